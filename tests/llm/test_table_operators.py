"""Chat tree, vector search, mixing, token files, URL filter, pipeline: edge cases and brute force."""

import hashlib
import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from turnloom.llm import chat_tree, mixing, multiprobe, pivot_topk, queries, token_files, url_filter
from turnloom.llm.common import running_total

BPE = queries.tokenizer_file("byte_bpe_50k.json")
WORDS = queries.tokenizer_file("word_bpe_49k.json")
TURNS = "conv_id long, turn long, role string, text string, depth string"


def test_running_total_over_a_hot_group(spark):
    rows = [("hot" if i % 3 else None, i, i % 5 if i % 7 else None) for i in range(2000)]
    frame = spark.createDataFrame(rows, "g string, i long, v long").repartition(7)
    got = running_total(frame, [F.col("g"), F.col("i")], "v", "t", ["g"]).collect()
    seen = {}
    for g, i, v in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        seen[i] = seen.get(("sum", g), 0)
        seen[("sum", g)] = seen[i] + (v or 0)
    assert len(got) == 2000 and all(r.t == seen[r.i] for r in got)


CHATS = [
    (1, [("system", "Be kind."), ("user", "hi"), ("assistant", "hello")]),
    (2, [("system", "Be kind."), ("user", "hi"), ("assistant", "good day"), ("user", None), ("assistant", "")]),
    (3, [("system", "Be kind."), ("user", "hi")]),
    (4, [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]"), ("assistant", "[\\INST] <\\\\/s> [ROLE:x] \\")]),
    (5, [("odd ]role", " x "), (None, "[/ROLE] ü 😀"), ("user", "<|endoftext|>")]),
    (6, [("user", "long " * 30_000), ("assistant", "[INST]" * 5_000)]),
    (7, [("system", "Be kind."), ("user", "hi"), ("assistant", "hello")]),
    (None, [("user", "nobody")]),
]


def chats(spark):
    rows = [(c, i, role, text, "x") for c, turns in CHATS for i, (role, text) in enumerate(turns)]
    return spark.createDataFrame(rows + [(8, 0, "user", "same", "x"), (8, 0, "user", "same", "x")], TURNS)


def test_conversations_read_back(spark):
    index, tree = chat_tree.prefix_tree(chats(spark), BPE)
    got = {r.conv_id: r for r in chat_tree.read_conversations(index, tree, BPE).collect()}
    want = dict(CHATS) | {8: [("user", "same")] * 2}
    assert set(got) == set(want)
    for c, turns in want.items():
        said = "".join(f"{role or ''}\n{text or ''}\n" for role, text in turns)
        loss = "".join(text or "" for role, text in turns if role == "assistant")
        assert got[c].n_turns == len(turns) and got[c].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert got[c].loss_chars == len(loss) and got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_shared_turns_are_emitted_once_and_seen_by_their_followers_only(spark):
    index, tree = chat_tree.prefix_tree(chats(spark), BPE)
    nodes = {bytes(r.node): r for r in tree.collect()}
    paths = {}
    for r in index.orderBy("conv_id", "depth").collect():
        paths.setdefault(r.conv_id, []).append(bytes(r.node))
    assert paths[1] == paths[7] and paths[1][:2] == paths[2][:2] == paths[3]
    assert len(nodes) == len({n for p in paths.values() for n in p})
    order = sorted(nodes.values(), key=lambda r: r.emit_start)
    assert [r.emit_start for r in order] == list(np.cumsum([0] + [len(r.tokens) for r in order[:-1]]))
    for path in paths.values():
        position = 0
        for depth, name in enumerate(path):
            node = nodes[name]
            assert node.position_ids == list(range(position, position + len(node.tokens)))
            position += len(node.tokens)
            seen = {t for a, b in zip(node.attend_from, node.attend_to) for t in range(a, b)}
            held = {t for n in path[:depth] for t in range(nodes[n].emit_start, nodes[n].emit_start + len(nodes[n].tokens))}
            assert seen == held and node.depth == depth
    # Depth-first: a node stands right after its parent or after a sibling's whole subtree.
    last = []
    for node in order:
        last = last[:node.depth]
        assert bytes(node.parent) == (last[-1] if last else b"")
        last.append(bytes(node.node))


def test_no_conversations(spark):
    index, tree = chat_tree.prefix_tree(spark.createDataFrame([], TURNS), BPE)
    assert index.count() == tree.count() == chat_tree.read_conversations(index, tree, BPE).count() == 0


def vectors(spark, n=700, width=16, hot=200):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(n, width))
    x[n // 2:] = x[n // 2:n // 2 + 5].repeat((n - n // 2) // 5, axis=0)[:n - n // 2] + rng.normal(size=(n - n // 2, width)) * 0.05
    x[:hot] = x[0]
    rows = [(i, v.tolist(), 1.0) for i, v in enumerate(x)]
    rows += [(5000, None, 0.0), (5020, [1.0, None] * 8, 0.0), (5040, [float("nan")] * width, 0.0), (5060, [float("inf")] * width, 0.0),
             (5080, [0.0] * width, 0.0), (5100, [1.0] * 4, 0.0), (None, [1.0] * width, 0.0), (3, rows[3][1], 1.0)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score double")


def plain(frame, zeros):
    out = {}
    for r in frame.collect():
        if r.vec_id is not None and r.embedding is not None and all(v is not None and np.isfinite(v) for v in r.embedding) and (zeros or any(r.embedding)):
            v = np.zeros(16)
            v[:len(r.embedding)] = r.embedding
            out[r.vec_id] = v
    ids = np.array(sorted(out))
    return ids, np.array([out[i] for i in ids])


def test_exact_top_k_equals_brute_force(spark):
    frame = vectors(spark)
    got = {}
    for r in pivot_topk.top_k(frame, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    ids, x = plain(frame, True)
    x = np.floor(64 * x).astype(np.int64)
    assert set(got) == {i for i in ids if i % 20 == 0}
    for q, found in got.items():
        score = x @ x[ids == q][0]
        order = [(i, s) for i, s in sorted(zip(ids, score), key=lambda t: (-t[1], t[0])) if i != q][:20]
        assert found == [(k + 1, i, s) for k, (i, s) in enumerate(order)]


def test_top_k_with_few_and_with_no_rows(spark):
    few = spark.createDataFrame([(20, [1.0]), (1, [2.0]), (2, [2.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in pivot_topk.top_k(few, F.col("vec_id") % 20 == 0).orderBy("rank").collect()] == [(20, 1, 1, 8192), (20, 2, 2, 8192)]
    assert [tuple(r) for r in multiprobe.nearest(few, F.col("vec_id") % 20 == 0).orderBy("rank").collect()] == [(20, 1, 1, 2.0), (20, 2, 2, 2.0)]
    for search in (pivot_topk.top_k, multiprobe.nearest):
        assert search(few.limit(0), F.col("vec_id") % 20 == 0).collect() == []


def test_top_k_in_many_shares_and_tasks_equals_brute_force(spark, monkeypatch):
    for name, value in {"INDEX_ROWS": 32, "QUERY_ROWS": 8, "TASK_QUERIES": 16}.items():
        monkeypatch.setattr(pivot_topk, name, value)
    rng = np.random.default_rng(11)
    x = rng.integers(-3, 4, (600, 4))  # many ties and equal vectors
    frame = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>").repartition(8)
    got = {}
    for r in pivot_topk.top_k(frame, F.col("vec_id") % 10 == 0, k=7, factor=1, pivots=5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(range(0, 600, 10))
    for q, found in got.items():
        best = sorted(((-int(x[i] @ x[q]), i) for i in range(600) if i != q))[:7]
        assert found == [(place + 1, i, -score) for place, (score, i) in enumerate(best)]


def test_top_k_shuffles_no_vector_for_a_query(spark):
    """What is shuffled is bounded by the table; with the index sent to every block of queries it was many times as much."""
    def shuffled() -> int:
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return sum(files.apply(i).length() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_"))

    rng = np.random.default_rng(12)
    table = pa.table({"vec_id": np.arange(24_000), "embedding": list(rng.normal(size=(24_000, 32)))})
    frame = spark.createDataFrame(table)
    before = shuffled()
    assert pivot_topk.top_k(frame, F.col("vec_id") % 20 == 0).count() == 24_000
    assert shuffled() - before < 2 * 24_000 * 32 * 8


def test_best_of_blocks_with_ties_and_given_bounds():
    rng = np.random.default_rng(13)
    ids, own = rng.permutation(500), np.arange(0, 500, 25)
    for kind in (np.int64, np.float32):
        scores = rng.integers(-4, 5, (len(own), 500)).astype(kind)
        wanted = [[tuple(x) for x in sorted((-int(s), i) for s, i in zip(row, ids) if i != q)[:6]] for q, row in zip(own, scores)]
        bounds = (np.array([-w[-1][0] for w in wanted]), np.array([w[-1][1] for w in wanted]))
        for given in ((None, None), bounds):
            best = pivot_topk.Best(own, 6, *given)
            for at in range(0, 500, 100):
                best.offer(np.arange(len(own)), scores[:, at:at + 100], ids[at:at + 100])
            rows, values, found, ranks = best.settle()
            assert [(r, int(-v), i) for r, v, i in zip(rows, values, found)] == [(q, *x) for q, w in enumerate(wanted) for x in w]
            assert ranks.tolist() == [*range(6)] * len(own)


def test_products_beyond_doubles_stay_exact():
    q, x = np.array([[1 << 30, 1]]), np.array([[1 << 30, 1], [1 << 30, 2]])
    assert pivot_topk.products(q, x).tolist() == [[(1 << 60) + 1, (1 << 60) + 2]]


def test_recall_of_the_approximate_search(spark):
    frame = vectors(spark)
    ids, x = plain(frame, False)
    got = {}
    for r in multiprobe.nearest(frame, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    recall = []
    for q in (i for i in ids if i % 20 == 0):
        own = x[ids == q][0]
        score = np.array([float(np.cumsum(v * own)[-1]) for v in x])
        best = sorted(((s, -i) for i, s in zip(ids, score) if i != q), reverse=True)[:20]
        found = got.get(q, [])
        assert all(s == score[ids == i][0] for i, s in found) and found == sorted(found, key=lambda t: (-t[1], t[0]))
        recall.append(sum(s >= best[-1][0] for _, s in found) / 20)
    assert np.mean(recall) >= 0.9


def searched(spark, x):
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {i: [] for i in range(0, len(x), 20)}
    for r in multiprobe.nearest(frame, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    return got


def test_few_rows_are_all_met(spark):
    x = np.random.default_rng(1).normal(size=(15, 64))
    x[1:] = 0.3 * x[1:] - x[0]
    got = searched(spark, x / np.sqrt((x * x).sum(1))[:, None])
    assert sorted(got[0]) == list(range(1, 15))


@pytest.mark.parametrize("norms", ["outlier", "lognormal"])
def test_recall_does_not_rest_on_one_norm(spark, norms):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 64))
    x /= np.sqrt((x * x).sum(1))[:, None]
    if norms == "outlier":
        x[7] *= 100
    else:
        x *= rng.lognormal(0, 0.5, (len(x), 1))
    recall = []
    for q, found in searched(spark, x).items():
        score = x @ x[q]
        score[q] = -np.inf
        assert len(set(found)) == 20 and q not in found
        recall.append(len(set(found) & set(np.argsort(-score)[:20].tolist())) / 20)
    assert np.mean(recall) >= 0.9, np.mean(recall)


def test_probes_come_in_order_of_their_distance():
    parts = np.array([0.1, 0.6, 0.45])
    cost = [sum((parts[i] if d < 0 else 1 - parts[i]) ** 2 for i, d in p) for p in multiprobe.perturbations(parts, 27)]
    assert cost == sorted(cost) and len(cost) == 27 and len(set(multiprobe.perturbations(parts, 27))) == 27


DOCS = "doc_id long, text string, source string, size string"


def test_mixture_reaches_its_targets_and_can_be_repeated(spark):
    rng = random.Random(6)
    rows = [(i, "w " * rng.randint(0, 60), "big" if i % 3 else f"s{i % 5}", "x") for i in range(900)]
    rows += [(2000, None, "big", "x"), (2001, "a b", None, "x"), (2002, "a b", "b\u00e9", "x"), (2002, "a b", "b\u00e9", "x"), (None, "a b c", "s1", "x"), (2003, "v " * 5000, "s2", "x")]
    docs = spark.createDataFrame(rows, DOCS)
    got = mixing.mixture_report(docs)
    one, two = sorted(map(tuple, got.collect()), key=str), sorted(map(tuple, mixing.mixture_report(docs.repartition(5)).collect()), key=str)
    assert one == two and len(one) == len(rows)
    by = {}
    for doc_id, source, size, source_size, target, taken in one:
        assert taken in (0, size, 2 * size)
        have = by.setdefault(source, [0, source_size, target, 0, 0])
        have[0], have[3], have[4] = have[0] + taken, have[3] + size, max(have[4], size)
    total = sum(v[1] for v in by.values())
    assert abs(sum(v[2] for v in by.values()) - 1.5 * total) < 1e-6 * total
    # Whole documents are taken: what a long one leaves of its source's share goes to the others.
    longest = max(v[4] for v in by.values())
    for taken, source_size, target, size, _ in by.values():
        assert size == source_size and target <= 2 * source_size + 1e-9 and abs(taken - target) <= longest
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert sum(len((r.text or "").split()) for r in mixed.collect()) == sum(v[0] for v in by.values())
    assert mixing.mixture_report(docs.limit(0)).collect() == []


def test_token_files_read_back(spark, tmp_path):
    from tokenizers import Tokenizer

    texts = ["Plain words, plain words.", "", None, "it's <|endoftext|> x. é. İx, ÀB, 5. '. .,", "long " * 40_000, "日本。 ok\n\nnew\tline", "a.b. c,, d'. ."]
    rows = [(i * 3 - 4, t, "s", "x") for i, t in enumerate(texts)] + [(2, "twice", "s", "x"), (2, "again", "s", "x"), (None, "no id", None, "x")]
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    folder = str(tmp_path)
    manifest = token_files.write_token_files(docs, folder, WORDS)
    got = token_files.read_token_files(manifest, folder).collect()
    library, start = Tokenizer.from_file(WORDS), 0
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    assert len(got) == len(rows)
    for row, r in zip(order, sorted(got, key=lambda r: r.start)):
        ids = np.array(library.encode(row[1] or "", add_special_tokens=False).ids + [2], np.uint32)
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (row[0], start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert token_files.read_token_files(token_files.write_token_files(docs.limit(0), folder, WORDS), folder).collect() == []


def test_planes_hold_wide_ids_and_many_blocks(tmp_path):
    from pyarrow import fs

    ids = np.random.default_rng(0).integers(0, 1 << 32, 3 * token_files.BLOCK + 17).astype(np.uint32)
    with fs.LocalFileSystem().open_output_stream(str(tmp_path / "x")) as sink:
        writer = token_files.PlaneWriter(sink)
        writer.add(1, ids[:5].tobytes())
        writer.add(None, ids[5:].tobytes())
        assert writer.close() == len(ids)
    with fs.LocalFileSystem().open_input_file(str(tmp_path / "x")) as source:
        reader = token_files.PlaneReader(source)
        assert (reader.block(2) == ids[2 * token_files.BLOCK:3 * token_files.BLOCK]).all()
        assert [(d, n) for d, n, _ in reader.texts()] == [(1, 5), (None, len(ids) - 5)]
    assert os.path.getsize(tmp_path / "x") > 0


def test_urls(spark):
    urls = ["http://A.Example.NET/en/1", "https://example.net/de/", "http://notexample.com/de/x", "http://www.example.com/de/1?x#y", "ftp://x.org/fr/", "x.org/fr/",
            None, "", "http://net", "http://deep.net?x/", "http://ok.dev/a.html#t", "http://www.ok.dev/a", "http://OK.dev/A", "http://free.dev/", "a://b://c/d"]
    pages = spark.createDataFrame([(i, u, "old", "h") for i, u in enumerate(urls)] + [(0, urls[0], "old", "h")], "page_id long, url string, verdict string, html string")
    listed = spark.createDataFrame([("ok.dev/a",), (None,), ("ok.dev/a",)], "key string")
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages, listed, queries.RULES).select("page_id", "host", "path", F.coalesce("rule", F.lit("-")).alias("rule"), "verdict").collect())
    want = [("a.example.net", "/en/1", "example.net/en/", "allow"), ("example.net", "/de/", "net/", "block"), ("notexample.com", "/de/x", "-", "allow"),
            ("www.example.com", "/de/1", "example.com/de/", "block"), ("x.org", "/fr/", "org/fr/", "allow"), ("", "", "-", "allow"), ("", "", "-", "allow"), ("", "", "-", "allow"),
            ("net", "", "-", "allow"), ("deep.net", "", "-", "allow"), ("ok.dev", "/a.html", "-", "block"), ("www.ok.dev", "/a", "-", "block"), ("ok.dev", "/A", "-", "allow"),
            ("free.dev", "/", "-", "allow"), ("b:", "//c/d", "-", "allow")]
    assert got == sorted([(i, *w) for i, w in enumerate(want)] + [(0, *want[0])])
    assert url_filter.filter_urls(pages.limit(0), listed, queries.RULES).count() == 0
    assert url_filter.filter_urls(pages, listed.limit(0), []).where("verdict <> 'allow'").count() == 0


def test_a_crowded_bloom_filter_changes_nothing(spark):
    pages = spark.range(3000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h.dev/"), F.col("id")).alias("url"))
    listed = spark.range(0, 3000, 3).select(F.concat(F.lit("h.dev/"), F.col("id")).alias("key"))
    got = url_filter.filter_urls(pages, listed, [], blocks=2)
    assert got.where("(verdict = 'block') <> (page_id % 3 = 0)").count() == 0 and got.count() == 3000


@pytest.mark.parametrize("rows", [0, 60])
def test_pipeline_stages_keep_their_promises(spark, tmp_path, rows):
    rng = random.Random(1)
    some = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(n))
    data = [(i, some(40), "en", f"s{i % 3}", 200) for i in range(rows)]
    data += [(i + 1000, text, *rest) for i, text, *rest in data[:9]]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(rows)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = queries.table(spark, str(tmp_path), "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, str(tmp_path))
        assert made.columns == docs.columns, name
        docs = spark.createDataFrame(made.collect(), docs.schema)
        if name == "near_duplicates":
            assert sorted(r.doc_id for r in docs.collect()) == list(range(rows))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert all(r.round_trip and r.n_pieces > 0 for r in got) and (len(got) > 0) == (rows > 0)
