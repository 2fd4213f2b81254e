"""Source audit, ranked lexical search, forest near-duplicates: edge cases and brute force."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from turnloom.llm import dart_minhash, dual_tree, mixing, source_audit, token_files, tree_forest, url_filter

TERM = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_divergence(rows, least, top=10):
    df, counts = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        lang, source, terms = lang or "", source or "", TERM.findall((text or "").translate(LOWER))
        df[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = set()
    for lang in df:
        kept = [t for t, n in df[lang].items() if n >= least]
        sources = [s for la, s in counts if la == lang]
        n = {s: sum(counts[lang, s][t] for t in kept) for s in sources}
        p = {s: {t: 1 + 10**9 * (counts[lang, s][t] + 2) // (n[s] + 2 * len(kept)) for t in kept} for s in sources}
        q = {t: 1 + 10**9 * (sum(counts[lang, s][t] for s in sources) + 2) // (sum(n.values()) + 2 * len(kept)) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, o, v, r) for r, (v, o) in enumerate(found, 1) if part == "pair" or r <= top}
    return out


def audited(spark, rows, least, **more):
    frame = spark.createDataFrame([(i, *r, "x", 1) for i, r in enumerate(rows)], "doc_id long, lang string, source string, text string, term string, place int")
    got = source_audit.divergence(frame, least=least, **more).collect()
    assert len(set(got)) == len(got)
    return {tuple(r) for r in got}


def test_divergence_equals_brute_force_with_copies_nulls_and_ties(spark):
    pick = random.Random(5)
    words = [f"Wort{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)] + ["éÉ", "ß", "Éa", "x1y"]
    rows = [(pick.choice(["de", "fr", None]), pick.choice(["a", "b", "c", None, "é"]),
             " ".join(pick.choices(words, k=pick.randint(0, 40))) + "." * pick.randint(0, 2)) for _ in range(150)]
    rows += [("de", "hot", "the same Text again, again")] * 70 + [("de", "a", "the same Text again, again")] * 3
    rows += [("de", "mute", None), ("fr", "mute", ""), ("solo", "one", "alone"), ("few", "a", "x y"), ("few", "b", "z"), ("de", "long", "Zug " * 50_000)]
    want = brute_divergence(rows, least=5)
    assert audited(spark, rows, 5) == want
    # Blocks of two sources, and counts that are passed on early, change nothing.
    assert audited(spark, rows, 5, block=2, held=7) == want


def test_divergence_of_nothing(spark):
    assert audited(spark, [], 1) == set()
    assert audited(spark, [("de", "a", None), ("de", "b", "x")], 2) == {("de", "a", "pair", "b", 0, 1), ("de", "b", "pair", "a", 0, 1)}


@pytest.mark.parametrize("count,total,kept", [(0, 0, 1), (9_000_000_001, 30_000_000_000, 12), (4_000_000_000_000, 4_000_000_000_000, 3)])
def test_shares_are_exact_for_large_counts(spark, count, total, kept):
    row = spark.range(1).selectExpr(f"{count}L AS c", f"{total}L AS n", f"{kept}L AS v").select(source_audit._share("c", "n", "v").alias("p"))
    assert row.first().p == 1 + 10**9 * (count + 2) // (total + 2 * kept)


def brute_links(vectors, similar=0.9):
    ids = sorted(vectors)
    values = np.array([np.pad(np.array(vectors[i], np.float64), (0, 12 - len(vectors[i]))) for i in ids])
    norms = np.sqrt((values ** 2).sum(1))
    linked = (values @ values.T) / np.outer(norms, norms) >= similar
    np.fill_diagonal(linked, False)
    root = {i: i for i in ids}
    moved = True
    while moved:
        moved = False
        for at, i in enumerate(ids):
            least = min([root[i], *(root[ids[k]] for k in np.flatnonzero(linked[at]))])
            moved, root[i] = moved or least != root[i], least
    return {i: (int(linked[at].sum()), root[i]) for at, i in enumerate(ids)}


def forest(spark, rows, **more):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, leaf long, n long, rep string")
    got = tree_forest.near_duplicates(frame, **more).collect()
    assert all(r.kept == (None if r.vec_id is None else r.vec_id == r.component_id) for r in got)
    return got


def test_forest_equals_brute_force_over_many_leaves(spark):
    pick = np.random.default_rng(3)
    centres = pick.standard_normal((60, 12))
    plain = {int(7 * i): (centres[i % 60] + 0.22 * pick.standard_normal(12)).astype(np.float32).tolist() for i in range(700)}
    plain |= {10_000 + i: [1.0] * 12 for i in range(300)} | {20_000 + i: [0.5, 2.0 + i] for i in range(5)}
    rows = [(i, v, 0, 1, 1, "x") for i, v in plain.items()]
    rows += [(i, v, 0, 1, 1, "x") for i, v in list(plain.items())[:40]]  # repeated rows
    odd = {30_000: None, 30_001: [0.0] * 12, 30_002: [1.0, None], 30_003: [float("nan")] * 12, 30_004: [float("inf"), 1.0], 30_005: []}
    rows += [(i, v, None, 1, 1, None) for i, v in odd.items()] + [(None, [1.0] * 12, 0, 1, 1, "x")] * 2
    want = brute_links(plain)
    got = {r.vec_id: (r.n_links, r.component_id) for r in forest(spark, rows, leaf=60, sample=200) if r.vec_id is not None}
    assert {i: got[i] for i in odd} == {i: (0, i) for i in odd} and set(got) == set(want) | set(odd)
    found, there = sum(got[i][0] for i in want), sum(n for n, _ in want.values())
    assert all(got[i][0] <= want[i][0] for i in want) and found >= 0.99 * there
    assert sum(got[i] == want[i] for i in want) >= 0.97 * len(want)


def test_forest_counts_a_pair_once_and_splits_leaves_that_no_plane_splits(spark):
    rows = [(i, [float(i + 1), float(i + 1)], 0, 1, 1, "x") for i in range(130)] + [(500, [1.0, -1.0], 0, 1, 1, "x")]
    got = {r.vec_id: (r.n_links, r.component_id) for r in forest(spark, rows, leaf=20, trees=3)}
    assert got == {i: (129, 0) for i in range(130)} | {500: (0, 500)}


def test_forest_of_nothing_and_of_large_values(spark):
    assert forest(spark, []) == []
    rows = [(1, [3e38, 3e38], 0, 1, 1, "x"), (2, [1e-40, 1e-40], 0, 1, 1, "x"), (3, [3e38, -3e38], 0, 1, 1, "x")]
    assert {(r.vec_id, r.n_links, r.component_id) for r in forest(spark, rows)} == {(1, 1, 1), (2, 1, 1), (3, 0, 3)}


WORD = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_ranking(docs, items, top):
    terms = lambda text: WORD.findall((text or "").translate(LOWER))
    bags = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, n_terms = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    asked = defaultdict(set)
    for item, text in items:
        asked[item] |= set(terms(text))
    df = Counter(t for _, b in bags for t in b)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
    out = []
    for item, wanted in asked.items():
        scores = []
        for doc, bag in bags:
            m = 100 - 50 + 50 * sum(bag.values()) * n_docs // max(1, n_terms)
            score = sum(weight[t] * (10**9 * bag[t] // (1000 * bag[t] + 20 * m)) for t in wanted if t in bag)
            if score > 0 and doc is not None:
                scores.append((-score, doc))
        out += [(item, r, d, -s) for r, (s, d) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=str)


def ranking(spark, rows, items, top=50, **more):
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, term string, n int")
    asked = spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, node int")
    return sorted((tuple(r) for r in dual_tree.search(frame, asked, top, **more).collect()), key=str)


def lexical_case(n):
    pick = random.Random(8)
    words = [f"w{i}" for i in range(400)] + ["É", "naïve", "x1"]
    draw = lambda k: " ".join(pick.choices(words, weights=[1 / (i + 2) for i in range(len(words))], k=k))
    docs = [(i, draw(pick.randint(0, 60))) for i in range(n)]
    items = [(i, draw(12) + " absent") for i in range(23)]
    docs += [(1000 + i, items[3][1] + " and More") for i in range(60)]  # ties beyond the last place
    docs += [(5, "w7 w9"), (5, "w7 w9"), (None, items[0][1]), (9_000, None), (9_001, ""), (9_002, "W3 " * 40_000), (9_003, "-- ..")]
    items += [(3, "w399 extra"), (None, "w5 w6"), (77, None), (78, "nowhere")]
    return docs, items


def test_ranking_equals_brute_force_with_ties_nulls_and_repeats(spark):
    docs, items = lexical_case(500)
    want = brute_ranking(docs, items, 50)
    assert ranking(spark, docs, items) == want
    # Many nodes, and items in several batches.
    assert ranking(spark, docs, items, 7, docs=4, leaves=3, at_once=60) == brute_ranking(docs, items, 7)


def test_ranking_of_nothing(spark):
    assert ranking(spark, [], [(1, "a b")]) == [] and ranking(spark, [(1, "a b")], []) == []
    assert ranking(spark, [(1, "a b")], [(1, None), (2, "c")]) == []


def test_bounds_prune_whole_batches_of_items():
    weights = np.arange(1, 401)
    built = dual_tree.build_items(list(range(64)), [np.arange(6 * i, 6 * i + 6, dtype=np.int32) for i in range(64)], weights)
    greatest = np.zeros(400)
    greatest[built.of(40)[0]] = 1000
    score = float((built.of(40)[1] * 1000).sum())
    assert list(dual_tree.surviving(built, np.full(64, score), greatest)) == [40]
    assert list(dual_tree.surviving(built, np.full(64, score + 1), greatest)) == []
    assert sorted(built.ids) == list(range(64)) and len(built.nodes) > 20
    assert all(set(built.of(i)[0]) <= set(t) for a, b, _, t, _ in built.nodes for i in range(a, b))


def test_columns_of_any_name_pass_through(spark):
    odd = ["_key", "_block", "_w0", "_raw", "_kept_id", "_mix_words", "_given", "_url", "host", "a.b"]
    rows = [(1, "s", "one two three", "http://a.net/x", *["v"] * len(odd)), (2, "s", "one two three", "http://b.org/fr/x", *["v"] * len(odd))]
    frame = spark.createDataFrame(rows, ["doc_id", "source", "text", "url", *odd])
    judged = url_filter.filter_urls(frame, spark.createDataFrame([("b.org/fr/x",)], "key string"), [url_filter.Rule("block", "net", "/")]).collect()
    assert {(r.doc_id, r.verdict, r._key, r._block, r["a.b"]) for r in judged} == {(1, "block", "v", "v", "v"), (2, "block", "v", "v", "v")}
    assert [(r.doc_id, r._raw, r["a.b"]) for r in dart_minhash.one_of_each(frame).collect()] == [(1, "v", "v")]
    mixed = mixing.mixed_documents(frame)
    assert mixed.columns == frame.columns and {r._mix_words for r in mixed.collect()} == {"v"}


def test_words_are_encoded_once_and_as_the_library_does():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain, encoder, pick = Tokenizer.from_file(path), token_files.WordEncoder(path, 2), random.Random(4)
    bits = ["word", "It's", "THE", "É", "œuvre", "Σας", "İx", "ẖ", "H̱", "x²", "ʰ", "ß", "µ", "ª", "don't", "'", "***", "%%%", ".", ",", ".,", "!", "?.", " ", " ", "\n",
            "\t", "\x0b", " ", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "3", "中文", "é", "́", "-", "_", "a.b", "çà,", "Œ."]
    texts = ["".join(pick.choice(bits) + pick.choice(["", "", " ", ". ", ", "]) for _ in range(pick.randint(0, 25))) for _ in range(3000)]
    texts += ["".join(pick.choice(bits[:3] + bits[14:25] + ["é", "à. ", "à? "]) for _ in range(12)) for _ in range(1500)]
    for at in range(0, len(texts), 500):
        wanted = [plain.encode(t, add_special_tokens=False).ids + [2] for t in texts[at:at + 500]]
        assert [np.frombuffer(x, np.uint32).tolist() for x in encoder(texts[at:at + 500])] == wanted
    # A word that comes again in a later batch, or with other stops or in capitals, is not encoded again.
    asked = []
    encoder._each = lambda words: asked.extend(words) or [b"\0\0\0\0"] * len(words)
    encoder._together = lambda words: asked.extend(words) or {w: b"\0\0\0\0" for w in words}
    for text in ("qwertaz qwertbz", "Qwertaz. QWERTBZ*** qwertaz, x"):
        encoder([text])
    assert sorted(w for w in asked if w.lower().startswith("qwert")) == ["qwertaz", "qwertbz"]
