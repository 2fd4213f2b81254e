"""Toxicity, language model, near-duplicates, piece ids: edge cases and brute force."""

import math
import random
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from turnloom.llm import dart_minhash, maxent_lm, piece_codec, toxicity
from turnloom.llm.components import components
from turnloom.llm.queries import tokenizer_file

DOCS = "doc_id long, text string, source string, severity string"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(240):
        bad = i % 4 == 0
        text = words(rng, 40)
        if bad:
            text += "".join(f" {rng.choice(['grumpo', 'snarkle', 'fizzwit'])}{rng.choice(['', 'er', 'ish'])}!" for _ in range(2 + i % 5))
        rows.append((i, text, "s", "x"))
        labels.append((i, int(bad)))
    rows += [(900, None, None, None), (901, "", "s", "x"), (902, "Grumpoish snarkle FIZZWIT " * 4000, "s", "x"), (3, rows[3][1], "s", "x")]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels + [(901, None), (None, 1)], "doc_id long, toxic int")


def test_severity_separates_and_keeps_rows(spark, labelled):
    docs, labels = labelled
    got = toxicity.severity_of(docs, labels).collect()
    assert len(got) == docs.count() and {c for c in got[0].asDict()} == {"doc_id", "text", "source", "severity", "grade", "rejected"}
    by = {r.doc_id: r for r in got}
    assert by[902].rejected and by[902].severity > 1 and not by[900].rejected and not by[901].rejected
    held = [r.rejected == (r.doc_id % 4 == 0) for r in got if r.doc_id < 240]
    assert sum(held) / len(held) > 0.97
    many = np.mean([by[i].severity for i in range(0, 240, 4) if i % 5 == 4])
    few = np.mean([by[i].severity for i in range(0, 240, 4) if i % 5 == 0])
    assert many > few


def test_ordinal_fit_orders_thresholds_and_recovers_grades():
    rng = np.random.default_rng(1)
    grade = rng.integers(0, 4, 400)
    flat, rows = [], []
    for i, g in enumerate(grade):
        for f in {int(x) for x in rng.integers(0, 50, 5)} | {100 + k for k in range(g)}:
            flat.append(f)
            rows.append(i)
    model = toxicity.fit(np.array(flat, np.int32), np.array(rows, np.int32), grade)
    margins = np.bincount(rows, weights=model.weights[np.array(flat)], minlength=400)
    assert (np.diff(model.thresholds) > 0).all()
    assert np.corrcoef(model.expected(margins), grade)[0, 1] > 0.9
    assert np.allclose(model.probabilities(margins).sum(1), 1)


def test_fit_follows_the_slope_to_an_optimum():
    rng = np.random.default_rng(4)
    flat, rows, grade = rng.integers(0, 6, 300), np.sort(rng.integers(0, 90, 300)), rng.integers(0, 4, 90)
    loss = lambda v: toxicity._loss(v, flat, rows, grade, 6, 0.7)
    at = np.concatenate([rng.standard_normal(7), [0.3, -0.4]])
    step = 1e-6
    slopes = [(loss(at + step * e)[0] - loss(at - step * e)[0]) / (2 * step) for e in np.eye(9)]
    assert np.allclose(slopes, loss(at)[1], rtol=1e-5, atol=1e-5)
    found = toxicity.minimise(loss, at)
    assert np.abs(loss(found)[1]).max() <= 1e-4 * max(1.0, np.abs(loss(at)[1]).max())
    assert all(loss(found)[0] <= loss(found + 0.01 * rng.standard_normal(9))[0] for _ in range(20))


def test_less_ridge_fits_the_training_texts_no_worse():
    rng = np.random.default_rng(2)
    toxic = (np.arange(600) % 8 == 0).astype(int)
    lists = [np.unique(np.concatenate([rng.integers(0, 3000, 40), 5000 + rng.integers(0, 12, 2 + i % 3) if t else []])).astype(np.int32) for i, t in enumerate(toxic)]
    flat, rows = np.concatenate(lists), np.repeat(np.arange(600), [len(x) for x in lists])
    grade = toxicity.grades_of(flat, rows, toxic)
    apart = []
    for ridge in (10.0, 1.0, 0.1):
        margins = np.bincount(rows, weights=toxicity.fit(flat, rows, grade, ridge=ridge).weights[flat], minlength=600)
        apart.append((margins[toxic == 1][:, None] > margins[toxic == 0]).mean())
    assert apart == sorted(apart) and apart[-1] > 0.999


def test_cut_lies_in_the_widest_gap_of_the_best():
    assert toxicity.choose_cut(np.array([0.1, 0.1, 0.2, 0.9]), np.array([0, 0, 0, 1])) == (1.0, pytest.approx(0.55))
    assert toxicity.choose_cut(np.array([0.1, 0.3]), np.array([0, 0])) == (0.0, 0.5)
    assert toxicity.choose_cut(np.array([0.5, 0.5]), np.array([0, 1])) == (0.0, 0.5)


def test_sample_has_one_text_of_each_id_and_clashing_columns_stay(spark):
    docs = spark.createDataFrame([(1, f"text {i}", "s", "x") for i in range(50)] + [(2, None, "s", "x")], DOCS)
    labels = spark.createDataFrame([(1, 1), (2, 0), (1, 0)], "doc_id long, toxic int")
    assert [(r.doc_id, r.toxic) for r in toxicity.labelled_sample(docs, labels).collect()] == [(1, 1)]
    clash = docs.selectExpr("doc_id", "text", "7 AS _text", "8 AS __text")
    assert {(r._text, r["__text"]) for r in toxicity.severity_of(clash, labels).collect()} == {(7, 8)}


def test_severity_of_empty_tables(spark):
    empty, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.severity_of(empty, labels).collect() == []
    one = toxicity.severity_of(spark.createDataFrame([(1, "a", None, None)], DOCS), labels).first()
    assert one.severity < 1e-9 and not one.rejected


def test_language_model_base_matches_the_definition(spark):
    rng = random.Random(2)
    texts = {i: words(rng, 30 + i % 40) + (" The the THE" if i % 3 else "\n\tthe") for i in range(120)}
    texts |= {200: None, 201: "", 202: "the " * 30_000, 203: "unseen\x0bwords é"}
    docs = spark.createDataFrame([(i, t, "s", "x") for i, t in texts.items()] + [(5, texts[5], "s", "x"), (None, "the end", None, None)], DOCS)
    got = maxent_lm.score_texts(docs).collect()
    assert len(got) == len(texts) + 2
    learned = Counter()
    for i, t in [*texts.items(), (5, texts[5]), (None, "the end")]:
        if crc32(b"" if i is None else str(i).encode()) % 7 != 2:
            learned.update(maxent_lm.tokens_of(t))
    total, distinct = sum(learned.values()), len(learned)
    for r in got:
        tokens = maxent_lm.tokens_of(texts.get(r.doc_id, "the end"))
        base = sum(math.log10((learned[t] + 1) / (total + distinct + 1)) for t in tokens)
        assert r.train_tokens == total and r.n_tokens == len(tokens) and r.n_known == sum(t in learned for t in tokens)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isfinite(r.score) and r.score < 0
    assert maxent_lm.score_texts(spark.createDataFrame([], DOCS)).collect() == []


def test_probabilities_of_all_words_add_up_to_one(spark):
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, words(rng, 50), "s", "x") for i in range(60)], DOCS)
    learned = docs.where(maxent_lm.fold(docs.doc_id) != 2)
    counts = maxent_lm.count_words(learned)
    known = maxent_lm.vocabulary(counts, listed=400)
    assert 0 < len(known.words) <= 400 < known.distinct
    weights = maxent_lm.train(maxent_lm.number(docs, known, 2), known)
    # Each word, and one unknown word of each ending, after the same two words.
    every = {bytes(r.token): r.n for r in counts.collect()}
    first = known.words[0].decode(), known.words[1].decode()
    rows = [(i, " ".join([*first, w.decode()])) for i, w in enumerate(every) if w]
    rows += [(-1, " ".join(first))]
    scored = maxent_lm.score(maxent_lm.number(spark.createDataFrame(rows, "doc_id long, text string"), known, 2), counts, known, weights)
    model = maxent_lm.Model(known, weights)
    ids = {w: i for i, w in enumerate(known.words)}
    assert scored.count() == len(rows)
    a, b = ids[known.words[0]], ids[known.words[1]]
    ranks = np.array([a, b, a])
    rows_c, rows_w = model.contexts(ranks, known.classes[ranks], np.array([3]))
    chances, total = model.softmax(model.class_logits(rows_c[:, 2:]))
    share = chances[0] / total[0]
    mass = 0.0
    for k in range(maxent_lm.FREQUENT):
        lo, hi = known.starts[k], known.starts[k + 1]
        if hi - lo > 1:
            w, t = model.softmax(model.word_logits(rows_w[:, 2:], k))
            assert math.isclose((w / t[:, None]).sum(), 1, rel_tol=1e-5)
        mass += share[k] if hi > lo else 0
    listed = {k: sum(10 ** known.within[i] for i in range(len(known.words)) if known.classes[i] == k) for k in range(16, 32)}
    mass += sum(share[k] * v for k, v in listed.items())
    tail = np.ones(maxent_lm.ENDINGS)
    for w, n in every.items():
        if w not in ids:
            tail[maxent_lm.ending_class(w)] += n + 1
    assert np.allclose(tail, known.tail_weight)
    mass += share[32:].sum()
    assert 0.999 < mass < 1.001


def brute_classes(rows):
    sets = {}
    for i, text in rows:
        w = (text or "").lower().split()
        n = min(5, len(w))
        sets[i] = Counter(tuple(w[j:j + n]) for j in range(len(w) - n + 1)) if n else None
    ids, parent = list(sets), {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in ids:
        for j in ids:
            if i < j and sets[i] and sets[j]:
                both = sum((sets[i] & sets[j]).values())
                if both >= 0.8 * (sum(sets[i].values()) + sum(sets[j].values()) - both) - 1e-9:
                    parent[max(find(i), find(j))] = min(find(i), find(j))
    return {i: min(j for j in ids if find(j) == find(i)) for i in ids}


def near_rows():
    rng = random.Random(9)
    rows, base = [], [words(rng, 90) for _ in range(6)]
    for i in range(150):
        w = base[i % 6].split()
        for _ in range(i % 7):
            w[rng.randrange(len(w))] = words(rng, 1)
        rows.append((i, " ".join(w)))
    passage = words(rng, 60)
    rows += [(200 + i, words(rng, 50) + " " + passage) for i in range(40)]
    return rows + [(300, None), (301, ""), (302, "  \n"), (303, "two words"), (304, "Two  WORDS"), (305, "word " * 3000), (306, "word " * 2900)]


def test_near_duplicates_equal_brute_force(spark):
    rows = near_rows()
    docs = spark.createDataFrame([(i, t, "s", "x") for i, t in rows], DOCS)
    got = {r.doc_id: r.class_id for r in dart_minhash.classes(docs).collect()}
    assert got == brute_classes(rows)
    kept = dart_minhash.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(got.values()))


def test_near_duplicates_of_repeated_and_null_ids(spark):
    text = words(random.Random(1), 30)
    docs = spark.createDataFrame([(7, text, "s", "x"), (7, text, "s", "x"), (None, text, None, None), (9, text, "s", "x"), (None, None, None, None)], DOCS)
    got = sorted(((r.doc_id, r.class_id, r.n_rows) for r in dart_minhash.classes(docs).collect()), key=str)
    assert got == sorted([(7, 7, 4), (7, 7, 4), (None, 7, 4), (9, 7, 4), (None, None, 1)], key=str)
    assert [(r.doc_id, r.text) for r in dart_minhash.one_of_each(docs).orderBy("doc_id").collect()] == [(None, None), (7, text)]
    assert dart_minhash.classes(spark.createDataFrame([], DOCS)).collect() == []


def test_darts_estimate_weighted_similarity():
    rng = np.random.default_rng(4)
    one = rng.integers(0, 1 << 60, 300).astype(np.uint64)
    two = np.concatenate([one[:240], rng.integers(0, 1 << 60, 60).astype(np.uint64)])
    one, two = np.concatenate([one, one[:50]]), np.concatenate([two, two[:50]])
    names, texts = dart_minhash.columns_of(np.concatenate([one, two]), np.repeat([0, 1], [350, 350]))
    signed = dart_minhash.signatures(names, texts, 2, 2000)
    both = len(np.intersect1d(names[texts == 0], names[texts == 1]))
    assert both == 290 and abs((signed[0] == signed[1]).mean() - both / (700 - both)) < 0.04


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 200), (200, 150)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 150: 100, 200: 100}


ODD = ["", " ", "  a", "a  b\n\nc   d ", "\n", "日本 語テキスト 😀😀 x", "a" * 40 + " hello</s><s>", "tab\there \r\n crlf", "x" * 300,
       "a\u0000b", "e\u0301 é", "internationalization 12345 3.14 http://a.b/c?d=e", "word\n\n\nWord. word, Word"]


def test_piece_ids_equal_the_library(spark):
    import sentencepiece

    path = tokenizer_file("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    given = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").limit(60).collect()]
    texts = ODD + given + ["very long " * 20_000, None, "▁ mark"]
    docs = spark.createDataFrame([(i, t, "s", "x") for i, t in enumerate(texts)] + [(0, "", "s", "x")], DOCS).withColumnRenamed("severity", "n_pieces")
    got = piece_codec.encode_and_decode(docs, path)
    assert got.columns == ["doc_id", "source", "piece_ids", "n_pieces", "round_trip"]
    for r in got.collect():
        text = texts[r.doc_id]
        if text is None:
            assert r.piece_ids is None and r.n_pieces is None and r.round_trip is None
        else:
            assert r.piece_ids == library.encode(text) and r.n_pieces == len(r.piece_ids) and r.round_trip == ("▁" not in text)
    assert piece_codec.encode_and_decode(docs.limit(0), path).collect() == []
