"""Held-out accuracy and odd rows of the trained models; recall of the neighbour search."""

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from inkveil.llm import language, neighbours, ngrams, quality_classifier, sampling, storage, subword_model, toxicity
from inkveil.llm.arrow_text import text_bytes
from inkveil.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
ODD = [(90001, None), (90002, ""), (90003, "   \n"), (90004, "12 34 !!"), (90005, "x" * 200_000), (None, "the and of"), (90006, "日本語"), (90006, "日本語")]


def auc(scores, labels):
    order = np.argsort(np.argsort(scores, kind="stable"), kind="stable") + 1
    n1 = labels.sum()
    return (order[labels == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(labels) - n1))


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{SF}/labels.parquet")
    odd = spark.createDataFrame(ODD, "doc_id bigint, text string")
    return docs, labels, odd


def test_grams_stay_within_words_and_do_not_depend_on_the_batch():
    def sums(text):
        raw = np.frombuffer(text.encode(), np.uint8)
        v = ngrams.view(raw, np.array([0, len(raw)]), True)
        table = np.random.default_rng(0).standard_normal(1 << 12)
        return ngrams.word_sums(v, table, (3, 4, 5), 12), ngrams.gram_counts(v, (3, 4, 5)), ngrams.word_hashes(v)

    alone, together = sums("Ünique"), sums("one, ünique. 2x")
    assert np.isclose(alone[0][0], together[0][1]) and alone[1][0] == together[1][1] and alone[2][0] == together[2][1]
    raw = np.frombuffer(b"abcd efg", np.uint8)
    v = ngrams.view(raw, np.array([0, len(raw)]), True)
    assert [int(ngrams.grams(v, n, 12)[1].sum()) for n in (3, 4, 5)] == [4 + 3, 3 + 2, 2 + 1]
    assert ngrams.gram_counts(v, (3,)).tolist() == [4, 3]


@pytest.mark.parametrize(("module", "label", "modulus", "held", "least"), [(toxicity, "toxic", 4, 2, 0.75), (quality_classifier, "quality", 5, 0, 0.95)])
def test_classifiers_on_held_out_rows(tables, module, label, modulus, held, least):
    docs, labels, odd = tables
    train = module.train_toxicity if label == "toxic" else module.train_quality
    score = module.score_toxicity if label == "toxic" else module.score_quality
    model = train(docs, labels)
    got = score(docs.join(labels, "doc_id"), model).collect()
    rows = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % modulus == held]
    assert auc(np.array([r.score for r in rows]), np.array([r[label] for r in rows])) > least
    extra = score(odd.withColumn("lang", F.lit("clash")), model).collect()
    assert len(extra) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in extra)
    assert score(odd.limit(0), model).count() == 0
    constant = train(docs.limit(0), labels.limit(0))
    assert {r.score for r in score(odd, constant).collect()} == {0.5}


def test_languages_on_held_out_rows(tables, spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.train_languages(docs)
    got = language.identify_languages(docs, model).collect()
    rows = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert np.mean([r.language.lang_pred == r.lang for r in rows]) > 0.97
    extra = {r.doc_id: r.language for r in language.identify_languages(tables[2], model).collect()}
    assert all(extra[i].lang_pred == "und" and extra[i].score == 0 and extra[i].languages == [] for i in (90001, 90002, 90003, 90004))
    assert extra[None].lang_pred == "en" and extra[90006].lang_pred in model.names
    nothing = language.train_languages(docs.limit(0))
    assert {r.language.lang_pred for r in language.identify_languages(tables[2], nothing).collect()} == {"und"}


M32 = 0xFFFFFFFF


def scalar_words(text, letters_only):
    """Folded words of a text, byte by byte."""
    out, word, before = [], bytearray(), 0
    for b in text.encode() + b" ":
        c = b + 32 if 65 <= b <= 90 or (before == 0xC3 and 0x80 <= b <= 0x9E and b != 0x97) else b
        before = b
        apart = not (48 <= c <= 57 or 97 <= c <= 122 or c >= 128) if letters_only else c <= 32
        if not apart:
            word.append(c)
        elif word:
            out.append(bytes(word))
            word = bytearray()
    return out


def scalar_mix(h):
    h ^= h >> 15
    return h * 0x9E3779B1 & M32


def scalar_grams(word, orders, bits):
    padded, out = b" " + word + b" ", []
    for n in orders:
        for i in range(len(padded) - n + 1):
            h = n
            for c in padded[i : i + n]:
                h = (h * 0x01000193 + c) & M32
            out.append(scalar_mix(h) >> (32 - bits))
    return out


def scalar_logit(model, text):
    s, words = model.settings, scalar_words(text, model.settings.letters_only)
    values = []
    for i, w in enumerate(words):
        again = i > 0 and words[i - 1] == w
        if again and not s.repeats:
            values.append((0.0, 0))
            continue
        h = scalar_mix(sum(c * pow(0x01000193, k, 1 << 32) for k, c in enumerate(w)) & M32)
        bag = [1 if again else h >> (32 - subword_model.BITS), *scalar_grams(w, subword_model.ORDERS, subword_model.BITS)]
        values.append((sum(float(model.table[b]) for b in bag), len(bag)))
    step = s.window // 2
    windows = [values[i : i + s.window] for i in range(0, max(1, len(values) - step), step)] if s.window else [values]
    return model.bias + max(sum(v for v, _ in w) / max(1, s.floor, sum(n for _, n in w)) for w in windows)


TEXTS = [
    "hello world", "hello hello", "", "hello", "world hello", " \n", "Ünique ÜNIQUE ünique !", "the the the end", "end of it", "日本語 テスト", "× × ÷",
    *(" ".join(f"w{i * k % 13}" for i in range(n)) for k, n in enumerate((1, 11, 12, 13, 23, 24, 25, 36, 37, 47, 48, 49, 200, 1000))),
]


def arrow(texts):
    return text_bytes(pa.array(texts, pa.string()))


@pytest.mark.parametrize("module", [toxicity, quality_classifier])
def test_scores_equal_a_scalar_version_whatever_stands_beside_a_text(module):
    table = np.random.default_rng(4).standard_normal(1 << subword_model.BITS).astype(np.float32)
    model = subword_model.Model(table, 0.25, module.SETTINGS)
    alone = [float(subword_model.logits(model, *arrow([t]))[0]) for t in TEXTS]
    assert np.allclose(alone, [scalar_logit(model, t) for t in TEXTS], rtol=0, atol=1e-9)
    assert subword_model.logits(model, *arrow(TEXTS)).tolist() == alone
    back = TEXTS[::-1] + TEXTS[3:]
    assert subword_model.logits(model, *arrow(back)).tolist() == alone[::-1] + alone[3:]


def test_trained_bags_equal_scored_ones():
    texts = ["good text here again again", "bad words bad words bad", "good good text", "bad bad here"] * 20
    model = subword_model.fit(texts, [0, 1, 0, 1] * 20, quality_classifier.SETTINGS)
    z = subword_model.logits(model, *arrow(texts))
    assert (z[1::2] > 0).all() and (z[::2] < 0).all()


def scalar_proportions(model, text):
    words, k = scalar_words(text, True), len(model.names)
    if not words:
        return np.zeros(k)
    scores = [[sum(float(model.tables[j][b]) for b in scalar_grams(w, language.ORDERS, language.BITS)) for j in range(k)] for w in words]

    def expect(share, allowed):
        for _ in range(language.ROUNDS):
            total, fit_ = [0.0] * k, 0.0
            for row in scores:
                p = [row[j] + np.log(share[j]) if j in allowed else -np.inf for j in range(k)]
                top = max(p)
                e = [np.exp(x - top) for x in p]
                fit_ += top + np.log(sum(e))
                total = [t + x / sum(e) for t, x in zip(total, e, strict=True)]
            share = [max(t / len(words), 1e-6) if j in allowed else 0.0 for j, t in enumerate(total)]
            share = [x / sum(share) for x in share]
        return share, fit_

    cost = 0.5 * np.log(len(words) + 1)
    share, fit_ = expect([1 / k] * k, set(range(k)))
    rank = sorted(range(k), key=lambda j: -share[j])
    tried = [(sum(row[rank[0]] for row in scores) - cost, [float(j == rank[0]) for j in range(k)]), (fit_ - k * cost, share)]
    if tried[0][0] < tried[1][0]:
        for size in range(2, k):
            some, likely = expect(share, set(rank[:size]))
            tried.append((likely - size * cost, some))
    return np.array(max(tried, key=lambda t: t[0])[1])


def test_languages_equal_a_scalar_version_whatever_stands_beside_a_text():
    rng = np.random.default_rng(8)
    letters = {"a": "abcdefgh", "b": "efghijkl", "c": "ijklmnop", "d": "mnopqrst"}
    word = lambda own: "".join(rng.choice(list(letters[own]), rng.integers(2, 8)))
    model = language.fit([" ".join(word(x) for _ in range(300)) for x in letters for _ in range(3)], [x for x in letters for _ in range(3)])
    texts = ["", "12", " ".join(word("a") for _ in range(40)), "!"] + [" ".join(word(x) for x in mix for _ in range(n)) for mix, n in (("ab", 20), ("bc", 15), ("abc", 30), ("d", 1), ("abcd", 25), ("c", 200))]
    view = lambda some: ngrams.view(*arrow(some), True)
    alone = [language.proportions(model, view([t]))[0] for t in texts]
    for t, p in zip(texts, alone, strict=True):
        assert np.allclose(p, scalar_proportions(model, t), atol=2e-3), t[:40]
    assert np.array_equal(language.proportions(model, view(texts)), np.array(alone))
    assert np.array_equal(language.proportions(model, view(texts[::-1])), np.array(alone[::-1]))


def test_samples_take_texts_of_any_length_and_repeated_ids(spark):
    long = "zimbo kalu wendo " * 3000
    rows = [(i, f"alpha beta gamma text {i}", "x") for i in range(60)] + [(101, long, "y"), (None, "omega " * 30, "z")] + [(7, "alpha", "x")] * 500
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(4)
    model = language.train_languages(docs)
    assert model.names == ["x", "y", "z"]
    assert language.identify_languages(docs.where("doc_id = 101"), model).first().language.lang_pred == "y"
    known = docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("label"))
    texts = docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("label"), "text")
    few = sampling.sample_texts(texts, sampling.pick_ids(known, 5), 120)
    assert sum(y == "x" for _, y in few) == 5 and (long, "y") in few  # no text of y fits: its first comes alone
    assert few == sampling.sample_texts(texts.repartition(7), sampling.pick_ids(known.repartition(3), 5), 120)
    assert sampling.sample_texts(texts.limit(0), sampling.pick_ids(known.limit(0), 5), 120) == []


def test_mixtures_are_found(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.train_languages(docs)
    some = {r.lang: r.text for r in docs.where("length(text) > 2000 AND length(text) < 4000").collect()}
    mixed = spark.createDataFrame([(1, some["en"][:1000] + " " + some["fr"][:1000])], "doc_id bigint, text string")
    got = language.identify_languages(mixed, model).first().language
    assert set(got.languages[:2]) == {"en", "fr"} and min(got.proportions[:2]) > 0.25


def brute(ids, vectors, k):
    out = {}
    for i in sorted({i for i in ids if i % 20 == 0}):
        q = vectors[ids.index(i)]
        others = [(-(np.array(v) * np.array(q)).sum(), j) for j, v in zip(ids, vectors, strict=True) if j != i]
        out[i] = sorted(others)[:k]
    return out


def test_neighbours_recall_ties_and_unusable_rows(spark):
    rng = np.random.default_rng(2)
    vectors = [list(map(float, v)) for v in np.vstack([rng.standard_normal((300, 16)), np.repeat(rng.standard_normal((1, 16)), 60, axis=0)]).astype(np.float32)]
    ids = list(range(len(vectors)))
    odd = [(1000, None), (1020, [0.0] * 16), (1040, [float("nan")] * 16), (1060, [float("inf")] + [1.0] * 15), (1080, [None] + [1.0] * 15), (None, vectors[0]), (1100, [1.0, 2.0])]
    table = spark.createDataFrame([*zip(ids, vectors, strict=True), *odd], "vec_id bigint, embedding array<float>").withColumn("score", F.lit("clash")).repartition(3)
    want = brute(ids, vectors, 20)
    got = defaultdict(list)
    for r in neighbours.nearest_neighbours(table, cell_rows=100).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    assert got.keys() == want.keys()
    hits = 0
    for i, rows in got.items():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, 21)) and all(a[2] > b[2] or (a[2] == b[2] and a[1] < b[1]) for a, b in zip(rows, rows[1:], strict=False))
        hits += len({r[1] for r in rows} & {j for _, j in want[i]})
        score = {j: -s for s, j in want[i]}
        assert all(abs(score[j] - s) < 1e-12 for _, j, s in rows if j in score)
    assert hits >= 0.9 * 20 * len(want)
    assert neighbours.nearest_neighbours(table.limit(0)).count() == 0
    few = neighbours.nearest_neighbours(table.where("vec_id IN (0, 1, 2)")).collect()
    assert [r.rank for r in few] == [1, 2]


def embeddings(spark, tmp_path, ids, vectors, parts=8):
    flat = np.ascontiguousarray(vectors)
    column = pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, flat.shape[1]), pa.int32()), pa.array(flat.ravel()))
    pq.write_table(pa.table({"vec_id": pa.array(ids, pa.int64()), "embedding": column}), f"{tmp_path}/e.parquet")
    return spark.read.parquet(f"{tmp_path}/e.parquet").repartition(parts)


def test_a_strict_test_gives_the_exact_neighbours_with_copies_ties_and_repeats(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(9)
    base = rng.standard_normal((260, 8)).round(1)
    mass = np.repeat(rng.standard_normal((2, 8)).round(1), 150, axis=0)  # two vectors are more than half of all rows
    vectors = np.vstack([base, mass, base[:20] * 2.0, base[:3] * 1e-8, -base[:5] * 64])
    ids = np.arange(len(vectors))
    ids[40:60:7] = 500  # an id with several vectors
    order = rng.permutation(len(ids))
    again = np.append(order, order[:30])  # rows that repeat
    pairs = sorted({(int(i), tuple(v)) for i, v in zip(ids, vectors, strict=True)})
    several = {i for i, _ in pairs if sum(j == i for j, _ in pairs) > 1}
    want = {}
    for i, v in pairs:
        if i % 20 == 0:
            want.setdefault(i, []).append([(r, j, s) for r, (s, j) in enumerate(sorted(((-float((np.array(w) * np.array(v)).sum()), j) for j, w in pairs if j != i))[:20], 1)])
    for most, cell, visits in ((10_000, 60, 3), (20, 100, 65536), (20, 10_000, 65536)):
        monkeypatch.setattr(neighbours, "MOST_HOT", most), monkeypatch.setattr(storage, "MOST_HOT", most), monkeypatch.setattr(storage, "FEW_ROWS", 0), monkeypatch.setattr(neighbours, "VISITS", visits)
        got = defaultdict(list)
        for r in neighbours.nearest_neighbours(embeddings(spark, tmp_path, ids[again], vectors[again], 3), confidence=0.999999999, cell_rows=cell).collect():
            got[r.query_id].append((r.rank, r.vec_id, -r.score))
        assert got.keys() == want.keys() and 500 in several
        for i, rows in got.items():
            assert sorted(rows) in want[i] and (i in several or len(want[i]) == 1)


def test_recall_over_many_cells_and_bands(spark, tmp_path):
    """50,000 rows in cells of 2,000, with leaves of 512: clusters, spread norms and one very long vector."""
    rng, n = np.random.default_rng(12), 50_000
    vectors = rng.standard_normal((200, 32))[rng.integers(200, size=n)] + 0.5 * rng.standard_normal((n, 32))
    vectors *= rng.lognormal(0, 0.5, (n, 1))
    vectors[7] *= 100
    vectors = vectors.astype(np.float32)
    got = defaultdict(set)
    for r in neighbours.nearest_neighbours(embeddings(spark, tmp_path, np.arange(n), vectors), query_every=100, cell_rows=2000).collect():
        got[r.query_id].add(r.vec_id)
    share, wide = [], vectors.astype(float)
    for i in range(0, n, 100):
        s = wide @ wide[i]
        s[i] = -np.inf
        share.append(len(got[i] & set(np.argsort(-s)[:20].tolist())) / 20)
    assert np.mean(share) >= 0.9 and np.mean(np.array(share) < 0.5) < 0.02


def test_vectors_of_each_length_and_beyond_the_range_of_products(spark):
    rows = [(0, [1e200, 1.0]), (1, [1e200, -1.0]), (2, [-1e200, 0.0]), (20, [1.0, 2.0, 3.0]), (21, [1.0, 0.0, 0.0]), (22, [0.0, -1.0, 0.0]), (40, [5.0])]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = defaultdict(list)
    for r in neighbours.nearest_neighbours(table).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert got == {0: [(1, float("inf")), (2, float("-inf"))], 20: [(21, 1.0), (22, -2.0)]}


def test_recall_on_the_embeddings_table(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = table.collect()
    vectors, ids = np.array([r.embedding for r in rows], float), np.array([r.vec_id for r in rows])
    got = defaultdict(set)
    for r in QUERIES["op8_projected_neighbours"](spark, SF).collect():
        got[r.query_id].add(r.vec_id)
    hits = 0
    for i in ids[ids % 20 == 0]:
        s = vectors @ vectors[ids == i][0]
        s[ids == i] = -np.inf
        hits += len(got[i] & set(ids[np.argsort(-s)[:20]].tolist()))
    assert hits >= 0.9 * 20 * len(got)
