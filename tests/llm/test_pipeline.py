"""The pipeline's stages and its whole run against what they must do."""

import random
from collections import defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkveil.llm import bpe, minhash, packing, quality_rules, sampling, secrets, simhash, subword_model, toxicity

SF = "/root/testdata/sf0.01"


def test_stages_one_by_one(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == columns
        out.write.parquet(f"{tmp_path}/{len(seen)}")
        seen[name] = (docs, spark.read.parquet(f"{tmp_path}/{len(seen)}"))
        docs = seen[name][1]
    ids = {k: ({r.doc_id for r in a.select("doc_id").collect()}, {r.doc_id for r in b.select("doc_id").collect()}) for k, (a, b) in seen.items()}

    before, after = ids["quality rules"]
    assert after == {r.doc_id for r in quality_rules.quality_rules(seen["quality rules"][0]).where("kept").collect()} and after < before

    before, after = ids["toxicity"]
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
    assert after < before and len(before - after) < 0.2 * len(before)
    assert len((before - after) & toxic) > 0.5 * len(before & toxic)

    before, after = ids["SimHash near-dedup"]
    groups = defaultdict(list)
    for r in simhash.near_duplicates(seen["SimHash near-dedup"][0], distance=corpus_pipeline.NEAR_BITS).collect():
        groups[r.component_id].append(r.doc_id)
    assert after == {min(g) for g in groups.values()} and seen["SimHash near-dedup"][1].count() == len(after)
    texts = [r.text for r in seen["SimHash near-dedup"][1].collect()]
    assert len({t.lower() for t in texts}) == len(texts)

    before, after = ids["secret scans"]
    assert before == after
    masked = seen["secret scans"][1]
    again = secrets.find_secrets(masked, [0.0] * secrets.SYMBOLS**2)
    assert again.where(F.size("base_spans") > 0).count() == 0 and masked.where("n_chars <> length(text)").count() == 0

    before, after = ids["best-fit packing"]
    assert before == after
    fill = seen["best-fit packing"][1].groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n"), F.avg("n")).first()
    assert fill[0] <= 1024 and fill[1] > 900


def test_stages_take_odd_rows(spark):
    base = spark.read.parquet(f"{SF}/documents.parquet")
    clean = base.join(spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1 AND toxic = 0"), "doc_id").where("lang = 'en' AND n_chars BETWEEN 1500 AND 3000")
    text = " ".join(reversed(clean.orderBy("doc_id").first().text.split()))
    odd = [(None, text, None, None, None), (None, text, None, None, None), (70001, None, None, None, None), (70002, "", "en", "s", 0), (70003, text + " secret=abcdefghijklmnopq", "en", "s", 5), (70003, text + " secret=abcdefghijklmnopq", "en", "s", 5)]
    docs = base.unionByName(spark.createDataFrame(odd, base.schema)).withColumn("n_words", F.lit("clash"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
    rows = docs.where("doc_id IS NULL OR doc_id > 70000").collect()
    assert sorted((r.doc_id or 0, r.n_words) for r in rows) == [(0, "clash"), (0, "clash"), (70003, "clash")]
    assert next(r.text for r in rows if r.doc_id == 70003).endswith(secrets.MASK)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() > 0
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_near_dedup_tells_rows_apart_by_their_texts(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    near = " ".join(f"b{i}" for i in range(59)) + " other"
    rows = [(5, a, "x"), (5, b, "x"), (3, b, "y"), (4, near, "x"), (8, c, "1"), (8, c, "1"), (8, c, "1"), (9, None, "n"), (10, "", "n"), (None, c, "q"), (None, c, "q")]
    docs = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], spark.read.parquet(f"{SF}/documents.parquet").schema).repartition(4)
    got = corpus_pipeline.one_of_each_group(spark, docs, SF).collect()
    assert sorted(((r.doc_id or 0, r.text, r.source) for r in got), key=repr) == sorted([(5, a, "x"), (3, b, "y"), (8, c, "1"), (9, None, "n"), (0, c, "q"), (0, c, "q")], key=repr)


def test_run_keeps_whole_documents(spark):
    out = corpus_pipeline.run(spark, SF)
    per = out.groupBy("doc_id").agg(F.max("piece").alias("p"), F.count("*").alias("n"), F.max(F.col("start") + F.col("length")).alias("end"), F.sum("length").alias("sum"))
    assert per.where("n <> p + 1 OR end <> sum").count() == 0 and per.count() > 500


def test_near_copies_of_brute_force_jaccard(spark, monkeypatch):
    rng = random.Random(3)
    base = [[f"w{rng.randrange(5000)}" for _ in range(n)] for n in (24, 60, 150, 400, 900)]
    texts = [" ".join(b) for b in base]
    for b in base:
        for step in (30, 45, 60, 80):  # about 1 - 10 / step of all shingles in common
            for _ in range(3):
                at = rng.randrange(step)
                texts.append(" ".join(f"x{rng.randrange(10**6)}" if i % step == at else w for i, w in enumerate(b)))
    shingles = [{" ".join(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    near = [(i, j) for i in range(len(texts)) for j in range(i) if len(shingles[i] & shingles[j]) >= 0.8 * len(shingles[i] | shingles[j])]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    bits = [simhash._fingerprint(t.encode(), 5) for t in texts]
    far = [(i, j) for i, j in near if (bits[i] ^ bits[j]).bit_count() > corpus_pipeline.NEAR_BITS]
    assert len(far) > 10
    for i, j in near + [(i, j) for i in range(len(texts)) for j in range(i) if (bits[i] ^ bits[j]).bit_count() <= corpus_pipeline.NEAR_BITS]:
        lo, hi = sorted((root(i), root(j)))
        parent[hi] = lo
    want = {root(i) for i in range(len(texts))}
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], spark.read.parquet(f"{SF}/documents.parquet").schema)
    for block, rows in ((minhash.BLOCK, minhash.BROADCAST_ROWS), (3, 0)):
        monkeypatch.setattr(minhash, "BLOCK", block), monkeypatch.setattr(minhash, "BROADCAST_ROWS", rows)
        assert {r.doc_id for r in corpus_pipeline.one_of_each_group(spark, docs, SF).collect()} == want


def test_rows_that_stay_are_found_by_bitmaps_without_a_shuffle_of_texts(spark):
    from inkveil.llm.simhash import _with_rows

    rows = spark.range(0, 70_000, 1, 3).select(F.monotonically_increasing_id().alias("__row"), F.col("id"), F.lit("text").alias("text"))
    stay = rows.where("id % 7 = 0 OR id IN (1, 32768, 69999)").select("__row")
    found = _with_rows(rows, stay, "__row")
    assert sorted(r.id for r in found.select("id").collect()) == sorted({*range(0, 70_000, 7), 1, 32768, 69999})
    assert found.columns == rows.columns and "MergeJoin" not in found._jdf.queryExecution().executedPlan().toString()


def test_a_worker_gets_texts_in_batches_of_few_mb(spark):
    """Batches were bounded by 10,000 rows and 64 MB, of which an executor beside its Python workers has no room."""
    docs = spark.range(0, 4000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("ab "), 4000).alias("text"))
    corpus_pipeline.pack(spark, docs, SF)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes], pa.int64())], ["n"])

    got = [r.n for r in docs.mapInArrow(sizes, "n long").collect()]
    assert max(got) < 6 << 20 < sum(got)
    assert packing.SmallSegments.memo_bytes < bpe.MEMO_BYTES and packing.SmallSegments(bpe.read_vocabulary(public_tokenizers.path("byte_bpe_50k.json"))).memo.most_bytes == 16 << 20


def test_workers_take_texts_of_one_mb_at_a_time(monkeypatch):
    """Both took 4 MB at once, in arrays or strings of many times that; packing also built a second tokenizer that no text asked for."""
    texts = pa.array([f"word{i} and  so on <s> {i}\n" * 400 if i % 50 == 0 else f"word{i} and so on " * 400 for i in range(900)] + [None, ""])
    config = bpe.read_vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    small, plain = packing.SmallSegments(config), bpe.SpaceSegments(config)
    assert "tok" not in vars(small)
    seen = []
    monkeypatch.setattr(small, "encode_batch", lambda part: seen.append(sum(map(len, part))) or plain.encode_batch(part))
    want = [np.array(e.ids, "<u4").tobytes() for e in plain.tok.encode_batch([t or "" for t in texts.to_pylist()], add_special_tokens=False)]
    assert small.encode(texts) == want and max(seen) <= 1 << 20 < sum(seen)
    vocab = plain.tok.get_vocab()
    assert {i for t, i in vocab.items() if t.startswith("\u0120")} == set(np.flatnonzero(small.starts).tolist()) and len(small.starts) == max(vocab.values()) + 1

    model = subword_model.Model(np.random.default_rng(1).normal(size=1 << subword_model.BITS).astype(np.float32), 0.0, toxicity.SETTINGS)
    texts = texts.fill_null("")
    whole, sizes, logits = [subword_model.probabilities(model, texts.slice(i, 1))[0].as_py() for i in range(len(texts))], [], subword_model.logits
    monkeypatch.setattr(subword_model, "logits", lambda m, raw, offsets: sizes.append(len(raw)) or logits(m, raw, offsets))
    assert subword_model.probabilities(model, texts).to_pylist() == whole and max(sizes) <= 1 << 20 < sum(sizes)


def test_packing_leaves_its_encoder_with_no_worker(spark):
    """Idle workers held it through all stages of a later run, beside an executor with a full heap."""
    docs = spark.range(0, 400, 1, 4).select(F.col("id").alias("doc_id"), F.repeat(F.lit("some words "), 50).alias("text"))
    assert corpus_pipeline.pack(spark, docs, SF).count() == 400

    def kept(batches):
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(k[0].__name__ == "SmallSegments" for k in bpe._KEPT)], pa.int64())], ["n"])

    assert {r.n for r in docs.mapInArrow(kept, "n long").collect()} == {0}


def test_pieces_leave_a_worker_one_mb_at_a_time(monkeypatch):
    """All pieces of 4 MB of text were in memory four times over; a long text's pieces, too, are now given in parts."""

    class Docs:
        schema = T.StructType([T.StructField("doc_id", T.LongType())])

        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):  # noqa: N802
            return run

    monkeypatch.setattr(packing.TaskContext, "get", staticmethod(lambda: type("Task", (), {"partitionId": staticmethod(lambda: 0)})))
    path = public_tokenizers.path("byte_bpe_50k.json")
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(n)) for n in [120_000, *[600] * 400]] + [None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    given = list(packing.pack_documents(Docs(), path, segments=packing.SmallSegments)(iter([batch])))
    assert max(b.column("tokens").nbytes for b in given) < 1.2 * (1 << 20) and sum(b.column("tokens").nbytes for b in given) > 4 << 20
    rows = pa.Table.from_batches(given).to_pylist()
    assert all(r["length"] * 4 == len(r["tokens"]) for r in rows)
    tokens, sequences = defaultdict(bytes), defaultdict(list)
    for r in rows:
        assert r["start"] * 4 == len(tokens[r["doc_id"]])
        tokens[r["doc_id"]] += r["tokens"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    want = bpe.SpaceSegments(bpe.read_vocabulary(path)).tok.encode_batch([t or "" for t in texts], add_special_tokens=False)
    assert [tokens[i] for i in range(len(texts))] == [np.array([*e.ids, 2], "<u4").tobytes() for e in want]
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024


def test_samples_are_named_without_python_workers(spark, monkeypatch):
    """A list of rows is made a table by Python workers of their own, which an executor then held beside the others."""
    rows = spark.createDataFrame([(i, "xy"[i % 2], f"text {i}") for i in range(20)], "id long, label string, text string")
    numbers = spark.createDataFrame([(i, i % 2, f"text {i}") for i in range(20)], "id long, label int, text string")
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", lambda *a, **k: 1 / 0)
    for table, names in ((rows, {"x", "y"}), (numbers, {0, 1})):
        got = sampling.sample_texts(table, sampling.pick_ids(table.select("id", "label"), 4), 1000)
        assert len(got) == 8 and {y for _, y in got} == names
        assert set(got) <= {(r.text, r.label) for r in table.collect()} and len(set(got)) == 8
