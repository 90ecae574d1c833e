"""Validators of reports, coordinate maps between a text and its redacted form, previews and traces."""

import difflib
import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from inkveil.functions.scans import count_until, running_sum
from inkveil.operators import privacy, replace, reports, trace
from inkveil.plans import fixtures


def test_key_lists_are_whole():
    assert [len(x) for x in (privacy.DIAGNOSTIC_KEYS, privacy.RUNTIME_KEYS, privacy.RECOGNITION_KEYS, privacy.REMOTE_KEYS)] == [15, 20, 7, 17]
    assert all(len(set(x)) == len(x) for x in (privacy.DIAGNOSTIC_KEYS, privacy.RUNTIME_KEYS, privacy.RECOGNITION_KEYS, privacy.REMOTE_KEYS))


def found(spark, validator, *texts):
    rows = privacy.report_issues(spark.createDataFrame(list(enumerate(texts)), "id int, report string"), validator).collect()
    return {i: [(r.issue, r.detail) for r in sorted(rows) if r.id == i] for i in range(len(texts))}


def test_escapes_arrays_and_depth_are_seen(spark):
    texts = (r'{"note": "张三\n住址"}', '{"note": "张三"}', '{"a": ["张三李四"]}', r'{"origin\u0061l": 1}', '{"a": [{"b": [[{"leaks": []}]]}], "n": 5, "t": "张"}', "龠", None, "[1]", "", '{"a": ' * 3000, r'{"a": "\ud800"}')
    got = found(spark, "regression", *texts)
    assert got[0] == got[1] == [("value", "$.note")] and got[2] == [("value", "$.a[0]")]
    assert got[3] == [("key", "$.original")] and got[4] == [("key", "$.a[0].b[0][0].leaks")]
    assert got[6] == [] and got[10] == [] and all(got[i] == [("unreadable", "$")] for i in (5, 7, 8, 9))


def test_each_validator(spark):
    text = json.dumps({"privacy": {"sample_entries": "omitted"}, "x": {"sample_entries": "omitted"}, "prompt": "p", "at": "in /opt/x", "home": "~/x", "win": "see C:\\x", "rel": "a/b", "cjk": "龦龧"})
    assert found(spark, "runtime", text)[0] == [("key", "$.x.sample_entries"), ("key", "$.prompt"), ("value", "$.at"), ("value", "$.home"), ("value", "$.win"), ("value", "$.cjk")]
    assert found(spark, "recognition", text)[0] == [("key", "$.prompt"), ("value", "$.home"), ("value", "$.win")]
    assert found(spark, "regression", text)[0] == [("value", "$.cjk")]
    paths = {"filename": "a/b", "filenames": ["a/b"], "safe_filename": " ok.txt ", "dot_filename": ".", "relative_path": "", "relative_path1": "\\\\h\\s", "relative_path2": "/x", "relative_path3": "C:/x", "relative_path4": "a\\b", "relative_path5": "a/../b", "relative_path6": "./var/x", "relative_path7": "a//b", "RELATIVE_PATH8": "~x", "relative_path9": 5, "path": "/x"}
    reasons = ["filename must be basename", "filename must be basename", "path must not be remote or network path", "path must be relative", "path must be relative", "path must use posix separators", "path must not escape case folder", "path must not expose local system path", "path must be relative"]
    names = ["filename", "dot_filename", *(f"relative_path{i}" for i in range(1, 7)), "RELATIVE_PATH8"]
    assert found(spark, "remote", json.dumps(paths))[0] == [("path", f"$.{n}: {r}") for n, r in zip(names, reasons, strict=True)]
    values = json.dumps([{"token": "x"}, "BEARER abc", "Secret-Token-1", "in /Volumes/x", "fine", {"body": {"relative_path": "/Users/x"}}])
    assert found(spark, "remote", values)[0] == [("key", "$[0].token"), ("value", "$[1]"), ("value", "$[2]"), ("value", "$[3]"), ("key", "$[5].body"), ("path", "$[5].body.relative_path: path must be relative"), ("value", "$[5].body.relative_path")]
    with pytest.raises(ValueError):
        privacy.report_issues(spark.createDataFrame([(1, "{}")], "id int, report string"), "other")


def test_errors_name_all_faults_of_a_row(spark):
    rows = [(1, '{"mappings": [], "a": "张三", "b": {"diff": "李四"}}'), (1, '{"extra": 1}'), (2, "{}"), (3, "x"), (None, '{"leaks": 1}')]
    frame = spark.createDataFrame(rows, "id int, report string")
    got = Counter(tuple(r) for r in privacy.privacy_errors(frame, "regression").collect())
    head = "M6 regression report contains "
    assert got == Counter([(1, head + "raw diagnostic fields: $.mappings, $.b.diff; sensitive report values: $.a, $.b.diff"), (1, head + "raw diagnostic fields: $.extra"), (3, "report is not a JSON object"), (None, head + "raw diagnostic fields: $.leaks")])
    remote = spark.createDataFrame([(1, '{"token": "/Users/a", "filename": "a/b"}')], "id int, report string")
    assert privacy.privacy_errors(remote, "remote").first().error == "forbidden key $.token; forbidden value at $.token; forbidden path at $.filename: filename must be basename"
    assert privacy.privacy_errors(remote, "recognition").first().error == "recognition benchmark contains absolute path"
    assert privacy.privacy_errors(frame.limit(0), "runtime").count() == 0


def test_unsafe_keys_and_values_walk_too(spark):
    r = spark.createDataFrame([(1, r'{"te\u0078t": "x", "a": ["张三\n住"]}'), (2, '{"n": "text: no", "p": "in /root/x"}')], "id int, report string")
    assert {tuple(x) for x in reports.unsafe_keys(r, "id", "report").collect()} == {(1, "text")}
    assert {tuple(x) for x in reports.unsafe_values(r, "id", "report").collect()} == {(1, "chinese_text"), (2, "absolute_path")}
    assert {"debug_trace", "lookup_entries", "draft_text", "redaction_map", "case_root", "traceback", "authorization"} <= set(reports.FORBIDDEN_KEYS)


def test_fixture_reports_vary(spark):
    got = spark.range(3000).select(fixtures.report(F.col("id")).alias("r")).distinct().count()
    assert got > 2000


def plain_places(text, entries):
    """Longest original first, leftmost first."""
    taken, out = set(), []
    for key, value in sorted(((k, v) for k, v in entries if k), key=lambda e: -len(e[0])):
        at = text.find(key)
        while at >= 0:
            if taken.isdisjoint(range(at, at + len(key))):
                taken.update(range(at, at + len(key)))
                out.append((at, at + len(key), value))
            at = text.find(key, at + 1)
    return sorted(out)


def test_coordinates_equal_a_plain_version_on_all_ways(spark):
    rng = random.Random(5)
    entries = [("ab", "[X]"), ("abc", ""), ("é", "[long mask]"), ("😀a", "b"), ("aa", "aa")]
    texts = ["".join(rng.choices(["a", "b", "c", "é", "😀", " ", "\n", "\ue000"], k=rng.randint(0, 40))) for _ in range(80)] + ["", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    shared = spark.createDataFrame([(i, "person", k, v) for i, (k, v) in enumerate(entries)], "ord int, type string, original string, masked string")
    many = shared.unionByName(spark.createDataFrame([(100 + i, "person", f"never{i}", "x") for i in range(70)], shared.schema))
    keyed = docs.select("doc_id").crossJoin(shared)
    for maps, on, guard in ((shared, None, False), (many, None, False), (shared, None, True), (keyed, "doc_id", True), (keyed, "doc_id", False)):
        own = trace.with_coordinates(docs, maps, on=on, guard=guard)
        done = replace.apply_mappings(own, maps, on=on, guard=guard).withColumn("spans", F.expr("transform(sequence(0, length(text)), i -> struct(i as start, least(i + 3, length(text)) as end))"))
        there = done.withColumn("new", F.transform("spans", lambda s: trace.to_redacted(F.col("coordinates"), s)))
        rows = there.withColumn("back", F.transform("new", lambda s: trace.to_original(F.col("coordinates"), s))).collect()
        assert len(rows) == len(texts)
        for r in rows:
            if r.text is None:
                assert r.coordinates is None and r.redacted is None
                continue
            want = plain_places(r.text, entries)
            assert [(x.start, x.end) for x in r.coordinates] == [(a, b) for a, b, _ in want], (on, guard, r.text)
            assert [r.redacted[x.new_start : x.new_end] for x in r.coordinates] == [v for _, _, v in want]
            for s, n, b in zip(r.spans, r.new, r.back, strict=True):
                grown = (min([s.start, *(a for a, e, _ in want if a < s.start < e)]), max([s.end, *(e for a, e, _ in want if a < s.end < e)]))
                inner = sorted((a, e, v) for a, e, v in want if a < grown[1] and grown[0] < e)
                text, at = "", grown[0]
                for a, e, v in inner:
                    text, at = text + r.text[at:a] + v, e
                assert r.redacted[n.start : n.end] == text + r.text[at : grown[1]], (r.text, s, n)
                if all(v for _, _, v in want):
                    assert (b.start, b.end) == grown


def test_preview_shows_the_diff_of_a_restore(spark):
    lines = [f"line {i}" for i in range(40)]
    lines[3], lines[9], lines[30] = "[A] here", "[A][B]", "end [B]"
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, "nothing"), (3, None), (4, "[A]"), (5, "x\n[C]\ny")], "doc_id int, redacted string")
    maps = spark.createDataFrame([(0, "person", "anna", "[A]", None), (1, "person", "bob", "[B]", None), (2, "person", "c\nd", "[C]", None)], "ord int, type string, original string, masked string, restore_original string")
    for r in trace.preview_restore(docs, maps).collect():
        assert (r.n_restored_entries, r.n_skipped_entries) == (3, 0)
        if r.redacted is None:
            assert r["diff"] is None
            continue
        want = "\n".join(difflib.unified_diff(r.redacted.splitlines(), r.restored.splitlines(), fromfile="redacted", tofile="restored", lineterm=""))
        assert r["diff"] == want
    keyed = spark.createDataFrame([(1, 0, "person", "anna", "[A]", None)], "doc_id int, ord int, type string, original string, masked string, restore_original string")
    got = {r.doc_id: (r.restored, r.n_restored_entries) for r in trace.preview_restore(docs, keyed, on="doc_id").collect()}
    assert got[4] == ("[A]", 0) and got[1][1] == 1 and got[1][0].count("anna") == 2


def test_trace_has_a_row_for_each_part(spark):
    docs = spark.createDataFrame([(1, "qu qu x", "[C] [C] x"), (2, "y", "y"), (3, None, None)], "doc_id int, text string, redacted string")
    maps = spark.createDataFrame([(0, "person", "qu", "[C]", "rule"), (1, "place", "zz", "[D]", "model")], "ord int, type string, original string, masked string, source string")
    leaks = spark.createDataFrame([(2, "email", "a@b.c")], "doc_id int, type string, text string")
    rows = trace.debug_trace(docs, maps, leaks).collect()
    parts = {(r.section, r.key): json.loads(r.json) for r in rows}
    assert parts["summary", ""] == {"version": "1.0", "mode": "standard", "mapping_count": 2, "leak_count": 1, "source_counts": {"model": 1, "rule": 1}, "type_counts": {"person": 1, "place": 1}}
    assert parts["document", "1"] == {"source_file": "1", "original_chars": 7, "redacted_chars": 9} and parts["document", "3"]["original_chars"] == 0
    assert parts["mapping", "000000:1"]["positions"] == [0, 3] and parts["mapping", "000001"]["count"] == 0 and len(rows) == 7


def test_running_sums_and_search(spark):
    rng = random.Random(1)
    lists = [sorted(rng.choices(range(20), k=n)) for n in (0, 1, 2, 3, 7, 8, 9, 33)]
    frame = spark.createDataFrame([(v, x) for v in lists for x in range(-1, 21)], "v array<int>, x int")
    for r in frame.select("v", "x", count_until(F.col("v"), F.col("x")).alias("n"), running_sum(F.col("v")).alias("s")).collect():
        assert r.n == sum(y <= r.x for y in r.v) and r.s == [sum(r.v[: i + 1]) for i in range(len(r.v))]


def test_all_spans_of_a_text_are_carried_as_single_ones(spark):
    rows = [(1, "the qu tion\nthethe\n\nqu"), (2, "nothing\nhere"), (3, ""), (4, None), (5, "tion"), (6, "the\n" * 60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    terms = spark.createDataFrame([(0, "person", "tion", "[LONG MASK]"), (1, "person", "the", ""), (2, "person", "qu", "é")], "ord int, type string, original string, masked string")
    every = F.flatten(F.transform(F.sequence(F.lit(0), F.length("text")), lambda a: F.transform(F.sequence(a, F.length("text")), lambda b: F.struct(a.alias("start"), b.alias("end")))))
    mapped = trace.with_coordinates(docs, terms, guard=False).withColumn("spans", F.when(F.length("text") < 40, every).otherwise(trace.line_spans(F.col("text"))))
    for many, one in ((trace.all_to_redacted, trace.to_redacted), (trace.all_to_original, trace.to_original)):
        got = mapped.select("doc_id", many(F.col("coordinates"), F.col("spans")).alias("all"), F.transform("spans", lambda s: one(F.col("coordinates"), s)).alias("each")).collect()
        assert len(got) == len(rows) and all(r["all"] == r["each"] for r in got) and [r["all"] for r in got if r["doc_id"] == 4] == [None]
