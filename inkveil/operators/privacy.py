"""What reports and remote payloads must not carry: a walk over JSON of any depth, and the rules of four validators.

The walk is one pass over the parsed document; everything that decides is a column expression over its nodes.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The keys that each kind of report may not have.
DIAGNOSTIC_KEYS = (
    "original", "masked", "mappings", "matched", "missing", "extra", "warnings", "leaks", "redacted_text", "restored_text", "debug_trace", "diff", "lookup_entries", "delete_blacklist_candidates",
    "suppressed_risky_entries",
)
RUNTIME_KEYS = (*DIAGNOSTIC_KEYS, "api_token", "authorization", "prompt", "completion", "body")
RECOGNITION_KEYS = ("prompt", "body", "completion", "entities", "mappings", "response", "request_body")
REMOTE_KEYS = (
    "restored_text", "restored_file", "draft_text", "original", "masked", "mapping", "redaction_map", "map_entries", "case_root", "source_dir", "api_token", "authorization", "token", "body", "traceback",
    "sample_entries", "unresolved_placeholders",
)
# Patterns of texts that give persons or places on a machine away.
CHINESE_TEXT = r"[\u4e00-\u9fff]{2,}"
ABSOLUTE_PATH = r"""(?:^|[\s"'(:=])(?:/[^,\s;]+|~[/\\][^,\s;]+|[A-Za-z]:[\\/][^,\s;]+)"""
REMOTE_VALUES = (r"/Users/", r"/Volumes/", r"(?i)Bearer\s+[A-Za-z0-9._~+/=-]+", r"(?i)secret-token[^\s,;\"']*")
LOCAL_ROOTS = ("private", "Users", "Volumes", "var")

NODE = "array<struct<nth:int,path:string,key:string,kind:string,text:string>>"
_KINDS = {str: "string", bool: "boolean", int: "number", float: "number", dict: "object", list: "array", type(None): "null"}


def _nodes(report: str) -> list[dict] | None:
    """All nodes in reading order, the root first; None for what is no JSON."""
    try:
        root = json.loads(report)
    except (ValueError, RecursionError):
        return None
    out, ahead = [], [("$", None, root)]
    while ahead:
        path, key, value = ahead.pop()
        out.append({"nth": len(out), "path": path, "key": key, "kind": _KINDS[type(value)], "text": value if isinstance(value, str) else None})
        inner = [(f"{path}.{k}", k, v) for k, v in value.items()] if isinstance(value, dict) else [(f"{path}[{i}]", None, v) for i, v in enumerate(value)] if isinstance(value, list) else []
        ahead.extend(reversed(inner))
    return out


def walk_json(report: Column) -> Column:
    """Array of (nth, path, key, kind, text) of a JSON text's nodes, escapes resolved.

    ``key`` is null for the root and for elements of arrays, ``text`` for all but strings. Of equal keys of one object the
    last counts. Null texts and what is no JSON give null; half of a surrogate pair becomes the replacement character.
    """

    @F.arrow_udf(NODE)
    def run(reports: pa.Array) -> pa.Array:
        clean = lambda s: s if s is None else s.encode("utf-8", "replace" if s.isascii() else "surrogatepass").decode("utf-8", "replace")
        rows = [None if r is None else _nodes(r) for r in reports.to_pylist()]
        for row in rows:
            for node in row or ():
                node.update(path=clean(node["path"]), key=clean(node["key"]), text=clean(node["text"]))
        return pa.array(rows, pa.list_(pa.struct([("nth", pa.int32()), *((c, pa.string()) for c in ("path", "key", "kind", "text"))])))

    return run(report)


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def remote_path_issue(key: Column, text: Column) -> Column:
    """Why a string may not stand under a file name or relative path key; null if it may."""
    low, value = F.lower(key), _stripped(text)
    parts = F.filter(F.split(value, "/"), lambda p: ~p.isin("", "."))
    name = F.when(value.contains("/") | value.contains("\\") | (value == "."), "filename must be basename")
    path = (
        F.when(value.rlike(r"^(?:\\\\|//)[^\\/]+(?:[\\/]|$)") | value.startswith("\\\\"), "path must not be remote or network path")
        .when(value.rlike(r"^(?:[/~]|[A-Za-z]:[\\/])"), "path must be relative")
        .when(value.contains("\\"), "path must use posix separators")
        .when(F.array_contains(parts, ".."), "path must not escape case folder")
        .when(F.get(parts, 0).isin(*LOCAL_ROOTS), "path must not expose local system path")
    )
    return F.when(value == "", None).when(low.contains("filename"), name).when(low.contains("relative_path"), path)


def _recognition_path(text: Column) -> Column:
    value = _stripped(text)
    return value.rlike(r"^(?:/|~/|~\\)") | value.contains(":\\") | value.contains(" /Users/") | value.contains(" /Volumes/") | value.contains(" ~/")


def _issues(x: Column, validator: str) -> list[Column]:
    """What is wrong with one node, in the order of a report; null where nothing is."""
    said = lambda what, where: F.struct(F.lit(what).alias("issue"), where.alias("detail"))
    key, path, text = x["key"], x["path"], x["text"]
    if validator == "regression":
        return [F.when(key.isin(*DIAGNOSTIC_KEYS), said("key", path)), F.when(text.rlike(CHINESE_TEXT), said("value", path))]
    if validator == "runtime":
        left_out = (path == "$.privacy.sample_entries") & (F.coalesce(text, F.lit("")) == "omitted")
        return [F.when(key.isin(*RUNTIME_KEYS) | ((key == "sample_entries") & ~left_out), said("key", path)), F.when(text.rlike(CHINESE_TEXT) | text.rlike(ABSOLUTE_PATH), said("value", path))]
    if validator == "recognition":
        return [F.when(key.isin(*RECOGNITION_KEYS), said("key", path)), F.when(_recognition_path(text), said("value", path))]
    if validator == "remote":
        wrong = remote_path_issue(key, text)
        value = F.lit(False)
        for pattern in REMOTE_VALUES:
            value = value | text.rlike(pattern)
        return [F.when(key.isin(*REMOTE_KEYS), said("key", path)), F.when(text.isNotNull() & wrong.isNotNull(), said("path", F.concat_ws(": ", path, wrong))), F.when(value, said("value", path))]
    raise ValueError(f"no validator {validator!r}")


def report_issues(reports: DataFrame, validator: str, id_col: str = "id", report: str = "report") -> DataFrame:
    """(id, nth, issue, detail) for all that a report must not carry, by nth node and by key, path and value.

    ``validator`` is regression, runtime, recognition or remote. ``detail`` is the place, for a path with the reason. What
    is no JSON object has the one issue ``unreadable`` (remote payloads may be any JSON); null reports have none.
    """
    nodes = reports.select(F.col(id_col).alias("id"), F.col(report).alias("report"), walk_json(F.col(report)).alias("nodes"))
    readable = F.col("nodes").isNotNull() & (F.lit(validator == "remote") | (F.col("nodes")[0]["kind"] == "object"))
    unreadable = F.array(F.struct(F.lit(0).alias("nth"), F.lit("unreadable").alias("issue"), F.lit("$").alias("detail")))
    found = F.flatten(F.transform("nodes", lambda x: F.transform(F.array_compact(F.array(*_issues(x, validator))), lambda i: F.struct(x["nth"].alias("nth"), i["issue"].alias("issue"), i["detail"].alias("detail")))))
    listed = F.when(F.col("report").isNotNull(), F.when(readable, found).otherwise(unreadable.cast("array<struct<nth:int,issue:string,detail:string>>")))
    return nodes.select("id", F.inline(listed)).withColumnRenamed("id", id_col)


_TITLES = {"regression": "M6 regression report", "runtime": "M8 runtime benchmark report"}


def privacy_errors(reports: DataFrame, validator: str, id_col: str = "id", report: str = "report") -> DataFrame:
    """(id, error): one message for each row whose report is refused, with all its faults; other rows are left out."""
    found = report_issues(reports.withColumn("__nth", F.monotonically_increasing_id()).select(F.struct("__nth", F.col(id_col).alias("id")).alias("row"), F.col(report).alias("report")), validator, "row", "report")
    ordered = F.array_sort(F.collect_list(F.struct("nth", F.when(F.col("issue") == "key", 0).when(F.col("issue") == "path", 1).otherwise(2).alias("place"), "issue", "detail")))
    kept = found.groupBy("row").agg(ordered.alias("all"))
    of = lambda issue: F.transform(F.filter("all", lambda x: x["issue"] == issue), lambda x: x["detail"])
    listed = lambda title, issue: F.when(F.size(of(issue)) > 0, F.concat(F.lit(title), F.array_join(of(issue), ", ")))
    if validator == "remote":
        word = lambda x: F.when(x["issue"] == "key", F.concat(F.lit("forbidden key "), x["detail"])).when(x["issue"] == "path", F.concat(F.lit("forbidden path at "), x["detail"])).when(x["issue"] == "value", F.concat(F.lit("forbidden value at "), x["detail"])).otherwise(x["issue"])
        error = F.array_join(F.transform("all", word), "; ")
    elif validator == "recognition":
        error = F.when(F.size(of("key")) > 0, "recognition benchmark contains raw diagnostic fields").when(F.size(of("value")) > 0, "recognition benchmark contains absolute path")
    else:
        error = F.concat(F.lit(_TITLES[validator] + " contains "), F.concat_ws("; ", listed("raw diagnostic fields: ", "key"), listed("sensitive report values: ", "value")))
    return kept.select(F.col("row.id").alias(id_col), F.when(F.exists("all", lambda x: x["issue"] == "unreadable"), "report is not a JSON object").otherwise(error).alias("error"))
