"""WARC archives written and read by Spark, the reading verified by chains of record boundaries.

An archive is read as text that is split at "blank line, WARC/1.0": every such place is a candidate for a record's start,
and payloads may hold as many false ones as they like. Tasks read file blocks independently and emit, for each candidate
with a readable header, where the record after it would start. Links inside a block are followed at once, so a candidate
leads straight to its chain's first place outside the block; pointer jumping over those finds, in rounds that grow with
the logarithm of a file's blocks, where the chain from the file's start enters each block. A second pass over the files
walks each block from there. Payloads are never shuffled, but for records that reach over a block's end.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkveil.llm.storage import materialize, shared_dir

MAGIC = b"WARC/1.0\r\n"
END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
LEAST_REVISIT_BYTES = 100
BROADCAST_ROWS = 200_000
MOST_ROUNDS = 60
SALTS = 32
_LENGTH = re.compile(rb"(?im)^content-length:[ \t]*(\d+)[ \t]*\r?$")
_JUMP = len(END) + len(MAGIC)


def _first_of_payload(rows: DataFrame, least: int) -> DataFrame:
    """(digest, first_id) for payloads of at least ``least`` bytes that occur more than once."""
    long = rows.where(F.octet_length("payload") >= least)
    groups = long.groupBy(F.sha2(F.col("payload").cast("binary"), 256).alias("same")).agg(F.count("*").alias("n"), F.min("id").alias("first_id"))
    return groups.where((F.col("n") > 1) & F.col("first_id").isNotNull()).select("same", "first_id")


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST_REVISIT_BYTES) -> None:
    """Write a record for every row into a folder of archives.

    Of rows with equal payloads of at least ``least`` bytes, the one with the smallest id is a response and the others
    revisit it. Null payloads are empty; rows that repeat the smallest id are responses too; null ids give responses
    without a number; an empty table gives archives without records. Other columns are not read.
    """
    rows = pages.select(F.col(id_col).cast("bigint").alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    first = materialize(_first_of_payload(rows, least))
    rows = rows.withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256))
    if first.count() <= BROADCAST_ROWS:
        rows = rows.join(F.broadcast(first), F.col("digest") == F.col("same"), "left")
    else:  # spread each payload's rows over salts, however many there are
        spread = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = rows.withColumn("salted", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
        rows = salted.join(spread, (F.col("digest") == F.col("same")) & (F.col("salted") == F.col("salt")), "left")
    revisit = F.coalesce(F.col("id") != F.col("first_id"), F.lit(False))
    number = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("payload").cast("string"), F.lit(END))
    body = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    url = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A"), " ", "%20")
    fields = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.0"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        F.concat(F.lit("WARC-Record-ID: "), number(F.col("id"))),
        F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), number(F.col("first_id")))),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string")),
    )
    rows.select(F.concat(fields, F.lit(END), body).alias("value")).write.option("lineSep", END).text(path)


def _pin_blocks(spark: SparkSession) -> None:
    """Spark cuts files anew for each job, by the cores there are at that time. From now on this session cuts them for as
    many as now, so that both reads of an archive find the same blocks if executors are lost or join in between."""
    name = "spark.sql.files.minPartitionNum"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, spark.conf.get("spark.sql.leafNodeDefaultParallelism", None) or str(spark.sparkContext.defaultParallelism))


def _segments(spark: SparkSession, path: str) -> DataFrame:
    """What lies between candidates, in order within each block of a file."""
    lines = spark.read.option("lineSep", END + MAGIC.decode()).text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


def _placed(batches: Iterator[pa.RecordBatch], *extras: str) -> Iterator[tuple]:
    """(file, block), place relative to the block's first segment, segment, whether a record may start before it, extras."""
    current, at = None, 0
    for batch in batches:
        for file, block, value, *rest in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "value", *extras)), strict=True):
            fresh = (file, block) != current
            if fresh:
                current, at = (file, block), 0
            if fresh and block == 0 and value.startswith(MAGIC):
                yield current, len(MAGIC), value[len(MAGIC) :], True, rest
            else:
                yield current, at, value, not (fresh and block == 0), rest
            at += len(value) + _JUMP


def _extent(segment: bytes) -> tuple[int, int] | None:
    """Where the record's body starts and ends, counted from the segment's start."""
    head = segment.find(b"\r\n\r\n")
    length = _LENGTH.search(segment, 0, head + 2) if head >= 0 else None
    return (head + 4, head + 4 + int(length[1])) if length else None


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block a row with its size, and a row for each candidate: start, the chain's first place outside the
    block, and the chain's last record inside it (all relative)."""
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("size", pa.int64()), ("start", pa.int64()), ("leaves", pa.int64()), ("last", pa.int64())])

    def rows(key: tuple[str, int], size: int, links: dict[int, int]) -> pa.RecordBatch:
        leaves: dict[int, tuple[int, int]] = {}
        for start in sorted(links, reverse=True):
            after = links[start]
            leaves[start] = leaves.get(after, (after, start))
        n = len(leaves)
        return pa.RecordBatch.from_arrays(
            [pa.array([key[0]] * (n + 1), pa.string()), *(pa.array(x, pa.int64()) for x in ([key[1]] * (n + 1), [size] + [None] * n, [None, *leaves], [None, *(v[0] for v in leaves.values())], [None, *(v[1] for v in leaves.values())]))],
            schema=schema,
        )

    key, size, links = None, 0, {}
    for now, at, segment, begins, _ in _placed(batches):
        if now != key:
            if key:
                yield rows(key, size, links)
            key, size, links = now, 0, {}
        size = at + len(segment) + _JUMP
        extent = _extent(segment) if begins else None
        if extent:
            links[at - len(MAGIC)] = at + extent[1] + len(END)
    if key:
        yield rows(key, size, links)


def _entries(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, entry, owner): where the verified chain enters each block (relative, null if it passes over it), and
    the start of the record that reaches into the block from before (in the file)."""
    found = materialize(_segments(spark, path).mapInArrow(_candidates, "file string, block bigint, size bigint, start bigint, leaves bigint, last bigint"))
    order = Window.partitionBy("file").orderBy("block")  # a row for each block of a file
    sizes = found.where("size IS NOT NULL").select("file", "block", "size")
    bases = sizes.withColumn("base", F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    links = found.where("size IS NULL").hint("merge").join(bases, ["file", "block"]).select("file", "block", "base", (F.col("base") + F.col("start")).alias("at"), (F.col("base") + F.col("leaves")).alias("to"), (F.col("base") + F.col("last")).alias("last"))
    links = materialize(links)
    jumps = links.select("file", "at", "to").hint("merge")  # candidates grow with the archives: they are never broadcast
    reached, before = links.where("at = 0").select("file", "at"), -1
    for _ in range(MOST_ROUNDS):
        further = reached.join(jumps, ["file", "at"]).select("file", F.col("to").alias("at"))
        reached = materialize(reached.unionByName(further.join(links.select("file", "at").hint("merge"), ["file", "at"], "left_semi")).distinct())
        now = reached.count()
        if now == before:
            break
        before = now
        ahead = jumps.select("file", F.col("at").alias("to"), F.col("to").alias("beyond"))
        jumps = materialize(jumps.join(ahead.hint("merge"), ["file", "to"]).select("file", "at", F.col("beyond").alias("to"))).hint("merge")
    chains = links.join(reached.hint("merge"), ["file", "at"], "left_semi")
    per_block = chains.groupBy("file", "block").agg(F.min("at").alias("at"), F.max("last").alias("last"))
    full = bases.join(per_block.hint("merge"), ["file", "block"], "left")
    owner = F.last("last", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return materialize(full.select("file", "block", "base", (F.col("at") - F.col("base")).alias("entry"), owner.alias("owner")))


class _Pieces:
    """Rows of (file, at, whole, place, data) on their way out."""

    KINDS = (pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.binary())

    def __init__(self):
        self.rows: list[tuple] = []
        self.held = 0

    def add(self, *row) -> None:
        self.rows.append(row)
        self.held += len(row[-1])

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) if self.rows else [()] * 5
        self.rows, self.held = [], 0
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, self.KINDS, strict=True)], names=["file", "at", "whole", "place", "data"])


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of each block from its entry on: whole ones, and pieces of such as begin or end in another block."""
    out, joint = _Pieces(), END.encode() + MAGIC
    key, base, expected = None, 0, None
    start, begun, end, parts = None, 0, None, []  # the record being read: its start, its first part's place, its end if known

    def leave() -> None:
        """The record goes on in a later block, or ends before this block's entry."""
        if start is not None and parts:
            out.add(key[0], base + start, False, base + begun, b"".join(parts))  # ends with what parts two segments

    for now, at, segment, begins, (block_base, entry, owner) in _placed(batches, "base", "entry", "owner"):
        if now != key:
            if block_base is None:
                raise RuntimeError(f"{now[0]} is cut at {now[1]} now, but was not when its chain was followed: read it again")
            leave()
            key, base, expected = now, block_base, entry
            start, begun, end, parts = (None if owner is None else owner - base), at, None, []
        extent = _extent(segment) if begins and at - len(MAGIC) == expected else None
        if extent:
            leave()
            start, begun, end, parts = at - len(MAGIC), at, at + extent[1], []
            expected = end + len(END)
        if start is None:
            continue
        parts += [segment, joint]
        if end is not None and at + len(segment) >= end:
            out.add(now[0], base + start, True, base + begun, b"".join(parts)[: end - begun])
            start, parts = None, []
        if out.held > 4 << 20:
            yield out.batch()
    leave()
    yield out.batch()


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives in ``path``: file, at, header, content (binary).

    Only records that the chain of record lengths from a file's start reaches are read. A file that does not begin with a
    record has none; after a broken link the rest of a file is left out, and so is a last record whose end is missing.
    Files are read twice; if the second read cuts them at other places than the first, it fails.
    """
    _pin_blocks(spark)
    entries = _entries(spark, path)
    segments = _segments(spark, path)
    if entries.count() <= BROADCAST_ROWS:  # one row for each block, of some 128 MB
        known = segments.join(F.broadcast(entries), ["file", "block"], "left")
    else:
        order = segments.withColumn("nth", F.monotonically_increasing_id())
        known = order.join(entries, ["file", "block"], "left").repartition("file", "block").sortWithinPartitions("file", "block", "nth").drop("nth")
    parts = known.select("file", "block", "base", "entry", "owner", "value").mapInArrow(_walk, "file string, at bigint, whole boolean, place bigint, data binary")
    pieces = parts.where("NOT whole").groupBy("file", "at").agg(F.array_sort(F.collect_list(F.struct("place", "data"))).alias("p"))
    whole_text = F.aggregate("p", F.lit(b""), lambda s, x: F.concat(s, x["data"]))
    joined = pieces.select("file", "at", whole_text.alias("data")).withColumn("data", F.substring("data", F.lit(1), F.octet_length("data") - _JUMP))
    rows = parts.where("whole").select("file", "at", "data").unionByName(joined)
    header = F.substring_index(F.col("data").cast("string"), END, 1)
    size = field(F.col("header"), "Content-Length").cast("bigint")
    records = rows.withColumn("header", header).withColumn("size", size)
    whole = records.where(F.octet_length("data") >= F.octet_length("header") + len(END) + F.col("size"))
    return whole.select("file", "at", "header", F.substring("data", F.octet_length("header") + len(END) + 1, F.col("size").cast("int")).alias("content"))


def field(header: Column, name: str) -> Column:
    """A field of a record's header; null if it is missing."""
    value = F.regexp_extract(header, rf"(?im)^{name}:[ \t]*([^\r\n]*)", 1)
    return F.when(value != "", value)


def http_payload(content: Column) -> tuple[Column, Column]:
    """The HTTP header and the payload of a record's content."""
    header = F.substring_index(content.cast("string"), END, 1)
    return header, F.substring(content, F.octet_length(header) + len(END) + 1, F.octet_length(content))


def page_records(records: DataFrame) -> DataFrame:
    """(page_id, url, record_type, payload, payload_bytes, payload_digest, refers_to) of records that :func:`write_warc` made.

    A revisit has no payload of its own; its size is that in its HTTP header and its digest that in its record header.
    """
    http, payload = http_payload(F.col("content"))
    parsed = records.select(
        F.regexp_extract(field(F.col("header"), "WARC-Record-ID"), r"page:(-?\d+)", 1).alias("id"), F.regexp_extract(F.coalesce(field(F.col("header"), "WARC-Refers-To"), F.lit("")), r"page:(-?\d+)", 1).alias("first"),
        field(F.col("header"), "WARC-Target-URI").alias("url"), field(F.col("header"), "WARC-Type").alias("record_type"),
        F.substring(field(F.col("header"), "WARC-Payload-Digest"), len("sha256:") + 1, 64).alias("stated"), field(http, "Content-Length").cast("bigint").alias("stated_bytes"), payload.alias("payload"),
    )
    revisit = F.col("record_type") == "revisit"
    return parsed.select(
        F.expr("try_cast(id AS bigint)").alias("page_id"), "url", "record_type", F.when(~revisit, F.col("payload")).alias("payload"),
        F.when(revisit, F.col("stated_bytes")).otherwise(F.octet_length("payload").cast("bigint")).alias("payload_bytes"),
        F.when(revisit, F.col("stated")).otherwise(F.sha2("payload", 256)).alias("payload_digest"),
        F.expr("try_cast(first AS bigint)").alias("refers_to"),
    )


def round_trip(pages: DataFrame, **columns: str) -> DataFrame:
    """Write ``pages`` into archives in shared storage and read their records back."""
    spark, path = pages.sparkSession, shared_dir(pages.sparkSession)
    write_warc(pages, path, **columns)
    return page_records(read_warc(spark, path))
