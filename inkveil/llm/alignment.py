"""Alignment of two tokenizers' tokens over the same bytes.

A transducer walks both token sequences of a text at once. Its state is which side leads and the bytes of that side's
last token that the other side has not matched yet (the dangling suffix); the next token of the side that lags is matched
against it, and an empty suffix closes a group. Moves are memoised by suffix and token. A text is walked in segments that
neither tokenizer reaches across, and what a segment gives is memoised as well, so that frequent words are walked once.

Links between overlapping tokens are then counted over the whole corpus. The most frequent pairs, whose number is bounded,
go to all tasks; the documents' other pairs meet their counts in a join by key.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.llm.arrow_text import slices
from inkveil.llm.bpe import Memo, SpaceSegments, _ranks, kept_in_worker, read_vocabulary
from inkveil.llm.storage import materialize

SPACE = "▁"
A_LEADS, B_LEADS = 0, 1
SHIFT = 20  # a pair is (A id << SHIFT) | B id
HOT_PAIRS = 1 << 19  # pairs that go to all tasks, at most
MOVES = 1 << 17  # remembered at most
BLOCK = 4096  # segments encoded in one call
SEGMENT_BYTES, SLICE_BYTES = 36 << 20, 2 << 20  # of the memo of segments, in each of its generations; of texts at a time
LONG_SEGMENT = 64  # characters from which a segment is not kept
_CUT = re.compile(r"(?<=\S) ")
_ACROSS = re.compile(f"[^{SPACE}]{SPACE}")


class PlainSegments(SpaceSegments):
    """Byte-level BPE in which the strings of special tokens are text like any other."""

    def __init__(self, config: str):
        super().__init__(config)
        self.tok.encode_special_tokens = True
        self.specials = []
        self.memo = Memo(4 << 20)  # serves one block; the aligner keeps what its segments give

    def after_space(self, parts: list[str]) -> list[list[int]]:
        """Ids of each part with a space before it. Words are encoded together, since only a word's first id has a space."""
        words = [p for p in parts if p.split() == [p]]
        ids = self._ids(" " + " ".join(words))
        cuts = np.flatnonzero(self.starts[ids]).tolist()
        found = {}
        if len(cuts) == len(words):
            listed = ids.tolist()
            found = {w: listed[a:b] for w, a, b in zip(words, cuts, [*cuts[1:], len(listed)], strict=True)}
        return [found[p] if p in found else self._ids(" " + p).tolist() for p in parts]


class Transducer:
    """Walks token ids of two vocabularies given as the bytes of each id (None: an id without bytes of its own).

    A state stands for the side that leads and its dangling suffix; its lowest bit is the side, and 0 is the empty suffix,
    after which a token of A comes next.
    """

    def __init__(self, a_bytes: list[bytes | None], b_bytes: list[bytes | None]):
        self.bytes = (a_bytes, b_bytes)
        self.names = tuple(list(map(str, range(len(x)))) for x in self.bytes)
        self._forget()

    def _forget(self) -> None:
        self.suffixes: list[bytes] = [b""]
        self.states: dict[tuple[int, bytes], int] = {}
        self.moves: dict[int, int] = {}  # by state << SHIFT | token; -1 where bytes differ

    def _move(self, state: int, token: int) -> int:
        """The state after ``token`` of the side that lags (of A from the empty suffix)."""
        side, suffix = (state & 1, self.suffixes[state >> 1]) if state else (B_LEADS, b"")
        new = self.bytes[1 - side][token]
        if not new:
            return -1
        if suffix.startswith(new):
            rest = suffix[len(new) :]
        elif new.startswith(suffix):
            side, rest = 1 - side, new[len(suffix) :]
        else:
            return -1
        if not rest:
            return 0
        if (side, rest) not in self.states:
            self.states[side, rest] = len(self.suffixes) << 1 | side
            self.suffixes.append(rest)
        return self.states[side, rest]

    def walk(self, a: list[int], b: list[int]) -> tuple[str, list[int]] | None:
        """(groups as ``a1,a2|b1;a3|b2,b3``, links as packed pairs), or None where the two sides' bytes differ."""
        if len(self.moves) > MOVES:
            self._forget()
        moves, (a_names, b_names) = self.moves, self.names
        n_a, n_b, i, j = len(a), len(b), 0, 0
        groups: list[str] = []
        links: list[int] = []
        while i < n_a:
            from_a, from_b, state = i, j, 0
            while True:
                if state & 1 == A_LEADS and state:
                    if j == n_b:
                        return None
                    token = b[j]
                    links.append(a[i - 1] << SHIFT | token)
                    j += 1
                else:
                    if i == n_a:
                        return None
                    token = a[i]
                    if state:
                        links.append(token << SHIFT | b[j - 1])
                    i += 1
                key = state << SHIFT | token
                state = moves.get(key)
                if state is None:
                    state = moves[key] = self._move(key >> SHIFT, token)
                if state <= 0:
                    break
            if state:
                return None
            left = a_names[a[from_a]] if i - from_a == 1 else ",".join([a_names[x] for x in a[from_a:i]])
            right = b_names[b[from_b]] if j - from_b == 1 else ",".join([b_names[x] for x in b[from_b:j]])
            groups.append(left + "|" + right)
        return (";".join(groups), links) if j == n_b else None


class Aligner:
    """Both encoders, the transducer and the memo of segments, kept in a worker."""

    def __init__(self, config: tuple[str, bytes]):
        vocabulary, model = config
        self.a = PlainSegments(vocabulary)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        ranks = _ranks(json.loads(vocabulary))
        if ranks is None:
            raise ValueError("not a byte-level vocabulary whose ids are in the order of its merges")
        a_bytes: list[bytes | None] = [None] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            a_bytes[i] = token
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        b_bytes: list[bytes | None] = []
        for i, piece in enumerate(pieces):
            if self.b.is_byte(i):
                b_bytes.append(bytes([int(piece[3:5], 16)]))
            else:
                b_bytes.append(None if self.b.is_control(i) or self.b.is_unknown(i) else piece.replace(SPACE, " ").encode())
        self.space = self.b.piece_to_id(SPACE)
        self.transducer = Transducer(a_bytes, b_bytes)
        #: no piece goes on into the white space after a word: then texts can be cut there
        self.cuttable = not any(_ACROSS.search(p) for p in pieces)
        self.memo = Memo(SEGMENT_BYTES)

    def parts(self, text: str) -> list[str]:
        """Segments of space+text, each without the space that it begins with."""
        if not self.cuttable:
            return [text]
        first, *others = _CUT.split(" " + text)
        return [first[1:], *others]

    def _align(self, parts: list[str]) -> Iterator[tuple[bytes, bytes, bytes] | None]:
        """(groups, links, number of A's tokens) of space+part for each part; None where B's bytes are not A's.

        A's bytes are always those of the text, for its tokens are made of the text's bytes."""
        b_ids = self.b.encode(parts, out_type=int, num_threads=1)
        walk = self.transducer.walk
        for part, a, b in zip(parts, self.a.after_space(parts), b_ids, strict=True):
            walked = walk(a, b if part else [self.space])
            yield walked and (walked[0].encode(), array("q", walked[1]).tobytes(), len(a).to_bytes(8, "little"))

    def align_batch(self, texts: list[str]) -> list[tuple[bytes, np.ndarray, int] | None]:
        """(groups, packed links, number of A's tokens) of every text; None for one without tokens."""
        cut = [self.parts(t) if t else [] for t in texts]
        distinct: set[str] = set()
        for parts in cut:
            distinct.update(parts)
        missing = self.memo.missing([p for p in distinct if len(p) <= LONG_SEGMENT])
        for lo in range(0, len(missing), BLOCK):
            block = missing[lo : lo + BLOCK]
            self.memo.put(zip(block, self._align(block), strict=True))
        long = [p for p in distinct if len(p) > LONG_SEGMENT]
        extra = dict(zip(long, self._align(long), strict=True))
        known, out = self.memo.__getitem__, []
        for parts in cut:
            if extra:
                found = [extra[p] if len(p) > LONG_SEGMENT else known(p) for p in parts]
            else:
                found = list(map(known, parts))
            if not found or None in found:
                out.append(None)
                continue
            groups, links, n_a = zip(*found, strict=True)
            out.append((b";".join(groups), np.frombuffer(b"".join(links), "<i8"), int(np.frombuffer(b"".join(n_a), "<i8").sum())))
        return out


def align_texts(docs: DataFrame, vocabulary: str, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_a, n_b, n_groups, n_links, groups, pairs (array of (pair, n), pair = A id << 20 | B id).

    ``vocabulary`` is the path of a byte-level BPE file of the tokenizers library (A), ``model`` of a sentencepiece model
    that adds a space (B). ``groups`` has A's and B's ids as ``a1,a2|b1;a3|b2,b3``. Null and empty texts, and those whose
    tokens do not spell space+text, have zeros, an empty ``groups`` and no pairs. Repeated rows and null ids are kept; an
    empty table gives no rows; other columns are not read.
    """
    with open(model, "rb") as f:
        config = (read_vocabulary(vocabulary), f.read())
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, pairs array<struct<pair:bigint,n:bigint>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = kept_in_worker(Aligner, config)
        for batch in slices(batches, text_col, SLICE_BYTES):
            numbers, groups, keys, counts, sizes = [], [], [], [], [0]
            for found in aligner.align_batch(batch.column(text_col).to_pylist()):
                if found is None:
                    numbers.append((0, 0, 0, 0))
                    groups.append(b"")
                    sizes.append(sizes[-1])
                    continue
                text, links, n_a = found
                n_groups = text.count(b";") + 1
                numbers.append((n_a, len(links) + n_groups - n_a, n_groups, len(links)))  # every token but a group's first gives a link
                groups.append(text)
                pairs, n = np.unique(links, return_counts=True)
                keys.append(pairs), counts.append(n)
                sizes.append(sizes[-1] + len(pairs))
            flat = [np.concatenate([*x, np.empty(0, np.int64)]).astype(np.int64) for x in (keys, counts)]
            pairs = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.StructArray.from_arrays([pa.array(x) for x in flat], ["pair", "n"]))
            columns = [pa.array(x, pa.int64()) for x in zip(*numbers, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), *columns, pa.array(groups, pa.binary()).cast(pa.string()), pairs], names=[id_col, "n_a", "n_b", "n_groups", "n_links", "groups", "pairs"])

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, count, best): how many links of all documents hold a pair, and whether none of its B id's pairs has more."""
    counted = materialize(aligned.select(F.inline("pairs")).groupBy("pair").agg(F.sum("n").alias("count")))
    b_id = F.col("pair").bitwiseAND(F.lit((1 << SHIFT) - 1))
    most = counted.groupBy(b_id.alias("b")).agg(F.max("count").alias("most"))  # a row for each of B's ids
    return counted.withColumn("b", b_id).join(F.broadcast(most), "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Of each list's values; in integers, so that no count is rounded."""
    running = np.concatenate([[0], np.cumsum(values)])
    return running[offsets[1:]] - running[offsets[:-1]]


def score_links(rows: DataFrame, counts: DataFrame, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """(row, n_best, count_sum) of every row, from (row, pairs) and the counts of :func:`pair_counts`.

    Pairs with more than one in ``hot_pairs`` of all links are fewer than that many: they are sent to all tasks as sorted
    arrays. What a document has besides them is joined by pair, where no key can hold more than that share of the links.
    """
    counts = materialize(counts)
    least = (counts.agg(F.sum("count")).first()[0] or 0) // hot_pairs
    hot = counts.where(F.col("count") > least).toArrow()
    found = {c: hot.column(c).to_numpy() for c in hot.column_names}
    order = np.argsort(found["pair"])
    sent = rows.sparkSession.sparkContext.broadcast(tuple(found[c][order] for c in ("pair", "count", "best")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, count, best = sent.value
        for batch in batches:
            lists = batch.column("pairs")
            offsets = np.asarray(lists.offsets, np.int64)
            lo, hi = int(offsets[0]), int(offsets[-1])
            pairs, n = (np.asarray(lists.values.field(k))[lo:hi] for k in (0, 1))
            offsets = offsets - lo
            place = np.minimum(np.searchsorted(known, pairs), max(len(known) - 1, 0))
            met = known[place] == pairs if len(known) else np.zeros(len(pairs), bool)
            gained = [np.zeros(len(pairs), np.int64) for _ in range(2)]
            gained[0][met] = n[met] * best[place[met]]
            gained[1][met] = n[met] * count[place[met]]
            left = np.concatenate([[0], np.cumsum(~met)])[offsets].astype(np.int32)
            rest = pa.ListArray.from_arrays(pa.array(left), pa.StructArray.from_arrays([pa.array(pairs[~met]), pa.array(n[~met])], ["pair", "n"]))
            yield pa.RecordBatch.from_arrays([batch.column("row"), *(pa.array(_sums(x, offsets)) for x in gained), rest], names=["row", "n_best", "count_sum", "rest"])

    partly = materialize(rows.select("row", "pairs").mapInArrow(run, "row bigint, n_best bigint, count_sum bigint, rest array<struct<pair:bigint,n:bigint>>"))
    tail = partly.select("row", F.inline("rest")).join(counts.where(F.col("count") <= least), "pair")
    late = tail.select("row", F.when(F.col("best"), F.col("n")).otherwise(0).alias("n_best"), (F.col("n") * F.col("count")).alias("count_sum"))
    return partly.drop("rest").unionByName(late).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def align_documents(
    docs: DataFrame, vocabulary: str, model: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False, hot_pairs: int = HOT_PAIRS
) -> DataFrame:
    """:func:`align_texts` with n_best (links whose pair is the most frequent of its B id) and count_sum (of the links'
    pairs' counts over all documents) instead of the pairs.

    With ``digest``, ``groups`` holds its SHA-256 in lower-case hex (an empty one stays), which spares the writing of all
    groups to shared storage. Edge cases are those of :func:`align_texts`.
    """
    aligned = align_texts(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), vocabulary, model, "id", "text")
    if digest:
        aligned = aligned.withColumn("groups", F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)))
    rows = materialize(aligned.withColumn("row", F.monotonically_increasing_id()))
    scores = score_links(rows.select("row", "pairs"), pair_counts(rows), hot_pairs)
    joined = rows.drop("pairs").join(scores, "row")
    return joined.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")
