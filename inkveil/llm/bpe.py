"""Exact, memoised encoding with tokenizers-library vocabularies.

Two facts about the supported vocabularies make parts of a text independent of one another:

* byte-level BPE with the usual pre-tokenising pattern never lets a token reach across a space that follows
  a character other than white space (:class:`SpaceSegments`);
* BPE with word ends drops white space, so white-space separated words are independent (:class:`Words`).

Memos are bounded by bytes and stay with a Python worker from task to task: of two generations, the older one goes when
the younger one is full.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from functools import cached_property

import numpy as np
import pyarrow as pa
import tiktoken
from tokenizers import Tokenizer, normalizers

from inkveil.llm.arrow_text import SLICE_BYTES, ranges

MEMO_BYTES = 64 << 20
ENTRY_BYTES = 200  # of a key, its value and its place in the table, besides what they hold
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""  # fixed value of the byte-level pre-tokeniser
_SAFE_CUT = re.compile(r"(?<=\S) ")


def read_vocabulary(path: str) -> str:
    """The tokenizer file's text, read on the driver; a vocabulary is a few MB, and tasks get it with the job."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def _plain(config: str) -> Tokenizer:
    tok = Tokenizer.from_str(config)
    tok.no_padding()
    tok.no_truncation()
    return tok


def _pack(ids: Iterable[int]) -> bytes:
    return np.asarray(ids, dtype="<u4").tobytes()


class Memo(dict):
    """The younger generation; :meth:`missing` brings back what the older one still has."""

    def __init__(self, most_bytes: int = MEMO_BYTES):
        super().__init__()
        self.most_bytes, self.held, self.older = most_bytes, 0, {}

    def put(self, pairs: Iterable[tuple]) -> None:
        for key, value in pairs:
            self[key] = value
            self.held += ENTRY_BYTES + len(key) + (sum(map(len, value)) if isinstance(value, tuple) else len(value or b""))

    def missing(self, wanted: Iterable) -> list:
        """Those of ``wanted`` that must be computed; the others are in the younger generation afterwards."""
        if self.held > self.most_bytes:
            self.older, self.held = dict(self), 0
            self.clear()
        older, out, again = self.older, [], []
        for w in wanted:
            if w in self:
                continue
            if w in older:
                again.append((w, older[w]))
            else:
                out.append(w)
        self.put(again)
        return out


_KEPT: dict[tuple[type, str], object] = {}


def kept_in_worker(kind: type, config: str):
    """One object of a kind for each worker, with its memos; another vocabulary takes its place."""
    if (kind, config) not in _KEPT:
        for key in [k for k in _KEPT if k[0] is kind]:
            del _KEPT[key]
        _KEPT[kind, config] = kind(config)
    return _KEPT[kind, config]


def _ranks(config: dict) -> dict[bytes, int] | None:
    """The vocabulary as byte ranks, if its ids are in the order of its merges (then the lowest id merges first)."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    symbol = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
    vocab, specials = config["model"]["vocab"], {t["content"] for t in config["added_tokens"]}
    merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in config["model"]["merges"]]
    if any(a >= b for a, b in zip(merged, merged[1:], strict=False)) or config["normalizer"] is not None:
        return None
    return {bytes(symbol[c] for c in token): i for token, i in vocab.items() if token not in specials}


class SpaceSegments:
    """Byte-level BPE: ids of whole texts as little-endian unsigned 32-bit bytes.

    New segments go through tiktoken's encoder, built from the same file, which gives the same ids several times faster;
    a vocabulary that it cannot represent, and every text that needs care, goes through the tokenizers library.
    """

    memo_bytes = MEMO_BYTES
    batch_bytes = SLICE_BYTES  # of texts that are cut into segments at once
    stays = True  # with its worker, from task to task

    def __init__(self, config: str):
        self.config = config
        parsed = json.loads(config)
        self.specials = [t["content"] for t in parsed["added_tokens"]]
        ranks = _ranks(parsed)
        self.fast = ranks and tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        vocab = parsed["model"]["vocab"] | {t["content"]: t["id"] for t in parsed["added_tokens"]}
        self.starts = np.zeros(max(vocab.values()) + 1, bool)
        for token, i in vocab.items():
            self.starts[i] = token.startswith("Ġ")
        self.memo = Memo(self.memo_bytes)

    @cached_property
    def tok(self) -> Tokenizer:
        """Some 40 MB, which few texts ask for."""
        return _plain(self.config)

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [_pack(e.ids) for e in self.tok.encode_batch(texts, add_special_tokens=False)]

    def _ids(self, text: str) -> np.ndarray:
        """Ids of a text without special tokens."""
        return np.asarray(self.fast.encode_ordinary(text) if self.fast else self.tok.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _learn(self, wanted: set[str]) -> None:
        """Encode segments, each with its leading space, many to a call; only a segment's first id starts with a space."""
        missing = [p for p in self.memo.missing(wanted) if p and not p[0].isspace()]
        for lo in range(0, len(missing), 4096):
            block = missing[lo : lo + 4096]
            ids = self._ids(" " + " ".join(block))
            cuts = np.flatnonzero(self.starts[ids])
            if len(cuts) != len(block):
                self.memo.put(zip(block, self._encode([" " + s for s in block]), strict=True))
                continue
            raw, ends = ids.tobytes(), [*(cuts[1:] * 4).tolist(), len(ids) * 4]
            self.memo.put((s, raw[a:b]) for s, a, b in zip(block, (cuts * 4).tolist(), ends, strict=True))

    def encode(self, texts: pa.Array) -> list[bytes]:
        """:meth:`encode_batch` of as many texts at a time as ``batch_bytes`` holds; null texts are empty."""
        return [ids for lo, hi in ranges(texts, self.batch_bytes) for ids in self.encode_batch([t or "" for t in texts.slice(lo, hi - lo).to_pylist()])]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """What encoding each whole text gives, special tokens in the text included.

        A cut before a space is safe when the part after it starts with something else than white space: the white
        space before the cut is then one token group in the whole text as in the part. Other texts go the careful way.
        """
        out: list[bytes] = []
        special = [any(s in t for s in self.specials) for t in texts]
        cut = [[""] if x else t.split(" ") for t, x in zip(texts, special, strict=True)]
        wanted: set[str] = set()
        for parts in cut:
            wanted.update(parts[1:])
        self._learn(wanted)
        memo = self.memo
        for text, parts, x in zip(texts, cut, special, strict=True):
            try:
                if x:
                    raise KeyError
                out.append(_pack(self._ids(parts[0])) + b"".join([memo[p] for p in parts[1:]]))
            except KeyError:
                out.append(self._careful(text))
        return out

    def _careful(self, text: str) -> bytes:
        if any(s in text for s in self.specials):
            return self._encode([text])[0]
        parts = _SAFE_CUT.split(text)
        return b"".join(self._encode([parts[0], *(" " + p for p in parts[1:])]))


class Words:
    """BPE with word ends: ids of single white-space separated words, given as UTF-8 bytes."""

    def __init__(self, config: str):
        self.tok = _plain(config)
        self.lower = _plain(config)  # for words in lower-case Latin-1, which the normaliser would leave as they are
        self.lower.normalizer = normalizers.Sequence([])
        self.memo = Memo()
        mark = self.tok.encode("\0", add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.tokens = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.tokens[i] = token.encode()

    def learn(self, words: set[bytes]) -> None:
        """Put ``words`` into the memo, encoding the unknown ones many to a call with a separator between them."""
        missing = self.memo.missing(words)
        simple: dict[bytes, tuple[bytes, bytes]] = {}  # as a lower-case stem and a full stop or comma, which stands alone
        other: list[bytes] = []
        for w in missing:
            text = w.decode()
            if max(text) < "\u0100":
                text = text.lower()
                cut = text[-1] in ".," and text[:-1].isalpha()
                simple[w] = (text[:-1].encode(), text[-1].encode()) if cut else (text.encode(), b"")
            else:
                other.append(w)
        stems = {part for pair in simple.values() for part in pair}
        known = {s: self.memo[s] for s in stems if s in self.memo} | {b"": b""}
        known.update(self._encoded(self.lower, [s for s in stems if s not in known]))
        self.memo.put((w, known[stem] + known[mark]) for w, (stem, mark) in simple.items())
        self.memo.put(self._encoded(self.tok, other))

    def _encoded(self, tok: Tokenizer, words: list[bytes]) -> Iterable[tuple[bytes, bytes]]:
        for lo in range(0, len(words), 2048):
            block = words[lo : lo + 2048]
            ids = np.asarray(tok.encode(b" \0 ".join(block).decode(), add_special_tokens=False).ids, dtype="<u4")
            cuts = np.flatnonzero(ids == self.mark) if self.mark is not None else ids[:0]
            if len(cuts) != len(block) - 1:  # a word holds the separator itself
                got = self.tok.encode_batch([w.decode() for w in block], add_special_tokens=False)
                yield from ((w, _pack(e.ids)) for w, e in zip(block, got, strict=True))
                continue
            raw = ids.tobytes()
            begins, ends = [0, *((cuts + 1) * 4).tolist()], [*(cuts * 4).tolist(), len(raw)]
            yield from ((w, raw[a:b]) for w, a, b in zip(block, begins, ends, strict=True))

    def decode(self, ids: bytes) -> bytes:
        """The library's ``decode`` of packed ids for a vocabulary without a decoder: its tokens, space-joined."""
        return b" ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))
