"""Token alignment against a brute-force version over byte offsets."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from inkveil.llm import alignment
from inkveil.llm.queries import QUERIES

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "\n\n", "  a", "a  b   c\n\n d \n e\t f ", "x<|endoftext|> y <unk> <s> <0x41>", "a\x1cb \x00 c \x85 d", "É́ é ́x", "x" * 9000, "日本語 テスト 😀 password: 日本", "trail ", "trail\n",
    "a　b", "▁ a▁b", "a  ", "\r\n \r\n", "don't I'LL", "a\n b \n  c", "᠎ x​ y",
]


def texts():
    rng, signs = random.Random(3), ["a", "b", " ", "  ", "\n", "é", "日", "1", "'s", ".", "\t", "▁", "😀", "the", " of"]
    return ODD + ["".join(rng.choices(signs[:11] if k % 3 else signs, k=rng.randint(1, 30))) for k in range(150)] + ["the of the cat"] * 3


def brute(rows):
    tok, sp = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    tok.encode_special_tokens = True
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    symbol = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}

    def one(text):
        a, b = tok.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
        a_bytes = [bytes(symbol[c] for c in tok.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if {b"".join(a_bytes), b"".join(b_bytes)} != {(" " + text).encode()}:
            return None
        a_ends, b_ends = (np.cumsum([len(x) for x in y]).tolist() for y in (a_bytes, b_bytes))
        groups, links, i, j, a0, b0 = [], [], 0, 0, 0, 0
        while i < len(a):
            links.append((a[i], b[j]))
            x, y = a_ends[i], b_ends[j]
            i, j = i + (x <= y), j + (y <= x)
            if x == y:
                groups.append(",".join(map(str, a[a0:i])) + "|" + ",".join(map(str, b[b0:j])))
                a0, b0 = i, j
        return len(a), len(b), groups, links

    found = [(i, one(t) if t else None) for i, t in rows]
    count = Counter(x for _, f in found if f for x in f[3])
    most = {}
    for (_, b), n in count.items():
        most[b] = max(most.get(b, 0), n)
    for i, f in found:
        yield (i, 0, 0, 0, 0, 0, 0, "") if not f else (i, f[0], f[1], len(f[2]), len(f[3]), sum(count[x] == most[x[1]] for x in f[3]), sum(count[x] for x in f[3]), ";".join(f[2]))


@pytest.mark.parametrize("hot_pairs", [alignment.HOT_PAIRS, 20])
def test_alignment_equals_byte_offsets(spark, hot_pairs):
    rows = [*enumerate(texts()), (3, "again"), (None, "no id"), (None, None)]
    clash = ("row", "n_a", "pairs", "pair", "groups", "best", "count", "id", "n")
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit("clash") for c in clash}).repartition(3)
    got = Counter(tuple(r) for r in alignment.align_documents(docs, A, B, hot_pairs=hot_pairs).collect())
    assert got == Counter(brute(rows))
    assert alignment.align_documents(docs.limit(0), A, B).count() == 0


def test_query_gives_digests_of_whole_table(spark, tmp_path):
    rows = list(enumerate(texts()[:60]))
    pq.write_table(pa.table({"doc_id": pa.array([i for i, _ in rows], pa.int64()), "text": [t for _, t in rows]}), tmp_path / "documents.parquet")
    got = Counter(tuple(r) for r in QUERIES["op11_token_alignment"](spark, str(tmp_path)).collect())
    assert got == Counter((*r[:7], r[7] and hashlib.sha256(r[7].encode()).hexdigest()) for r in brute(rows))


def test_transducer_tracks_the_leading_side_and_closes_on_an_empty_suffix():
    walker = alignment.Transducer([b"ab", b"cde", b"f", None], [b"a", b"bc", b"def", b"x", b""])
    assert walker.walk([0, 1, 2, 0], [0, 1, 2]) is None  # the last token of A is not matched
    groups, links = walker.walk([0, 1, 2], [0, 1, 2])
    assert groups == "0,1,2|0,1,2"
    assert [(x >> alignment.SHIFT, x & (1 << alignment.SHIFT) - 1) for x in links] == [(0, 0), (0, 1), (1, 1), (1, 2), (2, 2)]
    assert {(alignment.A_LEADS, b"ab"), (alignment.A_LEADS, b"b"), (alignment.B_LEADS, b"c"), (alignment.B_LEADS, b"f")} <= set(walker.states)
    assert walker.walk([0, 1, 2] * 2, [0, 1, 2] * 2)[0] == "0,1,2|0,1,2;0,1,2|0,1,2"
    assert walker.walk([2], [3]) is None and walker.walk([3], [0]) is None and walker.walk([0], [4]) is None and walker.walk([0], [0]) is None
