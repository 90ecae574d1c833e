"""Batches are worked off in pieces of bounded bytes."""

import pyarrow as pa

from inkveil.functions import pieces


def test_pieces_cover_all_rows_and_hold_few_bytes(monkeypatch):
    monkeypatch.setattr(pieces, "PIECE_BYTES", 10)
    for column in (pa.array(["a" * 6, "b" * 6, None, "", "c" * 30, "d"]), pa.array([["a" * 3, "a" * 3], ["b" * 6], None, [], ["c" * 30, None], ["d"]])):
        for part in (column, column.slice(1, 4)):
            runs = list(pieces.pieces(part))
            assert [i for lo, n in runs for i in range(lo, lo + n)] == list(range(len(part))) and len(runs) > 1
    assert list(pieces.pieces(pa.array([], pa.string()))) == []


def test_results_come_piece_by_piece(monkeypatch):
    monkeypatch.setattr(pieces, "PIECE_BYTES", 10)
    out = list(pieces.each_row(iter([(pa.array(["x" * 6] * 4), pa.array([1, 2, None, 4]))]), lambda a, b: b and len(a) * b, pa.int64()))
    assert [x for part in out for x in part.to_pylist()] == [6, 12, None, 24] and len(out) == 4
