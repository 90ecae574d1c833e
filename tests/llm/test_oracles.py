"""The corpus queries that SQL can express."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from inkveil.llm.queries import ORACLES, QUERIES
from tests.compare import both


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    ours, theirs = both(spark, QUERIES[name], ORACLES[name])
    assert ours == theirs


def test_rejected_hosts_equal_the_sql(spark, tmp_path):
    """Hosts of very different failure rates, one of them null, so that the verdict and its prior decide."""
    fine = " ".join(f"word{i}" for i in range(30))
    rows = [(f"h{h}", "short" if i * 7 % 100 < rate else f"{fine} {i}") for h, (n, rate) in enumerate(((300, 95), (200, 80), (400, 3), (150, 52), (60, 58), (3, 100), (1, 0), (500, 10))) for i in range(n)]
    rows += [(None, "short" if i % 10 else fine) for i in range(120)] + [("h0", None), (None, None)]
    table = pa.table({"doc_id": pa.array(range(len(rows)), pa.int64()), "text": [t for _, t in rows], "lang": ["en"] * len(rows), "source": [s for s, _ in rows], "n_chars": pa.array([len(t or "") for _, t in rows], pa.int64())})
    pq.write_table(table, tmp_path / "documents.parquet")
    ours, theirs = both(spark, QUERIES["op4_quality_rules"], ORACLES["op4_quality_rules"], tmp_path)
    names = sorted(QUERIES["op4_quality_rules"](spark, str(tmp_path)).columns)
    lost = [r for r in ours if not r[names.index("base_failed")] and not r[names.index("kept")]]
    kept = [r for r in ours if r[names.index("kept")]]
    assert ours == theirs and len(lost) > 20 and len(kept) > 500
