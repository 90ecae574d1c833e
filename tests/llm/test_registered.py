"""All corpus queries are there when the subpackage is: a misspelt import in it must not look like a build without it."""

import __spark_entry__


def test_every_corpus_query_is_registered():
    names = list(__spark_entry__.queries())
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)] == [1] * 13 and "pipeline" in names
    assert {"op2_warc_boundary_chain", "op4_quality_rules", "op12_importance_resampling"} <= set(__spark_entry__.oracle_sql())
