"""Shared folders: found, kept apart, removed."""

import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from inkveil import shared

CODE = """
import sys
from pyspark.sql import SparkSession
sys.path.insert(0, {repo!r})
from inkveil import shared
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false"){more}.getOrCreate()
one, two, three = (shared.materialize(spark.range(3)) for _ in range(3))
path = shared.shared_dir(spark)
spark.range(2).write.parquet(path)
shared.drop_shared(spark, path)
assert one.count() == two.count() == three.count() == 3
print("ROOT", shared.shared_root(spark), spark.conf.get("spark.checkpoint.dir", "unset"))
spark.stop()
"""


@pytest.mark.parametrize("named", [True, False])
def test_folders_are_removed_at_the_end(tmp_path, named):
    more = f'.config("spark.checkpoint.dir", "file://{tmp_path}")' if named else ""
    code = CODE.format(repo=str(Path(__file__).resolve().parent.parent), more=more)
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=200, check=True).stdout
    _, root, setting = next(line for line in out.splitlines() if line.startswith("ROOT")).split()
    assert root == setting or setting == "unset"
    folder = Path(root.removeprefix("file://"))
    assert not folder.exists() or list(folder.glob("inkveil-*")) == []


def test_a_cluster_must_name_a_folder(spark, monkeypatch):
    class Cluster:
        class conf:
            get = staticmethod(lambda name, default=None: default)

        class sparkContext:
            master = "spark://host:7077"

            class _jsc:
                sc = staticmethod(lambda: type("C", (), {"getCheckpointDir": staticmethod(lambda: type("N", (), {"isDefined": staticmethod(lambda: False)}))}))

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared.shared_root(Cluster)


def test_rows_of_few_tasks_are_spread(spark, tmp_path):
    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "one"))  # one row group, whatever a split's size
    spark.range(0, 1000, 1, 8).write.parquet(str(tmp_path / "eight"))
    tasks = lambda rows: rows.select(F.spark_partition_id().alias("p")).distinct().count()
    one, eight = (spark.read.parquet(str(tmp_path / n)) for n in ("one", "eight"))
    assert tasks(one) == 1 and tasks(shared.spread(one, "id")) == 4 and shared.spread(one, "id").count() == 1000
    wide = one.repartition(5)
    assert shared.spread(wide, "id") is wide and shared.spread(eight.limit(0), "id").count() == 0
