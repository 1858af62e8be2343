"""Versions that two writers cannot both claim, and partitions that a filter prunes to."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from mnemoloom.api import Store
from mnemoloom.sources import snapshots


def test_the_second_of_two_writers_is_told(spark, tmp_path):
    root = str(tmp_path / "t")
    first = snapshots.publish(spark.range(1), root)
    assert first == 1 and snapshots.publish(spark.range(2), root, expected=1) == 2
    with pytest.raises(snapshots.Conflict):
        snapshots.publish(spark.range(3), root, expected=1)
    assert snapshots.current(spark, root).count() == 2 and snapshots.current(spark, root, 1).count() == 1


def test_updates_of_many_writers_all_count(spark, tmp_path):
    root = str(tmp_path / "t")

    def add(k):
        row = spark.range(k, k + 1)
        return snapshots.update(spark, root, lambda have: row if have is None else have.unionByName(row), tries=30)

    with ThreadPoolExecutor(4) as pool:
        versions = list(pool.map(add, range(6)))
    assert sorted(versions) == [1, 2, 3, 4, 5, 6]
    assert sorted(r.id for r in snapshots.current(spark, root).collect()) == list(range(6))


def test_a_repository_is_read_alone(spark, tmp_path, capsys):
    store = Store(spark, str(tmp_path))
    rows = [(repo, f"n{k}", f"n{k}", f"n{k}()", "a.js", k, True) for repo in ("1", "2") for k in range(3)]
    store.publish("symbols", spark.createDataFrame(rows, "repo string, node_id string, name string, label string, file string, line int, callable boolean"))
    mine = store.read("symbols").filter(F.col("repo") == "1")
    mine.explain()
    plan = capsys.readouterr().out
    assert "PartitionFilters: [isnotnull(repo" in plan and mine.count() == 3
    assert store.read("symbols").columns[0] == "repo" and dict(mine.dtypes)["repo"] == "string"
