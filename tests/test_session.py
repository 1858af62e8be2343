"""Tasks take bounded shares of an input, however large it is."""

import pytest
from pyspark.sql import functions as F

from mnemoloom import session
from mnemoloom.operators import history


@pytest.fixture
def settings(spark):
    names = [*session._SHARES, session._INITIAL]
    before = {k: spark.conf.get(k, None) for k in names}
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_partitions_follow_the_input(spark, settings, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "BYTES_PER_SHUFFLE", 1 << 10)
    monkeypatch.setitem(session._SHARES, "spark.sql.adaptive.advisoryPartitionSizeInBytes", "16k")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "1k")
    try:
        most = []
        for n in (20_000, 80_000):
            folder = f"{tmp_path}/{n}"
            commits = spark.range(n).select((F.col("id") / 4).cast("long").alias("commit"), F.concat(F.lit("f"), F.col("id").cast("string")).alias("file"))
            commits.write.parquet(f"{folder}/commits.parquet")
            session.tune(spark, folder)
            pairs = history.cochange(spark.read.parquet(f"{folder}/commits.parquet"))
            assert pairs.count() == n // 4 * 6
            most.append(pairs.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0])
        # Four times the input, and a task still holds about the same; with four fixed partitions it held four times as much.
        assert most[1] < most[0] * 2
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.minPartitionSize")


def test_own_settings_stay(spark, settings, tmp_path):
    spark.range(1).write.parquet(f"{tmp_path}/t.parquet")
    session.tune(spark, str(tmp_path))
    assert spark.conf.get(session._INITIAL) == spark.conf.get("spark.sql.shuffle.partitions") == "4"
