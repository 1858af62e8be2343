"""Running a streaming query to the end of what is available, into files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_folder


def drain(stream: DataFrame, out: str, checkpoint: str, mode: str = "update"):
    """Start `stream` over what is available; every batch lands in its own folder of `out`.

    A batch that is retried overwrites its own folder, so each is there once.
    """

    def land(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(land)
        .start()
    )


def replayed(lines: DataFrame, files: int = 6) -> DataFrame:
    """A stream of text lines (`value`): the rows of a table as JSON, in `files` files dealt by hash and so in no order, a file per batch.

    Two last files hold one line far in the future each, with nothing but its time, `at`: the first moves the watermark past
    all others, and with the second comes out what waits for time. Consumers leave them out after the watermark.
    """
    spark = lines.sparkSession
    folder = shared_folder(spark, "replay")
    names = [F.col(c) for c in lines.columns]
    text = lines.select(F.to_json(F.struct(*names)).alias("value"))
    text.repartition(files, F.xxhash64("value")).write.text(folder)
    end = spark.range(1).select(F.to_json(F.struct(F.lit(END_OF_REPLAY).alias("at"))).alias("value"))
    for _ in range(2):
        end.write.mode("append").text(folder)
    return spark.readStream.option("maxFilesPerTrigger", 1).text(folder)


END_OF_REPLAY = "2999-01-01T00:00:00.000Z"


def run_available(stream: DataFrame, keys: list[str], mode: str = "update") -> DataFrame:
    """Process everything available and return the latest row per key.

    With mode "append" every row is final and comes back as it is.
    """
    spark = stream.sparkSession
    out = shared_folder(spark, "stream-out")
    query = drain(stream, out, shared_folder(spark, "stream-state"), mode)
    query.awaitTermination()
    # A stream that never had a batch leaves no folder behind.
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())])
    if query.lastProgress:
        landed = spark.read.schema(schema).option("basePath", out).parquet(out)
    else:
        landed = spark.createDataFrame([], schema)
    if mode == "append":
        return landed.drop("batch")
    rest = [c for c in stream.columns if c not in keys]
    return (
        landed.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col("batch")).alias("_row")).select(*keys, "_row.*").select(*stream.columns)
    )
