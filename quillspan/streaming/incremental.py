"""New logs as a stream: each micro-batch is parsed and what is already kept is left out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillspan.functions.text import key_of
from quillspan.operators.dedupe import eligible
from quillspan.sources.textlog import parsed

KEY = ["title", "norm"]


def start(spark: SparkSession, folder: str, out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append the new clips of logs that arrive in ``folder`` to the Parquet table ``out``.

    A clip is new if no clip of its title with the same normalised text is kept. A batch that
    is run again after a failure finds its rows kept and adds none.
    """

    def absorb(batch: DataFrame, batch_id: int) -> None:
        fresh = eligible(parsed(batch)).withColumn("norm", key_of(F.col("text"))).dropDuplicates(KEY).withColumn("batch", F.lit(batch_id))
        try:
            fresh = fresh.join(spark.read.parquet(out).select(*KEY), KEY, "left_anti")
        except Exception as e:  # noqa: BLE001 - only the missing table of a first batch
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        fresh.write.mode("append").parquet(out)

    logs = spark.readStream.format("text").option("wholetext", True).schema("value string").load(folder).select(F.lit(folder).alias("path"), "value")
    writer = logs.writeStream.foreachBatch(absorb).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
