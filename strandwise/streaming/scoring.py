"""Scoring of newly arriving sequence files with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from strandwise.plans.pipelines import predict_sequences


def score_stream(
    seqs: DataFrame, coefs: DataFrame, out: str, checkpoint: str, intercept: float = 0.0
) -> StreamingQuery:
    """Score each micro-batch of `seq_id, seq` rows and write it as Parquet.

    A sequence is one row, so its counts never span batches and no state is
    kept. A batch writes its own folder by overwrite, so a replayed batch after
    a failure gives the same files.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        predict_sequences(batch, coefs, intercept).write.mode("overwrite").parquet(
            f"{out}/batch={epoch}"
        )

    return (
        seqs.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_scores(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(out).drop("batch")
