"""Gain planning on a stream of logs. Parsing and planning are projections, so a streaming table goes through them unchanged."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.loudness import TpTarget, accepted, gain_plan, parse_logs, rejects


def planned_stream(logs: DataFrame, target: TpTarget = TpTarget()) -> DataFrame:  # noqa: B008
    """Plans of the logs as they come; kbps is the log's own, as a probe would need a second table. For the others see gain_sink."""
    return gain_plan(accepted(parse_logs(logs)).withColumn("kbps", F.col("log_kbps")), target)


def gain_sink(logs: DataFrame, plans: str, rejected: str, checkpoint: str, target: TpTarget = TpTarget(), after: Callable[[int], None] | None = None) -> DataStreamWriter:  # noqa: B008
    """A stream that writes each log once, as a plan below the folder plans or as a reject with its reason below rejected; start() runs it.

    A batch goes to the folders batch=<id> of both, which it replaces: a batch that is done again after a stop writes the same rows to the same
    place. Reading either folder gives batch as a column. after(batch) is called between the two writes, for tests that stop there.
    """

    def write(batch: DataFrame, at: int) -> None:
        measured = parse_logs(batch).persist()
        try:
            rejects(measured).write.mode("overwrite").parquet(f"{rejected}/batch={at}")
            if after:
                after(at)
            plan = gain_plan(accepted(measured).withColumn("kbps", F.col("log_kbps")), target)
            plan.write.mode("overwrite").parquet(f"{plans}/batch={at}")
        finally:
            measured.unpersist()

    return logs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
