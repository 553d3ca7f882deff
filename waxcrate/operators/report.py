"""Reports on gain plans and conversions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import one_decimal

#: The order of the report's sections.
SECTIONS = ("FfmpegLossless", "Mp3Lossless", "AacLossless", "Mp3Reencode", "AacReencode")
#: The report's headings (fixed values).
COLUMNS = ("Filename", "Format", "Bitrate (kbps)", "LUFS", "True Peak (dBTP)", "Target (dBTP)", "Headroom (dB)", "Method", "Effective Gain (dB)")


def format_label(method):
    return F.when(method.startswith("Mp3"), "MP3").when(method.startswith("Aac"), "AAC").when(method == "FfmpegLossless", "Lossless").otherwise("-")


def method_label(method):
    return F.when(method == "FfmpegLossless", "ffmpeg").when(method.endswith("Lossless"), "native").when(method.endswith("Reencode"), "re-encode").otherwise("none")


def _texts(filename: str) -> list:
    method = F.col("gain_method")
    texts = (
        F.col(filename), format_label(method), F.coalesce(F.col("kbps").cast("string"), F.lit("-")),
        one_decimal(F.col("input_i")), one_decimal(F.col("input_tp")), one_decimal(F.col("target_tp")), one_decimal(F.col("headroom"), sign=True),
        method_label(method), one_decimal(F.col("effective_gain"), sign=True),
    )
    return [t.alias(name) for t, name in zip(texts, COLUMNS, strict=True)]


def gain_report(plan: DataFrame, filename: str = "filename", by: tuple[str, ...] = ()) -> DataFrame:
    """The report's nine text columns, after the columns by, for files with headroom."""
    return plan.where(F.col("gain_method") != "None").select(*by, *_texts(filename))


def write_csv(plan: DataFrame, path: str, by: tuple[str, ...] = (), filename: str = "filename") -> None:
    """The report as CSV with a header: one file for each value of by, in a folder named after it; the file has the report's columns."""
    rows = gain_report(plan, filename, by)
    (rows.repartition(*by) if by else rows).write.partitionBy(*by).csv(path, header=True)


def sectioned_report(plan: DataFrame, by: tuple[str, ...] = ("collection_id",)) -> DataFrame:
    """Files with headroom with the number of their section and how many files it has."""
    order = F.array_position(F.array(*map(F.lit, SECTIONS)), F.col("gain_method")).cast("int")
    files = plan.where(F.col("gain_method") != "None").withColumn("section_ord", order)
    counts = files.groupBy(*by, "section_ord").agg(F.count("*").alias("section_count"))
    return files.join(counts, [*by, "section_ord"])


def lossy_followup(actions: DataFrame) -> DataFrame:
    """Tracks that were re-encoded from a lossy source, to be replaced by better ones."""
    return actions.where(F.col("action") == "ReencodeLossy")
