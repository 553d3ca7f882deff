"""What the corpus operators share: the scratch folder, Arrow batches, and small Column helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch. Documents are long, so the default of 10,000 rows would make batches of many MB.
BATCH_ROWS = 1000
#: Bytes of text that a vectorised step takes at a time; one longer document is a step of its own.
STEP_BYTES = 1 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a new local folder in local mode
    (tests); on a cluster that would be a disk of each machine, so it is an error."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="waxcrate-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, and survives the loss of executors. discard deletes it."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.scratch = path
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes tables that written made and that no later result reads."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.scratch)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches sent to Python workers, unless the session has its own setting."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def steps(texts: list[str], limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold about limit characters each, so that no vectorised step grows with the batch."""
    at, held = 0, 0
    for i, text in enumerate(texts):
        if held and held + len(text) > limit:
            yield at, i
            at, held = i, 0
        held += len(text)
    if at < len(texts):
        yield at, len(texts)


def arrow_rows(batches: Iterable[pa.RecordBatch], schema: pa.Schema, make: Callable[[dict], Iterable[dict]]) -> Iterator[pa.RecordBatch]:
    """Applies make to each batch as a dict of Python lists; make yields dicts of columns."""
    for batch in batches:
        for columns in make(batch.to_pydict()):
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, also where body uses it inside the lambda of a higher-order function."""
    return F.transform(F.array(value), body)[0]


def word_array(text: Column) -> Column:
    """Words of the shingle operators: lower-cased runs of ASCII letters, digits and non-ASCII characters; null gives none.

    The same words as ``shingles.word_hashes``.
    """
    cleaned = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[\x00-\x7F&&[^a-z0-9]]+", " "))
    return F.when(cleaned == "", F.array().cast("array<string>")).otherwise(F.split(cleaned, " "))


def shingles_of(hashes: Column) -> Column:
    """64-bit hashes of all runs of five word hashes; fewer words have none. Three passes, each over pairs of numbers."""

    def joined(a: Column, b: Column, skip: int) -> Column:
        """Hashes of a[i] with b[i + skip], as long as both exist."""
        n = F.size(b) - skip
        return F.when(n > 0, F.zip_with(F.slice(a, 1, n), F.slice(b, skip + 1, n), lambda x, y: F.xxhash64(x, y))).otherwise(F.array().cast("array<bigint>"))

    return let(hashes, lambda one: let(joined(one, one, 1), lambda two: let(joined(two, two, 2), lambda four: joined(four, one, 4))))


def hashed(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))
