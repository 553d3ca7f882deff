"""Tables between steps: written to the folder that driver and executors share, so that a lost executor costs no recomputation."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. In local mode without it (tests), a temporary folder; on a cluster that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        folder = f"file://{tempfile.mkdtemp(prefix='waxcrate-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Tables that this process has kept and not cleared.
_PATHS: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _PATHS.append(path)
    return path


def clear(spark: SparkSession) -> int:
    """Deletes all tables kept so far, once no result that reads them is needed any more; returns how many there were."""
    done = len(_PATHS)
    while _PATHS:
        path = spark._jvm.org.apache.hadoop.fs.Path(_PATHS.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return done


#: Rows of a row group of tables of whole documents.
DOCUMENT_ROWS = 16


def kept(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """df, computed once and read back from Parquet. rows: of a row group at most, for rows that are large: a reader's batch ends with its
    row group, so it holds that many and not 4096."""
    path = new_path(df.sparkSession, name)
    df.write.options(compression="zstd", **({"parquet.block.row.count.limit": str(rows)} if rows else {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
