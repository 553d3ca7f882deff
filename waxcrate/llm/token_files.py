"""Token-ID output: flat unsigned integer files with 64-bit document offsets, read back through memory maps.

A folder holds, for each range partition of the document ids, three files: ``.bin`` (ids of all its documents, each with the end
id, little-endian uint16 or uint32), ``.off`` (int64, documents + 1 offsets into ``.bin``) and ``.doc`` (int64 document ids; the
smallest int64 marks null). A manifest row names each set. A partition's base, the ids before it, is the prefix sum of the
manifest's totals, so a reader can start anywhere and no task needs more than its own file.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch_path, small_batches, steps, written
from .tokens import encoder

#: Documents whose offsets and ids a reader takes at a time.
DOCS_AT_ONCE = 1000
NO_ID = np.iinfo(np.int64).min
MANIFEST = "part int, path string, dtype string, n_docs long, n_tokens long"
_FIELDS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def filesystem(uri: str):
    """The file system of a folder's URI, and the path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri)


def write_token_files(docs: DataFrame, folder: str, vocab: str = "byte_bpe_50k.json", end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the ids of every whole text in ascending document id order; returns the manifest, one row for each partition.

    Null texts count as empty: they have the end id only. A null id comes first. Rows of one id go by the hash of their text, so that
    an id with any share of the rows is dealt to many partitions. An empty table gives an empty manifest. Columns of docs other than
    these two aren't looked at, whatever their names. Files of failed attempts keep other names, which no manifest row mentions.
    """
    small_batches(docs.sparkSession)
    ordered = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    ordered = ordered.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = filesystem(folder)
        e = encoder(vocab)
        dtype = np.dtype("<u2") if e.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        name, out, ids, lengths = f"{path}/{uuid.uuid4().hex}", None, [], []
        for batch in batches:
            texts = batch.column("text").to_pylist()
            if texts and out is None:
                store.create_dir(path)
                out = store.open_output_stream(f"{name}.bin")
            ids.append(batch.column("doc_id").fill_null(int(NO_ID)).to_numpy(zero_copy_only=False))
            for a, b in steps(texts):
                flat, edges = e.encode(texts[a:b])
                closed = np.insert(flat, edges[1:], end_id)
                out.write(closed.astype(dtype).tobytes())
                lengths.append(np.diff(edges) + 1)
        if out is not None:
            out.close()
            n = np.concatenate(lengths)
            for kind, values in (("off", np.concatenate([[0], np.cumsum(n)])), ("doc", np.concatenate(ids))):
                with store.open_output_stream(f"{name}.{kind}") as f:
                    f.write(values.astype("<i8").tobytes())
            row = {"part": [TaskContext.get().partitionId()], "path": [name], "dtype": [dtype.str], "n_docs": [len(n)], "n_tokens": [int(n.sum())]}
            yield pa.RecordBatch.from_pydict(row, schema=pa.schema([("part", pa.int32()), ("path", pa.string()), ("dtype", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    return written(ordered.mapInArrow(write, MANIFEST), "token-manifest")


def _array(store, path: str, dtype: str) -> Callable[[int, int], np.ndarray]:
    """(first, last) -> those values of a file of numbers: through a memory map, or by reading that range where files aren't local."""
    kind = np.dtype(dtype)
    if store.type_name == "local":
        return (lambda a, b, m=np.memmap(path, kind, "r"): m[a:b]) if store.get_file_info(path).size else lambda a, b: np.zeros(0, kind)
    file = store.open_input_file(path)
    return lambda a, b: np.frombuffer(file.read_at((b - a) * kind.itemsize, a * kind.itemsize), kind)


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """For each document in the files: doc_id, start (ids before it), n_tokens (with the end id), ids_crc32 of its uint32 ids."""
    based = manifest.withColumn("base", F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = filesystem(folder)
        for batch in batches:
            for row in batch.to_pylist():
                offsets, ids, values = (_array(store, f"{row['path']}.{kind}", dtype) for kind, dtype in (("off", "<i8"), ("doc", "<i8"), ("bin", row["dtype"])))
                for a in range(0, row["n_docs"], DOCS_AT_ONCE):
                    at, own = offsets(a, min(a + DOCS_AT_ONCE, row["n_docs"]) + 1), ids(a, min(a + DOCS_AT_ONCE, row["n_docs"]))
                    held, edges = values(int(at[0]), int(at[-1])), (at - at[0]).tolist()
                    crc = [zlib.crc32(held[x:y].astype("<u4")) for x, y in zip(edges[:-1], edges[1:], strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(own, mask=own == NO_ID), pa.array(at[:-1] + row["base"]), pa.array(np.diff(at)), pa.array(crc, pa.int64())], schema=_FIELDS)

    return based.repartition(max(1, manifest.count())).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_file_rows(docs: DataFrame, vocab: str = "byte_bpe_50k.json", end_id: int = 0) -> DataFrame:
    """Writes the files of docs into the shared folder, and returns what they hold."""
    folder = scratch_path(docs.sparkSession, "token-files")
    return read_token_files(write_token_files(docs, folder, vocab, end_id), folder)
