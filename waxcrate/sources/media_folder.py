"""A folder of media files as a Spark data source: ``spark.read.format("media_folder").option("markers", ".a,.b").load(root)``.

Folders that hold a marker file are pruned while they are listed, the root itself excepted; folders that are links aren't entered. The
folder tree is dealt to tasks by subfolder: the driver lists the top levels only, until there are enough folders. Filters on
extension that can be pushed (=, IN) leave files out before they become rows. Register with ``register(spark)``.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from .collection_files import located

SCHEMA = "path string, size long, extension string"
_ROWS = 10_000


class _Folder(InputPartition):
    """Folders to walk, or (deep false) only the files in them."""

    def __init__(self, path: str, deep: bool):
        super().__init__(0)
        self.path, self.deep = path, deep


class FolderReader(DataSourceReader):
    def __init__(self, options: dict):
        self.uri = options["path"].rstrip("/") or "/"
        self.markers = {x for x in options.get("markers", "").split(",") if x}
        self.least = int(options.get("folders", 64))
        self.extensions: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes filters on extension; the others are left to Spark."""
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is not None and f.attribute == ("extension",):
                self.extensions = values if self.extensions is None else self.extensions & values
            else:
                yield f

    def _listed(self, store: fs.FileSystem, path: str) -> tuple[list[tuple[str, int]], list[str]] | None:
        """Files with sizes and folders in a folder; None if it can't be listed, as a folder may vanish or be closed to us."""
        try:
            if isinstance(store, fs.LocalFileSystem):
                with os.scandir(path) as found:
                    own = list(found)
                files = [(x.path, x.stat(follow_symlinks=False).st_size) for x in own if x.is_file(follow_symlinks=False)]
                return files, [x.path for x in own if x.is_dir(follow_symlinks=False)]
            own = store.get_file_info(fs.FileSelector(path))
            return [(x.path, x.size) for x in own if x.type == fs.FileType.File], [x.path for x in own if x.type == fs.FileType.Directory]
        except OSError:
            return None

    def _marked(self, files: list[tuple[str, int]]) -> bool:
        return bool(self.markers) and any(name.rpartition("/")[2] in self.markers for name, _ in files)

    def partitions(self) -> list[_Folder]:
        store, root = located(self.uri)
        top = self._listed(store, root)
        if top is None:
            raise FileNotFoundError(self.uri)
        done, level = [_Folder(root, False)], top[1]
        while level and len(level) < self.least:  # a level more, as long as the folders are few
            below = []
            for folder in level:
                listed = self._listed(store, folder)
                if listed and not self._marked(listed[0]):
                    done.append(_Folder(folder, False))
                    below += listed[1]
            level = below
        return done + [_Folder(folder, True) for folder in level]

    def read(self, partition: _Folder) -> Iterator[pa.RecordBatch]:
        store, root = located(self.uri)
        waiting, rows = [partition.path], []
        while waiting:
            folder = waiting.pop()
            listed = self._listed(store, folder)
            if listed is None or (folder != root and self._marked(listed[0])):
                continue
            waiting += listed[1] if partition.deep else []
            for path, size in listed[0]:
                stem, dot, extension = path.rpartition("/")[2].rpartition(".")
                extension = extension.lower() if dot and stem else ""
                if self.extensions is None or extension in self.extensions:
                    rows.append((path, size, extension))
            while len(rows) >= _ROWS or (rows and not waiting):
                part, rows = rows[:_ROWS], rows[_ROWS:]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*part, strict=True)], names=["path", "size", "extension"])


class MediaFolder(DataSource):
    """Options: path, markers (file names with commas between them), folders (so many at least are dealt to tasks, if there are). Columns: SCHEMA."""

    @classmethod
    def name(cls) -> str:
        return "media_folder"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FolderReader:
        return FolderReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Registers the source; pushing filters into it needs this setting of the session."""
    spark.dataSource.register(MediaFolder)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
