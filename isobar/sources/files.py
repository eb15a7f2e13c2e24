"""Files that tasks write and the driver commits, and ``format("rawfile")`` for contents as they are.

A task writes under a folder of its own attempt and names its files in its message; when all tasks
have ended the driver moves the files of the messages to their places and drops the rest. So an
attempt that is lost or repeated leaves nothing, and a job that fails changes nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType


@dataclass
class Written(WriterCommitMessage):
    """Where a task has put its files, and where they go."""

    files: list[tuple[str, str]]


class StagedWriter(DataSourceWriter):
    """What writers of files share; files of the same place are overwritten. ``prefix`` stands before
    the names of files, for writers that name them by task."""

    def __init__(self, path: str, overwrite: bool = False):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex
        self.prefix = ""

    def _staging(self, path: str) -> str:
        return f"{path}/_temporary-{self.job}"

    def attempt(self) -> tuple[arrow_fs.FileSystem, str]:
        """A store and a folder in it for the files of one attempt of a task."""
        store, path = arrow_fs.FileSystem.from_uri(self.path)
        own = f"{self._staging(path)}/{uuid.uuid4().hex}"
        store.create_dir(own)
        return store, own

    def commit(self, messages: list[Written]) -> None:
        store, path = arrow_fs.FileSystem.from_uri(self.path)
        moves = [m for w in messages if w for m in w.files]
        if len({to for _, to in moves}) < len(moves):
            self.abort(messages)
            raise ValueError("a file is written by two tasks")
        if self.overwrite and store.get_file_info(path).type == arrow_fs.FileType.Directory:
            for f in store.get_file_info(arrow_fs.FileSelector(path)):
                if f.base_name != f"_temporary-{self.job}":
                    (store.delete_dir if f.type == arrow_fs.FileType.Directory else store.delete_file)(f.path)
        for at, to in moves:
            folder, _, base = to.rpartition("/")
            if folder:
                store.create_dir(f"{path}/{folder}")
            store.move(at, f"{path}/{folder + '/' if folder else ''}{self.prefix}{base}")
        self.abort(messages)

    def abort(self, messages: list[Written]) -> None:
        store, path = arrow_fs.FileSystem.from_uri(self.path)
        if store.get_file_info(self._staging(path)).type == arrow_fs.FileType.Directory:
            store.delete_dir(self._staging(path))


class RawWriter(StagedWriter):
    """Rows ``file, content``."""

    def write(self, rows: Iterator[pa.RecordBatch]) -> Written:
        store, own = self.attempt()
        done = []
        for row in rows:
            name = row["file"]
            if name.startswith("/") or ".." in name.split("/"):
                raise ValueError(f"{name} is not in the folder")
            done.append((f"{own}/{len(done)}", name))
            with store.open_output_stream(done[-1][0]) as sink:
                sink.write(row["content"])
        return Written(done)


class RawFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rawfile"

    def schema(self) -> str:
        return "file string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return RawWriter(dict(self.options)["path"], overwrite)


def write_files(files: DataFrame, path: str, mode: str = "append") -> None:
    """``files(file, content)`` as files in the folder ``path``."""
    spark: SparkSession = files.sparkSession
    spark.dataSource.register(RawFiles)
    files.select("file", "content").write.format("rawfile").mode(mode).option("path", path).save()
