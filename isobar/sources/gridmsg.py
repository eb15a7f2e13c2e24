"""``format("gridmsg")``: slabs as files of messages, read and written by Spark as a data source.

A message is a mark, the lengths of its header and of its values, the header (JSON of the slab's
keys), the values, and an end mark. A file ends with an index of its messages, place and keys of
each, so a reader fetches only those that a query's filters leave.

Reading: the driver lists files only; a partition is some files or a range of a large one, and its
task reads the index and then the messages wanted. Filters on keys go to the source
(``spark.sql.python.filterPushdown.enabled``, which :func:`register` sets).
Writing: a task writes files under names of its own attempt; the driver moves them to their places
when all tasks have ended, so a task that is repeated leaves one copy and a failed job none.
Streaming: the driver keeps a log of the files found, an entry for each batch; an offset is the number
of entries, so a batch has the same files after a restart and every file comes once.

Paths are those of Arrow's file systems: local or mounted ones, or URIs of object stores and HDFS.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from datetime import datetime, timezone

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan,
    LessThanOrEqual)
from pyspark.sql.types import StructType

from .files import StagedWriter, Written

#: Marks of messages and of files. Fixed values.
BEGIN, END, INDEX = b"GMSG", b"7777", b"GIDX"
HEAD, TAIL = struct.Struct("<4sIQ"), struct.Struct("<Q4s")
KEYS = ("param", "eps", "ref_time", "lead_s", "k", "target", "tile", "levtype", "begin_min", "end_min", "west", "south", "east", "north", "header", "low", "step")
#: Bytes of files that a partition has, as Spark's own sources do by default.
SPLIT = 128 << 20
SUFFIX = ".gmsg"


def schema(places: Sequence[str] = ("y", "x")) -> str:
    """Of slabs on a grid, or with ``("cell",)`` on cells."""
    points = ", ".join(f"{p}: {'bigint' if p == 'cell' else 'int'}" for p in places)
    return ("param string, eps int, ref_time timestamp, lead_s long, k int, target double, tile long, levtype string, begin_min double, end_min double, "
            "west double, south double, east double, north double, header string, low double, step double, "
            f"points array<struct<{points}, n: bigint>>")


# --- messages ---------------------------------------------------------------------------------

def _micros(at: datetime | None) -> int | None:
    if at is None:
        return None
    at = at.astimezone(timezone.utc) if at.tzinfo else at.replace(tzinfo=timezone.utc)
    return (at - datetime(1970, 1, 1, tzinfo=timezone.utc)) // (datetime.resolution)


def pack(keys: dict, places: list[np.ndarray], n: np.ndarray, present: np.ndarray) -> bytes:
    """One message. ``keys["places"]`` names the arrays of places."""
    head = json.dumps(keys | {"count": len(n)}, sort_keys=True).encode()
    body = zlib.compress(b"".join([*[p.astype("<i8").tobytes() for p in places], n.astype("<i8").tobytes(), np.packbits(present).tobytes()]), 1)
    return HEAD.pack(BEGIN, len(head), len(body)) + head + body + END


def unpack(raw: bytes) -> tuple[dict, list[np.ndarray], np.ndarray, np.ndarray]:
    """Keys, places, numbers and which are there; ValueError for what is no message."""
    mark, head, body = HEAD.unpack_from(raw)
    if mark != BEGIN or raw[-4:] != END or len(raw) != HEAD.size + head + body + 4:
        raise ValueError("no message")
    keys = json.loads(raw[HEAD.size: HEAD.size + head])
    data, count = zlib.decompress(raw[HEAD.size + head: -4]), keys["count"]
    arrays = [np.frombuffer(data, "<i8", count, 8 * count * i) for i in range(len(keys["places"]) + 1)]
    return keys, arrays[:-1], arrays[-1], np.unpackbits(np.frombuffer(data, np.uint8, offset=8 * count * len(arrays)), count=count).astype(bool)


def read_index(file: pa.NativeFile) -> list[dict]:
    """``at, length`` and keys of each message of an open file."""
    size = file.size()
    if not size:
        return []
    file.seek(size - TAIL.size)
    length, mark = TAIL.unpack(file.read(TAIL.size))
    if mark != INDEX:
        raise ValueError("no index at the end of the file")
    file.seek(size - TAIL.size - length)
    return json.loads(zlib.decompress(file.read(length)))


class FileOfMessages:
    """A file as it is written: messages, then their index."""

    def __init__(self, sink: pa.NativeFile):
        self.sink, self.at, self.index = sink, 0, []

    def add(self, keys: dict, message: bytes) -> None:
        self.sink.write(message)
        self.index.append({k: v for k, v in keys.items() if k != "header"} | {"at": self.at, "length": len(message)})
        self.at += len(message)

    def close(self) -> None:
        index = zlib.compress(json.dumps(self.index).encode())
        self.sink.write(index + TAIL.pack(len(index), INDEX))
        self.sink.close()


# --- reading ----------------------------------------------------------------------------------

@dataclass
class Part(InputPartition):
    """Ranges of files: a message is of the range that it begins in."""

    ranges: list[tuple[str, int, int]]


def _value(v):
    return _micros(v) if isinstance(v, datetime) else v


def fits(keys: dict, filters: Sequence[Filter]) -> bool:
    """Whether a message is one that filters leave. A comparison with an absent key fails."""
    for f in filters:
        own = keys.get(f.attribute[0])
        if isinstance(f, (IsNull, IsNotNull)):
            ok = (own is None) == isinstance(f, IsNull)
        elif own is None:
            ok = False
        elif isinstance(f, In):
            ok = own in [_value(v) for v in f.value]
        else:
            want = _value(f.value)
            ok = {EqualTo: own == want, GreaterThan: own > want, GreaterThanOrEqual: own >= want, LessThan: own < want, LessThanOrEqual: own <= want}[type(f)]
        if not ok:
            return False
    return True


def _split(files: Sequence[tuple[str, int]], most: int) -> list[Part]:
    """Files into parts of about ``most`` bytes; larger files are cut."""
    out, held, size = [], [], 0
    for path, length in files:
        for begin in range(0, max(length, 1), most):
            end = min(begin + most, length) if length else 0
            if held and size + end - begin > most:
                out.append(Part(held))
                held, size = [], 0
            held.append((path, begin, end))
            size += end - begin
    return out + [Part(held)] * bool(held)


class _Messages:
    """What readers of tables and of streams share."""

    def __init__(self, options: dict, wanted: StructType):
        self.path = options["path"]
        self.split = int(options.get("split", SPLIT))
        self.schema, self.filters = wanted, []

    def files(self) -> list[tuple[str, int]]:
        store, path = arrow_fs.FileSystem.from_uri(self.path)
        found = store.get_file_info(arrow_fs.FileSelector(path, recursive=True)) if store.get_file_info(path).type == arrow_fs.FileType.Directory else [store.get_file_info(path)]
        if found and found[0].type == arrow_fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        return sorted((f.path, f.size) for f in found if f.type == arrow_fs.FileType.File and not any(p[0] in "._" for p in f.path[len(path):].split("/") if p))

    def batches(self, part: Part) -> Iterator[pa.RecordBatch]:
        """A batch for each message that fits."""
        from pyspark.sql.pandas.types import to_arrow_schema

        store, _ = arrow_fs.FileSystem.from_uri(self.path)
        target = to_arrow_schema(self.schema)
        points = target.field("points").type if "points" in target.names else None
        for path, begin, end in part.ranges:
            with store.open_input_file(path) as file:
                for own in read_index(file):
                    if begin <= own["at"] < end and fits(own, self.filters):
                        file.seek(own["at"])
                        yield self._batch(file.read(own["length"]), target, points)

    def _batch(self, raw: bytes, target: pa.Schema, points: pa.DataType | None) -> pa.RecordBatch:
        keys, places, n, present = unpack(raw)
        columns = []
        for f in target:
            if f.name == "points":
                own = dict(zip(keys["places"], places))
                absent = [c.name for c in points.value_type if c.name not in own and c.name != "n"]
                if absent:
                    raise ValueError(f"a message has no {', '.join(absent)}; its places are {', '.join(keys['places'])}")
                values = [pa.array(n, mask=~present) if c.name == "n" else pa.array(own[c.name]).cast(c.type) for c in points.value_type]
                items = pa.StructArray.from_arrays(values, fields=list(points.value_type))
                columns.append(pa.ListArray.from_arrays(pa.array([0, len(n)], pa.int32()), items).cast(f.type))
            else:
                columns.append(pa.array([keys.get(f.name)], pa.timestamp("us", "UTC") if f.name == "ref_time" else f.type).cast(f.type))
        return pa.RecordBatch.from_arrays(columns, schema=target)


class MessageReader(_Messages, DataSourceReader):
    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if len(f.attribute) == 1 and f.attribute[0] in KEYS and f.attribute[0] != "header" and isinstance(f, (EqualTo, In, IsNull, IsNotNull, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Part]:
        return _split(self.files(), self.split) or [Part([])]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return self.batches(partition)


class MessageStream(_Messages, DataSourceStreamReader):
    """Files in the order in which listings find them. ``log`` is a folder of the query's own."""

    def __init__(self, options: dict, wanted: StructType):
        super().__init__(options, wanted)
        if "log" not in options:
            raise ValueError("a stream of messages has a folder for its log: option log")
        self.log, self.most = options["log"], int(options.get("maxFilesPerTrigger", 1000))

    def _entries(self) -> dict[int, list]:
        store, path = arrow_fs.FileSystem.from_uri(self.log)
        store.create_dir(path)
        found = [f for f in store.get_file_info(arrow_fs.FileSelector(path)) if f.base_name.isdigit()]
        out = {}
        for f in found:
            with store.open_input_stream(f.path) as stream:
                out[int(f.base_name)] = json.loads(stream.read())
        return out

    def _append(self, number: int, files: list) -> None:
        """Written whole under another name, then moved: an entry is there or not."""
        store, path = arrow_fs.FileSystem.from_uri(self.log)
        own = f"{path}/.{uuid.uuid4().hex}"
        with store.open_output_stream(own) as stream:
            stream.write(json.dumps(files).encode())
        store.move(own, f"{path}/{number:012d}")

    def initialOffset(self) -> dict:
        return {"entries": 0}

    def latestOffset(self) -> dict:
        entries = self._entries()
        known = {path for files in entries.values() for path, _ in files}
        new = [f for f in self.files() if f[0] not in known][: self.most]
        last = max(entries, default=0)
        if new:
            self._append(last + 1, new)
        return {"entries": last + bool(new)}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        entries = self._entries()
        files = [tuple(f) for i in range(start["entries"] + 1, end["entries"] + 1) for f in entries[i]]
        return _split(files, self.split)

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return self.batches(partition)

    def commit(self, end: dict) -> None:
        pass


# --- writing ----------------------------------------------------------------------------------

class MessageWriter(StagedWriter):
    """Rows of slabs to files; with a column ``file`` (or whatever the option ``file`` names) its rows
    go to that file in the folder and the frame has to bring them together, else a task writes one."""

    def __init__(self, options: dict, given: StructType, overwrite: bool):
        super().__init__(options["path"], overwrite)
        self.column = options.get("file", "file" if "file" in given.names else None)
        self.prefix = "" if self.column or overwrite else f"{self.job}-"
        kind = given["points"].dataType.elementType
        self.places = [f.name for f in kind.fields if f.name != "n"]
        self.keys = [k for k in KEYS if k in given.names]

    def write(self, rows: Iterator) -> Written:
        from pyspark import TaskContext

        store, own = self.attempt()
        done: list[tuple[str, str]] = []
        seen: set[str] = set()
        name, file = None, None
        for row in rows:
            to = row[self.column] if self.column else f"part-{TaskContext.get().partitionId():06d}{SUFFIX}"
            if to != name:
                if file:
                    file.close()
                if to in seen:
                    raise ValueError(f"rows of {to} are not together")
                seen.add(to)
                name = to
                done.append((f"{own}/{len(done)}", to))
                file = FileOfMessages(store.open_output_stream(done[-1][0]))
            keys = {k: _value(row[k]) for k in self.keys} | {"places": self.places}
            points = row["points"]
            places = [np.fromiter((p[c] for p in points), np.int64, len(points)) for c in self.places]
            present = np.fromiter((p["n"] is not None for p in points), bool, len(points))
            n = np.fromiter((p["n"] or 0 for p in points), np.int64, len(points))
            file.add(keys, pack(keys, places, n, present))
        if file:
            file.close()
        return Written(done)


class MessageSource(DataSource):
    """Options: ``path``; for reading ``split`` (bytes of a partition) and ``places`` (``y,x`` or
    ``cell``); for streams ``log`` and ``maxFilesPerTrigger``; for writing ``file``."""

    @classmethod
    def name(cls) -> str:
        return "gridmsg"

    def schema(self) -> str:
        return schema(self.options.get("places", "y,x").split(","))

    def reader(self, schema: StructType) -> DataSourceReader:
        return MessageReader(dict(self.options), schema)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return MessageStream(dict(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return MessageWriter(dict(self.options), schema, overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to a session and let filters go to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(MessageSource)


def read(spark: SparkSession, path: str, places: str = "y,x", **options) -> DataFrame:
    register(spark)
    return spark.read.format("gridmsg").options(path=path, places=places, **options).load()


def write(slabs: DataFrame, path: str, file: str | None = None, mode: str = "append") -> None:
    """Slabs as files in the folder ``path``; with ``file``, each under the name that column has."""
    register(slabs.sparkSession)
    rows = slabs
    if file:
        rows = slabs.repartition(file).sortWithinPartitions(file)
    writer = rows.write.format("gridmsg").mode(mode).option("path", path)
    (writer.option("file", file) if file else writer).save()


def stream(spark: SparkSession, path: str, log: str, places: str = "y,x", files_per_batch: int = 1000) -> DataFrame:
    """Slabs of the files that come to a folder, each once; ``log`` is a folder for this query alone."""
    register(spark)
    return spark.readStream.format("gridmsg").options(path=path, log=log, places=places, maxFilesPerTrigger=files_per_batch).load()
