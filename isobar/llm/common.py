"""Helpers shared by the text operators: scratch tables, links to components, Arrow text access."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_local: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share, from ``spark.checkpoint.dir``.

    A session on one machine that has none, as in tests, gets a temporary folder; on a cluster
    without it this is an error, for no machine's own folder is seen by the others.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is not set")
        app = spark.sparkContext.applicationId
        found = _local.setdefault(app, "file://" + tempfile.mkdtemp(prefix="isobar-"))
    return found.rstrip("/")


def stored(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends there,
    so a lost executor costs a re-read and nothing is computed twice. ``by`` is a column, the last of
    ``df``, of few values whose rows get folders of their own."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/isobar/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.isobar_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`stored`."""
    delete(df.sparkSession, df.isobar_path)


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of ``links(a, b)`` (longs), by alternating large and small stars.

    Returns ``(node, component)`` with the smallest node reachable, for nodes that have a link.
    Each round is two group-by minima (combined map-side) and two equi-joins, so a node with very
    many links never gathers them in one task, and the links never leave the executors.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                   .where("u <> v").distinct(), "links")
    state = _signature(edges)
    for _ in range(most_rounds):
        if not state[0]:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        large = stored(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = (small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
                 .unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        after = stored(small, "small")
        discard(large)
        discard(edges)
        edges, before, state = after, state, _signature(after)
        if state == before:
            break
    else:
        raise RuntimeError("components did not converge")
    return (edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"),
                           F.expr("sum(cast(xxhash64(v, u) as decimal(38, 0)))")).first())


_kept: dict = {}


def kept(key, make):
    """What ``make()`` gave for ``key`` before in this worker. Only the latest key's value is kept,
    so that a worker which goes from one operator to another frees what the former one held."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each value of an Arrow string column; null counts as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = column.cast(kind)
    return [x or b"" for x in column.to_pylist()]


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of an Arrow binary column in one array, and the offsets of its values."""
    wide = column.cast(pa.large_binary())
    if wide.null_count:
        wide = wide.fill_null(b"")
    _, offsets, data = wide.buffers()
    ends = np.frombuffer(offsets, np.int64)[wide.offset: wide.offset + len(wide) + 1]
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[ends[0]: ends[-1]], ends - ends[0]


BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def _powers_to(n: int) -> list[np.ndarray]:
    """Powers of ``BASE`` and of its inverse modulo 2**64, ``n`` at least; the worker keeps them."""
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(20, n.bit_length())
        _powers[:] = [np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size, b, np.uint64)))) for b in (BASE, pow(BASE, -1, 1 << 64))]
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """One to one on 64 bits, every bit in on every bit out."""
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(29)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(32)


def prefix_hashes(body: np.ndarray) -> np.ndarray:
    """Polynomial hashes of all prefixes of ``body``."""
    out = np.zeros(len(body) + 1, np.uint64)
    np.cumsum((body.astype(np.uint64) + np.uint64(1)) * _powers_to(len(body) + 1)[0][: len(body)], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of spans, from the hashes of prefixes: equal spans have equal ones wherever they lie."""
    return mix((sums[end] - sums[start]) * _powers_to(len(sums))[1][start])
