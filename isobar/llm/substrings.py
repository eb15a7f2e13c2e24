"""Removal of repeated passages with a logarithmic family of sparse suffix arrays.

Every window of 200 bytes picks one of its 40-byte grams, the one with the least hash, the first
of equals: its anchor. Equal windows pick the same anchor, so only suffixes that start at anchors
need to be indexed, about one in 80 bytes. A batch's suffix array holds the suffixes in the order
of their first 40 bytes, which are stored as they are; suffixes that agree in these are one row,
with how many there are and the least and the greatest hash of the text around them (all windows
that picked the anchor), so a passage that very many documents share is one row; the table of
suffixes tells the places of each. A new batch is merge-scanned against each level of the index, which yields the
suffixes that occur more than once and whether their surroundings differ; then it becomes a level,
and while two levels have the same size they merge into one of twice that. Levels are tables
bucketed and sorted by the leading bytes, so scans and merges read them in order without a shuffle.

The texts are cut into suffixes once and written in ``SHARES`` shares, dealt by a hash of their places;
a batch is some of the shares. There are four batches, and one more each time that the suffixes are four
times as many as ``FEW``, so that jobs grow with the logarithm of the text.

Suffixes that the scans found are looked up by a join. One whose whole surroundings occur twice has
all its windows removed. Where the same suffix has different surroundings, one text of each is
fetched, and these are compared window by window; suffixes with very many different surroundings
are compared as rows instead.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import delete, discard, flat_bytes, kept, mix, scratch_dir, stored

WINDOW, GRAM = 200, 40
CHUNK, PLACE = 1 << 19, np.uint64((1 << 20) - 1)
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
HEAVY = 4000
SHARES, FEW = 16, 1 << 16


@lru_cache(1)
def _powers() -> list[tuple[np.ndarray, np.ndarray]]:
    """Powers of both bases and of their inverses, modulo 2**64."""
    out = []
    for base in BASES:
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(CHUNK * 2 + 1, b, np.uint64)
            p[0] = 1
            both.append(np.cumprod(p))
        out.append(tuple(both))
    return out


def _sums(body: np.ndarray, base: int) -> np.ndarray:
    out = np.zeros(len(body) + 1, np.uint64)
    np.cumsum((body.astype(np.uint64) + np.uint64(1)) * _powers()[base][0][: len(body)], out=out[1:])
    return out


def _hashes(sums: np.ndarray, base: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return (sums[end] - sums[start]) * _powers()[base][1][start]


def anchors(body: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor, of the texts that lie end to end in ``body``.

    Returns first window, number of windows, place of the anchor, and hash of all bytes of the
    run's windows (with the anchor's place among them).
    """
    n = len(body)
    if n < WINDOW:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64)
    inverse = _powers()[0][1]
    sums = _sums(body, 0)
    h = mix((sums[GRAM:] - sums[:-GRAM]) * inverse[: n - GRAM + 1])
    least = h & ~PLACE | np.arange(len(h), dtype=np.uint64)
    size, width = 1, WINDOW - GRAM + 1
    while size * 2 <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    count = n - WINDOW + 1
    at = (np.minimum(least[:count], least[width - size: width - size + count]) & PLACE).astype(np.int64)
    steps = np.zeros(count + 1, np.int32)
    long = np.flatnonzero(np.diff(bounds) >= WINDOW)
    np.add.at(steps, bounds[long], 1)
    np.add.at(steps, np.minimum(bounds[long + 1] - WINDOW + 1, count), -1)
    inside = np.cumsum(steps[:-1]) > 0
    edge = np.ones(count + 1, bool)
    edge[1:-1] = (at[1:] != at[:-1]) | (inside[1:] != inside[:-1])
    cuts = np.flatnonzero(edge)
    first, after = cuts[:-1], cuts[1:]
    keep = inside[first]
    first, after = first[keep], after[keep]
    seg = _hashes(_sums(body, 1), 1, first, after - 1 + WINDOW)
    place = (at[first] - first).astype(np.uint64) << np.uint64(32) | (after - first).astype(np.uint64)
    return first, after - first, at[first], mix(seg ^ mix(place))


def _chunks(bounds: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Texts ``a`` to ``b`` with the byte range to look at; very long texts come in several
    ranges that overlap by all but one byte of a window."""
    a = 0
    while a < len(bounds) - 1:
        if bounds[a + 1] - bounds[a] > CHUNK:
            for at in range(int(bounds[a]), int(bounds[a + 1]) - WINDOW + 1, CHUNK):
                yield a, a + 1, at, min(at + CHUNK + WINDOW - 1, int(bounds[a + 1]))
            a += 1
            continue
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + CHUNK, "right")) - 1)
        yield a, b, int(bounds[a]), int(bounds[b])
        a = b


def _signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def _leading(part: np.ndarray, at: np.ndarray) -> pa.Array:
    """The first ``GRAM`` bytes of the suffixes of ``part`` that start at ``at``."""
    data = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(part, GRAM)[at])
    offsets = np.arange(0, GRAM * len(at) + 1, GRAM, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def suffixes(docs: DataFrame) -> DataFrame:
    """``id, rk, first, windows, suffix, seg`` of the anchors in ``docs(id, rk, text)``: the first
    window and how many have the anchor, the bytes that lead its suffix, and the hash of the text
    around it."""
    schema = T.StructType([docs.schema["id"], docs.schema["rk"]] + [T.StructField(n, t) for n, t in (
        ("first", T.LongType()), ("windows", T.LongType()), ("suffix", T.BinaryType()), ("seg", T.LongType()))])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("suffixes", lambda: None)
        for b in batches:
            body, bounds = flat_bytes(b.column(2))
            for low_doc, high_doc, low, high in _chunks(bounds):
                part = body[low:high]
                first, count, at, seg = anchors(part, np.clip(bounds[low_doc: high_doc + 1], low, high) - low)
                if not len(first):
                    continue
                doc = np.searchsorted(bounds[low_doc: high_doc + 1], first + low, "right") - 1 + low_doc
                which = pa.array(doc)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(which), b.column(1).take(which), pa.array(first + low - bounds[doc]), pa.array(count),
                     _leading(part, at), _signed(seg)], names=schema.names)

    return docs.select("id", "rk", F.encode("text", "utf-8").alias("text")).mapInArrow(of, schema)


def _key() -> F.Column:
    """Hash of a suffix's leading bytes."""
    return F.xxhash64("suffix").alias("key")


def suffix_array(rows: DataFrame) -> DataFrame:
    """``(suffix, lo, hi, n)`` of :func:`suffixes`, one row for equal leading bytes; ``hi`` is null
    where it equals ``lo``."""
    return rows.groupBy("suffix").agg(
        F.min("seg").alias("lo"), F.max("seg").alias("hi"), F.count("*").alias("n")).withColumn("hi", F.expr("nullif(hi, lo)"))


class SuffixIndex:
    """Levels of suffix arrays; :meth:`add` scans a batch against all of them and takes it in.
    The levels' tables are dropped when the ``with`` block ends, however it ends."""

    def __init__(self, spark):
        self.spark, self.levels = spark, []  # (batches, table), larger before smaller
        self.merges = 0
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def __enter__(self):
        return self

    def __exit__(self, *failure) -> None:
        for _, name in self.levels:
            self._drop(name)
        self.levels = []

    def _level(self, size: int, rows: DataFrame) -> DataFrame:
        name = f"isobar_suffixes_{uuid.uuid4().hex}"
        self.levels.append((size, name))
        rows.write.option("compression", "zstd").option("path", self._path(name)).bucketBy(self.buckets, "suffix").sortBy("suffix").saveAsTable(name)
        return self.spark.table(name)

    def _path(self, name: str) -> str:
        """In the folder that all machines share, wherever the warehouse is."""
        return f"{scratch_dir(self.spark)}/isobar/{name}"

    def _drop(self, name: str) -> None:
        self.spark.sql(f"drop table if exists {name}")
        delete(self.spark, self._path(name))

    def _merge_equal(self) -> None:
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (size, x), (_, y) = self.levels[-2:]
            a, b = self.spark.table(x).alias("a"), self.spark.table(y).alias("b")
            lo = F.least("a.lo", "b.lo")
            hi = F.greatest("a.lo", "a.hi", "b.lo", "b.hi")
            both = a.join(b, F.col("a.suffix") == F.col("b.suffix"), "full_outer").select(
                F.coalesce("a.suffix", "b.suffix").alias("suffix"), lo.alias("lo"), F.nullif(hi, lo).alias("hi"), (F.coalesce("a.n", F.lit(0)) + F.coalesce("b.n", F.lit(0))).alias("n"))
            self._level(2 * size, both)
            self.merges += 1
            for name in (x, y):
                self._drop(name)
            self.levels = [level for level in self.levels if level[1] not in (x, y)]

    def add(self, rows: DataFrame) -> DataFrame:
        """Take in a batch of :func:`suffixes`. Returns ``(key, mixed)``: hashes of the
        batch's suffixes that occur again in it or in a level, and whether their surroundings differ."""
        older = [self.spark.table(name).select("suffix", F.col("lo").alias("lo2"), F.col("hi").alias("hi2")) for _, name in self.levels]
        batch = self._level(1, suffix_array(rows))
        hits = batch.where("n > 1").select(_key(), F.col("hi").isNotNull().alias("mixed"))
        for level in older:
            differ = F.col("hi").isNotNull() | F.col("hi2").isNotNull() | (F.col("lo") != F.col("lo2"))
            hits = hits.unionByName(batch.join(level, "suffix").select(_key(), differ.alias("mixed")))
        hits = stored(hits, "hits")
        self._merge_equal()
        return hits


def shared_out(rows: DataFrame) -> DataFrame:
    """:func:`suffixes`, written in shares."""
    return stored(rows.withColumn("share", F.pmod(F.xxhash64("id", "rk", "first"), F.lit(SHARES)).cast("int")), "suffixes", "share")


def batches(rows: DataFrame) -> list[DataFrame]:
    """Batches of a table of :func:`shared_out`; each reads the folders of its shares alone."""
    n, count = rows.count(), 4
    while count < SHARES and n >= FEW << 2 * (count - 3):
        count += 1
    return [rows.where(F.col("share").isin(list(range(k, SHARES, count)))) for k in range(count)]


def recurring(rows: DataFrame) -> DataFrame:
    """``(key, mixed)`` of the suffixes in a table of :func:`shared_out` that occur more than once, by
    an index that takes in one batch after the other."""
    with SuffixIndex(rows.sparkSession) as index:
        found = [index.add(batch) for batch in batches(rows)]
        out = stored(reduce(DataFrame.unionByName, found).groupBy("key").agg(F.max("mixed").alias("mixed")), "recurring")
    for hits in found:
        discard(hits)
    return out


def _bodies(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``key, seg, body``: the text around the anchors in ``wanted(key, seg, at)``, where ``at``
    tells the document, the first window and their number."""
    lists = wanted.groupBy(F.col("at.id").alias("id2"), F.col("at.rk").alias("rk2")).agg(
        F.collect_list(F.struct("key", "seg", F.col("at.first").alias("first"), F.col("at.windows").alias("windows"))).alias("places"))
    rows = docs.join(lists, F.col("id").eqNullSafe(F.col("id2")) & (F.col("rk") == F.col("rk2"))).select(
        F.encode("text", "utf-8").alias("text"), "places")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                raw, places = b.column(0)[i].as_py(), b.column(1)[i].values
                key, seg, first, windows = (places.field(c) for c in ("key", "seg", "first", "windows"))
                body = [raw[a: a + n + WINDOW - 1] for a, n in zip(first.to_pylist(), windows.to_pylist())]
                yield pa.RecordBatch.from_arrays([key, seg, pa.array(body, pa.binary())], names=["key", "seg", "body"])

    found = rows.mapInArrow(of, "key long, seg long, body binary")
    return found.groupBy("key", "seg").agg(F.first("body").alias("body"))  # rows may be equal


def _runs(flags: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of set flags that stay within one owner."""
    edge = np.ones(len(flags) + 1, bool)
    edge[1:-1] = (flags[1:] != flags[:-1]) | (owner[1:] != owner[:-1])
    cuts = np.flatnonzero(edge)
    keep = flags[cuts[:-1]] if len(flags) else np.zeros(0, bool)
    return cuts[:-1][keep], cuts[1:][keep]


def _windows(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Owner and hash of every window of ``bodies``."""
    hashes, owners = [], []
    at = 0
    while at < len(bodies):
        end, size = at, 0
        while end < len(bodies) and (end == at or size + len(bodies[end]) <= CHUNK):
            size += len(bodies[end])
            end += 1
        part = np.frombuffer(b"".join(bodies[at:end]), np.uint8)
        sizes = np.array([len(x) for x in bodies[at:end]])
        counts = sizes - WINDOW + 1
        owner = np.repeat(np.arange(at, end), counts)
        ends = np.cumsum(counts)
        start = np.arange(ends[-1]) - np.repeat(ends - counts, counts) + np.repeat(np.cumsum(sizes) - sizes, counts)
        hashes.append(mix(_hashes(_sums(part, 1), 1, start, start + WINDOW)))
        owners.append(owner)
        at = end
    return np.concatenate(owners), np.concatenate(hashes)


def _light(surroundings: DataFrame) -> DataFrame:
    """``key, seg, from, to``: runs of windows that recur in another of the gram's surroundings."""
    def compared(keys: list, segs: list, bodies: list) -> pa.RecordBatch:
        owner, h = _windows(bodies)
        names = np.unique(np.array(keys, np.int64), return_inverse=True)[1].astype(np.uint64)
        full = h ^ mix(names + np.uint64(1))[owner]
        order = np.argsort(full, kind="stable")
        same = full[order][1:] == full[order][:-1]
        twice = np.zeros(len(full), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        begin = np.searchsorted(owner, np.arange(len(bodies)))
        a, b = _runs(twice, owner)
        own = owner[a]
        return pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.int64)[own]), pa.array(np.array(segs, np.int64)[own]),
                                           pa.array(a - begin[own]), pa.array(b - begin[own])], names=["key", "seg", "from", "to"])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, segs, bodies, size = [], [], [], 0
        for b in batches:
            for key, seg, body in zip(*(c.to_pylist() for c in b.columns)):
                if size > CHUNK and key != keys[-1]:
                    yield compared(keys, segs, bodies)
                    keys, segs, bodies, size = [], [], [], 0
                keys.append(key)
                segs.append(seg)
                bodies.append(body)
                size += len(body)
        if keys:
            yield compared(keys, segs, bodies)

    return surroundings.repartition("key").sortWithinPartitions("key").mapInArrow(of, "key long, seg long, from long, to long")


def _heavy(surroundings: DataFrame) -> DataFrame:
    """As :func:`_light`, every window a row: no gram gathers in one task."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                own = b.slice(at, 1024)
                owner, h = _windows(own.column(2).to_pylist())
                begin = np.searchsorted(owner, np.arange(own.num_rows))
                which = pa.array(owner)
                yield pa.RecordBatch.from_arrays([own.column(0).take(which), own.column(1).take(which), pa.array(np.arange(len(owner)) - begin[owner]), _signed(h)],
                                                 names=["key", "seg", "at", "h"])

    rows = surroundings.mapInArrow(of, "key long, seg long, at long, h long")
    twice = rows.groupBy("key", "h").agg(F.count("*").alias("n")).where("n > 1")
    return rows.join(twice, ["key", "h"], "left_semi").select("key", "seg", F.col("at").alias("from"), (F.col("at") + 1).alias("to"))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """``id, rk, spans``: byte ranges of ``docs(id, rk, text)`` covered by a 200-byte string that
    also starts elsewhere, as (start, end), perhaps overlapping. Texts without any are absent."""
    rows = shared_out(suffixes(docs))
    hits = recurring(rows)
    found = stored(rows.select("id", "rk", "first", "windows", _key(), "seg").join(hits, "key"), "found")
    discard(rows)
    discard(hits)
    counted = found.groupBy("key", "seg").agg(F.count("*").alias("n"))
    wanted = stored(found.where("mixed").groupBy("key", "seg").agg(F.min(F.struct("rk", "first", "windows", "id")).alias("at")), "wanted")
    kinds = wanted.groupBy("key").agg(F.count("*").alias("kinds"))
    own = stored(_bodies(docs, wanted).join(kinds, "key"), "surroundings")
    light = _light(own.where(f"kinds <= {HEAVY}").select("key", "seg", "body"))
    heavy = _heavy(own.where(f"kinds > {HEAVY}").select("key", "seg", "body"))
    runs = light.unionByName(heavy).groupBy("key", "seg").agg(F.collect_list(F.struct("from", "to")).alias("runs"))
    known = stored(counted.join(runs, ["key", "seg"], "left").where("n > 1 or runs is not null"), "known")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("from"), F.col("windows").alias("to")))
    spans = found.join(known, ["key", "seg"]).select(
        "id", "rk", "first", F.explode(F.when(F.col("n") > 1, whole).otherwise(F.col("runs"))).alias("run"))
    spans = spans.select("id", "rk", F.struct((F.col("first") + F.col("run.from")).alias("start"),
                                              (F.col("first") + F.col("run.to") + WINDOW - 1).alias("end")).alias("span"))
    out = stored(spans.groupBy("id", "rk").agg(F.collect_set("span").alias("spans")), "spans")
    for table in (found, wanted, own, known):
        discard(table)
    return out


def _merge(spans: list[dict]) -> list[tuple[int, int]]:
    """Maximal runs of overlapping or touching spans, in order."""
    out: list[tuple[int, int]] = []
    for start, end in sorted((s["start"], s["end"]) for s in spans):
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], end)
        else:
            out.append((start, end))
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """``docs`` without the bytes that repeat: the columns of ``docs`` with the remaining text,
    and ``n_bytes, n_removed, n_spans, kept``, the latter the remaining bytes (with ``digest``
    their SHA-256 in hexadecimal instead, and of ``docs`` only ``id_col``). Columns of ``docs`` that
    have one of these names are replaced.

    Texts count as UTF-8 bytes, null as empty (and stays null in ``text_col``). Every byte in a
    200-byte string that also starts elsewhere, in the same row or another, is removed; equal rows
    are each other's elsewhere. Where a cut leaves part of a character, the text drops that part;
    ``kept`` does not. Null and repeated ids are rows like others: rows are told apart by id and text.
    """
    made = ("n_bytes", "n_removed", "n_spans", "kept")
    carried = [id_col] if digest else [c for c in docs.columns if c not in made]
    keyed = docs.select(F.struct(*carried).alias("row"), F.col(text_col).alias("text"), F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_rk"))
    spans = repeated_spans(keyed.select(F.col("_id").alias("id"), F.col("_rk").alias("rk"), "text"))
    joined = keyed.join(spans, F.col("_id").eqNullSafe(F.col("id")) & (F.col("_rk") == F.col("rk")), "left").select("row", "text", "spans")
    fields = [T.StructField("row", joined.schema["row"].dataType), *[T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")]]
    fields += [T.StructField("kept", T.StringType())] if digest else [T.StructField("kept", T.BinaryType()), T.StructField("rest", T.StringType())]
    schema = T.StructType(fields)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                numbers, kept, rest = [], [], []
                for text, found in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    raw = (text or "").encode()
                    cuts = _merge(found or [])
                    pieces, end = [], 0
                    for a, b_ in cuts:
                        pieces.append(raw[end:a])
                        end = b_
                    left = b"".join(pieces) + raw[end:]
                    numbers.append((len(raw), len(raw) - len(left), len(cuts)))
                    kept.append(hashlib.sha256(left).hexdigest() if digest else left)
                    rest.append(None if text is None else left.decode("utf-8", "ignore"))
                columns = [part.column(0), *[pa.array(c, pa.int64()) for c in zip(*numbers)], pa.array(kept, pa.string() if digest else pa.binary())]
                yield pa.RecordBatch.from_arrays(columns + ([] if digest else [pa.array(rest, pa.string())]), names=schema.names)

    out = joined.mapInArrow(of, schema)
    own = [F.col("rest").alias(c) if c == text_col and not digest else F.col("row")[c].alias(c) for c in carried]
    return out.select(*own, "n_bytes", "n_removed", "n_spans", "kept")


def op2_suffix_dedup(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove_repeats(docs, digest=True).withColumnRenamed("kept", "kept_sha256")
