"""Minimax contiguous partition of a corpus into shards.

Texts that are equal form a group that is never cut. Groups stand in the order of their texts'
SHA-256; a shard is a run of them. The smallest capacity is searched by bisection: with a capacity,
shards are filled greedily, each as far as it goes, and the capacity is feasible if no more shards
are needed than there are. A group above the capacity is a shard of its own, so that one huge group
of copies does not decide how the others are dealt.

Spark sums the sizes up along the order. The search looks at cells of these sums, of which the driver
has the first, the last and the count, ``CELLS`` a round: a cell of more than two sums bounds a cut
from both sides. Each round bisects with either bound, then cuts the cells between them finer, until
both bounds agree; so the driver holds a bounded number of sums and the result is exact.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, stored

CELLS = 1 << 14
OVERHEAD = 16


class Cells:
    """Cells of ascending sums: ``(first, last, count)``."""

    def __init__(self, cells: list[tuple[int, int, int]]):
        self.cells = sorted(cells)
        self.firsts = [c[0] for c in self.cells]
        self.total = self.cells[-1][1]

    def around(self, x: int) -> tuple[int, int]:
        """First and last of the cell that ``x`` lies in."""
        return self.cells[max(0, bisect_right(self.firsts, x) - 1)][:2]

    def floor(self, x: int) -> tuple[int, int]:
        """Bounds of the largest sum up to ``x``, 0 if there is none."""
        i = bisect_right(self.firsts, x) - 1
        if i < 0:
            return 0, 0
        first, last, n = self.cells[i]
        return (last, last) if last <= x else (first, first if n <= 2 else min(x, last))

    def after(self, at: int) -> tuple[int, int]:
        """Bounds of the smallest sum above ``at``."""
        i = bisect_right(self.firsts, at)
        if i and at < self.cells[i - 1][1]:
            last, n = self.cells[i - 1][1:]
            return (last if n <= 2 else at), last
        return (self.firsts[i],) * 2 if i < len(self.firsts) else (self.total,) * 2

    def path(self, capacity: int, shards: int, bound: int) -> list[int]:
        """Ends of the greedy shards, by the lower (0) or the upper bound (1)."""
        out, at = [], 0
        for _ in range(shards):
            at = max(self.floor(at + capacity)[bound], self.after(at)[bound])
            out.append(at)
        return out

    def least(self, shards: int, bound: int) -> int:
        """The smallest capacity with which greedy shards hold everything."""
        low, high = 1, self.total
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if self.path(mid, shards, bound)[-1] >= self.total else (mid + 1, high)
        return low


def _cells(sums: DataFrame, windows: list[tuple[int, int]], width: int) -> list[tuple[int, int, int]]:
    """Cells of so many bytes of the sums in ``windows`` (bounds included)."""
    end, base, place = F.col("end"), 0, []
    for low, high in windows:
        place.append(F.when(end.between(low, high), F.floor((end - low) / F.lit(width)).cast("long") + base))
        base += (high - low) // width + 1
    found = sums.select(end, F.coalesce(*place).alias("cell")).where("cell is not null")
    return [tuple(r) for r in found.groupBy("cell").agg(F.min("end"), F.max("end"), F.count("*")).drop("cell").collect()]


def minimax_cuts(sums: DataFrame, total: int, shards: int) -> list[int]:
    """Ends of at most ``shards`` shards of the smallest capacity, from ascending ``sums(end)``."""
    width = max(1, total // CELLS)
    cells = Cells(_cells(sums, [(1, total)], width))
    while True:
        low, high = cells.least(shards, 1), cells.least(shards, 0)
        least, most = cells.path(low, shards, 0), cells.path(high, shards, 1)
        if low == high and least == most:
            return sorted(set(least))
        windows: list[list[int]] = []
        for a, b in sorted((min(pair), max(pair)) for pair in zip(least, most)):
            a, b = cells.around(a)[0], cells.around(b)[1]  # whole cells
            if windows and a <= windows[-1][1] + 1:
                windows[-1][1] = max(windows[-1][1], b)
            else:
                windows.append([a, b])
        width = max(1, min(width // 4, sum(b - a + 1 for a, b in windows) // CELLS))
        rest = [c for c in cells.cells if not any(a <= c[0] <= b for a, b in windows)]
        cells = Cells(rest + _cells(sums, [(a, b) for a, b in windows], width))


def _halved(sums: DataFrame, cuts: list[int], shards: int) -> list[int]:
    """More cuts while there are fewer shards than wanted: the largest that can be cut, near their middle."""
    single: set[int] = set()
    while len(cuts) < shards:
        spans = sorted(((b - a, a, b) for a, b in zip([0, *cuts], cuts) if b not in single), reverse=True)[: shards - len(cuts)]
        if not spans:
            break
        end = F.col("end")
        near = [f(F.when((end > a) & (end < b) & side, end)) for _, a, b in spans for f, side in ((F.max, end <= (a + b) // 2), (F.min, end > (a + b) // 2))]
        found = sums.agg(*[x.alias(str(i)) for i, x in enumerate(near)]).first()
        for k, (_, a, b) in enumerate(spans):
            at = [x for x in found[2 * k: 2 * k + 2] if x is not None]
            if at:
                cuts = sorted([*cuts, min(at, key=lambda x: abs(2 * x - a - b))])
            else:
                single.add(b)
    return cuts


def shard(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, size, text_crc32, shard, slot`` of every document; the law is ``bytes``.

    ``size`` is the UTF-8 bytes of the text and ``OVERHEAD`` more. The largest shard is as small as
    runs of whole groups allow. Slots count a shard's documents from 0. Null text is empty text, and
    of one group with it; its CRC is 0. Rows with null or repeated ids are documents like others;
    other columns, of any name, are ignored. Fewer groups than shards leave the last shards without
    documents. Empty in, empty out.
    """
    if shards < 1:
        raise ValueError("one shard at least")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = stored(docs.select(F.col(id_col).alias("doc"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"),
                              F.sha2(text.cast("binary"), 256).alias("key"), F.monotonically_increasing_id().alias("row")), "sized")
    block = F.substring("key", 1, 3)  # 4096 of them, ascending with the keys
    inside = F.sum("size").over(Window.partitionBy("block").orderBy("key"))
    groups = stored(rows.groupBy("key").agg(F.sum("size").alias("size")).withColumn("block", block).select("block", "key", inside.alias("inside")), "groups")
    totals = groups.groupBy("block").agg(F.max("inside").alias("bytes"))
    before = totals.select("block", (F.sum("bytes").over(Window.orderBy("block")) - F.col("bytes")).alias("before"))  # 4096 rows at most
    sums = groups.join(F.broadcast(before), "block").select("key", (F.col("before") + F.col("inside")).alias("end"))
    total = sums.agg(F.max("end")).first()[0]
    keys: list[str] = []
    if total:
        cuts = _halved(sums, minimax_cuts(sums, total, shards), shards)
        keys = sorted(r.key for r in sums.where(F.col("end").isin(cuts[:-1])).collect())
    discard(groups)
    at = F.size(F.filter(F.array(*map(F.lit, keys)), lambda k: k < F.col("key"))) if keys else F.lit(0)
    return _slots(rows.select("doc", "size", "crc", "row", at.cast("int").alias("shard"))).select(
        F.col("doc").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", "slot")


def _slots(rows: DataFrame) -> DataFrame:
    """``slot``: a number for each row of a shard in the order of the ids, without gaps. Ranges of
    shard, id and row are numbered each by itself, so that a large shard is not numbered by one task."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = stored(rows.repartitionByRange(parts, "shard", "doc", "row").withColumn("part", F.spark_partition_id()), "ranges")
    counts = rows.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = counts.select("shard", "part", (F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("before"))
    numbered = rows.withColumn("inside", F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc", "row")))
    return numbered.join(before, ["shard", "part"]).withColumn("slot", F.col("before") + F.col("inside") - 1)


def op12_minimax_shards(spark, sf_dir):
    out = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"), 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: CRC-32 by the table of its reflected polynomial; groups in the order of their digests.
OP12_SQL = """
with recursive bits as (select i::bigint as i, i::bigint as v, 0 as b from range(256) r(i) union all
  select i, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end, b + 1 from bits where b < 8),
crc as materialized (select list(v order by i) as t from bits where b = 8),
d as materialized (select doc_id, coalesce(text, '') as text, (strlen(coalesce(text, '')) + 16)::bigint as size from documents),
hexed as materialized (select text, hex(encode(text)) as h from (select distinct text from d)),
sums as materialized (select text, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(0, strlen(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::bigint)),
  lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) as crc from hexed, crc),
g as materialized (select row_number() over (order by sha256(text)) as i, text, sum(size)::bigint as size from d group by text),
runs as materialized (select list({c: 1::bigint, s: size} order by i) as sizes, sum(size)::bigint as total from g),
search as (select 1::bigint as low, total as high from runs union all
  select case when fits then low else mid + 1 end, case when fits then mid else high end
  from (select low, high, mid, list_reduce(sizes, lambda a, b: case when a.s + b.s <= mid then {c: a.c, s: a.s + b.s} else {c: a.c + 1, s: b.s} end).c <= 40 as fits
        from (select low, high, (low + high) // 2 as mid from search where low < high), runs)),
least as materialized (select min(low) as c from search where low = high),
filled as (select i, size as s, 0 as shard from g where i = 1 union all
  select g.i, case when s + size <= c then s + size else size end, case when s + size <= c then shard else shard + 1 end from filled join g on g.i = filled.i + 1, least)
select doc_id, d.size, crc as text_crc32, 'bytes' as law, shard::int as shard, row_number() over (partition by shard order by doc_id) - 1 as slot, null::int as grown_shard
from d join sums using (text) join g using (text) join filled using (i)
"""
