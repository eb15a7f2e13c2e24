"""Phrases whose words occur together more often than by chance, named pair by pair.

Texts become blocks of word numbers, one array for a language's texts in a block. A phrase of k words
is a pair of phrases of k - 1 words that overlap in all but two: level by level, each block counts the
pairs of adjacent frequent names it has, one shuffle sums the counts of all blocks and gives a pair that
is frequent its name, and the names go back to the blocks by block, where they take the place of the
pairs for the next level. All of it goes packed: a block sends each shard, a range of the words' or
pairs' hashes, one row with what it has of it in order, pairs as steps between numbers that stand for
them one to one; the shard answers with one row that says which of these are frequent and their ranks
among the shard's, which are names. A frequent word or pair itself is one row, whatever blocks have it.
There is a shard for each ``SHARD`` bytes of text. A pair's name also says what it was made from:
following the left or the right half down gives the frequencies of all beginnings and ends of a phrase,
for its cuts, and the pairs made from a phrase are the longer ones that hold it.

A block has about ``BLOCK`` bytes of text, so the work of a task is bounded; of a pair a shard gets one
count from each block that has it, however often it occurs.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BASE, discard, flat_bytes, mix, stored, text_bytes

BLOCK, PART, BATCH = 16 << 20, 2 << 20, 50_000
SHARD = 32 << 20
LONGEST = 5
#: Ends of pieces; the tab separates words as the space does. Fixed values.
ENDS = bytes.maketrans(b".,;:!?\x0a\x0b\x0c\x0d\x09", b"\n\n\n\n\n\n\n\n\n\n ")
#: Blocks that one partition may have, as bits of a block's number.
BLOCKS_BITS = 8
#: Rows of what a block sends to a shard, of a block, and of its words by language.
LEVEL_ONE = "shard long, items binary, body binary, lang string, n long, block long"
LEVEL = "shard long, block long, items binary, body binary"
#: Rows of the frequent words or pairs of a shard, and of its answers to blocks.
WORDS = "name long, lang string, word string, f long, shard long, block long, reply binary"
PAIRS = "name long, a long, b long, f long, shard long, block long, reply binary"
ZSTD = pa.Codec("zstd")
RAW = 9


def _packed(*arrays: np.ndarray | bytes) -> bytes:
    """Arrays of numbers from 0 on, each byte of them apart, as many bytes as the largest has; bytes as they are."""
    heads, parts = [], []
    for x in arrays:
        if isinstance(x, bytes):
            heads += [len(x), RAW]
            parts.append(x)
            continue
        wide = (int(x.max(initial=0)).bit_length() + 7) // 8
        planes = np.ascontiguousarray(x, "<u8").view(np.uint8).reshape(len(x), 8)
        heads += [len(x), wide]
        parts += [planes[:, k].tobytes() for k in range(wide)]
    raw = b"".join((np.array([len(arrays), *heads], "<i8").tobytes(), *parts))
    return len(raw).to_bytes(8, "little") + ZSTD.compress(raw, asbytes=True)


def _unpacked(cell: pa.Scalar) -> list[np.ndarray]:
    cell = cell.as_buffer()
    raw = np.frombuffer(ZSTD.decompress(cell[8:], int.from_bytes(cell[:8].to_pybytes(), "little")), np.uint8)
    n = int(raw[:8].view("<i8")[0])
    heads, at, out = raw[8: 8 + 16 * n].view("<i8").tolist(), 8 + 16 * n, []
    for m, wide in zip(heads[::2], heads[1::2]):
        if wide == RAW:
            out.append(raw[at: at + m])
            at += m
            continue
        planes = np.zeros((m, 8 if wide > 4 else 4), np.uint8)
        for k in range(wide):
            planes[:, k] = raw[at: at + m]
            at += m
        out.append(planes.reshape(-1).view("<i8" if wide > 4 else "<u4").astype(np.int64))
    return out


def _steps(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=x.dtype.type(0))


class _Mixed:
    """Pairs of numbers below ``names`` one to one as numbers of so many bits, dealt evenly to shards."""

    def __init__(self, names: int, shards: int):
        self.names, self.shards, self.bits = names, shards, max(2, 2 * max(1, names - 1).bit_length())
        if self.bits > 62:
            raise RuntimeError("too many frequent phrases")
        self.mask, self.half = np.uint64((1 << self.bits) - 1), np.uint64((self.bits + 1) // 2)
        self.back = np.uint64(pow(BASE, -1, 1 << 64))

    def mixed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x = a.astype(np.uint64) * np.uint64(self.names) + b.astype(np.uint64)
        for _ in range(2):
            x = x * np.uint64(BASE) & self.mask
            x ^= x >> self.half
        return x

    def pairs(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for _ in range(2):
            x = (x ^ x >> self.half) * self.back & self.mask
        return (x // np.uint64(self.names)).astype(np.int64), (x % np.uint64(self.names)).astype(np.int64)

    def shard(self, x: np.ndarray) -> np.ndarray:
        few = min(self.bits, 32)
        return (x >> np.uint64(self.bits - few)) * np.uint64(self.shards) >> np.uint64(few)


class _Words(dict):
    """Numbers of one language's words, from a list that all languages of a block share."""

    def __init__(self, lang: str, shared: list):
        super().__init__({b"\n": -1, b"": -2})
        self.lang, self.shared = lang, shared

    def __missing__(self, word: bytes) -> int:
        self[word] = place = len(self.shared)
        self.shared.append((self.lang, word))
        return place


def _numbered(batches: Iterator[pa.RecordBatch], shards: int = 1) -> Iterator[pa.RecordBatch]:
    """Blocks of word numbers, -1 between pieces, and the words of each block."""
    first, made = TaskContext.get().partitionId() << BLOCKS_BITS, 0
    words: dict[str, _Words] = {}
    shared: list[tuple[str, bytes]] = []
    arrays: list[np.ndarray] = []
    size = 0

    def block() -> Iterator[pa.RecordBatch]:
        nonlocal words, shared, arrays, size, made
        if made >> BLOCKS_BITS:
            raise RuntimeError("a partition has too many blocks")
        numbers = np.concatenate(arrays)
        out = _rows(first + made, numbers, shared, shards)
        words, shared, arrays, size, made = {}, [], [], 0, made + 1
        yield out

    def take(lang: str, texts: list[bytes]) -> None:
        own = words.get(lang)
        if own is None:
            own = words[lang] = _Words(lang, shared)
        body = b"\n".join(texts).lower().translate(ENDS).replace(b"\n", b" \n ") + b" \n"
        numbers = np.fromiter(map(own.__getitem__, body.split(b" ")), np.int32)
        arrays.append(numbers[numbers != -2])

    for b in batches:
        held: dict[str, list[bytes]] = {}
        waiting = 0
        for lang, text in zip(b.column(0).to_pylist(), text_bytes(b.column(1))):
            held.setdefault(lang, []).append(text)
            waiting += len(text)
            size += len(text)
            if waiting >= PART or size >= BLOCK:
                for key, texts in held.items():
                    take(key, texts)
                held, waiting = {}, 0
                if size >= BLOCK:
                    yield from block()
        for key, texts in held.items():
            take(key, texts)
    if arrays:
        yield from block()


def _rows(block: int, body: np.ndarray, shared: list, shards: int) -> pa.RecordBatch:
    """The words of a block by shard, in the order of word and language, its words by language, and
    its array: how many words each shard has, then their numbers from 1 on, 0 between pieces."""
    langs = sorted({lang for lang, _ in shared})
    place = {lang: i for i, lang in enumerate(langs)}
    starts = [crc32(lang.encode("utf-8", "surrogatepass")) for lang in langs]
    lang = np.fromiter((place[key] for key, _ in shared), np.int64, len(shared))
    hashed = mix(np.fromiter((crc32(word, starts[place[key]]) for key, word in shared), np.uint64, len(shared)))
    shard = ((hashed >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
    table = pa.table([pa.array(shard), pa.array([w for _, w in shared], pa.large_binary()), pa.array(lang)], names=["shard", "word", "lang"])
    order = pc.sort_indices(table, [("shard", "ascending"), ("word", "ascending"), ("lang", "ascending")]).to_numpy()
    number = np.zeros(len(shared) + 1, np.int64)
    number[order] = np.arange(1, len(shared) + 1)
    body = number[body]  # the last one stands for -1
    n = np.bincount(body, minlength=len(shared) + 1)[1:]
    lang, cuts, word = lang[order], np.searchsorted(shard[order], np.arange(shards + 1)), table["word"].combine_chunks().take(pa.array(order))
    data, ends = flat_bytes(word)
    items = []
    for k, (i, j) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
        if j > i:
            own, index = np.unique(lang[i:j], return_inverse=True)
            names = [langs[x].encode("utf-8", "surrogatepass") for x in own.tolist()]
            items.append((k, _packed(n[i:j], index, np.diff(ends[i: j + 1]), data[ends[i]: ends[j]].tobytes(), np.array([len(x) for x in names]), b"".join(names))))
    sums = np.bincount(lang, n, len(langs)).astype(np.int64).tolist()
    rows = [(k, x, None, None, None, block) for k, x in items] + [(None, None, None, x, m, None) for x, m in zip(langs, sums)]
    rows.append((None, None, _packed(np.diff(cuts), body), None, None, block))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary(), pa.string(), pa.int64(), pa.int64()))],
                                      names=["shard", "items", "body", "lang", "n", "block"])


def _numbering(shards: int):
    return lambda batches: _numbered(batches, shards)


def _paired(left: pa.Table, right: pa.Table, dense: bool, names: int, shards: int) -> pa.Table:
    """Of one block, its array and the answers about its words or pairs: the pairs of adjacent frequent
    ones with their counts, a row for each shard, and the array of their places. A ``dense`` array has
    a place for each word, others have the words at which something begins, then its places."""
    sizes, *body = _unpacked(left["body"][0])
    begins = np.cumsum(sizes) - sizes
    if dense:
        at = np.flatnonzero(body[0])
        own = body[0][at] - 1
    else:
        at, own = np.cumsum(body[0]), body[1]
    known = np.full(int(sizes.sum()), -1, np.int64)
    for shard, cell in zip(right["shard"].to_pylist(), right["reply"]):
        place, rank = map(np.cumsum, _unpacked(cell))
        known[begins[shard] + place] = rank * shards + shard
    own = known[own]
    at, own = at[own >= 0], own[own >= 0]
    next_to = np.flatnonzero(at[1:] == at[:-1] + 1)
    mixed = _Mixed(names, shards)
    pairs, where, n = np.unique(mixed.mixed(own[next_to], own[next_to + 1]), return_inverse=True, return_counts=True)
    cuts = np.searchsorted(mixed.shard(pairs), np.arange(shards + 1))  # pairs in order are shards in order
    block = left["block"][0].as_py()
    out: list[tuple] = [(k, block, _packed(_steps(pairs[i:j]), n[i:j]), None) for k, (i, j) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())) if j > i]
    out.append((None, block, None, _packed(np.diff(cuts), _steps(at[next_to]), where)))
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["shard", "block", "items", "body"])


def _pairing(dense: bool, names: int, shards: int):
    none = pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("items", pa.binary()), ("body", pa.binary())]).empty_table()
    return lambda left, right: _paired(left, right, dense, names, shards) if left.num_rows else none


def _answered(table: pa.Table, index: np.ndarray, n: np.ndarray, sizes: list[int], least: int, shards: int, columns) -> pa.Table:
    """Of one shard: rows of what is frequent, with ``columns`` of their places among the distinct ones,
    and for each block which of its own are frequent and their ranks. ``index`` has the place of each
    item, block after block."""
    shard = table["shard"][0].as_py()
    f = np.bincount(index, n).astype(np.int64)  # sums below 2^53 are exact
    good = np.flatnonzero(f >= least)
    rank = np.full(len(f), -1, np.int64)
    rank[good] = np.arange(len(good))
    replies, blocks, begin = [], [], 0
    for block, m in zip(table["block"].to_pylist(), sizes):
        own = rank[index[begin: begin + m]]
        begin += m
        place = np.flatnonzero(own >= 0)
        if len(place):
            replies.append(_packed(_steps(place), _steps(own[place])))
            blocks.append(block)
    few = columns(good)
    top = pa.table({"name": pa.array(np.arange(len(good)) * shards + shard)} | few | {"f": pa.array(f[good])} | {"shard": pa.nulls(len(good), pa.int64()), "block": pa.nulls(len(good), pa.int64()), "reply": pa.nulls(len(good), pa.binary())})
    m = len(blocks)
    rest = pa.table({c: pa.nulls(m, top.schema.field(c).type) for c in ("name", *few, "f")} | {"shard": pa.array([shard] * m, pa.int64()), "block": pa.array(blocks, pa.int64()), "reply": pa.array(replies, pa.binary())})
    return pa.Table.from_batches(pa.concat_tables([top, rest]).to_batches(BATCH), top.schema)


def _words(least: int, shards: int):
    def of(table: pa.Table) -> pa.Table:
        """Of one shard, the words of all blocks: those that are frequent."""
        cells = [_unpacked(cell) for cell in table["items"]]
        named = []
        for *_, lengths, body in cells:
            ends, body = np.cumsum(lengths).tolist(), body.tobytes()
            named.append([body[i:j].decode("utf-8", "surrogatepass") for i, j in zip([0, *ends], ends)])
        langs = sorted(set().union(*named))
        place = {lang: i for i, lang in enumerate(langs)}
        lang = np.concatenate([np.array([place[x] for x in own], np.int64)[c[1]] for own, c in zip(named, cells)])
        n, lengths, data = (np.concatenate([c[k] for c in cells]) for k in (0, 2, 3))
        ends = np.concatenate((np.zeros(1, np.int64), np.cumsum(lengths)))
        words = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(data)]).dictionary_encode()
        order = pc.sort_indices(words.dictionary).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        pairs, index = np.unique(rank[words.indices.to_numpy()] * len(langs) + lang, return_inverse=True)

        def columns(good: np.ndarray) -> dict:
            word = words.dictionary.take(pa.array(order[pairs[good] // len(langs)])).cast(pa.binary()).cast(pa.string())
            return {"lang": pa.array(langs, pa.string()).take(pa.array(pairs[good] % len(langs))), "word": word}
        return _answered(table, index, n, [len(c[0]) for c in cells], least, shards, columns)
    return of


def _summing(least: int, names: int, shards: int):
    def of(table: pa.Table) -> pa.Table:
        """Of one shard, the pairs of all blocks: those that are frequent."""
        cells = [_unpacked(cell) for cell in table["items"]]
        sizes = [len(c[0]) for c in cells]
        pairs, n = np.concatenate([np.cumsum(c[0]) for c in cells]), np.concatenate([c[1] for c in cells])
        del cells
        pairs, index = np.unique(pairs, return_inverse=True)

        def columns(good: np.ndarray) -> dict:
            a, b = _Mixed(names, shards).pairs(pairs[good].astype(np.uint64))
            return {"a": pa.array(a), "b": pa.array(b)}
        return _answered(table, index, n, sizes, least, shards, columns)
    return of


def phrases(docs: DataFrame, least: int = 100, most: int = 2000, covered: int = 100, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of each language's ``most`` first phrases.

    A phrase has 2 to ``LONGEST`` words and occurs ``least`` times or more. A-Z are lower-cased, and
    words are what stands between spaces and tabs in pieces between ``[.,;:!?]`` and line ends. ``a``
    is the phrase's frequency, ``l`` and ``r`` those of its two sides at the cut that scores lowest
    (of equals the first), ``n`` all words of the language, the score floor(1000 a n / (l r)), exact.
    Phrases inside a longer one with ``covered`` per cent of their frequency are left out. Equal scores
    go by ``a``, then by the phrase's bytes. Null languages are ``und``, null texts empty; repeated rows
    count as often as they occur; other columns are ignored. Empty in, empty out.
    """
    source = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    shards = 1 + (source.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // SHARD
    level = stored(source.mapInArrow(_numbering(shards), LEVEL_ONE), "phrases1")
    total = stored(level.where("n is not null").groupBy("lang").agg(F.sum("n").alias("total")), "words")
    items = lambda: level.where("items is not null").select("shard", "block", "items").groupBy("shard")
    hits = [stored(items().applyInArrow(_words(least, shards), WORDS), "hits1")]
    for k in range(2, LONGEST + 1):
        names = 1 + (hits[-1].agg(F.max("name")).first()[0] or 0)
        bodies, replies = level.where("body is not null").select("block", "body"), hits[-1].where("reply is not null").select("shard", "block", "reply")
        following = stored(bodies.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(_pairing(k == 2, names, shards), LEVEL), f"phrases{k}")
        discard(level)
        level = following
        hits.append(stored(items().applyInArrow(_summing(least, names, shards), PAIRS), f"hits{k}"))
    discard(level)
    out = stored(_first(_scored(hits, total, covered), most), "phrases")
    for df in (total, *hits):
        discard(df)
    return out


def _scored(hits: list[DataFrame], total: DataFrame, covered: int) -> DataFrame:
    """Phrases that no longer one covers, with their lowest cut."""
    tables = [h.where("name is not null") for h in hits]
    known = tables[0].select("name", "lang", F.array("word").alias("words"), F.array("f").alias("begins"), F.array("f").alias("ends"))
    out = []
    for k, table in enumerate(tables[1:], 2):
        left = known.select(F.col("name").alias("a"), "lang", F.col("words").alias("first"), "begins")
        right = known.select(F.col("name").alias("b"), F.element_at("words", -1).alias("last"), "ends")
        joined = table.select("name", "a", "b", "f").join(left, "a").join(right, "b")
        known = joined.select("name", "lang", "f", F.concat("first", F.array("last")).alias("words"),
                              F.concat("begins", F.array("f")).alias("begins"), F.concat("ends", F.array("f")).alias("ends"))
        own = known
        if k < len(tables):
            longer = tables[k].select(F.col("a").alias("name"), "f").unionByName(tables[k].select(F.col("b").alias("name"), "f"))
            longer = longer.groupBy("name").agg(F.max("f").alias("longer"))
            own = known.join(longer, "name", "left").where((F.col("longer").isNull()) | (100 * F.col("longer") < covered * F.col("f")))
        out.append(own.select("lang", "f", "words", "begins", "ends", F.lit(k).alias("k")))
    every = out[0]
    for df in out[1:]:
        every = every.unionByName(df)
    every = every.join(total, "lang")
    l, r = F.get("begins", F.col("j") - 1), F.get("ends", F.col("k") - F.col("j") - 1)
    wide = "decimal(19, 0)"
    cuts = every.select("*", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("j")).select("lang", "words", "f", "total", "j", l.alias("l"), r.alias("r"))
    score = F.expr(f"(cast(f as {wide}) * cast(total as {wide}) * 1000) div (cast(l as {wide}) * cast(r as {wide}))")
    low = F.min(F.struct(score.alias("score"), "j", "l", "r")).alias("low")
    return cuts.groupBy("lang", F.array_join("words", " ").alias("phrase"), "f", "total").agg(low).select("lang", "phrase", F.col("f").alias("a"), "low.l", "low.r", F.col("total").alias("n"), "low.score")


def _first(scored: DataFrame, most: int) -> DataFrame:
    """Ranks of a language's phrases: first in parts of each language, so that none is ranked whole by
    one task, then of what is left."""
    parts = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.row_number().over(Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(parts))).orderBy(*order))
    few = scored.withColumn("rank", part).where(F.col("rank") <= most)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    return few.withColumn("rank", rank).where(F.col("rank") <= most).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_phrases(spark, sf_dir):
    return phrases(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP11_SQL = """
with d as (select coalesce(lang, 'und') as lang, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
pieces as (select lang, unnest(string_split_regex(text, '[.,;:!?\\x0A-\\x0D]')) as piece from d),
w as (select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as words from pieces),
grams as (select lang, k, array_to_string(words[i:i + k - 1], ' ') as phrase from (select lang, words, k, unnest(range(1, len(words) - k + 2)) as i from w, range(1, 6) r(k) where len(words) >= k)),
f as (select lang, k, phrase, count(*) as f from grams group by all),
n as (select lang, sum(f)::bigint as n from f where k = 1 group by lang),
c as (select lang, k, phrase, f as a, string_split(phrase, ' ') as words from f where k >= 2 and f >= 100),
inside as (select lang, array_to_string(words[i:i + m - 1], ' ') as phrase, max(a) as longer
  from (select lang, words, a, k, m, unnest(range(1, k - m + 2)) as i from c, range(2, 5) r(m) where m < k) group by all),
kept as (select c.* from c left join inside using (lang, phrase) where longer is null or 100 * longer < 100 * a),
cuts as (select kept.lang, kept.phrase, a, n, j, l.f as l, r.f as r, (1000::hugeint * a * n) // (l.f::hugeint * r.f) as score
  from (select *, unnest(range(1, k)) as j from kept) kept join n using (lang)
  join f l on l.lang = kept.lang and l.k = j and l.phrase = array_to_string(words[1:j], ' ')
  join f r on r.lang = kept.lang and r.k = kept.k - j and r.phrase = array_to_string(words[j + 1:], ' ')),
low as (select lang, phrase, a, n, arg_min({l: l, r: r, score: score}, {s: score, j: j}) as x from cuts group by all),
ranked as (select lang, row_number() over (partition by lang order by x.score desc, a desc, encode(phrase)) as rank, phrase, a, x.l as l, x.r as r, n, x.score::bigint as score from low)
select lang, rank, phrase, a, l, r, n, score from ranked where rank <= 2000
"""
