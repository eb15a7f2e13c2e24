"""Quality rules with an n-gram language model: modified Kneser-Ney over characters.

The symbols are letters without case (Latin ones without accents, those of other scripts as they are,
by code point modulo ``CLASSES``), and one each for digits, sentence marks, other symbols, white
space and line ends: with finer symbols rare strings look likely to a model of their own text.
4-grams are counted for each language over *all* documents. Texts are dealt into blocks of about
``BLOCK`` bytes where they lie; each block gives the sorted hashes of its 4-grams with their counts,
so what is gathered grows with the text, while the model of a Latin text has 32**4 entries at most.
Spark sums the counts and estimates all orders by group-bys, windows and joins. The model is stored
in shards by ranges of the hash, one for each ``SHARD`` entries, each two arrays: sorted hashes and
log probabilities. A block asks the shards for its own 4-grams, ``ASKING`` blocks a copy of each, and
its texts are scored with the answers; no task or driver holds the whole of a large model, and the
rows that go around are as many as blocks and shards of the model, not their number times the text's.
The texts scored are those counted, so each
4-gram is found and none needs a back-off weight of its own.

A document's perplexity is compared with a band of its own language: the median of all
documents' log perplexities, plus and minus a multiple of their median absolute deviation. The
``LANGUAGES`` languages that most documents have get models of their own, the others share one.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, flat_bytes, mix, prefix_hashes, span_hashes, stored

ORDER, BITS = 4, 13
CLASSES = 1 << BITS
LANGUAGES, OTHER = 1000, "other"
LINE, BLANK, SYMBOL, STOP, DIGIT, FOREIGN = 10, 32, 35, 46, 48, 64
BLOCK, LEVEL = 32 << 20, 9
#: Entries of a shard of the model, and blocks that ask one copy of it.
SHARD, ASKING = 1 << 20, 32
#: Odd multiplier and its inverse modulo 2**64: the hash of an n-gram is one to one.
MULTIPLIER = 0x9E3779B97F4A7C15
INVERSE = pow(MULTIPLIER, -1, 1 << 64)
#: Kind of each byte: 0 white space, 1 later byte of a character, 2 its first, 3 symbol.
BYTES = np.array([0 if b in b" \t\n\v\f\r" else 3 if b in b"#*$%&|<>" else 1 if b & 0xC0 == 0x80 else 2 for b in range(256)], np.uint8)
TABLE = 0x10000


@lru_cache(1)
def _classes() -> np.ndarray:
    """Symbol of each code point below ``TABLE``."""
    out = np.full(TABLE, SYMBOL, np.uint16)
    for cp in range(TABLE):
        c = chr(cp)
        kind = unicodedata.category(c)
        latin = cp < 0x250 or 0x1E00 <= cp < 0x1F00
        base = unicodedata.normalize("NFD", c.lower())[0] if latin else c
        if c.isspace():
            out[cp] = LINE if c == "\n" else BLANK
        elif "a" <= base <= "z":
            out[cp] = ord(base)
        elif c.isdigit():
            out[cp] = DIGIT
        elif c in ".,;:!?'\"()-" or (not latin and kind in ("Po", "Pd", "Ps", "Pe", "Pi", "Pf")):
            out[cp] = STOP
        elif kind[0] in "LM":
            out[cp] = FOREIGN if latin else ord(c.lower()[0]) % CLASSES
    return out


def fold(text: str) -> np.ndarray:
    """Symbols of ``text``."""
    return _folded(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32))


def _folded(cps: np.ndarray) -> np.ndarray:
    low = cps < TABLE
    out = (cps % CLASSES).astype(np.uint16)
    out[low] = _classes()[cps[low]]
    return out


def chunks(column: pa.Array, most: int = 2 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Whole texts of an Arrow column, about ``most`` bytes at a time: first text, the one after
    the last, all their bytes, and the bounds of each text among these."""
    body, bounds = flat_bytes(column)
    a = 0
    while a < len(bounds) - 1:
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + most, "right")) - 1)
        yield a, b, body[bounds[a]: bounds[b]], bounds[a: b + 1] - bounds[a]
        a = b


def grams(body: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 4-gram that ends at each character of the texts, and how many characters each text has;
    what precedes a text counts as line ends."""
    firsts = np.concatenate(([0], np.cumsum((body & 0xC0) != 0x80)))
    sizes = np.diff(firsts[bounds])
    text = body.tobytes().decode("utf-8", "replace")
    if len(text) != sizes.sum():  # bytes that are not UTF-8
        parts = [body[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(bounds[:-1], bounds[1:])]
        text, sizes = "".join(parts), np.array([len(x) for x in parts])
    classes = _folded(np.frombuffer(text.encode("utf-32-le"), np.uint32))
    place = np.arange(len(classes)) + (ORDER - 1) * np.repeat(np.arange(1, len(sizes) + 1), sizes)
    c = np.full(len(classes) + (ORDER - 1) * (len(sizes) + 1), LINE, np.uint64)
    c[place] = classes
    out = c[place - ORDER + 1]
    for i in range(ORDER - 2, -1, -1):
        out = out << np.uint64(BITS) | c[place - i]
    return out, sizes


def languages(docs: DataFrame, lang_col: str = "lang", most: int = LANGUAGES) -> tuple[str, ...]:
    """The languages that get a model of their own, then ``OTHER``."""
    rows = docs.where(F.col(lang_col).isNotNull()).groupBy(F.col(lang_col).cast("string").alias("lang")).count().orderBy(F.desc("count"), "lang").limit(most).collect()
    return (*sorted(r.lang for r in rows if r.lang != OTHER), OTHER)


def language(col: str, groups: tuple[str, ...]) -> F.Column:
    """The language if it has a model of its own, else (also for null) ``OTHER``."""
    own = F.col(col).cast("string")
    return F.when(own.isin(*groups), own).otherwise(OTHER)


def _numbers(column: pa.Array, groups: tuple[str, ...]) -> np.ndarray:
    return pc.index_in(column, value_set=pa.array(groups)).to_numpy().astype(np.int64)


def _hashed(key: np.ndarray) -> np.ndarray:
    return key * np.uint64(MULTIPLIER)


def _keys(body: np.ndarray, bounds: np.ndarray, langs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each character its 4-gram, with the number of the language above it; and text sizes."""
    g, sizes = grams(body, bounds)
    return g | np.repeat(langs.astype(np.uint64), sizes) << np.uint64(BITS * ORDER), sizes


def blocks(docs: DataFrame, groups: tuple[str, ...]) -> DataFrame:
    """Blocks of ``docs(_id, lang, text)``: rows ``(block, body)`` with some of its texts (an Arrow
    stream), and a row ``(block, hashes, counts)`` with its 4-grams, hashes ascending."""

    def sent(block: int, seen: list) -> Iterator[pa.RecordBatch]:
        h = np.concatenate([x[0] for x in seen])
        by = np.argsort(h)
        h, n = h[by], np.concatenate([x[1] for x in seen])[by]
        first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        yield _record(block, None, h[first].tobytes(), np.add.reduceat(n, first).astype(np.uint32).tobytes())

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packing = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=LEVEL))
        block, size, seen = TaskContext.get().partitionId() << 32, 0, []
        for b in batches:
            langs = _numbers(b.column(1), groups)
            for first, after, body, bounds in chunks(b.column(2)):
                key, _ = _keys(body, bounds, langs[first:after])
                if len(key):
                    seen.append(np.unique(_hashed(key), return_counts=True))
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, b.schema, options=packing) as out:
                    out.write_batch(b.slice(first, after - first))
                yield _record(block, sink.getvalue().to_pybytes(), None, None)
                size += len(body)
                if size >= BLOCK:
                    yield from sent(block, seen)
                    block, size, seen = block + 1, 0, []
        if seen:
            yield from sent(block, seen)

    return docs.mapInArrow(of, "block long, body binary, hashes binary, counts binary")


def _record(block, body, hashes, counts) -> pa.RecordBatch:
    columns = [pa.array([block], pa.int64()), *[pa.array([x], pa.binary()) for x in (body, hashes, counts)]]
    return pa.RecordBatch.from_arrays(columns, names=["block", "body", "hashes", "counts"])


def questions(parts: DataFrame, shards: int, copies: int) -> DataFrame:
    """``(block, shard, copy, hashes)``: the 4-grams of ``parts(block, hashes)`` by the shard that has
    them, and which copy of it the block asks."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, hashes in zip(b.column(0).to_pylist(), b.column(1)):
                h = np.frombuffer(hashes.as_py(), np.uint64)
                shard = _shard(h, shards)
                for k in np.unique(shard).tolist():
                    low, high = np.searchsorted(shard, [k, k + 1])
                    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([k], pa.int64()), pa.array([h[low:high].tobytes()], pa.binary())], names=["block", "shard", "hashes"])

    asked = parts.mapInArrow(of, "block long, shard long, hashes binary")
    return asked.withColumn("copy", F.pmod(F.xxhash64("block"), F.lit(copies)))


def _shard(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Which of ``shards`` equal ranges of the hash each lies in."""
    return ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def gram_counts(parts: DataFrame) -> DataFrame:
    """``(key, n)``: counts of all 4-grams of all languages, from the blocks' own counts."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for hashes, counts in zip(b.column(0), b.column(1)):
                key = np.frombuffer(hashes.as_py(), np.uint64) * np.uint64(INVERSE)
                n = np.frombuffer(counts.as_py(), np.uint32)
                yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(n.astype(np.int64))], names=["key", "n"])

    return parts.select("hashes", "counts").mapInArrow(of, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _suffix(order: int) -> F.Column:
    """Key of the n-gram without its first character, for one of ``order`` characters."""
    rest = BITS * (order - 1)
    return F.shiftleft(F.shiftright("key", BITS * order), rest).bitwiseOR(F.col("key").bitwiseAND(F.lit((1 << rest) - 1)))


def kneser_ney(counts: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """``(key, logp)`` and the stored tables that it reads: interpolated modified Kneser-Ney for each 4-gram of ``counts(key, n)``.

    The highest order uses counts, the lower ones the number of different characters that precede.
    The discounts of an order and language come from its counts of counts one to four; where those
    vanish, a half is used. A context has at most ``CLASSES`` n-grams, a suffix as many longer ones,
    so no window or join key is large.
    """
    seen = {ORDER: counts}
    for order in range(ORDER, 1, -1):
        seen[order - 1] = stored(seen[order].groupBy(_suffix(order).alias("key")).agg(F.count("*").alias("n")), "grams")
    n, lower = F.col("n"), None
    for order in range(1, ORDER + 1):
        rows = seen[order].withColumn("lang", F.shiftright("key", BITS * order))
        of = rows.groupBy("lang").agg(*[F.count_if(n == i).alias(f"n{i}") for i in (1, 2, 3, 4)])
        y = F.expr("n1 / (n1 + 2 * n2)")
        discount = [F.least(F.lit(float(i)), F.greatest(F.lit(0.0), i - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}"))) for i in (1, 2, 3)]
        all_seen = F.expr("n1 > 0 and n2 > 0 and n3 > 0 and n4 > 0")
        of = of.select("lang", *[F.when(all_seen, d).otherwise(0.5).alias(f"d{i}") for i, d in enumerate(discount, 1)])
        # at most one row for each of LANGUAGES + 1 languages
        rows = rows.join(F.broadcast(of), "lang").withColumn("d", F.when(n == 1, F.col("d1")).when(n == 2, F.col("d2")).otherwise(F.col("d3")))
        same = Window.partitionBy("context")
        rows = rows.withColumn("context", F.shiftright("key", BITS)).select(
            "key", ((n - F.col("d")) / F.sum("n").over(same)).alias("own"), (F.sum("d").over(same) / F.sum("n").over(same)).alias("rest"))
        if lower is None:
            rows = rows.withColumn("below", F.lit(1.0 / CLASSES))
        else:
            rows = rows.withColumn("suffix", _suffix(order)).join(lower, "suffix")
        lower = rows.select(F.col("key").alias("suffix"), (F.col("own") + F.col("rest") * F.col("below")).alias("below"))
    return lower.select(F.col("suffix").alias("key"), F.log("below").cast("float").alias("logp")), list(seen.values())


def sorted_arrays(model: DataFrame, shards: int) -> DataFrame:
    """``(shard, hashes, logp)``: one row for each range of the hash, hashes ascending."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = _hashed(b.column(0).to_numpy().astype(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(_shard(h, shards)), pa.array(h.view(np.int64)), b.column(1)], names=["shard", "hash", "logp"])

    def packed(table: pa.Table) -> pa.Table:
        h, logp = table["hash"].to_numpy().view(np.uint64), table["logp"].to_numpy()
        by = np.argsort(h)
        return pa.table([table["shard"][:1], pa.array([h[by].tobytes()]), pa.array([logp[by].tobytes()])], names=["shard", "hashes", "logp"])

    return model.mapInArrow(hashed, "shard long, hash long, logp float").groupBy("shard").applyInArrow(packed, "shard long, hashes binary, logp binary")


def _answers(asked: pa.Table, model: pa.Table) -> pa.Table:
    """Log probabilities of the 4-grams that blocks ask a shard for, in the order asked."""
    hashes = np.frombuffer(model["hashes"][0].as_py(), np.uint64)
    logp = np.frombuffer(model["logp"][0].as_py(), np.float32)
    found = [logp[np.searchsorted(hashes, np.frombuffer(h.as_py(), np.uint64))].tobytes() for h in asked["hashes"]]
    return pa.table([asked["block"], asked["shard"], pa.array(found, pa.binary())], names=["block", "shard", "logp"])


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars")


def scored(docs: DataFrame, groups: tuple[str, ...]) -> DataFrame:
    """``(_id, lang, measures, log_perplexity)`` of ``docs(_id, lang, text)``, one row for each."""
    parts = stored(blocks(docs, groups), "blocks")
    counted = parts.where("hashes is not null").select("block", "hashes", "counts")
    counts = stored(gram_counts(counted), "grams")
    shards, copies = 1 + counts.count() // SHARD, 1 + counted.count() // ASKING
    estimates, used = kneser_ney(counts)
    model = stored(sorted_arrays(estimates, shards), "model")
    for table in used:
        discard(table)
    copied = model.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(copies - 1).cast("long"))))
    asked = questions(counted.select("block", "hashes"), shards, copies)
    answers = asked.groupBy("shard", "copy").cogroup(copied.groupBy("shard", "copy")).applyInArrow(_answers, "block long, shard long, logp binary")
    schema = T.StructType([docs.schema["_id"], T.StructField("lang", T.StringType())]
                          + [T.StructField(c, T.LongType()) for c in MEASURES] + [T.StructField("log_perplexity", T.DoubleType())])

    def opened(texts: pa.Table) -> Iterator[tuple]:
        """Again the texts of a block, their bytes and bounds, hashes of their 4-grams, sizes."""
        for packed in texts["body"]:
            for b in pa.ipc.open_stream(packed.as_py()):
                for first, after, body, bounds in chunks(b.column(2)):
                    own = b.slice(first, after - first)
                    key, sizes = _keys(body, bounds, _numbers(own.column(1), groups))
                    yield own, body, bounds, _hashed(key), sizes

    def score(texts: pa.Table, known: pa.Table) -> pa.Table:
        hashes = np.unique(np.concatenate([np.unique(h) for _, _, _, h, _ in opened(texts)]))
        logp = b"".join(known.sort_by("shard")["logp"].to_pylist())  # shards are ranges of the hash
        logp = np.frombuffer(logp, np.float32)
        if len(logp) != len(hashes):
            raise ValueError(f"{len(hashes)} n-grams, {len(logp)} answers")
        out = []
        for own, body, bounds, h, sizes in opened(texts):
            h, at = np.unique(h, return_inverse=True)
            p = logp[np.searchsorted(hashes, h)][at]
            sums = np.concatenate(([0.0], np.cumsum(p, dtype=np.float64)))
            ends = np.concatenate(([0], np.cumsum(sizes)))
            mean = -np.diff(sums[ends]) / np.maximum(sizes, 1)
            out.append(pa.RecordBatch.from_arrays(
                [own.column(0), own.column(1), *[pa.array(c) for c in (*basics(body, bounds), sizes)], pa.array(mean, mask=sizes == 0)],
                names=schema.names))
        return pa.Table.from_batches(out)

    return parts.where("body is not null").select("block", "body").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, schema)


def basics(body: np.ndarray, bounds: np.ndarray, window: int = 5) -> np.ndarray:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (rows) of texts (columns) that
    lie end to end in ``body``. Words and lines are compared by 64-bit hashes."""
    docs, n = len(bounds) - 1, len(body)
    out = np.zeros((5, docs), np.int64)
    if not n:
        return out
    count = lambda flags: np.diff(np.concatenate(([0], np.cumsum(flags)))[bounds])
    kind = BYTES[body]
    inside = kind > 0
    first, last = np.ones(n, bool), np.ones(n, bool)
    first[1:] = ~inside[:-1]
    first[bounds[:-1][bounds[:-1] < n]] = True
    last[:-1] = ~inside[1:]
    last[bounds[1:] - 1] = True
    starts, ends = np.flatnonzero(inside & first), np.flatnonzero(inside & last) + 1
    owner = np.searchsorted(bounds, starts, "right") - 1
    sums = prefix_hashes(body)
    out[0] = np.bincount(owner, minlength=docs)
    out[1] = count(kind > 1)
    out[2] = count(kind == 3)
    cuts = np.union1d(bounds, np.flatnonzero(body == 10) + 1)
    low, high = cuts[:-1], cuts[1:] - (body[cuts[1:] - 1] == 10)
    worded = np.searchsorted(starts, high) > np.searchsorted(starts, low)
    low, high = low[worded], high[worded]
    line_owner = np.searchsorted(bounds, low, "right") - 1
    _, seen = np.unique(span_hashes(sums, low, high) ^ mix(line_owner.astype(np.uint64) + np.uint64(1)), return_index=True)
    out[3] = np.bincount(line_owner, minlength=docs) - np.bincount(line_owner[seen], minlength=docs)
    m = len(starts) - window + 1
    if m > 1:
        word = span_hashes(sums, starts, ends)
        key = word[:m]
        for i in range(1, window):
            key = key * np.uint64(0xD1342543DE82EF95) + word[i: i + m]
        whole = np.flatnonzero(owner[:m] == owner[window - 1:])
        key = mix(key[whole]) ^ mix(owner[whole].astype(np.uint64) + np.uint64(1))
        ordered = np.sort(key)
        twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        if len(twice):
            at = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
            hit = whole[twice[at] == key]
            steps = np.zeros(len(starts) + 1, np.int64)
            steps[hit] += 1
            steps[hit + window] -= 1
            out[4] = np.bincount(owner[np.cumsum(steps)[:-1] > 0], minlength=docs)
    return out


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
            low: float = 4.5, high: float = 5.0, least_spread: float = 0.01, short: float = 300.0) -> DataFrame:
    """Measures and verdict of every row.

    Returns ``id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept, log_perplexity, band_low, band_high``. ``base_failed``: fewer than 10 words, or over a
    fifth of them in repeated 5-word windows. Others are kept if the log perplexity lies in the
    language's band: the median less ``low`` and plus ``high`` spreads. A spread is the median
    absolute deviation, ``least_spread`` at least, times one plus the root of ``short`` characters
    over the text's, as short texts stray further. The medians are over the documents that pass
    the base rules. Null text: no words, base_failed. Rows without a language, and those of a
    language that is not among the most frequent, are ``other``. Each of several equal rows gets its
    own row; other columns are ignored. Empty in, empty out.
    """
    groups = languages(docs, lang_col)
    rows = scored(docs.select(F.col(id_col).alias("_id"), language(lang_col, groups).alias("lang"), F.col(text_col).alias("text")), groups)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rows = stored(rows.withColumn("base_failed", failed), "quality")
    fit = rows.where(~F.col("base_failed"))
    mid = fit.groupBy("lang").agg(F.percentile_approx("log_perplexity", 0.5, 100000).alias("mid"))
    off = (fit.join(F.broadcast(mid), "lang").withColumn("off", F.abs(F.col("log_perplexity") - F.col("mid")))
           .groupBy("lang").agg(F.percentile_approx("off", 0.5, 100000).alias("mad")))
    # at most one row for each declared language and one for the rest
    out = rows.join(F.broadcast(mid.join(off, "lang")), "lang", "left")
    spread = F.greatest("mad", F.lit(least_spread)) * (1 + F.sqrt(short / F.greatest("n_chars", F.lit(1))))
    out = out.withColumns({"band_low": F.col("mid") - low * spread, "band_high": F.col("mid") + high * spread})
    inside = F.coalesce(F.col("log_perplexity").between(F.col("band_low"), F.col("band_high")), F.lit(True))
    return out.select(F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      "base_failed", (~F.col("base_failed") & inside).alias("kept"), "lang", "log_perplexity", "band_low", "band_high")


def quality_kept(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that :func:`quality` keeps, with all their columns, whatever their names.

    Rows are matched by id, text and language, so rows that share an id are judged each by its own.
    """
    key = F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text"), F.col(lang_col).alias("lang"))
    marked = docs.select(key.alias("key"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    good = quality(marked, "key", "text", "lang").where("kept").select(F.col("key").alias("good")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("doc"), key.alias("key"))
    return rows.join(good, F.col("key").eqNullSafe(F.col("good")), "left_semi").select("doc.*")


def op1_ngram_quality(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality(docs).drop("lang", "band_low", "band_high")
