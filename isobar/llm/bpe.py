"""Byte-level BPE encoding and decoding with Spark's higher-order functions.

The pattern cuts a text into words. Ranked merges are folded over the byte arrays of distinct
words: a step finds the least rank of all adjacent pairs, by a literal rank map, and merges the
first pair that has it, until no pair has a rank. Spark does so for the distinct words of up to
``WORD_BYTES`` bytes that are most frequent in the texts, ``DICTIONARY`` of them at most; these, of
4 MB at most, are broadcast, and texts take their ids from there where they lie, in Arrow batches,
so that no text is shuffled. A worker merges other words when it first meets them, long ones with a
heap. (Folding these in Spark too, without shuffling texts, took more CPU and driver memory than
allowed; see README.) Decoding concatenates the binary pieces of the ids.

Every token of the file has to encode to itself (the tests check it): then pairs of equal rank are
pairs of equal parts.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import kept
from .words import WordTable, encoded, gather

MAPS = 1 << 15
DICTIONARY, WORD_BYTES = 1 << 16, 64
#: Words that a task counts before it passes them on.
COUNTED = 200_000
BITS = 20
ID, NONE = (1 << BITS) - 1, 1 << 30


@lru_cache(2)
def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file with one base64 token and its rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word: again and again the adjacent pair of lowest rank, the first of equals, merges."""
    if len(word) > WORD_BYTES:
        return _merge_long(word, ranks)
    if word in ranks:
        return [ranks[word]]
    parts, rank = [word[i: i + 1] for i in range(len(word))], ranks.get
    pairs = [rank(word[i: i + 2], 1 << 60) for i in range(len(word) - 1)]
    while pairs:
        low = min(pairs)
        if low == 1 << 60:
            break
        i = pairs.index(low)
        parts[i] = new = parts[i] + parts.pop(i + 1)
        del pairs[i]
        if i:
            pairs[i - 1] = rank(parts[i - 1] + new, 1 << 60)
        if i < len(pairs):
            pairs[i] = rank(new + parts[i + 1], 1 << 60)
    return [ranks[p] for p in parts]


def _merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """As :func:`merge_word`, with a heap of pairs: n log n for words of any length."""
    n = len(word)
    parts: list[bytes | None] = [word[i: i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(word[i: i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, size = heapq.heappop(heap)
        j = after[i]
        if parts[i] is None or j >= n or len(parts[i]) + len(parts[j]) != size:
            continue
        parts[i] += parts[j]
        parts[j] = None
        after[i] = k = after[j]
        if k < n:
            before[k] = i
        for a, b in ((before[i], i), (i, k)):
            if a >= 0 and b < n and (r := ranks.get(parts[a] + parts[b])) is not None:
                heapq.heappush(heap, (r, a, len(parts[a]) + len(parts[b])))
    return [ranks[p] for p in parts if p is not None]


def rank_map(ranks: dict[bytes, int]) -> Column:
    """The ranks as one literal: ``letters`` has the id of each byte; ``keys`` and ``merged`` are
    arrays of small arrays, picked by :func:`_slot`, of the pairs of ids that merge and of the
    token's rank, which is its id."""
    keys: list[list[int]] = [[] for _ in range(MAPS)]
    merged: list[list[int]] = [[] for _ in range(MAPS)]
    for piece, rank in ranks.items():
        for i in range(1, len(piece)):
            a, b = ranks.get(piece[:i]), ranks.get(piece[i:])
            if a is not None and b is not None:
                slot = (a * 31 + b) % MAPS
                keys[slot].append(a << BITS | b)
                merged[slot].append(rank)
    literal = {"letters": [ranks[bytes([i])] for i in range(256)], "keys": keys, "merged": merged}
    return F.from_json(F.lit(json.dumps(literal)), "letters array<bigint>, keys array<array<bigint>>, merged array<array<bigint>>")


def with_value(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def fold(word: Column, ranks: Column) -> Column:
    """Ids of a word (string): ranked merges over the array of its bytes.

    An entry of the folded array is a part's id in the low ``BITS`` bits and, above, the rank of
    its pair with the next part, ``NONE`` if it does not merge. A step merges the least entry, the
    first of equals, and ranks the two pairs around anew. It costs in proportion to the parts left,
    and there are as many steps as bytes, so this is for short words.
    """
    def part(x: Column) -> Column:
        return x.bitwiseAND(ID)

    def entry(a: Column, b: Column) -> Column:
        """The part ``a`` before the part ``b`` (null at the end of the word)."""
        slot = ((a * 31 + b) % MAPS).cast("int")
        place = F.array_position(F.get(ranks["keys"], slot), F.shiftleft(a, BITS) + b)
        return F.coalesce(F.shiftleft(F.get(F.get(ranks["merged"], slot), place.cast("int") - 1), BITS), F.lit(NONE << BITS)) + a

    def entries(parts: Column) -> Column:
        n = F.size(parts)
        return F.concat(F.zip_with(F.slice(parts, F.lit(1), n - 1), F.slice(parts, F.lit(2), n - 1), entry), F.array(F.get(parts, n - 1) + (NONE << BITS)))

    def one(x: Column, new: Column, at: Column) -> Column:
        before = F.when(at > 1, F.array(entry(part(F.get(x, at - 2)), new))).otherwise(F.array().cast("array<bigint>"))
        return F.concat(F.slice(x, F.lit(1), F.greatest(at - 2, F.lit(0))), before, F.array(entry(new, part(F.get(x, at + 1)))), F.slice(x, at + 2, F.size(x)))

    def step(x: Column, _) -> Column:
        return with_value(F.array_min(x), lambda low: F.when(low >= NONE << BITS, x).otherwise(one(x, F.shiftright(low, BITS), F.array_position(x, low).cast("int"))))

    letters = F.transform(F.split(F.decode(word.cast("binary"), "ISO-8859-1"), ""), lambda c: F.get(ranks["letters"], F.ascii(c)))
    return with_value(letters, lambda raw: F.aggregate(raw, entries(raw), step, lambda x: F.transform(x, lambda y: part(y).cast("int"))))


def cutter(pattern: str) -> Callable[[str], list[str]]:
    """The words of a text. Texts of ASCII only are cut by the same pattern with its classes of letters
    and numbers written out, which takes half the time."""
    every = regex.compile(pattern).findall
    plain = re.sub(r"\[[^\]]*\]", lambda m: m[0].replace(r"\p{L}", "A-Za-z").replace(r"\p{N}", "0-9"), pattern).replace(r"\p{L}", "[A-Za-z]").replace(r"\p{N}", "[0-9]")
    if r"\p" in plain or r"\P" in plain:
        return every
    ascii_only = re.compile(plain, re.ASCII).findall
    return lambda text: ascii_only(text) if text.isascii() else every(text)


def frequent_words(docs: DataFrame, pattern: str, text_col: str = "text", most: int = DICTIONARY) -> DataFrame:
    """``(word)``: the distinct words of all texts up to ``WORD_BYTES`` bytes, of more than ``most``
    those that occur most. Tasks count before anything is shuffled."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, held = cutter(pattern), Counter()

        def rows() -> pa.RecordBatch:
            words = [w for w in held if len(w) <= WORD_BYTES and len(w.encode()) <= WORD_BYTES]
            out = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([held[w] for w in words], pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for b in batches:
            for text in b.column(0).to_pylist():
                held.update(cut(text or ""))
                if len(held) > COUNTED:
                    yield rows()
        yield rows()

    words = docs.select(text_col).mapInArrow(of, "word string, n long")
    return words.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(most).select("word")


def dictionary(words: DataFrame, ranks: Column) -> tuple[list[str], np.ndarray, np.ndarray]:
    """``words`` folded by Spark: the words, all their ids end to end, and how many each has. They
    are bounded in number and bytes and go through the driver."""
    spread = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    coded = words.repartition(spread, "word").select("word", with_value(ranks, lambda r: fold(F.col("word"), r)).alias("ids")).toArrow()
    ids = coded["ids"].combine_chunks()
    return coded["word"].to_pylist(), ids.flatten().to_numpy().astype(np.uint32), ids.value_lengths().to_numpy().astype(np.int64)


class Coder:
    """Of one worker: the pattern, a word table that begins with the dictionary, and all pieces."""

    def __init__(self, known: tuple[list[str], np.ndarray, np.ndarray], ranks: dict[bytes, int], pattern: str):
        pieces = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            pieces[rank] = token
        self.starts = np.concatenate(([0], np.cumsum([len(p) for p in pieces])))
        self.pieces = np.frombuffer(b"".join(pieces), np.uint8)
        self.cut = cutter(pattern)

        def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
            found = [merge_word(w.encode(), ranks) for w in words]
            return np.fromiter(chain.from_iterable(found), np.uint32), np.fromiter(map(len, found), np.int64, len(found))

        self.table = WordTable(encode, 600_000, known)

    def encode(self, texts: list[str]) -> Iterator[tuple[int, list[np.ndarray]]]:
        return encoded(texts, self.cut, self.table)

    def decode(self, ids: np.ndarray) -> bytes:
        """The pieces of the ids, end to end."""
        return gather(self.pieces, self.starts, ids.astype(np.int64)).tobytes()


def _coders(docs: DataFrame, ranks_path: str, pattern: str, text_col: str, most: int):
    """A function that gives each worker its coder. Ranks and dictionary are broadcast; both are bounded."""
    ranks = read_ranks(ranks_path)
    known = dictionary(frequent_words(docs, pattern, text_col, most), rank_map(ranks))
    shared = docs.sparkSession.sparkContext.broadcast((known, ranks, pattern))
    return lambda: kept(("coder", id(shared.value)), lambda: Coder(*shared.value))


def _per_text(docs: DataFrame, id_col: str, text_col: str, schema: T.StructType, coder, row) -> DataFrame:
    """``row(coder, ids)`` of every text: the columns after the id."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder()
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                for first, ids in own.encode([text or "" for text in part.column(1).to_pylist()]):
                    columns = zip(*(row(own, x.astype("<u4")) for x in ids))
                    yield pa.RecordBatch.from_arrays([part.column(0).slice(first, len(ids)), *map(pa.array, columns)], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(of, schema)


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", most: int = DICTIONARY) -> DataFrame:
    """``id_col, n_tokens, ids``: ids of every whole text, as binary (little-endian unsigned 32-bit).

    Null or empty text: no ids. Rows are encoded each by itself, also where ids are null or repeat;
    other columns are ignored. Empty in, empty out. A text and its ids have to fit a row; a word of
    n bytes takes n log n steps. ``most`` bounds the dictionary, not the words that are encoded.
    """
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
    return _per_text(docs, id_col, text_col, schema, _coders(docs, ranks_path, pattern, text_col, most), lambda _, ids: (len(ids), ids.tobytes()))


def decode(coded: DataFrame, ranks_path: str, id_col: str = "doc_id") -> DataFrame:
    """``id_col, decoded``: the bytes of each row's ``ids``, their binary pieces one after the other."""
    schema = T.StructType([T.StructField(id_col, coded.schema[id_col].dataType), T.StructField("decoded", T.BinaryType())])
    shared = coded.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = kept(("decoder", id(shared.value)), lambda: Coder(([], np.zeros(0, np.uint32), np.zeros(0, np.int64)), shared.value, ""))
        for b in batches:
            texts = [own.decode(np.frombuffer(x or b"", "<u4")) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.binary())], names=schema.names)

    return coded.select(id_col, "ids").mapInArrow(of, schema)


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", most: int = DICTIONARY) -> DataFrame:
    """``id_col, n_tokens, ids_sha256, decoded_sha256``: encoded, then decoded from the ids."""
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()),
                           T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    return _per_text(docs, id_col, text_col, schema, _coders(docs, ranks_path, pattern, text_col, most), lambda own, ids: (
        len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(own.decode(ids)).hexdigest()))


def op7_byte_bpe(spark, sf_dir):
    import public_tokenizers

    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"),
                      public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
