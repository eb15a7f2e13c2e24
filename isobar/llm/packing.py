"""Bounded-space online packing of documents into training sequences.

Each partition tokenizes its documents and places them as they come, with a fixed number of open
windows: whole windows' worth of a long document are sequences of their own, what remains goes to
the open window that it fills best, and where none has room the fullest is emitted and a new one
opened. What is still open at the end of each partition is small (at most that number of windows
each); these leftovers are merged, best fit again, in groups of partitions.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import kept, stored, text_bytes
from .words import WordTable, encoded

CAPACITY, OPEN_WINDOWS, END_ID = 2048, 64, 1
PARTITION_SHIFT, GROUP = 34, 32


MARK = "\x1e"
STOP = re.compile(rb"(?<=[a-z])([.,])(?=\s)")


def words_of(text: bytes) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased, a single stop or comma apart."""
    return STOP.sub(rb" \1", text.lower()).split()


def word_ids(path: str) -> WordTable:
    """Word table over a tokenizer file that lower-cases, and drops white space before it encodes,
    so that words between ASCII white space are encoded independently of each other."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    batch = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)
    mark = tokenizer.encode(MARK, add_special_tokens=False).ids
    final = np.zeros(tokenizer.get_vocab_size(), bool)
    final[[i for piece, i in tokenizer.get_vocab().items() if piece.endswith("</w>")]] = True

    def joined(texts: list[str], between: str) -> np.ndarray:
        return np.array(batch([between.join(texts)], add_special_tokens=False)[0].ids, np.uint32)

    def of(texts: list[str], letters: bool) -> tuple[np.ndarray, np.ndarray]:
        """Words of letters only end with their one final piece; others are told apart by marks."""
        if letters:
            ids = joined(texts, " ")
            ends = np.flatnonzero(final[ids])
            if len(ends) == len(texts):
                return ids, np.diff(ends, prepend=-1)
        elif len(mark) == 1:
            ids = joined(texts, f" {MARK} ")
            cuts = np.flatnonzero(ids == mark[0])
            if len(cuts) == len(texts) - 1:
                return np.delete(ids, cuts), np.diff(np.append(cuts, len(ids)), prepend=-1) - 1
        found = [e.ids for e in batch(texts, add_special_tokens=False)]
        return np.array([i for own in found for i in own], np.uint32), np.array([len(own) for own in found])

    def encode(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        texts = [w.decode() for w in words]
        letters = np.fromiter(map(str.isalpha, texts), bool, len(texts))
        sizes, parts = np.zeros(len(texts), np.int64), []
        for flag in (True, False):
            own = np.flatnonzero(letters == flag)
            if len(own):
                ids, sizes[own] = of([texts[i] for i in own.tolist()], flag)
                parts.append((own, ids))
        out, starts = np.zeros(int(sizes.sum()), np.uint32), np.cumsum(sizes) - sizes
        for own, ids in parts:
            n = sizes[own]
            out[np.repeat(starts[own] - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
        return out, sizes

    return WordTable(encode)


class Windows:
    """Open windows by free room. :meth:`place` returns the window and the offset in it."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.open: list[tuple[int, int]] = []  # (free, window), ascending: the fullest first
        self.made = 0

    def new(self) -> int:
        self.made += 1
        return self.made - 1

    def place(self, size: int) -> tuple[int, int]:
        at = bisect_left(self.open, (size, -1))
        if at < len(self.open):
            free, window = self.open.pop(at)
        else:
            if len(self.open) >= self.most:
                self.open.pop(0)
            free, window = self.capacity, self.new()
        if free > size:
            insort(self.open, (free - size, window))
        return window, self.capacity - free


def _merged(capacity: int):
    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        """Best fit of the leftover windows, the fullest first."""
        windows, ids, out = Windows(capacity, 1 << 60), {}, []
        for window, fill in pdf.sort_values(["length", "window"], ascending=[False, True])[["window", "length"]].itertuples(index=False):
            where, shift = windows.place(int(fill))
            out.append((window, ids.setdefault(where, window), shift))
        return pd.DataFrame(out, columns=["left_window", "sequence", "shift"]).astype("int64")
    return of


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
         open_windows: int = OPEN_WINDOWS, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents and their places in sequences of at most ``capacity`` tokens.

    Returns ``id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset`` and, with
    ``with_ids``, ``ids`` (little-endian unsigned 32-bit). A document's ids are those of
    ``tokenizer`` (a file of the tokenizers library) without special tokens, then 1; null or empty
    text is that one id. Rows with null or repeated ids are documents like others. Only documents
    longer than a sequence are cut. Offsets in a sequence are gapless. No rows, no pieces.
    """
    kind = docs.schema[id_col].dataType
    longs = ("start", "length", "ids_crc32", "doc_tokens", "window", "offset")
    fields = [T.StructField("doc", kind), *[T.StructField(c, T.LongType()) for c in longs], T.StructField("left", T.BooleanType())]
    schema = T.StructType(fields + [T.StructField("ids", T.BinaryType())] * with_ids)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, windows = kept(("words", tokenizer), lambda: word_ids(tokenizer)), Windows(capacity, open_windows)
        base = TaskContext.get().partitionId() << PARTITION_SHIFT

        def made(ids: list, rows: list, left: bool, raw: list) -> pa.RecordBatch:
            columns = list(zip(*rows)) or [()] * len(longs)
            arrays = [pa.array(ids, b_type), *[pa.array(c, pa.int64()) for c in columns], pa.array([left] * len(rows), pa.bool_())]
            return pa.RecordBatch.from_arrays(arrays + [pa.array(raw, pa.binary())] * with_ids, names=schema.names)

        b_type = pa.null()
        for b in batches:
            b_type = b.column(0).type
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                docs_in, texts = part.column(0).to_pylist(), text_bytes(part.column(1))
                for first, coded in encoded(texts, words_of, table):
                    ids_out, rows, raw = [], [], []
                    for doc, own in zip(docs_in[first:], coded):
                        ids = np.append(own, END_ID).astype("<u4")
                        for start in range(0, len(ids), capacity):
                            piece = ids[start: start + capacity]
                            window, offset = windows.place(len(piece)) if len(piece) < capacity else (windows.new(), 0)
                            body = piece.tobytes()
                            ids_out.append(doc)
                            rows.append((start, len(piece), zlib.crc32(body), len(ids), base + window, offset))
                            if with_ids:
                                raw.append(body)
                    yield made(ids_out, rows, False, raw)
        rest = [(0, capacity - free, 0, 0, base + window, 0) for free, window in windows.open]
        if rest:
            yield made([None] * len(rest), rest, True, [None] * len(rest))

    pieces = stored(docs.select(id_col, text_col).mapInArrow(of, schema), "pieces")
    group = F.expr(f"shiftright(window, {PARTITION_SHIFT}) div {GROUP}")
    merged = pieces.where("left").groupBy(group).applyInPandas(_merged(capacity), "left_window long, sequence long, shift long")
    placed = pieces.where("not left").join(merged, F.col("window") == F.col("left_window"), "left")
    return placed.select(F.col("doc").alias(id_col), "start", "length", "ids_crc32", "doc_tokens",
                         F.coalesce("sequence", "window").alias("sequence_id"),
                         (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"), *["ids"] * with_ids)


def op5_packing(spark, sf_dir):
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
