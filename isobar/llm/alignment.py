"""Tokens of two tokenizers aligned by the bytes they cover.

Token ends of either tokenizer are bits of a packed bitset over the bytes. The AND of both has the
shared cuts; population counts up to a cut say how many tokens of either end there, so each stretch
between two cuts is a range of tokens on both sides, and all pairs of a stretch are linked.

Both tokenizers cut where white space follows another character, so texts are taken in units, white
space and what follows it. A worker aligns the units it has not seen before, many in one bitset, and
puts a text's result together from them. The distinct pairs of a block of texts get the numbers of
documents that have them, and each text sums these up, in three steps: blocks say which pairs they
have, one shuffle by pair counts the documents of all blocks, and the counts go back by block.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import kept, stored
from .words import Places, _grown, gather

BLOCK, PART = 32 << 20, 1 << 20
BLOCKS_BITS = 8
#: Bits of a token of the second tokenizer in the number of a pair.
BITS = 20
#: Of units that are remembered by a worker: how many, and how long at most.
MOST, LONG = 300_000, 64
#: A unit ends where a space, tab or line feed follows a character that is no white space: there no
#: token of either tokenizer goes on. Other white space may be inside a token.
UNIT = r"\s*(?:\S+(?:[^\S \t\n]\s*)?)+|\s+"


class Packed:
    """Bits of a packed set, with counts up to each word of 64."""

    def __init__(self, size: int, at: np.ndarray):
        bits = np.zeros(-(-max(size, 1) // 64) * 64, bool)
        bits[at] = True
        self._of(np.packbits(bits, bitorder="little").view("<u8"))

    def _of(self, words: np.ndarray) -> Packed:
        self.words = words
        self.before = np.cumsum(np.bitwise_count(words).astype(np.int64)) - np.bitwise_count(words)
        return self

    def __and__(self, other: Packed) -> Packed:
        return object.__new__(Packed)._of(self.words & other.words)

    def places(self) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))

    def rank(self, at: np.ndarray) -> np.ndarray:
        """How many bits are set up to each of ``at``, itself included."""
        word = self.words[at >> 6] & np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(63) - (at & 63).astype(np.uint64))
        return self.before[at >> 6] + np.bitwise_count(word)


def _counted(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of their numbers."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[first], np.add.reduceat(n[order], first) if len(first) else n[:0]


class Sides:
    """Both tokenizers: ids and bytes of units."""

    def __init__(self, byte_path: str, piece_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_path)
        self.a.encode_special_tokens = True
        vocab = self.a.get_vocab()
        self.a_sizes = np.zeros(max(vocab.values()) + 1, np.int64)
        self.a_sizes[list(vocab.values())] = [len(t) for t in vocab]  # a character for each byte
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        of_byte = {i: bytes([int(self.b.id_to_piece(i)[3:5], 16)]) for i in range(len(self.b)) if self.b.is_byte(i)}
        self.b_bytes = [of_byte.get(i) or self.b.id_to_piece(i).replace("▁", " ").encode() for i in range(len(self.b))]
        self.b_sizes = np.array([len(x) for x in self.b_bytes])
        if len(self.b) >> BITS:
            raise ValueError(f"more than {1 << BITS} pieces")

    def ids(self, units: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """A line feed before a unit is a token of its own, so that the unit follows as it is."""
        batch = getattr(self.a, "encode_batch_fast", self.a.encode_batch)
        a = [e.ids for e in batch(units, add_special_tokens=False)]
        return a, [x[2:] for x in self.b.encode(["\n" + u for u in units], num_threads=1)]


class Units:
    """What a worker knows of the units it has seen, by their numbers."""

    def __init__(self, sides: Sides):
        self.sides = sides
        self.cut = regex.compile(UNIT).findall
        self.clear()

    def clear(self) -> None:
        self.place = Places()
        self.sizes = np.zeros((4, 1 << 12), np.int64)  # tokens, tokens, groups, links
        self.bad = np.zeros(1 << 12, bool)
        self.groups: list[bytes] = []
        self.pairs, self.times = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.starts = np.zeros(1 << 12, np.int64)

    def learn(self) -> None:
        """Align the newest units."""
        units, self.place.new = self.place.new, []
        count = len(self.place)
        old = count - len(units)
        self.bad = _grown(self.bad, count)
        self.sizes = np.pad(self.sizes, ((0, 0), (0, len(self.bad) - self.sizes.shape[1])))
        self.starts = _grown(self.starts, count + 1)
        for first in range(0, len(units), 20_000):
            self._align(units[first: first + 20_000], old + first)

    def _align(self, units: list[str], at: int) -> None:
        a_ids, b_ids = self.sides.ids(units)
        raws = [u.encode() for u in units]
        for i, raw in enumerate(raws):
            if b"".join(map(self.sides.b_bytes.__getitem__, b_ids[i])) != raw or int(self.sides.a_sizes[a_ids[i]].sum()) != len(raw):
                self.bad[at + i], a_ids[i], b_ids[i], raws[i] = True, [], [], b""
        a, b = (np.fromiter(chain.from_iterable(x), np.int64) for x in (a_ids, b_ids))
        unit_ends = np.cumsum([len(r) for r in raws])
        size = int(unit_ends[-1])
        bits_a, bits_b = (Packed(size, np.cumsum(sizes[ids]) - 1) for sizes, ids in ((self.sides.a_sizes, a), (self.sides.b_sizes, b)))
        cuts = (bits_a & bits_b).places()
        a_to, b_to = bits_a.rank(cuts), bits_b.rank(cuts)
        a_n, b_n = np.diff(a_to, prepend=0), np.diff(b_to, prepend=0)
        owner = np.searchsorted(unit_ends, cuts, "right")
        found = np.stack([np.bincount(owner, w, len(units)).astype(np.int64) for w in (a_n, b_n, np.ones(len(cuts)), a_n * b_n)]) if len(cuts) else np.zeros((4, len(units)), np.int64)
        self.sizes[:, at: at + len(units)] = found
        a_text, b_text = (list(map(str, x.tolist())) for x in (a, b))
        texts = [",".join(a_text[i: j]) + "|" + ",".join(b_text[k: m]) for i, j, k, m in zip((a_to - a_n).tolist(), a_to.tolist(), (b_to - b_n).tolist(), b_to.tolist())]
        ends = np.cumsum(found[2]).tolist()
        self.groups += [";".join(texts[i: j]).encode() for i, j in zip([0, *ends], ends)]
        keys, times = [], []
        large = a_n * b_n > 1 << 20
        for g in np.flatnonzero(large).tolist():  # distinct tokens of either side first
            (ua, na), (ub, nb) = (np.unique(x[to[g] - n[g]: to[g]], return_counts=True) for x, to, n in ((a, a_to, a_n), (b, b_to, b_n)))
            keys.append(owner[g] << 2 * BITS | (ua[:, None] << BITS | ub).ravel())
            times.append((na[:, None] * nb).ravel())
        links = np.where(large, 0, a_n * b_n)
        done = 0
        while done < len(links):  # some millions of links at a time
            upto = max(done + 1, int(np.searchsorted(np.cumsum(links[done:]), 1 << 22, "right")) + done)
            n = links[done: upto]
            g = np.repeat(np.arange(done, upto), n)
            k = np.arange(len(g)) - np.repeat(np.cumsum(n) - n, n)
            own = a[(a_to - a_n)[g] + k // b_n[g]] << BITS | b[(b_to - b_n)[g] + k % b_n[g]]
            u, c = np.unique(owner[g] << 2 * BITS | own, return_counts=True)
            keys.append(u)
            times.append(c)
            done = upto
        keys, times = _counted(np.concatenate(keys or [np.zeros(0, np.int64)]), np.concatenate(times or [np.zeros(0, np.int64)]))
        used = int(self.starts[at])
        self.pairs, self.times = (_grown(x, used + len(keys)) for x in (self.pairs, self.times))
        self.pairs[used: used + len(keys)] = keys & (1 << 2 * BITS) - 1
        self.times[used: used + len(keys)] = times
        self.starts[at + 1: at + len(units) + 1] = used + np.searchsorted(keys >> 2 * BITS, np.arange(len(units)), "right")

    def align(self, texts: list[str]) -> tuple[list[tuple], np.ndarray, np.ndarray, np.ndarray]:
        """Of each text its counts and digest; of all, the distinct pairs: number of the text, pair, links."""
        if len(self.place) > MOST:
            self.clear()
        held = [self.cut(" " + t) if t else [] for t in texts]
        found = np.fromiter(map(self.place.__getitem__, chain.from_iterable(held)), np.int64)
        if self.place.new:
            self.learn()
        ends = np.cumsum([len(h) for h in held])
        text = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))
        bad = np.bincount(text, self.bad[found], len(texts)) > 0
        sums = [np.bincount(text, row[found], len(texts)).astype(np.int64) for row in self.sizes]
        rows, numbers = [], found.tolist()
        for i, (first, last) in enumerate(zip([0, *ends.tolist()], ends.tolist())):
            if bad[i] or first == last:
                rows.append((0, 0, 0, 0, ""))
            else:
                body = b";".join([self.groups[u] for u in numbers[first: last]])
                rows.append((*[int(s[i]) for s in sums], hashlib.sha256(body).hexdigest()))
        good = ~bad[text]
        of_unit, n = np.unique(text[good] << 32 | found[good], return_counts=True)
        unit = of_unit & 0xFFFFFFFF
        sizes = self.starts[unit + 1] - self.starts[unit]
        pairs = gather(self.pairs, self.starts, unit)
        links = gather(self.times, self.starts, unit) * np.repeat(n, sizes)
        of_text = np.repeat(of_unit >> 32, sizes)
        numbers, place = np.unique(pairs, return_inverse=True)
        keys, links = _counted(of_text << 32 | place, links)
        return rows, keys >> 32, numbers[keys & 0xFFFFFFFF], links


COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def _aligned(sides: tuple[str, str], texts_schema: T.StructType, most: int):
    """Rows of texts, a row with the pairs of each text for each block, and the block's pairs."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = kept(("units", *sides), lambda: Units(Sides(*sides)))
        first, made, size, docs = TaskContext.get().partitionId() << BLOCKS_BITS, 0, 0, 0
        parts: list[tuple[np.ndarray, ...]] = []
        names, kind = texts_schema.names, pa.null()

        def batch(n: int, **columns) -> pa.RecordBatch:
            nulls = {"doc": kind, "groups_sha256": pa.string(), "body": pa.binary()}
            return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(n, nulls.get(c, pa.int64()))) if c != "block" else pa.array(np.full(n, first + made)) for c in names], names=names)

        def block() -> Iterator[pa.RecordBatch]:
            nonlocal made, size, docs, parts
            if made >> BLOCKS_BITS:
                raise RuntimeError("a partition has too many blocks")
            text, pair, links = (np.concatenate(x) for x in zip(*parts))
            own, place = np.unique(pair, return_inverse=True)
            body = np.concatenate((np.bincount(text, minlength=docs), place, links)).astype("<u4").tobytes() if links.max(initial=0) < 1 << 32 else b""
            if not body and len(links):
                raise RuntimeError("a text has too many links of one pair")
            yield batch(1, body=pa.array([body], pa.binary()), row=pa.array([docs]))
            n = np.bincount(place, minlength=len(own))
            for at in range(0, len(own), 50_000):
                own_part = own[at: at + 50_000]
                yield batch(len(own_part), place=pa.array(np.arange(at, at + len(own_part))), pair=pa.array(own_part), docs=pa.array(n[at: at + 50_000]))
            made, size, docs, parts = made + 1, 0, 0, []

        for b in batches:
            kind = b.column(0).type
            texts = [t or "" for t in b.column(1).to_pylist()]
            at = 0
            while at < len(texts):
                upto, held = at, 0
                while upto < len(texts) and held < min(PART, most):
                    held += len(texts[upto])
                    upto += 1
                rows, text, pair, links = units.align(texts[at: upto])
                columns = list(zip(*rows))
                yield batch(len(rows), doc=b.column(0).slice(at, upto - at), row=pa.array(np.arange(docs, docs + len(rows))),
                            **{c: pa.array(x, pa.int64()) for c, x in zip(COUNTS, columns)}, groups_sha256=pa.array(columns[4], pa.string()))
                parts.append((text + docs, pair, links))
                docs, size, at = docs + len(rows), size + held, upto
                if size >= most:
                    yield from block()
        if parts:
            yield from block()
    return of


def _summed(schema: T.StructType):
    names = schema.names

    def of(left: pa.Table, right: pa.Table) -> pa.Table:
        """Of one block, its texts and pairs and the pairs' counts: two sums for each text."""
        bodies = left.filter(pa.compute.is_valid(left["body"]))
        rows = left.filter(pa.compute.is_null(left["body"]))
        numbers, docs = np.frombuffer(bodies["body"][0].as_py(), "<u4").astype(np.int64), bodies["row"][0].as_py()
        n = numbers[:docs]
        m = int(n.sum())
        place, links, text = numbers[docs: docs + m], numbers[docs + m:], np.repeat(np.arange(docs), n)
        count, best = np.zeros(right.num_rows, np.int64), np.zeros(right.num_rows, bool)
        count[right["place"].to_numpy()] = right["n"].to_numpy()
        best[right["place"].to_numpy()] = right["best"].to_numpy()
        sums = [np.zeros(docs, np.int64) for _ in range(2)]
        for out, values in zip(sums, (links * best[place], links * count[place])):
            np.add.at(out, text, values)  # whole numbers
        own = rows["row"].to_numpy()
        columns = {"n_best": pa.array(sums[0][own]), "count_sum": pa.array(sums[1][own])}
        return pa.table([columns.get(c, rows[c] if c in rows.column_names else None) for c in names], names=names)
    return of


def align(docs: DataFrame, byte_tokenizer: str, piece_tokenizer: str, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """How two tokenizers cut each text, one row for each: ``id_col, n_a, n_b, n_groups, n_links,
    n_best, count_sum, groups_sha256``.

    A is a byte-level file of the tokenizers library and encodes a space and the text; B is a
    sentencepiece model that adds the space itself. Special tokens are plain text. ``n_groups``:
    stretches of bytes between shared token ends; ``n_links``: pairs of a token of A and one of B in
    the same stretch; ``n_best``: of these, those whose pair of ids is linked in as many documents as
    any pair of its A id; ``count_sum``: these numbers of documents, over the links. The digest is of
    ``a1,a2|b1;a3|b2,b3``.

    Null and empty texts, and those whose bytes either tokenizer does not give back, have zeros and an
    empty digest. Rows with null or repeated ids are documents like others; other columns are ignored.
    A text has to fit a row; ``block`` is about the characters of a block. Empty in, empty out.
    """
    kind, long = docs.schema[id_col].dataType, T.LongType()
    schema = T.StructType([T.StructField("block", long), T.StructField("doc", kind), T.StructField("row", long), *[T.StructField(c, long) for c in COUNTS],
                           T.StructField("groups_sha256", T.StringType()), T.StructField("body", T.BinaryType()), *[T.StructField(c, long) for c in ("place", "pair", "docs")]])
    source = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    found = stored(source.mapInArrow(_aligned((byte_tokenizer, piece_tokenizer), schema, block), schema), "aligned")
    pairs = found.where("pair is not null").select("block", "place", "pair", "docs")
    total = pairs.groupBy("pair").agg(F.sum("docs").alias("n"))
    of_a = Window.partitionBy(F.shiftright("pair", BITS))  # no more rows than B has pieces
    total = total.withColumn("best", F.col("n") == F.max("n").over(of_a))
    back = pairs.drop("docs").join(total, "pair").select(F.col("block").alias("to"), "place", "n", "best")
    out = T.StructType([T.StructField("doc", kind), *[T.StructField(c, long) for c in (*COUNTS, "n_best", "count_sum")], T.StructField("groups_sha256", T.StringType())])
    texts = found.where("pair is null").select("block", "doc", "row", *COUNTS, "groups_sha256", "body")
    return texts.groupBy("block").cogroup(back.groupBy("to")).applyInArrow(_summed(out), out).withColumnRenamed("doc", id_col)


def op13_tokenizer_alignment(spark, sf_dir):
    import public_tokenizers

    return align(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
