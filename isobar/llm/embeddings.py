"""Embedding near-duplicates by a robust-pruned flat graph.

Vectors of one label (and length) are dealt to cells around centroids, each to its nearest few, so
that cells overlap. The centroids have two levels, coarse ones and residuals that all coarse ones
share, both fitted on a bounded sample; the number of cells is the product of both, so it follows
the number of vectors while what is broadcast does not. Every cell builds a pruned neighbour graph;
the adjacency lists of a vector's cells are united. Each vector then searches its cells from the
medoids and from its own place in the graph, greedily, and from what it reaches widens over all
vectors within a margin of the range. Pairs at or above the cosine, computed exactly in double
precision, are links. A pair that shares several cells counts in the first of these. Cells give a
vector's number of links and a spanning forest of their links, not all pairs.

Recall is audited by brute force over more and more vectors, until enough of them were seen to
have links; where that takes all vectors, the links of the brute force are the result. Too low a
recall repeats the work with more overlap, and in the end all links are found by brute force.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, discard, stored

CELL, BLOCK = 400, 2000
SAMPLE, CENTROIDS = 20000, 512
AUDIT, CHUNK, EVIDENCE = 500, 20000, 100
DEGREE, POOL, ALPHA = 24, 48, 1.2
BEAM, MARGIN, MEDOIDS = 16, 0.10, 4


def unit(vectors) -> np.ndarray:
    """Rows of length one; scaled by the greatest component first, so that no square over- or underflows."""
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _centroids(x: np.ndarray, count: int, rounds: int = 6) -> np.ndarray:
    """k-means from evenly spread rows."""
    c = x[np.linspace(0, len(x) - 1, count).astype(int)].copy()
    for _ in range(rounds):
        near = _nearest(x, c, 1)[:, 0]
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        size = np.bincount(near, minlength=count)[:, None]
        c = np.where(size > 0, total / np.maximum(size, 1), c)
    return c


def _nearest(x: np.ndarray, c: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` nearest rows of ``c`` to each row of ``x``, nearest first."""
    return np.argsort((c * c).sum(1) - 2 * (x @ c.T), axis=1, kind="stable")[:, :count]


def fit_cells(vectors: DataFrame) -> dict[tuple, tuple[np.ndarray, np.ndarray]]:
    """Coarse centroids and residuals of the groups of ``vectors(label, size, vector)`` that need
    more than one cell, from at most about ``SAMPLE`` rows chosen by hash. A group of n vectors gets
    about n / ``CELL`` cells. Groups too small for a share of the sample are one cell."""
    counts = vectors.groupBy("label", "size").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
    total = counts.agg(F.sum("n")).first()[0]
    if not total:
        return {}
    share = min(1.0, SAMPLE / total)
    rows = vectors.join(counts, ["label", "size"]).where(F.pmod(F.xxhash64("node"), F.lit(1 << 30)) <= int(share * (1 << 30)))
    sample = rows.orderBy("node").limit(2 * SAMPLE).select("label", "size", "n", "vector").toPandas()
    out = {}
    for key, part in sample.groupby(["label", "size"]):
        x = unit(part["vector"])
        wanted = -(-int(part["n"].iloc[0]) // CELL)
        coarse = _centroids(x, min(wanted, CENTROIDS, max(1, len(x) // 4)))
        rest = x - coarse[_nearest(x, coarse, 1)[:, 0]]
        fine = _centroids(rest, min(-(-wanted // len(coarse)), CENTROIDS, max(1, len(x) // 4)))
        out[key] = coarse, fine
    return out


def cells_of(x: np.ndarray, coarse: np.ndarray, fine: np.ndarray, overlap: int) -> np.ndarray:
    """The cells of each row: of its ``overlap`` nearest coarse centroids the nearest residuals."""
    near = _nearest(x, coarse, overlap)
    if len(fine) == 1:
        return near
    return np.stack([near[:, k] * len(fine) + _nearest(x - coarse[near[:, k]], fine, 1)[:, 0] for k in range(near.shape[1])], 1)


def assigned(vectors: DataFrame, cells: dict, overlap: int) -> DataFrame:
    """``vectors`` with ``cells``: those of a vector, ascending."""
    shared = vectors.sparkSession.sparkContext.broadcast(cells)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                found: list[list[int]] = [[0]] * part.num_rows
                by_key: dict[tuple, list[int]] = {}
                for i, key in enumerate(zip(part.column(0).to_pylist(), part.column(1).to_pylist())):
                    if key in shared.value:
                        by_key.setdefault(key, []).append(i)
                for key, own in by_key.items():
                    x = unit(part.column(4).take(pa.array(own)).to_pylist())
                    for i, near in zip(own, np.sort(cells_of(x, *shared.value[key], overlap), axis=1).tolist()):
                        found[i] = near
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.list_(pa.int32()))], names=[*part.schema.names, "cells"])

    kept = vectors.select("label", "size", "node", "m", "vector")
    return kept.mapInArrow(of, f"label string, size int, node long, m long, vector {kept.schema['vector'].dataType.simpleString()}, cells array<int>")


def robust_prune(x: np.ndarray, degree: int = DEGREE, pool: int = POOL, alpha: float = ALPHA) -> np.ndarray:
    """Neighbours of each row, padded with -1: of its nearest ``pool``, nearest first, those that no
    neighbour kept before is ``alpha`` times nearer to."""
    n = len(x)
    if n < 2:
        return np.full((n, 1), -1)
    sim = x @ x.T
    np.fill_diagonal(sim, -2)
    width = min(pool, n - 1)
    near = np.argpartition(-sim, width - 1, axis=1)[:, :width]
    near = np.take_along_axis(near, np.argsort(-np.take_along_axis(sim, near, 1), axis=1, kind="stable"), 1)
    out = np.full((n, min(degree, width)), -1)
    for at in range(0, n, 256):
        own = near[at: at + 256]
        away = 1 - np.take_along_axis(sim[at: at + 256], own, 1)
        alive, count = np.ones(own.shape, bool), np.zeros(len(own), int)
        for k in range(width):
            rows = np.flatnonzero(alive[:, k] & (count < out.shape[1]))
            out[at + rows, count[rows]] = own[rows, k]
            count[rows] += 1
            alive[rows] &= alpha * (1 - sim[own[rows, k][:, None], own[rows]]) > away[rows]
    return out


def _graph(pdf: pd.DataFrame) -> pd.DataFrame:
    """Adjacency of a block: the pruned edges, and for each the edge back."""
    nodes = pdf["node"].to_numpy()
    lists = robust_prune(unit(pdf["vector"]))
    rows, cols = np.nonzero(lists >= 0)
    a, b = rows, lists[rows, cols]
    pairs = np.unique(np.concatenate((np.stack((a, b), 1), np.stack((b, a), 1))), axis=0)
    cuts = np.searchsorted(pairs[:, 0], np.arange(len(nodes) + 1))
    return pd.DataFrame({"node": nodes, "near": [nodes[pairs[i:j, 1]] for i, j in zip(cuts, cuts[1:])]})


def range_search(x: np.ndarray, starts: np.ndarray, ends: np.ndarray, queries: np.ndarray, own: np.ndarray, least: float) -> np.ndarray:
    """Which rows of ``x`` each query finds at cosine ``least`` or more, as a matrix.

    Greedy with a beam from the medoids and from ``own``, the query's place among the rows (-1 if
    it is none of them), then over the edges of all rows within the margin. The edges of row i are
    ``ends[starts[i]:starts[i + 1]]``. All queries go one step at a time together.
    """
    n = len(x)
    sims = queries @ x.T
    middle = x @ x.mean(0)
    medoids = [int(middle.argmax())]
    far = x @ x[medoids[0]]
    while len(medoids) < min(MEDOIDS, n):
        medoids.append(int(far.argmin()))
        far = np.maximum(far, x @ x[medoids[-1]])
    found, done = np.zeros(sims.shape, bool), np.zeros(sims.shape, bool)
    found[:, medoids] = True
    here = np.flatnonzero(own >= 0)
    found[here, own[here]] = True
    while True:
        reached = np.where(found, sims, -3.0)
        bar = np.partition(reached, n - BEAM, axis=1)[:, n - BEAM] if n > BEAM else np.full(len(queries), -2.0)
        open_ = found & ~done & (sims >= np.maximum(bar, -2.0)[:, None])
        if not open_.any():
            open_ = found & ~done & (sims >= least - MARGIN)
            if not open_.any():
                return found & (sims >= least)
        done |= open_
        rows, cols = np.nonzero(open_)
        sizes = starts[cols + 1] - starts[cols]
        at = np.repeat(starts[cols] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        found[np.repeat(rows, sizes), ends[at]] = True


LINKS = "node long, n long, root long"


def _forest(hit: np.ndarray, ids: np.ndarray, q_ids: np.ndarray, n: np.ndarray) -> pd.DataFrame:
    """``node, n, root`` of queries that have ``n`` links and of both sides' members that are joined
    by ``hit`` (queries by rows): each with the least node that it reaches here."""
    low, q_low = ids.copy(), q_ids.copy()
    if hit.any():
        rows, cols = np.nonzero(hit)
        order = np.argsort(cols, kind="stable")
        row_cuts = np.flatnonzero(np.diff(rows, prepend=-1))
        col_cuts = np.flatnonzero(np.diff(cols[order], prepend=-1))
        every, back = np.unique(np.concatenate((ids, q_ids)), return_inverse=True)
        while True:
            before = low, q_low
            q_low, low = q_low.copy(), low.copy()
            q_low[rows[row_cuts]] = np.minimum(q_low[rows[row_cuts]], np.minimum.reduceat(low[cols], row_cuts))
            low[cols[order][col_cuts]] = np.minimum(low[cols[order][col_cuts]], np.minimum.reduceat(q_low[rows[order]], col_cuts))
            both = every.copy()
            np.minimum.at(both, back, np.concatenate((low, q_low)))  # a node on both sides is one
            low, q_low = both[back[: len(ids)]], both[back[len(ids):]]
            if (low == before[0]).all() and (q_low == before[1]).all():
                break
    out = pd.DataFrame({"node": np.concatenate((q_ids, ids)), "n": np.concatenate((n, np.zeros(len(ids)))), "root": np.concatenate((q_low, low))}).astype("int64")
    return out[(out["n"] > 0) | (out["root"] != out["node"])]


def _searcher(least: float):
    """Of a block: what those that ask find in it."""
    def of(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        cell = key[2]
        nodes, asks = pdf[pdf["near"].notna()], pdf[pdf["asks"]]
        ids, q_ids = nodes["node"].to_numpy(), asks["node"].to_numpy()
        if not len(ids) or not len(q_ids):
            return pd.DataFrame({c: np.zeros(0, np.int64) for c in ("node", "n", "root")})
        order = np.argsort(ids)
        flat = np.concatenate([np.asarray(v, np.int64) for v in nodes["near"]])
        owner = np.repeat(np.arange(len(ids)), [len(v) for v in nodes["near"]])
        at = np.minimum(np.searchsorted(ids, flat, sorter=order), len(ids) - 1)
        place = order[at]
        here = ids[place] == flat
        starts, ends = np.searchsorted(owner[here], np.arange(len(ids) + 1)), place[here]
        at = order[np.minimum(np.searchsorted(ids, q_ids, sorter=order), len(ids) - 1)]
        own = np.where(ids[at] == q_ids, at, -1)
        m = nodes["m"].to_numpy()
        x, q = unit(nodes["vector"]), unit(asks["vector"])
        mine = lambda side: np.array([[c in own_cells for c in others] for own_cells in map(set, side)], np.float32).reshape(len(side), -1)
        others = sorted({c for v in nodes["cells"] for c in v if c < cell})
        earlier, q_earlier = mine(nodes["cells"]), mine(asks["cells"])
        hit, n = np.zeros((len(q_ids), len(ids)), bool), np.zeros(len(q_ids))
        for a in range(0, len(q_ids), 500):
            found = range_search(x, starts, ends, q[a: a + 500], own[a: a + 500], least)
            rows = np.flatnonzero(own[a: a + 500] >= 0)
            found[rows, own[a: a + 500][rows]] = False
            hit[a: a + 500] = found
            n[a: a + 500] = (found & ~(q_earlier[a: a + 500] @ earlier.T > 0)) @ m
        return _forest(hit, ids, q_ids, n)
    return of


def graph_links(vectors: DataFrame, least: float, overlap: int) -> DataFrame:
    """``node, n, root`` of ``vectors(label, size, node, m, vector)``, several rows a node: how many
    others it was found to link with, and the least node linked with it."""
    dealt = stored(assigned(vectors, fit_cells(vectors), overlap), "cells")
    shard = ["label", "size", "cell"]
    members = dealt.withColumn("cell", F.explode("cells"))
    # Cells that vectors crowd are cut in blocks of bounded size; each block is asked by all of them.
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    counts = members.groupBy(*shard).agg(F.count("*").alias("members")).select(*shard, blocks.alias("blocks"))
    members = members.join(counts, shard).withColumn("block", F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")).cast("int"))
    graphs = members.groupBy(*shard, "block").applyInPandas(_graph, "node long, near array<long>")
    united = graphs.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    asked = members.join(united, "node").select(
        *shard, "node", "m", "vector", "cells", "near", "block",
        F.explode(F.when(F.col("blocks") == 1, F.array(F.struct(F.lit(0).alias("of"), F.lit(0).alias("part"), F.lit(True).alias("asks"), F.lit(True).alias("here"))))
                  .otherwise(F.concat(
                      F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.struct(F.col("block").alias("of"), i.alias("part"), F.lit(False).alias("asks"), F.lit(True).alias("here"))),
                      F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.struct(i.alias("of"), F.col("block").alias("part"), F.lit(True).alias("asks"), F.lit(False).alias("here")))))).alias("at"))
    asked = asked.select(*shard, "node", "m", "vector", "cells", F.when(F.col("at.here"), F.col("near")).alias("near"), "at.of", "at.part", "at.asks")
    out = stored(asked.groupBy(*shard, "of", "part").applyInPandas(_searcher(least), LINKS), "links")
    discard(dealt)
    return out


def true_links(vectors: DataFrame, asked: DataFrame, least: float) -> DataFrame:
    """As :func:`graph_links` for the nodes ``asked``, by brute force against all ``vectors``.
    What is asked goes through the driver, so it is a bounded part of the vectors."""
    asked = asked.select("label", "size", "node", "vector").toPandas()
    groups = {k: (p["node"].to_numpy(), unit(p["vector"])) for k, p in asked.groupby(["label", "size"])}
    shared = vectors.sparkSession.sparkContext.broadcast(groups)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, part in b.to_pandas().groupby(["label", "size"]):
                if key in shared.value:
                    q_ids, q = shared.value[key]
                    ids, m, x = part["node"].to_numpy(), part["m"].to_numpy(), unit(part["vector"])
                    step = max(1, (1 << 22) // len(q))
                    for at in range(0, len(x), step):
                        hit = (q @ x[at: at + step].T >= least) & (q_ids[:, None] != ids[None, at: at + step])
                        if hit.any():
                            yield pa.RecordBatch.from_pandas(_forest(hit, ids[at: at + step], q_ids, hit @ m[at: at + step]), preserve_index=False)

    return stored(vectors.select("label", "size", "node", "m", "vector").mapInArrow(of, LINKS), "true")


def draws(vectors: DataFrame) -> Iterator[DataFrame]:
    """All of ``vectors``, in parts by hash: about ``AUDIT`` nodes, then about ``CHUNK`` at a time."""
    n, low, step = max(1, vectors.count()), 0, AUDIT
    place = F.pmod(F.xxhash64("node", F.lit(3)), F.lit(1 << 40))
    while low < 1 << 40:
        high = min(1 << 40, low + max(1, (step << 40) // n))
        yield vectors.where((place >= low) & (place < high))
        low, step = high, CHUNK


def exact_links(vectors: DataFrame, least: float) -> DataFrame:
    """As :func:`graph_links`, by brute force."""
    return reduce(DataFrame.unionByName, [true_links(vectors, asked, least) for asked in draws(vectors)])


def audit(vectors: DataFrame, links: DataFrame, least: float) -> float | None:
    """Recall of ``links``, as the mean over nodes that have true links of the share found. Nodes
    are drawn until ``EVIDENCE`` of them have links; None where all nodes together are fewer."""
    have = links.groupBy("node").agg(F.sum("n").alias("found"))
    n, total = 0, 0.0
    for asked in draws(vectors):
        true = true_links(vectors, asked, least)
        wanted = true.groupBy("node").agg(F.sum("n").alias("wanted")).where("wanted > 0")
        share = wanted.join(have, "node", "left").select((F.coalesce("found", F.lit(0)) / F.col("wanted")).alias("share"))
        row = share.agg(F.count("*").alias("n"), F.coalesce(F.sum("share"), F.lit(0.0)).alias("total")).first()
        discard(true)
        n, total = n + row.n, total + row.total
        if n >= EVIDENCE:
            return total / n
    return None


def near_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.93,
                 overlap: int = 2, target: float = 0.97) -> DataFrame:
    """``id_col, n_links, component_id, kept, recall`` for every row.

    Rows link if labels (of any type) are equal and not null, vectors have one length and the
    cosine, in double precision, is at least ``least``. Vectors that are null, empty, zero, or hold
    null or non-finite numbers link with nothing. Equal vectors of a label are one node with a
    count, so copies are not paired; each row counts as a vector of its own, also where ids repeat
    or are null. ``component_id`` is the smallest id reachable (null only where none has an id).
    ``recall`` is the audited one, at least ``target``, and null where all links were found by brute
    force. Empty in, empty out; other columns are ignored.
    """
    finite = (F.size(vector_col) > 0) & F.forall(vector_col, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists(vector_col, lambda v: v != 0)
    fit = F.coalesce(F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & finite, F.lit(False))
    single = rows.schema[vector_col].dataType.elementType.typeName() == "float"
    vector = F.col(vector_col).cast("array<float>" if single else "array<double>")
    marked = stored(rows.select(F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("label"), vector.alias("vector"), fit.alias("fit"))
                    .withColumn("node", F.when(F.col("fit"), F.xxhash64("label", "vector"))), "vectors")
    nodes = stored(marked.where("fit").groupBy("node").agg(F.min("id").alias("first"), F.count("*").alias("m"), F.first("label").alias("label"), F.first("vector").alias("vector"))
                   .withColumn("size", F.size("vector")), "nodes")
    while True:
        links = graph_links(nodes, least, overlap)
        recall = audit(nodes, links, least)
        if recall is not None and recall >= target:
            break
        if recall is None or overlap >= 12:
            links, recall = exact_links(nodes, least), None
            break
        discard(links)
        overlap *= 2
    linked = links.groupBy("node").agg(F.sum("n").alias("n"))
    found = components(links.select(F.col("node").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "_node")
    known = nodes.join(linked, "node", "left").join(found, F.col("node") == F.col("_node"), "left").select(
        "node", "first", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    known = stored(known, "known")
    least_id = known.groupBy("component").agg(F.min("first").alias("component_id"))
    by_node = known.join(least_id, "component").select(F.col("node").alias("_node"), "n_links", "component_id")
    out = marked.join(by_node, F.col("node") == F.col("_node"), "left")
    component = F.coalesce(F.when(F.col("fit"), F.col("component_id")), F.col("id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"), F.lit(recall).cast("double").alias("recall"))


def op10_embedding_graph(spark, sf_dir):
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))
