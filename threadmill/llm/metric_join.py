"""Exact join of all vectors whose cosine is at least a threshold, over pivot cells.

On the unit sphere the cosine is a metric question: cosine >= t means a chord
of at most r = sqrt(2 - 2t).  A bounded set of pivots cuts the vectors into
cells (each vector's nearest pivot).  A vector x of cell i visits another cell
j when a member y of j could be within r of it: by the triangle inequality not
if d(x, p_j) > r + the largest distance of j's members from p_j, nor if
d(x, p_j) - d(x, p_i) > 2r; and since chords are Euclidean, not if x is
farther than r from the plane midway between the two pivots.  A linked pair of
two cells therefore visits both ways.

Equal vectors are first gathered into one class (a grouped minimum and count,
so a vector that a third of the rows share is summed before the shuffle).
Cells are dealt out in blocks of bounded rows and bytes, each one packed value
with a bit per vector and cell for the visits.  No vector is copied into the
cells it visits: the blocks are stored once, and a task meets the blocks of two
partitions with each other, reading both from there, so what is stored and
shuffled grows with the vectors and not with their visits.  Of two blocks that
visit each other only the vectors whose bit is set are multiplied, a strip at
a time, in single precision; values within its rounding of the threshold are
decided by the exact measure in double precision, some at a time.  A task
returns per pair of blocks and vector the number of its partners and one edge
to the smallest vector of its connected part - never the list of pairs.

Defined results: see vectors.py for vectors that take no part (they get no
links and are their own component); vectors of different lengths do not
link; equal vectors link with each other; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectors as V
from .base import TASK_ROWS, counted, small_batches, stored, trim
from .components import components, forest

#: Classes per pivot, and the most pivots (they are sent to every task).
PER_PIVOT = 4000
MAX_PIVOTS = 512
#: Rows of a block at most (about: they are dealt by hash), and bytes of its vectors as doubles.
BLOCK = 4096
BLOCK_BYTES = 8 << 20
#: Blocks are stored in so many partitions, or as many as hold so many blocks each; every two partitions make a task.
PARTITIONS = 12
PER_PARTITION = 32
#: Rows whose distances to all pivots are held at once, and products held at once.
VISIT_ROWS = 1024
STRIP = 1 << 20
#: Bytes of unpacked blocks that a Python worker keeps during a task.
KEPT_BYTES = 32 << 20


def _by_dim(batch: pa.RecordBatch):
    """(length, places, matrix) of the batch's vectors, length by length."""
    vec = batch.column(batch.schema.get_field_index("vec"))
    dims = batch.column(batch.schema.get_field_index("dim")).to_numpy()
    for dim in np.unique(dims):
        at = np.flatnonzero(dims == dim)
        yield int(dim), at, vec.take(pa.array(at)).flatten().to_numpy().reshape(len(at), dim)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * (x @ pivots.T)))


def _homes(classes: DataFrame, pivots: dict, keep: list) -> DataFrame:
    """The columns ``keep`` of ``classes`` with home cell and distance."""
    cols = ["dim", "vec", *(c for c in keep if c not in ("dim", "vec"))]

    def run(batches):
        for batch in batches:
            cell, dist = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
            for dim, at, x in _by_dim(batch):
                d = _distances(V.scaled(x), pivots[dim])
                cell[at], dist[at] = d.argmin(axis=1), d.min(axis=1)
            yield pa.RecordBatch.from_arrays([*(batch.column(cols.index(c)) for c in keep), pa.array(cell), pa.array(dist)],
                                             [*keep, "cell", "dist"])
        trim()

    kinds = dict(classes.dtypes)
    return classes.select(*cols).mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in keep) + ", cell int, dist double")


def _visits(x: np.ndarray, home: int, p: np.ndarray, far: np.ndarray, r: float) -> np.ndarray:
    """Which cells the vectors of scaled ``x``, all of cell ``home``, may have partners in."""
    slack = 1e-9
    d = _distances(x, p)
    own = d[:, home][:, None]
    between = _distances(p[home][None, :], p)
    meet = ((d <= r + far[None, :] + slack) & (d - own <= 2 * r + slack)
            & (d * d - own * own <= 2 * between * (r + slack) + 1e-12))
    meet[:, home] = True
    return meet


def _blocks(homes: DataFrame, per_cell: dict, pivots: dict, reach: dict, r: float) -> DataFrame:
    """One row per block: its number, cell, the cells it visits, and its vectors with a bit for each of their visits."""
    first = np.cumsum([0, *per_cell.values()]).tolist()
    places = homes.sparkSession.createDataFrame(  # one row per pivot and length: at most MAX_PIVOTS each
        [(*cell, start, m) for (cell, m), start in zip(per_cell.items(), first)], "dim int, cell int, start long, m int")
    h = F.pmod(F.xxhash64("id"), F.lit(2 ** 31))
    dealt = homes.join(F.broadcast(places), ["dim", "cell"]).select(
        (F.col("start") + h % F.col("m")).alias("block"), "dim", "cell", "id", "copies", "vec")
    schema = pa.schema([("block", pa.int64()), ("dim", pa.int32()), ("cell", pa.int32()), ("visits", pa.list_(pa.int32())),
                        ("ids", pa.binary()), ("copies", pa.binary()), ("bits", pa.binary()), ("kind", pa.string()),
                        ("data", pa.binary())])

    def run(t: pa.Table) -> pa.Table:
        block, dim, cell = (t[c][0].as_py() for c in ("block", "dim", "cell"))
        x = t["vec"].combine_chunks().flatten().to_numpy().reshape(t.num_rows, dim)
        bits, seen = [], np.zeros(len(pivots[dim]), bool)
        for start in range(0, len(x), VISIT_ROWS):
            meet = _visits(V.scaled(x[start:start + VISIT_ROWS]), cell, pivots[dim], reach[dim], r)
            bits.append(np.packbits(meet, axis=1))
            seen |= meet.any(axis=0)
        with np.errstate(over="ignore"):
            short = x.astype(np.float32)
        kept = short if (short == x).all() else x
        out = pa.Table.from_pylist([{
            "block": block, "dim": dim, "cell": cell, "visits": np.flatnonzero(seen).tolist(),
            "ids": t["id"].to_numpy().tobytes(), "copies": t["copies"].to_numpy().tobytes(),
            "bits": np.concatenate(bits).tobytes(), "kind": kept.dtype.str, "data": kept.tobytes()}], schema)
        trim()
        return out

    return dealt.groupBy("block").applyInArrow(
        run, "block long, dim int, cell int, visits array<int>, ids binary, copies binary, bits binary, kind string, data binary")


class _Block:
    """An unpacked block: ids, copies, the vectors as they are stored, and scaled in single precision."""

    def __init__(self, batch: pa.RecordBatch, row: int, side: str):
        def of(name):
            return batch.column(f"{side}_{name}")[row]

        self.block, self.cell, self.dim = (of(c).as_py() for c in ("block", "cell", "dim"))
        self.ids = np.frombuffer(of("ids").as_py(), np.int64)
        self.copies = np.frombuffer(of("copies").as_py(), np.int64)
        self.bits = np.frombuffer(of("bits").as_py(), np.uint8).reshape(len(self.ids), -1)
        self.x = np.frombuffer(of("data").as_py(), of("kind").as_py()).reshape(len(self.ids), self.dim)
        self.unit = np.empty(self.x.shape, np.float32)
        for start in range(0, len(self.x), VISIT_ROWS):
            self.unit[start:start + VISIT_ROWS] = V.scaled(self.x[start:start + VISIT_ROWS].astype(np.float64))
        self.bytes = self.x.nbytes + self.unit.nbytes + self.bits.nbytes + 16 * len(self.ids)

    def visitors(self, cell: int) -> np.ndarray:
        """Places of the vectors that visit a cell."""
        return np.flatnonzero(self.bits[:, cell >> 3] >> (7 - (cell & 7)) & 1)


def _near(a: _Block, b: _Block, at_a: np.ndarray, at_b: np.ndarray, threshold: float):
    """Some at a time, the places (in a, in b) of pairs with cosine >= ``threshold``; inside one block each pair once."""
    same = b is a
    # a sum of dim rounded products of rounded unit vectors is off by less than (dim + 2) / 2^24
    off = (a.dim + 8) * 2.0 ** -23
    u = a.unit if len(at_a) == len(a.unit) else a.unit[at_a]
    w = u if same else b.unit if len(at_b) == len(b.unit) else b.unit[at_b]
    step = max(1, STRIP // max(1, len(w)))
    few = max(1, STRIP // max(8, 2 * a.dim))
    for start in range(0, len(u), step):
        done = start if same else 0  # earlier rows have met these
        c = u[start:start + step] @ w[done:].T
        if same:
            c[np.tri(*c.shape, dtype=bool)] = -2
        hit = np.flatnonzero(c.max(axis=1) >= threshold - off)
        if not len(hit):
            continue
        c = c[hit]
        rows, cols = np.nonzero(c >= threshold - off)
        for first in range(0, len(rows), few):
            i, j = rows[first:first + few], cols[first:first + few]
            sure = c[i, j] >= threshold + off
            i, j = at_a[start + hit[i]], at_b[done + j]
            if not sure.all():
                p = np.flatnonzero(~sure)
                sure[p] = V.cosine_pairs(a.x[i[p]].astype(np.float64), b.x[j[p]].astype(np.float64)) >= threshold
                i, j = i[sure], j[sure]
            if len(i):
                yield i, j


def _join_blocks(a: _Block, b: _Block, threshold: float):
    """(ids, links, heads) of the vectors with links between two blocks (or inside one); None without links."""
    if b is a:
        at_a = at_b = np.arange(len(a.ids))
    else:
        at_a, at_b = a.visitors(b.cell), b.visitors(a.cell)
    ids = None
    for i, j in _near(a, b, at_a, at_b, threshold) if len(at_a) and len(at_b) else ():
        if ids is None:
            ids, copies = (a.ids, a.copies) if b is a else (np.concatenate([a.ids, b.ids]), np.concatenate([a.copies, b.copies]))
            links = np.zeros(len(ids), np.int64)
            order = np.argsort(ids)
            rank = np.empty(len(ids), np.int64)
            rank[order] = root = np.arange(len(ids))  # by id, so the smallest is the head
        if b is not a:
            j = j + len(a.ids)
        links += (np.bincount(i, copies[j], len(ids)) + np.bincount(j, copies[i], len(ids))).astype(np.int64)
        p, q = root[rank[i]], root[rank[j]]
        apart = p != q
        if apart.any():
            pairs = np.unique(np.minimum(p[apart], q[apart]) * len(ids) + np.maximum(p[apart], q[apart]))
            node, head = forest(pairs // len(ids), pairs % len(ids))
            to = np.arange(len(ids))
            to[node] = head
            root = to[root]
    if ids is None:
        return None
    at = np.flatnonzero(links)
    return ids[at], links[at], ids[order[root[rank[at]]]]


def _found(blocks: DataFrame, threshold: float) -> DataFrame:
    """(id, links, head) of every pair of blocks that visit each other.

    Blocks are read from where they are stored, partition against partition: nothing is shuffled for it.
    """
    a, b = (blocks.select(*(F.col(c).alias(f"{side}_{c}") for c in blocks.columns)) for side in "ab")
    pairs = a.hint("shuffle_replicate_nl").join(b, (F.col("a_dim") == F.col("b_dim")) & (F.col("a_block") <= F.col("b_block"))
                                                & F.array_contains("a_visits", F.col("b_cell"))
                                                & F.array_contains("b_visits", F.col("a_cell")))

    def run(batches):
        kept, held, left = {}, 0, None
        for batch in batches:
            for row in range(batch.num_rows):
                k, m = batch.column("a_block")[row].as_py(), batch.column("b_block")[row].as_py()
                if left is None or left.block != k:  # rows of one left block follow each other
                    left = kept.get(k) or _Block(batch, row, "a")
                right = left if m == k else kept.get(m) or _Block(batch, row, "b")
                if m != k and m not in kept and held + right.bytes <= KEPT_BYTES:
                    kept[m] = right
                    held += right.bytes
                out = _join_blocks(left, right, threshold)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["id", "links", "head"])
        kept.clear()
        trim()

    return pairs.drop("a_visits", "b_visits").mapInArrow(run, "id long, links long, head long")


def near_links(df: DataFrame, threshold: float, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Per vector: id, n_links (other vectors with cosine >= ``threshold``), component_id, kept."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be above 0 and at most 1")
    spark = df.sparkSession
    r = math.sqrt(2 - 2 * threshold) + 1e-7
    rows = stored(V.by_id(df, id_col, vec_col))
    good = rows.where(V.usable())
    classes = stored(good.groupBy("vec").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))
                     .select("id", "copies", F.size("vec").alias("dim"), "vec"))
    sizes = {r_["dim"]: r_["n"] for r_ in classes.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    pivots = {}
    for dim, n in sizes.items():
        k = min(MAX_PIVOTS, max(1, n // PER_PIVOT))
        chosen = classes.where(F.col("dim") == dim).orderBy(F.xxhash64("id"), "id").limit(k).collect()
        pivots[dim] = V.scaled(V.matrix([c["vec"] for c in chosen]))
    if not sizes:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("bigint").alias("n_links"),
                           F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    with small_batches(spark, VISIT_ROWS):
        cells = {(c["dim"], c["cell"]): c for c in _homes(classes, pivots, ["dim"]).groupBy("dim", "cell").agg(
            F.count(F.lit(1)).alias("n"), F.max("dist").alias("far")).collect()}  # at most MAX_PIVOTS rows a length
        reach = {d: np.array([cells[d, j]["far"] if (d, j) in cells else -9.0 for j in range(len(p))])
                 for d, p in pivots.items()}
        per_cell = {cell: -(-c["n"] // max(1, min(BLOCK, BLOCK_BYTES // (8 * cell[0])))) for cell, c in cells.items()}
        n = sum(per_cell.values())
        parts = max(min(n, PARTITIONS), -(-n // PER_PARTITION))
        blocks = stored(_blocks(_homes(classes, pivots, ["id", "copies", "dim", "vec"]), per_cell, pivots, reach, r)
                        .repartition(parts))
        found, n = counted(_found(blocks, threshold))
    found = found.coalesce(max(1, -(-n // TASK_ROWS), parts * parts // PER_PARTITION))  # most tasks find little
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    comp = components(found.select(F.col("id").alias("a"), F.col("head").alias("b")))
    of_class = stored(classes.join(links, "id", "left").join(comp.withColumnRenamed("node", "id"), "id", "left")
                      .select("vec", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                              F.coalesce("component", "id").alias("component_id")))
    out = rows.join(of_class, "vec", "left").select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.col(id_col) == F.col("component_id"))
