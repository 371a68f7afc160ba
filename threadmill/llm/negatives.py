"""Hard negatives from embeddings by best-first search in STR-packed R-trees.

Vectors are whole numbers, floor(SCALE * x), and a row's score for an anchor
is their integer inner product.  Rows are dealt by a hash of their id into
blocks of bounded size; a block's task packs one R-tree for each label it
holds, by sort-tile-recurse: rows are cut into slabs by their most spread
coordinate, each slab by the next one, and so on down to leaves of LEAF rows;
runs of FAN boxes make the boxes of the next level.

For an anchor a, a box [lo, hi] allows in coordinate j the products between
a_j lo_j and a_j hi_j; the sums of the smaller and of the larger ones bound
the scores of every row inside.  A search keeps a queue of boxes, the one
with the best possible row first, and never opens a box

* whose bounds lie outside the score window, all above it or all below it, or
* that cannot hold a row better than the k-th found: its bound is strictly
  below the k-th score, or equal to it with no smaller id inside.

Two rounds over the blocks: the first finds every anchor's positives - in the
trees of its own label - and the second, in the trees of all other labels, the
best rows of the score windows of all its positives at once.  Anchors are a stated query set;
each block of them meets each block of rows once a round, and a grouped top k
joins what the blocks found.

Defined results: rows without an id or a label, without a vector, with an
empty one, or with null or non-finite parts take no part; neither do rows
whose scaled parts are so large (dim * max^2 >= 2^53) that products are no
longer exact numbers; vectors of another length than the anchor's are not its
candidates; an anchor's own id is not its candidate; rows that share an id are
candidates each, and as an anchor the smallest (label, vector) of them
counts; equal scores are ordered by id; anchors without positives, and
positives without negatives, return nothing; no anchor, no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.rank import top_n_per_group
from .base import stored, trim

#: Rows of a leaf, boxes of a box, and what floats are multiplied by.
LEAF, FAN, SCALE = 256, 16, 256
#: Rows of a block at least and at most, and anchors of an anchor block.
MIN_ROWS, MAX_ROWS, MAX_ANCHORS = 8192, 65_536, 1024
POSITIVES, NEGATIVES = 5, 3
#: A negative's score lies between these percentages of its positive's.
LOW, HIGH = 50, 95


def str_order(x: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The rows of ``x`` in sort-tile-recurse order: runs of ``leaf`` rows are tiles of the most spread coordinates."""
    spread = np.argsort(-x.std(axis=0), kind="stable")
    out = np.empty(len(x), np.int64)

    def tile(rows: np.ndarray, level: int, at: int) -> None:
        pages = -(-len(rows) // leaf)
        if pages <= 1 or level == len(spread):
            out[at:at + len(rows)] = rows
            return
        slabs = int(np.ceil(pages ** (1 / (len(spread) - level))))
        rows = rows[np.argsort(x[rows, spread[level]], kind="stable")]
        size = -(-pages // slabs) * leaf
        for start in range(0, len(rows), size):
            tile(rows[start:start + size], level + 1, at + start)

    tile(np.arange(len(x)), 0, 0)
    return out


class Forest:
    """One packed R-tree per label, their boxes in flat arrays: a box's children, and a leaf's rows, are a range."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, labels: np.ndarray, leaf: int = LEAF, fan: int = FAN):
        rows, low, high, least, first, last, level = [], [], [], [], [], [], []
        self.roots: dict[int, int] = {}
        n_rows = n_boxes = 0
        for label in np.unique(labels).tolist():
            at = np.flatnonzero(labels == label)
            at = at[str_order(x[at], leaf)]
            rows.append(at)
            here = x[at], x[at], ids[at]
            start, size, height = n_rows, leaf, 0
            while True:
                edges = np.arange(0, len(here[0]), size)
                first.append(start + edges)
                last.append(start + np.append(edges[1:], len(here[0])))
                level.append(np.full(len(edges), height))
                here = (np.minimum.reduceat(here[0], edges), np.maximum.reduceat(here[1], edges),
                        np.minimum.reduceat(here[2], edges))
                for flat, column in zip((low, high, least), here):
                    flat.append(column)
                start, n_boxes = n_boxes, n_boxes + len(edges)
                size, height = fan, height + 1
                if len(edges) == 1:
                    break
            n_rows += len(at)
            self.roots[label] = n_boxes - 1
        order = np.concatenate(rows)
        self.ids, self.x = ids[order], x[order]
        self.low, self.high = np.concatenate(low), np.concatenate(high)
        self.least, self.level = np.concatenate(least).tolist(), np.concatenate(level).tolist()
        self.first, self.last = np.concatenate(first).tolist(), np.concatenate(last).tolist()

    def bounds(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(anchors x boxes) smallest and largest possible scores."""
        up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
        return up @ self.low.T + down @ self.high.T, up @ self.high.T + down @ self.low.T


class Windows:
    """The best k (score, id) of some score windows; higher scores, then smaller ids, are better."""

    def __init__(self, k: int, spans: list[tuple[float, float]]):
        self.k, self.spans = k, spans
        self.low, self.high = (np.array(c, float) for c in zip(*spans))
        self.top = max(high for _, high in spans)
        #: per window the worst (score, id) among its k, once there are k
        self.worst = [(-np.inf, np.inf)] * len(spans)
        self.rows: list[list[tuple[int, int]]] = [[] for _ in spans]

    def wants(self, smallest: float, largest: float, least: int) -> bool:
        """Some window can still take a row with a score between the bounds and an id from ``least`` on."""
        for (low, high), (score, own) in zip(self.spans, self.worst):
            if largest >= low and smallest <= high:
                reach = largest if largest < high else high
                if reach > score or reach == score and least <= own:
                    return True
        return False

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        floor = np.maximum(self.low, [score for score, _ in self.worst])
        keep = (scores >= floor[:, None]) & (scores <= self.high[:, None])
        for w in np.flatnonzero(keep.any(axis=1)).tolist():
            new, own = scores[keep[w]], ids[keep[w]]
            if len(new) > self.k:
                top = np.lexsort((own, -new))[:self.k]
                new, own = new[top], own[top]
            rows = self.rows[w] + list(zip(map(int, new.tolist()), own.tolist()))
            self.rows[w] = rows = sorted(rows, key=lambda r: (-r[0], r[1]))[:self.k]
            if len(rows) == self.k:
                self.worst[w] = rows[-1]


def search(forest: Forest, roots: list[int], smallest: np.ndarray, largest: np.ndarray, anchor: np.ndarray,
           own_id: int, windows: Windows) -> int:
    """Best-first over the trees of ``roots``, given the anchor's bounds of all boxes; returns the leaves opened."""
    smallest, largest, least = smallest.tolist(), largest.tolist(), forest.least
    queue: list = []

    def push(box: int) -> None:
        if windows.wants(smallest[box], largest[box], least[box]):
            heapq.heappush(queue, (-min(largest[box], windows.top), least[box], box))

    for root in roots:
        push(root)
    opened = 0
    while queue:
        box = heapq.heappop(queue)[2]
        # what its windows have found since it was queued may close it
        if not windows.wants(smallest[box], largest[box], least[box]):
            continue
        if forest.level[box]:
            for child in range(forest.first[box], forest.last[box]):
                push(child)
        else:
            rows = slice(forest.first[box], forest.last[box])
            ids, scores = forest.ids[rows], forest.x[rows] @ anchor
            opened += 1
            if least[box] <= own_id:
                scores[ids == own_id] = np.nan  # never wanted: no comparison holds
            windows.add(ids, scores)
    return opened


def _matrix(column) -> np.ndarray:
    return np.array([np.asarray(v, np.float64) for v in column], np.float64)


def _forest(rows: pd.DataFrame, anchors: np.ndarray) -> tuple[Forest, np.ndarray, np.ndarray]:
    """The trees of a block, and the bounds of their boxes for all ``anchors``."""
    forest = Forest(rows["id"].to_numpy(np.int64), _matrix(rows["vec"]), rows["label"].to_numpy(np.int64))
    return forest, *forest.bounds(anchors)


def positives_block(rows: pd.DataFrame, asked: pd.DataFrame, k: int) -> pd.DataFrame:
    """(anchor_id, id, score): the ``k`` best rows of each anchor's label in this block."""
    anchors = _matrix(asked["vec"])
    forest, smallest, largest = _forest(rows, anchors)
    found = []
    for i, (own, label) in enumerate(zip(asked["id"].tolist(), asked["label"].tolist())):
        if label in forest.roots:
            best = Windows(k, [(-np.inf, np.inf)])
            search(forest, [forest.roots[label]], smallest[i], largest[i], anchors[i], own, best)
            found += [(own, r, score) for score, r in best.rows[0]]
    return pd.DataFrame(found, columns=["anchor_id", "id", "score"]).astype("int64")


def negatives_block(rows: pd.DataFrame, asked: pd.DataFrame, k: int, low: int, high: int) -> pd.DataFrame:
    """(anchor_id, positive_id, positive_score, id, score): the ``k`` best of each positive's window in this block.

    ``asked`` has the anchors' positives as arrays ``positive_ids`` and ``positive_scores``.
    """
    anchors = _matrix(asked["vec"])
    forest, smallest, largest = _forest(rows, anchors)
    found = []
    for i, (own, label, ids, scores) in enumerate(zip(asked["id"].tolist(), asked["label"].tolist(),
                                                      asked["positive_ids"], asked["positive_scores"])):
        pairs = [(int(p), int(s)) for p, s in zip(ids, scores)]
        windows = Windows(k, [(-(-low * s // 100), high * s // 100) for _, s in pairs])
        roots = [box for other, box in forest.roots.items() if other != label]
        search(forest, roots, smallest[i], largest[i], anchors[i], own, windows)
        for (positive, score), best in zip(pairs, windows.rows):
            found += [(own, positive, score, r, s) for s, r in best]
    return pd.DataFrame(found, columns=["anchor_id", "positive_id", "positive_score", "id", "score"]).astype("int64")


def usable(df: DataFrame, label: Column, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(id, label, dim, vec): the rows that take part, their vectors as whole numbers (held as doubles)."""
    vec = F.col(vec_col).cast("array<double>")
    whole = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = F.transform(vec, lambda x: x * float(scale))
    rows = (df.select(F.col(id_col).cast("bigint").alias("id"), label.cast("bigint").alias("label"), scaled.alias("vec"))
            .where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull()
                   & (F.size("vec") > 0)).where(whole))
    # doubles are whole from 2^53 on, and such rows go next
    small = F.transform("vec", lambda x: F.when(F.abs(x) < float(1 << 53), F.floor(x).cast("double")).otherwise(x))
    exact = F.size("vec") * F.pow(F.array_max(F.transform("vec", F.abs)), F.lit(2.0)) < float(1 << 53)
    return rows.withColumn("vec", small).where(exact).select("id", "label", F.size("vec").alias("dim"), "vec")


def _dealt(rows: DataFrame, anchors: DataFrame, row_blocks: int, anchor_blocks: int) -> DataFrame:
    """Every block of rows next to every block of anchors; role 1 are the anchors."""
    extra = [c for c in anchors.columns if c not in rows.columns]
    none = [F.lit(None).cast(anchors.schema[c].dataType).alias(c) for c in extra]
    cols = ["id", "label", "dim", "vec", *extra]
    a = rows.select(*rows.columns, *none).select(
        *cols, F.lit(0).alias("role"), F.pmod(F.xxhash64("id"), F.lit(row_blocks)).cast("int").alias("rb"),
        F.explode(F.sequence(F.lit(0), F.lit(anchor_blocks - 1))).alias("ab"))
    b = anchors.select(
        *cols, F.lit(1).alias("role"), F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))).alias("rb"),
        F.pmod(F.xxhash64("id", F.lit(1)), F.lit(anchor_blocks)).cast("int").alias("ab"))
    return a.unionByName(b)


def mine(df: DataFrame, is_anchor: Column, label: Column | None = None, positives: int = POSITIVES,
         negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, id_col: str = "vec_id",
         vec_col: str = "embedding", label_col: str = "label", scale: int = SCALE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); ``is_anchor`` is over ``id``.

    ``label``: an expression over ``df`` to use instead of ``label_col``.
    """
    if positives < 1 or negatives < 1:
        raise ValueError("at least one positive and one negative are asked for")
    spark = df.sparkSession
    rows = stored(usable(df, F.col(label_col) if label is None else label, id_col, vec_col, scale))
    anchors = stored(rows.where(is_anchor).groupBy("id").agg(F.min(F.struct("label", "dim", "vec")).alias("a"))
                     .select("id", "a.*"))
    n, n_anchors = rows.count(), anchors.count()
    per_block = min(MAX_ROWS, max(MIN_ROWS, n // (4 * spark.sparkContext.defaultParallelism)))
    blocks = max(1, -(-n // per_block)), max(1, -(-n_anchors // MAX_ANCHORS))

    def sides(f: pd.DataFrame):
        a, b = f[f["role"] == 0], f[f["role"] == 1]
        return (a, b) if len(a) and len(b) else None

    def first(f: pd.DataFrame) -> pd.DataFrame:
        both = sides(f)
        out = positives_block(*both, positives) if both else pd.DataFrame(
            columns=["anchor_id", "id", "score"]).astype("int64")
        trim()
        return out

    def second(f: pd.DataFrame) -> pd.DataFrame:
        both = sides(f)
        out = negatives_block(*both, negatives, low, high) if both else pd.DataFrame(
            columns=["anchor_id", "positive_id", "positive_score", "id", "score"]).astype("int64")
        trim()
        return out

    order = [F.col("score").desc(), F.col("id").asc()]
    groups = ["dim", "rb", "ab"]
    near = _dealt(rows, anchors, *blocks).groupBy(*groups).applyInPandas(first, "anchor_id long, id long, score long")
    # at most ``positives`` rows an anchor
    chosen = stored(top_n_per_group(near, ["anchor_id"], order, positives, rank_col="rank")
                    .groupBy(F.col("anchor_id").alias("id"))
                    .agg(F.array_sort(F.collect_list(F.struct("rank", F.col("id").alias("p"), "score"))).alias("ps"))
                    .select("id", F.transform("ps", lambda p: p["p"]).alias("positive_ids"),
                            F.transform("ps", lambda p: p["score"]).alias("positive_scores")))
    hard = (_dealt(rows, anchors.join(chosen, "id"), *blocks).groupBy(*groups)
            .applyInPandas(second, "anchor_id long, positive_id long, positive_score long, id long, score long"))
    best = top_n_per_group(hard, ["anchor_id", "positive_id", "positive_score"], order, negatives, rank_col="rank")
    return best.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
                       F.col("score").alias("negative_score"))
