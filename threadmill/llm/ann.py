"""Nearest vectors by cosine from randomly rotated one-bit codes.

Every unit vector is padded with zeros to the code length B, rotated by one
seeded random orthogonal matrix, and kept as the signs of its parts (packed
bits) and one number, its inner product with the sign vector.  For a rotated
query the inner product with the sign vector, divided by that number, is an
unbiased estimate of the cosine, and its error is at most

    z * sqrt((1 - f^2) / f^2) / sqrt(B - 1)

with a probability that ``z`` sets.  Estimates and bounds come from the codes
alone; a vector is looked at itself only if its upper bound reaches what the
query's k-th best vector is known to have (the k-th best exact cosine so far,
or lower bound, whichever is higher).  The returned scores are exact cosines
in double precision.

The query set is a stated part of the table.  It meets all rows in blocks:
the codes in blocks of bounded size, the queries in blocks of bounded size,
each pair of blocks one task, which returns k rows per query; a grouped top-k
over those ends the search.  Blocks are dealt by a hash of the id, so a vector
that many rows share makes no hot block, and no candidate is dropped for
being one of many.

Defined results: see vectors.py for vectors that take no part; a query is not
its own candidate, but equal vectors of other ids are candidates; equal scores
are ordered by id; with fewer than k candidates all are returned; vectors of
another length than the query's are not candidates; no query, no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import vectors as V
from .base import stored

SEED = 11
#: Code bits: four for each part of the vector, in whole 64-bit words.
BITS_PER_PART = 4
#: Standard errors that the bound allows for.
Z = 3.0
#: Rows of a code block at least and at most, and queries of a query block.
MIN_ROWS, MAX_ROWS, MAX_QUERIES = 2048, 65_536, 2048


def code_bits(dim: int) -> int:
    return max(128, -(-dim * BITS_PER_PART // 64) * 64)


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """The first ``dim`` columns of a random orthogonal B x B matrix, transposed: maps parts to B rotated ones."""
    bits = code_bits(dim)
    q, r = np.linalg.qr(np.random.default_rng([seed, bits]).standard_normal((bits, bits)))
    return (q * np.sign(np.diag(r)))[:, :dim].T.copy()


def encode(x: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign bits (n x B/8) and each row's inner product with its own sign vector."""
    rotated = V.scaled(x) @ turn
    return (np.packbits(rotated > 0, axis=1),
            np.abs(rotated).sum(axis=1) / np.sqrt(rotated.shape[1]))


def estimates(codes: np.ndarray, factor: np.ndarray, queries: np.ndarray, z: float) -> tuple[np.ndarray, np.ndarray]:
    """(queries x rows) estimated cosines, and each row's error bound; ``queries`` are rotated unit vectors."""
    bits = queries.shape[1]
    signs = np.unpackbits(codes, axis=1).astype(np.float32) * 2 - 1
    raw = (queries.astype(np.float32) @ signs.T) / np.float32(np.sqrt(bits))
    error = z * np.sqrt(np.maximum(0.0, 1 - factor ** 2)) / factor / np.sqrt(bits - 1) + 1e-5
    return raw / factor.astype(np.float32), error.astype(np.float32)


def index(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Every usable vector with its code: id, dim, vec, code, factor."""
    rows = V.by_id(df, id_col, vec_col).where(V.usable()).select("id", F.size("vec").alias("dim"), "vec")

    def run(frames):
        turns = {}
        for f in frames:
            f = f.reset_index(drop=True)
            codes, factor = [b""] * len(f), np.zeros(len(f))
            for dim, at in f.groupby("dim").indices.items():
                if dim not in turns:
                    turns[dim] = rotation(dim)
                c, factor[at] = encode(V.matrix(f["vec"].iloc[at]), turns[dim])
                for k, row in zip(at, c):
                    codes[k] = row.tobytes()
            yield f.assign(code=codes, factor=factor)

    return rows.mapInPandas(run, "id long, dim int, vec array<double>, code binary, factor double")


def search_block(rows: pd.DataFrame, queries: pd.DataFrame, k: int, z: float) -> pd.DataFrame:
    """The ``k`` best of ``rows`` for each of ``queries``, with exact scores."""
    rows, queries = rows.sort_values("id"), queries.sort_values("id")
    ids, vecs = rows["id"].to_numpy(), V.matrix(rows["vec"])
    codes = np.frombuffer(b"".join(rows["code"]), np.uint8).reshape(len(rows), -1)
    factor = rows["factor"].to_numpy()
    own, asked = queries["id"].to_numpy(), V.matrix(queries["vec"])
    turned = V.scaled(asked) @ rotation(vecs.shape[1])
    nq = len(own)
    best = [(np.zeros(0), np.zeros(0, np.int64))] * nq
    known = np.full(nq, -np.inf)
    for start in range(0, len(ids), MIN_ROWS):
        part = slice(start, start + MIN_ROWS)
        est, error = estimates(codes[part], factor[part], turned, z)
        est[own[:, None] == ids[part][None, :]] = -np.inf
        floor = known
        if est.shape[1] >= k:
            lower = est - error[None, :]
            floor = np.maximum(known, np.partition(lower, est.shape[1] - k, axis=1)[:, est.shape[1] - k])
        q, r = np.nonzero(est + error[None, :] >= floor[:, None])
        keep = np.isfinite(est[q, r])
        q, r = q[keep], r[keep]
        exact = np.concatenate([np.zeros(0)] + [V.cosine_pairs(asked[q[s:s + 65536]], vecs[start + r[s:s + 65536]])
                                                for s in range(0, len(q), 65536)])
        bounds = np.searchsorted(q, np.arange(nq + 1))
        for i in range(nq):
            here = slice(bounds[i], bounds[i + 1])
            if here.start == here.stop:
                continue
            score = np.concatenate([best[i][0], exact[here]])
            found = np.concatenate([best[i][1], ids[start + r[here]]])
            order = np.lexsort((found, -score))[:k]
            best[i] = (score[order], found[order])
            if len(order) == k:
                known[i] = score[order[-1]]
    return pd.DataFrame({"query_id": np.repeat(own, [len(b[1]) for b in best]),
                         "vec_id": np.concatenate([b[1] for b in best]),
                         "score": np.concatenate([b[0] for b in best])})


def nearest(df: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vec_col: str = "embedding",
            z: float = Z) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of every row for which ``is_query`` (over ``id``) holds."""
    coded = stored(index(df, id_col, vec_col))
    n, n_queries = coded.agg(F.count(F.lit(1)), F.count_if(is_query)).first()
    spark = df.sparkSession
    per_block = min(MAX_ROWS, max(MIN_ROWS, n // (4 * spark.sparkContext.defaultParallelism)))
    row_blocks, query_blocks = max(1, -(-n // per_block)), max(1, -(-n_queries // MAX_QUERIES))
    h = F.xxhash64("id")
    rows = coded.select("id", "dim", "vec", "code", "factor", F.lit(0).alias("role"),
                        F.pmod(h, F.lit(row_blocks)).cast("int").alias("rb"),
                        F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("qb"))
    queries = coded.where(is_query).select(
        "id", "dim", "vec", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("double").alias("factor"),
        F.lit(1).alias("role"), F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))).alias("rb"),
        F.pmod(F.xxhash64("id", F.lit(1)), F.lit(query_blocks)).cast("int").alias("qb")).select(
        "id", "dim", "vec", "code", "factor", "role", "rb", "qb")

    def run(f: pd.DataFrame) -> pd.DataFrame:
        a, b = f[f["role"] == 0], f[f["role"] == 1]
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype(
                {"query_id": "int64", "vec_id": "int64", "score": "float64"})
        return search_block(a, b, k, z)

    found = (rows.unionByName(queries).groupBy("dim", "rb", "qb")
             .applyInPandas(run, "query_id long, vec_id long, score double"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
