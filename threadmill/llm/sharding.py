"""Rendezvous (highest random weight) hashing of stable record keys over weighted shards.

Every (key, shard) pair has a hash; a record goes to the shard with the
largest ``weight / -ln(u)``, where ``u`` in (0, 1) is that hash.  A shard's
share is proportional to its weight, and a record's shard depends on its key
and the shard list alone.  One more shard changes only the records that the
new shard itself wins; one shard less moves only that shard's records.

All of it is column expressions: no Python runs on executors and the text is
never shuffled.  Slots need an order inside each shard; a shard is cut into
cells by a second hash of the key, cells of a few thousand rows are numbered
on their own, and the cells' row counts give each cell's first slot.  Equal
records repeat their key, so the copies of one record share a cell; order
inside a cell is by (key, ``tie`` columns), and fully equal rows are
interchangeable.

Defined results: a null key counts as one key of its own; repeated keys share
a shard and get different slots; an empty table gives an empty table; a shard
with weight 0 takes no rows; input columns named like an output column are
replaced by the output.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one cell; a cell is numbered inside one task.
CELL_ROWS = 4096


def shard_score(key: Column, shard: int, weight: float) -> Column:
    """``weight / -ln(u)`` with ``u`` from the top 53 bits of a 64-bit hash of (key, shard)."""
    h = F.xxhash64(F.concat(key, F.lit(f"|{shard}")))
    u = (F.shiftrightunsigned(h, 11).cast("double") + F.lit(0.5)) * F.lit(2.0 ** -53)
    return F.lit(float(weight)) / -F.log(u)


def shard_of(key: Column, weights: Mapping[int, float]) -> Column:
    """The winning shard of each key; ties of scores go to the smaller shard number."""
    live = {s: w for s, w in sorted(weights.items()) if w > 0}
    if not live:
        raise ValueError("at least one shard needs a positive weight")
    entries = [F.struct(shard_score(key, s, w).alias("score"), F.lit(-s).alias("neg")) for s, w in live.items()]
    return (-F.array_max(F.array(*entries))["neg"]).cast("int")


def key_text(col: str) -> Column:
    return F.coalesce(F.concat(F.lit("k"), F.col(col).cast("string")), F.lit("null"))


def assign(df: DataFrame, key_col: str, weights: Mapping[int, float], shard_col: str = "shard") -> DataFrame:
    """``df`` with the shard of every row."""
    return df.withColumn(shard_col, shard_of(key_text(key_col), weights))


def with_slots(df: DataFrame, key_col: str, shard_col: str = "shard", slot_col: str = "slot",
               tie: Sequence[str] = (), n_rows: int | None = None, n_shards: int = 16) -> DataFrame:
    """Number the rows of every shard from 0 without a gap.

    ``n_rows`` (counted when not given) sets the number of cells of a shard so
    that a cell holds about CELL_ROWS rows at any input size.
    """
    n = df.count() if n_rows is None else n_rows
    cells = max(1, -(-n // (n_shards * CELL_ROWS)))
    cell, first = "__cell", "__first"
    placed = df.withColumn(cell, F.pmod(F.xxhash64(key_text(key_col), F.lit("cell")), F.lit(cells)).cast("int"))
    here = Window.partitionBy(shard_col, cell).orderBy(F.col(key_col), *tie)
    numbered = placed.withColumn(slot_col, F.row_number().over(here))
    before = (Window.partitionBy(shard_col).orderBy(cell)
              .rowsBetween(Window.unboundedPreceding, -1))
    firsts = (placed.groupBy(shard_col, cell).agg(F.count(F.lit(1)).alias("__n"))
              .withColumn(first, F.coalesce(F.sum("__n").over(before), F.lit(0)))
              .drop("__n"))
    return (numbered.join(firsts, [shard_col, cell])
            .withColumn(slot_col, F.col(first) + F.col(slot_col) - 1)
            .drop(cell, first))


def write_shards(df: DataFrame, path: str, shard_col: str = "shard") -> None:
    """One folder per shard; large shards are split over several files."""
    df.hint("rebalance", shard_col).write.partitionBy(shard_col).parquet(path)
