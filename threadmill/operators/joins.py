"""Join helpers: broadcast only behind a measured size bound.

A side that is small by construction (a keyword list, a product list) is
stored once with a reliable checkpoint and measured: its rows are counted and
their bytes summed.  It is broadcast only within ``max_bytes``, otherwise it is
joined with a normal shuffle join (where AQE's skew-join splitting applies).
Broadcasting it up front keeps the large side from being shuffled at all - a
hot key on the large side then never concentrates in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

MAX_BROADCAST_ROWS = 2_000_000
MAX_BROADCAST_BYTES = 32 * 1024 * 1024


def broadcast_if(df: DataFrame, n_rows: int, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """``df`` broadcast-hinted when the measured ``n_rows`` is within the bound.

    Only for rows of a fixed width (ids, numbers); see ``small_side`` for text.
    """
    return F.broadcast(df) if n_rows <= max_rows else df


def measured_bytes(df: DataFrame) -> int:
    """Rows as JSON text plus 16 bytes each: an upper estimate of the rows in memory."""
    text = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))
    return df.agg(F.sum(F.octet_length(text) + 16)).first()[0] or 0


def common_first_join(df: DataFrame, side: DataFrame, key: str, how: str = "inner", freq: str = "n",
                      max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """``df`` joined ("inner" or "left") with ``side``, which has one row per ``key`` and in ``freq`` how often ``df`` has it.

    Both are read more than once, so they should be stored.  What fits within ``max_bytes`` is
    broadcast, the most frequent keys first: their rows of ``df`` stay in the
    order and the tasks they are in.  Only rows of the rarer keys are shuffled.
    ``freq`` is dropped.
    """
    out = [c for c in side.columns if c not in (key, freq)]
    text = F.to_json(F.struct(*[F.col(f"`{c}`") for c in side.columns]))
    # classes of frequency, eight to an octave: a few hundred at most
    octave = F.floor(8 * F.log2(F.greatest(F.col(freq), F.lit(1)))).cast("int")
    sizes = side.groupBy(octave.alias("c")).agg(F.sum(F.octet_length(text) + 16).alias("b")).collect()
    least, held = None, 0
    for c, b in sorted(((r["c"], r["b"]) for r in sizes), reverse=True):
        held += b
        if held > max_bytes:
            break
        least = c
    else:
        return df.join(F.broadcast(side.drop(freq)), key, how)
    if least is None:
        return df.join(side.drop(freq), key, how)
    mark = "__tm_common"
    met = df.join(F.broadcast(side.where(octave >= least).select(key, *out, F.lit(True).alias(mark))), key, "left")
    rare = met.where(F.col(mark).isNull()).select(*df.columns).join(side.where(octave < least).drop(freq), key, how)
    return met.where(F.col(mark)).drop(mark).unionByName(rare)


def small_side(df: DataFrame, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """The side ready for joining: stored, and broadcast-hinted when proven small."""
    stored = materialize(df)
    return F.broadcast(stored) if measured_bytes(stored) <= max_bytes else stored
