"""Packing documents into sequences of bounded length, certified by lower bounds.

Every document is its token ids and an end id; one longer than a sequence is
cut into pieces of full length, the first taking what is left over.  Full
pieces are sequences of their own.  The others are dealt into partitions of
bounded size, and each partition is packed by best-fit decreasing: the longest
piece first, always into the fullest sequence that still takes it.

Each partition's number of sequences is held against a lower bound from
dual-feasible functions (maps u of [0, 1] with sum u(x_i) <= 1 wherever
sum x_i <= 1, so the sum of u over all pieces bounds the number of sequences):

* identity (the volume);
* for every e up to one half: 1 above 1 - e, 0 below e, identity between;
* for k up to MAX_K: floor((k + 1) x) / k, or x where (k + 1) x is whole.

A partition that meets its bound is certified and closed, but for its least
full sequence: a bound is rounded up to whole sequences, and the rest of that
rounding may go together with those of other partitions.  Partitions with a
gap exchange documents: their sequences without any free place are closed, as
they waste nothing, all other pieces are pooled, dealt anew into as few
partitions as hold them, and packed again.  A round's new packing is taken
only if it needs fewer sequences; the rounds end when nothing is left open,
when a round brings nothing, or after ROUNDS.

The lengths alone are packed - a piece's ids are neither sorted nor shuffled
for it - and one join brings the places back to the pieces.

Defined results: a null text is the empty text, whose document is its end id;
texts are encoded whole; repeated rows, rows that share an id and rows
without an id are documents of their own; an empty table gives no rows; other
columns of the input are left out, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import per_worker, small_batches, stored, trim
from .bytebpe import ByteEncoder

#: Tokens of a sequence.
CAPACITY = 2048
#: Pieces of a partition (a task holds their lengths and item numbers).
PART_ITEMS = 1 << 16
#: Exchanges at most, and the largest k of the third family of bounds.
ROUNDS, MAX_K = 6, 100


def cut(n: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of the pieces of a document of ``n`` ids: full ones, and before them what is left over."""
    if n <= capacity:
        return [n]
    first = n % capacity
    return ([first] if first else []) + [capacity] * (n // capacity)


def lower_bound(counts: np.ndarray) -> int:
    """The least number of sequences that pieces need: ``counts[x]`` pieces of length x, capacity the last x."""
    c = len(counts) - 1
    x = np.arange(c + 1, dtype=np.int64)
    counts = counts.astype(np.int64)
    best = -(-int((counts * x).sum()) // c)
    # 1 above c - e, x between, 0 below e: all e at once from running sums
    number, volume = np.cumsum(counts), np.cumsum(counts * x)
    e = np.arange(1, c // 2 + 1)
    above = number[c] - number[c - e]
    between = volume[c - e] - volume[e - 1]
    if len(e):
        best = max(best, int((above + -(-between // c)).max()))
    for k in range(1, MAX_K + 1):
        whole = (k + 1) * x % c == 0
        # in units of 1 / (k c)
        value = np.where(whole, k * x, (k + 1) * x // c * c)
        best = max(best, -(-int((counts * value).sum()) // (k * c)))
    return best


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, int]:
    """(sequence, offset) of every piece, and the number of sequences: best-fit decreasing, ties by order."""
    where = np.zeros(len(lengths), np.int64)
    offset = np.zeros(len(lengths), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    some, used = 0, 0  # bit r of ``some``: there are sequences with r free places
    order = np.argsort(-lengths, kind="stable")
    for i, n in zip(order.tolist(), lengths[order].tolist()):
        fits = some >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            seq = free[room].pop()
            if not free[room]:
                some &= ~(1 << room)
        else:
            seq, room = used, capacity
            used += 1
        where[i], offset[i] = seq, capacity - room
        left = room - n
        if left:
            free[left].append(seq)
            some |= 1 << left
    return where, offset, used


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, key_col: str = "doc_id",
           text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Per piece: key, piece, start, length, ids_crc32, and, if asked for, ``ids`` (little-endian, 32 bits each)."""
    names = ["key", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = per_worker(f"byte bpe {tokenizer}", lambda: ByteEncoder(tokenizer))
        end = np.array([end_id], "<u4")
        for batch in batches:
            rows = []
            for key, text in zip(*(batch.column(k) for k in (0, 1))):
                text = text.as_py()
                ids = np.concatenate([encoder.encode(text), end]) if text else end
                start = 0
                for k, n in enumerate(cut(len(ids), capacity)):
                    data = ids[start:start + n].tobytes()
                    rows.append((key.as_py(), k, start, n, zlib.crc32(data), data)[:len(names)])
                    start += n
            columns = zip(*rows) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)
        trim()

    schema = "key long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    return (docs.select(F.col(key_col).cast("bigint").alias("key"), F.col(text_col).alias("text"))
            .mapInArrow(run, schema).withColumn("item", F.monotonically_increasing_id()))


def _packed(items: DataFrame, round_: int, capacity: int) -> DataFrame:
    """One round: (item, length, part, seq, offset, open) of every piece; open ones may be exchanged.

    Pieces are dealt by a hash of their number, so no length, text or id that
    many share gathers in one partition.
    """
    n = items.count()
    parts = max(1, -(-n // PART_ITEMS))

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("item")
        lengths = f["length"].to_numpy(np.int64)
        seq, offset, used = best_fit(lengths, capacity)
        held = np.bincount(seq, lengths, used)
        certified = used == lower_bound(np.bincount(lengths, minlength=capacity + 1))
        left = held < capacity
        if certified:
            left &= np.arange(used) == held.argmin()
        return pd.DataFrame({"item": f["item"].to_numpy(), "length": lengths, "part": f["part"].to_numpy(), "seq": seq,
                             "offset": offset, "open": left[seq]})

    dealt = items.select("item", "length",
                         F.pmod(F.xxhash64("item", F.lit(round_)), F.lit(parts)).cast("int").alias("part"))
    return stored(dealt.groupBy("part").applyInPandas(
        run, "item long, length long, part int, seq long, offset long, open boolean"))


def places(items: DataFrame, capacity: int = CAPACITY, rounds: int = ROUNDS) -> DataFrame:
    """(item, sequence_id, offset) of pieces (item, length), none longer than ``capacity``."""
    whole = items.where(F.col("length") == capacity).select(
        "item", (-1 - F.col("item")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    closed = [whole]

    def close(rows: DataFrame, round_: int) -> None:
        # round, partition and place in it make a number of their own
        name = F.lit(round_ << 56) + F.shiftleft(F.col("part").cast("bigint"), 24) + F.col("seq")
        closed.append(rows.select("item", name.alias("sequence_id"), "offset"))

    # what is still open: its packing so far, the round that made it, and how many sequences that takes
    now, made = _packed(items.where(F.col("length") < capacity), 0, capacity), 0
    for round_ in range(1, rounds + 1):
        close(now.where(~F.col("open")), made)
        now = now.where("open")
        needs = now.select("part", "seq").distinct().count()
        if needs < 2:
            break
        new = _packed(now.select("item", "length"), round_, capacity)
        got = new.select("part", "seq").distinct().count()
        if got >= needs:
            break
        now, made = new, round_
    close(now, made)
    out = closed[0]
    for more in closed[1:]:
        out = out.unionByName(more)
    return out


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, key_col: str = "doc_id",
         text_col: str = "text", keep_ids: bool = False, rounds: int = ROUNDS) -> DataFrame:
    """Per piece: key, piece, start, length, ids_crc32, sequence_id, offset (and ``ids``, if asked for)."""
    if not 1 <= capacity < 1 << 24:
        raise ValueError("a sequence takes 1 to 2^24 - 1 tokens")
    # what a batch of texts takes, it takes in the JVM as well
    with small_batches(docs.sparkSession, 512):
        cut_up = stored(pieces(docs, tokenizer, end_id, capacity, key_col, text_col, keep_ids))
    found = places(cut_up.select("item", "length"), capacity, rounds)
    return cut_up.join(found, "item").drop("item").withColumnRenamed("key", key_col)


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves: sequence_id, n_tokens, ``ids`` (one binary of 32-bit integers).

    ``packed`` is ``pack``'s result with ids; a group is at most one sequence.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return (packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("parts"))
            .select("sequence_id", "n_tokens", F.aggregate(
                "parts", F.lit(b""), lambda done, p: F.concat(done, p["ids"])).alias("ids")))


def bound(packed: DataFrame, capacity: int = CAPACITY) -> tuple[int, int]:
    """(sequences used, lower bound for the whole table) from the counts of lengths, at most ``capacity`` rows."""
    counts = np.zeros(capacity + 1, np.int64)
    for r in packed.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():
        counts[r["length"]] = r["n"]
    return packed.select("sequence_id").distinct().count(), lower_bound(counts)
