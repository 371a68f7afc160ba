"""Exact near-duplicate join of documents on word shingles, by universe partition and pigeonhole.

Two sets x, y with Jaccard similarity >= t differ in at most
H(x, y) = floor((1 - t) / (1 + t) * (|x| + |y|)) elements.  The shingle
universe is cut by hash into segments.  A document walks through the segments
in order and takes each non-empty one, for *units*, until it has H + 1 units,
H being the largest it can have with any partner:

* an exact segment counts 1 unit: its subset's hash is indexed;
* a one-deletion segment counts 2 units (1 if it holds one element): indexed
  are the subset's hash and those of the subset with each element left out.

Of two similar documents take the one whose walk ends first: it has more units
than there are differing elements, so at least one of its segments differs by
fewer elements than it counts units, and the other document has indexed a hash
in common with it there.  Empty segments count nothing and are never indexed,
so no list of "documents without elements here" exists.  A document that
reaches the last segment with too few units is only at risk together with
another such document; those few also index each of their elements.

Segments belong to a size band (sizes up to BAND_RATIO apart); a pair meets in
the band of its larger member, so a document is indexed in its own band and in
those that its possible partners reach.  For each band the allocation - number
of segments, exact or one-deletion - is the one with the least cost: indexed
hashes, plus the expected chance candidates, plus the elements of documents
that run out of segments.

Equal sets are gathered into classes first, by a grouped minimum.  Indexed
hashes travel packed, dealt by hash to buckets of bounded size; inside one
map task a hash that several classes share is sent once.  Only shared hashes
become rows.  Candidates are pairs under one hash whose sizes and parity
bitmaps (a small one, then one that grows with the set) leave a link possible:
the number of bits in which two bitmaps differ is at most the number of
differing elements.  They are verified on the whole
sets, in two steps.  In the first, every class is paired with the smallest one
under each of its hashes (a star, so a large group of near copies gives few
candidates), and in each of STAR_ROUNDS rounds a class is held against the
nearest star that it is not yet connected to.  In the second, for hashes whose
classes are not all in one component, all pairs across components are
verified.  Every link between different components is thus found, and links
inside a component cannot change it.

Defined results: null or empty texts, and texts of white space, have no
shingles and are linked with nothing; a text with fewer words than a shingle
has its whole word sequence as its one shingle; equal sets are linked; rows
that share an id count as linked; a null id takes no part and keeps a null
component; texts are read whole; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import broadcast_if
from . import words as W
from .base import counted, packed, per_worker, release, small_batches, stored, unpacked
from .components import components

BAND_RATIO = 1.5
#: Cost of a chance candidate in indexed hashes, and the chance that an element is shared with some unrelated text.
CANDIDATE_COST, SHARED = 4.0, 0.3
#: Hashes in memory before a map task sends them, and hashes of one bucket.
FLUSH, BUCKET = 300_000, 500_000
#: 64-bit words of the parity bitmap.
MAP_WORDS = 8
#: Rounds in which each document is held against its nearest star.
STAR_ROUNDS = 2
#: At most so many ids, or pairs of ids (8 bytes each id), are broadcast.
MAX_BROADCAST_IDS = 1_000_000


def differing(x, y, percent: int):
    """The most elements in which sets of sizes x, y can differ at a similarity of ``percent``."""
    return (100 - percent) * (x + y) // (100 + percent)


def allocation(low: int, high: int, percent: int) -> tuple[int, bool]:
    """(segments, one-deletion) of the band of sizes ``low`` to ``high``: the cheapest for a document in its middle."""
    size = (low + high) / 2
    need = differing(size, min(size * 100 / percent, high), percent) + 1
    best = None
    for deletion in (False, True):
        units = 2 if deletion else 1
        least = max(1, int(differing(high, high, percent) + units) // units)
        for m in sorted({max(1, int(least * f + e)) for f in (1, 1.1, 1.2, 1.35, 1.5, 2) for e in (0, 1, 2)}):
            k = size / m  # elements of a segment; their number is nearly Poisson
            empty, single = np.exp(-k), k * np.exp(-k)
            mean = (1 - empty) + (1 - empty - single) * (units - 1)
            spread = np.sqrt(m * (empty * (1 - empty) + 0.25 * single * (units - 1))) + 1e-9
            short = 1 / (1 + np.exp(min(30.0, 1.7 * (m * mean - need) / spread)))
            taken = min(m * (1 - empty), need / max(mean, 1e-9) * (1 - empty))
            rows = taken * (1 + (k if deletion else 0)) + short * size
            chance = taken * SHARED ** max(1.0, k - (1 if deletion else 0)) * (k if deletion else 1)
            cost = rows + CANDIDATE_COST * chance
            if best is None or cost < best[0]:
                best = (cost, m, deletion)
    return best[1], best[2]


def bands(largest: int, percent: int) -> list[tuple[int, int, int, bool]]:
    """(smallest size, largest size, segments, one-deletion) of every band up to the partners of ``largest``."""
    out, low = [], 1
    while not out or out[-1][1] < largest * 100 // percent:
        high = max(low + 1, int(low * BAND_RATIO)) - 1
        out.append((low, high, *allocation(low, high, percent)))
        low = high + 1
    return out


def index_hashes(s: np.ndarray, percent: int, table: list) -> np.ndarray:
    """All hashes that a document with the sorted shingles ``s`` is indexed under."""
    n = len(s)
    out, short = [], False
    largest = n * 100 // percent
    spread = W.mix(s + W.STEP[43])
    for low, high, m, deletion in table:
        if high < n:
            continue
        if low > largest:
            break
        need = differing(n, min(largest, high), percent) + 1
        # the hash's high bits name the segment, so segments are runs of the sorted set
        segment = ((s >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        starts = np.flatnonzero(np.diff(segment, prepend=-1))
        sizes = np.diff(starts, append=n)
        units = np.minimum(sizes, 2) if deletion else np.ones(len(starts), np.int64)
        total = np.cumsum(units)
        last = int(np.searchsorted(total, need))
        if last >= len(starts):
            short = True
            last = len(starts) - 1
        starts, sizes = starts[:last + 1], sizes[:last + 1]
        end = int(starts[-1] + sizes[-1])
        sums = np.add.reduceat(spread[:end], starts)
        salt = segment[starts].astype(np.uint64) * W.STEP[40] + W.STEP[41:42] * np.uint64(low)
        out.append(W.mix(sums + salt))
        if deletion:
            several = np.repeat(sizes > 1, sizes)
            out.append(W.mix((np.repeat(sums + salt, sizes) - spread[:end])[several]))
    if short:
        out.append(W.mix(s ^ W.STEP[42]))
    return np.unique(np.concatenate(out))


def parity(s: np.ndarray, bits: int = 64 * MAP_WORDS) -> bytes:
    """A bitmap of ``bits`` (a power of two) in which every element turns one bit over."""
    return np.packbits(np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(
        np.uint8).tobytes()


def _sets(batch: pa.RecordBatch, n: int):
    """(id, sorted shingles) of each row of a batch of ids and texts."""
    kept = per_worker("word tables", dict)
    for at in range(0, batch.num_rows, 512):
        part = batch.slice(at, 512)
        ids = part.column(0).to_pylist()
        for start, texts in W.batches(part.column(1).to_pylist()):
            for i, s in enumerate(W.shingle_sets(texts, n, kept)):
                yield ids[start + i], s


def shingled(docs: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """Per row: id, n_shingles, digest of the set (null if empty), parity bitmaps: a small one as ``array<long>``
    and one whose size follows the set's."""

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        for batch in batches_:
            ids, sizes, digests, maps, wide = [], [], [], [], []
            for i, s in _sets(batch, n):
                ids.append(i)
                sizes.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                maps.append(parity(s))
                wide.append(parity(s, max(64 * MAP_WORDS, 1 << (2 * len(s)).bit_length())))
            flat = np.frombuffer(b"".join(maps), "<i8")
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                 pa.FixedSizeListArray.from_arrays(pa.array(flat, pa.int64()), MAP_WORDS).cast(pa.list_(pa.int64())),
                 pa.array(wide, pa.binary())],
                ["id", "n_shingles", "digest", "map", "wide"])

    slim = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, "id long, n_shingles long, digest binary, map array<long>, wide binary")


def _shared_hashes(docs: DataFrame, n: int, percent: int, buckets: int, table: list) -> DataFrame:
    """(hash, id) of every index hash that at least two of ``docs`` (id, text) share."""
    shift = 64 - (buckets.bit_length() - 1)

    def index(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["bucket", "known", "data"]

        def flushed(hashes, ids):
            h = np.concatenate(hashes)
            d = np.repeat(np.array(ids, np.int64), [len(x) for x in hashes])
            order = np.lexsort((d, h))
            h, d = h[order], d[order]
            first = np.flatnonzero(np.diff(h, prepend=h[:1] ^ np.uint64(1)))
            copies = np.diff(first, append=len(h))
            rest = np.ones(len(h), bool)
            rest[first] = False
            # the classes of a hash after its first one: the hash is known to be shared,
            # so they go to any bucket, evenly
            hr, dr = h[rest], d[rest]
            spread = W.mix(dr.view(np.uint64) ^ hr) & np.uint64(buckets - 1)
            order = np.argsort(spread, kind="stable")
            hr, dr = hr[order], dr[order]
            rows = [(b, True, packed(hr[p], dr[p])) for b, p in W.runs(spread[order])]
            h, d, many = h[first], d[first], copies > 1
            rows += [(b, False, packed(h[p], d[p], many[p])) for b, p in W.runs(h >> np.uint64(shift))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()),
                                              pa.array([r[1] for r in rows], pa.bool_()),
                                              pa.array([r[2] for r in rows], pa.binary())], names)

        hashes, ids, held = [], [], 0
        for batch in batches_:
            for i, s in _sets(batch, n):
                if len(s):
                    hashes.append(index_hashes(s, percent, table))
                    ids.append(i)
                    held += len(hashes[-1])
                    if held >= FLUSH:
                        yield from flushed(hashes, ids)
                        hashes, ids, held = [], [], 0
        if hashes:
            yield from flushed(hashes, ids)

    def merge(f: pd.DataFrame) -> pd.DataFrame:
        known = [unpacked(x, "<u8", "<i8") for x in f.loc[f["known"], "data"]]
        parts = [unpacked(x, "<u8", "<i8", "?") for x in f.loc[~f["known"], "data"]]
        out = [pd.DataFrame({"hash": h.view(np.int64), "id": d}) for h, d in known]
        if parts:
            h, d, many = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(h, kind="stable")
            h, d, many = h[order], d[order], many[order]
            first = np.flatnonzero(np.diff(h, prepend=h[:1] ^ np.uint64(1)))
            copies = np.diff(first, append=len(h))
            shared = np.repeat((copies > 1) | np.logical_or.reduceat(many, first), copies)
            out.append(pd.DataFrame({"hash": h[shared].view(np.int64), "id": d[shared]}))
        return pd.concat(out)

    return (docs.mapInArrow(index, "bucket int, known boolean, data binary").groupBy("bucket")
            .applyInPandas(merge, "hash long, id long").distinct())


def _differ(a: str, b: str) -> Column:
    out = F.lit(0)
    for k in range(MAP_WORDS):
        out = out + F.bit_count(F.col(a)[k].bitwiseXOR(F.col(b)[k]))
    return out


def _possible(percent: int) -> Column:
    """Sizes na, nb and the bitmaps' distance ``apart`` leave room for a link."""
    sizes = ((F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent))
    most = F.floor((100 - percent) * (F.col("na") + F.col("nb")) / F.lit(100 + percent))
    return sizes & (F.col("apart") <= most)


def _candidates(pairs: DataFrame, classes: DataFrame, percent: int) -> tuple[DataFrame, int]:
    """The pairs (a, b) that sizes and bitmaps leave possible, with the distance of their bitmaps; their number."""
    sized = classes.select("id", "n_shingles", "map")
    left = sized.select(F.col("id").alias("a"), F.col("n_shingles").alias("na"), F.col("map").alias("ma"))
    right = sized.select(F.col("id").alias("b"), F.col("n_shingles").alias("nb"), F.col("map").alias("mb"))
    return counted(pairs.join(left, "a").join(right, "b").withColumn("apart", _differ("ma", "mb"))
                   .where(_possible(percent)).select("a", "b", "apart"))


def _narrowed(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that the wide bitmaps leave possible.

    Bitmaps of two sizes are compared at the smaller one: a bitmap's halves
    laid over each other are the bitmap of half the size.
    """
    sized = classes.select("id", "n_shingles", "wide")
    left = sized.select(F.col("id").alias("a"), F.col("n_shingles").alias("na"), F.col("wide").alias("wa"))
    right = sized.select(F.col("id").alias("b"), F.col("n_shingles").alias("nb"), F.col("wide").alias("wb"))

    def run(batches):
        for batch in batches:
            a, b, na, nb = (batch.column(k).to_pylist() for k in range(4))
            keep = []
            for k, (x, y) in enumerate(zip(batch.column(4), batch.column(5))):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                size = min(len(x), len(y))
                x, y = (np.bitwise_xor.reduce(v.reshape(-1, size), axis=0) for v in (x, y))
                keep.append(int(np.bitwise_count(x ^ y).sum()) <= differing(na[k], nb[k], percent))
            yield pa.RecordBatch.from_arrays(
                [pa.array([v for v, k in zip(c, keep) if k], pa.int64()) for c in (a, b)], ["a", "b"])

    return (pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "na", "nb", "wa", "wb")
            .mapInArrow(run, "a long, b long"))


def _links(pairs: DataFrame, classes: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) of documents whose sets are similar enough.

    Only the texts of ``a`` and ``b`` are read; the sets of the ``b`` go to
    those of the ``a``, each of which stands for many ``b``.  Rows that share an
    id are one document, linked if any of them is.
    """
    pairs, n_pairs = counted(_narrowed(pairs, classes, percent).distinct().select("a", F.col("b").alias("id")))
    heads, n_heads = counted(pairs.select(F.col("a").alias("id")).distinct(), n_pairs)

    def of_b(batches):
        for batch in batches:
            a = batch.column(2).to_pylist()
            rows = list(_sets(batch, n))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array([i for i, _ in rows], pa.int64()),
                                              pa.array([s.tobytes() for _, s in rows], pa.binary())], ["a", "b", "y"])

    def of_a(batches):
        for batch in batches:
            rows = list(_sets(batch, n))
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()),
                                              pa.array([s.tobytes() for _, s in rows], pa.binary())], ["a", "x"])

    def similar(batches):
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays(
                [pa.array([v for v, k in zip(c, keep) if k], pa.int64()) for c in (a, b)], ["a", "b"])

    members = (docs.join(broadcast_if(pairs, n_pairs, MAX_BROADCAST_IDS), "id").select("id", "text", "a")
               .mapInArrow(of_b, "a long, b long, y binary"))
    first = (docs.join(broadcast_if(heads, n_heads, MAX_BROADCAST_IDS), "id", "left_semi")
             .mapInArrow(of_a, "a long, x binary"))
    with small_batches(docs.sparkSession):
        links = stored(members.join(first, "a").select("a", "b", "x", "y").mapInArrow(similar, "a long, b long"))
    release(docs.sparkSession)
    return links


def _across(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs (a, b) whose ends are in different components; ``ca`` is that of a."""
    for end, name in (("a", "ca"), ("b", "cb")):
        named = found.select(F.col("node").alias(end), F.col("component").alias(name))
        pairs = pairs.join(named, end, "left").withColumn(name, F.coalesce(name, end))
    return pairs.where("ca != cb").drop("cb")


def near_duplicates(df: DataFrame, percent: int = 80, n: int = 5, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """Per row: ``id_col``, n_shingles, component_id (smallest id reachable by links of ``percent`` similarity)."""
    if not 50 <= percent <= 100 or n < 1:
        raise ValueError("percent must be 50 to 100 and n at least 1")
    spark = df.sparkSession
    # what a batch of texts takes, it takes in the JVM as well
    with small_batches(spark, 1000):
        rows = stored(shingled(df, n, id_col, text_col))
    usable = rows.where("digest is not null and id is not null")
    classes = stored(usable.groupBy("digest", "n_shingles").agg(F.min("id").alias("id"))
                     .join(usable.select("digest", "id", "map", "wide"), ["digest", "id"])
                     .dropDuplicates(["digest", "id"]))
    total, largest = (v or 0 for v in classes.agg(F.sum("n_shingles"), F.max("n_shingles")).first())
    buckets = 1 << max(5, (int(total * 0.6) // BUCKET).bit_length())
    # copies need not be indexed: rows whose id is not their class's smallest
    copies, n_copies = counted(usable.select("digest", "id").join(
        classes.select("digest", F.col("id").alias("first")), "digest").where("id != first").select("id")
        .distinct().join(classes.select("id"), "id", "left_anti"))
    docs = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    firsts = docs.join(broadcast_if(copies, n_copies, MAX_BROADCAST_IDS), "id", "left_anti")
    with small_batches(spark, 1000):
        shared = stored(_shared_hashes(firsts, n, percent, buckets, bands(largest, percent)))
    release(spark)
    least = stored(shared.groupBy("hash").agg(F.min("id").alias("a")))
    stars, left = _candidates(shared.join(least, "hash").where("a != id").select("a", F.col("id").alias("b")).distinct(),
                              classes, percent)
    links = found = None
    for _ in range(STAR_ROUNDS):
        if not left:
            break
        # each document with the nearest star it is not yet connected to
        best, _ = counted(stars.groupBy("b").agg(F.min(F.struct("apart", "a")).alias("s")).select("s.a", "b"), left)
        new = _links(best, classes, firsts, n, percent)
        links = new if links is None else links.unionByName(new)
        found = stored(components(links))
        stars, left = counted(_across(stars.join(best, ["a", "b"], "left_anti"), found).drop("ca"), left)
        release(spark)
    if found is None:  # no hash is shared
        found = spark.createDataFrame([], "node long, component long")
    # hashes whose classes are still in several components: all pairs across them
    named = stored(shared.join(found.withColumnRenamed("node", "id"), "id", "left")
                   .withColumn("component", F.coalesce("component", "id")))
    split, some = counted(named.groupBy("hash").agg(F.min("component").alias("low"), F.max("component").alias("high"))
                          .where("low != high").select("hash"))
    more = None
    if some:
        sized = stored(named.join(split, "hash", "left_semi").join(classes.select("id", "n_shingles", "map"), "id"))
        a = sized.select("hash", F.col("id").alias("a"), F.col("component").alias("ca"), F.col("n_shingles").alias("na"),
                         F.col("map").alias("ma"))
        b = sized.select("hash", F.col("id").alias("b"), F.col("component").alias("cb"), F.col("n_shingles").alias("nb"),
                         F.col("map").alias("mb"))
        here = (F.col("ca") < F.col("cb")) & _possible(percent)
        across, pairs = counted(a.join(b, "hash").withColumn("apart", _differ("ma", "mb")).where(here)
                                .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        if pairs:
            more = _links(across, classes, firsts, n, percent)
    # rows that share an id but not their text tie their classes together
    twice = usable.select("id", "digest").distinct().groupBy("id").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    ties = (usable.join(twice, "id", "left_semi").select("id", "digest").distinct()
            .join(classes.select("digest", F.col("id").alias("b")), "digest").select(F.col("id").alias("a"), "b"))
    ties, tied = counted(ties)
    # what the stars have joined stays joined: later links only go on from there
    joined = found.select(F.col("node").alias("a"), F.col("component").alias("b"))
    for extra in ([more] if more is not None else []) + ([ties] if tied else []):
        joined = joined.unionByName(extra)
    end = stored(components(joined)) if more is not None or tied else found
    of_class = stored(classes.join(end.withColumnRenamed("node", "id"), "id", "left")
                      .select("digest", F.coalesce("component", "id").alias("component_id")))
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return (rows.join(of_class, "digest", "left")
            .select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id")))
