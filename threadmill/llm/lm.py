"""Stupid-backoff language-model scores of whole documents, from n-gram counts of the whole corpus.

The score of a word is the relative frequency of the longest of its n-grams
that the corpus holds at least MIN_COUNT times, times ALPHA for every shorter
step taken; its logarithms are summed per document.  With the base

    base(word) = ln(count(word) / total) + (steps to the longest context) * ln ALPHA

and, for a kept n-gram, the gain over the next shorter one,

    gain(n-gram) = ln(count / count of its context) - ln ALPHA - (the same ratio of its suffix),

a word's score is its base plus the gains of its kept n-grams, because every
suffix of a kept n-gram is kept too.  So each order is one join of its own:
n-gram gains, partitioned by hash, with the documents' n-grams, dealt by the
same hash, summed per document.

Words are coded: one that makes at least 1 / MAX_FREQUENT of all words - by
arithmetic there are at most MAX_FREQUENT of these, 24 bytes each, so they and
their counts are sent to every task - by its rank, any other by its hash.  N-grams are
counted per run of about FLUSH words before they travel, as sorted and packed
columns, and dealt by the hash of their first two words, so that an n-gram
meets the count of its context; a word or a word pair that the corpus is full
of is one entry per run.  Buckets and runs are bounded, their number follows
the corpus.  Texts are read once: a run is stored as the hashes and counts of its
distinct words and, for each word of its texts, which of them it is.  Words and n-grams are
counted and looked up from these runs.  Phases are stored one by one,
each without the shuffle files of the one before; n-grams longer than two words
are counted, and all n-grams looked up, in PASSES shares of the buckets one after
the other: the disk in use is that of one share.  N-grams as common as a frequent
word are not sent when they are looked up: their gains, at most MAX_FREQUENT of
each order by the same arithmetic, go to every task and are summed there.

Defined results: null or empty texts have 0 words, a sum of 0 and a null mean;
texts are read whole; repeated rows count as often as they occur and get equal
scores each; rows that share an id are each counted, and scored as one
document; a null id takes part in the counts, not in the scores; an empty
table gives no rows; MIN_COUNT and the order are parameters of the model and
hold for all data alike.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .base import packed, per_worker, release, small_batches, stored_alone, trim, unpacked

ALPHA = 0.4
ORDER = 3
MIN_COUNT = 2
#: A word with at least this share of all words is coded by its rank.
MAX_FREQUENT = 1_000_000
#: Words in memory before a map task sends its n-grams, words of one bucket, and of one where n-grams are looked up:
#: runs are met one by one there, and the fewer buckets, the fewer sums a document has.
FLUSH, BUCKET, LOOKUP_BUCKET = 1_000_000, 2_000_000, 4_000_000
RARE = np.uint64(1 << 63)
#: Shares of the buckets that are counted and looked up one after the other.
PASSES = 2


class Frequent:
    """The frequent words' hashes (sorted), ranks and log counts, and the log of the number of all words."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, total: int):
        rank = np.lexsort((hashes, -counts.astype(np.int64)))
        ranks = np.empty(len(hashes), np.uint64)
        ranks[rank] = np.arange(len(hashes), dtype=np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.ranks, self.by_rank = hashes[order], ranks[order], hashes[rank]
        # the hashes of equal leading bits stand together; where each such run starts
        bits = max(1, (4 * len(hashes)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.starts = np.searchsorted(self.hashes >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)
        self.log_count = np.log(counts[rank].astype(np.float64))
        self.log_total = math.log(max(1, total))

    def codes(self, h: np.ndarray) -> np.ndarray:
        out = h | RARE
        slot = (h >> self.shift).astype(np.int64)
        at, end = self.starts[slot], self.starts[slot + 1]
        left = np.flatnonzero(at < end)
        at, end = at[left], end[left]
        while len(left):
            hit = self.hashes[at] == h[left]
            out[left[hit]] = self.ranks[at[hit]]
            more = ~hit & (at + 1 < end)
            left, at, end = left[more], at[more] + 1, end[more]
        return out

    def names(self, codes: np.ndarray) -> np.ndarray:
        """What stands for a word whether it is frequent or not: its hash with the top bit set."""
        out = codes.copy()
        known = codes < RARE
        out[known] = self.by_rank[codes[known].astype(np.int64)] | RARE
        return out

    def logs(self, codes: np.ndarray) -> np.ndarray:
        """Log counts of frequent words, NaN for others."""
        out = np.full(len(codes), np.nan)
        known = codes < RARE
        out[known] = self.log_count[codes[known].astype(np.int64)]
        return out


class Common:
    """Gains of the common n-grams, by their sorted hashes."""

    def __init__(self, hashes: np.ndarray, gains: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.gains = hashes[order], gains[order]
        bits = max(1, (4 * len(hashes)).bit_length())
        self.shift = np.uint64(64 - bits)
        # only hashes whose leading bits a common one has as well are searched for
        self.there = np.zeros(1 << bits, bool)
        self.there[(self.hashes >> self.shift).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each hash is a common n-gram's, and the gains of those that are."""
        out = self.there[(h >> self.shift).astype(np.int64)]
        maybe = np.flatnonzero(out)
        at = np.minimum(np.searchsorted(self.hashes, h[maybe]), len(self.hashes) - 1)
        hit = self.hashes[at] == h[maybe] if len(maybe) else np.zeros(0, bool)
        out[maybe] = hit
        return out, self.gains[at[hit]]


def gram_hash(columns: list[np.ndarray]) -> np.ndarray:
    out = np.full(len(columns[0]), len(columns), np.uint64)
    for k, c in enumerate(columns):
        out = out + c * W.STEP[10 + k]
    return W.mix(out)


def _runs(batches: Iterator[pa.RecordBatch], flush: int = FLUSH):
    """(ids, word hashes, word offsets) of about ``flush`` words at a time."""
    kept = per_worker("word tables", dict)
    ids, hashes, sizes, held = [], [], [], 0
    parts = (batch.slice(at, 512) for batch in batches for at in range(0, batch.num_rows, 512))
    for part in parts:
        own = part.column(0).to_pylist()
        for start, texts in W.batches(part.column(1).to_pylist()):
            h, at = W.word_hashes(texts, kept)
            ids += own[start:start + len(texts)]
            hashes.append(h)
            sizes.append(np.diff(at))
            held += len(h)
            if held >= flush:
                yield ids, np.concatenate(hashes), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
                ids, hashes, sizes, held = [], [], [], 0
    if ids:
        yield ids, np.concatenate(hashes), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
    del ids, hashes, sizes
    trim()


def _dealt(order_by: np.ndarray, buckets: int):
    """(bucket, slice) of the non-empty buckets of sorted 64-bit hashes."""
    return W.runs(order_by >> np.uint64(64 - (buckets.bit_length() - 1)))


def _rows(parts: list, names: list, kinds: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[i] for p in parts], k) for i, k in enumerate(kinds)], names)


def _stored_runs(docs: DataFrame) -> DataFrame:
    """Runs of documents, packed: ids (and whether there is one) and numbers of words; the hashes of the
    distinct words, the most frequent first, and their counts; for each word its place among them."""

    def run(batches):
        for ids, h, at in _runs(batches):
            known = np.array([i is not None for i in ids], np.uint8)
            own = np.array([0 if i is None else i for i in ids], np.int64)
            sort, u = W.sorted_order(h)
            first = W.firsts(u)
            u, c = u.take(first), np.diff(first, append=len(h))
            often = np.argsort(-c, kind="stable")
            rank = np.empty(len(u), "<u4")
            rank[often] = np.arange(len(u), dtype="<u4")
            places = np.empty(len(h), "<u4")
            places[sort] = np.repeat(rank, c)
            yield _rows([(packed(own, known, np.diff(at)), packed(u[often], c[often].astype("<u4")),
                          packed(places), len(h))],
                        ["docs", "words", "places", "n"], [pa.binary(), pa.binary(), pa.binary(), pa.int64()])

    return docs.mapInArrow(run, "docs binary, words binary, places binary, n long")


def _read_runs(batches: Iterator[pa.RecordBatch]):
    """(ids, whether there is one, hashes of distinct words, places among them, word offsets) of ``_stored_runs``."""
    for batch in batches:
        for docs, words, places in zip(batch.column(0), batch.column(1), batch.column(2)):
            ids, known, n = unpacked(docs.as_py(), "<i8", "u1", "<i8")
            hashes, _ = unpacked(words.as_py(), "<u8", "<u4")
            yield ids, known.astype(bool), hashes, unpacked(places.as_py(), "<u4")[0], np.concatenate([[0], np.cumsum(n)])
    trim()


def _word_counts(runs: DataFrame, buckets: int) -> DataFrame:
    """Per bucket: the words' hashes (sorted) and counts, packed, and the number of all words."""

    def count(batches):
        for batch in batches:
            for words in batch.column(0):
                u, c = unpacked(words.as_py(), "<u8", "<u4")
                sort, u = W.sorted_order(u)
                c = c.take(sort).astype("<i8")
                yield _rows([(b, packed(u[p], c[p])) for b, p in _dealt(u, buckets)],
                            ["bucket", "data"], [pa.int32(), pa.binary()])
        trim()

    def merge(f: pd.DataFrame) -> pd.DataFrame:
        parts = [unpacked(x, "<u8", "<i8") for x in f["data"]]
        h, c = (np.concatenate(x) for x in zip(*parts))
        sort, u = W.sorted_order(h)
        first = W.firsts(u)
        u, total = u.take(first), np.add.reduceat(c.take(sort), first) if len(h) else c
        del parts, h, c, sort, first
        trim()
        return pd.DataFrame({"bucket": [f["bucket"].iloc[0]], "data": [packed(u, total)], "n": [int(total.sum())]})

    return (runs.select("words").mapInArrow(count, "bucket int, data binary").groupBy("bucket")
            .applyInPandas(merge, "bucket int, data binary, n long"))


def _frequent(counts: DataFrame) -> Frequent:
    total = counts.agg(F.sum("n")).first()[0] or 0

    def pick(frames):
        for f in frames:
            for data in f["data"]:
                h, c = unpacked(data, "<u8", "<i8")
                keep = c * MAX_FREQUENT >= total
                yield pd.DataFrame({"hash": h[keep].view(np.int64), "n": c[keep]})

    rows = counts.select("data").mapInPandas(pick, "hash long, n long").toPandas()
    return Frequent(rows["hash"].to_numpy(np.int64).view(np.uint64), rows["n"].to_numpy(np.int64), total)


def _inside(at: np.ndarray, n: int) -> np.ndarray:
    """Whether the ``n`` words from each place on are of one document (for the places where there are as many)."""
    out = np.ones(max(0, int(at[-1]) - n + 1), bool)
    for k in range(1, n):
        last = at[1:] - k
        out[last[(last >= 0) & (last < len(out))]] = False
    return out


def _gram_counts(stored_runs: DataFrame, frequent: Frequent, n: int, buckets: int, passes: int = 1,
                 turn: int = 0) -> DataFrame:
    """The ``n``-grams of each run with their counts, packed, by bucket of their first two words.

    Of ``passes`` passes, the one of number ``turn`` counts the buckets that leave it as a remainder.
    """

    def count(batches):
        bits = buckets.bit_length() - 1
        for _, _, hashes, places, at in _read_runs(batches):
            now = _inside(at, n)
            m = len(now)
            own = frequent.codes(hashes)
            codes = own.take(places)
            lead_hash = gram_hash([codes[:m], codes[1:m + 1]])
            lead = lead_hash >> np.uint64(64 - bits)
            if passes > 1:
                now &= lead % np.uint64(passes) == np.uint64(turn)
            where = np.flatnonzero(now)
            if not len(where):
                continue
            full = lead_hash if n == 2 else gram_hash([codes[k:m + k] for k in range(n)])
            full, lead = full.take(where), lead.take(where)
            # one sort key: the bucket of the first two words, the first word, then the whole n-gram
            word = np.empty(len(own), np.uint64)
            word[np.argsort(own)] = np.arange(len(own), dtype=np.uint64)
            word_bits = min(len(own).bit_length(), 63 - bits)
            key = (lead << np.uint64(64 - bits) | word.take(places.take(where)) << np.uint64(64 - bits - word_bits)
                   | full >> np.uint64(bits + word_bits))
            sort = W.rough_order(key)
            # equal n-grams that do not stand together are only counted apart here
            first = W.firsts(full.take(sort))
            times = np.diff(first, append=len(sort)).astype("<u4")
            sort = sort.take(first)
            where = where.take(sort)
            columns = [codes.take(where + k) for k in range(n)]
            yield _rows([(b, packed(*[c[p] for c in columns], times[p])) for b, p in W.runs(lead.take(sort))],
                        ["bucket", "data"], [pa.int32(), pa.binary()])

    return stored_runs.mapInArrow(count, "bucket int, data binary")


def _kept(counted: DataFrame, shorter: DataFrame | None, frequent: Frequent, n: int, min_count: int) -> DataFrame:
    """Per bucket, packed: the codes, log counts, log counts of the contexts and of the last words of kept n-grams.

    ``shorter``: the same for the contexts, dealt by the same first two words
    (for 2 words the context is the first word).  Unknown logs are NaN.
    """

    def merge(f: pd.DataFrame) -> pd.DataFrame:
        parts = [unpacked(x, *["<u8"] * n, "<u4") for x in f.loc[f["side"] == 0, "data"]]
        if not parts:
            return pd.DataFrame({"bucket": [], "data": []}).astype({"bucket": "int32"})
        columns = [np.concatenate([p[k] for p in parts]) for k in range(n)]
        times = np.concatenate([p[n] for p in parts]).astype(np.int64)
        sort, full = W.sorted_order(gram_hash(columns))
        first = W.firsts(full)
        total = np.add.reduceat(times.take(sort), first)
        keep = np.flatnonzero(total >= min_count)
        at = sort.take(first.take(keep))
        columns, total = [c.take(at) for c in columns], total.take(keep)
        if n == 2:
            context = frequent.logs(columns[0])
        else:
            known = [unpacked(x, *["<u8"] * (n - 1), "<f8", "<f8", "<f8") for x in f.loc[f["side"] == 1, "data"]]
            above = gram_hash([np.concatenate([k[i] for k in known]) for i in range(n - 1)]) if known else full[:0]
            logs = np.concatenate([k[n - 1] for k in known]) if known else np.zeros(0)
            order, above = W.sorted_order(above)
            where = order[np.searchsorted(above, gram_hash(columns[:-1]))] if len(total) else order[:0]
            context = logs[where]
        # rows in the order of their first word: its column is made of runs
        by, _ = W.sorted_order(columns[0])
        del parts, times, full, sort, first
        trim()
        logs = [np.log(total.astype(np.float64)), context, frequent.logs(columns[-1])]
        return pd.DataFrame({"bucket": [np.int32(f["bucket"].iloc[0])],
                             "data": [packed(*[c.take(by) for c in columns + logs])]})

    sides = counted.select("bucket", F.lit(0).alias("side"), "data")
    if shorter is not None:
        sides = sides.unionByName(shorter.select("bucket", F.lit(1).alias("side"), "data"))
    return stored_alone(sides.groupBy("bucket").applyInPandas(merge, "bucket int, data binary"))


def _counted(stored_runs: DataFrame, shorter: DataFrame | None, frequent: Frequent, n: int, min_count: int,
             buckets: int) -> DataFrame:
    """``_kept`` of all ``n``-grams, one share of the buckets after the other."""
    passes = 1 if shorter is None else PASSES
    out = None
    for turn in range(passes):
        own = None if shorter is None else shorter.where(F.col("bucket") % passes == turn)
        part = _kept(_gram_counts(stored_runs, frequent, n, buckets, passes, turn), own, frequent, n, min_count)
        out = part if out is None else out.unionByName(part)
    return out


def _kept_pairs(kept: DataFrame, frequent: Frequent, known: bool) -> DataFrame:
    """Kept pairs as rows (key, log_count, log_context, log_last) where both logs are known; or those where one is
    not (it is null), with the codes w0 and w1 of their words besides."""

    def run(batches):
        for batch in batches:
            for data in batch.column(0).to_pylist():
                *codes, log_count, log_context, log_last = unpacked(data, "<u8", "<u8", "<f8", "<f8", "<f8")
                own = np.isnan(log_context) | np.isnan(log_last)
                own = np.flatnonzero(~own if known else own)
                codes = [c[own] for c in codes]
                longs = [gram_hash([frequent.names(c) for c in codes])] + ([] if known else codes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c[own], from_pandas=True) for c in (log_count, log_context, log_last)]
                    + [pa.array(c.view(np.int64)) for c in longs], columns)

    columns = ["log_count", "log_context", "log_last", "key"] + ([] if known else ["w0", "w1"])
    return kept.select("data").mapInArrow(run, ", ".join(f"{c} {'double' if c[0] == 'l' else 'long'}" for c in columns))


def _kept_longer(kept: DataFrame, frequent: Frequent, n: int) -> DataFrame:
    """Kept n-grams of more words as rows: key, suffix (the key of the n-gram without its first word), log_count, log_context."""

    def run(batches):
        for batch in batches:
            for data in batch.column(0).to_pylist():
                *codes, log_count, log_context, _ = unpacked(data, *["<u8"] * n, "<f8", "<f8", "<f8")
                names = [frequent.names(c) for c in codes]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(gram_hash(x).view(np.int64)) for x in (names, names[1:])]
                    + [pa.array(log_count), pa.array(log_context)], ["key", "suffix", "log_count", "log_context"])

    return kept.select("data").mapInArrow(run, "key long, suffix long, log_count double, log_context double")


def _gains(kept: list[DataFrame], counts: DataFrame, frequent: Frequent, order: int, buckets: int) -> list[DataFrame]:
    """Per order from 2 the stored ``_table`` of every kept n-gram's gain."""

    def rare(frames):
        for f in frames:
            for data in f["data"]:
                h, c = unpacked(data, "<u8", "<i8")
                codes = frequent.codes(h)
                keep = codes >= RARE
                yield pd.DataFrame({"code": codes[keep].view(np.int64), "log": np.log(c[keep].astype(np.float64))})

    words = counts.select("data").mapInPandas(rare, "code long, log double")
    pairs = _kept_pairs(kept[0], frequent, True)
    asked = stored_alone(_kept_pairs(kept[0], frequent, False))
    for word, log in (("w0", "log_context"), ("w1", "log_last")):
        # only rare words are looked up, so no word's pairs fill a task
        looked = (asked.where(F.col(log).isNull()).join(words.withColumnRenamed("code", word), word)
                  .withColumn(log, F.col("log")).drop("log"))
        asked = asked.where(F.col(log).isNotNull()).unionByName(looked)
    pairs = pairs.unionByName(asked.drop("w0", "w1"))
    step = math.log(ALPHA)
    ratio = F.col("log_count") - F.col("log_context")
    out = [stored_alone(_table(
        pairs.select("key", (ratio - F.lit(step) - F.col("log_last") + F.lit(frequent.log_total)).alias("gain"),
                     "log_count", ratio.alias("ratio")), frequent, buckets, order > 2))]
    # the pairs are in their table now: what they came from goes before longer n-grams are joined
    kept[0] = pairs = asked = looked = None
    release(counts.sparkSession)
    for n in range(3, order + 1):
        # both sides are joined by one long number, which Spark sorts without comparing rows
        longer = _kept_longer(kept[n - 2], frequent, n).join(_ratios(out[-1]), "suffix")
        out.append(stored_alone(_table(
            longer.select("key", (ratio - F.lit(step) - F.col("ratio")).alias("gain"), "log_count", ratio.alias("ratio")),
            frequent, buckets, n < order)))
    return out


def _summed(ids: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids and the sums of their values; without a sort where the ids are close to each other."""
    low = int(ids.min())
    span = int(ids.max()) - low + 1
    if span <= 8 * len(ids):
        at = ids - low
        u = np.flatnonzero(np.bincount(at, minlength=span))
        return u + low, np.bincount(at, values, span).take(u)
    u, at = np.unique(ids, return_inverse=True)
    return u, np.bincount(at, values, len(u))


def _sums(grams: DataFrame, gains: DataFrame, buckets: int) -> DataFrame:
    """(id, gain): sums of the gains of each document's n-grams, joined bucket by bucket.

    ``grams``: bucket, side, data (0: hashes, ids; 2: ids, sums); ``gains``: bucket, data (sorted hashes, gains).
    """

    def join(f: pd.DataFrame) -> pd.DataFrame:
        known = [unpacked(x, "<u8", "<f8") for x in f.loc[f["side"] == 1, "data"]]
        done = [unpacked(x, "<i8", "<f8") for x in f.loc[f["side"] == 2, "data"]]
        ids, values = [i for i, _ in done], [v for _, v in done]
        h, gain = (np.concatenate(x) for x in zip(*known)) if known else (np.zeros(0, np.uint64), np.zeros(0))
        sort, h = W.sorted_order(h)
        gain = gain.take(sort)
        for data in f.loc[f["side"] == 0, "data"] if known else ():
            asked, doc = unpacked(data, "<u8", "<i8")
            at = np.minimum(np.searchsorted(h, asked), len(h) - 1)
            hit = np.flatnonzero(h.take(at) == asked)
            if len(hit):
                u, sums = _summed(doc.take(hit), gain.take(at.take(hit)))
                ids.append(u)
                values.append(sums)
        if not ids:
            return pd.DataFrame({"id": [], "gain": []})
        out = pd.DataFrame({"id": np.concatenate(ids), "gain": np.concatenate(values)})
        del known, h, gain, ids, values, sort
        trim()
        return out

    sides = (grams
             .unionByName(gains.select("bucket", F.lit(1).alias("side"), "data")))
    return stored_alone(sides.groupBy("bucket").applyInPandas(join, "id long, gain double")
                  .groupBy("id").agg(F.sum("gain").alias("gain")))


def _asked(stored_runs: DataFrame, frequent: Frequent, common: Common | None, n: int, buckets: int, passes: int = 1,
           turn: int = 0) -> DataFrame:
    """The documents' ``n``-grams (for 1: the rare words), by bucket, packed.

    Side 0: hashes and ids; side 2: ids and what their common n-grams gain, in a bucket by chance.
    """
    shift = np.uint64(64 - (buckets.bit_length() - 1))

    def run(batches):
        for ids, known, hashes, places, at in _read_runs(batches):
            if n == 1:
                now = (frequent.codes(hashes) >= RARE).take(places)
                key = (hashes << np.uint64(1)).take(places)
            else:
                # a word's name is its hash with the top bit set, frequent or not
                names, now = (hashes | RARE).take(places), _inside(at, n)
                key = gram_hash([names[k:len(now) + k] for k in range(n)])
            doc = np.repeat(np.arange(len(ids)), np.diff(at))[:len(now)]
            if not known.all():
                now &= known.take(doc)
            if passes > 1:
                now &= (key >> shift) % np.uint64(passes) == np.uint64(turn)
            now = np.flatnonzero(now)
            key, doc = key.take(now), doc.take(now)
            out = []
            if common is not None and len(common.hashes):
                hit, gains = common.find(key)
                sums = np.bincount(doc[hit], gains, len(ids))
                some = np.flatnonzero(sums)
                if len(some):
                    any_bucket = int(W.mix(ids[some[:1]].view(np.uint64))[0] >> shift)
                    out.append((any_bucket, 2, packed(ids[some], sums[some])))
                rest = np.flatnonzero(~hit)
                key, doc = key.take(rest), doc.take(rest)
            sort = W.rough_order(key)
            key, doc = key.take(sort), ids.take(doc.take(sort))
            out += [(b, 0, packed(key[p], doc[p])) for b, p in _dealt(key, buckets)]
            yield _rows(out, ["bucket", "side", "data"], [pa.int32(), pa.int32(), pa.binary()])

    return stored_runs.mapInArrow(run, "bucket int, side int, data binary")


def _together(batches: Iterator[pa.RecordBatch]):
    """The rows of the batches, about FLUSH at a time."""
    run, held = [], 0
    for batch in batches:
        run.append(batch)
        held += batch.num_rows
        if held >= FLUSH:
            yield pa.Table.from_batches(run).combine_chunks().to_batches()[0]
            run, held = [], 0
    if held:
        yield pa.Table.from_batches(run).combine_chunks().to_batches()[0]


def _table(gains: DataFrame, frequent: Frequent, buckets: int, with_ratios: bool) -> DataFrame:
    """Rows (key, gain, log_count, ratio) by bucket of the key, packed: the sorted keys and gains, and (or null) the ratios;
    those of common n-grams in bucket -1."""
    shift = 64 - (buckets.bit_length() - 1)
    least = frequent.log_total - math.log(MAX_FREQUENT)

    def shown(ratio):
        return packed(ratio) if with_ratios else None

    def pack(batches):
        for batch in _together(batches):
            key, gain, log_count, ratio = (batch.column(k).to_numpy() for k in range(4))
            key = key.view(np.uint64)
            sort, key = W.sorted_order(key)
            gain, ratio, often = gain.take(sort), ratio.take(sort), log_count.take(sort) >= least
            out = [(-1, packed(key[often], gain[often]), shown(ratio[often]))] if often.any() else []
            if out:
                key, gain, ratio = key[~often], gain[~often], ratio[~often]
            yield _rows(out + [(b, packed(key[p], gain[p]), shown(ratio[p])) for b, p in _dealt(key, buckets)],
                        ["bucket", "data", "ratios"], [pa.int32(), pa.binary(), pa.binary()])

    assert 0 < shift < 64
    return gains.mapInArrow(pack, "bucket int, data binary, ratios binary")


def _ratios(table: DataFrame) -> DataFrame:
    """(suffix, ratio): the keys of a ``_table`` and the logs of count over the context's count."""

    def run(batches):
        for batch in batches:
            for data, ratios in zip(batch.column(0), batch.column(1)):
                key, _ = unpacked(data.as_py(), "<u8", "<f8")
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(unpacked(ratios.as_py(), "<f8")[0])],
                                                 ["suffix", "ratio"])

    return table.select("data", "ratios").mapInArrow(run, "suffix long, ratio double")


def _common(gains: DataFrame) -> Common:
    """The gains of bucket -1: at most MAX_FREQUENT."""
    found = [unpacked(r.data, "<u8", "<f8") for r in gains.where("bucket = -1").select("data").collect()]
    if not found:
        return Common(np.zeros(0, np.uint64), np.zeros(0))
    return Common(*(np.concatenate(x) for x in zip(*found)))


def _word_table(counts: DataFrame, buckets: int) -> DataFrame:
    """Log counts of the words by bucket of their hashes' lower 63 bits, which the codes of rare words hold."""

    def run(frames):
        for f in frames:
            for data in f["data"]:
                h, c = unpacked(data, "<u8", "<i8")
                key = h << np.uint64(1)
                sort, key = W.sorted_order(key)
                logs = np.log(c.take(sort).astype(np.float64))
                parts = [(b, packed(key[p], logs[p])) for b, p in _dealt(key, buckets)]
                yield pd.DataFrame({"bucket": [b for b, _ in parts], "data": [d for _, d in parts]})

    return counts.select("data").mapInPandas(run, "bucket int, data binary")


def _bases(stored_runs: DataFrame, frequent: Frequent, order: int) -> DataFrame:
    """(id, n_words, base): all of the base but the log counts of rare words."""
    step = math.log(ALPHA)

    def run(batches):
        for ids, known, hashes, places, at in _read_runs(batches):
            logs = np.nan_to_num(frequent.logs(frequent.codes(hashes)))[places]
            sums = np.concatenate([[0.0], np.cumsum(logs)])
            n = np.diff(at)
            steps = sum(np.maximum(0, n - k) for k in range(1, order))
            base = np.add.reduceat(np.append(logs, 0.0), np.minimum(at[:-1], len(logs))) if len(logs) else sums[at[:-1]]
            base = np.where(n > 0, base, 0.0) - n * frequent.log_total + steps * step
            yield pa.RecordBatch.from_arrays([pa.array(ids, mask=~known), pa.array(n, pa.int64()),
                                              pa.array(base, pa.float64())], ["id", "n_words", "base"])

    return stored_runs.mapInArrow(run, "id long, n_words long, base double")


def score(df: DataFrame, order: int = ORDER, min_count: int = MIN_COUNT, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """Per document: ``id_col``, n_words, log_score (sum over its words), mean_log_score."""
    if order < 2 or min_count < 1:
        raise ValueError("the order must be at least 2 and min_count at least 1")
    spark = df.sparkSession
    docs = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    # texts and runs are handed to Python in small batches: what a batch takes, it takes in the JVM as well
    with small_batches(spark, 1000):
        runs = stored_alone(_stored_runs(docs))
    size = runs.agg(F.sum("n")).first()[0] or 0
    buckets, look = (1 << max(6, (size // n).bit_length()) for n in (BUCKET, LOOKUP_BUCKET))
    kept: list[DataFrame] = []
    with small_batches(spark, 8):
        counts = stored_alone(_word_counts(runs, buckets))
        frequent = _frequent(counts)
        for n in range(2, order + 1):
            kept.append(_counted(runs, kept[-1] if kept else None, frequent, n, min_count, buckets))
    gains = _gains(kept, counts, frequent, order, look)
    del kept
    release(spark)
    parts = []
    with small_batches(spark, 8):
        for n in range(1, order + 1):
            known = _word_table(counts, look) if n == 1 else gains[n - 2].select("bucket", "data")
            common = None if n == 1 else _common(known)
            passes = 1 if n == 1 else PASSES
            known = known.where("bucket >= 0")
            for turn in range(passes):
                parts.append(_sums(_asked(runs, frequent, common, n, look, passes, turn),
                                   known.where(F.col("bucket") % passes == turn), look))
        total = stored_alone(_bases(runs, frequent, order).where("id is not null"))
    for p in parts:
        total = total.unionByName(p.select("id", F.lit(0).cast("bigint").alias("n_words"), F.col("gain").alias("base")))
    return (total.groupBy("id").agg(F.sum("n_words").alias("n_words"), F.sum("base").alias("log_score"))
            .select(F.col("id").alias(id_col), "n_words", "log_score",
                    F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")).alias("mean_log_score")))
