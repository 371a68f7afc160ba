"""Ranked lexical search of stated items over all documents, by the Best Position Algorithm.

A term of a document has an impact: the term's weight times a saturated
frequency, all in integers (see ``impact``).  An item's score for a document
is the sum of its terms' impacts, repeats included.

Two passes over the documents, neither with a shuffle of texts.  The first
counts what the weights need: documents with terms, all terms, and for each
term of the items the documents that hold it.  The second builds impact lists
for blocks of documents - per term the postings by falling impact, and per
document its postings, each with its place in its list - and runs every item
over every block:

* sorted access: the next places of all lists of the item are read;
* direct access: every document met for the first time is looked up in all
  lists, which gives its score and marks its place in each of them as seen;
* each list's best position is the end of its unbroken run of seen places.  A
  document not met yet stands behind the best position in every list, so its
  score is at most the sum of the impacts found right behind them - never more
  than at the last places read, often less, since direct accesses fill gaps;
* the search of a block stops when that sum is strictly below the k-th best
  score known (of this block or of earlier blocks of the same task).

A document that ties with the k-th score is never cut off by the threshold;
ties are decided by the id.  Each task returns at most k documents an item,
and a grouped top k over tasks ends the search.  A block holds a bounded number of
postings, and one document more at most.  Items are a stated query set; they
go to the tasks in runs of at most QUERY_BYTES of text, one pass for each run.

Defined results: null and empty texts have no terms and are never returned;
an item without terms, or with none that a document holds, returns nothing;
documents that share an id or a text are documents of their own (equal score
and id: any order); documents without an id count in the statistics and are
not returned; rows of one item id are items of their own, each with its ranks;
texts are read whole; empty tables give no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.rank import top_n_per_group
from .base import small_batches, stored, trim

#: Everything but digits, ASCII letters and bytes from 0x80 parts terms; A-Z become a-z.
_TERM = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(0x80, 0x100))
TABLE = bytes(c if c in _TERM else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
#: Bytes of item text in one pass, postings of a block.
QUERY_BYTES, BLOCK_POSTINGS = 4 << 20, 3_000_000
#: Places of every list that the first step of a search reads; each step reads twice as many.
FIRST_STEP = 32
#: Row numbers of what the counting pass says besides terms.
N_DOCS, N_TERMS = -1, -2


def terms(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def length_norm(n: int, n_docs: int, n_terms: int) -> int:
    return 25 + 75 * n * n_docs // n_terms


def impact(weights: np.ndarray, tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
    return weights * (1_000_000_000 * tf // (1000 * tf + 8 * norm))


def statistics(docs: DataFrame, wanted: dict[bytes, int]) -> dict[int, int]:
    """Documents that hold each wanted term (by its number), and N_DOCS and N_TERMS of all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                words = terms(text.as_buffer().to_pybytes()) if text.is_valid else ()
                if words:
                    held[N_DOCS] += 1
                    held[N_TERMS] += len(words)
                    held.update(wanted[w] for w in wanted.keys() & set(words))
        yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.int64()), pa.array(held.values(), pa.int64())],
                                         ["term", "n"])

    rows = (docs.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
            .collect())  # at most the items' distinct terms and two more
    return {r["term"]: r["n"] for r in rows}


class Block:
    """The impact lists of some documents, and per document its postings with their places in the lists."""

    def __init__(self, ids: list[int], sizes: list[int], term: np.ndarray, value: np.ndarray, n_terms: int):
        self.ids = np.array(ids, np.int64)
        sizes = np.array(sizes, np.int64)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        self.doc_start = np.concatenate([[0], np.cumsum(sizes)])
        order = np.lexsort((doc, -value, term))
        #: by list place: impact and document; by document: where each posting stands in the lists
        self.value, self.doc = value[order], doc[order].astype(np.int32)
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.arange(len(order))
        self.term = term.astype(np.int32)
        self.list_start = np.searchsorted(term[order], np.arange(n_terms + 1))

    def search(self, query: list[tuple[int, int]], k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """(document numbers, scores) of the ``k`` best of the block that reach ``floor``, for (term, times)."""
        query = [(t, q) for t, q in query if self.list_start[t] < self.list_start[t + 1]]
        best, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not query:
            return best, scores
        own = np.array([t for t, _ in query])
        times = np.array([q for _, q in query], np.int64)
        factor = np.zeros(len(self.list_start), np.int64)
        factor[own] = times
        start, end = self.list_start[own], self.list_start[own + 1]
        seen = np.zeros(len(self.doc), bool)
        met = np.zeros(len(self.ids), bool)
        read, position, step, kth = start.copy(), start.copy(), FIRST_STEP, floor
        while True:
            # sorted access: the next places of every list
            until = np.minimum(read + step, end)
            new = np.unique(self.doc[_ranges(read, until)])
            new = new[~met[new]]
            read, step = until, step * 2
            met[new] = True
            if len(new):
                # direct access: all postings of the documents just met
                sizes = self.doc_start[new + 1] - self.doc_start[new]
                at = _ranges(self.doc_start[new], self.doc_start[new + 1])
                often = factor[self.term[at]]
                mine = often > 0
                place = self.place[at[mine]]
                seen[place] = True
                total = np.zeros(len(new), np.int64)
                np.add.at(total, np.repeat(np.arange(len(new)), sizes)[mine], often[mine] * self.value[place])
                good = total >= max(kth, 1)
                best, scores = np.concatenate([best, new[good]]), np.concatenate([scores, total[good]])
                if len(best) > k:
                    top = np.lexsort((self.ids[best], -scores))[:k]
                    best, scores = best[top], scores[top]
                if len(best) == k:
                    kth = max(kth, int(scores.min()))
            # best positions: the first place of each list that is not seen
            bound = 0
            for i, (a, b) in enumerate(zip(position.tolist(), end.tolist())):
                while a < b:
                    run = seen[a:a + 4096 if a + 4096 < b else b]
                    gap = int(run.argmin())
                    if not run[gap]:
                        a += gap
                        break
                    a += len(run)
                position[i] = a
                if a < b:
                    bound += int(times[i]) * int(self.value[a])
            # no document that was not met can score above the bound
            if bound < max(kth, 1) or (read >= end).all():
                return best, scores


def _ranges(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All numbers of the ranges [start, end), one range after the other."""
    sizes = end - start
    total = int(sizes.sum())
    shift = np.repeat(start - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
    return np.arange(total) + shift


def _blocks(batches: Iterator[pa.RecordBatch], wanted: dict[bytes, int], weights: np.ndarray, n_docs: int,
            n_terms: int) -> Iterator[Block]:
    ids: list = []
    sizes: list = []
    rows: list = []
    tfs: list = []
    norms: list = []

    def made() -> Block:
        size = np.array(sizes, np.int64)
        term = np.array(rows, np.int64)
        value = impact(weights[term], np.array(tfs, np.int64), np.repeat(np.array(norms, np.int64), size))
        return Block(ids, sizes, term, value, len(weights))

    known = wanted.keys()
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            words = terms(text.as_buffer().to_pybytes()) if key is not None and text.is_valid else ()
            if not words:
                continue
            held = Counter(words)
            here = [(wanted[w], held[w]) for w in known & held.keys()]
            if not here:
                continue
            ids.append(key)
            sizes.append(len(here))
            norms.append(length_norm(len(words), n_docs, n_terms))
            for t, n in here:
                rows.append(t)
                tfs.append(n)
            if len(rows) >= BLOCK_POSTINGS:
                yield made()
                for column in (ids, sizes, rows, tfs, norms):
                    column.clear()
    if ids:
        yield made()


def _found(docs: DataFrame, items: list[tuple[int, bytes]], k: int) -> DataFrame:
    """(number, doc, score): at most ``k`` rows of every task for every item."""
    asked = [(number, Counter(terms(text))) for number, text in items]
    vocabulary = sorted(set().union(*(c.keys() for _, c in asked)))
    wanted = {w: i for i, w in enumerate(vocabulary)}
    stats = statistics(docs, wanted)
    n_docs, n_terms = stats.get(N_DOCS, 0), stats.get(N_TERMS, 0)
    # terms that no document holds change no score
    kept = [i for i in range(len(vocabulary)) if stats.get(i)]
    wanted = {vocabulary[i]: at for at, i in enumerate(kept)}
    weights = np.array([weight(n_docs, stats[i]) for i in kept], np.int64)
    queries = [(number, [(wanted[w], q) for w, q in c.items() if w in wanted]) for number, c in asked]
    queries = [(number, q) for number, q in queries if q]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        floor: dict[int, int] = {}
        for block in _blocks(batches, wanted, weights, n_docs, n_terms):
            for number, query in queries:
                at, score = block.search(query, k, floor.get(number, 1))
                if len(at):
                    old = best.get(number, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
                    doc, score = np.concatenate([old[0], block.ids[at]]), np.concatenate([old[1], score])
                    top = np.lexsort((doc, -score))[:k]
                    best[number] = doc[top], score[top]
                    if len(top) == k:
                        floor[number] = int(score[top[-1]])
        trim()
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(list(best), [len(d) for d, _ in best.values()]).astype(np.int64), pa.int64()),
             pa.array(np.concatenate([np.zeros(0, np.int64)] + [d for d, _ in best.values()]), pa.int64()),
             pa.array(np.concatenate([np.zeros(0, np.int64)] + [s for _, s in best.values()]), pa.int64())],
            ["number", "doc", "score"])

    return docs.mapInArrow(run, "number long, doc long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text", query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(``item_col``, rank, ``id_col``, score): the ``k`` best documents of every item with a score above 0."""
    if k < 1:
        raise ValueError("k must be at least 1")
    slim = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("binary").alias("text"))
    numbered = stored(items.select(F.col(item_col).alias("item"), F.col(item_text_col).cast("binary").alias("text"))
                      .withColumn("number", F.monotonically_increasing_id()))
    size = numbered.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_runs = max(1, -(-size // query_bytes))
    parts = []
    for run in range(n_runs):
        mine = numbered.where(F.pmod(F.xxhash64("number"), F.lit(n_runs)) == run).where("text is not null")
        # about QUERY_BYTES of text
        chosen = [(r["number"], bytes(r["text"])) for r in mine.select("number", "text").collect()]
        with small_batches(docs.sparkSession, 1000):
            found = _found(slim, chosen, k)
            parts.append(stored(top_n_per_group(found, ["number"], [F.col("score").desc(), F.col("doc").asc()], k,
                                                rank_col="rank")))
    best = parts[0]
    for more in parts[1:]:
        best = best.unionByName(more)
    # one row per item; the best rows are at most k times as many
    return best.join(numbered.select("number", "item"), "number").select(
        F.col("item").alias(item_col), "rank", F.col("doc").alias(id_col), "score")
