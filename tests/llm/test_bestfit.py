"""Best-fit packing: bounds against exhaustive packing, pieces and places against the library."""

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import public_tokenizers
from texts import docs, empty, rows
from threadmill.llm import bestfit as B
from threadmill.llm import queries as Q
from threadmill.llm.bytebpe import ByteEncoder

SF = "/root/testdata/sf0.001"
NAME = "byte_bpe_50k.json"


def least_bins(lengths, capacity):
    """The fewest bins, by trying every assignment."""
    best = len(lengths)

    def place(i, free):
        nonlocal best
        if len(free) >= best:
            return
        if i == len(lengths):
            best = len(free)
            return
        for k in range(len(free)):
            if free[k] >= lengths[i] and free[k] not in free[:k]:
                place(i + 1, free[:k] + [free[k] - lengths[i]] + free[k + 1:])
        place(i + 1, free + [capacity - lengths[i]])

    place(0, [])
    return best


def test_bounds_never_exceed_the_optimum_and_beat_the_volume():
    rng = np.random.default_rng(5)
    sharper = 0
    for _ in range(300):
        capacity = int(rng.integers(5, 30))
        lengths = sorted(rng.integers(1, capacity + 1, rng.integers(1, 9)).tolist(), reverse=True)
        bound = B.lower_bound(np.bincount(lengths, minlength=capacity + 1))
        assert -(-sum(lengths) // capacity) <= bound <= least_bins(lengths, capacity)
        sharper += bound > -(-sum(lengths) // capacity)
    assert sharper > 30
    assert B.lower_bound(np.zeros(9, int)) == 0


def test_best_fit_takes_the_fullest_bin_that_fits():
    where, offset, used = B.best_fit(np.array([3, 7, 5, 2, 3]), 10)
    # 7; 5; the first 3 goes next to the 7, the other to the 5, the 2 fills that one up
    assert used == 2 and where.tolist() == [0, 0, 1, 1, 1] and offset.tolist() == [7, 0, 0, 8, 5]
    rng = np.random.default_rng(1)
    for _ in range(50):
        lengths = rng.integers(1, 65, 200)
        where, offset, used = B.best_fit(lengths, 64)
        held = np.bincount(where, lengths, used)
        assert held.max() <= 64
        for b in range(used):
            at = np.flatnonzero(where == b)
            at = at[np.argsort(offset[at])]
            assert offset[at].tolist() == [0, *np.cumsum(lengths[at])[:-1].tolist()]


def test_cut():
    assert B.cut(5, 4) == [1, 4] and B.cut(8, 4) == [4, 4] and B.cut(4, 4) == [4] and B.cut(1, 4) == [1]


def test_encoder_equals_the_library():
    library = Tokenizer.from_file(public_tokenizers.path(NAME))
    encoder = ByteEncoder(NAME)
    assert encoder.ranked is not None
    texts = [r[1] for r in rows() if r[1]] + [
        "a  b\t\n c \n\n", "don't I'LL we've 's", "x\x1cy\x85z", "<|endoftext|> <|endoftext", "日本語 ½ ①", " lead", "tail ",
        "1234567 12 ٣", "é é ß ſ", "a b c", "<b>" * 50, "\x00\x01\x7f", "naïve— “quote”"]
    for t in texts:
        assert encoder.encode(t).tolist() == library.encode(t, add_special_tokens=False).ids


def check(packed, texts, capacity, end_id, key="doc_id"):
    """Pieces cover every document's ids in order, and sequences are gapless and not too long."""
    library = Tokenizer.from_file(public_tokenizers.path(NAME))
    want = sorted(((k, library.encode(t or "", add_special_tokens=False).ids + [end_id]) for k, t in texts),
                  key=lambda r: (r[0] is not None, r[0] or 0, len(r[1])))
    expected = []
    for k, ids in want:
        start = 0
        for p, n in enumerate(B.cut(len(ids), capacity)):
            part = np.array(ids[start:start + n], "<u4").tobytes()
            expected.append((k, p, start, n, zlib.crc32(part)))
            start += n
    found = packed.collect()
    order = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted(((r[key], r.piece, r.start, r.length, r.ids_crc32) for r in found), key=order) == \
        sorted(expected, key=order)
    by_seq = {}
    for r in found:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_seq)


@pytest.mark.parametrize("capacity", [7, 64, 2048])
def test_awkward_rows(spark, capacity):
    data = rows() + [(3, "shares an id", *rows()[0][2:]), (None, "no id", *rows()[0][2:])] * 2
    packed = B.pack(docs(spark, data), NAME, 0, capacity)
    used = check(packed, [(r[0], r[1]) for r in data], capacity, 0)
    assert B.bound(packed, capacity)[0] == used >= B.bound(packed, capacity)[1]


def test_empty(spark):
    packed = B.pack(empty(spark), NAME, 0)
    assert packed.collect() == [] and B.bound(packed) == (0, 0)


def test_gaps_exchange_documents(spark, monkeypatch):
    """With many small partitions, exchanges bring the sequences down to the bound of the whole table."""
    monkeypatch.setattr(B, "PART_ITEMS", 40)
    rng = np.random.default_rng(2)
    items = spark.createDataFrame([(i, int(n)) for i, n in enumerate(rng.integers(300, 2048, 900))], "item long, length long")
    lengths = {r.item: r.length for r in items.collect()}
    count = {}
    for rounds in (0, 6):
        placed = B.places(items, rounds=rounds).collect()
        assert sorted(r.item for r in placed) == sorted(lengths)
        held = {}
        for r in placed:
            held[r.sequence_id] = held.get(r.sequence_id, 0) + lengths[r.item]
        assert max(held.values()) <= 2048
        count[rounds] = len(held)
    best = B.lower_bound(np.bincount(list(lengths.values()), minlength=2049))
    assert best <= count[6] < count[0]


def test_query_and_sequences(spark):
    data = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    out = Q.QUERIES["op11_best_fit_packing"](spark, SF)
    used = check(out, data, 2048, 0)
    counts = np.bincount([r.length for r in out.collect()], minlength=2049)
    assert used <= B.lower_bound(counts) + 1
    packed = B.pack(spark.read.parquet(f"{SF}/documents.parquet"), NAME, 0, keep_ids=True)
    found = {r.sequence_id: r.ids for r in B.sequences(packed).collect()}
    assert len(found) == used
    for r in packed.collect():
        assert zlib.crc32(bytes(found[r.sequence_id])[4 * r.offset:4 * (r.offset + r.length)]) == r.ids_crc32
