import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from texts import docs, empty, rows
from tokenizers import Tokenizer

import public_tokenizers
from threadmill.llm import bpe, packing, wordbpe

NAME = "word_bpe_49k.json"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(NAME))


def odd_texts():
    rng = random.Random(4)
    letters = [chr(c) for c in [*range(1, 128), *range(0xA0, 0x260), 0x301, 0x3A3, 0x3C2, 0x2028, 0x4E2D, 0x1F600]]
    out = [r[1] or "" for r in rows()]
    out += ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(1500)]
    out += ["".join(rng.choice("abehtinr 's<|endoftext|>") for _ in range(rng.randrange(60))) for _ in range(1500)]
    return out + [c * n for c in "ab!=-*é" for n in (1, 2, 3, 7, 50, 999)]


def test_both_encoders_equal_the_library(library):
    pieces = wordbpe.Pieces(NAME)
    own = wordbpe.Encoder(pieces, bpe.BacktrackingBpe(pieces.spec).encode)
    other = wordbpe.library_encoder(NAME)
    for t in odd_texts():
        ids = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(t), "<u4").tolist() == ids, t
        assert np.frombuffer(other.encode(t), "<u4").tolist() == ids, t


def test_full_tables_are_emptied_without_changing_ids(library, monkeypatch):
    monkeypatch.setattr(wordbpe, "MAX_CHUNKS", 5)
    monkeypatch.setattr(wordbpe, "MAX_PIECES", 3)
    monkeypatch.setattr(bpe, "MAX_PAIRS", 4)
    pieces = wordbpe.Pieces(NAME)
    own = wordbpe.Encoder(pieces, bpe.BacktrackingBpe(pieces.spec).encode)
    for t in odd_texts()[10:60]:
        assert np.frombuffer(own.encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


def test_encode_and_decode_columns(spark, library):
    out = bpe.decode(bpe.encode(docs(spark), NAME), NAME).collect()
    assert len(out) == 60
    for r in out:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert list(r.token_ids) == ids
        assert r.decoded == library.decode(ids, skip_special_tokens=False)
    assert bpe.decode(bpe.encode(empty(spark), NAME), NAME).count() == 0


@pytest.mark.parametrize("bits", [1, 3, 7, 8, 9, 13, 16, 17, 31, 32])
def test_pack_round_trip_and_random_access(bits):
    ids = np.random.default_rng(bits).integers(0, 2 ** bits, 1001, dtype=np.uint64).astype(np.uint32)
    data = packing.pack(ids, bits)
    assert len(data) == -(-1001 * bits // 8)
    for a, b in ((0, 1001), (0, 0), (5, 6), (333, 900), (1000, 1001)):
        assert packing.unpack(data, bits, a, b).tolist() == ids[a:b].tolist()


def test_width():
    assert [packing.width(n) for n in (0, 1, 2, 255, 256, 49407)] == [1, 1, 2, 8, 9, 16]


def test_files_hold_all_ids_in_key_order(spark, library, scratch, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_IDS", 50)
    path = scratch + "/tokens"
    df = docs(spark).unionByName(docs(spark, [(None, "no id", *[None] * 10), (7, "again", *[None] * 10)]))
    packing.write(df, path, NAME, 2, file_text_bytes=20_000)
    data = sorted([(r.doc_id is not None, r.doc_id or 0, r.text or "") for r in df.collect()])
    got = sorted(packing.read(spark, path).collect(), key=lambda r: r.start)
    sums = {(r.start, r.n_tokens): r.ids_crc32 for r in packing.read_checksums(spark, path).collect()}
    start = 0
    for (known, key, text), r in zip(data, got, strict=True):
        ids = library.encode(text, add_special_tokens=False).ids + [2]
        assert (r.key, r.start, r.n_tokens, list(r.token_ids)) == (key if known else None, start, len(ids), ids)
        assert sums[start, len(ids)] == zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))
        start += len(ids)
    index = packing.index(spark, path).collect()
    assert sum(r.n_docs for r in index) == len(data) and sum(r.n_ids for r in index) == start and len(index) > 3
    assert len({r.file for r in index}) > 1
    # random access: one block from its place in its file
    r = index[-1]
    with open(r.path.removeprefix("file:"), "rb") as f:
        f.seek(r.start)
        _, keys, offsets, bits, payload = next(packing.blocks(f.read()))
    assert int(keys[0]) == r.first_key and bits == 16
    assert len(packing.unpack(payload, bits, int(offsets[0]), int(offsets[1]))) == offsets[1]


def test_empty_table_writes_readable_files(spark, scratch):
    packing.write(empty(spark), scratch + "/none", NAME, 2)
    assert packing.read(spark, scratch + "/none").count() == 0


def test_cut_file_is_refused():
    data = packing.block([1], [struct.pack("<3I", 1, 2, 3)], 16)
    with pytest.raises(ValueError):
        list(packing.blocks(data[:-1]))


def test_a_long_chunk_is_encoded_and_not_kept():
    from tokenizers import Tokenizer
    import public_tokenizers
    text = "ab1" * 200_000 + " x " + "q" * 100_000
    pieces = wordbpe.Pieces(NAME)
    encoder = wordbpe.Encoder(pieces, bpe.BacktrackingBpe(pieces.spec).encode)
    ids = np.frombuffer(encoder.encode(text), "<u4").tolist()
    library = Tokenizer.from_file(public_tokenizers.path(NAME))
    assert ids == library.encode(text, add_special_tokens=False).ids
    assert max(map(len, encoder.chunks)) <= wordbpe.MAX_KEPT_CHARS
    assert max(map(len, encoder.chunks.piece_ids)) <= wordbpe.MAX_KEPT_CHARS


def test_one_pass_equals_encoding_and_decoding(spark):
    rows = [(i, t, "x") for i, t in enumerate(["", None, "One  two\nthree", "ünïcode 漢字 <s> \x1c", "a" * 5000, "Again again"])]
    df = spark.createDataFrame(rows, "doc_id long, text string, decoded string")
    both = {r.doc_id: (r.token_ids, r.decoded) for r in bpe.encode_decode(df, NAME).collect()}
    apart = bpe.decode(bpe.encode(df, NAME), NAME)
    assert both == {r.doc_id: (r.token_ids, r.decoded) for r in apart.collect()}
    assert bpe.encode_decode(df, NAME).columns == ["doc_id", "token_ids", "decoded"]
    assert bpe.encode_decode(df.limit(0), NAME).count() == 0


def test_the_backtracking_encoder_keeps_no_second_vocabulary(library):
    """The library only normalises and splits there; a worker held its vocabulary and merges besides its own tables."""
    encoder = bpe._encoder(NAME)
    assert encoder.pieces.library.get_vocab_size() == 0
    for t in odd_texts():
        assert np.frombuffer(encoder.encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_encoding_and_decoding_takes_few_rows_at_once(spark, library, monkeypatch):
    sizes = []

    class Plan:
        columns, schema = ["doc_id", "text"], spark.range(0).withColumnsRenamed({"id": "doc_id"}).schema

        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            return run

    monkeypatch.setattr(bpe, "_encoded", lambda texts, _, f=bpe._encoded: (sizes.append(len(texts)), f(texts, _))[1])
    texts = [f"text number {i} あ" for i in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(300), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    out = pa.Table.from_batches(list(bpe.encode_decode(Plan(), NAME)(iter([batch]))))
    assert max(sizes) <= 64 and out.column("doc_id").to_pylist() == list(range(300))
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert out.column("token_ids").to_pylist() == want
    assert out.column("decoded").to_pylist() == [library.decode(i, skip_special_tokens=False) for i in want]


def test_words_of_letters_are_not_split(monkeypatch):
    """A word that is one piece by its letters is neither split nor shown byte by byte; the ids stay the library's."""
    encoder = wordbpe.library_encoder(NAME)
    split, find, library = [], encoder.pieces.pattern.findall, encoder.pieces.library

    class Pattern:
        findall = staticmethod(lambda chunk: (split.append(chunk), find(chunk))[1])

    monkeypatch.setattr(encoder.pieces, "pattern", Pattern)
    text = "Some été words, it's x1 ½ a\x01b ªº ßĸ end."
    for _ in range(2):
        assert list(struct.unpack(f"<{len(encoder.encode(text)) // 4}I", encoder.encode(text))) == \
            library.encode(text, add_special_tokens=False).ids
    assert sorted(split) == sorted(["words,", "it's", "x1", "½", "a\x01b", "end."])
    assert encoder.pieces.show(word := "".join(["lett", "ers"])) is word
