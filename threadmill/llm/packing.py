"""Token ids in binary files of fixed-width packed integers.

Every id takes ``bits`` bits, the fewest that hold the vocabulary's largest
id, one after another from the lowest bit of the first payload byte.  A file
is a row of blocks, each followed by one byte 0x0A (ignored by readers):

    magic "TMBP", version u16, bits u16, n_docs u32, n_ids u64, payload bytes u64   (28 bytes)
    document keys   i64 x n_docs     (the smallest i64 stands for a null key)
    offsets         u64 x (n_docs+1) first id of each document, and the end
    payload         the packed ids

All integers are little-endian.  Since the width is fixed, id k of a block
lies at bit ``k * bits``: any document, or any id, is read by computing its
place, and whole ranges are unpacked with numpy.

Writing: documents are range-partitioned by key, sorted inside a partition,
and each partition is one file, so the files in the order of their part
numbers hold the documents in ascending key order.  Spark's own writer
commits the files, so lost or repeated tasks leave no partial file, and any
file system that Spark knows will do; they are read back with Spark's
``binaryFile`` source.  The number of partitions follows the bytes of text, so
a file and a task stay bounded at any input size.

Defined results: a null text is the empty text (its document still gets the
end id, if there is one); equal keys stay next to each other, ordered by text;
a null key sorts first; an empty table writes no block and reads as no rows;
other input columns are left out of the files.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.joins import broadcast_if
from . import wordbpe
from .base import per_worker, stored

MAGIC = b"TMBP"
HEADER = "<4sHHIQQ"
HEADER_BYTES = struct.calcsize(HEADER)
NULL_KEY = -(2 ** 63)
#: Ids of a block after which a new block starts (a document is never split).
BLOCK_IDS = 1 << 20
#: Bytes of text for one file.
FILE_TEXT_BYTES = 24 << 20
#: At most so many files' totals (16 bytes each) are broadcast.
MAX_BROADCAST_FILES = 1_000_000


def width(max_id: int) -> int:
    """The fewest bits that hold ``max_id``."""
    return max(1, int(max_id).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """``ids`` at ``bits`` bits each, lowest bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    shown = (ids.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(shown.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(payload: bytes | memoryview, bits: int, first: int, last: int) -> np.ndarray:
    """Ids ``first`` to ``last`` (end exclusive) of a packed payload, without reading what is before."""
    if last <= first:
        return np.zeros(0, np.uint32)
    start = first * bits
    raw = np.frombuffer(payload, np.uint8)[start // 8:(last * bits + 7) // 8]
    at = np.arange(last - first, dtype=np.int64) * bits + start % 8
    words = np.zeros(len(raw) + 8, np.uint8)
    words[: len(raw)] = raw
    value = np.zeros(len(at), np.uint64)
    for k in range((bits + 7 + 7) // 8):
        value |= words[(at >> 3) + k].astype(np.uint64) << np.uint64(8 * k)
    return ((value >> (at & 7).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.uint32)


def block(keys: list[int], rows: list[bytes], bits: int) -> bytes:
    """One block of documents whose ids are given as little-endian unsigned 32-bit integers."""
    offsets = np.concatenate([[0], np.cumsum([len(r) // 4 for r in rows])]).astype("<u8")
    payload = pack(np.frombuffer(b"".join(rows), "<u4"), bits)
    head = struct.pack(HEADER, MAGIC, 1, bits, len(keys), int(offsets[-1]), len(payload))
    return head + np.asarray(keys, "<i8").tobytes() + offsets.tobytes() + payload


def blocks(data: bytes) -> Iterator[tuple[int, np.ndarray, np.ndarray, int, memoryview]]:
    """(start in the file, keys, offsets, bits, payload) of every block of a file."""
    at, view = 0, memoryview(data)
    while at < len(view):
        magic, version, bits, n_docs, n_ids, size = struct.unpack_from(HEADER, view, at)
        if magic != MAGIC or version != 1:
            raise ValueError("not a packed token file")
        keys_at = at + HEADER_BYTES
        offsets_at = keys_at + 8 * n_docs
        payload_at = offsets_at + 8 * (n_docs + 1)
        keys = np.frombuffer(view, "<i8", n_docs, keys_at)
        offsets = np.frombuffer(view, "<u8", n_docs + 1, offsets_at).astype(np.int64)
        if offsets[-1] != n_ids or payload_at + size > len(view):
            raise ValueError("a packed token file is cut off")
        yield at, keys, offsets, bits, view[payload_at:payload_at + size]
        at = payload_at + size + 1


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int | None, key_col: str = "doc_id",
          text_col: str = "text", file_text_bytes: int = FILE_TEXT_BYTES) -> None:
    """Encode ``text_col`` with the tokenizers library and write the files to ``path``."""
    slim = docs.select(F.col(key_col).cast("bigint").alias("key"), F.col(text_col).alias("text"))
    total = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_files = max(1, -(-total // file_text_bytes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = per_worker(f"library {tokenizer}", lambda: wordbpe.library_encoder(tokenizer))
        bits = width(max(encoder.pieces.library.get_vocab_size(with_added_tokens=True) - 1, end_id or 0))
        end = b"" if end_id is None else struct.pack("<I", end_id)
        keys: list[int] = []
        rows: list[bytes] = []
        held = 0

        def flushed():
            return pa.RecordBatch.from_arrays([pa.array([block(keys, rows, bits)], pa.binary())], ["block"])

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                row = (encoder.encode(text) if text else b"") + end
                keys.append(NULL_KEY if key is None else key)
                rows.append(row)
                held += len(row) // 4
                if held >= BLOCK_IDS:
                    yield flushed()
                    keys, rows, held = [], [], 0
        if keys:
            yield flushed()

    sorted_docs = slim.repartitionByRange(n_files, "key").sortWithinPartitions("key", "text")
    # the text writer copies a string's bytes as they are, so a block lands unchanged
    (sorted_docs.mapInArrow(run, "block binary").select(F.col("block").cast("string"))
     .write.option("lineSep", "\n").text(path))


def _files(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select(F.regexp_extract(F.col("path"), r"part-(\d+)", 1).cast("int").alias("file"), "path", "content")


def index(spark: SparkSession, path: str) -> DataFrame:
    """Per block: file, path, start in the file, first and last key, documents, ids - for random access."""

    def run(batches):
        for batch in batches:
            out = []
            for file, where, data in zip(*(c.to_pylist() for c in batch.columns)):
                for at, keys, offsets, _, _ in blocks(data):
                    out.append((file, where, at, int(keys.min()), int(keys.max()), len(keys), int(offsets[-1])))
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], schema)

    names = ["file", "path", "start", "first_key", "last_key", "n_docs", "n_ids"]
    kinds = [pa.int32(), pa.string()] + [pa.int64()] * 5
    schema = pa.schema(list(zip(names, kinds)))
    return _files(spark, path).mapInArrow(
        run, "file int, path string, start long, first_key long, last_key long, n_docs long, n_ids long")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The documents of the files: key, ``start`` (ids of all documents before), n_tokens, token_ids."""
    return _placed(spark, path, "token_ids array<int>", lambda ids, a, b: ids[a:b].astype(np.int32),
                   pa.list_(pa.int32()))


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    """Like ``read``, with the CRC-32 of each document's ids as little-endian unsigned 32-bit integers."""
    return _placed(spark, path, "ids_crc32 long", lambda ids, a, b: zlib.crc32(ids[a:b]), pa.int64())


def _placed(spark: SparkSession, path: str, column: str, value, kind: pa.DataType) -> DataFrame:
    name = column.split()[0]

    def run(batches):
        for batch in batches:
            for file, _, data in zip(*(c.to_pylist() for c in batch.columns)):
                before = 0
                for _, keys, offsets, bits, payload in blocks(data):
                    ids = unpack(payload, bits, 0, int(offsets[-1])).astype("<u4")
                    values = [value(ids, a, b) for a, b in zip(offsets[:-1], offsets[1:])]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([file] * len(keys), pa.int32()),
                         pa.array([None if k == NULL_KEY else k for k in keys.tolist()], pa.int64()),
                         pa.array(offsets[:-1] + before, pa.int64()), pa.array(np.diff(offsets), pa.int64()),
                         pa.array(values, kind)], ["file", "key", "inside", "n_tokens", name])
                    before += int(offsets[-1])

    rows = stored(_files(spark, path).mapInArrow(run, f"file int, key long, inside long, n_tokens long, {column}"))
    # one row per file: the files' totals, summed up in file order
    upto = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    firsts = stored(rows.groupBy("file").agg(F.sum("n_tokens").alias("n"))
                    .select("file", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("first")))
    firsts = broadcast_if(firsts, firsts.count(), MAX_BROADCAST_FILES)
    return rows.join(firsts, "file").select("key", (F.col("first") + F.col("inside")).alias("start"), "n_tokens", name)
