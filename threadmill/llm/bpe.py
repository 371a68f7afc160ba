"""BPE encoding by backtracking over longest matches, and decoding by an offset table.

A word is a string over letters (byte characters; the last one carries the
end-of-word mark and so is a letter of its own).  Running an Aho-Corasick
automaton of the reversed tokens over the reversed word gives, in one linear
pass, the longest token that starts at each place.  The encoder takes the
longest match, checks it against the token before it in a pair-compatibility
table, tries shorter prefixes of it, and steps back where none fits; places
from which no encoding exists are marked, so none is tried twice.  A sequence
in which every neighbouring pair is compatible is the one that merging by
rank gives, so the result is exact.

Two neighbours are compatible when merging their joined letters by rank gives
the same two tokens back.  On the way from letters to a token its right edge
runs through a chain of sub-tokens, and so does the left edge of the next
one; a merge across the seam happens when a pair of chain members has a merge
that is due before either of them is merged inside its own token.

Decoding gathers each id's characters from one byte table by offset and
length, for whole batches at once; the file has no decoder, so tokens are
joined by a space.

Defined results: a null or empty text, and one of white space alone, has no
ids and decodes to ''; repeated rows and ties do not matter, each row is
encoded on its own; all input columns are kept, and one named like an output
column is replaced.  Long texts are encoded whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import wordbpe
from .base import arrow_columns, per_worker, trim

#: Entries of a worker's pair-compatibility table before it is emptied.
MAX_PAIRS = 200_000
#: Rows of a slice that is encoded and decoded at once.
DECODE_ROWS = 64
#: Added to a character's code to make the letter that ends a word.
END = 0xE000


class BacktrackingBpe:
    """Exact BPE of one word by backtracking (see the module's text)."""

    def __init__(self, spec: dict):
        import ahocorasick
        model = spec["model"]
        suffix = model["end_of_word_suffix"]

        def letters(token: str) -> str:
            if token.endswith(suffix) and len(token) > len(suffix):
                body = token[: -len(suffix)]
                return body[:-1] + chr(ord(body[-1]) + END)
            return token

        self.ids = {letters(t): i for t, i in model["vocab"].items()}
        self.merges = {}
        self.halves = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            left, right, made = model["vocab"][a], model["vocab"][b], model["vocab"][a + b]
            self.merges[left << 32 | right] = rank
            self.halves.setdefault(made, (left, right, rank))
        self.shorter = {}
        longest: dict[str, int] = {}
        for s in sorted(self.ids, key=len):
            best = None
            for n in range(len(s) - 1, 0, -1):
                best = longest.get(s[:n])
                if best is not None:
                    break
            self.shorter[self.ids[s]] = best
            longest[s] = self.ids[s]
        self.size = {i: len(s) for s, i in self.ids.items()}
        self.automaton = ahocorasick.Automaton()
        for s, i in self.ids.items():
            self.automaton.add_word(s[::-1], i)
        self.automaton.make_automaton()
        self.right_chain: dict[int, list] = {}
        self.left_chain: dict[int, list] = {}
        self.pairs: dict[int, bool] = {}

    def chain(self, token: int, side: int) -> list[tuple[int, int, float]]:
        """(sub-token at that edge, rank of its own merge, rank of the merge that uses it up)."""
        kept = self.right_chain if side else self.left_chain
        if token not in kept:
            out, ends = [], float("inf")
            while True:
                half = self.halves.get(token)
                made = half[2] if half else -1
                out.append((token, made, ends))
                if half is None:
                    break
                token, ends = half[side], made
            kept[out[0][0]] = out
            return out
        return kept[token]

    def compatible(self, first: int, second: int) -> bool:
        pair = first << 32 | second
        known = self.pairs.get(pair)
        if known is None:
            if len(self.pairs) >= MAX_PAIRS:
                self.pairs.clear()
            known = self.pairs[pair] = self._compatible(first, second)
        return known

    def _compatible(self, first: int, second: int) -> bool:
        merges = self.merges
        for a, made_a, used_a in self.chain(first, 1):
            for b, made_b, used_b in self.chain(second, 0):
                rank = merges.get(a << 32 | b)
                if rank is not None:
                    due = max(rank, made_a, made_b)
                    # of two equal merges the left one comes first
                    if due < used_a and due <= used_b:
                        return False
        return True

    def encode(self, piece: str) -> list[int]:
        """The ids of one shown piece."""
        word = piece[:-1] + chr(ord(piece[-1]) + END)
        whole = self.ids.get(word)
        n = len(word)
        if n == 1:
            return [whole]
        longest: list = [None] * n
        for end, token in self.automaton.iter(word[::-1]):
            at = n - 1 - end
            if longest[at] is None or self.size[token] > self.size[longest[at]]:
                longest[at] = token
        out: list[int] = []
        dead = bytearray(n + 1)
        at, token = 0, longest[0]
        while at < n:
            size = 0
            while token is not None:
                size = self.size[token]
                if not dead[at + size] and (not out or self.compatible(out[-1], token)):
                    break
                token = self.shorter[token]
            if token is not None:
                out.append(token)
                at += size
                token = longest[at] if at < n else None
            else:
                if not out:
                    raise ValueError("a letter of the word is not in the vocabulary")
                dead[at] = 1
                last = out.pop()
                at -= self.size[last]
                token = self.shorter[last]
        return out


class OffsetTable:
    """Byte strings by id: one buffer, and where each id's string starts and ends."""

    def __init__(self, strings: list[bytes]):
        self.data = np.frombuffer(b"".join(strings), np.uint8)
        self.sizes = np.array([len(s) for s in strings], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]]).astype(np.int64)

    def gather(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All strings of ``ids`` in a row, and the row offsets in bytes."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        # four bytes a place: the characters of a slice are far fewer than 2^31
        index = np.repeat((self.starts[ids] - ends + sizes).astype(np.int32 if total < 1 << 31 else np.int64), sizes)
        index += np.arange(total, dtype=index.dtype)
        bounds = np.concatenate([[0], ends])[offsets]
        return self.data[index], bounds


def token_strings(spec: dict) -> list[bytes]:
    """Each id's string as the library shows it (without a decoder)."""
    by_id = {i: t for t, i in spec["model"]["vocab"].items()}
    by_id |= {t["id"]: t["content"] for t in spec["added_tokens"]}
    return [by_id.get(i, "").encode() for i in range(max(by_id) + 1)]


def _encoder(tokenizer: str) -> wordbpe.Encoder:
    def make():
        pieces = wordbpe.Pieces(tokenizer, model=False)
        bpe = BacktrackingBpe(pieces.spec)
        pieces.spec = None  # the file's contents are in the tables now
        trim()
        return wordbpe.Encoder(pieces, bpe.encode)
    return per_worker(f"bpe {tokenizer}", make, "bpe")


def _table(tokenizer: str) -> OffsetTable:
    def make():
        import json
        with open(wordbpe.resolve(tokenizer), encoding="utf-8") as f:
            table = OffsetTable([s + b" " for s in token_strings(json.load(f))])
        trim()
        return table
    return per_worker(f"decode {tokenizer}", make, "bpe")


def _encoded(texts: pa.Array, tokenizer: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all ``texts`` in a row, and where each text's ids start (one more at the end)."""
    encoder = _encoder(tokenizer)
    rows = [encoder.encode(t) if t else b"" for t in texts.to_pylist()]
    offsets = np.concatenate([[0], np.cumsum([len(r) // 4 for r in rows])]).astype(np.int64)
    return np.frombuffer(b"".join(rows), "<u4").astype(np.int32), offsets


def _lists(flat: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32), pa.int32()), pa.array(flat, pa.int32()))


def _decoded(flat: np.ndarray, offsets: np.ndarray, tokenizer: str) -> pa.Array:
    data, bounds = _table(tokenizer).gather(flat, offsets)
    data = data.tobytes()
    return pa.array([data[a:max(a, b - 1)].decode() for a, b in zip(bounds[:-1], bounds[1:])], pa.string())


IDS = T.ArrayType(T.IntegerType(), False)


def encode(df: DataFrame, tokenizer: str, text_col: str = "text", ids_col: str = "token_ids") -> DataFrame:
    """``df`` with the ids of ``text_col`` as ``array<int>``."""
    return arrow_columns(df, [T.StructField(ids_col, IDS, False)], text_col,
                         lambda texts: [_lists(*_encoded(texts, tokenizer))])


def decode(df: DataFrame, tokenizer: str, ids_col: str = "token_ids", text_col: str = "decoded") -> DataFrame:
    """``df`` with the text of ``ids_col``, special tokens included."""

    def make(lists):
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        sizes = np.array([len(x) if x is not None else 0 for x in lists], np.int64) if lists.null_count else \
            np.diff(lists.offsets.to_numpy())  # a slice's offsets do not start at 0, its flattened values do
        return [_decoded(flat, np.concatenate([[0], np.cumsum(sizes)]), tokenizer)]

    return arrow_columns(df, [T.StructField(text_col, T.StringType(), False)], ids_col, make)


def encode_decode(df: DataFrame, tokenizer: str, text_col: str = "text", ids_col: str = "token_ids",
                  decoded_col: str = "decoded") -> DataFrame:
    """``df`` with the ids of ``text_col``, and the text decoded from them, in place of ``text_col``: one pass in one worker."""

    def make(texts):
        flat, offsets = _encoded(texts, tokenizer)
        return [_lists(flat, offsets), _decoded(flat, offsets, tokenizer)]

    return arrow_columns(df, [T.StructField(ids_col, IDS, False), T.StructField(decoded_col, T.StringType(), False)],
                         text_col, make, keep=False, rows=DECODE_ROWS)
