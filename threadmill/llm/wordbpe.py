"""Splitting text into the pre-tokens of a word-level BPE tokenizer file.

Covers the layout of ``word_bpe_49k.json``: NFC, white space runs to one
space, lower case; a regular expression for the pieces; bytes shown as
printable characters; an end-of-word suffix.  The usual text (no character
from U+0180 on, no odd control character, no special token) is split with
plain Python, which gives the same pieces because such text is in NFC, and no
piece holds white space; any other text goes through the library's own
normaliser and splitter.

A text's ids are the ids of its white-space chunks in a row, and a chunk's
ids those of its pieces, so both are kept in bounded per-worker tables and a
word that comes again costs one look-up.
"""

from __future__ import annotations

import json
import os
import re
import struct
import unicodedata

#: Entries of a worker's tables; a full table is emptied and filled anew.
MAX_CHUNKS = 300_000
MAX_PIECES = 200_000
#: Longer chunks and pieces are encoded each time and not kept, so the tables are bounded in bytes too.
MAX_KEPT_CHARS = 64


def resolve(tokenizer: str) -> str:
    """The file of a tokenizer given by path, or by its name among the public ones."""
    if os.path.sep in tokenizer:
        return tokenizer
    import public_tokenizers
    return public_tokenizers.path(tokenizer)


def shown_bytes() -> list[str]:
    """The printable character that stands for each byte: itself where it is
    printable Latin-1, else the next unused one from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def class_ranges(kind: str, upto: int = 0x250) -> str:
    """The characters below ``upto`` whose category starts with ``kind``, as a character class."""
    return "".join(re.escape(chr(i)) for i in range(upto) if unicodedata.category(chr(i))[0] == kind)


def packed_ids(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers; most lists are short."""
    return struct.pack(f"<{len(ids)}I", *ids)


class Pieces:
    """A tokenizer file's pre-tokenisation; ``encode_piece`` (bytes shown as characters -> ids) is given.

    The library is loaded without the vocabulary and merges where ``model`` is false: it only normalises and splits then.
    """

    def __init__(self, tokenizer: str, model: bool = True):
        from tokenizers import Tokenizer
        path = resolve(tokenizer)
        with open(path, encoding="utf-8") as f:
            self.spec = json.load(f)
        if model:
            self.library = Tokenizer.from_file(path)
        else:
            empty = self.spec | {"model": self.spec["model"] | {"vocab": {}, "merges": []}, "added_tokens": []}
            self.library = Tokenizer.from_str(json.dumps(empty))
        self.library.no_truncation()
        self.library.no_padding()
        special = {t["content"]: t["id"] for t in self.spec["added_tokens"]}
        self.special = special
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, special)) + ")")
        letters, digits = class_ranges("L"), class_ranges("N")
        self.pattern = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^\\s{letters}{digits}]+")
        self.unusual = re.compile("[\x1c-\x1fƀ-\U0010ffff]|" + "|".join(map(re.escape, special)))
        self.shown = shown_bytes()

    def show(self, piece: str) -> str:
        if piece.isascii() and piece.isprintable() and " " not in piece:
            return piece
        shown = self.shown
        return "".join([shown[b] for b in piece.encode()])

    def unusual_pieces(self, text: str):
        """(id, None) for a special token, (None, shown piece) for others; by the library's own rules."""
        for part in self.special_pattern.split(text):
            if part in self.special:
                yield self.special[part], None
            elif part:
                for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part)):
                    yield None, piece


class _Chunks(dict):
    """White-space chunk -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, pieces: Pieces, piece_ids: _PieceIds):
        self.pieces, self.piece_ids = pieces, piece_ids

    def __missing__(self, chunk: str) -> bytes:
        # letters alone are one piece
        out = (self.piece_ids[chunk] if chunk.isalpha()
               else b"".join([self.piece_ids[p] for p in self.pieces.pattern.findall(chunk)]))
        if len(chunk) <= MAX_KEPT_CHARS:
            if len(self) >= MAX_CHUNKS:
                self.clear()
            self[chunk] = out
        return out


class _PieceIds(dict):
    """Piece -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, pieces: Pieces, encode_shown):
        self.pieces, self.encode_shown = pieces, encode_shown

    def __missing__(self, piece: str) -> bytes:
        out = packed_ids(self.encode_shown(self.pieces.show(piece)))
        if len(piece) <= MAX_KEPT_CHARS:
            if len(self) >= MAX_PIECES:
                self.clear()
            self[piece] = out
        return out


class Encoder:
    """Texts to ids (little-endian unsigned 32-bit integers) with ``encode_shown`` for each new piece."""

    def __init__(self, pieces: Pieces, encode_shown):
        self.pieces, self.encode_shown = pieces, encode_shown
        self.chunks = _Chunks(pieces, _PieceIds(pieces, encode_shown))

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if not text.isascii() or "<" in text or "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:
            if self.pieces.unusual.search(text):
                return self.encode_unusual(text)
        return b"".join(map(self.chunks.__getitem__, text.lower().split()))

    def encode_unusual(self, text: str) -> bytes:
        out = []
        for known, piece in self.pieces.unusual_pieces(text):
            if known is not None:
                out.append(known)
            else:
                out.extend(self.encode_shown(piece))
        return packed_ids(out)


def library_encoder(tokenizer: str) -> Encoder:
    """An encoder whose pieces the tokenizers library encodes."""
    pieces = Pieces(tokenizer)
    model = pieces.library.model
    return Encoder(pieces, lambda piece: [t.id for t in model.tokenize(piece)])
