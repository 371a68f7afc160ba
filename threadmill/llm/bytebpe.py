"""Ids of whole texts under a byte-level BPE tokenizer file, as the tokenizers library gives them.

Where the file's merges are in the order of the ids they make - then a token's
id is its rank - ordinary text is encoded by rank with tiktoken, several times
faster and with the same ids.  Text with a special token's string, with a
character from U+0180 on (where the two libraries' tables of letters may be of
different age) or with an odd control character, and files of another layout,
go through the tokenizers library itself.
"""

from __future__ import annotations

import json
import re

import numpy as np

from .wordbpe import resolve, shown_bytes

#: The pieces of the byte-level pre-tokeniser; a fixed value of the file format.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteEncoder:
    """Texts to ids as arrays of little-endian unsigned 32-bit integers."""

    def __init__(self, tokenizer: str):
        from tokenizers import Tokenizer
        path = resolve(tokenizer)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        special = [re.escape(t["content"]) for t in spec["added_tokens"]]
        self.unusual = re.compile("|".join(["[\x1c-\x1f\x85ƀ-\U0010ffff]", *special]))
        self.ranked = self._ranked(spec)

    def _ranked(self, spec: dict):
        model, split = spec["model"], spec.get("pre_tokenizer") or {}
        plain = (spec.get("normalizer") is None and split.get("type") == "ByteLevel" and split.get("use_regex", True)
                 and not split.get("add_prefix_space") and not model.get("ignore_merges")
                 and not model.get("dropout"))
        vocab = model["vocab"]
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        first = len(vocab) - len(merged)
        if not plain or first != 256 or any(vocab.get(t) != first + k for k, t in enumerate(merged)):
            return None
        import tiktoken
        byte = {c: b for b, c in enumerate(shown_bytes())}
        ranks = {bytes(byte[c] for c in token): i for token, i in vocab.items()}
        return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if self.ranked is None or (not text.isascii() or "<" in text or "\x1c" <= min(text, default=" ") <= "\x1f") \
                and self.unusual.search(text):
            ids = self.library.encode(text, add_special_tokens=False).ids
        else:
            ids = self.ranked.encode_ordinary(text)
        return np.asarray(ids, "<u4")
