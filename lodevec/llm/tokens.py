"""Token ids of a byte-level BPE tokenizer file.

The ids are those of tokenizers' Tokenizer.from_file(path).encode(text, add_special_tokens=False), which the tests hold
them against. tiktoken makes them, from the file's vocabulary and the byte-level pattern, at about twelve times the
library's speed and without remembering any words, so a worker's memory does not grow with what it has read. Texts that
hold a special token's string, or on which the pattern runs out of stack (hundreds of thousands of blanks in a row), go
through the library itself, whole.
"""

from __future__ import annotations

import json
from functools import cache, cached_property

import numpy as np
import tiktoken

# Fixed value: the byte-level pattern, with possessive repetition where it never has to give back.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


class Ids:
    """One per process and file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [x["content"] for x in spec.get("added_tokens") or []]
        self.path = path
        # A byte that is no printable character stands in the file as the next character from 256 on.
        printable = [b for b in range(256) if chr(b).isprintable() and b not in (32, 0xA0, 0xAD)]
        others = sorted(set(range(256)) - set(printable))
        byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
        ranks = {bytes(byte[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in self.special}
        self.core = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def whole(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """uint32 ids of each text, without special tokens."""
        return [self._ids(t) for t in texts]

    def _ids(self, text: str) -> np.ndarray:
        if not any(s in text for s in self.special):
            try:
                return self.core.encode_to_numpy(text)
            except ValueError:  # the pattern's stack is full
                pass
        return np.asarray(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)


@cache
def ids_for(path: str) -> Ids:
    return Ids(path)
