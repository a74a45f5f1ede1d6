"""Ids of a byte-level tokenizer file, quickly. Runs inside tasks.

The file is written for one library, whose encoder takes most of its time for bookkeeping
that is of no use here. The same vocabulary, merges and word pattern are therefore handed to
a leaner encoder of another library; the special token's own text is found by the same rule
in both. Tests hold the two against each other.
"""

from __future__ import annotations

import json
import re

import numpy as np
import tiktoken

# Fixed value: the word pattern of this family of byte-level tokenizers.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

# Fixed value: white space as the pattern understands it.
_SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# The pattern's engine goes back over a run of white space with a bounded stack; longer runs
# than this are cut out beforehand.
LONGEST_RUN = 50_000
_RUN = re.compile(f"[{_SPACES}]{{{LONGEST_RUN},}}")


def _byte_of_symbol() -> dict[str, int]:
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return {chr(b if b in shown else next(spare)): b for b in range(256)}


class Encoder:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        byte_of = _byte_of_symbol()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {
            bytes(byte_of[c] for c in token): i
            for token, i in spec["model"]["vocab"].items()
            if token not in special
        }
        self._encoding = tiktoken.Encoding(
            "byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special
        )
        self._special = set(special)

    def encode(self, text: str) -> list[int]:
        if len(text) < LONGEST_RUN:
            return self._words(text)
        ids, at = [], 0
        for run in _RUN.finditer(text):
            # the last one of a run belongs to the word behind it
            end = run.end() - (run.end() < len(text))
            ids += self._words(text[at : run.start()])
            ids += self._encoding._encode_single_piece(text[run.start() : end])
            at = end
        return ids + self._words(text[at:])

    def _words(self, text: str) -> list[int]:
        return self._encoding.encode(text, allowed_special=self._special)


def to_bytes(ids: list[int]) -> bytes:
    array = np.array(ids, dtype="<u4")
    if len(array) and array.max() >= 1 << 16:
        return b"4" + array.tobytes()
    return b"2" + array.astype("<u2").tobytes()


def from_bytes(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, dtype="<u2" if blob[:1] == b"2" else "<u4", offset=1)
