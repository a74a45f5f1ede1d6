"""Sketches by which texts within a share of edits become candidates. Runs inside tasks.

An edit changes at most q of a text's q-grams (runs of q characters), so two texts within
e times the longer length n share about n (1 - q e) of them at least: with q = 1 / (2 e) half
of them, and of all that either has a third. BANDS bands of ROWS minima each then agree
somewhere with a chance of 1 - (1 - 1/27)^BANDS = 0.97 for edits placed as badly as can be,
and more for others. Repeats of a q-gram count as different ones.
"""

from __future__ import annotations

import numpy as np

from relaymill.llm import arrays

ROWS = 3
BANDS = 96
# texts up to the second length have short grams also, those from the first one long ones
SHORT_GRAM, SHORT = 2, (40, 60)

_random = np.random.default_rng(4099)
_FACTORS = _random.integers(0, 2**63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def gram_size(most_edits: float) -> int:
    return max(1, min(12, int(0.5 / most_edits + 1e-9))) if most_edits > 0 else 12


def grams(text: str, q: int) -> np.ndarray:
    """Hashes of the text's q-grams, the k-th occurrence of one apart from the others; sorted."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    total = max(1, len(points) - q + 1)
    hashed = np.full(total, 0x51ED270B + q, dtype=np.uint64)
    for k in range(min(q, len(points))):
        hashed = arrays.mix(hashed * np.uint64(0xD6E8FEB86659FD93) + points[k : k + total])
    hashed.sort()
    begin = np.concatenate(([True], hashed[1:] != hashed[:-1]))
    rank = np.arange(total) - np.maximum.accumulate(np.where(begin, np.arange(total), 0))
    return np.sort(arrays.mix(hashed + rank.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


def bands(text: str, most_edits: float) -> np.ndarray:
    """One number for each band; texts that agree in one are candidates."""
    sizes = [gram_size(most_edits)] if len(text) >= SHORT[0] else []
    if len(text) <= SHORT[1]:
        sizes.append(min(SHORT_GRAM, gram_size(most_edits)))
    out = []
    for q in sorted(set(sizes)):
        found = grams(text, q)
        least = np.full((BANDS, ROWS), np.iinfo(np.uint64).max, dtype=np.uint64)
        for at in range(0, len(found), 1 << 16):
            part = found[at : at + (1 << 16)]
            for i in range(BANDS):
                for j in range(ROWS):
                    mixed = part * _FACTORS[i, j]
                    mixed ^= mixed >> np.uint64(32)
                    mixed *= _FACTORS[i, (j + 1) % ROWS]
                    least[i, j] = min(least[i, j], mixed.min())
        whole = np.arange(BANDS, dtype=np.uint64) + np.uint64(q << 20)
        for j in range(ROWS):
            whole = arrays.mix(whole * np.uint64(0xD6E8FEB86659FD93) + least[:, j])
        out.append(whole.view(np.int64))
    return np.concatenate(out)


def may_be_near(a: str, b: str, most: int, q: int = 5) -> bool:
    """False only where shared q-grams prove that more than `most` edits are needed."""
    if abs(len(a) - len(b)) > most:
        return False
    fewest = max(len(a), len(b)) - q + 1 - q * most
    if fewest <= 0 or min(len(a), len(b)) < q:
        return True
    return len(np.intersect1d(grams(a, q), grams(b, q), assume_unique=True)) >= fewest
