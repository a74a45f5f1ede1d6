"""Randomised edit embedding of texts and fingerprints sampled from it. Runs inside tasks.

A walker reads a text character by character. At each step of a walk that all texts share, a
random bit chosen by step and character says whether it moves on. What it reads at each step
is the embedding of the text: after an edit, two walkers soon read in step again, so few
edits change few places, and the Hamming distance of the embeddings follows the edit
distance of the texts. The time a walker stays with a character depends only on the step it
arrives and on the character, so one look-up replaces a run of coin flips.

A fingerprint samples SLOTS places of the embedding. For each slot the place is drawn evenly
from the embedding's length, and in such a way that texts of nearly equal length share it:
the draw for a longer text differs only if it falls into the part that is longer.
"""

from __future__ import annotations

import numpy as np

SLOTS = 256
PERIOD = 4096
CLASSES = 64

_random = np.random.default_rng(77)


def _stay_table() -> np.ndarray:
    """Steps that a walker stays with a character, by step of arrival and character class."""
    moves = _random.integers(0, 2, (PERIOD, CLASSES), dtype=np.uint8)
    moves[-1] = 1  # a walker moves on at the end of each period at the latest
    stay = np.empty((PERIOD, CLASSES), dtype=np.int64)
    stay[-1] = 1
    for step in range(PERIOD - 2, -1, -1):
        stay[step] = np.where(moves[step] == 1, 1, stay[step + 1] + 1)
    return stay.ravel().astype(np.int16)


_STAY = _stay_table()


def _records(slot: int, limit: int) -> np.ndarray:
    """Ascending places below `limit`; the last one below L is an even draw from 0 .. L-1.

    These are the places at which a sequence of independent random numbers has a new
    minimum: after one at place p, the next is beyond m with probability (p+1)/(m+1).
    """
    draw = np.random.default_rng(1_000_003 * slot + 17)
    places, at = [0], 1
    while True:
        at = int(at / (1.0 - draw.random())) + 1
        if at > limit:
            return np.array(places, dtype=np.int64)
        places.append(at - 1)


_PLACES = [_records(slot, 1 << 40) for slot in range(SLOTS)]


def sampled_places(lengths: np.ndarray) -> np.ndarray:
    """The places of all slots (columns) for embeddings of these lengths (rows)."""
    out = np.empty((len(lengths), SLOTS), dtype=np.int64)
    last = np.maximum(lengths, 1) - 1
    for slot, places in enumerate(_PLACES):
        out[:, slot] = places[np.searchsorted(places, last, side="right") - 1]
    return out


def _classes(points: np.ndarray) -> np.ndarray:
    return ((points * np.uint32(0x9E3779B1)) >> np.uint32(26)).astype(np.int64)


class Corpus:
    """Code points of some texts, one after another."""

    def __init__(self, texts: list[str]):
        self.lengths = np.array([len(t) for t in texts], dtype=np.int64)
        self.offsets = np.concatenate(([0], np.cumsum(self.lengths)))
        joined = "".join(texts).encode("utf-32-le", "surrogatepass")
        self.points = np.frombuffer(joined, dtype=np.uint32)


def walk(corpus: Corpus, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The step at which each character is reached, and the steps after the last one.

    All texts are walked at once, longest first, so that those under way are always the
    first ones. `start` gives the step at which each text begins.
    """
    n = len(corpus.lengths)
    order = np.argsort(-corpus.lengths, kind="stable")
    lengths, offsets = corpus.lengths[order], corpus.offsets[:-1][order].copy()
    classes = _classes(corpus.points).astype(np.uint8)
    arrival = np.empty(len(classes), dtype=np.int64)
    time = np.zeros(n, dtype=np.int64) if start is None else start[order].copy()
    longest = int(lengths[0]) if n else 0
    # texts under way at each step, from the lengths in falling order
    under_way = np.searchsorted(-lengths, -np.arange(longest), side="left").tolist()
    mask = PERIOD - 1
    for active in under_way:
        at, now = offsets[:active], time[:active]
        arrival[at] = now
        now += _STAY[((now & mask) << 6) | classes[at]]
        at += 1
    total = np.empty(n, dtype=np.int64)
    total[order] = time
    return arrival, total


def _symbols(points: np.ndarray, at: np.ndarray, end: np.ndarray) -> np.ndarray:
    """One byte for the character read and the one after it; never 0."""
    following = np.where(at + 1 < end, points[np.minimum(at + 1, len(points) - 1)], 0)
    mixed = points[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= following.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return ((mixed >> np.uint64(40)) % np.uint64(255) + np.uint64(1)).astype(np.uint8)


def fingerprints(texts: list[str], edits: list[tuple[int, str]]) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints (a row of SLOTS bytes each) of the texts and of their edited versions.

    An edit (keep, tail) stands for text[:keep] + tail. The walk over the kept part is that
    of the text itself, so only the tails are walked anew. An empty text has only zeros.
    """
    corpus = Corpus(texts)
    arrival, total = walk(corpus)
    plain = np.zeros((len(texts), SLOTS), dtype=np.uint8)
    places = sampled_places(total)
    for i in np.flatnonzero(corpus.lengths):
        begin, end = corpus.offsets[i], corpus.offsets[i + 1]
        at = begin + np.searchsorted(arrival[begin:end], places[i], side="right") - 1
        plain[i] = _symbols(corpus.points, at, np.int64(end))

    keep = np.array([k for k, _ in edits], dtype=np.int64)
    tails = Corpus([t for _, t in edits])
    reached = total.copy()
    inside = keep < corpus.lengths
    reached[inside] = arrival[corpus.offsets[:-1][inside] + keep[inside]]
    tail_arrival, edited_total = walk(tails, reached)
    edited = np.zeros_like(plain)
    places = sampled_places(edited_total)
    for i in range(len(edits)):
        begin, middle = corpus.offsets[i], corpus.offsets[i] + keep[i]
        first, last = tails.offsets[i], tails.offsets[i + 1]
        points = np.concatenate((corpus.points[begin:middle], tails.points[first:last]))
        if not len(points):
            continue
        steps = np.concatenate((arrival[begin:middle], tail_arrival[first:last]))
        at = np.searchsorted(steps, places[i], side="right") - 1
        edited[i] = _symbols(points, at, np.int64(len(points)))
    return plain, edited


def _shared(a: str, b: str) -> int:
    """Length of the common beginning, by steps that double and then halve."""
    most, low, step = min(len(a), len(b)), 0, 1
    while low < most and a[low : low + step] == b[low : low + step]:
        low, step = min(low + step, most), 2 * step
    while step:
        step //= 2
        if step and a[low : low + step] == b[low : low + step]:
            low = min(low + step, most)
    return low


def edit_distance(a: str, b: str, most: int | None = None) -> int:
    """Levenshtein distance, with one bit per character of the shorter text.

    Beyond `most` it is not carried on: then the result is some number above `most`.
    """
    n = _shared(a, b)
    a, b = a[n:], b[n:]
    n = _shared(a[::-1], b[::-1])
    a, b = a[: len(a) - n], b[: len(b) - n]
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return len(b)
    occurs: dict[str, int] = {}
    for i, c in enumerate(a):
        occurs[c] = occurs.get(c, 0) | 1 << i
    if most is not None and len(b) - len(a) > most:
        return most + 1
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, distance = full, 0, len(a)
    for left, c in zip(range(len(b), 0, -1), b):
        if most is not None and distance - left > most:  # every character takes off one at most
            return most + 1
        eq = occurs.get(c, 0)
        x = eq | down
        d0 = ((((x & up) + up) ^ up) | x) & full
        right_up = (down | ~(d0 | up)) & full
        right_down = up & d0
        distance += bool(right_up & top) - bool(right_down & top)
        right_up = (right_up << 1 | 1) & full
        right_down = (right_down << 1) & full
        up = (right_down | ~(d0 | right_up)) & full
        down = right_up & d0
    return distance
