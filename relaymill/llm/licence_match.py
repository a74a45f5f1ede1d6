"""Dice coefficients of word bigrams between texts and licence templates. Runs inside tasks.

Normalised text: A to Z in lower case; everything but letters, digits and bytes beyond ASCII
separates words; lines that only name a copyright holder are left out.

Units compared: all windows of words of a text, wherever they begin and end, so every line,
run of lines and whole text is among them. A window of a bigrams and a template of b can only
reach a Dice of t if  b t/(2-t) <= a <= b (2-t)/t , and only if it has b t/(2-t) bigrams of the
template at all, so windows begin where so many of them follow within the greatest length.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np

from relaymill.llm import arrays

LEAST = 0.85

_WORD = np.zeros(256, dtype=bool)
_WORD[128:] = True
for _range in (range(48, 58), range(65, 91), range(97, 123)):
    _WORD[list(_range)] = True
_HOLDER = re.compile(rb"^[^a-z0-9]*(copyright|\xc2\xa9|\(c\))\b.{0,160}$")
_HOLDER_SIGN = re.compile(rb"copyright|\xc2\xa9|\(c\)")
_RUN = re.compile(rb"[a-z0-9\x80-\xff]+")


def bigrams(lines: list[bytes]) -> Counter:
    """Word bigrams of some lines, taken as one text; lines in lower case."""
    words = [w for line in lines if not _HOLDER.match(line) for w in _RUN.findall(line)]
    return Counter(zip(words, words[1:]))


class Templates:
    def __init__(self, texts: list[tuple[str, str]], least: float = LEAST):
        self.least = least
        found = [(name, bigrams([" ".join(text.lower().split()).encode()])) for name, text in texts]
        found = [(name, grams) for name, grams in found if grams]
        found.sort(key=lambda x: (x[1].total(), x[0]))
        self.names = [name for name, _ in found]
        self.sizes = [grams.total() for _, grams in found]
        self.longest = [math.floor(b * (2 - least) / least + 1e-9) for b in self.sizes]
        self.fewest = [max(1, math.ceil(b * least / (2 - least) - 1e-9)) for b in self.sizes]
        hashed = [{_pair_hash(*pair): n for pair, n in grams.items()} for _, grams in found]
        self.known = np.unique(np.array([h for grams in hashed for h in grams], dtype=np.uint64))
        # how often each template has each of the known bigrams
        self.counts = np.zeros((len(found), len(self.known)), dtype=np.int64)
        for k, grams in enumerate(hashed):
            at = np.searchsorted(self.known, np.array(list(grams), dtype=np.uint64))
            self.counts[k, at] = list(grams.values())


def _pair_hash(a: bytes, b: bytes) -> int:
    data = np.frombuffer(a + b" " + b, dtype=np.uint8)
    part = arrays.Slice(data, np.array([0, len(data)]))
    ends = np.array([len(a), len(data)])
    return int(_pairs(part.hashes(np.array([0, len(a) + 1]), ends))[0])


def _pairs(words: np.ndarray) -> np.ndarray:
    return arrays.mix(words[:-1] * np.uint64(0xD6E8FEB86659FD93) + words[1:])


def _without_holders(part: arrays.Slice, line_starts, line_ends, line: np.ndarray) -> np.ndarray:
    """Which words, given by their lines, are not in a line that only names a holder."""
    data = part.data.tobytes()
    signs = np.array([m.start() for m in _HOLDER_SIGN.finditer(data)], dtype=np.int64)
    holders = [
        k
        for k in np.unique(np.searchsorted(line_starts, signs, side="right") - 1).tolist()
        if _HOLDER.match(data[line_starts[k] : line_ends[k]])
    ]
    return ~np.isin(line, holders)


def matches(part: arrays.Slice, templates: Templates) -> list[list[tuple[int, int, str, float]]]:
    """For each text: (first line, last line, licence, Dice) of its matches.

    Lines are counted from 0 and leave empty ones out. Matches share no bigram; `_chosen`
    says which of those that overlap are taken.
    """
    out: list[list[tuple[int, int, str, float]]] = [[] for _ in range(part.n)]
    part = part.lower()
    starts, ends, _ = part.spans(_WORD[part.data])
    line_starts, line_ends, lines = part.spans(part.data != 10)
    line = np.searchsorted(line_starts, starts, side="right") - 1
    told = _without_holders(part, line_starts, line_ends, line)
    starts, ends, line = starts[told], ends[told], line[told]
    if len(starts) < 2 or not templates.names:
        return out
    text = arrays.owners(lines)[line]
    pairs = _pairs(part.hashes(starts, ends))
    at = np.minimum(np.searchsorted(templates.known, pairs), len(templates.known) - 1)
    hits = np.flatnonzero((templates.known[at] == pairs) & (text[:-1] == text[1:]))
    grams = at[hits]
    begun: dict[int, list[tuple[int, np.ndarray, np.ndarray]]] = {}
    for k, (fewest, longest) in enumerate(zip(templates.fewest, templates.longest)):
        own = np.flatnonzero(templates.counts[k, grams])
        place = hits[own]
        last = place[fewest - 1 :]
        first = place[: len(last)]
        may = np.flatnonzero((last - first < longest) & (text[first] == text[last]))
        if not len(may):
            continue
        for t in np.unique(text[first[may]]).tolist():
            low, high = np.searchsorted(text[place], [t, t + 1])
            inside = may[(may >= low) & (may < high)] - low
            rows = own[low:high]
            begun.setdefault(t, []).append((k, hits[rows], _spent(grams[rows], hits[rows], templates.counts[k]), inside))
    firsts = np.cumsum(lines) - lines
    for t, found in begun.items():
        out[t] = [
            (int(line[a] - firsts[t]), int(line[b + 1] - firsts[t]), templates.names[k], dice)
            for a, b, k, dice in _chosen(found, templates)
        ]
    return out


def _spent(grams: np.ndarray, place: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each bigram the place of the earlier one like it that must not be in the window.

    A bigram adds to the overlap while the window has fewer of its kind than the template.
    """
    order = np.argsort(grams, kind="stable")
    kind = grams[order]
    rank = np.arange(len(order))
    earlier = rank - counts[kind]
    there = (earlier >= 0) & (kind[np.maximum(earlier, 0)] == kind)
    out = np.full(len(order), -1, dtype=np.int64)
    out[order] = np.where(there, place[order[np.maximum(earlier, 0)]], -1)
    return out


def _chosen(found: list[tuple], templates: Templates) -> list[tuple[int, int, int, float]]:
    """(first bigram, last bigram, template, Dice) of the matches in a text.

    Of all sets of matches without a common bigram the one is taken whose sum of
    overlap - (window + template) / 4  is greatest: a Dice of 1/2 would count nothing, a
    better match counts more than a worse one, and a text more than a notice inside it.
    """
    todo = sorted((int(place[s]), k, n, int(s)) for n, (k, place, _, inside) in enumerate(found) for s in inside)
    # best sum of matches up to the one that ends at a place, that match, and the one before it
    ended: dict[int, tuple[float, tuple, int | None]] = {}
    waiting: list[int] = []
    so_far, latest = 0.0, None
    for first, k, n, s in todo:
        closed = [e for e in waiting if e < first]
        if closed:
            waiting = [e for e in waiting if e >= first]
            for e in sorted(closed):
                if ended[e][0] > so_far:
                    so_far, latest = ended[e][0], e
        _, place, spent, _ = found[n]
        size, longest = templates.sizes[k], templates.longest[k]
        stop = int(np.searchsorted(place, first + longest))
        ends = place[s:stop]
        overlap = np.cumsum(spent[s:stop] < first)
        both = ends - first + 1 + size
        dice = 2 * overlap / both
        for e in np.flatnonzero(dice >= templates.least).tolist():
            end, total = int(ends[e]), so_far + float(overlap[e] - both[e] / 4)
            if end not in ended:
                waiting.append(end)
            elif ended[end][0] >= total:
                continue
            ended[end] = (total, (first, end, k, float(dice[e])), latest)
    for e in sorted(waiting):
        if ended[e][0] > so_far:
            so_far, latest = ended[e][0], e
    out = []
    while latest is not None:
        _, match, latest = ended[latest]
        out.append(match)
    return out[::-1]
