"""Patterns of secrets, and the scan of one text. Runs inside tasks."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

BASE_KINDS = ("assign", "access", "hex")

# The three base patterns with the least length of what they must match, and
# further shapes of published token formats. Each: kind, pattern, group, least length.
PATTERNS = (
    (
        "assign",
        rb"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        2,
        12,
    ),
    ("access", rb"AKIA[A-Z0-9]+", 0, 18),
    ("hex", rb"[0-9a-f]+", 0, 16),
    ("forge", rb"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    ("jwt", rb"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    ("pem", rb"-----BEGIN [A-Z ]*PRIVATE KEY-----[^-]+-----END [A-Z ]*PRIVATE KEY-----", 0, 64),
    ("login", rb"[a-z][a-z0-9+.-]*://[^\s/:@]+:[^\s/@]+@", 0, 12),
)
KINDS = tuple(kind for kind, *_ in PATTERNS)
RULE_VERSION = hashlib.sha256(repr(PATTERNS).encode()).hexdigest()[:16]

# A text without any of these (in lower case) cannot match the pattern.
_NEEDLES = {
    "assign": (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key"),
    "access": (b"akia",),
    "forge": (b"ghp_", b"gho_", b"ghu_", b"ghs_", b"ghr_"),
    "jwt": (b"eyj",),
    "pem": (b"private key-----",),
    "login": (b"://",),
}
# A run of hex digits that is long enough need not be found through all short ones: maximal
# runs of 16 or more are the same either way.
_COMPILED = [
    (kind, re.compile(rb"[0-9a-f]{16,}" if kind == "hex" else pattern), group, least)
    for kind, pattern, group, least in PATTERNS
]


# Two patterns begin with a run of characters that may be long and lead to nothing; trying them
# from each of its places would cost the square of it. What must follow the run is searched
# instead: kind -> (that, the run's characters, how a match begins, how it goes on).
_NAME = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-"
_BEHIND_RUN = {
    "jwt": (b".eyJ", _NAME, re.compile(rb"eyJ[A-Za-z0-9_-]"), re.compile(rb"[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+")),
    "login": (
        b"://", b"abcdefghijklmnopqrstuvwxyz0123456789+.-", re.compile(rb"[a-z]"), re.compile(rb"[^\s/:@]+:[^\s/@]+@")
    ),
}


def _spans(kind: str, pattern: re.Pattern, group: int, data: bytes) -> Iterator[tuple[int, int, int]]:
    """(start, end, length of what counts) of the matches, leftmost, without overlap."""
    if kind not in _BEHIND_RUN:
        for match in pattern.finditer(data):
            begin, end = match.span(group)
            yield match.start(), match.end(), end - begin
        return
    follows, run, first, rest = _BEHIND_RUN[kind]
    at = floor = 0
    while (place := data.find(follows, at)) >= 0:
        at = place + 1
        tail = rest.match(data, place + len(follows))
        if tail:
            begin = floor + len(data[floor:place].rstrip(run))
            start = first.search(data, begin, place)
            if start:
                yield start.start(), tail.end(), tail.end() - start.start()
                at = floor = tail.end()
        floor = max(floor, place + 1)  # no run goes on across its end


def scan(data: bytes) -> list[tuple[int, int, int]]:
    """(start, end, index of the kind) of every secret, in code points, in order."""
    lowered = data.lower()
    found = []
    for index, (kind, pattern, group, least) in enumerate(_COMPILED):
        if kind in _NEEDLES and not any(needle in lowered for needle in _NEEDLES[kind]):
            continue
        for start, end, length in _spans(kind, pattern, group, data):
            if length >= least:
                found.append((start, end, index))
    if not found or data.isascii():
        return sorted(found, key=lambda x: (x[0], x[2]))
    # the patterns begin and end at ASCII characters, so no code point is cut
    points, before, total = {}, 0, 0
    for at in sorted({p for s, e, _ in found for p in (s, e)}):
        total += len(data[before:at].decode())
        points[at], before = total, at
    return sorted(((points[s], points[e], k) for s, e, k in found), key=lambda x: (x[0], x[2]))
