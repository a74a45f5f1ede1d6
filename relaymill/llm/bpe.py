"""Byte-pair encoding and decoding of whole texts, one short word at a time. Runs inside tasks.

A word is held as a contiguous array of part boundaries, and beside each boundary the rank
of the merge of the part that starts there with the next one. The least rank is found by a
scan, its right boundary is deleted, and the two neighbouring ranks are looked up again.
Words are short, so the scan beats any heap. Long runs of one character class, which are not
short words, would take a time that grows with the square of their length; from
`LONG_WORD` parts on, a heap over the same ranks takes the place of the scan.
"""

from __future__ import annotations

import heapq
import json

import regex
from tokenizers import Tokenizer

NO_RANK = 1 << 60
LONG_WORD = 256


def _byte_symbols() -> list[str]:
    """The printable stand-in of every byte: printable Latin-1 as it is, others from 256 up."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in shown)
    spare = {b: 256 + k for k, b in enumerate(others)}
    return [chr(b if b in shown else spare[b]) for b in range(256)]


class Vocabulary:
    """Tokens, merges and special tokens of a tokenizer file with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        merges = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        # rank and joined token of each pair
        self.ranks = {(a, b): rank for rank, (a, b) in enumerate(merges)}
        self.symbols = _byte_symbols()
        # Normal form and word pattern follow the Unicode version of the library that the
        # file is written for; both are asked of it for chunks that are not plain ASCII.
        library = Tokenizer.from_file(path)
        self.normal = library.normalizer.normalize_str
        self.split = library.pre_tokenizer.pre_tokenize_str
        self.tokens = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}


class Remembered:
    """A bounded dictionary of two generations: what is used again outlives a change."""

    def __init__(self, limit: int, longest: int = 48):
        self.limit, self.longest = limit // 2, longest
        self.young: dict = {}
        self.old: dict = {}

    def get(self, key: str):
        value = self.young.get(key)
        if value is None:
            value = self.old.get(key)
            if value is not None:
                self.put(key, value)
        return value

    def put(self, key: str, value) -> None:
        if len(key) <= self.longest:
            if len(self.young) >= self.limit:
                self.old, self.young = self.young, {}
            self.young[key] = value


class Encoder:
    """Encodes texts; remembers words, and normalised chunks between spaces."""

    WORDS_KEPT = 800_000
    CHUNKS_KEPT = 1_200_000

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        self.specials = regex.compile(
            "(" + "|".join(regex.escape(s) for s in vocabulary.special) + ")"
        )
        self.names = {i: str(i) for i in vocabulary.tokens}
        self.words = Remembered(self.WORDS_KEPT)
        self.chunks = Remembered(self.CHUNKS_KEPT)

    def encode(self, text: str) -> list[int]:
        """The ids of a text."""
        out: list[int] = []
        for part in self._parts(text):
            special = self.vocabulary.special.get(part)
            if special is not None:
                out.append(special)
                continue
            for chunk in self._chunks(part):
                out += self._ids(chunk)
        return out

    def spelled(self, text: str) -> tuple[int, str, str]:
        """Number of ids, the ids in decimal and the decoded text, by remembered chunks."""
        found: list[tuple[str, str]] = []
        for part in self._parts(text):
            special = self.vocabulary.special.get(part)
            if special is not None:
                found.append(self._named([special]))
                continue
            young = self.chunks.young
            chunks = self._chunks(part)
            both = [young.get(chunk) for chunk in chunks]
            if None in both:
                both = [b or self._spell(chunk) for b, chunk in zip(both, chunks)]
            found += both
        ids = "".join([both[0] for both in found])
        return ids.count(" "), ids[1:], "".join([both[1] for both in found])[1:]

    def _parts(self, text: str) -> list[str]:
        """The text, cut at special tokens; these are found before it is normalised."""
        return self.specials.split(text) if "<|" in text else [text]

    def _chunks(self, part: str) -> list[str]:
        """Normalised and cut at spaces; other white space is left to the pattern."""
        part = part.lower() if part.isascii() else self.vocabulary.normal(part)
        return part.replace("\n", " ").split(" ")

    def _spell(self, chunk: str) -> tuple[str, str]:
        both = self.chunks.get(chunk)
        if both is None:
            both = self._named(self._ids(chunk))
            self.chunks.put(chunk, both)
        return both

    def _named(self, ids: list[int]) -> tuple[str, str]:
        """Ids and tokens, each with a space before it (no token holds a space)."""
        names, tokens = self.names, self.vocabulary.tokens
        return "".join([" " + names[i] for i in ids]), "".join([" " + tokens[i] for i in ids])

    def _ids(self, chunk: str) -> list[int]:
        """Ids of a normalised chunk without spaces."""
        known = self.words.get(chunk)
        if known is not None:
            return known
        if chunk.isalpha() and max(chunk) < "\u0250":  # one word of the pattern, in Latin letters
            known = self.word(chunk)
            self.words.put(chunk, known)
            return known
        if chunk[:-1].isalpha() and chunk[-1] in ".,;:!?":
            return self._ids(chunk[:-1]) + self._ids_of_words([chunk[-1]])
        if chunk.isascii():
            return self._ids_of_words(self.pattern.findall(chunk))
        table = {s: b for b, s in enumerate(self.vocabulary.symbols)}
        words = [bytes(table[c] for c in w).decode() for w, _ in self.vocabulary.split(chunk)]
        return self._ids_of_words(words)

    def _ids_of_words(self, words: list[str]) -> list[int]:
        ids: list[int] = []
        for word in words:
            known = self.words.get(word)
            if known is None:
                known = self.word(word)
                self.words.put(word, known)
            ids += known
        return ids

    def word(self, word: str) -> list[int]:
        """Ids of one word of the pattern."""
        vocabulary = self.vocabulary
        table = vocabulary.symbols
        symbols = [table[b] for b in word.encode()]
        symbols[-1] += vocabulary.end
        merge = self._merged if len(symbols) < LONG_WORD else self._merged_long
        ids = vocabulary.ids
        return [ids[p] for p in merge(symbols)]

    def _merged(self, symbols: list[str]) -> list[str]:
        rank_of = self.vocabulary.ranks.get
        text = "".join(symbols)
        starts = list(range(len(symbols)))
        starts.append(len(text))
        # rank[i]: of merging part i with part i + 1; the last part has no next one
        rank = [rank_of(pair, NO_RANK) for pair in zip(symbols, symbols[1:])]
        while rank:
            least = min(rank)
            if least == NO_RANK:
                break
            i = rank.index(least)
            del starts[i + 1]
            del rank[i]
            begin, end = starts[i], starts[i + 1]
            part = text[begin:end]
            if i < len(rank):
                rank[i] = rank_of((part, text[end : starts[i + 2]]), NO_RANK)
            if i:
                rank[i - 1] = rank_of((text[starts[i - 1] : begin], part), NO_RANK)
        return [text[a:b] for a, b in zip(starts, starts[1:])]

    def _merged_long(self, symbols: list[str]) -> list[str]:
        """The same result with a heap of ranks and linked parts."""
        ranks = self.vocabulary.ranks
        parts: list[str | None] = list(symbols)
        after = [*range(1, len(parts)), -1]
        before = [-1, *range(len(parts) - 1)]
        heap = [
            (ranks[pair], i, pair) for i, pair in enumerate(zip(parts, parts[1:])) if pair in ranks
        ]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i] if parts[i] is not None else -1
            if j < 0 or (parts[i], parts[j]) != pair:
                continue  # one of the two has changed meanwhile
            parts[i], parts[j] = pair[0] + pair[1], None
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right >= 0:
                    new = (parts[left], parts[right])
                    if new in ranks:
                        heapq.heappush(heap, (ranks[new], left, new))
        return [p for p in parts if p is not None]


def decode(vocabulary: Vocabulary, ids: list[int]) -> str:
    """The tokens with a space between each two: the file names no decoder of its own."""
    return " ".join([vocabulary.tokens[i] for i in ids])


def words_of(vocabulary: Vocabulary, ids: list[int]) -> str:
    """Readable text: the words that the tokens spell, with a space between each two."""
    byte_of = {s: b for b, s in enumerate(vocabulary.symbols)}
    end = vocabulary.end
    out = bytearray()
    special = {i: t for t, i in vocabulary.special.items()}
    for i in ids:
        if i in special:
            out += special[i].encode() + b" "
            continue
        token = vocabulary.tokens[i]
        closes = bool(end) and token.endswith(end)
        out += bytes(byte_of[c] for c in (token[: -len(end)] if closes else token))
        out += b" " if closes else b""
    return out.decode(errors="replace").removesuffix(" ")
