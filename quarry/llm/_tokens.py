"""Loading a public tokenizer file and cutting texts into chunks whose tokens
do not depend on their neighbours.

A text is cut at white space (always a pre-token border, see ``chunks``), the
distinct new chunks of a batch are split into pre-tokens together, and the
results are kept in a bounded table, so a frequent word is worked on once per
worker.  What happens to a pre-token (a table lookup, merges) is the
operators' part.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import re
from dataclasses import dataclass

import numpy as np
import regex

# The code points with the Unicode property White_Space.
WHITE_SPACE = "".join(map(chr, [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                                0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
# Fixed value: the split pattern of byte-level vocabularies.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_WORD = re.compile(f"[^{WHITE_SPACE}]+")
_SPACED_WORD = re.compile(f"[{WHITE_SPACE}]*[^{WHITE_SPACE}]+|[{WHITE_SPACE}]+")
#: Python's str.split() also splits at these, tokenizers do not.
_SEPARATORS = re.compile("[\x1c-\x1f]")
#: Chunks with other characters than these take the library's own normaliser
#: and splitter, so that no difference between Unicode tables can matter.
_PLAIN = re.compile("[\t\n\r -~\xa1-ɏ]*")


def is_plain(chunk: str) -> bool:
    return chunk.isascii() and chunk.isprintable() or _PLAIN.fullmatch(chunk) is not None


def is_plain_text(text: str) -> bool:
    return _PLAIN.fullmatch(text) is not None


@dataclass(frozen=True, eq=False)
class Vocabulary:
    """A BPE tokenizer file, read on the driver and sent to the workers (a few
    MB whatever the data)."""

    source: str                       # the file's JSON
    ids: dict[str, int]
    merges: list[tuple[str, str]]
    end_of_word: str
    added: dict[str, int]
    pattern: str
    lower: bool

    def __reduce__(self):
        return parse_vocabulary, (self.source,)

    @functools.cached_property
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_str(self.source)

    @functools.cached_property
    def find(self):
        return regex.compile(self.pattern).findall

    @functools.cached_property
    def added_pattern(self):
        return re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")

    @functools.cached_property
    def added_start(self) -> str:
        """What every added token begins with."""
        return os.path.commonprefix(list(self.added)) if self.added else "\0"

    def pieces(self, chunk: str) -> list[str]:
        """A chunk cut at added-token strings, those kept."""
        return [p for p in self.added_pattern.split(chunk) if p] if self.added else [chunk]

    def pre_tokens(self, piece: str) -> list[bytes]:
        if is_plain(piece):
            text = piece.lower() if self.lower else piece
            if text.isalpha() or text[:1] == " " and text[1:].isalpha():
                return [text.encode()]                # one run of letters
            return [p.encode() for p in self.find(text)]
        tok = self.library
        text = tok.normalizer.normalize_str(piece) if tok.normalizer else piece
        alphabet = byte_alphabet()
        return [bytes(map(alphabet.__getitem__, p)) for p, _ in tok.pre_tokenizer.pre_tokenize_str(text)]

    def chunks(self, text: str) -> list[str]:
        """A file whose splitter drops white space gets words; otherwise a
        word keeps the white space before it."""
        if self.end_of_word:
            return _WORD.findall(text) if _SEPARATORS.search(text) else text.split()
        return _SPACED_WORD.findall(text)


@functools.lru_cache(maxsize=1)
def byte_alphabet() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 characters stand for their
    own byte, the other bytes follow in order from U+0100."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = sorted(set(range(256)) - set(own))
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


@functools.lru_cache(maxsize=4)
def parse_vocabulary(source: str) -> Vocabulary:
    d = json.loads(source)
    m = d["model"]
    merges = [tuple(x.split(" ", 1)) if isinstance(x, str) else tuple(x) for x in m["merges"]]
    splits = [p["pattern"]["Regex"] for p in (d["pre_tokenizer"].get("pretokenizers") or []) if p["type"] == "Split"]
    steps = (d.get("normalizer") or {}).get("normalizers") or []
    return Vocabulary(source, m["vocab"], merges, m.get("end_of_word_suffix") or "",
                      {a["content"]: a["id"] for a in d.get("added_tokens", [])},
                      splits[0] if splits else BYTE_LEVEL_PATTERN, any(s["type"] == "Lowercase" for s in steps))


@functools.lru_cache(maxsize=4)
def load_vocabulary(path: str) -> Vocabulary:
    with open(path, encoding="utf-8") as f:
        return parse_vocabulary(f.read())


class PairTable:
    """Adjacent pairs of ids -> rank, and rank -> merged id."""

    def __init__(self, vocab: Vocabulary):
        self.base = max(vocab.ids.values()) + 1
        pairs = [(vocab.ids[a] * self.base + vocab.ids[b], r, vocab.ids[a + b]) for r, (a, b) in enumerate(vocab.merges)]
        self.merged = np.array([p[2] for p in pairs], np.int64)
        # open addressing, a tenth full: most pairs that are asked for are none
        # and meet an empty slot at once
        self.shift = np.uint64(64 - max(4, (10 * len(pairs)).bit_length()))
        slots = 1 << (64 - int(self.shift))
        self.keys, self.order = np.full(slots, -1, np.int64), np.zeros(slots, np.int64)
        key = np.array([p[0] for p in pairs], np.int64)
        rank = np.array([p[1] for p in pairs], np.int64)
        at = self._slot(key)
        while len(key):
            free = self.keys[at] == -1
            self.keys[at[free]], self.order[at[free]] = key[free], rank[free]
            out = self.keys[at] != key
            # of several in one slot the last stays
            self.order[at[~out]] = rank[~out]
            key, rank, at = key[out], rank[out], (at[out] + 1) & (slots - 1)
        self.none = len(pairs)                         # the rank of no pair
        chars = {b: c for c, b in byte_alphabet().items()}
        self.inner = np.array([vocab.ids[chars[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab.ids[chars[b] + vocab.end_of_word] for b in range(256)], np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, ``none`` where it cannot be merged (an id below
        0 stands for no symbol)."""
        key = a * self.base + b
        at = self._slot(key)
        found = self.keys[at]
        out = np.where((found == key) & (a >= 0) & (b >= 0), self.order[at], self.none)
        left = np.nonzero((found != key) & (found != -1))
        while len(left[0]):
            at_left = (at[left] + 1) & (len(self.keys) - 1)
            at[left] = at_left
            found, wanted = self.keys[at_left], key[left]
            hit = (found == wanted) & (np.broadcast_to(a, key.shape)[left] >= 0) & (np.broadcast_to(b, key.shape)[left] >= 0)
            out[left] = np.where(hit, self.order[at_left], self.none)
            more = (found != wanted) & (found != -1)
            left = tuple(x[more] for x in left)
        return out

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def symbols(self, word: bytes) -> np.ndarray:
        raw = np.frombuffer(word, np.uint8)
        out = self.inner[raw]
        out[-1:] = self.last[raw[-1:]]
        return out


class ChunkTable:
    """chunk -> value, filled batch by batch with ``compute(chunks)``.  Bounded:
    past ``entries`` keys only the older half is kept (frequent chunks come
    early); keys over ``longest`` characters live for one batch only."""

    def __init__(self, vocab: Vocabulary, compute, entries: int = 500_000, longest: int = 64):
        self.vocab, self.compute, self.entries, self.longest = vocab, compute, entries, longest
        self.values: dict = {}

    def rows(self, texts: list[str], batch_chars: int = 2_000_000):
        """For each text, in order, the values of its chunks."""
        part, size = [], 0
        for t in texts:
            part.append(t)
            size += len(t)
            if size >= batch_chars:
                yield from self._batch(part)
                part, size = [], 0
        if part:
            yield from self._batch(part)

    def _batch(self, texts):
        chunks = [self.vocab.chunks(t) for t in texts]
        distinct = set().union(*chunks)
        new = [c for c in distinct if c not in self.values]
        if len(self.values) + len(new) > self.entries:
            self.values = dict(itertools.islice(self.values.items(), self.entries // 2))
            new = [c for c in distinct if c not in self.values]
        for k in range(0, len(new), 50_000):
            part = new[k : k + 50_000]
            self.values.update(zip(part, self.compute(part), strict=True))
        for c in chunks:
            yield list(map(self.values.__getitem__, c))
        for c in new:
            if len(c) > self.longest:
                del self.values[c]


def pre_token_plan(vocab: Vocabulary, chunks: list[str], known) -> tuple[list[list], list[bytes]]:
    """Split chunks into pre-tokens.  Per chunk a list of either
    ``known(pre_token)`` results (not None), ids of added tokens wrapped as
    one-element lists, or indexes into the returned distinct other words."""
    words: dict[bytes, int] = {}
    plan, start = [], vocab.added_start
    for c in chunks:
        parts: list = []
        for piece in vocab.pieces(c) if start in c else (c,):
            if piece in vocab.added:
                parts.append([vocab.added[piece]])
                continue
            for pre in vocab.pre_tokens(piece):
                hit = known(pre)
                parts.append(hit if hit is not None else words.setdefault(pre, len(words)))
        plan.append(parts)
    return plan, list(words)
