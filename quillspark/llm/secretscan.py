"""Secrets in whole texts: known shapes, and random strings exposed by token efficiency.

A byte-pair vocabulary spends few tokens on words and many on random characters. A string with few
characters a token is reported as ``random``, unless it is a digest or an identifier of words that
themselves take few tokens.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_right
from collections.abc import Callable
from itertools import accumulate
from statistics import median

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from quillspark.llm.common import map_text

KINDS = ("assign", "access", "hex", "random")

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

Span = tuple[str, int, int]

# What the base detectors accept.
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")

#: Fixed value: the published split pattern of the vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Strings to test: unbroken runs of key characters, long enough.
CANDIDATE = "[A-Za-z0-9+/_=-]{%d,}"
#: Known digests and identifiers that are no secrets: hexadecimal (also UUIDs) and digits.
DIGEST = re.compile(r"[0-9a-fA-F-]+|[0-9A-F-]+")
#: What an identifier is made of: words, capitals in a row, numbers.
PIECE = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")

_loaded: dict[str, tiktoken.Encoding] = {}


def vocabulary(path: str) -> tiktoken.Encoding:
    """The vocabulary at ``path``, loaded once in each Python process."""
    if path not in _loaded:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[path] = tiktoken.Encoding("scan", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def base_spans(text: str) -> list[Span]:
    """Secrets of known shapes, leftmost and non-overlapping in each kind, by start and kind."""
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(out, key=order)


def order(s: Span) -> tuple[int, int]:
    return s[1], KINDS.index(s[0])


def identifier(s: str, coder: tiktoken.Encoding, most: float) -> bool:
    """Whether a run is words, and numbers of up to 4 digits, whose words have ``most`` characters a token or more.

    Signs and numbers cost a token or more each, so an identifier's own ratio may be low; its words'
    isn't. They have to reach it together and in the median, so one long word doesn't cover for a key.
    """
    pieces = PIECE.findall(s)
    words = [p for p in pieces if not p.isdigit()]
    if not words or any(len(p) > 4 for p in pieces if p.isdigit()):
        return False
    tokens = [len(coder.encode_ordinary(p)) for p in words]
    return sum(map(len, words)) >= most * sum(tokens) and median(len(p) / n for p, n in zip(words, tokens, strict=True)) >= most


def random_spans(text: str, base: list[Span], coder: tiktoken.Encoding, most: float, shortest: int = 20) -> list[Span]:
    """Runs of at least ``shortest`` characters with fewer than ``most`` characters a token, outside the base spans."""
    out, taken = [], sorted(s[1:] for s in base)
    ends = list(accumulate((b for _, b in taken), max))
    for m in re.finditer(CANDIDATE % shortest, text):
        s, (a, b) = m[0], m.span()
        if DIGEST.fullmatch(s):
            continue
        # The first base span that may end after this run's start is the only one to start before its end, if any does.
        i = bisect_right(ends, a)
        if i < len(taken) and taken[i][0] < b:
            continue
        if len(s) < most * len(coder.encode_ordinary(s)) and not identifier(s, coder, most):
            out.append(("random", a, b))
    return out


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scanner(path: str, most: float, shortest: int) -> Callable[[list], list[list]]:
    def one(text: str | None) -> tuple:
        text = text or ""
        base = base_spans(text)
        more = random_spans(text, base, vocabulary(path), most, shortest)
        every = sorted(base + more, key=order) if more else base
        counts = [sum(s[0] == k for s in base) for k in KINDS[:3]]
        return *counts, hashlib.sha256(written(base).encode()).hexdigest(), written(every), len(more), [{"kind": k, "start": a, "end": b} for k, a, b in every]

    def work(texts: list) -> list[list]:
        found = [one(x) for x in texts]
        return [list(x) for x in zip(*found, strict=True)] if found else [[] for _ in range(7)]

    return work


def find_secrets(docs: DataFrame, path: str = VOCABULARY, most: float = 2.2, shortest: int = 20, keep: list[str] | None = None) -> DataFrame:
    """Secrets of every whole text, one row for each row of ``docs``.

    Returns ``keep`` (doc_id), the number of spans of each known shape (n_assign, n_access, n_hex),
    base_sha256 of those, spans (all, written ``kind:start:end``), n_random (strings of fewer than
    ``most`` characters a token) and found (all spans as an array). Offsets are code points, the end
    exclusive. ``path`` names the vocabulary's file; every executor has to have it.

    ``most`` and ``shortest`` decide what counts as random: below ``shortest`` characters a ratio says
    little, so shorter strings are left to the known shapes. Digests (hexadecimal, UUIDs), numbers,
    and identifiers whose words take few tokens are left out, however long they are.

    A null text counts as empty: no spans. Rows are independent, so repeats, ties and nulls in other
    columns change nothing, and other columns are not read. An empty table gives an empty one. Time
    grows with the length of a text, for runs without a blank too: nothing in it backtracks.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    fields = [(f"n_{k}", "bigint", pa.int64()) for k in KINDS[:3]]
    fields += [("base_sha256", "string", pa.string()), ("spans", "string", pa.string()), ("n_random", "bigint", pa.int64())]
    fields += [("found", "array<struct<kind:string,start:int,end:int>>", kind)]
    return map_text(docs, keep or ["doc_id"], lambda: scanner(path, most, shortest), fields)
