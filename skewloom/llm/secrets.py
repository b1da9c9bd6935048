"""Secret scan: fixed patterns, and guess-cost of values in credential contexts.

Base spans are the whole matches of three kinds: ``assign`` (a credential name, ``:`` or ``=`` and a
value of eight characters or more), ``access`` (access key ids) and ``hex`` (lower-case hex runs of 32
or more). The method adds spans of kind ``guess``: a value that stands in a wider credential context
is segmented into dictionary words, dates, repeats, keyboard walks, sequences and brute-force spans by
dynamic programming, and the cheapest total is its number of guesses. Words are those that people choose and those
of a public vocabulary, ranked by frequency. A value that takes more guesses than ``MIN_LOG10`` is a secret, unless a base span
holds the whole of it. After a mere blank a value that looks like plain words is prose, not a secret.

Offsets are code points, end exclusive. A null or empty text has no spans; an empty table gives an empty result. Matches of a kind
never overlap, and texts of any length are scanned whole. Repeated rows each get their answer; further columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: A greedy run of 32 or more is a maximal run, as ``[0-9a-f]+`` gives it.
HEX = re.compile(r"[0-9a-f]{32,}")
CONTEXT = re.compile(
    r"""(?<![A-Za-z0-9])(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|api[_-]?key|access[_-]?key|secret[_-]?key|private[_-]?key|client[_-]?secret|bearer|auth(?:orization)?)["']?(?:\x20{0,4}[:=]\x20{0,4}|\x20is\x20{1,4}|\x20)["']?([^\s"'<>]{8,})""",
    re.I | re.A,
)
LETTERS = re.compile(r"[^\W\d_]+")
HINTS = ("pass", "pwd", "secret", "token", "credential", "api", "key", "bearer", "auth")
KINDS = ("assign", "access", "hex", "guess")
#: log10 of the guesses above which a value counts as a secret.
MIN_LOG10 = 10.0

# Words people choose, most common first.
WORDS = (
    "password", "qwerty", "dragon", "baseball", "football", "letmein", "monkey", "master", "shadow", "michael",
    "jennifer", "superman", "batman", "trustno", "killer", "welcome", "login", "admin", "hello", "freedom",
    "whatever", "iloveyou", "sunshine", "princess", "starwars", "secret", "summer", "winter", "spring", "autumn",
    "hunter", "ranger", "soccer", "hockey", "george", "andrew", "charlie", "thomas", "jordan", "daniel",
    "access", "flower", "cheese", "computer", "internet", "test", "guest", "root", "user", "changeme",
    "default", "example", "sample", "token", "value", "string", "none", "null", "true", "false",
    "love", "money", "blue", "green", "orange", "purple", "silver", "golden", "happy", "lucky",
    "the", "and", "that", "this", "with", "from", "have", "your", "key", "pass",
)
# Rows of a keyboard.
KEY_ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
SUBSTITUTES = {"0": "o", "1": "l", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
_CHOSEN = {w: i + 2 for i, w in enumerate(WORDS)}
#: Letters of the shortest and of the longest word of a vocabulary that counts.
SHORTEST, LONGEST = 3, 20
#: A block of up to so many characters that is said twice is looked for at every place.
NEAR = 32


@lru_cache(4)
def ranks(vocabulary: str | None) -> dict[str, int]:
    """Words and their ranks: those that people choose, then the whole words of a tokenizer's file in the order of their ids."""
    out = dict(_CHOSEN)
    if vocabulary:
        with open(vocabulary, encoding="utf-8") as f:
            ids = json.load(f)["model"]["vocab"]
        whole = (t.removesuffix("</w>") for t in sorted(ids, key=ids.get) if t.endswith("</w>"))
        for w in whole:
            if SHORTEST <= len(w) <= LONGEST and w.isascii() and w.isalpha():
                out.setdefault(w, len(out) + 2)
    return out


_NEXT = {(a, b) for row in KEY_ROWS for a, b in zip(row, row[1:], strict=False)} | {
    (x, y) for up, down in zip(KEY_ROWS, KEY_ROWS[1:], strict=False) for k, x in enumerate(up) for y in down[max(0, k - 1) : k + 1]
}
_NEXT |= {(b, a) for a, b in _NEXT}
_DATE = re.compile(r"(?:19|20)\d\d(?:[-/.]?(?:0[1-9]|1[0-2])(?:[-/.]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)?\d\d")


def _space(c: str) -> float:
    """log10 of the alphabet that a brute-force search of ``c`` goes through."""
    if c.isdigit():
        return 1.0
    if "a" <= c <= "z" or "A" <= c <= "Z":
        return math.log10(26)
    return math.log10(33) if c < "\x80" else 3.0


def guess_log10(value: str, limit: float = math.inf, words: dict[str, int] = _CHOSEN) -> float:
    """log10 of the guesses of the cheapest segmentation; each extra segment costs a factor two.

    Ends early, with ``limit`` or more, where the whole is sure to cost at least ``limit``.
    """
    n = len(value)
    plain = "".join(SUBSTITUTES.get(c, c) for c in value.lower())
    low = value.lower()
    best = [0.0] + [math.inf] * n
    dates = {}
    for i in range(n):
        for end in range(i + 4, min(n, i + 10) + 1):
            if _DATE.fullmatch(value, i, end):
                dates.setdefault(end, []).append(i)
    walk = [0] * n  # start of the keyboard walk that ends here
    same = [0] * n  # start of the run of one character
    step = [0] * n  # start of the run of consecutive characters
    for k in range(1, n):
        walk[k] = walk[k - 1] if (low[k - 1], low[k]) in _NEXT else k
        same[k] = same[k - 1] if value[k] == value[k - 1] else k
        ok = abs(ord(value[k]) - ord(value[k - 1])) == 1
        turn = ok and k - step[k - 1] >= 2 and ord(value[k]) - ord(value[k - 1]) != ord(value[k - 1]) - ord(value[k - 2])
        step[k] = (k - 1 if turn else step[k - 1]) if ok else k
    join, seen = math.log10(2), {}
    for end in range(1, n + 1):
        last = end - 1
        cost = best[last] + _space(value[last])
        for i in range(max(0, end - LONGEST), end - 2):
            rank = words.get(plain[i:end]) or words.get(low[i:end])
            if rank:
                variants = sum(a != b for a, b in zip(plain[i:end], value[i:end], strict=True))
                cost = min(cost, best[i] + join + math.log10(rank) + variants * 0.5)
        for i in dates.get(end, ()):
            cost = min(cost, best[i] + join + math.log10(365 * 120))
        for start, least, per in ((same[last], 3, 0.3), (step[last], 3, 0.5), (walk[last], 4, 0.6)):
            # No other segment reaches further than 64 characters into a run.
            for i in range(start, min(end - least, start + 64) + 1):
                cost = min(cost, best[i] + join + _space(value[i]) + 0.7 + per * math.log10(end - i))
        halves = range(2, min(end // 2, NEAR) + 1)
        tail = value[end - 4 : end]
        if NEAR < end - seen.get(tail, end) <= end // 2:  # a longer block ends as the one before it did
            halves = [*halves, end - seen[tail]]
        seen[tail] = end
        for half in halves:  # a block said twice
            if value[last] == value[last - half] and value[end - half : end] == value[end - 2 * half : end - half]:
                cost = min(cost, best[end - half] + join + math.log10(half + 1))
        best[end] = cost
        # Unless a run goes on, a segment that crosses this place starts near it, or is the second half of what came before.
        if cost >= limit and (end == n or walk[end] == same[end] == end and step[end] in (end, last) and (end + 1 >= n or step[end + 1] >= last)):
            least_cost = min(best[max(0, min(end - NEAR - 1, end // 2)) : end + 1])
            if least_cost >= limit:
                return least_cost
    return best[n]


def _mixed(value: str) -> bool:
    """Not plain words: digits, three classes, or letters whose case changes inside."""
    classes = (any(c.islower() for c in value), any(c.isupper() for c in value), any(c.isdigit() for c in value), any(not c.isalnum() for c in value))
    return classes[2] or classes[3] and sum(classes) >= 3 or any(not (p.islower() or p.isupper() or p.istitle()) for p in LETTERS.findall(value))


def scan(text: str | None, words: dict[str, int] = _CHOSEN) -> list[tuple[str, int, int]]:
    """All spans of a text as ``(kind, start, end)``, ordered by start, then kind as listed."""
    text = text or ""
    found = [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16] if "AKIA" in text else []
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    low = text.lower()
    if any(h in low for h in HINTS):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
        taken = sorted((s, e) for _, s, e in found)
        for m in CONTEXT.finditer(text):
            value = m[1].rstrip(".,;:!?)]}#*$%&|")
            start, end = m.start(1), m.start(1) + len(value)
            if any(s <= start and end <= e for s, e in taken):
                continue
            told = text[m.start() : start].rstrip("\"' ").endswith((":", "="))
            if len(value) >= 8 and (told or _mixed(value)) and guess_log10(value, MIN_LOG10, words) >= MIN_LOG10:
                found.append(("guess", start, end))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def _say(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long"


def _scan_batches(vocabulary: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = ranks(vocabulary)
        for b in batches:
            cols = [[] for _ in range(6)]
            for t in b.column("text"):
                spans = scan(t.as_py(), words)
                base = [x for x in spans if x[0] != "guess"]
                count = {k: sum(x[0] == k for x in spans) for k in KINDS}
                row = (count["assign"], count["access"], count["hex"], hashlib.sha256(_say(base).encode()).hexdigest(), _say(spans), count["guess"])
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            arrays = [b.column("doc_id"), *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]]
            yield pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in SCHEMA.split(", ")])

    return run


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """One row per document with its counts and spans. ``vocabulary``: a tokenizer's file whose whole words count as guessable."""
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(_scan_batches(vocabulary), SCHEMA)
