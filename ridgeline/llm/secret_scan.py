"""Secret scans: fixed patterns, and a guess-cost dynamic programme over values in credential contexts.

The base patterns (assignments, access keys, long hex runs) are found as they stand. A wider set of contexts ("pwd: ...",
"passphrase is ...", "Authorization: Bearer ...", quoted values with punctuation) gives candidate values, overlapping ones too;
each is cut at least cost into words, dates, repeats, keyboard walks, sequences and brute-force characters, and the value
counts as a secret if even the cheapest cut takes 10 ** ``least`` guesses or more. The cost of a cut is the sum of the log10
guesses of its parts and a price for each part. Every stretch of a repeat, walk or sequence is a part, not whole runs alone;
what a part costs is kept as a running minimum, so the programme is linear in the value's length (but for a logarithm at
repeats), and values of any length are scored whole by the same rules.

Words are ranked: a short list of what people choose, then the words of letters that most documents of the corpus hold
(``corpus_words``, a bounded number, counted over all of them).

Defined results: null and empty texts have no spans; equal texts give equal spans; rows are independent. Offsets count
code points, ends are exclusive. Only the named columns are read, so other columns can't clash.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import most_counted, slices

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")

#: A name and what sets its value: a mark, "is", or blanks alone after words that announce a credential.
CONTEXT = re.compile(
    r"(?<![a-z0-9])(?:pass(?:word|wd|phrase|code)?|pwd|pin|secret|token|bearer|api_?key|access_?key|private_?key|auth(?:orization)?|credentials?|login)[\"']?(?:\s*(?::=|=>|[:=]|\bis\b)\s*|(?<=bearer)(?P<blank>\s+)|(?<=token)(?P<blanks>\s+))",
    re.IGNORECASE | re.ASCII,
)
VALUE = re.compile(r"[\"']([^\"'\n]+)[\"']|([^\s\"'<>,;]+)")
KINDS = ("assign", "access", "hex", "guess")
LEAST_VALUE = 6

# Words that people choose, with a rank by their place.
WORDS = (
    "password", "bearer", "admin", "welcome", "letmein", "monkey", "dragon", "master", "login", "secret", "token", "user", "root", "test", "guest", "example",
    "changeme", "default", "hello", "love", "sunshine", "princess", "football", "baseball", "shadow", "michael", "jordan", "summer", "winter", "spring",
    "autumn", "monday", "friday", "sunday", "january", "march", "april", "june", "july", "august", "october", "company", "server", "database", "system",
    "public", "private", "key", "value", "none", "null", "true", "false", "your", "here", "pass", "word", "my", "the", "is", "not", "and", "for", "with", "change", "this",
)
LAYOUT = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")  # fixed rows of the keyboard
LEET = str.maketrans("4@831!0$57+", "aabeiiosstt")

PART_PRICE = 0.3  # log10 guesses for the order and number of parts
BRUTE = 1.0  # log10 guesses of one brute-force character
DOUBLED = math.log10(2)  # for each doubling of a repeat's count
MOST_UNIT = 64  # characters of a repeat's unit, in values of any length
WALK, STEP = math.log10(47), 0.35  # a walk's first key, and each of its keys
SEQUENCE = 1.2  # a sequence's kind and start
YEAR, DAY = 2.1, 4.6  # a year alone, and a day of a year
DATE = re.compile(r"(?:19|20)\d\d([-/._]?)(?:0?[1-9]|1[0-2])\1(?:0?[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])([-/._]?)(?:0?[1-9]|1[0-2])\2(?:19|20)\d\d|(?:19|20)\d\d", re.ASCII)
DATE_SIZES = (4, 6, 7, 8, 9, 10)
LONGEST_WORD = 24


def _neighbours() -> dict[str, set[str]]:
    at = {c: (x + y / 2, y) for y, row in enumerate(LAYOUT) for x, c in enumerate(row)}
    return {a: {b for b, (u, v) in at.items() if a != b and abs(x - u) <= 1 and abs(y - v) <= 1} for a, (x, y) in at.items()}


NEAR = _neighbours()


class Lexicon:
    """Ranked words; those of more than LONGEST_WORD characters are left out."""

    def __init__(self, words: Iterable[str] = WORDS):
        self.rank: dict[str, int] = {}
        for word in words:
            if len(word) <= LONGEST_WORD:
                self.rank.setdefault(word, len(self.rank) + 1)
        self.longest = max(map(len, self.rank), default=0)


DEFAULT = Lexicon()


def lowered(value: str) -> str:
    """Lower case, character by character: those that become two stay."""
    return "".join([low if len(low := c.lower()) == 1 else c for c in value])


def word_cost(value: str, low: str, plain: str, i: int, j: int, lexicon: Lexicon) -> float | None:
    """Of the word at i:j: its rank, and what its case and look-alike digits add."""
    for form, twist in ((low, 0.0), (plain, 0.6)):
        if (r := lexicon.rank.get(form[i:j])) is not None:
            own = value[i:j]
            return math.log10(r + 1) + (0.0 if own == low[i:j] else 0.3 if own.istitle() or own.isupper() else 1.0) + twist
    return None


def repeat_runs(value: str) -> list[tuple[int, int, int]]:
    """(start, end, unit) of the stretches that repeat a unit of up to MOST_UNIT characters; not those a shorter unit gives."""
    codes = np.frombuffer(value.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    runs: list[tuple[int, int, int]] = []
    by_unit: dict[int, list[tuple[int, int]]] = {}
    for unit in range(1, min(MOST_UNIT, len(codes) // 2) + 1):
        edges = np.flatnonzero(np.diff(np.concatenate(([0], (codes[unit:] == codes[:-unit]).view(np.int8), [0]))))
        found = [(a, b + unit) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True) if b - a >= unit]
        shorter = [r for u, rows in by_unit.items() if unit % u == 0 for r in rows]
        if shorter:
            found = [(a, b) for a, b in found if not any(c <= a and b <= d for c, d in shorter)]
        if found:
            by_unit[unit] = found
            runs += [(a, b, unit) for a, b in found]
    return sorted(runs)


class _Repeat:
    """The cheapest start of a repeat that ends at the present place, for one run.

    Counts are priced by doublings: those over 2 ** (j - 1) and up to 2 ** j cost the same, so each class needs the least of
    a sliding window of starts, kept for each phase of the unit.
    """

    def __init__(self, start: int, unit: int):
        self.start, self.unit = start, unit
        self.windows: dict[tuple[int, int], deque[tuple[float, int]]] = {}

    def best(self, k: int, whole: list[float]) -> tuple[float, int]:
        turns, phase = divmod(k - self.start, self.unit)
        least, at = math.inf, 0
        j = 1
        while (1 << (j - 1)) + 1 <= turns:
            window = self.windows.setdefault((phase, j), deque())
            enters = k - ((1 << (j - 1)) + 1) * self.unit
            while window and window[-1][0] >= whole[enters]:
                window.pop()
            window.append((whole[enters], enters))
            while window[0][1] < k - (1 << j) * self.unit:
                window.popleft()
            if (cost := window[0][0] + DOUBLED * j) < least:
                least, at = cost, window[0][1]
            j += 1
        return least + BRUTE * self.unit, at


def guess_cost(value: str, lexicon: Lexicon = DEFAULT) -> tuple[float, list[tuple[str, str]]]:
    """The log10 guesses of the cheapest cut, and the cut: (kind, characters)."""
    n = len(value)
    low = lowered(value)
    plain = low.translate(LEET)
    runs = repeat_runs(value)[::-1]
    alive: list[tuple[int, _Repeat]] = []
    whole = [0.0] + [math.inf] * n  # best cost where a part ends at k
    brute, opened = math.inf, 0  # of a brute-force part that is still open
    walk_from, walked, walk_at = 0, math.inf, 0  # of the present walk: its start; the least whole[i] - STEP * i, and that i
    up = down = 0  # starts of the present rising and falling sequence
    back: list[tuple[int, str]] = [(0, "")] * (n + 1)
    for k in range(1, n + 1):
        best, place, kind = math.inf, 0, ""
        fresh = whole[k - 1]
        if brute > fresh:
            brute, opened = fresh, k - 1
        brute += BRUTE
        best, place, kind = brute, opened, "brute"
        for i in range(max(0, k - lexicon.longest), k - 1):
            if (cost := word_cost(value, low, plain, i, k, lexicon)) is not None and whole[i] + cost < best:
                best, place, kind = whole[i] + cost, i, "word"
        if value[k - 1] in "0123456789":
            for size in DATE_SIZES:
                i = k - size
                if i >= 0 and DATE.fullmatch(value, i, k):
                    cost = whole[i] + (YEAR if size == 4 else DAY)
                    if cost < best:
                        best, place, kind = cost, i, "date"
        while runs and runs[-1][0] < k:
            start, end, unit = runs.pop()
            alive.append((end, _Repeat(start, unit)))
        if alive:
            alive = [(end, r) for end, r in alive if end >= k]
            for _, run in alive:
                cost, i = run.best(k, whole)
                if cost < best:
                    best, place, kind = cost, i, "repeat"
        if k > 1:
            a, b = low[k - 2], low[k - 1]
            if b not in NEAR.get(a, ()):
                walk_from, walked = k - 1, math.inf
            if k - walk_from >= 3:
                i = k - 3
                if whole[i] - STEP * i < walked:
                    walked, walk_at = whole[i] - STEP * i, i
                if walked + STEP * k + WALK < best:
                    best, place, kind = walked + STEP * k + WALK, walk_at, "walk"
            alike = a.isascii() and a.isalnum() and b.isascii() and b.isalnum()
            up = up if alike and ord(b) - ord(a) == 1 else k - 1
            down = down if alike and ord(a) - ord(b) == 1 else k - 1
            for i in range(min(up, down), k - 2):  # at most 26 long
                if whole[i] + SEQUENCE + math.log10(k - i) < best:
                    best, place, kind = whole[i] + SEQUENCE + math.log10(k - i), i, "sequence"
        whole[k], back[k] = best + PART_PRICE, (place, kind)
    cut, k = [], n
    while k:
        start, kind = back[k]
        cut.append((kind, value[start:k]))
        k = start
    return whole[n], cut[::-1]


#: Words of the corpus that the lexicon takes at most, and the least number of documents that hold one.
MOST_WORDS, LEAST_HOLDERS = 20_000, 3


def corpus_words(docs: DataFrame, text_col: str = "text", most: int = MOST_WORDS) -> list[str]:
    """The words of 3 to LONGEST_WORD letters a-z that most documents hold, by that number and then by name."""
    low = F.split(F.regexp_replace(F.lower(F.col(text_col)), "[^a-z]+", " "), " ")
    held = docs.select(F.explode_outer(F.array_distinct(low)).alias("value")).where(F.length("value").between(3, LONGEST_WORD))
    return most_counted(held.groupBy("value").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_HOLDERS), most)


LEAST_GUESSES = 8.0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """The fixed patterns' spans in order of start, then kind as listed."""
    low = text.lower()
    out = []
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        out += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(*m.span(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(*m.span(), "hex") for m in _hex(text)]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


_HEX_BYTES = bytes(104 if 48 <= b <= 57 or 97 <= b <= 102 else 32 for b in range(256))


def _hex(text: str) -> list[re.Match]:
    if b"h" * 32 not in text.encode("utf-8", "surrogatepass").translate(_HEX_BYTES):
        return []
    return [m for m in re.finditer(r"[0-9a-f]{32,}", text)]  # maximal runs, as they start at a run's first character


def guess_spans(text: str, least: float = LEAST_GUESSES, lexicon: Lexicon = DEFAULT) -> list[tuple[int, int, str]]:
    """Values in credential contexts that take 10 ** least guesses or more.

    Contexts are looked for after each other's marks, so a value may be a context itself ("Authorization: Bearer ..."). After
    blanks alone a value needs a digit, as prose goes on that way too.
    """
    low = text.lower()
    if not any(k in low for k in ("pass", "pwd", "pin", "secret", "token", "bearer", "key", "auth", "credential", "login")):
        return []
    out = set()
    for m in CONTEXT.finditer(text):
        v = VALUE.match(text, m.end())
        if v is None:
            continue
        k = 1 if v[1] is not None else 2
        value = v[2].rstrip(".,)") if k == 2 else v[1]
        if len(value) < LEAST_VALUE or ((m["blank"] or m["blanks"]) and not any(c.isdigit() for c in value)):
            continue
        if guess_cost(value, lexicon)[0] >= least:
            out.add((v.start(k), v.start(k) + len(value), "guess"))
    return sorted(out)


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST_GUESSES, words: Iterable[str] | None = None) -> DataFrame:
    """Per row ``(id, base, secrets)``: spans ``(start, end, kind)`` of the fixed patterns, and of all, in order.

    ``words`` follow the fixed ones in rank; the corpus's own by default.
    """
    ranked = (*WORDS, *(corpus_words(docs, text_col) if words is None else words))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(ranked)
        for batch in batches:
            for part in slices(batch):
                base, every = [], []
                for text in part.column(1).to_pylist():
                    text = text or ""
                    b = base_spans(text)
                    g = guess_spans(text, least, lexicon)
                    base.append(b)
                    every.append(sorted(b + g, key=lambda x: (x[0], KINDS.index(x[2]), x[1])) if g else b)
                spans = [pa.array([[{"start": s, "end": e, "kind": k} for s, e, k in row] for row in rows], kind) for rows in (base, every)]
                yield pa.RecordBatch.from_arrays([part.column(0), *spans], names=[id_col, "base", "secrets"])

    span = "array<struct<start:long,end:long,kind:string>>"
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, base {span}, secrets {span}")


def redact(text: str, spans: list[tuple[int, int]], mark: str = "[secret]") -> str:
    """The text with its spans, merged where they overlap, replaced by ``mark``."""
    out, at = [], 0
    for start, end in sorted(spans):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def base_digest(spans: list[tuple[int, int, str]]) -> str:
    return hashlib.sha256(joined(spans).encode()).hexdigest()
