"""Secret scans: fixed patterns, and password guess cost for values in a credential context.

The fixed patterns find assignments, access keys and long hex runs. The method adds what they miss: a value that a key name such as ``pwd`` or
``passphrase``, an authorization header or a URL's user part puts in a credential context, if a guesser would need
``10 ** threshold`` tries or more. The cost is that of the cheapest segmentation, found by dynamic programming over the value, into

* words of any script, at their rank among the corpus' most frequent words (counted over all documents; the ``dictionary_words`` first are kept), doubled
  for capitals and for digit-for-letter spellings,
* dates, at days times years from 2000, with a factor for separators,
* repeats, at the cost of the repeated part times the number of its repeats,
* keyboard walks and runs of neighbouring letters or digits, at starts times turns,
* brute-force spans, at as many tries a character as the value's classes of characters have (10 digits, 26 small or capital letters, 33 marks, 100 others),

each further segment doubling the cost. Values that are ordinary words are cheap and stay out.

Defined cases: null and empty texts have no spans. Positions are code points, ends exclusive. A value that overlaps a pattern span is not added.
Repeated rows are scanned each for itself; rows without an id too. An empty table gives an empty table, and an empty dictionary.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import most_frequent, small_batches, stored, text_of

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
CONTEXT = re.compile(
    r"""(?<![A-Za-z])(?:pass(?:word|wd|phrase|code)?|pwd|pw|secret|token|credentials?|(?:api|access|private|secret|auth)[_-]?key|client[_-]?secret|auth|bearer)["']?[ \t]*(?:=>|:=|[:=]|\bis\b)[ \t]*["']?([^\s"'<>]+)"""
    r"""|\bauthorization:[ \t]*(?:bearer|basic)[ \t]+([^\s"'<>]+)|://[^\s:/@]+:([^\s/@]+)@""", re.I | re.A)
_KEYS = ("pass", "pwd", "pw", "secret", "token", "api", "key", "auth", "bearer", "credential", "://")
_HEX_MARK = bytes(104 if chr(b) in "0123456789abcdef" else 32 for b in range(256))
_ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")
_SPOKEN = str.maketrans("4310@$57!", "aeloassti")
_DATES = (
    re.compile(r"(?P<y>(?:19|20)\d\d)(?P<s>[-/._]?)(?:0?[1-9]|1[0-2])(?P=s)(?:0?[1-9]|[12]\d|3[01])"),
    re.compile(r"(?:0?[1-9]|[12]\d|3[01])(?P<s>[-/._]?)(?:0?[1-9]|1[0-2])(?P=s)(?P<y>(?:19|20)\d\d|\d\d)"),
)
_YEAR = re.compile(r"(?:19|20)\d\d")
BRUTE, NEXT, LONGEST_WORD = 1.0, math.log10(2), 24


def _near() -> dict[str, set[str]]:
    """Keys beside each other: in a row, or one row apart."""
    at = {c: (r, i + r * 0.5) for r, row in enumerate(_ROWS) for i, c in enumerate(row)}
    return {a: {b for b in at if a != b and abs(at[a][0] - at[b][0]) <= 1 and abs(at[a][1] - at[b][1]) <= 1} for a in at}


NEAR = _near()


def _walks(low: str) -> list[tuple[int, int, float]]:
    """(start, end, cost) of keyboard walks and of runs of consecutive characters, three long or more."""
    out, n = [], len(low)
    for steps, starts, ways in ((lambda a, b: b in NEAR.get(a, ()), 36, 4.6), (lambda a, b: a.isalnum() and b.isalnum() and abs(ord(a) - ord(b)) == 1, 36, 2.0)):
        i = 0
        while i < n - 2:
            j = i
            while j + 1 < n and steps(low[j], low[j + 1]):
                j += 1
            if j - i >= 2:
                turns = 1 + sum(ord(low[k + 1]) - ord(low[k]) != ord(low[k]) - ord(low[k - 1]) for k in range(i + 1, j)) if ways == 2.0 else 1 + sum(
                    (low[k + 1] in _row(low[k])) != (low[k] in _row(low[k - 1])) for k in range(i + 1, j))
                out.append((i, j + 1, math.log10(starts * (j - i)) + turns * math.log10(ways)))
            i = max(j, i + 1)
    return out


def _row(c: str) -> str:
    return next((r for r in _ROWS if c in r), "")


def _repeats(low: str, ranks: dict[str, int], each: float = BRUTE) -> list[tuple[int, int, float]]:
    """(start, end, cost) of parts of one to eight characters that follow themselves."""
    out, n = [], len(low)
    for width in range(1, min(8, n // 2) + 1):
        i = 0
        while i + 2 * width <= n:
            same = 0
            while i + same + width < n and low[i + same] == low[i + same + width]:
                same += 1
            count = same // width + 1
            if count >= 2 and count * width >= 3:
                part = low[i:i + width]
                out.append((i, i + count * width, min(width * each, math.log10(1 + ranks[part]) if part in ranks else 99.0) + math.log10(count)))
            i += max(1, same - width + 1)
    return out


def character_cost(value: str) -> float:
    """log10 of the number of characters in the classes that the value has."""
    classes = (("0", "9", 10), ("a", "z", 26), ("A", "Z", 26))
    plain = [sum(lo <= c <= hi for c in value) for lo, hi, _ in classes]
    high = sum(c > "~" for c in value)
    size = sum(n for (_, _, n), found in zip(classes, plain) if found) + (33 if sum(plain) + high < len(value) else 0) + (100 if high else 0)
    return max(BRUTE, math.log10(max(1, size)))


def guess_cost(value: str, ranks: dict[str, int], each: float = BRUTE) -> float:
    """log10 of the guesses that the cheapest segmentation needs, a brute-force character at ``each``."""
    low, n = value.lower(), len(value)
    if len(low) != n:
        low = value
    spoken = low.translate(_SPOKEN)
    ends: dict[int, list[tuple[int, float]]] = {}
    for a, b, cost in _walks(low) + _repeats(low, ranks, each):
        ends.setdefault(b, []).append((a, cost))
    for a in range(n):
        if not low[a].isdigit():
            continue
        years = lambda y: math.log10(max(20, abs(int(y) - 2000)) if len(y) == 4 else 100)
        if m := _YEAR.match(low, a):
            ends.setdefault(m.end(), []).append((a, years(m[0])))
        for m in filter(None, (p.match(low, a) for p in _DATES)):
            ends.setdefault(m.end(), []).append((a, years(m["y"]) + math.log10(365) + (math.log10(4) if m["s"] else 0)))
    best, brute = [0.0] + [math.inf] * n, [math.inf] * (n + 1)
    for b in range(1, n + 1):
        start = lambda a: best[a] + (NEXT if a else 0.0)
        brute[b] = min(brute[b - 1], start(b - 1)) + each
        found = [start(a) + cost for a, cost in ends.get(b, ())]
        for a in range(max(0, b - LONGEST_WORD), b - 2):
            plain = low[a:b]
            rank, twist = ranks.get(plain), 0.0
            if rank is None and (rank := ranks.get(spoken[a:b])) is not None:
                twist = NEXT
            if rank is not None:
                found.append(start(a) + math.log10(1 + rank) + twist + (NEXT if value[a:b] != plain else 0.0))
        best[b] = min([brute[b], *found])
    return best[n]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns."""
    out = []
    low = text.lower()
    if ("=" in text or ":" in text) and any(k in low for k in ("passw", "secret", "token", "api")):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if b"h" * 32 in text.encode("utf-8", "surrogatepass").translate(_HEX_MARK):
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def merged_spans(spans: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the union of spans sorted by start."""
    starts, ends = [], []
    for a, _, b in spans:
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def costly_values(text: str, taken: list[tuple[int, int, int]], ranks: dict[str, int], threshold: float) -> list[tuple[int, int, int]]:
    low = text.lower()
    if not any(k in low for k in _KEYS):
        return []
    out = []
    starts, ends = merged_spans(taken)
    for m in CONTEXT.finditer(text):
        a, b = m.span(m.lastindex)
        while b > a and text[b - 1] in ".,;:!?)]}":
            b -= 1
        # The first taken stretch that ends behind the value's start is the only one that can reach into it first.
        at = bisect_right(ends, a)
        if b - a >= 6 and not (at < len(ends) and starts[at] < b) and guess_cost(text[a:b], ranks, character_cost(text[a:b])) >= threshold:
            out.append((a, 3, b))
    return out


def scan(text: str, ranks: dict[str, int], threshold: float = 10.0) -> dict:
    base = base_spans(text)
    spans = sorted(base + costly_values(text, base, ranks, threshold))
    join = lambda rows: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in rows)
    counts = [sum(k == want for _, k, _ in base) for want in range(3)]
    return {"n_assign": counts[0], "n_access": counts[1], "n_hex": counts[2], "base_sha256": hashlib.sha256(join(base).encode()).hexdigest(), "spans": join(spans), "n_guess": len(spans) - len(base)}


def word_ranks(docs: DataFrame, text: str = "text", words: int = 20_000) -> dict[str, int]:
    """Ranks, from 1, of the most frequent words of three to 24 letters of any script, counted over all texts. At most ``words`` rows come to the driver."""
    each = docs.select(F.explode(F.split(F.lower(text_of(text)), r"[^\p{L}]+")).alias("word")).where(f"length(word) between 3 and {LONGEST_WORD}")
    top = most_frequent(stored(each.groupBy("word").agg(F.count(F.lit(1)).alias("n")), "word-counts"), words)
    return {row["word"]: i for i, row in enumerate(top, 1)}


RESULT = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long"


def secret_spans(docs: DataFrame, text: str = "text", name: str = "secrets", threshold: float = 10.0, dictionary_words: int = 20_000) -> DataFrame:
    """``docs`` with a struct of counts and spans in ``name``, which must be free."""
    small_batches(docs.sparkSession)
    ranks = word_ranks(docs, text, dictionary_words)

    @F.pandas_udf(RESULT)
    def found(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([scan(t or "", ranks, threshold) for t in texts], columns=[c.split()[0] for c in RESULT.split(", ")])

    return docs.withColumn(name, found(text_of(text)))


def secrets_query(docs: DataFrame) -> DataFrame:
    return secret_spans(docs.select("doc_id", "text")).select("doc_id", "secrets.*")
