"""Secret scans: fixed patterns, and password guess costs in credential contexts.

Three fixed patterns give the base spans (assign, access, hex).  Beyond them,
the value that follows an identifier with a credential word in it is cut, by dynamic programming, into
the segments that are cheapest to guess: ranked words, dates, repeats, keyboard
walks and brute-force spans.  The cost is the least over all segmentations.  A
value that stays expensive is a span of kind ``guess``, unless a base span
already touches it.

Words rank by how early they are tried: the fixed common parts of passwords,
then the corpus's own words by how many of its documents hold them
(:func:`ranked_words`).  Every character costs 1 at most, so values shorter than
``least`` can't reach it.  After "is" a value counts only with characters of two
classes or in quotes, as prose follows there too.

Defined cases: a null or empty text has no spans; a value of any length is read
whole; rows that repeat an id or a text give a row each; an empty table gives an
empty result and no ranked words; of segmentations that cost the same any
serves, as only the cost counts; only the id and the text are read, so other
columns may have any names.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import partial
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import map_rows, stage

KINDS = ("assign", "access", "hex", "guess")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")

#: An identifier, dotted or hyphened too, and the sign that gives it a value; read once from its first character.
_NAMED = re.compile(r"""(?<![A-Za-z0-9_])(?<![A-Za-z0-9_][.-])([A-Za-z0-9_]++(?:[.-][A-Za-z0-9_]++)*+(?:(?:(?<=api)|(?<=access)|(?<=private)|(?<=secret))\x20key\b)?)["']?[ \t]*([:=]>?|->|\bis\b)[ \t]*""", re.IGNORECASE | re.ASCII)
_VALUE = re.compile(r""""([^"\n]+)"|'([^'\n]+)'|([^\s"'<>,;]+)""")
#: A word within an identifier ends before what is no letter and where the case changes; the shorter words begin so, too.
_ENDS = r"(?-i:(?![A-Za-z])|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z]))"
_BEGINS = r"(?-i:(?<![A-Za-z])|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z]))"
_LONG_WORDS = r"(?:pass(?:word|wd|phrase|code)|pwd|secret|token|(?:api|access|private|secret)[ _-]?key|credential)s?"
_CREDENTIAL = re.compile(rf"(?:{_LONG_WORDS}|{_BEGINS}(?:pass|auth(?:orization)?|bearer|login)){_ENDS}", re.IGNORECASE | re.ASCII)
#: What a text must hold for a pattern to find anything in it.
_ASSIGNED = ("password", "passwd", "secret", "token", "apikey", "api_key")
_HINTS = ("pass", "pwd", "secret", "token", "key", "auth", "bearer", "credential", "login")
_RUN_OF_HEX = b"f" * 24
_HEX_BYTES = bytes(ord("f") if b in b"0123456789abcdef" else ord(" ") for b in range(256))
_CLASSES = tuple(map(re.compile, (r"[a-z]", r"[A-Z]", r"[0-9]", r"[^A-Za-z0-9]")))

#: Common parts of passwords, by how early they are tried.
COMMON = (
    "password pass admin welcome letmein secret login master dragon monkey shadow sunshine princess football baseball superman batman trustno "
    "iloveyou hello charlie michael jordan daniel jessica ashley thomas hunter ranger soccer hockey killer george andrew summer winter spring "
    "autumn monday friday january march april june july august october november december love test demo user guest root system default changeme "
    "company office server database service access account private public token key example none null true false the and you that this with"
).split()
#: Rows of a keyboard, each shifted by half a key against the one above, and the alphabet.
KEY_ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")
ALPHABET = "abcdefghijklmnopqrstuvwxyz"


def _neighbours() -> set[tuple[str, str]]:
    """Keys that touch, along rows and across them, in both directions, and letters that follow each other."""
    pairs = {(a, b) for row in (*KEY_ROWS, ALPHABET) for a, b in zip(row, row[1:], strict=False)}
    for upper, lower in zip(KEY_ROWS, KEY_ROWS[1:], strict=False):
        for k, key in enumerate(lower):
            pairs |= {(key, other) for other in upper[k : k + 2]}
    return pairs | {(b, a) for a, b in pairs}


_NEXT = _neighbours()
_DATE = re.compile(r"(?:19|20)\d\d[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)\d\d", re.ASCII)
_YEAR = re.compile(r"(?:19|20)\d\d", re.ASCII)
_LEET = str.maketrans("4310$5@7!", "aeiossati")
#: Prices (common logarithms of guesses): a character, a date, a year, the start of a walk and of a repeat, letters changed by case or sign.
CHARACTER, DATE, YEAR, WALK, REPEAT, CHANGED = 1.0, 4.3, 2.3, 2.0, 1.0, 1.0


class Words:
    """Ranks of the words that are tried, the earliest 1."""

    def __init__(self, ranked: Iterable[str]):
        self.rank: dict[str, int] = {}
        for word in ranked:
            if len(word) >= 3:
                self.rank.setdefault(word.lower(), len(self.rank) + 1)
        self.longest = max(map(len, self.rank), default=0)

    def price(self, value: str, plain: str) -> float | None:
        """The price of ``value``, whose letters are ``plain``; None for what is no word."""
        rank = self.rank.get(plain)
        return None if rank is None else math.log10(rank + 1) + (0.0 if value == plain else CHANGED)


KNOWN = Words(COMMON)


class _Run:
    """The cheapest start of a segment in the run that reaches the current place.

    A segment from ``start`` costs what is best before it and the logarithm of
    its length.  Once an earlier start is as cheap as a later one it stays so,
    as lengths grow alike; so only starts that are cheaper than all earlier ones
    are kept, and mostly there are one or two.
    """

    def __init__(self, price: float):
        self.price, self.began, self.starts = price, 0, []

    def cost(self, end: int, goes_on: bool, best: list[float]) -> float:
        if not goes_on:
            self.began, self.starts = end - 1, []
        if end - self.began < 3:
            return math.inf
        least, kept = math.inf, []
        for start in (*self.starts, end - 3):
            own = best[start] + math.log10(end - start)
            if own < least:
                least = own
                kept.append(start)
        self.starts = kept
        return least + self.price


def guess_cost(value: str, words: Words = KNOWN) -> float:
    """The common logarithm of the guesses that find ``value`` by its cheapest segmentation."""
    n, low = len(value), value.lower()
    if len(low) != n:
        low = "".join(c if len(c.lower()) != 1 else c.lower() for c in value)
    plain = low.translate(_LEET)
    dated: dict[int, list[tuple[int, float]]] = {}
    for k in range(n):
        if value[k] in "0123":
            for pattern, price in ((_DATE, DATE), (_YEAR, YEAR)):
                if m := pattern.match(value, k):
                    dated.setdefault(m.end(), []).append((k, price))
    best = [0.0]
    walk, repeat = _Run(WALK), _Run(REPEAT)
    for end in range(1, n + 1):
        at = end - 1
        cost = best[at] + CHARACTER
        cost = min(cost, walk.cost(end, at > 0 and (low[at - 1], low[at]) in _NEXT, best))
        cost = min(cost, repeat.cost(end, at > 0 and value[at] == value[at - 1], best))
        for start, price in dated.get(end, ()):
            cost = min(cost, best[start] + price)
        for size in range(3, min(words.longest, end) + 1):
            price = words.price(value[end - size : end], plain[end - size : end])
            if price is not None:
                cost = min(cost, best[end - size] + price)
        best.append(cost)
    return best[n]


def ranked_words(docs: DataFrame, text_col: str = "text", most: int = 10_000) -> list[str]:
    """The ``most`` words that stand in the most documents, after the fixed common ones.

    A word is 4 to 16 letters between blanks or sentence marks, in lower case
    but for its first letter, so parts of keys and quoted values are none.  All
    documents are counted, by partial aggregates; ``most`` bounds what reaches
    the driver and the workers.
    """
    word = r"(?<![^\s(])[A-Za-z][a-z]{3,15}(?![^\s,.;:!?)])"
    own = F.array_distinct(F.regexp_extract_all(F.col(text_col), F.lit(word), F.lit(0)))
    counted = docs.select(F.explode(F.transform(own, F.lower)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    # Written, so that the partitions' words meet on an executor and only the ranked ones reach the driver.
    ranked = stage(docs.sparkSession, counted.orderBy(F.desc("n"), "word").limit(most), "secrets-words")
    return COMMON + [r["word"] for r in sorted(ranked.collect(), key=lambda r: (-r["n"], r["word"]))]


def values(text: str) -> Iterator[tuple[re.Match[str], bool]]:
    """What follows each identifier with a credential word in it (``DB_PASSWORD``, ``clientSecret``, ``api key``), and whether "is" stands between."""
    named = _NAMED.search(text)
    while named:
        end = named.end(1)
        word = _CREDENTIAL.search(named[1])
        value = _VALUE.match(text, named.end()) if word else None
        # What follows a host name at once is a port.
        port = value and value[3] and named[2] == ":" and value.start() == named.end(2) and "." in named[1][word.end() :]
        if value and not port:
            yield value, named[2].lower() == "is"
            end = value.end()
        named = _NAMED.search(text, end)


def find(text: str, least: float = 10.0, words: Words = KNOWN) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans and all spans of a text, each (kind, start, end), by start and kind."""
    low = text.lower()
    base = []
    if any(word in low for word in _ASSIGNED):
        base += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        base += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if _RUN_OF_HEX in text.encode("utf-8", "surrogatepass").translate(_HEX_BYTES):
        base += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    more = []
    if any(word in low for word in _HINTS):
        # Where base spans begin, and the furthest end up to each.
        starts = sorted((a, b) for _, a, b in base)
        reached = list(accumulate((b for _, b in starts), max))
        for m, said in values(text):
            k = next(g for g in (1, 2, 3) if m[g] is not None)
            value, start, end = m[k], m.start(k), m.end(k)
            if k == 3:
                value = value.rstrip(".)]}:!?")
                end = start + len(value)
            before = bisect_left(starts, (end, 0))
            if len(value) * CHARACTER < least or (before and reached[before - 1] > start):
                continue
            plain = said and k == 3 and sum(bool(p.search(value)) for p in _CLASSES) < 2
            if not plain and guess_cost(value, words) >= least:
                more.append(("guess", start, end))

    def order(span: tuple[str, int, int]) -> tuple[int, int]:
        return span[1], KINDS.index(span[0])

    return sorted(base, key=order), sorted(base + more, key=order)


def _row(text: str, words: Words = KNOWN) -> tuple:
    base, spans = find(text, words=words)
    joined = [",".join(f"{kind}:{a}:{b}" for kind, a, b in some) for some in (base, spans)]
    counts = [sum(kind == want for kind, _, _ in base) for want in KINDS[:3]]
    return (*counts, hashlib.sha256(joined[0].encode()).hexdigest(), joined[1], len(spans) - len(base))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: Iterable[str] = COMMON) -> DataFrame:
    """The id with n_assign, n_access, n_hex, base_sha256, spans and n_guess; ``words`` are the ranked ones."""
    row = partial(_row, words=Words(words))
    return map_rows(docs, id_col, text_col, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long", row)
