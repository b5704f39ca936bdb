"""Personal data: fixed patterns over the text and over a normalised form of it.

Transducers undo disguises (look-alike characters, spelled digits, "at" and
"dot" in words or brackets) and record where every piece of the normalised
text came from; identifiers found there are mapped back to source characters
and added to those that stand plainly in the text.  Every scan starts from a
literal (an "@", a bracket, a word) and walks outwards over what earlier sites
left free, so time grows with the length of the text whatever fills it.

Bounds of what is undone: digits and "at" and "dot" in English words; look-alike
letters of the tables below (Cyrillic and Greek), full-width forms, and decimal
digits of all scripts.

Defined cases: a null or empty text has no spans; a text of any length is read
whole; rows that repeat an id or a text give a row each; an empty table gives an
empty result; only the id and the text are read, so other columns may have any
names; base spans are always kept, and an added span never overlaps a base span
of its kind, nor one added before it (the one that starts first stays).
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame

from lattica.llm.common import map_rows

KINDS = ("email", "ip", "card", "phone")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_SOME_IP = re.compile(r"[0-9]\.[0-9]+\.[0-9]")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from each "@" outwards so that no long run is read twice."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
        free = m.end() if m else at + 1
        at = text.find("@", free)
    return out


def plain(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every identifier that stands in ``text`` as it is."""
    out = [("email", a, b) for a, b in emails(text)]
    for m in _IP.finditer(text) if _SOME_IP.search(text) else ():
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in m.groups()):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _NOT_DIGIT.sub("", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


#: Letters of other scripts that look like Latin ones.
LOOKALIKES = dict(zip("аеорсухіјѕԁһӏԛԝАВЕКМНОРСТХІЈЅαορνιΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijsdhlqwABEKMHOPCTXIJSaopviABEZHIKMNOPTYX", strict=True))
#: Marks that stand for the plain ones of identifiers, and marks that are not seen.
MARKS = {
    **dict.fromkeys("．。․‧·", "."),
    **dict.fromkeys("＠﹫", "@"),
    **dict.fromkeys("‐‑‒–−﹣", "-"),
    **dict.fromkeys("   ", " "),
    "＋": "+",
}
UNSEEN = "​‌‍⁠﻿­"
#: English digit words.
DIGITS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}


def _glyph_table() -> dict[str, str]:
    table = LOOKALIKES | MARKS | dict.fromkeys(UNSEEN, "")
    table |= {chr(0xFEE0 + b): chr(b) for b in range(0x21, 0x7F) if chr(0xFEE0 + b) not in table}
    for code in range(0x80, 0x20000):
        ch = chr(code)
        if unicodedata.category(ch) == "Nd":
            table[ch] = str(unicodedata.decimal(ch))
    return table


_GLYPHS = _glyph_table()
_GLYPH = re.compile("[" + "".join(map(re.escape, _GLYPHS)) + "]")
_BRACKETED = re.compile(r"[\[({<]\s*(at|dot)\s*[\])}>]", re.IGNORECASE)
#: An "at" in words and the domain after it; the blanks before it are walked by hand.
_SPELLED_AT = re.compile(r"[aA][tT]\s+([A-Za-z0-9-]++(?:(?:\s++[dD][oO][tT]\s++|\.)[A-Za-z0-9-]++)++)")
#: Last labels of domains, those of countries first, that an address in words may end in.
TOP_LABELS = frozenset(
    (
        "ac ad ae af ag ai al am ao aq ar as at au aw ax az ba bb bd be bf bg bh bi bj bm bn bo br bs bt bv bw by bz ca cc cd cf cg ch ci ck cl cm cn co cr cu cv cw cx cy cz de dj dk dm do dz "
        "ec ee eg er es et eu fi fj fk fm fo fr ga gb gd ge gf gg gh gi gl gm gn gp gq gr gs gt gu gw gy hk hm hn hr ht hu id ie il im in io iq ir is it je jm jo jp ke kg kh ki km kn kp kr kw ky kz "
        "la lb lc li lk lr ls lt lu lv ly ma mc md me mg mh mk ml mm mn mo mp mq mr ms mt mu mv mw mx my mz na nc ne nf ng ni nl no np nr nu nz om pa pe pf pg ph pk pl pm pn pr ps pt pw py qa "
        "re ro rs ru rw sa sb sc sd se sg sh si sj sk sl sm sn so sr ss st su sv sx sy sz tc td tf tg th tj tk tl tm tn to tr tt tv tw tz ua ug uk us uy uz va vc ve vg vi vn vu wf ws ye yt za zm zw "
        "com org net edu gov mil int info biz name pro aero asia cat coop jobs mobi museum post tel travel arpa example test invalid local localhost "
        "academy agency app art bank berlin blog business cafe care center chat church city click cloud club codes community company consulting cool design dev digital direct email energy engineering expert family farm finance "
        "foundation fun fund games global group guru health help host house institute international law legal life link live london love ltd market marketing media money network news one online page paris partners photo photography "
        "plus press pub school science services shop site social software solutions space store studio support systems team tech technology tips today tools top training university ventures video vip wiki work works world xyz zone"
    ).split()
)
_CLOCK = re.compile(r"[0-9]+\.(?:am|pm)", re.IGNORECASE)
_DOT = re.compile(r"(?<!\s)\s++dot\s++", re.IGNORECASE)
_DIGIT_WORD = "|".join(DIGITS)
_SPELLED = re.compile(rf"\b(?:plus[\s-]++)?(?:{_DIGIT_WORD}|[0-9]++)(?:[\s,-]++(?:{_DIGIT_WORD}|[0-9]++)){{3,}}\b", re.IGNORECASE)
_SPELLED_PART = re.compile(rf"(plus)[\s-]+|({_DIGIT_WORD})\b[\s,-]*", re.IGNORECASE)
_WORD_OF_DIGITS = re.compile(rf"\b(?:{_DIGIT_WORD})\b[\s,-]++(?:{_DIGIT_WORD})\b", re.IGNORECASE)


class Normalised:
    """A text after rewrites, with the source place of every piece."""

    def __init__(self, text: str, origin: list[tuple[int, int, int, int]] | None = None):
        self.text = text
        self.pieces = origin if origin is not None else [(0, len(text), 0, len(text))]

    def rewrite(self, sites: list[tuple[int, int, str]]) -> Normalised:
        """Replace each (start, end, by) of the sorted, separate ``sites``."""
        out, pieces, at, size = [], [], 0, 0

        def copy(a: int, b: int) -> None:
            nonlocal size
            while a < b:
                lo, hi, src, src_end = self.piece(a)
                stop = min(b, hi)
                straight = hi - lo == src_end - src
                pieces.append((size, size + stop - a, src + (a - lo) if straight else src, src + (stop - lo) if straight else src_end))
                out.append(self.text[a:stop])
                size += stop - a
                a = stop

        for start, end, by in sites:
            copy(at, start)
            if by:
                pieces.append((size, size + len(by), self.source(start)[0], self.source(end - 1)[1]))
                out.append(by)
                size += len(by)
            at = end
        copy(at, len(self.text))
        return Normalised("".join(out), pieces)

    def piece(self, at: int) -> tuple[int, int, int, int]:
        return self.pieces[bisect_right(self.pieces, at, key=lambda p: p[0]) - 1]

    def source(self, at: int) -> tuple[int, int]:
        """Source bounds of one character."""
        lo, hi, src, end = self.piece(at)
        return (src + at - lo, src + at - lo + 1) if hi - lo == end - src else (src, end)


def bracketed(text: str) -> list[tuple[int, int, str]]:
    """The "at" and "dot" in brackets, with the blanks around them, found from each bracket outwards."""
    sites, free = [], 0
    for m in _BRACKETED.finditer(text):
        start, end = m.span()
        while start > free and text[start - 1].isspace():
            start -= 1
        while end < len(text) and text[end].isspace():
            end += 1
        sites.append((start, end, "@" if m[1].lower() == "at" else "."))
        free = end
    return sites


def spelled_mails(text: str) -> list[tuple[int, int, str]]:
    """The "at" and "dot" of addresses in words, found from each "at" outwards."""
    sites, free = [], 0
    for m in _SPELLED_AT.finditer(text):
        at = m.start()
        while at > free and text[at - 1].isspace():
            at -= 1
        if at == m.start() or at == free or text[at - 1] not in _LOCAL or re.split(r"[\s.]", m[1])[-1].lower() not in TOP_LABELS or _CLOCK.fullmatch(m[1]):
            continue
        dots, start = [], at
        while True:
            while start > free and text[start - 1] in _LOCAL:
                start -= 1
            gap = start
            while gap > free and text[gap - 1].isspace():
                gap -= 1
            before = gap - 3
            # A dot in words stands between blanks, with a name before it.
            if not (gap < start < at and before > free and text[before:gap].lower() == "dot" and text[before - 1].isspace()):
                break
            name = before
            while name > free and text[name - 1].isspace():
                name -= 1
            if name == free or text[name - 1] not in _LOCAL:
                break
            dots.append((name, start, "."))
            start = name
        if start < at:
            sites += [*dots[::-1], (at, m.start(1), "@")]
            sites += [(m.start(1) + x.start(), m.start(1) + x.end(), ".") for x in _DOT.finditer(m[1])]
            free = m.end()
    return sites


def spelled_digits(text: str) -> list[tuple[int, int, str]]:
    """The digits and the plus of numbers in words, four or more in a row."""
    sites = []
    for m in _SPELLED.finditer(text):
        for x in _SPELLED_PART.finditer(m[0]):
            end = x.end() if m.start() + x.end() < m.end() else len(m[0])
            sites.append((m.start() + x.start(), m.start() + end, "+" if x[1] else DIGITS[x[2].lower()]))
    return sites


def normalise(text: str) -> Normalised | None:
    """The text without disguises; None where there is none."""
    out = Normalised(text)
    if not text.isascii() and not _GLYPHS.keys().isdisjoint(set(text)):
        out = out.rewrite([(m.start(), m.end(), _GLYPHS[m[0]]) for m in _GLYPH.finditer(out.text)])
    sites = bracketed(out.text)
    if sites:
        out = out.rewrite(sites)
    sites = spelled_mails(out.text)
    if sites:
        out = out.rewrite(sites)
    # A digit word with another beside it stands between separators.
    if not DIGITS.keys().isdisjoint(out.text.lower().replace(",", " ").replace("-", " ").split()) and _WORD_OF_DIGITS.search(out.text):
        sites = spelled_digits(out.text)
        if sites:
            out = out.rewrite(sites)
    return None if out.text is text else out


def find(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans and all spans of a text, by kind and start."""
    base = plain(text)
    spans = list(base)
    form = normalise(text)
    if form:
        taken = {kind: sorted((a, b) for k, a, b in base if k == kind) for kind in KINDS}
        reached = dict.fromkeys(KINDS, 0)
        for kind, a, b in plain(form.text):
            start, end = form.source(a)[0], form.source(b - 1)[1]
            # Base spans of a kind don't overlap, so only the last that begins before the end can touch; added ones come in order.
            near = bisect_left(taken[kind], (end, 0)) - 1
            if start >= reached[kind] and not (near >= 0 and taken[kind][near][1] > start):
                spans.append((kind, start, end))
                reached[kind] = end

    def order(span: tuple[str, int, int]) -> tuple[int, int]:
        return KINDS.index(span[0]), span[1]

    return sorted(base, key=order), sorted(spans, key=order)


def _row(text: str) -> tuple:
    base, spans = find(text)
    joined = [",".join(f"{kind}:{a}:{b}" for kind, a, b in some) for some in (base, spans)]
    counts = [sum(kind == want for kind, _, _ in base) for want in KINDS]
    return (*counts, hashlib.sha256(joined[0].encode()).hexdigest(), joined[1], len(spans) - len(base))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id with n_email, n_ip, n_card, n_phone, base_sha256, spans and n_added."""
    return map_rows(docs, id_col, text_col, "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long", _row)
