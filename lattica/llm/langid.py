"""Language identification by hierarchical discrimination.

First the language family is predicted by one-versus-rest linear support
vector machines, then one-versus-one machines vote between the languages of
that family.  Features are hashed counts of character 1-, 2- and 3-grams of the
whole lower-cased text, square-rooted and scaled to length one.

Families are a fixed table of related languages; a learned language that the
table lacks is a family of its own.  The machines learn from a bounded sample:
about ``rows`` documents of each language, chosen by the hash of their id, each
with a few short excerpts of it so that short texts are covered too.

Defined cases: a null or empty text, or one without a letter, is ``und`` with
score 0; with one learned language every other text is that language; with
none, all texts are ``und``; equal margins and votes go to the family, and
within it to the language, that comes first by name; rows that repeat an id or
a text are predicted each, and learned once for each id and language; a text of
any length is read whole; an empty table gives an empty result; columns beside
the named ones may have any names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.common import map_text, slices

#: Families of related languages.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"),
    "romance": ("fr", "es", "pt", "it", "ca", "gl", "ro", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
    "indic": ("hi", "mr", "ne", "bn", "pa", "gu", "ur"),
    "sinitic": ("zh", "yue", "wuu"),
}
_FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs}
DIMS = 4096
_LETTER = re.compile(r"[^\W\d_]")
_fold: list[np.ndarray] = []


def _folded() -> np.ndarray:
    """Lower case of the code points below 0x3000; what is no letter becomes a space."""
    if not _fold:
        table = np.arange(0x3000, dtype=np.uint32)
        for code in range(0x3000):
            ch = chr(code)
            low = ch.lower()
            table[code] = (ord(low) if len(low) == 1 else code) if ch.isalpha() else 0x20
        _fold.append(table)
    return _fold[0]


def features(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of hashed n-gram weights for each text."""
    n = len(offsets) - 1
    if not len(raw):
        return np.zeros((n, DIMS), dtype=np.float32)
    lead = np.flatnonzero((raw & 0xC0) != 0x80)
    codes = np.frombuffer(raw.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    owner = np.repeat(np.arange(n), np.diff(np.searchsorted(lead, offsets)))
    table = _folded()
    codes = np.where(codes < len(table), table[np.minimum(codes, len(table) - 1)], codes)
    row = owner * DIMS
    counts = np.bincount(row + ((codes * np.uint32(0x9E3779B1)) >> np.uint32(23)).astype(np.int64), minlength=n * DIMS)
    both = codes[:-1] * np.uint32(0x85EBCA6B) + codes[1:]
    at = np.flatnonzero(owner[:-1] == owner[1:])
    counts += np.bincount(row[at] + 512 + (((both[at] * np.uint32(0xC2B2AE35)) >> np.uint32(16)).astype(np.int64) * 1536 >> 16), minlength=n * DIMS)
    three = both[:-1] * np.uint32(0x85EBCA6B) + codes[2:]
    at = np.flatnonzero(owner[:-2] == owner[2:])
    counts += np.bincount(row[at] + 2048 + ((three[at] * np.uint32(0x27D4EB2F)) >> np.uint32(21)).astype(np.int64), minlength=n * DIMS)
    out = np.sqrt(counts.reshape(n, DIMS)).astype(np.float32)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def svm(x: np.ndarray, y: np.ndarray, cost: float = 1.0, epochs: int = 12, seed: int = 0) -> np.ndarray:
    """Weights of a linear support vector machine (labels 1 and -1), by dual coordinate descent."""
    alpha, w = np.zeros(len(y)), np.zeros(x.shape[1], dtype=np.float32)
    diagonal = np.einsum("ij,ij->i", x, x)
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in order.permutation(len(y)):
            if diagonal[k] > 0:
                slope = y[k] * float(x[k] @ w) - 1.0
                new = min(max(alpha[k] - slope / diagonal[k], 0.0), cost)
                if new != alpha[k]:
                    w += np.float32((new - alpha[k]) * y[k]) * x[k]
                    alpha[k] = new
    return w


class Model:
    """Family machines and, within each family, a machine for each pair of languages."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        self.langs = sorted(set(langs))
        self.family_of = [_FAMILY.get(lang, f"={lang}") for lang in self.langs]
        self.families = sorted(set(self.family_of))
        y = np.array([self.langs.index(lang) for lang in langs])
        families = np.array([self.families.index(f) for f in self.family_of])
        self.family_w = np.stack([svm(x, np.where(families[y] == f, 1.0, -1.0)) for f in range(len(self.families))], axis=1) if len(self.families) > 1 else None
        self.members = [[k for k, f in enumerate(families) if f == g] for g in range(len(self.families))]
        self.pair_w: dict[tuple[int, int], np.ndarray] = {}
        for members in self.members:
            for i, a in enumerate(members):
                for b in members[i + 1 :]:
                    own = np.isin(y, (a, b))
                    self.pair_w[a, b] = svm(x[own], np.where(y[own] == a, 1.0, -1.0))

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The language's index and a score from 0 to 1 for each row."""
        n = len(x)
        family, score = np.zeros(n, dtype=np.int64), np.ones(n)
        if self.family_w is not None:
            margins = np.exp(4.0 * (x @ self.family_w))
            family = margins.argmax(axis=1)
            score = margins.max(axis=1) / margins.sum(axis=1)
        lang = np.zeros(n, dtype=np.int64)
        for g, members in enumerate(self.members):
            rows = np.flatnonzero(family == g)
            if not len(rows):
                continue
            votes, trust = np.zeros((len(rows), len(self.langs))), np.zeros((len(rows), len(self.langs)))
            for a, b in ((a, b) for i, a in enumerate(members) for b in members[i + 1 :]):
                sure = 1 / (1 + np.exp(-4.0 * (x[rows] @ self.pair_w[a, b])))
                votes[:, a] += sure >= 0.5
                votes[:, b] += sure < 0.5
                trust[:, a] += sure
                trust[:, b] += 1 - sure
            best = np.array(members)[(votes + trust / (2 * len(self.langs)))[:, members].argmax(axis=1)]
            lang[rows] = best
            score[rows] *= trust[np.arange(len(rows)), best] / max(len(members) - 1, 1) if len(members) > 1 else 1.0
        return lang, np.clip(score, 0.0, 1.0)


def held_out(id_col: str, parts: int, part: int) -> Column:
    """Rows whose crc32 of the id as text leaves ``part``; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == part, F.lit(False))


def train(docs: DataFrame, rows: int = 300, languages: int = 64, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", excerpts: tuple[int, ...] = (400, 100, 30, 12)) -> Model | None:
    """A model from about ``rows`` documents, at most twice as many, of each language that are not held out.

    ``languages`` bounds how many are learned, the most frequent first (ties by
    name); counts are over all rows.  Ids are drawn, each with one of its texts,
    so a repeated id counts once.
    """
    known = docs.select(F.col(id_col).alias("own_id"), F.col(text_col).alias("own_text"), F.col(lang_col).cast("string").alias("own_lang"))
    known = known.where(F.col("own_lang").isNotNull() & F.col("own_text").isNotNull() & ~held_out("own_id", 4, 2))
    counted = known.groupBy("own_lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "own_lang").limit(languages)
    counts = {r["own_lang"]: r["n"] for r in counted.collect()}
    if not counts:
        return None
    share = F.coalesce(*[F.when(F.col("own_lang") == lang, F.lit(min(1.0, rows / n))) for lang, n in sorted(counts.items())], F.lit(0.0))
    chosen = known.where(F.pmod(F.xxhash64(F.lit(17), "own_id"), F.lit(1 << 20)) < share * (1 << 20))
    chosen = chosen.groupBy("own_lang", "own_id").agg(F.min("own_text").alias("own_text"))
    rank = F.row_number().over(Window.partitionBy("own_lang").orderBy(F.xxhash64(F.lit(17), "own_id"), "own_id"))
    chosen = chosen.withColumn("rank", rank).where(F.col("rank") <= 2 * rows).select("own_id", "own_lang", "own_text")
    texts: list[str] = []
    langs: list[str] = []
    for _, lang, text in sorted(chosen.collect(), key=lambda r: (str(r[0]), r[2])):
        if _LETTER.search(text):
            pick = np.random.default_rng(len(text))
            parts = [text] + [text[(k := int(pick.integers(0, max(1, len(text) - size)))) : k + size] for size in excerpts]
            parts = [p for p in parts if _LETTER.search(p)]
            texts += parts
            langs += [lang] * len(parts)
    if not texts:
        return None
    x = np.empty((len(texts), DIMS), dtype=np.float32)
    for k in range(0, len(texts), 128):
        some = [t.encode("utf-8", "replace") for t in texts[k : k + 128]]
        x[k : k + len(some)] = features(np.frombuffer(b"".join(some), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(c) for c in some])]))
    return Model(x, langs)


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, least_score: float = 0.0, wanted: tuple[str, ...] | None = None) -> DataFrame:
    """The id with lang_pred and score; or, with ``keep``, those columns of the rows that are not rejected.

    Rejected are ``und``, languages that are not ``wanted`` (all learned ones
    where it is None), and what scores below ``least_score``.
    """
    names = np.array(model.langs if model else [], dtype=object)
    out = keep or [id_col]
    columns = list(dict.fromkeys([*out, text_col]))

    def body(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = batch.column(text_col)
        for first, last, raw, offsets in slices(batch, text_col, 1 << 18, max_rows=128):
            lettered = np.array([bool(t.is_valid and _LETTER.search(t.as_py())) for t in texts.slice(first, last - first)])
            lang, score = np.full(last - first, "und", dtype=object), np.zeros(last - first)
            if model and lettered.any():
                best, sure = model.predict(features(raw, offsets))
                lang[lettered], score[lettered] = names[best[lettered]], sure[lettered]
            rows = batch.slice(first, last - first).select(out)
            if keep:
                own = lang != "und" if wanted is None else np.isin(lang.astype(str), wanted)
                yield rows.filter(pa.array(own & (score >= least_score)))
            else:
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(lang.tolist(), pa.string()), pa.array(score)], names=[id_col, "lang_pred", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*out).schema)
    return map_text(docs, schema if keep else f"{schema}, lang_pred string, score double", body, columns)
