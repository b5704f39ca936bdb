"""Quality rules: counts over the text, and line labels by a linear-chain CRF.

Each line that has a word is an observation; Viterbi decoding of a two-state
linear-chain conditional random field marks it content or boilerplate, and the
share of word characters in content lines decides whether a document that
passes the fixed rules is kept.

The field is trained on a bounded sample of labelled documents.  Labels are per
document, so lines learn from them at a distance: a line is boilerplate when
its document is labelled bad or when it repeats an earlier line, else content.

Lines and three-word windows of a text are the same where their 64-bit hashes
are; at a million lines in one text a false repeat has a chance of about 10^-8.

Defined cases: a null text or one without words has no words, fails the fixed
rule on length and is not kept; counts and learning are over whole texts
whatever their length; rows that repeat an id or a text give a row each, and an
id that is labelled more than once is learned once for each of its labels; of
equally likely labellings the one with content first wins; an empty table gives
an empty result; with no labelled rows to learn from, every line counts as
content; only the named columns are read, so others may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm import textscan
from lattica.llm.common import map_text, slices

N_FEATURES = 12
_SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", dtype=np.uint8))
_UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
_LOWER = (np.arange(256) >= 97) & (np.arange(256) <= 122)
_DIGIT = (np.arange(256) >= 48) & (np.arange(256) <= 57)
_MARK = np.isin(np.arange(256), np.frombuffer(b"!?.,;:", dtype=np.uint8))
_SHOUT = np.isin(np.arange(256), np.frombuffer(b"!?", dtype=np.uint8))
_STOP = np.isin(np.arange(256), np.frombuffer(b".!?", dtype=np.uint8))


class Lines:
    """Lines with a word of a run of texts: their bounds, owners and features."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        n_texts = len(offsets) - 1
        self.starts, self.ends = textscan.runs(textscan.BLANK_WORDS[raw], offsets)
        self.word_bounds = textscan.per_text(self.starts, offsets)
        self.words = textscan.span_hashes(raw, self.starts, self.ends, lower=False)
        lead = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        word_chars = lead[self.ends] - lead[self.starts]
        self.word_chars = _totals(word_chars, self.word_bounds)
        breaks = np.flatnonzero(raw == 10)
        first = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
        first = first[first < len(raw)]
        last = np.concatenate([first[1:], [len(raw)]]).astype(np.int64)
        # A line ends before its own break.
        last -= (last > first) & (raw[np.maximum(last - 1, 0)] == 10) if len(first) else 0
        in_line = np.searchsorted(self.starts, np.concatenate([first, [len(raw)]]))
        n_words = np.diff(in_line)
        full = n_words > 0
        self.first, self.last, self.n_words = first[full], last[full], n_words[full]
        self.owner = np.searchsorted(offsets, self.first, side="right") - 1
        # Texts without bytes share their offset with the next one, which owns the line.
        self.bounds = np.searchsorted(self.owner, np.arange(n_texts + 1))
        totals = np.concatenate([[0], np.cumsum(word_chars)])
        self.chars = totals[in_line[1:]][full] - totals[in_line[:-1]][full]
        self.hashes = textscan.span_hashes(raw, self.first, self.last, lower=False)
        self.repeated = _repeats(self.owner, self.hashes)
        self.features = self._features(raw)

    def _features(self, raw: np.ndarray) -> np.ndarray:
        def share(table: np.ndarray) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(table[raw])])
            return total[self.last] - total[self.first]

        letters = np.maximum(share(_LOWER | _UPPER), 1)
        chars = np.maximum(self.chars, 1)
        out = np.zeros((len(self.first), N_FEATURES), dtype=np.float64)
        if not len(out):
            return out
        out[:, 0] = 1.0
        out[:, 1] = np.minimum(np.log1p(self.n_words), 6) / 6
        out[:, 2] = self.n_words < 4
        out[:, 3] = np.minimum(share(_SYMBOLS) / chars, 0.5) * 2
        out[:, 4] = share(_SYMBOLS) > 0
        out[:, 5] = share(_UPPER) / letters
        out[:, 6] = np.minimum(share(_SHOUT) / np.maximum(self.n_words, 1), 1)
        out[:, 7] = np.minimum(share(_DIGIT) / chars, 1)
        out[:, 8] = self.repeated
        out[:, 9] = _STOP[raw[self.last - 1]]
        out[:, 10] = self._variety()
        out[:, 11] = np.minimum(share(_MARK) / np.maximum(self.n_words, 1), 1)
        return out

    def _variety(self) -> np.ndarray:
        """Different words of each line, as a share of its words."""
        line_of = np.repeat(np.arange(len(self.n_words)), self.n_words)
        again = _repeats(line_of, self.words)
        return 1 - np.bincount(line_of, weights=again, minlength=len(self.n_words)) / np.maximum(self.n_words, 1)

    def repeated_lines(self) -> np.ndarray:
        return _totals(self.repeated.astype(np.int64), self.bounds)

    def repeated_words(self, width: int = 3) -> np.ndarray:
        """Words of each text in windows of ``width`` words that stand in it twice or more."""
        grams = textscan.gram_hashes(self.words, width)
        owner = np.repeat(np.arange(len(self.word_bounds) - 1), np.diff(self.word_bounds))
        inside = np.flatnonzero(owner[: len(grams)] == owner[width - 1 :][: len(grams)])
        own, values = owner[inside], grams[inside]
        order = np.lexsort((values, own))
        same = (own[order][1:] == own[order][:-1]) & (values[order][1:] == values[order][:-1])
        twice = np.zeros(len(order), dtype=bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        hit = textscan.covered(inside[twice], width, len(self.words))
        return _totals(hit.astype(np.int64), self.word_bounds)


def _totals(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _repeats(owner: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values equal an earlier one of the same owner."""
    order = np.lexsort((np.arange(len(values)), values, owner))
    same = (owner[order][1:] == owner[order][:-1]) & (values[order][1:] == values[order][:-1])
    out = np.zeros(len(values), dtype=bool)
    out[order[1:][same]] = True
    return out


class Field:
    """A two-state linear-chain conditional random field (0 content, 1 boilerplate)."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray):
        self.weights, self.moves = weights, moves

    @classmethod
    def trained(cls, chains: list[tuple[np.ndarray, np.ndarray]], steps: int = 150, rate: float = 0.15, decay: float = 1e-3) -> Field:
        """Maximise the conditional log-likelihood of (features, labels) chains by Adam."""
        weights, moves = np.zeros((N_FEATURES, 2)), np.zeros((2, 2))
        if not chains:
            weights[0] = (1.0, -1.0)
            return cls(weights, moves)
        x, y = (np.concatenate(c) for c in zip(*chains, strict=True))
        ends = np.cumsum([len(labels) for _, labels in chains])
        first = np.repeat(np.concatenate([[0], ends[:-1]]), np.diff(ends, prepend=0))
        inner = np.flatnonzero(first < np.arange(len(y)))
        one_hot = np.eye(2)[y]
        seen_w, seen_m = x.T @ one_hot, one_hot[inner - 1].T @ one_hot[inner]
        mean, var = np.zeros(N_FEATURES * 2 + 4), np.zeros(N_FEATURES * 2 + 4)
        for step in range(1, steps + 1):
            node, pair = marginals(x @ weights, moves, first, inner)
            slope = np.concatenate([(seen_w - x.T @ node).ravel(), (seen_m - pair).ravel()]) / len(y)
            slope -= decay * np.concatenate([weights.ravel(), moves.ravel()])
            mean, var = 0.9 * mean + 0.1 * slope, 0.99 * var + 0.01 * slope**2
            move = rate * (mean / (1 - 0.9**step)) / (np.sqrt(var / (1 - 0.99**step)) + 1e-8)
            weights, moves = weights + move[: N_FEATURES * 2].reshape(N_FEATURES, 2), moves + move[N_FEATURES * 2 :].reshape(2, 2)
        return cls(weights, moves)

    def decode(self, features: np.ndarray) -> np.ndarray:
        """The most likely labels of one chain, by Viterbi."""
        score = (features @ self.weights).tolist()
        (cc, cb), (bc, bb) = self.moves.tolist()
        content, boiler = score[0]
        back = []
        for s0, s1 in score[1:]:
            from_c, from_b = content + cc >= boiler + bc, content + cb > boiler + bb
            back.append((0 if from_c else 1, 0 if from_b else 1))
            content, boiler = (content + cc if from_c else boiler + bc) + s0, (content + cb if from_b else boiler + bb) + s1
        state = int(boiler > content)
        out = [state]
        for step in reversed(back):
            state = step[state]
            out.append(state)
        return np.array(out[::-1])


def marginals(score: np.ndarray, moves: np.ndarray, first: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """State probabilities of every place of chains laid end to end, and the expected moves.

    Sums over labellings are products of 2 x 2 matrices.  They are built by
    doubling over all places at once, so a chain costs the logarithm of its
    length in steps and needs no padding; ``first`` is the place where each
    place's chain begins, ``inner`` the places that follow another.
    """
    n = len(score)
    here = np.exp(score - score.max(axis=1, keepdims=True))
    step = np.exp(moves - moves.max())
    ahead = np.broadcast_to(here[:, None, :], (n, 2, 2)).copy()
    ahead[inner] *= step
    back = ahead.copy()
    last = np.searchsorted(first, first, side="right") - 1
    gap, place = 1, np.arange(n)
    longest = int((last - first).max()) + 1
    while gap < longest:
        for table, at, other in ((ahead, np.flatnonzero(place - gap >= first), -gap), (back, np.flatnonzero((place + gap <= last) & (place > first)), gap)):
            made = table[at + other] @ table[at] if other < 0 else table[at] @ table[at + other]
            table[at] = made / made.max(axis=(1, 2), keepdims=True)
        gap *= 2
    forth, after = ahead[:, 0, :], np.ones((n, 2))
    after[inner - 1] = back[inner].sum(axis=2)
    node = forth * after
    node /= node.sum(axis=1, keepdims=True)
    pair = forth[inner - 1][:, :, None] * step * (here * after)[inner][:, None, :]
    return node, (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)


def sample(docs: DataFrame, labels: DataFrame, label_col: str, rows: int, where=None, id_col: str = "doc_id", text_col: str = "text") -> list:
    """(text, label, id) of at most ``rows`` labelled documents of each label, by the hash of their id.

    Ids are chosen first, each once, from the narrow labels table; their number
    is the bound that lets them be broadcast against the documents.  An id that
    stands on several rows gives its smallest text, so the rows are bounded too.
    """
    known = labels if where is None else labels.where(where)
    known = known.select(F.col(id_col).alias("picked_id"), F.col(label_col).alias("picked_label")).where("picked_id is not null").distinct()
    picked = [known.where(F.col("picked_label") == value).orderBy(F.xxhash64("picked_id"), "picked_id").limit(rows) for value in (0, 1)]
    texts = docs.select(F.col(id_col).alias("own_id"), F.coalesce(F.col(text_col), F.lit("")).alias("own_text"))
    found = texts.join(F.broadcast(picked[0].unionAll(picked[1])), F.col("own_id") == F.col("picked_id"))
    found = found.groupBy("picked_id", "picked_label").agg(F.min("own_text").alias("own_text"))
    return sorted(((r["own_text"], r["picked_label"], r["picked_id"]) for r in found.collect()), key=lambda r: (r[2], r[1]))


def train(docs: DataFrame, labels: DataFrame, rows: int = 400, where=None, id_col: str = "doc_id", text_col: str = "text") -> Field:
    """The field, from all lines of at most ``rows`` documents of each quality."""
    chains = []
    for text, label, _ in sample(docs, labels, "quality", rows, where, id_col, text_col):
        raw = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
        if len(raw):
            found = Lines(raw, np.array([0, len(raw)]))
            if len(found.first):
                y = np.ones(len(found.first), dtype=np.int64) if label == 0 else found.repeated.astype(np.int64)
                chains.append((found.features, y))
    return Field.trained(chains)


def apply(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text", least_words: int = 50, most_repeats: int = 50, least_share: float = 0.5) -> DataFrame:
    """The id with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, content_share, kept."""

    def body(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for first, last, raw, offsets in slices(batch, text_col):
            found = Lines(raw, offsets)
            n_words = np.diff(found.word_bounds)
            symbols = np.concatenate([[0], np.cumsum(_SYMBOLS[raw])])
            n_symbols = symbols[offsets[1:]] - symbols[offsets[:-1]]
            repeat = found.repeated_words()
            failed = (n_words < least_words) | (100 * repeat > most_repeats * n_words)
            content = np.zeros(len(found.first), dtype=bool)
            for a, b in zip(found.bounds[:-1].tolist(), found.bounds[1:].tolist(), strict=True):
                if b > a:
                    content[a:b] = field.decode(found.features[a:b]) == 0
            share = _totals(found.chars * content, found.bounds) / np.maximum(found.word_chars, 1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(id_col).slice(first, last - first),
                    *(pa.array(v, pa.int64()) for v in (n_words, found.word_chars, n_symbols, found.repeated_lines(), repeat)),
                    pa.array(failed),
                    pa.array(share),
                    pa.array(~failed & (share >= least_share)),
                ],
                names=[id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "content_share", "kept"],
            )

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, kept boolean"
    return map_text(docs, schema, body, list(dict.fromkeys([id_col, text_col])))
