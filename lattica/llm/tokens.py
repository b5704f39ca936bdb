"""Token counts of a byte-level BPE by rank-synchronous array merging.

Texts are cut into pre-tokens, the distinct ones of a run of texts are held as
one ragged array of symbols, and all sequences advance together: each applies
its lowest-rank pair, at every place where it stands, until none is left; the
symbols that survive are counted.  A pair made by a merge ranks above that
merge, so applying one rank at a time gives what the library's one-by-one
queue gives.

Defined cases: a null text counts as empty, which has no bytes and no tokens;
the string of a special token inside a text is one token, as the library reads
it by default; of pairs of one rank, which overlap, the left one is merged
first; a text of any length is counted whole; rows that repeat an id or a text
give a row each; an empty table gives an empty result; only the id and the text
are read, so other columns may have any names.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lattica.llm import textscan
from lattica.llm.common import map_text, slices

_LETTER, _NUMBER, _SPACE, _OTHER = 0, 1, 2, 3
#: The endings that the pre-tokenizer splits off after an apostrophe.
_ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
_PAIR = np.uint64(1 << 20)


def _classes() -> np.ndarray:
    """The pre-tokenizer's class of every code point, by Unicode category."""
    out = np.full(0x110000, _OTHER, dtype=np.uint8)
    for code in range(0x110000):
        kind = unicodedata.category(chr(code))[0]
        if kind == "L":
            out[code] = _LETTER
        elif kind == "N":
            out[code] = _NUMBER
        elif kind == "Z":
            out[code] = _SPACE
    out[[*range(0x09, 0x0E), 0x85]] = _SPACE
    return out


def _byte_symbols() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shifted = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(shifted)}


class Counter:
    """Counts tokens with the vocabulary of a ``.json`` tokenizer file."""

    def __init__(self, path: str, known_limit: int = 1 << 20):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        vocab = spec["model"]["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.of_byte = np.zeros(256, dtype=np.uint64)
        for symbol, byte in _byte_symbols().items():
            self.of_byte[byte] = vocab[symbol]
        pairs = np.array([vocab[a] * int(_PAIR) + vocab[b] for a, b in merges], dtype=np.uint64)
        self.merged = np.array([vocab[a + b] for a, b in merges], dtype=np.uint64)
        self._index(pairs)
        self.classes = _classes()
        self.known_limit = known_limit
        self.known = np.zeros(0, np.uint64)
        self.known_count = np.zeros(0, np.int64)

    def _index(self, pairs: np.ndarray) -> None:
        """An open-addressing table from pair to rank."""
        self.bits = 18
        size = 1 << self.bits
        self.slot_pair = np.full(size + 64, 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
        self.slot_rank = np.full(size + 64, len(pairs), dtype=np.int32)
        places = self._place(pairs)
        self.probes = 1
        for rank, place in enumerate(places.tolist()):
            k = place
            while self.slot_rank[k] != len(pairs):
                k += 1
            self.slot_pair[k], self.slot_rank[k] = pairs[rank], rank
            self.probes = max(self.probes, k - place + 1)
        self.none = len(pairs)

    def _place(self, pairs: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((pairs * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, pairs: np.ndarray) -> np.ndarray:
        """The rank of each pair; the number of merges where it has none."""
        at = self._place(pairs)
        out = np.full(len(pairs), self.none, dtype=np.int32)
        open_ = np.arange(len(pairs))
        for _ in range(self.probes):
            slot = self.slot_pair[at]
            hit = slot == pairs[open_]
            out[open_[hit]] = self.slot_rank[at[hit]]
            go = ~hit & (slot != np.uint64(0xFFFFFFFFFFFFFFFF))
            if not go.any():
                break
            open_, at = open_[go], at[go] + 1
        return out

    def merge(self, symbols: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Surviving symbols of each sequence ``symbols[bounds[i]:bounds[i + 1]]``; none is empty."""
        counts = np.diff(bounds)
        live = np.arange(len(counts))
        while len(live):
            length = np.diff(bounds)
            row = np.repeat(np.arange(len(length)), length)
            rank = np.full(len(symbols), self.none, dtype=np.int32)
            inside = np.flatnonzero(row[:-1] == row[1:])
            rank[inside] = self.ranks(symbols[inside] * _PAIR + symbols[inside + 1])
            lowest = np.minimum.reduceat(rank, bounds[:-1])
            counts[live] = length
            going = lowest < self.none
            at = np.flatnonzero((rank == lowest[row]) & going[row])
            if not len(at):
                break
            # Of touching places (a pair like "aa" in "aaa") every second one, from the left, applies.
            first = np.concatenate([[True], np.diff(at) != 1])
            since = np.arange(len(at)) - np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
            at = at[since % 2 == 0]
            symbols[at] = self.merged[rank[at]]
            keep = going[row]
            keep[at + 1] = False
            symbols = symbols[keep]
            left = (length - np.bincount(row[at], minlength=len(length)))[going]
            live = live[going]
            bounds = np.concatenate([[0], np.cumsum(left)])
        return counts

    def starts(self, codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Which code points begin a pre-token; texts begin at ``offsets``."""
        n = len(codes)
        kind = self.classes[codes]
        edge = np.zeros(n + 1, dtype=bool)
        edge[offsets] = True
        new = np.empty(n, dtype=bool)
        new[0] = True
        new[1:] = kind[1:] != kind[:-1]
        new |= edge[:-1]
        last = np.empty(n, dtype=bool)
        last[:-1] = new[1:]
        last[-1] = True
        # A run of white space before something else gives up its last character: a
        # plain space joins what follows, anything else stands alone.
        give = np.flatnonzero((kind == _SPACE) & last & ~edge[1:])
        plain = codes[give] == 0x20
        new[give] = True
        new[give[plain] + 1] = False
        # A lone apostrophe that begins a pre-token takes a known ending from the letters after it.
        for at in np.flatnonzero((codes == 0x27) & new & last & ~edge[1:]).tolist():
            rest = codes[at + 1 : at + 3]
            for ending in _ENDINGS:
                if len(ending) <= len(rest) and all(ord(c) == rest[k] for k, c in enumerate(ending)):
                    if len(ending) == 2 and edge[at + 2]:
                        continue
                    new[at + 1] = False
                    after = at + 1 + len(ending)
                    if after < n:
                        new[after] |= not edge[after] and kind[after] == _LETTER
                    break
        return new

    def pieces(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte bounds of the pre-tokens, and how many begin before each text's start."""
        lead = np.flatnonzero((raw & 0xC0) != 0x80)
        codes = np.frombuffer(raw.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        text_at = np.searchsorted(lead, offsets)
        begins = lead[np.flatnonzero(self.starts(codes, text_at))] if len(codes) else lead
        return np.concatenate([begins, [len(raw)]]), np.searchsorted(begins, offsets)

    def count(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each text, whose bytes lie between its offsets."""
        if not len(raw):
            return np.zeros(len(offsets) - 1, dtype=np.int64)
        extra = np.zeros(len(offsets) - 1, dtype=np.int64)
        text = raw.tobytes()
        for special in self.special:
            mark = special.encode()
            if mark in text:
                return self._count_split(text, offsets, mark)
        bounds, first = self.pieces(raw, offsets)
        hashes = textscan.span_hashes(raw, bounds[:-1], bounds[1:], lower=False)
        values, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        found = np.minimum(np.searchsorted(self.known, values), max(len(self.known) - 1, 0))
        old = self.known[found] == values if len(self.known) else np.zeros(len(values), bool)
        counts = np.ones(len(values), dtype=np.int64)
        counts[old] = self.known_count[found[old]]
        fresh = np.flatnonzero(~old)
        if len(fresh):
            begin, size = bounds[where[fresh]], bounds[where[fresh] + 1] - bounds[where[fresh]]
            ragged = np.concatenate([[0], np.cumsum(size)])
            at = np.repeat(begin - ragged[:-1], size) + np.arange(ragged[-1])
            counts[fresh] = self.merge(self.of_byte[raw[at]], ragged)
            self._remember(values[fresh], counts[fresh])
        total = np.concatenate([[0], np.cumsum(counts[inverse])])
        return total[first[1:]] - total[first[:-1]] + extra

    def _remember(self, values: np.ndarray, counts: np.ndarray) -> None:
        """Keep counts of pre-tokens for later runs of texts, up to ``known_limit`` of them."""
        if len(self.known) + len(values) > self.known_limit:
            self.known, self.known_count = values, counts
            return
        both = np.concatenate([self.known, values])
        order = np.argsort(both)
        self.known, self.known_count = both[order], np.concatenate([self.known_count, counts])[order]

    def _count_split(self, text: bytes, offsets: np.ndarray, mark: bytes) -> np.ndarray:
        """Count texts in which a special token stands: each part on its own, one for each mark."""
        out = np.zeros(len(offsets) - 1, dtype=np.int64)
        parts, owner = [], []
        for k in range(len(offsets) - 1):
            split = text[offsets[k] : offsets[k + 1]].split(mark)
            out[k] += len(split) - 1
            parts += split
            owner += [k] * len(split)
        bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        np.add.at(out, owner, self.count(np.frombuffer(b"".join(parts), dtype=np.uint8), bounds))
        return out


_counters: dict[str, Counter] = {}


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """The id with n_bytes, n_tokens and over_limit (more than ``limit`` tokens).

    ``vocabulary`` names a byte-level ``.json`` file in the public tokenizers'
    folder; workers look it up there, so it is not shipped.
    """

    def body(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        if vocabulary not in _counters:
            _counters[vocabulary] = Counter(public_tokenizers.path(vocabulary))
        counter = _counters[vocabulary]
        for first, last, raw, offsets in slices(batch, text_col):
            n = counter.count(raw, offsets)
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col).slice(first, last - first), pa.array(np.diff(offsets), pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return map_text(docs, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean", body, list(dict.fromkeys([id_col, text_col])))
