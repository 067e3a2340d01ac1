"""Rows of a cohort that repeat test items, found by spaced seeds."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from holdfast.llm.common import judged

TOKEN = re.compile(r"[^\W_]+")
# Which tokens of a window a mask reads (1) and which it ignores (0). Of SPAN or
# more tokens, a fifth at most different, four in a row are equal, or else they are 15 tokens in
# equal runs of 3 3 3 3, 11 in 3 3 3, or 10 in 3 3 2, 2 3 3 or 3 2 3: a mask reads each of them.
MASKS = ("1111", "1110111", "1110110111")
SPAN = 9  # tokens of the shortest item that may differ
LAID = 1_000_000  # tokens laid over each other at a time
FACTOR = np.uint64(0x9E3779B97F4A7C15)
SLOTS = 1 << 22
BLOCK_BYTES = 8_000_000  # UTF-8 bytes of test items that one pass carries


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall(text.lower()) if text else []


def _seeds(codes: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the tokens that the mask reads, for every window start; 0 where one is unknown."""
    n = max(0, len(codes) - len(mask) + 1)
    total, known = np.zeros(n, dtype=np.uint64), np.ones(n, dtype=bool)
    with np.errstate(over="ignore"):
        for at, bit in enumerate(mask):
            if bit == "1":
                part = codes[at : at + n]
                known &= part > 0
                total = (total ^ part) * FACTOR
                total ^= total >> np.uint64(29)
    return np.where(known, total | np.uint64(1), np.uint64(0))


class SeedIndex:
    """The seeds of some test items, and what verification needs of them."""

    def __init__(self, items: list[tuple[object, str | None]], least_tokens: int, least_share: float):
        self.least_tokens = least_tokens
        share = Fraction(least_share).limit_denominator(1_000)
        # what an equal token earns and another one costs, so that a stretch of least_share sums up to 0 or more
        self.earn, self.cost = share.denominator - share.numerator, share.numerator
        self.ids, self.code, rows = [], {}, []
        for ident, text in items:
            words = tokens(text)
            if words:
                self.ids.append(ident)
                rows.append(np.array([self.code.setdefault(w, len(self.code) + 1) for w in words], dtype=np.int64))
        self.rows = rows
        self.size = np.array([len(r) for r in rows], dtype=np.int64)
        self.flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        self.first = np.cumsum(self.size) - self.size
        seeds, item, at = [], [], []
        self.short: dict[tuple, list[int]] = {}
        for k, codes in enumerate(rows):
            if len(codes) < SPAN:
                self.short.setdefault(tuple(codes.tolist()), []).append(k)
                continue
            for mask in MASKS:
                h = _seeds(codes.astype(np.uint64), mask)
                seeds.append(h ^ _salt(mask))
                item.append(np.full(len(h), k))
                at.append(np.arange(len(h)))
        self.seed = np.concatenate(seeds) if seeds else np.zeros(0, np.uint64)
        order = np.argsort(self.seed, kind="stable")
        self.seed = self.seed[order]
        self.item = np.concatenate(item)[order] if item else np.zeros(0, np.int64)
        self.at = np.concatenate(at)[order] if at else np.zeros(0, np.int64)
        self.slot = np.zeros(SLOTS, dtype=bool)
        self.slot[(self.seed % np.uint64(SLOTS)).astype(np.int64)] = True
        self.lengths = sorted({len(k) for k in self.short})

    def find(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item, first token, tokens, equal tokens) of each overlap of a whole text.

        Every hit names a diagonal (item, shift). On it, item and text are laid over each
        other; the longest stretch that begins and ends with an equal token, and of which
        `least_share` are equal, is the overlap. It counts with `least_tokens` tokens, or
        the whole item where that is shorter.
        """
        words = tokens(text)
        get = self.code.get
        codes = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
        if not codes.any():
            return []
        out = []
        for n in self.lengths:
            if len(codes) >= n:
                known = np.convolve(codes > 0, np.ones(n, dtype=np.int64), "valid") == n
                for s in np.flatnonzero(known):
                    for k in self.short.get(tuple(codes[s : s + n].tolist()), ()):
                        out.append((k, int(s), n, n))
        if len(codes) >= SPAN and len(self.seed):
            unsigned, hits = codes.astype(np.uint64), []
            for mask in MASKS:
                h = _seeds(unsigned, mask)
                some = np.flatnonzero(h)
                h = h[some] ^ _salt(mask)
                may = self.slot[(h % np.uint64(SLOTS)).astype(np.int64)]
                some, h = some[may], h[may]
                lo, hi = np.searchsorted(self.seed, h, "left"), np.searchsorted(self.seed, h, "right")
                at = _ranges(lo, hi - lo)
                hits.append(np.unique(self.item[at] << 32 | np.repeat(some, hi - lo) - self.at[at] + (1 << 31)))
            for k, shift in self._likely(np.unique(np.concatenate(hits)), codes):
                item = self.rows[k]
                lo, hi = max(0, -shift), min(len(item), len(codes) - shift)
                equal = item[lo:hi] == codes[lo + shift : hi + shift]
                a, b = _longest(equal, self.earn, self.cost)
                if b - a >= min(self.least_tokens, len(item)):
                    out.append((k, lo + shift + a, b - a, int(equal[a:b].sum())))
        return out

    def _likely(self, hits: np.ndarray, codes: np.ndarray) -> Iterator[tuple[int, int]]:
        """The diagonals (item, shift) with as many equal tokens as the shortest overlap has."""
        item, shift = hits >> 32, (hits & 0xFFFFFFFF) - (1 << 31)
        lo = np.maximum(0, -shift)
        size = np.minimum(self.size[item], len(codes) - shift) - lo
        least = np.minimum(self.least_tokens, self.size[item]) * self.cost
        part = np.cumsum(size) // LAID
        for x in np.split(np.arange(len(hits)), np.flatnonzero(np.diff(part)) + 1):
            if len(x):
                over = _ranges(self.first[item[x]] + lo[x], size[x]), _ranges(shift[x] + lo[x], size[x])
                same = np.add.reduceat((self.flat[over[0]] == codes[over[1]]).astype(np.int64), np.cumsum(size[x]) - size[x])
                for i in x[same * (self.earn + self.cost) >= least[x]].tolist():
                    yield int(item[i]), int(shift[i])

    def longest(self, texts: list[str | None]) -> list[list[dict]]:
        """(item id, start, tokens, equal tokens) of each text's best overlap with each item."""
        out = []
        for text in texts:
            best: dict[int, tuple[int, int, int]] = {}
            for k, start, size, same in self.find(text):
                if k not in best or (-size, -same, start) < (-best[k][1], -best[k][2], best[k][0]):
                    best[k] = (start, size, same)
            out.append([{"item_id": self.ids[k], "start": a, "n_tokens": b, "n_equal": c} for k, (a, b, c) in best.items()])
        return out


def _salt(mask: str) -> np.uint64:
    return np.uint64(int(mask, 2) << 40)


def _ranges(lo: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers lo to lo + size - 1 of each range in turn."""
    return np.repeat(lo - np.cumsum(size) + size, size) + np.arange(size.sum())


def _longest(equal: np.ndarray, earn: int, cost: int) -> tuple[int, int]:
    """Longest stretch from an equal token to an equal token that sums up to 0 or more; of
    equally long ones that with the most equal tokens, then the first."""
    run = np.r_[0, np.cumsum(np.where(equal, earn, -cost))]
    at = np.flatnonzero(equal)
    # the first start that is not above an end, by the lowest start so far
    first = at[np.searchsorted(-np.minimum.accumulate(run[at]), -run[at + 1])]
    end = np.lexsort((run[first] - run[at + 1], first - at))[0]
    return int(first[end]), int(at[end]) + 1


def _indexes(items: DataFrame, id: str, text: str, least_tokens: int, least_share: float) -> Iterator[SeedIndex]:
    """Indexes of the test items in parts of about BLOCK_BYTES; the size is counted, not assumed."""
    rows = items.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text")).where("text is not null")
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = max(1, math.ceil(size / BLOCK_BYTES))
    for k in range(parts):
        part = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == k).orderBy("id", "text").collect()
        yield SeedIndex([(r["id"], r["text"]) for r in part], least_tokens, least_share)


def leaked_overlaps(
    cohort: DataFrame, items: DataFrame, id: str = "id", text: str = "text", item_id: str = "id", item_text: str = "text", least_tokens: int = 12, least_share: float = 0.8
) -> DataFrame:
    """(id, item_id, start, n_tokens, n_equal), one row per overlap of a row with a test item.

    A leak of the test side into a cohort. Tokens are runs of letters and digits,
    lower-cased. Masks over a few tokens ignore some positions; text and item share a hash
    wherever they agree on the others. Each hit is verified on its diagonal, so that
    substituted tokens are tolerated: an overlap begins and ends with an equal token and counts
    with `least_tokens` tokens (or the whole item if shorter) of which `least_share` are equal.
    With SPAN `least_tokens` and a share of 0.8 or more every overlap has a hit. Items of fewer
    than SPAN tokens are found whole and unchanged only. Of the overlaps of one row with one
    item the longest is given, of these the one with the most equal tokens, then the first.

    Null, empty and token-free texts and items overlap with nothing. Null ids are carried,
    repeated rows give a row each, equal items are reported under each of their ids. Other
    columns are not read. Texts of any length are read whole.

    The index of a part of the items (BLOCK_BYTES of text) goes to the tasks; further parts
    are further passes over the cohort, so no table of unproven size is broadcast.
    """
    rows = cohort.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    kind = items.schema[item_id].dataType
    arrow = pa.list_(pa.struct([("item_id", to_arrow_type(kind)), ("start", pa.int32()), ("n_tokens", pa.int32()), ("n_equal", pa.int32())]))
    found = None
    for index in _indexes(items, item_id, item_text, least_tokens, least_share):
        hit = judged(rows, "text", index.longest, f"array<struct<item_id:{kind.simpleString()},start:int,n_tokens:int,n_equal:int>>", arrow)
        hit = hit.select("row.id", F.inline("value"))
        found = hit if found is None else found.union(hit)
    return found


def without_leaks(
    cohort: DataFrame, items: DataFrame, text: str = "text", item_id: str = "id", item_text: str = "text", least_tokens: int = 12, least_share: float = 0.8
) -> DataFrame:
    """The cohort's rows, all columns, without those that overlap with a test item.

    Rules and cases as in `leaked_overlaps`; rows are judged where they are read, so null and
    repeated ids make no difference.
    """
    for index in _indexes(items, item_id, item_text, least_tokens, least_share):
        clean = judged(cohort, text, lambda texts, index=index: [not index.find(t) for t in texts], "boolean", pa.bool_())
        cohort = clean.where("value").select("row.*")
    return cohort
