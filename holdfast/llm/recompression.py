"""Repeated word windows by recompression of the token sequence."""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.llm.common import LAST_ID
from holdfast.llm.repeats import LOW, Block, find_repeats

ROUNDS = 2
ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * ODD[1]
        x = (x ^ (x >> np.uint64(27))) * ODD[2]
    return x ^ (x >> np.uint64(31))


def _name(*parts: np.ndarray | int) -> np.ndarray:
    """The global name of a run (symbol, length) or pair (left, right): equal wherever it occurs."""
    total = np.uint64(0)
    with np.errstate(over="ignore"):
        for k, part in enumerate(parts):
            total = _mix((total ^ np.asarray(part, dtype=np.uint64)) * ODD[0] + np.uint64(k + 1))
    return total


# Inverse of an odd base, and its powers.
_INVERSE = np.uint64(pow(int(ODD[0]), -1, 1 << 64))
CHUNKS = 8  # words of more chunks of 8 bytes are hashed one by one


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def words_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(name, twin, start, end) of the words of UTF-8 bytes, parted by ASCII white space.

    Name and twin are 128 bits made from all bytes of the word: two chains that mix 8 bytes
    after 8 bytes, or BLAKE2 for words of more than CHUNKS such steps.
    """
    space = _SPACE[data]
    edge = np.diff(np.r_[True, space, True].astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    size = end - start
    name, twin = _name(size, 17), _name(size, 23)
    padded = np.r_[data, np.zeros(8, dtype=np.uint8)]
    eight = np.lib.stride_tricks.sliding_window_view(padded, 8)
    left = np.flatnonzero(size <= 8 * CHUNKS)
    for c in range(CHUNKS):
        left = left[size[left] > 8 * c]
        if not len(left):
            break
        chunk = np.ascontiguousarray(eight[start[left] + 8 * c]).view("<u8").ravel()
        spare = np.uint64(8) * np.maximum(8 * (c + 1) - size[left], 0).astype(np.uint64)
        chunk = (chunk << spare) >> spare
        with np.errstate(over="ignore"):
            name[left] = _mix((name[left] ^ chunk) * ODD[0] + np.uint64(c + 1))
            twin[left] = _mix((twin[left] ^ _mix(chunk + ODD[2])) * ODD[1] + np.uint64(c + 1))
    for k in np.flatnonzero(size > 8 * CHUNKS).tolist():
        whole = hashlib.blake2b(data[start[k] : end[k]].tobytes(), digest_size=16).digest()
        name[k], twin[k] = np.frombuffer(whole, dtype="<u8")
    return name, twin, start, end


def _stretches(token: np.ndarray, width: int, salt: int) -> np.ndarray:
    """A digest of the `width` tokens from each place on, by doubling; too short ones at the end are left out."""
    part, size, total, done = token, 1, None, 0
    while True:
        if width & size:
            n = len(token) - done - size + 1
            ahead = part[done : done + max(n, 0)]
            total = ahead if total is None else _name(total[: len(ahead)], ahead, salt, size)
            done += size
        size *= 2
        if size > width:
            return total
        half = size // 2
        part = _name(part[: max(len(part) - half, 0)], part[half:], salt)


class Symbols:
    """A level of the recompressed sequence: names, and the tokens [low, high) that settle each.

    A symbol's name and bounds follow from the tokens from `low` to `high` alone, so that
    every window that holds these tokens has the same symbol inside, wherever it stands.
    """

    def __init__(self, name: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.name, self.low, self.high = name, low, high

    def runs(self, level: int) -> Symbols:
        """Each maximal run of one symbol becomes a symbol; its neighbours show that it ends."""
        n = len(self.name)
        first = np.flatnonzero(np.r_[True, self.name[1:] != self.name[:-1]])
        last = np.r_[first[1:], n] - 1
        length = last - first + 1
        name = np.where(length > 1, _name(self.name[first], length, level, 1), self.name[first])
        low, high = self.low[np.maximum(first - 1, 0)].copy(), self.high[np.minimum(last + 1, n - 1)].copy()
        low[0], high[-1] = self.low[0] - 1, self.high[-1] + 1  # the outer ends settle nothing
        return Symbols(name, low, high)

    def pairs(self, level: int) -> Symbols:
        """Each left symbol with a right one behind it becomes a symbol; names decide the sides."""
        n = len(self.name)
        right = (_mix(self.name ^ np.uint64(level + 101)) >> np.uint64(11)) & np.uint64(1) > 0
        joins = np.zeros(n, dtype=bool)
        joins[:-1] = ~right[:-1] & right[1:]
        taken = np.r_[False, joins[:-1]]
        before, after = np.maximum(np.arange(n) - 1, 0), np.minimum(np.arange(n) + 1, n - 1)
        low = np.where(right & ~taken, self.low[before], self.low)
        high = np.where(joins, self.high[after], np.where(~right, self.high[after], self.high))
        name = np.where(joins, _name(self.name, self.name[after], level, 2), self.name)
        return Symbols(name[~taken], low[~taken], high[~taken])


def _least_in(order: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Index of the smallest of order[a:b] for each range (a < b), the first of equal ones."""
    packed = (order.astype(np.uint64) << np.uint64(32)) | np.arange(len(order), dtype=np.uint64)
    levels, size = [packed], 1
    while size * 2 <= int((b - a).max()):
        prev = levels[-1]
        levels.append(np.r_[np.minimum(prev[:-size], prev[size:]), prev[-size:]])
        size *= 2
    level = np.log2(b - a).astype(np.int64)
    out = np.empty(len(a), dtype=np.uint64)
    for k in np.unique(level):
        at = level == k
        out[at] = np.minimum(levels[k][a[at]], levels[k][b[at] - (1 << int(k))])
    return (out & np.uint64(0xFFFFFFFF)).astype(np.int64)


class Windows:
    """Windows of `width` words: the symbols inside them as keys, their digests as pieces."""

    # a window's own digest deals it out, so a frequent symbol spreads over all ranges
    record = np.dtype([("key", "<u8"), ("two", "<u8"), ("anchor", "<u8"), ("id", "<i8"), ("at", "<i4")])

    def __init__(self, width: int):
        self.width = width

    def _scan(self, texts: list[bytes]):
        """(key, text, position, digest, digest, place of the key's symbol) of each window.

        The key is the interior symbol with the smallest name, with the words that settle
        it; equal windows have it in the same place.
        """
        w = self.width
        data = np.frombuffer(b" ".join(texts), dtype=np.uint8)
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        begin = np.cumsum(size + 1) - size - 1
        name, twin, start, _ = words_of(data)
        doc = np.searchsorted(begin, start, "right") - 1
        count = np.bincount(doc, minlength=len(texts))
        before = np.r_[0, np.cumsum(count)[:-1]]
        n = len(name)
        # an end sign of its own stands between texts; no window holds one
        token = np.zeros(n + len(texts) + 1, dtype=np.uint64)
        ends = np.r_[0, np.cumsum(count + 1)]
        token[ends] = _name(np.arange(len(texts) + 1), 3, 7)
        place = np.arange(n) + doc + 1
        token[place] = name
        second = _name(token, 5)
        second[place] = twin
        if not (count >= w).any():
            return None
        at = place[np.arange(n) + w <= (before + count)[doc]]
        where = np.arange(len(token))
        levels = [Symbols(token, where, where + 1)]
        for r in range(ROUNDS):
            levels.append(levels[-1].runs(r).pairs(r))
        up, down = _powers(ODD[0], len(token) + 1), _powers(_INVERSE, len(token) + 1)
        one = np.r_[np.uint64(0), np.cumsum(token * up[:-1], dtype=np.uint64)]
        key, spot = np.zeros(len(at), dtype=np.uint64), np.zeros(len(at), dtype=np.int64)
        open_ = np.arange(len(at))
        for symbols in reversed(levels):
            s = at[open_]
            a, b = np.searchsorted(symbols.low, s, "left"), np.searchsorted(symbols.high, s + w, "right")
            some = a < b
            if some.any():
                q = _least_in((symbols.name >> np.uint64(33)).astype(np.uint32), a[some], b[some])
                low, high = symbols.low[q], symbols.high[q]
                key[open_[some]] = _name(symbols.name[q], (one[high] - one[low]) * down[low], high - low)
                spot[open_[some]] = low
            open_ = open_[~some]
            if not len(open_):
                break
        d = doc[np.searchsorted(place, at)]
        first = at - ends[d] - 1
        return key & ~LOW, d, first, _stretches(token, w, 31)[at], _stretches(second, w, 37)[at], spot

    def keys(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        keys, owner, seen = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
        for run in block.chunks():
            found = self._scan([block.texts[i] for i in run])
            if found:
                # all windows around one symbol are one owner
                keys.append(found[0])
                owner.append(found[5] + seen)
                seen += int(found[5].max()) + 1
        return np.concatenate(keys), np.concatenate(owner)

    def _places(self, block: Block, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Text index and record of each window behind a shared key."""
        shared = np.unique(shared & ~LOW)
        docs, records = [np.zeros(0, np.int64)], [np.zeros(0, self.record)]
        for run in block.chunks():
            found = self._scan([block.texts[i] for i in run])
            if not found or not len(shared):
                continue
            key, d, first, one, two, _ = found
            some = shared[np.minimum(np.searchsorted(shared, key), len(shared) - 1)] == key
            doc = np.array(run)[d[some]]
            out = np.zeros(len(doc), dtype=self.record)
            out["key"], out["two"], out["anchor"], out["id"], out["at"] = one[some], two[some], key[some], block.ids[doc], first[some]
            docs.append(doc)
            records.append(out)
        return np.concatenate(docs), np.concatenate(records)

    @staticmethod
    def _heads(pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of each window's first occurrence, windows sorted; and the window of each piece."""
        order = np.lexsort((pieces["at"], pieces["id"], pieces["two"], pieces["key"]))
        key, two = pieces["key"][order], pieces["two"][order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (two[1:] != two[:-1])
        went = np.empty(len(order), dtype=np.int64)
        went[order] = np.cumsum(new) - 1
        return order[new], went

    def pieces(self, block: Block, shared: np.ndarray) -> np.ndarray:
        _, records = self._places(block, shared)
        return records[self._heads(records)[0]]

    @staticmethod
    def _later(pieces: np.ndarray, head: np.ndarray) -> np.ndarray:
        return (head["id"] < pieces["id"]) | (head["id"] == pieces["id"]) & (head["at"] < pieces["at"])

    def judge(self, pieces: np.ndarray) -> np.ndarray:
        """1 where the same words also start earlier."""
        first, went = self._heads(pieces)
        return self._later(pieces, pieces[first][went])

    def finish(self, block: Block, shared: np.ndarray, marks: np.ndarray) -> pd.DataFrame:
        words = [t.split() for t in block.texts]
        base = np.r_[0, np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))]
        step = np.zeros(int(base[-1]) + 1, dtype=np.int32)
        if len(shared):
            doc, records = self._places(block, shared)
            first, went = self._heads(records)
            hit = (marks[went] > 0) | self._later(records, records[first][went])
            at = base[doc[hit]] + records["at"][hit]
            np.add.at(step, at, 1)
            np.add.at(step, at + self.width, -1)
        gone = np.cumsum(step[:-1]) > 0
        removed, digest = [], []
        for i, own in enumerate(words):
            lost = gone[base[i] : base[i + 1]]
            if block.whole[i] and len(own) >= self.width:
                removed.append(len(own))
                own = []
            else:
                removed.append(int(lost.sum()))
                own = compress(own, ~lost) if removed[-1] else own
            digest.append(hashlib.sha256(b" ".join(own)).hexdigest())
        return pd.DataFrame({"ord": block.ids, "n_words": np.diff(base), "n_removed": removed, "kept_sha256": digest})


def repeated_windows(cohort: DataFrame, width: int = 20, id: str = "id", text: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept_sha256), one row per cohort row.

    A word is removed where a window of `width` words of its text covers it whose words also
    start earlier: in a text with a smaller id, or before in the same text. Windows are judged
    on the input. The digest is that of the words that stay, joined by single spaces.

    Words are parted by ASCII white space. Recompression names runs of one symbol and pairs
    of a left and a right symbol, round after round; names and sides follow from what is
    named alone, so they agree across the cohort without a dictionary. A window's key is the
    interior symbol of the highest level with the smallest name; keys that occur twice reveal
    windows that may repeat, and 128-bit digests verify them, built from 128 bits of each
    word's bytes. A join a round to name symbols by number would shuffle every token, so the
    rounds run inside the tasks; names from content agree as such numbers would.

    Null, empty and short texts lose nothing. A null id counts as larger than any other. Rows
    with equal ids are one document; equal windows at one position of it do not remove each
    other. Rows that repeat an earlier text go whole. An empty cohort gives no rows; other
    columns are not read. Ids are whole numbers.
    """
    rows = find_repeats(cohort, lambda: Windows(width), "ord long, n_words long, n_removed long, kept_sha256 string", id, text)
    return rows.select(F.when(F.col("ord") != LAST_ID, F.col("ord")).alias("id"), "n_words", "n_removed", "kept_sha256")
