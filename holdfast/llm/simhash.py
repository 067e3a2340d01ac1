"""Near copies of texts by SimHash fingerprints and a binary trie self-join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.llm.common import judged, keep, ship
from holdfast.llm.graph import components, local_components

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
BITS = 36  # below the two blocks that agree: 64 - 16 - 12
FRONTIER = 500_000


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash of the word shingles of a text, as a signed number; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    width = min(shingle, len(words))
    first, last = (ends - sizes)[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    votes, n = np.zeros(64, dtype=np.int64), len(first)
    for at in range(0, n, 16384):
        h = np.array([digest(line[a:b], 42) for a, b in zip(first[at : at + 16384], last[at : at + 16384])], dtype=np.uint64)
        votes += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int(np.packbits(votes * 2 > n).view(">i8")[0])


def fingerprints(cohort: DataFrame, id: str = "id", text: str = "text", shingle: int = 3) -> DataFrame:
    """(id, digest, fp): one row per cohort row; words are parted by ASCII white space, A-Z
    lower-cased. `digest` is a 64-bit hash of the text as it is."""

    rows = cohort.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    found = judged(rows, "text", lambda texts: [fingerprint(t, shingle) for t in texts], "bigint", pa.int64())
    return found.select("row.id", F.xxhash64("row.text").alias("digest"), F.col("value").alias("fp"))


def _ones(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


def trie_links(bucket: np.ndarray, rest: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join all entries of a bucket within `budget` differing bits of `rest`.

    The arrays are sorted by (bucket, rest), so that a trie node is a range of them. Pairs of
    nodes are taken down together, bit by bit: a pair of different children spends one bit of
    the budget and is left as soon as that is overspent. Pairs that meet are merged into
    components at once; what is returned joins each entry to the first of its component.
    """
    n = len(rest)
    edge = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    lo, hi = edge, np.r_[edge[1:], n]
    many = hi - lo > 1
    lo, hi = lo[many], hi[many]
    lab, found, held = np.arange(n), [], 0
    stack = [(BITS - 1, lo, hi, lo, hi, np.zeros(len(lo), dtype=np.int64))]
    while stack:
        bit, al, ah, bl, bh, err = stack.pop()
        if len(al) > FRONTIER:
            cut = len(al) // 2
            stack.append((bit, al[cut:], ah[cut:], bl[cut:], bh[cut:], err[cut:]))
            stack.append((bit, al[:cut], ah[:cut], bl[:cut], bh[:cut], err[:cut]))
            continue
        single = (ah - al == 1) & (bh - bl == 1)
        if single.any():
            i, j = al[single], bl[single]
            near = (i != j) & (_ones(rest[i] ^ rest[j]) <= budget)
            found.append((i[near], j[near]))
            held += int(near.sum())
            if held > FRONTIER:
                lab = local_components(n, np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found]), lab)
                found, held = [], 0
            al, ah, bl, bh, err = al[~single], ah[~single], bl[~single], bh[~single], err[~single]
        if not len(al):
            continue
        # what both nodes still differ in at most is within the budget: everything links
        if bit < budget:
            full = err + bit + 1 <= budget
            for x, y in ((al, ah), (bl, bh)):
                size = (y - x)[full]
                member = np.repeat(x[full], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                found.append((np.repeat(al[full], size), member))
                held += len(member)
            al, ah, bl, bh, err = al[~full], ah[~full], bl[~full], bh[~full], err[~full]
            if not len(al):
                continue
        ones = np.r_[0, np.cumsum((rest >> bit) & 1)]
        am, bm = ah - (ones[ah] - ones[al]), bh - (ones[bh] - ones[bl])
        same = (al == bl) & (ah == bh)
        parts = [
            (al, am, bl, bm, err), (am, ah, bm, bh, err), (al, am, bm, bh, err + 1),
            (am[~same], ah[~same], bl[~same], bm[~same], err[~same] + 1),
        ]
        nxt = [np.concatenate([p[k] for p in parts]) for k in range(5)]
        live = (nxt[1] > nxt[0]) & (nxt[3] > nxt[2]) & (nxt[4] <= budget)
        live &= ~((nxt[0] == nxt[2]) & (nxt[1] - nxt[0] == 1) & (nxt[3] - nxt[2] == 1))
        stack.append((bit - 1, *[x[live] for x in nxt]))
    if found:
        lab = local_components(n, np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found]), lab)
    moved = np.flatnonzero(lab != np.arange(n))
    return moved, lab[moved]


def _blocks() -> list:
    """The 16 ways in which a 16-bit block and a 12-bit block of the rest agree, as (key, rest)."""
    fp, out = F.col("fp"), []
    for i in range(4):
        low = 48 - 16 * i
        head = F.shiftrightunsigned(fp, low).bitwiseAND(F.lit(0xFFFF))
        # 48 bits without the block: what is above it moves down to meet what is below it
        below = fp.bitwiseAND(F.lit((1 << low) - 1)) if low else F.lit(0).cast("long")
        above = F.shiftleft(F.shiftrightunsigned(fp, low + 16), low) if i else F.lit(0).cast("long")
        left = above.bitwiseOR(below)
        for j in range(4):
            at = 36 - 12 * j
            mid = F.shiftrightunsigned(left, at).bitwiseAND(F.lit(0xFFF))
            under = left.bitwiseAND(F.lit((1 << at) - 1)) if at else F.lit(0).cast("long")
            over = F.shiftleft(F.shiftrightunsigned(left, at + 12), at) if j else F.lit(0).cast("long")
            key = F.lit((4 * i + j) << 28).cast("long").bitwiseOR(F.shiftleft(head.cast("long"), 12)).bitwiseOR(mid.cast("long"))
            out.append(F.struct(key.alias("key"), over.bitwiseOR(under).alias("rest")))
    return out


def fingerprint_links(fps: DataFrame, budget: int = 3) -> DataFrame:
    """Links (a, b) that join the distinct fingerprints `fp` within `budget` (3 at most) bits.

    Two fingerprints with 3 or fewer differing bits agree in one of four 16-bit blocks and,
    of the other 48 bits, in one of four 12-bit blocks. Each of the 16 combinations is a
    forest of tries whose roots are the values of both blocks; Spark deals the roots out and
    `trie_links` walks each trie against itself. A task holds one root at a time.
    """
    if not 0 <= budget <= 3:
        raise ValueError("the blocks hold for a budget of 0 to 3 bits")
    ship(fps.sparkSession)
    spread = fps.select("fp", F.explode(F.array(*_blocks())).alias("_at")).select("fp", "_at.*")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = []
        for rows in batches:
            key = rows["key"].to_numpy()
            cut = int(np.searchsorted(key, key[-1])) if len(key) else 0
            if cut == 0 and held and len(key) and held[-1]["key"].iloc[-1] == key[0]:
                held.append(rows)
                continue
            held.append(rows.iloc[:cut])
            yield solve(held)
            held = [rows.iloc[cut:]]
        if held:
            yield solve(held)

    def solve(parts: list[pd.DataFrame]) -> pd.DataFrame:
        rows = pd.concat(parts)
        fp = rows["fp"].to_numpy()
        a, b = trie_links(rows["key"].to_numpy(), rows["rest"].to_numpy(), budget) if len(fp) else ([], [])
        return pd.DataFrame({"a": fp[a] if len(a) else np.zeros(0, np.int64), "b": fp[b] if len(a) else np.zeros(0, np.int64)})

    dealt = spread.repartition("key").sortWithinPartitions("key", "rest")
    return dealt.mapInPandas(run, "a long, b long").distinct()


def _grouped(cohort: DataFrame, budget: int, shingle: int, id: str, text: str) -> DataFrame:
    """(id, digest, fp, root, entity_id), one row per cohort row; `root` tells groups apart."""
    prints = keep(fingerprints(cohort, id, text, shingle), "fingerprints")
    fps = keep(prints.groupBy("fp").agg(F.min("id").alias("low")), "nodes")
    roots = components(fingerprint_links(fps, budget))
    node = fps.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    low = node.groupBy("root").agg(F.min("low").alias("entity_id"))
    named = keep(node.join(low, "root").select(F.col("fp").alias("_fp"), "root", "entity_id"), "entities")
    return prints.join(named, F.col("fp") == F.col("_fp")).drop("_fp")


def near_copies(cohort: DataFrame, budget: int = 3, shingle: int = 3, id: str = "id", text: str = "text") -> DataFrame:
    """(id, fp, entity_id), one row per cohort row: near copies are one entity.

    `entity_id` is the smallest id reachable over links of `budget` or fewer differing bits,
    the row's own id included. As an entity it keeps copies on one side of a holdout.
    Null, empty and blank texts have fingerprint 0 and link like any other. A row with a
    null id takes part; it gives its group no id, and a group of such rows alone has a null
    one. Repeated ids give a row each. Other columns are not read.

    Rows with equal fingerprints are one node, so copies cost one row however many they are.
    """
    return _grouped(cohort, budget, shingle, id, text).select("id", "fp", "entity_id")


def without_near_copies(cohort: DataFrame, budget: int = 3, shingle: int = 3, id: str = "id", text: str = "text") -> DataFrame:
    """The cohort's rows, all columns, one row of each group of `near_copies`.

    It is the row with the smallest id, null ids last. Of rows that share that id within the
    group the text with the smallest digest stays, of rows that share the text as well the
    one whose other columns come first. An id repeated in several groups is judged in each.
    An empty cohort gives no rows.
    """
    named = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("")).alias("_id")
    heads = (
        _grouped(cohort, budget, shingle, id, text).where("id <=> entity_id")
        .groupBy("root", "id").agg(F.min("digest").alias("_digest")).select(named(F.col("id")), "_digest")
    )
    whole = cohort.select(
        F.struct(*[F.col(f"`{c}`") for c in cohort.columns]).alias("row"), named(F.col(id)), F.xxhash64(F.col(text).cast("string")).alias("_digest")
    )
    others = [F.col(f"row.`{c}`") for c, kind in cohort.dtypes if c not in (id, text) and "map<" not in kind and "variant" not in kind]
    one = whole.join(heads, ["_id", "_digest"], "left_semi").groupBy("_id", "_digest").agg(F.min_by("row", F.struct(F.lit(0), *others)).alias("row"))
    return one.select("row.*")
