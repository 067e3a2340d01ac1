"""Spelling variants in the words of a cohort, found through words over a reduced alphabet."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.llm.common import keep, ship

# Letters: a to z and U+00C0 to U+00FF; A to Z are folded before.
LETTERS = "".join(map(chr, [*range(0x61, 0x7B), *range(0xC0, 0x100)]))
SYMBOLS = "0123456789abcdefghijklmnopqrstuv"
# Words beyond this length meet on their halves: a neighbourhood grows with the square of it.
LONG = 64
FLUSH = 200_000  # words counted in a task before their counts are sent on
WHOLE = 4_000_000  # characters from which on runs are taken one by one, not as a list


def word_counts(cohort: DataFrame, shortest: int, noise: int | None, id: str, text: str) -> DataFrame:
    """(word, n): how often each word of `shortest` letters or more occurs in all texts."""
    ship(cohort.sparkSession)
    runs = re.compile("[a-zÀ-ÿ]{%d,}" % shortest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        for batch in batches:
            for ident, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                plain = value.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
                found = Counter(runs.findall(plain) if len(plain) < WHOLE else (m[0] for m in runs.finditer(plain)))
                if noise:
                    seed = zlib.crc32(f"{ident}:".encode())
                    for word in list(found):
                        h = zlib.crc32(word.encode(), seed)
                        if h % noise == 0:
                            at, n = h % len(word), found.pop(word)
                            total[word[:at] + word[at + 1 :]] += n
                total.update(found)
                if len(total) >= FLUSH:
                    yield packed(total)
                    total = Counter()
        yield packed(total)

    def packed(total: Counter[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    texts = cohort.select(F.coalesce(F.col(id).cast("string"), F.lit("")).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.length("word") >= shortest)


def reduced(word: Column, symbols: int) -> Column:
    """The word over `symbols` symbols: each letter becomes its digest's remainder."""
    return F.translate(word, LETTERS, "".join(SYMBOLS[zlib.crc32(c.encode()) % symbols] for c in LETTERS))


def neighbourhood(red: Column, symbols: int) -> Column:
    """The reduced word and all that one edit makes of it, seen from one end of each pair.

    Edits have two ends. Deletions are listed from the longer word (insertions from the
    shorter one would find the same pairs again), replacements from the smaller symbol.
    """
    at = F.sequence(F.lit(1), F.length(red))
    head, tail = (lambda i: F.substring(red, F.lit(1), i - 1)), (lambda i: F.substring(red, i + 1, F.length(red)))
    every = F.array(*[F.lit(s) for s in SYMBOLS[:symbols]])
    cuts = F.array_distinct(F.transform(at, lambda i: F.concat(head(i), tail(i))))
    higher = lambda i: F.filter(every, lambda s: s > F.substring(red, i, F.lit(1)))
    swaps = F.flatten(F.transform(at, lambda i: F.transform(higher(i), lambda s: F.concat(head(i), s, tail(i)))))
    return F.concat(F.array(red), cuts, swaps)


def near_words(words: DataFrame, symbols: int) -> DataFrame:
    """(a, a_n, b, b_n): each pair of words that differ by one inserted, deleted or replaced letter, once."""
    sized = words.withColumn("red", reduced(F.col("word"), symbols)).withColumn("len", F.length("word"))
    short = sized.where(F.col("len") <= LONG)
    left = short.select(F.col("word").alias("a"), F.col("n").alias("a_n"), "red", "len", F.explode(neighbourhood(F.col("red"), symbols)).alias("key"))
    right = short.select(F.col("word").alias("b"), F.col("n").alias("b_n"), F.col("red").alias("b_red"))
    # words with one reduced form meet twice; each other pair has one listing end
    once = (F.col("red") != F.col("key")) | (F.col("a") < F.col("b"))
    apart = F.levenshtein(F.col("a"), F.col("b"), 1) == 1
    pairs = left.join(right, F.col("key") == F.col("b_red")).where(once & apart).select("a", "a_n", "b", "b_n")
    return pairs.union(_near_long(sized.where(F.col("len") >= LONG).select("word", "n", "len")))


def _near_long(words: DataFrame) -> DataFrame:
    """Pairs whose longer word exceeds LONG letters: one edit leaves the first or the last half as it was."""
    half = lambda of: F.floor((of - 1) / 2).cast("int")

    def halves(of: Column) -> Column:
        size = F.length("word")
        ends = (F.substring("word", F.lit(1), half(of)), F.substring(F.col("word"), size - (of - half(of)) + 1, of))
        return F.array(*[F.concat(of.cast("string"), F.lit(f":{i}:"), F.md5(e)) for i, e in enumerate(ends)])

    left = words.where(F.col("len") > LONG).select(F.col("word").alias("a"), F.col("n").alias("a_n"), F.col("len").alias("a_len"), F.explode(halves(F.col("len"))).alias("key"))
    both = F.when(F.col("len") > LONG, F.concat(halves(F.col("len")), halves(F.col("len") + 1))).otherwise(halves(F.col("len") + 1))
    right = words.select(F.col("word").alias("b"), F.col("n").alias("b_n"), F.col("len").alias("b_len"), F.explode(both).alias("key"))
    once = (F.col("a_len") > F.col("b_len")) | (F.col("a") < F.col("b"))
    met = left.join(right, "key").where(once).select("a", "a_n", "b", "b_n")
    # the built-in distance takes time in the square of the length
    apart = F.pandas_udf(lambda a, b: pd.Series([one_edit(x, y) for x, y in zip(a, b)], dtype=bool), "boolean")
    return met.where(apart("a", "b")).distinct()


def one_edit(a: str, b: str) -> bool:
    """Whether two different words, the first no shorter, are one edit apart: what follows the first difference is equal."""
    low, high = 0, len(b)
    while low < high:  # longest common start
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a.startswith(b[:mid]) else (low, mid - 1)
    return len(a) - len(b) <= 1 and a[low + 1 :] == b[low + 1 - (len(a) - len(b)) :]


def last_forms(forms: DataFrame) -> DataFrame:
    """(word, root): where following `form` from word to word ends, for words that have one.

    Counts at least double along a chain, so chains have 63 steps at most, and each round
    doubles the steps taken: six rounds end the longest.
    """
    now = keep(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = now.select(F.col("word").alias("_at"), F.col("root").alias("_to"))
        new = keep(now.join(step, F.col("root") == F.col("_at"), "left").select("word", F.coalesce("_to", "root").alias("root"), F.col("_to").isNotNull().alias("_on")), "roots")
        now = new.drop("_on")
        if new.where("_on").isEmpty():
            return now


def spelling_groups(
    cohort: DataFrame, shortest: int = 5, least: int = 3, ratio: int = 2, noise: int | None = None, symbols: int | None = None, id: str = "id", text: str = "text"
) -> DataFrame:
    """(word, form, root, n, n_near, form_n): the words of all texts and the spelling each one varies.

    Words are maximal runs of the letters A to Z, a to z and U+00C0 to U+00FF, with A to Z
    in lower case, of `shortest` letters and `least` occurrences or more. Words are near if
    one inserted, deleted or replaced letter makes one of the other; `n_near` counts them. A
    word's `form` is its most frequent near word (ties: the first in code-point order) if
    that has `ratio` (2 at least) times its occurrences `n`, else null; `root` ends the chain of forms.

    `noise` plants errors for measurement: a run whose crc32 of `id:run` it divides loses
    the letter at that crc's remainder by the length (a null id counts as empty text).

    Null and empty texts hold no words; texts and runs of any length are read whole; every
    row counts, also those that repeat an id or a text; an empty cohort has no words. Other
    columns are not read.

    Letters are hashed to `symbols` symbols (by default 8, more for very large vocabularies,
    which changes the number of candidates and never the result). One-edit neighbours of
    reduced words meet the reduced vocabulary in an equi-join, and pairs are verified on the
    words themselves. Only counted words are shuffled, never texts.
    """
    if ratio < 2:
        raise ValueError("a form needs twice the occurrences at least, or chains may turn back")
    words = keep(word_counts(cohort, shortest, noise, id, text).where(F.col("n") >= least), "words")
    if symbols is None:
        count = words.count()
        symbols = 8 if count < 4_000_000 else 16 if count < 100_000_000 else 32
    pairs = keep(near_words(words, symbols), "near_words")
    links = pairs.select(F.col("a").alias("w"), F.col("b").alias("o"), F.col("b_n").alias("o_n")).union(pairs.select("b", "a", "a_n"))
    best = links.groupBy("w").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("o_n")).alias("less"), F.col("o").alias("form"))).alias("best"))
    joined = words.join(best, F.col("word") == F.col("w"), "left")
    holds = -F.col("best.less") >= F.col("n") * ratio
    named = keep(
        joined.select("word", F.when(holds, F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(holds, -F.col("best.less")).alias("form_n")),
        "forms",
    )
    roots = last_forms(named.where("form is not null")).withColumnRenamed("word", "_word")
    ends = named.join(roots, F.col("word") == F.col("_word"), "left")
    return ends.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
