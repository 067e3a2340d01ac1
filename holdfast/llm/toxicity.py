"""Toxicity of texts after a noisy-channel decoding of disguised words."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from holdfast.llm.common import judged, keep, ship

SAMPLE = 12_000  # labelled rows that the classifier is fitted on, at most
FEATURES = 4_000  # word forms that the classifier keeps, at most
LEAST_TEXTS = 3  # texts of y = 1 that a form is seen in
LEAST_Z = 2.72  # a form's log odds ratio in its standard errors
LEAST_ODDS = 3.0  # and the log odds ratio itself
LIKE = 0.05  # share of a target's rows that one content counts for, at most
FOLDS = 3  # parts of the training texts; each is measured with forms that the others taught
PRIOR = 0.05  # share of y = 1 that one row's worth of belief holds before any label

# What a sign may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c",
}

# The character model knows a to z and the lower-case letters of Latin-1; 0 is anything else.
KNOWN = [chr(c) for c in (*range(97, 123), *range(0xDF, 0x100)) if chr(c).isalpha()]
K = len(KNOWN) + 1
PLACE = {c: i + 1 for i, c in enumerate(KNOWN)}
_TABLE = np.zeros(257, dtype=np.int64)
_TABLE[[ord(c) for c in KNOWN]] = range(1, K)

WORDS = re.compile(r"[^\W\d_]+")
TRIPLE = re.compile(r"([^\W\d_])\1\1")
SINGLES = re.compile(r"(?:[\w@$!|+€(][.\-_*]){2,}[\w@$!|+€(]\W*")
SIGNS = frozenset(LEET)
# Punctuation before a word, the word, punctuation behind it; "!" and "$$$" behind are no signs.
EDGES = re.compile(r"((?:[^\w@$!|+€(]|_)*)(.*?)((?:[^\w@$|+€(]|_|\${3,})*)", re.S)

# Classes of characters for a first look at a text; SOFT signs may also stand around a character.
SPACE, JOIN, SOFT, SIGN, LETTER = 1, 2, 3, 4, 5
_CLASS = np.zeros(0x10000, dtype=np.uint8)
_CLASS[[c for c in range(0x10000) if chr(c).isalpha()]] = LETTER
_CLASS[[c for c in range(0x10000) if chr(c).isspace()]] = SPACE
_CLASS[[ord(c) for c in ".-_*"]] = JOIN
_CLASS[[ord(c) for c in SIGNS]] = SIGN
_CLASS[[ord(c) for c in "!("]] = SOFT


def suspect(text: str) -> bool:
    """Is there anything that `restore` may decode: a letter beside a sign, a letter three times,
    three single characters in a row, whatever white space parts them and punctuation stands
    around them, or three parted by joining signs?"""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    if len(codes) < 3:
        return False
    if codes.max() >= len(_CLASS):
        return True
    kind = np.full(len(codes) + 2, SPACE, dtype=np.uint8)
    kind[1:-1] = _CLASS.take(codes)
    letter, sign, space, join = kind == LETTER, (kind == SIGN) | (kind == SOFT), kind == SPACE, kind == JOIN
    if (letter[1:] & sign[:-1]).any() or (letter[:-1] & sign[1:]).any():
        return True
    same = codes[1:] == codes[:-1]
    if (same[1:] & same[:-1] & letter[1:-3]).any():
        return True
    if (join[:-2] & join[2:]).any():
        one = ~space & ~join
        one[1:-1] |= codes == ord("_")
        if (one[:-4] & join[1:-3] & one[2:-2] & join[3:-1] & one[4:]).any():
            return True
    start = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    ends = np.append(start[1:], len(kind))
    total = np.zeros(len(kind) + 1, dtype=np.int32)
    np.cumsum(kind >= SIGN, dtype=np.int32, out=total[1:])
    single = total[ends] - total[start] <= 1
    if not (single[:-2] & single[1:-1] & single[2:]).any():
        return False
    np.cumsum(kind >= SOFT, dtype=np.int32, out=total[1:])
    single &= total[ends] > total[start]
    return bool((single[:-2] & single[1:-1] & single[2:]).any())


def count_trigrams(texts: list[str]) -> np.ndarray:
    """How often each three characters of the model's alphabet follow each other."""
    total = np.zeros(K**3, dtype=np.int64)
    held, size = [], 0
    for t in [*texts, None]:
        if t is not None:
            held.append(t.lower())
            size += len(t)
        if held and (t is None or size > 500_000):
            codes = np.frombuffer("\n\n".join(held).encode("utf-32-le", "surrogatepass"), dtype="<u4")
            at = np.r_[0, 0, _TABLE[np.minimum(codes, 256)], 0]
            total += np.bincount((at[:-2] * K + at[1:-1]) * K + at[2:], minlength=K**3)
            held, size = [], 0
    return total


class CharacterModel:
    """log P(c | a, b), interpolated from three to one character; text is the channel's source."""

    def __init__(self, counts: np.ndarray, strength: float = 5.0):
        n3 = counts.reshape(K, K, K).astype(np.float64)
        n2, n1 = n3.sum(axis=0), n3.sum(axis=(0, 1))
        p1 = (n1 + 1) / (n1.sum() + K)
        p2 = (n2 + strength * p1) / (n2.sum(axis=1, keepdims=True) + strength)
        p3 = (n3 + strength * p2[None]) / (n3.sum(axis=2, keepdims=True) + strength)
        self.cost = -np.log(p3).astype(np.float32)
        self._memo: dict[str, str] = {}
        self._words: dict[str, str] = {}

    def decode(self, span: str) -> str:
        """The likeliest text behind a disguised span, by Viterbi over its character lattice.

        Each run of one letter may stand for one or two of it, "(" at the front for itself, each sign for the letters it
        resembles or for itself, each separator between single characters for nothing or for
        a word boundary. A state is the last two characters.
        """
        if span in self._memo:
            return self._memo[span]
        best = {(0, 0): (0.0, None)}
        for options in _lattice(span):
            nxt: dict = {}
            for state, (spent, back) in best.items():
                for out, price in options:
                    a, b, total = *state, spent + price
                    for c in out:
                        i = PLACE.get(c, 0)
                        total += float(self.cost[a, b, i])
                        a, b = b, i
                    if (a, b) not in nxt or total < nxt[a, b][0]:
                        nxt[a, b] = (total, (back, out))
            best = nxt
        _, back = min(((s + float(self.cost[a, b, 0]), back) for (a, b), (s, back) in best.items()), key=lambda x: x[0])
        parts = []
        while back:
            back, out = back
            parts.append(out)
        if len(self._memo) > 100_000:
            self._memo.clear()
        self._memo[span] = done = "".join(reversed(parts))
        return done

    def restore(self, text: str) -> str:
        """Lower-cased text with its disguised words decoded; other words stay as they are."""
        text = text.lower()
        if not suspect(text):
            return text
        out, single, known = [], [], self._words
        lead = ""
        for word in text.split():
            head, core, tail = ("", word, "") if len(word) == 1 else _edges(word)
            if len(core) == 1 and (core.isalpha() or core in SIGNS):
                if head and single:
                    out.extend(self._singles(single, lead))
                    single = []
                lead = lead if single else head
                single.append(core)
                if tail:
                    out.extend(self._singles(single, lead, tail))
                    single = []
                continue
            if single:
                out.extend(self._singles(single, lead))
                single = []
            out.append(known.get(word) or self._word(word))
        return " ".join([*out, *self._singles(single, lead)])

    def _singles(self, single: list[str], lead: str = "", tail: str = "") -> list[str]:
        done = [self.decode(" ".join(single))] if len(single) > 2 and len(set(single)) > 1 else single
        return [lead + " ".join(done) + tail] if single else []

    def _word(self, word: str) -> str:
        head, core, tail = _edges(word)
        done = word
        if core.isalpha():
            if TRIPLE.search(core):
                done = head + self.decode(core) + tail
        elif SINGLES.fullmatch(core) and any(c.isalpha() for c in core) or _disguised(core):
            found = self.decode(core)
            # a plain word behind "(" stays whole unless that stands for a letter
            if not (found[0] == core[0] == "(" and core[1:].isalpha() and not TRIPLE.search(core)):
                done = head + found + tail
        if len(self._words) > 100_000:
            self._words.clear()
        self._words[word] = done
        return done


def _edges(word: str) -> tuple[str, str, str]:
    """Punctuation before a word, the word, punctuation behind it. "(" is punctuation before a
    single character and where ")" closes it, else it may be a sign."""
    head, core, tail = EDGES.fullmatch(word).groups()
    if core[:1] == "(" and len(core) > 1 and (len(core) == 2 or ")" in tail):
        inner = EDGES.fullmatch(core[1:]).groups()
        return head + "(" + inner[0], inner[1], inner[2] + tail
    return head, core, tail


def _disguised(word: str) -> bool:
    """Letters with signs among them, a third letters at least."""
    letters = sum(map(str.isalpha, word))
    return letters > 0 and letters * 3 >= len(word) and all(c.isalpha() or c in SIGNS for c in word)


def _lattice(span: str) -> list[list[tuple[str, float]]]:
    spaced = len(span) > 2 and all(not c.isalnum() and c not in SIGNS for c in span[1::2])
    options, i = [], 0
    while i < len(span):
        c, j = span[i], i + 1
        if c.isalpha():
            while j < len(span) and span[j] == c:
                j += 1
            n = j - i
            options.append([(c, 0.0)] if n == 1 else [(c * 2, 0.0), (c, 2.0)] if n == 2 else [(c, 1.0), (c * 2, 1.0)])
        elif c in SIGNS:
            options.append([(x, 0.5) for x in LEET[c]] + [(c, 1.0 if c == "(" and not i else 8.0)])
        elif spaced:
            options.append([("", 0.0), (" ", 1.5)])
        else:
            options.append([(c, 0.0)])
        i = j
    return options


def word_forms(word: str) -> list[str]:
    """A word and its openings of 4 to 6 letters, marked by a star."""
    return [word, *(word[:n] + "*" for n in (4, 5, 6) if len(word) >= n)]


class Lexicon:
    """Weights of word forms, and a logistic curve over a text's hits."""

    def __init__(self, weights: dict[str, float], curve: np.ndarray | None = None):
        self.weights, self.curve = weights, curve
        self.heads = frozenset(f.rstrip("*")[:3] for f in weights)

    def hits(self, text: str) -> tuple[float, float, float]:
        """Of a restored text: log of hit words, of their weight, and of hits per 1000 words."""
        words, heads, weights = WORDS.findall(text), self.heads, self.weights
        found = [max((weights.get(f, 0.0) for f in word_forms(w))) for w in words if w[:3] in heads]
        found = [x for x in found if x > 0]
        return math.log1p(len(found)), math.log1p(sum(found)), math.log1p(1000 * len(found) / max(1, len(words)))

    def fit(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> None:
        """Ridge logistic regression by Newton steps; without both classes the base rate."""
        full = np.c_[np.ones(len(x)), x]
        w = np.zeros(full.shape[1])
        rate = (y.sum() + PRIOR) / (len(y) + 1)
        w[0] = math.log(rate / (1 - rate))
        if 0 < y.sum() < len(y):
            penalty = np.diag([0.0] + [ridge] * x.shape[1])
            for _ in range(40):
                p = 1 / (1 + np.exp(-np.clip(full @ w, -30, 30)))
                step = np.linalg.solve((full * (p * (1 - p))[:, None]).T @ full + penalty + 1e-6 * np.eye(len(w)), full.T @ (y - p) - penalty @ w)
                w += np.clip(step, -4, 4)
        self.curve = w

    def score(self, text: str) -> float:
        z = float(self.curve[0] + np.dot(self.curve[1:], self.hits(text)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fit_characters(cohort: DataFrame, text: str = "text") -> CharacterModel:
    """The character model from the counts of all texts; K^3 counts reach the driver at most."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(K**3, dtype=np.int64)
        for rows in batches:
            total += count_trigrams([t for t in rows["text"] if t])
        at = np.flatnonzero(total)
        yield pd.DataFrame({"code": at, "n": total[at]})

    counts = cohort.select(F.col(text).cast("string").alias("text")).mapInPandas(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros(K**3)
    total[counts["code"].to_numpy(dtype=np.int64)] = counts["n"].to_numpy()
    return CharacterModel(total)


def content_key(text: Column) -> Column:
    """The smallest digest of a text's five-word runs: near copies mostly have one and the same."""
    bind = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))  # evaluated once, not once per element
    runs = lambda words: F.array_min(F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - 4, F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice(words, i, 5), " "))))
    return bind(F.split(F.trim(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}]+", " "))), " "), runs)


def fit_lexicon(cohort: DataFrame, targets: DataFrame, model: CharacterModel, id: str = "id", text: str = "text") -> Lexicon:
    """Word forms that tell y = 1 from y = 0, on SAMPLE labelled rows by smallest digest.

    Sampled texts with one content key count for a share LIKE of their target's rows at most,
    and once at least, however often they were copied: a text of many copies would teach each
    of its words and leave no room for those that tell. The curve is fitted on hits
    of forms from the other FOLDS of contents, since a text holds words that only it and its
    like have taught, and new texts do not.
    """
    known = (
        targets.where("id is not null and y is not null").groupBy("id").agg(F.max("y").cast("int").alias("y"))
        .orderBy(F.xxhash64("id", F.lit(11)), "id").limit(SAMPLE).select(F.col("id").alias("_id"), "y")
    )
    # SAMPLE rows at most, so broadcasting is bounded
    rows = cohort.select(F.col(id).alias("_key"), F.col(text).cast("string").alias("text")).join(F.broadcast(known), F.col("_key") == F.col("_id")).select("text", "y")
    rows = rows.select("y", content_key(F.col("text")).alias("key"), F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))
    rows = keep(rows, "training")
    # a content counts for a share of its target's rows at most, smallest digests first
    nth = F.row_number().over(Window.partitionBy("key", "y").orderBy(F.xxhash64("text"), "row"))
    most = rows.groupBy("y").agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) * LIKE)).alias("most"))
    one = rows.select("y", F.col("row").alias("_row"), nth.alias("nth")).join(F.broadcast(most), "y").where("nth <= most").select("_row")
    rows = rows.join(one, F.col("row") == F.col("_row")).select("y", F.pmod("key", F.lit(FOLDS)).cast("int").alias("fold"), "text")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            yield part.assign(text=[model.restore(t) for t in part["text"]])

    rows = keep(rows.mapInPandas(decode, rows.schema), "training")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            seen: dict[tuple[int, int], Counter] = {(f, y): Counter() for f in range(FOLDS) for y in (0, 1)}
            for t, label, fold in zip(part["text"], part["y"], part["fold"]):
                forms = {""}
                for word in set(WORDS.findall(t)):
                    forms.update(word_forms(word))
                seen[fold, int(label != 0)].update(forms)
            for (fold, y), forms in seen.items():
                yield pd.DataFrame({"form": list(forms), "fold": fold, "y": y, "n": list(forms.values())}, columns=["form", "fold", "y", "n"]).astype({"form": object, "fold": "int32", "y": "int32", "n": "int64"})

    some = (F.col("form") == "") | (sum(F.col(f"n{f}1") for f in range(FOLDS)) >= LEAST_TEXTS)
    of = lambda f, y: F.sum(F.when((F.col("fold") == f) & (F.col("y") == y), F.col("n")).otherwise(0)).alias(f"n{f}{y}")
    forms = keep(rows.mapInPandas(count, "form string, fold int, y int, n long").groupBy("form").agg(*[of(f, y) for f in range(FOLDS) for y in (0, 1)]).where(some), "forms")
    lexicons = [_lexicon(forms, [f for f in range(FOLDS) if f != left]) for left in range(FOLDS)]

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            hits = [lexicons[f].hits(t) for t, f in zip(part["text"], part["fold"])]
            yield pd.DataFrame(hits, columns=["a", "b", "c"]).assign(y=(part["y"].to_numpy() != 0).astype(np.int32))

    table = rows.mapInPandas(measure, "a double, b double, c double, y int").toPandas().sort_values(["a", "b", "c", "y"])
    lexicon = _lexicon(forms, list(range(FOLDS)))
    lexicon.fit(table[["a", "b", "c"]].to_numpy(), table["y"].to_numpy(dtype=np.float64))
    return lexicon


def _lexicon(forms: DataFrame, folds: list[int]) -> Lexicon:
    """The strongest FEATURES forms from the counts of these folds; a form weighs the lower bound of its log odds ratio."""
    tally = lambda y: sum((F.col(f"n{f}{y}") for f in folds), F.lit(0))
    counts = forms.select("form", tally(1).alias("pos"), tally(0).alias("neg"))
    whole = counts.where("form = ''").first()
    pos, neg = (whole["pos"], whole["neg"]) if whole else (0, 0)
    odds = F.log((F.col("pos") + 0.5) / (pos + 1)) - F.log((F.col("neg") + 0.5) / (neg + 1))
    error = F.sqrt(1 / (F.col("pos") + 0.5) + 1 / (F.col("neg") + 0.5))
    known = counts.where(f"form <> '' and pos >= {LEAST_TEXTS}").withColumn("odds", odds).withColumn("error", error).withColumn("z", F.col("odds") / F.col("error"))
    best = known.where((F.col("z") >= LEAST_Z) & (F.col("odds") >= LEAST_ODDS)).orderBy(F.desc("z"), "form").limit(FEATURES)
    return Lexicon({r["form"]: r["odds"] - 2 * r["error"] for r in best.collect()})


def toxicity(cohort: DataFrame, targets: DataFrame, least: float = 0.3, id: str = "id", text: str = "text", carry: bool = False) -> DataFrame:
    """(id, score, predicted), one row per cohort row; with `carry` instead the cohort's rows,
    all columns, that score under `least`.

    `targets` holds (id, y) of the training side only: the caller keeps held-out rows away.
    The character model counts every text of the cohort. Disguised spans (signs for letters,
    letters parted by spaces or dots, letters repeated) are decoded by Viterbi under it, and
    the restored text is scored: word forms with a strong log odds ratio in the training rows
    are hits, and a logistic curve over the hits gives the score. Nothing but the text enters.

    Null and empty texts are scored as texts without hits. Null ids and repeated ids give a
    row each; a null y or an id without text teaches nothing; of several y of an id the
    largest holds. Without both classes every text gets the base rate, without any training
    row PRIOR, so that nothing is rejected. An empty cohort gives no rows. Texts are read
    whole, in any language.
    """
    ship(cohort.sparkSession)
    model = fit_characters(cohort, text)
    lexicon = fit_lexicon(cohort, targets, model, id, text)
    rows = cohort if carry else cohort.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    scored = judged(rows, text if carry else "text", lambda texts: [lexicon.score(model.restore(t or "")) for t in texts], "double", pa.float64())
    if carry:
        return scored.where(F.col("value") < least).select("row.*")
    return scored.select("row.id", F.col("value").alias("score"), (F.col("value") >= least).cast("int").alias("predicted"))
