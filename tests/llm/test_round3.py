"""Centroid clusters, spelling variants and shared lines against plain versions."""

import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from holdfast.llm.clusters import apexes, base_simplex, cluster_rows, nearest, possible, squared
from holdfast.llm.lines import without_shared_lines
from holdfast.llm.mphash import DIGEST, DigestIndex
from holdfast.llm.spelling import LONG, spelling_groups


def plain_clusters(rows, k, rounds, dims):
    kept = [(i, [int(np.floor(1024 * np.float64(x))) for x in v]) for i, v in rows if v and len(v) == dims and all(x is not None and np.isfinite(x) and abs(x) < 2**17 for x in v)]
    kept.sort(key=lambda r: (sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centres = [q for _, q in kept[:k]]
    near = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, c)), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        home = [near(q)[1] for _, q in kept]
        groups = [[q for (_, q), h in zip(kept, home) if h == j] for j in range(len(centres))]
        centres = [[sum(x) // len(g) for x in zip(*g)] if g else c for g, c in zip(groups, centres)]
    out = [(i, *near(q)) for i, q in kept]
    of = {j: sum(d for _, d, c in out if c == j) for _, _, j in out}
    return sorted((str(i), c, d, of[c], sum(of.values()), tuple(centres[c])) for i, d, c in out)


def got_clusters(frame, **how):
    return sorted((str(r.id), r.cluster, r.distance, r.cluster_inertia, r.inertia, tuple(r.centroid)) for r in cluster_rows(frame, **how).collect())


@pytest.mark.parametrize("dims", [1, 2, 5])
def test_clusters_equal_plain_rounds(make, dims):
    rng = np.random.default_rng(dims)
    rows = [(i, [float(x) for x in rng.normal(size=dims).round(2) + 3 * (i % 3)]) for i in range(120)]
    rows += [(200 + i, [1.5] * dims) for i in range(40)] + [(7, [0.25] * dims), (7, [0.25] * dims), (None, [-1e-9] * dims), (None, None), (300, []), (301, [None] * dims)]
    rows += [(302, [float("nan")] * dims), (303, [float("inf")] * dims), (304, [2.0**17] * dims), (305, [0.0] * (dims + 1)), (306, [-131071.0] * dims)]
    frame = make([(*r, "x", 1) for r in rows], "id bigint, features array<double>, cluster string, q int")
    assert got_clusters(frame, clusters=5, rounds=4, dims=dims, pivots=4) == plain_clusters(rows, 5, 4, dims)


def test_clusters_of_few_equal_or_no_rows(make):
    same = [(i, [0.5, -0.5]) for i in range(6)]
    for rows in (same, same[:3], []):
        frame = make(rows, "id bigint, features array<float>")
        assert got_clusters(frame, dims=2) == plain_clusters(rows, 8, 10, 2)


def test_clusters_accept_text_ids(make):
    assert len(got_clusters(make([("a", [1.0]), ("b", [2.0]), (None, [3.0])], "id string, features array<double>"), dims=1)) == 3


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 6), st.sampled_from([1, 3, 40, 2**26]), st.booleans())
def test_bounds_never_lose_the_nearest_centre(seed, dims, size, flat):
    rng = np.random.default_rng(seed)
    q = rng.integers(-size, size + 1, (60, dims))
    if flat:
        q[:, 1:] = q[:, :1]
    centres = q[rng.integers(0, 60, 6)] + rng.integers(-1, 2, (6, dims))
    points, base = base_simplex(np.unique(q[:20], axis=0), 4)
    rows, tips = (apexes(squared(x, points), base) for x in (q, centres))
    exact = squared(q, centres)
    home, distance = nearest(q, rows, centres, tips)
    assert (home == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all()


def test_bounds_prune():
    rng = np.random.default_rng(1)
    centres = rng.integers(-1000, 1000, (8, 64))
    q = centres[rng.integers(0, 8, 500)] + rng.integers(-60, 60, (500, 64))
    points, base = base_simplex(centres, 6)
    open_ = possible(apexes(squared(q, points), base), apexes(squared(centres, points), base))
    assert open_.sum() < 0.5 * open_.size


def plain_words(rows, noise):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    count = Counter()
    for i, t in rows:
        for w in "".join(c if "a" <= c <= "z" or "À" <= c <= "ÿ" else " " for c in (t or "").translate(fold)).split():
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            count[w[: h % len(w)] + w[h % len(w) + 1 :] if noise and h % noise == 0 else w] += 1
    words = {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    out = {}
    for w, n in words.items():
        found = [o for o in words if o != w and near(w, o)]
        best = min(found, key=lambda o: (-words[o], o), default=None)
        out[w] = (best if best and words[best] >= 2 * n else None, n, len(found))

    def root(w):
        while out[w][0]:
            w = out[w][0]
        return w

    return sorted((w, str(f), root(w), n, k, f and words[f]) for w, (f, n, k) in out.items())


def got_words(frame, **how):
    return sorted((r.word, str(r.form), r.root, r.n, r.n_near, r.form_n) for r in spelling_groups(frame, **how).collect())


def word_texts():
    rng = np.random.default_rng(3)
    base = ["running", "runner", "Straße", "éclair", "ÀÉÎÕÜ", "aaaaa", "aaaaaa", "house", "mouse", "houses"]
    rows = []
    for i in range(300):
        w = base[int(rng.integers(0, len(base)) * rng.random())]
        if rng.random() < 0.4:
            at = int(rng.integers(0, len(w)))
            w = w[:at] + "aeñ"[int(rng.integers(0, 3))] + w[at + int(rng.integers(0, 2)) :]
        rows.append((i % 50, f"{w} {w.upper()}-{w},x" if i % 3 else w))
    long = "ab" * 40
    rows += [(900, " ".join([long] * 9 + [long[:-1]] * 4 + [long + "c"] * 3 + ["c" + long[1:]] * 3 + ["q" * LONG] * 9 + ["q" * (LONG + 1)] * 3 + ["q" * (LONG - 1) + "r"] * 3))]
    return rows + [(None, "running runing " * 5), (901, None), (902, ""), (903, " \n\t"), (900, "house"), (900, "house")]


@pytest.mark.parametrize("noise", [None, 3])
@pytest.mark.parametrize("symbols", [2, None])
def test_words_equal_plain_version(make, noise, symbols):
    rows = word_texts()
    frame = make([(*r, "w", 1) for r in rows], "id bigint, text string, word string, n int")
    assert got_words(frame, noise=noise, symbols=symbols) == plain_words(rows, noise)


def test_words_on_odd_and_empty_cohorts(odd, none):
    assert got_words(none) == []
    rows = [(r.id, r.text) for r in odd.collect()]
    assert got_words(odd, noise=5) == plain_words(rows, 5)


def test_a_very_long_run_of_letters(make):
    run = "abcdefghij" * 30_000
    got = got_words(make([(1, f"{run} {run} {run} {run} {run} {run} {run[:-1]} {run[:-1]} {run[:-1]}")], "id int, text string"))
    assert [(r[0] == run, r[1] == run, r[3], r[4]) for r in got] == [(False, True, 3, 1), (True, False, 6, 1)]


def plain_lines(rows, least, shortest):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda s: s.strip(" \t\n\x0b\x0c\r").translate(fold)
    order = lambda i: (i is not None, i or 0)
    held = {}
    for i, t in rows:
        for k in {key(s) for s in (t or "").split("\n")}:
            if len(k) >= shortest:
                held.setdefault(k, []).append(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [s for s in lines if len(h := held.get(key(s), [])) < least or order(max(h, key=order)) == order(i)]
        out.append((str(i), "\n".join(stay), len(lines), len(lines) - len(stay)))
    return sorted(out)


def got_lines(frame, **how):
    return sorted((str(r.id), r.text, r.n_lines, r.n_dropped) for r in without_shared_lines(frame, **how).collect())


def line_texts():
    rng = np.random.default_rng(4)
    pool = [f"Line number {i} of the pool, É" for i in range(12)] + ["short", "", " nineteen letters ...", " \t twenty characters..\r", "TWENTY characters.."]
    rows = [(int(i * 7 % 40), "\n".join(pool[int(j)] for j in rng.integers(0, len(pool), int(rng.integers(0, 9))))) for i in range(60)]
    hot = "this line stands in a third of all rows or more"
    rows += [(100 + i, f"{hot}\nown line of row {i} and no other\n{hot.upper()}  ") for i in range(40)]
    return rows + [(None, hot), (None, pool[0] + "\n" + hot), (None, None), (500, ""), (501, "\n\n"), (-5, hot + "\n" * 3), (139, rows[-1][1]), (139, rows[-1][1])]


@pytest.mark.parametrize("least", [2, 3, 50])
def test_lines_equal_plain_version(make, least):
    rows = line_texts()
    frame = make([(*r, "x", 1, b"") for r in rows], "id bigint, text string, node string, ord int, drops binary")
    assert got_lines(frame, least=least) == plain_lines(rows, least, 20)


def test_lines_of_null_ids_only(make):
    rows = [(None, "a line of twenty characters or more")] * 4
    assert got_lines(make(rows, "id bigint, text string")) == plain_lines(rows, 3, 20)


def test_lines_on_odd_and_empty_cohorts(odd, none):
    assert got_lines(none) == []
    rows = [(r.id, r.text) for r in odd.collect()]
    assert got_lines(odd, least=2) == plain_lines(rows, 2, 20)


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 60_000])
def test_minimal_perfect_hash(n):
    rng = np.random.default_rng(n)
    keys = np.zeros(n, DIGEST)
    keys["lo"], keys["hi"] = rng.integers(0, 50 if n <= 1000 else 2**63, n), rng.integers(0, 2**63, n)
    counts, lasts = rng.integers(1, 400, n), rng.integers(-(2**62), 2**62, n)
    index = DigestIndex.build(keys, counts, lasts)
    assert sorted(index.slots(keys).tolist()) == list(range(n))
    got, last = index.probe(keys)
    assert (got == np.minimum(counts, 255)).all() and (last[counts > 1] == lasts[counts > 1]).all()
    other = keys.copy()
    other["hi"] ^= np.uint64(1 << 62)
    assert (index.probe(other)[0] == 0).all()
    assert 8 * len(index.words) <= 0.7 * n + 64
