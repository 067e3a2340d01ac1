"""Near copies and repeats against plain versions."""

import random

import brute
import numpy as np
import pytest

from holdfast.llm import repeats
from holdfast.llm.graph import components, local_components
from holdfast.llm.passages import RunIndex, repeated_passages
from holdfast.llm.recompression import Symbols, repeated_windows
from holdfast.llm.simhash import fingerprint_links, near_copies, trie_links
from holdfast.llm.vectors import near_vectors


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def ordered(rows):
    return sorted(rows, key=repr)


@pytest.fixture(scope="module")
def texts(spark):
    """Texts that share passages, copy each other, change words and repeat themselves."""
    draw = random.Random(5)
    word = lambda: "".join(draw.choice("abcdeéñ") for _ in range(draw.randint(1, 6)))
    pool = [[word() for _ in range(60)] for _ in range(8)]
    rows = []
    for i in range(160):
        words = [word() for _ in range(draw.randint(0, 40))]
        for _ in range(draw.randint(0, 3)):
            part = list(draw.choice(pool))
            if draw.random() < 0.5:
                part[draw.randrange(len(part))] = word()
            words += part[draw.randint(0, 20) : draw.randint(30, 60)] + [word() for _ in range(draw.randint(0, 6))]
        if draw.random() < 0.15:
            words += [word()] * draw.randint(10, 50)
        rows.append((draw.choice([i, i, i, None]) if i % 20 == 0 else i, draw.choice([" ", "\n", " \t"]).join(words)))
    rows += [(200 + k, rows[k][1]) for k in range(0, 60, 7)] + [rows[3], rows[4], (900, None), (901, ""), (5, "another text of an id seen before " * 9)]
    return rows


@pytest.mark.parametrize("hot", [30_000, 2])
def test_passages(spark, make, texts, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    got = rows_of(repeated_passages(make(texts, "id bigint, text string")))
    assert ordered(got) == ordered(brute.passages(texts))


@pytest.mark.parametrize("least", [21, 34])
def test_passages_of_other_lengths(spark, make, texts, least):
    got = rows_of(repeated_passages(make(texts[:60], "id bigint, text string"), least))
    assert ordered(got) == ordered(brute.passages(texts[:60], least))


def test_words_of_long_structured_letters_differ(make):
    """Letters in Thue-Morse order and the exchanged word have equal polynomial digests modulo 2^64."""
    bits = [bin(i).count("1") % 2 for i in range(2048)]
    words = [f"word{i}" for i in range(19)]
    one, other = ("".join("ab"[b ^ flip] for b in bits) for flip in (0, 1))
    rows = [(1, " ".join([*words, one])), (2, " ".join([*words, other])), (3, " ".join(["zz", *words, other]))]
    assert ordered(rows_of(repeated_windows(make(rows, "id bigint, text string")))) == ordered(brute.windows(rows))


@pytest.mark.parametrize("width", [20, 7])
def test_windows(make, texts, width):
    got = rows_of(repeated_windows(make(texts, "id bigint, text string"), width))
    assert ordered(got) == ordered(brute.windows(texts, width))


def test_repeats_of_odd_rows(odd, none):
    plain = [(r["id"], r["text"]) for r in odd.collect()]
    assert ordered(rows_of(repeated_windows(odd))) == ordered(brute.windows(plain))
    assert ordered(rows_of(repeated_passages(odd))) == ordered(brute.passages(plain))
    assert rows_of(repeated_windows(none)) == rows_of(repeated_passages(none)) == []


def test_run_index_streams_longest_matches():
    draw = np.random.default_rng(3)
    texts = draw.integers(97, 100, (30, 40)).astype(np.uint8)
    patterns = draw.integers(97, 100, (12, 40)).astype(np.uint8)
    patterns[:, 5:34] = texts[:12, 8:37]
    size, short = np.full(30, 40), np.full(12, 40)
    for least in (25, 12):
        index = RunIndex(texts, size, max(least, 9))
        who, at, row = index.stream(patterns, short, least)
        held = [bytes(t) for t in texts]
        want = {(p, s) for p in range(12) for s in range(40 - least + 1) if any(bytes(patterns[p, s : s + least]) in t for t in held)}
        assert set(zip(who.tolist(), at.tolist())) == want
        assert len(index.start) < index.text.size  # runs, not rows


def test_recompression_agrees_inside_windows():
    draw = np.random.default_rng(4)
    core = draw.integers(1, 5, 60).astype(np.uint64)

    def parse(before, after):
        t = np.r_[draw.integers(1, 5, before), core, draw.integers(1, 5, after)].astype(np.uint64)
        level = Symbols(t, np.arange(len(t)), np.arange(len(t)) + 1)
        for r in range(2):
            level = level.runs(r).pairs(r)
        inside = (level.low >= before) & (level.high <= before + 60)
        return list(zip(level.name[inside].tolist(), (level.low[inside] - before).tolist()))

    first = parse(7, 9)
    assert len(first) > 5 and all(parse(a, b) == first for a, b in ((30, 1), (2, 40), (11, 11)))


def test_trie_links_equal_all_pairs(spark, make):
    draw = random.Random(9)
    centres = [draw.getrandbits(64) for _ in range(12)]
    prints = set()
    for c in centres:
        for _ in range(25):
            x = c
            for _ in range(draw.randint(0, 5)):
                x ^= 1 << draw.randrange(64)
            prints.add(x)
    prints = sorted(prints)
    signed = [x - 2**64 if x >> 63 else x for x in prints]
    root = brute.groups(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    links = fingerprint_links(make([(x,) for x in signed], "fp bigint")).collect()
    at = {x: i for i, x in enumerate(signed)}
    a, b = np.array([at[r.a] for r in links]), np.array([at[r.b] for r in links])
    assert local_components(len(prints), a, b).tolist() == root


def test_trie_without_links():
    moved, _ = trie_links(np.array([1, 1, 2]), np.array([0, 15, 0]), 3)
    assert not len(moved)


def test_near_copies(make, odd, none, texts):
    for frame, rows in ((make(texts, "id bigint, text string"), texts), (odd, [(r["id"], r["text"]) for r in odd.collect()])):
        prints = [brute.simhash(t) for _, t in rows]
        root = brute.groups(prints, lambda a, b: (a ^ b).bit_count() <= 3)
        low = {}
        for (i, _), r in zip(rows, root):
            low[r] = min([x for x in (low.get(r), i) if x is not None], default=None)
        want = [(i, p - 2**64 if p >> 63 else p, low[r]) for (i, _), p, r in zip(rows, prints, root)]
        assert ordered(rows_of(near_copies(frame))) == ordered(want)
    assert rows_of(near_copies(none)) == []


def test_components_of_a_chain_and_a_star(make):
    links = [(i, i + 1) for i in range(40)] + [(100, 101 + i) for i in range(30)] + [(7, 7)]
    got = {r.node: r.root for r in components(make(links, "a bigint, b bigint")).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and all(got[101 + i] == 100 for i in range(30))


def test_near_vectors(make):
    draw = np.random.default_rng(1)
    rows = []
    for i in range(300):
        v = draw.normal(size=16) if i % 3 or not rows else np.array(rows[draw.integers(len(rows))][2]) * 3 + draw.normal(size=16) * 0.25
        rows.append((i, int(i % 2), [float(x) for x in v]))
    rows += [(300, 0, rows[0][2]), (301, 0, [1e200 * x for x in rows[0][2]]), (301, 0, rows[0][2])]
    odd = [(400, None, rows[0][2]), (401, 0, None), (402, 0, [0.0] * 16), (403, 0, [float("nan")] * 16), (404, 0, [float("inf")] * 16), (405, 0, [1.0, None]), (406, 0, []), (407, 0, [1.0, 0.0])]
    x = np.array([r[2] for r in rows])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = (x @ x.T >= 0.93) & (np.array([r[1] for r in rows])[:, None] == np.array([r[1] for r in rows]))
    np.fill_diagonal(near, False)
    a, b = np.nonzero(near)
    root = local_components(len(rows), a, b)
    want = [(r[0], int(n), rows[k][0], r[0] == rows[k][0]) for r, n, k in zip(rows, near.sum(axis=1), root)]
    want += [(r[0], 0, r[0], True) for r in odd]
    frame = make([(*r, 5) for r in rows + odd], "id bigint, y int, features array<double>, node int")
    for size in (2_000, 20):
        assert ordered(rows_of(near_vectors(frame, cell_rows=size))) == ordered(want)
    assert rows_of(near_vectors(frame.where("false"))) == []


@pytest.mark.parametrize("dim, rank", [(768, 3), (256, 6)])
def test_vectors_that_vary_in_few_directions(make, dim, rank):
    """Many links lie straight across the boundary of two cells; none may be lost."""
    draw = np.random.default_rng(dim)
    x = draw.normal(size=(600, rank)) @ draw.normal(size=(rank, dim)) + 1e-3 * draw.normal(size=(600, dim))
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    near = unit @ unit.T >= 0.93
    np.fill_diagonal(near, False)
    root = local_components(600, *np.nonzero(near))
    frame = make([(i, 1, v) for i, v in enumerate(x.tolist())], "id bigint, y int, features array<double>")
    got = ordered(rows_of(near_vectors(frame, cell_rows=25)))
    assert got == ordered((i, int(n), int(k), i == k) for i, (n, k) in enumerate(zip(near.sum(axis=1), root)))


def test_blocks_of_a_large_cell(make, monkeypatch):
    from holdfast.llm import vectors

    monkeypatch.setattr(vectors, "BLOCK", 16)
    rows = [(i, 1, [1.0, i * 1e-3, 0.5]) for i in range(100)]
    got = rows_of(vectors.near_vectors(make(rows, "id bigint, y int, features array<double>")))
    assert len(got) == 100 and all(r[1:3] == (99, 0) for r in got)
