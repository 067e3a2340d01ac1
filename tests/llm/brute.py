"""Plain versions of the operators, for small cohorts."""

import hashlib

import xxhash

LAST = 1 << 63


def passages(rows, least=50):
    data = [(LAST if i is None else i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, b in data:
        for s in range(len(b) - least + 1):
            k = b[s : s + least]
            first[k] = min(first.get(k, LAST), i)
    out = []
    for (i, b), (raw, _) in zip(data, rows):
        gone = [False] * len(b)
        for s in range(len(b) - least + 1):
            if first[b[s : s + least]] < i:
                gone[s : s + least] = [True] * least
        spans = sum(g and (j == 0 or not gone[j - 1]) for j, g in enumerate(gone))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((raw, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def windows(rows, width=20):
    data = [(LAST if i is None else i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in data:
        for s in range(len(w) - width + 1):
            k = tuple(w[s : s + width])
            first[k] = min(first.get(k, (LAST, LAST)), (i, s))
    out = []
    for (i, w), (raw, _) in zip(data, rows):
        gone = [False] * len(w)
        for s in range(len(w) - width + 1):
            if first[tuple(w[s : s + width])] < (i, s):
                gone[s : s + width] = [True] * width
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((raw, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def simhash(text):
    words = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
    if not words:
        return 0
    width = min(3, len(words))
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + width]), 42) for i in range(len(words) - width + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(keys, near):
    """Smallest position reachable over near(a, b)."""
    root = list(range(len(keys)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(keys)):
        for j in range(i):
            if near(keys[i], keys[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(keys))]


def jump(key, shards):
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def overlaps(items, text, least=12):
    """(item, start, tokens, equal) of the longest overlap with each item, a fifth of it different at most."""
    out = set()
    for k, item in enumerate(items):
        found = []
        for shift in range(1 - len(item), len(text)):
            at = [i for i in range(max(0, -shift), min(len(item), len(text) - shift)) if item[i] == text[i + shift]]
            found += [(b - a + 1, j - i + 1, -a - shift) for i, a in enumerate(at) for j, b in enumerate(at) if j >= i and 5 * (j - i + 1) >= 4 * (b - a + 1)]
        size, same, start = max(found, default=(0, 0, 0))
        if size >= min(least, len(item)):
            out.add((k, -start, size, same))
    return out
