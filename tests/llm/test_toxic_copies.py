"""Toxic documents at 0.3 where labelled texts are copied, exactly and with edits."""

import numpy as np
import pytest

from holdfast.llm.toxicity import toxicity

BAD = ["scumbag", "moronic", "worthless", "disgusting", "pathetic"]


def corpus(copies: int, edit: bool):
    rng = np.random.default_rng(7)
    pool = ["".join(rng.choice(list("abcdefghiklmnoprstu"), 6)) for _ in range(1500)]
    draw = lambda n, words: [words[int(i)] for i in rng.integers(0, len(words), n)]
    docs = []
    for i in range(900):
        words, bad = draw(60, pool), int(i % 6 == 0)
        for _ in range(3 * bad):
            words[int(rng.integers(0, 60))] = BAD[int(rng.integers(0, 5))]
        docs.append((i, " ".join(words), bad, i % 5 != 0))
    own = ["".join(rng.choice(list("qvwxyz"), 9)) for _ in range(1800)]
    for c in range(copies):
        words = own + ["scumbag"]
        for _ in range(20 * edit):
            words[int(rng.integers(0, 1800))] = pool[int(rng.integers(0, 1500))]
        docs.append((10_000 + c, " ".join(words), 1, True))
    return docs


@pytest.mark.parametrize("edit", [False, True])
def test_copies_of_a_toxic_text_do_not_displace_toxic_words(make, edit):
    found = {}
    for copies in (0, 300):
        docs = corpus(copies, edit)
        frame = make([(i, t) for i, t, _, _ in docs], "id int, text string")
        targets = make([(i, y) for i, _, y, train in docs if train], "id int, y int")
        labels = {i: y for i, _, y, train in docs if not train}
        got = {r["id"]: r["predicted"] for r in toxicity(frame, targets).collect() if r["id"] in labels}
        caught = np.mean([got[i] for i, y in labels.items() if y])
        alarms = np.mean([got[i] for i, y in labels.items() if not y])
        found[copies] = caught, alarms
    # edited copies hold 70 % of the toxic labels here and still teach a few words of their own
    assert min(c for c, _ in found.values()) > 0.9 and max(a for _, a in found.values()) < 0.02, found
