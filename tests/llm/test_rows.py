"""Hosts, toxicity, mixing, leaks, page text and shards."""

import os
import time
import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from holdfast.llm.hosts import filter_urls
from holdfast.llm.html import extract_text, main_text
from holdfast.llm.leaks import SeedIndex, leaked_overlaps, without_leaks
from holdfast.llm.mixing import mix_strata, mixed_rows
from holdfast.llm.sharding import jump, shard_rows
from holdfast.llm.toxicity import CharacterModel, count_trigrams, suspect, toxicity

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("net", "/es/", "block")]


def test_rules_and_reputation(make):
    urls = [
        (1, "http://A.Example.com/en/x?y"), (2, "https://b.com/"), (3, "https://b.com"), (4, None), (5, "no scheme"), (6, "x://notexample.com/en/"),
        (7, "ftp://s.net/es/1#f"), (8, "http://bad.org/1"), (9, "http://bad.org/2"), (10, "http://good.org/1"), (11, "http://new.bad.org/"), (8, "http://bad.org/1"),
    ]
    many = [(100 + i, f"http://bad.org/{i}") for i in range(60)] + [(200 + i, f"http://good.org/{i}") for i in range(60)]
    pages = make([(*u, "z") for u in urls + many], "id bigint, url string, host string")
    outcomes = make([(100 + i, 1) for i in range(60)] + [(200 + i, 0) for i in range(60)] + [(None, 1), (10, None), (5000, 1)], "id bigint, y int")
    got = {}
    for r in filter_urls(pages, outcomes, RULES).collect():
        got.setdefault(r.id, []).append(r)
    one = {k: v[0] for k, v in got.items()}
    assert len(got[8]) == 2 and sum(map(len, got.values())) == len(urls) + 120
    assert (one[1].host, one[1].path, one[1].rule, one[1].verdict) == ("a.example.com", "/en/x", "example.com/en/", "block")
    assert one[2].rule == "com/" and one[3].rule is None and one[6].rule == "com/" and one[7].verdict == "block"
    assert (one[4].host, one[4].path, one[5].host) == ("", "", "")
    assert one[8].verdict == "block" and one[10].verdict == "allow" and one[4].verdict == "allow"
    # a host of its own, one page without an outcome: its domain speaks for it, more weakly
    assert one[10].posterior < one[11].posterior < one[8].posterior
    bare = filter_urls(pages, outcomes.where("false"), []).collect()
    assert len(bare) == len(urls) + 120 and {r.verdict for r in bare} == {"allow"}
    assert filter_urls(pages.where("false"), outcomes, RULES).collect() == []


CLEAN = "the small river runs along quiet green fields under many old trees while people walk home in soft evening light"


def _labelled(make):
    words = CLEAN.split()
    rows, targets = [], []
    for i in range(400):
        own = [words[(i * 7 + k * 3) % len(words)] for k in range(14)]
        if i % 4 == 0:
            own[3], own[9] = ("blorgus", "snarfling")[i % 8 // 4], "blorgus"
        rows.append((i, " ".join(own)))
        targets.append((i, int(i % 4 == 0)))
    return rows, targets


def test_toxicity_sees_through_disguises(make):
    rows, targets = _labelled(make)
    more = [
        (1000, "people said b l o r g u s to the river and blorgus again"), (1001, "the bl0rgu$ walked with a bl0rgus home"),
        (1002, "see the b.l.o.r.g.u.s under old blorrrgus trees"), (1003, CLEAN), (1004, None), (1005, ""), (None, "blorgus snarfling blorgus"),
        (1006, CLEAN * 500 + " blorgus snarfling blorgus " * 30), (1003, CLEAN), (1007, "call 068 555-2748 or mail 4you @ 12 a b"),
    ]
    cohort = make([(*r, 0.1) for r in rows + more], "id bigint, text string, score double")
    frame = make(targets + [(None, 1), (2, None), (5000, 1)], "id bigint, y int")
    got = {r.id: r for r in toxicity(cohort, frame).collect()}
    assert all(got[i].predicted == y for i, y in targets)
    assert [got[i].predicted for i in (1000, 1001, 1002, None, 1006)] == [1] * 5
    assert [got[i].predicted for i in (1003, 1004, 1005, 1007)] == [0] * 4
    kept = toxicity(cohort, frame, carry=True)
    assert kept.columns == cohort.columns and kept.count() == 300 + 5
    assert toxicity(cohort.where("false"), frame).collect() == []
    untaught = toxicity(cohort, frame.where("false")).collect()
    assert len(untaught) == len(rows + more) and {r.predicted for r in untaught} == {0}
    flat = toxicity(cohort, frame.where("y = 0")).collect()
    assert len(flat) == len(rows + more) and len({round(r.score, 9) for r in flat}) == 1


def test_character_model_decodes():
    model = CharacterModel(count_trigrams(["some stupid words and a moron, more stupid words; stupid moron " * 20]))
    assert model.restore("a $tup1d m o r o n, and mooooron 2024") == "a stupid moron, and moron 2024"
    assert model.restore("Plain WORDS stay, 12 of 30.") == "plain words stay, 12 of 30."


DISGUISES = [
    ("los€r", "loser"), ("$tup1d", "stupid"), ("m o r o n", "moron"), ("m  o  r  o  n", "moron"), ("m \n o\tr \n o n", "moron"),
    ("m\u2003o\u2003r\u2003o\u2003n", "moron"), ("m o r o n.", "moron."), ("(m o r o n)", "(moron)"), ("\u201cm o r o n\u201d", "\u201cmoron\u201d"),
    ('"l0ser"', '"loser"'), ("(l0ser)", "(loser)"), ("'m.o.r.o.n',", "'moron',"), ("*m-o-r-o-n", "*moron"), ("mooooron", "moron"), ("mmoooron", "moron"),
    ("l0ser\U0001f600", "loser\U0001f600"), ("m o r o n\U0001f600", "moron\U0001f600"), ("m_o_r_o_n", "moron"), ("l0ser!", "loser!"), ("moron$$$", "moron$$$"),
]


@pytest.mark.parametrize("disguised, want", DISGUISES)
def test_disguise_alone_is_decoded(disguised, want):
    model = CharacterModel(count_trigrams(["some stupid words and a moron, a loser too, more stupid words; stupid moron and loser " * 20]))
    assert suspect(disguised) and model.restore(f"and {disguised} and") == f"and {want} and" and model.restore(disguised) == want
    plain = 'he said "words (some of them)" and a word, i am (too much).'
    assert model.restore(f"{plain} {disguised}") == f"{plain} {want}"


def test_held_out_toxicity(spark):
    from holdfast.llm.queries import op4_toxicity

    sf_dir = "/root/testdata/sf0.1"
    if not os.path.isdir(sf_dir):
        pytest.skip("no test data")
    found = op4_toxicity(spark, sf_dir).where("held_out").join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").select("score", "toxic").toPandas()
    y, s = found["toxic"].to_numpy(), found["score"].to_numpy()
    pos, neg = s[y == 1], s[y == 0]
    auc = ((pos[:, None] > neg).mean() + 0.5 * (pos[:, None] == neg).mean()) if len(pos) and len(neg) else 1
    assert auc > 0.95


def test_mix(make, odd, none):
    rows = [(i, "w " * (i % 9), "abc"[i % 3] if i % 10 else None) for i in range(300)] + [(None, "x y", "a"), (7, "w w", "a"), (7, "w w", "a"), (301, None, "d"), (302, "", "d")]
    frame = make([(*r, 9) for r in rows], "id bigint, text string, stratum string, size int")
    weights = make([(i, 2.0 if i % 2 else 0.5) for i in range(0, 300, 3)] + [(3, 0.1), (None, 9.0)], "id bigint, weight double")
    got = [tuple(r) for r in mix_strata(frame, weights).collect()]
    assert sorted(map(repr, got)) == sorted(repr(tuple(r)) for r in mix_strata(frame.repartition(5), weights).collect())
    assert len(got) == len(rows) and all(0 <= taken <= 2 * size for _, size, _, _, taken in got)
    total, by = sum(g[1] for g in got), {}
    for _, size, source, target, taken in got:
        by.setdefault((source, target), []).append(taken)
    assert all(abs(sum(v) - target) <= 0.5 for (_, target), v in by.items())
    assert abs(sum(t for _, t in by) - 1.5 * total) < 1e-6 and all(t <= 2 * s + 1e-9 for s, t in by)
    assert mix_strata(odd).count() == odd.count() and mix_strata(none).collect() == []
    # whole rows: each stratum within half a document of its target
    taken, words = {}, {i: s for i, s, *_ in got}
    for r in mixed_rows(frame, weights).collect():
        taken.setdefault(r.stratum, []).append(r)
    for s, rs in taken.items():
        some = next(g for g in got if g[0] == next(r.id for r in rs if r.id is not None))
        assert abs(sum(len((r.text or "").split()) for r in rs) - some[3]) <= 4.5 and max(words.values()) <= 9
    assert sorted(map(repr, mixed_rows(frame, weights).collect())) == sorted(map(repr, mixed_rows(frame.repartition(7), weights).collect()))
    assert mixed_rows(odd).columns == odd.columns and mixed_rows(none).collect() == []


def test_heavier_rows_come_first(make):
    frame = make([(i, "w", s) for i in range(4000) for s in ("a",)] + [(i, "w", "b") for i in range(5000, 9000)], "id bigint, text string, stratum string")
    weights = make([(i, 4.0) for i in range(0, 4000, 2)], "id bigint, weight double")
    # weights 1 and 3, all words shared once: stratum a gets 2000 of its 4000 words
    got = mix_strata(frame, weights, weights=(1.0, 3.0), share=1.0).where("id < 4000").groupBy((F.col("id") % 2).alias("odd")).agg(F.sum("taken").alias("n")).collect()
    n = {r.odd: r.n for r in got}
    # keys of rate 4 and 1: z^4 + z = 1 at z = 0.7245, the share of heavy rows below the edge
    assert n[0] + n[1] == 2000 and abs(n[0] - 1449) < 100


def test_leaks(make, odd, none):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau"
    words = item.split()
    swapped = words[:]
    swapped[5], swapped[12] = "OTHER", "thing"
    cohort = make([
        (1, f"before {item} after", 0), (2, "Alpha, BETA; " + " ".join(words[2:]), 0), (3, "x " + " ".join(swapped) + " y", 0), (4, " ".join(words[3:15]), 0),
        (5, " ".join(words[:8]), 0), (6, " ".join(reversed(words)), 0), (7, None, 0), (8, "", 0), (None, "q " * 30_000 + item, 0), (9, "see short item here", 0), (9, "see short item here", 0),
    ], "id bigint, text string, value int")
    items = make([(50, item), (51, "short item"), (52, None), (53, ""), (54, item)], "item_id bigint, text string")
    got = leaked_overlaps(cohort, items, item_id="item_id").collect()
    assert sorted({(str(r.id), r.item_id) for r in got}) == sorted([(str(i), k) for i in (1, 2, 3, 4, None) for k in (50, 54)] + [("9", 51)])
    assert [(r.n_tokens, r.n_equal) for r in got if r.id == 3 and r.item_id == 50] == [(19, 17)]
    clean = without_leaks(cohort, items, item_id="item_id")
    assert clean.columns == cohort.columns and sorted(r.id for r in clean.collect()) == [5, 6, 7, 8]
    assert leaked_overlaps(none, items, item_id="item_id").collect() == [] == leaked_overlaps(odd, items.where("false"), item_id="item_id").collect()
    assert without_leaks(odd, items.where("false"), item_id="item_id").count() == odd.count()


def test_substituted_items_equal_brute_force():
    draw = np.random.default_rng(5)
    sixteen = [f"t{i}" for i in range(16)]
    index = SeedIndex([(1, " ".join(sixteen))], 12, 0.8)
    assert index.find(" ".join("x" if i in (5, 11) else w for i, w in enumerate(sixteen))) == [(0, 0, 16, 14)]
    for n in (9, 10, 11, *range(12, 61, 3)):
        items = [[f"w{i}" for i in draw.integers(0, 400, n)] for _ in range(12)]
        index = SeedIndex([(k, " ".join(w)) for k, w in enumerate(items)], 12, 0.8)
        for k, words in enumerate(items):
            spots = set(draw.choice(n, min(n // 5 + k % 2, n), replace=False).tolist())
            text = ["other"] * (k % 3) + [f"s{i}" if i in spots else w for i, w in enumerate(words)] + ["end"] * (k % 2)
            assert {(x["item_id"], x["start"], x["n_tokens"], x["n_equal"]) for x in index.longest([" ".join(text)])[0]} == brute.overlaps(items, text), (n, spots)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body>
<header><h1>Site name of the paper</h1></header><nav><ul><li><a href=/a>the one</a><li><a href=/b>and two</a></ul></nav><div class="cookie-notice">We use cookies and the law says that it is for you.</div>
<!-- a > b <p>hidden</p> --><article><h1>Short title</h1><p>The first paragraph of the article, with <b>bold</b> words &amp; &eacute;ntities &lt;that are&gt; kept,
and  white   space<br>joined.<p>Unclosed second one of the text, that is long enough to be decided by its own words.
<p>Tiny.</p><div class="comments"><p>A reader says that this is the best of all of the pages on the web.</p></div><aside>See also the other one of it.</aside></article>
<form><label>Your name</label><input name=q><button>Send</button></form><footer>&copy; the paper and all of its people</footer></body></html>"""


def test_main_text():
    assert main_text(PAGE) == (
        "Short title The first paragraph of the article, with bold words & éntities <that are> kept, and white space joined. "
        "Unclosed second one of the text, that is long enough to be decided by its own words. Tiny."
    )
    assert main_text(None) == main_text("") == main_text("<html><nav><a>x</a></nav>") == ""
    assert main_text("<article><p>Hi.</p></article>") == "Hi." and main_text("<article><p>un<b>closed &amp; open") == "unclosed & open"
    prose = "The text of a page without any article is found by the share of words that are in the list of stop words. "
    assert main_text(f"<div>{prose * 2}</div><p>Short bit.</p><div>{prose}</div><div><a>the link</a> <a>and one more of it</a></div>") == f"{(prose * 2).strip()} Short bit. {prose.strip()}"


def test_text_outside_of_articles():
    prose = "The text of a page that has an article is found by the share of words that are in the list of stop words."
    menu, foot = "<nav><a>the one</a></nav>", "<footer>the paper and all of its people</footer>"
    teaser = f"<article><h3>Other</h3><p>{prose}</p></article>"
    for box in ("<aside>{}</aside>", '<div class="related-posts">{}</div>'):
        assert main_text(f"{menu}<div>{prose}</div><p>Short bit.</p><div>{prose}</div>{box.format(teaser)}{foot}") == f"{prose} Short bit. {prose}"
    lead, rest = f"Lead: {prose}", f"Rest: {prose}"
    page = f"{menu}<p>Top line.</p><p>{lead}</p><article><p>{prose}</p></article><p>Small part.</p><div>{rest}</div><p>Last line.</p>{foot}"
    assert main_text(page) == f"{lead} {prose} Small part. {rest}"
    assert main_text(f"<article><p>{prose}</p><figure><img src=a><figcaption>A small river.</figcaption></figure><p>{prose}</p></article>") == f"{prose} A small river. {prose}"


SENTENCES = [
    "Река тихо течёт под старым мостом, и люди идут домой вечером. Дети играют на берегу, пока солнце садится за лесом.",
    "Il fiume scorre lento sotto il vecchio ponte e la gente torna a casa la sera. I bambini giocano sulla riva mentre il sole tramonta dietro il bosco.",
    "Rzeka płynie powoli pod starym mostem, a ludzie wracają wieczorem do domu. Dzieci bawią się na brzegu, gdy słońce zachodzi za lasem.",
    "河水在旧桥下静静地流淌,人们在傍晚回家。孩子们在岸边玩耍,太阳落在森林后面。老人们坐在树下谈论过去的日子。",
    "يجري النهر بهدوء تحت الجسر القديم ويعود الناس إلى بيوتهم في المساء. يلعب الأطفال على الضفة بينما تغرب الشمس خلف الغابة.",
    "नदी पुराने पुल के नीचे धीरे धीरे बहती है और लोग शाम को घर लौटते हैं। बच्चे किनारे पर खेलते हैं जबकि सूरज जंगल के पीछे डूबता है।",
]


@pytest.mark.parametrize("prose", SENTENCES)
def test_main_text_in_any_language(prose):
    names = " ".join(f"Alpha Beta {k}." for k in range(9))
    page = f"<nav><a>{prose}</a></nav><div>{names}</div><div><p>{prose}</p><p>{prose}</p></div><div><a>{prose}</a></div><footer>© {prose}</footer>"
    assert main_text(page) == f"{prose} {prose}"


def _slow(page):
    start = time.perf_counter()
    main_text(page + "The text of it.")
    return time.perf_counter() - start


@pytest.mark.parametrize("part", ["<span>", "<div>", "<p><b>", "<li><span>", "<select>", "<a<a", "<a title='x\"y>", "</x>"])
def test_main_text_takes_linear_time(part):
    # five times the page: a square would take 25 times as long
    assert _slow(part * 100_000) < 12 * max(_slow(part * 20_000), 0.05)


def test_an_odd_quote_ends_with_its_tag():
    assert main_text("<article><p title=\"x>Some words.</p><p>And it's more.</p></article>") == "Some words. And it's more."


def test_extract_text(make):
    pages = make([(1, "u", PAGE, "t"), (None, None, None, "t"), (1, "u", PAGE, "t"), (2, "v", "<p>" * 3000 + "x" * 200_000, "t")], "id bigint, url string, html string, text string")
    got = extract_text(pages).collect()
    assert len(got) == 4 and all(r.n_chars == len(r.text) for r in got)
    assert [(r.url, r.text) for r in got if r.id is None] == [(None, "")] and extract_text(pages.where("false")).collect() == []


def test_jump_moves_only_into_new_shards():
    keys = np.random.default_rng(2).integers(-(2**63), 2**63, 2000)
    for n in (1, 2, 7, 8, 100):
        now, more = jump(keys, n), jump(keys, n + 1)
        assert now.tolist() == [brute.jump(int(k) % 2**64, n) for k in keys]
        assert ((now == more) | (more == n)).all()
    with pytest.raises(ValueError):
        jump(keys, 0)


def test_shards(odd, none):
    got = shard_rows(odd, 3).collect()
    assert len(got) == odd.count() and {r.law for r in got} == {"key"} and shard_rows(none).collect() == []
    for s in range(3):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    rows = {(r["id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in odd.collect()}
    assert rows == {(r.id, r["size"], r.text_crc32) for r in got}
    assert all(r.grown_shard in (r.shard, 3) for r in got)
    assert len({r.shard for r in got if r.id is None}) == 1
