"""Decontamination, toxicity, main text, interpolation: brute force, held-out accuracy and edge rows."""

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagwell.llm import decontaminate, interpolate, kneser, mincut

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_contamination(docs, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    wins = {(i, tuple(w[p : p + min(13, len(w))])) for i, t in items for w in [words(t)] if w for p in range(len(w) - min(13, len(w)) + 1)}
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for i, g in wins:
            for p in range(len(w) - len(g) + 1):
                if tuple(w[p : p + len(g)]) == g:
                    hit.update(range(p, p + len(g)))
                    found.add(str(i))
        out.append((d, len(w), len(hit), len(found), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_BYTES, 0])
def test_contamination_equals_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", limit)
    r = random.Random(3)
    say = lambda n: " ".join(r.choice("ab cé Dd É 1 x-y zz".split(" ")) + r.choice(["", ",", ".\n"]) for _ in range(n))
    items = [(i, say(r.choice([0, 1, 3, 6, 9, 12, 13, 14, 30, 60]))) for i in range(25)] + [(3, "again a b c"), (98, None), (99, "")]
    docs = [(i, say(r.choice([0, 2, 12, 13, 40, 90]))) for i in range(40)]
    docs += [(100 + i, say(20) + " " + items[i][1].upper() + " " + say(300)) for i in range(25)]
    docs += [(200, None), (201, ""), (None, items[8][1]), (100, docs[40][1]), (100, docs[40][1]), (300, "b " * 400)]
    d = spark.createDataFrame([(*x, "k") for x in docs], "doc_id bigint, text string, item_id string")
    b = spark.createDataFrame([(*x, "k") for x in items], "item_id bigint, text string, h string")
    got = decontaminate.contamination(d.select("doc_id", "text"), b).collect()
    want = brute_contamination(docs, items)
    assert sorted([(x.doc_id, x.n_words, x.n_hit, x.n_items, x.contaminated) for x in got], key=str) == want
    assert sum(x[4] for x in want) > 10
    none = decontaminate.contamination(d.select("doc_id", "text"), b.limit(0)).collect()
    assert len(none) == len(docs) and not any(x.contaminated for x in none)


def labelled(r, n):
    """Texts with toxic words of whole and of varied forms."""
    out = []
    for i in range(n):
        words = ["".join(r.choice(["ba", "ko", "ri", "tun", "es"]) for _ in range(r.randint(1, 4))) for _ in range(r.randint(5, 60))]
        bad = i % 4 == 0
        if bad:
            words.insert(r.randrange(len(words)), r.choice(["vilword", "zak" + r.choice(["ba", "ko", "ri"]) + r.choice(["es", "tun"])]))
        out.append((i, " ".join(words), int(bad)))
    return out


def test_toxicity_held_out_and_edges(spark):
    rows = labelled(random.Random(5), 1500)
    extra = [(5001, None, 0), (5002, "", 0), (None, "vilword ba ko", 1), (5003, "ko " * 20000 + "vilword", None), (5004, "... !!", None)]
    docs = spark.createDataFrame([(a, b, "q") for a, b, _ in rows + extra], "doc_id bigint, text string, toxic string")
    labels = spark.createDataFrame([(a, c) for a, _, c in rows + extra[:1]] + [(1, None), (1, 0), (8, 0)], "doc_id bigint, toxic int")
    out = {r.doc_id: r for r in kneser.scored(docs, labels).collect()}
    assert len(out) == len(rows) + 5 and out[5002].toxic == "q"
    held = [(out[a].toxic_score >= kneser.CUT, c == 1) for a, _, c in rows if zlib.crc32(str(a).encode()) % 4 == 2]
    assert sum(p == y for p, y in held) / len(held) > 0.97 and len(held) > 300
    assert out[5001].toxic_score == out[5002].toxic_score < kneser.CUT
    assert out[None].toxic_score > 0.5 and all(0 <= r.toxic_score <= 1 for r in out.values())
    for some in (labels.limit(0), labels.filter("toxic = 0")):
        assert {r.toxic_score for r in kneser.scored(docs, some).collect()} == {0.0}
    assert kneser.scored(docs.limit(0), labels).count() == 0


def test_expressions_of_few_training_texts_count(spark):
    rows = labelled(random.Random(6), 1500)
    ids = spark.range(1500).select("id", kneser.held_out("id").alias("h"), F.pmod(F.xxhash64(F.lit(11), "id"), F.lit(kneser.FOLDS)).alias("fold"))
    train = {r.id for r in ids.filter("NOT h AND fold > 0").collect()}
    for n in (1, 3):
        rare = [i for i, _, bad in rows if bad and i in train][:n]
        texts = [(i, t + " qyxjugw" * (i in rare), c) for i, t, c in rows]
        extra = [(9001, "ba ko ri qyxjugw tun", None), (9002, "ba ko ri fhmcpdg tun", None)]
        docs = spark.createDataFrame([(a, b) for a, b, _ in texts + extra], "doc_id bigint, text string")
        out = {r.doc_id: r.toxic_score for r in kneser.scored(docs, spark.createDataFrame([(a, c) for a, _, c in texts], "doc_id bigint, toxic int")).collect()}
        assert out[9001] > out[9002] + 0.05


def test_cut_is_minimal():
    r = random.Random(1)
    for _ in range(150):
        n = r.randint(1, 8)
        costs = [r.randint(-9, 9) for _ in range(n)]
        links = [(a, b, r.randint(0, 6)) for a, b in itertools.combinations(range(n), 2) if r.random() < 0.5]
        price = lambda keep: sum(c if c > 0 and not k else -c if c < 0 and k else 0 for c, k in zip(costs, keep)) + sum(w for a, b, w in links if keep[a] != keep[b])  # noqa: B023, E731
        assert price(mincut.content(costs, links)) == min(map(price, itertools.product([False, True], repeat=n)))


PAGE = """<html><head><title>t</title><style>p{}</style><script>var a = "</p><p>no";</script></head><body>
<header><p>Site name</p></header><nav><ul><li><a href=/a>Home</a><li><a href=/b>More</a></ul></nav>
<div class="cookie-notice"><p>We use cookies to make this site better for all of our readers, please accept.</p></div>
<div id="content"><h1>Head &amp; line</h1><p>First   paragraph&nbsp;with <b>bold</b> text,
and more.<p>Second &#233;t&eacute; one.<div class="ad">Buy now, cheap things of many kinds, for everybody here today.</div><ul><li>item</ul>
<form><label>Mail</label><button>Send</button></form></div>
<section class="comments"><p>A reader writes a long remark here, which is not part of the article at all.</p></section>
<aside><p>Sidebar text of some length, which goes on and on, but belongs to no article.</p></aside><!-- <p>hidden</p> --><footer>&copy; x</footer>"""


def test_main_text(spark):
    text = "Head & line\nFirst paragraph with bold text, and more.\nSecond été one.\nitem"
    assert mincut.main_text(PAGE) == text
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, "x"), (2, "u", "", "x"), (3, "u", "<p></p><br>", "x"), (4, "u", "just a plain text without any markup, but long enough to be the content.", "x"), (5, "u", "<article>" + "<p>word</p>" * 3000, "x")]
    out = mincut.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")).collect()
    assert [r.text for r in out[:5]] == [text, text, "", "", ""] and out[0].n_chars == len(text)
    assert out[5].text.startswith("just") and out[6].n_chars == 3000 * 5 - 1


@pytest.mark.parametrize("piece", ["<video-player src=x></video-player>", "<title-card></title-card>", "<svg width=1/>", "<svg width=1>", "<math/>", "<object data=x>", "<canvas>", "<audio src=x>", "<select>", "<select><option>a</option></select>"])
def test_elements_do_not_swallow_what_follows(piece):
    one, two = "A first paragraph, long enough to be content of the page.", "A second paragraph, long enough to be content of the page."
    text = mincut.main_text(f"<article><p>{one}</p>{piece}<p>{two}</p></article>")
    assert text.startswith(one) and text.endswith(two)


LONG = "A paragraph of the article that is long enough to be its content, as anyone would say."


@pytest.mark.parametrize("page,text", [
    ('<p>AAA <span class="share">x</span> BBB</p>', "AAA BBB"),
    ('<p>AAA <span class="share">x <span>y</span> z</span> BBB <span>CCC</span> DDD</p>', "AAA BBB CCC DDD"),
    ('<p>AAA <span class="ad">x</p><p>BBB</p>', "AAA\nBBB"),
    (f'<section id="discussion"><p>{LONG}</p></section>', LONG), (f'<section id="related-work"><p>{LONG}</p></section>', LONG),
    (f'<div class="market-share"><p>{LONG}</p></div>', LONG), (f'<div class="entry-header"><h1>Title</h1></div><p>{LONG}</p>', f"Title\n{LONG}"),
    (f'<div class="page-header"><h1>Title</h1></div><p>{LONG}</p>', f"Title\n{LONG}"),
    (f'<p>{LONG}</p><ul><li><a href=a>One reference</a></li><li><a href=b>Two</a></li></ul>', f"{LONG}\nOne reference\nTwo"),
    (f'<p title="open>{LONG}</p>', LONG), (f"<p>{LONG}</p><![CDATA[ x > y ]]>", LONG),
    (f'<p>{LONG}</p><div class="user-comments"><p>{LONG}</p></div><div class="share-buttons"><p>{LONG}</p></div><div class="related-posts">{LONG}</div>', LONG),
])
def test_parts_of_an_article_stay(page, text):
    assert mincut.main_text(f"<body><nav><a href=x>Menu</a></nav><article>{page}</article></body>") == text


def test_text_inside_math_and_object_stays():
    page = "<article><p>The area is <math><mi>xyz</mi></math> of <object data=x>some shape</object> here, as everybody knows well.</p></article>"
    assert mincut.main_text(page) == "The area is xyz of some shape here, as everybody knows well."


def test_interpolation_counts_and_improves(spark, monkeypatch):
    r = random.Random(2)
    words = [f"W{i}é" for i in range(60)]
    chain = {w: r.sample(words, 3) for w in words}
    docs = []
    for i in range(400):
        w = [r.choice(words)]
        for _ in range(r.randint(0, 40)):
            w.append(r.choice(chain[w[-1]]))
        docs.append((i, " ".join(w)))
    docs += [(1000, None), (1001, ""), (1002, " \t\x0b "), (None, "w1é w2é"), (5, "new unseen words"), (1003, "W1é " * 30000)]
    df = spark.createDataFrame([(*x, "z") for x in docs], "doc_id bigint, text string, block string")
    cut = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW)) + [None]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    count = Counter(w for i, t in docs if not held(i) for w in cut(t))
    n, v = sum(count.values()), len(count)
    for size in (interpolate.BLOCK, 5000):
        monkeypatch.setattr(interpolate, "BLOCK", size)
        out = interpolate.score(df).collect()
        got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out), key=str)
        want = [(i, held(i), len(cut(t)), sum(count[w] > 0 for w in cut(t)), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in cut(t)), 6)) for i, t in docs]
        assert got == sorted(want, key=str)
        rows = [r for r in out if r.held_out and r.n_tokens > 5]
        assert sum(r.score for r in rows) > 0.75 * sum(r.base_score for r in rows) and all(math.isfinite(r.score) for r in out)
    assert interpolate.score(df.limit(0)).count() == 0


def test_weights_are_learned_from_every_training_document(spark, monkeypatch):
    r = random.Random(4)
    docs = [(i, " ".join(r.choices("abcdefgh", k=r.randint(1, 30)))) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    events = sum(len(t.split()) + 1 for i, t in docs if zlib.crc32(str(i).encode()) % 7 != 2)
    seen, learn = [], interpolate.weights
    monkeypatch.setattr(interpolate, "weights", lambda code, n, types: seen.append((dict(zip(code.tolist(), n.tolist(), strict=True)), n.sum())) or learn(code, n, types))
    for size in (interpolate.BLOCK, 1000):
        monkeypatch.setattr(interpolate, "BLOCK", size)
        interpolate.score(df).count()
    assert seen[0] == seen[1] and seen[0][1] == events


def test_mixture_weights_climb():
    code, n = interpolate.np.array([3 * 4096 * 4096 + 4 * 4096 + 20 + 4097]), np.array([10])
    w = interpolate.weights(code, n, 1000)
    assert np.allclose(w.sum(axis=1), 1) and w[3, 0] > 0.99 and w[0, 0] == 0


def test_scores_equal_a_dictionary_model(spark, monkeypatch):
    learned, real = [], interpolate.weights
    monkeypatch.setattr(interpolate, "weights", lambda *a: learned.append(real(*a)) or learned[-1])
    monkeypatch.setattr(interpolate, "BLOCK", 900)
    r = random.Random(4)
    docs = [(i, " ".join(r.choices(["The", "the", "cat", "sat", "on", "mat", "été"] + [f"w{k}" for k in range(30)], k=r.randrange(25))) + r.choice(["", "\n"])) for i in range(80)] + [(80, None), (81, "")]
    got = {x.doc_id: x for x in interpolate.score(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = {i: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low)), None] for i, t in docs}
    one, two = Counter(), Counter()
    for i, ts in tokens.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            one.update(ts)
            two.update(zip(["<start>", *ts], ts))  # noqa: B905
    total, types = sum(one.values()), len(one)
    for i, ts in tokens.items():
        base = score = 0.0
        for v, w in zip(["<start>", *ts], ts):  # noqa: B905
            seen = one[None] if v == "<start>" else one[v]
            mix = learned[0][math.ceil(math.log2(seen + 1))]
            score += math.log10(mix[0] * (two[v, w] / seen if seen else 0) + mix[1] * one[w] / total + mix[2] / (types + 1))
            base += math.log10((one[w] + 1) / (total + types + 1))
        assert got[i].score == pytest.approx(score) and got[i].base_score == pytest.approx(base)
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(ts), sum(one[w] > 0 for w in ts), total)
