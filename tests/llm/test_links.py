"""Near duplicates of texts and vectors, mixing and the pipeline: brute force, small blocks and edge rows."""

import random
import re

import numpy as np
import pytest

import corpus_pipeline
from lagwell.llm import cells, jaccard, mixing, stage

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def smallest(vertices, edges):
    label = {v: v for v in vertices}
    while True:
        new = dict(label)
        for a, b in edges:
            new[a] = new[b] = min(new[a], new[b])
        if new == label:
            return label
        label = new


def test_components_of_paths_stars_and_none(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(7, 7), (300, 200), (200, 300)]
    got = {r.v: r.c for r in stage.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = smallest({x for e in edges for x in e}, edges)
    assert got == {v: c for v, c in want.items()}
    assert stage.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def brute_sets(rows):
    out = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        out[i] = {tuple(w[p : p + 5]) for p in range(max(1, len(w) - 4))} if w else set()
    return out


def brute_groups(rows):
    s = brute_sets(rows)
    ids = list(s)
    edges = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if s[a] and s[b] and 100 * len(s[a] & s[b]) >= 75 * len(s[a] | s[b])]
    return s, smallest(ids, edges)


def near_texts(r):
    words = [f"w{i}" for i in range(400)]
    common = " ".join(r.choices(words, k=40))
    rows, n = [], 0
    for size in (6, 12, 40, 120):
        for _ in range(6):
            base = r.choices(words, k=size)
            for _ in range(r.choice([1, 2, 6])):
                w = list(base)
                for _ in range(r.choice([0, 0, 1, 2])):
                    w[r.randrange(len(w))] = r.choice(words)
                rows.append((n, " ".join(w) + r.choice(["", " ", "\n"])))
                n += 1
    for _ in range(60):  # one passage in many texts, some of them near each other by it
        rows.append((n, " ".join([common, *r.choices(words, k=r.choice([0, 2, 5, 9, 14, 30]))])))
        n += 1
    return rows + [(n, None), (n + 1, ""), (n + 2, "a"), (n + 3, "A "), (n + 4, "a b c d"), (n + 5, "a b c d e"), (n + 6, "  ")]


@pytest.mark.parametrize("leaders,block", [(3, 700_000), (0, 300), (1, 300)])
def test_jaccard_groups_equal_brute_force(spark, monkeypatch, leaders, block):
    monkeypatch.setattr(jaccard, "LEADERS", leaders)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = near_texts(random.Random(leaders + 11))
    df = spark.createDataFrame([(*x, 1, "t") for x in rows], "doc_id bigint, text string, n int, token string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df.repartition(3)).collect()}
    s, label = brute_groups(rows)
    assert got == {i: (len(s[i]), label[i]) for i in s}
    assert sum(i != c for i, c in label.items()) > 40


def test_jaccard_null_ids_repeats_and_nothing(spark):
    rows = [(4, "a b c d e f"), (4, "a b c d e f"), (None, "a b c d e f"), (2, "A B C D E F"), (9, "x y z")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted([tuple(r) for r in jaccard.near_duplicates(df).collect()], key=str)
    assert got == sorted([(4, 2, 2), (4, 2, 2), (None, 2, None), (2, 2, 2), (9, 1, 9)], key=str)
    assert jaccard.near_duplicates(df.limit(0)).count() == 0


def test_repeated_ids_with_unrelated_texts(spark):
    x, y, z = (" ".join(f"{c}{i}" for i in range(30)) for c in "xyz")
    rows = [(4, x), (4, y), (4, y), (2, y + " end"), (7, z), (7, x + " end"), (9, z), (5, ""), (5, "alone"), (None, x)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted([(r.doc_id, r.component_id) for r in jaccard.near_duplicates(df).collect()], key=str)
    assert got == sorted([(4, 4), (4, 2), (4, 2), (2, 2), (7, 7), (7, 4), (9, 7), (5, 5), (5, 5), (None, None)], key=str)
    kept = corpus_pipeline.near_duplicates(spark, df, "").collect()
    assert sorted([tuple(r) for r in kept], key=str) == sorted([(4, x), (2, y + " end"), (7, z), (5, ""), (5, "alone"), (None, x)], key=str)
    two = df.filter("doc_id = 4")  # both components have the smallest id 4
    assert sorted(r.text for r in corpus_pipeline.near_duplicates(spark, two, "").collect()) == [x, y]


def brute_vectors(rows):
    good = {i: np.array(e, float) for i, e in rows if e and all(x is not None and np.isfinite(x) for x in e) and any(e)}
    links = {(a, b) for a in good for b in good if a != b and len(good[a]) == len(good[b]) and good[a] @ good[b] / np.linalg.norm(good[a]) / np.linalg.norm(good[b]) >= 0.95}
    label = smallest([i for i, _ in rows], links)
    return {i: (sum(a == i for a, _ in links), label[i], label[i] == i) for i, _ in rows}, links


@pytest.mark.parametrize("per,block", [(10**9, 1024), (40, 16)])
def test_vectors_equal_brute_force(spark, monkeypatch, per, block):
    monkeypatch.setattr(cells, "PER_CELL", per)
    monkeypatch.setattr(cells, "BLOCK", block)
    r = np.random.default_rng(4)
    base = r.normal(size=(60, 16))
    rows = [(i, [float(x) for x in base[i % 60] * r.uniform(0.1, 9) + r.normal(size=16) * r.choice([0, 0.05, 0.2])]) for i in range(240)]
    rows += [(500 + i, rows[7][1]) for i in range(30)]
    rows += [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] + [1.0] * 15), (904, [1.0, None] * 8), (905, [float("inf")] + [1.0] * 15), (906, [1.0, 2.0]), (907, [2.0, 4.0]), (908, [1e30] * 16), (909, [1e-30] * 16)]
    rows = [(i, None if e is None else [None if x is None else float(np.float32(x)) for x in e]) for i, e in rows]
    df = spark.createDataFrame([(*x, 1) for x in rows], "vec_id bigint, embedding array<float>, cell int")
    got = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in cells.near_duplicates(df).collect()}
    want, links = brute_vectors(rows)
    found = sum(x[0] for x in got.values())
    assert len(got) == len(rows) and 0.9 * len(links) <= found <= len(links)
    if per > 1000:
        assert got == want
    empty = cells.near_duplicates(df.limit(0))
    assert empty.count() == 0
    twice = cells.near_duplicates(df.filter("vec_id = 1").unionByName(df.filter("vec_id = 1"))).collect()
    assert [(x.n_links, x.component_id) for x in twice] == [(1, 1)] * 2


def test_recall_on_copies_of_the_given_vectors(spark, monkeypatch):
    monkeypatch.setattr(cells, "PER_CELL", 100)
    r = np.random.default_rng(6)
    given = [x.embedding for x in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    x = np.array(given, float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    # copies of cosine 0.95 to 0.999 with their vector
    noise = r.normal(size=(4, *x.shape))
    noise /= np.linalg.norm(noise, axis=2, keepdims=True)
    every = np.concatenate([x, *(x + n * a for n, a in zip(noise, (0.05, 0.2, 0.3, 0.32), strict=True))]).astype(np.float32)
    df = spark.createDataFrame([(i, e.tolist()) for i, e in enumerate(every)], "vec_id bigint, embedding array<float>")
    y = every.astype(float)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    count = (y @ y.T >= 0.95).sum(axis=1) - 1
    got = {r.vec_id: r.n_links for r in cells.near_duplicates(df).collect()}
    assert all(got[i] <= c for i, c in enumerate(count.tolist()))
    assert sum(got.values()) >= 0.9 * count.sum() > 1000


def test_raking_meets_margins_in_both_forms(spark):
    r = random.Random(8)
    docs = [(i, r.choice(["ab cd ", "1 2 3 ", "x\n"]) * r.randint(1, 30), r.choice(["en", "de"]), r.choice(["s1", "s1", "s1", "s2", "s3"]), i) for i in range(600)]
    docs += [(None, None, None, None, 1), (601, "", None, "s1", 1), (602, "a", "en", None, 1)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, tokens bigint")
    targets = {"source": {"s1": 1, "s2": 1, "s3": 1, "": 0.01, "absent": 5}, "lang": {"en": 3, "de": 1, "": 0.02}}
    out = [mixing.mixed(df, targets, share=0.5, most=m).toPandas() for m in (mixing.CELLS, 0)]
    for o in out:
        assert len(o) == len(docs) and set(df.columns) < set(o.columns)
        w = o.mix_tokens * o.mix_factor
        shares = w.groupby(o.source.fillna("")).sum() / w.sum()
        assert abs(shares["s1"] - shares["s3"]) < 1e-3 and abs(shares["s2"] - 1 / 3.01) < 1e-2
        assert abs((o.mix_p * o.mix_tokens).sum() / o.mix_tokens.sum() - 0.5) < 1e-6
        assert (o.mix_kept == (o.mix_draw < o.mix_p)).all() and 0.4 < o.mix_kept.mean() < 0.9
    a, b = (o.sort_values(["doc_id", "source"]).reset_index(drop=True) for o in out)
    assert np.allclose(a.mix_factor, b.mix_factor) and np.allclose(a.mix_p, b.mix_p)
    assert mixing.mixed(df.limit(0)).count() == 0


def test_kept_tokens_meet_targets(spark):
    r = random.Random(12)
    docs = [(i, r.choice(["ab cd ", "ab cd ", "ab cd ", "1 2 3 "]) * r.randint(1, 20), "en" if r.random() < 0.8 else "de", "s1" if r.random() < 0.85 else "s2") for i in range(1500)]
    df = spark.createDataFrame([*docs, (None, None, None, None)], "doc_id bigint, text string, lang string, source string")
    o = mixing.mixed(df).toPandas()
    assert o.mix_p.max() <= 1 and 0.4 < (o.mix_p * o.mix_tokens).sum() / o.mix_tokens.sum() <= mixing.SHARE
    for c, power in (("source", 0.7), ("lang", 0.7), ("mix_topic", 0.9)):
        key = o[c].fillna("")
        share = lambda w: w.groupby(key).sum() / w.sum()  # noqa: B023, E731
        target = share(o.mix_tokens) ** power
        got, drawn = share(o.mix_p * o.mix_tokens), share(o.mix_tokens * o.mix_kept)
        for k, t in (target / target.sum()).items():
            if k not in ("", "empty"):
                assert abs(got[k] / t - 1) < 0.012 and abs(drawn[k] / t - 1) < 0.2
    assert o[o.source.isna()].mix_p.min() > 0.99  # too few tokens for their target: kept whole


def corpus(r):
    """Documents with toxic words, copies and benchmark passages; most are labelled."""
    word = lambda: "".join(r.choice(["ba", "ko", "ri", "tun", "es", "lo"]) for _ in range(r.randint(1, 4)))
    items = [(i, " ".join(word() for _ in range(20))) for i in range(5)]
    docs, labels = [], []
    for i in range(900):
        w = [word() for _ in range(r.randint(20, 60))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                w.insert(r.randrange(len(w)), r.choice(["vilword", "zakbad"]))
        elif i % 31 == 0:
            w[5:5] = items[i % 5][1].split()
        docs.append((i, " ".join(w), r.choice(["en", "de"]), r.choice(["s1", "s1", "s2"]), 1))
        labels.append((i, 1, int(toxic)))
    for i in range(900, 930):
        w = docs[r.choice([1, 2, 3, 7])][1].split()
        w[-1] = word()
        docs.append((i, " ".join(w), "en", "s1", 1))
    return docs + [(950, None, None, None, None), (951, "", "en", "s2", 0)], labels, items


def test_pipeline_stages_equal_brute_force(spark, tmp_path):
    docs, labels, items = corpus(random.Random(9))
    d = f"file://{tmp_path}"
    kind = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame(docs, kind).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    now = spark.read.parquet(f"{d}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "benchmark_decontamination", "mixing", "token_output"]

    kept = stages["toxicity"](spark, now, d)
    assert kept.columns == now.columns
    left = [tuple(r) for r in kept.collect()]
    marked = {i for i, _, t in labels if t}
    assert {r[0] for r in left} == {r[0] for r in docs} - marked

    kept = stages["ngram_jaccard_join"](spark, kept, d)
    _, label = brute_groups([(r[0], r[1]) for r in left])
    left = [r for r in left if label[r[0]] == r[0]]
    assert kept.columns == now.columns and sorted(tuple(r) for r in kept.collect()) == sorted(left)

    kept = stages["benchmark_decontamination"](spark, kept, d)
    bad = {r[0] for r in left if any(t in (r[1] or "") for _, t in items)}
    left = [r for r in left if r[0] not in bad]
    assert bad and kept.columns == now.columns and sorted(tuple(r) for r in kept.collect()) == sorted(left)

    table = mixing.mixed(kept).collect()
    kept = stages["mixing"](spark, kept, d)
    left = [tuple(r)[:5] for r in table if r.mix_draw < r.mix_p]
    assert kept.columns == now.columns and sorted(tuple(r) for r in kept.collect()) == sorted(left) and len(left) > 0.6 * len(table)

    out = corpus_pipeline.run(spark, d).collect()
    assert sorted(r.doc_id for r in out) == sorted(r[0] for r in left)
    assert sum(r.n_tokens for r in out) == max(r.start + r.n_tokens for r in out)
