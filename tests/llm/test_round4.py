"""The boosted trees of personal data learn from all candidates of all texts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import pii
from corpusloom.plans.session import ship


def test_pii_learns_beyond_a_text_s_first_candidates(spark):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghijkl", k=15)) + "7" for _ in range(480)]
    keys = ["AKIA" + "".join(rng.choices("0123456789ABCDEF", k=15)) + "1" for _ in range(40)]
    texts = [" ".join([*words[12 * i : 12 * i + 12], key]) for i, key in enumerate(keys)]
    docs = ship(spark).createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = pii.fit(docs)
    assert model is not None
    for r in pii.find_pii(docs, model).collect():
        start = texts[r.doc_id].index("AKIA")
        assert r.spans == f"secret:{start}:{start + 20}"


def test_pii_counts_every_text_once(spark):
    texts = ship(spark).range(20_500).select(F.concat(F.lit("see AKIA"), F.lpad(F.col("id").cast("string"), 16, "0")).alias("text"))
    for docs in (texts, texts.union(texts.limit(3000)).repartition(5)):
        assert pii.labelled(docs).agg(F.sum("n")).first()[0] == 20_500
    phones = "".join(f"tel {i:09} " for i in range(10_000))  # several batches of candidates of one text
    docs = spark.createDataFrame([(phones,), (phones,), (None,)], "text string")
    base, failed = pii.base_spans(phones)
    held = pii.Held(base), pii.Held(failed)
    labels = [pii.weak_label(phones, s, *held) for s in pii.candidates(phones)]
    rows = pii.labelled(docs).collect()
    assert sum(r.n for r in rows) == 10_000 == len([y for y in labels if y is not None])
    assert sum(r.n * r.y for r in rows) == sum(filter(None, labels)) and {r.fold for r in rows} == {pii.fold_of(phones)}


@pytest.fixture(scope="module")
def by_hand():
    """fold, label, free and bins of every labelled candidate of sf0.01, by a loop over its different texts."""
    import pyarrow.parquet as pq

    out = []
    for text in {t or "" for t in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column(0).to_pylist()}:
        base, failed = pii.base_spans(text)
        for s in pii.candidates(text):
            y = pii.weak_label(text, s, pii.Held(base), pii.Held(failed))
            if y is not None:
                out.append((pii.fold_of(text), y, not any(a < s[2] and s[1] < b for _, a, b in base), pii.binned(np.array([pii.features(text, s)]))[0]))
    return [np.array(c) for c in zip(*out, strict=True)]


def test_pii_trees_by_brute_force(spark, by_hand):
    fold, y, free, bins = by_hand
    docs = ship(spark).read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = pii.stored(pii.labelled(docs.union(docs.limit(300)).repartition(6)))
    assert rows.agg(F.sum("n")).first()[0] == len(y)
    models, rounds, rate = pii.boost(rows, rounds=3), 3, 0.3
    for i, m in enumerate(models):
        own = fold != i
        cuts = {(f, min(c for c in range(pii.BINS) if (bins[own, f] <= c).mean() >= q)) for f in range(pii.FEATURES) for q in np.linspace(0.02, 0.98, 24)}
        want = pii.Trees([], m.bias, 2.0)
        for _ in range(rounds):
            p = want.likely(bins)
            g, h = np.rint((y - p) * pii.PARTS), np.rint(p * (1 - p) * pii.PARTS)

            def best(node, g=g, h=h, cuts=cuts):
                def parts(f, c):
                    left = node & (bins[:, f] <= c)
                    return [(g[s].sum() / pii.PARTS, h[s].sum() / pii.PARTS) for s in (left, node & ~left)]

                gain = lambda at: sum(a * a / (b + 1) for a, b in parts(*at))
                at = max(sorted(cuts), key=gain)
                return at, [rate * a / (b + 1) for a, b in parts(*at)]

            root, _ = best(own)
            left = bins[:, root[0]] <= root[1]
            (a, la), (b, lb) = best(own & left), best(own & ~left)
            want.trees.append((root, a, b, [*map(float, la + lb)]))
        for got, tree in zip(m.trees, want.trees, strict=True):
            assert got[:3] == tree[:3] and np.allclose(got[3], tree[3], rtol=0, atol=1e-12)
    found = {r.score / pii.SCORES: (r.n, r.right) for r in pii.added_scores(rows, models).collect()}
    score = np.zeros(len(y))
    for i, m in enumerate(models):
        score[fold == i] = m.score_bins(bins[fold == i])
    use = free & (score >= 0.5)
    assert found == {s: ((use & (score == s)).sum(), y[use & (score == s)].sum()) for s in set(score[use])}
