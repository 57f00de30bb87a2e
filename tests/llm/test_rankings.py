"""Ranked search, nearest neighbours and hard negatives against brute force, over nulls, ties, repeats, odd values and empty tables."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom.llm import negatives, neighbours, search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
CLASH = "row long, id string, n int, term string, tf int, tid int, item string, impact int, rank int, score string, d int, v string, asks int, `on` string, block int, curve int, `at` int, label2 int, bands string, `group` string"


def ranks_by_hand(docs, items, best=10):
    fold = lambda t: [x.translate({c: c + 32 for c in range(65, 91)}) for x in TERM.findall(t or "")]
    counts = [(i, Counter(fold(t))) for i, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for at, (doc, c) in enumerate(counts):
            n = sum(c.values())
            m = 10 + 90 * n * n_docs // max(n_terms, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(fold(text)) if t in c)
            if score > 0:
                scored.append((-score, doc is None, doc or 0, at, doc))
        out += [(item, k + 1, s[-1], -s[0]) for k, s in enumerate(sorted(scored)[:best])]
    return Counter(out)


def clashing(spark, rows, schema):
    extra = CLASH.split(", ")
    return spark.createDataFrame([(*r, *[None] * len(extra)) for r in rows], f"{schema}, {CLASH}").repartition(3)


def test_ranked_search(spark):
    rnd = np.random.default_rng(3)
    words = [f"w{k}" for k in range(60)] + ["Über", "ß", "x9", "ÉCOLE", "École"]
    weights = 1 / np.arange(1, len(words) + 1)
    text = lambda n: " ".join(rnd.choice(words, n, p=weights / weights.sum()))
    docs = [(k, text(int(rnd.integers(1, 60)))) for k in range(150)] + [(k, "same words, again") for k in range(300, 315)]
    docs += [(None, None), (None, "w50 w51!w52"), (400, ""), (401, "..\x00\n"), (402, "W1_w2-w1\tw3"), (5, "w55 w56"), (5, "w55 w56"), (403, "w1 " * 20_000 + "w58")]
    items = [(k, text(12)) for k in range(20)] + [(90, "AGAIN same"), (91, None), (92, ""), (93, "unknown terms only"), (94, "w58 w58"), (94, "w58 w58"), (None, "w50 w55")]
    tables = clashing(spark, docs, "doc_id long, text string"), clashing(spark, items, "item_id long, text string")
    for later in (0.5, 1.0):
        got = search.ranked(*tables, later=later)
        assert Counter(tuple(r) for r in got.collect()) == ranks_by_hand(docs, items)
    few = search.ranked(*tables, best=3).collect()
    assert Counter(tuple(r) for r in few) == ranks_by_hand(docs, items, 3)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert search.ranked(tables[0].limit(0), tables[1]).count() == search.ranked(tables[0], tables[1].limit(0)).count() == 0


def test_hilbert_curve_visits_each_cell_once_and_steps_to_a_neighbour():
    for axes, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(2**bits)] * axes), -1).reshape(-1, axes)
        keys = neighbours.hilbert_keys(cells, bits)
        assert sorted(keys) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def vectors(n=700, d=24):
    rnd = np.random.default_rng(8)
    x = rnd.standard_normal((n, d))
    x[: n // 3] = rnd.standard_normal(d) + 0.05 * x[: n // 3]  # a third of the rows crowd together
    x[n // 3 : n // 3 + 60] = x[5]  # equal rows
    x *= rnd.uniform(0.2, 3, (n, 1))
    rows = [(k, [float(c) for c in v.astype(np.float32)], k % 7) for k, v in enumerate(x)]
    inf, nan = float("inf"), float("nan")
    odd = [(20, rows[3][1], 1), (None, rows[4][1], 2), (5000, None, 1), (5020, [], 1), (5040, [0.0] * d, 1), (5060, [inf] * d, 1), (5080, [nan] + [1.0] * (d - 1), 1), (5100, [None] + [1.0] * (d - 1), 1)]
    odd += [(5200, [1.0, 2.0], 3), (5201, [2.0, 1.0], 3), (5202, [0.5, 1.0], 4), (5300, [9.0], None), (5201, [2.0, 1.0], 3)]
    return rows + odd


def embeddings(spark, rows):
    return clashing(spark, rows, "vec_id long, embedding array<float>, label int")


def test_nearest_neighbours(spark):
    rows = vectors()
    use = [(i, np.array(v, float)) for i, v, _ in rows if v and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    want = []
    for k, (i, q) in enumerate(use):
        if i is not None and i % 20 == 0:
            near = sorted((-float((q * x).sum()), j is None, j or 0) for m, (j, x) in enumerate(use) if m != k and len(x) == len(q))
            want += [(i, r + 1, None if none else j, round(-s, 6)) for r, (s, none, j) in enumerate(near[:20])]
    got = neighbours.nearest_neighbours(embeddings(spark, rows), 20, share=1.0).collect()
    assert Counter((*tuple(r)[:3], round(r["score"], 6)) for r in got) == Counter(want)
    narrow = neighbours.nearest_neighbours(embeddings(spark, rows), 20, share=0.9, block=(16, 64)).collect()
    found = Counter(tuple(r)[:3:2] for r in narrow)
    recall = sum((found & Counter((q, v) for q, _, v, _ in want)).values()) / len(want)
    assert recall >= 0.85
    assert neighbours.nearest_neighbours(embeddings(spark, rows).limit(0), 20).count() == 0
    assert neighbours.nearest_neighbours(embeddings(spark, rows).filter("vec_id % 20 <> 0"), 20).count() == 0


@pytest.mark.parametrize("blocks", [(4096, 512), (32, 3)])
def test_hard_negatives(spark, blocks):
    rows = vectors() + [(6000, [1e30] + [0.0] * 23, 1), (6001, [1e30] + [0.0] * 23, 1), (6002, [3e29] + [0.0] * 23, 2)]
    clip = lambda s: max(-(2**63), min(2**63 - 1, s))
    use = [(i, [clip(math.floor(256 * c)) for c in v], label) for i, v, label in rows if label is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    use = [(i, v, (label + 1) % 10 if i is not None and i % 7 == 0 else label) for i, v, label in use]
    want = []
    for k, (i, a, label) in enumerate(use):
        if i is not None and i % 100 == 0:
            scored = sorted((-clip(sum(p * q for p, q in zip(a, v, strict=True))), j is None, j or 0, own) for m, (j, v, own) in enumerate(use) if m != k and len(v) == len(a))
            for s, none, j, _ in [x for x in scored if x[3] == label][:5]:
                hard = [x for x in scored if x[3] != label and 30 * -s <= 100 * -x[0] <= 90 * -s][:10]
                want += [(i, None if none else j, r + 1, None if x[1] else x[2], -s, -x[0]) for r, x in enumerate(hard)]
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = negatives.hard_negatives(embeddings(spark, rows), 100, label, rows_in_block=blocks[0], anchors_in_block=blocks[1])
    assert Counter(tuple(r) for r in got.collect()) == Counter(want)
    assert len(want) > 50
    assert negatives.hard_negatives(embeddings(spark, rows).limit(0), 100, label).count() == 0
