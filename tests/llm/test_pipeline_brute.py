"""The whole pipeline against a plain Python version of its five stages."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import corpus_pipeline
from flowloom.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(n, seed):
    r = random.Random(seed)
    return [f"w{r.choice('abcdefghij')}{r.randrange(900)}" for _ in range(n)]


def corpus():
    """Planted near copies, exact copies, common lines, benchmark passages, texts without letters, nulls and repeated rows."""
    r, rows = random.Random(4), []
    item = " ".join(prose(20, 999))
    for i in range(60):
        tokens = prose(60 + i, i)
        lines = [" ".join(tokens[:30]), " ".join(tokens[30:])]
        if i % 4 == 0:
            lines.insert(1, "  Common LINE ")
        if i % 15 == 7:
            lines.append(item)
        rows.append((i, "\n".join(lines), "en", f"s{r.choice('aab')}" if i % 9 else None))
        if i % 6 == 0:
            near = tokens[:40] + ["changed"] + tokens[41:]
            rows.append((100 + i, " ".join(near), None, "sc"))
    rows += [rows[3], (None, " ".join(prose(50, 5)[:50]), "en", "sa"), (None, None, None, "sa"), (301, "12 34", "en", "sb"), (302, "", "en", "sb"), (303, "common line", "en", "sb")]
    return rows, [(1, item), (2, None)]


def plain(rows, items):
    docs = [(d, t, s) for d, t, _, s in rows if any(c.isalpha() for c in t or "")]
    key = lambda x: x.strip(" \t\n\v\f\r").lower()
    seen = Counter(k for _, t, _ in docs for k in {key(x) for x in t.split("\n")})
    docs = [(d, "\n".join(x for x in t.split("\n") if not (key(x) and seen[key(x)] >= 10)), s) for d, t, s in docs]
    grams = lambda w: [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []
    sets = [frozenset(grams(t.lower().split())) for _, t, _ in docs]
    root = list(range(len(docs)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if root[i] != root[j] and (a == b or a | b and len(a & b) / len(a | b) >= 0.8):
                root = [root[j] if x == root[i] else x for x in root]
    groups = defaultdict(list)
    for i, x in enumerate(root):
        groups[x].append(i)
    docs = [docs[min(g, key=lambda i: (docs[i][0] is None, docs[i][0] or 0, i))] for g in groups.values()]

    def held(text):
        w = text.lower().split()
        for _, item in items:
            x = (item or "").lower().split()
            a = Counter(grams(x))
            for i in range(max(1, len(w) - len(x) + 1)):
                b = Counter(grams(w[i : i + len(x)]))
                if x and w and (a & b).total() / (a | b).total() >= 0.8:
                    return True
        return False

    docs = [(d, t, s) for d, t, s in docs if not held(t)]
    sizes = defaultdict(int)
    for _, t, s in docs:
        sizes[s] += len(t.split())
    names = sorted(n for n in sizes if n is not None) + [None] * (None in sizes)
    weight = {n: (3, 1, 2)[i % 3] for i, n in enumerate(names)}
    target, open_, left = {}, set(names), 1.5 * sum(sizes.values())
    while True:
        share = {n: left * weight[n] / sum(weight[m] for m in open_) for n in open_}
        full = [n for n in open_ if share[n] > 2 * sizes[n]]
        if not full:
            break
        for n in full:
            target[n] = 2 * sizes[n]
            left -= target[n]
            open_.discard(n)
    target |= share if open_ else {}
    out = Counter()
    for n in names:
        order = []
        for d, t, s in docs:
            if s == n:
                size, h = len(t.split()), hashlib.md5(("" if d is None else str(d)).encode()).hexdigest()
                order.append((f"{size.bit_length() or 1:02}{bin(size)[2:6]}", h[0] + str(int(h[1], 16) // 4), d is None, d or 0, size, d, t))
        rate = target[n] / sizes[n] if sizes[n] else 0.0
        for at, row in enumerate(sorted(order, key=lambda o: o[:5])):
            copies = math.floor((at + 1) * rate + mixing.offset()) - math.floor(at * rate + mixing.offset())
            for k in range(copies):
                out[row[5], row[6], n, k + 1, row[4], sizes[n]] += 1
    return out


def test_pipeline_against_plain_stages(spark, tmp_path):
    rows, items = corpus()
    docs = spark.createDataFrame([(d, t, x, s, len(t or "")) for d, t, x, s in rows], SCHEMA)
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = Counter((r.doc_id, r.text, r.source, r.copy, r["size"], r.source_size) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == plain(rows, items)
