"""Each operator against brute force, over nulls, blanks, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from flowloom.llm import components, decontaminate, exact, language, lines, mixing, quality, simhash, suffixes, tokens, toxicity
from flowloom.llm.text import words

#: Further columns of names that operators use themselves.
CLASH = {
    "key": "k", "h": "1", "count": "2", "mark": "m", "pos": "3", "rank": "4", "class": "c", "len": "5", "n_lines": "6", "n_dropped": "7", "__mark": "8", "__copies": "9", "row": "10", "doc": "11",
    "found": "12", "score": "13", "size": "14", "copies": "15", "copy": "16", "id": "17", "n": "18", "name": "19", "block": "20", "part": "21", "data": "22", "kept": "23", "spans": "24", "fp": "25", "taken": "26", "target": "27", "dotted.name": "28",
}
SCHEMA = "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` string" for c in CLASH)


def table(spark, rows):
    """(doc_id, text[, lang, source]) rows, with further columns of names that operators use themselves."""
    return spark.createDataFrame([(*r, *(None,) * (4 - len(r)), *CLASH.values()) for r in rows], SCHEMA).repartition(3)


RND = random.Random(5)
VOCAB = ["the", "of", "Sea", "sand", "über", "river", "stone", "cloud", "moss", "fern", "owl", "elk", "ash", "oak"]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) + r.choice(["", "", "", ",", "ly", "s"]) for _ in range(n))


ODD = [(None, "some words here"), (None, None), (50, None), (51, ""), (52, " \t\n"), (53, "one"), (53, "one"), (54, "ONE"), (55, "x" * 30_000), (56, prose(4000, 9)), (57, "  é\x00z")]
DOCS = [(i, prose(60, i % 17)) for i in range(40)] + [(100 + i, prose(60, i)[: -3 - i % 4]) for i in range(10)] + ODD


def test_simhash_against_all_pairs(spark):
    got = simhash.near_duplicates(table(spark, DOCS)).collect()

    def fp(text):
        w = words(text)
        grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    fps = [fp(t) for _, t in DOCS]
    group = list(range(len(DOCS)))
    for i in range(len(DOCS)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                group = [group[j] if g == group[i] else g for g in group]
    least = {g: min((d for (d, _), k in zip(DOCS, group) if k == g and d is not None), default=None) for g in group}
    want = Counter((d, f"{f:016x}", least[g]) for (d, _), f, g in zip(DOCS, fps, group))
    assert Counter(tuple(r) for r in got) == want
    assert simhash.near_duplicates(table(spark, [])).count() == 0


def test_crowded_buckets_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 8)
    r = random.Random(1)
    centre = [r.getrandbits(64) for _ in range(4)]
    fps = {c ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 5))) for c in centre for _ in range(60)}
    df = spark.createDataFrame([(simhash.signed(f),) for f in fps], "fp long")
    got = {tuple(sorted((x.a, x.b))) for x in simhash.links(df).collect()}
    parent = {simhash.signed(f): simhash.signed(f) for f in fps}

    def find(p, x):
        while p[x] != x:
            x = p[x]
        return x

    mine = dict(parent)
    for a, b in got:
        mine[find(mine, a)] = find(mine, b)
    for a in parent:
        for b in parent:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 3:
                parent[find(parent, a)] = find(parent, b)
    split = lambda p: {frozenset(x for x in p if find(p, x) == root) for root in {find(p, x) for x in p}}
    assert split(mine) == split(parent)


def test_masks_cover_every_triple():
    r, masks = random.Random(2), simhash.covering_masks(list(range(64)), 3)
    assert len(masks) == 15
    for _ in range(2000):
        bits = sum(1 << b for b in r.sample(range(64), 3))
        assert any(not m & bits for m in masks)


def test_components_of_chains_and_hubs(spark):
    chain = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 40)] + [(7000, 7000)]
    got = components.components(spark.createDataFrame(chain, "a long, b long")).collect()
    groups = defaultdict(set)
    for r in got:
        groups[r.root].add(r.node)
    assert sorted(map(len, groups.values())) == [40, 61]
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_exact_groups(spark):
    rows = [*DOCS, (200, prose(4000, 9).upper()), (201, prose(4000, 9) + "x"), (202, "ÉA"), (203, "éa"), (204, "Éa")]
    weak = lambda part, seed: F.struct((F.length(part) if seed == 0 else F.xxhash64(part)).cast("long").alias("h"), F.lit(0).alias("i"))
    for block, hashed in ((5, exact.hash_pair), (8192, exact.hash_pair), (5, weak)):
        got = exact.exact_duplicates(table(spark, rows), block, hashed).collect()
        low = lambda t: (t or "").encode().lower()
        groups = defaultdict(list)
        for d, t in rows:
            groups[low(t)].append(d)
        best = lambda ds: max((d for d in ds if d is not None), default=None)
        want = Counter((d, best(groups[low(t)]), len(groups[low(t)]), hashlib.sha256(low(t)).hexdigest()) for d, t in rows)
        assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
        assert sum(r.kept for r in got) == len(groups) and all(r.doc_id == r.keep_id for r in got if r.kept)
    assert exact.exact_duplicates(table(spark, [])).count() == 0


def test_mix_meets_targets(spark):
    r = random.Random(3)
    rows = [(i, prose(r.randint(0, 300), i), None, None if i % 11 == 0 else f"s{r.choice('aaaab')}{i % 3}") for i in range(900)]
    rows += [(None, "a b", None, "tiny"), (5005, None, None, "empty"), (5006, " ", None, "empty"), *rows[:3]]
    got = mixing.mixed(table(spark, rows)).collect()
    again = mixing.mixed(table(spark, rows).repartition(7)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again)) and len(got) == len(rows)
    sizes = defaultdict(int)
    for row in rows:
        sizes[row[3]] += len((row[1] or "").split())
    names = sorted(n for n in sizes if n is not None) + [None]
    weight = {n: (3, 1, 2)[i % 3] for i, n in enumerate(names)}
    target, open_, left = {}, set(names), 1.5 * sum(sizes.values())
    while True:
        share = {n: left * weight[n] / sum(weight[m] for m in open_) for n in open_}
        full = [n for n in open_ if share[n] > 2 * sizes[n]]
        if not full:
            target |= share
            break
        for n in full:
            target[n] = 2 * sizes[n]
            left -= target[n]
            open_.discard(n)
    taken, goal = Counter(), {}
    by_id = {row[0]: row[3] for row in rows}
    for g in got:
        assert g.taken == g.copies * g["size"] and 0 <= g.copies <= 2
        taken[by_id[g.doc_id]] += g.taken
        goal[by_id[g.doc_id]] = g.target
    for n in names:
        assert goal[n] == pytest.approx(target[n])
        assert abs(taken[n] - goal[n]) <= 320
    assert mixing.mixed(table(spark, [])).count() == 0
    mix = mixing.mixture(table(spark, rows))
    assert mix.select("doc.*").columns == table(spark, []).columns
    assert Counter((r.doc.doc_id, r.doc.text) for r in mix.collect()).total() == sum(g.copies for g in got)
    assert mixing.mixture(table(spark, [])).count() == 0


def test_lines(spark):
    rows = [(i, f"own {i}\n Shared LINE\t\n\nkeep\r") for i in range(12)] + [(100, "shared line"), (101, None), (102, ""), (101, None), (None, "x\ny"), (103, "\n" * 500 + "keep")]
    rows += [(104, "solo\nsolo\nsolo")] * 2
    got = Counter((r.doc.doc_id, r.doc.text, r.found.n_lines, r.found.n_dropped) for r in lines.line_dedup(table(spark, rows)).collect())
    key = lambda x: x.strip(" \t\n\v\f\r").encode().lower()
    seen = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")})
    want = Counter()
    for d, t in rows:
        all_ = (t or "").split("\n")
        kept = [x for x in all_ if not (key(x) and seen[key(x)] >= 10)]
        want[d, None if t is None else "\n".join(kept), len(all_), len(all_) - len(kept)] += 1
    assert got == want
    assert lines.without_common_lines(table(spark, rows)).columns == table(spark, []).columns
    assert {tuple(r)[4:] for r in lines.without_common_lines(table(spark, rows)).collect()} == {tuple(CLASH.values())}
    assert lines.without_common_lines(table(spark, [])).count() == 0


def brute_suffixes(docs, length):
    seen, out = set(), {}
    for d, t in sorted(docs):
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if t[i : i + length] in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(t[i : i + length])
        out[d] = bytes(b for b, g in zip(t, gone) if not g), sum(a and not b for a, b in zip(gone, b"\0" + gone))
    return out


@pytest.mark.parametrize("how", [{}, {"together": 1}, {"hot": 3, "ranged": 50}, {"hot": 1, "piece": 64, "ranged": 500}])
def test_suffixes(spark, monkeypatch, how):
    r = random.Random(3)
    piece = lambda n: "".join(r.choice("abcd é") for _ in range(r.randint(0, n)))
    base = [piece(300) for _ in range(10)]
    docs = [(d, "".join(r.choice([r.choice(base), piece(60)]) for _ in range(r.randint(0, 5)))) for d in range(80)] + [(90, "z" * 500)]
    df = table(spark, [*docs, (95, None), (96, ""), docs[3]])
    monkeypatch.setattr(suffixes, "MOST_HOT", 10**9)
    want = brute_suffixes([(d, t.encode()) for d, t in docs], 20) | {95: (b"", 0), 96: (b"", 0)}
    got = suffixes.without_repeats(df, length=20, gram=8, **how).collect()
    assert len(got) == len(docs) + 3
    for g in got:
        kept, spans = want[g.doc_id]
        assert (bytes(g.kept), g.n_spans, g.n_bytes - g.n_removed) == (kept, spans, len(kept))


def test_suffixes_null_ids_come_first(spark):
    text = prose(80, 1)
    got = {r.doc_id: r.n_removed for r in suffixes.without_repeats(table(spark, [(1, text), (None, text)])).collect()}
    assert got == {None: 0, 1: len(text.encode())}
    other = prose(90, 2)
    got = sorted((r.doc_id, r.n_bytes, r.n_removed) for r in suffixes.without_repeats(table(spark, [(5, text), (5, text + other), (6, other), (7, "q" * 300_000)]), piece=200_000).collect())
    a, b = len(text.encode()), len(other.encode())
    assert got[2] == (6, b, b) and got[3][2] > 299_000
    assert {(n, gone > 0) for _, n, gone in got[:2]} in ({(a, True), (a + b, False)}, {(a, False), (a + b, True)})
    assert suffixes.without_repeats(table(spark, [])).count() == 0


def test_loser_tree_merges_and_keeps_prefixes():
    r = random.Random(4)
    runs = [sorted({bytes(r.choice(b"ab") for _ in range(r.randint(0, 9))) for _ in range(n)}) for n in (0, 1, 30, 40, 7)]
    coded = [suffixes.coded([(k, i, j, 2, 3, False) for j, k in enumerate(keys)], [(b"", 9, 9, 9, 9, True)]) for i, keys in enumerate(runs)]
    decoded = [suffixes.decoded(c) for c in coded]
    assert all(d[1] == [(9, 9, 9, 9)] for d in decoded)
    out = list(suffixes.merged([d[0] for d in decoded]))
    assert [e[0] for _, e in out] == sorted(k for keys in runs for k in keys)
    for (_, a), (n, b) in zip(out, out[1:]):
        assert n == suffixes.shared(a[0], b[0], 0)
    assert list(suffixes.merged([])) == []


def test_token_counts(spark):
    import public_tokenizers
    import sentencepiece

    model = str(public_tokenizers.path("piece_bpe_32k.model"))
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    rows = [*DOCS, (300, "  two  spaces "), (301, "<s>▁a ▁▁b</s> <unk>"), (302, "日本語\n\n tab\tx"), (303, "    ")]
    got = Counter(map(tuple, tokens.token_counts(table(spark, rows), model, 50).collect()))
    want = Counter((d, len((t or "").encode()), n := len(sp.encode(t or "")), n > 50) for d, t in rows)
    assert got == want


def test_language(spark):
    latin, greek = ["lorem ipsum dolor sit amet"] * 20, ["αυτό είναι ένα κείμενο στα ελληνικά"] * 20
    rows = [(i, f"{t} {i}", "la") for i, t in enumerate(latin)] + [(100 + i, t, "el") for i, t in enumerate(greek)]
    rows += [(200, None, "la"), (201, "12 !?", "la"), (202, "ipsum amet", None), (None, "είναι κείμενο", None), rows[0]]
    got = language.identified(table(spark, rows)).collect()
    assert len(got) == len(rows)
    found = {r.doc_id: (r.lang_pred, r.score) for r in got}
    assert found[200] == found[201] == ("und", 0.0) and found[202][0] == "la" and found[None][0] == "el"
    assert all(found[i][0] == "la" and found[100 + i][0] == "el" for i in range(20)) and all(0 <= s <= 1 for _, s in found.values())
    assert {r.lang_pred for r in language.identified(table(spark, [(1, "abc", None)])).collect()} == {"und"}
    docs = table(spark, rows)
    few, many = (language.fitted_profiles(docs, languages=n) for n in (1000, 1))
    assert isinstance(few, dict) and len(few) > 1 and not isinstance(many, dict)
    told = lambda profiles: Counter((r.doc.doc_id, r.doc.text, r.found.lang_pred, round(r.found.score, 12)) for r in language.predicted(docs, profiles).collect())
    assert told(few) == told(many)
    assert language.identified(table(spark, [])).count() == 0


def test_language_against_plain_profiles(spark):
    langs = {"aa": "the cat sat on the mat und", "bb": "der hund und die katze the", "cc": "le chat est sur la table"}
    rows = [(i, " ".join(random.Random(i).choices(t.split(), k=12)), x) for i, (x, t) in enumerate(list(langs.items()) * 20)]
    rows += [(100, "the und la", None), (101, "x" * 40_000 + " le chat", None), (102, "ÄÖ 12 the", None), rows[4]]

    def grams(text):
        out = Counter()
        for w in re.findall(r"[^\W\d_]+", text.lower()):
            w = f" {w} "
            out.update(w[i : i + n] for n in (1, 2, 3) for i in range(len(w) - n + 1) if w[i : i + n] != " ")
        return out

    def top(counts):
        return sorted(counts, key=lambda g: (-counts[g], [ord(c) if c != " " else -1 for c in g] and sum((ord(c) + 1 if c != " " else 1) << 21 * k for k, c in enumerate(reversed(g)))))[:50]

    held = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 3 == 1
    profiles = {x: top(sum((grams(t) for d, t, y in rows if y == x and not held(d)), Counter())) for x in langs}
    want = Counter()
    for d, t, _ in rows:
        mine = top(grams(t))
        away = {x: sum(abs(k - p.index(g)) if g in p else 50 for k, g in enumerate(mine)) for x, p in profiles.items()}
        best = min(away, key=lambda x: (away[x], x))
        want[d, held(d), best, round(1 - away[best] / (50 * len(mine)), 9)] += 1
    got = language.identified(table(spark, rows), ranks=50).collect()
    assert Counter((r.doc_id, r.held_out, r.lang_pred, round(r.score, 9)) for r in got) == want


def test_decontamination(spark):
    items = [(1, prose(30, 101)), (2, prose(12, 102)), (3, "three word item"), (4, None), (5, " "), (None, prose(20, 103))]
    near = items[0][1].split()
    near[2] = "changed"
    docs = [(i, prose(100, 200 + i)) for i in range(10)]
    docs += [(20, docs[0][1] + "\n" + items[0][1].upper() + "\n" + docs[1][1]), (21, items[1][1] + " tail"), (22, " ".join(near) + " end"), (23, "a Three  word item b"), (24, None), (25, ""), (None, "x " + items[5][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs += [(30, " ".join(items[0][1].split()[:-2])), (31, items[0][1]), (31, items[0][1]), (32, prose(3000, 77) + " " + items[1][1])]
    items += [(7, items[0][1]), (2**60 + 1, items[1][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for part in (decontaminate.PART, 150):
        got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.contaminated(table(spark, docs), bench, part=part).collect()}
        want = {}
        for d, t in docs:
            for k, item in items:
                w, x = words(t), words(item)
                if not x:
                    continue
                a = Counter(decontaminate.shingles(x, 5))
                for i in range(max(1, len(w) - len(x) + 1)):
                    b = Counter(decontaminate.shingles(w[i : i + len(x)], 5))
                    s = sum((a & b).values()) / sum((a | b).values())
                    if s >= 0.8 and s > want.get((d, k), 0):
                        want[d, k] = s
        assert got == pytest.approx(want) and (20, 1) in got and (21, 2) in got and (23, 3) in got and (None, None) in got and (30, 1) in got and (31, 7) in got
    assert decontaminate.contaminated(table(spark, []), bench).count() == 0
    assert decontaminate.contaminated(table(spark, docs), bench.limit(0)).count() == 0


def test_toxicity_reads_through_disguise(spark):
    bad = ["idiot", "moron", "worthless"]
    rows = [(i, prose(30, 1000 + i) + (f" {bad[i % 3]} " if i % 4 == 0 else " ") + prose(30, 2000 + i)) for i in range(240)]
    hidden = ["1d10t", "m0r0n", "w0rthless", "idiiiot", "i d i o t", "m.o.r.o.n", "!diot"]
    rows += [(1000 + i, f"{prose(20, i)} {h} {prose(20, 50 + i)}") for i, h in enumerate(hidden)]
    rows += [(2000 + i, prose(40, 3000 + i)) for i in range(10)] + [(3000, None), (3001, ""), (None, "moron")]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(240)] + [(3000, None), (None, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(table(spark, rows), labels).collect()}
    assert all(got[i].predicted == int(i % 4 == 0) for i in range(240))
    assert sum(got[1000 + i].predicted for i in range(len(hidden))) >= len(hidden) - 1
    assert not any(got[2000 + i].predicted for i in range(10)) and got[None].predicted == 1 and got[3000].predicted == got[3001].predicted == 0
    assert all(0 <= r.score <= 1 for r in got.values())
    assert toxicity.toxicity(table(spark, []), labels).count() == 0
    assert {r.predicted for r in toxicity.toxicity(table(spark, rows[:5]), labels.limit(0)).collect()} == {0}


def test_quality_keeps_the_like_of_the_target(spark):
    junk = lambda i: " ".join(random.Random(i).choice(["$$", "##", "click", "win", "!!"]) for _ in range(60))
    rows = [(i, prose(60, i)) for i in range(80)] + [(100 + i, junk(i)) for i in range(20)] + [(200, None), (None, ""), (5, prose(60, 5))]
    labels = spark.createDataFrame([(i, 1) for i in range(40)] + [(100, 0), (None, None)], "doc_id long, quality int")
    got = quality.resampled(table(spark, rows), labels, share=0.6).collect()
    assert len(got) == len(rows) and sum(r.kept for r in got) == round(0.6 * len(rows))
    assert sum(r.kept for r in got if r.doc_id is not None and 100 <= r.doc_id < 200) <= 2
    assert quality.resampled(table(spark, []), labels).count() == 0
    assert {r.log_weight for r in quality.resampled(table(spark, rows[:3]), labels.limit(0)).collect()} == {0.0}


def test_quality_against_plain_counts(spark):
    rows = [(i, prose(30 + i % 7, i) + (" click win" if i % 3 == 0 else "")) for i in range(60)] + [(60, None), (None, "x"), (5, prose(35, 5)), (61, prose(5000, 3))]
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(40)], "doc_id long, quality int")
    mask = 2**64 - 1

    def buckets(text):
        h = [xxhash.xxh64_intdigest(w) for w in words(text)]
        pairs = [(a * 0x9E3779B97F4A7C15 & mask) ^ b for a, b in zip(h, h[1:])]
        return [(x >> 16) % 500 for x in (*h, *((p ^ p >> 29) * 0xBF58476D1CE4E5B9 & mask for p in pairs))]

    raw = Counter(b for _, t in rows for b in buckets(t))
    target = Counter(b for d, t in rows if d in range(40) and d % 3 for b in buckets(t))
    ratio = [np.log((target[b] + 1) / (target.total() + 500)) - np.log((raw[b] + 1) / (raw.total() + 500)) for b in range(500)]
    want, keys = Counter(), []
    for d, t in rows:
        w = sum(ratio[b] for b in buckets(t))
        u = (xxhash.xxh64_intdigest(str(-1 if d is None else d), 11) + 0.5) / 2.0**64
        keys.append((w - np.log(-np.log(u)), d, round(w, 6)))
    keys.sort(key=lambda k: -k[0])
    got = quality.resampled(table(spark, rows), labels, share=0.5, buckets=500).collect()
    assert Counter((r.doc_id, round(r.log_weight, 6)) for r in got) == Counter((d, w) for _, d, w in keys)
    assert Counter(r.doc_id for r in got if r.kept) == Counter(d for _, d, _ in keys[: round(0.5 * len(rows))])


def test_top_k_is_exact_among_ties(spark):
    r = random.Random(6)
    rows = [(r.choice([3, 2**40, 2**62, r.getrandbits(62)]), i) for i in range(200)]
    df = spark.createDataFrame(rows, "key long, doc_id long")
    for k in (0, 1, 37, 120, 200):
        assert sorted(map(tuple, quality.top_k(df, k).collect())) == sorted(sorted(rows, reverse=True)[:k])
