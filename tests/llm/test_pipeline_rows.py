"""Stages of the pipeline on planted near copies, null, repeated and shared ids."""

import random

import corpus_pipeline
from flowloom.llm import resemble, simhash
from flowloom.llm.text import words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(n, seed):
    r = random.Random(seed)
    return [f"w{r.randrange(5000)}" for _ in range(n)]


def edited(tokens, *at):
    return [f"new{i}" if i in at else w for i, w in enumerate(tokens)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA).repartition(3)


def jaccard(a, b):
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_near_copies_of_several_words_are_found(spark):
    texts = []
    for k in range(40):
        base = prose(200, k)
        texts += [" ".join(base), " ".join(edited(base, *range(5, 5 + 40 * (k % 5), 40)))]
    hub = prose(120, 99)
    texts += [" ".join(edited(hub, i)) for i in range(1, 30)] + ["one two", "ONE two", "one three", "", None]
    got = {r.row: r.component for r in resemble.resemblance_groups(spark.createDataFrame(list(enumerate(texts)), "row long, text string")).collect()}
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if (texts[i] or "").split() and (texts[j] or "").split():
                near = jaccard(texts[i], texts[j]) >= 0.8
            else:
                near = not (texts[i] or "").split() and not (texts[j] or "").split()
            if near and root[i] != root[j]:
                root = [root[j] if r == root[i] else r for r in root]
    assert all((got[i] == got[j]) == (root[i] == root[j]) for i in got for j in got)
    assert any(jaccard(texts[2 * k], texts[2 * k + 1]) < 0.9 and got[2 * k] == got[2 * k + 1] for k in range(40))


def test_crowded_bands_of_unlike_texts(spark):
    """A long common passage puts thousands of unlike texts into the same bands; the few alike ones are found without all pairs."""
    common, texts = prose(120, 5), []
    for k in range(3000):
        own = prose(60, 1000 + k)
        texts.append(" ".join(common + own))
        if k % 500 == 0:
            texts.append(" ".join(common + edited(own, 7)))
    rows = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    got = {r.row: r.component for r in resemble.resemblance_groups(rows).collect()}
    pairs = {(min(i, j), max(i, j)) for i, j in got.items() if i != j}
    assert len(pairs) == 6 and all(j == i + 1 for i, j in pairs)
    found = spark.createDataFrame([(k, k, sorted(resemble.shingle_set(t).view("int64").tolist())) for k, t in enumerate(texts)], "node long, piece long, found array<long>")
    could = {tuple(r) for r in resemble._could_resemble(resemble._rarest(found, 0.8), 0.8).collect()}
    assert pairs <= could and len(could) < 100


def test_stages_decide_by_row(spark):
    one, two, three = (prose(150, s) for s in (1, 2, 3))
    text = " ".join
    rows = [(1, text(one)), (1, text(one)), (1, text(two)), (None, text(one)), (None, text(edited(one, 70))), (7, text(three)), (None, text(three)), (None, text(three))]
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, frame(spark, rows), "").collect()), key=repr)
    assert got == sorted([(1, text(one)), (1, text(two)), (7, text(three))], key=repr)
    sf_dir = "/root/testdata/sf0.001"
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first().text
    bad, clean = text(one[:50]) + f" {item} " + text(one[50:]), text(two)
    rows = [(None, bad), (None, clean), (5, bad), (5, clean), (5, clean), (6, None)]
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.decontamination(spark, frame(spark, rows), sf_dir).collect()), key=repr)
    assert got == sorted([(None, clean), (5, clean), (5, clean), (6, None)], key=repr)


BIG = 2**60


def test_large_ids_beside_nulls_stay_apart(spark):
    """pandas would make doubles of them: 2**60 + 1 and 2**60 + 3 would be one id."""
    import public_tokenizers
    from flowloom.llm import decontaminate, exact, language, lines, mixing, quality, simhash, suffixes, tokens, toxicity

    texts = [" ".join(prose(40, s)) for s in (1, 2, 3)]
    ids = [BIG + 1, None, BIG + 3]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in zip(ids, texts)], SCHEMA).coalesce(1)
    bench = spark.createDataFrame([(BIG + 1, texts[0]), (None, texts[1]), (BIG + 3, texts[2])], "item_id long, text string").coalesce(1)
    labels = spark.createDataFrame([(BIG + 1, 1, 0), (BIG + 3, 1, 1)], "doc_id long, quality int, toxic int")
    found = {
        "op1": simhash.near_duplicates(docs), "op2": toxicity.toxicity(docs, labels), "op3": decontaminate.contaminated(docs, bench),
        "op4": tokens.token_counts(docs, str(public_tokenizers.path("piece_bpe_32k.model"))), "op5": exact.exact_duplicates(docs), "op6": mixing.mixed(docs),
        "op7": language.identified(docs), "op8": quality.resampled(docs, labels), "op9": lines.without_common_lines(docs), "op10": suffixes.without_repeats(docs),
    }
    for name, df in found.items():
        assert {r.doc_id for r in df.collect()} == set(ids), name
    assert {(r.doc_id, r.item_id) for r in found["op3"].collect()} == {(i, i) for i in ids}
    assert {(r.doc_id, r.component_id) for r in found["op1"].collect()} == {(i, i) for i in ids}
    for name, stage in corpus_pipeline.STAGES[:3]:
        assert {r.doc_id for r in stage(spark, docs, "/root/testdata/sf0.001").collect()} == set(ids), name
    assert {r.doc_id for r in corpus_pipeline.mixing_sources(spark, docs, "").collect()} <= set(ids)


def test_stages_take_clashing_columns_and_empty_tables(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = frame(spark, [(i, " ".join(prose(60, i))) for i in range(4)] + [(None, None), (9, ""), (10, "word " * 20_000)])
    more = docs.selectExpr("*", "1 as row", "2 as found", "3 as doc", "4 as size", "5 as target", "6 as n_lines", "7 as copy")
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, more, sf_dir)
        assert got.columns[:5] == list(corpus_pipeline.COLUMNS), name
        assert sorted(map(repr, got.collect())) == sorted(map(repr, stage(spark, docs, sf_dir).collect())), name
        assert stage(spark, docs.limit(0), sf_dir).count() == 0, name


def test_near_dedup_joins_what_fingerprints_link(spark):
    notice, text = prose(3, 1) * 120, " ".join
    a, b, c = text(notice + prose(12, 2)), text(notice + prose(12, 3)), text(prose(150, 4))
    x, y = simhash.simhash(words(a)), simhash.simhash(words(b))
    assert (x ^ y).bit_count() <= 3
    sets = [set(resemble.shingle_set(t).tolist()) for t in (a, b)]
    assert len(sets[0] & sets[1]) < 0.8 * len(sets[0] | sets[1])
    # d resembles b alone, so one group is made of links of both kinds
    d = text([*notice, *prose(12, 3), "added"])
    got = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, frame(spark, [(5, a), (4, b), (3, d), (2, c)]), "").collect())
    assert got == [2, 3]
