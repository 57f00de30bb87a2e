"""Disguises that have to reach the decoder, and the decoder against all readings."""

import itertools
import random

import numpy as np

from flowloom.llm import toxicity
from test_ops import prose, table

LONG = "worthlessgoodfornothing"
BAD = ["idiot", "moron", "bigot", LONG]


def channel(spark):
    rows = [(i, prose(30, 1000 + i) + f" {BAD[i % 4]} " + prose(30, 2000 + i)) for i in range(240)]
    return toxicity.Channel(toxicity.language_model(table(spark, rows)))


def test_disguises_are_decoded(spark):
    c = channel(spark)
    hidden = {"idiiot": "idiot", "mooron": "moron", "81607": "bigot", "id" + "i" * 60 + "ot": "idiot", ".".join(LONG): LONG, "m0r0n" + "!" * 50: "moron"}
    assert {h: c.restored(h) for h in hidden} == hidden
    assert [c.restored(w) for w in ("cloud", "moron")] == ["cloud", "moron"]
    assert c.restored("x" * 30_000)
    spaced = {"i d i o t": "idiot", "i  d  i  o  t": "idiot", "i\nd\ni\no\nt": "idiot", "id iot": "idiot", "1 d i 0 t": "idiot", "o f i d i o t": "of idiot", "m o r o n o f": "moron of"}
    assert {h: c.rejoined(h) for h in spaced} == spaced
    assert c.rejoined("of the elk") == "of the elk"


def test_spaced_words_are_scored(spark):
    rows = [(i, prose(30, 1000 + i) + (f" {BAD[i % 4]} " if i % 4 < 3 else " ") + prose(30, 2000 + i)) for i in range(240)]
    hidden = ["i d i o t", "id iot", "m\no\nr\no\nn", "b  1  g  0  t", "o f m o r o n"]
    rows += [(1000 + i, f"{prose(20, i)} {h} {prose(20, 50 + i)}") for i, h in enumerate(hidden)]
    rows += [(2000 + i, prose(400, 3000 + i)) for i in range(10)] + [(3000, "moron " * 20_000), (3001, "moron"), (3001, "moron")]
    labels = spark.createDataFrame([(i, int(i % 4 < 3)) for i in range(240)], "doc_id long, toxic int")
    got = toxicity.toxicity(table(spark, rows), labels).collect()
    assert len(got) == len(rows)
    assert all(r.predicted for r in got if 1000 <= r.doc_id < 2000 or r.doc_id >= 3000) and not any(r.predicted for r in got if 2000 <= r.doc_id < 3000)
    assert len({r.score for r in got if r.doc_id >= 3000}) == 1  # a word counts once


DISGUISES = {
    "letters for signs": lambda w: w.translate(str.maketrans("oiest", "01357")),
    "spaced": " ".join,
    "spaced twice": "  ".join,
    "by lines": "\n".join,
    "in two pieces": lambda w: w[: len(w) // 2] + " " + w[len(w) // 2 :],
    "repeated": lambda w: w[:2] + w[2] * 3 + w[3:],
    "all twice": lambda w: "".join(c * 2 for c in w),
    "dotted": ".".join,
    "spaced among letters": lambda w: "a " + " ".join(w) + " b",
    "spaced signs": lambda w: " ".join(w.translate(str.maketrans("oiest", "01357"))),
    "spaced after a word that ends alike": lambda w: f"x{w[0]} " + " ".join(w),
}


def test_every_learned_word_in_every_disguise(spark):
    """On the words learned from sf0.01, alone and inside prose; clean prose hides none."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fitted(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"))
    words = model.strong()
    assert len(words) > 3
    texts = {(w, name, where): where.format(hide(w)) for w in words for name, hide in DISGUISES.items() for where in ("{}", "eaea ndorea edst {} threeain for heed")}
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts.values())], "doc_id long, text string")
    got = {r.doc.doc_id: r.score for r in toxicity.scored(rows, model).collect()}
    assert not [key for i, key in enumerate(texts) if got[i] < 0.5]
    clean = docs.join(labels.filter("toxic = 0"), "doc_id").select("text").collect()
    hidden = toxicity.Vocabulary(words, model.costs)
    assert not [h for r in clean if (h := hidden.hidden((r.text or "").lower()) - set((r.text or "").lower().split()))]
    assert hidden.hidden("") == hidden.hidden(" \n.,") == toxicity.Vocabulary([], model.costs).hidden("t r a s h") == set()
    assert toxicity.Vocabulary(["trash"], model.costs).hidden("youtrash " + "x" * 50_000 + " t r a s h") == {"trash"}


def test_the_beam_loses_nothing_on_long_strings(spark, monkeypatch):
    c, r = channel(spark), random.Random(6)
    texts = ["".join(r.choice("id1o0t!@s5 m$rgn") for _ in range(40)).strip() for _ in range(12)] + [" ".join("idiotmoronbigot"), "m.o.r.o.n b1g0t iiidiooot of the elk"]
    beam = [c.decoded(t) for t in texts]
    monkeypatch.setattr(toxicity, "STATES", 10**9)
    monkeypatch.setattr(toxicity, "MARGIN", 1e9)
    exact = [c.decoded(t) for t in texts]
    assert [cost_of(b, t, c.costs) for b, t in zip(beam, texts, strict=True)] == [cost_of(e, t, c.costs) for e, t in zip(exact, texts, strict=True)]


def readings(text, costs):
    """The least cost of all paths through the lattice, by recursion."""

    def go(at, a, b, last, cost, some):
        if at == len(text):
            yield cost + (costs[a][b][0] if b or not some else 0.0)
            return
        ch = text[at]
        if ch == " ":
            if not b:
                yield from go(at + 1, a, b, last, cost, some)
            else:
                yield from go(at + 1, a, b, last, cost + toxicity.GAP, some)
                yield from go(at + 1, b, 0, "", cost + costs[a][b][0], some)
            return
        for c, extra in own(ch):
            code = toxicity._CODE.get(c, toxicity.OTHER)
            yield from go(at + 1, b, code, ch, cost + extra + costs[a][b][code], True)
            if b:
                yield from go(at + 1, 0, code, ch, cost + extra + toxicity.SPLIT + costs[a][b][0] + costs[b][0][code], True)
        if ch == last or not ch.isalpha():
            yield from go(at + 1, a, b, ch if ch == last else last, cost + without(ch, last), some)

    return min(go(0, 0, 0, "", 0.0, False))


def own(ch):
    return [(c, toxicity.SUBSTITUTED) for c in toxicity.STANDS_FOR.get(ch, "")] + [(ch, 0.0 if ch.isalpha() else toxicity.KEPT)]


def without(ch, last):
    return toxicity.REPEATED if ch == last else toxicity.LOST if ch in toxicity.STANDS_FOR else toxicity.DROPPED


def cost_of(word, text, costs):
    """The least cost of a path that reads ``text`` as ``word``."""
    seen = {(0, 0, 0, "", 0): 0.0}
    for ch in text:
        nxt = {}
        for (w, a, b, last, _), cost in seen.items():

            def put(key, c, nxt=nxt):
                nxt[key] = min(c, nxt.get(key, 1e18))

            if ch == " ":
                if not b:
                    put((w, a, b, last, 0), cost)
                else:
                    put((w, a, b, last, 0), cost + toxicity.GAP)
                    if word[w : w + 1] == " ":
                        put((w + 1, b, 0, "", 0), cost + costs[a][b][0])
                continue
            for c, extra in own(ch):
                code = toxicity._CODE.get(c, toxicity.OTHER)
                if word[w : w + 1] == c:
                    put((w + 1, b, code, ch, 0), cost + extra + costs[a][b][code])
                if b and word[w : w + 2] == " " + c:
                    put((w + 2, 0, code, ch, 0), cost + extra + toxicity.SPLIT + costs[a][b][0] + costs[b][0][code])
            if ch == last or not ch.isalpha():
                put((w, a, b, ch if ch == last else last, 0), cost + without(ch, last))
        seen = nxt
    return min(cost + (costs[a][b][0] if b or not word else 0.0) for (w, a, b, _, _), cost in seen.items() if w == len(word))


def test_viterbi_finds_the_cheapest_of_all_readings(spark):
    c, r = channel(spark), random.Random(1)
    for _ in range(60):
        text = "".join(r.choice("id1o0t!@s5 m$r") for _ in range(r.randint(1, 7))).strip()
        if text:
            assert np.isclose(cost_of(c.decoded(text), text, c.costs), readings(text, c.costs)), text
    assert not list(itertools.islice(c.decoded(""), 1))
