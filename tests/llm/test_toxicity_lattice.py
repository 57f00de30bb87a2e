"""Known words as arcs of the decoder's lattice, across gaps too, against all readings."""

import random

import numpy as np
import pytest

from flowloom.llm import toxicity
from test_ops import table
from test_toxicity_gate import channel, own, without

WORDS = ["idiot", "moron", "rid", "dim"]


@pytest.fixture(scope="module")
def costs(spark):
    return np.array(channel(spark).costs)


def cheapest(text, costs, words):
    """The cheapest of all paths through the lattice with the arcs of ``words``, by recursion: its cost and what it reads."""

    def outside(at, a, b, last, cost, read):
        if at == len(text):
            yield cost + (costs[a][b][0] if b or not read else 0.0), read
            return
        ch = text[at]
        for w in words if ch != " " else ():
            start = cost + toxicity.WORD + (toxicity.BORDER + costs[a][b][0] if b else 0.0)
            yield from inside(at, w, 0, "", bool(b), False, start, read + " " if b else read)
        if ch == " ":
            if not b:
                yield from outside(at + 1, a, b, last, cost, read)
            else:
                yield from outside(at + 1, a, b, last, cost + toxicity.GAP, read)
                yield from outside(at + 1, b, 0, "", cost + costs[a][b][0], read + " ")
            return
        for c, extra in own(ch):
            code = toxicity._CODE.get(c, toxicity.OTHER)
            yield from outside(at + 1, b, code, ch, cost + extra + costs[a][b][code], read + c)
            if b:
                yield from outside(at + 1, 0, code, ch, cost + extra + toxicity.SPLIT + costs[a][b][0] + costs[b][0][code], read + " " + c)
        if ch == last or not ch.isalpha():
            yield from outside(at + 1, a, b, ch if ch == last else last, cost + without(ch, last), read)

    def inside(at, w, n, last, begun, gaps, cost, read):
        if n == len(w):
            border = at == len(text) or text[at] == " "
            if border or not gaps:
                yield from outside(at, 0, 0, "", cost + (0.0 if border else toxicity.BORDER), read + w + " ")
        if at == len(text):
            return
        ch = text[at]
        if ch == " ":
            if n and not begun:
                yield from inside(at + 1, w, n, last, begun, True, cost + toxicity.GAP, read)
            return
        for c, extra in own(ch):
            if w[n : n + 1] == c:
                yield from inside(at + 1, w, n + 1, ch, begun, gaps, cost + extra, read)
        if n and (ch == last or not ch.isalpha()):
            yield from inside(at + 1, w, n, ch if ch == last else last, begun, gaps, cost + without(ch, last), read)

    cost, read = min(outside(0, 0, 0, "", 0.0, ""))
    return cost, read


def test_one_path_is_the_cheapest_of_all_readings(costs):
    c, r = toxicity.Channel(costs, WORDS), random.Random(3)
    texts = ["r i d", "xrid", "ridx", "r.i d", "rr id", "d i m r", "r 1 d i m", "rid dim", "d1m", "di0m"]
    texts += [" ".join("".join(r.choice("ridm1.! ") for _ in range(r.randint(3, 7))).split()) for _ in range(60)]
    for t in texts:
        if t:
            assert c.decoded(t).split() == cheapest(t, costs, WORDS)[1].split(), t
    assert {c.decoded(t).strip() for t in ("r i d", "r.i d", "rr id")} == {"rid"}


def test_the_beam_loses_no_arc_on_long_strings(costs, monkeypatch):
    c, r = toxicity.Channel(costs, WORDS), random.Random(8)
    texts = [" ".join("".join(r.choice("id1o0t! m$rn") for _ in range(40)).split()) for _ in range(12)]
    texts += [" ".join("xx" + w + "of the" + w) for w in WORDS[:2]]
    beam = [c.decoded(t) for t in texts]
    monkeypatch.setattr(toxicity, "STATES", 10**9)
    monkeypatch.setattr(toxicity, "MARGIN", 1e9)
    assert beam == [c.decoded(t) for t in texts]


def test_scores_read_the_decoded_stretches(spark, costs):
    weights = {"moron$": 0.95, "ridiot$": 0.95, "idiots$": 0.95, "bigot$": 0.7}
    model = toxicity.Model(costs, weights, 0.1)
    texts = ["of the elk", "of b i g o t the", "of the m o\nr o n elk", "elkmoron", "r i d i o t s"]
    docs = table(spark, list(enumerate(texts))).select("doc_id", "text")
    got = {r.doc.doc_id: r.score for r in toxicity.scored(docs, model).collect()}
    assert "bigot" not in model.strong()  # no arc of its own: the run of single characters is decoded
    assert got[0] < 0.1 and got[1] > 0.7 and got[2] > 0.9 and got[3] > 0.9
    # a letter belongs to one word of the path: of two words that overlap, one is read
    assert got[4] == pytest.approx(1 - (1 - 0.05) * (1 - 0.95))
