"""Toxicity of texts, obfuscated ones included: a noisy channel, then scores of the restored words."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.text import id_bucket, whole_row
from flowloom.plans.lineage import scratch, written

#: What a written character may stand for besides itself.
STANDS_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "(": "c", "<": "c", "+": "t", "#": "h", "€": "e", "£": "l", "¡": "i",
}
#: Costs, in nats, of reading a character as one that it stands for, of dropping a sign or a repeated letter, and of a sign that stays.
SUBSTITUTED, DROPPED, REPEATED, KEPT = 1.0, 2.0, 0.5, 6.0
#: Of dropping a sign that stands for a letter, of dropping the white space between two pieces, and of a word border where none is written.
LOST, GAP, SPLIT = 3.5, 1.0, 9.0
LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïñòóôõöøùúûüýÿœ"
EDGE, OTHER = 0, len(LETTERS) + 1
CLASSES = len(LETTERS) + 2
#: Labelled rows that the word model is fitted on at most, about, chosen by a hash of their ids.
FITTED = 20_000
#: Words that a Python worker remembers before it starts afresh.
REMEMBERED = 400_000
#: Longer tokens are decoded each time, not remembered.
LONGEST = 40
#: States of the lattice that are kept after each character.
STATES = 64
#: Costs of a word of the vocabulary as a whole, and of a border beside it in a longer token.
WORD, BORDER = 8.0, 2.0
#: The least weight of such a word as a part of the strongest word's: letters of weaker ones also stand in texts by chance.
ARC = 0.8
#: States that cost so much more than the cheapest do not go on either.
MARGIN = 14.0
SIZES = (4, 5)

_TABLE = np.full(0x110000, OTHER, np.int64)
_TABLE[[ord(c) for c in LETTERS]] = np.arange(1, len(LETTERS) + 1)
_TABLE[[ord(c) for c in LETTERS[:26].upper()]] = np.arange(1, 27)
_TABLE[[ord(c) for c in " \t\n\x0b\x0c\r"]] = EDGE
_CODE = {c: i + 1 for i, c in enumerate(LETTERS)}
#: What needs reading: a character twice in a row, one that may stand for another, or letters with a digit or sign among them.
_ALIKE = re.compile(r"(.)\1|[" + re.escape("".join(STANDS_FOR)) + r"]|[^\W\d_].*[\W\d_]|[\W\d_].*[^\W\d_]", re.S)
#: Signs around a word that stand for no letter: those that never do, and three or more of one that may.
_FRAME = "\"'.,;:?)[]{}>*%&-_=/\\~`^…«»“”„"
_RUNS = re.compile(r"^([@$!(<+#|])\1\1+|([@$!(<+#|])\2\2+$|!$")
#: Runs of single characters.
_SINGLE = re.compile(r"(?<!\S)\S(?:\s+\S){2,}(?!\S)")


def _folds() -> np.ndarray:
    """For each character the letter it is, or stands for, i and l being one; 0 for white space and what stands for none."""
    out = np.zeros(0x110000, np.uint32)
    for i in range(0x110000):
        if chr(i).isalpha():
            out[i] = i
    for c, letters in STANDS_FOR.items():
        out[ord(c)] = ord(letters[0])
    out[ord("l")] = ord("i")
    return out


class Vocabulary:
    """Finds the stretches of a text that a word may stand in, in any disguise, and reads them by the channel's lattice."""

    def __init__(self, words: list[str], costs: np.ndarray):
        import ahocorasick

        self.channel, self.words, self.folds, self.automaton = Channel(costs, words), set(words), _folds(), ahocorasick.Automaton()
        for fold in {self.folded(w)[0] for w in words}:
            if len(fold) > 2:
                self.automaton.add_word(fold, len(fold))
        if len(self.automaton):
            self.automaton.make_automaton()

    def folded(self, text: str) -> tuple[str, np.ndarray, np.ndarray]:
        """The letters of ``text`` without gaps and repeats, where each stands first, and where its last repeat."""
        codes = self.folds[np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")]
        at = np.flatnonzero(codes)
        letters = codes[at]
        new = np.concatenate(([True], letters[1:] != letters[:-1])) if len(at) else np.zeros(0, bool)
        return letters[new].astype("<u4").tobytes().decode("utf-32-le"), at[new], at[np.append(new[1:], True)] if len(at) else at

    def stretches(self, text: str) -> list[tuple[int, int]]:
        """Where whole pieces of ``text`` (lower case) have to be read together, in order and apart.

        These are runs of single characters, and all pieces that the letters of one word
        lie in, whatever gaps, repeats and signs that stand for none are between them or letters
        around them. Elsewhere no word arc goes over a gap, so a gap there is a border and pieces are read one by one.
        """
        found = [m.span() for m in _SINGLE.finditer(text)]
        if len(self.automaton):
            letters, at, again = self.folded(text)
            for last, size in self.automaton.iter(letters):
                begin, stop = int(again[last - size + 1]), int(at[last]) + 1
                while begin and not text[begin - 1].isspace():
                    begin -= 1
                end = _GAP.search(text, stop)
                found.append((begin, end.start() if end else len(text)))
        out: list[tuple[int, int]] = []
        for begin, stop in sorted(found):
            if out and begin < out[-1][1]:
                out[-1] = out[-1][0], max(stop, out[-1][1])
            else:
                out.append((begin, stop))
        return out

    def pieces(self, text: str) -> tuple[set[str], set[str]]:
        """The distinct stretches of ``text`` (lower case), and the distinct tokens outside of them."""
        found, rest, at = set(), [], 0
        for begin, stop in self.stretches(text):
            found.add(text[begin:stop])
            rest.append(text[at:begin])
            at = stop
        rest.append(text[at:])
        return found, {t for r in rest for t in r.split()}

    def hidden(self, text: str) -> set[str]:
        """The words of the vocabulary that are read in the stretches of ``text`` (lower case)."""
        return {w for run in self.pieces(text)[0] for w in self.channel.rejoined(run).split()} & self.words


_GAP = re.compile(r"\s")


def language_model(docs: DataFrame) -> np.ndarray:
    """-log p(c | a, b) over the letters of all texts, as counts of character triples from every row."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(CLASSES**3, np.int64)

        def add(part: list[str]) -> None:
            nonlocal total
            c = _TABLE[np.frombuffer(("  " + "  ".join(part) + " ").encode("utf-32-le"), "<u4")]
            total += np.bincount((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:], minlength=len(total))

        for batch in batches:
            part, n = [], 0
            for text in batch["text"]:
                part.append(text or "")
                n += len(part[-1])
                if n > 1_000_000:
                    add(part)
                    part, n = [], 0
            add(part)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"triple": at, "n": total[at]})

    rows = docs.select(F.col("text").cast("string")).mapInPandas(counted, "triple long, n long").groupBy("triple").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(CLASSES**3)
    n[[r["triple"] for r in rows]] = [r["n"] for r in rows]
    n = n.reshape(CLASSES, CLASSES, CLASSES)
    one = (n.sum(axis=(0, 1)) + 1) / (n.sum() + CLASSES)
    two = (n.sum(axis=0) + 5 * one) / (n.sum(axis=(0, 2))[:, None] + 5)
    return -np.log((n + 5 * two) / (n.sum(axis=2)[:, :, None] + 5))


class Channel:
    """Restores the words of a text; ``words`` are arcs of its lattice, besides the single characters."""

    def __init__(self, costs: np.ndarray, words: Iterable[str] = ()):
        self.costs = costs.tolist()
        self.known: dict[str, str] = {}
        self.letters = [frozenset(w) for w in words]
        #: The trie: for each node the nodes that follow by a letter, and the word that ends there.
        self.trie: list[tuple[dict[str, int], str]] = [({}, "")]
        for w in words:
            node = 0
            for c in w:
                if c not in (after := self.trie[node][0]):
                    after[c] = len(self.trie)
                    self.trie.append(({}, ""))
                node = after[c]
            self.trie[node] = self.trie[node][0], w

    def decoded(self, text: str) -> str:
        """The likeliest words behind ``text``: a Viterbi path through its readings under the language model.

        A character is read as itself or a letter that it stands for; a sign, or a letter
        that repeats the one before, may be dropped; so may white space, which else is a
        border; and a border may stand where none is written. Only the ``STATES`` cheapest
        states within ``MARGIN`` go on from a character, so that time follows the text's length.

        A known word is a path of its own through the same characters, at one cost for all
        its letters. It may begin and end inside a token, at the cost of a border, but then
        holds no white space. Its states are few and none is dropped.
        """
        costs = self.costs
        states: dict[tuple[int, int, str], tuple[float, tuple | None]] = {(EDGE, EDGE, ""): (0.0, None)}
        words = self._can_hold(text)
        inside: dict[tuple[int, str, bool, bool], tuple[float, tuple | None]] = {}
        for ch in text:
            after: dict[tuple[int, int, str], tuple[float, tuple | None]] = {}
            if words:
                self._ended(inside, states, ch.isspace())
                inside = self._inside(inside, states, ch)
            limit = min(cost for cost, _ in states.values()) + MARGIN if len(states) > 1 else 1e300
            if ch in _CODE:  # a letter: it is read as itself, dropped as a repeat, or begins a word
                code = _CODE[ch]
                for (a, b, last), (cost, path) in states.items():
                    row = costs[a][b]
                    new = cost + row[code]
                    if (old := after.get((b, code, ch))) is None or old[0] > new:
                        after[(b, code, ch)] = new, (path, ch)
                    if ch == last and ((old := after.get((a, b, ch))) is None or old[0] > cost + REPEATED):
                        after[(a, b, ch)] = cost + REPEATED, path
                    if b != EDGE and (split := cost + SPLIT + row[EDGE]) < limit:
                        new = split + costs[b][EDGE][code]
                        if (old := after.get((EDGE, code, ch))) is None or old[0] > new:
                            after[(EDGE, code, ch)] = new, ((path, " "), ch)
                states = after if len(after) <= STATES else dict(sorted(after.items(), key=lambda s: s[1][0])[:STATES])
                continue
            gap = ch.isspace()
            readings = [] if gap else [(c, _CODE.get(c, OTHER), SUBSTITUTED) for c in STANDS_FOR.get(ch, "")]
            sign, dropped = not ch.isalpha(), LOST if readings else DROPPED
            if not gap:
                readings.append((ch, _CODE.get(ch, OTHER), KEPT if sign else 0.0))
            for (a, b, last), (cost, path) in states.items():
                if cost > limit:
                    continue
                row, found = costs[a][b], []
                if gap:
                    if b == EDGE:
                        found.append(((a, b, last), cost, path))
                    else:
                        found.append(((a, b, last), cost + GAP, path))
                        found.append(((b, EDGE, ""), cost + row[EDGE], (path, " ")))
                else:
                    for c, code, extra in readings:
                        found.append(((b, code, ch), cost + extra + row[code], (path, c)))
                    split = cost + SPLIT + row[EDGE]
                    if b != EDGE and split < limit:
                        for c, code, extra in readings:
                            found.append(((EDGE, code, ch), split + extra + costs[b][EDGE][code], ((path, " "), c)))
                    if ch == last:
                        found.append(((a, b, ch), cost + REPEATED, path))
                    elif sign:
                        found.append(((a, b, last), cost + dropped, path))
                for key, new, way in found:
                    old = after.get(key)
                    if old is None or old[0] > new:
                        after[key] = new, way
            states = after if len(after) <= STATES else dict(sorted(after.items(), key=lambda s: s[1][0])[:STATES])
        if words:
            self._ended(inside, states, True)
        path = min(((cost + (costs[a][b][EDGE] if b != EDGE or path is None else 0.0), path) for (a, b, _), (cost, path) in states.items()), key=lambda s: s[0])[1]
        letters = []
        while path:
            path, c = path
            letters.append(c)
        return "".join(reversed(letters))

    def _can_hold(self, text: str) -> bool:
        """Whether all letters of some known word stand, or are stood for, in ``text``."""
        have = set(text).union(*(STANDS_FOR[c] for c in set(text) if c in STANDS_FOR)) if self.letters else ()
        return any(word <= have for word in self.letters)

    def _ended(self, inside: dict, states: dict, border: bool) -> None:
        """Adds to ``states`` the known words that end here, at a written border or inside a token."""
        for (node, _, _, gaps), (cost, path) in inside.items():
            word = self.trie[node][1]
            if word and (border or not gaps):
                new = cost + (0.0 if border else BORDER)
                if (old := states.get((EDGE, EDGE, ""))) is None or old[0] > new:
                    states[(EDGE, EDGE, "")] = new, ((path, word), " ")

    def _inside(self, inside: dict, states: dict, ch: str) -> dict:
        """States (node, last character, begun inside a token, holds gaps) in known words after ``ch``, from those before it and from those outside."""
        after: dict[tuple[int, str, bool, bool], tuple[float, tuple | None]] = {}

        def put(key: tuple[int, str, bool, bool], cost: float, path: tuple | None) -> None:
            if (old := after.get(key)) is None or old[0] > cost:
                after[key] = cost, path

        if ch.isspace():
            for (node, last, begun, _), (cost, path) in inside.items():
                if not begun:
                    put((node, last, begun, True), cost + GAP, path)
            return after
        sign, readings = not ch.isalpha(), [(c, SUBSTITUTED) for c in STANDS_FOR.get(ch, "")]
        readings.append((ch, KEPT if sign else 0.0))
        for (node, last, begun, gaps), (cost, path) in inside.items():
            for c, extra in readings:
                if (child := self.trie[node][0].get(c)) is not None:
                    put((child, ch, begun, gaps), cost + extra, path)
            if ch == last:
                put((node, ch, begun, gaps), cost + REPEATED, path)
            elif sign:
                put((node, last, begun, gaps), cost + (LOST if len(readings) > 1 else DROPPED), path)
        first = [(child, extra) for c, extra in readings if (child := self.trie[0][0].get(c)) is not None]
        if first:
            for (a, b, _), (cost, path) in states.items():
                begun = b != EDGE
                start = cost + WORD + (BORDER + self.costs[a][b][EDGE] if begun else 0.0)
                for child, extra in first:
                    put((child, ch, begun, False), start + extra, (path, " ") if begun else path)
        return after

    def restored(self, token: str) -> str:
        """The word, or words, behind a token. A token of different letters alone has one reading and needs no search."""
        token = _RUNS.sub("", token.strip(_FRAME)).strip(_FRAME)
        return self._known(token) if _ALIKE.search(token) else token

    def rejoined(self, run: str) -> str:
        """The words behind a run of short pieces."""
        return self._known(" ".join(run.split()))

    def _known(self, text: str) -> str:
        if len(text) > LONGEST:
            return self.decoded(text)
        if text not in self.known:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            self.known[text] = self.decoded(text)
        return self.known[text]

    def words(self, text: str | None) -> set[str]:
        """The distinct restored words of a whole text; of runs of short pieces those of single characters."""
        text = (text or "").lower()
        out = {w for t in set(text.split()) for w in self.restored(t).split()}
        out.update(w for run in set(_SINGLE.findall(text)) for w in self.rejoined(run).split())
        return out


def features(word: str) -> list[str]:
    """The word, whole and by its first letters."""
    return [word + "$", *(word[:n] for n in SIZES if len(word) >= n)] if word else []


@dataclass
class Model:
    costs: np.ndarray
    weights: dict[str, float]
    prior: float

    def strong(self) -> list[str]:
        """Words whose weight is at least ``ARC`` of the strongest word's."""
        words = {f[:-1]: w for f, w in self.weights.items() if f.endswith("$")}
        return sorted(w for w, x in words.items() if x >= ARC * max(words.values()))


def fitted(docs: DataFrame, labels: DataFrame, most: int = FITTED, least: int = 3) -> Model:
    """The language model from all texts, and word weights from labelled rows that aren't held out.

    Rows with the same label and the same least hashed five-word shingle count as one, so
    that copies, near ones included, are no evidence of their own. A feature weighs the
    smoothed part of toxic rows among those that have it, and in a second pass toxic rows
    count only for the features about as strong as their strongest.
    """
    toxic = labels.filter("toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")).filter(id_bucket(F.col("doc_id"), 5) != 0)
    size = toxic.count()
    chosen = toxic.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < min(1.0, most / max(size, 1)) * 1_000_003).orderBy(F.xxhash64("doc_id")).limit(2 * most)
    costs = language_model(docs)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        channel = Channel(costs)
        for batch in batches:
            out = []
            for text, label in zip(batch["text"], batch["toxic"], strict=True):
                t = (text or "").lower().split()
                sketch = min((xxhash.xxh64_intdigest(" ".join(t[i : i + 5])) for i in range(max(1, len(t) - 4))))
                out.append((sketch >> 1, int(label), sorted({f for w in channel.words(text) for f in features(w)})))
            yield pd.DataFrame(out, columns=["sketch", "toxic", "found"])

    # at most 2 * FITTED ids
    sample = docs.select("doc_id", F.col("text").cast("string")).join(F.broadcast(chosen), "doc_id").select("text", "toxic")
    read = written(sample.mapInPandas(rows, "sketch long, toxic int, found array<string>"))
    totals = read.select("sketch", "toxic").distinct().agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first()
    bad, good = (totals[0] or 0), (totals[1] or 0)
    prior = (bad + 1) / (bad + good + 2)
    has = written(read.select("sketch", "toxic", F.explode("found").alias("f")).distinct())

    def weighed(pairs: DataFrame, smooth: float) -> DataFrame:
        counts = pairs.groupBy("f").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
        w = (F.col("bad") + smooth * prior) / (F.col("bad") + F.col("good") + smooth)
        return counts.filter(F.col("bad") >= least).select("f", w.alias("w")).filter("w > 0.3")

    smooth = float(1.25 * np.log(max(has.select("f").distinct().count(), 2)) / -np.log(prior))
    strong = written(has.join(weighed(has, smooth), "f"))
    bar = strong.groupBy("sketch", "toxic").agg(F.max("w").alias("most"))
    again = strong.join(bar, ["sketch", "toxic"]).filter("toxic = 0 or w >= most - 0.02")
    # no more features than 2 * FITTED rows have at least ``least`` times
    return Model(costs, {r["f"]: r["w"] for r in weighed(again, smooth).collect()}, prior)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc, score): each row of ``docs`` as a struct, and the evidence of all its restored words: one less the chance that none is toxic.

    The strongest words are arcs of the lattice. Pieces that such a word, or a run of single
    characters, may lie in are decoded together, with the gaps between them as edges that
    are dropped or are borders; other tokens are decoded each by itself.
    """

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights, vocabulary = model.weights, Vocabulary(model.strong(), model.costs)
        channel = vocabulary.channel
        lowest = min(0.25, model.prior / 2)
        known: dict[str, tuple[tuple[str, float], ...]] = {}

        def weighed(words: str) -> tuple[tuple[str, float], ...]:
            best = ((w, max(weights.get(f, 0.0) for f in features(w))) for w in words.split())
            return tuple((w, x) for w, x in best if x)

        for texts in batches:
            out = []
            for text in texts:
                found: dict[str, float] = {}
                runs, tokens = vocabulary.pieces((text or "").lower())
                for token in tokens:
                    ws = known.get(token)
                    if ws is None:
                        if len(known) > REMEMBERED:
                            known.clear()
                        ws = known[token] = weighed(channel.restored(token))
                    if ws:
                        found.update(ws)
                for run in runs:
                    found.update(weighed(channel.rejoined(run)))
                none = 1.0 - lowest
                for x in found.values():
                    none *= 1.0 - x
                out.append(1.0 - none)
            yield pd.Series(out, dtype=float)

    return docs.select(whole_row(docs).alias("doc"), of(F.col("text").cast("string")).alias("score"))


def toxicity(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, score, predicted.

    Labels are learned only from rows whose crc32 of the id modulo 5 is not 0; a score
    depends on the whole text alone. Null and blank texts score the prior's half.
    Labels that are null are left out, contradicting ones count as toxic. Repeated rows
    repeat; null ids are never labelled; extra columns are ignored; empty tables give an
    empty result or, without labels, the same low score for all.
    """
    with scratch(docs.sparkSession):
        model = fitted(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"), **how)
    found = scored(docs.select("doc_id", "text"), model)
    return found.select("doc.doc_id", (id_bucket(F.col("doc.doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
