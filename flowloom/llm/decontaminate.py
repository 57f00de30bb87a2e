"""Benchmark passages in documents: SimHash windows, Hamming blocks, exact similarity."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.text import words
from flowloom.plans.lineage import written
from flowloom.plans.ranking import numbered

SIZE, SIMILAR = 5, 0.8
#: Fingerprints of 64 bits within RADIUS bits agree in one of 8 blocks of 8 bits but for two bits: 8 * 3 > 23.
RADIUS, BLOCKS, SLACK = 23, 8, 2
#: Bytes of distinct items, about, that the driver and a task hold at once; a larger benchmark is gone through in parts.
PART = 16_000_000
FOUND = "array<struct<k:long,similarity:double,first_word:long,n_words:long>>"


def shingles(tokens: list[bytes], size: int) -> list[int]:
    n = min(size, len(tokens))
    return [xxhash.xxh64_intdigest(b" ".join(tokens[i : i + n])) for i in range(len(tokens) - n + 1)] if n else []


def bits(hashes: np.ndarray) -> np.ndarray:
    """Rows of +1 and -1 for the bits of each hash."""
    return np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32) * 2 - 1


def packed(signs: np.ndarray) -> np.ndarray:
    return np.packbits(signs > 0, axis=1, bitorder="little").view("<u8").ravel()


#: By byte, the bytes that differ from it in at most SLACK bits.
NEAR = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)[None, :]) <= SLACK


class Items:
    """An index of benchmark items: by shingle, by number of words and fingerprint block, and their shingle counts."""

    def __init__(self, items: list[tuple[int, str | None]], size: int, similar: float):
        self.size, self.similar = size, similar
        self.ids, self.counts = [], []
        prints: dict[int, list[np.uint64]] = defaultdict(list)
        self.of: dict[int, list[int]] = defaultdict(list)
        self.vocabulary: dict[bytes, int] = {}
        self.by_shingle: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for item_id, text in items:
            tokens = words(text)
            if not tokens:
                continue
            n, hashes = len(tokens), shingles(tokens, size)
            place = len(self.of[n])
            self.of[n].append(len(self.ids))
            self.ids.append(item_id)
            self.counts.append(Counter(hashes))
            prints[n].append(packed(bits(np.array(hashes, np.uint64)).sum(axis=0)[None, :])[0])
            for w in tokens:
                self.vocabulary.setdefault(w, len(self.vocabulary) + 1)
            for h in set(hashes):
                self.by_shingle[h].append((n, place))
        self.prints = {n: np.array(p, np.uint64) for n, p in prints.items()}
        self.sizes = sorted({min(size, n) for n in self.of})

    def anchored(self, tokens: list[bytes], size: int) -> dict[int, list[int]]:
        """Positions of the text's shingles of ``size`` words that some item has, by shingle hash."""
        codes = np.fromiter(map(self.vocabulary.get, tokens, [0] * len(tokens)), np.int64, len(tokens)) if tokens else np.empty(0, np.int64)
        run = np.concatenate(([0], np.cumsum(codes > 0)))
        out: dict[int, list[int]] = defaultdict(list)
        for i in np.flatnonzero(run[size:] - run[:-size] == size).tolist():
            h = xxhash.xxh64_intdigest(b" ".join(tokens[i : i + size]))
            if h in self.by_shingle:
                out[h].append(i)
        return out

    def found(self, text: str | None) -> list[dict]:
        """The best window of each item that the text has."""
        tokens = words(text)
        best: dict[int, tuple[float, int, int]] = {}
        for size in self.sizes:
            windows: dict[int, set[int]] = defaultdict(set)
            items: dict[int, set[int]] = defaultdict(set)
            for h, places in self.anchored(tokens, size).items():
                for n, place in self.by_shingle[h]:
                    if min(self.size, n) == size:
                        items[n].add(place)
                for n in {n for n, _ in self.by_shingle[h] if min(self.size, n) == size}:
                    for p in places:
                        windows[n].update(range(max(0, p + size - n), min(p, max(0, len(tokens) - n)) + 1))
            for n, starts in windows.items():
                self._windows(tokens, size, n, np.array(sorted(starts)), np.array(sorted(items[n])), best)
        return [{"k": self.ids[k], "similarity": s, "first_word": at, "n_words": n} for k, (s, at, n) in sorted(best.items())]

    def _windows(self, tokens: list[bytes], size: int, n: int, starts: np.ndarray, items: np.ndarray, best: dict[int, tuple[float, int, int]]) -> None:
        """Windows of ``n`` words, or the whole of a shorter text: fingerprints, candidates by blocks, then the exact similarity."""
        long = min(n, len(tokens))
        m, other = long - size + 1, n - size + 1
        prints = self.prints[n][items]
        blocks = prints.view(np.uint8).reshape(-1, BLOCKS)
        for stretch in np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1):
            for a in range(0, len(stretch), 4096):
                part = stretch[a : a + 4096]
                hashes = np.array(shingles(tokens[part[0] : part[-1] + long], size), np.uint64)
                sums = np.vstack((np.zeros((1, 64), np.int32), np.cumsum(bits(hashes), axis=0)))
                own = packed(sums[m:] - sums[:-m])
                own_blocks = own.view(np.uint8).reshape(-1, BLOCKS)
                near = np.zeros((len(own), len(prints)), bool)
                for b in range(BLOCKS):
                    near |= NEAR[own_blocks[:, b]][:, blocks[:, b]]
                near &= np.bitwise_count(own[:, None] ^ prints[None, :]) <= RADIUS
                counts: dict[int, Counter] = {}
                for i, j in zip(*(x.tolist() for x in np.nonzero(near)), strict=True):
                    k = self.of[n][items[j]]
                    if i not in counts:
                        counts[i] = Counter(hashes[i : i + m].tolist())
                    both = sum((counts[i] & self.counts[k]).values())
                    s = both / (m + other - both)
                    if s >= self.similar and (k not in best or best[k][0] < s):
                        best[k] = s, int(part[i]), long


def _searches(benchmark: DataFrame, size: int, similar: float, part: int):
    """(placed, searches, n): distinct item texts with a number k; for each of n parts of them a function of a text to what it holds."""
    items = benchmark.select(F.col("text").cast("string").alias("text")).filter("text is not null").distinct()
    sized = items.withColumn("bytes", F.octet_length("text").cast("long"))
    placed = written(numbered(sized, "text", name="k", before={"before": "bytes"}).select("k", "text", F.floor(F.col("before") / part).alias("part")))

    def one(at: int):
        rows = [(r["k"], r["text"]) for r in placed.filter(F.col("part") == at).collect()]

        @F.pandas_udf(FOUND)
        def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            index = Items(rows, size, similar)
            for batch in batches:
                yield batch.map(index.found)

        return of

    parts = [r["part"] for r in placed.select("part").distinct().orderBy("part").toLocalIterator()]
    return placed, (one(at) for at in parts), len(parts)


def contaminated(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, similar: float = SIMILAR, part: int = PART) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, n_words) for each document and benchmark item that it holds.

    A document holds an item if one of its windows of as many words, or the whole of a
    shorter text, has a weighted (multiset) Jaccard similarity of ``similar`` or more over
    ``size``-word shingles, words lower-cased A-Z; of an item's windows the first of the
    most similar is told. Windows are fingerprinted, and compared with items, where both
    share a shingle, since others have similarity 0; blocks guarantee every item within 23
    bits, and the exact similarity decides. Two texts at similarity 0.8 differ in about 10
    bits and in over 23 once in 100,000. Items shorter than ``size`` words count as one
    shingle; items without words are never held. Null or blank texts hold nothing;
    repeated rows tell each item again, and repeated items are told by each id; null ids
    are passed on; extra columns are ignored; empty tables give an empty result. Distinct
    items are gone through in parts of about ``part`` bytes, one after the other, so that
    neither the driver nor a task holds more of any benchmark.
    """
    placed, searches, n = _searches(benchmark, size, similar, part)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    ids = items.join(placed, "text").select("k", "item_id")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = []
    for of in searches:
        here = texts.select("doc_id", F.explode(of("text")).alias("f")).select("doc_id", "f.*")
        found.append(here if n == 1 else written(here))
    if not found:
        return texts.limit(0).selectExpr("doc_id", "0L as item_id", "0D as similarity", "0L as first_word", "0L as n_words")
    return reduce(DataFrame.union, found).join(ids, "k").select("doc_id", "item_id", "similarity", "first_word", "n_words")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, similar: float = SIMILAR, part: int = PART) -> DataFrame:
    """The rows of ``docs`` whose text holds no item, as ``contaminated`` tells; each row is judged by itself."""
    _, searches, n = _searches(benchmark, size, similar, part)
    for of in searches:
        docs = docs.filter(F.size(of(F.col("text").cast("string"))) == 0)
        if n > 1:
            docs = written(docs)
    return docs
