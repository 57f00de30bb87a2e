"""Repeated byte strings by a distributed merge sort of anchored suffixes.

Which positions need sorting: every ``length``-byte window picks the k-gram of least hash
in it as its anchor (leftmost of equals), by content alone, so equal windows pick anchors
at the same place. A window whose anchor's k-gram occurs once cannot be repeated. The
stretch of text under the consecutive windows that share an anchor is that anchor's
suffix; equal suffixes have equal windows throughout.

How they are sorted: each task sorts its suffixes into a run, keeps the earliest of equal
ones, front-codes it (length of the prefix shared with the one before, then the rest) and
cuts it by key range. Each range's runs are merged by a loser tree that starts every
comparison behind the prefix known to be shared. The prefix that neighbours of the merged
order share then tells what is repeated: the whole suffix, or else, among the different
suffixes of one k-gram, which share less, the suffixes that start at each of their windows
are sorted in turn, and a neighbour that shares ``length`` bytes is a later start.

Nothing hot meets in one task: what a batch of documents can settle itself it settles (a
k-gram that it holds twice is repeated; of equal suffixes all but the earliest go), and a
k-gram too frequent for one range is spread over all of them.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.plans.lineage import settled, written

LENGTH, GRAM = 100, 32
#: Windows of a text that are hashed at once; longer texts go piece by piece.
PIECE = 1 << 20
#: A k-gram with more occurrences is hot: its suffixes are spread over all ranges, and its windows are compared by a shuffle of their own.
HOT = 10_000
#: Hot k-grams at most, whatever the input: a larger input has a larger HOT.
MOST_HOT = 1_000_000
#: Suffixes that a range should have.
RANGE = 20_000
#: Rows of a batch whose suffixes make one run.
RUN = 3_000
#: Windows of different suffixes that are sorted at once, about.
SORTED = 100_000
NULL_ID = np.iinfo(np.int64).min

_rng = np.random.Generator(np.random.PCG64(1))
_BYTE = _rng.integers(0, 1 << 64, 256, np.uint64)
_R = np.uint64(0x9E3779B97F4A7C15)
_R_INVERSE = np.uint64(pow(int(_R), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _power(name: str, n: int) -> np.ndarray:
    if name not in _powers or len(_powers[name]) < n:
        base = np.full(max(n, 8192), _R if name == "up" else _R_INVERSE, np.uint64)
        base[0] = 1
        _powers[name] = np.cumprod(base, dtype=np.uint64)
    return _powers[name][:n]


def anchors(data: bytes, length: int = LENGTH, gram: int = GRAM, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(k-gram hash, first window, number of windows) of each anchor of ``data``; windows in no two of them."""
    out = []
    for start in range(0, len(data) - length + 1, piece):
        part = np.frombuffer(data, np.uint8)[start : start + piece + length - 1]
        n = len(part) - gram + 1
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[part] * _power("up", len(part)), out=sums[1:])
        h = (sums[gram:] - sums[:-gram]) * _power("down", n)
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        low = np.uint64((1 << 21) - 1)
        least, wide, done = (h & ~low) | np.arange(n, dtype=np.uint64), length - gram + 1, 1
        while done < wide:
            step = min(done, wide - done)
            least = np.minimum(least[:-step], least[step:])
            done += step
        at = (least & low).astype(np.int64)
        first = np.concatenate(([0], np.flatnonzero(at[1:] != at[:-1]) + 1))
        out.append((h[at[first]], first + start, np.diff(np.append(first, len(at)))))
    if not out:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


#: What ``first`` says in a row of ``_occurrences`` and ``_repeated`` if it is no position: a count of the k-gram, or SETTLED - position.
COUNT, SETTLED = -1, -2


def _occurrences(length: int, gram: int, piece: int):
    """(h, owner, first) of each k-gram that a batch has once; of others their count, and each occurrence as settled."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hs, owners, firsts = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for owner, data in zip(batch.column("owner").to_pylist(), batch.column("data"), strict=True):
                h, first, _ = anchors(data.as_py(), length, gram, piece)
                hs.append(h)
                owners.append(np.full(len(h), owner, np.int64))
                firsts.append(first)
            h, owner, first = np.concatenate(hs).view(np.int64), np.concatenate(owners), np.concatenate(firsts)
            kinds, of, n = np.unique(h, return_inverse=True, return_counts=True)
            several = n[of] > 1
            # settled rows are dealt by owner, so that a hot k-gram sends its count alone to the others
            out = (
                np.concatenate((h[~several], kinds[n > 1], owner[several] + first[several])),
                np.concatenate((owner[~several], n[n > 1], owner[several])),
                np.concatenate((first[~several], np.full((n > 1).sum(), COUNT), SETTLED - first[several])),
            )
            for a in range(0, len(out[0]), 500_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[a : a + 500_000]) for x in out], ["h", "owner", "first"])

    return rows


def _repeated(hot: int):
    """Rows sorted by h to (owner, first) of the k-grams that occur again; of hot ones also (h, -1 - how often)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n, held = None, 0, []  # of the k-gram that may go on in the next batch: one row for each batch of documents at most
        for batch in batches:
            h, owner, first = (batch.column(c).to_numpy() for c in ("h", "owner", "first"))
            out = [(owner[first <= SETTLED], SETTLED - first[first <= SETTLED])]
            at = first > SETTLED
            h, owner, first = h[at], owner[at], first[at]
            starts = np.flatnonzero(np.concatenate((np.ones(min(1, len(h)), bool), h[1:] != h[:-1])))
            if len(starts):
                size = np.add.reduceat(np.where(first == COUNT, owner, 1), starts)
                if h[0] == last:
                    size[0] += n
                    n = int(size[0])
                if h[0] != last or len(starts) > 1:
                    if n > 1:
                        out.extend(held)
                    if n > hot:
                        out.append((np.array([last]), np.array([-1 - n])))
                    held = []
                of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(h))))
                goes_on = of == len(starts) - 1
                chosen = ~goes_on & (size[of] > 1) & (first >= 0)
                out.append((owner[chosen], first[chosen]))
                full = np.flatnonzero(size[:-1] > hot)
                out.append((h[starts[full]], -1 - size[full]))
                last, n = int(h[-1]), int(size[-1])
                held.append((owner[goes_on & (first >= 0)], first[goes_on & (first >= 0)]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[k] for o in out])) for k in (0, 1)], ["owner", "first"])
        if n > 1:
            out = [*held, *([(np.array([last]), np.array([-1 - n]))] if n > hot else [])]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[k] for o in out]).astype(np.int64)) for k in (0, 1)], ["owner", "first"])

    return rows


def shared(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of ``a`` and ``b``, of which ``known`` bytes are known to agree."""
    n = min(len(a), len(b)) - known
    x = int.from_bytes(a[known : known + n], "big") ^ int.from_bytes(b[known : known + n], "big")
    return known + n - (x.bit_length() + 7) // 8


#: An entry of a run: key, then doc, mark, first, number of windows, hot.
Entry = tuple[bytes, int, int, int, int, bool]


def coded(entries: list[Entry], repeats: list[Entry]) -> bytes:
    """A front-coded run of sorted entries with distinct keys, with the later occurrences that it left out."""
    common, rests, before = [], [], b""
    for e in entries:
        n = shared(before, e[0], 0)
        common.append(n)
        rests.append(e[0][n:])
        before = e[0]
    both = [*entries, *repeats]
    numbers = np.array([e[1:4] for e in both], np.int64).reshape(-1, 3).tobytes()
    small = np.array([(e[4], e[5]) for e in both], np.uint16).reshape(-1, 2).tobytes()
    lengths = np.array([common, list(map(len, rests))], np.uint16).tobytes()
    return zstandard.ZstdCompressor(3).compress(struct.pack("<II", len(entries), len(repeats)) + numbers + small + lengths + b"".join(rests))


def decoded(run: bytes) -> tuple[Iterator[tuple[int, Entry]], list[tuple[int, int, int, int]]]:
    """(prefix shared with the entry before, entry) in order; the occurrences left out."""
    raw = zstandard.ZstdDecompressor().decompress(run)
    n, m = struct.unpack_from("<II", raw)
    numbers = np.frombuffer(raw, np.int64, 3 * (n + m), 8).reshape(-1, 3)
    small = np.frombuffer(raw, np.uint16, 2 * (n + m), 8 + 24 * (n + m)).reshape(-1, 2)
    lengths = np.frombuffer(raw, np.uint16, 2 * n, 8 + 28 * (n + m)).reshape(2, n)

    def entries() -> Iterator[tuple[int, Entry]]:
        at, key = 8 + 28 * (n + m) + 4 * n, b""
        for (doc, mark, first), (windows, hot), common, rest in zip(numbers[:n].tolist(), small[:n].tolist(), *lengths.tolist(), strict=True):
            key = key[:common] + raw[at : at + rest]
            at += rest
            yield common, (key, doc, mark, first, windows, bool(hot))

    return entries(), [(*x, w[0]) for x, w in zip(numbers[n:].tolist(), small[n:].tolist(), strict=True)]


def merged(runs: list[Iterator[tuple[int, Entry]]]) -> Iterator[tuple[int, Entry]]:
    """All entries in the order of their keys, each with the prefix that it shares with the one before.

    A loser tree: every inner node holds the run that lost there, whose head's common
    prefix with the winner is known. Of two heads the one that shares more with the last
    output is the smaller; only if they share as much are they compared, from there on.
    """
    k = len(runs)
    heads: list[Entry | None] = []
    common = [0] * k
    for run in runs:
        _, e = next(run, (0, None))
        heads.append(e)

    def beats(i: int, j: int) -> bool:
        a, b = heads[i], heads[j]
        if a is None or b is None:
            return b is None
        if common[i] != common[j]:
            return common[i] > common[j]
        x, y = a[0], b[0]
        n = shared(x, y, common[i])
        wins = x[n:] < y[n:] if n < min(len(x), len(y)) else len(x) <= len(y)
        common[j if wins else i] = n
        return wins

    losers = [-1] * max(1, k)

    def build(node: int) -> int:
        if node >= k:
            return node - k
        a, b = build(2 * node), build(2 * node + 1)
        won, lost = (a, b) if beats(a, b) else (b, a)
        losers[node] = lost
        return won

    top = build(1) if k > 1 else 0
    while k and (e := heads[top]) is not None:
        yield common[top], e
        common[top], heads[top] = next(runs[top], (0, None))
        node = (top + k) // 2
        while node:
            if beats(losers[node], top):
                losers[node], top = top, losers[node]
            node //= 2


def _runs(ranges: int, hot: np.ndarray, length: int, gram: int, piece: int):
    """Documents with the firsts of their repeated anchors to (range, run)."""
    hot_kinds = frozenset(hot.view(np.uint64).tolist())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, RUN) for whole in batches for at in range(0, whole.num_rows, RUN)):
            found: dict[int, list[Entry]] = {}
            for doc, mark, data, firsts in zip(*(batch.column(c) for c in ("doc", "mark", "data", "firsts")), strict=True):
                doc, mark, data, wanted = doc.as_py(), mark.as_py(), data.as_py(), set(firsts.as_py())
                for h, first, n in zip(*(x.tolist() for x in anchors(data, length, gram, piece)), strict=True):
                    if first in wanted:
                        key = h.to_bytes(8, "big") + data[first : first + n + length - 1]
                        part = (xxhash.xxh64_intdigest(key) if h in hot_kinds else h) * ranges >> 64
                        found.setdefault(part, []).append((key, doc, mark, first, n, h in hot_kinds))
            runs: dict[int, tuple[list[Entry], list[Entry]]] = {}
            for part, entries in found.items():
                entries.sort()
                kept: list[Entry] = []
                for e in entries:
                    if not kept or kept[-1][0] != e[0]:
                        kept.append(e)
                    elif kept[-1] != e:  # a later start, whatever other runs hold: to any range, so that a hot suffix does not fill one
                        runs.setdefault((e[2] + e[3]) % ranges, ([], []))[1].append(e)
                runs.setdefault(part, ([], []))[0].extend(kept)
            if runs:
                yield pa.RecordBatch.from_arrays([pa.array(list(runs), pa.int32()), pa.array([coded(*r) for r in runs.values()], pa.binary())], ["part", "run"])

    return rows


SPANS = "doc long, mark long, first long, n long, window binary"


def later_starts(entries: list[Entry], length: int) -> tuple[list[tuple], list[tuple]]:
    """(spans, firsts): spans of the windows of ``entries`` that also start earlier in one of the same k-gram; of hot k-grams the other windows.

    The suffixes at all windows are sorted, by k-gram, then bytes, then place; a suffix
    that shares ``length`` bytes with its neighbour is a later start.
    """
    n = np.array([e[4] for e in entries])
    data = np.frombuffer(b"".join(e[0][8:] for e in entries), np.uint8)
    ends = np.cumsum(n + length - 1)
    owner = np.repeat(np.arange(len(entries)), n)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    starts = (ends - n - length + 1)[owner] + offset
    suffixes = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, length)[starts]).view(f"S{length}").ravel()
    kinds = np.frombuffer(b"".join(e[0][:8] for e in entries), ">u8")[owner]
    doc, mark, first = (np.array([e[k] for e in entries], np.int64) for k in (1, 2, 3))
    at = first[owner] + offset
    order = np.lexsort((at, mark[owner], doc[owner], suffixes, kinds))
    # all are as long, so what numpy leaves out of a comparison, zero bytes at the end, is left out of both
    again = (suffixes[order[1:]] == suffixes[order[:-1]]) & (kinds[order[1:]] == kinds[order[:-1]])
    gone = np.sort(order[1:][again])
    breaks = np.flatnonzero((np.diff(gone) > 1) | (np.diff(owner[gone]) > 0)) + 1
    spans = [(int(doc[owner[g[0]]]), int(mark[owner[g[0]]]), int(at[g[0]]), len(g), None) for g in np.split(gone, breaks) if len(g)]
    hot = np.array([e[5] for e in entries])[owner]
    hot[gone] = False
    place = lambda i, e: (e[1], e[2], int(at[i]), 1, xxhash.xxh3_128_digest(e[0][:8] + e[0][8 + offset[i] : 8 + offset[i] + length]))
    return spans, [place(i, entries[owner[i]]) for i in np.flatnonzero(hot).tolist()]


def _merge(length: int, together: int):
    """The runs of a range to its later occurrences: n windows from ``first`` on; windows of hot k-grams to be compared elsewhere."""

    def rows(runs: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        trees = []
        for run in runs["run"]:
            entries, repeats = decoded(run)
            trees.append(entries)
            out.extend((*r, None) for r in repeats)
        waiting: list[list] = []  # different suffixes of k-grams with more than one
        n_windows = 0

        def ended(group: list[list]) -> None:
            """All different suffixes of one k-gram."""
            nonlocal n_windows
            if group and (len(group) > 1 or group[0][5]):
                waiting.extend(group)
                n_windows += sum(e[4] for e in group)
                if n_windows >= together:
                    settle()

        def settle() -> None:
            nonlocal n_windows
            if waiting:
                for found in later_starts(waiting, length):
                    out.extend(found)
            waiting.clear()
            n_windows = 0

        group: list[list] = []
        for common, e in merged(trees):
            if group and common >= 8 and common == len(e[0]) == len(group[-1][0]):
                here, seen = e[1:4], tuple(group[-1][1:4])
                if here != seen:
                    out.append((*max(here, seen), e[4], None))
                    group[-1][1:4] = min(here, seen)
                continue
            # a hot k-gram may be more than fits: its windows meet again below, so parts of it will do
            if group and (common < 8 or group[0][5] and len(group) >= 1000):
                ended(group)
                group = []
            group.append(list(e))
        ended(group)
        settle()
        return pd.DataFrame(out, columns=["doc", "mark", "first", "n", "window"])

    return rows


def repeated_windows(source: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, ranged: int = RANGE, piece: int = PIECE, together: int = SORTED) -> DataFrame:
    """(doc, mark, data) to (doc, mark, first, n): from byte ``first`` on, n windows that also start earlier.

    Earlier is the order of doc, mark and position; ``mark`` is a hash of the row's bytes,
    so rows that repeat id and bytes are one document.
    """
    source = source.withColumn("owner", F.xxhash64("doc", "mark"))
    found = source.select("owner", "data").mapInArrow(_occurrences(length, gram, piece), "h long, owner long, first long")
    again = written(found.repartition("h").sortWithinPartitions("h").mapInArrow(_repeated(hot), "owner long, first long"))
    total = again.filter("first >= 0").count()
    # one row for each hot k-gram, MOST_HOT at most
    often = again.filter(F.col("first") < -max(hot, total // MOST_HOT)).select("owner").collect()
    ranges = 1 + total // ranged
    wanted = again.filter("first >= 0").groupBy("owner").agg(F.collect_list("first").alias("firsts"))
    runs = source.join(wanted, "owner").select("doc", "mark", "data", "firsts").mapInArrow(_runs(ranges, np.array([r["owner"] for r in often], np.int64), length, gram, piece), "part int, run binary")
    spans = written(runs.groupBy("part").applyInPandas(_merge(length, together), SPANS))
    place = F.struct("doc", "mark", "first")
    windows = spans.filter("window is not null")
    earliest = windows.groupBy("window").agg(F.min(place).alias("e"))
    later = windows.join(earliest, "window").filter(place != F.col("e"))
    return spans.filter("window is null").union(later.select(spans.columns)).select("doc", "mark", "first", "n")


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, ranged: int = RANGE, piece: int = PIECE, together: int = SORTED) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept (the bytes that remain).

    A byte goes if a ``length``-byte string over it also starts earlier, in a smaller
    doc_id or earlier in the same document; strings are taken from the input, may
    overlap, and never cross documents. Texts are UTF-8 bytes; null is empty. A null
    doc_id comes before all others. Rows with the same id and text are one document (each
    keeps what it keeps); rows with one id and different texts are ordered by a hash of
    the text. Other columns are ignored; an empty table gives an empty result.
    """
    data = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), data.alias("data"), F.xxhash64(data).alias("mark"))
    source = source.withColumn("doc", F.coalesce("doc_id", F.lit(NULL_ID)))
    windows = settled(docs.sparkSession, lambda: repeated_windows(source.select("doc", "mark", "data"), length, gram, hot, ranged, piece, together))
    marked = windows.groupBy("doc", "mark").agg(F.collect_list(F.struct("first", "n")).alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data, spans in zip(batch.column("data"), batch.column("spans"), strict=True):
                data = data.as_py()
                if not spans.is_valid or not len(spans):
                    out.append((len(data), 0, 0, data))
                    continue
                first, n = (spans.values.field(c).to_numpy() for c in ("first", "n"))
                edges = np.zeros(len(data) + 1, np.int64)
                np.add.at(edges, first, 1)
                np.add.at(edges, first + n - 1 + length, -1)
                gone = np.cumsum(edges[:-1]) > 0
                spans_n = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1])) if len(data) else 0
                out.append((len(data), int(gone.sum()), spans_n, np.frombuffer(data, np.uint8)[~gone].tobytes()))
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    joined = source.join(marked, ["doc", "mark"], "left").select("doc_id", "data", "spans")
    return joined.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
