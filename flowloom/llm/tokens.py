"""Token counts from the counts of distinct pre-tokens."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distinct pre-tokens that a Python worker remembers before it starts afresh.
REMEMBERED = 500_000
#: Spaces, then what is no space. Every piece of the vocabulary has its spaces in front, so no merge crosses such a border.
PRETOKEN = re.compile(" *[^ ]+| +$")


class PieceCounter:
    """Pieces of a sentencepiece model, counted once for each distinct pre-token."""

    def __init__(self, model: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.vocab_size()))
        self.splits = not any(re.search("[^▁]▁", p) for p in pieces)
        self.known: dict[str, int] = {}

    def learn(self, new: list[str]) -> None:
        # the library puts a space in front, so the pre-token's first one goes; a lone space would leave nothing to encode
        ids = self.model.encode([t[1:] for t in new], num_threads=1)
        self.known.update((t, len(x) if len(t) > 1 else 1) for t, x in zip(new, ids, strict=True))

    def counts(self, texts: list[str]) -> list[int]:
        if not self.splits:
            return [len(x) for x in self.model.encode(texts, num_threads=1)]
        tables = [Counter(PRETOKEN.findall(" " + t.replace("▁", " "))) if t else {} for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        if new := [t for t in set().union(*tables) if t not in self.known]:
            self.learn(new)
        known = self.known
        return [sum(n * known[t] for t, n in table.items()) for table in tables]


def token_counts(docs: DataFrame, model: str, limit: int = 4096) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_bytes, n_tokens, over_limit.

    A task cuts each text into pre-tokens, keeps their frequencies by document, counts the
    pieces of each distinct pre-token once, joins both by pre-token and sums. No text's ids
    are made, and nothing is shuffled. A null text counts as empty (0 tokens); null and
    repeated ids are passed on; other columns are ignored; an empty table gives an empty
    result. ``model`` must be readable on every executor.
    """

    @F.pandas_udf("long")
    def pieces(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = PieceCounter(model)
        for batch in batches:
            texts, n = [t or "" for t in batch], np.zeros(len(batch), np.int64)
            for at in range(0, len(texts), 256):
                n[at : at + 256] = counter.counts(texts[at : at + 256])
            yield pd.Series(n)

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), pieces(text).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
