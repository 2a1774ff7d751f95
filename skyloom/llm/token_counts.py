"""Token counts from an exact length histogram.

The corpus is aggregated to (encoded length, documents).  Everything a context limit asks
for is a sum over lengths from some point on: with D(L) the documents of at least L tokens,
T(L) their tokens and T the total, truncation at L leaves  T - T(L) + L * D(L)  tokens, and
the q-quantile is the first length whose documents up to it reach q.
"""

from __future__ import annotations


import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyloom.llm.bpe import _CHUNK, _OTHER_SPACE, CACHE, _shipped, read_ranks
from skyloom.llm.common import arrow_map

#: Lengths of a block of the histogram, for sums in two levels.
LENGTH_BLOCK = 64


class Counter:
    """Token counts of texts by the library, remembered for each word with its white space."""

    def __init__(self, blob: bytes, pattern: str) -> None:
        self.encoding = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=read_ranks(blob), special_tokens={})
        self.known: dict[str, int] = {}

    def count(self, text: str) -> int:
        if _OTHER_SPACE.search(text):
            return len(self.encoding.encode_ordinary(text))
        found = _CHUNK.findall(text)
        new = set(found).difference(self.known)
        if len(self.known) + len(new) > CACHE:
            self.known.clear()
            new = set(found)
        for c in new:
            self.known[c] = len(self.encoding.encode_ordinary(c))
        return sum(map(self.known.__getitem__, found))


_COUNTERS: dict[tuple[int, str], Counter] = {}


def token_lengths(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """n_tokens of every row's whole text; a null or empty text has none."""
    blob = _shipped(docs.sparkSession, ranks_path)

    def rows(c: dict[str, list]) -> dict[str, list]:
        key = (hash(blob.value), pattern)
        if key not in _COUNTERS:
            _COUNTERS[key] = Counter(blob.value, pattern)
        return {"n_tokens": list(map(_COUNTERS[key].count, c["text"]))}

    return arrow_map(docs.select(F.coalesce("text", F.lit("")).alias("text")), rows, "n_tokens long")


def histogram(lengths: DataFrame) -> DataFrame:
    """(n_tokens, n_docs), one row for each length that occurs; null lengths do not count."""
    return lengths.where("n_tokens is not null").groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """For each length that occurs: n_tokens, n_docs, docs_at_least, tokens_at_least,
    truncated_tokens (the corpus cut at this limit), docs_up_to, quantile (their share).

    Sums run inside blocks of ``LENGTH_BLOCK`` lengths in parallel; only the totals of the
    blocks, one row for each 64 tokens of the longest document, are summed in one task.
    An empty histogram gives no row.
    """
    blocks = hist.withColumn("block", F.floor(F.col("n_tokens") / LENGTH_BLOCK))
    totals = blocks.groupBy("block").agg(F.sum("n_docs").alias("bd"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("bt"))
    later = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    totals = totals.select(
        "block",
        F.coalesce(F.sum("bd").over(later), F.lit(0)).alias("docs_after"),
        F.coalesce(F.sum("bt").over(later), F.lit(0)).alias("tokens_after"),
        F.sum("bd").over(every).alias("docs"),
        F.sum("bt").over(every).alias("tokens"),
    )
    inside = Window.partitionBy("block").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, 0)
    sums = blocks.join(totals, "block").select(
        "n_tokens",
        "n_docs",
        (F.col("docs_after") + F.sum("n_docs").over(inside)).alias("docs_at_least"),
        (F.col("tokens_after") + F.sum(F.col("n_docs") * F.col("n_tokens")).over(inside)).alias("tokens_at_least"),
        "docs",
        "tokens",
    )
    up_to = F.col("docs") - F.col("docs_at_least") + F.col("n_docs")
    return sums.select(
        "n_tokens",
        "n_docs",
        "docs_at_least",
        "tokens_at_least",
        (F.col("tokens") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")).alias("truncated_tokens"),
        up_to.alias("docs_up_to"),
        (up_to / F.col("docs")).alias("quantile"),
    )


def truncated_total(sums: DataFrame, limit: int) -> DataFrame:
    """One row: tokens left when every document is cut at *limit*, for any limit.

    A look-up of two rows: the first length has all tokens behind it, the first one that is not
    below the limit those of the documents that are cut.
    """
    behind = F.struct(F.col("docs_at_least").alias("docs"), F.col("tokens_at_least").alias("tokens"))
    at = sums.agg(F.coalesce(F.max("tokens_at_least"), F.lit(0)).alias("all"), F.min_by(behind, F.when(F.col("n_tokens") >= limit, F.col("n_tokens"))).alias("cut"))
    return at.select((F.col("all") - F.coalesce("cut.tokens", F.lit(0)) + F.coalesce("cut.docs", F.lit(0)) * limit).alias("truncated_tokens"))


def quantile(sums: DataFrame, q: float) -> DataFrame:
    """One row: the smallest length that at least the share *q* of the documents does not exceed (null without documents)."""
    return sums.where(F.col("quantile") >= q).agg(F.min("n_tokens").alias("n_tokens"))
