"""Quality rules: base rules plus gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm import gbdt, text_stats
from skyloom.llm.common import arrow_map, columns, text_bytes

#: Labelled rows the trees are fitted on, at most: those with the smallest hash of doc_id.
MAX_LABELLED = 12_000


def sample_labels(labels: DataFrame, bound: int) -> DataFrame:
    """At most *bound* (doc_id, label) rows with a label; rows of one document are averaged.

    The choice is by hash, so it does not depend on the order or the partitions of the table.
    """
    one = columns(labels, "doc_id", "quality").where("doc_id is not null and quality is not null")
    one = one.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)


def _measured(texts: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Base counts (rows of five) and learned features; a text's words are dropped before the next one's are made."""
    counts, learned = [], []
    for text in texts:
        base = text_stats.base_counts(text)
        counts.append(base[:5])
        learned.append(text_stats.features(text, base))
    return np.array(counts, np.int64).reshape(-1, 5), np.array(learned, float).reshape(-1, len(text_stats.FEATURES))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def statistics(docs: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the base counts of whole texts (null: no words) and the learned features."""

    def rows(c: dict[str, list]) -> dict[str, list]:
        counts, learned = _measured(c["text"])
        return dict(zip(COUNTS, counts.T, strict=True)) | {"features": list(learned)} | {n: c[n] for n in ("doc_id", *extra)}

    types = dict(docs.dtypes)
    more = "".join(f", {n} {types[n]}" for n in extra)
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, features array<double>" + more
    return arrow_map(docs.select("doc_id", text_bytes(), *extra), rows, schema)


def fit(docs: DataFrame, labels: DataFrame, bound: int = MAX_LABELLED) -> gbdt.Forest:
    """Trees for the probability of quality, fitted on the driver on a bounded labelled sample.

    Only the statistics of the sampled rows come to the driver.  Quality may only fall as
    the features in ``text_stats.FALLING`` rise.
    """
    chosen = sample_labels(labels, bound)
    # chosen has at most *bound* rows of two numbers, so a broadcast is bounded too
    rows = statistics(columns(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id"), ("label",))
    # of the rows of one doc_id that with the smallest statistics, whatever the partitions
    rows = rows.groupBy("doc_id").agg(F.min("features").alias("features"), F.first("label").alias("label")).orderBy("doc_id").select("features", "label").collect()
    x = np.array([r[0] for r in rows], float).reshape(-1, len(text_stats.FEATURES))
    y = np.array([r[1] for r in rows], float)
    monotone = np.array([-1 if f in text_stats.FALLING else 0 for f in text_stats.FEATURES])
    return gbdt.fit(x, y, monotone)


def apply_rules(
    docs: DataFrame,
    labels: DataFrame,
    min_words: int = 50,
    max_repeat_percent: int = 50,
    threshold: float = 0.5,
    bound: int = MAX_LABELLED,
) -> DataFrame:
    """Statistics, base verdict and the forest's verdict for every row of *docs*.

    ``base_failed`` if a text has under *min_words* words, or more than
    *max_repeat_percent* per cent of its words repeat in 3-word windows.  ``kept`` if it
    has not failed and the forest gives at least *threshold*.  A null text has no words
    and fails; a null doc_id stays null; repeated rows each get a row.  Without labels (or
    with one class only) the forest is a constant of at least the threshold when that class
    is quality, or none is known.
    """
    forest = fit(docs, labels, bound)
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, quality_score double"

    def rows(c: dict[str, list]) -> dict[str, list]:
        counts, learned = _measured(c["text"])
        return dict(zip(COUNTS, counts.T, strict=True)) | {"doc_id": c["doc_id"], "quality_score": forest.probability(learned)}

    scored = arrow_map(docs.select(F.col("doc_id").cast("long"), text_bytes()), rows, schema)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return scored.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("quality_score") >= threshold))


def filter_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of *docs*, all columns, whose texts the rules keep (decided per row, in one pass)."""
    forest = fit(docs, labels, options.pop("bound", MAX_LABELLED))
    return docs.where(keep_column(forest, **options)(F.coalesce("text", F.lit("")).cast("binary")))


def keep_column(forest: gbdt.Forest, min_words: int = 50, max_repeat_percent: int = 50, threshold: float = 0.5):
    """The verdict as an Arrow-batched boolean function of UTF-8 bytes."""
    @F.pandas_udf("boolean")
    def keep(text: pd.Series) -> pd.Series:
        counts, learned = _measured(map(bytes, text))
        failed = (counts[:, 0] < min_words) | (100 * counts[:, 4] > max_repeat_percent * counts[:, 0])
        return pd.Series(~failed & (forest.probability(learned) >= threshold))

    return keep
