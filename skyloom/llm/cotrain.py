"""Quality classifier by co-training two views of a document.

The content view sees the text (statistics and hashed words), the metadata view what the
page says about it (source, language, declared length).  In each round both views score every
document without a label, each hands the other one the labels of its surest documents of
either class, and what those documents look like in the other view is summed on the executors.
A view then learns its logistic model again from the labelled sample, with one feature more:
the log-odds that the labels it was handed give a document.  So the pool is the whole corpus,
and the sample decides how far a view trusts the other one.  Both are calibrated on labelled
rows that no model was fitted on and combined by their calibrated log-odds.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import log, log1p

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.llm import text_stats
from skyloom.llm.common import Scratch
from skyloom.llm.quality_rules import sample_labels

#: Labelled rows the models are fitted on, at most.
MAX_LABELLED = 5_000
#: Hashed words of the content view; hashed values of the metadata view.
WORD_BUCKETS, META_BUCKETS = 1 << 12, 256
_DENSE = len(text_stats.FEATURES)
TEXT_WIDTH, META_WIDTH = WORD_BUCKETS + _DENSE, META_BUCKETS + 1
#: Statistics of the two views, their first columns; the others are shares.
DENSE = {"text": _DENSE, "meta": 1}
WIDTH = {"text": TEXT_WIDTH, "meta": META_WIDTH}
#: Log-odds are ranked in steps of 1 / RANKS from -LIMIT to LIMIT.
RANKS, LIMIT = 256, 32
#: A view's columns as 16-bit numbers and their values as 32-bit floats.
FEATURES = "tc binary, tv binary, mc binary, mv binary"

Sparse = tuple[list[int], list[float]]


def text_view(text: bytes) -> Sparse:
    """Statistics, then each hashed word's share of the text's words; nothing for no words."""
    base = text_stats.base_counts(text)
    n, words = base[0], base[-1]
    if not n:
        return [], []
    counts = Counter(words)
    cols = list(range(_DENSE)) + [_DENSE + zlib.crc32(w) % WORD_BUCKETS for w in counts]
    return cols, text_stats.features(text, base) + [c / n for c in counts.values()]


def meta_view(source: str | None, lang: str | None, n_chars: int | None) -> Sparse:
    """The declared length's logarithm and one-hot hashed source and language (null is a value of its own)."""
    cols = [1 + zlib.crc32(f"{k}={v}".encode()) % META_BUCKETS for k, v in (("source", source), ("lang", lang))]
    return [0, *cols], [log1p(max(0, n_chars or 0)) / 10.0, 1.0, 1.0]


def _packed(view: Sparse) -> tuple[bytes, bytes]:
    return np.array(view[0], "<u2").tobytes(), np.array(view[1], "<f4").tobytes()


def featured(docs: DataFrame, scratch: Scratch, whole: bool = False) -> DataFrame:
    """A table of all rows: doc_id and the packed features of both views, and ``doc``, the *whole* row as it is, if wanted."""
    types = dict(docs.dtypes)
    meta = [F.col(c).cast(t) if c in types else F.lit(None).cast(t) for c, t in (("source", "string"), ("lang", "string"), ("n_chars", "long"))]

    @F.pandas_udf(FEATURES)
    def views(text: pd.Series, source: pd.Series, lang: pd.Series, n_chars: pd.Series) -> pd.DataFrame:
        packed = []
        for t, s, w, n in zip(text, source, lang, n_chars, strict=True):
            packed.append((*_packed(text_view(t)), *_packed(meta_view(s, w, None if pd.isna(n) else int(n)))))
        return pd.DataFrame(packed, columns=["tc", "tv", "mc", "mv"])

    made = docs.select(*([F.struct("*").alias("doc")] if whole else []), F.col("doc_id").cast("long").alias("doc_id"), views(F.coalesce("text", F.lit("")).cast("binary"), *meta).alias("f"))
    return scratch.write(made.select(*made.columns[:-1], "f.*"), "features")


@dataclass
class Rows:
    """Sparse rows in flat arrays."""

    row: np.ndarray
    col: np.ndarray
    val: np.ndarray
    n: int

    @staticmethod
    def of(views: list[Sparse]) -> Rows:
        sizes = [len(c) for c, _ in views]
        row = np.repeat(np.arange(len(views)), sizes)
        col = np.fromiter((c for cols, _ in views for c in cols), np.int64, sum(sizes))
        val = np.fromiter((v for _, vals in views for v in vals), float, sum(sizes))
        return Rows(row, col, val, len(views))

    @staticmethod
    def unpack(cols: pa.Array, vals: pa.Array) -> Rows:
        """From packed columns of any number of rows, without Python objects."""
        col, sizes = _buffer(cols, "<u2")
        val, _ = _buffer(vals, "<f4")
        return Rows(np.repeat(np.arange(len(sizes)), sizes), col.astype(np.intp), val.astype(float), len(sizes))

    def with_column(self, value: np.ndarray, at: int) -> Rows:
        """With one column more, *at*, that every row has."""
        every = np.arange(self.n)
        return Rows(np.concatenate([self.row, every]), np.concatenate([self.col, np.full(self.n, at)]), np.concatenate([self.val, value]), self.n)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.val * w[self.col], self.n)

    def dot_t(self, g: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(self.col, self.val * g[self.row], width)

    def take(self, rows: np.ndarray) -> Rows:
        place = np.full(self.n, -1)
        place[rows] = np.arange(len(rows))
        held = place[self.row] >= 0
        return Rows(place[self.row[held]], self.col[held], self.val[held], len(rows))


@dataclass
class Logistic:
    """Logistic regression over scaled sparse columns, fitted by accelerated gradient steps."""

    weights: np.ndarray
    bias: float

    @staticmethod
    def fit(x: Rows, y: np.ndarray, width: int, steps: int = 150, l2: float = 1e-3, near: Logistic | None = None) -> Logistic:
        """From zero, or in fewer steps from a model that is *near*."""
        if not len(y) or y.min() == y.max():
            p = (y.sum() + 1.0) / (len(y) + 2.0)
            return Logistic(np.zeros(width), log(p / (1 - p)))
        scale = np.sqrt(np.bincount(x.col, x.val**2, width) / len(y))
        scale = 1.0 / np.maximum(scale, 1e-6)
        scaled = Rows(x.row, x.col, x.val * scale[x.col], x.n)
        # columns have unit mean square; the mean number of columns a row bounds the curvature
        rate = 4.0 / (1.0 + float(np.bincount(scaled.row, scaled.val**2, x.n).mean()))
        w = v = np.zeros(width) if near is None else near.weights / scale
        b = u = log((y.sum() + 1.0) / (len(y) - y.sum() + 1.0)) if near is None else near.bias
        for k in range(steps):
            g = 1.0 / (1.0 + np.exp(-np.clip(scaled.dot(v) + u, -30, 30))) - y
            w2 = v - rate * (scaled.dot_t(g, width) / len(y) + l2 * v)
            b2 = u - rate * g.mean()
            m = k / (k + 3.0)
            v, u = w2 + m * (w2 - w), b2 + m * (b2 - b)
            w, b = w2, b2
        return Logistic(w * scale, float(b))

    def raw(self, x: Rows) -> np.ndarray:
        return x.dot(self.weights) + self.bias


def calibrate(raw: np.ndarray, y: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """Platt scaling (a, b) of raw scores by Newton steps with smoothed targets; identity without both classes."""
    if not len(y) or y.min() == y.max():
        return 1.0, 0.0
    pos, neg = y.sum(), len(y) - y.sum()
    target = np.where(y > 0.5, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 0.0, log((pos + 1) / (neg + 1))
    x = np.stack([raw, np.ones(len(raw))], 1)
    for _ in range(steps):
        p = 1.0 / (1.0 + np.exp(-np.clip(a * raw + b, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (p - target) + 1e-3 * np.array([a, 0.0]))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def _buffer(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a binary column, and how many each row has."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros(0, kind), np.zeros(0, int)
    width = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], width)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return np.frombuffer(data.tobytes(), kind), np.diff(offsets) // np.dtype(kind).itemsize


@dataclass
class Handed:
    """What the documents that one view was handed labels for look like in it: for both classes
    their number, the sums of all columns and those of the squares of the dense ones."""

    n: np.ndarray
    sums: np.ndarray
    squares: np.ndarray

    @staticmethod
    def none(view: str) -> Handed:
        return Handed(np.zeros(2), np.zeros((2, WIDTH[view])), np.zeros((2, DENSE[view])))

    @staticmethod
    def of(view: str, x: Rows, chosen: list[np.ndarray]) -> Handed:
        """From the rows that are chosen for each class (boolean)."""
        out, dense = Handed.none(view), x.col < DENSE[view]
        for c, rows in enumerate(chosen):
            w = rows.astype(float)
            out.n[c] = w.sum()
            out.sums[c] = x.dot_t(w, WIDTH[view])
            out.squares[c] = np.bincount(x.col[dense], x.val[dense] ** 2 * w[x.row[dense]], DENSE[view])
        return out

    def flat(self) -> np.ndarray:
        return np.concatenate([self.n, self.sums.ravel(), self.squares.ravel()])

    @staticmethod
    def of_flat(view: str, flat: np.ndarray) -> Handed:
        width = WIDTH[view]
        return Handed(flat[:2], flat[2 : 2 + 2 * width].reshape(2, width), flat[2 + 2 * width :].reshape(2, -1))

    def weights(self, view: str, least: float = 20.0) -> np.ndarray:
        """Weights whose dot product with a row is its log-odds, a share-weighted log ratio for
        shares and a difference of class means over the variance for statistics; zeros without
        labels of both classes."""
        if not self.n.min() > 0:
            return np.zeros(WIDTH[view])
        d = DENSE[view]
        mean, n = self.sums[:, :d] / self.n[:, None], self.n.sum()
        spread = self.squares.sum(0) / n - (self.sums[:, :d].sum(0) / n) ** 2
        shares = self.sums[:, d:]
        prior = (shares.sum(0) + 1e-3) / (shares.sum() + 1e-3 * shares.shape[1])
        theta = (shares + least * prior) / (shares.sum(1, keepdims=True) + least)
        return np.concatenate([(mean[1] - mean[0]) / np.maximum(spread, 1e-6) / d, np.log(theta[1] / theta[0])])


@dataclass
class View:
    """One view's model: a logistic one over its columns and the log-odds of what it was handed."""

    name: str
    handed: np.ndarray
    model: Logistic
    scale: tuple[float, float]

    def log_odds(self, x: Rows) -> np.ndarray:
        """Calibrated log-odds."""
        return self.scale[0] * self.model.raw(x.with_column(x.dot(self.handed), WIDTH[self.name])) + self.scale[1]

    @staticmethod
    def fit(name: str, x: Rows, y: np.ndarray, handed: Handed, near: View | None = None) -> View:
        """Every fifth row is held back for the calibration."""
        weights = handed.weights(name)
        held = np.arange(len(y)) % 5 == 0
        own = x.with_column(x.dot(weights), WIDTH[name])
        model = Logistic.fit(own.take(np.flatnonzero(~held)), y[~held], WIDTH[name] + 1, 150 if near is None else 50, near=near and near.model)
        return View(name, weights, model, calibrate(model.raw(own.take(np.flatnonzero(held))), y[held]))


@dataclass
class Model:
    """Both views, the prior log-odds, and how many labels each was handed of either class in the last round."""

    text: View
    meta: View
    prior: float
    handed: dict[str, tuple[int, int]]

    def log_odds(self, text: Rows, meta: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated log-odds of the content view, the metadata view and their combination."""
        t, m = self.text.log_odds(text), self.meta.log_odds(meta)
        return t, m, t + m - self.prior


OTHER = {"text": "meta", "meta": "text"}


def _rows_of(batch: pa.RecordBatch | pa.Table) -> dict[str, Rows]:
    return {v: Rows.unpack(batch.column(f"{v[0]}c"), batch.column(f"{v[0]}v")) for v in WIDTH}


def _sliced(batches: Iterator[pa.RecordBatch], rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """Few rows at a time, for their features take several times their packed size."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _rank(log_odds: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(log_odds * RANKS), -LIMIT * RANKS, LIMIT * RANKS - 1).astype(np.int64)


def surest(ranks: np.ndarray, counts: np.ndarray, share: float, prior: float) -> tuple[int, int]:
    """(low, high): documents with a rank of at most low are the surest of class 0 and those of at
    least high of class 1, about *share* of all, in the proportions of the labels, equal ranks
    together.  Where one class reaches the other's ranks, that is where the view tells no
    documents apart, it gives up the class it would give more of."""
    order = np.argsort(ranks)
    ranks, counts = ranks[order], counts[order]
    total = counts.sum()
    low = ranks[min(len(ranks) - 1, np.searchsorted(np.cumsum(counts), share * (1 - prior) * total))]
    high = ranks[::-1][min(len(ranks) - 1, np.searchsorted(np.cumsum(counts[::-1]), share * prior * total))]
    if low < high:
        return int(low), int(high)
    return (int(low), LIMIT * RANKS) if prior > 0.5 else (-LIMIT * RANKS - 1, int(high))


def exchange(pool: DataFrame, views: dict[str, View], share: float, prior: float) -> dict[str, Handed]:
    """What each view is handed when both have scored all of *pool*, in two passes over it.

    The first one sums the documents of each rank (at most 2 * LIMIT * RANKS of them a view),
    the second one, by then knowing which ranks are the surest, the statistics of their documents.
    """
    shipped = pool.sparkSession.sparkContext.broadcast(views)

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {v: np.zeros(2 * LIMIT * RANKS, np.int64) for v in WIDTH}
        for batch in _sliced(batches):
            for v, x in _rows_of(batch).items():
                counts[v] += np.bincount(_rank(shipped.value[v].log_odds(x)) + LIMIT * RANKS, minlength=2 * LIMIT * RANKS)
        for v, c in counts.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([v] * len(at), pa.string()), pa.array(at - LIMIT * RANKS), pa.array(c[at])], names=["view", "rank", "n"])

    got = pool.mapInArrow(ranked, "view string, rank long, n long").groupBy("view", "rank").agg(F.sum("n").alias("n")).toPandas()
    if not len(got):
        return {v: Handed.none(v) for v in WIDTH}
    bounds = {v: surest(g["rank"].to_numpy(), g["n"].to_numpy(), share, prior) for v, g in got.groupby("view")}

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {v: Handed.none(v).flat() for v in WIDTH}
        for batch in _sliced(batches):
            rows = _rows_of(batch)
            for giver, x in rows.items():
                rank, (low, high) = _rank(shipped.value[giver].log_odds(x)), bounds[giver]
                total[OTHER[giver]] += Handed.of(OTHER[giver], rows[OTHER[giver]], [rank <= low, rank >= high]).flat()
        for v, flat in total.items():
            at = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays([pa.array([v] * len(at), pa.string()), pa.array(at), pa.array(flat[at])], names=["view", "at", "value"])

    sums = pool.mapInArrow(summed, "view string, at long, value double").groupBy("view", "at").agg(F.sum("value").alias("value")).toPandas()
    out = {}
    for v in WIDTH:
        flat, mine = Handed.none(v).flat(), sums[sums["view"] == v]
        flat[mine["at"].to_numpy()] = mine["value"].to_numpy()
        out[v] = Handed.of_flat(v, flat)
    return out


def fit(table: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, rounds: int = 3, share: float = 0.1) -> Model:
    """Co-train on a table of ``featured``.

    The sparse features of at most *max_labelled* labelled documents, not their texts, come to
    the driver (those with the smallest hashes of doc_id; of the rows of one doc_id that with
    the smallest features).  All other documents are the pool.  In round k each view hands over
    the labels of its surest documents, k * *share* of the pool.
    """
    chosen = sample_labels(labels, max_labelled)
    few = table.select("doc_id", "tc", "tv", "mc", "mv")
    # at most max_labelled rows of two numbers
    known = few.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.first("label").alias("label"), F.min(F.struct("tc", "tv", "mc", "mv")).alias("f"))
    sample = known.select("doc_id", "label", "f.*").orderBy("doc_id").toArrow()
    y = sample.column("label").to_numpy().astype(float)
    rows = _rows_of(sample)
    prior_p = float((y.sum() + 1.0) / (len(y) + 2.0))
    views = {v: View.fit(v, rows[v], y, Handed.none(v)) for v in WIDTH}
    handed = {v: Handed.none(v) for v in WIDTH}
    pool = few.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_anti").select("tc", "tv", "mc", "mv")
    for k in range(1, rounds + 1) if 0 < y.sum() < len(y) else ():
        handed = exchange(pool, views, k * share, prior_p)
        views = {v: View.fit(v, rows[v], y, handed[v], views[v]) for v in WIDTH}
    return Model(views["text"], views["meta"], log(prior_p / (1 - prior_p)), {v: (int(h.n[0]), int(h.n[1])) for v, h in handed.items()})


def _scores(model: Model, rows: dict[str, Rows]) -> dict[str, np.ndarray]:
    t, m, both = (1.0 / (1.0 + np.exp(-np.clip(v, -700, 700))) for v in model.log_odds(rows["text"], rows["meta"]))
    blank = np.bincount(rows["text"].row, minlength=rows["text"].n) == 0
    return {"text_score": t, "meta_score": m, "score": np.where(blank, 0.0, both)}


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """doc_id, text_score, meta_score, score (probabilities of quality) and kept for every row.

    A text without words (null, empty) scores 0 and is not kept.  Missing or null metadata is
    a value like any other.  Without labels every other document scores one half and is kept;
    repeated rows each get a row.
    """
    table = featured(docs, Scratch(docs.sparkSession, "cotrain"))
    model = fit(table, labels, **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            scores = _scores(model, _rows_of(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, scores.values())], names=["doc_id", *scores])

    scored = table.mapInArrow(run, "doc_id long, text_score double, meta_score double, score double")
    return scored.withColumn("kept", F.col("score") >= threshold)


def filter_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """The rows of *docs*, all columns, that the classifier keeps, decided row by row."""
    table = featured(docs, Scratch(docs.sparkSession, "cotrain"), whole=True)
    return table.where(_keep(fit(table, labels, **options), threshold)).select("doc.*")


def _keep(model: Model, threshold: float) -> Column:
    @F.pandas_udf("boolean")
    def keep(tc: pd.Series, tv: pd.Series, mc: pd.Series, mv: pd.Series) -> pd.Series:
        packed = pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in (tc, tv, mc, mv)], names=["tc", "tv", "mc", "mv"])
        kept = [_scores(model, _rows_of(part))["score"] >= threshold for part in _sliced(iter([packed]))]
        return pd.Series(np.concatenate(kept) if kept else np.zeros(0, bool))

    return keep("tc", "tv", "mc", "mv")
