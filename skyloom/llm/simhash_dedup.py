"""SimHash near-duplicates by vantage-point trees over 64-bit fingerprints.

The metric is the Hamming distance on a block of bits, the vantage point the zero string:
a fingerprint's distance to it is the number of ones in the block, its *ring*.  Distances
on disjoint blocks add up to the whole distance, so by the triangle inequality

    d(x, y) >= sum over blocks of |ring(x) - ring(y)|,

and a branch is pruned when that sum exceeds the radius.  The tree therefore has one level
for each block, a child for each ring, and a search carries what is left of its radius.

Shards: of two fingerprints within r, one half of the bits differs in at most r // 2.  A shard
is a half and its ring vector; a fingerprint lives in the shard of its own vector and visits
those above it within r // 2 (from the lower side only: of two overlapping shards one
suffices).  In a shard the rest of the tree is searched in memory as a self-join of nodes.
Equal fingerprints are one point; a shard emits a star for each set of linked points, so
that its rows grow with the points and never with the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import Keyed, Scratch, arrow_map, lower_words, text_bytes
from skyloom.llm.components import components
from skyloom.llm.similar_texts import similar_links, sketch, text_key

#: Bits of a block; 16 blocks of 4 bits.
BLOCK = 4
#: Jaccard similarity of near copies and words of its shingles, where no radius is asked for.
SIMILARITY, SHINGLE = 0.8, 5
_LEAF = 1 << 14  # comparisons below which a pair of nodes is compared directly
_ONES = np.array([bin(i).count("1") for i in range(1 << 16)], np.uint8)


def fingerprint(text: bytes, words: int = 3) -> int:
    """SimHash of the word shingles: a bit is 1 if more than half of the shingles' hashes have it."""
    w = lower_words(text)
    if not w:
        return 0
    if len(w) <= words:
        return xxhash.xxh64_intdigest(b" ".join(w), 42)
    joined = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=False)], ">u8")
    n, counts = len(hashes), np.zeros(64, np.int64)
    for at in range(0, n, 4096):  # bounded memory for any length
        counts += np.unpackbits(hashes[at : at + 4096].view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(texts: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, row and fp (the fingerprint as a signed long) of every row; null counts as empty."""

    def rows(c: dict[str, list]) -> dict[str, list]:
        raw = np.array([fingerprint(t, words) for t in c["text"]], np.uint64)
        return {"doc_id": c["doc_id"], "row": c["row"], "fp": raw.view(np.int64)}

    return arrow_map(texts.select("doc_id", "row", text_bytes()), rows, "doc_id long, row long, fp long")


def _rings(fp: Column, blocks: range) -> list[Column]:
    return [F.bit_count(F.shiftrightunsigned(fp, BLOCK * b).bitwiseAND(F.lit((1 << BLOCK) - 1))) for b in blocks]


def shards(points: DataFrame, radius: int) -> DataFrame:
    """(half, shard, fp, home): the home shard of every fingerprint and those it visits.

    A visit raises the ring vector by a multiset of at most radius // 2 steps, since the ring
    vectors of a linked pair differ by that much in one half; the pair meets where the
    vectors' componentwise maximum is the shard, which both reach from below.
    """
    steps = radius // 2
    per_half = 64 // BLOCK // 2
    frames = []
    for half in (0, 1):
        rings = _rings(F.col("fp"), range(half * per_half, (half + 1) * per_half))
        code = sum((r.cast("long") * (8**i) for i, r in enumerate(rings)), F.lit(0).cast("long"))
        raises = [c for k in range(1, steps + 1) for c in combinations_with_replacement(range(per_half), k)]
        visits = [
            F.when(
                F.expr("true") if not c else _within(rings, c),
                F.struct((code + sum(8**i for i in c)).alias("shard"), F.lit(False).alias("home")),
            )
            for c in raises
        ]
        every = F.array(F.struct(code.alias("shard"), F.lit(True).alias("home")), *visits)
        frames.append(points.select("fp", F.explode(F.filter(every, lambda x: x.isNotNull())).alias("s")).select(F.lit(half).alias("half"), "s.shard", "fp", "s.home"))
    return frames[0].unionByName(frames[1])


def _within(rings: list[Column], raises: tuple[int, ...]) -> Column:
    ok = F.lit(True)
    for i in set(raises):
        ok = ok & (rings[i] + raises.count(i) <= BLOCK)
    return ok


def _ring(fp: np.ndarray, level: int) -> np.ndarray:
    return _ONES[((fp >> np.uint64(BLOCK * level)) & np.uint64((1 << BLOCK) - 1)).astype(np.intp)]


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a[:, None] ^ b[None, :])


class VantageTree:
    """In-memory tree over distinct fingerprints: one level a block, one child a ring."""

    def __init__(self, points: np.ndarray, levels: tuple[int, ...]) -> None:
        self.points, self.levels = points, levels

    def links(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Index pairs of all points within *radius*, in blocks; each pair once."""
        every = np.arange(len(self.points))
        todo = [(every, every, 0, radius)]
        while todo:
            a, b, level, left = todo.pop()
            if not len(a) or not len(b):
                continue
            same = a is b
            if len(a) * len(b) <= _LEAF or level == len(self.levels):
                yield from self._leaf(a, b, radius, same)
                continue
            ra = _ring(self.points[a], self.levels[level])
            rb = ra if same else _ring(self.points[b], self.levels[level])
            parts_a = {int(r): a[ra == r] for r in np.unique(ra)}
            parts_b = parts_a if same else {int(r): b[rb == r] for r in np.unique(rb)}
            for r, x in parts_a.items():
                for q, y in parts_b.items():
                    if abs(r - q) <= left and (not same or r <= q):
                        todo.append((x, y, level + 1, left - abs(r - q)))

    def _leaf(self, a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        step = max(1, (1 << 20) // len(b))
        for at in range(0, len(a), step):
            x = a[at : at + step]
            i, j = np.nonzero(_distance(self.points[x], self.points[b]) <= radius)
            i, j = x[i], b[j]
            keep = i < j if same else i != j
            yield i[keep], j[keep]


def _merge(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after linking points i and j; a label is the smallest index of its set."""
    while len(i):
        a, b = labels[i], labels[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(labels, above := labels[labels]):
            labels = above
    return labels


def local_labels(points: np.ndarray, radius: int, levels: tuple[int, ...]) -> np.ndarray:
    """For distinct *points* the smallest index that links within *radius* reach."""
    labels = np.arange(len(points))
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for pair in VantageTree(points, levels).links(radius):
        held.append(pair)
        size += len(pair[0])
        if size >= 1 << 16:
            labels = _merge(labels, *map(np.concatenate, zip(*held, strict=True)))
            held, size = [], 0
    return _merge(labels, *map(np.concatenate, zip(*held, strict=True))) if held else labels


def links(points: DataFrame, radius: int = 3) -> DataFrame:
    """(fp, other) rows that join distinct fingerprints to the same components as the links within
    *radius* bits would: a star for each set that a shard's tree finds, so fewer rows than points."""
    per_half = 64 // BLOCK // 2
    levels = {0: tuple(range(per_half, 2 * per_half)), 1: tuple(range(per_half))}

    def stars(half: int, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        points = np.unique(fps.view(np.uint64))
        labels = local_labels(points, radius, levels[half])
        at = np.flatnonzero(labels != np.arange(len(points)))
        return points[at].view(np.int64), points[labels[at]].view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Shards arrive sorted; the last one of a batch may go on in the next."""
        open_: list[tuple[np.ndarray, ...]] = []

        def flush(parts: list[tuple[np.ndarray, ...]], to: int | None) -> tuple[pa.RecordBatch | None, list]:
            half, shard, fp, home = (np.concatenate(x) for x in zip(*parts, strict=True))
            cuts = np.flatnonzero((np.diff(half) != 0) | (np.diff(shard) != 0)) + 1
            bounds = [0, *cuts.tolist(), len(fp)]
            rest = []
            if to is None:
                at = bounds[-2]
                rest = [(half[at:], shard[at:], fp[at:], home[at:])]
                bounds = bounds[:-1]
            found = [
                stars(int(half[a]), fp[a:b])
                for a, b in zip(bounds, bounds[1:], strict=False)
                if b - a > 1 and (radius // 2 > 1 or home[a:b].any())
            ]
            if not found:
                return None, rest
            x, y = (np.concatenate(v) for v in zip(*found, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["fp", "other"]), rest

        for batch in batches:
            if not batch.num_rows:
                continue
            open_.append(tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns))
            if open_[0][1][0] == open_[-1][1][-1] and open_[0][0][0] == open_[-1][0][-1]:
                continue  # one shard so far
            out, open_ = flush(open_, None)
            if out is not None:
                yield out
        if open_:
            out, _ = flush(open_, 0)
            if out is not None:
                yield out

    dealt = shards(points, radius)
    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(n, "half", "shard").sortWithinPartitions("half", "shard")
    return dealt.mapInArrow(run, "fp long, other long").distinct()


def _sketched(texts: DataFrame, words: int, shingle: int) -> DataFrame:
    """doc_id, row, fp and what ``similar_links`` asks for, of every row, in one reading of the texts."""

    def rows(c: dict[str, list]) -> dict[str, list]:
        raw = np.array([fingerprint(t, words) for t in c["text"]], np.uint64)
        sketches = [sketch(t, shingle) for t in c["text"]]
        named = dict(zip(("node", "n", "buckets"), zip(*sketches, strict=True), strict=True)) if sketches else {"node": [], "n": [], "buckets": []}
        return {"doc_id": c["doc_id"], "row": c["row"], "fp": raw.view(np.int64), "key": [text_key(t) for t in c["text"]]} | named

    return arrow_map(texts.select("doc_id", "row", text_bytes()), rows, "doc_id long, row long, fp long, key long, node long, n long, buckets array<long>")


def _grouped(texts: DataFrame, words: int, radius: int | None, scratch: Scratch) -> DataFrame:
    """doc_id, row, fp, fingerprint, component_id and stays for rows of doc_id, row and text."""
    if radius is None:
        prints = scratch.write(_sketched(texts, words, SHINGLE), "prints")
    else:
        prints = scratch.write(fingerprints(texts, words), "prints")
    # the row that stays is the smallest (doc_id is null, doc_id, row)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    points = scratch.write(prints.groupBy("fp").agg(F.min(order).alias("first")), "points")
    edges = scratch.write(links(points.select("fp"), 3 if radius is None else radius), "links").select(F.col("fp").alias("a"), F.col("other").alias("b"))
    if radius is None:
        edges = similar_links(texts, prints, edges, SIMILARITY, SHINGLE, scratch)
    roots = components(edges, scratch)
    at = points.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    at = scratch.write(at, "roots")
    first = at.groupBy("root").agg(F.min("first").alias("keep"))
    by_point = at.join(first, "root").select("fp", "keep")
    return prints.join(by_point, "fp").select(
        "doc_id",
        "row",
        "fp",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("keep.doc_id").alias("component_id"),
        (F.col("doc_id").eqNullSafe(F.col("keep.doc_id")) & F.col("row").eqNullSafe(F.col("keep.row"))).alias("stays"),
    )


def near_groups(docs: DataFrame, words: int = 3, radius: int | None = None) -> DataFrame:
    """doc_id, fp, fingerprint (16 hex digits), component_id for every row of *docs*.

    With a *radius*, documents are linked when their fingerprints differ in at most so many bits.
    Without one, those within 3 bits are, and also those whose sets of 5-word shingles have a
    Jaccard similarity of 0.8 or more (``SIMILARITY``, ``SHINGLE``); ``component_id`` is the
    smallest doc_id reachable, itself included.  A null or empty text has fingerprint zero and
    is linked like any other.  Null doc_ids keep their row and never are a component's id unless
    it has no other.  Repeated rows each get a row.
    """
    texts = docs.select(F.col("doc_id").cast("long"), F.lit(None).cast("long").alias("row"), "text")
    return _grouped(texts, words, radius, Scratch(docs.sparkSession, "simhash")).drop("row", "stays")


def drop_near_copies(docs: DataFrame, words: int = 3, radius: int | None = None) -> DataFrame:
    """The rows of *docs*, all columns, of one row a component: that with its smallest doc_id; one
    row also of those that have no doc_id or share one.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    keyed = Keyed(docs, scratch)
    return keyed.without(_grouped(keyed.texts(), words, radius, scratch).where("not stays").select("doc_id", "row"))
