"""Links between texts by the Jaccard similarity of their word shingles, checked exactly.

Texts that may be similar share a bucket: the key of a bucket is a few minima of the shingles'
hashes under one mapping each.  With 32 buckets of 6 minima a pair of similarity 0.8 shares
none with a chance of 6e-5.  What is linked already is one point; points that share buckets
form a cluster, and a cluster's texts are compared with each other in blocks of a bounded number
of shingles, each pair of blocks in a task of its own, which answers with the links that join
points and never with pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import Scratch, arrow_map, even_share, lower_words, text_bytes
from skyloom.llm.components import components

#: Buckets of a text and minima in the key of a bucket.
BUCKETS, MINIMA = 32, 6
#: Shingles of a block of a cluster, and distinct ones that are counted by one matrix product.
BLOCK, COLUMNS = 1 << 20, 4096
#: Bits of the filter that lets a second reading of the texts pass over those that no cluster holds.
FILTER_BITS = 1 << 20
_ODD = np.random.default_rng(9).integers(0, 1 << 31, BUCKETS * MINIMA, np.uint32) * np.uint32(2) + np.uint32(1)


def _signed(digest: int) -> int:
    return digest - (1 << 63)


def text_key(text: bytes) -> int:
    """A digest of a whole text, to find its rows again; no decision rests on it."""
    return _signed(xxhash.xxh64_intdigest(text, 5))


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; a shorter text is one shingle, no words are none."""
    w = lower_words(text)
    if not w:
        return np.zeros(0, np.uint64)
    joined = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    last = ends[min(words, len(w)) - 1 :].tolist()
    return np.unique(np.array([digest(joined[a:b], 7) for a, b in zip(starts, last, strict=False)], np.uint64))


def bucket_keys(shingles: np.ndarray) -> list[int]:
    """One key a bucket; the multiplication is folded, for its low bits depend on few bits."""
    least = np.full(len(_ODD), np.iinfo(np.uint32).max, np.uint32)
    short = shingles.astype(np.uint32)
    for at in range(0, len(short), 256):  # bounded memory for any length
        x = _ODD[:, None] * short[None, at : at + 256]
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x9E3779B1)
        np.minimum(least, x.min(1), out=least)
    rows = least.reshape(BUCKETS, MINIMA)
    return [_signed(xxhash.xxh64_intdigest(r.tobytes(), k)) for k, r in enumerate(rows)]


def sketch(text: bytes, words: int) -> tuple[int, int, list[int]]:
    """The text's set of shingles as a node (its digest), its size and its buckets."""
    s = shingle_set(text, words)
    return _signed(xxhash.xxh64_intdigest(s.tobytes(), 11)), len(s), bucket_keys(s) if len(s) else []


def shared_shingles(sets: list[np.ndarray], rows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each of *rows* the numbers of shingles that it has in common with every set."""
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, code, times = np.unique(every, return_inverse=True, return_counts=True)
    # a shingle of one set is in no intersection; the others are numbered anew
    number = np.cumsum(times > 1) - 1
    owner, code = owner[times[code] > 1], number[code[times[code] > 1]]
    wide = int(number[-1]) + 1 if len(number) else 0
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    for at in range(0, len(rows), 256):
        some = rows[at : at + 256]
        place = np.full(len(sets), -1)
        place[some] = np.arange(len(some))
        counts = np.zeros((len(some), len(sets)), np.float32)
        for low in range(0, wide, COLUMNS):
            a, b = np.searchsorted(code, (low, low + COLUMNS))
            full = np.zeros((len(sets), min(COLUMNS, wide - low)), np.float32)
            full[owner[a:b], code[a:b] - low] = 1.0
            counts += full[some] @ full.T
        yield from zip(some.tolist(), counts, strict=True)


def block_links(roots: np.ndarray, sets: list[np.ndarray], first: np.ndarray, second: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links between roots that join the same ones as all pairs of a set in *first* (boolean) and one
    in *second* that are similar; at most as many as there are roots."""
    above: dict[int, int] = {}

    def top(r: int) -> int:
        while above.get(r, r) != r:
            above[r] = r = above.get(above[r], above[r])
        return r

    sizes = np.array([len(s) for s in sets], np.float64)
    out = []
    for i, common in shared_shingles(sets, np.flatnonzero(first)):
        alike = second & (roots != roots[i]) & (common >= similarity * (sizes + sizes[i] - common) - 1e-9)
        for r in np.unique(roots[alike]).tolist():
            a, b = top(int(roots[i])), top(r)
            if a != b:
                above[max(a, b)] = min(a, b)
                out.append((min(a, b), max(a, b)))
    return out


def similar_links(texts: DataFrame, prints: DataFrame, edges: DataFrame, similarity: float, words: int, scratch: Scratch) -> DataFrame:
    """*edges* (a, b: fingerprints) and those that join the fingerprints of similar texts.

    *prints* has a row for each text: fp, key (``text_key``), node, n and buckets (``sketch``).
    A text without words is similar to none.
    """
    nodes = prints.where("n > 0").groupBy("node").agg(F.min("fp").alias("fp"), F.max("fp").alias("other"), F.min("key").alias("key"), F.first("n").alias("n"), F.first("buckets").alias("buckets"))
    nodes = scratch.write(nodes, "nodes")
    # one set of shingles may have several fingerprints
    several = prints.join(nodes.where("fp <> other").select("node", F.col("fp").alias("least")), "node").where("fp <> least")
    edges = scratch.write(edges.unionByName(several.select(F.col("least").alias("a"), F.col("fp").alias("b")).distinct()), "edges0")
    roots = components(edges, scratch, "linked").withColumnRenamed("node", "fp")
    rooted = nodes.join(roots, "fp", "left").select("node", "key", "n", F.coalesce("root", "fp").alias("root"), "buckets")
    rooted = scratch.write(rooted, "rooted")
    # buckets of one point alone are never read again
    buckets = rooted.select("node", "root", F.explode("buckets").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("bucket", "low")
    held = scratch.write(buckets.join(shared, "bucket").select("node", "root", "low").distinct(), "held")
    clusters = components(held.select(F.col("root").alias("a"), F.col("low").alias("b")), scratch, "clusters").select(F.col("node").alias("root"), F.col("root").alias("cluster"))
    members = rooted.join(held.select("node").distinct(), "node", "left_semi").drop("buckets").join(clusters, "root")
    members = scratch.write(members, "members")
    total = members.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    block = even_share(members, 4 * total, 1 << 16, BLOCK)
    parts = members.groupBy("cluster").agg(F.ceil(F.sum("n") / block).alias("parts"))
    own = F.pmod(F.xxhash64("node"), F.col("parts"))
    placed = members.join(parts, "cluster").select("cluster", "node", "root", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other"))
    placed = placed.select("cluster", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "root")

    # a second reading of the texts makes the sets of the clusters' texts alone; the filter has a fixed size
    hits = members.select(F.pmod("key", F.lit(FILTER_BITS)).cast("int").alias("bit")).distinct().toPandas()["bit"].to_numpy()
    bits = np.zeros(FILTER_BITS, bool)
    bits[hits] = True
    shipped = texts.sparkSession.sparkContext.broadcast(np.packbits(bits))

    def sets(c: dict[str, list]) -> dict[str, list]:
        bits = np.unpackbits(shipped.value)
        found = [shingle_set(t, words) for t in c["text"] if bits[text_key(t) % FILTER_BITS]]
        return {"node": [_signed(xxhash.xxh64_intdigest(s.tobytes(), 11)) for s in found], "shingles": [s.tobytes() for s in found]}

    found = arrow_map(texts.select(text_bytes()), sets, "node long, shingles binary")
    found = scratch.write(found.join(members.select("node"), "node", "left_semi").groupBy("node").agg(F.first("shingles").alias("shingles")), "sets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of blocks arrive one after the other; the last one of a batch may go on in the next."""
        open_: list[tuple] = []

        def answer(rows: list[tuple]) -> pa.RecordBatch:
            _, i, j, own, root, shingles = zip(*rows, strict=True)
            own, roots = np.array(own), np.array(root)
            links = block_links(roots, [np.frombuffer(s, np.uint64) for s in shingles], own == i[0], own == j[0], similarity)
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([x for _, x in links], pa.int64())], names=["a", "b"])

        for batch in batches:
            for row in zip(*(batch.column(n).to_pylist() for n in ("cluster", "i", "j", "own", "root", "shingles")), strict=True):
                if open_ and open_[-1][:3] != row[:3]:
                    yield answer(open_)
                    open_ = []
                open_.append(row)
        if open_:
            yield answer(open_)

    dealt = placed.join(found, "node").repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")
    return edges.unionByName(dealt.mapInArrow(run, "a long, b long").distinct())
