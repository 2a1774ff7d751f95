"""Huffman coding of integer streams, one binary value a scan.

Symbols are counted by a distributed aggregation; only the table of distinct symbols comes to
the driver, where the tree is built.  A coded stream is its bits, most significant first,
behind one byte with the number of padding bits, which is 8 for a whole number of bytes.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Tree:
    """``nodes`` is the root, then the left and the right child of each inner node; node k of 1..n is
    symbol k - 1, inner nodes count from n + 1."""

    symbols: np.ndarray
    nodes: np.ndarray

    def codes(self) -> dict[int, tuple[int, int]]:
        """(bits, length) of every symbol; a lone symbol has one bit."""
        n = len(self.symbols)
        if n == 1:
            return {int(self.symbols[0]): (0, 1)}
        inner = (len(self.nodes) - 1) // 2
        out: dict[int, tuple[int, int]] = {}
        todo = [(int(self.nodes[0]), 0, 0)]
        while todo:
            node, code, length = todo.pop()
            if node <= n:
                out[int(self.symbols[node - 1])] = (code, length)
            else:
                k = node - n
                todo.append((int(self.nodes[k]), code << 1, length + 1))
                todo.append((int(self.nodes[inner + k]), code << 1 | 1, length + 1))
        return out


def build_tree(counts: Iterable[tuple[int, int]]) -> Tree:
    """Tree of (symbol, weight) rows; of equal weights the lower node merges first."""
    rows = sorted(counts)
    symbols = np.array([s for s, _ in rows], np.int64)
    heap = [(w, k + 1) for k, (_, w) in enumerate(rows)]
    heapq.heapify(heap)
    left, right, node = [], [], len(rows)
    while len(heap) > 1:
        (w1, a), (w2, b) = heapq.heappop(heap), heapq.heappop(heap)
        node += 1
        left.append(a)
        right.append(b)
        heapq.heappush(heap, (w1 + w2, node))
    return Tree(symbols, np.array([heap[0][1] if heap else 0, *left, *right], np.int64))


#: Distinct symbols of a tree, at most; a column with more is not worth coding.
MOST_SYMBOLS = 1 << 20
#: Bits that one step of decoding looks up.
WINDOW = 16


def tree_of(df: DataFrame, symbol: str) -> Tree:
    """Tree over a column's values; rows to the driver are its distinct values, which are bounded."""
    rows = df.groupBy(symbol).agg(F.count(F.lit(1)).alias("n")).limit(MOST_SYMBOLS + 1).collect()
    if len(rows) > MOST_SYMBOLS:
        raise ValueError(f"{symbol} has more than {MOST_SYMBOLS} distinct values")
    return build_tree((r[0], r[1]) for r in rows)


def encode(values: np.ndarray, codes: dict[int, tuple[int, int]]) -> bytes:
    """The values' codes one after the other; bits are laid out by array operations."""
    if not len(values):
        return bytes([8])
    symbols = np.array(sorted(codes))
    code = np.array([codes[s][0] for s in symbols.tolist()], dtype=object if max(n for _, n in codes.values()) > 62 else np.int64)
    length = np.array([codes[s][1] for s in symbols.tolist()])
    at = np.searchsorted(symbols, values)
    if not np.array_equal(symbols[np.minimum(at, len(symbols) - 1)], values):
        raise ValueError("a value has no code")
    n = length[at]
    ends = np.cumsum(n)
    place = np.arange(int(ends[-1])) - np.repeat(ends - n, n)  # of a bit in its code
    bits = ((np.repeat(code[at], n) >> (np.repeat(n, n) - 1 - place)) & 1).astype(np.uint8)
    padding = 8 - len(bits) % 8
    return bytes([padding]) + np.packbits(np.concatenate([bits, np.zeros(padding, np.uint8)])).tobytes()


def decode(data: bytes, tree: Tree, length: int) -> np.ndarray:
    """Exactly *length* symbols; too few or left-over bits are an error.

    The symbol that begins at each bit is looked up at once; what remains is to follow the
    symbols' lengths from the first bit on.
    """
    bits = np.unpackbits(np.frombuffer(data[1:], np.uint8))
    bits = bits[: len(bits) - data[0]] if len(bits) else bits
    wrong = ValueError("a stream of another length")
    if len(tree.symbols) == 1:
        if len(bits) != length:
            raise wrong
        return np.full(length, tree.symbols[0])
    codes = tree.codes()
    wide = min(WINDOW, max(n for _, n in codes.values()))
    symbol, size = np.full(1 << wide, -1), np.zeros(1 << wide, np.int64)
    longer: dict[tuple[int, int], int] = {}
    for k, s in enumerate(tree.symbols.tolist()):
        c, n = codes[s]
        if n <= wide:
            symbol[c << wide - n : (c + 1) << wide - n], size[c << wide - n : (c + 1) << wide - n] = k, n
        else:
            longer[(c, n)] = k
    padded = np.concatenate([bits, np.zeros(wide, np.uint8)]).astype(np.int64)
    window = np.zeros(len(bits), np.int64)
    for k in range(wide):
        window = window << 1 | padded[k : k + len(bits)]
    found, step = symbol[window].tolist(), size[window].tolist()
    out, at, end = [], 0, len(bits)
    while at < end:
        n = step[at]
        if n:
            out.append(found[at])
        else:
            c, n = int(window[at]), wide
            while (c, n) not in longer:
                if at + n >= end:
                    raise wrong
                c, n = c << 1 | int(bits[at + n]), n + 1
            out.append(longer[(c, n)])
        at += n
    if len(out) != length or at != end:
        raise wrong
    return tree.symbols[np.array(out, int)] if out else np.zeros(0, np.int64)


def encode_scans(df: DataFrame, keys: list[str], value: str, tree: Tree) -> DataFrame:
    """keys, n, data: each scan's values in order of ``i`` as one coded stream."""
    codes = tree.codes()
    scans = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("i", F.col(value).alias("v")))).alias("rows"))

    @F.pandas_udf("binary")
    def pack(values: pd.Series) -> pd.Series:
        return values.map(lambda v: encode(np.asarray(v), codes))

    values = F.transform("rows", lambda r: r["v"].cast("long"))
    return scans.select(*keys, F.size("rows").alias("n"), pack(values).alias("data"))


def decode_scans(coded: DataFrame, keys: list[str], tree: Tree) -> DataFrame:
    """keys, i, value of every sample."""

    @F.pandas_udf("array<long>")
    def unpack(data: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([decode(bytes(x), tree, int(k)) for x, k in zip(data, n, strict=True)])

    return coded.select(*keys, F.posexplode(unpack("data", "n")).alias("i", "value")).withColumn("i", F.col("i").cast("long"))
