"""Byte-level BPE encoding and decoding by dynamic programming over byte prefixes.

A sequence of tokens is what greedy merging makes of its bytes exactly if each token is what
merging makes of its own bytes, and each adjacent pair what it makes of the pair's bytes.
So every byte prefix of a piece has exactly one *valid last token*: one that ends there and
agrees with the last token of the prefix before it.  Storing that token for each prefix gives
the encoding by walking back from the end, makes an append cost its own bytes only, and lets
an edit stop as soon as the stored tokens agree again.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable
from itertools import chain

import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm.common import arrow_map

#: Entries of the caches of a worker; a full cache is emptied.
CACHE = 1_000_000
_CHUNK = re.compile(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")
_OTHER_SPACE = re.compile("[\x85\xa0  -     　]")


class PrefixEncoder:
    """Encoder for one table of ranks and one splitting pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.tokens = {r: t for t, r in ranks.items()}
        # white space as the property: the library's engine and this one differ on control characters
        self.pattern = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.longest = max(map(len, ranks))
        lengths: dict[bytes, set[int]] = {}
        for t in ranks:
            lengths.setdefault(t[-2:], set()).add(len(t))
        #: Lengths of the tokens that end in these two bytes, longest first; one byte always is a token.
        self.lengths = {k: sorted(v | {1}, reverse=True) for k, v in lengths.items()}
        self.pairs: dict[int, bool] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.chunks: dict[str, tuple[int, ...]] = {}
        self.names = {r: str(r) for r in ranks.values()}

    def merge(self, data: bytes) -> list[int]:
        """What greedy merging makes of *data*: the definition, used on pairs of tokens only."""
        parts = [data[i : i + 1] for i in range(len(data))]
        rank, none = self.ranks.get, 1 << 40
        pairs = [rank(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while pairs and (lowest := min(pairs)) < none:
            i = pairs.index(lowest)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = rank(parts[i] + parts[i + 1], none)
            if i:
                pairs[i - 1] = rank(parts[i - 1] + parts[i], none)
        return [self.ranks[p] for p in parts]

    def agrees(self, before: int, token: int) -> bool:
        """Whether *token* may follow *before* (-1: starts a piece)."""
        key = (before + 1) << 32 | token
        known = self.pairs.get(key)
        if known is None:
            own = self.tokens[token]
            if before < 0:
                known = self.merge(own) == [token]
            else:
                known = self.merge(self.tokens[before] + own) == [before, token]
            if len(self.pairs) >= CACHE:
                self.pairs.clear()
            self.pairs[key] = known
        return known

    def last_token(self, data: bytes, end: int, last: list[int]) -> int:
        """The valid last token of ``data[:end]``, given those of all shorter prefixes."""
        rank, agrees = self.ranks.get, self.agrees
        for n in self.lengths.get(data[max(0, end - 2) : end], (1,)):
            if n <= end and (t := rank(data[end - n : end])) is not None and agrees(last[end - n - 1] if n < end else -1, t):
                return t
        raise ValueError("the ranks hold no valid token here")

    def table(self, data: bytes) -> PrefixTable:
        table = PrefixTable(self)
        table.append(data)
        return table

    def piece(self, text: str) -> tuple[int, ...]:
        """The tokens of one match of the pattern; a piece that is a token is that token."""
        known = self.pieces.get(text)
        if known is None:
            data = text.encode()
            whole = self.ranks.get(data)
            known = (whole,) if whole is not None else tuple(self.table(data).encode())
            if len(data) <= 64:
                if len(self.pieces) >= CACHE:
                    self.pieces.clear()
                self.pieces[text] = known
        return known

    def encode(self, text: str) -> list[int]:
        """The tokens of a whole text, as the library's encode_ordinary gives them.

        No match goes on from a non-space to a space, so a run of white space with the word
        behind it can be encoded alone and remembered; texts with white space outside ASCII
        take the pattern as a whole.
        """
        if _OTHER_SPACE.search(text):
            return list(chain.from_iterable(map(self.piece, self.pattern.findall(text))))
        found = _CHUNK.findall(text)
        known = self.chunks
        new = set(found).difference(known)
        if len(known) + len(new) > CACHE:
            known.clear()
            new = set(found)
        for c in new:
            known[c] = tuple(chain.from_iterable(map(self.piece, self.pattern.findall(c))))
        return list(chain.from_iterable(map(known.__getitem__, found)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class PrefixTable:
    """The valid last token of every prefix of one piece, kept through appends and edits."""

    def __init__(self, encoder: PrefixEncoder) -> None:
        self.encoder, self.data, self.last = encoder, b"", []

    def append(self, data: bytes) -> None:
        """Add *data*; the search of ``last_token``, written out since it is the hot loop."""
        encoder = self.encoder
        self.data += data
        data, last, lengths, rank, pairs, single = self.data, self.last, encoder.lengths.get, encoder.ranks.get, encoder.pairs.get, (1,)
        for end in range(len(last) + 1, len(data) + 1):
            for n in lengths(data[end - 2 : end] if end > 1 else data[:1], single):
                if n <= end and (t := rank(data[end - n : end])) is not None:
                    before = last[end - n - 1] if n < end else -1
                    agrees = pairs((before + 1) << 32 | t)
                    if agrees or agrees is None and encoder.agrees(before, t):
                        last.append(t)
                        break
            else:
                raise ValueError("the ranks hold no valid token here")

    def replace(self, at: int, length: int, data: bytes) -> int:
        """Replace ``data[at:at+length]``; gives how many prefixes were worked out again.

        Behind the edit a last token depends only on as many bytes and earlier entries as the
        longest token has; once that many entries in a row are what they were, so are the rest.
        """
        old, rest = self.last[at + length :], self.data[at + length :]
        self.data = self.data[:at] + data + rest
        del self.last[at:]
        done = agreed = 0
        border = at + len(data)
        while len(self.last) < len(self.data):
            end = len(self.last) + 1
            self.last.append(self.encoder.last_token(self.data, end, self.last))
            done += 1
            if end > border:
                agreed = agreed + 1 if self.last[-1] == old[end - border - 1] else 0
                if agreed >= self.encoder.longest:
                    self.last += old[end - border :]
        return done

    def encode(self) -> list[int]:
        out, end = [], len(self.last)
        while end:
            out.append(self.last[end - 1])
            end -= len(self.encoder.tokens[out[-1]])
        return out[::-1]


def read_ranks(blob: bytes) -> dict[bytes, int]:
    """Ranks from the lines of a rank file: base64 of the token, its rank."""
    return {base64.b64decode(t): int(r) for t, r in map(bytes.split, blob.splitlines()) if t}


_ENCODERS: dict[tuple[int, str], PrefixEncoder] = {}


def _encoder(blob: bytes, pattern: str) -> PrefixEncoder:
    """One encoder a worker and vocabulary, so that its caches outlive a task."""
    key = (hash(blob), pattern)
    if key not in _ENCODERS:
        _ENCODERS[key] = PrefixEncoder(read_ranks(blob), pattern)
    return _ENCODERS[key]


def _shipped(spark: SparkSession, path: str):
    """The vocabulary file for the executors; its size is fixed and does not follow the data."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


Derive = Callable[[PrefixEncoder, list[int]], tuple]


def encode_map(docs: DataFrame, ranks_path: str, pattern: str, derive: Derive, names: tuple[str, ...], types: tuple[str, ...]) -> DataFrame:
    """doc_id and the columns *derive* makes of every whole text's ids; a null text is empty.

    An empty text has no ids.  Rows are independent: repeated rows and null doc_ids stay as
    they are, other columns are not read.
    """
    blob = _shipped(docs.sparkSession, ranks_path)

    def rows(c: dict[str, list]) -> dict[str, list]:
        encoder = _encoder(blob.value, pattern)
        made = [derive(encoder, encoder.encode(t)) for t in c["text"]]
        return {"doc_id": c["doc_id"]} | {n: [m[i] for m in made] for i, n in enumerate(names)}

    schema = ", ".join(["doc_id long", *(f"{n} {t}" for n, t in zip(names, types, strict=True))])
    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")), rows, schema)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id and ids of every whole text."""
    return encode_map(docs, ranks_path, pattern, lambda _, ids: (ids,), ("ids",), ("array<int>",))


def decode_documents(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id and data (the bytes) of every row of ids; null ids give null, an unknown id is an error."""
    blob = _shipped(encoded.sparkSession, ranks_path)

    def rows(c: dict[str, list]) -> dict[str, list]:
        encoder = _encoder(blob.value, "")
        return {"doc_id": c["doc_id"], "data": [None if i is None else encoder.decode(i) for i in c["ids"]]}

    return arrow_map(encoded.select("doc_id", "ids"), rows, "doc_id long, data binary")
