"""Harmonic packing of token sequences.

Lengths fall into reciprocal-capacity classes: a piece of length l is one of k = capacity // l
in its bin, for every piece of the class, so bins are filled by counting alone and workers
never wait for each other.  A document is cut so that each piece suits its class: whole
capacities first, then the largest reciprocal floor(capacity / k) that the rest holds, until
the rest's own class wastes at most ``slack`` tokens of a bin.

A piece's place is its number in its class: its rank inside a salted share of the class plus
the counts of the shares before it.  Only the last bin of each class is not full; those
pieces, at most k - 1 for each of the classes however large the corpus, are packed
together by first-fit decreasing.
"""

from __future__ import annotations

import json
import re
import struct
import zlib

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyloom.llm.common import Scratch, arrow_map

#: Words a worker remembers; a full cache is emptied.
CACHE = 500_000
#: Shares of all pieces for each shuffle partition.
SHARES = 4


#: Words whose normalisation is lower-casing alone: no combining marks, no odd spaces, no dotted capital I.
_SIMPLE = re.compile("[!-~¡-įıĲ-ɏ]+")
_BYTE_CHARS = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}


class WordTokenizer:
    """Ids by a ``tokenizers`` file, remembered for each word between ASCII spaces.

    The normaliser and the pattern never join across white space, so words are encoded alone.
    Where lower-casing is all the normaliser does, a word is split by the file's own pattern
    and only its parts go to the merge model, remembered too; other words take the whole
    tokenizer.  Special tokens' strings in a text are ordinary text.
    """

    def __init__(self, definition: str) -> None:
        from tokenizers import Tokenizer

        self.plain = Tokenizer.from_str(definition)
        self.plain.encode_special_tokens = True
        self.model = self.plain.model
        spec = json.loads(definition)
        steps = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        splits = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        #: Only a file of this kind may take the short way.
        self.short = steps == ["NFC", "Replace", "Lowercase"] and [x.get("type") for x in splits] == ["Split", "ByteLevel"] and splits[0]["invert"]
        self.split = regex.compile(splits[0]["pattern"]["Regex"]) if self.short else None
        #: Ids as little-endian unsigned 32-bit integers: smaller than tuples, and texts are joins of them.
        self.known: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _part(self, part: str) -> bytes:
        ids = self.parts.get(part)
        if ids is None:
            raw = part if part.isascii() else part.encode().decode("latin-1").translate(_BYTE_CHARS)
            ids = _packed([t.id for t in self.model.tokenize(raw)])
            if len(self.parts) >= CACHE:
                self.parts.clear()
            self.parts[part] = ids
        return ids

    def word(self, word: str) -> bytes:
        if self.short and _SIMPLE.fullmatch(word):
            found = self.split.findall(word.lower())
            return b"".join(map(self._part, found))
        return _packed(self.plain.encode(word, add_special_tokens=False).ids)

    def ids(self, text: str) -> np.ndarray:
        words = text.replace("\n", " ").split(" ")
        new = set(words).difference(self.known)
        if new:
            if len(self.known) + len(new) > CACHE:
                self.known.clear()
                new = set(words)
            self.known.update(zip(new, map(self.word, new), strict=True))
        return np.frombuffer(b"".join(map(self.known.__getitem__, words)), "<u4")


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def cut_lengths(n: int, capacity: int, slack: int) -> list[int]:
    """Piece lengths of a document of *n* tokens, in order."""
    out = [capacity] * (n // capacity)
    rest = n % capacity
    while rest:
        k = capacity // rest
        if capacity - k * rest <= slack:
            out.append(rest)
            break
        piece = capacity // (k + 1)
        out.append(piece)
        rest -= piece
    return out


_TOKENIZERS: dict[int, WordTokenizer] = {}


def _tokenizer(definition: str) -> WordTokenizer:
    key = hash(definition)
    if key not in _TOKENIZERS:
        _TOKENIZERS[key] = WordTokenizer(definition)
    return _TOKENIZERS[key]


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int, slack: int) -> DataFrame:
    """doc_id, row, start, length, ids_crc32, doc_tokens for every piece of every document."""
    with open(tokenizer_path, encoding="utf-8") as f:
        definition = docs.sparkSession.sparkContext.broadcast(f.read())  # a fixed vocabulary

    def rows(c: dict[str, list]) -> dict[str, list]:
        tokenizer = _tokenizer(definition.value)
        out: dict[str, list] = {n: [] for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")}
        for doc_id, text in zip(c["doc_id"], c["text"], strict=True):
            ids = np.append(tokenizer.ids(text), np.array([end_id], "<u4"))
            at = 0
            for n in cut_lengths(len(ids), capacity, slack):
                out["doc_id"].append(doc_id)
                out["start"].append(at)
                out["length"].append(n)
                out["ids_crc32"].append(zlib.crc32(ids[at : at + n].tobytes()))
                out["doc_tokens"].append(len(ids))
                at += n
        return out

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    made = arrow_map(docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")), rows, schema)
    return made.withColumn("row", F.monotonically_increasing_id())


def _first_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece, by best-fit over *lengths* in falling order."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    by_room: dict[int, list[int]] = {}
    rooms = np.zeros(capacity + 1, np.int64)
    n_bins = 0
    for i in order.tolist():
        n = int(lengths[i])
        fits = np.flatnonzero(rooms[n:])
        if len(fits):
            room = n + int(fits[0])
            at = by_room[room].pop()
            rooms[room] -= 1
        else:
            room, at = capacity, n_bins
            n_bins += 1
        bins[i], offsets[i] = at, capacity - room
        by_room.setdefault(room - n, []).append(at)
        rooms[room - n] += 1
    return bins, offsets


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int = 2,
    capacity: int = 4096,
    slack: int = 64,
) -> DataFrame:
    """Pieces of all documents with the sequence and offset that harmonic packing gives them.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.  A document's
    ids are those of its whole text and *end_id*, so a null or empty text has one id.  Every
    id lies in exactly one piece; offsets in a sequence have no gap.  Repeated rows are packed
    as documents of their own, null doc_ids stay null, an empty table gives no piece.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    cut = scratch.write(pieces(docs, tokenizer_path, end_id, capacity, slack), "pieces")
    spark = docs.sparkSession
    # one row for each class, at most `capacity` of them
    counts = [(r["length"], r["n"]) for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()]
    wanted = SHARES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = sum(n for _, n in counts) or 1
    shares = spark.createDataFrame([(length, n, -(-n * wanted // total)) for length, n in counts], "length long, n long, shares long")
    salted = cut.join(F.broadcast(shares), "length").withColumn("share", F.pmod(F.xxhash64("row", "start"), F.col("shares")))
    by_share = salted.groupBy("length", "share").agg(F.count(F.lit(1)).alias("m"))
    before = Window.partitionBy("length").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_share.select("length", "share", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "share").orderBy("row", "start")
    numbered = (
        salted.withColumn("nth", F.row_number().over(inside) - 1)
        .join(starts, ["length", "share"])
        .withColumn("nth", F.col("nth") + F.col("base"))
        .withColumn("k", F.floor(F.lit(capacity) / F.col("length")))
    )
    numbered = scratch.write(numbered.withColumn("full", F.col("nth") < F.floor(F.col("n") / F.col("k")) * F.col("k")).drop("shares", "share", "base"), "numbered")
    scratch.drop("pieces")
    payload = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    # a class's sequences are numbered in its own range
    wide = 1 << 44
    full = numbered.where("full").select(
        *payload,
        (F.col("length") * wide + F.floor(F.col("nth") / F.col("k"))).alias("sequence_id"),
        ((F.col("nth") % F.col("k")) * F.col("length")).alias("offset"),
    )

    def fit(rest: pd.DataFrame) -> pd.DataFrame:
        rest = rest.sort_values(["length", "row"], ascending=[False, True], kind="stable")
        bins, offsets = _first_fit(rest["length"].to_numpy(), capacity)
        return rest[payload].assign(sequence_id=bins, offset=offsets)

    schema = ", ".join(f"{c} long" for c in [*payload, "sequence_id", "offset"])
    # at most k - 1 pieces for each class: a bound by the capacity alone
    rest = numbered.where("not full").select("row", F.lit(0).alias("together"), *payload).groupBy("together").applyInPandas(fit, schema)
    return full.unionByName(rest)


def public_path(name: str) -> str:
    """The place of a public tokenizer's file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
