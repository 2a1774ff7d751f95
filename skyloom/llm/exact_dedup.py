"""Exact deduplication by distributed MSD radix partitioning.

Documents are split by successive bytes of their text without white space: by a digit of
DIGIT bytes at the first place where the texts of a group differ.  A group that is too large for
one task is split again; the bytes that all its texts have in common are skipped, so every
round tells texts apart, and a group whose texts are all the same has ended.  (A round's digit is
twice as wide as the one before, so that a large group of long texts that differ here and there
takes a number of rounds that grows with the logarithm of their length.)  Any other group goes as
one to a task, which splits it further, byte by byte, until its parts are single texts or have
ended.  Equality is decided on the bytes themselves, never on a digest.

Copies that meet in one Arrow batch are collapsed first by the same recursion, so a text
that a third of all rows share goes on as one representative for each batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import SPACES, Keyed, Scratch, arrow_map, text_bytes

_CONTINUATION = bytes(range(0x80, 0xC0))
#: Bytes of a digit, and the bytes and texts of the largest group that goes to one task.
DIGIT, MOST_BYTES, MOST_TEXTS = 8, 16 << 20, 1 << 16
#: Parts of a class of copies in the join that tells its rows which one stays.
SALTS = 16


def radix_classes(texts: list[bytes], digit: int = 1) -> list[list[int]]:
    """Indices of equal texts, by MSD radix recursion on the digit after what a group has in common."""
    done: list[list[int]] = []
    todo = [list(range(len(texts)))] if texts else []
    while todo:
        members = todo.pop()
        if len(members) == 1:
            done.append(members)
            continue
        least, most = min(map(texts.__getitem__, members)), max(map(texts.__getitem__, members))
        if least == most:
            done.append(members)
            continue
        at = len(commonprefix([least, most]))
        parts: dict[bytes, list[int]] = {}
        for i in members:
            parts.setdefault(texts[i][at : at + digit], []).append(i)
        todo += parts.values()
    return done


def _representatives(texts: DataFrame) -> DataFrame:
    """One row for each distinct text of a batch, with its members and its bytes."""

    def rows(c: dict[str, list]) -> dict[str, list]:
        texts = [t.translate(None, SPACES) for t in c["text"]]
        sizes = [len(t.translate(None, _CONTINUATION)) for t in c["text"]]
        out: dict[str, list] = {"members": [], "sha": [], "rest": []}
        for part in radix_classes(texts, 64):
            out["members"].append([{"doc_id": c["doc_id"][i], "row": c["row"][i], "chars": sizes[i]} for i in part])
            out["rest"].append(texts[part[0]])
            out["sha"].append(hashlib.sha256(texts[part[0]]).hexdigest())
        return out

    schema = "members array<struct<doc_id: long, row: long, chars: long>>, sha string, rest binary"
    few = texts.select("doc_id", "row", text_bytes())
    return arrow_map(few, rows, schema, block=1 << 20).withColumn("rep", F.monotonically_increasing_id())


def _common(least: pd.Series, most: pd.Series) -> pd.Series:
    return pd.Series([-1 if a == b else len(commonprefix([a, b])) for a, b in zip(least, most, strict=True)], dtype="int64")


def _ends(group: str, active: DataFrame) -> DataFrame:
    """Each group's length of what its texts have in common; -1 if they are all the same."""
    bounds = active.groupBy(group).agg(F.min("rest").alias("least"), F.max("rest").alias("most"))
    return bounds.select(group, F.pandas_udf(_common, "long")("least", "most").alias("at"))


def _leaves(active: DataFrame) -> DataFrame:
    """(rep, class) for the texts of whole groups (grp, digit) that equal another one, group by group in tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list[pa.RecordBatch] = []

        def classes(table: pa.Table) -> pa.RecordBatch:
            reps, texts = table.column("rep").to_numpy(), table.column("rest").to_pylist()
            keys = list(zip(table.column("grp").to_pylist(), table.column("digit").to_pylist(), strict=True))
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            rep, first = [], []
            for a, b in zip(cuts, cuts[1:], strict=False):
                for part in radix_classes(texts[a:b]) if b - a > 1 else ():
                    if len(part) > 1:
                        found = reps[a + np.array(part)]
                        rep.extend(found.tolist())
                        first.extend([int(found.min())] * len(part))
            return pa.RecordBatch.from_arrays([pa.array(rep, pa.int64()), pa.array(first, pa.int64())], names=["rep", "class"])

        for batch in batches:
            if not batch.num_rows:
                continue
            open_.append(batch)
            # rows arrive sorted by group; the last group of a batch may go on in the next one
            last = (batch.column("grp")[-1], batch.column("digit")[-1])
            if (open_[0].column("grp")[0], open_[0].column("digit")[0]) == last:
                continue
            table = pa.Table.from_batches(open_)
            at = table.num_rows - 1
            while (table.column("grp")[at - 1], table.column("digit")[at - 1]) == last:
                at -= 1
            yield classes(table.slice(0, at))
            open_ = table.slice(at).to_batches()
        if open_:
            yield classes(pa.Table.from_batches(open_))

    dealt = active.select("grp", "digit", "rep", "rest").repartition("grp", "digit").sortWithinPartitions("grp", "digit")
    return dealt.mapInArrow(run, "rep long, class long")


def _classes(reps: DataFrame, scratch: Scratch, digit: int, most_bytes: int, most_texts: int) -> DataFrame:
    """(rep, class) for every representative whose text equals that of another one.

    A round sums the bytes and texts of each digit's group.  The groups above the bounds, at most
    all bytes over *most_bytes* and all texts over *most_texts* of them, are joined back; their
    texts go to a table for the next round, all the others through one shuffle to the tasks that
    finish them.
    """
    # what all texts of a group have in common is skipped; at first that is not known
    active, k, found = reps.select("rep", "rest", F.lit(0).cast("long").alias("grp"), F.lit(0).cast("long").alias("at")), 0, []
    while True:
        cut = active.withColumn("digit", F.expr(f"substring(rest, cast(at as int) + 1, {min(digit << k, 1 << 30)})"))
        groups = cut.groupBy("grp", "digit").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("rest")).alias("size"), F.min("rep").alias("next"))
        large = scratch.write(groups.where((F.col("n") > 1) & ((F.col("n") > most_texts) | (F.col("size") > most_bytes))).select("grp", "digit", "next"), f"large{k}")
        found.append(scratch.write(_leaves(cut.join(large, ["grp", "digit"], "left_anti")), f"classes{k}"))
        inside = scratch.write(cut.join(large, ["grp", "digit"]).select("rep", "rest", F.col("next").alias("grp")), f"inside{k}")
        ends = scratch.write(_ends("grp", inside), f"ends{k}")
        found.append(scratch.write(inside.select("rep", "grp").join(ends.where("at < 0"), "grp").select("rep", F.col("grp").alias("class")), f"ended{k}"))
        active = scratch.write(inside.join(ends.where("at >= 0"), "grp").select("rep", "rest", "grp", "at"), f"active{k + 1}")
        scratch.drop(f"large{k}", f"inside{k}", f"ends{k}", f"active{k}")
        if active.isEmpty():
            break
        k += 1  # the texts' length bounds the rounds, since each tells a group's texts apart
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def _verdicts(texts: DataFrame, scratch: Scratch, digit: int, most_bytes: int, most_texts: int) -> DataFrame:
    """doc_id, row, keep_id, group_size, kept, text_sha256 for rows of doc_id, row and text."""
    reps = scratch.write(_representatives(texts), "reps")
    found = _classes(reps.select("rep", "rest"), scratch, digit, most_bytes, most_texts)
    # the best row is the smallest (minus code points, doc_id is null, doc_id, representative, place)
    order = F.transform(
        "members",
        lambda m, i: F.struct((-m["chars"]).alias("less"), m["doc_id"].isNull().alias("none"), m["doc_id"].alias("id"), F.col("rep"), i.alias("place")),
    )
    slim = reps.select("rep", "sha", "members", F.array_min(order).alias("best"), F.size("members").cast("long").alias("size"))
    # only what a class sums and what it answers is keyed by class; members meet it by their representative
    shares = scratch.write(found.join(slim.select("rep", "best", "size"), "rep"), "shares")
    totals = shares.groupBy("class").agg(F.min("best").alias("keep"), F.sum("size").alias("group_size"))
    salted = totals.withColumn("salt", F.explode(F.array([F.lit(i) for i in range(SALTS)])))
    answers = shares.select("rep", "class", F.pmod(F.xxhash64("rep"), F.lit(SALTS)).cast("int").alias("salt")).join(salted, ["class", "salt"])
    answers = scratch.write(answers.select("rep", "keep", "group_size"), "answers")
    scratch.drop("shares")
    answered = slim.join(answers, "rep", "left").withColumn("keep", F.coalesce("keep", "best")).withColumn("group_size", F.coalesce("group_size", "size"))
    return answered.select("rep", "keep", "group_size", "sha", F.posexplode("members").alias("place", "m")).select(
        F.col("m.doc_id").alias("doc_id"),
        F.col("m.row").alias("row"),
        F.col("keep.id").alias("keep_id"),
        "group_size",
        ((F.col("rep") == F.col("keep.rep")) & (F.col("place") == F.col("keep.place"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def exact_groups(docs: DataFrame, digit: int = DIGIT, most_bytes: int = MOST_BYTES, most_texts: int = MOST_TEXTS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of *docs* (doc_id, text).

    Texts are equal when identical without ASCII white space; a null text is empty, and
    empty texts equal each other.  Of equal texts the row with the most code points in the
    original text, then the smallest doc_id (null last) stays.  Repeated rows with one doc_id
    each get a row and count in ``group_size``; exactly one row of a group is ``kept``.  An
    empty table gives an empty result.
    """
    texts = docs.select(F.col("doc_id").cast("long"), F.lit(None).cast("long").alias("row"), "text")
    return _verdicts(texts, Scratch(docs.sparkSession, "exact"), digit, most_bytes, most_texts).drop("row")


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of *docs*, all columns, that ``exact_groups`` keeps: one row of each class of
    equal texts, also where rows have no doc_id or share one.
    """
    scratch = Scratch(docs.sparkSession, "exact")
    keyed = Keyed(docs, scratch)
    return keyed.without(_verdicts(keyed.texts(), scratch, DIGIT, MOST_BYTES, MOST_TEXTS).where("not kept").select("doc_id", "row"))
