"""Language-model scores by a hidden Markov model over words.

Training is Baum-Welch over all training documents: each partition runs forward-backward over
its whole texts with the current parameters and sends its expected counts, which are summed by
symbol in a shuffle; the driver gets one row a symbol.  A state emits the end of the text or a
word's symbol, a hash; a word has its smoothed share of its symbol's training tokens, so every
word has a probability under every state.  There are as many symbols as leave at least two
distinct training words to each, so few are unseen, and 65 536 at most.  Scoring is the exact scaled forward recursion over whole texts.

What grows with the corpus, the word counts, stays distributed: the counts of a bounded
number of frequent words are broadcast, which saves their tokens a join and changes no result;
other words meet theirs in a join by word, none of which can be frequent.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import Scratch, arrow_map, lower_words, text_bytes

#: Symbols that states emit, at least and at most: the end of a text (0) and hashes of words.
SYMBOLS = (16, 1 << 16)
#: Words whose counts are broadcast; the others' are joined.
COUNTED = 200_000
#: Tokens that the recursions hold at a time; texts above it are cut for memory, with their messages carried over the cuts.
BATCH, PIECE = 1 << 19, 1 << 12
#: Steps between two scalings of the recursions.
RESCALE = 4
_END = b""  # no word is empty


def word_symbol(word: bytes, symbols: int) -> int:
    return 1 + zlib.crc32(word) % (symbols - 1)


def symbol_number(distinct: int) -> int:
    """A power of two, at most half the number of distinct words, within the bounds."""
    return min(SYMBOLS[1], max(SYMBOLS[0], 1 << max(0, distinct.bit_length() - 2)))


def training_rows(docs: DataFrame) -> DataFrame:
    """row-wise doc_id, text (bytes, null: empty) and held_out: crc32 of doc_id's text mod 7 is 2."""
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2
    return docs.select(F.col("doc_id").cast("long"), text_bytes(), held.alias("held_out"))


def token_counts(rows: DataFrame) -> DataFrame:
    """(word, n) over the training rows' tokens; the end of a text is the empty word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            made = [pa.array(list(counts), pa.binary()), pa.array(counts.values(), pa.int64())]
            counts.clear()
            return pa.RecordBatch.from_arrays(made, names=["word", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(lower_words(text))
                counts[_END] += 1
            if len(counts) > 400_000:
                yield flush()
        if counts:
            yield flush()

    partial = rows.where("not held_out").select("text").mapInArrow(count, "word binary, n long")
    return partial.groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Lexicon:
    """The frequent words, the totals of the training tokens and of each symbol; bounded by ``counted``."""

    words: list[bytes]
    counts: np.ndarray
    total: int
    distinct: int
    end_count: int
    symbol_tokens: np.ndarray
    symbol_words: np.ndarray

    def share_logs(self) -> np.ndarray:
        """log10 of what (c + 1) is divided by to give a word's share of its symbol; 0 for the end."""
        logs = np.log10(self.symbol_tokens + self.symbol_words + 1.0)
        logs[0] = 0.0
        return logs


def lexicon(counts: DataFrame, counted: int = COUNTED) -> Lexicon:
    words = counts.where(F.octet_length("word") > 0)
    top = words.orderBy(F.col("n").desc(), "word").limit(counted).select("word", "n").toArrow()
    number = symbol_number(counts.count())
    tokens, types = np.zeros(number), np.zeros(number)
    symbol = F.when(F.octet_length("word") == 0, F.lit(0)).otherwise(1 + F.crc32("word") % (number - 1)).cast("int")
    # one row a symbol
    by_symbol = counts.groupBy(symbol.alias("symbol")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words")).toArrow()
    at = by_symbol.column("symbol").to_numpy()
    tokens[at], types[at] = by_symbol.column("n").to_numpy(), by_symbol.column("words").to_numpy()
    return Lexicon(top.column("word").to_pylist(), top.column("n").to_numpy(), int(tokens.sum()), int(types.sum()), int(tokens[0]), tokens, types)


def encode(rows: DataFrame, lex: Lexicon) -> DataFrame:
    """doc_id, held_out, ids (symbols as 16-bit numbers, the end last), n_tokens, n_known, log_counts, rare.

    ``log_counts`` sums log10(c + 1) over the words whose counts are broadcast; ``rare`` lists
    the other words, repeated ones too.
    """
    shipped = rows.sparkSession.sparkContext.broadcast(lex)  # at most `counted` words

    def run(c: dict[str, list]) -> dict[str, list]:
        lex = shipped.value
        known, symbols = _places(lex)
        logs, crc, number = np.log10(lex.counts + 1.0), zlib.crc32, len(lex.symbol_tokens)
        out: dict[str, list] = {n: [] for n in ("ids", "n_tokens", "n_known", "log_counts", "rare")}
        for text in c["text"]:
            words = lower_words(text)
            at = np.fromiter(map(known.get, words, repeat(-1)), np.int64, len(words))
            ids = np.zeros(len(words) + 1, "<u2")
            ids[:-1] = symbols[at]
            others = np.flatnonzero(at < 0)
            rare = [words[i] for i in others.tolist()]
            ids[others] = [1 + crc(w) % (number - 1) for w in rare]
            counted = at[at >= 0]
            out["ids"].append(ids.tobytes())
            out["n_tokens"].append(len(ids))
            out["n_known"].append(len(counted) + (lex.end_count > 0))
            out["log_counts"].append(float(logs[counted].sum()))
            out["rare"].append(rare)
        return {"doc_id": c["doc_id"], "held_out": c["held_out"]} | out

    schema = "doc_id long, held_out boolean, ids binary, n_tokens long, n_known long, log_counts double, rare array<binary>"
    return arrow_map(rows, run, schema).withColumn("row", F.monotonically_increasing_id())


_PLACES: dict[int, tuple[Lexicon, dict[bytes, int], np.ndarray]] = {}


def _places(lex: Lexicon) -> tuple[dict[bytes, int], np.ndarray]:
    held = _PLACES.get(0)
    if held is None or held[0] is not lex:
        symbols = np.array([*(word_symbol(w, len(lex.symbol_tokens)) for w in lex.words), 0], "<u2")
        held = _PLACES[0] = (lex, {w: i for i, w in enumerate(lex.words)}, symbols)
    return held[1], held[2]


@dataclass
class Model:
    """start (K), move (K, K) and emit (symbols, K), each row of a state a distribution."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def first_model(lex: Lexicon, states: int, seed: int = 7, spread: float = 1.0, stay: float = 0.95) -> Model:
    """Unigram emissions, tilted at random for each state so that states can part; states that last."""
    rng = np.random.default_rng(seed)
    unigram = lex.symbol_tokens + 1.0
    emit = unigram[:, None] * np.exp(spread * rng.standard_normal((len(unigram), states)))
    move = np.full((states, states), (1 - stay) / max(1, states - 1))
    np.fill_diagonal(move, stay if states > 1 else 1.0)
    return Model(np.full(states, 1 / states), move, emit / emit.sum(0))


def _scaled_emissions(model: Model, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Emissions with a largest value of 1 a symbol, and what they were divided by."""
    most = model.emit.max(1)
    return (model.emit / most[:, None]).astype(kind), most


class _Steps:
    """Sequences as steps: the longest first, each step the sequences that still run, one after the other."""

    def __init__(self, offsets: np.ndarray) -> None:
        lengths = np.diff(offsets)
        self.order = np.argsort(-lengths, kind="stable")
        self.lengths = lengths[self.order]
        self.begin = offsets[:-1][self.order]
        steps = int(self.lengths[0]) if len(lengths) else 0
        self.active = np.searchsorted(-self.lengths, -np.arange(steps), side="left")  # lengths > t
        self.starts = np.concatenate([[0], np.cumsum(self.active)])

    def symbols(self, ids: np.ndarray, since: int, until: int) -> np.ndarray:
        """The symbols of the steps in [since, until), in their order."""
        n, starts = self.active[since:until], self.starts[since:until]
        sequence = np.arange(starts[0], self.starts[until]) - np.repeat(starts, n)
        return np.take(ids, np.take(self.begin, sequence) + np.repeat(np.arange(since, until), n)).astype(np.intp)


def expected_counts(model: Model, emit: np.ndarray, ids: np.ndarray, offsets: np.ndarray, before: np.ndarray | None = None, after: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected starts, moves and emissions over non-empty sequences, by forward-backward in parallel.

    *emit* are scaled emissions: the scales of the recursions are free, since each token's
    posterior is divided by its own sum.  A sequence that continues another one has the forward
    message at that one's last token in *before* (rows of zeros: a text starts here); *after*
    are the backward messages at the last tokens (ones at the end of a text).
    """
    states = len(model.start)
    move, one = model.move.astype(np.float32), np.ones(states, np.float32)
    s = _Steps(offsets)
    n0 = len(s.order)
    if not n0:
        return np.zeros(states), np.zeros((states, states)), np.zeros(model.emit.shape)
    symbols = s.symbols(ids, 0, len(s.active))
    x = np.take(emit, symbols, 0)  # emissions, then forward messages
    ends = x.copy()  # emissions, then emissions times backward messages
    p = np.empty_like(x)  # messages from the token before, then posteriors
    first = np.zeros((n0, states), np.float32) if before is None else before[s.order].astype(np.float32)
    fresh = ~first.any(1)
    np.matmul(first, move, out=p[:n0])
    p[:n0][fresh] = model.start
    x[:n0] *= p[:n0]
    if after is not None:
        ends[s.starts[s.lengths - 1] + np.arange(n0)] *= after[s.order].astype(np.float32)
    starts, active = s.starts.tolist(), s.active.tolist()
    was = slice(0, n0)
    for t in range(1, len(active)):
        n, at = active[t], starts[t]
        prior = p[at : at + n]
        np.matmul(x[was][:n], move, out=prior)
        was = slice(at, at + n)
        now = x[was]
        now *= prior
        if not t % RESCALE:
            now /= (now @ one)[:, None]
    back = np.ascontiguousarray(move.T)
    for t in range(len(active) - 2, -1, -1):
        n, at, then = active[t + 1], starts[t], starts[t + 1]
        now = ends[at : at + n]
        now *= ends[then : then + n] @ back
        if not t % RESCALE:
            now /= (now @ one)[:, None]
    p *= ends
    scale = 1.0 / (p @ one)
    ends *= scale[:, None]
    moves = first.T @ ends[:n0]
    if len(ends) > n0:
        earlier = np.arange(n0, len(ends)) - np.repeat(s.active[:-1], s.active[1:])
        moves += np.take(x, earlier, 0).T @ ends[n0:]
    weight = np.empty(len(p))
    emits = np.empty((states, len(emit)))
    for k in range(states):
        np.multiply(p[:, k], scale, out=weight)
        emits[k] = np.bincount(symbols, weight, len(emit))
    return (p[:n0] * scale[:n0, None])[fresh].sum(0, dtype=float), moves * model.move, emits.T


def _pieces(model: Model, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A long sequence cut for memory: offsets of its pieces and the exact messages at the cuts."""
    emit, _ = _scaled_emissions(model, float)
    offsets = np.append(np.arange(0, len(ids), PIECE), len(ids))
    before, after = np.zeros((len(offsets) - 1, len(model.start))), np.ones((len(offsets) - 1, len(model.start)))
    a = model.start * emit[ids[0]]
    for t in range(1, len(ids)):
        if t % PIECE == 0:
            before[t // PIECE] = a
        a = (a @ model.move) * emit[ids[t]]
        a /= a.sum()
    b = np.ones(len(model.start))
    for t in range(len(ids) - 1, 0, -1):
        b = model.move @ (emit[ids[t]] * b)
        b /= b.sum()
        if t % PIECE == 0:
            after[t // PIECE - 1] = b
    return offsets, before, after


def _batches(offsets: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Sequences in groups of like lengths with at most *size* tokens, or of one sequence."""
    lengths = np.diff(offsets)
    order = np.argsort(lengths, kind="stable")
    at, ends = 0, np.cumsum(lengths[order])
    while at < len(order):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right")))
        yield order[at:end]
        at = end


def _gather(ids: np.ndarray, offsets: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The chosen sequences one after the other."""
    return np.concatenate([ids[offsets[i] : offsets[i + 1]] for i in chosen]), np.concatenate([[0], np.cumsum(np.diff(offsets)[chosen])])


def log_likelihoods(model: Model, ids: np.ndarray, offsets: np.ndarray, size: int = BATCH) -> np.ndarray:
    """log10 probability of every non-empty sequence, by the scaled forward recursion in parallel, a window of steps at a time."""
    emit, most = _scaled_emissions(model, float)
    one = np.ones(len(model.start))
    s = _Steps(offsets)
    out = np.add.reduceat(np.take(np.log10(most), ids), offsets[:-1])[s.order] if len(s.order) else np.zeros(0)
    alpha = np.empty((0, len(model.start)))
    t, starts, active = 0, s.starts, s.active
    while t < len(active):
        until = max(t + 1, int(np.searchsorted(starts, starts[t] + size, side="right")) - 1)
        n = active[t:until]
        symbols = s.symbols(ids, t, until)
        x, was = np.take(emit, symbols, 0), 0
        for k, m in enumerate(n.tolist()):
            at = int(starts[t + k] - starts[t])
            now = x[at : at + m]
            if t + k == 0:
                now *= model.start
            else:
                now *= (alpha if k == 0 else x[was : was + m])[:m] @ model.move
            if (t + k) % RESCALE == 0:
                scale = now @ one
                now /= scale[:, None]
                out[:m] += np.log10(scale)
            was = at
        done = np.flatnonzero(s.lengths[: n[0]] <= until)
        last = starts[s.lengths[done] - 1] - starts[t] + done
        out[done] += np.log10(x[last].sum(1))
        alpha = x[was : was + n[-1]].copy()
        t = until
    back = np.empty_like(out)
    back[s.order] = out
    return back


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a binary column of 16-bit numbers, and the rows' offsets."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    width = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data.view("<u2"), (offsets - offsets[0]) // 2


def counts_of(model: Model, ids: np.ndarray, offsets: np.ndarray, size: int = BATCH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``expected_counts`` of any number of sequences of any length, a batch at a time."""
    states = len(model.start)
    sums = (np.zeros(states), np.zeros((states, states)), np.zeros(model.emit.shape))
    emit, _ = _scaled_emissions(model, np.float32)
    for chosen in _batches(offsets, size):
        part, cut = _gather(ids, offsets, chosen)
        before = after = None
        if len(part) > size:  # one text
            cut, before, after = _pieces(model, part)
        for at in range(0, len(cut) - 1, max(1, size // PIECE)) if before is not None else (0,):
            end = min(len(cut) - 1, at + size // PIECE) if before is not None else len(cut) - 1
            got = expected_counts(model, emit, part[cut[at] : cut[end]], cut[at : end + 1] - cut[at], None if before is None else before[at:end], None if after is None else after[at:end])
            for s, p in zip(sums, got, strict=True):
                s += p
    return sums


def baum_welch(tokens: DataFrame, lex: Lexicon, states: int, rounds: int, prior: float | None = None) -> Model:
    """Train on the rows of *tokens* that are not held out: one distributed E-step a round.

    A round's shuffle carries at most a row for each symbol and task; the driver gets the sums,
    one row a symbol and state and one more.  *prior* tokens a state follow the unigram distribution;
    without it, one for each distinct word and all states together.
    """
    prior = lex.distinct / states if prior is None else prior
    context = tokens.sparkSession.sparkContext
    model = first_model(lex, states)
    unigram = (lex.symbol_tokens + 1.0) / (lex.symbol_tokens + 1.0).sum()
    names = [f"s{k}" for k in range(states)]

    for _ in range(rounds):
        shipped = context.broadcast(model)

        def e_step(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            sums = None
            for batch in batches:
                if batch.num_rows:
                    part = counts_of(shipped.value, *_flat(batch.column(0)))
                    sums = part if sums is None else tuple(s + p for s, p in zip(sums, part, strict=True))
            if sums is not None:
                used = np.flatnonzero(sums[2].any(1))
                rows = np.concatenate([sums[0][None], sums[1], sums[2][used]]).astype(np.float32)
                keys = np.concatenate([np.arange(-1 - states, 0), used]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(keys), *(pa.array(rows[:, k]) for k in range(states))], names=["symbol", *names])

        sent = tokens.where("not held_out").select("ids").mapInArrow(e_step, "symbol int, " + ", ".join(f"{n} float" for n in names))
        got = sent.groupBy("symbol").agg(*(F.sum(n).alias(n) for n in names)).toArrow()
        shipped.destroy()
        if not got.num_rows:
            return model
        keys = got.column("symbol").to_numpy()
        rows = np.stack([got.column(n).to_numpy() for n in names], 1)
        emit = unigram[:, None] * prior + np.zeros((len(unigram), states))
        emit[keys[keys >= 0]] += rows[keys >= 0]
        special = rows[keys < 0][np.argsort(keys[keys < 0])]
        start, move = special[0] + 1.0, special[1:] + 0.1
        model = Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))
    return model


def train(docs: DataFrame, scratch: Scratch, states: int = 8, rounds: int = 8, counted: int = COUNTED) -> tuple[DataFrame, Lexicon, DataFrame, Model]:
    """The tables of word counts and of encoded texts, the lexicon and the model."""
    rows = training_rows(docs)
    counts = scratch.write(token_counts(rows), "counts")
    lex = lexicon(counts, counted)
    tokens = scratch.write(encode(rows, lex), "tokens")
    return counts, lex, tokens, baum_welch(tokens, lex, states, rounds)


def score(docs: DataFrame, states: int = 8, rounds: int = 8, counted: int = COUNTED) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of *docs*.

    A null text is empty and has one token, its end.  A null doc_id trains.  Repeated rows each
    train and get a row.  With nothing to train on every token is unknown: its base term is
    log10(1), and the model's emissions are those it began with.
    """
    counts, lex, tokens, model = train(docs, Scratch(docs.sparkSession, "hmm"), states, rounds, counted)
    # words beyond the broadcast counts: every one is rarer than `counted` others, so no key is hot
    rare = tokens.select("row", F.explode("rare").alias("word"))
    known = counts.select("word", F.col("n").alias("c"))
    terms = rare.join(known, "word").groupBy("row").agg(F.sum(F.log10(F.col("c") + 1.0)).alias("rare_logs"), F.count(F.lit(1)).alias("rare_known"))
    shipped = docs.sparkSession.sparkContext.broadcast((model, lex.share_logs()))

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, share_logs = shipped.value
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, offsets = _flat(batch.column(0))
            logs = np.empty(batch.num_rows)
            for chosen in _batches(offsets, BATCH):
                part, cut = _gather(ids, offsets, chosen)
                logs[chosen] = log_likelihoods(model, part, cut) - np.add.reduceat(share_logs[part], cut[:-1])
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(logs)], names=[*batch.schema.names[1:], "log"])

    few = tokens.select("ids", "row", "doc_id", "held_out", "n_tokens", "n_known", "log_counts")
    schema = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, log_counts double, log double"
    scored = few.mapInArrow(forward, schema).join(terms, "row", "left")
    logs = F.col("log_counts") + F.coalesce("rare_logs", F.lit(0.0))
    end, denominator = float(np.log10(lex.end_count + 1.0)), float(np.log10(lex.total + lex.distinct + 1.0))
    return scored.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(lex.total).cast("long").alias("train_tokens"),
        (logs + end - F.col("n_tokens") * denominator).alias("base_score"),
        (F.col("log") + logs).alias("score"),
    )
