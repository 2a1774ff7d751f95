"""Byte-level BPE, token counts, packing, language model."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from skyloom.llm import bpe, hmm_lm, packing, queries, token_counts
from skyloom.llm.common import Scratch
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.01"
RANKS = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def encoder():
    with open(RANKS, "rb") as f:
        return bpe.PrefixEncoder(bpe.read_ranks(f.read()), P.PATTERN)


@pytest.fixture(scope="module")
def library(encoder):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=encoder.ranks, special_tokens={})


MIXED = st.text(st.sampled_from(list("abcdeé ñ\n\t\x1c\x85   　'tslrvm123!!--==日本ßẞİΣ🙂<|>")), max_size=60)


@settings(max_examples=300, deadline=None)
@given(MIXED | st.text(max_size=40))
def test_encoding_equals_the_library(encoder, library, text):
    ids = encoder.encode(text)
    assert ids == library.encode_ordinary(text)
    assert encoder.decode(ids) == text.encode()


@settings(max_examples=100, deadline=None)
@given(st.binary(min_size=1, max_size=60), st.data())
def test_appends_and_edits(encoder, data, more):
    data = bytes(97 + b % 12 for b in data)
    table = encoder.table(data[:7])
    table.append(data[7:])
    assert table.encode() == encoder.merge(data)
    at = more.draw(st.integers(0, len(data)))
    n, new = more.draw(st.integers(0, 6)), bytes(97 + b % 12 for b in more.draw(st.binary(max_size=5)))
    table.replace(at, n, new)
    assert table.data == data[:at] + new + data[at + n :] and table.encode() == encoder.merge(table.data)


def test_edit_of_a_long_piece_stops_early(encoder):
    rng = random.Random(3)
    table = encoder.table(bytes(rng.choice(b"aeinrst") for _ in range(4000)))
    assert table.replace(2000, 1, b"q") < 200


def test_bpe_query(spark, documents, empty, library, encoder):
    texts = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    got = queries.op10_bpe(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode_ordinary(texts[r.doc_id] or "")
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
    ids = bpe.encode_documents(documents, RANKS, P.PATTERN)
    back = bpe.decode_documents(ids, RANKS).collect()
    assert sorted(bytes(r.data) for r in back) == sorted((r.text or "").encode() for r in documents.collect())
    assert bpe.encode_documents(empty, RANKS, P.PATTERN).count() == 0


def test_histogram_answers(spark, documents, empty):
    ranks = P.path("byte_bpe_50k.tiktoken")
    with open(ranks, "rb") as f:
        e = tiktoken.Encoding("x", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(f.read()), special_tokens={})
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = [len(e.encode_ordinary(r.text or "")) for r in docs.collect()]
    sums = token_counts.suffix_sums(token_counts.histogram(token_counts.token_lengths(docs, ranks, P.PATTERN))).cache()
    rows = sums.collect()
    assert {r.n_tokens: r.n_docs for r in rows} == dict(Counter(n))
    for r in rows:
        assert r.docs_at_least == sum(x >= r.n_tokens for x in n) and r.tokens_at_least == sum(x for x in n if x >= r.n_tokens)
        assert r.truncated_tokens == sum(min(x, r.n_tokens) for x in n) and r.docs_up_to == sum(x <= r.n_tokens for x in n)
    for limit in (0, 1, 77, 512, 4096, 10**7):
        assert token_counts.truncated_total(sums, limit).first()[0] == sum(min(x, limit) for x in n)
    assert token_counts.quantile(sums, 0.5).first()[0] == sorted(n)[math.ceil(len(n) / 2) - 1]
    none = token_counts.suffix_sums(token_counts.histogram(token_counts.token_lengths(empty, ranks, P.PATTERN)))
    assert none.count() == 0 and token_counts.truncated_total(none, 5).first()[0] == 0
    odd = token_counts.histogram(token_counts.token_lengths(documents, ranks, P.PATTERN)).collect()
    assert sum(r.n_docs for r in odd) == 12 and {r.n_tokens: r.n_docs for r in odd}[0] == 2


WORDS = P.path("word_bpe_49k.json")


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(list("abcdeé ñ\n\t\x1c\x85 　'tsll123!!--=日本ßẞİΣÁ🙂<|endoftext|>")), max_size=50))
def test_word_tokenizer_equals_the_library(text):
    global _PAIR
    try:
        own, whole = _PAIR
    except NameError:
        with open(WORDS, encoding="utf-8") as f:
            own = packing.WordTokenizer(f.read())
        whole = Tokenizer.from_file(WORDS)
        whole.encode_special_tokens = True
        _PAIR = own, whole
    assert own.ids(text).tolist() == whole.encode(text, add_special_tokens=False).ids


@given(st.integers(1, 20_000), st.sampled_from([0, 32, 64]))
def test_cut_lengths(n, slack):
    cut = packing.cut_lengths(n, 4096, slack)
    assert sum(cut) == n and all(1 <= c <= 4096 for c in cut)


def check_pieces(rows, ids_of, most_padding):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for doc, ids in ids_of.items():
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    padding = 0
    for s in by_sequence.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    assert padding <= most_padding


def test_packing(spark, documents, empty):
    whole = Tokenizer.from_file(WORDS)
    whole.encode_special_tokens = True
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids_of = {r.doc_id: [*whole.encode(r.text or "", add_special_tokens=False).ids, 2] for r in docs.collect()}
    got = packing.pack(docs, WORDS).collect()
    check_pieces(got, ids_of, 0.02 * sum(map(len, ids_of.values())))
    odd = packing.pack(documents, WORDS).collect()
    assert sum(r.length for r in odd) == sum(len(whole.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in documents.collect())
    assert packing.pack(empty, WORDS).count() == 0


def test_full_bins_hold_a_fixed_number(spark):
    docs = spark.createDataFrame([(i, "a " * (1364 if i % 2 else 700)) for i in range(400)], "doc_id long, text string")
    rows = packing.pack(docs, WORDS).collect()
    sizes = Counter(r.sequence_id for r in rows if r.length == 1365)
    assert set(sizes.values()) <= {3} | {v for k, v in sizes.items() if k < 1 << 40}


def paths_of(model, ids):
    """All state paths of a sequence and their probabilities together with it."""
    k = len(model.start)
    paths = np.stack(np.meshgrid(*[range(k)] * len(ids), indexing="ij"), -1).reshape(-1, len(ids))
    p = model.start[paths[:, 0]] * model.emit[ids[0], paths[:, 0]]
    for t in range(1, len(ids)):
        p = p * model.move[paths[:, t - 1], paths[:, t]] * model.emit[ids[t], paths[:, t]]
    return paths, p


@pytest.mark.parametrize("size, piece", [(1 << 19, 1 << 12), (3, 2), (3, 1), (5, 4)])
def test_forward_and_expected_counts_against_enumeration(monkeypatch, size, piece):
    """Sequences are run in one batch, in several, and cut with their messages carried over."""
    rng = np.random.default_rng(5)
    k, v = 3, 5
    norm = lambda a, ax: a / a.sum(ax, keepdims=True)
    model = hmm_lm.Model(norm(rng.random(k), 0), norm(rng.random((k, k)), 1), norm(rng.random((v, k)), 0))
    seqs = [rng.integers(0, v, n) for n in (1, 4, 2, 6, 4, 9)]
    ids, offsets = np.concatenate(seqs).astype("<u2"), np.concatenate([[0], np.cumsum([len(s) for s in seqs])])
    assert np.allclose(hmm_lm.log_likelihoods(model, ids, offsets, size), [math.log10(paths_of(model, s)[1].sum()) for s in seqs])
    starts, moves, emits = np.zeros(k), np.zeros((k, k)), np.zeros((v, k))
    for s in seqs:
        paths, p = paths_of(model, s)
        p = p / p.sum()
        np.add.at(starts, paths[:, 0], p)
        for t in range(len(s)):
            np.add.at(emits[s[t]], paths[:, t], p)
            if t:
                np.add.at(moves, (paths[:, t - 1], paths[:, t]), p)
    monkeypatch.setattr(hmm_lm, "PIECE", piece)
    got = hmm_lm.counts_of(model, ids, offsets, size)
    assert all(np.allclose(a, b, atol=1e-4) for a, b in zip(got, (starts, moves, emits), strict=True))


def test_number_of_symbols():
    assert [hmm_lm.symbol_number(n) for n in (0, 1, 30, 64, 127, 128, 10**5, 10**9)] == [16, 16, 16, 32, 32, 64, 32768, 65536]


def test_long_sequences_do_not_underflow():
    rng = np.random.default_rng(8)
    emit = np.full((4, 2), 1e-7)
    emit[0], emit[1] = (1.0, 1e-7), (1e-7, 1.0)
    model = hmm_lm.Model(np.array([0.5, 0.5]), np.array([[0.999, 0.001], [0.001, 0.999]]), emit / emit.sum(0))
    ids, offsets = rng.integers(0, 4, 5000).astype("<u2"), np.array([0, 4000, 4010, 5000])
    assert np.isfinite(hmm_lm.log_likelihoods(model, ids, offsets)).all()
    starts, moves, emits = hmm_lm.counts_of(model, ids, offsets)
    assert math.isclose(starts.sum(), 3, rel_tol=1e-4) and math.isclose(moves.sum(), 4997, rel_tol=1e-4) and math.isclose(emits.sum(), 5000, rel_tol=1e-4)


def test_language_model_scores(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, (r.text or "").encode().lower().split() + [b""]) for r in docs.collect()]
    counts = Counter(w for i, ws in rows if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    n, v = sum(counts.values()), len(counts)
    # a small broadcast bound, so that the join by word takes part
    got = {r.doc_id: r for r in hmm_lm.score(docs, states=4, rounds=3, counted=900).collect()}
    all_rows = {r.doc_id: r for r in hmm_lm.score(docs, states=4, rounds=3).collect()}
    for i, ws in rows:
        r = got[i]
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws)
        assert r.held_out == (zlib.crc32(str(i).encode()) % 7 == 2) and r.n_tokens == len(ws) and r.train_tokens == n
        assert r.n_known == sum(counts[w] > 0 for w in ws) and math.isclose(r.base_score, base, rel_tol=1e-9, abs_tol=1e-9)
        assert math.isclose(r.score, all_rows[i].score, rel_tol=1e-5)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_score_is_the_sum_over_all_paths(spark):
    """The score column against enumeration of the state paths with the words' own probabilities."""
    texts = ["a b c", "b c", "a a b", "", "c zz a", "d", "a b", "c c", "b b a d", "x y", "a c", None, "b a", "q"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    words = [(t or "").encode().split() + [b""] for t in texts]
    counts = Counter(w for i, ws in enumerate(words) if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    _, lex, _, model = hmm_lm.train(docs, Scratch(spark, "t"), states=2, rounds=2)
    symbol = lambda w: hmm_lm.word_symbol(w, len(lex.symbol_tokens)) if w else 0
    in_symbol, kinds = Counter(), Counter()
    for w, c in counts.items():
        in_symbol[symbol(w)] += c
        kinds[symbol(w)] += 1
    share = lambda w: (counts[w] + 1) / (in_symbol[symbol(w)] + kinds[symbol(w)] + 1) if w else 1.0
    got = {r.doc_id: r for r in hmm_lm.score(docs, states=2, rounds=2, counted=3).collect()}
    # every state gives all words, known or not, at most probability one together
    assert np.allclose(model.emit.sum(0), 1) and np.allclose(model.move.sum(1), 1) and (model.emit > 0).all()
    for i, ws in enumerate(words):
        want = paths_of(model, [symbol(w) for w in ws])[1].sum() * math.prod(map(share, ws))
        assert math.isclose(got[i].score, math.log10(want), rel_tol=1e-4), i


def test_language_model_odd_rows(documents, empty):
    got = hmm_lm.score(documents, states=2, rounds=1).collect()
    assert len(got) == 12 and all(r.n_tokens == 1 for r in got if r.doc_id in (4, 5, 6))
    assert hmm_lm.score(empty, states=2, rounds=1).count() == 0
    only = documents.where("crc32(cast(cast(doc_id as string) as binary)) % 7 = 2")
    assert all(r.n_known == 0 and r.base_score == 0 and math.isfinite(r.score) for r in hmm_lm.score(only, states=2, rounds=1).collect())
