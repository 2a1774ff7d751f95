"""Exact and near deduplication, components."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from skyloom.llm import components, exact_dedup, simhash_dedup, similar_texts
from skyloom.llm.common import Scratch

SF = "/root/testdata/sf0.01"


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def brute_exact(rows):
    best = {}
    for i, t in rows:
        k = (-len(t or ""), i is None, i or 0)
        n, b = best.get(norm(t), (0, k))
        best[norm(t)] = (n + 1, min(b, k))
    return best


def check_exact(rows, got):
    best = brute_exact(rows)
    assert len(got) == len(rows)
    digest = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in best.items()}
    kept = {}
    for r in got:
        n, (_, none, keep) = digest[r.text_sha256]
        assert r.group_size == n and (r.keep_id is None if none else r.keep_id == keep)
        kept[r.text_sha256] = kept.get(r.text_sha256, 0) + r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert set(kept.values()) <= {1}


def test_exact_groups_match_brute_force(spark, documents, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check_exact([tuple(r) for r in docs.select("doc_id", "text").collect()], exact_dedup.exact_groups(docs).collect())
    check_exact([tuple(r) for r in documents.select("doc_id", "text").collect()], exact_dedup.exact_groups(documents, digit=1, most_bytes=50, most_texts=2).collect())
    # large groups are split again
    check_exact([tuple(r) for r in docs.select("doc_id", "text").collect()], exact_dedup.exact_groups(docs, digit=2, most_bytes=20_000, most_texts=40).collect())
    assert exact_dedup.exact_groups(empty).count() == 0


def test_drop_copies(spark, documents, empty):
    out = exact_dedup.drop_copies(documents)
    assert out.columns == documents.columns
    # 1 and 2 have equal texts of one length, 4 to 6 are empty and 6 has the most code points;
    # of the three rows of 7's text that without doc_id is the longest
    assert sorted((r.doc_id is None, r.doc_id) for r in out.collect()) == [(False, i) for i in (1, 3, 6, 8, 9, 10)] + [(True, None)]
    assert exact_dedup.drop_copies(empty).count() == 0


def test_no_copy_survives_without_an_id_of_its_own(spark):
    rows = [(None, "a b"), (None, "a b"), (None, "ab"), (5, "ab"), (6, "ab zz"), (6, "ab")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.text for r in exact_dedup.drop_copies(docs).collect()) == ["a b", "ab zz"]
    near = simhash_dedup.drop_near_copies(spark.createDataFrame([(None, "one two three"), (None, "one two three"), (7, "one two three"), (7, "ONE two three"), (7, "four five")], "doc_id long, text string"))
    assert sorted(r.text.lower() for r in near.collect()) == ["four five", "one two three"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=12).map(lambda b: b.translate(bytes(97 + i % 2 for i in range(256)))), max_size=40))
def test_radix_classes(texts):
    for digit in (1, 3):
        got = exact_dedup.radix_classes(texts, digit)
        assert sorted(i for part in got for i in part) == list(range(len(texts)))
        assert sorted(sorted(p) for p in got) == sorted([i for i, t in enumerate(texts) if t == u] for u in set(texts))


def brute_fingerprint(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, ids, radius):
    u = np.array(sorted(set(fps)), np.uint64)
    parent = list(range(len(u)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(u)):
        for j in np.flatnonzero(np.bitwise_count(u ^ u[i]) <= radius):
            a, b = find(i), find(int(j))
            parent[max(a, b)] = min(a, b)
    at = {int(f): find(i) for i, f in enumerate(u)}
    least = {}
    for f, i in zip(fps, ids, strict=True):
        if i is not None:
            least[at[f]] = min(i, least.get(at[f], i))
    return [least.get(at[f]) for f in fps]


@pytest.mark.parametrize("radius", [3, 5])
def test_near_groups_match_brute_force(spark, documents, empty, radius):
    few = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    for docs in (few, documents.select("doc_id", "text")):
        rows = docs.collect()
        got = simhash_dedup.near_groups(docs, radius=radius).collect()
        fps = [brute_fingerprint(r.text) for r in rows]
        want = sorted(map(str, zip([r.doc_id for r in rows], (f"{f:016x}" for f in fps), brute_components(fps, [r.doc_id for r in rows], radius), strict=True)))
        assert sorted(str((r.doc_id, r.fingerprint, r.component_id)) for r in got) == want
    assert simhash_dedup.near_groups(empty).count() == 0


def test_links_of_planted_neighbours(spark):
    """Chains of fingerprints a few bits apart, in every part of the bits, are joined; others are not."""
    rng = random.Random(4)
    fps = []
    for _ in range(150):
        f = rng.getrandbits(64)
        for _ in range(rng.randint(1, 5)):
            fps.append(f)
            for b in rng.sample(range(64), 3):
                f ^= 1 << b
    signed = [f - (1 << 64) if f >> 63 else f for f in set(fps)]
    points = spark.createDataFrame([(f,) for f in signed], "fp long")
    edges = simhash_dedup.links(points).select(*[simhash_dedup.F.col(c).alias(n) for c, n in (("fp", "a"), ("other", "b"))])
    roots = {r.node: r.root for r in components.components(edges, Scratch(spark, "t")).collect()}
    ids = list(range(len(signed)))
    want = brute_components([f % (1 << 64) for f in signed], ids, 3)
    groups = {}
    for f, w in zip(signed, want, strict=True):
        groups.setdefault(w, set()).add(roots.get(f, f))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(1, k) for k in range(2, 60)] + [(7, 7)] + [(300, 200), (200, 250)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    assert all(got[i] == 100 for i in range(100, 141)) and all(got[i] == 1 for i in range(1, 60))
    assert got[300] == got[250] == got[200] == 200
    none = components.components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t"))
    assert none.count() == 0


def test_drop_near_copies(documents):
    """One row of each component stays, whatever its doc_id."""
    out = simhash_dedup.drop_near_copies(documents)
    assert out.columns == documents.columns
    # the texts of 1 and 2 have the same words, 3 and 10 nearly so; 4 to 6 are empty
    assert sorted(r.doc_id for r in out.collect()) == [1, 4, 7, 8, 9]


def test_block_links_join_what_all_pairs_join():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 60, 60).astype(np.uint64)
    sets = [np.unique(np.where(rng.random(60) < rng.choice([0.02, 0.1, 0.4]), rng.integers(0, 1 << 60, 60).astype(np.uint64), base)) for _ in range(80)]
    roots = np.array([100 + i // 3 for i in range(80)])
    for first in (np.ones(80, bool), np.arange(80) % 2 == 0):
        second = np.ones(80, bool) if first.all() else ~first
        parent = {int(r): int(r) for r in roots}

        def top(r, parent=parent):
            return r if parent[r] == r else top(parent[r])

        for i in np.flatnonzero(first):
            for j in np.flatnonzero(second):
                common = len(np.intersect1d(sets[i], sets[j]))
                if 5 * common >= 4 * (len(sets[i]) + len(sets[j]) - common):
                    a, b = sorted((top(int(roots[i])), top(int(roots[j]))))
                    parent[b] = a
        got = similar_texts.block_links(roots, sets, first, second, 0.8)
        assert 0 < len(got) < len(set(roots.tolist()))
        own = {int(r): int(r) for r in roots}
        for a, b in got:
            x, y = sorted((top(a, own), top(b, own)))
            own[y] = x
        assert {r: top(r, own) for r in own} == {r: top(r) for r in parent}


def test_similar_texts_in_small_blocks(spark, monkeypatch):
    """Blocks of a few shingles link what one block links."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    want = {r.doc_id: r.component_id for r in simhash_dedup.near_groups(docs).collect()}
    monkeypatch.setattr(similar_texts, "even_share", lambda *a: 400)
    assert {r.doc_id: r.component_id for r in simhash_dedup.near_groups(docs).collect()} == want


def test_pipeline_stage_joins_similar_texts(spark):
    """Of sf0.1's texts with a 5-word Jaccard similarity of 0.8 or more each pair shares a component, as brute force finds them."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id < 3500").select("doc_id", "text")
    got = {r.doc_id: r.component_id for r in simhash_dedup.near_groups(docs).collect()}
    at, sizes, shared = {}, {}, {}
    for r in docs.collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        shingles = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
        sizes[r.doc_id] = len(shingles)
        for s in shingles:
            at.setdefault(s, []).append(r.doc_id)
    for ids in at.values():
        for i, a in enumerate(ids):
            for b in ids[i + 1 :]:
                shared[a, b] = shared.get((a, b), 0) + 1
    alike = [(a, b) for (a, b), n in shared.items() if 5 * n >= 4 * (sizes[a] + sizes[b] - n)]
    thin = {r.doc_id: r.component_id for r in simhash_dedup.near_groups(docs, radius=3).collect()}
    assert any(thin[a] != thin[b] for a, b in alike)
    assert all(got[a] == got[b] for a, b in alike)
    # and nothing is joined but by these and by the fingerprints
    parent = dict(thin)
    root = lambda i: i if parent[i] == i else root(parent[i])
    for a, b in alike:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    assert {i: root(i) for i in parent} == got


def test_pipeline_stage_asks_for_similar_texts(spark):
    import corpus_pipeline

    words = [f"w{i}" for i in range(300)]
    changed = words.copy()
    for i in (40, 90, 140, 190, 240):
        changed[i] += "x"
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(changed)), (3, " ".join(reversed(words)))], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, docs, "").collect()) == [1, 3]
