"""Quality rules (boosted trees) and the co-trained classifier."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from skyloom.llm import cotrain, gbdt, quality_rules, text_stats
from skyloom.llm.common import Scratch

SF = "/root/testdata/sf0.01"


def brute_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(grams)
    repeated = {j for i, g in enumerate(grams) if n[g] > 1 for j in range(i, i + 3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated)


def test_base_counts_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = dict(docs.select("doc_id", "text").collect())
    got = quality_rules.apply_rules(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()
    assert len(got) == len(texts)
    for r in got:
        want = brute_base(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)


def test_held_out_accuracy_and_clean_documents(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    train, held = labels.where("doc_id % 4 <> 0"), labels.where("doc_id % 4 = 0")
    rules = quality_rules.apply_rules(docs, train).join(held, "doc_id").select("quality", "kept", "base_failed").collect()
    judged = [r for r in rules if not r.base_failed]
    assert np.mean([r.kept == bool(r.quality) for r in judged]) > 0.95
    assert np.mean([r.kept for r in judged if r.quality]) > 0.98
    scores = cotrain.classify(docs, train).join(held, "doc_id").select("quality", "kept").collect()
    assert np.mean([r.kept == bool(r.quality) for r in scores]) > 0.93
    assert np.mean([r.kept for r in scores if r.quality]) > 0.97


def test_forest_is_monotone():
    rng = np.random.default_rng(1)
    x = rng.random((800, 3))
    y = (np.sin(6 * x[:, 0]) + x[:, 1] - x[:, 2] + 0.3 * rng.standard_normal(800) > 0.4).astype(float)
    f = gbdt.fit(x, y, np.array([0, 1, -1]), trees=30)
    for j, sign in ((1, 1), (2, -1)):
        for _ in range(50):
            row = np.repeat(rng.random((1, 3)), 40, 0)
            row[:, j] = np.linspace(0, 1, 40)
            assert (sign * np.diff(f.raw(row)) >= -1e-12).all()
    assert np.mean((f.raw(x) > 0) == (y > 0.5)) > 0.8


def test_forest_walk_equals_scalar_walk():
    rng = np.random.default_rng(2)
    x, y = rng.random((300, 4)), rng.integers(0, 2, 300).astype(float)
    f = gbdt.fit(x, y, np.zeros(4), trees=8)

    def walk(row):
        total = f.bias
        for at in f.roots:
            while f.feature[at] >= 0:
                at = f.left[at] if row[f.feature[at]] <= f.threshold[at] else f.right[at]
            total += f.value[at]
        return total

    assert np.allclose(f.raw(x), [walk(r) for r in x])


def test_odd_rows(documents, labels, empty, no_labels):
    got = quality_rules.apply_rules(documents, labels).collect()
    assert len(got) == 12
    assert all(r.base_failed and not r.kept for r in got if r.n_words < 50)
    assert quality_rules.apply_rules(empty, labels).count() == 0
    kept = quality_rules.apply_rules(documents, no_labels).where("not base_failed and not kept").count()
    assert kept == 0
    scores = cotrain.classify(documents, labels).collect()
    assert len(scores) == 12 and all(r.score == 0 and not r.kept for r in scores if r.doc_id in (4, 5, 6))
    assert cotrain.classify(empty, no_labels).count() == 0
    assert all(r.kept for r in cotrain.classify(documents, no_labels).collect() if r.doc_id not in (4, 5, 6))
    for f in (quality_rules.filter_documents, cotrain.filter_documents):
        assert f(documents, labels).columns == documents.columns


def test_filters_agree_with_verdicts(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    for module, verdicts in ((quality_rules, quality_rules.apply_rules), (cotrain, cotrain.classify)):
        want = {r.doc_id for r in verdicts(docs, labels).where("kept").collect()}
        assert {r.doc_id for r in module.filter_documents(docs, labels).collect()} == want


def test_exchange_on_the_sample_tables(spark):
    """Both views hand labels of both classes over on sf0.1, from the whole pool, and each round more."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    table = cotrain.featured(docs, Scratch(spark, "t"))
    pool = docs.count() - min(labels.where("quality is not null").select("doc_id").distinct().count(), cotrain.MAX_LABELLED)
    for rounds in (1, 3):
        model = cotrain.fit(table, labels, rounds=rounds)
        for handed in model.handed.values():
            assert min(handed) > 0 and 0.08 * rounds * pool < sum(handed) < 0.25 * rounds * pool


def made_up(spark, good, bad, source_of):
    """Documents with words by class and a source by class, the first 80 with labels."""
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for i in range(600):
        y = int(rng.random() < 0.5)
        text = " ".join(rng.choice(good if y else bad, 30))
        rows.append((i, text, "en", source_of(rng, y), 100))
        if i < 80:
            labels.append((i, y, 0))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {r[0]: r[1] for r in labels}


def test_a_sure_view_teaches_the_other_one(spark):
    """What was handed over tells the classes apart: each view's weights of the handed labels are positive
    and words and sources that no labelled document has are learned from the other view."""
    common, good, bad = [f"c{i}" for i in range(30)], [f"g{i}" for i in range(300)], [f"b{i}" for i in range(300)]
    docs, labels, _ = made_up(spark, good + common, bad + common, lambda rng, y: f"s{rng.integers(4) + 4 * y}")
    table = cotrain.featured(docs, Scratch(spark, "t"))
    model = cotrain.fit(table, labels)
    assert model.text.model.weights[-1] > 0 and model.meta.model.weights[-1] > 0
    assert min(min(h) for h in model.handed.values()) > 20
    for view, x in (("text", [cotrain.text_view(" ".join(w).encode()) for w in (good, bad)]), ("meta", [cotrain.meta_view(f"s{k}", "en", 100) for k in (6, 2)])):
        cols, vals = zip(*(cotrain._packed(v) for v in x), strict=True)
        odds = getattr(model, view).log_odds(cotrain.Rows.unpack(pa.array(cols), pa.array(vals)))
        assert odds[0] > 0 > odds[1]


def test_surest_ranks():
    ranks, counts = np.array([-5, 0, 3, 9]), np.array([10, 30, 40, 20])
    assert cotrain.surest(ranks, counts, 0.3, 0.5) == (0, 9)  # equal ranks go together: 40 for 15 asked
    assert cotrain.surest(ranks, counts, 0.1, 0.5) == (-5, 9)
    low, high = cotrain.surest(np.array([7]), np.array([5]), 0.1, 0.8)  # one rank: nothing tells class 1 apart
    assert low == 7 and high > 7


def test_rows_of_one_id_do_not_depend_on_partitions(spark, documents, labels):
    two = documents.unionByName(documents.withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit(" other words here"))))
    models = [cotrain.fit(cotrain.featured(two.repartition(n), Scratch(spark, "t")), labels) for n in (1, 5)]
    assert np.allclose(models[0].text.model.weights, models[1].text.model.weights)
    forests = [quality_rules.fit(two.repartition(n), labels) for n in (1, 5)]
    assert np.array_equal(forests[0].threshold, forests[1].threshold)


def test_features_of_nothing():
    assert text_stats.features(b"", text_stats.base_counts(b"")) == [0.0] * len(text_stats.FEATURES)
