"""HTML extraction, licence scan, the pipeline and the registry."""

import html
import importlib
import re
import time

import duckdb
import pytest
from skyloom.llm import html_extract, license_scan, license_texts, queries

SF = "/root/testdata/sf0.01"


def article_blocks(page):
    """The article by its tags alone: the pages of the test data mark it."""
    body = re.search(r"<article>(.*)</article>", page, re.S)[1]
    body = re.sub(r"</?(?:p|h1|br)\b[^>]*>", "\0", body)
    text = re.sub(r"<[^>]*>", "", body)
    return "\n".join(b for b in (re.sub(r"\s+", " ", html.unescape(x)).strip() for x in text.split("\0")) if b)


def test_pages_match_their_articles(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = {r.page_id: (r.url, article_blocks(r.html)) for r in pages.collect()}
    got = html_extract.extract_pages(pages).collect()
    assert len(got) == len(want)
    assert all((r.url, r.text) == want[r.page_id] and r.n_chars == len(r.text) for r in got)


LONG = "This paragraph is long enough to be the text of a page, with many words in one line."


@pytest.mark.parametrize(
    "page, want",
    [
        ("", ""),
        ("<script>var x = '<p>no</p>';</script><style>p{}</style>", ""),
        (f"<nav><a href=1>Home</a></nav><div id=main><h1>Head &amp; shoulders</h1><p>{LONG}<p>Short.</div><footer>{LONG}</footer>", f"Head & shoulders\n{LONG}\nShort."),
        (f"<div class='cookie-notice'>{LONG}</div><main><p>{LONG}</p><div class=ad>{LONG}</div><p>End.</p></main><div class='comments'><p>{LONG}</p></div>", f"{LONG}\nEnd."),
        (f"<ul><li><a href=a>One link of a menu that is long enough</a><li><a href=b>Another link of this menu, also long</a></ul><p>{LONG}</p>", LONG),
        (f"<article><p>a\n  b\t c<br>d</p><form><input><label>Name</label></form><aside>{LONG}</aside><blockquote>q</blockquote></article>", "a b c\nd\nq"),
        ("<article><p>&lt;b&gt; &#233;&eacute; &nbsp; x</p></article>", "<b> éé x"),
        (f"<article><p><b>{LONG}<p>open <i>inline<p>end</article><section id=comments><p>{LONG}</section>", f"{LONG}\nopen inline\nend"),
        (f"<body class='has-sidebar'><div class='sidebar'>{LONG}</div><div class=content><p>{LONG}</p></div>", LONG),
    ],
)
def test_page_shapes(page, want):
    assert html_extract.main_text(page) == want


BODY = "Body text of the page. " * 25
RELATED = "<ul>" + "<li><a href=x>Another story of this site</a></li>" * 4 + "</ul>"


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<div><p>{LONG}</p>{RELATED}<p>{BODY}</p></div>", f"{LONG}\n{BODY.strip()}"),
        (f"<div><h1>Head</h1><p>By A. Bee</p><p>1 May 2020</p><p>{BODY}</p><p>End.</p></div>", f"Head\nBy A. Bee\n1 May 2020\n{BODY.strip()}\nEnd."),
        (f"<article><p>{LONG}</p></article><article><p>{BODY}</p></article>", f"{LONG}\n{BODY.strip()}"),
        (f"<main><h1>Headline</h1><article><p>{BODY}</p></article></main>", f"Headline\n{BODY.strip()}"),
        (f"<div class='widget'><article><p>{LONG}</p></article></div><footer>Foot</footer>", LONG),
        (f"<form><div><p>{LONG}</p>{RELATED}</div></form>", LONG),
        (f"<div><p>{BODY}</p></div><div class='widget'><article><p>{LONG}</p></article></div>", BODY.strip()),
        (f"<div><p>{BODY}</p></div><div class='comments'><article><p>{LONG}</p></article></div>", BODY.strip()),
    ],
)
def test_text_outside_one_clean_article(page, want):
    assert html_extract.main_text(page) == want


@pytest.mark.parametrize(
    "page, want",
    [
        # short lines of the element around all surges, and between them, are kept
        (f"<body><div class=text><p>One.</p><div class=ad>{LONG}</div><p>{BODY}</p>{RELATED}<p>Two.</p><div class=ad>{LONG}</div><p>End.</p></div><p>Back to top</p></body>", f"One.\n{BODY.strip()}\nTwo.\nEnd."),
        # a last paragraph after link lists
        (f"<body><p>{BODY * 3}</p>{RELATED * 3}<p>{LONG}</p></body>", f"{(BODY * 3).strip()}\n{LONG}"),
        # the distribution decides between an empty mark and the text
        (f"<body><article></article><div><p>{BODY}</p></div></body>", BODY.strip()),
        (f"<article><p>{LONG}</p><p>x <math><mi>a</mi></math></p><div class='feedback-loop'>Loops.</div><p class='related-work'>Others.</p><div class='related-posts'>{LONG}</div></article>", f"{LONG}\nx a\nLoops.\nOthers."),
        (f"<article><p>{LONG}</p></article><p>{LONG}</p>", LONG),
        (f"<div><p title='a > b' id=it's>{LONG}</p><p>1 < 2 <3</p></div>", f"{LONG}\n1 < 2 <3"),
    ],
)
def test_the_distribution_decides(page, want):
    assert html_extract.main_text(page) == want


@pytest.mark.parametrize(
    "part",
    ['<a "', "<a href='", '<a b="c" ', "<div>", "<div></p>", "<p><b>", "<i><div><b></i>", "</p>", "<", "<!", "<!--", "<script>", "</script", "<li><ul>", "<a href=\"x>", "&amp", "<td><table>", "<b><p></b>"],
)
def test_hostile_markup_takes_linear_time(part):
    def seconds(n):
        page = part * n + f"<p>{LONG}</p>"
        times = []
        for _ in range(3):
            began = time.process_time()
            html_extract.main_text(page)
            times.append(time.process_time() - began)
        return min(times)

    assert seconds(40_000) < 14 * max(seconds(10_000), 0.02)


def test_surges_and_dives():
    assert html_extract.surges([0, 0, 100, 50, 0, 0, 0, 80, 0]) == [(2, 4), (7, 8)]
    assert html_extract.surges([5, 0, 0, 0, 9]) == [(4, 5)]
    assert html_extract.surges([5, 5, 5, 5, 90, 5, 0, 0, 0]) == [(2, 6)]
    assert html_extract.surges([5, 5, 90], surge=1) == [(0, 3)]
    assert html_extract.surges([0, 0]) == [] and html_extract.surges([]) == []


def test_odd_pages(spark):
    rows = [(1, "u", None), (1, "u", None), (None, None, f"<p>{LONG}</p>"), (2, "v", "plain " * 50_000)]
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = html_extract.extract_pages(df).collect()
    assert sorted(r.n_chars for r in got) == [0, 0, len(LONG), 299_999]
    assert html_extract.extract_pages(df.limit(0)).count() == 0


def test_licence_scan_equals_sql(spark):
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = sorted(duckdb.sql(queries.ORACLE["op8_license_scan"]).fetchall())
    assert sorted(map(tuple, queries.op8_license_scan(spark, SF).collect())) == want and want


def test_licence_forms(spark, documents, empty):
    mit = license_scan.KNOWN[0][1]
    texts = [
        "The MIT License (MIT)\n\nCopyright (c) 2020 A. Person\nAll rights reserved.\n\n" + mit.replace(". ", ".\n").upper(),
        mit.replace("sublicense", "sub-license").replace("NONINFRINGEMENT", "NON-INFRINGEMENT"),
        mit + " And more.",
        "words\nreleased under the MIT LICENCE!\nwords",
        "Licensed under the Apache License, v2.0",
        None,
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r.doc_id, r.unit, r.line_no, r.license) for r in license_scan.scan(docs).collect())
    assert got == [(0, "text", 0, "MIT"), (1, "text", 0, "MIT"), (3, "line", 2, "MIT"), (4, "line", 1, "Apache-2.0"), (4, "text", 0, "Apache-2.0")]


def test_notices_and_spellings(spark):
    """Header notices as paragraphs of a file, in comment signs, and every pair of equivalent words, in Spark and in SQL."""
    notice = license_texts._APACHE_NOTICE
    gpl = next(t for n, t in license_scan.KNOWN if n == "GPL-3.0" and t.startswith("This program is free") and "later" in t and len(t) < 400)
    words = gpl.split(" ")
    lines = [" ".join(words[i : i + 9]) for i in range(0, len(words), 9)]
    texts = [
        "# " + "\n# ".join(notice.split("\n")),
        "import os\n\n\t\n" + "\n".join(f" * {x.strip()}" for x in lines) + "\n \nmore code\nand more",
        license_texts._UNLICENSE.replace("recognize", "recognise").replace("non-commercial", "noncommercial") + license_texts._UNLICENSE_END.replace("https", "http"),
        license_texts._ZLIB.replace("acknowledgment", "acknowledgement").upper(),
    ]
    documents = spark.createDataFrame([*enumerate(texts), (None, texts[0]), (3, texts[3])], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.unit, r.line_no, r.license) for r in license_scan.scan(documents).collect())
    want = [("0", "text", 0, "Apache-2.0"), ("1", "paragraph", 4, "GPL-3.0"), ("2", "text", 0, "Unlicense"), ("3", "text", 0, "Zlib"), ("3", "text", 0, "Zlib"), ("None", "text", 0, "Apache-2.0")]
    assert [x for x in got if x[1] != "paragraph" or x[0] == "1"] == want
    for a, b in license_scan.SAME_WORDS:
        assert license_scan.canonical(f"x {a.upper()}, y") == license_scan.canonical(f"X {b} y")
    con = duckdb.connect()
    con.register("documents", documents.toPandas().astype({"doc_id": "Int64"}))
    assert sorted((str(r[0]), *r[1:4]) for r in con.sql(license_scan.scan_sql()).fetchall()) == got


def test_no_licences_in_odd_texts(documents, empty):
    assert license_scan.scan(documents).count() == 0 and license_scan.scan(empty).count() == 0


def test_whole_licence_texts(spark):
    """Whole licence files, filled anew, in capitals and without their appendix, in Spark and in SQL."""
    from pathlib import Path

    names = ["Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0"]
    texts = {n: (Path(html_extract.__file__).parent / "licences" / f"{n}.txt").read_text() for n in names}
    rows = [(i, texts[n]) for i, n in enumerate(names)] + [(10 + i, re.sub(r"[ ]*\n(?=\S)", "\n  ", texts[n]).upper()) for i, n in enumerate(names)]
    rows += [(20, texts["GPL-3.0"].split("END OF TERMS")[0]), (21, texts["GPL-3.0"] + " and more")]
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in license_scan.scan(documents).collect())
    whole = {r[0]: r[3] for r in got if r[1] == "text"}
    assert whole == dict(enumerate(names)) | {10 + i: n for i, n in enumerate(names)} | {20: "GPL-3.0"}
    con = duckdb.connect()
    con.register("documents", documents.toPandas())
    assert sorted(con.sql(license_scan.scan_sql()).fetchall()) == got


def test_pipeline_against_brute_force(spark):
    """The dedup stages and the packing of run() by other means: texts compared with each other, the library's tokenizer."""
    import public_tokenizers
    from test_dedup import brute_fingerprint, norm
    from test_tokens import check_pieces
    from tokenizers import Tokenizer

    pipeline = importlib.import_module("corpus_pipeline")
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in pipeline.STAGES] == ["quality_classifier", "quality_rules", "exact_dedup", "simhash_near_dedup", "packing"]
    judged = pipeline.quality_rules_stage(spark, pipeline.quality_classifier(spark, docs, sf), sf).select("doc_id", "text").collect()
    clean = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").collect()}
    assert len(clean & {r.doc_id for r in judged}) >= 0.9 * len(clean)
    best = {}
    for r in judged:
        key = (-len(r.text or ""), r.doc_id)
        best[norm(r.text)] = min(best.get(norm(r.text), key), key)
    left = sorted((r for r in judged if best[norm(r.text)][1] == r.doc_id), key=lambda r: r.doc_id)
    words = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or "")) for r in left]
    shingles = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in words]
    prints = [brute_fingerprint(r.text) for r in left]
    parent = list(range(len(left)))

    def root(i):
        return i if parent[i] == i else root(parent[i])

    for i in range(len(left)):
        for j in range(i):
            common = len(shingles[i] & shingles[j])
            if (prints[i] ^ prints[j]).bit_count() <= 3 or words[i] and 5 * common >= 4 * (len(shingles[i]) + len(shingles[j]) - common):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    kept = {r.doc_id: r.text for i, r in enumerate(left) if root(i) == i}
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    whole.encode_special_tokens = True
    ids = {i: [*whole.encode(t or "", add_special_tokens=False).ids, 2] for i, t in kept.items()}
    got = pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in got} == set(kept) and 0 < len(kept) < len(judged) < docs.count()
    check_pieces(got, ids, 0.1 * sum(map(len, ids.values())))


def test_stages_keep_the_columns(spark, documents, labels, tmp_path):
    pipeline = importlib.import_module("corpus_pipeline")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for _, stage in pipeline.STAGES[:-1]:
        assert stage(spark, documents, str(tmp_path)).columns == documents.columns
    assert pipeline.STAGES[-1][1](spark, documents.limit(0), str(tmp_path)).count() == 0


def test_registry():
    import __spark_entry__ as entry

    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert set(queries.ORACLE) <= set(queries.QUERIES)
