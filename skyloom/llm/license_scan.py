"""Licence scan by canonical digest lookup.

A text is brought to a canonical form (case, copyright lines, punctuation and spellings that
mean the same), and the digest of the entire form is looked up among those of known licences
by a hash join.  The units are each whole document, its paragraphs and its lines, so a notice
that stands at the head of a file or as a line of a page is found as well as a licence file.  Forms whose length no known
form has cannot be equal to one and are not digested.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm.common import arrow_map
from skyloom.llm.license_texts import KNOWN

# Fixed values: (pattern, replacement) in order, in the syntax that RE2 and Python share.
COPYRIGHT_LINES = (
    (r"^[^a-z0-9\n]*copyright[^\n]*(\(c\)|©|[0-9][0-9][0-9][0-9])[^\n]*$", " "),
    (r"^[^a-z0-9\n(©]*(\(c\)|©)[^\n]*$", " "),
    (r"^[^a-z0-9\n]*all rights reserved[^a-z0-9\n]*$", " "),
)
PUNCTUATION = ((r"[^\p{L}\p{N}]+", " "),)
# Words that mean the same in licences, by a list that is published with licence identifiers.
SAME_WORDS = (
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("analyse", "analyze"),
    ("artefact", "artifact"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("calibre", "caliber"),
    ("cancelled", "canceled"),
    ("capitalisations", "capitalizations"),
    ("catalogue", "catalog"),
    ("categorise", "categorize"),
    ("centre", "center"),
    ("emphasised", "emphasized"),
    ("favour", "favor"),
    ("favourite", "favorite"),
    ("fulfil", "fulfill"),
    ("fulfilment", "fulfillment"),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labelling", "labeling"),
    ("labour", "labor"),
    ("maximise", "maximize"),
    ("modelled", "modeled"),
    ("modelling", "modeling"),
    ("offence", "offense"),
    ("optimise", "optimize"),
    ("organise", "organize"),
    ("practise", "practice"),
    ("programme", "program"),
    ("realise", "realize"),
    ("recognise", "recognize"),
    ("signalling", "signaling"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "willful"),
    ("per cent", "percent"),
    ("non commercial", "noncommercial"),
)
SPELLINGS = (
    (r"\blicence", "license"),
    (r"\bsub license", "sublicense"),
    (r"\bnon infringement\b", "noninfringement"),
    (r"\bv(ersion)? ?([0-9])", r"version \2"),
    (r"\bhttps\b", "http"),
    (r"isation\b", "ization"),
    (r"\bcopyright owner", "copyright holder"),
    *((rf"\b{a}\b", b) for a, b in SAME_WORDS),
)
_COPYRIGHT = re.compile("|".join(p for p, _ in COPYRIGHT_LINES))
_WORD = re.compile(r"[^\W_]+")
_BLANK = " \t\x0b\x0c\r"
_SPELLINGS = [(re.compile(p, re.A), to) for p, to in SPELLINGS]
#: Without one of these no spelling rule changes anything.
_SPELLED = re.compile(r"licence|sub license|\bv ?[0-9]|version[0-9]|https|isation|copyright owner|\b(?:non infringement|" + "|".join(a for a, _ in SAME_WORDS) + ")", re.A)


def _spelled(form: str) -> str:
    if _SPELLED.search(form):
        for pattern, to in _SPELLINGS:
            form = pattern.sub(to, form)
    return form


def canonical_units(text: str) -> list[tuple[str, int, str]]:
    """(kind, line number, canonical form) of the whole text (line 0), of its paragraphs of several lines
    (that of the first one), which blank lines set apart, and of each line."""
    low = text.lower()
    lines = low.split("\n")
    blank = [not x.strip(_BLANK) for x in lines]
    if "copyright" in low or "(c)" in low or "©" in low or "all rights reserved" in low:
        lines = [" " if _COPYRIGHT.search(x) else x for x in lines]
    forms = [" ".join(_WORD.findall(x)) for x in lines]
    units = [("text", 0, " ".join(filter(None, forms)))]
    first = None
    for i in range(len(forms) + 1):
        if i < len(forms) and not blank[i]:
            first = i if first is None else first
        elif first is not None:
            if i - first > 1:
                units.append(("paragraph", first + 1, " ".join(filter(None, forms[first:i]))))
            first = None
    units += [("line", i, f) for i, f in enumerate(forms, 1)]
    # what no rule changes in the whole is changed in no part of it
    return [(k, i, _spelled(f)) for k, i, f in units] if _SPELLED.search(units[0][2]) else units


def canonical(text: str) -> str:
    """Canonical form of a text; empty for punctuation alone and for copyright lines alone."""
    return canonical_units(text)[0][2]


def known_digests(known: Iterable[tuple[str, str]] = KNOWN) -> dict[str, tuple[str, int]]:
    """Digest of each known canonical form: the first name it has, and the form's length."""
    out: dict[str, tuple[str, int]] = {}
    for name, text in known:
        form = canonical(text)
        out.setdefault(hashlib.sha256(form.encode()).hexdigest(), (name, len(form)))
    return out


def scan(docs: DataFrame, known: Iterable[tuple[str, str]] = KNOWN) -> DataFrame:
    """doc_id, unit, line_no, license, digest: one row for each unit of *docs* that is a known licence.

    ``unit`` is text, paragraph or line; ``line_no`` is 0 for the whole text and counts lines from 1
    (a paragraph has that of its first line).  A text of one line matches as text and as line.  Null and empty texts match nothing; repeated rows match each; a null doc_id stays.
    *known* is a list of (name, text), not corpus data, so its digests are broadcast.
    """
    spark: SparkSession = docs.sparkSession
    digests = known_digests(known)
    lengths = frozenset(n for _, n in digests.values() if n)

    def rows(c: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"doc_id": [], "unit": [], "line_no": [], "digest": []}
        for doc_id, text in zip(c["doc_id"], c["text"], strict=True):
            for kind, i, form in canonical_units(text):
                if len(form) in lengths:
                    out["doc_id"].append(doc_id)
                    out["unit"].append(kind)
                    out["line_no"].append(i)
                    out["digest"].append(hashlib.sha256(form.encode()).hexdigest())
        return out

    few = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    hashed = arrow_map(few, rows, "doc_id long, unit string, line_no long, digest string")
    table = spark.createDataFrame([(d, name) for d, (name, n) in digests.items() if n], "digest string, license string")
    return hashed.join(F.broadcast(table), "digest").select("doc_id", "unit", "line_no", "license", "digest")


def scan_sql(known: Iterable[tuple[str, str]] = KNOWN) -> str:
    """The scan as SQL for an engine with RE2 patterns."""

    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    def form(x: str) -> str:
        x = f"lower({x})"
        for pattern, to in (*((f"(?m){p}", to) for p, to in COPYRIGHT_LINES), *PUNCTUATION, *SPELLINGS):
            x = f"regexp_replace({x}, {quoted(pattern)}, {quoted(to)}, 'g')"
        return f"trim({x})"

    values = ", ".join(f"({i}, {quoted(n)}, {quoted(t)})" for i, (n, t) in enumerate(known))
    return f"""
        WITH known AS (
            SELECT sha256({form("text")}) AS digest, arg_min(license, i) AS license
            FROM (VALUES {values}) v(i, license, text) GROUP BY 1
        ), numbered AS (
            SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents
        ), lines AS (
            SELECT row, doc_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS line FROM (SELECT row, doc_id, string_split(text, chr(10)) AS l FROM numbered)
        ), parts AS (
            SELECT *, regexp_matches(line, '^[\\x20\\x09-\\x0D]*$') AS blank, count(CASE WHEN regexp_matches(line, '^[\\x20\\x09-\\x0D]*$') THEN 1 END) OVER (PARTITION BY row ORDER BY i) AS part FROM lines
        ), units AS (
            SELECT doc_id, 'text' AS kind, 0 AS line_no, text AS unit FROM numbered
            UNION ALL
            SELECT doc_id, 'line', i, line FROM lines
            UNION ALL
            SELECT doc_id, 'paragraph', min(i), string_agg(line, chr(10) ORDER BY i) FROM parts WHERE NOT blank GROUP BY row, doc_id, part HAVING count(*) > 1
        ), hashed AS (
            SELECT doc_id, kind, line_no, sha256(form) AS digest
            FROM (SELECT doc_id, kind, line_no, {form("unit")} AS form FROM units) WHERE form <> ''
        )
        SELECT h.doc_id, h.kind AS unit, CAST(h.line_no AS BIGINT) AS line_no, k.license, h.digest
        FROM hashed h JOIN known k ON h.digest = k.digest
    """
