r"""Licence scan by canonical digest lookup.

A text's canonical form has A-Z in lower case, no copyright lines, one space for each run of punctuation and white
space, and one spelling of equivalent words. A copyright line begins with ``copyright`` or ``(c)`` and a mark, a year, a
placeholder or a name, or with the sign, and ``All rights reserved.`` as the next line is a part of it; a line of prose that was wrapped before the word ``copyright`` stays, since no
name begins with a word that follows ``copyright`` in the known texts or in PROSE. The SHA-256 of the
whole canonical text is hash-joined to the digests of known licences; each line of it, as a text of its own, is joined
to the same digests, which finds one-line notices.

The texts are scanned once and not shuffled. Of their lines only those go on whose digest is known, and only rows that
have such lines are grouped again.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowmill.llm.common import BROADCAST_BYTES, scratch
from rowmill.llm.licence_texts import PROSE, SPELLINGS, TEXTS
from rowmill.session import table

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _none_of(phrases: set[str], first: bool = True) -> str:
    """A pattern, without look-ahead (the oracle's engine has none), of the beginnings that no line with one of the phrases
    as its first words has. The first character is a letter, or not ASCII."""
    heads = "".join(sorted({p[0] for p in phrases if p}))
    if "" in phrases:
        other = ["[" + "".join(c for c in _LOWER if c not in heads) + "]"]
    elif first:
        other = [f"[^\\x00-\\x60\\x7B-\\x7F{heads}]"]
    else:
        # A line that ends within a phrase, behind a whole word of it, was wrapped there.
        other = [f"[^\\n{heads}]", *([] if " " in heads else ["$"])]
    return "(" + "|".join([*other, *(h + _none_of({p[1:] for p in phrases if p[:1] == h}, False) for h in heads)]) + ")"


def _copyright_line() -> str:
    """Pattern of copyright lines in lower case."""
    bodies = [body.translate(str.maketrans(_UPPER, _LOWER)) for _, body in TEXTS]
    prose = set(PROSE).union(*(re.findall(r"copyright\W+([a-z]+)", b) for b in bodies)) - {"c", "the"}
    prose = prose.union(*({f"the {x}" for x in re.findall(r"copyright\s+the\s+([a-z]+)", b)} for b in bodies))
    items = set().union(*(re.findall(r"\(c\)\s+([a-z]+)", b) for b in bodies))
    mark = r"(©|[0-9]{4}|[\[<{])"
    said = rf"copyright[\x20\t]*:?[\x20\t]*(\(c\)|{mark})|copyright[\x20\t]*:?[\x20\t]+{_none_of(prose)}"
    sign = rf"\(c\)[\x20\t]*{mark}|\(c\)[\x20\t]+{_none_of(items) if items else '[^\\n]'}|©"
    return rf"(?m)^[\x20\t]*({said}|{sign})[^\n]*(\n[\x20\t]*all rights reserved[\x20\t\r.]*$)?"


_COPYRIGHT_LINE = _copyright_line()
#: ASCII controls, space and punctuation but for the line feed, and typographic punctuation.
_PUNCTUATION = "[\\x00-\\x09\\x0B-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F‐-―‘-‟«»·•]+"
#: Up to so many known digests stand in the scan itself, to tell which lines go on; with more, all lines do.
MAX_LITERALS = 10_000


def _apart(words: str) -> str:
    """Two spaces between words, so that each has its own on both sides and neighbours can be replaced in one go."""
    return words.replace(" ", "  ")


def canonical_lines(text: str) -> list[str]:
    """The non-empty canonical lines of a text; the canonical text is those joined by a space."""
    text = text.translate(str.maketrans(_UPPER, _LOWER))
    text = re.sub(_PUNCTUATION, " ", re.sub(_COPYRIGHT_LINE, "", text))
    lines = []
    for line in text.split("\n"):
        line = f" {_apart(line.strip(' '))} "
        for said, meant in SPELLINGS:
            line = line.replace(f" {_apart(said)} ", f" {_apart(meant)} ")
        lines.append(line.strip(" ").replace("  ", " "))
    return [x for x in lines if x]


def digest(text: str) -> str:
    return hashlib.sha256(" ".join(canonical_lines(text)).encode()).hexdigest()


def _lines(text: Column) -> Column:
    text = F.translate(text, _UPPER, _LOWER)
    text = F.regexp_replace(F.regexp_replace(text, _COPYRIGHT_LINE, ""), _PUNCTUATION, " ")
    # Two spaces between words and around each line, so that whole words can be replaced by plain string search at once.
    text = F.concat(F.lit("\n "), F.replace(text, F.lit("\n"), F.lit(" \n ")), F.lit(" "))
    text = F.regexp_replace(text, "\\x20+", "  ")
    for said, meant in SPELLINGS:
        text = F.replace(text, F.lit(f" {_apart(said)} "), F.lit(f" {_apart(meant)} "))
    text = F.replace(text, F.lit("  "), F.lit(" "))
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" "))), lambda x: x != "")


def scan(docs: DataFrame, known: Sequence[tuple[str, str]] = TEXTS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Licences of documents; one row for each row of ``docs``.

    ``license_id`` is the licence that the whole text is, else NULL. ``notices`` names the licences that single lines
    are, in order, once each, joined by commas; empty without any. NULL and empty texts, and those of copyright lines
    only, have the digest of the empty string and no licence. Repeated rows are scanned each. Other columns are not
    read; an empty table gives an empty result. A digest known under two names keeps the first in order of names.

    Returns doc_id, canonical_sha256, license_id, notices.
    """
    digests: dict[str, str] = {}
    for name, body in sorted(known):
        digests.setdefault(digest(body), name)
    names = docs.sparkSession.createDataFrame(list(digests.items()), "known_digest string, known_id string")
    if sum(len(n.encode()) + 128 for n in digests.values()) <= BROADCAST_BYTES:
        names = F.broadcast(names)

    rows = docs.select(F.col(doc_id).alias("doc_id"), _lines(F.coalesce(F.col(text), F.lit(""))).alias("lines"))
    hits = F.array_distinct(F.transform("lines", lambda x: F.sha2(x, 256)))
    if len(digests) <= MAX_LITERALS:
        hits = F.filter(hits, lambda x: x.isin(list(digests)))
    rows = rows.select("doc_id", F.sha2(F.array_join("lines", " "), 256).alias("canonical_sha256"), hits.alias("hits"), F.monotonically_increasing_id().alias("row"))
    rows = scratch(rows)
    lines = rows.select("row", F.explode("hits").alias("line")).join(names, F.col("line") == F.col("known_digest"))
    found = lines.groupBy("row").agg(F.array_join(F.array_sort(F.collect_set("known_id")), ",").alias("notices"))
    noted = rows.filter(F.size("hits") > 0).join(found, "row", "left").select("doc_id", "canonical_sha256", F.coalesce("notices", F.lit("")).alias("notices"))
    rows = rows.filter(F.size("hits") == 0).select("doc_id", "canonical_sha256", F.lit("").alias("notices")).unionAll(noted)
    joined = rows.join(names, F.col("canonical_sha256") == F.col("known_digest"), "left")
    return joined.select("doc_id", "canonical_sha256", F.col("known_id").alias("license_id"), "notices")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    known = {}
    for name, body in sorted(TEXTS):
        known.setdefault(digest(body), name)
    values = ", ".join(f"('{d}', '{n}')" for d, n in known.items())
    line = "' ' || replace(trim(x, ' '), ' ', '  ') || ' '"
    for said, meant in SPELLINGS:
        line = f"replace({line}, ' {_apart(said)} ', ' {_apart(meant)} ')"
    line = f"replace({line}, '  ', ' ')"
    return f"""
WITH known AS (SELECT * FROM (VALUES {values}) AS v(d, n)),
low AS (SELECT doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS t FROM documents),
plain AS (SELECT doc_id, regexp_replace(regexp_replace(t, '{_COPYRIGHT_LINE}', '', 'g'), '{_PUNCTUATION}', ' ', 'g') AS t FROM low),
cut AS (SELECT doc_id, list_filter(list_transform(string_split(t, chr(10)), lambda x: trim({line}, ' ')), lambda x: x <> '') AS ls FROM plain),
hits AS (SELECT doc_id, string_agg(DISTINCT n, ',' ORDER BY n) AS notices FROM (SELECT doc_id, sha256(unnest(ls)) AS d FROM cut) JOIN known USING (d) GROUP BY doc_id)
SELECT c.doc_id, sha256(coalesce(array_to_string(ls, ' '), '')) AS canonical_sha256, k.n AS license_id, coalesce(notices, '') AS notices
FROM cut c LEFT JOIN known k ON k.d = sha256(coalesce(array_to_string(ls, ' '), '')) LEFT JOIN hits h ON h.doc_id = c.doc_id
"""


ORACLE = _oracle()
