"""Licence scan by canonical digest, with DataFrame functions only.

A text is brought to a canonical form: copyright lines dropped, lower case,
punctuation and white space to single spaces, equivalent spellings to one.
The SHA-256 of the whole form is hash-joined to the digests of known licence
texts in the same form.  Units that are looked up whole: the document, each
of its paragraphs (parted by empty lines) and each of its lines.  A text of
several paragraphs inside a longer document is found as a run: its paragraphs
are joined one by one, and it is there if all of them stand in order with
nothing but empty paragraphs between.

Known are ``KNOWN`` and the full texts in ``license_texts``, each with and
without its title and without what follows its terms.

Equal forms have equal lengths, so units whose length is not that of a known
form are left out before hashing.  The known table is a parameter; it is
broadcast only while its counted rows are within ``BROADCAST_ROWS``.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.llm.text import whole

BROADCAST_ROWS = 50_000

# A line that states who holds the copyright: it has a sign or a year.
COPYRIGHT_LINE = r"(?im)^[^0-9A-Za-z\n]*(copyright[^\n]*(\(c\)|©|[0-9]{4})|\(c\)|©)[^\n]*$"
NOT_WORD = r"[^0-9a-z\x{80}-\x{10FFFF}\n]+"
# Equivalent spellings, after lower case and punctuation.
SPELLINGS = (
    (r"\b(sub)?licen[cs]e(s|d|e|es)?\b", "$1license$2"),
    (r"\b(auth|col|fav|hon|behavi|endeav)our(s|ed|able)?\b", "$1or$2"),
    (r"\b(author|organ|recogn|util|custom|initial)is(e|es|ed|ing|ation|ations)\b", "$1iz$2"),
    (r"\b(judg|acknowledg)ement(s)?\b", "$1ment$2"),
    (r"\bfulfil(s|ment)?\b", "fulfill$1"),
    (r"\bcentre(s)?\b", "center$1"),
    (r"\bwhilst\b", "while"),
    (r"\bprogramme(s)?\b", "program$1"),
    (r"\bsub (licens)", "sub$1"),
    (r"\bnon (commercial|infring)", "non$1"),
    (r"\bper cent\b", "percent"),
    (r"\bcopyright owner(s)?\b", "copyright holder$1"),
)

# Public licence notices and short licence texts.
KNOWN = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT License."),
    ("MIT", "MIT License"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\");"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE."""),
)


TEXTS = Path(__file__).parent / "license_texts"
# Titles that stand over texts that have none of their own.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", "BSD-3-Clause License", "BSD License", "New BSD License",
                     "BSD 3-Clause \"New\" or \"Revised\" License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", "BSD-2-Clause License", "BSD License", "Simplified BSD License",
                     "BSD 2-Clause \"Simplified\" License"),
}
_TERMS_END = re.compile(r"END OF TERMS AND CONDITIONS")


def full_texts() -> list[tuple[str, str]]:
    """(license, text) of every form of the full texts."""
    out = [(k, t) for k, t in KNOWN if "\n\n" in t]
    for file in sorted(TEXTS.glob("*.txt")):
        name, text = file.stem.partition("_")[0], file.read_text(encoding="utf-8")
        out.append((name, text))
        end = _TERMS_END.search(text)
        if end:
            out += [(name, text[:end.end()]), (name, text[:end.start()])]
    for name, text in list(out):
        if name in TITLES:
            out += [(name, f"{t}\n\n{text}") for t in TITLES[name]]
        else:
            out.append((name, re.split(r"\n[ \t]*\n", text.strip(), maxsplit=1)[1]))
    return out


def known_texts(spark: SparkSession) -> DataFrame:
    """(license, text) of ``KNOWN`` and ``full_texts``."""
    rows = F.array(*(F.struct(F.lit(k).alias("license"), F.lit(t).alias("text")) for k, t in KNOWN))
    return spark.range(1).select(F.inline(rows)).unionByName(spark.createDataFrame(full_texts(), "license string, text string"))


def canonical_lines(text: Column) -> Column:
    """The canonical form with its line ends still in place."""
    out = F.regexp_replace(F.lower(F.regexp_replace(whole(text), COPYRIGHT_LINE, "")), NOT_WORD, " ")
    for pattern, to in SPELLINGS:
        out = F.regexp_replace(out, pattern, to)
    return out


def one_line(form: Column) -> Column:
    return F.trim(F.regexp_replace(form, "[ \n]+", " "))


def known_digests(known: DataFrame) -> DataFrame:
    """(digest, n, license): several names of one form are joined."""
    form = one_line(canonical_lines(F.col("text")))
    return (known.select(form.alias("f"), "license").filter("f <> ''")
            .groupBy(F.sha2("f", 256).alias("digest"), F.length("f").alias("n"))
            .agg(F.array_join(F.array_sort(F.collect_set("license")), "|").alias("license")))


PARAGRAPH_END = "\n *\n[ \n]*"


def paragraphs(form: Column) -> Column:
    """The paragraphs that hold a word, each on one line."""
    return F.filter(F.transform(F.split(form, PARAGRAPH_END), one_line), lambda p: p != F.lit(""))


def known_parts(known: DataFrame) -> DataFrame:
    """(digest, n, text, k, parts, license): paragraph ``k`` of ``parts`` of
    each known text that has two or more."""
    rows = known.select("license", paragraphs(canonical_lines(F.col("text"))).alias("p")).filter(F.size("p") > 1)
    each = rows.select("license", F.sha2(F.array_join("p", "\n"), 256).alias("text"), F.size("p").alias("parts"), F.posexplode("p").alias("k", "f"))
    return (each.groupBy(F.sha2("f", 256).alias("digest"), F.length("f").alias("n"), "text", "k", "parts")
            .agg(F.array_join(F.array_sort(F.collect_set("license")), "|").alias("license")))


def scan(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, text_license (of the whole text, or null),
    found (sorted array of <unit, at, license>; unit: text, paragraph, line or
    run, at: its number from 0, of a run that of its first paragraph among
    those that hold a word), licenses (sorted distinct names).

    Null and empty texts: nothing found.  Null id: kept as null.  Repeated
    rows: one row each.  Empty table: no rows; an empty known table finds
    nothing.  Other columns are not read.
    """
    known = known if known is not None else known_texts(docs.sparkSession)
    alone = known_digests(known).select(F.lit(False).alias("part"), "digest", "n", F.lit(None).cast("string").alias("text"),
                                        F.lit(None).cast("int").alias("k"), F.lit(None).cast("int").alias("parts"), "license")
    table = alone.unionByName(known_parts(known).select(F.lit(True).alias("part"), "digest", "n", "text", "k", "parts", "license")).persist()
    small = table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    lengths = {p: [] for p in (False, True)}
    for r in table.select("part", "n").distinct().orderBy("n").collect() if small else ():
        lengths[r["part"]].append(r["n"])

    def fits(f: Column, part: bool = False) -> Column:
        if not small:
            return f != F.lit("")
        return F.length(f).isin(lengths[part]) if lengths[part] else F.lit(False)

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"),
                       canonical_lines(F.col(text_col)).alias("form"))

    def units(name: str, parts: Column, part: bool = False) -> Column:
        made = F.transform(parts, lambda p, i: F.struct(F.lit(name).alias("unit"), i.cast("int").alias("at"), p.alias("form")))
        return F.filter(made, lambda u: fits(u["form"], part))

    # lines first: cheap to sort out by length, as a line is its own form but for the ends
    lines = units("line", F.transform(F.split("form", "\n"), lambda p: F.trim(p)))
    every = F.concat(units("text", F.array(one_line(F.col("form")))), units("paragraph", F.transform(F.split("form", PARAGRAPH_END), one_line)),
                     lines, units("run", paragraphs(F.col("form")), True))
    one = (rows.select("rid", "id", F.explode_outer(every).alias("u"))
           .select("rid", "id", "u.unit", "u.at", F.coalesce(F.col("u.unit") == "run", F.lit(False)).alias("part"),
                   F.coalesce(F.sha2("u.form", 256), F.col("rid").cast("string")).alias("digest")))
    table = table.drop("n")
    hits = one.join(F.broadcast(table) if small else table, ["part", "digest"], "left")
    # one row per document and known text at one place; its other units are in one row
    runs = hits.groupBy("rid", "text", (F.col("at") - F.col("k")).alias("start")).agg(
        F.first("id").alias("id"), F.max(F.when(F.col("unit") == "text", F.col("license"))).alias("text_license"),
        F.collect_set(F.when(F.col("license").isNotNull() & ~F.col("part"), F.struct("unit", "at", "license"))).alias("units"),
        F.countDistinct("k").alias("seen"), F.first("parts").alias("parts"), F.first("license").alias("license"))
    full = F.array(F.struct(F.lit("run").alias("unit"), F.col("start").alias("at"), "license"))
    out = runs.groupBy("rid").agg(
        F.first("id").alias("id"), F.max("text_license").alias("text_license"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("text").isNull(), F.col("units"))
                                                              .when(F.col("seen") == F.col("parts"), full))))).alias("found"))
    return out.select("id", "text_license", "found", F.array_sort(F.array_distinct(F.transform("found", lambda x: x["license"]))).alias("licenses"))
