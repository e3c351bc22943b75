"""Licence scans by canonical digests.

Texts are normalised (case, punctuation, copyright lines, equivalent spellings) and whole units (a text, each of its
paragraphs, each of its lines) are looked up by digest in the table of known licences, by a hash join. The table holds the
short texts and notices of KNOWN, which may also be met by paragraph, and the entire texts that ``full_texts`` lists.
"""

from __future__ import annotations

from importlib import resources
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

#: Equivalent spellings, fixed values: British and American forms, hyphens, and web addresses with or without TLS.
SPELLINGS = (
    ("licence", "license"), ("licensor's", "licensors"), ("sub-license", "sublicense"), ("non-commercial", "noncommercial"),
    ("copy-right", "copyright"), ("acknowledgement", "acknowledgment"), ("organisation", "organization"), ("authorisation", "authorization"),
    ("merchantibility", "merchantability"), ("fulfilment", "fulfillment"), ("per cent", "percent"), ("https://", "http://"), ("&", " and "),
)

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""

#: Public licence texts and notices, fixed values.
KNOWN = (
    ("MIT", _MIT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", _ISC),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "SPDX-License-Identifier: CC-BY-4.0"),
)
#: A paragraph of a known text counts on its own from this many characters on.
LEAST = 80


#: Where the terms of a text end; what follows says how to apply them and is often left out.
_END = "END OF TERMS AND CONDITIONS"


def _bsd() -> list[tuple[str, str]]:
    """The usual wordings of the BSD licences: with or without a title, a claim of all rights and numbers, for a holder or owner."""
    text = (resources.files(__package__) / "license_texts" / "BSD-3-Clause.txt").read_text(encoding="utf-8")
    text = text[text.index("Redistribution and use") :].replace("THE REGENTS AND", "THE COPYRIGHT HOLDERS AND").replace("the University", "the copyright holder")
    third, rest = text.index("3. Neither"), text.index("THIS SOFTWARE")
    bodies = (("BSD-3-Clause", "3", text), ("BSD-2-Clause", "2", text[:third] + "\n" + text[rest:]))
    out = []
    for (name, n, body), title, rights, numbers, who in product(bodies, ("", "BSD {}-Clause License", "The {}-Clause BSD License"), ("", "All rights reserved."), (True, False), ("HOLDER", "OWNER")):
        body = body.replace("THE REGENTS OR", f"THE COPYRIGHT {who} OR")
        for i in () if numbers else "123":
            body = body.replace(f"\n{i}. ", "\n* ")
        out.append((name, "\n\n".join(x for x in (title.format(n), rights, body) if x)))
    return out


def full_texts() -> list[tuple[str, str]]:
    """license_id and text of the entire licences at hand (the files of license_texts), with and without their appendices."""
    out = _bsd()
    for file in sorted((resources.files(__package__) / "license_texts").iterdir(), key=lambda f: f.name):
        if file.name.endswith(".txt"):
            name, text = file.name.removesuffix(".txt"), file.read_text(encoding="utf-8")
            terms = text[: text.index(_END)] if _END in text else text
            out += [(name, text), (name, terms), (name, terms + _END)]
    return out


def _spelled(text: Column) -> Column:
    out = F.lower(text)
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


_BREAK = "\u0001"


def _forms(df: DataFrame) -> DataFrame:
    """df with ``forms``: the distinct canonical forms of its text as a whole, of its paragraphs and of its lines.

    Each line is made canonical once (copyright lines become empty); blank lines part the paragraphs.
    """
    lines = F.split(_spelled(F.col("text")), "\n")
    plain = lambda x: F.when(F.trim(F.translate(x, "\t\r", "  ")) == "", F.lit(_BREAK)).otherwise(F.trim(F.regexp_replace(x, "[^a-z0-9]+", " ")))
    owned = lambda x: F.when(x.startswith("copyright") | x.startswith("c "), F.when(x.rlike("^(c )?copyright( |$)|^c [0-9]{4}( |$)"), F.lit("")).otherwise(x)).otherwise(x)
    tidy = lambda x: F.trim(F.regexp_replace(x, " +", " "))
    out = df.withColumn("__lines", F.transform(F.transform(lines, plain), owned)).withColumn("__text", F.array_join("__lines", " "))
    whole, parts = F.array(tidy(F.replace("__text", F.lit(_BREAK), F.lit(" ")))), F.transform(F.split("__text", _BREAK), tidy)
    forms = F.filter(F.array_distinct(F.concat(whole, parts, "__lines")), lambda x: (x != "") & (x != _BREAK))
    return out.withColumn("forms", forms).withColumn("paragraphs", parts).drop("__lines", "__text")


def known(spark: SparkSession, texts: DataFrame | None = None) -> DataFrame:
    """license_id and digest of each known text and of the longer paragraphs of those of KNOWN.

    texts (license_id, text) are entire licences, ``full_texts`` by default. They count as a whole only: licences share
    paragraphs, with others in the table and with some that aren't.
    """
    kind = "license_id string, text string"
    long = F.array_join(F.filter("paragraphs", lambda x: x != ""), " ")
    parts = F.array_union(F.array(long), F.filter("paragraphs", lambda x: F.length(x) >= LEAST))
    short = _forms(spark.createDataFrame(list(KNOWN), kind)).select("license_id", F.explode(parts).alias("form"))
    texts = spark.createDataFrame(full_texts(), kind) if texts is None else texts
    whole = _forms(texts.select("license_id", "text").where("text is not null")).select("license_id", long.alias("form")).where("form <> ''")
    return short.unionByName(whole).select("license_id", F.md5("form").alias("digest")).distinct()


def scan(docs: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """doc_id, license_id and n_forms (distinct canonical units that match) for each licence found in a document.

    texts is the table of entire licences, see ``known``. Texts without a licence (null and empty ones, too) give no row;
    rows of one id count together.
    """
    rows = _forms(documents(docs).where("text is not null")).select("doc_id", F.explode_outer("forms").alias("form")).where("form is not null")
    hits = rows.select("doc_id", F.md5("form").alias("digest")).join(F.broadcast(known(docs.sparkSession, texts)), "digest")
    return hits.groupBy("doc_id", "license_id").agg(F.countDistinct("digest").alias("n_forms"))


def sql() -> str:
    """The same in DuckDB's SQL over documents, for the texts of KNOWN."""
    spelled = "lower(text)"
    for a, b in SPELLINGS:
        spelled = f"replace({spelled}, '{a.replace(chr(39), chr(39) * 2)}', '{b}')"
    plain = r"CASE WHEN regexp_matches(trim(regexp_replace(x, '[^a-z0-9]+', ' ', 'g')), '^(c )?copyright( |$)|^c [0-9]{4}( |$)') THEN '' ELSE trim(regexp_replace(x, '[^a-z0-9]+', ' ', 'g')) END"
    joined = lambda t: f"array_to_string(list_filter(list_transform(string_split({t}, chr(10)), lambda x: {plain}), lambda x: x <> ''), ' ')"
    paragraphs = lambda t: f"list_transform(regexp_split_to_array({t}, '\\n[ \\t\\r]*\\n'), lambda p: {joined('p')})"
    values = ", ".join(f"('{i}', '{t.replace(chr(39), chr(39) * 2)}')" for i, t in KNOWN)
    return f"""
WITH known_texts(license_id, text) AS (VALUES {values}),
spelled_known AS (SELECT license_id, {spelled} AS t FROM known_texts),
known AS (SELECT DISTINCT license_id, md5(form) AS digest FROM (
  SELECT license_id, unnest(list_concat([{joined('t')}], list_filter({paragraphs('t')}, lambda x: length(x) >= {LEAST}))) AS form FROM spelled_known)),
spelled AS (SELECT doc_id, {spelled} AS t FROM documents WHERE text IS NOT NULL),
forms AS (SELECT doc_id, unnest(list_distinct(list_concat([{joined('t')}], {paragraphs('t')}, list_transform(string_split(t, chr(10)), lambda x: {plain})))) AS form FROM spelled)
SELECT doc_id, license_id, count(DISTINCT digest) AS n_forms
FROM (SELECT doc_id, md5(form) AS digest FROM forms WHERE form <> '') JOIN known USING (digest)
GROUP BY doc_id, license_id"""
