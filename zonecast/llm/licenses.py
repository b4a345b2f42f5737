"""Licence scans by canonical digests.

A text's canonical form doesn't depend on case, punctuation, white space, copyright lines or
on which of two equivalent spellings it uses. Known licence texts and notices are brought to
that form once and hashed; a document's whole text, and each of its lines as a whole notice,
are hash-joined to those digests. Nothing is searched inside a text, so the work for each
document doesn't depend on how many licences are known.

Everything is DataFrame operations, in one pass: a text's canonical form is made once, its
digest and those of its lines meet the known digests in one broadcast join, and what is left
of a document (its own digest and its known lines) is put together by row.

Defined results for odd input: a null or empty text, or one of punctuation alone, has the
digest of the empty string and no licence (an empty form is never known); rows with one id
(null included), repeated ones too, are documents of their own; an empty table gives an empty
result; other columns aren't read. Only ASCII letters change case.

A line '(c) name' without a year names a holder, unless the text also has a '(b)': then it is
an item of a list. The entire texts of AGPL-3.0, CC-BY-4.0, CC-BY-NC-4.0 and CC-BY-ND-4.0 aren't
known, only their names and notices.
"""

from __future__ import annotations

from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# ---------------------------------------------------------------- fixed values: spellings

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# a line that begins, after marks, like this says who holds the rights, not what they are; the
# second form is a holder's name, so none of the words below may follow
STATED = r"copyright[^a-z0-9\n]*(?:c\)|[0-9]|year|yyyy|by )|©|all rights reserved"
NO_HOLDER = (r"(?:notices?|holders?|owners?|ownership|laws?|licen[cs]es?|licensed|interests?|disclaimers?|statements?|treaty|treaties|doctrines?|permissions?|protections?|"
             r"infringements?|claims?|rights?|terms?|status|information|marks?|materials?|works?|patents?|trademarks?|and|or|on|of|in|for|to|is|are|if|as|that|this|these|those|under|"
             r"with|within|which|it|its|your|any|all|shall|must|may|can|including|resulting|the (?:software|program|library|work|code|document|material|above|holder|owner)s?)")
# a (c) names a holder; where the text also has a (b) it is a list's mark, unless a year or the word follows
MARK_C = r"\(c\)"
DATED_C = r"\(c\)[^a-z0-9\n]*(?:(?:19|20)[0-9]{2}{no_digit}|copyright)"
HOLDER_WORDS = ("copyright", "(c)", "©", "all rights reserved")
_NAMED = r"copyright[ \t:]++[^a-z0-9\n\s,.;)]*+(?!" + NO_HOLDER + r"(?![a-z]))[^\s,.;)]"
HOLDER = rf"(^|\n)[^a-z0-9\n]*(?:{STATED}|{_NAMED}|{MARK_C})[^\n]*"
HOLDER_BESIDE_LISTS = rf"(^|\n)[^a-z0-9\n]*(?:{STATED}|{_NAMED}|{DATED_C.replace('{no_digit}', '(?![0-9])')})[^\n]*"
MARKS = r"[\x00-\x09\x0b-\x2f\x3a-\x60\x7b-\xbf\x{2010}-\x{201f}\x{2026}]+"
EQUIVALENT = (
    ("licence", "license"), ("sub license", "sublicense"), ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"),
    ("artefact", "artifact"), ("authorisation", "authorization"), ("authorise", "authorize"), ("calibre", "caliber"), ("cancelled", "canceled"),
    ("catalogue", "catalog"), ("centre", "center"), ("copyright owner", "copyright holder"), ("emphasise", "emphasize"),
    ("favour", "favor"), ("fulfilment", "fulfillment"), ("initialise", "initialize"), ("judgement", "judgment"), ("labelling", "labeling"),
    ("labour", "labor"), ("modelled", "modeled"), ("noncommercial", "non commercial"), ("organisation", "organization"), ("organise", "organize"),
    ("per cent", "percent"), ("practise", "practice"), ("programme", "program"), ("realise", "realize"), ("recognise", "recognize"),
    ("signalling", "signaling"), ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"), ("https", "http"),
)

# ---------------------------------------------------------------- fixed values: known texts

_WARRANTY_MIT = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_WARRANTY_ISC = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_CONDITIONS_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
materials provided with the distribution."""
_THIRD_BSD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without
specific prior written permission."""
_WARRANTY_BSD = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT,
INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR
PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)
ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_GRANT_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in
the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,
and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"""
_KEEP_MIT = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_GRANT_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_BODIES = (
    ("MIT", "MIT License", f"{_GRANT_MIT}\n{_KEEP_MIT}\n{_WARRANTY_MIT}"),
    ("ISC", "ISC License", f"{_GRANT_ISC}, provided that the above copyright notice and this permission notice appear in all copies.\n{_WARRANTY_ISC}"),
    ("0BSD", "BSD Zero Clause License", f"{_GRANT_ISC}.\n{_WARRANTY_ISC}"),
    ("BSD-2-Clause", "BSD 2-Clause License", f"{_CONDITIONS_BSD}\n{_WARRANTY_BSD}"),
    ("BSD-3-Clause", "BSD 3-Clause License", f"{_CONDITIONS_BSD}\n{_THIRD_BSD}\n{_WARRANTY_BSD}"),
)
_NAMES = (
    ("Apache-2.0", ("Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0 License")),
    ("MIT", ("MIT License", "MIT-License")),
    ("ISC", ("ISC License",)),
    ("BSD-2-Clause", ("BSD 2-Clause License", "Simplified BSD License")),
    ("BSD-3-Clause", ("BSD 3-Clause License", "New BSD License")),
    ("MPL-2.0", ("Mozilla Public License, Version 2.0", "Mozilla Public License 2.0")),
    ("GPL-2.0", ("GNU General Public License, version 2", "GNU General Public License v2.0")),
    ("GPL-3.0", ("GNU General Public License, version 3", "GNU General Public License v3.0")),
    ("LGPL-3.0", ("GNU Lesser General Public License, version 3",)),
    ("AGPL-3.0", ("GNU Affero General Public License, version 3",)),
    ("CC0-1.0", ("CC0 1.0", "Creative Commons Zero v1.0 Universal")),
    ("CC-BY-4.0", ("CC BY 4.0", "Creative Commons Attribution 4.0 International License")),
    ("CC-BY-SA-4.0", ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License")),
    ("CC-BY-NC-4.0", ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License")),
    ("CC-BY-ND-4.0", ("CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License")),
)
_NOTICES = ("Licensed under {}", "Licensed under the {}", "Released under {}", "Released under the {}", "Distributed under the {}", "Available under the {}",
            "This work is licensed under {}", "This work is licensed under a {}", "This work is licensed under the {}", "This software is released under the {}",
            "This project is licensed under the {}")


def known_texts() -> list[tuple[str, str]]:
    """(licence, text): bodies with and without their title, notices, and identifier lines."""
    out = [(i, t) for i, title, body in _BODIES for t in (body, f"{title}\n{body}", f"The {title}\n{body}")]
    out += [(i, notice.format(name)) for i, names in _NAMES for name in names for notice in _NOTICES]
    return out + [(i, f"SPDX-License-Identifier: {i}") for i, _ in _NAMES]


_FILES = ("Apache-2.0", "MPL-2.0", "GPL-2.0", "GPL-3.0", "LGPL-3.0", "CC0-1.0", "CC-BY-SA-4.0")
_END = "END OF TERMS AND CONDITIONS"


def whole_texts() -> list[tuple[str, str]]:
    """(licence, text) of the long licences kept as files: entire, and up to the end of the terms where more follows."""
    out = []
    for i in _FILES:
        text = resources.files(__package__).joinpath("license_texts", f"{i}.txt").read_text("utf-8")
        out.append((i, text))
        if _END in text:
            terms = text[:text.index(_END)]
            out += [(i, terms), (i, terms + _END)]
    return out


# ---------------------------------------------------------------- canonical form

def canonical_lines(text: Column) -> Column:
    """The canonical form, line ends kept; costly steps run where a text has what they look for."""
    out = F.coalesce(text, F.lit(""))
    out = F.when(F.octet_length(out) == F.length(out), F.lower(out)).otherwise(F.translate(out, UPPER, LOWER))
    says = F.lit(False)
    for word in HOLDER_WORDS:
        says = says | F.contains(out, F.lit(word))
    held = F.when(F.contains(out, F.lit("(b)")), F.regexp_replace(out, HOLDER_BESIDE_LISTS, "$1")).otherwise(F.regexp_replace(out, HOLDER, "$1"))
    out = F.regexp_replace(F.when(says, held).otherwise(out), MARKS, " ")
    for a, b in EQUIVALENT:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def one_line(lines: Column) -> Column:
    return F.trim(F.regexp_replace(F.replace(lines, F.lit("\n"), F.lit(" ")), " {2,}", " "))


def known_digests(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """(digest, license) of the known texts; of licences with one canonical text the first by name."""
    rows = spark.createDataFrame(known if known is not None else known_texts() + whole_texts(), "license string, text string")
    form = one_line(canonical_lines(F.col("text")))
    return rows.select("license", form.alias("form")).where("form != ''").groupBy(F.sha2("form", 256).alias("digest")).agg(F.min("license").alias("license"))


def scan_licenses(docs: DataFrame, known: list[tuple[str, str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest, text_license, n_licenses, licenses): the whole text's licence, and all licences of its lines, sorted."""
    table = F.broadcast(known_digests(docs.sparkSession, known))  # as large as the list of known texts, which is code
    rows = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), canonical_lines(F.col(text_col)).alias("form"))
    lines = F.filter(F.transform(F.split("form", "\n"), one_line), lambda x: x != "")
    own = F.struct(F.lit(True).alias("whole"), F.sha2(one_line(F.col("form")), 256).alias("digest"))
    of_lines = F.transform(F.array_distinct(lines), lambda x: F.struct(F.lit(False).alias("whole"), F.sha2(x, 256).alias("digest")))
    digests = rows.select("id", "row", F.explode(F.concat(F.array(own), of_lines)).alias("d")).select("id", "row", "d.whole", "d.digest")
    found = digests.join(table, "digest", "left").where(F.col("whole") | F.col("license").isNotNull())
    found = found.groupBy("row").agg(
        F.first("id").alias("id"), F.max(F.when(F.col("whole"), F.col("digest"))).alias("digest"), F.max(F.when(F.col("whole"), F.col("license"))).alias("text_license"),
        F.array_sort(F.collect_set("license")).alias("named"))  # as many as there are licences at most
    return found.select(F.col("id").alias(id_col), "digest", "text_license", F.size("named").cast("long").alias("n_licenses"), F.array_join("named", ",").alias("licenses"))
