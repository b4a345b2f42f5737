import duckdb
from pyspark.sql import functions as F

from zonecast.llm import licenses as L

MIT = next(t for i, t in L.known_texts() if i == "MIT")


def scan(docs, **kw):
    return sorted(((r.doc_id, r.text_license, r.n_licenses, r.licenses) for r in L.scan_licenses(docs, **kw).collect()), key=str)


def test_whole_texts_and_lines(docs_of, no_docs):
    shouted = "  # Copyright (c) 2020 Someone\n//  All rights reserved.\n\n" + MIT.upper().replace(",", " , ").replace("\n", "\n * ").replace("ABOVE ", "ABOVE\n")
    british = MIT.replace("sublicense", "sublicence")
    texts = [MIT, shouted, british, MIT + " extra", "story\n/* Licensed under the Apache License, Version 2.0. */\nmore\nreleased under the MIT licence!",
             "A text on how it is licensed under the Apache License, Version 2.0.", None, "", "!!! ...\n(c) nobody", "x" * 300_000 + "\nLicensed under CC BY-NC 4.0.",
             "“Licensed under CC BY-NC 4.0.”\nLicensed under CC BY-NC 4.0", (0, "other")]
    docs = docs_of(texts).withColumn("license", F.lit("clash")).withColumn("digest", F.lit(1))
    assert scan(docs) == sorted([(0, "MIT", 1, "MIT"), (1, "MIT", 1, "MIT"), (2, "MIT", 1, "MIT"), (3, None, 0, ""), (4, None, 2, "Apache-2.0,MIT"), (5, None, 0, ""), (6, None, 0, ""),
                                 (7, None, 0, ""), (8, None, 0, ""), (9, None, 1, "CC-BY-NC-4.0"), (10, None, 1, "CC-BY-NC-4.0"), (0, None, 0, "")], key=str)
    assert scan(no_docs) == []


def test_null_ids_and_own_catalogue(docs_of):
    docs = docs_of([(None, "Our Terms."), (1, "our terms"), (1, "our terms")])
    assert scan(docs, known=[("B", "our terms"), ("A", "OUR, TERMS"), ("C", "!!!")]) == sorted([(None, "A", 1, "A"), (1, "A", 1, "A"), (1, "A", 1, "A")], key=str)


def test_each_known_text_names_its_license(docs_of):
    known = L.known_texts()
    got = {r.doc_id: r.text_license for r in L.scan_licenses(docs_of([t for _, t in known])).collect()}
    assert got == {i: name for i, (name, _) in enumerate(known)}


def test_whole_long_texts(docs_of):
    whole = L.whole_texts()
    assert {i for i, _ in whole} == {"Apache-2.0", "MPL-2.0", "GPL-2.0", "GPL-3.0", "LGPL-3.0", "CC0-1.0", "CC-BY-SA-4.0"}
    # as they are, with other line ends, in a comment, and with a holder of their own
    texts = [f(t) for _, t in whole for f in (str, lambda t: " ".join(t.replace("Copyright [yyyy] [name of copyright owner]", "").split()) if "Copyright (C)" not in t else t,
                                              lambda t: "/*\n" + "\n".join(f" * {x}" for x in t.split("\n")) + "\n*/", lambda t: "Copyright The Go Authors\n\n" + t)]
    got = {r.doc_id: r.text_license for r in L.scan_licenses(docs_of(texts)).collect()}
    assert got == {i: whole[i // 4][0] for i in range(len(texts))}
    apache = next(t for i, t in whole if i == "Apache-2.0")
    item = "(c) You must retain, in the Source form of any Derivative Works"
    assert item in apache and scan(docs_of([apache.replace(item, "(c) You need not retain, in the Source form of any Derivative Works")]))[0][1] is None


def test_lines_that_name_a_holder(docs_of):
    holders = ["Copyright Node.js contributors. All rights reserved.", "Copyright The Go Authors", "// Copyright: Jane Doe <jane@example.org>", "(c) Jane Doe", "Copyright (c) 2020 A", "© B",
               "Copyright 2009 The Go Authors. All rights reserved.", "Copyright [name of copyright owner]"]
    others = ["Copyright notice", "copyright and related rights", "COPYRIGHT HOLDERS AND CONTRIBUTORS", "copyright the software, and", "Copyright.", "copyright", "Copyright  law is"]
    texts = [f"{x}\n\n{MIT}" for x in holders + others] + [MIT.replace(" copyright", "\ncopyright").replace(" COPYRIGHT", "\nCOPYRIGHT")]
    got = {r.doc_id: r.text_license for r in L.scan_licenses(docs_of(texts)).collect()}
    assert got == {i: "MIT" if i < len(holders) or i == len(texts) - 1 else None for i in range(len(texts))}
    kept = "(b) one\n(c) two\n(c) 2020 Someone"
    assert L.scan_licenses(docs_of([kept, "(b) one\n(c) two", "(b) one"])).select("digest").distinct().count() == 2


def test_sql_names_what_the_operator_names(docs_of, tmp_path):
    """The oracle on a table of whole licences, holder lines, lists, notices and odd texts."""
    from zonecast.llm.oracle import ORACLES
    from zonecast.llm.queries import QUERIES

    whole = L.whole_texts()
    lines = ["Copyright Node.js contributors. All rights reserved.", "Copyright The Go Authors", "// Copyright: Jane Doe", "(c) Jane Doe", "Copyright (c) 2020 A", "© B", "Copyright [name of copyright owner]",
             "Copyright notice", "copyright and related rights", "Copyright.", "copyright", "Copyright  law is", "Copyright thesis", "copyright ist Wissen", "Copyright\t:«Zoë»", "Copyright (the work)"]
    texts = [t for _, t in whole] + [f"Copyright The Go Authors\n\n{t}" for _, t in whole] + [t for _, t in L.known_texts()] + [f"{x}\n\n{MIT}" for x in lines]
    texts += ["(b) one\n(c) two\n(c) 2020 Someone\n(c) 20201 x", "(b) one\n(c) two", "(c) two", None, "", "!!!", "ÀÉ Licensed under CC BY 4.0", "x\nLicensed under CC BY 4.0.\nMIT license\n", (3, "other"), (None, MIT)]
    docs = docs_of(texts)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in QUERIES["op4_licenses"](docs.sparkSession, str(tmp_path)).select("doc_id", "digest", "text_license", "n_licenses", "licenses").collect()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(f"SELECT doc_id, digest, text_license, n_licenses, licenses FROM ({ORACLES['op4_licenses']})").fetchall()
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {r[2] for r in got} >= {i for i, _ in whole} | {"MIT", "ISC", "0BSD", "BSD-2-Clause", "BSD-3-Clause"}
