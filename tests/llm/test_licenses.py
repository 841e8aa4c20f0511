from tests.conftest import SF_SMALL
from tests.llm.conftest import ODD
from tests.oracle_compare import duck
from tillwise.llm import licenses, queries

MIT = next(t for n, t in licenses.KNOWN if n == "MIT" and t.startswith("MIT License\n"))


def test_query_equals_oracle(spark):
    query, sql = queries.QUERIES["op9_license_scans"]
    got, want = query(spark, SF_SMALL), duck(SF_SMALL).sql(sql)
    key = lambda r: tuple(x or "" for x in r[1:]) + (r[0],)
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=key) == sorted(want.fetchall(), key=key)


def test_equivalent_texts_match(docs_of):
    texts = [MIT, MIT.upper(), MIT.replace("\n", "\n\n  * "), "Copyright (c) 2021 A. Body\n" + MIT + "\nAll rights reserved.",
             MIT.replace("sublicense", "sub-licence").replace("MIT License", "MIT Licence"),
             MIT.replace("without restriction", "with restriction"), "x " + MIT]
    got = [r.license for r in licenses.scan(docs_of(texts)).orderBy("doc_id").collect()]
    assert got == ["MIT"] * 5 + [None, None]


def test_notices_on_lines(docs_of):
    texts = ["text\n  released under the MIT licence!\nmore\nLicensed under CC BY-NC 4.0.", "Released under the MIT License. Not."]
    rows = licenses.scan(docs_of(texts)).orderBy("doc_id").collect()
    assert [r.notices for r in rows] == ["CC-BY-NC-4.0,MIT", ""] and rows[0].license is None


def test_odd_rows(docs_of):
    docs = docs_of([(None, t, None) for t in ODD]).selectExpr("*", "1 as license", "2 as digest")
    rows = licenses.scan(docs).collect()
    assert len(rows) == len(ODD) and all(r.license is None and r.notices == "" for r in rows)
    assert licenses.scan(docs.limit(0)).count() == 0 and licenses.scan(docs, known=()).count() == len(ODD)


def duck_scan(docs):
    import duckdb
    con, documents = duckdb.connect(), docs.toPandas()
    con.register("documents", documents)
    return con.sql(queries.QUERIES["op9_license_scans"][1]).fetchall()


def test_whole_texts_of_common_licenses(docs_of):
    """Texts as a project ships them: other wrapping, a holder's line, no appendix."""
    import textwrap
    from importlib import resources
    stored = {n: resources.files("tillwise.llm").joinpath(f"license_texts/{n}.txt").read_text() for n in licenses.TEXTS}
    wrapped = {n: "\n\n".join(textwrap.fill(p, 60, break_on_hyphens=False) for p in t.split("\n\n")) for n, t in stored.items()
               if not t.startswith(("Copyright", " ")) and n.startswith(("Unl", "BSL", "CC0"))}
    bsd = next(t for n, t in licenses.KNOWN if n == "BSD-2-Clause" and t.startswith("Redis"))
    texts = [*stored.items(), *wrapped.items(),
             ("Apache-2.0", stored["Apache-2.0"].split("END OF TERMS AND CONDITIONS")[0] + "END OF TERMS AND CONDITIONS\n"),
             ("BSD-2-Clause", "Copyright 2020 A. Body\nAll rights reserved.\n\n" + textwrap.fill(bsd.replace("\n", " "), 70, break_on_hyphens=False)),
             ("BSD-3-Clause", stored["BSD-3-Clause"]), (None, stored["GPL-3.0"].replace("freedom", "free beer"))]
    docs = docs_of([t for _, t in texts])
    rows = licenses.scan(docs).orderBy("doc_id").collect()
    assert [r.license for r in rows] == [n for n, _ in texts]
    assert sorted(map(tuple, rows), key=lambda r: r[0]) == sorted(duck_scan(docs), key=lambda r: r[0])


def test_holder_lines_and_prose(docs_of):
    held = ["Copyright The Foo Authors", "Copyright Foo Inc. and others", "copyright: Ann Lawson", "Copyright Lawrence Lab",
            "Copyright Ärger GmbH", "Copyright the Notables"]
    # wrapped lines that begin with the word are part of the text
    wrapped = MIT.replace(" copyright", "\ncopyright").replace(" COPYRIGHT", "\nCOPYRIGHT")
    texts = [f"MIT License\n\n{h}\n\n" + MIT.split("\n", 1)[1] for h in held] + [wrapped]
    docs = docs_of([*texts, "Copyright notice of it\n" + MIT])
    rows = licenses.scan(docs).orderBy("doc_id").collect()
    assert [r.license for r in rows] == ["MIT"] * len(texts) + [None]
    assert sorted(map(tuple, rows)) == sorted(duck_scan(docs))


def test_notice_lines_not_planted(docs_of):
    texts = ["a\nSPDX-License-Identifier: LGPL-2.1-or-later\nb", "// SPDX-License-Identifier: MPL-2.0",
             'x\n * Licensed under the Apache License, Version 2.0 (the "License");\ny', "Licensed under the GNU GPL v2."]
    rows = licenses.scan(docs_of(texts)).orderBy("doc_id").collect()
    assert [r.notices for r in rows] == ["LGPL-2.1", "MPL-2.0", "Apache-2.0", "GPL-2.0"]
