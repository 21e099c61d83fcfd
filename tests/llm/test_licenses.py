from __future__ import annotations

import pytest

import __spark_entry__ as entry_points
from reviewloom.llm import licenses
from suite.compare import compare, connect

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op7_license_scan", "op8_topk_search"])
def test_against_sql(spark, name):
    assert compare(spark, connect(SMALL), SMALL, name) == ""


def wrapped(names, width=7):
    words = " ".join(licenses.SENTENCES[n] for n in names).split()
    return "\n".join(" ".join(words[i:i + width]) for i in range(0, len(words), width))


def test_rules(spark, awkward, no_docs):
    s = licenses.SENTENCES
    cases = {
        1: ("Some text. " + s["mit-notice"] + " More text", "MIT", 0),
        2: ("no stop before\n" + s["gpl3-notice"] + "\nafter", "GPL-3.0-only", 0),
        3: (wrapped(["mit-title"]) + "\n\n" + wrapped(["mit-grant", "mit-keep", "mit-as-is"]), "MIT", 0),
        4: (wrapped(["bsd-grant", "bsd-source", "bsd-binary"]), "BSD-2-Clause", 0),
        5: (wrapped(["bsd-grant", "bsd-binary"]), "", 2),
        6: (s["apache-notice"] + " " + s["cc-by-nc4-notice"], "Apache-2.0,CC-BY-NC-4.0", 0),
        7: (wrapped(["gpl3-later", "gpl-hope", "gpl-details"]).upper(), "GPL-3.0-or-later", 0),
        8: ("It is not released under the MIT License.", "", 0),
        9: (wrapped(["mit-keep", "mit-notice"]), "MIT", 1),
        10: (s["mit-notice"] * 3, "", 0),
        11: (" ".join([s["mit-notice"]] * 3), "MIT,MIT,MIT", 0),
        12: (None, "", 0), 13: ("", "", 0),
    }
    docs = spark.createDataFrame([(i, t) for i, (t, _, _) in cases.items()], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    for i, (_, licence, rest) in cases.items():
        assert (got[i].licences, got[i].n_unexplained) == (licence, rest), i
    assert got[9].sentences == "mit-keep,mit-notice" and got[9].n_sentences == 2
    assert licenses.scan(awkward).count() == awkward.count() and licenses.scan(no_docs).count() == 0


def test_constants():
    import re
    assert all(re.search(licenses.TRIGGER, w) for w in licenses.BY_WORDS)
    assert len(licenses.BY_WORDS) == len(licenses.SENTENCES) and len(licenses.SENTENCES) <= ord(licenses.LAST) - ord(licenses.FIRST) + 1


def test_plan_has_no_python(spark, awkward):
    plan = licenses.scan(awkward)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_licences_beyond_the_first(spark):
    bsd, s = ["bsd-grant", "bsd-source", "bsd-binary"], licenses.SENTENCES
    names = ["the copyright holder", "Google Inc.", "the University", "the <organization>", "Foo, Inc.\nand Bar Ltd."]
    clause = "Neither the name of {} nor the names of its contributors\nmay be used to endorse or promote products derived from\nthis software without specific prior written permission."
    cases = [(wrapped(bsd) + "\n" + clause.format(n), "BSD-3-Clause", 0) for n in names]
    cases += [(wrapped(bsd), "BSD-2-Clause", 0), (clause.format("X"), "", 1),
              (wrapped(bsd) + "\n3. The name of the author may not be used to endorse or promote products\n derived from this software without permission.", "BSD-3-Clause", 0),
              (wrapped([*bsd, "bsd-advert"]) + "\nThis product includes software of X.\n" + clause.format("X"), "BSD-4-Clause", 0),
              (wrapped([*bsd, "apache11-ack"]) + "\nThe names \"A\" must not be used to endorse or promote products derived from this software.", "Apache-1.1", 0)]
    cases += [(wrapped([*n.split()]), licence, 0) for n, licence in [
        ("gpl2-only gpl-hope gpl-details", "GPL-2.0-only"), ("gpl2-only-2", "GPL-2.0-only"), ("gpl2-later gpl-hope gpl-details", "GPL-2.0-or-later"),
        ("lgpl21-later lgpl-hope lgpl-details", "LGPL-2.1-or-later"), ("lgpl2-later", "LGPL-2.0-or-later"), ("lgpl3-later-2 gpl-hope lgpl-details", "LGPL-3.0-or-later"),
        ("agpl3-later gpl-hope agpl-details", "AGPL-3.0-or-later"), ("unlicense-free unlicense-anyone", "Unlicense"), ("boost-grant", "BSL-1.0"),
        ("epl1-notice", "EPL-1.0"), ("epl2-notice", "EPL-2.0")]]
    mark = "SPDX-License-Identifier: "
    cases += [(f"// {mark}MIT\nint x;", "MIT", 0), (f"/* {mark}GPL-2.0 WITH Linux-syscall-note */", "GPL-2.0-only", 0), (f"# {mark}GPL-2.0+", "GPL-2.0-or-later", 0),
              (f"<!-- (c) X {mark}(MIT OR Apache-2.0) AND BSD-3-Clause -->", "MIT,Apache-2.0,BSD-3-Clause", 0), (f"{mark}LicenseRef-mine\n", "", 1),
              (f"{mark.lower()}lgpl-2.1-or-later", "LGPL-2.1-or-later", 0), (mark, "", 0), (f"{mark}MIT\n{s['mit-notice']}", "MIT,MIT", 0)]
    docs = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: (r.licences, r.n_unexplained) for r in licenses.scan(docs).collect()}
    assert {i: (got[i], t) for i, (t, licence, rest) in enumerate(cases) if got[i] != (licence, rest)} == {}
    assert [r.sentences for r in licenses.scan(docs).filter("doc_id = 21").collect()] == ["spdx-MIT"]


def test_very_long_texts(spark):
    """Lines of 100,000 words, with and without known sentences around them."""
    words, mark = "word another " * 50_000, "SPDX-License-Identifier: "
    cases = [("SPDX License Identifier " + words, "", 1), (words + licenses.SENTENCES["mit-notice"], "", 0), (words + ". " + licenses.SENTENCES["mit-notice"] + " " + words, "MIT", 0),
             (f"{mark}MIT {words}", "MIT", 0), ((mark + "MIT OR ISC\n") * 2000, ",".join(["MIT", "ISC"] * 2000), 0), ("license " * 100_000, "", 0),
             ("neither the name of " + words + " endorse or promote products derived from this software", "", 0), ("license.\n" * 100_000, "", 0)]
    docs = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: (r.licences, r.n_unexplained) for r in licenses.scan(docs).collect()}
    assert {i: got[i][0][:80] for i, (t, licence, rest) in enumerate(cases) if got[i] != (licence, rest)} == {}


def test_texts_of_licences(spark):
    """A copy of a text with the notice at its end is named once, by the text; other notices are read as before."""
    cases = [("gpl3-text x gpl3-later gpl-hope gpl-details", "GPL-3.0-only"), ("gpl3-text", "GPL-3.0-only"), ("gpl2-text x gpl2-later gpl-hope gpl-details", "GPL-2.0-only"),
             ("gpl3-later gpl-hope gpl-details", "GPL-3.0-or-later"), ("agpl3-text x agpl3-later gpl-hope agpl-details", "AGPL-3.0-only"),
             ("zlib-as-is x zlib-grant", "Zlib"), ("zlib-as-is", "")]
    text = lambda names: "\n\n".join("Some other sentence of the text." if n == "x" else wrapped([n]) for n in names.split())
    docs = spark.createDataFrame([(i, text(t)) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: r.licences for r in licenses.scan(docs).collect()}
    assert [got[i] for i in range(len(cases))] == [licence for _, licence in cases]
