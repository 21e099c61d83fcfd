from __future__ import annotations

from reviewloom import vocab
from reviewloom.operators import aspects


def tagged(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i long, clean_deep string")
    return aspects.tag_aspects(df)


def test_whole_words_in_lexicon_order(spark):
    rows = tagged(spark, ["refund late courier", "worship tracker", "", None, "easy box price"]).orderBy("i").collect()
    assert [r["aspects"] for r in rows] == [["delivery", "support"], [], [], [], ["price", "packaging", "ux"]]


def test_every_keyword_hits_its_aspect(spark):
    words = [(w, a) for a, ws in vocab.ASPECT_KEYWORDS.items() for w in ws]
    rows = tagged(spark, [w for w, _ in words]).orderBy("i").collect()
    assert [r["aspects"] for r in rows] == [[a] for _, a in words]


def test_flags(spark):
    rows = aspects.add_aspect_flags(tagged(spark, ["late parcel", "cost money", "sunny"])).orderBy("i").collect()
    assert [(r["aspect_delivery"], r["aspect_price"]) for r in rows] == [(True, False), (False, True), (False, False)]
    assert not any(rows[2][f"aspect_{a}"] for a in vocab.ASPECT_KEYWORDS)


def test_table_form_agrees(spark):
    texts = ["late late box", "", None, "ui app money", "none"]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, clean_deep string")
    joined = aspects.tag_aspects_with_table(df, "i", aspects.lexicon_table(spark)).orderBy("i").collect()
    assert [r["aspects"] for r in joined] == [r["aspects"] for r in tagged(spark, texts).orderBy("i").collect()]


def test_own_lexicon(spark):
    lexicon = {"battery": ["battery", "charge"], "screen": ["screen"]}
    df = aspects.add_aspect_flags(aspects.tag_aspects(spark.createDataFrame([("screen charge",)], "clean_deep string"), lexicon), lexicon)
    row = df.first()
    assert row["aspects"] == ["battery", "screen"] and row["aspect_battery"]


def test_rows_and_unmatched(spark):
    df = tagged(spark, ["late box", "sunny"])
    assert sorted(tuple(r) for r in aspects.aspect_rows(df, "i").collect()) == [(0, "delivery"), (0, "packaging")]
    assert [r["i"] for r in aspects.unmatched(df).collect()] == [1]


def test_filters(spark):
    rows = [("a", "negative", 0.5, ["ux"], 1.0, None), ("b", "positive", 0.5, ["ux", "price"], 1.0, None), ("c", "negative", 0.5, [], 1.0, None)]
    df = spark.createDataFrame(rows, "review_text string, sentiment string, confidence double, aspects array<string>, rating double, review_date string")
    def texts(*choice):
        return sorted(r["review_text"] for r in aspects.filter_reviews(df, *choice).collect())
    assert texts() == ["a", "b", "c"]
    assert texts(["negative"]) == ["a", "c"]
    assert texts([], ["price", "delivery"]) == ["b"]
    assert texts(["negative"], ["ux"]) == ["a"]
