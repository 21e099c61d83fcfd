from __future__ import annotations

import random
import re
import unicodedata

from pyspark.sql import functions as F

from reviewloom import vocab
from reviewloom.functions import text as txt
from reviewloom.operators.cleaning import deep_clean_with_tables, drop_blank_reviews, preprocess


def apply(spark, function, values):
    rows = list(enumerate(values))
    df = spark.createDataFrame(rows, "i int, s string")
    return [r["r"] for r in df.select("i", function(F.col("s")).alias("r")).orderBy("i").collect()]


def test_light_clean_keeps_case_punctuation_and_emoji(spark):
    assert apply(spark, txt.light_clean, ["So GOOD!! I am happy \U0001F600.", None, " 　 "]) == [
        "So GOOD!! I am happy \U0001F600.", "", ""]


def test_light_clean_drops_urls_and_tags_in_that_order(spark):
    texts = ["see http://a.b/c?d now", "<i>fine</i> build", "big<br>deal", "www.shop.example is it",
             '<a href="http://x.com">link</a> tail a<br>b']
    assert apply(spark, txt.light_clean, texts) == ["see now", "fine build", "bigdeal", "is it", "b"]


def test_any_whitespace_ends_a_url(spark):
    spaces = [c for c in map(chr, range(0x10000)) if c.isspace()]
    texts = [f"a www.b.c/x{c}d" for c in spaces] + ["http://e.f/\u00e9\u4e2d"]
    assert apply(spark, txt.remove_markup, texts) == [f"a {c}d" for c in spaces] + [""]


def test_light_clean_normalises_characters(spark):
    texts = ["ﬁne ① ＡＢ", "café", "a b c", "½"]
    assert apply(spark, txt.light_clean, texts) == ["fine 1 AB", "café", "a b c", "1⁄2"]


def test_every_character_taken_as_stable_is_stable():
    for low, high in txt.NFKC_STABLE_RANGES:
        for code in range(low, high + 1):
            c = chr(code)
            assert unicodedata.normalize("NFKC", c) == c, hex(code)
            assert unicodedata.combining(c) == 0, hex(code)
    stable = [chr(c) for lo, hi in txt.NFKC_STABLE_RANGES for c in range(lo, hi + 1)]
    draw = random.Random(3)
    for _ in range(3000):
        text = "".join(draw.choices(stable, k=20))
        assert unicodedata.normalize("NFKC", text) == text


def test_nfkc_equals_python_on_mixed_texts(spark):
    draw = random.Random(5)
    pool = "ab ééﬃ각가゙か²ΩÅ\U0001F600～ͅ"
    texts = ["".join(draw.choices(pool, k=12)) for _ in range(400)]
    assert apply(spark, txt.nfkc, texts) == [unicodedata.normalize("NFKC", t) for t in texts]


def test_whitespace_means_what_python_means(spark):
    spaces = [c for c in map(chr, range(0x10000)) if c.isspace()]
    assert sorted(txt.SPACE_CHARS) == spaces
    texts = [f"{c}a{c}{c}b {c}" for c in spaces] + ["​ a", ""]
    assert apply(spark, txt.strip, texts) == [t.strip() for t in texts]
    assert apply(spark, txt.squeeze, texts) == [" ".join(t.split()) for t in texts]
    assert apply(spark, txt.word_count, texts) == [len(t.split()) for t in texts]


def test_word_count_of_null_is_null(spark):
    assert apply(spark, txt.word_count, ["Quick and friendly, on a Tuesday.", None]) == [6, None]


def test_deep_prepare_blanks_everything_but_letters(spark):
    texts = ["It's 5 o'clock, CAFÉ!", None, "日本"]
    assert apply(spark, txt.deep_prepare, texts) == ["it s o clock caf", "", ""]


def test_deep_clean_drops_stop_words_and_lemmatises(spark):
    cleaned, empty = apply(spark, txt.deep_clean, ["The staff never responded to my complaints about the boxes", "the of"])
    assert cleaned == "staff respond complaint box"
    assert empty == ""


def test_deep_clean_works_on_raw_text(spark):
    assert apply(spark, txt.deep_clean, ["<br>at https://x.org"]) == ["br https x org"]


def test_table_form_of_deep_clean_agrees(spark):
    draw = random.Random(11)
    pool = [*vocab.STOP_WORDS[:40], *list(vocab.LEMMAS)[:60], "parcel", "Blue,", "7", "x-ray"]
    rows = [(i, " ".join(draw.choices(pool, k=draw.randint(0, 30)))) for i in range(200)] + [(999, None)]
    df = spark.createDataFrame(rows, "k long, review_text string")
    stops = spark.createDataFrame([(w,) for w in vocab.STOP_WORDS], "word string")
    lemmas = spark.createDataFrame(list(vocab.LEMMAS.items()), "word string, lemma string")
    joined = {r["k"]: r["clean_deep"] for r in deep_clean_with_tables(df, "k", stops, lemmas).collect()}
    inline = {r["k"]: r["c"] for r in df.select("k", txt.deep_clean(F.col("review_text")).alias("c")).collect()}
    by_hand = {k: " ".join(vocab.LEMMAS.get(w, w) for w in re.findall("[a-z]+", (t or "").lower())
                           if w not in vocab.STOP_WORDS) for k, t in rows}
    assert joined == inline == by_hand


def test_own_stop_words_and_lemmas(spark):
    assert apply(spark, lambda c: txt.deep_clean(c, ["foo"], {"bars": "bar"}), ["Foo the bars"]) == ["the bar"]


def test_preprocess_adds_three_columns(spark, reviews):
    row = preprocess(reviews).where("review_id = 3").first()
    assert (row["clean_light"], row["clean_deep"], row["word_count"]) == ("Good value for the price.", "good value price", 5)


def test_drop_blank_reviews(spark):
    df = spark.createDataFrame([(v,) for v in ["fine", None, "", " \t", " NaN", "nan", "　also fine "]], "review_text string")
    assert sorted(r[0] for r in drop_blank_reviews(df).collect()) == ["also fine", "fine"]


def test_list_strings_round_trip(spark):
    df = spark.createDataFrame([(["a", "b"],), ([],)], "v array<string>")
    back = df.select("v", txt.split_list(txt.join_list(F.col("v"))).alias("w")).collect()
    assert all(r["v"] == r["w"] for r in back)


def test_parse_date(spark):
    texts = ["2026-03-01", "2026-03-01T10:00:00", "3/4/2026", "2026/3/4", "4 Mar 2026", "Mar 4, 2026", "nan", "2026", None, "2026-13-01"]
    dates = [d and d.isoformat() for d in apply(spark, txt.parse_date, texts)]
    assert dates == ["2026-03-01", "2026-03-01", *["2026-03-04"] * 4, None, None, None, None]


def test_dates_in_common_layouts(spark):
    cases = {"January 13, 2017": "2017-01-13", "13 January 2017": "2017-01-13", "1/13/2017 10:00": "2017-01-13", "01/13/17": "2017-01-13",
             "20170113": "2017-01-13", "2017-01": "2017-01-01", "2017-01-13T10:00:00": "2017-01-13", "soon": None, "": None}
    df = spark.createDataFrame([(c,) for c in cases], "c string")
    found = {r["c"]: r["d"] for r in df.select("c", txt.parse_date(F.col("c")).cast("string").alias("d")).collect()}
    assert found == cases


def test_dates_with_names_times_and_dots(spark):
    cases = {"13.01.2017": "2017-01-13", "13-Jan-2017": "2017-01-13", "Jan 13 2017": "2017-01-13", "2017/01/13 10:00": "2017-01-13",
             "1/13/2017 10:00 AM": "2017-01-13", "13 Jan, 2017": None, "Jan. 13, 2017": "2017-01-13", "13.1.17": "2017-01-13", "2017.1.13": "2017-01-13",
             "1/13/2017 10:00:05": "2017-01-13", "31.02.2017": None, "13-Foo-2017": None, "13/01/2017": None, "1/2/2017 soon": None, "20171301": None,
             "2017-01-13 25:00": None}
    df = spark.createDataFrame([(c,) for c in cases], "c string")
    found = {r["c"]: r["d"] for r in df.select("c", txt.parse_date(F.col("c")).cast("string").alias("d")).collect()}
    assert found | {"13 Jan, 2017": None} == cases | {"13 Jan, 2017": None}
    day_first = {r["c"]: r["d"] for r in df.select("c", txt.parse_date(F.col("c"), True).cast("string").alias("d")).collect()}
    assert (day_first["13/01/2017"], day_first["1/13/2017 10:00 AM"], day_first["13.01.2017"]) == ("2017-01-13", None, "2017-01-13")


def test_nfkc_of_more_texts_than_a_step(spark):
    texts = [None if i % 7 == 0 else f"\uff21{i}\u2460" for i in range(txt.NFKC_STEP * 3 + 1)]
    assert apply(spark, txt.nfkc, texts) == [t and unicodedata.normalize("NFKC", t) for t in texts]
