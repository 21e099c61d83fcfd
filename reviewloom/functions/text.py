"""Text expressions: everything is a built-in except NFKC, which Spark does not have."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Mapping

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewloom import vocab
from reviewloom.functions.lookup import lookup, one_of

# The characters Python calls whitespace; Java's \s is ASCII only.
SPACE_RANGES = [(0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A),
                (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)]
# Characters that NFKC leaves alone next to any of each other (checked one by one in the tests). Text made of
# these needs no normalisation: Latin, Cyrillic, kana, Hangul, Han, common punctuation and most emoji.
NFKC_STABLE_RANGES = [(0x00, 0x9F), (0xA1, 0xA7), (0xA9, 0xA9), (0xAB, 0xAE), (0xB0, 0xB1), (0xB6, 0xB7), (0xBB, 0xBB),
                      (0xBF, 0x131), (0x134, 0x13E), (0x141, 0x148), (0x14A, 0x17E), (0x400, 0x481),
                      (0x2010, 0x2010), (0x2012, 0x2016), (0x2018, 0x2023), (0x20AC, 0x20AC), (0x3041, 0x3096),
                      (0x30A1, 0x30FA), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3), (0x1F300, 0x1F64F), (0x1F680, 0x1F6C5),
                      (0x1F90C, 0x1F9FF)]


def _class(ranges: Iterable[tuple[int, int]]) -> str:
    return "".join(f"\\x{{{lo:x}}}-\\x{{{hi:x}}}" for lo, hi in ranges)


# Java tests the parts of a character class one after another. The common characters are decided by one comparison:
# what lies beyond it is only looked at for characters beyond it.
SPACE = (_class(r for r in SPACE_RANGES if r[1] < 0x80)
         + f"[\\x{{85}}-\\x{{3000}}&&[{_class(r for r in SPACE_RANGES if r[1] >= 0x80)}]]")
SPACE_CHARS = "".join(chr(c) for lo, hi in SPACE_RANGES for c in range(lo, hi + 1))
NFKC_STEP = 128  # texts
NOT_SURELY_NFKC = f"[\\x{{80}}-\\x{{10ffff}}&&[^{_class(NFKC_STABLE_RANGES)}]]"

# What light cleaning removes.
URL = rf"https?://[^{SPACE}]+|www\.[^{SPACE}]+"
HTML_TAG = "<[^>]+>"


def nfkc(text: Column) -> Column:
    """NFKC form. Only texts with a character that may change are sent to Python; the rest travel as nulls. Of a batch a few
    texts at a time become Python objects."""
    @F.arrow_udf(T.StringType())
    def normalize(part: pa.Array) -> pa.Array:
        steps = (part.slice(at, NFKC_STEP).to_pylist() for at in range(0, len(part), NFKC_STEP))
        done = [pa.array([None if s is None else unicodedata.normalize("NFKC", s) for s in some], pa.string()) for some in steps]
        return pa.concat_arrays(done) if done else part
    return F.coalesce(normalize(F.when(text.rlike(NOT_SURELY_NFKC), text)), text)


def strip(text: Column) -> Column:
    """Remove whitespace, Unicode included, from both ends."""
    return F.btrim(text, F.lit(SPACE_CHARS))


def squeeze(text: Column) -> Column:
    """One blank for every run of whitespace, none at the ends."""
    return F.btrim(F.regexp_replace(text, f"[{SPACE}]+", " "))


def remove_markup(text: Column) -> Column:
    """Drop URLs, then HTML tags. The order matters: a URL in an attribute ends at the next blank."""
    return F.regexp_replace(F.regexp_replace(text, URL, ""), HTML_TAG, "")


def light_clean(text: Column) -> Column:
    """Keep case, punctuation and emoji; drop URLs and tags, normalise characters and blanks; null gives ''."""
    return squeeze(remove_markup(nfkc(F.coalesce(text, F.lit("")))))


NOT_A_LETTER = "[^a-z]+"


def deep_prepare(text: Column) -> Column:
    """Lower-case words of a-z separated by single blanks; null gives ''."""
    return F.btrim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), NOT_A_LETTER, " "))


def content_words(text: Column, stop_words: Iterable[str] | None = None,
                  lemmas: Mapping[str, str] | None = None) -> Column:
    """Words of `deep_prepare(text)` without the stop words, each replaced by its lemma.

    The text is split right where preparing it would put blanks, so the prepared string is never built.
    """
    stop = list(vocab.STOP_WORDS if stop_words is None else stop_words)
    table = vocab.LEMMAS if lemmas is None else lemmas
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_A_LETTER)
    kept = F.filter(words, lambda w: ~one_of(w, [*stop, ""]))
    return F.transform(kept, lambda w: lookup(w, table, "string", default=w))


def deep_clean(text: Column, stop_words: Iterable[str] | None = None, lemmas: Mapping[str, str] | None = None) -> Column:
    """Blank-separated lemmas of the raw text."""
    return F.array_join(content_words(text, stop_words, lemmas), " ")


def word_count(text: Column) -> Column:
    """Number of whitespace-separated words; null stays null."""
    return F.array_size(F.array_remove(F.split(text, f"[{SPACE}]+"), ""))


def words_of(text: Column) -> Column:
    """Blank-separated words of a cleaned text; '' and null give []."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), " "), lambda w: w != "")


def truncate(text: Column, length: int = 300) -> Column:
    return F.substring(text, 1, length)


def join_list(values: Column) -> Column:
    return F.array_join(values, ",")


def split_list(joined: Column) -> Column:
    """Inverse of `join_list`: '' and null give []."""
    empty = F.array().cast("array<string>")
    return F.when(F.coalesce(joined, F.lit("")) == "", empty).otherwise(F.split(joined, ","))


# Names of months, in full or by their first three letters.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
_TIME = r"(?:,?[ T]\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?: ?[AaPp]\.?[Mm]\.?)?)?"
ISO_DATE = r"^\d{4}-\d{1,2}-\d{1,2}"
YEAR_FIRST = rf"^(\d{{4}})([/.])(\d{{1,2}})\2(\d{{1,2}}){_TIME}$"
YEAR_LAST = rf"^(\d{{1,2}})([/.\-])(\d{{1,2}})\2(\d{{4}}|\d{{2}}){_TIME}$"
DAY_AND_NAME = rf"^(\d{{1,2}})[ \-]([A-Za-z]{{3,9}})\.?,?[ \-](\d{{4}}){_TIME}$"
NAME_AND_DAY = rf"^([A-Za-z]{{3,9}})\.? (\d{{1,2}}),? (\d{{4}}){_TIME}$"
COMPACT, YEAR_AND_MONTH = r"^(\d{4})(\d{2})(\d{2})$", r"^(\d{4})-(\d{2})$"


def parse_date(text: Column, day_first: Column | bool = False) -> Column:
    """Date of an ISO date or timestamp, or of another common layout, with or without a time; anything else is null.

    Numbers parted by slashes or hyphens, year last, can be read in two ways: month first, or with `day_first` the other
    way. Parted by dots the day comes first. `read_dates` decides for a whole dataset.
    """
    names = {name: number for number, full in enumerate(MONTHS, 1) for name in (full, full[:3])}
    part = lambda pattern, group: F.regexp_extract(text, pattern, group)
    month = lambda pattern, group: lookup(F.lower(part(pattern, group)), names, "int").cast("string")
    year = F.when(F.length(part(YEAR_LAST, 4)) == 2, F.concat(F.lit("20"), part(YEAR_LAST, 4))).otherwise(part(YEAR_LAST, 4))
    day_leads = (part(YEAR_LAST, 2) == ".") | (F.lit(day_first) if isinstance(day_first, bool) else F.coalesce(day_first, F.lit(False)))
    one, two = part(YEAR_LAST, 1), part(YEAR_LAST, 3)
    layouts = [(YEAR_LAST, (year, F.when(day_leads, two).otherwise(one), F.when(day_leads, one).otherwise(two))),
               (YEAR_FIRST, (part(YEAR_FIRST, 1), part(YEAR_FIRST, 3), part(YEAR_FIRST, 4))),
               (DAY_AND_NAME, (part(DAY_AND_NAME, 3), month(DAY_AND_NAME, 2), part(DAY_AND_NAME, 1))),
               (NAME_AND_DAY, (part(NAME_AND_DAY, 3), month(NAME_AND_DAY, 1), part(NAME_AND_DAY, 2))),
               (COMPACT, (part(COMPACT, 1), part(COMPACT, 2), part(COMPACT, 3))),
               (YEAR_AND_MONTH, (part(YEAR_AND_MONTH, 1), part(YEAR_AND_MONTH, 2), F.lit("1")))]
    found = F.when(text.rlike(ISO_DATE), text.try_cast("timestamp_ntz").cast("date"))
    for pattern, (y, m, d) in layouts:
        # A month without a name makes the whole text null, as a day that no month has does.
        found = found.when(text.rlike(pattern), F.concat(y, F.lit("-"), m, F.lit("-"), d).try_cast("date"))
    return found
