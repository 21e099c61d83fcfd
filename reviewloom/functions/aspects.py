"""Aspect tagging against a small keyword lexicon, within the row."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from reviewloom import vocab
from reviewloom.functions.lookup import let, text_array


def aspect_list(words: Column, lexicon: Mapping[str, Sequence[str]] | None = None) -> Column:
    """Aspects with a keyword among the words, in lexicon order. Whole words only: "worship" is not "ship"."""
    keywords = vocab.ASPECT_KEYWORDS if lexicon is None else lexicon
    return let(words, lambda found: F.array_compact(F.array(*[
        F.when(F.arrays_overlap(found, text_array(listed)), F.lit(aspect)) for aspect, listed in keywords.items()])))
