"""The interactive chain: clean, score, tag. One narrow plan over the raw rows."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.operators.aspects import Lexicon, add_aspect_flags, tag_aspects
from reviewloom.operators.cleaning import preprocess
from reviewloom.operators.scoring import Scorer, WordModel, score_external, score_lexicon, score_model
from reviewloom.schema import TEXT, require_columns


def analyze(df: DataFrame, model: WordModel | PipelineModel | None = None, load_model: Callable[[], Scorer] | None = None,
            lexicon: Lexicon | None = None, valences: Mapping[str, float] | None = None, key: str | None = None) -> DataFrame:
    """Add the cleaned texts, `sentiment`, `confidence`, `aspects` and one flag per aspect.

    Sentiment comes from a fitted pipeline, from a caller's model, or by default from the valence lexicon, whose
    confidence is the absolute compound score. Also works on a streaming DataFrame, since no row needs another; only a
    word model does not, which joins texts to its table (`key` as in `score_model`).
    """
    require_columns(df, TEXT)
    if model is not None and load_model is not None:
        raise ValueError("give model or load_model, not both")
    cleaned = preprocess(df)
    if model is not None:
        scored = score_model(cleaned, model, label="sentiment", confidence="confidence", key=key)
    elif load_model is not None:
        scored = score_external(cleaned, load_model, label="sentiment", confidence="confidence")
    else:
        scored = score_lexicon(cleaned, valences=valences, score="confidence", label="sentiment")
        scored = scored.withColumn("confidence", F.abs("confidence"))
    return add_aspect_flags(tag_aspects(scored, lexicon), lexicon)
