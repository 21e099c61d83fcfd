"""Agreement and classification metrics, all from one aggregation per question."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom import vocab
from reviewloom.functions.numeric import share

LABELS = tuple(vocab.EVALUATION_LABELS)


def agreement_rate(df: DataFrame, first: str, second: str) -> DataFrame:
    """Share of rows with equal labels; a null never agrees, not even with a null."""
    return df.agg(F.avg(F.coalesce(F.col(first) == F.col(second), F.lit(False)).cast("double")).alias("agreement"))


def confusion_matrix(df: DataFrame, truth: str, predicted: str, labels: Sequence[str] = LABELS) -> DataFrame:
    """One row per true label with a column per predicted label, zeros included. One pass, no join."""
    cells = [F.count_if((F.col(truth) == t) & (F.col(predicted) == p)).alias(f"{i}_{j}")
             for i, t in enumerate(labels) for j, p in enumerate(labels)]
    rows = [F.struct(F.lit(i).alias("ordinal"), F.lit(t).alias("true_label"),
                     *[F.col(f"{i}_{j}").alias(p) for j, p in enumerate(labels)]) for i, t in enumerate(labels)]
    return df.na.drop(subset=[truth]).agg(*cells).select(F.inline(F.array(*rows)))


def _counters(df: DataFrame, truth: str, models: Mapping[str, str], labels: Sequence[str]) -> DataFrame:
    """One row per model: rows, correct rows, and per label the true, predicted and correctly predicted rows."""
    wanted = []
    for m, predicted in enumerate(models.values()):
        wanted += [F.count("*").alias(f"n{m}"), F.count_if(F.col(truth) == F.col(predicted)).alias(f"ok{m}")]
        for i, name in enumerate(labels):
            is_true, is_predicted = F.col(truth) == name, F.col(predicted) == name
            wanted += [F.count_if(is_true).alias(f"true{m}_{i}"), F.count_if(is_predicted).alias(f"said{m}_{i}"),
                       F.count_if(is_true & is_predicted).alias(f"hit{m}_{i}")]
    row = df.na.drop(subset=[truth]).agg(*wanted)
    entries = []
    for m, model in enumerate(models):
        fields = [F.lit(model).alias("model"), F.col(f"n{m}").alias("n"), F.col(f"ok{m}").alias("ok")]
        for i in range(len(labels)):
            fields += [F.col(f"{kind}{m}_{i}").alias(f"{kind}_{i}") for kind in ("true", "said", "hit")]
        entries.append(F.struct(*fields))
    return row.select(F.inline(F.array(*entries)))


def _with_label_metrics(counters: DataFrame, labels: Sequence[str]) -> DataFrame:
    added: dict[str, Column] = {}
    for i in range(len(labels)):
        hit = F.col(f"hit_{i}")
        added[f"precision_{i}"] = share(hit, F.col(f"said_{i}"))
        added[f"recall_{i}"] = share(hit, F.col(f"true_{i}"))
        added[f"f1_{i}"] = share(2 * hit, F.col(f"said_{i}") + F.col(f"true_{i}"))
    return counters.withColumns(added)


def _total(columns: Sequence[Column]) -> Column:
    return reduce(add, columns)


def classification_metrics(df: DataFrame, truth: str, models: Mapping[str, str],
                           labels: Sequence[str] = LABELS) -> DataFrame:
    """Per model: rows evaluated, accuracy, and precision, recall and F1 averaged over the labels.

    `models` maps a model name to its prediction column. A metric without a denominator is 0.
    """
    scored = _with_label_metrics(_counters(df, truth, models, labels), labels)
    macros = [(_total([F.col(f"{kind}_{i}") for i in range(len(labels))]) / len(labels)).alias(f"{kind}_macro")
              for kind in ("precision", "recall", "f1")]
    return scored.select("model", "n", share(F.col("ok"), F.col("n")).alias("accuracy"), *macros)


def classification_report(df: DataFrame, truth: str, models: Mapping[str, str],
                          labels: Sequence[str] = LABELS) -> DataFrame:
    """Per model and label: precision, recall, F1 and support, then the accuracy (as `f1`, the only value of its line), the macro and
    the support-weighted averages."""
    scored = _with_label_metrics(_counters(df, truth, models, labels), labels)
    span = range(len(labels))
    support = _total([F.col(f"true_{i}") for i in span])
    kinds = ("precision", "recall", "f1")

    def line(ordinal: int, name: str, values: Sequence[Column], count: Column) -> Column:
        return F.struct(F.lit(ordinal).alias("ordinal"), F.lit(name).alias("label"),
                        *[v.alias(k) for k, v in zip(kinds, values)], count.alias("support"))

    lines = [line(i, name, [F.col(f"{k}_{i}") for k in kinds], F.col(f"true_{i}")) for i, name in enumerate(labels)]
    lines.append(line(len(labels), "accuracy", [F.lit(None).cast("double"), F.lit(None).cast("double"), share(F.col("ok"), F.col("n"))], support))
    lines.append(line(len(labels) + 1, "macro avg",
                      [_total([F.col(f"{k}_{i}") for i in span]) / len(labels) for k in kinds], support))
    lines.append(line(len(labels) + 2, "weighted avg",
                      [share(_total([F.col(f"{k}_{i}") * F.col(f"true_{i}") for i in span]), support) for k in kinds],
                      support))
    return scored.select("model", F.inline(F.array(*lines)))
