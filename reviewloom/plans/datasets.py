"""From an uploaded table to a stored dataset, and from stored datasets to strategies."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.operators.profiling import dataset_fingerprint, guess_mapping
from reviewloom.operators.scoring import Scorer, WordModel
from reviewloom.operators.strategy import Writer, ask_writer, strategy_context, strategy_documents, strategy_prompts
from reviewloom.plans.analyze import analyze
from reviewloom.schema import ColumnMapping
from reviewloom.sources.stages import write_stage
from reviewloom.sources.store import ReviewStore
from reviewloom.sources.workspace import fresh_path


def ingest(store: ReviewStore, uploaded: DataFrame, name: str, mapping: ColumnMapping | None = None,
           model: WordModel | PipelineModel | None = None, load_model: Callable[[], Scorer] | None = None) -> str:
    """Analyse and store a table under an id made of `name` and its content; content seen before is not redone.

    Without a mapping the columns are guessed. Returns the dataset id.
    """
    mapped = (mapping or guess_mapping(uploaded)).apply(uploaded)
    dataset_id = dataset_fingerprint(mapped, name).first()["fingerprint"]
    if not store.dataset_exists(dataset_id):
        store.save_analysis(analyze(mapped, model, load_model), dataset_id)
    return dataset_id


def write_strategies(store: ReviewStore, load_writer: Callable[[], Writer], dataset_id: str | None = None,
                     max_aspects: int = 3, examples: int = 3, writer: str | None = None) -> None:
    """Let a writer answer the prompt of every stored dataset, or of one, and store the answers and the strategies in them.

    A prompt is asked once: answers are stored as they come, before anything is made of them, and prompts that the same
    writer has answered are not asked again. `writer` names the writer; without it a digest of `load_writer` does.
    """
    name = writer or hashlib.sha256(cloudpickle.dumps(load_writer)).hexdigest()
    context = strategy_context(store.reviews(dataset_id), store.aspects(dataset_id), max_aspects, examples)
    prompts = write_stage(strategy_prompts(context).withColumn("prompt_digest", F.sha2("prompt", 256)), fresh_path(store.spark, "prompts"))
    asked = store.answers().where(F.col("writer") == name).select("prompt_digest")
    fresh = prompts.dropDuplicates(["prompt_digest"]).join(asked, "prompt_digest", "left_anti")
    if not fresh.isEmpty():
        store.save_answers(ask_writer(fresh, load_writer).withColumns({"writer": F.lit(name), "asked_at": F.current_timestamp()}))
    known = (store.answers().where(F.col("writer") == name).groupBy("prompt_digest").agg(F.max_by("answer", "asked_at").alias("answer")))
    answered = prompts.join(known, "prompt_digest").select("dataset_id", "answer")
    store.save_strategies(strategy_documents(answered).select("dataset_id", "strategy_json"))
