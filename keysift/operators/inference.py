"""Asking a text model: distinct prompts, a cache, and one client per task.

A client factory is any picklable callable that takes the ``ModelOptions`` of the scan, so that
an answer is filed under the options it was made with, and returns a client: a callable
from prompt to answer text. A client with ``is_available()`` or ``initialize()`` is asked whether it is there
and made ready before its first call; where one of them says no or raises, as where the factory
raises, the task's contents fail, one by one, and the task does not. A client with ``close()`` is
closed when its task is done.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keysift import schemas
from keysift.operators.answers import answer_findings, parse_answer
from keysift.operators.chunks import CHUNK_CHARS, chunk_contents, chunk_units
from keysift.operators.joins import may_match
from keysift.operators.prompts import ModelOptions, cache_key, prompt
from keysift.operators.rules import RuleSet
from keysift.session import cut_lineage

Client = Callable[[str], str]
ClientFactory = Callable[[ModelOptions], Client]
ROWS_PER_YIELD = 64
#: How the message of a content begins whose task had no client; others are failed calls.
UNAVAILABLE = "ProviderUnavailable"


def keyed_chunks(units: DataFrame, rules: RuleSet, model: ModelOptions,
                 size: int = CHUNK_CHARS) -> DataFrame:
    return chunk_units(units, size).withColumn("cache_key", cache_key(F.col("content"), rules, model))


def keyed_contents(units: DataFrame, rules: RuleSet, model: ModelOptions, size: int = CHUNK_CHARS) -> DataFrame:
    """``cache_key, content`` of every chunk, without where it stands."""
    return chunk_contents(units, size).withColumn("cache_key", cache_key(F.col("content"), rules, model))


def distinct_chunks(chunks: DataFrame) -> DataFrame:
    """``cache_key, copies``: each content once, by its key; the contents stay where they are."""
    return chunks.groupBy("cache_key").agg(F.count("*").alias("copies"))


def not_cached(distinct: DataFrame, cache: DataFrame) -> DataFrame:
    """The keys no answer is known for yet."""
    return distinct.join(cache.select("cache_key"), "cache_key", "left_anti")


def contents_of(distinct: DataFrame, chunks: DataFrame) -> DataFrame:
    """``cache_key, content, copies`` of the keys in ``distinct``.

    Contents of other keys are dropped where they are read, and copies combine before the
    shuffle, so a text repeated everywhere moves once per task.
    """
    return may_match(chunks, distinct, ["cache_key"]).select("cache_key", "content").distinct().join(distinct, "cache_key")


def prompts_for(distinct: DataFrame, rules: RuleSet) -> DataFrame:
    """``cache_key, copies, prompt``: what to ask, here or in a batch job elsewhere."""
    return distinct.select("cache_key", "copies", prompt(F.col("content"), rules).alias("prompt"))


def ready_client(client_factory: ClientFactory, model: ModelOptions) -> tuple[Client | None, str | None]:
    """A client that is there and ready, or None and why."""
    client = None
    try:
        client = client_factory(model)
        for step in ("is_available", "initialize"):
            if hasattr(client, step) and getattr(client, step)() is False:
                raise RuntimeError(f"{step}() says no")
        return client, None
    except Exception as e:  # a provider that is not there must not fail the scan
        _close(client)
        return None, f"{UNAVAILABLE}: {e}"


def _close(client: Client | None) -> None:
    if hasattr(client, "close"):
        client.close()


def ask(distinct: DataFrame, rules: RuleSet, client_factory: ClientFactory,
        model: ModelOptions = ModelOptions(), tasks: int | None = None, in_flight: int = 1, turn: int = 0) -> DataFrame:
    """``cache_key, copies, response, error``: a client's answer per content (``contents_of``).

    A call that raises counts as an empty answer; its message goes to ``error``, as does that of a client
    which is not there (UNAVAILABLE). The calls are split over ``tasks`` tasks (default: the session's shuffle partitions,
    one per core at least); more and shorter tasks lose less when an executor dies. A task has at most ``in_flight``
    calls open at a time; a client that gets several must be safe to call from threads. ``turn`` deals the contents
    differently.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, missing = ready_client(client_factory, model)

        def call(text: str) -> tuple[str, str | None]:
            if client is None:
                return "", missing
            try:
                return (client(text) or "").strip(), None
            except Exception as e:  # a failed call must not fail the scan
                return "", f"{type(e).__name__}: {e}"

        with ThreadPoolExecutor(in_flight) as pool:
            each = pool.map if in_flight > 1 else map
            try:
                for batch in batches:
                    for i in range(0, len(batch), ROWS_PER_YIELD):
                        rows = batch.iloc[i:i + ROWS_PER_YIELD]
                        answers = list(each(call, rows["prompt"]))
                        yield pd.DataFrame({
                            "cache_key": rows["cache_key"].to_numpy(), "copies": rows["copies"].to_numpy(),
                            "response": [a for a, _ in answers], "error": [e for _, e in answers]})
            finally:
                _close(client)

    spark = distinct.sparkSession
    tasks = tasks or max(spark.sparkContext.defaultParallelism,
                         int(spark.conf.get("spark.sql.shuffle.partitions")))
    by = F.col("cache_key") if not turn else F.xxhash64("cache_key", F.lit(turn))
    return prompts_for(distinct.repartition(tasks, by), rules).mapInPandas(
        run, "cache_key string, copies long, response string, error string")


def ask_again(distinct: DataFrame, chunks: DataFrame, rules: RuleSet, client_factory: ClientFactory,
              model: ModelOptions = ModelOptions(), tasks: int | None = None, in_flight: int = 1, turns: int = 1) -> DataFrame:
    """``ask`` about the keys of ``distinct``, in up to ``turns`` turns: contents whose task had no client are dealt to other
    tasks in the next one. Each turn's answers are materialised; failed calls are not repeated."""
    answers = None
    for turn in range(turns):
        asked = cut_lineage(ask(contents_of(distinct, chunks), rules, client_factory, model, tasks, in_flight, turn))
        answers = asked if answers is None else answers.unionByName(asked)
        lost = asked.where(F.col("error").startswith(UNAVAILABLE))
        if turn + 1 == turns or lost.isEmpty():
            return answers
        answers = answers.where(F.col("error").isNull() | ~F.col("error").startswith(UNAVAILABLE))
        distinct = lost.select("cache_key", "copies")


def known_answers(distinct: DataFrame, cache: DataFrame) -> DataFrame:
    """``cache_key, copies, response, error`` of the contents the cache has."""
    once = cache.groupBy("cache_key").agg(F.min("response").alias("response"))
    return distinct.select("cache_key", "copies").join(once, "cache_key").withColumn(
        "error", F.lit(None).cast("string"))


def answers_for(chunks: DataFrame, rules: RuleSet, client_factory: ClientFactory | None,
                cache: DataFrame | None = None, model: ModelOptions = ModelOptions(),
                tasks: int | None = None, in_flight: int = 1, turns: int = 1) -> DataFrame:
    """``cache_key, copies, response, error`` for every distinct content of ``chunks`` (with
    ``cache_key`` and ``content``): from the cache where it has the key, else from a client; without
    a client, from the cache only. Keys alone decide which is which; the contents that are asked
    about are fetched then. Materialised, since a call is costly and may answer differently next time."""
    distinct = distinct_chunks(chunks)
    if client_factory is None:
        return cut_lineage(known_answers(distinct, cache))
    if cache is not None:  # needed twice, and the texts are gone through for it
        distinct = cut_lineage(distinct)
    new = distinct if cache is None else cut_lineage(not_cached(distinct, cache))
    asked = ask_again(new, chunks, rules, client_factory, model, tasks, in_flight, turns)
    return asked if cache is None else asked.unionByName(cut_lineage(known_answers(distinct, cache)))


def attach_answers(chunks: DataFrame, answers: DataFrame) -> DataFrame:
    """Chunks with the parsed ``answer`` of their content, if it names a secret.

    Answers are parsed once per content and those without a secret dropped first, so
    neither content nor clean chunks take part in the join. A content that very many chunks
    share is split by Spark's skew join.
    """
    found = (answers.select("cache_key", parse_answer(F.col("response")).alias("answer"))
             .where(F.size("answer") > 0))
    return chunks.drop("content").join(found, "cache_key")


@dataclass(frozen=True)
class ModelRun:
    """What a model said about some units: ``findings`` (raw, like the regex ones), the ``answers`` they
    come from, and ``failures``, the chunks by repository whose call failed: nothing is known of those."""

    findings: DataFrame
    answers: DataFrame
    failures: DataFrame


def failed_chunks(chunks: DataFrame, answers: DataFrame) -> DataFrame:
    """``repository, failed_chunks, error`` (one of the messages), for repositories with any."""
    failed = answers.where(F.col("error").isNotNull()).select("cache_key", "error")
    return chunks.select("repository", "cache_key").join(failed, "cache_key").groupBy("repository").agg(
        F.count("*").alias("failed_chunks"), F.min("error").alias("error"))


def model_run(units: DataFrame, rules: RuleSet, client_factory: ClientFactory | None,
              model: ModelOptions = ModelOptions(), cache: DataFrame | None = None,
              size: int = CHUNK_CHARS, tasks: int | None = None, in_flight: int = 1, turns: int = 1) -> ModelRun:
    chunks = keyed_chunks(units, rules, model, size)
    answers = answers_for(keyed_contents(units, rules, model, size), rules, client_factory, cache, model, tasks, in_flight, turns)
    return ModelRun(answer_findings(attach_answers(chunks, answers)), answers, failed_chunks(chunks, answers))


def model_findings(units: DataFrame, rules: RuleSet, client_factory: ClientFactory | None,
                   model: ModelOptions = ModelOptions(), cache: DataFrame | None = None,
                   size: int = CHUNK_CHARS, tasks: int | None = None, in_flight: int = 1, turns: int = 1) -> DataFrame:
    """The model's findings in ``units`` (raw, like the regex ones)."""
    return model_run(units, rules, client_factory, model, cache, size, tasks, in_flight, turns).findings


def extend_cache(answers: DataFrame, path: str) -> None:
    """Append the answers that did not fail to a cache table."""
    (answers.where(F.col("error").isNull()).select(*schemas.RESPONSES.names)
     .write.mode("append").parquet(path))
