"""Calls to injected models from executors: cached, budgeted, retried by category, validated, with usage.

A model is a function that the caller injects: `call(model, prompt) -> (text, usage)`; usage is a dictionary or
None. It is shipped to the executors and used there, one prompt after another within a partition, paced to a
share of the allowed rate. Nothing here opens a connection itself.
"""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citemill.operators.boundary import TRANSIENT, category_of
from citemill.operators.routing import STRUCTURED_STAGES, Settings
from citemill.runtime import materialize

Call = Callable[[str, str], tuple[str, dict | None]]
_ANSWER = "key string, result string, model string, category string, message string, attempts int, usage string"


class Invalid(Exception):
    """An answer that doesn't fit what was asked for."""

    category = "structured_output"


def parsed(text: str, required: tuple[str, ...]) -> str:
    """The JSON object in an answer, with all required fields, as text."""
    first, last = text.find("{"), text.rfind("}")
    try:
        body = json.loads(text[first : last + 1])
    except json.JSONDecodeError as e:
        raise Invalid(f"no JSON object: {e}") from e
    lacking = [k for k in required if not isinstance(body, dict) or k not in body]
    if lacking:
        raise Invalid(f"fields are missing: {', '.join(lacking)}")
    return json.dumps(body, sort_keys=True)


def waited(message: str, attempt: int, cap: float = 60.0) -> float:
    """Seconds before another attempt: what the server asks for, else doubling, with jitter."""
    _, found, rest = message.lower().partition("retry in ")
    try:
        return min(float(rest.split("s")[0]), cap) if found else min(2.0**attempt, cap) * random.uniform(0.5, 1.0)
    except ValueError:
        return min(2.0**attempt, cap)


def answer(call: Call, prompt: str, models: list[str], settings: Settings, required: tuple[str, ...] | None, sleep: Callable[[float], None]) -> tuple:
    """(result, model, category, message, attempts, usage) of one prompt over the models in order.

    A transient failure is tried again on its model, up to `max_retries` times, and then on the next one; a
    quota that is used up only moves on if the settings say so; anything else ends the call. An answer that
    doesn't fit is asked for again with what was wrong.
    """
    tried, category, message = 0, "unknown", ""
    for model in models:
        asked = prompt
        for attempt in range(settings.max_retries + 1):
            tried += 1
            try:
                text, used = call(model, asked)
                result = text if required is None else parsed(text, required)
                return result, model, None, None, tried, None if used is None else json.dumps(used)
            except Exception as e:  # noqa: BLE001
                category, message = category_of(e), " ".join(str(e).split()) or type(e).__name__
                if category == "structured_output":
                    asked = f"{prompt}\n\nThe last answer was not usable ({message}). Answer again."
                elif category not in TRANSIENT:
                    break
                elif attempt < settings.max_retries:
                    sleep(waited(message, attempt))
        if not (category in TRANSIENT or (category == "quota_exhausted" and settings.fallback_on_quota)):
            break
    return None, model, category, message, tried, None


def model_calls(
    prompts: DataFrame, call: Call, stage: str, settings: Settings, cache: DataFrame | None = None, required: tuple[str, ...] | None = None, order: tuple[str, ...] = ("key",), explicit: str = "", pace: bool = False
) -> DataFrame:
    """key, result, model, category, message, attempts, usage, cached of every one of `prompts` (key, prompt).

    Answers that `cache` (model, prompt, result) holds for the first model are taken from it. The others
    are distinct prompts: each is asked once, the first `spend_cap` of them by `order` if there is a cap, and
    those beyond it have the category `budget_exhausted`. The result is written, so that no call is repeated when
    it is read again.
    """
    models = settings.candidates(stage, explicit)
    held = prompts.select("key", "prompt", *[c for c in order if c not in ("key", "prompt")])
    if cache is None:
        known = held.limit(0).select("key", F.lit("").alias("result"))
        todo = held
    else:
        one = cache.where(F.col("model") == models[0]).groupBy("prompt").agg(F.max("result").alias("result"))
        known = held.join(one, "prompt").select("key", "result")
        todo = held.join(one, "prompt", "left_anti")
    todo = materialize(todo.groupBy("prompt").agg(F.min(F.struct(*order)).alias("o"), F.collect_list("key").alias("keys")), "prompts")
    ask, over = todo, todo.limit(0)
    if settings.spend_cap:
        ask = materialize(todo.orderBy("o", "prompt").limit(settings.spend_cap), "asked")
        over = todo.join(ask.select("prompt"), "prompt", "left_anti")
    tasks = max(1, prompts.sparkSession.sparkContext.defaultParallelism)
    gap = 60.0 * tasks / settings.requests_per_minute if pace else 0.0
    asked_for = required if stage in STRUCTURED_STAGES else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = 0.0
        for batch in batches:
            out = []
            for prompt in batch.column(0).to_pylist():
                if gap:
                    time.sleep(max(0.0, last + gap - time.monotonic()))
                    last = time.monotonic()
                out.append((prompt, *answer(call, prompt, models, settings, asked_for, time.sleep)))
            kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string()]
            columns = list(zip(*out, strict=True)) if out else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["prompt", "result", "model", "category", "message", "attempts", "usage"])

    kind = "prompt string, result string, model string, category string, message string, attempts int, usage string"
    answered = materialize(ask.select("prompt").repartition(tasks).mapInArrow(run, kind), "answers")
    none = [F.lit(None).cast("string").alias(c) for c in ("result", "model")]
    spent = over.select(F.explode("keys").alias("key"), *none, F.lit("budget_exhausted").alias("category"), F.lit("over the run's budget").alias("message"), F.lit(0).alias("attempts"), F.lit(None).cast("string").alias("usage"))
    fresh = todo.join(answered, "prompt").select(F.explode("keys").alias("key"), "result", "model", "category", "message", "attempts", "usage")
    hit = known.select("key", "result", F.lit(models[0]).alias("model"), *[F.lit(None).cast("string").alias(c) for c in ("category", "message")], F.lit(0).alias("attempts"), F.lit(None).cast("string").alias("usage"))
    return fresh.unionByName(spent).withColumn("cached", F.lit(False)).unionByName(hit.withColumn("cached", F.lit(True)))


def hit_counts(answers: DataFrame) -> DataFrame:
    """One row: answers from the cache, asked for, and failed."""
    return answers.agg(F.count_if("cached").alias("hits"), F.count_if(~F.col("cached")).alias("misses"), F.count("category").alias("failed"))


def embedded(texts: DataFrame, embed: Callable[[list[str]], list[list[float]]], model: str, cache: DataFrame | None = None, batch: int = 256) -> DataFrame:
    """(text, vector) of the different texts of `texts` (text): from `cache` (model, text, vector), else by the injected function.

    Vectors of one call must have one width.
    """
    wanted = texts.select("text").distinct()
    known = cache.where(F.col("model") == model).select("text", F.col("vector").cast("array<float>").alias("vector")) if cache is not None else None
    todo = wanted if known is None else wanted.join(known.select("text"), "text", "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, batch):
                some = b.column(0).slice(at, batch)
                made = [[float(x) for x in v] for v in embed(some.to_pylist())]
                if len({len(v) for v in made}) > 1 or len(made) != len(some):
                    raise ValueError("the embedder gave vectors of several widths, or not one a text")
                yield pa.RecordBatch.from_arrays([some, pa.array(made, pa.list_(pa.float32()))], names=["text", "vector"])

    made = materialize(todo.mapInArrow(run, "text string, vector array<float>"), "embedded")
    return made if known is None else made.unionByName(known.join(wanted, "text", "left_semi"))


def uniform_width(vectors: DataFrame, column: str = "vector") -> int:
    """The one width of all vectors; an error if there are several. 0 without vectors."""
    r = vectors.agg(F.min(F.size(column)).alias("lo"), F.max(F.size(column)).alias("hi")).first()
    if r.lo != r.hi:
        raise ValueError(f"vectors of widths {r.lo} to {r.hi}")
    return r.lo or 0


def pair_matrix(vectors: DataFrame) -> DataFrame:
    """(i, j, score): cosines of all pairs i <= j of a small list of vectors (seq, v), itself included, rounded to 6 places."""
    from citemill.operators.resolve import similar_pairs

    own = vectors.select(F.col("seq").alias("i"), F.col("seq").alias("j"), F.lit(1.0).alias("score"))
    return similar_pairs(vectors, -1.0).withColumn("score", F.round("score", 6)).unionByName(own)
