"""Pipeline events folded into one state per run, in batch and as a stream."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The order of the phases.
PHASES = ("search", "fetch", "score", "fulltext", "extract", "resolve", "graph", "traverse", "answer", "done")


def event(run_id: str, seq: int, phase: str, message: str, kind: str = "info", ts: float = 0.0, **payload) -> dict:
    """One row of an event table; phases that don't exist are refused."""
    if phase not in PHASES and phase != "error":
        raise ValueError(f"no phase {phase!r}")
    return {"run_id": run_id, "seq": seq, "phase": phase, "kind": kind, "message": message, "payload": json.dumps(payload), "ts": ts}


EVENT = "run_id string, seq long, phase string, kind string, message string, payload string, ts double"


def fold(events: DataFrame) -> DataFrame:
    """run_id, n_events, furthest, current, counter, answer, errors of (run_id, seq, phase, kind, counter, delta).

    The answer of a run is one text, so its deltas meet in one row, as they do for a reader; all else is aggregated where it lies.
    """
    parts = F.transform(F.array_sort(F.collect_list(F.struct("seq", "delta"))), lambda x: x["delta"])
    return events.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n_events"),
        F.max("phase").alias("furthest"),
        F.max_by("phase", "seq").alias("current"),
        F.max_by("counter", F.when(F.col("counter").isNotNull(), F.col("seq"))).alias("counter"),
        F.array_join(parts, "").alias("answer"),
        F.count_if(F.col("kind") == "error").alias("errors"),
    )


def _counters() -> list[tuple[str, object]]:
    """(counter, its value in an event) pairs: what the payload of a phase says; whole numbers only."""
    number = lambda *names: F.get_json_object("payload", "$." + ".".join(names)).try_cast("long")
    length = lambda name: F.json_array_length(F.get_json_object("payload", f"$.{name}")).cast("long")
    at = lambda *phases: F.col("phase").isin(*phases)
    both = number("extracted").isNotNull() & number("total").isNotNull()
    return [
        ("papers", F.when(at("fetch"), number("unique")).when(at("score"), number("papers"))),
        ("extracted", F.when(at("extract") & both, number("extracted"))),
        ("extract_total", F.when(at("extract") & both, number("total"))),
        ("extract_pending", F.when(at("extract"), number("pending"))),
        ("extracted_concepts", F.when(at("extract"), number("concepts"))),
        ("limitations", F.when(at("extract"), number("limitations"))),
        ("concepts", F.when(at("resolve"), F.coalesce(length("concept_nodes"), number("concepts")))),
        ("merge_decisions", F.when(at("resolve"), length("decisions"))),
        ("nodes", F.when(at("graph"), number("stats", "nodes"))),
        ("edges", F.when(at("graph"), number("stats", "edges"))),
        ("done_nodes", F.when(at("done"), number("graph", "nodes"))),
        ("done_edges", F.when(at("done"), number("graph", "edges"))),
        ("subgraph_nodes", F.when(at("traverse"), number("stats", "nodes"))),
        ("subgraph_edges", F.when(at("traverse"), number("stats", "edges"))),
    ]


def run_states(events: DataFrame) -> DataFrame:
    """One row a run of an event table (`EVENT`), whatever order its rows come in.

    seen (phases in order of first event), phase (the last one but `done`), counters (by name, the last value that
    a payload sets; a pending number stands in for a total, and the end's for a graph's size), answer (the deltas in order), complete, citations, error
    (the first of the answer's unless the run itself failed, whose last one counts), finished_at and elapsed.
    """
    live = F.col("phase") != "done"
    opened = events.where("phase <> 'error'").groupBy("run_id", "phase").agg(F.min("seq").alias("at"))
    seen = opened.groupBy("run_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "phase"))), lambda x: x["phase"]).alias("seen"))
    last = lambda value, known: F.max_by(value, F.when(known, F.col("seq")))
    counted = [last(value, value.isNotNull()).alias(f"c_{name}") for name, value in _counters()]
    deltas = F.array_sort(F.collect_list(F.when(F.col("kind") == "delta", F.struct("seq", "message"))))
    failed = (F.col("kind") == "error") & (F.col("phase") == "error")
    state = events.groupBy("run_id").agg(
        last(F.col("phase"), live).alias("phase"),
        F.array_join(F.transform(deltas, lambda x: x["message"]), "").alias("answer"),
        F.coalesce(F.bool_or((F.col("phase") == "answer") & (F.col("kind") == "ok")), F.lit(False)).alias("complete"),
        last(F.get_json_object("payload", "$.citations"), (F.col("phase") == "answer") & (F.col("kind") == "ok")).alias("citations"),
        F.coalesce(last(F.col("message"), failed), F.min_by("message", F.when((F.col("phase") == "answer") & (F.col("kind") == "error"), F.col("seq")))).alias("error"),
        F.max(F.when(~live, F.col("ts"))).alias("finished_at"),
        F.min("ts").alias("started_at"),
        F.max("ts").alias("latest"),
        *counted,
    )
    names = [n for n, _ in _counters()]
    spare = {"extract_total": "c_extract_pending", "nodes": "c_done_nodes", "edges": "c_done_edges"}
    value = {n: F.coalesce(f"c_{n}", spare[n]) if n in spare else F.col(f"c_{n}") for n in names if f"c_{n}" not in spare.values()}
    pairs = F.filter(F.array(*[F.struct(F.lit(n).alias("name"), v.alias("n")) for n, v in value.items()]), lambda x: x["n"].isNotNull())
    out = state.join(seen, "run_id", "left").withColumn("counters", F.map_from_entries(pairs))
    elapsed = F.greatest(F.lit(0.0), F.coalesce("finished_at", "latest") - F.col("started_at"))
    return out.select("run_id", "seen", "phase", "counters", "answer", "complete", F.from_json("citations", "array<string>").alias("citations"), "error", "finished_at", elapsed.alias("elapsed"))


HEADLINE = ("papers", "concepts", "nodes", "edges", "limitations", "subgraph_nodes", "subgraph_edges")


def counter_line(counters: dict[str, int], width: int = 0) -> str:
    """The headline counters that fit into a width, and how many more there are."""
    some = [f"{k}={counters[k]}" for k in HEADLINE if k in counters]
    if not some:
        return "no counters yet"
    for keep in range(len(some), -1, -1):
        more = len(counters) - keep
        line = "   ".join(some[:keep] + ([f"(+{more} more)"] if more else []))
        if not width or len(line) <= width:
            return line
    return line


def phase_states(runs: DataFrame, n_phases: int = len(PHASES)) -> DataFrame:
    """run_id, phase, state: done before the current phase, active at it, pending after it."""
    each = F.explode(F.sequence(F.lit(1), F.lit(n_phases))).alias("phase")
    state = F.when(F.col("phase") < F.col("current"), "done").when(F.col("phase") == F.col("current"), "active").otherwise("pending")
    return runs.select("run_id", "current", each).select("run_id", "phase", state.alias("state"))


def fold_stream(events: DataFrame) -> DataFrame:
    """The running state of each run: run_id, n_events, furthest, current, seq, errors, one row per change.

    `events` is a stream of (run_id, seq long, phase int, kind). Rows may come late: the current phase is
    that of the highest seq seen.
    """
    import pandas as pd

    def step(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, furthest, current, seq, errors = state.get if state.exists else (0, 0, 0, -1, 0)
        for part in parts:
            n += len(part)
            furthest = max(furthest, int(part["phase"].max()))
            errors += int((part["kind"] == "error").sum())
            last = part.loc[part["seq"].idxmax()]
            if last["seq"] > seq:
                seq, current = int(last["seq"]), int(last["phase"])
        state.update((n, furthest, current, seq, errors))
        yield pd.DataFrame([(key[0], n, furthest, current, seq, errors)], columns=["run_id", "n_events", "furthest", "current", "seq", "errors"])

    kind = "n_events long, furthest int, current int, seq long, errors long"
    return events.groupBy("run_id").applyInPandasWithState(step, f"run_id long, {kind}", kind, "update", "NoTimeout")


def progress(items: DataFrame, work: Callable[[DataFrame], DataFrame], batch: int, stop: Callable[[DataFrame], bool], record: Callable[[int, DataFrame], None]) -> DataFrame:
    """Work through `items` (id, ...) in batches of `batch` rows by id, `record` each batch's number and written result, and
    go on until `stop` says that a result shows a failure every further batch would share. Returns all results so far."""
    from citemill.operators.order import numbered
    from citemill.runtime import materialize

    rows = numbered(items, "id", name="_n").withColumn("_batch", F.expr(f"(_n - 1) div {batch}"))
    last = rows.agg(F.max("_batch")).first()[0]
    out = None
    for k in range(0 if last is None else int(last) + 1):
        done = materialize(work(rows.where(F.col("_batch") == k).drop("_n", "_batch")), "progress")
        record(k, done)
        out = done if out is None else out.unionByName(done)
        if stop(done):
            break
    return out if out is not None else work(items.limit(0))


def answer_events(run_id: str, chunks: Iterator[str], known: set[str], first_seq: int = 0) -> Iterator[dict]:
    """Events of an answer that comes in chunks: a delta a chunk, and an end with the valid citations and the invented ones.

    Citations may be split between chunks; they are read from the whole text.
    """
    text, seq = "", first_seq
    for chunk in chunks:
        text += chunk
        yield event(run_id, seq, "answer", chunk, "delta")
        seq += 1
    cited = list(dict.fromkeys(re.findall(r"\[([PC][0-9]+)\]", text)))
    yield event(run_id, seq, "answer", "answer complete", "ok", citations=[c for c in cited if c in known], invented=[c for c in cited if c not in known])


def throttled(spark, path: str, schema: str, per_trigger: int = 1) -> DataFrame:
    """A stream over files of events that takes a bounded number of files at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).json(path)
