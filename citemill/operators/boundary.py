"""The boundary to models: deterministic offline defaults, error categories, stops, usage and budgets.

Calls themselves are in `models`, choices of model in `routing`.
"""

from __future__ import annotations

import builtins
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citemill.functions import text as fx
from citemill.operators.order import numbered

BATCH, DEFAULT_SCORE = 10, 3
# What names a period's allowance, what a stop on credentials looks for, retried statuses and phrases.
PERIOD_MARKERS = ("perday", "per_day", "per-day", "daily free-tier", "dailyquota")
RETRIED_STATUS = (408, 429, 500, 502, 503, 504)
RETRIED_PHRASES = ("disconnected", "connection reset", "connection refused", "timed out", "timeout", "overloaded", "unavailable", "resource_exhausted", "too many requests")
DAILY_PHRASES = ("daily free-tier quota", "daily quota")
#: Categories whose failures may pass: they are tried again, on the same model or another.
TRANSIENT = ("timeout", "rate_limited", "server_error", "network_error")
#: What a failure's type name may be where the system itself failed.
SYSTEM_ERRORS = tuple(sorted(k.lower() for k, v in vars(builtins).items() if isinstance(v, type) and issubclass(v, OSError)))
#: category, parts of the type name, parts of the message, ranges of statuses, whole type names: the first rule that any part fits wins.
RULES: tuple[tuple[str, tuple[str, ...], tuple[str, ...], tuple[tuple[int, int], ...], tuple[str, ...]], ...] = (
    ("timeout", ("timeout",), ("timeout",), (), ()),
    ("budget_exhausted", ("budgetexhausted", "quotaexhausted"), (), (), ()),
    ("unsupported", ("unsupported", "notimplemented"), (), (), ()),
    (
        "auth_failed",
        ("authentication", "permissiondenied"),
        ("unauthenticated", "permission_denied", "invalid api key", "api_key_invalid", "invalid credentials", "credential"),
        ((401, 401), (403, 403)),
        (),
    ),
    ("invalid_request", ("contextwindow",), ("context_length",), (), ()),
    ("rate_limited", ("ratelimit",), (), ((429, 429),), ()),
    ("invalid_request", ("notfound", "badrequest", "invalidrequest", "unprocessable"), (), ((404, 404),), ()),
    ("server_error", ("serviceunavailable", "internalserver", "badgateway"), (), ((500, 599),), ()),
    ("network_error", ("connect",), (), (), SYSTEM_ERRORS),
    ("invalid_request", (), (), ((400, 499),), ()),
)


def scored_in_batches(docs: DataFrame, batch: int = BATCH, given: DataFrame | None = None, score: int = DEFAULT_SCORE) -> DataFrame:
    """(id, chunk, score): rows numbered by id in chunks of `batch`, with the scores that `given` (id, seq, score) assigns.

    The later of several scores of an id wins; a row without one gets the default.
    """
    rows = numbered(docs.select("id"), "id").select("id", F.expr(f"(n - 1) div {batch}").alias("chunk"))
    if given is None:
        return rows.withColumn("score", F.lit(score))
    last = given.where("score is not null").groupBy("id").agg(F.max_by("score", "seq").alias("score"))
    return rows.join(last, "id", "left").select("id", "chunk", F.coalesce("score", F.lit(score)).alias("score"))


def relevance_histogram(scored: DataFrame) -> DataFrame:
    """(score, n): records by their score, `unscored` for those without one."""
    return scored.groupBy(F.coalesce(F.col("score").cast("string"), F.lit("unscored")).alias("score")).agg(F.count(F.lit(1)).alias("n"))


def batch_prompts(papers: DataFrame, title: str, batch: int = BATCH, clip: int = 400) -> DataFrame:
    """(chunk, prompt): the text that asks a model for the scores of a batch, abstracts cut to `clip` characters as the prompt's rule is."""
    rows = numbered(papers.select("id", "title", "year", "abstract"), "id")
    snippet = F.replace(F.left(fx.text_or_empty(F.col("abstract")), F.lit(clip)), F.lit("\n"), F.lit(" "))
    line = F.concat(F.lit("- id: "), "id", F.lit("\n  title: "), "title", F.lit("\n  year: "), F.coalesce(F.col("year").cast("string"), F.lit("None")), F.lit("\n  abstract: "), snippet)
    parts = F.array_sort(F.collect_list(F.struct("n", line.alias("line"))))
    return rows.groupBy(F.expr(f"(n - 1) div {batch}").alias("chunk")).agg(
        F.concat(F.lit(f"Rate how relevant each paper is to: {title}\n\n"), F.array_join(F.transform(parts, lambda x: x["line"]), "\n")).alias("prompt")
    )


def extraction(facts: DataFrame) -> DataFrame:
    """Extractions of parsed model answers (paper_id, paper_hash, summary, concepts, builds_on, relation, relation_target,
    stated_limitation, inferred_open_problem).

    Names and texts are trimmed and blank ones dropped; a limitation of other work isn't one of the paper's own, and
    without a limitation there is no open problem.
    """
    limit = F.trim(fx.text_or_empty(F.col("stated_limitation")))
    own = F.when(fx.prior_work_limitation(limit), "").otherwise(limit)
    named = F.filter("concepts", lambda c: F.trim(fx.text_or_empty(c["name"])) != "")
    base = F.filter(F.transform("builds_on", lambda b: F.trim(b)), lambda b: fx.text_or_empty(b) != "")
    made = facts.select(
        "paper_id", "paper_hash", F.trim(fx.text_or_empty(F.col("summary"))).alias("summary"), named.alias("concepts"), base.alias("builds_on"), "relation",
        F.trim(fx.text_or_empty(F.col("relation_target"))).alias("relation_target"), own.alias("stated_limitation"),
        F.when(own == "", "").otherwise(F.trim(fx.text_or_empty(F.col("inferred_open_problem")))).alias("inferred_open_problem"),
    )
    parts = [F.col(c) for c in ("paper_hash", "summary", "relation", "relation_target", "stated_limitation", "inferred_open_problem")]
    return made.withColumn("extraction_hash", fx.content_hash(*parts, F.to_json("concepts"), F.to_json("builds_on")))


def mentions(extractions: DataFrame, papers: DataFrame | None = None) -> DataFrame:
    """paper_id, place (1-based), name, role, description, year: the concepts that extractions name, blank names dropped."""
    rows = extractions.select("paper_id", F.posexplode("concepts").alias("at", "m")).where(F.trim(fx.text_or_empty(F.col("m.name"))) != "")
    fields = {f.name for f in extractions.schema["concepts"].dataType.elementType.fields}
    said = F.col("m.description") if "description" in fields else F.lit("")
    rows = rows.select("paper_id", (F.col("at") + 1).alias("place"), "m.name", "m.role", said.alias("description"))
    if papers is None:
        return rows
    return rows.join(papers.select(F.col("id").alias("paper_id"), "year"), "paper_id", "left")


def usage(block: Column) -> Column:
    """(input, output, total, reasoning) tokens of a provider's usage block as JSON text, under any of three spellings.

    What isn't a whole number stays unknown; a missing total is the sum of two known parts.
    """

    def read(*names: str) -> Column:
        raw = F.coalesce(*[F.get_json_object(block, f"$.{n}") for n in names])
        return raw.try_cast("double").try_cast("long")

    given, made = read("prompt_tokens", "prompt_token_count", "input_tokens"), read("completion_tokens", "candidates_token_count", "output_tokens")
    total = F.coalesce(read("total_tokens", "total_token_count"), given + made)
    return F.struct(given.alias("input"), made.alias("output"), total.alias("total"), read("reasoning_tokens").alias("reasoning"))


def hashed_embedding(c: Column, width: int = 64) -> Column:
    """A deterministic bag-of-tokens vector: each token adds one at its hashed place."""
    places = F.transform(fx.rank_tokens(c), lambda t: F.pmod(F.xxhash64(t), F.lit(width)))
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.size(F.filter(places, lambda p: p == i)).cast("float"))


def rule_extraction(papers: DataFrame) -> DataFrame:
    """Offline extraction: the sentences of an abstract that state a limitation of its own, by theme words."""
    own = F.filter(fx.sentences(F.col("abstract")), lambda s: (fx.classify_theme(s) != "other") & ~fx.prior_work_limitation(s))
    return papers.select(F.col("id").alias("paper_id"), F.coalesce(F.get(own, F.lit(0)), F.lit("")).alias("stated_limitation"))


def error_category(status: Column, name: Column, text: Column) -> Column:
    """The category of a provider's failure, from its status, type name and message; see `RULES`."""
    n, t = F.lower(fx.text_or_empty(name)), F.lower(fx.text_or_empty(text))
    code = F.coalesce(F.when(status.between(100, 599), status), F.regexp_extract(t, r"\b([45][0-9][0-9])\b", 1).try_cast("int"))
    period = fx.contains_any(t, ("resource_exhausted", "429")) & fx.contains_any(t, PERIOD_MARKERS)
    out = None
    for category, names, texts, statuses, whole in RULES:
        fits = F.lit(False)
        for part in (fx.contains_any(n, names) if names else None, fx.contains_any(t, texts) if texts else None, n.isin(*whole) if whole else None):
            fits = fits if part is None else fits | part
        for low, high in statuses:
            fits = fits | F.coalesce(code.between(low, high), F.lit(False))
        value = F.when(period, "quota_exhausted").otherwise(category) if category == "rate_limited" else F.lit(category)
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out.otherwise("unknown")


def category_of(error: BaseException) -> str:
    """`error_category` of a Python exception; one that already has a category keeps it."""
    known = getattr(error, "category", None)
    if isinstance(known, str):
        return known
    name, text = type(error).__name__.lower(), str(error).lower()
    holders = (error, getattr(error, "response", None))
    codes = [v for h in holders for k in ("status_code", "code", "http_status", "status") if isinstance(v := getattr(h, k, None), int) and 100 <= v < 600]
    codes += [int(x) for x in re.findall(r"\b([45]\d\d)\b", text)[:1]]
    code = codes[0] if codes else None
    system = name in SYSTEM_ERRORS or isinstance(error, OSError)
    for category, names, texts, statuses, whole in RULES:
        by_status = code is not None and any(low <= code <= high for low, high in statuses)
        by_type = (category == "timeout" and isinstance(error, TimeoutError)) or (bool(whole) and system)
        if by_status or by_type or any(p in name for p in names) or any(p in text for p in texts):
            daily = any(p in text for p in ("resource_exhausted", "429")) and any(p in text for p in PERIOD_MARKERS)
            return "quota_exhausted" if category == "rate_limited" and daily else category
    return "unknown"


def retryable(status: Column, name: Column, text: Column) -> Column:
    """Whether a failure may pass: by its status where it has one, else by its type or message."""
    dropped = F.lower(fx.text_or_empty(name)).isin(*SYSTEM_ERRORS) | fx.contains_any(F.lower(fx.text_or_empty(text)), RETRIED_PHRASES)
    return F.when(status.between(100, 599), status.isin(*RETRIED_STATUS)).otherwise(dropped)


def stops_batch(category: Column, text: Column) -> Column:
    """Whether a failure is systemic, so that every further call of a batch would fail alike."""
    return category.isin("auth_failed", "budget_exhausted", "quota_exhausted") | fx.contains_any(F.lower(fx.text_or_empty(text)), DAILY_PHRASES)


def within_budget(rows: DataFrame, most: int, order: list[str]) -> DataFrame:
    """The first `most` rows, which is all that a capped model call may see."""
    return rows.orderBy(*order).limit(most)
