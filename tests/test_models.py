"""Error categories, routing, and calls to injected models."""

import json

import pytest
from citemill.operators import boundary, models
from citemill.operators.routing import Settings
from pyspark.sql import functions as F

FAILURES = [
    (429, "", "RESOURCE_EXHAUSTED perDay", "quota_exhausted"),
    (429, "", "slow down", "rate_limited"),
    (None, "RateLimitError", "429 GenerateRequestsPerDay", "quota_exhausted"),
    (None, "TimeoutError", "", "timeout"),
    (403, "", "", "auth_failed"),
    (None, "AuthenticationError", "", "auth_failed"),
    (400, "", "api_key_invalid", "auth_failed"),
    (None, "", "500 oops", "server_error"),
    (None, "", "", "unknown"),
    (None, "NotFoundError", "", "invalid_request"),
    (None, "BadRequestError", "", "invalid_request"),
    (None, "UnprocessableEntityError", "", "invalid_request"),
    (404, "", "", "invalid_request"),
    (418, "", "", "invalid_request"),
    (None, "ServiceUnavailableError", "", "server_error"),
    (None, "InternalServerError", "", "server_error"),
    (None, "BadGatewayError", "", "server_error"),
    (503, "", "", "server_error"),
    (700, "", "", "unknown"),
    (None, "APIConnectionError", "", "network_error"),
    (None, "ConnectError", "", "network_error"),
    (400, "ConnectionResetError", "", "network_error"),
    (None, "OSError", "", "network_error"),
    (None, "BrokenPipeError", "", "network_error"),
    (None, "ContextWindowExceeded", "", "invalid_request"),
    (None, "NotImplementedError", "", "unsupported"),
    (None, "BudgetExhausted", "", "budget_exhausted"),
]


def test_error_categories(spark):
    df = spark.createDataFrame(FAILURES, "s int, n string, t string, want string")
    got = df.withColumn("got", boundary.error_category(F.col("s"), F.col("n"), F.col("t"))).collect()
    assert [(r.n, r.t, r.got) for r in got] == [(r.n, r.t, r.want) for r in got]
    for status, name, text, want in FAILURES:
        if name and not hasattr(__builtins__, name):
            error = type(name, (Exception,), {"status_code": status})(text)
            if name not in ("TimeoutError", "ConnectionResetError"):
                assert boundary.category_of(error) == want
    assert boundary.category_of(ConnectionResetError("gone")) == "network_error" and boundary.category_of(TimeoutError()) == "timeout"
    assert boundary.category_of(models.Invalid("x")) == "structured_output"
    kinds = spark.createDataFrame([(503, "", "", True), (400, "", "timeout", False), (None, "", "Connection reset by peer", True), (None, "OSError", "", True), (None, "", "bad", False)], "s int, n string, t string, want boolean")
    assert kinds.where(boundary.retryable(F.col("s"), F.col("n"), F.col("t")) != F.col("want")).count() == 0
    stops = spark.createDataFrame([("auth_failed", "", True), ("unknown", "daily quota used", True), ("timeout", "", False)], "c string, t string, want boolean")
    assert stops.where(boundary.stops_batch(F.col("c"), F.col("t")) != F.col("want")).count() == 0


def test_routing():
    s = Settings(fast_model="openai/qwen3:4b", answer_model="gpt-x", fallback_models="a, b,a, gpt-x", base_urls='{"openai": "http://h", "x": ""}', structured_output_models="qwen3, b")
    assert (s.model_for("answer"), s.model_for("extraction"), s.model_for("extraction", "z"), s.model_for("other")) == ("gpt-x", "openai/qwen3:4b", "z", "openai/qwen3:4b")
    assert s.fallbacks("a") == ["b", "gpt-x"] and s.candidates("answer") == ["gpt-x", "a", "b"] and s.candidates("extraction") == ["openai/qwen3:4b", "b"]
    assert [s.provider_of(m) for m in ("gemini-2", "o3-mini", "p/q", "mystery")] == ["gemini", "openai", "p", "openai"]
    assert s.endpoint_of("mystery") == "http://h" and s.endpoint_of("gemini-2") is None and s.routed("gemini-2") == "gemini/gemini-2"
    with pytest.warns(UserWarning):
        assert Settings(base_urls="[1]").endpoints() == {}
    with pytest.raises(ValueError):
        Settings(max_retries=99)
    with pytest.raises(ValueError):
        Settings(structured_output_models="none").candidates("extraction")
    assert Settings.from_env({"CITEMILL_CORPUS_CAP": "7", "CITEMILL_FALLBACK_ON_QUOTA": "yes", "CITEMILL_SERPAPI_KEY": "k"}) == Settings(corpus_cap=7, fallback_on_quota=True, serpapi_key="k")
    assert Settings(serpapi_key="k").sources()[-1] == "serpapi" and len(Settings().sources()) == 5


def _call(model, prompt):
    if prompt.startswith("down") and model == "m1":
        raise ConnectionError("refused")
    if prompt.startswith("auth"):
        raise PermissionError("invalid api key")
    if prompt.startswith("odd") and "not usable" not in prompt:
        return "no json here", None
    return f'{{"a": "{model}", "n": {len(prompt)}}}', {"prompt_tokens": 3, "completion_tokens": 4}


def test_calls_are_cached_budgeted_and_retried(spark, monkeypatch):
    settings = Settings(fast_model="m1", fallback_models="m2", max_retries=1, spend_cap=4)
    rows = [("1", "plain"), ("2", "plain"), ("3", "down"), ("4", "auth"), ("5", "odd"), ("6", "known"), ("7", "zz late")]
    prompts = spark.createDataFrame(rows, "key string, prompt string")
    cache = spark.createDataFrame([("m1", "known", "{}"), ("m2", "plain", "no")], "model string, prompt string, result string")
    monkeypatch.setattr(models, "waited", lambda *_: 0.0)
    made = models.model_calls(prompts, _call, "extraction", settings, cache, required=("a",))
    got = {r.key: r for r in made.collect()}
    assert len(got) == 7 and got["1"].result == got["2"].result and json.loads(got["1"].result)["a"] == "m1"
    assert (got["3"].model, got["3"].category) == ("m2", None) and got["3"].attempts == 3
    assert (got["4"].category, got["4"].attempts) == ("auth_failed", 1) and got["4"].result is None
    assert got["5"].attempts == 2 and got["5"].category is None
    assert got["6"].cached and got["6"].result == "{}" and got["7"].category == "budget_exhausted"
    assert tuple(models.hit_counts(made).first()) == (1, 6, 2)
    used = made.where("key = '1'").select(boundary.usage(F.col("usage")).alias("u")).first().u
    assert tuple(used) == (3, 4, 7, None)
    assert models.waited("please retry in 7s", 0) in (0.0, 7.0)


def test_embeddings_are_made_once_a_text(spark):
    texts = spark.createDataFrame([("ab",), ("ab",), ("c",), ("old",)], "text string")
    cache = spark.createDataFrame([("m", "old", [9.0, 9.0]), ("x", "c", [1.0, 1.0])], "model string, text string, vector array<double>")
    out = models.embedded(texts, lambda some: [[len(t), 1.0] for t in some], "m", cache)
    assert {r.text: tuple(r.vector) for r in out.collect()} == {"ab": (2.0, 1.0), "c": (1.0, 1.0), "old": (9.0, 9.0)} and out.count() == 3
    assert models.uniform_width(out) == 2
    with pytest.raises(ValueError):
        models.uniform_width(spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "vector array<double>"))
    m = models.pair_matrix(spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [3.0, 0.0])], "seq long, v array<double>"))
    assert {(r.i, r.j): r.score for r in m.collect()} == {(1, 1): 1.0, (2, 2): 1.0, (3, 3): 1.0, (1, 2): 0.0, (1, 3): 1.0, (2, 3): 0.0}


def test_usage_blocks(spark):
    rows = ['{"prompt_token_count": 5, "candidates_token_count": "6"}', '{"input_tokens": 1, "total_tokens": 9}', '{"prompt_tokens": "x"}', None]
    got = [tuple(r.u) for r in spark.createDataFrame([(r,) for r in rows], "b string").select(boundary.usage(F.col("b")).alias("u")).collect()]
    assert got == [(5, 6, 11, None), (1, None, 9, None), (None, None, None, None), (None, None, None, None)]


def test_extraction_projection_and_prompts(spark):
    kind = "paper_id string, paper_hash string, summary string, concepts array<struct<name:string,description:string,role:string>>, builds_on array<string>, relation string, relation_target string, stated_limitation string, inferred_open_problem string"
    rows = [("p", "h", " s ", [(" ", "", "uses"), ("net", "d", "uses")], [" x ", "", None], "extends", " y ", " our method is slow ", " why "), ("q", "h2", None, [], [], None, None, "", "open")]
    got = {r.paper_id: r for r in boundary.extraction(spark.createDataFrame(rows, kind)).collect()}
    assert (got["p"].summary, [c.name for c in got["p"].concepts], got["p"].builds_on, got["p"].relation_target) == ("s", ["net"], ["x"], "y")
    assert (got["p"].stated_limitation, got["p"].inferred_open_problem, got["q"].inferred_open_problem) == ("our method is slow", "why", "")
    assert got["p"].extraction_hash != got["q"].extraction_hash
    papers = spark.createDataFrame([(f"p{i}", f"T{i}", None if i == 1 else 2000, "a\nb" * 300) for i in range(3)], "id string, title string, year int, abstract string")
    made = boundary.batch_prompts(papers, "Topic", batch=2).orderBy("chunk").collect()
    assert len(made) == 2 and made[0].prompt.count("- id:") == 2 and "year: None" in made[0].prompt and len(made[1].prompt) < 520
    scored = boundary.scored_in_batches(papers, 2, spark.createDataFrame([("p0", 1, 5), ("p0", 2, 4), ("p1", 1, None)], "id string, seq int, score int"))
    assert {r.id: (r.chunk, r.score) for r in scored.collect()} == {"p0": (0, 4), "p1": (0, 3), "p2": (1, 3)}
