"""Which model serves which stage: settings, fallbacks, endpoints and capabilities. Configuration only."""

from __future__ import annotations

import json
import os
import warnings
from dataclasses import dataclass, fields

#: Stages whose answers must fit a schema.
STRUCTURED_STAGES = ("query_expansion", "relevance_scoring", "extraction", "resolution")
#: How a bare model id names its provider.
PROVIDERS = (("gemini", "gemini"), ("gpt", "openai"), ("o1", "openai"), ("o3", "openai"), ("text-embedding", "openai"), ("claude", "anthropic"))
#: Bounds of numeric settings.
BOUNDS = {"corpus_cap": (1, 10_000), "max_retries": (0, 20), "requests_per_minute": (1, 100_000), "spend_cap": (0, 10**9), "timeout_seconds": (1.0, 3600.0)}


@dataclass(frozen=True)
class Settings:
    """Settings of a run; `from_env` reads them from variables with a prefix."""

    fast_model: str = "gemini-2.5-flash"
    strong_model: str = "gemini-2.5-flash"
    structured_model: str = ""
    answer_model: str = ""
    embedding_model: str = "gemini-embedding-001"
    fallback_models: str = ""
    fallback_on_quota: bool = False
    base_urls: str = ""
    structured_output_models: str = ""
    serpapi_key: str = ""
    corpus_cap: int = 30
    max_retries: int = 5
    requests_per_minute: int = 15
    spend_cap: int = 0
    timeout_seconds: float = 120.0

    def __post_init__(self) -> None:
        for name, (low, high) in BOUNDS.items():
            if not low <= getattr(self, name) <= high:
                raise ValueError(f"{name} must lie between {low} and {high}")

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None, prefix: str = "CITEMILL_") -> Settings:
        env = os.environ if env is None else env
        given = {}
        for f in fields(cls):
            raw = env.get(prefix + f.name.upper())
            if raw is not None:
                kind = type(f.default)
                given[f.name] = raw.strip().lower() in ("1", "true", "yes", "on") if kind is bool else kind(raw)
        return cls(**given)

    def model_for(self, stage: str, explicit: str = "") -> str:
        """An explicit model wins, then the stage's role."""
        if explicit:
            return explicit
        if stage == "answer":
            return self.answer_model or self.strong_model
        return (self.structured_model or self.fast_model) if stage in STRUCTURED_STAGES else self.fast_model

    def fallbacks(self, model: str = "") -> list[str]:
        """Fallback models in order, each once, without the model itself."""
        listed = [m.strip() for m in self.fallback_models.split(",")]
        return [m for m in dict.fromkeys(listed) if m and m != model]

    def endpoints(self) -> dict[str, str]:
        """Base URLs by provider; anything malformed counts as none, with a warning."""
        if not self.base_urls.strip():
            return {}
        try:
            found = json.loads(self.base_urls)
        except json.JSONDecodeError:
            found = None
        if not isinstance(found, dict):
            warnings.warn("base_urls isn't a JSON object of provider and URL and is ignored", stacklevel=2)
            return {}
        return {str(k): str(v) for k, v in found.items() if v}

    def provider_of(self, model: str) -> str:
        """The provider that a model id names: by its prefix, else by how the id begins, else the structured model's."""
        for one in (model, self.structured_model or self.fast_model):
            if "/" in one:
                return one.partition("/")[0]
            for begin, provider in PROVIDERS:
                if one.startswith(begin):
                    return provider
        return one

    def endpoint_of(self, model: str) -> str | None:
        return self.endpoints().get(self.provider_of(model))

    def routed(self, model: str) -> str:
        """provider/model."""
        return model if "/" in model else f"{self.provider_of(model)}/{model}"

    def fits_schemas(self, model: str) -> bool:
        """Whether a model is declared to keep to a schema: an entry occurs in its id."""
        listed = [m.strip() for m in self.structured_output_models.split(",") if m.strip()]
        return any(entry in name for entry in listed for name in {model, model.partition("/")[2] or model})

    def sources(self) -> list[str]:
        """Indexes that a run asks, in order; the one that needs a key only with it."""
        return ["semantic_scholar", "openalex", "arxiv", "crossref", "dblp", *(["serpapi"] if self.serpapi_key else [])]

    def candidates(self, stage: str, explicit: str = "", can_schema=None) -> list[str]:
        """Models to try in order. For a structured stage, those alone that keep to a schema; none is an error."""
        first = self.model_for(stage, explicit)
        able = can_schema or (lambda m: not self.structured_output_models or self.fits_schemas(m))
        chain = [m for m in [first, *self.fallbacks(first)] if stage not in STRUCTURED_STAGES or able(m)]
        if not chain:
            raise ValueError(f"no model for stage {stage!r} keeps to a schema")
        return chain
