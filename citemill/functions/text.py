"""Scalar expressions over bibliographic text. All are built-in column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists, prefixes and patterns that results depend on.
DOI_PREFIXES = ("https://doi.org/", "http://doi.org/", "https://dx.doi.org/", "doi:")
TITLE_STOP = ("a", "an", "the", "of", "for", "and", "in", "on", "with", "to", "via", "using")
RANK_STOP = tuple(
    """a an and are as at be been by for from has have in is it its of on or that the
    their them these this to was were we with our us can could may might will
    would should using used use based via also more most than then so such which
    while between into over under about after before during through""".split()
)
QUESTION_STOP = tuple(
    """a an the and or of for to in on with by from is are was were be been what
    which who whom how does do did can could should would will shall may might
    between among about into over under than then them their there these those
    that this it its as at we i you they he she""".split()
)
HEDGES = ("may", "might", "could", "possibly", "potentially", "some")
PLURAL_EXCEPTIONS = ("analysis", "basis", "bias", "data", "loss", "ssm", "gas")
PRIOR_VERBS = (
    "address", "overcome", "resolve", "tackle", "alleviat", "mitigat",
    "addressing", "overcoming", "resolving", "tackling", "alleviating", "mitigating",
)
PRIOR_SUBJECTS = (
    "existing", "previous", "prior", "conventional", "traditional", "current", "earlier", "limitation of",
    "limitations of", "problem of", "problems of", "weakness", "weaknesses", "drawback", "drawbacks", "shortcoming",
)
THEMES = (
    ("scalability", ("scal", "large-scale", "large scale", "memory", "computational cost", "expensive", "efficien", "throughput", "latency")),
    ("generalisation", ("generaliz", "transfer", "cross-domain", "out-of-distribution", "unseen", "domain-specific", "other domains")),
    ("evaluation", ("evaluat", "benchmark", "dataset", "metric", "baseline", "experiment")),
    ("interpretability", ("interpret", "explainab", "transparent", "black box", "black-box", "reasoning", "human-understandable")),
    ("robustness", ("robust", "noise", "adversarial", "outlier", "perturb", "unstable", "over-smooth", "oversmooth", "stability", "converg")),
    ("data_requirements", ("annotat", "label", "training data", "supervis", "data-hungry", "few-shot", "zero-shot")),
    ("theoretical", ("theoret", "convergence proof", "bound", "guarantee", "provably")),
    ("real_world_deployment", ("real-world", "production", "deploy", "latency-critical", "hardware", "resource-constrained", "edge")),
)
CLOSURE_MARKERS = (
    "addresses", "we address", "overcomes", "solves", "resolves", "our method handles", "in contrast to", "unlike prior",
    "improves upon", "mitigates",
)
QUESTION_RULES = (
    ("comparison", (r"\bcompare\b", r"\bversus\b", r"\bvs\.?\b", r"\bdifference between\b", r"\bbetter than\b", r"\btrade[- ]?offs?\b", r"\bhow do\b.*\band\b")),
    ("gap", (r"\bgaps?\b", r"\bunsolved\b", r"\bunresolved\b", r"\bopen problems?\b", r"\blimitation", r"\bunder[- ]?explored\b", r"\bunderstudied\b", r"\bunexplored\b", r"\bnot (?:yet )?(?:been )?(?:tried|explored|studied)\b", r"\bremains?\b", r"\bwhat'?s missing\b", r"\bweakness")),
    ("lineage", (r"\blineage\b", r"\bevol", r"\bhistory of\b", r"\borigin", r"\broots?\b", r"\btrace\b", r"\bdeveloped\b", r"\bhow did\b", r"\bprogression\b")),
    ("approaches", (r"\bapproaches?\b", r"\bmethods?\b", r"\btechniques?\b", r"\bstrategies\b", r"\bmajor\b", r"\bwhat (?:methods|techniques|approaches)\b", r"\bcommonly used\b", r"\bstate of the art\b", r"\bfamilies\b")),
)
SPACE = r"[ \t\n\r\f\x0B]"


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, SPACE + "+", " "))


def normalise_doi(c: Column) -> Column:
    cleaned = F.lower(F.trim(text_or_empty(c)))
    for prefix in DOI_PREFIXES:
        cleaned = F.regexp_replace(cleaned, "^" + prefix.replace(".", r"\."), "")
    return F.when(F.startswith(cleaned, F.lit("10.")), cleaned).otherwise("")


def normalise_title(c: Column) -> Column:
    return collapse(F.regexp_replace(F.lower(text_or_empty(c)), r"[^a-z0-9 \t\n\r\f\x0B]", " "))


def title_key(c: Column) -> Column:
    words = F.filter(F.split(normalise_title(c), " "), lambda w: (w != "") & ~w.isin(*TITLE_STOP))
    return F.array_join(F.slice(F.array_sort(words), 1, 20), " ")


def content_hash(*parts: Column) -> Column:
    """The first 128 bits of SHA-256, in hexadecimal, of the parts joined by U+001F; nulls are empty."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *[text_or_empty(p.cast("string")) for p in parts]), 256), 1, 32)


def dedup_keys(doi: Column, arxiv: Column, title: Column) -> Column:
    """Match keys, most reliable first."""
    d, t = normalise_doi(doi), title_key(title)
    keys = F.array(
        F.when(d != "", F.concat(F.lit("doi:"), d)),
        F.when(text_or_empty(arxiv) != "", F.concat(F.lit("arxiv:"), F.lower(F.trim(arxiv)))),
        F.when(t != "", F.concat(F.lit("title:"), t)),
    )
    return F.filter(keys, lambda k: k.isNotNull())


def paper_id(doi: Column, arxiv: Column, title: Column) -> Column:
    d = normalise_doi(doi)
    return (
        F.when(d != "", F.concat(F.lit("doi:"), d))
        .when(text_or_empty(arxiv) != "", F.concat(F.lit("arxiv:"), F.lower(F.trim(arxiv))))
        .otherwise(F.concat(F.lit("t:"), F.substring(content_hash(title_key(title)), 1, 16)))
    )


def abstract_from_index(index: Column) -> Column:
    """Prose of an inverted index (word to positions); of words at one position the last one wins."""
    entries = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    numbered = F.transform(entries, lambda e, i: F.struct(e["p"].alias("p"), i.alias("i"), e["w"].alias("w")))
    ordered = F.array_sort(numbered)
    ahead = F.slice(ordered, F.lit(2), F.greatest(F.size(ordered), F.lit(1)))
    pairs = F.zip_with(ordered, ahead, lambda e, n: F.struct(e["w"].alias("w"), (n["p"] == e["p"]).alias("again")))
    kept = F.filter(pairs, lambda e: ~F.coalesce(e["again"], F.lit(False)))
    return F.array_join(F.transform(kept, lambda e: e["w"]), " ")


def clean_markup(c: Column) -> Column:
    return collapse(F.regexp_replace(text_or_empty(c), "<[^>]+>", " "))


def guess_year(c: Column) -> Column:
    return F.regexp_extract(text_or_empty(c), r"\b(19[5-9][0-9]|20[0-4][0-9])\b", 1).try_cast("int")


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text_or_empty(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def normalise_name(c: Column) -> Column:
    """Spelling fold of a concept name; a name that folds to nothing is its trimmed self."""
    folded = collapse(F.regexp_replace(F.replace(F.replace(F.lower(text_or_empty(c)), F.lit("ß"), F.lit("ss")), F.lit("."), F.lit("")), "[^a-z0-9]+", " "))
    return F.when(folded != "", folded).otherwise(F.trim(text_or_empty(c)))


def singular_last(words: Column) -> Column:
    """The last word without its plural s, by the conservative rule for comparison keys."""
    last = F.element_at(words, -1)
    cut = F.endswith(last, F.lit("s")) & ~F.endswith(last, F.lit("ss")) & ~last.isin(*PLURAL_EXCEPTIONS)
    return F.when(
        F.size(words) > 0,
        F.when(cut, F.concat(F.slice(words, 1, F.size(words) - 1), F.array(F.left(last, F.length(last) - 1)))).otherwise(words),
    ).otherwise(words)


def rank_tokens(c: Column) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(text_or_empty(c)), F.lit("[a-z0-9]+"), 0), lambda t: ~t.isin(*RANK_STOP))


def question_tokens(c: Column) -> Column:
    found = F.regexp_extract_all(F.lower(text_or_empty(c)), F.lit("[a-z0-9]+"), 0)
    return F.array_distinct(F.filter(found, lambda t: ~t.isin(*QUESTION_STOP) & (F.length(t) > 1)))


def node_text(label: Column, aliases: Column, description: Column) -> Column:
    parts = F.array(label, F.array_join(F.coalesce(aliases, F.array().cast("array<string>")), " "), description)
    return F.array_join(F.filter(parts, lambda p: p.isNotNull() & (p != "")), " ")


def content_terms(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text_or_empty(c)), F.lit("[a-z][a-z0-9-]{2,}"), 0))


def sentences(c: Column) -> Column:
    parts = F.transform(F.split(text_or_empty(c), r"(?<=[.!?])[ \t\n\r\f\x0B]+"), lambda s: F.trim(s))
    return F.filter(parts, lambda s: s != "")


def citations(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text_or_empty(c), F.lit(r"\[([PC][0-9]+)\]"), 1))


def contains_any(c: Column, stems: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(s)) for s in stems])


def prior_work_limitation(c: Column, verbs: tuple[str, ...] = PRIOR_VERBS, subjects: tuple[str, ...] = PRIOR_SUBJECTS) -> Column:
    lowered = F.lower(collapse(text_or_empty(c)))
    return contains_any(lowered, verbs) & contains_any(lowered, subjects)


def classify_question(c: Column, rules=QUESTION_RULES, default: str = "full_report") -> Column:
    text = F.concat(F.lit(" "), F.lower(F.trim(text_or_empty(c))), F.lit(" "))
    out = None
    for name, patterns in rules:
        hit = reduce(lambda a, b: a | b, [F.rlike(text, F.lit(p)) for p in patterns])
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(default)


def classify_theme(c: Column, themes=THEMES, default: str = "other") -> Column:
    lowered = F.lower(text_or_empty(c))
    out = None
    for name, stems in themes:
        out = F.when(contains_any(lowered, stems), name) if out is None else out.when(contains_any(lowered, stems), name)
    return out.otherwise(default)


def gap_words(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text_or_empty(c)), F.lit("[a-z][a-z-]{3,}"), 0))


def closure_signals(c: Column, markers: tuple[str, ...] = CLOSURE_MARKERS) -> Column:
    words = F.filter(gap_words(c), lambda w: (F.length(w) > 4) & ~w.isin(*markers))
    return F.when(contains_any(F.lower(text_or_empty(c)), markers), words).otherwise(F.array().cast("array<string>"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0.0 for empty or zero vectors, an error for unlike widths."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors of unlike width"))).when(norms == 0, 0.0).otherwise(dot(a, b) / norms)


def extract_json(c: Column) -> Column:
    return F.regexp_extract(text_or_empty(c), r"(?s)\{.*\}", 0)


def clip(c: Column, limit: int = 120) -> Column:
    one = collapse(text_or_empty(c))
    return F.when(F.length(one) > limit, F.concat(F.left(one, F.lit(limit - 3)), F.lit("..."))).otherwise(one)


def prompt_body(c: Column, limit: int = 4000, marker: str = " [truncated]") -> Column:
    one = collapse(text_or_empty(c))
    return F.when(F.length(one) > limit, F.concat(F.left(one, F.lit(limit)), F.lit(marker))).otherwise(one)


def prompt_hash(*prompts: Column) -> Column:
    return F.substring(content_hash(*prompts), 1, 12)


def document_text(title: Column, abstract: Column) -> Column:
    return F.concat_ws(" ", text_or_empty(title), text_or_empty(title), text_or_empty(abstract))


def concept_terms(c: Column) -> Column:
    tokens = rank_tokens(c)
    long = F.filter(tokens, lambda t: F.length(t) > 2)
    return F.when(F.size(long) > 0, long).otherwise(tokens)


def claim_supported(claim: Column, evidence: Column) -> Column:
    """Whether at least half of a claim's terms occur in the evidence; null below two terms."""
    terms = F.filter(content_terms(claim), lambda t: ~t.isin(*HEDGES))
    return F.when(F.size(terms) >= 2, F.size(F.array_intersect(terms, content_terms(evidence))) / F.size(terms) >= 0.5)


def checked_citations(answer: Column, allowed: Column) -> tuple[Column, Column]:
    """(answer without unknown labels, the unknown ones); blanks collapse only where something went."""
    unknown = F.array_except(citations(answer), allowed)
    cut = F.aggregate(unknown, text_or_empty(answer), lambda s, x: F.replace(s, F.concat(F.lit("["), x, F.lit("]")), F.lit("")))
    tidy = F.trim(F.regexp_replace(F.regexp_replace(cut, " {2,}", " "), r" ([.,;])", "$1"))
    return F.when(F.size(unknown) > 0, tidy).otherwise(text_or_empty(answer)), unknown


def request_key(prefix: Column, url: Column, params: Column) -> Column:
    """Deterministic key of a request: sorted parameters, nulls dropped."""
    pairs = F.filter(F.map_entries(params), lambda e: e["value"].isNotNull())
    joined = F.array_join(F.array_sort(F.transform(pairs, lambda e: F.concat(e["key"], F.lit("="), e["value"]))), "&")
    return F.concat_ws("|", prefix, url, joined)


def strict_sum(c: Column) -> Column:
    """The sum, or null if any value is unknown."""
    return F.when(F.count(c) == F.count(F.lit(1)), F.sum(c))


def strict_avg(c: Column) -> Column:
    return F.when((F.count(c) == F.count(F.lit(1))) & (F.count(F.lit(1)) > 0), F.avg(c))
