"""Entity resolution of concept names: spelling groups, similar vectors, judged pairs, components."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citemill.functions import text as fx
from citemill.operators.components import connected_components
from citemill.operators.order import numbered
from citemill.runtime import materialize

AUTO, MAYBE, BUDGET = 0.92, 0.70, 40


def name_groups(mentions: DataFrame) -> DataFrame:
    """key, name (most frequent spelling; then longer, then greater), n, first, aliases, paper_ids, description, year."""
    keyed = mentions.withColumn("key", fx.normalise_name(F.col("name")))
    votes = keyed.groupBy("key", "name").agg(F.count(F.lit(1)).alias("n"))
    best = votes.groupBy("key").agg(F.max_by("name", F.struct("n", F.length("name").alias("len"), "name")).alias("name"))

    def ordered(c: str) -> Column:
        return F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("seq", c))), lambda x: x[c]))

    rest = keyed.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("seq").alias("first"),
        ordered("name").alias("aliases"),
        ordered("paper_id").alias("paper_ids"),
        F.left(F.max_by("description", F.struct(F.length("description").alias("len"), (-F.col("seq")).alias("s"))), F.lit(200)).alias("description"),
        F.min("year").alias("year"),
    )
    return best.join(rest, "key")


def similar_pairs(vectors: DataFrame, least: float = MAYBE, block: int = 2048) -> DataFrame:
    """(i, j, score) of all pairs of vectors (seq, v) with a cosine of `least` or more, i < j. Exact.

    Unit vectors are dealt by their place along one direction, the one in which they differ most, and two
    blocks meet once, unless their places lie further apart than vectors of that cosine can (sqrt(2 - 2 * least)).
    A pair of blocks is one matrix product. What meets is still a share of the square of the number of vectors,
    moved once a block: for entity-sized inputs.
    """
    import numpy as np
    import pandas as pd

    direction = _widest(vectors)
    along = F.aggregate(F.zip_with(F.col("v").cast("array<double>"), F.array(*[F.lit(float(x)) for x in direction]), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))
    norm = F.sqrt(F.aggregate(F.col("v").cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x))
    placed = vectors.select("seq", "v", F.when(norm > 0, along / norm).otherwise(0.0).alias("at"))
    rows = numbered(placed, "at", "seq").withColumn("b", F.expr(f"cast((n - 1) div {block} as int)"))
    rows = materialize(rows.drop("n"), "placed")
    spans = rows.groupBy("b").agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    apart = math.sqrt(max(0.0, 2 - 2 * least)) + 1e-9
    one, two = spans.toDF("x", "xl", "xh"), spans.toDF("y", "yl", "yh")
    met = one.join(F.broadcast(two), (F.col("x") <= F.col("y")) & (F.col("yl") - F.col("xh") <= apart)).select("x", "y")  # of blocks, not of vectors
    met = materialize(met, "meets")
    both = met.select(F.col("x").alias("b"), "x", "y").unionByName(met.where("x <> y").select(F.col("y").alias("b"), "x", "y"))
    sent = rows.drop("at").join(F.broadcast(both), "b")

    def product(part: pd.DataFrame) -> pd.DataFrame:
        x, y = int(part["x"].iloc[0]), int(part["y"].iloc[0])
        m = np.stack([np.asarray(v, float) for v in part["v"]])
        norm = np.sqrt((m * m).sum(1, keepdims=True))
        m = np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)
        seq, b = part["seq"].to_numpy(), part["b"].to_numpy()
        left, right = np.flatnonzero(b == x), np.flatnonzero(b == y)
        score = m[left] @ m[right].T
        i, j = np.nonzero(score >= least - 1e-12)
        a, c = seq[left[i]], seq[right[j]]
        ok = a < c if x == y else a != c
        return pd.DataFrame({"i": np.minimum(a, c)[ok], "j": np.maximum(a, c)[ok], "score": score[i, j][ok]})

    return sent.groupBy("x", "y").applyInPandas(product, "i long, j long, score double")


def _widest(vectors: DataFrame, sample: int = 2000) -> list[float]:
    """The direction in which up to `sample` unit vectors differ most; any direction would do for exactness."""
    import numpy as np

    some = [np.asarray(r.v, float) for r in vectors.orderBy(F.xxhash64("seq")).limit(sample).collect() if r.v]
    if not some:
        return [1.0]
    m = np.stack(some)
    norm = np.sqrt((m * m).sum(1, keepdims=True))
    m = np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)
    return np.linalg.eigh(np.cov(m.T).reshape(m.shape[1], -1))[1][:, -1].tolist() if len(m) > 1 else [1.0] + [0.0] * (m.shape[1] - 1)


def decisions(pairs: DataFrame, auto: float = AUTO, budget: int = BUDGET, judged: DataFrame | None = None) -> DataFrame:
    """(i, j, score, decision, rule): similar enough pairs merge, the most similar of the others are judged.

    `judged` is (i, j, same); a pair within the budget that it lacks stays apart, as does everything
    beyond the budget.
    """
    near = pairs.where(F.col("score") < auto)
    first = near.orderBy(F.desc("score"), "i", "j").limit(budget).select("i", "j", F.lit("judge").alias("rule"))
    asked = near.join(F.broadcast(first), ["i", "j"], "left").withColumn("rule", F.coalesce("rule", F.lit("over-budget")))
    if judged is None:
        asked = asked.withColumn("decision", F.lit("different"))
    else:
        asked = asked.join(judged, ["i", "j"], "left").withColumn("decision", F.when((F.col("rule") == "judge") & F.col("same"), "same").otherwise("different")).drop("same")
    sure = pairs.where(F.col("score") >= auto).withColumns({"rule": F.lit("auto-similarity"), "decision": F.lit("same")})
    return sure.unionByName(asked.select(*sure.columns))


def entities(made: DataFrame) -> DataFrame:
    """(id, component) of the vertices that decisions join."""
    return connected_components(made.where("decision = 'same'").select(F.col("i").alias("a"), F.col("j").alias("b")))


def resolved_concepts(mentions: DataFrame, made: DataFrame, preferred: DataFrame | None = None) -> DataFrame:
    """The concepts that mentions (seq, name, paper_id, description, year) resolve to, after the merge decisions `made`.

    Groups of a folded name are numbered by their first mention's seq, which is what `made` speaks of. The name is
    the spelling that the judge preferred most often (`preferred`: key, name), else the most frequent one; then
    the longer, then the greater. Returns component, name, slug, aliases, paper_ids, description (the longest, cut
    to 200), first_seen_year and place (1-based, by most papers, then name).
    """
    keyed = mentions.withColumn("key", fx.normalise_name(F.col("name")))
    groups = keyed.groupBy("key").agg(F.min("seq").alias("first"))
    label = entities(made).withColumnRenamed("id", "first")
    groups = groups.join(label, "first", "left").select("key", F.coalesce("component", "first").alias("component"))
    rows = keyed.join(groups, "key")
    forms = rows.groupBy("component", "name").agg(F.count(F.lit(1)).alias("n"), F.lit(0).alias("voted"))
    if preferred is not None:
        votes = rows.select("component", "key").join(preferred.select("key", "name"), "key").groupBy("component", "name").agg(F.count(F.lit(1)).alias("n"), F.lit(1).alias("voted"))
        forms = forms.unionByName(votes)
    best = forms.groupBy("component").agg(F.max_by("name", F.struct("voted", "n", F.length("name").alias("len"), "name")).alias("name"))

    def ordered(c: str) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]).alias(c)

    def united(c: str, out: str) -> DataFrame:  # value by value first: a component of any size has few different ones
        each = rows.groupBy("component", F.col(c).alias("value")).agg(F.min("seq").alias("at"))
        return each.groupBy("component").agg(ordered(out))

    rest = rows.groupBy("component").agg(
        F.left(F.max_by("description", F.struct(F.length("description").alias("len"), (-F.col("seq")).alias("s"))), F.lit(200)).alias("description"), F.min(F.nullif("year", F.lit(0))).alias("first_seen_year")
    )
    out = best.join(united("name", "aliases"), "component").join(united("paper_id", "paper_ids"), "component").join(rest, "component")
    return numbered(out.withColumn("slug", fx.slug(F.col("name"))), F.desc(F.size("paper_ids")), "name", "component", name="place")


def centroid_text(name: Column, description: Column, clip: int = 200) -> Column:
    """The text that stands for a group of mentions: the name, and the description if there is one."""
    about = F.left(fx.text_or_empty(description), F.lit(clip))
    return F.when(about == "", name).otherwise(F.concat(name, F.lit(": "), about))


def name_index(concepts: DataFrame) -> DataFrame:
    """(key, id): each folded name or alias with the first concept that has it; empty folds don't resolve."""
    spelled = concepts.select("id", "seq", F.posexplode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("pos", "s"))
    keyed = spelled.withColumn("key", fx.normalise_name(F.col("s"))).where("key <> ''")
    return keyed.groupBy("key").agg(F.min_by("id", F.struct("seq", "pos")).alias("id"))


ROLE_EDGES = {"introduces": "INTRODUCES", "limitation": "HAS_LIMITATION"}
RELATION_EDGES = {"extends": "EXTENDS", "replaces": "REPLACES", "combines": "COMBINES_WITH", "critiques": "HAS_LIMITATION", "applies-to-new-domain": "USES"}
LINE = ("extends", "replaces", "combines")


def derived_relations(extractions: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(relations, unresolved) of extractions: mentions, the stated relation, and what a paper builds on.

    relations: src, dst, type, evidence. unresolved: paper_id, name, origin, once each.
    """
    role = F.lower(F.trim("m.role"))
    mention = extractions.select("paper_id", F.explode("concepts").alias("m")).select("paper_id", F.col("m.name").alias("name"), F.col("m.role").alias("role"), role.alias("r"))
    met = mention.withColumn("key", fx.normalise_name(F.col("name"))).join(index, "key", "left")
    kind = F.create_map(*[F.lit(x) for pair in ROLE_EDGES.items() for x in pair])
    direct = met.where("id is not null").select(
        F.col("paper_id").alias("src"), F.col("id").alias("dst"), F.coalesce(F.try_element_at(kind, F.col("r")), F.lit("USES")).alias("type"), F.concat("paper_id", F.lit(": role="), "role").alias("evidence")
    )
    lost = met.where("id is null").select("paper_id", "name", F.concat(F.lit("concept:"), "role").alias("origin"))
    children = met.where("r = 'introduces' and id is not null").select("paper_id", F.col("id").alias("child")).distinct()

    stated = extractions.where(fx.text_or_empty(F.col("relation")) != "").select("paper_id", "relation", "relation_target")
    target = stated.withColumn("key", fx.normalise_name(F.col("relation_target"))).join(index, "key", "left").withColumnRenamed("id", "parent")
    lost = lost.unionByName(target.where("parent is null and coalesce(relation_target, '') <> ''").select("paper_id", F.col("relation_target").alias("name"), F.lit("relation").alias("origin")))
    lost = lost.unionByName(target.where("parent is null").select("paper_id", F.lit("").alias("name"), F.concat(F.lit("relation:"), "relation").alias("origin")))
    edge = F.create_map(*[F.lit(x) for pair in RELATION_EDGES.items() for x in pair])
    said = F.concat("paper_id", F.lit(": "), "relation", F.lit(" "), "relation_target")
    found = target.where("parent is not null").withColumns({"type": F.try_element_at(edge, F.col("relation")), "evidence": said})
    line = found.where(F.col("relation").isin(*LINE)).join(children, "paper_id").select(F.col("parent").alias("src"), F.col("child").alias("dst"), "type", "evidence")
    other = found.where(~F.col("relation").isin(*LINE)).select(F.col("paper_id").alias("src"), F.col("parent").alias("dst"), "type", "evidence")

    base = extractions.select("paper_id", F.explode("builds_on").alias("name")).withColumn("key", fx.normalise_name(F.col("name"))).join(index, "key", "left")
    lost = lost.unionByName(base.where("id is null").select("paper_id", "name", F.lit("builds_on").alias("origin")))
    built = base.where("id is not null").join(children, "paper_id").select(
        F.col("id").alias("src"), F.col("child").alias("dst"), F.lit("EXTENDS").alias("type"), F.concat("paper_id", F.lit(": builds_on "), "name").alias("evidence")
    )
    return direct.unionByName(line).unionByName(other).unionByName(built), lost.distinct()
