"""Operator 3, MinHash near-dedup by a multi-index Hamming join with exact confirmation.

A document's set holds its distinct n-word shingles (lower-cased A-Z; whole sequence if shorter). Its
signature is `chunks * width` MinHash values of 16 bits each. Two signatures are compared in Hamming
distance over those values. By the pigeonhole principle, two signatures that differ in at most
`(errors + 1) * chunks - 1` values agree in all but `errors` values of some chunk; every document
therefore emits, for each chunk, one key for each choice of `errors` masked values, and equal keys find
every such pair. With 12 chunks of 6 values and one error that is a distance of 23 of 72, and a pair at
similarity 0.8 that lies beyond still shares a key in all but 3 of 10**6 cases. Found pairs are
confirmed on full shingle sets, in integers. `exact=True` takes other keys, by which no pair can be missed:
the shingles of each set that are rarest over all documents, as many as two sets of the similarity must share
one of; it counts every shingle of every document, and is there to measure the recall of the first way.

Rows with the same set (a 128-bit fingerprint of two sums, and the size) are one vertex, so copies cost
nothing. Keys are counted once, those of one vertex alone are dropped, and of buckets with the same members
one stays. A bucket isn't expanded into pairs. In rounds, each component so far (at first each vertex) has a
few pairs confirmed, with leaders of other components that it shares most buckets with (`DRAWS`); large
groups melt together there. What is still in different components of a bucket is compared exactly: members
of buckets of up to `LARGE` pair by pair, if sizes and two bits of each signature value (in the join's own
condition) let the pair reach the similarity; larger buckets that overlap form a cluster, whose vertices
are dealt into blocks, a large component into blocks of its own. Two blocks meet in one task unless they are
of one component; their signatures are compared, and where some agree enough, all intersections of these
sets are counted as matrix products over shingles. Two components get one link at most there. A link between
different texts can only be left unconfirmed where its ends are connected anyhow, so components are those of
all links.

Groups of any size (a key, a component, copies of a text) are aggregated before they are shuffled, and joined
by `rows.meet`, which deals a hot group as its rows lie.

Null or empty texts, and texts without words, have no set, no link and their own id as component; a
null doc_id takes part, but isn't the smallest id of a group unless it is alone. Rows that share a
doc_id are judged by their own texts. An empty table gives an empty result. Extra columns don't matter,
whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citemill.llm import textkernel as tk
from citemill.llm.rows import free_name, meet, row_key, small, without
from citemill.operators.components import connected_components
from citemill.runtime import materialize, table

CHUNKS, WIDTH, ERRORS = 12, 6, 1
#: Pairs whose signatures agree in fewer than half of their values are not confirmed: at similarity 0.8
#: that is over six standard deviations away.
LEAST_AGREEING = 0.5
#: Pairs that a component tries in each of the rounds.
DRAWS = (1, 8, 8)
#: Buckets of more members are compared block by block; vertices in a block, and shingles taken to a product at once.
LARGE, BLOCK, COLUMNS = 64, 512, 4096
FINGERPRINT = ["f1", "f2", "n_shingles"]


def _signature(s: np.ndarray, sizes: np.ndarray, values: int) -> np.ndarray:
    """A row of 16-bit MinHash values for each text that has shingles."""
    begin = (np.cumsum(sizes) - sizes)[sizes > 0]
    seeds = tk.mix(np.arange(1, 2 * values + 1, dtype=tk.U) * tk.U(0xA0761D6478BD642F))
    out = np.empty((len(begin), values), np.uint16)
    for k in range(values):
        least = np.minimum.reduceat((s ^ seeds[2 * k]) * (seeds[2 * k + 1] | tk.U(1)), begin)
        out[:, k] = (tk.mix(least) >> tk.U(48)).astype(np.uint16)
    return out


def _sets(texts: pa.Array, n: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, last text + 1, shingles, set sizes) for pieces of a column."""
    for i, j, data, offs in tk.chunks(texts):
        h, doc, _, _ = tk.words(data, offs)
        yield i, j, *tk.shingle_sets(h, doc, j - i, n)


def sketches(docs: DataFrame, n: int, values: int) -> DataFrame:
    """doc_id, row (its key), fingerprint (f1, f2, n_shingles), sig and b0, b1 (two bits of its values) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, s, sizes in _sets(batch.column(2), n):
                one = tk.per_text(np.add, tk.mix(s + tk.U(0x1F83D9AB)), sizes, 0)
                two = tk.per_text(np.add, tk.mix(s ^ tk.U(0x5BE0CD19137E2179)), sizes, 0)
                sig = np.zeros((len(sizes), values), np.uint16)
                if len(s):
                    sig[sizes > 0] = _signature(s, sizes, values)
                low = (sig[:, :64] & 3).astype(tk.U)  # two bits of each value, 32 values to a word
                low = np.concatenate((low, np.zeros((len(low), 64 - low.shape[1]), tk.U)), 1)
                low = (low.reshape(-1, 2, 32) << (tk.U(2) * np.arange(32, dtype=tk.U))).sum(2, dtype=tk.U).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)),
                     pa.array(sizes, pa.int64()), pa.array([x.tobytes() for x in sig], pa.binary()), pa.array(low[:, 0]), pa.array(low[:, 1])],
                    names=["doc_id", "row", *FINGERPRINT, "sig", "b0", "b1"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row"), "text").mapInArrow(
        run, "doc_id long, row binary, f1 long, f2 long, n_shingles long, sig binary, b0 long, b1 long"
    )


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), -1)


def _masked_keys(sets: DataFrame, chunks: int, width: int, errors: int) -> DataFrame:
    """(key, vertex): for each chunk of the signature, all ways to mask `errors` of its values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = _signatures(batch.column(1)).astype(tk.U)
            keys = []
            for c in range(chunks):
                for m, kept in enumerate(combinations(range(width), width - errors)):
                    x = np.full(len(sig), c * 1000 + m + 1, tk.U)
                    for k in kept:
                        x = tk.mix(x * tk.U(0x9E3779B97F4A7C15) + sig[:, c * width + k])
                    keys.append(x)
            flat, vertex = np.stack(keys, 1).ravel().view(np.int64), np.repeat(batch.column(0).to_numpy(), len(keys))
            for at in range(0, len(flat), 100_000):
                s = slice(at, at + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(flat[s]), pa.array(vertex[s])], names=["key", "vertex"])

    return sets.select("vertex", "sig").mapInArrow(run, "key long, vertex long")


def _rare_keys(docs: DataFrame, sets: DataFrame, n: int, percent: int) -> DataFrame:
    """(key, vertex): the rarest shingles of each set, one of which any two sets of the similarity share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, _, s, sizes in _sets(batch.column(1), n):
                vertex = np.repeat(batch.column(0).to_numpy()[i : i + len(sizes)], sizes)
                for at in range(0, len(s), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(vertex[at : at + 100_000]), pa.array(s[at : at + 100_000].view(np.int64))], names=["vertex", "key"])

    uses = materialize(_texts(docs, sets).mapInArrow(run, "vertex long, key long"), "shingles")
    often = materialize(uses.groupBy("key").count().where("count > 1"), "often")
    order = F.array_sort(F.collect_list(F.struct(F.coalesce("count", F.lit(1)).alias("n"), "key")))
    ranked = meet(uses, often, ["key"], "count", "left").groupBy("vertex").agg(order.alias("all"))
    first = F.size("all") - F.ceil(F.size("all") * percent / 100) + 1
    return ranked.select("vertex", F.explode(F.slice("all", F.lit(1), first.cast("int"))).alias("k")).where("k.n > 1").select("k.key", "vertex")


def _texts(docs: DataFrame, sets: DataFrame) -> DataFrame:
    """(vertex, text): one text of each of the vertices of `sets`."""
    some = materialize(sets.select("row", "vertex"), "rows")
    rows = docs.select(row_key().alias("row"), "text").join(small(some), "row")
    return materialize(rows.groupBy("vertex").agg(F.first("text").alias("text")), "texts")


def _buckets(keyed: DataFrame) -> DataFrame:
    """(key, vertex, size): the rows of keys that more than one vertex has, one key of those with the same members."""
    shared = materialize(keyed.groupBy("key").agg(F.min("vertex").alias("lo"), F.max("vertex").alias("hi")).where("lo <> hi").select("key"), "shared")
    rows = materialize(keyed.join(small(shared), "key", "left_semi"), "keyed")
    members = rows.groupBy("key").agg(
        F.count(F.lit(1)).alias("size"), F.min("vertex").alias("lo"), F.bit_xor(F.xxhash64("vertex")).alias("x"), F.bit_xor(F.xxhash64("vertex", F.lit(2))).alias("y")
    )
    kept = materialize(members.groupBy("size", "lo", "x", "y").agg(F.min("key").alias("key")).select("key", "size"), "kept")
    return materialize(meet(rows, kept, ["key"], "size"), "buckets")


def _with_component(rows: DataFrame, label: DataFrame | None) -> DataFrame:
    if label is None:
        return rows.withColumn("component", F.col("vertex"))
    return rows.join(label, "vertex", "left").withColumn("component", F.coalesce("component", "vertex"))


def _mixed(named: DataFrame, draw: int) -> DataFrame:
    """The rows (key, vertex, size, component) of buckets that hold more than one component, with one member as
    `lead`: in draw 0 the one of the smallest component, else one drawn for each bucket."""
    order = F.xxhash64("key", "vertex", F.lit(draw)) if draw else F.col("component")
    lead = F.min(F.struct(order.alias("order"), "component", "vertex")).alias("lead")
    of = named.groupBy("key").agg(lead, F.min("component").alias("first"), F.max("component").alias("last"), F.count(F.lit(1)).alias("members"))
    of = materialize(of.where("first <> last").select("key", "lead", "members"), "leads")
    return meet(named, of, ["key"], "members").drop("members")


def _few_each(mixed: DataFrame, most: int, draw: int) -> DataFrame:
    """At most `most` pairs (a, b) for each component: of `most` lots of leaders, those that its vertices share most buckets with."""
    met = mixed.where("component <> lead.component").groupBy("component", "vertex", F.col("lead.vertex").alias("b")).count()
    lot = F.pmod(F.xxhash64("b", "vertex", F.lit(draw)), F.lit(most)).alias("lot")
    best = F.max(F.struct("count", F.xxhash64("vertex", "b").alias("tie"), F.col("vertex").alias("a"), "b")).alias("best")
    return met.groupBy("component", lot).agg(best).select("best.a", "best.b").distinct()


def _agreeing(pairs: DataFrame, sets: DataFrame, values: int, percent: int, least: float) -> DataFrame:
    """Pairs (a, b) where sizes and signatures leave a link within reach."""
    known = sets.select("vertex", "n_shingles", "sig")
    both = pairs.join(known.toDF("a", "na", "sa"), "a").join(known.toDF("b", "nb", "sb"), "b")
    both = both.where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            agree = (_signatures(batch.column(2)) == _signatures(batch.column(3))).sum(1)
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"])
            yield out.filter(pa.array(agree >= values * least))

    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _full_sets(texts: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(vertex, shingles) of the wanted vertices."""
    some = texts.join(small(wanted), "vertex", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, s, sizes in _sets(batch.column(1), n):
                end = np.cumsum(sizes)
                blobs = [s[e - k : e].tobytes() for e, k in zip(end, sizes, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(blobs, pa.binary())], names=["vertex", "shingles"])

    return materialize(some.select("vertex", "text").mapInArrow(run, "vertex long, shingles binary"), "shingles")


def _confirmed(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets satisfy 100 * intersection >= percent * union."""
    both = pairs.select("a", "b").join(full.toDF("a", "sa"), "a").join(full.toDF("b", "sb"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), tk.U), np.frombuffer(y.as_buffer(), tk.U)
                all_ = np.concatenate((x, y))
                all_.sort(kind="stable")  # merges the two runs
                same = int((all_[1:] == all_[:-1]).sum())
                ok.append(100 * same >= percent * (len(all_) - same))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _merge(label: DataFrame | None, links: DataFrame) -> DataFrame:
    """Labels (vertex, component) after further links; vertices without a label are their own component."""
    if label is None:
        return connected_components(links).withColumnRenamed("id", "vertex")
    named = links.join(label.toDF("a", "ca"), "a", "left").join(label.toDF("b", "cb"), "b", "left")
    named = named.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a <> b")
    step = materialize(connected_components(named), "step")
    moved = label.join(step.toDF("component", "to"), "component", "left").select("vertex", F.coalesce("to", "component").alias("component"))
    fresh = step.toDF("vertex", "component").join(label, "vertex", "left_anti")
    return materialize(moved.unionByName(fresh), "component")


def _across(mixed: DataFrame, sets: DataFrame, values: int, percent: int, exact: bool) -> DataFrame:
    """Pairs of different components in one bucket whose sizes and signature bits let them be linked."""
    used = min(64, values)
    apart = 1 - percent / 100
    most = int(used * apart + 6 * math.sqrt(used * (1.5 * apart - apart * apart))) + 1  # six standard deviations above the mean
    rows = mixed.join(sets.select("vertex", "n_shingles", "b0", "b1"), "vertex")
    one, two = (rows.select("key", *[F.col(c).alias(f"{x}_{c}") for c in ("vertex", "component", "n_shingles", "b0", "b1")]) for x in "ab")
    far = sum((F.bit_count(F.col(f"a_{b}").bitwiseXOR(F.col(f"b_{b}"))) for b in ("b0", "b1")), F.lit(0))
    near = (F.col("a_vertex") > F.col("b_vertex")) & (F.col("a_component") != F.col("b_component")) & (F.lit(exact) | (far <= most))
    sized = F.least("a_n_shingles", "b_n_shingles") * 100 >= F.greatest("a_n_shingles", "b_n_shingles") * percent
    return one.join(two.withColumnRenamed("key", "b_key"), (F.col("key") == F.col("b_key")) & sized & near).select(
        F.col("a_vertex").alias("a"), F.col("b_vertex").alias("b")
    ).distinct()


def _dealt(large: DataFrame) -> DataFrame:
    """(cluster, vertex, component, x, y): the vertices of `large` (vertex, component, head: a vertex of its bucket), once
    for each pair of blocks x <= y of their cluster that they take part in.

    A component of `BLOCK` vertices or more has blocks of its own, which don't meet each other; the others of a
    cluster share blocks.
    """
    cluster = connected_components(large.select(F.col("vertex").alias("a"), F.col("head").alias("b"))).toDF("vertex", "cluster")
    members = materialize(large.select("vertex", "component").distinct().join(cluster, "vertex"), "large")
    sizes = members.groupBy("cluster", "component").agg(F.count(F.lit(1)).alias("n"))
    own = sizes.withColumn("pool", F.when(F.col("n") >= BLOCK, F.col("component")))
    pools = own.groupBy("cluster", "pool").agg(F.sum("n").alias("n"))
    pools = pools.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    upto = Window.partitionBy("cluster").orderBy(F.asc_nulls_first("pool"))  # a large component is a row: vertices / BLOCK rows at most
    whole = Window.partitionBy("cluster")
    pools = pools.withColumns({"first": (F.sum("blocks").over(upto) - F.col("blocks")).cast("int"), "of": F.sum("blocks").over(whole).cast("int")})
    placed = own.drop("n").join(pools.drop("n"), (own["cluster"] == pools["cluster"]) & own["pool"].eqNullSafe(pools["pool"])).drop(pools["cluster"], pools["pool"])
    placed = materialize(placed.join(sizes, ["cluster", "component"]), "pools")
    rows = meet(members, placed, ["cluster", "component"], "n")
    rows = rows.withColumn("block", F.col("first") + F.pmod(F.xxhash64("vertex"), F.col("blocks")).cast("int"))
    mine = F.col("pool").isNotNull()
    others = F.filter(F.sequence(F.lit(0), F.col("of") - 1), lambda o: ~(mine & (o >= F.col("first")) & (o < F.col("first") + F.col("blocks"))))
    sent = rows.select("cluster", "vertex", "component", "block", F.explode(others).alias("other"))
    return sent.select("cluster", "vertex", "component", "block", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))


def _in_blocks(texts: DataFrame, sets: DataFrame, large: DataFrame, n: int, percent: int, least: float) -> DataFrame:
    """Links (a, b) between components in the clusters of `large`, one for two components and blocks."""
    import pandas as pd

    full = _full_sets(texts, large.select("vertex").distinct(), n)
    sent = _dealt(large).join(full.join(sets.select("vertex", "sig"), "vertex"), "vertex")

    def compared(part: pd.DataFrame) -> pd.DataFrame:
        x, y = int(part["x"].iloc[0]), int(part["y"].iloc[0])
        block, vertex, component = (part[c].to_numpy() for c in ("block", "vertex", "component"))
        sig = np.frombuffer(b"".join(part["sig"]), np.uint16).reshape(len(part), -1)
        sizes = np.array([len(b) // 8 for b in part["shingles"]])
        left, right = np.flatnonzero(block == x), np.flatnonzero(block == y)
        near = np.array([(sig[right] == sig[i]).sum(1) >= sig.shape[1] * least for i in left]).reshape(len(left), len(right))
        near &= (component[left][:, None] != component[right][None, :]) & (vertex[left][:, None] != vertex[right][None, :])
        near &= np.minimum(sizes[left][:, None], sizes[right][None, :]) * 100 >= np.maximum(sizes[left][:, None], sizes[right][None, :]) * percent
        if not near.any():
            return pd.DataFrame({"a": vertex[:0], "b": vertex[:0]})
        left, right, near = left[near.any(1)], right[near.any(0)], near[near.any(1)][:, near.any(0)]
        some = np.union1d(left, right)
        lists = [np.frombuffer(part["shingles"].iloc[i], tk.U) for i in some]
        left, right = np.searchsorted(some, left), np.searchsorted(some, right)
        vertex, component, sizes = vertex[some], component[some], sizes[some]
        _, column, uses = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(lists)), sizes)
        shared = uses[column] > 1  # a shingle of one set only is in no intersection
        number = np.cumsum(uses > 1) - 1
        column, owner = number[column[shared]], owner[shared]
        order = np.argsort(column, kind="stable")
        column, owner = column[order], owner[order]
        same = np.zeros((len(left), len(right)), np.float32)
        for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
            lo, hi = np.searchsorted(column, (at, at + COLUMNS))
            matrix = np.zeros((len(lists), COLUMNS), np.float32)
            matrix[owner[lo:hi], column[lo:hi] - at] = 1
            same += matrix[left] @ matrix[right].T
        union = sizes[left][:, None] + sizes[right][None, :] - same
        i, j = np.nonzero(near & (100 * same.astype(np.int64) >= percent * union.astype(np.int64)))
        found = pd.DataFrame({"a": vertex[left[i]], "b": vertex[right[j]], "ca": component[left[i]], "cb": component[right[j]]})
        return found.drop_duplicates(["ca", "cb"])[["a", "b"]]

    return sent.groupBy("cluster", "x", "y").applyInPandas(compared, "a long, b long")


def near_duplicates(
    docs: DataFrame, n: int = 5, percent: int = 80, chunks: int = CHUNKS, width: int = WIDTH, errors: int = ERRORS, exact: bool = False
) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable), kept, row (its key) and component (null for rows that are
    alone) of every row of `docs`."""
    values = chunks * width
    least = 0.0 if exact else LEAST_AGREEING
    sketched = materialize(sketches(docs, n, values), "sketches")
    sets = sketched.where("n_shingles > 0").groupBy(*FINGERPRINT).agg(
        *[F.first(c).alias(c) for c in ("sig", "b0", "b1", "row")], F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies")
    )
    sets = materialize(sets.withColumn("vertex", F.monotonically_increasing_id()), "sets")
    buckets = _buckets(materialize(_rare_keys(docs, sets, n, percent), "rare") if exact else _masked_keys(sets, chunks, width, errors))
    met = materialize(buckets.select("vertex").distinct(), "met")
    label = _linked(docs, sets.join(small(met), "vertex", "left_semi"), buckets, n, percent, values, least, exact) if met.limit(1).count() else None

    several = sets.select(*FINGERPRINT, "vertex", "first_id", "copies")
    if label is None:
        several = several.where("copies > 1").select(*FINGERPRINT, F.col("vertex").alias("component"), F.col("first_id").alias("smallest"), "copies")
    else:
        several = several.join(label, "vertex", "left").where("copies > 1 or component is not null")
        several = materialize(several.withColumn("component", F.coalesce("component", "vertex")), "several")
        of = several.groupBy("component").agg(F.min("first_id").alias("smallest"), F.count(F.lit(1)).alias("vertices"))
        several = meet(several, materialize(of, "smallest"), ["component"], "vertices").select(*FINGERPRINT, "component", "smallest", "copies")
    out = meet(sketched.select("doc_id", "row", *FINGERPRINT), materialize(several, "several"), FINGERPRINT, "copies", "left")
    # rows of a group whose ids are all null, and rows that are alone, have their own id
    out = out.withColumn("component_id", F.coalesce("smallest", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "row", "component")


def _linked(docs: DataFrame, sets: DataFrame, buckets: DataFrame, n: int, percent: int, values: int, least: float, exact: bool) -> DataFrame:
    """(vertex, component) of all vertices that have a link, found in `buckets`."""
    sets = materialize(sets, "met_sets")
    texts = _texts(docs, sets)

    def links(pairs: DataFrame) -> DataFrame:
        pairs = materialize(_agreeing(pairs, sets, values, percent, least), "pairs")
        ends = materialize(pairs.select(F.col("a").alias("vertex")).union(pairs.select("b")).distinct(), "ends")
        return materialize(_confirmed(pairs, _full_sets(texts, ends, n), percent), "links")

    label = None
    for draw, most in enumerate(DRAWS):
        label = _merge(label, links(_few_each(_mixed(_with_component(buckets, label), draw), most, draw)))
    mixed = materialize(_mixed(_with_component(buckets, label), 0), "mixed")
    large = mixed.where(F.col("size") > LARGE).select("vertex", "component", F.col("lead.vertex").alias("head"))
    if large.limit(1).count():
        label = _merge(label, materialize(_in_blocks(texts, sets, large, n, percent, least), "links"))
    few = mixed.where(F.col("size") <= LARGE).select("key", "vertex", "size")
    return _merge(label, links(_across(_mixed(_with_component(few, label), 0), sets, values, percent, exact)))


def without_near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """`docs` with one row of each group of near duplicates: one of the smallest id, of these the smallest key."""
    found = materialize(near_duplicates(docs, n, percent), "near")
    members = found.where("component is not null")
    stays = members.groupBy("component").agg(F.min(F.when(F.col("kept"), F.col("row"))).alias("stays"), F.count(F.lit(1)).alias("rows"))
    gone = meet(members, materialize(stays, "stays"), ["component"], "rows").where("row <> stays").select("row").distinct()
    left = without(docs, materialize(gone, "gone"))
    # rows that repeat in full share a key: one of them stays
    repeated = materialize(members.groupBy("row").count().where("count > 1").select("row"), "repeated")
    key = free_name(docs, "_row")
    again = left.withColumn(key, row_key()).join(small(repeated.toDF(key)), key, "left_semi")
    return without(left, repeated).unionByName(again.dropDuplicates([key]).select(*docs.columns))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All `documents` under 2-word shingles at similarity 0.8: doc_id, n_shingles, component_id, kept."""
    found = near_duplicates(table(spark, sf_dir, "documents"), n=2, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", "kept")
