"""Operator 10, exact top-k inner products over norm-sorted blocks with rotated partial sums.

Components become floor(scale * x), so that scores are integers; they are held as doubles, which have
every such integer exactly. Vectors are sorted by descending
length over `SLABS` ranges and packed into blocks; queries are packed too, so a block of queries meets
a block of vectors as one matrix product. Each query's k-th best score against the block of longest
vectors is a first threshold. A query block only goes to slabs whose longest vector can still reach a
threshold of it (Cauchy-Schwarz: |q| |v|). Where the two blocks meet, both are rotated by the
eigenvectors of the vectors' second moments (their right singular vectors); the product of the leading
coordinates plus the product of the lengths of the rest bounds each score, and only pairs whose bound
reaches the threshold are scored, exactly, in integers. Thresholds rise as a task goes on. The bound
never drops a pair that belongs to the result, ties included. Scores beyond the range of long are held
at its ends and tie there; a component whose product with the scale is beyond the range of double is held
at that range's end.

Vectors that are null, empty, or hold null or non-finite components take no part. Vectors of different
widths don't meet. A null id can be found (last among ties) but isn't a query. A query's candidates are all
rows but its own, so rows that repeat its id are found, and each row with a query's id is a query. An empty
table gives an empty result. Extra columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citemill.runtime import materialize, table

#: Ranges of length at least (a session with more shuffle partitions has as many), and parts of one that meet queries apart.
SLABS, SALTS, STREAMS = 64, 8, 16
BLOCK, QUERY_BLOCK = 2048, 512
LEADING = 16
NO_ID = np.iinfo(np.int64).max
LOWEST, HIGHEST = -(2**63), 2**63 - 1
#: Rotations are found from components up to this size; any rotation keeps the bound.
TURNED = 2.0**400
_BLOCKS = "slab int, block int, dim int, longest double, ids binary, body binary"


_SEEDED = pa.schema(
    [("qslab", pa.int32()), ("qblock", pa.int32()), ("dim", pa.int32()), ("need", pa.float64()), ("q_ids", pa.binary()), ("q_body", pa.binary()), ("least", pa.binary())]
)


def _lengths(vectors: list[np.ndarray] | np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.array([float(np.sqrt((v * v).sum())) for v in vectors], np.float64)


def _integers(vectors: DataFrame, id_col: str, vec_col: str, scale: float) -> DataFrame:
    """id, row (its number), dim, length, body (whole numbers as doubles) of every vector that takes part."""
    v = F.col(vec_col)
    fine = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("row"), F.when(fine, v.cast("array<double>")).alias("v"))
    rows = rows.where("v is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            with np.errstate(over="ignore"):
                flat = np.nan_to_num(np.floor(lists.flatten().to_numpy(zero_copy_only=False) * scale))
            ends = np.cumsum(lists.value_lengths().to_numpy())
            parts = np.split(flat, ends[:-1])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([len(p) for p in parts], pa.int32()),
                    pa.array(_lengths(parts), pa.float64()),
                    pa.array([p.tobytes() for p in parts], pa.binary()),
                ],
                names=["id", "row", "dim", "length", "body"],
            )

    return rows.mapInArrow(run, "id long, row long, dim int, length double, body binary")


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """Blocks of up to `size` vectors of one width, longest first, from each of `SLABS` ranges of length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        made = 0

        def pack(dim: int) -> pa.RecordBatch:
            nonlocal made
            some = held.pop(dim)
            made += 1
            ids = np.array([[NO_ID if r[1] is None else r[1] for r in some], [r[4] for r in some]], np.int64)
            return pa.RecordBatch.from_pylist(
                [{"slab": some[0][0], "block": made, "dim": dim, "longest": max(r[2] for r in some), "ids": ids.tobytes(), "body": b"".join(r[3] for r in some)}],
                schema=pa.schema([("slab", pa.int32()), ("block", pa.int32()), ("dim", pa.int32()), ("longest", pa.float64()), ("ids", pa.binary()), ("body", pa.binary())]),
            )

        for batch in batches:
            for slab, id_, row, dim, length, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.setdefault(dim, []).append((slab, id_, length, body, row))
                if len(held[dim]) == size:
                    yield pack(dim)
        for dim in list(held):
            yield pack(dim)

    slabs = max(SLABS, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartitionByRange(slabs, F.desc("length"), "id").sortWithinPartitions(F.desc("length"), "id")
    return dealt.select(F.spark_partition_id().alias("slab"), "id", "row", "dim", "length", "body").mapInArrow(run, _BLOCKS)


def _unpack(dim: int, ids: bytes, body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, row numbers and vectors of a block."""
    return *np.frombuffer(ids, np.int64).reshape(2, -1), np.frombuffer(body, np.float64).reshape(-1, dim)


def _threshold(score: int) -> float:
    """What a score must reach to tie with this one; all scores reach the lowest."""
    return -np.inf if score == LOWEST else float(score)


def _best(q_rows: np.ndarray, q: np.ndarray, ids: np.ndarray, rows: np.ndarray, v: np.ndarray, least: np.ndarray, rotate: np.ndarray, k: int):
    """(query number, vector number, score) of each query's k best that reach its threshold `least`."""
    h = min(LEADING, q.shape[1])
    q_top, v_top = np.abs(q).max(1, initial=0), np.abs(v).max(1, initial=0)
    with np.errstate(over="ignore", invalid="ignore"):  # what can't be bounded is scored
        q_len, v_len = np.sqrt((q * q).sum(1)), np.sqrt((v * v).sum(1))
        reach = np.flatnonzero(~(q_len * v_len.max() * (1 + 1e-9) + 1 < least))
        qr, vr = q[reach] @ rotate, v @ rotate
        rest_q, rest_v = np.sqrt((qr[:, h:] ** 2).sum(1)), np.sqrt((vr[:, h:] ** 2).sum(1))
        bound = qr[:, :h] @ vr[:, :h].T + np.outer(rest_q, rest_v)
        slack = np.outer(q_len[reach], v_len) * 1e-9 + 1
        alive = ~(bound + slack < least[reach, None]) & (q_rows[reach, None] != rows[None, :])
        largest = np.outer(q_top[reach], v_top) * q.shape[1]
    out = []
    for row, n in enumerate(reach):
        at = np.flatnonzero(alive[row])
        if not len(at):
            continue
        plain = largest[row, at] < 2.0**53
        if plain.all():
            score = (v[at] @ q[n]).astype(np.int64)
        else:
            score = np.zeros(len(at), np.int64)
            score[plain] = (v[at[plain]] @ q[n]).astype(np.int64)
            w = [int(x) for x in q[n]]
            score[~plain] = [min(max(sum(int(x) * y for x, y in zip(u, w, strict=True)), LOWEST), HIGHEST) for u in v[at[~plain]].tolist()]
        good = score >= least[n]
        at, score = at[good], score[good]
        order = np.lexsort((ids[at], -score))[:k]
        out.append((np.full(len(order), n), at[order], score[order]))
    if not out:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: float = 1024.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of each query's k highest scores, ties to the smaller id."""
    spark = vectors.sparkSession
    # `is_query` is a condition on the id column
    rows = materialize(_integers(vectors, id_col, vec_col, scale), "integers")
    blocks = materialize(_packed(rows, BLOCK), "blocks")
    queries = rows.withColumn(id_col, F.col("id")).where(is_query & F.col("id").isNotNull()).drop(id_col)
    queries = materialize(_packed(queries, QUERY_BLOCK), "queries")

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, ids, body in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                v = np.clip(_unpack(dim, ids, body)[2], -TURNED, TURNED)
                sums[dim] = sums.get(dim, 0) + v.T @ v
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["dim", "m"]
        )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[dim] = sums.get(dim, 0) + np.frombuffer(m)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["dim", "m"])

    kind = "dim int, m binary"  # one width squared a task, added up in two steps
    found = blocks.select("dim", "ids", "body").mapInArrow(moments, kind).withColumn("stream", F.monotonically_increasing_id() % STREAMS)
    found = found.repartition("dim", "stream").drop("stream").mapInArrow(add, kind).repartition("dim").mapInArrow(add, kind)
    total = {dim: np.frombuffer(m).reshape(dim, dim) for dim, m in found.collect()}  # one row a width
    rotations = {dim: np.ascontiguousarray(np.linalg.eigh(m)[1][:, ::-1]) for dim, m in total.items()}
    longest = blocks.groupBy("dim").agg(F.max_by(F.struct("ids", "body"), "longest").alias("top"))
    tops = {r.dim: (bytes(r.top.ids), bytes(r.top.body)) for r in longest.collect()}  # one block a width
    shared = spark.sparkContext.broadcast((rotations, tops))

    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rotations, tops = shared.value
        for batch in batches:
            for r in batch.to_pylist():
                _, q_rows, q = _unpack(r["dim"], r["ids"], r["body"])
                n, _, score = _best(q_rows, q, *_unpack(r["dim"], *tops[r["dim"]]), np.full(len(q), -np.inf), rotations[r["dim"]], k)
                least = np.full(len(q), -np.inf)
                full = np.flatnonzero(np.bincount(n, minlength=len(q)) == k)
                for i in full:
                    least[i] = _threshold(score[n == i].min())
                length = _lengths(q)
                need = np.where((length > 0) & (length < np.inf), (least - 1) / np.clip(length, 1e-300, 1e300) * (1 - 1e-9), -np.inf)
                yield pa.RecordBatch.from_pylist([{"qslab": r["slab"], "qblock": r["block"], "dim": r["dim"], "need": float(need.min()), "q_ids": r["ids"], "q_body": r["body"], "least": least.tobytes()}], schema=_SEEDED)

    seeded = materialize(queries.mapInArrow(seed, "qslab int, qblock int, dim int, need double, q_ids binary, q_body binary, least binary"), "seeded")
    slabs = blocks.groupBy("slab", "dim").agg(F.max("longest").alias("longest"))  # one row a range and width
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    sent = seeded.join(F.broadcast(slabs), "dim").where("longest >= need").drop("longest").select("*", salts)
    met = blocks.withColumn("salt", F.col("block") % SALTS).join(sent, ["slab", "dim", "salt"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rotations, _ = shared.value
        raised: dict = {}
        for batch in batches:
            for r in batch.to_pylist():
                q_ids, q_rows, q = _unpack(r["dim"], r["q_ids"], r["q_body"])
                ids, rows, v = _unpack(r["dim"], r["ids"], r["body"])
                key = (r["dim"], r["qslab"], r["qblock"])
                least = raised.setdefault(key, np.frombuffer(r["least"]).copy()) if len(raised) < 10_000 else np.frombuffer(r["least"]).copy()
                n, at, s = _best(q_rows, q, ids, rows, v, least, rotations[r["dim"]], k)
                count = np.bincount(n, minlength=len(q))
                ends = np.cumsum(count)
                for i in np.flatnonzero(count[: len(q)] == k):
                    least[i] = max(least[i], _threshold(s[ends[i] - 1]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(q_rows[n], pa.int64()),
                        pa.array(q_ids[n], pa.int64()),
                        pa.array(ids[at], pa.int64()),
                        pa.array(s, pa.int64()),
                    ],
                    names=["query", "query_id", "vec_id", "score"],
                )

    pairs = met.select("dim", "ids", "body", "qslab", "qblock", "q_ids", "q_body", "least").mapInArrow(
        score, "query long, query_id long, vec_id long, score long"
    )
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    best = pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", F.when(F.col("vec_id") != NO_ID, F.col("vec_id")).alias("vec_id"), "score")


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 highest scores of every hundredth id of `embeddings` against all other rows."""
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


ORACLE_SQL = """
with v as materialized (
  select row_number() over () as row, vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as e from embeddings
  where embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.row, q.vec_id as query_id, c.vec_id,
    list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::bigint as score
  from v q join v c on q.vec_id % 100 = 0 and c.row <> q.row and len(q.e) = len(c.e))
select query_id, row_number() over (partition by row order by score desc, vec_id nulls last)::int as rank, vec_id, score
from s qualify rank <= 10
"""
