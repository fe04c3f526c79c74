"""Exact top-k inner-product search by norm buckets.

Vectors are grouped by length. Against a bucket whose longest vector is ``m``,
a query ``q`` that already holds ``k`` scores of ``theta`` or more needs a
local cosine of ``theta / (|q| m)`` from any newcomer:

* above 1 no vector of the bucket can enter and the bucket is skipped;
* at ``COORDINATE_COSINE`` or more, unit vectors must lie near the query in
  each coordinate, so the query's largest coordinates bound the candidates;
* below that, only vectors long enough, ``|p| >= theta / |q|``, are candidates.

What remains is verified by exact integer products.

On Spark: a bucket is cut into chunks of bounded size, queries into groups by
the length they need, and a cell (chunk, query group) is one group of a
cogrouped job. The first scores come from the longest bucket. Which buckets a
query group meets follows from the bucket table of ``MOST_BUCKETS`` rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import written

SCALE = 64
CHUNK_ROWS = 4096
GROUP_ROWS = 2048
MOST_BUCKETS = 512
COORDINATE_COSINE = 0.6
FOCUS = 3
#: Whole numbers below this are exact as doubles.
EXACT = float(1 << 53)


def integer_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """id, row, v (components floor(scale * x)) and norm of every usable vector.

    Null vectors and vectors with a null, NaN or infinite component are left
    out. Vectors of unequal lengths are multiplied over the components that
    both have. Products are whole numbers. ``row`` tells rows apart, repeated
    ids too; it means something only in a written table.
    """
    x = F.col("x")
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("x")).filter(F.col("id").isNotNull() & x.isNotNull())
    rows = rows.filter(F.forall(x, lambda e: F.coalesce(e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))), F.lit(False))))
    rows = rows.select("id", F.monotonically_increasing_id().alias("row"), F.transform(x, lambda e: F.floor(e.cast("double") * scale)).alias("v"))
    return rows.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double") * e.cast("double"))))


def _buckets(rows: DataFrame, value: str, most: int, rows_each: int) -> tuple[list[float], int]:
    """Edges that split ``value`` into at most ``most`` parts of about ``rows_each`` rows."""
    n = rows.count()
    parts = max(1, min(most, -(-n // rows_each)))
    if parts == 1:
        return [], n
    cuts = rows.agg(F.percentile_approx(value, [i / parts for i in range(1, parts)], 20 * most)).first()[0]
    return sorted(set(cuts)), n


def _place(value: str, edges: list[float]):
    """How many edges lie below the value."""
    return F.lit(0) if not edges else F.aggregate(F.array(*[F.lit(float(e)) for e in edges]), F.lit(0), lambda a, e: a + F.when(F.col(value) > e, 1).otherwise(0))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    lists = column.combine_chunks()
    lists = lists if isinstance(lists, pa.Array) else lists.chunk(0)
    lengths, flat = lists.value_lengths().to_numpy(zero_copy_only=False), lists.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width)[None, :] < lengths[:, None]] = flat
    return out


def _candidates(q: np.ndarray, q_norm: float, need: float, p: np.ndarray, p_norm: np.ndarray) -> np.ndarray | None:
    """Rows that can reach the score ``need`` with q; None: all of them."""
    longest = p_norm[0]
    if need <= 0 or q_norm == 0 or longest == 0:
        return None
    cosine = need / (q_norm * longest)
    if cosine > 1 + 1e-9:
        return np.zeros(0, int)
    n = int(np.searchsorted(-p_norm, -(need / q_norm) * (1 - 1e-9), side="right"))
    if cosine < COORDINATE_COSINE:
        return np.arange(n)
    unit = q / q_norm
    keep = np.ones(n, bool)
    for c in np.argsort(-np.abs(unit), kind="stable")[:FOCUS]:
        spread = np.sqrt(max(0.0, (1 - min(1.0, cosine) ** 2) * (1 - unit[c] ** 2)))
        low, high = (unit[c] * cosine - spread if unit[c] * cosine - spread > -1 else -1.0), unit[c] * cosine + spread
        # the feasible range widens to the pole when it lies within the cap
        low, high = (-1.0 if -unit[c] >= cosine else low), (1.0 if unit[c] >= cosine else high)
        x = p[:n, c] / np.maximum(p_norm[:n], 1e-300)
        keep &= (x >= low - 1e-9) & (x <= high + 1e-9)
    return np.flatnonzero(keep)


def _cell(k: int):
    schema = pa.schema([("query_id", pa.int64()), ("query_row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def search(queries: pa.Table, chunk: pa.Table) -> pa.Table:
        if not queries.num_rows or not chunk.num_rows:
            return schema.empty_table()
        lists = [t.column("v").combine_chunks() for t in (queries, chunk)]
        width = max(int(np.max(x.value_lengths().to_numpy(zero_copy_only=False), initial=0)) for x in lists)
        norm = chunk.column("norm").to_numpy()
        order = np.lexsort((chunk.column("id").to_numpy(), -norm))
        p, ids, rows, norm = _matrix(chunk.column("v"), width)[order], chunk.column("id").to_numpy()[order], chunk.column("row").to_numpy()[order], norm[order]
        q_rows = queries.column("row").to_numpy()
        qs, q_ids, q_norm, need = _matrix(queries.column("v"), width), queries.column("id").to_numpy(), queries.column("norm").to_numpy(), queries.column("theta").to_numpy(zero_copy_only=False)
        if float(norm[0]) * float(q_norm.max()) < EXACT:  # no partial sum of a product is longer than the two vectors' lengths
            p, qs = p.astype(np.float64), qs.astype(np.float64)
        found: list[np.ndarray] = []
        for i in range(len(q_ids)):
            theta = -np.inf if need[i] is None or np.isnan(need[i]) else need[i]
            at = _candidates(qs[i], q_norm[i], theta, p, norm)
            at = np.arange(len(ids)) if at is None else at
            score = p[at] @ qs[i]
            keep = (score >= theta) & (rows[at] != q_rows[i])
            score, vec = score[keep].astype(np.int64), ids[at][keep]
            if len(score) > k:  # all that tie with the k-th highest take part in the order by id
                best = score >= np.partition(score, len(score) - k)[len(score) - k]
                score, vec = score[best], vec[best]
                best = np.lexsort((vec, -score))[:k]
                score, vec = score[best], vec[best]
            found.append(np.stack([np.full(len(vec), q_ids[i]), np.full(len(vec), q_rows[i]), vec, score]))
        a = np.concatenate(found, axis=1)
        return pa.Table.from_arrays([pa.array(x, pa.int64()) for x in a], schema=schema)

    return search


def _cells(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """Both sides carry (bucket, sub, part): the k best of each query in each cell."""
    key = ("bucket", "sub", "part")
    return queries.groupBy(*key).cogroup(vectors.groupBy(*key)).applyInArrow(_cell(k), "query_id long, query_row long, vec_id long, score long")


def top_k(vectors: DataFrame, query_filter, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, chunk_rows: int = CHUNK_ROWS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: for every row that meets ``query_filter``
    (a condition on ``id``) the k highest integer inner products with the other
    rows, ties to the smaller id; all rows if there are fewer than k.

    Equal vectors count one by one. Each row of a repeated id is a query and a
    candidate of its own: a query leaves out its own row only, and its id then
    has every rank once for each of its rows. Rows without an id or a usable
    vector take no part. Empty tables give no rows; other columns are ignored.
    """
    rows = written(integer_vectors(vectors, id_col, vector_col, scale).withColumn("down", -F.col("norm")), "topk-vectors")
    edges, _ = _buckets(rows, "down", MOST_BUCKETS, chunk_rows)
    rows = rows.withColumn("bucket", _place("down", edges))
    stats = rows.groupBy("bucket").agg(F.max("norm").alias("longest"), F.count(F.lit(1)).alias("n"))
    stats = [(r["bucket"], r["longest"], -(-r["n"] // chunk_rows)) for r in stats.orderBy("bucket").collect()]  # MOST_BUCKETS rows at most
    spark = rows.sparkSession
    stats_df = F.broadcast(spark.createDataFrame(stats, "bucket int, longest double, subs long"))
    chunks = rows.join(stats_df, "bucket").select("id", "row", "v", "norm", "bucket", F.pmod(F.xxhash64("row"), "subs").alias("sub"))
    asked = written(rows.filter(query_filter).select("id", "row", "v", "norm", F.lit(None).cast("double").alias("theta")), "topk-asked")

    def meet(queries: DataFrame, ordered: str, only_first: bool) -> DataFrame:
        edges, _ = _buckets(queries, ordered, MOST_BUCKETS, group_rows)
        first = queries.withColumn("band", _place(ordered, edges))
        bands = [(r["band"], r["least"], -(-r["n"] // group_rows)) for r in first.groupBy("band").agg(F.min(ordered).alias("least"), F.count(F.lit(1)).alias("n")).collect()]
        cells, start = [], 0
        for band, least, n in sorted(bands):
            for bucket, longest, subs in stats:
                if (bucket == stats[0][0]) == only_first and (only_first or longest >= least * (1 - 1e-9)):
                    cells.append((band, n, start, bucket, subs))
            start += n
        if not cells:
            return spark.createDataFrame([], "query_id long, query_row long, vec_id long, score long")
        cells_df = F.broadcast(spark.createDataFrame(cells, "band int, n long, start long, bucket int, subs long"))
        met = first.join(cells_df, "band").withColumn("part", F.col("start") + F.pmod(F.xxhash64("row"), "n")).withColumn("sub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("subs") - 1)))
        spread = chunks.join(cells_df.select("bucket", "start", "n"), "bucket").withColumn("part", F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)))
        return _cells(met.select("bucket", "sub", "part", "id", "row", "v", "norm", "theta"), spread.select("bucket", "sub", "part", "id", "row", "v", "norm"), k)

    if not stats:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    seen = written(meet(asked, "norm", True), "topk-first")
    theta = seen.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") == k).select(F.col("query_row").alias("row"), F.col("score").cast("double").alias("theta"))
    asked = written(asked.drop("theta").join(theta, "row", "left").withColumn("need", F.when((F.col("theta") > 0) & (F.col("norm") > 0), F.col("theta") / F.col("norm")).otherwise(0.0)), "topk-queries")
    rest = meet(asked, "need", False)
    return seen.unionByName(rest).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
