"""Exact k highest scores of each query: every pair is scored, histograms of the scores locate each query's k-th value."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.operators.places import numbered
from tidelog.tables import written

#: Queries of one block at most, and bytes of their vectors: what a task holds beside its slab of scores.
BLOCK_QUERIES, BLOCK_BYTES = 4096, 1 << 24
#: Buckets of a query's histogram, and scores that a task makes at once.
BUCKETS, SLAB_SCORES = 512, 1 << 20


def scaled(vector: Column, scale: int = 256) -> Column:
    """Components as floor(scale * x), longs; null for a vector that is null or holds null or non-finite components."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(vector.isNotNull() & fine, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def rows_of(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of the vectors of each length, and their components as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.asarray(column.offsets).astype(np.int64)
    values, sizes = column.values.to_numpy(), np.diff(offsets)
    for d in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == d)
        yield rows, values[offsets[rows, None] + np.arange(d)]


def products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact inner products of integer vectors: in doubles where no sum can pass 53 bits, else in longs; an error beyond those."""
    most = int(np.abs(queries).max(initial=0)) * int(np.abs(vectors).max(initial=0)) * queries.shape[1]
    if most < 1 << 53:
        return (queries.astype(np.float64) @ vectors.T.astype(np.float64)).astype(np.int64)
    if most >= 1 << 63:
        raise OverflowError("an inner product may pass 64 bits")
    return queries @ vectors.T


class Block:
    """Queries of a block by their vectors' length: their places in the block, ids and vectors."""

    def __init__(self, table: pa.Table):
        table = table.combine_chunks()
        self.ids = table.column("id").to_numpy()
        self.groups = {x.shape[1]: (rows, x) for rows, x in rows_of(table.column("x"))} if table.num_rows else {}

    def scored(self, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Slabs of all scores of a batch: the queries' places, the batch's rows, scores, and whether a pair counts."""
        ids = batch.column("id").to_pandas().to_numpy()  # missing ids are NaN, equal to none
        for rows, x in rows_of(batch.column("x")):
            if x.shape[1] in self.groups:
                places, queries = self.groups[x.shape[1]]
                step = max(1, SLAB_SCORES // len(places))
                for a in range(0, len(rows), step):
                    part = rows[a : a + step]
                    yield places, part, products(queries, x[a : a + step]), self.ids[places, None] != ids[part]


def histograms(rows: DataFrame, block, low: np.ndarray, width: np.ndarray, k: int) -> DataFrame:
    """(place, bucket, n): how many scores of each query lie in each bucket; bucket b of a query begins at low + b * width.

    Scores above all buckets count in the last one, those below the first in none. A task leaves out buckets under the one
    with which it has counted `k`: the k-th score of all can't lie there.
    """
    sent = rows.sparkSession.sparkContext.broadcast((low, width))  # two numbers a query of the block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, width = sent.value
        counts = np.zeros((len(low), BUCKETS), np.int64)
        for batch in batches:
            for places, _, scores, fine in block.value.scored(batch):
                bucket = np.minimum((scores - low[places, None]) // width[places, None], BUCKETS - 1)
                fine &= bucket >= 0
                flat = (np.arange(len(places))[:, None] * BUCKETS + bucket)[fine]
                counts[places] += np.bincount(flat, minlength=len(places) * BUCKETS).reshape(-1, BUCKETS)
        above = counts[:, ::-1].cumsum(axis=1)[:, ::-1] - counts
        place, bucket = np.nonzero((counts > 0) & (above < k))
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(bucket), pa.array(counts[place, bucket])], ["place", "bucket", "n"])

    return rows.mapInArrow(run, "place long, bucket long, n long").groupBy("place", "bucket").agg(F.sum("n").alias("n"))


def thresholds(rows: DataFrame, block, n_queries: int, reach: np.ndarray, k: int) -> np.ndarray:
    """The k-th highest score of each query of a block, or a score below all where there are fewer than `k`.

    Each round counts a histogram of the range that holds the k-th score and goes on in its bucket, until that is one score wide.
    """
    low, width = -reach, -(-(2 * reach + 1) // BUCKETS)
    down = Window.partitionBy("place").orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, 0)
    while True:
        counted = histograms(rows, block, low, width, k).withColumn("so_far", F.sum("n").over(down))
        kth = counted.where(f"so_far >= {k}").groupBy("place").agg(F.max("bucket").alias("bucket")).toArrow()  # a row a query of the block
        place, bucket = kth.column("place").to_numpy(), kth.column("bucket").to_numpy()
        found = np.zeros(n_queries, bool)
        found[place] = True
        low[place] += bucket * width[place]
        if (width[found] == 1).all():
            return np.where(found, low, -reach)
        width = np.where(found, -(-width // BUCKETS), width)


def reaching(rows: DataFrame, block, least: np.ndarray, k: int) -> DataFrame:
    """(place, vec_id, score) of pairs whose score reaches the query's threshold; of a task's equal ones at most its first `k`."""
    sent = rows.sparkSession.sparkContext.broadcast(least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [np.zeros(0, np.int64)] * 3, np.zeros(0, bool)
        for batch in batches:
            ids = batch.column("id").to_pandas()
            missing, ids = ids.isna().to_numpy(), ids.fillna(0).to_numpy().astype(np.int64)
            found = [(*best[0], best[1])]
            for places, part, scores, fine in block.value.scored(batch):
                q, c = np.nonzero(fine & (scores >= sent.value[places, None]))
                found.append((places[q], scores[q, c], ids[part[c]], missing[part[c]]))
            place, score, vec_id, none = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((vec_id, none, -score, place))
            order = order[np.arange(len(order)) - np.searchsorted(place[order], place[order]) < k]
            best = [place[order], score[order], vec_id[order]], none[order]
        (place, score, vec_id), none = best
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(vec_id, mask=none), pa.array(score)], ["place", "vec_id", "score"])

    return rows.mapInArrow(run, "place long, vec_id long, score long")


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The `k` rows of `vectors` with the highest scores for each row of `queries`: query_id, query_copy, rank, vec_id, score.

    Components x become floor(scale * x); the score is the integer inner product, exact. Each query meets every row of `vectors` but those of its
    own id; with fewer than `k` of them all are given. Ties go to the smaller id, a missing one last. Vectors that are null or
    hold null or non-finite components take no part; those of another length than the query's are no candidates of it, and
    queries without an id are none. Rows count as often as they occur; an id that asks with several different vectors has
    ranks for each, told apart by `query_copy` (1, 2, ... by vector). Scores that could pass 64 bits are an error.

    Queries go to the tasks in blocks of bounded size, numbered in the shared folder; for each block the candidates are read
    where they lie, never shuffled, and only counts and rows that reach the query's threshold travel: `k` a task and query.
    """
    good = lambda df: df.select(F.col(f"`{id_col}`").cast("long").alias("id"), scaled(F.col(f"`{vec_col}`"), scale).alias("x")).where("x is not null")
    rows, spark = good(vectors), vectors.sparkSession
    asking = good(queries).where("id is not null").distinct()
    asking = numbered(asking.withColumn("copy", F.row_number().over(Window.partitionBy("id").orderBy("x"))).withColumn("all", F.lit(0)), ["all"], ["id", "copy"], "place")
    asking = written(asking.select("id", "x", "copy", F.expr("place - 1").alias("place")))
    square = F.aggregate("x", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    longest = rows.agg(F.max(square)).first()[0]
    total, length = asking.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
    found = spark.createDataFrame([], "query_id long, query_copy int, vec_id long, score long")
    if total and longest is not None:
        size = max(1, min(BLOCK_QUERIES, BLOCK_BYTES // (8 * max(1, length))))
        for first in range(0, total, size):
            own = asking.where(f"place >= {first} and place < {first + size}")
            table = own.orderBy("place").select("id", "x").toArrow()  # a block
            block = spark.sparkContext.broadcast(Block(table))
            norms = np.zeros(table.num_rows)
            for at, x in rows_of(table.column("x")):
                norms[at] = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
            reach = np.ceil(norms * longest**0.5 * (1 + 1e-9)).astype(np.int64) + 1
            least = thresholds(rows, block, table.num_rows, reach, k)
            hits = reaching(rows, block, least, k).join(F.broadcast(own.select("id", "copy", F.expr(f"place - {first}").alias("place"))), "place")
            found = found.unionByName(written(hits.select(F.col("id").alias("query_id"), F.col("copy").alias("query_copy"), "vec_id", "score")))
    order = Window.partitionBy("query_id", "query_copy").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    ranked = found.withColumn("rank", F.row_number().over(order).cast("int")).where(f"rank <= {k}")
    return ranked.select("query_id", "query_copy", "rank", "vec_id", "score")
