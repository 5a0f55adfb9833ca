"""Nearest neighbours by inner product: probed lists, rotated vectors scanned in column blocks, candidates abandoned early."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.operators.places import numbered
from tidelog.tables import written

#: Queries of one block at most, and bytes of their vectors: what every task holds; and partial products that it makes at once.
BLOCK_QUERIES, BLOCK_BYTES, SLAB_SCORES = 4096, 1 << 24, 1 << 21
#: Queries of the sample that are compared with all of it at once, on the driver.
ASKED_ROWS = 100
#: Nearest lists of a query whose vectors in the sample give its bound.
BOUND_LISTS = 4


@dataclass
class Index:
    """Centres of the lists, a random rotation, the sample they were fitted on and each of its vectors' list."""

    centres: np.ndarray
    rotation: np.ndarray
    sample_ids: np.ndarray
    sample: np.ndarray
    own: np.ndarray


def directions(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def ranked_lists(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Lists of each vector, nearest centre first. Rounded, so that equal vectors agree in whatever batch they come."""
    return np.argsort(-np.round(directions(vectors) @ centres.T, 9), axis=1, kind="stable")


def fit(ids: np.ndarray, sample: np.ndarray, lists: int, rounds: int = 8, seed: int = 7) -> Index:
    """k-means on the directions of `sample` (one row a vector, none of them zero)."""
    rng = np.random.Generator(np.random.PCG64(seed))
    d = sample.shape[1]
    rotation = np.linalg.qr(rng.standard_normal((d, d)))[0]
    unit = np.unique(directions(sample), axis=0)
    centres = unit[rng.choice(len(unit), min(lists, len(unit)), replace=False)]
    for _ in range(rounds):
        own = (unit @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, unit)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 0, sums / np.maximum(norms, 1e-300), centres)
    return Index(centres, rotation, ids, sample, ranked_lists(sample, centres)[:, 0])


def probes_for(index: Index, k: int, recall: float, asked: int = 1000) -> int:
    """Lists to probe so that `recall` of the sample's own nearest neighbours are met; the whole table's are nearer still."""
    needed = []
    for first in range(0, min(asked, len(index.sample)), ASKED_ROWS):
        queries = index.sample[first : first + min(ASKED_ROWS, asked - first)]
        scores = queries @ index.sample.T
        scores[np.arange(len(queries)), first + np.arange(len(queries))] = -np.inf
        best = np.argsort(-scores, axis=1, kind="stable")[:, : min(k, len(index.sample) - 1)]
        place = np.argsort(ranked_lists(queries, index.centres), axis=1)
        needed.append(np.take_along_axis(place, index.own[best], axis=1).ravel())
    needed = np.sort(np.concatenate(needed))
    return int(needed[min(len(needed) - 1, int(recall * len(needed)))]) + 1 if len(needed) else 1


def bounds_of(ids: np.ndarray, queries: np.ndarray, lists: np.ndarray, counts: np.ndarray, index: Index, k: int) -> np.ndarray:
    """A score that `k` candidates in each query's own probed lists reach: the k-th best of the sample's vectors in the
    nearest BOUND_LISTS of them, and in further ones until `k` are met; -inf if they hold fewer."""
    best = np.full((len(ids), k), -np.inf)
    by_list = np.argsort(index.own, kind="stable")
    edges = np.searchsorted(index.own[by_list], np.arange(len(index.centres) + 1))
    for r in range(int(counts.max(initial=0))):
        active = np.flatnonzero((r < counts) & ((r < BOUND_LISTS) | np.isneginf(best).any(axis=1)))
        for one in np.unique(lists[active, r]).tolist():
            rows, members = active[lists[active, r] == one], by_list[edges[one] : edges[one + 1]]
            scores = queries[rows] @ index.sample[members].T
            scores[ids[rows, None] == index.sample_ids[members]] = -np.inf
            best[rows] = np.partition(np.hstack((best[rows], scores)), len(members), axis=1)[:, len(members) :]
    return best.min(axis=1)


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id and v of the vectors that are neither null nor zero, without null or non-finite components."""
    v = F.col("v")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")).where(v.isNotNull() & F.col("id").isNotNull() & fine)


def scan_list(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, bounds: np.ndarray, rotation: np.ndarray, k: int, blocks: int, z: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query ids, ids and scores of each query's best `k` of a list that reach its bound.

    Vectors are rotated and cut in column blocks. Block by block the partial products grow. If a product reached the
    bound, b of its d columns would hold about b / d of it, with deviation |q||x| sqrt(b (d - b) / d) / d; a candidate whose
    partial product lies more than `z` deviations under that is abandoned. The rest is scored on the original vectors.
    """
    turned, asked = vectors @ rotation, queries @ rotation
    d = turned.shape[1]
    edges = np.unique(np.linspace(0, d, blocks + 1).astype(int)).tolist()
    partial = np.zeros((len(asked), len(turned)))
    alive = query_ids[:, None] != ids
    norms = np.linalg.norm(queries, axis=1)[:, None] * np.linalg.norm(vectors, axis=1)
    least = (bounds - 1e-9 * (1 + np.abs(np.where(np.isfinite(bounds), bounds, 0))))[:, None]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if alive.mean() > 0.2:
            partial += asked[:, a:b] @ turned[:, a:b].T
        else:
            q, x = np.nonzero(alive)
            partial[q, x] += (asked[q, a:b] * turned[x, a:b]).sum(axis=1)
        alive &= partial + z * np.sqrt(b * (d - b) / d) / d * norms >= least * (b / d)
    if len(turned) > k:
        partial[~alive] = -np.inf
        low = np.partition(partial, len(turned) - k, axis=1)[:, len(turned) - k, None]
        alive &= partial >= low - 1e-9 * (1 + np.abs(np.where(np.isfinite(low), low, 0)))
    q, x = np.nonzero(alive)
    score = (vectors[x] * queries[q]).sum(axis=1)
    order = np.lexsort((ids[x], -score, q))
    q, x, score = q[order], x[order], score[order]
    first = np.searchsorted(q, q)
    top = np.arange(len(q)) - first < k
    return query_ids[q[top]], ids[x[top]], score[top]


def nearest(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20, recall: float = 0.97, sample_rows: int = 20_000, blocks: int = 8, z: float = 4.0) -> DataFrame:
    """The `k` nearest rows of `vectors` to each row of `queries` by inner product, itself left out: query_id, rank, id_col, score.

    Centres are fitted on `sample_rows` rows chosen by hash of the id, at most 4,096 of them; all rows are indexed. The
    sample also says how many lists a query must ask to meet `recall`; it asks more until they hold `k` candidates. Vectors of
    the sample in those lists give a score that `k` candidates there reach. Should abandoning leave a query fewer, its lists are scanned
    again without a bound. Queries go to the tasks in blocks of bounded size, each with the lists that it asks; the vectors are
    scanned where they lie, sorted by list, once a block, and only a task's `k` best of a query travel. Ties go to the smaller id.
    Vectors that are null, zero or have null or non-finite components take no part, nor do those of another length than the
    commonest one (the shorter one on a tie), nor rows without an id. Ids are integers; rows that repeat one count each as
    candidates, and as a query once, with the least of their vectors. Scores are doubles of the original vectors; fewer than `k`
    candidates are all given.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[vec_col].dataType.simpleString()
    good = usable(vectors, id_col, vec_col)
    sizes = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], f"query_id long, rank int, {id_col} long, score double")
    d, total = sizes[0]["d"], sizes[0]["count"]
    good = good.where(F.size("v") == d)
    asking = usable(queries, id_col, vec_col).where(F.size("v") == d).groupBy("id").agg(F.min("v").alias("v"))
    share = min(1.0, 1.2 * sample_rows / total)
    picked = good.where(F.pmod(F.xxhash64("id"), F.lit(1_000_003)) < share * 1_000_003).orderBy(F.xxhash64("id"), "id").limit(sample_rows).toPandas()
    if not len(picked):
        picked = good.orderBy("id").limit(sample_rows).toPandas()
    index = fit(picked["id"].to_numpy(), np.array(picked["v"].tolist(), np.float64).reshape(-1, d), min(4096, max(1, int(total**0.5 / 2))))
    probes = probes_for(index, k, recall)
    shared = spark.sparkContext.broadcast(index)  # bounded: the sample, 4,096 centres and a rotation

    def placing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                lists = ranked_lists(np.array(batch["v"].tolist(), np.float64), shared.value.centres)[:, 0]
                yield pd.DataFrame({"id": batch["id"], "v": batch["v"], "list": lists.astype(np.int32)})

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = written(good.mapInPandas(placing, f"id long, v {kind}, list int").repartitionByRange(tasks, "list", "id").sortWithinPartitions("list", "id"))
    held = np.zeros(len(index.centres), np.int64)
    for row in placed.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect():  # a row for each list: 4,096 at most
        held[row.list] = row.n

    def assigned(bounded: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if not len(batch):
                    continue
                v, ids = np.array(batch["v"].tolist(), np.float64), batch["id"].to_numpy()
                lists = ranked_lists(v, shared.value.centres)
                counts = np.minimum(np.maximum(probes, (np.cumsum(held[lists], axis=1) <= k).sum(axis=1) + 1), lists.shape[1])
                bounds = bounds_of(ids, v, lists, counts, shared.value, k) if bounded else np.full(len(ids), -np.inf)
                asked = np.zeros((len(ids), len(shared.value.centres)), bool)
                for row, (own, n) in enumerate(zip(lists, counts, strict=True)):
                    asked[row, own[:n]] = True
                yield pd.DataFrame({"id": ids, "v": batch["v"], "bound": bounds, "asked": [x.tobytes() for x in np.packbits(asked, axis=1)]})

        return run

    def scan_block(block):
        """A task's best `k` of each query of a block, of its vectors in the lists that the query asks."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            query_ids, asking, bounds, asked = block.value
            best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
            for batch in batches:
                if not len(batch):
                    continue
                ids, v, lists = batch["id"].to_numpy(), np.array(batch["v"].tolist(), np.float64), batch["list"].to_numpy()
                found = [best]
                for one in np.unique(lists).tolist():
                    rows, q = np.flatnonzero(lists == one), np.flatnonzero(asked[:, one])
                    step = max(1, SLAB_SCORES // max(1, len(q)))
                    for a in range(0, len(rows) if len(q) else 0, step):
                        part = rows[a : a + step]
                        found.append(scan_list(ids[part], v[part], query_ids[q], asking[q], bounds[q], shared.value.rotation, k, blocks, z))
                q, x, score = (np.concatenate(c) for c in zip(*found, strict=True))
                order = np.lexsort((x, -score, q))
                order = order[np.arange(len(order)) - np.searchsorted(q[order], q[order]) < k]
                best = q[order], x[order], score[order]
            yield pd.DataFrame({"query_id": best[0], id_col: best[1], "score": best[2]})

        return run

    def scanned(rows: DataFrame, bounded: bool) -> DataFrame:
        """Candidates of all queries of `rows`, block by block."""
        plan = rows.mapInPandas(assigned(bounded), f"id long, v {kind}, bound double, asked binary").withColumn("all", F.lit(0))
        plan = numbered(plan, ["all"], ["id"], "place")
        n, size = plan.count(), max(1, min(BLOCK_QUERIES, BLOCK_BYTES // (8 * d)))
        out = spark.createDataFrame([], f"query_id long, {id_col} long, score double")
        for first in range(0, n, size):
            own = plan.where(f"place > {first} and place <= {first + size}").toPandas()  # a block
            asked = np.unpackbits(np.stack([np.frombuffer(x, np.uint8) for x in own["asked"]]), axis=1).astype(bool)
            block = spark.sparkContext.broadcast((own["id"].to_numpy(), np.array(own["v"].tolist(), np.float64).reshape(-1, d), own["bound"].to_numpy(), asked))
            out = out.unionByName(written(placed.mapInPandas(scan_block(block), f"query_id long, {id_col} long, score double")))
        return out

    found = scanned(asking, True)
    if total > k:
        full = found.groupBy(F.col("query_id").alias("id")).agg(F.count(F.lit(1)).alias("n")).where(f"n >= {k}")
        short = asking.join(full, "id", "left_anti")
        if not short.isEmpty():
            found = found.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(scanned(short, False))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), id_col)
    return found.withColumn("rank", F.row_number().over(order)).where(f"rank <= {k}").select("query_id", F.col("rank").cast("int"), id_col, "score")
