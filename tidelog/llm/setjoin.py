"""Exact Jaccard self-join of word-shingle sets, answered as connected components."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.graph import components
from tidelog.tables import dropped, written
from tidelog.llm.vec import U64, mixed, pieces, shingle_sets

KEYS = 8
BUCKET_BITS, BLOCK = 18, 1 << 13
#: Partners that one task compares with its copy of a set.
PARTNERS = 512
#: Longer index lists are walked block by block.
LONG_LIST = 64
#: Bits of the filter of ids: eight an id, within these bounds (8 MB at most).
FILTER_BITS = 1 << 20, 1 << 26


@dataclass(frozen=True)
class Threshold:
    """Two sets link when den * |intersection| >= num * |union|."""

    num: int
    den: int

    def need(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Least intersection of linked sets of sizes x and y."""
        return -(-self.num * (x + y) // (self.num + self.den))

    def least(self, x: np.ndarray) -> np.ndarray:
        """Smallest size that a set can have that links with one of size x."""
        return -(-self.num * x // self.den)

    def most(self, x: np.ndarray) -> np.ndarray:
        return self.den * x // self.num

    def apart(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Largest symmetric difference of linked sets."""
        return x + y - 2 * self.need(x, y)


def in_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of `docs` whose id may be in `ids`, a written table: a bitmap drops most others before texts are shuffled."""
    least, most = FILTER_BITS
    spot = F.pmod(F.xxhash64("id"), F.lit(min(most, max(least, 1 << (8 * ids.count()).bit_length()))))
    words = ids.select(spot.alias("spot")).select(
        F.expr("spot div 65536").alias("block"), F.expr("int(spot % 65536 div 64)").alias("word"), F.expr("shiftleft(1L, int(spot % 64))").alias("bit")
    )
    blocks = words.groupBy("block", "word").agg(F.bit_or("bit").alias("bits")).groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("bits"))
    marked = docs.withColumn("spot", spot).withColumn("block", F.expr("spot div 65536")).join(F.broadcast(blocks), "block")
    return marked.where("coalesce(bit_get(bits[int(spot % 65536 div 64)], int(spot % 64)), 0) = 1").drop("spot", "block", "bits")


def sketched(docs: DataFrame, size: int) -> DataFrame:
    """A row for each document: id, n, a 128-bit signature of its set and minimum hashes; and counts of hash buckets by task."""
    odd = [U64(int(x)) for x in mixed(np.arange(1, KEYS + 1, dtype=np.uint64)) | U64(1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << BUCKET_BITS, np.int64)
        for batch in batches:
            for part, data, offsets in pieces(batch, "text"):
                sets = shingle_sets(data, offsets, size)
                n = np.array([len(s) for s in sets])
                flat = np.concatenate(sets)
                counts += np.bincount((flat >> U64(64 - BUCKET_BITS)).astype(np.int64), minlength=len(counts))
                filled = n > 0
                heads = (np.cumsum(n) - n)[filled]
                out = np.zeros((2 + KEYS, len(n)), np.uint64)
                if len(heads):
                    out[0, filled], out[1, filled] = np.add.reduceat(flat, heads), np.bitwise_xor.reduceat(mixed(flat), heads)
                    for k, by in enumerate(odd):
                        out[2 + k, filled] = np.minimum.reduceat(flat * by, heads)
                keys = pa.ListArray.from_arrays(pa.array(np.arange(0, KEYS * len(n) + 1, KEYS, dtype=np.int32)), pa.array(np.ascontiguousarray(out[2:].T).ravel().view(np.int64)))
                none = pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int32()), pa.array(out[0].view(np.int64)), pa.array(out[1].view(np.int64)), keys, *none], NAMES)
        blocks = np.flatnonzero(counts.reshape(-1, BLOCK).any(axis=1)).tolist()
        m = len(blocks)
        yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.list_(pa.int64())), pa.array(blocks, pa.int32()), pa.array([counts[b * BLOCK : (b + 1) * BLOCK].tobytes() for b in blocks], pa.binary())], NAMES)

    return docs.mapInArrow(run, "id long, n int, s1 long, s2 long, keys array<long>, block int, counts binary")


NAMES = ["id", "n", "s1", "s2", "keys", "block", "counts"]


def bucket_ranks(sketches: DataFrame) -> np.ndarray:
    """Rank of each hash bucket, rarest first: the order of all sets' elements. Of fixed size, summed in a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[block] = sums.get(block, 0) + np.frombuffer(counts, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["block", "counts"])

    total = np.zeros((1 << BUCKET_BITS) // BLOCK * BLOCK, np.int64)
    blocks = sketches.where("block is not null").select("block", "counts")
    for row in blocks.repartition((1 << BUCKET_BITS) // BLOCK, "block").mapInArrow(run, "block int, counts binary").collect():
        total[row.block * BLOCK : (row.block + 1) * BLOCK] = np.frombuffer(row.counts, np.int64)
    ranks = np.empty(len(total), np.uint64)
    ranks[np.argsort(total, kind="stable")] = np.arange(len(total), dtype=np.uint64)
    return ranks


def ordered(hashes: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """A set in the common order: the top bits of each hash become its bucket's rank, which loses nothing."""
    low = U64(64 - BUCKET_BITS)
    return np.sort(ranks[(hashes >> low).astype(np.int64)] << low | hashes & U64((1 << (64 - BUCKET_BITS)) - 1))


def leaders(reps: DataFrame) -> DataFrame:
    """(id, hub): the set whose answers a set's own are derived from, for sets that share minimum hashes with others.

    Each minimum hash that several sets share elects the set whose minimum hashes are the commonest altogether: of edited
    copies that is the text they were made from. A set goes to the hub that most of its hashes elect (two at least). This
    only saves work; it decides no link.
    """
    keys = written(reps.select("id", F.posexplode("keys").alias("k", "key")).select("id", F.xxhash64("k", "key").alias("key")))
    common = written(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    shared = written(keys.join(common, "key"))
    weight = written(shared.groupBy("id").agg(F.sum("n").alias("weight")))
    elected = written(shared.join(weight, "id").groupBy("key").agg(F.max(F.struct("weight", (-F.col("id")).alias("minus"))).alias("best")))
    votes = shared.join(elected, "key").groupBy("id", (-F.col("best.minus")).alias("hub")).agg(F.count(F.lit(1)).alias("votes"), F.max("best.weight").alias("weight"))
    best = votes.where("votes > 1").groupBy("id").agg(F.max(F.struct("votes", "weight", (-F.col("hub")).alias("minus"))).alias("best"))
    out = written(best.select("id", (-F.col("best.minus")).alias("hub")))
    dropped(keys, common, shared, weight, elected)
    return out


def compared(docs: DataFrame, pairs: DataFrame, size: int, link: Threshold, ranks, differences: bool) -> DataFrame:
    """Intersections of the sets of `pairs` (hub, id): rows (hub, id, n_hub, n, inter) and, with `differences`, t_size and t.

    Each hub's text meets its partners' in parts of PARTNERS; within a part they stream by. t: the leading elements of the
    symmetric difference with the hub, as many as a link can depend on; own elements first, then the missing ones.
    """
    parts = written(pairs.groupBy("hub").agg(F.expr(f"int((count(*) - 1) div {PARTNERS}) + 1").alias("parts")))
    members = pairs.join(parts, "hub").select("id", "hub", F.expr("int(pmod(xxhash64(id), parts))").alias("part"), F.lit(1).alias("role"))
    heads = parts.select(F.col("hub").alias("id"), "hub", F.explode(F.expr("sequence(0, parts - 1)")).alias("part"), F.lit(0).alias("role"))
    going = written(members.unionByName(heads))
    rows = in_ids(docs, going.select("id")).join(going.hint("merge"), "id").select("hub", "part", "role", "id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own = None, None
        for batch in batches:
            for part, data, offsets in pieces(batch, "text"):
                sets = shingle_sets(data, offsets, size)
                out, lists = [], []
                for h, role, i, s in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), part.column(3).to_pylist(), sets, strict=True):
                    if role == 0:
                        hub, own = h, ordered(s, ranks.value)
                        continue
                    assert h == hub
                    s = ordered(s, ranks.value)
                    at = np.minimum(np.searchsorted(own, s), max(0, len(own) - 1))
                    inside = own[at] == s if len(own) else np.zeros(len(s), bool)
                    inter = int(inside.sum())
                    t_size = len(s) + len(own) - 2 * inter
                    out.append((h, i, len(own), len(s), inter, t_size))
                    if differences:
                        missing = np.ones(len(own), bool)
                        missing[at[inside]] = False
                        reach = int(link.apart(len(s), link.most(len(s)))) + 1
                        t = np.concatenate((s[~inside], ~own[missing]))[:reach]
                        lists.append(mixed(t ^ mixed(np.array([h]).astype(np.uint64))).view(np.int64).tolist())
                columns = list(zip(*out, strict=True)) or [[]] * 6
                arrays = [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), *[pa.array(c, pa.int32()) for c in columns[2:]]]
                if differences:
                    arrays.append(pa.array(lists, pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(arrays, ["hub", "id", "n_hub", "n", "inter", "t_size", "t"][: len(arrays)])

    ready = rows.repartition("hub", "part").sortWithinPartitions("hub", "part", "role", "id")
    return ready.mapInArrow(run, "hub long, id long, n_hub int, n int, inter int, t_size int" + ", t array<long>" * differences)


def list_pairs(token: np.ndarray, n: np.ndarray, span: np.ndarray, pos: np.ndarray, kind: np.ndarray, fresh: int, reach, fits) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j), i before j >= fresh, of entries of one index list that pass the filters.

    Entries are sorted by token, span (the size of the indexed set), size n and place. `reach(j)` is the smallest span of partners
    of j. In short lists neighbours at growing distance are compared all at once. A long list is walked from the members of
    all but its commonest kind: each block of equal span and size is entered up to the last place that `fits` and then skipped.
    """
    first = np.searchsorted(token, token, "left")
    found_i, found_j = [], []
    lengths = np.searchsorted(token, token, "right") - first
    j = np.flatnonzero((lengths <= LONG_LIST) & (np.arange(len(token)) >= max(1, fresh)))
    low = reach(j)
    lag = 1
    while len(j):
        ok = j - lag >= first[j]
        ok[ok] &= span[j[ok] - lag] >= low[ok]
        j, low = j[ok], low[ok]
        i = j - lag
        good = fits(i, j)
        found_i.append(i[good])
        found_j.append(j[good])
        lag += 1
    for a in np.unique(first[lengths > LONG_LIST]).tolist():
        b = a + int(lengths[a])
        kinds, counts = np.unique(kind[a:b], return_counts=True)
        main = kinds[counts.argmax()]
        blocks = a + np.flatnonzero(np.append(True, (np.diff(span[a:b]) != 0) | (np.diff(n[a:b]) != 0)))
        ends = np.append(blocks[1:], b)
        walk = (a + np.flatnonzero(kind[a:b] != main)).tolist()
        for x in walk:
            near = np.flatnonzero((span[blocks] >= reach(np.array([x]))[0]) & (reach(blocks) <= span[x]))
            for k in near.tolist():
                s, e = int(blocks[k]), int(ends[k])
                lo, hi = s, e  # `fits` holds up to some place of the block: entries there are sorted by place
                while lo < hi:
                    mid = (lo + hi) // 2
                    if fits(np.array([mid]), np.array([x]), True)[0]:
                        lo = mid + 1
                    else:
                        hi = mid
                i = np.arange(s, lo)
                i = i[(kind[i] == main) | (i < x)]
                keep = fits(i, np.full(len(i), x)) & (np.maximum(i, x) >= fresh)
                found_i.append(np.minimum(i[keep], x))
                found_j.append(np.maximum(i[keep], x))
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *found_i]), np.concatenate([none, *found_j])


def candidates(entries: DataFrame, link: Threshold, within: bool) -> DataFrame:
    """Distinct pairs (a, b) that share an indexed element and pass the size and position filters.

    `entries`: token, id, n, span (NULL: n), pos, kind (NULL: id). Only pairs of different kinds are wanted. Across groups (`within`
    false) span is the set's size and kind its group. Within a group span is the size of the difference to the hub, and sets
    that link with one and the same set are of one kind, as that joins them already.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            for name, other in (("span", "n"), ("kind", "id")):
                if columns[name].null_count:
                    columns[name] = pc.coalesce(columns[name].cast(pa.int64()), columns[other].cast(pa.int64()))
            new = [columns[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("token", "id", "n", "span", "pos", "kind")]
            fresh = len(kept[0]) if kept else 0
            token, ids, n, span, pos, kind = [np.concatenate(x) for x in zip(kept, new, strict=True)] if kept else new
            if not len(token):
                continue

            def fits(i, j, place_only=False):
                if within:
                    apart = link.apart(n[i], n[j])
                    share = np.maximum(1, -((apart - span[i] - span[j]) // 2))
                    ok = np.minimum(n[i], n[j]) >= link.least(np.maximum(n[i], n[j]))
                else:
                    share = link.need(n[i], n[j])
                    ok = np.ones(len(i), bool)
                ok &= (kind[i] != kind[j]) | place_only
                return ok & (1 + np.minimum(span[i] - pos[i] - 1, span[j] - pos[j] - 1) >= share)

            def reach(j):
                return span[j] - link.apart(n[j], link.most(n[j])) if within else link.least(span[j])

            i, j = list_pairs(token, n, span, pos, kind, fresh, reach, fits)
            pairs = np.unique(np.stack((np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j]))), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])
            last = np.flatnonzero(token == token[-1])
            last = last[span[last] >= (span[-1] - np.max(link.apart(n[last], link.most(n[last]))) if within else link.least(span[-1:])[0])]
            kept = [x[last] for x in (token, ids, n, span, pos, kind)]

    ready = entries.select("token", "id", "n", "span", "pos", "kind").repartition("token").sortWithinPartitions("token", "span", "n", "pos", "id")
    return ready.mapInArrow(run, "a long, b long").distinct()


def prefixes(docs: DataFrame, size: int, link: Threshold, ranks) -> DataFrame:
    """(id, n, prefix): the leading elements of each set, of which linked sets share one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in pieces(batch, "text"):
                sets = shingle_sets(data, offsets, size)
                lead = [ordered(s, ranks.value)[: len(s) - int(link.need(len(s), int(link.least(len(s))))) + 1] for s in sets]
                bounds = np.append(0, np.cumsum([len(x) for x in lead])).astype(np.int32)
                flat = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(lead).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int32()), flat], ["id", "n", "prefix"])

    return docs.mapInArrow(run, "id long, n int, prefix array<long>")


def near_components(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id_col, n_shingles, component_id (smallest id reachable by links, itself included).

    Sets are the distinct `size`-word shingles of the text, A-Z lower-cased; fewer words are one shingle. Two documents link
    when den * |intersection| >= num * |union|. A null text or one without words is empty and links with nothing. Ids are
    integers; rows that repeat an id are documents of their own, and so are rows without an id, whose component_id is the
    smallest id that they reach (NULL if none). Sets are told apart by 128-bit signatures. All links count, none is
    estimated:

    1. equal sets become one class;
    2. sets that share minimum hashes are compared with a hub (`leaders`);
    3. those of a hub that don't link with it elect hubs among themselves, and are compared with these;
       two sets of a hub link by what they share of their differences to it, unless both link with one hub already: for
       sets u, v and hub h the symmetric difference of u and v is that of (u xor h) and (v xor h). If they share nothing
       there, u and v are no more alike than u and h. So an index of the differences' leading elements finds the rest;
    4. sets of different hubs are found by an index of their leading elements, rarest first;
    5. the pairs found are compared, and the links joined to components.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sketches = written(sketched(rows, size))
    sets = sketches.where("block is null")
    if not sets.groupBy("id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1 or id is null").isEmpty():
        dropped(sketches)
        numbered = written(rows.select(F.monotonically_increasing_id().alias("id"), F.col("id").alias("own_id"), "text"))
        sketches = written(sketched(numbered.select("id", "text"), size))
        found = written(linked(numbered.select("id", "text"), sketches, size, Threshold(num, den)).join(numbered.select("id", "own_id"), "id"))
        least = found.groupBy("component_id").agg(F.min("own_id").alias("least_id"))
        out = found.join(least, "component_id").select(F.col("own_id").alias("id"), "n_shingles", F.col("least_id").alias("component_id"))
    else:
        out = linked(rows, sketches, size, Threshold(num, den))
    return out.withColumnRenamed("id", id_col)


def linked(docs: DataFrame, sketches: DataFrame, size: int, link: Threshold) -> DataFrame:
    """As `near_components`, of documents (id, text) whose ids are unique, and their `sketched` table."""
    num, den, spark = link.num, link.den, docs.sparkSession
    ranks = spark.sparkContext.broadcast(bucket_ranks(sketches))  # of fixed size
    sets = sketches.where("block is null")
    reps = written(sets.where("n > 0").groupBy("s1", "s2", "n").agg(F.min("id").alias("id"), F.first("keys").alias("keys")))
    hubs = leaders(reps)
    star = written(compared(docs, hubs.where("id <> hub"), size, link, ranks, True))
    near = F.col("inter") * den >= (F.col("n") + F.col("n_hub") - F.col("inter")) * num
    open_hubs = written(star.where(~near).select("hub").distinct())
    second = leaders(reps.join(star.where(~near).select("id"), "id", "left_semi"))
    inside = second.where("id <> hub").join(star.where(~near).select("id", F.col("hub").alias("first_hub")), "id").join(star.where(~near).select(F.col("id").alias("hub"), F.col("hub").alias("first_hub")), ["hub", "first_hub"])
    nearer = written(compared(docs, inside.select("hub", "id"), size, link, ranks, False).where(near).select("hub", "id"))
    kinds = star.join(nearer.withColumnRenamed("hub", "second_hub"), "id", "left").withColumn("kind", F.when(near, F.col("hub")).otherwise(F.coalesce("second_hub", "id")))
    inner = kinds.join(open_hubs, "hub", "left_semi").select("id", "n", F.col("t_size").alias("span"), "kind", F.posexplode("t").alias("pos", "token"))
    groups = written(reps.select("id").join(hubs, "id", "left").select("id", F.nullif("hub", "id").alias("kind")))
    # by shuffle at every size: broadcasting the smaller side would end where it outgrows the threshold
    lead = prefixes(in_ids(docs, groups), size, link, ranks).join(groups.hint("merge"), "id")
    outer = lead.select("id", "n", F.lit(None).cast("int").alias("span"), "kind", F.posexplode("prefix").alias("pos", "token"))
    found = written(candidates(inner, link, True).unionByName(candidates(outer, link, False)).distinct())
    stars = written(star.where(near).select(F.col("hub").alias("a"), F.col("id").alias("b")).unionByName(nearer.select(F.col("hub").alias("a"), F.col("id").alias("b"))))
    dropped(star, nearer, open_hubs, groups)  # before texts travel again
    checked = compared(docs, found.select(F.col("a").alias("hub"), F.col("b").alias("id")), size, link, ranks, False)
    links = stars.unionByName(checked.where(near).select(F.col("hub").alias("a"), F.col("id").alias("b")))
    found_components = components(links)
    classes = reps.select("s1", "s2", "n", F.col("id").alias("rep")).join(found_components.withColumnRenamed("id", "rep"), "rep", "left")
    classes = written(classes.select("s1", "s2", "n", F.coalesce("component_id", "rep").alias("component_id")))
    out = sets.join(classes, ["s1", "s2", "n"], "left")
    return out.select("id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))
