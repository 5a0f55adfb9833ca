"""Language-model scores: a context-mixing model of bytes, trained online, and a unigram base."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.vec import LOWER, U64, HashIndex, mixed, pieces, ragged, span_hashes, words
from tidelog.tables import written

#: Context lengths in bytes of the predictors: those of the short ones are counted in hashed slots of fixed number, those of
#: the long ones exactly, in tables that grow with the corpus.
SHORT, LONG = (1, 2, 3), (4, 5, 6)
ORDERS = SHORT + LONG
CONTEXT = max(ORDERS)
INPUTS = len(ORDERS) + 1
SLOT_BITS = (16, 20, 22)
FIRST_SLOT = [sum(1 << b for b in SLOT_BITS[:k]) for k in range(len(SHORT) + 1)]
SLOTS = FIRST_SLOT[-1]
#: Gates: bytes since the last blank and how many contexts are known.
GATES = (CONTEXT + 1) * (len(ORDERS) + 1)
#: Steps of log odds in the refinement table.
STEPS = 33
#: Parts of the windows, by hash, after each of which the mixer's weights move.
ROUNDS = 8
#: Prior strength of the weights and the furthest that one moves in a round.
PRIOR, REACH = 50.0, 0.1
END = 10
PIECE = 1 << 20
CHUNK = 1 << 15
#: Distinct windows or words that a task holds before it passes them on.
TALLY = 1 << 21
#: A key's count to learn from is kept above its count in all; occurrences after which a task passes on all that it holds.
LEARNED, OCCURRENCES = 1 << 32, 1 << 30
#: Windows and words at most of which every task holds costs and counts, the commonest ones; all others are joined.
COMMON_WINDOWS, COMMON_WORDS = 1 << 21, 1 << 18
FIXED = 1 << 16
LOG = np.array([*range(192), *(192 * 2 ** (k / 5) for k in range(1, 65))])


def stream(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows of all texts' bytes (the predicted byte on top of CONTEXT bytes), each text's range; two hashes of each word, each text's range.

    A text is its words, A-Z lower-cased, each followed by a blank, and an end byte. Before it stand zeros.
    """
    low = LOWER[data]
    starts, ends, ranges = words(low, offsets)
    sizes = ends - starts + 1
    body = np.append(low, np.uint8(32))[ragged(starts, sizes)]
    body[np.cumsum(sizes) - 1] = 32
    texts = np.append(0, np.cumsum(sizes))[ranges]
    n = len(offsets) - 1
    out = np.zeros(len(body) + n * 9 + 8, np.uint8)
    skew = np.arange(n) * 9 + 8
    out[np.arange(len(body)) + np.repeat(skew, np.diff(texts))] = body
    out[texts[1:] + skew] = END
    eight = np.ndarray((max(0, len(out) - 7),), "<u8", out, strides=(1,))
    lengths = np.diff(texts) + 1
    windows = eight[ragged(texts[:-1] + skew - 7, lengths)] >> U64(56 - 8 * CONTEXT)
    return windows, np.append(0, np.cumsum(lengths)), span_hashes(low, starts, ends), span_hashes(low, starts, ends, 1), ranges


def summed(a: np.ndarray, b: np.ndarray | None, counts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    """Keys (a, b) that differ from the one before them, and how often they come."""
    new = np.ones(len(a), bool)
    new[1:] = a[1:] != a[:-1]
    if b is not None:
        new[1:] |= b[1:] != b[:-1]
    at = np.flatnonzero(new)
    if counts is None:
        sums = np.diff(np.append(at, len(a)))
    else:
        sums = np.add.reduceat(counts, at) if len(at) else counts
    return a[at], None if b is None else b[at], sums


def distinct(a: np.ndarray, b: np.ndarray | None, counts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    """Keys (a, b) that differ from the one before them in the order of a, and how often they come; nearly always distinct."""
    if b is None and counts is None:
        return summed(np.sort(a), None, None)
    order = np.argsort(a, kind="stable")
    return summed(a[order], None if b is None else b[order], None if counts is None else counts[order])


class Tally:
    """Keys of a task, each once with its counts: occurrences to learn from times LEARNED plus all, merged as they come."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray | None, np.ndarray]] = []
        self.occurrences = 0

    def add(self, a: np.ndarray, b: np.ndarray | None, learn: np.ndarray) -> None:
        """Occurrences of keys (a, b); `learn` is 1 or 0 for each. Without b, a has less than 64 bits."""
        self.occurrences += len(a)
        if b is None:
            marked = np.sort(a << U64(1) | learn)
            self.parts.append(summed(marked >> U64(1), None, (marked & U64(1)) * U64(LEARNED) + U64(1)))
        else:
            self.parts.append(distinct(a, b, learn * U64(LEARNED) + U64(1)))
        if len(self.parts) > 1 and sum(len(p[0]) for p in self.parts[1:]) > max(TALLY // 4, len(self.parts[0][0])):
            self._merge()

    def _merge(self) -> None:
        if len(self.parts) > 1:
            columns = zip(*self.parts, strict=True)
            self.parts = [distinct(*(None if c[0] is None else np.concatenate(c) for c in columns))]

    def take(self, limit: int = 0) -> tuple[np.ndarray, np.ndarray | None, np.ndarray, np.ndarray] | None:
        """If there are more than `limit` keys, the rarer half at least, whose place is free then: (a, b, n to learn from, m in all).

        Common keys stay and go on adding up, so that they don't go to the shuffle again and again. All go at a limit of 0.
        """
        whole = not limit or self.occurrences >= OCCURRENCES  # counts of both kinds fit 32 bits
        if not self.parts or not whole and sum(len(p[0]) for p in self.parts) <= limit + limit // 4:
            return None
        self._merge()
        a, b, counts = self.parts[0]
        if not whole and len(a) <= limit:
            return None
        n, m = (counts // U64(LEARNED)).astype(np.int64), (counts % U64(LEARNED)).astype(np.int64)
        if whole:
            self.parts, self.occurrences = [], 0
            return a, b, n, m
        go = m <= np.partition(m, len(m) // 2)[len(m) // 2]
        self.parts = [(a[~go], None if b is None else b[~go], counts[~go])] if not go.all() else []
        return a[go], None if b is None else b[go], n[go], m[go]


def tallied(docs: DataFrame) -> DataFrame:
    """Counts of documents (text, learn): rows (a, b, n, m) of n occurrences to learn from among m.

    b = 0: a is a window; b odd: a and b are a word's hashes; b = 2: texts. Each task adds up its own first, a row for each
    key it holds, so that its rows are dealt as they are: Spark's own sums before the shuffle would find few alike.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, vocabulary, texts = Tally(), Tally(), np.zeros(2, np.int64)

        def rows(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x.astype(np.uint64).view(np.int64)) for x in (a, b, n, m)], ["a", "b", "n", "m"])

        def passed_on(limit: int) -> Iterator[pa.RecordBatch]:
            if found := windows.take(limit):
                yield rows(found[0], np.zeros(len(found[0])), *found[2:])
            if found := vocabulary.take(limit):
                yield rows(*found)

        for batch in batches:
            for part, data, offsets in pieces(batch, "text", PIECE):
                learn = part.column(1).to_numpy(zero_copy_only=False).astype(np.uint64)
                found, bounds, one, two, ranges = stream(data, offsets)
                windows.add(found, None, np.repeat(learn, np.diff(bounds)))
                vocabulary.add(one, two | U64(1), np.repeat(learn, np.diff(ranges)))
                texts += int(learn.sum()), len(learn)
                yield from passed_on(TALLY)
        yield from passed_on(0)
        yield rows(np.zeros(1), np.full(1, 2), texts[:1], texts[1:])

    return docs.mapInArrow(run, "a long, b long, n long, m long").repartition("a", "b").groupBy("a", "b").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))


def byte_of(windows: np.ndarray) -> np.ndarray:
    return (windows >> U64(8 * CONTEXT)).astype(np.int64)


def context_of(windows: np.ndarray, order: int) -> np.ndarray:
    return windows >> U64(8 * (CONTEXT - order)) & U64((1 << 8 * order) - 1)


def slots(windows: np.ndarray) -> np.ndarray:
    """Where the short predictors keep the counts of each of the eight bits: an array (predictor, bit, window)."""
    byte = byte_of(windows)
    out = np.empty((len(SHORT), 8, len(windows)), np.int64)
    for k, order in enumerate(SHORT):
        context = context_of(windows, order)
        for bit in range(8):
            node = (1 << bit | byte >> (8 - bit)).astype(np.uint64)
            at = context << U64(8) | node if order == 1 else mixed(context << U64(8) | node) >> U64(64 - SLOT_BITS[k])
            out[k, bit] = at.astype(np.int64) + FIRST_SLOT[k]
    return out


def bits_of(windows: np.ndarray) -> np.ndarray:
    byte = byte_of(windows)
    return np.stack([byte >> (7 - bit) & 1 for bit in range(8)])


def short_counts(windows: DataFrame) -> DataFrame:
    """(slot, state) of the short predictors: counts of zeros and of ones, eight bits each. At most SLOTS rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy().view(np.uint64) << U64(8 * (CONTEXT - max(SHORT)))
            n = np.broadcast_to(batch.column(1).to_numpy(), (len(SHORT), 8, len(keys))).ravel()
            ones = np.broadcast_to(bits_of(keys), (len(SHORT), 8, len(keys))).ravel()
            at, _, total = distinct(slots(keys).ravel() << 1 | ones, None, n)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 1), pa.array(np.where(at & 1, 0, total)), pa.array(np.where(at & 1, total, 0))], ["slot", "n0", "n1"])

    top = windows.groupBy(F.shiftrightunsigned("a", 8 * (CONTEXT - max(SHORT))).alias("key")).agg(F.sum("n").alias("n"))
    sums = top.mapInArrow(run, "slot long, n0 long, n1 long").groupBy("slot").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    step = lambda n: F.when(F.col(n) < 192, F.col(n)).otherwise(F.least(F.lit(255), F.floor(5 * F.log2(F.col(n) / 192)) + 192))
    return sums.select(F.col("slot").cast("int").alias("slot"), (step("n0") * 256 + step("n1")).cast("int").alias("state"))


@dataclass
class Mixer:
    """Weights of each gate with the curvature seen so far, and the refinement: ones and all bits by byte so far and odds."""

    weights: np.ndarray = field(default_factory=lambda: np.append(np.full((GATES, len(ORDERS)), 0.3), np.zeros((GATES, 1)), axis=1))
    curvature: np.ndarray = field(default_factory=lambda: np.tile(np.eye(INPUTS) * PRIOR, (GATES, 1, 1)))
    ones: np.ndarray = field(default_factory=lambda: np.zeros(256 * STEPS))
    total: np.ndarray = field(default_factory=lambda: np.zeros(256 * STEPS))

    def odds(self, inputs: np.ndarray, gate: np.ndarray) -> np.ndarray:
        """Log odds of the bits that came."""
        out = np.zeros(gate.shape)
        for k in range(INPUTS):
            out += inputs[k] * self.weights[:, k][gate]
        return np.clip(out, -18, 18)


def evidence(windows: np.ndarray, n: np.ndarray, states: np.ndarray, left_out: int) -> tuple[np.ndarray, np.ndarray]:
    """Inputs of the mixer (input, bit, window), positive in favour of the bit that came, and the gate of each bit.

    `windows` are distinct and hold all of the corpus whose last min(LONG) context bytes are theirs, n times each.
    `left_out` occurrences of each window itself are taken from the counts.
    """
    byte, bits = byte_of(windows), bits_of(windows)
    inputs = np.empty((INPUTS, 8, len(windows)), np.float32)
    known = np.zeros((8, len(windows)), np.int64)

    def put(k: int, same: np.ndarray, other: np.ndarray) -> None:
        total = same + other
        inputs[k] = np.log((same + 0.05) / (other + 0.05)) * (total / (total + 0.2))
        known[total > 0] += 1

    for k, at in enumerate(slots(windows)):
        state = states[at].astype(np.int64)
        zeros, ones = state >> 8, state & 255
        same = np.where(bits == 1, ones, zeros)
        put(k, LOG[np.where(same < 192, np.maximum(same - left_out, 0), same)], LOG[np.where(bits == 1, zeros, ones)])
    for k, order in enumerate(LONG, len(SHORT)):
        key = context_of(windows, order) << U64(8) | byte.astype(np.uint64)
        place = np.argsort(key, kind="stable")
        key = key[place]
        sums = np.append(0, np.cumsum(n[place]))
        level = np.empty((9, len(key)), np.int64)
        for bit in range(9):  # occurrences that share the context and the first `bit` bits
            group = key >> U64(8 - bit)
            at = np.append(np.flatnonzero(np.append(True, group[1:] != group[:-1])), len(group))
            level[bit, place] = np.repeat(sums[at[1:]] - sums[at[:-1]], np.diff(at))
        put(k, (level[1:] - left_out).astype(np.float64), (level[:-1] - level[1:]).astype(np.float64))
    inputs[-1] = np.where(bits == 1, 0.3, -0.3)
    since = np.full(len(windows), CONTEXT)
    for back in range(CONTEXT, 0, -1):
        before = windows >> U64(8 * (CONTEXT - back)) & U64(255)
        since[(before == 32) | (before == 0)] = back - 1
    return inputs, since * (len(ORDERS) + 1) + known


def refinement_place(windows: np.ndarray, odds: np.ndarray, bits: np.ndarray) -> np.ndarray:
    byte = byte_of(windows)
    node = np.stack([1 << bit | byte >> (8 - bit) for bit in range(8)])
    return node * STEPS + np.clip(np.round(np.where(bits == 1, odds, -odds) * 2) + STEPS // 2, 0, STEPS - 1).astype(np.int64)


def slopes(windows: np.ndarray, n: np.ndarray, states: np.ndarray, mixer: Mixer) -> tuple[np.ndarray, np.ndarray]:
    """What a round learns from windows, each with one occurrence left out and n times: (place, value) of gradient,
    curvature and refinement in whole numbers, so that sums don't depend on their order."""
    inputs, gate = evidence(windows, n, states, 1)
    bits, odds = bits_of(windows), mixer.odds(inputs, gate)
    p = 1 / (1 + np.exp(-odds))
    error, spread = (1 - p) * FIXED, p * (1 - p) * FIXED
    weight, flat = np.broadcast_to(n, gate.shape).ravel().astype(np.float64), gate.ravel()
    out = []
    for i in range(INPUTS):
        out.append(np.bincount(flat, np.round(inputs[i] * error).ravel() * weight, GATES))
    for i in range(INPUTS):
        for j in range(i, INPUTS):
            out.append(np.bincount(flat, np.round(inputs[i] * inputs[j] * spread).ravel() * weight, GATES))
    at = refinement_place(windows, odds, bits).ravel()
    out += [np.bincount(at, bits.ravel() * weight, 256 * STEPS), np.bincount(at, weight, 256 * STEPS)]
    values = np.concatenate(out)
    used = np.flatnonzero(values)
    return used, values[used].astype(np.int64)


def moved(mixer: Mixer, place: np.ndarray, value: np.ndarray) -> Mixer:
    """The mixer after a round: a step of an online Newton method, whose curvature is that of all rounds so far."""
    pairs = [(i, j) for i in range(INPUTS) for j in range(i, INPUTS)]
    whole = np.zeros(GATES * (INPUTS + len(pairs)) + 2 * 256 * STEPS)
    whole[place] = value
    gradient = whole[: GATES * INPUTS].reshape(INPUTS, GATES).T / FIXED
    curvature = mixer.curvature.copy()
    for (i, j), sums in zip(pairs, whole[GATES * INPUTS : GATES * (INPUTS + len(pairs))].reshape(-1, GATES) / FIXED, strict=True):
        curvature[:, i, j] += sums
        if i != j:
            curvature[:, j, i] += sums
    step = np.clip(np.linalg.solve(curvature, gradient[:, :, None])[:, :, 0], -REACH, REACH)
    ones, total = whole[-2 * 256 * STEPS :].reshape(2, -1)
    return Mixer(mixer.weights + step, curvature, mixer.ones + ones, mixer.total + total)


def bits_needed(windows: np.ndarray, n: np.ndarray, states: np.ndarray, mixer: Mixer) -> np.ndarray:
    """Bits of each window's byte after its context, in millionths."""
    inputs, gate = evidence(windows, n, states, 0)
    bits, odds = bits_of(windows), mixer.odds(inputs, gate)
    one = 1 / (1 + np.exp(-np.where(bits == 1, odds, -odds)))
    at = refinement_place(windows, odds, bits)
    one = np.clip(0.5 * one + 0.5 * (mixer.ones[at] + 4 * one) / (mixer.total[at] + 4), 1e-7, 1 - 1e-7)
    return np.round(-np.log2(np.where(bits == 1, one, 1 - one)).sum(axis=0) * 1e6).astype(np.int64)


def grouped(windows: DataFrame, *more: str) -> DataFrame:
    """Windows (a, n and `more`) dealt and sorted by their last min(LONG) context bytes: a group has at most 2^24 windows, whatever the corpus."""
    short = F.shiftrightunsigned("a", 8 * (CONTEXT - min(LONG))).bitwiseAND(F.lit((1 << 8 * min(LONG)) - 1))
    return windows.select(short.alias("context"), "a", "n", *more).repartition("context").sortWithinPartitions("context", "a")


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns behind the context of `grouped` rows, in chunks that no group spans."""
    held: list[np.ndarray] = []
    for batch in batches:
        held = [np.concatenate((old, c.to_numpy())) for old, c in zip(held, batch.columns, strict=True)] if held else [c.to_numpy() for c in batch.columns]
        edge = np.searchsorted(held[0], held[0][-1]) if len(held[0]) else 0
        if edge >= CHUNK:
            yield [held[1][:edge].view(np.uint64), *(c[:edge] for c in held[2:])]
            held = [c[edge:] for c in held]
    if held and len(held[0]):
        yield [held[1].view(np.uint64), *held[2:]]


def trained(windows: DataFrame, states) -> Mixer:
    """The mixer after all windows of the training texts, part by part; the weights of a part are those that the parts before it left."""
    spark, mixer = windows.sparkSession, Mixer()
    rows = windows.where("n > 0")
    context = F.shiftrightunsigned("a", 8 * (CONTEXT - min(LONG))).bitwiseAND(F.lit((1 << 8 * min(LONG)) - 1))
    for number in range(ROUNDS):
        shared = spark.sparkContext.broadcast(mixer)  # of fixed size

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for part, n in whole_groups(batches):
                place, value = slopes(part, n, states.value, shared.value)
                yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(value)], ["place", "value"])

        part = grouped(rows.where(F.pmod(F.xxhash64(context), F.lit(ROUNDS)) == number))
        sums = part.mapInArrow(run, "place long, value long").groupBy("place").agg(F.sum("value").alias("value")).toPandas()
        mixer = moved(mixer, sums["place"].to_numpy(np.int64), sums["value"].to_numpy(np.int64))
    return mixer


def costs(windows: DataFrame, states, mixer) -> DataFrame:
    """(a, m, value): what each window costs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, n, m in whole_groups(batches):
            yield pa.RecordBatch.from_arrays([pa.array(part.view(np.int64)), pa.array(m), pa.array(bits_needed(part, n, states.value, mixer.value))], ["a", "m", "value"])

    return grouped(windows, "m").mapInArrow(run, "a long, m long, value long")


def often(table: DataFrame, most: int) -> int:
    """The least m of which `most` rows of a table at most have as much: a count for each of few sizes, no sort."""
    step = F.least(F.col("m"), F.pow(F.lit(2.0), F.floor(F.log2("m") * 8) / 8).cast("long") + 1)
    sizes = table.groupBy(step.alias("size")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("size")).collect()
    least, total = 1 << 62, 0
    for size, rows in sizes:
        total += rows
        if total > most:
            break
        least = size
    return least


@dataclass
class Common:
    """What every task holds of common windows and words, of bounded size."""

    windows: HashIndex
    costs: np.ndarray
    words: HashIndex
    others: np.ndarray
    counts: np.ndarray
    ends: int


def scored(docs: DataFrame, common) -> DataFrame:
    """(id, row, n_tokens, n_bytes, known, base, cost, rare): sums over common windows and words; `rare` (a, b, m) are all others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, row = common.value, TaskContext.get().partitionId() << 36
        logs = np.log10(tables.counts + 1.0)
        for batch in batches:
            for part, data, offsets in pieces(batch, "text", PIECE):
                windows, bounds, one, two, ranges = stream(data, offsets)
                n = part.num_rows
                at, hit = tables.windows.find(windows)
                total = np.append(0, np.cumsum(tables.costs[at], dtype=np.int64))  # 0 where there is none
                at, met = tables.words.find(one)
                met &= tables.others[at] == two | U64(1)
                text = np.repeat(np.arange(n), np.diff(ranges))
                base, known = np.bincount(text[met], logs[at[met]], n), np.bincount(text[met], minlength=n)
                lost, strange = np.flatnonzero(~hit), np.flatnonzero(~met)
                a, b = np.append(windows[lost], one[strange]), np.append(np.zeros(len(lost), np.uint64), two[strange] | U64(1))
                owner = np.append(np.searchsorted(bounds, lost, "right") - 1, text[strange])
                order = np.lexsort((b, a, owner))
                a, b, owner = a[order], b[order], owner[order]
                new = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (owner[1:] != owner[:-1]))) if len(a) else np.zeros(0, np.int64)
                m = np.diff(np.append(new, len(a)))
                edges = pa.array(np.searchsorted(owner[new], np.arange(n + 1)).astype(np.int32))
                rare = pa.StructArray.from_arrays([pa.array(a[new].view(np.int64)), pa.array(b[new].view(np.int64)), pa.array(m)], ["a", "b", "m"])
                arrays = [
                    part.column(0), pa.array(np.arange(row, row + n)), pa.array(np.diff(ranges) + 1), pa.array(np.diff(bounds)), pa.array(known.astype(np.int64) + (tables.ends > 0)),
                    pa.array(base + np.log10(tables.ends + 1.0)), pa.array(np.diff(total[bounds])), pa.ListArray.from_arrays(edges, rare),
                ]
                row += n
                yield pa.RecordBatch.from_arrays(arrays, ["id", "row", "n_tokens", "n_bytes", "known", "base", "cost", "rare"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "text").mapInArrow(run, f"id {kind}, row long, n_tokens long, n_bytes long, known long, base double, cost long, rare array<struct<a:long,b:long,m:long>>")


def score(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id_col, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    The model learns from the rows where `learn` holds and scores all. Tokens are the words, A-Z lower-cased, and one end.
    `base_score` adds log10((c + 1) / (N + V + 1)) over the tokens (c: the token's count in the training texts, N: all of
    theirs, V: distinct ones). `score` is log10 of the probability that the context-mixing model gives the words (a blank
    behind each) and the end; `bits_per_byte` the bits over those bytes. Null texts are empty: an end alone. Rows with the
    same or no id stay rows of their own.

    1. Distinct windows (a byte and the CONTEXT bytes before it) and words are counted.
    2. Six predictors, one for each length of context, hold how often each bit came after a hashed or whole context and
       the bits of the byte so far. Short contexts lie in slots of fixed number, long ones in the windows' own table,
       dealt by context, which grows with the corpus.
    3. A mixer adds the predictors' log odds with weights by gate. It learns online: the windows come in ROUNDS parts by
       hash, each predicted under the weights that earlier parts left, one occurrence left out of the counts, and then the
       weights move. The odds met and what came then make the refinement. All windows train; sums are of whole numbers,
       so that neither partitions nor cores change the result.
    4. Each distinct window's cost is computed once. Costs and counts of the commonest windows and words go to all tasks,
       bounded in number; all others are joined to the texts that hold them.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    spark = docs.sparkSession
    counts = written(tallied(rows.select("text", "learn")))
    windows, vocabulary = counts.where("b = 0"), counts.where("b & 1 = 1 and n > 0")
    ends = counts.where("b = 2").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    tokens, types = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)) + ends, F.count(F.lit(1)) + int(ends > 0)).first()
    table = short_counts(windows.where("n > 0")).toArrow()
    states = np.zeros(SLOTS, np.uint16)
    states[table["slot"].to_numpy()] = table["state"].to_numpy()
    states = spark.sparkContext.broadcast(states)  # of fixed size
    priced = written(costs(windows, states, spark.sparkContext.broadcast(trained(windows, states))))
    often_window, often_word = often(priced, COMMON_WINDOWS), often(vocabulary, COMMON_WORDS)
    near, told = (t.where(F.col("m") >= m).select(*columns).toArrow() for t, m, columns in ((priced, often_window, ("a", "value")), (vocabulary, often_word, ("a", "b", "n"))))
    one, first = np.unique(told["a"].to_numpy().view(np.uint64), return_index=True)  # of words with one first hash one is held
    own = lambda column: np.append(told[column].to_numpy()[first], 0)
    common = Common(HashIndex(near["a"].to_numpy().view(np.uint64)), np.append(near["value"].to_numpy(), 0).astype(np.int32), HashIndex(one), own("b").view(np.uint64), own("n"), ends)
    first = written(scored(rows, spark.sparkContext.broadcast(common)))
    lookup = priced.where(F.col("m") < often_window).select("a", F.lit(0).cast("long").alias("b"), "value").unionByName(vocabulary.select("a", "b", F.col("n").alias("value")))
    rare = first.select("row", F.explode("rare").alias("r")).select("row", "r.a", "r.b", "r.m").join(lookup, ["a", "b"])
    word = F.col("b") != 0
    late = rare.groupBy("row").agg(
        F.sum(F.when(word, F.col("m"))).alias("late_known"), F.sum(F.when(word, F.col("m") * F.log10(F.col("value") + 1.0))).alias("late_base"), F.sum(F.when(~word, F.col("m") * F.col("value"))).alias("late_cost"),
    )
    share = float(np.log10(tokens + types + 1.0))
    bits = (F.col("cost") + F.coalesce("late_cost", F.lit(0))) / F.lit(1e6)
    return first.drop("rare").join(late, "row", "left").select(
        F.col("id").alias(id_col), "n_tokens", (F.col("known") + F.coalesce("late_known", F.lit(0))).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("late_base", F.lit(0.0)) - F.col("n_tokens") * F.lit(share)).alias("base_score"), (-bits * F.lit(float(np.log10(2)))).alias("score"), (bits / F.col("n_bytes")).alias("bits_per_byte"),
    )
