"""Passages that repeat across documents: content-defined chunks by a gear rolling hash, deduplicated by digest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.bloom import filter_of
from tidelog.llm.vec import LOWER, U64, buffers, mixed, pieces, span_hashes, words
from tidelog.tables import written

#: Words that the gear hash looks back on, and gear values of which the least makes a cut.
GEAR_WORDS, NEAR = 4, 8
#: First and last words of a repeated passage in which cuts may differ between the texts that hold it.
UNSURE_BEFORE, UNSURE_BEHIND = GEAR_WORDS - 1 + NEAR - 1, NEAR - 1
#: Multipliers of the two rolling hashes of a window.
ROLLS = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95


def sliding(values: np.ndarray, size: int, pick) -> np.ndarray:
    """`pick` (minimum or maximum) of every `size` neighbouring values, a power of two."""
    step = 1
    while step < size:
        values = pick(values[:-step], values[step:])
        step *= 2
    return values


def cut_words(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Words of all texts with which a chunk begins.

    The gear hash shifts by one bit a word and adds the next word's value, so it depends on the last GEAR_WORDS words. A
    word is a cut if its gear value is the least of some NEAR neighbouring ones. So cuts lie NEAR words apart at most, and
    two texts that share a passage have the same cuts in it but for its first UNSURE_BEFORE and last UNSURE_BEHIND words.
    """
    n = len(hashes)
    ordinal = np.arange(n) - np.repeat(bounds[:-1], np.diff(bounds))
    left = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(n)
    gear = hashes.copy()
    for back in range(1, GEAR_WORDS):
        gear[back:] += hashes[:-back] << U64(back)
    gear = mixed(gear) | U64(1)
    if n < NEAR:
        return np.zeros(0, np.int64)
    least = sliding(gear, NEAR, np.minimum)
    least[(ordinal < GEAR_WORDS - 1)[: len(least)] | (left < NEAR)[: len(least)]] = 0  # not within one text
    padded = np.concatenate((np.zeros(NEAR - 1, np.uint64), least, np.zeros(NEAR - 1, np.uint64)))
    return np.flatnonzero(sliding(padded, NEAR, np.maximum) == gear)


def seeds(hashes: np.ndarray, bounds: np.ndarray, most_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, end and digest of the chunks from each cut on that end within `most_words` words, in the same text.

    A digest of each chunk's words is taken once; a seed's is the sum of its chunks' with their ordinals.
    """
    cuts = cut_words(hashes, bounds)
    if len(cuts) < 2:
        return cuts[:0], cuts[:0], np.zeros(0, np.uint64)
    size = np.diff(cuts)
    ordinal = np.arange(int(size.sum())) - np.repeat(cuts[:-1] - cuts[0], size)
    sums = np.append(U64(0), np.cumsum(mixed(hashes[cuts[0] : cuts[-1]] + ordinal.astype(np.uint64) * U64(ROLLS[0]))))
    chunk = mixed(sums[cuts[1:] - cuts[0]] - sums[cuts[:-1] - cuts[0]] + size.astype(np.uint64))
    text = np.searchsorted(bounds, cuts, "right") - 1
    last = np.searchsorted(cuts, np.minimum(cuts + most_words, bounds[text + 1] - 1), "right") - 1
    at = np.flatnonzero(last > np.arange(len(cuts)))
    digest = np.zeros(len(at), np.uint64)
    for k in range(int((last[at] - at).max(initial=0))):
        more = at + k < last[at]
        digest[more] += mixed(chunk[at[more] + k] + U64((ROLLS[1] * (k + 1)) & (2**64 - 1)))
    return cuts[at], cuts[last[at]], mixed(digest)


def seed_words(least_passage: int) -> int:
    """Most words of a seed, so that a passage of `least_passage` words holds one whose cuts are sure: the first of them lies NEAR - 1 words on at most."""
    return least_passage - UNSURE_BEFORE - (NEAR - 1) - UNSURE_BEHIND - 1


def hashed_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of all words, A-Z lower-cased, and each text's range in them."""
    low = LOWER[data]
    starts, ends, bounds = words(low, offsets)
    return span_hashes(low, starts, ends), starts, ends, bounds


def window_hashes(hashes: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of the `size` words from each place on."""
    out = []
    for k, base in enumerate(ROLLS):
        inverse = pow(base, -1, 1 << 64)
        n = np.full(len(hashes), base, np.uint64)
        n[:1] = 1
        sums = np.append(U64(0), np.cumsum(mixed(hashes + U64(k)) * np.cumprod(n)))
        back = np.full(len(hashes), inverse, np.uint64)
        back[:1] = 1
        out.append(mixed((sums[at + size] - sums[at]) * np.cumprod(back)[at]))
    return out[0], out[1]


def content_keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, h, h2, doc, text of the rows that have a text: `h` and `h2` tell texts apart, `doc` documents.

    A row without an id is a document of its own, one with another such row only if their texts are equal.
    """
    text = F.col(f"`{text_col}`")
    own = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("h"), F.xxhash64(F.lit(1), text).alias("h2"), text.alias("text")).where("text is not null")
    return own.select("id", "h", "h2", F.when(F.col("id").isNull(), F.col("h")).otherwise(F.xxhash64("id")).alias("doc"), "text")


def passing(batches: Iterator[pa.RecordBatch], found: Broadcast | None, inside: bool) -> Iterator[pa.RecordBatch]:
    """Rows of batches whose hash of the text (`th`) passes the filter, or the others; all without a filter."""
    for batch in batches:
        if found is None:
            yield batch
        elif batch.num_rows:
            held = found.value.holds(batch.column("th").to_numpy().view(np.uint64)) == inside
            yield batch.filter(pa.array(held))


def once_each(texts: DataFrame) -> tuple[DataFrame, Broadcast, DataFrame, DataFrame]:
    """Distinct texts, each as the document that keeps it: those of one row, behind a filter that lets none of the others pass
    (hash of the text: `th`), and those that several rows may hold; and the rows of these.

    The columns are those of `content_keys` and last_id, nameless (the hash, if a row without an id holds the text), last_doc,
    m (rows) and several (documents). Only texts whose hash occurs again are dealt out, and grouped by all their bytes.
    """
    again = texts.groupBy("h").count().where("count > 1").select("h")
    found = filter_of(written(again))
    nameless = F.when(F.col("id").isNull(), F.col("h"))
    alone = texts.withColumns({"th": F.col("h"), "last_id": F.col("id"), "nameless": nameless, "last_doc": F.col("doc"), "m": F.lit(1).cast("long"), "several": F.lit(False)})
    named = texts.withColumn("th", F.col("h"))
    rows = named.mapInArrow(lambda batches: passing(batches, found, True), named.schema).drop("th")
    grouped = rows.groupBy("text").agg(
        F.min("id").alias("id"), F.max("id").alias("last_id"), F.min(nameless).alias("nameless"), F.min("h").alias("h"), F.min("h2").alias("h2"), F.min("doc").alias("doc"), F.max("doc").alias("last_doc"), F.count(F.lit(1)).alias("m")
    )
    several = (F.col("id") != F.col("last_id")) | (F.col("id").isNotNull() & F.col("nameless").isNotNull())
    heads = written(grouped.withColumns({"several": F.coalesce(several, F.lit(False)), "th": F.col("h")}).select(*alone.columns))
    return alone, found, heads, rows.select("id", "h", "h2", "doc")


def all_seeds(texts: DataFrame, most_words: int, without: Broadcast | None = None) -> DataFrame:
    """(digest, doc, last_doc) of all seeds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in buffers(passing(batches, without, False)):
            hashes, _, _, bounds = hashed_words(data, offsets)
            starts, _, digest = seeds(hashes, bounds, most_words)
            text = np.searchsorted(bounds, starts, "right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(digest.view(np.int64)), *(pa.array(part.column(c).to_numpy()[text]) for c in ("doc", "last_doc"))], ["digest", "doc", "last_doc"])

    return texts.select("doc", "last_doc", "th", "text").mapInArrow(run, "digest long, doc long, last_doc long")


def windows_near(texts: DataFrame, shared: Broadcast, size: int, without: Broadcast | None = None) -> DataFrame:
    """(id, h, last_id, nameless, m, several, w, w2, at, start, stop) of every window of `size` words around a seed that passes the filter: 96 bits of two
    hashes of its words, its place in words, and in code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in buffers(passing(batches, without, False)):
            hashes, starts, ends, bounds = hashed_words(data, offsets)
            first, stop, digest = seeds(hashes, bounds, seed_words(size))
            hit = shared.value.holds(digest)
            first, stop = first[hit], stop[hit]
            text = np.searchsorted(bounds, first, "right") - 1
            a, b = np.maximum(stop - size, bounds[text]), np.minimum(first, bounds[text + 1] - size)
            ok = a <= b
            marks = np.zeros(len(hashes) + 1, np.int64)
            np.add.at(marks, a[ok], 1)
            np.add.at(marks, b[ok] + 1, -1)
            at = np.flatnonzero(np.cumsum(marks)[:-1] > 0)
            if not len(at):
                continue
            text = np.searchsorted(bounds, at, "right") - 1
            w, w2 = window_hashes(hashes, at, size)
            points = np.append(0, np.cumsum((data & 0xC0) != 0x80))
            base = points[offsets[text]]
            whole = lambda x: pa.array(x.astype(np.int32))
            rows = pa.array(text)
            arrays = [*(part.column(c).take(rows) for c in names), pa.array(w.view(np.int64)), pa.array((w2 >> U64(32)).astype(np.uint32).view(np.int32)), whole(at - bounds[text]), whole(points[starts[at]] - base), whole(points[ends[at + size - 1]] - base)]
            yield pa.RecordBatch.from_arrays(arrays, [*names, "w", "w2", "at", "start", "stop"])

    kind = texts.schema["id"].dataType.simpleString()
    names = ["id", "h", "last_id", "nameless", "m", "several"]
    return texts.select(*names, "th", "text").mapInArrow(run, f"id {kind}, h long, last_id {kind}, nameless long, m long, several boolean, w long, w2 int, at int, start int, stop int")


def repeated_passages(docs: DataFrame, least_passage: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per passage of `least_passage` words or more that other documents hold too: id_col, start, end, n_words, n_docs, first_id, kept, text_hash.

    Words are compared with A-Z lower-cased, white space as one blank. A window of `least_passage` words (33 at least) is repeated if
    several documents hold it; the one of smallest id keeps it. A passage is a row of neighbouring repeated windows of a text that
    the same document keeps: it is as long as the texts agree, in words. `kept`: it is that document itself, whose copy stays; `first_id` is its id;
    `n_docs`: occurrences of the passage's commonest window. Passages that different documents keep may overlap. Places are
    code points, end exclusive. Null and empty texts and those without a repeat have no rows. Rows of one id are one document in
    several texts, told apart by `text_hash` (`xxhash64`): what only they share is no repeat. A row without an id is a
    document of its own, behind all others in order; such rows with equal texts are one. Equal rows have one row a passage.

    Seeds, a few neighbouring chunks each, are deduplicated by digest: first those of several documents are found. A repeated
    window holds such a seed, so only windows around them are compared, by 96 bits, and in groups with partial
    sums; the rows of a very common window are split by skew-join. Nothing is compared pair by pair.
    """
    if seed_words(least_passage) < NEAR:
        raise ValueError(f"least_passage is too small: {least_passage}")
    texts = content_keys(docs, id_col, text_col)
    alone, repeated, heads, rows = once_each(texts)
    found = all_seeds(alone, seed_words(least_passage), repeated).unionByName(all_seeds(heads, seed_words(least_passage)))
    counts = found.groupBy("digest").agg(F.min("doc").alias("a"), F.max("last_doc").alias("b"), F.count(F.lit(1)).alias("n"))
    shared = written(counts.where("n > 1 and a <> b").select("digest"))  # a text's own copies alone need no comparison
    named = texts.where("id is not null").select("id", "h")
    unique = named.groupBy("id").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").isEmpty()
    keyed = lambda t: t.withColumn("h", F.when(F.col("id").isNull(), F.col("h")).otherwise(0)) if unique else t  # noqa: E731  an id says which text it is
    marks = filter_of(shared)
    near = windows_near(keyed(alone), marks, least_passage, repeated).unionByName(windows_near(keyed(heads), marks, least_passage))  # read twice, for counts and places
    counts = near.groupBy("w", "w2").agg(
        F.min("id").alias("first_id"), F.max("last_id").alias("last_id"), F.min("nameless").alias("first_h"), F.max("nameless").alias("last_h"), F.sum("m").alias("n")
    )
    many = (F.col("first_id") != F.col("last_id")) | (F.col("first_h") != F.col("last_h")) | (F.col("first_id").isNotNull() & F.col("first_h").isNotNull())
    counts = counts.where(many).select("w", "w2", "n", "first_id", F.when(F.col("first_id").isNull(), F.col("first_h")).alias("first_h"))
    found = near.select("id", "h", "several", "w", "w2", "at", "start", "stop").join(counts, ["w", "w2"])
    by = ["id", "h", "several", "first_id", "first_h"]
    at = F.col("at") - F.dense_rank().over(Window.partitionBy(*by).orderBy("at"))  # of one text
    runs = found.withColumn("run", at).groupBy(*by, "run").agg(F.min("at").alias("at"), F.max("at").alias("last"), F.min("start").alias("start"), F.max("stop").alias("end"), F.max("n").alias("n_docs"))
    runs = written(runs.withColumn("own", F.col("id").eqNullSafe(F.col("first_id"))).drop("run"))
    if unique:
        of_id = named.distinct().select(F.col("id").alias("of_id"), F.col("h").alias("of_h"))
        runs = runs.join(of_id, F.col("id") == F.col("of_id"), "left").withColumn("h", F.coalesce("of_h", "h")).drop("of_id", "of_h")
    one = F.col("own") & (F.col("first_h").isNull() | (F.col("first_h") == F.col("h")))
    columns = [(F.col("last") - F.col("at") + least_passage).cast("long").alias("n_words"), "n_docs", "first_id"]
    alone = runs.where("not several").select("id", "h", F.col("start").cast("long"), F.col("end").cast("long"), *columns, one.alias("kept"))
    whole = kept_by_heads(heads.where("several"), runs.where("several"), least_passage)
    members = rows.distinct().join(heads.where("several").select(F.col("id").alias("head_id"), "h", "h2"), ["h", "h2"]).select("id", "h", "doc", "head_id")
    named_runs = whole.select(F.col("id").alias("of_id"), F.col("h").alias("of_h"), "start", "end", "n_words", "n_docs", "first_id", "first_h")
    copied = members.join(named_runs, F.col("head_id").eqNullSafe(F.col("of_id")) & (F.col("h") == F.col("of_h")))
    kept = F.col("id").eqNullSafe(F.col("first_id")) & (F.col("first_h").isNull() | (F.col("first_h") == F.col("h")))
    passages = alone.unionByName(copied.select("id", "h", "start", "end", "n_words", "n_docs", "first_id", kept.alias("kept")))
    return passages.select(F.col("id").alias(id_col), "start", "end", "n_words", "n_docs", "first_id", "kept", F.col("h").alias("text_hash"))


def kept_by_heads(heads: DataFrame, runs: DataFrame, size: int) -> DataFrame:
    """Passages (id, h, start, end, n_words, n_docs, first_id, first_h) of texts that several documents hold as a whole.

    All of such a text is repeated: what no other document keeps its first one does, passages between others' too.
    """
    theirs = runs.where(~(F.col("id").eqNullSafe(F.col("first_id")) & (F.col("first_h").isNull() | (F.col("first_h") == F.col("h")))))
    given = theirs.groupBy(F.col("id").alias("of_id"), F.col("h").alias("of_h")).agg(F.collect_list(F.struct("at", "last")).alias("taken"))  # of one text
    joined = heads.select("id", "h", "m", "text").join(given, F.col("id").eqNullSafe(F.col("of_id")) & (F.col("h") == F.col("of_h")), "left").select("id", "h", "m", "text", "taken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in pieces(batch, "text"):
                _, starts, ends, bounds = hashed_words(data, offsets)
                points = np.append(0, np.cumsum((data & 0xC0) != 0x80))
                out = []
                for row, taken in enumerate(part.column("taken").to_pylist()):
                    first, n, base = int(bounds[row]), int(bounds[row + 1] - bounds[row]), int(points[offsets[row]])
                    if n < size:
                        continue
                    free = np.zeros(n - size + 3, np.int8)
                    free[1:-1] = 1
                    for t in taken or ():
                        free[t["at"] + 1 : t["last"] + 2] = 0
                    for a, b in np.flatnonzero(np.diff(free)).reshape(-1, 2).tolist():  # windows a to b - 1
                        out.append((row, int(points[starts[first + a]]) - base, int(points[ends[first + b - 1 + size - 1]]) - base, b - 1 - a + size))
                if out:
                    row, start, end, n_words = (np.array(c) for c in zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([*(part.column(c).take(pa.array(row)) for c in ("id", "h", "m")), *(pa.array(c, pa.int64()) for c in (start, end, n_words))], ["id", "h", "m", "start", "end", "n_words"])

    kind = heads.schema["id"].dataType.simpleString()
    mine = joined.mapInArrow(run, f"id {kind}, h long, m long, start long, end long, n_words long")
    mine = mine.select("id", "h", "start", "end", "n_words", F.col("m").alias("n_docs"), F.col("id").alias("first_id"), F.when(F.col("id").isNull(), F.col("h")).alias("first_h"))
    others = theirs.select("id", "h", F.col("start").cast("long"), F.col("end").cast("long"), (F.col("last") - F.col("at") + size).cast("long").alias("n_words"), "n_docs", "first_id", "first_h")
    return mine.unionByName(others)


def without_repeats(docs: DataFrame, passages: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` without the words that only passages cover which another document keeps.

    What a passage that the document keeps covers stays, so every repeated window stays whole in one document, and words of no
    passage stay where they are. Null texts stay; columns of any name are carried along.
    """
    spans = passages.groupBy(F.col(id_col).alias("of_id"), F.col("text_hash").alias("of_h")).agg(F.collect_list(F.struct("start", "end", "kept")).alias("spans"))  # of one text

    @F.pandas_udf("string")
    def rest(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else remaining(t, s) for t, s in zip(text, spans, strict=True)], dtype=object)

    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    carried = docs.select(row.alias("row"), F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("h"), F.col(f"`{text_col}`").alias("t"))
    joined = carried.join(spans.where(F.exists("spans", lambda s: ~s["kept"])), F.col("id").eqNullSafe(F.col("of_id")) & (F.col("h") == F.col("of_h")), "left")
    text = F.when(F.col("spans").isNull(), F.col("t")).otherwise(rest("t", "spans"))
    return joined.select(*[(text if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def remaining(text: str, spans: list[dict] | None) -> str:
    """A text without the places that spans to be cut cover and none to be kept."""
    if spans is None or not len(spans):
        return text
    marks = np.zeros((2, len(text) + 1), np.int64)
    for s in spans:
        marks[int(s["kept"]), s["start"]] += 1
        marks[int(s["kept"]), s["end"]] -= 1
    cut, keep = np.cumsum(marks, axis=1)[:, :-1] > 0
    edges = np.flatnonzero(np.diff(np.concatenate(([0], (cut & ~keep).astype(np.int8), [0]))))
    out, at = [], 0
    for a, b in edges.reshape(-1, 2).tolist():
        while a < b and text[a].isspace():  # behind a word that stays: its blank stays too
            a += 1
        out.append(text[at:a])
        at = b
    return "".join(out) + text[at:]
