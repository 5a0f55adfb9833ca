"""Collocations: phrases counted level by level, then read as streams in prefix and in suffix order.

The layout is that of external estimation of n-gram models: all counted phrases lie in one sorted stream, in which the
beginnings of a phrase and its extension by one word stand where a single pass meets them, so that no count is looked up
in a hash table. A second stream, sorted by the words backwards, gives the same for the ends of phrases.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.bloom import filter_of
from tidelog.llm.vec import LOWER, ODD, U64, buffers, mixed, ragged, span_hashes, unique_hashes, words
from tidelog.tables import dropped, written

#: Rows of a batch, and text bytes among them, whose phrases are counted at once.
BUFFER_ROWS, BUFFER_BYTES = 512, 1 << 21
#: Phrases whose counts a task holds before it passes them on; words, and words not yet added up.
TASK_ROWS = 1 << 18
TASK_WORDS, LOOSE_WORDS = 1 << 19, 1 << 18
#: Words of the corpus for each bucket of a sketch of phrases, and the bits of a bucket's number at least and at most (64 MB
#: a task while `least` fits a byte). In an overfull sketch all buckets are crowded: that costs time only.
BUCKET_WORDS, BUCKET_BITS = 32, (16, 26)
#: Buckets that a row holds.
BLOCK = 1 << 16
#: Parts of a language's phrases that are cut to the first ones before they meet.
SALTS = 64

BREAK = np.zeros(256, bool)
BREAK[[*b".,;:!?", *range(10, 14)]] = True
GAP = BREAK.copy()
GAP[[32, 9]] = True


def word_keys(data: np.ndarray, offsets: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys of all words; where each begins and ends in `data`; its text; whether the next word follows it in one piece."""
    starts, ends, bounds = words(np.where(GAP[data], np.uint8(32), data), offsets)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    broken = np.append(0, np.cumsum(BREAK[data]))
    joined = np.zeros(len(starts), bool)
    joined[:-1] = (text[1:] == text[:-1]) & (broken[starts[1:]] == broken[ends[:-1]])
    return span_hashes(data, starts, ends, seed), starts, ends, text, joined


def lang_keys(langs: list[str]) -> np.ndarray:
    """A key of each language, by its bytes."""
    data = [x.encode() for x in langs]
    ends = np.cumsum([len(x) for x in data], dtype=np.int64)
    return span_hashes(np.frombuffer(b"".join(data), np.uint8), ends - [len(x) for x in data], ends, 1)


def phrase_hashes(keys: list[np.ndarray], lang: np.ndarray) -> np.ndarray:
    """A hash of a language and word keys in their order."""
    out = mixed(lang ^ U64(len(keys)))
    for k, key in enumerate(keys):
        out = mixed(out * U64(ODD) + key + U64(k))
    return out


def frequent_hashes(phrases: DataFrame, n_words: int) -> DataFrame:
    """The hashes of a table of phrases, as tasks compute them from texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [batch.column(f"k{k}").to_numpy().view(np.uint64) for k in range(n_words)]
            yield pa.RecordBatch.from_arrays([pa.array(phrase_hashes(keys, lang_keys(batch.column("lang").to_pylist())).view(np.int64))], ["hash"])

    return phrases.mapInArrow(run, "hash long")


def distinct_counts(hashes: np.ndarray, columns: list[np.ndarray], times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """One place of each distinct row of `columns`, whose hashes are given, and how often it occurs (rows count once, or `times`)."""
    _, example, index = unique_hashes(hashes)
    if any((c[example[index]] != c).any() for c in columns):  # two rows of one hash
        _, example, index = np.unique(np.stack(columns), axis=1, return_index=True, return_inverse=True)
        index = index.ravel()
    return example, np.bincount(index, times, minlength=len(example)).astype(np.int64)  # sums of a task, far below 2 ** 53


def counted_words(texts: DataFrame, seed: int) -> DataFrame:
    """(lang, k0, word, n): words with their keys. Each task adds up its own first; of two words with one key both are passed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs: dict = {}
        held: list[tuple[np.ndarray, ...]] = []  # language, key, another key, size and number of words, and their bytes

        def merged() -> tuple[np.ndarray, ...]:
            lang, keys, other, sizes, n, data = (np.concatenate(c) for c in zip(*held, strict=True))
            places, n = distinct_counts(mixed(keys ^ mixed(lang)) ^ other, [lang, keys, other], n)
            return lang[places], keys[places], other[places], sizes[places], n, data[ragged((np.cumsum(sizes) - sizes)[places], sizes[places])]

        def rows() -> pa.RecordBatch:
            lang, keys, _, sizes, n, data = held[0]
            edges = pa.py_buffer(np.append(0, np.cumsum(sizes)).astype(np.int64))
            word = pa.Array.from_buffers(pa.large_string(), len(n), [None, edges, pa.py_buffer(data)]).cast(pa.string())
            return pa.RecordBatch.from_arrays([pa.array([langs[x] for x in lang.tolist()], pa.string()), pa.array(keys.view(np.int64)), word, pa.array(n)], ["lang", "k0", "word", "n"])

        for part, raw, offsets in buffers(batches, "text", BUFFER_ROWS, BUFFER_BYTES):
            data = LOWER[raw]
            keys, starts, ends, text, _ = word_keys(data, offsets, seed)
            lang = part.column("lang").dictionary_encode()
            known = lang.dictionary.to_pylist()
            of_each = lang_keys(known)
            langs.update(zip(of_each.tolist(), known, strict=True))
            codes = lang.indices.to_numpy()[text].astype(np.uint64)
            places, n = distinct_counts(mixed(keys ^ mixed(codes)), [keys, codes])
            sizes = ends[places] - starts[places]
            other = span_hashes(data, starts[places], ends[places], seed + BLOCK)
            held.append((of_each[codes[places].astype(np.int64)], keys[places], other, sizes, n, data[ragged(starts[places], sizes)]))
            if len(held) > 1 and sum(len(x[0]) for x in held[1:]) > LOOSE_WORDS:
                held = [merged()]
                if len(held[0][0]) > TASK_WORDS:
                    yield rows()
                    held = []
        if held:
            held = [merged()]
            yield rows()

    counts = texts.mapInArrow(run, "lang string, k0 long, word string, n long").repartition("lang", "k0")
    return counts.groupBy("lang", "k0").agg(F.sum("n").alias("n"), F.min("word").alias("word"), F.max("word").alias("other"))


def candidates(part: pa.RecordBatch, raw: np.ndarray, offsets: np.ndarray, n_words: int, shorter, seed: int, langs: dict) -> list[np.ndarray]:
    """Language and word keys of all phrases of some texts, both of whose phrases of one word less pass the filter `shorter`."""
    keys, _, _, text, joined = word_keys(LOWER[raw], offsets, seed)
    lang = part.column("lang").dictionary_encode()
    known = lang.dictionary.to_pylist()
    of_each = lang_keys(known)
    langs.update(zip(of_each.tolist(), known, strict=True))
    of_lang = of_each[lang.indices.to_numpy()[text]] if len(text) else np.zeros(0, np.uint64)
    whole = np.ones(max(0, len(keys) - n_words + 2), bool)  # places with n_words - 1 words of one piece
    for k in range(n_words - 2):
        whole &= joined[k : k + len(whole)]
    at = np.flatnonzero(whole)
    at = at[shorter.holds(phrase_hashes([keys[at + k] for k in range(n_words - 1)], of_lang[at]))]
    fine = np.zeros(len(keys) + 1, bool)
    fine[at] = True
    at = at[fine[at + 1] & joined[at]]
    return [of_lang[at], *(keys[at + k] for k in range(n_words))]


class Crowded:
    """Buckets of phrases, by hash, in which enough phrases lie: a bit each."""

    def __init__(self, bytes_: np.ndarray, bits: int):
        self.bytes, self.bits = bytes_, bits

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        at = buckets(hashes, self.bits)
        return self.bytes[at >> 3] >> (at & 7).astype(np.uint8) & 1 > 0


def buckets(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> U64(64 - bits)).astype(np.int64)


def crowded(texts: DataFrame, n_words: int, shorter: Broadcast, seed: int, least: int, bits: int) -> Broadcast:
    """The buckets, of 2 ** bits, with `least` occurrences or more of candidates of `n_words` words together.

    A phrase that occurs so often lies in one of them, so that all others needn't be counted phrase by phrase. A task counts
    up to `least` in each bucket, which is enough to tell; the tasks' counts are added up block by block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.min_scalar_type(least))
        for part, raw, offsets in buffers(batches, "text", BUFFER_ROWS, BUFFER_BYTES):
            lang, *keys = candidates(part, raw, offsets, n_words, shorter.value, seed, {})
            at, n = np.unique(buckets(phrase_hashes(keys, lang), bits), return_counts=True)
            counts[at] = np.minimum(counts[at] + n, least)
        for number, block in enumerate(counts.reshape(-1, BLOCK)):
            if block.any():
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([block.tobytes()])], ["block", "counts"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            for number, counts in zip(batch.column("block").to_pylist(), batch.column("counts"), strict=True):
                block = sums.setdefault(number, np.zeros(BLOCK, np.int64))
                block += np.frombuffer(counts.as_buffer(), np.min_scalar_type(least))
        for number, block in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([np.packbits(block >= least, bitorder="little").tobytes()])], ["block", "bits"])

    found = texts.mapInArrow(run, "block long, counts binary").repartition("block").mapInArrow(added, "block long, bits binary").toArrow()  # 2 ** bits bits
    out = np.zeros(((1 << bits) // BLOCK, BLOCK >> 3), np.uint8)
    for number, row in zip(found.column("block").to_pylist(), found.column("bits").to_pylist(), strict=True):
        out[number] = np.frombuffer(row, np.uint8)
    return texts.sparkSession.sparkContext.broadcast(Crowded(out.ravel(), bits))


def counted_phrases(texts: DataFrame, n_words: int, shorter: Broadcast, seed: int, among: Broadcast | None = None) -> DataFrame:
    """(lang, k0, k1, ..., n): phrases of `n_words` words, both of whose phrases of one word less pass the filter `shorter`,
    and which lie in the buckets `among`."""
    names = [f"k{k}" for k in range(n_words)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs: dict = {}
        sums = [np.zeros(0, np.uint64)] * (n_words + 1), np.zeros(0, np.int64)

        def rows() -> pa.RecordBatch:
            arrays = [pa.array([langs[x] for x in sums[0][0].tolist()], pa.string()), *(pa.array(c.view(np.int64)) for c in sums[0][1:]), pa.array(sums[1])]
            return pa.RecordBatch.from_arrays(arrays, ["lang", *names, "n"])

        for part, raw, offsets in buffers(batches, "text", BUFFER_ROWS, BUFFER_BYTES):
            own = candidates(part, raw, offsets, n_words, shorter.value, seed, langs)
            if among is not None:
                crowd = among.value.holds(phrase_hashes(own[1:], own[0]))
                own = [c[crowd] for c in own]
            columns = [np.concatenate(c) for c in zip(sums[0], own, strict=True)]
            places, n = distinct_counts(phrase_hashes(columns[1:], columns[0]), columns, np.append(sums[1], np.ones(len(own[0]), np.int64)))
            sums = [c[places] for c in columns], n
            if len(n) > TASK_ROWS:
                yield rows()
                sums = [np.zeros(0, np.uint64)] * (n_words + 1), np.zeros(0, np.int64)
        yield rows()

    fields = ", ".join(f"{k} long" for k in names)
    return texts.mapInArrow(run, f"lang string, {fields}, n long").groupBy("lang", *names).agg(F.sum("n").alias("n"))


def stream(phrases: DataFrame, order: str, most_words: int) -> DataFrame:
    """`phrases` (lang, words, f) with `parts`, counts of the phrase's first 1, 2, ... words in `order`, and `covered`.

    `order` is a column of `words` or of them backwards. Rows are dealt by range and sorted, so that a phrase stands behind
    its beginnings, and the first of its extensions just behind it. One pass keeps the last count of each length: those are
    the counts of the beginnings. An extension that occurs as often as the phrase is its only one and so the next row:
    `covered` says that there is one. What a part needs of its neighbours, a few counts, is joined to it afterwards.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, first, pending = [None] * most_words, True, None
        for batch in batches:
            if not batch.num_rows:
                continue
            n = np.asarray(batch.column("size")).astype(np.int64)
            f = batch.column("f").to_numpy()
            parts = []
            for depth in range(most_words):
                at = np.maximum.accumulate(np.where(n == depth + 1, np.arange(len(n)), -1))
                none = np.full(len(n), last[depth] is None)
                value = np.where(at >= 0, f[np.maximum(at, 0)], 0 if last[depth] is None else last[depth])
                parts.append(pa.array(value, pa.int64(), mask=(at < 0) & none))
                if at[-1] >= 0:
                    last[depth] = int(f[at[-1]])
            child = (n[1:] == n[:-1] + 1) & (f[1:] == f[:-1])
            heads = np.zeros(len(n), bool)
            heads[0] = first
            rows = batch.append_column("heads", pa.array(heads))
            for depth, column in enumerate(parts):
                rows = rows.append_column(f"p{depth}", column)
            if pending is not None:  # the last row of the batch before
                yield pending.append_column("covered", pa.array([bool(n[0] == pending.column("size")[0].as_py() + 1 and f[0] == pending.column("f")[0].as_py())]))
            if len(n) > 1:
                yield rows.slice(0, len(n) - 1).append_column("covered", pa.array(child))
            pending, first = rows.slice(len(n) - 1), False
        if pending is not None:
            yield pending.append_column("covered", pa.array([None], pa.bool_()))

    spark = phrases.sparkSession
    dealt = phrases.select("lang", "words", "f", F.size("words").alias("size"), F.expr(order).alias("by"))
    dealt = dealt.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "lang", "by").sortWithinPartitions("lang", "by").drop("by").withColumn("part", F.spark_partition_id())
    counts = ", ".join(f"p{k} long" for k in range(most_words))
    passed = written(dealt.mapInArrow(run, f"lang string, words array<long>, f long, size int, part int, heads boolean, {counts}, covered boolean"))
    # of each part: its first row, and the last count of each length; a row a part, in their order
    edges = passed.where("heads or covered is null").groupBy("part").agg(
        F.max(F.when(F.col("heads"), F.struct("size", "f"))).alias("head"), *[F.max(F.when(F.col("covered").isNull(), F.col(f"p{k}"))).alias(f"p{k}") for k in range(most_words)]
    )
    by_part = Window.partitionBy(F.lit(0)).orderBy("part")
    carried = edges.select("part", F.lead("head").over(by_part).alias("next"), *[F.last(f"p{k}", ignorenulls=True).over(by_part.rowsBetween(Window.unboundedPreceding, -1)).alias(f"c{k}") for k in range(most_words)])
    joined = passed.join(F.broadcast(carried), "part")  # as many rows as parts
    parts = F.array(*[F.when(F.col("size") > k, F.coalesce(f"p{k}", f"c{k}")) for k in range(most_words)])
    after = (F.col("next.size") == F.col("size") + 1) & (F.col("next.f") == F.col("f"))
    return joined.select("lang", "words", "f", parts.alias("parts"), F.coalesce("covered", after, F.lit(False)).alias("covered"))


def lowest_cut(most_words: int) -> Column:
    """score, k, l and r of a phrase's lowest-scoring cut, the one with the smallest k of equal ones. Products stay exact up to 38 digits."""
    wide = lambda c: c.cast("decimal(16,0)")
    cuts = []
    for k in range(1, most_words):
        left, right = F.get("left_parts", F.lit(k - 1)), F.get("right_parts", F.size("words") - k - 1)
        score = F.call_function("div", wide(F.col("a")) * wide(F.col("n")) * F.lit(1000).cast("decimal(4,0)"), wide(left) * wide(right))
        cuts.append(F.when(F.size("words") > k, F.struct(score.alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r"))))
    return F.array_min(F.array_compact(F.array(*cuts)))


def collocations(docs: DataFrame, least: int = 100, most_words: int = 5, top: int = 2000, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """The first `top` phrases of each language by score: lang, rank, phrase, a, l, r, n, score.

    Texts are split at `[.,;:!?]` and line ends into pieces and those at blanks and tabs into words, A-Z lower-cased; a null text
    is empty, a null language `und`. A phrase of 2 to `most_words` words that occurs a >= `least` times in a language of n words is a
    candidate. A cut behind its first words, which occur l times and the rest r times, gives floor(1000 * a * n / (l * r)); the
    lowest counts. A candidate with a longer one around it that occurs as often is dropped. Ties go to the larger a, then to
    the phrase that is less by bytes. Repeated rows and ids count each; other columns aren't read; no rows without candidates.

    Words are counted with 64-bit keys, and counted anew with other keys should two share one where it matters. A phrase is
    counted only where both phrases of one word less within it pass a filter of the frequent ones, of bounded size; what
    passes wrongly is counted and dropped. Phrases of three words, most of which are chance meetings of two frequent pairs, must
    also lie in a bucket of a sketch with `least` occurrences. Counts are summed in tasks before they are shuffled.
    """
    texts = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text_col}`").alias("text")).where("text is not null")
    seed = 0
    while True:
        vocabulary = written(counted_words(texts, seed))
        if vocabulary.where(f"n >= {least} and word <> other").isEmpty():
            break
        dropped(vocabulary)
        seed += 1
    frequent = vocabulary.where(f"n >= {least}")
    bits = ((vocabulary.agg(F.sum("n")).first()[0] or 0) // BUCKET_WORDS).bit_length()
    bits = min(BUCKET_BITS[1], max(BUCKET_BITS[0], bits))
    levels = [frequent.select("lang", "k0", "n")]
    for n_words in range(2, most_words + 1):
        if levels[-1].isEmpty():
            break
        shorter = filter_of(frequent_hashes(levels[-1], n_words - 1))
        among = crowded(texts, n_words, shorter, seed, least, bits) if n_words == 3 else None  # most pairs that meet are no phrase
        levels.append(written(counted_phrases(texts, n_words, shorter, seed, among).where(f"n >= {least}")))
    phrases = reduce(DataFrame.unionByName, [x.select("lang", F.array(*[f"k{k}" for k in range(n_words)]).alias("words"), F.col("n").alias("f")) for n_words, x in enumerate(levels, 1)])
    ahead = stream(phrases, "words", most_words).where("size(words) > 1").withColumnsRenamed({"f": "a", "parts": "left_parts"})
    back = stream(phrases, "reverse(words)", most_words).where("size(words) > 1").select("lang", "words", F.col("parts").alias("right_parts"), F.col("covered").alias("covered_before"))
    totals = vocabulary.groupBy("lang").agg(F.sum("n").alias("n"))
    both = ahead.hint("merge").join(back, ["lang", "words"]).where("not covered and not covered_before").join(totals, "lang")
    scored = written(both.select("lang", "words", "a", "n", lowest_cut(most_words).alias("cut")))
    spelled = scored.select("lang", "words", F.posexplode("words").alias("at", "k0")).join(frequent.select("lang", "k0", "word"), ["lang", "k0"])
    spelled = spelled.groupBy("lang", "words").agg(F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"])).alias("phrase"))  # as many as the phrase has words
    found = scored.join(spelled, ["lang", "words"]).select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).alias("salt"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    for keys in (["lang", "salt"], ["lang"]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")).where(f"rank <= {top}")
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
