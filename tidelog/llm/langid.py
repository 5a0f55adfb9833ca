"""Language identification by n-gram filters that hold a bit for every language."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.vec import U64, mixed, pieces
from tidelog.tables import written

#: An ASCII letter in lower case, a byte of any other letter, or a blank for all else.
_fold = np.full(256, 32, np.uint8)
_fold[128:] = np.arange(128, 256)
_fold[97:123] = _fold[65:91] = np.arange(97, 123)
FOLD = _fold
GRAM = 4
#: Parts in which a language's n-grams are ranked before the best of each are ranked together.
PARTS = 64


@dataclass
class Model:
    """Bit-sliced Bloom filters: one word of language bits for each slot (several if there are over 64 languages)."""

    languages: list[str]
    slots: np.ndarray = field(default_factory=lambda: np.zeros((1, 1), np.uint64))
    #: Share of n-grams of other languages that a language's filter lets through.
    false_rate: np.ndarray = field(default_factory=lambda: np.zeros(0))
    hashes: int = 3

    def places(self, grams: np.ndarray) -> Iterator[np.ndarray]:
        h = mixed(grams.astype(np.uint64) + U64(0x632BE59BD9B4E019))
        mask, step = U64(self.slots.shape[1] - 1), h >> U64(32) | U64(1)
        for _ in range(self.hashes):
            yield (h & mask).astype(np.int64)
            h = h + step


def filled(counts: list[tuple[str, np.ndarray]], slots: int, hashes: int) -> Model:
    """A model of the given n-grams of each language. The language with the most training documents comes first."""
    model = Model([name for name, _ in counts], np.zeros((max(1, -(-len(counts) // 64)), slots), np.uint64), np.zeros(len(counts)), hashes)
    for k, (_, grams) in enumerate(counts):
        bit = U64(1 << (k % 64))
        for at in model.places(grams):
            model.slots[k // 64][at] |= bit
        share = float(np.count_nonzero(model.slots[k // 64] & bit)) / slots
        model.false_rate[k] = share**hashes
    return model


def grams_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the 4-byte grams of each text (letters and single blanks, blanks around it), and each text's range."""
    bounds = offsets + 2 * np.arange(len(offsets)) + 1  # two blanks before each text: no gram spans two texts
    folded = np.full(len(data) + 2 * len(offsets) + 2, 32, np.uint8)
    lengths = np.diff(offsets)
    folded[np.arange(len(data)) + np.repeat(2 * np.arange(len(lengths)) + 2, lengths)] = FOLD[data]
    blank = folded == 32
    double = blank[:-1] & blank[1:]
    good = ~(double[:-2] | double[1:-1] | double[2:])
    wide = folded.astype(np.uint32)
    code = wide[:-3] | wide[1:-2] << 8 | wide[2:-1] << 16 | wide[3:] << 24
    at = np.flatnonzero(good)
    return code[at], np.searchsorted(at, bounds)


def lettered(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text holds a letter of any script."""
    ascii_letters = np.append(0, np.cumsum((FOLD[data] != 32) & (data < 128)))
    out = ascii_letters[offsets[1:]] > ascii_letters[offsets[:-1]]
    for i in np.flatnonzero(~out & (np.diff(offsets) > 0)).tolist():
        text = data[offsets[i] : offsets[i + 1]]
        out[i] = bool((text >= 128).any()) and any(c.isalpha() for c in text.tobytes().decode("utf-8", "replace"))
    return out


def learn(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", top: int = 6000, slots: int = 1 << 17, hashes: int = 3, own: float = 0.2) -> Model:
    """Filters of the `top` commonest n-grams of each language, counted over all rows with a language and a text.

    An n-gram counts for a language only if its share there is at least `own` times that in any other language, so that
    passages in a second language don't blur the filters.

    Each task counts its own n-grams first; their sums are shuffled by language and n-gram. The driver gets `top` numbers
    a language and the model has `slots` words, whatever the input's size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, tuple[np.ndarray, np.ndarray, int]] = {}

        def add(name: str, codes: np.ndarray, count: np.ndarray, texts: int) -> None:
            if name in sums:
                codes, count = np.concatenate((sums[name][0], codes)), np.concatenate((sums[name][1], count))
                order = np.argsort(codes, kind="stable")
                codes, count = codes[order], count[order]
                new = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
                codes, count, texts = codes[new], np.add.reduceat(count, new), texts + sums[name][2]
            sums[name] = codes, count, texts

        for batch in batches:
            for part, data, offsets in pieces(batch, "text"):
                codes, bounds = grams_of(data, offsets)
                names = np.array(part.column(0).to_pylist(), object)
                for name in dict.fromkeys(names.tolist()):
                    rows = np.repeat(names == name, np.diff(bounds))
                    own = np.sort(codes[rows])
                    new = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, np.int64)
                    add(name, own[new], np.diff(np.append(new, len(own))), int((names == name).sum()))
        for name, (codes, count, texts) in sums.items():
            codes, count = np.append(codes.astype(np.int64), -1), np.append(count, texts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(codes), pa.string()), pa.array(codes), pa.array(count)], ["lang", "gram", "n"])

    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    sums = written(rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    # totals by grouping, ranks in parts by hash first: no language lies in one task
    total = sums.groupBy("lang").agg(F.sum("n").alias("total"))
    shares = written(sums.join(total, "lang").withColumn("share", F.col("n") / F.col("total")).drop("total"))
    most = shares.groupBy("gram").agg(F.max("share").alias("most"))
    kept = shares.join(most, "gram").where((F.col("gram") < 0) | (F.col("share") >= own * F.col("most"))).withColumn("part", F.when(F.col("gram") < 0, -1).otherwise(F.pmod(F.xxhash64("gram"), F.lit(PARTS))))
    order = F.desc("n"), F.col("gram")
    some = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(f"rank <= {top}")
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", F.col("gram") < 0).orderBy(*order))).where(f"rank <= {top}")
    found: dict[str, list[int]] = {}
    texts: dict[str, int] = {}
    for r in ranked.select("lang", "gram", "n").collect():
        found.setdefault(r.lang, [])
        if r.gram < 0:
            texts[r.lang] = r.n
        else:
            found[r.lang].append(r.gram)
    names = sorted(found, key=lambda x: (-texts.get(x, 0), x))
    return filled([(x, np.array(sorted(found[x]), np.uint32)) for x in names], slots, hashes)


def scores(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each text and language the share of the text's n-grams that the language holds, corrected for false positives."""
    codes, bounds = grams_of(data, offsets)
    masks = [np.full(len(codes), ~U64(0)) for _ in model.slots]
    for at in model.places(codes):
        for mask, words in zip(masks, model.slots, strict=True):
            mask &= words[at]
    total = np.diff(bounds)
    out = np.zeros((len(total), len(model.languages)))
    for k in range(len(model.languages)):
        sums = np.append(0, np.cumsum(((masks[k // 64] >> U64(k % 64)) & U64(1)).astype(np.uint8), dtype=np.int64))
        hits = sums[bounds[1:]] - sums[bounds[:-1]]
        p = model.false_rate[k]
        out[:, k] = np.clip((hits - total * p) / np.maximum(total, 1) / max(1e-9, 1 - p), 0, 1)
    return out


def predict(docs: DataFrame, model: Model, text_col: str = "text", out_cols: tuple[str, str] = ("lang_pred", "lang_score")) -> DataFrame:
    """`docs` with the predicted language and its score, 0 to 1: the share of the text's n-grams that the language holds.

    A text that is null or has no letter is `und`, score 0, as is every text if nothing was learned. A text with letters but
    no n-gram of any language is given the language with the most training documents, score 0. Columns of the result's names
    are replaced, all others carried along. No shuffle.
    """
    docs = docs.drop(*out_cols)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: slots times words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part, data, offsets in pieces(batch, text_col):
                names, best = np.full(part.num_rows, "und", object), np.zeros(part.num_rows)
                if model.languages:
                    found = scores(model, data, offsets)
                    letters = lettered(data, offsets)
                    top = found.argmax(axis=1)
                    best = np.where(letters, found[np.arange(len(top)), top], 0.0)
                    names = np.where(letters, np.array(model.languages, object)[top], "und")
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names.tolist(), pa.string()), pa.array(best)], [*part.schema.names, *out_cols])

    schema = T.StructType([*docs.schema.fields, T.StructField(out_cols[0], T.StringType()), T.StructField(out_cols[1], T.DoubleType())])
    return docs.mapInArrow(run, schema)


def held_out(id_col: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves `fold` modulo `folds`."""
    return F.crc32(id_col.cast("string")) % folds == fold
