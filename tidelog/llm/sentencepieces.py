"""SentencePiece-style encoding with seeded merge-dropout, and decoding."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.bpe import HEAP_FROM, Memo, Merges, code_points, keyed, merge_each, merge_one
from tidelog.llm.vec import U64, pieces, ragged

MARK = "▁"


class PieceBPE:
    """A merge-type model with byte fallback: ids, scores and bytes of its pieces."""

    def __init__(self, path: str, dropout: float = 0.0, seed: int = 0):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [model.id_to_piece(i) for i in range(model.vocab_size())]
        plain = {p: i for i, p in enumerate(names) if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i))}
        if any(MARK in p.lstrip(MARK) for p in plain):
            raise ValueError("pieces that span words aren't supported")
        rank = {i: r for r, i in enumerate(sorted(plain.values(), key=lambda i: (-model.get_score(i), i)))}
        pairs = [(plain[p[:k]], plain[p[k:]], rank[i], i) for p, i in plain.items() for k in range(1, len(p)) if p[:k] in plain and p[k:] in plain]
        self.merges = Merges(pairs)
        self.symbol = np.full(0x110000, -1, np.int32)
        for p, i in plain.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        self.symbol[32], self.symbol[ord(MARK)] = self.symbol[ord(MARK)], -1
        self.byte_base = next(i for i in range(len(names)) if model.is_byte(i))
        texts = [bytes([i - self.byte_base]) if model.is_byte(i) else b"" if model.is_unknown(i) or model.is_control(i) else p.replace(MARK, " ").encode() for i, p in enumerate(names)]
        self.text = np.frombuffer(b"".join(texts), np.uint8)
        self.text_size = np.array([len(t) for t in texts])
        self.text_at = np.cumsum(self.text_size) - self.text_size
        self.limit, self.seed = U64(min(2**64 - 1, int(dropout * 2**64))), seed
        self.memo = Memo(self._compute)

    def _symbols(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A symbol for each character of the words, and their numbers; an unknown character has one that never merges."""
        points, at = code_points(data[ragged(starts, ends - starts)])
        lengths = np.diff(np.searchsorted(at, np.append(0, np.cumsum(ends - starts))))
        symbols = self.symbol[points]
        return np.where(symbols < 0, -1 - points, symbols), lengths

    def _merged(self, symbols: np.ndarray, lengths: np.ndarray, dropped=None, applied=None) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of the words and their numbers. `dropped(word, start, middle, end)` says which candidates are skipped,
        `applied` is told of those that merge."""
        short = lengths <= HEAP_FROM
        if short.all():
            return self._with_bytes(*merge_each(symbols, lengths, self.merges, dropped, applied))
        small, first = np.flatnonzero(short), np.cumsum(lengths) - lengths
        narrowed = (f and (lambda word, *place, f=f: f(small[word], *place)) for f in (dropped, applied))
        out, counts = merge_each(symbols[np.repeat(short, lengths)], lengths[small], self.merges, *narrowed)
        done = dict(zip(small.tolist(), np.split(out, np.cumsum(counts)[:-1]) if len(small) else [], strict=True))
        for i in np.flatnonzero(~short).tolist():
            one, told = (f and (lambda *place, i=i, f=f: f(np.array([i]), *(np.array([x]) for x in place))) for f in (dropped, applied))
            done[i] = np.array(merge_one(symbols[first[i] : first[i] + lengths[i]].tolist(), self.merges, one, told), np.int32)
        rows = [done[i] for i in range(len(lengths))]
        return self._with_bytes(np.concatenate(rows), np.array([len(x) for x in rows]))

    def _compute(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of words without dropout; behind each word's pieces come the candidates that merged. While those stay, the
        others don't matter: each merge is the best of all candidates, and so of any that hold it."""
        symbols, lengths = self._symbols(data, starts, ends)
        met = [np.zeros((2, 0), np.int64)]

        def note(word, start, middle, end):
            met.append(np.stack((word, start << 42 | middle << 21 | end)))

        pieces, counts = self._merged(symbols, lengths, None, note if self.limit else None)
        word, place = np.concatenate(met, axis=1)
        order = np.argsort(word, kind="stable")
        word, place = word[order], place[order]
        offers = np.bincount(word, minlength=len(lengths))
        # an entry: number of pieces, pieces, candidates as two halves of 32 bits
        total = 1 + counts + 2 * offers
        at = np.cumsum(total) - total
        out = np.zeros(int(total.sum()), np.int32)
        out[at] = counts
        out[ragged(at + 1, counts)] = pieces
        out[ragged(at + 1 + counts, 2 * offers)] = place.astype("<i8").view(np.int32)
        return out, total

    def _with_bytes(self, symbols: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unknown characters as the pieces of their bytes."""
        unknown = np.flatnonzero(symbols < 0)
        if not len(unknown):
            return symbols, counts
        size = np.ones(len(symbols), np.int64)
        coded = [chr(-1 - s).encode() for s in symbols[unknown].tolist()]
        size[unknown] = [len(c) for c in coded]
        out = np.repeat(symbols, size)
        at = np.cumsum(size) - size
        out[ragged(at[unknown], size[unknown])] = np.frombuffer(b"".join(coded), np.uint8).astype(np.int32) + self.byte_base
        sums = np.append(0, np.cumsum(size))
        edges = np.append(0, np.cumsum(counts))
        return out, np.diff(sums[edges])

    def encode(self, data: np.ndarray, offsets: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and each text's range. A candidate is skipped by the hash of the seed, its text's integer of
        `keys`, its word's place in the text and its own place in the word.

        Words whose merges all stay have the pieces of an earlier run without dropout; the others run on their own.
        """
        filled = np.flatnonzero(np.diff(offsets))
        data = np.insert(data, offsets[:-1][filled], 32)
        bounds = offsets + np.append(0, np.cumsum(np.diff(offsets) > 0))
        blank = data == 32
        begins = blank.copy()
        begins[1:] &= ~blank[:-1]
        begins[bounds[:-1][filled]] = True
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(data)) if len(starts) else starts
        words = np.searchsorted(starts, bounds)
        at, total, _ = self.memo.find(data, starts, ends)
        pool = self.memo.pool
        count = pool[at].astype(np.int64) if len(at) else at
        again = np.zeros(0, np.int64)
        if self.limit:
            each = np.diff(words)
            own = keyed(self.seed, np.repeat(keys, each), np.arange(len(starts)) - np.repeat(words[:-1], each))
            offers = (total - 1 - count) >> 1
            halves = pool[ragged(at + 1 + count, 2 * offers)]
            place = np.ascontiguousarray(halves).view("<i8")
            word = np.repeat(np.arange(len(starts)), offers)
            skipped = np.zeros(len(starts), bool)
            skipped[word[keyed(self.seed, own[word], place) < self.limit]] = True
            again = np.flatnonzero(skipped)
        size = count.copy()
        if len(again):
            symbols, lengths = self._symbols(data, starts[again], ends[again])
            fresh, size[again] = self._merged(symbols, lengths, lambda w, a, b, c: keyed(self.seed, own[again[w]], a << 42 | b << 21 | c) < self.limit)
            pool = np.concatenate((pool, fresh))
            at = at + 1
            at[again] = len(pool) - len(fresh) + np.cumsum(size[again]) - size[again]
        else:
            at = at + 1
        edges = np.append(0, np.cumsum(size))
        return pool[ragged(at, size)], edges[words]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all id sequences and each one's range; the blank put before a text's first piece goes."""
        size = self.text_size[ids]
        out = self.text[ragged(self.text_at[ids], size)]
        sums = np.append(0, np.cumsum(size))[bounds]
        filled = sums[1:] > sums[:-1]
        lead = sums[:-1][filled]
        lead = lead[out[lead] == 32] if len(lead) else lead
        return np.delete(out, lead), sums - np.searchsorted(lead, sums)


@cache
def piece_bpe(path: str, dropout: float, seed: int) -> PieceBPE:
    """One model and setting for each worker process."""
    return PieceBPE(path, dropout, seed)


def encode(docs: DataFrame, model: str, dropout: float = 0.1, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per document: id_col, n_bytes, n_pieces, ids_crc32 (unsigned, of the ids as little-endian 32-bit), lossless, ids.

    `model` is the path of a merge-type model with byte fallback and no normalisation, present on every executor. Each
    candidate merge is skipped with probability `dropout`, by a hash of the seed, the document's id, the word's place in it
    and the candidate's place in the word: each occurrence of a word has draws of its own, and equal inputs give equal ids
    wherever they run. Without dropout the pieces are the library's, but for U+2581, which goes by its bytes so that
    decoding gives it back. `lossless`: decoding gives the text. Null texts are empty and have no pieces; rows that repeat
    give equal rows, a null id is an id like others. No shuffle.
    """
    if not 0 <= dropout <= 1:
        raise ValueError("dropout lies in 0..1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = piece_bpe(model, dropout, seed)
        for batch in batches:
            for part, data, offsets in pieces(batch, "text"):
                ids, bounds = bpe.encode(data, offsets, np.array(part.column(2).to_pylist(), np.int64))
                back, edges = bpe.decode(ids, bounds)
                same = np.array_equal(edges, offsets) and np.array_equal(back, data)
                lossless = [same or back[edges[i] : edges[i + 1]].tobytes() == data[offsets[i] : offsets[i + 1]].tobytes() for i in range(part.num_rows)]
                crcs = [crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                arrays = [part.column(0), pa.array(np.diff(offsets)), pa.array(np.diff(bounds)), pa.array(crcs, pa.int64()), pa.array(lossless, pa.bool_())]
                if with_ids:
                    arrays.append(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids)))
                yield pa.RecordBatch.from_arrays(arrays, ["id", "n_bytes", "n_pieces", "ids_crc32", "lossless", "ids"][: len(arrays)])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col).cast("string")).alias("key"))
    schema = f"id {kind}, n_bytes long, n_pieces long, ids_crc32 long, lossless boolean" + ", ids array<int>" * with_ids
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, model: str, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """`encoded` with the text of its ids; null ids are an empty text. Bytes that form no UTF-8 become U+FFFD. A column
    named `out_col` is replaced."""
    encoded = encoded.drop(out_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = piece_bpe(model, 0.0, 0)
        for batch in batches:
            lists = [np.array(x or [], np.int64) for x in batch.column(ids_col).to_pylist()]
            bounds = np.append(0, np.cumsum([len(x) for x in lists])).astype(np.int64)
            out, edges = bpe.decode(np.concatenate([*lists, np.zeros(0, np.int64)]).astype(np.int64), bounds)
            texts = [out[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, out_col])

    from pyspark.sql import types as T

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField(out_col, T.StringType())]))
