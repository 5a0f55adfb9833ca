"""Order-preserving packing of documents into token windows by dynamic programming."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.bpe import ByteBPE, byte_bpe
from tidelog.llm.vec import pieces

#: Tokens that one run of the dynamic program takes before its last windows are left to the next run.
RUN_TOKENS = 1 << 20


@dataclass(frozen=True)
class Costs:
    """What a cut costs, in tokens of padding: between documents, behind a sentence, elsewhere."""

    document: int = 0
    sentence: int = 2
    inside: int = 6
    #: Windows of a smaller power of two aren't sought, except at a partition's end.
    least_exact: int = 64


def choose_cuts(places: np.ndarray, costs: np.ndarray, window: int, inside: int, least_exact: int, tail_from: int) -> tuple[list[int], list[int]]:
    """Cheapest ways to cut a stream at `places` (ascending from 0, at most `window` apart): each place's cost and the one before it.

    A window ends at a place, at most `window` after the last one; or one full window is cut at no place (cost `inside`)
    and the next ends there. A window of a power of two needs no padding (those under `least_exact` count only from
    `tail_from` on), any other is padded to `window`. For padded windows the best start is the front of a monotone queue
    of cost + place; for exact ones the few places at the right distances are looked up.
    """
    at_end, at_start = [], []
    for extra in (0, window):
        for p in (1 << k for k in range(window.bit_length())):
            want = places - extra - p
            found = np.minimum(np.searchsorted(places, want), len(places) - 1)
            hit = np.flatnonzero((places[found] == want) & ((p >= least_exact) | (places >= tail_from)))
            at_end.append(hit)
            at_start.append(found[hit] << 1 | bool(extra))
    ends, starts = np.concatenate(at_end), np.concatenate(at_start)
    order = np.argsort(ends, kind="stable")
    exact, first = starts[order].tolist(), np.searchsorted(ends[order], np.arange(len(places) + 1)).tolist()
    spots, price = places.tolist(), costs.tolist()
    near_from = np.searchsorted(places, places - window).tolist()
    far_from = np.searchsorted(places, places - 2 * window).tolist()
    best, back, score = [0] * len(spots), [-1] * len(spots), [0] * len(spots)
    near, far, waiting = deque([0]), deque(), 0  # indices, their scores ascending
    for i in range(1, len(spots)):
        b, low = spots[i], near_from[i]
        while near[0] < low:
            near.popleft()
        source = near[0]
        least = score[source] + window - b
        while waiting < low:
            entry = score[waiting]
            while far and score[far[-1]] >= entry:
                far.pop()
            far.append(waiting)
            waiting += 1
        low = far_from[i]
        while far and far[0] < low:
            far.popleft()
        if far and (other := score[far[0]] + 2 * window + inside - b) < least:
            least, source = other, far[0]
        for x in exact[first[i] : first[i + 1]]:
            if (other := best[x >> 1] + inside * (x & 1)) < least:
                least, source = other, x >> 1
        best[i], back[i] = least + price[i], source
        score[i] = entry = best[i] + b
        while near and score[near[-1]] >= entry:
            near.pop()
        near.append(i)
    return best, back


class Stream:
    """The tokens of a partition in order, packed as they come; only the open tail stays in memory."""

    def __init__(self, first_sequence: int, window: int, costs: Costs):
        self.window, self.costs, self.sequence = window, costs, first_sequence
        self.ids = np.zeros(0, np.int32)
        self.docs: list = []  # of each document (or rest of one) in the stream: id, length, tokens before, all tokens
        self.sentences = np.zeros(0, np.int64)

    def add(self, keys: list, ids: np.ndarray, bounds: np.ndarray, sentences: np.ndarray) -> None:
        base = len(self.ids)
        self.ids = np.concatenate((self.ids, ids))
        self.sentences = np.concatenate((self.sentences, sentences + base))
        lengths = np.diff(bounds).tolist()
        self.docs += [(k, n, 0, n) for k, n in zip(keys, lengths, strict=True)]

    def flush(self, last: bool) -> list[tuple]:
        """Rows (document, start, length, crc32, document's tokens, sequence, offset, ids) of the windows that are closed."""
        total = len(self.ids)
        if not total:
            return []
        ends = np.cumsum([d[1] for d in self.docs])
        price = np.full(total + 1, 255, np.uint8)
        price[self.sentences] = self.costs.sentence
        if last:
            tail = price[max(1, total - self.window) : total]
            tail[tail == 255] = self.costs.inside
        price[ends] = self.costs.document
        price[0] = 0
        places = np.flatnonzero(price < 255)
        gaps = np.diff(places)
        long = np.flatnonzero(gaps > self.window)
        if len(long):
            price[np.concatenate([np.arange(places[k] + self.window, places[k + 1], self.window) for k in long])] = self.costs.inside
            places = np.flatnonzero(price < 255)
        best, back = choose_cuts(places, price[places].astype(np.int64), self.window, self.costs.inside, self.costs.least_exact, total - self.window if last else total + 1)
        i = len(places) - 1
        if not last:
            first = int(np.searchsorted(places, max(1, total - 2 * self.window)))
            i = min(range(first, len(places)), key=lambda k: (best[k], -k))
        cuts = []
        closed = int(places[i])
        while i > 0:
            j = back[i]
            cuts.append(int(places[i]))
            if places[i] - places[j] > self.window:
                cuts.append(int(places[j]) + self.window)
            i = j
        cuts = [0, *cuts[::-1]]
        rows, w, at = [], 0, 0
        rest = []
        for key, length, before, whole in self.docs:
            done, end = at, at + length
            while done < min(end, closed):
                while cuts[w + 1] <= done:
                    w += 1
                upto = min(end, cuts[w + 1])
                piece = self.ids[done:upto]
                rows.append((key, before + done - at, upto - done, crc32(piece.astype("<u4").tobytes()), whole, self.sequence + w, done - cuts[w], piece))
                done = upto
            if done < end:
                rest.append((key, end - done, before + done - at, whole))
            at = end
        self.sequence += len(cuts) - 1
        self.ids, self.docs = self.ids[closed:], rest
        self.sentences = self.sentences[self.sentences > closed] - closed
        return rows


def tokens(bpe: ByteBPE, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all texts with `end_id` behind each, the texts' bounds in them, and the places behind sentences."""
    starts, at, count, bounds = bpe.spans(data, offsets)
    total = np.append(0, np.cumsum(count))
    ids, id_bounds, _ = bpe.ids_of(at, count, bounds, starts)
    out = np.insert(ids, id_bounds[1:], end_id)
    behind = data[np.maximum(starts - 1, 0)]
    blank = (data[starts] == 32) | (data[starts] == 10) if len(starts) else np.zeros(0, bool)
    stops = np.flatnonzero(np.isin(behind, (33, 46, 63)) & blank | (behind == 10))
    text = np.searchsorted(bounds, stops, "right") - 1
    inner = bounds[text] != stops
    return out, id_bounds + np.arange(len(id_bounds)), total[stops[inner]] + text[inner]


def pack(docs: DataFrame, vocabulary: str, window: int = 1024, end_id: int = 0, costs: Costs = Costs(), id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    Each document is the ids of its text and `end_id`; an empty or null text is `end_id` alone. Documents keep the order in
    which their partition is read; each partition fills sequences of its own, so nothing is shuffled and a lost task
    repeats alone. Cuts fall where padding and cut costs together are least.
    """
    if window < 2 or window & (window - 1):
        raise ValueError("window must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(vocabulary)
        stream = Stream(TaskContext.get().partitionId() << 36, window, costs)

        def out(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            arrays = [pa.array(columns[0], key_type), *[pa.array(c, pa.int64()) for c in columns[1:7]]]
            if with_ids:
                arrays.append(pa.array(columns[7], pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(arrays, NAMES[: len(arrays)])

        key_type = None
        for batch in batches:
            key_type = batch.column(0).type
            for part, data, offsets in pieces(batch, "text"):
                stream.add(part.column(0).to_pylist(), *tokens(bpe, data, offsets, end_id))
                if len(stream.ids) >= RUN_TOKENS and (rows := stream.flush(False)):
                    yield out(rows)
        if rows := stream.flush(True):
            yield out(rows)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


NAMES = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
