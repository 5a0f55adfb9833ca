"""Arrow string columns as numpy byte arrays: words, hashes and digests of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Text bytes handled at once; numpy's temporaries are a small multiple of it.
PIECE_BYTES = 1 << 21

_space = np.zeros(256, bool)
_space[[32, *range(9, 14)]] = True
SPACE = _space
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
LOWER = _lower
ODD = 0x9E3779B97F4A7C15


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the offsets of its rows; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None and len(column) else np.zeros(0, np.uint8)
    return data, offsets - (offsets[0] if len(offsets) else 0)


def pieces(batch: pa.RecordBatch, column: str = "text", limit: int = 0) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with whole texts of about `limit` bytes together (one text at least), their bytes and offsets."""
    if not batch.num_rows:
        return
    data, offsets = texts(batch.column(column))
    limit, at = limit or PIECE_BYTES, 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        end = min(end, batch.num_rows)
        yield batch.slice(at, end - at), data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def buffers(batches: Iterator[pa.RecordBatch], column: str = "text", rows: int = 512, limit: int = 0) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """`pieces` of batches, a few rows at a time: a task holds no copy of the texts of a whole batch."""
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield from pieces(batch.slice(first, rows), column, limit)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words (runs of bytes that aren't ASCII white space), and each text's range in them."""
    solid = ~SPACE[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = solid[:-1], solid[1:]
    filled = offsets[:-1] < offsets[1:]
    before[offsets[:-1][filled]] = False
    after[offsets[1:][filled] - 1] = False
    starts = np.flatnonzero(solid & ~before)
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte span. Every eight bytes are mixed with their place in the span before they are summed, so
    no arithmetic of the bytes carries over to the hash; two seeds give 128 bits."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = ends - starts
    parts = (sizes + 7) >> 3
    padded = np.append(data, np.zeros(8, np.uint8))
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    first = np.cumsum(parts) - parts
    place = np.arange(int(parts.sum())) - np.repeat(first, parts)
    at = np.repeat(starts, parts) + 8 * place
    value = eight[at]
    left = np.repeat(ends, parts) - at
    short = left < 8
    value[short] &= (U64(1) << (left[short] << 3).astype(np.uint64)) - U64(1)
    most = int(place.max(initial=0)) + 1
    keys = mixed(np.arange(most, dtype=np.uint64) * U64(ODD) + U64((seed * 0xD1342543DE82EF95 + 0x632BE59BD9B4E019) & (2**64 - 1)))
    sums = np.append(U64(0), np.cumsum(mixed(value ^ keys[place])))
    return mixed(sums[first + parts] - sums[first] + sizes.astype(np.uint64) * U64(0xD1342543DE82EF95) + U64(seed))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text, A-Z lower-cased, and each text's range in them."""
    low = LOWER[data]
    starts, ends, bounds = words(low, offsets)
    return span_hashes(low, starts, ends), bounds


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its `size`-word shingles; a shorter text is one shingle, one without words none."""
    hashes, bounds = word_hashes(data, offsets)
    weights = [U64(2 * pow(ODD, k + 3, 1 << 62) + 1) for k in range(size)]
    rolled = np.zeros(max(0, len(hashes) - size + 1), np.uint64)
    for k in range(size):
        rolled += hashes[k : len(hashes) - size + 1 + k] * weights[k]
    rolled = mixed(rolled)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= size:
            own = np.sort(rolled[a : b - size + 1])
            keep = np.empty(len(own), bool)
            keep[0] = True
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            out.append(own[keep])
        elif b > a:
            short = hashes[a:b] * np.array(weights[: b - a])
            out.append(mixed(np.array([short.sum(dtype=np.uint64) + U64(b - a)])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[0].. +lengths[0], starts[1].. and so on, in one array."""
    total = int(lengths.sum())
    out = np.arange(total, dtype=np.int64)
    first = np.cumsum(lengths) - lengths
    out += np.repeat(starts.astype(np.int64) - first, lengths)
    return out


def unique_hashes(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values ascending, the place of one example of each, and for each value its index among them."""
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    new = np.empty(len(ordered), bool)
    new[:1] = True
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    index = np.empty(len(hashes), np.int64)
    index[order] = np.cumsum(new) - 1
    return ordered[new], order[new], index


def same_spans(a: np.ndarray, a_starts: np.ndarray, b: np.ndarray, b_starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether each pair of byte spans of one size holds the same bytes."""
    at = ragged(a_starts, sizes)
    differ = np.append(0, np.cumsum(a[at] != b[ragged(b_starts, sizes)]))
    edges = np.append(0, np.cumsum(sizes))
    return differ[edges[1:]] == differ[edges[:-1]]


class HashIndex:
    """Places of distinct 64-bit keys. Each key lies in one of two slots, so a search reads two at most."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.append(keys, keys.dtype.type(0))  # behind the keys: no key
        self.bits = max(4, (4 * len(keys)).bit_length())
        while not self._placed(keys):
            self.bits += 1

    def _slots(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = keys.astype(np.uint64) * U64(ODD)
        h ^= h >> U64(29)
        h *= U64(0xBF58476D1CE4E5B9)
        return (h >> U64(64 - self.bits)).astype(np.int64), (h & U64((1 << self.bits) - 1)).astype(np.int64)

    def _placed(self, keys: np.ndarray) -> bool:
        """Put every key in one of its slots, moving others to their second one; False if that doesn't end."""
        none = len(keys)
        self.table = np.full(1 << self.bits, none, np.int32)
        both = np.stack(self._slots(keys))
        waiting, turn = np.arange(none, dtype=np.int32), np.zeros(none, np.int64)
        for _ in range(64):
            if not len(waiting):
                break
            slots = both[turn[waiting], waiting]
            out = self.table[slots]
            self.table[slots] = waiting
            lost = waiting[self.table[slots] != waiting]  # of several for one slot the last stays
            moved = np.unique(out[out < none])
            moved = moved[self.table[both[turn[moved], moved]] != moved]
            turn[moved] ^= 1
            turn[lost] ^= 1
            waiting = np.append(lost, moved)
        return not len(waiting)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each key's place, and whether it is there at all (its place is then that behind all keys)."""
        one, two = self._slots(keys)
        none = len(self.keys) - 1
        at = self.table[one]
        missed = np.flatnonzero((self.keys[at] != keys) | (at == none))
        if len(missed):
            other = self.table[two[missed]]
            at[missed] = np.where(self.keys[other] == keys[missed], other, none)
        return at, at != none
