"""Byte-pair merging over ragged numpy arrays: many short symbol sequences advance together, a merge rank at a time."""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable
from functools import cache

import numpy as np

from tidelog.llm.vec import HashIndex, mixed, ragged, same_spans, span_hashes, unique_hashes

NONE = np.iinfo(np.int32).max
#: Sequences of more symbols go through the heap, whose cost doesn't grow with symbols times merges.
HEAP_FROM = 200
#: Symbols that an agenda of many sequences takes at once.
CACHED = 1 << 17
#: Distinct pre-tokens remembered by a worker before it starts afresh.
MEMO_SIZE = 1 << 20


class Merges:
    """Pairs of symbols with the rank and the result of merging them."""

    def __init__(self, pairs: list[tuple[int, int, int, int]]):
        rows = np.array(sorted(pairs), np.int64).reshape(-1, 4)
        self.keys = rows[:, 0] << 32 | rows[:, 1]
        self.ranks, self.results = np.append(rows[:, 2], NONE).astype(np.int32), np.append(rows[:, 3], 0).astype(np.int32)
        self._index = HashIndex(self.keys)
        self._dict: dict[int, tuple[int, int]] = {}

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE where the pair doesn't merge) and result of each pair."""
        at, _ = self._index.find(left.astype(np.int64) << 32 | right)
        return self.ranks[at], self.results[at]

    def get(self, left: int, right: int) -> tuple[int, int] | None:
        if not self._dict:
            self._dict = dict(zip(self.keys.tolist(), zip(self.ranks[:-1].tolist(), self.results[:-1].tolist(), strict=True), strict=True))
        return self._dict.get(left << 32 | right)


def merge_one(symbols: list[int], merges: Merges, dropped: Callable[[int, int, int], bool] | None = None, applied: Callable[[int, int, int], None] | None = None) -> list[int]:
    """One sequence by an agenda: the lowest rank, then the leftmost candidate; `dropped(start, middle, end)` skips a candidate.

    `applied` is told of each merge.
    """
    n = len(symbols)
    sym, after, before, end = list(symbols), [*range(1, n + 1)], [*range(-1, n - 1)], [*range(1, n + 1)]
    agenda: list[tuple[int, int, int, int, int]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n and (found := merges.get(sym[i], sym[j])) and not (dropped and dropped(i, j, end[j])):
            heapq.heappush(agenda, (found[0], i, j, end[j], found[1]))

    for i in range(n - 1):
        offer(i)
    alive = [True] * n
    while agenda:
        _, i, j, stop, result = heapq.heappop(agenda)
        if not alive[i] or not alive[j] or after[i] != j or end[j] != stop or end[i] != j:
            continue
        if applied:
            applied(i, j, stop)
        sym[i], end[i], alive[j], after[i] = result, stop, False, after[j]
        if after[i] < n:
            before[after[i]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [sym[i] for i in range(n) if alive[i]]


def merge_many(symbols: np.ndarray, lengths: np.ndarray, merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """Merge all sequences to the end; returns symbols and lengths in the same order.

    Each round looks up the pairs that changed, takes the lowest rank of every sequence and merges all its places at once
    (of overlapping ones every second, from the left). A sequence without candidates leaves.
    """
    seq = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    sym = symbols.astype(np.int32)
    rank, result = np.full(len(sym), NONE, np.int32), np.zeros(len(sym), np.int32)
    changed = np.arange(max(0, len(sym) - 1))
    done_sym, done_seq = [], []
    while len(sym):
        changed = changed[seq[changed] == seq[changed + 1]] if len(sym) > 1 else changed[:0]
        if len(changed):
            rank[changed], result[changed] = merges.find(sym[changed], sym[changed + 1])
        heads = np.flatnonzero(np.concatenate(([True], seq[1:] != seq[:-1])))
        low = np.minimum.reduceat(rank, heads)
        sizes = np.diff(np.append(heads, len(sym)))
        each = np.repeat(low, sizes)
        over = each == NONE
        if over.any():
            done_sym.append(sym[over])
            done_seq.append(seq[over])
            keep = ~over
            sym, seq, rank, result, each = sym[keep], seq[keep], rank[keep], result[keep], each[keep]
            if not len(sym):
                break
        at = np.flatnonzero(rank == each)
        if len(at) > 1:
            fresh = np.concatenate(([True], np.diff(at) != 1))
            place = np.arange(len(at))
            at = at[(place - np.maximum.accumulate(np.where(fresh, place, 0))) % 2 == 0]
        sym[at] = result[at]
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        rank[at] = NONE
        sym, seq, rank, result = sym[keep], seq[keep], rank[keep], result[keep]
        at -= np.arange(len(at))
        rank[at] = NONE
        left = at[at > 0] - 1
        rank[left[seq[left] == seq[left + 1]]] = NONE
        touched = np.zeros(len(sym), bool)
        touched[at] = touched[left] = True
        changed = np.flatnonzero(touched[:-1])
    sym, seq = np.concatenate(done_sym or [np.zeros(0, np.int32)]), np.concatenate(done_seq or [np.zeros(0, np.int64)])
    order = np.argsort(seq, kind="stable")
    return sym[order], np.bincount(seq, minlength=len(lengths))


def merge_each(symbols: np.ndarray, lengths: np.ndarray, merges: Merges, dropped: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray] | None = None, applied: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], None] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """All sequences by an agenda each, as `merge_one`, a candidate of every sequence a round; symbols and lengths in the same order.
    `dropped(sequence, start, middle, end)` says which candidates are skipped, `applied` is told of those that merge.

    Symbols keep their places and are linked, so that a round costs one minimum over the candidates held, and else work in
    proportion to its merges; finished sequences leave once they are a quarter. Some CACHED symbols at a time, whose arrays
    stay in a core's cache.
    """
    ends = np.cumsum(lengths)
    if len(symbols) > 2 * CACHED:
        cuts = np.unique(np.searchsorted(ends, np.arange(CACHED, len(symbols), CACHED)))
        cuts = np.concatenate(([0], cuts[(cuts > 0) & (cuts < len(lengths))], [len(lengths)])).tolist()
        edges, parts = np.append(0, ends), []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            both = (f and (lambda seq, *place, a=a, f=f: f(seq + a, *place)) for f in (dropped, applied))
            parts.append(_merge_each(symbols[edges[a] : edges[b]], lengths[a:b], merges, *both))
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    return _merge_each(symbols, lengths, merges, dropped, applied)


def _merge_each(symbols: np.ndarray, lengths: np.ndarray, merges: Merges, dropped, applied) -> tuple[np.ndarray, np.ndarray]:
    sym, lengths = symbols.astype(np.int32), lengths.astype(np.int64)
    first = np.cumsum(lengths) - lengths
    after = np.arange(1, len(sym) + 1) - np.repeat(first, lengths)  # the next symbol's place in the sequence, and so this one's end
    before, result, alive = after - 2, np.zeros(len(sym), np.int32), np.ones(len(sym), bool)
    none = np.int64(NONE) << 32

    def offers(seq: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Rank and place of the candidates that begin there."""
        out, at = none | place, first[seq] + place
        inside = np.flatnonzero(after[at] < lengths[seq])
        seq, place, at = seq[inside], place[inside], at[inside]
        middle = after[at]
        other = first[seq] + middle
        rank, result[at] = merges.find(sym[at], sym[other])
        if dropped is not None:
            some = np.flatnonzero(rank != NONE)
            rank[some[dropped(seq[some], place[some], middle[some], after[other[some]])]] = NONE
        out[inside] = rank.astype(np.int64) << 32 | place
        return out

    seq = np.flatnonzero(lengths > 1)
    size = lengths[seq]
    key, base = offers(np.repeat(seq, size), ragged(np.zeros(len(seq), np.int64), size)), np.cumsum(size) - size
    while len(seq):
        best = np.minimum.reduceat(key, base)
        going = best < none
        if 4 * np.count_nonzero(going) <= 3 * len(seq):
            key, seq, best = key[np.repeat(going, lengths[seq])], seq[going], best[going]
            base = np.cumsum(lengths[seq]) - lengths[seq]
            now, held = seq, base
        else:
            now, held, best = seq[going], base[going], best[going]
        place = best & 0xFFFFFFFF
        head = first[now]
        at = head + place
        gone = after[at]
        sym[at] = result[at]
        alive[head + gone] = False
        after[at] = end = after[head + gone]
        if applied is not None:
            applied(now, place, gone, end)
        key[held + gone] = none | gone
        inner = np.flatnonzero(end < lengths[now])
        before[head[inner] + end[inner]] = place[inner]
        left = before[at]
        more = np.flatnonzero(left >= 0)
        place = np.append(place, left[more])
        key[np.append(held, held[more]) + place] = offers(np.append(now, now[more]), place)
    total = np.append(0, np.cumsum(alive))
    return sym[alive], total[first + lengths] - total[first]


class Memo:
    """Symbols of the distinct spans met so far, found by hash and compared byte by byte; starts afresh beyond MEMO_SIZE spans."""

    def __init__(self, compute: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], hashed=span_hashes):
        self.compute, self.hashed = compute, hashed
        self._clear()

    def _clear(self) -> None:
        self.keys, self.at, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.text_at, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool, self.text = np.zeros(0, np.int32), np.zeros(0, np.uint8)

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each span: where its symbols lie in `pool`, how many they are, and the number of its entry (-1 if it has none).

        A span whose hash is that of an entry with other bytes is computed on its own.
        """
        if len(self.keys) > MEMO_SIZE or len(self.pool) > 16 * MEMO_SIZE:
            self._clear()
        distinct, example, index = unique_hashes(self.hashed(data, starts, ends))
        place = np.searchsorted(self.keys, distinct)
        known = np.zeros(len(distinct), bool)
        inside = place < len(self.keys)
        known[inside] = self.keys[place[inside]] == distinct[inside]
        new = np.flatnonzero(~known)
        if len(new):
            a, b = starts[example[new]], ends[example[new]]
            at, count = self._computed(data, a, b)
            text_at = np.cumsum(b - a) - (b - a) + len(self.text)
            self.text = np.concatenate((self.text, data[ragged(a, b - a)]))
            columns = (self.keys, distinct[new]), (self.at, at), (self.count, count), (self.text_at, text_at), (self.size, b - a)
            self.keys, self.at, self.count, self.text_at, self.size = (np.insert(old, place[new], add) for old, add in columns)
            place = np.searchsorted(self.keys, distinct)
        entry = place[index]
        at, count, size = self.at[entry], self.count[entry], ends - starts
        right = self.size[entry] == size
        # up to eight bytes the hash is a bijection for each size
        long = np.flatnonzero(right & (size > 8)) if self.hashed is span_hashes else np.flatnonzero(right)
        right[long] = same_spans(data, starts[long], self.text, self.text_at[entry[long]], size[long])
        wrong = np.flatnonzero(~right)
        if len(wrong):
            at[wrong], count[wrong] = self._computed(data, starts[wrong], ends[wrong])
            entry[wrong] = -1
        return at, count, entry

    def _computed(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        symbols, counts = self.compute(data, starts, ends)
        at = np.cumsum(counts) - counts + len(self.pool)
        self.pool = np.concatenate((self.pool, symbols))
        return at, counts


#: Code points of Unicode's White_Space property (fixed values).
WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3


@cache
def classes() -> np.ndarray:
    """White space, letter, number or other for each code point."""
    import unicodedata

    out = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x32400):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LN":
            out[c] = LETTER if kind == "L" else NUMBER
    out[WHITE] = SPACE
    return out


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes and where each begins."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[at].astype(np.int32)
    wide = np.flatnonzero(lead >= 0x80)
    if len(wide):
        w, b = at[wide], lead[wide]
        padded = np.concatenate((data, np.zeros(3, np.uint8))).astype(np.int32)
        one, two, three = (padded[w + k] & 0x3F for k in (1, 2, 3))
        lead[wide] = np.where(b < 0xE0, (b & 0x1F) << 6 | one, np.where(b < 0xF0, (b & 0x0F) << 12 | one << 6 | two, (b & 0x07) << 18 | one << 12 | two << 6 | three))
    return lead, at


def pre_tokens(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Byte starts of the pre-tokens of the texts between `bounds` (ascending byte places, first 0, last the end).

    The pattern is that of byte-level BPE vocabularies: contractions, then letters, numbers or other signs with at most one
    blank before them, then white space, of which the last before a text's next sign stands apart.
    """
    points, at = code_points(data)
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes()[points]
    head = np.zeros(n + 1, bool)
    head[np.searchsorted(at, bounds)] = True
    head[n] = True
    turn = head[:n].copy()
    turn[1:] |= kind[1:] != kind[:-1]
    begins = turn.copy()
    solid = np.flatnonzero(turn & (kind != SPACE))
    after_space = solid[(solid > 0) & ~head[solid] & (kind[solid - 1] == SPACE)]
    begins[after_space - 1] = True
    begins[after_space[points[after_space - 1] == 32]] = False
    quotes = np.flatnonzero((points == 39) & begins & ~np.append(head[1:n], True))
    quotes = quotes[quotes + 1 < n]
    if len(quotes):
        one = points[quotes + 1]
        two = np.where((quotes + 2 < n) & ~head[np.minimum(quotes + 2, n)], points[np.minimum(quotes + 2, n - 1)], 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        for which, size in ((short, 2), (long, 3)):
            q = quotes[which]
            begins[q + 1] = False
            q = q[q + size < n]
            begins[q + size] = True
    return at[begins]


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {}, 256
    for b in range(256):
        out[b] = chr(b) if b in plain else chr(extra)
        extra += b not in plain
    return [out[b] for b in range(256)]


class ByteBPE:
    """Ids of a byte-level BPE vocabulary in the tokenizers format."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            described = json.load(f)
        vocab = described["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in described["model"]["merges"]]
        self.merges = Merges([(vocab[a], vocab[b], rank, vocab[a + b]) for rank, (a, b) in enumerate(merges)])
        self.byte_ids = np.array([vocab[c] for c in byte_alphabet()], np.int32)
        self.special = {t["content"].encode(): t["id"] for t in described["added_tokens"]}
        self.memo = Memo(self._compute)

    def _compute(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lengths = ends - starts
        symbols = self.byte_ids[data[ragged(starts, lengths)]]
        short = lengths <= HEAP_FROM
        if short.all():
            return merge_many(symbols, lengths, self.merges)
        out, counts = merge_many(symbols[np.repeat(short, lengths)], lengths[short], self.merges)
        parts, all_counts = np.split(out, np.cumsum(counts)[:-1]) if len(counts) else [], np.zeros(len(lengths), np.int64)
        at, result, k = np.cumsum(lengths) - lengths, [], 0
        for i, small in enumerate(short.tolist()):
            if small:
                result.append(parts[k])
                k += 1
            else:
                result.append(np.array(merge_one(symbols[at[i] : at[i] + lengths[i]].tolist(), self.merges), np.int32))
            all_counts[i] = len(result[-1])
        return np.concatenate(result), all_counts

    def spans(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the pre-tokens of all texts: byte starts, place of the symbols in `memo.pool` and their number; and each text's range.

        A special string inside a text is one symbol, and the texts around it are apart; it has the place -1 - id.
        """
        raw, marks = None, []
        for content, number in self.special.items():
            raw = data.tobytes() if raw is None else raw
            found = raw.find(content)
            while found >= 0:
                end = found + len(content)
                if np.searchsorted(offsets, found, "right") == np.searchsorted(offsets, end, "left"):
                    marks.append((found, end, number))
                    found = raw.find(content, end)
                else:
                    found = raw.find(content, found + 1)
        bounds = np.unique(np.concatenate((offsets, [m[0] for m in marks], [m[1] for m in marks]))).astype(np.int64) if marks else offsets
        starts = pre_tokens(data, bounds)
        if marks:
            whole = np.ones(len(starts), bool)
            for a, b, _ in marks:
                i, j = np.searchsorted(starts, (a, b))
                whole[i + 1 : j] = False
            starts = starts[whole]
        ends = np.append(starts[1:], len(data)) if len(starts) else starts
        at, count, _ = self.memo.find(data, starts, ends)
        for a, _, number in marks:
            i = np.searchsorted(starts, a)
            at[i], count[i] = -1 - number, 1
        return starts, at, count, np.searchsorted(starts, offsets)

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Number of ids of each text."""
        _, _, count, bounds = self.spans(data, offsets)
        total = np.append(0, np.cumsum(count))
        return total[bounds[1:]] - total[bounds[:-1]]

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids, each text's range in them, and the byte where each pre-token begins."""
        starts, at, count, bounds = self.spans(data, offsets)
        return self.ids_of(at, count, bounds, starts)

    def ids_of(self, at: np.ndarray, count: np.ndarray, bounds: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As `ids`, from what `spans` returned."""
        total = np.append(0, np.cumsum(count))
        out = self.memo.pool[np.maximum(ragged(at, count), 0)] if len(self.memo.pool) else np.zeros(total[-1], np.int32)
        special = np.flatnonzero(at < 0)
        out[total[special]] = -1 - at[special]
        return out, total[bounds], starts


@cache
def byte_bpe(path: str) -> ByteBPE:
    """One vocabulary for each worker process."""
    return ByteBPE(path)


def keyed(seed: int, *parts: np.ndarray) -> np.ndarray:
    """A hash of equally long integer arrays under a seed."""
    out = np.full(1, np.uint64(seed & 0xFFFFFFFFFFFFFFFF))
    for p in parts:
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + np.asarray(p).astype(np.uint64))
    return out
