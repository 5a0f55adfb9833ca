"""Each operator against a brute-force version, an exact round trip or held-out accuracy, and the awkward inputs."""

import hashlib
import math
import random
import re
import string
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidelog.llm import ann, bpe, chunks, exact, graph, langid, lm, packing, secrets, sentencepieces, setjoin, token_counts

public_tokenizers = pytest.importorskip("public_tokenizers")
BYTE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
AWKWARD = [None, "", " \n\t", "a", "Ab aB", "é日本 <|endoftext|> don't", "x" * 5000, "word " * 3000, "word " * 3000, "▁ ▁▁  \x00"]
SYLLABLES = ["the", "an", "er", "on", "re", "st", "ti", "ou", "ha", "en"]


def sentence(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(n)) + "."


def corpus():
    rng = random.Random(5)
    texts = list(AWKWARD)
    base = sentence(rng, 120)
    for k in range(12):  # edited copies: of the base and of one another
        words = base.split()
        for _ in range(k):
            words[rng.randrange(len(words))] = sentence(rng, 1)
        texts.append(" ".join(words))
    texts += [sentence(rng, rng.randint(1, 80)) for _ in range(40)]
    texts += [t.upper() for t in texts[12:16] if t]
    return [(i * 3, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    # columns whose names clash with the operators' own
    rows = [(i, t, "en", i, "x") for i, t in corpus()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, id long, n string").repartition(3).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def brute_components(rows, size, num, den):
    sets, parent = {}, {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} or ({tuple(w)} if w else set())
        parent[i] = i

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("size", "num"), [(4, 85), (2, 50)])
def test_set_join(docs, size, num):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in setjoin.near_components(docs, size, num, 100).collect()}
    assert got == brute_components(corpus(), size, num, 100)


@pytest.mark.parametrize(("first", "last_first"), [(0, False), (-60, True)])
def test_set_join_whatever_the_ids(spark, first, last_first):
    """A hub, many copies with a common tail, and a text that links with the copies only."""
    rng = random.Random(9)
    words = [f"w{k}x{rng.randrange(10**6)}" for k in range(100)]
    tail = [f"tail{k}" for k in range(10)]
    texts = [" ".join(words)] + [" ".join(words + tail[:9] + [f"own{k}"]) for k in range(100)] + [" ".join(words + tail + [f"more{k}" for k in range(5)] * 3)]
    rows = [(first + k, t) for k, t in enumerate(texts)]
    if last_first:
        rows = [(i, t) for (i, _), (_, t) in zip(rows, reversed(rows), strict=True)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in setjoin.near_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, 100).collect()}
    assert got == brute_components(rows, 4, 85, 100)


@pytest.mark.parametrize("seed", [1])
def test_set_join_of_a_loose_group(spark, seed):
    """Members that lie too far from their hub to link with it, and lists of up to 500 entries of mixed sizes."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(200)]
    rows = []
    for k in range(500):
        cut, add = rng.choice([(0, 45), (45, 0), (20, 25), (30, 10), (5, 60)])
        lines = words[cut:] if rng.random() < 0.5 else words[: len(words) - cut]
        rows.append((k - 20, " ".join(lines + [f"extra{j}" for j in range(max(0, add - 3))] + [f"own{k}-{j}" for j in range(rng.randrange(4))])))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in setjoin.near_components(spark.createDataFrame(rows, "doc_id long, text string"), 2, 85, 100).collect()}
    assert got == brute_components(rows, 2, 85, 100)


def test_set_join_of_repeated_and_missing_ids(spark):
    rng = random.Random(2)
    a, b, c = (sentence(rng, 40) for _ in range(3))
    rows = [(5, a), (5, a), (5, b), (3, a + " more"), (None, b), (None, c), (None, None), (9, b)]
    got = sorted(((r.doc_id, r.component_id, r.n_shingles) for r in setjoin.near_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, 100).collect()), key=str)
    n = {t: len({tuple(t.lower().split()[k : k + 4]) for k in range(len(t.split()) - 3)}) for t in (a, b, c, a + " more")}
    want = [(5, 3, n[a]), (5, 3, n[a]), (5, 5, n[b]), (3, 3, n[a + " more"]), (None, 5, n[b]), (None, None, n[c]), (None, None, 0), (9, 5, n[b])]
    assert got == sorted(want, key=str)


@pytest.mark.parametrize(("within", "members"), [(True, 40), (True, 400), (False, 40), (False, 400)])
def test_index_lists_lose_no_pair(spark, within, members):
    rng, link = random.Random(members), setjoin.Threshold(85, 100)
    rows = []
    for i in range(members):
        n = rng.choice([60, 70, 82, 84, 90, 96, 100])
        span = rng.choice([8, 12, 20]) if within else None
        rows.append((7, i, n, span, rng.randrange(min(span or 10, 10)), rng.choice([-7, -7, 5000, i]) if within else i % 5))
    entries = spark.createDataFrame(rows, "token long, id long, n int, span int, pos int, kind long")
    got = {(r.a, r.b) for r in setjoin.candidates(entries, link, within).collect()}
    want = set()
    for _, a, n, s, p, x in rows:
        for _, b, m, t, q, y in rows[a + 1 :]:
            share = max(1, -((link.apart(n, m) - s - t) // 2)) if within else link.need(n, m)
            left = min(s - p, t - q) if within else min(n - p, m - q)
            if left >= share and min(n, m) >= link.least(max(n, m)) and x != y:
                want.add((a, b))
    assert want and got == want


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(40)] + [(100 + rng.randrange(20), 100 + rng.randrange(20)) for _ in range(15)] + [(200, 200)]
    got = {r.id: r.component_id for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    parent = {x: x for p in links for x in p}
    for _ in parent:
        for a, b in links:
            parent[a] = parent[b] = min(parent[a], parent[b])
    assert got == {x: p for x, p in parent.items() if any(x in link and link[0] != link[1] for link in links)}


@pytest.mark.parametrize("weak", [False, True])
def test_exact_groups(docs, weak):
    hashed = (lambda t: F.length(t)) if weak else exact.content_hash
    got = {r.doc_id: r for r in exact.exact_groups(docs, keep="max", normalise=exact.ascii_lower, hashed=hashed).collect()}
    norm = {i: re.sub("[A-Z]", lambda m: m[0].lower(), t or "") for i, t in corpus()}
    for i, t in norm.items():
        same = [k for k, u in norm.items() if u == t]
        assert (got[i].keep_id, got[i].group_size, got[i].kept) == (max(same), len(same), i == max(same))
        assert got[i].text_sha256 == hashlib.sha256(t.encode()).hexdigest()


def brute_secrets(text):
    text, spans = text or "", []
    for rank, (kind, pattern, group, least) in enumerate(secrets.PATTERNS):
        flags = re.I if pattern.startswith("(?i)") else 0
        spans += [(m.start(), rank, m.end(), kind) for m in re.finditer(pattern.removeprefix("(?i)"), text, flags | re.A) if len(m[group]) >= least]
    for rank, of in enumerate(secrets.CLASSES, len(secrets.PATTERNS)):
        for m in re.finditer(f"{of.run}{{{of.window},}}", text):
            if any(s < m.end() and m.start() < e for s, _, e, _ in spans) or any(re.fullmatch(p, m[0]) for p in secrets.ALLOWED):
                continue
            sums = [sum(secrets.weighted_log(c) for c in Counter(m[0][k : k + of.window]).values()) for k in range(len(m[0]) - of.window + 1)]
            if min(sums) <= int(of.window * (math.log2(of.window) - of.bits) * secrets.SCALE):
                spans.append((m.start(), rank, m.end(), of.kind))
    return sorted(spans)


def brute_redacted(text, spans):
    out, at = [], 0
    for start, _, end, _ in spans:
        if start >= at:
            out += [text[at:start], "[SECRET]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def test_secrets_of_long_texts(spark):
    """More matches than a block of them, overlapping ones of several kinds, in one text; time in proportion to their number."""
    rng = random.Random(11)

    def text(n):
        kinds = ("0123456789abcdef", string.ascii_letters + string.digits + "+/=_-")
        word = lambda: "".join(rng.choices(rng.choice(kinds), k=rng.randrange(8, 45)))
        return "".join(rng.choice(["password = ", "token:", "AKIA", " ", "é ", "\n"]) + word() + rng.choice([" ", "ü", "."]) for _ in range(n))

    texts = [text(n) for n in (1, 300, 3000)]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    found = secrets.scan_secrets(frame)
    for r in found.select("text", "secrets", secrets.redacted(F.col("text"), F.col("secrets")).alias("out")).collect():
        want = brute_secrets(r.text)
        assert [tuple(s) for s in r.secrets] == want
        assert r.out == brute_redacted(r.text, want)
    sums = spark.createDataFrame([(list(range(k)),) for k in (0, 1, 256, 257, 70000)], "v array<int>").select("v", secrets.running(F.col("v"), F.greatest, 0).alias("most"), secrets.running(F.col("v"), lambda x, y: F.least(x, y), 9).alias("least"))
    for r in sums.collect():
        assert r.most == r.v and r.least == [0] * len(r.v)


def test_secrets(spark):
    rng = random.Random(2)
    alphabet = "abcdefABCDEF0123456789+/_=-Zxyz"
    parts = ["password = ", 'Token:"', "api-key=", "API_KEY : ", "AKIA", "é ", " \n", "secret=short ", "token: secret: 'abcdefghijklmnop' "]
    texts = list(AWKWARD) + ["".join(rng.choice(parts) + "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 45))) for _ in range(rng.randint(1, 6))) for _ in range(150)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for r in secrets.scan_secrets(rows).collect():
        assert [tuple(s) for s in r.secrets] == brute_secrets(r.text), r.text
    masked = secrets.scan_secrets(rows).select("text", "secrets", secrets.redacted(F.col("text"), F.col("secrets")).alias("out")).collect()
    assert all(r.out == r.text for r in masked if not r.secrets) and all("[SECRET]" in r.out for r in masked if r.secrets)


def test_token_counts_and_packing(docs):
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(BYTE)
    ids = {i: reference.encode(t or "", add_special_tokens=False).ids for i, t in corpus()}
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(docs, BYTE).collect()}
    assert got == {i: (len((t or "").encode()), len(ids[i])) for i, t in corpus()}
    rows = packing.pack(docs, BYTE, window=64, with_ids=True).collect()
    sequences, pieces = {}, {}
    for r in rows:
        whole = ids[r.doc_id] + [0]
        assert r.ids == whole[r.start : r.start + r.length] and r.doc_tokens == len(whole)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
    for parts in [*sequences.values(), *pieces.values()]:
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
    sizes = [sum(n for _, n in parts) for parts in sequences.values()]
    assert max(sizes) <= 64 and {i: sum(n for _, n in p) for i, p in pieces.items()} == {i: len(x) + 1 for i, x in ids.items()}
    assert sum(0 if s & (s - 1) == 0 else 64 - s for s in sizes) < 0.1 * sum(sizes)  # cuts cost 2 or 6 of so small windows


def test_cuts_are_cheapest():
    rng, window = random.Random(4), 16
    for _ in range(60):
        places = [0]
        while places[-1] < 60:
            places.append(places[-1] + rng.randint(1, 12))
        costs = [0] + [rng.choice([0, 2, 6]) for _ in places[1:]]
        best, _ = packing.choose_cuts(np.array(places), np.array(costs), window, 5, 1, 0)
        pad = lambda n: 0 if n & (n - 1) == 0 else window - n
        brute = [0] + [math.inf] * (len(places) - 1)
        for j in range(1, len(places)):
            for i in range(j):
                n = places[j] - places[i]
                cost = pad(n) if n <= window else pad(n - window) + 5 if n <= 2 * window else math.inf
                brute[j] = min(brute[j], brute[i] + cost + costs[j])
        assert best == brute


def test_merging_all_at_once_is_merging_by_agenda():
    model = bpe.byte_bpe(BYTE)
    rng = random.Random(6)
    words = ["".join(rng.choice("abthein ") for _ in range(rng.randint(1, 30))).encode() for _ in range(300)]
    flat = model.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
    out, counts = bpe.merge_many(flat, np.array([len(w) for w in words]), model.merges)
    at = np.append(0, np.cumsum(counts))
    assert all(out[at[i] : at[i + 1]].tolist() == bpe.merge_one(model.byte_ids[list(w)].tolist(), model.merges) for i, w in enumerate(words))


def test_pieces_round_trip(docs):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    plain = {r.doc_id: r.ids for r in sentencepieces.encode(docs, PIECE, dropout=0.0).collect()}
    assert all(plain[i] == library.encode(t or "") for i, t in corpus() if "▁" not in (t or ""))
    varied = sentencepieces.encode(docs, PIECE, dropout=0.3, seed=9)
    back = {r.doc_id: r for r in sentencepieces.decode(varied, PIECE).collect()}
    assert all(back[i].text == (t or "") and back[i].lossless for i, t in corpus())
    again = {r.doc_id: r.ids for r in sentencepieces.encode(docs.repartition(1), PIECE, dropout=0.3, seed=9).collect()}
    assert {i: r.ids for i, r in back.items()} == again
    other = {r.doc_id: r.ids for r in sentencepieces.encode(docs, PIECE, dropout=0.3, seed=10).collect()}
    assert again != other and again != plain


def brute_pieces(model, text, key):
    """Merge-dropout by the plainest agenda: of all neighbours that may merge the best score, the leftmost first."""
    out = []
    words = re.findall(r" +[^ ]*", " " + text) if text else []
    for number, word in enumerate(words):
        symbols = [(int(model.symbol[ord(c)]), k, k + 1) for k, c in enumerate(word)]
        symbols = [(s if s >= 0 else -1 - ord(word[a]), a, b) for s, a, b in symbols]
        own = bpe.keyed(model.seed, np.array([key]), np.array([number]))
        while True:
            found = []
            for i in range(len(symbols) - 1):
                hit = model.merges.get(symbols[i][0], symbols[i + 1][0]) if min(symbols[i][0], symbols[i + 1][0]) >= 0 else None
                place = symbols[i][1] << 42 | symbols[i][2] << 21 | symbols[i + 1][2]
                if hit and bpe.keyed(model.seed, own, np.array([place]))[0] >= model.limit:
                    found.append((hit[0], i, hit[1]))
            if not found:
                break
            _, i, result = min(found)
            symbols[i : i + 2] = [(result, symbols[i][1], symbols[i + 1][2])]
        out += [x for s, *_ in symbols for x in ([s] if s >= 0 else [model.byte_base + b for b in chr(-1 - s).encode()])]
    return out


def test_dropout_is_drawn_for_each_place():
    model = sentencepieces.PieceBPE(PIECE, 0.2, 5)
    rng = random.Random(3)
    texts = ["the of the of the", "", "a", "é日本 ▁", "information " * 30, "x" * 300] + [sentence(rng, 20) for _ in range(20)]
    data = [t.encode() for t in texts]
    for _ in range(2):  # the second time from the memo
        ids, bounds = model.encode(np.frombuffer(b"".join(data), np.uint8), np.append(0, np.cumsum([len(d) for d in data])), np.arange(len(texts)) * 11)
        got = [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        assert got == [brute_pieces(model, t, 11 * k) for k, t in enumerate(texts)]
    many = "information " * 500
    ids, bounds = model.encode(np.frombuffer((many * 1).encode(), np.uint8), np.array([0, len(many)]), np.array([7]))
    starts = np.flatnonzero(np.char.startswith([bytes(model.text[model.text_at[i] : model.text_at[i] + model.text_size[i]]).decode() for i in ids], " "))
    assert len({tuple(x.tolist()) for x in np.split(ids, starts[1:])}) > 8


def test_only_words_that_lose_a_merge_run_again(monkeypatch):
    """A skipped candidate that wouldn't have merged changes nothing; agendas of many words, in parts, are those of each word."""
    monkeypatch.setattr(bpe, "CACHED", 50)
    model, again = sentencepieces.PieceBPE(PIECE, 0.05, 5), []
    text = "information " * 500
    model.encode(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]), np.array([1]))
    plain = model._merged
    monkeypatch.setattr(model, "_merged", lambda s, n, *more: again.append(len(n)) or plain(s, n, *more))
    ids, _ = model.encode(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]), np.array([7]))
    assert ids.tolist() == brute_pieces(model, text, 7)
    assert len(again) == 1 and 100 < again[0] < 275  # 11 merges a word: 0.43 of the words; with all candidates more than 0.6


def twins(n):
    """The Thue-Morse word of n letters and its complement: polynomial hashes modulo 2^64 give both one value."""
    a, b = "a", "b"
    while len(a) < n:
        a, b = a + b, b + a
    return a, b


@pytest.mark.parametrize("n", [4096])
def test_twin_words_are_told_apart(spark, n):
    from tokenizers import Tokenizer

    one, two = twins(n)
    docs = spark.createDataFrame([(0, one), (1, two), (2, f"{one} {two}"), (3, one)], "doc_id long, text string").coalesce(1)
    reference = Tokenizer.from_file(BYTE)
    ids = {i: reference.encode(t, add_special_tokens=False).ids for i, t in docs.collect()}
    assert {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, BYTE).collect()} == {i: len(x) for i, x in ids.items()}
    packed = {}
    for r in packing.pack(docs, BYTE, with_ids=True).orderBy("doc_id", "start").collect():
        packed.setdefault(r.doc_id, []).extend(r.ids)
    assert packed == {i: x + [0] for i, x in ids.items()}
    assert all(r.lossless for r in sentencepieces.encode(docs, PIECE).collect())
    assert {r.doc_id: r.component_id for r in setjoin.near_components(docs).collect()} == {0: 0, 1: 1, 2: 2, 3: 0}
    counts = {one: 3, two: 1, "": 3}  # in the training texts; N = 7, V = 3
    for r in lm.score(docs, F.col("doc_id") != 1).join(docs, "doc_id").collect():
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / 11) for w in [*r.text.split(), ""]), rel_tol=1e-9)


def test_a_memo_compares_bytes():
    model = bpe.ByteBPE(BYTE)
    weak = bpe.ByteBPE(BYTE)
    weak.memo.hashed = lambda data, starts, ends, seed=0: (ends - starts).astype(np.uint64)  # all of one length collide
    texts = [b"house", b"mouse", b"a very long compound word", b"antidisestablishmentarianism", b"abcdefghijklmnopqrstuvwxyzab", b"house"]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.append(0, np.cumsum([len(t) for t in texts]))
    for _ in range(2):
        got, want = weak.ids(data, offsets), model.ids(data, offsets)
        assert got[0].tolist() == want[0].tolist() and got[1].tolist() == want[1].tolist()


def test_repeated_passages(spark):
    rng = random.Random(7)
    lengths = [30, 45, 49, 50, 51, 52, 55, 60, 80, 150, 400] * 2
    passages = [sentence(rng, n)[:-1] for n in lengths]
    rows, planted = [], {}
    for k, passage in enumerate(passages):
        for copy in range(2 + k % 3):
            key = 100 + 10 * k + copy
            before, after = f"{sentence(rng, 30 + copy)} b{key}", f"a{key} {sentence(rng, 20)}"  # the words next to it differ
            text = f"{before} {passage.upper() if copy else passage}  {after}"
            rows.append((key, text))
            planted[key] = (len(before) + 1, len(before) + 1 + len(passage), len(passage.split()), 100 + 10 * k)
    rows += [(1, None), (2, ""), (3, "la " * 500), (4, sentence(rng, 2)), (5, "é " + sentence(rng, 90)), (None, sentence(rng, 90))]
    rows += [(6, rows[-2][1].replace("é", "ü")), (7, sentence(rng, 70)), (7, rows[-1][1] + " x"), (7, rows[-1][1] + " x"), (5, rows[-2][1])]
    docs = spark.createDataFrame([(i, t, "a", "b") for i, t in rows], "doc_id long, text string, spans string, id string")
    found = {}
    for r in chunks.repeated_passages(docs).collect():
        found.setdefault(r.doc_id, []).append(r)
    for key, (start, end, n, first) in planted.items():
        mine = found.get(key, [])
        if n < 50:
            assert not mine, (key, n)
        else:
            assert [(r.start, r.end, r.n_words, r.first_id, r.kept) for r in mine] == [(start, end, n, first, key == first)], (key, n)
    assert set(found) == {k for k, p in planted.items() if p[2] >= 50} | {5, 6, 7, None}  # a row without an id repeats what 7 keeps; what one id alone holds twice is no repeat
    assert [(r.start, r.n_words, r.kept) for r in found[6]] == [(2, 90, False)]
    left = {}
    for r in chunks.without_repeats(docs, chunks.repeated_passages(docs)).collect():
        left.setdefault(r.doc_id, []).append(r.text)
    texts = dict(rows)
    assert all(left[k] == [texts[k] if k == p[3] or p[2] < 50 else texts[k][: p[0]] + texts[k][p[1] :]] for k, p in planted.items())
    assert left[1] == [None] and left[6] == ["ü "]


def brute_passages(rows, size):
    """Repeated windows, each kept by the first document that holds it, and runs of neighbouring ones of one keeper."""
    holders, texts = {}, {}
    for i, t in rows:
        if t is None:
            continue
        words = [(m.start(), m.end(), m.group().decode("latin-1")) for m in re.finditer(rb"[^ \t-\r]+", t.encode("utf-8").lower())]
        texts[i, t] = words
        doc = (i is None, i or 0, t if i is None else "")
        for k in range(len(words) - size + 1):
            holders.setdefault(tuple(w for _, _, w in words[k : k + size]), set()).add(doc)
    out = set()
    for (i, t), words in texts.items():
        run = None
        for k in range(len(words) - size + 2):
            docs = holders.get(tuple(w for _, _, w in words[k : k + size]), set()) if k <= len(words) - size else set()
            # the keeper among rows without an id is one of smallest hash, not of smallest text: told by its being the only one or not
            first = min(docs) if len(docs) > 1 else None
            if run and (first is None or first != run[0]):
                out.add((i, t, *run))
                run = None
            if first is not None:
                start, end = (len(t.encode()[:x].decode()) for x in (words[k][0], words[k + size - 1][1]))
                run = (first, run[1] if run else start, end)
    return {(i, t, start, end, None if first[0] else first[1], first == (i is None, i or 0, t if i is None else "")) for i, t, first, start, end in out}, holders


@pytest.mark.parametrize("seed", [1, 2])
def test_all_passages_against_brute_force(spark, seed):
    """Passages side by side, nested, over one another, in three and more documents, of 50 to 500 words; ids that are missing or repeat."""
    rng = random.Random(seed)
    parts = [sentence(rng, n)[:-1].split() for n in (50, 50, 51, 52, 55, 57, 60, 80, 100, 100, 130, 200, 500)]
    parts += [parts[-1][a : a + n] for a, n in ((0, 50), (100, 61), (300, 200), (449, 51))] + [parts[9][-6:] + parts[8], parts[7][:49], parts[10][20:90]]
    texts = []
    for _ in range(70):
        words = sentence(rng, rng.randint(0, 30)).split()
        for _ in range(rng.randint(1, 4)):
            words += rng.choice(parts) + (sentence(rng, rng.randint(1, 20)).split() if rng.random() < 0.5 else [])
        texts.append(rng.choice([" ", "  ", "\n"]).join(w.upper() if rng.random() < 0.01 else w for w in words))
    rows = [(k, t) for k, t in enumerate(texts)] + [(5, texts[6]), (5, texts[5]), (5, texts[5]), (99, None), (98, ""), (97, "ü " + texts[8]), (None, texts[9] + " und"), (96, "la " * 300), (95, "la " * 120)]
    for x in range(13):  # the case of a passage that begins one document's copy and ends another's
        a, b = sentence(rng, 100)[:-1].split(), sentence(rng, 100)[:-1].split()
        rows += [(200 + 10 * x, " ".join(a)), (204 + 10 * x, " ".join(a + b)), (208 + 10 * x, " ".join(a[-6:] + b))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    passages = chunks.repeated_passages(docs).cache()
    want, holders = brute_passages(rows, 50)
    text_of = {(r.doc_id, r.h): r.text for r in docs.select("doc_id", F.xxhash64("text").alias("h"), "text").collect()}
    got = [(r.doc_id, text_of[r.doc_id, r.text_hash], r.start, r.end, r.first_id, r.kept) for r in passages.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    left = set()
    for r in chunks.without_repeats(docs, passages).collect():
        words = (r.text or "").lower().split()
        left |= {tuple(words[k : k + 50]) for k in range(len(words) - 49)}
    assert all(tuple(w.encode("latin-1").decode() for w in window) in left for window, ids in holders.items() if len(ids) > 1)


def test_passages_of_rows_without_ids(spark):
    """A row without an id is a document of its own and hides no passage."""
    rng = random.Random(1)
    words = sentence(rng, 100)[:-1]
    rows = [(7, "x " + words), (3, words + " y"), (None, "z " + words), (None, words + " w"), (None, words + " w")]
    for some in (rows[:3], rows[2:4], rows[3:], rows):
        got = chunks.repeated_passages(spark.createDataFrame(some, "doc_id long, text string")).collect()
        ids = [i for i, _ in some]
        if some == rows[3:]:  # equal rows without an id are one document
            assert not got
            continue
        first = min([i for i in ids if i is not None], default=None)
        assert len(got) == len(set(some)) and all(r.n_words == 100 and r.first_id == first for r in got)
        assert sum(r.kept for r in got) == 1 and (first is None or next(r for r in got if r.kept).doc_id == first)


def test_language(spark):
    rng = random.Random(8)
    words = {"en": ["the", "and", "with", "house"], "de": ["der", "und", "mit", "häuser"], "fr": ["les", "et", "avec", "maisön"]}
    rows = [(i, " ".join(rng.choice(words[x]) for _ in range(20)), x) for i, x in enumerate(["en", "de", "fr"] * 40)]
    rows += [(900, None, "en"), (901, "", None), (902, "12 !?", "de"), (903, "a", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(docs.where("doc_id % 5 <> 0"))
    got = {r.doc_id: (r.lang_pred, r.lang_score) for r in langid.predict(docs, model).collect()}
    assert all(got[i][0] == x for i, _, x in rows if i < 900) and all(0 <= s <= 1 for _, s in got.values())
    assert [got[i][0] for i in (900, 901, 902)] == ["und"] * 3 and got[903][0] in words
    none = langid.learn(docs.limit(0))
    assert {r.lang_pred for r in langid.predict(docs, none).collect()} == {"und"}


def test_nearest(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, 16))
    vectors = (centres[rng.integers(0, 12, 600)] + 0.3 * rng.standard_normal((600, 16))).astype(np.float32)
    vectors[100:140] = vectors[100]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(1000, None), (1001, [0.0] * 16), (1002, [None] * 16), (1003, [float("nan")] * 16), (1004, [1.0, 2.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in ann.nearest(table, table.where("vec_id % 20 = 0"), k=10).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    exact_scores = vectors.astype(np.float64) @ vectors.astype(np.float64).T
    hits = 0
    for q, found in got.items():
        scores = np.round(exact_scores[q], 9)
        best = [i for i in np.lexsort((np.arange(600), -scores)).tolist() if i != q][:10]
        hits += len({i for i, _ in found} & set(best))
        assert all(abs(s - exact_scores[q, i]) < 1e-9 for i, s in found) and found == sorted(found, key=lambda x: (-x[1], x[0]))
    assert set(got) == set(range(0, 600, 20)) and hits >= 0.9 * 10 * len(got)
    few = ann.nearest(table.where("vec_id < 3"), table.where("vec_id < 3"), k=10).collect()
    assert len(few) == 6
    assert ann.nearest(table.limit(0), table.limit(0)).count() == 0


def test_nearest_fills_all_ranks(spark):
    vectors = np.random.default_rng(5).standard_normal((1500, 12)).astype(np.float32)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    asking = table.where("vec_id % 10 = 0").unionByName(table.where("vec_id = 1").withColumn("vec_id", F.lit(9999).cast("long")))
    for rows, n in ((table, 20), (table.where("vec_id <= 30"), 20)):
        got = {}
        for r in ann.nearest(rows, asking).collect():
            got.setdefault(r.query_id, []).append(r.rank)
        assert len(got) == 151 and all(sorted(x) == list(range(1, n + 1)) for x in got.values())


def test_lm(docs):
    got = {r.doc_id: r for r in lm.score(docs, F.col("doc_id") % 7 != 2).collect()}
    tokens = {i: [*(t or "").encode().lower().split(), b"\n"] for i, t in corpus()}
    counts = Counter(w for i, ws in tokens.items() if i % 7 != 2 for w in ws)
    n, v = sum(counts.values()), len(counts)
    for i, ws in tokens.items():
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(ws), sum(counts[w] > 0 for w in ws), n)
        assert math.isclose(got[i].base_score, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
        assert math.isclose(got[i].bits_per_byte * (sum(len(w) + 1 for w in ws) - 1), -got[i].score / math.log10(2), rel_tol=1e-9)
    untrained = lm.score(docs.where("doc_id < 60"), F.lit(None).cast("boolean")).collect()
    assert all(r.base_score == 0 and r.n_known == 0 and abs(r.bits_per_byte - 8) < 0.1 for r in untrained)


def test_lm_counts_go_to_the_shuffle_as_tasks_made_them(docs):
    """Tasks have added up their windows: no second sum of the same rows before they are dealt."""
    plan = lm.tallied(docs.select(F.coalesce("text", F.lit("")).alias("text"), F.lit(True).alias("learn")))._jdf.queryExecution().executedPlan().toString()
    above = plan.split("MapInArrow")[0]
    assert "Aggregate" in above and "Aggregate" not in above[above.rindex("Exchange") :]


@pytest.mark.parametrize(("tally", "occurrences"), [(1 << 21, 1 << 30), (40, 1 << 30), (40, 300)])
def test_lm_tasks_pass_on_few_rows(spark, monkeypatch, tally, occurrences):
    """A key that a task holds is one row, whether it is learned from or not; common ones are held while rare ones go."""
    monkeypatch.setattr(lm, "TALLY", tally)
    monkeypatch.setattr(lm, "OCCURRENCES", occurrences, raising=False)
    monkeypatch.setattr(lm, "PIECE", 64)
    rng, made = random.Random(3), []
    texts = ["common words " * rng.randint(2, 5) + "".join(rng.choices("abcdefgh", k=9)) for _ in range(60)]
    batch = pa.RecordBatch.from_pydict({"text": texts, "learn": [i % 3 > 0 for i in range(60)]})

    class Docs:
        def mapInArrow(self, run, schema):
            made.extend(r for part in run(iter([batch])) for r in zip(*(c.to_pylist() for c in part.columns), strict=True))
            return spark.createDataFrame(made, schema)

    sums = {(r.a, r.b): (r.n, r.m) for r in lm.tallied(Docs()).collect()}
    windows, bounds, one, two, ranges = lm_windows(texts)
    want = {}
    for keys, others, edges in ((windows, np.zeros_like(windows), bounds), (one, two | np.uint64(1), ranges)):
        text = np.searchsorted(edges, np.arange(len(keys)), "right") - 1
        for *key, i in zip(keys.view(np.int64).tolist(), others.view(np.int64).tolist(), text.tolist(), strict=True):
            n, m = want.get(tuple(key), (0, 0))
            want[tuple(key)] = n + (i % 3 > 0), m + 1
    assert sums == {**want, (0, 2): (40, 60)}
    if tally > len(want):
        assert len(made) == len(sums)
    elif occurrences > 1000:
        assert max(Counter(r[:2] for r in made if want.get(r[:2], (0, 0))[1] > 100).values()) <= 2


def test_lm_is_the_same_however_rows_are_dealt(docs, monkeypatch):
    results = []
    for parts in (1, 5):
        rows = lm.score(docs.repartition(parts), F.col("doc_id") % 7 != 2).collect()
        results.append({r.doc_id: (r.score, round(r.base_score, 9)) for r in rows})
    monkeypatch.setattr(lm, "COMMON_WINDOWS", 5)  # nearly everything is joined
    monkeypatch.setattr(lm, "COMMON_WORDS", 2)
    rows = lm.score(docs, F.col("doc_id") % 7 != 2).collect()
    results.append({r.doc_id: (r.score, round(r.base_score, 9)) for r in rows})
    assert all(r == results[0] for r in results)


def test_lm_predicts_better_than_words_alone(spark, monkeypatch):
    monkeypatch.setattr(lm, "ROUNDS", 8)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    held = langid.held_out(F.col("doc_id"), 7, 2)
    found = lm.score(docs, ~held).where(held).agg(F.sum("score"), F.sum("base_score")).first()
    assert found[0] > found[1]


def lm_windows(texts):
    data = [t.encode() for t in texts]
    return lm.stream(np.frombuffer(b"".join(data), np.uint8), np.append(0, np.cumsum([len(d) for d in data])))


def test_lm_evidence_is_what_brute_counting_gives():
    rng = random.Random(12)
    windows, bounds, *_ = lm_windows([sentence(rng, 60) for _ in range(5)] + [""])
    assert bounds[-1] == len(windows) and (lm.byte_of(windows)[bounds[1:] - 1] == lm.END).all()
    keys, n = np.unique(windows, return_counts=True)
    states = np.zeros(lm.SLOTS, np.uint16)
    for at, ones in ((lm.slots(keys)[k, bit], lm.bits_of(keys)[bit]) for k in range(len(lm.SHORT)) for bit in range(8)):
        for place, one, count in zip(at.tolist(), ones.tolist(), n.tolist(), strict=True):
            zeros, others = states[place] >> 8, states[place] & 255
            states[place] = min(191, zeros + count * (1 - one)) << 8 | min(191, others + count * one)
    for left_out in (0, 1):
        inputs, _ = lm.evidence(keys, n, states, left_out)
        for i in range(0, len(keys), 7):
            text = int(keys[i]).to_bytes(8, "little")[: lm.CONTEXT + 1]
            for k, order in enumerate(lm.ORDERS):
                near = [(int(x).to_bytes(8, "little")[lm.CONTEXT], c) for x, c in zip(keys, n, strict=True) if int(x).to_bytes(8, "little")[lm.CONTEXT - order : lm.CONTEXT] == text[lm.CONTEXT - order : lm.CONTEXT]]
                for bit in range(8):
                    begun = [(b, c) for b, c in near if b >> (8 - bit) == text[-1] >> (8 - bit)]
                    same = sum(c for b, c in begun if (b >> (7 - bit)) == text[-1] >> (7 - bit)) - left_out
                    other = sum(c for _, c in begun) - left_out - same
                    if max(same, other) < 150:
                        want = math.log((same + 0.05) / (other + 0.05)) * (same + other) / (same + other + 0.2)
                        assert abs(inputs[k, bit, i] - want) < 1e-4 or order > 1 and k < len(lm.SHORT)  # hashed slots may be shared


def test_lm_trains_on_every_window(docs, spark):
    rows = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.lit(True).alias("learn"))
    windows = lm.tallied(rows).where("b = 0").cache()
    mixer = lm.trained(windows, spark.sparkContext.broadcast(np.zeros(lm.SLOTS, np.uint16)))
    count = sum(len(w) + 1 for _, t in corpus() for w in (t or "").encode().split()) + len(corpus())
    assert windows.agg(F.sum("n")).first()[0] == count and mixer.total.sum() == 8 * count


def test_lm_probabilities_sum_to_one():
    windows = (np.arange(256, dtype=np.uint64) << np.uint64(8 * lm.CONTEXT)) | np.uint64(0x6162)
    rng = np.random.default_rng(1)
    states = rng.integers(0, 65536, lm.SLOTS).astype(np.uint16)
    mixer = lm.Mixer(ones=rng.uniform(0, 5, 256 * lm.STEPS), total=np.full(256 * lm.STEPS, 9.0))
    bits = lm.bits_needed(windows, rng.integers(0, 4, 256), states, mixer) / 1e6
    assert math.isclose(float((2**-bits).sum()), 1, abs_tol=1e-4)


@pytest.mark.parametrize(
    "run",
    [
        lambda d: setjoin.near_components(d), lambda d: secrets.scan_secrets(d), lambda d: packing.pack(d, BYTE), lambda d: lm.score(d, F.lit(True)), lambda d: exact.exact_groups(d),
        lambda d: chunks.repeated_passages(d), lambda d: token_counts.count_tokens(d, BYTE), lambda d: sentencepieces.encode(d, PIECE),
    ],
)
def test_empty_tables(empty, run):
    assert run(empty).count() == 0
