"""Exact top-k, phrase mining and whitening against brute force, and their awkward inputs."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.llm import phrases, queries, topk, whiten


def floored(v):
    return tuple(math.floor(256 * float(x)) for x in v)


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


# ---- top-k


def vectors_with_ties():
    rng = random.Random(3)
    hot = [0.5, -0.25, 0.125, 0.75]
    rows = [(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(120)]
    rows += [(i, list(hot)) for i in range(120, 200)]  # a third of all rows is one vector
    rows += [(200, None), (250, [math.nan, 0.0, 0.0, 0.0]), (300, [None, 1.0, 1.0, 1.0]), (350, [math.inf] * 4), (400, []), (450, [1.0, 2.0]), (451, [0.5, 0.25]), (None, list(hot)), (130, list(hot)), (0, [0.1, 0.2, 0.3, 0.4])]
    rng.shuffle(rows)
    return rows


def brute_top(rows, k, every):
    good = [(i, floored(v)) for i, v in rows if usable(v)]
    out = []
    asked = sorted({(i, x) for i, x in good if i is not None and i % every == 0})
    for i in sorted({i for i, _ in asked}):
        for copy, (_, q) in enumerate([a for a in asked if a[0] == i], 1):
            found = [(-sum(a * b for a, b in zip(q, x, strict=True)), j is None, j or 0) for j, x in good if j != i and len(x) == len(q)]
            out += [(i, copy, rank, None if none else j, -s) for rank, (s, none, j) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize(("block", "buckets"), [(4096, 512), (3, 4)])
def test_top_k(spark, monkeypatch, block, buckets):
    """One block and one or two rounds; many blocks and many rounds."""
    monkeypatch.setattr(topk, "BLOCK_QUERIES", block)
    monkeypatch.setattr(topk, "BUCKETS", buckets)
    rows = vectors_with_ties()
    every = 50 if block == 3 else 10
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, id int, x string").repartition(3)
    got = topk.exact_top_k(df, df.where(f"vec_id % {every} = 0"), k=5)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_top(rows, 5, every)


def test_top_k_of_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.0]), (50, [5.0, 6.0])], "vec_id long, embedding array<float>")
    got = topk.exact_top_k(df, df.where("vec_id % 50 = 0"))
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got.collect()) == [(0, 1, 50), (0, 2, 1), (50, 1, 1), (50, 2, 0)]
    assert topk.exact_top_k(df.limit(0), df.limit(0)).count() == 0
    assert topk.exact_top_k(df, df.where("vec_id = 7")).count() == 0


def test_products_are_exact():
    rng = np.random.default_rng(1)
    for top in (1 << 10, 1 << 27, 1 << 29):
        q, x = rng.integers(-top, top, (3, 5)), rng.integers(-top, top, (4, 5))
        want = [[sum(int(a) * int(b) for a, b in zip(u, v, strict=True)) for v in x] for u in q]
        assert topk.products(q, x).tolist() == want
    with pytest.raises(OverflowError):
        topk.products(np.array([[1 << 40]]), np.array([[1 << 40]]))


# ---- phrases


def brute_phrases(rows, least, most, top):
    total, counts = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = [x for x in re.split("[ \t]+", piece) if x]
            total[lang] += len(w)
            for n in range(1, most + 1):
                for k in range(len(w) - n + 1):
                    counts[lang, tuple(w[k : k + n])] += 1
    out = []
    for lang in total:
        found, own = [], {p: c for (x, p), c in counts.items() if x == lang and c >= least}
        for p, a in own.items():
            inside = [q for q in own if len(q) > len(p) and any(q[k : k + len(p)] == p for k in range(len(q) - len(p) + 1))]
            if len(p) < 2 or any(100 * own[q] >= 100 * a for q in inside):
                continue
            score, _, l, r = min((1000 * a * total[lang] // (counts[lang, p[:k]] * counts[lang, p[k:]]), k, counts[lang, p[:k]], counts[lang, p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, rank, p.decode(), -a, l, r, total[lang], -s) for rank, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def phrase_rows():
    rng = random.Random(8)
    vocabulary = ["the", "of", "new", "york", "city", "Über", "straße", "日本", "a\x01b", "x\x1f", "don't", "(yes)", "%"]
    rows = []
    for n in range(120):
        words = rng.choices(vocabulary, [8, 6, 4, 4, 3, 2, 2, 2, 1, 1, 1, 1, 1], k=rng.randint(0, 40))
        if n % 3 == 0:
            words[len(words) // 2 : len(words) // 2] = ["New", "YORK", "city", "hall"]
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ", ", ". ", "\n", "\x0b", "; ", "?!"]) for w in words)
        rows.append((rng.choice(["en", "de", None, "und"]), text))
    rows += [("en", "aa aa aa aa aa aa aa"), ("en", None), (None, None), ("fr", ""), ("de", " \t\n.,"), ("en", "word " * 3000)]
    return rows


@pytest.mark.parametrize(("least", "top", "parts"), [(3, 2000, 4), (6, 7, 1), (2, 40, 9)])
def test_phrases(spark, monkeypatch, least, top, parts):
    rows = phrase_rows()
    if least == 2:  # a text at a time, so that counts meet in the shuffle; ranges of a few rows, so that most phrases lie apart from their beginnings
        monkeypatch.setattr(phrases, "BUFFER_BYTES", 1)
    df = spark.createDataFrame([(lang, text, i, "w") for i, (lang, text) in enumerate(rows)], "lang string, text string, n long, word string").repartition(3)
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = phrases.collocations(df, least=least, top=top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
    assert sorted(tuple(r) for r in got) == brute_phrases(rows, least, 5, top)


def test_phrases_survive_shared_keys(spark, monkeypatch):
    """Two words with one key are noticed, and all is counted with other keys; rows of one hash are told apart by their columns."""
    plain, rows = phrases.span_hashes, phrase_rows()[:40]
    monkeypatch.setattr(phrases, "unique_hashes", lambda h, f=phrases.unique_hashes: f(h & np.uint64(7)))
    df = spark.createDataFrame(rows, "lang string, text string").coalesce(1)
    assert sorted(tuple(r) for r in phrases.collocations(df, least=3).collect()) == brute_phrases(rows, 3, 5, 2000)
    monkeypatch.setattr(phrases, "span_hashes", lambda d, s, e, seed=0: plain(d, s, e, seed) if seed else np.zeros(len(s), np.uint64))
    assert sorted(tuple(r) for r in phrases.collocations(df, least=3).collect()) == brute_phrases(rows, 3, 5, 2000)


def test_chance_phrases_are_not_passed_on(spark, monkeypatch):
    """Where all pairs are frequent and hardly any three words are, tasks pass on few phrases of three words."""
    rng = random.Random(3)
    rows = [("en", " ".join([*rng.choices("abcdefghijklmnopqrst", k=300), "x", "y", "z", "w"])) for _ in range(60)]
    df, made = spark.createDataFrame(rows, "lang string, text string").repartition(3), []
    plain = type(df).mapInArrow

    def noted(self, run, schema, *more):
        out = plain(self, run, schema, *more)
        if schema == "lang string, k0 long, k1 long, k2 long, n long":
            made.append(out)
        return out

    monkeypatch.setattr(type(df), "mapInArrow", noted)
    got = phrases.collocations(df, least=25).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    assert sorted(tuple(r) for r in got) == brute_phrases(rows, 25, 5, 2000)
    assert len(made) == 1 and 0 < made[0].count() < 100


def test_words_of_one_key_in_one_task(spark, monkeypatch):
    """Words are added up within a task, in parts and whole; two of one key are both passed on."""
    rows = phrase_rows()
    df = spark.createDataFrame(rows, "lang string, text string").select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").where("text is not null").coalesce(1)
    counts = Counter((lang or "und", w) for lang, text in rows for w in re.findall("[^ \t.,;:!?\n-\r]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")))
    for limit in (1 << 18, 3):
        monkeypatch.setattr(phrases, "BUFFER_ROWS", 7)
        monkeypatch.setattr(phrases, "LOOSE_WORDS", limit)
        monkeypatch.setattr(phrases, "TASK_WORDS", limit)
        found = phrases.counted_words(df, 0).collect()
        assert {(r.lang, r.word): r.n for r in found} == counts and all(r.word == r.other for r in found)
    monkeypatch.setattr(phrases, "word_keys", lambda *a, f=phrases.word_keys: (np.zeros_like(f(*a)[0]), *f(*a)[1:]))
    assert any(r.word != r.other for r in phrases.counted_words(df, 0).collect())


def test_phrases_of_nothing(spark):
    df = spark.createDataFrame([], "lang string, text string")
    assert phrases.collocations(df).count() == 0
    assert phrases.collocations(spark.createDataFrame([(None, None), ("en", "")], df.schema)).count() == 0
    assert phrases.collocations(spark.createDataFrame([("en", "a b c")], df.schema)).count() == 0


def test_exact_scores(spark):
    """Products beyond 64 bits, scores rounded down, the smaller k of equal cuts."""
    row = (["x", "y", "z"], 10**12 + 7, 10**14 + 1, [10**13 + 3, 10**12 + 9], [10**12 + 8, 10**13 + 5])
    df = spark.createDataFrame([row], "words array<string>, a long, n long, left_parts array<long>, right_parts array<long>")
    got = df.select(phrases.lowest_cut(5).alias("c")).first().c
    cuts = [(1000 * row[1] * row[2] // (x * y), k, x, y) for k, x, y in ((1, row[3][0], row[4][1]), (2, row[3][1], row[4][0]))]
    assert tuple(got) == min(cuts)


# ---- whitening


def brute_white(rows, components):
    good = [(i, floored(v)) for i, v in rows if usable(v)]
    fit = np.array(sorted({x for _, x in good}), dtype=object)
    n, s = len(fit), fit.sum(axis=0)
    y = fit * n - s
    cov = (y.T @ y).astype(float) / n**3
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values)[:components]
    out = {}
    for i, x in good:
        centred = np.array([float(a) for a in x]) - (s / n).astype(float)
        out.setdefault(i, []).append((sum(int(n * a - b) ** 2 for a, b in zip(x, s, strict=True)), centred @ vectors[:, order] / np.sqrt(values[order])))
    return n, values[order] / np.trace(cov), out


@pytest.mark.parametrize("spread", [1.0, 3e9])
def test_whitening(spark, spread):
    """Small numbers, and such as need more than 64 bits on the way."""
    rng = np.random.default_rng(2)
    data = (rng.standard_normal((150, 6)) @ rng.standard_normal((6, 6)) * spread + 7 * spread).tolist()
    rows = [(i, v) for i, v in enumerate(data)] + [(200 + i, data[3]) for i in range(80)] + [(300, None), (301, [None] * 6), (302, [math.nan] * 6), (303, [math.inf] * 6), (5, data[5])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, component int").repartition(4)
    got = whiten.whitened(df).collect()
    n, share, want = brute_white(rows, 4)
    assert len(got) == 4 * sum(len(x) for x in want.values()) and {r.n for r in got} == {n}
    sign = {}
    for r in got:
        deviation, white = want[r.vec_id][0]
        assert int(r.deviation) == deviation and abs(r.explained / share[r.component - 1] - 1) < 1e-9
        sign.setdefault(r.component, 1 if r.whitened * white[r.component - 1] > 0 else -1)
        assert abs(r.whitened * sign[r.component] - white[r.component - 1]) < 1e-6
    assert {r.identity_error for r in got} and max(r.identity_error for r in got) < 1e-9
    fit = {floored(v): [r.whitened for r in got if r.vec_id == i and r.component == 1][0] for i, v in rows if usable(v)}
    assert abs(np.var(list(fit.values())) - 1) < 1e-9


def test_whitening_of_few_rows(spark):
    kind = "vec_id long, embedding array<float>"
    assert whiten.whitened(spark.createDataFrame([], kind)).count() == 0
    one = whiten.whitened(spark.createDataFrame([(1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, [0.5])], kind)).collect()
    assert sorted((r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one)[:4] == [(i, c, 1, 0, None, None, None) for i in (1, 2) for c in (1, 2)]
    assert [(r.deviation, r.whitened) for r in one if r.vec_id == 3] == [(None, None)] * 2
    line = whiten.whitened(spark.createDataFrame([(i, [i / 4, i / 2, 1.0]) for i in range(5)], kind)).collect()  # one dimension only
    assert {r.component for r in line} == {1, 2, 3} and all((r.whitened is None) == (r.component > 1) for r in line) and all(r.identity_error < 1e-12 for r in line)


# ---- the registered queries


def test_queries(spark, tmp_path):
    rng = np.random.default_rng(4)
    vectors = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((160, 8)).astype(np.float32))] + [(400, None)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    texts = [("en", "alpha beta gamma, delta epsilon " * 60), ("en", "alpha beta. gamma " * 50), (None, "one two " * 99)]
    spark.createDataFrame(texts, "lang string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op11_exact_top_k(spark, str(tmp_path))
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(((q, r, v, s) for q, _, r, v, s in brute_top(vectors, 5, 50)), key=str)
    assert sorted(tuple(r) for r in queries.op12_phrases(spark, str(tmp_path)).collect()) == brute_phrases(texts, 100, 5, 2000)
    white = queries.op13_whitening(spark, str(tmp_path))
    assert dict(white.dtypes)["deviation"] == "bigint" and white.count() == 640
    assert white.where(F.col("identity_error") > 1e-4).count() == 0
