"""The registered queries of the operators: each applies one to its whole table, as its contract asks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import ann, chunks, exact, langid, lm, packing, phrases, secrets, sentencepieces, setjoin, token_counts, topk, whiten
from tidelog.llm.oracle import ORACLE_SQL  # noqa: F401

#: Vocabulary files; set before calling the queries to use others.
VOCABULARIES = {"byte": "byte_bpe_50k.json", "piece": "piece_bpe_32k.model"}


def vocabulary(kind: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARIES[kind])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.near_components(table(spark, sf_dir, "documents"), size=4, num=85, den=100)


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("secrets", lambda s: s["rank"] < len(secrets.PATTERNS))
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind, *_ in secrets.PATTERNS],
        F.sha2(secrets.joined_spans(base), 256).alias("base_sha256"),
        secrets.joined_spans(F.col("secrets")).alias("spans"),
    )


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = langid.held_out(F.col("doc_id"), 5, 0)
    model = langid.learn(docs.where(~held))
    return langid.predict(docs.select("doc_id", held.alias("held_out"), "text"), model, out_cols=("lang_pred", "score")).drop("text")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = langid.held_out(F.col("doc_id"), 7, 2)
    return lm.score(table(spark, sf_dir, "documents"), ~held).withColumn("held_out", held)


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 20 = 0"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents"), keep="max", normalise=exact.ascii_lower)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.repeated_passages(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary("byte"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 1024)


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.encode(table(spark, sf_dir, "documents"), vocabulary("piece"), dropout=0.1, seed=17, with_ids=False)


def op11_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.exact_top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5, scale=256).drop("query_copy")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whiten.whitened(table(spark, sf_dir, "embeddings"), components=4, scale=256)
    return found.withColumn("deviation", F.expr("try_cast(deviation as long)"))


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard, op2_secret_scans, op3_language_id, op4_packing, op5_lm_scoring, op6_nearest_neighbours, op7_exact_dedup, op8_substring_dedup, op9_token_counts, op10_sentencepiece, op11_exact_top_k, op12_phrases, op13_whitening)}
