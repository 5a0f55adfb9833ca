"""A training corpus from `documents`: language, exact copies, near copies, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the last return the columns
of `documents`, whatever other columns it has and whatever they are called. Stages are written as Parquet in the shared
folder and read again. Null and empty texts have no letters and go in the first stage; an empty table stays empty. Rows
without an id pass the second and third stage, which choose by id. Rows that repeat an id and its text become one row in
the second stage; rows of one id with other texts stay or go as their texts do there, and together in the third.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import exact, langid, packing, secrets, setjoin
from tidelog.llm.queries import vocabulary
from tidelog.tables import written

#: Share of the usual (median) score of a language's labelled documents under which a document is of no known language.
LEAST_SHARE = 1 / 3


def free(docs: DataFrame, *names: str) -> list[str]:
    """Names of new columns that no column of `docs` has."""
    out = []
    for name in names:
        while name in docs.columns or name in out:
            name += "_"
        out.append(name)
    return out


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without letters, and those of no language that the corpus has, go; the filters are learned from `lang`.

    A text is of its best language if it reaches LEAST_SHARE of the median score of the labelled documents of that language.
    """
    lang, score, usual = free(docs, "pred_lang", "pred_score", "usual_score")
    found = written(langid.predict(docs, langid.learn(docs), out_cols=(lang, score)))
    labelled = found.where(F.col("lang").isNotNull() & (F.col("lang").cast("string") == F.col(lang)))
    gates = labelled.groupBy(lang).agg(F.percentile_approx(score, 0.5, 10_000).alias(usual))  # a row a language
    # a row a language, as many as the model holds: texts stay where they are
    return found.join(F.broadcast(gates), lang, "left").where((F.col(lang) != "und") & (F.col(score) >= F.coalesce(F.col(usual), F.lit(0.0)) * LEAST_SHARE)).select(*[F.col(f"`{c}`") for c in docs.columns])


def chosen(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of `docs` whose id is in `ids`, and rows without an id."""
    return docs.where("doc_id is not null").join(ids, "doc_id", "left_semi").unionByName(docs.where("doc_id is null"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document of smallest id stays, of rows that repeat it one. Rows without an id stay."""
    (sha,) = free(docs, "text_sha256")
    groups = written(exact.exact_groups(docs.where("doc_id is not null").select("doc_id", "text")).where("kept").select("doc_id", F.col("text_sha256").alias(sha)))
    if groups.groupBy("doc_id").count().where("count > 1").isEmpty():
        return chosen(docs, groups.select("doc_id"))
    hashed = docs.withColumn(sha, F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    one = hashed.where("doc_id is not null").join(groups.distinct(), ["doc_id", sha], "left_semi").dropDuplicates(["doc_id", sha]).drop(sha)
    return one.select(*docs.columns).unionByName(docs.where("doc_id is null"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are linked by five-word shingles, Jaccard 0.8 or more, the one of smallest id stays."""
    found = setjoin.near_components(docs.where("doc_id is not null"), size=5, num=80, den=100)
    return chosen(docs, found.where("component_id = doc_id").select("doc_id"))


def secret_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts and `n_chars` follows, where there is such a column; documents stay."""
    (spans,) = free(docs, "found_secrets")
    found = secrets.scan_secrets(docs, out_col=spans)
    found = found.withColumn("text", secrets.redacted(F.col("text"), F.col(f"`{spans}`")))
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return found.select(*[F.col(f"`{c}`") for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token windows of 1,024: pieces with their ids."""
    return packing.pack(docs, vocabulary("byte"), with_ids=True)


STAGES = [("language_id", language), ("exact_dedup", exact_copies), ("ngram_jaccard", near_copies), ("secret_scans", secret_spans), ("packing", packed)]

#: SQL can't express the n-gram filters of the first stage, nor tokens; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
