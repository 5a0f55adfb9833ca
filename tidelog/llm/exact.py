"""Exact duplicates: group by a 128-bit content hash, keep one stable id, compare bytes inside the groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.operators.assign import small
from tidelog.tables import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of a group that one compare task takes beside its copy of the kept text.
ROWS_PER_SALT = 512


def ascii_lower(text: Column) -> Column:
    """A-Z to lower case and nothing else; texts of ASCII only take the fast path."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def content_hash(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", normalise=None, hashed=content_hash) -> DataFrame:
    """One row per document: id_col, keep_id, group_size, kept, text_sha256.

    Texts are equal when their normalised bytes are (`normalise`: Column to Column; None leaves them). `keep` is "min"
    or "max": which id of equal texts stays. Null texts count as empty. Rows that repeat an id and its text get equal
    rows, counted each; rows of one id with other texts are documents of their own. A missing id is less than any other.

    Hash counts are combined before they are shuffled. Only members of groups travel with their texts, dealt in salted
    parts beside a copy of the kept text each, so no group lies in one task. The list of members goes to the texts if it is
    short (counted up to a bound), else texts are dealt out to it. Members whose bytes differ from the kept
    text (a collision of `hashed`) are grouped by their whole texts instead. Rows are told apart by id and SHA-256.
    """
    if keep not in ("min", "max"):
        raise ValueError(f"keep is min or max, not {keep!r}")
    pick = F.min if keep == "min" else F.max
    norm = F.coalesce(F.col(text_col), F.lit(""))
    norm = normalise(norm) if normalise else norm
    sha = F.sha2(F.col("norm").cast("binary"), 256)
    texts = docs.select(F.col(id_col).alias("id"), norm.alias("norm")).withColumn("sha", sha)
    marks = written(texts.select("id", "sha", hashed(F.col("norm")).alias("h")))
    groups = written(marks.groupBy("h").agg(pick(F.struct("id", "sha")).alias("keep"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    once = marks.groupBy("id", "sha", "h").agg(F.count(F.lit(1)).alias("rows"))
    members = written(once.join(groups, "h").select("id", "sha", "rows", "keep", "n", F.expr(f"int(pmod(xxhash64(id, sha), n div {ROWS_PER_SALT} + 1))").alias("salt")))
    if marks.groupBy("id").count().where("count > 1 or id is null").isEmpty():  # then an id says which row it is, and texts needn't be hashed again
        carried = texts.drop("sha").join(small(members), "id")
    else:
        carried = matched(texts, members).dropDuplicates(["id", "sha"]) if repeats(members) else matched(texts, members)
    heads = carried.where(F.col("id").eqNullSafe(F.col("keep.id")) & (F.col("sha") == F.col("keep.sha"))).select(
        F.col("keep"), F.explode(F.sequence(F.lit(0), F.expr(f"int(n div {ROWS_PER_SALT})"))).alias("salt"), F.col("norm").alias("head")
    )
    compared = written(
        carried.join(heads, ["keep", "salt"]).select(
            "id", "sha", "rows", "keep", (F.col("norm") == F.col("head")).alias("same"), F.when(F.col("norm") != F.col("head"), F.col("norm")).alias("norm")
        )
    )
    apart = compared.where("not same")
    by_text = apart.groupBy("norm").agg(pick("id").alias("keep_id"), F.sum("rows").alias("group_size"))
    rest = apart.select("id", "sha", "norm").join(by_text, "norm").select("id", "sha", "keep_id", "group_size")
    same = compared.where("same")
    sizes = written(same.groupBy("keep").agg(F.sum("rows").alias("group_size")))
    classes = same.select("id", "sha", "keep").join(sizes, "keep").select("id", "sha", F.col("keep.id").alias("keep_id"), "group_size").unionByName(rest)
    classes = classes.select(F.col("id").alias("of_id"), F.col("sha").alias("of_sha"), "keep_id", "group_size")
    found = marks.select("id", "sha").join(classes, F.col("id").eqNullSafe(F.col("of_id")) & (F.col("sha") == F.col("of_sha")), "left")
    keep_id = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return found.select(
        F.col("id").alias(id_col), keep_id.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), keep_id.eqNullSafe(F.col("id")).alias("kept"), F.col("sha").alias("text_sha256")
    )


def matched(texts: DataFrame, members: DataFrame) -> DataFrame:
    """Texts (id, sha, norm) of the members, with their columns."""
    of = members.withColumnsRenamed({"id": "of_id", "sha": "of_sha"})
    return texts.join(small(of), F.col("id").eqNullSafe(F.col("of_id")) & (F.col("sha") == F.col("of_sha"))).drop("of_id", "of_sha")


def repeats(members: DataFrame) -> bool:
    return not members.where("rows > 1").isEmpty()
