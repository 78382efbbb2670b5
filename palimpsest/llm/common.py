"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators.cut import written as materialize

TOKEN = r"[A-Za-z0-9]+(?:'[A-Za-z]+)?"
TOKEN_RE = re.compile(TOKEN)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokens(text: str) -> list[str]:
    return TOKEN_RE.findall(text.lower()) if text.isascii() else [t.lower() for t in TOKEN_RE.findall(text)]


def spread(df: DataFrame, per_core: int = 2) -> DataFrame:
    """Enough partitions for a CPU-heavy kernel; input that is already split finely stays in place. For scans only: asking a plan with a shuffle for its partitions would run it."""
    want = df.sparkSession.sparkContext.defaultParallelism * per_core
    return df if df.rdd.getNumPartitions() * 2 >= want else df.repartition(want)


def present(c: str | Column = "text") -> Column:
    """Neither null nor empty: other rows are never cases."""
    col = F.col(c) if isinstance(c, str) else c
    return col.isNotNull() & (col != "")


def pairs_of_classes(members: DataFrame, pairs: DataFrame, ident: str, out: tuple[str, str], block: int = 2_000) -> DataFrame:
    """Expand pairs of classes (ca, cb; ca <> cb, each once) into pairs of member rows, smaller id first.

    members: (cls, ident). A class of more than `block` members is cut into blocks of about that size, and
    pairs are first expanded to pairs of blocks, so no key ever holds more than one block a side.
    """
    sizes = members.groupBy("cls").agg(F.ceil(F.count("*") / block).cast("int").alias("_n")).where("_n > 1")
    rows = members.join(sizes, "cls", "left").select("cls", F.col(ident).alias("_id"), F.pmod(F.xxhash64(ident), F.coalesce("_n", F.lit(1)).cast("bigint")).cast("int").alias("_b"))
    left = rows.select(F.col("cls").alias("ca"), F.col("_b").alias("ba"), F.col("_id").alias("ia"))
    right = rows.select(F.col("cls").alias("cb"), F.col("_b").alias("bb"), F.col("_id").alias("ib"))
    p = (pairs.select("ca", "cb")
         .join(sizes.select(F.col("cls").alias("ca"), F.col("_n").alias("na")), "ca", "left")
         .join(sizes.select(F.col("cls").alias("cb"), F.col("_n").alias("nb")), "cb", "left")
         .select("ca", "cb", F.explode(F.sequence(F.lit(0), F.coalesce("na", F.lit(1)) - 1)).alias("ba"), F.coalesce("nb", F.lit(1)).alias("nb"))
         .select("ca", "cb", "ba", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("bb")))
    return (p.join(left, ["ca", "ba"]).join(right, ["cb", "bb"])
            .select(F.least("ia", "ib").alias(out[0]), F.greatest("ia", "ib").alias(out[1])))


def pairs_within(members: DataFrame, ident: str, out: tuple[str, str], block: int = 2_000) -> DataFrame:
    """All pairs of members (cls, ident) inside one class, smaller id first, block against block."""
    sizes = members.groupBy("cls").agg(F.count("*").alias("_c")).where(F.col("_c") > 1).select("cls", F.ceil(F.col("_c") / block).cast("int").alias("_n"))
    rows = members.join(sizes, "cls").select("cls", F.col(ident).alias("_id"), "_n", F.pmod(F.xxhash64(ident), F.col("_n").cast("bigint")).cast("int").alias("_b"))
    # every row meets, on the left, the blocks at or after its own
    left = rows.select("cls", F.col("_id").alias("ia"), F.col("_b").alias("ba"), F.explode(F.sequence(F.col("_b"), F.col("_n") - 1)).alias("bb"))
    right = rows.select("cls", F.col("_id").alias("ib"), F.col("_b").alias("bb"))
    j = left.join(right, ["cls", "bb"]).where((F.col("ba") < F.col("bb")) | (F.col("ia") < F.col("ib")))
    return j.select(F.least("ia", "ib").alias(out[0]), F.greatest("ia", "ib").alias(out[1]))
