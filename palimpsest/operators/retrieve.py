"""Candidate retrieval: shared fingerprints, LSH, their union ranked, seeds for the alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.config import FingerprintConfig
from palimpsest.functions import native
from palimpsest.config import PRIME
from palimpsest.operators.corpus import counted, lsh, postings


def shared_counts(subs: DataFrame, docs: DataFrame, inverted: DataFrame | None = None) -> DataFrame:
    """(sub_id, src_id, shared): posting rows of the source for each distinct value of the submission.

    Postings are counted by (value, source) before the join, so a boilerplate value costs one row a
    document, not one a position. inverted(value, doc_id, n): these counts as an index stores them.
    """
    q = postings(subs).select(F.col("doc_id").alias("sub_id"), "value").distinct()
    p = (counted(docs) if inverted is None else inverted).withColumnRenamed("doc_id", "src_id")
    return q.join(p, "value").where(F.col("sub_id") != F.col("src_id")).groupBy("sub_id", "src_id").agg(F.sum("n").alias("shared"))


def lsh_pairs(subs: DataFrame, docs: DataFrame, cfg: FingerprintConfig, empty: bool = True) -> DataFrame:
    """(sub_id, src_id), distinct: pairs that agree in a band. Documents of one signature are joined as one class and expanded at the end.

    All documents without fingerprints have one signature and meet, though they can never match; empty=False leaves them out.
    """
    if not empty:
        subs, docs = (d.where(F.get("sig", F.lit(0)) != PRIME) for d in (subs, docs))

    def classes(d: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        m = d.select(F.col("doc_id").alias(name), "sig", F.xxhash64("sig").alias("_k"))
        return m.select(name, "_k").distinct(), m.groupBy("_k").agg(F.first("sig").alias("sig")).select(F.col("_k").alias("doc_id"), "sig")

    ms, cs = classes(subs, "sub_id")
    md, cd = classes(docs, "src_id")
    a = lsh(cs, cfg).select(F.col("doc_id").alias("ka"), "band", F.xxhash64("key").alias("key"))
    b = lsh(cd, cfg).select(F.col("doc_id").alias("kb"), "band", F.xxhash64("key").alias("key"))
    k = a.join(b, ["band", "key"]).select("ka", "kb").distinct()
    return k.join(ms.withColumnRenamed("_k", "ka"), "ka").join(md.withColumnRenamed("_k", "kb"), "kb").where(F.col("sub_id") != F.col("src_id")).select("sub_id", "src_id")


def candidates(subs: DataFrame, docs: DataFrame, cfg: FingerprintConfig, exclude: DataFrame | None = None, min_shared: int | None = None, inverted: DataFrame | None = None, empty: bool = True) -> DataFrame:
    """(sub_id, src_id, est_jaccard, shared, via, rank): LSH or at least min_shared fingerprints; the best `limit` a submission.

    Ranked by shared count, then estimated Jaccard, then source id, so the cut is the same in every run.
    exclude(doc_id): sources that are no candidates of any submission; min_shared: other than the configured one, for this call.
    """
    least = cfg.min_shared if min_shared is None else min_shared
    if exclude is not None:
        gone = exclude.select("doc_id").distinct()
        docs = docs.join(gone, "doc_id", "left_anti")
        inverted = None if inverted is None else inverted.join(gone, "doc_id", "left_anti")
    s = shared_counts(subs, docs, inverted)
    hits = lsh_pairs(subs, docs, cfg, empty).withColumn("lsh", F.lit(True))
    c = hits.join(s, ["sub_id", "src_id"], "full_outer").select("sub_id", "src_id", F.coalesce("lsh", F.lit(False)).alias("lsh"), F.coalesce("shared", F.lit(0)).alias("shared"))
    c = c.withColumn("post", F.col("shared") >= least).where("lsh or post")
    sa = subs.groupBy(F.col("doc_id").alias("sub_id")).agg(F.first("sig").alias("_a"))
    sb = docs.groupBy(F.col("doc_id").alias("src_id")).agg(F.first("sig").alias("_b"))
    c = c.join(sa, "sub_id").join(sb, "src_id").select(
        "sub_id", "src_id", native.estimate_jaccard("_a", "_b").alias("est_jaccard"), "shared",
        F.when(F.col("lsh") & F.col("post"), "both").when(F.col("lsh"), "lsh").otherwise("postings").alias("via"))
    w = Window.partitionBy("sub_id").orderBy(F.col("shared").desc(), F.col("est_jaccard").desc(), "src_id")
    return c.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= cfg.limit)


def seeds(subs: DataFrame, docs: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(sub_id, src_id, q, s): equal fingerprints by position; of the given pairs only, if there are any given."""
    q = postings(subs).select(F.col("doc_id").alias("sub_id"), F.col("pos").alias("q"), "value")
    p = postings(docs).select(F.col("doc_id").alias("src_id"), F.col("pos").alias("s"), "value")
    if pairs is None:
        return q.join(p, "value").where(F.col("sub_id") != F.col("src_id")).select("sub_id", "src_id", "q", "s")
    # the pairs pick the submission's values first, so a frequent value meets only sources that were chosen
    return q.join(pairs.select("sub_id", "src_id"), "sub_id").join(p, ["src_id", "value"]).select("sub_id", "src_id", "q", "s")


def exact_runs(seed_rows: DataFrame, k: int) -> DataFrame:
    """(sub_id, src_id, q0, q1, s0, s1, seeds): runs of seeds on one diagonal whose shingles touch or overlap; token positions inclusive."""
    d = seed_rows.select("sub_id", "src_id", "q", "s", (F.col("q") - F.col("s")).alias("diag")).distinct()
    w = Window.partitionBy("sub_id", "src_id", "diag").orderBy("q")
    g = d.withColumn("new", F.when(F.col("q") - F.lag("q").over(w) <= k, 0).otherwise(1)).withColumn("run", F.sum("new").over(w))
    return g.groupBy("sub_id", "src_id", "diag", "run").agg(
        F.min("q").alias("q0"), (F.max("q") + k - 1).alias("q1"), F.min("s").alias("s0"), (F.max("s") + k - 1).alias("s1"), F.count("*").alias("seeds")).drop("diag", "run")
