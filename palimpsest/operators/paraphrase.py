"""Lexical embeddings and their cosine, as sparse rows; and top-k over dense embeddings."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.config import EMBEDDING_DIM
from palimpsest.functions import native

WHITE = r"(?U)[\s\x1c-\x1f]+"


def lexical_embedding(docs: DataFrame, ident: str = "doc_id", text: str = "text", dim: int = EMBEDDING_DIM) -> DataFrame:
    """(doc_id, bucket, weight): white-space words hashed into `dim` buckets, 1 + ln(count), unit length. Texts without words have no rows.

    Words are counted before they are hashed, so a word is hashed once a document.
    """
    w = docs.select(F.col(ident).alias("doc_id"), F.explode(F.split(F.col(text), WHITE)).alias("word")).where("word <> ''")
    w = w.groupBy("doc_id", "word").agg(F.count("*").alias("n"))
    b = w.groupBy("doc_id", (native.fnv1a32("word") % dim).cast("int").alias("bucket")).agg((1 + F.log(F.sum("n").cast("double"))).alias("v"))
    norm = b.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    return b.join(norm, "doc_id").select("doc_id", "bucket", (F.col("v") / F.col("norm")).alias("weight"))


def sparse_cosine(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a_id, b_id, cosine) of all pairs of two embedded tables that share a bucket; b is a stated query set."""
    x = a.select(F.col("doc_id").alias("a_id"), "bucket", F.col("weight").alias("wa"))
    y = b.select(F.col("doc_id").alias("b_id"), "bucket", F.col("weight").alias("wb"))
    return x.join(y, "bucket").where(F.col("a_id") != F.col("b_id")).groupBy("a_id", "b_id").agg(F.sum(F.col("wa") * F.col("wb")).alias("cosine"))


def dense(emb: DataFrame, ident: str, vector: str, dim: int = EMBEDDING_DIM) -> DataFrame:
    """(doc_id, vec) of sparse rows (doc_id, bucket, weight)."""
    m = emb.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "weight"))).alias("m"))
    return m.select(F.col("doc_id").alias(ident), F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias(vector))


class Embedder(Protocol):
    """What a worker makes once and uses for all its texts."""

    def embed(self, texts: list[str]) -> np.ndarray:
        """One row a text; rows need not have unit length."""


def embedded(docs: DataFrame, embedder: Callable[[], Embedder] | None = None, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(ident, vec) of every text that is neither null nor empty, of unit length; the lexical embedding if no embedder is given."""
    d = docs.where(F.col(text).isNotNull() & (F.col(text) != "")).select(F.col(ident).alias("_id"), F.col(text).alias("_t"))
    kind = docs.schema[ident].dataType.simpleString()
    if embedder is None:
        return dense(lexical_embedding(d, "_id", "_t"), ident, "vec")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for b in batches:
            model = model or embedder()
            v = np.asarray(model.embed(b["_t"].tolist()), float)
            yield pd.DataFrame({ident: b["_id"], "vec": list(v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12))})

    return d.mapInPandas(run, f"{ident} {kind}, vec array<double>")


QUERY_BYTES = 64_000_000


def nearest(queries: DataFrame, base: DataFrame, k: int = 10, embedder: Callable[[], Embedder] | None = None, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(ident, src_id, score, rank): for each text of queries the k nearest of base by cosine, smaller id first on ties."""
    q, b = embedded(queries, embedder, ident, text), embedded(base, embedder, ident, text)
    return best_rows(q.select(F.col(ident).alias("q_id"), F.col("vec").alias("q")), b.select(F.col(ident).alias("src_id"), "vec"), k, "src_id", "vec").withColumnRenamed("q_id", ident)


def best_rows(queries: DataFrame, base: DataFrame, k: int, ident: str, vector: str) -> DataFrame:
    """(q_id, ident, score, rank): the k rows of base with the largest product with each query, a stated set of unit vectors.

    Queries go to the workers in blocks of at most QUERY_BYTES, so base is read once a block and never copied; a batch of base is
    one matrix product, and only its k best a query leave the worker.
    """
    spark = queries.sparkSession
    kind = {c: d.schema[c].dataType.simpleString() for d, c in ((queries, "q_id"), (base, ident))}
    width = queries.select(F.max(F.size("q")).alias("w"), F.count("*").alias("n")).first()
    blocks = max(1, -(-(width["n"] or 0) * (width["w"] or 1) * 8 // QUERY_BYTES))
    parts = []
    for i in range(blocks):
        held = spark.sparkContext.broadcast(_matrix(queries.where(F.pmod(F.xxhash64("q_id"), F.lit(blocks)) == i).toPandas()))

        def run(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            ids, m = held.value
            for b in batches:
                if not len(b) or not len(ids):
                    continue
                own = b[ident].to_numpy()
                score = np.round(np.array(b[vector].tolist(), float) @ m.T, 6)
                for j, q in enumerate(ids):
                    s = np.where(own == q, -np.inf, score[:, j])
                    o = np.lexsort((own, -s))[:k]
                    o = o[s[o] > -np.inf]
                    yield pd.DataFrame({"q_id": q, ident: own[o], "score": s[o]})

        parts.append(base.select(ident, vector).mapInPandas(run, f"q_id {kind['q_id']}, {ident} {kind[ident]}, score double"))
    c = parts[0]
    for p in parts[1:]:
        c = c.unionByName(p)
    w = Window.partitionBy("q_id").orderBy(F.col("score").desc(), ident)
    return c.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _matrix(q: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return q["q_id"].to_numpy(), np.array(q["q"].tolist(), float) if len(q) else np.empty((0, 0))


def top_k(queries: DataFrame, base: DataFrame, score: Column, k: int, ident: str) -> DataFrame:
    """The k best rows of base for each query, smaller id first on ties. queries is a stated set, met in blocks with all rows of base."""
    from math import ceil

    blocks = max(1, ceil(queries.sparkSession.sparkContext.defaultParallelism / 2))
    q = queries.withColumn("_b", F.pmod(F.xxhash64("q_id"), F.lit(blocks)))
    b = base.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))))
    j = q.join(b, "_b").where(F.col("q_id") != F.col(ident)).select("q_id", ident, score.alias("score"))
    w = Window.partitionBy("q_id").orderBy(F.col("score").desc(), ident)
    return j.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
