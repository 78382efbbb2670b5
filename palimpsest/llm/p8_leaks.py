"""Problem 8: passages of evaluation items inside a corpus.

Both sides are brought to the canonical form of problem 1, lower-cased and cut into words
([a-z0-9]+). Winnowing keeps, of every WINDOW consecutive hashes of GRAM words, the smallest
(rightmost on ties); GRAM + WINDOW - 1 = MIN_WORDS, so any shared stretch of MIN_WORDS words has a
fingerprint in common. Fingerprints are joined and every (document, item) that meets is extended
exactly: it counts if MIN_WORDS consecutive words of the item stand in the document, or all words
of a shorter item. Winnowing gives no guarantee below MIN_WORDS; for items that short a document
also yields the hash of each run that is as long as one of them.

Null or empty texts, on either side, leak nothing. Repeated items and documents are all reported.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import present, spread, table
from .p1_canonical import canonical
from .p2_spans import gram_hashes, token_ids

MIN_WORDS = 13
GRAM = 8
WINDOW = MIN_WORDS - GRAM + 1
WORD = re.compile("[a-z0-9]+")


def words(text: str) -> list[str]:
    return WORD.findall(canonical(text).lower())


def winnow(h: np.ndarray, window: int) -> np.ndarray:
    """Distinct values kept: the smallest of every `window` hashes (of all, if there are fewer)."""
    if len(h) <= window:
        return h.min(keepdims=True) if len(h) else h
    return np.unique(np.lib.stride_tricks.sliding_window_view(h, window).min(axis=1))


def _fingerprints(batches: Iterator[pd.DataFrame], lengths: list[int], item: bool) -> Iterator[pd.DataFrame]:
    memo: dict[str, int] = {}
    for b in batches:
        ids, n, value = [], [], []
        for i, text in zip(b["_id"], b["_t"]):
            v = token_ids(words(text), memo)
            parts = []
            if len(v) >= MIN_WORDS:
                parts.append((0, winnow(gram_hashes(v, GRAM), WINDOW)))
            if item and 0 < len(v) < MIN_WORDS:
                parts.append((len(v), gram_hashes(v, len(v))))
            if not item:
                parts += [(k, np.unique(gram_hashes(v, k))) for k in lengths]
            for k, h in parts:
                ids.append(np.full(len(h), i)); n.append(np.full(len(h), k)); value.append(h)
        if ids:
            yield pd.DataFrame({"_id": np.concatenate(ids), "n": np.concatenate(n), "value": np.concatenate(value)})


def _confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    memo: dict[str, int] = {}
    for b in batches:
        keep = []
        cached: dict[str, tuple[list[str], np.ndarray]] = {}
        for d, i in zip(b["dt"], b["it"]):
            w = words(i)
            k = min(MIN_WORDS, len(w))
            if d not in cached:
                cached = {d: ((x := words(d)), token_ids(x, memo))}
            keep.append(bool(k) and _shares(w, gram_hashes(token_ids(w, memo), k), cached[d][0], gram_hashes(cached[d][1], k), k))
        yield b.loc[keep, ["doc", "item"]]


def _shares(a: list[str], ga: np.ndarray, b: list[str], gb: np.ndarray, k: int) -> bool:
    """Whether k consecutive words stand in both; equal hashes only say where to compare the words."""
    _, at, to = np.intersect1d(ga, gb, return_indices=True)
    return any(a[i:i + k] == b[j:j + k] for i, j in zip(at.tolist(), to.tolist()))


def leaks(docs: DataFrame, items: DataFrame, doc: str = "doc_id", item: str = "item_id", text: str = "text") -> DataFrame:
    """(doc, item), distinct: the items each document gives away."""
    d = spread(docs.select(F.col(doc).alias("_id"), F.col(text).alias("_t")).where(present("_t") & F.col("_id").isNotNull()))
    e = items.select(F.col(item).alias("_id"), F.col(text).alias("_t")).where(present("_t") & F.col("_id").isNotNull())
    # which lengths under MIN_WORDS occur: at most MIN_WORDS - 1 numbers, whatever the size of the items
    short = F.pandas_udf(lambda s: s.map(lambda t: len(words(t))), "int")
    lengths = sorted(r[0] for r in e.select(short("_t").alias("n")).where(F.col("n").between(1, MIN_WORDS - 1)).distinct().collect())
    schema = "_id {}, n int, value bigint"
    kind = {x: df.schema[x].dataType.simpleString() for df, x in ((docs, doc), (items, item))}
    fd = d.mapInPandas(lambda it: _fingerprints(it, lengths, False), schema.format(kind[doc]))
    fe = e.mapInPandas(lambda it: _fingerprints(it, lengths, True), schema.format(kind[item]))
    # items that share a fingerprint are joined once by it
    fe = fe.groupBy("n", "value").agg(F.collect_set("_id").alias("items"))
    met = fd.join(fe, ["n", "value"]).select(F.col("_id").alias("doc"), F.explode("items").alias("item")).distinct()
    both = (met.join(d.select(F.col("_id").alias("doc"), F.col("_t").alias("dt")), "doc")
            .join(e.select(F.col("_id").alias("item"), F.col("_t").alias("it")), "item").select("doc", "item", "dt", "it"))
    ok = both.mapInPandas(_confirm, f"doc {kind[doc]}, item {kind[item]}")
    return ok.select(F.col("doc").alias(doc), F.col("item").alias(item)).distinct()


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return leaks(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "eval_items").select("item_id", "text"))
