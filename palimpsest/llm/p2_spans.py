"""Problem 2: long exact spans that several records share.

A record becomes a sequence of shingles (GRAM tokens each). A Cartesian tree over the shingles'
hashes yields compact windows (l, c, r): in every run of shingles that starts at or after l, ends
at or before r and holds c, the smallest hash stands at c. Only windows at least as wide as the
shortest span asked for are kept. Two records that share MIN_TOKENS tokens in a row share that
run's smallest shingle, and in each the kept window of that shingle holds the run, so one hash
function finds every such pair; more would only serve inexact passages. Records whose windows meet
on a hash are verified exactly: all runs of MIN_TOKENS tokens inside the windows that met are
joined on a 64-bit hash of the whole run.

Copies of one token sequence form one class and are expanded only in the result. A run's set of
holders is summed up in a signature; runs with the same holders (neighbouring runs mostly) are
expanded once. Null and empty texts, and those of fewer than MIN_TOKENS tokens, share nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, pairs_of_classes, pairs_within, present, spread, table, tokens

MIN_TOKENS = 40
GRAM = 20
_MULT = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def token_ids(toks: list[str], memo: dict[str, int]) -> np.ndarray:
    if len(memo) > 500_000:
        memo.clear()
    out = []
    for t in toks:
        h = memo.get(t)
        if h is None:
            h = memo[t] = xxhash.xxh3_64_intdigest(t)
        out.append(h)
    return np.array(out, dtype=np.uint64)


def gram_hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n ids, as int64; by doubling, so in log n vector steps."""
    if len(ids) < n:
        return np.empty(0, np.int64)
    with np.errstate(over="ignore"):
        h, width, acc, done = ids.copy(), 1, None, 0
        k = n
        while k:
            if k & 1:
                part = h[done: done + len(ids) - n + 1]
                acc = part.copy() if acc is None else (acc * _MULT ** np.uint64(width)) + part
                done += width
            k >>= 1
            if k:
                h = (h[:-width] * _MULT ** np.uint64(width)) + h[width:]
                width *= 2
        acc = (acc ^ (acc >> np.uint64(31))) * _MIX
        acc ^= acc >> np.uint64(29)
    return acc.view(np.int64)


def compact_windows(h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(l, c, r) of the Cartesian tree's nodes whose subtree spans at least `width` shingles; r is inclusive."""
    n = len(h)
    if n < width:
        e = np.empty(0, np.int64)
        return e, e, e
    # A node is that wide exactly if it is the (first) minimum of some stretch of `width`.
    c = np.unique(np.lib.stride_tricks.sliding_window_view(h, width).argmin(axis=1) + np.arange(n - width + 1))
    left, right, stack = np.empty(len(c), np.int64), np.empty(len(c), np.int64), []
    for k in range(len(c)):  # previous and next smaller among wide nodes bound the window
        while stack and h[c[stack[-1]]] > h[c[k]]:
            right[stack.pop()] = c[k] - 1
        left[k] = c[stack[-1]] + 1 if stack else 0
        stack.append(k)
    for k in stack:
        right[k] = n - 1
    return left, c, right


def _windows(batches: Iterator[pd.DataFrame], min_tokens: int, gram: int) -> Iterator[pd.DataFrame]:
    memo: dict[str, int] = {}
    for b in batches:
        ids, cls, key, lo, hi = [], [], [], [], []
        for i, text in zip(b["_id"], b["_t"]):
            v = token_ids(tokens(text), memo)
            if len(v) < min_tokens:
                continue
            left, c, right = compact_windows(h := gram_hashes(v, gram), min_tokens - gram + 1)
            ids.append(np.full(len(c), i)); cls.append(np.full(len(c), xxhash.xxh3_64_intdigest(v.tobytes()) - 2**63, np.int64))
            # the runs of min_tokens that hold c and stay inside the window
            key.append(h[c]); lo.append(np.maximum(left, c + gram - min_tokens)); hi.append(np.minimum(right + gram - min_tokens, c))
        if ids:
            yield pd.DataFrame({"_id": np.concatenate(ids), "cls": np.concatenate(cls), "key": np.concatenate(key), "lo": np.concatenate(lo), "hi": np.concatenate(hi)})


def _runs(batches: Iterator[pd.DataFrame], min_tokens: int) -> Iterator[pd.DataFrame]:
    memo: dict[str, int] = {}
    for b in batches:
        cls, run, pos = [], [], []
        for k, text, spans in zip(b["cls"], b["_t"], b["spans"]):
            g = gram_hashes(token_ids(tokens(text), memo), min_tokens)
            p = np.unique(np.concatenate([np.arange(s["lo"], s["hi"] + 1) for s in spans]))
            cls.append(np.full(len(p), k)); run.append(g[p]); pos.append(p)
        if cls:
            yield pd.DataFrame({"cls": np.concatenate(cls), "run": np.concatenate(run), "pos": np.concatenate(pos)})


def _shared_runs(df: DataFrame, ident: str, text: str, min_tokens: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """(members(cls, _id), runs(cls, run, pos) that stand in at least two classes)."""
    d = spread(df.select(F.col(ident).alias("_id"), F.col(text).alias("_t")).where(present("_t") & F.col("_id").isNotNull()))
    kind = df.schema[ident].dataType.simpleString()
    w = materialize(d.mapInPandas(lambda it: _windows(it, min_tokens, gram), f"_id {kind}, cls bigint, key bigint, lo int, hi int"))
    members = w.select("_id", "cls").distinct()
    chosen = members.groupBy("cls").agg(F.min("_id").alias("_id"))
    one = w.join(chosen, ["cls", "_id"], "left_semi").select("cls", "key", "lo", "hi")
    met = one.groupBy("key").agg(F.min("cls").alias("a"), F.max("cls").alias("b")).where("a <> b").select("key")
    spans = (one.join(met, "key").groupBy("cls").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
             .join(chosen, "cls").join(d, "_id").select("cls", "_t", "spans"))
    runs = materialize(spans.mapInPandas(lambda it: _runs(it, min_tokens), "cls bigint, run bigint, pos int"))
    both = runs.groupBy("run").agg(F.min("cls").alias("a"), F.max("cls").alias("b")).where("a <> b").select("run")
    return members, runs.join(both, "run")


def shared_pairs(df: DataFrame, ident: str = "raw_id", text: str = "text", min_tokens: int = MIN_TOKENS, gram: int = GRAM) -> DataFrame:
    """(ident_a, ident_b): rows that have at least min_tokens consecutive tokens in common."""
    members, runs = _shared_runs(df, ident, text, min_tokens, gram)
    holders = runs.select("run", "cls").distinct()
    sig = holders.groupBy("run").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("cls", F.lit(1))).alias("s1"), F.bit_xor(F.xxhash64("cls", F.lit(2))).alias("s2"))
    chosen = sig.groupBy("n", "s1", "s2").agg(F.min("run").alias("run")).select("run")
    h = holders.join(chosen, "run").select(F.col("run").alias("g"), "cls")
    out = (f"{ident}_a", f"{ident}_b")
    pairs = pairs_within(h.select(F.col("g").alias("cls"), F.col("cls").alias("c")), "c", ("ca", "cb")).distinct()
    return pairs_of_classes(members, pairs, "_id", out).unionByName(pairs_within(members, "_id", out))


def shared_share(df: DataFrame, ident: str = "raw_id", text: str = "text", min_tokens: int = MIN_TOKENS, gram: int = GRAM) -> DataFrame:
    """(ident, n_tokens, shared_tokens, share) of every row; a copied text is shared whole, null text has 0 tokens."""
    members, runs = _shared_runs(df, ident, text, min_tokens, gram)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n = [len(tokens(t)) if t else 0 for t in b["_t"]]
            yield pd.DataFrame({"_id": b["_id"], "n_tokens": n})

    kind = df.schema[ident].dataType.simpleString()
    sizes = spread(df.select(F.col(ident).alias("_id"), F.col(text).alias("_t"))).mapInPandas(measure, f"_id {kind}, n_tokens int")
    # start positions -> covered tokens: every start adds the part of its run beyond the start before it
    from pyspark.sql import Window
    gap = F.col("pos") - F.lag("pos").over(Window.partitionBy("cls").orderBy("pos"))
    cover = runs.select("cls", "pos").distinct().select("cls", F.coalesce(F.least(gap, F.lit(min_tokens)), F.lit(min_tokens)).alias("add")).groupBy("cls").agg(F.sum("add").alias("cover"))
    copies = members.groupBy("cls").agg(F.count("*").alias("n"))
    m = members.join(copies, "cls").join(cover, "cls", "left")
    out = sizes.join(m, "_id", "left").select(
        F.col("_id").alias(ident), "n_tokens",
        F.when(F.col("n") > 1, F.col("n_tokens")).otherwise(F.coalesce("cover", F.lit(0))).cast("int").alias("shared_tokens"))
    return out.withColumn("share", F.when(F.col("n_tokens") > 0, F.round(F.col("shared_tokens") / F.col("n_tokens"), 6)).otherwise(F.lit(0.0)))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return shared_pairs(table(spark, sf, "raw_docs").select("raw_id", "text"))


def p2_share(spark: SparkSession, sf: str) -> DataFrame:
    return shared_share(table(spark, sf, "raw_docs").select("raw_id", "text"))
