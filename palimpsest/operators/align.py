"""Alignment of candidate pairs: seeds are chained, each chain's region aligned, passages of one source merged."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.config import AlignConfig, FingerprintConfig
from palimpsest.functions import kernels, native
from palimpsest.operators.spans import EXCLUSIONS

PASSAGE = "q0 int, q1 int, s0 int, s1 int, similarity double"


def passages(pairs: DataFrame, seed_rows: DataFrame, subs: DataFrame, docs: DataFrame, cfg: FingerprintConfig, a: AlignConfig) -> DataFrame:
    """(sub_id, src_id, q0, q1, s0, s1, similarity, match_type) of the given pairs(sub_id, src_id).

    Seeds are gathered by pair: at most as many as the two documents have equal positions. Pairs without tokens or seeds give none.
    """
    z = seed_rows.join(pairs.select("sub_id", "src_id"), ["sub_id", "src_id"], "left_semi").groupBy("sub_id", "src_id").agg(F.collect_set(F.struct("q", "s")).alias("seeds"))
    ta = subs.groupBy(F.col("doc_id").alias("sub_id")).agg(F.first("tokens").alias("ta"))
    tb = docs.groupBy(F.col("doc_id").alias("src_id")).agg(F.first("tokens").alias("tb"))
    kinds = [df.schema["doc_id"].dataType.simpleString() for df in (subs, docs)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            pairs = [(list(x), list(y), [(int(e["q"]), int(e["s"])) for e in s]) for s, x, y in zip(b["seeds"], b["ta"], b["tb"])]
            rows = [(sub, src, *p) for sub, src, ps in zip(b["sub_id"], b["src_id"], kernels.align(pairs, cfg.k, a)) for p in ps]
            yield pd.DataFrame(rows, columns=["sub_id", "src_id", "q0", "q1", "s0", "s1", "similarity"])

    m = z.join(ta, "sub_id").join(tb, "src_id").mapInPandas(run, f"sub_id {kinds[0]}, src_id {kinds[1]}, {PASSAGE}")
    return m.withColumn("match_type", native.classify("similarity"))


def located(pairs: DataFrame, subs: DataFrame, docs: DataFrame, cfg: FingerprintConfig, a: AlignConfig) -> DataFrame:
    """As passages(), with seeds taken from the fingerprints of the two documents, plus c0, c1 (characters), near (exclusions that overlap these) and lost (token positions in q0 to q1 that do not count).

    subs: spans.prepared(). No row of a shuffle is a seed; a row is a pair with the tokens and fingerprints of its documents, tokens as one string.
    """
    def side(df: DataFrame, ident: str, end: str, *more: str) -> DataFrame:
        return df.groupBy(F.col("doc_id").alias(ident)).agg(*[F.first(F.concat_ws(" ", c) if c == "tokens" else F.col(c)).alias(f"{c}_{end}") for c in ("tokens", "pos", "value", *more)])

    kinds = [df.schema["doc_id"].dataType.simpleString() for df in (subs, docs)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for big in batches:
            for at in range(0, len(big), 500):
                b = big[at:at + 500]
                words = [(x.split(), y.split()) for x, y in zip(b["tokens_a"], b["tokens_b"])]
                seeds = [kernels.shared_positions(*x) for x in zip(b["pos_a"], b["value_a"], b["pos_b"], b["value_b"])]
                rows = []
                for sub, src, gaps, excl, lost, ps in zip(b["sub_id"], b["src_id"], b["gaps_a"], b["exclusions_a"], b["lost_a"], kernels.align([(*w, s) for w, s in zip(words, seeds)], cfg.k, a)):
                    if ps:
                        at_char, lost = np.cumsum(gaps), np.asarray(lost)
                    for p in ps:
                        c0, c1 = int(at_char[2 * p[0]]), int(at_char[2 * p[1] + 1])
                        rows.append((sub, src, *p, c0, c1, [x for x in excl if x["start"] < c1 and c0 < x["end"]], lost[(lost >= p[0]) & (lost <= p[1])]))
                yield pd.DataFrame(rows, columns=["sub_id", "src_id", "q0", "q1", "s0", "s1", "similarity", "c0", "c1", "near", "lost"])

    p = pairs.select("sub_id", "src_id").join(side(docs, "src_id", "b").hint("merge"), "src_id").join(side(subs, "sub_id", "a", "gaps", "exclusions", "lost").hint("merge"), "sub_id")
    m = p.mapInPandas(run, f"sub_id {kinds[0]}, src_id {kinds[1]}, {PASSAGE}, c0 int, c1 int, near {EXCLUSIONS}, lost array<int>")
    return m.withColumn("match_type", native.classify("similarity"))


def chains(seed_rows: DataFrame, max_gap: int) -> DataFrame:
    """(sub_id, src_id, q_start, q_end, s_start, s_end, anchors) of every pair's seeds."""
    kinds = [seed_rows.schema[c].dataType.simpleString() for c in ("sub_id", "src_id")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(sub, src, *c) for sub, src, s in zip(b["sub_id"], b["src_id"], b["seeds"]) for c in kernels.chains([(int(e["q"]), int(e["s"])) for e in s], max_gap)]
            yield pd.DataFrame(rows, columns=["sub_id", "src_id", "q_start", "q_end", "s_start", "s_end", "anchors"])

    z = seed_rows.groupBy("sub_id", "src_id").agg(F.collect_list(F.struct("q", "s")).alias("seeds"))
    return z.mapInPandas(run, f"sub_id {kinds[0]}, src_id {kinds[1]}, q_start int, q_end int, s_start int, s_end int, anchors int")
