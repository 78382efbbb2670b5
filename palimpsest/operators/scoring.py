"""Scoring of matches: exclusions, the similarity index, its breakdown by source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.config import ScoringConfig

KEYS = ["sub_id", "src_id", "q0", "q1", "s0", "s1"]


def admitted(matches: DataFrame, cfg: ScoringConfig) -> DataFrame:
    """Without sources on the allow list and passages that are too short. A long list is a table of its own, joined."""
    m = matches.where(F.col("q1") - F.col("q0") + 1 >= cfg.min_match_words)
    if len(cfg.allowlist) > 1000:
        allowed = m.sparkSession.createDataFrame([(x,) for x in sorted(cfg.allowlist)], "_allowed string")
        return m.join(allowed, F.col("src_id").cast("string") == F.col("_allowed"), "left_anti")
    return m.where(~F.col("src_id").cast("string").isin(*sorted(cfg.allowlist))) if cfg.allowlist else m


def apply_exclusions(matches: DataFrame, exclusions: DataFrame, cfg: ScoringConfig) -> DataFrame:
    """Plus excluded and exclusion_reason. matches has c0, c1 (characters), exclusions(doc_id, start, end, kind) one row a span.

    A match is excluded if the one span that covers most of it (the first of the best) covers exclusion_ratio of it.
    """
    e = exclusions.where(F.col("kind").isin(*cfg.kinds)) if cfg.kinds else exclusions.limit(0)
    e = e.select(F.col("doc_id").alias("sub_id"), F.col("start").alias("_s"), F.col("end").alias("_e"), "kind")
    spans = matches.select("sub_id", "c0", "c1").distinct()
    j = spans.join(e, "sub_id").where((F.col("_s") < F.col("c1")) & (F.col("c0") < F.col("_e")))
    cover = (F.least("c1", "_e") - F.greatest("c0", "_s")) / F.greatest(F.lit(1), F.col("c1") - F.col("c0"))
    best = j.groupBy("sub_id", "c0", "c1").agg(F.max(F.struct(cover.alias("cover"), (-F.col("_s")).alias("a"), (-F.col("_e")).alias("b"), "kind")).alias("x"))
    best = best.where(F.col("x.cover") >= cfg.exclusion_ratio).select("sub_id", "c0", "c1", F.col("x.kind").alias("exclusion_reason"))
    return matches.join(best, ["sub_id", "c0", "c1"], "left").withColumn("excluded", F.col("exclusion_reason").isNotNull())


def judged(matches: DataFrame, cfg: ScoringConfig) -> DataFrame:
    """As apply_exclusions(), of matches that hold the exclusions near them; no join."""
    size = F.greatest(F.lit(1), F.col("c1") - F.col("c0"))
    near = F.filter("near", lambda x: x["kind"].isin(*cfg.kinds)) if cfg.kinds else F.slice("near", 1, 0)
    best = F.array_max(F.transform(near, lambda x: F.struct(
        ((F.least("c1", x["end"]) - F.greatest("c0", x["start"])) / size).alias("cover"), (-x["start"]).alias("a"), (-x["end"]).alias("b"), x["kind"].alias("kind"))))
    m = matches.withColumn("_x", best).drop("near")
    m = m.withColumn("exclusion_reason", F.when(F.col("_x.cover") >= cfg.exclusion_ratio, F.col("_x.kind"))).drop("_x")
    return m.withColumn("excluded", F.col("exclusion_reason").isNotNull())


def covered(matches: DataFrame) -> DataFrame:
    """(sub_id, src_id, pos) of matches that are not excluded, distinct: only matched positions are ever a row each. Without the positions in lost, if matches have it."""
    at = F.sequence("q0", "q1")
    at = F.array_except(at, "lost") if "lost" in matches.columns else at
    return matches.where("not excluded").select("sub_id", "src_id", F.explode(at).alias("pos")).distinct()


def token_mask(tokens: str | Column, exclusions: str | Column, kinds: list[str]) -> Column:
    """array<boolean>: for each token whether it overlaps no excluded span of the kinds that count."""
    active = F.filter(exclusions, lambda x: x["kind"].isin(*kinds)) if kinds else F.slice(exclusions, 1, 0)
    return F.transform(tokens, lambda t: ~F.exists(active, lambda x: (x["start"] < t["end"]) & (t["start"] < x["end"])))


def similarity_index(cover: DataFrame, sizes: DataFrame) -> DataFrame:
    """(sub_id, index, matched_words, scorable_words, total_words, excluded_words) of each row of sizes(sub_id, total_words, scorable_words).

    cover(sub_id, src_id, pos): matched positions that count. Where none counts the index is 0.
    """
    matched = cover.select("sub_id", "pos").distinct().groupBy("sub_id").agg(F.count("*").alias("matched_words"))
    t = sizes.select("sub_id", F.col("total_words").cast("bigint").alias("total_words"), F.col("scorable_words").cast("bigint").alias("scorable_words")).join(matched, "sub_id", "left").na.fill(0, ["matched_words"])
    return t.select("sub_id", F.when(F.col("scorable_words") > 0, F.col("matched_words") / F.col("scorable_words")).otherwise(0.0).alias("index"),
                    "matched_words", "scorable_words", "total_words", (F.col("total_words") - F.col("scorable_words")).alias("excluded_words"))


def breakdown(matches: DataFrame, cover: DataFrame, sizes: DataFrame) -> DataFrame:
    """(sub_id, src_id, words, unique_words, share, best_similarity, match_types, rank).

    Sources claim positions in the order of their words, then id; unique words are those claimed, so
    shares sum to the index. A source left without a position is no row.
    """
    words = cover.groupBy("sub_id", "src_id").agg(F.count("*").alias("words"))
    # who claims a position: the best source that holds it; a minimum, so no sort of a position's holders
    # a file of positions is a hundredth of them in memory, so its size must not have them broadcast
    owner = cover.join(words.hint("merge"), ["sub_id", "src_id"]).groupBy("sub_id", "pos").agg(F.min(F.struct((-F.col("words")).alias("w"), "src_id")).alias("x"))
    unique = owner.groupBy("sub_id", F.col("x.src_id").alias("src_id")).agg(F.count("*").alias("unique_words"))
    kinds = matches.where("not excluded").groupBy("sub_id", "src_id").agg(F.max("similarity").alias("best_similarity"), F.array_sort(F.collect_set("match_type")).alias("match_types"))
    out = words.join(unique, ["sub_id", "src_id"], "left").na.fill(0, ["unique_words"]).join(sizes.select("sub_id", "scorable_words"), "sub_id").join(kinds, ["sub_id", "src_id"])
    w = Window.partitionBy("sub_id").orderBy(F.col("unique_words").desc(), F.col("words").desc(), "src_id")
    return out.select("sub_id", "src_id", "words", "unique_words", (F.col("unique_words") / F.col("scorable_words")).alias("share"), "best_similarity", "match_types").withColumn("rank", F.row_number().over(w))
