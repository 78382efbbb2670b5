"""Reports: nested rows, JSON, HTML."""

from __future__ import annotations

import html
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.config import ScoringConfig
from palimpsest.functions import kernels, native
from palimpsest.plans.engine import Checked

VERSION = "1.0"
# What every report says.
CAVEATS = (
    "Shared text by itself decides nothing: quotations, citations and standard wording raise the index for good reasons.",
    "Only the documents of the index were compared, so a low index does not show that a text is original.",
)
COLORS = {"human": "#1b6ca8", "unclear": "#6b6b6b", "likely-ai": "#b36b00", "very-likely-ai": "#a3195b"}


def reports(checked: Checked, ai: DataFrame, documents: DataFrame, cfg: ScoringConfig, generated_at: str | None = None) -> DataFrame:
    """(doc_id, report): one nested row a submission.

    documents: doc_id, source_name, sha256, media_type, page_starts.
    """
    r = lambda c: F.round(c, 4)
    match = F.struct(
        F.col("q0").alias("_q"), F.col("src_id").cast("string").alias("source_id"), "source_label", "match_type", r("similarity").alias("similarity"), F.array("q0", "q1").alias("query_tokens"),
        F.array("s0", "s1").alias("source_tokens"), F.array("c0", "c1").alias("query_chars"), "excluded", "exclusion_reason")
    ms = checked.matches.groupBy("sub_id").agg(F.array_sort(F.collect_list(match)).alias("matches"))
    label = checked.matches.groupBy("sub_id", "src_id").agg(F.min("source_label").alias("source_label"))
    source = F.struct("rank", F.col("src_id").cast("string").alias("source_id"), "source_label", "words", "unique_words", r("share").alias("share"), r("best_similarity").alias("best_similarity"), "match_types")
    bs = checked.by_source.join(label, ["sub_id", "src_id"], "left").groupBy("sub_id").agg(F.array_sort(F.collect_list(source)).alias("sources"))
    d = (documents.select(F.col("doc_id").alias("sub_id"), "source_name", "sha256", "media_type", native.n_pages("page_starts").alias("pages"))
         .join(checked.similarity, "sub_id").join(ai.withColumnRenamed("doc_id", "sub_id").withColumnRenamed("index", "ai_index"), "sub_id").join(ms, "sub_id", "left").join(bs, "sub_id", "left"))
    now = F.lit(generated_at) if generated_at else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")
    body = F.struct(
        F.lit(VERSION).alias("report_version"), now.alias("generated_at"),
        F.struct(F.col("sub_id").cast("string").alias("id"), F.col("source_name").alias("name"), "sha256", "media_type", "pages", "total_words", "scorable_words", "excluded_words").alias("document"),
        F.struct(r("index").alias("index"), "matched_words", "scorable_words", "total_words", "excluded_words", F.coalesce("sources", F.array()).alias("sources"), F.coalesce("matches", F.array()).alias("matches")).alias("similarity"),
        F.struct(r("ai_index").alias("index"), "band", F.array(r("ci_low"), r("ci_high")).alias("confidence_interval"), "calibrated", "used_language_model", "profile",
                 F.transform("segments", lambda s: F.struct(F.array(s["start"], s["end"]).alias("span"), s["words"].alias("words"), s["score"].alias("score"), s["band"].alias("band"))).alias("segments"), "features", "caveats").alias("ai_writing"),
        F.struct(F.lit(cfg.exclude_quotes).alias("exclude_quotes"), F.lit(cfg.exclude_citations).alias("exclude_citations"), F.lit(cfg.exclude_bibliography).alias("exclude_bibliography"),
                 F.lit(cfg.min_match_words).alias("min_match_words"), F.array(*[F.lit(x) for x in sorted(cfg.allowlist)]).cast("array<string>").alias("allowlist")).alias("settings"),
        native.review_priority("index", "ai_index", "band").alias("review_priority"), F.concat("caveats", F.array(*map(F.lit, CAVEATS))).alias("caveats"))
    return d.select(F.col("sub_id").alias("doc_id"), body.alias("report"))


def to_json(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", F.to_json("report").alias("json"))


def to_html(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc_id, html); texts(doc_id, text)."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def page(text: str, r) -> str:
        s, a, d = r["similarity"], r["ai_writing"], r["document"]
        e = lambda x: html.escape(str(x))
        marks = [(*m["query_chars"], "excl" if m["excluded"] else "match", f"{m['source_label']} ({m['match_type']})" + (f" excluded: {m['exclusion_reason']}" if m["excluded"] else "")) for m in s["matches"]]
        rows = "".join(f"<tr><td>{e(x['source_label'])}</td><td>{x['words']}</td><td>{100 * x['share']:.1f}%</td><td>{x['best_similarity']:.2f}</td><td>{e(', '.join(x['match_types']))}</td></tr>" for x in s["sources"])
        rows = rows or "<tr><td colspan=5>No passage was long enough to count.</td></tr>"
        lo, hi = a["confidence_interval"]
        return (
            f"<!doctype html><meta charset=utf-8><title>{e(d['name'])}</title><style>mark.match{{background:#ffd9a8}}mark.excl{{background:#ddd}}td,th{{padding:.2em .6em}}</style>"
            f"<h1>{e(d['name'])}</h1><p>{e(r['generated_at'])} · {e(r['review_priority'])}</p>"
            f"<p>Similarity {100 * s['index']:.1f}% ({s['matched_words']} of {s['scorable_words']} words, {s['excluded_words']} excluded)</p>"
            f"<p style=\"color:{COLORS.get(a['band'], '#444')}\">AI-writing {100 * a['index']:.0f}% ({100 * lo:.0f}-{100 * hi:.0f}), {e(a['band'])}, {'calibrated' if a['calibrated'] else 'NOT calibrated'}</p>"
            f"<table><tr><th>Source<th>Words<th>Share<th>Similarity<th>Kind</tr>{rows}</table><div>{kernels.highlight(text or '', marks)}</div>"
            f"<ul>{''.join(f'<li>{e(c)}</li>' for c in r['caveats'])}</ul>")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "html": [page(t, json.loads(j)) for t, j in zip(b["text"], b["json"])]})

    j = rows.select("doc_id", F.to_json("report", {"ignoreNullFields": "false"}).alias("json")).join(texts.select("doc_id", "text"), "doc_id")
    return j.mapInPandas(run, f"doc_id {kind}, html string")
