"""Queries over the test tables, one for each operator, and SQL twins where SQL can say the same.

Submissions are `documents`, the reference corpus is `eval_items` (or, where matches are given,
`raw_docs` with `matches` and `segments`). Queries with a twin take the tokens of the stored text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.config import CALIBRATED, DISCOURSE_MARKERS, FUNCTION_WORDS, PRIME, UNCALIBRATED, AlignConfig, FingerprintConfig, ScoringConfig
from palimpsest.functions import kernels, native
from palimpsest.operators import align, blocks, detect, lm, paraphrase, retrieve, scoring, spans
from palimpsest.operators.corpus import Corpus, choose_bands, fingerprints, latest, lsh, postings
from palimpsest.operators.cut import written
from palimpsest.plans import report, twins
from palimpsest.plans.engine import Engine
from palimpsest.sources import providers
from palimpsest.streaming.watch import score_drift

CFG = FingerprintConfig(normalize=False)
Query = Callable[[SparkSession, str], DataFrame]


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _spread(df: DataFrame) -> DataFrame:
    """A table of few row groups gets a partition a core, so that kernels use them all; a large one stays as it is split."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n)


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return _spread(_t(spark, sf, "documents").select("doc_id", "text"))


def _items(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "eval_items").select(F.col("item_id").alias("doc_id"), "text")


def _fp(df: DataFrame, tokens: bool = False) -> DataFrame:
    return fingerprints(df, CFG, tokens=tokens)


def _raw(spark: SparkSession, sf: str) -> DataFrame:
    """One row a doc_id of raw_docs (one content, one id)."""
    d = _t(spark, sf, "raw_docs").where("doc_id is not null and text is not null").select("doc_id", "text")
    return d.groupBy("doc_id").agg(F.min("text").alias("text"))


def _matches(spark: SparkSession, sf: str) -> DataFrame:
    m = _t(spark, sf, "matches").where("query_tokens is not null").select(
        "match_id", "sub_id", F.col("source_id").alias("src_id"), F.get("query_tokens", F.lit(0)).alias("q0"), F.get("query_tokens", F.lit(1)).alias("q1"), "similarity", "match_type", "excluded",
        F.get("query_chars", F.lit(0)).alias("c0"), F.get("query_chars", F.lit(1)).alias("c1"), "matched_at")
    return latest(m, ["match_id"], "matched_at")


# --- queries ----------------------------------------------------------------------------------------


def tidy_text(s, d):
    return _t(s, d, "documents").select("doc_id", native.tidy("text").alias("tidy"))


def doc_content_id(s, d):
    return _t(s, d, "documents").select("doc_id", native.content_id("text").alias("content_id"), native.digest("text").alias("sha256"))


def content_dedupe(s, d):
    return _t(s, d, "documents").where("text is not null").groupBy(native.content_id("text").alias("content_id")).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n"))


def html_text(s, d):
    return _t(s, d, "discovered").select("cand_id", native.html_to_text("text").alias("plain"))


def strip_jats(s, d):
    return _t(s, d, "discovered").select("cand_id", native.strip_jats("text").alias("plain"))


def dedupe_by_doi(s, d):
    return providers.first_by_doi(_t(s, d, "discovered").select("source_id", "cand_id", "provider", "found_at"), ["found_at", "cand_id"]).select("doi", "cand_id", "provider")


def page_of_span(s, d):
    p = _t(s, d, "raw_docs").where("doc_id is not null").groupBy("doc_id").agg(F.max("page_starts").alias("page_starts"))
    g = _t(s, d, "segments").where("span is not null").select("doc_id", "seg_no", F.get("span", F.lit(0)).alias("offset_at")).distinct()
    return g.join(p, "doc_id").select("doc_id", "seg_no", "offset_at", native.page_of("page_starts", "offset_at").alias("page"), native.n_pages("page_starts").alias("n_pages"))


def source_labels(s, d):
    m = _t(s, d, "source_meta").where("doc_id is not null").select("doc_id", "title", "url", "kind", "year", "indexed_at")
    return latest(m, ["doc_id"], "indexed_at").select("doc_id", native.source_label("title", "url", "doc_id").alias("label"), "kind")


def latest_matches(s, d):
    return _matches(s, d).select("match_id", "sub_id", "src_id", "q0", "q1", "similarity", "excluded")


def tokenize(s, d):
    return _t(s, d, "documents").select("doc_id", F.posexplode(native.tokens("text")).alias("idx", "tok"))


def token_offsets(s, d):
    return spans.token_offsets(_t(s, d, "eval_items"), "item_id").withColumnRenamed("doc_id", "item_id")


def dehyphenate(s, d):
    return _t(s, d, "raw_docs").select("raw_id", native.dehyphenate("text").alias("joined"))


def tag_counts(s, d):
    n = lambda p: F.coalesce(F.size(F.regexp_extract_all("text", F.lit(p), F.lit(0))), F.lit(0))
    return _t(s, d, "documents").where("text is not null").select("doc_id", n(native.INLINE_QUOTE).alias("quotes"), n(native.CITATION).alias("citations"))


def merge_spans(s, d):
    g = _t(s, d, "segments").select("doc_id", "band", F.get("span", F.lit(0)).alias("start"), F.get("span", F.lit(1)).alias("end")).where("doc_id is not null and band is not null")
    return spans.merge_spans(g, ["doc_id", "band"])


def scorable_tokens(s, d):
    m = _matches(s, d).where("excluded and c0 is not null").select(F.col("sub_id").alias("doc_id"), F.col("c0").alias("start"), F.col("c1").alias("end"))
    raw = _raw(s, d).join(m.select("doc_id").distinct(), "doc_id", "left_semi")
    return spans.scorable(spans.token_offsets(raw), m).groupBy("doc_id").agg(F.count("*").alias("scorable"))


def token_hash(s, d):
    toks = _t(s, d, "eval_items").select(F.explode(native.tokens("text")).alias("tok")).distinct()
    return toks.select("tok", native.token_hash("tok").alias("value"))


def shingle_hash(s, d):
    toks = _t(s, d, "eval_items").select("item_id", F.posexplode(native.tokens("text")).alias("pos", "tok"))
    v = toks.join(toks.select("tok").distinct().withColumn("tv", native.token_hash("tok")), "tok")
    w = Window.partitionBy("item_id").orderBy("pos")
    return v.select("item_id", "pos", native.horner257([F.lead("tv", i).over(w) if i else F.col("tv") for i in range(CFG.k)]).alias("value")).where("value is not null")


def winnow_fps(s, d):
    return postings(_fp(_docs(s, d)))


def fingerprint_positions(s, d):
    return postings(_fp(_docs(s, d))).groupBy("doc_id", "value").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos")).where("n > 1")


def distinct_fps(s, d):
    return _fp(_docs(s, d)).select("doc_id", "n_tokens", F.size(F.array_distinct("value")).alias("n_values"))


def minhash_signature(s, d):
    return _fp(_items(s, d)).select(F.col("doc_id").alias("item_id"), F.posexplode("sig").alias("slot", "value"))


def lsh_band_keys(s, d):
    return lsh(_fp(_items(s, d)), CFG).select(F.col("doc_id").alias("item_id"), "band", F.get("key", F.lit(0)).alias("k0"), F.get("key", F.lit(1)).alias("k1"))


def lsh_candidate_pairs(s, d):
    f = _fp(_items(s, d))
    return retrieve.lsh_pairs(f, f, CFG).where("sub_id < src_id").select(F.col("sub_id").alias("a_id"), F.col("src_id").alias("b_id"))


def pair_jaccard(s, d):
    f = _fp(_items(s, d))
    p = retrieve.lsh_pairs(f, f, CFG).where("sub_id < src_id")
    p = p.join(f.select(F.col("doc_id").alias("sub_id"), F.col("sig").alias("sa"), F.col("value").alias("va")), "sub_id").join(f.select(F.col("doc_id").alias("src_id"), F.col("sig").alias("sb"), F.col("value").alias("vb")), "src_id")
    return p.select(F.col("sub_id").alias("a_id"), F.col("src_id").alias("b_id"), F.round(native.estimate_jaccard("sa", "sb"), 6).alias("estimated"), F.round(native.exact_jaccard("va", "vb"), 6).alias("exact"))


# The same operators over documents, which grow. Pairs are given between classes of equal fingerprint sets
# (`lsh_classes_docs` says which document is in which), so copies cost a row each and not one a pair.


def token_offsets_docs(s, d):
    return spans.token_offsets(_docs(s, d))


def token_hash_docs(s, d):
    toks = _docs(s, d).select(F.explode(native.tokens("text")).alias("tok")).distinct()
    return toks.select("tok", native.token_hash("tok").alias("value"))


def shingle_hash_docs(s, d):
    toks = _docs(s, d).select("doc_id", F.posexplode(native.tokens("text")).alias("pos", "tok"))
    v = toks.join(toks.select("tok").distinct().withColumn("tv", native.token_hash("tok")), "tok")
    w = Window.partitionBy("doc_id").orderBy("pos")
    return v.select("doc_id", "pos", native.horner257([F.lead("tv", i).over(w) if i else F.col("tv") for i in range(CFG.k)]).alias("value")).where("value is not null")


def minhash_signature_docs(s, d):
    return _fp(_docs(s, d)).select("doc_id", F.posexplode("sig").alias("slot", "value"))


def lsh_band_keys_docs(s, d):
    return lsh(_fp(_docs(s, d)), CFG).select("doc_id", "band", F.get("key", F.lit(0)).alias("k0"), F.get("key", F.lit(1)).alias("k1"))


def _classes(f: DataFrame) -> DataFrame:
    """(doc_id, class_id): class_id is the smallest doc_id with the same set of fingerprints."""
    m = f.select("doc_id", F.xxhash64(F.array_sort(F.array_distinct("value"))).alias("_k"))
    return m.join(m.groupBy("_k").agg(F.min("doc_id").alias("class_id")), "_k").select("doc_id", "class_id")


def lsh_classes_docs(s, d):
    return _classes(_fp(_docs(s, d)))


def _class_sets(s, d) -> DataFrame:
    """(doc_id, value): the set of fingerprints of each class, sorted, under the class's id."""
    f = fingerprints(_docs(s, d), replace(CFG, n_perm=0), tokens=False).select("doc_id", F.array_sort(F.array_distinct("value")).alias("value"))
    return f.groupBy(F.xxhash64("value").alias("_k")).agg(F.min("doc_id").alias("doc_id"), F.first("value").alias("value")).drop("_k")


def lsh_candidate_pairs_docs(s, d):
    return blocks.pairs(_class_sets(s, d), CFG)


def pair_jaccard_docs(s, d):
    """Pairs that agree in a band, and all others of the threshold's similarity or more."""
    p = blocks.pairs(_class_sets(s, d), CFG, jaccard=True)
    exact = F.when(F.col("either") > 0, F.col("shared") / F.col("either")).otherwise(0.0)
    return p.select("a_id", "b_id", F.round(F.col("same") / CFG.n_perm, 6).alias("estimated"), F.round(exact, 6).alias("exact"))


def index_stats_docs(s, d):
    return Corpus.build(_docs(s, d), cfg=CFG).stats()


def lexical_embedding_docs(s, d):
    return paraphrase.lexical_embedding(_docs(s, d)).select("doc_id", "bucket", F.round("weight", 6).alias("weight"))


def mask_and_refill_docs(s, d):
    m = _docs(s, d).select("doc_id", lm.mask_spans("text").alias("m")).select("doc_id", "m.masked", "m.n")
    answer = F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(F.col("n") - 1, F.lit(0))), lambda i: F.concat(F.lit("<extra_id_"), i.cast("string"), F.lit("> word"))), " ")
    return m.select("doc_id", "masked", "n", lm.refill("masked", answer).alias("refilled"))


def _pair(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({"sub_id": "doc_id", "src_id": "item_id"})


# ids of documents and items are numbers of different tables, so a shift keeps them apart
SHIFT = 1_000_000_000_000


def _far(df: DataFrame) -> DataFrame:
    return df.withColumn("doc_id", F.col("doc_id") + SHIFT)


def _near(df: DataFrame) -> DataFrame:
    return _pair(df).withColumn("item_id", F.col("item_id") - SHIFT)


def shared_counts(s, d):
    return _near(retrieve.shared_counts(_fp(_docs(s, d)), _fp(_far(_items(s, d)))))


def seeds(s, d):
    return _near(retrieve.seeds(_fp(_docs(s, d)), _fp(_far(_items(s, d)))))


def candidates_top50(s, d):
    c = _near(retrieve.candidates(written(_fp(_docs(s, d))), written(_fp(_far(_items(s, d)))), CFG))
    return c.select("doc_id", "item_id", F.round("est_jaccard", 6).alias("est_jaccard"), "shared", "via", "rank")


def _runs(s, d) -> DataFrame:
    return retrieve.exact_runs(retrieve.seeds(_fp(_docs(s, d)), _fp(_far(_items(s, d)))), CFG.k)


def exact_runs(s, d):
    return _near(_runs(s, d))


def _run_cover(s, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    m = written(scoring.admitted(_runs(s, d), ScoringConfig()).withColumns({"excluded": F.lit(False), "similarity": F.lit(1.0), "match_type": F.lit("verbatim")}))
    n = F.size(native.tokens("text"))
    return m, scoring.covered(m), _docs(s, d).select(F.col("doc_id").alias("sub_id"), n.alias("total_words"), n.alias("scorable_words"))


def similarity_index(s, d):
    _, cover, sizes = _run_cover(s, d)
    return scoring.similarity_index(cover, sizes).select(F.col("sub_id").alias("doc_id"), F.round("index", 6).alias("index"), "matched_words", "scorable_words")


def source_breakdown(s, d):
    m, cover, sizes = _run_cover(s, d)
    b = _near(scoring.breakdown(m, written(cover), sizes))
    return b.select("doc_id", "item_id", "words", "unique_words", F.round("share", 6).alias("share"), "rank")


def matched_index(s, d):
    """The index of each submission in the given matches; tokens inside excluded passages do not count."""
    m = written(_matches(s, d))
    toks = _raw(s, d).join(m.select(F.col("sub_id").alias("doc_id")).distinct(), "doc_id", "left_semi").select(F.col("doc_id").alias("sub_id"), F.size(native.tokens("text")).alias("total_words"))
    inside = lambda p: p.join(toks, "sub_id").where(F.col("pos") < F.col("total_words")).drop("total_words")
    out = inside(m.where("excluded").select("sub_id", F.explode(F.sequence("q0", "q1")).alias("pos")).distinct())
    lost = out.groupBy("sub_id").agg(F.count("*").alias("_n"))
    sizes = toks.join(lost, "sub_id", "left").select("sub_id", "total_words", (F.col("total_words") - F.coalesce("_n", F.lit(0))).alias("scorable_words"))
    cover = inside(scoring.covered(m)).join(out, ["sub_id", "pos"], "left_anti")
    return scoring.similarity_index(cover, sizes).select("sub_id", F.round("index", 6).alias("index"), "matched_words", "scorable_words", "total_words")


def _segments(s, d) -> DataFrame:
    g = _t(s, d, "segments").where("score is not null").select("doc_id", "seg_no", "score", "words", F.get("span", F.lit(0)).alias("a"), F.get("span", F.lit(1)).alias("b"))
    return g.distinct()


def ai_bands(s, d):
    return _segments(s, d).select("doc_id", "seg_no", "a", "score", native.band_for("score").alias("band"))


def ai_document_index(s, d):
    g = detect.document_index(_segments(s, d).where("words > 0"))
    return g.select("doc_id", "covered", "n_segments", F.round("index", 6).alias("index"), F.round("half", 6).alias("half"), native.band_for("index").alias("band"))


def review_priority(s, d):
    a = ai_document_index(s, d).select("doc_id", F.col("index").alias("ai"), "band")
    m = matched_index(s, d).select(F.col("sub_id").alias("doc_id"), F.col("index").alias("similarity"))
    j = a.join(m, "doc_id", "left").na.fill(0.0, ["similarity"])
    return j.select("doc_id", "similarity", "ai", native.review_priority("similarity", "ai", "band").alias("priority"))


def isotonic_apply(s, d):
    return _segments(s, d).select("doc_id", "seg_no", "a", native.isotonic("score", CALIBRATED.breakpoints, CALIBRATED.values).alias("calibrated"))


def isotonic_fit(s, d):
    g = _t(s, d, "segments").where("score is not null and band is not null").select("score", F.col("band").isin("likely-ai", "very-likely-ai").cast("int").alias("label"))
    ends, values = detect.fit_calibration(g)
    return s.createDataFrame(list(zip(map(float, ends), map(float, values))), "breakpoint double, value double")


def word_ratios(s, d):
    w = _docs(s, d).select("doc_id", F.explode(native.tokens("text")).alias("tok")).groupBy("doc_id", "tok").agg(F.count("*").alias("n"))
    share = lambda c: F.round(F.sum(F.when(c, F.col("n")).otherwise(0)) / F.sum("n"), 6)
    return w.groupBy("doc_id").agg(
        F.round(F.count("*") / F.sum("n"), 6).alias("type_token"), share(F.col("n") == 1).alias("hapax"),
        share(F.col("tok").isin(*sorted(FUNCTION_WORDS))).alias("function_words"), share(F.col("tok").isin(*sorted(DISCOURSE_MARKERS))).alias("discourse"))


def punct_entropy(s, d):
    c = _docs(s, d).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"[!-/:-@\[-`{-~]"), F.lit(0))).alias("c")).groupBy("doc_id", "c").agg(F.count("*").alias("n"))
    t = c.groupBy("doc_id").agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log2(F.col("n").cast("double"))).alias("x"))
    return t.select("doc_id", F.round(F.abs(F.log2(F.col("t").cast("double")) - F.col("x") / F.col("t")), 6).alias("entropy"))


def lexical_embedding(s, d):
    return paraphrase.lexical_embedding(_t(s, d, "eval_items"), "item_id").select(F.col("doc_id").alias("item_id"), "bucket", F.round("weight", 6).alias("weight"))


def paraphrase_topk(s, d):
    """Queries: items whose id is divisible by 100, against all documents."""
    q = paraphrase.lexical_embedding(_t(s, d, "eval_items").where("item_id % 100 = 0"), "item_id").withColumn("doc_id", F.col("doc_id") + SHIFT)
    c = paraphrase.sparse_cosine(paraphrase.lexical_embedding(_docs(s, d)), q)
    w = Window.partitionBy("b_id").orderBy(F.round("cosine", 6).desc(), "a_id")
    c = c.withColumn("rank", F.row_number().over(w)).where("rank <= 10")
    return c.select((F.col("b_id") - SHIFT).alias("item_id"), F.col("a_id").alias("doc_id"), F.round("cosine", 6).alias("cosine"), "rank")


def paraphrase_topk_all(s, d):
    """All items against all documents. Items do not grow, so each task holds their vectors."""
    q = paraphrase.lexical_embedding(_t(s, d, "eval_items"), "item_id").toPandas()
    ids = np.unique(q["doc_id"].to_numpy(np.int64))
    m = np.zeros((paraphrase.EMBEDDING_DIM, len(ids)))
    m[q["bucket"], np.searchsorted(ids, q["doc_id"])] = q["weight"]
    held = s.sparkContext.broadcast((ids, m))

    def best(batches):
        ids, m = held.value
        for b in batches:
            v = np.zeros((len(b), len(m)))
            for i, (k, w) in enumerate(zip(b["k"], b["w"])):
                v[i, k] = w
            c, docs = np.round(v @ m, 6), b["doc_id"].to_numpy(np.int64)
            for j, item in enumerate(ids):
                o = np.lexsort((docs, -c[:, j]))[:10]
                o = o[v[o] @ m[:, j] > 0]
                yield pd.DataFrame({"item_id": item, "doc_id": docs[o], "cosine": c[o, j]})

    e = paraphrase.lexical_embedding(_docs(s, d)).groupBy("doc_id").agg(F.collect_list(F.struct("bucket", "weight")).alias("x"))
    c = e.select("doc_id", F.col("x.bucket").alias("k"), F.col("x.weight").alias("w")).mapInPandas(best, "item_id bigint, doc_id bigint, cosine double")
    w = Window.partitionBy("item_id").orderBy(F.col("cosine").desc(), "doc_id")
    return c.withColumn("rank", F.row_number().over(w)).where("rank <= 10")


def embedding_topk(s, d):
    """Queries: vectors whose id is divisible by 100, against all."""
    e = _t(s, d, "embeddings").where("embedding is not null").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    n = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    e = e.withColumn("v", F.transform("v", lambda x: x / n))
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q_id"), F.col("v").alias("q"))
    return paraphrase.best_rows(q, e, 10, "vec_id", "v").select("q_id", "vec_id", "score", "rank")


def log_softmax_rank(s, d):
    e = _t(s, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("row"), F.pmod("label", F.lit(64)).alias("target")).where("row is not null and target is not null")
    return e.select("vec_id", "target", F.round(F.get(native.log_softmax("row"), F.col("target")), 6).alias("logp"), native.rank_of("row", "target").alias("rank"))


def lm_triples(s, d):
    e = _t(s, d, "embeddings").where("embedding is not null").select("vec_id", F.array(F.transform("embedding", lambda x: x.cast("double"))).alias("rows"), F.array("label").alias("targets"), F.array(F.col("label").cast("string")).alias("names"))
    return e.select("vec_id", F.explode(native.triples("rows", "targets", "names")).alias("t")).select("vec_id", "t.token", F.round("t.logp", 6).alias("logp"), F.round("t.logr", 6).alias("logr"))


def reconstruct_abstract(s, d):
    """The inverted index of each abstract is made by grouping, then undone."""
    t = _t(s, d, "discovered").where("text is not null")
    index = _word_index(t)
    empty = F.create_map().cast("map<string,array<int>>")
    return t.select("cand_id").join(index, "cand_id", "left").select("cand_id", providers.reconstruct_abstract(F.coalesce("index", empty)).alias("abstract"))


def _word_index(t: DataFrame) -> DataFrame:
    """(cand_id, index): word -> positions of each text."""
    w = t.select("cand_id", F.posexplode(F.filter(F.split("text", r"\s+"), lambda w: w != "")).alias("i", "w")).groupBy("cand_id", "w").agg(F.collect_list("i").alias("at"))
    return w.groupBy("cand_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "at"))).alias("index"))


def openalex_payloads(s, d):
    """Records written as the provider's JSON, a payload each, and read again."""
    t = _t(s, d, "discovered").where("text is not null")
    j = t.join(_word_index(t), "cand_id", "left").select("cand_id", F.to_json(F.struct(F.array(F.struct(
        F.col("cand_id").cast("string").alias("id"), F.col("source_id").alias("doi"), "title", F.coalesce("year", F.lit(0)).alias("publication_year"), F.col("index").alias("abstract_inverted_index"),
        F.struct(F.col("open_access").alias("is_oa")).alias("open_access"))).alias("results"))).alias("payload"))
    return providers.openalex(j, keep=["cand_id"]).select("cand_id", "source_id", "title", "url", "text", "year", "open_access")


def crossref_payloads(s, d):
    t = _t(s, d, "discovered").where("text is not null")
    j = t.select("cand_id", F.to_json(F.struct(F.struct(F.array(F.struct(
        F.col("source_id").alias("DOI"), F.col("url").alias("URL"), F.array("title").alias("title"), F.regexp_replace("text", "[<>&]", " ").alias("abstract"),
        F.struct(F.array(F.array(F.coalesce("year", F.lit(0)))).alias("date-parts")).alias("issued"))).alias("items")).alias("message"))).alias("payload"))
    return providers.crossref(j, keep=["cand_id"]).select("cand_id", "source_id", "title", "url", "text", "year", "open_access")


def candidates_filtered(s, d):
    """With a set of sources left out and another number of fingerprints to share, for this call."""
    docs, items = written(_fp(_docs(s, d))), written(_fp(_far(_items(s, d))))
    c = _near(retrieve.candidates(docs, items, CFG, exclude=items.where(F.col("doc_id") % 3 == 0).select("doc_id"), min_shared=4))
    return c.select("doc_id", "item_id", F.round("est_jaccard", 6).alias("est_jaccard"), "shared", "via", "rank")


def allowlisted_runs(s, d):
    """Runs that are long enough, of sources that no list lets pass."""
    allowed = frozenset(str(i + SHIFT) for i in range(0, 10_000, 2))
    return _near(scoring.admitted(_runs(s, d), ScoringConfig(allowlist=allowed))).select("doc_id", "item_id", "q0", "q1", "s0", "s1")


def guaranteed_matches(s, d):
    """Pairs whose longest common run of tokens is at least the guaranteed length: all of them share a fingerprint."""
    r = _near(_runs(s, d)).where(F.col("q1") - F.col("q0") + 1 >= CFG.guaranteed_match_length)
    return r.groupBy("doc_id", "item_id").agg((F.max(F.col("q1") - F.col("q0")) + 1).alias("longest"))


def query_phrases(s, d):
    return _docs(s, d).select("doc_id", F.posexplode(providers.query_phrases("text")).alias("no", "phrase"))


def mask_and_refill(s, d):
    m = _t(s, d, "eval_items").select("item_id", lm.mask_spans("text").alias("m")).select("item_id", "m.masked", "m.n")
    answer = F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(F.col("n") - 1, F.lit(0))), lambda i: F.concat(F.lit("<extra_id_"), i.cast("string"), F.lit("> word"))), " ")
    return m.select("item_id", "masked", "n", lm.refill("masked", answer).alias("refilled"))


def index_stats(s, d):
    return Corpus.build(_items(s, d), cfg=CFG).stats()


def forget_document(s, d):
    c = Corpus.build(_far(_items(s, d)), cfg=CFG)
    left = c.forget(c.docs.where((F.col("doc_id") - SHIFT) % 2 == 0).select("doc_id"))
    return _near(retrieve.shared_counts(_fp(_docs(s, d)), left.docs)).groupBy("item_id").agg(F.count("*").alias("documents"), F.sum("shared").alias("shared"))


def drift(s, d):
    m = _t(s, d, "matches").select(F.col("similarity").alias("score"), F.col("matched_at").alias("scored_at")).where("scored_at is not null")
    g = score_drift(m, 0.95)
    return g.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "n", F.round("mean_score", 6).alias("mean_score"), "drifted")


def fold_text(s, d):
    f = F.pandas_udf(lambda x: x.map(lambda t: kernels.fold(t)[0], na_action="ignore"), "string")
    return _docs(s, d).select("doc_id", f("text").alias("folded"))


def sentence_spans(s, d):
    return spans.normalized(_docs(s, d)).select("doc_id", F.explode("sentences").alias("x")).select("doc_id", "x.start", "x.end")


def exclusion_spans(s, d):
    return spans.normalized(_docs(s, d)).select("doc_id", F.explode("exclusions").alias("x")).select("doc_id", "x.start", "x.end", "x.kind")


def chain_seeds(s, d):
    return _near(align.chains(retrieve.seeds(_fp(_docs(s, d)), _fp(_far(_items(s, d)))), AlignConfig().max_gap))


def stylometry_doc(s, d):
    f = detect.features(_docs(s, d))
    return f.select("doc_id", *[F.round(c, 6).alias(c) for c in detect.FEATURES], "has_likelihood")


def ai_segments(s, d):
    return detect.scored(detect.segment_features(_docs(s, d)), UNCALIBRATED).select("doc_id", "seg_no", "start", "end", "words", "score", "band")


def ai_analysis(s, d):
    return detect.analyze(_docs(s, d), CALIBRATED)


def _engine(s, d) -> Engine:
    items = _t(s, d, "eval_items").select((F.col("item_id") + SHIFT).alias("doc_id"), "text")
    e = Engine.build(items, profile=CALIBRATED)
    return replace(e, corpus=replace(e.corpus, docs=written(e.corpus.docs), meta=written(e.corpus.meta)))


def originality_check(s, d):
    r = _engine(s, d).check(_docs(s, d)).similarity
    return r.select(F.col("sub_id").alias("doc_id"), F.round("index", 6).alias("index"), "matched_words", "scorable_words", "total_words", "excluded_words")


def align_matches(s, d):
    return _near(_engine(s, d).check(_docs(s, d)).matches).select("doc_id", "item_id", "q0", "q1", "s0", "s1", "similarity", "match_type", "excluded", "exclusion_reason")


def _reports(s, d) -> DataFrame:
    e, docs = _engine(s, d), _docs(s, d)
    about = _t(s, d, "documents").select("doc_id", F.coalesce("title", F.lit("")).alias("source_name"), native.digest("text").alias("sha256"), F.lit("text/plain").alias("media_type"), F.array(F.lit(0)).alias("page_starts"))
    return report.reports(e.check(docs), e.analyze(docs), about, e.scoring, "2025-01-01T00:00:00+00:00")


def originality_report_json(s, d):
    return report.to_json(_reports(s, d))


def originality_report_html(s, d):
    return report.to_html(_reports(s, d), _docs(s, d))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return originality_check(spark, sf)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (
        tidy_text, doc_content_id, content_dedupe, html_text, strip_jats, dedupe_by_doi, page_of_span, source_labels, latest_matches, tokenize, token_offsets, dehyphenate, tag_counts,
        merge_spans, scorable_tokens, token_hash, shingle_hash, winnow_fps, fingerprint_positions, distinct_fps, minhash_signature, lsh_band_keys, lsh_candidate_pairs, pair_jaccard,
        shared_counts, seeds, candidates_top50, exact_runs, similarity_index, source_breakdown, matched_index, ai_bands, ai_document_index, review_priority, isotonic_apply, isotonic_fit,
        word_ratios, punct_entropy, lexical_embedding, paraphrase_topk, embedding_topk, log_softmax_rank, lm_triples, reconstruct_abstract, openalex_payloads, crossref_payloads, candidates_filtered, allowlisted_runs, guaranteed_matches, query_phrases, mask_and_refill, index_stats,
        forget_document, drift, fold_text, sentence_spans, exclusion_spans, chain_seeds, stylometry_doc, ai_segments, ai_analysis, originality_check, align_matches,
        originality_report_json, originality_report_html, token_offsets_docs, token_hash_docs, shingle_hash_docs, minhash_signature_docs, lsh_band_keys_docs, lsh_classes_docs,
        lsh_candidate_pairs_docs, pair_jaccard_docs, index_stats_docs, lexical_embedding_docs, mask_and_refill_docs, paraphrase_topk_all)}


# --- SQL twins ----------------------------------------------------------------------------------------

P = str(PRIME)
TOK = "list_transform(regexp_extract_all(text, '[A-Za-z0-9]+(?:''[A-Za-z]+)?'), lambda x: lower(x))"
SPACE = r"[\s\x0B\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
HASH = f"list_reduce(list_prepend(0::HUGEINT, list_transform(string_split(tok, ''), lambda c: unicode(c)::HUGEINT)), lambda h, c: (h * 31 + c) % {P})::BIGINT"


def _fps(name: str, table: str, ident: str, where: str = "true") -> str:
    """CTEs {name}_t (tokens), {name}_s (shingles), {name} (id, pos, value): winnowed fingerprints."""
    h = "tv::HUGEINT"
    for i in range(1, CFG.k):
        h = f"({h} * 257 + lead(tv, {i}) OVER w) % {P}"
    lags = [f"lag(value, {i}) OVER w" if i else "value" for i in range(CFG.w)]
    pick = " ".join(f"WHEN l{i} = m THEN pos - {i}" for i in range(CFG.w))
    return f"""
    {name}_t AS (SELECT id, (generate_subscripts(l, 1) - 1)::INTEGER AS pos, unnest(l) AS tok FROM (SELECT {ident} AS id, {TOK} AS l FROM {table} WHERE text IS NOT NULL AND {where})),
    {name}_v AS (SELECT tok, {HASH} AS tv FROM (SELECT DISTINCT tok FROM {name}_t)),
    {name}_s AS (SELECT id, pos, value FROM (SELECT id, pos, ({h})::BIGINT AS value FROM {name}_t JOIN {name}_v USING (tok) WINDOW w AS (PARTITION BY id ORDER BY pos)) WHERE value IS NOT NULL),
    {name}_l AS (SELECT id, pos, max(pos) OVER (PARTITION BY id) AS last, {", ".join(f"{x} AS l{i}" for i, x in enumerate(lags))} FROM {name}_s WINDOW w AS (PARTITION BY id ORDER BY pos)),
    {name}_m AS (SELECT *, least({", ".join(f"l{i}" for i in range(CFG.w))}) AS m FROM {name}_l WHERE pos >= least({CFG.w - 1}, last)),
    {name} AS (SELECT DISTINCT id, (CASE {pick} END)::INTEGER AS pos, m AS value FROM {name}_m)"""


def _sig(name: str, fps: str) -> str:
    a, b = kernels.permutations(CFG.n_perm, CFG.seed)
    perms = ", ".join(f"({i}, {x}, {y})" for i, (x, y) in enumerate(zip(a.tolist(), b.tolist())))
    return f"""
    {name}_p(slot, a, b) AS (VALUES {perms}),
    {name} AS (SELECT id, slot::INTEGER AS slot, min((a::HUGEINT * value + b) % {P})::BIGINT AS value FROM (SELECT DISTINCT id, value FROM {fps}) CROSS JOIN {name}_p GROUP BY id, slot)"""


def _bands(name: str, sig: str) -> str:
    _, rows = choose_bands(CFG.n_perm, CFG.threshold)
    return f"{name} AS (SELECT id, (slot // {rows})::INTEGER AS band, list(value ORDER BY slot) AS key FROM {sig} GROUP BY id, slot // {rows})"


DOCS, ITEMS = _fps("df", "documents", "doc_id"), _fps("it", "eval_items", "item_id")
SHARED = "sc AS (SELECT q.id AS doc_id, p.id AS item_id, sum(n)::BIGINT AS shared FROM (SELECT DISTINCT id, value FROM df) q JOIN (SELECT id, value, count(*) AS n FROM it GROUP BY ALL) p USING (value) GROUP BY ALL)"
SEEDS = "sd AS (SELECT q.id AS doc_id, p.id AS item_id, q.pos AS q, p.pos AS s FROM df q JOIN it p USING (value))"
RUNS = f"""{SEEDS}, ru AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, item_id, q - s ORDER BY q) AS run FROM (
    SELECT *, CASE WHEN q - lag(q) OVER (PARTITION BY doc_id, item_id, q - s ORDER BY q) <= {CFG.k} THEN 0 ELSE 1 END AS new FROM (SELECT DISTINCT * FROM sd))),
    xr AS (SELECT doc_id, item_id, min(q) AS q0, max(q) + {CFG.k - 1} AS q1, min(s) AS s0, max(s) + {CFG.k - 1} AS s1, count(*) AS seeds FROM ru GROUP BY doc_id, item_id, q - s, run)"""
COVER = "cv AS (SELECT DISTINCT doc_id, item_id, unnest(range(q0, q1 + 1)) AS pos FROM xr WHERE q1 - q0 + 1 >= 8), tot AS (SELECT doc_id, CASE WHEN text IS NULL THEN 0 ELSE len(" + TOK + ") END AS n FROM documents)"
MATCHES = """mm AS (SELECT * FROM (SELECT match_id, sub_id, source_id AS src_id, query_tokens[1] AS q0, query_tokens[2] AS q1, similarity, match_type, excluded, query_chars[1] AS c0, query_chars[2] AS c1, matched_at FROM matches WHERE query_tokens IS NOT NULL)
    QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY matched_at DESC NULLS LAST, sub_id DESC NULLS LAST, src_id DESC NULLS LAST, q0 DESC NULLS LAST, q1 DESC NULLS LAST, similarity DESC NULLS LAST, match_type DESC NULLS LAST, excluded DESC NULLS LAST, c0 DESC NULLS LAST, c1 DESC NULLS LAST) = 1)"""
RAW = "rw AS (SELECT doc_id, min(text) AS text FROM raw_docs WHERE doc_id IS NOT NULL AND text IS NOT NULL GROUP BY doc_id)"
SEGS = "sg AS (SELECT DISTINCT doc_id, seg_no, score, words, span[1] AS a, span[2] AS b FROM segments WHERE score IS NOT NULL)"
BAND = "CASE WHEN {0} < 0.20 THEN 'human' WHEN {0} < 0.75 THEN 'unclear' WHEN {0} < 0.90 THEN 'likely-ai' ELSE 'very-likely-ai' END"
PIECES = "regexp_extract_all(text, '[A-Za-z0-9]+(?:''[A-Za-z]+)?|[^A-Za-z0-9]+')"


def _offsets(table: str, ident: str) -> str:
    """CTE of (id, idx, tok, start, end) of a table's stored texts."""
    return f"""pc AS (SELECT {ident} AS id, generate_subscripts(l, 1) AS k, unnest(l) AS p FROM (SELECT {ident}, {PIECES} AS l FROM {table} WHERE text IS NOT NULL)),
    po AS (SELECT id, k, p, sum(length(p)) OVER (PARTITION BY id ORDER BY k) AS e FROM pc),
    ofs AS (SELECT id, (row_number() OVER (PARTITION BY id ORDER BY k) - 1)::INTEGER AS idx, lower(p) AS tok, (e - length(p))::INTEGER AS "start", e::INTEGER AS "end" FROM po WHERE regexp_matches(p, '^[A-Za-z0-9]'))"""


MINDEX = f"""{MATCHES}, {RAW}, tk AS (SELECT doc_id AS sub_id, len({TOK})::BIGINT AS total_words FROM rw WHERE doc_id IN (SELECT sub_id FROM mm)),
    ps AS (SELECT sub_id, unnest(range(0, total_words)) AS pos FROM tk), ex AS (SELECT DISTINCT sub_id, unnest(range(q0, q1 + 1)) AS pos FROM mm WHERE excluded),
    fr AS (SELECT * FROM ps ANTI JOIN ex USING (sub_id, pos)), co AS (SELECT DISTINCT sub_id, unnest(range(q0, q1 + 1)) AS pos FROM mm WHERE NOT excluded),
    mi AS (SELECT sub_id, CASE WHEN coalesce(s, 0) > 0 THEN round(coalesce(m, 0) / s, 6) ELSE 0.0 END::DOUBLE AS "index", coalesce(m, 0)::BIGINT AS matched_words, coalesce(s, 0)::BIGINT AS scorable_words, total_words
    FROM tk LEFT JOIN (SELECT sub_id, count(*) AS s FROM fr GROUP BY 1) USING (sub_id) LEFT JOIN (SELECT sub_id, count(*) AS m FROM co SEMI JOIN fr USING (sub_id, pos) GROUP BY 1) USING (sub_id))"""
AIDX = f"""{SEGS}, ai AS (SELECT doc_id, sum(words)::BIGINT AS covered, count(*) AS n_segments, sum(score * words) / sum(words) AS x,
    CASE WHEN count(*) >= 2 THEN 1.96 * stddev_samp(score) / sqrt(count(*)) ELSE 0.20 END AS h FROM sg WHERE words > 0 GROUP BY doc_id)"""
FNV = "list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(word, ''), lambda c: unicode(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295)"


def _embed(name: str, table: str, ident: str, where: str = "true") -> str:
    return f"""{name}_w AS (SELECT id, word, count(*) AS n FROM (SELECT {ident} AS id, unnest(regexp_split_to_array(text, '{SPACE}+')) AS word FROM {table} WHERE text IS NOT NULL AND {where}) WHERE word <> '' GROUP BY ALL),
    {name}_h AS (SELECT word, ({FNV} % 512)::INTEGER AS bucket FROM (SELECT DISTINCT word FROM {name}_w)),
    {name}_b AS (SELECT id, bucket, 1 + ln(sum(n)) AS v FROM {name}_w JOIN {name}_h USING (word) GROUP BY ALL),
    {name} AS (SELECT id, bucket, v / sqrt(sum(v * v) OVER (PARTITION BY id)) AS weight FROM {name}_b)"""


def oracle_sql() -> dict[str, str]:
    bands, rows = choose_bands(CFG.n_perm, CFG.threshold)
    iso = "CASE " + " ".join(f"WHEN score <= {b} THEN {v}" for b, v in zip(CALIBRATED.breakpoints, CALIBRATED.values)) + f" ELSE {CALIBRATED.values[-1]} END::DOUBLE"
    quote = native.INLINE_QUOTE.replace("'", "''")
    cite = native.CITATION.replace("'", "''")
    words = lambda s: ", ".join(f"'{x}'" for x in sorted(s))
    jats = "coalesce(text, '')"
    jats = f"regexp_replace({jats}, '<[^>]+>', ' ', 'g')"
    for e, c in (("&nbsp;", " "), ("&#160;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "''"), ("&#39;", "''"), ("&amp;", "&")):
        jats = f"replace({jats}, '{e}', '{c}')"
    cand = lambda items, least: f"""WITH {DOCS}, {items}, {_sig("ds", "df")}, {_sig("si", "it")}, {_bands("db", "ds")}, {_bands("ib", "si")}, {SHARED},
        lp AS (SELECT DISTINCT db.id AS doc_id, ib.id AS item_id FROM db JOIN ib ON db.band = ib.band AND db.key = ib.key),
        cn AS (SELECT coalesce(lp.doc_id, sc.doc_id) AS doc_id, coalesce(lp.item_id, sc.item_id) AS item_id, lp.doc_id IS NOT NULL AS l, coalesce(shared, 0) AS shared FROM lp FULL JOIN sc USING (doc_id, item_id)),
        ck AS (SELECT * FROM cn WHERE l OR shared >= {least}),
        ej AS (SELECT ck.doc_id, ck.item_id, sum((x.value = y.value)::INT) / {CFG.n_perm} AS est FROM ck JOIN ds x ON x.id = ck.doc_id JOIN si y ON y.id = ck.item_id AND x.slot = y.slot GROUP BY ALL)
        SELECT doc_id, item_id, round(est, 6)::DOUBLE AS est_jaccard, shared, CASE WHEN l AND shared >= {least} THEN 'both' WHEN l THEN 'lsh' ELSE 'postings' END AS via,
        (row_number() OVER (PARTITION BY doc_id ORDER BY shared DESC, est DESC, item_id))::INTEGER AS rank FROM ck JOIN ej USING (doc_id, item_id) QUALIFY rank <= {CFG.limit}"""  # noqa: E731
    sigs = f"WITH {DOCS}, {_sig('ds', 'df')}, {twins.with_sentinel('ds', 'dz', 'documents', 'doc_id', 'df')}"
    classes = """kc AS (SELECT id, list(DISTINCT value ORDER BY value)::VARCHAR AS k FROM df GROUP BY id),
        cl AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY coalesce(k, '')) AS class_id FROM documents LEFT JOIN kc ON id = doc_id)"""
    pairs = f"{sigs}, {_bands('db', 'dz')}, {classes}, rb AS (SELECT * FROM db WHERE id IN (SELECT class_id FROM cl)), cp AS (SELECT DISTINCT a.id AS a_id, b.id AS b_id FROM rb a JOIN rb b ON a.band = b.band AND a.key = b.key AND a.id < b.id)"
    return {
        "openalex_payloads": r"""WITH t AS (SELECT *, array_to_string(list_filter(regexp_split_to_array(text, '[\s\x0B]+'), lambda w: w <> ''), ' ') AS a, trim(coalesce(title, '')) AS t FROM discovered WHERE text IS NOT NULL)
            SELECT cand_id, coalesce(nullif(source_id, ''), cand_id::VARCHAR) AS source_id, t AS title, cand_id::VARCHAR AS url, CASE WHEN t <> '' THEN t || '. ' || a ELSE a END AS text, coalesce(year, 0) AS year, coalesce(open_access, false) AS open_access FROM t WHERE a <> ''""",
        "crossref_payloads": f"""WITH t AS (SELECT *, trim(regexp_replace(regexp_replace(text, '[<>&]', ' ', 'g'), '{SPACE}+', ' ', 'g')) AS a, trim(coalesce(title, '')) AS t FROM discovered WHERE text IS NOT NULL)
            SELECT cand_id, coalesce(nullif(source_id, ''), t) AS source_id, t AS title, coalesce(url, '') AS url, CASE WHEN t <> '' THEN t || '. ' || a ELSE a END AS text, coalesce(year, 0) AS year, false AS open_access FROM t WHERE a <> ''""",
        "allowlisted_runs": f"WITH {DOCS}, {ITEMS}, {RUNS} SELECT doc_id, item_id, q0, q1, s0, s1 FROM xr WHERE q1 - q0 + 1 >= 8 AND NOT (item_id < 10000 AND item_id % 2 = 0)",
        "guaranteed_matches": f"WITH {DOCS}, {ITEMS}, {RUNS} SELECT doc_id, item_id, max(q1 - q0) + 1 AS longest FROM xr WHERE q1 - q0 + 1 >= {CFG.guaranteed_match_length} GROUP BY ALL",
        "token_offsets_docs": f'WITH {_offsets("documents", "doc_id")} SELECT id AS doc_id, idx, tok, "start", "end" FROM ofs',
        "token_hash_docs": f"SELECT tok, {HASH} AS value FROM (SELECT DISTINCT unnest({TOK}) AS tok FROM documents WHERE text IS NOT NULL)",
        "shingle_hash_docs": f"WITH {DOCS} SELECT id AS doc_id, pos, value FROM df_s",
        "minhash_signature_docs": f"{sigs} SELECT id AS doc_id, slot, value FROM dz",
        "lsh_band_keys_docs": f"{sigs}, {_bands('db', 'dz')} SELECT id AS doc_id, band, key[1] AS k0, key[2] AS k1 FROM db",
        "lsh_classes_docs": f"WITH {DOCS}, {classes} SELECT doc_id, class_id FROM cl",
        "lsh_candidate_pairs_docs": f"{pairs} SELECT a_id, b_id FROM cp",
        "pair_jaccard_docs": f"""{pairs}, u AS (SELECT DISTINCT id, value FROM df WHERE id IN (SELECT class_id FROM cl)), un AS (SELECT id, count(*) AS n FROM u GROUP BY id),
            sh AS (SELECT x.id AS a_id, y.id AS b_id, count(*) AS n FROM u x JOIN u y ON x.value = y.value AND x.id < y.id GROUP BY ALL),
            ap AS (SELECT a_id, b_id FROM cp UNION SELECT a_id, b_id FROM sh JOIN un x ON x.id = a_id JOIN un y ON y.id = b_id WHERE sh.n / (x.n + y.n - sh.n) >= {CFG.threshold}),
            v AS (SELECT id, list(DISTINCT value) AS vs FROM df GROUP BY id), e AS (SELECT a_id, b_id, sum((x.value = y.value)::INT) / {CFG.n_perm} AS est FROM ap JOIN dz x ON x.id = a_id JOIN dz y ON y.id = b_id AND x.slot = y.slot GROUP BY ALL)
            SELECT a_id, b_id, round(est, 6)::DOUBLE AS estimated, round(len(list_intersect(x.vs, y.vs)) / len(list_distinct(list_concat(x.vs, y.vs))), 6)::DOUBLE AS exact FROM e JOIN v x ON x.id = a_id JOIN v y ON y.id = b_id""",
        "index_stats_docs": f"""{sigs}, {_bands('db', 'dz')} SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(DISTINCT value) FROM df) AS distinct_fingerprints, (SELECT count(*) FROM (SELECT DISTINCT band, key FROM db)) AS buckets,
            {bands}::INTEGER AS bands, {rows}::INTEGER AS rows, {round((1 / bands) ** (1 / rows), 4)}::DOUBLE AS lsh_knee, {CFG.min_shared}::INTEGER AS min_shared""",
        "lexical_embedding_docs": f"WITH {_embed('e', 'documents', 'doc_id')} SELECT id AS doc_id, bucket, round(weight, 6) AS weight FROM e",
        "paraphrase_topk_all": f"""WITH {_embed('e', 'eval_items', 'item_id')}, {_embed('d', 'documents', 'doc_id')}, c AS (SELECT e.id AS item_id, d.id AS doc_id, round(sum(e.weight * d.weight), 6) AS cosine FROM e JOIN d USING (bucket) GROUP BY ALL)
            SELECT item_id, doc_id, cosine, (row_number() OVER (PARTITION BY item_id ORDER BY cosine DESC, doc_id))::INTEGER AS rank FROM c QUALIFY rank <= 10""",
        "stylometry_doc": twins.stylometry(SPACE, list(detect.LIKELIHOOD)),
        "fold_text": twins.fold_text(),
        "sentence_spans": twins.sentence_spans(SPACE),
        "query_phrases": twins.query_phrases(),
        "chain_seeds": twins.chain_seeds(DOCS, ITEMS, SEEDS),
        "isotonic_fit": twins.ISOTONIC_FIT,
        "lm_triples": twins.LM_TRIPLES,
        "tidy_text": rf"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t\x0B\f\r]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '\A{SPACE}+|{SPACE}+\z', '', 'g') AS tidy FROM documents",
        "doc_content_id": "SELECT doc_id, 'sha256:' || substr(sha256(text), 1, 24) AS content_id, sha256(text) AS sha256 FROM documents",
        "content_dedupe": "SELECT 'sha256:' || substr(sha256(text), 1, 24) AS content_id, min(doc_id) AS first_doc, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1",
        "html_text": r"SELECT cand_id, regexp_replace(regexp_replace(text, '(?is)<script\b.*?</script>|<style\b.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g') AS plain FROM discovered",
        "strip_jats": f"SELECT cand_id, trim(regexp_replace({jats}, '{SPACE}+', ' ', 'g')) AS plain FROM discovered",
        "dedupe_by_doi": "SELECT replace(lower(source_id), 'https://doi.org/', '') AS doi, cand_id, provider FROM discovered QUALIFY row_number() OVER (PARTITION BY replace(lower(source_id), 'https://doi.org/', '') ORDER BY found_at NULLS FIRST, cand_id) = 1",
        "page_of_span": """WITH p AS (SELECT doc_id, max(page_starts) AS ps FROM raw_docs WHERE doc_id IS NOT NULL GROUP BY 1), g AS (SELECT DISTINCT doc_id, seg_no, span[1] AS offset_at FROM segments WHERE span IS NOT NULL)
            SELECT doc_id, seg_no, offset_at, greatest(1, coalesce(nullif(list_position(list_transform(ps, lambda x: x > offset_at), true), 0) - 1, len(ps), 1))::INTEGER AS page, greatest(1, coalesce(len(ps), 1))::INTEGER AS n_pages FROM g JOIN p USING (doc_id)""",
        "source_labels": """SELECT doc_id, coalesce(nullif(title, ''), nullif(url, ''), doc_id) AS label, kind FROM source_meta WHERE doc_id IS NOT NULL
            QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY indexed_at DESC NULLS LAST, title DESC NULLS LAST, url DESC NULLS LAST, kind DESC NULLS LAST, year DESC NULLS LAST) = 1""",
        "latest_matches": f"WITH {MATCHES} SELECT match_id, sub_id, src_id, q0, q1, similarity, excluded FROM mm",
        "tokenize": f"SELECT doc_id, (generate_subscripts(l, 1) - 1)::INTEGER AS idx, unnest(l) AS tok FROM (SELECT doc_id, {TOK} AS l FROM documents WHERE text IS NOT NULL)",
        "token_offsets": f'WITH {_offsets("eval_items", "item_id")} SELECT id AS item_id, idx, tok, "start", "end" FROM ofs',
        "dehyphenate": r"SELECT raw_id, regexp_replace(text, '-[ \t]*\r?\n[ \t]*([a-z])', '\1', 'g') AS joined FROM raw_docs",
        "tag_counts": f"SELECT doc_id, len(regexp_extract_all(text, '{quote}'))::INTEGER AS quotes, len(regexp_extract_all(text, '{cite}'))::INTEGER AS citations FROM documents WHERE text IS NOT NULL",
        "merge_spans": """WITH s AS (SELECT DISTINCT doc_id, band, span[1] AS a, span[2] AS b FROM segments WHERE doc_id IS NOT NULL AND band IS NOT NULL AND span[1] IS NOT NULL AND span[2] IS NOT NULL),
            n AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY doc_id, band ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM s),
            r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, band ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS run FROM n)
            SELECT doc_id, band, min(a) AS "start", max(b) AS "end" FROM r GROUP BY doc_id, band, run""",
        "scorable_tokens": f"""WITH {MATCHES}, {RAW}, x AS (SELECT DISTINCT sub_id AS doc_id, c0, c1 FROM mm WHERE excluded AND c0 IS NOT NULL), rx AS (SELECT * FROM rw WHERE doc_id IN (SELECT doc_id FROM x)), {_offsets("rx", "doc_id")}
            SELECT id AS doc_id, count(*) AS scorable FROM ofs WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.doc_id = ofs.id AND x.c0 < ofs."end" AND ofs."start" < x.c1) GROUP BY id""",
        "token_hash": f"SELECT tok, {HASH} AS value FROM (SELECT DISTINCT unnest({TOK}) AS tok FROM eval_items WHERE text IS NOT NULL)",
        "shingle_hash": f"WITH {ITEMS} SELECT id AS item_id, pos, value FROM it_s",
        "winnow_fps": f"WITH {DOCS} SELECT id AS doc_id, pos, value FROM df",
        "fingerprint_positions": f"WITH {DOCS} SELECT id AS doc_id, value, count(*) AS n, min(pos) AS first_pos FROM df GROUP BY id, value HAVING count(*) > 1",
        "distinct_fps": f"WITH {DOCS} SELECT doc_id, CASE WHEN text IS NULL THEN 0 ELSE len({TOK}) END::INTEGER AS n_tokens, coalesce(n, 0)::INTEGER AS n_values FROM documents LEFT JOIN (SELECT id, count(DISTINCT value) AS n FROM df GROUP BY id) ON id = doc_id",
        "minhash_signature": f"WITH {ITEMS}, {_sig('si', 'it')} SELECT id AS item_id, slot, value FROM si",
        "lsh_band_keys": f"WITH {ITEMS}, {_sig('si', 'it')}, {_bands('ib', 'si')} SELECT id AS item_id, band, key[1] AS k0, key[2] AS k1 FROM ib",
        "lsh_candidate_pairs": f"WITH {ITEMS}, {_sig('si', 'it')}, {_bands('ib', 'si')} SELECT DISTINCT a.id AS a_id, b.id AS b_id FROM ib a JOIN ib b ON a.band = b.band AND a.key = b.key AND a.id < b.id",
        "pair_jaccard": f"""WITH {ITEMS}, {_sig('si', 'it')}, {_bands('ib', 'si')}, p AS (SELECT DISTINCT a.id AS a_id, b.id AS b_id FROM ib a JOIN ib b ON a.band = b.band AND a.key = b.key AND a.id < b.id),
            v AS (SELECT id, list(DISTINCT value) AS vs FROM it GROUP BY id), e AS (SELECT a_id, b_id, sum((x.value = y.value)::INT) / {CFG.n_perm} AS est FROM p JOIN si x ON x.id = a_id JOIN si y ON y.id = b_id AND x.slot = y.slot GROUP BY ALL)
            SELECT a_id, b_id, round(est, 6)::DOUBLE AS estimated, round(len(list_intersect(x.vs, y.vs)) / len(list_distinct(list_concat(x.vs, y.vs))), 6)::DOUBLE AS exact FROM e JOIN v x ON x.id = a_id JOIN v y ON y.id = b_id""",
        "shared_counts": f"WITH {DOCS}, {ITEMS}, {SHARED} SELECT doc_id, item_id, shared FROM sc",
        "seeds": f"WITH {DOCS}, {ITEMS}, {SEEDS} SELECT doc_id, item_id, q, s FROM sd",
        "candidates_top50": cand(ITEMS, CFG.min_shared),
        "candidates_filtered": cand(_fps("it", "eval_items", "item_id", f"(item_id + {SHIFT}) % 3 <> 0"), 4),
        "exact_runs": f"WITH {DOCS}, {ITEMS}, {RUNS} SELECT doc_id, item_id, q0, q1, s0, s1, seeds FROM xr",
        "similarity_index": f"""WITH {DOCS}, {ITEMS}, {RUNS}, {COVER}, m AS (SELECT doc_id, count(DISTINCT pos) AS m FROM cv GROUP BY 1)
            SELECT doc_id, CASE WHEN n > 0 THEN round(coalesce(m, 0) / n, 6) ELSE 0.0 END::DOUBLE AS "index", coalesce(m, 0)::BIGINT AS matched_words, n::BIGINT AS scorable_words FROM tot LEFT JOIN m USING (doc_id)""",
        "source_breakdown": f"""WITH {DOCS}, {ITEMS}, {RUNS}, {COVER}, w AS (SELECT doc_id, item_id, count(*) AS words FROM cv GROUP BY ALL),
            o AS (SELECT doc_id, pos, item_id FROM cv JOIN w USING (doc_id, item_id) QUALIFY row_number() OVER (PARTITION BY doc_id, pos ORDER BY words DESC, item_id) = 1),
            u AS (SELECT doc_id, item_id, count(*) AS u FROM o GROUP BY ALL)
            SELECT doc_id, item_id, words, coalesce(u, 0)::BIGINT AS unique_words, round(coalesce(u, 0) / n, 6)::DOUBLE AS share,
            (row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(u, 0) DESC, words DESC, item_id))::INTEGER AS rank FROM w LEFT JOIN u USING (doc_id, item_id) JOIN tot USING (doc_id)""",
        "matched_index": f"WITH {MINDEX} SELECT * FROM mi",
        "ai_bands": f"WITH {SEGS} SELECT doc_id, seg_no, a, score, {BAND.format('score')} AS band FROM sg",
        "ai_document_index": f'WITH {AIDX} SELECT doc_id, covered, n_segments, round(x, 6) AS "index", round(h, 6) AS half, {BAND.format("x")} AS band FROM ai',
        "review_priority": f"""WITH {MINDEX}, {AIDX}, j AS (SELECT doc_id, coalesce("index", 0.0) AS similarity, round(x, 6) AS ai, {BAND.format("x")} AS band FROM ai LEFT JOIN mi ON sub_id = doc_id)
            SELECT doc_id, similarity, ai, CASE WHEN similarity >= 0.30 OR (band IN ('likely-ai', 'very-likely-ai') AND similarity >= 0.10) THEN 'read-first' WHEN similarity >= 0.15 OR ai >= 0.75 THEN 'worth-a-look' ELSE 'no-flags' END AS priority FROM j""",
        "isotonic_apply": f"WITH {SEGS} SELECT doc_id, seg_no, a, {iso} AS calibrated FROM sg",
        "word_ratios": f"""WITH w AS (SELECT doc_id, tok, count(*) AS n FROM (SELECT doc_id, unnest({TOK}) AS tok FROM documents WHERE text IS NOT NULL) GROUP BY ALL)
            SELECT doc_id, round(count(*) / sum(n), 6)::DOUBLE AS type_token, round(sum(CASE WHEN n = 1 THEN n ELSE 0 END) / sum(n), 6)::DOUBLE AS hapax,
            round(sum(CASE WHEN tok IN ({words(FUNCTION_WORDS)}) THEN n ELSE 0 END) / sum(n), 6)::DOUBLE AS function_words, round(sum(CASE WHEN tok IN ({words(DISCOURSE_MARKERS)}) THEN n ELSE 0 END) / sum(n), 6)::DOUBLE AS discourse FROM w GROUP BY doc_id""",
        "punct_entropy": r"""WITH c AS (SELECT doc_id, c, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[!-/:-@\[-`{-~]')) AS c FROM documents WHERE text IS NOT NULL) GROUP BY ALL), t AS (SELECT doc_id, sum(n) AS t, sum(n * log2(n)) AS x FROM c GROUP BY 1)
            SELECT doc_id, round(abs(log2(t) - x / t), 6)::DOUBLE AS entropy FROM t""",
        "lexical_embedding": f"WITH {_embed('e', 'eval_items', 'item_id')} SELECT id AS item_id, bucket, round(weight, 6) AS weight FROM e",
        "paraphrase_topk": f"""WITH {_embed('e', 'eval_items', 'item_id', 'item_id % 100 = 0')}, {_embed('d', 'documents', 'doc_id')}, c AS (SELECT e.id AS item_id, d.id AS doc_id, round(sum(e.weight * d.weight), 6) AS cosine FROM e JOIN d USING (bucket) GROUP BY ALL)
            SELECT item_id, doc_id, cosine, (row_number() OVER (PARTITION BY item_id ORDER BY cosine DESC, doc_id))::INTEGER AS rank FROM c QUALIFY rank <= 10""",
        "embedding_topk": """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE embedding IS NOT NULL),
            c AS (SELECT q.vec_id AS q_id, b.vec_id, round(list_dot_product(q.v, b.v) / sqrt(list_dot_product(q.v, q.v)) / sqrt(list_dot_product(b.v, b.v)), 6) AS score FROM e q JOIN e b ON q.vec_id <> b.vec_id WHERE q.vec_id % 100 = 0)
            SELECT q_id, vec_id, score, (row_number() OVER (PARTITION BY q_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM c QUALIFY rank <= 10""",
        "log_softmax_rank": """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS r, label % 64 AS t FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL)
            SELECT vec_id, t AS target, round(r[t + 1] - list_max(r) - ln(list_sum(list_transform(r, lambda x: exp(x - list_max(r))))), 6) AS logp, (1 + len(list_filter(r, lambda x: x > r[t + 1])))::INTEGER AS rank FROM e""",
        "reconstruct_abstract": r"SELECT cand_id, array_to_string(list_filter(regexp_split_to_array(text, '[\s\x0B]+'), lambda w: w <> ''), ' ') AS abstract FROM discovered WHERE text IS NOT NULL",
        "index_stats": f"""WITH {ITEMS}, {_sig('si', 'it')}, {_bands('ib', 'si')} SELECT (SELECT count(*) FROM eval_items) AS documents, (SELECT count(DISTINCT value) FROM it) AS distinct_fingerprints, (SELECT count(*) FROM (SELECT DISTINCT band, key FROM ib)) AS buckets,
            {bands}::INTEGER AS bands, {rows}::INTEGER AS rows, {round((1 / bands) ** (1 / rows), 4)}::DOUBLE AS lsh_knee, {CFG.min_shared}::INTEGER AS min_shared""",
        "forget_document": f"WITH {DOCS}, {_fps('it', 'eval_items', 'item_id', 'item_id % 2 <> 0')}, {SHARED} SELECT item_id, count(*) AS documents, sum(shared)::BIGINT AS shared FROM sc GROUP BY item_id",
        "drift": "SELECT strftime(matched_at, '%Y-%m-%d') AS day, count(*) AS n, round(avg(similarity), 6) AS mean_score, abs(avg(similarity) - 0.95) > 0.05 AS drifted FROM matches WHERE matched_at IS NOT NULL AND similarity IS NOT NULL GROUP BY 1",
    }
