"""The engine: many submissions against a corpus in one plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.config import PRIME, PROFILES, AlignConfig, DetectorProfile, FingerprintConfig, ScoringConfig
from palimpsest.functions import kernels, native
from palimpsest.operators import align, detect, paraphrase, retrieve, scoring, spans
from palimpsest.operators.corpus import Corpus
from palimpsest.operators.cut import written
from palimpsest.sources import files


@dataclass(frozen=True)
class Checked:
    """matches, similarity and by_source of a batch of submissions."""

    matches: DataFrame
    similarity: DataFrame
    by_source: DataFrame
    submissions: DataFrame


@dataclass(frozen=True)
class Engine:
    corpus: Corpus
    alignment: AlignConfig = AlignConfig()
    scoring: ScoringConfig = ScoringConfig()
    profile: DetectorProfile = PROFILES["uncalibrated"]
    model: Callable[[], object] | None = None

    @classmethod
    def build(cls, raw: DataFrame, meta: DataFrame | None = None, cfg: FingerprintConfig = FingerprintConfig(), ident: str = "doc_id", text: str = "text", **settings) -> Engine:
        return cls(Corpus.build(raw, meta, cfg, ident, text), **settings)

    @classmethod
    def load(cls, spark: SparkSession, path: str, **settings) -> Engine:
        return cls(Corpus.load(spark, path), **settings)

    def save(self, path: str) -> None:
        self.corpus.save(path)

    def add(self, raw: DataFrame, meta: DataFrame | None = None, on_duplicate: str = "append", kind: str = "corpus") -> Engine:
        return replace(self, corpus=self.corpus.append(raw, meta, on_duplicate, kind=kind))

    def add_dir(self, spark: SparkSession, root: str) -> Engine:
        return self.add(files.load_dir(spark, root))

    def forget(self, ids: DataFrame) -> Engine:
        return replace(self, corpus=self.corpus.forget(ids))

    def check(self, submissions: DataFrame, ident: str = "doc_id", text: str = "text", cut: Callable[[DataFrame], DataFrame] = written, exclude: DataFrame | None = None, min_shared: int | None = None) -> Checked:
        """All submissions at once. `cut` ends the plan where a part is used again; pass the identity to keep one lazy plan.

        exclude(doc_id): sources left out; min_shared: fingerprints a candidate must share, other than the index's own.
        """
        cfg = self.corpus.cfg
        subs = cut(spans.prepared(submissions, cfg, ident, text, self.scoring.kinds))
        docs = self.corpus.docs  # load() gives a table; a corpus built in memory is computed where it is used
        cand = cut(retrieve.candidates(subs, docs, cfg, exclude, min_shared, self.corpus.inverted, empty=False))
        found = align.located(cand, subs, docs, cfg, self.alignment)
        label = self.corpus.meta.select(F.col("doc_id").alias("src_id"), native.source_label("title", "url", "doc_id").alias("source_label"))
        held = cut(scoring.judged(scoring.admitted(found, self.scoring), self.scoring).join(label, "src_id", "left"))
        m = held.drop("lost")
        sizes = cut(subs.groupBy(F.col("doc_id").alias("sub_id")).agg(F.first(F.struct(F.col("n_tokens").alias("total_words"), (F.col("n_tokens") - F.size("lost")).alias("scorable_words"))).alias("x")).select("sub_id", "x.*"))
        # positions of a match that do not count are kept beside it, so what is covered needs no join
        cover = cut(scoring.covered(held))
        return Checked(m, scoring.similarity_index(cover, sizes), scoring.breakdown(m, cover, sizes), submissions)

    def analyze(self, submissions: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
        return detect.analyze(submissions, self.profile, ident, text, self.model)

    def paraphrases(self, submissions: DataFrame, sources: DataFrame, k: int = 10, embedder: Callable[[], paraphrase.Embedder] | None = None, ident: str = "doc_id", text: str = "text") -> DataFrame:
        """(doc_id, src_id, score, rank): the k sources whose embeddings are nearest to each submission's. embedder makes the embedder in the worker; lexical if not given."""
        return paraphrase.nearest(submissions, sources, k, embedder, ident, text)

    def check_and_add(self, submissions: DataFrame, **kw) -> tuple[Checked, Engine]:
        """Scored against the corpus as it is, then added as student papers."""
        return self.check(submissions, **kw), self.add(submissions, on_duplicate="ignore", kind="student")


def quick_ai_check(texts: DataFrame, ident: str = "doc_id", text: str = "text", min_words: int = 25) -> DataFrame:
    """The writing index alone, of texts with at least min_words tokens."""
    return detect.analyze(texts.where(F.size(native.tokens(text)) >= min_words), PROFILES["hc3-style-v1"], ident, text)


def register(spark: SparkSession) -> None:
    """SQL functions: fold_text, token_hash, fnv1a32, band_for; the table functions tokenize(text) and align_texts(submission, source)."""
    from pyspark.sql import types as T

    spark.udf.register("fold_text", F.pandas_udf(lambda s: s.map(lambda t: kernels.fold(t)[0], na_action="ignore"), T.StringType()))
    letters = "filter(split(word, ''), c -> c <> '')"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION token_hash(word STRING) RETURNS BIGINT RETURN CAST(aggregate({letters}, CAST(0 AS DECIMAL(38, 0)), (h, c) -> CAST((h * 31 + ascii(c)) % {PRIME} AS DECIMAL(38, 0))) AS BIGINT)")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION fnv1a32(word STRING) RETURNS BIGINT RETURN aggregate({letters}, 2166136261L, (h, c) -> ((h ^ CAST(ascii(c) AS BIGINT)) * 16777619L) & 4294967295L)")
    from pyspark.sql.functions import udtf

    @udtf(returnType="idx int, tok string, start int, end int")
    class Tokenize:
        def eval(self, text: str):
            if text is not None:
                n = kernels.normalize(text)
                for i, (w, (s, e)) in enumerate(zip(n.words, n.spans)):
                    yield i, w, s, e

    @udtf(returnType="q0 int, q1 int, s0 int, s1 int, similarity double, match_type string")
    class Align:
        def eval(self, submission: str, source: str):
            if submission is None or source is None:
                return
            cfg = FingerprintConfig()
            a, b = kernels.normalize(submission).words, kernels.normalize(source).words
            (pa, va, _), (pb, vb, _) = kernels.fingerprint(a, cfg), kernels.fingerprint(b, cfg)
            where: dict[int, list[int]] = {}
            for p, v in zip(pb.tolist(), vb.tolist()):
                where.setdefault(v, []).append(p)
            seeds = [(q, s) for q, v in zip(pa.tolist(), va.tolist()) for s in where.get(v, ())]
            for q0, q1, s0, s1, sim in kernels.align([(a, b, seeds)], cfg.k, AlignConfig())[0]:
                yield int(q0), int(q1), int(s0), int(s1), float(sim), "verbatim" if sim >= 0.98 else "near-duplicate"

    spark.udtf.register("align_texts", Align)
    spark.udtf.register("tokenize", Tokenize)
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION band_for(score DOUBLE) RETURNS STRING RETURN CASE WHEN score < 0.20 THEN 'human' WHEN score < 0.75 THEN 'unclear' WHEN score < 0.90 THEN 'likely-ai' WHEN score IS NOT NULL THEN 'very-likely-ai' END")
