"""Fingerprint tables of a corpus: building, appending, forgetting, saving, loading, statistics."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.config import FingerprintConfig
from palimpsest.functions import kernels

FINGERPRINT = "n_tokens int, tokens array<string>, pos array<int>, value array<bigint>, sig array<bigint>"


def choose_bands(n_perm: int, threshold: float) -> tuple[int, int]:
    """(bands, rows): the exact split of the signature whose collision curve rises nearest the threshold, fewest rows on ties."""
    splits = [(n_perm // r, r) for r in range(1, n_perm + 1) if n_perm % r == 0]
    return min(splits, key=lambda s: abs((1 / s[0]) ** (1 / s[1]) - threshold))


def fingerprints(docs: DataFrame, cfg: FingerprintConfig, ident: str = "doc_id", text: str = "text", tokens: bool = True) -> DataFrame:
    """(doc_id, n_tokens, tokens, pos, value, sig) of each row. Null text counts as empty: no tokens, sentinel signature. Repeated ids stay repeated rows."""
    kind = docs.schema[ident].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, t in zip(b["_id"], b["_t"]):
                words = [] if not t else kernels.normalize(t).words if cfg.normalize else kernels.stored_words(t)
                pos, value, sig = kernels.fingerprint(words, cfg)
                rows.append((i, len(words), words if tokens else None, pos.astype("int32"), value, sig))
            yield pd.DataFrame(rows, columns=["doc_id", "n_tokens", "tokens", "pos", "value", "sig"])

    return docs.select(F.col(ident).alias("_id"), F.col(text).alias("_t")).mapInPandas(run, f"doc_id {kind}, {FINGERPRINT}")


def postings(fp: DataFrame) -> DataFrame:
    """(doc_id, pos, value), a row for each selected shingle."""
    return fp.select("doc_id", F.explode(F.arrays_zip("pos", "value")).alias("x")).select("doc_id", F.col("x.pos").alias("pos"), F.col("x.value").alias("value"))


def counted(fp: DataFrame) -> DataFrame:
    """(value, doc_id, n): the inverted index, how often each document has each value."""
    return postings(fp).groupBy("value", "doc_id").agg(F.count("*").alias("n"))


def lsh(sig: DataFrame, cfg: FingerprintConfig) -> DataFrame:
    """(doc_id, band, key): the bands of each signature, keys as arrays."""
    bands, rows = choose_bands(cfg.n_perm, cfg.threshold)
    keys = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.struct(b.alias("band"), F.slice("sig", b * rows + 1, rows).alias("key")))
    return sig.select("doc_id", F.explode(keys).alias("x")).select("doc_id", F.col("x.band").alias("band"), F.col("x.key").alias("key"))


@dataclass(frozen=True)
class Corpus:
    """docs(doc_id, n_tokens, tokens, pos, value, sig), meta(doc_id, title, author, url, kind, year, n_tokens) and, once saved, inverted(value, doc_id, n)."""

    docs: DataFrame
    meta: DataFrame
    cfg: FingerprintConfig
    inverted: DataFrame | None = None

    @classmethod
    def build(cls, raw: DataFrame, meta: DataFrame | None = None, cfg: FingerprintConfig = FingerprintConfig(), ident: str = "doc_id", text: str = "text") -> Corpus:
        docs = fingerprints(raw, cfg, ident, text)
        return cls(docs, _meta(docs, _own_meta(raw, ident, "corpus") if meta is None else meta), cfg)

    def append(self, raw: DataFrame, meta: DataFrame | None = None, on_duplicate: str = "append", ident: str = "doc_id", text: str = "text", cfg: FingerprintConfig | None = None, kind: str = "corpus") -> Corpus:
        """With 'append' a known id gets its postings once more (its metadata are replaced); with 'ignore' it stays as it is."""
        if (cfg or self.cfg) != self.cfg:
            raise ValueError(f"fingerprints made with {cfg} cannot enter an index made with {self.cfg}")
        new = fingerprints(raw, self.cfg, ident, text)
        if on_duplicate == "ignore":
            new = new.join(self.docs.select("doc_id").distinct(), "doc_id", "left_anti")
        elif on_duplicate != "append":
            raise ValueError("on_duplicate is 'append' or 'ignore'")
        fresh = _meta(new, _own_meta(raw, ident, kind) if meta is None else meta)
        inv = None if self.inverted is None else self.inverted.unionByName(counted(new)).groupBy("value", "doc_id").agg(F.sum("n").alias("n"))
        return replace(self, inverted=inv, docs=self.docs.unionByName(new), meta=self.meta.join(fresh.select("doc_id"), "doc_id", "left_anti").unionByName(fresh))

    def forget(self, ids: DataFrame) -> Corpus:
        """Without the documents of ids(doc_id)."""
        gone = ids.select("doc_id").distinct()
        inv = None if self.inverted is None else self.inverted.join(gone, "doc_id", "left_anti")
        return replace(self, inverted=inv, docs=self.docs.join(gone, "doc_id", "left_anti"), meta=self.meta.join(gone, "doc_id", "left_anti"))

    def stats(self) -> DataFrame:
        """One row: documents, distinct_fingerprints, buckets, bands, rows, lsh_knee, min_shared."""
        bands, rows = choose_bands(self.cfg.n_perm, self.cfg.threshold)
        parts = {
            "documents": self.docs.select("doc_id").distinct(), "distinct_fingerprints": postings(self.docs).select("value").distinct(),
            "buckets": lsh(self.docs, self.cfg).select("band", F.xxhash64("key")).distinct()}
        each = [d.agg(*[F.count("*").alias(n) if n == name else F.lit(0).cast("bigint").alias(n) for n in parts]) for name, d in parts.items()]
        return each[0].unionByName(each[1]).unionByName(each[2]).agg(*[F.sum(n).alias(n) for n in parts]).select(
            "documents", "distinct_fingerprints", "buckets", F.lit(bands).alias("bands"), F.lit(rows).alias("rows"),
            F.lit(round((1 / bands) ** (1 / rows), 4)).alias("lsh_knee"), F.lit(self.cfg.min_shared).alias("min_shared"))

    def save(self, path: str) -> None:
        self.docs.write.mode("overwrite").parquet(f"{path}/docs")
        # in order of the values, so a check of few of them reads few row groups
        inv = counted(self.docs.sparkSession.read.parquet(f"{path}/docs")) if self.inverted is None else self.inverted
        inv.repartitionByRange("value").sortWithinPartitions("value").write.mode("overwrite").parquet(f"{path}/inverted")
        self.meta.write.mode("overwrite").parquet(f"{path}/meta")
        spark = self.docs.sparkSession
        spark.createDataFrame([(json.dumps(asdict(self.cfg)),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/config")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Corpus:
        cfg = FingerprintConfig(**json.loads(spark.read.text(f"{path}/config").first()[0]))
        docs = spark.read.parquet(f"{path}/docs")
        try:
            inverted = spark.read.parquet(f"{path}/inverted")
        except Exception as e:  # an index of before postings were stored
            if "PATH_NOT_FOUND" not in str(e):
                raise
            inverted = None
        return cls(docs, spark.read.parquet(f"{path}/meta"), cfg, inverted)


META = {"title": "string", "author": "string", "url": "string", "kind": "string", "year": "int"}


def _own_meta(raw: DataFrame, ident: str, kind: str) -> DataFrame:
    """Metadata of documents that come without: their file's name as the title, if they have one."""
    title = F.coalesce("source_name", F.lit("")) if "source_name" in raw.columns else F.lit("")
    return raw.select(F.col(ident).alias("doc_id"), title.alias("title"), F.lit("").alias("author"), F.lit("").alias("url"), F.lit(kind).alias("kind"), F.lit(None).cast("int").alias("year"))


def _meta(docs: DataFrame, meta: DataFrame) -> DataFrame:
    """One row a document; of several rows of metadata the latest indexed."""
    sizes = docs.groupBy("doc_id").agg(F.max("n_tokens").alias("n_tokens"))
    return latest(meta.select("doc_id", *META, *[c for c in ("indexed_at",) if c in meta.columns]), ["doc_id"], "indexed_at").drop("indexed_at").join(sizes, "doc_id")


def latest(df: DataFrame, keys: list[str], time: str) -> DataFrame:
    """One row a key, the one of the latest time; among those of one time the greatest row. Pre-aggregated before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    order = ([time] if time in rest else []) + [c for c in rest if c != time]
    best = df.groupBy(*keys).agg(F.max(F.struct(*order)).alias("_x"))
    return best.select(*keys, *[F.col(f"_x.{c}").alias(c) for c in rest])
