"""Spans of a document: merging, the tokens they leave scorable, tags in the text."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.config import FingerprintConfig
from palimpsest.functions import kernels
from palimpsest.operators.corpus import FINGERPRINT

EXCLUSIONS = "array<struct<start:int,end:int,kind:string>>"
NORMALIZED = "text string, tokens array<struct<tok:string,start:int,end:int>>, sentences array<struct<start:int,end:int>>, exclusions " + EXCLUSIONS


def normalized(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text folded, tokens, sentences, exclusions); offsets point into the stored text. Null text counts as empty."""
    kind = docs.schema[ident].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, t in zip(b["_id"], b["_t"]):
                n = kernels.normalize(t or "")
                rows.append((i, n.text, [{"tok": w, "start": s, "end": e} for w, (s, e) in zip(n.words, n.spans)],
                             [{"start": s, "end": e} for s, e in n.sentences], [{"start": s, "end": e, "kind": k} for s, e, k in n.exclusions]))
            yield pd.DataFrame(rows, columns=["doc_id", "text", "tokens", "sentences", "exclusions"])

    return docs.select(F.col(ident).alias("_id"), F.col(text).alias("_t")).mapInPandas(run, f"doc_id {kind}, {NORMALIZED}")


def prepared(docs: DataFrame, cfg: FingerprintConfig, ident: str = "doc_id", text: str = "text", kinds: Sequence[str] = ()) -> DataFrame:
    """As corpus.fingerprints(), plus gaps, exclusions and lost, from one pass over each text.

    gaps: starts and ends of the tokens in the stored text, in turn, each as the distance to the one before; small numbers,
    which files and shuffles squeeze. lost: positions of the tokens that overlap an exclusion of the given kinds. Texts go
    on in parts of 500, so a worker holds no more of them at once.
    """
    kind = docs.schema[ident].dataType.simpleString()

    def row(i, t: str) -> tuple:
        n = kernels.normalize(t)
        words, places = (n.words, n.spans) if cfg.normalize else ([], [])
        if not cfg.normalize:
            for m in kernels.TOKEN.finditer(t):
                words.append(m[0].lower())
                places.append(m.span())
        pos, value, sig = kernels.fingerprint(words, cfg)
        at = np.array(places, np.int32).reshape(-1, 2)
        out = np.zeros(len(at), bool)
        for s, e, k in n.exclusions:
            if k in kinds:
                out |= (s < at[:, 1]) & (at[:, 0] < e)
        return (i, len(words), words, pos.astype("int32"), value, sig, np.diff(at.ravel(), prepend=np.int32(0)),
                [{"start": s, "end": e, "kind": k} for s, e, k in n.exclusions], np.flatnonzero(out).astype("int32"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 500):
                rows = [row(i, t or "") for i, t in zip(b["_id"][at:at + 500], b["_t"][at:at + 500])]
                yield pd.DataFrame(rows, columns=["doc_id", "n_tokens", "tokens", "pos", "value", "sig", "gaps", "exclusions", "lost"])

    return docs.select(F.col(ident).alias("_id"), F.col(text).alias("_t")).mapInPandas(run, f"doc_id {kind}, {FINGERPRINT}, gaps array<int>, exclusions {EXCLUSIONS}, lost array<int>")


def merge_spans(spans: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, start, end): spans of one key that overlap or touch become one."""
    before = Window.partitionBy(*keys).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*keys).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = spans.select(*keys, "start", "end").where("start is not null and end is not null").distinct()
    s = s.withColumn("new", F.when(F.col("start") <= F.max("end").over(before), 0).otherwise(1)).withColumn("run", F.sum("new").over(upto))
    return s.groupBy(*keys, "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("run")


def token_offsets(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, idx, tok, start, end) of the stored text in code points; one pass over each text, whatever its length."""
    kind = T.ArrayType(T.StructType([T.StructField("tok", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    found = F.pandas_udf(lambda s: s.map(lambda t: [{"tok": m[0].lower(), "start": m.start(), "end": m.end()} for m in kernels.TOKEN.finditer(t)]), kind)
    return docs.where(F.col(text).isNotNull()).select(F.col(ident).alias("doc_id"), F.posexplode(found(text)).alias("idx", "x")).select("doc_id", "idx", "x.tok", "x.start", "x.end")


def scorable(tokens: DataFrame, spans: DataFrame) -> DataFrame:
    """tokens(doc_id, idx, start, end) that overlap none of spans(doc_id, start, end). The equi key is the document, its spans are few once merged."""
    s = merge_spans(spans, ["doc_id"]).select("doc_id", F.col("start").alias("_s"), F.col("end").alias("_e"))
    return tokens.join(s, (tokens.doc_id == s.doc_id) & (F.col("_s") < F.col("end")) & (F.col("start") < F.col("_e")), "left_anti")
