"""Payloads of the two bibliographic providers, and what is done with them. No network: payloads are rows of JSON."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions import kernels, native

OPENALEX = "results array<struct<id:string,doi:string,title:string,publication_year:int,abstract_inverted_index:map<string,array<int>>,open_access:struct<is_oa:boolean>>>"
CROSSREF = "message struct<items:array<struct<DOI:string,URL:string,title:array<string>,abstract:string,issued:struct<`date-parts`:array<array<int>>>>>>"


def reconstruct_abstract(index: str | Column) -> Column:
    """Running text of a map word -> positions, by position and word; '' for null."""
    spots = F.flatten(F.transform(F.map_entries(native.col(index)), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.coalesce(F.array_join(F.transform(F.array_sort(spots), lambda x: x["w"]), " "), F.lit(""))


def strip_jats(c: str | Column) -> Column:
    """As native.strip_jats, with every entity HTML knows."""
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: " ".join(html.unescape(re.sub("<[^>]+>", " ", t or "")).split()))

    return F.pandas_udf(run, T.StringType())(native.col(c))


def _titled(title: Column, abstract: Column) -> Column:
    return F.when(title != "", F.concat(title, F.lit(". "), abstract)).otherwise(abstract)


def openalex(payloads: DataFrame, json: str = "payload", keep: list[str] | None = None) -> DataFrame:
    """(source_id, title, url, text, provider, year, open_access); records without an abstract are left out."""
    w = payloads.select(*(keep or []), F.explode(F.from_json(json, OPENALEX)["results"]).alias("w"))
    w = w.withColumn("a", reconstruct_abstract("w.abstract_inverted_index")).withColumn("t", F.coalesce(F.trim("w.title"), F.lit(""))).where("a <> ''")
    return w.select(
        *(keep or []), F.coalesce(F.nullif("w.doi", F.lit("")), F.nullif("w.id", F.lit("")), "t").alias("source_id"), F.col("t").alias("title"), F.coalesce("w.id", F.lit("")).alias("url"),
        _titled(F.col("t"), F.col("a")).alias("text"), F.lit("openalex").alias("provider"), F.col("w.publication_year").alias("year"), F.coalesce("w.open_access.is_oa", F.lit(False)).alias("open_access"))


def crossref(payloads: DataFrame, json: str = "payload", keep: list[str] | None = None) -> DataFrame:
    """As openalex(); open_access is false, the provider does not say."""
    w = payloads.select(*(keep or []), F.explode(F.from_json(json, CROSSREF)["message"]["items"]).alias("w"))
    w = w.withColumn("a", strip_jats("w.abstract")).withColumn("t", F.coalesce(F.trim(F.get("w.title", F.lit(0))), F.lit(""))).where("a <> ''")
    return w.select(
        *(keep or []), F.coalesce(F.nullif("w.DOI", F.lit("")), "t").alias("source_id"), F.col("t").alias("title"), F.coalesce("w.URL", F.lit("")).alias("url"),
        _titled(F.col("t"), F.col("a")).alias("text"), F.lit("crossref").alias("provider"), F.get(F.get(F.col("w.issued.date-parts"), F.lit(0)), F.lit(0)).alias("year"), F.lit(False).alias("open_access"))


def doi_key(c: str | Column) -> Column:
    return F.replace(F.lower(native.col(c)), F.lit("https://doi.org/"), F.lit(""))


def first_by_doi(found: DataFrame, order: list[str]) -> DataFrame:
    """One record a DOI key: the first in `order`. A null id is a key of its own. A minimum, pre-aggregated, not a sort."""
    cols = found.columns
    rest = [c for c in cols if c not in order]
    g = found.groupBy(doi_key("source_id").alias("doi")).agg(F.min(F.struct(*order, *rest)).alias("x"))
    return g.select("doi", *[F.col(f"x.{c}").alias(c) for c in cols])


def discover(openalex_payloads: DataFrame | None = None, crossref_payloads: DataFrame | None = None, only: tuple[str, ...] = ("openalex", "crossref")) -> DataFrame:
    """The chosen providers' records, one a DOI. Payloads: call int (the number of the phrase), payload string.

    The first found wins, by call, then provider in this order, then title and text. Malformed payloads give no records.
    """
    parts = []
    for no, (name, df, parse) in enumerate((("openalex", openalex_payloads, openalex), ("crossref", crossref_payloads, crossref))):
        if df is not None and name in only:
            parts.append(parse(df, keep=["call"]).withColumn("provider_no", F.lit(no)))
    if not parts:
        raise ValueError("no payloads")
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return first_by_doi(both, ["call", "provider_no", "title", "text"]).drop("doi", "call", "provider_no")


def query_phrases(text: str | Column, count: int = 6, size: int = 6) -> Column:
    """array<string> of the phrases to search for; empty for null or empty text."""
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([kernels.query_phrases(kernels.normalize(t).words, count, size) if t else [] for t in s], dtype=object)

    return F.pandas_udf(run, T.ArrayType(T.StringType()))(text)


def as_raw(found: DataFrame) -> DataFrame:
    """Rows a corpus takes: doc_id, text, source_name, page_starts, media_type, sha256."""
    return found.select(
        native.content_id("text").alias("doc_id"), "text", F.coalesce(F.nullif("title", F.lit("")), "source_id").alias("source_name"), F.array(F.lit(0)).alias("page_starts"),
        F.lit("text/plain").alias("media_type"), native.digest("text").alias("sha256"))
