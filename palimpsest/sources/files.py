"""Documents from files, with Spark's binary source: one row a file, ids from the content."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import kernels, native

MAX_BYTES = 40 * 1024 * 1024
# What can be read, and the media type of each.
MEDIA = {
    "txt": "text/plain", "text": "text/plain", "md": "text/plain", "pdf": "application/pdf", "rtf": "application/rtf", "html": "text/html", "htm": "text/html",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
}
SCHEMA = "text string, page_starts array<int>, error string"


def read_one(data: bytes, suffix: str) -> tuple[str, list[int]]:
    if suffix == "pdf":
        return kernels.pdf_text(data)
    if suffix == "docx":
        return kernels.docx_text(data), [0]
    text = kernels.decode(data)
    return (kernels.rtf_text(text) if suffix == "rtf" else kernels.html_text(text) if suffix in ("html", "htm") else text), [0]


def load_bytes(files: DataFrame) -> DataFrame:
    """files(path, content) -> doc_id, text, source_name, page_starts, media_type, sha256, error.

    A file that is too large, of an unknown kind or unreadable has null text and an error. page_starts refer to the text as it was read.
    """
    name = F.element_at(F.split("path", "/"), -1)
    f = files.select("path", "content", name.alias("source_name"), F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).alias("suffix"))
    media = F.create_map(*[F.lit(x) for kv in MEDIA.items() for x in kv])
    f = f.withColumn("media_type", F.try_element_at(media, F.col("suffix")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for data, suffix, known in zip(b["content"], b["suffix"], b["media_type"]):
                if data is None or len(data) > MAX_BYTES or known is None:
                    rows.append((None, None, "unsupported" if known is None else "too large" if data is not None else "no content"))
                    continue
                try:
                    rows.append((*read_one(bytes(data), suffix), None))
                except Exception as e:  # noqa: BLE001 - one bad file must not end the load
                    rows.append((None, None, f"{type(e).__name__}: {e}"))
            out = pd.DataFrame(rows, columns=["text", "page_starts", "error"])
            yield pd.concat([b.drop(columns=["suffix"]).reset_index(drop=True), out], axis=1)

    d = f.mapInPandas(run, f"path string, content binary, source_name string, media_type string, {SCHEMA}")
    return d.select(native.content_id("content").alias("doc_id"), native.tidy("text").alias("text"), "source_name", "page_starts", "media_type", native.digest("content").alias("sha256"), "error", "path")


def load_dir(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """Supported files under root; those that fail are left out. Distributed, so without an order (sort by path for one)."""
    glob = "*.{" + ",".join(x for s in MEDIA for x in (s, s.upper())) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", glob).load(root)
    return load_bytes(files.where(F.col("length") <= MAX_BYTES).select("path", "content")).where("error is null").drop("error")


def load_path(spark: SparkSession, path: str) -> DataFrame:
    return load_bytes(spark.read.format("binaryFile").load(path).select("path", "content"))
