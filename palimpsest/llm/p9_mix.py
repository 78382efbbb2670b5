"""Problem 9: records of several sources mixed to target weights.

Sizes are tokens of a public tokenizer. The largest mix is taken in which every source can give its
share without being used more than max_repeats times; a source gives whole passes over its records
and then the first records (in hash order) of one more pass, so it misses its quota by less than
one record. Each source's stream is cut into blocks of 1/BLOCKS of the mix. Block k of a source of
weight w is released at k / w and due at (k + 1) / w; earliest deadline first over the released
blocks puts them into slots, which keeps every source within one block of its share all along.

Running sums are taken in two steps (over hash buckets, then inside a bucket), so no task ever holds
a whole source. Source names are compared trimmed and in lower case. Records of null, empty or
zero-token text, of a null source or one without a target are not used. A target whose source has
no record, or with no share or repeats, is reported with share 0 and the others keep their
proportions. Rows with one doc_id are records of their own.
"""

from __future__ import annotations

import base64
import heapq
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, present, spread, table

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the split pattern that belongs to this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLOCKS = 10_000
BUCKETS = 4096


def tokenizer(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(df: DataFrame, ident: str, text: str, source: str, path: str = TOKENIZER) -> DataFrame:
    """(_id, source, n, h) of every record with text and source."""
    kind = df.schema[ident].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = None
        for b in batches:
            enc = enc or tokenizer(path)
            yield pd.DataFrame({"_id": b["_id"], "source": b["source"], "n": [len(enc.encode_ordinary(t)) for t in b["_t"]], "h": b["h"]})

    d = df.select(F.col(ident).alias("_id"), F.lower(F.trim(source)).alias("source"), F.col(text).alias("_t")).where(present("_t") & present("source"))
    return spread(d.withColumn("h", F.xxhash64("_id", "_t"))).mapInPandas(run, f"_id {kind}, source string, n bigint, h bigint").where("n > 0")


def schedule(weights: dict[str, float], blocks: dict[str, int]) -> list[tuple[str, int, int]]:
    """[(source, block, slot)] by earliest deadline first among released blocks."""
    total = sum(weights.values())
    w = {s: x / total for s, x in weights.items() if blocks.get(s)}
    waiting = [(0.0, s, 0) for s in sorted(w)]
    heapq.heapify(waiting)
    ready: list[tuple[float, str, int]] = []
    out: list[tuple[str, int, int]] = []
    slot = 0
    while waiting or ready:
        while waiting and waiting[0][0] <= slot + 1e-9:
            _, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, ((k + 1) / w[s], s, k))
        if not ready:  # rounding left a gap: time passes
            slot = math.ceil(waiting[0][0] - 1e-9)
            continue
        _, s, k = heapq.heappop(ready)
        out.append((s, k, len(out)))
        slot += 1
        if k + 1 < blocks[s]:
            heapq.heappush(waiting, ((k + 1) / w[s], s, k + 1))
    return out


def plan(sizes: DataFrame, targets: DataFrame, source: str = "source") -> list[dict]:
    """One entry a target (the table of targets is as small as the list of sources): quota and size in tokens."""
    t = targets.select(F.lower(F.trim(source)).alias("source"), "target_share", "max_repeats").where("source is not null").groupBy("source").agg(
        F.max("target_share").alias("w"), F.max("max_repeats").alias("r"))
    rows = t.join(sizes.groupBy("source").agg(F.sum("n").alias("size")), "source", "left").orderBy("source").collect()
    out = [{"source": x["source"], "w": float(x["w"] or 0), "r": int(x["r"] or 0), "size": int(x["size"] or 0)} for x in rows]
    live = [x for x in out if x["w"] > 0 and x["r"] > 0 and x["size"] > 0]
    share = sum(x["w"] for x in live)
    total = min((x["size"] * x["r"] / (x["w"] / share) for x in live), default=0.0)
    for x in out:
        x["quota"] = min(x["size"] * x["r"], int(total * x["w"] / share)) if x in live else 0
    return out


def mix(docs: DataFrame, targets: DataFrame, ident: str = "doc_id", text: str = "text", source: str = "source", path: str = TOKENIZER, blocks: int = BLOCKS) -> tuple[DataFrame, DataFrame]:
    """(records(ident, source, copy, n_tokens, slot, place), shares(source, target_share, max_repeats, available_tokens, chosen_tokens, actual_share))."""
    spark = docs.sparkSession
    n = materialize(count_tokens(docs, ident, text, source, path))
    entries = plan(n, targets)
    total = sum(x["quota"] for x in entries)
    block = max(1, math.ceil(total / blocks))
    quota = spark.createDataFrame([(x["source"], x["quota"], x["size"]) for x in entries if x["quota"] > 0], "source string, quota bigint, size bigint")
    slots = schedule({x["source"]: float(x["quota"]) for x in entries if x["quota"] > 0}, {x["source"]: math.ceil(x["quota"] / block) for x in entries})
    at = spark.createDataFrame(slots or [], "source string, block bigint, slot int")  # at most `blocks` rows and one a source
    b = n.join(F.broadcast(quota), "source").withColumn("bucket", F.shiftrightunsigned("h", 64 - 12) % BUCKETS)
    sums = b.groupBy("source", "bucket").agg(F.sum("n").alias("s"))
    before = sums.select("source", "bucket", (F.sum("s").over(Window.partitionBy("source").orderBy("bucket")) - F.col("s")).alias("base"))
    inside = F.sum("n").over(Window.partitionBy("source", "bucket").orderBy("h", "_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    b = b.join(before, ["source", "bucket"]).withColumn("start", F.col("base") + inside).where("start < quota")
    copies = F.sequence(F.lit(0), F.floor((F.col("quota") - 1 - F.col("start")) / F.col("size")).cast("int"))
    r = b.withColumn("copy", F.explode(copies)).withColumn("place", F.col("copy") * F.col("size") + F.col("start"))
    r = r.withColumn("block", F.floor(F.col("place") / block)).join(F.broadcast(at), ["source", "block"])
    records = r.select(F.col("_id").alias(ident), "source", "copy", F.col("n").alias("n_tokens"), "slot", "place")
    asked = spark.createDataFrame([(x["source"], x["w"], x["r"], x["size"]) for x in entries], "source string, target_share double, max_repeats int, available_tokens bigint")
    got = records.groupBy("source").agg(F.sum("n_tokens").alias("chosen_tokens"))
    s = asked.join(got, "source", "left").withColumn("chosen_tokens", F.coalesce("chosen_tokens", F.lit(0)))
    # one row a target: the whole table is as small as the list of sources
    shares = s.withColumn("_all", F.sum("chosen_tokens").over(Window.partitionBy(F.lit(0)))).select("source", "target_share", "max_repeats", "available_tokens", "chosen_tokens", F.when(F.col("_all") > 0, F.round(F.col("chosen_tokens") / F.col("_all"), 6)).otherwise(0.0).alias("actual_share"))
    return records, shares


def _tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return mix(table(spark, sf, "documents").select("doc_id", "text", "source"), table(spark, sf, "mix_targets"))


def p9_mix(spark: SparkSession, sf: str) -> DataFrame:
    return _tables(spark, sf)[0]


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    return _tables(spark, sf)[1]
