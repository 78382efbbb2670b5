"""Problem 4: new batches held against everything accepted before, without reprocessing the history.

A text is cut into chunks at content-defined boundaries: five-token runs, chosen by their rolling hash. A chunk begins at
a boundary and reaches to the next; its key is the run at which it begins. The table of chunks to records grows
with each accepted batch. A new batch is cut likewise, its chunks are looked up, and the pairs that meet are decided by
coverage: the share of all runs of the two that they have in common, at least SIMILARITY of them (the Jaccard similarity
asked for). Then the accepted chunks are appended. Neither texts nor chunks of the history are computed again, and a
batch that is small beside the history is sent to it, not the other way round.

Boundaries at a fixed rate, with hashes of whole chunks, would lose pairs: two texts that are 0.7 similar need have no whole
chunk in common. So the rate follows the text: the runs that come first in one fixed order are boundaries, as many
as 1 - SIMILARITY of its distinct runs and SHARED more. Two texts that are that similar then have the first SHARED runs they
share among the boundaries of both, whatever their length, repetition or edits, so pairs with fewer boundaries in common (or fewer than all the
runs they would have to share) are none. Bounds on length, place and parity of hashed runs thin the candidates further, without loss.

The order puts last the runs that many texts of the first batch hold (counted over one text in SAMPLE; common is what
at least one in RARE of them holds), then goes by hash. It is stored with the history and never changes. It decides only how many
pairs are looked at, never which are found.

Copies form one class. Null and empty texts are never cases; texts under five tokens match only as
copies; rows without an accepted doc_id never stand on the earlier side, rows of null id or batch on neither.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators.cut import delete, shared_folder

from .common import materialize, present, table, tokens
from .p2_spans import gram_hashes, token_ids

GRAM = 5
SIMILARITY = 0.7
SAMPLE = 16
RARE = 2_000
SHARED = 3
SENT = 100_000  # rows of two or three numbers each: what is broadcast at most


@contextlib.contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """What is shuffled for a table written in here is deleted with that, not when the driver next collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def kept(df: DataFrame) -> DataFrame:
    with tidy(df.sparkSession):
        return materialize(df)


def listed(ids: DataFrame) -> DataFrame:
    """A list to join with: if it is short (SENT, counted), it is sent, and nothing else moves."""
    return F.broadcast(ids) if ids.count() <= SENT else ids


def parity(g: np.ndarray) -> bytes:
    """As many bits as there are runs, to the next power of two; each run flips one. Two of them differ in no more places than the sets do."""
    size = 1 << max(6, (len(g) - 1).bit_length())
    return np.packbits((np.bincount(g & (size - 1), minlength=size) & 1).astype(bool)).tobytes()


def parity_distance(x: bytes, y: bytes) -> int:
    a, b = sorted((x, y), key=len)
    while len(b) > len(a):  # the longer one folded is what the shorter size would have given
        h = len(b) // 2
        b = (int.from_bytes(b[:h]) ^ int.from_bytes(b[h:])).to_bytes(h)
    return (int.from_bytes(a) ^ int.from_bytes(b)).bit_count()


def _signed(batches: Iterator[pd.DataFrame], order: Broadcast, similarity: float) -> Iterator[pd.DataFrame]:
    memo: dict[str, int] = {}
    common, count = order.value
    for b in batches:
        runs, bits, ends = [], [], []
        for t in b["_t"]:
            g = np.unique(gram_hashes(token_ids(tokens(t), memo), GRAM))
            often = np.zeros(len(g), np.int64)
            if len(common) and len(g):
                at = np.minimum(np.searchsorted(common, g), len(common) - 1)
                often = np.where(common[at] == g, count[at], 0)
            n = min(len(g), len(g) - int(np.ceil(similarity * len(g) - 1e-6)) + SHARED)
            runs.append(g[np.lexsort((g, often))]); bits.append(parity(g) if len(g) else b""); ends.append(n)
        yield pd.DataFrame({"_id": b["_id"], "batch_no": b["batch_no"], "cls": b["cls"], "total": [len(r) for r in runs], "bits": bits, "chunks": ends, "runs": runs})


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    memo: dict[str, int] = {}
    for b in batches:
        yield pd.DataFrame({"runs": [np.unique(gram_hashes(token_ids(tokens(t), memo), GRAM)).tobytes() for t in b["_t"]]})


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        if len(b):
            run, n = np.unique(np.concatenate([np.frombuffer(g, np.int64) for g in b["runs"]]), return_counts=True)
            yield pd.DataFrame({"run": run, "n": n})


def _close(batches: Iterator[pd.DataFrame], similarity: float) -> Iterator[pd.DataFrame]:
    for b in batches:
        most = (1 - similarity) / (1 + similarity) * (b["ta"] + b["tb"]) + 1e-6
        yield b.loc[[parity_distance(x, y) <= m for x, y, m in zip(b["sa"], b["sb"], most)], ["ca", "cb"]]


def close(pairs: DataFrame, left: DataFrame, right: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (ca, cb) whose parities (left, right: cls, total, bits) do not rule that similarity out."""
    return (pairs.join(left.select(F.col("cls").alias("ca"), F.col("total").alias("ta"), F.col("bits").alias("sa")), "ca")
            .join(right.select(F.col("cls").alias("cb"), F.col("total").alias("tb"), F.col("bits").alias("sb")), "cb")
            .mapInPandas(lambda it: _close(it, similarity), "ca bigint, cb bigint"))


def confirmed(pairs: DataFrame, runs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (ca, cb) whose sets of runs are that similar. runs(cls, runs) need hold no more than their classes."""
    return (pairs.join(runs.select(F.col("cls").alias("ca"), F.col("runs").alias("ra")), "ca")
            .join(runs.select(F.col("cls").alias("cb"), F.col("runs").alias("rb")), "cb")
            .mapInPandas(lambda it: _jaccard(it, similarity), "ca bigint, cb bigint"))


def _jaccard(batches: Iterator[pd.DataFrame], similarity: float) -> Iterator[pd.DataFrame]:
    for b in batches:
        keep = []
        for x, y in zip(b["ra"], b["rb"]):
            n = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(n >= similarity * (len(x) + len(y) - n) - 1e-9)
        yield b.loc[keep, ["ca", "cb"]]


def _expand(pairs: DataFrame, old: DataFrame, new: DataFrame, ident: str, block: int = 2_000) -> DataFrame:
    """Class pairs (ca, cb), the two may be one class -> row pairs with an earlier batch on side a."""
    def blocks(d: DataFrame, cls: str, i: str, n: str, b: str, batch: str) -> tuple[DataFrame, DataFrame]:
        size = d.groupBy("cls").agg(F.ceil(F.count("*") / block).cast("int").alias(n)).where(F.col(n) > 1)
        rows = d.join(size, "cls", "left").select(F.col("cls").alias(cls), F.col("_id").alias(i), F.col("batch_no").alias(batch),
                                                  F.pmod(F.xxhash64("_id"), F.coalesce(n, F.lit(1)).cast("bigint")).cast("int").alias(b))
        return rows, size.select(F.col("cls").alias(cls), n)

    left, na = blocks(old, "ca", "ia", "na", "ba", "bta")
    right, nb = blocks(new, "cb", "ib", "nb", "bb", "btb")
    p = (pairs.join(na, "ca", "left").join(nb, "cb", "left")
         .withColumn("ba", F.explode(F.sequence(F.lit(0), F.coalesce("na", F.lit(1)) - 1)))
         .withColumn("bb", F.explode(F.sequence(F.lit(0), F.coalesce("nb", F.lit(1)) - 1))).select("ca", "cb", "ba", "bb"))
    return p.join(left, ["ca", "ba"]).join(right, ["cb", "bb"]).where("bta < btb").select(F.col("ia").alias(f"{ident}_a"), F.col("ib").alias(f"{ident}_b"))


class History:
    """Chunks, signatures and rows of everything accepted, in a folder that all executors share.

    check(batch) compares one batch with what earlier calls appended; append(batch) adds accepted rows. Each
    append is a part of its own, which counts only once the last of its tables is written and its name is listed:
    what a failed call leaves behind is never read. A row that was appended before is not added twice (rows are identified by `ident`).
    """

    def __init__(self, spark: SparkSession, path: str, ident: str = "raw_id", similarity: float = SIMILARITY, kind: str = "bigint"):
        self.spark, self.path, self.ident, self.similarity = spark, path, ident, similarity
        self.schemas = {
            "rows": f"cls bigint, _id {kind}, batch_no int", "chunks": "chunk bigint, place int, cls bigint, total int",
            "texts": "cls bigint, total int, bits binary, runs array<bigint>", "order": "run bigint, n bigint", "parts": "part string",
        }
        self.signed = f"_id {kind}, batch_no int, cls bigint, total int, bits binary, chunks int, runs array<bigint>"  # the first `chunks` of the runs are its chunks
        self._order: Broadcast | None = None
        self._work: dict[int, str] = {}

    def _load(self, name: str, paths: list[str]) -> DataFrame:
        schema = self.schemas[name]
        try:
            return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def _read(self, name: str) -> DataFrame:
        parts = [r["part"] for r in self._load("parts", [f"{self.path}/parts"]).collect()]  # one a batch
        return self._load(name, [f"{self.path}/{p}/{name}" for p in sorted(parts)])

    def order(self, batch: DataFrame) -> Broadcast:
        """The stored order of runs, fixed by the first batch: at most RARE entries for each run of a text of mean length."""
        if self._order is None:
            path = f"{self.path}/order"
            stored = self._load("order", [path]).orderBy("run").toPandas()
            if not len(stored) and not self._read("rows").limit(1).count():
                some = batch.where(F.pmod(F.xxhash64("cls"), F.lit(SAMPLE)) == 0).dropDuplicates(["cls"])
                runs = materialize(some.select("_t").mapInPandas(_runs, "runs binary"))
                least = max(2, -(-runs.count() // RARE))
                runs.mapInPandas(_counted, "run bigint, n bigint").groupBy("run").agg(F.sum("n").alias("n")).where(F.col("n") >= least).write.mode("overwrite").parquet(path)
                stored = self._load("order", [path]).orderBy("run").toPandas()
            self._order = self.spark.sparkContext.broadcast((stored["run"].to_numpy(np.int64), stored["n"].to_numpy(np.int64)))
        return self._order

    def sign(self, batch: DataFrame) -> DataFrame:
        """One written row a record of the batch (ident, text, batch_no): its class, chunks, parity and runs. Texts are read once and not moved."""
        d = batch.where(present("text") & F.col(self.ident).isNotNull() & F.col("batch_no").isNotNull()).select(
            F.col(self.ident).alias("_id"), F.col("batch_no").cast("int").alias("batch_no"), F.xxhash64("text").alias("cls"), F.col("text").alias("_t"))
        order, similarity = self.order(d), self.similarity
        path = f"{self.path}/signed/{uuid.uuid4().hex}"
        d.mapInPandas(lambda it: _signed(it, order, similarity), self.signed).write.parquet(path)
        out = self.spark.read.schema(self.signed).parquet(path)
        self._work[id(out)] = path
        return out

    def release(self, signed: DataFrame) -> None:
        """Deletes signed rows that are in the history by now."""
        delete(self.spark.sparkContext, self._work.pop(id(signed)))

    def rows(self, signed: DataFrame, accepted: DataFrame | None = None) -> DataFrame:
        """(cls, ident, batch_no, ok) of the signed rows; accepted: ids, all of them if not given."""
        r = signed.select("cls", "_id", "batch_no")
        if accepted is None:
            return r.withColumn("ok", F.lit(True))
        ok = accepted.select(F.col(self.ident).alias("_id")).distinct().withColumn("ok", F.lit(True))
        return materialize(r.join(ok, "_id", "left").select("cls", "_id", "batch_no", F.coalesce("ok", F.lit(False)).alias("ok")))

    def _copies(self, rows: DataFrame) -> DataFrame:
        """Ids of all rows of a class but one."""
        one = rows.groupBy("cls").agg(F.min("_id").alias("_one"), F.count("*").alias("_n")).where("_n > 1")
        return kept(rows.select("cls", "_id").join(one, "cls").where("_id <> _one").select("_id").distinct())

    @staticmethod
    def _exploded(classes: DataFrame, *more: str) -> DataFrame:
        # what one text's rows share stands last and together: it packs to a few bytes in a shuffle
        return classes.select("cls", "total", *more, F.posexplode(F.slice("runs", F.lit(1), F.col("chunks"))).alias("place", "chunk")).select("chunk", "place", "cls", "total", *more)

    def similar(self, signed: DataFrame, rows: DataFrame) -> DataFrame:
        """(ca, cb): accepted classes, of the history or of a batch signed along, and classes of the signed rows that are equal or similar; written.

        A set of rows with few chunks (SENT at most, counted) is sent to the history; a larger one is joined by shuffle.
        """
        old = self._read("rows")
        spread_ = rows.groupBy("cls").agg(F.min(F.when(F.col("ok"), F.col("batch_no"))).alias("first"), F.max("batch_no").alias("last"))
        copies = self._copies(rows)
        without = listed(copies)
        # one row of each class; chunks and signatures, each without the runs, which would move with them if the copies are too many to be sent
        own = signed.select("_id", "cls", "total", "chunks", F.slice("runs", F.lit(1), F.col("chunks")).alias("runs")).join(without, "_id", "left_anti")
        signatures = signed.select("_id", "cls", "total", "bits").join(without, "_id", "left_anti").drop("_id")
        small = signed.agg(F.sum("chunks")).first()[0] or 0
        sent = F.broadcast if small <= SENT else lambda d: d
        s = self.similarity
        side = lambda d, x, t, p: d.select("chunk", F.col("place").alias(p), F.col("cls").alias(x), F.col("total").alias(t))
        exploded = self._exploded(own)
        b = side(exploded, "cb", "tb", "pb")
        ta, tb = F.col("ta"), F.col("tb")
        length = F.least(ta, tb) >= s * F.greatest(ta, tb) - 1e-6
        # from each of the first SHARED boundaries they share on, the rest of either text must still hold what they have in common, but for those before it
        near = F.least(ta - F.col("pa"), tb - F.col("pb")) >= s / (1 + s) * (ta + tb) - 1e-6 - (SHARED - 1)
        enough = F.col("_k") >= F.least(F.lit(SHARED), F.ceil(s * F.greatest(ta, tb) - 1e-6))
        meet = lambda a, b, which: a.join(b, "chunk").where(which & length & near).groupBy("ca", "cb", "ta", "tb").agg(F.count("*").alias("_k")).where(enough).select("ca", "cb")
        met = meet(side(self._read("chunks"), "ca", "ta", "pa"), sent(b), F.col("ca") != F.col("cb"))
        fresh = spread_.where("first is not null").select("cls")
        several = rows.agg(F.min("batch_no") < F.max("batch_no")).first()[0]
        if several:  # batches signed together: the later ones are held against the accepted rows of the earlier ones too
            # within the delivery each two meet once, whichever is the earlier; then only those stay that some accepted row of one precedes
            within = kept(meet(side(exploded, "ca", "ta", "pa"), b, F.col("ca") < F.col("cb")))
            x, y = (spread_.select(F.col("cls").alias(c), F.col("first").alias(f"f{c}"), F.col("last").alias(f"l{c}")) for c in ("ca", "cb"))
            within = kept(within.join(x, "ca").join(y, "cb").select("ca", "cb", (F.col("fca") < F.col("lcb")).alias("on"), (F.col("fcb") < F.col("lca")).alias("back")).where("on or back"))
            met = met.unionByName(within.where("on").select("ca", "cb")).unionByName(within.where("back").select(F.col("cb").alias("ca"), F.col("ca").alias("cb")))
        met = met.distinct()
        needed = kept(met)
        texts = self._read("texts")
        accepted = texts.select("cls", "total", "bits")
        if several:  # those of them that stand on side a are accepted
            accepted = accepted.unionByName(signatures)
        among = lambda d, x: d.join(listed(needed.select(F.col(x).alias("cls")).distinct()), "cls", "left_semi")
        # signatures of the classes that met
        pairs = kept(close(needed, among(accepted, "ca"), among(signatures, "cb"), s).distinct())
        # then runs of those whose signatures are close, and of no others; one table is moved at a time if they are too many to be sent
        ids = kept(pairs.select(F.col("ca").alias("cls")).unionByName(pairs.select(F.col("cb").alias("cls"))).distinct())
        ones = kept(rows.select("cls", "_id").join(ids, "cls", "left_semi").join(copies, "_id", "left_anti").select("_id").distinct())
        mine = kept(signed.select("_id", "cls", "runs").join(listed(ones), "_id", "left_semi")).select("cls", "runs").dropDuplicates(["cls"])
        theirs = kept(texts.select("cls", "runs").join(listed(ids), "cls", "left_semi"))
        found = confirmed(pairs, mine.unionByName(theirs.join(mine.select("cls"), "cls", "left_anti")), s)
        known = old.select("cls").unionByName(fresh) if several else old.select("cls")
        same = own.select("cls").join(known.distinct(), "cls", "left_semi").select(F.col("cls").alias("ca"), F.col("cls").alias("cb"))
        return kept(found.distinct().unionByName(same))

    def pairs(self, signed: DataFrame, rows: DataFrame) -> DataFrame:
        """(ident_a, ident_b) of signed rows."""
        old = self._read("rows").unionByName(rows.where("ok").drop("ok"))
        return _expand(self.similar(signed, rows), old, rows.drop("ok"), self.ident)

    def check(self, batch: DataFrame) -> DataFrame:
        """(ident_a, ident_b): accepted rows of earlier batches that rows of this batch (or of these batches) repeat."""
        signed = self.sign(batch)
        return self.pairs(signed, self.rows(signed))

    def append(self, accepted: DataFrame) -> None:
        signed = self.sign(accepted)
        self.add(signed, self.rows(signed))

    def add(self, signed: DataFrame, rows: DataFrame) -> None:
        """Appends the accepted ones of the signed rows; of copies the chunks are stored once."""
        old = self._read("rows")
        new = rows.where("ok").drop("ok").join(old.select("_id"), "_id", "left_anti").dropDuplicates(["_id"])
        fresh = kept(new.join(old.select("cls"), "cls", "left_anti").groupBy("cls").agg(F.min("_id").alias("_id")))
        fresh = signed.join(listed(fresh.select("_id")), "_id", "left_semi")
        part = uuid.uuid4().hex
        with tidy(self.spark):
            self._exploded(fresh).write.parquet(f"{self.path}/{part}/chunks")
            fresh.select("cls", "total", "bits", "runs").write.parquet(f"{self.path}/{part}/texts")
            new.select("cls", "_id", "batch_no").write.parquet(f"{self.path}/{part}/rows")
        self.spark.createDataFrame([(part,)], "part string").coalesce(1).write.mode("append").parquet(f"{self.path}/parts")


def repeats(records: DataFrame, accepted: DataFrame, ident: str = "raw_id", similarity: float = SIMILARITY) -> DataFrame:
    """(ident_a, ident_b), a accepted and of an earlier batch, b equal or that similar.

    Two deliveries: the first batch starts the history; all later ones are held against it, and against the accepted rows
    of each other's earlier batches, in one go. (Batch by batch, `History.check` and `append` give the same rows.)

    records: ident, doc_id, text, batch_no; accepted: doc_id. Rows with null batch_no stand nowhere.
    """
    spark = records.sparkSession
    known = accepted.select("doc_id").where("doc_id is not null").distinct()
    r = records.select(ident, "doc_id", "text", "batch_no")
    kind = records.schema[ident].dataType.simpleString()
    history = History(spark, shared_folder(spark, "history"), ident, similarity, kind)
    first = r.agg(F.min("batch_no")).first()[0]
    if first is None:
        return spark.createDataFrame([], f"{ident}_a {kind}, {ident}_b {kind}")
    ok = r.where(F.col(ident).isNotNull()).select(ident, "doc_id").join(known, "doc_id", "left_semi")
    base = history.sign(r.where(F.col("batch_no") == first))
    history.add(base, history.rows(base, ok))
    history.release(base)
    later = history.sign(r.where(F.col("batch_no") > first))
    return history.pairs(later, history.rows(later, ok))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return repeats(table(spark, sf, "raw_docs"), table(spark, sf, "source_meta"))
