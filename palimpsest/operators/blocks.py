"""Pairs of a table's sets of fingerprints, block against block: no pair is a row of a shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.config import FingerprintConfig
from palimpsest.functions import kernels
from palimpsest.operators.corpus import choose_bands
from palimpsest.operators.cut import shared_folder

ROWS = 16_000  # of a block
HOT = 2_000  # a value of at least 1 / HOT of the rows is frequent
PART = 2_000_000  # rows of pairs at once
MARKS = 64_000_000  # cells at once of rows by values


def pairs(sets: DataFrame, cfg: FingerprintConfig, jaccard: bool = False) -> DataFrame:
    """(a_id, b_id), smaller id first, of sets(doc_id, value sorted and distinct) that agree in a band of their signatures; each pair once.

    jaccard: also those whose exact Jaccard similarity is cfg.threshold or more, and columns same (slots), shared, either.
    The blocks are files in the shared folder, which tasks read themselves, so what is moved is a block for each other block.
    """
    spark = sets.sparkSession
    path = shared_folder(spark, "blocks")

    def signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(sig=[kernels.minhash(v, cfg.n_perm, cfg.seed) for v in b["value"]])

    sets.mapInPandas(signed, "doc_id bigint, value array<bigint>, sig array<bigint>").write.option("maxRecordsPerFile", ROWS).parquet(path)
    held = spark.read.parquet(path)
    files = sorted(held.inputFiles())
    hot: np.ndarray = np.empty(0, np.int64)
    if jaccard:
        # the order of values that all sets share: frequent ones last, the most frequent at the end; a bounded list
        most = held.select(F.explode("value").alias("value")).groupBy("value").agg(F.count("*").alias("n")).where(F.col("n") >= max(2, held.count() // HOT))
        hot = most.orderBy("n", "value").select("value").toPandas()["value"].to_numpy(np.int64)
    n, cores = len(files), spark.sparkContext.defaultParallelism
    tasks = n * (n + 1) // 2
    sent = spark.sparkContext.broadcast((files, hot))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, hot = sent.value
        of, a = -1, None
        for batch in batches:
            for t in batch["id"]:
                i, j = _cell(int(t))
                if i != of:
                    of, a = i, _Block(files[i], cfg, hot, jaccard)
                yield from _meet(a, a if i == j else _Block(files[j], cfg, hot, jaccard), i == j, cfg, jaccard)

    schema = "a_id bigint, b_id bigint" + ", same int, shared int, either int" * jaccard
    return spark.range(0, tasks, 1, max(1, min(tasks, cores * 16))).mapInPandas(run, schema)


def _cell(t: int) -> tuple[int, int]:
    """Row and column, not beyond it, of the t-th cell of a triangle."""
    i = int(((8 * t + 1) ** 0.5 - 1) / 2)
    while i * (i + 1) // 2 > t:
        i -= 1
    while (i + 1) * (i + 2) // 2 <= t:
        i += 1
    return i, t - i * (i + 1) // 2


class _Block:
    def __init__(self, path: str, cfg: FingerprintConfig, hot: np.ndarray, jaccard: bool):
        import pyarrow.fs as fs
        import pyarrow.parquet as pq

        system, at = fs.FileSystem.from_uri(path)
        t = pq.read_table(at, filesystem=system, columns=["doc_id", "sig"] + ["value"] * jaccard).combine_chunks()
        self.ids = t["doc_id"].to_numpy()
        self.sig = t["sig"].combine_chunks().flatten().to_numpy().reshape(len(self.ids), cfg.n_perm)
        bands, rows = choose_bands(cfg.n_perm, cfg.threshold)
        # equal keys are compared in full afterwards
        mix = np.array([pow(0x9E3779B97F4A7C15, 2 * r + 1, 1 << 64) for r in range(rows)], np.uint64)
        keys = (self.sig.view(np.uint64).reshape(len(self.ids), bands, rows) * mix).sum(axis=2, dtype=np.uint64).T
        self.order = np.argsort(keys, axis=1)
        self.keys = np.take_along_axis(keys, self.order, axis=1)
        if jaccard:
            v = t["value"].combine_chunks()
            self.value = v.flatten().to_numpy()
            self.size = np.diff(v.offsets.to_numpy())
            self.start = np.concatenate(([0], np.cumsum(self.size)))
            self.row = np.repeat(np.arange(len(self.ids)), self.size)
            # a set goes without its last values in the common order, one fewer than it must share with any partner
            self.drop = np.maximum(np.ceil(cfg.threshold * self.size - 1e-9).astype(int) - 1, 0)
            rank = np.zeros(len(self.value), np.int64)
            if len(hot):
                by = np.argsort(hot)
                k = np.minimum(np.searchsorted(hot[by], self.value), len(hot) - 1)
                rank = np.where(hot[by][k] == self.value, by[k] + 1, 0)
            o = np.lexsort((self.value, rank, self.row))
            place = np.empty(len(o), np.int64)
            place[o] = np.arange(len(o)) - self.start[self.row]
            kept = np.flatnonzero(place < (self.size - self.drop)[self.row])
            kept = kept[np.argsort(self.value[kept], kind="stable")]
            self.kept_value, self.kept_row = self.value[kept], self.row[kept]
            self.coded = np.unique(self.value, return_inverse=True) if len(self.value) else (np.zeros(1, np.int64), np.empty(0, np.int64))
            self.seen = None


def _equal(x: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of equal entries of two sorted arrays, at most about PART at once."""
    lo = np.searchsorted(y, x, "left")
    n = np.searchsorted(y, x, "right") - lo
    some = np.flatnonzero(n)
    if not len(some):
        return
    total = np.cumsum(n[some])
    for part in np.split(some, np.unique(np.searchsorted(total, np.arange(PART, total[-1], PART)))):
        if len(part):
            c = n[part]
            yield np.repeat(part, c), np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c) + np.repeat(lo[part], c)


def _meet(a: _Block, b: _Block, own: bool, cfg: FingerprintConfig, jaccard: bool) -> Iterator[pd.DataFrame]:
    if not len(a.ids) or not len(b.ids):
        return
    m, (bands, rows) = len(b.ids), choose_bands(cfg.n_perm, cfg.threshold)
    found = []
    for k in range(bands):
        for x, y in _equal(a.keys[k], b.keys[k]):
            x, y = a.order[k][x], b.order[k][y]
            ok = (a.sig[x, k * rows:k * rows + rows] == b.sig[y, k * rows:k * rows + rows]).all(axis=1)
            found.append((x * m + y)[ok & (x < y) if own else ok])
    code = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
    if jaccard:
        code = np.union1d(code, _near(a, b, own, cfg))
    for s in range(0, len(code), 200_000):
        x, y = np.divmod(code[s:s + 200_000], m)
        out = {"a_id": np.minimum(a.ids[x], b.ids[y]), "b_id": np.maximum(a.ids[x], b.ids[y])}
        if jaccard:
            same = np.concatenate([(a.sig[x[i:i + 10_000]] == b.sig[y[i:i + 10_000]]).sum(axis=1) for i in range(0, len(x), 10_000)])
            both = _shared(a, b, x, y)
            out |= {"same": same.astype(np.int32), "shared": both.astype(np.int32), "either": (a.size[x] + b.size[y] - both).astype(np.int32)}
        yield pd.DataFrame(out)


def _near(a: _Block, b: _Block, own: bool, cfg: FingerprintConfig) -> np.ndarray:
    """Codes of the pairs whose Jaccard similarity is cfg.threshold or more, rows of a by parts: those that share enough of the values kept are compared in full."""
    m, out = len(b.ids), [np.empty(0, np.int64)]
    step = max(1, len(a.ids) // 8)
    for s in range(0, len(a.ids), step):
        mine = (a.kept_row >= s) & (a.kept_row < s + step)
        value, row = a.kept_value[mine], a.kept_row[mine]
        code, count = np.empty(0, np.int64), np.empty(0, np.int64)
        for x, y in _equal(value, b.kept_value):
            x, y = row[x], b.kept_row[y]
            c, n = np.unique((x * m + y)[x < y] if own else x * m + y, return_counts=True)
            both = np.concatenate([code, c])
            code, at = np.unique(both, return_inverse=True)
            count = np.bincount(at, np.concatenate([count, n]), len(code)).astype(np.int64)
        x, y = np.divmod(code, m)
        least = np.ceil(cfg.threshold / (1 + cfg.threshold) * (a.size[x] + b.size[y]) - 1e-9)
        maybe = count >= least - np.maximum(a.drop[x], b.drop[y])
        code, x, y = code[maybe], x[maybe], y[maybe]
        both = _shared(a, b, x, y)
        out.append(code[both / np.maximum(1, a.size[x] + b.size[y] - both) >= cfg.threshold])
    return np.concatenate(out)


def _shared(a: _Block, b: _Block, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many values row x of a shares with row y of b; x does not fall."""
    out = np.zeros(len(x), np.int64)
    if not len(x):
        return out
    names, of_b = b.coded
    if a.seen is not b:  # once for two blocks
        k = np.minimum(np.searchsorted(names, a.value), len(names) - 1)
        a.seen, a.k, a.hit = b, k, names[k] == a.value
    k, hit = a.k, a.hit
    high = max(1, min(256, MARKS // len(names)))
    edges = np.unique(np.concatenate([np.searchsorted(x, np.arange(x[0], x[-1] + high, high)), [len(x)]]))
    mark = np.zeros((high, len(names)), bool)
    for s, e in zip(edges[:-1], edges[1:]):
        top = x[s]
        own = slice(a.start[top], a.start[min(top + high, len(a.ids))])
        r, c = a.row[own][hit[own]] - top, k[own][hit[own]]
        mark[r, c] = True
        for p in range(s, e, 20_000):
            u, w = x[p:min(e, p + 20_000)] - top, y[p:min(e, p + 20_000)]
            n = b.size[w]
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(b.start[w], n)
            out[p:p + len(u)] = np.bincount(np.repeat(np.arange(len(u)), n), mark[np.repeat(u, n), of_b[at]], len(u))
        mark[r, c] = False
    return out
