import numpy as np
from pyspark.sql import functions as F

from palimpsest.functions import kernels
from palimpsest.operators import blocks
from palimpsest.operators.corpus import choose_bands
from palimpsest.plans import catalog
from tests import brute

TEXTS = ["the old mill by the river was sold to a baker from the next town last spring", "the old mill by the river was sold to a painter from the next town last spring", "two words", None, "", "four words stand here",
         "nothing of this sentence stands in any other one that is listed above or below it", "the old mill by the river was sold to a baker from the next town last spring"]


def test_operators_run_over_all_documents(spark, tmp_path):
    cfg = catalog.CFG
    spark.createDataFrame(list(enumerate(TEXTS, 1)), "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    q = {n: f for n, f in catalog.queries().items() if n.endswith("_docs")}
    got = {n: [tuple(r) for r in q[n](spark, str(tmp_path)).collect()] for n in ("minhash_signature_docs", "lsh_classes_docs", "pair_jaccard_docs", "lsh_candidate_pairs_docs", "index_stats_docs")}
    values, sigs = {}, {}
    for i, t in enumerate(TEXTS, 1):
        h = brute.shingles((t or "").split(), cfg.k)
        values[i] = {h[p] for p in brute.winnow(h, cfg.w)}
        sigs[i] = brute.minhash(values[i], cfg.n_perm, cfg.seed)
    assert set(got["minhash_signature_docs"]) == {(i, k, v) for i, s in sigs.items() for k, v in enumerate(s)}
    cls = dict(got["lsh_classes_docs"])
    assert cls == {i: min(j for j in values if values[j] == values[i]) for i in values} and cls[8] == 1
    bands, rows = choose_bands(cfg.n_perm, cfg.threshold)
    meet = {(a, b) for a in sigs for b in sigs if a < b and any(sigs[a][k * rows:k * rows + rows] == sigs[b][k * rows:k * rows + rows] for k in range(bands))}
    pairs = set(got["lsh_candidate_pairs_docs"])
    assert {(a, b) for a in cls for b in cls if a < b and (cls[a] == cls[b] or tuple(sorted((cls[a], cls[b]))) in pairs)} == meet and (1, 2) in pairs
    assert {(a, b): x for a, b, _, x in got["pair_jaccard_docs"]} == {(a, b): round(len(values[a] & values[b]) / len(values[a] | values[b]), 6) for a, b in pairs}
    assert got["index_stats_docs"][0][:2] == (8, len(set.union(*values.values())))


def test_paraphrase_search_takes_all_items(spark, sf):
    got = [tuple(r) for r in catalog.paraphrase_topk_all(spark, sf).collect()]
    items = {r.item_id for r in spark.read.parquet(f"{sf}/eval_items.parquet").where("text rlike '\\\\S'").select("item_id").collect()}
    assert {r[0] for r in got} == items and len(items) == 240
    some = {(r[0], r[1], r[3]): r[2] for r in got if r[0] % 100 == 0}
    want = {(r[0], r[1], r[3]): r[2] for r in map(tuple, catalog.paraphrase_topk(spark, sf).collect())}
    assert some.keys() == want.keys() and all(abs(some[k] - want[k]) < 2e-6 for k in want)


def test_all_pairs_of_the_threshold_are_found_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(blocks, "ROWS", 40)
    cfg, rng = catalog.CFG, np.random.default_rng(1)
    # sets of 20 to 60 out of 60 values that are frequent and 400 that are not; some share 10 to 13 % and no band
    sets = {i: set(rng.choice(60, rng.integers(2, 8), replace=False).tolist()) | set((60 + rng.choice(400, rng.integers(18, 52), replace=False)).tolist()) for i in range(1, 141)} | {200: {1}, 201: set()}
    df = spark.createDataFrame([(i, sorted(v)) for i, v in sets.items()], "doc_id bigint, value array<bigint>").repartition(3)
    sig = {i: kernels.minhash(np.array(sorted(v), np.int64), cfg.n_perm, cfg.seed) for i, v in sets.items()}
    bands, rows = choose_bands(cfg.n_perm, cfg.threshold)
    both = {(a, b): (len(sets[a] & sets[b]), len(sets[a] | sets[b])) for a in sets for b in sets if a < b}
    meet = {(a, b) for a, b in both if (sig[a] == sig[b]).reshape(bands, rows).all(axis=1).any()}
    near = {p for p, (n, m) in both.items() if n / m >= cfg.threshold}
    assert {tuple(r) for r in blocks.pairs(df, cfg).collect()} == meet and len(near - meet) > 50
    got = [tuple(r) for r in blocks.pairs(df, cfg, jaccard=True).collect()]
    assert len(got) == len(meet | near) and {r[:2]: r[3:] for r in got} == {p: both[p] for p in meet | near}
    assert all(r[2] == (sig[r[0]] == sig[r[1]]).sum() for r in got)
    monkeypatch.setattr(blocks, "PART", 50)
    assert sorted(tuple(r) for r in blocks.pairs(df, cfg, jaccard=True).collect()) == sorted(got)
    assert blocks.pairs(df.where(F.lit(False)), cfg, jaccard=True).count() == 0
