import itertools

import pytest
from pyspark.sql import functions as F

from palimpsest.config import CALIBRATED, PROFILES, DetectorProfile, FingerprintConfig, ScoringConfig
from palimpsest.operators import align, corpus, detect, paraphrase, retrieve, scoring, spans
from palimpsest.plans import engine as plans
from palimpsest.plans import report
from palimpsest.sources import files, providers

SOURCE = ("Salt marshes along sheltered coasts store carbon at rates that few other habitats reach because their waterlogged soils slow the decay of roots and leaves. "
          "Every tide brings a thin layer of silt that buries last season's growth before microbes can return it to the air. "
          "Where embankments cut the marsh from the sea this supply ends and the stored carbon begins to escape again within a few decades.")
COPIED = "because their waterlogged soils slow the decay of roots and leaves. Every tide brings a thin layer of silt that buries last season's growth"
PROSE = ("Our visit to the museum began in the rain and ended with tea in a bright hall. The guide spoke about clocks, maps and a long voyage to the south. "
         "Children drew ships on paper while their parents compared old coins in glass cases near the stairs.")


def build(spark, sources, **kw):
    raw = spark.createDataFrame(list(sources.items()), "doc_id string, text string")
    return plans.Engine.build(raw, **kw)


def index(spark, engine, text, name="s"):
    r = engine.check(spark.createDataFrame([(name, text)], "doc_id string, text string"))
    return r, r.similarity.first()["index"]


def test_a_copied_passage_is_found_and_prose_is_not(spark):
    e = build(spark, {"a": SOURCE})
    r, x = index(spark, e, PROSE + " " + COPIED + " " + PROSE)
    assert x > 0.12
    m = r.matches.collect()
    assert m[0]["match_type"] == "verbatim" and m[0]["q1"] - m[0]["q0"] + 1 >= 15
    r, x = index(spark, e, PROSE)
    assert x == 0.0 and r.matches.count() == 0
    assert index(spark, e, "x " * 9 + "waterlogged soils slow the" + " y" * 9)[1] == 0.0


def test_shares_sum_to_the_index_and_unique_words_to_the_matched(spark):
    e = build(spark, {"a": SOURCE, "b": SOURCE + " And more about reeds.", "c": PROSE + " " + SOURCE})
    r, x = index(spark, e, SOURCE + " " + "Other words follow here without any model at all in sight.")
    b = r.by_source.collect()
    assert x <= 1 and len(b) >= 2
    assert sum(s["share"] for s in b) == pytest.approx(x)
    assert sum(s["unique_words"] for s in b) == r.similarity.first()["matched_words"]
    assert any(s["unique_words"] == 0 for s in b)


def test_quotation_evasion_allow_list_and_forgetting(spark):
    e = build(spark, {"a": SOURCE})
    plain = index(spark, e, PROSE + " " + COPIED + ".")[1]
    r, quoted = index(spark, e, PROSE + ' "' + COPIED + '" it says.')
    assert quoted < plain and r.matches.first()["exclusion_reason"] == "quote"
    assert index(spark, e, PROSE + " " + "​".join(COPIED).replace("o", "о") + ".")[1] > 0.12
    from dataclasses import replace
    assert index(spark, replace(e, scoring=ScoringConfig(allowlist=frozenset({"a"}))), PROSE + " " + COPIED)[1] == 0.0
    assert index(spark, e.forget(spark.createDataFrame([("a",)], "doc_id string")), PROSE + " " + COPIED)[1] == 0.0
    e2 = e.add(spark.createDataFrame([("t", PROSE)], "doc_id string, text string"))
    assert index(spark, e2, PROSE)[1] > 0.9 and index(spark, e2, PROSE, "t")[1] == 0.0  # its own id is left out


def test_saved_and_loaded_it_gives_the_same(spark, tmp_path):
    e = build(spark, {"a": SOURCE, "n": None, "e": ""})
    x = index(spark, e, PROSE + " " + COPIED)[1]
    e.save(str(tmp_path / "c"))
    again = plans.Engine.load(spark, str(tmp_path / "c"))
    assert again.corpus.cfg == e.corpus.cfg and index(spark, again, PROSE + " " + COPIED)[1] == pytest.approx(x, abs=1e-9)
    with pytest.raises(ValueError):
        e.corpus.append(spark.createDataFrame([("x", "y")], "doc_id string, text string"), cfg=FingerprintConfig(k=6))


def test_appending_twice_doubles_postings_unless_ignored(spark):
    raw = spark.createDataFrame([("a", SOURCE)], "doc_id string, text string")
    c = corpus.Corpus.build(raw)
    sub = corpus.fingerprints(spark.createDataFrame([("s", SOURCE)], "doc_id string, text string"), c.cfg)
    n = retrieve.shared_counts(sub, c.docs).first()["shared"]
    assert retrieve.shared_counts(sub, c.append(raw).docs).first()["shared"] == 2 * n
    assert retrieve.shared_counts(sub, c.append(raw, on_duplicate="ignore").docs).first()["shared"] == n
    assert c.stats().first()["documents"] == 1
    assert corpus.choose_bands(128, 0.10) == (64, 2) and corpus.choose_bands(128, 0.50) == (32, 4) and corpus.choose_bands(128, 0.80) == (8, 16)


def test_documents_too_short_to_fingerprint_collide_but_never_match(spark):
    e = build(spark, {"a": "one two", "b": "three", "c": None})
    sub = spark.createDataFrame([("s", "four five"), ("z", None)], "doc_id string, text string")
    c = retrieve.candidates(corpus.fingerprints(sub, e.corpus.cfg), e.corpus.docs, e.corpus.cfg).collect()
    assert {(x["sub_id"], x["via"], x["est_jaccard"], x["shared"]) for x in c} == {("s", "lsh", 1.0, 0), ("z", "lsh", 1.0, 0)} and len(c) == 6
    r = e.check(sub)
    assert r.matches.count() == 0 and {x["index"] for x in r.similarity.collect()} == {0.0}


def test_empty_tables_and_extra_columns(spark):
    e = build(spark, {"a": SOURCE})
    empty = spark.createDataFrame([], "doc_id string, text string, value int, sig string, pos int")
    assert e.check(empty).similarity.count() == 0
    wide = spark.createDataFrame([("s", COPIED, 1, "x", 2)], "doc_id string, text string, value int, sig string, pos int")
    assert e.check(wide).similarity.first()["index"] > 0.5


def test_exclusion_needs_most_of_the_match(spark):
    m = spark.createDataFrame([("s", "a", 0, 9, 0, 9, 0, 100, 1.0, "verbatim"), ("s", "b", 0, 9, 0, 9, 0, 50, 1.0, "verbatim")], "sub_id string, src_id string, q0 int, q1 int, s0 int, s1 int, c0 int, c1 int, similarity double, match_type string")
    x = spark.createDataFrame([("s", 0, 60, "quote"), ("s", 0, 45, "citation")], "doc_id string, start int, end int, kind string")
    got = {r["src_id"]: r["exclusion_reason"] for r in scoring.apply_exclusions(m, x, ScoringConfig()).collect()}
    assert got == {"a": None, "b": "quote"}


def test_merge_spans_and_scorable(spark):
    s = spark.createDataFrame([("d", 0, 5), ("d", 5, 8), ("d", 2, 3), ("d", 10, 12), ("d", 10, 12), (None, 1, 2), ("d", None, 3)], "doc_id string, start int, end int")
    assert sorted((r["start"], r["end"]) for r in spans.merge_spans(s, ["doc_id"]).where("doc_id = 'd'").collect()) == [(0, 8), (10, 12)]
    t = spans.token_offsets(spark.createDataFrame([("d", "😀 ab cd ef"), ("n", None), ("e", "")], "doc_id string, text string"))
    assert [tuple(r)[1:] for r in t.orderBy("idx").collect()] == [(0, "ab", 2, 4), (1, "cd", 5, 7), (2, "ef", 8, 10)]
    left = spans.scorable(t, spark.createDataFrame([("d", 3, 6)], "doc_id string, start int, end int"))
    assert [r["tok"] for r in left.collect()] == ["ef"]


def test_exact_runs_split_on_diagonal_and_gap(spark):
    rows = [("s", "a", q, q + 3) for q in (0, 3, 8, 30)] + [("s", "a", 0, 9)]
    r = retrieve.exact_runs(spark.createDataFrame(rows, "sub_id string, src_id string, q int, s int"), 5)
    assert sorted(tuple(x)[2:] for x in r.collect()) == [(0, 4, 9, 13, 1), (0, 12, 3, 15, 3), (30, 34, 33, 37, 1)]


def test_detector_fixed_point_segments_and_caveats(spark):
    for p in PROFILES.values():
        row = {f: p.weights.get(f, (0, 0, 1))[1] for f in detect.FEATURES}
        df = spark.createDataFrame([tuple(row.values()) + (True,)], [*row, "has_likelihood"])
        import math
        assert df.select(detect.raw_score(p)).first()[0] == pytest.approx(1 / (1 + math.exp(-p.bias)))
    para = " ".join(f"Sentence number {i} speaks of topic {i * 3} and closes." for i in range(20))
    docs = spark.createDataFrame([("long", " ".join([para] * 4)), ("short", "Too short to say much."), ("none", None), ("empty", "")], "doc_id string, text string")
    a = {r["doc_id"]: r for r in detect.analyze(docs, CALIBRATED).collect()}
    assert len(a["long"]["segments"]) >= 3 and a["long"]["ci_low"] <= a["long"]["index"] <= a["long"]["ci_high"]
    s = [x["score"] for x in a["long"]["segments"]]
    assert min(s) - 1e-4 <= a["long"]["index"] <= max(s) + 1e-4
    assert len(a["short"]["segments"]) == 1 and any("short" in c for c in a["short"]["caveats"])
    assert a["none"]["segments"] == [] and len(a) == 4
    u = {r["doc_id"]: r for r in detect.analyze(docs, PROFILES["uncalibrated"]).collect()}
    assert u["long"]["ci_high"] - u["long"]["ci_low"] > a["long"]["ci_high"] - a["long"]["ci_low"]


def test_isotonic_fit_on_a_table(spark):
    df = spark.createDataFrame([(0.1, 0), (0.4, 1), (0.5, 0), (0.9, 1), (None, 1), (0.2, None)], "score double, label int")
    ends, values = detect.fit_calibration(df)
    assert values == sorted(values)
    profile = DetectorProfile("own", 0.0, {}, tuple(ends), tuple(values))
    assert profile.calibrated


def test_reports(spark):
    e = build(spark, {"a": SOURCE})
    docs = spark.createDataFrame([("s", "<b>" + PROSE + " " + COPIED)], "doc_id string, text string")
    about = docs.select("doc_id", F.lit("essay.txt").alias("source_name"), F.sha2("text", 256).alias("sha256"), F.lit("text/plain").alias("media_type"), F.array(F.lit(0)).alias("page_starts"))
    rows = report.reports(e.check(docs), e.analyze(docs), about, e.scoring)
    import json
    j = json.loads(report.to_json(rows).first()["json"])
    assert list(j)[:3] == ["report_version", "generated_at", "document"] and j["similarity"]["sources"][0]["source_id"] == "a" and "verdict" not in json.dumps(j)
    h = report.to_html(rows, docs).first()["html"]
    assert "<mark" in h and "&lt;b&gt;" in h


def test_embeddings(spark):
    d = spark.createDataFrame([(1, "red green blue"), (2, "blue green red"), (3, "something else"), (4, None), (5, "  ")], "doc_id bigint, text string")
    e = paraphrase.lexical_embedding(d)
    assert {r["doc_id"] for r in e.collect()} == {1, 2, 3}
    c = {(r["a_id"], r["b_id"]): r["cosine"] for r in paraphrase.sparse_cosine(e, e.where("doc_id = 1")).collect()}
    assert c[2, 1] == pytest.approx(1.0)
    v = paraphrase.dense(e, "doc_id", "v")
    assert len(v.first()["v"]) == 512


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("hello  world\r\n")
    (tmp_path / "sub" / "b.html").write_text("<p>hi</p>")
    (tmp_path / "c.bin").write_bytes(b"x")
    (tmp_path / "d.docx").write_bytes(b"broken")
    got = {r["source_name"]: r for r in files.load_dir(spark, str(tmp_path)).collect()}
    assert set(got) == {"a.txt", "b.html"} and got["a.txt"]["text"] == "hello world" and got["a.txt"]["doc_id"].startswith("sha256:")
    assert set(r["source_name"] for r in files.load_dir(spark, str(tmp_path), recursive=False).collect()) == {"a.txt"}
    assert files.load_path(spark, str(tmp_path / "c.bin")).first()["error"] == "unsupported"


def test_providers(spark):
    a = '{"results":[{"id":"W1","doi":"https://doi.org/10.1/A","title":"T","publication_year":2020,"abstract_inverted_index":{"b":[1],"a":[0,2]},"open_access":{"is_oa":true}},{"id":"W2","title":"x","abstract_inverted_index":null}]}'
    c = '{"message":{"items":[{"DOI":"10.1/a","URL":"u","title":["T"],"abstract":"<jats:p>x &amp; y</jats:p>","issued":{"date-parts":[[2019]]}},{"DOI":"10.2/b","title":["N"]}]}}'
    o = providers.openalex(spark.createDataFrame([(a,)], "payload string"))
    r = providers.crossref(spark.createDataFrame([(c,)], "payload string"))
    assert o.first()["text"] == "T. a b a" and o.count() == 1 and r.first()["text"] == "T. x & y" and r.count() == 1
    both = o.withColumn("n", F.lit(0)).unionByName(r.withColumn("n", F.lit(1)))
    one = providers.first_by_doi(both, ["n"]).collect()
    assert len(one) == 1 and one[0]["provider"] == "openalex"
    assert providers.as_raw(o).first()["doc_id"].startswith("sha256:")
    pay = lambda *p: spark.createDataFrame(list(enumerate(p)), "call int, payload string")
    d = providers.discover(pay("not json", a, a), pay(c.replace("&amp;", "&#8211;"), c)).collect()
    assert len(d) == 1 and d[0]["provider"] == "crossref" and "x \u2013 y" in d[0]["text"]
    assert providers.discover(pay("{}"), None).count() == 0
    assert providers.discover(pay(a), pay(c), only=("openalex",)).first()["provider"] == "openalex" and providers.discover(pay(a), pay(c), only=("crossref",)).first()["provider"] == "crossref"


def test_sources_left_out_and_stored_index(spark, tmp_path):
    e = build(spark, {"a": SOURCE, "b": SOURCE + " and more words than that"})
    subs = spark.createDataFrame([("s", COPIED)], "doc_id string, text string")
    e.save(str(tmp_path / "i"))
    stored = plans.Engine.load(spark, str(tmp_path / "i"))
    assert stored.corpus.inverted.groupBy("doc_id").count().count() == 2
    key = lambda c: sorted(tuple(r) for r in c.by_source.select("src_id", "words").collect())
    assert key(stored.check(subs)) == key(e.check(subs))
    assert {r["src_id"] for r in stored.check(subs, exclude=spark.createDataFrame([("a",)], "doc_id string")).by_source.collect()} == {"b"}
    one = stored.forget(spark.createDataFrame([("b",)], "doc_id string"))
    assert {r["src_id"] for r in one.check(subs).by_source.collect()} == {"a"}
    again = stored.add(spark.createDataFrame([("c", SOURCE)], "doc_id string, text string"))
    assert "c" in {r["src_id"] for r in again.check(subs).matches.collect()}


def test_paraphrases_with_any_embedder(spark):
    class Letters:
        def embed(self, texts):
            return [[t.count(c) + 0.1 for c in "abc"] for t in texts]

    q = spark.createDataFrame([("q1", "aaa b"), ("q2", ""), ("q3", None)], "doc_id string, text string")
    b = spark.createDataFrame([("x", "aaaa"), ("y", "bbbb"), ("z", "aaa b"), ("q1", "aaa b")], "doc_id string, text string")
    e = build(spark, {"a": SOURCE})
    got = [(r["doc_id"], r["src_id"], r["rank"]) for r in e.paraphrases(q, b, 2, Letters).orderBy("rank").collect()]
    assert got == [("q1", "z", 1), ("q1", "x", 2)]
    assert e.paraphrases(q, b, 1).first()["src_id"] == "z" and e.paraphrases(q.limit(0), b, 1).count() == 0


def test_language_model_windows_and_infilling():
    from palimpsest.operators import lm

    for n in (0, 1, 2, 7, 8, 9, 40):
        seen = [t for b, s in lm.windows(n, 8) for t in range(s, min(n, b + 8))]
        assert seen == list(range(1, n)) and all(s - b >= 4 or b == 0 for b, s in lm.windows(n, 8))
    words = " ".join(f"w{i}" for i in range(40))
    out = lm.infilled(words, 3, lambda m: " ".join(f"<extra_id_{i}> new" for i in range(m.count("<extra_id_"))))
    assert len(out) == 3 and all("new" in t and "extra_id" not in t for t in out) and lm.infilled("two words", 3, str) == []


def test_stream(spark, tmp_path):
    from palimpsest.streaming.watch import check_stream, score_drift

    e = build(spark, {"a": SOURCE})
    spark.createDataFrame([("s", COPIED)], "doc_id string, text string").write.parquet(str(tmp_path / "in"))
    seen = []
    q = check_stream(spark.readStream.schema("doc_id string, text string").parquet(str(tmp_path / "in")), e, lambda c, n: seen.append(c.similarity.first()["index"]), str(tmp_path / "cp"))
    q.awaitTermination()
    assert len(seen) == 1 and seen[0] > 0.5
    d = spark.createDataFrame([("2025-01-01 10:00:00", 0.5), ("2025-01-01 11:00:00", None)], "t string, score double").select(F.to_timestamp("t").alias("scored_at"), "score")
    assert score_drift(d, 0.3).first()["drifted"]


def test_sql_functions(spark):
    plans.register(spark)
    r = spark.sql("SELECT fold_text('ﬁn') AS f, token_hash('decomposition') AS h, band_for(0.8D) AS b").first()
    assert (r["f"], r["h"], r["b"]) == ("fin", 712203369825161900, "likely-ai")


def test_align_table_function(spark):
    plans.register(spark)
    r = spark.sql("SELECT * FROM align_texts(:a, :b)", args={"a": COPIED, "b": SOURCE}).collect()
    assert r and r[0]["match_type"] == "verbatim" and r[0]["q1"] - r[0]["q0"] >= 8
    assert spark.sql("SELECT * FROM align_texts(NULL, 'a')").count() == 0
    assert spark.sql("SELECT fnv1a32('ab') AS h, token_hash('') AS z").first()["z"] == 0


def test_command_line(spark, tmp_path, capsys):
    from palimpsest import cli

    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.txt").write_text(SOURCE)
    (tmp_path / "essay.txt").write_text(PROSE + " " + COPIED)
    idx = str(tmp_path / "idx")
    assert cli.main(["index", "build", "--corpus", str(tmp_path / "src"), "--out", idx]) == 0
    assert cli.main(["check", str(tmp_path / "essay.txt"), "--index", idx, "--json", str(tmp_path / "r.json"), "--html", str(tmp_path / "r.html"), "--add-to-corpus"]) == 0
    import json
    r = json.loads((tmp_path / "r.json").read_text())
    assert r["similarity"]["index"] > 0.12 and r["similarity"]["sources"][0]["source_label"] == "a.txt" and (tmp_path / "r.html").exists()
    assert list(r["ai_writing"]["segments"][0]) == ["span", "words", "score", "band"]
    assert plans.Engine.load(spark, idx).corpus.meta.where("kind = 'student'").count() == 1
    assert cli.main(["forget", "sha256:none", "--index", idx]) == 1
    assert cli.main(["forget", r["document"]["id"], "--index", idx]) == 0
    assert cli.main(["index", "stats", "--index", idx]) == 0
    assert '"documents": 1' in capsys.readouterr().out


def test_table_function(spark):
    plans.register(spark)
    assert [tuple(r) for r in spark.sql("SELECT * FROM tokenize('The bank')").collect()] == [(0, "the", 0, 3), (1, "bank", 4, 8)]
    assert spark.sql("SELECT * FROM tokenize(NULL)").count() == 0


def test_positions_are_not_broadcast_by_the_size_of_their_file(spark, tmp_path):
    spark.range(50_000).selectExpr("'s' AS sub_id", "'a' AS src_id", "cast(id AS int) AS pos").write.parquet(str(tmp_path / "cover"))
    cover = spark.read.parquet(str(tmp_path / "cover"))
    m = spark.createDataFrame([("s", "a", 1.0, "verbatim", False)], "sub_id string, src_id string, similarity double, match_type string, excluded boolean")
    sizes = spark.createDataFrame([("s", 60_000, 60_000)], "sub_id string, total_words int, scorable_words int")
    b = scoring.breakdown(m, cover, sizes)
    assert "SortMergeJoin [sub_id" in b._jdf.queryExecution().executedPlan().toString() and b.first()["unique_words"] == 50_000


def test_matches_carry_their_places_and_exclusions(spark):
    quoted = f'{COPIED} He wrote: "{SOURCE[:300].replace(chr(34), "")}" and no more.'
    subs = spark.createDataFrame([("s", quoted), ("t", COPIED), ("e", ""), ("n", None)], "doc_id string, text string")
    e = build(spark, {"a": SOURCE})
    p = spans.prepared(subs, e.corpus.cfg, kinds=e.scoring.kinds)
    norm = {r["doc_id"]: r for r in spans.normalized(subs).collect()}
    for r in p.collect():
        at, n = list(itertools.accumulate(r["gaps"])), norm[r["doc_id"]]
        assert list(zip(at[::2], at[1::2])) == [(t["start"], t["end"]) for t in n["tokens"]] and r["exclusions"] == n["exclusions"]
        assert r["lost"] == [i for i, t in enumerate(n["tokens"]) if any(x["start"] < t["end"] and t["start"] < x["end"] for x in n["exclusions"])]
    pairs = spark.createDataFrame([(d, "a") for d in norm], "sub_id string, src_id string")
    m = align.located(pairs, p, e.corpus.docs, e.corpus.cfg, e.alignment)
    want = align.passages(pairs, retrieve.seeds(p, e.corpus.docs, pairs), p, e.corpus.docs, e.corpus.cfg, e.alignment)
    keys = ("sub_id", "src_id", "q0", "q1", "s0", "s1", "similarity", "match_type")
    assert sorted(tuple(x[k] for k in keys) for x in m.collect()) == sorted(tuple(x[k] for k in keys) for x in want.collect()) and m.count() > 1
    x = p.select("doc_id", F.explode("exclusions").alias("x")).select("doc_id", "x.*")
    got, want = ({(r["sub_id"], r["q0"], r["excluded"], r["exclusion_reason"]) for r in d.collect()} for d in (scoring.judged(m, e.scoring), scoring.apply_exclusions(m, x, e.scoring)))
    assert got == want
