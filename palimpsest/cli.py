"""Command line: index build, index stats, check, forget. Thin over Engine; a cluster is whatever spark-submit names."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import functions as F

from palimpsest.config import PROFILES, FingerprintConfig, ScoringConfig
from palimpsest.operators.cut import written
from palimpsest.operators.lm import TransformersLM
from palimpsest.plans import report
from palimpsest.plans.engine import Engine
from palimpsest.session import session
from palimpsest.sources import files


def _build(spark, a) -> int:
    e = Engine.build(files.load_dir(spark, a.corpus), cfg=FingerprintConfig(k=a.k, w=a.w))
    e.save(a.out)
    s = Engine.load(spark, a.out).corpus.stats().first().asDict()
    print(json.dumps(s | {"added": s["documents"]}, indent=2))
    return 0


def _stats(spark, a) -> int:
    print(json.dumps(Engine.load(spark, a.index).corpus.stats().first().asDict(), indent=2))
    return 0


def _check(spark, a) -> int:
    cfg = ScoringConfig(not a.include_quotes, not a.include_citations, not a.include_bibliography, a.min_words, allowlist=frozenset(a.allow or ()))
    model = (lambda name=a.lm: TransformersLM(name)) if a.lm else None
    e = Engine.load(spark, a.index, scoring=cfg, profile=PROFILES[a.profile], model=model)
    docs = written(files.load_path(spark, a.path).where("error is null"))
    if docs.isEmpty():
        print(f"cannot read {a.path}", file=sys.stderr)
        return 1
    rows = written(report.reports(e.check(docs), e.analyze(docs), docs, cfg))
    text = report.to_json(rows).first()["json"]
    r = json.loads(text)
    if a.json:
        Path(a.json).write_text(text)
    if a.html:
        Path(a.html).write_text(report.to_html(rows, docs).first()["html"])
    s, w = r["similarity"], r["ai_writing"]
    print(f"similarity {100 * s['index']:.1f}%  ({s['matched_words']} / {s['scorable_words']} scorable words, {len(s['sources'])} sources)")
    print(f"ai-writing {100 * w['index']:.1f}%  band={w['band']}  range {100 * w['confidence_interval'][0]:.0f}%-{100 * w['confidence_interval'][1]:.0f}%  {'calibrated' if w['calibrated'] else 'UNCALIBRATED'}")
    print(f"review priority: {r['review_priority']}")
    for c in r["caveats"]:
        print(f"  note: {c}")
    if a.print_json:
        print(text)
    if a.add_to_corpus:
        _replace(spark, e.add(docs, on_duplicate="ignore", kind="student"), a.index)
    return 0


def _replace(spark, e: Engine, path: str) -> None:
    """Written beside the index, which it then replaces by a change of names; the old one goes last."""
    e.save(f"{path}.new")
    sc = spark.sparkContext
    at = lambda x: sc._jvm.org.apache.hadoop.fs.Path(x)
    fs = at(path).getFileSystem(sc._jsc.hadoopConfiguration())
    fs.delete(at(f"{path}.old"), True)
    fs.rename(at(path), at(f"{path}.old"))
    fs.rename(at(f"{path}.new"), at(path))
    fs.delete(at(f"{path}.old"), True)
    spark.catalog.refreshByPath(path)


def _forget(spark, a) -> int:
    e = Engine.load(spark, a.index)
    if e.corpus.meta.where(F.col("doc_id") == a.doc_id).isEmpty():
        print(f"no such document: {a.doc_id}", file=sys.stderr)
        return 1
    _replace(spark, e.forget(spark.createDataFrame([(a.doc_id,)], "doc_id string")), a.index)
    print(f"removed {a.doc_id}, index now holds {Engine.load(spark, a.index).corpus.meta.count()} documents")
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="palimpsest", description="Document originality on Spark.")
    subs = p.add_subparsers(required=True)
    index = subs.add_parser("index").add_subparsers(required=True)
    b = index.add_parser("build", help="fingerprint a directory of sources")
    b.add_argument("--corpus", required=True)
    b.add_argument("--out", required=True)
    b.add_argument("--k", type=int, default=5)
    b.add_argument("--w", type=int, default=4)
    b.set_defaults(run=_build)
    s = index.add_parser("stats", help="statistics of an index")
    s.add_argument("--index", required=True)
    s.set_defaults(run=_stats)
    c = subs.add_parser("check", help="originality report of one file")
    c.add_argument("path")
    c.add_argument("--index", required=True)
    for flag in ("--json", "--html", "--lm"):
        c.add_argument(flag)
    for flag in ("--print-json", "--include-quotes", "--include-citations", "--include-bibliography", "--add-to-corpus"):
        c.add_argument(flag, action="store_true")
    c.add_argument("--min-words", type=int, default=8)
    c.add_argument("--allow", action="append")
    c.add_argument("--profile", choices=sorted(PROFILES), default="uncalibrated")
    c.set_defaults(run=_check)
    f = subs.add_parser("forget", help="remove a document from an index")
    f.add_argument("doc_id")
    f.add_argument("--index", required=True)
    f.set_defaults(run=_forget)
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    return a.run(session(), a)


if __name__ == "__main__":
    sys.exit(main())
