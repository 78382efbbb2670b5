"""Problem 10: what a template, a server or a page without its scripts left instead of content.

Lines are normalised (case, digits, spaces) and counted by host over all records. A line is recurrent boilerplate of its
host if the share of the host's records that hold it is BOILERPLATE_SHARE or more beyond chance (the lower end of a 95 %
interval, so a host of two records can have boilerplate and a single record cannot). Boilerplate is subtracted. What
is left, the residual, decides: a record is excluded if a line of it holds an unfilled placeholder, filler text, an error
message or a notice that scripts or cookies are needed, or if boilerplate is all the record has and that holds it. A line
in which an author talks about such things, or quotes them, is no evidence.
So a banner that every page of a host carries excludes none of them, while the page that is nothing but the banner goes.

Null and empty texts are never found; records of a null host have no pages beside them, so nothing is subtracted from them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, present, spread, table

BOILERPLATE_SHARE = 0.3
Z = 1.645

# What unfilled slots look like in common template languages and forms.
PLACEHOLDER = re.compile(
    r"\{\{\s*[A-Za-z_][\w. ]*\}\}|\$\{[A-Za-z_][\w.]*\}|%%[A-Za-z_]+%%|(?<![\w%])%[A-Z_]{3,}%(?!\w)|<%=?\s*[\w.]+\s*%>"
    r"|<<[A-Za-z][A-Za-z _-]*>>|(?<!\S)\{\d\}(?=[\s,.;:!?)]|$)|(?<!\S)%[sd](?=[\s,.;:!?)]|$)|_{5,}"
    r"|\[(?:insert|add|enter|type|put|your|fill in|write|name|title|date|author|company|todo)\b[^\]\n]*\]|\[[A-Z]+(?: [A-Z]+)+\]"
    r"|^\s*(?:TODO|TBD|FIXME|TBA)\s*:", re.I | re.M)
PLACEHOLDER_CASED = re.compile(r"\{\{|\$\{|%%|<%|<<|\{\d\}|%[sd]|__|\[|^\s*(?:TODO|TBD|FIXME|TBA)\s*:|%[A-Z_]{3,}%", re.M)
# The usual filler words.
LOREM = frozenset(
    "lorem ipsum dolor sit amet consectetur consectetuer adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim "
    "veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum "
    "eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum vestibulum ante "
    "vel purus".split())
LOREM_MARKS = frozenset("lorem ipsum dolor amet consectetur consectetuer adipiscing eiusmod incididunt aliqua vestibulum dolore labore tempor".split())
MASH = re.compile(r"(?:asdf|qwer|zxcv|hjkl|jkl|uiop|qwertz?y?|foo|bar|baz|bla+h?|test|abc|xyz|x{3,}|z{3,}|a{3,}|\d+)+", re.I)
LOREM_HINTS = ("lorem", "ipsum", "dolor", "consectetur", "adipiscing", "eiusmod", "vestibulum")
MASH_HINT = re.compile(r"asdf|qwer|zxcv|hjkl|jkl|uiop|foo|bar|bla|test|abc|xyz|xxx|zzz|aaa")
# How servers report a failure, in some languages.
ERROR = re.compile(
    r"(?:(?:error|erreur|fehler|errore|erro|błąd|ошибка|http)[\s/:.-]*(?:\d\.\d\s+)?)?[45]\d\d\s*(?:[:–—-]\s*)?"
    r"(?:not found|bad gateway|bad request|forbidden|unauthori[sz]ed|service (?:temporarily )?unavailable|gateway time-?out|internal server error|"
    r"too many requests|request time-?out|gone|la page|page|seite|p[áa]gina|strona|страница|nicht|no |non |introuvable)"
    r"|(?:error|erreur|fehler)\s+[45]\d\d\b"
    r"|(?:page|file|seite|datei) (?:not|nicht) (?:found|gefunden)\b|página no encontrada|página não encontrada|pagina non trovata|pagina niet gevonden|"
    r"nie znaleziono strony|strona nie (?:została znaleziona|istnieje)|страница не найдена|η σελίδα δεν βρέθηκε|找不到页面|页面不存在|ページが見つかりません|페이지를 찾을 수 없습니다|"
    r"page introuvable|cette page n'existe"
    r"|access denied|zugriff verweigert|accès refusé|acceso denegado|permission denied"
    r"|(?:oops|sorry)[!,.]? (?:we|the page|something|this page|an error)|internal server error|service unavailable"
    r"|too many requests|your session has (?:expired|timed out)|traceback \(most recent call last\)|fatal error:|(?:parse|syntax) error:"
    r"|(?:warning|notice): .{0,200} on line \d+|exception in thread|(?:\w+\.)*\w*(?:error|exception): .{0,120}$"
    r"|the requested (?:url|page|resource)\b.{0,120}(?:not found|could not|does not|unavailable)|internal error id \w+"
    r"|this (?:site|page) can.t be reached|we can.t find (?:that|the|this) page", re.I)
# Notices that scripts or cookies are needed.
SCRIPTS = re.compile(r"javascript|\bscripts?\b|\bcookies?\b", re.I)
NOTICE = re.compile(
    r"(?:please|bitte|veuillez|merci d|por favor|proszę|per favore|пожалуйста)\b|(?:you need|you must|you have) to\b|you must\b|your browser|enable\b|turn on\b|activate\b|allow\b|activ(?:ez|a|e)\b|"
    r"habilit|włącz|включите|aktivieren|this (?:site|page|app|website|application|content) (?:requires|needs|uses|works)|"
    r"(?:javascript|scripts?|cookies?) (?:is|are|must be|has been|have been) (?:required|disabled|needed|turned off|not|enabled)|we(?:'re| are) sorry|checking (?:if|your)|"
    r"(?:we|this site) use cookies|noscript|diese seite|cette page|esta página", re.I)
REPEATS = 4
QUOTED = re.compile(r"\"[^\"\n]{0,120}\"|“[^”\n]{0,120}”|«[^»\n]{0,120}»|„[^“”\n]{0,120}[“”]|`[^`\n]{0,120}`")
TALK = re.compile(r"\b(?:template language|the format|the notation|the syntax|the string|the words?|the phrase|stands? for|is written|writes|wrote|means|called|where the value)\b", re.I)
SENTENCE = re.compile(r"[^.!?\n]+(?:[.!?]+(?=\s|$)|$|[.!?])+", re.M)
WORD = re.compile(r"[^\W\d_]+")


def evidence(line: str) -> str | None:
    """The kind of evidence a line (paragraph) holds: placeholder, filler, error, scripts or None."""
    if not line.strip():
        return None
    own = QUOTED.sub(" ", line)
    start = own.strip()
    if PLACEHOLDER_CASED.search(own):
        for s in re.split(r"(?<=[.!?])\s+", own):
            if PLACEHOLDER.search(s) and not TALK.search(s):
                if re.match(r"\s*(?:todo|tbd|fixme|tba)\b", s, re.I) and not re.match(r"\s*(?:TODO|TBD|FIXME|TBA)\s*:", s) and not PLACEHOLDER.search(re.sub(r"^\s*\w+\s*:", "", s)):
                    continue
                return "placeholder"
    if re.match(ERROR, start):
        return "error"
    if SCRIPTS.search(own):
        for s in re.split(r"(?<=[.!?])\s+", own):
            if SCRIPTS.search(s) and NOTICE.match(s.strip()):
                return "scripts"
    low = own.lower()
    lorem, mash = any(x in low for x in LOREM_HINTS), MASH_HINT.search(low)
    w = WORD.findall(low) if lorem or mash else []
    if len(w) >= 4:
        if lorem and sum(x in LOREM_MARKS for x in w) >= 3 and sum(x in LOREM for x in w) >= 0.5 * len(w):
            return "filler"
        if mash and sum(bool(MASH.fullmatch(x)) for x in w) >= 0.6 * len(w):
            return "filler"
    for s in SENTENCE.findall(own) if "lorem ipsum" in low else ():
        x = WORD.findall(s.lower())
        if len(x) >= 5 and sum(t in LOREM for t in x) >= 0.6 * len(x):
            return "filler"
    if own.count(".") + own.count("!") + own.count("?") >= REPEATS:
        run, last = 0, None
        for s in re.split(r"[.!?]\s*", own):
            run = run + 1 if s == last and len(s) >= 4 else 1
            if run >= REPEATS:
                return "filler"
            last = s
    return None


def normal(line: str) -> str:
    return " ".join(re.sub(r"\d+", "0", line.lower()).split())


def _lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for i, host, text in zip(b["_id"], b["host"], b["_t"]):
            found: dict[int, str | None] = {}
            for line in text.split("\n"):
                if (n := normal(line)):
                    k = xxhash.xxh3_64_intdigest(n) - 2**63
                    found[k] = found.get(k) or evidence(line)
            rows += [(i, host, k, e) for k, e in found.items()]
        yield pd.DataFrame(rows, columns=["_id", "host", "line", "kind"])


def residue(docs: DataFrame, ident: str = "doc_id", text: str = "text", host: str = "collection") -> DataFrame:
    """(ident, kinds): records to leave out and what was found in them, sorted."""
    kind = docs.schema[ident].dataType.simpleString()
    d = spread(docs.select(F.col(ident).alias("_id"), F.col(host).cast("string").alias("host"), F.col(text).alias("_t")).where(present("_t")))
    lines = materialize(d.mapInPandas(_lines, f"_id {kind}, host string, line bigint, kind string"))
    # hosts and lines are counted before any shuffle; a host that holds a third of all rows is a few sums
    records = d.groupBy("host").agg(F.count("*").alias("records"))
    often = lines.groupBy("host", "line").agg(F.count("*").alias("n")).where("n > 1").join(records, "host")
    n, p = F.col("records").cast("double"), F.col("n") / F.col("records")
    lower = (p + Z * Z / (2 * n) - Z * F.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n))) / (1 + Z * Z / n)
    often = often.where(lower >= BOILERPLATE_SHARE).select("host", "line")
    often = often.select(F.col("host").alias("h"), F.col("line").alias("l"))
    marked = lines.where("kind is not null")
    on = (F.col("host") == F.col("h")) & (F.col("line") == F.col("l"))
    kept = marked.join(often, on, "left_anti")
    # records of boilerplate only: nothing would be left of them, so they stand as they are
    doubtful = marked.join(often, on, "left_semi").select("_id", "line", "kind")
    whole = (lines.join(doubtful.select("_id").distinct(), "_id", "left_semi").join(often, on, "left")
             .groupBy("_id").agg(F.sum(F.col("l").isNull().cast("int")).alias("rest")).where("rest = 0").select("_id"))
    found = kept.select("_id", "kind").unionByName(doubtful.join(whole, "_id", "left_semi").select("_id", "kind"))
    return found.groupBy("_id").agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds")).select(F.col("_id").alias(ident), "kinds")


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return residue(table(spark, sf, "documents").select("doc_id", "text", "collection")).select("doc_id")
