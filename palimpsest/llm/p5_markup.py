"""Problem 5: markup residue (HTML, JATS, Markdown, wiki, LaTeX) turned into clean text.

A text is read as a stream of markup tokens and text slots. Blocks that may hold foreign signs are
taken out first, in the order code, formula, list, so nothing inside them counts again; then
headings, then everything else. Each token carries its element (heading, list, code, formula,
other) and its clean form: headings become "# ...", items "- ...", code stays in a fence,
formulas stand between dollar signs, all other markup goes and its text stays.

The wrapper of a host (`wrappers`) is a union-free expression inferred from the token streams of its
records: repeated groups are folded to (...)+, and streams are aligned one after another, what only
one side has becoming (...)?. It shows which markup is the host's frame. It cannot name elements, and
Markdown, wiki and LaTeX records come from hosts with one record or none, so elements are read from
the tokens themselves, for every record alike.

Null text has no elements and stays null; empty text stays empty. Signs that an author uses as such
(prices, comparisons, tickets, set braces, file names, page numbers between dashes) are no markup.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import present, spread, table

NS = r"(?:jats:|mml:|ns\d?:)?"
X = re.I | re.S
CODE = [
    re.compile(r"<pre\b[^<>]*>(?:\s*<code\b[^<>]*>)?(?P<b>(?:(?!<pre\b).)*?)(?:</code>\s*)?</pre\s*>", X),
    re.compile(r"<(?P<t>syntaxhighlight|source)\b[^<>]*>(?P<b>(?:(?!<(?P=t)\b).)*?)</(?P=t)\s*>", X),
    re.compile(r"^(?P<f>```+|~~~+)[^\n]*\n(?P<b>.*?)^(?P=f)[ \t]*$", re.M | re.S),
    re.compile(r"\\begin\{(?P<t>verbatim\*?|lstlisting|minted)\}(?:\[[^\]\n]*\])?(?:\{\w+\})?(?P<b>(?:(?!\\begin\{(?P=t)\}).)*?)\\end\{(?P=t)\}", re.S),
    re.compile(r"<(?P<t>" + NS + r"code)\b[^<>]*>(?P<b>[^<]*\n.*?)</(?P=t)\s*>", X),
]
FORMULA = [
    re.compile(r"<span\b[^>]*class=[\"']?[^\"'<>]*math[^<>]*>(?P<b>(?:(?!<span\b).)*?)</span\s*>", X),
    re.compile(r"<(?P<t>" + NS + r"(?:disp-formula|inline-formula))\b[^<>]*>(?P<b>(?:(?!<(?P=t)\b).)*?)</(?P=t)\s*>", X),
    re.compile(r"<(?P<t>" + NS + r"(?:tex-math|math))\b[^<>]*>(?P<b>(?:(?!<(?P=t)\b).)*?)</(?P=t)\s*>", X),
    re.compile(r"\\begin\{(?P<t>(?:equation|align|gather|multline|eqnarray|displaymath|math)\*?)\}(?P<b>(?:(?!\\begin\{(?P=t)\}).)*?)\\end\{(?P=t)\}", re.S),
    re.compile(r"\\\[(?P<b>(?:(?!\\\[).)+?)\\\]|\\\((?P<c>(?:(?!\\\().)+?)\\\)", re.S),
    re.compile(r"\$\$(?P<b>[^$]+?)\$\$", re.S),
    re.compile(r"(?<![\\$\w])\$(?=[^\s$])(?P<b>[^$\n]*?[\\^_={][^$\n]*?)(?<=[^\s\\])\$(?![\d$])"),
]
LIST = [
    re.compile(r"<(?P<t>" + NS + r"(?:ul|ol|dl|list|def-list))\b[^<>]*>(?P<b>(?:(?!<(?P=t)\b).)*?)</(?P=t)\s*>", X),
    re.compile(r"\\begin\{(?P<t>itemize|enumerate|description)\*?\}(?:\[[^\]\n]*\])?(?P<b>(?:(?!\\begin\{(?P=t)\*?\}).)*?)\\end\{(?P=t)\*?\}", re.S),
]
ITEM = re.compile(r"<(?:" + NS + r")?(?:li|list-item|dt|dd|def-item)\b[^<>]*>|\\item\b(?:\[[^\]\n]*\])?", re.I)
# items in the line: at least two neighbours with one kind of mark
BULLETS = re.compile(r"(?:^[ \t]{0,6}(?P<m>[-*+•])(?P=m){0,2}[ \t]+(?!\d+[ \t]*-[ \t]*$)\S[^\n]*(?:\n[ \t]+\S[^\n]*)*(?:\n+|\Z)){1}(?:[ \t]{0,6}(?P=m)(?:(?P=m){0,2})[ \t]+(?!\d+[ \t]*-[ \t]*$)\S[^\n]*(?:\n[ \t]+\S[^\n]*)*(?:\n+|\Z))+", re.M)
HASHES = re.compile(r"(?:^#{1,3}[ \t]+\S[^\n]*(?:\n|\Z)){2,}", re.M)
NUMBERS = re.compile(r"(?:^[ \t]{0,6}\d{1,3}[.)][ \t]+\S[^\n]*(?:\n[ \t]+\S[^\n]*)*(?:\n+|\Z)){2,}", re.M)
NUMBER = re.compile(r"^[ \t]{0,6}(\d{1,3})[.)][ \t]", re.M)
HEAD = re.compile(r"<head\b[^<>]*>(?:(?!<head\b).)*?</head\s*>|<(?P<t>style|script)\b[^<>]*>(?:(?!<(?P=t)\b).)*?</(?P=t)\s*>|<!doctype[^<>]*>|<\?xml[^>]*\?>", X)
HEADING = [
    re.compile(r"<(?P<t>" + NS + r"(?:h[1-6]|title|article-title|subtitle))\b[^<>]*>(?P<b>(?:(?!<(?P=t)\b).)*?)</(?P=t)\s*>", X),
    re.compile(r"\\(?:part|chapter|(?:sub){0,2}section|(?:sub)?paragraph)\*?\s*(?:\[[^\]\n]*\])?\{(?P<b>(?:[^{}]|\{[^{}]*\})*)\}"),
    re.compile(r"^[ \t]{0,3}#{1,6}[ \t]+(?P<b>[^\n#][^\n]*?)[ \t]*#*[ \t]*$", re.M),
    re.compile(r"^(?P<e>={1,6})[ \t]*(?P<b>[^=\n][^\n]*?[^=\n]|[^=\n])[ \t]*(?P=e)[ \t]*$", re.M),
    re.compile(r"(?:^|(?<=\n))(?P<b>[^\n=#|<>*-][^\n]*)\n(?:={3,}|-{3,})[ \t]*(?=\n|\Z)"),
]
COMMENT = re.compile(r"<!--(?:(?!<!--).)*?-->", re.S)
TABLE = re.compile(r"^\|[^\n]*\|[ \t]*\n\|[ \t:|-]*-[ \t:|-]*\|[ \t]*(?:\n\|[^\n]*\|[ \t]*)*", re.M)
OTHER: list[tuple[re.Pattern[str], str]] = [
    (COMMENT, ""),
    (re.compile(r"\{\|(?:(?!\{\|).)*?^\|\}", re.S | re.M), ""),
    (re.compile(r"<(?P<t>ref)\b[^>]*?(?:/>|>.*?</(?P=t)\s*>)", X), ""),
    (re.compile(r"<br\s*/?>\n?|</(?:[a-z]+:)?p\s*>\n?", re.I), "\n"),
    (re.compile(r"</?[A-Za-z][\w:.-]*(?:\s+[^<>]*)?/?>"), ""),
    (re.compile(r"\{\{(?:[^{}\n|]+\|[^{}]*|[a-z][\w-]*)\}\}"), ""),
    (re.compile(r"\[\[(?:Category|File|Image|Datei|Kategorie|Catégorie):[^\]\n]*\]\]", re.I), ""),
    (re.compile(r"\[\[(?:[^\]\n|]*\|)?(?P<b>[^\]\n|]*)\]\]"), r"\g<b>"),
    (re.compile(r"!?\[(?P<b>[^\]\n]*)\]\([^)\s]+(?:\s+\"[^\"\n]*\")?\)"), r"\g<b>"),
    (re.compile(r"\[https?://\S+[ ]+(?P<b>[^\]\n]*)\]"), r"\g<b>"),
    (re.compile(r"'''''(?P<b>[^'\n](?:.*?[^'\n])?)'''''|'''(?P<c>[^'\n](?:.*?[^'\n])?)'''|(?<!')''(?P<d>[^'\s](?:[^\n]*?[^'\s])?)''(?!')"), r"\g<b>\g<c>\g<d>"),
    (re.compile(r"(?<![\w*\\])(?P<m>\*{1,3})(?=[^\s*])(?P<b>[^*\n]*?)(?<=[^\s*\\])(?P=m)(?![\w*])"), r"\g<b>"),
    (re.compile(r"(?<![\w\\])(?P<m>_{1,3})(?=[^\s_])(?P<b>[^_\n]*?)(?<=[^\s_\\])(?P=m)(?!\w)"), r"\g<b>"),
    (re.compile(r"~~(?=\S)(?P<b>[^~\n]*?)(?<=\S)~~"), r"\g<b>"),
    (re.compile(r"(?<!`)`(?P<b>[^`\n]+)`(?![`'])"), r"\g<b>"),
    (re.compile(r"``(?P<b>[^`'\n]+)''"), r'"\g<b>"'),
    (re.compile(r"[~ ]?\\(?:cite[a-z]*|ref|eqref|label|footnote|index|pageref|autoref|nocite|thanks)\*?(?:\[[^\]\n]*\])*\{(?:[^{}]|\{[^{}]*\})*\}"), ""),
    (re.compile(r"\\(?:textbf|textit|emph|texttt|textsc|underline|textrm|textsf|mbox|text|href\{[^{}]*\}|url|uppercase)\s*\{(?P<b>(?:[^{}]|\{[^{}]*\})*)\}"), r"\g<b>"),
    (re.compile(r"\\(?:begin|end)\{[A-Za-z]+\*?\}(?:\[[^\]\n]*\])?|\\(?:documentclass|usepackage|title|author|date|input|include|includegraphics|bibliography\w*|vspace|hspace|caption)\*?(?:\[[^\]\n]*\])?\{[^{}]*\}"), ""),
    (re.compile(r"\\(?:item|par|noindent|maketitle|tableofcontents|newpage|clearpage|bigskip|medskip|smallskip|centering|large|Large|small|bf|it|em|LaTeX|TeX|ldots|dots|quad|qquad)\b"), ""),
    (re.compile(r"\\(?P<b>[%&#$_{}])"), r"\g<b>"),
    (re.compile(r"\\\\(?=\s|$)", re.M), "\n"),
    (re.compile(r"&(?:#\d{1,7}|#x[0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,20});"), "&"),
]
# a backslash before a letter is markup only with an argument
COMMAND = re.compile(r"\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?\{(?P<b>[^{}\n]*)\}")
ANY = re.compile(r"[<>\\$*_#=~`'\[{&|+•-]|^[ \t]*\d+[.)]\s", re.M)
HOLE = "\ue000{}\ue001"
MARK = "\ue002"
HOLES = re.compile("\ue000(\\d+)\ue001")


def _entities(m: re.Match) -> str:
    return html.unescape(m[0]).replace("\xa0", " ")


def convert(text: str | None) -> tuple[set[str], str | None]:
    """(elements in the text, clean text)."""
    if not text or not ANY.search(text):
        return set(), text
    found: set[str] = set()
    kept: list[str] = []

    def take(kind: str, form):
        def f(m: re.Match) -> str:
            found.add(kind)
            kept.append(form(m))
            return HOLE.format(len(kept) - 1)
        return f

    def body(m: re.Match) -> str:
        g = m.groupdict()
        return next((g[k] for k in "bcd" if g.get(k) is not None), "")

    def plain(s: str) -> str:
        s = HOLES.sub(lambda m: kept[int(m[1])], s)
        return " ".join(html.unescape(_strip(s)).split())

    t = text
    for p in CODE:
        t = p.sub(take("code", lambda m: "```\n" + html.unescape(re.sub(r"</?[A-Za-z][^<>]*>", "", body(m))).strip("\n") + "\n```"), t)
    for p in FORMULA:
        t = p.sub(take("formula", lambda m: "$" + " ".join(html.unescape(re.sub(r"</?[A-Za-z][^<>]*>", " ", _math(body(m), m[0]))).split()) + "$"), t)
    for p in LIST:
        while True:  # inner lists first
            n = p.sub(take("list", lambda m: "\n".join("- " + x for s in ITEM.split(body(m)) if (x := plain(s)))), t)
            if n == t:
                break
            t = n

    def items(m: re.Match) -> str:
        found.add("list")
        kept.append("\n".join("- " + x for s in m[0].split("\n") if (x := plain(re.sub(r"^\s*(?:[-*+•#]+|\d+[.)])\s+", "", s)))))
        return HOLE.format(len(kept) - 1) + m[0][len(m[0].rstrip("\n")):]

    t = BULLETS.sub(items, t)
    t = HASHES.sub(items, t)
    t = NUMBERS.sub(lambda m: items(m) if (n := [int(x) for x in NUMBER.findall(m[0])])[1] == n[0] + 1 else m[0], t)
    t, n = HEAD.subn("", t)
    if n:
        found.add("other")
    t, n = TABLE.subn(lambda m: "\n".join("\t".join(c.strip() for c in r.strip().strip("|").split("|")) for r in m[0].split("\n") if not re.fullmatch(r"[|\s:-]+", r)), t)
    if n:
        found.add("other")
    for p in HEADING:
        t, n = p.subn(lambda m: f"\n{MARK} " + m["b"].strip() + "\n", t)
        if n:
            found.add("heading")
    for p, form in OTHER:
        t, n = p.subn(_entities if form == "&" else form, t)
        if n:
            found.add("other")
    t, n = COMMAND.subn(r"\g<b>", t)
    if n:
        found.add("other")
    if found:
        if "~" in t and "\\" in text:
            t = re.sub(r"(?<=\S)~(?=\S)", " ", t)
        while HOLES.search(t):
            t = HOLES.sub(lambda m: kept[int(m[1])], t)
        t = re.sub(r"[ \t]+\n", "\n", t.replace(MARK, "#"))
        t = re.sub(r"\n{3,}", "\n\n", t).strip()
    else:
        t = text
    return found, t


def _math(inner: str, whole: str) -> str:
    alt = re.search(r"alttext=[\"']([^\"']+)", whole)
    tex = re.search(r"<[^<>]*tex-math[^<>]*>(.*?)<", whole, re.S)
    return alt[1] if alt else tex[1] if tex else re.sub(r"^\s*\\[\[(]|\\[\])]\s*$", "", inner)


def _strip(s: str) -> str:
    for p, form in OTHER:
        s = p.sub(_entities if form == "&" else form, s)
    return s


RESULT = T.StructType([T.StructField("elements", T.ArrayType(T.StringType())), T.StructField("clean_text", T.StringType())])


@F.pandas_udf(RESULT)
def convert_udf(s: pd.Series) -> pd.DataFrame:
    out = [convert(t) for t in s]
    return pd.DataFrame({"elements": [sorted(e) for e, _ in out], "clean_text": [t for _, t in out]})


def clean(df: DataFrame, text: str = "text") -> DataFrame:
    """Every row and column, plus elements (sorted array) and clean_text."""
    return spread(df).withColumn("_m", convert_udf(F.col(text))).withColumns({"elements": F.col("_m.elements"), "clean_text": F.col("_m.clean_text")}).drop("_m")


# --- wrappers -------------------------------------------------------------------------------

STREAM = re.compile(r"<!--.*?-->|</?([A-Za-z][\w:.-]*)[^<>]*>|[^<]+|<", re.S)


def stream(text: str) -> list[str]:
    """Tag names and text slots, in order."""
    out: list[str] = []
    for m in STREAM.finditer(text):
        tag = m[1]
        if tag:
            out.append(("</" if m[0][1] == "/" else "<") + tag.lower() + ">")
        elif not m[0].startswith("<!--") and m[0].strip() and (not out or out[-1] != "#"):
            out.append("#")
    return out


def fold(seq: list[str], longest: int = 24) -> list[str]:
    """Neighbouring repetitions become one group (...)+, shortest groups first."""
    for width in range(1, min(longest, len(seq) // 2) + 1):
        out: list[str] = []
        i = 0
        while i < len(seq):
            unit = seq[i:i + width]
            n = 1
            while len(unit) == width and seq[i + n * width:i + (n + 1) * width] == unit:
                n += 1
            if n > 1 and unit != ["#"]:
                inner = " ".join(unit)
                out.append(inner if width == 1 and inner.endswith(")+") else f"({inner})+")
                i += n * width
            else:
                out.append(seq[i])
                i += 1
        seq = out
    return seq


def align(a: list[str], b: list[str]) -> list[str]:
    """One union-free expression for both: what only one has is optional."""
    def bare(x: str) -> str:
        return x[1:-2] if x.startswith("(") and x.endswith((")?", ")+")) else x

    out: list[str] = []
    m = SequenceMatcher(None, [bare(x) for x in a], [bare(x) for x in b], autojunk=False)
    for op, i, j, k, n in m.get_opcodes():
        if op == "equal":
            out += [x if x == y else next((z for z in (x, y) if z.endswith(")+")), x if x.endswith(")?") else y) for x, y in zip(a[i:j], b[k:n])]
        else:
            out += [x if x.endswith(")?") else f"({bare(x)})?" for x in [*a[i:j], *b[k:n]]]
    return out


BUCKET = 200


def wrappers(df: DataFrame, host: str = "host", text: str = "text") -> DataFrame:
    """(host, records, wrapper): equal folded streams are counted before hosts are gathered, so a hot host is a few rows."""
    folded = F.pandas_udf(lambda s: s.map(lambda t: "\t".join(fold(stream(t)))), T.StringType())
    shapes = (df.select(F.col(host).alias("host"), F.col(text).alias("_t")).where(present("_t") & F.col("host").isNotNull() & F.col("_t").rlike("</?[A-Za-z]"))
              ).select("host", folded("_t").alias("shape")).groupBy("host", "shape").agg(F.count("*").alias("n"))

    def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n", "shape"], ascending=[False, True])
        w: list[str] | None = None
        for s in pdf["shape"]:
            w = s.split("\t") if w is None else align(w, s.split("\t"))
        return pd.DataFrame({"host": [key[0]], "shape": ["\t".join(w or [])], "n": [int(pdf["n"].sum())]})

    # shapes of one host are merged in buckets, then the buckets' wrappers, so a hot host's alignments run side by side
    size = shapes.groupBy("host").agg(F.ceil(F.count("*") / BUCKET).alias("_n"))
    parts = shapes.join(size, "host").withColumn("_b", F.pmod(F.xxhash64("shape"), F.col("_n"))).groupBy("host", "_b").applyInPandas(merge, "host string, shape string, n bigint")
    whole = parts.groupBy("host").applyInPandas(merge, "host string, shape string, n bigint")
    return whole.select("host", F.col("n").alias("records"), F.replace("shape", F.lit("\t"), F.lit(" ")).alias("wrapper"))


def _both(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "raw_docs").select(F.lit("raw_docs").alias("tbl"), F.col("raw_id").alias("row_id"), "text")
    d = table(spark, sf, "discovered").select(F.lit("discovered").alias("tbl"), F.col("cand_id").alias("row_id"), "text")
    return r.unionByName(d)


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    d = clean(_both(spark, sf).where(present("text")))
    return d.select("tbl", "row_id", F.explode("elements").alias("element"))


def p5_clean(spark: SparkSession, sf: str) -> DataFrame:
    return clean(_both(spark, sf)).select("tbl", "row_id", "clean_text")


def p5_wrappers(spark: SparkSession, sf: str) -> DataFrame:
    """Of the hosts of both tables; a raw_docs record's is that of the address its accepted content was found at."""
    host = F.expr("try_parse_url(url, 'HOST')").alias("host")
    d = table(spark, sf, "discovered").select(host, "text")
    urls = table(spark, sf, "source_meta").where("doc_id is not null and url <> ''").groupBy("doc_id").agg(F.max("url").alias("url"))
    r = table(spark, sf, "raw_docs").select("doc_id", "text").join(urls, "doc_id").select(host, "text")
    return wrappers(d.unionByName(r))
