"""Column expressions that stay in the JVM. All are pure: Column in, Column out; null in, null out unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.config import BANDS, PRIME, TOKEN_BASE, TOP_BAND

# The grammars of tokens, quotations, citations and broken words.
TOKEN = r"[A-Za-z0-9]+(?:'[A-Za-z]+)?"
INLINE_QUOTE = r'"([^"]{8,600})"'
CITATION = (
    r"\((?:[A-Z][A-Za-z'-]+(?:\s+(?:et\s+al\.?|and|&)\s+[A-Z][A-Za-z'-]+)?(?:,\s*)?(?:19|20)\d{2}[a-z]?(?:,\s*(?:p{1,2}\.?\s*)?\d+(?:-\d+)?)?)\)"
    r"|\[\d{1,3}(?:\s*[,-]\s*\d{1,3})*\]")
HYPHEN_BREAK = r"-[ \t]*\r?\n[ \t]*(?=[a-z])"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- ingest ---------------------------------------------------------------------------------


def tidy(c: str | Column) -> Column:
    """One kind of line end, single blanks, at most one empty line, no white space around."""
    t = F.regexp_replace(col(c), r"\r\n?", "\n")
    t = F.regexp_replace(t, r"[ \t\x0B\f\r]+", " ")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    return F.regexp_replace(t, r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def digest(c: str | Column) -> Column:
    return F.sha2(col(c).cast("binary"), 256)


def content_id(c: str | Column) -> Column:
    return F.concat(F.lit("sha256:"), F.substring(digest(c), 1, 24))


def html_to_text(c: str | Column) -> Column:
    """Scripts and styles, then all tags, become a blank."""
    t = F.regexp_replace(col(c), r"(?is)<(script|style)\b.*?</\1>", " ")
    return F.regexp_replace(t, r"<[^>]+>", " ")


def strip_jats(c: str | Column) -> Column:
    """Tags to blanks, the entities providers send resolved, white space levelled; null gives ''."""
    t = F.regexp_replace(F.coalesce(col(c), F.lit("")), r"<[^>]+>", " ")
    for entity, char in (("&nbsp;", "\u00a0"), ("&#160;", "\u00a0"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(t, r"(?U)\s+", " "))


def page_of(starts: str | Column, offset: str | Column) -> Column:
    """1-based page of an offset: pages end at the first start beyond it; 1 if there are none."""
    s, o = col(starts), col(offset)
    later = F.array_position(F.transform(s, lambda x: x > o), True)
    n = F.when(later > 0, later - 1).otherwise(F.size(s))
    return F.greatest(F.lit(1), F.coalesce(n, F.lit(1))).cast("int")


def locate(starts: str | Column, start: str | Column, end: str | Column) -> Column:
    """struct<page_start, page_end, char_start, char_end> of a half-open span."""
    s, e = col(start), col(end)
    return F.struct(page_of(starts, s).alias("page_start"), page_of(starts, F.greatest(s, e - 1)).alias("page_end"), s.alias("char_start"), e.alias("char_end"))


def n_pages(starts: str | Column) -> Column:
    return F.greatest(F.lit(1), F.coalesce(F.size(col(starts)), F.lit(1)))


# --- tokens ---------------------------------------------------------------------------------


def tokens(c: str | Column) -> Column:
    """Lower-cased tokens of the stored text; null gives an empty array."""
    return F.transform(F.coalesce(F.regexp_extract_all(col(c), F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>")), F.lower)


def dehyphenate(c: str | Column) -> Column:
    return F.regexp_replace(col(c), HYPHEN_BREAK, "")


def _rotl(h: Column, n: int) -> Column:
    return F.shiftleft(h, n).bitwiseAND(F.lit(PRIME)).bitwiseOR(F.shiftrightunsigned(h, 61 - n))


def token_hash(c: str | Column) -> Column:
    """Polynomial hash of the code points modulo 2^61 - 1; 31 h = rotl(h, 5) - h keeps it inside bigint."""
    if TOKEN_BASE != 31:
        raise ValueError("the rotation form holds for base 31")
    chars = F.filter(F.split(col(c), ""), lambda x: x != "")
    return F.aggregate(chars, F.lit(0).cast("bigint"), lambda h, x: F.pmod(_rotl(h, 5) - h + F.ascii(x), F.lit(PRIME)))


def horner257(values: list[Column]) -> Column:
    """Hash of a run of token values modulo 2^61 - 1."""
    h = values[0]
    for v in values[1:]:
        h = F.pmod(_rotl(h, 8) + h + v, F.lit(PRIME))
    return h


def fnv1a32(c: str | Column) -> Column:
    """FNV-1a over code points, 32 bits."""
    mask = F.lit(0xFFFFFFFF).cast("bigint")
    chars = F.filter(F.split(col(c), ""), lambda x: x != "")
    return F.aggregate(chars, F.lit(2166136261).cast("bigint"), lambda h, x: (h.bitwiseXOR(F.ascii(x).cast("bigint")) * F.lit(16777619)).bitwiseAND(mask))


# --- similarity -----------------------------------------------------------------------------


def estimate_jaccard(a: str | Column, b: str | Column) -> Column:
    """Share of equal slots of two signatures; 0 if one is empty or they differ in length."""
    a, b = col(a), col(b)
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x))
    return F.when((F.size(a) > 0) & (F.size(a) == F.size(b)), same / F.size(a)).otherwise(F.lit(0.0))


def exact_jaccard(a: str | Column, b: str | Column) -> Column:
    """Jaccard similarity of two sets held in arrays; 0 for two empty ones."""
    both, either = F.size(F.array_intersect(col(a), col(b))), F.size(F.array_union(col(a), col(b)))
    return F.when(either > 0, both / either).otherwise(F.lit(0.0))


def cosine(a: str | Column, b: str | Column) -> Column:
    """Dot product; the inputs are unit vectors of one length."""
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def classify(identity: str | Column) -> Column:
    return F.when(col(identity) >= 0.98, F.lit("verbatim")).otherwise(F.lit("near-duplicate"))


# --- scores ---------------------------------------------------------------------------------


def sigmoid(z: str | Column) -> Column:
    z = col(z)
    return F.when(z >= 0, 1.0 / (1.0 + F.exp(-z))).otherwise(F.exp(z) / (1.0 + F.exp(z)))


def band_for(score: str | Column) -> Column:
    s = col(score)
    out = F.when(s.isNull(), F.lit(None))
    for upper, name in BANDS:
        out = out.when(s < upper, F.lit(name))
    return out.otherwise(F.lit(TOP_BAND))


def review_priority(similarity: str | Column, ai: str | Column, band: str | Column) -> Column:
    s, a, b = col(similarity), col(ai), col(band)
    return (F.when((s >= 0.30) | (b.isin("likely-ai", "very-likely-ai") & (s >= 0.10)), "read-first")
            .when((s >= 0.15) | (a >= 0.75), "worth-a-look").otherwise("no-flags"))


def isotonic(raw: str | Column, breakpoints: tuple[float, ...], values: tuple[float, ...]) -> Column:
    """A step function: the value of the first breakpoint not below the score, else the last; without steps the score itself."""
    r = col(raw)
    if not breakpoints:
        return r
    out = F.when(r.isNull(), F.lit(None).cast("double"))
    for b, v in zip(breakpoints, values, strict=True):
        out = out.when(r <= b, F.lit(float(v)))
    return out.otherwise(F.lit(float(values[-1])))


def source_label(title: str, url: str, doc_id: str) -> Column:
    return F.coalesce(F.nullif(F.col(title), F.lit("")), F.nullif(F.col(url), F.lit("")), F.col(doc_id))


# --- language model arithmetic ----------------------------------------------------------------


def log_softmax(row: str | Column) -> Column:
    r = col(row)
    top = F.array_max(r)
    total = F.aggregate(r, F.lit(0.0), lambda s, x: s + F.exp(x - top))
    return F.transform(r, lambda x: x - top - F.log(total))


def rank_of(row: str | Column, target: str | Column) -> Column:
    """1 + the number of strictly greater values, so ties favour the target."""
    chosen = F.get(col(row), col(target))
    return 1 + F.size(F.filter(col(row), lambda v: v > chosen))


def triples(rows: str | Column, targets: str | Column, names: str | Column) -> Column:
    """array<struct<token, logp, logr>> of next-token logits, targets outside the vocabulary skipped."""
    z = F.arrays_zip(col(rows).alias("r"), col(targets).alias("t"), col(names).alias("n"))
    z = F.filter(z, lambda x: (F.size(x["r"]) > 0) & (x["t"] >= 0) & (x["t"] < F.size(x["r"])))
    return F.transform(z, lambda x: F.struct(x["n"].alias("token"), F.get(log_softmax(x["r"]), x["t"]).alias("logp"), F.log(rank_of(x["r"], x["t"]).cast("double")).alias("logr")))
