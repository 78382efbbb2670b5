"""Problem 1: one canonical form for texts that look the same.

A transducer is compiled once from a rule over the Unicode database plus a short list of
look-alike letters. It reads grapheme clusters, longest match first, and writes the canonical
form in a single pass: widths, ligatures, spaces, invisible characters, composed and
decomposed accents, letters of other alphabets with a Latin shape. Case, accents and raised or
lowered digits are kept. The table is checked when it is compiled: every value must map to
itself (so the form is stable) and no two rules may claim one character.

Null text gives null; empty text gives empty text; texts of any length are read whole.
"""

from __future__ import annotations

import functools
import unicodedata

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, pairs_of_classes, pairs_within, present, spread, table

# Letters that share a shape with a Latin letter.
LOOK_ALIKES = {
    # Cyrillic, small
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s",
    "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "ѵ": "v",
    # Cyrillic, capital
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T",
    "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y", "Ӏ": "I", "Һ": "H",
    # Greek, small
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "χ": "x", "γ": "y", "ϲ": "c", "ϳ": "j",
    # Greek, capital
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    # Armenian and Latin extensions
    "օ": "o", "ս": "u", "հ": "h", "ո": "n", "ɑ": "a", "ɡ": "g",
}
SPACES = {c: " " for c in map(chr, [0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000])}
BREAKS = {"\u0085": "\n", "\u2028": "\n", "\u2029": "\n", "\r": "\n"}
JAMO = "\u1100-\u115e\u1161-\u11ff\ua960-\ua97f\ud7b0-\ud7ff"
# Characters without any width; tag characters and variation selectors included.
INVISIBLE = ("\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f"
             "\u3164\ufe00-\ufe0f\ufeff\uffa0\ufff9-\ufffb\U000e0000-\U000e0fff")
_INVISIBLE = regex.compile(f"[{INVISIBLE}]")
# One cluster that is not plain ASCII: conjoining jamo, or a base with what extends it.
CLUSTER = regex.compile(rf"\r\n|\r|[{JAMO}][{JAMO}{INVISIBLE}]*|[^\x00-\x7f][\p{{M}}{INVISIBLE}]*|[\x00-\x7f][\p{{M}}{INVISIBLE}]+")


def _compat(ch: str) -> str | None:
    """The plain form of one character where width, ligature or presentation form is all that differs."""
    tag, _, rest = unicodedata.decomposition(ch).partition(" ")
    if tag in ("<wide>", "<narrow>", "<isolated>", "<initial>", "<medial>", "<final>"):
        return unicodedata.normalize("NFKC", ch)
    if tag == "<compat>" and ("LIGATURE" in unicodedata.name(ch, "") or "\ufb00" <= ch <= "\ufb4f" or "DIGRAPH" in unicodedata.name(ch, "")):
        return unicodedata.normalize("NFKC", ch)
    if tag == "<compat>" and unicodedata.category(ch) == "Nl":  # roman numerals
        return unicodedata.normalize("NFKC", ch)
    return None


@functools.lru_cache(1)
def compiled() -> dict[str, str]:
    """character -> canonical string, conflict-checked."""
    out: dict[str, str] = {}
    wide = {c: p for c in map(chr, [*range(0xA0, 0x3400), *range(0xF900, 0x10000), *range(0x10000, 0x1F000)]) if (p := _compat(c)) and p != c}
    for rule in (LOOK_ALIKES, SPACES, BREAKS, wide):
        for c, plain in rule.items():
            if c in out and out[c] != plain:
                raise ValueError(f"two rules for {c!r}")
            out[c] = plain
    for c, plain in list(out.items()):
        out[c] = "".join(out.get(x, x) for x in plain)
    for c, plain in out.items():
        if any(out.get(x, x) != x for x in plain):
            raise ValueError(f"the form of {c!r} is not stable")
    return out


@functools.lru_cache(200_000)
def _cluster(c: str) -> str:
    if c in ("\r\n", "\r"):
        return "\n"
    c = _INVISIBLE.sub("", c)
    if not c:
        return ""
    m = compiled()
    parts = "".join(m.get(x, x) for x in unicodedata.normalize("NFC", c))
    parts = "".join(m.get(x, x) for x in unicodedata.normalize("NFD", parts))
    return unicodedata.normalize("NFC", parts)


def canonical(text: str | None) -> str | None:
    if text is None or (text.isascii() and "\r" not in text):
        return text
    return CLUSTER.sub(lambda m: _cluster(m[0]), text)


@F.pandas_udf(T.StringType())
def canonical_udf(s: pd.Series) -> pd.Series:
    return s.map(canonical, na_action="ignore")


def normalize_text(df: DataFrame, text: str = "text", out: str = "canonical_text") -> DataFrame:
    """Every input row and column, plus the canonical form."""
    return spread(df).withColumn(out, canonical_udf(F.col(text)))


def same_look(df: DataFrame, ident: str = "raw_id", text: str = "text") -> DataFrame:
    """Pairs of rows whose canonical forms are equal and whose texts are not. Only hashes are shuffled."""
    d = df.select(F.col(ident).alias("_i"), F.col(text).alias("_t")).where(present("_t") & F.col("_i").isNotNull())
    h = materialize(normalize_text(d, "_t", "_c").select(
        "_i", F.unhex(F.md5("_c")).alias("look"), F.unhex(F.md5("_t")).alias("cls")))
    forms = h.select("look", "cls").distinct()
    many = forms.groupBy("look").count().where("count > 1").select("look")
    forms = forms.join(many, "look")
    # forms of one look meet block against block, however many there are
    pairs = pairs_within(forms.select(F.col("look").alias("cls"), F.col("cls").alias("form")), "form", ("ca", "cb"))
    members = h.join(many, "look", "left_semi").select("cls", "_i")
    return pairs_of_classes(members, pairs, "_i", (f"{ident}_a", f"{ident}_b"))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return same_look(table(spark, sf, "raw_docs").select("raw_id", "text"))


def p1_normalized(spark: SparkSession, sf: str) -> DataFrame:
    d = normalize_text(table(spark, sf, "raw_docs").select("raw_id", "text"))
    return d.select("raw_id", "canonical_text", (~F.col("text").eqNullSafe(F.col("canonical_text"))).alias("changed"))
