"""Problem 3: text that was decoded with the wrong encoding.

A record is cut into pieces (sentences and lines). For every piece that is not plain ASCII (which all
these encodings share, so no decoding changes it) each link "encode as it was read, decode as it should
have been" that goes through yields a candidate, and candidates that were UTF-8 are followed further, so
text that was garbled several times is undone as often. Each candidate is compressed with the zstandard
dictionaries of the languages of its script. To the compressed length comes what the dictionaries cannot
say: control codes, letters that none of them has, signs in the middle of words, letters of two scripts
side by side. The record then takes the chains that make its whole description shortest: a chain is paid
for once a record by its links, each use of it by USE, and a piece stays as it is unless that saves
something. Garbled places inside sound text are so found and restored alone.

A decoding is only looked at if it can shorten: it must not put letters into a word of another script, nor
bring in more letters that no dictionary has than it takes away.

Dictionaries are raw contents, cut from at most DICT_DOCS labelled rows of `documents` a language and script.

A record with a replacement character lost something: it is reported but not restorable. A single garbled
word in quotation marks is an author's example. Null and empty texts are never affected.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, present, spread, table

DICT_DOCS = 150
DICT_BYTES = 110_000
LEVEL = 5

# Encodings as read, and what the text was in truth.
SINGLE = ["cp1252", "cp437", "cp850", "mac_roman", "cp1250", "iso8859_2", "cp1251", "koi8_r", "cp866", "iso8859_5", "mac_cyrillic", "cp1253", "iso8859_7", "cp1254", "cp1256", "iso8859_6", "cp874", "cp1257", "iso8859_15", "cp1255", "cp737", "cp852"]
WIDE = ["gbk", "shift_jis", "cp949", "big5", "euc_jp"]
LATIN = ["cp1252", "cp1250", "iso8859_2", "mac_roman", "cp437", "cp850", "cp1254", "cp852", "cp1257"]


@functools.lru_cache(None)
def tables(name: str) -> tuple[dict[str, int], list[str]]:
    """(character -> byte, byte -> character); bytes without a character stand for the control code of that number."""
    dec = []
    for b in range(256):
        try:
            dec.append(bytes([b]).decode(name))
        except UnicodeDecodeError:
            dec.append(chr(b))
    enc = {c: b for b, c in reversed(list(enumerate(dec)))}
    for b in range(0x80, 0x100):
        enc.setdefault(chr(b), b) if b < 0xA0 or name in ("cp1252",) else None
    return enc, dec


def encode(text: str, name: str) -> bytes | None:
    if name in WIDE:
        try:
            return text.encode(name)
        except UnicodeEncodeError:
            return None
    enc = tables(name)[0]
    try:
        return bytes([enc[c] for c in text])
    except KeyError:
        return None


def decode(data: bytes, name: str) -> str | None:
    if name == "utf-8" or name in WIDE:
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            return None
    dec = tables(name)[1]
    s = "".join([dec[b] for b in data])
    return None if any("\x80" <= c <= "\x9f" for c in s) else s


def script(c: str) -> str:
    o = ord(c)
    if o < 0x250 or 0x1E00 <= o < 0x1F00:
        return "latin"
    if o < 0x400 and o >= 0x370 or 0x1F00 <= o < 0x2000:
        return "greek"
    if 0x400 <= o < 0x530:
        return "cyrillic"
    if 0x590 <= o < 0x600:
        return "hebrew"
    if 0x600 <= o < 0x780 or 0xFB50 <= o < 0xFE00 or 0xFE70 <= o < 0xFF00:
        return "arabic"
    if 0x900 <= o < 0xE00:
        return "indic"
    if 0xE00 <= o < 0xE80:
        return "thai"
    if 0x3040 <= o < 0x31C0 or 0x3400 <= o < 0xA000 or 0xF900 <= o < 0xFB00 or 0xFF00 <= o < 0xFFF0:
        return "cjk"
    if 0xAC00 <= o < 0xD7B0 or 0x1100 <= o < 0x1200:
        return "hangul"
    return "other"


HIGH = re.compile(r"[^\x00-\x7f]+")
ASCII_LETTER = re.compile("[A-Za-z]")


def main_script(text: str) -> str:
    return letters_of(text)[0]


def letters_of(text: str) -> tuple[str, bool]:
    """(the script most letters have, whether at least half of the letters are none of ASCII)."""
    if text.isascii():
        return "latin", False
    n: dict[str, int] = {}
    for c, k in Counter("".join(HIGH.findall(text))).items():
        if c.isalpha():
            x = script(c)
            n[x] = n.get(x, 0) + k
    if not n:
        return "latin", False
    high = sum(n.values())
    low = len(ASCII_LETTER.findall(text))
    weighed = {x: k if x == "latin" else 2 * k for x, k in n.items()}
    best = max(sorted(weighed), key=weighed.get)
    return best if best == "latin" or weighed[best] >= low else "latin", high >= 0.5 * (high + low)


PIECE = re.compile(r"[^\n]*?(?:[.!?。！？।؟][\"'”’»」』)]*(?=[ \n]|$)|[。！？]|\n|$)\s*", re.S)
WORD = re.compile(r"[^ \t\n]*[^\x00-\x7f][^ \t\n]*")
UTF8_READ = [*SINGLE, *WIDE]
# bytes that naming a link costs: a share of what distinguishes it from all others, and of how rare it is
UTF8_COST, SINGLE_COST, USE, CONTROL, BROKEN, FRESH = 1, 7, 1, 2, 2, 4
BEAM = 5


# a sign between two letters of a word, other than what may stand there
INSIDE = re.compile(r"(?<=[^\W\d_])(?:[^\x00-\x7f\w\s’‘‐‑–—·…\u0300-\u036f\u00ad\u200b-\u200f\u2060\ufeff\ufffd]|[¼½¾¹²³])(?=[^\W\d_])")


# letters of two scripts side by side
PATCHED = re.compile("[A-Za-zÀ-ɏ](?=[\u0370-\u1dff\u2e80-\ud7ff])|[\u0370-\u1dff\u2e80-\ud7ff](?=[A-Za-zÀ-ɏ])")
CODES = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]")
JOINED = re.compile(r"(?:[^\W\d_]|[^\x00-\x7f\W])+")


def packed(text: str) -> bytes:
    """UTF-8, with dashes, quotation marks, currency and letter-like signs in two bytes: in three they would seem longer than the letters they are misread as."""
    data = text.encode("utf-8", "surrogatepass")
    if not text.isascii():
        for long, short in ((b"\xe2\x80", b"\xfa"), (b"\xe2\x82", b"\xfb"), (b"\xe2\x84", b"\xfc")):
            data = data.replace(long, short)
    return data


@functools.lru_cache(None)
def recoding(read: str, true: str) -> dict[int, str]:
    """Every character of one single-byte encoding -> what its byte is in another."""
    enc, dec = tables(read)[0], tables(true)[1]
    m = {ord(c): dec[b] for c, b in enc.items() if c > "\x7f" and not "\x80" <= dec[b] <= "\x9f"}
    return m | {o: chr(o) for o in range(128)}


@functools.lru_cache(None)
def utf8_signs(read: str) -> tuple[frozenset[str], frozenset[str]]:
    """What lead and continuation bytes of UTF-8 look like, read in this encoding."""
    dec = tables(read)[1]
    return frozenset(dec[b] for b in range(0xC2, 0xF5)), frozenset(dec[b] for b in range(0x80, 0xC0))


UTF8_RUN = re.compile(rb"(?:[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3})+")


def undo_utf8(piece: str, read: str) -> str | None:
    """The piece with every run of bytes that is UTF-8 decoded as such, or None where there is none."""
    if read in WIDE:
        def word(m: re.Match) -> str:
            data = encode(m[0], read)
            return (decode(data, "utf-8") if data is not None else None) or m[0]

        data = encode(piece, read)
        t = (decode(data, "utf-8") if data is not None else None) or WORD.sub(word, piece)
        return None if t == piece else t
    enc = tables(read)[0]
    lead, tail = utf8_signs(read)
    changed = False

    def run(m: re.Match) -> str:
        nonlocal changed
        w = m[0]
        if lead.isdisjoint(w) or tail.isdisjoint(w):
            return w
        out, cur = [], bytearray()

        def flush() -> None:
            nonlocal changed
            pos = 0
            for r in UTF8_RUN.finditer(cur):
                try:
                    t = r[0].decode("utf-8")
                except UnicodeDecodeError:
                    continue
                out.append("".join(back[pos:r.start()]) + t)
                pos = r.end()
                changed = True
            out.append("".join(back[pos:]))
            cur.clear()
            back.clear()

        back: list[str] = []
        for c in w:
            if (x := enc.get(c)) is None:
                flush()
                out.append(c)
            else:
                cur.append(x)
                back.append(c)
        flush()
        return "".join(out)

    t = HIGH.sub(run, piece)
    return t if changed else None


def mixed(text: str, before: set[str]) -> bool:
    """Whether a letter or figure that was not there before stands in a word of another script: no decoding of a text does that."""
    new = {c for c in set(text) - before if c > "\x7f" and c.isalnum()}
    if not new:
        return False
    if main_script(text) != "latin" and any(script(c) == "latin" for c in new):
        return True
    wide = sum(script(c) in ("cjk", "hangul") for c in new) >= 4
    for m in JOINED.finditer(text):
        w = m[0]
        if new.isdisjoint(w):
            continue
        kinds = {script(c) for c in w if not (wide and c <= "\x7f")}
        if len(kinds - {"cjk", "hangul"}) + bool(kinds & {"cjk", "hangul"}) > 1:
            return True
    return False


class Restorer:
    """dicts: language and script -> (script, bytes)."""

    def __init__(self, dicts: dict[str, tuple[str, bytes]]):
        self.by_script: dict[str, list[zstandard.ZstdCompressor]] = {}
        seen: Counter[str] = Counter()
        for _, (s, data) in sorted(dicts.items()):
            text = data.decode("utf-8", "ignore")
            d = zstandard.ZstdCompressionDict(packed(text), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.by_script.setdefault(s, []).append(zstandard.ZstdCompressor(dict_data=d, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False))
            seen.update(text)
        self.plain = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
        self.alphabet = {c for c, n in seen.items() if n >= 2}
        self.memo: dict[str, list[tuple[str, str, int, int]]] = {}
        self.odd: dict[str, bool] = {}
        self.covers: dict[tuple[str, str], tuple[frozenset[str], frozenset[str]]] = {}

    def strange(self, c: str) -> int:
        """What a character costs beside its bytes: a control code or one of private use, a letter that no dictionary has and that is no mere form of another."""
        got = self.odd.get(c)
        if got is None:
            kind = unicodedata.category(c)
            got = self.odd[c] = 2 if kind in ("Cc", "Co", "Cn") else 1 if kind[0] in "LM" and c not in self.alphabet and not unicodedata.decomposition(c).startswith("<") or kind in ("So", "Sm") and c not in self.alphabet else 0
        return got

    def alien(self, text: str) -> int:
        """What control codes of the text cost, and signs in the middle of words."""
        n = sum(text.count(c) for c in set(text) if "\x7f" < c <= "\x9f")
        return CONTROL * n + BROKEN * (len(INSIDE.findall(text)) + len(PATCHED.findall(text)))

    def lengths(self, text: str, kind: str) -> list[int]:
        """Bytes that describe the text, by the dictionary of each language of that script."""
        data = packed(text)
        return [len(x.compress(data)) for x in self.by_script.get(kind) or [self.plain]]

    def plainly(self, read: str, true: str) -> tuple[frozenset[str], frozenset[str]]:
        """The characters that a recoding covers, and those of them that it turns into nothing strange."""
        got = self.covers.get((read, true))
        if got is None:
            m = recoding(read, true)
            got = self.covers[read, true] = frozenset(map(chr, m)), frozenset(chr(k) for k, c in m.items() if c <= "\x7f" or not self.strange(c))
        return got

    def links(self, piece: str, s: str, foreign: bool) -> Iterator[tuple[str, str, int]]:
        """(link, text, cost) of every decoding that goes through and changes something, each text once."""
        high = {c for c in piece if c > "\x7f"}
        if not high:
            return
        alien = self.alien(piece)
        done = {piece}
        for read in UTF8_READ if max(high) >= "\u2e80" else SINGLE:  # bytes of UTF-8 read as a wide encoding give wide signs
            if read not in WIDE:
                lead, tail = utf8_signs(read)
                if lead.isdisjoint(high) or tail.isdisjoint(high):
                    continue
            t = undo_utf8(piece, read)
            if t and t not in done:
                done.add(t)
                if not mixed(t, high):
                    yield f"{read}>utf-8", t, UTF8_COST
        sets = LATIN if s == "latin" and not foreign else SINGLE
        signs = sorted(high)
        images = {"".join(signs)}
        for read in sets:
            if s == "latin" and read not in LATIN:
                continue
            if not tables(read)[0].keys() >= high:
                continue
            for true in sets:
                if true == read:
                    continue
                all_, good = self.plainly(read, true)
                # a letter that no dictionary has can be part of no match: more of them never save
                if not high <= good and (not alien or not high <= all_):
                    continue
                m = recoding(read, true)
                image = "".join([m[ord(c)] for c in signs])
                if image in images or (letters_of(image)[0] == "latin") == foreign and any(map(str.isalpha, image)):
                    continue  # no language of Latin script writes mostly accented letters, and other letters do not come up inside Latin words
                images.add(image)
                done.add(t := piece.translate(m))
                yield f"{read}>{true}", t, SINGLE_COST
        if max(high) >= "\u2000":  # bytes taken in pairs
            for read in ("utf-16-le", "utf-16-be"):
                data = piece.encode(read, "surrogatepass")
                for true in ("utf-8", "cp1252"):
                    t = decode(data, true)
                    if t and not CODES.search(t) and t not in done:
                        done.add(t)
                        yield f"{read}>{true}", t, SINGLE_COST
        if s != "latin" or foreign:
            for read in WIDE if s in ("cjk", "hangul") else (*WIDE[:0], "cp1252", "mac_roman", "cp437", "cp850"):
                if (data := encode(piece, read)) is None:
                    continue
                for true in WIDE:
                    if true != read and (t := decode(data, true)) and t not in done:
                        done.add(t)
                        yield f"{read}>{true}", t, SINGLE_COST

    def chains(self, piece: str) -> list[tuple[str, str, int, int]]:
        """(chain, text, bytes saved, cost of the chain) of every chain that saves anything; those that end in UTF-8 are followed further."""
        got = self.memo.get(piece)
        if got is None:
            kind, foreign = letters_of(piece)
            sizes = self.lengths(piece, kind)
            base = min(sizes) + self.alien(piece)
            # in its own script a piece stays in one of the two languages that describe it best
            near = {kind: sorted(range(len(sizes)), key=lambda i: (sizes[i], i))[:2]}
            got, texts = [], {piece}
            ahead = [("", piece, 0, kind, foreign)]
            while ahead:
                level = []
                for chain, cur, spent, k0, f0 in ahead:
                    for link, t, cost in self.links(cur, k0, f0):
                        if t in texts or chain and not link.endswith("utf-8"):
                            continue  # what was UTF-8 is not garbled by bytes as well
                        texts.add(t)
                        k, f = (k0, f0) if k0 == "latin" and not f0 and cost == SINGLE_COST else letters_of(t)
                        data = packed(t)
                        c = self.by_script.get(k) or [self.plain]
                        size = min(len(c[i].compress(data)) for i in near.get(k, range(len(c))))
                        # what a decoding brings in and no dictionary has speaks against it once more
                        fresh = FRESH * sum(t.count(c) * self.strange(c) for c in set(t).difference(piece) if c > "\x7f")
                        saved = base - size - self.alien(t) - fresh
                        if saved >= 0 or cost == UTF8_COST:
                            level.append((f"{chain} {link}".strip(), t, saved, spent + cost, k, f))
                got += [x[:4] for x in level if x[2] >= 0]
                # every chain that saves is kept; the next links are sought behind those that save most or lose least (each makes
                # the text shorter, so this ends), for a half undone text may well be no shorter to describe
                level.sort(key=lambda x: (x[3] - x[2], x[0]))
                ahead = [(c, t, n, k, f) for c, t, g, n, k, f in level if c.endswith("utf-8")][:BEAM]
            if len(self.memo) > 50_000:
                self.memo.clear()
            self.memo[piece] = got
        return got


def choose(ps: list[str], options: list[list[tuple[str, str, int, int]]]) -> list[int]:
    """Which option each piece takes (-1: stays as it is) so that the record's description is shortest; a chain is paid once a record, each use of it USE bytes."""
    taken, saved = [-1] * len(options), [0] * len(options)
    offers: dict[str, list[tuple[int, int, int]]] = {}
    costs: dict[str, int] = {}
    for k, opts in enumerate(options):
        for j, (chain, _, gain, cost) in enumerate(opts):
            offers.setdefault(chain, []).append((k, j, gain - USE))
            costs[chain] = cost
    while offers:
        worth, chain = max((sum(max(0, g - saved[k]) for k, _, g in o) - costs[c], c) for c, o in offers.items())
        if worth <= 0:
            break
        for k, j, g in offers.pop(chain):
            if g > saved[k]:
                taken[k], saved[k] = j, g
    used = {options[k][j][0] for k, j in enumerate(taken) if j >= 0}
    # beside garbled pieces, what a chain in use fits just as well is taken for garbled too
    return [j if j >= 0 else max(((o[2], i) for i, o in enumerate(options[k]) if o[0] in used and sum(map(str.isalpha, o[1])) >= sum(map(str.isalpha, ps[k]))), default=(0, -1))[1] for k, j in enumerate(taken)]


def pieces(text: str) -> Iterator[str]:
    """Sentences and lines, in order and complete."""
    return (m[0] for m in PIECE.finditer(text) if m[0])


LOST = re.compile("\ufffd")
QUOTE = re.compile(r"[\"“«„‘'`][^\"”»“’'`\n]{1,40}[\"”»“’'`]")


def restore(text: str, r: Restorer) -> tuple[bool, bool, str]:
    """(affected, restorable, text restored as far as it goes)."""
    if text.isascii():  # every decoding here leaves ASCII as it is
        return False, True, text
    ps = list(pieces(text))
    options = [[] if p.isascii() else r.chains(p) for p in ps]
    taken = choose(ps, options)
    out = [p if j < 0 else o[j][1] for p, o, j in zip(ps, options, taken)]
    spots = [k for k, (p, j) in enumerate(zip(ps, taken)) if j >= 0 or LOST.search(p)]
    if not spots:
        return False, True, text
    if len(spots) == 1:  # one garbled word, quoted, is an example
        p = ps[spots[0]]
        for q in QUOTE.finditer(p):
            if " " not in q[0].strip() and not q[0].isascii():
                rest = p[:q.start()] + p[q.end():]
                if not LOST.search(rest) and (rest.isascii() or choose([rest], [r.chains(rest)]) == [-1]):
                    return False, True, text
    fixed = "".join(out)
    return True, not LOST.search(fixed), fixed


def dictionaries(docs: DataFrame, lang: str = "lang", text: str = "text", per_language: int = DICT_DOCS) -> dict[str, tuple[str, bytes]]:
    """language and script -> (script, content). Every language has one for each script its labelled rows are written in, however few
    they are; from at most `per_language` of them each, chosen by the hash of their text."""
    d = docs.select(F.lower(F.substring(F.trim(lang), 1, 2)).alias("lang"), F.col(text).alias("_t")).where(present("_t") & F.col("lang").rlike("^[a-z]{2}$"))
    kind = F.pandas_udf(lambda s: s.map(lambda t: main_script(t or "")), "string")
    h = d.select("lang", F.xxhash64("_t").alias("h"), kind(F.when(F.col("_t").rlike(r"[^\x00-\x7f]"), F.col("_t"))).alias("s"))  # ranked without the texts
    top = h.distinct().withColumn("k", F.row_number().over(Window.partitionBy("lang", "s").orderBy("h"))).where(F.col("k") <= per_language).select("lang", "h", "s")
    rows = (d.withColumn("h", F.xxhash64("_t")).join(F.broadcast(top), ["lang", "h"])  # at most per_language rows a two-letter code and script
            .select("lang", "s", "h", F.substring("_t", 1, DICT_BYTES).alias("_t")).dropDuplicates(["lang", "s", "h"]).collect())
    out: dict[str, tuple[str, bytes]] = {}
    for name, s in sorted({(x["lang"], x["s"]) for x in rows}):
        own = sorted((x for x in rows if (x["lang"], x["s"]) == (name, s)), key=lambda x: x["h"])
        # the end of a raw dictionary is the cheapest to refer to
        data = b"\n".join(x["_t"].encode("utf-8", "surrogatepass") for x in own if "�" not in x["_t"])[-DICT_BYTES:]
        if data:
            out[f"{name} {s}"] = (s, data)
    return out


def repaired(df: DataFrame, clean: DataFrame, ident: str = "raw_id", text: str = "text") -> DataFrame:
    """(ident, affected, restorable, restored) of every row; `clean` has text and lang."""
    spark = df.sparkSession
    dicts = dictionaries(clean)
    shared = spark.sparkContext.broadcast(dicts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = None
        for b in batches:
            rows = []
            for i, t in zip(b["_id"], b["_t"]):
                if not t or t.isascii():
                    rows.append((i, False, True, t))
                    continue
                r = r or Restorer(shared.value)
                rows.append((i, *restore(t, r)))
            yield pd.DataFrame(rows, columns=[ident, "affected", "restorable", "restored"])

    kind = df.schema[ident].dataType.simpleString()
    return spread(df.select(F.col(ident).alias("_id"), F.col(text).alias("_t"))).mapInPandas(run, f"{ident} {kind}, affected boolean, restorable boolean, restored string")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "raw_docs").select("raw_id", "text").where(present("text") & F.col("text").rlike(r"[^\x00-\x7f]"))
    return repaired(d, table(spark, sf, "documents")).where("affected").select("raw_id")


def p3_restored(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "raw_docs").select("raw_id", "text")
    return repaired(d, table(spark, sf, "documents")).select("raw_id", "affected", "restorable", "restored")
