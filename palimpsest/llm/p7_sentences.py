"""Problem 7: sentences with offsets, in any script.

Every place where a sentence could end (behind an end mark and what closes with it; at a blank in
scripts that use no marks) is tagged boundary or inside by a linear chain over these two states,
decoded with Viterbi. All scores are log odds counted over all records; no list of words goes in.
The labels are those the text itself gives: where a paragraph ends and the next begins is a boundary.

* left: how often the word before a full stop ends a paragraph, of all times it stands before one
  (an abbreviation never does). A word little is known of goes by its shape: one letter, letters
  between stops, a figure, short, long;
* mark: the same of the mark with what closes behind it (`!"` goes on where `."` ends);
* right: how often the next word begins a paragraph, of all times it follows a blank, else its kind
  (capital, small letter, figure, sign); behind figures and single letters also how often it follows these
  with a stop (months and further initials do);
* transition: how many words lie between two boundaries, in paragraphs of one unit against all
  stretches between marks.

All counts are kept by script. Only the structure is fixed, not learned: nothing ends inside an open quotation or bracket,
nor at a mark with no blank behind it (decimals, addresses) in scripts that write blanks. A script whose paragraphs mostly
end without a mark (Thai) is tagged at its blanks; for it the chain is trained on text stripped of punctuation: letters at
paragraph edges against letters anywhere.

Units cover everything but white space. Null and empty texts have none. Untrained, the tagger ends a unit at each mark.
"""

from __future__ import annotations

import bisect
import itertools
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, present, spread, table
from .p3_encoding import script

MIN_SHARE = 1e-6
PRIOR = 2.0  # how many sightings the kind of a word counts as much as
BIAS = 1.6  # log odds of a boundary where nothing else is known
END = ".!?…。！？｡؟।॥;;՞۔"
CLOSE = "\"'”’»›)]}」』】）〉》“‘"
MARK = re.compile(r"[.!?…。！？｡؟।॥;;۔]+(?:[\"'”’»›)\]}」』】）〉》“‘]|[   ]»(?![^\W\d_]))*")
PARAGRAPH = re.compile(r"\n[^\S\n]*(?:\n[^\S\n]*)+")
LEFT = re.compile(r"(?:(\d)\s)?(\S*)\Z")
NEXT = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*|\S")
FOLLOWS = re.compile(r"(?:(?<=\s)|\A)(?:[^\W\d_]+(?:['’-][^\W\d_]+)*|\d|[^\s\w])")
OPENS = "«»„“”\"'([¿¡‚‘{（「『《"
SPACELESS = ("cjk", "thai")
PAIRED = ("figure", "capital", "letter", "sign")
QUOTES = re.compile("[\"“”«»„「」『』‹›]")
PAIRS = {"“": "”", "«": "»", "„": "“”", "「": "」", "『": "』", "‹": "›"}
STRETCH = re.compile(rf"[^\s{re.escape(END)}]+")
PUNCTUATION = re.compile(r"[^\w\s]|_")
FOREIGN = re.compile(r"[\u0370-\u1dff\u1f00-\u1fff\u2e80-\uffef]")
INF = 1e9


def left_key(part: str, at: int, script_: str) -> str:
    """The word before a stop: small letters unless it is one letter; "0" for figures; "0 x" behind a figure."""
    if script_ in SPACELESS:
        return ""
    lo = at
    while lo > 0 and not part[lo - 1].isspace():
        lo -= 1
    m = LEFT.search(part, max(0, lo - 2), at)
    w = m[2].lstrip(OPENS)
    if w[-1:].isdigit():
        return "0"
    return ("0 " if m[1] else "") + (w if len(w) == 1 else w.lower())


def left_kind(key: str) -> str:
    u, w = ("0 ", key[2:]) if key.startswith("0 ") else ("", key)
    if w in ("", "0"):
        return u + "figure" if w else u + "none"
    if "." in w:
        return u + "dotted"
    if len(w) == 1:
        return u + ("capital" if w.isupper() else "letter" if w.islower() else "sign")
    return u + ("short" if len(w) <= 3 else "long")


def right_key(part: str, at: int, script_: str) -> str:
    """The word at `at`, behind blanks; initials are all one key, and scripts without blanks go by their first sign."""
    m = NEXT.match(part, at)
    if not m:
        return ""
    w = m[0]
    if script_ in SPACELESS:
        return "letter" if w[0].isalpha() else w[0]
    return "A." if len(w) == 1 and w.isupper() and part[m.end():m.end() + 1] == "." else w


def right_kind(key: str) -> str:
    c = key[:1]
    if key in ("A.", "letter"):
        return key
    return "capital" if c.isupper() else "small" if c.islower() else "figure" if c.isdigit() else "letter" if c.isalpha() else c


def gap_kind(words: int) -> str:
    return str(min(words, 4)) if words < 8 else "8"


def skip(part: str, at: int) -> int:
    n = len(part)
    while at < n and part[at].isspace():
        at += 1
    return at


def paragraphs(text: str) -> Iterator[tuple[int, int]]:
    pos = 0
    for m in PARAGRAPH.finditer(text):
        yield pos, m.start()
        pos = m.end()
    yield pos, len(text)


def script_of(part: str) -> str:
    if not FOREIGN.search(part):
        return "latin"
    n: Counter[str] = Counter()
    for c, k in Counter(part).items():
        if c.isalpha():
            n[script(c)] += k
    return n.most_common(1)[0][0] if n else "latin"


def marks(part: str, script_: str, begins: set[int]) -> Iterator[tuple[int, int, int]]:
    """(start of the mark, end of the mark, end of what closes with it) where a unit could end."""
    for m in MARK.finditer(part):
        s, e = m.span()
        own = s + len(m[0].rstrip(CLOSE + " \u00a0\u202f"))
        while e > own and e - 1 in begins:
            e -= 1  # it opens the next quotation
        if e == len(part) or part[e].isspace() or script_ in SPACELESS:
            yield s, own, e


class Counts:
    """(table, script) -> key -> how often: at a boundary, and at all."""

    def __init__(self):
        self.at: dict[tuple[str, str], Counter[str]] = defaultdict(Counter)
        self.n: dict[tuple[str, str], Counter[str]] = defaultdict(Counter)

    def add(self, text: str) -> None:
        for lo, hi in paragraphs(text):
            if part := text[lo:hi].strip():
                self._paragraph(part, script_of(part))

    def _paragraph(self, part: str, sc: str) -> None:
        ms = list(marks(part, sc, {a for a, _ in _quotes(part)}))
        marked = bool(ms) and ms[-1][2] == len(part)
        if len(part) >= 20:
            self.n["marked", sc][""] += 1
            self.at["marked", sc][""] += marked
        mark, left, after, gap = (self.n[t, sc] for t in ("mark", "left", "after", "gap"))
        prev = 0
        for s, own, e in ms:
            mark[part[s:e]] += 1
            if e == len(part):
                self.at["mark", sc][part[s:e]] += 1
            if own == s + 1 and part[s] == ".":
                left[key := left_key(part, s, sc)] += 1
                if e == len(part):
                    self.at["left", sc][key] += 1
                elif (kind := left_kind(key)) in PAIRED:
                    after[kind + " " + right_key(part, skip(part, e), sc)] += 1
            if sc not in SPACELESS:
                gap[gap_kind(part.count(" ", prev, s) + (prev == 0))] += 1
            prev = e
        if marked:
            self.at["right", sc][right_key(part, 0, sc)] += 1
            if len(ms) == 1 and sc not in SPACELESS:
                self.at["gap", sc][gap_kind(part.count(" ", 0, ms[0][0]) + 1)] += 1
        if sc not in SPACELESS:
            self.n["right", sc].update(FOLLOWS.findall(part))
            return
        self.n["right", sc].update("letter" if x[0].isalpha() else x[0] for x in STRETCH.findall(part))
        bare = PUNCTUATION.sub("", part).strip()
        if len(bare) > 1:
            self.at["edge", sc].update((bare[0], bare[-1]))
            self.n["edge", sc].update(bare)

    def rows(self) -> Iterator[tuple[str, str, str, int, int]]:
        """Keys, the kinds of keys ("left/", "right/") and the totals of tables ("left*")."""
        for (t, sc), n in list(self.n.items()):
            at = self.at[t, sc]
            kind = {"left": left_kind, "right": right_kind, "after": lambda k: k.rsplit(" ", 1)[0]}.get(t)
            kinds: dict[str, list[int]] = defaultdict(lambda: [0, 0])
            for k in n.keys() | at.keys():
                yield t, sc, k, at[k], n[k]
                if kind:
                    kinds[kind(k)][0] += at[k]
                    kinds[kind(k)][1] += n[k]
            for k, (x, y) in kinds.items():
                yield t + "/", sc, k, x, y
            yield t + "*", sc, "", at.total(), n.total()


class Tagger:
    """model: (table, script, key) -> (at a boundary, all), as counted by train(); totals and kinds are summed here."""

    def __init__(self, model: dict[tuple[str, str, str], tuple[int, int]] | None = None):
        self.model = model or {}
        self.memo: dict[tuple[str, str, str], float] = {}
        self.unmarked = {s for (t, s, _), (a, n) in self.model.items() if t == "marked" and n >= 5 and a < 0.5 * n}

    def rate(self, table_: str, sc: str) -> float:
        a, n = self.model.get((table_ + "*", sc, ""), (0, 0))
        return (a + 0.1) / (n + 1.0)

    def odds(self, table_: str, sc: str, key: str, kind: str | None) -> float:
        """log of how much more often than on average `key` is seen at a boundary; by its kind as far as little is known of it."""
        got = self.memo.get((table_, sc, key))
        if got is None:
            base = self.rate(table_, sc)
            a, n = self.model.get((table_ + "/", sc, kind), (0, 0)) if kind is not None else (0, 0)
            prior = (a + PRIOR * base) / (n + PRIOR)
            a, n = self.model.get((table_, sc, key), (0, 0))
            got = self.memo[table_, sc, key] = max(-8.0, math.log((a + PRIOR * prior) / (n + PRIOR) / base)) if self.model else 0.0
            if len(self.memo) > 200_000:
                self.memo.clear()
        return got

    def after(self, sc: str, kind: str, key: str) -> float:
        """The share of `key` among the beginnings of paragraphs against its share among what follows a stop behind this kind of word."""
        a, _ = self.model.get(("right", sc, key), (0, 0))
        _, n = self.model.get(("after", sc, f"{kind} {key}"), (0, 0))
        starts, _ = self.model.get(("right*", sc, ""), (0, 0))
        _, all_ = self.model.get(("after/", sc, kind), (0, 0))
        e = (n + 1.0) / (all_ + 50.0)
        return min(0.0, math.log((a + 50.0 * e) / (starts + 50.0) / e)) if n else 0.0

    def units(self, text: str | None) -> list[tuple[int, int]]:
        """[(start, end)] in code points."""
        if not text or not text.strip():
            return []
        return [u for lo, hi in paragraphs(text) for u in self._paragraph(text, lo, hi)]

    def _paragraph(self, text: str, lo: int, hi: int) -> list[tuple[int, int]]:
        part = text[lo:hi]
        if not part.strip():
            return []
        sc = script_of(part)
        places = self._blanks(part, sc) if sc in self.unmarked else self._marks(part, sc)
        out, s = [], 0
        for c in [*viterbi(places), len(part)]:
            a, b = s, c
            while a < b and part[a].isspace():
                a += 1
            while b > a and part[b - 1].isspace():
                b -= 1
            if b > a:
                out.append((lo + a, lo + b))
                s = c
        return out

    def _blanks(self, part: str, sc: str) -> list[tuple[int, float, float]]:
        a, n = self.model[("marked", sc, "")]
        prior = math.log((n - a + 0.5) / (a + 0.5))
        begins, ends = map(list, zip(*q)) if (q := _quotes(part)) else ([], [])
        places = []
        for m in re.finditer(r"\s+", part):
            x, y = part[m.start() - 1:m.start()], part[m.end():m.end() + 1]
            k = bisect.bisect_left(begins, m.start()) - 1
            if not x or not y or "\n" in m[0] or k >= 0 and m.start() < ends[k]:
                continue  # a line break by itself ends nothing
            score = prior + sum(max(-1.5, min(1.5, self.odds("edge", sc, c, None))) for c in (x, y) if c.isalnum())
            places.append((m.end(), score, 0.0))
        return places

    def _marks(self, part: str, sc: str) -> list[tuple[int, float, float]]:
        quotes = _quotes(part)  # in order, none inside another
        begins, ends = [a for a, _ in quotes], [b for _, b in quotes]
        depth = _brackets(part)
        places = []
        prev = 0
        for s, own, e in marks(part, sc, set(begins)):
            nxt = skip(part, e)
            if nxt == len(part):
                continue
            k = bisect.bisect_left(begins, s) - 1  # the last quotation that begins before the mark
            if k >= 0 and e < ends[k]:
                continue
            if depth[e - 1] > 0:
                continue
            right = right_key(part, nxt, sc)
            score = BIAS + self.odds("mark", sc, part[s:e], None) + self.odds("right", sc, right, right_kind(right))
            if part[s:own] == ".":
                left = left_key(part, s, sc)
                kind = left_kind(left)
                score += self.odds("left", sc, left, kind)
                if kind in PAIRED:
                    score += self.after(sc, kind, right)
            near = self.odds("gap", sc, gap_kind(part.count(" ", prev, s) + (prev == 0)), None) if sc not in SPACELESS else 0.0
            places.append((e, score, min(0.0, near)))
            prev = e
        return places


def _quotes(part: str) -> list[tuple[int, int]]:
    """(start, end) of quotations, the end behind the closing mark; one pass, whatever their length."""
    signs = QUOTES.finditer(part)
    out: list[tuple[int, int]] = []
    start, want = -1, ""
    for m in signs:
        i, c = m.start(), m[0]
        if start >= 0:
            if c in want and (c != '"' or not part[i - 1].isspace()):
                out.append((start, i + 1))
                start = -1
        elif c in PAIRS:
            if any(part.find(x, i + 1) >= 0 for x in PAIRS[c]):
                start, want = i, PAIRS[c]
        elif c == '"' and (i == 0 or part[i - 1].isspace() or part[i - 1] in "([{—–-\"。！？：，"):
            start, want = i, c
    return out


def _brackets(part: str) -> list[int]:
    """Depth of brackets after each character; an opening one without its partner counts nothing."""
    stack: list[int] = []
    step = [0] * len(part)
    for i, c in enumerate(part):
        if c in "([（":
            stack.append(i)
        elif c in ")]）" and stack:
            step[stack.pop()] += 1
            step[i] -= 1
    return list(itertools.accumulate(step))


def viterbi(places: list[tuple[int, float, float]]) -> list[int]:
    """places: (position, score as a boundary, score of the step from a boundary just before) -> positions of the boundaries in the best sequence."""
    inside, bound = -INF, 0.0  # what comes before the first place is a boundary
    back: list[tuple[bool, bool]] = []
    for _, score, near in places:
        back.append((bound > inside, bound + near > inside))
        inside, bound = max(inside, bound), max(inside, bound + near) + score
    state, out = bound > inside, []
    for k in range(len(places) - 1, -1, -1):
        if state:
            out.append(places[k][0])
        state = back[k][state]
    return out[::-1]


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        c = Counts()
        for text in b["_t"]:
            c.add(text)
        yield pd.DataFrame(c.rows(), columns=["tbl", "script", "key", "at", "n"])


def train(docs: DataFrame, text: str = "text") -> DataFrame:
    """(tbl, script, key, at, n) over all rows. A key is kept from MIN_SHARE of its table's sightings on, so there are at most 1 / MIN_SHARE of a table."""
    d = spread(docs.select(F.col(text).alias("_t")).where(present("_t")))
    c = d.mapInPandas(_count, "tbl string, script string, key string, at bigint, n bigint").groupBy("tbl", "script", "key").agg(F.sum("at").alias("at"), F.sum("n").alias("n"))
    c = materialize(c)
    total = c.where("tbl like '%*'").groupBy(F.regexp_replace("tbl", r"\*", "").alias("tbl")).agg(F.sum("n").alias("total"))
    kept = c.join(F.broadcast(total), "tbl", "left").where((F.col("n") >= MIN_SHARE * F.col("total")) | F.col("total").isNull())
    return kept.where((F.col("n") >= 2) | F.col("tbl").rlike("[*/]")).select("tbl", "script", "key", "at", "n")


def sentences(docs: DataFrame, model: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(ident, sent_start, sent_end) of every row's units."""
    spark = docs.sparkSession
    rows = {(r["tbl"], r["script"], r["key"]): (r["at"], r["n"]) for r in model.collect()}  # bounded, see train()
    shared = spark.sparkContext.broadcast(rows)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = Tagger(shared.value)
        for b in batches:
            rows = [(i, a, e) for i, x in zip(b["_id"], b["_t"]) for a, e in t.units(x)]
            yield pd.DataFrame(rows, columns=[ident, "sent_start", "sent_end"])

    kind = docs.schema[ident].dataType.simpleString()
    return docs.select(F.col(ident).alias("_id"), F.col(text).alias("_t")).mapInPandas(run, f"{ident} {kind}, sent_start int, sent_end int")


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    """One row of each scored content: chosen by id before any text moves, so a content that many rows repeat is no hot key."""
    ids = table(spark, sf, "segments").select("doc_id").where("doc_id is not null").distinct()
    r = table(spark, sf, "raw_docs").where(present("text"))
    one = r.select("doc_id", "raw_id").join(ids, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("raw_id").alias("raw_id")).select("raw_id")
    return r.select("raw_id", "doc_id", "text").join(one, "raw_id", "left_semi").select("doc_id", "text")


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return sentences(_scored(spark, sf), train(table(spark, sf, "raw_docs")))


def p7_spans(spark: SparkSession, sf: str) -> DataFrame:
    """segments with span moved out to whole sentences; a span that meets none keeps its ends."""
    s = sentences(_scored(spark, sf), train(table(spark, sf, "raw_docs")))
    seg = table(spark, sf, "segments").where("doc_id is not null and span is not null").select("doc_id", "seg_no", F.col("span")[0].alias("a"), F.col("span")[1].alias("b")).distinct()
    j = seg.join(s, "doc_id", "left").where("sent_start is null or (sent_start < b and sent_end > a)")
    g = j.groupBy("doc_id", "seg_no", "a", "b").agg(F.min("sent_start").alias("x"), F.max("sent_end").alias("y"))
    return seg.join(g, ["doc_id", "seg_no", "a", "b"], "left").select(
        "doc_id", "seg_no", "a", "b", F.least("a", F.coalesce("x", "a")).alias("span_start"), F.greatest("b", F.coalesce("y", "b")).alias("span_end"))
