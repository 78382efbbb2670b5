"""Problem 6: scanned pages repaired into continuous paragraphs.

1. Page furniture is found in each record: lines that are only a page number (in one of several
   styles, in rising order or at a page's end) and running heads (lines that come again, or that
   interrupt a sentence beside a page break).
2. Words cut at a line end are joined, unless the hyphen is the word's own: a word counts as a
   compound if the vocabulary knows it with its hyphen and not without.
3. Misread words: a Levenshtein automaton, widened by the multi-letter confusions of scanners, is
   intersected with a trie of the vocabulary, which yields every word within the distance; the
   candidates are ranked by kind of edit, by whether the record uses the word elsewhere, and by
   frequency. Unknown words only are looked up, in hard-wrapped records only.

The vocabulary comes from all rows that are not hard-wrapped. A word enters if it makes up at least
MIN_SHARE of all words, so it has at most 1 / MIN_SHARE entries, whatever the size of the input;
that bound is what allows it to be broadcast.

Null and empty texts have no noise and are repaired to themselves. Lines end at \\n only.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, present, spread, table

MIN_SHARE = 1e-6
MIN_COUNT = 3
WORDS = r"[\p{L}]+(?:['’][\p{L}]+)?(?:-[\p{L}]+)*"
# What scanners mistake for each other (as it is read, what stood there).
CONFUSIONS = [
    ("0", "o"), ("1", "l"), ("1", "i"), ("5", "s"), ("8", "b"), ("6", "b"), ("9", "g"), ("2", "z"), ("3", "e"), ("4", "a"), ("7", "t"),
    ("|", "l"), ("l", "i"), ("i", "l"), ("c", "e"), ("e", "c"), ("o", "a"), ("a", "o"), ("h", "b"), ("b", "h"), ("u", "n"), ("n", "u"),
    ("f", "t"), ("t", "f"), ("s", "a"), ("a", "s"), ("o", "e"), ("e", "o"), ("v", "y"), ("y", "v"), ("q", "g"), ("g", "q"), ("j", "i"), ("t", "l"), ("l", "t"), ("o", "c"), ("c", "o"), ("f", "s"), ("k", "h"),
    ("rn", "m"), ("m", "rn"), ("nn", "m"), ("m", "nn"), ("cl", "d"), ("d", "cl"), ("ri", "n"), ("n", "ri"), ("ii", "u"), ("u", "ii"), ("li", "h"), ("h", "li"), ("vv", "w"), ("w", "vv"),
    ("lc", "k"), ("k", "lc"), ("in", "m"), ("m", "in"), ("ni", "m"), ("m", "ni"), ("ti", "h"), ("h", "ti"), ("tl", "d"), ("ci", "a"), ("fi", "ﬁ"), ("ll", "u"), ("u", "ll"), ("rri", "m"), ("il", "u"), ("ln", "m"), ("ui", "m"), ("iu", "m"), ("lii", "m"),
]
HYPHENS = "-­‐‑¬"
BROKEN = re.compile(rf"([^\W\d_]+(?:-[^\W\d_]+)*)[{HYPHENS}]\s*$")
ROMAN = re.compile(r"m{0,3}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})", re.I)
STYLES = [
    ("dash", re.compile(r"[-–—~] ?(\w{1,5}) ?[-–—~]")),
    ("of", re.compile(r"(?:page|p\.|seite|s\.|pág(?:ina|\.)|str\.)\s?(\w{1,5}) (?:of|von|de|z|/) \w{1,5}", re.I)),
    ("word", re.compile(r"(?:page|pp?\.|pg\.|seite|s\.|pág(?:ina|\.)|str\.)\s?(\w{1,5})", re.I)),
    ("ratio", re.compile(r"(\d{1,4}) ?/ ?\d{1,4}")),
    ("bracket", re.compile(r"[\[(|] ?(\d{1,4}) ?[\])|]")),
    ("bare", re.compile(r"([\dOolIS]{1,4})")),
    ("roman", re.compile(r"([ivxlcdmIVXLCDM]{1,8})")),
]
DIGIT = str.maketrans("OolIS", "00115")
NUMBERED = re.compile(r"^\d{1,4}\s{2,}\S|\S\s{2,}\d{1,4}$|\S [/|·•] ?\d{1,4}$|^\d{1,4} ?[/|·•] \S")
SAME = str.maketrans("01589", "olsbg")
TOKEN = re.compile(r"[^\W_]+(?:['’][^\W\d_]+)?", re.U)


def roman(s: str) -> int | None:
    if not ROMAN.fullmatch(s):
        return None
    v = [dict(i=1, v=5, x=10, l=50, c=100, d=500, m=1000)[c] for c in s.lower()]
    return sum(-a if a < b else a for a, b in zip(v, [*v[1:], 0]))


def hard_wrapped(lines: list[str]) -> bool:
    n = sorted(len(x) for x in lines if x.strip())
    return len(n) >= 4 and 25 <= n[len(n) // 2] and n[len(n) * 8 // 10] <= 90


def page_number(line: str) -> tuple[str, int] | None:
    s = line.strip(" \t\f")
    for style, p in STYLES:
        if m := p.fullmatch(s):
            g = m[1].translate(DIGIT)
            if g.isdigit() and (style != "bare" or any(c.isdigit() for c in m[1])):
                return style, int(g)
            if style != "bare" and (v := roman(m[1])):
                return "roman" if style == "roman" else style, v
    return None


def head_form(line: str) -> str:
    s = re.sub(r"^\d{1,4}\s{2,}|\s{2,}\d{1,4}$|\s[/|·•] ?\d{1,4}$|^\d{1,4} ?[/|·•] ", "", line.strip(" \t\f").lower())
    s = s.translate(SAME)
    for a, b in (("rn", "m"), ("cl", "d"), ("ri", "n"), ("ii", "u"), ("l", "i"), ("c", "e"), ("a", "o")):
        s = s.replace(a, b)
    return s


def furniture(lines: list[str], starts: list[int] | None = None) -> dict[int, str]:
    """line index -> 'header' or 'page_number'."""
    out: dict[int, str] = {}
    n = len(lines)
    numbers = {i: p for i, x in enumerate(lines) if x.strip() and (p := page_number(x))}
    pos, offsets = 0, []
    for x in lines:
        offsets.append(pos)
        pos += len(x) + 1
    last = max((i for i, x in enumerate(lines) if x.strip()), default=0)
    near = [s for s in (starts or []) if s and s > 0]

    def at_break(i: int) -> bool:
        return i == last or any(-60 <= s - offsets[i] <= len(lines[i]) + 120 for s in near) or "\f" in lines[i] or (i + 1 < n and lines[i + 1].startswith("\f"))

    for i, (style, v) in numbers.items():
        same = [(j, w) for j, (s, w) in numbers.items() if s == style and j != i]
        if style in ("bare", "roman") and any(j in (i - 1, i + 1) for j, _ in same):
            continue  # a column of figures
        follows = any((w - v) * (j - i) > 0 and abs(j - i) >= 4 * abs(w - v) for j, w in same)
        if style in ("dash", "of", "word") or follows or at_break(i):
            out[i] = "page_number"
    width = sorted(len(x) for x in lines if x.strip())[-max(1, n // 10)] if last else 0
    free = [i for i, x in enumerate(lines) if x.strip() and i not in out]
    forms = {i: head_form(lines[i]) for i in free}
    often: dict[str, list[int]] = {}
    for i in free:
        often.setdefault(forms[i], []).append(i)

    def heads(i: int) -> bool:
        s = lines[i].strip(" \t\f")
        return bool(re.search(r"[^\W\d_]{2}", s)) and not re.search(r"[.,;!?]$", s) and not (s[0].islower() and not NUMBERED.search(s)) and len(s) <= 100

    for form, at in often.items():
        if len(at) >= 2 and all(b - a >= 4 for a, b in zip(at, at[1:])) and all(map(heads, at)) and form.strip(" .-"):
            if any(at_top(i, out, lines, near, offsets) for i in at):
                out.update((i, "header") for i in at)
    paged = bool(out)
    for i in free:
        if i in out or not heads(i):
            continue
        s = lines[i].strip(" \t\f")
        top = at_top(i, out, lines, near, offsets)
        if not top:
            continue
        letters = [c for c in s if c.isalpha()]
        capital = len(letters) >= 4 and sum(c.isupper() for c in letters) >= 0.8 * len(letters)
        before = next((j for j in range(i - 1, -1, -1) if lines[j].strip() and j not in out), None)
        after = next((j for j in range(i + 1, n) if lines[j].strip() and j not in out), None)
        cut = before is not None and not re.search(r"[.!?:][\"'”’)\]]*\s*$", lines[before]) and after is not None and lines[after].strip()[:1].islower()
        if NUMBERED.search(s) or capital and (paged or near or "\f" in lines[i]) or cut and (paged or "\f" in lines[i] or near) and not re.search(r"[.,;!?)]", s) and re.match(r"[A-Z0-9]", s) and len(s) + 1 + len(lines[after].split()[0]) <= width:
            out[i] = "header"
    return out


def at_top(i: int, known: dict[int, str], lines: list[str], near: list[int], offsets: list[int]) -> bool:
    """Whether a page may begin with this line."""
    if "\f" in lines[i]:
        return True
    j = i - 1
    while j >= 0 and not lines[j].strip():
        j -= 1
    if j < 0 or known.get(j) == "page_number" or lines[j].endswith("\f"):
        return True
    return any(-100 <= s - offsets[i] <= 100 for s in near) or NUMBERED.search(lines[i].strip()) is not None


class Lexicon:
    """The vocabulary as a trie, with the widened Levenshtein automaton run over it."""

    def __init__(self, counts: dict[str, int]):
        self.counts = counts
        self.common = max(20, 2e-5 * sum(counts.values()))
        self.root: dict = {}
        for w in counts:
            node = self.root
            for c in w:
                node = node.setdefault(c, {})
            node[""] = w
        self.read: dict[str, list[tuple[str, str]]] = {}
        for a, b in CONFUSIONS:
            self.read.setdefault(a[0], []).append((a, b))
        self.memo: dict[str, list[tuple[float, str, int]]] = {}

    def candidates(self, word: str) -> list[tuple[float, str, int]]:
        """(cost, vocabulary word, where the first edit is): every one within cost 1 or two confusions."""
        got = self.memo.get(word)
        if got is None:
            if len(self.memo) > 100_000:
                self.memo.clear()
            got = self.memo[word] = self._search(word)
        return got

    def _search(self, word: str) -> list[tuple[float, str, int]]:
        best: dict[str, tuple[float, int]] = {}
        n = len(word)
        # state: position in the word, node of the trie, cost, place of the first edit
        stack = [(0, self.root, 0.0, -1)]
        seen: dict[tuple[int, int], float] = {}
        while stack:
            i, node, cost, first = stack.pop()
            key = (i, id(node))
            if seen.get(key, 9.0) <= cost:
                continue
            seen[key] = cost
            if i == n and "" in node:
                w = node[""]
                if cost < best.get(w, (9.0, 0))[0]:
                    best[w] = (cost, first)
            if i < n:
                c = word[i]
                if c in node and c:
                    stack.append((i + 1, node[c], cost, first))
                if cost <= 0.5:
                    for a, b in self.read.get(c, ()):
                        if word.startswith(a, i):
                            x = node
                            for d in b:
                                x = x.get(d)
                                if x is None:
                                    break
                            if x is not None:
                                stack.append((i + len(a), x, cost + 0.5, first if first >= 0 else i))
                if cost == 0:
                    f = first if first >= 0 else i
                    stack.append((i + 1, node, 1.0, f))
                    stack += [(i + 1, x, 1.0, f) for d, x in node.items() if d and d != c]
            if cost == 0:
                stack += [(i, x, 1.0, first if first >= 0 else i) for d, x in node.items() if d]
        return sorted((c, w, f) for w, (c, f) in best.items() if w != word)

    def correct(self, word: str, used: Counter | None = None) -> tuple[str, int] | None:
        """(right word, place of the first edit) if `word` is taken for a misread one."""
        low = word.lower()
        if low in self.counts or len(low) < 3 or not low[0].isalnum():
            return None
        digits = any(c.isdigit() for c in low)
        if digits and not re.search(r"[^\W\d_].*[^\W\d_]|[^\W\d_]{2}", low):
            return None
        named = word[0].isupper()  # a name unless the right word is a common one
        ranked = []
        for cost, w, at in self.candidates(low):
            k = self.counts[w]
            if any(c.isdigit() for c in w):
                continue
            if cost == 1.0 and not self._confused(low, w):  # some other edit
                if digits or named or len(low) < 5 or k < 30 or abs(len(w) - len(low)) > 0:
                    continue
            elif k < (self.common if named else 3):
                continue
            ranked.append((cost, -(used[w] > 0 if used else 0), -k, w, at))
        return min(ranked)[3:5] if ranked else None

    @staticmethod
    def _confused(low: str, w: str) -> bool:
        """Whether two confusions lead from one to the other."""
        def steps(s: str) -> set[str]:
            return {s[:i] + b + s[i + len(a):] for a, b in CONFUSIONS for i in range(len(s)) if s.startswith(a, i)}
        return any(w in steps(x) for x in steps(low))


def number_misread(tok: str) -> bool:
    """Digits with letters that look like digits among them; codes such as B2 or 5b are left alone."""
    if re.fullmatch(r"[\dOolISBb]+", tok) is None or tok.isdigit() or not any(c.isdigit() for c in tok):
        return False
    return len(tok) > 2 or re.fullmatch(r"\d[OolI]|[OolI]\d", tok) is not None


def noise(text: str, starts: list[int] | None, lex: Lexicon) -> tuple[list[tuple[int, str]], str]:
    """([(line number from 1, kind)], repaired text)."""
    lines = text.split("\n")
    if not hard_wrapped(lines):
        return [], text
    known = furniture(lines, starts)
    found = {(i + 1, k) for i, k in known.items()}
    body = [i for i, x in enumerate(lines) if i not in known]
    used = Counter(w.lower() for i in body for w in TOKEN.findall(lines[i]))
    fixed = {i: lines[i].strip("\f") for i in body}

    def fix(tok: str) -> tuple[str, int] | None:
        if number_misread(tok):
            return tok.translate(str.maketrans("OolISBb", "0011586")), 0
        return lex.correct(tok, used)

    def cased(right: str, tok: str) -> str:
        return right[0].upper() + right[1:] if tok[0].isupper() and right else right

    joins: dict[int, tuple[int, bool]] = {}
    skip: set[tuple[int, int]] = set()
    for k, i in enumerate(body):
        m = BROKEN.search(lines[i].rstrip("\f "))
        nxt = next((j for j in body[k + 1:] if lines[j].strip()), None)
        if not m or nxt is None or nxt - i > 6:
            continue
        h = re.match(r"[\f\s]*([^\W_]+(?:-[^\W\d_]+)*)", lines[nxt])
        if not h or not h[1][0].islower() and not h[1][0].isdigit():
            continue
        head = m[1].rsplit("-", 1)
        left, right = head[-1], h[1].split("-")[0]
        whole, compound = (left + right).lower(), f"{left}-{right}".lower()
        soft = lines[i].rstrip("\f ")[-1] != "-"
        full_compound = (m[1] + "-" + h[1]).lower()
        a, b = lex.counts.get(whole, 0), max(lex.counts.get(compound, 0), lex.counts.get(full_compound, 0))
        if not a and not b:
            c = lex.correct(left + right, used)
            a = lex.counts.get(c[0], 0) if c else 0
            if not a and left.lower() in lex.counts and right.lower() in lex.counts and not soft and len(right) > 3 and len(left) > 3:
                b = 1
        own = b > a
        joins[i] = (nxt, own)
        if not own:
            found.add((i + 1, "hyphen"))
            if left[:1].isascii() and (c := fix(left + right)):
                found.add(((i if c[1] < len(left) else nxt) + 1, "misread"))
            skip |= {(i, m.end(1) - len(left)), (nxt, h.start(1))}
        elif b:
            skip |= {(i, m.end(1) - len(left)), (nxt, h.start(1))} if compound in lex.counts or full_compound in lex.counts else set()
    for i in body:
        x = lines[i]

        def repair(m: re.Match) -> str:
            t = m[0]
            s, e = m.start(), m.end()
            if (i, s) in skip or x[s - 1:s] in ("_", "\\", "@") or x[e:e + 1] in ("_", "@") or (x[s - 1:s] == "." and s > 1 and x[s - 2].isalnum()) or (x[e:e + 1] == "." and x[e + 1:e + 2].isalnum()):
                return t
            if (x[e:e + 1] == "-" or x[s - 1:s] == "-") and not t.isdigit():
                a, b = x[:s].rfind(" ") + 1, (x.find(" ", e) + 1 or len(x) + 1) - 1
                if x[a:b].strip("\"'(),.;:!?“”[]").lower() in lex.counts:
                    return t
            c = fix(t)
            if not c:
                return t
            found.add((i + 1, "misread"))
            return cased(c[0], t)

        fixed[i] = TOKEN.sub(repair, x.strip("\f"))
    return sorted(found), _reflow(lines, body, fixed, joins, lex)


def _reflow(lines: list[str], body: list[int], fixed: dict[int, str], joins: dict[int, tuple[int, bool]], lex: Lexicon) -> str:
    width = max((len(lines[i]) for i in body), default=0)
    paragraphs: list[str] = []
    cur = ""
    glue = False
    for k, i in enumerate(body):
        s = fixed[i].strip()
        if not s:
            # blank lines beside page furniture separate nothing inside a sentence
            if cur and re.search(r"[.!?:][\"'”’)\]]*$", cur):
                paragraphs.append(cur)
                cur = ""
            continue
        cur = cur + s if glue or not cur else f"{cur} {s}"
        glue = False
        if i in joins:
            glue = True
            if not joins[i][1]:
                cur = re.sub(rf"[{HYPHENS}]\s*$", "", cur)
        elif re.search(r"[.!?:][\"'”’)\]]*$", s) and len(s) < 0.75 * width:
            paragraphs.append(cur)
            cur = ""
    if cur:
        paragraphs.append(cur)
    return "\n\n".join(paragraphs)


def vocabulary(texts: DataFrame, text: str = "text") -> DataFrame:
    """(word, n): lower-cased words of rows that are not hard-wrapped, each at least MIN_SHARE of those that come MIN_COUNT times."""
    d = texts.select(F.col(text).alias("_t")).where(present("_t"))
    # a line of more than 90 characters: not hard-wrapped
    d = d.where(F.col("_t").rlike(r"(?m)^.{120,}$") & F.col("_t").rlike("[A-Za-z]"))
    # words and the parts of compounds
    w = d.select(F.explode(F.regexp_extract_all(F.lower("_t"), F.lit(WORDS), F.lit(0))).alias("word"))
    w = w.where(F.col("word").rlike("^[^\\u0370-\\uffff]+$")).groupBy("word").agg(F.count("*").alias("n"))
    parts = w.where(F.contains("word", F.lit("-"))).select(F.explode(F.split("word", "-")).alias("word"), "n")
    w = w.unionByName(parts).groupBy("word").agg(F.sum("n").alias("n"))
    w = materialize(w.where(F.col("n") >= MIN_COUNT))
    total = w.agg(F.sum("n")).first()[0] or 0
    return w.where(F.col("n") >= MIN_SHARE * total)


def scan_noise(docs: DataFrame, vocab: DataFrame, ident: str = "raw_id", text: str = "text", starts: str = "page_starts") -> DataFrame:
    """(ident, noise array<struct<line_no, kind>>, repaired) of every row."""
    spark = docs.sparkSession
    words = {r["word"]: r["n"] for r in vocab.collect()}  # at most 1 / MIN_SHARE words, see vocabulary()
    shared = spark.sparkContext.broadcast(words)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lex = None
        for b in batches:
            rows = []
            for i, t, s in zip(b["_id"], b["_t"], b["_s"]):
                if not t:
                    rows.append((i, [], t))
                    continue
                lex = lex or Lexicon(shared.value)
                f, r = noise(t, None if s is None else list(s), lex)
                rows.append((i, [{"line_no": n, "kind": k} for n, k in f], r))
            yield pd.DataFrame(rows, columns=[ident, "noise", "repaired"])

    kind = docs.schema[ident].dataType.simpleString()
    d = spread(docs.select(F.col(ident).alias("_id"), F.col(text).alias("_t"), F.col(starts).alias("_s")))
    return d.mapInPandas(run, f"{ident} {kind}, noise array<struct<line_no:int,kind:string>>, repaired string")


def _vocab(spark: SparkSession, sf: str) -> DataFrame:
    return vocabulary(table(spark, sf, "raw_docs").select("text").unionByName(table(spark, sf, "documents").select("text")))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "raw_docs").where(present("text") & F.contains("text", F.lit("\n")))
    return scan_noise(d, _vocab(spark, sf)).select("raw_id", F.explode("noise").alias("x")).select("raw_id", F.col("x.line_no").alias("line_no"), F.col("x.kind").alias("kind"))


def p6_repaired(spark: SparkSession, sf: str) -> DataFrame:
    return scan_noise(table(spark, sf, "raw_docs"), _vocab(spark, sf)).select("raw_id", "repaired")
