"""SQL twins of the queries that need more than a SELECT: sequential steps as recursive CTEs, folding as a join with a table of forms."""

from __future__ import annotations

import unicodedata

from palimpsest.config import ABBREVIATIONS, DISCOURSE_MARKERS, FUNCTION_WORDS, PRIME, QUERY_STOPWORDS, AlignConfig
from palimpsest.functions import kernels


def forms() -> list[tuple[int, str]]:
    """(code point, plain form) of every character that does not stand for itself; Hangul syllables follow a rule of their own."""
    out = []
    for o in range(128, 0x20000):
        if 0xD800 <= o < 0xE000 or 0xAC00 <= o < 0xD7A4 or not unicodedata.category(chr(o))[0] in "LMNPSZC":
            continue
        if (f := kernels.plain_form(chr(o))) != chr(o):
            out.append((o, f))
    return out


def folded(table: str, ident: str) -> str:
    """CTEs up to fd(id, folded): the text character by character in its plain form."""
    rows = ", ".join(f"({o}, [{', '.join(str(ord(c)) for c in f)}]::INTEGER[])" for o, f in forms())
    return f"""fm(o, f) AS (VALUES {rows}),
    fc AS (SELECT id, k, unicode(c) AS o, c FROM (SELECT {ident} AS id, generate_subscripts(l, 1) AS k, unnest(l) AS c FROM (SELECT {ident}, string_split(text, '') AS l FROM {table} WHERE text <> ''))),
    ff AS (SELECT id, k, CASE WHEN f IS NOT NULL THEN coalesce(array_to_string(list_transform(f, lambda x: chr(x)), ''), '')
        WHEN fc.o BETWEEN 44032 AND 55203 THEN chr((4352 + (fc.o - 44032) // 588)::INTEGER) || chr((4449 + (fc.o - 44032) % 588 // 28)::INTEGER) || CASE WHEN (fc.o - 44032) % 28 > 0 THEN chr((4519 + (fc.o - 44032) % 28)::INTEGER) ELSE '' END
        ELSE c END AS f FROM fc LEFT JOIN fm ON fc.o = fm.o),
    fd AS (SELECT id, string_agg(f, '' ORDER BY k) AS folded FROM ff GROUP BY id)"""


def fold_text() -> str:
    return f"WITH {folded('documents', 'doc_id')} SELECT doc_id, CASE WHEN text = '' THEN '' ELSE folded END AS folded FROM documents LEFT JOIN fd ON id = doc_id"


def query_phrases(count: int = 6, size: int = 6) -> str:
    """The best free window is taken `count` times; each step is a CTE."""
    stop = ", ".join(f"'{w}'" for w in sorted(QUERY_STOPWORDS))
    steps, free = [], "sc"
    for i in range(count):
        steps.append(f"p{i} AS (SELECT id, p FROM {free} QUALIFY row_number() OVER (PARTITION BY id ORDER BY v DESC, p) = 1)")
        steps.append(f"f{i} AS (SELECT x.* FROM {free} x JOIN p{i} y USING (id) WHERE abs(x.p - y.p) >= {size})")
        free = f"f{i}"
    taken = " UNION ALL ".join(f"SELECT id, p FROM p{i}" for i in range(count))
    return rf"""WITH {folded('documents', 'doc_id')},
    wl AS (SELECT id, list_transform(regexp_extract_all(regexp_replace(folded, '-[ \t]*\r?\n[ \t]*([a-z])', '\1', 'g'), '[A-Za-z0-9]+(?:''[A-Za-z]+)?'), lambda x: lower(x)) AS l FROM fd),
    wd AS (SELECT id, generate_subscripts(l, 1) - 1 AS p, unnest(l) AS w, len(l) AS n FROM wl),
    sc AS (SELECT id, p, v FROM (SELECT id, p, n, sum((length(w) > 3 AND w NOT IN ({stop}))::INTEGER) OVER (PARTITION BY id ORDER BY p ROWS BETWEEN CURRENT ROW AND {size - 1} FOLLOWING) AS v FROM wd) WHERE n > {size} AND p <= n - {size}),
    {", ".join(steps)}, tk AS ({taken}),
    ph AS (SELECT tk.id, p, array_to_string(l[p + 1:p + {size}], ' ') AS phrase FROM tk JOIN wl ON tk.id = wl.id UNION ALL SELECT id, 0, array_to_string(l, ' ') FROM wl WHERE len(l) BETWEEN 1 AND {size})
    SELECT id AS doc_id, (row_number() OVER (PARTITION BY id ORDER BY p) - 1)::INTEGER AS no, phrase FROM ph"""


def chain_seeds(docs: str, items: str, seeds: str) -> str:
    gap = AlignConfig().max_gap
    return f"""WITH RECURSIVE {docs}, {items}, {seeds},
    ar AS (SELECT doc_id, item_id, list({{'q': q, 's': s}} ORDER BY q, s) AS l FROM sd GROUP BY ALL),
    ch AS (SELECT doc_id, item_id, 0 AS n, []::STRUCT(a INTEGER, b INTEGER, c INTEGER, d INTEGER, k INTEGER)[] AS st FROM ar
      UNION ALL
      SELECT doc_id, item_id, n + 1, CASE WHEN coalesce(h, 0) = 0 THEN list_append(st, {{'a': x.q, 'b': x.q, 'c': x.s, 'd': x.s, 'k': 1}})
          ELSE list_transform(st, lambda y, i: CASE WHEN i = h THEN {{'a': y.a, 'b': greatest(y.b, x.q), 'c': least(y.c, x.s), 'd': greatest(y.d, x.s), 'k': y.k + 1}} ELSE y END) END
      FROM (SELECT doc_id, item_id, n, st, l[n + 1] AS x, list_position(list_transform(st, lambda y: l[n + 1].q - y.b <= {gap} AND abs(l[n + 1].q - l[n + 1].s - y.a + y.c) <= {gap}), true) AS h
            FROM ch JOIN ar USING (doc_id, item_id) WHERE n < len(l))),
    fin AS (SELECT doc_id, item_id, unnest(st) AS y FROM ch JOIN ar USING (doc_id, item_id) WHERE n = len(l))
    SELECT doc_id, item_id, y.a AS q_start, y.b AS q_end, y.c AS s_start, y.d AS s_end, y.k AS anchors FROM fin"""


ISOTONIC_FIT = """WITH RECURSIVE g AS (SELECT s, y, row_number() OVER (ORDER BY s, y) AS i FROM (SELECT score::DOUBLE AS s, (band IN ('likely-ai', 'very-likely-ai'))::INTEGER::DOUBLE AS y FROM segments WHERE score IS NOT NULL AND band IS NOT NULL)),
    r AS (SELECT 0 AS step, 0::BIGINT AS i, []::STRUCT(e DOUBLE, s DOUBLE, z DOUBLE)[] AS st
      UNION ALL
      SELECT step + 1, CASE WHEN viol THEN x.i ELSE x.i + 1 END, CASE WHEN viol
          THEN list_append(list_slice(st, 1, len(st) - 2), {'e': greatest(st[-2].e, st[-1].e), 's': st[-2].s + st[-1].s, 'z': st[-2].z + st[-1].z})
          ELSE list_append(st, {'e': g.s, 's': g.y, 'z': 1.0::DOUBLE}) END
      FROM (SELECT step, i, st, coalesce(len(st) > 1 AND st[-2].s / st[-2].z > st[-1].s / st[-1].z, false) AS viol FROM r) x LEFT JOIN g ON g.i = x.i + 1 WHERE viol OR g.i IS NOT NULL)
    SELECT y.e AS breakpoint, y.s / y.z AS value FROM (SELECT unnest(st) AS y FROM r WHERE step = (SELECT max(step) FROM r))"""

LM_TRIPLES = """WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS r FROM embeddings WHERE embedding IS NOT NULL)
    SELECT vec_id, label::VARCHAR AS token, round(r[label + 1] - list_max(r) - ln(list_sum(list_transform(r, lambda x: exp(x - list_max(r))))), 6) AS logp,
    round(ln(1 + len(list_filter(r, lambda x: x > r[label + 1]))), 6) AS logr FROM e WHERE label >= 0 AND label < len(r)"""


def with_sentinel(sig: str, name: str, table: str, ident: str, fps: str) -> str:
    """The signatures plus those of rows without fingerprints: the prime in every slot."""
    return f"{name} AS (SELECT * FROM {sig} UNION ALL SELECT {ident}, slot::INTEGER, {PRIME}::BIGINT FROM {table} CROSS JOIN {sig}_p WHERE {ident} NOT IN (SELECT id FROM {fps}))"


def _sentences(space: str) -> str:
    """Folded characters with their places, words joined over line ends, stops that end a sentence, and their places in the stored text."""
    names = ", ".join(f"'{w}'" for w in sorted(ABBREVIATIONS))
    return rf"""{folded('documents', 'doc_id')},
    br AS (SELECT id, generate_subscripts(l, 1) AS n, unnest(l) AS x FROM (SELECT id, regexp_extract_all(folded, '(?s)-[ \t]*\r?\n[ \t]*[a-z]|.') AS l FROM fd)),
    kp AS (SELECT id, n, generate_subscripts(y, 1) AS m, length(x) AS len, unnest(y) AS c FROM (SELECT id, n, x, string_split(x, '') AS y FROM br)),
    fo AS (SELECT id, k - 1 AS pl, row_number() OVER (PARTITION BY id ORDER BY k, i) AS r FROM (SELECT id, k, generate_subscripts(z, 1) AS i, unnest(z) AS c FROM (SELECT id, k, string_split(f, '') AS z FROM ff WHERE f <> ''))),
    nr AS (SELECT id, c, m, len, row_number() OVER (PARTITION BY id ORDER BY n, m) AS r FROM kp),
    tx AS (SELECT id, c, pl, row_number() OVER (PARTITION BY id ORDER BY r) - 1 AS j FROM nr JOIN fo USING (id, r) WHERE m = len),
    st AS (SELECT id, string_agg(c, '' ORDER BY j) AS t, count(*) AS n FROM tx GROUP BY id),
    pc AS (SELECT id, t, generate_subscripts(l, 1) AS q, unnest(l) AS x FROM (SELECT id, t, regexp_extract_all(t, '(?s)[.!?]["''\)\]]*|[^.!?]+') AS l FROM st)),
    po AS (SELECT id, t, x, sum(length(x)) OVER (PARTITION BY id ORDER BY q) AS e FROM pc),
    en AS (SELECT id, e FROM (SELECT id, e, regexp_replace(regexp_replace(lower(substr(t, greatest(0, e - length(x) - 12)::BIGINT + 1, least(12, e - length(x))::BIGINT)), '{space}+$', ''), '^(?s:.*){space}', '') AS w, substr(t, e::BIGINT + 1, 1) AS nx FROM po WHERE regexp_matches(x, '^[.!?]'))
        WHERE (nx = '' OR regexp_matches(nx, '^{space}')) AND NOT (rtrim(w, '.') IN ({names}) OR regexp_matches(rtrim(w, '.'), '^\pL$'))),
    bd AS (SELECT id, e AS b FROM en UNION SELECT id, n FROM st UNION SELECT id, 0 FROM st),
    sg AS (SELECT id, b AS s, lead(b) OVER (PARTITION BY id ORDER BY b) AS e FROM bd),
    ok AS (SELECT sg.id, s, e FROM sg JOIN st USING (id) WHERE e > s AND regexp_matches(substr(t, s::BIGINT + 1, (e - s)::BIGINT), '[^\s\x0B\x1c-\x1f]')),
    sp AS (SELECT ok.id, a.pl::INTEGER AS "start", (z.pl + 1)::INTEGER AS "end" FROM ok JOIN tx a ON a.id = ok.id AND a.j = s JOIN tx z ON z.id = ok.id AND z.j = e - 1)"""


def sentence_spans(space: str) -> str:
    return f'WITH {_sentences(space)} SELECT id AS doc_id, "start", "end" FROM sp'


def stylometry(space: str, zero: list[str]) -> str:
    """The features of style by grouping: words of the folded text, their sentences by place, marks. Those named in zero need a language model."""
    words = lambda ws: ", ".join(f"'{w}'" for w in sorted(ws))
    share = lambda c: f"round(sum(CASE WHEN {c} THEN n ELSE 0 END) / sum(n), 6)::DOUBLE"
    return rf"""WITH {_sentences(space)},
    wp AS (SELECT id, q, x, sum(length(x)) OVER (PARTITION BY id ORDER BY q) - length(x) AS b FROM (SELECT id, generate_subscripts(l, 1) AS q, unnest(l) AS x FROM (SELECT id, regexp_extract_all(t, '[A-Za-z0-9]+(?:''[A-Za-z]+)?|[^A-Za-z0-9]+') AS l FROM st))),
    wo AS (SELECT wp.id, lower(x) AS w, pl FROM wp JOIN tx ON tx.id = wp.id AND tx.j = wp.b WHERE regexp_matches(x, '^[A-Za-z0-9]')),
    sz AS (SELECT sp.id, sp."start", count(*) AS n FROM sp JOIN wo ON wo.id = sp.id AND wo.pl >= sp."start" AND wo.pl < sp."end" GROUP BY ALL),
    sm AS (SELECT id, avg(n) AS m, stddev_pop(n) AS sd FROM sz GROUP BY id),
    wc AS (SELECT id, w, count(*) AS n FROM wo GROUP BY ALL),
    ws AS (SELECT id, round(count(*) / sum(n), 6)::DOUBLE AS tt, {share("n = 1")} AS hx, {share(f"w IN ({words(FUNCTION_WORDS)})")} AS fw, {share(f"w IN ({words(DISCOURSE_MARKERS)})")} AS dm FROM wc GROUP BY id),
    mk AS (SELECT id, c, count(*) AS n FROM tx WHERE NOT regexp_matches(c, '^[\pL\pN]') AND NOT regexp_matches(c, '^{space}') GROUP BY ALL),
    me AS (SELECT id, abs(log2(sum(n)) - sum(n * log2(n)) / sum(n)) AS h FROM mk GROUP BY id)
    SELECT doc_id, {", ".join(f"0.0::DOUBLE AS {z}" for z in zero)}, coalesce(round(m, 6), 0)::DOUBLE AS sent_len_mean, coalesce(round(sd / m, 6), 0)::DOUBLE AS sent_len_cv, coalesce(tt, 0)::DOUBLE AS type_token_ratio, coalesce(hx, 0)::DOUBLE AS hapax_ratio,
    coalesce(fw, 0)::DOUBLE AS function_word_ratio, CASE WHEN ws.id IS NULL THEN 0.0 ELSE coalesce(round(h, 6), 0) END::DOUBLE AS punct_entropy, coalesce(dm, 0)::DOUBLE AS discourse_marker_rate, false AS has_likelihood
    FROM documents LEFT JOIN ws ON ws.id = doc_id LEFT JOIN sm ON sm.id = doc_id LEFT JOIN me ON me.id = doc_id"""
