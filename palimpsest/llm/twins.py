"""SQL twins of the problems whose rules plain SQL can say over a small input."""

from __future__ import annotations

import unicodedata

from .p1_canonical import INVISIBLE, canonical

TOKENS = "list_transform(regexp_extract_all(text, '[A-Za-z0-9]+(?:''[A-Za-z]+)?'), lambda x: lower(x))"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def canonical_sql(text: str) -> str:
    """The canonical form: invisible characters go, composed characters are mapped one by one, several-letter forms by replacement.

    The table has one entry a character whose canonical form is another; the rule is the operator's, applied to single characters.
    """
    one_from, one_to, more = [], [], []
    for o in range(0x80, 0x1F000):
        c = chr(o)
        if 0xD800 <= o < 0xE000 or unicodedata.category(c) in ("Cn", "Co"):
            continue
        f = canonical(c)
        if f == c or unicodedata.normalize("NFC", c) == f:
            continue
        if len(f) == 1:
            one_from.append(c)
            one_to.append(f)
        elif f:
            more.append((c, f))
    ranges = INVISIBLE.encode("unicode_escape").decode().replace("\\U000", "\\U000")
    import re

    cls = re.sub(r"\\u([0-9a-f]{4})|\\U([0-9a-f]{8})|\\x([0-9a-f]{2})", lambda m: "\\x{" + (m[1] or m[2] or m[3]).lstrip("0") + "}", ranges)
    out = f"regexp_replace(regexp_replace({text}, '\\r\\n?', chr(10), 'g'), '[{cls}]', '', 'g')"
    out = f"translate(nfc_normalize({out}), {_quoted(''.join(one_from))}, {_quoted(''.join(one_to))})"
    for c, f in more:
        out = f"replace({out}, {_quoted(c)}, {_quoted(f)})"
    return f"nfc_normalize({out})"


def _runs(n: int) -> str:
    """CTEs tk(raw_id, l) and rn(raw_id, pos, run): every run of n tokens of the stored text."""
    return f"""tk AS (SELECT raw_id, {TOKENS} AS l FROM raw_docs WHERE text <> ''),
    rn AS (SELECT raw_id, pos, md5(array_to_string(l[pos + 1:pos + {n}], ' ')) AS run FROM (SELECT raw_id, l, unnest(range(0, len(l) - {n - 1})) AS pos FROM tk WHERE len(l) >= {n}))"""


def oracle_sql() -> dict[str, str]:
    words = f"regexp_extract_all(lower({canonical_sql('text')}), '[a-z0-9]+')"
    gram = lambda t, i: f"(SELECT {i}, n, array_to_string(l[p + 1:p + least(n, 13)], ' ') AS g FROM (SELECT {i}, n, l, unnest(range(0, len(l) - least(n, 13) + 1)) AS p FROM {t} WHERE len(l) >= least(n, 13)))"
    return {
        "p1_normalized": f"SELECT raw_id, {canonical_sql('text')} AS canonical_text, text IS DISTINCT FROM {canonical_sql('text')} AS changed FROM raw_docs",
        "p1_found": f"WITH c AS (SELECT raw_id, text, {canonical_sql('text')} AS form FROM raw_docs WHERE text <> '') SELECT a.raw_id AS raw_id_a, b.raw_id AS raw_id_b FROM c a JOIN c b ON a.form = b.form AND a.text <> b.text AND a.raw_id < b.raw_id",
        "p2_found": f"WITH {_runs(40)}, d AS (SELECT DISTINCT raw_id, run FROM rn) SELECT DISTINCT a.raw_id AS raw_id_a, b.raw_id AS raw_id_b FROM d a JOIN d b ON a.run = b.run AND a.raw_id < b.raw_id",
        "p2_share": f"""WITH {_runs(40)}, sh AS (SELECT run FROM rn GROUP BY run HAVING count(DISTINCT raw_id) > 1), cv AS (SELECT DISTINCT raw_id, unnest(range(pos, pos + 40)) AS t FROM rn JOIN sh USING (run)),
            n AS (SELECT raw_id, count(*) AS k FROM cv GROUP BY raw_id) SELECT raw_id, coalesce(len(l), 0)::INTEGER AS n_tokens, coalesce(k, 0)::INTEGER AS shared_tokens,
            CASE WHEN len(l) > 0 THEN round(coalesce(k, 0) / len(l), 6) ELSE 0.0 END::DOUBLE AS share FROM raw_docs LEFT JOIN tk USING (raw_id) LEFT JOIN n USING (raw_id)""",
        "p4_found": f"""WITH {_runs(5)}, tx AS (SELECT text, min(raw_id) AS cls FROM raw_docs WHERE text <> '' GROUP BY text), rr AS (SELECT raw_id, doc_id, batch_no, cls FROM raw_docs JOIN tx USING (text) WHERE batch_no IS NOT NULL),
            d AS (SELECT DISTINCT raw_id AS cls, run FROM rn WHERE raw_id IN (SELECT cls FROM tx)), n AS (SELECT cls, count(*) AS n FROM d GROUP BY cls),
            c AS (SELECT a.cls AS a, b.cls AS b, count(*) AS k FROM d a JOIN d b ON a.run = b.run AND a.cls < b.cls GROUP BY ALL),
            s AS (SELECT a, b FROM c JOIN n x ON x.cls = a JOIN n y ON y.cls = b WHERE k >= 0.7 * (x.n + y.n - k) - 1e-9),
            p AS (SELECT a, b FROM s UNION ALL SELECT b, a FROM s UNION ALL SELECT cls, cls FROM tx)
            SELECT x.raw_id AS raw_id_a, y.raw_id AS raw_id_b FROM p JOIN rr x ON x.cls = a JOIN rr y ON y.cls = b WHERE x.batch_no < y.batch_no AND x.doc_id IN (SELECT doc_id FROM source_meta)""",
        "p8_found": f"""WITH i AS (SELECT item_id, l, len(l) AS n FROM (SELECT item_id, {words} AS l FROM eval_items WHERE text <> '') WHERE len(l) > 0),
            ig AS {gram('i', 'item_id')}, ns AS (SELECT DISTINCT least(n, 13) AS n FROM i), d AS (SELECT doc_id, l, n FROM (SELECT doc_id, {words} AS l FROM documents WHERE text <> '') CROSS JOIN ns),
            dg AS {gram('d', 'doc_id')} SELECT DISTINCT doc_id, item_id FROM dg JOIN ig ON dg.g = ig.g AND dg.n = least(ig.n, 13)""",
    }
