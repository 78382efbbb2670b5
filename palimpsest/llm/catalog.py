"""The queries of this subpackage, for the driver, and the SQL twins of those whose rules SQL can say."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import twins
from . import p1_canonical, p2_spans, p3_encoding, p4_history, p5_markup, p6_scans, p7_sentences, p8_leaks, p9_mix, p10_residue

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "p1_found": p1_canonical.p1_found, "p1_normalized": p1_canonical.p1_normalized,
        "p2_found": p2_spans.p2_found, "p2_share": p2_spans.p2_share,
        "p3_found": p3_encoding.p3_found, "p3_restored": p3_encoding.p3_restored,
        "p4_found": p4_history.p4_found,
        "p5_found": p5_markup.p5_found, "p5_clean": p5_markup.p5_clean, "p5_wrappers": p5_markup.p5_wrappers,
        "p6_found": p6_scans.p6_found, "p6_repaired": p6_scans.p6_repaired,
        "p7_found": p7_sentences.p7_found, "p7_spans": p7_sentences.p7_spans,
        "p8_found": p8_leaks.p8_found,
        "p9_mix": p9_mix.p9_mix, "p9_shares": p9_mix.p9_shares,
        "p10_found": p10_residue.p10_found,
    }


def oracle_sql() -> dict[str, str]:
    return twins.oracle_sql()
