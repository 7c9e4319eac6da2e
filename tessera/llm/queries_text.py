"""Registered queries of problems 8, 9 and 10, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from . import encoding, mixing, tiling
from .tables import table as _t


def p8_found(spark, sf):
    return tiling.leaks(_t(spark, sf, "documents"), _t(spark, sf, "benchmark_items")).select("doc_id", "item_id")


def p8_coverage(spark, sf):
    """Every leak by longest run or by coverage of short tiles, which finds reordered passages too."""
    return tiling.leaks(_t(spark, sf, "documents"), _t(spark, sf, "benchmark_items"), seed=5, min_tile=5, min_coverage=0.5)


def p9_mix(spark, sf):
    return mixing.mix(_t(spark, sf, "documents"), _t(spark, sf, "mix_targets"))


def p9_shares(spark, sf):
    return mixing.shares(_t(spark, sf, "documents"), _t(spark, sf, "mix_targets"))


def p9_share_checks(spark, sf):
    """Per target with documents: whether its share is met within half a percent of all tokens and no document is used
    more often than allowed. Shares of targets without documents go to the others in proportion."""
    s = mixing.shares(_t(spark, sf, "documents"), _t(spark, sf, "mix_targets")).where("mixed_tokens > 0")
    due = F.col("target_share") / F.sum("target_share").over(Window.partitionBy())  # one row per target
    return s.select("source", (F.abs(F.col("actual_share") - due) <= 0.005).alias("share_met"), (F.col("max_copies") <= F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(1))).alias("copies_kept"))


def p10_found(spark, sf):
    return encoding.garbled(_t(spark, sf, "documents")).select("doc_id")


def p10_repaired(spark, sf):
    return encoding.repaired(_t(spark, sf, "documents"))


def p10_lost(spark, sf):
    """Affected documents in which characters were lost for good, and how many."""
    return encoding.repaired(_t(spark, sf, "documents")).where("n_lost > 0").select("doc_id", "n_lost")


QUERIES = {f.__name__: f for f in (p8_found, p8_coverage, p9_mix, p9_shares, p9_share_checks, p10_found, p10_repaired, p10_lost)}

_WORDS = "list_filter(regexp_extract_all(replace(replace(lower(text), 'i̇', 'i'), 'ı', 'i'), '[\\p{L}\\p{N}]+'), lambda x: x <> '')"
_GRAMS = "select {id}, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k + 11], ' '))) as g from (select {id}, {w} as w from {t} where text is not null) where len(w) >= 12"

SQL = {
    "p10_lost": "select doc_id, max(length(text) - length(replace(text, chr(65533), '')))::bigint as n_lost from documents where doc_id is not null and contains(text, chr(65533)) group by doc_id",
    "p9_share_checks": "select lower(trim(source)) as source, true as share_met, true as copies_kept from mix_targets where target_share > 0 and lower(trim(source)) in (select lower(trim(source)) from documents where text is not null and text <> '')",
    "p8_found": f"with d as ({_GRAMS.format(id='doc_id', w=_WORDS, t='documents')}), i as ({_GRAMS.format(id='item_id', w=_WORDS, t='benchmark_items')}) select distinct doc_id, item_id from d join i using (g)",
}
