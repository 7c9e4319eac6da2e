"""The registry of claims: what the artefacts say, rendered and looked up in the documents."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import claims as cl
from ..session import Staging
from ..sources import views as v
from ..sources.tables import table as t
from . import evaluation, groups, provenance, reports, selection
from .base_sql import RUNS
from .registry_tools import registry

QUERIES, SQL, query = registry()
_RESULTS = {name: fn for m in (evaluation, groups, provenance, reports, selection) for name, fn in m.QUERIES.items()}
_TEXTS = {name: text for m in (evaluation, groups, provenance, reports, selection) for name, text in m.SQL.items()}


@dataclass(frozen=True)
class Family:
    """Claims made of the rows of a query: one per row, named by ``name`` and the row's ``keys``."""

    name: str
    result: str
    value: str  # an expression both engines read
    form: str
    keys: tuple[str, ...] = ()
    where: str = "true"
    must_appear: bool = True
    zero_ok: bool = False


#: One line per family; a value that only pins an artefact need not appear in the text.
FAMILIES = (
    Family("ds.total", "curated_totals", "images", "thousands"),
    Family("ds.groups_total", "curated_totals", "n_groups", "thousands"),
    Family("ds.patients", "curated_totals", "patients", "thousands"),
    Family("ds.mask_count", "curated_totals", "masks", "thousands"),
    Family("ds.mask_pct", "curated_totals", "100 * masks / images", "pct"),
    Family("ds.slices_per_patient", "curated_totals", "with_patient / patients", "f1"),
    Family("ds.pid_before", "curated_totals", "100 * with_patient / images", "pct"),
    Family("ds.pid_after", "propagated_share", "pct", "pct"),
    Family("ds.cross_source_clusters", "cluster_sources", "n_cross", "int"),
    Family("ds.retained", "dedup_effect", "after", "thousands", ("label",)),
    Family("ds.curated", "dedup_effect", "before", "thousands", ("label",)),
    Family("ds.dedup_pct", "dedup_effect", "removed_pct", "pct", ("label",), zero_ok=True),
    Family("ds.per_group", "group_ratios", "per_group", "f2", ("label",)),
    Family("ds.groups", "group_ratios", "n_groups", "int", ("label",)),
    Family("ds.source_class", "source_class_counts", "n", "int", ("source", "label")),
    Family("ds.raw", "source_redundancy", "n", "thousands", ("source",), "source is not null"),
    Family("excl.redundant_pct", "source_redundancy", "100 * redundant_share", "pct", ("source",), "source is not null", zero_ok=True),
    Family("ds.dims", "source_dims", "n_dims", "int", ("source",)),
    Family("excl.rows", "exclusion_rationale", "n", "int", ("reason",)),
    Family("split.sibling_pct", "sibling_contamination", "sibling_pct", "pct", ("fold",), zero_ok=True),
    Family("split.groups_spanning", "split_checks", "n", "int", ("check_name",), zero_ok=True),
    Family("perf", "json_flatten", "value", "f4", ("run_id", "model", "metric")),
    Family("perf.ci_lo", "json_flatten", "lo", "f4", ("run_id", "model", "metric"), "lo is not null", must_appear=False),
    Family("perf.ci_hi", "json_flatten", "hi", "f4", ("run_id", "model", "metric"), "hi is not null", must_appear=False),
    Family("infl", "leakage_pivot", "inflation_pp", "pp", ("base", "model")),
    Family("infl.foldstd", "per_fold_spread", "std", "f4", ("model", "metric")),
    Family("cmp.diff_pp", "comparison_signs", "abs(100 * acc_diff)", "f2", ("run_id", "model_a", "model_b")),
    Family("cmp.ci_lo_pp", "comparison_signs", "abs(100 * lo)", "f2", ("run_id", "model_a", "model_b"), "lo is not null", must_appear=False),
    Family("cmp.ci_hi_pp", "comparison_signs", "abs(100 * hi)", "f2", ("run_id", "model_a", "model_b"), "hi is not null", must_appear=False),
    Family("cls.recall", "run_class_metrics", "recall", "f3", ("run_id", "model", "label")),
    Family("cls.f1", "run_class_metrics", "f1", "f3", ("run_id", "model", "label"), must_appear=False),
    Family("probe.recall", "per_class_metrics", "recall", "f3", ("label",)),
    Family("ext.files", "scopes_overlap_report", "n_items", "thousands", ("scope",)),
    Family("ext.matched", "scopes_overlap_report", "n_matched", "int", ("scope",), zero_ok=True),
    Family("ext.matched_pct", "scopes_overlap_report", "100 * image_rate", "pct", ("scope",), zero_ok=True),
    Family("ext.bytes", "scopes_overlap_report", "byte_identical", "int", ("scope",), zero_ok=True),
    Family("ext.retained", "group_flags", "retained", "int", ("label",), "label is not null"),
    Family("ext.strata", "strata", "n", "int", ("stratum",)),
    Family("ext.strata_pct", "strata", "pct", "pct", ("stratum",)),
    Family("ext.agreement", "published_leak", "100 * agreement", "pct", ("label",)),
    Family("pub.spanning", "publisher_split_integrity", "spanning_groups", "int"),
    Family("pub.spanning_images", "publisher_split_integrity", "images_involved", "int"),
    Family("cal.ece", "ece", "ece", "f4"),
    Family("aurc", "risk_coverage", "aurc", "f4"),
    Family("defer.units_kept", "deferral_curve", "units_kept", "thousands", ("defer_frac",)),
    Family("defer.accuracy", "deferral_curve", "unit_accuracy", "f4", ("defer_frac",)),
    Family("paired.n", "paired_contrast_summary", "n_items", "int"),
    Family("paired.diff", "paired_contrast_summary", "diff_pp", "pp", must_appear=False),
    Family("lost.category", "lost_category", "n", "int"),
)
#: The two scopes of documents: letters are those of one source, everything else is the manuscript. A letter quotes a
#: part of the manuscript's numbers by design.
SCOPES = ("manuscript", "letter")
LETTERS = "review_letter"


def registry_claims(spark, sf):
    """(claim_id, value, form, must_appear, zero_ok) of every family; each result is computed once."""
    staging, held, parts = Staging(spark, "claims"), {}, []
    for f in FAMILIES:
        if f.result not in held:
            held[f.result] = staging.keep(_RESULTS[f.result](spark, sf))
        keys = [F.coalesce(F.col(k).cast("string"), F.lit("none")) for k in f.keys]
        rows = held[f.result].where(f.where)
        parts.append(rows.select(F.concat_ws(".", F.lit(f.name), *keys).alias("claim_id"), F.expr(f"cast({f.value} as double)").alias("value"), F.lit(f.form).alias("form"), F.lit(f.must_appear).alias("must_appear"), F.lit(f.zero_ok).alias("zero_ok")))
    return reduce(lambda a, b: a.unionByName(b), parts)


def _family_sql(f: Family) -> str:
    keys = "".join(f" || '.' || coalesce({k}::varchar, 'none')" for k in f.keys)
    return f"select '{f.name}'{keys} as claim_id, ({f.value})::double as value, '{f.form}' as form, {f.must_appear} as must_appear, {f.zero_ok} as zero_ok from r_{f.result} where {f.where}"


_DIGITS = {"f4": "printf('%.4f', round(value, 4))", "f3": "printf('%.3f', round(value, 3))", "f2": "printf('%.2f', round(value, 2))", "f1": "printf('%.1f', round(value, 1))", "thousands": "format('{:,}', round(value)::bigint)", "int": "round(value)::bigint::varchar", "pp": "printf('%+.2f', round(value, 2))", "pct": "printf('%.1f', round(value, 1))"}
_RENDER = "case form " + " ".join(f"when '{k}' then {x}" for k, x in _DIGITS.items()) + " end"
_CLAIMS = "with recursive " + ", ".join(f"r_{name} as ({_TEXTS[name]})" for name in dict.fromkeys(f.result for f in FAMILIES)) + ", cl as (" + " union all ".join(map(_family_sql, FAMILIES)) + f"), cr as (select *, {_RENDER} as rendered from cl)"
_PLAIN = "trim(regexp_replace(translate(text, '−–—‑   ', '----   '), '\\s+', ' ', 'g'))"
_RUNS_OF = "regexp_extract_all(' ' || {x}, '[^0-9.,]([+-]?[0-9][0-9.,]*)', 1)"


def _tokens_sql(rows: str, key: str) -> str:
    """(key, token) of texts: every reading of every number."""
    return f"""nr as (select {key}, unnest({_RUNS_OF.format(x=_PLAIN)}) as run from {rows}),
nb as (select {key}, run, regexp_replace(run, '^[+-]', '') as body from nr), np as (select *, generate_series(1, length(body)) as ends from nb),
ne as (select {key}, run, body, unnest(ends) as i from np), nt as (select {key}, run, body[1:i] as token from ne where regexp_matches(body[i:i], '[0-9]') and (i = length(body) or not regexp_matches(body[i + 1:i + 1], '[0-9]'))),
tk as (select distinct {key}, token from nt union select {key}, run[1:1] || token from nt where regexp_matches(run, '^[+-]'))"""


_DOCS = f"docs as (select case when source = '{LETTERS}' then 'letter' else 'manuscript' end as scope, text from documents where text is not null)"


def documents_by_scope(spark, sf):
    scope = F.when(F.col("source") == LETTERS, "letter").otherwise("manuscript")
    return t(spark, sf, "documents").where("text is not null").select(scope.alias("scope"), "text")


@query(_CLAIMS + f""", {_DOCS}, {_tokens_sql("docs", "scope")},
vr as (select claim_id, unnest(list_distinct([rendered, regexp_replace(rendered, '^\\+', '')])) as token from cr), fd as (select claim_id, bool_or(scope = 'manuscript') as m, bool_or(scope = 'letter') as l from vr join tk using (token) group by 1)
select cr.claim_id, rendered, case when value is null or isnan(value) then 'SKIP' when value = 0 and not zero_ok then 'SKIP' when rendered is null then 'ERROR' when length(trim(rendered, '+-')) < 2 then 'SKIP' when not must_appear then 'note'
 when coalesce(m, false) and coalesce(l, false) then 'ok' when coalesce(m, false) then 'ok*' else 'FAIL' end as verdict from cr left join fd using (claim_id)""")
def claims_check(spark, sf):
    """The verdict on every claim of the registry."""
    staging = Staging(spark, "verdicts")
    tokens = staging.keep(cl.quoted(documents_by_scope(spark, sf)))
    return cl.verdicts(staging.keep(registry_claims(spark, sf)), tokens, list(SCOPES), ["letter"])


_NUMBERS = """list_filter(list_transform(regexp_split_to_array({x}, '[^\\p{{L}}\\p{{N}}_.,]+'), lambda w: regexp_replace(w, '^[.,]+|[.,]+$', '', 'g')), lambda w: regexp_matches(w, '^[0-9][0-9,]*(\\.[0-9]+)?$'))"""


@query(_CLAIMS + f""", {_DOCS}, vr as (select distinct unnest(list_distinct([rendered, regexp_replace(rendered, '^\\+', '')])) as number from cr),
nu as (select unnest({_NUMBERS.format(x=_PLAIN)}) as number from docs where scope = 'manuscript') select number, count(*) as n from nu where (number like '%.%' or number like '%,%' or length(number) >= 3) and number not in (select number from vr where number is not null) group by 1 order by n desc, number limit 60""")
def claims_coverage(spark, sf):
    """The sixty most frequent numbers of the manuscript that no claim covers."""
    docs = documents_by_scope(spark, sf).where("scope = 'manuscript'")
    return cl.uncovered(docs, Staging(spark, "coverage").keep(registry_claims(spark, sf))).orderBy(F.desc("n"), "number").limit(60)


@query(f"with nu as (select unnest({_NUMBERS.format(x=_PLAIN)}) as number from documents where text is not null) select number, count(*) as n from nu group by number")
def text_numbers(spark, sf):
    """Every standing number of all texts and how often it occurs."""
    d = t(spark, sf, "documents").where("text is not null")
    return d.select(F.explode(tx.numbers(tx.normalise(F.col("text")))).alias("number")).groupBy("number").agg(F.count(F.lit(1)).alias("n"))


@query(f"with docs as (select doc_id, text from documents where text is not null and doc_id is not null), {_tokens_sql('docs', 'doc_id')} select token, count(distinct doc_id) as n_docs from tk group by token")
def number_readings(spark, sf):
    """Every reading of every number and the documents it can be found in."""
    d = t(spark, sf, "documents").where("text is not null and doc_id is not null")
    return d.select("doc_id", F.explode(tx.number_tokens(tx.normalise(F.col("text")))).alias("token")).groupBy("token").agg(F.countDistinct("doc_id").alias("n_docs"))


@query(f"with {RUNS}, e as (select run_id, unnest(map_entries(models)) as e from m), v as (select run_id, e.key as model, unnest(map_entries(e.value.point)) as p from e where e.value is not null), cl as (select run_id, model, p.key as metric, p.value as value from v where p.value is not null) select run_id, model, metric, form, {_RENDER.replace('round(value', 'round(value * 100')} as text from cl, (values ('f4'), ('f3'), ('f2'), ('f1'), ('thousands'), ('int'), ('pp'), ('pct')) f(form)")
def number_forms(spark, sf):
    """Every metric, in percent, in every form numbers are rendered in."""
    p = evaluation._points(spark, sf).where("value is not null").select("run_id", "model", "metric", (F.col("value") * 100).alias("x"), F.explode(F.array(*map(F.lit, tx.FORMS))).alias("form"))
    return p.select("run_id", "model", "metric", "form", tx.rendered_as(F.col("x"), F.col("form")).alias("text"))


@query(f"with {RUNS} select split_mode, count(*) as n_runs, sum(n_images)::bigint as n_images, printf('%.2f', round(avg(n_groups), 2)) as mean_groups from m group by split_mode")
def runs_by_mode(spark, sf):
    return v.runs(spark, sf).groupBy("split_mode").agg(F.count(F.lit(1)).alias("n_runs"), F.sum("n_images").alias("n_images"), tx.rendered(F.avg("n_groups"), "f2").alias("mean_groups"))
