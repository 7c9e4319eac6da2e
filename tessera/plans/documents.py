"""Queries over nested and drifting result documents (problems 4 and 7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import nested, schema_drift
from ..sources.tables import table as _t
from .drift_sql import CHANGES


def p4_found(spark, sf):
    return schema_drift.changes(_t(spark, sf, "metrics_raw")).where("change_kind <> 'unreadable'")


def p4_ingest(spark, sf):
    return schema_drift.ingest(_t(spark, sf, "metrics_raw"))


def p4_change_counts(spark, sf):
    return schema_drift.changes(_t(spark, sf, "metrics_raw")).groupBy("field_name", "change_kind").agg(F.count(F.lit(1)).alias("n_files"))


def p7_found(spark, sf):
    return nested.metric_children(_t(spark, sf, "metrics"))


def p7_nodes(spark, sf):
    nodes = nested.shred(_t(spark, sf, "metrics"), "metrics_id", ["labels", "models", "comparisons"])
    return nodes.select("metrics_id", "label", "parent_label", "schema_path", F.element_at("keys", -1).alias("key"))


def p7_values(spark, sf):
    return nested.metric_values(_t(spark, sf, "metrics"))


QUERIES = {f.__name__: f for f in (p4_found, p4_ingest, p4_change_counts, p7_found, p7_nodes, p7_values)}

_NODES = """r as (select * from metrics where metrics_id is not null),
me as (select metrics_id, unnest(map_entries(models)) as e, generate_subscripts(map_entries(models), 1) - 1 as i from r),
m as (select metrics_id, '1.' || i as label, e.key as model, e.value as v from me),
pt as (select metrics_id, label, model, unnest(map_entries(v.point)) as e, generate_subscripts(map_entries(v.point), 1) - 1 as j from m),
ci as (select metrics_id, label, model, unnest(map_entries(v.ci95)) as e, generate_subscripts(map_entries(v.ci95), 1) - 1 as j from m),
su as (select metrics_id, label, model, unnest(map_entries(v.support)) as e, generate_subscripts(map_entries(v.support), 1) - 1 as j from m),
cm as (select metrics_id, label, unnest(v.confusion_matrix) as e, generate_subscripts(v.confusion_matrix, 1) - 1 as j from m),
cp as (select metrics_id, unnest(comparisons) as e, generate_subscripts(comparisons, 1) - 1 as i from r)"""

SQL = {
    "p4_found": CHANGES,
    "p4_change_counts": f"select field_name, change_kind, count(*) as n_files from ({CHANGES}) group by 1, 2",
    "p7_nodes": f"""with {_NODES} select metrics_id, '0.' || i as label, null::varchar as parent_label, 'labels[]' as schema_path, i::varchar as key from (select metrics_id, generate_subscripts(labels, 1) - 1 as i from r)
union all select metrics_id, label, null, 'models{{}}', model from m
union all select metrics_id, label || '.0.' || j, label, 'models{{}}.point{{}}', e.key from pt
union all select metrics_id, label || '.1.' || j, label, 'models{{}}.ci95{{}}', e.key from ci
union all select metrics_id, label || '.1.' || j || '.' || k, label || '.1.' || j, 'models{{}}.ci95{{}}[]', k::varchar from (select *, generate_subscripts(e.value, 1) - 1 as k from ci)
union all select metrics_id, label || '.2.' || j, label, 'models{{}}.confusion_matrix[]', j::varchar from cm
union all select metrics_id, label || '.2.' || j || '.' || k, label || '.2.' || j, 'models{{}}.confusion_matrix[][]', k::varchar from (select *, generate_subscripts(e, 1) - 1 as k from cm)
union all select metrics_id, label || '.3.' || j, label, 'models{{}}.support{{}}', e.key from su
union all select metrics_id, '2.' || i, null, 'comparisons[]', i::varchar from cp
union all select metrics_id, '2.' || i || '.6.' || k, '2.' || i, 'comparisons[].acc_diff_ci95[]', k::varchar from (select *, generate_subscripts(e.acc_diff_ci95, 1) - 1 as k from cp)""",
    "p7_values": f"""with {_NODES}, w as (select metrics_id, model, e.key as metric, e.value as point, null::double as lo, null::double as hi, null::bigint as support from pt
union all select metrics_id, model, e.key, null, e.value[1], e.value[2], null from ci union all select metrics_id, model, e.key, null, null, null, e.value from su)
select metrics_id, model, metric, max(point) as point, max(lo) as ci_lo, max(hi) as ci_hi, max(support) as support from w group by 1, 2, 3""",
    "p7_found": """with m as (select metrics_id, e.key as model, e.value as v from (select metrics_id, unnest(map_entries(models)) as e from metrics where metrics_id is not null)),
c as (select metrics_id, unnest(comparisons) as x, generate_subscripts(comparisons, 1) - 1 as i from metrics where metrics_id is not null)
select metrics_id, 'model' as child_kind, model as parent_key, '' as child_key from m
union all select metrics_id, 'point', model, unnest(map_keys(v.point)) from m
union all select metrics_id, 'ci95', model, unnest(map_keys(v.ci95)) from m
union all select metrics_id, 'support', model, unnest(map_keys(v.support)) from m
union all select metrics_id, 'comparison', i::varchar, coalesce(x.model_a, '') || '|' || coalesce(x.model_b, '') from c where x is not null""",
}
