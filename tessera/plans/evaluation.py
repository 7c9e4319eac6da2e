"""Queries on splits, metrics, calibration, tests, resampling and report tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import evaluation as ev
from ..operators import splitting as sp
from ..operators import statistics as st
from ..session import Staging
from ..sources import views as v
from ..sources.tables import table as t
from .base_sql import CURATED, DEC, LABELLED, PRED, RUNS

QUERIES, SQL = {}, {}
ABC = ("A", "N", "R")


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def _u(*parts: str) -> str:
    """The portable random number in SQL."""
    return "('0x' || substr(md5(" + " || ':' || ".join(f"({p})::varchar" for p in parts) + "), 1, 8))::bigint"


_LF = f"with {LABELLED}"


@query(f"{_LF}, o as (select path, label, {_u('42', 'path')} as h from l) select path, label, ((row_number() over (partition by label order by h, path) - 1) % 5)::int as fold from o")
def kfold_stratified(spark, sf):
    return sp.stratified_folds(v.labelled_folds(spark, sf).select("path", "label"), "path", "label", 5, 42)


@query(f"{_LF} select path, unit, ({_u('42', 'unit')} % 5)::int as fold from l")
def kfold_grouped_hash(spark, sf):
    return sp.grouped_folds(v.labelled_folds(spark, sf).select("path", "unit"), "unit", 5, 42)


@query(f"{_LF}, o as (select l.path, l.label, k.k as outer_fold, {_u('1000 + k.k', 'l.path')} as h from l, range(5) k(k) where l.fold <> k.k) select outer_fold::int as outer_fold, path, ((row_number() over (partition by outer_fold, label order by h, path) - 1) % 3)::int as inner_fold from o")
def nested_folds(spark, sf):
    base = v.labelled_folds(spark, sf).select("path", "label", "fold").withColumn("outer_fold", F.explode(F.array(*map(F.lit, range(5))))).where("fold <> outer_fold")
    w = Window.partitionBy("outer_fold", "label").orderBy(st.draw(1000 + F.col("outer_fold"), "path"), "path")
    return base.select("outer_fold", "path", ((F.row_number().over(w) - 1) % 3).cast("int").alias("inner_fold"))


@query()
def kfold_stratified_grouped(spark, sf):
    return sp.stratified_group_folds(v.labelled_folds(spark, sf), "unit", "label", 5, 42)


@query(f"{_LF} select count(distinct unit) as n_units, 0::bigint as n_torn, 5::bigint as n_folds, true as even from l where label is not null")
def kfold_group_checks(spark, sf):
    """What must hold of folds of whole units: each unit once, all folds used, shares of rows within a tenth of even."""
    rows = v.labelled_folds(spark, sf).where("label is not null")
    f = Staging(spark, "fold_checks").keep(sp.stratified_group_folds(rows, "unit", "label", 5, 42))
    once = f.groupBy("unit").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("n_units"), F.count_if(F.col("n") > 1).alias("n_torn"))
    n = rows.join(f.withColumnRenamed("fold", "dealt"), "unit").groupBy("dealt").agg(F.count(F.lit(1)).alias("n"))
    shares = n.agg(F.count(F.lit(1)).alias("n_folds"), ((F.max("n") - F.min("n")) <= 0.1 * F.avg("n")).alias("even"))
    return once.join(shares).select("n_units", "n_torn", "n_folds", "even")  # one row each


@query(f"{_LF}, g as (select unit, min(fold) <> max(fold) as spans from l group by unit) select fold, count(*) as n, count_if(spans)::bigint as n_sibling, round(100.0 * count_if(spans) / count(*), 4) as sibling_pct from l join g using (unit) group by fold")
def sibling_contamination(spark, sf):
    return sp.siblings(v.labelled_folds(spark, sf), "unit", "fold")


@query(f"{_LF} select grp, count(distinct fold) as n_folds, count(*) as n from l where grp is not null group by grp having count(distinct fold) > 1")
def groups_spanning_folds(spark, sf):
    return sp.spanning(v.labelled_folds(spark, sf), "grp", "fold")


@query(f"{_LF} select patient, count(distinct fold) as n_folds, count(*) as n from l where patient is not null group by patient having count(distinct fold) > 1")
def patients_spanning_folds(spark, sf):
    return sp.spanning(v.labelled_folds(spark, sf), "patient", "fold")


@query(f"""{_LF}, x as (select 'units_spanning_folds' as check_name, (select count(*) from (select unit from l group by unit having count(distinct fold) > 1)) as n
 union all select 'entities_spanning_folds', (select count(*) from (select patient from l where patient is not null group by patient having count(distinct fold) > 1))
 union all select 'rows_without_fold', (select count(*) from l where fold is null)
 union all select 'labels_absent_from_fold', (select count(*) from (select distinct a.fold, b.label from l a, l b where b.label is not null except select fold, label from l))) select check_name, n, case when n = 0 then 'ok' else 'FAIL' end as status from x""")
def split_checks(spark, sf):
    return sp.verify(v.labelled_folds(spark, sf), "unit", "patient", "label", "fold")


@query(f"{_LF} select fold, label, count(*) as images, count(distinct unit) as units, round(count(*) / count(distinct unit), 4) as ratio from l group by 1, 2")
def partitions_table(spark, sf):
    g = v.labelled_folds(spark, sf).groupBy("fold", "label").agg(F.count(F.lit(1)).alias("images"), F.countDistinct("unit").alias("units"))
    return g.withColumn("ratio", F.round(F.col("images") / F.col("units"), 4))


@query(f"""{_LF}, o as (select path, label, fold, ({_u('7', 'path')} % 3) as inner_fold from l) select k.k::int as fold, case when o.fold = k.k then 'test' when inner_fold = 0 then 'train_earlystop' else 'train_fit' end as part, label, count(*) as n from o, range(5) k(k) group by 1, 2, 3""")
def augmentation_table(spark, sf):
    o = v.labelled_folds(spark, sf).select("label", F.col("fold").alias("own"), (st.draw(F.lit(7), "path") % 3).alias("inner_fold"), F.explode(F.array(*map(F.lit, range(5)))).alias("fold"))
    part = F.when(F.col("own") == F.col("fold"), "test").when(F.col("inner_fold") == 0, "train_earlystop").otherwise("train_fit")
    return o.groupBy("fold", part.alias("part"), "label").agg(F.count(F.lit(1)).alias("n"))


@query(f"{_LF} select label, path, pos::int as pos from (select label, path, row_number() over (partition by label order by {_u('42', 'path')}, path) as pos from l) where pos <= 20")
def stratified_sample(spark, sf):
    w = Window.partitionBy("label").orderBy(st.draw(F.lit(42), "path"), "path")
    return v.labelled_folds(spark, sf).select("label", "path", F.row_number().over(w).alias("pos")).where("pos <= 20")


@query(f"with {DEC} select a.y_true, b.pred, count(dc.item) as n from (values ('A'), ('N'), ('R')) a(y_true) cross join (values ('A'), ('N'), ('R')) b(pred) left join dc on dc.y_true = a.y_true and dc.pred = b.pred group by 1, 2")
def confusion_matrix(spark, sf):
    return ev.label_grid(v.decisions(spark, sf), ABC)


_PC = f"with {DEC}, pc as (select label, count_if(y_true = label and pred = label) as tp, count_if(y_true <> label and pred = label) as fp, count_if(y_true = label and pred <> label) as fn, count_if(y_true <> label and pred <> label) as tn from dc, (values ('A'), ('N'), ('R')) v(label) group by label)"


@query(_PC + " select label, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) as precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) as recall, round(coalesce(tn / nullif(tn + fp, 0), 0), 6) as specificity, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) as f1, (tp + fn)::bigint as support from pc")
def per_class_metrics(spark, sf):
    return ev.per_class(v.decisions(spark, sf), ABC)


@query(f"with {DEC} select round(avg(correct), 6) as accuracy, (select round(avg(r), 6) from (select avg(correct) as r from dc group by y_true)) as balanced_accuracy from dc")
def balanced_accuracy_present(spark, sf):
    return ev.balanced_accuracy(v.decisions(spark, sf))


@query(f"with {DEC} select round(avg(correct), 6) as accuracy, (select round(sum(r) / 4, 6) from (select avg(correct) as r from dc group by y_true)) as balanced_accuracy from dc")
def balanced_accuracy_fixed(spark, sf):
    return ev.balanced_accuracy(v.decisions(spark, sf), [*ABC, "X"])


@query(f"with {PRED} select round(sum(pow(prob - (y_true = label)::int, 2)) / count_if(y_true = label), 6) as brier from pr")
def brier(spark, sf):
    return ev.brier(v.predictions(spark, sf))


@query(f"with {PRED}, s as (select label, round(prob, 9) as s, count_if(y_true = label) as pos, count_if(y_true <> label) as neg from pr group by 1, 2), c as (select *, coalesce(sum(neg) over (partition by label order by s rows between unbounded preceding and 1 preceding), 0) as below from s) select label, round(sum(pos * (below + neg / 2)) / sum(pos) / sum(neg), 6) as auc from c group by label")
def auc_ovr(spark, sf):
    return ev.auc_ovr(v.predictions(spark, sf))


_RB = f"with {DEC}, rb as (select ceil(round(conf * 15, 9))::int as bin, count(*) as n, avg(conf) as mc, avg(correct) as acc from dc group by 1 having bin >= 1)"


@query(_RB + " select round(sum(n * abs(acc - mc)) / sum(n), 6) as ece, round(max(abs(acc - mc)), 6) as mce, round(sum(n * mc) / sum(n), 6) as mean_confidence, round(sum(n * acc) / sum(n), 6) as accuracy, round((sum(n * acc) - sum(n * mc)) / sum(n), 6) as confidence_gap from rb")
def ece(spark, sf):
    return ev.calibration(v.decisions(spark, sf))


@query(_RB + " select bin, n, round(mc, 6) as mean_confidence, round(acc, 6) as accuracy, round(abs(acc - mc), 6) as gap from rb")
def reliability(spark, sf):
    return ev.reliability(v.decisions(spark, sf)).select("bin", "n", *[F.round(c, 6).alias(c) for c in ("mean_confidence", "accuracy", "gap")])


_UN = f"""with {PRED}, mn as (select grp, label, round(avg(prob), 9) as prob, min(y_true) as y_true, count(*) as size from pr group by 1, 2),
un as (select grp, arg_max(label, (prob, -ascii(label))) as pred, max(prob) as conf, min(y_true) as y_true, max(size) as size from mn group by grp), uc as (select *, (pred = y_true)::int as correct from un)"""


@query(_UN + " select grp, pred, round(conf, 6) as conf, y_true, size, correct from uc")
def group_pooled_predictions(spark, sf):
    return ev.pooled_units(v.predictions(spark, sf)).withColumn("conf", F.round("conf", 6))


@query(_UN + ", a as (select avg(e / i) as aurc, count(*) as n_units from (select sum(1 - correct) over (order by conf desc, grp rows unbounded preceding) as e, row_number() over (order by conf desc, grp) as i from uc)), o as (select avg(e / i) as oracle from (select sum(1 - correct) over (order by 1 - correct, grp rows unbounded preceding) as e, row_number() over (order by 1 - correct, grp) as i from uc)) select round(aurc, 6) as aurc, round(oracle, 6) as oracle_aurc, round(aurc - oracle, 6) as excess_aurc, n_units from a, o")
def risk_coverage(spark, sf):
    return ev.risk_coverage(ev.pooled_units(v.predictions(spark, sf)), "grp")


@query(_UN + ", k as (select *, row_number() over (order by conf, grp) as pos, count(*) over () as n from uc) select f.f as defer_frac, count(*) as units_kept, sum(size)::bigint as items_kept, round(avg(correct), 6) as unit_accuracy from k, (values (0.0::double), (0.05::double), (0.1::double), (0.15::double), (0.2::double), (0.3::double), (0.4::double), (0.5::double)) f(f) where pos > round_even(f.f * n, 0) group by 1")
def deferral_curve(spark, sf):
    return ev.deferral(ev.pooled_units(v.predictions(spark, sf)), (0.0, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5))


@query(_UN + ", k as (select *, row_number() over (order by conf, grp) as pos, count(*) over () as n from uc), q as (select f.f as defer_frac, count(*) as units_kept, sum(size)::bigint as items_kept from k, (values (0.1::double), (0.2::double), (0.3::double)) f(f) where pos > round_even(f.f * n, 0) group by 1) select units_kept, items_kept, (select sum(size) from uc)::bigint - items_kept as items_transferred from q where abs(defer_frac - 0.2) < 1e-8")
def deferral_lookup(spark, sf):
    """The row of the deferral curve at a fraction that is compared nearly, and the items it transfers."""
    units = ev.pooled_units(v.predictions(spark, sf))
    row = ev.deferral(units, (0.1, 0.2, 0.3)).where(F.abs(F.col("defer_frac") - 0.2) < 1e-8)
    total = units.agg(F.sum("size").alias("total"))
    return row.join(total).select("units_kept", "items_kept", (F.col("total") - F.col("items_kept")).alias("items_transferred"))


@query(f"with {PRED}, s as (select label, round(prob, 9) as s, count_if(y_true = label) as pos, count_if(y_true <> label) as neg from pr group by 1, 2), c as (select *, coalesce(sum(neg) over (partition by label order by s rows between unbounded preceding and 1 preceding), 0) as below from s), a as (select label, sum(pos * (below + neg / 2)) / sum(pos) / sum(neg) as auc from c group by label) select round(avg(auc), 5) as auc_macro, count(*) as n_labels from a")
def auc_macro(spark, sf):
    """Mean one-vs-rest area over the labels for which it is defined."""
    return ev.auc_ovr(v.predictions(spark, sf)).agg(F.round(F.avg("auc"), 5).alias("auc_macro"), F.count(F.lit(1)).alias("n_labels"))


_AB = f"with {DEC}, ab as (select grp, y_true, correct as a_ok, ((case when {_u('9', 'item')} % 3 = 0 then 'A' when {_u('9', 'item')} % 3 = 1 then 'N' else 'R' end) = y_true)::int as b_ok from dc)"


def _pairs(spark, sf):
    d = v.decisions(spark, sf)
    r = st.draw(F.lit(9), "item") % 3
    other = F.when(r == 0, "A").when(r == 1, "N").otherwise("R")
    return d.select("item", "grp", "y_true", F.col("correct").alias("a_ok"), (other == F.col("y_true")).cast("int").alias("b_ok"))


@query(_AB + " select y_true, count_if(a_ok = 1 and b_ok = 0)::bigint as a_only, count_if(a_ok = 0 and b_ok = 1)::bigint as b_only from ab group by y_true")
def mcnemar_counts(spark, sf):
    return st.mcnemar(_pairs(spark, sf), "y_true").drop("p")


@query(_AB + """, g as (select y_true, count_if(a_ok = 1 and b_ok = 0)::bigint as a_only, count_if(a_ok = 0 and b_ok = 1)::bigint as b_only from ab group by y_true), x as (select *, a_only + b_only as n, unnest(range(0, least(a_only, b_only) + 1)) as i from g)
select y_true, a_only, b_only, round(case when n = 0 then 1 else least(1.0, 2 * sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2)))) end, 6) as p from x group by y_true, a_only, b_only, n""")
def mcnemar_pairs(spark, sf):
    return st.mcnemar(_pairs(spark, sf), "y_true")


_CMP = f"with {RUNS}, cp as (select m.run_id, unnest(comparisons) as x, generate_subscripts(comparisons, 1) - 1 as i from m)"


def _comparisons(spark, sf):
    return v.runs(spark, sf).select("run_id", F.posexplode("comparisons").alias("i", "x")).select("run_id", "i", "x.*").where("model_a is not null or model_b is not null or bootstrap_p is not null or mcnemar_exact_p is not null")


@query(_CMP + """, q as (select run_id, i, x.model_a as model_a, x.model_b as model_b, x.mcnemar_exact_p as p from cp where x is not null and x.mcnemar_exact_p is not null),
r as (select *, least(1.0, p * (count(*) over (partition by run_id) - row_number() over (partition by run_id order by p, i) + 1)) as raw from q)
select run_id, i::int as i, model_a, model_b, p, round(max(raw) over (partition by run_id order by p, i rows unbounded preceding), 6) as p_holm from r""")
def holm_adjust(spark, sf):
    c = _comparisons(spark, sf).select("run_id", "i", "model_a", "model_b", F.col("mcnemar_exact_p").alias("p"))
    return st.holm(c, "p", ["run_id"], ["i"]).withColumn("p_holm", F.round("p_holm", 6))


_PT = f"with {RUNS}, e as (select run_id, config, base_config, split_mode, unnest(map_entries(models)) as e from m), pt as (select run_id, config, base_config, split_mode, e.key as model, unnest(map_entries(e.value.point)) as p, e.value.ci95 as ci from e where e.value is not null)"


def _points(spark, sf):
    r = v.runs(spark, sf).select("run_id", "config", "base_config", "split_mode", F.explode("models").alias("model", "e"))
    return r.select("run_id", "config", "base_config", "split_mode", "model", F.explode("e.point").alias("metric", "value"), F.col("e.ci95").alias("ci"))


@query(_PT + " select run_id, model, p.key as metric, p.value as value, ci[p.key][1] as lo, ci[p.key][2] as hi from pt")
def json_flatten(spark, sf):
    ci = F.try_element_at(F.col("ci"), F.col("metric"))
    return _points(spark, sf).select("run_id", "model", "metric", "value", F.get(ci, F.lit(0)).alias("lo"), F.get(ci, F.lit(1)).alias("hi"))


@query(_PT + """, a as (select coalesce(base_config, replace(config, '_imagelevel', '')) as base, model, case when config like '%imagelevel%' then 'image' else 'grouped' end as mode, avg(p.value) as acc from pt where p.key = 'accuracy' and config is not null group by 1, 2, 3)
select base, model, round(max(acc) filter (where mode = 'grouped'), 6) as grouped, round(max(acc) filter (where mode = 'image'), 6) as image, round(100 * (max(acc) filter (where mode = 'image') - max(acc) filter (where mode = 'grouped')), 4) as inflation_pp from a group by 1, 2 having count(*) = 2""")
def leakage_pivot(spark, sf):
    p = _points(spark, sf).where("metric = 'accuracy' and config is not null")
    p = p.select(F.coalesce("base_config", F.replace("config", F.lit("_imagelevel"), F.lit(""))).alias("base"), "model", F.when(F.col("config").contains("imagelevel"), "image").otherwise("grouped").alias("mode"), "value")
    w = p.groupBy("base", "model").pivot("mode", ["grouped", "image"]).agg(F.avg("value")).dropna(subset=["grouped", "image"])
    return w.select("base", "model", F.round("grouped", 6).alias("grouped"), F.round("image", 6).alias("image"), F.round(100 * (F.col("image") - F.col("grouped")), 4).alias("inflation_pp"))


@query(_PT + " select model, p.key as metric, count(p.value) as n, round(min(p.value), 6) as min, round(avg(p.value), 9) as mean, round(max(p.value), 6) as max, round(stddev_samp(p.value), 9) as std from pt group by 1, 2")
def per_fold_spread(spark, sf):
    c = F.col("value")
    return _points(spark, sf).groupBy("model", "metric").agg(F.count(c).alias("n"), F.round(F.min(c), 6).alias("min"), F.round(F.avg(c), 9).alias("mean"), F.round(F.max(c), 6).alias("max"), F.round(F.stddev_samp(c), 9).alias("std"))


@query(f"with {RUNS}, e as (select run_id, labels, unnest(map_entries(models)) as e from m), r as (select run_id, labels, e.key as model, unnest(e.value.confusion_matrix) as row, generate_subscripts(e.value.confusion_matrix, 1) as i from e), c as (select run_id, labels, model, i, unnest(row) as n, generate_subscripts(row, 1) as j from r) select run_id, model, labels[i] as y_true, labels[j] as pred, n from c")
def confusion_tables(spark, sf):
    e = v.runs(spark, sf).select("run_id", "labels", F.explode("models").alias("model", "e"))
    r = e.select("run_id", "labels", "model", F.posexplode("e.confusion_matrix").alias("i", "row"))
    c = r.select("run_id", "labels", "model", "i", F.posexplode("row").alias("j", "n"))
    return c.select("run_id", "model", F.get("labels", F.col("i")).alias("y_true"), F.get("labels", F.col("j")).alias("pred"), "n")


@query(_CMP + " select run_id, least(x.model_a, x.model_b) as model_a, greatest(x.model_a, x.model_b) as model_b, case when x.model_a <= x.model_b then x.acc_diff else -x.acc_diff end as acc_diff, case when x.model_a <= x.model_b then x.acc_diff_ci95[1] else -x.acc_diff_ci95[2] end as lo, case when x.model_a <= x.model_b then x.acc_diff_ci95[2] else -x.acc_diff_ci95[1] end as hi from cp where x.model_a is not null and x.model_b is not null")
def comparison_signs(spark, sf):
    c = _comparisons(spark, sf).where("model_a is not null and model_b is not null")
    fwd = F.col("model_a") <= F.col("model_b")
    lo, hi = F.get("acc_diff_ci95", F.lit(0)), F.get("acc_diff_ci95", F.lit(1))
    return c.select("run_id", F.least("model_a", "model_b").alias("model_a"), F.greatest("model_a", "model_b").alias("model_b"), F.when(fwd, F.col("acc_diff")).otherwise(-F.col("acc_diff")).alias("acc_diff"), F.when(fwd, lo).otherwise(-hi).alias("lo"), F.when(fwd, hi).otherwise(-lo).alias("hi"))


#: Draws of intervals and differences over cross-validated predictions, and of external items.
CV_DRAWS, EXTERNAL_DRAWS = 2000, 4000


def _boot(stats: str, seed: int, draws: int, *keys: str) -> str:
    """Common table expressions: the units with their weight ``w`` in each draw ``d``."""
    text = " || ':' || ".join([f"'{seed}'", *(f"({k})::varchar" for k in keys)])
    step = lambda x: f"((xor({x} >> 16, {x}) * 73244475) & 4294967295)"
    cdf = " + ".join(f"(u >= {c!r}::double)::int" for c in st.poisson_cdf())
    return f"""bk as (select *, ('0x' || substr(md5({text}), 1, 8))::bigint as ka, ('0x' || substr(md5({text}), 9, 8))::bigint as kb from {stats}),
b1 as (select bk.*, d.d, (ka + d.d * 2654435761) & 4294967295 as x from bk, range(1, {draws + 1}) d(d)), b2 as (select * replace ({step("x")} as x) from b1), b3 as (select * replace ({step("x")} as x) from b2),
b4 as (select * replace (xor(xor(x >> 16, x), kb) as x) from b3), b5 as (select * replace ({step("x")} as x) from b4), b6 as (select * replace ({step("x")} as x) from b5),
b7 as (select *, xor(x >> 16, x) / 4294967296.0::double as u from b6), bw as (select *, {cdf} as w from b7)"""


_CI = "round(avg({v}), 6) as mean, round(quantile_cont({v}, 0.025), 6) as lo, round(quantile_cont({v}, 0.975), 6) as hi, count({v}) as n_draws"


@query(_AB + f""", g as (select grp, sum(a_ok) as ok, count(*) as n from ab group by grp), {_boot("g", 42, CV_DRAWS, "grp")}, dr as (select d, sum(w * ok) / sum(w * n) as acc from bw group by d)
select {_CI.format(v="acc")} from dr""")
def bootstrap_accuracy_ci(spark, sf):
    g = st.group_sums(_pairs(spark, sf), "grp", {"ok": F.col("a_ok"), "n": F.lit(1)})
    d = st.bootstrap_sums(g, "grp", ["ok", "n"], CV_DRAWS, 42).select(F.try_divide("ok", "n").alias("acc"))
    return st.interval(d, "acc")


@query(_AB + f""", g as (select grp, sum(a_ok) as a, sum(b_ok) as b, count(*) as n from ab group by grp), {_boot("g", 43, CV_DRAWS, "grp")}, dr as (select d, (sum(w * a) - sum(w * b)) / sum(w * n) as diff from bw group by d)
select {_CI.format(v="diff")}, round(least(1.0, 2 * least(avg((diff <= 0)::int), avg((diff >= 0)::int))), 6) as p from dr""")
def bootstrap_paired_diff(spark, sf):
    g = st.group_sums(_pairs(spark, sf), "grp", {"a": F.col("a_ok"), "b": F.col("b_ok"), "n": F.lit(1)})
    d = st.bootstrap_sums(g, "grp", ["a", "b", "n"], CV_DRAWS, 43).select(F.try_divide(F.col("a") - F.col("b"), F.col("n")).alias("diff"))
    return st.interval(d, "diff", p=st.two_sided_p(F.col("diff")))


@query(_AB + f""", g as (select grp, y_true, sum(a_ok) as ok, count(*) as n from ab group by grp, y_true), {_boot("g", 44, EXTERNAL_DRAWS, "grp", "y_true")}, dr as (select y_true, d, sum(w * ok) / sum(w * n) as recall from bw group by y_true, d having sum(w * n) > 0)
select y_true, {_CI.format(v="recall")} from dr group by y_true""")
def bootstrap_recall_ci(spark, sf):
    g = st.group_sums(_pairs(spark, sf), "grp", {"ok": F.col("a_ok"), "n": F.lit(1)}, "y_true")
    d = st.bootstrap_sums(g, "grp", ["ok", "n"], EXTERNAL_DRAWS, 44, "y_true").select("y_true", F.try_divide("ok", "n").alias("recall"))
    return st.interval(d, "recall", "y_true")


@query(_AB + f""", s as (select grp, y_true, sum(a_ok) filter (where grp % 2 = 0) as ok1, count_if(grp % 2 = 0) as n1, sum(a_ok) filter (where grp % 2 = 1) as ok0, count_if(grp % 2 = 1) as n0 from ab group by all), {_boot("s", 45, EXTERNAL_DRAWS, "grp", "y_true")},
dr as (select d, y_true, sum(w * coalesce(ok1, 0)) / nullif(sum(w * n1), 0) - sum(w * coalesce(ok0, 0)) / nullif(sum(w * n0), 0) as delta from bw group by d, y_true), q as (select d, avg(delta) as delta from dr group by d)
select {_CI.format(v="delta")} from q""")
def bootstrap_stratified_delta(spark, sf):
    """Mean over classes of the difference in recall between two strata; a class missing from either is left out."""
    pairs = _pairs(spark, sf)
    yes = F.col("grp") % 2 == 0
    g = st.group_sums(pairs, "grp", {"ok1": F.when(yes, F.col("a_ok")).otherwise(0), "n1": yes.cast("int"), "ok0": F.when(~yes, F.col("a_ok")).otherwise(0), "n0": (~yes).cast("int")}, "y_true")
    d = st.bootstrap_sums(g, "grp", ["ok1", "n1", "ok0", "n0"], EXTERNAL_DRAWS, 45, "y_true")
    per = d.select("draw", (F.try_divide("ok1", "n1") - F.try_divide("ok0", "n0")).alias("delta"))
    return st.interval(per.groupBy("draw").agg(F.avg("delta").alias("delta")), "delta")


@query(_AB + f""", g as (select grp, sum(a_ok - b_ok) as d0, count(*) as n from ab group by grp), {_boot("g", 46, EXTERNAL_DRAWS, "grp")}, dr as (select d, sum(w * d0) / sum(w * n) as diff from bw group by d),
q as (select avg(diff) as mean, count(diff) as n_draws, least(1.0, 2 * (least(count_if(diff <= 0), count_if(diff >= 0)) + 1) / (count(diff) + 1)) as q from dr)
select round(mean, 6) as mean, n_draws, round(q, 6) as p, case when q < 2.0 / {EXTERNAL_DRAWS + 1} then '<{2 / (EXTERNAL_DRAWS + 1):.4f}' else printf('%.4f', q) end as p_text from q""")
def bootstrap_cluster(spark, sf):
    g = st.group_sums(_pairs(spark, sf), "grp", {"d0": F.col("a_ok") - F.col("b_ok"), "n": F.lit(1)})
    d = st.bootstrap_sums(g, "grp", ["d0", "n"], EXTERNAL_DRAWS, 46).select(F.try_divide("d0", "n").alias("diff"))
    out = d.agg(F.round(F.avg("diff"), 6).alias("mean"), F.count("diff").alias("n_draws"), st.two_sided_p_plus(F.col("diff")).alias("q"))
    return out.select("mean", "n_draws", F.round("q", 6).alias("p"), st.format_p(F.col("q"), EXTERNAL_DRAWS, True).alias("p_text"))


_CELLS = [(a, b) for a in ABC for b in ABC]
_SUMS = [*(f"c_{a}{b}" for a, b in _CELLS), "sq", *(f"{k}{i}" for i in range(1, 16) for k in ("bn", "bc", "ba"))]
_UNITS = f"""{DEC}, it as (select dc.*, ceil(round(conf * 15, 9))::int as bin from dc),
g as (select grp, {", ".join(f"count_if(y_true = '{a}' and pred = '{b}') as c_{a}{b}" for a, b in _CELLS)}, sum(sq) as sq, {", ".join(f"count_if(bin = {i}) as bn{i}, coalesce(sum(conf) filter (where bin = {i}), 0) as bc{i}, coalesce(sum(correct) filter (where bin = {i}), 0) as ba{i}" for i in range(1, 16))} from it group by grp)"""


def _metric_exprs(div, add) -> dict[str, str]:
    """Every metric as a SQL expression over the additive sums of a sample."""
    total = add(f"c_{a}{b}" for a, b in _CELLS)
    tp = {a: f"c_{a}{a}" for a in ABC}
    true = {a: "(" + add(f"c_{a}{b}" for b in ABC) + ")" for a in ABC}
    pred = {a: "(" + add(f"c_{b}{a}" for b in ABC) + ")" for a in ABC}
    f1 = {a: f"coalesce({div(f'2 * {tp[a]}', f'({true[a]} + {pred[a]})')}, 0)" for a in ABC}
    mean = lambda xs: "(" + add(xs) + f") / {len(ABC)}"
    present = " + ".join(f"cast({true[a]} > 0 as int)" for a in ABC)
    bins = range(1, 16)
    return {
        "accuracy": div("(" + add(tp.values()) + ")", f"({total})"),
        "balanced_accuracy": div("(" + add(f"coalesce({div(tp[a], true[a])}, 0)" for a in ABC) + ")", f"({present})"),
        "macro_precision": mean(f"coalesce({div(tp[a], pred[a])}, 0)" for a in ABC),
        "macro_recall": mean(f"coalesce({div(tp[a], true[a])}, 0)" for a in ABC),
        "macro_specificity": mean(f"coalesce({div(f'({total} - {true[a]} - {pred[a]} + {tp[a]})', f'({total} - {true[a]})')}, 0)" for a in ABC),
        "macro_f1": mean(f1[a] for a in ABC),
        "weighted_f1": div("(" + add(f"{true[a]} * {f1[a]}" for a in ABC) + ")", f"({total})"),
        "brier": div("sq", f"({total})"),
        "ece": div("(" + add(f"abs(ba{i} - bc{i})" for i in bins) + ")", "(" + add(f"bn{i}" for i in bins) + ")"),
        "mean_confidence": div("(" + add(f"bc{i}" for i in bins) + ")", "(" + add(f"bn{i}" for i in bins) + ")"),
    }


_PLUS = " + ".join
_DUCK = _metric_exprs(lambda a, b: f"({a} / nullif({b}, 0))", _PLUS)


def _unit_sums(spark, sf):
    """The additive sums of every metric per resampling unit."""
    it = v.decisions(spark, sf).withColumn("bin", F.ceil(F.round(F.col("conf") * 15, 9)).cast("int"))
    sums = {f"c_{a}{b}": ((F.col("y_true") == a) & (F.col("pred") == b)).cast("int") for a, b in _CELLS}
    sums["sq"] = F.col("sq")
    for i in range(1, 16):
        here = F.col("bin") == i
        sums |= {f"bn{i}": here.cast("int"), f"bc{i}": F.when(here, F.col("conf")).otherwise(0.0), f"ba{i}": F.when(here, F.col("correct")).otherwise(0)}
    return st.group_sums(it, "grp", sums)


@query("with " + _UNITS + ", t as (select " + ", ".join(f"sum({c})::double as {c}" for c in _SUMS) + " from g) " + " union all ".join(f"select '{m}' as metric, round({x}, 6) as value from t" for m, x in _DUCK.items()))
def all_metrics(spark, sf):
    """Every metric of a set of predictions: fixed labels, empty denominators 0, balanced accuracy over the labels present."""
    t_ = _unit_sums(spark, sf).agg(*[F.sum(c).cast("double").alias(c) for c in _SUMS])
    exprs = _metric_exprs(lambda a, b: f"try_divide({a}, {b})", _PLUS)
    return t_.select(F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.round(F.expr(x), 6).alias("value")) for m, x in exprs.items()])))


@query("with " + _UNITS + f", {_boot('g', 47, CV_DRAWS, 'grp')}, dr as (select d, " + ", ".join(f"sum(w * {c})::double as {c}" for c in _SUMS) + " from bw group by d), mv as (" + " union all ".join(f"select d, '{m}' as metric, {x} as v from dr" for m, x in _DUCK.items()) + f") select metric, {_CI.format(v='v')} from mv group by metric")
def bootstrap_metrics_ci(spark, sf):
    """Intervals of every metric over one group bootstrap; a draw in which a metric is undefined is skipped for it."""
    d = st.bootstrap_sums(_unit_sums(spark, sf), "grp", _SUMS, CV_DRAWS, 47)
    exprs = _metric_exprs(lambda a, b: f"try_divide({a}, {b})", _PLUS)
    long = d.select("draw", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.expr(x).alias("v")) for m, x in exprs.items()])))
    return st.interval(long, "v", "metric")


@query(f"with {CURATED}, b as (select label, bytes, path, median(bytes) over (partition by label) as med from c where bytes > 0 and label is not null) select label, path, med from (select *, row_number() over (partition by label order by abs(bytes - med), path) as r from b) where r = 1")
def median_representative(spark, sf):
    b = v.curated(spark, sf).where("bytes > 0 and label is not null").select("label", "bytes", "path")
    med = b.groupBy("label").agg(F.median("bytes").alias("med"))
    near = b.join(med, "label")
    return near.groupBy("label", "med").agg(F.min(F.struct(F.abs(F.col("bytes") - F.col("med")).alias("a"), "path")).alias("m")).select("label", F.col("m.path").alias("path"), "med")


@query(f"with {CURATED}, n as (select label, count(*) as n from c where label is not null group by label) select max(n) / sum(n) as majority_baseline, 1.0 / count(*) as chance, count(*) as n_labels from n")
def majority_baseline(spark, sf):
    n = v.curated(spark, sf).where("label is not null").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return n.agg((F.max("n") / F.sum("n")).alias("majority_baseline"), (F.lit(1.0) / F.count(F.lit(1))).alias("chance"), F.count(F.lit(1)).alias("n_labels"))


@query(f"{_LF}, n as (select label, count(*) as n from l where label is not null group by label) select label, n, round((select sum(n) from n) / ((select count(*) from n) * n), 6) as weight from n")
def class_weights(spark, sf):
    n = v.labelled_folds(spark, sf).where("label is not null").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy()
    return n.withColumn("weight", F.round(F.sum("n").over(w) / (F.count(F.lit(1)).over(w) * F.col("n")), 6))


_PUB = f"""with {CURATED.replace("c as", "c0 as")}, m as (select grp, path, split from (select nullif(lower(trim(group_id)), '') as grp, path,
 coalesce(case list_filter(string_split(lower(path), '/')[:-2], lambda x: x in ('train', 'training', 'val', 'valid', 'validation', 'test', 'testing'))[1] when 'train' then 'train' when 'training' then 'train' when 'val' then 'val' when 'valid' then 'val' when 'validation' then 'val' when 'test' then 'test' when 'testing' then 'test' end, 'unassigned') as split
 from bdneuro_v7_manifest where path is not null) where grp is not null group by all)"""


@query(_PUB + """, g as (select grp, count(distinct split) as ns, count(*) as n, count_if(split = 'test') as nt, count_if(split <> 'test') as no from m group by grp)
select count_if(ns > 1)::bigint as spanning_groups, coalesce(sum(n) filter (where ns > 1), 0)::bigint as images_involved, coalesce(sum(nt) filter (where no > 0), 0)::bigint as test_with_sibling, sum(nt)::bigint as test_images from g""")
def publisher_split_integrity(spark, sf):
    """Groups of the external release that its own folders put in several splits."""
    from ..functions import paths as px

    m = t(spark, sf, "bdneuro_v7_manifest").where("path is not null").select(F.lower(F.trim("group_id")).alias("grp"), "path", px.split_of(F.col("path")).alias("split")).where("grp <> ''").distinct()
    g = m.groupBy("grp").agg(F.countDistinct("split").alias("ns"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("split") == "test").alias("nt"), F.count_if(F.col("split") != "test").alias("no"))
    part = lambda c, k: F.coalesce(F.sum(F.when(c, F.col(k))), F.lit(0))
    return g.agg(F.count_if(F.col("ns") > 1).alias("spanning_groups"), part(F.col("ns") > 1, "n").alias("images_involved"), part(F.col("no") > 0, "nt").alias("test_with_sibling"), F.sum("nt").alias("test_images"))


@query(f"with {DEC}, b as (select correct, conf, case when conf < 0.5 then '[0,0.5)' when conf < 0.8 then '[0.5,0.8)' when conf < 0.9 then '[0.8,0.9)' else '[0.9,1]' end as band from dc) select band, count(*) as n, round(avg(correct), 6) as accuracy, round(avg(conf), 6) as mean_conf from b group by band having count(*) >= 20")
def confidence_bands(spark, sf):
    """Accuracy in closed-open bands of a score; bands with fewer than 20 items are left out."""
    c = F.col("conf")
    band = F.when(c < 0.5, "[0,0.5)").when(c < 0.8, "[0.5,0.8)").when(c < 0.9, "[0.8,0.9)").otherwise("[0.9,1]")
    g = v.decisions(spark, sf).groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("correct"), 6).alias("accuracy"), F.round(F.avg("conf"), 6).alias("mean_conf"))
    return g.where("n >= 20")


@query(f"""with {RUNS}, e as (select run_id, unnest(map_entries(models)) as e from m), s as (select run_id, e.key as model, unnest(map_entries(e.value.support)) as s from e where e.value is not null)
select run_id, model, sum(s.value)::bigint as n, arg_max(s.key, (s.value, s.key)) as largest_class, count(*) as n_classes from s where s.value is not null group by 1, 2""")
def support_totals(spark, sf):
    s = v.runs(spark, sf).select("run_id", F.explode("models").alias("model", "e")).select("run_id", "model", F.explode("e.support").alias("k", "n")).where("n is not null")
    return s.groupBy("run_id", "model").agg(F.sum("n").alias("n"), F.max(F.struct("n", "k")).alias("b"), F.count(F.lit(1)).alias("n_classes")).select("run_id", "model", "n", F.col("b.k").alias("largest_class"), "n_classes")
