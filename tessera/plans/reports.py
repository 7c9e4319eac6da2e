"""Report tables, exposure contrasts and round trips through file formats."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import paths as px
from ..operators import graph as gr
from ..operators import neighbours as ne
from ..operators import statistics as st
from ..session import Staging, shared_dir
from ..sources import readers
from ..sources import views as v
from ..sources.tables import table as t
from .base_sql import CURATED, FILES, FOLDS, LABELLED, RUNS
from .base_sql import D as _D
from .base_sql import P as _P
from .registry_tools import registry
from .selection import _INNER, _h, stored_inner

QUERIES, SQL, query = registry()
_LF = f"with {LABELLED}"
MODELS = ("cnn", "svm")


def _n():
    return F.count(F.lit(1))


@query(f"with {CURATED} select count(*) as images, count(distinct grp) as n_groups, count(distinct patient) as patients, count(patient) as with_patient, count(mask) as masks from c")
def curated_totals(spark, sf):
    return v.curated(spark, sf).agg(_n().alias("images"), F.countDistinct("grp").alias("n_groups"), F.countDistinct("patient").alias("patients"), F.count("patient").alias("with_patient"), F.count("mask").alias("masks"))


@query(f"with {CURATED}, k as (select dup_cluster, min(patient) as cp from c where dup_cluster is not null group by 1) select round(100.0 * count(coalesce(c.patient, k.cp)) / count(*), 6) as pct, count_if(c.patient is null and k.cp is not null)::bigint as gained from c left join k using (dup_cluster)")
def propagated_share(spark, sf):
    """Share of rows with a patient after identifiers were passed on within duplicate clusters."""
    c = v.curated(spark, sf)
    k = c.where("dup_cluster is not null").groupBy("dup_cluster").agg(F.min("patient").alias("cp"))
    j = c.join(k.hint("merge"), "dup_cluster", "left")
    return j.agg(F.round(100.0 * F.count(F.coalesce("patient", "cp")) / _n(), 6).alias("pct"), F.count_if(F.col("patient").isNull() & F.col("cp").isNotNull()).alias("gained"))


@query(f"with {CURATED}, k as (select dup_cluster, min(patient) as pid, min(mask) as cmask from c where dup_cluster is not null group by 1) select c.path, c.dup_cluster, coalesce(c.mask, case when k.pid is not null then k.cmask end) as mask from c join k using (dup_cluster) where c.mask is null and k.pid is not null and k.cmask is not null")
def propagated_masks(spark, sf):
    """Masks passed on to files without one, only within clusters that have a patient."""
    c = v.curated(spark, sf).where("dup_cluster is not null")
    k = c.groupBy("dup_cluster").agg(F.min("patient").alias("pid"), F.min("mask").alias("cmask")).where("pid is not null and cmask is not null")
    return c.where("mask is null").join(k, "dup_cluster").select("path", "dup_cluster", F.col("cmask").alias("mask"))


@query(f"with {CURATED} select count(*) as n_clusters, count_if(n > 1)::bigint as n_cross from (select dup_cluster, count(distinct source) as n from c where dup_cluster is not null group by 1)")
def cluster_sources(spark, sf):
    k = v.curated(spark, sf).where("dup_cluster is not null").groupBy("dup_cluster").agg(F.countDistinct("source").alias("n"))
    return k.agg(_n().alias("n_clusters"), F.count_if(F.col("n") > 1).alias("n_cross"))


@query(f"with {CURATED} select label, count(*) as n, count(distinct grp) as n_groups, round(count(*) / nullif(count(distinct grp), 0), 6) as per_group from c where label is not null and grp is not null group by label")
def group_ratios(spark, sf):
    g = v.curated(spark, sf).where("label is not null and grp is not null").groupBy("label").agg(_n().alias("n"), F.countDistinct("grp").alias("n_groups"))
    return g.withColumn("per_group", F.round(F.try_divide("n", "n_groups"), 6))


@query(f"with {CURATED} select source, label, count(*) as n from c where source is not null and label is not null group by 1, 2")
def source_class_counts(spark, sf):
    return v.curated(spark, sf).where("source is not null and label is not null").groupBy("source", "label").agg(_n().alias("n"))


@query(f"with {FILES} select source, count(distinct width || 'x' || height) as n_dims from f where source is not null group by source")
def source_dims(spark, sf):
    dims = F.when(F.col("width").isNotNull() & F.col("height").isNotNull(), F.concat_ws("x", "width", "height"))
    return v.files(spark, sf, "source", "width", "height").where("source is not null").groupBy("source").agg(F.countDistinct(dims).alias("n_dims"))


@query(f"with {FILES}, k as (select case when class is null or class = 'unknown' then 'class unknown' when source like 'mirror%' then 'mirror of another set' when source = 'slicebank' and class = 'notumor' then 'no healthy slices by design' else 'kept' end as reason from f) select reason, count(*) as n from k group by reason")
def exclusion_rationale(spark, sf):
    """Files by the reason they are left out, or kept."""
    reason = F.when(F.col("class").isNull() | (F.col("class") == "unknown"), "class unknown").when(F.col("source").startswith("mirror"), "mirror of another set").when((F.col("source") == "slicebank") & (F.col("class") == "notumor"), "no healthy slices by design").otherwise("kept")
    return v.files(spark, sf, "source", "class").groupBy(reason.alias("reason")).agg(_n().alias("n"))


@query(f"with {CURATED} select count(*) as n from c where label = 'category that is gone'")
def lost_category(spark, sf):
    """A count whose category the data no longer have: claims on it must be skipped, not matched."""
    return v.curated(spark, sf).where("label = 'category that is gone'").agg(_n().alias("n"))


_CM = f"with {RUNS}, e as (select run_id, labels, unnest(map_entries(models)) as e from m), r as (select run_id, labels, e.key as model, unnest(e.value.confusion_matrix) as row, generate_subscripts(e.value.confusion_matrix, 1) as i from e), x as (select run_id, labels, model, i, unnest(row) as n, generate_subscripts(row, 1) as j from r), y as (select run_id, model, labels[i] as yt, labels[j] as yp, n from x)"
_CK = _CM + ", k as (select run_id, model, l as label, sum(n) filter (where yt = l and yp = l) as tp, sum(n) filter (where yt = l) as t, sum(n) filter (where yp = l) as p from y, (select distinct yt as l from y where yt is not null) group by 1, 2, 3 having sum(n) filter (where yt = l) is not null)"


def _class_cells(spark, sf):
    e = v.runs(spark, sf).select("run_id", "labels", F.explode("models").alias("model", "e"))
    r = e.select("run_id", "labels", "model", F.posexplode("e.confusion_matrix").alias("i", "row"))
    y = r.select("run_id", "labels", "model", "i", F.posexplode("row").alias("j", "n")).select("run_id", "model", F.get("labels", F.col("i")).alias("yt"), F.get("labels", F.col("j")).alias("yp"), "n")
    both = y.select("run_id", "model", F.inline(F.array(F.struct(F.col("yt").alias("label"), F.when(F.col("yt") == F.col("yp"), F.col("n")).alias("tp"), F.col("n").alias("t"), F.lit(None).cast("bigint").alias("p")), F.struct(F.col("yp").alias("label"), F.lit(None).cast("bigint").alias("tp"), F.lit(None).cast("bigint").alias("t"), F.col("n").alias("p")))))
    k = both.where("label is not null").groupBy("run_id", "model", "label").agg(F.sum("tp").alias("tp"), F.sum("t").alias("t"), F.sum("p").alias("p"))
    return k.where("t is not null")


@query(_CK + " select run_id, model, label, round(coalesce(tp / nullif(t, 0), 0), 6) as recall, round(coalesce(tp / nullif(p, 0), 0), 6) as precision, round(coalesce(2 * tp / nullif(t + p, 0), 0), 6) as f1, t::bigint as support from k")
def run_class_metrics(spark, sf):
    """Recall, precision and F1 of every class of every run, from its confusion matrix."""
    z = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    return _class_cells(spark, sf).select("run_id", "model", "label", z(F.col("tp"), F.col("t")).alias("recall"), z(F.col("tp"), F.col("p")).alias("precision"), z(2 * F.col("tp"), F.col("t") + F.col("p")).alias("f1"), F.col("t").alias("support"))


@query(_CK + ", o as (select run_id, model, label, coalesce(tp / nullif(t, 0), 0) as r, t from k) select run_id, model, label, round(r, 6) as recall, round(greatest(0, r - 1.96 * sqrt(r * (1 - r) / nullif(t, 0))), 6) as lo, round(least(1, r + 1.96 * sqrt(r * (1 - r) / nullif(t, 0))), 6) as hi from o")
def per_class_ci(spark, sf):
    """Per-class values unnested from keys like recall::glioma, with their intervals side by side."""
    r = F.coalesce(F.try_divide("tp", "t"), F.lit(0.0))
    half = 1.96 * F.sqrt(F.try_divide(r * (1 - r), F.col("t")))
    k = _class_cells(spark, sf)
    keyed = k.select("run_id", "model", F.create_map(F.concat(F.lit("recall::"), "label"), r, F.concat(F.lit("lo::"), "label"), F.greatest(F.lit(0.0), r - half), F.concat(F.lit("hi::"), "label"), F.least(F.lit(1.0), r + half)).alias("point"))
    long = keyed.select("run_id", "model", F.explode("point").alias("key", "x")).withColumn("kind", F.split_part("key", F.lit("::"), F.lit(1))).withColumn("label", F.split_part("key", F.lit("::"), F.lit(2)))
    wide = long.groupBy("run_id", "model", "label").pivot("kind", ["recall", "lo", "hi"]).agg(F.max("x"))
    return wide.select("run_id", "model", "label", *[F.round(c, 6).alias(c) for c in ("recall", "lo", "hi")])


_CP = f"with {RUNS}, cp as (select m.run_id, unnest(comparisons) as x, generate_subscripts(comparisons, 1) - 1 as i from m), q as (select run_id, i, x.model_a as a, x.model_b as b, x.mcnemar_exact_p as p, least(x.model_a, x.model_b) = 'cnn' and greatest(x.model_a, x.model_b) = 'svm' as fixed from cp where x is not null and x.mcnemar_exact_p is not null and x.model_a is not null and x.model_b is not null)"


@query(_CP + """, r as (select *, least(1.0, p * (count(*) over w - row_number() over (w order by p, i) + 1)) as raw from q where not fixed window w as (partition by run_id)), h as (select *, max(raw) over (partition by run_id order by p, i rows unbounded preceding) as ph from r)
select run_id, i::int as i, a as model_a, b as model_b, 'prespecified' as family, p, round(p, 6) as p_used from q where fixed union all select run_id, i::int, a, b, 'exploratory', p, round(ph, 6) from h""")
def prespecified_comparisons(spark, sf):
    """The pair named beforehand keeps its p value; only the exploratory ones are adjusted among themselves."""
    c = v.runs(spark, sf).select("run_id", F.posexplode("comparisons").alias("i", "x")).select("run_id", "i", "x.model_a", "x.model_b", F.col("x.mcnemar_exact_p").alias("p")).where("p is not null and model_a is not null and model_b is not null")
    fixed = (F.least("model_a", "model_b") == "cnn") & (F.greatest("model_a", "model_b") == "svm")
    cols = ["run_id", "i", "model_a", "model_b"]
    one = c.where(fixed).select(*cols, F.lit("prespecified").alias("family"), "p", F.round("p", 6).alias("p_used"))
    rest = st.holm(c.where(~fixed), "p", ["run_id"], ["i"]).select(*cols, F.lit("exploratory").alias("family"), "p", F.round("p_holm", 6).alias("p_used"))
    return one.unionByName(rest)


@query(f"{_LF} select source, count(*) as n_rows, count(distinct unit) as n_units, count(distinct label) as n_labels, case when count(*) < 300 or count(distinct label) < 3 then 'not constructible' else 'ok' end as status from l group by source")
def source_probe_summary(spark, sf):
    """Whether what is left of a source can carry a probe: 300 rows and three classes."""
    g = v.labelled_folds(spark, sf).groupBy("source").agg(_n().alias("n_rows"), F.countDistinct("unit").alias("n_units"), F.countDistinct("label").alias("n_labels"))
    return g.withColumn("status", F.when((F.col("n_rows") < 300) | (F.col("n_labels") < 3), "not constructible").otherwise("ok"))


_HIT = f"{FILES}, qh as (select path, min(p) as p, min(d) as d from (select path, {_P} as p, {_D} as d from bdneuro_v7_manifest where path is not null) where p is not null and d is not null group by path), pool as (select p, d, min(file_id) as rep from f where p is not null and d is not null group by p, d), near as (select qh.path, pool.rep, greatest(bit_count(xor(qh.p, pool.p)), bit_count(xor(qh.d, pool.d)))::int as dist from qh, pool where bit_count(xor(qh.p, pool.p)) <= 4 and bit_count(xor(qh.d, pool.d)) <= 4), nn as (select path, arg_min(rep, (dist, rep)) as rep from near group by path)"


@query(f"with {_HIT}, one as (select path, min(lower(trim(label))) as label, min(nullif(lower(trim(group_id)), '')) as grp from bdneuro_v7_manifest where path is not null group by path), j as (select one.label, one.grp, (f.class = one.label) as same from nn join one using (path) join f on f.file_id = nn.rep where one.label in ('glioma', 'meningioma', 'pituitary') and f.class is not null) select label, count(*) as n_matched, round(avg(same::int), 6) as agreement, count(distinct grp) as n_groups from j group by label")
def published_leak(spark, sf):
    """Tumour items of the release within 4 bits of the index: how many, whether their classes agree, and their groups."""
    files = v.files(spark, sf, "class", "p", "d")
    near = ne.within(v.external(spark, sf), "path", ne.hash_classes(files), 4).groupBy("path").agg(F.min(F.struct("distance", "match_id")).alias("m"))
    m = t(spark, sf, "bdneuro_v7_manifest").where("path is not null").select("path", F.lower(F.trim("label")).alias("label"), F.nullif(F.lower(F.trim("group_id")), F.lit("")).alias("grp")).groupBy("path").agg(F.min("label").alias("label"), F.min("grp").alias("grp"))
    j = near.select("path", F.col("m.match_id").alias("file_id")).join(m, "path").join(files.select("file_id", "class"), "file_id").where(F.col("label").isin("glioma", "meningioma", "pituitary") & F.col("class").isNotNull())
    return j.groupBy("label").agg(_n().alias("n_matched"), F.round(F.avg((F.col("class") == F.col("label")).cast("double")), 6).alias("agreement"), F.countDistinct("grp").alias("n_groups"))


@query(f"with {_HIT}, nd as (select dist, count(*) as n from near group by dist) select dist as distance, n, repeat('#', least(60, floor(60 * n / max(n) over ())::bigint)) as bar from nd")
def match_bars(spark, sf):
    """Close pairs by distance, as bars scaled to sixty characters."""
    near = ne.within(v.external(spark, sf), "path", ne.hash_classes(v.files(spark, sf, "p", "d")), 4)
    n = near.groupBy("distance").agg(_n().alias("n"))
    width = F.least(F.lit(60), F.floor(60 * F.col("n") / F.max("n").over(Window.partitionBy())).cast("int"))
    return n.withColumn("w", width).select("distance", "n", F.expr("repeat('#', w)").alias("bar"))


@query("with b as (select distinct path, string_split(lower(path), '/')[:-2] as dirs from bdneuro_v7_manifest where path is not null), k as (select lower(trim(m.label)) as label, coalesce(case list_filter(b.dirs, lambda x: x in ('train', 'training', 'val', 'valid', 'validation', 'test', 'testing'))[1] when 'train' then 'train' when 'training' then 'train' when 'val' then 'val' when 'valid' then 'val' when 'validation' then 'val' when 'test' then 'test' when 'testing' then 'test' end, 'unassigned') as split from b join (select path, min(label) as label from bdneuro_v7_manifest where path is not null group by path) m using (path)) select label, count(*) as n_files, count_if(split <> 'unassigned')::bigint as n_assigned from k group by label")
def assigned_counts(spark, sf):
    """Files per class less those of no split, from a map of counts by split."""
    m = t(spark, sf, "bdneuro_v7_manifest").where("path is not null").groupBy("path").agg(F.min("label").alias("label"))
    n = m.groupBy(F.lower(F.trim("label")).alias("label"), px.split_of(F.col("path")).alias("split")).agg(_n().alias("n"))
    by = n.groupBy("label").agg(F.map_from_entries(F.collect_list(F.struct("split", "n"))).alias("counts"))  # one entry per split
    total = F.aggregate(F.map_values("counts"), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return by.select("label", total.alias("n_files"), (total - F.coalesce(F.try_element_at("counts", F.lit("unassigned")), F.lit(0))).alias("n_assigned"))


_CFG = "q as (select 'main' as config, * from l union all select 'figshare_only', * from l where patient is not null and label <> 'notumor')"


@query(f"{_LF}, {_CFG} select config, fold, label, count(*) as images, count(distinct unit) as units, round(count(*) / count(distinct unit), 2) as ratio from q where label is not null group by 1, 2, 3")
def partitions_by_config(spark, sf):
    """Images, units and their ratio by configuration, fold and class."""
    f = v.labelled_folds(spark, sf).where("label is not null")
    conf = F.array(F.lit("main"), F.when(F.col("patient").isNotNull() & (F.col("label") != "notumor"), "figshare_only"))
    q = f.select("*", F.explode(F.filter(conf, lambda x: x.isNotNull())).alias("config"))
    g = q.groupBy("config", "fold", "label").agg(_n().alias("images"), F.countDistinct("unit").alias("units"))
    return g.withColumn("ratio", F.round(F.col("images") / F.col("units"), 2))


@query(f"{_LF}, {_INNER} select k.k::int as fold, case when l.fold = k.k then 'test' when inn.inner_fold = 0 then 'train_earlystop' else 'train_fit' end as part, l.label, count(*) as n from l cross join range(5) k(k) left join inn on inn.outer_fold = k.k and inn.path = l.path group by 1, 2, 3")
def augmentation_stored(spark, sf):
    """Parts of each outer fold per class, with the stored inner folds: stop set, fit set and test set."""
    q = v.labelled_folds(spark, sf).select("path", "label", F.col("fold").alias("own"), F.explode(F.array(*map(F.lit, range(5)))).alias("outer_fold"))
    j = q.join(stored_inner(spark, sf), ["outer_fold", "path"], "left")
    part = F.when(F.col("own") == F.col("outer_fold"), "test").when(F.col("inner_fold") == 0, "train_earlystop").otherwise("train_fit")
    return j.groupBy(F.col("outer_fold").alias("fold"), part.alias("part"), "label").agg(_n().alias("n"))


@query(f"{_LF}, {_INNER} select count(*) as n_inner, count_if(l.fold = inn.outer_fold)::bigint as n_overlap from inn join l using (path)")
def inner_outer_disjoint(spark, sf):
    """Rows of the stored inner folds whose file is in the test part of that outer fold; must be 0."""
    j = stored_inner(spark, sf).join(v.labelled_folds(spark, sf).select("path", "fold"), "path")
    return j.agg(_n().alias("n_inner"), F.count_if(F.col("fold") == F.col("outer_fold")).alias("n_overlap"))


_SRC = f"""with {FILES}, {CURATED}, {FOLDS}, raw as (select source, count(*) as raw_n from f where source is not null group by 1), g as (select c.source, count(*) as curated, count(s.path) as after, count(distinct c.patient) as patients, count(distinct c.grp) as n_groups, count(distinct c.width || 'x' || c.height) as sizes from c left join s using (path) where c.source is not null group by 1)"""


@query(_SRC + " select raw.source, raw_n, coalesce(curated, 0) as curated, coalesce(after, 0) as after, case when coalesce(patients, 0) = 0 then 'NR' else patients::varchar end as patients, coalesce(n_groups, 0) as n_groups, coalesce(sizes, 0) as sizes, t.r as trust from raw left join g using (source) left join (select lower(trim(source)) as source, min(trust_rank) as r from source_trust group by 1) t using (source) union all select 'TOTAL', (select sum(raw_n)::bigint from raw), sum(curated)::bigint, sum(after)::bigint, sum(patients)::varchar, sum(n_groups)::bigint, max(sizes), null from g")
def sources_overview(spark, sf):
    """Per source: files, curated rows, rows in the split, patients or NR, groups, sizes and its metadata; then the total."""
    raw = v.files(spark, sf, "source").where("source is not null").groupBy("source").agg(_n().alias("raw_n"))
    sizes = F.when(F.col("width").isNotNull() & F.col("height").isNotNull(), F.concat_ws("x", "width", "height"))
    c = v.curated(spark, sf).where("source is not null").join(v.folds(spark, sf), "path", "left")
    g = c.groupBy("source").agg(_n().alias("curated"), F.count("fold").alias("after"), F.countDistinct("patient").alias("np"), F.countDistinct("grp").alias("n_groups"), F.countDistinct(sizes).alias("sizes"))
    trust = t(spark, sf, "source_trust").groupBy(F.lower(F.trim("source")).alias("source")).agg(F.min("trust_rank").alias("trust"))
    j = Staging(spark, "overview").keep(raw.join(g, "source", "left").join(trust, "source", "left").na.fill(0, ["curated", "after", "np", "n_groups", "sizes"]))
    rows = j.select("source", "raw_n", "curated", "after", F.when(F.col("np") == 0, "NR").otherwise(F.col("np").cast("string")).alias("patients"), "n_groups", "sizes", "trust")
    total = j.agg(F.lit("TOTAL").alias("source"), *[F.sum(x).alias(x) for x in ("raw_n", "curated", "after")], F.sum("np").cast("string").alias("patients"), F.sum("n_groups").alias("n_groups"), F.max("sizes").alias("sizes"), F.lit(None).cast("int").alias("trust"))
    return rows.unionByName(total)


@query(f"with {FILES}, {CURATED}, b as (select class as label, count(*) as before from f where class is not null group by 1), a as (select label, count(*) as after from c where label is not null group by 1) select label, coalesce(before, 0) as before, coalesce(after, 0) as after from b full join a using (label)")
def before_after(spark, sf):
    """Files and curated rows per class, also of classes only one side has."""
    b = v.files(spark, sf, "class").where("class is not null").groupBy(F.col("class").alias("label")).agg(_n().alias("before"))
    a = v.curated(spark, sf).where("label is not null").groupBy("label").agg(_n().alias("after"))
    return b.join(a, "label", "full").na.fill(0, ["before", "after"]).select("label", "before", "after")


# Exposure: whether a near copy of an external item was in the development part of a fold.

_EXPO = f"""{LABELLED}, {FILES.replace("f as", "fl as")}, dev as (select fl.p, fl.d, l.fold, l.grp from l join fl using (path) where fl.p is not null and fl.d is not null),
qh as (select path, min(p) as p, min(d) as d from (select path, {_P} as p, {_D} as d from bdneuro_v7_manifest where path is not null) where p is not null and d is not null group by path),
xh as (select distinct qh.path, dev.fold, dev.grp from qh join dev on bit_count(xor(qh.p, dev.p)) <= 2 and bit_count(xor(qh.d, dev.d)) <= 2),
xf as (select path, count(distinct fold) as nf, min(fold) as f0 from xh group by path)"""
_ANSWER = f"""xr as (select xf.path, k.k::int as fold, (nf > 1 or f0 <> k.k) as exposed, mm.model from xf, range(5) k(k), (values ('cnn'), ('svm')) mm(model)),
xc as (select *, ({_h(11, 'path', 'fold', 'model')} % 100 < case when exposed then 80 else 70 end)::int as correct from xr)"""


def _exposure(spark, sf):
    """(path, fold of the near copy, grp) of external items with a near copy in the development set."""
    dev = v.labelled_folds(spark, sf).select("path", "fold", "grp").hint("merge").join(v.files(spark, sf, "path", "p", "d"), "path").where("p is not null and d is not null")
    classes = dev.groupBy("p", "d").agg(F.min("path").alias("rep"))
    hit = ne.within(v.external(spark, sf), "path", classes, 2).select("path", F.col("match_id").alias("rep"))
    return hit.join(dev.join(classes, ["p", "d"]).select("rep", "fold", "grp"), "rep").select("path", "fold", "grp").distinct()


def _answers(spark, sf):
    """Each exposed item under each fold's model of two kinds: whether that fold had a copy of it, and whether it was right."""
    per = _exposure(spark, sf).groupBy("path").agg(F.countDistinct("fold").alias("nf"), F.min("fold").alias("f0"))
    cells = per.select("path", "nf", "f0", F.explode(F.array(*map(F.lit, range(5)))).alias("fold")).select("*", F.explode(F.array(*map(F.lit, MODELS))).alias("model"))
    exposed = (F.col("nf") > 1) | (F.col("f0") != F.col("fold"))
    correct = st.draw(F.lit(11), "path", "fold", "model") % 100 < F.when(exposed, 80).otherwise(70)
    return cells.select("path", "fold", exposed.alias("exposed"), "model", correct.cast("int").alias("correct"))


@query(f"with {_EXPO}, {_ANSWER} select path, model, count_if(exposed)::bigint as n_exposed, count_if(not exposed)::bigint as n_unexposed, round(avg(correct) filter (where exposed), 6) as acc_exposed, round(avg(correct) filter (where not exposed), 6) as acc_unexposed from xc group by 1, 2 having count_if(exposed) > 0 and count_if(not exposed) > 0")
def paired_exposure_contrast(spark, sf):
    """Mean correctness of each item and model over folds that saw a copy and folds that did not; items need both kinds."""
    e = F.col("exposed")
    g = _answers(spark, sf).groupBy("path", "model").agg(F.count_if(e).alias("n_exposed"), F.count_if(~e).alias("n_unexposed"), F.round(F.avg(F.when(e, F.col("correct"))), 6).alias("acc_exposed"), F.round(F.avg(F.when(~e, F.col("correct"))), 6).alias("acc_unexposed"))
    return g.where("n_exposed > 0 and n_unexposed > 0")


@query(f"with {_EXPO} select count(*) as n_items, count_if(nf = 1)::bigint as n_usable, count_if(nf > 1)::bigint as n_dropped from xf")
def usable_items(spark, sf):
    """Items exposed in some fold and unexposed in another; the rest are dropped and counted."""
    per = _exposure(spark, sf).groupBy("path").agg(F.countDistinct("fold").alias("nf"))
    return per.agg(_n().alias("n_items"), F.count_if(F.col("nf") == 1).alias("n_usable"), F.count_if(F.col("nf") > 1).alias("n_dropped"))


@query(f"with {_EXPO}, {_ANSWER}, w as (select path, model, avg(correct) filter (where exposed) as e, avg(correct) filter (where not exposed) as u from xc group by 1, 2 having count_if(exposed) > 0 and count_if(not exposed) > 0) select count(distinct path) as n_items, count(*) as n, round(100 * avg(e - u), 4) as diff_pp from w")
def paired_contrast_summary(spark, sf):
    e = F.col("exposed")
    w = _answers(spark, sf).groupBy("path", "model").agg(F.avg(F.when(e, F.col("correct"))).alias("e"), F.avg(F.when(~e, F.col("correct"))).alias("u")).where("e is not null and u is not null")
    return w.agg(F.countDistinct("path").alias("n_items"), _n().alias("n"), F.round(100 * F.avg(F.col("e") - F.col("u")), 4).alias("diff_pp"))


@query(f"""with recursive {_EXPO}, k as (select distinct 'i:' || path as a, 'g:' || grp as b from xh where grp is not null), e as (select a, b from k union select b, a from k), r(node, seen) as (select a, a from e union select r.node, e.b from r join e on r.seen = e.a)
select substr(node, 3) as path, min(seen) as cluster from r where node like 'i:%' group by node""")
def item_group_clusters(spark, sf):
    """External items that share a matched development group, through any number of groups."""
    k = _exposure(spark, sf).where("grp is not null").select(F.concat(F.lit("i:"), "path").alias("a"), F.concat(F.lit("g:"), "grp").alias("b")).distinct()
    return gr.components(k).where("node like 'i:%'").select(F.substring("node", 3, 100_000).alias("path"), F.col("component").alias("cluster"))


@query(f"with {_EXPO}, al as (select distinct path from bdneuro_v7_manifest where path is not null), un as (select al.path, ({_h(42, 'al.path')} % 5)::int as held from al left join xf using (path) where xf.path is null), nc as (select un.path, k.k::int as fold, k.k <> held as exposed, ({_h(12, 'un.path', 'k.k')} % 100 < 75)::int as correct from un, range(5) k(k)) select count(distinct path) as n_items, round(avg(correct) filter (where exposed), 6) as acc_exposed, round(avg(correct) filter (where not exposed), 6) as acc_unexposed from nc")
def negative_control(spark, sf):
    """Items without a copy, given one random unexposed fold each: the contrast should vanish."""
    every = t(spark, sf, "bdneuro_v7_manifest").where("path is not null").select("path").distinct()
    un = every.join(_exposure(spark, sf).select("path").distinct(), "path", "left_anti").withColumn("held", (st.draw(F.lit(42), "path") % 5).cast("int"))
    c = un.withColumn("fold", F.explode(F.array(*map(F.lit, range(5)))))
    e, ok = F.col("fold") != F.col("held"), (st.draw(F.lit(12), "path", "fold") % 100 < 75).cast("int")
    return c.agg(F.countDistinct("path").alias("n_items"), F.round(F.avg(F.when(e, ok)), 6).alias("acc_exposed"), F.round(F.avg(F.when(~e, ok)), 6).alias("acc_unexposed"))


@query(f"with {_HIT}, dd as (select qh.path, min(near.dist) as dist from qh left join near using (path) group by 1), one as (select path, min(lower(trim(label))) as label from bdneuro_v7_manifest where path is not null group by path), k as (select case when dist is null then '5+' when dist = 0 then '0' when dist <= 2 then '1-2' else '3-4' end as bin, label, ({_h(13, 'path')} % 100 < 75)::int as correct from dd join one using (path) where label in ('glioma', 'meningioma', 'pituitary', 'notumor')), c as (select bin, label, avg(correct) as r, count(*) as n from k group by 1, 2) select bin, sum(n)::bigint as n, round(sum(r) / 4, 6) as balanced_accuracy from c group by bin having sum(n) >= 20")
def metric_by_distance(spark, sf):
    """Balanced accuracy over the fixed classes in distance bins of at least twenty items."""
    near = ne.within(v.external(spark, sf), "path", ne.hash_classes(v.files(spark, sf, "p", "d")), 4).groupBy("path").agg(F.min("distance").alias("dist"))
    one = t(spark, sf, "bdneuro_v7_manifest").where("path is not null").groupBy("path").agg(F.min(F.lower(F.trim("label"))).alias("label")).where(F.col("label").isin("glioma", "meningioma", "pituitary", "notumor"))
    d = F.col("dist")
    bin_ = F.when(d.isNull(), "5+").when(d == 0, "0").when(d <= 2, "1-2").otherwise("3-4")
    k = v.external(spark, sf).select("path").join(near, "path", "left").join(one, "path").select(bin_.alias("bin"), "label", (st.draw(F.lit(13), "path") % 100 < 75).cast("int").alias("correct"))
    c = k.groupBy("bin", "label").agg(F.avg("correct").alias("r"), _n().alias("n"))
    return c.groupBy("bin").agg(F.sum("n").alias("n"), F.round(F.sum("r") / 4, 6).alias("balanced_accuracy")).where("n >= 20")


# Round trips: what is written in a format and read again must be what the table holds.


def _path(spark, name: str) -> str:
    import uuid

    return f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex[:12]}"


@query("select path, nullif(source, '') as source, nullif(label, '') as label, width, bytes, outer_fold from (select distinct d.path, d.source, d.label, d.width, d.bytes, null::int as outer_fold from dataset d where path is not null)")
def csv_round_trip(spark, sf):
    """Curated rows written as CSV and read with a fixed schema; empty text is NULL."""
    rows = t(spark, sf, "dataset").where("path is not null").select("path", "source", "label", "width", "bytes").distinct().withColumn("outer_fold", F.lit(None).cast("int"))
    out = _path(spark, "csv")
    readers.write(rows, out, "csv")
    return readers.csv_table(spark, out, "path string, source string, label string, width int, bytes bigint, outer_fold int")


@query(f"with {RUNS}, e as (select run_id, unnest(map_entries(models)) as e from m) select run_id, e.key as model, e.value.point['accuracy'] as accuracy from e")
def json_round_trip(spark, sf):
    """Runs written as one JSON report each and read back as documents."""
    r = v.runs(spark, sf).select("run_id", "models")
    out = _path(spark, "json")
    readers.write_json(r, out)
    docs = readers.json_lines(spark, out)
    models = F.try_variant_get(F.col("doc"), "$.models", "map<string,variant>")
    e = docs.select(F.try_variant_get(F.col("doc"), "$.run_id", "string").alias("run_id"), F.explode(models).alias("model", "e"))
    return e.select("run_id", "model", F.try_variant_get(F.col("e"), "$.point.accuracy", "double").alias("accuracy"))


@query(f"with {CURATED} select label || ': ' || count(*) || ' rows' as line from c where label is not null group by label")
def text_report(spark, sf):
    """A report written as lines of text."""
    g = v.curated(spark, sf).where("label is not null").groupBy("label").agg(_n().alias("n"))
    out = _path(spark, "text")
    readers.write(g.select(F.concat("label", F.lit(": "), F.col("n").cast("string"), F.lit(" rows")).alias("line")), out, "text")
    return spark.read.text(out).select(F.col("value").alias("line"))


@query("select vec_id, len(embedding) as n_dims, round(list_sum(list_transform(embedding, lambda x: x::double)), 6) as total from embeddings")
def vector_round_trip(spark, sf):
    """Feature matrices written as arrays and loaded again."""
    out = _path(spark, "vectors")
    readers.write(t(spark, sf, "embeddings").select("vec_id", "embedding"), out)
    e = spark.read.parquet(out)
    return e.select("vec_id", F.size("embedding").cast("bigint").alias("n_dims"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 6).alias("total"))


@query("select n, 'checked' as status from (select count(distinct path) as n from dataset where path is not null)")
def counted_files(spark, sf):
    """A folder of files counted by suffix, as on disk: one file per path is written and listed again."""
    out = _path(spark, "listing")
    names = t(spark, sf, "dataset").where("path is not null").select("path").distinct()
    readers.write(names, out, "text")
    return readers.count_lines(spark, out).select("n", F.lit("checked").alias("status"))


@query(f"with {CURATED}, b as (select label, count_if(dup_cluster is not null) as before, count(distinct dup_cluster) as clusters from c where label is not null group by label) select label, before::bigint as before, clusters, round_even(100.0 * (1 - clusters / before), 2) as removed_pct from b where before > 0")
def removed_half_even(spark, sf):
    """Shares removed by de-duplication, rounded half to even as the tables are."""
    b = v.curated(spark, sf).where("label is not null").groupBy("label").agg(F.count("dup_cluster").alias("before"), F.countDistinct("dup_cluster").alias("clusters")).where("before > 0")
    return b.withColumn("removed_pct", F.bround(100.0 * (1 - F.col("clusters") / F.col("before")), 2))
