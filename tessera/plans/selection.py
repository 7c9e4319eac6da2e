"""Queries that select, guard, look up and sample: configurations, integrity checks, group flags and samples."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import paths as px
from ..functions.hashing import norm_digest
from ..operators import duplicates as du
from ..operators import graph as gr
from ..operators import neighbours as ne
from ..operators import splitting as sp
from ..operators.evaluation import running, softmax
from ..operators.statistics import draw
from ..session import Staging
from ..sources import views as v
from ..sources.tables import table as t
from .base_sql import CURATED, DEC, FILES, LABELLED, PRED, RUNS
from .base_sql import D as _D
from .base_sql import P as _P
from .registry_tools import registry

QUERIES, SQL, query = registry()
_LF = f"with {LABELLED}"
def _n():
    return F.count(F.lit(1))



def _h(seed: int, *parts: str) -> str:
    return f"('0x' || substr(md5('{seed}' || " + " || ".join(f"':' || ({p})::varchar" for p in parts) + "), 1, 8))::bigint"


@query(f"""with {CURATED}, k as (select 'main' as config, label, grp, patient from c where label is not null union all select 'figshare_only', label, grp, patient from c where label is not null and patient is not null and label <> 'notumor')
select config, label, count(*) as n, count(distinct grp) as n_groups, count(distinct patient) as n_patients from k group by 1, 2""")
def config_selection(spark, sf):
    """The rows of each run configuration: all labelled ones, or those with a patient and a tumour class."""
    c = v.curated(spark, sf).where("label is not null")
    conf = F.array(F.lit("main"), F.when(F.col("patient").isNotNull() & (F.col("label") != "notumor"), "figshare_only"))
    k = c.select("label", "grp", "patient", F.explode(F.filter(conf, lambda x: x.isNotNull())).alias("config"))
    return k.groupBy("config", "label").agg(_n().alias("n"), F.countDistinct("grp").alias("n_groups"), F.countDistinct("patient").alias("n_patients"))


@query(f"with {CURATED}, s as (select label, source, count(*) as n from c where label is not null and source is not null group by 1, 2) select label, count(*) as n_sources, min(n) as smallest, case when count(*) < 2 then 'abort' when min(n) < 30 then 'warn' else 'ok' end as status from s group by label")
def source_guard(spark, sf):
    """Whether a class can be compared across sources: at least two, and the smallest with 30 rows."""
    s = v.curated(spark, sf).where("label is not null and source is not null").groupBy("label", "source").agg(_n().alias("n"))
    g = s.groupBy("label").agg(_n().alias("n_sources"), F.min("n").alias("smallest"))
    return g.withColumn("status", F.when(F.col("n_sources") < 2, "abort").when(F.col("smallest") < 30, "warn").otherwise("ok"))


@query(f"with {CURATED} select source, case when bool_and(patient is not null) then 'patient' else 'group' end as unit, count(*) as n, count_if(patient is null)::bigint as n_without from c group by source union all select 'ALL', case when bool_and(patient is not null) then 'patient' else 'group' end, count(*), count_if(patient is null)::bigint from c")
def unit_naming(spark, sf):
    """The resampling unit: patients if every row has one, groups otherwise."""
    named = F.col("patient").isNotNull()
    aggs = [F.when(F.bool_and(named), "patient").otherwise("group").alias("unit"), _n().alias("n"), F.count_if(~named).alias("n_without")]
    c = v.curated(spark, sf)
    return c.groupBy("source").agg(*aggs).unionByName(c.agg(*aggs).withColumn("source", F.lit("ALL")))


@query(f"""{_LF}, u as (select label, unit, count(distinct fold) as nf from l where label is not null group by 1, 2) select label, count(*) as n_units, case when count(*) >= 5 then 'ok' else 'abort' end as status from u group by label""")
def smallest_class_guard(spark, sf):
    """Every class needs at least as many units as there are folds."""
    u = v.labelled_folds(spark, sf).where("label is not null").select("label", "unit").distinct().groupBy("label").agg(_n().alias("n_units"))
    return u.withColumn("status", F.when(F.col("n_units") >= 5, "ok").otherwise("abort"))


@query(f"{_LF}, f as (select path, min(p) as p, min(d) as d from (select path, {_P} as p, {_D} as d from files_index where path is not null) group by path) select count(*) as n, count_if(f.path is null)::bigint as n_missing, count_if(f.path is not null and (f.p is null or f.d is null))::bigint as n_without_hash, case when count_if(f.path is null) = 0 then 'ok' else 'FAIL' end as status from l left join f using (path)")
def integrity_join(spark, sf):
    """Development rows joined with their hashes; a row without a partner fails the check."""
    from ..functions.hashing import parse_hash64

    f = t(spark, sf, "files_index").where("path is not null").select("path", parse_hash64("phash").alias("p"), parse_hash64("dhash").alias("d"))
    f = f.groupBy("path").agg(F.min("p").alias("p"), F.min("d").alias("d")).withColumn("found", F.lit(True))
    j = v.labelled_folds(spark, sf).select("path").join(f, "path", "left")
    lost = F.col("found").isNull()
    g = j.agg(_n().alias("n"), F.count_if(lost).alias("n_missing"), F.count_if(~lost & (F.col("p").isNull() | F.col("d").isNull())).alias("n_without_hash"))
    return g.withColumn("status", F.when(F.col("n_missing") == 0, "ok").otherwise("FAIL"))


@query(f"{_LF}, m as (select path, min(mask) as mask from c group by path) select label, count(*) as n_masked, count(distinct unit) as n_units from l join m using (path) where mask is not null group by label")
def masked_items(spark, sf):
    """Split files that have a mask; the others are dropped."""
    m = v.curated(spark, sf).where("mask is not null").select("path").distinct()
    return v.labelled_folds(spark, sf).join(m, "path").groupBy("label").agg(_n().alias("n_masked"), F.countDistinct("unit").alias("n_units"))


_INNER = f"o as (select l.path, l.label, k.k as outer_fold, {_h(1000, 'k.k', 'l.path')} as h from l, range(5) k(k) where l.fold <> k.k), inn as (select outer_fold::int as outer_fold, path, ((row_number() over (partition by outer_fold, label order by h, path) - 1) % 3)::int as inner_fold from o)"


def stored_inner(spark, sf):
    """Inner folds as a stored table (outer_fold, path, inner_fold), dealt once."""
    base = v.labelled_folds(spark, sf).select("path", "label", "fold").withColumn("outer_fold", F.explode(F.array(*map(F.lit, range(5))))).where("fold <> outer_fold")
    w = Window.partitionBy("outer_fold", "label").orderBy(draw(F.lit(1000), "outer_fold", "path"), "path")
    return Staging(spark, "inner").keep(base.select("outer_fold", "path", ((F.row_number().over(w) - 1) % 3).cast("int").alias("inner_fold")))


@query(f"{_LF}, {_INNER}, q as (select l.path, k.k::int as outer_fold, l.fold <> k.k as is_dev from l, range(5) k(k)) select outer_fold, count_if(is_dev)::bigint as n_dev, count_if(is_dev and inner_fold is null)::bigint as n_missing, count_if(inner_fold = 0)::bigint as n_stop, count_if(not is_dev and inner_fold is not null)::bigint as n_overlap from q left join inn using (outer_fold, path) group by 1")
def inner_fold_lookup(spark, sf):
    """Stored inner folds looked up per outer fold: rows without one and test rows that have one must be 0."""
    q = v.labelled_folds(spark, sf).select("path", "fold", F.explode(F.array(*map(F.lit, range(5)))).alias("outer_fold"))
    j = q.join(stored_inner(spark, sf), ["outer_fold", "path"], "left")
    dev, has = F.col("fold") != F.col("outer_fold"), F.col("inner_fold").isNotNull()
    return j.groupBy("outer_fold").agg(F.count_if(dev).alias("n_dev"), F.count_if(dev & ~has).alias("n_missing"), F.count_if(F.col("inner_fold") == 0).alias("n_stop"), F.count_if(~dev & has).alias("n_overlap"))


_EXT = f"qh as (select path, min(p) as p, min(d) as d from (select path, {_P} as p, {_D} as d from bdneuro_v7_manifest where path is not null) where p is not null and d is not null group by path)"
_ONE = "one as (select path, min(lower(trim(label))) as label, min(nullif(lower(trim(group_id)), '')) as grp from bdneuro_v7_manifest where path is not null group by path)"
_NEAR = f"{FILES}, {_EXT}, pool as (select p, d, min(file_id) as rep from f where p is not null and d is not null group by p, d), hit as (select distinct qh.path from qh, pool where bit_count(xor(qh.p, pool.p)) <= 4 and bit_count(xor(qh.d, pool.d)) <= 4)"


def _items(spark, sf):
    m = t(spark, sf, "bdneuro_v7_manifest").where("path is not null").select("path", F.lower(F.trim("label")).alias("label"), F.nullif(F.lower(F.trim("group_id")), F.lit("")).alias("grp"))
    return m.groupBy("path").agg(F.min("label").alias("label"), F.min("grp").alias("grp"))


def _hits(spark, sf):
    return ne.within(v.external(spark, sf), "path", ne.hash_classes(v.files(spark, sf, "p", "d")), 4).select("path").distinct().withColumn("hit", F.lit(True))


@query(f"with {_NEAR}, {_ONE}, j as (select one.*, (hit.path is not null) as hit, bool_or(hit.path is not null) over (partition by coalesce(one.grp, one.path)) as group_hit from one left join hit using (path)) select label, count(*) as distributed, count_if(hit)::bigint as matched, count_if(not group_hit)::bigint as retained, round(100.0 * count_if(not group_hit) / count(*), 4) as retained_pct from j group by label")
def group_flags(spark, sf):
    """External items per label that remain when a whole group goes with any of its matched items."""
    j = Staging(spark, "flags").keep(_items(spark, sf).join(_hits(spark, sf), "path", "left").select("path", "label", F.coalesce("grp", "path").alias("unit"), F.coalesce("hit", F.lit(False)).alias("hit")))
    flags = j.where("hit").select("unit").distinct().withColumn("group_hit", F.lit(True))
    g = j.join(flags, "unit", "left").groupBy("label").agg(_n().alias("distributed"), F.count_if("hit").alias("matched"), F.count_if(F.col("group_hit").isNull()).alias("retained"))
    return g.withColumn("retained_pct", F.round(100.0 * F.col("retained") / F.col("distributed"), 4))


@query(f"with {RUNS}, k as (select run_id, map_keys(models) as names from m), e as (select run_id, names, generate_subscripts(names, 1) as i from k) select a.run_id, a.names[a.i] as model_a, a.names[b.i] as model_b, (a.i - 1)::int as i, (b.i - 1)::int as j from e a join e b on a.run_id = b.run_id and a.i < b.i")
def model_pairs(spark, sf):
    """All pairs of models of a run, in the order they are listed."""
    pairs = F.expr("flatten(transform(names, (a, i) -> transform(filter(transform(names, (b, j) -> struct(b as model_b, j as j)), x -> x.j > i), y -> struct(a as model_a, y.model_b as model_b, cast(i as int) as i, cast(y.j as int) as j))))")
    return v.runs(spark, sf).select("run_id", F.map_keys("models").alias("names")).select("run_id", F.inline(pairs))


@query(f"{_LF} select a.fold, a.source, b.label from (select distinct fold, source from l) a cross join (select distinct label from l where label is not null) b except select fold, source, label from l")
def absent_classes(spark, sf):
    """Classes of which a source has no file in a fold."""
    c = v.labelled_folds(spark, sf).select("fold", "source", "label").distinct()
    # folds, a few dozen sources and the classes: both sides are distinct values of small domains
    grid = c.select("fold", "source").distinct().join(c.select("label").where("label is not null").distinct())
    return grid.exceptAll(c)


@query(f"with {RUNS}, b as (select coalesce(base_config, replace(config, '_imagelevel', '')) as base, list_sort(list(distinct split_mode) filter (split_mode is not null)) as modes from m where config is not null group by 1) select base, array_to_string(modes, ' + ') as modes, (list_contains(modes, 'grouped') and list_contains(modes, 'image')) as complete from b")
def has_modes(spark, sf):
    """Whether a base configuration was run in both split modes."""
    base = F.coalesce("base_config", F.replace("config", F.lit("_imagelevel"), F.lit("")))
    b = v.runs(spark, sf).where("config is not null").groupBy(base.alias("base")).agg(F.array_sort(F.collect_set("split_mode")).alias("modes"))
    need = F.array(F.lit("grouped"), F.lit("image"))
    return b.select("base", F.array_join("modes", " + ").alias("modes"), (F.size(F.array_except(need, "modes")) == 0).alias("complete"))


@query(f"{_LF}, g as (select a.fold, b.label from (select distinct fold from l) a cross join (select distinct label from l where label is not null) b) select g.fold, g.label, count(l.path) as images, count(distinct l.unit) as units, round(count(l.path) / nullif(count(distinct l.unit), 0), 6) as ratio from g left join l on l.fold = g.fold and l.label = g.label group by 1, 2")
def fold_class_counts(spark, sf):
    """Images, units and their ratio for every fold and class, also where a fold has none."""
    f = v.labelled_folds(spark, sf)
    grid = f.select("fold").distinct().join(f.select("label").where("label is not null").distinct())
    n = f.groupBy("fold", "label").agg(_n().alias("images"), F.countDistinct("unit").alias("units"))
    j = grid.join(n, ["fold", "label"], "left").na.fill(0, ["images", "units"])
    return j.withColumn("ratio", F.round(F.try_divide("images", "units"), 6))


@query(f"with {FILES} select sha, count(*) as n_files, count(distinct source) as n_sources from f where sha is not null group by sha having count(distinct source) > 1")
def dup_cross_source(spark, sf):
    return v.files(spark, sf, "sha", "source").where("sha is not null").groupBy("sha").agg(_n().alias("n_files"), F.countDistinct("source").alias("n_sources")).where("n_sources > 1")


@query(f"{_LF} select fold, label, path, pos::int as pos from (select fold, label, path, row_number() over (partition by fold, label order by {_h(42, 'path')}, path) as pos from l) where pos <= 5")
def stratified_fold_sample(spark, sf):
    """Five files of each fold and class without replacement, in a seeded order."""
    w = Window.partitionBy("fold", "label").orderBy(draw(F.lit(42), "path"), "path")
    return v.labelled_folds(spark, sf).select("fold", "label", "path", F.row_number().over(w).alias("pos")).where("pos <= 5")


@query(f"with {_NEAR} select path from hit order by {_h(7, 'path')}, path limit 40")
def matched_sample(spark, sf):
    """Forty matched external items in a seeded random order."""
    return _hits(spark, sf).select("path").orderBy(draw(F.lit(7), "path"), "path").limit(40)


@query(f"with {CURATED} select dup_cluster, count(*) as n, count(distinct source) as n_sources, min(path) as first_path from c where dup_cluster is not null group by 1 order by n desc, dup_cluster limit 12")
def largest_clusters(spark, sf):
    """The dozen largest duplicate clusters, for inspection."""
    g = v.curated(spark, sf).where("dup_cluster is not null").groupBy("dup_cluster").agg(_n().alias("n"), F.countDistinct("source").alias("n_sources"), F.min("path").alias("first_path"))
    return g.orderBy(F.desc("n"), "dup_cluster").limit(12)


@query(f"""with recursive {_EXT}, h as (select p, d, min(path) as rep from qh group by p, d), e as (select a.rep as a, b.rep as b from h a join h b on a.rep <> b.rep and bit_count(xor(a.p, b.p)) <= 4 and bit_count(xor(a.d, b.d)) <= 4),
r(node, seen) as (select rep, rep from h union select r.node, e.b from r join e on r.seen = e.a), k as (select node as rep, min(seen) as c from r group by node), g as (select qh.path, k.c from qh join h using (p, d) join k using (rep)),
n as (select c, row_number() over (order by c) - 1 as i from (select distinct c from g)) select g.path, 'ext_g' || lpad(n.i::varchar, 5, '0') as group_name, g.c as first_path from g join n using (c)""")
def external_groups(spark, sf):
    """Near-duplicate groups of the external release, numbered by their first path as ext_g00000 and so on."""
    ext = v.external(spark, sf)
    h = Staging(spark, "external").keep(ext.groupBy("p", "d").agg(F.min("path").alias("rep")))
    comp = gr.components(ne.banded_pairs(h, 4).select("a", "b"))
    k = h.join(comp, h["rep"] == comp["node"], "left").select("p", "d", F.coalesce("component", "rep").alias("first_path"))
    named = running(k.select("first_path").distinct(), [F.col("first_path")], {}).select("first_path", F.format_string("ext_g%05d", (F.col("pos") - 1).cast("bigint")).alias("group_name"))
    return ext.join(k, ["p", "d"]).join(named, "first_path").select("path", "group_name", "first_path")


@query("select path, case when list_has_any(string_split(lower(path), '/')[:-2], ['train', 'training']) then 'train' when list_has_any(string_split(lower(path), '/')[:-2], ['val', 'valid', 'validation']) then 'val' when list_has_any(string_split(lower(path), '/')[:-2], ['test', 'testing']) then 'test' else 'unassigned' end as split from (select distinct path from bdneuro_v7_manifest where path is not null)")
def split_inference(spark, sf):
    """The split any folder of a path names, training before the others."""
    return t(spark, sf, "bdneuro_v7_manifest").where("path is not null").select("path").distinct().select("path", px.split_any(F.col("path")).alias("split"))


@query(f"with {FILES} select doc_id, md5(text) as md5, sha256(text) as sha, n > 1 as repeated from (select doc_id, text, count(*) over (partition by md5(text)) as n from documents where text is not null)".replace(f"with {FILES} ", ""))
def content_digests(spark, sf):
    """MD5 and SHA-256 of whole texts, and whether the MD5 occurs again."""
    d = t(spark, sf, "documents").where("text is not null").select("doc_id", F.md5(F.encode("text", "UTF-8")).alias("md5"), F.sha2(F.encode("text", "UTF-8"), 256).alias("sha"))
    return du.flag_repeats(d, ["md5"]).withColumnRenamed("is_repeated", "repeated")


@query("select label as code, case label when 1 then 'meningioma' when 2 then 'glioma' when 3 then 'pituitary' else 'unknown' end as class, count(*) as n from embeddings group by 1, 2")
def label_decode(spark, sf):
    """Numeric class codes by their names, unknown for any other code."""
    names = F.create_map(*[F.lit(x) for kv in {1: "meningioma", 2: "glioma", 3: "pituitary"}.items() for x in kv])
    return t(spark, sf, "embeddings").groupBy(F.col("label").alias("code"), F.coalesce(names[F.col("label").cast("int")], F.lit("unknown")).alias("class")).agg(_n().alias("n"))


@query(f"with {CURATED} select distinct patient, 'PID_' || upper(patient) as tag from c where patient is not null")
def codepoint_text(spark, sf):
    """Identifiers read from lists of code points, as in matrix files, with a prefix."""
    p = v.curated(spark, sf).where("patient is not null").select("patient").distinct()
    points = p.select("patient", F.transform(F.split(F.upper("patient"), ""), lambda c: F.ascii(c)).alias("points"))
    return points.select("patient", px.from_codepoints(F.col("points"), "PID_").alias("tag"))


_SOFT = f"with {PRED}, x as (select *, wa / 10.0 as a, wn / 10.0 as n, wr / 10.0 as r from w), y as (select *, greatest(a, n, r) as g from x), z as (select *, exp(a - g) + exp(n - g) + exp(r - g) as z from y), s as (select item, wa, wn, wr, exp(a - g) / z as sa, exp(n - g) / z as sn, exp(r - g) / z as sr from z)"


@query(_SOFT + ' select item, round(sa, 6) as "A", round(sn, 6) as "N", round(sr, 6) as "R" from s')
def softmax_scores(spark, sf):
    """Logits to probabilities, shifted by the largest."""
    s = v.logits(spark, sf).select("item", softmax(F.array(*[F.col(k) / 10 for k in "ANR"])).alias("s"))
    return s.select("item", *[F.round(F.get("s", F.lit(i)), 6).alias(k) for i, k in enumerate("ANR")])


@query(_SOFT + ", b as (select item, [round((wa / (wa + wn + wr) + sa) / 2, 9), round((wn / (wa + wn + wr) + sn) / 2, 9), round((wr / (wa + wn + wr) + sr) / 2, 9)] as q from s) select item, case when q[1] >= q[2] and q[1] >= q[3] then 'A' when q[2] >= q[3] then 'N' else 'R' end as pred, round(list_max(q), 6) as conf from b")
def ensemble_posterior(spark, sf):
    """The mean posterior of two models per item, and its best label; ties go to the first."""
    w = v.logits(spark, sf).select("item", F.array(*[F.col(k) / F.col("total") for k in "ANR"]).alias("p"), softmax(F.array(*[F.col(k) / 10 for k in "ANR"])).alias("s"))
    q = w.select("item", F.zip_with("p", "s", lambda a, b: F.round((a + b) / 2, 9)).alias("q"))
    return q.select("item", F.get(F.array(*map(F.lit, "ANR")), (F.array_position("q", F.array_max("q")) - 1).cast("int")).alias("pred"), F.round(F.array_max("q"), 6).alias("conf"))


@query("with e as (select vec_id, unnest(embedding)::double as x, generate_subscripts(embedding, 1) - 1 as dim from embeddings) select count(*) as n_dims, count_if(s = 0)::bigint as n_constant, round(min(s), 6) as smallest, round(max(s), 6) as largest from (select dim, stddev_pop(x) as s from e group by dim)")
def zero_variance_dims(spark, sf):
    """Dimensions of the vectors that never vary, by population deviation."""
    e = t(spark, sf, "embeddings").select(F.posexplode("embedding").alias("dim", "x")).groupBy("dim").agg(F.stddev_pop(F.col("x").cast("double")).alias("s"))
    return e.agg(_n().alias("n_dims"), F.count_if(F.col("s") == 0).alias("n_constant"), F.round(F.min("s"), 6).alias("smallest"), F.round(F.max("s"), 6).alias("largest"))


@query(f"with {PRED} select 'prob_' || label as column_name, label as suffix, count(*) as n, round(avg(prob), 6) as mean_prob from pr group by label")
def wide_to_long(spark, sf):
    """Score columns prob_<label> of a wide table turned into rows by their suffix."""
    wide = v.wide_predictions(spark, sf)
    cols = [c for c in wide.columns if c.startswith("prob_")]
    long = wide.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("prob")) for c in cols])))
    return long.groupBy("column_name", F.substring_index("column_name", "_", -1).alias("suffix")).agg(_n().alias("n"), F.round(F.avg("prob"), 6).alias("mean_prob"))


@query("""with r as (select * from metrics_raw where file_no is not null and json_valid(payload) qualify row_number() over (partition by file_no order by loaded_at desc nulls last, payload desc) = 1)
select file_no, p.path, json_extract_string(payload, p.path) as value, case when json_extract_string(payload, p.path) is null then 'SKIP' else 'ok' end as status from r, (values ('$.run_id'), ('$.config'), ('$.bootstrap_unit')) p(path)""")
def json_paths(spark, sf):
    """Single values read from documents by path; what is missing is skipped, not an error."""
    from ..sources.current import latest_rows

    r = latest_rows(t(spark, sf, "metrics_raw"), "file_no", ("loaded_at",), {"payload": F.col("payload")})
    cells = F.array(*[F.struct(F.lit(p).alias("path"), F.get_json_object("payload", p).alias("value")) for p in ("$.run_id", "$.config", "$.bootstrap_unit")])
    return r.select("file_no", F.inline(cells)).withColumn("status", F.when(F.col("value").isNull(), "SKIP").otherwise("ok"))


@query(f"""with {RUNS}, e as (select run_id, unnest(map_entries(models)) as e from m), k as (select run_id, e.key as model, e.value.point as pt, e.value.ci95 as ci from e), q as (select k.*, x.metric from k, (values ('accuracy'), ('balanced_accuracy'), ('brier'), ('nosuch')) x(metric))
select run_id, model, metric, pt[metric] as value, ci[metric][1] as lo, ci[metric][2] as hi, case when pt[metric] is null then 'Missing' else 'ok' end as status from q""")
def metric_lookup(spark, sf):
    """Values and bounds by run, model and metric; what a run does not hold is marked missing."""
    k = v.runs(spark, sf).select("run_id", F.explode("models").alias("model", "e")).select("run_id", "model", F.col("e.point").alias("pt"), F.col("e.ci95").alias("ci"), F.explode(F.array(*map(F.lit, ("accuracy", "balanced_accuracy", "brier", "nosuch")))).alias("metric"))
    at = lambda m: F.try_element_at(F.col(m), F.col("metric"))
    return k.select("run_id", "model", "metric", at("pt").alias("value"), F.get(at("ci"), F.lit(0)).alias("lo"), F.get(at("ci"), F.lit(1)).alias("hi"), F.when(at("pt").isNull(), "Missing").otherwise("ok").alias("status"))


@query(f"with {DEC}, lv as (select 'image' as level, conf, correct, item as k from dc union all select 'group', avg(conf), max(correct), grp from dc group by grp) select level, count(*) as n, round(avg(conf), 6) as mean_conf from lv where level <> 'image' group by level")
def level_by_exclusion(spark, sf):
    """Rows of the level that is not the image level, whatever it is called."""
    d = v.decisions(spark, sf)
    lv = d.select(F.lit("image").alias("level"), "conf").unionByName(d.groupBy("grp").agg(F.avg("conf").alias("conf")).select(F.lit("group").alias("level"), "conf"))
    return lv.where("level <> 'image'").groupBy("level").agg(_n().alias("n"), F.round(F.avg("conf"), 6).alias("mean_conf"))


@query(f"{_LF} select unit, count(*) as n, count(distinct fold) as n_folds, case when count(distinct fold) > 1 then 'FAIL' else 'ok' end as status from l group by unit having count(distinct fold) > 1")
def stored_split_recheck(spark, sf):
    """A stored split checked again without stopping: the units it tears."""
    s = sp.spanning(v.labelled_folds(spark, sf), "unit", "fold")
    return s.select("unit", "n", "n_folds", F.lit("FAIL").alias("status"))


@query(f"with {CURATED} select label, sha_n as n_contents, n from (select label, count(*) as n, count(distinct path) as sha_n from c where label is not null and mask is not null group by label)")
def rows_by_expression(spark, sf):
    """Rows selected by a string expression with a parameter."""
    wanted = "mask is not null"
    return v.curated(spark, sf).where(f"label is not null and {wanted}").groupBy("label").agg(_n().alias("n"), F.countDistinct("path").alias("n_contents"))


@query("select nullif(lower(trim(sha256)), '') as sha, count(distinct path) as n_paths from bdneuro_v7_manifest where path is not null and nullif(lower(trim(sha256)), '') in (select nullif(lower(trim(sha256)), '') from files_index) group by 1")
def byte_identical_external(spark, sf):
    """Contents of the external release that also stand in the index."""
    m = t(spark, sf, "bdneuro_v7_manifest").where("path is not null").select("path", norm_digest("sha256").alias("sha")).where("sha is not null")
    known = t(spark, sf, "files_index").select(norm_digest("sha256").alias("sha")).where("sha is not null").distinct()
    return m.join(known, "sha", "left_semi").groupBy("sha").agg(F.countDistinct("path").alias("n_paths"))
