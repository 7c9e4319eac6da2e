"""Queries on indexing, duplicates, curation and matching."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import paths as px
from ..functions.hashing import norm_digest
from ..operators import curation as cu
from ..operators import duplicates as du
from ..operators import neighbours as ne
from ..session import Staging
from ..sources import views as v
from ..sources.tables import table as t
from .base_sql import CURATED, FILES, FOLDS

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


LABELS = ("glioma", "meningioma", "notumor", "pituitary")
_GROUPS = f"""with {FILES}, g as (select sha, count(*) as n_files, array_to_string(list_sort(list_distinct(list(source) filter (source is not null))), ' + ') as sources, count(distinct source) as n_sources,
 array_to_string(list_sort(list_distinct(list(class) filter (class is not null))), ' + ') as classes, count(distinct class) > 1 as class_conflict from f where sha is not null group by sha having count(*) > 1)"""


@query(_GROUPS + " select * from g")
def dup_exact_groups(spark, sf):
    return du.exact_groups(v.files(spark, sf, "sha", "source", "class"), "sha", "source", "class")


@query(_GROUPS + " select sources, count(*) as n_groups, sum(n_files)::bigint as n_files from g where n_sources > 1 group by 1")
def dup_source_combos(spark, sf):
    g = du.exact_groups(v.files(spark, sf, "sha", "source", "class"), "sha", "source", "class").where("n_sources > 1")
    return g.groupBy("sources").agg(F.count(F.lit(1)).alias("n_groups"), F.sum("n_files").alias("n_files"))


@query(_GROUPS + " select * from g where class_conflict")
def dup_label_conflicts(spark, sf):
    return du.exact_groups(v.files(spark, sf, "sha", "source", "class"), "sha", "source", "class").where("class_conflict")


@query(f"with {FILES} select source, n, n_unique, round(1 - n_unique / n, 6) as redundant_share from (select source, count(*) as n, count(distinct sha) + count_if(sha is null)::bigint as n_unique from f group by source)")
def source_redundancy(spark, sf):
    return du.redundancy(v.files(spark, sf, "source", "sha"), ["source"], "sha")


@query(f"with {FILES}, k as (select distinct sha, source from f where sha is not null and source is not null) select a.source as source_a, b.source as source_b, count(*) as n_shared from k a join k b on a.sha = b.sha and a.source < b.source group by 1, 2")
def source_overlap_exact(spark, sf):
    return du.shared_between(v.files(spark, sf, "source", "sha"), "sha", "source")


@query(f"with {FILES} select file_id, sha, coalesce(count(*) over (partition by sha) > 1 and sha is not null, false) as is_repeated from f")
def dup_flags(spark, sf):
    return du.flag_repeats(v.files(spark, sf, "sha"), ["sha"])


@query(f"with {CURATED} select source, " + ", ".join(f"count_if(label = '{x}')::bigint as {x}" for x in LABELS) + " from c group by source")
def class_by_source_crosstab(spark, sf):
    return du.crosstab(v.curated(spark, sf), "source", "label", LABELS)


@query(f"with {CURATED} select source, label, grouping(source, label)::int as level, count(*) as n from c group by cube(source, label)")
def crosstab_margins(spark, sf):
    return du.crosstab_margins(v.curated(spark, sf), "source", "label")


@query(f"with {FILES} select source, dims, n, rank from (select *, row_number() over (partition by source order by n desc, dims) as rank from (select source, width || 'x' || height as dims, count(*) as n from f where width is not null and height is not null group by 1, 2)) where rank <= 4")
def top_sizes_per_source(spark, sf):
    return du.top_sizes(v.files(spark, sf, "source", "width", "height"), "source")


@query(f"with {FILES} select case when source in ('slicebank', 'northset') then 'reference' when source like 'mirror%' then 'mirror' else 'other' end as pool, count(*) as n_files, count(distinct sha) as n_contents, sum(bytes)::bigint as total_bytes from f group by 1")
def pool_sizes(spark, sf):
    pool = F.when(F.col("source").isin("slicebank", "northset"), "reference").when(F.col("source").startswith("mirror"), "mirror").otherwise("other")
    return v.files(spark, sf, "source", "sha", "bytes").groupBy(pool.alias("pool")).agg(F.count(F.lit(1)).alias("n_files"), F.countDistinct("sha").alias("n_contents"), F.sum("bytes").alias("total_bytes"))


@query(f"""with {FILES}, r(src, cls) as (values ('slicebank', 'glioma'), ('slicebank', 'meningioma'), ('slicebank', 'pituitary'), ('northset', 'notumor'), ('brightset', 'notumor'))
select f.source, f.class, (r.src is not null) as included, count(*) as n from f left join r on f.source = r.src and f.class = r.cls group by 1, 2, 3""")
def curation_rules(spark, sf):
    rules = [("slicebank", "glioma"), ("slicebank", "meningioma"), ("slicebank", "pituitary"), ("northset", "notumor"), ("brightset", "notumor")]
    return cu.apply_rules(v.files(spark, sf, "source", "class"), rules).groupBy("source", "class", "included").agg(F.count(F.lit(1)).alias("n"))


@query(
    """with a as (select distinct path, string_split(lower(path), '/') as parts from bdneuro_v7_manifest where path is not null),
b as (select path, list_reverse(list_transform(parts[:-2], lambda x: replace(replace(trim(regexp_replace(x, '^\\d+[_\\-]?', '')), ' ', '_'), '-', '_'))) as up, parts[:-2] as dirs from a)
select path, coalesce(case list_filter(up, lambda x: x in ('glioma', 'brain_glioma', 'meningioma', 'brain_menin', 'pituitary', 'pituitary_macroadenoma', 'healthy', 'brain_normal', 'notumor'))[1]
 when 'glioma' then 'glioma' when 'brain_glioma' then 'glioma' when 'meningioma' then 'meningioma' when 'brain_menin' then 'meningioma'
 when 'pituitary' then 'pituitary' when 'pituitary_macroadenoma' then 'pituitary' when 'healthy' then 'notumor' when 'brain_normal' then 'notumor' when 'notumor' then 'notumor' end, 'unknown') as class,
 coalesce(case list_filter(dirs, lambda x: x in ('train', 'training', 'val', 'valid', 'validation', 'test', 'testing'))[1] when 'train' then 'train' when 'training' then 'train' when 'val' then 'val' when 'valid' then 'val' when 'validation' then 'val' when 'test' then 'test' when 'testing' then 'test' end, 'unassigned') as split,
 regexp_extract(path, '([^/]+)/[^/]*$', 1) as parent, regexp_extract(path, '([^/]+)\\.[^./]*$', 1) as stem from b"""
)
def path_normalise(spark, sf):
    p = F.col("path")
    return t(spark, sf, "bdneuro_v7_manifest").where("path is not null").select("path").distinct().select("path", px.class_of(p).alias("class"), px.split_of(p).alias("split"), px.parent(p).alias("parent"), px.stem(p).alias("stem"))


@query("""with a as (select distinct path, string_split(lower(path), '/')[:-2] as dirs, regexp_extract(path, '([^/]+)/[^/]*$', 1) as parent from bdneuro_v7_manifest where path is not null),
u as (select parent from a where not list_has_any(list_transform(dirs, lambda x: replace(replace(trim(regexp_replace(x, '^\\d+[_\\-]?', '')), ' ', '_'), '-', '_')), ['glioma', 'brain_glioma', 'meningioma', 'brain_menin', 'pituitary', 'pituitary_macroadenoma', 'healthy', 'brain_normal', 'notumor']))
select (select count(*) from u) as n_unmapped, (select count(*) from a) as n_paths, coalesce(array_to_string((select list_sort(list(distinct parent))[1:10] from u), ' | '), '') as folders""")
def unmapped_folders(spark, sf):
    """Paths none of whose folders names a class, with the first ten of their folders."""
    m = t(spark, sf, "bdneuro_v7_manifest").where("path is not null").select("path").distinct()
    lost = px.class_of(F.col("path")) == "unknown"
    folders = F.array_join(F.slice(F.sort_array(F.collect_set(F.when(lost, px.parent(F.col("path"))))), 1, 10), " | ")  # folder names, not paths
    return m.agg(F.count_if(lost).alias("n_unmapped"), F.count(F.lit(1)).alias("n_paths"), folders.alias("folders"))


_HC = f"{FILES}, h as (select p, d, min(file_id) as rep, count(*) as n from f where p is not null and d is not null group by p, d)"


@query(f"with {_HC} select a.rep as a, b.rep as b, bit_count(xor(a.p, b.p))::int as dist_p, bit_count(xor(a.d, b.d))::int as dist_d from h a join h b on a.rep < b.rep and bit_count(xor(a.p, b.p)) <= 2 and bit_count(xor(a.d, b.d)) <= 2")
def hamming_pairs_banded(spark, sf):
    return ne.banded_pairs(ne.hash_classes(v.files(spark, sf, "p", "d")), 2)


@query(f"with {_HC} select greatest(bit_count(xor(a.p, b.p)), bit_count(xor(a.d, b.d)))::int as distance, count(*) as n from h a join h b on a.rep < b.rep and bit_count(xor(a.p, b.p)) <= 4 and bit_count(xor(a.d, b.d)) <= 4 group by 1")
def match_histogram(spark, sf):
    pairs = ne.banded_pairs(ne.hash_classes(v.files(spark, sf, "p", "d")), 4)
    return pairs.groupBy(F.greatest("dist_p", "dist_d").alias("distance")).agg(F.count(F.lit(1)).alias("n"))


_POOL = f"""{FILES}, q as (select distinct path, {{P}} as p, {{D}} as d from bdneuro_v7_manifest where path is not null), pool as (select p, d, min(file_id) as rep from f where p is not null and d is not null group by p, d),
qh as (select path, min(p) as p, min(d) as d from q where p is not null and d is not null group by path),
near as (select qh.path, pool.rep, bit_count(xor(qh.p, pool.p))::int as dp, greatest(bit_count(xor(qh.p, pool.p)), bit_count(xor(qh.d, pool.d)))::int as dist from qh cross join pool),
rk as (select *, row_number() over (partition by path order by dist, rep) as r, row_number() over (partition by path order by dp, rep) as rp from near)"""
from .base_sql import D as _D  # noqa: E402
from .base_sql import P as _P  # noqa: E402

_POOL = _POOL.replace("{P}", _P).replace("{D}", _D)


def _members(files, classes, *cols):
    """(rep, *cols, n): what the files of each hash class have in these columns, and how many of them."""
    return files.join(classes.select("p", "d", "rep"), ["p", "d"]).groupBy("rep", *cols).agg(F.count(F.lit(1)).alias("n"))


@query(f"with {_POOL} select path, rep as match_id, dist as distance from rk where r = 1")
def nearest_neighbour(spark, sf):
    return ne.nearest(v.external(spark, sf), "path", ne.hash_classes(v.files(spark, sf, "p", "d"))).select("path", "match_id", "distance")


@query(f"with {_POOL} select a.path, a.rep as best_id, a.dp as best_distance, b.dp as runner_up_distance, b.dp - a.dp as margin from rk a left join rk b on a.path = b.path and b.rp = 2 where a.rp = 1")
def best_two_match(spark, sf):
    """Best and second match by the first hash alone, at any distance."""
    return ne.best_two(v.external(spark, sf), "path", ne.hash_classes(v.files(spark, sf, "p", "d")))


#: Scope of a pool file by its source: what was trained on, what stands in source repositories, and both together.
_SCOPES = "case when f.source = 'slicebank' then ['trained', 'composite'] when f.source like 'mirror%' then ['sources', 'composite'] else ['composite'] end"


def _scopes():
    return F.when(F.col("source") == "slicebank", F.array(F.lit("trained"), F.lit("composite"))).when(F.col("source").startswith("mirror"), F.array(F.lit("sources"), F.lit("composite"))).otherwise(F.array(F.lit("composite")))


_SC = f"""{_POOL}, held as (select distinct pool.rep, unnest({_SCOPES}) as scope from pool join f using (p, d)),
sn as (select held.scope, near.path, min(near.dist) as dist from near join held using (rep) group by 1, 2)"""


SCOPES = ("trained", "sources", "composite")


def scope_distances(spark, sf, scopes=SCOPES, far=None):
    """(path, scope, distance): the nearest pool class of each external item in each scope, at any distance.

    A class counts for every source that holds a copy with its hashes. Distances from ``far`` on are given as ``far``.
    """
    held = [F.bool_or(F.array_contains(_scopes(), s)).cast("int") * (1 << i) for i, s in enumerate(scopes)]
    classes = v.files(spark, sf, "p", "d", "source").where("p is not null and d is not null").groupBy("p", "d").agg(sum(held, F.lit(0)).alias("held"))
    return ne.nearest_by_set(v.external(spark, sf), "path", classes.where("held <> 0"), scopes, far).withColumnRenamed("set", "scope")


#: Limits at which the nearest distances of a scope are looked for, until an item is below one; None is none.
_FAR = (5, 12, None)


def _near_or_least(spark, sf, staging):
    """(path, scope, distance): exact up to 4; in a scope where no item is as near, exact as far as its least distance."""
    todo, out = list(SCOPES), None
    for far in _FAR:
        found = staging.keep(scope_distances(spark, sf, todo, far))
        least = {r["scope"]: r["least"] for r in found.groupBy("scope").agg(F.min("distance").alias("least")).collect()}
        done = [s for s in todo if s not in least or far is None or least[s] < far]
        part = found.where(F.col("scope").isin(done))
        out = part if out is None else out.unionByName(part)
        todo = [s for s in todo if s not in done]
        if not todo:
            break
    return out


@query(f"""with {_SC}, m as (select distinct path, nullif(lower(trim(sha256)), '') as sha, nullif(lower(trim(group_id)), '') as grp from bdneuro_v7_manifest where path is not null), one as (select path, min(sha) as sha, min(grp) as grp from m group by path),
fs as (select distinct sha, unnest({_SCOPES}) as scope from f where sha is not null),
j as (select s.scope, one.path, one.grp, sn.dist, (fs.sha is not null) as same, coalesce(sn.dist <= 4, false) as hit from (values ('trained'), ('sources'), ('composite')) s(scope) cross join one left join sn on sn.path = one.path and sn.scope = s.scope left join fs on fs.sha = one.sha and fs.scope = s.scope),
g as (select scope, grp, bool_or(hit) as hit from j where grp is not null group by 1, 2)
select scope, count(*) as n_items, count_if(same)::bigint as byte_identical, count_if(hit)::bigint as n_matched, round(count_if(hit) / count(*), 6) as image_rate, min(gc) as groups_contaminated, round(min(gc) / min(gn), 6) as group_rate, min(dist) as min_distance
from j join (select scope, count_if(hit)::bigint as gc, count(*) as gn from g group by 1) q using (scope) group by scope""")
def scopes_overlap_report(spark, sf):
    """Overlap of the external release with each scope: equal bytes, near images, groups with a near image, nearest distance."""
    files = v.files(spark, sf, "sha", "source")
    m = t(spark, sf, "bdneuro_v7_manifest").where("path is not null").select("path", norm_digest("sha256").alias("sha"), F.nullif(F.lower(F.trim("group_id")), F.lit("")).alias("grp"))
    one = m.groupBy("path").agg(F.min("sha").alias("sha"), F.min("grp").alias("grp"))
    fs = files.where("sha is not null").select("sha", F.explode(_scopes()).alias("scope")).distinct().withColumn("same", F.lit(True))
    items = one.withColumn("scope", F.explode(F.array(F.lit("trained"), F.lit("sources"), F.lit("composite"))))
    staging = Staging(spark, "overlap_report")
    j = items.join(_near_or_least(spark, sf, staging).hint("merge"), ["path", "scope"], "left").join(fs, ["sha", "scope"], "left").withColumn("hit", F.coalesce(F.col("distance") <= 4, F.lit(False)))
    j = staging.keep(j)
    n = F.count(F.lit(1))
    g = j.where("grp is not null").groupBy("scope", "grp").agg(F.bool_or("hit").alias("hit")).groupBy("scope").agg(F.count_if("hit").alias("groups_contaminated"), F.round(F.count_if("hit") / n, 6).alias("group_rate"))
    r = j.groupBy("scope").agg(n.alias("n_items"), F.count_if(F.coalesce("same", F.lit(False))).alias("byte_identical"), F.count_if("hit").alias("n_matched"), F.round(F.count_if("hit") / n, 6).alias("image_rate"), F.min("distance").alias("min_distance"))
    return r.join(g, "scope", "left").select("scope", "n_items", "byte_identical", "n_matched", "image_rate", "groups_contaminated", "group_rate", "min_distance")


@query(f"""with {_SC}, w as (select q.path, max(dist) filter (where scope = 'trained') as t, max(dist) filter (where scope = 'sources') as s from (select distinct path from q) q left join sn using (path) group by 1),
st as (select path, case when t <= 4 then 'direct' when s <= 4 then 'source_only' else 'clean' end as stratum, coalesce(not coalesce(s <= 4, false) and not coalesce(t <= 4, false) and least(t, s) >= 12, false) as strict_clean from w)
select stratum, count(*) as n, count_if(strict_clean)::bigint as n_strict, round(100.0 * count(*) / sum(count(*)) over (), 4) as pct from st group by 1""")
def strata(spark, sf):
    """Items close to trained files, close to source files only, or to neither; strictly clean where nothing is nearer than 12 bits."""
    every = t(spark, sf, "bdneuro_v7_manifest").where("path is not null").select("path").distinct()
    w = scope_distances(spark, sf, ("trained", "sources"), 12).groupBy("path").pivot("scope", ["trained", "sources"]).agg(F.max("distance"))
    j = every.join(w, "path", "left")
    near = lambda c: F.coalesce(F.col(c) <= 4, F.lit(False))
    stratum = F.when(near("trained"), "direct").when(near("sources"), "source_only").otherwise("clean")
    strict = F.coalesce(~near("trained") & ~near("sources") & (F.least("trained", "sources") >= 12), F.lit(False))
    counts = j.select(stratum.alias("stratum"), strict.alias("strict")).groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), F.count_if("strict").alias("n_strict"))
    return counts.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 4))


_BINS = "case when dist = 0 then '0' when dist between 1 and 2 then '1-2' when dist between 3 and 11 then '3-11' when dist between 12 and 15 then '12-15' else '16+' end"


@query(f"with {_POOL}, b as (select dist, {_BINS} as bin from rk where r = 1) select bin, count(*) as n, round(100.0 * count(*) / sum(count(*)) over (), 4) as pct, min(dist) as lo, max(dist) as hi from b group by bin")
def distance_bins(spark, sf):
    """External items by distance to their nearest pool class, in closed bins."""
    near = nearest_neighbour(spark, sf)
    d = F.col("distance")
    bin_ = F.when(d == 0, "0").when(d <= 2, "1-2").when(d <= 11, "3-11").when(d <= 15, "12-15").otherwise("16+")
    g = near.groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("distance").alias("lo"), F.max("distance").alias("hi"))
    return g.select("bin", "n", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 4).alias("pct"), "lo", "hi")


@query(f"with {_SC} select scope, count(*) as n, quantile_cont(dist, 0.25) as q25, quantile_cont(dist, 0.5) as q50, quantile_cont(dist, 0.75) as q75, count_if(dist between 3 and 5)::bigint as n_3_5, count_if(dist between 6 and 11)::bigint as n_6_11, count_if(dist between 12 and 15)::bigint as n_12_15, count_if(dist >= 16)::bigint as n_16 from sn group by scope")
def distance_quantiles(spark, sf):
    """Quartiles (linear) of the nearest distance per scope, and counts of closed bins."""
    d = F.col("distance")
    q = F.percentile("distance", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))  # at most 65 distinct values
    bins = {"n_3_5": d.between(3, 5), "n_6_11": d.between(6, 11), "n_12_15": d.between(12, 15), "n_16": d >= 16}
    return scope_distances(spark, sf).groupBy("scope").agg(F.count(F.lit(1)).alias("n"), q[0].alias("q25"), q[1].alias("q50"), q[2].alias("q75"), *[F.count_if(c).alias(k) for k, c in bins.items()])


_REP = f"""{CURATED}, rp as (select *, row_number() over (partition by dup_cluster order by case when source = 'slicebank' then 0 when source = 'northset' then 1 when source = 'brightset' then 2 else 9 end, (mask is null), coalesce(bytes, 0) desc, path) as r from c where dup_cluster is not null)"""


@query(f"with {_REP} select dup_cluster, path as representative, source, (mask is not null) as has_mask from rp where r = 1")
def representatives(spark, sf):
    return cu.representatives(v.curated(spark, sf), "dup_cluster", {"slicebank": 0, "northset": 1, "brightset": 2}).select("dup_cluster", F.col("path").alias("representative"), "source", F.col("mask").isNotNull().alias("has_mask"))


@query(f"with {CURATED} select path, dup_cluster, case when patient is null then min(patient) over (partition by dup_cluster) else patient end as patient_id, (count(distinct patient) over (partition by dup_cluster)) > 1 as conflict from c where dup_cluster is not null")
def propagate_ids(spark, sf):
    return cu.propagate(v.curated(spark, sf).where("dup_cluster is not null"), "dup_cluster").select("path", "dup_cluster", "patient_id", "conflict")


@query(f"with {_REP} select label, count(*) as before, count_if(r = 1)::bigint as after, round(100.0 * (1 - count_if(r = 1) / count(*)), 4) as removed_pct from rp group by label")
def dedup_effect(spark, sf):
    return cu.dedup_effect(v.curated(spark, sf), "dup_cluster", {"slicebank": 0, "northset": 1, "brightset": 2})


@query(f"with {CURATED} select grp, count(*) as n, count(distinct label) as n_labels, array_to_string(list_sort(list_distinct(list(label) filter (label is not null))), ' + ') as labels from c where grp is not null group by grp having count(distinct label) > 1")
def groups_spanning_labels(spark, sf):
    g = v.curated(spark, sf).where("grp is not null").groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("label").alias("n_labels"), du.joined_set("label").alias("labels"))
    return g.where("n_labels > 1")


@query(f"with {CURATED} select count(*) as n_groups, min(n) as min_size, median(n) as median_size, round(avg(n), 6) as mean_size, max(n) as max_size from (select grp, count(*) as n from c where grp is not null group by grp)")
def group_size_summary(spark, sf):
    sizes = v.curated(spark, sf).where("grp is not null").groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.count(F.lit(1)).alias("n_groups"), F.min("n").alias("min_size"), F.median("n").alias("median_size"), F.round(F.avg("n"), 6).alias("mean_size"), F.max("n").alias("max_size"))


@query(f"with {CURATED} select label, count(distinct source) as n_sources, count(*) as n, case when count(distinct source) = 1 then min(source) end as only_source from c where label is not null group by label")
def single_source_classes(spark, sf):
    """Classes and how many sources they come from; the source is named where it is the only one."""
    k = F.countDistinct("source")
    return v.curated(spark, sf).where("label is not null").groupBy("label").agg(k.alias("n_sources"), F.count(F.lit(1)).alias("n"), F.when(k == 1, F.min("source")).alias("only_source"))


@query(f"""with {CURATED}, g as (select source, count(*) as images, count(distinct patient) as patients, count(distinct grp) as groups_, count(distinct width || 'x' || height) as sizes, array_to_string(list_sort(list_distinct(list(label) filter (label is not null))), ', ') as labels from c group by source)
select source, images, case when patients = 0 then 'NR' else patients::varchar end as patients, groups_ as n_groups, sizes, labels from g
union all select 'TOTAL', count(*), count(distinct patient)::varchar, count(distinct grp), count(distinct width || 'x' || height), '' from c""")
def sources_table(spark, sf):
    c = v.curated(spark, sf)
    aggs = [F.count(F.lit(1)).alias("images"), F.countDistinct("patient").alias("np"), F.countDistinct("grp").alias("n_groups"), F.countDistinct(F.concat_ws("x", "width", "height")).alias("sizes")]
    dims = c.where("true").withColumn("width", F.when(F.col("height").isNotNull(), F.col("width")))
    aggs[3] = F.countDistinct(F.when(F.col("width").isNotNull() & F.col("height").isNotNull(), F.concat_ws("x", "width", "height"))).alias("sizes")
    per = dims.groupBy("source").agg(*aggs, du.joined_set("label", ", ").alias("labels")).select("source", "images", F.when(F.col("np") == 0, "NR").otherwise(F.col("np").cast("string")).alias("patients"), "n_groups", "sizes", "labels")
    total = dims.agg(*aggs).select(F.lit("TOTAL").alias("source"), "images", F.col("np").cast("string").alias("patients"), "n_groups", "sizes", F.lit("").alias("labels"))
    return per.unionByName(total)


@query(f"""with {FILES}, {FOLDS} select f.source, count(*) as distributed, count(s.path) as retained, count(*) - count(s.path) as removed, round(100.0 * count(s.path) / count(*), 4) as retained_pct from f left join s using (path) group by f.source""")
def retained_cohort(spark, sf):
    j = v.files(spark, sf, "source", "path").select("source", "path").join(v.folds(spark, sf), "path", "left")
    g = j.groupBy("source").agg(F.count(F.lit(1)).alias("distributed"), F.count("fold").alias("retained"))
    return g.select("source", "distributed", "retained", (F.col("distributed") - F.col("retained")).alias("removed"), F.round(100.0 * F.col("retained") / F.col("distributed"), 4).alias("retained_pct"))


@query(f"""with {_POOL}, b as (select path, dist, case when dist = 0 then '0' when dist <= 2 then '1-2' else '3-99' end as band, ('0x' || substr(md5('42:' || path), 1, 8))::bigint as h from rk where r = 1)
select band, path, dist as distance, pos::int as pos from (select *, row_number() over (partition by band order by h, path) as pos from b) where pos <= 10""")
def band_sample(spark, sf):
    """Ten matches per distance band in a seeded order, for inspection."""
    from ..operators.statistics import draw

    near = nearest_neighbour(spark, sf)
    band = F.when(F.col("distance") == 0, "0").when(F.col("distance") <= 2, "1-2").otherwise("3-99")
    w = Window.partitionBy("band").orderBy(draw(F.lit(42), "path"), "path")
    return near.select(band.alias("band"), "path", "distance").withColumn("pos", F.row_number().over(w)).where("pos <= 10")


@query(f"""with {_HC}, pairs as (select a.rep as a, b.rep as b from h a join h b on a.rep < b.rep and bit_count(xor(a.p, b.p)) <= 2 and bit_count(xor(a.d, b.d)) <= 2),
m as (select h.rep, f.source, f.class, count(*) as n from f join h using (p, d) where f.class is not null group by all)
select x.source as source_a, y.source as source_b, sum(x.n * y.n)::bigint as n, round(sum(case when x.class = y.class then x.n * y.n else 0 end) / sum(x.n * y.n), 6) as agreement from pairs join m x on x.rep = a join m y on y.rep = b group by 1, 2""")
def match_agreement(spark, sf):
    """Share of near pairs of files whose classes agree, per pair of sources.

    All files of two near hash classes are pairs; source_a is on the side of the class with the smaller file_id.
    Files with equal hashes are no near pair.
    """
    j = _matched_labels(spark, sf)
    n, same = F.col("na") * F.col("nb"), F.col("ca") == F.col("cb")
    return j.groupBy("source_a", "source_b").agg(F.sum(n).alias("n"), F.round(F.sum(F.when(same, n).otherwise(0)) / F.sum(n), 6).alias("agreement"))


def _matched_labels(spark, sf):
    files = v.files(spark, sf, "source", "class", "p", "d")
    classes = Staging(spark, "agreement").keep(ne.hash_classes(files))
    pairs = ne.banded_pairs(classes, 2).select("a", "b")
    held = _members(files.where("class is not null"), classes, "source", "class")
    side = lambda k, s, c, n: held.select(F.col("rep").alias(k), F.col("source").alias(s), F.col("class").alias(c), F.col("n").alias(n))
    return pairs.join(side("a", "source_a", "ca", "na"), "a").join(side("b", "source_b", "cb", "nb"), "b")


@query(f"""with {_HC}, pairs as (select a.rep as a, b.rep as b from h a join h b on a.rep < b.rep and bit_count(xor(a.p, b.p)) <= 2 and bit_count(xor(a.d, b.d)) <= 2),
m as (select h.rep, f.class, count(*) as n from f join h using (p, d) where f.class is not null group by all)
select x.class as class_a, y.class as class_b, sum(x.n * y.n)::bigint as n from pairs join m x on x.rep = a join m y on y.rep = b where x.class <> y.class group by 1, 2""")
def disagreement_crosstab(spark, sf):
    """Near pairs of files whose classes differ, by both classes."""
    j = _matched_labels(spark, sf).where("ca <> cb")
    return j.groupBy(F.col("ca").alias("class_a"), F.col("cb").alias("class_b")).agg(F.sum(F.col("na") * F.col("nb")).alias("n"))
