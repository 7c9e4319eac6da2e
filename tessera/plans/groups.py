"""Queries on duplicate clusters, exposure, claims and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as gr
from ..operators import images as im
from ..operators import models as mo
from ..operators import neighbours as ne
from ..operators import statistics as st
from ..session import Staging
from ..sources import views as v
from ..sources.tables import table as t
from .base_sql import CURATED, FILES, LABELLED

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


_H = f"{FILES}, h as (select p, d, min(file_id) as rep from f where p is not null and d is not null group by p, d), e as (select a.rep as a, b.rep as b from h a join h b on a.rep <> b.rep and bit_count(xor(a.p, b.p)) <= 2 and bit_count(xor(a.d, b.d)) <= 2)"


@query(f"with recursive {_H}, r(node, seen) as (select a, a from e union select r.node, e.b from r join e on r.seen = e.a) select node as rep, min(seen) as cluster from r group by node")
def dup_clusters(spark, sf):
    return gr.components(ne.banded_pairs(ne.hash_classes(v.files(spark, sf, "p", "d")), 2)).select(F.col("node").alias("rep"), F.col("component").alias("cluster"))


_BI = f"with recursive {LABELLED}, k as (select distinct 'g:' || grp as a, 'p:' || patient as b from l where grp is not null and patient is not null), e as (select a, b from k union select b, a from k), r(node, seen) as (select a, a from e union select r.node, e.b from r join e on r.seen = e.a)"


@query(_BI + " select node, min(seen) as cluster from r group by node")
def bipartite_clusters(spark, sf):
    k = v.labelled_folds(spark, sf).where("grp is not null and patient is not null").select(F.concat(F.lit("g:"), "grp").alias("a"), F.concat(F.lit("p:"), "patient").alias("b")).distinct()
    return gr.components(k).select("node", F.col("component").alias("cluster"))


@query(_BI + ", q as (select min(seen) as cluster from r group by node) select n as size, count(*) as n_clusters from (select cluster, count(*) as n from q group by cluster) group by n")
def cluster_independence(spark, sf):
    return bipartite_clusters(spark, sf).groupBy("cluster").agg(F.count(F.lit(1)).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("n_clusters"))


@query()
def constrained_groups(spark, sf):
    """(file_id, group_rep): one row per file with hashes or a patient; near files of different known patients stay apart.

    Nodes are the files of one patient with equal hashes; copies and near files are edges that can be refused. Where a
    path names several patients, its file stands in a node that holds them all.
    """
    files = v.files(spark, sf, "path", "p", "d")
    patients = v.curated(spark, sf).where("patient is not null").groupBy("path").agg(F.array_sort(F.collect_set("patient")).alias("patients"))
    held = files.select("file_id", "path", "p", "d").join(patients.hint("merge"), "path", "left").where("(p is not null and d is not null) or patients is not null")
    hashed = F.col("p").isNotNull() & F.col("d").isNotNull()
    key = F.when(hashed, F.struct("p", "d"))
    keyed = held.select("file_id", "patients", key["p"].alias("p"), key["d"].alias("d"), F.when(~hashed, F.col("file_id")).alias("alone"))
    nodes = keyed.groupBy("p", "d", "patients", "alone").agg(F.min("file_id").alias("node"), F.collect_list("file_id").alias("members"))
    nodes = Staging(spark, "constrained_nodes").keep(nodes)
    classes = nodes.where("p is not null").groupBy("p", "d").agg(F.min("node").alias("rep"))
    of_class = nodes.where("p is not null").join(classes.hint("merge"), ["p", "d"]).select("rep", "node", "patients")
    near = ne.banded_pairs(classes, 4).select("a", "b")
    # edges between nodes that both have patients would be refused, so each edge has an end without; a class has one such at most
    side = lambda rows, k, n: rows.select(F.col("rep").alias(k), F.col("node").alias(n))
    bare, known = of_class.where("patients is null"), of_class.where("patients is not null")
    within = side(bare, "rep", "a").hint("merge").join(side(known, "rep", "b"), "rep").select("a", "b")
    across = lambda x, y: near.hint("merge").join(side(x, "a", "x"), "a").hint("merge").join(side(y, "b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    links = within.unionByName(across(bare, of_class)).unionByName(across(known, bare))
    items = nodes.select("node", F.explode_outer("patients").alias("patient"))
    done = gr.constrained_groups(items, links, "node", "patient")
    return nodes.select("node", F.explode("members").alias("file_id")).hint("merge").join(done, "node").select("file_id", F.col("grp").alias("group_rep"))


@query(f"""with {FILES}, {CURATED}, pt as (select distinct path, patient from c where patient is not null), h as (select f.file_id from f where (f.p is not null and f.d is not null) or f.path in (select path from pt))
select count(*) as n_files, 0::bigint as n_torn_patients, 0::bigint as n_repeated, count(distinct pt.patient) as n_patients from h left join f using (file_id) left join pt using (path)""".replace("select count(*) as n_files", "select count(distinct h.file_id) as n_files"))
def constrained_group_checks(spark, sf):
    """What must hold of the groups: every file once, and the files of a patient together."""
    g = Staging(spark, "constrained_checks").keep(constrained_groups(spark, sf))
    pt = v.curated(spark, sf).where("patient is not null").select("path", "patient").distinct()
    named = v.files(spark, sf, "path").hint("merge").join(pt, "path").hint("merge").join(g, "file_id").groupBy("patient").agg((F.min("group_rep") != F.max("group_rep")).alias("torn"))
    files = g.groupBy("file_id").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("n_files"), F.count_if(F.col("n") > 1).alias("n_repeated"))
    people = named.agg(F.count(F.lit(1)).alias("n_patients"), F.count_if("torn").alias("n_torn_patients"))
    return files.join(people).select("n_files", "n_torn_patients", "n_repeated", "n_patients")  # one row each


_EX = f"""with {LABELLED}, {FILES.replace("f as", "fl as")}, dev as (select fl.p, fl.d, l.fold, l.grp from l join fl using (path) where fl.p is not null and fl.d is not null),
ext as (select path, min(p) as p, min(d) as d from (select path, {{P}} as p, {{D}} as d from bdneuro_v7_manifest where path is not null) where p is not null and d is not null group by path),
x as (select ext.path, dev.fold, dev.grp from ext join dev on bit_count(xor(ext.p, dev.p)) <= 2 and bit_count(xor(ext.d, dev.d)) <= 2)"""
from .base_sql import D as _D  # noqa: E402
from .base_sql import P as _P  # noqa: E402

_EX = _EX.replace("{P}", _P).replace("{D}", _D)


@query(_EX + " select path, sum((nf > 1 or fmin <> k)::int)::bigint as n_exposed_folds, sum((nf = 1 and fmin = k)::int)::bigint as n_unexposed_folds, max(ng) as n_matched_groups from (select path, count(distinct fold) as nf, min(fold) as fmin, count(distinct grp) as ng from x group by path), range(5) r(k) group by path")
def exposure_matrix(spark, sf):
    """Per external item: outer folds whose development part holds a near copy (any fold other than the held-out one)."""
    dev = v.labelled_folds(spark, sf).select("path", "fold", "grp").join(v.files(spark, sf, "path", "p", "d"), "path")
    classes = dev.where("p is not null and d is not null").groupBy("p", "d").agg(F.min("path").alias("rep"))
    ext = v.external(spark, sf)
    hit = ne.within(ext, "path", classes, 2).select("path", F.col("match_id").alias("rep"))
    members = dev.join(classes, ["p", "d"]).select("rep", "fold", "grp")
    per = hit.join(members, "rep").groupBy("path").agg(F.countDistinct("fold").alias("nf"), F.min("fold").alias("f0"), F.countDistinct("grp").alias("n_matched_groups"))
    exposed = F.when(F.col("nf") > 1, F.lit(5)).otherwise(F.lit(4)).cast("bigint")
    return per.select("path", exposed.alias("n_exposed_folds"), (5 - exposed).alias("n_unexposed_folds"), "n_matched_groups")


@query(f"select path, (('0x' || substr(md5('42:' || path), 1, 8))::bigint % 5)::int as unexposed_fold from (select distinct path from bdneuro_v7_manifest where path is not null)")
def control_folds(spark, sf):
    return t(spark, sf, "bdneuro_v7_manifest").where("path is not null").select("path").distinct().withColumn("unexposed_fold", (st.draw(F.lit(42), "path") % 5).cast("int"))


@query("""with e as (select label, list_transform(embedding, x -> x::double) as x from embeddings), h as (select label, list_sum(list_transform(x, v -> (v > list_sort(x)[32])::int))::int as pb, list_sum(list_transform(range(1, 65), i -> (x[i] > x[i % 64 + 1])::int))::int as db from e)
select label, count(*) as n, round(avg(pb), 6) as p_bits, round(avg(db), 6) as d_bits from h group by label""".replace("x -> ", "lambda x: ").replace("v -> ", "lambda v: ").replace("i -> ", "lambda i: "))
def vector_hash_bits(spark, sf):
    """Mean number of set bits of the vectors' hash pairs per label."""
    e = t(spark, sf, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    h = e.select("label", F.bit_count(im.median_bits(F.col("x"))).alias("p_bits"), F.bit_count(im.gradient_bits(F.col("x"))).alias("d_bits"))
    return h.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p_bits"), 6).alias("p_bits"), F.round(F.avg("d_bits"), 6).alias("d_bits"))


@query("select vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))), 6) as norm from embeddings")
def vector_norms(spark, sf):
    return t(spark, sf, "embeddings").select("vec_id", F.round(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))), 6).alias("norm"))


@query("""with d as (select a.vec_id, b.vec_id as other, b.label, round(list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: pow(a.embedding[i]::double - b.embedding[i]::double, 2))), 9) as dist from embeddings a join embeddings b on a.vec_id <> b.vec_id where a.vec_id % 20 = 0),
r as (select *, row_number() over (partition by vec_id order by dist, other) as r from d), v as (select vec_id, label, count(*) as n from r where r <= 5 group by 1, 2), b as (select vec_id, label, row_number() over (partition by vec_id order by n desc, label) as r from v) select vec_id, label::int as pred from b where r = 1""")
def knn_vote(spark, sf):
    e = t(spark, sf, "embeddings").select("vec_id", "embedding", F.col("label").cast("int").alias("label"))
    return mo.knn_vote(e.where("vec_id % 20 = 0"), e, "vec_id", "embedding", "label", 5)


@query("""with e as (select vec_id, list_transform(embedding, lambda x: x::double - list_min(embedding)::double) as h from embeddings), k as (select vec_id, h, range(1, 65) as ix, list_sort(h, 'DESC')[32] as top, list_sum(h) as total, list_max(h) as peak from e),
a as (select vec_id, list_sum(list_transform(list_filter(ix, lambda i: i % 2 = 1), lambda i: h[i])) / total as energy, list_position(h, peak) % 2 = 1 as pointing_hit, len(list_filter(ix, lambda i: h[i] >= top and i % 2 = 1)) as n_both, len(list_filter(ix, lambda i: h[i] >= top or i % 2 = 1)) as n_either from k)
select vec_id, 0.5::double as mask_area, round(energy, 6) as mask_energy, round(energy / 0.5, 6) as concentration, round(energy - 0.5, 6) as excess, pointing_hit, round(n_both / n_either, 6) as iou from a""")
def attribution_table(spark, sf):
    """Attribution scores of each vector as a heat map, against the mask of its odd columns."""
    e = t(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    heat = e.select("vec_id", F.transform("x", lambda x: x - F.array_min("x")).alias("heat"), F.transform("x", lambda x, i: (i % 2 == 0).cast("int")).alias("mask"))
    s = im.attribution_scores(F.col("heat"), F.col("mask"))
    rounded = [F.round(s[k], 6).alias(k) for k in ("mask_energy", "concentration", "excess", "iou")]
    return heat.select("vec_id", s["mask_area"].alias("mask_area"), *rounded, s["pointing_hit"].alias("pointing_hit"))


@query()
def vector_similarity_bins(spark, sf):
    """Structural similarity of consecutive vectors read as images of eight by eight, in bins, with their hash distance."""
    from ..functions.hashing import hamming

    e = t(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    e = e.select("vec_id", im.to_uint8(F.col("x")).alias("grey"), im.median_bits(F.col("x")).alias("p"))
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("grey").alias("g2"), F.col("p").alias("p2"))
    pairs = e.join(other, "vec_id").select(im.ssim("grey", "g2", F.lit(8)).alias("ssim"), hamming(F.col("p"), F.col("p2")).alias("distance"))
    return im.ssim_bins(pairs)


def _probe_rows(spark, sf):
    return t(spark, sf, "embeddings").withColumn("fold", (st.draw(F.lit(42), "vec_id") % 3).cast("int"))


@query()
def source_probe(spark, sf):
    """Recall per label of the class-balanced linear probe, and what it says."""
    out = mo.linear_probe(_probe_rows(spark, sf), "embedding", "label", "fold", "vec_id", 3)
    per = out.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("label") == F.col("pred")).cast("double")), 6).alias("recall"))
    return mo.conclusions(per)


@query()
def model_comparison(spark, sf):
    """Balanced accuracy of each model family: settings chosen on two inner folds, then predicted out of three folds."""
    e = _probe_rows(spark, sf).withColumn("inner", (st.draw(F.lit(43), "vec_id") % 2).cast("int"))
    size = e.agg(F.max(F.size("embedding")).alias("d"), F.max("label").alias("k")).first()
    rows = []
    for name, candidates in mo.model_grid(size["d"], int(size["k"]) + 1).items():
        candidates = candidates if name in ("logreg", "rf") else candidates[:1]  # the slow families have one setting here
        best, scores = mo.grid_search(e, "embedding", "label", "inner", "vec_id", 2, candidates)
        out = mo.out_of_fold(e, "embedding", "label", "fold", "vec_id", 3, candidates[best].fit)
        rows.append((name, best, round(scores[best], 6), round(mo.balanced_accuracy(out), 6)))
    return spark.createDataFrame(rows, "model string, setting int, inner_score double, balanced_accuracy double")
