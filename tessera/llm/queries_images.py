"""Registered queries of problems 1, 2, 3, 5 and 6, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import entity_splits, image_groups, split_overlap
from .tables import table as _t


def p1_found(spark, sf):
    return image_groups.file_groups(_t(spark, sf, "files_index"), _t(spark, sf, "dataset"))


def p2_found(spark, sf):
    return image_groups.close_files(_t(spark, sf, "files_index"))


def p2_class_links(spark, sf):
    return image_groups.class_links(_t(spark, sf, "files_index"))


def p2_class_pairs(spark, sf):
    return image_groups.class_pairs(_t(spark, sf, "files_index"))


def p3_found(spark, sf):
    return split_overlap.overlaps(_t(spark, sf, "bdneuro_v7_manifest"), _t(spark, sf, "files_index")).select("eval_path", "train_path")


def p3_counts(spark, sf):
    return split_overlap.overlap_counts(_t(spark, sf, "bdneuro_v7_manifest"), _t(spark, sf, "files_index"))


def p5_found(spark, sf):
    return image_groups.survivors(_t(spark, sf, "files_index"), _t(spark, sf, "dataset"), _t(spark, sf, "source_trust"))


def p6_found(spark, sf):
    return entity_splits.split_breaches(_t(spark, sf, "dataset"), _t(spark, sf, "splits_outer"))


def p6_splits(spark, sf):
    return entity_splits.assign_splits(_t(spark, sf, "dataset"), _t(spark, sf, "split_targets"))


def p6_shares(spark, sf):
    made = p6_splits(spark, sf).groupBy("split_name").agg(F.count(F.lit(1)).alias("n_paths"), F.countDistinct("block").alias("n_blocks"))
    return made.withColumn("share", F.round(F.col("n_paths") / F.sum("n_paths").over(_all()), 6))


def _all():
    from pyspark.sql import Window

    return Window.partitionBy()


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p2_class_links, p2_class_pairs, p3_found, p3_counts, p5_found, p6_found, p6_splits, p6_shares)}

_HASH = "case when regexp_matches(lower({c}), '^\\s*(0x)?0*[0-9a-f]{{1,16}}\\s*$') then ('0x' || lpad(regexp_extract(lower({c}), '^\\s*(?:0x)?0*([0-9a-f]{{1,16}})\\s*$', 1), 16, '0'))::ubigint end"
_CUR = f"""cur as (
  select file_id, path, {_HASH.format(c="phash")} as p, {_HASH.format(c="dhash")} as d, nullif(lower(trim(sha256)), '') as s,
         lower(trim(source)) as source, greatest(coalesce(bytes, 0), 0) as bytes, indexed_at, lower(trim(orig_split)) as osplit
  from files_index where file_id is not null
  qualify row_number() over (partition by file_id order by indexed_at desc nulls last, loaded_at desc nulls last) = 1)"""
_NONE = "('', '-', '--', 'n/a', 'na', 'nan', 'nil', 'none', 'null', 'unknown', '?', '#n/a', '<na>', 'missing')"
_EVAL = """ev as (
  select distinct path, case when f in ('test', 'testing') then 'test' else 'validation' end as split, p, d, s from (
    select path, list_filter(string_split(lower(path), '/')[:-2], lambda x: x in ('val', 'valid', 'validation', 'test', 'testing'))[1] as f,
           {p} as p, {d} as d, nullif(lower(trim(sha256)), '') as s from bdneuro_v7_manifest where path is not null) where f is not null)""".format(p=_HASH.format(c="phash"), d=_HASH.format(c="dhash"))
_P3 = f"""with {_CUR}, {_EVAL}, tr as (select * from cur where osplit = 'train' and path is not null),
pairs as (select e.path as eval_path, t.path as train_path, e.split, t.source, coalesce(e.s = t.s, false) as exact from ev e join tr t on e.s = t.s
  union select e.path, t.path, e.split, t.source, coalesce(e.s = t.s, false) from ev e join tr t on bit_count(xor(e.p, t.p)) <= 2 and bit_count(xor(e.d, t.d)) <= 2)"""

_PATIENT = f"select path, lower(trim(patient_id)) as pa from dataset where path is not null and lower(trim(patient_id)) not in {_NONE}"
_CLOSURE = """reach(node, seen) as (select a, a from sym union select r.node, l.b from reach r join sym l on r.seen = l.a)"""

_BLOCKS = f"""with recursive recs as (select distinct path, 'g:' || nullif(trim(lower(group_id)), '') as g,
    case when lower(trim(patient_id)) not in {_NONE} then 'p:' || lower(trim(patient_id)) end as p from dataset where path is not null),
ent as (select path, g as e from recs where g is not null union select path, p from recs where p is not null),
ties as (select path, e, min(e) over (partition by path) as m from ent),
sym as (select e as a, m as b from ties where e <> m union select m, e from ties where e <> m), {_CLOSURE},
comp as (select node, min(seen) as block from reach group by node),
nodes as (select path, min(coalesce(g, p)) as node from recs group by path),
blocks as (select n.path, coalesce(c.block, n.node, 'f:' || n.path) as block from nodes n left join comp c on c.node = n.node)"""
_SPLITS = f"""{_BLOCKS}, dealt as (select path, block, (('0x' || substr(md5('42:' || block), 1, 8))::bigint % 4096)::int as cell from blocks),
cells as (select cell, (sum(n) over (order by cell) - n / 2.0) / sum(n) over () as middle from (select cell, count(*) as n from dealt group by cell)),
edges as (select split_name, sum(share) over (order by split_name) / sum(share) over () as edge from (select split_name, sum(target_share) as share from split_targets where split_name is not null and target_share > 0 group by 1)),
chosen as (select cell, coalesce(min(split_name) filter (where middle <= edge), max(split_name)) as split_name from cells, edges group by cell),
made as (select path, block, split_name from dealt join chosen using (cell))"""

SQL = {
    "p1_found": f"""with recursive {_CUR}, named as (select distinct c.file_id, q.pa from cur c join ({_PATIENT}) q using (path)),
pl as (select file_id as a, min(file_id) over (partition by pa) as b from named),
hc as (select p, d, min(file_id) as rep from cur where p is not null and d is not null group by 1, 2),
links as (select a, b from pl where a <> b
  union select c.file_id, h.rep from cur c join hc h using (p, d) where c.file_id <> h.rep
  union select x.rep, y.rep from hc x join hc y on x.rep > y.rep and bit_count(xor(x.p, y.p)) <= 2 and bit_count(xor(x.d, y.d)) <= 2),
sym as (select a, b from links union select b, a from links), {_CLOSURE}
select node as file_id, min(seen) as group_id from reach group by node""",
    "p2_found": f"""with {_CUR} select a.file_id as file_id_a, b.file_id as file_id_b from cur a join cur b on a.file_id < b.file_id
 and (bit_count(xor(a.p, b.p)) <= 4 and bit_count(xor(a.d, b.d)) <= 4)
union select a.file_id, b.file_id from cur a join cur b on a.file_id < b.file_id and a.s = b.s""",
    "p2_class_pairs": f"""with {_CUR}, hc as (select p, d, min(file_id) as rep from cur where p is not null and d is not null group by 1, 2)
select a.rep as class_a, b.rep as class_b, bit_count(xor(a.p, b.p))::int as dist_p, bit_count(xor(a.d, b.d))::int as dist_d from hc a join hc b on a.rep < b.rep and bit_count(xor(a.p, b.p)) <= 4 and bit_count(xor(a.d, b.d)) <= 4""",
    "p2_class_links": f"""with {_CUR}, hc as (select p, d, min(file_id) as rep, count(*) as n from cur where p is not null and d is not null group by 1, 2),
near as (select a.rep as a, b.rep as b from hc a join hc b on a.rep <> b.rep and bit_count(xor(a.p, b.p)) <= 4 and bit_count(xor(a.d, b.d)) <= 4),
every as (select c.file_id, c.s, h.rep, h.n, coalesce(h.rep, c.file_id) as unit, coalesce(g.deg, 0) as deg from cur c left join hc h using (p, d) left join (select a, count(*) as deg from near group by a) g on g.a = h.rep),
u as (select s, unit, min(file_id) as first, count(*) as n from every where s is not null group by 1, 2),
sh as (select s, min(first) as sha_id, sum(n)::bigint as sha_size, count(*) as n_units from u group by s),
lk as (select x.s, x.unit, count(*) as linked from u x join near on near.a = x.unit join u y on y.s = x.s and y.unit = near.b group by 1, 2)
select e.file_id, e.rep as class_id, e.n as class_size, e.deg as n_close_classes, sh.sha_id, sh.sha_size, coalesce(sh.n_units - 1 - coalesce(lk.linked, 0), 0) as n_sha_classes
from every e left join sh using (s) left join lk on lk.s = e.s and lk.unit = e.unit""",
    "p6_found": f"""{_BLOCKS},
held as (select distinct s.path, coalesce(b.block, 'f:' || s.path) as block, s.outer_fold from splits_outer s left join blocks b on b.path = s.path where s.path is not null and s.outer_fold is not null)
select distinct path from held where block in (select block from held group by block having min(outer_fold) <> max(outer_fold))""",
    "p6_splits": f"{_SPLITS} select path, block, split_name from made",
    "p6_shares": f"{_SPLITS} select split_name, count(*) as n_paths, count(distinct block) as n_blocks, round(count(*) / sum(count(*)) over (), 6) as share from made group by 1",
    "p3_found": _P3 + " select distinct eval_path, train_path from pairs",
    "p3_counts": _P3
    + """, one as (select eval_path, train_path, max(split) as split, max(source) as source, bool_or(exact) as exact from pairs group by 1, 2)
 select split, source, count(*) as pairs, count(distinct eval_path) as eval_files, count(distinct train_path) as train_files, count_if(exact)::bigint as exact_pairs from one group by 1, 2""",
    "p5_found": f"""with {_CUR}, facts as (
  select path, min(pa) as patient, min(ma) as mask from (
    select path, case when lower(trim(patient_id)) not in {_NONE} then lower(trim(patient_id)) end as pa,
           case when lower(trim(mask_path)) not in {_NONE} then trim(mask_path) end as ma from dataset where path is not null) group by 1),
g as (select c.*, f.patient, f.mask, coalesce(t.r, 2000000000) as r, count(*) over (partition by p, d) as n, min(file_id) over (partition by p, d) as group_id
      from cur c left join facts f on c.path = f.path left join (select lower(trim(source)) as source, min(trust_rank) as r from source_trust group by 1) t on c.source = t.source
      where p is not null and d is not null),
k as (select *, row_number() over (partition by p, d order by r, (mask is null), bytes desc, indexed_at desc, file_id) as pos from g where n > 1)
select group_id, min_by(file_id, pos) as survivor_id, coalesce(min_by(patient, pos) filter (where patient is not null), '') as patient_id,
       coalesce(min_by(mask, pos) filter (where mask is not null), '') as mask_path from k group by group_id""",
}
