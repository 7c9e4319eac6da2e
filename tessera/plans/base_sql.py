"""SQL counterparts of the cleaned views."""

HASH = "case when regexp_matches(lower({c}), '^\\s*(0x)?0*[0-9a-f]{{1,16}}\\s*$') then ('0x' || lpad(regexp_extract(lower({c}), '^\\s*(?:0x)?0*([0-9a-f]{{1,16}})\\s*$', 1), 16, '0'))::ubigint end"
NONE = "('', '-', '--', 'n/a', 'na', 'nan', 'nil', 'none', 'null', 'unknown', '?', '#n/a', '<na>', 'missing')"
P, D = HASH.format(c="phash"), HASH.format(c="dhash")
FILES = f"""f as (select file_id, path, lower(trim(source)) as source, class, lower(trim(orig_split)) as split, width, height, mode, greatest(coalesce(bytes, 0), 0) as bytes,
 nullif(lower(trim(sha256)), '') as sha, {P} as p, {D} as d from files_index where file_id is not null
 qualify row_number() over (partition by file_id order by indexed_at desc nulls last, loaded_at desc nulls last) = 1)"""
CURATED = f"""c as (select distinct path, lower(trim(source)) as source, label, width, height, bytes, {P} as p, {D} as d,
 case when lower(trim(patient_id)) not in {NONE} then lower(trim(patient_id)) end as patient, case when lower(trim(mask_path)) not in {NONE} then trim(mask_path) end as mask,
 dup_cluster, is_representative as is_rep, nullif(lower(trim(group_id)), '') as grp from dataset)"""
FOLDS = "s as (select path, min(outer_fold) as fold from splits_outer where outer_fold is not null group by path)"
LABELLED = f"{CURATED}, {FOLDS}, l as (select s.path, s.fold, k.label, k.grp, k.patient, k.source, coalesce(k.grp, 'f:' || s.path) as unit from s join (select path, min(label) as label, min(grp) as grp, min(patient) as patient, min(source) as source from c group by path) k using (path))"
RUNS = "m as (select * from metrics where run_id is not null qualify row_number() over (partition by run_id order by written_at desc nulls last, loaded_at desc nulls last, metrics_id desc) = 1)"
PRED = """w as (select l_orderkey * 10 + l_linenumber as item, l_orderkey as grp, l_returnflag as y_true, l_quantity::bigint as wa, 1 + round(l_discount * 100)::bigint as wn, 1 + round(l_tax * 100)::bigint as wr from lineitem where l_returnflag is not null),
pr as (select item, grp, y_true, unnest(['A', 'N', 'R']) as label, unnest([wa, wn, wr]) / (wa + wn + wr) as prob from w)"""
DEC = f"{PRED}, dc as (select item, grp, y_true, pred, conf, sq, (pred = y_true)::int as correct from (select item, grp, y_true, pow(wa / (wa + wn + wr) - (y_true = 'A')::int, 2) + pow(wn / (wa + wn + wr) - (y_true = 'N')::int, 2) + pow(wr / (wa + wn + wr) - (y_true = 'R')::int, 2) as sq, case when wa >= wn and wa >= wr then 'A' when wn >= wr then 'N' else 'R' end as pred, greatest(wa, wn, wr) / (wa + wn + wr) as conf from w))"
