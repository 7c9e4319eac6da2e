"""The SQL counterpart of the drift report: how each document departs from the target schema."""

from __future__ import annotations

from ..operators.schema_drift import APPROVED, COLUMNS, METRICS, MODEL_FIELDS


def _names(xs) -> str:
    return ", ".join(f"'{x}'" for x in xs)


def _rows(items) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in i) + ")" for i in items)


def _at(value: str, key: str) -> str:
    """A field of a JSON object by the key in a column."""
    return f"json_extract({value}, '$.\"' || {key} || '\"')"


def _kind(value: str) -> str:
    return f"case json_type({value}) when 'VARCHAR' then 'string' when 'ARRAY' then 'array' when 'OBJECT' then 'object' when 'BOOLEAN' then 'boolean' when 'NULL' then 'null' else 'number' end"


_SNAKE = "lower(regexp_replace(key, '([a-z0-9])([A-Z])', '\\1_\\2', 'g'))"
_TOP = [(c, n, i) for c in COLUMNS for i, n in enumerate((c, *APPROVED.get(c, ())))]
_SUB = [(f, n, i) for f in MODEL_FIELDS for i, n in enumerate((f, *APPROVED.get(f"models.*.{f}", ())))]
_OF_MODELS = _names([*MODEL_FIELDS, *APPROVED["models.*.point"], *APPROVED["models.*.ci95"]])
_METRICS = _names(sorted(METRICS))
_K = _at("val", "k")

CHANGES = f"""with r as (select file_no, payload::json as doc from metrics_raw where file_no is not null and json_valid(payload) and json_type(payload) = 'OBJECT' qualify row_number() over (partition by file_no order by loaded_at desc nulls last, payload desc) = 1),
tk as (select file_no, doc, unnest(json_keys(doc)) as key from r), te as (select file_no, key, {_SNAKE} as name, {_at("doc", "key")} as val from tk), tv as (select *, {_kind("val")} as kind from te),
col(target, kind) as (values {_rows(COLUMNS.items())}), app(target, name, rank) as (values {_rows(_TOP)}), fld(target, kind) as (values {_rows(MODEL_FIELDS.items())}), fapp(target, name, rank) as (values {_rows(_SUB)}),
tc as (select *, case when kind = 'object' and len(list_filter(json_keys(val), lambda k: json_type({_K}) = 'OBJECT' and list_has_any(json_keys({_K}), [{_OF_MODELS}]))) > 0 then 'models'
 when kind = 'array' and len(list_filter(from_json(val, '["json"]'), lambda e: json_type(e) = 'OBJECT' and json_type(e, '$.model_a') <> 'NULL' and json_type(e, '$.model_b') <> 'NULL')) > 0 then 'comparisons'
 when kind = 'array' and json_array_length(val) > 0 and len(list_filter(from_json(val, '["json"]'), lambda e: json_type(e) <> 'VARCHAR')) = 0 then 'labels' end as content from tv),
cand as (select file_no, target, key, rank from tc join app using (name) where key not in (select target from col) union all select file_no, content, key, 100 from tc where content is not null and key not in (select target from col) and name not in (select name from app)),
pl as (select r.file_no, col.target, col.kind as want, coalesce(x.key, (select arg_min(c.key, (c.rank, c.key)) from cand c where c.file_no = r.file_no and c.target = col.target)) as spot from r cross join col left join tc x on x.file_no = r.file_no and x.key = col.target),
mo as (select pl.file_no, tc.val from pl join tc on tc.file_no = pl.file_no and tc.key = pl.spot where pl.target = 'models' and tc.kind = 'object'),
mk as (select file_no, val, unnest(json_keys(val)) as m from mo), me as (select file_no, m, {_at("val", "m")} as entry from mk), mj as (select * from me where json_type(entry) = 'OBJECT'),
fk as (select file_no, m, entry, unnest(json_keys(entry)) as key from mj), fe as (select file_no, m, key, {_SNAKE} as name, {_at("entry", "key")} as val from fk), fv as (select *, {_kind("val")} as kind, regexp_replace(name, '_(ci95|ci|interval95)$', '') as stem, regexp_matches(name, '_(ci95|ci|interval95)$') as bound from fe),
nm as (select file_no, m, list(name) as names, list(stem) filter (where bound) as stems from fv group by 1, 2),
fl as (select fv.*, (coalesce(list_contains(nm.stems, name), false) or name in ({_METRICS}) or contains(name, '::')) and kind in ('number', 'string', 'null') as is_point, bound and (stem in ({_METRICS}) or contains(stem, '::') or list_contains(nm.names, stem)) as is_ci from fv join nm using (file_no, m)),
fc as (select file_no, m, target, key, rank from fl join fapp using (name) where key not in (select target from fld)),
fp as (select mj.file_no, mj.m, fld.target, fld.kind as want, coalesce(x.key, (select arg_min(c.key, (c.rank, c.key)) from fc c where c.file_no = mj.file_no and c.m = mj.m and c.target = fld.target)) as spot from mj cross join fld left join fl x on x.file_no = mj.file_no and x.m = mj.m and x.key = fld.target),
loose as (select file_no, m, bool_or(is_point) as lp, bool_or(is_ci) as lc from fl group by 1, 2),
held as (select fp.*, fl.kind, fl.val, case target when 'point' then lp when 'ci95' then lc else false end as loose from fp left join loose using (file_no, m) left join fl on fl.file_no = fp.file_no and fl.m = fp.m and fl.key = fp.spot),
inner_kinds as (select file_no, m, target, kind, want, spot, case when kind is null or kind = 'null' then true when kind <> want then false
 when target = 'point' then len(list_filter(json_keys(val), lambda k: coalesce(json_type({_K}), 'NULL') in ('VARCHAR', 'ARRAY', 'OBJECT', 'BOOLEAN'))) = 0
 when target = 'ci95' then len(list_filter(json_keys(val), lambda k: coalesce(json_type({_K}), 'NULL') not in ('ARRAY', 'NULL') or (json_type({_K}) = 'ARRAY' and len(list_filter(from_json({_K}, '["json"]'), lambda e: json_type(e) in ('VARCHAR', 'ARRAY', 'OBJECT', 'BOOLEAN'))) > 0))) = 0
 else true end as fits from held)
select distinct file_no, field_name, change_kind from (
 select file_no, target as field_name, case when spot is null then 'removed' else 'renamed' end as change_kind from pl where spot is null or spot <> target
 union all select pl.file_no, target, 'retyped' from pl join tc on tc.file_no = pl.file_no and tc.key = pl.spot where tc.kind not in (want, 'null')
 union all select file_no, key, 'added' from tc where key not in (select target from col) and (file_no, key) not in (select file_no, spot from pl where spot is not null)
 union all select file_no, 'models.*.' || target, case when spot is not null or loose then 'renamed' else 'removed' end from held where spot is null or spot <> target
 union all select file_no, 'models.*.' || target, 'retyped' from inner_kinds where not fits
 union all select file_no, 'models.*.' || key, 'added' from fl where key not in (select target from fld) and not is_point and not is_ci and (file_no, m, key) not in (select file_no, m, spot from fp where spot is not null))"""
