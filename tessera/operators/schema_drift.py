"""Reading documents whose layout drifts into one schema (problem 4).

A rescue-column reader; one pass over each document gives its typed columns, what it left and how it departs:

* *enforce*: each target column takes the value under its own name if the JSON type fits;
* *promote*: a missing column is found under a name approved for it, or by its content (a models object is known by
  the fields of its entries, a comparison list by its model pairs, a label list by its strings);
* *rescue*: keys that are no column, and values no converter reads, stay in ``_rescued`` as JSON under the keys they
  have in the document, at every depth: of an object read in part its other keys, of a list the rest of each element
  at its place. Typed columns and ``_rescued`` together hold everything but JSON nulls;
* *replay*: :func:`replay` takes stored rows and names approved later, and moves rescued values into typed columns
  that are still empty. Values convert where their form is known (grouped digits, comma lists, metric/value lists,
  lo/hi objects, bracketed or dashed intervals).

Every departure is reported as removed, renamed, retyped or added. A document is walked by plain Python in Arrow
batches: its keys are not known beforehand, and the same rules in nested column expressions took two to six times
the CPU. Rows are independent, so nothing is moved but the rows of files loaded more than once.

Defined results: a payload that is NULL or no JSON object has NULL in all columns, keeps the payload in ``_rescued``
and reports ``unreadable`` for ``*``; of a file loaded twice the latest row (loaded_at, then payload) counts; JSON
null is no change; rows without a file_no are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from ..session import Staging
from ..sources.current import latest_rows

#: The columns of the target table and their JSON types.
COLUMNS = {"run_id": "string", "config": "string", "base_config": "string", "split_mode": "string", "n_images": "number", "n_groups": "number", "bootstrap_unit": "string", "labels": "array", "models": "object", "comparisons": "array"}
#: The fields of a model entry and their JSON types.
MODEL_FIELDS = {"point": "object", "ci95": "object", "confusion_matrix": "array", "support": "object"}
#: Names approved for promotion, in snake case, by preference; fields of model entries as ``models.*.<field>``.
APPROVED = {
    "base_config": ("parent_config",),
    "split_mode": ("cv_mode", "partitioning", "split"),
    "n_images": ("num_images", "images", "image_count"),
    "n_groups": ("num_groups", "groups", "n_patients", "num_patients", "patients"),
    "bootstrap_unit": ("resample_unit", "unit"),
    "labels": ("classes", "class_names"),
    "models": ("classifiers", "results"),
    "comparisons": ("model_comparisons", "pairwise"),
    "models.*.point": ("point_estimates", "point_estimate", "estimate", "estimates", "scores", "mean", "values"),
    "models.*.ci95": ("ci", "ci_95", "conf_int", "interval95", "interval_95", "intervals", "confidence_interval"),
    "models.*.confusion_matrix": ("confusion",),
    "models.*.support": ("supports", "class_support"),
}
#: Metrics that may stand directly in a model entry; per-class ones have "::" in their name.
METRICS = frozenset(("accuracy", "balanced_accuracy", "macro_f1", "weighted_f1", "macro_precision", "macro_recall", "macro_specificity", "roc_auc_macro", "brier", "ece", "mean_confidence"))
_INTERVAL_SUFFIX = re.compile(r"_(ci95|ci|interval95)$")
_NUMBER = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?")
_BOUND = re.compile(r"(?:(?<![\d.])-)?\d+(?:\.\d+)?")
_BETWEEN = re.compile(r"[\s\[\](),;:–—-]*")
_HUMP = re.compile(r"([a-z0-9])([A-Z])")

_DOUBLES = pa.list_(pa.float64())
_MODEL = pa.struct([("point", pa.map_(pa.string(), pa.float64())), ("ci95", pa.map_(pa.string(), _DOUBLES)), ("confusion_matrix", pa.list_(pa.list_(pa.int64()))), ("support", pa.map_(pa.string(), pa.int64()))])
_PAIR = {"model_a": "text", "model_b": "text", "a_only_correct": "whole", "b_only_correct": "whole", "mcnemar_exact_p": "number", "acc_diff": "number", "acc_diff_ci95": "numbers", "bootstrap_p": "number"}
_KINDS = {"text": pa.string(), "whole": pa.int64(), "number": pa.float64(), "numbers": _DOUBLES}
_COMPARISON = pa.struct([(k, _KINDS[t]) for k, t in _PAIR.items()])
_TYPES = {**{c: pa.string() for c in COLUMNS}, "n_images": pa.int64(), "n_groups": pa.int64(), "labels": pa.list_(pa.string()), "models": pa.map_(pa.string(), _MODEL), "comparisons": pa.list_(_COMPARISON)}
_CHANGES = pa.list_(pa.struct([("field_name", pa.string()), ("change_kind", pa.string())]))

#: Stands for "nothing is left".
_DONE = object()


def snake(key: str) -> str:
    return _HUMP.sub(r"\1_\2", key).lower()


def kind_of(v) -> str:
    """null, boolean, number, string, array or object."""
    if v is None:
        return "null"
    if isinstance(v, str):
        return "string"
    if isinstance(v, bool):
        return "boolean"
    return "array" if isinstance(v, list) else "object" if isinstance(v, dict) else "number"


def _parse(text: str | None):
    """The object a text holds; None if it is cut off, no JSON, or no object."""

    def number(t: str):
        x = float(t)
        return x if math.isfinite(x) else t

    try:
        doc = json.loads(text, parse_float=number, parse_constant=lambda t: t) if text else None
    except (ValueError, RecursionError):
        return None
    return doc if isinstance(doc, dict) else None


# Converters take a JSON value to (typed value, rest); the rest is _DONE where nothing is left.


def _number(v):
    """A number, or text that writes one with or without digit grouping."""
    if isinstance(v, str):
        text = re.sub(r"[,\s]", "", v)
        return (float(text), _DONE) if _NUMBER.fullmatch(text) and math.isfinite(float(text)) else (None, v)
    if kind_of(v) == "number":
        try:
            return float(v), _DONE
        except OverflowError:
            return None, v
    return None, _DONE if v is None else v


def _whole(v):
    n, rest = _number(v)
    if n is None:
        return None, rest
    if n != int(n) or abs(n) >= 1 << 63:
        return None, v
    return (v if kind_of(v) == "number" and isinstance(v, int) else int(n)), _DONE


def _string(v):
    return (v, _DONE) if isinstance(v, str) or v is None else (None, v)


def _text(v):
    """Text; a list of one text and an object that says its kind stand for the text they wrap."""
    if isinstance(v, list) and len(v) == 1 and isinstance(v[0], str):
        return v[0], _DONE
    if isinstance(v, dict) and isinstance(v.get("kind"), str):
        return v["kind"], _rest_of_object({k: x for k, x in v.items() if k != "kind" and x is not None})
    return _string(v)


def _labels(v):
    if isinstance(v, str):
        return [x.strip() for x in v.split(",")], _DONE
    if isinstance(v, list) and all(kind_of(x) in ("string", "number", "boolean", "null") for x in v):
        return [x if isinstance(x, str) or x is None else json.dumps(x) for x in v], _DONE
    return None, _DONE if v is None else v


def _numbers(v):
    if v is None:
        return None, _DONE
    if not isinstance(v, list):
        return None, v
    read = [_number(x) for x in v]
    return [n for n, _ in read], _DONE if all(r is _DONE for _, r in read) else v


def _interval(v):
    """Two bounds given as an array, a lo/hi object, or text such as "[a, b]" or "a-b"."""
    if isinstance(v, dict):
        (lo, rest_lo), (hi, rest_hi) = _number(v.get("lo")), _number(v.get("hi"))
        rests = {"lo": rest_lo, "hi": rest_hi}
        left = _rest_of_object({k: rests.get(k, x) for k, x in v.items() if x is not None})
        return (None if lo is None and hi is None else [lo, hi]), left
    if isinstance(v, str):
        bounds = _BOUND.findall(v)
        return ([float(b) for b in bounds], _DONE) if len(bounds) == 2 and _BETWEEN.fullmatch(_BOUND.sub("", v)) else (None, v)
    return _numbers(v)


def _matrix(v):
    if not isinstance(v, list):
        return None, _DONE if v is None else v
    out, whole = [], True
    for row in v:
        read = [_whole(x) for x in row] if isinstance(row, list) else None
        whole = whole and (row is None or (read is not None and all(r is _DONE for _, r in read)))
        out.append(None if read is None else [n for n, _ in read])
    return out, _DONE if whole else v


def _metric_list(v):
    """A list of {metric, value} as a map."""
    out, rests = {}, []
    for e in v:
        value = _number(e["value"]) if isinstance(e, dict) and isinstance(e.get("metric"), str) and e.get("value") is not None else (None, e)
        if value[1] is _DONE:
            out[e["metric"]] = value[0]
            rests.append(_rest_of_object({k: x for k, x in e.items() if k not in ("metric", "value") and x is not None}))
        else:
            rests.append(_DONE if e is None else e)
    return out, _rest_of_list(rests)


def _by_key(convert: Callable):
    def run(v):
        if not isinstance(v, dict):
            return None, _DONE if v is None else v
        read = {k: convert(x) for k, x in v.items()}
        return {k: t for k, (t, _) in read.items()}, _rest_of_object({k: r for k, (_, r) in read.items()})

    return run


def _rest_of_object(rests: dict):
    left = {k: r for k, r in rests.items() if r is not _DONE}
    return left or _DONE


def _rest_of_list(rests: list):
    return [None if r is _DONE else r for r in rests] if any(r is not _DONE for r in rests) else _DONE


_OF_PAIR = {"text": _string, "whole": _whole, "number": _number, "numbers": _numbers}


def _comparisons(v):
    if not isinstance(v, list):
        return None, _DONE if v is None else v
    out, rests = [], []
    for e in v:
        if not isinstance(e, dict):
            out.append(None)
            rests.append(_DONE if e is None else e)
            continue
        read = {k: _OF_PAIR[t](e.get(k)) for k, t in _PAIR.items()}
        out.append({k: t for k, (t, _) in read.items()})
        rests.append(_rest_of_object({k: read[k][1] if k in read else _DONE if x is None else x for k, x in e.items()}))
    return out, _rest_of_list(rests)


_CONVERT = {**{c: _text for c in COLUMNS}, "n_images": _whole, "n_groups": _whole, "labels": _labels, "comparisons": _comparisons}
_OF_MODEL = {"point": lambda v: _metric_list(v) if isinstance(v, list) else _by_key(_number)(v), "ci95": _by_key(_interval), "confusion_matrix": _matrix, "support": _by_key(_whole)}


def _is_metric(name: str) -> bool:
    return name in METRICS or "::" in name


class Reader:
    """Reads documents into the target schema under a set of approved names."""

    def __init__(self, approvals: Mapping[str, Sequence[str]] = APPROVED):
        inner = {f: approvals.get(f"models.*.{f}", ()) for f in MODEL_FIELDS}
        self.columns = {c: {a: i for i, a in enumerate((c, *approvals.get(c, ())))} for c in COLUMNS}
        self.fields = {f: {a: i for i, a in enumerate((f, *inner[f]))} for f in MODEL_FIELDS}
        self.named = {a for names in self.columns.values() for a in names}
        self.of_models = frozenset((*MODEL_FIELDS, *inner["point"], *inner["ci95"]))
        self.content = {"models": self._is_models, "comparisons": _is_comparisons, "labels": _is_labels}

    def _is_models(self, v) -> bool:
        """An object with an entry that has fields of a model."""
        return isinstance(v, dict) and any(isinstance(e, dict) and not self.of_models.isdisjoint(e) for e in v.values())

    def _place(self, doc: dict, names: dict[str, str], target: str, ranks: Mapping[str, int], all_named: set | None) -> str | None:
        """The key that holds a target's content: its own name, then approved names, then what its content shows."""
        if target in doc:
            return target
        found = None
        for key, value in doc.items():
            if key in (COLUMNS if all_named is not None else MODEL_FIELDS):
                continue
            rank = ranks.get(names[key])
            if rank is None and all_named is not None and target in self.content and names[key] not in all_named and self.content[target](value):
                rank = 100
            if rank is not None and (found is None or (rank, key) < found):
                found = (rank, key)
        return found[1] if found else None

    def model(self, entry: dict, typed: bool) -> tuple[dict | None, object, list[tuple[str, str]]]:
        names = {k: snake(k) for k in entry}
        kinds = {k: kind_of(v) for k, v in entry.items()}
        place = {f: self._place(entry, names, f, ranks, None) for f, ranks in self.fields.items()}
        known = set(names.values())
        bounds = {k: _INTERVAL_SUFFIX.sub("", n) for k, n in names.items() if _INTERVAL_SUFFIX.search(n)}
        stems = set(bounds.values())
        loose = {
            "point": {k: n for k, n in names.items() if (_is_metric(n) or n in stems) and kinds[k] in ("number", "string", "null")},
            "ci95": {k: stem for k, stem in bounds.items() if _is_metric(stem) or stem in known},
        }
        found = []
        for f, kind in MODEL_FIELDS.items():
            at, label = place[f], f"models.*.{f}"
            if at != f:
                found.append((label, "renamed" if at is not None or loose.get(f) else "removed"))
            if at is not None and kinds[at] != "null" and not (kinds[at] == kind and _fits(f, entry[at])):
                found.append((label, "retyped"))
        used = {at: f for f, at in place.items() if at is not None}
        found += [(f"models.*.{k}", "added") for k in entry if k not in MODEL_FIELDS and k not in used and k not in loose["point"] and k not in loose["ci95"]]
        if not typed:
            return None, _DONE, found
        out, rests = dict.fromkeys(MODEL_FIELDS), {}
        for k, v in entry.items():
            if k in used:
                out[used[k]], rests[k] = _OF_MODEL[used[k]](v)
            elif place["ci95"] is None and k in loose["ci95"]:
                value, rests[k] = _interval(v)
                out["ci95"] = {**(out["ci95"] or {}), loose["ci95"][k]: value}
            elif place["point"] is None and k in loose["point"]:
                value, rests[k] = _number(v)
                out["point"] = {**(out["point"] or {}), loose["point"][k]: value}
            elif v is not None:
                rests[k] = v
        return out, _rest_of_object(rests), found

    def models(self, value, typed: bool = True) -> tuple[dict | None, object, list[tuple[str, str]]]:
        if not isinstance(value, dict):
            return None, _DONE if value is None else value, []
        out, rests, found = {}, {}, []
        for name, entry in value.items():
            if isinstance(entry, dict):
                out[name], rests[name], changes = self.model(entry, typed)
                found += changes
            else:  # an entry that is no object has no place in the typed column: its key stays with NULL
                out[name], rests[name] = None, _DONE if entry is None else entry
        return out, _rest_of_object(rests), found

    def document(self, payload: str | None, typed: bool = True) -> tuple[dict, str | None, list[tuple[str, str]]]:
        """(typed columns, rescued JSON, changes) of one document."""
        doc = _parse(payload)
        if doc is None:
            return dict.fromkeys(COLUMNS), payload, [("*", "unreadable")]
        names = {k: snake(k) for k in doc}
        place = {c: self._place(doc, names, c, ranks, self.named) for c, ranks in self.columns.items()}
        found, out, rests = [], dict.fromkeys(COLUMNS), {}
        for c, kind in COLUMNS.items():
            at = place[c]
            if at != c:
                found.append((c, "renamed" if at is not None else "removed"))
            if at is None:
                continue
            if kind_of(doc[at]) not in (kind, "null"):
                found.append((c, "retyped"))
            if c == "models":
                out[c], rests[at], changes = self.models(doc[at], typed)
                found += changes
            elif typed:
                out[c], rests[at] = _CONVERT[c](doc[at])
        used = set(place.values())
        extra = [k for k in doc if k not in COLUMNS and k not in used]
        found += [(k, "added") for k in extra]
        if not typed:
            return out, None, list(dict.fromkeys(found))
        left = _rest_of_object({k: rests.get(k, v) for k, v in doc.items() if v is not None})
        return out, None if left is _DONE else _json(left), list(dict.fromkeys(found))

    def again(self, stored: dict, rescued: str | None) -> tuple[dict, str | None]:
        """Stored columns with rescued values moved to those that are still empty, and what is left of them."""
        doc = _parse(rescued)
        if doc is None:
            return stored, rescued
        names, out = {k: snake(k) for k in doc}, dict(stored)
        for c, ranks in self.columns.items():
            at = self._place(doc, names, c, ranks, self.named)
            if at is None:
                continue
            if c == "models":
                out[c], doc[at] = self._models_again(out[c], doc[at])
            elif out[c] is None:
                out[c], doc[at] = _CONVERT[c](doc[at])
        left = _rest_of_object(doc)
        return out, None if left is _DONE else _json(left)

    def _models_again(self, held: dict | None, rest):
        if held is None:
            return self.models(rest)[:2]
        if not isinstance(rest, dict):
            return held, rest
        held, rest = dict(held), dict(rest)
        for name, entry in rest.items():
            old = held.get(name)
            if not isinstance(entry, dict):
                continue
            new, left, _ = self.model(entry, True)
            # only fields that were empty are filled; what would double a filled one stays rescued
            clash = [f for f in MODEL_FIELDS if old is not None and old[f] is not None and new[f] is not None]
            if not clash:
                held[name] = {f: new[f] if old is None or old[f] is None else old[f] for f in MODEL_FIELDS}
                rest[name] = left
                continue
            names = {k: snake(k) for k in entry}
            free = {f: self._place(entry, names, f, self.fields[f], None) for f in MODEL_FIELDS if f not in clash and old[f] is None}
            filled, after = dict(old), dict(entry)
            for f, at in free.items():
                if at is not None:
                    filled[f], after[at] = _OF_MODEL[f](entry[at])
            held[name], rest[name] = filled, _rest_of_object(after)
        return held, _rest_of_object(rest)


def _fits(field: str, v) -> bool:
    if field == "point":
        return all(kind_of(x) in ("number", "null") for x in v.values())
    if field == "ci95":
        return all(x is None or (isinstance(x, list) and all(kind_of(y) in ("number", "null") for y in x)) for x in v.values())
    return True


def _is_comparisons(v) -> bool:
    return isinstance(v, list) and any(isinstance(e, dict) and e.get("model_a") is not None and e.get("model_b") is not None for e in v)


def _is_labels(v) -> bool:
    return isinstance(v, list) and len(v) > 0 and all(isinstance(e, str) for e in v)


def _json(v) -> str:
    return json.dumps(v, ensure_ascii=False, separators=(",", ":"))


def _arrow(values: list, kind: pa.DataType) -> pa.Array:
    """Values as Arrow; maps are given as dictionaries at any depth."""

    def shaped(v, t):
        if v is None:
            return None
        if pa.types.is_map(t):
            return [(k, shaped(x, t.item_type)) for k, x in v.items()]
        if pa.types.is_struct(t):
            return {f.name: shaped(v[f.name], f.type) for f in t}
        if pa.types.is_list(t) and (pa.types.is_struct(t.value_type) or pa.types.is_map(t.value_type)):
            return [shaped(x, t.value_type) for x in v]
        return v

    nested = pa.types.is_nested(kind)
    return pa.array([shaped(v, kind) for v in values] if nested else values, type=kind)


def _plain(v, t: pa.DataType):
    """A Python value from Arrow with maps as dictionaries."""
    if v is None:
        return None
    if pa.types.is_map(t):
        return {k: _plain(x, t.item_type) for k, x in v}
    if pa.types.is_struct(t):
        return {f.name: _plain(v[f.name], f.type) for f in t}
    return v


def read(raw: DataFrame, approvals: Mapping[str, Sequence[str]] = APPROVED, typed: bool = True) -> DataFrame:
    """(file_no, loaded_at, the target columns, _rescued, _changes): the one pass both results below come from.

    Without ``typed`` only file_no and _changes are made.
    """
    staging = Staging(raw.sparkSession, "drift")
    rows = latest_rows(raw, "file_no", ("loaded_at",), {"payload": F.col("payload"), "loaded_at": F.col("loaded_at")}, staging)
    shape = [("file_no", pa.int64())]
    if typed:
        shape += [("loaded_at", pa.timestamp("us", "UTC")), *_TYPES.items(), ("_rescued", pa.string())]
    schema = pa.schema([*shape, ("_changes", _CHANGES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(approvals)
        for batch in batches:
            made = [reader.document(p, typed) for p in batch.column("payload").to_pylist()]
            found = _arrow([[{"field_name": f, "change_kind": k} for f, k in c] for _, _, c in made], _CHANGES)
            cols = [batch.column("file_no")]
            if typed:
                cols += [batch.column("loaded_at").cast(pa.timestamp("us", "UTC")), *[_arrow([t[c] for t, _, _ in made], _TYPES[c]) for c in COLUMNS], pa.array([r for _, r, _ in made], pa.string())]
            yield pa.RecordBatch.from_arrays([*cols, found], schema=schema)

    return rows.select("file_no", "loaded_at", "payload").mapInArrow(run, from_arrow_schema(schema))


def changes(raw: DataFrame, approvals: Mapping[str, Sequence[str]] = APPROVED) -> DataFrame:
    """(file_no, field_name, change_kind): how each file departs from the target schema."""
    return read(raw, approvals, typed=False).select("file_no", F.inline("_changes"))


def ingest(raw: DataFrame, approvals: Mapping[str, Sequence[str]] = APPROVED) -> DataFrame:
    """One typed row per file in the target schema, with ``_rescued`` for all that did not find a place."""
    return read(raw, approvals).drop("_changes")


def replay(stored: DataFrame, approvals: Mapping[str, Sequence[str]]) -> DataFrame:
    """Stored rows of :func:`ingest` with rescued values moved into typed columns under newly approved names.

    A column that already has a value keeps it, and what is rescued under its name stays rescued; other columns of
    ``stored`` pass unchanged.
    """
    changed = {**_TYPES, "_rescued": pa.string()}
    kept = stored.select([c for c in stored.columns if c not in changed] + list(changed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(approvals)
        for batch in batches:
            cols = {c: [_plain(v, _TYPES[c]) for v in batch.column(c).to_pylist()] for c in COLUMNS}
            made = [reader.again({c: cols[c][i] for c in COLUMNS}, r) for i, r in enumerate(batch.column("_rescued").to_pylist())]
            arrays = {**{c: _arrow([t[c] for t, _ in made], _TYPES[c]) for c in COLUMNS}, "_rescued": pa.array([r for _, r in made], pa.string())}
            yield pa.RecordBatch.from_arrays([arrays.get(n, batch.column(n)) for n in batch.schema.names], names=batch.schema.names)

    return kept.mapInArrow(run, kept.schema).select(stored.columns)
