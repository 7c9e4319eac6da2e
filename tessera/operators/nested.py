"""Flat tables from deeply nested rows, by Dewey labels (problem 7).

Every element of a map or array, at any depth, is a node. A node's label is the sequence of ordinals on the way
to it (position of the column, of the map entry or array element, of the struct field); its parent's label is
what remains after cutting off the last element level, so links need no join. The walk follows the schema and is
one projection: a row is read once, whatever the number of tables made of it. Nodes that share a schema path
make one table.

Defined results: rows with a NULL root key are left out; a NULL collection has no nodes, an empty one neither; a
NULL map value or array element is a node with a NULL value; ordinals of map entries follow the stored order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NODE = "array<struct<label:string,schema_path:string,keys:array<string>,value:string>>"


def _scalar(value: Column, kind: T.DataType) -> Column:
    """The value as text, NULL for anything with parts: these are nodes of their own."""
    return F.lit(None).cast("string") if isinstance(kind, (T.StructType, T.MapType, T.ArrayType)) else value.cast("string")


def _walk(value: Column, kind: T.DataType, label: Column, path: str, keys: Column, wanted: frozenset[str] | None) -> Column | None:
    """Array of the nodes below ``value`` in document order; None where its type can hold none that are wanted."""
    if isinstance(kind, T.StructType):
        parts = [_walk(value[f.name], f.dataType, F.concat(label, F.lit(f".{i}")), f"{path}.{f.name}", keys, wanted) for i, f in enumerate(kind.fields)]
        parts = [p for p in parts if p is not None]
        return F.concat(*parts) if parts else None
    if isinstance(kind, T.MapType):
        items, inner, path = F.map_entries(value), kind.valueType, path + "{}"
        parts_of = lambda e, i: (e["key"].cast("string"), e["value"])
    elif isinstance(kind, T.ArrayType):
        items, inner, path = value, kind.elementType, path + "[]"
        parts_of = lambda e, i: (i.cast("string"), e)
    else:
        return None
    if wanted is not None and not any(w.startswith(path) for w in wanted):
        return None

    def node(e: Column, i: Column) -> Column:
        key, held = parts_of(e, i)
        here, ks = F.concat(label, F.lit("."), i.cast("string")), F.concat(keys, F.array(key))
        own = F.array(F.struct(here.alias("label"), F.lit(path).alias("schema_path"), ks.alias("keys"), _scalar(held, inner).alias("value")))
        below = _walk(held, inner, here, path, ks, wanted)
        if wanted is not None and path not in wanted:
            own = F.array().cast(_NODE)
        return own if below is None else F.concat(own, below)

    return F.coalesce(F.flatten(F.transform(items, node)), F.array().cast(_NODE))


def shred(df: DataFrame, root: str, columns: Sequence[str], paths: Sequence[str] | None = None) -> DataFrame:
    """(root, label, parent_label, schema_path, keys, value): one row per node of the given columns.

    ``keys`` are the map keys and array positions on the way to the node, its own last. With ``paths`` only nodes of
    these schema paths are made, and the walk enters nothing else. The first ordinal of a label is the place of the
    column in ``columns``.
    """
    wanted = None if paths is None else frozenset(paths)
    parts = []
    for i, name in enumerate(columns):
        made = _walk(F.col(name), df.schema[name].dataType, F.lit(str(i)), name, F.array().cast("array<string>"), wanted)
        if made is not None:
            parts.append(made)
    nodes = df.where(F.col(root).isNotNull()).select(root, F.inline(F.concat(*parts) if parts else F.array().cast(_NODE)))
    return nodes.select(root, "label", parent_label(F.col("label"), F.col("schema_path")).alias("parent_label"), "schema_path", "keys", "value")


def parent_label(label: Column, path: Column) -> Column:
    """The label cut back to the enclosing element; NULL for nodes right below the root.

    A label has one ordinal per struct field and element on the way; what is cut are those of the last element and
    the fields between it and the element around it.
    """
    last = F.regexp_extract(path, r"(?:^|[}\]])([^{}\[\]]*)(?:\{\}|\[\])$", 1)
    ordinals = F.size(F.split(last, r"\.", -1))
    cut = F.size(F.split(label, r"\.")) - ordinals
    shallow = ~path.rlike(r"[}\]].+(\{\}|\[\])$")
    return F.when(~shallow, F.concat_ws(".", F.slice(F.split(label, r"\."), F.lit(1), F.greatest(cut, F.lit(0)))))


def tables(nodes: DataFrame, paths: Sequence[str]) -> dict[str, DataFrame]:
    """The node tables of the given schema paths, related by ``parent_label`` = ``label``."""
    return {p: nodes.where(F.col("schema_path") == p).withColumn("key", F.element_at("keys", -1)).drop("keys", "schema_path") for p in paths}


def _last(label: Column) -> Column:
    """The ordinal a label ends with: the place of the element in its collection."""
    return F.substring_index(label, ".", -1).cast("int")


#: Schema paths of the metrics table and the kind of child they hold.
METRIC_CHILDREN = {"models{}": "model", "models{}.point{}": "point", "models{}.ci95{}": "ci95", "models{}.support{}": "support", "comparisons[]": "comparison"}


def metric_children(metrics: DataFrame) -> DataFrame:
    """(metrics_id, child_kind, parent_key, child_key) of models, their values and the comparisons.

    A label is an address: cut back to the parent's, its last ordinal is the place of the parent among the models, so
    the parent's key is looked up in the row itself and no join is needed.
    """
    rows = metrics.select("metrics_id", "models", "comparisons").where("metrics_id is not null")
    nodes = _nodes_of(rows, METRIC_CHILDREN)
    label, path = (lambda n: n["label"]), (lambda n: n["schema_path"])
    names = F.map_keys("models")
    pair = lambda n: F.get("comparisons", _last(label(n)))
    empty = lambda c: F.coalesce(c, F.lit(""))
    kind = F.create_map(*[F.lit(x) for kv in METRIC_CHILDREN.items() for x in kv])

    def child(n: Column) -> Column:
        is_model, is_pair = path(n) == "models{}", path(n) == "comparisons[]"
        own = F.element_at(n["keys"], -1)
        above = F.get(names, _last(parent_label(label(n), path(n))))
        return F.struct(
            kind[path(n)].alias("child_kind"),
            F.when(is_model | is_pair, own).otherwise(above).alias("parent_key"),
            F.when(is_model, F.lit("")).when(is_pair, F.concat(empty(pair(n)["model_a"]), F.lit("|"), empty(pair(n)["model_b"]))).otherwise(own).alias("child_key"),
        )

    kept = F.filter(nodes, lambda n: (path(n) != "comparisons[]") | pair(n).isNotNull())
    return rows.select("metrics_id", F.inline(F.transform(kept, child)))


def _nodes_of(rows: DataFrame, paths: Sequence[str]) -> Column:
    """The nodes of models and comparisons as an array."""
    wanted = frozenset(paths)
    made = [_walk(F.col(c), rows.schema[c].dataType, F.lit(str(i)), c, F.array().cast("array<string>"), wanted) for i, c in enumerate(("models", "comparisons"))]
    return F.concat(*[m for m in made if m is not None])


def metric_values(metrics: DataFrame) -> DataFrame:
    """(metrics_id, model, metric, point, ci_lo, ci_hi, support): the values of each model side by side.

    Made of the node tables: bounds are children of the interval they belong to, which is a child of its model.
    """
    paths = ("models{}.point{}", "models{}.ci95{}", "models{}.ci95{}[]", "models{}.support{}")
    nodes = shred(metrics.select("metrics_id", "models"), "metrics_id", ["models"], paths)
    of = lambda p, v: F.max(F.when(F.col("schema_path") == f"models{{}}.{p}", v))
    number, bound = F.col("value").try_cast("double"), _last(F.col("label"))
    return nodes.groupBy("metrics_id", F.col("keys")[0].alias("model"), F.col("keys")[1].alias("metric")).agg(
        of("point{}", number).alias("point"), of("ci95{}[]", F.when(bound == 0, number)).alias("ci_lo"), of("ci95{}[]", F.when(bound == 1, number)).alias("ci_hi"), of("support{}", F.col("value").try_cast("bigint")).alias("support")
    )
