"""Core operators on small frames, and the registry against the smallest data."""

import datetime as dt
import hashlib
import json
import math
import random
import re
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tessera import session
from tessera.functions import text as tx
from tessera.functions.hashing import parse_hash64
from tessera.functions.missing import usable
from tessera.operators import claims, evaluation, graph, images, models, neighbours, nested, schema_drift, splitting, statistics
from tessera.plans import evaluation as plans
from tessera.plans import groups as plans_groups
from tessera.sources import readers
from tessera.streaming import current

T0 = dt.datetime(2024, 1, 1)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_hash_spellings(spark):
    df = spark.createDataFrame([("0xFF",), (" 00ff ",), ("8000000000000000",), ("",), ("zz",), (None,), ("0" * 20 + "1",), ("1" * 17,)], "h string")
    assert [r[0] for r in df.select(parse_hash64("h")).collect()] == [255, 255, -(1 << 63), None, None, None, 1, None]


def test_usable(spark):
    df = spark.createDataFrame([(" P1 ",), ("N/A",), ("nan",), ("-",), ("",), (None,)], "p string")
    assert [r[0] for r in df.select(usable("p")).collect()] == ["p1", None, None, None, None, None]


def test_drift(spark):
    full = {"run_id": "r", "config": "c", "base_config": "c", "split_mode": "grouped", "n_images": 5, "n_groups": 2, "bootstrap_unit": "group", "labels": ["a"], "models": {"m": {"point": {"accuracy": 1}, "ci95": {"accuracy": [0, 1]}, "confusion_matrix": [[1]], "support": {"a": 1}}, "none": None}, "comparisons": []}
    flat = {**full, "models": None, "classifiers": {"m": {"accuracy": 0.5, "accuracy_ci95": [0.1, 0.9], "confusion_matrix": [[1]], "support": {"a": 1}, "seconds": 3}}, "split_mode": None, "n_images": "6,964", "odd": {"x": 1}}
    del flat["models"]
    other = {**full, "models": {"m": {"scores": {"accuracy": "0.7"}, "support": {}, "ci95": {"accuracy": {"lo": 0, "hi": 1}}}}, "klass_list": ["a", "b"], "n_groups": True}
    del other["labels"]
    raw = [(1, json.dumps(full)), (2, json.dumps(flat)), (3, json.dumps(other)), (4, "{bad"), (5, None), (6, "[1]"), (1, "{}"), (None, "{}")]
    df = spark.createDataFrame([(n, p, T0 - dt.timedelta(days=i), "e", 1) for i, (n, p) in enumerate(raw)], "file_no bigint, payload string, loaded_at timestamp, entries string, doc int")
    got = set(rows(schema_drift.changes(df)))
    assert {g for g in got if g[0] == 1} == set()
    assert {g[1:] for g in got if g[0] == 2} == {("models", "renamed"), ("n_images", "retyped"), ("odd", "added"), ("models.*.point", "renamed"), ("models.*.ci95", "renamed"), ("models.*.seconds", "added")}
    assert {g[1:] for g in got if g[0] == 3} == {("labels", "renamed"), ("n_groups", "retyped"), ("models.*.point", "renamed"), ("models.*.point", "retyped"), ("models.*.ci95", "retyped"), ("models.*.confusion_matrix", "removed")}
    assert {g for g in got if g[0] > 3} == {(n, "*", "unreadable") for n in (4, 5, 6)}
    typed = {r["file_no"]: r for r in schema_drift.ingest(df).collect()}
    assert typed[2]["n_images"] == 6964 and typed[2]["models"]["m"]["point"] == {"accuracy": 0.5} and typed[2]["models"]["m"]["ci95"] == {"accuracy": [0.1, 0.9]}
    assert typed[3]["models"]["m"]["point"] == {"accuracy": 0.7} and typed[3]["labels"] == ["a", "b"] and json.loads(typed[3]["_rescued"]) == {"n_groups": True}
    assert typed[1]["models"]["none"] is None and typed[1]["_rescued"] is None and typed[4]["_rescued"] == "{bad"
    assert schema_drift.changes(df.where("false")).count() == 0


def test_drift_rescues_what_is_left_inside(spark):
    entry = {
        "point": {"accuracy": 0.5, "brier": "n/a", "ece": None}, "accuracy": 0.6,
        "ci95": {"accuracy": {"lo": 0, "hi": 1, "level": 0.9}, "brier": "[0.1, 0.2]", "ece": "unknown", "macro_f1": [0.1, "x"]},
        "confusion_matrix": [[1, "many"]], "support": {"a": 1.5, "b": "1,000"}, "fit_predict_seconds": 3, "calibration": {"t": 1.2},
    }
    listed = {"point": [{"metric": "accuracy", "value": 0.5}, {"metric": "brier", "value": 0.1, "n": 9}, {"metric": "ece", "value": "?"}]}
    flat = {"accuracy": 0.5, "brier": "n/a", "accuracy_ci95": {"lower": 0, "upper": 1}, "chosen_params": {"C": 1}}
    pair = {"model_a": "x", "model_b": "y", "a_only_correct": 1.5, "acc_diff": "0.1", "acc_diff_ci95": {"lo": 0, "hi": 1}, "note": "n"}
    doc = {"run_id": "r", "split_mode": {"kind": "grouped", "by": "patient"}, "n_images": 5.5, "n_groups": "1,000", "results": {"m": entry, "l": listed, "f": flat, "text": "t", "none": None}, "comparisons": [{"model_a": "x", "model_b": "y"}, pair, "z"], "seed": 1}
    df = spark.createDataFrame([(1, json.dumps(doc), T0)], "file_no bigint, payload string, loaded_at timestamp")
    row = schema_drift.ingest(df).first()
    assert json.loads(row["_rescued"]) == {
        "split_mode": {"by": "patient"},
        "n_images": 5.5,
        "results": {
            "m": {
                "point": {"brier": "n/a"}, "accuracy": 0.6, "ci95": {"accuracy": {"level": 0.9}, "ece": "unknown", "macro_f1": [0.1, "x"]},
                "confusion_matrix": [[1, "many"]], "support": {"a": 1.5}, "fit_predict_seconds": 3, "calibration": {"t": 1.2},
            },
            "l": {"point": [None, {"n": 9}, {"metric": "ece", "value": "?"}]},
            "f": {"brier": "n/a", "accuracy_ci95": {"lower": 0, "upper": 1}, "chosen_params": {"C": 1}},
            "text": "t",
        },
        "comparisons": [None, {"a_only_correct": 1.5, "acc_diff_ci95": {"lo": 0, "hi": 1}, "note": "n"}, "z"],
        "seed": 1,
    }
    assert row["split_mode"] == "grouped" and row["n_groups"] == 1000 and row["models"]["m"]["point"]["accuracy"] == 0.5 and row["models"]["m"]["support"]["b"] == 1000


def test_drift_replays_rescued_values(spark):
    entry = {"scores": {"accuracy": "0.7"}, "conf_int": {"accuracy": {"lo": 0.1, "hi": 0.9}}, "confusion": [[1, 2]], "support": {"a": 3}, "odd": 1}
    docs = [{"run_id": "r", "CvMode": "grouped", "num_images": "1,000", "classifiers": {"m": entry, "n": None}, "model_comparisons": [{"model_a": "x", "model_b": "y"}], "class_names": "a, b", "seed": 1}, {"models": {"m": entry, "k": {"point": {"accuracy": 1}, "scores": {"brier": 2}}}}, {}]
    df = spark.createDataFrame([(i, json.dumps(d), T0) for i, d in enumerate(docs)] + [(9, "{bad", T0)], "file_no bigint, payload string, loaded_at timestamp")
    bare = schema_drift.ingest(df, {})
    first = bare.where("file_no = 0").first()
    assert first["n_images"] is None and json.loads(first["_rescued"])["num_images"] == "1,000"
    key = lambda rs: {r["file_no"]: (r.asDict(True), json.loads(r["_rescued"]) if r["_rescued"] and r["file_no"] != 9 else r["_rescued"]) for r in rs}
    again, whole = key(schema_drift.replay(bare, schema_drift.APPROVED).collect()), key(schema_drift.ingest(df).collect())
    assert {k: v[1] for k, v in again.items()} == {k: v[1] for k, v in whole.items()}
    assert all({c: x for c, x in again[k][0].items() if c != "_rescued"} == {c: x for c, x in whole[k][0].items() if c != "_rescued"} for k in whole)
    assert again[0][0]["n_images"] == 1000 and again[0][1] == {"classifiers": {"m": {"odd": 1}}, "seed": 1}
    assert again[1][1] == {"models": {"m": {"odd": 1}, "k": {"scores": {"brier": 2}}}}  # a filled field keeps its value
    names = {**schema_drift.APPROVED, "models.*.support": ("odd",)}
    assert schema_drift.ingest(df, names).where("file_no = 1").first()["models"]["m"]["support"] == {"a": 3}


def test_nested(spark):
    kind = "id bigint, m map<string,struct<p:map<string,double>,c:array<array<int>>>>, a array<struct<x:string>>"
    df = spark.createDataFrame([(1, {"k": ({"u": 1.0, "v": None}, [[1, 2], []]), "z": None}, [("q",), None]), (2, None, []), (None, {"k": None}, None)], kind)
    got = {r["label"]: r for r in nested.shred(df, "id", ["m", "a"]).collect()}
    assert {r["schema_path"] for r in got.values()} == {"m{}", "m{}.p{}", "m{}.c[]", "m{}.c[][]", "a[]"}
    assert all(r["parent_label"] is None or r["parent_label"] in got for r in got.values())
    leaf = next(r for r in got.values() if r["schema_path"] == "m{}.c[][]" and r["value"] == "2")
    pruned = nested.shred(df, "id", ["m", "a"], ["m{}.c[][]"])
    assert rows(pruned) == rows(nested.shred(df, "id", ["m", "a"]).where("schema_path = 'm{}.c[][]'")) and nested.shred(df, "id", ["m"], ["x{}"]).count() == 0
    of = nested.tables(nested.shred(df, "id", ["m", "a"]), ["m{}", "m{}.p{}"])
    assert {(r["key"], r["pk"]) for r in of["m{}.p{}"].join(of["m{}"].select(F.col("label").alias("parent_label"), F.col("key").alias("pk")), "parent_label").collect()} == {("u", "k"), ("v", "k")}
    assert leaf["keys"] == ["k", "0", "1"] and got[leaf["parent_label"]]["schema_path"] == "m{}.c[]" and got[got[leaf["parent_label"]]["parent_label"]]["keys"] == ["k"]


def test_components_and_constraint(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(90, 91), (None, 1), (4, 4)], "a bigint, b bigint")
    assert dict(rows(graph.components(e))) == {**{i: 0 for i in range(51)}, 90: 90, 91: 90}
    star = spark.createDataFrame([(5, i) for i in range(6, 90)] + [(i, i + 100) for i in range(50)] + [(i + 100, i) for i in range(20)], "a bigint, b bigint")
    assert rows(graph.components(star, hot_rows=10)) == rows(graph.components(star))
    rng = random.Random(5)
    some = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)]
    seen = {i: i for e in some for i in e if e[0] != e[1]}
    while any(seen[a] != seen[b] for a, b in some if a != b):
        for a, b in some:
            if a != b:
                seen[a] = seen[b] = min(seen[a], seen[b])
    assert dict(rows(graph.components(spark.createDataFrame(some, "a bigint, b bigint")))) == seen
    assert graph.components(e.where("false")).count() == 0
    items = spark.createDataFrame([(1, "x"), (2, None), (3, "y"), (4, "x"), (5, None)], "id bigint, ent string")
    links = spark.createDataFrame([(1, 2), (2, 3)], "a bigint, b bigint")
    assert rows(graph.constrained_groups(items, links, "id", "ent")) == [(1, 1), (2, 1), (3, 3), (4, 1), (5, 5)]


def test_constrained_groups_equal_the_walk_in_order(spark):
    rng = random.Random(12)
    for trial in range(3):
        n = 60
        ents = {i: {rng.choice("abcdefgh") for _ in range(rng.choice([1, 1, 2]))} if rng.random() < 0.3 else set() for i in range(n)}
        links = sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(70)})
        parent, held = list(range(n)), {i: set(e) for i, e in ents.items()}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        def join(x, y):
            lo, hi = min(x, y), max(x, y)
            parent[hi] = lo
            held[lo] |= held[hi]

        for e in "abcdefgh":
            own = [i for i in range(n) if e in ents[i]]
            for i in own[1:]:
                if find(i) != find(own[0]):
                    join(find(i), find(own[0]))
        for a, b in links:
            x, y = find(a), find(b)
            if x != y and (not held[x] or not held[y] or held[x] & held[y]):
                join(x, y)
        items = spark.createDataFrame([(i, e) for i in range(n) for e in (sorted(ents[i]) or [None])], "id bigint, ent string")
        got = graph.constrained_groups(items, spark.createDataFrame(links, "a bigint, b bigint"), "id", "ent")
        assert rows(got) == sorted(((i, find(i)) for i in range(n)), key=str), trial


def test_constrained_groups_keep_patients_apart(spark, monkeypatch):
    # 1 and 2 are copies of different patients, 3 is a copy of none; 4 is the other file of patient b, 5 one without hashes
    files = [(1, "/1", 0, 0), (2, "/2", 0, 0), (3, "/3", 0, 0), (4, "/4", -1, -1), (5, "/5", None, None), (6, "/6", None, 3), (7, "/7", 77777, 0), (8, "/8", 77776, 0)]
    people = [("/1", "a"), ("/2", "b"), ("/4", "b"), ("/5", "b"), ("/7", "c"), ("/7", "d"), ("/8", "d")]
    monkeypatch.setattr(plans_groups.v, "files", lambda *_: spark.createDataFrame(files, "file_id bigint, path string, p bigint, d bigint"))
    monkeypatch.setattr(plans_groups.v, "curated", lambda *_: spark.createDataFrame(people, "path string, patient string"))
    assert rows(entry.queries()["constrained_groups"](spark, "")) == [(1, 1), (2, 2), (3, 1), (4, 2), (5, 2), (7, 7), (8, 7)]


def test_mcnemar_and_holm(spark):
    def exact(a, b):
        n, k = a + b, min(a, b)
        return min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n)

    cases = [(0, 0), (1, 5), (10, 2), (7, 7), (0, 40)]
    df = spark.createDataFrame(cases, "a bigint, b bigint").select("a", "b", statistics.binomial_p(F.col("a"), F.col("b")).alias("p"))
    for a, b, p in df.collect():
        assert p == pytest.approx(exact(a, b), abs=1e-9)
    h = spark.createDataFrame([("f", i, p) for i, p in enumerate([0.01, 0.04, 0.03, 0.5])], "fam string, i int, p double")
    assert [round(r["p_holm"], 6) for r in statistics.holm(h, "p", ["fam"], ["i"]).orderBy("i").collect()] == [0.04, 0.09, 0.09, 0.5]


def test_metrics(spark):
    rng = random.Random(2)
    data = [(i, rng.choice("ABC"), rng.choice("ABC"), rng.randrange(0, 16) / 15) for i in range(300)]
    d = spark.createDataFrame(data, "item bigint, y_true string, pred string, conf double").withColumn("correct", (F.col("pred") == F.col("y_true")).cast("int"))
    got = {r["label"]: r for r in evaluation.per_class(d, ["A", "B", "C", "X"]).collect()}
    for c in "ABC":
        tp = sum(t == p == c for _, t, p, _ in data)
        assert got[c]["recall"] == pytest.approx(tp / sum(t == c for _, t, _, _ in data), abs=1e-6)
    assert got["X"]["recall"] == 0 and got["X"]["support"] == 0
    bins = {}
    for _, t, p, c in data:
        if c > 0:
            bins.setdefault(math.ceil(round(c * 15, 9)), []).append((c, t == p))
    n = sum(map(len, bins.values()))
    want = sum(len(b) / n * abs(sum(x for x, _ in b) / len(b) - sum(y for _, y in b) / len(b)) for b in bins.values())
    assert evaluation.calibration(d).first()["ece"] == pytest.approx(want, abs=1e-5)
    order = sorted(data, key=lambda r: (-r[3], r[0]))
    err = curve = 0
    for k, (_, t, p, _) in enumerate(order, 1):
        err += t != p
        curve += err / k
    assert evaluation.risk_coverage(d, "item").first()["aurc"] == pytest.approx(curve / len(order), abs=1e-6)


def test_bootstrap_has_the_draws_of_the_reference(spark, monkeypatch):
    data = [(g, "AB"[g % 3 == 0], int(g % 5 > 0), int(g % 4 > 0)) for g in range(24) for _ in range(1 + g % 3)]
    monkeypatch.setattr(plans, "_pairs", lambda *_: spark.createDataFrame(data, "grp bigint, y_true string, a_ok int, b_ok int"))
    cdf = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(12)]

    def mixed(x):
        for _ in range(2):
            x = ((x >> 16) ^ x) * 0x45D9F3B & 0xFFFFFFFF
        return (x >> 16) ^ x

    def weight(seed, d, unit):
        digest = hashlib.md5(f"{seed}:{unit}".encode()).hexdigest()
        u = mixed(mixed(int(digest[:8], 16) + d * 0x9E3779B1 & 0xFFFFFFFF) ^ int(digest[8:16], 16)) / 2**32
        return sum(u >= c for c in cdf)

    def brute(draws, seed, value):
        out = []
        for d in range(1, draws + 1):
            w = [weight(seed, d, r[0]) for r in data]
            out.append(sum(x * value(r) for x, r in zip(w, data)) / sum(w))
        return np.array(out)

    acc = brute(2000, 42, lambda r: r[2])
    got = entry.queries()["bootstrap_accuracy_ci"](spark, "").first()
    assert got["n_draws"] == 2000 and [got["mean"], got["lo"], got["hi"]] == pytest.approx([acc.mean(), *np.percentile(acc, [2.5, 97.5])], abs=2e-6)
    diff = brute(2000, 43, lambda r: r[2] - r[3])
    got = entry.queries()["bootstrap_paired_diff"](spark, "").first()
    assert got["n_draws"] == 2000 and got["p"] == pytest.approx(min(1, 2 * min((diff <= 0).mean(), (diff >= 0).mean())), abs=2e-3)
    diff = brute(4000, 46, lambda r: r[2] - r[3])
    got = entry.queries()["bootstrap_cluster"](spark, "").first()
    assert got["n_draws"] == 4000 and got["p"] == pytest.approx(min(1, 2 * (min((diff <= 0).sum(), (diff >= 0).sum()) + 1) / 4001), abs=2e-3)
    # a draw that picks no unit of a class has no recall and is skipped
    assert all(3980 <= r["n_draws"] <= 4000 for r in entry.queries()["bootstrap_recall_ci"](spark, "").collect())
    assert 3980 <= entry.queries()["bootstrap_stratified_delta"](spark, "").first()["n_draws"] <= 4000


def test_matches_count_for_all_sources_of_a_copy(spark, tmp_path):
    files = [(1, "mirror1", "x", "00", "00"), (2, "slicebank", "y", "00", "00"), (3, "mirror2", "x", "01", "00"), (4, "mirror2", "y", "01", "00"), (5, "slicebank", "x", "ffff", "00")]
    row = "file_id bigint, source string, class string, phash string, dhash string, path string, orig_split string, width int, height int, mode string, bytes bigint, sha256 string, indexed_at timestamp, loaded_at timestamp"
    spark.createDataFrame([(*f, f"/{f[0]}", "train", 1, 1, "L", 1, "ab" if f[0] == 5 else None, T0, T0) for f in files], row).write.parquet(f"{tmp_path}/files_index.parquet")
    spark.createDataFrame([("e1", "00", "00", "AB", "g"), ("e2", "ffffffff", "ffffffff", None, "g")], "path string, phash string, dhash string, sha256 string, group_id string").write.parquet(f"{tmp_path}/bdneuro_v7_manifest.parquet")
    q = entry.queries()
    got = {r["scope"]: (r["n_items"], r["byte_identical"], r["n_matched"], r["groups_contaminated"], r["min_distance"]) for r in q["scopes_overlap_report"](spark, str(tmp_path)).collect()}
    assert got == {"composite": (2, 1, 1, 1, 0), "sources": (2, 0, 1, 1, 0), "trained": (2, 1, 1, 1, 0)}
    assert rows(q["match_agreement"](spark, str(tmp_path))) == [("mirror1", "mirror2", 2, 0.5), ("slicebank", "mirror2", 2, 0.5)]


def test_nearest_by_set_equals_brute_force(spark, monkeypatch):
    rng = random.Random(11)
    word = lambda: rng.getrandbits(64) - (1 << 63)
    pool = [(word(), word(), rng.choice([4, 4, 5, 6, 7])) for _ in range(301)]
    asked = [(f"q{i}", word(), word()) for i in range(20)] + [("copy", *pool[0][:2]), ("close", pool[1][0] ^ 3, pool[1][1] ^ 1)]
    asked += [("again", *asked[0][1:])]
    far = lambda a, b: max(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(a, b))
    names = ("x", "y", "z", "none")
    want = sorted((n, names[i], min(far((p, d), r) for r in pool if r[2] >> i & 1)) for n, p, d in asked for i in range(3))
    q, r = spark.createDataFrame(asked, "item string, p bigint, d bigint"), spark.createDataFrame(pool, "p bigint, d bigint, held int")
    assert rows(neighbours.nearest_by_set(q, "item", r, names)) == want
    monkeypatch.setattr(neighbours, "INDEX_FROM", 0)  # by bands
    monkeypatch.setattr(neighbours, "SET_QUERIES", 9)
    monkeypatch.setattr(neighbours, "SET_ROWS", 40)
    assert rows(neighbours.nearest_by_set(q, "item", r, names)) == want
    assert rows(neighbours.nearest_by_set(q, "item", r.limit(0), names)) == []
    assert rows(neighbours.nearest_by_set(q.limit(0), "item", r, names)) == []


def _scope_tables(spark, path):
    row = "file_id bigint, source string, class string, phash string, dhash string, path string, orig_split string, width int, height int, mode string, bytes bigint, sha256 string, indexed_at timestamp, loaded_at timestamp"
    files = [(1, "mirror1", "00", "00"), (2, " Slicebank", "00", "00"), (3, "mirror2", "ff", "00"), (4, None, "ffffffffffffffff", "00")]
    spark.createDataFrame([(i, s, "x", p, d, f"/{i}", "train", 1, 1, "L", 1, None, T0, T0) for i, s, p, d in files], row).write.parquet(f"{path}/files_index.parquet")
    items = [("e1", "01", "00", None, "g"), ("e2", "ff", "00", None, "g"), ("e3", "ffffffff", "ffffffff", None, "h"), ("e4", None, "00", None, "h")]
    spark.createDataFrame(items, "path string, phash string, dhash string, sha256 string, group_id string").write.parquet(f"{path}/bdneuro_v7_manifest.parquet")


def _one_scan(monkeypatch):
    monkeypatch.setattr(neighbours, "nearest", lambda *_, **__: pytest.fail("a scan for one scope"))


def test_strata_take_one_scan(spark, tmp_path, monkeypatch):
    _scope_tables(spark, tmp_path)
    _one_scan(monkeypatch)
    got = rows(entry.queries()["strata"](spark, str(tmp_path)))
    assert got == [("clean", 2, 1, 50.0), ("direct", 1, 0, 25.0), ("source_only", 1, 0, 25.0)]


def _asked(monkeypatch):
    """What nearest_by_set is asked for: its sets and the limit."""
    asked, by_set = [], neighbours.nearest_by_set
    monkeypatch.setattr(neighbours, "nearest_by_set", lambda q, i, p, sets, far=None: asked.append((tuple(sets), far)) or by_set(q, i, p, sets, far))
    return asked


def test_strata_tell_no_distances_apart_from_12_on(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    word = lambda: rng.getrandbits(64)
    pool = [(word(), word()) for _ in range(40)]
    flip = lambda x, n: x ^ sum(1 << i for i in rng.sample(range(64), n))
    items = [(flip(pool[i % 40][0], i % 16), flip(pool[i % 40][1], i % 5)) for i in range(80)]
    row = "file_id bigint, source string, class string, phash string, dhash string, path string, orig_split string, width int, height int, mode string, bytes bigint, sha256 string, indexed_at timestamp, loaded_at timestamp"
    spark.createDataFrame([(i, "slicebank" if i % 2 else "mirror1", "x", f"{p:x}", f"{d:x}", f"/{i}", "train", 1, 1, "L", 1, None, T0, T0) for i, (p, d) in enumerate(pool)], row).write.parquet(f"{tmp_path}/files_index.parquet")
    spark.createDataFrame([(f"e{i}", f"{p:x}", f"{d:x}", None, None) for i, (p, d) in enumerate(items)] + [("none", None, None, None, None)], "path string, phash string, dhash string, sha256 string, group_id string").write.parquet(f"{tmp_path}/bdneuro_v7_manifest.parquet")
    want: dict = {"clean": [1, 0]}  # an item without hashes is not strictly clean
    for q in items:
        s, t = (min(max((x ^ y).bit_count() for x, y in zip(q, r)) for r in pool[k::2]) for k in (0, 1))
        n = want.setdefault("direct" if t <= 4 else "source_only" if s <= 4 else "clean", [0, 0])
        n[0], n[1] = n[0] + 1, n[1] + (min(s, t) >= 12)
    asked = _asked(monkeypatch)
    for least in (0, neighbours.INDEX_BELOW):  # by bands, and row by row
        monkeypatch.setattr(neighbours, "INDEX_BELOW", least)
        got = {r["stratum"]: [r["n"], r["n_strict"]] for r in entry.queries()["strata"](spark, str(tmp_path)).collect()}
        assert got == want and all(n[1] for k, n in want.items() if k == "clean")
    assert asked == [(("trained", "sources"), 12)] * 2


def test_overlap_report_looks_farther_only_where_nothing_is_near(spark, tmp_path, monkeypatch):
    row = "file_id bigint, source string, class string, phash string, dhash string, path string, orig_split string, width int, height int, mode string, bytes bigint, sha256 string, indexed_at timestamp, loaded_at timestamp"
    files = [(1, "mirror1", "ff", "00"), (2, "slicebank", "ffffffffff", "ffff")]
    manifest = "path string, phash string, dhash string, sha256 string, group_id string"
    asked = _asked(monkeypatch)
    for name, items, want, scopes in (
        ("far", ["00", "01"], {"trained": (0, 39), "sources": (0, 7), "composite": (0, 7)}, [(("trained", "sources", "composite"), 5), (("trained", "sources", "composite"), 12), (("trained",), None)]),
        ("near", ["00", "fe"], {"trained": (0, 33), "sources": (1, 1), "composite": (1, 1)}, [(("trained", "sources", "composite"), 5), (("trained",), 12), (("trained",), None)]),
        ("all", ["fe", "ffffffffff"], {"trained": (0, 16), "sources": (1, 1), "composite": (1, 1)}, [(("trained", "sources", "composite"), 5), (("trained",), 12), (("trained",), None)]),
    ):
        at = f"{tmp_path}/{name}"
        spark.createDataFrame([(i, s, "x", p, d, f"/{i}", "train", 1, 1, "L", 1, None, T0, T0) for i, s, p, d in files], row).write.parquet(f"{at}/files_index.parquet")
        spark.createDataFrame([(f"e{i}", p, "00", None, "g") for i, p in enumerate(items)], manifest).write.parquet(f"{at}/bdneuro_v7_manifest.parquet")
        asked.clear()
        got = {r["scope"]: (r["n_matched"], r["min_distance"]) for r in entry.queries()["scopes_overlap_report"](spark, at).collect()}
        assert got == want
        assert asked == scopes


def test_overlap_report_takes_one_scan(spark, tmp_path, monkeypatch):
    _scope_tables(spark, tmp_path)
    _one_scan(monkeypatch)
    got = {r["scope"]: (r["n_items"], r["n_matched"], r["groups_contaminated"], r["min_distance"]) for r in entry.queries()["scopes_overlap_report"](spark, str(tmp_path)).collect()}
    assert got == {"trained": (4, 1, 1, 1), "sources": (4, 2, 1, 0), "composite": (4, 2, 1, 0)}


def test_band_keys_are_not_sent_through_the_driver(spark):
    classes = spark.range(9).select(F.col("id").alias("rep"), F.col("id").alias("p"), (F.col("id") * 7).alias("d"))
    items = classes.select(F.col("rep").alias("item"), "p", "d")
    for df in (neighbours.banded_pairs(classes, 4), neighbours.within(items, "item", classes, 4)):
        assert "Broadcast" not in df._jdf.queryExecution().sparkPlan().toString()


def test_rows_per_file_are_not_sent_through_the_driver(spark):
    for name in ("split_checks", "sibling_contamination", "propagated_share"):
        plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
        joins = [x for x in plan.splitlines() if "BroadcastHashJoin" in x and re.search(r"path#|unit#|dup_cluster#", x)]
        assert not joins, (name, joins)


def test_constrained_groups_send_no_rows_through_the_driver(spark, monkeypatch):
    plans, keep = [], session.Staging.keep
    of = lambda df: df._jdf.queryExecution().sparkPlan().toString()
    monkeypatch.setattr(session.Staging, "keep", lambda self, df: (plans.append(of(df)), keep(self, df))[1])
    plans.append(of(entry.queries()["constrained_group_checks"](spark, "/root/testdata/sf0.001")))
    joins = [x for plan in plans for x in plan.splitlines() if re.search(r"BroadcastHashJoin \[(?!(a|b|l)#)", x)]  # a, b, l: links
    assert len(plans) > 10 and not joins, joins


def test_claims_are_not_sent_through_the_driver(spark):
    docs = spark.createDataFrame([("manuscript", "of 1,234 files 99.5 % and 77.7 % in 12")], "scope string, text string")
    made = spark.range(1).select(F.lit(99.5).alias("value"), F.lit("pct").alias("form"))
    left = claims.uncovered(docs, made)
    assert rows(left) == [("1,234", 1), ("77.7", 1)]
    assert "Broadcast" not in left._jdf.queryExecution().sparkPlan().toString()


def test_splits(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([(i, f"u{i // 4}", rng.choice("ab")) for i in range(400)], "item bigint, unit string, label string")
    f = splitting.stratified_folds(df, "item", "label", 5, 1)
    assert {r["c"] for r in f.groupBy("label", "fold").agg(F.count("*").alias("c")).groupBy("label").agg((F.max("c") - F.min("c")).alias("c")).collect()} <= {0, 1}
    g = splitting.stratified_group_folds(df, "unit", "label", 5, 1, cell_units=60)
    sizes = [r["c"] for r in df.join(g, "unit").groupBy("fold").agg(F.count("*").alias("c")).collect()]
    assert len(sizes) == 5 and max(sizes) - min(sizes) <= 16 and g.count() == 100
    leaky = df.withColumn("fold", (F.col("item") % 3).cast("int"))
    checks = splitting.verify(leaky, "unit", "unit", "label", "fold")
    with pytest.raises(ValueError, match="units_spanning_folds"):
        splitting.require(checks)
    assert splitting.require(checks, strict=False).count() == 4


def test_text_and_claims(spark):
    d = spark.createDataFrame([("manuscript", "It was 0.9686 (0.968) −1.25 of 3,064 x9; v1.2.3, +2.50 and 77."), ("letter", "We found 0.968 and 88.")], "scope string, text string")
    assert d.select(tx.numbers(tx.normalise(F.col("text")))).first()[0] == ["0.9686", "0.968", "1.25", "3,064", "2.50", "77"]
    tokens = claims.quoted(d)
    held = {r["token"] for r in tokens.where("scope = 'manuscript'").collect()}
    assert {"3", "3,064", "-1.25", "+2.50", "2.50", "0.968", "0.9686", "0"} <= held and not {"0.96", "064", "25"} & held
    rows_ = [("a", 0.968, "f3", True, False), ("b", 0.96, "f2", True, False), ("c", 0.0, "f1", True, False), ("d", float("nan"), "f1", True, False), ("e", 7.0, "int", True, False), ("f", 9.0, "f2", False, False), ("g", 2.5, "pp", True, False), ("h", 5.5, "roman", True, False), ("i", None, "f1", True, False), ("j", 0.0, "f2", False, True)]
    c = spark.createDataFrame(rows_, "claim_id string, value double, form string, must_appear boolean, zero_ok boolean")
    got = {r["claim_id"]: r["verdict"] for r in claims.verdicts(c, tokens, ["manuscript", "letter"], ["letter"]).collect()}
    assert got == {"a": "ok", "b": "FAIL", "c": "SKIP", "d": "SKIP", "e": "SKIP", "f": "note", "g": "ok*", "h": "ERROR", "i": "SKIP", "j": "note"}
    assert {r["number"] for r in claims.uncovered(d, c).collect()} == {"0.9686", "1.25", "3,064"}
    assert claims.verdicts(c.where("false"), tokens, ["manuscript"]).count() == 0


def test_bootstrap_weights_are_poisson(spark):
    u = spark.createDataFrame([(i, 1.0, f"s{i % 2}") for i in range(3000)], "unit bigint, one double, s string")
    got = statistics.bootstrap_sums(u, "unit", ["one"], 50, 1, "s").collect()
    assert len(got) == 100 and abs(np.mean([r["one"] for r in got]) - 1500) < 15 and 20 < np.std([r["one"] for r in got]) < 60
    again = statistics.bootstrap_sums(u.repartition(7), "unit", ["one"], 50, 1, "s").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    assert statistics.bootstrap_sums(u.where("false"), "unit", ["one"], 5, 1).count() == 0


def test_nearest_at_any_distance(spark, monkeypatch):
    rng = random.Random(8)
    signed = lambda: rng.getrandbits(64) - (1 << 63)
    pool = [(i, signed(), signed()) for i in range(300)]
    qs = [(f"q{i}", p ^ (1 << (i % 60)), d) if i % 3 else (f"q{i}", signed(), signed()) for i, (_, p, d) in enumerate(pool[:60])]
    bits = lambda a, b: ((a ^ b) & ((1 << 64) - 1)).bit_count()
    p = spark.createDataFrame(pool, "rep bigint, p bigint, d bigint").repartition(3)
    q = spark.createDataFrame(qs, "path string, p bigint, d bigint")
    want = {(n, *min((max(bits(a, x), bits(b, y)), i) for i, x, y in pool)[::-1]) for n, a, b in qs}
    assert {tuple(r) for r in neighbours.nearest(q, "path", p).collect()} == want
    two = {n: sorted((bits(a, x), i) for i, x, _ in pool)[:2] for n, a, _ in qs}
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 7)
    got = {r["path"]: r for r in neighbours.best_two(q, "path", p).collect()}
    assert all(got[n]["best_id"] == t[0][1] and got[n]["best_distance"] == t[0][0] and got[n]["runner_up_distance"] == t[1][0] for n, t in two.items())
    assert neighbours.nearest(q, "path", p.where("false")).count() == 0 == neighbours.nearest(q.where("false"), "path", p).count()


def png(path, pixels):
    import struct
    import zlib

    h, w = pixels.shape
    raw = b"".join(b"\0" + row.tobytes() for row in pixels.astype(np.uint8))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_images(spark, tmp_path):
    df = spark.createDataFrame([([0.0, 0.0, 200.0, 200.0],), ([],)], "x array<double>")
    assert [r[0] for r in df.select(images.otsu_threshold("x")).collect()] == [0.0, None]
    assert df.select(images.ssim("x", "x", F.lit(2))).first()[0] == pytest.approx(1.0)
    assert df.select(images.to_uint8(F.col("x"))).first()[0] == [0, 0, 255, 255]
    s = images.attribution_scores(F.col("x"), F.array(*map(F.lit, (0, 0, 1, 1))))
    assert tuple(df.limit(1).select(*[v.alias(k) for k, v in s.items()]).first()) == (0.0, 0.5, 0.5, 1.0, 2.0, True, 1.0)
    bright = lambda stack: stack[:, :2, :2].sum((1, 2))
    heat = images.occlusion_heat(np.ones((6, 6)), bright, patch=2, stride=2)
    assert heat[:2, :2] == pytest.approx(np.full((2, 2), 4.0)) and heat[2:].sum() == 0
    assert images.occlusion_maps(spark.createDataFrame([(1, [1.0] * 36), (2, [1.0]), (3, None)], "id int, x array<double>"), "id", "x", 6, bright, patch=2, stride=2).where("heat is null").count() == 2
    rng = np.random.default_rng(1)
    x, y = rng.random((12, 15)) * 255, rng.random((12, 15)) * 255
    brute = []
    for i in range(6):
        for j in range(9):
            a, b = x[i : i + 7, j : j + 7].ravel(), y[i : i + 7, j : j + 7].ravel()
            cov = np.cov(a, b)
            brute.append((2 * a.mean() * b.mean() + 2.55**2) * (2 * cov[0, 1] + 7.65**2) / ((a.mean() ** 2 + b.mean() ** 2 + 2.55**2) * (cov[0, 0] + cov[1, 1] + 7.65**2)))
    assert images.ssim_of(x, y) == pytest.approx(np.mean(brute))
    pic = np.zeros((40, 50))
    pic[10:30, 10:40] = 200
    pic[15:20, 15:20] = 0  # a hole
    pic[2:4, 2:4] = 200  # a smaller part
    mask = images.brain_mask(pic)
    assert mask.sum() == 20 * 30 and images.brain_mask(np.zeros((5, 5))).sum() == 0
    assert images.variant(pic, mask, "brain", 8).shape == (8, 8) and images.variant(pic, mask, "background", 8).max() > 0 and images.resized(np.ones((7, 5)), 3, 4) == pytest.approx(np.ones((3, 4)))
    png(tmp_path / "a.png", pic)
    png(tmp_path / "b.png", np.clip(pic + rng.integers(0, 3, pic.shape), 0, 255))
    png(tmp_path / "c.png", rng.integers(0, 255, pic.shape))
    (tmp_path / "broken.png").write_bytes(b"no image")
    got = {r["path"].rsplit("/", 1)[1]: r for r in images.image_rows(spark, str(tmp_path)).collect()}
    assert set(got) == {"a.png", "b.png", "c.png"} and (got["a.png"]["width"], got["a.png"]["height"], got["a.png"]["mode"]) == (50, 40, "L")
    apart = lambda i, j, h: ((got[i][h] ^ got[j][h]) & ((1 << 64) - 1)).bit_count()
    assert apart("a.png", "b.png", "p") < apart("a.png", "c.png", "p")


def test_models_are_stored(spark, tmp_path):
    from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
    from pyspark.ml.linalg import Vectors

    df = spark.createDataFrame([(float(i % 2), Vectors.dense([i % 2 + 0.1 * i])) for i in range(20)], ["label", "features"])
    model = LogisticRegression().fit(df)
    for _ in range(2):
        models.save_model(model, str(tmp_path / "m"))
    assert models.load_model(LogisticRegressionModel, str(tmp_path / "m")).coefficients == model.coefficients


def test_models(spark):
    rng = random.Random(2)
    data = [(i, [rng.gauss(3 * (i % 3), 1), rng.gauss(0, 1)], i % 3, i % 4) for i in range(240)]
    df = spark.createDataFrame([*data, (999, None, 1, 0)], "id bigint, x array<double>, y int, fold int")
    out = models.linear_probe(df, "x", "y", "fold", "id", 4)
    assert out.count() == 240 and models.balanced_accuracy(out) > 0.8
    one = models.linear_probe(df.where("y = 1 or fold = 0"), "x", "y", "fold", "id", 4)
    assert {r["pred"] for r in one.where("id % 4 = 0").collect()} == {1}  # the other folds hold one label
    near = models.knn_vote(df.where("x is not null and id < 40"), df.where("x is not null"), "id", "x", "y", 5)
    assert near.count() == 40
    scored = df.where("x is not null").select("id", "y", F.array(-F.abs(F.col("x")[0]), -F.abs(F.col("x")[0] - 3), -F.abs(F.col("x")[0] - 6)).alias("s"))
    done = models.sigmoid_calibration(scored, "y", "s", [0, 1, 2]).collect()
    assert all(abs(sum(r["prob"]) - 1) < 1e-9 for r in done) and np.mean([int(np.argmax(r["prob"])) == r["y"] for r in done]) > 0.8


def test_readers(spark, tmp_path):
    for name in ("s/train/glioma/a.PNG", "s/pred/b.png", "s/test/healthy/c.jpg", "s/notes.txt"):
        f = tmp_path / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(name.encode())
    got = readers.union_sources(spark, {"one": str(tmp_path / "s"), "gone": str(tmp_path / "none")}).select("class", "split", "source")
    assert rows(got) == [("glioma", "train", "one"), ("notumor", "test", "one")]
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:p ><w:r><w:t>a &amp;</w:t><w:t xml:space="preserve"> b</w:t></w:r></w:p><w:p><w:t>c</w:t></w:p></w:document>')
    (tmp_path / "no.docx").write_bytes(b"nothing")
    assert readers.docx_text(spark, str(tmp_path / "no.docx")).first()["text"] is None
    assert readers.optional(spark, str(tmp_path / "gone")) is None
    assert readers.docx_text(spark, str(tmp_path / "d.docx")).first()["text"] == "a & b\nc"
    raw = spark.read.format("binaryFile").load(str(tmp_path / "s" / "notes.txt"))
    good = hashlib.md5(b"s/notes.txt").hexdigest()
    assert [r["ok"] for r in readers.verified(raw, {"notes.txt": good.upper()}).collect()] == [True] and readers.verified(raw, {}).first()["ok"] is None
    out = str(tmp_path / "out")
    held = readers.Artefacts(spark, str(tmp_path))
    with pytest.raises(readers.Missing):
        held["out"]
    readers.write(spark.range(3), out, dry_run=True)
    readers.write(spark.range(3), out)
    assert held["out"].count() == 3 and held["out"] is held["out"]
    with pytest.raises(Exception, match="exists"):
        readers.write(spark.range(3), out, overwrite=False)


def test_streaming(spark, tmp_path):
    spark.createDataFrame([(1, T0, "a"), (1, T0 + dt.timedelta(days=1), "b"), (2, T0, "c")], "k bigint, at timestamp, v string").write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("k bigint, at timestamp, v string").parquet(str(tmp_path / "in"))
    q = current.current_rows(s, "k", "at", ["v"]).writeStream.outputMode("complete").format("memory").queryName("cur").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["v"] for r in spark.table("cur").collect()) == ["b", "c"]


def test_registry(spark):
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q) and {"p4_found", "p7_found", "dup_exact_groups"} <= set(q)
    assert entry.entry(spark).count() > 0
