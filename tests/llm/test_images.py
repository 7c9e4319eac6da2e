"""Groups, pairs, overlaps, survivors and splits against brute force, and their defined edge cases."""

import datetime as dt
import itertools
import random

import pytest

from tessera.llm import chosen_path, components, entity_splits, image_groups, share_join, split_overlap
from tessera.operators import skew
from tessera.session import Staging

FILES = "file_id bigint, path string, source string, class string, orig_split string, width int, height int, mode string, bytes bigint, sha256 string, phash string, dhash string, indexed_at timestamp, loaded_at timestamp, rep int, n int"
DATASET = "path string, patient_id string, mask_path string, group_id string, node string"
T0 = dt.datetime(2024, 1, 1)


def flip(h, k, rng):
    for b in rng.sample(range(64), k):
        h ^= 1 << b
    return h


def make_files(n, seed=1):
    rng = random.Random(seed)
    rows, held = [], []
    for i in range(1, n + 1):
        if held and rng.random() < 0.5:
            p, d, sha = rng.choice(held)
            p, d = flip(p, rng.choice([0, 0, 1, 2, 3, 5]), rng), flip(d, rng.choice([0, 0, 1, 2, 4]), rng)
            sha = sha if rng.random() < 0.3 else f"{rng.getrandbits(256):064x}"
        else:
            p = 1 << 63 if rng.random() < 0.3 else rng.getrandbits(64)
            d, sha = rng.getrandbits(64), f"{rng.getrandbits(256):064x}"
        held.append((p, d, sha))
        ph = rng.choice([f"{p:016x}", f"{p:016X}", f"0x{p:x}", f" {p:x} "])
        dh = f"{d:016x}" if rng.random() > 0.05 else rng.choice([None, "", "zz"])
        rows.append((i, f"/a/{i}.png", rng.choice(["s1", " S2", None]), "c", rng.choice(["train", " Train ", "test", None]), 1, 1, "L", rng.choice([None, 0, 5, 9]), rng.choice([sha, sha.upper()]) if rng.random() > 0.1 else None, ph, dh, T0 + dt.timedelta(days=i), T0, 7, 8))
    older = [(*r[:9], "00", "ffff", "ffff", r[12] - dt.timedelta(days=400), T0 + dt.timedelta(days=900), 7, 8) for r in rows[: n // 10]]
    return rows + older + rows[:5]


def parse(h):
    try:
        return int(h.strip().lower().removeprefix("0x"), 16)
    except (AttributeError, ValueError):
        return None


def current(rows):
    best = {}
    for r in rows:
        if r[0] not in best or r[12] > best[r[0]][12]:
            best[r[0]] = r
    return {k: (parse(r[10]), parse(r[11]), (r[9] or "").lower(), r) for k, r in best.items()}


def near(a, b, t):
    return None not in (a[0], a[1], b[0], b[1]) and (a[0] ^ b[0]).bit_count() <= t and (a[1] ^ b[1]).bit_count() <= t


@pytest.fixture(scope="module")
def rows():
    return make_files(260)


@pytest.fixture(scope="module")
def files(spark, rows):
    return spark.createDataFrame(rows, FILES)


@pytest.fixture(scope="module")
def dataset(spark):
    rng = random.Random(5)
    out = [(f"/a/{i}.png", rng.choice([None, "", "N/A", "nan", " P1 ", "p1", f"p{i % 40}"]), rng.choice([None, "-", f"/m/{i}.png"]), rng.choice([None, " ", "G1", f"g{i % 50}"]), "x") for i in range(1, 200)]
    return spark.createDataFrame([*out, *out[:9], (None, "p3", None, "g1", "x")], DATASET)


@pytest.mark.parametrize("leaf", [512, 3, 1])
def test_pairs_equal_brute_force(files, rows, leaf):
    cur = current(rows)
    want = {(a, b) for a, b in itertools.combinations(sorted(cur), 2) if near(cur[a], cur[b], 4) or (cur[a][2] and cur[a][2] == cur[b][2])}
    got = image_groups.close_files(files, leaf=leaf, hot_rows=3 if leaf == 3 else 200_000).collect()
    assert {tuple(r) for r in got} == want
    assert len(got) == len(want)


def brute_groups(cur, dataset_rows):
    parent = {k: k for k in cur}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by_path = {v[3][1]: k for k, v in cur.items()}
    links = [(a, b) for a, b in itertools.combinations(cur, 2) if near(cur[a], cur[b], 2)]
    known = {}
    for r in dataset_rows:
        p = (r[1] or "").strip().lower()
        if p not in ("", "n/a", "nan", "-") and r[0] in by_path:
            known.setdefault(p, []).append(by_path[r[0]])
    links += [(v[0], x) for v in known.values() for x in v[1:]]
    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    groups = {}
    for k in cur:
        groups.setdefault(find(k), []).append(k)
    return {(k, min(g)) for g in groups.values() if len(g) > 1 for k in g}


@pytest.mark.parametrize("hot", [200_000, 2])
def test_groups_equal_brute_force(files, rows, dataset, hot):
    got = image_groups.file_groups(files, dataset, leaf=2, hot_rows=hot)
    assert {tuple(r) for r in got.collect()} == brute_groups(current(rows), dataset.collect())


def test_chain_and_star_components(spark):
    n = 300
    links = [(i, i + 1) for i in range(n)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5, 5), (None, 3), (7, None)]
    df = spark.createDataFrame(links * 2, "a bigint, b bigint")
    got = dict(map(tuple, components.connected_components(df, Staging(spark, "t"), hot_rows=10).collect()))
    assert got == {**{i: 0 for i in range(n + 1)}, **{1000 + i: 1000 for i in range(200)}}


def test_shares_cover_all_positions():
    for k in (2, 4):
        masks = share_join.position_shares(k, range(64), "s")
        assert len(masks) == k + 1
        assert sum(m % (1 << 64) for m in masks) == (1 << 64) - 1


def random_classes(n, seed, hot=0.0):
    """Hash pairs of which half are near copies of others; a share of them has one p."""
    rng = random.Random(seed)
    held = {}
    while len(held) < n:
        if held and rng.random() < 0.5:
            p, d = rng.choice(list(held)[:200])
            p, d = flip(p, rng.randrange(5), rng), flip(d, rng.randrange(5), rng)
        else:
            p, d = (7 if rng.random() < hot else rng.getrandbits(64)), rng.getrandbits(64)
        held.setdefault((p, d), len(held) + 1)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return [(i, signed(p), signed(d)) for (p, d), i in held.items()]


@pytest.mark.parametrize(("leaf", "hot"), [(64, 0.0), (16, 0.4)])
def test_chosen_paths_reach_their_recall(spark, leaf, hot):
    data = random_classes(1500, 3, hot)
    df = spark.createDataFrame(data, "rep bigint, p bigint, d bigint")
    staging = Staging(spark, "cp")
    levels, trees = chosen_path.plan(1500, 4, leaf, 1e-5)
    assert levels >= 4 and trees > 5  # the tree is really walked
    want = {tuple(r) for r in share_join.close_pairs(df, 4, staging).collect()}
    got = [tuple(r) for r in chosen_path.near_pairs(df, 4, staging, leaf).collect()]
    assert len(got) == len(set(got)) and set(got) <= want and len(got) >= 0.999 * len(want) > 300
    few = {tuple(r) for r in chosen_path.near_pairs(df, 4, staging, leaf, miss=0.3).collect()}
    assert 0.7 <= len(few & want) / len(want)


def test_large_nodes_are_compared_in_blocks(spark):
    near = random_classes(1, 1)[0][1:]
    data = [(i, near[0], near[1] ^ (1 << (i % 63)) ^ (1 << (i // 63))) for i in range(1, 63 * 5)]
    data = [(i, p, d) for i, (p, d) in enumerate({(p, d) for _, p, d in data})]
    df = spark.createDataFrame(data, "rep bigint, p bigint, d bigint")
    staging = Staging(spark, "dense")
    want = {tuple(sorted((a[0], b[0]))) for a, b in itertools.combinations(data, 2) if (a[2] ^ b[2]).bit_count() <= 4}
    assert {tuple(r)[:2] for r in chosen_path.near_pairs(df, 4, staging, leaf=4).collect()} == want
    assert {tuple(r)[:2] for r in share_join.close_pairs(df, 4, staging, leaf=4).collect()} == want


def test_hot_keys_are_spread(spark):
    rows = spark.createDataFrame([("h", i) for i in range(90)] + [("c", 100), ("d", 101)], "k string, i int")
    other = spark.createDataFrame([("h", "x"), ("h", "y"), ("c", "z"), ("e", "w")], "k string, v string")
    sizes = Staging(spark, "sizes").keep(rows.groupBy("k").count().withColumnRenamed("count", "n"))
    for how in ("inner", "left", "right"):
        got = skew.spread_join(rows, other, ["k"], sizes, ["i"], how, hot_rows=10)
        assert sorted(got.select("k", "i", "v").collect(), key=str) == sorted(rows.join(other, "k", how).select("k", "i", "v").collect(), key=str)
    pairs = skew.pairs_within(rows.join(sizes, "k"), "k", "i", block=7)
    assert sorted((r.a, r.b) for r in pairs.collect()) == list(itertools.combinations(range(90), 2))


def test_overlaps_equal_brute_force(spark, files, rows):
    rng = random.Random(9)
    cur = current(rows)
    ext = []
    for i in range(80):
        c = cur[rng.choice(list(cur))]
        p, d = flip(c[0] or 0, rng.choice([0, 1, 2, 3]), rng), flip(c[1] or 0, rng.choice([0, 1, 2, 3]), rng)
        folder = rng.choice(["Val", "testing", "TEST", "train", "other"])
        ext.append((f"/{i}/{folder}/test.png" if i % 2 else f"/{i}/{folder}/x.png", f"{p:016x}", f"{d:016x}" if i % 9 else None, c[2] if i % 5 == 0 else None))
    ext += [*ext[:3], (None, "1", "1", "ab")]
    m = spark.createDataFrame(ext, "path string, phash string, dhash string, sha256 string")
    want = set()
    for e in ext:
        if e[0] and e[0].lower().split("/")[2] in ("val", "testing", "test"):
            for v in cur.values():
                if (v[3][4] or "").strip().lower() == "train" and (near((parse(e[1]), parse(e[2])), v, 2) or (e[3] and e[3] == v[2])):
                    want.add((e[0], v[3][1]))
    for hot in (200_000, 1):
        got = [tuple(r)[:2] for r in split_overlap.overlaps(m, files, hot_rows=hot).collect()]
        assert set(got) == want and len(got) == len(want)


def test_segment_places_allow_shifts():
    assert [p for p in split_overlap.positions(2) if p[0] == 1] == [(1, 20, 21), (1, 21, 21), (1, 22, 21)]


def test_survivors(spark):
    trust = spark.createDataFrame([("a", 1), ("b", 2)], "source string, trust_rank int")
    at = T0
    base = lambda i, source, size, p="1": (i, f"/{i}", source, None, None, 1, 1, "L", size, None, p, "2", at, at, 1, 1)
    f = spark.createDataFrame([base(1, "B", 10), base(2, " A ", 0), base(3, "a", None), base(4, "zz", 99), base(5, "a", 1, "9")], FILES)
    d = spark.createDataFrame([("/1", "P9", "/m/1", None, ""), ("/2", "nan", None, None, ""), ("/3", None, "/m/3", None, ""), ("/4", "p4", None, None, "")], DATASET)
    for hot in (200_000, 1):
        assert [tuple(r) for r in image_groups.survivors(f, d, trust, hot_rows=hot).collect()] == [(1, 3, "p9", "/m/3")]


def test_blocks_and_splits(spark, dataset):
    rows = {tuple(r)[:4] for r in dataset.collect() if r[0]}
    splits = spark.createDataFrame([(p, i % 3 if i % 7 else None) for i, (p, *_) in enumerate(sorted(rows, key=str))] + [("/gone", 1), ("/gone", 2), (None, 1)], "path string, outer_fold int")
    got = {r[0] for r in entity_splits.split_breaches(dataset, splits, hot_rows=3).collect()}
    blocks = {tuple(r) for r in entity_splits.record_blocks(dataset, Staging(spark, "b")).collect()}
    block_of = dict(blocks)
    assert len(blocks) == len(block_of) == len({p for p, *_ in rows})
    fold = {}
    for r in splits.where("outer_fold is not null and path is not null").collect():
        fold.setdefault(block_of.get(r[0], r[0]), set()).add(r[1])
    assert got == {r[0] for r in splits.where("outer_fold is not null and path is not null").collect() if len(fold[block_of.get(r[0], r[0])]) > 1}
    targets = spark.createDataFrame([("train", 0.7), ("test", 0.3), (None, 0.1)], "split_name string, target_share double")
    made = entity_splits.assign_splits(dataset, targets).collect()
    assert len(made) == len(block_of)
    assert all(len({r["split_name"] for r in made if r["block"] == b}) == 1 for b in {r["block"] for r in made})
    assert entity_splits.assign_splits(dataset, targets.where("false")).count() == 0


def test_every_entity_of_a_path_is_tied(spark):
    rows = [("/a", None, None, "g1", "x"), ("/a", None, None, "g2", "x"), ("/a", "p9", None, "g3", "x"), ("/b", None, None, "G2 ", "x"), ("/c", "P9", None, None, "x"), ("/d", None, None, "g4", "x")]
    got = dict(map(tuple, entity_splits.record_blocks(spark.createDataFrame(rows, DATASET), Staging(spark, "t")).collect()))
    assert got["/a"] == got["/b"] == got["/c"] != got["/d"]
    many = spark.createDataFrame([(f"s{i}", 1.0) for i in range(entity_splits.CELLS + 1)], "split_name string, target_share double")
    with pytest.raises(ValueError, match="splits"):
        entity_splits.assign_splits(spark.createDataFrame(rows, DATASET), many)


def test_empty_tables(spark, files, dataset):
    f, d = files.where("false"), dataset.where("false")
    trust = spark.createDataFrame([], "source string, trust_rank int")
    m = spark.createDataFrame([], "path string, phash string, dhash string, sha256 string")
    assert image_groups.file_groups(f, d).count() == 0
    assert image_groups.close_files(f).count() == 0
    assert image_groups.survivors(f, d, trust).count() == 0
    assert split_overlap.overlaps(m, f).count() == 0
    assert entity_splits.split_breaches(d, spark.createDataFrame([], "path string, outer_fold int")).count() == 0


def test_class_links_count_every_file_and_equal_digests(spark):
    data = [*make_files(150, seed=5), *[(900 + i, f"/b/{i}.png", "s1", "c", "train", 1, 1, "L", 1, sha, None, "00", T0, T0, 7, 8) for i, sha in enumerate(["ab" * 32, "AB" * 32, None])]]
    newest = {}
    for r in data:
        if r[0] not in newest or r[12] > newest[r[0]][12]:
            newest[r[0]] = r
    units, digest = {}, {}
    for i, r in newest.items():
        p, d = parse(r[10]), parse(r[11])
        units[i] = (p, d) if p is not None and d is not None else i
        digest[i] = r[9].lower() if r[9] else None
    close = lambda x, y: not isinstance(x, int) and not isinstance(y, int) and all(bin(a ^ b).count("1") <= 4 for a, b in zip(x, y))
    want = {}
    for i, u in units.items():
        same = [j for j in units if units[j] == u] if not isinstance(u, int) else []
        signed = [j for j in units if digest[i] and digest[j] == digest[i]]
        others = {units[j] for j in signed} - {u}
        near = {x for x in units.values() if x != u and close(x, u)}
        want[i] = (min(same, default=None), len(same) or None, len(near), min(signed, default=None), len(signed) or None, len(others - near))
    df = spark.createDataFrame(data, FILES)
    assert sum(w[5] > 0 for w in want.values()) > 2 and want[900][5] == want[901][5] == 1
    for hot in (components.HOT_ROWS, 1):
        assert {r[0]: tuple(r[1:]) for r in image_groups.class_links(df, hot_rows=hot).collect()} == want
    assert image_groups.class_links(df.where("false")).count() == 0
