"""Leaks, mixes and repairs against brute force, round trips and their defined edge cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import encoding, mixing, tiling

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, span string, item_id bigint"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None, "x", 1) for i, t, s in rows], DOCS)


def longest_run(a, b):
    best = 0
    for i in range(len(a)):
        for j in range(len(b)):
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            best = max(best, n)
    return best


@pytest.mark.parametrize("limit", [tiling.BLOCK_SEEDS, 60, 1])
def test_leaks_equal_brute_force(spark, limit):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([5, 14, 40])))) for i in range(12)]
    texts = []
    for i in range(40):
        body = rng.choices([*words, "other"], k=60)
        if i % 2:
            src = rng.choice(items)[1].split()
            n, at = rng.choice([11, 12, 13, 30]), rng.randrange(0, 20)
            body[at:at] = src[:n]
        sep = rng.choice([" ", ", ", "\n", "_", "-"])
        text = sep.join(body)
        texts.append((i, text.upper() if i % 3 == 0 else text, "s"))
    texts += [(90, None, "s"), (91, "", "s"), (92, "ab " * 20_000, "s"), texts[1]]
    its = spark.createDataFrame([*items, (70, None), (71, "")], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.longest for r in tiling.leaks(docs(spark, texts), its, block_seeds=limit).collect()}
    want = {}
    for d, t, _ in texts:
        for i, x in items:
            n = longest_run(tiling.words_of(t)[:200], tiling.words_of(x))
            if n >= 12:
                want[d, i] = n
    assert got == want


def test_tiles_find_reordered_pieces():
    item = np.arange(1, 41, dtype=np.uint64)
    doc = np.concatenate([item[20:40], np.zeros(3, np.uint64), item[:20]])
    made = tiling.tiles(doc, item, 5)
    assert sorted(n for _, _, n in made) == [20, 20]
    assert tiling.tiles(np.empty(0, np.uint64), item, 5) == []


def test_tiles_of_relevant_runs_are_those_of_the_whole():
    rng = np.random.default_rng(4)
    for _ in range(60):
        item = rng.integers(1, 6, rng.integers(5, 30)).astype(np.uint64)
        doc = np.where(rng.random(80) < 0.2, 0, rng.integers(1, 6, 80)).astype(np.uint64)
        size = lambda made: (max((n for *_, n in made), default=0), sum(n for *_, n in made))
        assert size(tiling.tiles(doc, item, 4)) == size(tiling.tiles(tiling.relevant(doc, item, 4), item, 4))


def test_words_fold_case():
    assert tiling.words_of("Straße_İki ILIK-x2") == tiling.words_of("STRASSE iki ılık X2")


def test_flow_is_cheapest():
    flow = mixing.plan_flow({("a",): 100, ("a", "b"): 100, ("b",): 10}, {"a": (0.5, 3), "b": (0.5, 1)})
    a, b = (sum(v for (_, s), v in flow.items() if s == x) for x in "ab")
    assert a == b == 110
    assert mixing.plan_flow({}, {"a": (1.0, 1)}) == {}


def test_mix_reaches_shares(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, f"text number {i} " + "word " * rng.randrange(1, 60), rng.choice(["A", " a", "b", "c", None])) for i in range(400)]
    rows += [(1000 + i, rows[i][1], "b") for i in range(50)] + [(2000, None, "a"), (2001, "", "b"), rows[0]]
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 4), ("c", 0.2, 2), ("gone", 0.1, 1)], "source string, target_share double, max_repeats int")
    d = docs(spark, rows)
    used = mixing.mix(d, targets).collect()
    assert all(r["copies"] <= {"a": 1, "b": 4, "c": 2}[r["source"]] for r in used)
    got = {r["source"]: r for r in mixing.shares(d, targets).collect()}
    assert got["gone"]["mixed_tokens"] == 0
    for s, share in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
        assert abs(got[s]["actual_share"] - share) < 0.01
    assert mixing.mix(d.where("false"), targets).count() == 0
    assert mixing.mix(d, targets.where("false")).count() == 0
    with pytest.raises(ValueError, match="sources"):
        monkeypatch.setattr(mixing, "MOST", 2)
        mixing.mix(d, targets)


def test_undo_inverts_chains():
    for text in ("déjà vu – naïve", "źródło", "Проверка", "€ 5 “so”"):
        for read in ("latin-1", "cp437", "cp850", "mac_roman"):
            bad = text.encode("utf-8").decode(read)
            fixed = encoding.RUN.sub(lambda m, read=read: encoding.undo_utf8(m.group(), read) or m.group(), bad)
            assert fixed == text
    assert encoding.undo_utf8("éà", "cp1252") is None


def test_chains_of_any_length_are_undone():
    text = "modèle été"
    bad = text
    for _ in range(4):
        bad = bad.encode("utf-8").decode("latin-1")
    assert "è" in {r for _, r in encoding.candidates(encoding.RUN.findall(bad)[0])}
    assert all(c in encoding.CHAINS for c, _ in encoding.candidates(encoding.RUN.findall(bad)[0]))


def test_repairs_by_place_and_once_per_id(spark):
    clean = ["Le modèle a été réévalué à Genève.", "Größe und Schärfe der Schichten", "El año pasado se añadió señal."]
    rows = [(i, f"{clean[i % 3]} Row {i}.", "s1") for i in range(300)]
    wanted = {}
    for j in range(60):
        text, steps = clean[j % 3], 1 + (j % 3 == 2) * 2
        bad = text
        for _ in range(steps):
            bad = bad.encode("utf-8").decode("latin-1")
        wanted[1000 + j] = text
        rows.append((1000 + j, bad, "s1"))
    rows += [rows[310], rows[310]]
    got = encoding.repaired(docs(spark, rows)).collect()
    assert len(got) == len({r["doc_id"] for r in got}) == len(wanted)
    right = sum(r["text"] == wanted[r["doc_id"]] and r["n_left"] == 0 for r in got)
    assert right / len(wanted) >= 0.95
    both = docs(spark, rows).withColumn("lang", F.col("text"))
    assert {r["field"] for r in encoding.repaired(both, fields=("text", "lang")).collect()} == {"text", "lang"}


def test_garbled_documents(spark):
    clean = ["Le modèle a été réévalué à Genève.", "Größe und Schärfe der Schichten", "El año pasado se añadió señal.", "A façade of skill – naïve “so”."]
    rows = [(i, f"{clean[i % 4]} Row {i}.", f"s{i % 3}") for i in range(400)]
    bad = {}
    for j, read in enumerate(["latin-1", "cp1252", "mac_roman", "cp437"] * 5):
        text = clean[j % 4]
        bad[1000 + j] = text
        raw = text.encode("utf-8")
        garbled = "".join(bytes([b]).decode(read, "replace") if bytes([b]).decode(read, "ignore") else chr(b) for b in raw) if read != "mac_roman" else raw.decode(read)
        rows.append((1000 + j, garbled, "s1"))
    rows += [(2000, "lost � here", None), (2001, None, "s1"), (2002, "", "s1"), (2003, "ASCII " * 30_000, None), rows[400]]
    d = docs(spark, rows)
    assert {r["doc_id"] for r in encoding.garbled(d).select("doc_id").collect()} == {*bad, 2000}
    fixed = {r["doc_id"]: r["text"] for r in encoding.repaired(d).collect()}
    assert {k: fixed[k] for k in bad} == bad
    assert encoding.garbled(d.where("false")).count() == 0
