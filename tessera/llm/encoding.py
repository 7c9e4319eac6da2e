"""Problem 10: text decoded in the wrong encoding, found and restored.

A *span* is a maximal run of characters outside ASCII. Each span has a latent chain: none, or a sequence of
(written as, read as) encodings that turned the original into what stands there. A chain is a candidate for a
span if undoing it works: the characters must be bytes of the encoding they were read as, and these bytes, or
maximal parts of them, must be well-formed in the encoding they were written as. Spans with a candidate are
weighed by expectation-maximization: the likelihood of a chain is that of the text it restores, in its place,
under a character model of the corpus; its prior is learned per source and field and shrunk towards that of the whole
corpus, so that weak evidence is pooled across records. Rounds go on until the likelihood settles. A span is garbled
where the posterior of "none" is below one half; it is restored by the most probable text, in its own place: the same
characters between other neighbours are judged by themselves. Replacement characters (U+FFFD) show a decoding that
lost its bytes: the document is affected, the lost character stays.

The character model counts which character follows which in and around spans, over all documents. It is learned
from spans that no UTF-8 chain can explain, and from those whose every explanation needs characters seen nowhere
else. Pairs are counted in a hashed table of ``TABLE`` cells and characters are bounded by Unicode, which bounds
the model whatever the size of the corpus.

Defined results: NULL and pure-ASCII texts are not affected; NULL sources form a pool of their own; repeated
rows are reported once per doc_id (of several texts under one id, the greatest repaired one); empty tables give
empty results.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Staging

#: Encodings UTF-8 bytes may have been read as.
READ_AS = ("cp1252", "latin-1", "cp1250", "cp1251", "cp1254", "cp437", "cp850", "cp866", "mac_roman", "koi8-r")
#: (written as, read as) pairs of single-byte encodings.
SINGLE = (("cp1250", "cp1252"), ("cp1251", "cp1252"), ("cp1254", "cp1252"), ("koi8-r", "cp1252"), ("koi8-r", "cp1251"), ("cp1251", "koi8-r"), ("cp866", "cp1251"), ("mac_roman", "cp1252"), ("cp850", "cp1252"), ("cp1252", "latin-1"))
#: Nats by which a single-byte chain must better a span to become a candidate; they have no structure to show.
SINGLE_GAIN = 5.0
LOST = "\ufffd"
NONE = "none"
#: All chains a prior is learned for; those of three and more steps count by their first two.
CHAINS = (NONE, *READ_AS, *(f"{a}>{b}{more}" for more in ("", ">...") for a in READ_AS for b in READ_AS), *(f"{a}:{b}" for a, b in SINGLE))
_CHAIN_NO = {c: i for i, c in enumerate(CHAINS)}
RUN = re.compile(r"[^\x00-\x7f]+")

_UTF8 = (
    r"(?:[\u00c2-\u00df][\u0080-\u00bf]|\u00e0[\u00a0-\u00bf][\u0080-\u00bf]|[\u00e1-\u00ec\u00ee\u00ef][\u0080-\u00bf]{2}"
    r"|\u00ed[\u0080-\u009f][\u0080-\u00bf]|\u00f0[\u0090-\u00bf][\u0080-\u00bf]{2}|[\u00f1-\u00f3][\u0080-\u00bf]{3})+"
)
_WELL_FORMED = re.compile(_UTF8)


@lru_cache(maxsize=None)
def _to_byte(encoding: str) -> dict[int, int]:
    """Translation of characters to the bytes (as U+0080..U+00FF) an encoding reads them from.

    Bytes an encoding leaves undefined were often passed through, so they stand for themselves.
    """
    out = {}
    for b in range(0x80, 0x100):
        try:
            out[ord(bytes([b]).decode(encoding))] = b
        except UnicodeDecodeError:
            out[b] = b
    return out


def undo_utf8(span: str, read_as: str) -> str | None:
    """The span with every well-formed part decoded again, None where there is none."""
    table = _to_byte(read_as)
    # characters that are no byte of the encoding separate parts; they must not look like bytes
    as_bytes = "".join(chr(table[ord(c)]) if ord(c) in table else "Ā" for c in span)
    if not _WELL_FORMED.search(as_bytes):
        return None
    out, at = [], 0
    for m in _WELL_FORMED.finditer(as_bytes):
        out += [span[at : m.start()], m.group().encode("latin-1").decode("utf-8")]
        at = m.end()
    return "".join([*out, span[at:]])


def undo_single(span: str, written_as: str, read_as: str) -> str | None:
    table = _to_byte(read_as)
    try:
        return bytes(table[ord(c)] for c in span).decode(written_as)
    except (KeyError, UnicodeDecodeError):
        return None


@lru_cache(maxsize=200_000)
def candidates(span: str) -> tuple[tuple[str, str], ...]:
    """(chain, restored) of every UTF-8 chain that can be undone, however many steps it has.

    Each step makes the span shorter, so there is an end to them. From the third step on a text that several chains
    lead to is followed once.
    """
    out: list[tuple[str, str]] = []
    todo, seen = [("", span, 0)], {span}
    while todo:
        chain, text, depth = todo.pop(0)
        if LOST in text:
            continue
        for read in READ_AS:
            made = undo_utf8(text, read)
            if made is not None and (depth < 2 or made not in seen):
                seen.add(made)
                name = read if depth == 0 else f"{chain}>{read}" if depth == 1 else chain if depth > 2 else f"{chain}>..."
                out.append((name, made))
                todo.append((name, made, depth + 1))
    return tuple(out)


def _context(char: str) -> str:
    """ASCII neighbours count as classes; nothing (the edge of the text) counts as a blank."""
    if not char or char.isspace():
        return " "
    if ord(char) > 127:
        return char
    return "a" if char.islower() else "A" if char.isupper() else "0" if char.isdigit() else "."


def _pairs(before: str, text: str, after: str) -> Iterator[tuple[str, str]]:
    """Neighbouring characters with at least one of them outside ASCII."""
    line = [_context(before), *map(_context, text), _context(after)]
    return zip(line, line[1:], strict=False)


def _cell(a: str, b: str) -> int:
    return (ord(a) * 1_000_003 + ord(b) * 7_919) % TABLE


class CharacterModel:
    """log P(b | a) from hashed pair counts, backed off to single characters, with a floor for unseen ones.

    The weight of the back-off grows with the corpus, so that garbled text of a given rarity, which is in the
    counts too where it has no structure of its own, stays improbable at every size.
    """

    def __init__(self, singles: dict[str, float], pairs: dict[int, float]):
        self.singles, self.pairs = singles, pairs
        self.total = sum(singles.values()) + 1.0
        self.weight = 2.0 + 1e-4 * self.total
        self.known: dict[tuple[str, str], float] = {}

    def step(self, a: str, b: str) -> float:
        if (a, b) not in self.known:
            back = max(self.singles.get(b, 0.0) / self.total, 1e-9)
            seen = self.pairs.get(_cell(a, b), 0.0) if a in self.singles and b in self.singles else 0.0
            self.known[a, b] = math.log((seen + self.weight * back) / (self.singles.get(a, 0.0) + self.weight))
        return self.known[a, b]

    def of(self, before: str, text: str, after: str) -> float:
        return sum(self.step(a, b) for a, b in _pairs(before, text, after))


#: Cells of the pair table.
TABLE = 1 << 20
#: Characters a restored text may hold without having been seen: letters and signs of Western text.
_WESTERN = frozenset(chr(c) for c in range(0xA1, 0x180)) | frozenset("\u2013\u2014\u2018\u2019\u201a\u201c\u201d\u201e\u2020\u2022\u2026\u2030\u20ac\u2122\u2212\u2264\u2265\u00a0")


def _readable(text: str) -> bool:
    """No control, private or unassigned characters."""
    return all(unicodedata.category(c)[0] != "C" for c in text)


def _weigh(before: str, span: str, after: str, model: CharacterModel) -> list[tuple[int, str, float]]:
    """Numbers of candidate chains with their log-likelihoods, "none" first; empty where "none" is the only one."""
    base = model.of(before, span, after)
    out = [(_CHAIN_NO[c], r, model.of(before, r, after)) for c, r in candidates(span)]
    if max((ll for _, _, ll in out), default=base) < base + SINGLE_GAIN:
        for written, read in SINGLE:
            restored = undo_single(span, written, read)
            if restored is not None and restored != span and _readable(restored) and (ll := model.of(before, restored, after)) - base >= SINGLE_GAIN:
                out.append((_CHAIN_NO[f"{written}:{read}"], restored, ll))
    return [(0, span, base), *out] if out else []


def _runs(text: str) -> Iterator[tuple[str, str, str]]:
    for m in RUN.finditer(text):
        yield text[m.start() - 1 : m.start()] if m.start() else "", m.group(), text[m.end() : m.end() + 1]


def character_model(docs: DataFrame, staging: Staging) -> CharacterModel:
    """The model of all documents; ``docs`` holds texts."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            plain: dict[tuple[str, str], int] = {}
            doubtful: dict[tuple[str, str, str], int] = {}
            for text in batch["text"]:
                for before, span, after in _runs(text):
                    if candidates(span):
                        key = (_context(before), span, _context(after))
                        doubtful[key] = doubtful.get(key, 0) + 1
                    else:
                        for pair in _pairs(before, span, after):
                            plain[pair] = plain.get(pair, 0) + 1
            rows = [(a, b, None, n) for (a, b), n in plain.items()] + [(a, b, span, n) for (a, span, b), n in doubtful.items()]
            yield pd.DataFrame(rows, columns=["a", "b", "span", "n"])

    seen = staging.keep(docs.select("text").mapInPandas(scan, "a string, b string, span string, n bigint").groupBy("a", "b", "span").agg(F.sum("n").alias("n")))
    singles: dict[str, float] = {}
    pairs: dict[int, float] = {}

    def learn(table: DataFrame) -> None:
        cell = F.pmod(F.ascii("a").cast("bigint") * 1_000_003 + F.ascii("b").cast("bigint") * 7_919, F.lit(TABLE))
        for r in table.groupBy(cell.alias("c")).agg(F.sum("n").alias("n")).collect():  # TABLE rows at most
            pairs[r["c"]] = pairs.get(r["c"], 0.0) + r["n"]
        for r in table.groupBy("a").agg(F.sum("n").alias("n")).collect():  # bounded by Unicode
            singles[r["a"]] = singles.get(r["a"], 0.0) + r["n"]

    learn(seen.where("span is null"))
    attested = frozenset(singles) | _WESTERN

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: dict[tuple[str, str], int] = {}
            for a, b, span, n in zip(batch["a"], batch["b"], batch["span"], batch["n"], strict=True):
                if all(any(ord(c) > 127 and c not in attested for c in restored) for _, restored in candidates(span)):
                    for pair in _pairs("" if a == " " else a, span, "" if b == " " else b):
                        out[pair] = out.get(pair, 0) + n
            yield pd.DataFrame([(*k, n) for k, n in out.items()], columns=["a", "b", "n"])

    learn(staging.keep(seen.where("span is not null").mapInPandas(settle, "a string, b string, n bigint")))
    return CharacterModel(singles, pairs)


_CAND = "array<struct<chain:int,restored:string,ll:double>>"


def _spans(docs: DataFrame, model: CharacterModel) -> DataFrame:
    """(doc_id, pool, before, span, after, n, cand) of spans with a candidate chain, and one row per batch and pool of
    the others."""
    sent = docs.sparkSession.sparkContext.broadcast((model.singles, model.pairs))  # bounded, see above

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = CharacterModel(*sent.value)
        known: dict[tuple[str, str, str], list] = {}
        for batch in batches:
            out, plain = [], {}
            for doc_id, pool, text in zip(batch["doc_id"], batch["pool"], batch["text"], strict=True):
                seen: dict[tuple[str, str, str], int] = {}
                for before, span, after in _runs(text):
                    key = (_context(before), span, _context(after))
                    seen[key] = seen.get(key, 0) + 1
                for key, n in seen.items():
                    if key not in known:
                        if len(known) > 200_000:
                            known.clear()
                        known[key] = _weigh("" if key[0] == " " else key[0], key[1], "" if key[2] == " " else key[2], own)
                    if known[key]:
                        out.append((doc_id, pool, *key, n, known[key]))
                    else:
                        plain[pool] = plain.get(pool, 0) + n
            out += [(None, p, None, None, None, n, None) for p, n in plain.items()]
            yield pd.DataFrame(out, columns=["doc_id", "pool", "before", "span", "after", "n", "cand"])

    return docs.select("doc_id", "pool", "text").mapInPandas(scan, f"doc_id bigint, pool string, before string, span string, after string, n bigint, cand {_CAND}")


_KEY = ["pool", "before", "span", "after"]


def _posteriors(keys: DataFrame, plain: DataFrame, staging: Staging, pooling: float, settled: float = 1e-5, most: int = 100) -> DataFrame:
    """keys (pool, before, span, after, n, cand) with ``w``, in proportion to the posterior of each candidate.

    Priors are learned per pool and chain. A round reads the keys once and reduces them to a weight per pool and
    chain; it is the last one when the mean log-likelihood grows by less than ``settled``.
    """
    top = F.array_max(F.transform("cand", lambda c: c["ll"]))
    # likelihoods relative to the best of a span, which no round changes
    keys = staging.keep(keys.select(*_KEY, "n", F.transform("cand", lambda c: F.struct(c["chain"], c["restored"], F.exp(c["ll"] - top).alias("x"))).alias("cand"), top.alias("top")))
    n_chains = len(CHAINS)

    def weighed(priors: DataFrame | None) -> DataFrame:
        if priors is None:
            rows, prior = keys, lambda c: F.when(c == 0, 0.98).otherwise(0.02 / (len(READ_AS) + len(SINGLE)))
        else:
            rows, prior = keys.join(priors, "pool"), lambda c: F.greatest(F.get("prior", c), F.lit(1e-6))
        w = F.transform("cand", lambda c: c["x"] * prior(c["chain"]))
        bound = rows.select(*_KEY, "n", "cand", "top", F.inline(F.array(F.struct(w.alias("w")))))  # w is computed once
        return bound.select("*", F.inline(F.array(F.struct(F.aggregate("w", F.lit(0.0), lambda a, x: a + x).alias("sum")))))

    priors, before = None, None
    for _ in range(most):
        rows = weighed(priors)
        share = F.zip_with("cand", "w", lambda c, w: F.struct(c["chain"].alias("chain"), (w / F.col("sum") * F.col("n")).alias("w"), F.when(c["chain"] == 0, (F.col("top") + F.log("sum")) * F.col("n")).alias("z")))
        clean = plain.select("pool", F.lit(0).alias("chain"), F.col("n").cast("double").alias("w"), F.lit(0.0).alias("z"))
        per = staging.keep(rows.select("pool", F.inline(share)).unionByName(clean).groupBy("pool", "chain").agg(F.sum("w").alias("w"), F.sum("z").alias("z")))
        overall = {r["chain"]: (r["w"], r["z"] or 0.0) for r in per.groupBy("chain").agg(F.sum("w").alias("w"), F.sum("z").alias("z")).collect()}  # one row per chain
        total = sum(w for w, _ in overall.values())
        if not total:
            break
        now = sum(z for _, z in overall.values()) / total
        if before is not None and abs(now - before) < settled:
            break
        before = now
        general = F.array(*[F.lit(pooling * overall.get(i, (0.0, 0.0))[0] / total) for i in range(n_chains)])
        own = per.groupBy("pool").agg(F.map_from_entries(F.collect_list(F.struct("chain", "w"))).alias("own"), F.sum("w").alias("all"))
        mixed = F.transform(general, lambda g, i: (F.coalesce(F.col("own")[i], F.lit(0.0)) + g) / (F.col("all") + F.lit(pooling)))
        priors = own.select("pool", mixed.alias("prior"))
    return weighed(priors)


def _texts(documents: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(doc_id, field, pool, text) of every text with a character outside ASCII."""
    named = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("text")) for f in fields])
    pool = F.concat_ws("\u0001", "field", F.coalesce(F.col("source").cast("string"), F.lit("\u0002")))
    rows = documents.where(F.col("doc_id").isNotNull()).select("doc_id", "source", F.inline(named))
    return rows.where(F.col("text").rlike(r"[^\x00-\x7F]")).select("doc_id", "field", pool.alias("pool"), "text")


def weighed_spans(documents: DataFrame, fields: Sequence[str] = ("text",), pooling: float = 50.0) -> tuple[DataFrame, DataFrame]:
    """Stored garbled spans (doc_id, pool, before, span, after, n, restored), and the texts they come from."""
    staging = Staging(documents.sparkSession, "encoding")
    docs = _texts(documents, fields)
    spans = staging.keep(_spans(docs, character_model(docs, staging)))
    doubtful = spans.where("cand is not null")
    # equal spans between equal neighbours in one pool have one posterior, however many documents hold them
    keys = staging.keep(doubtful.groupBy(*_KEY, "cand").agg(F.sum("n").alias("n")))
    plain = staging.keep(spans.where("cand is null").groupBy("pool").agg(F.sum("n").alias("n")))
    post = _posteriors(keys, plain, staging, pooling)
    chosen = F.zip_with("cand", "w", lambda c, w: F.struct(c["restored"].alias("restored"), (w / F.col("sum")).alias("p")))
    each = post.select(*_KEY, F.inline(chosen)).groupBy(*_KEY, "restored").agg(F.sum("p").alias("p"))
    same = F.col("restored") == F.col("span")
    judged = each.groupBy(*_KEY).agg(F.sum(F.when(same, F.col("p")).otherwise(0.0)).alias("p_none"), F.max(F.when(~same, F.struct("p", "restored"))).alias("best"))
    wrong = staging.keep(judged.where("p_none < 0.5").select(*_KEY, F.col("best.restored").alias("restored")))
    return staging.keep(doubtful.select("doc_id", *_KEY, "n").join(wrong, _KEY)), docs


def _n_lost(text: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(LOST), F.lit("")))).cast("bigint")


def garbled(documents: DataFrame, fields: Sequence[str] = ("text",), pooling: float = 50.0) -> DataFrame:
    """(doc_id, n_spans, n_lost): documents with wrongly decoded text, regainable or not."""
    spans, docs = weighed_spans(documents, fields, pooling)
    wrong = spans.select("doc_id", F.col("n").alias("k"), F.lit(0).cast("bigint").alias("l"))
    lost = docs.where(F.col("text").contains(LOST)).select("doc_id", F.lit(0).cast("bigint").alias("k"), _n_lost("text").alias("l"))
    return wrong.unionByName(lost).groupBy("doc_id").agg(F.sum("k").alias("n_spans"), F.max("l").alias("n_lost"))


def repaired(documents: DataFrame, fields: Sequence[str] = ("text",), pooling: float = 50.0) -> DataFrame:
    """(doc_id, field, n_spans, n_left, n_lost, text): affected texts, restored as far as they can be.

    ``n_spans`` counts the spans that were restored, ``n_left`` those of them that still look wrongly decoded or
    hold a lost character, ``n_lost`` the lost characters in the whole text.
    """
    spans, docs = weighed_spans(documents, fields, pooling)
    fixes = spans.groupBy("doc_id", "pool").agg(F.collect_set(F.struct("before", "span", "after", "restored")).alias("fix"))  # spans of one document
    joined = docs.join(fixes, ["doc_id", "pool"], "left").where(F.col("fix").isNotNull() | F.col("text").contains(LOST)).select("doc_id", "field", _n_lost("text").alias("n_lost"), "text", "fix")

    def mend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = []
            for text, fix in zip(batch["text"], batch["fix"], strict=True):
                known = {(f["before"], f["span"], f["after"]): f["restored"] for f in fix} if fix is not None else {}
                n = [0, 0]

                def put(m, text=text, known=known, n=n):
                    key = (_context(text[m.start() - 1 : m.start()] if m.start() else ""), m.group(), _context(text[m.end() : m.end() + 1]))
                    if key not in known:
                        return m.group()
                    n[0] += 1
                    n[1] += LOST in known[key] or bool(candidates(known[key]))
                    return known[key]

                made.append((RUN.sub(put, text), *n))
            done = pd.DataFrame(made, columns=["text", "n_spans", "n_left"])
            yield pd.DataFrame({"doc_id": batch["doc_id"], "field": batch["field"], "n_spans": done["n_spans"], "n_left": done["n_left"], "n_lost": batch["n_lost"], "text": done["text"]})

    cols = ["n_spans", "n_left", "n_lost", "text"]
    mended = joined.mapInPandas(mend, "doc_id bigint, field string, n_spans bigint, n_left bigint, n_lost bigint, text string")
    mended = mended.where("n_spans > 0 or n_lost > 0")
    return mended.groupBy("doc_id", "field").agg(F.max(F.struct("text", *cols[:3])).alias("r")).select("doc_id", "field", *[f"r.{c}" for c in cols])
