"""Trained models: held-out accuracy on a small corpus, and edge cases."""

import math
import random
from functools import partial

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.llm import quality_model, toxicity
from tessera.llm.common import crc_mod


def corpus(n=500, seed=3):
    rng = random.Random(seed)
    syllables = ["the", "er", "on", "ing", "ha", "nd", "re", "ou", "at", "es"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    docs, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randint(20, 150))]
        toxic, good = rng.random() < 0.2, rng.random() < 0.7
        if toxic:
            for _ in range(rng.randint(2, 6)):
                words.insert(rng.randrange(len(words)), "vequ" + rng.choice(["ta", "mo", "sse", "aire", word()]))
        if not good:
            words = [w.upper() + "!!" for w in words] if rng.random() < 0.5 else [w for w in words[:20] for _ in range(6)]
        docs.append((i, " ".join(words)))
        labels.append((i, int(good), int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark, documents):
    docs, labels = corpus()
    return documents(docs), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), labels


def accuracy(scores, labels, at, mod, rest):
    import zlib

    held = [r for r in labels if zlib.crc32(str(r[0]).encode()) % mod == rest]
    return np.mean([(scores[r[0]] >= 0.5) == bool(r[at]) for r in held])


def test_quality_on_held_out_rows(tables):
    docs, labels, rows = tables
    weights = quality_model.fit(docs, labels, crc_mod(F.col("doc_id"), 3) != 1)
    scores = {r.doc_id: r["_q_score"] for r in quality_model.scored(docs, weights).collect()}
    assert accuracy(scores, rows, 1, 3, 1) > 0.95
    assert quality_model.scored(docs, weights).columns == [*docs.columns, "_q_score"]


def test_toxicity_on_held_out_rows(tables):
    docs, labels, rows = tables
    scores = {r.doc_id: r.score for r in toxicity.toxicity(docs, labels, crc_mod(F.col("doc_id"), 5) != 0).collect()}
    assert accuracy(scores, rows, 2, 5, 0) > 0.95


def test_edges(spark, documents):
    docs = documents([(1, None), (2, ""), (None, "a b"), (3, "x" * 100_000), (3, "x" * 100_000)])
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    some = spark.createDataFrame([(1, 1, 1), (1, 1, 0), (None, 1, 1), (2, None, None), (3, 0, 0)], "doc_id bigint, quality int, toxic int")
    for labels in (none, some):
        weights = quality_model.fit(docs, labels, F.lit(True))
        quality = quality_model.scored(docs, weights, keep=["doc_id"]).collect()
        toxic = toxicity.toxicity(docs, labels, F.lit(True)).collect()
        for got in ([r["_q_score"] for r in quality], [r.score for r in toxic]):
            assert len(got) == 5 and all(0 <= s <= 1 for s in got)
    empty = documents([])
    assert quality_model.scored(empty, weights).count() == 0 and toxicity.toxicity(empty, some, F.lit(True)).count() == 0


def plain_models(counts, order, d, dc):
    """The shared and the two class models by plain recursion over dictionaries: likelihood(class or None, context, character)."""
    whole = [{}, {}, {}]
    for word, *n in counts:
        s = "\x02" + word + "\x03"
        for j in range(1, len(s)):
            for i in range(max(0, j - order + 1), j + 1):
                for k, x in enumerate((*n, sum(n))):
                    whole[k][s[i : j + 1]] = whole[k].get(s[i : j + 1], 0) + x
    letters = len({g for g in whole[2] if len(g) == 1}) + 1

    def value(g):
        if len(g) == order or g[0] == "\x02":
            return whole[2][g]
        return len({h[0] for h in whole[2] if len(h) == len(g) + 1 and h[1:] == g})

    def after(h):
        return [g for g in whole[2] if len(g) == len(h) + 1 and g.startswith(h)]

    def shared(h, x):
        low = shared(h[1:], x) if h else 1 / letters
        seen = [value(g) for g in after(h)]
        if not seen:
            return low
        own = max(value(h + x) - d, 0) if h + x in whole[2] else 0
        return own / sum(seen) + d * len(seen) / sum(seen) * low

    def of_class(k, h, x):
        n = [whole[k][g] for g in after(h)]
        if not sum(n):
            return shared(h, x)
        return max(whole[k].get(h + x, 0) - dc, 0) / sum(n) + sum(min(v, dc) for v in n) / sum(n) * shared(h, x)

    return of_class, shared, sorted({g for g in whole[2] if len(g) == 1})


def test_ratios_are_those_of_the_plain_models(spark):
    counts = [("the", 9, 1), ("vequ", 0, 6), ("then", 4, 0), ("equine", 3, 2), ("hat", 1, 1), ("tata", 5, 3)]
    p = toxicity.Kneser(order=4)
    of_class, shared, letters = plain_models(counts, 4, p.discount, p.class_discount)
    grams = spark.createDataFrame(counts, "word string, n0 long, n1 long").mapInArrow(partial(toxicity._grams, order=4), "gram string, n0 long, n1 long")
    found = toxicity.ratios(grams.groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), p)
    by = {(r.gram, r.whole): r.ratio for r in found.collect()}
    e = toxicity.Evidence(*toxicity.packed(found, p.bits), p)
    for word in ("the", "vequ", "thequ", "vex", "zz", "tatatata"):
        s = "\x02" + word + "\x03"
        want = 0.0
        for j in range(1, len(s)):
            h = s[max(0, j - 3) : j]
            want += math.log(of_class(1, h, s[j]) / of_class(0, h, s[j]))
            if (h + s[j], True) in by:
                assert by[h + s[j], True] == pytest.approx(math.log(of_class(1, h, s[j]) / of_class(0, h, s[j])))
        assert e.ratio(word) == pytest.approx(want, abs=1e-5)
        assert e[word] == pytest.approx(math.log(1 + p.rate * (math.exp(want) - 1)), abs=1e-5)
    assert e["vequ"] > 0 > e["then"]
    for h in ("\x02th", "equ", "zzz"):  # every model is a distribution over the characters and one unknown
        rest = shared(h, "\x00")
        assert sum(shared(h, x) for x in letters) + rest == pytest.approx(1)
        assert sum(of_class(1, h, x) for x in letters) + of_class(1, h, "\x00") == pytest.approx(1)


def plain_ftrl(rows, p, bias):
    """FTRL-proximal over rows of (label, {bucket: value}), one coordinate at a time."""
    z, n = {}, {}

    def weight(k):
        if abs(z.get(k, 0.0)) <= p.l1:
            return 0.0
        return -(z[k] - math.copysign(p.l1, z[k])) / ((p.beta + math.sqrt(n.get(k, 0.0))) / p.alpha + p.l2)

    for label, x in rows:
        w = {k: weight(k) for k in x}
        g = 1 / (1 + math.exp(-(bias + sum(w[k] * v for k, v in x.items())))) - label
        for k, v in x.items():
            sigma = (math.sqrt(n.get(k, 0.0) + (g * v) ** 2) - math.sqrt(n.get(k, 0.0))) / p.alpha
            z[k] = z.get(k, 0.0) + g * v - sigma * w[k]
            n[k] = n.get(k, 0.0) + (g * v) ** 2
    return z, n


def test_ftrl_steps_are_those_of_a_plain_loop():
    rng = random.Random(4)
    p = quality_model.Ftrl(bits=6)
    rows = [(rng.randint(0, 1), {k: rng.uniform(0.1, 3) for k in rng.sample(range(64), 9)}) for _ in range(60)]
    places = list(range(60))
    rng.shuffle(places)
    frame = pd.DataFrame({
        "shard": 3, "place": places, "label": [r[0] for r in rows], "at": [np.array(list(r[1]), np.int32) for r in rows],
        "by": [np.array(list(r[1].values()), np.float32) for r in rows],
    })
    got = quality_model._train(frame, p, 0.3, np.zeros(64), np.zeros(64))
    ordered = [(r[0], {k: float(np.float32(v)) for k, v in r[1].items()}) for _, r in sorted(zip(places, rows))]
    z, n = plain_ftrl(ordered, p, 0.3)
    assert {k: pytest.approx(v) for k, v in z.items()} == dict(zip(got["bucket"], got["z"]))
    assert {k: pytest.approx(v) for k, v in n.items()} == dict(zip(got["bucket"], got["n"]))


def test_weights_do_not_depend_on_the_partitions(tables):
    docs, labels, _ = tables
    p = quality_model.Ftrl(rounds=2, bits=12, shards=3)
    one, two = (quality_model.fit(d, labels, F.lit(True), p=p) for d in (docs.coalesce(1), docs.orderBy(F.desc("text")).repartition(7)))
    assert np.array_equal(one, two)


def test_the_driver_gets_one_state_a_round(spark, tables, monkeypatch):
    """However many shards: what comes to the driver is one number of each kind a bucket, the mean over the shards that touched it."""
    docs, labels, _ = tables
    p = quality_model.Ftrl(rounds=3, bits=13, shards=6)
    frame, got = type(docs), []
    whole = frame.toArrow
    monkeypatch.setattr(frame, "toArrow", lambda self: got.append(whole(self)) or got[-1])
    weights = quality_model.fit(docs, labels, F.lit(True), p=p)
    assert len(got) == p.rounds and all(sum(c.nbytes for c in t.columns) <= (4 + 8 + 8) * 2**p.bits + 4096 for t in got)

    keyed = docs.drop("label").join(labels.select("doc_id", F.col("quality").alias("label")), "doc_id").select(
        F.pmod(F.xxhash64(F.lit("shard"), "doc_id"), F.lit(p.shards)).cast("int").alias("shard"), F.xxhash64(F.lit("place"), "doc_id", "text").alias("place"),
        "label", F.col("text").cast("binary").alias("text"),
    )
    rows = next(quality_model._vectors(iter(whole(keyed).combine_chunks().to_batches()), p)).to_pandas()
    z, n = np.zeros(2**p.bits), np.zeros(2**p.bits)
    bias = math.log((rows["label"].sum() + 1) / ((1 - rows["label"]).sum() + 1))
    for _ in range(p.rounds):
        ran = [quality_model._train(own, p, bias, z, n) for _, own in rows.groupby("shard")]
        assert len(ran) == p.shards
        for k in range(2**p.bits):
            touched = [(r["z"].to_numpy()[i], r["n"].to_numpy()[i]) for r in ran if (i := np.searchsorted(r["bucket"], k)) < len(r) and r["bucket"].to_numpy()[i] == k]
            if touched:
                z[k], n[k] = (sum(x) / len(touched) for x in zip(*touched))
    assert np.array_equal(weights, np.append(quality_model._weights(z, n, p), bias).astype(np.float32))


def test_shapes():
    assert quality_model.shape(b"Ab12!!") == b"Aa9!" and quality_model.shape("é".encode()) == b"a"
