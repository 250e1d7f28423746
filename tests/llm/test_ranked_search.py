"""Ranked search against plain loops over all documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tessera.llm import ranked_search
from tessera.llm.ranked_search import Search, search


def _terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def _brute(docs, items, k):
    found = [(i, _terms(t)) for i, t in docs]
    found = [(i, t) for i, t in found if t]
    n_docs, total = len(found), sum(len(t) for _, t in found)
    df = Counter(x for _, t in found for x in set(t))
    wanted = {}
    for item, text in items:
        if item is not None:
            wanted.setdefault(item, set()).update(_terms(text))
    out = []
    for item, terms in wanted.items():
        rows = []
        for doc, t in found:
            tf, m = Counter(t), 50 + (50 * len(t) * n_docs) // total
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * ((1_000_000_000 * tf[x]) // (1000 * tf[x] + 20 * m)) for x in terms if tf[x]
            )
            if score > 0 and doc is not None:
                rows.append((-score, doc))
        out += [(item, r, d, -s) for r, (s, d) in enumerate(sorted(rows)[:k], 1)]
    return sorted(out)


def _run(spark, docs, items, p):
    left = spark.createDataFrame([(i, t, "z", 5) for i, t in docs], "doc_id bigint, text string, item_id string, score int")
    right = spark.createDataFrame([(i, t, "q") for i, t in items], "item_id bigint, text string, doc_id string")
    return sorted(tuple(r) for r in search(left, right, p).select("item_id", "rank", "doc_id", "score").collect())


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.choice([1, 3, 20, 200])))) for i in range(400)]
    items = [(i, " ".join(rng.choices(words, k=12))) for i in range(25)]
    return docs, items


@pytest.mark.parametrize("p", [Search(k=3), Search(k=3, block_terms=60), Search(k=50, cells=70)])
def test_against_a_plain_loop(spark, corpus, p):
    assert _run(spark, *corpus, p) == _brute(*corpus, p.k)


def test_edges(spark):
    docs = [
        (1, "Alpha beta"), (2, "alpha BETA"), (3, None), (4, ""), (5, "... !!"), (None, "alpha gamma"), (6, "É alpha_beta"), (6, "alpha"), (7, "alpha " * 9000), (8, "delta-delta"),
    ]
    items = [(1, "alpha beta beta"), (1, "delta"), (2, None), (3, "nothing here"), (None, "alpha"), (4, "É é"), (5, "gamma")]
    assert _run(spark, docs, items, Search(k=4)) == _brute(docs, items, 4)
    assert _run(spark, docs, [], Search()) == [] == _run(spark, [], items, Search()) == _run(spark, [(1, "...")], items, Search())


def test_terms_below_the_threshold_are_not_looked_up():
    statistics = {0: (1000, 500_000, 400_000), 1: (5, 900_000, 0), 2: (60, 900_000, 800_000)}
    plan = ranked_search._plan([(0, 0), (0, 1), (0, 2)], 1, statistics, 3, 1000, 50_000, Search())
    assert plan.essential[0] == plan.start[0]  # the common term's own bound is below the k-th score of the rarest
    assert plan.essential[1] == plan.start[2] and plan.bound[0] == math.floor(1000 * math.log(2002 / 121)) * 800_000


def test_thresholds_rise_with_exact_scores_only():
    plan = ranked_search.Plan(*(np.zeros(1, np.int64),) * 5, np.ones(2, np.int64), 1, 1, 2, 10)
    seen = ranked_search._Thresholds(plan)
    seen.see(np.array([0, 1, 0]), np.array([5, 9, 7]))
    assert seen.bound.tolist() == [5, 1]
    seen.see(np.array([0]), np.array([6]))
    assert seen.bound.tolist() == [6, 1]
