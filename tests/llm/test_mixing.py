"""Pfair mixing: deviation, order, whole results."""

from collections import Counter, defaultdict

from tessera.llm.mixing import mix, mixed, sweep


def rows_of(sizes):
    return [(i, "t", "en", s, 1) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]


def check_deviation(found, weights, block):
    blocks = {(r.source, r.block): r.slot for r in found}
    assert len(set(blocks.values())) == len(blocks)
    last = {s: max(slot for (x, _), slot in blocks.items() if x == s) for s in weights}
    total = sum(weights.values())
    for s, w in weights.items():
        slots = sorted(slot for (x, _), slot in blocks.items() if x == s)
        done = 0
        for t in range(last[s] + 1):
            if done < len(slots) and slots[done] == t:
                done += 1
            assert abs((t + 1) * w / total - done) < 1


def test_each_source_is_within_one_block(documents):
    weights = {"a": 180, "b": 90, "c": 60, "d": 29, "e": 1}
    docs = documents(rows_of({"a": 700, "b": 300, "c": 200, "d": 90, "e": 3}))
    found = mix(docs, weights=weights, block=2).collect()
    assert len(found) == 1293 and len({r.position for r in found}) == 1293
    check_deviation(found, weights, 2)


def test_default_targets_and_ties(documents):
    found = mix(documents(rows_of({"a": 400, "b": 100, "c": 100})), block=1).collect()
    first = Counter(r.source for r in found if r.slot < 100)
    assert first == {"a": 50, "b": 25, "c": 25}


def test_edges(documents):
    rows = [(1, None, "en", None, 1), (None, "x", "en", "a", 1), (None, "x", "en", "a", 1), (2, "", "en", "", 1), (3, "y", "en", "other", 1)]
    found = mix(documents(rows), block=1).collect()
    assert len(found) == 5 and len({r.position for r in found}) == 5
    named = mix(documents(rows), weights={"a": 1.0, "missing": 2.0}, block=1).collect()
    assert sorted(r.slot is None for r in named) == [False, False, True, True, True]
    assert mix(documents([])).count() == 0
    assert mix(documents(rows), weights={}).where("slot is null").count() == 5


def test_mixed_keeps_rows_and_columns_in_order(documents):
    docs = documents(rows_of({"a": 40, "b": 20}))
    out = mixed(docs, block=1)
    assert out.columns == docs.columns
    order = [r.doc_id for r in out.collect()]
    place = {r.doc_id: r.position for r in mix(docs, block=1).collect()}
    assert order == sorted(place, key=place.get)


def test_many_sources(documents):
    docs = documents([(i, "t", "en", f"s{i % 450}", 1) for i in range(900)])
    found = mix(docs, block=1).collect()
    by = defaultdict(set)
    for r in found:
        by[r.source].add(r.slot)
    assert len(found) == 900 and all(len(s) == 2 for s in by.values())


def test_targets_are_those_of_the_unrounded_weights(documents):
    """A third of the rows and 19 equal sources: shares that are no 360ths; over 2,000 slots rounding would add up."""
    sizes = {"big": 6000, **{f"s{i:02}": 630 for i in range(19)}}
    found = mix(documents(rows_of(sizes)), block=1).collect()
    assert len(found) == sum(sizes.values()) == len({r.position for r in found})
    check_deviation(found, {s: n**0.5 for s, n in sizes.items()}, 1)


def test_more_sources_than_a_period_has_slots(documents):
    sizes = {"big": 900, **{f"s{i:03}": 1 + i % 3 for i in range(400)}}
    found = mix(documents(rows_of(sizes)), block=1).collect()
    check_deviation(found, {s: n**0.5 for s, n in sizes.items()}, 1)


def test_equal_small_and_irrational_weights_stay_within_one_block(documents):
    weights = {**{f"s{i}": 1.0 for i in range(7)}, "rare": 0.004, "odd": 2**0.5, "tenth": 0.1}
    sizes = {s: max(2, int(900 * w)) for s, w in weights.items()}
    check_deviation(mix(documents(rows_of(sizes), extra=False), weights=weights, block=1).collect(), weights, 1)
    equal = mix(documents(rows_of({f"s{i}": 3000 for i in range(7)}), extra=False)).collect()
    check_deviation(equal, {f"s{i}": 1.0 for i in range(7)}, 8)


def test_ranges_give_the_schedule_of_one_sweep(spark):
    weights = spark.createDataFrame([("a", 500, 31), ("b", 300, 17), (None, 200, 7), ("c", 40, 3)], "source string, n long, slots long")
    one = {tuple(r) for r in sweep(weights, 1, 4096).collect()}
    assert one == {tuple(r) for r in sweep(weights, 1, 8).collect()} and len(one) == 1040
