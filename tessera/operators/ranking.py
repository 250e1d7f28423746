"""Browse orders, selections, sampling and neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.constants import BASE_SCORE
from tessera.functions.text import natural_key
from tessera.operators.blocks import in_blocks, numbered
from tessera.store import table_of


def name_order(name: Column) -> Column:
    """File names as a Simplified Chinese reader sorts them: Han characters by pinyin before letters, digit runs by their number."""
    return F.collate(natural_key(name, fold=False), "zh_Hans")


def sort_orders() -> dict[str, list[Column]]:
    """The eight browse orders; each ends in (seed, filename, id)."""
    score = F.coalesce(F.col("score"), F.lit(BASE_SCORE))
    base = [F.asc_nulls_first("seed"), F.asc_nulls_first("filename"), F.asc("id")]
    return {
        "score_desc": [score.desc(), *base], "score_asc": [score.asc(), *base], "filename": [name_order(F.col("filename")).asc(), *base],
        "seed": base, "size_desc": [F.desc("size"), *base], "size_asc": [F.asc("size"), *base],
        "mtime_desc": [F.desc("modified_at"), *base], "mtime_asc": [F.asc("modified_at"), *base],
    }


def browse(rows: DataFrame, order: str = "score_desc", text: str = "", only_hidden: bool = False) -> DataFrame:
    """Rows whose filename holds the trimmed text, in a browse order."""
    found = rows.where(F.contains(F.lower("filename"), F.lower(F.trim(F.lit(text))))) if text.strip() else rows
    if only_hidden:
        found = found.where(F.col("hidden"))
    return found.orderBy(*sort_orders()[order])


def top_half(rows: DataFrame, group: str) -> DataFrame:
    """Of each group's visible members the best-scored ones: half of all visible members, at least one."""
    seen = rows.where(~F.coalesce(F.col("hidden"), F.lit(False)))
    total = seen.groupBy(group).agg(F.count("*").alias("total"))
    order = W.partitionBy(group).orderBy(F.desc("score"), F.asc("id"))
    ranked = seen.where(F.col("score").isNotNull()).withColumn("rank", F.row_number().over(order))
    return ranked.join(total, group).where(F.col("rank") <= F.greatest(F.lit(1).cast("bigint"), F.ceil(F.col("total") / 2))).drop("total")


def places(rows: DataFrame, order: str) -> DataFrame:
    """``rows`` with their place (from 1) in a browse order."""
    return numbered(rows, sort_orders()[order], "place")


def neighbours(groups: DataFrame) -> DataFrame:
    """Position, total, previous and next key of each group (group_key, count) in group order."""
    at = table_of(numbered(groups.select("group_key", "count"), [F.desc("count"), F.asc("group_key")]).select("group_key", "position"))
    before = at.select((F.col("position") + 1).alias("position"), F.col("group_key").alias("previous"))
    after = at.select((F.col("position") - 1).alias("position"), F.col("group_key").alias("next"))
    total = at.agg(F.count("*").alias("total"))  # one row
    return at.join(before, "position", "left").join(after, "position", "left").join(F.broadcast(total)).select(
        "group_key", "position", "total", "previous", "next"
    )


def shuffled(rows: DataFrame, seed: int, saved: list[int] | None = None) -> DataFrame:
    """A random order, repeatable by seed; ids of a saved order come first, in that order."""
    place = F.array_position(F.lit(saved or [0]).cast("array<bigint>"), F.col("id")) if saved else F.lit(0)
    return rows.orderBy(F.when(place > 0, place).otherwise(F.lit(2**31)), F.xxhash64(F.lit(seed), "id"), "id")


def pair_weight(gap: Column, unscored: Column, recent: Column, stale_a: Column, stale_b: Column) -> Column:
    """Weight of an arena pair: near scores, unscored images and stale ones come up more, recent pairs less."""
    near = F.when(gap < 5, 1.0).when(gap < 10, 0.5).when(gap < 25, 0.2).otherwise(0.08)
    return near * F.when(unscored, 3.0).otherwise(1.0) * F.when(recent, 0.15).otherwise(1.0) * stale_a * stale_b


#: Pairs that a task holds against recent ones, and that it makes where it only streams them.
PAIRS, BLOCK_PAIRS = 2**19, 2**23


def arena_pairs(rows: DataFrame, recent: DataFrame | None = None) -> DataFrame:
    """All pairs (group_key, a, b, weight) of each group's images (group_key, id, score, staleness 0..1).

    A group is what the arena shows at a time; it is paired in blocks, so that
    a large one is spread over tasks, and so are the pairs that meet ``recent`` ones. What a row alone decides is computed before rows meet.
    """
    # small rows make many pairs, so tasks are counted by the pairs, not by the size of what is read
    sizes = rows.groupBy("group_key").agg(F.count("*").alias("n"))
    whole, most = sizes.agg(F.sum(F.col("n") * F.col("n") / 2), F.max("n")).first()
    whole, most = int(whole or 0), int(most or 1)
    least = 4 * rows.sparkSession.sparkContext.defaultParallelism
    own = rows.where("id is not null").select("group_key", "id", F.coalesce("score", F.lit(BASE_SCORE)).alias("s"), F.col("score").isNull().alias("u"), (F.lit(0.6) + F.col("staleness")).alias("f"))
    placed = in_blocks(own.join(table_of(numbered(sizes.select("group_key"), [F.asc("group_key")], "group")), "group_key"), "group_key", "id")
    cell = ((F.col("group") * most + F.col("low")) * most + F.col("high")).alias("cell")  # one number, as each of a cell's rows is found by it; a group has fewer blocks than rows
    each = [cell, F.col("group_key").alias("key"), (F.col("low") < F.col("high")).alias("apart"), "id", "s", "u", "f"]
    sides = [
        placed.where(F.col("side") == F.col(at)).select(*each).withColumnsRenamed({c: f"{c}{end}" for c in ("key", "apart", "id", "s", "u", "f")}).repartition(max(least, whole // BLOCK_PAIRS), "cell")
        for at, end in (("low", "x"), ("high", "y"))
    ]
    met = sides[0].join(sides[1].drop("keyy", "aparty").hint("shuffle_hash"), "cell").where(F.col("apartx") | (F.col("idx") < F.col("idy")))
    first = F.col("idx") < F.col("idy")
    pairs = met.select(
        F.col("keyx").alias("group_key"), F.least("idx", "idy").alias("a"), F.greatest("idx", "idy").alias("b"), F.abs(F.col("sx") - F.col("sy")).alias("gap"), (F.col("ux") | F.col("uy")).alias("unscored"),
        *(F.when(first, F.col(f"f{x}")).otherwise(F.col(f"f{y}")).alias(f"f{end}") for end, x, y in (("a", "x", "y"), ("b", "y", "x"))),
    )
    if recent is None:
        pairs = pairs.withColumn("recent", F.lit(False))
    else:
        parts = max(least, whole // PAIRS)
        seen = recent.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit(True).alias("recent"))
        pairs = pairs.repartition(parts, "a", "b").join(seen.repartition(parts, "a", "b").distinct(), ["a", "b"], "left").withColumn("recent", F.coalesce("recent", F.lit(False)))
    weight = pair_weight(F.col("gap"), F.col("unscored"), F.col("recent"), F.col("fa"), F.col("fb"))
    return pairs.select("group_key", "a", "b", weight.alias("weight"))


def draw_pairs(pairs: DataFrame, seed: int, n: int = 1) -> DataFrame:
    """n pairs drawn without replacement by weight: the largest keys u ** (1 / w)."""
    u = (F.pmod(F.xxhash64(F.lit(seed), "a", "b"), F.lit(2**52)) + 0.5) / F.lit(float(2**52))
    return pairs.orderBy(F.desc(F.ln(u) / F.col("weight")), "a", "b").limit(n)


#: A score band is so wide; a block of a stratum has about so many images.
BAND = 5
STRATUM_BLOCK = 1000


def _uniform(seed: int, role: str, *by: str) -> Column:
    return (F.pmod(F.xxhash64(F.lit(seed), F.lit(role), *by), F.lit(2**52)) + 0.5) / F.lit(float(2**52))


def arena_draw(rows: DataFrame, k: int, seed: int, recent: DataFrame | None = None) -> DataFrame:
    """``k`` pairs (group_key, draw, a, b) of each group, drawn by ``pair_weight`` with replacement, without making all pairs.

    Images (group_key, id, score, staleness) are strata of a score band and of
    whether they have a score. A pair of strata is proposed by its mass, the
    product of summed staleness weights times the best weight its gap allows;
    within it both images by staleness; the pair is kept with the chance that its
    true weight has against that bound. So kept pairs are distributed as the
    weights. The rows are read once, into blocks with running sums; rounds of
    proposals go on until every group of two images or more has its pairs.
    """
    base = rows.where("id is not null").select("group_key", "id", "score", (F.lit(0.6) + F.coalesce("staleness", F.lit(0.0))).alias("w"))
    base = base.dropDuplicates(["group_key", "id"]).withColumn("s", F.coalesce("score", F.lit(BASE_SCORE))).withColumn("bare", F.col("score").isNull())
    base = base.withColumn("band", F.floor(F.col("s") / BAND).cast("int"))
    stratum = ["group_key", "band", "bare"]
    sized = base.join(base.groupBy(*stratum).agg(F.ceil(F.count("*") / STRATUM_BLOCK).alias("_blocks")), stratum)
    sized = sized.withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "id"), F.col("_blocks"))).drop("_blocks", "score")
    high = F.sum("w").over(W.partitionBy(*stratum, "block").orderBy("id").rowsBetween(W.unboundedPreceding, 0))
    placed = table_of(sized.withColumn("hi", high).withColumn("lo", F.col("hi") - F.col("w")))
    mass = placed.groupBy(*stratum, "block").agg(F.sum("w").alias("m"), F.count("*").alias("n"))
    upto = F.sum("m").over(W.partitionBy(*stratum).orderBy("block").rowsBetween(W.unboundedPreceding, 0))
    blocks = table_of(mass.withColumn("b_hi", upto).withColumn("b_lo", F.col("b_hi") - F.col("m")))
    strata = blocks.groupBy(*stratum).agg(F.sum("m").alias("m"), F.sum("n").alias("n"))
    one, two = (strata.select("group_key", *(F.col(c).alias(f"{c}{x}") for c in ("band", "bare", "m", "n"))) for x in ("1", "2"))
    key = lambda x: F.struct(f"band{x}", f"bare{x}")
    met = one.join(two, "group_key").where((key("1") < key("2")) | ((key("1") == key("2")) & (F.col("n1") > 1)))  # at most some 40 strata a group
    least_gap = F.greatest(F.lit(0), (F.abs(F.col("band1") - F.col("band2")) - 1) * BAND).cast("double")
    bound = pair_weight(least_gap, F.col("bare1") | F.col("bare2"), F.lit(False), F.lit(1.0), F.lit(1.0))
    cell = met.withColumn("bound", bound).withColumn("mass", F.col("bound") * F.col("m1") * F.col("m2") * F.when(key("1") == key("2"), 0.5).otherwise(1.0))
    reach = F.sum("mass").over(W.partitionBy("group_key").orderBy("band1", "bare1", "band2", "bare2").rowsBetween(W.unboundedPreceding, 0))
    cells = table_of(cell.withColumn("c_hi", reach).withColumn("c_lo", F.col("c_hi") - F.col("mass")))
    total = cells.groupBy("group_key").agg(F.max("c_hi").alias("total"))
    seen = None if recent is None else recent.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit(True).alias("recent")).distinct()

    def picked(asks: DataFrame, x: str) -> DataFrame:
        """Each proposal's image of side ``x``: the block by its running mass, then the row."""
        at = (_uniform(seed, f"row{x}", "group_key", "turn") * F.col(f"m{x}")).alias("at")
        want = asks.select("group_key", "turn", F.col(f"band{x}").alias("band"), F.col(f"bare{x}").alias("bare"), at)
        inside = want.join(blocks.select(*stratum, "block", "b_lo", "b_hi"), stratum).where("at >= b_lo and at < b_hi").withColumn("at", F.col("at") - F.col("b_lo"))
        found = inside.select(*stratum, "block", "turn", "at").join(placed, [*stratum, "block"]).where("at >= lo and at < hi")
        return found.select("group_key", "turn", F.col("id").alias(f"id{x}"), F.col("s").alias(f"s{x}"))

    kept, turns, start, left = None, 4 * k + 32, 0, total
    while not left.isEmpty():
        asks = left.withColumn("turn", F.explode(F.sequence(F.lit(start), F.lit(start + turns - 1))))
        asks = asks.withColumn("at", _uniform(seed, "cell", "group_key", "turn") * F.col("total"))
        asks = table_of(asks.join(cells, "group_key").where("at >= c_lo and at < c_hi").select("group_key", "turn", "band1", "bare1", "m1", "band2", "bare2", "m2", "bound"))
        pairs = asks.join(picked(asks, "1"), ["group_key", "turn"]).join(picked(asks, "2"), ["group_key", "turn"]).where("id1 <> id2")
        pairs = pairs.withColumn("a", F.least("id1", "id2")).withColumn("b", F.greatest("id1", "id2"))
        pairs = pairs.join(seen, ["a", "b"], "left") if seen is not None else pairs.withColumn("recent", F.lit(False))
        weight = pair_weight(F.abs(F.col("s1") - F.col("s2")), F.col("bare1") | F.col("bare2"), F.coalesce("recent", F.lit(False)), F.lit(1.0), F.lit(1.0))
        new = pairs.where(_uniform(seed, "keep", "group_key", "turn") * F.col("bound") < weight).select("group_key", "turn", "a", "b")
        kept = table_of(new if kept is None else kept.union(new))
        done = kept.groupBy("group_key").agg(F.count("*").alias("n")).where(F.col("n") >= k)
        left = table_of(left.join(done, "group_key", "left_anti"))
        start, turns = start + turns, 2 * turns
    if kept is None:
        return rows.select("group_key", F.lit(0).alias("draw"), F.col("id").alias("a"), F.col("id").alias("b")).where("false")
    draw = F.row_number().over(W.partitionBy("group_key").orderBy("turn"))
    return kept.withColumn("draw", draw).where(F.col("draw") <= k).select("group_key", "draw", "a", "b")
