"""Mixing sources to target weights by Pfair scheduling (operator 8), native.

Each source's documents, in the order of a hash of doc_id, are dealt into
blocks. Block i (from 0) of a source with weight w is released at slot
floor(i/w) and due at slot ceil((i+1)/w); one block runs in a slot, of those
released the one with the earliest deadline. At every slot each source that
still has blocks is within one block of its target; when a source runs out its
slots stay empty and the others keep their places.

Weights are whole numbers: as given where they are whole in millionths, else
rounded to ``FINE``-ths, which moves a target by slots / FINE blocks. The slots
are swept in ranges, one row a range: a range starts from a guess of what each
source has run, and is swept again from what the range before it ended with
until that no longer changes, so the result is that of one sweep. A range knows
where its first blocks are released (in decimals) and counts on from there in
whole numbers, so the number of slots has no bound. A slot looks at every
source: the work is slots times sources, spread over the ranges.

Everything is DataFrame functions: no Python runs on the rows. A document's
number within its source comes from a two-level count over hash parts, so a
source with a third of all rows is spread like any other.

Nulls and edges: a null source is a source of its own; a null doc_id sorts
first in its source; repeated rows are separate rows. Text is not read. Extra
columns are ignored. An empty table gives an empty result. Sources that
``weights`` does not name, or names with a weight that is not positive, come
after the schedule's end marker: they are kept, with a null slot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import cut

#: Weights that are not whole are rounded to so many parts.
FINE = 2**36
#: Slots that a row sweeps.
RANGE = 4096
BLOCK = 8
TEMPER = 0.5
#: Hex digits of the hash that name a part of a source.
PART_DIGITS = 2


def _order() -> Column:
    return F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))


def _targets(counts: DataFrame, weights: dict[str, float] | None, temper: float) -> DataFrame:
    """(source, n, w): without ``weights`` a source's target is its row count to the power ``temper``."""
    if weights is None:
        return counts.select("source", "n", F.pow(F.col("n").cast("double"), F.lit(temper)).alias("w"))
    given = counts.sparkSession.createDataFrame(
        [(k, float(v)) for k, v in weights.items() if v > 0] or [(None, 0.0)], "name string, w double"
    ).where("w > 0")
    return counts.join(F.broadcast(given), F.col("source").eqNullSafe(F.col("name"))).select("source", "n", "w")


def parts(counts: DataFrame, weights: dict[str, float] | None, temper: float) -> DataFrame:
    """Whole weights of each source: (source, n, slots)."""
    everyone = W.partitionBy()
    whole = F.round(F.col("w") * 1_000_000)
    is_whole = (F.max(F.abs(F.col("w") * 1_000_000 - whole) / F.col("w")).over(everyone) <= 1e-8) & (F.sum(whole).over(everyone) <= FINE)
    fine = F.greatest(F.round(F.col("w") * F.lit(FINE) / F.sum("w").over(everyone)), F.lit(1.0))
    return _targets(counts, weights, temper).select("source", "n", F.when(is_whole, whole).otherwise(fine).cast("long").alias("slots"))


def sweep(sources: DataFrame, block: int, length: int = RANGE) -> DataFrame:
    """Earliest deadline first over all slots: (source, block, slot) of the blocks that ``sources`` (source, n, slots) have."""
    row = sources.agg(
        F.array_sort(F.collect_list(F.struct(F.coalesce("source", F.lit("")).alias("name"), "source", "slots", "n"))).alias("s"),
        F.sum("slots").alias("period"),
    ).where("period > 0")
    # in decimals: the parts before block x of a source, and the first slot at or after them
    before = "cast(cast({x} as decimal(20, 0)) * cast(period as decimal(18, 0)) as decimal(38, 0))"
    # the last block of each source has run when it is due
    last = f"array_max(transform(s, x -> ({before.format(x=f'((x.n + {block - 1}) div {block})')} + x.slots - 1) div x.slots))"
    ranges = row.withColumn("last", F.expr(last)).withColumn("range", F.explode(F.expr(f"sequence(0L, (last - 1) div {length})")))
    # The guess: all that is due by then, and of what is released by then the earliest due, as many as slots are left over.
    guess = f"transform(s, x -> cast(cast(range * {length}L as decimal(20, 0)) * cast(x.slots as decimal(18, 0)) as decimal(38, 0)) div period)"
    over = ranges.withColumn("low", F.expr(guess)).withColumn("spare", F.expr(f"range * {length}L - aggregate(low, 0L, (a, x) -> a + x)"))
    due = f"""
      slice(array_sort(transform(filter(sequence(0, size(s) - 1), k -> {before.format(x='low[k]')} < cast(range * {length}L as decimal(20, 0)) * s[k].slots),
        k -> struct(({before.format(x='(low[k] + 1)')} + s[k].slots - 1) div s[k].slots AS due, k AS k))), 1, cast(spare as int)).k"""
    start = over.withColumn("first", F.expr(due)).withColumn(
        "run", F.expr("transform(low, (x, j) -> x + if(array_contains(first, j), 1L, 0L))")
    ).select("range", "last", "s", "period", "run")
    # c[k]: the source's parts, the slot (counted from the range's start) in which its next block is released, and the parts past that slot
    first_of = f"""
      transform(run, (x, k) -> struct(s[k].slots AS w, {before.format(x='x')} div s[k].slots - range * {length}L AS at, cast({before.format(x='x')} % s[k].slots as bigint) AS past))"""
    edf = f"""
      aggregate(sequence(0L, least({length}L, last - range * {length}L) - 1),
        named_struct('ran', transform(c, x -> 0L), 'log', cast(array() as array<int>)),
        (a, t) -> aggregate(array(
            array_min(transform(sequence(0, size(c) - 1), k -> named_struct(
              'late', c[k].at + (c[k].past + a.ran[k] * period) div c[k].w > t,
              'due', c[k].at + (c[k].past + (a.ran[k] + 1) * period + c[k].w - 1) div c[k].w,
              'k', k))).k),
          a,
          (b, k) -> named_struct(
            'ran', transform(b.ran, (r, j) -> r + if(j = k, 1L, 0L)),
            'log', concat(b.log, array(k)))))"""

    def swept(df: DataFrame) -> DataFrame:
        spread = df.repartition(df.sparkSession.sparkContext.defaultParallelism * 4, "range")
        ran = spread.withColumn("c", F.expr(first_of)).withColumn("_done", F.expr(edf)).withColumn("end", F.expr("transform(run, (x, k) -> x + _done.ran[k])"))
        return ran.select("range", "last", "s", "period", "run", "end", F.col("_done.log").alias("log"))

    done = cut(swept(start), "sweep")
    while True:
        before = done.select((F.col("range") + 1).alias("range"), F.col("end").alias("_end"))
        joined = done.join(before, "range", "left").withColumn("_same", F.col("_end").isNull() | (F.col("_end") == F.col("run")))
        wrong = joined.where("not _same")
        if wrong.isEmpty():
            break
        again = swept(wrong.select("range", "last", "s", "period", F.col("_end").alias("run")))
        done = cut(joined.where("_same").select(*done.columns).union(again), "sweep")
    # what each source has run when its range starts, and its place in the range, number its blocks
    slots = done.select("range", "s", "run", F.posexplode("log").alias("at", "k"))
    turn = F.row_number().over(W.partitionBy("range", "k").orderBy("at")) - 1
    placed = slots.select(
        F.expr("s[k].source").alias("source"), (F.expr("run[k]") + turn).alias("block"), (F.col("range") * length + F.col("at")).alias("slot"), F.expr("s[k].n").alias("n")
    )
    return placed.where(F.col("block") * block < F.col("n")).drop("n")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK, temper: float = TEMPER) -> DataFrame:
    """Every row as (doc_id, source, block, slot, position): read in the order of ``position``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"))
    return _placed(rows, weights, block, temper).select("doc_id", "source", "block", "slot", "position")


def _numbered(keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What the numbering of rows (source, _h, _part) starts from: (_s, _p, _before) of each part, and (source, n)."""
    found = cut(keyed.groupBy("source", "_part").agg(F.count("*").alias("n")), "parts")
    before = found.select(
        F.col("source").alias("_s"),
        F.col("_part").alias("_p"),
        F.coalesce(
            F.sum("n").over(W.partitionBy("source").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
        ).alias("_before"),
    )
    return before, found.groupBy("source").agg(F.sum("n").alias("n"))


def _placed(rows: DataFrame, weights: dict[str, float] | None, block: int, temper: float) -> DataFrame:
    keyed = rows.withColumn("_h", _order()).withColumn("_part", F.substring("_h", 1, PART_DIGITS))
    # Rows of one source and doc_id share a key; the keys alone are numbered and joined to the schedule.
    keyed = keyed.withColumn("_key", F.concat(F.when(F.col("source").isNull(), "0").otherwise("1"), F.coalesce("source", F.lit(""))))
    keys = keyed.select("source", "_key", "_h", "_part")
    before, counts = _numbered(keys)
    ranked = keys.withColumn("_rank", F.row_number().over(W.partitionBy("source", "_part").orderBy("_h")) - 1)
    numbered = ranked.join(before, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_part") == F.col("_p"))).select(
        "source", "_key", "_h", (F.col("_rank") + F.col("_before")).alias("_i")
    ).withColumn("block", F.floor(F.col("_i") / block))
    plan = sweep(cut(parts(counts, weights, temper), "weights"), block).select(F.col("source").alias("_ts"), F.col("block").alias("_tb"), "slot")
    timed = numbered.join(plan, F.col("source").eqNullSafe(F.col("_ts")) & (F.col("block") == F.col("_tb")), "left")
    places = timed.groupBy("_key", "_h").agg(F.array_sort(F.collect_list(F.struct("_i", "block", "slot"))).alias("_places"))
    copy = F.row_number().over(W.partitionBy("_key", "_h").orderBy("doc_id"))
    return (
        keyed.withColumn("_copy", copy).join(places, ["_key", "_h"]).withColumn("_place", F.element_at("_places", F.col("_copy")))
        .withColumn("block", F.col("_place.block")).withColumn("slot", F.col("_place.slot"))
        .withColumn("position", F.col("slot") * block + F.col("_place._i") % block)
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, all columns, written in mixed order: range-sorted by position."""
    columns = docs.columns
    renamed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.struct(*columns).alias("_row")
    )
    settings = {"weights": None, "block": BLOCK, "temper": TEMPER} | options
    placed = _placed(renamed, **settings)
    return placed.select("position", "_row").orderBy(F.asc_nulls_last("position")).select(*(F.col("_row")[c].alias(c) for c in columns))
