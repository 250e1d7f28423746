"""Review actions as an event log, and the state that follows from it."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.constants import ARENA_DIVISOR, ARENA_K, BASE_SCORE, HIGHEST, LOWEST, PAYLOAD_BYTES, SWIPE_STEPS
from tessera.functions.json_clean import has_sensitive_key
from tessera.functions.scores import swipe_step
from tessera.functions.text import valid_event_name, valid_token
from tessera.operators.components import components
from tessera.store import table_of

SEVERITIES = ("debug", "info", "warn", "error")


def swipe_scores(events: DataFrame) -> DataFrame:
    """(image_id, score) after swipes (image_id, gesture, at, seq), in order, clamped at every step.

    A clamped step is x -> min(hi, max(lo, x + d)). Such maps compose into one
    of the same form, so each log is cut into runs that are composed on their
    own and then in order; no image's whole log has to be one array.
    """
    steps = events.where(swipe_step(F.col("gesture")).isNotNull()).select("image_id", "at", "seq", swipe_step(F.col("gesture")).alias("d"))
    run = steps.withColumn("run", F.date_trunc("day", "at"))
    ordered = F.array_sort(F.collect_list(F.struct("at", "seq", "d")))
    start = F.struct(F.lit(0.0).alias("d"), F.lit(LOWEST).alias("lo"), F.lit(HIGHEST).alias("hi"))

    def then(f, d, lo, hi):
        """The map f followed by x -> min(hi, max(lo, x + d))."""
        low = F.least(hi, F.greatest(lo, f["lo"] + d))
        return F.struct((f["d"] + d).alias("d"), low.alias("lo"), F.least(hi, F.greatest(lo, f["hi"] + d)).alias("hi"))

    maps = run.groupBy("image_id", "run").agg(ordered.alias("log")).select(
        "image_id", "run", F.aggregate("log", start, lambda f, e: then(f, e["d"], F.lit(LOWEST), F.lit(HIGHEST))).alias("m")
    )
    chain = F.array_sort(F.collect_list(F.struct("run", "m")))
    whole = maps.groupBy("image_id").agg(chain.alias("chain"))
    score = F.aggregate(
        "chain", F.lit(BASE_SCORE), lambda x, e: F.least(e["m"]["hi"], F.greatest(e["m"]["lo"], x + e["m"]["d"]))
    )
    return whole.select("image_id", score.alias("score"))


class Fold:
    """Scores, hidden flags and comparisons, one action after another.

    An action has action_id, mode (swipe, arena, hide, unhide, arena_hide,
    undo), image_id or left/right, gesture, winner, undo_of. Undo restores the
    snapshot that its action took, once; later actions on top are overwritten.
    Of an action that says ``undone`` false nothing is kept, as no undo asks for it.
    """

    def __init__(self) -> None:
        self.scores: dict[int, float] = {}
        self.hidden: dict[int, bool] = {}
        self.compared: dict[str, tuple[int, int, int, float]] = {}
        self.taken: dict[str, dict] = {}
        self.undone: set[str] = set()

    def _vote(self, left: int, right: int, left_won: bool) -> float:
        scores = self.scores
        a, b = scores.get(left, BASE_SCORE), scores.get(right, BASE_SCORE)
        change = ARENA_K * ((1.0 if left_won else 0.0) - 1 / (1 + 10 ** ((b - a) / ARENA_DIVISOR)))
        scores[left], scores[right] = _clamped(a + change), _clamped(b - change)
        return abs(scores[left] - a)

    def add(self, e: dict) -> None:
        scores, hidden = self.scores, self.hidden
        mode, key, kept = e["mode"], e["action_id"], e.get("undone", True)
        if mode == "undo":
            snap = self.taken.get(e["undo_of"])
            if snap is None or e["undo_of"] in self.undone:
                return
            self.undone.add(e["undo_of"])
            for image, score in snap["scores"].items():
                if score is None:
                    scores.pop(image, None)
                else:
                    scores[image] = score
            hidden.update(snap["hidden"])
            self.compared.pop(e["undo_of"], None)
            return
        images = [i for i in (e.get("image_id"), e.get("left"), e.get("right")) if i is not None]
        if kept and mode != "unhide":  # unhiding cannot be undone
            self.taken[key] = {"scores": {i: scores.get(i) for i in images}, "hidden": {i: hidden.get(i, False) for i in images}}
        if mode == "swipe" and e["gesture"] in SWIPE_STEPS:
            scores[images[0]] = _clamped(scores.get(images[0], BASE_SCORE) + SWIPE_STEPS[e["gesture"]])
        elif mode == "hide":
            scores[images[0]], hidden[images[0]] = 0.0, True
        elif mode == "unhide":
            scores.setdefault(images[0], BASE_SCORE)
            hidden[images[0]] = False
        elif mode in ("arena", "arena_hide"):
            left, right, winner = e["left"], e["right"], e["winner"]
            change = self._vote(left, right, winner == left)
            if kept:
                self.compared[key] = (left, right, winner, change)
            if mode == "arena_hide":
                victim = right if winner == left else left
                scores[victim], hidden[victim] = 0.0, True


def _clamped(x: float) -> float:
    return max(LOWEST, min(HIGHEST, x))


def fold(actions: list[dict]) -> tuple[dict[int, float], dict[int, bool], list[tuple[int, int, int, float]]]:
    """Scores, hidden flags and comparisons after actions in order."""
    done = Fold()
    for e in actions:
        done.add(e)
    return done.scores, done.hidden, list(done.compared.values())


_FOLD_COLUMNS = ["action_id", "mode", "image_id", "left", "right", "gesture", "winner", "undo_of", "undone"]


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scores of each part's log, whose rows come one after another in order; a part's state is held, not its log."""
    names = ["image_id", "score", "hidden"]

    def ended(done: Fold) -> pa.RecordBatch:
        every = sorted(done.scores.keys() | {i for i, h in done.hidden.items() if h})
        columns = [pa.array(every, pa.int64()), pa.array([done.scores.get(i) for i in every], pa.float64()), pa.array([done.hidden.get(i, False) for i in every], pa.bool_())]
        return pa.RecordBatch.from_arrays(columns, names=names)

    part, done = None, Fold()
    for batch in batches:
        parts = batch.column("part").to_pylist()
        for own, e in zip(parts, batch.select(_FOLD_COLUMNS).to_pylist()):
            if own != part:
                if part is not None:
                    yield ended(done)
                part, done = own, Fold()
            done.add(e)
    if part is not None:
        yield ended(done)


def review_state(actions: DataFrame) -> DataFrame:
    """(image_id, score, hidden) after all actions (action_id, mode, image_id, left, right, gesture, winner, undo_of, at).

    A vote reads both scores, so the log is sequential within a connected
    component of the votes; components are independent and folded in parallel.
    A component's log is sorted by Spark and streamed through its task, which holds
    the state of the images and the snapshots of actions that some undo names.
    """
    target = actions.select(F.col("action_id").alias("undo_of"), F.coalesce("image_id", "left").alias("undone_image"))
    asked = actions.where((F.col("mode") == "undo") & F.col("undo_of").isNotNull()).select(F.col("undo_of").alias("action_id"), F.lit(True).alias("_asked")).distinct()
    undos = actions.where(F.col("undo_of").isNotNull()).join(target, "undo_of", "left")
    plain = actions.where(F.col("undo_of").isNull()).withColumn("undone_image", F.lit(None).cast("bigint"))
    keyed = plain.unionByName(undos).join(asked, "action_id", "left").withColumn("undone", F.coalesce("_asked", F.lit(False)))
    keyed = keyed.withColumn("node", F.coalesce("image_id", "left", "undone_image"))
    linked = components(actions.where(F.col("left").isNotNull() & F.col("right").isNotNull()).select(F.col("left").alias("a"), F.col("right").alias("b")))
    parts = keyed.join(linked.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left").withColumn("part", F.coalesce("component", "node"))
    logs = parts.where(F.col("part").isNotNull()).select("part", "at", *_FOLD_COLUMNS)
    return logs.repartition("part").sortWithinPartitions("part", F.asc_nulls_last("at"), F.asc_nulls_last("action_id")).mapInArrow(_folded, "image_id bigint, score double, hidden boolean")


def check_telemetry(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events that may be recorded, and the rejected ones with the reason."""
    reason = (
        F.when(~F.coalesce(valid_event_name(F.col("event_name")), F.lit(False)), "event_name")
        .when(~F.coalesce(valid_token(F.col("session_id")), F.lit(False)), "session_id")
        .when(~F.coalesce(F.col("severity").isin(*SEVERITIES), F.lit(False)), "severity")
        .when(F.octet_length("payload") > PAYLOAD_BYTES, "payload_size")
        .when(F.expr("try_parse_json(payload)").isNull(), "payload_json")
        .when(has_sensitive_key(F.col("payload")), "payload_key")
    )
    judged = events.withColumn("reason", reason)
    return judged.where(F.col("reason").isNull()).drop("reason"), judged.where(F.col("reason").isNotNull())


def newest(events: DataFrame, n: int, at: str = "occurred_at", key: str = "event_id") -> DataFrame:
    """The newest n (1 to 1000) rows of a log."""
    return events.orderBy(F.desc(at), F.desc(key)).limit(max(1, min(1000, n)))


def diagnostics(events: DataFrame, n: int = 200) -> DataFrame:
    """Newest events as JSON lines; a payload that is no JSON is an empty object."""
    rows = newest(events, n)
    payload = F.when(F.expr("try_parse_json(payload)").isNotNull(), F.col("payload")).otherwise("{}")
    return rows.withColumn("payload", payload).select(F.to_json(F.struct(*rows.columns)).alias("line"))


def label_states(log: DataFrame) -> DataFrame:
    """(image_id, label_id, action_id, at, before, after): whether the label is on before and after each action on it.

    ``log`` (action_id, image_id, label_id, op, at): ``attach``, ``detach`` and ``toggle``, in order of (at, action_id).
    Attach and detach set the state whatever it was; toggles since the last of
    them flip it. So a state is a running count within a run that starts at each
    set, and no image's log is folded row by row.
    """
    key = W.partitionBy("image_id", "label_id").orderBy("at", "action_id")
    rows = log.where(F.col("op").isin("attach", "detach", "toggle") & F.col("image_id").isNotNull() & F.col("label_id").isNotNull())
    runs = rows.withColumn("_run", F.sum(F.when(F.col("op") == "toggle", 0).otherwise(1)).over(key))
    within = W.partitionBy("image_id", "label_id", "_run").orderBy("at", "action_id")
    start = F.first(F.when(F.col("op") == "attach", 1).otherwise(0)).over(within)
    flips = F.sum(F.when(F.col("op") == "toggle", 1).otherwise(0)).over(within)
    states = runs.withColumn("after", F.pmod(start + flips, F.lit(2)) == 1).withColumn("before", F.coalesce(F.lag("after").over(key), F.lit(False)))
    return states.select("image_id", "label_id", "action_id", "at", "before", "after")


def with_undone(log: DataFrame) -> DataFrame:
    """``log`` with each ``undo`` (undo_of) as the action it amounts to: a detach where the undone attach was new, else nothing.

    Whether it was new may hang on earlier undos, so the states are computed
    until they settle: as many rounds as undos stand on one another.
    """
    undos = log.where(F.col("op") == "undo").groupBy("undo_of").agg(F.min(F.struct("at", "action_id")).alias("first"))
    undos = undos.select(F.col("undo_of").alias("action_id"), F.col("first.at").alias("undo_at"), F.col("first.action_id").alias("undo_id"))
    plain = table_of(log.where(F.col("op") != "undo").select("action_id", "image_id", "label_id", "op", "at"))
    new: DataFrame | None = None
    while True:
        acted = plain if new is None else plain.union(new.select(F.col("undo_id").alias("action_id"), "image_id", "label_id", F.lit("detach").alias("op"), F.col("undo_at").alias("at")))
        fresh = label_states(acted).where("after and not before").join(plain.where(F.col("op") == "attach").select("action_id"), "action_id", "left_semi")
        found = table_of(fresh.join(undos, "action_id").select("action_id", "image_id", "label_id", "undo_at", "undo_id"))
        if new is not None and found.exceptAll(new).isEmpty() and new.exceptAll(found).isEmpty():
            return acted
        new = found


def label_intervals(log: DataFrame) -> DataFrame:
    """(image_id, label_id, valid_from, valid_to): when a label was on, by (at, action_id) as structs; open ones end with null."""
    turns = label_states(log).where("before <> after").withColumn("turn", F.struct("at", "action_id"))
    following = F.lead("turn").over(W.partitionBy("image_id", "label_id").orderBy("turn"))
    return turns.withColumn("valid_to", following).where("after").select("image_id", "label_id", F.col("turn").alias("valid_from"), "valid_to")


def labels_at(points: DataFrame, intervals: DataFrame) -> DataFrame:
    """(image_id, at, action_id, labels): the labels that are on right after each point (image_id, at, action_id), ascending."""
    turn = F.struct("at", "action_id")
    on = intervals.join(points.select("image_id", turn.alias("_turn")).distinct(), "image_id").where("valid_from <= _turn and (valid_to is null or _turn < valid_to)")
    held = on.groupBy("image_id", "_turn").agg(F.sort_array(F.collect_set("label_id")).alias("labels"))
    rows = points.withColumn("_turn", turn).join(held, ["image_id", "_turn"], "left")
    return rows.select("image_id", "at", "action_id", F.coalesce("labels", F.array().cast("array<bigint>")).alias("labels"))


def label_log(actions: DataFrame, labels: DataFrame) -> DataFrame:
    """Swipes that carry a label, toggles and undos (action_id, mode, image_id, label_id, undo_of, at) as a label log; unknown labels are refused."""
    known = labels.select(F.col("id").cast("bigint").alias("label_id")).distinct()
    op = F.when(F.col("mode") == "swipe", "attach").when(F.col("mode") == "label_on", "attach").when(F.col("mode") == "label_off", "detach").when(F.col("mode") == "label_toggle", "toggle")
    acts = actions.withColumn("op", op).where("op is not null and label_id is not null").join(known, "label_id", "left_semi").withColumn("undo_of", F.lit(None).cast("string"))
    undos = actions.where("mode = 'undo'").withColumn("op", F.lit("undo")).withColumn("label_id", F.lit(None).cast("bigint"))
    columns = ["action_id", "image_id", "label_id", "op", "undo_of", "at"]
    return acts.select(*columns).unionByName(undos.select(*columns))


def recovered_scores(scores: DataFrame, found: DataFrame) -> DataFrame:
    """Scores (image_id, internal_score, last_mode) with those ``found`` (image_id, internal_score): a row that is there keeps its mode, a new one has ``recovered``."""
    new = found.dropDuplicates(["image_id"]).select("image_id", F.col("internal_score").alias("_found"), F.lit(True).alias("_there"))
    rows = scores.withColumn("_known", F.lit(True)).join(new, "image_id", "full")
    mode = F.when(F.col("_known"), F.col("last_mode")).otherwise("recovered")
    return rows.select("image_id", F.when(F.col("_there"), F.col("_found")).otherwise(F.col("internal_score")).alias("internal_score"), mode.alias("last_mode"))
