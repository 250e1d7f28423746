"""Registered queries of library tables: selections, manual groups, keys, text checks, and changes of stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import json_clean, keys, scores, text, vectors
from tessera.operators import backfill, clustering, graphs, groups, ranking, reconcile, review
from tessera.operators.blocks import numbered
from tessera.plans import bindings as b
from tessera.plans.registry import MATCH_SQL, register
from tessera.sources import files
from tessera.sources.folder_source import folder_listing
from tessera.store import Store, scratch_path, table_of

# --- selections


@register("p8_filename_filter", f"WITH {b.IMAGES_SQL} SELECT id FROM images WHERE contains(filename, 'g1') AND hidden")
def p8(spark, sf_dir):
    rows = b.images(spark, sf_dir).withColumn("score", F.lit(None).cast("double"))
    return ranking.browse(rows, "seed", " G1 ", only_hidden=True).select("id")


@register("p10_file_missing", f"WITH {b.IMAGES_SQL} SELECT id, id % 3 = 0 AS file_missing FROM images")
def p10(spark, sf_dir):
    images = b.images(spark, sf_dir)
    return groups.file_missing(images, images.where("id % 3 <> 0").select(F.col("abs_path").alias("path"))).select("id", "file_missing")


@register("p11_clean_scores", "SELECT doc_id AS id, CASE WHEN doc_id % 4 = 3 THEN (doc_id % 101)::DOUBLE ELSE 50.0::DOUBLE END AS score FROM documents")
def p11(spark, sf_dir):
    k = F.col("doc_id") % 4
    score = F.when(k == 0, float("nan")).when(k == 1, float("-inf")).when(k == 3, (F.col("doc_id") % 101).cast("double"))
    return b.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), scores.clean(score).alias("score"))


@register("o2_members", f"WITH {b.IMAGES_SQL} SELECT id, filename FROM images WHERE group_key_l1 = 'en' AND source_id = 1")
def o2(spark, sf_dir):
    return groups.members(b.images(spark, sf_dir), 1, "en", source_id=1).select("id", "filename")


@register("g16_ids_for_keys", f"WITH {b.IMAGES_SQL} SELECT id FROM images WHERE group_key_l2 IN ('en-0', 'en-3')")
def g16(spark, sf_dir):
    return groups.ids_for_keys(b.images(spark, sf_dir), 2, ["en-0", "en-3"])


@register("a7_vision_coverage", f"""WITH {b.IMAGES_SQL}, own AS (SELECT id FROM images WHERE source_id = 1)
SELECT (SELECT count(*) FROM own) AS total, (SELECT count(*) FROM own WHERE id IN (SELECT vec_id FROM embeddings)) AS computed""")
def a7(spark, sf_dir):
    signatures = b.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.lit("vision").alias("slot"), F.lit("m").alias("model_id"))
    return groups.coverage(b.images(spark, sf_dir), signatures, "vision", "m", source_id=1)


# --- manual groups

_H = "substr(md5(lower(trim(regexp_replace(prompt_pos, '\\s+', ' ', 'g')))), 1, 16)"


def _bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 50th image is bound by hand: half by merges, half by splits."""
    kind = F.when(F.col("id") % 100 < 50, "merge").otherwise("split")
    return b.images(spark, sf_dir).where("id % 50 = 7").select(
        F.lit(2).alias("level"), F.col("id").alias("image_id"), F.lit("pinned").alias("group_key"), kind.alias("kind"), F.col("group_key_l2").alias("prev_group_key")
    )


@register("j9_manual_groups", f"WITH {b.IMAGES_SQL} SELECT DISTINCT group_key_l2 AS group_key FROM images WHERE id % 50 = 7")
def j9(spark, sf_dir):
    return groups.manual_groups(b.images(spark, sf_dir), _bindings(spark, sf_dir))


@register("g14_merge_groups", f"""WITH {b.IMAGES_SQL}, m AS (SELECT id, group_key_l2, {_H} AS h FROM images WHERE group_key_l2 IN ('en-0', 'en-3'))
SELECT 2 AS level, id AS image_id, 'merge' AS kind, group_key_l2 AS prev_group_key,
substr(md5(concat('manual:', (SELECT array_to_string(list_sort(list_distinct(list(h))), '') FROM m))), 1, 16) AS group_key FROM m""")
def g14(spark, sf_dir):
    return clustering.merge_groups(b.images(spark, sf_dir), ["en-0", "en-3"])


@register("g15_unbind", f"""WITH {b.IMAGES_SQL}, n AS (SELECT id, group_key_l2, coalesce(source_id = 1, false) AND id % 100 < 50 AS undone FROM images WHERE id % 50 = 7)
SELECT id, CASE WHEN undone THEN group_key_l2 ELSE 'pinned' END AS group_key, undone FROM n""")
def g15(spark, sf_dir):
    restored, left = clustering.unbind(b.images(spark, sf_dir), _bindings(spark, sf_dir), "pinned", "merge", source_id=1)
    return restored.select("id", "group_key", F.lit(True).alias("undone")).union(left.select("image_id", "group_key", F.lit(False)))


@register("g9_vector_keys", """SELECT label::VARCHAR AS bucket, substr(md5(concat('vec', chr(1), label, chr(3), min(vec_id))), 1, 16) AS group_key FROM embeddings GROUP BY label""")
def g9(spark, sf_dir):
    least = b.vectors(spark, sf_dir).groupBy("bucket").agg(F.min("id").alias("id"))
    return least.select("bucket", keys.vector_cluster_key(F.col("bucket"), F.col("id")).alias("group_key"))


@register("g10_manual_keys", f"""WITH {b.IMAGES_SQL} SELECT group_key_l1 AS lang, size, substr(md5(concat('manual:', array_to_string(list_sort(list_distinct(list({_H}))), ''))), 1, 16) AS group_key
FROM images GROUP BY 1, 2""")
def g10(spark, sf_dir):
    rows = b.images(spark, sf_dir).groupBy(F.col("group_key_l1").alias("lang"), "size").agg(F.collect_set(keys.prompt_hash(F.col("prompt_pos"))).alias("h"))
    return rows.select("lang", "size", keys.manual_key(F.col("h")).alias("group_key"))


# --- keys and text


@register("g19_content_keys", f"""WITH {b.IMAGES_SQL} SELECT id, md5(concat_ws('|', size, seed, length(prompt_pos), prompt_pos, 0, '')) AS content,
concat_ws('|', workflow_key, steps, '', seed) AS metadata FROM images""")
def g19(spark, sf_dir):
    content = keys.content_key(*(F.col(c) for c in ("size", "seed", "prompt_pos", "prompt_neg")))
    signature = keys.metadata_signature(F.col("workflow_key"), F.col("steps"), F.lit(None), F.col("seed"))
    return b.images(spark, sf_dir).select("id", F.md5(content).alias("content"), signature.alias("metadata"))


@register("g25_recipes", """WITH p AS (SELECT p_partkey AS id, p_partkey % 3 AS m, p_size % 5 AS steps, p_partkey % 7 AS height FROM part)
SELECT id, substr(md5(concat('{"checkpoint":"', CASE WHEN m > 0 THEN concat('m', m) ELSE '' END, '","diffusion_model":"","loras":[{"name":"a","strength":0.5},{"name":"b","strength":1.0}],"vae":"","sampler":"euler","scheduler":"karras","steps":',
steps, ',"cfg":7.5,"width":8,"height":', height, ',"aspect_ratio":0.0}')), 1, 16) AS signature, m > 0 AND steps > 0 AND height > 0 AS complete FROM p""")
def g25(spark, sf_dir):
    lora = lambda name, strength: F.struct(F.lit(name).alias("name"), F.lit(strength).alias("strength"), F.lit(None).cast("double").alias("clip_strength"))
    m = (F.col("p_partkey") % 3).cast("string")
    recipe = F.struct(
        F.when(m != "0", F.concat(F.lit(" m"), m)).alias("checkpoint"), F.lit(" ").alias("diffusion_model"), F.array(lora(" b", 1.0), lora("", 2.0), lora("a ", 0.5)).alias("loras"),
        F.lit(None).cast("string").alias("vae"), F.lit("euler ").alias("sampler"), F.lit("karras").alias("scheduler"), (F.col("p_size") % 5).cast("long").alias("steps"),
        F.lit(7.5).alias("cfg"), F.lit(8).cast("long").alias("width"), (F.col("p_partkey") % 7).cast("long").alias("height"), F.lit(0.0).alias("aspect_ratio"),
    )
    rows = b.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), keys.normalized_recipe(recipe).alias("recipe"))
    return rows.select("id", keys.recipe_signature(F.col("recipe")).alias("signature"), keys.complete_recipe(F.col("recipe")).alias("complete"))


@register("f14_aspect_ratio", "SELECT p_partkey AS id, CASE WHEN p_size % 5 > 0 AND p_partkey % 7 > 0 THEN round((p_size % 5) / (p_partkey % 7), 9) ELSE 0.0 END AS ratio FROM part")
def f14(spark, sf_dir):
    ratio = keys.aspect_ratio(F.col("p_size") % 5, F.col("p_partkey") % 7)
    return b.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.round(ratio, 9).alias("ratio"))


@register("f2_embedding_refs", "SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN concat('e', doc_id % 5, ';z 9') ELSE '' END AS refs FROM documents")
def f2(spark, sf_dir):
    k = (F.col("doc_id") % 5).cast("string")
    some = F.concat(F.lit("A, Embedding:e"), k, F.lit(".., (embedding: z 9 ) xembedding:q; embedding:;embedding:e"), k)
    prompt = F.when(F.col("doc_id") % 2 == 0, some).otherwise("my_1embedding:x, embeddings:y")
    return b.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat_ws(";", text.embedding_refs(prompt)).alias("refs"))


@register("f5_fields", """WITH p AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE concat(' ', p_name, ', "', p_brand, '" ') END AS v FROM part)
SELECT id, CASE WHEN regexp_matches(v, '[,"\\n]') THEN concat('"', replace(v, '"', '""'), '"') ELSE v END AS csv, replace(trim(regexp_replace(v, '[^\\p{L}\\p{N}_\\- ]', '', 'g')), ' ', '_') AS name FROM p""")
def f5(spark, sf_dir):
    v = F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(F.concat(F.lit(" "), "p_name", F.lit(', "'), "p_brand", F.lit('" ')))
    return b.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.csv_field(v).alias("csv"), text.sanitize_name(v).alias("name"))


@register("f11_unit_vectors", """SELECT vec_id AS id, round(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]) / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 4) AS along FROM embeddings""")
def f11(spark, sf_dir):
    """Each vector along its own unit vector: its length."""
    v = F.transform("embedding", lambda x: x * 3)
    return b.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.round(vectors.dot(F.col("embedding"), vectors.normalize(v)), 4).alias("along"))


@register("f16_durations", """SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'unknown' WHEN event_id % 7 = 1 THEN '0' ELSE (event_id % 60 * 60000)::VARCHAR END AS ms FROM events""")
def f16(spark, sf_dir):
    at = F.concat(F.lit("2024-01-01 00:"), F.lpad((F.col("event_id") % 60).cast("string"), 2, "0"), F.lit(":00"))
    start = F.lit("2024-01-01 00:00:00")
    began = F.when(F.col("event_id") % 7 == 1, at).otherwise(start)
    ended = F.when(F.col("event_id") % 7 == 0, "never").when(F.col("event_id") % 7 == 1, start).otherwise(at)
    return b.table(spark, sf_dir, "events").select("event_id", F.coalesce(text.duration_ms(began, ended).cast("string"), F.lit("unknown")).alias("ms"))


@register("f21_whitelisted", """SELECT event_id, CASE event_type WHEN 'view' THEN '{}' ELSE concat('{"count":"', greatest(0, event_id % 9 - 4), '","kind":"a"}') END AS payload FROM events WHERE event_type IN ('click', 'view')""")
def f21(spark, sf_dir):
    count = (F.col("event_id") % 9 - 4 + F.lit(0.25)).cast("string")
    payload = F.concat(F.lit('{"count": '), count, F.lit(', "kind": "a", "path": "/x"}'))
    rows = b.table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("event_name"), payload.alias("payload"))
    return json_clean.whitelisted(rows, {"click": ["count", "kind"], "view": []}).select("event_id", "payload")


# --- changes of stored tables


def _store(spark: SparkSession, **tables: DataFrame) -> Store:
    store = Store(spark, scratch_path(spark, "library"))
    for name, df in tables.items():
        store.overwrite(name, df)
    return store


@register("k7_upsert_scores", f"""WITH {b.SCORES_SQL} SELECT image_id, CASE WHEN image_id % 3 = 0 THEN 1.0::DOUBLE ELSE internal_score END AS score, CASE WHEN image_id % 3 = 0 THEN 'recovered' END AS last_mode FROM scores""")
def k7(spark, sf_dir):
    rows = b.scores(spark, sf_dir)
    store = _store(spark, scores=rows)
    store.upsert("scores", rows.where("image_id % 3 = 0").select("image_id", F.lit(1.0).alias("internal_score"), F.lit("recovered").alias("last_mode")))
    return store.read("scores").select("image_id", F.col("internal_score").alias("score"), "last_mode")


@register("k8_insert_absent", "SELECT doc_id AS image_id, 1::BIGINT AS label_id FROM labels WHERE toxic = 1 OR quality = 1")
def k8(spark, sf_dir):
    labels = b.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("image_id"), F.lit(1).cast("long").alias("label_id"), "toxic", "quality")
    store = _store(spark, image_labels=labels.where("toxic = 1"))
    store.insert_absent("image_labels", labels.where("quality = 1").select("image_id", "label_id"))
    return store.read("image_labels")


@register("k9_update_columns", f"""WITH {b.SCORES_SQL} SELECT image_id, internal_score AS score, CASE WHEN image_id % 5 = 0 THEN 'swipe' END AS last_mode FROM scores""")
def k9(spark, sf_dir):
    rows = b.scores(spark, sf_dir)
    store = _store(spark, scores=rows)
    store.update("scores", rows.where("image_id % 5 = 0").select("image_id", F.lit("swipe").alias("last_mode")))
    return store.read("scores").select("image_id", F.col("internal_score").alias("score"), "last_mode")


@register("k10_delete_missing", f"""WITH {b.IMAGES_SQL}, {b.SCORES_SQL}, i AS (SELECT id, group_key_l1, coalesce(source_id = 1, false) AND id % 3 = 0 AS gone FROM images)
SELECT i.id, group_key_l1, gone, NOT gone AND s.image_id IS NOT NULL AS scored FROM i LEFT JOIN scores s ON i.id = s.image_id""")
def k10(spark, sf_dir):
    images = b.images(spark, sf_dir)
    store = _store(spark, images=images, scores=b.scores(spark, sf_dir))
    gone = store.delete_missing(1, images.where("id % 3 <> 0").select(F.col("abs_path").alias("norm_path")))
    kept = store.read("images").select("id", "group_key_l1", F.lit(False).alias("gone"))
    rows = kept.union(gone.select("id", "group_key_l1", F.lit(True)))
    scored = store.read("scores").select(F.col("image_id").alias("id"), F.lit(True).alias("scored"))
    return rows.join(scored, "id", "left").withColumn("scored", F.coalesce("scored", F.lit(False)))


@register("k12_delete_label", "SELECT doc_id AS image_id, 1::BIGINT AS label_id FROM labels WHERE toxic = 1")
def k12(spark, sf_dir):
    labels = b.table(spark, sf_dir, "labels")
    on = [labels.where(f"{c} = 1").select(F.col("doc_id").alias("image_id"), F.lit(k).cast("long").alias("label_id")) for k, c in ((1, "toxic"), (2, "quality"))]
    store = _store(spark, labels=spark.createDataFrame([(1, "toxic"), (2, "good")], "id bigint, name string"), image_labels=on[0].union(on[1]))
    store.delete_label(2)
    return store.read("image_labels").join(store.read("labels").select(F.col("id").alias("label_id")), "label_id").select("image_id", "label_id")


@register("k13_hide_group", f"""WITH {b.IMAGES_SQL} SELECT id, hidden OR (group_key_l2 = 'en-0' AND coalesce(source_id = 1, false)) AS hidden FROM images""")
def k13(spark, sf_dir):
    store = _store(spark, images=b.images(spark, sf_dir))
    store.hide("group_key_l2", "en-0", source_id=1)
    return store.read("images").select("id", "hidden")


@register("g22_apply_recovery", f"""WITH {MATCH_SQL}, bound AS (SELECT new_id AS id FROM m WHERE old_id % 4 = 0)
SELECT 'binding' AS what, id, 'pin' AS "value" FROM bound
UNION ALL SELECT 'key', id, CASE WHEN id IN (SELECT id FROM bound) THEN 'pin' ELSE group_key_l2 END FROM files WHERE side = 1
UNION ALL SELECT 'label', new_id, '9' FROM m WHERE old_id IN (SELECT doc_id FROM labels WHERE toxic = 1)
UNION ALL SELECT 'score', id, '1' FROM files WHERE side = 1 AND id % 3 = 0
UNION ALL SELECT 'score', new_id, (old_id % 101)::VARCHAR FROM m WHERE new_id % 3 <> 0""")
def g22(spark, sf_dir):
    """Even documents are the old library, odd ones the new; what the new one holds after recovery."""
    files = [b.identity_rows(spark, sf_dir, side) for side in (0, 1)]
    names = [spark.createDataFrame([(k, "toxic")], "id bigint, name string") for k in (1, 9)]
    bound = files[0].where("id % 4 = 0").select(
        F.lit(2).alias("level"), F.col("id").alias("image_id"), F.lit("pin").alias("group_key"), F.lit("split").alias("kind"), F.lit(None).cast("string").alias("prev_group_key")
    )
    toxic = b.table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("image_id"), F.lit(1).cast("long").alias("label_id"))
    rated = [rows.select(F.col("id").alias("image_id"), score.alias("internal_score")) for rows, score in (
        (files[0], (F.col("id") % 101).cast("double")), (files[1].where("id % 3 = 0"), F.lit(1.0)))]
    store = _store(spark, images=files[1], scores=rated[1], labels=names[1])
    old = {"images": files[0], "manual_group_bindings": bound, "labels": names[0], "image_labels": toxic, "scores": rated[0]}
    new = {t: store.read(t) for t in ("manual_group_bindings", "labels", "image_labels", "scores")} | {"images": files[1]}
    reconcile.apply(store, reconcile.plan_recovery(old, new))
    found = {
        "binding": ("manual_group_bindings", "image_id", "group_key"), "key": ("images", "id", "group_key_l2"), "label": ("image_labels", "image_id", "label_id"),
        "score": ("scores", "image_id", "CAST(internal_score AS BIGINT)"),
    }
    parts = [store.read(t).select(F.lit(what).alias("what"), F.col(key).alias("id"), F.expr(value).cast("string").alias("value")) for what, (t, key, value) in found.items()]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


#: A pass over documents as files, by the last digit of the id: 0 renamed, 1 deleted, 2 renamed with a new file at the old path, 3 edited
#: in place, 4 with a new file beside it; 5 and 6 swap contents in pairs (id, id + 1); the rest unchanged.
_FILES = """f AS (SELECT doc_id AS id, doc_id % 10 AS d, concat('/lib/', doc_id, '.png') AS path, concat(doc_id, '-', md5(text)) AS fp FROM documents WHERE doc_id IS NOT NULL),
listing AS (SELECT id, path, fp, true AS old FROM f WHERE d IN (7, 8, 9, 4)
  UNION ALL SELECT id, concat('/lib/moved', id, '.png'), fp, true FROM f WHERE d IN (0, 2)
  UNION ALL SELECT id, path, concat('new-', fp), false FROM f WHERE d IN (2, 3)
  UNION ALL SELECT id, concat('/lib/more', id, '.png'), concat('new-', fp), false FROM f WHERE d = 4
  UNION ALL SELECT x.id, y.path, x.fp, true FROM f x JOIN f y ON (x.d = 5 AND y.id = x.id + 1) OR (x.d = 6 AND y.id = x.id - 1))"""


#: The pairs' condition, and the same as one equality: over an OR Spark would compare all pairs of files.
_SWAPPED = "(x.d = 5 AND y.id = x.id + 1) OR (x.d = 6 AND y.id = x.id - 1)"
_PARTNER = "y.id = CASE x.d WHEN 5 THEN x.id + 1 WHEN 6 THEN x.id - 1 END"


@register("st4_sync", f"""WITH {_FILES}, fresh AS (SELECT path, fp, (SELECT max(id) FROM f) + row_number() OVER (ORDER BY path) AS id FROM (
  SELECT l.path, l.fp FROM listing l LEFT JOIN f ON f.path = l.path WHERE f.fp IS DISTINCT FROM l.fp))
SELECT CASE WHEN old OR d = 3 THEN l.id ELSE fresh.id END AS id, l.path AS abs_path, l.fp AS content_fp FROM listing l JOIN f USING (id) LEFT JOIN fresh ON fresh.path = l.path""")
def st4_sync(spark, sf_dir):
    from tessera.streaming.ingest import planned

    b.table(spark, sf_dir, "documents").createOrReplaceTempView("st4_documents")
    named = _FILES.replace("FROM documents", "FROM st4_documents").replace(_SWAPPED, _PARTNER)
    known = table_of(spark.sql(f"WITH {named} SELECT id, path AS abs_path, fp AS content_fp, '' AS group_key_l1, '' AS group_key_l3 FROM f"))
    listing = table_of(spark.sql(f"WITH {named} SELECT path AS norm_path, fp FROM listing"))
    read = listing.join(known.select(F.col("abs_path").alias("norm_path"), F.col("content_fp").alias("fp")), ["norm_path", "fp"], "left_anti").select(
        F.col("norm_path").alias("abs_path"), F.col("fp").alias("content_fp"), F.lit("").alias("group_key_l1"), F.lit("").alias("group_key_l3"),
        F.lit("").alias("filename"), F.lit(0).alias("modified_at"),
    )
    top = known.agg(F.max("id")).first()[0] or 0
    fresh = lambda rows: numbered(rows, [F.asc("abs_path")], "n").withColumn("id", F.col("n") + F.lit(top)).drop("n")
    keys = lambda rows: rows.select("id", F.col("content_fp").alias("content_key"), F.lit("").alias("meta_sig"), "content_fp")
    plan = planned(known, listing, read, fresh, keys)
    stay = known.join(plan.removed.select("id"), "id", "left_anti").join(plan.moves.union(plan.again.select(plan.moves.columns)).select("id"), "id", "left_anti")
    moved = plan.moves.select("id", "abs_path").join(known.select("id", "content_fp"), "id")
    rows = [stay.select("id", "abs_path", "content_fp"), moved.select("id", "abs_path", "content_fp")]
    return rows[0].union(rows[1]).union(plan.again.select("id", "abs_path", "content_fp")).union(plan.inserts.select("id", "abs_path", "content_fp"))


# --- labels over time, drawn pairs, sanitised payloads, merged sources

_LOG = """log AS (SELECT event_id AS action_id, user_id AS image_id, event_id % 3 AS label_id, ts AS tm,
  CASE event_type WHEN 'purchase' THEN 'attach' WHEN 'click' THEN 'toggle' WHEN 'error' THEN 'detach' END AS op FROM events)"""


def _label_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    op = F.create_map(*(F.lit(x) for x in ("purchase", "attach", "click", "toggle", "error", "detach")))[F.col("event_type")]
    return b.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("action_id"), F.col("user_id").alias("image_id"), (F.col("event_id") % 3).alias("label_id"), F.col("ts").alias("at"), op.alias("op")
    )


@register("r6_label_states", f"""WITH {_LOG}, o AS (SELECT *, list(op) OVER (PARTITION BY image_id, label_id ORDER BY tm, action_id) AS ops FROM log WHERE op IS NOT NULL)
SELECT action_id, image_id, label_id, list_reduce(list_prepend('off', ops), lambda x, y: CASE WHEN y = 'attach' THEN 'on' WHEN y = 'detach' THEN 'off' WHEN x = 'on' THEN 'off' ELSE 'on' END) = 'on' AS after FROM o""")
def r6_states(spark, sf_dir):
    return review.label_states(_label_log(spark, sf_dir)).select("action_id", "image_id", "label_id", "after")


@register("r1_labels_at_actions", f"""WITH {_LOG}, acts AS (SELECT action_id, image_id, tm, label_id, op FROM log),
e AS (SELECT p.action_id, p.image_id, l.label_id, list(l.op ORDER BY l.tm, l.action_id) AS ops FROM acts p JOIN log l ON l.image_id = p.image_id AND l.op IS NOT NULL AND (l.tm, l.action_id) <= (p.tm, p.action_id) GROUP BY 1, 2, 3),
s AS (SELECT action_id, label_id, list_reduce(list_prepend('off', ops), lambda x, y: CASE WHEN y = 'attach' THEN 'on' WHEN y = 'detach' THEN 'off' WHEN x = 'on' THEN 'off' ELSE 'on' END) = 'on' AS is_on FROM e)
SELECT p.action_id, p.image_id, coalesce(array_to_string(list(s.label_id ORDER BY s.label_id) FILTER (is_on), ','), '') AS labels FROM acts p LEFT JOIN s USING (action_id) GROUP BY 1, 2""")
def r1_labels(spark, sf_dir):
    log = _label_log(spark, sf_dir)
    found = review.labels_at(log.select("image_id", "at", "action_id"), review.label_intervals(log))
    return found.select("action_id", "image_id", F.concat_ws(",", F.col("labels").cast("array<string>")).alias("labels"))


@register("w1_drawn_pairs", "SELECT s_nationkey AS group_key, 5::BIGINT AS draws, true AS valid FROM supplier GROUP BY 1 HAVING count(*) > 1")
def w1_drawn(spark, sf_dir):
    score = F.when(F.col("s_suppkey") % 5 != 0, F.col("s_acctbal") / 100)
    rows = b.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("group_key"), F.col("s_suppkey").alias("id"), score.alias("score"), F.lit(0.5).alias("staleness"))
    drawn = ranking.arena_draw(rows, 5, seed=11)
    own = rows.select("group_key", "id")
    ends = drawn.join(own.withColumnRenamed("id", "a").withColumn("a_in", F.lit(True)), ["group_key", "a"], "left").join(own.withColumnRenamed("id", "b").withColumn("b_in", F.lit(True)), ["group_key", "b"], "left")
    return ends.groupBy("group_key").agg(F.count("*").alias("draws"), F.bool_and(F.coalesce(F.col("a_in") & F.col("b_in") & (F.col("a") < F.col("b")), F.lit(False))).alias("valid"))


_FNV = """'h_' || printf('%08x', list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split('s:' || {v}, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295))"""


@register("f21_sanitized", f"""SELECT event_id, CASE event_type WHEN 'view' THEN concat('{{"view":"', CASE WHEN event_id % 2 = 0 THEN 'swipe' ELSE 'arena' END, '","duration_ms":', greatest(0, floor(event_id % 9 - 4 + 0.25 + 0.5))::BIGINT, '}}')
WHEN 'click' THEN concat('{{', CASE WHEN event_id % 3 = 0 THEN '"gesture":"up",' ELSE '' END, '"has_label":', (event_id % 2 = 0), ',"image_id":"', {_FNV.format(v='event_id::VARCHAR')}, '"}}') ELSE '{{}}' END AS payload
FROM events WHERE event_type IN ('view', 'click', 'error')""")
def f21_sanitized(spark, sf_dir):
    i = F.col("event_id")
    view = F.concat(F.lit('{"duration_ms": '), (i % 9 - 4 + F.lit(0.25)).cast("string"), F.lit(', "view": "'), F.when(i % 2 == 0, "swipe").otherwise("arena"), F.lit('", "path": "/x"}'))
    gesture = F.when(i % 3 == 0, '"up"').when(i % 3 == 1, '"sideways"').otherwise("7")
    click = F.concat(F.lit('{"image_id": '), i.cast("string"), F.lit(', "has_label": '), (i % 2 == 0).cast("string"), F.lit(', "gesture": '), gesture, F.lit(', "duration_ms": "long"}'))
    payload = F.when(F.col("event_type") == "view", view).when(F.col("event_type") == "click", click).otherwise("no json")
    rows = b.table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("event_name"), payload.alias("payload"))
    allowed = {"view": ["view", "duration_ms"], "click": ["gesture", "has_label", "duration_ms", "image_id"], "error": []}
    enums = {"view": ["swipe", "arena", "folder"], "gesture": ["left", "right", "up", "down"]}
    return json_clean.sanitized(rows, allowed, enums, ["duration_ms"], ["has_label"], "s").select("event_id", "payload")


#: g26: documents as images of sources that three spellings of one root name; every seventh image is there under a second spelling too.


@register("g26_merged_library", """WITH r AS (SELECT source, dense_rank() OVER (ORDER BY source) * 3 AS source_id FROM (SELECT DISTINCT source FROM documents)),
k AS (SELECT doc_id AS id, source_id, concat('c:/lib/', source, '/img', doc_id, '.png') AS abs_path, substr(md5(concat('c:/lib/', source)), 1, 16) AS group_key_l0 FROM documents JOIN r USING (source))
SELECT k.*, CASE WHEN id % 7 = 0 AND id % 2 = 1 THEN 20.0::DOUBLE WHEN id % 2 = 0 THEN 10.0::DOUBLE END AS score,
  CASE WHEN id % 5 = 0 THEN group_key_l0 WHEN id % 7 = 0 THEN 'late' END AS bound FROM k""")
def g26_merged(spark, sf_dir):
    docs = b.table(spark, sf_dir, "documents").select("doc_id", "source")
    number = docs.select("source").distinct()
    ranked = numbered(number, [F.asc("source")], "n").select("source", (F.col("n") * 3).alias("base"))
    spelling = F.when(F.col("k") == 0, F.concat(F.lit("C:\\lib\\"), "source", F.lit("\\"))).when(F.col("k") == 1, F.concat(F.lit("c:/lib/"), "source")).otherwise(F.concat(F.lit("//?/C:/lib/"), "source", F.lit("//")))
    sources = ranked.withColumn("k", F.explode(F.array(*map(F.lit, range(3))))).select((F.col("base") + F.col("k")).alias("id"), spelling.alias("path"), "source", "k")
    sources = table_of(sources)
    twin = F.when(F.col("doc_id") % 7 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    copies = docs.withColumn("copy", F.explode(twin)).withColumn("k", ((F.col("doc_id") + F.col("copy")) % 3).cast("int"))
    slash = F.when(F.col("k") == 0, "\\").otherwise("/")
    far = F.lit(10**9)
    images = copies.join(sources, ["source", "k"]).select(
        (F.col("doc_id") + F.col("copy") * far).alias("id"), F.col("id").alias("source_id"), F.concat(F.regexp_replace("path", r"[\\/]+$", ""), slash, F.lit("img"), "doc_id", F.lit(".png")).alias("abs_path"),
        F.md5("path").alias("group_key_l0"), F.col("doc_id").alias("doc"), "copy",
    )
    images = table_of(images)
    late = F.col("copy") == 1
    scores = images.where((F.col("doc") % 2 == 0) | late).select(F.col("id").alias("image_id"), F.when(late, 20.0).otherwise(10.0).alias("internal_score"))
    bindings = images.where("doc % 5 = 0 and copy = 0").select(F.lit(0).alias("level"), F.col("id").alias("image_id"), F.col("group_key_l0").alias("group_key")).union(
        images.where(late).select(F.lit(0), "id", F.lit("late"))
    )
    columns = ["id", "source_id", "abs_path", "group_key_l0"]
    done = backfill.normalized_library({"sources": sources.select("id", "path"), "images": images.select(*columns), "scores": scores, "manual_group_bindings": bindings})
    return done["images"].join(done["scores"].select(F.col("image_id").alias("id"), F.col("internal_score").alias("score")), "id", "left").join(
        done["manual_group_bindings"].select(F.col("image_id").alias("id"), F.col("group_key").alias("bound")), "id", "left"
    )


# --- listings of written trees, template names, probes, scans


def _tree(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """Suppliers as workflow files, one each, in two trees: folders of nations, and of regions and nations."""
    nation = b.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey")
    rows = b.table(spark, sf_dir, "supplier").join(nation, "s_nationkey")
    i = F.col("s_suppkey")
    flow = F.concat(
        F.lit('{"id": "w'), i, F.lit('", "nodes": [{"id": 1, "type": "KSampler"}, {"id": 2, "type": "CheckpointLoaderSimple", "widgets_values": ["m'), i % 7,
        F.lit('"]}], "links": [[1, 2, 0, 1, 0, "MODEL"]]}'),
    )
    base = scratch_path(spark, "trees")
    flows = rows.select(flow.alias("value"), "s_nationkey", "n_regionkey", i.alias("k"))
    i_even = F.col("k") % 2 == 0
    own = F.concat(F.lit("s_nationkey="), "s_nationkey", F.lit("/k="), "k", F.lit("/flow.txt"))
    flows = flows.repartition(4 * spark.sparkContext.defaultParallelism, "k")
    files.write_texts(flows.select(F.when(i_even, F.concat(F.lit(f"{base}/a/"), own)).otherwise(F.concat(F.lit(f"{base}/b/n_regionkey="), "n_regionkey", F.lit("/"), own)).alias("path"), "value"))
    return f"{base}/a", f"{base}/b"


@register("s1_folder_listing", """WITH s AS (SELECT s_suppkey AS k, s_nationkey AS n, n_regionkey AS r FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT 'a' AS tree, concat('s_nationkey=', n) AS top, count(*) AS files FROM s WHERE k % 2 = 0 GROUP BY n
UNION ALL SELECT 'b', concat('n_regionkey=', r), count(*) FROM s WHERE k % 2 = 1 GROUP BY r""")
def s1_listing(spark, sf_dir):
    a, z = _tree(spark, sf_dir)
    found = folder_listing(spark, [a, z], depth=3, suffixes="txt").where(F.col("length") > 0)
    top = F.regexp_extract("folder", r"/trees-[0-9a-f]+/[ab]/([^/]*)", 1)
    return found.groupBy(F.regexp_extract("root", r"/([ab])$", 1).alias("tree"), top.alias("top")).agg(F.count("*").alias("files"))


@register("s8_templates_by_depth", """SELECT concat('w', s_suppkey) AS workflow_id, 'CheckpointLoaderSimple,KSampler' AS types, 'CheckpointLoaderSimple->KSampler' AS edges, concat('m', s_suppkey % 7) AS models, 2::BIGINT AS node_count
FROM supplier WHERE s_suppkey % 2 = 0""")
def s8_templates(spark, sf_dir):
    """Folder levels under a root count from 1: the files of tree a are on level 3, those of tree b on level 4, which is not looked at."""
    listing = folder_listing(spark, list(_tree(spark, sf_dir)), depth=2, suffixes="txt")
    found = files.templates_of(spark, listing, "*.txt")
    return found.select("workflow_id", *(F.concat_ws(",", c).alias(n) for c, n in (("t", "types"), ("e", "edges"), ("diffusion_models", "models"))), "node_count")


@register("s10_templates_of_sources", "SELECT concat('w', s_suppkey) AS workflow_id FROM supplier")
def s10_templates(spark, sf_dir):
    """Both trees, one of them named twice: each template once."""
    a, z = _tree(spark, sf_dir)
    return files.templates_of(spark, folder_listing(spark, [a, z, a + "/"], depth=4, suffixes="txt"), "*.txt").select("workflow_id")


@register("s16_signatures_for_source", f"""WITH {b.IMAGES_SQL} SELECT vec_id AS image_id, round(list_sum(embedding)::DOUBLE, 3) AS total FROM embeddings WHERE vec_id % 5 <> 0 AND vec_id % 7 <> 0
AND vec_id IN (SELECT id FROM images WHERE source_id = 1)""")
def s16_signatures(spark, sf_dir):
    i = F.col("vec_id")
    rows = b.table(spark, sf_dir, "embeddings").select(
        i.alias("image_id"), F.when(i % 5 == 0, "text").otherwise("vision").alias("slot"), F.lit("m").alias("model_id"), (F.size("embedding") + (i % 7 == 0).cast("int")).alias("dim"), F.col("embedding").alias("vec")
    )
    found = groups.signatures_for(rows, "vision", "m", b.images(spark, sf_dir), 1)
    return found.select("image_id", F.round(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x), 3).alias("total"))


@register("p9_probes", f"""WITH {b.SCORES_SQL} SELECT doc_id AS id, doc_id IN (SELECT image_id FROM scores) AS has_score, doc_id % 10 = 3 AS has_binding, coalesce(doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1), false) AS has_label FROM documents""")
def p9(spark, sf_dir):
    images = b.images(spark, sf_dir)
    bound = images.where("id % 10 = 3").select(F.lit(2).alias("level"), F.col("id").alias("image_id")).union(images.where("id % 20 = 3").select(F.lit(0), "id"))
    named = b.table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("image_id"))
    return groups.probes(images, b.scores(spark, sf_dir), bound, named)


@register("a1_template_names", f"""WITH {b.IMAGES_SQL}, g AS (SELECT group_key_l2 AS group_key, count(*) AS "count" FROM images WHERE NOT hidden GROUP BY 1),
n AS (SELECT group_key_l2 AS group_key, min(concat('template ', 9 - workflow_template_id)) AS template_name FROM images WHERE NOT hidden AND workflow_template_id > 0 GROUP BY 1)
SELECT g.group_key, "count", template_name FROM g LEFT JOIN n USING (group_key)""")
def a1_names(spark, sf_dir):
    images = b.images(spark, sf_dir)
    templates = images.select(F.col("workflow_template_id").alias("id")).where("id > 0").distinct().withColumn("name", F.concat(F.lit("template "), F.lit(9) - F.col("id")))
    listed = groups.list_groups(images, 2)
    return groups.with_template_names(listed, images, templates, 2).select("group_key", "count", "template_name")


@register("a15_group_diagnostics", f"""WITH {b.IMAGES_SQL} SELECT group_key_l1 AS group_key, string_agg(DISTINCT checkpoint, ',' ORDER BY checkpoint) AS checkpoints, string_agg(DISTINCT source_kind, ',' ORDER BY source_kind) AS source_kinds,
count(*) FILTER (hidden) AS hidden, sum(CASE WHEN meta_ok THEN 0 ELSE 1 END)::BIGINT AS failed FROM images GROUP BY 1""")
def a15(spark, sf_dir):
    return groups.diagnostics_by(b.images(spark, sf_dir), 1)


@register("r7_recovered_scores", """WITH s AS (SELECT doc_id AS image_id, quality * 10.0::DOUBLE AS score FROM labels), f AS (SELECT doc_id AS image_id, (doc_id % 50) * 1.0::DOUBLE AS found FROM documents WHERE doc_id % 3 = 0)
SELECT coalesce(s.image_id, f.image_id) AS image_id, coalesce(found, score) AS internal_score, CASE WHEN s.image_id IS NULL THEN 'recovered' ELSE 'swipe' END AS last_mode FROM s FULL JOIN f ON s.image_id = f.image_id""")
def r7(spark, sf_dir):
    scores_ = b.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("image_id"), (F.col("quality") * 10.0).alias("internal_score"), F.lit("swipe").alias("last_mode"))
    found = b.images(spark, sf_dir).where("id % 3 = 0").select(F.col("id").alias("image_id"), (F.col("id") % 50).cast("double").alias("internal_score"))
    return review.recovered_scores(scores_, found)


@register("g24_assigned_templates", f"""WITH {b.IMAGES_SQL} SELECT id, CASE WHEN workflow_template_id IS NOT NULL THEN workflow_template_id WHEN workflow_key IN ('w1', 'w5') THEN 77 ELSE -1 END AS template,
CASE WHEN workflow_template_id IS NULL AND workflow_key IN ('w1', 'w5') THEN 0.5::DOUBLE ELSE 0 END AS confidence FROM images""")
def g24(spark, sf_dir):
    images = b.images(spark, sf_dir).withColumn("workflow_match_confidence", F.lit(None).cast("double"))
    keys_ = images.select("workflow_key").distinct().where(F.col("workflow_key").isin("w1", "w5"))
    done = graphs.assign_templates(images, keys_.select("workflow_key", F.lit(77).cast("bigint").alias("template_id"), F.lit(0.5).alias("coverage")))
    return done.select("id", F.coalesce("workflow_template_id", F.lit(-1)).alias("template"), F.coalesce("workflow_match_confidence", F.lit(0.0)).alias("confidence"))


@register("p13_merge_in_source", f"""WITH {b.IMAGES_SQL} SELECT id AS image_id, group_key_l2 AS prev_group_key FROM images WHERE group_key_l2 IN ('en-0', 'en-3') AND source_id = 1""")
def p13(spark, sf_dir):
    return clustering.merge_groups(b.images(spark, sf_dir), ["en-0", "en-3"], source_id=1).select("image_id", "prev_group_key")


@register("f6_sanitized_json", """SELECT event_id, CASE event_type WHEN 'view' THEN '{"a": null, "b": "NaN", "c": [null, -1, null]}' WHEN 'click' THEN concat('{"x": ', event_id, ', "y": "-Infinity \\" NaN"}') ELSE event_type END AS payload FROM events""")
def f6(spark, sf_dir):
    text_ = F.when(F.col("event_type") == "view", '{"a": NaN, "b": "NaN", "c": [Infinity, -1, -Infinity]}').when(
        F.col("event_type") == "click", F.concat(F.lit('{"x": '), F.col("event_id").cast("string"), F.lit(', "y": "-Infinity \\" NaN"}'))
    ).otherwise(F.col("event_type"))
    return b.table(spark, sf_dir, "events").select("event_id", json_clean.sanitize_json(text_).alias("payload"))


@register("o9_shuffled", "SELECT count(*) AS n, count(DISTINCT doc_id) AS ids, 3::BIGINT AS saved_first FROM documents")
def o9(spark, sf_dir):
    """A shuffle keeps every row once and puts the saved order first."""
    rows = b.images(spark, sf_dir).select("id")
    saved = [r.id for r in rows.orderBy(F.desc("id")).limit(3).collect()]
    placed = ranking.shuffled(rows, 5, saved).withColumn("at", F.monotonically_increasing_id())
    first = table_of(placed).withColumn("rank", F.array_position(F.lit(saved).cast("array<bigint>"), F.col("id")))
    head = first.where("rank > 0").select("at", "rank").orderBy("at")
    in_order = [r.rank for r in head.collect()]  # three rows
    least = first.agg(F.min(F.when(F.col("rank") == 0, F.col("at"))).alias("m"), F.max(F.when(F.col("rank") > 0, F.col("at"))).alias("s"))
    good = F.lit(3 if in_order == [1, 2, 3] else 0).cast("bigint")
    return first.agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids")).join(least).select("n", "ids", F.when(F.col("m").isNull() | (F.col("s") < F.col("m")), good).otherwise(0).alias("saved_first"))
