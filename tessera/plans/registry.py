"""Registered queries of the engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import keys, scores, text
from tessera.operators import clustering, graphs, groups, identity, ranking, recommend, reconcile, review, similarity, vector_index
from tessera.plans import bindings as b
from tessera.store import scratch_path

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``, with its DuckDB SQL where it has one."""

    def add(query: Query) -> Query:
        _QUERIES[name] = query
        if sql is not None:
            _SQL[name] = sql
        return query

    return add


def queries() -> dict[str, Query]:
    import tessera.plans.ingest_queries  # noqa: F401  registers on import
    import tessera.plans.library_queries  # noqa: F401
    import tessera.streaming.queries  # noqa: F401

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)


def _listed(column: str) -> F.Column:
    return F.concat_ws(",", F.col(column).cast("array<string>")).alias(column)


# --- groups and facets

_SHOWN = ", ".join(f"min({c}) AS {c}" for c in groups.SHOWN)


def _groups(level: int, name: str) -> None:
    @register(name, f"WITH {b.IMAGES_SQL} SELECT group_key_l{level} AS group_key, count(*) AS \"count\", {_SHOWN} FROM images WHERE NOT hidden GROUP BY 1")
    def query(spark, sf_dir, level=level):
        return groups.list_groups(b.images(spark, sf_dir), level)


for _level, _name in enumerate(("a1_groups_folder", "a1_groups_model", "a1_groups_similar", "a1_groups_prompt")):
    _groups(_level, _name)


@register("a2_lora_groups", f"""WITH {b.IMAGES_SQL}, named AS (SELECT id, list_distinct(list_filter(lora_names, lambda x: x <> '')) AS n FROM images WHERE NOT hidden),
rows AS (SELECT id, unnest(CASE WHEN len(n) = 0 THEN ['(unknown)'] ELSE n END) AS name FROM named)
SELECT concat('lora-single:', name) AS group_key, count(*) AS "count" FROM rows GROUP BY 1""")
def a2(spark, sf_dir):
    return groups.lora_groups(b.images(spark, sf_dir))


@register("a3_model_facets", f"""WITH {b.IMAGES_SQL} SELECT group_key_l1, coalesce(nullif(diffusion_model, ''), '(未知)') AS model, count(*) AS "count"
FROM images WHERE NOT hidden GROUP BY 1, 2""")
def a3(spark, sf_dir):
    return groups.facet_counts(b.images(spark, sf_dir))


@register("a4_move_targets", f"""WITH {b.IMAGES_SQL} SELECT group_key_l2 AS group_key, count(*) AS "count", {_SHOWN} FROM images
WHERE NOT hidden AND group_key_l2 <> 'en-0' GROUP BY 1""")
def a4(spark, sf_dir):
    return groups.move_targets(b.images(spark, sf_dir), "en-0")


@register("a5_group_members", f"""WITH {b.IMAGES_SQL} SELECT group_key_l2 AS group_key, count(*) AS "count", min(prompt_pos) AS prompt_pos,
array_to_string(list(id ORDER BY id), ',') AS members FROM images GROUP BY 1""")
def a5(spark, sf_dir):
    return groups.group_members(b.images(spark, sf_dir)).withColumn("members", _listed("members"))


_A6 = """WITH rows AS (SELECT l_orderkey * 10 + l_linenumber AS id, p_name AS prompt_pos, '' AS prompt_neg, concat(p_brand, '|', p_type) AS recipe_signature,
  l_quantity * 2 AS score FROM lineitem JOIN part ON l_partkey = p_partkey),
ranked AS (SELECT *, row_number() OVER (PARTITION BY prompt_pos, prompt_neg, recipe_signature ORDER BY score DESC, id) AS rn FROM rows),
stats AS (SELECT prompt_pos, prompt_neg, recipe_signature, count(*) AS n, max(score) AS best_score, avg(score) AS mean_score, median(score) AS median_score,
  var_pop(score) AS variance, array_to_string(list(id ORDER BY rn) FILTER (WHERE rn <= 4), ',') AS example_ids FROM ranked GROUP BY 1, 2, 3),
shrunk AS (SELECT *, n / (n + 5.0) AS confidence, mean_score * (n / (n + 5.0)) + 50 * (1 - n / (n + 5.0)) AS shrunk_score FROM stats)
SELECT prompt_pos, prompt_neg, recipe_signature, n, round(best_score, 6) AS best_score, round(mean_score, 6) AS mean_score, round(median_score, 6) AS median_score,
round(variance, 6) AS variance, round(confidence, 6) AS confidence, round(shrunk_score, 6) AS shrunk_score, example_ids FROM shrunk"""


def _rounded(df: DataFrame) -> DataFrame:
    out = df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))
    return out.withColumn("example_ids", _listed("example_ids")) if "example_ids" in df.columns else out


@register("a6_recommend_all", _A6)
def a6_all(spark, sf_dir):
    return _rounded(recommend.recommend(b.recommendation_rows(spark, sf_dir)))


@register("a6_recommend_prompts", _A6 + " ORDER BY round(shrunk_score, 9) DESC, round(mean_score, 9) DESC, n DESC, prompt_pos, prompt_neg, recipe_signature LIMIT 10")
def a6(spark, sf_dir):
    return _rounded(recommend.recommend_prompts(b.recommendation_rows(spark, sf_dir), level=1))


@register("a8_coverage", """SELECT (SELECT count(*) FROM documents WHERE text <> '') AS total,
(SELECT count(*) FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings)) AS computed""")
def a8(spark, sf_dir):
    signatures = b.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.lit("text").alias("slot"), F.lit("m").alias("model_id"))
    return groups.coverage(b.images(spark, sf_dir), signatures, "text", "m")


@register("a12_unmatched_workflows", f"""WITH {b.IMAGES_SQL} SELECT workflow_key, min(group_key_l1) AS graph FROM images WHERE workflow_template_id IS NULL GROUP BY 1""")
def a12(spark, sf_dir):
    graph = F.struct(F.col("group_key_l1").alias("g"))
    return groups.unmatched_workflows(b.images(spark, sf_dir).withColumn("workflow_graph", graph)).select("workflow_key", F.col("workflow_graph.g").alias("graph"))


@register("a13_common_tokens", """WITH prompts AS (SELECT r_regionkey AS p, 'World region, ' || r_name AS t FROM region),
tok AS (SELECT DISTINCT p, unnest(regexp_split_to_array(lower(t), '[,\\s]+')) AS token FROM prompts)
SELECT token FROM tok WHERE token <> '' GROUP BY 1 HAVING count(*) = (SELECT count(*) FROM prompts)""")
def a13(spark, sf_dir):
    return recommend.common_tokens(b.table(spark, sf_dir, "region").select(F.concat(F.lit("World region, "), "r_name").alias("prompt_pos")))


@register("a14_source_stats", f"WITH {b.IMAGES_SQL} SELECT source_id, count(*) AS file_count, max(modified_at) AS newest_mtime FROM images GROUP BY 1")
def a14(spark, sf_dir):
    return groups.source_stats(b.images(spark, sf_dir))


@register("a17_thumbnails", f"""WITH {b.IMAGES_SQL}, r AS (SELECT group_key_l1 AS group_key, abs_path,
row_number() OVER (PARTITION BY group_key_l1 ORDER BY seed, filename, id) AS rn FROM images WHERE NOT hidden)
SELECT group_key, array_to_string(list(abs_path ORDER BY rn), ',') AS paths FROM r WHERE rn <= 4 GROUP BY 1""")
def a17(spark, sf_dir):
    return groups.thumbnails(b.images(spark, sf_dir), 1).withColumn("paths", _listed("paths"))


_EXPORT = f"""WITH {b.IMAGES_SQL}, {b.SCORES_SQL}, rows AS (SELECT id, filename, abs_path, concat('/lib/', group_key_l0) AS source, prompt_pos AS prompt_positive, prompt_neg AS prompt_negative,
checkpoint AS model, concat('[', array_to_string(list_transform(lora_names, lambda x: concat('{{"name":"', x, '","strength":1.0}}')), ','), ']') AS loras, '' AS vae, '' AS sampler,
seed, steps, 0.0::DOUBLE AS cfg, group_key_l3 AS group_key, concat_ws(';', CASE WHEN quality = 1 THEN 'good' END, CASE WHEN toxic = 1 THEN 'toxic' END) AS labels,
internal_score AS score, '' AS notes, '' AS scanned_at FROM images LEFT JOIN scores ON id = image_id LEFT JOIN labels ON id = doc_id)"""


def _export(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.operators.export import export_rows

    labels = b.table(spark, sf_dir, "labels")
    names = spark.createDataFrame([(1, "good"), (2, "toxic")], "id bigint, name string")
    on = labels.where("quality = 1").select(F.col("doc_id").alias("image_id"), F.lit(1).cast("bigint").alias("label_id")).union(
        labels.where("toxic = 1").select(F.col("doc_id").alias("image_id"), F.lit(2).cast("bigint").alias("label_id"))
    )
    images = b.images(spark, sf_dir)
    sources = images.select(F.col("source_id").alias("id"), F.concat(F.lit("/lib/"), "group_key_l0").alias("path")).distinct()
    return export_rows(images, sources, b.scores(spark, sf_dir), on, names)


@register("a18_export_rows", _EXPORT + " SELECT * FROM rows")
def a18(spark, sf_dir):
    return _export(spark, sf_dir)


@register("k1_export_csv", _EXPORT + """ SELECT filename, abs_path, source, md5(prompt_positive) AS prompt_positive, model, loras, seed::VARCHAR AS seed, steps::VARCHAR AS steps, '0.0' AS cfg, group_key,
labels, CASE WHEN score IS NULL THEN '' ELSE printf('%.2f', score) END AS score, concat(prompt_negative, vae, sampler, notes, scanned_at) AS empty FROM rows""")
def k1(spark, sf_dir):
    """The file as it is read back."""
    from tessera.operators.export import COLUMNS, write_csv

    path = scratch_path(spark, "export")
    write_csv(_export(spark, sf_dir), path)
    back = spark.read.options(header=True, multiLine=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path).na.fill("")
    assert tuple(back.columns) == COLUMNS
    empty = F.concat("prompt_negative", "vae", "sampler", "notes", "scanned_at").alias("empty")
    return back.select("filename", "abs_path", "source", F.md5("prompt_positive").alias("prompt_positive"), "model", "loras", "seed", "steps", "cfg", "group_key", "labels", "score", empty)


@register("k2_export_json", _EXPORT + """ SELECT filename, md5(prompt_positive) AS prompt_positive, loras, seed, cfg, labels, score, notes FROM rows""")
def k2(spark, sf_dir):
    from tessera.operators.export import write_json

    path = scratch_path(spark, "export")
    write_json(_export(spark, sf_dir), path)
    return spark.read.json(path).select("filename", F.md5("prompt_positive").alias("prompt_positive"), "loras", "seed", "cfg", "labels", "score", "notes")


_FILES = """files AS (SELECT doc_id AS id, concat('m', doc_id % 3) AS folder, CASE WHEN doc_id % 10 = 0 THEN concat('img', doc_id % 7, '_', doc_id % 9 + 1, '.png') ELSE concat('img', doc_id % 7, '.png') END AS filename FROM documents),
taken AS (SELECT 'm1' AS folder, unnest(['img2.png', 'img2_1.png', 'img3_2.png']) AS filename)"""


@register("k3_archive_plan", f"""WITH {_FILES}, r AS (SELECT id, folder, filename, row_number() OVER (PARTITION BY folder, filename ORDER BY id)
  - CASE WHEN (folder, filename) IN (SELECT (folder, filename) FROM taken) THEN 0 ELSE 1 END AS rank FROM files),
used AS (SELECT DISTINCT folder, regexp_extract(filename, '^(.+)_([0-9]+)\\.png$', 1) AS stem, try_cast(regexp_extract(filename, '^(.+)_([0-9]+)\\.png$', 2) AS BIGINT) AS k
  FROM (SELECT folder, filename FROM files UNION SELECT folder, filename FROM taken) WHERE regexp_matches(filename, '_[0-9]+\\.png$')),
free AS (SELECT g.folder, g.stem, n.k, row_number() OVER (PARTITION BY g.folder, g.stem ORDER BY n.k) AS rank
  FROM (SELECT folder, replace(filename, '.png', '') AS stem, max(rank) AS most FROM r WHERE rank > 0 GROUP BY 1, 2) g, LATERAL (SELECT unnest(range(1, g.most + 100)) AS k) n
  WHERE NOT EXISTS (SELECT 1 FROM used u WHERE u.folder = g.folder AND u.stem = g.stem AND u.k = n.k))
SELECT id, r.folder, CASE WHEN r.rank = 0 THEN filename ELSE concat(free.stem, '_', free.k, '.png') END AS name FROM r LEFT JOIN free ON r.folder = free.folder AND free.stem = replace(filename, '.png', '') AND free.rank = r.rank""")
def k3(spark, sf_dir):
    from tessera.operators.export import archive_plan

    own = F.concat(F.lit("img"), (F.col("doc_id") % 7).cast("string"))
    name = F.when(F.col("doc_id") % 10 == 0, F.concat(own, F.lit("_"), (F.col("doc_id") % 9 + 1).cast("string"), F.lit(".png"))).otherwise(F.concat(own, F.lit(".png")))
    files = b.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("").alias("abs_path"), name.alias("filename"), F.concat(F.lit("m"), (F.col("doc_id") % 3).cast("string")).alias("checkpoint"))
    taken = spark.createDataFrame([("m1", "img2.png"), ("m1", "img2_1.png"), ("m1", "img3_2.png")], "folder string, filename string")
    return archive_plan(files, "checkpoint", taken).select("id", "folder", "name")


@register("p5_needs_reparse", f"WITH {b.IMAGES_SQL} SELECT id FROM images WHERE NOT meta_ok OR parser_version IS DISTINCT FROM 'v2'")
def p5(spark, sf_dir):
    return b.images(spark, sf_dir).where(groups.needs_reparse("v2")).select("id")


@register("p6_has_lora", f"WITH {b.IMAGES_SQL} SELECT id, list_contains(lora_names, 'a') AS has_a, len(list_filter(lora_names, lambda x: x <> '')) = 0 AS none FROM images")
def p6(spark, sf_dir):
    return b.images(spark, sf_dir).select("id", groups.has_lora("a").alias("has_a"), groups.without_lora().alias("none"))


@register("p12_can_move", f"""WITH {b.IMAGES_SQL} SELECT group_key_l3 AS selection, count(DISTINCT source_id) = 1 AS one_source, count(*) FILTER (WHERE group_key_l2 = 'en-0') = 0 AS none_inside,
(SELECT coalesce(bool_or(group_key_l2 = 'en-0'), false) FROM images) AS target_exists FROM images GROUP BY 1""")
def p12(spark, sf_dir):
    images = b.images(spark, sf_dir)
    return groups.can_move(images, images.select(F.col("group_key_l3").alias("selection"), "id"), "en-0")


@register("j5_image_rows", f"""WITH {b.IMAGES_SQL}, {b.SCORES_SQL} SELECT id, concat('/lib/', group_key_l0) AS source_path, concat('t', workflow_template_id) AS template_name,
CASE WHEN id % 10 = 3 THEN 'move' END AS binding_kind, coalesce(internal_score, 50.0) AS score, internal_score IS NOT NULL AS scored,
coalesce((SELECT 'toxic' FROM labels WHERE doc_id = id AND toxic = 1 LIMIT 1), '') AS labels FROM images LEFT JOIN scores ON id = image_id""".replace("concat('t', workflow_template_id)", "CASE WHEN workflow_template_id IS NOT NULL THEN concat('t', workflow_template_id) END"))
def j5(spark, sf_dir):
    images = b.images(spark, sf_dir)
    sources = images.select(F.col("source_id").alias("id"), F.concat(F.lit("/lib/"), "group_key_l0").alias("path")).distinct()
    templates = spark.range(3).select("id", F.concat(F.lit("t"), F.col("id").cast("string")).alias("name"))
    bound = images.where("id % 10 = 3").select(F.lit(2).alias("level"), F.col("id").alias("image_id"), F.lit("move").alias("kind"))
    toxic = b.table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("image_id"), F.lit(1).cast("bigint").alias("label_id"))
    names = spark.createDataFrame([(1, "toxic")], "id bigint, name string")
    rows = groups.image_rows(images, sources, templates, bound, b.scores(spark, sf_dir), toxic, names)
    return rows.select("id", "source_path", "template_name", "binding_kind", "score", "scored", _listed("labels"))


@register("j19_disk_status", """WITH a AS (SELECT DISTINCT concat('/lib/', doc_id) AS p FROM documents WHERE doc_id % 10 <> 0),
d AS (SELECT DISTINCT concat('/lib/', doc_id) AS p FROM documents WHERE doc_id % 10 <> 1)
SELECT coalesce(a.p, d.p) AS path, CASE WHEN d.p IS NULL THEN 'missing' WHEN a.p IS NULL THEN 'new' ELSE 'matched' END AS status FROM a FULL JOIN d ON a.p = d.p""")
def j19(spark, sf_dir):
    docs = b.table(spark, sf_dir, "documents").withColumn("norm_path", text.normalize_path(F.concat(F.lit("/lib/"), F.col("doc_id").cast("string"), F.lit("/"))))
    return groups.disk_status(docs.where("doc_id % 10 <> 0"), docs.where("doc_id % 10 <> 1"))


# --- keys and text


@register("g1_group_keys", f"""WITH {b.IMAGES_SQL}, k AS (SELECT id, source_id, prompt_pos, group_key_l0,
substr(md5(concat('model-deviation:v2', chr(1), 'base_model', chr(1), coalesce(nullif(diffusion_model, ''), checkpoint), chr(31))), 1, 16) AS l1 FROM images)
SELECT id, substr(md5(group_key_l0), 1, 16) AS l0, l1, substr(md5(concat('model-deviation:v2', chr(1), 'base_model', chr(1), l1, chr(3),
lower(trim(regexp_replace(prompt_pos, '\\s+', ' ', 'g'))))), 1, 16) AS l3 FROM k""")
def g1(spark, sf_dir):
    images = b.images(spark, sf_dir)
    values = keys.dimension_values("base_model", {c: F.col(c) for c in ("diffusion_model", "checkpoint")})
    keyed = images.withColumn("l1", keys.key_l1("base_model", values))
    return keyed.select("id", keys.key_l0(F.col("group_key_l0")).alias("l0"), "l1", keys.key_l3("base_model", F.col("l1"), F.col("prompt_pos")).alias("l3"))


@register("g2_lora_key", f"""WITH {b.IMAGES_SQL}, n AS (SELECT id, list_sort(list_distinct(list_filter(lora_names, lambda x: x <> ''))) AS v FROM images),
w AS (SELECT id, CASE WHEN len(v) = 0 THEN ['(unknown)'] ELSE v END AS v FROM n)
SELECT id, substr(md5(concat('model-deviation:v2', chr(1), 'lora', chr(1), array_to_string(list_transform(v, lambda x: x || chr(31)), ''))), 1, 16) AS l1,
CASE WHEN len(v) > 1 THEN concat(array_to_string(v, ' + '), ' (×', len(v), ')') ELSE v[1] END AS label FROM w""")
def g2(spark, sf_dir):
    values = keys.dimension_values("lora", {"loras": F.col("loras")})
    return b.images(spark, sf_dir).select("id", keys.key_l1("lora", values).alias("l1"), keys.dimension_label(values).alias("label"))


def _rehash(dimension: str, value: str) -> None:
    value = f"coalesce(nullif(trim({value}), ''), '(unknown)')"
    l1 = f"substr(md5(concat('model-deviation:v2', chr(1), '{dimension}', chr(1), {value}, chr(31))), 1, 16)"

    @register(f"g3_rehash_{dimension}", f"""WITH {b.IMAGES_SQL}, k AS (SELECT id, prompt_pos, {l1} AS l1 FROM images)
SELECT id, l1 AS group_key_l1, l1 AS group_key_l2, substr(md5(concat('model-deviation:v2', chr(1), '{dimension}', chr(1), l1, chr(3), lower(trim(regexp_replace(prompt_pos, '\\s+', ' ', 'g'))))), 1, 16) AS group_key_l3 FROM k""")
    def query(spark, sf_dir, dimension=dimension):
        return groups.rehash(b.images(spark, sf_dir), dimension)


for _dimension, _value in {
    "base_model": "coalesce(nullif(trim(diffusion_model), ''), checkpoint)", "diffusion_model": "diffusion_model", "text_encoder": "text_encoder", "controlnet": "controlnet",
}.items():
    _rehash(_dimension, _value)


@register("g2_embedding_key", """WITH t AS (SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN [concat('e', doc_id % 5)] WHEN doc_id % 3 = 1 THEN list_sort([concat('e', doc_id % 5), 'z 9']) ELSE ['(unknown)'] END AS v FROM documents)
SELECT id, substr(md5(concat('model-deviation:v2', chr(1), 'embedding', chr(1), array_to_string(list_transform(v, lambda x: x || chr(31)), ''))), 1, 16) AS l1 FROM t""")
def g2_embedding(spark, sf_dir):
    k = (F.col("doc_id") % 5).cast("string")
    prompt = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("a cat, embedding:e"), k, F.lit("., x"))).when(
        F.col("doc_id") % 3 == 1, F.concat(F.lit("Embedding:z 9, b (embedding:e"), k, F.lit(")"))
    ).otherwise("none of them: xembedding:q")
    values = keys.dimension_values("embedding", {"prompt_pos": F.col("prompt_pos")})
    return b.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), prompt.alias("prompt_pos")).select("id", keys.key_l1("embedding", values).alias("l1"))


@register("g4_tokens", """WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[,\\s]+'), lambda x: x <> '') AS tok FROM documents)
SELECT doc_id, len(tok) AS n_tokens, len(list_distinct(tok)) AS n_distinct FROM t""")
def g4(spark, sf_dir):
    tok = text.prompt_tokens(F.col("text"))
    return b.table(spark, sf_dir, "documents").select("doc_id", F.size(tok).cast("bigint").alias("n_tokens"), F.size(F.array_distinct(tok)).cast("bigint").alias("n_distinct"))


@register("f1_normalize", "SELECT doc_id, md5(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS h FROM documents")
def f1(spark, sf_dir):
    return b.table(spark, sf_dir, "documents").select("doc_id", F.md5(text.normalize_prompt(F.col("text"))).alias("h"))


@register("f7_labels", """WITH t AS (SELECT doc_id, text, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS s FROM documents)
SELECT doc_id, substr(text, 1, 120) AS label, CASE WHEN length(s) > 40 THEN substr(s, 1, 40) || '…' ELSE s END AS compact FROM t""")
def f7(spark, sf_dir):
    return b.table(spark, sf_dir, "documents").select("doc_id", text.group_label(F.col("text")).alias("label"), text.compact_label(F.col("text")).alias("compact"))


@register("f20_mask", "SELECT doc_id, md5(regexp_replace(text, '[A-Za-z0-9\\x{00C0}-\\x{024F}]', 'x', 'g')) AS h FROM documents")
def f20(spark, sf_dir):
    return b.table(spark, sf_dir, "documents").select("doc_id", F.md5(text.mask(F.col("text"))).alias("h"))


@register("f26_prompt_diff", """WITH t AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_split_to_array(lower(text), '[,\\s]+'), lambda x: x <> '')) AS tok,
row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS rn FROM conversations)
SELECT a.conv_id, a.turn, len(list_filter(a.tok, lambda x: NOT list_contains(b.tok, x))) AS n_new FROM t a JOIN t b ON a.conv_id = b.conv_id AND a.rn = b.rn + 1""")
def f26(spark, sf_dir):
    order = W.partitionBy("conv_id").orderBy("turn", "text")
    rows = b.table(spark, sf_dir, "conversations").withColumn("before", F.lag("text").over(order)).withColumn("rn", F.row_number().over(order)).where("rn > 1")
    return rows.select("conv_id", "turn", F.size(text.prompt_diff(F.col("text"), F.col("before"))).cast("bigint").alias("n_new"))


@register("f12_swipe_arena", """WITH s AS (SELECT custkey, a, b FROM (SELECT c_custkey AS custkey, (c_custkey * 7 % 101)::DOUBLE AS a, (c_custkey * 13 % 101)::DOUBLE AS b FROM customer)),
e AS (SELECT *, 8 * (1 - 1 / (1 + pow(10, (b - a) / 40))) AS d FROM s)
SELECT custkey, round(greatest(0, least(100, a + 10)), 6) AS swiped, round(greatest(0, least(100, a + d)), 6) AS winner, round(greatest(0, least(100, b - d)), 6) AS loser,
abs(a - b) < 5 AS close FROM e""")
def f12(spark, sf_dir):
    rows = b.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("custkey"), (F.col("c_custkey") * 7 % 101).cast("double").alias("a"), (F.col("c_custkey") * 13 % 101).cast("double").alias("b")
    )
    won, lost = scores.arena(F.col("a"), F.col("b"), F.lit(True))
    return rows.select(
        "custkey", F.round(scores.swiped(F.col("a"), F.lit("right")), 6).alias("swiped"), F.round(won, 6).alias("winner"), F.round(lost, 6).alias("loser"),
        scores.close_match(F.col("a"), F.col("b")).alias("close"),
    )


# --- similarity, clustering, identity

_TOKENS = """tok AS (SELECT doc_id AS id, lang AS bucket, list_distinct(list_filter(regexp_split_to_array(lower(text), '[,\\s]+'), lambda x: x <> '')) AS t FROM documents),
x AS (SELECT bucket, id, len(t) AS n, unnest(t) AS w FROM tok),
common AS (SELECT a.bucket, a.id AS a, b.id AS b, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb FROM x a JOIN x b ON a.bucket = b.bucket AND a.w = b.w AND a.id < b.id GROUP BY 1, 2, 3),
pairs AS (SELECT bucket, a, b, c / (na + nb - c) AS sim FROM common WHERE c / (na + nb - c) >= 0.3)"""


def _bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = b.table(spark, sf_dir, "documents")
    return docs.select(F.col("lang").alias("bucket"), F.col("doc_id").alias("id"), text.token_set(F.col("text")).alias("tokens"))


@register("j10_jaccard_pairs", f"WITH {_TOKENS} SELECT bucket, a, b, round(sim, 6) AS sim FROM pairs")
def j10(spark, sf_dir):
    return similarity.jaccard_pairs(_bucketed(spark, sf_dir), 0.3).withColumn("sim", F.round("sim", 6))


_COMPONENTS = """both_ways AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach(node, root) AS (SELECT DISTINCT a, a FROM both_ways UNION SELECT both_ways.b, reach.root FROM reach JOIN both_ways ON reach.node = both_ways.a),
comp AS (SELECT node, min(root) AS component FROM reach GROUP BY 1)"""


@register("g6_single_linkage", f"WITH RECURSIVE {_TOKENS}, {_COMPONENTS} SELECT bucket, id, coalesce(component, id) AS cluster FROM tok LEFT JOIN comp ON id = node")
def g6(spark, sf_dir):
    return clustering.single_linkage(_bucketed(spark, sf_dir), 0.3)


@register("g11_recluster_text", f"""WITH RECURSIVE {_TOKENS}, {_COMPONENTS},
c AS (SELECT bucket, id, coalesce(component, id) AS cluster FROM tok LEFT JOIN comp ON id = node),
h AS (SELECT doc_id, substr(md5(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))), 1, 16) AS h FROM documents),
k AS (SELECT bucket, cluster, list_sort(list_distinct(list(h))) AS hs FROM c JOIN h ON id = doc_id GROUP BY 1, 2)
SELECT c.id, CASE WHEN c.id % 50 = 7 THEN 'pinned' ELSE substr(md5(concat(c.bucket, chr(2), array_to_string(hs, chr(2)))), 1, 16) END AS group_key
FROM c JOIN k USING (bucket, cluster)""")
def g11(spark, sf_dir):
    images = b.images(spark, sf_dir)
    bound = images.where("id % 50 = 7").select(F.lit(2).alias("level"), F.col("id").alias("image_id"), F.lit("pinned").alias("group_key"))
    return clustering.recluster_text(images, bound)


_DOT = "list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


@register("j11_cosine_pairs", f"""SELECT a.label::VARCHAR AS bucket, a.vec_id AS a, b.vec_id AS b, round({_DOT}, 5) AS sim
FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE {_DOT} >= 0.3""")
def j11(spark, sf_dir):
    return similarity.cosine_pairs(b.vectors(spark, sf_dir), 0.3).withColumn("sim", F.round("sim", 5))


@register("j10_jaccard_links", f"""WITH {_TOKENS}, links AS (SELECT a AS id, b FROM pairs UNION ALL SELECT b, a FROM pairs), n AS (SELECT id, count(*) AS n FROM links GROUP BY 1),
r AS (SELECT bucket, list_sort(t) AS t, min(id) AS rep FROM tok GROUP BY 1, 2)
SELECT tok.bucket, tok.id, rep, coalesce(n, 0)::BIGINT AS n_links FROM tok JOIN r ON tok.bucket = r.bucket AND list_sort(tok.t) = r.t LEFT JOIN n ON tok.id = n.id""")
def j10_links(spark, sf_dir):
    return similarity.jaccard_links(_bucketed(spark, sf_dir), 0.3)


@register("g7_average_linkage")
def g7(spark, sf_dir):
    return clustering.average_linkage(b.vectors(spark, sf_dir), 0.25)


@register("a9_nearest_member", f"""SELECT e.vec_id AS id, e.label::VARCHAR AS group_key, round((SELECT max({_DOT}) FROM embeddings a, embeddings b WHERE a.vec_id = e.vec_id
AND b.label = a.label AND b.vec_id <> a.vec_id), 5) AS nearest FROM embeddings e""")
def a9(spark, sf_dir):
    rows = b.vectors(spark, sf_dir).withColumnRenamed("bucket", "group_key")
    return similarity.nearest_member(rows).withColumn("nearest", F.round("nearest", 5))


@register("g20_outliers", f"""WITH near AS (SELECT a.vec_id AS id, a.label::VARCHAR AS group_key, max({_DOT}) AS nearest FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id
GROUP BY 1, 2 HAVING max({_DOT}) < 0.3),
o AS (SELECT a.vec_id AS id, b.label::VARCHAR AS g, max({_DOT}) AS sim FROM embeddings a, embeddings b WHERE a.label <> b.label GROUP BY 1, 2 HAVING max({_DOT}) > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, g DESC) AS rn FROM o)
SELECT near.id, group_key, round(nearest, 5) AS nearest, g AS best_group, round(sim, 5) AS best_sim FROM near LEFT JOIN r ON near.id = r.id AND rn = 1""")
def g20(spark, sf_dir):
    rows = b.vectors(spark, sf_dir).withColumnRenamed("bucket", "group_key")
    return similarity.outliers(rows, threshold=0.3).withColumn("nearest", F.round("nearest", 5)).withColumn("best_sim", F.round("best_sim", 5))


_J11 = f"""SELECT a.label::VARCHAR AS bucket, a.vec_id AS a, b.vec_id AS b, round({_DOT}, 5) AS sim
FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE {_DOT} >= 0.3"""


@register("j11_indexed_pairs", _J11)
def j11_indexed(spark, sf_dir):
    index = vector_index.build(b.vectors(spark, sf_dir))
    return vector_index.close_pairs(index, 0.3).withColumn("sim", F.round("sim", 5))


@register("a9_indexed_nearest", f"""SELECT a.label::VARCHAR AS group_key, a.vec_id AS id, round(max({_DOT}), 5) AS nearest FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id GROUP BY 1, 2""")
def a9_indexed(spark, sf_dir):
    index = vector_index.build(b.vectors(spark, sf_dir))
    return vector_index.nearest(index).select(F.col("bucket").alias("group_key"), "id", F.round("sim", 5).alias("nearest"))


@register("g20_indexed_others", f"""WITH o AS (SELECT a.vec_id AS id, a.label::VARCHAR AS group_key, b.label::VARCHAR AS g, max({_DOT}) AS sim FROM embeddings a JOIN embeddings b ON a.label <> b.label GROUP BY 1, 2, 3)
SELECT id, group_key, g AS best_group, round(sim, 5) AS best_sim FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, g DESC) AS rn FROM o) WHERE rn = 1""")
def g20_indexed(spark, sf_dir):
    index = vector_index.build(b.vectors(spark, sf_dir))
    return vector_index.nearest(index, same=False).select("id", F.col("bucket").alias("group_key"), F.col("near").alias("best_group"), F.round("sim", 5).alias("best_sim"))


@register("g21_suggest_groups", f"""WITH best AS (SELECT a.label AS own, b.label, a.vec_id, max({_DOT}) AS best FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND b.label <> a.label GROUP BY 1, 2, 3)
SELECT own::VARCHAR AS group_key, label::VARCHAR AS other_group, round(avg(best), 5) AS score, (SELECT count(*) FROM embeddings e WHERE e.label = best.label) AS "count" FROM best GROUP BY own, label""")
def g21(spark, sf_dir):
    rows = b.vectors(spark, sf_dir).withColumnRenamed("bucket", "group_key")
    return similarity.suggest_groups(rows.where("id % 50 = 0"), rows).withColumn("score", F.round("score", 5))


@register("g21_suggest_by_tokens", """WITH t AS (SELECT s_suppkey AS id, s_nationkey::VARCHAR AS g, list_distinct(list_filter(regexp_split_to_array(lower(concat(s_name, ' n', s_nationkey % 5, ' a', s_suppkey % 7)), '[,\\s]+'), lambda x: x <> '')) AS w FROM supplier),
best AS (SELECT a.g, b.g AS o, a.id, max(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w)))) AS best FROM t a, t b WHERE a.id % 50 = 0 AND a.g <> b.g GROUP BY 1, 2, 3 HAVING best > 0),
asked AS (SELECT g, count(*) AS n FROM t WHERE id % 50 = 0 GROUP BY 1)
SELECT best.g AS group_key, o AS other_group, round(sum(best) / any_value(asked.n), 6) AS score, (SELECT count(*) FROM t WHERE t.g = o) AS "count" FROM best JOIN asked ON best.g = asked.g GROUP BY best.g, o""")
def g21_tokens(spark, sf_dir):
    words = F.concat("s_name", F.lit(" n"), (F.col("s_nationkey") % 5).cast("string"), F.lit(" a"), (F.col("s_suppkey") % 7).cast("string"))
    rows = b.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("string").alias("group_key"), F.col("s_suppkey").alias("id"), text.token_set(words).alias("tokens"))
    return similarity.suggest_by_tokens(rows.where("id % 50 = 0"), rows).withColumn("score", F.round("score", 6))


MATCH_SQL = f"""{b.IDENTITY_SQL}, keyed AS (SELECT id, side, 1 AS tier, 'content_key' AS basis, content_key AS k FROM files
  UNION ALL SELECT id, side, 2, 'metadata', meta_sig FROM files UNION ALL SELECT id, side, 3, 'content_hash', content_fp FROM files),
once AS (SELECT tier, basis, k, side, min(id) AS id FROM keyed WHERE k <> '' GROUP BY 1, 2, 3, 4 HAVING count(*) = 1),
pairs AS (SELECT a.tier, a.basis, a.id AS old_id, b.id AS new_id FROM once a JOIN once b ON a.tier = b.tier AND a.k = b.k AND a.side = 0 AND b.side = 1),
m1 AS (SELECT * FROM pairs WHERE tier = 1),
m2 AS (SELECT * FROM m1 UNION ALL SELECT * FROM pairs WHERE tier = 2 AND old_id NOT IN (SELECT old_id FROM m1) AND new_id NOT IN (SELECT new_id FROM m1)),
m AS (SELECT * FROM m2 UNION ALL SELECT * FROM pairs WHERE tier = 3 AND old_id NOT IN (SELECT old_id FROM m2) AND new_id NOT IN (SELECT new_id FROM m2))"""


@register("g18_match_files", f"WITH {MATCH_SQL} SELECT old_id, new_id, basis FROM m")
def g18(spark, sf_dir):
    return identity.match_files(b.identity_rows(spark, sf_dir, 0), b.identity_rows(spark, sf_dir, 1))


@register("a11_basis_histogram", f"WITH {MATCH_SQL} SELECT basis, count(*) AS n FROM m GROUP BY 1")
def a11(spark, sf_dir):
    return identity.basis_histogram(g18(spark, sf_dir))


@register("j17_majority_keys", f"""WITH {MATCH_SQL}, v AS (SELECT o.group_key_l2 AS old_key, n.group_key_l2 AS new_key, count(*) AS c FROM m JOIN files o ON m.old_id = o.id JOIN files n ON m.new_id = n.id GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY old_key ORDER BY c DESC, new_key) AS rn FROM v) SELECT old_key, new_key FROM r WHERE rn = 1""")
def j17(spark, sf_dir):
    old, new = b.identity_rows(spark, sf_dir, 0), b.identity_rows(spark, sf_dir, 1)
    return reconcile.majority_keys(identity.match_files(old, new), old, new)


@register("j15_graph_containment", """WITH g AS (SELECT concat('s', l_suppkey) AS k, list(DISTINCT l_returnflag) AS t, list(DISTINCT concat(l_returnflag, '->', l_linestatus)) AS e FROM lineitem GROUP BY 1),
u AS (SELECT l_partkey AS id, concat('p', l_partkey) AS name, list(DISTINCT l_returnflag) AS t, list(DISTINCT concat(l_returnflag, '->', l_linestatus)) AS e FROM lineitem GROUP BY l_partkey),
m AS (SELECT g.k, u.id, len(g.e) / len(u.e) AS coverage, row_number() OVER (PARTITION BY g.k ORDER BY len(u.e) - len(g.e), lower(u.name), u.id) AS rn
FROM g JOIN u ON list_has_all(u.t, g.t) AND list_has_all(u.e, g.e))
SELECT k AS workflow_key, id AS template_id, round(coverage, 6) AS coverage FROM m WHERE rn = 1""")
def j15(spark, sf_dir):
    line = b.table(spark, sf_dir, "lineitem").withColumn("edge", F.concat("l_returnflag", F.lit("->"), "l_linestatus"))
    sets = [F.collect_set("l_returnflag").alias("t"), F.collect_set("edge").alias("e")]
    g = line.groupBy(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("workflow_key")).agg(*sets)
    t = line.groupBy(F.col("l_partkey").alias("template_id")).agg(*sets).withColumn("name", F.concat(F.lit("p"), F.col("template_id").cast("string")))
    return graphs.contained(g, t).withColumn("coverage", F.round("coverage", 6))


# --- review, ranking


def _browse(order: str, by: str) -> None:
    @register(f"o4_browse_{order}", f"WITH {b.IMAGES_SQL}, {b.SCORES_SQL}, r AS (SELECT id, row_number() OVER (ORDER BY {by}seed, filename, id) AS rn FROM images LEFT JOIN scores ON id = image_id) SELECT id, rn AS place FROM r")
    def query(spark, sf_dir, order=order):
        scored = b.images(spark, sf_dir).join(b.scores(spark, sf_dir).withColumnsRenamed({"image_id": "id", "internal_score": "score"}), "id", "left")
        return ranking.places(scored, order).select("id", "place")


for _order, _by in {
    "score_desc": "coalesce(internal_score, 50) DESC, ", "score_asc": "coalesce(internal_score, 50), ", "seed": "", "size_desc": "size DESC, ", "size_asc": "size, ",
    "mtime_desc": "modified_at DESC, ", "mtime_asc": "modified_at, ",
}.items():
    _browse(_order, _by)


@register("r1_swipe_scores", """WITH e AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'purchase' THEN 10.0 WHEN 'click' THEN 5.0 WHEN 'error' THEN -10.0 WHEN 'view' THEN 0.0 END AS d FROM events)
SELECT user_id AS image_id, list_reduce(list_prepend(50.0::DOUBLE, list(d::DOUBLE ORDER BY ts, event_id)), lambda x, y: greatest(0, least(100, x + y))) AS score
FROM e WHERE d IS NOT NULL GROUP BY 1""")
def r1(spark, sf_dir):
    gesture = F.when(F.col("event_type") == "purchase", "right").when(F.col("event_type") == "click", "up").when(F.col("event_type") == "error", "left").when(F.col("event_type") == "view", "down")
    rows = b.table(spark, sf_dir, "events").select(F.col("user_id").alias("image_id"), gesture.alias("gesture"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"))
    return review.swipe_scores(rows)


@register("r2_review_state")
def r2(spark, sf_dir):
    events = b.table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    other = F.col("user_id") + 1
    vote = F.col("event_type").isin("click", "purchase")
    mode = F.when(vote, "arena").when(F.col("event_type") == "error", "hide").when(F.col("event_type") == "signup", "unhide").otherwise("swipe")
    rows = events.withColumn("mode", mode).select(
        F.col("event_id").cast("string").alias("action_id"), "mode", F.when(~vote, F.col("user_id")).alias("image_id"), F.when(vote, F.col("user_id")).alias("left"),
        F.when(vote, other).alias("right"), F.lit("up").alias("gesture"), F.when(vote, F.when(F.col("value") > 10, F.col("user_id")).otherwise(other)).alias("winner"),
        F.lit(None).cast("string").alias("undo_of"), "at",
    )
    return review.review_state(rows).withColumn("score", F.round("score", 6))


@register("r8_check_telemetry", """SELECT CASE WHEN value < 0 THEN 'severity' WHEN event_type = 'error' THEN 'payload_key' ELSE 'ok' END AS verdict, count(*) AS n FROM events GROUP BY 1""")
def r8(spark, sf_dir):
    events = b.table(spark, sf_dir, "events").select(
        F.col("event_type").alias("event_name"), F.concat(F.lit("u-"), F.col("user_id").cast("string")).alias("session_id"),
        F.when(F.col("value") < 0, "loud").otherwise("info").alias("severity"),
        F.when(F.col("event_type") == "error", F.lit('{"a": [{"filePath": 1}]}')).otherwise(F.lit('{"n": 1}')).alias("payload"),
    )
    good, bad = review.check_telemetry(events)
    return good.select(F.lit("ok").alias("verdict")).union(bad.select("reason")).groupBy("verdict").agg(F.count("*").alias("n"))


@register("k5_newest_events", "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 200")
def k5(spark, sf_dir):
    return review.newest(b.table(spark, sf_dir, "events"), 200, at="ts").select("event_id", "event_type")


@register("o4_browse_natural", f"WITH {b.IMAGES_SQL}, r AS (SELECT id, row_number() OVER (ORDER BY id % 997, seed, filename, id) AS rn FROM images) SELECT id, rn AS place FROM r")
def o4(spark, sf_dir):
    rows = b.images(spark, sf_dir).withColumn("score", F.lit(None).cast("double"))
    return ranking.places(rows, "filename").select("id", "place")


@register("o10_top_half", f"""WITH {b.IMAGES_SQL}, {b.SCORES_SQL}, s AS (SELECT id, group_key_l2, internal_score, count(*) OVER (PARTITION BY group_key_l2) AS total FROM images LEFT JOIN scores ON id = image_id WHERE NOT hidden),
r AS (SELECT *, row_number() OVER (PARTITION BY group_key_l2 ORDER BY internal_score DESC, id) AS rn FROM s WHERE internal_score IS NOT NULL)
SELECT group_key_l2, id, rn AS "rank" FROM r WHERE rn <= greatest(1, ceil(total / 2))""")
def o10(spark, sf_dir):
    rows = b.images(spark, sf_dir).join(b.scores(spark, sf_dir).withColumnRenamed("image_id", "id"), "id", "left").withColumnRenamed("internal_score", "score")
    return ranking.top_half(rows, "group_key_l2").select("group_key_l2", "id", F.col("rank").cast("bigint").alias("rank"))


@register("o11_neighbours", f"""WITH {b.IMAGES_SQL}, g AS (SELECT group_key_l2 AS group_key, count(*) AS c FROM images WHERE NOT hidden GROUP BY 1)
SELECT group_key, row_number() OVER o AS position, count(*) OVER () AS total, lag(group_key) OVER o AS previous, lead(group_key) OVER o AS "next" FROM g WINDOW o AS (ORDER BY c DESC, group_key)""")
def o11(spark, sf_dir):
    return ranking.neighbours(groups.list_groups(b.images(spark, sf_dir), 2))


_W1 = """WITH s AS (SELECT s_suppkey AS id, s_nationkey::VARCHAR AS g, CASE WHEN s_suppkey % 7 <> 0 THEN (s_suppkey * 17 % 101)::DOUBLE END AS score, (s_suppkey % 11) / 10.0 AS st FROM supplier)
SELECT {g}x.id AS a, y.id AS b, round((CASE WHEN abs(coalesce(x.score, 50) - coalesce(y.score, 50)) < 5 THEN 1.0 WHEN abs(coalesce(x.score, 50) - coalesce(y.score, 50)) < 10 THEN 0.5
WHEN abs(coalesce(x.score, 50) - coalesce(y.score, 50)) < 25 THEN 0.2 ELSE 0.08 END)::DOUBLE * (CASE WHEN x.score IS NULL OR y.score IS NULL THEN 3.0 ELSE 1.0 END)::DOUBLE
* {r}(0.6 + x.st)::DOUBLE * (0.6 + y.st)::DOUBLE, 6) AS weight FROM s x JOIN s y ON x.id < y.id{j}"""


def _arena_rows(spark, sf_dir):
    return b.table(spark, sf_dir, "supplier").select(
        F.col("s_nationkey").cast("string").alias("group_key"), F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 7 != 0, (F.col("s_suppkey") * 17 % 101).cast("double")).alias("score"),
        ((F.col("s_suppkey") % 11) / 10.0).alias("staleness"),
    )


def _sixth(column: str) -> F.Column:
    """Rounded to six digits by doubles, as the SQL does; ``round`` takes four times as long as all else about a pair, for its decimals."""
    return F.floor(F.col(column) * 1e6 + 0.5) / 1e6


@register("w1_arena_pairs", _W1.format(g="", r="", j=""))
def w1(spark, sf_dir):
    rows = _arena_rows(spark, sf_dir).withColumn("group_key", F.lit("all"))
    return ranking.arena_pairs(rows).select("a", "b", _sixth("weight").alias("weight"))


@register("w2_recent_pairs", _W1.format(g="x.g AS group_key, ", r="(CASE WHEN (x.id + y.id) % 3 = 0 THEN 0.15 ELSE 1.0 END)::DOUBLE * ", j=" AND x.g = y.g"))
def w2(spark, sf_dir):
    rows = _arena_rows(spark, sf_dir)
    pairs = rows.select("group_key", F.col("id").alias("b")).join(rows.select("group_key", F.col("id").alias("a")), "group_key").where("b < a and (a + b) % 3 = 0")
    return ranking.arena_pairs(rows, pairs).withColumn("weight", _sixth("weight"))
