"""The pipeline keeps the columns of documents until the last stage."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import line_dedup, near_dup, packing, quality_model, queries


def test_stages_in_order(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "repeated_lines", "mixed_sources", "packed"]
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.cut(stage(spark, docs, sf), name)
        if name != "packed":
            assert docs.columns == columns and 0 < docs.count() <= before
            before = docs.count()
    assert {"doc_id", "sequence_id", "offset"} <= set(docs.columns)


def test_each_operator_has_one_query():
    names = sorted(int(n[2:].split("_")[0]) for n in queries.queries())
    assert names == list(range(1, 14))


#: Names that operators and stages use inside, as columns of the caller's.
OWN_NAMES = ["_nd_hash", "_nd_id", "_lh_key", "_lh_rank", "_lh_cuts", "_lh_kept", "_lh_cutrank", "_q_text", "_q_score", "row", "rest", "hash", "cuts", "score", "position", "_row"]


@pytest.fixture(scope="module")
def odd_corpus(spark, tmp_path_factory):
    """Documents with nulls, empty and very long texts, repeats and clashing names; and labels for some."""
    folder = tmp_path_factory.mktemp("odd")
    good = "The quiet river runs past the old mill and on to the wide green sea beyond the hills."
    texts = [f"{good} Story number {i} tells of {i * 7} boats and their crews." for i in range(40)] + ["buy now!!! $$$ click " * 5] * 10
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(50, None), (51, ""), (52, "word " * 50_000), (None, "no id at all here"), (53, texts[0]), (0, texts[0]), (54, good + "\n" + good)]
    full = [(i, t, "en" if i else None, None if i == 3 else f"s{(i or 0) % 3}", len(t or "")) for i, t in rows]
    docs = spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for name in OWN_NAMES:
        docs = docs.withColumn(name, F.concat(F.lit(f"{name} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))
    docs.write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1 if i < 40 else 0, 0) for i in range(50)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_stages_keep_clashing_columns(spark, odd_corpus):
    docs = spark.read.parquet(f"{odd_corpus}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.cut(stage(spark, docs, odd_corpus), name)
        assert docs.columns == columns, name
        for r in docs.collect():
            assert all(r[c] == f"{c} of {'none' if r.doc_id is None else r.doc_id}" for c in OWN_NAMES), name
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, odd_corpus)
    assert packed.agg(F.sum("length")).first()[0] > 0


def test_stages_against_plain_rules(spark, odd_corpus):
    """Every stage's own promise on its own input: no clean row lost, no row made."""
    docs = spark.read.parquet(f"{odd_corpus}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    near = stages["near_duplicates"](spark, docs, odd_corpus).collect()
    assert sorted(r.doc_id for r in near if r.text == docs.where("doc_id = 53").first().text) == [0]
    assert {r.doc_id for r in near} >= {50, 51, 52, None}
    lines = {(r.doc_id, r.text) for r in stages["repeated_lines"](spark, docs, odd_corpus).collect()}
    assert (50, None) in lines and (51, "") in lines and len([x for x in lines if x[0] == 54]) == 1
    mixed = stages["mixed_sources"](spark, docs, odd_corpus)
    assert sorted(map(str, mixed.collect())) == sorted(map(str, docs.collect()))


def test_sequences_follow_the_mix(spark, odd_corpus):
    """the order that mixed_sources gives is that of the packed sequences; another order gives others."""
    docs = spark.read.parquet(f"{odd_corpus}/documents.parquet").where("doc_id is not null and doc_id < 50 and doc_id > 0").repartition(3, "doc_id")
    mixed = corpus_pipeline.cut(dict(corpus_pipeline.STAGES)["mixed_sources"](spark, docs, odd_corpus))
    turned = corpus_pipeline.cut(mixed.orderBy(F.desc("doc_id")))
    for stored in (mixed, turned):
        place = {r.doc_id: r.at for r in stored.select("doc_id", corpus_pipeline.stored_place().alias("at")).collect()}
        if stored is turned:
            assert sorted(place, key=place.get) == sorted(place, reverse=True)
        firsts = {}
        for r in packing.pack(stored, public_tokenizers.path("word_bpe_49k.json"), 128, place=corpus_pipeline.stored_place()).collect():
            firsts[r.sequence_id] = min(firsts.get(r.sequence_id, 2**62), place[r.doc_id])
        assert len(firsts) > 3 and [firsts[k] for k in range(len(firsts))] == sorted(firsts.values())


def test_an_empty_corpus(spark, odd_corpus):
    docs = spark.read.parquet(f"{odd_corpus}/documents.parquet").where("false")
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.cut(stage(spark, docs, odd_corpus), name)
        assert docs.count() == 0


def test_operators_take_their_own_names(spark, odd_corpus):
    docs = spark.read.parquet(f"{odd_corpus}/documents.parquet")
    kept = line_dedup.without_repeats(docs)
    assert set(kept.columns) == set(docs.columns) and kept.schema["_lh_kept"].dataType.simpleString().startswith("array")
    weights = quality_model.fit(docs, spark.read.parquet(f"{odd_corpus}/labels.parquet"), F.lit(True))
    scored = quality_model.scored(docs, weights)
    assert set(scored.columns) == set(docs.columns) and dict(scored.dtypes)["_q_score"] == "double"
    assert sorted(map(str, near_dup.keep_one(docs).select("_nd_hash", "_nd_id").distinct().collect()))[0].startswith("Row(_nd_hash='_nd_hash of")
