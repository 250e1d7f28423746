"""Explicit schemas of the engine's tables and a reader tolerant of older ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA_VERSION = 19

LORA = "struct<name: string, strength: double, clip_strength: double>"
SAMPLER = "struct<sampler: string, seed: bigint, steps: bigint, cfg: double, scheduler: string>"
CHAIN_ITEM = "struct<node_type: string, model: string, strength: double, enabled: boolean>"
RECIPE = (
    f"struct<checkpoint: string, diffusion_model: string, loras: array<{LORA}>, vae: string, sampler: string, "
    "scheduler: string, steps: bigint, cfg: double, width: bigint, height: bigint, aspect_ratio: double>"
)
GRAPH = "struct<t: array<string>, e: array<string>>"

_DDL = {
    "sources": "id bigint, path string, kind string, alias string, scanned_at timestamp, file_count bigint, newest_mtime bigint, "
    "l2_threshold double, l2_visual_threshold double, l2_semantic_threshold double, l2_mode string, model_deviation_dimensions array<string>",
    "images": "id bigint, source_id bigint, rel_path string, abs_path string, filename string, size bigint, modified_at bigint, "
    "width bigint, height bigint, prompt_pos string, prompt_neg string, checkpoint string, "
    f"loras array<{LORA}>, vae string, samplers array<{SAMPLER}>, seed bigint, steps bigint, cfg double, "
    "group_key_l0 string, group_key_l1 string, group_key_l2 string, group_key_l3 string, meta_ok boolean, source_kind string, "
    "scanned_at timestamp, hidden boolean, diffusion_model string, text_encoder string, controlnet string, "
    f"model_chain array<{CHAIN_ITEM}>, workflow_key string, workflow_graph {GRAPH}, workflow_template_id bigint, "
    f"workflow_match_confidence double, recipe {RECIPE}, recipe_signature string, parser_version string, content_fp string, "
    "embeddings array<string>",
    "labels": "id bigint, name string, gesture string, color string",
    "image_labels": "image_id bigint, label_id bigint",
    "scores": "image_id bigint, internal_score double, updated_at timestamp, last_mode string",
    "compare_pairs": "id string, group_key string, left_img bigint, right_img bigint, winner bigint, delta double, created_at timestamp",
    "archive_log": "image_id bigint, dest_path string, archived_at timestamp",
    "manual_group_bindings": "level int, image_id bigint, group_key string, kind string, created_at timestamp, prev_group_key string",
    "image_signatures": "image_id bigint, slot string, model_id string, dim int, vec array<float>, updated_at bigint",
    "review_actions": "action_id string, session_id string, mode string, image_id bigint, left_image_id bigint, right_image_id bigint, "
    "gesture string, winner bigint, group_key string, started_at timestamp, committed_at timestamp, duration_ms bigint, "
    "context_signature string, result string, undo_of_action_id string",
    "telemetry_events": "event_id string, session_id string, event_name string, schema_version int, occurred_at timestamp, mode string, "
    "payload string, severity string",
    "workflow_templates": "id bigint, path string, name string, workflow_id string, topology_signature string, "
    f"graph {GRAPH}, node_count bigint, diffusion_models array<string>, model_chain array<string>, scanned_at timestamp",
}

#: Columns that identify a row.
KEYS = {
    "sources": ["path"], "images": ["id"], "labels": ["id"], "image_labels": ["image_id", "label_id"], "scores": ["image_id"],
    "compare_pairs": ["id"], "archive_log": ["image_id"], "manual_group_bindings": ["level", "image_id"],
    "image_signatures": ["image_id", "slot"], "review_actions": ["action_id"], "telemetry_events": ["event_id"],
    "workflow_templates": ["path"],
}
#: Tables whose rows go when the image goes: table and its image column.
CASCADE = {"image_labels": "image_id", "scores": "image_id", "manual_group_bindings": "image_id", "image_signatures": "image_id"}
#: What stands for a column that an older library lacks.
DEFAULTS = {
    "l2_threshold": 0.3, "l2_visual_threshold": 0.75, "l2_semantic_threshold": 0.7, "l2_mode": "text", "hidden": False, "prompt_pos": "",
    "prompt_neg": "", "checkpoint": "", "seed": 0, "steps": 0, "cfg": 0.0, "size": 0, "width": 0, "height": 0, "content_fp": "",
    "workflow_key": "", "group_key_l1": "", "group_key_l2": "",
}


def ddl(table: str) -> str:
    """Schema of a table as a DDL string."""
    return _DDL[table]


def tables() -> list[str]:
    return list(_DDL)


def select_with_defaults(df: DataFrame, table: str) -> DataFrame:
    """The table's columns from ``df``: missing or null ones take their default (else null)."""
    empty = df.sparkSession.createDataFrame([], _DDL[table])
    columns = []
    for f in empty.schema.fields:
        default = F.lit(DEFAULTS.get(f.name)).cast(f.dataType)
        columns.append((F.coalesce(F.col(f.name).cast(f.dataType), default) if f.name in df.columns else default).alias(f.name))
    return df.select(*columns)
