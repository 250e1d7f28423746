"""JSON texts: lenient numbers, sensitive keys, telemetry whitelists."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TOKENS = re.compile(r'"(?:[^"\\]|\\.)*"|(?<![\w.])-?(?:NaN|Infinity)(?![\w.])', re.S)


def clean_json(text: str) -> str:
    """Bare NaN, Infinity and -Infinity as null; strings stay as they are."""
    return _TOKENS.sub(lambda m: m[0] if m[0][0] == '"' else "null", text)


@F.pandas_udf(T.StringType())
def sanitize_json(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in texts:
        yield s.map(lambda t: None if t is None else clean_json(t))


#: A JSON string, with the colon that makes it a key. Unrolled and possessive: no recursion over long strings.
_STRING = r'"([^"\\]*+(?:\\.[^"\\]*+)*+)"(\s*:)?'


def json_keys(payload: Column) -> Column:
    """Keys at every depth of a JSON text, as written after parsing (escapes of letters undone); null for what is no JSON."""
    text = F.to_json(F.try_parse_json(payload))
    strings, colons = (F.regexp_extract_all(text, F.lit(_STRING), F.lit(g)) for g in (1, 2))
    pairs = F.filter(F.arrays_zip(strings.alias("key"), colons.alias("colon")), lambda p: p["colon"] != "")
    return F.transform(pairs, lambda p: p["key"])


def has_sensitive_key(payload: Column) -> Column:
    """Whether any key at any depth holds ``prompt`` or ``path``; false for what is no JSON."""
    return F.coalesce(F.exists(json_keys(payload), lambda k: F.lower(k).rlike("prompt|path")), F.lit(False))


def hashed_id(value: Column, salt: str) -> Column:
    """``h_`` and the FNV-1a (32 bits, hex) of ``salt:value`` over its characters."""
    codes = F.transform(F.split(F.concat(F.lit(f"{salt}:"), value), ""), lambda c: F.ascii(c).cast("bigint"))
    mixed = F.aggregate(codes, F.lit(0x811C9DC5).cast("bigint"), lambda h, c: (h.bitwiseXOR(c) * F.lit(0x01000193)).bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.concat(F.lit("h_"), F.lpad(F.lower(F.hex(mixed)), 8, "0"))


def sanitized(
    events: DataFrame, allowed: dict[str, list[str]], enums: dict[str, list[str]], numbers: list[str], flags: list[str], salt: str, payload: str = "payload"
) -> DataFrame:
    """Events of known names with the payload fields they may carry, by VariantType, in the order of the whitelist.

    Ids (``…_id``) are hashed with ``salt``, ``numbers`` rounded and at least 0,
    ``flags`` must be booleans, other fields one of the words of their enum; what
    fits nothing, or has another type, is left out. A payload that is no JSON is empty.
    """
    parsed = F.try_parse_json(payload)

    def field(name: str) -> Column:
        at = F.try_variant_get(parsed, f"$.{name}", "variant")
        kind = F.schema_of_variant(at)
        word, number = F.try_variant_get(parsed, f"$.{name}", "string"), F.try_variant_get(parsed, f"$.{name}", "double")
        numeric = kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
        if name.endswith("_id"):
            return F.when((kind == "STRING") | numeric, hashed_id(word, salt))
        if name in numbers:
            return F.when(numeric, F.greatest(F.lit(0).cast("bigint"), F.floor(number + 0.5)))
        if name in flags:
            return F.when(kind == "BOOLEAN", F.try_variant_get(parsed, f"$.{name}", "boolean"))
        return F.when((kind == "STRING") & word.isin(*enums.get(name, [])), word)

    tidy = F.lit(None).cast("string")
    for event, names in allowed.items():
        tidy = F.when(F.col("event_name") == event, F.to_json(F.struct(*(field(n).alias(n) for n in names))) if names else F.lit("{}")).otherwise(tidy)
    return events.where(F.col("event_name").isin(*allowed)).withColumn(payload, tidy)


def fnv1a(text: str, salt: str = "") -> int:
    """FNV-1a, 32 bits."""
    h = 0x811C9DC5
    for b in (salt + text).encode():
        h = (h ^ b) * 0x01000193 & 0xFFFFFFFF
    return h


def whitelisted(events: DataFrame, allowed: dict[str, list[str]], payload: str = "payload") -> DataFrame:
    """Payload fields that the event's whitelist names; numbers are rounded and at least 0."""
    fields = sorted({f for names in allowed.values() for f in names})
    parsed = F.from_json(payload, "map<string,string>")
    keep: Column = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    def named(names: list[str]) -> Column:
        return F.map_filter(parsed, lambda k, v: F.array_contains(F.array(*map(F.lit, names)).cast("array<string>"), k))

    for event, names in allowed.items():
        keep = F.when(F.col("event_name") == event, named(names)).otherwise(keep)
    number = lambda v: F.round(v.try_cast("double")).try_cast("bigint")
    tidy = F.transform_values(keep, lambda k, v: F.when(number(v).isNotNull(), F.greatest(F.lit(0).cast("bigint"), number(v)).cast("string")).otherwise(v))
    return events.where(F.col("event_name").isin(*allowed)).withColumn(payload, F.to_json(tidy)) if fields else events.where(F.lit(False))
