"""Text columns: prompts, tokens, paths, names, checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: CJK ideographs that are tokens of their own.
CJK = r"\x{4E00}-\x{9FFF}"
_RUN = rf"(?:(?![{CJK}])[\p{{L}}\p{{N}}'-])+"


def normalize_prompt(prompt: Column) -> Column:
    """White space runs as one space, trimmed, lower case. Null stays null."""
    return F.lower(F.trim(F.regexp_replace(prompt, r"(?U)\s+", " ")))


def raw_tokens(prompt: Column) -> Column:
    """Lower-case pieces between commas and white space; empty for null."""
    pieces = F.split(F.lower(F.coalesce(prompt, F.lit(""))), r"(?U)[,\s]+")
    return F.filter(pieces, lambda p: p != "")


def prompt_tokens(prompt: Column) -> Column:
    """Tokens of a prompt: pieces as they are, but a piece with ideographs gives each ideograph and each run between."""
    cut = F.transform(
        raw_tokens(prompt),
        lambda p: F.when(p.rlike(f"[{CJK}]"), F.regexp_extract_all(p, F.lit(f"[{CJK}]|{_RUN}"), F.lit(0))).otherwise(F.array(p)),
    )
    return F.when(prompt.rlike(f"[{CJK}]"), F.flatten(cut)).otherwise(raw_tokens(prompt))


def token_set(prompt: Column) -> Column:
    return F.array_distinct(prompt_tokens(prompt))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two token sets; two empty sets are equal (1.0)."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(F.array_union(a, b))
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def prompt_diff(here: Column, there: Column) -> Column:
    """Tokens here that are not there; ideographs are not split."""
    return F.array_except(raw_tokens(here), raw_tokens(there))


def embedding_refs(prompt: Column) -> Column:
    """Names after ``embedding:`` at a word boundary, up to a comma, line end, bracket or semicolon; each once, in order."""
    found = F.regexp_extract_all(F.coalesce(prompt, F.lit("")), F.lit(r"(?i)(?<![A-Za-z0-9])embedding:([^,\n\r();]*)"), F.lit(1))
    clean = F.transform(found, lambda x: F.trim(F.regexp_replace(F.trim(x), r"\.+$", "")))
    return F.array_distinct(F.filter(clean, lambda x: x != ""))


def normalize_path(path: Column, windows: bool = True) -> Column:
    """One spelling of a path: forward slashes, no long-path prefix, no closing slash, lower-case drive."""
    p = path
    if windows:
        p = F.regexp_replace(F.regexp_replace(p, r"\\", "/"), r"^//\?/", "")
    p = F.when(p.rlike(r"^/+$"), F.lit("/")).otherwise(F.regexp_replace(p, r"/+$", ""))
    if windows:
        p = F.when(p.rlike("^[A-Za-z]:"), F.concat(F.lower(F.substring(p, 1, 1)), F.substr(p, F.lit(2)))).otherwise(p)
    return p


def sanitize_name(name: Column) -> Column:
    """A name safe in paths: letters, digits, ``_``, ``-`` and spaces, trimmed, spaces as ``_``."""
    return F.regexp_replace(F.trim(F.regexp_replace(name, r"[^\p{L}\p{N}_\- ]", "")), " ", "_")


def csv_field(value: Column) -> Column:
    """A CSV field, quoted where it holds a comma, quote or line end; quotes doubled."""
    v = F.coalesce(value, F.lit(""))
    return F.when(v.rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)


def natural_key(name: Column, width: int = 20, fold: bool = True) -> Column:
    """Sort key that orders digit runs by value: img2 before img10; without ``fold`` letters keep their case."""
    padded = F.regexp_replace(F.lower(name) if fold else name, r"(\d+)", "0" * width + "$1")
    return F.regexp_replace(padded, rf"0*(\d{{{width}}})(?!\d)", "$1")


def mask(text: Column) -> Column:
    """The text with its letters and digits hidden, character for character: ideographs as U+3007, others as x."""
    wide = F.regexp_replace(text, r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}]", "〇")
    return F.regexp_replace(wide, r"[A-Za-z0-9\x{00C0}-\x{024F}]", "x")


def group_label(text: Column, length: int = 120) -> Column:
    """The first characters of a prompt."""
    return F.substring(text, 1, length)


def compact_label(text: Column, length: int = 40) -> Column:
    """White space as single spaces, cut with an ellipsis."""
    t = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.when(F.char_length(t) > length, F.concat(F.substring(t, 1, length), F.lit("…"))).otherwise(t)


def valid_token(value: Column, most: int = 128) -> Column:
    """1 to ``most`` bytes of ASCII letters, digits and ``_-.:``."""
    return value.rlike(r"^[A-Za-z0-9_.:-]+$") & (F.octet_length(value) <= most)


def valid_event_name(value: Column) -> Column:
    return value.rlike(r"^[a-z0-9_.:-]+$") & (F.octet_length(value) <= 96)


def duration_ms(started: Column, committed: Column) -> Column:
    """Milliseconds from start to commit, never negative; null where either cannot be read."""
    a, b = F.try_to_timestamp(started), F.try_to_timestamp(committed)
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(F.lit(0).cast("long"), F.unix_millis(b) - F.unix_millis(a)))
