"""Generation metadata in image files: PNG text, EXIF user comments, parameter texts and node graphs."""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.json_clean import clean_json
from tessera.functions.parameters import bound, parameters_struct
from tessera.sources.node_graph import graph_meta, topology

PNG_MAGIC = b"\x89PNG\r\n\x1a\n"
META = (
    "struct<prompt_pos: string, prompt_neg: string, checkpoint: string, diffusion_model: string, vae: string, text_encoder: string, controlnet: string, "
    "loras: array<struct<name: string, strength: double, clip_strength: double>>, "
    "samplers: array<struct<sampler: string, seed: bigint, steps: bigint, cfg: double, scheduler: string>>, "
    "model_chain: array<struct<node_type: string, model: string, strength: double, enabled: boolean>>, embeddings: array<string>, "
    "t: array<string>, e: array<string>, width: bigint, height: bigint, source_kind: string, meta_ok: boolean>"
)


def blank(kind: str = "local", ok: bool = False) -> dict:
    return {
        "prompt_pos": "", "prompt_neg": "", "checkpoint": "", "diffusion_model": "", "vae": "", "text_encoder": "", "controlnet": "", "loras": [],
        "samplers": [], "model_chain": [], "embeddings": [], "t": [], "e": [], "width": 0, "height": 0, "source_kind": kind, "meta_ok": ok,
    }


def png_chunks(data: bytes) -> Iterator[tuple[bytes, bytes, int, int]]:
    """(type, body, start, end) of each chunk; stops where the file is broken."""
    at = 8
    while data[:8] == PNG_MAGIC and at + 12 <= len(data):
        (size,) = struct.unpack(">I", data[at : at + 4])
        end = at + 12 + size
        if end > len(data):
            return
        yield data[at + 4 : at + 8], data[at + 8 : end - 4], at, end
        at = end


def png_text(data: bytes) -> tuple[dict[str, str], int, int]:
    """Texts of prompt, workflow and parameters (iTXt over tEXt; compressed text is not read), and the size."""
    plain, wide, size = {}, {}, (0, 0)
    for kind, body, _, _ in png_chunks(data):
        key, _, rest = body.partition(b"\0")
        name = key.decode("latin-1")
        if kind == b"IHDR" and len(body) >= 8:
            size = struct.unpack(">II", body[:8])
        elif kind == b"tEXt":
            plain[name] = rest.decode("utf-8", "replace")
        elif kind == b"iTXt" and rest[:1] == b"\0":
            wide[name] = rest[2:].split(b"\0", 2)[-1].decode("utf-8", "replace")
    return {k: v for k, v in (plain | wide).items() if k in ("prompt", "workflow", "parameters")}, *size


def _jpeg_size(data: bytes) -> tuple[int, int]:
    at = 2
    while data[:2] == b"\xff\xd8" and at + 9 < len(data) and data[at] == 0xFF:
        mark, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", data[at + 5 : at + 9])
            return width, height
        at += 2 + size
    return 0, 0


def user_comment(data: bytes) -> str:
    """The EXIF user comment of a JPEG or WebP file; empty where there is none."""
    at = data.find(b"UNICODE\0")
    if at >= 0:
        body = data[at + 8 : at + 8 + 65536]
        text = body.decode("utf-16-be" if body[:1] == b"\0" else "utf-16-le", "ignore")
        return text.split("\0", 1)[0]
    at = data.find(b"ASCII\0\0\0")
    return data[at + 8 : at + 65544].split(b"\0", 1)[0].decode("ascii", "ignore") if at >= 0 else ""


def image_meta(path: str, data: bytes | None) -> dict:
    """Metadata of an image file by its kind; ``parameters`` is the parameter text that stands for it, if one does."""
    meta, kind = blank() | {"parameters": None}, path.rsplit(".", 1)[-1].lower()
    if not data:
        return meta
    if kind == "png":
        texts, width, height = png_text(data)
        if "prompt" in texts:
            meta |= from_graph(texts["prompt"])
        if not meta["meta_ok"] and "parameters" in texts:
            meta |= blank() | {"parameters": texts["parameters"]}
        if not meta["t"] and "workflow" in texts:
            meta["t"], meta["e"] = _ui_topology(texts["workflow"])
        meta["width"], meta["height"] = width or meta["width"], height or meta["height"]
    elif kind in ("jpg", "jpeg", "webp"):
        text = user_comment(data)
        if "Steps:" in text:
            meta["parameters"] = text
        width, height = _jpeg_size(data)
        meta["width"], meta["height"] = width or meta["width"], height or meta["height"]
    return meta


def from_graph(text: str) -> dict:
    """Metadata of an API-form node graph; not ok where it is no JSON object."""
    try:
        root = json.loads(clean_json(text))
    except ValueError:
        root = None
    return blank("comfy") | graph_meta(root) if isinstance(root, dict) else blank("comfy")


def _ui_topology(text: str) -> tuple[list[str], list[str]]:
    try:
        return topology(json.loads(clean_json(text)))
    except ValueError:
        return [], []


def _images(paths: pd.Series, contents: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(list(map(image_meta, paths, contents)), columns=[*blank(), "parameters"])


def _graphs(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([from_graph(t or "") for t in texts], columns=list(blank()))


def parse_image(path: Column | str, content: Column | str) -> Column:
    """Metadata struct of image files. Python reads the file and its node graph; a parameter text is parsed by built-in functions."""

    def field(raw: Column, text: Column, name: str) -> Column:
        if name in ("t", "e"):
            return raw[name]
        return F.coalesce(F.nullif(raw[name], F.lit(0)), text[name]) if name in ("width", "height") else text[name]

    def merged(raw: Column) -> Column:
        parsed = bound(parameters_struct(raw["parameters"]), lambda text: F.struct(*(field(raw, text, c).alias(c) for c in blank())))
        return F.when(raw["parameters"].isNotNull(), parsed.cast(META)).otherwise(F.struct(*(raw[c].alias(c) for c in blank())))

    read = F.pandas_udf(_images, META[:-1] + ", parameters: string>")(path, content)
    return bound(read, merged)


def parse_parameters(text: Column | str) -> Column:
    """Metadata struct of parameter texts, without Python."""
    return parameters_struct(F.col(text) if isinstance(text, str) else text).cast(META)


def parse_graph(text: Column | str) -> Column:
    """Metadata struct of node graphs."""
    return F.pandas_udf(_graphs, META)(text)


def png_chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def rewrite_prompt(data: bytes, positive: str, negative: str) -> bytes | None:
    """A PNG with its prompts replaced, all other chunks as they were; null where they cannot be edited.

    A node graph is editable where the sampler's inputs link straight to one
    text node each; a parameter text always is.
    """
    texts, _, _ = png_text(data)
    new: dict[str, str] = {}
    if "prompt" in texts:
        graph = json.loads(clean_json(texts["prompt"]))
        for side, text in (("positive", positive), ("negative", negative)):
            nodes = {str(n["inputs"][side][0]) for n in graph.values() if isinstance(n.get("inputs", {}).get(side), list)}
            if len(nodes) != 1 or graph.get(node := nodes.pop(), {}).get("class_type") != "CLIPTextEncode" or not isinstance(graph[node]["inputs"].get("text"), str):
                return None
            graph[node]["inputs"]["text"] = text
            if "workflow" in texts:
                ui = json.loads(clean_json(new.get("workflow", texts["workflow"])))
                for n in ui.get("nodes", []):
                    if str(n.get("id")) == node and n.get("widgets_values"):
                        n["widgets_values"][0] = text
                new["workflow"] = json.dumps(ui, ensure_ascii=False)
        new["prompt"] = json.dumps(graph, ensure_ascii=False)
    elif "parameters" in texts:
        _, steps, tail = texts["parameters"].partition("Steps:")
        new["parameters"] = positive + (f"\nNegative prompt: {negative}" if negative else "") + ("\n" + steps + tail if steps else "")
    else:
        return None
    last = {}
    for kind, body, start, end in png_chunks(data):
        name = body.partition(b"\0")[0].decode("latin-1")
        if kind == b"tEXt" and name in new:
            last[name] = (start, end)
    if not last:
        return None
    out, at = [], 0
    for name, (start, end) in sorted(last.items(), key=lambda x: x[1]):
        out += [data[at:start], png_chunk(b"tEXt", name.encode() + b"\0" + new[name].encode())]
        at = end
    return b"".join([*out, data[at:]])


@F.pandas_udf(T.BinaryType())
def rewrite_prompts(contents: pd.Series, positives: pd.Series, negatives: pd.Series) -> pd.Series:
    return pd.Series([rewrite_prompt(c, p, n) for c, p, n in zip(contents, positives, negatives)])
