"""Node graphs of image pipelines: topology, prompts by link tracing, models and samplers."""

from __future__ import annotations

import re
from typing import Any

DEPTH = 8
# Node classes and input names of the graph format.
SAMPLERS = ("KSampler", "KSamplerAdvanced", "SamplerCustom", "ClownsharKSampler_Beta")
SELECTORS = (*SAMPLERS, "KSamplerSelect")
CHECKPOINTS = (
    "CheckpointLoaderSimple", "UNETLoader", "CheckpointLoader", "UnetLoaderGGUF", "CheckpointLoaderAdvanced", "CheckpointLoaderNF4",
    "UnetLoaderGGUFAdvanced",
)
LORAS = ("LoraLoader", "LoraLoaderModelOnly")
VAES = ("VAELoader", "SeedVR2LoadVAEModel")
ENCODERS = (
    "CLIPLoader", "DualCLIPLoader", "TripleCLIPLoader", "QuadrupleCLIPLoader", "CLIPLoaderGGUF", "DualCLIPLoaderGGUF", "CLIPLoaderAdvanced",
)
CONTROLNETS = ("ControlNetLoader", "ControlNetLoaderAdvanced", "ControlNetLoaderDiffusers", "ControlNetLoaderAdvancedDiffusers")
TEXT_INPUTS = ("text", "value", "string", "prompt", "content", "strings")
CONDITION_INPUTS = ("text", "prompt", "positive", "negative")
SWITCH_INPUTS = ("switch", "select", "selector", "active")
MODEL_FILE = re.compile(r"\.(safetensors|ckpt|pt|pth|bin|gguf)$", re.I)


def topology(root: Any) -> tuple[list[str], list[str]]:
    """Sorted node types and sorted ``source->target`` edges, alike for the API form and the UI form."""
    if isinstance(root, dict) and isinstance(root.get("nodes"), list):
        kinds = {n.get("id"): n["type"] for n in root["nodes"] if n.get("type")}
        links = [k for k in root.get("links") or [] if isinstance(k, list) and len(k) >= 6]
        edges = [f"{kinds[k[1]]}->{kinds[k[3]]}" for k in links if k[1] in kinds and k[3] in kinds]
        return sorted(n["type"] for n in root["nodes"] if n.get("type")), sorted(edges)
    kinds = {i: n["class_type"] for i, n in root.items() if isinstance(n, dict) and isinstance(n.get("class_type"), str) and n["class_type"]}
    edges = [
        f"{kinds[v[0]]}->{kinds[i]}"
        for i in kinds for v in (root[i].get("inputs") or {}).values()
        if isinstance(v, list) and v and isinstance(v[0], str) and v[0] in kinds
    ]
    return sorted(kinds.values()), sorted(edges)


class _Graph:
    def __init__(self, root: dict) -> None:
        self.nodes = {i: n for i, n in root.items() if isinstance(n, dict)}

    def at(self, link: Any) -> dict | None:
        """The node a link ``[id, slot]`` points to."""
        return self.nodes.get(link[0]) if isinstance(link, list) and link and isinstance(link[0], str) else None

    @staticmethod
    def pick(inputs: dict, names: tuple[str, ...]):
        lower = {k.lower(): v for k, v in reversed(inputs.items())}
        return [lower[n] for n in names if n in lower]

    def text(self, value: Any, depth: int = 0) -> str | None:
        """The text a value stands for: itself, or what its link leads to."""
        if depth > DEPTH:
            return None
        if isinstance(value, str):
            return value or None
        node = self.at(value)
        inputs = (node or {}).get("inputs")
        if not isinstance(inputs, dict):
            return None
        if "Switch" in str(node.get("class_type")) and (found := self.switched(inputs, depth)):
            return found
        for v in self.pick(inputs, TEXT_INPUTS):
            if isinstance(v, list) and self.at(v) is None:
                parts = [p for p in (x if isinstance(x, str) else self.text(x, depth + 1) for x in v) if p]
                if parts:
                    return "\n".join(parts)
            elif found := self.text(v, depth + 1):
                return found
        return self.text(next(iter(inputs.values())), depth + 1) if len(inputs) == 1 else None

    def switched(self, inputs: dict, depth: int) -> str | None:
        choice = next((c for v in self.pick(inputs, SWITCH_INPUTS) if (c := self.choice(v)) is not None), None)
        if choice is None:
            order = ("on_false", "on_true", *(f"input{k}" for k in range(10)))
        elif isinstance(choice, bool):
            order = ("on_true", "on_false") if choice else ("on_false", "on_true")
        else:
            order = (f"input{max(0, choice)}",)
        return next((t for v in self.pick(inputs, order) if (t := self.text(v, depth + 1))), None)

    def choice(self, value: Any) -> bool | int | None:
        if isinstance(value, (bool, int)):
            return value
        inputs = (self.at(value) or {}).get("inputs") or {}
        return next((v for v in self.pick(inputs, ("value", "switch", "select")) if isinstance(v, (bool, int))), None)

    def condition(self, link: Any, depth: int = 0) -> str | None:
        """The prompt a conditioning link carries; zeroed conditioning carries none."""
        node = self.at(link)
        if depth > DEPTH or node is None or node.get("class_type") == "ConditioningZeroOut":
            return None
        inputs = node.get("inputs") or {}
        names = ("text",) if node.get("class_type") == "CLIPTextEncode" else CONDITION_INPUTS
        for v in (inputs[n] for n in names if n in inputs):
            if found := self.text(v, depth + 1) or (self.condition(v, depth + 1) if names is CONDITION_INPUTS else None):
                return found
        return None


def _float(value: Any) -> float | None:
    try:
        return float(value) if isinstance(value, (int, float, str)) and not isinstance(value, bool) else None
    except ValueError:
        return None


def loras_of(inputs: dict) -> list[dict]:
    """LoRAs of a custom loader: slots as objects, wrapped lists, or names with numbered strengths. Disabled slots do not count."""
    out = []

    def first(source: dict, names: list[str]) -> float | None:
        return next((x for n in names if (x := _float(source.get(n))) is not None), None)

    def add(name: Any, strength: float | None, clip: float | None) -> None:
        if isinstance(name, str) and name.strip() and name.lower() != "none":
            out.append({"name": name.strip(), "strength": 1.0 if strength is None else strength, "clip_strength": clip})

    for key, value in inputs.items():
        slots = value.get("__value__") if isinstance(value, dict) and key in ("loras", "lora_list") else [value] if isinstance(value, dict) else []
        for s in slots or []:
            if isinstance(s, dict) and s.get("on", s.get("active", True)) is not False:
                name = next((s[k] for k in ("lora", "lora_name", "name") if k in s), None)
                add(name, first(s, ["strength", "strength_model"]), first(s, ["strengthTwo", "strength_clip", "clipStrength"]))
        if isinstance(value, str) and "strength" not in key and (key == "lora_name" or key.startswith("lora_") or MODEL_FILE.search(value)):
            n = (re.search(r"\d+", key) or [""])[0]
            own = [f"lora_{n}_strength", f"lora_{n}_model_strength", f"strength_{n}", f"strength_model_{n}"] if n else []
            clips = [f"lora_{n}_clip_strength", f"strength_clip_{n}"] if n else []
            add(value, first(inputs, [*own, "strength", "strength_model"]), first(inputs, [*clips, "strength_clip", "strengthTwo", "strength_two"]))
    return out


def graph_meta(root: dict) -> dict:
    """Metadata fields of an API-form graph; nodes are read in the order of their ids."""
    g = _Graph(root)
    t, e = topology(root)
    meta: dict[str, Any] = {"t": t, "e": e, "meta_ok": True, "loras": [], "samplers": [], "model_chain": []}
    order = sorted(g.nodes, key=lambda i: (not i.isdigit(), int(i) if i.isdigit() else 0, i))
    positive: list[str] = []
    negative: list[str] = []
    loose: list[str] = []
    for node in (g.nodes[i] for i in order):
        kind, inputs = str(node.get("class_type") or ""), node.get("inputs") or {}
        if kind in SAMPLERS:
            for side, into in (("positive", positive), ("negative", negative)):
                found = g.condition(inputs.get(side))
                if found and found not in into:
                    into.append(found)
        _models(kind, inputs, meta)
    for node in (g.nodes[i] for i in order):
        found = g.text(node["inputs"].get("text")) if node.get("class_type") == "CLIPTextEncode" and node.get("inputs") else None
        if found and found not in positive + negative + loose:
            loose.append(found)
    meta["prompt_pos"], meta["prompt_neg"] = "\n".join(positive or loose), "\n".join(negative)
    refs = re.findall(r"(?i)(?<![A-Za-z0-9])embedding:([^,\n\r();]*)", meta["prompt_pos"])
    meta["embeddings"] = list(dict.fromkeys(r for r in (x.strip().rstrip(".").strip() for x in refs) if r))
    return meta


def _models(kind: str, inputs: dict, meta: dict) -> None:
    """Add what a loader or sampler node says."""

    def named(*names: str) -> str:
        return next((inputs[n] for n in names if isinstance(inputs.get(n), str) and inputs[n]), "")

    def chain(model: str, strength: float | None = None, enabled: bool | None = None) -> None:
        meta["model_chain"].append({"node_type": kind, "model": model, "strength": strength, "enabled": enabled})

    def keep(field: str, value: str) -> None:
        meta[field] = meta.get(field) or value

    if kind in CHECKPOINTS and (name := named("unet_name", "ckpt_name")):
        keep("checkpoint", name)
        keep("diffusion_model", name)
        chain(name)
    elif "lora" in kind.lower():
        own = {"name": named("lora_name"), "strength": _float(inputs.get("strength_model")), "clip_strength": _float(inputs.get("strength_clip"))}
        for lora in [own | {"strength": 1.0 if own["strength"] is None else own["strength"]}] if kind in LORAS and own["name"] else [] if kind in LORAS else loras_of(inputs):
            meta["loras"].append(lora)
            chain(lora["name"], lora["strength"])
    elif kind in VAES:
        keep("vae", named("vae_name", "model"))
    elif kind in ENCODERS and (names := sorted({v for k, v in inputs.items() if k.startswith("clip_name") and isinstance(v, str) and v})):
        keep("text_encoder", ",".join(names))
        chain(",".join(names))
    elif kind in CONTROLNETS and (name := named("control_net_name", "cn_name", "name")):
        keep("controlnet", name)
        chain(name)
    elif kind in SELECTORS:
        seed = next((inputs[k] for k in ("seed", "noise_seed") if isinstance(inputs.get(k), int)), 0)
        meta["samplers"].append({
            "sampler": named("sampler_name"), "seed": seed if abs(seed) < 2**63 else 0, "steps": inputs["steps"] if isinstance(inputs.get("steps"), int) else 0,
            "cfg": _float(inputs.get("cfg")) or 0.0, "scheduler": named("scheduler"),
        })
    elif ("Model" in kind or "Enhancer" in kind) and (name := named("model_name", "model")):
        chain(name, _float(inputs.get("strength")), inputs["enabled"] if isinstance(inputs.get("enabled"), bool) else None)
