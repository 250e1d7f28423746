"""Text and image vectors: tokenizer, image preprocessing, model towers and signature jobs.

The models themselves are not part of the package: a tower takes the path of
an ONNX file. Everything up to the model runs, and is tested, without one.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.constants import BATCH, CROP, TOKEN_CAP

#: Ideographs that are split from their neighbours. Fixed values.
IDEOGRAPHS = (
    (0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F), (0x2B740, 0x2B81F), (0x2B920, 0x2CEAF), (0xF900, 0xFAFF),
    (0x2F800, 0x2FA1F),
)
_IDEOGRAPH = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in IDEOGRAPHS) + "]")
# Channel means and deviations of the image tower.
MEAN = np.array([0.48145466, 0.4578275, 0.40821073])
DEVIATION = np.array([0.26862954, 0.26130258, 0.27577711])


class WordPiece:
    """Greedy longest-match tokenizer over a vocabulary (token: id)."""

    def __init__(self, vocabulary: dict[str, int], lowercase: bool = True, longest_word: int = 100, cap: int = TOKEN_CAP) -> None:
        for special in ("[CLS]", "[SEP]", "[UNK]", "[PAD]"):
            if special not in vocabulary:
                raise ValueError(f"the vocabulary lacks {special}")
        self.vocabulary, self.lowercase, self.longest_word, self.cap = vocabulary, lowercase, longest_word, cap

    def words(self, text: str) -> list[str]:
        """Words and marks: control characters dropped, ideographs alone, punctuation alone."""
        kept = "".join(" " if c.isspace() else c for c in text if c.isspace() or c not in "\0\ufffd" and not unicodedata.category(c).startswith("C"))
        spaced = _IDEOGRAPH.sub(r" \g<0> ", kept)
        if self.lowercase:
            spaced = "".join(c for c in unicodedata.normalize("NFD", spaced.lower()) if unicodedata.category(c) != "Mn")
        out: list[str] = []
        for word in spaced.split():
            start = 0
            for k, c in enumerate(word):
                if unicodedata.category(c).startswith("P") or c in "$+<=>^`|~":
                    out += [w for w in (word[start:k], c) if w]
                    start = k + 1
            if start < len(word):
                out.append(word[start:])
        return out

    def pieces(self, word: str) -> list[int]:
        unknown = [self.vocabulary["[UNK]"]]
        if len(word) > self.longest_word:
            return unknown
        found, at = [], 0
        while at < len(word):
            end = next((e for e in range(len(word), at, -1) if ("##" if at else "") + word[at:e] in self.vocabulary), None)
            if end is None:
                return unknown
            found.append(self.vocabulary[("##" if at else "") + word[at:end]])
            at = end
        return found

    def encode(self, text: str) -> list[int]:
        """Ids with [CLS] and [SEP], at most ``cap`` of them."""
        ids = [i for w in self.words(text) for i in self.pieces(w)]
        return [self.vocabulary["[CLS]"], *ids[: self.cap - 2], self.vocabulary["[SEP]"]]


def _cubic(x: np.ndarray, a: float = -0.5) -> np.ndarray:
    x = np.abs(x)
    near = ((a + 2) * x - (a + 3)) * x * x + 1
    far = a * (((x - 5) * x + 8) * x - 4)
    return np.where(x < 1, near, np.where(x < 2, far, 0.0))


@cache
def resize_matrix(size: int, target: int) -> np.ndarray:
    """Weights (target, size) of antialiased bicubic resampling along one side."""
    scale = size / target
    wide = max(scale, 1.0)
    centre = (np.arange(target) + 0.5) * scale
    low = np.maximum(0, np.floor(centre - 2 * wide + 0.5))
    high = np.minimum(size, np.floor(centre + 2 * wide + 0.5))
    at = np.arange(size)
    w = _cubic((at[None, :] - centre[:, None] + 0.5) / wide)
    w = np.where((at >= low[:, None]) & (at < high[:, None]), w, 0.0)
    return w / w.sum(axis=1, keepdims=True)


def preprocess(rgb: np.ndarray, crop: int = CROP) -> np.ndarray:
    """(3, crop, crop) from an RGB image (height, width, 3): short side to ``crop``, centre crop, normalised."""
    height, width = rgb.shape[:2]
    short = min(height, width)
    new_h, new_w = int(np.rint(height * crop / short)), int(np.rint(width * crop / short))
    x = rgb.astype(np.float64)
    if (new_h, new_w) != (height, width):
        x = np.clip(np.rint(np.einsum("ow,hwc->hoc", resize_matrix(width, new_w), x)), 0, 255)
        x = np.clip(np.rint(np.einsum("oh,hwc->owc", resize_matrix(height, new_h), x)), 0, 255)
    top, left = (new_h - crop) // 2, (new_w - crop) // 2
    x = (x[top : top + crop, left : left + crop] / 255 - MEAN) / DEVIATION
    return x.transpose(2, 0, 1).astype(np.float32)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1; zero rows stay."""
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.where(n > 0, x / np.where(n > 0, n, 1), x)


@cache
def _session(path: str):
    import onnxruntime

    options = onnxruntime.SessionOptions()
    options.intra_op_num_threads = 1  # one task, one core
    return onnxruntime.InferenceSession(path, options)


def text_vectors(texts: list[str], tokenizer: WordPiece, run) -> np.ndarray:
    """Vectors of texts in batches, padded to the longest of a batch; the first position, at length 1."""
    out = []
    for at in range(0, len(texts), BATCH):
        ids = [tokenizer.encode(t) for t in texts[at : at + BATCH]]
        n = max(map(len, ids))
        pad = tokenizer.vocabulary["[PAD]"]
        tokens = np.array([i + [pad] * (n - len(i)) for i in ids], np.int64)
        mask = np.array([[1] * len(i) + [0] * (n - len(i)) for i in ids], np.int64)
        out.append(unit(run(tokens, mask)[:, 0]))
    return np.concatenate(out) if out else np.zeros((0, 0))


def embed_texts(todo: DataFrame, vocabulary: dict[str, int], model_path: str, slot: str, model_id: str) -> DataFrame:
    """Signatures (image_id, slot, model_id, dim, vec) of texts (image_id, text); one session per Python worker."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer, session = WordPiece(vocabulary), _session(model_path)

        def run(tokens: np.ndarray, mask: np.ndarray) -> np.ndarray:
            feed = {"input_ids": tokens, "attention_mask": mask, "token_type_ids": np.zeros_like(tokens)}
            return session.run(None, {i.name: feed[i.name] for i in session.get_inputs()})[0]

        for f in frames:
            yield _rows(f["image_id"], text_vectors(f["text"].tolist(), tokenizer, run), slot, model_id)

    return todo.select("image_id", "text").mapInPandas(each, "image_id bigint, slot string, model_id string, dim int, vec array<float>")


def embed_images(todo: DataFrame, model_path: str, slot: str, model_id: str) -> DataFrame:
    """Signatures of decoded images (image_id, height, width, rgb binary); images of the wrong size are left out."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session = _session(model_path)
        for f in frames:
            good = f[f["rgb"].map(len) == f["height"] * f["width"] * 3]
            for at in range(0, len(good), BATCH):
                part = good.iloc[at : at + BATCH]
                x = np.stack([preprocess(np.frombuffer(r.rgb, np.uint8).reshape(r.height, r.width, 3)) for r in part.itertuples()])
                yield _rows(part["image_id"], unit(session.run(None, {session.get_inputs()[0].name: x})[0]), slot, model_id)

    return todo.select("image_id", "height", "width", "rgb").mapInPandas(each, "image_id bigint, slot string, model_id string, dim int, vec array<float>")


def _rows(ids: pd.Series, vectors: np.ndarray, slot: str, model_id: str) -> pd.DataFrame:
    return pd.DataFrame({"image_id": ids.to_numpy(), "slot": slot, "model_id": model_id, "dim": vectors.shape[1] if len(vectors) else 0, "vec": list(vectors.astype(np.float32))})


def signature_todo(images: DataFrame, signatures: DataFrame, slot: str, model_id: str, force: bool = False) -> DataFrame:
    """Images still to be embedded: of the text slot those with a prompt, of the vision slot those not hidden or missing."""
    rows = images.where(F.coalesce("prompt_pos", F.lit("")) != "") if slot == "text" else images.where(~F.coalesce("hidden", F.lit(False)))
    if slot != "text" and "file_missing" in images.columns:
        rows = rows.where(~F.col("file_missing"))
    if force:
        return rows
    done = signatures.where((F.col("slot") == slot) & (F.col("model_id") == model_id)).select(F.col("image_id").alias("id"))
    return rows.join(done, "id", "left_anti")


def capabilities(models: dict[str, str | None]) -> dict[str, bool]:
    """Which towers can run: a model path is known and the runtime imports."""
    try:
        import onnxruntime  # noqa: F401
    except ImportError:
        return dict.fromkeys(models, False)
    return {name: path is not None for name, path in models.items()}
