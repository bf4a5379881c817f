"""Models that stages name: labels, files, where they are kept, and how a run is spread."""

from __future__ import annotations

import os
from collections.abc import Sequence
from dataclasses import dataclass

# Labels of personal data that general and typed entity models are asked for.
PII_LABELS = (
    "person", "organization", "location", "email", "phone_number", "url", "id", "account_number", "zip_code", "address", "ip_address", "date", "ssn",
    "driver_license", "passport", "age", "credit_card", "medical_condition",
)
TYPED_PII_LABELS = (
    "date", "person_name", "person_title", "organization", "location", "email", "phone", "id", "account", "zip_code", "address", "ip", "url", "ssn",
    "driver_license", "passport", "age", "credit_card", "medical_condition", "technology",
)


@dataclass(frozen=True)
class Model:
    id: str
    repo: str
    files: tuple[tuple[str, int], ...]  # path and bytes, about
    labels: tuple[str, ...] = ()
    languages: tuple[str, ...] = ("multi",)
    revision: str = "main"

    @property
    def size(self) -> int:
        return sum(n for _, n in self.files)


# Public entity models by name. Add others with ``register``.
MODELS: dict[str, Model] = {
    m.id: m
    for m in (
        Model("gliner-multi-pii", "onnx-community/gliner_multi_pii-v1", (("gliner_config.json", 732), ("onnx/model_fp16.onnx", 579_717_643)), PII_LABELS),
        Model("gliner-pii-edge", "knowledgator/gliner-pii-edge-v1.0", (("gliner_config.json", 2_000), ("onnx/model.onnx", 181_000_000)), PII_LABELS),
        Model("gliner-small", "onnx-community/gliner_small-v2.1", (("gliner_config.json", 731), ("onnx/model_fp16.onnx", 306_253_040)), PII_LABELS, ("en",)),
        Model("gliner-multi", "onnx-community/gliner_multi-v2.1", (("gliner_config.json", 731), ("onnx/model_fp16.onnx", 579_717_643)), PII_LABELS),
    )
}
DEFAULT = "gliner-multi-pii"


def register(model: Model) -> None:
    MODELS[model.id] = model


def required(descriptors: Sequence[dict]) -> dict[str, dict]:
    """By ``repo@revision``: the files that the pipeline's stages need and the stages that need them."""
    out: dict[str, dict] = {}
    for n, d in enumerate(descriptors):
        name = d.get("options", {}).get("model") or (DEFAULT if d["type"] == "GlinerNer" else "")
        if not d.get("enabled", True) or name not in MODELS:
            continue
        m = MODELS[name]
        entry = out.setdefault(f"{m.repo}@{m.revision}", {"files": {}, "stages": []})
        entry["files"] |= dict(m.files)
        entry["stages"].append(d.get("id") or f"{d['type']}#{n}")
    return out


def status(folder: str, descriptors: Sequence[dict]) -> dict[str, bool]:
    """Whether all files of each needed model are below the folder (repo/revision/path)."""
    there = lambda key, path: os.path.exists(os.path.join(folder, *key.rsplit("@", 1), path))
    return {key: all(there(key, path) for path in entry["files"]) for key, entry in required(descriptors).items()}


def prefetch(spark, folder: str, descriptors: Sequence[dict]) -> list[str]:
    """Send the needed models' folders to the executors; their keys."""
    known = [key for key, ok in status(folder, descriptors).items() if ok]
    for key in known:
        spark.sparkContext.addFile(os.path.join(folder, *key.rsplit("@", 1)), recursive=True)
    return known


def parallelism(cores: int, preset: str = "balanced") -> dict[str, int]:
    """Workers (task slots) and threads of each: workers first, as pages are independent; one page at a time in a worker."""
    if preset not in ("single", "balanced", "throughput"):
        raise ValueError(f"unknown preset {preset!r}")
    workers = 1 if preset == "single" else max(1, min(4, cores // 2)) if preset == "balanced" else max(1, cores)
    return {"workers": workers, "threads": max(1, cores // workers), "pages_in_flight": 1}
