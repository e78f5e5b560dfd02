"""Catalog of patch encoders: names and widths, registration of custom ones, plug-ins."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable, Iterable
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession

#: Names and widths of the known encoders. They need model packages and weights that are not part of this library.
KNOWN = {
    "resnet18": 512,
    "resnet34": 512,
    "resnet50": 2048,
    "resnet101": 2048,
    "resnet152": 2048,
    "convnext_tiny": 768,
    "convnext_small": 768,
    "convnext_base": 1024,
    "convnext_large": 1536,
    "vit_b_16": 768,
    "vit_b_32": 768,
    "vit_h_14": 1280,
    "vit_l_16": 1024,
    "vit_l_32": 1024,
    "dinov2_small": 384,
    "dinov2_base": 768,
    "dinov2_large": 1024,
    "dinov2_giant": 1536,
    "dinov3_vit7b16": 4096,
    "dinov3_vit7b16_sat": 4096,
    "dinov3_vitb16": 768,
    "dinov3_vith16_plus": 1280,
    "dinov3_vitl16": 1024,
    "dinov3_vitl16_sat": 1024,
    "dinov3_vits16": 384,
    "dinov3_vits16_plus": 384,
    "clip_rn50": 1024,
    "clip_rn50x4": 640,
    "clip_rn50x16": 768,
    "clip_rn50x64": 1024,
    "clip_rn101": 512,
    "clip_vit_b_16": 512,
    "clip_vit_b_32": 512,
    "clip_vit_l_14": 768,
    "clip_vit_l_14_336": 768,
    "conch_v1": 512,
    "conch_v15": 768,
    "omiclip": 768,
    "quilt_b_16": 512,
    "quilt_b_16_pmb": 512,
    "quilt_b_32": 512,
    "uni_v1": 1024,
    "uni_v2": 1536,
    "lunit_vit_small_patch16_dino": 384,
    "lunit_vit_small_patch8_dino": 384,
    "lunit_resnet50_bt": 2048,
    "lunit_resnet50_mocov2": 2048,
    "lunit_resnet50_swav": 2048,
    "plip": 512,
    "medsiglip": 1152,
    "musk": 1024,
    "openmidnight": 1536,
    "pathorchestra": 1024,
    "h_optimus_0": 1536,
    "h_optimus_1": 1536,
    "h0_mini": 1536,
    "hibou_b": 768,
    "hibou_l": 1024,
    "biomedclip": 512,
    "phikon_v1": 768,
    "phikon_v2": 1024,
    "virchow_v1": 2560,
    "virchow_v2": 2560,
    "prov_gigapath": 1536,
    "midnight": 3072,
    "chief-ctranspath": 768,
}


class MissingDependency(RuntimeError):
    """A known encoder whose model package or weights are not installed."""


class Encoder:
    """A batch of patches (n, h, w, 3) of bytes to vectors (n, dim) of single precision."""

    def __init__(self, name: str, dim: int, fn: Callable[[np.ndarray], np.ndarray]) -> None:
        self.name, self.dim, self.fn = name, dim, fn

    def extract_batch(self, patches: np.ndarray, batch_size: int | None = None) -> np.ndarray:
        if not len(patches):
            return np.zeros((0, self.dim), np.float32)
        size = min(len(patches), batch_size or len(patches))
        parts = []
        for i in range(0, len(patches), size):
            got = self.fn(patches[i : i + size])
            if not isinstance(got, np.ndarray):
                raise TypeError(f"encoder {self.name} returned {type(got).__name__}, not an array")
            parts.append(got.reshape(len(got), -1).astype(np.float32))
        out = np.concatenate(parts)
        if out.shape != (len(patches), self.dim):
            raise ValueError(f"encoder {self.name} returned {out.shape}, not {(len(patches), self.dim)}")
        return out

    def cleanup(self) -> None:
        """Frees what the encoder holds; plain functions hold nothing."""


class Registry:
    """Encoders by lower-case name; builders run when an encoder is first created."""

    def __init__(self) -> None:
        self._builders: dict[str, tuple[int, Callable[[], Encoder]]] = {}

    def register(self, name: str, dim: int, builder: Callable[[], Encoder]) -> None:
        key = name.lower()
        if key in self._builders:
            raise ValueError(f"encoder {key} is registered already")
        self._builders[key] = (dim, builder)

    def register_function(self, name: str, dim: int, fn: Callable[[np.ndarray], np.ndarray]) -> None:
        self.register(name, dim, lambda: Encoder(name.lower(), dim, fn))

    def available(self) -> list[str]:
        return sorted(self._builders)

    def create(self, name: str) -> Encoder:
        if name.lower() not in self._builders:
            raise KeyError(f"unknown encoder {name}; known: {', '.join(self.available())}")
        return self._builders[name.lower()][1]()

    def create_many(self, names: Iterable[str]) -> list[Encoder]:
        return [self.create(n) for n in names]

    def dims(self) -> dict[str, int]:
        return {n: d for n, (d, _) in self._builders.items()}

    def load_plugin(self, path: str | Path) -> None:
        """Imports a module by path and calls its register_encoders(registry)."""
        path = Path(path)
        spec = importlib.util.spec_from_file_location(path.stem, path)
        module = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(module)
        if not hasattr(module, "register_encoders"):
            raise AttributeError(f"plug-in {path} has no register_encoders(registry)")
        module.register_encoders(self)


def _unavailable(name: str) -> Callable[[], Encoder]:
    def build() -> Encoder:
        raise MissingDependency(f"encoder {name} needs its model package and weights, which are not installed")

    return build


def default_registry() -> Registry:
    """All known encoders; each needs its own dependency when it is created."""
    out = Registry()
    for name, dim in KNOWN.items():
        out.register(name, dim, _unavailable(name))
    return out


def encoders(spark: SparkSession, registry: Registry | None = None) -> DataFrame:
    """(name, dim) of a registry."""
    found = (registry or default_registry()).dims()
    return spark.createDataFrame(sorted(found.items()), "name string, dim int")


def rgb_stats(patches: np.ndarray) -> np.ndarray:
    """A deterministic encoder for tests: mean and deviation of each channel."""
    flat = patches.reshape(len(patches), -1, 3).astype(np.float64)
    return np.concatenate([flat.mean(axis=1), flat.std(axis=1)], axis=1)
