"""Validated settings of a run. They are driver-side values; nothing here touches data."""

from __future__ import annotations

import re
from dataclasses import dataclass

PRECISIONS = ("float32", "float16", "bfloat16")
_DEVICE = re.compile(r"cpu|cuda(:\d+)?")


def positive(value: float, name: str) -> None:
    if value <= 0:
        raise ValueError(f"{name} must be above 0, not {value}")


def non_negative(value: float, name: str) -> None:
    if value < 0:
        raise ValueError(f"{name} must not be negative: {value}")


def fraction(value: float, name: str) -> None:
    if not 0 <= value <= 1:
        raise ValueError(f"{name} must lie between 0 and 1, not {value}")


def device(value: str) -> None:
    if not _DEVICE.fullmatch(value):
        raise ValueError(f"device must be cpu, cuda or cuda:N, not {value!r}")


@dataclass(frozen=True)
class Segmentation:
    device: str = "cuda"
    batch_size: int = 1
    thumbnail_power: float = 1.25
    thumbnail_max: int = 1024
    mask_threshold: float = 0.5

    def __post_init__(self) -> None:
        device(self.device)
        for name in ("batch_size", "thumbnail_power", "thumbnail_max"):
            positive(getattr(self, name), name)


@dataclass(frozen=True)
class Extraction:
    patch_size: int
    target_mag: int
    step_size: int | None = None
    tissue_thresh: float = 0.0
    white_thresh: int = 15
    black_thresh: int = 50
    fast_mode: bool = True

    def __post_init__(self) -> None:
        for name in ("patch_size", "target_mag", "white_thresh", "black_thresh"):
            positive(getattr(self, name), name)
        if self.step_size is not None:
            positive(self.step_size, "step_size")
        if self.target_mag > 120:
            raise ValueError("target_mag must not exceed 120")
        fraction(self.tissue_thresh, "tissue_thresh")

    @property
    def step(self) -> int:
        return self.patch_size if self.step_size is None else self.step_size


@dataclass(frozen=True)
class Features:
    encoders: tuple[str, ...]
    device: str = "cuda"
    batch_size: int = 32
    num_workers: int = 4
    precision: str = "float16"

    def __post_init__(self) -> None:
        if not self.encoders:
            raise ValueError("at least one encoder is needed")
        twice = sorted({e for e in self.encoders if self.encoders.count(e) > 1})
        if twice:
            raise ValueError(f"encoders named twice: {', '.join(twice)}")
        device(self.device)
        positive(self.batch_size, "batch_size")
        non_negative(self.num_workers, "num_workers")
        if self.precision not in PRECISIONS:
            raise ValueError(f"precision must be one of {', '.join(PRECISIONS)}")

    @property
    def compute_dtype(self) -> str:
        """Half precision needs a GPU; on a CPU it becomes float32. Stored vectors are float32 either way."""
        return "float32" if self.device == "cpu" and self.precision == "float16" else self.precision


@dataclass(frozen=True)
class Output:
    root: str
    save_images: bool = False
    visualize_grids: bool = False
    visualize_mask: bool = False
    visualize_contours: bool = False
    skip_existing: bool = True
    thumbnail_size: int = 1024

    def __post_init__(self) -> None:
        if not self.root:
            raise ValueError("an output folder is needed")
        positive(self.thumbnail_size, "thumbnail_size")
