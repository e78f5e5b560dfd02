"""File names, formats and output paths as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffixes of each backend, lower case.
BACKENDS = {
    "openslide": ("svs", "tif", "tiff", "ndpi", "vms", "vmu", "scn", "mrxs", "bif", "biff", "dcm", "dicom"),
    "image": ("png", "jpg", "jpeg", "bmp", "webp", "gif"),
}
SUFFIXES = {suffix: backend for backend, found in BACKENDS.items() for suffix in found}


def name_of(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def stem_of(path: Column) -> Column:
    """File name without its last suffix."""
    return F.regexp_replace(name_of(path), r"(?<=.)\.[^.]+$", "")


def suffix_of(path: Column) -> Column:
    """Last suffix in lower case without the dot; empty if none."""
    return F.lower(F.regexp_extract(name_of(path), r".\.([^.]+)$", 1))


def backend_of(path: Column) -> Column:
    """The backend that reads a file, by suffix in any case, or null."""
    lookup = F.create_map(*[F.lit(x) for pair in SUFFIXES.items() for x in pair])
    return F.try_element_at(lookup, suffix_of(path))


def is_supported(path: Column) -> Column:
    return suffix_of(path).isin(list(SUFFIXES))


def output_paths(root: str, stem: Column) -> dict[str, Column]:
    """Where a slide's coordinates, lock, images and pictures go below an output root."""
    base = root.rstrip("/")
    return {
        "patches": F.concat(F.lit(f"{base}/patches/slide_stem="), stem),
        "lock": F.concat(F.lit(f"{base}/patches/"), stem, F.lit(".lock")),
        "images": F.concat(F.lit(f"{base}/images/"), stem),
        "visualization": F.lit(f"{base}/visualization"),
    }


def parse_feature_list(raw: Column) -> Column:
    """Encoder names in lower case from a list cut at commas and white space."""
    return F.filter(F.split(F.lower(F.translate(raw, ",", " ")), r"\s+"), lambda x: x != "")


def feature_list_error(names: Column, choices: list[str]) -> Column:
    """empty, unknown: ..., duplicates: ..., or null for a good list."""
    unknown = F.array_except(names, F.array(*[F.lit(c) for c in choices]))
    twice = F.array_distinct(F.filter(names, lambda n: F.size(F.filter(names, lambda m: m == n)) > 1))
    return (
        F.when(F.size(names) == 0, F.lit("empty"))
        .when(F.size(unknown) > 0, F.concat(F.lit("unknown: "), F.array_join(F.array_sort(unknown), ", ")))
        .when(F.size(twice) > 0, F.concat(F.lit("duplicates: "), F.array_join(F.array_sort(twice), ", ")))
    )
