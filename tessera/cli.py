"""Command line: detect-tissue, segment-and-get-coords, process, info."""

from __future__ import annotations

import argparse
import sys

from tessera.config import Extraction, Features, Output, Segmentation
from tessera.functions.paths import BACKENDS
from tessera.plans.catalog import default_registry


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tessera", description="Tissue masks, patch coordinates and features of slides, on Spark.")
    commands = top.add_subparsers(dest="command", required=True)
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("path")
    common.add_argument("-o", "--output", required=True)
    common.add_argument("--device", default="cuda")
    common.add_argument("--seg-batch-size", type=int, default=1)
    common.add_argument("--recursive", action="store_true")
    common.add_argument("--mpp-csv")
    common.add_argument("--mpp", type=float)
    common.add_argument("-v", "--verbose", action="store_true")
    coords = argparse.ArgumentParser(add_help=False)
    coords.add_argument("--patch-size", type=int, required=True)
    coords.add_argument("--target-mag", type=int, required=True)
    coords.add_argument("--step-size", type=int)
    coords.add_argument("--tissue-thresh", type=float, default=0.0)
    coords.add_argument("--white-thresh", type=int, default=15)
    coords.add_argument("--black-thresh", type=int, default=50)
    unused = "accepted and without effect: a task holds one slide, Spark's task slots bound the rest"
    coords.add_argument("--write-batch", type=int, default=8192, help=unused)
    coords.add_argument("--patch-workers", type=int, help=unused)
    coords.add_argument("--max-open-slides", type=int, default=200, help=unused)
    coords.add_argument("--fast-mode", action=argparse.BooleanOptionalAction, default=True)
    coords.add_argument("--save-images", action="store_true")
    for kind in ("grids", "mask", "contours"):
        coords.add_argument(f"--visualize-{kind}", action="store_true")
    skip = coords.add_mutually_exclusive_group()
    skip.add_argument("--skip-existing", dest="skip_existing", action="store_true", default=True)
    skip.add_argument("--force", dest="skip_existing", action="store_false")
    commands.add_parser("detect-tissue", parents=[common])
    commands.add_parser("segment-and-get-coords", parents=[common, coords])
    process = commands.add_parser("process", parents=[common, coords])
    process.add_argument("--feature-extractors", required=True)
    process.add_argument("--feature-device")
    process.add_argument("--feature-batch-size", type=int, default=32)
    process.add_argument("--feature-num-workers", type=int, default=4)
    process.add_argument("--feature-precision", default="float16", choices=("float32", "float16", "bfloat16"))
    process.add_argument("--feature-plugin", action="append", default=[])
    commands.add_parser("info")
    return top


def encoder_names(raw: str, known: list[str]) -> tuple[str, ...]:
    """Names of a list cut at commas and white space; empty, unknown or repeated ones are errors."""
    names = raw.replace(",", " ").lower().split()
    unknown, twice = sorted(set(names) - set(known)), sorted({n for n in names if names.count(n) > 1})
    for bad, what in ((not names, "no encoder named"), (unknown, f"unknown encoders: {', '.join(unknown)}"), (twice, f"encoders named twice: {', '.join(twice)}")):
        if bad:
            raise ValueError(what)
    return tuple(names)


def main(args: list[str] | None = None) -> int:
    given = parser().parse_args(args)
    if given.command == "info":
        for backend, suffixes in BACKENDS.items():
            print(f"{backend}: {' '.join('.' + s for s in suffixes)}")
        print("encoders:", ", ".join(default_registry().available()))
        return 0
    from tessera.pipeline import SlideEngine
    from tessera.session import local_session

    try:
        segmentation = Segmentation(device=given.device, batch_size=given.seg_batch_size)
        if given.command == "detect-tissue":
            output, config = Output(given.output), None
        else:
            output = Output(given.output, given.save_images, given.visualize_grids, given.visualize_mask, given.visualize_contours, given.skip_existing)
            config = Extraction(given.patch_size, given.target_mag, given.step_size, given.tissue_thresh, given.white_thresh, given.black_thresh, given.fast_mode)
        registry = default_registry()
        if given.command == "process":
            for plugin in given.feature_plugin:
                registry.load_plugin(plugin)
            names = encoder_names(given.feature_extractors, registry.available())
            features = Features(names, given.feature_device or given.device, given.feature_batch_size, given.feature_num_workers, given.feature_precision)
    except (ValueError, AttributeError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    engine = SlideEngine(local_session(), output, segmentation, registry=registry)
    where = {"recursive": given.recursive, "mpp_csv": given.mpp_csv, "mpp": given.mpp}
    if given.command == "detect-tissue":
        report = engine.detect_tissue(given.path, **where)
    elif given.command == "segment-and-get-coords":
        report = engine.segment_and_get_coords(given.path, config, **where)
    else:
        report = engine.process(given.path, config, features, **where)
    print("\n".join(report.lines() if given.verbose else report.lines()[:1]))
    return 0


if __name__ == "__main__":
    sys.exit(main())
