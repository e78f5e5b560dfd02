"""Patch features: one pass for each encoder over the patches that still lack them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tessera.plans.catalog import Encoder

FEATURE_SCHEMA = "slide_id bigint, patch_idx bigint, embedding array<float>"


def embed(pixels: DataFrame, encoder: Encoder, size: int, batch_size: int = 32) -> DataFrame:
    """FEATURE_SCHEMA of ``pixels`` (slide_id, patch_idx, data: RGB bytes of ``size`` squared).

    The encoder travels with the function and is used for all batches of a
    task; a vector of the wrong width or type is an error of the job.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), 1024):
                part = batch.iloc[i : i + 1024]
                stack = np.stack([np.frombuffer(b, np.uint8).reshape(size, size, 3) for b in part["data"]])
                yield pd.DataFrame({"slide_id": part["slide_id"], "patch_idx": part["patch_idx"], "embedding": list(encoder.extract_batch(stack, batch_size))})

    return pixels.select("slide_id", "patch_idx", "data").mapInPandas(run, FEATURE_SCHEMA)
