"""The encoder seam: texts to unit vectors, by any callable; offline, by hashed words."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Encoder = Callable[[list[str]], np.ndarray]


def hashed_encoder(size: int = 64) -> Encoder:
    """A deterministic encoder: words and word pairs hash to signed dimensions. Says nothing about meaning."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), size), np.float64)
        for k, t in enumerate(texts):
            w = re.findall(r"\w+", (t or "").lower())
            for x in [*w, *(" ".join(p) for p in zip(w, w[1:]))]:
                h = int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little")
                out[k, h % size] += 1 if h >> 32 & 1 else -1
        n = np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)
        return (out / n).astype(np.float32)

    return encode


def encoded(text: str | Column, make: Callable[[], Encoder]) -> Column:
    """A vector column; make() builds the encoder once for each worker's iterator."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = make()
        for b in batches:
            yield pd.Series(list(np.asarray(encode(b.fillna("").tolist()), np.float32)))

    return run(text)
