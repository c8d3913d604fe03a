"""Text embeddings: an Arrow-batched interface for any encoder, and a deterministic one that needs no weights."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

DIM, BATCH, MOST_WORDS = 64, 32, 64


def hashing_encoder(dim: int = DIM) -> Callable[[list[str]], np.ndarray]:
    """Mean of pseudo-random directions of the first ``MOST_WORDS`` words, scaled to length 1; blank texts are zero."""
    import xxhash

    steps = np.arange(1, dim + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    def encode(texts: list[str]) -> np.ndarray:
        words = [t.lower().split()[:MOST_WORDS] for t in texts]
        known = {w: i for i, w in enumerate(dict.fromkeys(w for ws in words for w in ws))}
        # Each word's direction: 64-bit hashes of its hash and the dimension, spread evenly over -1 to 1.
        x = np.array([xxhash.xxh64_intdigest(w) for w in known], np.uint64)[:, None] + steps[None]
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        directions = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2**52 - 1
        out = np.zeros((len(texts), dim))
        owner = np.repeat(np.arange(len(texts)), [len(ws) for ws in words])
        if len(owner):
            np.add.at(out, owner, directions[[known[w] for ws in words for w in ws]])
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm == 0, 1, norm)

    return encode


def embedder(make: Callable[[], Callable[[list[str]], np.ndarray]] = hashing_encoder, dim: int = DIM, batch: int = BATCH) -> Callable[[Column], Column]:
    """A function from a text column to array<float>; ``make`` loads the encoder once a worker. The dimension of every batch is checked."""

    @pandas_udf("array<float>")
    def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = make()
        for part in parts:
            texts, rows = part.fillna("").tolist(), []
            for i in range(0, len(texts), batch):
                x = np.asarray(encode(texts[i : i + batch]), np.float32)
                if x.shape != (len(texts[i : i + batch]), dim):
                    raise ValueError(f"the encoder gave {x.shape} for {len(texts[i : i + batch])} texts, not {dim} dimensions")
                rows += list(x)
            yield pd.Series(rows)

    return embed
