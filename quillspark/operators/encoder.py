"""Vectors of texts from a pluggable encoder, each distinct text once, with a store that resumes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import prefixed
from ..sources.store import scratch_table


class Encoder(Protocol):
    signature: str

    def encode(self, texts: list[str], prefix: str) -> np.ndarray: ...


class HashEncoder:
    """Deterministic unit vectors of hashed character trigrams: for tests, not for relevance."""

    def __init__(self, width: int = 64, salt: str = ""):
        self.width, self.salt = width, salt
        self.signature = f"hash-{width}-{salt}"

    def encode(self, texts: list[str], prefix: str) -> np.ndarray:
        out = np.zeros((len(texts), self.width), np.float32)
        for i, t in enumerate(texts):
            t = t if t.startswith(prefix) else prefix + t
            for j in range(max(1, len(t) - 2)):
                h = hashlib.blake2b((self.salt + t[j : j + 3]).encode(), digest_size=8).digest()
                out[i, int.from_bytes(h[:4], "little") % self.width] += 1 if h[4] & 1 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def pool(hidden: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Mean over the unmasked places, then unit length."""
    m = mask[..., None].astype(hidden.dtype)
    mean = (hidden * m).sum(1) / np.maximum(m.sum(1), 1e-9)
    return mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-12)


def text_key(text, prefix: str, encoder: Encoder):
    """Key of a stored vector: the encoder's signature and the prefixed text."""
    return F.sha2(F.concat_ws("\x1f", F.lit(encoder.signature), prefixed(text, prefix)), 256)


def encode(texts: DataFrame, text_col: str, prefix: str, encoder: Encoder, batch: int = 64) -> DataFrame:
    """(key, vector) of a table of distinct texts with their keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = b.column(1).to_pylist()
            for i in range(0, len(values), batch):
                v = encoder.encode(values[i : i + batch], prefix)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, batch), pa.array([x.tolist() for x in v], pa.list_(pa.float32()))], ["key", "vector"])

    return texts.select("key", text_col).mapInArrow(run, "key string, vector array<float>")


def embeddings(df: DataFrame, text_col: str, prefix: str, encoder: Encoder, store: str, rebuild: bool = True, block: int = 1 << 18) -> DataFrame:
    """``df`` with ``vector``. Texts that the store lacks are encoded and appended in blocks of about
    ``block`` texts, each committed by itself, so an interrupted run goes on behind its last whole block;
    without ``rebuild`` a missing vector is an error."""
    spark = df.sparkSession
    keyed = df.withColumn("key", text_key(F.coalesce(text_col, F.lit("")), prefix, encoder))
    distinct = keyed.select("key", F.coalesce(text_col, F.lit("")).alias("text")).dropDuplicates(["key"])
    try:
        known = spark.read.schema("key string, vector array<float>").parquet(store)
        missing = distinct.join(known.select("key"), "key", "left_anti")
    except AnalysisException:
        missing = distinct
    missing = scratch_table(missing)
    n = missing.count()
    if n and not rebuild:
        raise ValueError(f"{store} lacks vectors of these texts for this encoder")
    blocks = -(-n // block)
    for i in range(blocks):
        encode(missing.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == i), "text", prefix, encoder).write.mode("append").parquet(store)
    stored = spark.read.schema("key string, vector array<float>").parquet(store).dropDuplicates(["key"])
    return keyed.join(stored, "key", "left").drop("key")
