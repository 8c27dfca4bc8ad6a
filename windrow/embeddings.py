"""Providers of text embeddings: hashed tokens in the JVM, or an HTTP service in batches."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Iterator
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windrow.operators.fingerprint import hash_embedding


class Provider(Protocol):
    def embed(self, df: DataFrame, key: str, text: str) -> DataFrame:
        """key, vector for every row."""


class LocalHash:
    """Signed token counts in ``dims`` hashed places, to unit length; texts without tokens are the zero vector."""

    def __init__(self, dims: int = 256) -> None:
        self.dims = dims

    def embed(self, df: DataFrame, key: str, text: str) -> DataFrame:
        sparse = hash_embedding(df, key, text, self.dims)
        maps = sparse.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("idx", "value"))).alias("m"))
        vector = F.transform(F.sequence(F.lit(0), F.lit(self.dims - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0.0)))
        found = maps.select("key", vector.alias("vector"))
        zero = F.array_repeat(F.lit(0.0), self.dims)
        return df.select(F.col(key).alias("key")).join(found, "key", "left").select("key", F.coalesce("vector", zero).alias("vector"))


class HttpBatches:
    """POSTs ``batch`` texts at a time to a service that answers with one vector a text, in order."""

    def __init__(self, url: str, model: str, batch: int = 64, token: str | None = None, timeout: float = 30.0) -> None:
        self.url, self.model, self.batch, self.token, self.timeout = url, model, batch, token, timeout

    def _ask(self, texts: list[str]) -> list[list[float]]:
        head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.token}"} if self.token else {})
        body = json.dumps({"model": self.model, "input": texts}).encode()
        with urllib.request.urlopen(urllib.request.Request(self.url, body, head), timeout=self.timeout) as got:  # noqa: S310
            rows = sorted(json.load(got)["data"], key=lambda r: r.get("index", 0))
        if len(rows) != len(texts):
            raise ValueError(f"{len(rows)} vectors for {len(texts)} texts")
        return [r["embedding"] for r in rows]

    def embed(self, df: DataFrame, key: str, text: str) -> DataFrame:
        ask, size = self._ask, self.batch

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for at in range(0, len(keys), size):
                    vectors = ask([t or "" for t in texts[at : at + size]])
                    yield pa.record_batch([pa.array(keys[at : at + size], batch.schema.field(0).type), pa.array(vectors, pa.list_(pa.float64()))], ["key", "vector"])

        kind = dict(df.dtypes)[key]
        return df.select(key, text).mapInArrow(run, f"key {kind}, vector array<double>")


def provider(cfg: dict[str, Any]) -> Provider:
    e = cfg["embedding"]
    if e["provider"] == "local-hash":
        return LocalHash(e["dims"])
    if e["provider"] == "http":
        return HttpBatches(e["url"], e["model"], e.get("batch", 64), e.get("token"), e.get("timeout", 30.0))
    raise KeyError(f"no provider {e['provider']}")
