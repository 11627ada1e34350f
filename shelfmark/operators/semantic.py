"""Search by embeddings, with a content-addressed cache of vectors."""

from __future__ import annotations

import json
import os
import urllib.request
from collections.abc import Callable, Iterator
from typing import Protocol, runtime_checkable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import vectors

LIMIT = 10
FLOOR = 35.0
ENV_BACKEND = "SHELFMARK_EMBED_BACKEND"
LOCAL_MODEL, DAEMON_MODEL = "all-MiniLM-L6-v2", "nomic-embed-text"
DAEMON = "http://localhost:11434"
CACHE_VERSION = 1


@runtime_checkable
class Backend(Protocol):
    """What embeds texts: order-preserving, and picklable, as it goes to the workers."""

    name: str

    def embed(self, texts: list[str]) -> list[list[float]]:
        """A vector for each text."""
        ...


class LocalModelBackend:
    """A sentence-embedding model of this machine, loaded on first use in each worker."""

    def __init__(self, model: str = LOCAL_MODEL) -> None:
        self.name, self.model, self._loaded = f"sentence-transformers:{model}", model, None

    def embed(self, texts: list[str]) -> list[list[float]]:
        """One batched call."""
        if self._loaded is None:
            from sentence_transformers import SentenceTransformer

            self._loaded = SentenceTransformer(self.model)
        return [[float(x) for x in v] for v in self._loaded.encode(texts)]

    def __getstate__(self) -> dict:
        return {"name": self.name, "model": self.model, "_loaded": None}


class DaemonBackend:
    """An embedding daemon over HTTP: one request a text."""

    def __init__(self, model: str = DAEMON_MODEL, host: str = DAEMON) -> None:
        self.name, self.model, self.host = f"ollama:{model}", model, host

    def available(self, timeout: float = 2.0) -> bool:
        """Whether the daemon answers."""
        try:
            with urllib.request.urlopen(f"{self.host}/api/tags", timeout=timeout) as answer:
                return answer.status == 200
        except OSError:
            return False

    def embed(self, texts: list[str]) -> list[list[float]]:
        """A vector for each text."""
        out = []
        for text in texts:
            body = json.dumps({"model": self.model, "prompt": text}).encode()
            request = urllib.request.Request(f"{self.host}/api/embeddings", body, {"Content-Type": "application/json"})
            with urllib.request.urlopen(request, timeout=30) as answer:
                out.append([float(x) for x in json.load(answer)["embedding"]])
        return out


def load_backend(prefer: str | None = None) -> tuple[Backend | None, str]:
    """The wanted backend (argument, environment, or the first that works), or none and why."""
    wanted = (prefer or os.environ.get(ENV_BACKEND, "") or "auto").strip().lower()
    known = {"sentence-transformers": "local", "st": "local", "local": "local", "ollama": "daemon", "daemon": "daemon", "auto": "auto"}.get(wanted)
    if known is None:
        return None, f"unknown embedding backend {wanted!r}"
    if known in ("local", "auto"):
        import importlib.util

        if importlib.util.find_spec("sentence_transformers"):
            backend = LocalModelBackend()
            return backend, f"using {backend.name}"
        if known == "local":
            return None, "sentence-transformers is not installed"
    daemon = DaemonBackend()
    if daemon.available():
        return daemon, f"using {daemon.name}"
    return None, "no embedding backend: install sentence-transformers or start the daemon"


def with_fingerprint(records: DataFrame) -> DataFrame:
    """Adds text, what is embedded, and fp, the key of its vector in the cache."""
    text = vectors.record_text()
    return records.withColumn("text", text).withColumn("fp", vectors.fingerprint(F.col("file"), F.col("line"), F.col("text")))


def embed_texts(texts: DataFrame, backend: Backend) -> DataFrame:
    """Vectors of (fp, text): fp, vec; batch by batch in the workers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"fp": batch["fp"], "vec": [[float(x) for x in v] for v in backend.embed(list(batch["text"]))]})

    return texts.select("fp", "text").mapInPandas(run, "fp string, vec array<double>")


def split_cache(records: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(hits: fp, vec; misses: fp, text; stale: fp of the cache that no record has)."""
    wanted = with_fingerprint(records).select("fp", "text").dropDuplicates(["fp"])
    hits = cache.join(wanted.select("fp"), "fp", "left_semi").select("fp", "vec")
    misses = wanted.join(cache.select("fp"), "fp", "left_anti")
    stale = cache.join(wanted.select("fp"), "fp", "left_anti").select("fp")
    return hits, misses, stale


def embed_records(records: DataFrame, backend: Backend, cache: DataFrame | None = None) -> DataFrame:
    """The vectors of all records, from the cache where it has them: fp, vec. This is the next cache."""
    if cache is None:
        return embed_texts(with_fingerprint(records).select("fp", "text").dropDuplicates(["fp"]), backend)
    hits, misses, _ = split_cache(records, cache)
    return hits.unionByName(embed_texts(misses, backend))


def load_cache(spark, path: str, backend_name: str) -> DataFrame | None:
    """A stored cache of this backend and version; none if it is absent, unreadable, or another's."""
    from pyspark.errors import AnalysisException

    try:
        held = spark.read.parquet(path)
        same = held.where((F.col("backend") == backend_name) & (F.col("version") == CACHE_VERSION))
        return None if same.isEmpty() else same.select("fp", "vec")
    except AnalysisException:
        return None


def save_cache(cache: DataFrame, path: str, backend_name: str) -> None:
    """Write a cache, replacing what was there; ``cache`` mustn't read from ``path``."""
    cache.withColumn("backend", F.lit(backend_name)).withColumn("version", F.lit(CACHE_VERSION)).write.mode("overwrite").parquet(path)


def rank(records: DataFrame, query_vector: list[float], limit: int = LIMIT, min_score: float = FLOOR, vector_col: str = "vec", order: tuple[str, ...] = ("file", "line")) -> DataFrame:
    """Rows by the scaled cosine of their vector with the query's, best first."""
    wanted = F.lit([float(x) for x in query_vector]).cast("array<double>")
    score = vectors.scale(vectors.cosine(F.col(vector_col).cast("array<double>"), wanted))
    return records.withColumn("score", score).where(F.col("score") >= min_score).orderBy(F.desc("score"), *order).limit(max(0, limit))


def search(records: DataFrame, query: str, backend: Backend, cache: DataFrame | None = None, limit: int = LIMIT, min_score: float = FLOOR, embed: Callable | None = None) -> DataFrame:
    """Records by meaning; a blank query finds nothing."""
    if not query.strip():
        return records.where(F.lit(False)).withColumn("score", F.lit(0.0))
    vec = (embed or backend.embed)([query.strip()])[0]
    found = with_fingerprint(records).join(embed_records(records, backend, cache), "fp")
    return rank(found, vec, limit, min_score).drop("fp", "text", "vec")
