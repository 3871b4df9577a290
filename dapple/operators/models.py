"""Boundaries to models, which are injected, and a mock that needs none."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dapple.session import ship


class Embedder(Protocol):
    """Turns a list of inputs into one row each of a matrix."""

    def __call__(self, inputs: list) -> np.ndarray: ...


class MockEmbedder:
    """A centre for each identity from its md5, and noise from each input's: same inputs, same vectors."""

    def __init__(self, dim: int = 64, noise: float = 0.15):
        self.dim, self.noise = dim, noise

    def _vector(self, text: str) -> np.ndarray:
        seed = int.from_bytes(hashlib.md5(text.encode()).digest()[:4], "big")
        return np.random.default_rng(seed).standard_normal(self.dim)

    def __call__(self, inputs: list) -> np.ndarray:
        rows = [self._vector(i["individual_id"]) / np.sqrt(self.dim) + self.noise * self._vector(i["md5"]) / np.sqrt(self.dim) for i in inputs]
        m = np.array(rows).reshape(-1, self.dim)
        return (m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-9)).astype(np.float32)


#: Name to factory; a real backbone is registered here by its owner.
EMBEDDERS: dict[str, Callable[[], Embedder]] = {"mock": MockEmbedder}


def register_embedder(name: str, factory: Callable[[], Embedder]) -> None:
    EMBEDDERS[name] = factory


def embed(rows: DataFrame, name: str = "mock", inputs: tuple[str, ...] = ("md5", "individual_id"), batch: int = 16) -> DataFrame:
    """Adds embedding. The model is built once a task and sees ``batch`` inputs at a time; its rows are L2-normalised."""
    ship(rows.sparkSession)
    factory = EMBEDDERS[name]

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for part in parts:
            found = part.to_dict("records")
            vectors = [v for lo in range(0, len(found), batch) for v in model(found[lo : lo + batch])]
            yield pd.Series([v.tolist() for v in vectors], index=part.index)

    run.__annotations__ = {"parts": Iterator[pd.DataFrame], "return": Iterator[pd.Series]}
    return rows.withColumn("embedding", F.pandas_udf(run, "array<float>")(F.struct(*inputs)))


def cross_fit(records: DataFrame, train: Callable[[pd.DataFrame, int], Embedder], inputs: tuple[str, ...] = ("md5", "individual_id")) -> DataFrame:
    """Out-of-fold embeddings: a row's model has not seen its fold.

    ``records``: md5, individual_id, role, fold.  Each fold is a group of its
    own holding what it is trained on (gallery rows of other folds) and what it
    embeds; ``train`` gets the former.  Folds hold identities of a catalogue,
    not a corpus, so a fold fits a task, as its model does.
    """
    ship(records.sparkSession)
    folds = records.select(F.col("fold").alias("target_fold")).distinct()
    need = (F.col("fold") == F.col("target_fold")) | ((F.col("fold") != F.col("target_fold")) & (F.col("role") == "gallery"))
    dealt = records.crossJoin(F.broadcast(folds)).where(need)  # a handful of folds

    def run(part: pd.DataFrame) -> pd.DataFrame:
        fold = int(part["target_fold"].iloc[0])
        model = train(part[part["fold"] != fold].sort_values("md5"), fold)
        own = part[part["fold"] == fold].sort_values("md5")
        vectors = model(own[list(inputs)].to_dict("records"))
        return pd.DataFrame({"md5": own["md5"], "fold": fold, "embedding": [v.tolist() for v in vectors]})

    return dealt.groupBy("target_fold").applyInPandas(run, "md5 string, fold int, embedding array<float>")


def isolate(f: Callable[[dict], object]) -> Callable[[dict], dict]:
    """Runs a model on a row and returns ok, value and err instead of raising, so one bad row stops nothing."""

    def run(row: dict) -> dict:
        try:
            return {"ok": True, "value": f(row), "err": None}
        except Exception as e:  # the caller sees it in err
            return {"ok": False, "value": None, "err": f"{type(e).__name__}: {e}"}

    return run
