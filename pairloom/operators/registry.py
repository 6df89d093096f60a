"""Named Python kernels on Arrow batches: embedders, which map rows to vectors, and verifiers, which judge pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

EMBEDDERS: dict[str, Callable[..., Callable[[list[str]], list[list[float]]]]] = {}


def embedder(name: str) -> Callable:
    """Register a factory: its keyword arguments are the model's settings, what it returns maps texts to vectors."""

    def register(factory: Callable) -> Callable:
        if name in EMBEDDERS:
            raise ValueError(f"{name} is registered already")
        EMBEDDERS[name] = factory
        return factory

    return register


def embed(rows: DataFrame, name: str, id_col: str, text_col: str, **settings) -> DataFrame:
    """(id, vector) by the named embedder, which each task makes once and uses for all its batches."""
    if name not in EMBEDDERS:
        raise KeyError(f"no embedder {name}; there are {sorted(EMBEDDERS)}")
    factory = EMBEDDERS[name]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory(**settings)
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "vector": model(batch["text"].tolist())})

    return rows.selectExpr(f"cast(`{id_col}` as long) as id", f"`{text_col}` as text").mapInPandas(run, "id long, vector array<double>")


def verify(pairs: DataFrame, judge: Callable[[dict], tuple[int, float, int]], columns: list[str]) -> DataFrame:
    """Pairs (a, b, ...) judged one by one: a, b, status, prediction, confidence, matches, error. What fails is a row, too:
    its status is "failed" and its error what went wrong."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                try:
                    prediction, confidence, matches = judge(row)
                    out.append((row["a"], row["b"], "ok", prediction, confidence, matches, None))
                except Exception as error:  # the verdict on this pair is that there is none
                    out.append((row["a"], row["b"], "failed", None, None, None, str(error)))
            yield pd.DataFrame(out, columns=["a", "b", "status", "prediction", "confidence", "matches", "error"]).astype({"prediction": "Int64", "matches": "Int64"})

    return pairs.select("a", "b", *columns).mapInPandas(run, "a long, b long, status string, prediction long, confidence double, matches long, error string")


@embedder("letters")
def letters(alphabet: str = "abcdefghijklmnopqrstuvwxyz") -> Callable[[list[str]], list[list[float]]]:
    """Shares of letters: a small embedder that needs no model."""

    def model(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            counts = [float((t or "").lower().count(c)) for c in alphabet]
            total = sum(counts) or 1.0
            out.append([c / total for c in counts])
        return out

    return model
