"""The boundary to models: embedders, rerankers and generators are injected; deterministic stand-ins come along."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def embedded(rows: DataFrame, text: str, embed: Callable[[list[str]], list[list[float]]], batch: int = 10, tries: int = 3) -> DataFrame:
    """rows with vector and error: batches go to `embed`; one that keeps failing is tried text by text, so one bad text
    fails alone."""

    def safely(texts: list[str]) -> list[tuple[list[float] | None, str]]:
        for _ in range(tries):
            try:
                found = embed(texts)
                if len(found) != len(texts):
                    raise ValueError(f"{len(found)} vectors for {len(texts)} texts")
                return [(v, "") for v in found]
            except Exception as e:
                error = str(e)
        return [(None, error)] if len(texts) == 1 else [x for t in texts for x in safely([t])]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts = part[text].fillna("").tolist()
            made = [x for i in range(0, len(texts), batch) for x in safely(texts[i : i + batch])]
            yield part.assign(vector=[v for v, _ in made], error=[e for _, e in made])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(run, f"{schema}, vector array<float>, error string")


def hashed_embedder(dim: int = 16) -> Callable[[list[str]], list[list[float]]]:
    """A stand-in: character trigrams counted in `dim` classes by CRC."""
    from zlib import crc32

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * dim
            for i in range(len(t) - 2):
                v[crc32(t[i : i + 3].encode()) % dim] += 1.0
            out.append(v)
        return out

    return embed


def reranked_by(rows: DataFrame, query: str, text: str, rerank: Callable[[list[str], list[str]], list[float]]) -> DataFrame:
    """rows with rerank: scores in 0..1, one for each pair, or the task fails."""

    @F.pandas_udf("double")
    def score(q: pd.Series, t: pd.Series) -> pd.Series:
        found = rerank(q.tolist(), t.tolist())
        if len(found) != len(q) or any(not 0 <= x <= 1 for x in found):
            raise ValueError("a reranker returns one score in 0..1 for each pair")
        return pd.Series(found)

    return rows.withColumn("rerank", score(query, text))


def generated(rows: DataFrame, key: str, generate: Callable[[list[dict]], list[dict]], schema: str, batch: int = 20) -> DataFrame:
    """What `generate` returns for batches of rows; answers for unknown or repeated keys go."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows_ = part.to_dict("records")
            out = []
            for i in range(0, len(rows_), batch):
                left = {r[key] for r in rows_[i : i + batch]}
                for answer in generate(rows_[i : i + batch]):
                    if answer.get(key) in left:
                        left.discard(answer[key])
                        out.append(answer)
            yield pd.DataFrame(out, columns=[f.split()[0] for f in schema.split(",")])

    return rows.mapInPandas(run, schema)
