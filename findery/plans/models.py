"""Model calls from plans: callables with failover, and optional morphological tokens."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from findery.functions.text import TOKENIZERS


class NoRouteAnswered(RuntimeError):
    """Every route failed; the message names each with its error."""


def first_working(routes: Sequence[tuple[str, Callable]], fallback: Callable | None = None) -> Callable:
    """A callable that tries routes in order of priority, then the fallback if one is given."""

    def call(*args):
        errors = []
        for name, route in routes:
            try:
                return route(*args)
            except Exception as e:  # any failure of a route is a reason to try the next
                errors.append(f"{name}: {type(e).__name__}: {e}")
        if fallback is not None:
            return fallback(*args)
        raise NoRouteAnswered("; ".join(errors) or "no route")

    return call


def embedded(rows: DataFrame, model: Callable[[list[str]], list[list[float]]], text: str, dimension: int, batch: int = 64) -> DataFrame:
    """rows with ``embedding`` from a model called in batches; null texts have none, a wrong dimension fails."""
    schema = StructType([*rows.schema.fields, StructField("embedding", ArrayType(DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.schema.get_field_index(text)).to_pylist()
            some, out = [k for k, t in enumerate(texts) if t is not None], [None] * len(texts)
            for k in range(0, len(some), batch):
                own = some[k : k + batch]
                for i, v in zip(own, model([texts[i] for i in own]), strict=True):
                    if len(v) != dimension:
                        raise ValueError(f"the model gave {len(v)} numbers, not {dimension}")
                    out[i] = v
            yield b.append_column("embedding", pa.array(out, pa.list_(pa.float64())))

    return rows.mapInArrow(run, schema)


class WrongAnswer(ValueError):
    """A model's answer breaks its contract."""


RERANKED = "query_id long, chunk_id long, candidate_key string, rank long, score double, source_rank long, source_score double"


def checked_rerank(request: dict, answer: dict) -> list[dict]:
    """The results of a reranker's answer, if it keeps the contract: same profile, model, candidate count and depth, known keys, each once."""
    for field, want in (("reranker_profile_name", request["reranker_profile_name"]), ("reranker_model_id", request["reranker_model_id"]), ("candidate_count", len(request["candidates"])), ("top_k", request["top_k"])):
        if answer.get(field, want) != want:
            raise WrongAnswer(f"{field} is {answer[field]!r}, not {want!r}")
    known, out = {c["candidate_key"] for c in request["candidates"]}, []
    for r in answer.get("results", ()):
        if r.get("candidate_key") not in known:
            raise WrongAnswer(f"unknown or repeated candidate {r.get('candidate_key')!r}")
        known.discard(r["candidate_key"])
        out.append({"candidate_key": r["candidate_key"], "rank": int(r["rank"]), "score": float(r["score"])})
    if sorted(r["rank"] for r in out) != list(range(1, len(out) + 1)) or len(out) > request["top_k"]:
        raise WrongAnswer("ranks must count from 1 without a gap, up to top_k")
    return out


def reranked(candidates: DataFrame, queries: DataFrame, model: Callable[[dict], dict], k: int, profile: str, model_id: str) -> DataFrame:
    """RERANKED rows of candidates as fuse.rerank_candidates gives them, by a model that gets one query's candidates (100 at most) in a call."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        fields = ["candidate_key", "rank", "text", "source_profile_name", "source_score", "chunk_id"]
        request = {"query_text": pdf.query_text.iloc[0], "top_k": k, "reranker_profile_name": profile, "reranker_model_id": model_id, "candidates": pdf[fields].to_dict("records")}
        by_key = pdf.set_index("candidate_key")
        rows = [{"query_id": int(pdf.query_id.iloc[0]), "chunk_id": int(by_key.chunk_id[r["candidate_key"]]), **r, "source_rank": int(by_key["rank"][r["candidate_key"]]), "source_score": float(by_key.source_score[r["candidate_key"]])} for r in checked_rerank(request, model(request))]
        return pd.DataFrame(rows, columns=[f.split()[0] for f in RERANKED.split(", ")])

    return candidates.join(queries.select("query_id", "query_text"), "query_id").groupBy("query_id").applyInPandas(run, RERANKED)


def morphs(text: Column) -> Column:
    """Korean morphemes where a morphological analyser is installed, else an error that says so."""

    @F.arrow_udf("array<string>")
    def cut(texts: pa.Array) -> pa.Array:
        try:
            from mecab import MeCab
        except ImportError as e:
            raise RuntimeError("the tokenizer korean_morphs needs the package python-mecab-ko") from e
        tagger = MeCab()
        return pa.array([None if t is None else [m.lower() for m in tagger.morphs(t)] for t in texts.to_pylist()], pa.list_(pa.string()))

    return cut(text)


TOKENIZERS.setdefault("korean_morphs", morphs)
