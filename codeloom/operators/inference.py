"""Batch inference as Spark jobs: embeddings and method descriptions.

The model sits behind a plain callable that works on lists. It is made once per
task, only for inputs no cache holds, and its results are written before use, so a
lost executor never causes a second round of calls for finished work.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom import constants as K
from codeloom.functions import text
from codeloom.operators import cache
from codeloom.session import ship_package, stage
from codeloom.sources.caches import CacheTable

Embedder = Callable[[list[str]], list[Sequence[float]]]
Describer = Callable[[list[dict]], str]


def hashing_embedder(dim: int = 32) -> Embedder:
    """Deterministic vectors from SHA-256 bytes; for tests and dry runs."""

    def vector(value: str) -> list[float]:
        raw = b""
        block = 0
        while len(raw) < dim:
            raw += hashlib.sha256(f"{block}\n{value}".encode()).digest()
            block += 1
        return [(b - 127.5) / 127.5 for b in raw[:dim]]

    return lambda texts: [vector(t) for t in texts]


def batches(frames: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    """Regroup a task's frames into frames of ``size`` rows, the last one shorter."""
    rest: pd.DataFrame | None = None
    for frame in frames:
        rest = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
        full = len(rest) - len(rest) % size
        for start in range(0, full, size):
            yield rest.iloc[start : start + size]
        rest = rest.iloc[full:]
    if rest is not None and len(rest):
        yield rest


def with_retries(call: Callable, retries: int, delay: Callable[[int], float]):
    """(result, None) of the first call that works, else (None, last error)."""
    error = None
    for attempt in range(retries + 1):
        try:
            return call(), None
        except Exception as exc:  # a provider may raise anything
            error = f"{type(exc).__name__}: {exc}"
            if attempt < retries:
                time.sleep(delay(attempt))
    return None, error


def batch_sizes(df: DataFrame, size: int) -> DataFrame:
    """How many rows each inference batch would hold: one row per batch."""

    ship_package(df.sparkSession)

    def sizes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches(frames, size):
            yield pd.DataFrame({"batch_rows": [len(frame)]})

    return df.mapInPandas(sizes, "batch_rows int")


def embed(
    requests: DataFrame,
    make_embedder: Callable[[], Embedder],
    batch_size: int = K.EMBED_BATCH,
    retries: int = K.EMBED_RETRIES,
    backoff: float = K.EMBED_BACKOFF,
) -> DataFrame:
    """``(sha, vector, error)`` for every ``(sha, text)``; a failed batch gives errors."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        embedder = None
        for frame in batches(frames, batch_size):
            embedder = embedder or make_embedder()
            texts = list(frame["text"])

            def call(embedder=embedder, texts=texts):
                found = [[float(x) for x in v] for v in embedder(texts)]
                if len(found) != len(texts):
                    raise ValueError(f"{len(found)} vectors for {len(texts)} texts")
                return found

            found, error = with_retries(call, retries, lambda n: backoff * 2**n)
            yield pd.DataFrame(
                {
                    "sha": frame["sha"].to_numpy(),
                    "vector": found if found is not None else [None] * len(frame),
                    "error": [error] * len(frame),
                }
            )

    ship_package(requests.sparkSession)
    narrow = requests.select("sha", "text")
    return narrow.mapInPandas(run, "sha string, vector array<float>, error string")


@dataclass(frozen=True)
class Inferred:
    """Entries for every request, those that are new for the cache, and failures."""

    entries: DataFrame
    fresh: DataFrame
    rejects: DataFrame


def embed_cached(
    requests: DataFrame,
    embed_cache: DataFrame | CacheTable,
    make_embedder: Callable[[], Embedder],
    model: str,
    folder: str,
    dim: int | None = None,
    **options,
) -> Inferred:
    """Vectors for all ``(sha, text)``, calling the model once per hash not cached.

    ``embed_cache`` is a cache table, to which the fresh vectors are added and whose entries
    then answer for all, or a frame of entries ``(model, sha, vector)``.
    """
    stored = isinstance(embed_cache, CacheTable)
    known = embed_cache.entries() if stored else cache.valid_vectors(embed_cache, model, dim)
    wanted = cache.misses(requests.select("sha", "text"), known)
    answers = stage(embed(wanted, make_embedder, **options), f"{folder}/embedded")
    fresh = answers.where(F.col("error").isNull()).select("sha", "vector")
    if stored:
        embed_cache.add(fresh)
    return Inferred(
        entries=embed_cache.entries() if stored else cache.merge(known, fresh),
        fresh=fresh.select(F.lit(model).alias("model"), "sha", "vector"),
        rejects=answers.where(F.col("error").isNotNull()).select("sha", "error"),
    )


_ARRAY = re.compile(r"\[.*\]", re.DOTALL)


def _answers(raw: str) -> dict[str, dict]:
    """Objects of the array in a reply by their hash; of several for one hash the last."""
    held = _ARRAY.search(raw)
    if held is None:
        raise ValueError("reply holds no JSON array")
    objects = (x for x in json.loads(held[0]) if isinstance(x, dict))
    return {x["hash"]: x for x in objects if isinstance(x.get("hash"), str)}


UNANSWERED = "the reply leaves the request out"


def _texts(answer: object) -> tuple[str | None, str | None, str | None]:
    """Summary and description of an answer, and what is wrong with it."""
    if answer is None:
        return None, None, UNANSWERED
    if not isinstance(answer, dict):
        return None, None, "the answer is no object"
    said = [answer.get(k) for k in ("summary", "description")]
    if any(x is not None and not isinstance(x, str) for x in said):
        return None, None, "the answer is no text"
    return said[0], said[1], None


CALLS = 256  # whose answers make one frame, as a frame costs more than many answers


def answered(
    frames: Iterator[pd.DataFrame], make_describer: Callable[[], Describer],
    batch_size: int, retries: int, backoff: float,
) -> Iterator[pd.DataFrame]:
    """What the model says of a task's rows ``(sha, signature, body, prompt)``, ``batch_size`` a call."""
    describer = None
    for block in batches(frames, batch_size * CALLS):
        asked = block[["sha", "signature", "prompt"]].to_numpy().tolist()
        told, errors = [], []
        for at in range(0, len(asked), batch_size):
            describer = describer or make_describer()
            some = asked[at : at + batch_size]
            items = [{"hash": h, "signature": s, "body": p} for h, s, p in some]

            def call(describer=describer, items=items):
                return _answers(describer(items))

            found, error = with_retries(call, retries, lambda n: backoff**n)
            texts = [_texts((found or {}).get(h)) for h, _, _ in some]
            told += texts
            errors += [error or t[2] for t in texts]
        yield pd.DataFrame(
            {
                "sha": block["sha"].to_numpy(),
                "body": block["body"].to_numpy(),
                "said": [t[0] for t in told],
                "described": [t[1] for t in told],
                "error": errors,
            }
        )


def describe(
    requests: DataFrame,
    make_describer: Callable[[], Describer] | None = None,
    batch_size: int = K.CHAT_BATCH,
    retries: int = K.CHAT_RETRIES,
    backoff: float = K.CHAT_BACKOFF,
) -> DataFrame:
    """``(sha, summary, error)`` for every ``(sha, signature, body)``.

    Without a model, and for a batch that keeps failing, the summary is the heuristic
    one, as for an answer that is not text. A request the reply leaves out gets the fixed
    default. All of these carry an error, so that they are asked again next time.
    """
    if make_describer is None:
        plain = text.heuristic_summary(F.col("body"))
        none = F.lit(None).cast("string")
        return requests.select("sha", plain.alias("summary"), none.alias("error"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return answered(frames, make_describer, batch_size, retries, backoff)

    ship_package(requests.sparkSession)
    asked = requests.select(
        "sha", "signature", "body", text.prompt_body(F.col("body")).alias("prompt")
    ).mapInPandas(
        run, "sha string, body string, said string, described string, error string"
    )
    return asked.select(
        "sha",
        F.when(F.col("error") != UNANSWERED, text.heuristic_summary(F.col("body")))
        .otherwise(text.summary_or_default(F.col("said"), F.col("described")))
        .alias("summary"),
        "error",
    )


def describe_cached(
    functions: DataFrame,
    summary_cache: DataFrame | CacheTable,
    model: str,
    folder: str | None = None,
    make_describer: Callable[[], Describer] | None = None,
    **options,
) -> Inferred:
    """Summaries for all functions ``(sha, signature, body_short)`` by content hash.

    Answers without an error are added where ``summary_cache`` is a cache table.
    """
    stored = isinstance(summary_cache, CacheTable)
    known = summary_cache.entries() if stored else cache.valid_summaries(summary_cache, model)
    requests = functions.select("sha", "signature", F.col("body_short").alias("body"))
    answers = describe(cache.misses(requests, known), make_describer, **options)
    if make_describer is not None or stored:
        answers = stage(answers, f"{folder}/described")
    worked = answers.where(F.col("error").isNull())
    entries = cache.merge(known, answers.select("sha", "summary"))
    if stored:
        summary_cache.add(worked.select("sha", "summary"))
        # what is not stored is told from the answers
        entries = cache.merge(summary_cache.entries(), answers.where(F.col("error").isNotNull()).select("sha", "summary"))
    return Inferred(
        entries=entries,
        fresh=worked.select(F.lit(model).alias("model"), "sha", "summary"),
        rejects=answers.where(F.col("error").isNotNull()).select("sha", "error"),
    )


def with_method_hash(functions: DataFrame) -> DataFrame:
    return functions.withColumn(
        "sha", text.method_hash(F.col("signature"), F.col("body_short"))
    )


def put_back(functions: DataFrame, entries: DataFrame) -> DataFrame:
    """Attach to every function its description, by hash, with the default if none."""
    keyed = cache.lookup(functions, entries, ["repo", "path", "fn_index"])
    return keyed.withColumn(
        "description", F.coalesce("summary", F.lit(K.SUMMARY_MISSING))
    ).drop("summary")
