"""Batch inference: prompts chains, retry, provider dispatch, embeddings.

The model is an injected function.  It is built once per task, called with a
batch of requests and answers each with a reply or an exception; one failing
row never fails its task.  Parsing, scoring and pricing stay native and follow
after this stage.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from gradeflow.functions.prompts import MAX_STEPS, substitute_text
from gradeflow.schemas import PROMPT_CHAIN, STEPS

MAX_PARALLEL_CALLS, DEFAULT_PARALLEL_CALLS = 100, 3
DEFAULT_EMBEDDING_DIMENSION = 1408
DEFAULT_EMBEDDING_PROVIDER = "google_multimodal"


@dataclass(frozen=True)
class Reply:
    """One answer of a model."""

    text: str
    prompt_tokens: int = 0
    completion_tokens: int = 0
    latency_ms: int | None = None  # measured by the caller when the model does not say


class ModelError(Exception):
    """A call that failed, with the status code the service gave."""

    def __init__(self, message: str, status_code: int | None = None):
        super().__init__(message)
        self.status_code = status_code


# A request is the row's payload columns plus system_message and prompt.
Predictor = Callable[[Sequence[dict]], Sequence[Reply | Exception]]


@dataclass(frozen=True)
class Retry:
    """Which failures are tried again, how often, and how long to wait.

    Fixed defaults of model calls: 5 attempts, 2 s doubling up to 30 s, on
    status 429 and 5xx.
    """

    max_attempts: int = 5
    initial_wait: float = 2.0
    max_wait: float = 30.0
    exponential_base: float = 2.0
    server_errors: bool = True
    sleep: Callable[[float], None] = field(default=time.sleep, compare=False)

    def wants(self, outcome: object) -> bool:
        code = getattr(outcome, "status_code", None)
        return isinstance(outcome, Exception) and code is not None and (
            code == 429 or (self.server_errors and 500 <= code < 600)
        )

    def wait(self, attempt: int) -> float:
        return min(self.max_wait, self.initial_wait * self.exponential_base ** (attempt - 1))


# Fixed defaults of embedding calls: 3 attempts, 2 s apart, on status 429 only.
EMBEDDING_RETRY = Retry(3, 2.0, 2.0, 1.0, server_errors=False)


def call_with_retry(
    call: Callable[[Sequence[dict]], Sequence], requests: Sequence[dict], retry: Retry
) -> list[tuple[object, int]]:
    """Outcome and number of attempts per request; only failed requests are sent again."""
    outcomes: list[tuple[object, int]] = [(None, 0)] * len(requests)
    waiting = list(range(len(requests)))
    for attempt in range(1, retry.max_attempts + 1):
        batch = [requests[i] for i in waiting]
        try:
            answers = list(call(batch))
            if len(answers) != len(batch):
                raise ModelError(f"{len(answers)} replies to {len(batch)} requests")
        except Exception as error:  # a failed batch call is the failure of each of its rows
            answers = [error] * len(batch)
        for i, answer in zip(waiting, answers):
            outcomes[i] = (answer, attempt)
        waiting = [i for i in waiting if retry.wants(outcomes[i][0])]
        if not waiting or attempt == retry.max_attempts:
            break
        retry.sleep(retry.wait(attempt))
    return outcomes


def dispatch(predictors: Mapping[str, Predictor], key: str = "provider") -> Predictor:
    """One predictor out of several, chosen per request by its provider."""

    def call(requests: Sequence[dict]) -> list[Reply | Exception]:
        replies: list[Reply | Exception] = [
            ValueError(f"Unknown provider: {r.get(key)}") if r.get(key) not in predictors else None for r in requests
        ]
        for name, predictor in predictors.items():
            mine = [i for i, r in enumerate(requests) if r.get(key) == name]
            if mine:
                for i, reply in zip(mine, predictor([requests[i] for i in mine])):
                    replies[i] = reply
        return replies

    return call


def chain_literal(steps: Sequence[Mapping]) -> Column:
    """A prompt chain given in the program as a constant column."""
    if not 1 <= len(steps) <= MAX_STEPS:
        raise ValueError(f"Prompt chain must have 1-{MAX_STEPS} steps")
    for place, step in enumerate(steps, start=1):
        if step.get("step_number") != place or step.get("prompt") is None:
            raise ValueError(f"step {place} needs step_number {place} and a prompt")
    return F.array(
        *[
            F.struct(
                F.lit(s["step_number"]).alias("step_number"),
                F.lit(s.get("system_message")).cast("string").alias("system_message"),
                F.lit(s["prompt"]).alias("prompt"),
            )
            for s in steps
        ]
    ).cast(PROMPT_CHAIN)


def _run_chains(rows: pd.DataFrame, chains: list, payload: list[str], call: Predictor, retry: Retry) -> tuple:
    """Run the chains of one batch step by step; step n sees the outputs of 1..n-1."""
    requests = rows[payload].to_dict("records")
    outputs: list[dict[int, str]] = [{} for _ in requests]
    records: list[list[dict]] = [[] for _ in requests]
    errors: list[str | None] = [None] * len(requests)
    finals: list[str | None] = [None] * len(requests)
    for depth in range(max((len(c) for c in chains), default=0)):
        live = [i for i, c in enumerate(chains) if depth < len(c) and errors[i] is None]
        batch = []
        for i in live:
            prompt = substitute_text(chains[i][depth]["prompt"], outputs[i])
            batch.append({**requests[i], "system_message": chains[i][depth]["system_message"], "prompt": prompt})
        started = time.monotonic()
        answered = call_with_retry(call, batch, retry)
        measured = int((time.monotonic() - started) * 1000 / max(len(batch), 1))
        for i, (reply, attempts) in zip(live, answered):
            number = int(chains[i][depth]["step_number"])
            if isinstance(reply, Exception):
                errors[i] = str(reply)
                continue
            outputs[i][number] = finals[i] = reply.text
            records[i].append(
                {
                    "step_number": number, "raw_output": reply.text,
                    "latency_ms": measured if reply.latency_ms is None else reply.latency_ms,
                    "prompt_tokens": reply.prompt_tokens, "completion_tokens": reply.completion_tokens,
                    "attempts": attempts, "error": None,
                }
            )
    responses = [None if error is not None else final for error, final in zip(errors, finals)]
    return responses, records, errors


def run_inference(
    images: DataFrame,
    chain: Column | Sequence[Mapping],
    predictor: Callable[[], Predictor],
    payload: Sequence[str],
    retry: Retry = Retry(),
    parallel_calls: int | None = None,
) -> DataFrame:
    """Run a prompt chain for every image.

    Adds model_response (output of the last step), steps and error.  A failing
    step ends the chain of its row with an error and keeps the steps before it.
    ``predictor`` builds the model client, once per task; ``payload`` names the
    columns a request carries.  ``parallel_calls`` limits how many tasks call
    the model at once; leave it out to keep the partitions as they are.
    """
    if parallel_calls is not None and not 1 <= parallel_calls <= MAX_PARALLEL_CALLS:
        raise ValueError(f"parallel_calls must be 1-{MAX_PARALLEL_CALLS}")
    payload = list(payload)
    steps = chain if isinstance(chain, Column) else chain_literal(chain)
    work = images.withColumn("_chain", steps)
    if parallel_calls is not None:
        work = work.repartition(parallel_calls)
    columns = list(images.columns)
    added = T.StructType.fromDDL(f"model_response string, steps {STEPS}, error string")
    schema = T.StructType(images.schema.fields + added.fields)

    def infer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = predictor()
        for rows in batches:
            chains = [[] if c is None else list(c) for c in rows["_chain"]]
            responses, records, errors = _run_chains(rows, chains, payload, call, retry)
            out = rows[columns].copy()
            out["model_response"], out["steps"], out["error"] = responses, records, errors
            yield out

    return work.mapInPandas(infer, schema)


@dataclass(frozen=True)
class Embedded:
    """Embeddings of one row; video segments are (start, end, vector)."""

    text: Sequence[float] | None = None
    image: Sequence[float] | None = None
    video: Sequence[tuple[float, float, Sequence[float]]] = ()


Embedder = Callable[[Sequence[dict], int], Sequence[Embedded | Exception]]


def embed(
    rows: DataFrame,
    embedders: Callable[[], Mapping[str, Embedder]],
    payload: Sequence[str],
    provider: str | None = None,
    dimension: int | None = None,
    retry: Retry = EMBEDDING_RETRY,
) -> DataFrame:
    """Add text, image and video embeddings by an injected embedder."""
    name, size = provider or DEFAULT_EMBEDDING_PROVIDER, dimension or DEFAULT_EMBEDDING_DIMENSION
    payload, columns = list(payload), list(rows.columns)
    added = T.StructType.fromDDL(
        "text_embedding array<float>, image_embedding array<float>, video_embeddings array<struct<"
        "start_offset_sec: double, end_offset_sec: double, embedding: array<float>>>, dimension int, error string"
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        embedder = embedders().get(name)
        for batch in batches:
            requests = batch[payload].to_dict("records")
            if embedder is None:
                answers = [ValueError(f"Unknown embedding provider: {name}")] * len(requests)
            else:
                answers = [a for a, _ in call_with_retry(lambda part: embedder(part, size), requests, retry)]
            good = [a if isinstance(a, Embedded) else Embedded() for a in answers]
            out = batch[columns].copy()
            out["text_embedding"] = [None if g.text is None else list(g.text) for g in good]
            out["image_embedding"] = [None if g.image is None else list(g.image) for g in good]
            out["video_embeddings"] = [
                [{"start_offset_sec": s, "end_offset_sec": e, "embedding": list(v)} for s, e, v in g.video] for g in good
            ]
            out["dimension"] = size
            out["error"] = [str(a) if isinstance(a, Exception) else None for a in answers]
            yield out

    return rows.mapInPandas(run, T.StructType(rows.schema.fields + added.fields))
