"""Model calls over records: tasks as generators, full provenance, errors kept apart.

A task is a generator over one record that yields requests (one, or a list) and returns a
sample. It runs in mapInPandas: one client for each partition, no driver loop, and each
record's steps and times kept with its result. Calls may be repeated when a Spark task is
retried, so clients should be idempotent; write the output once before branching on it.
"""

from __future__ import annotations

import hashlib
import inspect
import json
import subprocess
import time
from collections.abc import Callable, Generator, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import datetime
from pathlib import Path
from typing import Any, Protocol

import pandas as pd
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.messages import SAMPLING
from ..schema import TASK_OUTPUT, struct
from ..storage import path_hash, written


@dataclass
class Request:
    messages: list[dict]
    model: str | None = None
    step_id: str | None = None
    params: dict = field(default_factory=dict)


@dataclass
class Response:
    text: str | None = None
    error: str | None = None
    model_resolved: str | None = None

    @property
    def is_success(self) -> bool:
        return self.error is None

    def text_or_error(self) -> str:
        return self.text if self.is_success else f"ERROR: {self.error}"


@dataclass
class Sample:
    id: str
    messages: list[dict]


class PipelineError(Exception):
    """Ends one record's task with a typed error."""

    def __init__(self, message: str, error_type: str = "error"):
        super().__init__(message)
        self.error_type = error_type


class ModelClient(Protocol):
    def complete(self, request: Request) -> Response: ...


class HashClient:
    """A deterministic stand-in: the answer is the MD5 of the last message."""

    def complete(self, request: Request) -> Response:
        last = request.messages[-1]["content"] if request.messages else ""
        return Response(hashlib.md5(last.encode()).hexdigest(), model_resolved=request.model)


def patient(client: ModelClient, outer: int = 5, inner: int = 3, pause: float = 1.0) -> RetryingClient:
    """Up to ``inner`` tries for a call, and that up to ``outer`` times."""
    return RetryingClient(RetryingClient(client, inner, pause), outer, pause)


class RetryingClient:
    """Tries a client again after errors and empty answers, with linearly growing pauses."""

    def __init__(self, client: ModelClient, retries: int = 5, pause: float = 1.0):
        self.client, self.retries, self.pause = client, retries, pause

    def complete(self, request: Request) -> Response:
        last = Response(error="no attempt")
        for attempt in range(self.retries):
            try:
                last = self.client.complete(request)
            except Exception as e:
                last = Response(error=str(e))
            if last.is_success and last.text:
                return last
            if last.is_success:
                last = Response(error="empty response")
            if attempt + 1 < self.retries:
                time.sleep(self.pause * (attempt + 1))
        return last


def model_request(messages: list[dict], model: Any = None, step_id: str | None = None, **params) -> Request:
    """A request; model is a name, None, or a dependency with a name."""
    name = model if model is None or isinstance(model, str) else getattr(model, "name", None)
    if model is not None and name is None:
        raise TypeError(f"model must be a name or a model dependency, not {type(model).__name__}")
    return Request(messages, name, step_id, {k: v for k, v in params.items() if k in SAMPLING and v is not None})


def query(client: ModelClient, request: Request) -> Response:
    """A single call; exceptions become errors."""
    try:
        return client.complete(request)
    except Exception as e:
        return Response(error=str(e))


Task = Callable[[dict], Generator[Request | list[Request], Any, Sample | None]]


def single_turn(record: dict) -> Generator[Request, Response, Sample]:
    """Messages (or a prompt) and the model's answer."""
    messages = list(record.get("messages") if record.get("messages") is not None else [])
    messages = messages or [{"role": "user", "content": record.get("prompt") or ""}]
    answer = yield model_request(messages, record.get("_model"), **{k: record.get(k) for k in SAMPLING})
    return Sample(record["id"], [*messages, {"role": "assistant", "content": answer.text_or_error()}])


def multi_turn(record: dict) -> Generator[Request, Response, Sample]:
    """After each user turn the model answers; other turns pass through."""
    said: list[dict] = []
    turns = record.get("turns")
    for turn in list(turns) if turns is not None else []:
        said.append(dict(turn))
        if turn["role"] == "user":
            answer = yield model_request(list(said), record.get("_model"), **{k: record.get(k) for k in SAMPLING})
            said.append({"role": "assistant", "content": answer.text_or_error()})
    return Sample(record["id"], said)


def git_commit() -> str | None:
    """The first 12 digits of the working tree's commit; None outside one."""
    try:
        return subprocess.run(["git", "rev-parse", "HEAD"], capture_output=True, text=True, timeout=5, check=True).stdout.strip()[:12]
    except (OSError, subprocess.SubprocessError):
        return None


def _plain(x: Any) -> Any:
    if isinstance(x, dict):
        return {k: _plain(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)) or hasattr(x, "tolist"):
        x = x.tolist() if hasattr(x, "tolist") else x
        return [_plain(v) for v in x] if isinstance(x, (list, tuple)) else x
    return None if isinstance(x, float) and x != x else x


def run_record(task: Task, record: dict, client: ModelClient, commit: str | None = None, file: str | None = None, workers: int = 8) -> dict:
    """One record's output: an annotated sample, or an error with the steps before it."""
    started, steps = datetime.now(), []

    def ask(request: Request, index: int) -> tuple[Response, dict]:
        answer = query(client, request)
        step = {
            "messages": request.messages, "model": request.model, "model_resolved": answer.model_resolved, "sampling": {k: str(v) for k, v in request.params.items()},
            "response": answer.text, "error": answer.error, "step_id": request.step_id, "step_index": index, "timestamp": datetime.now(),
        }
        return answer, step

    def failed(kind: str, message: str) -> dict:
        error = {"error": kind, "message": message, "input_data": json.dumps(record, default=str), "steps": steps, "pipeline_commit": commit, "pipeline_file": file, "started_at": started, "failed_at": datetime.now()}
        return {"__ERROR__": error}

    try:
        # The generator's code also runs on creation for plain functions, so that is inside as well.
        run = task(record)
        answer: Any = None
        while True:
            try:
                wanted = run.send(answer)
            except StopIteration as end:
                sample = end.value
                break
            if isinstance(wanted, list):
                with ThreadPoolExecutor(min(workers, max(1, len(wanted)))) as pool:
                    got = list(pool.map(ask, wanted, range(len(steps), len(steps) + len(wanted))))
                steps += [s for _, s in got]
                answer = [a for a, _ in got]
            else:
                answer, step = ask(wanted, len(steps))
                steps.append(step)
    except PipelineError as e:
        return failed(e.error_type, str(e))
    except Exception as e:
        return failed("unexpected_error", f"{type(e).__name__}: {e}")
    if sample is None:
        return failed("skipped", "the task returned no sample")
    if not isinstance(sample, Sample):
        return failed("unexpected_error", f"TypeError: a task must return a Sample, not {type(sample).__name__}")
    return {
        "id": sample.id, "messages": sample.messages, "input_data": json.dumps(record, default=str), "steps": steps,
        "pipeline_commit": commit, "pipeline_file": file, "started_at": started, "completed_at": datetime.now(),
    }


def respond(records: DataFrame, client: Callable[[], ModelClient] = HashClient, workers: int = 8) -> DataFrame:
    """records (messages or prompt, _model and sampling options if they have them) with response: the model's answer, or ERROR: and why there is none. All columns stay."""
    kept = records.drop("response")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = client()

        def one(record: dict) -> str | None:
            return query(made, next(single_turn(record))).text_or_error()

        with ThreadPoolExecutor(workers) as pool:
            for batch in batches:
                said = list(pool.map(one, [{"id": None} | r for r in batch.to_pylist()]))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(said, pa.string())], [*batch.schema.names, "response"])

    return kept.mapInArrow(run, StructType([*kept.schema.fields, StructField("response", StringType())]))


def rollout(records: DataFrame, task: Task, client: Callable[[], ModelClient] = HashClient, commit: str | None = None, file: str | None = None, workers: int = 8, done: Accumulator | None = None) -> DataFrame:
    """records through a task: rows of TASK_OUTPUT, errors under __ERROR__. ``client`` is made once for each partition; ``done`` counts finished records as they come."""

    names = struct(TASK_OUTPUT).names

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = client()
        with ThreadPoolExecutor(workers) as pool:
            for frame in frames:
                rows = [_plain(r) for r in frame.to_dict("records")]
                out = list(pool.map(lambda r: run_record(task, r, made, commit, file), rows))
                if done is not None:
                    done.add(len(out))
                yield pd.DataFrame([{n: o.get(n) for n in names} for o in out], columns=names, dtype=object)

    return records.mapInPandas(run, TASK_OUTPUT)


class Pipeline:
    """What a project defines: a name, dependencies, and transform(spark) giving samples. Subclasses get copies of the dependencies."""

    name = ""
    deps: dict[str, Any] = {}
    registry: dict[str, type[Pipeline]] = {}

    def __init_subclass__(cls, **kw):
        super().__init_subclass__(**kw)
        cls.deps = dict(cls.deps)
        if cls.name:
            Pipeline.registry[cls.name] = cls

    def setup(self) -> None: ...

    def teardown(self) -> None: ...

    def transform(self, spark) -> DataFrame:
        raise NotImplementedError

    def execute(self, spark, limit: int | None = None) -> DataFrame:
        """The samples, made and written before teardown."""
        self.setup()
        try:
            out = self.transform(spark)
            return written(out if limit is None else out.orderBy("id").limit(limit))
        finally:
            self.teardown()


@dataclass(frozen=True)
class ModelDep:
    """A registered model; its system prompt's hash tells whether it has changed."""

    name: str
    sysprompt: str | None = None
    type = "model"

    def hash(self) -> str | None:
        return hashlib.sha256(self.sysprompt.encode()).hexdigest()[:16] if self.sysprompt else None

    def entry(self) -> dict:
        return {"type": self.type, "registry": self.name, "sysprompt_hash": self.hash()}


@dataclass(frozen=True)
class FileDep:
    """A file or a folder of the project; the hash of its content tells whether it has changed."""

    path: str
    type = "file"

    def read(self) -> str:
        return Path(self.path).read_text()

    def exists(self) -> bool:
        return Path(self.path).exists()

    def hash(self) -> str | None:
        return path_hash(self.path)

    def entry(self) -> dict:
        return {"type": self.type, "path": self.path, "content_hash": self.hash()}


def code_hash(pipeline: type[Pipeline]) -> str:
    """16 hex digits of the SHA-256 of a pipeline's source."""
    return hashlib.sha256(inspect.getsource(pipeline).encode()).hexdigest()[:16]


def dependency_rows(pipeline: type[Pipeline]) -> list[tuple[str, str, str, str | None]]:
    """owner, attr, type, hash of a pipeline's declared dependencies; a plain value counts by its text."""
    known = lambda v: (v.type, v.hash()) if isinstance(v, (ModelDep, FileDep)) else (type(v).__name__, hashlib.sha256(str(v).encode()).hexdigest()[:16])
    return [(pipeline.name, k, *known(v)) for k, v in sorted(pipeline.deps.items())]


def manifest_entries(pipeline: type[Pipeline]) -> dict[str, dict]:
    """What a pipeline's manifest says of each dependency."""
    return {k: v.entry() for k, v in sorted(pipeline.deps.items()) if isinstance(v, (ModelDep, FileDep))}


def success(df: DataFrame) -> DataFrame:
    return df.where(F.col("error").isNull())
