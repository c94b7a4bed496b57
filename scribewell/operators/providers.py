"""Models behind two small protocols, run in Arrow batches with fallback from one backend to the next.

No speech or text model is available here: the stubs are stubs, by name and in what they return.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame

from scribewell.functions.web import RUN_WORDS, START_WORDS

# What text models are told, and how models decode.
SUMMARIZE = "You are helpful assistant to summarize web article. Your output is markdown formatted. please summary with bullet points and meaningful sections."
TRANSLATE = "You are helpful assistant to translate the summary"
TOP_K, TEMPERATURE, MAX_NEW_TOKENS = 10, 0, 128


class Transcriber(Protocol):
    """Opened once for each task; ``close`` releases what it holds."""

    backend: str

    def transcribe(self, samples: list[float], language: str, task: str) -> list[str] | None: ...

    def close(self) -> None: ...


class TextModel(Protocol):
    backend: str

    def prompt(self, text: str) -> str: ...

    def close(self) -> None: ...


class Probed(Protocol):
    """What a model may say of itself before it is asked: whether it can be had, and that it runs.

    ``capability`` is one of CAPABILITIES; a model without it can be had. ``warm_up`` runs the model once on nothing; what it raises on a GPU
    with one of START_WORDS sends all work to the next backend.
    """

    def capability(self) -> str: ...

    def warm_up(self) -> None: ...


# What models say of themselves.
CAPABILITIES = ("readily", "after-download", "no")


class StubTranscriber:
    """Says how much it was given; fails on its backend if told so, when it is asked or when it is warmed up."""

    def __init__(self, backend: str = "wasm", fails_with: str | None = None, starts_with: str | None = None):
        self.backend, self.fails_with, self.starts_with = backend, fails_with, starts_with

    def warm_up(self) -> None:
        if self.starts_with:
            raise RuntimeError(self.starts_with)

    def transcribe(self, samples: list[float], language: str, task: str) -> list[str] | None:
        if self.fails_with:
            raise RuntimeError(self.fails_with)
        return [f"[stub {task} {language}: {len(samples)} samples]"] if samples else None

    def close(self) -> None:
        pass


class StubTextModel:
    """Answers with the first line of its prompt's body."""

    backend = "stub"

    def __init__(self, able: str = "readily"):
        self.able = able

    def capability(self) -> str:
        return self.able

    def prompt(self, text: str) -> str:
        return "[stub summary] " + text.partition("\n\n")[2].split("\n")[0][:80]

    def close(self) -> None:
        pass


class Opened:
    """The first of some backends that can be had and runs, and what it said of itself; errors that another one may mend move on to the next for good."""

    def __init__(self, backends: list[Callable[[], object]]):
        self.backends, self.at, self.model, self.said = backends, -1, None, "no"
        self._next()

    def _next(self) -> None:
        self.model = None
        while self.model is None and self.at + 1 < len(self.backends):
            self.at += 1
            model = self.backends[self.at]()
            probe = getattr(model, "capability", None)
            self.said = probe() if probe else "readily"
            if self.said == "no":
                model.close()
                continue
            try:
                if warm_up := getattr(model, "warm_up", None):
                    warm_up()
            except Exception as e:  # noqa: BLE001  whatever a backend raises is a status
                model.close()
                self.said = f"error: {e}"
                if not (model.backend == "webgpu" and any(w in str(e) for w in START_WORDS)):
                    self.at = len(self.backends)
                continue
            self.model = model

    def ask(self, call: Callable[[object], object]) -> tuple[object, str | None, str]:
        """(answer, backend, status); without a model the status is no_provider, or why the last one doesn't run."""
        while self.model is not None:
            model = self.model
            try:
                return call(model), model.backend, "ok"
            except Exception as e:  # noqa: BLE001  whatever a backend raises is this row's status
                mends = model.backend == "webgpu" and any(w in str(e) for w in RUN_WORDS)
                if not mends or self.at + 1 >= len(self.backends):
                    return None, model.backend, f"error: {e}"
                model.close()
                self._next()
        return None, None, "no_provider" if self.said == "no" else self.said

    def close(self) -> None:
        if self.model is not None:
            self.model.close()


def transcribed(windows: DataFrame, backends: list[Callable[[], Transcriber]], also: tuple[str, ...] = ()) -> DataFrame:
    """(stream_id, ``also``, samples, language, task) to (stream_id, ``also``, outputs, backend, status): one row for each window, in batch or stream."""
    keys = ("stream_id", *also)
    kinds = ", ".join(f"{k} {windows.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Opened(backends)
        try:
            for batch in batches:
                rows = [model.ask(lambda m, r=r: m.transcribe(r["samples"] or [], r["language"], r["task"])) for r in batch.select(["samples", "language", "task"]).to_pylist()]
                columns = [pa.array([r[0] for r in rows], pa.list_(pa.string())), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())]
                yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], *columns], [*keys, "outputs", "backend", "status"])
        finally:
            model.close()

    return windows.select(*keys, "samples", "language", "task").mapInArrow(run, f"{kinds}, outputs array<string>, backend string, status string")


def answered(prompts: DataFrame, backends: list[Callable[[], TextModel]], key: str = "page_id") -> DataFrame:
    """(key, prompt) to (key, answer, backend, status); a null prompt has a null answer and isn't asked."""
    kind = prompts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Opened(backends)
        try:
            for batch in batches:
                rows = [(None, None, "skipped") if p is None else model.ask(lambda m, p=p: m.prompt(p)) for p in batch.column("prompt").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(key), *[pa.array([r[i] for r in rows], pa.string()) for i in range(3)]], [key, "answer", "backend", "status"])
        finally:
            model.close()

    return prompts.select(key, "prompt").mapInArrow(run, f"{key} {kind}, answer string, backend string, status string")


def capabilities(keys: DataFrame, backends: list[Callable[[], TextModel]], key: str = "page_id") -> DataFrame:
    """(key, available, backend): for every row what the backend that would be asked says of itself, once it has been warmed up.

    ``available`` is one of CAPABILITIES ("no" if no backend can be had), or the error with which the last one didn't start. A task opens a backend once.
    """
    kind = keys.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Opened(backends)
        try:
            backend = None if model.model is None else model.model.backend
            for batch in batches:
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([batch.column(key), pa.array([model.said] * n, pa.string()), pa.array([backend] * n, pa.string())], [key, "available", "backend"])
        finally:
            model.close()

    return keys.select(key).mapInArrow(run, f"{key} {kind}, available string, backend string")
