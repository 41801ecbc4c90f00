"""Models as pluggable batch functions: registry, options, batching, retry."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from types import MappingProxyType
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType


def batches(items: Sequence, size: int) -> Iterator[Sequence]:
    """Runs of ``size`` items in order; the last may be shorter. No items, no runs."""
    if size <= 0:
        raise ValueError("batch size must be positive")
    for at in range(0, len(items or ()), size):
        yield items[at : at + size]


def bisect_retry(items: Sequence, run: Callable[[Sequence], list], errors: type[Exception] | tuple = RuntimeError) -> list:
    """``run`` on all items; a batch that fails is halved until it works or a
    single item fails. Each attempt gets its inputs anew, and results of a failed
    one are not kept, so nothing is lost or doubled."""
    if not len(items):
        return []
    try:
        return list(run(items))
    except errors:
        if len(items) == 1:
            raise
        half = len(items) // 2
        return bisect_retry(items[:half], run, errors) + bisect_retry(items[half:], run, errors)


def number(value: Any, default: float | None) -> float | None:
    """A parameter as a number: any number or its string; missing is the default."""
    return default if value is None else float(value)


def batch_size(value: Any, default: int) -> int:
    """A batch size: missing or below one is the default, itself one at least."""
    size = int(value) if value is not None else 0
    return size if size >= 1 else max(1, default)


@dataclass(frozen=True)
class Options:
    """Options of a model or a call; an immutable copy of what is given."""

    values: MappingProxyType = field(default_factory=lambda: MappingProxyType({}))

    @classmethod
    def of(cls, **values: Any) -> Options:
        return cls(MappingProxyType(dict(values)))

    def get(self, key: str, default: Any = None) -> Any:
        return self.values.get(key, default)

    def number(self, key: str, default: float) -> float:
        return number(self.values.get(key), default)

    def with_(self, **values: Any) -> Options:
        return Options(MappingProxyType({**self.values, **values}))

    def __reduce__(self):
        return (Options.of, ()) if not self.values else (_options, (dict(self.values),))


def _options(values: dict) -> Options:
    return Options(MappingProxyType(values))


#: A factory makes a model from (name, options); a model is a batch function.
Model = Callable[[Sequence, Options], list]
Factory = Callable[[str, Options], Model]


class Registry:
    """Factories by model name, for one task."""

    def __init__(self, task: str):
        self.task = task
        self._factories: dict[str, Factory] = {}

    def register(self, names: str | Iterable[str], factory: Factory) -> None:
        for name in [names] if isinstance(names, str) else names:
            self._factories[name] = factory

    def is_registered(self, name: str) -> bool:
        return name in self._factories

    def factory(self, name: str) -> Factory:
        if name not in self._factories:
            raise KeyError(f"no {self.task} model is named {name!r}; there are {sorted(self._factories)}")
        return self._factories[name]

    def names(self) -> set[str]:
        return set(self._factories)

    def unregister(self, name: str) -> bool:
        return self._factories.pop(name, None) is not None

    def clear(self) -> None:
        self._factories.clear()


TASKS = ("layout", "detection", "recognition", "doc_orientation", "line_orientation", "formula", "table", "classify", "page_text", "caption")
REGISTRIES = {task: Registry(task) for task in TASKS}


_CACHE: dict[tuple, Model] = {}
_LOCK = threading.Lock()


def cached_model(factory: Factory, name: str, options: Options) -> Model:
    """One instance a Python worker, name and options; never part of a closure."""
    key = (getattr(factory, "__module__", ""), getattr(factory, "__qualname__", repr(factory)), name, tuple(sorted((k, repr(v)) for k, v in options.values.items())))
    with _LOCK:
        if key not in _CACHE:
            _CACHE[key] = factory(name, options)
        return _CACHE[key]


def predict(
    df: DataFrame,
    factory: Factory,
    name: str,
    inputs: str | list[str],
    decode: Callable[[pd.DataFrame, list], pd.DataFrame],
    schema: StructType | str,
    size: int = 1,
    options: Options = Options(),
    errors: type[Exception] | tuple = RuntimeError,
) -> DataFrame:
    """A model over the rows of ``df``, in batches that fill across groups.

    Each Arrow batch is cut into runs of ``size`` rows, each run with bisect-retry;
    ``decode`` turns rows and results into rows of ``schema``. Filter and project
    first: neither passes a Python stage.
    """
    columns = [inputs] if isinstance(inputs, str) else inputs

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = cached_model(factory, name, options)
        for frame in frames:
            if not len(frame):
                continue
            rows = list(frame[columns[0]]) if isinstance(inputs, str) else list(frame[columns].itertuples(index=False))
            results: list = []
            for part in batches(rows, size):
                results += bisect_retry(part, lambda x: model(x, options), errors)
            yield decode(frame, results)

    return df.mapInPandas(run, schema)


def onnx_session(path: str, threads: int = 1, gpu: int = -1, gpu_memory: int | None = None):
    """A session of one thread a task; on a device where one is given. Needs
    ``onnxruntime``; no weights come with this package, so models run as far as
    the caller's files go."""
    import onnxruntime as ort

    options = ort.SessionOptions()
    options.intra_op_num_threads = threads
    limit = {"gpu_mem_limit": gpu_memory} if gpu_memory else {}
    providers = [("CUDAExecutionProvider", {"device_id": gpu, **limit})] if gpu > -1 else []
    return ort.InferenceSession(path, options, providers=[*providers, "CPUExecutionProvider"])


def onnx_factory(path: str, prepare: Callable, finish: Callable) -> Factory:
    """A factory over an ONNX file: ``prepare(items, options)`` gives the feeds,
    ``finish(outputs, items, options)`` one result an item."""

    def make(name: str, options: Options) -> Model:
        session = onnx_session(path, int(options.number("threads", 1)), int(options.number("gpu", -1)))

        def model(items: Sequence, call: Options) -> list:
            return finish(session.run(None, prepare(items, call)), items, call)

        return model

    return make


def generate(step: Callable[[np.ndarray], np.ndarray], start: np.ndarray, end: int, most: int, temperature: float = 0.0, seed: int = 42, top: int = 40, mass: float = 0.95, floor: float = 0.05) -> list[list[int]]:
    """``generate_cached`` with a ``step`` that maps all ids so far (batch, length)
    to scores, for models that keep nothing between tokens."""

    def whole(new: np.ndarray, before: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        ids = new if before is None else np.concatenate([before, new], axis=1)
        return step(ids), ids

    return generate_cached(whole, start, (end,), most, temperature, seed, top, mass, floor)


def generate_cached(step: Callable[[np.ndarray, Any], tuple[np.ndarray, Any]], start: np.ndarray, ends: Sequence[int], most: int, temperature: float = 0.0, seed: int = 42, top: int = 40, mass: float = 0.95, floor: float = 0.05) -> list[list[int]]:
    """Token loop of a batch of sequences within one call.

    ``step`` maps new ids (batch, length) and what it kept (none at first, when
    the new ids are the prompt) to scores of the next token (batch, vocabulary)
    and what it keeps, such as keys and values; so a token costs one position,
    not all before it. Greedy at temperature 0 or below, the first of equals;
    else sampled among the ``top`` best, least probability ``floor`` of the best,
    and the smallest set of probability ``mass``. A row is finished by any of
    ``ends`` and then fed the first of them, until all have finished or ``most``
    tokens stand.
    """
    new = np.asarray(start, np.int64)
    new = new[:, None] if new.ndim == 1 else new
    rng, kept = np.random.default_rng(seed), None
    done, out = np.zeros(len(new), bool), [[] for _ in range(len(new))]
    for _ in range(most):
        scores, kept = step(new, kept)
        scores = np.asarray(scores, float)
        if temperature <= 0:
            found = scores.argmax(axis=1)
        else:
            found = np.array([_sample(s / temperature, rng, top, mass, floor) for s in scores])
        found = np.where(done, ends[0], found)
        for i in np.flatnonzero(~done):
            out[i].append(int(found[i]))
        done |= np.isin(found, ends)
        if done.all():
            break
        new = found[:, None]
    return out


def _sample(scores: np.ndarray, rng: np.random.Generator, top: int, mass: float, floor: float) -> int:
    best = np.argsort(-scores, kind="stable")[:top]
    p = np.exp(scores[best] - scores[best[0]])
    best, p = best[p >= floor], p[p >= floor]
    p /= p.sum()
    cut = int(np.searchsorted(np.cumsum(p), mass)) + 1
    return int(rng.choice(best[:cut], p=p[:cut] / p[:cut].sum()))


def left_pad(rows: Sequence[Sequence[int]], pad: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Ids padded on the left to the longest row, and which places are real."""
    most = max(map(len, rows), default=0)
    ids, real = np.full((len(rows), most), pad, np.int64), np.zeros((len(rows), most), bool)
    for i, r in enumerate(rows):
        if len(r):
            ids[i, most - len(r) :], real[i, most - len(r) :] = r, True
    return ids, real


def pad_images(images: Sequence[np.ndarray], fill: int = 255) -> np.ndarray:
    """Images (height, width, channels) stacked, filled at the right and bottom."""
    h, w = max(x.shape[0] for x in images), max(x.shape[1] for x in images)
    out = np.full((len(images), h, w, images[0].shape[2]), fill, images[0].dtype)
    for i, x in enumerate(images):
        out[i, : x.shape[0], : x.shape[1]] = x
    return out
