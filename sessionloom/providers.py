"""What stands outside the engine: a judge of prompts and an encoder of texts. Both run where the rows are.

The offline ones are deterministic and need no network: a keyword scorer, and signed hashing of word pieces.
"""

from __future__ import annotations

import json
import time
import zlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Judge(Protocol):
    def __call__(self, prompt: str) -> dict: ...


class Encoder(Protocol):
    dimensions: int

    def __call__(self, texts: list[str]) -> np.ndarray: ...


def retried(ask: Callable[[str], str], prompt: str, tries: int = 5, pause: float = 1.5, sleep: Callable[[float], None] = time.sleep) -> dict:
    """The JSON object that ``ask`` returns; up to ``tries`` tries, waiting longer by ``pause`` seconds after each."""
    last: Exception | None = None
    for i in range(tries):
        try:
            got = json.loads(ask(prompt))
            if isinstance(got, dict):
                return got
            raise ValueError("not an object")
        except Exception as e:  # noqa: BLE001  whatever a provider raises is tried again
            last = e
            if i + 1 < tries:
                sleep(pause * (i + 1))
    raise RuntimeError(f"no answer after {tries} tries: {last}")


class HashEncoder:
    """Signed counts of a text's three-character pieces in ``dimensions`` cells, of length one; zero for an empty text."""

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimensions), np.float32)
        for i, t in enumerate(texts):
            t = f" {t.lower()} " if t else ""
            for j in range(len(t) - 2):
                h = zlib.crc32(t[j : j + 3].encode("utf-8", "replace"))
                out[i, h % self.dimensions] += 1 if h >> 31 else -1
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, n, out=out, where=n > 0)


def encoded(rows: DataFrame, encoder: Encoder, key: str = "seq_key", text: str = "text", batch: int = 256) -> DataFrame:
    """(key, emb array<float>): texts encoded in batches, null as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                part = whole.slice(at, batch)
                emb = encoder([x or "" for x in part.column(1).to_pylist()])
                flat = pa.array(np.ascontiguousarray(emb, np.float32).ravel())
                offsets = pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * encoder.dimensions)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offsets, flat)], [key, "emb"])

    kind = dict(rows.dtypes)[key]
    return rows.select(key, F.col(text).cast("string")).mapInArrow(run, f"`{key}` {kind}, emb array<float>")


def judged(prompts: DataFrame, judge: Callable[[str], dict], key: str = "seq_key") -> DataFrame:
    """(key, response): the judge's JSON object for each prompt; null where it fails for good, which loses no other row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for p in batch.column(1).to_pylist():
                try:
                    out.append(json.dumps(judge(p or "")))
                except Exception:  # noqa: BLE001  counted as a failure by the caller
                    out.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], [key, "response"])

    kind = dict(prompts.dtypes)[key]
    return prompts.select(key, "prompt").mapInArrow(run, f"`{key}` {kind}, response string")
