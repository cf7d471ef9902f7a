"""Calls of models by batches: a client is anything with answer(text) -> dict; this package has a deterministic stub and no network."""

from __future__ import annotations

from collections.abc import Callable
from hashlib import md5

from pyspark.sql import DataFrame


class StubClient:
    """Answers from a hash of the text; every `fails`-th text fails at first, as a service would."""

    def __init__(self, fails: int = 0):
        self.fails = fails
        self.tried: dict[str, int] = {}

    def answer(self, text: str) -> dict:
        h = int(md5((text or "").encode()).hexdigest()[:8], 16)
        self.tried[text] = self.tried.get(text, 0) + 1
        if self.fails and h % self.fails == 0 and self.tried[text] == 1:
            raise TimeoutError("busy")
        return {"positive": h % 2 == 1, "score": h / 0xFFFFFFFF}


def answered(df: DataFrame, key: str, text: str, client: Callable[[], StubClient], retries: int = 1) -> DataFrame:
    """key, positive, score, error, attempts. What may pass is tried again; an answer without its fields is asked for once more. A row that fails for good has its error and nulls."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        own = client()
        for batch in batches:
            rows = []
            for value in batch.column(1).to_pylist():
                found, error, attempts = {}, None, 0
                while attempts <= retries:
                    attempts += 1
                    try:
                        found = own.answer(value)
                        if isinstance(found.get("positive"), bool):
                            error = None
                            break
                        error = "no answer"
                    except (TimeoutError, ConnectionError) as e:
                        error = str(e)
                rows.append((None, None, error, attempts) if error else (found["positive"], found.get("score"), None, attempts))
            if rows:
                kinds = [pa.bool_(), pa.float64(), pa.string(), pa.int32()]
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))], [key, "positive", "score", "error", "attempts"])

    return df.select(key, text).mapInArrow(run, f"{key} {kind}, positive boolean, score double, error string, attempts int")
