"""Pluggable row functions with isolation and a hard time limit (UDF surface)."""

from __future__ import annotations

import multiprocessing as mp
from collections.abc import Callable, Iterator
from multiprocessing.connection import Connection

import pandas as pd
from pyspark.sql import DataFrame

_OUT = "predicted_text string, confidence double, skipped_reason string"


def _attempt(fn: Callable, args: tuple) -> dict:
    try:
        return fn(*args)
    except Exception as e:  # noqa: BLE001 - the row reports it
        return {"skipped_reason": f"{type(e).__name__}: {e}"}


def _serve(fn: Callable, at: Connection) -> None:
    while True:
        try:
            args = at.recv()
        except EOFError:
            return
        at.send(_attempt(fn, args))


class Isolated:
    """One process that runs a function row after row, and is replaced when a row hangs or kills it.

    What the function loads once it keeps for all rows of the task.
    """

    def __init__(self, fn: Callable):
        self.fn, self.process, self.at = fn, None, None

    def _start(self) -> None:
        fork = mp.get_context("fork")
        self.at, there = fork.Pipe()
        self.process = fork.Process(target=_serve, args=(self.fn, there), daemon=True)
        self.process.start()
        there.close()

    def stop(self) -> None:
        if self.process is not None:
            self.at.close()
            self.process.terminate()
            self.process.join(1)
            if self.process.is_alive():
                self.process.kill()
            self.process = None

    def call(self, args: tuple, seconds: float) -> dict:
        """The function's dict; a reason instead of a result if it raises, hangs or dies."""
        if self.process is None:
            self._start()
        try:
            self.at.send(args)
            if self.at.poll(seconds):
                return self.at.recv()
            reason = "timeout"
        except (EOFError, OSError):
            reason = "died"
        self.stop()
        return {"skipped_reason": reason}


def run_engine(tasks: DataFrame, fn: Callable[[str, str], dict], timeout: float | None = None) -> DataFrame:
    """``tasks`` (image_path, language, and any key columns) with predicted_text, confidence and skipped_reason."""
    names = tasks.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        worker = Isolated(fn)
        try:
            for b in batches:
                rows = [_attempt(fn, args) if timeout is None else worker.call(args, timeout) for args in zip(b["image_path"], b["language"])]
                out = b[names].copy()
                for c in ("predicted_text", "confidence", "skipped_reason"):
                    out[c] = pd.Series([r.get(c) for r in rows], index=out.index, dtype="float64" if c == "confidence" else "object")
                yield out
        finally:
            worker.stop()

    fields = ", ".join(f"`{c}` {t}" for c, t in tasks.dtypes)
    return tasks.mapInPandas(run, f"{fields}, {_OUT}")
