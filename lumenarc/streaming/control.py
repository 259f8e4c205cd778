"""Running, cancelling and pausing work: one run per checkpoint, tags to interrupt jobs, and stops between micro-batches.

What is cancelled loses nothing: offsets and state lie in the checkpoint, and every micro-batch writes a folder of its own.
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


class AlreadyRunning(RuntimeError):
    """The same work is under way in this application."""


class Stopped(RuntimeError):
    """Work that ended between two micro-batches because it was asked to."""


_lock = threading.Lock()
_held: dict[tuple[str, str], threading.Event] = {}


def _key(spark: SparkSession, name: str) -> tuple[str, str]:
    return spark.sparkContext.applicationId, name


@contextmanager
def single(spark: SparkSession, name: str) -> Iterator[Callable[[], bool]]:
    """Holds a name (such as a checkpoint) for one run and tags its Spark jobs; a second run of the name is refused.

    Gives a function that tells whether cancel() was called. Streams of two applications on one checkpoint are refused by
    Spark itself, by the checkpoint's metadata and commit files.
    """
    key = _key(spark, name)
    with _lock:
        if key in _held:
            raise AlreadyRunning(name)
        _held[key] = threading.Event()
    spark.sparkContext.addJobTag(tag(name))
    try:
        yield _held[key].is_set
    finally:
        spark.sparkContext.removeJobTag(tag(name))
        with _lock:
            del _held[key]


def tag(name: str) -> str:
    return "run-" + "".join(c if c.isalnum() else "-" for c in name)


def running(spark: SparkSession, name: str) -> bool:
    return _key(spark, name) in _held


def cancel(spark: SparkSession, name: str, at_once: bool = False) -> bool:
    """Asks a run to end after its micro-batch, or interrupts its jobs at once; False if there is no such run."""
    with _lock:
        asked = _held.get(_key(spark, name))
    if asked is None:
        return False
    asked.set()
    if at_once:
        spark.sparkContext.cancelJobsWithTag(tag(name))
    return True


def stopping(work: Callable[[DataFrame, int], None], asked: Callable[[], bool]) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch that does no further micro-batch once it was asked to stop."""

    def step(batch: DataFrame, k: int) -> None:
        if asked():
            raise Stopped(f"before micro-batch {k}")
        work(batch, k)

    return step
