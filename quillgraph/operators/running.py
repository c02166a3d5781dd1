"""Running many statements side by side, each with a time limit.

A statement runs in a thread of its own under a job tag. When its time is up the jobs of its tag are
cancelled, others go on, and it is tried again with the next, longer limit; after the last one its
status is TIMEOUT. Time spent waiting for free cores counts: a statement that takes them all delays
others until it is cancelled, and those are tried again. Statements are a list, as candidates are; their results stay on the cluster but for
the rows asked for.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import InheritableThread
from pyspark.errors import PySparkException
from pyspark.sql import Row, SparkSession

CORRECT, EMPTY, WRONG, TIMEOUT = "CORRECT", "EMPTY_RESULT", "SYNTACTICALLY_INCORRECT", "TIMEOUT"
#: Seconds of a statement's first and second try. Fixed values.
TRIES = (3.0, 5.0)
#: Seconds that cancelled jobs get to end.
GRACE = 10.0


@dataclass
class Outcome:
    id: object
    status: str
    rows: list[Row] = field(default_factory=list)
    message: str = ""
    tries: int = 1


def _once(spark: SparkSession, id_: object, sql: str, seconds: float, most: int) -> Outcome | None:
    """None if the time is up."""
    tag, found, over = f"run-{uuid.uuid4().hex}", [], threading.Event()
    context = spark.sparkContext

    def work() -> None:
        context.addJobTag(tag)
        context.setLocalProperty("spark.job.interruptOnCancel", "true")  # tasks that wait are woken to end
        try:
            rows = spark.sql(sql).limit(most).collect()
            found.append(Outcome(id_, CORRECT if rows else EMPTY, rows))
        except PySparkException as e:
            found.append(Outcome(id_, WRONG, message=str(e).splitlines()[0]))
        except Exception as e:  # a cancelled job's error, or one that Spark doesn't convert
            found.append(Outcome(id_, WRONG, message=str(e).splitlines()[0] if str(e) else type(e).__name__))
        finally:
            context.removeJobTag(tag)
            over.set()

    InheritableThread(target=work, daemon=True).start()
    if over.wait(seconds):
        return found[0]
    context.cancelJobsWithTag(tag)
    over.wait(GRACE)
    return None


def run(spark: SparkSession, id_: object, sql: str, tries: tuple[float, ...] = TRIES, most: int = 30) -> Outcome:
    """The first outcome within a try's seconds; at most so many rows."""
    for k, seconds in enumerate(tries):
        out = _once(spark, id_, sql, seconds, most)
        if out is not None:
            out.tries = k + 1
            return out
    return Outcome(id_, TIMEOUT, message=f"no result within {tries[-1]:g} seconds", tries=len(tries))


def run_all(spark: SparkSession, statements: Iterable[tuple[object, str]], tries: tuple[float, ...] = TRIES, most: int = 30, workers: int = 4) -> list[Outcome]:
    """Outcomes of (id, sql) in the order given, `workers` at a time."""
    with ThreadPoolExecutor(workers) as pool:
        return list(pool.map(lambda s: run(spark, *s, tries, most), statements))
