"""Answers of an outside judge, asked once for each different request: a cache by digest, bounded calls in flight, retries.

What the cache has is not asked again. The rest goes out chunk by chunk; in a
task a few threads wait for answers, no more requests than twice as many are
taken from the stream ahead of them, and a call that fails waits and tries again.
A chunk's answers are committed when it is done, so a restart repeats one chunk
at most; requests that fail for good are reported after the others are saved.
"""

from __future__ import annotations

import random
import time
import uuid
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources.commits import Log
from ..sources.storage import joined

ANSWERS = "digest string, answer string, error string"
CHUNK = 100_000


class Refused(Exception):
    """Raised by a judge for a request that no retry will mend."""


def asked(request: str, ask: Callable[[str], str], attempts: int, delay: float) -> tuple[str | None, str | None]:
    """(answer, error) of a request: a wait that doubles, with a random part, lies between attempts."""
    for turn in range(attempts):
        try:
            return ask(request), None
        except Refused as e:
            return None, f"refused: {e}"
        except Exception as e:
            error = f"{type(e).__name__}: {e}"
        if turn + 1 < attempts:
            time.sleep(min(60.0, delay * 2**turn) * (0.5 + random.random() / 2))
    return None, error


def _in_flight(ask: Callable[[str], str], workers: int, attempts: int, delay: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(workers) as pool:
            for frame in frames:
                waiting, rows = deque(), []

                def take() -> None:
                    digest, future = waiting.popleft()
                    rows.append((digest, *future.result()))

                for digest, request in zip(frame["digest"], frame["request"]):
                    waiting.append((digest, pool.submit(asked, request, ask, attempts, delay)))
                    if len(waiting) >= 2 * workers:
                        take()
                while waiting:
                    take()
                yield pd.DataFrame(rows, columns=["digest", "answer", "error"])

    return run


def answers(spark: SparkSession, requests: DataFrame, ask: Callable[[str], str], cache: str, workers: int = 8, attempts: int = 5, delay: float = 1.0, chunk: int = CHUNK, tasks: int | None = None) -> DataFrame:
    """requests (with a column `request`) and their answers; `cache` is a folder that later calls share.

    At most `tasks` tasks (the number of shuffle partitions, unless given) of
    `workers` threads call at a time.
    """
    log, digest = Log(spark, cache), F.sha2("request", 256)
    rows = requests.withColumn("digest", digest)
    read = lambda: [spark.read.schema(ANSWERS).parquet(joined(cache, p)) for p in sorted(log.snapshot().files)]

    def known() -> DataFrame | None:
        parts = read()
        out = parts[0] if parts else None
        for p in parts[1:]:
            out = out.unionByName(p)
        # two callers at a time may have asked the same
        return out.groupBy("digest").agg(F.min("answer").alias("answer")) if out is not None else None

    have = known()
    fresh = rows.select("digest", "request").distinct()
    fresh = fresh.join(have.select("digest"), "digest", "left_anti") if have is not None else fresh
    waiting = f"waiting/{uuid.uuid4().hex}"
    numbered = fresh.withColumn("chunk", F.pmod(F.conv(F.substring("digest", 1, 8), 16, 10).cast("long"), F.lit(max(1, -(-fresh.count() // chunk)))).cast("int"))
    numbered.write.partitionBy("chunk").parquet(joined(cache, waiting))
    failed: list[tuple[int, str]] = []
    for name in log.storage.names(joined(cache, waiting)):
        if name.startswith("chunk="):
            part = spark.read.schema("digest string, request string").parquet(joined(cache, waiting, name))
            part = part.repartition(tasks or int(spark.conf.get("spark.sql.shuffle.partitions")), "digest")
            path = f"answers/{uuid.uuid4().hex}"
            part.mapInPandas(_in_flight(ask, workers, attempts, delay), ANSWERS).write.parquet(joined(cache, path))
            done = spark.read.schema(ANSWERS).parquet(joined(cache, path))
            n, error = done.where("error IS NOT NULL").agg(F.count(F.lit(1)), F.min("error")).first()
            if n:
                failed.append((n, error))
                good = f"answers/{uuid.uuid4().hex}"
                done.where("error IS NULL").write.parquet(joined(cache, good))
                log.storage.remove(joined(cache, path))
                path = good
            log.update(lambda _, path=path: {"add": {path: {}}})
    log.storage.remove(joined(cache, waiting))
    if failed:
        raise RuntimeError(f"{sum(n for n, _ in failed)} requests had no answer, e.g. {failed[0][1]}; the others are saved in {cache}")
    have = known()
    return rows.join(have, "digest", "left").drop("digest") if have is not None else rows.withColumn("answer", F.lit(None).cast("string")).drop("digest")


def candidate_judge(spark: SparkSession, ask: Callable[[str], str], cache: str, identity: str = "", **how) -> Callable[[DataFrame], DataFrame]:
    """A judge for `runs.execute.run`: items of a bundle -> (query_id, logprob of the target).

    `ask` gets a prompt and returns JSON {label: log-probability}; `identity` (a
    model, an address) is part of what the cache goes by. A label that is not
    among the candidates' or a target without a finite log-probability of 0 or less is an error.
    """

    def judge(items: DataFrame) -> DataFrame:
        prompt = tx.judge_prompt(F.col("task_instruction"), F.col("candidates"), F.col("prediction.output"))
        rows = items.select(F.col("query.query_id").alias("query_id"), "target_subtask_id", tx.candidate_labels(F.col("candidates")).alias("labels"), prompt.alias("prompt"))
        rows = rows.withColumn("request", F.to_json(F.struct(F.lit(identity).alias("identity"), "prompt")))
        found = answers(spark, rows, _PromptOf(ask), cache, **how).withColumn("said", F.from_json("answer", "map<string,double>"))
        label = F.element_at(F.map_keys(F.map_filter("labels", lambda k, v: v == F.col("target_subtask_id"))), 1)
        strange = F.size(F.array_except(F.map_keys("said"), F.map_keys("labels"))) > 0
        logprob = F.try_element_at("said", label)
        good = ~strange & (logprob <= 0) & (logprob > -9999)
        checked = F.when(F.coalesce(good, F.lit(False)), logprob).otherwise(F.raise_error(F.concat(F.lit("unfit judgement of "), F.col("query_id"))))
        return found.select("query_id", checked.alias("logprob"))

    return judge


class _PromptOf:
    """Hands the prompt of a request on."""

    def __init__(self, ask: Callable[[str], str]):
        self.ask = ask

    def __call__(self, request: str) -> str:
        import json

        return self.ask(json.loads(request)["prompt"])
