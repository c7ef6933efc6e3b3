"""Checks of what goes into a leaderboard, and its manifest."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.kernels import is_close
from ..sources.storage import Storage, joined
from .metrics import ID_ONLY, SIGNED

DOMAINS = ("id", "env", "emb")
ROWS = "baseline string, track string, world string, metric string, protocol string, domain string, task string, score double, mean double"


def input_problems(rows: DataFrame, protocols: dict[str, str] | None = None) -> DataFrame:
    """baseline, world, metric, domain, rule of what a leaderboard must not take.

    rows (baseline, world, metric, protocol, domain, task, score, mean): a task's
    score and the reported mean of its domain. Rules: protocol (another version),
    domain (unknown), coverage (not all domains of the metric), range (score not a
    fraction of its metric), mean (not the mean of the tasks).
    """
    key = ["baseline", "world", "metric"]
    protocols = protocols or {}
    versions = F.create_map(*(F.lit(x) for pair in protocols.items() for x in pair)) if protocols else F.create_map(F.lit(""), F.lit(""))
    wanted = F.try_element_at(versions, F.col("metric"))
    low = F.when(F.col("metric").isin(*SIGNED), -1.0).otherwise(0.0)
    free = (F.col("metric") == "csvc") & F.col("score").isNull()
    bad_score = ~free & (F.col("score").isNull() | F.isnan("score") | (F.col("score") < low) | (F.col("score") > 1))
    of_rows = F.when(wanted.isNotNull() & ~wanted.eqNullSafe(F.col("protocol")), "protocol").when(~F.col("domain").isin(*DOMAINS), "domain").when(bad_score, "range")
    single = rows.select(*key, "domain", of_rows.alias("rule")).where("rule IS NOT NULL").distinct()
    own = rows.groupBy(*key).agg(F.array_sort(F.collect_set("domain")).alias("domains"))
    whole = F.when(F.col("metric").isin(*ID_ONLY), F.array(F.lit("id"))).otherwise(F.array(*map(F.lit, sorted(DOMAINS))))
    coverage = own.where((F.col("metric") != "sia") & (F.col("domains") != whole)).select(*key, F.lit("*").alias("domain"), F.lit("coverage").alias("rule"))
    means = rows.groupBy(*key, "domain").agg(F.avg("score").alias("found"), F.max("mean").alias("mean"))
    off = ~F.coalesce(is_close(F.col("found"), F.col("mean")), F.col("found").isNull() & F.col("mean").isNull())
    return single.unionByName(coverage).unionByName(means.where(off).select(*key, "domain", F.lit("mean").alias("rule")))


def read_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, list[dict]]:
    """ROWS and the sources (baseline, world, metric, path, sha256) of a manifest, a list of short files on any file system.

    The manifest lists baselines {baseline, track, worlds: {world: {metric: relative path}}}.
    A result file holds {metric: result}, or one result as {metric, baseline, result}.
    """
    storage = Storage(spark)
    manifest, folder = storage.read_object(path), path.rpartition("/")[0]
    rows, sources, seen = [], [], set()
    for entry in manifest["baselines"]:
        name = entry.get("baseline"), entry.get("track")
        if not all(isinstance(x, str) and x for x in name) or name in seen:
            raise ValueError(f"baselines and tracks must be named, and once each: {name}")
        seen.add(name)
        for world, files in entry["worlds"].items():
            for metric, relative in files.items():
                data = storage.read(joined(folder, relative))
                saved = json.loads(data)
                if "result" in saved and (saved.get("metric"), saved.get("baseline")) != (metric, name[0]):
                    raise ValueError(f"{relative} holds another result than the manifest says")
                result = saved["result"] if "result" in saved else saved[metric]
                sources.append({"baseline": name[0], "world": world, "metric": metric, "path": relative, "sha256": hashlib.sha256(data).hexdigest()})
                for domain, own in result["domains"].items():
                    rows += [(*name, world, metric, result.get("protocol"), domain, task, score, own["mean"]) for task, score in own["tasks"].items()]
    if not rows:
        raise ValueError("a manifest without baselines")
    return spark.createDataFrame(rows, ROWS), sources


def domain_scores(rows: DataFrame, protocols: dict[str, str] | None = None) -> DataFrame:
    """(baseline, track, world, metric, domain, score) for `metrics.leaderboard`, after input_problems found nothing."""
    from ..plans.audits import raise_if_any

    raise_if_any(input_problems(rows, protocols), "unfit leaderboard inputs")
    return rows.groupBy("baseline", "track", "world", "metric", "domain").agg(F.avg("score").alias("score"))
