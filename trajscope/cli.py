"""Command line: datasets, runs and their results, published results, queries of the catalog."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def _shown(value: object) -> None:
    print(json.dumps(value, ensure_ascii=False, indent=1, sort_keys=True, default=str))


def validate(spark: SparkSession, o) -> int:
    from .sources import dataset

    rows = dataset.load(spark, o.root, o.metrics.split(",") if o.metrics else None, "report").violations.groupBy("rule").count().orderBy("rule").collect()
    for r in rows:
        print(f"{r['rule']}: {r['count']}")
    return int(bool(rows))


def check_frames(spark: SparkSession, o) -> int:
    """Annotated lengths against those of the videos, of a table (task_id, episode_id, num_frames)."""
    from .plans import cohorts
    from .sources import dataset

    episodes = dataset.load(spark, o.root, []).episodes.select(F.col("task_id").alias("task"), F.col("episode_id").alias("episode"), "num_frames")
    videos = spark.read.parquet(o.videos).select(F.col("task_id").alias("task"), F.col("episode_id").alias("episode"), F.col("num_frames").cast("int").alias("found"))
    apart = episodes.join(videos, ["task", "episode"], "left").where(~F.col("found").eqNullSafe(F.col("num_frames"))).orderBy("task", "episode")
    rows = apart.limit(20).collect()
    for r in rows:
        print(f"{r['task']}/{r['episode']}: {r['num_frames']} annotated, {r['found']} in the video")
    return int(bool(rows))


def run(spark: SparkSession, o) -> int:
    from .runs import config, execute

    judgements = spark.read.parquet(o.judgements) if o.judgements else None
    _shown({m: r["overall"] for m, r in execute.run(spark, config.load(o.config), judgements).items()})
    return 0


def inspect(spark: SparkSession, o) -> int:
    from .runs import config, execute

    found = execute.inspect(spark, config.load(o.config))
    _shown(found)
    return int(any(r["state"] != "valid" for r in found.values()))


def status(spark: SparkSession, o) -> int:
    from .runs import config, execute, publish

    found = publish.status({path: execute.inspect(spark, config.load(path)) for path in o.configs})
    _shown(found)
    return int(found["status"] != "complete")


def batch(spark: SparkSession, o) -> int:
    """Which cells of some runs can be planned, and why others cannot."""
    from .runs import batch as planner
    from .runs import config
    from .sources import dataset

    asked = config.load(o.config)
    metrics = planner.expand(o.metrics or ["all"], list(asked.metrics))
    tasks = planner.expand(o.tasks or ["all"], list(asked.tasks))
    data = dataset.load(spark, asked.data, metrics)
    domains = sorted({d for m in metrics for d in asked.metrics[m][1]})
    rows = planner.eligibility(data, metrics, tasks, domains).orderBy("metric", "task").collect()
    for r in rows:
        print(f"{r['metric']} {r['task']}: {r['reason'] or 'can run'}")
    return int(not any(r["reason"] is None for r in rows))


def publish(spark: SparkSession, o) -> int:
    """Valid results of a run go to the published ones; a run with a metric that is not valid is refused."""
    from .runs import config, execute
    from .runs import publish as publisher

    asked = config.load(o.config)
    unfit = {m: r["state"] for m, r in execute.inspect(spark, asked).items() if r["state"] != "valid"}
    if unfit:
        raise ValueError(f"not valid: {unfit}")
    results = execute.saved_results(spark, asked)
    publisher.publish(spark, o.root, o.baseline, results, records={m: execute.records_of(spark, asked, m) for m in results})
    return 0


def sync(spark: SparkSession, o) -> int:
    from .runs import publish as publisher

    print("\n".join(publisher.sync(spark, o.source, o.target)))
    return 0


def leaderboard(spark: SparkSession, o) -> int:
    from .operators import board, metrics

    rows, _ = board.read_manifest(spark, o.manifest)
    ranked = metrics.ranked(metrics.leaderboard(board.domain_scores(rows))).orderBy("track", "rank")
    _shown([{k: r[k] for k in ("track", "rank", "baseline", "overall", "tsu", "tpm", "frr", "vc", "missing")} for r in ranked.collect()])
    return 0


def infer(spark: SparkSession, o) -> int:
    """Answers to a file of queries, as JSONL."""
    from .runs import execute, registry
    from .sources import wire

    q = wire.read_queries(spark, o.queries)
    state = F.coalesce("state", "state_a")
    asked = q.select("query_id", "op", state["task_id"].alias("task"), state["episode_id"].alias("episode"), state["anchor_frame"].alias("anchor"), F.col("state_b.anchor_frame").alias("anchor_b"), "instruction", F.coalesce("playback", F.lit("forward")).alias("playback"))
    settings = json.loads(o.options)
    registry.open_predictor(o.model, settings)
    wire.write_jsonl(execute.answered(asked, o.model, settings, o.batch_size), o.output)
    return 0


def judge(spark: SparkSession, o) -> int:
    """Scores of a response bundle, from a table of judgements (query_id, logprobs)."""
    from .operators import metrics
    from .plans import identify
    from .runs import results

    items = identify.select_items(identify.read_bundle(spark, o.bundle), o.tasks.split(",") if o.tasks else None, o.domains.split(",") if o.domains else None)
    _shown(results.summary(metrics.identification(identify.judged(items, spark.read.parquet(o.judgements)))))
    return 0


def curves(spark: SparkSession, o) -> int:
    """The best and worst value curves of a finished metric, as one SVG."""
    from .operators import charts
    from .runs import config, execute
    from .sources.storage import Storage

    drawn = execute.curves(spark, config.load(o.config), o.metric)
    picked = charts.selected(drawn, "score", o.most).withColumn("title", F.concat_ws(" ", "domain", "task", "place", "number", "episode"))
    Storage(spark).replace(o.output, charts.sheet(picked, title="title"))
    return 0


def listed(spark: SparkSession | None, o) -> int:
    from . import catalog, catalog_kernels, catalog_layout, catalog_plans, register  # noqa: F401
    from .runs import registry

    names = {"queries": register.QUERIES, "metrics": registry.METRICS, "predictors": registry.PREDICTORS}[o.what]
    print("\n".join(sorted(names)))
    return 0


def query(spark: SparkSession, o) -> int:
    from . import catalog, catalog_kernels, catalog_layout, catalog_plans, register  # noqa: F401
    from .sources import wire

    if o.query not in register.QUERIES:
        raise ValueError(f"unknown query {o.query}")
    wire.write_jsonl(register.QUERIES[o.query](spark, o.tables), o.output)
    return 0


def coverage(spark: SparkSession, o) -> int:
    from .operators import checked
    from .sources import wire

    report = checked.join_report(wire.read_queries(spark, o.queries), wire.read_results(spark, o.results)).groupBy("status").count().orderBy("status").collect()
    for r in report:
        print(f"{r['status']}: {r['count']}")
    return int(any(r["status"] != "ok" for r in report))


#: name: (function, help, arguments); an argument is a name or a name with argparse's settings.
COMMANDS: dict[str, tuple[Callable, str, tuple]] = {
    "validate": (validate, "check a dataset directory", ("root", ("--metrics", {"help": "comma-separated; all blocks are checked without it"}))),
    "check-frames": (check_frames, "compare annotated lengths with those of the videos", ("root", "videos")),
    "run": (run, "run a configuration", ("config", ("--judgements", {}))),
    "inspect": (inspect, "validate the saved results of a run", ("config",)),
    "status": (status, "states of several runs", (("configs", {"nargs": "+"}),)),
    "batch": (batch, "cells that a configuration can plan", ("config", ("--metrics", {"action": "append"}), ("--tasks", {"action": "append"}))),
    "publish": (publish, "publish the valid results of a run", ("root", "baseline", "config")),
    "sync": (sync, "publish at the target what the source has", ("source", "target")),
    "leaderboard": (leaderboard, "the leaderboard of a manifest", ("manifest",)),
    "infer": (infer, "answer a file of queries", ("queries", "output", ("--model", {"required": True}), ("--options", {"default": "{}"}), ("--batch-size", {"type": int, "default": 1}))),
    "judge": (judge, "score a bundle by a table of judgements", ("bundle", "judgements", ("--tasks", {}), ("--domains", {}))),
    "curves": (curves, "draw the best and worst curves of a metric", ("config", "metric", "output", ("--most", {"type": int, "default": 3}))),
    "list": (listed, "names of queries, metrics or predictors", (("what", {"nargs": "?", "default": "queries", "choices": ("queries", "metrics", "predictors")}),)),
    "query": (query, "run a catalog query and write its rows as JSONL", ("query", "tables", "output")),
    "coverage": (coverage, "compare predictions with their plan", ("queries", "results")),
}


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0: done and in order; 1: done, with findings; 2: refused."""
    parser = argparse.ArgumentParser(prog="trajscope")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, (function, text, own) in COMMANDS.items():
        command = commands.add_parser(name, help=text)
        command.set_defaults(function=function)
        for argument in own:
            if isinstance(argument, str):
                command.add_argument(argument)
            else:
                command.add_argument(argument[0], **argument[1])
    options = parser.parse_args(arguments)
    if options.command != "list":
        spark = spark or SparkSession.builder.appName("trajscope").getOrCreate()
    try:
        return options.function(spark, options)
    except (OSError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
