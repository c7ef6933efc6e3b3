"""Published results: <root>/<baseline>/<metric>/summary.json and an index, merged by cell.

What is published is what the root's log of commits says; a publisher commits all
of its results as one version, over the version that it read, so two at a time
lose nothing and one that dies leaves the old version. The files follow from the
log: `export` writes those that differ, the index last, and can be repeated.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

from ..functions.naming import check_components
from ..sources.commits import Log, Snapshot
from ..sources.storage import joined
from .registry import METRICS


def merged(old: dict | None, new: dict) -> dict:
    """new over old by (domain, task); means are made anew, and what else a result says is that of the new one."""
    domains: dict = {}
    for result in filter(None, (old, new)):
        for domain, own in result["domains"].items():
            domains.setdefault(domain, {}).update(own["tasks"])
    out = {d: {"mean": _mean(tasks), "tasks": dict(sorted(tasks.items()))} for d, tasks in sorted(domains.items())}
    whole = old is None or domains == {d: own["tasks"] for d, own in new["domains"].items()}
    # figures of a part do not describe the whole
    beside = {k: v for k, v in new.items() if whole or k in ("protocol",)}
    return beside | {"overall": _mean({d: own["mean"] for d, own in out.items()}), "domains": out}


def _mean(values: dict) -> float | None:
    some = [v for v in values.values() if v is not None]
    return sum(some) / len(some) if some else None


def publish(spark: SparkSession, root: str, baseline: str, results: dict[str, dict], now: str | None = None, records: dict[str, DataFrame] | None = None) -> None:
    """Merge results into the published ones, all or none of them.

    With records, those of the (domain, task) cells that come replace the ones
    that are there, and the figures beside the means are made anew of all of them;
    without, a result that is merged keeps its means alone.
    """
    check_components([baseline])
    check_components(sorted({t for r in results.values() for own in r["domains"].values() for t in own["tasks"]}), task_names=True)
    now = now or datetime.now(timezone.utc).isoformat(timespec="seconds")
    log = Log(spark, root)

    def change(snapshot: Snapshot) -> dict:
        entries, add, remove = {}, {}, []
        for metric, result in results.items():
            key = f"{baseline}/{metric}"
            old = snapshot.properties.get(key)
            if old and old["result"].get("protocol") != result.get("protocol"):
                raise ValueError(f"{key} was published under protocol {old['result'].get('protocol')}, not {result.get('protocol')}")
            whole = merged(old["result"] if old else None, result)
            before = [p for p in snapshot.files if p.startswith(f"{key}/records/")]
            if records and metric in records:
                path = f"{key}/records/{uuid.uuid4().hex}"
                own = records[metric]
                for p in before:
                    own = _over(spark.read.parquet(joined(root, p)), own)
                own.write.parquet(joined(root, path))
                spec = METRICS.get(metric)
                if spec and spec.figures and (before or not old):
                    whole |= spec.figures(spark.read.parquet(joined(root, path)))
                add[path] = {}
            remove += before
            entries[key] = {"baseline": baseline, "metric": metric, "published": now, "result": whole}
        return {"set": entries, "add": add, "remove": remove}

    export(log, log.update(change))


def _over(old: DataFrame, new: DataFrame) -> DataFrame:
    """old without the cells that new brings, and new."""
    cell = ["domain", "task"]
    return old.join(new.select(*cell).distinct(), cell, "left_anti").unionByName(new)


def published_records(spark: SparkSession, root: str, baseline: str, metric: str) -> DataFrame | None:
    """The records behind a published result, if it came with them."""
    paths = [joined(root, p) for p in Log(spark, root).snapshot().files if p.startswith(f"{baseline}/{metric}/records/")]
    return spark.read.parquet(*paths) if paths else None


def _text(entry: dict) -> str:
    return json.dumps(entry, ensure_ascii=False, allow_nan=False, indent=1, sort_keys=True) + "\n"


def index(snapshot: Snapshot) -> dict:
    """{baseline: {metric: {path, sha256, overall}}} of what is published."""
    out: dict = {}
    for key, entry in sorted(snapshot.properties.items()):
        digest = hashlib.sha256(_text(entry).encode()).hexdigest()
        out.setdefault(entry["baseline"], {})[entry["metric"]] = {"path": f"{key}/summary.json", "sha256": digest, "overall": entry["result"]["overall"]}
    return out


def export(log: Log, snapshot: Snapshot | None = None) -> list[str]:
    """Write the files that are not there or hold something else, the index last; their paths."""
    snapshot, written = snapshot or log.snapshot(), []
    for key, entry in sorted(snapshot.properties.items()):
        path, text = f"{key}/summary.json", _text(entry)
        at = joined(log.root, path)
        if not log.storage.exists(at) or log.storage.read(at) != text.encode():
            log.storage.replace(at, text)
            written.append(path)
    # a later version's publisher writes its own; an older index must not follow it
    if log.snapshot().version == snapshot.version:
        log.storage.replace_object(joined(log.root, "index.json"), index(snapshot))
        return written
    return written + export(log)


def sync(spark: SparkSession, source: str, target: str) -> list[str]:
    """Publish at the target what the source has and the target lacks or has otherwise; the keys (baseline/metric)."""
    wanted, log, taken = Log(spark, source).snapshot().properties, Log(spark, target), []

    def change(snapshot: Snapshot) -> dict | None:
        taken[:] = sorted(k for k, entry in wanted.items() if snapshot.properties.get(k) != entry)
        return {"set": {k: wanted[k] for k in taken}} if taken else None

    export(log, log.update(change))
    return taken


def status(rows: dict[str, dict[str, dict]]) -> dict:
    """Counts and names by state of inspected runs {run: {metric: inspect row}}."""
    state = {run: next((s for s in ("wrong", "stale", "incomplete") if any(m["state"] == s for m in own.values())), "valid") for run, own in rows.items()}
    named = {s: sorted(r for r, x in state.items() if x == s) for s in ("valid", "incomplete", "stale", "wrong")}
    return {"status": "complete" if len(named["valid"]) == len(rows) else "incomplete", "expected": len(rows), **named}
