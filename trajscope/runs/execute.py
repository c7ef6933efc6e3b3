"""A run: plan, predict what is pending, join, score; per metric, so that a restart goes on where it stopped.

Every metric has a folder with a log of commits (`sources.commits`), on any file
system: answers are added chunk by chunk, the result comes last, with digests of
all its stages, by which `inspect` finds the first that has changed since.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import checked, layout, lineage
from ..plans import identify
from ..sources import contents, dataset
from ..sources.commits import Log, Snapshot
from ..sources.scratch import fresh_path
from ..sources.storage import Storage, joined
from . import results
from .config import RunConfig
from .registry import METRICS, Metric, Predictor, check_domains, check_mode, open_predictor, planned, predictor_class

ASKED = ["op", "task", "episode", "anchor", "anchor_b", "instruction", "playback"]
ANSWERS = "query_id string, op string, score double, output string"


def as_asked(plan: DataFrame, op: str) -> DataFrame:
    """query_id and the columns ASKED of a plan."""
    have = set(plan.columns)
    first = "anchor_a" if "anchor_a" in have else "anchor"
    other = lambda c, kind: F.col(c).cast(kind) if c in have else F.lit(None).cast(kind)
    return plan.select("query_id", F.lit(op).alias("op"), "task", "episode", F.col(first).alias("anchor"), other("anchor_b", "int").alias("anchor_b"), "instruction", F.coalesce(other("playback", "string"), F.lit("forward")).alias("playback"))


def answered(queries: DataFrame, model: str, settings: dict, batch_size: int = 1, native: str | None = None) -> DataFrame:
    """ANSWERS for queries of any op, each kind by its own method, in the order of the batch; a model is opened once per partition.

    Values of equal states are asked once in a partition; queries of an episode
    meet in one, as far as partitions of equal cost allow. A compare is the
    difference of the values of its two states.
    """

    def of_states(predictor, rows: pd.DataFrame, known: dict) -> list[float]:
        states = [*zip(rows["task"], rows["episode"], rows["anchor"], rows["instruction"], rows["playback"], strict=True)]
        fresh = [*dict.fromkeys(s for s in states if s not in known)]
        for k in range(0, len(fresh), batch_size):
            part = pd.DataFrame(fresh[k : k + batch_size], columns=["task", "episode", "anchor", "instruction", "playback"])
            known.update(zip(fresh[k : k + batch_size], _checked(predictor.value(part), len(part)), strict=True))
        return [known[s] for s in states]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predictor, known, episode = open_predictor(model, settings), {}, None
        for frame in frames:
            for (task, name), part in frame.groupby(["task", "episode"], sort=False):
                if (task, name) != episode:  # what was asked of other episodes is not asked again
                    known, episode = {}, (task, name)
                for op, rows in part.groupby("op", sort=False):
                    out = rows[["query_id", "op"]].assign(score=None, output=None)
                    if native:
                        out["score"] = _checked(getattr(predictor, native)(rows), len(rows))
                    elif op == "subtask":
                        out["output"] = _checked(predictor.subtask(rows), len(rows))
                    elif op == "compare":
                        left = of_states(predictor, rows, known)
                        out["score"] = [b - a for a, b in zip(left, of_states(predictor, rows.assign(anchor=rows["anchor_b"].astype(int)), known), strict=True)]
                    else:
                        out["score"] = of_states(predictor, rows, known)
                    yield out

    asked = queries.select("query_id", *ASKED)
    kind = predictor_class(model)
    if native is None and kind.answer_states is not Predictor.answer_states:
        return _answered_by_table(asked, kind(**settings))
    # a state costs as much as the prefix that a predictor reads for it
    partitions = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    together = layout.balanced(asked, ["task", "episode"], "anchor", F.greatest(F.col("anchor"), F.coalesce("anchor_b", F.lit(0))) + 1, partitions)
    return together.select("query_id", *ASKED).mapInPandas(run, ANSWERS)


def _answered_by_table(asked: DataFrame, predictor: Predictor) -> DataFrame:
    """ANSWERS of a predictor that takes the states as a table; each different one is asked once."""
    state = ["task", "episode", "anchor", "instruction", "playback"]
    other = asked.where("op = 'compare'").withColumn("anchor", F.col("anchor_b"))
    values = predictor.answer_states(asked.unionByName(other).where("op <> 'subtask'").select(*state).distinct()).select(*state, "score")
    own = asked.join(values.withColumnRenamed("score", "a"), state, "left")
    own = own.join(values.withColumnsRenamed({"anchor": "anchor_b", "score": "b"}), ["task", "episode", "anchor_b", "instruction", "playback"], "left")
    score = F.when(F.col("op") == "compare", F.col("b") - F.col("a")).otherwise(F.col("a"))
    output = F.when(F.col("op") == "subtask", predictor.subtask_text(own))
    return own.select("query_id", "op", score.alias("score"), output.alias("output"))


def _checked(answers: list, n: int) -> list:
    if len(answers) != n:
        raise ValueError(f"predictor gave {len(answers)} answers for {n} rows")
    return answers


@dataclass(frozen=True)
class Inputs:
    """What a run reads beside its configuration, as digests: the dataset's files, the checkpoint's and the code's."""

    data: str
    checkpoint: str | None
    code: dict[str, str]


def inputs(spark: SparkSession, config: RunConfig) -> Inputs:
    predictor = predictor_class(config.model)
    code = {m: contents.code_digest(predictor, METRICS[m].plan, METRICS[m].score, METRICS[m].records or METRICS[m].score) for m in config.metrics}
    return Inputs(contents.tree_digest(contents.dataset_files(spark, config.data)), contents.tree_digest(contents.digests(spark, config.checkpoint)) if config.checkpoint else None, code)


class Scratch:
    """Tables that are read often in a run, written once to the shared folder and removed at its end."""

    def __init__(self, spark: SparkSession):
        self.spark, self.storage, self.paths = spark, Storage(spark), []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for path in self.paths:
            self.storage.remove(path)

    def settled(self, rows: DataFrame, tag: str) -> DataFrame:
        self.paths.append(fresh_path(self.spark, tag))
        rows.write.parquet(self.paths[-1])
        return self.spark.read.schema(rows.schema).parquet(self.paths[-1])

    def dataset(self, root: str, metrics: list[str]) -> dataset.Dataset:
        """A checked dataset; its files are parsed once."""
        data = dataset.load(self.spark, root, metrics, "report")
        data = dataset.Dataset(self.settled(data.tasks, "tasks"), self.settled(data.episodes, "episodes"), self.settled(data.violations, "violations"))
        dataset.raise_violations(data)
        return data


def identity(plan: DataFrame, config: RunConfig, metric: str, own: Inputs) -> dict:
    """What saved answers are bound to: the queries, the model with its settings and checkpoint, the data and the code."""
    queries = checked.fingerprint(as_asked(plan, METRICS[metric].op).withColumn("all_", F.lit(0)), ["all_"]).first()
    return {
        "queries": queries["fingerprint"] if queries else "", "model": config.model, "options": dict(config.model_options), "mode": config.metrics[metric][0],
        "checkpoint": own.checkpoint, "data": own.data, "code": own.code[metric],
    }


def changed(old: dict | None, new: dict) -> list[str]:
    """Names of the parts in which two identities differ."""
    return sorted(k for k in new.keys() | (old or {}).keys() if (old or {}).get(k) != new.get(k))


def _read(spark: SparkSession, log: Log, snapshot: Snapshot, kind: str) -> list[DataFrame]:
    schema = {"parts": ANSWERS, "digests": lineage.ROWS, "judgements": JUDGEMENTS}.get(kind)
    reader = spark.read.schema(schema) if schema else spark.read
    return [reader.parquet(joined(log.root, path)) for path in sorted(snapshot.files) if path.startswith(f"{kind}/")]


def _save(log: Log, rows: DataFrame, kind: str) -> str:
    """Rows in a new folder below the log's root; they belong to it once they are committed."""
    path = f"{kind}/{uuid.uuid4().hex}"
    rows.write.parquet(joined(log.root, path))
    return path


JUDGEMENTS = "query_id string, logprob double"


def predicted(spark: SparkSession, plan: DataFrame, config: RunConfig, metric: str, log: Log, bound: dict) -> DataFrame:
    """Answers to the whole plan: those saved below the log's root, and new ones for the rest, saved chunk by chunk.

    A chunk holds whole episodes, about config.chunk_rows queries, and is
    committed when it is written, so a run that is killed loses one chunk. Saved
    answers of other inputs are an error, and so is a second run at the same time.
    Any partitioning of a restart will do.
    """
    op = METRICS[metric].op
    snapshot = log.update(lambda s: {"set": {"identity": bound}} if "identity" not in s.properties else None)
    if snapshot.properties["identity"] != bound:
        raise ValueError(f"{log.root} has answers to other queries, of another model or to other inputs: {', '.join(changed(snapshot.properties['identity'], bound))}")
    asked = as_asked(plan, op)
    parts = _read(spark, log, snapshot, "parts")
    done = checked.union_parts(parts) if parts else None
    rest = checked.pending(asked, done) if done is not None else asked
    n = rest.count()
    if n:
        native = check_mode(metric, config.metrics[metric][0], predictor_class(config.model))
        chunks = -(-n // config.chunk_rows)
        staged = fresh_path(spark, "pending")
        rest.withColumn("chunk", F.pmod(F.xxhash64("task", "episode"), F.lit(chunks)).cast("int")).write.partitionBy("chunk").parquet(staged)
        read = spark.read.schema(rest.schema).option("basePath", staged)
        for name in log.storage.names(staged):
            if not name.startswith("chunk="):
                continue
            known = snapshot.version
            fresh = _save(log, answered(read.parquet(joined(staged, name)), config.model, config.model_options, config.batch_size, native), "parts")

            def commit(now: Snapshot, known: int = known, fresh: str = fresh) -> dict:
                if now.version != known:
                    raise RuntimeError(f"{log.root}: another run writes answers here")
                return {"add": {fresh: {}}}

            snapshot = log.update(commit)
        log.storage.remove(staged)
    return checked.union_parts(_read(spark, log, snapshot, "parts"))


def judgement_items(data: dataset.Dataset, plan: DataFrame, answers: DataFrame) -> DataFrame:
    """Items of a bundle for the judge: plan, answers and each task's candidates."""
    known = data.tasks.select(F.col("task_id").alias("task"), F.map_from_entries(F.transform("subtasks", lambda x: F.struct(x["id"], x["description"]))).alias("candidates"))
    return identify.bundle(plan, answers, F.broadcast(known))


def joined_up(spec: Metric, data: dataset.Dataset, plan: DataFrame, answers: DataFrame, judged: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """The plan with its scores, and the judge's items where there are any."""
    if spec.op != "subtask":
        return checked.join_checked(plan.withColumn("op", F.lit(spec.op)), answers.drop("output").withColumnRenamed("score", "v")), None
    scored = checked.join_checked(plan.withColumn("op", F.lit("subtask")), judged.withColumn("op", F.lit("subtask")), ignore_extra=True)
    return scored, judgement_items(data, plan, answers)


def stages(spec: Metric, plan: DataFrame, answers: DataFrame, records: DataFrame, items: DataFrame | None, judged: DataFrame | None) -> DataFrame:
    """lineage.ROWS of a result's stages, in the order in which each follows from those before."""
    rows = [lineage.stage(0, "plan", as_asked(plan, spec.op), ["query_id"], ASKED), lineage.stage(1, "answers", answers, ["query_id"], ["op", "score", "output"])]
    if items is not None:
        flat = items.select(F.col("query.query_id").alias("query_id"), "query", "prediction", "target_subtask_id", "task_instruction", "candidates", "domain")
        rows.append(lineage.stage(2, "bundle", flat, ["query_id"], ["query", "prediction", "target_subtask_id", "task_instruction", "candidates", "domain"]))
        rows.append(lineage.stage(3, "judgements", judged, ["query_id"], number="logprob"))
    rows.append(lineage.stage(4, "records", records.withColumn("number_", results.number(records)), results.record_keys(records), number="number_"))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def run(spark: SparkSession, config: RunConfig, judgements: DataFrame | None = None, judge: Callable[[DataFrame], DataFrame] | None = None) -> dict[str, dict]:
    """Results of all metrics of a configuration; also in <output>/<metric>/result.json, with their records beside it. A restart takes them over.

    sia needs judgements (query_id, logprob of the target), or a judge that makes
    them of the bundle's items (`operators.judging`).
    """
    own, out = inputs(spark, config), {}
    with Scratch(spark) as scratch:
        data = scratch.dataset(config.data, list(config.metrics))
        for metric in config.metrics:
            out[metric] = _one(spark, config, metric, data, own, scratch, judgements, judge)
    return out


def _one(spark: SparkSession, config: RunConfig, metric: str, data: dataset.Dataset, own: Inputs, scratch: Scratch, judgements: DataFrame | None, judge: Callable[[DataFrame], DataFrame] | None) -> dict:
    spec, log, domains = METRICS[metric], Log(spark, joined(config.output, metric)), list(config.metrics[metric][1])
    plan = scratch.settled(planned(spec, data, config.tasks_of(metric), domains, list(config.candidate_tasks.get(metric, ()))), "plan")
    check_domains(plan, metric, domains)
    bound, saved = identity(plan, config, metric, own), log.snapshot()
    if "result" in saved.properties and saved.properties.get("identity") == bound:
        return saved.properties["result"]
    answers = predicted(spark, plan, config, metric, log, bound)
    judged, add = None, {}
    if spec.op == "subtask":
        if judgements is None and judge is None:
            raise ValueError(f"{metric} needs judgements of the answers")
        made = judgements if judgements is not None else judge(judgement_items(data, plan, answers))
        add[_save(log, made.select("query_id", F.col("logprob").cast("double").alias("logprob")), "judgements")] = {}
        judged = spark.read.schema(JUDGEMENTS).parquet(joined(log.root, *add))
    scored, items = joined_up(spec, data, plan, answers, judged)
    records = _save(log, spec.records(scored) if spec.records else spec.score(scored), "records")
    kept = spark.read.parquet(joined(log.root, records))
    result = {"protocol": results.PROTOCOLS.get(metric), **results.summary(spec.score(scored)), **(spec.figures(kept) if spec.figures else {})}
    add |= {records: {}, _save(log, stages(spec, plan, answers, kept, items, judged), "digests"): {}}
    if spec.excluded:
        left_out = _save(log, spec.excluded(data, config.tasks_of(metric), domains), "excluded")
        counts = spark.read.parquet(joined(log.root, left_out)).groupBy("reason").agg(F.count(F.lit(1)).alias("n")).orderBy("reason").collect()
        result["exclusions"] = {r["reason"]: r["n"] for r in counts}
        add[left_out] = {}
    old = [p for p in saved.files if not p.startswith("parts/")]
    log.update(lambda _: {"add": add, "remove": old, "set": {"result": result}})
    log.storage.replace_object(joined(log.root, "result.json"), {"metric": metric, "identity": bound, "result": result})
    return result


def records_of(spark: SparkSession, config: RunConfig, metric: str) -> DataFrame:
    """The records of a finished metric."""
    log = Log(spark, joined(config.output, metric))
    found = _read(spark, log, log.snapshot(), "records")
    if not found:
        raise ValueError(f"{metric} has no result yet")
    return found[0]


def saved_results(spark: SparkSession, config: RunConfig) -> dict[str, dict]:
    """The results of the finished metrics."""
    found = {m: Log(spark, joined(config.output, m)).snapshot().properties for m in config.metrics}
    return {m: p["result"] for m, p in found.items() if "result" in p}


def operations(spark: SparkSession, config: RunConfig) -> DataFrame:
    """metric and ANSWERS of all metrics of a run; an id in two metrics, or twice in one, is an error."""
    parts = []
    for metric in config.metrics:
        log = Log(spark, joined(config.output, metric))
        parts += [p.withColumn("metric", F.lit(metric)) for p in _read(spark, log, log.snapshot(), "parts")]
    if not parts:
        raise ValueError(f"{config.output} has no answers yet")
    return checked.union_parts(parts).select("metric", *(c.split()[0] for c in ANSWERS.split(", ")))


def curves(spark: SparkSession, config: RunConfig, metric: str) -> DataFrame:
    """domain, task, episode, score and values in order of the anchors, of a finished metric that asks for values."""
    spec, log = METRICS[metric], Log(spark, joined(config.output, metric))
    if spec.op != "value":
        raise ValueError(f"{metric} asks for no values")
    data = dataset.load(spark, config.data, list(config.metrics))
    plan, found = planned(spec, data, config.tasks_of(metric), list(config.metrics[metric][1]), list(config.candidate_tasks.get(metric, ()))), _read(spark, log, log.snapshot(), "parts")
    if not found:
        raise ValueError(f"{metric} has no answers yet")
    scored = plan.join(checked.union_parts(found).select("query_id", F.col("score").alias("v")), "query_id")
    order = "position" if "position" in plan.columns else "anchor"
    drawn = scored.groupBy(*results.EPISODE).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, "v"))), lambda x: x["v"]).alias("values"))
    return drawn.join(records_of(spark, config, metric).select(*results.EPISODE, "score"), results.EPISODE)


def inspect(spark: SparkSession, config: RunConfig, tolerance: float = 1e-9) -> dict[str, dict]:
    """For each metric: state (valid, incomplete, stale or wrong), n_planned, n_missing, reason, and where saved and recomputed differ.

    stale: the inputs named in reason have changed. wrong: the stage named in
    reason is the first that does not follow from those before it, or the saved
    means do not follow from the records.
    """
    own, out = inputs(spark, config), {}
    with Scratch(spark) as scratch:
        data = scratch.dataset(config.data, list(config.metrics))
        for metric in config.metrics:
            out[metric] = _inspected(spark, config, metric, data, own, scratch, tolerance)
    return out


def _inspected(spark: SparkSession, config: RunConfig, metric: str, data: dataset.Dataset, own: Inputs, scratch: Scratch, tolerance: float) -> dict:
    spec, log = METRICS[metric], Log(spark, joined(config.output, metric))
    plan, saved = scratch.settled(planned(spec, data, config.tasks_of(metric), list(config.metrics[metric][1]), list(config.candidate_tasks.get(metric, ()))), "plan"), log.snapshot()
    row: dict = {"state": "incomplete", "reason": None, "n_planned": plan.count(), "n_missing": None, "differences": []}
    if "identity" not in saved.properties:
        return row
    if parts := changed(saved.properties["identity"], identity(plan, config, metric, own)):
        return row | {"state": "stale", "reason": ", ".join(parts)}
    found = _read(spark, log, saved, "parts")
    if not found:
        return row
    answers = found[0]
    for part in found[1:]:
        answers = answers.unionByName(part)
    row["n_missing"] = checked.pending(plan.select("query_id"), answers).count()
    if row["n_missing"] or "result" not in saved.properties:
        return row
    try:
        judged = next(iter(_read(spark, log, saved, "judgements")), None)
        scored, items = joined_up(spec, data, plan, answers, judged)
        records = scratch.settled(spec.records(scored) if spec.records else spec.score(scored), "records")
        again = results.summary(spec.score(scored))
        apart = lineage.differences(_read(spark, log, saved, "digests")[0], stages(spec, plan, answers, records, items, judged), tolerance)
        apart = lineage.summary(apart).collect()  # a row per stage and kind
    except Exception as e:  # answers or judgements that no longer fit the plan
        return row | {"state": "wrong", "reason": f"stages cannot be computed: {str(e).splitlines()[0][:300]}"}
    if apart:
        return row | {"state": "wrong", "reason": apart[0]["stage"], "differences": [(r["stage"], r["difference"], r["n"], r["example"]) for r in apart]}
    flat = lambda r: {(d, t): s for d, own in r["domains"].items() for t, s in [("*", own["mean"]), *own["tasks"].items()]}
    old, new = flat(log.storage.read_object(joined(log.root, "result.json"))["result"]), flat(again)
    wrong = sorted(k for k in old.keys() | new.keys() if k not in old or k not in new or (old[k] is None) != (new[k] is None) or abs((old[k] or 0) - (new[k] or 0)) > tolerance)
    return row | ({"state": "wrong", "reason": "result", "differences": wrong} if wrong else {"state": "valid"})
