"""Grouped statistics: macro means, rank correlation, percentiles, bootstrap."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def macro_mean(scores: DataFrame, value: str = "score", domain: str = "domain", task: str = "task", extra: Sequence[str] = ()) -> DataFrame:
    """Unweighted means in three steps, in long form: level, domain, task, score.

    Rows -> (domain, task) -> domain -> overall; each later step sees only the
    few rows of the one before, so one shuffle carries data.
    """
    keys = list(extra)
    tasks = scores.groupBy(*keys, domain, task).agg(F.avg(value).alias("score"))
    domains = tasks.groupBy(*keys, domain).agg(F.avg("score").alias("score"))
    overall = domains.groupBy(*keys).agg(F.avg("score").alias("score"))
    row = lambda level, d, t: [F.lit(level).alias("level"), *keys, d.alias("domain"), t.alias("task"), "score"]
    everything = F.lit("*")
    return (
        tasks.select(*row("task", F.col(domain), F.col(task).cast("string")))
        .unionByName(domains.select(*row("domain", F.col(domain), everything)))
        .unionByName(overall.select(*row("overall", everything, everything)))
    )


def average_rank(value: str, keys: Sequence[str]) -> Column:
    """Ranks from 1 on; ties share their mean rank."""
    own = Window.partitionBy(*keys)
    return F.rank().over(own.orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, value)) - 1) / F.lit(2.0)


def spearman(rows: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """keys, n, rho: Pearson's correlation of average ranks; null if x or y is constant. -0.0 equals 0.0."""
    ranked = rows.withColumn("x_", F.col(x).cast("double") + F.lit(0.0)).withColumn("y_", F.col(y).cast("double") + F.lit(0.0))
    ranked = ranked.withColumn("rx", average_rank("x_", keys)).withColumn("ry", average_rank("y_", keys))
    s = ranked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum("rx").alias("sx"), F.sum("ry").alias("sy"), F.sum(F.col("rx") * F.col("ry")).alias("sxy"), F.sum(F.col("rx") * F.col("rx")).alias("sxx"), F.sum(F.col("ry") * F.col("ry")).alias("syy")
    )
    n = F.col("n")
    root = F.sqrt((n * F.col("sxx") - F.col("sx") * F.col("sx")) * (n * F.col("syy") - F.col("sy") * F.col("sy")))
    return s.select(*keys, "n", F.try_divide(n * F.col("sxy") - F.col("sx") * F.col("sy"), root).alias("rho"))


#: Bins of a cell's values; a bin holds about so many-th of its different values.
WIN_BINS = 64


def pairwise_wins(rows: DataFrame, keys: Sequence[str], value: str, winner: str) -> DataFrame:
    """keys, wins, n_winners, n_losers, score: share of (winner, loser) pairs where the winner is strictly above.

    Equal values are counted first, so ties are a row. Running counts of losers
    take the place of a join of all pairs, in two levels, so that no task sorts
    a whole cell: bins between quantiles of a sketch, which outliers do not widen, and the values within a bin.
    """
    keys = list(keys)
    loser = F.when(F.col(winner), 0).otherwise(1)
    counted = rows.select(*keys, F.col(value).cast("double").alias("v_"), loser.alias("l_")).groupBy(*keys, "v_").agg(F.sum("l_").alias("losers_"), F.sum(1 - F.col("l_")).alias("winners_"))
    cuts = counted.groupBy(*keys).agg(F.array_distinct(F.percentile_approx("v_", [k / WIN_BINS for k in range(1, WIN_BINS)], 1000)).alias("cuts_"))
    binned = counted.join(cuts, keys).withColumn("bin_", F.size(F.filter("cuts_", lambda c: c < F.col("v_")))).drop("cuts_")
    below = lambda w: F.coalesce(F.sum("losers_").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = binned.withColumn("below_", below(Window.partitionBy(*keys, "bin_").orderBy("v_")))
    # of a bin: losers, winners, wins within it
    bins = within.groupBy(*keys, "bin_").agg(F.sum("losers_").alias("losers_"), F.sum("winners_").alias("winners_"), F.sum(F.col("winners_") * F.col("below_")).alias("wins_"))
    bins = bins.withColumn("lower_", below(Window.partitionBy(*keys).orderBy("bin_")))
    out = bins.groupBy(*keys).agg(F.sum(F.col("wins_") + F.col("winners_") * F.col("lower_")).alias("wins"), F.sum("winners_").alias("n_winners"), F.sum("losers_").alias("n_losers"))
    return out.withColumn("score", F.try_divide(F.col("wins").cast("double"), (F.col("n_winners") * F.col("n_losers")).cast("double")))


def nearest_rank(value: str, q: float) -> Column:
    """sorted[max(0, ceil(q * n) - 1)]."""
    return F.expr(f"percentile_disc({q}) within group (order by {value})")


def draw(n: Column, *parts: Column) -> Column:
    """A whole number below n by a hash of the parts: the same on every run, every executor and in any engine with MD5."""
    word = F.conv(F.substring(F.md5(F.concat_ws(":", *(p.cast("string") for p in parts))), 1, 8), 16, 10).cast("long")
    return F.pmod(word, n.cast("long"))


def resamples(rows: DataFrame, keys: Sequence[str], order: str, times: int, seed: int = 42) -> DataFrame:
    """keys, replicate, and the rows (by `order`) drawn with replacement, as many as there are distinct values of `order`.

    Draws are rows of a table, `times` for each value; a draw is joined to the
    rows of the value that it hits.
    """
    keys = list(keys)
    places = rows.select(*keys, order).distinct().withColumn("place", (F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1).cast("long"))
    sizes = places.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_"))
    draws = sizes.select("*", F.explode(F.sequence(F.lit(0), F.lit(times - 1))).alias("replicate")).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_") - 1)).alias("i_"))
    drawn = draws.withColumn("place", draw(F.col("n_"), F.lit(seed), *(F.col(k) for k in keys), F.col("replicate"), F.col("i_")))
    return drawn.join(places, [*keys, "place"]).join(rows, [*keys, order]).drop("n_", "place")


#: Places whose draws are counted together, draws that a row asks for, and replicates counted at a time.
BLOCK = 4096
DRAWS = 1 << 16
REPLICATES = 128


def _drawn(key: str, seed: int):
    """(key, replicate, block, hits): the places that `draw` gives to the numbers from lo on, dealt into blocks; hits are two bytes a draw."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for own, n, replicate, lo in frame[[key, "n_", "replicate", "lo"]].itertuples(index=False):
                head = hashlib.md5(f"{seed}:{own}:{replicate}:".encode())
                words = []
                for i in range(lo, min(n, lo + DRAWS)):
                    word = head.copy()
                    word.update(b"%d" % i)
                    words.append(word.digest()[:4])
                place = np.sort(np.frombuffer(b"".join(words), ">u4").astype(np.int64) % n)
                block, first = np.unique(place // BLOCK, return_index=True)
                hits = [x.astype("<u2").tobytes() for x in np.split(place % BLOCK, first[1:])]
                yield pd.DataFrame({key: [own] * len(block), "replicate": replicate, "block": block, "hits": hits})

    return run


def _weights(drawn: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Some replicates at a time, and how often each drew each place of the block."""
    ids, at = np.unique(drawn["replicate"].to_numpy(), return_inverse=True)
    hits = drawn["hits"].to_numpy()
    for a in range(0, len(ids), REPLICATES):
        w = np.zeros((len(ids[a : a + REPLICATES]), BLOCK), np.int64)
        for k in np.flatnonzero((at >= a) & (at < a + REPLICATES)):
            w[at[k] - a] += np.bincount(np.frombuffer(hits[k], "<u2"), minlength=BLOCK)
        yield ids[a : a + REPLICATES], w


def _runs(rows: pd.DataFrame, columns: list[str]) -> np.ndarray:
    """Where rows, sorted by the columns, change in one of them."""
    new = np.zeros(len(rows), dtype=bool)
    new[:1] = True
    for c in columns:
        x = rows[c].to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def _bin_sums(key: str, group: str):
    """(key, replicate, group, bin, n, s, ss) of a block: drawn values in each bin, their sum and sum of squares."""

    def run(drawn: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame(columns=[key, "replicate", group, "bin", "n", "s", "ss"])]
        if len(drawn) and len(rows):
            rows = rows.sort_values([group, "bin"])
            first, offset, value = _runs(rows, [group, "bin"]), rows["place"].to_numpy() % BLOCK, rows["v"].to_numpy()
            of = rows.iloc[first]
            for ids, w in _weights(drawn):
                w = w[:, offset]
                n, s, ss = (np.add.reduceat(x, first, axis=1) for x in (w, w * value, w * (value * value)))
                r, b = np.nonzero(n)
                out.append(pd.DataFrame({key: drawn[key].iloc[0], "replicate": ids[r], group: of[group].to_numpy()[b], "bin": of["bin"].to_numpy()[b], "n": n[r, b], "s": s[r, b], "ss": ss[r, b]}))
        return pd.concat(out[1:] or out)

    return run


def _bin_values(key: str, group: str):
    """(key, replicate, group, bin, v, n) of a block: how often each value of a replicate's wanted bins is drawn. Rows with a replicate name such a bin, the others are values."""

    def run(drawn: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame(columns=[key, "replicate", group, "bin", "v", "n"])]
        asks = rows["replicate"].notna()
        wanted, rows = rows[asks], rows[~asks]
        if len(drawn) and len(rows) and len(wanted):
            rows = rows.sort_values([group, "bin", "v"])
            first, offset = _runs(rows, [group, "bin", "v"]), rows["place"].to_numpy(np.int64) % BLOCK
            of = rows.iloc[first]
            # the values of each bin: from which run, to which
            spans = {gb: (at[0], at[-1] + 1) for gb, at in of.reset_index(drop=True).groupby([group, "bin"]).indices.items()}
            starts, values = np.append(first, len(rows)), of["v"].to_numpy()
            for ids, w in _weights(drawn):
                for gb, some in wanted[wanted["replicate"].isin(ids)].groupby([group, "bin"]):
                    if gb not in spans:
                        continue
                    a, z = spans[gb]
                    at = np.searchsorted(ids, some["replicate"].to_numpy(np.int64))
                    n = np.add.reduceat(w[np.ix_(at, offset[starts[a] : starts[z]])], first[a:z] - first[a], axis=1)
                    r, k = np.nonzero(n)
                    out.append(pd.DataFrame({key: drawn[key].iloc[0], "replicate": ids[at][r], group: gb[0], "bin": gb[1], "v": values[a:z][k], "n": n[r, k]}))
        return pd.concat(out[1:] or out)

    return run


def resampled_medians(rows: DataFrame, key: str, order: str, group: str, value: str, times: int, seed: int = 42) -> DataFrame:
    """key, replicate, group, n, s, ss, c: number, sum, sum of squares and median of the values of each group in each replicate of `resamples`.

    key and group are one column each; rows with a null group count as places only.
    The draws are counted where they are made, by blocks of places, and meet the
    values of their block; neither is a row per draw and value. Medians are found
    in two steps: the bin between quantiles that holds the middle, and then the
    values of that bin, so no task holds a replicate. Key and group are strings and whole numbers.
    """
    kind = dict(rows.dtypes)
    places = rows.select(key, order).distinct().withColumn("place", (F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1).cast("long"))
    sizes = rows.select(key, order).distinct().groupBy(key).agg(F.count(F.lit(1)).alias("n_"))
    asked = sizes.where(F.col(key).isNotNull()).select("*", F.explode(F.sequence(F.lit(0), F.lit(times - 1))).alias("replicate")).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_") - 1, F.lit(DRAWS).cast("long"))).alias("lo"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    drawn = asked.repartition(parts, key, "replicate", "lo").mapInPandas(_drawn(key, seed), f"{key} {kind[key]}, replicate int, block long, hits binary")
    # both uses take the same columns, so that the draws are made and shuffled once
    drawn = drawn.repartition(parts, key, "block")
    some = rows.where(F.col(group).isNotNull() & F.col(value).isNotNull()).select(key, order, group, F.col(value).cast("double").alias("v"))
    cuts = some.groupBy(key, group).agg(F.array_distinct(F.percentile_approx("v", [k / WIN_BINS for k in range(1, WIN_BINS)], 1000)).alias("cuts_"))
    values = some.join(cuts, [key, group]).withColumn("bin", F.size(F.filter("cuts_", lambda c: c < F.col("v")))).join(places, [key, order])
    values = values.select(key, F.floor(F.col("place") / BLOCK).cast("long").alias("block"), "place", group, "bin", "v")
    by = lambda df: df.groupBy(key, "block")
    cell = [key, "replicate", group]
    sums = by(drawn).cogroup(by(values)).applyInPandas(_bin_sums(key, group), f"{key} {kind[key]}, replicate int, {group} {kind[group]}, bin int, n long, s double, ss double")
    sums = sums.groupBy(*cell, "bin").agg(*(F.sum(c).alias(c) for c in ("n", "s", "ss")))
    # both middle places, from 0, and the bins they lie in
    own = Window.partitionBy(*cell)
    upto = F.sum("n").over(own.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    bins = sums.withColumn("before", upto - F.col("n")).withColumn("total", F.sum("n").over(own))
    bins = bins.withColumn("low_", F.floor((F.col("total") - 1) / 2)).withColumn("high_", F.floor(F.col("total") / 2))
    within = lambda x: (F.col("before") <= F.col(x)) & (F.col(x) < F.col("before") + F.col("n"))
    middle = bins.where(within("low_") | within("high_")).select(*cell, "bin", "before", "low_", "high_")
    blocks = sizes.select(key, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_") - 1) / BLOCK))).alias("block"))
    none = lambda kind: F.lit(None).cast(kind)
    wanted = middle.join(blocks, key).select(key, "block", none("long").alias("place"), group, "bin", none("double").alias("v"), "replicate")
    both = values.withColumn("replicate", none("int")).unionByName(wanted)
    found = by(drawn).cogroup(by(both)).applyInPandas(_bin_values(key, group), f"{key} {kind[key]}, replicate int, {group} {kind[group]}, bin int, v double, n long")
    found = found.groupBy(*cell, "bin", "v").agg(F.sum("n").alias("n")).join(middle, [*cell, "bin"])
    upto = F.sum("n").over(Window.partitionBy(*cell, "bin").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    found = found.withColumn("before", F.col("before") + upto - F.col("n"))
    ends = found.groupBy(*cell).agg(F.max(F.when(within("low_"), F.col("v"))).alias("a_"), F.max(F.when(within("high_"), F.col("v"))).alias("b_"))
    centers = ends.select(*cell, (F.col("a_") + (F.col("b_") - F.col("a_")) * 0.5).alias("c"))
    return sums.groupBy(*cell).agg(*(F.sum(c).alias(c) for c in ("n", "s", "ss"))).join(centers, cell)


def interval(scores: DataFrame, keys: Sequence[str], value: str = "score") -> DataFrame:
    """keys, n_valid, low, high: 2.5 and 97.5 per cent of the replicates that have a score."""
    some = scores.where(F.col(value).isNotNull())
    return some.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_valid"), F.percentile(value, F.lit(0.025)).alias("low"), F.percentile(value, F.lit(0.975)).alias("high"))


def mean_or_raise(value: str, what: str) -> Column:
    """Mean of a column; an error where there is no value."""
    return F.when(F.count(value) > 0, F.avg(value)).otherwise(F.raise_error(F.lit(f"no values for {what}")))


def task_means(scores: DataFrame, value: str = "score") -> DataFrame:
    """task, score: unweighted means of a task's domains."""
    cells = scores.groupBy("task", "domain").agg(F.avg(value).alias("score"))
    return cells.groupBy("task").agg(F.avg("score").alias("score"))
