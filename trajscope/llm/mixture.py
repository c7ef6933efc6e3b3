"""Mixing sources to target weights along a curriculum, in DataFrame operations only.

Every source has a weight schedule over training time 0 to 1, piecewise linear.
Its integral is the source's weight, which sets its share of the budget (SHARE
times all sizes). A target stops at REPEATS times its source's size; what is left
over goes to the others by weight, until none is above.

The words of a source stand in a fixed order (by the md5 of doc_id), once for
each repeat. The schedule's integral up to time t, scaled to the target, is the
source's cumulative demand; inverting it gives each document the time at which
training reaches the middle of what is taken of it. Documents sorted by that time
(a range sort) are the curriculum. The document in which a source's demand ends
is taken as far as the demand reaches, so a source's taken words are its rounded
target.

Cumulative sizes come from three levels of sums (document, bucket of hashes,
bucket of buckets), so the rows of a hot source never meet in one task, whatever
its size: each window holds one bucket or RUN sums.

Defined cases: null text has no words; documents without words are taken with no
words and have no position; a null source is a source of its own, the last; a
null doc_id hashes as `-`; rows that repeat doc_id, source and size are counted
first and laid one after another; an empty table has no rows; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, sized, table
from .ranks import ranked

WORD = r"[^\x20\x09-\x0D]+"
SHARE = 1.5
REPEATS = 2
#: (time, weight) knots, dealt to sources in order, repeating; the integrals are 3, 1 and 2: one source fades, one peaks half-way, one grows.
SCHEDULES = (((0.0, 4.5), (1.0, 1.5)), ((0.0, 0.5), (0.5, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 3.0)))
#: Hex digits of a bucket, and of a bucket of buckets: sixteen to the power of (5 - 2, 2) sums to a window at most.
FINE, COARSE = 5, 2
#: Repeats of one row that a task lays out at a time.
LAID = 4096


def integral(schedule) -> float:
    return sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]))


def _pieces(schedule) -> Column:
    """array<struct<t, w, m, c>>: where a piece begins, its weight there, its slope, and the integral before it."""
    out, before = [], 0.0
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]):
        out.append(F.struct(*(F.lit(x).alias(k) for k, x in (("t", t0), ("w", w0), ("m", (w1 - w0) / (t1 - t0)), ("c", before)))))
        before += (t1 - t0) * (w0 + w1) / 2
    return F.array(*out)


def _of_rank(values) -> Column:
    return F.element_at(F.array(*values), (F.col("pos") % len(values)).cast("int") + 1)


def time_of(pieces: Column, area: Column) -> Column:
    """When the integral of the schedule reaches `area`."""
    piece = F.element_at(F.filter(pieces, lambda p: (p["c"] <= area) | (p["t"] == 0.0)), -1)
    rest = F.greatest(area - piece["c"], F.lit(0.0))
    root = piece["w"] + F.sqrt(F.greatest(piece["w"] * piece["w"] + 2 * piece["m"] * rest, F.lit(0.0)))
    return F.least(piece["t"] + F.when(rest > 0, 2 * rest / root).otherwise(0.0), F.lit(1.0))


def _water_fill(sources: DataFrame, share: float, repeats: int) -> tuple[float, float] | None:
    """The level of targets by weight, as numerator and denominator; a round for each time that some source turns out full."""
    total = sources.agg(F.sum("source_size")).first()[0]
    if total is None:
        return None
    level = None
    while True:
        full = F.lit(False) if level is None else _full(level, repeats)
        held, weight = sources.agg(F.sum(F.when(full, F.col("source_size")).otherwise(0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        now = (share * total - repeats * held, weight)
        if now == level or not weight:
            return level or now
        level = now


def _full(level: tuple[float, float], repeats: int) -> Column:
    return F.lit(level[0]) * F.col("weight") > F.lit(float(repeats)) * F.col("source_size") * F.lit(level[1])


def targets(sizes: DataFrame, schedules=SCHEDULES, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """source_, source_size, target and pieces of (source_, source_size): a row for each source."""
    placed, _ = ranked(sizes.withColumn("all_", F.lit(0)), "all_", [F.col("source_")], "sources")
    placed = materialize(placed.withColumn("weight", _of_rank([F.lit(integral(s)) for s in schedules])), "sources")
    level = _water_fill(placed, share, repeats)
    if level is None:
        return placed.select("source_", "source_size", F.lit(0.0).alias("target"), F.lit(0.0).alias("weight"), _pieces(schedules[0]).alias("pieces"))
    open_ = F.lit(level[0]) * F.col("weight") / F.lit(level[1]) if level[1] else F.lit(0.0)
    target = F.when(_full(level, repeats), F.lit(float(repeats)) * F.col("source_size")).otherwise(open_)
    return placed.select("source_", "source_size", target.alias("target"), "weight", _of_rank([_pieces(s) for s in schedules]).alias("pieces"))


def mix(docs: DataFrame, schedules=SCHEDULES, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """A row for each row of docs: doc_id, source, size, source_size, target, taken, and takes, an array of (position, words) of the repeats that are taken."""
    # sources sort by code point, null last
    source = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("~"))
    own = docs.select("doc_id", source.alias("source_"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    units = own.groupBy("doc_id", "source_", "size").agg(F.count(F.lit(1)).alias("rows_"))
    units = units.withColumn("hash_", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")).cast("binary"))).withColumn("fine_", F.substring("hash_", 1, FINE))
    units = materialize(units, "units")
    coarse = F.substring("fine_", 1, COARSE)
    fine = materialize(units.groupBy("source_", "fine_").agg(F.sum(F.col("rows_") * F.col("size")).alias("words_")), "buckets")
    tops = fine.groupBy("source_", coarse.alias("coarse_")).agg(F.sum("words_").alias("words_"))
    before = lambda *by: F.coalesce(F.sum("words_").over(Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tops = tops.select("source_", "coarse_", before("source_", "coarse_").alias("top_"))
    fine = fine.withColumn("coarse_", coarse).withColumn("in_", before("source_", "coarse_", "fine_"))
    fine = fine.join(sized(tops), ["source_", "coarse_"]).select("source_", "fine_", (F.col("top_") + F.col("in_")).alias("before_"))
    plan = targets(units.groupBy("source_").agg(F.sum(F.col("rows_") * F.col("size")).alias("source_size")), schedules, share, repeats)
    order = Window.partitionBy("source_", "fine_").orderBy("hash_", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = units.withColumn("start_", F.coalesce(F.sum(F.col("rows_") * F.col("size")).over(order), F.lit(0)))
    rows = rows.join(fine, ["source_", "fine_"]).withColumn("start_", F.col("start_") + F.col("before_"))
    rows = rows.join(sized(plan.drop("pieces", "weight")), "source_")
    # equal rows are laid out one after another, LAID at a time
    lots = F.transform(F.sequence(F.lit(0), ((F.col("rows_") - 1) / LAID).cast("long")), lambda k: k * LAID)
    many = rows.where(F.col("rows_") > LAID).withColumn("lot_", F.explode(lots)).repartition("source_", "hash_", "lot_")
    laid = rows.where(F.col("rows_") <= LAID).withColumn("lot_", F.lit(0).cast("long")).unionByName(many)
    row = F.explode(F.sequence(F.col("lot_"), F.least(F.col("lot_") + LAID, F.col("rows_")) - 1))
    laid = laid.withColumn("row_", row).withColumn("start_", F.col("start_") + F.col("row_") * F.col("size"))
    words = lambda k: F.greatest(F.lit(0), F.least(F.col("size"), F.rint("target").cast("long") - F.col("start_") - k * F.col("source_size")))
    takes = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(repeats - 1).cast("long")), lambda k: F.struct((F.col("start_") + k * F.col("source_size") + words(k) / 2).alias("at"), words(k).alias("words")))
    laid = laid.withColumn("takes_", F.filter(takes, lambda x: x["words"] > 0)).drop("rows_", "fine_", "before_", "lot_")
    pieces = sized(plan.select("source_", "weight", "pieces"))
    laid = laid.join(pieces, "source_")
    timed = F.transform("takes_", lambda x: F.struct(time_of(F.col("pieces"), x["at"] / F.col("target") * F.col("weight")).alias("position"), x["words"].alias("words")))
    name = F.when(F.col("source_") != "~", F.substring("source_", 2, 2**31 - 1))
    taken = F.aggregate("takes_", F.lit(0).cast("long"), lambda a, x: a + x["words"])
    return laid.select("doc_id", name.alias("source"), "size", "source_size", "target", taken.alias("taken"), timed.alias("takes"), F.col("hash_").alias("order_"), "row_")


def curriculum(mixed: DataFrame) -> DataFrame:
    """doc_id, source, position and words of every take, sorted by position: what training reads, in its order."""
    takes = mixed.select("doc_id", "source", "order_", "row_", F.explode("takes").alias("take")).select("doc_id", "source", "take.position", "take.words", "order_", "row_")
    return takes.orderBy("position", "order_", "row_").drop("order_", "row_")


def op12_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    position = F.round(F.try_element_at("takes", F.lit(1))["position"], 9)
    out = mixed.withColumn("position", position).withColumn("n_takes", F.size("takes").cast("long"))
    return out.orderBy(F.asc_nulls_last("position"), "order_", "row_").select("doc_id", "size", "source_size", "target", "taken", "n_takes", "position")


def _sql() -> str:
    n = len(SCHEDULES)
    piece = []
    for r, s in enumerate(SCHEDULES):
        before = 0.0
        for (t0, w0), (t1, w1) in zip(s, s[1:]):
            piece.append(f"({r}, {t0}::DOUBLE, {w0}::DOUBLE, {(w1 - w0) / (t1 - t0)}::DOUBLE, {before}::DOUBLE)")
            before += (t1 - t0) * (w0 + w1) / 2
    weights = " ".join(f"WHEN {r} THEN {integral(s)}::DOUBLE" for r, s in enumerate(SCHEDULES))
    return f"""
WITH d AS (SELECT doc_id, coalesce('=' || source, '~') AS s, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
v AS (SELECT s, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY s) - 1) % {n} AS k, CASE k {weights} END AS w FROM d GROUP BY s),
p AS (SELECT *, row_number() OVER (ORDER BY source_size / w, s) AS i, {SHARE} * sum(source_size) OVER () AS budget, coalesce(sum(source_size) OVER b, 0) AS held, sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS rest
  FROM v WINDOW b AS (ORDER BY source_size / w, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
q AS (SELECT min(i) AS i FROM p WHERE (budget - {REPEATS} * held) * w <= {REPEATS} * source_size * rest),
t AS (SELECT p.s, p.k, p.w, p.source_size, CASE WHEN p.i < q.i THEN {REPEATS}::DOUBLE * p.source_size ELSE (o.budget - {REPEATS} * o.held)::DOUBLE * p.w / o.rest END AS target FROM p, q JOIN p o ON o.i = q.i),
x AS (SELECT doc_id, d.s, k, w, size, source_size, target, sum(size) OVER (PARTITION BY d.s ORDER BY md5(coalesce(doc_id::VARCHAR, '-')), doc_id, size ROWS UNBOUNDED PRECEDING) - size AS lo FROM d JOIN t USING (s)),
y AS (SELECT *, greatest(0, least(size, round_even(target, 0)::BIGINT - lo)) AS taken1, greatest(0, least(size, round_even(target, 0)::BIGINT - lo - source_size)) AS taken2 FROM x),
z AS (SELECT *, CASE WHEN taken1 > 0 THEN (lo + taken1 / 2) / target * w END AS area FROM y),
g(k, t, m0, m, c) AS (VALUES {", ".join(piece)}),
u AS (SELECT z.*, (SELECT max(c) FROM g WHERE g.k = z.k AND (c <= area OR t = 0)) AS c FROM z)
SELECT doc_id, size, source_size, target, (taken1 + taken2)::BIGINT AS taken, (CASE WHEN taken1 > 0 THEN 1 ELSE 0 END + CASE WHEN taken2 > 0 THEN 1 ELSE 0 END)::BIGINT AS n_takes,
  round(CASE WHEN taken1 > 0 THEN least(1.0::DOUBLE, g.t + CASE WHEN area > u.c THEN 2 * (area - u.c) / (m0 + sqrt(greatest(m0 * m0 + 2 * m * (area - u.c), 0))) ELSE 0 END) END, 9) AS position
FROM u LEFT JOIN g ON g.k = u.k AND g.c = u.c
"""


OP12_SQL = _sql()
