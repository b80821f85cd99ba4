"""Mixing sources to target weights.

Sizes are summed by source, a water-filling of the word budget gives each source its target, and
each document is emitted floor(rate) times plus once more on a hash-seeded coin whose probability
is the fraction of the rate (rate = target / size of the source).

The coin of a document is the first 52 bits of the MD5 of its id, turned by a phase of 1/16
steps that belongs to the source. Every phase is a fair coin; the one whose total falls nearest the target is
taken, so sources of few or very uneven documents come near their targets too.

Defined results: null text or no words: size 0, and such rows share their source's rate; null
source: a source of its own, ordered last; null doc_id: coin of the empty string; repeated rows:
each row is a document, with the same coin; a source without words: rate 0; an empty table: no
rows. emit_copies returns the columns of its input as they came; mix_sources replaces those that bear the names of
the added ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, stash, table

NAME = "op1_mixing"
PHASES = 16


def with_size(docs: DataFrame) -> DataFrame:
    """Adds size, the words of the text."""
    return docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))


def coin(phase: Column | int = 0) -> Column:
    """Uniform in [0, 1), from doc_id alone, turned by phase steps."""
    bits = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 13), 16, 10)
    turned = bits.cast("double") / F.lit(2.0**52) + F.lit(phase) / F.lit(float(PHASES))
    return turned - F.floor(turned)


def source_targets(sized: DataFrame, share: float = 1.5, cap: float = 2.0, weights: Sequence[int] = (3, 1, 2)) -> DataFrame:
    """source, source_size, target: one row per source.

    Sources ordered by size limit per weight are capped while the level of the water is above
    theirs; the rest share what is left by weight. The windows run over sources, not rows.
    """
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    by = by.withColumn("_weight", F.element_at(cycle, (((F.row_number().over(order) - 1) % len(weights)) + 1).cast("int")))
    by = by.withColumn("_limit", F.col("source_size") * cap)
    fill = Window.orderBy(F.col("_limit") / F.col("_weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    by = by.withColumns({
        "_budget": F.sum("source_size").over(everything) * share,
        "_filled": F.coalesce(F.sum("_limit").over(fill), F.lit(0.0)),
        "_open": F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(fill), F.lit(0.0)),
    })
    by = by.withColumn("_capped", (F.col("_budget") - F.col("_filled")) * F.col("_weight") > F.col("_limit") * F.col("_open"))
    by = by.withColumns({
        "_taken": F.sum(F.when(F.col("_capped"), F.col("_limit")).otherwise(0.0)).over(everything),
        "_left": F.sum(F.when(F.col("_capped"), 0.0).otherwise(F.col("_weight"))).over(everything),
    })
    free = (F.col("_budget") - F.col("_taken")) * F.col("_weight") / F.nullif(F.col("_left"), F.lit(0.0))
    return by.select("source", "source_size", F.when(F.col("_capped"), F.col("_limit")).otherwise(free).alias("target"))


def _joined(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows beside their source's row; null sources meet. The join side is left to the measured size."""
    plan = plan.select(F.col("source").alias("_source"), *[c for c in plan.columns if c != "source"])
    return sized.join(plan, sized["source"].eqNullSafe(plan["_source"])).drop("_source")


def _rate() -> Column:
    return F.coalesce(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0))


def _copies() -> Column:
    """How often a row beside its source's plan is taken."""
    turned = coin(0) + F.col("phase") / F.lit(float(PHASES))
    return (F.floor(_rate()) + F.when(turned - F.floor(turned) < _rate() - F.floor(_rate()), 1).otherwise(0)).cast("long")


def mixing_plan(sized: DataFrame, **limits) -> DataFrame:
    """source, source_size, target, phase: one row per source."""
    targets = source_targets(sized.select("doc_id", "source", "size"), **limits)
    rows = _joined(sized.select("doc_id", "source", "size"), targets)
    extra = _rate() - F.floor(_rate())
    sums = rows.groupBy("source", "source_size", "target").agg(
        *[F.sum(F.when(coin(k) < extra, F.col("size")).otherwise(0)).alias(f"_s{k}") for k in range(PHASES)]
    )
    away = [F.abs(F.floor(_rate()) * F.col("source_size") + F.col(f"_s{k}") - F.col("target")) for k in range(PHASES)]
    best = F.array_min(F.array(*[F.struct(a.alias("a"), F.lit(k).alias("k")) for k, a in enumerate(away)]))
    return sums.select("source", "source_size", "target", best["k"].alias("phase"))


def mix_sources(docs: DataFrame, sized: DataFrame | None = None, **limits) -> DataFrame:
    """docs with size, source_size, target, copies and taken = size * copies.

    sized: docs with size, where that is already at hand.
    """
    sized = with_size(docs) if sized is None else sized
    sized = sized.drop("source_size", "target", "phase", "copies", "taken")
    rows = _joined(sized, mixing_plan(sized, **limits))
    return rows.withColumn("copies", _copies()).withColumn("taken", F.col("size") * F.col("copies")).drop("phase")


def emit_copies(docs: DataFrame, **limits) -> DataFrame:
    """The mix itself: the columns of docs as they came, whatever their names, each row as often as it is taken.

    Sizes are counted once, and the plan, a row for each source, is a written table, so Spark knows its size when it
    joins: texts stay where they are as long as the plan is small enough to be broadcast.
    """
    sized = stash(with_size(docs.select("doc_id", "source", "text")).drop("text"), "mixing")
    plan = stash(mixing_plan(sized, **limits), "mixing-plan")
    rows = _joined(docs.select(F.struct(*docs.columns).alias("whole"), "doc_id", "source"), plan).withColumn("copies", _copies())
    return rows.where("copies > 0").select("whole", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("whole.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: one narrow pass over the texts gives the sizes; all else runs on (doc_id, source, size)."""
    docs = table(spark, sf_dir, "documents")
    sized = stash(with_size(docs.select("doc_id", "source", "text")).drop("text"), "mixing")
    return mix_sources(sized, sized).select("doc_id", "size", "source_size", "target", "taken", "copies")


#: The coin of DuckDB: the same 52 bits of MD5.
SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u
  FROM documents),
by_source AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w,
    source_size * 2.0::DOUBLE AS lim
  FROM by_source),
filled AS (
  SELECT *, sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE AS budget,
    coalesce(sum(lim) OVER f, 0.0::DOUBLE) AS before_lim,
    sum(w) OVER () - coalesce(sum(w) OVER f, 0.0::DOUBLE) AS open_w
  FROM weighed
  WINDOW f AS (ORDER BY lim / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
capped AS (SELECT *, (budget - before_lim) * w > lim * open_w AS cap FROM filled),
targets AS (
  SELECT source, source_size,
    CASE WHEN cap THEN lim ELSE (budget - sum(CASE WHEN cap THEN lim ELSE 0.0::DOUBLE END) OVER ()) * w
      / nullif(sum(CASE WHEN cap THEN 0.0::DOUBLE ELSE w END) OVER (), 0) END AS target
  FROM capped),
rated AS (
  SELECT s.*, t.source_size, t.target, coalesce(t.target / nullif(t.source_size, 0), 0.0)::DOUBLE AS rate
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
phases AS (
  SELECT source, k, abs(any_value(floor(rate)) * any_value(source_size) + sum(
    CASE WHEN (u + k / 16.0::DOUBLE) - floor(u + k / 16.0::DOUBLE) < rate - floor(rate) THEN size ELSE 0 END) - any_value(target)) AS away
  FROM rated, range(16) r(k) GROUP BY source, k),
best AS (SELECT source, arg_min(k, (away, k)) AS k FROM phases GROUP BY source),
copied AS (
  SELECT r.*, (floor(rate) + CASE WHEN (u + b.k / 16.0::DOUBLE) - floor(u + b.k / 16.0::DOUBLE) < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS copies
  FROM rated r JOIN best b ON r.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, size * copies AS taken, copies FROM copied
"""
