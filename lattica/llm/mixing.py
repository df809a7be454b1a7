"""Mixing sources to target weights, in DataFrame operations alone.

Words are counted once per document and summed per source. Sources share all words by weight; no target exceeds
``most`` times its source, and what a capped source leaves over is shared anew by weight. The
fixed point of that resharing is found directly: in the order of cap over weight a prefix of the sources is
capped, and the level of the others follows from running sums. A document is then taken floor(rate) times and once
more with the fraction as probability, drawn from a hash of its id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.common import WORD, cut, unused

#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (5, 2, 1)
SEED = "mix-1"
#: Sources up to which their table, a few numbers each, is sent to every executor.
MOST_BROADCAST = 100_000


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """(source, source_size, target) from sources(source, source_size), one row per source.

    Sources rank by code point, null last. Sources without words get target 0.
    """
    order = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (order % len(weights) + 1).cast("int"))
    s = sources.withColumn("w", weight).withColumn("cap", (F.col("source_size") * most).cast("double")).withColumn("r", F.col("cap") / F.col("w"))
    everything = Window.partitionBy()
    upto = Window.orderBy("r", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = s.withColumn("total", F.sum(F.col("source_size").cast("double")).over(everything)).withColumn("all_w", F.sum("w").over(everything))
    # the level if this source and those before it in the order were capped; the source is capped if the level without it exceeds its own r
    s = s.withColumn("cap_before", F.sum("cap").over(upto) - F.col("cap")).withColumn("w_before", F.sum("w").over(upto) - F.col("w"))
    s = s.withColumn("level", (F.col("total") - F.col("cap_before")) / (F.col("all_w") - F.col("w_before")))
    s = s.withColumn("capped", F.col("level") > F.col("r"))
    s = s.withColumn("final", F.min(F.when(~F.col("capped"), F.struct("r", F.col("source").isNull().alias("n"), "source", "level"))).over(everything)["level"])
    return s.select("source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("final") * F.col("w")).alias("target"))


def uniform(key: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from the MD5 of seed and key; the same on every run and engine."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3, seed: str = SEED) -> DataFrame:
    """docs plus ``size``, ``source_size``, ``target`` and ``copies``: how often the mix takes the document.

    Null texts have no words, a text of any length is counted whole, null sources are one source of their own (the last), repeated rows are drawn alike. An
    empty table gives an empty one. Columns of those four names in ``docs`` are replaced.
    """
    kept = [c for c in docs.columns if c not in ("size", "source_size", "target", "copies")]
    source, rate_ = unused([*docs.columns, *kept], "_source", "_rate")
    sized = docs.select(*kept, word_count(F.col("text")).alias("size"))
    sources = cut(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)).withColumnRenamed("source", source)
    if sources.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:  # else Spark joins by source and splits large ones
        sources = F.broadcast(sources)
    rate = F.coalesce(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0))
    joined = sized.join(sources, F.col("source").eqNullSafe(F.col(source))).drop(source).withColumn(rate_, rate)
    copies = F.floor(rate_) + F.when(uniform(F.col("doc_id"), seed) < F.col(rate_) - F.floor(rate_), 1).otherwise(0)
    return joined.withColumn("copies", copies.cast("long")).drop(rate_)


def emit(mixed: DataFrame) -> DataFrame:
    """Each row of a mix as often as it is taken."""
    (copy,) = unused(mixed.columns, "_copy")
    return mixed.where("copies > 0").withColumn(copy, F.explode(F.sequence(F.lit(1), F.col("copies")))).drop(copy)


MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
src AS (SELECT source, sum(size)::DOUBLE AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w FROM src),
ratio AS (SELECT *, 3 * source_size AS cap, 3 * source_size / w AS r FROM weighed),
run AS (
  SELECT *, sum(source_size) OVER () AS total, sum(w) OVER () AS all_w,
    sum(cap) OVER (ORDER BY r, source NULLS LAST ROWS UNBOUNDED PRECEDING) - cap AS cap_before,
    sum(w) OVER (ORDER BY r, source NULLS LAST ROWS UNBOUNDED PRECEDING) - w AS w_before FROM ratio),
lev AS (SELECT *, (total - cap_before) / (all_w - w_before) AS level FROM run),
fin AS (SELECT level FROM lev WHERE NOT level > r ORDER BY r, source NULLS LAST LIMIT 1),
tgt AS (SELECT source, source_size, CASE WHEN level > r THEN cap ELSE (SELECT level FROM fin) * w END AS target FROM lev),
rated AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, coalesce(t.target / nullif(t.source_size, 0), 0) AS rate,
    ('0x' || substr(md5('mix-1:' || coalesce(s.doc_id::VARCHAR, 'null')), 1, 8))::UBIGINT / 4294967296.0 AS u
  FROM sized s JOIN tgt t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size::BIGINT AS source_size, target,
  (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM rated
"""
