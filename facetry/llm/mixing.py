"""Mixing sources to target weights, with DataFrame functions only.

Tokens are summed per source, targets are filled like water up to a cap of
``max_repeat`` times the source, and a source's repetition rate is target over
size. A document is emitted floor(rate) times, and once more if a hash (seeded, so
reruns agree) of its id, its text and its number among equal rows falls under the
rate's fraction.

Edge cases: null text has size 0; null is a source of its own, last in order;
a source without words has rate 0 and target 0; a null id draws like any other;
repeated rows draw apart, by their number, and each counts; texts of any length are
measured without a list of their words; an empty table gives an empty result; extra
columns are carried along.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import number_repeats, settle

SEED = "mix-1"
WEIGHTS = (1, 2, 3)
MAX_REPEAT = 3
#: A source's row is broadcast while there are at most so many sources (about 100 bytes each).
BROADCAST_SOURCES = 100_000
#: What lies between words.
GAP = r"[\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Runs of other than blank and U+0009-U+000D: blanks of the text with single
    blanks between words, and one."""
    flat = F.trim(F.regexp_replace(text, GAP, " "))
    gaps = F.octet_length(flat) - F.octet_length(F.replace(flat, F.lit(" "), F.lit("")))
    return F.when(F.coalesce(flat, F.lit("")) == "", F.lit(0)).otherwise(gaps + 1).cast("long")


def draw(key: Column, digest: Column, nth: Column, seed: str) -> Column:
    """A number in [0, 1) of 48 hashed bits; any engine with md5 can repeat it."""
    named = F.concat_ws(":", F.lit(seed), F.coalesce(key.cast("string"), F.lit("null")), digest, nth.cast("string"))
    return F.conv(F.substring(F.md5(named), 1, 12), 16, 10).cast("double") / float(1 << 48)


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(source, source_size) -> source, source_size, target.

    Water-filling in closed form: with sources ordered by cap/weight, the
    capped ones are a prefix. A level that takes sources past that prefix as capped
    is lower than the true one, so the true one is the highest that caps nothing new."""
    by_source = Window.orderBy(F.col("source").asc_nulls_last())
    repeated = F.array(*map(F.lit, weights))
    ranked = sizes.select(
        "source",
        "source_size",
        F.element_at(repeated, (F.pmod(F.row_number().over(by_source) - 1, F.lit(len(weights))) + 1).cast("int")).cast("long").alias("weight"),
        (F.col("source_size") * max_repeat).alias("cap"),
    )
    everything = Window.partitionBy()
    ordered = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    filled = ranked.select(
        "*",
        F.sum("source_size").over(everything).alias("total"),
        F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("capped"),
        F.sum("weight").over(ordered.rowsBetween(0, Window.unboundedFollowing)).alias("open_weight"),
    )
    level = (F.col("total") - F.col("capped")) / F.col("open_weight")
    capped = level * F.col("weight") >= F.col("cap")
    final = F.max(F.when(~capped, level)).over(everything)
    target = F.when(capped | final.isNull(), F.col("cap").cast("double")).otherwise(F.least(final * F.col("weight"), F.col("cap").cast("double")))
    return filled.select("source", "source_size", target.alias("target"))


def measure(docs: DataFrame) -> DataFrame:
    """``docs`` with ``mix_size`` (words), ``mix_digest`` (of the text) and ``mix_hash``, which
    parts texts as cheaply as can be."""
    return docs.withColumns({"mix_size": word_count(F.col("text")), "mix_digest": F.md5(F.coalesce("text", F.lit("")).cast("binary")), "mix_hash": F.xxhash64(F.coalesce("text", F.lit("")))})


def drawn(measured: DataFrame, seed: str = SEED) -> DataFrame:
    """``measured`` with ``mix_draw``, a number in [0, 1)."""
    numbered = number_repeats(measured, ["doc_id", "mix_hash"])
    return numbered.withColumn("mix_draw", draw(F.col("doc_id"), F.col("mix_digest"), F.col("__nth"), seed)).drop("__nth")


def plan_mix(measured: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """``measured`` with ``mix_source_size``, ``mix_target`` and ``mix_copies``."""
    sums = measured.groupBy("source").agg(F.sum("mix_size").alias("source_size"))
    targets = settle(source_targets(sums, weights, max_repeat), "mix-sources")
    small = targets.count() <= BROADCAST_SOURCES
    named = targets.select(F.col("source").alias("_mix_source"), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"))
    joined = measured.join(F.broadcast(named) if small else named, F.col("source").eqNullSafe(F.col("_mix_source"))).drop("_mix_source")
    rate = F.least(F.coalesce(F.try_divide(F.col("mix_target"), F.col("mix_source_size").cast("double")), F.lit(0.0)), F.lit(float(max_repeat)))
    whole = F.floor(rate)
    return joined.withColumn("mix_copies", whole + (F.col("mix_draw") < rate - whole).cast("long"))


def mix(docs: DataFrame, seed: str = SEED, **options) -> DataFrame:
    """The mixed corpus: each row of ``docs`` as often as its copies say, same columns."""
    # the record travels as one column, so that no name of its own can clash
    packed = docs.select("doc_id", "text", "source", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    planned = plan_mix(drawn(measure(packed), seed), **options).filter("mix_copies > 0")
    return planned.select("__row", F.explode(F.sequence(F.lit(1), F.col("mix_copies").cast("int"))).alias("__copy")).select("__row.*")


def mix_digest(docs: DataFrame) -> DataFrame:
    """Contract of op5. The measured rows are kept without their texts, so texts are read once."""
    measured = settle(measure(docs.select("doc_id", "text", "source")).drop("text"), "mix-sizes")
    return plan_mix(drawn(measured)).select(
        "doc_id",
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        (F.col("mix_size") * F.col("mix_copies")).alias("taken"),
    )


MIX_SQL = """
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS digest,
         row_number() OVER (PARTITION BY doc_id, coalesce(text, '')) - 1 AS nth,
         CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) AS BIGINT) AS size
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), w AS (
  SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight, 3 * source_size AS cap FROM s
), f AS (
  SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) AS total,
         CAST(coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS capped,
         CAST(sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS open_weight
  FROM w
), l AS (SELECT *, (total - capped) / open_weight AS level FROM f
), t AS (
  SELECT source, source_size, cap, weight, level * weight >= cap AS full_up,
         max(CASE WHEN level * weight >= cap THEN NULL ELSE level END) OVER () AS final
  FROM l
), g AS (
  SELECT source, source_size, CASE WHEN full_up OR final IS NULL THEN CAST(cap AS DOUBLE) ELSE least(final * weight, CAST(cap AS DOUBLE)) END AS target FROM t
), r AS (
  SELECT d.doc_id, d.size, g.source_size, g.target,
         least(CASE WHEN g.source_size = 0 THEN 0.0 ELSE g.target / g.source_size END, 3.0) AS rate,
         CAST(CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null') || ':' || d.digest || ':' || d.nth), 1, 12) AS BIGINT) AS DOUBLE) / 281474976710656.0 AS u
  FROM sized d JOIN g ON d.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target,
       CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r
"""
