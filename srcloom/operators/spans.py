"""Spans of lines in files that nest or follow each other: which holds a line, which hold any of some lines.

One sort of each file's rows by line; nothing is joined by ranges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def innermost(points: DataFrame, spans: DataFrame) -> DataFrame:
    """points (path, line, ...) with the spans' columns beside a and z (its last line) of the innermost span
    (path, a, z, ...) that holds the line; points in no span go.  Where a span begins on the line on which the
    one before ends, that line belongs to the later one."""
    keep = [c for c in spans.columns if c != "path"]
    span, point = F.struct(*keep), F.struct(*(c for c in points.columns if c not in ("path", "line")), "line")
    row = lambda rows, line, role, step, s, p: rows.select("path", line.alias("_at"), F.lit(role).alias("_role"), F.lit(step).alias("_step"), s.alias("_span"), p.alias("_point"))
    no_span, no_point = F.lit(None).cast(spans.select(span.alias("s")).schema["s"].dataType), F.lit(None).cast(points.select(point.alias("p")).schema["p"].dataType)
    both = spans.select("path", span.alias("_span")).select("path", "_span", F.explode(F.array(F.struct(F.col("_span.a").alias("at"), F.lit(0).alias("role"), F.lit(1).alias("step")), F.struct(F.col("_span.z").alias("at"), F.lit(2).alias("role"), F.lit(-1).alias("step")))).alias("e"))
    ends = both.select("path", F.col("e.at").alias("_at"), F.col("e.role").alias("_role"), F.col("e.step").alias("_step"), F.when(F.col("e.role") == 0, F.col("_span")).alias("_span"), no_point.alias("_point"))
    every = ends.unionByName(row(points, F.col("line"), 1, 0, no_span, point))
    upto = lambda w: w.orderBy("_at", "_role", F.desc("_span.z")).rowsBetween(Window.unboundedPreceding, 0)
    every = every.withColumn("_depth", F.sum("_step").over(upto(Window.partitionBy("path"))))
    every = every.withColumn("_span", F.last("_span", True).over(upto(Window.partitionBy("path", "_depth"))))
    found = every.where("_role = 1 AND _depth > 0 AND _span.z >= _at")
    return found.select("path", "_point.*", *(F.col(f"_span.{c}").alias(c) for c in keep))


def within(points: DataFrame, spans: DataFrame) -> DataFrame:
    """What ``innermost`` gives for spans of which none stands in another (``outermost``): the last that has begun, by one sort."""
    keep = [c for c in spans.columns if c != "path"]
    span, point = F.struct(*keep), F.struct(*(c for c in points.columns if c not in ("path", "line")), "line")
    no_span, no_point = F.lit(None).cast(spans.select(span.alias("s")).schema["s"].dataType), F.lit(None).cast(points.select(point.alias("p")).schema["p"].dataType)
    every = spans.select("path", F.col("a").alias("_at"), F.lit(0).alias("_role"), span.alias("_span"), no_point.alias("_point")).unionByName(points.select("path", F.col("line").alias("_at"), F.lit(1).alias("_role"), no_span.alias("_span"), point.alias("_point")))
    upto = Window.partitionBy("path").orderBy("_at", "_role", F.desc("_span.z")).rowsBetween(Window.unboundedPreceding, 0)
    found = every.withColumn("_span", F.last("_span", True).over(upto)).where("_role = 1 AND _span.z >= _at")
    return found.select("path", "_point.*", *(F.col(f"_span.{c}").alias(c) for c in keep))


def holding(spans: DataFrame, points: DataFrame) -> DataFrame:
    """The spans (path, a, z, ...) in which at least one of points (path, line) lies, at any depth."""
    row = lambda rows, line, role, span: rows.select("path", line.alias("_at"), F.lit(role).alias("_role"), span.alias("_span"))
    span = F.struct(*(c for c in spans.columns if c != "path"))
    none = F.lit(None).cast(spans.select(span.alias("s")).schema["s"].dataType)
    every = row(spans, F.col("a"), 0, span).unionByName(row(points, F.col("line"), 1, none)).unionByName(row(spans, F.col("z"), 2, span))
    seen = Window.partitionBy("path").orderBy("_at", "_role").rowsBetween(Window.unboundedPreceding, 0)
    every = every.withColumn("_seen", F.sum(F.when(F.col("_role") == 1, 1).otherwise(0)).over(seen)).where("_role <> 1")
    return every.groupBy("path", "_span").agg(F.max("_seen").alias("_to"), F.min("_seen").alias("_from")).where("_to > _from").select("path", "_span.*")


def outermost(spans: DataFrame) -> DataFrame:
    """The spans (path, a, z, ...) that stand in no larger one."""
    before = Window.partitionBy("path").orderBy("a", F.desc("z")).rowsBetween(Window.unboundedPreceding, -1)
    rows = spans.withColumn("_m", F.max(F.struct("z", F.negative("a").alias("a"))).over(before))
    return rows.where("_m IS NULL OR _m.z < z OR (_m.z = z AND -_m.a = a)").drop("_m")
