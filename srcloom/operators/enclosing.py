"""The innermost interval around each interval, where intervals may cross, by sorted sweeps.

Of two outer intervals the one that starts later and ends no earlier hides the other from all that follows; what is
left is a stack with falling ends, in which a binary search finds the innermost one that reaches far enough.  Rows
are dealt by ranges of (key, start), so that a key of any size is spread over many bins; each bin is swept by itself.
What finds nothing in its bin looks for the last earlier bin of its key with an end far enough away, and in that
bin once more.  Nothing is paired but each interval with its result.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcloom.operators.lineage import cut, cut_as_dealt

FOUND = "key string, bin int, id string, far long, outer string"
#: Rows of a bin, and look-ups that go to one group.
ROWS = 200_000


class Stack:
    """Outer intervals in order of their starts, without those that a later one hides."""

    def __init__(self):
        self.ends: list[int] = []  # negative, so that they rise
        self.ids: list[str] = []

    def put(self, end: int, own: str) -> None:
        while self.ends and -self.ends[-1] < end:
            self.ends.pop()
            self.ids.pop()
        self.ends.append(-end)
        self.ids.append(own)

    def find(self, end: int, own: str) -> str | None:
        """The last one that ends at ``end`` or later and isn't ``own``."""
        k = bisect_right(self.ends, -end) - 1
        while k >= 0 and self.ids[k] == own:
            k -= 1
        return self.ids[k] if k >= 0 else None


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, bin, start, far, role, id) in order: what each row of role 1 finds among those of role 0 before it."""
    last, stack = None, Stack()
    for batch in batches:
        out = []
        for key, number, far, role, own in zip(*(batch.column(c).to_pylist() for c in ("key", "bin", "far", "role", "id")), strict=True):
            if (key, number) != last:
                last, stack = (key, number), Stack()
            if role:
                out.append((key, number, own, far, stack.find(far, own)))
            else:
                stack.put(far, own)
        kinds = (pa.string(), pa.int32(), pa.string(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out, strict=True)) or [()] * 5, kinds, strict=True)], ["key", "bin", "id", "far", "outer"])


def _swept(rows: DataFrame) -> DataFrame:
    # outer intervals come first where starts are equal, of them those that end later, then larger ids
    return rows.sortWithinPartitions("key", "bin", "start", "role", F.desc("far"), F.desc("place")).select("key", "bin", "start", "far", "role", "id").mapInArrow(_sweep, FOUND)


def _looked_up(asked: DataFrame, among: DataFrame, tasks: int) -> DataFrame:
    """What rows asked (key, bin, start, far, id) find among others of their key and bin; those of a bin that very many
    look in are repeated for parts of them."""
    parts = asked.groupBy("key", "bin").agg(F.ceil(F.count("*") / ROWS).cast("int").alias("parts"))
    a = asked.join(parts, ["key", "bin"]).withColumns({"part": F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"), "role": F.lit(1), "place": F.lit(0).cast("long")})
    b = among.join(parts, ["key", "bin"]).withColumns({"part": F.explode(F.sequence(F.lit(0), F.col("parts") - 1)), "role": F.lit(0)})
    names = ("key", "bin", "part", "start", "far", "role", "place", "id")
    rows = a.select(*names).unionByName(b.select(*names)).repartition(tasks, "key", "bin", "part")
    return _swept(rows.withColumn("key", F.concat_ws("\x00", "part", "key"))).where("outer IS NOT NULL").select(F.substring_index("key", "\x00", -1).alias("key"), "id", "far", "bin", "outer")


def enclosing(inner: DataFrame, outer: DataFrame, by: str) -> DataFrame:
    """inner (by, id, start, end) with ``outerId``: of the outer intervals of the same ``by`` that hold it, but for
    itself, the one that starts last, of these the one that ends first, of these the one of least id; null where none does, or
    a key or bound is null.  Keys, ids and bounds are whole numbers; inner has each id once, and an id in both names the same interval."""
    part = lambda rows, role: rows.where(f"{by} IS NOT NULL AND start IS NOT NULL AND `end` IS NOT NULL AND id IS NOT NULL").select(F.col(by).cast("string").alias("key"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("far"), F.lit(role).alias("role"), F.col("id").cast("long").alias("place"), F.col("id").cast("string").alias("id"))
    rows = part(outer, 0).unionByName(part(inner, 1))
    bins = max(1, -(-rows.count() // ROWS))
    dealt = cut_as_dealt(rows.repartitionByRange(bins, "key", "start").withColumn("bin", F.spark_partition_id()))
    here = cut(_swept(dealt))
    done = here.where("outer IS NOT NULL").select("id", "outer")
    # what has found nothing asks the bins before it that its key lies in
    open_ = here.where("outer IS NULL")
    ends = dealt.where("role = 0").groupBy("key", "bin").agg(F.max("far").alias("far"))
    many = dealt.groupBy("key").agg(F.min("bin").alias("a"), F.max("bin").alias("z")).where("a < z").select("key")
    one = F.lit(0).alias("bin")
    asked = open_.join(many, "key", "left_semi").select("key", one, (2 * F.col("bin")).cast("long").alias("start"), "far", "id")
    among = ends.join(many, "key", "left_semi").select("key", one, (2 * F.col("bin") + 1).cast("long").alias("start"), "far", F.lit(0).cast("long").alias("place"), F.concat(F.lit("b"), F.col("bin").cast("string")).alias("id"))
    bin_of = cut(_looked_up(asked, among, bins).select("key", F.substring("outer", 2, 20).cast("int").alias("bin"), F.lit(2**63 - 1).alias("start"), "far", "id"))
    found = done.unionByName(_looked_up(bin_of, dealt.where("role = 0"), bins).select("id", "outer"))
    return inner.join(found.select(F.col("id").cast(inner.schema["id"].dataType).alias("id"), F.col("outer").cast(outer.schema["id"].dataType).alias("outerId")), "id", "left")
