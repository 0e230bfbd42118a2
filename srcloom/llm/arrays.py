"""Walks through arrays with DataFrame functions."""

from __future__ import annotations

from pyspark.sql import functions as F

BLOCK = 256


def running(items: F.Column, first: F.Column, kind: str, step) -> F.Column:
    """Goes through an array from a place ``first``: step(place, item) gives the next place and an array of
    results; all results in order, as an array of type ``kind``."""
    # by way of an array, so that what the items come from is worked out once
    return F.transform(F.array(items), lambda own: _running(own, first, kind, step))[0]


def _running(items: F.Column, first: F.Column, kind: str, step) -> F.Column:
    none = F.array().cast(kind)

    def in_block(acc, x):
        at, own = step(acc["at"], x)
        return F.struct(at.alias("at"), F.when(F.size(own) > 0, F.concat(acc["own"], own)).otherwise(acc["own"]).cast(kind).alias("own"))

    def block(acc, k):
        inner = F.aggregate(F.slice(items, k * BLOCK + 1, BLOCK), F.struct(acc["at"].alias("at"), none.alias("own")), in_block)
        # by way of an array, so that the block is gone through once
        return F.transform(F.array(inner), lambda i: F.struct(i["at"].alias("at"), F.concat(acc["own"], F.array(i["own"])).cast(f"array<{kind}>").alias("own")))[0]

    blocks = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int"))
    whole = F.aggregate(blocks, F.struct(first.alias("at"), F.array().cast(f"array<{kind}>").alias("own")), block, lambda acc: F.flatten(acc["own"]))
    return F.when(F.size(items) > 0, whole).otherwise(none)
