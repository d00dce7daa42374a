"""Putting markers in the place of spans, in texts and in texts cut into segments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

REPLACEMENTS = "array<struct<start:int,end:int,marker:string>>"


def normalize(replacements: Column, length: Column) -> Column:
    """Replacements in range, by start and the longer first; later ones that overlap go."""
    sound = F.filter(replacements.cast(REPLACEMENTS), lambda r: (r["start"] >= 0) & (r["end"] > r["start"]) & (r["end"] <= length) & r["marker"].isNotNull())
    key = lambda r: F.struct(r["start"], r["start"] - r["end"])
    ordered = F.array_sort(sound, lambda a, b: F.when(key(a) < key(b), -1).when(key(a) > key(b), 1).otherwise(0))
    keep = lambda acc, r: F.when(r["start"] >= F.coalesce(F.element_at(F.transform(acc, lambda x: x["end"]), -1), F.lit(0)), F.concat(acc, F.array(r))).otherwise(acc)
    return F.aggregate(ordered, F.array().cast(REPLACEMENTS), lambda acc, r: F.when(F.size(acc) == 0, F.array(r)).otherwise(keep(acc, r)))


def splice(text: Column, replacements: Column) -> Column:
    """The text with disjoint, sorted replacements put in."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    put = lambda acc, r: F.struct(r["end"].alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, r["start"] - acc["at"]), r["marker"]).alias("out"))
    return F.aggregate(replacements, start, put, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def splice_segments(segments: Column, replacements: Column) -> Column:
    """Segments with replacements put in: a marker stands in the segment where its span starts, and the
    rest of the span is cut from the segments it reaches into.  No segment goes."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def one(acc: Column, segment: Column) -> Column:
        lo, hi = acc["at"], acc["at"] + F.length(segment)
        local = F.transform(
            F.filter(replacements, lambda r: (r["start"] < hi) & (r["end"] > lo)),
            lambda r: F.struct(
                F.greatest(r["start"] - lo, F.lit(0)).alias("start"), F.least(r["end"] - lo, F.length(segment)).alias("end"), F.when(r["start"] >= lo, r["marker"]).otherwise("").alias("marker")
            ),
        )
        return F.struct(hi.alias("at"), F.concat(acc["out"], F.array(splice(segment, local.cast(REPLACEMENTS)))).alias("out"))

    return F.aggregate(segments, zero, one, lambda acc: acc["out"])
