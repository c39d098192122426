"""Chat formatting: collapse of cumulative snapshots, then rendering.

Chat logs often hold a conversation several times, each snapshot a few turns longer. Every turn gets the rolling hash of
the turns up to it; a conversation whose last hash also stands inside a longer one is a prefix of that, and an anti-join
drops it. Of equal conversations the one of least id stays. What remains is rendered in a chat template.

All steps are native. The rolling hash adds the 64-bit hashes of (place, role, text) in two 32-bit halves, so it is a
running sum. Turns are numbered and summed in blocks of turn numbers and the blocks' totals are added afterwards, so that
no window holds a long conversation whole; rendering goes in segments of SEGMENT turns.

Defined results: rows with null conversation or turn are left out; a null role or text counts as an empty one; turns of
equal number are ordered by role and text, and rows that repeat are turns of their own. Long texts are rendered whole; other
columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Range of turn numbers that one window numbers, and turns that one rendered row holds at most.
BLOCK = SEGMENT = 512


def _running(rows: DataFrame, order: list[str], sums: list[str]) -> DataFrame:
    """Replaces the columns ``sums`` by their running sums (row included) over each conversation: in blocks, then across."""
    inner = Window.partitionBy("conv", "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("conv", "block").agg(*(F.sum(k).alias(f"_{k}") for k in sums))
    before = totals.select("conv", "block", *(F.sum(f"_{k}").over(earlier).alias(f"_{k}") for k in sums)).where(F.col(f"_{sums[0]}").isNotNull())
    out = rows.withColumns({k: F.sum(k).over(inner) for k in sums}).join(before, ["conv", "block"], "left")
    return out.withColumns({k: F.col(k) + F.coalesce(f"_{k}", F.lit(0)) for k in sums}).drop(*(f"_{k}" for k in sums))


def numbered(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows (conv, turn, role, text, block, place); place counts a conversation's turns from 1."""
    rows = turns.where(F.col(conv_col).isNotNull() & F.col(turn_col).isNotNull()).select(
        F.col(conv_col).alias("conv"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(role_col, F.lit("")).alias("role"),
        F.coalesce(text_col, F.lit("")).alias("text"),
    )
    rows = rows.withColumns({"block": F.floor(F.col("turn") / BLOCK), "place": F.lit(1)})
    return _running(rows, ["turn", "role", "text"], ["place"])


def rolling(turns: DataFrame, **columns: str) -> DataFrame:
    """Rows (conv, place, low, high): the rolling hash of each conversation's first ``place`` turns."""
    name = F.xxhash64("place", "role", "text")
    halves = (name.bitwiseAND(F.lit(0xFFFFFFFF)).alias("low"), F.shiftrightunsigned(name, 32).alias("high"))
    hashed = numbered(turns, **columns).select("conv", "block", "place", *halves)
    return _running(hashed, ["place"], ["low", "high"]).drop("block")


def maximal(turns: DataFrame, **columns: str) -> DataFrame:
    """The conversations (conv) that are a prefix of no longer one; of equal ones the least."""
    prefixes = rolling(turns, **columns)
    key = ["place", "low", "high"]
    # Each conversation's own end is among the prefixes too, so a longer one exists where the prefixes outnumber the ends.
    ends = prefixes.groupBy("conv").agg(F.max(F.struct(*key)).alias("end")).select("conv", "end.*").groupBy(*key).agg(F.min("conv").alias("conv"), F.count("*").alias("ends"))
    seen = prefixes.groupBy(*key).agg(F.count("*").alias("seen"))
    a, b = ends.alias("a"), seen.alias("b")
    longer = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in key] + [F.col("b.seen") > F.col("a.ends")]
    return a.join(b, longer, "left_anti").select("conv")


def render(turns: DataFrame, segment: int = SEGMENT, **columns: str) -> DataFrame:
    """Maximal conversations in the template: conv_id, segment, n_turns, rendered. Segments of a conversation follow on."""
    rows = numbered(turns, **columns).join(maximal(turns, **columns), "conv", "left_semi")
    parts = rows.groupBy("conv", F.floor((F.col("place") - 1) / segment).alias("segment")).agg(
        F.count("*").alias("n_turns"), F.sort_array(F.collect_list(F.struct("place", "role", "text"))).alias("turns")
    )
    line = lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit("<|end|>\n"))
    return parts.select(F.col("conv").alias("conv_id"), "segment", "n_turns", F.array_join(F.transform("turns", line), "").alias("rendered"))
