"""Texts in parts over many rows, joined only where a match may lie across a seam."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.functions.patterns import SPACE_CHARS
from corpuslens.functions.sqltext import quote
from corpuslens.operators.staging import staged

#: Stands between two parts of a text.
SEPARATOR = " "


@dataclass(frozen=True)
class Look:
    """What is searched: a Java pattern, the function its text goes through first, and
    how far a match reaches (:func:`corpuslens.functions.patterns.reach`)."""

    regex: str
    form: str
    reach: int


def _units(most: int, least: int = 0) -> str:
    """The beginning of a text: so many characters, a run of white space being one."""
    return f"^(?:[{SPACE_CHARS}]++|[^{SPACE_CHARS}]){{{least},{most}}}"


def _places(look: Look, text: str) -> str:
    """What the pattern finds from every place of the text, were it to begin there."""
    return f"regexp_extract_all({look.form}({text}), {quote(f'(?=({look.regex}))')}, 1)"


def _nothing_across(looks: list[Look], left: str, right: str) -> Column:
    """Whether every pattern finds the same, from every place, in two texts apart and joined.

    A match over the seam would add to what is found or be longer than what is found at its
    place; equal lists rule it out, and tell that no end of a text matters either.
    """
    joined = f"concat({left}, {quote(SEPARATOR)}, {right})"
    same = [f"{_places(x, joined)} = concat({_places(x, left)}, {_places(x, right)})" for x in looks]
    return F.expr(" and ".join(same) or "true")


def _runs(blocks: DataFrame, key: str, block: str, looks: list[Look]) -> DataFrame:
    """Per block the first block of the run of blocks that has to stay together: ``run``.

    Ends of the blocks, some characters each, are ordered by ranges of (key, block) and meet
    their neighbours within a range; what lies at the edge of a range comes from one row a
    range. So the blocks of one key, however many, are no single task's work.
    """
    wide = max((look.reach for look in looks), default=0) + 2
    text = F.col("text")
    # Where white space stands alone, units are characters.
    plain = ~F.rlike(text, F.lit(f"[{SPACE_CHARS}]{{2}}"))
    backwards = F.reverse(F.regexp_extract(F.reverse(text), _units(wide), 0))
    ends = staged(blocks.select(
        key, block,
        F.when(plain, F.length(text) >= wide).otherwise(F.rlike(text, F.lit(_units(wide, wide)))).alias("long"),
        F.when(plain, F.substring(text, 1, wide)).otherwise(F.regexp_extract(text, _units(wide), 0)).alias("head"),
        F.when(plain, F.right(text, F.lit(wide))).otherwise(backwards).alias("tail"),
    ), "unit-ends")
    ranged = staged(ends.repartitionByRange(key, block).withColumn("_range", F.spark_partition_id()), "ends")
    here, place = F.struct(key, "long", "tail", "first"), F.struct(key, block)
    ranged = ranged.withColumn("first", F.col(block) < 0)
    over = Window.orderBy("_range")
    edges = ranged.groupBy("_range").agg(F.min(key).alias("_low"), F.max_by(here, place).alias("_high")).select(
        F.col("_range"), F.lead("_low").over(over).alias("_after"), F.lag("_high").over(over).alias("_before")
    )
    inside = Window.partitionBy("_range").orderBy(key, block)
    rows = ranged.join(edges, "_range").withColumns({
        "_prev": F.coalesce(F.lag(here).over(inside), "_before"),
        "_next": F.coalesce(F.lead(key).over(inside), "_after"),
    })
    last = ~F.col("_next").eqNullSafe(F.col(key))
    seen = (F.col("_prev.long") | F.col("_prev.first")) & (F.col("long") | last)
    rows = rows.select(
        key, block, "_range",
        (
            ~F.col(f"_prev.{key}").eqNullSafe(F.col(key))
            | F.coalesce(seen & _nothing_across(looks, "_prev.tail", "head"), F.lit(False))
        ).alias("begins"),
    )
    rows = staged(rows.withColumn("start", F.when(F.col("begins"), F.col(block))), "begins")
    carried = rows.groupBy("_range").agg(F.max_by("start", F.when(F.col("begins"), place)).alias("_start")).select(
        "_range", F.last("_start", True).over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("_carried")
    )
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.join(carried, "_range").select(
        key, block, F.coalesce(F.last("start", True).over(so_far), "_carried").alias("run")
    )


def _joined(parts: DataFrame, keys: list[str], order: str) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct(order, "text")))
    return parts.groupBy(*keys).agg(F.array_join(ordered["text"], SEPARATOR).alias("text"))


def pieces(
    openings: DataFrame, parts: DataFrame, key: str, order: str, looks: list[Look], per_block: int = 32
) -> DataFrame:
    """``(key, piece, text)``: texts cut so that searching the pieces finds what searching
    the whole text would.

    The text of a key is its ``text`` in ``openings`` (one row a key), then those of ``parts``
    (any number) by ``order``, whole numbers from 0, with one space between. ``per_block``
    numbers of the order form a block. A block stays joined to the one before where a match
    may lie across, and where either is too short to tell, as when it holds white space only.
    Pieces are numbered by their first block, the opening being block -1, so they sort in
    the order of the text. Null texts are empty ones.

    Rows are as long as a block, and longer only where every seam in between may be
    matched over. Texts are moved once; those of joined blocks twice.
    """
    block = F.floor(F.col(order) / per_block).cast("long").alias("piece")
    shaped = parts.select(key, block, F.col(order).alias("at"), F.coalesce("text", F.lit("")).alias("text"))
    first = openings.select(key, F.lit(-1).cast("long").alias("piece"), F.coalesce("text", F.lit("")).alias("text"))
    blocks = staged(first.unionByName(_joined(shaped, [key, "piece"], "at")), "blocks")
    runs = _runs(blocks, key, "piece", looks)
    added = staged(runs.where("run <> piece"), "added")
    heads = added.select(key, F.col("run").alias("piece"), "run").distinct()
    members = added.unionByName(heads)
    together = blocks.join(members, [key, "piece"])
    alone = blocks.join(members.select(key, "piece"), [key, "piece"], "left_anti")
    joined = _joined(together, [key, "run"], "piece").withColumnRenamed("run", "piece")
    return alone.select(key, "piece", "text").unionByName(joined)
