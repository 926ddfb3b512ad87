"""Jump consistent hashing of stable keys to shards (Lamping and Veach, 2014)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.numbering import number_within

# Fixed values of the published algorithm.
MULTIPLIER = 2862933555777941757
LOW = 0xFFFFFFFF
#: Steps every key gets; a key that needs more takes the guarded second loop.
COMMON_STEPS = 24


def _times(a: Column, b: int) -> Column:
    """Low 32 bits of a 32-bit value times a 32-bit constant, without overflow of a long."""
    low, high = b & 0xFFFF, b >> 16
    return (a * F.lit(low) + F.shiftleft((a * F.lit(high)).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(LOW))


def _advance(state: Column) -> Column:
    """One jump: key = key * MULTIPLIER + 1 (mod 2^64, kept as two 32-bit halves), then
    the next shard the key would move to."""
    hi, lo, at = state["hi"], state["lo"], state["j"]
    low, high = MULTIPLIER & LOW, MULTIPLIER >> 32
    small = lo * F.lit(low & 0xFFFF) + F.lit(1)
    large = lo * F.lit(low >> 16)
    sum_low = small + F.shiftleft(large.bitwiseAND(F.lit(0xFFFF)), 16)
    new_lo = sum_low.bitwiseAND(F.lit(LOW))
    carry = F.shiftright(sum_low, 32) + F.shiftright(large, 16)
    new_hi = (carry + _times(hi, low) + _times(lo, high)).bitwiseAND(F.lit(LOW))
    draw = F.shiftright(new_hi, 1).cast("double") + F.lit(1.0)
    jump = F.floor((at + F.lit(1)).cast("double") * (F.lit(float(1 << 31)) / draw)).cast("long")
    return F.struct(new_hi.alias("hi"), new_lo.alias("lo"), at.alias("b"), jump.alias("j"))


def jump_shard(key: Column, shards: int) -> Column:
    """Shard of a 64-bit key, 0 to ``shards`` - 1; null keys count as 0.

    With one more shard a key either stays or moves to the new shard. The number of
    jumps is about ln(shards); each row gets COMMON_STEPS, and a row that is not done
    then goes on for as many steps as there can be, so that no key is cut short.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("hi"), key.bitwiseAND(F.lit(LOW)).alias("lo"),
        F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"),
    )

    def run(state: Column, steps: int) -> Column:
        step = lambda s, _: F.when(s["j"] < F.lit(shards), _advance(s)).otherwise(s)
        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), state, step)

    state = run(start, min(shards, COMMON_STEPS))
    if shards > COMMON_STEPS:
        state = F.when(state["j"] < F.lit(shards), run(state, shards)).otherwise(state)
    return state["b"].cast("int")


def stable_key(column: Column, kind: str) -> Column:
    """The 64-bit key of a column: integers stand for themselves, other types are hashed."""
    return column if kind in ("bigint", "int", "smallint", "tinyint") else F.xxhash64(column)


def shard_documents(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row with its shard, the shard it would have with one more, and a slot.

    Columns: the key, size (UTF-8 bytes plus 1), text_crc32, shard, grown_shard, slot.
    Slots are gapless from 0 in each shard. Null texts count as empty (size 1, checksum
    0); rows with a null key go to the shard of key 0; rows that repeat a key share its
    shard and get slots of their own; an empty table gives no rows; other columns are
    not read. The text is read once and never shuffled.
    """
    kind = dict(docs.dtypes)[key]
    content = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key), (F.octet_length(content).cast("long") + 1).alias("size"),
        F.crc32(content.cast("binary")).alias("text_crc32"),
    )
    chosen = stable_key(F.col(key), kind)
    rows = rows.select("*", jump_shard(chosen, shards).alias("shard"), jump_shard(chosen, shards + 1).alias("grown_shard"))
    return number_within(rows, "shard", [key, "text_crc32"], "slot")
