"""Operations: cost by time bucket, local times, cache figures."""

from __future__ import annotations

from datetime import datetime
from functools import lru_cache
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Prices of a request and of a GB second, and the memory of the function.
PRICE_PER_REQUEST = 0.0000002
PRICE_PER_GB_SECOND = 0.0000166667
MEMORY_GB = 2.0


def cost(invocations: Column, duration_ms: Column) -> Column:
    return invocations * PRICE_PER_REQUEST + duration_ms / 1000.0 * MEMORY_GB * PRICE_PER_GB_SECOND


def cost_by_bucket(invocations: DataFrame, durations: DataFrame) -> DataFrame:
    """(ts, invocations, duration_ms, cost_usd) of two series (ts, value), and a total with null ts, also over nothing; what a series lacks is 0.

    Both series are summed by time and over all in one pass; values without a time count in the total only.
    """
    none = invocations.sparkSession.range(1).select(F.lit(None).cast(invocations.schema["ts"].dataType).alias("ts"), F.lit(0).cast("long").alias("i"), F.lit(0.0).alias("d"))
    a = invocations.select("ts", F.col("value").cast("long").alias("i"), F.lit(0.0).alias("d"))
    b = durations.select("ts", F.lit(0).cast("long").alias("i"), F.col("value").cast("double").alias("d"))
    sums = a.unionByName(b).unionByName(none).groupingSets([["ts"], []], "ts").agg(F.grouping("ts").alias("all"), F.coalesce(F.sum("i"), F.lit(0)).alias("i"), F.coalesce(F.sum("d"), F.lit(0.0)).alias("d"))
    rows = sums.filter("all = 1 or ts is not null")
    return rows.select("ts", F.col("i").alias("invocations"), F.col("d").alias("duration_ms"), cost(F.col("i"), F.col("d")).alias("cost_usd"))


@lru_cache(maxsize=64)
def _names(zone: str) -> tuple[list[int], list[str]]:
    """From when (seconds since 1970, UTC) which abbreviation holds in a zone, up to 2100, found by halving the days at which it changes."""
    at = lambda s: datetime.fromtimestamp(s, ZoneInfo(zone)).strftime("%Z")
    starts, names, day = [-(1 << 62)], [at(0)], 86_400
    for day_start in range(0, 4_102_444_800, 30 * day):
        low, high = day_start, day_start + 30 * day
        if at(high) != names[-1]:
            while high - low > 1:
                middle = (low + high) // 2
                low, high = (low, middle) if at(middle) != names[-1] else (middle, high)
            starts.append(high)
            names.append(at(high))
    return starts, names


def local_line(line: Column, zone: str = "UTC") -> Column:
    """A line that begins with an ISO time and a tab, with that time in the zone and the zone's abbreviation then; any other line as it is.

    A time without an offset is taken as in the zone already.
    """
    head, tail = F.substring_index(line, "\t", 1), F.substring(line, F.instr(line, "\t"), F.length(line))
    fixed = head.rlike(r"(Z|[+-]\d\d:?\d\d)$")
    iso = head.rlike(r"^\d{4}-\d\d-\d\d([T ]\d\d:\d\d(:\d\d(\.\d+)?)?(Z|[+-]\d\d:?\d\d)?)?$")
    read = F.try_to_timestamp(head)
    utc = F.to_utc_timestamp(read, F.current_timezone())  # as a time of day in UTC, whatever the session's zone
    there = F.when(fixed, F.from_utc_timestamp(utc, zone)).otherwise(read)
    instant = F.unix_timestamp(F.when(fixed, read).otherwise(F.from_utc_timestamp(F.to_utc_timestamp(read, zone), F.current_timezone())))
    starts, names = _names(zone)
    name = F.element_at(F.array(*map(F.lit, names)), F.size(F.filter(F.array(*map(F.lit, starts)), lambda s: s <= instant)))
    shown = F.concat(F.date_format(there, "yyyy-MM-dd HH:mm"), F.lit(" "), name, tail)
    return F.when((F.instr(line, "\t") > 0) & iso & read.isNotNull(), shown).otherwise(line)


def cache_figures(log: DataFrame) -> DataFrame:
    """hits, misses and hit_rate (0 for no request) of a log with a boolean hit."""
    hits, misses = F.count_if("hit"), F.count_if(~F.col("hit"))
    return log.agg(hits.alias("hits"), misses.alias("misses"), F.when(hits + misses > 0, hits / (hits + misses)).otherwise(0.0).alias("hit_rate"))
