"""Demo trades: a row for each symbol, day, trading hour, minute and trade of that minute, made by arithmetic on the row's number alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SYMBOLS = ("AMBER", "BIRCH", "CEDAR")
#: Trading hours of a day (UTC).
OPENS, HOURS = 13, 7


def trades(spark: SparkSession, start: str = "2026-01-01", days: int = 30, per_minute: int = 4) -> DataFrame:
    """(ts, symbol, price, quantity): days * 3 symbols * 7 hours * 60 minutes * per_minute rows."""
    minutes = HOURS * 60
    i = F.col("id")
    symbol = F.pmod(i, F.lit(len(SYMBOLS))).cast("int")
    tick = F.floor(i / len(SYMBOLS))
    minute, k = F.floor(tick / per_minute), F.pmod(tick, F.lit(per_minute))
    seconds = F.floor(minute / minutes) * 86_400 + OPENS * 3600 + F.pmod(minute, F.lit(minutes)) * 60 + F.floor(k * 60 / per_minute)
    ts = F.timestamp_add("SECOND", seconds, F.lit(start).cast("timestamp_ntz"))
    price = 100 + 50 * symbol + F.pmod(i * 7919 + 104_729, F.lit(1999)) / 100
    rows = spark.range(days * minutes * per_minute * len(SYMBOLS))
    return rows.select(ts.alias("ts"), F.get(F.array(*map(F.lit, SYMBOLS)), symbol).alias("symbol"), price.alias("price"), (1 + F.pmod(i * 31, F.lit(97))).alias("quantity"))
