"""Prices and costs of model calls. Prices are a small table: ord, prefix and rates per million tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RATES = ("input", "output", "cache_read", "cache_write_5m", "cache_write_1h")


def price_schema() -> str:
    return "ord int, prefix string, " + ", ".join(f"{r} double" for r in RATES)


def priced(df: DataFrame, prices: DataFrame, model: str = "model", most: int = 10_000) -> DataFrame:
    """Each row with the rates of the first prefix, by ord, that its model begins with; priced is false where there is none.

    Models are few beside rows: the prefixes are joined to the distinct models, then by equality.
    """
    if prices.count() > most:
        raise ValueError("a price table of this size is not broadcast")
    models = df.select(model).distinct()
    found = models.join(F.broadcast(prices), F.col(model).startswith(F.col("prefix")))
    best = found.groupBy(model).agg(F.min_by(F.struct(*RATES), "ord").alias("price"))
    return df.join(best, model, "left").withColumn("priced", F.col("price").isNotNull())


def cost(input: Column, output: Column, cache_read: Column, write_5m: Column, write_1h: Column, price: Column = None) -> Column:
    """Dollars; 0 without a price."""
    price = F.col("price") if price is None else price
    parts = zip(RATES, (input, output, cache_read, write_5m, write_1h))
    total = sum((F.coalesce(n, F.lit(0)) * price[r] for r, n in parts), F.lit(0.0)) / 1e6
    return F.coalesce(total, F.lit(0.0))


def ledger_writes(usage: Column) -> tuple[Column, Column]:
    """Tokens written to the five-minute and to the hour cache: the split's, or all of them for the first."""
    split = usage["cache_creation"]
    return F.coalesce(split["ephemeral_5m_input_tokens"], usage["cache_creation_input_tokens"], F.lit(0)), F.coalesce(split["ephemeral_1h_input_tokens"], F.lit(0))


def waste_writes(usage: Column) -> tuple[Column, Column]:
    """The same from the total and the hour's part alone."""
    hour = F.coalesce(usage["cache_creation"]["ephemeral_1h_input_tokens"], F.lit(0))
    return F.coalesce(usage["cache_creation_input_tokens"], F.lit(0)) - hour, hour


def month_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")
