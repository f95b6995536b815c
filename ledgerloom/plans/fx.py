"""Exchange rates: what is needed, what a provider gave, and the gaps between."""

from __future__ import annotations

import json
import re
from urllib.request import urlopen

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.fill import forward
from ledgerloom.operators.keyed import insert_missing

#: Codes that the default provider lacks.
UNSUPPORTED = frozenset({"AED", "SAR", "PHP", "IDR", "SGD", "HKD", "CNY", "NZD"})
RATES = "id_date date, currency string, rate_usd double"
CODE = re.compile(r"[A-Z]{3}")


def codes(currencies) -> list[str]:
    """Sorted ISO codes; anything else is an error."""
    out = sorted(set(currencies))
    for c in out:
        if not CODE.fullmatch(c):
            raise ValueError(f"{c!r} is no currency code")
    return out


def needed(accounts: DataFrame, dates: DataFrame, have: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of calendar day and account currency (and extras) that have no rate yet."""
    spark = accounts.sparkSession
    found = accounts.where("currency is not null").select("currency")
    if extra:
        found = found.unionByName(spark.createDataFrame([(c,) for c in codes(extra)], "currency string"))
    pairs = found.distinct().join(dates.agg(F.min("id_date").alias("lo"), F.max("id_date").alias("hi")).where("lo is not null")).select(F.explode(F.sequence("lo", "hi")).alias("id_date"), "currency")
    return pairs.join(have.select("id_date", "currency"), ["id_date", "currency"], "left_anti")


def inverted(quotes: DataFrame) -> DataFrame:
    """Quotes against one dollar as dollars for one unit; quotes of zero or none are skipped."""
    return quotes.where("quote is not null and quote <> 0").select("id_date", "currency", (F.lit(1.0) / F.col("quote")).alias("rate_usd"))


def filled(rates: DataFrame, spine: DataFrame) -> DataFrame:
    """A rate for each day of the spine from each currency's first known day on, the last known carried forward."""
    days = rates.select("currency").distinct().join(spine.agg(F.min("id_date").alias("lo"), F.max("id_date").alias("hi")).where("lo is not null")).select("currency", F.explode(F.sequence("lo", "hi")).alias("id_date"))
    one = rates.groupBy("id_date", "currency").agg(F.max("rate_usd").alias("rate_usd"))
    rows = days.join(one, ["id_date", "currency"], "left")
    return rows.select("id_date", "currency", forward(F.col("rate_usd"), ["currency"], ["id_date"]).alias("rate_usd")).where("rate_usd is not null")


def fetch(spark: SparkSession, since: str, until: str, currencies, url: str, read=None) -> DataFrame:
    """Quotes of a provider that answers ``{"rates": {day: {code: quote}}}``; ``read`` stands in for the network in tests."""
    wanted = [c for c in codes(currencies) if c not in UNSUPPORTED]
    answer = json.loads((read or (lambda u: urlopen(u, timeout=30).read()))(f"{url}/v1/{since}..{until}?base=USD&symbols={','.join(wanted)}")) if wanted else {"rates": {}}
    rows = [(day, c, float(q)) for day, quotes in answer["rates"].items() for c, q in quotes.items()]
    return spark.createDataFrame(rows, "id_date string, currency string, quote double").withColumn("id_date", F.col("id_date").cast("date"))


def enrich(have: DataFrame, quotes: DataFrame, accounts: DataFrame, dates: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Known rates and, for days and currencies without one, the filled quotes."""
    missing = needed(accounts, dates, have, extra)
    fresh = filled(inverted(quotes), dates).join(missing, ["id_date", "currency"], "left_semi")
    return insert_missing(have, fresh, ["id_date", "currency"])
