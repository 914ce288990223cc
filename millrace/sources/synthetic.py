"""Dirty customer records at any scale, each row a function of its number and the seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What records are made of.
FIRST = "Ada Ben Cleo Dan Eva Finn Gwen Hugo Iris Jack Kara Liam Mona Nils Olga Paul".split()
LAST = "Abbot Baker Carter Dyer Eaton Fisher Gray Hunter Irwin Joyner Keller Lane Mason Nash Otis Potter".split()
CITIES = ["Ashford", "Brightwater", "Cedar Falls", "Dunmore", "Eastgate", "Fairview", "Glenwood", "Harborne"]
STATES = "WA OR NV UT CO KS MO TN KY VT".split()
INDUSTRIES = "Mining Farming Shipping Banking Printing Weaving Brewing Teaching".split()
STATUSES = "open closed paused new".split()


def customers(spark: SparkSession, rows: int, seed: int = 42, dirty: float = 0.2, repeated: float = 0.05, nested: bool = False) -> DataFrame:
    """So many dirty records; see records."""
    return records(spark.range(rows), seed, dirty, repeated, nested)


def records(ids: DataFrame, seed: int = 42, dirty: float = 0.2, repeated: float = 0.05, nested: bool = False) -> DataFrame:
    """A record for each id (id): customer_id to account_status, with nulls, typos, outliers and padding in a share of rows and repeated keys in another.

    nested: also extra_field in a tenth of the rows and a nested struct in a
    twentieth. A draw is 32 bits of the md5 of its name, the seed and the id, so
    that any engine can tell the same records.
    """

    def draw(name: str) -> Column:
        return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(name), F.lit(str(seed)), F.col("id").cast("string"))), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))

    def pick(name: str, values: list[str]) -> Column:
        return F.array(*map(F.lit, values))[F.floor(draw(name) * len(values)).cast("int")]

    def number(name: str, low: int, high: int) -> Column:
        return (low + F.floor(draw(name) * (high - low + 1))).cast("string")

    noise = F.when(draw("dirty") < dirty, draw("noise")).otherwise(1.0)
    hole = lambda k: (noise >= 0.05) & (noise < 0.15) & (F.floor(draw("hole") * 4) == k)
    pad = lambda c: F.when((noise >= 0.30) & (noise < 0.35), F.concat(F.lit("  "), c, F.lit("  "))).otherwise(c)
    typo = lambda c, k: F.when((noise >= 0.15) & (noise < 0.25) & (F.floor(draw("field") * 2) == k), F.concat(F.substring(c, 1, 1), c)).otherwise(c)
    key = F.when((draw("repeat") < repeated) & (F.col("id") > 0), F.floor(draw("which") * F.col("id"))).otherwise(F.col("id"))
    first, last = pick("first", FIRST), pick("last", LAST)
    spend = F.when((noise >= 0.25) & (noise < 0.30), 50_000 + draw("spend") * 950_000).otherwise(100 + draw("spend") * 49_900)
    columns = {
        "customer_id": F.concat(F.lit("CUST-"), F.lpad(key.cast("string"), 9, "0")),
        "first_name": pad(typo(first, 0)),
        "last_name": pad(typo(last, 1)),
        "email": F.when(~hole(0), F.concat(F.lower(first), F.lit("."), F.lower(last), F.lit("@example.com"))),
        "phone": F.when(~hole(1), F.concat_ws("-", F.lit("+1"), number("p1", 200, 999), number("p2", 2000, 9999), number("p3", 1000, 9999))),
        "city": F.when(~hole(2), pick("city", CITIES)),
        "state": pick("state", STATES),
        "zip_code": number("zip", 10_000, 99_999),
        "industry": F.when(~hole(3), pick("industry", INDUSTRIES)),
        "signup_date": F.date_format(F.date_add(F.lit("2022-01-01").cast("date"), F.floor(draw("date") * 1000).cast("int")), "yyyy-MM-dd"),
        "total_spend": F.round(spend, 2),
        "account_status": pick("status", STATUSES),
    }
    if nested:
        columns["extra_field"] = F.when(draw("extra") < 0.1, F.concat(F.lit("extra_"), F.col("id")))
        columns["nested"] = F.when(draw("nest") < 0.05, F.struct(F.struct(F.concat(F.lit("v"), F.col("id")).alias("level2")).alias("level1")))
    return ids.select(*[c.alias(n) for n, c in columns.items()])
