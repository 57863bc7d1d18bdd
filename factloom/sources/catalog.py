"""Component catalogue answers: one JSON payload per product.

Fetching is left to the caller; here a payload becomes a row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAYLOAD = (
    "code string, url string, name string, model string, brand string, category string, stock long, library string, "
    "prices array<struct<start string, price string, currency string>>, datasheet string, description string, "
    "attributes array<struct<name string, value string>>"
)
MAX_TIERS = 4
NO_PRICE = "暂无报价"  # fixed value


def normalise(df: DataFrame, payload: str) -> DataFrame:
    staged = df.withColumn("_p", F.from_json(payload, PAYLOAD))
    code = F.coalesce(F.nullif(F.col("_p.code"), F.lit("")), F.regexp_extract("_p.url", r"C[0-9]+", 0))
    tier = lambda t: F.concat(F.coalesce(t["start"], F.lit("?")), F.lit("+: "), F.coalesce(t["currency"], F.lit("$")), F.coalesce(t["price"], F.lit("?")))
    tiers = F.transform(F.slice("_p.prices", 1, MAX_TIERS), tier)
    described = F.transform(
        F.filter(
            F.coalesce("_p.attributes", F.array().cast("array<struct<name:string,value:string>>")),
            lambda a: (F.coalesce(a["name"], F.lit("")) != "") & (F.coalesce(a["value"], F.lit("")) != ""),
        ),
        lambda a: F.concat(F.lit("  - "), a["name"], F.lit(": "), a["value"]),
    )
    return staged.select(
        *[c for c in df.columns if c != payload],
        code.alias("c_number"),
        *[F.coalesce(f"_p.{n}", F.lit("")).alias(n) for n in ("name", "model", "brand", "category", "datasheet", "description")],
        F.coalesce("_p.stock", F.lit(0)).alias("stock"),
        (F.col("_p.library") == "base").alias("is_basic"),
        F.when(F.coalesce(F.size("_p.prices"), F.lit(0)) > 0, F.array_join(tiers, " | ")).otherwise(F.lit(NO_PRICE)).alias("price_str"),
        described.alias("attributes"),
    )
