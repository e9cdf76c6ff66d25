"""Request bodies as JSON text: parse with an explicit schema, default and clamp."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "k bigint, costing string"


def parse_requests(requests: DataFrame, body: str = "props", low: int = 10, high: int = 60) -> DataFrame:
    """(event_id, k, clamped, costing); a body that isn't JSON gives nulls and the default costing."""
    parsed = requests.withColumn("o", F.from_json(body, SCHEMA))
    return parsed.select("event_id", F.col("o.k").alias("k"), F.least(F.greatest("o.k", F.lit(low)), F.lit(high)).alias("clamped"), F.coalesce("o.costing", F.lit("auto")).alias("costing"))
