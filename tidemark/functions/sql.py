"""The engine's functions under names of their own in a session's SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf


def register(spark: SparkSession) -> list[str]:
    """Register scalar functions (plain SQL bodies, which the optimizer sees through), a grouped one and the chunker
    as a table function; gives their names."""
    bodies = {
        "tm_growth_pct(new DOUBLE, old DOUBLE) RETURNS DOUBLE": "CASE WHEN old > 0 THEN (new / old - 1) * 100 END",
        "tm_growth_bucket(pct DOUBLE) RETURNS STRING": "CASE WHEN pct >= 15 THEN 'strong' WHEN pct >= 5 THEN 'growing' WHEN pct >= -5 THEN 'flat' WHEN pct IS NOT NULL THEN 'declining' END",
        "tm_sentiment_label(mean DOUBLE) RETURNS STRING": "CASE WHEN mean > 0.15 THEN 'positive' WHEN mean < -0.15 THEN 'negative' WHEN mean IS NOT NULL THEN 'neutral' END",
        "tm_net_spread(gross DOUBLE, bps DOUBLE) RETURNS DOUBLE": "abs(gross) - 4 * bps / 1e4",
    }
    for head, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")

    @F.pandas_udf("double")
    def tm_max_drawdown(values: pd.Series) -> float:
        return float((values / values.cummax() - 1).min()) if len(values) else float("nan")

    @udtf(returnType="chunk_index int, content string")
    class Chunks:
        def eval(self, text: str, size: int, overlap: int):
            from tidemark.operators.rag import chunk

            yield from enumerate(chunk(text, size, overlap))

    spark.udf.register("tm_max_drawdown", tm_max_drawdown)
    spark.udtf.register("tm_chunks", Chunks)
    return [*(head.split("(")[0] for head in bodies), "tm_max_drawdown", "tm_chunks"]
