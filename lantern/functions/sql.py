"""Functions for SQL: pii_scan (a table function), pii_score and pii_redact. For ad-hoc queries; tables are better served by the operators."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..session import ship_package


def register_all(spark: SparkSession) -> None:
    """``SELECT * FROM pii_scan('text')``, ``SELECT pii_score(text), pii_redact(text) FROM t``."""
    ship_package(spark)

    @F.udtf(returnType="type string, value string, start_index int, end_index int, severity string")
    class PiiScan:
        def eval(self, text: str):
            from lantern.functions import plain

            for f in plain.resolved(plain.scan_text(text)):
                yield f["type"], f["value"], f["start"], f["end"], f["severity"]

    @F.pandas_udf("int")
    def pii_score(texts: pd.Series) -> pd.Series:
        from lantern.functions import plain

        return texts.map(lambda t: plain.score_of(plain.resolved(plain.scan_text(t))))

    @F.pandas_udf("string")
    def pii_redact(texts: pd.Series) -> pd.Series:
        from lantern.functions import plain

        return texts.map(plain.redact_text)

    spark.udtf.register("pii_scan", PiiScan)
    spark.udf.register("pii_score", pii_score)
    spark.udf.register("pii_redact", pii_redact)
