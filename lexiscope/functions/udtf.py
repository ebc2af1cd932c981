"""X-05: a table function for SQL users."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


class ExplodeMatches:
    """(term, start, stop, matched) of every whole-word hit of any of the terms, ignoring case."""

    def eval(self, text: str, terms: list):
        for term in terms or []:
            for m in re.finditer(rf"\b{re.escape(term)}\b", text or "", re.IGNORECASE):
                yield term, m.start(), m.end(), m[0]


def register(spark: SparkSession, name: str = "explode_matches") -> None:
    """SELECT m.* FROM docs, LATERAL explode_matches(text, array('he')) m"""
    spark.udtf.register(name, udtf(ExplodeMatches, returnType="term string, start int, stop int, matched string"))
