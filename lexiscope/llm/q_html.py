"""Query op4: main text of all pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiscope.llm.common import table
from lexiscope.llm.html_extract import fit, main_text


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The article's text of every page."""
    pages = table(spark, sf_dir, "pages")
    params = fit(pages)
    texts = pages.select("page_id", "url", main_text(F.col("html"), params).alias("text"))
    return texts.withColumn("n_chars", F.length("text").cast("long"))


QUERIES = {"op4_html_extraction": op4_html_extraction}
ORACLES: dict[str, str] = {}
