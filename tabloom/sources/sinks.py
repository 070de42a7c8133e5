"""Writers for predictions and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_predictions(predictions: DataFrame, folder: str, form: str = "parquet") -> None:
    """Parquet by default, or CSV with a header per part file (UTF-8 without a byte-order mark)."""
    writer = predictions.write.mode("overwrite")
    if form == "csv":
        writer.option("header", True).option("escape", '"').csv(folder)
    elif form == "parquet":
        writer.parquet(folder)
    else:
        raise ValueError("form must be parquet or csv")


def write_report(facts: DataFrame, lines: DataFrame, folder: str) -> None:
    """Facts as parquet and the Markdown lines as one text file: a few rows per column of the table."""
    facts.write.mode("overwrite").parquet(f"{folder}/facts")
    lines.orderBy("ord").select("line").coalesce(1).write.mode("overwrite").text(f"{folder}/report")
