"""Sinks: Parquet and CSV, and a workbook where its library is installed."""

from __future__ import annotations

from pyspark.sql import DataFrame

from gleanery.operators import export


def write_parquet(df: DataFrame, path: str, by: list[str] | None = None, mode: str = "overwrite") -> None:
    w = df.write.mode(mode)
    (w.partitionBy(*by) if by else w).parquet(path)


def write_csv(df: DataFrame, path: str, clusters: list[list[str]], mode: str = "overwrite") -> None:
    """The sanitised export, columns ordered by cluster."""
    clean = export.sanitised(df)
    clean.select(*export.ordered(clean.columns, clusters)).write.mode(mode).option("header", True).csv(path)


def write_workbook(df: DataFrame, path: str, clusters: list[list[str]], most: int = 100_000) -> int:
    """The sanitised export as a workbook of one sheet, with clusters told in the first row; needs openpyxl.

    Rows are taken to the driver one partition at a time. A frame of over `most` rows is refused: a workbook is no sink for it.
    """
    from openpyxl import Workbook

    clean = export.sanitised(df)
    names = export.ordered(clean.columns, clusters)
    if clean.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows; write Parquet or CSV")
    of = {c: i + 1 for i, cluster in enumerate(clusters) for c in cluster}
    book = Workbook(write_only=True)
    sheet = book.create_sheet("products")
    sheet.append([of.get(c, 0) for c in names])
    sheet.append(names)
    n = 0
    for row in clean.select(*names).toLocalIterator():
        sheet.append(list(row))
        n += 1
    book.save(path)
    return n
