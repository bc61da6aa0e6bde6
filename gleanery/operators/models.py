"""Model steps as plug-ins: what a model says joins as columns; without one every step leaves its input as it is.

A model is a function of a pandas frame that gives a frame with the same index. It runs on the executors, batch by batch,
and only on rows that need it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.text import sanitised

Model = Callable[[pd.DataFrame], pd.DataFrame]
FREE_TEXT = ("ingredients", "allergens", "may_contain", "manufacturer_name", "manufacturer_address", "place_of_origin")
TRANSLATED = ("allergens", "may_contain")


def _run(rows: DataFrame, model: Model, inputs: list[str], outputs: tuple[str, ...], keep_old: bool, error: str | None) -> DataFrame:
    """rows with the outputs replaced by what the model gives; where it gives nothing, or fails, the old value stays.

    error names a text column that gets what went wrong, for each row of a batch that the model failed on.
    """
    if error and error not in rows.columns:
        rows = rows.withColumn(error, F.lit(None).cast("string"))
    names = rows.columns

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            try:
                said = model(b[inputs])
            except Exception as e:  # noqa: BLE001  a model that fails must not fail the job
                said = pd.DataFrame(index=b.index)
                if error:
                    b[error] = f"{type(e).__name__}: {e}"
            for c in outputs:
                if c in said:
                    new = said[c].where(said[c].notna() & (said[c] != ""), b[c])
                    b[c] = b[c].where(b[c].notna() & (b[c] != ""), new) if keep_old else new
            yield b[names]

    return rows.mapInPandas(each, rows.schema)


def fill_missing(rows: DataFrame, text: str, model: Model | None = None, fields: tuple[str, ...] = FREE_TEXT, least: int = 200, error: str | None = None) -> DataFrame:
    """Fields still empty, from pages' texts of at least `least` characters."""
    if model is None:
        return rows
    empty = F.lit(False)
    for f in fields:
        empty = empty | (F.coalesce(F.col(f), F.lit("")) == "")
    due = F.coalesce(empty & (F.length(text) >= least), F.lit(False))
    return rows.where(~due).unionByName(_run(rows.where(due), model, [text, *fields], fields, True, error), allowMissingColumns=True)


def translate(rows: DataFrame, model: Model | None = None, fields: tuple[str, ...] = TRANSLATED, error: str | None = None) -> DataFrame:
    """The fields in the model's words; the old ones where it has none."""
    return rows if model is None else _run(rows, model, list(fields), fields, False, error)


def classify(rows: DataFrame, inputs: list[str], outputs: tuple[str, ...], model: Model | None = None, own: tuple[str, ...] = (), error: str | None = None) -> DataFrame:
    """rows with text columns that a classifier fills; those that the record has itself keep its values."""
    new = tuple(c for c in outputs if c not in own)
    rows = rows.withColumns({c: F.lit(None).cast("string") for c in new if c not in rows.columns})
    return rows if model is None else _run(rows, model, inputs, new, False, error)


def answer_object(answer: Column) -> Column:
    """The JSON object in a model's answer: from its first brace to its last; null without one that can be read."""
    body = F.nullif(F.regexp_extract(answer, r"(?s)\{.*\}", 0), F.lit(""))
    return F.when(F.from_json(body, "map<string,string>").isNotNull(), body)


def answer_columns(answer: Column, keys: tuple[str, ...]) -> list[Column]:
    """The keys of a model's answer as text columns, lists and objects as JSON; empty where there is none, or a word for none."""
    said = F.from_json(answer_object(answer), "map<string,string>")
    return [sanitised(F.trim(said[k])).alias(k) for k in keys]
