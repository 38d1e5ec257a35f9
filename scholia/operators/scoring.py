"""Batch scoring by a caller's model."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.functions.text import parse_json_lenient


def build_prompts(df: DataFrame, template: str, columns: list[str], key: str = "doc_id", dimensions: list[str] | None = None) -> DataFrame:
    """key[, dimension], prompt: the template with `{column}` (and `{dimension}`) filled in; nulls become ''."""
    out = df
    if dimensions:
        out = df.withColumn("dimension", F.explode(F.array(*map(F.lit, dimensions))))
    prompt: Column = F.lit(template)
    for c in [*columns, *(["dimension"] if dimensions else [])]:
        prompt = F.replace(prompt, F.lit("{" + c + "}"), F.coalesce(F.col(c).cast("string"), F.lit("")))
    return out.select(key, *(["dimension"] if dimensions else []), prompt.alias("prompt"))


def score_prompts(prompts: DataFrame, fn: Callable[[list[str]], list[str]], size: int = 64) -> DataFrame:
    """Prompts with response and error.  fn gets up to `size` prompts at a time; if it raises, they are tried one by one
    and those that fail keep their error."""

    def one(prompt: str):
        try:
            return fn([prompt])[0], None
        except Exception as e:  # the failure is the result
            return None, f"{type(e).__name__}: {e}"

    def run(batches):
        for pdf in batches:
            for at in range(0, len(pdf), size):
                part = pdf.iloc[at : at + size]
                asked = part["prompt"].tolist()
                try:
                    told = [(r, None) for r in fn(asked)]
                except Exception:  # noqa: BLE001
                    told = [one(p) for p in asked]
                yield part.assign(response=pd.Series([r for r, _ in told], index=part.index, dtype=object), error=pd.Series([e for _, e in told], index=part.index, dtype=object))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema.fields)
    return prompts.mapInPandas(run, f"{fields}, response string, error string")


def validate_scores(df: DataFrame, fields: list[str], default: str = "5", col: str = "response") -> DataFrame:
    """The fields of each response, defaults where it cannot be read, and whether all were there."""
    told = df.withColumn("__s", parse_json_lenient(F.col(col), fields))
    whole = F.lit(True)
    for f in fields:
        whole = whole & F.col("__s")[f].isNotNull()
    return told.select(*df.columns, F.coalesce(whole, F.lit(False)).alias("valid"), *[F.coalesce(F.col("__s")[f], F.lit(default)).alias(f) for f in fields])
