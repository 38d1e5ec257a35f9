"""Documents as rows of lines, and helpers on them."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: characters of text whose rows are held before they are handed on.
HELD_CHARS = 1 << 20


def lines_of(docs: DataFrame, limit: int | None = None, text_col: str = "text") -> DataFrame:
    """doc_id, line_no (from 0), line.  A limit cuts the array before it is exploded."""
    parts = F.split(text_col, "\n")
    if limit is not None:
        parts = F.slice(parts, 1, limit)
    return docs.select("doc_id", F.posexplode(parts).alias("line_no", "line"))


def once(df: DataFrame, *keep: str, **made: Column) -> DataFrame:
    """df's columns `keep` with the columns made, each evaluated once a row: they pass through a
    generator of one row, into which the optimizer does not copy the expressions that use them."""
    return df.select(*keep, F.inline(F.array(F.struct(*[v.alias(k) for k, v in made.items()]))))


def each_text(docs: DataFrame, rows: Callable[[str], Iterable[tuple]], **columns: str) -> DataFrame:
    """doc_id and the columns (int, double or string), a row for each tuple that rows(text) gives of docs' texts, a null one being empty.  They are
    handed on whenever the texts reach HELD_CHARS, so what a task holds does not follow its rows."""
    kinds = [{"int": pa.int32(), "double": pa.float64(), "string": pa.string()}[k] for k in columns.values()]

    def run(batches):
        for batch in batches:
            ids, at, made, size = batch["doc_id"], [], [], 0
            for k, text in enumerate(batch["text"]):
                text = text.as_py() or ""
                size += len(text)
                for row in rows(text):
                    at.append(k)
                    made.append(row)
                if size >= HELD_CHARS or k + 1 == len(batch):
                    told = zip(*made) if made else [()] * len(kinds)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(told, kinds))], names=["doc_id", *columns])
                    at, made, size = [], [], 0

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, ", ".join([f"doc_id {kind}", *(f"{c} {k}" for c, k in columns.items())]))


def in_order(value: Column, *order: str) -> Column:
    """An aggregate: value of each row, ordered by the columns named."""
    pairs = F.collect_list(F.struct(*[F.col(c) for c in order], value.alias("v")))
    return F.transform(F.sort_array(pairs), lambda x: x["v"])


def doc_window(*order: str):
    return Window.partitionBy("doc_id").orderBy(*order)
