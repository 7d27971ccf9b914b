"""CSV and search-hit sources, a cached table, and the checks they share."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Sequence
from functools import reduce
from operator import and_, or_

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from oddlog.functions.rows import quoted
from oddlog.functions.text import word_tokens
from oddlog.operators.order import with_position
from oddlog.sources.records import QUOTE, records

# Cells a string-typed CSV reader still takes for missing.
NA_WORDS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def require_columns(df: DataFrame, columns: Iterable[str] | None, where: str) -> None:
    """Fail before any job when a wanted column is absent."""
    missing = [c for c in columns or () if c not in df.columns]
    if missing:
        raise ValueError(f"Requested columns not available in {where}: {missing}")


class CachedTable:
    """A source that keeps its table until told to reload or given another."""

    _table: DataFrame | None = None

    def load(self, columns: Sequence[str] | None = None) -> DataFrame:
        raise NotImplementedError

    def get_df(self, force_reload: bool = False, columns: Sequence[str] | None = None) -> DataFrame:
        if self._table is None or force_reload:
            self.set_df(self.load(columns))
        return self._table

    def set_df(self, df: DataFrame) -> DataFrame:
        if self._table is not None:
            self._table.unpersist()
        self._table = df.persist(StorageLevel.MEMORY_AND_DISK)
        return self._table


class CsvSource(CachedTable):
    """Header CSV with every column as text.

    Quoted cells may hold line breaks, and a large file is still read by many tasks (see `records`): splits are those
    of ``spark.sql.files.maxPartitionBytes``.
    """

    def __init__(self, spark: SparkSession, path: str, sep: str = ","):
        self.spark, self.path, self.sep = spark, path, sep

    def _placed(self, columns: Sequence[str] | None) -> DataFrame:
        options = {"sep": self.sep, "escape": QUOTE}
        names = self.spark.read.options(**options, header=True, inferSchema=False, multiLine=True).csv(self.path).columns
        missing = [c for c in columns or () if c not in names]
        if missing:
            raise ValueError(f"Requested columns not available in csv data: {missing}")
        if not names:
            return self.spark.createDataFrame([], "_file string, _start bigint, _line bigint")
        schema = T.StructType([T.StructField(f"c{k}", T.StringType()) for k in range(len(names))])
        found = records(self.spark, self.path, self.sep)
        cells = found.select("_file", "_start", "_line", F.from_csv("_text", schema.simpleString()[7:-1].replace(":", " "), options).alias("_row"))
        cell = lambda k: F.col("_row")[f"c{k}"]
        return cells.select("_file", "_start", "_line", *[F.when(~cell(k).isin(*NA_WORDS), cell(k)).alias(n) for k, n in enumerate(names)])

    def load(self, columns: Sequence[str] | None = None) -> DataFrame:
        return self._placed(columns).drop("_file", "_start", "_line")

    def load_in_order(self, columns: Sequence[str] | None = None, out: str = "row_id") -> tuple[DataFrame, int]:
        """The table with its 0-based line position over all files, by path."""
        placed, n = with_position(self._placed(columns), ["_file", "_start", "_line"], out)
        return placed.drop("_file", "_start", "_line"), n


def flatten(df: DataFrame, sep: str = ".") -> DataFrame:
    """Nested structs to flat columns with dotted names; arrays stay."""

    def leaves(schema: T.StructType, path: list[str]):
        for field in schema.fields:
            here = [*path, field.name]
            if isinstance(field.dataType, T.StructType):
                yield from leaves(field.dataType, here)
            else:
                source = F.col(".".join("`" + p.replace("`", "``") + "`" for p in here))
                yield source.alias(sep.join(here))

    return df.select(*leaves(df.schema, []))


def _field(df: DataFrame, name: str) -> tuple[Column, T.DataType]:
    """A field and its type; one that no record has is a null, which nothing matches."""
    if name in df.columns:
        return quoted(name), df.schema[name].dataType
    return F.lit(None).cast("string"), T.StringType()


def _compare(df: DataFrame, name: str, test) -> Column:
    """``test(value, type)`` of a field; for a list, whether any entry passes."""
    column, kind = _field(df, name)
    if isinstance(kind, T.ArrayType):
        return F.exists(column, lambda x: F.coalesce(test(x, kind.elementType), F.lit(False)))
    return test(column, kind)


def _equals(value):
    """Equality with a literal brought to the field's type."""

    def test(column: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StringType):
            return column == F.lit(str(value).lower() if isinstance(value, bool) else str(value))
        return column == F.lit(value).try_cast(kind)

    return test


def _within(op: str, value):
    """A bound, by time where the field is a time or two texts are compared."""

    def test(column: Column, kind: T.DataType) -> Column:
        literal = F.lit(value)
        if isinstance(kind, T.TimestampType) or (isinstance(kind, T.StringType) and isinstance(value, str)):
            column, literal = column.try_cast("timestamp"), literal.cast("timestamp")
        return {"gte": column >= literal, "lte": column <= literal, "gt": column > literal, "lt": column < literal}[op]

    return test


WORDS = r"[\p{L}\p{N}_]+"


def _term(df: DataFrame, body: dict, keywords: Sequence[str]) -> Column:
    ((name, value),) = body.items()
    return _compare(df, name, _equals(value))


def _range(df: DataFrame, body: dict, keywords: Sequence[str]) -> Column:
    ((name, limits),) = body.items()
    return reduce(and_, [_compare(df, name, _within(op, value)) for op, value in limits.items()])


def _query_string(df: DataFrame, body: dict, keywords: Sequence[str]) -> Column:
    """Any word of a plain text in any of the fields; the whole text in a keyword field. No operators."""
    text = body["query"]
    words = list(dict.fromkeys(re.findall(r"\w+", text.lower())))

    def test(name: str):
        if name in keywords:
            return _equals(text)
        return lambda column, kind: F.arrays_overlap(word_tokens(column.cast("string"), WORDS), F.array(*map(F.lit, words)).cast("array<string>"))

    return reduce(or_, [F.coalesce(_compare(df, name, test(name)), F.lit(False)) for name in body["fields"]])


def _bool(df: DataFrame, body: dict, keywords: Sequence[str]) -> Column:
    """All of filter and none of must_not; a row with a null field is not excluded."""
    out = F.lit(True)
    for part, clauses in body.items():
        if part not in ("filter", "must_not"):
            raise ValueError(f"{part!r} is no part of a stored query here: give it as a Spark condition (where=)")
        for c in [clauses] if isinstance(clauses, dict) else clauses:
            met = _clause(df, c, keywords)  # bare, so that a filter reaches the scan
            out = out & (met if part == "filter" else ~F.coalesce(met, F.lit(False)))
    return out


# The clauses stored queries use; any other condition is a Spark one.
_CLAUSES = {"term": _term, "range": _range, "query_string": _query_string, "bool": _bool}


def _clause(df: DataFrame, clause: dict, keywords: Sequence[str]) -> Column:
    if len(clause) != 1 or next(iter(clause)) not in _CLAUSES:
        raise ValueError(f"{sorted(clause)} is no clause of a stored query here: give it as a Spark condition (where=)")
    ((kind, body),) = clause.items()
    return _CLAUSES[kind](df, body, keywords)


class HitSource(CachedTable):
    """Exported search hits: one JSON object per line, or a nested table.

    ``query`` takes the stored-query shape: a ``_source`` list and a query of
    the clauses in ``_CLAUSES``; a field that no record has matches nothing.
    ``where`` is any further condition, a Spark SQL string or a column, over
    the flat columns.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str | None = None,
        query: dict | str | None = None,
        table: DataFrame | None = None,
        max_docs: int | None = None,
        order_by: Sequence[str] = ("_id",),
        keywords: Sequence[str] = (),
        partitions: int | None = None,
        schema: T.StructType | str | None = None,
        where: str | Column | None = None,
    ):
        self.spark, self.path, self.table, self.schema, self.where = spark, path, table, schema, where
        self.query = json.loads(query) if isinstance(query, str) else query
        self.max_docs, self.order_by, self.keywords, self.partitions = max_docs, list(order_by), keywords, partitions

    def load(self, columns: Sequence[str] | None = None) -> DataFrame:
        nested = self.table
        if nested is None:
            reader = self.spark.read if self.schema is None else self.spark.read.schema(self.schema)
            nested = reader.json(self.path)
        meta = [c for c in ("_id", "_index") if c in nested.columns]
        flat = flatten(nested.select("_source.*", *meta))
        if self.query is not None and "query" in self.query:
            flat = flat.filter(_clause(flat, self.query["query"], self.keywords))
        if self.where is not None:
            flat = flat.filter(self.where)
        if self.query is not None and self.query.get("_source"):
            wanted = [c for c in self.query["_source"] if c in flat.columns]
            flat = flat.select(*[quoted(c) for c in dict.fromkeys([*wanted, *meta])])
        if self.max_docs:
            flat = flat.orderBy(*[quoted(c) for c in self.order_by]).limit(self.max_docs)
        if columns and any(c not in flat.columns for c in columns) and not flat.isEmpty():
            require_columns(flat, columns, "hit data")
        return flat.repartition(self.partitions) if self.partitions else flat
