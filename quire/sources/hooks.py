"""User parsers as table functions: a class that turns a row into elements.

A hook is any class with ``iter_elements(row)``: it gets a dict of the row's columns and
yields a dict for each element, none to many, with canonical field names.  Registered by
name it runs in SQL (``SELECT ... FROM raw, LATERAL name(...)``) and in :func:`apply_hook`.
Spark evaluates a table function row by row and makes an Arrow table for each, which takes
milliseconds; :func:`apply_hook` therefore passes whole Arrow batches.  The class is sent to executors by value, so they need nothing but what
it imports itself.  An exception in a hook becomes a row with ``hook_error`` and does not
end the job.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from quire.schema import ELEMENT_COLUMNS

#: What a hook may not set: the key of its row.
KEY = ("doc_id",)
FIELDS = {name: kind for name, kind in ELEMENT_COLUMNS.items() if name not in KEY}
#: Rows that are held at a time.
ROWS = 256
#: Registered classes by session and name, for batches.
_REGISTERED: dict[tuple[str, str], type] = {}


def _table_function(hook: type, columns: tuple[str, ...], fields: tuple[str, ...]) -> type:
    """A class for Spark, made so that it holds all it needs and refers to no module of this package."""

    class TableFunction:
        def __init__(self) -> None:
            self.hook = hook()

        def eval(self, *row):
            try:
                found = []
                for k, element in enumerate(self.hook.iter_elements(dict(zip(columns, row))) or ()):
                    unknown = set(element) - set(fields)
                    if unknown:
                        raise ValueError(f"unknown fields: {', '.join(sorted(unknown))}")
                    found.append((*[element.get(f, k if f == "element_index" else None) for f in fields], None))
            except Exception as error:
                found = [(*[None] * len(fields), f"{type(error).__name__}: {error}")]
            yield from found

    return TableFunction


def _over_batches(function: type, given: T.StructType, found: T.StructType, rows: int) -> Callable:
    """A table function over Arrow batches (doc_id and the columns of ``given``); it too refers to no module of this package."""

    def batches(iterator):
        import pyarrow as pa
        from pyspark.sql.conversion import ArrowTableToRowsConversion, LocalDataToArrowConversion
        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.sql.types import StructType

        target = to_arrow_schema(found)
        made = function()

        def table(ids, owners: list, elements: list) -> pa.RecordBatch:
            columns = list(zip(*elements))
            used = [k for k, values in enumerate(columns) if any(v is not None for v in values)]
            converted = {}
            if used:
                part = LocalDataToArrowConversion.convert(list(zip(*[columns[k] for k in used])), StructType([found[k] for k in used]), False)
                converted = {k: part.column(i).combine_chunks() for i, k in enumerate(used)}
            fields = [converted[k] if k in converted else pa.nulls(len(elements), f.type) for k, f in enumerate(target)]
            return pa.RecordBatch.from_arrays([ids.take(pa.array(owners, pa.int64())), *fields], names=["doc_id", *target.names])

        for batch in iterator:
            ids = batch.column(0)
            own = pa.Table.from_arrays(batch.columns[1:], names=given.names)
            owners, elements = [], []
            for at in range(0, batch.num_rows, rows):
                for k, row in enumerate(ArrowTableToRowsConversion.convert(own.slice(at, rows), given), at):
                    for element in made.eval(*row):
                        owners.append(k)
                        elements.append(element)
                        if len(elements) >= rows:
                            yield table(ids, owners, elements)
                            owners, elements = [], []
            if elements:
                yield table(ids, owners, elements)

    return batches


def _found() -> T.StructType:
    """What a hook yields, with the message of an exception."""
    return T.StructType.fromDDL(", ".join(f"{k} {v}" for k, v in FIELDS.items()) + ", hook_error string")


def register_hook(spark: SparkSession, name: str, hook: type, columns: tuple[str, ...]) -> None:
    """Register a hook under ``name``, for rows of ``columns`` in this order.

    Registering again under the same name replaces the former hook.
    """
    if not re.fullmatch("[A-Za-z_][A-Za-z0-9_]*", name):
        raise ValueError(f"not a name for a function: {name!r}")
    if not callable(getattr(hook, "iter_elements", None)):
        raise TypeError("a hook needs a method iter_elements")
    made = _table_function(hook, tuple(columns), tuple(FIELDS))
    spark.udtf.register(name, F.udtf(made, returnType=_found(), useArrow=True))
    _REGISTERED[_key(spark, name)] = made


def _key(spark: SparkSession, name: str) -> tuple[str, str]:
    return spark._jsparkSession.sessionUUID(), name.lower()


def apply_hook(raw: DataFrame, name: str, columns: tuple[str, ...]) -> DataFrame:
    """Elements of ``raw`` (doc_id and ``columns``) by a registered hook, with ``hook_error``.

    Rows for which the hook yields nothing give no element.  Narrow: no shuffle.
    """
    spark = raw.sparkSession
    made = _REGISTERED.get(_key(spark, name))
    if made is None:
        # Registered with another session of the same functions.
        given = ", ".join(f"r.`{c}`" for c in columns)
        fields = ", ".join(f"h.`{c}`" for c in FIELDS)
        return spark.sql(f"SELECT r.doc_id, {fields}, h.hook_error FROM {{raw}} AS r, LATERAL {name}({given}) AS h", raw=raw)
    # Names of their own, as a column may be given twice.
    rows = raw.select("doc_id", *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(columns)])
    given = T.StructType(rows.schema.fields[1:])
    return rows.mapInArrow(_over_batches(made, given, _found(), ROWS), T.StructType([rows.schema["doc_id"], *_found().fields]))
