"""Schemas of the tables that the engine takes in and stores, and a check of a table against one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import IntegerType, MapType, StringType, StructField, StructType

_TEXT, _INT = StringType(), IntegerType()


def _struct(**fields) -> StructType:
    """A schema without a session at hand, which reading it from text would need."""
    return StructType([StructField(name, kind) for name, kind in fields.items()])


METADATA = _struct(title=_TEXT, source=_TEXT, length=_INT, unique_terms=_INT, term_frequencies=MapType(_TEXT, _INT), attributes=MapType(_TEXT, _TEXT))
DOCUMENTS = _struct(id=_TEXT, raw_content=_TEXT, normalized_content=_TEXT, fields=MapType(_TEXT, _TEXT), metadata=METADATA)


def checked(df: DataFrame, schema: StructType) -> DataFrame:
    """The schema's columns of a table, in its order; a column that is missing or of another type is an error."""
    kinds = dict(df.dtypes)
    wrong = [f.name for f in schema if kinds.get(f.name) != f.dataType.simpleString()]
    if wrong:
        raise ValueError(f"missing or of another type: {', '.join(wrong)}")
    return df.select(*schema.names)
