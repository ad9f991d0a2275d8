"""Explicit schemas of the tables the operators read and write."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import DataType, StructType

TABLES = {
    "ground_truth": "email_id string, label string, dataset_source string, labeled_at timestamp",
    "raw_email_event": "schemaVersion int, emailId string, senderKey string, sender string, senderDomain string, "
    "contentHashHex string, ingestSource string",
}


def schema(table: str) -> StructType:
    return StructType.fromDDL(TABLES[table])


def require(df: DataFrame, table: str) -> DataFrame:
    """Project ``df`` to a table's columns, failing on a missing column or a different type."""
    wanted = schema(table)
    have: dict[str, DataType] = {f.name: f.dataType for f in df.schema.fields}
    problems = [
        f"{f.name}: want {f.dataType.simpleString()}, have {have[f.name].simpleString() if f.name in have else 'none'}"
        for f in wanted.fields
        if f.name not in have or have[f.name].simpleString() != f.dataType.simpleString()
    ]
    if problems:
        raise ValueError(f"table {table} does not match its schema: " + "; ".join(problems))
    return df.select(*[f.name for f in wanted.fields])
