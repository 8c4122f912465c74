"""Plain Python rules as Arrow functions over DataFrames: a batch of strings in, columns out."""

from __future__ import annotations

import functools
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType
from pyspark.sql.pandas.types import to_arrow_schema

from quire.runtime import ship


def refusing(read: Callable[..., dict]) -> Callable[..., dict]:
    """A reader of a binary format whose every failure over its input is a ValueError that names it."""

    @functools.wraps(read)
    def safe(*values):
        try:
            return read(*values)
        except ValueError:
            raise
        except MemoryError:
            raise
        except Exception as e:  # noqa: BLE001  a damaged file may break any step of a reader
            raise ValueError(f"damaged file: {type(e).__name__}: {e}") from e

    return safe


def map_rows(rows: DataFrame, out: str, rule: Callable[..., dict], *inputs: str) -> DataFrame:
    """The columns of rows that aren't inputs, and the columns of out that rule makes from the inputs.

    out is a schema in DDL.  A row for which the rule raises ValueError has nulls and the
    message in ``error``, so one bad document never fails a job.
    """
    ship(rows.sparkSession)
    made = StructType.fromDDL(out)
    rest = [f for f in rows.schema.fields if f.name not in inputs]
    schema = StructType([*rest, *made.fields]).add("error", "string")
    arrow = to_arrow_schema(made)

    def run(batches):
        for batch in batches:
            results, errors = [], []
            for values in zip(*(batch[n].to_pylist() for n in inputs), strict=True):
                try:
                    results.append(rule(*values))
                    errors.append(None)
                except ValueError as e:
                    results.append({})
                    errors.append(str(e))
            columns = [pa.array([r.get(f.name) for r in results], f.type) for f in arrow]
            yield pa.RecordBatch.from_arrays([*(batch[f.name] for f in rest), *columns, pa.array(errors, pa.string())], schema.names)

    return rows.mapInArrow(run, schema)
