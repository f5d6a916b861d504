import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from parcelweave.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    made = session("local[4]", 4, **{"spark.driver.memory": "3g", "spark.ui.showConsoleProgress": "false"})
    made.sparkContext.setLogLevel("ERROR")
    return made


@pytest.fixture(scope="session")
def frame(spark):
    """Rows of dicts or tuples under a schema string."""

    def make(schema: str, *rows):
        names = [part.strip().split(" ", 1)[0] for part in _split(schema)]
        return spark.createDataFrame([tuple(r.get(n) for n in names) if isinstance(r, dict) else r for r in rows], schema)

    return make


def _split(schema: str) -> list[str]:
    parts, depth, at = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            parts.append(schema[at:i])
            at = i + 1
    return [*parts, schema[at:]]


@pytest.fixture(scope="session")
def source(spark):
    """A source table by name, from dicts of the columns that matter; dates may be text."""
    import datetime as dt

    from pyspark.sql import types as T

    from parcelweave.sources import schemas

    def make(name: str, *rows: dict):
        schema = T.StructType.fromDDL(schemas.INDICATORS) if name == "indicators" else schemas.schema(name)

        def cell(field, row):
            x = row.get(field.name)
            if isinstance(x, str) and isinstance(field.dataType, T.DateType):
                return dt.date.fromisoformat(x)
            return float(x) if isinstance(field.dataType, T.DoubleType) and x is not None else x

        unknown = {k for r in rows for k in r} - set(schema.names)
        assert not unknown, unknown
        return spark.createDataFrame([tuple(cell(f, r) for f in schema) for r in rows], schema)

    return make


@pytest.fixture(scope="session")
def sources(source):
    """All source tables; empty but for those given."""
    from parcelweave.sources.schemas import SOURCES

    def make(**rows):
        return {name: source(name, *rows.get(name, ())) for name in SOURCES}

    return make
