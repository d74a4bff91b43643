import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from plumbline.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("checkpoints"))
    session = local_session(4, "4g", spark__sql__shuffle__partitions="4", spark__checkpoint__dir=folder)
    yield session
    session.stop()


@pytest.fixture
def table(spark):
    """Build a table from {"column": [values]} and a schema; rows are keyed 0, 1, 2, ..."""
    from plumbline import as_table

    def build(schema: str, **columns):
        width = len(next(iter(columns.values()))) if columns else 0
        rows = [(i, *[columns[c][i] for c in columns]) for i in range(width)]
        return as_table(spark.createDataFrame(rows, f"rid bigint, {schema}"), "rid", key_is_data=False)

    return build
