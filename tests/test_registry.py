"""Every registered query against its SQL, and what the driver relies on."""

from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pytest

import __spark_entry__ as entry_module
from gradeweave.registry.oracle import ORACLE
from gradeweave.registry.queries import QUERIES
from tests.compare import connect, differences

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no driver tables")


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry_module.queries()) and set(ORACLE) <= set(entry_module.oracle_sql())


def test_entry_has_rows_and_stable_columns(spark):
    df = entry_module.entry(spark)
    assert {"student_identifier", "yours", "average"} <= set(df.columns)
    assert not df.isEmpty()


@pytest.fixture(scope="module")
def compared(spark):
    con = connect(FOLDER)

    def check(name):
        try:
            return name, differences(con, spark, FOLDER, name)
        except Exception as e:
            return name, ([f"{type(e).__name__}: {e}"], 0)

    with ThreadPoolExecutor(6) as pool:
        return dict(pool.map(check, sorted(ORACLE)))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(compared, name):
    found, rows = compared[name]
    assert not found, "\n".join(found)
    assert rows > 0 or name == "lost_dashes"
