import pytest

from compare import oracle_rows, spark_rows
from kinloom.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_same_rows_as_sql(spark, name):
    assert spark_rows(catalog.queries()[name](spark, SF)) == oracle_rows(catalog.oracle_sql()[name], SF)
