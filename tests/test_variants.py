"""Every query against its SQL on empty tables and on tables with hot keys."""

import pytest

import __spark_entry__ as contract
from tarnwork.workload import SQL, full_sql
from tarnwork.plans.quality import EmptySource, NotEnoughRows
from tests import oracle
from tests.tables import variant

SQLS = {name: full_sql(name) for name in SQL}

GATED = {"sink_replace_readback": EmptySource} | dict.fromkeys(
    ("rf_train_score", "rf_vector_score", "ml_run_row", "model_gate"), NotEnoughRows
)


@pytest.fixture(scope="module", params=["hot", "empty"])
def place(request, sf, tmp_path_factory):
    folder = variant(sf, str(tmp_path_factory.mktemp("tables")), request.param)
    return folder, oracle.connection(folder)


@pytest.mark.parametrize("name", sorted(SQLS))
def test_matches_sql(spark, place, name):
    folder, con = place
    if name in GATED and folder.endswith("empty"):
        with pytest.raises(GATED[name]):  # its gate refuses an empty source
            contract.queries()[name](spark, folder)
        return
    df = contract.queries()[name](spark, folder)
    problem = oracle.difference(oracle.spark_rows(df), oracle.sql_rows(con, SQLS[name]))
    assert problem is None, problem
