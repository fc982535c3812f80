"""Training rows: made part by part, without exchanges that stay on the disk; judged rows that are joined once."""

import datetime
import random

import pytest

from tarnwork.plans import ml
from tarnwork.workload import features
from tarnwork.workload import views as v

PRODUCTS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@pytest.fixture(scope="module")
def place(spark, tmp_path_factory):
    """Orders of 40 customers, one of them with a third of the rows, one without a name; some orders come twice."""
    folder, draw = str(tmp_path_factory.mktemp("training")), random.Random(4)
    day = datetime.datetime(1997, 1, 1)
    orders = [
        (k, 7 if k % 3 == 0 else draw.randrange(40), "O", draw.randrange(100, 99999) / 7, day + datetime.timedelta(days=draw.randrange(900)), draw.choice(PRODUCTS))
        for k in range(1500)
    ]
    tables = {
        "orders": orders + orders[:20],
        "customer": [(k, None if k == 3 else f"Customer#{k:03d}", k % 4, 1.0, "BUILDING") for k in range(40)],
        "nation": [(k, f"N{k}", k % 2) for k in range(4)],
        "region": [(k, f"R{k}") for k in range(2)],
    }
    for name, rows in tables.items():
        spark.createDataFrame(rows, v.TABLES[name]).write.parquet(f"{folder}/{name}.parquet")
    return folder


def counted(df):
    return sorted((tuple(map(str, r)), n) for *r, n in df.groupBy(*df.columns).count().collect())


def test_parts_have_the_rows_of_the_whole(spark, place, tmp_path):
    whole = features._training_rows(v.orders(spark, place))
    parted = features._store_training_rows(spark, place, str(tmp_path / "rows"), 5)
    assert parted.schema.names == whole.schema.names
    assert counted(parted) == counted(whole)
    assert not (tmp_path / "rows" / "orders").exists()


def shuffle_bytes(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).length() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_"))


def test_training_rows_leave_no_exchange_on_the_disk(spark, place, tmp_path, monkeypatch):
    monkeypatch.setattr(features, "stored_input", lambda spark, name, tables, build: (build(str(tmp_path / "m")), str(tmp_path / "m"))[1])
    monkeypatch.setattr(ml, "train", lambda *a: None)
    monkeypatch.setattr(ml, "save_model", lambda *a: None)
    spark._jvm.System.gc()
    before = shuffle_bytes(spark)
    _, rows = features._trained(spark, place)
    assert rows.count() > 1000
    assert shuffle_bytes(spark) - before < 20_000  # 950,999 when the join ran for each reader


def test_run_rows_count_rows_that_are_joined_once(spark, place, monkeypatch):
    seen, metrics = [], ml.binary_metrics
    monkeypatch.setattr(ml, "binary_metrics", lambda df: (seen.append(df._jdf.queryExecution().optimizedPlan().toString()), metrics(df))[1])
    assert features.ml_run_row(spark, place).count() == 2
    assert len(seen) == 1 and "Join" not in seen[0] and "UDF" not in seen[0]
