import glob
import os

import pytest

from trailweave.plans.oracles import ORACLES
from trailweave.plans.queries import QUERIES

duckdb = pytest.importorskip("duckdb")
FOLDER = "/root/testdata/sf0.001"


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize(
    "name",
    [
        "event_log", "dfg_by_case", "dfg_by_day", "dfg_by_conversation", "neighbourhood_pairs", "transition_probabilities",
        "decay_weights", "frequent_components", "threshold_communities", "cluster_file_edges", "truth_edges", "row_numbers",
    ],
)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        table = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"create view {table} as select * from read_parquet('{path}')")
    cursor = con.execute(ORACLES[name])
    columns = sorted(c[0] for c in cursor.description)
    order = [[c[0] for c in cursor.description].index(c) for c in columns]
    want = sorted(tuple(str(r[i]) for i in order) for r in cursor.fetchall())
    df = QUERIES[name](spark, FOLDER)
    assert sorted(df.columns) == columns
    assert sorted(tuple(str(v) for v in r) for r in df.select(*columns).collect()) == want
