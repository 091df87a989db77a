import os

from pyspark.sql import functions as F
from test_runs import scanned

from docloom.operators import ingest
from docloom.sources.versions import Store


def test_a_run_leaves_only_what_its_manifest_names(spark, tmp_path):
    os.mkdir(f"{tmp_path}/in")
    with open(f"{tmp_path}/in/a.md", "wb") as f:
        f.write(b"# Plan\n\nThe river runs.")
    store = Store(spark, f"{tmp_path}/g")
    one = ingest.committed_run(store, scanned(spark, f"{tmp_path}/in"), F.lit("2024-01-01").cast("timestamp"), "t1")
    assert set(os.listdir(f"{tmp_path}/g/data")) == {p.rpartition("/")[2] for p in one.tables.values()}
    assert store.table("chunks").count() == 1
