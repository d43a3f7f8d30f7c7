"""The written tables that statistics are answered from."""

import shutil

import pyarrow.parquet as pq

from matchstats.operators import cells
from matchstats.plans.queries import QUERIES
from matchstats.plans.store import Store

SF = "/root/testdata/sf0.001"


def test_tables_are_derived_once(spark, tmp_path):
    for t in ("lineitem", "orders", "customer", "nation"):
        shutil.copyfile(f"{SF}/{t}.parquet", tmp_path / f"{t}.parquet")
    store = Store.of(spark, str(tmp_path))
    assert Store.of(spark, str(tmp_path)) is store
    kept = sorted(map(tuple, store.cells.collect()))
    assert kept == sorted(tuple(r) for r in QUERIES["build_cells"](spark, str(tmp_path)).select(*store.cells.columns).collect())
    # only the partition of the version is read
    plan = store.cells.where("game_version = 20001")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(game_version" in plan
    # a table that changes, or a written one that is gone, has them derived again
    shutil.rmtree(store.paths[-1].removeprefix("file://"))
    again = Store.of(spark, str(tmp_path))
    assert again is not store and sorted(map(tuple, again.cells.collect())) == kept
    pq.write_table(pq.read_table(f"{SF}/lineitem.parquet").slice(0, 100), tmp_path / "lineitem.parquet")
    fewer = Store.of(spark, str(tmp_path))
    assert fewer is not again and 0 < fewer.battles.count() <= 100
    assert cells.CELL == fewer.cells.columns[:5]
