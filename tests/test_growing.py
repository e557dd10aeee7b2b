"""Facts and cube that grow with their files: only new files are read, and results are those of a full rebuild."""

from __future__ import annotations

import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tillwise.plans.dashboard import monthly_revenue
from tillwise.plans.profit import pnl_by_category
from tillwise.plans.workspace import GrowingWorkspace, StaleFacts, Workspace

PNL = ("category", "order_date", "order_status", "payment_amount", "cogs", "gross_profit")


def add(spark, folder, table, rows, name):
    """One more file of a table."""
    rows.coalesce(1).write.parquet(f"{folder}/_made/{table}-{name}")
    part = next(Path(f"{folder}/_made/{table}-{name}").glob("part-*.parquet"))
    (Path(folder) / f"{table}.parquet").mkdir(exist_ok=True)
    shutil.copy(part, f"{folder}/{table}.parquet/{name}.parquet")


@pytest.fixture
def shop(spark, data, tmp_path):
    """The test tables, orders in two halves of which the second comes later."""
    folder = tmp_path / "shop"
    folder.mkdir()
    for name in ("region", "nation", "customer", "part"):
        shutil.copy(f"{data}/{name}.parquet", folder / f"{name}.parquet")
    orders, lines = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("orders", "lineitem"))
    halves = {}
    for k, name in enumerate("ab"):
        halves[name] = (orders.where(F.col("o_orderkey") % 2 == k), lines.where(F.col("l_orderkey") % 2 == k))

    def deliver(name, orders=True, lines=True):
        if orders:
            add(spark, str(folder), "orders", halves[name][0], name)
        if lines:
            add(spark, str(folder), "lineitem", halves[name][1], name)

    return str(folder), deliver


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def same_as_rebuilt(spark, space, folder):
    whole = Workspace(spark, folder)
    assert rows(space.facts()) == rows(whole.facts())
    assert rows(pnl_by_category(space.cells(*PNL))) == rows(pnl_by_category(whole.cells(*PNL)))
    assert rows(monthly_revenue(space.cells(*PNL))) == rows(monthly_revenue(whole.cells(*PNL)))


def test_only_new_files_are_read(spark, shop, tmp_path):
    folder, deliver = shop
    deliver("a")
    space = GrowingWorkspace(spark, folder, str(tmp_path / "stored"))
    assert {Path(p).name for p in space.refresh()} == {"a.parquet"}
    same_as_rebuilt(spark, space, folder)
    assert space.refresh() == []

    deliver("b")
    seen = []
    own = space._derive
    space.stored.derive = lambda new: seen.append({k: [Path(f).name for f in v.inputFiles()] for k, v in new.items()}) or own(new)
    assert len(space.refresh()) == 2
    assert seen == [{"lineitem": ["b.parquet"], "orders": ["b.parquet"]}]
    same_as_rebuilt(spark, space, folder)

    later = GrowingWorkspace(spark, folder, str(tmp_path / "stored"))  # another application
    assert later.refresh() == []
    same_as_rebuilt(spark, later, folder)


def test_lines_may_come_after_their_orders(spark, shop, tmp_path):
    folder, deliver = shop
    deliver("a")
    deliver("b", lines=False)
    space = GrowingWorkspace(spark, folder, str(tmp_path / "stored"))
    space.refresh()
    deliver("b", orders=False)
    space.refresh()
    same_as_rebuilt(spark, space, folder)


def test_orders_after_their_lines_are_refused(spark, shop, tmp_path):
    folder, deliver = shop
    deliver("a")
    deliver("b", orders=False)
    space = GrowingWorkspace(spark, folder, str(tmp_path / "stored"))
    space.refresh()
    deliver("b", lines=False)
    with pytest.raises(StaleFacts):
        space.refresh()
    fresh = GrowingWorkspace(spark, folder, str(tmp_path / "anew"))
    fresh.refresh()
    same_as_rebuilt(spark, fresh, folder)


def test_a_changed_file_makes_everything_anew(spark, shop, tmp_path):
    folder, deliver = shop
    deliver("a")
    space = GrowingWorkspace(spark, folder, str(tmp_path / "stored"))
    space.refresh()
    Path(f"{folder}/lineitem.parquet/a.parquet").unlink()
    deliver("b")
    assert len(space.refresh()) == 3
    same_as_rebuilt(spark, space, folder)


def test_a_part_that_was_not_finished_counts_once(spark, shop, tmp_path):
    folder, deliver = shop
    deliver("a")
    space = GrowingWorkspace(spark, folder, str(tmp_path / "stored"))
    space.refresh()
    deliver("b")
    own = space._derive

    def broken(new):
        own(new)["facts"].write.mode("overwrite").parquet(f"{tmp_path}/stored/generation=0/facts/part=1")
        raise RuntimeError("lost")

    space.stored.derive = broken
    with pytest.raises(RuntimeError, match="lost"):
        space.refresh()
    space.stored.derive = own
    space.refresh()
    same_as_rebuilt(spark, space, folder)


def test_facts_are_written_once_and_cubes_hold_what_is_asked_for(spark, shop, tmp_path, monkeypatch):
    """No copy of the facts beside the stored ones; a cube has its report's dimensions, and old parts of it are not made again."""
    from tillwise.plans import workspace

    copies, made, own = [], [], workspace.roll_up
    monkeypatch.setattr(workspace, "store", lambda df: copies.append(df) or df)
    monkeypatch.setattr(workspace, "roll_up", lambda cells: made.append(cells) or own(cells))
    folder, deliver = shop
    deliver("a")
    space = GrowingWorkspace(spark, folder, str(tmp_path / "stored"))
    space.refresh()
    assert not copies and not made
    cells = space.cells(*PNL)
    assert not {"city", "device", "gender", "age_group", "rating"} & set(cells.columns) and len(made) == 1
    deliver("b")
    space.refresh()
    space.cells(*PNL)
    later = GrowingWorkspace(spark, folder, str(tmp_path / "stored"))
    later.refresh()
    later.cells(*reversed(PNL))
    assert len(made) == 2 and not copies
    same_as_rebuilt(spark, space, folder)
    assert rows(pnl_by_category(space.cube)) == rows(pnl_by_category(space.cells(*PNL)))
