"""Retention and compaction of the stored flow table, and versions that readers see whole."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from flowlens.operators import export as X
from flowlens.operators import maintain as M
from flowlens.sources import testdata as td

AS_OF = dt.datetime(2024, 3, 10)


def spread(spark, days=90):
    """The small flows over three months."""
    f = td.flows(spark, SMALL)
    return f.withColumn("ts", F.col("ts") + F.make_dt_interval(days=F.abs(F.hash("id")) % (days - 30)))


@pytest.fixture()
def table(spark, tmp_path):
    path = str(tmp_path / "flows")
    f = spread(spark)
    for e in range(6):
        X.write_flows(f.filter(F.abs(F.hash("id", F.lit(1))) % 6 == e), path, epoch=e)
    return path, f


def files(path):
    return {os.path.relpath(os.path.join(d, n), path) for d, _, names in os.walk(path) for n in names if n.endswith(".parquet")}


def ids(df):
    return sorted(r[0] for r in df.select("id").collect())


def kept(f, as_of, days):
    return ids(f.filter(F.col("ts") >= F.lit(as_of - dt.timedelta(days=days))))


def test_versions_hold_the_same_rows(spark, table):
    path, f = table
    assert ids(M.read_table(spark, path)) == ids(f)
    before = len(files(path))
    assert M.maintain(spark, path, AS_OF, days=400) == 1
    assert ids(M.read_table(spark, path)) == ids(f)
    assert M.maintain(spark, path, AS_OF, days=400) == 2
    assert ids(M.read_table(spark, path)) == ids(f)
    # the first version's epochs are gone now; the newest epoch, maybe still written, stays
    assert sorted(n for n in os.listdir(path) if n.startswith("epoch")) == ["epoch=5"]
    assert len(files(path)) < before


def test_old_months_go_unread(spark, table, monkeypatch):
    path, f = table
    M.maintain(spark, path, AS_OF, days=400, upto_epoch=5)
    read = []
    rows = M._rows
    monkeypatch.setattr(M, "_rows", lambda s, p, folders: read.append(folders) or rows(s, p, folders))
    M.maintain(spark, path, AS_OF, days=20)
    # only the month of the edge is opened
    assert {x for folders in read for x in folders} == {"_base/v=1/yyyymm=202402"}
    monkeypatch.undo()
    assert ids(M.read_table(spark, path)) == kept(f, AS_OF, 20)
    months = {m["month"]: m["folder"] for m in M._snapshot(spark, path, 2)["months"]}
    assert months[202402].startswith("_base/v=2") and months.get(202403, "_base/v=1").startswith("_base/v=1")
    M.maintain(spark, path, AS_OF, days=20)
    assert not [x for x in files(path) if "yyyymm=202401" in x or "v=1/yyyymm=202402" in x]


def test_a_reader_of_the_version_before_is_not_broken(spark, table):
    path, f = table
    M.maintain(spark, path, AS_OF, days=400, upto_epoch=5)
    old = M.read_table(spark, path)
    old.schema  # planned before the next version
    M.maintain(spark, path, AS_OF, days=20)
    assert ids(old) == ids(f)


def test_a_run_that_dies_changes_nothing(spark, table, monkeypatch):
    path, f = table
    M.maintain(spark, path, AS_OF, days=400)
    pack = M._pack

    def dies(df, folder):
        pack(df, folder)
        raise RuntimeError("lost")
    monkeypatch.setattr(M, "_pack", dies)
    with pytest.raises(RuntimeError):
        M.maintain(spark, path, AS_OF, days=20)
    monkeypatch.undo()
    assert ids(M.read_table(spark, path)) == ids(f)
    assert M.maintain(spark, path, AS_OF, days=20) == 2
    assert ids(M.read_table(spark, path)) == kept(f, AS_OF, 20)


def test_new_epochs_join_the_months_and_many_parts_are_packed(spark, table, monkeypatch):
    path, f = table
    monkeypatch.setattr(M, "MAX_PARTS", 2)
    M.maintain(spark, path, AS_OF, days=400, upto_epoch=1)
    M.maintain(spark, path, AS_OF, days=400, upto_epoch=3)
    assert max(len([1 for m in M._snapshot(spark, path, 2)["months"] if m["month"] == 202401]), 1) == 2
    M.maintain(spark, path, AS_OF, days=400, upto_epoch=5)
    assert len([1 for m in M._snapshot(spark, path, 3)["months"] if m["month"] == 202401]) == 1
    assert ids(M.read_table(spark, path)) == ids(f)


def test_ranges_open_their_months_only(spark, table):
    path, f = table
    M.maintain(spark, path, AS_OF, days=400, upto_epoch=5)
    lo, hi = dt.datetime(2024, 2, 3), dt.datetime(2024, 2, 20)
    part = M.read_table(spark, path, lo, hi)
    assert ids(part) == ids(f.filter((F.col("ts") >= F.lit(lo)) & (F.col("ts") < F.lit(hi))))
    assert all("yyyymm=202402" in x for x in part.inputFiles())


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "none")
    assert M.read_table(spark, path).count() == 0
    assert M.maintain(spark, path, AS_OF) == 1
    assert M.read_table(spark, path).count() == 0
