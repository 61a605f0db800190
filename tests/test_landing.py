"""Landing in one pass, with damaged lines kept, and publishing of whole versions."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from ledgerline.operators.constraints import ConstraintError
from ledgerline.plans import publish
from ledgerline.plans.publish import PublishError
from ledgerline.plans.warehouse import Warehouse
from ledgerline.sources import files
from ledgerline.sources.export import RAW_COLUMNS, MalformedExportError, read_csv, write_csv
from ledgerline.sources.landing import land_csv
from ledgerline.sources.workspace import Workspace

HEADER = ",".join(RAW_COLUMNS)
GOOD = ",".join(["1"] * len(RAW_COLUMNS))


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


# --- landing ---------------------------------------------------------------


@pytest.fixture
def export(tmp_path):
    """Writes files of lines, each below a header, and returns their folder."""

    def write(**lines: list[str]) -> str:
        for name, content in lines.items():
            (tmp_path / f"{name}.csv").write_text("\n".join([HEADER, *content]) + "\n", newline="")
        return str(tmp_path)

    return write


def test_damaged_lines_are_kept_with_their_file(spark, export):
    blank = "," * (len(RAW_COLUMNS) - 1)
    folder = export(
        a=[GOOD, "1,2,3", GOOD + ",more", "", "   ", blank], b=[GOOD, f'{GOOD[:-1]}"open', 'and closed"', GOOD],
        c=[GOOD[:-1] + '"a ""quoted"" one, with a comma"'], d=[],
    )
    landing = land_csv(spark, folder, Workspace(spark, "landing"), allow_damaged=True)
    assert landing.counts == {"total_rows": 9, "wrong_field_count": 2, "open_quotes": 2}
    assert landing.staging.count() == 5
    assert landing.staging.where("fy = '1' AND item_id = '1'").count() == 4
    last = landing.staging.columns[-1]
    assert landing.staging.where(F.col(last) == 'a "quoted" one, with a comma').count() == 1
    assert landing.staging.where("item_id = ''").count() == 1
    kept = sorted((r.damage, r.line, os.path.basename(r.file)) for r in landing.quarantine.collect())
    assert kept == sorted([
        ("fields", "1,2,3", "a.csv"), ("fields", GOOD + ",more", "a.csv"),
        ("quote", f'{GOOD[:-1]}"open', "b.csv"), ("quote", 'and closed"', "b.csv"),
    ])


def test_damaged_lines_stop_the_landing_and_are_named(spark, export):
    workspace = Workspace(spark, "landing")
    with pytest.raises(MalformedExportError, match="1,2,3") as raised:
        land_csv(spark, export(a=[GOOD, "1,2,3"]), workspace)
    assert workspace.path("landed") in str(raised.value)
    assert spark.read.parquet(workspace.path("landed")).where("damage <> 'none'").count() == 1


def test_records_over_several_lines(spark, export):
    folder = export(a=[GOOD, f'{GOOD[:-1]}"two', 'lines"', "1,2"])
    landing = land_csv(spark, folder, Workspace(spark, "landing"), multi_line=True, allow_damaged=True)
    assert landing.counts == {"total_rows": 3, "wrong_field_count": 1, "open_quotes": 0}
    assert landing.staging.where(F.col(landing.staging.columns[-1]) == "two\nlines").count() == 1


def test_landing_equals_the_plain_reader(spark, warehouse, tmp_path):
    path = str(tmp_path / "export")
    write_csv(warehouse.staging(), path)
    landing = land_csv(spark, path, Workspace(spark, "landing"))
    assert landing.damaged == 0 and landing.counts["total_rows"] == 6500
    assert rows_of(landing.staging) == rows_of(read_csv(spark, path)) == rows_of(warehouse.staging())


def test_empty_exports(spark, export):
    landing = land_csv(spark, export(a=[], b=[]), Workspace(spark, "landing"))
    assert landing.counts["total_rows"] == landing.staging.count() == landing.quarantine.count() == 0


def test_other_line_ends_and_marks(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(f"﻿{HEADER}\r\n{GOOD}\r\n{GOOD}".encode())
    landing = land_csv(spark, str(tmp_path), Workspace(spark, "landing"))
    assert landing.counts["total_rows"] == 2
    assert {r[-1] for r in landing.staging.collect()} == {"1"}


# --- publishing ------------------------------------------------------------


def no_checks(_):
    pass


def table(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "v int")


@pytest.fixture
def name():
    import uuid

    return f"t{uuid.uuid4().hex[:8]}"


def test_publish_stops_at_a_broken_key(spark, warehouse_of, tmp_path, name):
    broken = warehouse_of({"item_id": "1"}, {"item_id": "1", "sku": "other"})
    with pytest.raises(ConstraintError):
        broken.publish(str(tmp_path), name)
    assert not list(tmp_path.iterdir())


def test_publish_saves_all_zones(spark, warehouse, tmp_path, name):
    assert warehouse.publish(str(tmp_path), name) == 1
    assert spark.table(f"{name}_oltp.orders").count() == 1443
    assert spark.table(f"{name}_olap.fact_sales").count() == 5780
    assert spark.table(f"{name}_olap.v_rfm_segments").count() == 148
    assert spark.table(f"{name}_olap.v_monthly_kpi").count() == 80
    assert spark.table(f"{name}_staging.export").count() == 6500
    again = Warehouse.from_staging(spark, publish.read(spark, str(tmp_path))["staging"]["export"])
    assert again.orders().count() == 1443
    again.close()


def test_a_crash_between_two_tables_leaves_the_old_version(spark, tmp_path, name):
    root = str(tmp_path)
    old = {"oltp": {"a": table(spark, 1), "b": table(spark, 1)}, "olap": {"c": table(spark, 1)}}
    publish.publish(spark, old, root, name, no_checks)
    broken = spark.range(3).select(F.raise_error(F.lit("no power")).cast("int").alias("v"))
    new = {"oltp": {"a": table(spark, 2), "b": broken}, "olap": {"c": table(spark, 2)}}
    with pytest.raises(Exception, match="no power"):
        publish.publish(spark, new, root, name, no_checks)
    seen = publish.read(spark, root)
    for zone, tables in old.items():
        for one in tables:
            assert spark.table(f"{name}_{zone}.{one}").collect() == seen[zone][one].collect() == [(1,)]
    assert publish.versions(spark, root) == [1]
    # Nothing of the failed version is left.
    assert len(list((tmp_path / "data").iterdir())) == 1


def test_a_failed_check_publishes_nothing(spark, tmp_path, name):
    def refuse(zones):
        assert zones["oltp"]["a"].count() == 1
        raise ConstraintError("broken")

    with pytest.raises(ConstraintError):
        publish.publish(spark, {"oltp": {"a": table(spark, 1)}}, str(tmp_path), name, refuse)
    assert publish.versions(spark, str(tmp_path)) == []
    with pytest.raises(PublishError, match="nothing is published"):
        publish.read(spark, str(tmp_path))


def test_lost_files_are_noticed(spark, tmp_path, name, monkeypatch):
    real = publish._write

    def losing(df, path):
        rows = real(df, path)
        return rows + 1 if path.endswith("/b") else rows

    monkeypatch.setattr(publish, "_write", losing)
    with pytest.raises(PublishError, match="oltp.b: 1 rows read, 2 written"):
        zones = {"oltp": {"a": table(spark, 1), "b": table(spark, 1)}}
        publish.publish(spark, zones, str(tmp_path), name, no_checks)


def test_a_crash_between_two_views_is_mended(spark, tmp_path, name, monkeypatch):
    root = str(tmp_path)
    publish.publish(spark, {"oltp": {"a": table(spark, 1), "b": table(spark, 1)}}, root, name, no_checks)
    monkeypatch.setattr(publish, "register", lambda *_: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError):
        publish.publish(spark, {"oltp": {"a": table(spark, 2), "b": table(spark, 2)}}, root, name, no_checks)
    monkeypatch.undo()
    assert [t.collect() for t in publish.read(spark, root)["oltp"].values()] == [[(2,)], [(2,)]]
    publish.register(spark, root, name)
    assert spark.table(f"{name}_oltp.a").collect() == spark.table(f"{name}_oltp.b").collect() == [(2,)]
    publish.register(spark, root, name, version=1)
    assert spark.table(f"{name}_oltp.a").collect() == [(1,)]


def test_two_roots_do_not_share_databases(spark, tmp_path, name):
    zones = {"oltp": {"a": table(spark, 1)}}
    publish.publish(spark, zones, str(tmp_path / "one"), name, no_checks)
    with pytest.raises(PublishError, match="belongs to"):
        publish.publish(spark, zones, str(tmp_path / "two"), name, no_checks)
    assert not (tmp_path / "two").exists()
    publish.publish(spark, {"oltp": {"a": table(spark, 2)}}, str(tmp_path / "two"), f"{name}x", no_checks)
    assert spark.table(f"{name}_oltp.a").collect() == [(1,)]
    spark.sql(f"CREATE DATABASE {name}y_oltp")
    with pytest.raises(PublishError, match="something else"):
        publish.publish(spark, zones, str(tmp_path / "three"), f"{name}y", no_checks)


def test_a_version_number_is_taken_once(spark, tmp_path, name):
    root = str(tmp_path)

    def meanwhile(_):
        files.create(spark, f"{root}/versions/{1:010d}.json", '{"version": 1, "folder": "data/x", "rows": {}}')

    with pytest.raises(Exception, match="exist"):
        publish.publish(spark, {"oltp": {"a": table(spark, 1)}}, root, name, meanwhile)
    assert publish.versions(spark, root) == [1] and not list((tmp_path / "data").iterdir())


def test_old_versions_expire(spark, tmp_path, name):
    root = str(tmp_path)
    for n in range(4):
        publish.publish(spark, {"oltp": {"a": table(spark, n)}}, root, name, no_checks)
    assert publish.expire(spark, root) == [1, 2] and publish.versions(spark, root) == [3, 4]
    assert len(list((tmp_path / "data").iterdir())) == 2
    assert spark.table(f"{name}_oltp.a").collect() == [(3,)]
    assert publish.read(spark, root, 3)["oltp"]["a"].collect() == [(2,)]
