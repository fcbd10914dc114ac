"""CSV files, the month store and the price history."""

import datetime as dt
import gzip
import os
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from portfold import schemas
from portfold.catalog.queries import QUERIES
from portfold.sources import csv_files, scratch, spread, store, versions
from tests.conftest import SMALL

MARCH, APRIL = dt.date(2026, 3, 14), dt.date(2026, 4, 14)


def line_rows(spark, day, value):
    rows = [(day, day.year, "x", "HOME", "ALL", "valor_total", value, None)]
    return spark.createDataFrame(rows, schemas.HOME_LINE)


def files_of(path):
    return {name: os.stat(os.path.join(path, name)).st_mtime_ns for name in os.listdir(path)}


def test_months_are_replaced_one_by_one(spark, tmp_path):
    root = str(tmp_path)
    store.write_month(line_rows(spark, MARCH, 1.0), root, "home_line", "202603")
    store.write_month(line_rows(spark, APRIL, 2.0), root, "home_line", "202604")
    store.write_month(line_rows(spark, APRIL, 5.0), root, "home_latest", "202604")
    before = files_of(f"{root}/home_line/yyyymm=202603"), files_of(f"{root}/home_latest/yyyymm=202604")
    store.write_month(line_rows(spark, APRIL, 3.0), root, "home_line", "202604")
    assert (files_of(f"{root}/home_line/yyyymm=202603"), files_of(f"{root}/home_latest/yyyymm=202604")) == before
    for label, value in (("202603", 1.0), ("202604", 3.0)):
        month = store.read_month(spark, root, "home_line", schemas.HOME_LINE, label)
        assert [row["market_value"] for row in month.collect()] == [value]
        assert month.columns == schemas.HOME_LINE.names


def test_months_that_are_no_months_are_not_listed(spark, tmp_path):
    root = str(tmp_path)
    for label in ("202603", "202512", "draft", "20260", "2026031"):
        store.write_month(line_rows(spark, MARCH, 1.0), root, "home_line", label)
    assert [row[0] for row in store.list_months(spark, root, "home_line").collect()] == ["202603", "202512"]
    assert store.list_months(spark, root, "missing").collect() == []


def test_reading_a_month_reads_its_folder_only(spark, tmp_path):
    root = str(tmp_path)
    for label in ("202603", "202604"):
        store.write_month(line_rows(spark, MARCH, 1.0), root, "home_line", label)
    plan = store.read_month(spark, root, "home_line", schemas.HOME_LINE, "202604")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(yyyymm" in plan


def test_run_label(spark):
    both = line_rows(spark, MARCH, 1.0).unionByName(line_rows(spark, APRIL, 1.0))
    assert store.run_label_of(both) == "202604"
    with pytest.raises(ValueError, match="no run label"):
        store.run_label_of(both.limit(0))
    with pytest.raises(ValueError, match="needs a name"):
        store.write_month(both, "/nowhere", None, "202604")


def current(spark, path):
    return spark.read.parquet(store.full_path(spark, path))


def test_full_refresh_may_read_what_it_replaces(spark, tmp_path):
    path = str(tmp_path / "table")
    with pytest.raises(FileNotFoundError):
        store.full_path(spark, path)
    store.write_full(spark.range(10), path)
    assert store.write_full(current(spark, path).where("id > 6"), path) == store.full_path(spark, path)
    assert sorted(row.id for row in current(spark, path).collect()) == [7, 8, 9]
    store.write_full(current(spark, path).where("id > 8"), path)
    assert len(os.listdir(path)) == 2  # the version before stays for those who still read it
    assert [row.id for row in current(spark, path).collect()] == [9]


def test_full_refresh_that_fails_keeps_the_old_table(spark, tmp_path):
    path = str(tmp_path / "table")
    store.write_full(spark.range(3), path)
    broken = spark.range(3).select(F.raise_error(F.lit("boom")).alias("id"))
    with pytest.raises(Exception, match="boom"):
        store.write_full(broken, path)
    assert current(spark, path).count() == 3


def test_a_crash_at_any_step_leaves_a_readable_table(spark, tmp_path):
    path = str(tmp_path / "table")
    store.write_full(spark.range(3), path)
    spark.range(9).write.parquet(f"{path}/v99999999999999999999")
    os.remove(f"{path}/v99999999999999999999/_SUCCESS")  # died before the end of the write
    assert current(spark, path).count() == 3
    store.write_full(spark.range(4), path)
    assert current(spark, path).count() == 4
    assert len(os.listdir(path)) == 2


def test_a_write_without_success_mark_is_an_error(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "table")
    store.write_full(spark.range(3), path)
    there = store._exists
    monkeypatch.setattr(store, "_exists", lambda s, p: there(s, p) and path + "/v" in p and len(os.listdir(path)) < 2)
    with pytest.raises(OSError, match="success"):
        store.write_full(spark.range(4), path)


def test_listing_months_opens_no_file(spark, tmp_path):
    store.write_month(line_rows(spark, MARCH, 1.0), str(tmp_path), "home_line", "202603")
    plan = store.list_months(spark, str(tmp_path), "home_line")._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" not in plan and "Exchange" not in plan


def test_views_by_table_name(spark, tmp_path):
    root = str(tmp_path)
    store.write_month(line_rows(spark, MARCH, 1.0), root, "home_line", "202603")
    store.write_month(line_rows(spark, APRIL, 2.0), root, "home_line", "202604")
    store.write_full(spark.createDataFrame([], schemas.SNAPSHOT), f"{root}/snapshot")
    assert set(store.register_views(spark, root, "202604")) == {*schemas.REPORTS, "snapshot"}
    assert [r[0] for r in spark.sql("select market_value from home_line").collect()] == [2.0]
    store.register_views(spark, root)
    assert spark.sql("select count(distinct yyyymm) from home_line").first()[0] == 2


def prices_of(spark, rows):
    return spark.createDataFrame(
        [(day, ticker, close, dt.datetime.combine(fetched, dt.time(9)), fetched) for day, ticker, close, fetched in rows],
        schemas.PRICES,
    )


def history(df):
    return sorted((row["ticker"], row["price_date"], row["close"]) for row in df.collect())


def test_price_upsert_touches_its_months_only(spark, tmp_path):
    path = str(tmp_path / "prices")
    assert store.read_prices(spark, path).count() == 0
    jan, feb, mar = dt.date(2026, 1, 30), dt.date(2026, 2, 2), dt.date(2026, 3, 2)
    store.upsert_prices(spark, path, prices_of(spark, [(jan, "A", 1.0, feb), (feb, "A", 2.0, feb), (mar, "A", 3.0, mar)]))
    february = versions.manifest(spark, path).months["202602"]
    untouched = files_of(f"{path}/{february}")
    batch = prices_of(spark, [(jan, "A", 9.0, mar), (jan, "B", 4.0, mar), (mar, "A", 8.0, feb)])
    expected = [("A", jan, 9.0), ("A", feb, 2.0), ("A", mar, 3.0), ("B", jan, 4.0)]
    assert history(store.upsert_prices(spark, path, batch)) == sorted(expected)
    assert history(store.upsert_prices(spark, path, batch)) == sorted(expected)
    assert versions.manifest(spark, path).months["202602"] == february and files_of(f"{path}/{february}") == untouched
    assert history(store.upsert_prices(spark, path, batch.limit(0))) == sorted(expected)


def test_csv_export_under_portuguese_headers(spark, tmp_path):
    path = str(tmp_path / "line")
    csv_files.export_csv(line_rows(spark, MARCH, 47259.95), path, portuguese=True)
    header = {
        "data_apuracao", "ano", "mes", "tipo_escopo", "instituicao_fin", "nome_metrica", "valor_total", "variacao_percentual",
    }
    assert set(spark.read.csv(path, header=True).columns) == header
    back = csv_files.scan_table(spark, path, schemas.HOME_LINE)
    assert back.collect() == line_rows(spark, MARCH, 47259.95).collect()


def test_columns_are_found_by_header(spark, tmp_path):
    path = tmp_path / "form.csv"
    path.write_text('instituicao_fin,note,timestamp,resumo,aporte,data_apuracao\nXP,n,t,"a ""b"", c\nd",0,14/03/2026\n')
    row = csv_files.scan_form(spark, str(path)).first()
    assert (row["institution"], row["as_of_date"], row["statement"]) == ("XP", "14/03/2026", 'a "b", c\nd')
    path.write_text("instituicao_fin,timestamp,resumo,aporte\nXP,t,a,0\n")
    with pytest.raises(ValueError, match="as_of_date"):
        csv_files.scan_form(spark, str(path))


def test_a_snapshot_without_line_ends_is_split(spark, tmp_path):
    rows = spark.range(20_000).select(*[F.col("id").cast("string").alias(c) for c in schemas.SNAPSHOT.names]).coalesce(1)
    csv_files.export_csv(rows, str(tmp_path / "s"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        split = csv_files.scan_snapshot(spark, str(tmp_path / "s"), line_ends=False)
        whole = csv_files.scan_snapshot(spark, str(tmp_path / "s"))
        assert split.rdd.getNumPartitions() > 4 and whole.rdd.getNumPartitions() == 1
        assert split.count() == whole.count() == 20_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_scratch_is_in_a_shared_folder(spark):
    first, second = scratch.scratch_path(spark, "x"), scratch.scratch_path(spark, "x")
    assert first != second
    assert first.startswith(spark.conf.get("spark.checkpoint.dir"))

    class Unset:
        class conf:  # noqa: N801
            @staticmethod
            def get(name, default=None):
                return {"spark.sql.warehouse.dir": "s3a://bucket/warehouse"}.get(name, default)

    assert scratch.scratch_path(Unset, "x").startswith("s3a://bucket/warehouse/scratch/portfold-")


def test_spread_deals_few_files_out_and_leaves_many_alone(spark, tmp_path):
    few, many = str(tmp_path / "few"), str(tmp_path / "many")
    spark.range(0, 100, 1, 2).write.parquet(few)
    spark.range(0, 1000, 1, spread.FEW_FILES).write.parquet(many)

    def shuffled(df):
        return "REBALANCE" in df._jdf.queryExecution().executedPlan().toString()
    assert shuffled(spread.spread(spark.read.parquet(few))) and not shuffled(spread.spread(spark.read.parquet(many)))
    assert spread.spread(spark.read.parquet(few), "id").count() == 100


def test_form_files_hold_so_many_answers_at_most(spark, tmp_path):
    """One task reads a whole file of answers, so files must not grow with the table."""
    answers = spark.range(1000, numPartitions=1).select(*[F.concat(F.lit("a\n"), F.col("id")).alias(n) for n in schemas.FORM.names])
    csv_files.export_form(schemas.with_csv_headers(answers), str(tmp_path / "form"), rows=300)
    assert sum(name.endswith(".csv") for name in files_of(tmp_path / "form")) == 4
    assert sorted(map(tuple, csv_files.scan_form(spark, str(tmp_path / "form")).collect())) == sorted(map(tuple, answers.collect()))


def test_packed_files_hold_so_many_rows_at_most(spark, tmp_path):
    """One task reads a whole packed file, so files must not grow with the table."""
    odd = F.concat(F.lit(' "a", \\ '), F.col("id") % 7, F.lit(" "))
    rows = spark.range(1000, numPartitions=1).select(*[
        (odd if f.name == "asset" else F.lit(None) if f.name == "line" else F.col("id")).cast(f.dataType if f.name != "as_of_date" else "string")
        .try_cast(f.dataType).alias(f.name) for f in schemas.SNAPSHOT.fields
    ])
    csv_files.export_csv(rows, str(tmp_path / "plain"))
    csv_files.export_csv(rows, str(tmp_path / "packed"), packed=300)
    packed = [tmp_path / "packed" / name for name in files_of(tmp_path / "packed") if name.endswith(".csv.gz")]
    assert sorted(gzip.open(path).read().count(b"\n") for path in packed) == [101, 301, 301, 301]
    plain = csv_files.scan_snapshot(spark, str(tmp_path / "plain"), line_ends=False)
    back = csv_files.scan_snapshot(spark, str(tmp_path / "packed"), line_ends=False)
    assert sorted(map(str, back.collect())) == sorted(map(str, plain.collect())) and back.count() == 1000
    csv_files.export_csv(rows.limit(0), str(tmp_path / "none"), packed=300)
    assert csv_files.scan_snapshot(spark, str(tmp_path / "none"), line_ends=False).count() == 0


def shuffle_files(spark):
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = (found.apply(i).getName() for i in range(found.size()))
    return {name for name in names if name.startswith("shuffle_")}


@pytest.mark.parametrize("before", [None, "false"])
def test_a_settled_table_leaves_no_shuffle_files(spark, tmp_path, before):
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    if before:
        spark.conf.set(setting, before)
    try:
        had = shuffle_files(spark)
        rows = spark.range(1000).withColumn("half", F.col("id") / 2).repartition(3, "id")
        stored = scratch.settle(rows, str(tmp_path / "stored"))
        assert spark.conf.get(setting, None) == before
        until = time.time() + 20
        while shuffle_files(spark) - had and time.time() < until:
            time.sleep(0.2)
        assert not shuffle_files(spark) - had
        assert sorted(stored.collect()) == sorted(rows.collect()) and stored.dtypes == rows.dtypes
        assert scratch.settle(rows.where("id < 0"), str(tmp_path / "none")).count() == 0
    finally:
        spark.conf.unset(setting)


def test_the_snapshot_query_leaves_packed_files_alone(spark):
    """Its CSV is compressed, and what the answers were joined from is gone when the rows are scanned."""
    scratch_root = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(scratch_root.glob("portfold-*"))
    frame = QUERIES["scan_snapshot"](spark, SMALL)
    left = [path for folder in set(scratch_root.glob("portfold-*")) - before for path in folder.rglob("part-*")]
    assert left and all(path.name.endswith(".csv.gz") for path in left)
    unpacked = sum(len(gzip.open(path).read()) for path in left)
    assert sum(path.stat().st_size for path in left) < unpacked / 4
    assert frame.count() == 2 * spark.read.parquet(f"{SMALL}/lineitem.parquet").count()
