"""Gates on what is published, runs that add months, quarantined rows, and the functions of SQL."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from portfold import schemas
from portfold.functions import numbers, sql, text
from portfold.operators import gates
from portfold.plans import reports, runs
from portfold.sources import csv_files, store, versions

COLUMNS = "as_of_date date, market_value decimal(38,2)"
D1, D2 = dt.date(2026, 3, 14), dt.date(2026, 4, 14)


def money(spark, *rows):
    return spark.createDataFrame([(d, None if v is None else Decimal(v)) for d, v in rows], COLUMNS)


def test_a_broken_gate_leaves_the_old_version(spark, tmp_path):
    path = str(tmp_path / "snapshot")
    checks = gates.snapshot_gates(least_rows=2, newest=D1, worth=Decimal("100"), change=0.5, unpriced=0.4)
    first = store.write_full(money(spark, (D1, "60"), (D1, "50")), path, checks)
    for rows, problem in (
        ([(D1, "100")], "rows"), ([(dt.date(2026, 1, 1), "60"), (dt.date(2026, 1, 2), "60")], "newest"), ([(D1, "160"), (D1, "1")], "worth"),
        ([(D1, "100"), (D1, None)], "unpriced"), ([(D1, "110"), (D1, "-5")], "negative"), ([], "rows"),
    ):
        with pytest.raises(gates.GateError, match=problem) as broken:
            store.write_full(money(spark, *rows), path, checks)
        assert set(broken.value.found) == {g.name for g in checks}
        assert store.full_path(spark, path) == first
    assert store.write_full(money(spark, (D1, "60"), (D2, "60")), path, checks) == store.full_path(spark, path) != first


def test_gates_need_no_second_scan(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch
    rows = money(spark, *[(D1, "1")] * 300).mapInArrow(counted, COLUMNS)
    store.write_full(rows, str(tmp_path / "t"), gates.snapshot_gates(least_rows=300))
    assert seen.value == 300


LOT = "submitted_at timestamp, as_of_date date, year int, month_num int, month_label string, institution string, line string, asset_class string, " \
      "asset string, quantity double, avg_price double, current_price double, market_value decimal(38,2), contribution double, exposure string"


def lots(spark, month, seed):
    rng = random.Random(seed)
    rows = []
    for k in range(60):
        day = dt.date(2026, month, rng.randrange(1, 29))
        cls, price = rng.choice(["stock", "fund"]), rng.randrange(1, 5000) / 100
        rows.append((dt.datetime(2026, month, 28, 1, 0, k), day, 2026, month, f"m{month}", rng.choice(["XP", "NU"]), f"l{k}", cls,
                     f"{cls}{rng.randrange(8)}", float(k + 1), price, price, Decimal(f"{price * (k + 1):.2f}"), None, rng.choice(["nacional", "internacional"])))
    return spark.createDataFrame(rows, LOT)


def tables(spark, root, label):
    return {name: sorted(map(str, store.read_month(spark, root, name, schema, label).collect())) for name, schema in schemas.REPORTS.items()}


def test_added_months_give_the_tables_of_a_full_rebuild(spark, tmp_path):
    months = {m: lots(spark, m, m) for m in (1, 2, 3)}
    root, whole = str(tmp_path / "added"), str(tmp_path / "whole")
    runs.add_months(spark, months[1].unionByName(months[2]), root)
    runs.add_months(spark, months[3], root)
    runs.run_reports(spark, months[1].unionByName(months[2]).unionByName(months[3]), whole)
    assert tables(spark, root, "202603") == tables(spark, whole, "202603")
    # A month in the middle is delivered again, with assets gone whose newest lots it held.
    months[2] = lots(spark, 2, 99).limit(10)
    runs.add_months(spark, months[2], root)
    runs.run_reports(spark, months[1].unionByName(months[2]).unionByName(months[3]), whole)
    assert tables(spark, root, "202603") == tables(spark, whole, "202603")


def test_adding_a_month_reads_that_month_only(spark, tmp_path):
    """Folders of the other months of the snapshot could even be gone; in the state only reductions of them are read."""
    root = str(tmp_path / "store")
    runs.add_months(spark, lots(spark, 1, 1), root)
    january = versions.manifest(spark, f"{root}/state/totals").months["202601"]
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch
    path = str(tmp_path / "feb")
    lots(spark, 2, 2).write.parquet(path)
    february = spark.read.parquet(path)
    runs.add_months(spark, february.mapInArrow(counted, february.schema), root)
    assert seen.value == 2 * 60  # once for the totals, once for the newest lots
    now = versions.manifest(spark, f"{root}/state/totals").months
    assert now["202601"] == january and set(now) == {"202601", "202602"}


def test_no_line_of_a_damaged_file_is_lost(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    header = "timestamp,data_apuracao,instituicao_fin,resumo,aporte\n"
    (folder / "a.csv").write_text(header + '1,2,XP,"x\ny",3\n2,only\n3,p,q,r,s,more\n4,p,q,"unclosed,5\n5,s,t,u,v\n')
    (folder / "b.csv").write_text(header + '6,a,b,c,d\n7,a,b,c,"open last\n8,u,v,w,x\n')
    (folder / "c.csv").write_text(header + '9,a,b,"say ""hi""",d\n10,a,b,stray " quote,d\n')  # odd, but nothing is open
    (folder / "d.csv").write_text(header + '11,a,b,c,"two\nlines"\n')
    checked = csv_files.scan_checked(spark, str(folder), str(tmp_path / "out"))
    assert checked.good.columns == schemas.FORM.names
    assert sorted(r["submitted_at"] for r in checked.good.collect()) == ["1", "10", "11", "6", "9"]
    bad = sorted((r["file"].rsplit("/", 1)[1], r["reason"], r["record"]) for r in checked.bad.collect())
    assert [(f, why) for f, why, _ in bad] == [("a.csv", "ragged")] * 3 + [("b.csv", "unclosed")]
    kept = "".join(record for *_, record in bad)
    assert all(part in kept for part in ("2,only", "s,more", "5,s,t,u,v", "open last", "8,u,v,w,x"))


def test_sql_functions_follow_the_column_functions(spark):
    assert set(sql.register(spark)) == {"ptbr_decimal", "lenient_number", "asset_name", "market_symbol", "brl", "percent_over"}
    texts = ["24.000,00", " 7.000 ", "", "  ", None, "Tesouro, IPCA 2.0", "1e5", "NaN", "5d", "-.5", "+3.", "\t12,5\t", "\t12.5 \x0b", "Infinity", "abc", "1,2,3"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    got = frame.select(
        t, F.expr("ptbr_decimal(t)"), text.decimal_from_ptbr(t), F.expr("lenient_number(t)"), numbers.to_number(t),
        F.expr("market_symbol(t)"), text.quote_symbol(t), F.expr("asset_name(t, 'Stock')"), text.asset_case(t, F.lit("stock")),
        F.expr("asset_name(t, 'Fund')"), text.asset_case(t, F.lit("fund")))
    for row in got.collect():
        for k in range(1, len(row), 2):
            assert row[k] == row[k + 1], (row, k)
    rng = random.Random(1)
    pairs = [(round(rng.uniform(-1e6, 1e6), 2), rng.choice([0.0, 1.0, round(rng.uniform(-1e4, 1e4), 2)])) for _ in range(300)] + [(None, 1.0), (1.0, None), (0.125, 0.08)]
    money = spark.createDataFrame(pairs, "a double, b double")
    for row in money.select(F.expr("percent_over(a, b)"), numbers.percent_over(numbers.exact(money, "a"), numbers.exact(money, "b")),
                            F.expr("brl(a)"), text.brl(F.col("a"))).collect():
        assert row[0] == row[1] and row[2] == row[3]


def test_reports_of_state_and_snapshot_share_their_reductions(spark):
    """The newest lot of all is the newest of the months' newest."""
    both = lots(spark, 1, 5).unionByName(lots(spark, 2, 6))
    month = F.month("as_of_date")
    by_month = reports.latest_per_key(both.withColumn("m", month), [*reports.HOLDING, "m"], tiebreak=reports.LOT_ORDER).drop("m")
    assert sorted(map(str, reports.current_positions(by_month).collect())) == sorted(map(str, reports.current_positions(both).collect()))


def test_added_months_sort_only_lots_that_can_be_the_newest(spark, tmp_path, monkeypatch):
    """The totals say which they are, by a hash aggregate. Lots without a submission or a date, and ties, change nothing."""
    plans, write = {}, runs.materialize

    def kept(df, path):
        plans[path.rsplit("/", 1)[1]] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, path)
    monkeypatch.setattr(runs, "materialize", kept)
    k = F.substring("line", 2, 9).cast("int")
    odd = lots(spark, 1, 7).unionByName(lots(spark, 2, 8)).withColumns({
        "submitted_at": F.when(k % 3 > 0, F.date_trunc("hour", F.col("submitted_at"))),
        "as_of_date": F.when(k % 7 > 0, F.col("as_of_date")),
    })
    root, whole = str(tmp_path / "added"), str(tmp_path / "whole")
    runs.add_months(spark, odd, root)
    sorted_rows = plans["lots"]
    assert sorted_rows.index("WindowGroupLimit") < sorted_rows.index("LeftSemi") and "SortAggregate" not in plans["totals"]
    runs.run_reports(spark, odd, whole)
    assert tables(spark, root, "202602") == tables(spark, whole, "202602")
