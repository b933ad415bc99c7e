from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tests.frames import frame, line
from tillroll.functions import bands, rows, text, time
from tillroll.operators import basket, lines, metrics, product, score
from tillroll.sources import invoices


def test_csv_keeps_latin_letters_text_numbers_and_file_order(spark, tmp_path):
    path = tmp_path / "data.csv"
    written = ["InvoiceNo,StockCode,Description,Quantity,InvoiceDate,UnitPrice,CustomerID,Country",
            'C536365,85123A,"CAFÉ, ""BLUE""",-6,12/1/2010 8:26,2.55,17850,United Kingdom',
            "536366,D,,6,1/13/2011 18:05,0.1,,France"]
    path.write_bytes("\n".join(written).encode("iso-8859-1"))
    got = invoices.read_csv(spark, str(path), row_id=True).orderBy("row_id").collect()
    assert [r.InvoiceNo for r in got] == ["C536365", "536366"]
    assert got[0].Description == 'CAFÉ, "BLUE"' and got[0].InvoiceDate == datetime(2010, 12, 1, 8, 26)
    assert got[1].CustomerID is None and got[1].InvoiceDate == datetime(2011, 1, 13, 18, 5)


def test_row_id_orders_cancels_and_survives_deduplication(spark, tmp_path):
    path = tmp_path / "data.csv"
    path.write_text("InvoiceNo,StockCode,Description,Quantity,InvoiceDate,UnitPrice,CustomerID,Country\n"
                    "9,A,MUG,5,1/1/2011 8:00,1,1,UK\n1,A,MUG,5,1/1/2011 8:00,1,1,UK\n"
                    "1,A,MUG,5,1/1/2011 8:00,1,1,UK\nC2,A,MUG,-5,1/2/2011 8:00,1,1,UK\n")
    from tillroll.operators import cancel
    df = lines.deduplicate(invoices.read_csv(spark, str(path), row_id=True))
    got = {r.InvoiceNo: r.QuantityCanceled for r in cancel.net_cancels(df).collect()}
    assert got == {"9": 0, "1": 5}


def test_duplicates(spark, monkeypatch):
    monkeypatch.setattr(rows, "RUN", 3)
    df = frame(spark, [line()] * 9 + [line("2", text=None)] * 2 + [line("3")])
    assert lines.duplicate_count(df).first().duplicates == 9
    assert sorted(r.copy_no for r in lines.duplicate_lines(df).where("InvoiceNo = '1'").collect()) == list(range(2, 10))
    assert lines.duplicate_lines(df).count() == 9
    clean = lines.deduplicate(df)
    assert clean.count() == 3 and lines.duplicate_count(clean).first().duplicates == 0


def test_split_reaches_the_scan(spark, tmp_path):
    frame(spark, [line(day=d) for d in range(4)]).write.parquet(str(tmp_path / "x"))
    before, after = lines.split_by_time(spark.read.parquet(str(tmp_path / "x")), datetime(2011, 1, 3, 12))
    assert before.count() == 2 and after.count() == 2
    assert "LessThan(InvoiceDate" in before._jdf.queryExecution().toString()


def test_profile_and_constants(spark):
    df = frame(spark, [line(), line("2", text=None)])
    profile = {r.column_name: r for r in lines.column_profile(df).collect()}
    assert profile["Description"].null_count == 1 and profile["Description"].null_pct == 50
    assert {r.column_name for r in lines.constant_columns(df).collect()} == set(df.columns) - {"InvoiceNo"}


def test_time_functions(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ'2011-03-01 00:30:00.000005' AS a, TIMESTAMP_NTZ'2011-02-28 01:30:00' AS b")
    r = df.select(time.elapsed_days(F.col("a"), F.col("b")).alias("e"), time.calendar_days(F.col("a"), F.col("b")).alias("c"),
                  time.from_micros(time.to_micros(F.col("a"))).alias("same"), time.plus_one_day(F.col("b")).alias("next")).first()
    assert (r.e, r.c) == (0, 1) and r.same == datetime(2011, 3, 1, 0, 30, 0, 5) and r.next == datetime(2011, 3, 1, 1, 30)


@pytest.mark.parametrize("zone", ["UTC", "America/Sao_Paulo", "Asia/Kathmandu"])
def test_times_do_not_depend_on_the_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.sql("SELECT TIMESTAMP_NTZ'2010-10-17 00:30:00' AS a UNION ALL SELECT TIMESTAMP_NTZ'2010-10-17 00:30:03'")
        r = df.agg(time.mean_micros(F.col("a")).alias("m")).select("m", time.from_micros(F.col("m")).cast("string").alias("t")).first()
        assert (r.m, r.t) == (1287275401500000, "2010-10-17 00:30:01.5")
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_mean_time_does_not_overflow(spark):
    df = spark.range(20_000).select(F.expr("TIMESTAMP_NTZ'2011-01-01 00:00:00'").alias("a"))
    assert df.agg(time.mean_micros(F.col("a"))).first()[0] == 1293840000000000


def test_bands(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 1, 1.01, 10, 10.5)], "p double")
    got = [tuple(r) for r in df.select(bands.price_band(F.col("p")), bands.price_band(F.col("p"), parity=True)).collect()]
    assert [g[0] for g in got] == ["0<.<1", "0<.<1", "1<.<2", "5<.<10", ".>10"]
    assert got[0][1] == ".>10"
    scores = spark.range(3, 10).select(bands.level(F.col("id")), bands.closeness(F.col("id"))).collect()
    assert [r[0] for r in scores] == ["Require Activation", "Needs Attention", "Promising", "Potential",
                                      "Champions", "Champions", "Can't Loose Them"]
    assert [r[1] for r in scores] == ["Clientes novos/ potenciais", "Pouco relacionamento/ regular",
                                      "Em processo de fidelização", "Em processo de fidelização", "Leal", "Leal", "Leal"]


def test_edges_of_order_ranges_are_counted_nowhere(spark):
    df = spark.createDataFrame([(50.0,), (49.9,), (5000.0,)], "basket_price double")
    found = basket.order_ranges(df).orderBy("position").collect()
    assert [r.n for r in found] == [1, 0, 0, 0, 0, 0, 0] and found[0].share_pct == 100


def test_snapshot_makes_the_last_customer_one_day_old(spark):
    table = metrics.customer_metrics(basket.baskets(frame(spark, [
        line("1", day=0), line("2", day=0.96), line("3", day=5, customer=2), line("4", quantity=-1, day=9)])
        .withColumn("QuantityCanceled", F.lit(0))))
    got = {r.CustomerID: r for r in table.collect()}
    assert got[2].Recency == 1 and got[1].Frequency == 2
    assert (got[1].Lenght, got[1].FirstPurchase - got[1].LastPurchase) == (0, 1)


def test_missing_length_shows_in_the_code_only(spark):
    df = score.with_labels(spark.createDataFrame([(4, 3, 2, None)], "R int, F int, M int, L int"))
    r = df.first()
    assert (r.RFML_Segment_Concat, r.RFML_Score, r.RFML_Level, r.Proximidade_Marca) == ("432nan", 9, "Can't Loose Them", "Leal")


def test_roots(spark):
    words = ["mugs", "mug", "boxes", "berries", "glass", "bus", "painting", "red", "painted"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select(text.root(F.col("w"))).collect()
    assert [r[0] for r in got] == ["mug", "mug", "box", "berry", "glass", "bus", "paint", "red", "paint"]


def test_band_counts_show_empty_bands(spark):
    banded = product.with_price_band(spark.createDataFrame([("A", 1.5)], "Description string, mean_price double"))
    assert [r.products for r in product.band_counts(banded).collect()] == [0, 1, 0, 0, 0, 0]


HEADER = "StockCode,InvoiceNo,Quantity,Description,UnitPrice,InvoiceDate,Country,CustomerID\n"


def test_csv_columns_go_by_name_and_integers_may_have_a_zero_fraction(spark, tmp_path):
    path = tmp_path / "data.csv"
    path.write_text(HEADER + "A1,536365,6.0,MUG,2.55,12/1/2010 8:26,UK,17850.0\nA2,536366,1,CUP,1,12/1/2010 8:28,UK,\n")
    got = {r.InvoiceNo: r for r in invoices.read_csv(spark, str(path)).collect()}
    assert (got["536365"].StockCode, got["536365"].Quantity, got["536365"].CustomerID) == ("A1", 6, 17850)
    assert got["536366"].CustomerID is None
    assert invoices.csv_rejects(spark, str(path)).count() == 0
    with pytest.raises(ValueError):
        (tmp_path / "short.csv").write_text("InvoiceNo,StockCode\n1,2\n")
        invoices.read_csv(spark, str(tmp_path / "short.csv"))


def test_csv_values_that_do_not_parse_are_errors_or_rejects(spark, tmp_path):
    path = tmp_path / "data.csv"
    path.write_text(HEADER + "A1,1,x1,MUG,2.55,12/1/2010 8:26,UK,5\nA2,2,1,CUP,1,12/1/2010 8:28,UK,5\n"
                    "A3,3,1,CUP,1,2010-12-01,UK,5.5\n")
    with pytest.raises(Exception, match="do not parse"):
        invoices.read_csv(spark, str(path)).collect()
    with pytest.raises(Exception, match="do not parse"):
        invoices.read_csv(spark, str(path)).count()  # also when no column is needed
    assert [r.InvoiceNo for r in invoices.read_csv(spark, str(path), lenient=True).collect()] == ["2"]
    rejects = {r.InvoiceNo: r.rejected for r in invoices.csv_rejects(spark, str(path)).collect()}
    assert rejects == {"1": ["Quantity"], "3": ["InvoiceDate", "CustomerID"]}


def test_parquet_times_do_not_depend_on_the_session_zone(spark, tmp_path):
    path = str(tmp_path / "x")
    frame(spark, [line()]).withColumn("InvoiceDate", F.expr("TIMESTAMP'2011-01-01 12:00:00 UTC'")).write.parquet(path)
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for z in ("UTC", "America/Sao_Paulo", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", z)
            assert invoices.read_parquet(spark, path).select(F.col("InvoiceDate").cast("string").alias("t")).first().t == "2011-01-01 12:00:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
