"""Readers: header-matched CSV layouts, mixed dates, percent text, table discovery."""
import datetime as dt
import os
import uuid

from pyspark.sql import functions as F

import pytest

from riskloom.operators.clean import parse_date, strip_percent
from riskloom.session import scratch_path
from riskloom.sources import readers as RD


def _dir(spark, name):
    return scratch_path(spark, f"test-{name}-{uuid.uuid4().hex}")


def test_both_layouts_read_by_header_name(spark):
    legacy = _dir(spark, "legacy")
    udiff = _dir(spark, "udiff")
    # columns deliberately out of the canonical order
    spark.createDataFrame([("NIFTY", "31-OCT-2024", "2024-10-15", "22000", "CE", "305.5", "1500")],
                          "Symbl string, XpryDt string, TradDt string, StrkPric string, OptnTyp string, "
                          "SttlmPric string, TtlTradgVol string").write.option("header", True).csv(legacy)
    spark.createDataFrame([("2024-10-15", "NIFTY", "2024-10-31", "", "", "22100.0", "NA")],
                          "TradDt string, TckrSymb string, XpryDt string, StrkPric string, OptnTp string, "
                          "SttlmPric string, TtlTradgVol string").write.option("header", True).csv(udiff)
    rows = RD.type_bhav(RD.read_bhavcopy(spark, legacy, udiff)).orderBy("strike").collect()
    fut, opt = rows
    assert opt.symbol == "NIFTY" and opt.expiry_date == dt.date(2024, 10, 31) and opt.strike == 22000.0
    assert opt.settle == 305.5 and opt.contracts == 1500 and opt.instrument == "OPTIDX"
    assert fut.strike == 0.0 and fut.instrument == "FUTIDX" and fut.contracts is None
    assert fut.trade_date == dt.date(2024, 10, 15)


def test_parse_date_formats_and_junk(spark):
    df = spark.createDataFrame([("2024-10-31",), ("31-OCT-2024",), ("31-10-2024",), ("junk",), (None,)], "d string")
    got = [r.x for r in df.select(parse_date("d").alias("x")).collect()]
    assert got == [dt.date(2024, 10, 31)] * 3 + [None, None]


def test_strip_percent(spark):
    df = spark.createDataFrame([("1,234.50%",), ("-0.25%",), ("n/a",)], "c string")
    assert [r.v for r in df.select(strip_percent("c").alias("v")).collect()] == [1234.5, -0.25, None]


def test_discover_tables(spark):
    root = _dir(spark, "discover")
    spark.range(3).write.parquet(os.path.join(root, "OptionChain"))
    os.makedirs(os.path.join(root, "empty_folder"))
    tables = RD.discover_tables(spark, root, layer="curated")
    assert list(tables) == ["v_curated_option_chain"] and tables["v_curated_option_chain"].count() == 3


def test_index_close_split(spark):
    path = _dir(spark, "index")
    spark.createDataFrame([
        ("Nifty 50", "02-01-1996", "1", "2", "0.5", "1.5"), ("India VIX", "02-01-1996", "-", "-", "-", "12.5"),
        ("Nifty IT", "02-01-1996", "1", "1", "1", "1"),
    ], ", ".join(f"`{c}` string" for c in RD.INDEX_CLOSE_COLUMNS)).write.option("header", True).csv(path)
    spot, vix = RD.read_index_close_csv(spark, path)
    s = spot.collect()
    assert len(s) == 1 and s[0].Index == "Nifty 50" and s[0].Close == 1.5 and s[0].Date == dt.date(1996, 1, 2)
    assert [r.VIX_Close for r in vix.collect()] == [12.5]


def _csv(spark, folder, name, text):
    """A landed file, written through Spark's own file system."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(os.path.join(folder, name))
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def test_one_folder_with_several_headers(spark):
    folder = _dir(spark, "mixed")
    _csv(spark, folder, "1.csv", "TradDt,Symbl,StrkPric,SttlmPric\n2024-01-02,NIFTY,22000,77.5\n")
    _csv(spark, folder, "2.csv", "Symbl, SttlmPric ,StrkPric,BizDt\nNIFTY,78.5,22100,2024-01-03\n")
    _csv(spark, folder, "3.csv", "")
    rows = RD.type_bhav(RD.read_bhavcopy_legacy(spark, folder)).orderBy("trade_date").collect()
    assert [(r.trade_date.isoformat(), r.strike, r.settle) for r in rows] == [("2024-01-02", 22000.0, 77.5), ("2024-01-03", 22100.0, 78.5)]


def test_positions_by_header_required_columns_and_parse_errors(spark):
    folder = _dir(spark, "positions")
    _csv(spark, folder, "p.csv", "entry_price,symbol,strike,expiry_date,option_type,quantity,entry_date\n"
         "10.5,NIFTY,22000,2024-01-25,CE,2,2024-01-02\nabc,NIFTY,,2024-13-25,PE,1.5,2024-01-02\n")
    a, b = RD.read_positions_csv(spark, folder).orderBy(F.col("entry_price").isNull()).collect()
    assert (a.symbol, a.strike, a.option_type, a.quantity, a.entry_price) == ("NIFTY", 22000.0, "CE", 2, 10.5)
    assert a.expiry_date == dt.date(2024, 1, 25) and b.expiry_date is None
    bad = RD.position_parse_errors(RD.read_positions_text(spark, folder)).collect()
    assert sorted((r.field, r.value) for r in bad) == [("entry_price", "abc"), ("expiry_date", "2024-13-25"), ("quantity", "1.5")]
    other = _dir(spark, "positions-short")
    _csv(spark, other, "p.csv", "symbol,strike\nNIFTY,1\n")
    with pytest.raises(ValueError, match="missing columns"):
        RD.read_positions_csv(spark, other)


def test_prices_of_the_feed_are_kept(spark):
    from riskloom.plans.processed import processed_derivatives
    folder = _dir(spark, "ohlc")
    _csv(spark, folder, "1.csv", "TradDt,Symbl,XpryDt,StrkPric,OptnTyp,OpnPric,HghPric,LwPric,ClsPric,SttlmPric,ChngInOpnIntrst\n"
         "2024-01-02,NIFTY,2024-01-25,22000,CE,5,7,4,6,1,33\n2024-01-02,NIFTY,2024-01-25,22000,CE,50,70,40,60,10,0\n"
         "2024-01-02,NIFTY,2024-01-25,,,5,7,4,6,1,3\n2024-01-02,OTHER,2024-01-25,,,5,7,4,6,1,3\n")
    opt, fut = processed_derivatives(RD.type_bhav(RD.read_bhavcopy_legacy(spark, folder)), RD.ARRIVAL)
    (r,) = opt.collect()
    assert (r.open, r.high, r.low, r.close, r.settle, r.chg_in_oi, r.dte) == (5.0, 7.0, 4.0, 6.0, 1.0, 33, 23)
    assert [(x.symbol, x.chg_in_oi) for x in fut.collect()] == [("NIFTY", 3)]


def test_missing_dataset_reports_no_data(spark):
    from riskloom.operators.freshness import latest_by_dataset, sync_report
    have = spark.createDataFrame([(dt.date(2024, 1, 2),)], "trade_date date")
    rep = {r.dataset: r.status for r in sync_report(latest_by_dataset({("p", "a"): have, ("p", "b"): None})).collect()}
    assert rep == {"a": "IN SYNC", "b": "NO DATA"}
