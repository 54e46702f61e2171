"""Incremental curated build equals the full build (SURVEY 5(c))."""
import dataclasses
import os
import uuid

from pyspark.sql import functions as F

from riskloom.catalog import ctx
from riskloom.plans.daily import run_curated
from riskloom.session import scratch_path
from riskloom.streaming.incremental import same_rows


def test_incremental_equals_full(spark, sf_small):
    p = ctx(spark, sf_small).processed
    root = scratch_path(spark, f"test-daily-{uuid.uuid4().hex}")
    full, inc = os.path.join(root, "full"), os.path.join(root, "inc")
    run_curated(spark, p, full, mode="full")
    first = dataclasses.replace(p, options=p.options.filter(F.dayofyear("trade_date") <= 300),
                                futures=p.futures.filter(F.dayofyear("trade_date") <= 300))
    run_curated(spark, first, inc, mode="incremental")          # first run: nothing stored -> full
    report = run_curated(spark, p, inc, mode="incremental")     # catch up
    for t in ("option_chain", "futures"):
        a = spark.read.parquet(os.path.join(full, t))
        b = spark.read.parquet(os.path.join(inc, t))
        assert a.count() == b.count() > 0
        assert same_rows(a, b).count() == 0
    rep = {r.dataset: r for r in report.collect()}
    assert set(rep) == {"options", "futures", "option_chain"} | {"futures"} and len(report.collect()) == 4
    full_latest = spark.read.parquet(os.path.join(full, "option_chain")).agg(F.max("trade_date")).first()[0]
    assert rep["option_chain"].latest_date == full_latest
    # a re-run with nothing new changes nothing
    run_curated(spark, p, inc, mode="incremental", late="upsert")
    assert same_rows(spark.read.parquet(os.path.join(full, "option_chain")),
                     spark.read.parquet(os.path.join(inc, "option_chain"))).count() == 0


def _put(spark, path, text):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


BHAV = "TradDt,Symbl,XpryDt,StrkPric,OptnTyp,OpnPric,HghPric,LwPric,ClsPric,SttlmPric,TtlTradgVol,OpnIntrst,ChngInOpnIntrst\n"


def _landing(spark, root, days):
    from riskloom.plans.daily import Landing
    index = "Index Name,Index Date,Open Index Value,High Index Value,Low Index Value,Closing Index Value\n"
    tenor = "Date,Price,Open,High,Low,Change %\n"
    dmy = ["-".join(reversed(d.split("-"))) for d in days]
    _put(spark, f"{root}/index/a.csv", index + "".join(f"Nifty 50,{d},22000,22100,21900,22050\nIndia VIX,{d},-,-,-,14\n" for d in dmy))
    _put(spark, f"{root}/yield/a.csv", "trade_date,symbol,div_yield\n" + "".join(f"{d},NIFTY,1.2\n" for d in days))
    for t in ("3m", "6m", "1y"):
        _put(spark, f"{root}/gbond_{t}/a.csv", tenor + "".join(f"{d},6.5,6.5,6.5,6.5,0%\n" for d in dmy))
    _put(spark, f"{root}/lots/a.csv", "symbol,start_date,end_date,lot_size\nNIFTY,2020-01-01,,50\n")
    return Landing(bhav_legacy=f"{root}/bhav", index_close=f"{root}/index", index_yield=f"{root}/yield",
                   gbond={t: f"{root}/gbond_{t}" for t in ("3m", "6m", "1y")}, lot_size=f"{root}/lots")


def test_landed_files_to_curated_with_late_rows(spark):
    """Full run, then a later file, then a correction and a late row in a closed year."""
    from riskloom.plans.daily import run_daily
    root = scratch_path(spark, f"test-landing-{uuid.uuid4().hex}")
    days = ["2022-12-01", "2022-12-02", "2023-01-02"]
    land = _landing(spark, root, days)
    row = lambda d, k, s: f"{d},NIFTY,{d[:4]}-12-28,{k},CE,{s},{s},{s},{s},{s},10,5,1\n"
    _put(spark, f"{root}/bhav/1.csv", BHAV + row("2022-12-01", 22000, 400) + row("2022-12-01", 22000, 999) + "2022-12-01,NIFTY,2022-12-28,,,1,2,3,4,22060,10,5,1\n")
    out = os.path.join(root, "out")

    def chain():
        return {(str(r.trade_date), r.strike): r.settle for r in spark.read.parquet(os.path.join(out, "curated", "option_chain")).collect()}
    report = {r.dataset: r.status for r in run_daily(spark, land, out).collect()}
    assert chain() == {("2022-12-01", 22000.0): 400.0} and set(report.values()) == {"IN SYNC"}
    _put(spark, f"{root}/bhav/2.csv", BHAV + row("2023-01-02", 22000, 500))
    run_daily(spark, land, out)
    assert chain() == {("2022-12-01", 22000.0): 400.0, ("2023-01-02", 22000.0): 500.0}
    _put(spark, f"{root}/bhav/0.csv", BHAV + row("2022-12-01", 22000, 410) + row("2022-12-02", 22100, 300))
    run_daily(spark, land, out)  # marks: 2022-12-02 is new, the correction is not taken
    assert chain()[("2022-12-01", 22000.0)] == 400.0 and chain()[("2022-12-02", 22100.0)] == 300.0
    run_daily(spark, land, out, late="upsert")
    assert chain() == {("2022-12-01", 22000.0): 410.0, ("2022-12-02", 22100.0): 300.0, ("2023-01-02", 22000.0): 500.0}
