"""What landing and reading files may move."""
import os
import uuid

from riskloom import fixtures as FX
from riskloom.plans.daily import Landing, processed_tables
from riskloom.session import scratch_path


def test_trade_calendar_needs_no_deduplication(spark):
    path = os.path.join(scratch_path(spark, f"test-calendar-{uuid.uuid4().hex}"), "bhav")
    rows = [("2024-01-02", "IDO", "NIFTY", "2024-03-28", "20000", "CE", "1", "1"), ("2024-01-02", "IDO", "NIFTY", "2024-03-28", "20000", "CE", "2", "2"),
            ("2024-01-03", "IDF", " banknifty ", "28-MAR-2024", "", "", "3", "3"), ("2024-01-04", "IDO", "OTHER", "2024-03-28", "20000", "PE", "4", "4"),
            ("", "IDO", "NIFTY", "2024-03-28", "20000", "PE", "5", "5")]
    d = spark.createDataFrame(rows, "TradDt string, InstrmntType string, Symbl string, XpryDt string, StrkPric string, OptnTyp string, ClsPric string, SttlmPric string")
    d.write.option("header", True).option("compression", "gzip").csv(path)
    t = processed_tables(spark, Landing(bhav_legacy=path))
    assert sorted((str(r.trade_date), r.symbol) for r in t["trade_calendar"].collect()) == [("2024-01-02", "NIFTY"), ("2024-01-03", "BANKNIFTY")]
    assert t["options"].count() == 1 and t["futures"].count() == 1
    plan = t["trade_calendar"]._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "expiry_date" not in plan.split("Scan")[0].split("Exchange")[0]


def test_feed_rows_are_sorted_before_they_are_text(spark, sf_small):
    ids = ["l_orderkey", "l_linenumber", "l_extendedprice"]
    m = FX.Market(spark, sf_small)
    d = FX.raw_bhav_legacy(m, ids)
    got = [tuple(r) for r in d.select(*ids).collect()]
    assert got == sorted(got) and len(got) == FX.raw_bhav_legacy(m).count()
    plan = d.drop(*ids)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("TradDt") < plan.index("Sort [") and "TradDt" not in plan[plan.index("Sort ["):]


def test_stream_lands_compressed_files(spark, sf_small):
    from riskloom.queryset_ingest import _out, q_stream_landing_files
    m = FX.Market(spark, sf_small)
    assert q_stream_landing_files(spark, sf_small).count() > 0
    files = spark.read.format("text").option("recursiveFileLookup", True).load(os.path.join(_out(spark, sf_small, "landing"), "files"))
    assert all(f.endswith(".gz") for f in files.inputFiles())
    assert files.where("not value like '%TradDt%'").count() == FX.raw_bhav_legacy(m).count()
