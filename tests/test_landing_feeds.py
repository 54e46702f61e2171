import os
import re
import uuid

from pyspark.sql import functions as F

from riskloom.operators.dedupe import dedupe_first
from riskloom.schemas import OPTIONS_KEY
from riskloom.session import scratch_path
from riskloom.sources import readers as RD
from riskloom.streaming.feeds import exchange_feeds
from riskloom.streaming.landing import run_feeds

LEGACY = ["TradDt", "InstrmntType", "Symbl", "XpryDt", "StrkPric", "OptnTyp", "OpnPric", "HghPric", "LwPric", "ClsPric", "SttlmPric",
          "TtlTradgVol", "OpnIntrst", "ChngInOpnIntrst"]
UDIFF = ["TradDt", "FinInstrmId", "TckrSymb", "XpryDt", "StrkPric", "OptnTp", "OpnPric", "HghPric", "LwPric", "ClsPric", "SttlmPric",
         "TtlTradgVol", "OpnIntrst", "ChngInOpnIntrst"]


def _put(folder, name, cols, rows, order=None):
    os.makedirs(folder, exist_ok=True)
    at = [cols.index(c) for c in (order or cols)]
    lines = [",".join((order or cols))] + [",".join(f'"{r[i]}"' if "," in str(r[i]) else str(r[i]) for i in at) for r in rows]
    with open(os.path.join(folder, name), "w") as f:
        f.write("\r\n".join(lines) + "\r\n")


def _contracts(day, symbol, base):
    return [(f"2024-01-{day:02d}", "IDO", symbol, "2024-03-28", k, t, base + k / 100, base + 9, base - 9, base + k / 50, base + k / 40, 10 * day, 100 + k, -day)
            for k in (20000, 20050) for t in ("CE", "PE")] + [(f"2024-01-{day:02d}", "IDF", symbol, "28-MAR-2024", "", "", 1.5, 2.5, 0.5, 1.25, 1.75, 3, 4, 5)]


def test_feeds_layouts_and_repeated_files_equal_the_batch_job(spark):
    root = scratch_path(spark, f"test-feeds-{uuid.uuid4().hex}")
    land, out, ck = (os.path.join(root, x) for x in ("landing", "tables", "ck"))
    legacy, udiff = os.path.join(land, "legacy"), os.path.join(land, "udiff")
    run = lambda: run_feeds(spark, land, exchange_feeds(out), ck, os.path.join(root, "unmatched"), max_files_per_trigger=2)
    _put(legacy, "d2.csv", LEGACY, _contracts(2, "NIFTY", 100))
    _put(legacy, "d3.csv", LEGACY, _contracts(3, "NIFTY", 200), LEGACY[::-1])
    _put(udiff, "d4.csv", UDIFF, _contracts(4, "BANKNIFTY", 300), UDIFF[5:] + UDIFF[:5])
    _put(os.path.join(land, "index"), "i.csv", RD.INDEX_CLOSE_COLUMNS, [("Nifty 50", "02-01-2024", 1, 2, 0.5, 1.5)])
    _put(os.path.join(land, "gbond_3m"), "b.csv", ["Date", "Price", "Open", "High", "Low", "Change %"], [("02-01-2024", 6.9, 6.8, 7, 6.7, "0.1%")])
    _put(os.path.join(land, "other"), "x.csv", ["a", "b"], [(1, 2), (3, 4)])
    n = run()
    assert n == {"derivatives": 15, "index_closes": 1, "bonds": 1, "unmatched": 2}

    # delivered again under other names and with other column orders, one new day, one corrected price
    _put(udiff, "d4-again.csv", UDIFF, _contracts(4, "BANKNIFTY", 300))
    _put(legacy, "d2-again.csv", LEGACY, _contracts(2, "NIFTY", 100), sorted(LEGACY))
    _put(legacy, "d5.csv", LEGACY, _contracts(5, "NIFTY", 500))
    _put(os.path.join(land, "index"), "j.csv", RD.INDEX_CLOSE_COLUMNS, [("Nifty 50", "02-01-2024", 1, 2, 0.5, 1.75)])
    assert run() == {"derivatives": 5, "index_closes": 1}
    assert run() == {}

    got = spark.read.parquet(os.path.join(out, "derivatives"))
    want = RD.type_bhav(RD.read_bhavcopy(spark, legacy, udiff))
    want = dedupe_first(want, OPTIONS_KEY, ["_file", "_row"])
    cols = [c for c in want.columns if not c.startswith("_")]
    a, b = got.select(*cols), want.select(*cols)
    assert a.count() == 20 and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    assert got.where("settle is null or open is null").count() == 0
    index = spark.read.parquet(os.path.join(out, "index")).select(F.col("trade_date").cast("string"), "index_name", "close").collect()
    assert [tuple(r) for r in index] == [("2024-01-02", "Nifty 50", 1.75)]
    bond = spark.read.parquet(os.path.join(out, "bonds")).first()
    assert (str(bond.trade_date), bond.tenor, bond.price) == ("2024-01-02", "3m", 6.9)
    lost = spark.read.parquet(os.path.join(root, "unmatched")).collect()
    assert [(r.header, r.rows) for r in lost] == [(["a", "b"], 2)]


def test_a_record_does_not_carry_the_lines_of_its_file(spark):
    from riskloom.streaming.landing import records
    root = scratch_path(spark, f"test-lines-{uuid.uuid4().hex}")
    _put(root, "a.csv", ["a", "b"], [(1, 2), (3, 4), (5, 6)])
    d = records(spark.read.format("text").option("wholetext", True).load(root))
    assert [(r._row, r._header, r._cells) for r in d.orderBy("_row").collect()] == [
        (1, ["a", "b"], ["1", "2"]), (2, ["a", "b"], ["3", "4"]), (3, ["a", "b"], ["5", "6"])]
    # the generator drops its input, all lines of the file, from its output rows
    assert re.search(r"Generate posexplode\(_lines#\d+\), \[\d+\]", d._jdf.queryExecution().optimizedPlan().toString())


def test_seen_records_are_kept_on_disk(spark):
    from riskloom.streaming.landing import STATE
    root = scratch_path(spark, f"test-state-{uuid.uuid4().hex}")
    _put(os.path.join(root, "in"), "a.csv", LEGACY, _contracts(2, "NIFTY", 100))
    assert run_feeds(spark, os.path.join(root, "in"), exchange_feeds(os.path.join(root, "out")), os.path.join(root, "ck")) == {"derivatives": 5}
    state = os.path.join(root, "ck", "state", "0")
    names = [f for d, _, fs in os.walk(state.removeprefix("file:")) for f in fs]
    assert any(f.endswith((".changelog", ".zip")) for f in names) and not any(f.endswith((".delta", ".snapshot")) for f in names)
    assert all(spark.conf.get(k, None) != v for k, v in STATE.items() if "provider" in k)


def test_table_does_not_depend_on_how_files_fall_into_batches(spark, monkeypatch):
    from riskloom.streaming import landing as L
    root = scratch_path(spark, f"test-batches-{uuid.uuid4().hex}")
    cols = ["trade_date", "symbol", "price", "seq"]
    for i, (name, rows) in enumerate((("a.csv", [("2024-01-02", "X", 5, 50), ("2024-01-02", "Y", 6, 60), ("2023-01-02", "X", 7, 70)]),
                                      ("b.csv", [("2024-01-02", "X", 1, 10), ("2024-01-02", "Y", 9, 90), ("2023-01-02", "X", 7, 70)]))):
        _put(os.path.join(root, "in"), name, cols, rows)
        os.utime(os.path.join(root, "in", name), (1_700_000_000 + i, 1_700_000_000 + i))

    def transform(d):
        return d.select(F.col("trade_date").cast("date").alias("trade_date"), "symbol", F.col("price").cast("double").alias("price"),
                        F.col("seq").cast("long").alias("seq"))

    def run(bytes_, name):
        monkeypatch.setattr(L, "BATCH_BYTES", bytes_)
        at = [os.path.join(root, f"{x}-{name}") for x in ("table", "ck")]
        n = L.run_landing_to_table(spark, os.path.join(root, "in"), cols, *at, transform, ["trade_date", "symbol"], ["seq"], stored_first=False)
        batches = [f for f in os.listdir(os.path.join(at[1], "commits").removeprefix("file:")) if f.isdigit()]
        got = spark.read.parquet(at[0]).select(F.col("trade_date").cast("string"), "symbol", "price", "seq").collect()
        return n, len(batches), sorted(tuple(r) for r in got)
    one, many = run(1 << 20, "one"), run(1, "many")
    assert many[1] > one[1] and one[0] == many[0] == 5
    assert one[2] == many[2] == [("2023-01-02", "X", 7.0, 70), ("2024-01-02", "X", 1.0, 10), ("2024-01-02", "Y", 6.0, 60)]
    # nothing of the batches is left beside the tables and checkpoints
    left = scratch_path(spark, "landing").removeprefix("file:")
    assert not os.path.exists(left) or not os.listdir(left)


def test_lines_are_shuffled_as_text_and_cut_as_before(spark):
    from riskloom.streaming import landing as L
    root = scratch_path(spark, f"test-cut-{uuid.uuid4().hex}")
    _put(root, "a.csv", ["a", " b", "c"], [("0", " 1 2 ", ""), ('"x ""y"" "', "1,5", "3"), ("2", "11", "200")])
    d = L.landing_stream(spark, root, [L.Feed("t", ["a", "b"], lambda r: r, "", ["a"])])
    assert not [f.name for f in d.schema if f.dataType.typeName() == "array"]
    got = L.cut(L.lines(L.texts(spark.read.format("text").option("wholetext", True).load(root)))).orderBy("_row").collect()
    assert [(r._header, r._cells) for r in got] == [(["a", "b", "c"], x) for x in (["0", "1 2", ""], ['x "y" ', "1,5", "3"], ["2", "11", "200"])]
