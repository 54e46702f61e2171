"""Same-pass run counters and the JSON run manifest."""
import json

from pyspark.sql import functions as F

from riskloom.operators.quality import run_counts
from riskloom.sources.writers import run_manifest


def test_run_counts_observed_in_the_same_pass(spark):
    df = spark.createDataFrame([(1, None), (2, 3.0), (3, None)], "k int, v double")
    out = run_counts(df, "t_counts", ["v"])
    out.write.format("noop").mode("overwrite").save()
    m = out._riskloom_observation.get
    assert m["rows"] == 3 and m["null_v"] == 2


def test_run_manifest_is_one_json_line_per_row(spark):
    summary = spark.createDataFrame([(1, 123.45), (2, 6.0)], "portfolio_id int, var_95 double")
    lines = [json.loads(r.value) for r in run_manifest(summary, {"model": "bsm", "lookback": 252}).collect()]
    assert {l["summary"]["portfolio_id"] for l in lines} == {1, 2}
    assert all(l["params"] == {"model": "bsm", "lookback": 252} for l in lines)
