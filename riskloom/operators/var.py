"""Historical-simulation VaR / CVaR over many portfolios and valuation dates at once.

Plan::

    spot ──lag──> returns, numbered per index (calendar-sized)
    positions ─ net per (portfolio, contract) ─ lots ─ chain ─> resolved legs ─ base price, time / vol / rate terms
          ─ last return up to the valuation date (broadcast calendar)
          ─> dealt by date, hot dates cut by contract
          ─> each contract of a date priced once under its scenarios, times the holdings,
             summed per (portfolio, date) in the task (Arrow kernel)
          ─> Σ of the tasks' vectors ─> one array of scenario PnL per (portfolio, valuation date)
          ─> VaR, CVaR, ranks: inside the row

A leg is valued on its own date with the returns known then, never with later
ones.  An array has at most ``lookback`` entries, so what is stored and shuffled grows with
portfolios x dates and not with legs x scenarios.  Why a kernel: a product of holdings
and prices needs each price many times, which rows can only express by repeating them.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..dims import SYMBOLS
from ..functions import normal as _normal
from ..functions.normal import norm_cdf_np
from ..functions.rounding import round_dec
from ..session import scratch_path
from ..shipping import ship_by_value
from ..sources.writers import write_table
from .portfolio import net_positions, normalise_positions, resolve_positions
from .scenario import option_method, prepare_shocked_pricing, with_base_price

# The kernel is pickled by value (with the numpy functions it calls), so executors
# need no copy of this package on their path.
ship_by_value(_normal)
ship_by_value(__name__)


def daily_returns(spot: DataFrame, lookback: int = 252, as_of=None) -> DataFrame:
    """Per symbol: the last ``lookback + 1`` closes up to ``as_of`` (default:
    the symbol's latest date), previous close by ``lag``, first row dropped.

    Returns symbol, trade_date, spot, prev_spot, daily_return.  All symbols
    in one window pass (partitioned by symbol: a handful of calendar-sized
    partitions).
    """
    s = spot.select("symbol", "trade_date", F.col("close").alias("spot"))
    if as_of is not None:
        s = s.filter(F.col("trade_date") <= F.lit(as_of))
    recent = s.withColumn("_rn", F.row_number().over(
        Window.partitionBy("symbol").orderBy(F.col("trade_date").desc()))).filter(F.col("_rn") <= lookback + 1)
    w = Window.partitionBy("symbol").orderBy("trade_date")
    r = recent.withColumn("prev_spot", F.lag("spot").over(w)).filter(F.col("prev_spot").isNotNull())
    return r.select("symbol", "trade_date", "spot", "prev_spot",
                    ((F.col("spot") - F.col("prev_spot")) / F.col("prev_spot")).alias("daily_return"))


def historical_scenarios(returns: DataFrame) -> DataFrame:
    """Returns as shocks: spot % = 100 x return (also at 4 dp), no vol or rate shock."""
    return returns.select(
        F.col("symbol").alias("driver_symbol"), F.col("trade_date").alias("scenario_date"),
        (F.col("daily_return") * 100.0).alias("spot_shock_pct"),
        round_dec(F.col("daily_return") * 100.0, 4).alias("spot_return_pct"),
        F.lit(0.0).alias("vol_shock_abs"), F.lit(0.0).alias("rate_shock_bps"),
    )


def numbered_returns(spot: DataFrame) -> DataFrame:
    """(driver_symbol, n, scenario_date, spot_shock_pct): every daily return of
    every index, numbered by date.  Calendar-sized windows."""
    w = Window.partitionBy("symbol").orderBy("trade_date")
    r = spot.select("symbol", "trade_date", F.col("close").alias("spot")).withColumn("prev", F.lag("spot").over(w))
    return r.filter(F.col("prev").isNotNull()).select(
        F.col("symbol").alias("driver_symbol"), F.row_number().over(w).alias("n"),
        F.col("trade_date").alias("scenario_date"),
        ((F.col("spot") - F.col("prev")) / F.col("prev") * 100.0).alias("spot_shock_pct"))


def last_known(returns: DataFrame, dates: DataFrame) -> DataFrame:
    """(driver_symbol, trade_date, last_n): the number of the last return up to
    each (driver_symbol, trade_date) of ``dates``, 0 if there is none."""
    marks = returns.select("driver_symbol", F.col("scenario_date").alias("trade_date"), "n", F.lit(False).alias("asked"))
    asked = dates.select("driver_symbol", "trade_date").distinct().withColumns(
        {"n": F.lit(0), "asked": F.lit(True)})
    w = Window.partitionBy("driver_symbol").orderBy("trade_date").rangeBetween(Window.unboundedPreceding, 0)
    both = marks.unionByName(asked).withColumn("last_n", F.max("n").over(w))
    return both.filter("asked").select("driver_symbol", "trade_date", "last_n")


def driver_map(spark, driver_symbol: str | None = "NIFTY") -> DataFrame:
    """symbol -> index whose returns shock it (4 rows of configuration).

    Parity with the source system maps every symbol to one index; ``None``
    maps each symbol to itself.  Joining it (rather than adding a literal)
    keeps the leg x scenario step an equi-join on the driver.
    """
    return spark.createDataFrame([(s, driver_symbol or s) for s in SYMBOLS], "symbol string, driver_symbol string")


GROUP = ["portfolio_id", "trade_date"]
SEGMENT = ["trade_date", "driver_symbol"]
CONTRACT = ["symbol", "expiry_date", "strike", "option_type"]
NOTHING, REPRICE, APPROX, LINEAR = 0, 1, 2, 3
# What the scenario kernel reads of a contract: equal values have equal scenario prices.
KERNEL = ["method", "spot", "strike", "rate", "q", "base_price", "delta", "gamma", "_sp_T", "_sp_s", "_sp_w", "_sp_sq", "_sp_eq", "_sp_er"]
_CELLS = 1 << 16  # (contract, scenario) values at a time: temporaries stay in cache
_HELD = 4096      # portfolio vectors a task holds before it hands them on


def dealt(legs: DataFrame, sizes: DataFrame, n: int) -> DataFrame:
    """Legs spread over ``n`` tasks by valuation date; a date with more than its share is cut by contract.

    ``sizes`` (trade_date, legs) is one row per date, so its broadcast and its
    window are calendar-sized.  A date of ``x`` % of all legs becomes about
    ``4 n x`` % pieces, so no portfolio, date or contract makes a hot task, and
    all holdings of a contract on a date stay together.
    """
    w = Window.partitionBy(F.lit(0))
    pieces = F.greatest(F.lit(1), F.ceil(F.col("legs") * (4 * n) / F.sum("legs").over(w))).cast("int")
    pieces = F.broadcast(sizes.select("trade_date", pieces.alias("_pieces")))
    salt = F.pmod(F.xxhash64(*CONTRACT), F.coalesce("_pieces", F.lit(1)))
    return legs.join(pieces, "trade_date", "left").repartition(n, F.col("trade_date"), salt).drop("_pieces")


def _prices(x: np.ndarray, shocks: np.ndarray) -> np.ndarray:
    """PnL of one lot of each contract (row of ``KERNEL``) under each spot shock (%), as in ``scenario_option``."""
    c = {name: x[:, i:i + 1] for i, name in enumerate(KERNEL)}
    out = np.zeros((len(x), len(shocks)))
    shocked = c["spot"] * (1.0 + shocks / 100.0)
    move = shocked - c["spot"]
    full, approx, linear = (x[:, 0] == m for m in (REPRICE, APPROX, LINEAR))
    if full.any():
        g = {k: v[full] for k, v in c.items()}
        S = shocked[full]
        d1 = (np.log(S / g["strike"]) + (g["rate"] - g["q"] + 0.5 * g["_sp_s"] * g["_sp_s"]) * g["_sp_T"]) / (g["_sp_s"] * g["_sp_sq"])
        d2 = d1 - g["_sp_s"] * g["_sp_sq"]
        w = g["_sp_w"]
        price = w * (S * g["_sp_eq"] * norm_cdf_np(w * d1) - g["strike"] * g["_sp_er"] * norm_cdf_np(w * d2))
        out[full] = price - g["base_price"]
    if approx.any():
        out[approx] = c["delta"][approx] * move[approx] + 0.5 * c["gamma"][approx] * move[approx] * move[approx]
    if linear.any():
        out[linear] = move[linear]
    return out


def _kernel(shocks: dict[str, np.ndarray], lookback: int, group_type: pa.DataType):
    """Sums over a task's legs: one vector of scenario PnL per (date, driver, portfolio).

    Rows come sorted by date, driver and contract.  Each different contract of
    a stretch is priced once, then the sparse product with the holdings gives
    the portfolios' vectors.
    """
    names = ["portfolio_id", *SEGMENT, "last_n", "pnl"]

    def batch(at: tuple, held: dict) -> pa.RecordBatch:
        date, driver, last = at
        n = len(held)
        values = np.concatenate(list(held.values()))
        each = len(values) // n
        pnl = pa.ListArray.from_arrays(pa.array(np.arange(0, len(values) + 1, each), pa.int32()), pa.array(values))
        return pa.RecordBatch.from_arrays(
            [pa.array(list(held), group_type), pa.array([date] * n, pa.date32()), pa.array([driver] * n, pa.string()),
             pa.array([last] * n, pa.int32()), pnl], names)

    def add(held: dict, part: pa.RecordBatch, window: np.ndarray) -> None:
        x = np.column_stack([part.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in KERNEL])
        held_by = part.column("portfolio_id").to_pylist()
        size = part.column("multiplier").to_numpy(zero_copy_only=False).astype(np.float64)
        same = (x[1:] == x[:-1]) | (np.isnan(x[1:]) & np.isnan(x[:-1]))
        contract = np.concatenate(([0], np.cumsum(~same.all(axis=1))))
        first = np.flatnonzero(np.concatenate(([True], contract[1:] != contract[:-1])))
        step = max(1, _CELLS // max(1, len(window)))
        for lo in range(0, len(first), step):
            pnl = _prices(x[first[lo:lo + step]], window)
            end = first[lo + step] if lo + step < len(first) else len(x)
            for i in range(first[lo], end):
                got = pnl[contract[i] - lo] * size[i] if x[i, 0] else 0.0
                mine = held.get(held_by[i])
                if mine is None:
                    held[held_by[i]] = np.zeros(len(window)) + got
                elif x[i, 0]:
                    mine += got

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, {}
        for b in batches:
            dates, drivers, lasts = (b.column(c).to_pylist() for c in (*SEGMENT, "last_n"))
            edges = [i for i in range(b.num_rows) if i == 0 or (dates[i], drivers[i]) != (dates[i - 1], drivers[i - 1])]
            for lo, hi in zip(edges, [*edges[1:], b.num_rows]):
                here = (dates[lo], drivers[lo], lasts[lo])
                if held and (here != at or len(held) >= _HELD):
                    yield batch(at, held)
                    held = {}
                at = here
                add(held, b.slice(lo, hi - lo), shocks[here[1]][max(0, here[2] - lookback):here[2]])
        if held:
            yield batch(at, held)
    return run


def scenario_vectors(positions: DataFrame, chain: DataFrame, futures: DataFrame, lots: DataFrame, spot: DataFrame,
                     lookback: int = 252, driver_symbol: str | None = "NIFTY", partitions: int | None = None) -> DataFrame:
    """(portfolio_id, trade_date, scenarios array<struct<scenario_date, pnl>>), in order of scenario date.

    The scenarios of a valuation date are the last ``lookback`` daily returns up
    to it.  ``driver_symbol`` = one index drives every leg (source-system
    parity); ``None`` = each leg is shocked by its own symbol's returns.

    Positions are netted per (portfolio, contract) before the market join (PnL is
    linear in the quantity); a (portfolio, date) whose legs never move gets zeros.
    Every contract of a date is priced once for all portfolios that hold it; tasks
    add up vectors of at most ``lookback`` numbers, and only those are shuffled.
    """
    net = net_positions(positions)
    opt, fut = resolve_positions(net, chain, futures, lots)
    spark = opt.sparkSession
    drv = F.broadcast(driver_map(spark, driver_symbol))
    n = partitions or max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    returns = numbered_returns(spot)
    held = normalise_positions(positions)  # dates and sizes come from the rows: netting again for them would shuffle all legs
    dates = held.select("trade_date", "symbol").distinct().join(drv, "symbol")
    known = F.broadcast(last_known(returns, dates).filter("last_n > 0"))

    method = option_method(opt)
    code = F.when(method == "full_reprice", REPRICE).when(method == "greeks_approx", APPROX).otherwise(NOTHING)
    o = opt.withColumn("_code", code)
    o = prepare_shocked_pricing(with_base_price(o).withColumns({"vol_shock_abs": F.lit(0.0), "rate_shock_bps": F.lit(0.0)}))
    o = o.withColumn("method", F.col("_code"))
    f = fut.withColumn("method", F.when(F.col("_matched"), LINEAR).otherwise(NOTHING))
    keep = ["portfolio_id", "trade_date", *(c for c in CONTRACT if c not in KERNEL), "multiplier", *KERNEL]
    blank = {k: F.lit(None).cast("double") for k in KERNEL if k not in f.columns}
    legs = o.select(*keep).unionByName(f.withColumns(blank).select(*keep))
    legs = legs.withColumns({k: F.col(k).cast("double") for k in [*KERNEL, "multiplier"]})
    sizes = held.groupBy("trade_date").agg(F.count(F.lit(1)).alias("legs"))
    legs = dealt(legs.join(drv, "symbol").join(known, ["driver_symbol", "trade_date"]), sizes, n)
    legs = legs.sortWithinPartitions(*SEGMENT, *CONTRACT).select("portfolio_id", *SEGMENT, "last_n", "multiplier", *KERNEL)

    shocks: dict[str, np.ndarray] = {}  # calendar-sized: one number per index and date
    for r in returns.groupBy("driver_symbol").agg(
            F.array_sort(F.collect_list(F.struct("n", "spot_shock_pct"))).alias("x")).collect():
        shocks[r.driver_symbol] = np.array([v.spot_shock_pct for v in r.x])
    key = next(x for x in legs.schema if x.name == "portfolio_id")
    schema = T.StructType([T.StructField("portfolio_id", key.dataType), *T.StructType.fromDDL(
        "trade_date date, driver_symbol string, last_n int, pnl array<double>").fields])
    parts = legs.mapInArrow(_kernel(shocks, lookback, to_arrow_type(key.dataType)), schema)

    # at most as many vectors per group as tasks that hold its date
    whole = parts.groupBy("portfolio_id", *SEGMENT, "last_n").agg(F.collect_list("pnl").alias("xs"))
    added = F.transform(F.col("xs")[0], lambda _, i: F.aggregate("xs", F.lit(0.0), lambda a, v: a + F.get(v, i)))
    whole = whole.withColumn("pnl", F.when(F.size("xs") == 1, F.col("xs")[0]).otherwise(added)).drop("xs")
    calendar = returns.groupBy("driver_symbol").agg(F.array_sort(F.collect_list(F.struct("n", "scenario_date"))).alias("_dates"))
    whole = whole.join(F.broadcast(calendar), "driver_symbol")
    window = F.slice("_dates", F.greatest(F.lit(1), F.col("last_n") - (lookback - 1)), F.size("pnl"))
    named = F.zip_with(window, "pnl", lambda d, v: F.struct(d["scenario_date"].alias("scenario_date"), v.alias("pnl")))
    out = whole.select(*GROUP, named.alias("scenarios"))
    if driver_symbol is not None:
        return out
    # several indices drive one portfolio: add them up by scenario date
    flat = out.select(*GROUP, F.inline("scenarios")).groupBy(*GROUP, "scenario_date").agg(F.sum("pnl").alias("pnl"))
    return flat.groupBy(*GROUP).agg(F.array_sort(F.collect_list(F.struct("scenario_date", "pnl"))).alias("scenarios"))


def flat_pnl(vectors: DataFrame) -> DataFrame:
    """(portfolio_id, trade_date, scenario_date, portfolio_pnl) of ``scenario_vectors``."""
    return vectors.select(*GROUP, F.inline("scenarios").alias("scenario_date", "portfolio_pnl"))


def scenario_pnl_by_date(positions: DataFrame, chain: DataFrame, futures: DataFrame, lots: DataFrame, spot: DataFrame,
                         lookback: int = 252, driver_symbol: str | None = "NIFTY",
                         partitions: int | None = None) -> DataFrame:
    """PnL (unrounded) per portfolio, valuation date and scenario date (``scenario_vectors``, one row per scenario)."""
    return flat_pnl(scenario_vectors(positions, chain, futures, lots, spot, lookback, driver_symbol, partitions))


def _rounded() -> Column:
    return F.transform("scenarios", lambda x: round_dec(x["pnl"], 2))


def var_cvar_vectors(vectors: DataFrame) -> DataFrame:
    """``var_cvar`` per (portfolio, valuation date), inside the row: no shuffle."""
    d = vectors.select(*GROUP, F.sort_array(_rounded()).alias("p")).withColumn("scenario_count", F.size("p").cast("bigint"))

    def quantile(share: float) -> Column:
        at = (F.col("scenario_count") - 1) * share
        lo, hi = F.floor(at), F.ceil(at)
        low, high = F.get("p", lo.cast("int")), F.get("p", hi.cast("int"))
        # equal neighbours are the quantile itself: no rounding may lift it above them
        return F.when((lo == hi) | (low == high), low).otherwise((hi - at) * low + (at - lo) * high)
    d = d.withColumns({"q95": quantile(0.05), "q99": quantile(0.01)})
    mean = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(xs), F.lit(0))
    d = d.withColumns({"t95": F.filter("p", lambda x: x < F.col("q95")), "t99": F.filter("p", lambda x: x < F.col("q99"))})
    return d.select(
        *GROUP, "scenario_count", round_dec(-F.col("q95"), 2).alias("var_95"), round_dec(-F.col("q99"), 2).alias("var_99"),
        round_dec(-F.coalesce(mean(F.col("t95")), "q95"), 2).alias("cvar_95"),
        round_dec(-F.coalesce(mean(F.col("t99")), "q99"), 2).alias("cvar_99"),
        round_dec(mean(F.col("p")), 2).alias("mean_pnl"), round_dec(F.get("p", F.lit(0)), 2).alias("min_pnl"),
        round_dec(F.element_at("p", -1), 2).alias("max_pnl"))


def _by_loss() -> Column:
    return F.array_sort(F.transform("scenarios", lambda x: F.struct(round_dec(x["pnl"], 2).alias("pnl"), x["scenario_date"].alias("scenario_date"))))


def rank_vectors(vectors: DataFrame) -> DataFrame:
    """``scenario_rank`` per (portfolio, valuation date), inside the row: no shuffle, no window."""
    d = vectors.select(*GROUP, F.posexplode(_by_loss()).alias("i", "x"))
    return d.select(*GROUP, F.col("x.scenario_date").alias("scenario_date"), F.col("x.pnl").alias("pnl"), (F.col("i") + 1).alias("loss_rank"))


def var_cvar(pnl: DataFrame, by=("portfolio_id",), value: str = "portfolio_pnl") -> DataFrame:
    """VaR/CVaR at 95% and 99% from per-scenario PnL (rounded to 2 dp first).

    VaR = -percentile (exact, linear interpolation); CVaR = -mean of the PnL
    strictly below -VaR, or VaR if there is none.  Two aggregates, the second
    over the rows and their group's percentiles: no group is gathered in a list.
    """
    by = [by] if isinstance(by, str) else list(by)
    p = pnl.select(*by, round_dec(F.col(value), 2).alias("_p"))
    g = p.groupBy(*by).agg(
        F.percentile("_p", F.array(F.lit(0.05), F.lit(0.01))).alias("_q"), F.count(F.lit(1)).alias("scenario_count"),
        F.avg("_p").alias("_mean"), F.min("_p").alias("_min"), F.max("_p").alias("_max"))
    g = g.withColumns({"_q95": F.col("_q")[0], "_q99": F.col("_q")[1]}).drop("_q")
    tail = p.join(g.select(*by, "_q95", "_q99"), by).groupBy(*by).agg(
        F.avg(F.when(F.col("_p") < F.col("_q95"), F.col("_p"))).alias("_t95"),
        F.avg(F.when(F.col("_p") < F.col("_q99"), F.col("_p"))).alias("_t99"))
    g = g.join(tail, by)
    return g.select(
        *by, "scenario_count",
        round_dec(-F.col("_q95"), 2).alias("var_95"), round_dec(-F.col("_q99"), 2).alias("var_99"),
        round_dec(-F.coalesce("_t95", "_q95"), 2).alias("cvar_95"), round_dec(-F.coalesce("_t99", "_q99"), 2).alias("cvar_99"),
        round_dec("_mean", 2).alias("mean_pnl"), round_dec("_min", 2).alias("min_pnl"),
        round_dec("_max", 2).alias("max_pnl"),
    )


def _stored(df: DataFrame) -> DataFrame:
    path = scratch_path(df.sparkSession, f"ranks/{uuid.uuid4().hex}")
    write_table(df, path)
    return df.sparkSession.read.parquet(path)


def exact_ranks(values: DataFrame, by: list[str], value: str, ranks: DataFrame, bins: int = 1024) -> DataFrame:
    """(by, target, value): the ``rank``-th smallest (from 0) of the integer column ``value`` in each group, for
    each (by, target, rank) of ``ranks``; exact, for groups of any size.

    Selection by counting: every round counts the values of each target's interval in
    ``bins`` equal parts and keeps the part that holds the rank, so an interval of
    10^12 takes four rounds.  A round's state is one number per target and part (combined
    before the shuffle); no group is sorted or gathered.
    """
    v = values.select(*by, F.col(value).cast("long").alias("_v")).where("_v is not null")
    span = v.groupBy(*by).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    at = ranks.join(span, by).select(*by, "target", F.col("rank").cast("long").alias("_rank"), "_lo", "_hi")
    widest = at.agg(F.max(F.col("_hi") - F.col("_lo") + 1)).first()[0] or 1
    key = [*by, "target"]
    for _ in range(max(1, math.ceil(math.log(widest, bins) - 1e-9))):
        # part i covers [lo + i * step, lo + (i + 1) * step)
        at = at.withColumn("_step", F.ceil((F.col("_hi") - F.col("_lo") + 1) / F.lit(bins)).cast("long"))
        spans = at.select(*by, "_lo", "_hi", "_step").distinct()  # targets share their first interval
        inside = v.join(spans, by).where("_v between _lo and _hi")
        of = [*by, "_lo", "_hi"]
        counts = inside.groupBy(*of, F.expr("(_v - _lo) div _step").alias("_bin")).agg(F.count(F.lit(1)).alias("_n"))
        w = Window.partitionBy(*of).orderBy("_bin")
        counts = counts.withColumn("_upto", F.sum("_n").over(w))
        hit = counts.join(at, of).where("_upto > _rank").groupBy(*key).agg(
            F.min_by(F.struct("_bin", (F.col("_rank") - F.col("_upto") + F.col("_n")).alias("_rank"), "_lo", "_hi", "_step"), "_bin").alias("x"))
        first = F.col("x._lo") + F.col("x._bin") * F.col("x._step")
        at = hit.select(*key, F.col("x._rank").alias("_rank"), first.alias("_lo"),
                        F.least(F.col("x._hi"), first + F.col("x._step") - 1).alias("_hi"))
        at = _stored(at)  # so that the planner knows its bytes and broadcasts it where it is small
    return at.select(*key, F.col("_lo").alias("value"))


def pooled_var(pnl: DataFrame, by=("portfolio_id",), value: str = "portfolio_pnl") -> DataFrame:
    """``var_cvar`` per group of any size (all valuation dates of a portfolio pooled): VaR by linear interpolation
    between the exact ranks, CVaR the negative mean of the PnL strictly below -VaR (or VaR if there is none), mean, least
    and largest PnL; PnL rounded to 2 dp first, sums exact in hundredths."""
    by = [by] if isinstance(by, str) else list(by)
    key, by = by, ["_group"]  # a struct is never null: a null portfolio is a group like any other
    cents = _stored(pnl.select(F.struct(*key).alias("_group"), F.round(round_dec(F.col(value), 2) * 100).cast("long").alias("cents")))  # rounded once, read every round
    whole = lambda c: F.sum(c.cast("decimal(20,0)"))
    known = cents.where("cents is not null")
    g = known.groupBy(*by).agg(F.count(F.lit(1)).alias("scenario_count"), whole(F.col("cents")).alias("_sum"),
                               F.min("cents").alias("_min"), F.max("cents").alias("_max"))
    targets = []
    for name, share in (("95", 0.05), ("99", 0.01)):
        at = (F.col("scenario_count") - 1) * share
        targets += [F.struct(F.lit(f"lo{name}").alias("target"), F.floor(at).alias("rank")),
                    F.struct(F.lit(f"hi{name}").alias("target"), F.ceil(at).alias("rank"))]
    got = exact_ranks(cents, by, "cents", g.select(*by, F.inline(F.array(*targets))))
    at = got.groupBy(*by).agg(*[F.max(F.when(F.col("target") == t, F.col("value") / 100.0)).alias(t) for t in ("lo95", "hi95", "lo99", "hi99")])

    def quantile(name: str, share: float) -> Column:
        pos = (F.col("scenario_count") - 1) * share
        lo, hi, low, high = F.floor(pos), F.ceil(pos), F.col(f"lo{name}"), F.col(f"hi{name}")
        return F.when((lo == hi) | (low == high), low).otherwise((hi - pos) * low + (pos - lo) * high)
    g = _stored(g.join(at, by).withColumns({"_q95": quantile("95", 0.05), "_q99": quantile("99", 0.01)}))  # one row per group
    below = lambda q: F.when(F.col("cents") / 100.0 < F.col(q), F.col("cents"))
    tail = known.join(g.select(*by, "_q95", "_q99"), by).groupBy(*by).agg(
        *[f.alias(f"{n}{q}") for q in ("_q95", "_q99") for n, f in (("_s", whole(below(q))), ("_n", F.count(below(q))))])

    def mean(total: str, n: str) -> Column:
        return F.col(total).cast("double") / 100.0 / F.nullif(F.col(n), F.lit(0))
    return g.join(tail, by).select(
        *[F.col(f"_group.{k}").alias(k) for k in key], "scenario_count", round_dec(-F.col("_q95"), 2).alias("var_95"), round_dec(-F.col("_q99"), 2).alias("var_99"),
        round_dec(-F.coalesce(mean("_s_q95", "_n_q95"), "_q95"), 2).alias("cvar_95"),
        round_dec(-F.coalesce(mean("_s_q99", "_n_q99"), "_q99"), 2).alias("cvar_99"),
        round_dec(mean("_sum", "scenario_count"), 2).alias("mean_pnl"),
        round_dec(F.col("_min") / 100.0, 2).alias("min_pnl"), round_dec(F.col("_max") / 100.0, 2).alias("max_pnl"))


def portfolio_var(positions: DataFrame, chain: DataFrame, futures: DataFrame, lots: DataFrame,
                  spot: DataFrame, lookback: int = 252, driver_symbol: str | None = "NIFTY") -> DataFrame:
    return var_cvar_vectors(scenario_vectors(positions, chain, futures, lots, spot, lookback, driver_symbol))


def scenario_rank(pnl: DataFrame, by=("portfolio_id",), value: str = "portfolio_pnl", top: int | None = None) -> DataFrame:
    """Scenarios ranked worst-first per group (ties by date); ``top`` keeps that many."""
    by = [by] if isinstance(by, str) else list(by)
    w = Window.partitionBy(*by).orderBy(F.col("_p"), F.col("scenario_date"))
    p = pnl.withColumn("_p", round_dec(F.col(value), 2))
    out = p.select(*by, "scenario_date", F.col("_p").alias("pnl"), F.row_number().over(w).alias("loss_rank"))
    return out if top is None else out.filter(F.col("loss_rank") <= top)


def worst_best_vectors(vectors: DataFrame) -> DataFrame:
    """``worst_best_days`` per (portfolio, valuation date), inside the row."""
    def least(sign: int) -> Column:
        return F.array_min(F.transform("scenarios", lambda x: F.struct(
            (sign * round_dec(x["pnl"], 2)).alias("p"), x["scenario_date"].alias("d"))))
    d = vectors.select(*GROUP, least(1).alias("w"), least(-1).alias("b"))
    return d.select(*GROUP, F.col("w.d").alias("worst_date"), F.col("w.p").alias("worst_pnl"),
                    F.col("b.d").alias("best_date"), (-F.col("b.p")).alias("best_pnl"))


def worst_best_days(pnl: DataFrame, by=("portfolio_id",), value: str = "portfolio_pnl") -> DataFrame:
    """Worst and best scenario date per group (earliest date on ties)."""
    by = [by] if isinstance(by, str) else list(by)
    p = pnl.withColumn("_p", round_dec(F.col(value), 2))
    return p.groupBy(*by).agg(
        F.min_by("scenario_date", F.struct(F.col("_p"), F.col("scenario_date"))).alias("worst_date"),
        F.min("_p").alias("worst_pnl"),
        F.min_by("scenario_date", F.struct(-F.col("_p"), F.col("scenario_date"))).alias("best_date"),
        F.max("_p").alias("best_pnl"),
    )


def pnl_histogram(pnl: DataFrame, bins: int = 40, by=("portfolio_id",),
                  value: str = "portfolio_pnl") -> DataFrame:
    """Counts of per-scenario PnL in ``bins`` equal-width bins per group."""
    by = [by] if isinstance(by, str) else list(by)
    p = pnl.select(*by, round_dec(F.col(value), 2).alias("_p"))
    rng = p.groupBy(*by).agg(F.min("_p").alias("_lo"), F.max("_p").alias("_hi"))
    j = p.join(rng, by)  # one row per group on the right
    width = (F.col("_hi") - F.col("_lo")) / bins
    b = F.when(F.col("_hi") == F.col("_lo"), F.lit(0)).otherwise(
        F.least(F.floor((F.col("_p") - F.col("_lo")) / width), F.lit(bins - 1))).cast("int")
    return j.withColumn("bin", b).groupBy(*by, "bin").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("_lo").alias("range_lo"), F.max("_hi").alias("range_hi"))
