"""Edge cases of single operators."""

import datetime as dt
import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark import constants as C
from tidemark.functions import dates, money, stats
from tidemark.functions import text as X
from tidemark.operators import asof, decide, entity, features, intervals, portfolio, similarity, sinks, study
from tidemark.sources import cursor, feeds, html_tables
from tidemark.streaming import pipelines

T0 = dt.datetime(2024, 3, 4, 15, 0)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def bars(spark, rows, instrument=1):
    return spark.createDataFrame([(instrument, at(m), float(c)) for m, c in rows], "instrument_id long, ts timestamp_ntz, close double")


def anchors(spark, minute=0, instrument=1):
    return spark.createDataFrame([(7, instrument, at(minute), None)], "cluster_id long, instrument_id long, anchor_ts timestamp_ntz, published_ts timestamp_ntz")


# --- as-of joins ---


def test_asof_takes_equal_times_and_carries_across_buckets(spark):
    facts = bars(spark, [(-200_000, 1), (0, 2), (10, 3)])
    probes = spark.createDataFrame([(1, at(-1)), (1, at(0)), (1, at(9)), (1, at(400_000)), (2, at(5)), (1, None)], "instrument_id long, t timestamp_ntz")
    got = {(r["instrument_id"], r["t"]): r["c"] for r in asof.asof(probes, facts, ["instrument_id"], "t").select("instrument_id", "t", F.col("fact.close").alias("c")).collect()}
    assert got == {(1, at(-1)): 1, (1, at(0)): 2, (1, at(9)): 2, (1, at(400_000)): 3, (2, at(5)): None, (1, None): None}


@pytest.mark.parametrize(("rows", "kept"), [([(-100, 1)], False), ([(-100, 1), (50, 2)], True), ([(-20, 1)], True)])
def test_stale_bar_needs_a_later_one(spark, rows, kept):
    assert bool(study.anchor_bars(anchors(spark), bars(spark, rows)).count()) is kept


# --- ladders ---


def ladder(spark, rows):
    return {r["horizon"]: round(r["raw_bps"], 6) for r in study.ladder(anchors(spark), bars(spark, rows)).collect()}


def test_horizons_use_the_last_bar_and_skip_missing_ones(spark):
    got = ladder(spark, [(-2, 100), (3, 101), (16, 102)])
    assert got["5m"] == 100.0 and got["15m"] == 100.0 and got["30m"] == 200.0 and "4h" not in got


def test_a_day_falls_forward_but_an_hour_does_not(spark):
    got = ladder(spark, [(-2, 100), (3 * 1440, 110)])
    assert got == {"1d": 1000.0, "3d": 1000.0, "5d": 1000.0} or set(got) == {"1d", "3d"}
    assert "1h" not in got


def test_no_bar_before_the_anchor_gives_nothing(spark):
    assert ladder(spark, [(5, 100), (20, 101)]) == {}


def test_beta_needs_thirty_days(spark):
    def daily(n):
        rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(days=d), 100.0 + (d * 7 * (i + 1)) % 13 + i) for i in (0, 1) for d in range(n)]
        return spark.createDataFrame(rows, "instrument_id long, ts timestamp_ntz, close double")

    assert study.beta(daily(29), 0).first()["beta"] is None
    assert study.beta(daily(30), 0).first()["beta"] is not None
    flat = daily(31).withColumn("close", F.when(F.col("instrument_id") == 0, 5.0).otherwise(F.col("close")))
    assert study.beta(flat, 0).first()["beta"] is None


def points(spark, rows):
    return spark.createDataFrame([(1, 1, T0, at(m), float(c)) for m, c in rows], "cluster_id long, instrument_id long, clock timestamp_ntz, ts timestamp_ntz, cum_bps double")


def test_half_life_ignores_the_other_sign_and_peak_takes_the_earliest(spark):
    s = study.summary(points(spark, [(1, -80), (2, 30), (3, 60), (4, 80), (5, 70)])).first()
    assert (s["peak_bps"], s["minutes_to_peak"], s["minutes_to_half"], s["direction"]) == (-80, 1, 3, "up")
    flat = study.summary(points(spark, [(1, 50), (2, 9.9)])).first()
    assert flat["direction"] == "flat" and flat["minutes_to_half"] is None


def test_recovery_after_the_trough_only(spark):
    r = study.recovery(points(spark, [(60, -40), (120, -100), (180, -50), (240, 0)])).first()
    assert (r["trough_bps"], r["hours_to_trough"], r["hours_to_half"], r["hours_to_full"]) == (-100, 2, 3, 4)
    assert study.recovery(points(spark, [(60, 5)])).count() == 0
    assert not study.recovery(points(spark, [(60, -40)])).first()["conclusive"]


def brute_series(spark, until_days, extend=False, sf="/root/testdata/sf0.001", anchors=None, bars=None, betas=None, daily=None):
    """{(cluster, ts): abnormal return} by the rules, an anchor at a time."""
    from bisect import bisect_right

    from tidemark.sources import views as V

    by = {}
    for x in (V.bars_session(spark, sf) if bars is None else bars).orderBy("ts").collect():
        by.setdefault(x["instrument_id"], []).append((x["ts"], x["close"]))
    betas = {x["instrument_id"]: x["beta"] for x in study.beta(V.bars_1d(spark, sf), 0).collect()} if betas is None else betas
    hours, day = dt.timedelta(hours=72), dt.timedelta(days=1)

    def settled(bars, when, clock):
        bars = [b for b in bars if clock - hours <= b[0] <= clock + 8 * day]
        i = bisect_right([b[0] for b in bars], when) - 1
        return bars[i] if i >= 0 and (when - bars[i][0] <= dt.timedelta(minutes=30) or i + 1 < len(bars)) else None

    out = {}
    for x in (V.anchors(spark, sf) if anchors is None else anchors).collect():
        clock, own, bench, beta = x["anchor_ts"], by.get(x["instrument_id"], []), by.get(0, []), betas.get(x["instrument_id"])
        at, until = clock - dt.timedelta(minutes=1), clock + until_days * day
        a, ba = settled(own, at, clock), settled(bench, at, clock)
        if not a:
            continue
        if extend and not any(a[0] < b[0] <= until for b in own):
            until = next((b[0] for b in own if until < b[0] <= until + 3 * day), until)
        if daily:  # minute bars of the loaded window, then closes of days that end after the last of them
            own, bench = ([*m, *((ts + day, close) for ts, close in daily.get(i, []) if not m or ts + day > m[-1][0])] for i, m in ((x["instrument_id"], [b for b in own if b[0] <= clock + 8 * day]), (0, [b for b in bench if b[0] <= clock + 8 * day])))
        for ts, close in own:
            if a[0] < ts <= until:
                cum = (close - a[1]) / a[1] * 1e4
                bb = [b for b in bench if b[0] <= ts][-1:]
                if beta is not None and ba and bb and bb[0][0] > ba[0]:
                    cum -= beta * (bb[0][1] - ba[1]) / ba[1] * 1e4
                out[x["cluster_id"], ts] = cum
    return out


def test_series_take_the_benchmark_off_at_every_bar(spark):
    both = bars(spark, [(-10, 100), (2, 102), (20, 104)]).unionByName(bars(spark, [(-5, 50), (10, 51)], 0))
    a = spark.createDataFrame([(1, 1, T0)], "cluster_id long, instrument_id long, anchor_ts timestamp_ntz")
    betas = spark.createDataFrame([(1, 0.5)], "instrument_id long, beta double")
    got = [x["cum_bps"] for x in study.series(a, both, 1, betas=betas, benchmark=0).orderBy("ts").collect()]
    assert got == pytest.approx([200, 400 - 0.5 * 200])  # the benchmark hasn't moved at the first bar
    assert list(brute_series(spark, 1, anchors=a, bars=both, betas={1: 0.5}).values()) == pytest.approx(got)


def test_summaries_are_abnormal_and_fall_forward(spark):
    from tidemark.plans import registry

    want, last = brute_series(spark, 1, extend=True), {}
    for (cluster, ts), cum in sorted(want.items()):
        last[cluster] = cum
    got = {x["cluster_id"]: x for x in registry.QUERIES["reaction_summary"](spark, "/root/testdata/sf0.001").collect()}
    assert {k: x["move_bps"] for k, x in got.items()} == pytest.approx(last, abs=1e-5)
    assert sum(x["n_points"] for x in got.values()) == len(want) and set(last) > {k for k, _ in brute_series(spark, 1)}


def test_series_of_all_stories(spark):
    from tidemark.plans import registry

    got = {(x["cluster_id"], x["ts"]): x["cum_bps"] for x in registry.QUERIES["cumulative_series"](spark, "/root/testdata/sf0.001").collect()}
    assert got == pytest.approx(brute_series(spark, 1), abs=1e-5) and len({k % 7 for k, _ in got}) > 1


def test_recoveries_of_falls_last_thirty_days(spark):
    from tidemark.plans import registry
    from tidemark.sources import views as V

    sf = "/root/testdata/sf0.001"
    daily = {}
    for x in V.bars_1d(spark, sf).orderBy("ts").collect():
        daily.setdefault(x["instrument_id"], []).append((x["ts"] + dt.timedelta(days=8400), x["close"]))
    start = {x["cluster_id"]: x["anchor_ts"] for x in V.anchors(spark, sf).collect()}
    fell = {x["cluster_id"] for x in registry.QUERIES["reaction_abnormal"](spark, sf).filter("horizon = '1d' AND abnormal_bps <= -50").collect()}
    low = {}
    for (cluster, ts), cum in brute_series(spark, 30, daily=daily).items():
        if ts > start[cluster] and cluster in fell:
            low[cluster] = min(low.get(cluster, (0.0, None)), (cum, ts))
    got = {x["cluster_id"]: x for x in registry.QUERIES["recovery"](spark, sf).collect()}
    assert {k: x["trough_bps"] for k, x in got.items()} == pytest.approx({k: v[0] for k, v in low.items() if v[0] < 0}, abs=1e-3)
    assert 0 < len(got) < len(start) and any(x["days_used"] >= C.CONCLUSIVE_DAYS for x in got.values())


def test_account_counts_the_cash_of_all_instruments(spark):
    from tidemark.operators import broker
    from tidemark.plans import registry
    from tidemark.sources import views as V

    rows = [(1, "buy", 2.0, 10.0, 0.5), (40, "buy", 3.0, 5.0, 0.25), (40, "sell", 1.0, 6.0, 0.25)]
    fills = spark.createDataFrame(rows, "instrument_id long, side string, qty double, price double, fee double")
    got = broker.account(fills, bars(spark, [(0, 11)]), F.lit(at(5)).cast("timestamp_ntz"), 100.0).first()
    assert tuple(got) == pytest.approx((100 - 20.5 - 15.25 + 5.75, 22, 92))
    none = broker.account(fills.filter("instrument_id = 40"), bars(spark, [(0, 11)]), F.lit(at(5)).cast("timestamp_ntz"), 100.0).first()
    assert tuple(none) == pytest.approx((90.5, 0, 90.5))
    all_fills = V.fills(spark, "/root/testdata/sf0.001").collect()
    cash = 1_000_000 + sum((-1 if x["side"] == "buy" else 1) * x["qty"] * x["price"] - x["fee"] for x in all_fills)
    assert registry.QUERIES["account_state"](spark, "/root/testdata/sf0.001").first()["cash_usd"] == pytest.approx(float(cash), abs=0.01)


def test_return_of_a_bad_price_fails(spark):
    with pytest.raises(Exception, match="positive"):
        one(spark, money.return_bps(F.lit(0.0), F.lit(1.0)))


# --- statistics ---


def test_wilson_and_deciles(spark):
    assert one(spark, stats.wilson(F.lit(0), F.lit(0))[0]) is None
    assert one(spark, stats.decile(F.lit(1.0))) == 9 and one(spark, stats.decile(F.lit(-3.0))) == 0
    df = spark.createDataFrame([(0.05, True), (0.95, False)], "score double, hit boolean")
    c = stats.calibration(df).orderBy("bucket").collect()
    assert len(c) == 10 and c[5]["n"] == 0 and c[5]["rate"] is None and c[0]["rate"] == 1.0


def test_spearman_nulls(spark):
    f = lambda rows: stats.spearman(spark.createDataFrame(rows, "x double, y double"), "x", "y").first()["rho"]
    assert f([(1.0, 2.0), (2.0, 3.0)]) is None
    assert f([(1.0, 2.0), (1.0, 3.0), (1.0, 4.0)]) is None
    assert f([(1.0, 3.0), (2.0, 2.0), (3.0, 1.0)]) == pytest.approx(-1)


def test_drawdown_starts_at_the_cash(spark):
    t = spark.createDataFrame([("a", 1, -10.0), ("a", 2, 30.0), ("a", 3, -60.0)], "r string, i int, realized_usd double")
    assert stats.max_drawdown(t, 100.0, ["r"], ["i"]).first()["max_drawdown_pct"] == pytest.approx(50.0)


# --- features and intervals ---


def daily(spark, ranges):
    rows = [(1, dt.datetime(2024, 1, 1) + dt.timedelta(days=i), float(h), float(lo), float(c), 10) for i, (h, lo, c) in enumerate(ranges)]
    return spark.createDataFrame(rows, "instrument_id long, ts timestamp_ntz, high double, low double, close double, volume long")


def test_atr_seed_smoothing_and_too_few(spark):
    ranges = [(10, 8, 9)] * 4 + [(14, 8, 9)]
    assert features.wilder_atr(daily(spark, ranges), 3).first()["atr"] == pytest.approx((2 * 2 + 6) / 3)
    assert features.wilder_atr(daily(spark, ranges[:3]), 3).first()["atr"] is None


def test_liquidity_needs_ten_days(spark):
    assert features.median_dollar_volume(daily(spark, [(1, 1, 2)] * 9)).first()["median_dollar_volume"] is None
    assert features.median_dollar_volume(daily(spark, [(1, 1, 2)] * 10)).first()["median_dollar_volume"] == 20


@pytest.mark.parametrize(("minute", "instrument", "hit"), [(60, 1, True), (61, 1, False), (-60, None, True), (0, 2, False)])
def test_calendar_edges(spark, minute, instrument, hit):
    cal = spark.createDataFrame([(instrument, at(minute))], "instrument_id long, scheduled_at timestamp_ntz")
    assert features.calendar_match(anchors(spark), cal, "cluster_id", "anchor_ts").first()["calendar_match"] is hit


def windows(spark, rows):
    return spark.createDataFrame([("k", at(a), at(b)) for a, b in rows], "k string, from_ts timestamp_ntz, to_ts timestamp_ntz")


def test_touching_nested_and_chained_windows(spark):
    got = intervals.coalesce(windows(spark, [(0, 10), (10, 20), (12, 15), (30, 40), (35, 50)]), ["k"]).orderBy("from_ts").collect()
    assert [(r["from_ts"], r["to_ts"], r["n"]) for r in got] == [(at(0), at(20), 3), (at(30), at(50), 2)]
    with pytest.raises(Exception, match="before it starts"):
        intervals.coalesce(windows(spark, [(5, 1)]), ["k"]).collect()


def test_versions_close_and_open(spark):
    h = spark.createDataFrame([(1, at(0), None), (2, at(0), None), (3, at(0), at(5))], "id long, valid_from timestamp_ntz, valid_to timestamp_ntz")
    out = {(r["id"], r["valid_from"], r["valid_to"]) for r in intervals.apply_versions(h, spark.createDataFrame([(2,), (3,)], "id long"), ["id"], F.lit(at(9))).collect()}
    assert out == {(1, at(0), at(9)), (2, at(0), None), (3, at(0), at(5)), (3, at(9), None)}


# --- dates ---


def test_sessions_openings_and_summer_time(spark):
    t = lambda *a: F.lit(dt.datetime(*a)).cast("timestamp_ntz")
    assert one(spark, dates.session(t(2024, 1, 3, 14, 30))) == "rth" and one(spark, dates.session(t(2024, 7, 3, 13, 30))) == "rth"
    assert one(spark, dates.session(t(2024, 1, 3, 14, 29))) == "pre" and one(spark, dates.session(t(2024, 1, 6, 15, 0))) == "weekend"
    assert one(spark, dates.next_open(t(2024, 1, 3, 14, 30))) == dt.datetime(2024, 1, 4, 14, 30)
    assert one(spark, dates.next_open(t(2024, 1, 3, 14, 29))) == dt.datetime(2024, 1, 3, 14, 30)
    wall = lambda m, d: one(spark, dates.wall_clock(F.lit(2024), F.lit(m), F.lit(d), F.lit(8), F.lit(30)))
    assert wall(1, 10).hour == 13 and wall(7, 10).hour == 12 and wall(2, 30) is None


# --- decisions ---


def signal(spark, **changes):
    row = {"direction": "bullish", "confidence": 0.9, "already_expected": False, "calendar_match": False, "event_type": "earnings", "move_bps": 10.0, "median_dollar_volume": 1e7, "open_positions": 0, "has_position": False, "asset_class": "us_equity"} | changes
    kinds = "direction string, confidence double, already_expected boolean, calendar_match boolean, event_type string, move_bps double, median_dollar_volume double, open_positions int, has_position boolean, asset_class string"
    return spark.createDataFrame([tuple(row.values())], kinds)


RULES = C.RULES | {"event_types": ("earnings",)}


@pytest.mark.parametrize(
    ("changes", "reason"),
    [({}, None), ({"direction": "bearish"}, "direction_actionable"), ({"confidence": 0.74}, "min_confidence"), ({"already_expected": True}, "already_expected"), ({"calendar_match": True}, "calendar_match"), ({"event_type": "legal"}, "event_type_whitelist"), ({"move_bps": None}, "stale_move"), ({"move_bps": -300.1}, "stale_move"), ({"median_dollar_volume": None}, "liquidity"), ({"median_dollar_volume": None, "asset_class": "crypto"}, None), ({"open_positions": 10}, "max_concurrent_positions"), ({"has_position": True}, "no_existing_position"), ({"confidence": None, "has_position": True}, "min_confidence")],
)
def test_gates(spark, changes, reason):
    r = decide.screened(signal(spark, **changes), RULES).first()
    assert r["skip_reason"] == reason and len(r["gates"]) == 9


def test_default_rules_trade_nothing(spark):
    assert decide.screened(signal(spark)).first()["skip_reason"] == "event_type_whitelist"


@pytest.mark.parametrize(
    ("atr", "price", "kind", "qty", "reason"),
    [("2.5", "100", "us_equity", Decimal(100), None), ("1.3", "100", "us_equity", Decimal(100), None), ("20", "100", "us_equity", Decimal(12), None), ("20", "100", "crypto", Decimal("12.5"), None), (None, "100", "us_equity", None, "atr_available"), ("0", "100", "us_equity", None, "atr_available"), ("300", "100", "us_equity", None, "position_too_small")],
)
def test_sizing(spark, atr, price, kind, qty, reason):
    df = spark.createDataFrame([(atr, price, kind)], "atr string, price string, asset_class string").select(F.col("atr").cast("decimal(18,6)").alias("atr"), F.col("price").cast("decimal(18,6)").alias("price"), "asset_class")
    r = decide.sized(df, 100_000.0).first()
    assert (r["qty"], r["size_reason"]) == (qty, reason)
    plain = portfolio.size(Decimal(100_000), None if atr is None else float(atr), Decimal(price), kind == "crypto", C.RULES)
    assert plain == (qty, reason)


def exits(spark, price, minute, **rules):
    f = decide.exit_reason(F.lit(100.0), F.lit(float(price)), F.lit(True), F.lit(2.0), F.lit(T0), F.lit(at(minute)), F.lit(24.0), C.RULES | rules)
    return one(spark, f)


def test_exit_order(spark):
    assert exits(spark, 96, 1) == "stop_loss" and exits(spark, 96, 5000) == "stop_loss"
    assert exits(spark, 120, 1) is None and exits(spark, 120, 1, take_profit_atr_multiple=3) == "take_profit"
    assert exits(spark, 100, 1440) == "time_stop" and exits(spark, 100, 1439) is None
    assert exits(spark, 1, 1, stop_atr_multiple=0) is None


def test_time_stop_beyond_the_deadline_unless_strict(spark):
    p = spark.createDataFrame([(1, 1, T0, 100.0, True, 0.0, 24.0)], "position_id long, instrument_id long, opened_at timestamp_ntz, entry_price double, is_long boolean, atr double, hours double")
    b = bars(spark, [(10, 101), (1500, 102)])
    assert decide.exit_instants(p, b, strict=False).first()["exit_ts"] == at(1500)
    assert decide.exit_instants(p, b).first()["exit_ts"] is None
    assert decide.exit_instants(p, b.unionByName(bars(spark, [(1440, 103)]))).first()["exit_ts"] == at(1440)


@pytest.mark.parametrize("strict", [True, False])
def test_exits_by_day_extremes_are_those_of_all_bars(spark, strict):
    import random

    r = random.Random(3)
    closes = {(i, m): 100 + r.gauss(0, 6) for i in (1, 2) for m in r.sample(range(-600, 8 * 1440), 500)}
    b = bars(spark, [(m, c) for (i, m), c in closes.items() if i == 1]).unionByName(bars(spark, [(m, c) for (i, m), c in closes.items() if i == 2], 2))
    rows = [(n, r.choice((1, 2)), at(r.randrange(0, 4000)), 100 + r.gauss(0, 5), r.random() < 0.5, r.choice((None, 0.0, 2.0, 5.0, 9.0)), r.choice((6.5, 24.0, 72.0))) for n in range(150)]
    p = spark.createDataFrame(rows, "position_id long, instrument_id long, opened_at timestamp_ntz, entry_price double, is_long boolean, atr double, hours double")
    rules = C.RULES | {"take_profit_atr_multiple": 3}
    want = {}
    for n, i, opened, entry, long, atr, hours in rows:
        end = opened + dt.timedelta(hours=hours)
        last = end if strict else end + dt.timedelta(days=3)
        for m, c in sorted((at(m), c) for (j, m), c in closes.items() if j == i):
            if n not in want and opened < m <= last:
                gain = c - entry if long else entry - c
                why = "stop_loss" if (atr or 0) > 0 and -gain >= atr * 2 else "take_profit" if (atr or 0) > 0 and gain >= atr * 3 else "time_stop" if m >= end else None
                if why:
                    want[n] = (m, c, why)
    got = {x["position_id"]: (x["exit_ts"], x["exit_price"], x["exit_reason"]) for x in decide.exit_instants(p, b, rules, strict=strict).collect()}
    assert len(got) == 150 and {k: v for k, v in got.items() if v[0]} == want


def test_backtest_marks_positions_at_the_last_bar(spark):
    w = world(spark, [(1, 0, 1, None, 100.0, None, None), (2, 60, 2, "liquidity", 50.0, None, None), (3, 3000, 2, "liquidity", 50.0, None, None)])
    m = portfolio.marked(w, bars(spark, [(0, 100), (50, 120), (61, 500)]))
    assert {x["signal_id"]: x["marks"] for x in m.collect()} == {1: {1: 100.0}, 2: {1: 120.0}, 3: None}  # the last bar is older than a day
    d = {x["signal_id"]: x for x in portfolio.backtest(m, 100_000.0)[0].collect()}
    cost = d[1]["qty"] * 100.05
    assert d[2]["equity"] == pytest.approx(100_000 - cost + d[1]["qty"] * 120, abs=0.02) and d[3]["equity"] == pytest.approx(100_000, abs=0.02)


def test_long_chains_are_one_group(spark):
    from tidemark.operators import similarity

    chain = spark.range(300).selectExpr("id AS a", "id + 1 AS b")
    assert {x["group"] for x in similarity.groups(chain).collect()} == {0}


def test_fill_rounds_half_away(spark):
    d = lambda x: F.lit(x).cast("decimal(18,6)")
    price, qty, fee = decide.filled(F.lit("buy"), d("100.001"), F.lit("2").cast("decimal(20,8)"), F.lit(26))
    assert one(spark, price) == Decimal("100.051001") and one(spark, fee) == Decimal("0.520265") and one(spark, qty) == Decimal(2)
    assert one(spark, decide.filled(F.lit("sell"), d("100.001"), F.lit("2").cast("decimal(20,8)"), F.lit(0))[0]) == Decimal("99.951000")


def test_lot_crosses_zero():
    D = Decimal
    held, cost, realized, fees, cash = portfolio.lots_of([("buy", D(5), D(100), D(1)), ("sell", D(8), D(110), D(1))])
    assert (held, cost, realized, fees, cash) == (D(-3), D(330), D(50), D(2), D(378))
    held, cost, realized, *_ = portfolio.lots_of([("buy", D(3), D(10), D(0)), ("sell", D(1), D(13), D(0))])
    assert (held, cost, realized) == (D(2), D(20), D(3))
    with pytest.raises(ValueError, match="positive"):
        portfolio.lots_of([("buy", D(0), D(1), D(0))])


def world(spark, rows):
    kinds = "run_id string, signal_id long, decision_at timestamp_ntz, instrument_id long, asset_class string, direction string, world_reason string, quote double, atr double, exit_ts timestamp_ntz, exit_price double, exit_reason string"
    return spark.createDataFrame([("r", i, at(m), inst, "us_equity", "bullish", why, q, 2.0, at(x) if x else None, p, "time_stop") for i, m, inst, why, q, x, p in rows], kinds)


def test_backtest_sees_its_own_opens(spark):
    w = world(spark, [(1, 0, 1, None, 100.0, 30, 110.0), (2, 1, 1, None, 100.0, 40, 90.0), (3, 2, 2, None, 50.0, None, None), (4, 50, 1, None, 100.0, 60, 100.0), (5, 51, 3, "liquidity", 10.0, None, None), (6, 52, 4, None, None, None, None)])
    d, t = portfolio.backtest(w, 100_000.0, C.RULES | {"max_positions": 2})
    got = {r["signal_id"]: (r["action"], r["skip_reason"]) for r in d.collect()}
    assert got == {1: ("open_long", None), 2: ("skip", "no_existing_position"), 3: ("open_long", None), 4: ("open_long", None), 5: ("skip", "liquidity"), 6: ("skip", "no_quote")}
    trades = {r["signal_id"]: r for r in t.collect()}
    assert set(trades) == {1, 4} and trades[1]["realized_usd"] > 0 and trades[4]["realized_usd"] < 0
    again, _ = portfolio.backtest(w, 100_000.0, C.RULES | {"max_positions": 2})
    assert {r["outcome"] for r in portfolio.compare(d, again, ["run_id", "signal_id"], ["action", "skip_reason", "qty"]).collect()} == {"same"}


def test_halt_switch():
    assert decide.may_trade(None) and decide.may_trade("run") and not decide.may_trade("halt") and not decide.may_trade("")


# --- text ---


@pytest.mark.parametrize(("raw", "plain"), [("The Coca-Cola Company", "Coca-Cola"), ("Alphabet Inc. (Class A)", "Alphabet"), ("Gap, Inc. (The)", "Gap"), ("Amazon.com, Inc.", "Amazon.com"), ("3M", "3M"), ("Company", "Company"), ("Berkshire Hathaway Class B", "Berkshire Hathaway"), ("Subclass A", "Subclass A"), ("Tyson Foods Co", "Tyson Foods")])
def test_names(spark, raw, plain):
    assert one(spark, X.stripped_name(F.lit(raw))) == plain


def test_text_functions(spark):
    assert one(spark, X.normalised(F.lit("Hello,  WORLD! https://a.b/c $5.20 50%"))) == "hello world $5.20 50%"
    assert one(spark, X.shingles(F.lit("a b"), 3)) == ["a b"] and one(spark, X.shingles(F.lit(""), 3)) == []
    assert one(spark, X.jaccard(F.array().cast("array<string>"), F.array(F.lit("a")))) == 0.0
    assert one(spark, X.strip_page(F.lit("<!-- x --><script>var a='<b>'</script><p>A&amp;B &#8217;s &#x41;&nbsp;c</p>"))) == "A&B ’s A c"
    assert one(spark, X.lede(F.lit("<p> </p>"), F.lit("<b>yes</b>"))) == "yes" and one(spark, X.lede(F.lit("<p></p>"))) is None
    assert one(spark, X.padded_cik(F.lit("123"))) == "0000000123" and one(spark, X.padded_cik(F.lit("12345678901"))) is None
    assert one(spark, X.cashtags(F.lit("$AAPL and $5 and $BRK.B"))) == ["AAPL", "BRK.B"]
    assert one(spark, X.mentions(F.lit("pay 3M now"), "3M", True)) and not one(spark, X.mentions(F.lit("3Ms"), "3M", True))


def test_similar_sets_equal_brute_force(spark):
    import itertools
    import random

    r = random.Random(4)
    sets = {i: sorted({f"t{r.randrange(12)}" for _ in range(r.randrange(1, 9))}) for i in range(60)}
    got = {(x["a"], x["b"]): round(x["similarity"], 9) for x in similarity.similar_sets(spark.createDataFrame(list(sets.items()), "k long, t array<string>"), "k", "t", 0.5).collect()}
    want = {}
    for a, b in itertools.combinations(sets, 2):
        s = len(set(sets[a]) & set(sets[b])) / len(set(sets[a]) | set(sets[b]))
        if s >= 0.5:
            want[a, b] = round(s, 9)
    assert got == want


def test_leaders_keep_order_hours_and_ciks(spark):
    hour = 60
    rows = [(1, "h1", at(0), None), (2, "h2", at(hour), "A"), (3, "h3", at(2 * hour), "B"), (4, "h1", at(3 * hour), None), (5, "h5", at(100 * hour), None), (6, "h6", at(0), None)]
    items = spark.createDataFrame(rows, "item_id long, content_hash string, received_at timestamp_ntz, cik string")
    edges = spark.createDataFrame([(1, 2, 0.6), (1, 3, 0.9), (1, 5, 0.9)], "a long, b long, similarity double")
    got = {r["item_id"]: r["leader_id"] for r in similarity.leader_clusters(items, edges).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 1, 5: 5, 6: 6}


def test_resolution_guards(spark):
    d = spark.createDataFrame([("IT", "ticker", 1, "us_equity"), ("AAPL", "ticker", 2, "us_equity"), ("0000000009", "cik", 3, "us_equity"), ("KO", "name", 4, "us_equity"), ("3M", "name", 5, "us_equity"), ("Group", "name", 6, "us_equity"), ("BTC", "ticker", 7, "crypto"), ("Apple", "name", 2, "us_equity")], "alias string, kind string, instrument_id long, asset_class string")
    rows = [(1, "IT and $IT", "", ["IT"], None), (2, "apple and AAPL", "NYSE: AAPL", [], None), (3, "Apple", "", [], "9"), (4, "KO Group 3M 3m BTC", "", [], None), (5, "3m btc", "", [], None), (6, "x", "", ["AAPL"], None)]
    items = spark.createDataFrame(rows, "item_id long, headline string, body string, hints array<string>, cik string")
    got = {(r["item_id"], r["instrument_id"]): (r["method"], r["confidence"]) for r in entity.resolve(items, d).collect()}
    assert got == {(1, 1): ("cashtag", 0.85), (2, 2): ("exchange_prefix", 0.9), (3, 3): ("cik", 1.0), (4, 5): ("name_alias", 0.7), (4, 7): ("crypto_keyword", 0.8), (6, 2): ("source_hint", 0.65)}


def test_promotion_and_fan_out(spark):
    new, verdicts = entity.promote(spark.createDataFrame([(1, 10), (1, 11), (2, 12)], "item_id long, instrument_id long"), spark.createDataFrame([(1, [10, 99]), (2, [])], "item_id long, instruments array<long>"))
    assert [(r["item_id"], r["instrument_id"]) for r in new.collect()] == [(1, 10)] and {r["item_id"]: r["n_confirmed"] for r in verdicts.collect()} == {1: 1, 2: 0}
    j = spark.createDataFrame([(1, T0, 100.0, [("tech", 0.5), ("energy", 1.0)])], "judgment_id long, anchor_ts timestamp_ntz, expected_move_bps double, sectors array<struct<sector: string, materiality: double>>")
    u = spark.createDataFrame([(1, "tech", at(-9), None), (2, "energy", at(-9), at(-1)), (3, "energy", at(-9), at(9))], "instrument_id long, sector string, valid_from timestamp_ntz, valid_to timestamp_ntz")
    assert {(r["instrument_id"], r["move_bps"], r["weight"]) for r in entity.fan_out(j, u).collect()} == {(1, 50.0, 0.5), (3, 100.0, 0.5)}


# --- sources and sinks ---


def payload(spark, value):
    return spark.createDataFrame([(value if isinstance(value, str) else json.dumps(value),)], "p string")


def test_snapshot_drops_untraded_and_forming(spark):
    bar = lambda t: {"o": 1, "h": 2, "l": 1, "c": 2, "v": 5, "t": t}
    p = payload(spark, {"status": "OK", "tickers": [{"ticker": "A", "min": bar(60_000)}, {"ticker": "B", "min": bar(0)}, {"ticker": "C", "min": bar(120_000)}, {"ticker": "D"}]})
    assert [r["symbol"] for r in feeds.snapshot(p, "p", F.lit(150_000).cast("long")).collect()] == ["A"]
    with pytest.raises(Exception, match="good status"):
        feeds.snapshot(payload(spark, {"status": "NO", "tickers": [{"ticker": "A", "min": bar(60_000)}]}), "p", F.lit(150_000).cast("long")).collect()


def test_similar_sets_against_brute_force(spark, monkeypatch):
    """Exact at several thresholds; of sets that share frequent tokens alone hardly a pair leaves the join."""
    import random

    r = random.Random(4)
    sets = {k: {f"t{min(r.randrange(60), r.randrange(60))}" for _ in range(r.randrange(1, 24))} for k in range(300)}
    sets |= {300 + k: {*list(sets[k])[1:], "n"} for k in range(40)} | {400 + k: set(sets[k]) for k in range(20)}
    monkeypatch.setattr(similarity, "BLOCK_SETS", 7, raising=False)
    frame, asked = spark.createDataFrame([(k, sorted(v)) for k, v in sets.items()], "k long, t array<string>"), []
    distinct = type(frame).distinct
    monkeypatch.setattr(type(frame), "distinct", lambda self: asked.append(self.count()) or distinct(self))
    for threshold in (0.3, 0.5, 0.8, 1.0):
        want = {(a, b): round(len(x & y) / len(x | y), 9) for a, x in sets.items() for b, y in sets.items() if a < b and len(x & y) / len(x | y) >= threshold}
        got = similarity.similar_sets(frame, "k", "t", threshold).collect()
        assert {(x["a"], x["b"]): round(x["similarity"], 9) for x in got} == want and len(got) == len(want)
        if threshold == 0.5:
            assert asked[-1] < 12 * len(want), "each pair leaves the join once for each token in common at most, and few others do"


def one_by_one(rows, edges, hours):
    """item_id: (leader_id, similarity), all items in one list."""
    near, start, last, ciks, by_hash, out, reach = {}, {}, {}, {}, {}, {}, dt.timedelta(hours=hours)
    for a, b, s in edges:
        near.setdefault(a, []).append((-s, b))
        near.setdefault(b, []).append((-s, a))
    for i, h, t, cik in sorted(rows, key=lambda r: (r[2] is None, r[2] or T0, r[0])):
        free = lambda lead: cik is None or ciks[lead] in (None, cik)
        lead, s = by_hash.get(h), 1.0
        if lead is None or not free(lead):
            found = [(s, o) for s, o in near.get(i, []) if o in start and None not in (t, start[o]) and t - start[o] <= reach and t - last[o] <= reach and free(o)]
            s, lead = min(found) if found else (-1.0, i)
            s = -s
        if lead == i:
            start[i], last[i], ciks[i] = t, t, None
        last[lead], ciks[lead] = t if None not in (t, last[lead]) else last[lead], ciks[lead] or cik
        if h is not None:
            by_hash.setdefault(h, lead)
        out[i] = (lead, round(s, 9))
    return out


def test_leaders_against_one_by_one(spark, monkeypatch):
    """Sets, times and ciks by chance; pairs further apart in time than a leader stays open neither leave the join nor link groups."""
    import random

    r = random.Random(6)
    sets = {i: {f"t{min(r.randrange(14), r.randrange(14))}" for _ in range(r.randrange(2, 6))} for i in range(240)}
    when = {i: at(r.randrange(0, 600 * 60)) if i % 40 else None for i in sets}
    rows = [(i, " ".join(sorted(sets[i])) if i % 17 else None, when[i], r.choice([None, None, "A", "B"])) for i in sets]
    every = [(a, b, len(sets[a] & sets[b]) / len(sets[a] | sets[b])) for a in sets for b in sets if a < b]
    every = [e for e in every if e[2] >= 0.5]
    items = spark.createDataFrame(rows, "item_id long, content_hash string, received_at timestamp_ntz, cik string")
    frame = spark.createDataFrame([(i, sorted(sets[i]), when[i]) for i in sets], "k long, t array<string>, received_at timestamp_ntz")
    asked, groups = [], similarity.groups
    monkeypatch.setattr(similarity, "groups", lambda edges, *names: asked.append(edges.count()) or groups(edges, *names))
    monkeypatch.setattr(similarity, "BLOCK_SETS", 7)
    for hours, most in ((48, 0), (5, 10_000)):
        close = {(a, b): round(s, 9) for a, b, s in every if when[a] and when[b] and abs(when[a] - when[b]) <= dt.timedelta(hours=hours)}
        assert 0 < len(close) < len(every) / 4
        want = one_by_one(rows, every, hours)
        assert any(lead != i and s < 1 for i, (lead, s) in want.items())
        got = similarity.leader_clusters(items, spark.createDataFrame(every, "a long, b long, similarity double"), hours).collect()
        assert {x["item_id"]: (x["leader_id"], round(x["similarity"], 9)) for x in got} == want and len(got) == len(rows)
        assert asked[-1] <= len(close)
        monkeypatch.setattr(similarity, "SPAN_SETS", most, raising=False)
        pairs = similarity.similar_sets(frame, "k", "t", 0.5, "received_at", hours).collect()
        assert {(x["a"], x["b"]): round(x["similarity"], 9) for x in pairs} == close and len(pairs) == len(close)


def test_leaders_of_equal_items(spark, monkeypatch):
    """Most repeats of a content never meet the walk; those of a refused cik lead themselves, or join by an edge."""
    import random

    r = random.Random(8)
    rows = [(i, f"h{min(r.randrange(30), r.randrange(30))}" if i % 50 else None, at(r.randrange(0, 300 * 60)) if i % 60 else None, r.choice([None, None, "A", "B", "C"])) for i in range(600)]
    when = {x[0]: x[2] for x in rows}
    edges = sorted({(min(a, b), max(a, b), r.choice([0.5, 0.7, 0.9])) for a, b in (r.sample(range(600), 2) for _ in range(900))})
    edges = [e for i, e in enumerate(edges) if i == 0 or e[:2] != edges[i - 1][:2]]
    items = spark.createDataFrame(rows, "item_id long, content_hash string, received_at timestamp_ntz, cik string")
    asked, walk = [], type(items).mapInPandas
    monkeypatch.setattr(type(items), "mapInPandas", lambda self, *a, **b: asked.append(self.count()) or walk(self, *a, **b))
    for some in (edges, edges[:40]):
        got = similarity.leader_clusters(items, spark.createDataFrame(some, "a long, b long, similarity double")).collect()
        want = one_by_one(rows, some, 48)
        assert {x["item_id"]: (x["leader_id"], round(x["similarity"], 9)) for x in got} == want and len(got) == len(rows)
        assert any(lead != i and s < 1 for i, (lead, s) in want.items()) or not [e for e in some if when[e[0]] and when[e[1]]]
    assert asked[-1] < 250


def test_leaders_of_pages_against_sql(spark, tmp_path, monkeypatch):
    """Near titles within and beyond 48 hours, pages without a title and pages without html."""
    import random

    import duckdb
    from parity import differences

    from tidemark.plans import registry

    r = random.Random(7)
    words = ["ocean", "river", "stone", "amber", "light", "north"]
    title = lambda i: f"<html><title>{' '.join(r.choices(words, k=4))}</title>" if i % 29 else "<p>none</p>"
    rows = [(i, "u", None if i % 31 == 0 else title(i)) for i in sorted(r.sample(range(3000), 250))]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    asked, leaders = [], similarity.leader_clusters
    monkeypatch.setattr(similarity, "leader_clusters", lambda items, edges, *hours: asked.append(edges.filter("b - a > 192").count()) or leaders(items, edges, *hours))
    got = registry.QUERIES["leader_clusters"](spark, str(tmp_path))
    assert differences(got, con, registry.ORACLES["leader_clusters"]) == "" and got.filter("similarity < 1").count() > 5
    assert asked == [0], "titles too far apart in time to share a story make no pair"


def test_exchange_candles(spark):
    row = lambda t: [t, "1", "2", "0.5", "1.5", "1.2", "7.5", 3]
    p = payload(spark, {"error": [], "result": {"PAIR": [row(60), row(120), row(180)], "last": 120}})
    assert [r["ts"].minute for r in feeds.exchange_ohlc(p, "p").collect()] == [1, 2]
    for bad in ({"error": ["no"], "result": {"PAIR": [row(60)], "last": 60}}, {"error": [], "result": {"A": [], "B": [], "last": 1}}, {"error": [], "result": {"A": [row(61)], "last": 90}}):
        with pytest.raises(Exception):
            if not feeds.exchange_ohlc(payload(spark, bad), "p").collect():
                raise ValueError("no rows")


ATOM = """<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom">{}</feed>"""
ENTRY = """<entry><title>{f} - Firm {n} (000000000{n}) (Filer)</title><link rel="alternate" href="https://x/000000000{n}-24-00000{n}-index.htm"/><summary type="html">&lt;b&gt;Filed&lt;/b&gt; Item 1.01: a Item 9.01: b</summary><updated>2024-03-0{n}T10:00:00-05:00</updated><category term="{f}"/><id>urn:accession-number=000000000{n}-24-00000{n}</id></entry>"""


def test_exchange_candles_of_a_long_response(spark):
    """A response is read once, not once for each of its candles."""
    rows = ", ".join(f'["{60 * t}", "1", "2", "0.5", "{t}", "1", "3", "4"]' for t in range(5))
    got = feeds.exchange_ohlc(spark.createDataFrame([(f'{{"error": [], "result": {{"XY": [{rows}], "last": 180}}}}',)], "p string"), "p")
    assert [int(x["close"]) for x in got.collect()] == [0, 1, 2, 3]
    above = got._jdf.queryExecution().optimizedPlan().toString().split("Generate explode")[0]
    assert "map_keys" not in above and "element_at" not in above


def test_filings_stop_at_the_cursor_and_keep_the_family(spark):
    p = payload(spark, ATOM.format("".join(ENTRY.format(n=n, f=f) for n, f in ((4, "8-K"), (3, "S-8"), (2, "8-K/A"), (1, "8-K")))))
    rows = feeds.filings(p, "p", cursor="0000000001-24-000001").orderBy("position").collect()
    assert [(r["external_id"], r["cik"], r["item_codes"]) for r in rows] == [("0000000004-24-000004", "0000000004", ["1.01", "9.01"]), ("0000000002-24-000002", "0000000002", ["1.01", "9.01"])]
    assert rows[0]["published_at"] == dt.datetime(2024, 3, 4, 15, 0) and rows[0]["body"].startswith("Filed Item")


def test_syndicated_and_news(spark):
    rss = '<rss version="2.0"><channel><item><title>A</title><link>l1</link><guid>g1</guid><pubDate>Fri, 10 Jul 2026 21:29:00 +0000</pubDate><description>&lt;p&gt;x&lt;/p&gt;</description></item><item><title>B</title><link>l2</link></item><item><link>l3</link></item></channel></rss>'
    assert sorted((r["external_id"], r["headline"]) for r in feeds.syndicated(payload(spark, rss), "p").collect()) == [("g1", "A"), ("l2", "B")]
    page = {"status": "OK", "results": [{"id": "1", "title": "t", "published_utc": "2024-01-01T00:10:00Z"}, {"id": "1", "title": "t", "published_utc": "2024-01-01T00:10:00Z"}, {"id": "0", "title": "u", "published_utc": "2024-01-01T00:01:00Z"}]}
    assert [r["external_id"] for r in feeds.news_pages(payload(spark, page), "p", "2024-01-01 00:14:00").collect()] == ["1"]
    assert one(spark, feeds.next_cursor(F.array(F.lit("b"), F.lit("a")), F.array(F.lit("a"), F.lit("c")))) == ["b", "a", "c"]


def test_archive_earnings_tickers_and_ranges(spark):
    docs = [{"_id": "1", "pub_date": "2024-01-02T03:04:05+0000", "section_name": "Sports", "headline": {"main": "x"}}, {"_id": "2", "pub_date": "2024-01-02T03:04:05+0000", "headline": {"main": " y "}, "word_count": "12", "keywords": [{"name": "n", "value": "v"}]}, {"_id": "3", "pub_date": "bad", "headline": {"main": "z"}}]
    rows = feeds.archive_month(payload(spark, {"response": {"docs": docs}}), "p", sections=["sports"]).collect()
    assert [(r["external_id"], r["headline"], r["word_count"], r["keywords"]) for r in rows] == [("2", "y", 12, ["v"])]
    e = feeds.earnings(payload(spark, {"earningsCalendar": [{"date": "2024-07-01", "symbol": "brk-b", "hour": "bmo"}]}), "p").first()
    assert e["symbol"] == "BRK.B" and e["scheduled_at"] == dt.datetime(2024, 7, 1, 12, 0)
    m = feeds.ticker_map(payload(spark, {"0": {"cik_str": 5, "ticker": "a", "title": "x"}, "1": {"cik_str": 6, "ticker": "A", "title": "y"}}), "p")
    assert [(r["symbol"], r["cik"]) for r in m.collect()] == [("A", "0000000005")]
    d = dt.date(2024, 1, 1)
    day = dt.timedelta(days=1)
    assert feeds.plan_ranges(d, d + 20 * day, lambda a, b: 100 * ((b - a).days + 1), 14, 800) == [(d, d + 6 * day), (d + 7 * day, d + 13 * day), (d + 14 * day, d + 20 * day)]
    with pytest.raises(ValueError, match="row cap"):
        feeds.plan_ranges(d, d, lambda a, b: 5, 14, 5)


def test_tables_of_pages(spark):
    html = "<h2>2026 Schedule</h2><table class='wikitable'><tr><th>Symbol</th><th>Security</th><th>GICS Sector</th><th>CIK</th></tr>" + "".join(f"<tr><td>A-{i}</td><td>Firm {i}</td><td>Tech</td><td>{i}</td></tr>" for i in range(3)) + "</table>"
    pages = spark.createDataFrame([(1, html)], "id long, html string")
    assert sorted(r["symbol"] for r in html_tables.constituents(pages, "html", "id", 1, 5).collect()) == ["A.0", "A.1", "A.2"]
    with pytest.raises(ValueError, match="expected"):
        html_tables.constituents(pages, "html", "id", 400, 600)
    dates_page = spark.createDataFrame([(1, "<h3>2026 meetings</h3><table><tr><td>January 27-28</td></tr><tr><td>Jul. 15, 2026</td></tr></table>")], "id long, html string")
    assert sorted(r["scheduled_at"] for r in html_tables.release_dates(dates_page, "html", "id", "fomc", 840).collect()) == [dt.datetime(2026, 1, 28, 19, 0), dt.datetime(2026, 7, 15, 18, 0)]


def test_documents_of_a_filing_stay_in_bounds(spark):
    rows = [(1, 1, "main.htm", "<p>" + "a" * 50 + "</p>"), (1, 2, "ex-index.htm", "x"), (1, 3, "ex1.htm", "b" * 50), (1, 4, "data.xml", "y")]
    d = spark.createDataFrame(rows, "filing_id long, position int, name string, html string")
    assert [(r["name"], len(r["text"])) for r in feeds.document_texts(d, 40, 60).orderBy("position").collect()] == [("main.htm", 40), ("ex1.htm", 20)]


def test_config_is_immutable(spark):
    none = spark.createDataFrame([], "version_label string, config_hash string, config string")
    row = sinks.config_row(none, "v1", {"b": 1, "a": {"d": 2, "c": 3}})
    assert row.first()["config"] == '{"a":{"c":3,"d":2},"b":1}'
    assert sinks.config_row(row, "v1", {"a": {"c": 3, "d": 2}, "b": 1}) is None
    with pytest.raises(ValueError, match="other values"):
        sinks.config_row(row, "v1", {"b": 2})


def test_raw_store_round_trip(spark, tmp_path):
    items = spark.createDataFrame([("src", "1", T0, '{"x": 1}'), ("src", "2", T0, '{"x": 1}')], "source string, external_id string, received_at timestamp_ntz, payload string")
    sinks.write_raw(items, str(tmp_path / "raw"))
    keys = [r["key"] for r in sinks.read_raw(spark, str(tmp_path / "raw")).collect()]
    assert len(set(keys)) == 2 and sinks.read_raw(spark, str(tmp_path / "raw"), keys[:1]).first()["payload"] == '{"x": 1}'
    with pytest.raises(ValueError, match="unsafe"):
        sinks.read_raw(spark, str(tmp_path / "raw"), ["../x"])


def test_ingestion_is_idempotent_and_streams_equal_batches(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    a = spark.createDataFrame([(1, "a", T0), (2, "b", T0), (1, "late", at(5))], "id long, v string, t timestamp_ntz")
    a.write.parquet(src)
    run = lambda cp: pipelines.ingest(spark.readStream.schema(a.schema).parquet(src), out, str(tmp_path / cp), ["id"], ["t"]).awaitTermination()
    run("c1")
    run("c2")  # the whole input once more
    assert sorted((r["id"], r["v"]) for r in spark.read.parquet(out).collect()) == [(1, "a"), (2, "b")]


def test_stream_windows_equal_batch(spark, tmp_path):
    rows = [(at(m), "k", 1.0) for m in (0, 10, 70, 500)]
    df = spark.createDataFrame(rows, "ts timestamp, k string, value double")
    df.write.parquet(str(tmp_path / "w"))
    stream = pipelines.windowed(spark.readStream.schema(df.schema).parquet(str(tmp_path / "w")), "ts", ["k"], "1 hour")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["n"] for r in spark.table("w").collect()) == [1, 1, 2]


def test_bad_messages_are_kept_aside(spark):
    raw = spark.createDataFrame([(1, '{"a": 1}'), (2, "nonsense")], "id long, m string")
    good, bad = pipelines.parsed_or_kept(raw, "m", "a int")
    assert [(r["id"], r["a"]) for r in good.collect()] == [(1, 1)] and [r["id"] for r in bad.collect()] == [2]


def test_queue_and_costs(spark):
    q = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    due = pipelines.due(q, spark.createDataFrame([(1,)], "id long"), spark.createDataFrame([(2, 3), (3, 2)], "id long, attempts long"), ["id"], 3)
    assert [r["id"] for r in due.collect()] == [3]
    prices = spark.createDataFrame([("m", 1.0, 2.0)], "model string, input_per_m double, output_per_m double")
    use = lambda m: spark.createDataFrame([(m, 1_000_000, 500_000)], "model string, input_tokens long, output_tokens long")
    assert pipelines.token_cost(use("m"), prices).first()["cost_usd"] == 2.0
    with pytest.raises(Exception, match="no price"):
        pipelines.token_cost(use("x"), prices).collect()


def test_cursor_source_in_batch_and_stream(spark, tmp_path):
    folder = tmp_path / "feed"
    folder.mkdir()
    line = lambda i, t: json.dumps({"external_id": str(i), "published_at": t}) + "\n"
    (folder / "a.jsonl").write_text(line(1, "2024-01-01") + line(2, "2024-01-02"))
    spark.dataSource.register(cursor.CursorFeed)
    assert [r["external_id"] for r in spark.read.format("cursor_feed").option("cursor", "2024-01-01").load(str(folder)).collect()] == ["2"]

    def poll():
        q = spark.readStream.format("cursor_feed").load(str(folder)).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).start(str(tmp_path / "o"))
        q.processAllAvailable()
        q.stop()
        return sorted(r["external_id"] for r in spark.read.parquet(str(tmp_path / "o")).collect())

    assert poll() == ["1", "2"]
    (folder / "b.jsonl").write_text(line(3, "2024-01-03"))
    assert poll() == ["1", "2", "3"]
    assert cursor.enabled({"a": (), "b": ("KEY",)}, {}) == ["a"]


def test_attachment_batch_by_batch_equals_all_at_once(spark):
    from tidemark.streaming import clusters

    rows = [(1, "fed holds rates steady", at(0)), (2, "fed holds rates steady today", at(30)), (3, "storm hits coast", at(40)), (4, "fed holds rates steady now", at(60)), (5, "storm hits the coast", at(70)), (6, "fed holds rates steady", at(60 * 100))]
    df = spark.createDataFrame([(i, t, str(hash(t)), ts, None) for i, t, ts in rows], "item_id long, title string, content_hash string, received_at timestamp_ntz, cik string")
    members = df.limit(0).withColumn("leader_id", F.lit(0).cast("long"))
    for ids in ([1, 2], [3, 4], [5], [6]):
        batch = df.filter(F.col("item_id").isin(ids))
        now = F.lit(max(ts for i, _, ts in rows if i in ids))
        got = clusters.attach(batch, members, now)
        members = members.unionByName(batch.join(got.select("item_id", "leader_id"), "item_id")).checkpoint()
        assert clusters.attach(batch, members, now).count() == 0
    assert {r["item_id"]: r["leader_id"] for r in members.collect()} == {1: 1, 2: 1, 3: 3, 4: 1, 5: 3, 6: 6}
    gone = clusters.closed(members.withColumn("source", F.lit("s")), F.lit(at(60 * 60)))
    assert {r["leader_id"]: r["n_items"] for r in gone.collect()} == {1: 3, 3: 2}


def test_broker_places_once_and_rejects_without_a_quote(spark):
    from tidemark.operators import broker

    intents = spark.createDataFrame([("a", 1, "buy", Decimal(2), "us_equity"), ("a", 1, "buy", Decimal(2), "us_equity"), ("b", 9, "buy", Decimal(1), "crypto"), ("c", 1, "sell", Decimal(1), "crypto")], "client_order_id string, instrument_id long, side string, qty decimal(20,8), asset_class string")
    got = {r["client_order_id"]: (r["status"], r["fill_price"], r["fee"]) for r in broker.place(intents, spark.createDataFrame([("c",)], "client_order_id string"), bars(spark, [(-5, 100)]), F.lit(at(0))).collect()}
    assert got == {"a": ("filled", Decimal("100.050000"), Decimal("0.000000")), "b": ("rejected", None, None)}


def test_cli_stages_run_known_queries(spark, capsys, tmp_path):
    from tidemark import cli
    from tidemark.plans import registry

    assert {q for v in cli.STAGES.values() for q in v} <= set(registry.QUERIES)
    assert cli.main(["stages"]) == 0 and "eval-latency: latency_by_horizon" in capsys.readouterr().out
    sf = "/root/testdata/sf0.001"
    assert cli.stage(spark, "documents", sf, 3) == 0 and "## document_queue" in capsys.readouterr().out
    assert cli.stage(spark, "documents", sf, 3, str(tmp_path / "d")) == 0 and spark.read.parquet(str(tmp_path / "d" / "document_queue")).count() > 3
    assert cli.stage(spark, "documents", sf, 3, str(tmp_path / "d.md")) == 0 and (tmp_path / "d.md").read_text().startswith("## document_queue")


def test_cli_lists_and_renders(spark, capsys):
    from tidemark import cli

    assert cli.main(["list"]) == 0 and "reaction_ladder" in capsys.readouterr().out
    assert cli.markdown(spark.createDataFrame([(1, "a|b")], "x int, y string")).endswith("| 1 | a\\|b |")


def test_everything_imports_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    code = "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parent.parent, check=True, timeout=120)


def test_families_of_forms_and_their_patterns(spark):
    entry = lambda i, form, title, summary: f'<entry><title>{title}</title><id>x,2008:accession-number=000000000{i}-24-000001</id><updated>2024-01-05T10:00:00Z</updated><summary>{summary}</summary>{f"""<category term="{form}"/>""" if form else ""}</entry>'
    p = payload(spark, "<feed>" + entry(1, "8-K12B", "8-K12B - A (12345) (Filer)", "Item   5.2 and Item 12.34, Item 123.4") + entry(2, "SC 13D/A", "SC 13D - B (1234) x", "") + entry(3, "SC 13G", "c", "") + entry(4, None, "d", "") + "</feed>")
    got = {form: sorted(x["external_id"][9] for x in feeds.filings(p, "p", form).collect()) for form in feeds.FORMS}
    assert got == {"8-K": ["1", "4"], "10-Q": ["4"], "4": ["4"], "SC 13D": ["2", "4"], "SC 13G": ["3", "4"]}
    first = feeds.filings(p, "p").orderBy("external_id").first()
    assert first["cik"] == "12345" and first["item_codes"] == ["5.2", "12.34"]
    assert [x["cik"] for x in feeds.filings(p, "p", "SC 13D").orderBy("external_id").collect()] == [None, None]
    with pytest.raises(ValueError):
        feeds.filings(p, "p", "S-1")


def test_walks_of_pages_end(spark):
    pages = {"a": ([1, 2], "b"), "b": ([2, 3], "c"), "c": ([3], "a")}
    assert feeds.walk(lambda u: u, "a", pages.get) == ["a", "b", "c"]
    assert feeds.walk(lambda u: u, "a", pages.get, most=2) == ["a", "b"]
    with pytest.raises(ValueError):
        feeds.walk(lambda u: u, "a", pages.get, most=2, strict=True)


def test_cursors_move_forward_only(spark):
    page = {"status": "OK", "results": [{"id": "1", "title": "t", "published_utc": "2024-01-02T00:00:00Z"}]}
    assert str(feeds.news_cursor(payload(spark, page), "p", "2024-01-03 00:00:00").first()[0]).startswith("2024-01-03")
    assert str(feeds.news_cursor(payload(spark, page), "p").first()[0]).startswith("2024-01-02")
    now = dt.datetime(2024, 1, 15)
    assert feeds.last_complete_month(now) == "2023-12" and feeds.last_complete_month(dt.datetime(2024, 3, 1)) == "2024-02"
    assert feeds.archive_next(None, "2023-11", now) == "2023-11" and feeds.archive_next("2023-11", "2023-01", now) == "2023-12"
    assert feeds.archive_next("2023-12", "2023-01", now) is None
    with pytest.raises(ValueError):
        feeds.archive_next("2023-13", "2023-01", now)


def test_aggregates_need_a_good_status(spark):
    bars = {"ticker": "A", "status": "ERROR", "results": [{"o": 1, "h": 1, "l": 1, "c": 1, "v": 1, "t": 0}]}
    with pytest.raises(Exception, match="good status"):
        feeds.aggregates(payload(spark, bars), "p").collect()
    assert feeds.aggregates(payload(spark, bars | {"status": "DELAYED"}), "p").count() == 1


def test_a_symbol_keeps_its_number(spark):
    from tidemark.operators import entity

    df = lambda *rows: spark.createDataFrame(list(rows), "symbol string, cik string")
    assert {tuple(x) for x in entity.identified(df(("A", "1"), ("B", "2")), df(("A", "9")), df(("A", "9"), ("B", None))).collect()} == {("A", "9"), ("B", "2")}
    with pytest.raises(Exception, match="another number for the symbol A"):
        entity.identified(df(("A", "1")), df(("A", "9")), df(("A", "1"))).collect()


def test_one_writer_at_a_time(spark, tmp_path):
    import threading

    from tidemark.operators import sinks

    path = str(tmp_path / "t")
    rows = spark.range(40).withColumnRenamed("id", "k")
    threads = [threading.Thread(target=lambda: sinks.append_absent(rows, path, ["k"])) for _ in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert spark.read.parquet(path).count() == 40 and not (tmp_path / "t.lock").exists()
    with sinks.single_writer(spark, path):
        with pytest.raises(TimeoutError):
            with sinks.single_writer(spark, path, wait_seconds=0.3):
                pass


def test_ticks_store_crypto_before_equity_fails():
    from tidemark.streaming import pipelines

    stored = []
    with pytest.raises(ValueError):
        pipelines.record_tick(lambda: stored.append("crypto"), lambda: int("no"))
    assert stored == ["crypto"]


def test_settling_looks_back_nine_days(spark):
    from tidemark.streaming import pipelines

    a = spark.createDataFrame([(i, at(-i * 60)) for i in (0, 216, 217)], "cluster_id long, anchor_ts timestamp_ntz")
    assert sorted(x["cluster_id"] for x in pipelines.settling(a, F.lit(at(0)).cast("timestamp_ntz")).collect()) == [0, 216]


def test_measurements_under_two_clocks_are_filled_in_later(spark):
    """A second run adds what had not settled, and leaves the rest."""
    from tidemark.operators import sinks

    a = spark.createDataFrame([(1, 1, T0, at(-5))], "cluster_id long, instrument_id long, anchor_ts timestamp_ntz, published_ts timestamp_ntz")
    every = bars(spark, [(-10, 100), (4, 101), (14, 102), (29, 103), (59, 104), (1439, 90), (1441, 80)])
    none = spark.createDataFrame([], "instrument_id long, beta double")
    daily = spark.createDataFrame([], "instrument_id long, ts timestamp_ntz, close double")
    early = study.measure(a, every.filter(F.col("ts") < F.lit(at(40)).cast("timestamp_ntz")), daily, none, 0)[0]
    late = study.measure(a, every, daily, none, 0)
    keys = ["measurer_version", "cluster_id", "instrument_id", "horizon"]
    added = sinks.absent(late[0], early, keys)
    assert {x["horizon"] for x in early.collect()} < {x["horizon"] for x in late[0].collect()}
    assert added.count() + early.count() == late[0].count() and {x["measurer_version"] for x in late[1].collect()} == {"m1", "m1-pub"}


def test_stories_of_one_instant_are_measured_once(spark, monkeypatch):
    """Copies of a story get its measures, and no bar meets more than one of them."""
    schema = "cluster_id long, instrument_id long, anchor_ts timestamp_ntz, published_ts timestamp_ntz"
    one = [(1, 1, T0, at(-5)), (2, 1, at(3), None)]
    many = [(c + 10 * k, i, x, y) for c, i, x, y in one for k in range(30)]
    every = bars(spark, [(-10, 100), (4, 101), (14, 102), (29, 103), (59, 104), (1439, 90), (1441, 80), (1500, 79), (2000, 95)])
    none = spark.createDataFrame([], "instrument_id long, beta double")
    daily = spark.createDataFrame([], "instrument_id long, ts timestamp_ntz, close double")
    met, series = [], study.series
    monkeypatch.setattr(study, "series", lambda anchors, *a, **b: met.append(anchors.count()) or series(anchors, *a, **b))
    alone, copied = (study.measure(spark.createDataFrame(x, schema), every, daily, none, 0) for x in (one, many))
    assert met[:4] == met[4:] and max(met) == 2
    for a, b in zip(alone, copied):
        assert a.columns == b.columns
        want = sorted(str({**r.asDict(), "cluster_id": r["cluster_id"] + 10 * k}) for r in a.collect() for k in range(30))
        assert sorted(str(r.asDict()) for r in b.collect()) == want and (want or a is alone[2])


def test_measures_shuffle_anchors_and_no_points(spark):
    """Measures equal those of rows of points, though no point becomes a row; stories of one instant, of none and without bars among them."""
    import random

    rnd = random.Random(5)
    minute = lambda days, whole=True: at(rnd.randrange(days * 1440) + (0 if whole else rnd.random()))
    price = lambda: rnd.choice([99.0, 100.0, 101.0, 103.5, 120.0])  # noqa: E731  (few, so that extremes have equals)
    kept = [(i, t, price()) for i, n in ((0, 700), (1, 900), (2, 40), (3, 500), (4, 1)) for t in sorted({minute(24, rnd.random() < 0.9) for _ in range(n)})]
    every = spark.createDataFrame(kept, "instrument_id long, ts timestamp_ntz, close double")
    daily = spark.createDataFrame([(i, dt.datetime(2024, 3, 1) + dt.timedelta(days=d), price()) for i in range(4) for d in range(60) if rnd.random() < 0.8], "instrument_id long, ts timestamp_ntz, close double")
    betas = spark.createDataFrame([(1, 0.7), (2, 1.3), (3, None)], "instrument_id long, beta double")
    told = [(c, rnd.randrange(6), minute(30, rnd.random() < 0.3), minute(30) if rnd.random() < 0.7 else None) for c in range(200)]
    told += [(200 + c, *told[c][1:]) for c in range(40)] + [(300 + k, i, t, t) for k, (i, t, _) in enumerate(kept[::40])]
    a = spark.createDataFrame(told, "cluster_id long, instrument_id long, anchor_ts timestamp_ntz, published_ts timestamp_ntz")
    got = study.measure(a, every, daily, betas, 0)
    keys, n = ["cluster_id", "instrument_id"], [0, 0, 0]
    for version, clock in C.CLOCKS.items():
        rows = study.abnormal(study.ladder(a, every, clock), every, betas, 0, clock).select(*keys, "horizon", F.col(clock).alias("clock"), "raw_bps", "abnormal_bps", "beta_used").localCheckpoint()
        day, fell = rows.filter("horizon = '1d'").select(*keys), study.falls(rows)
        summaries = study.summary(study.series(a.join(day, keys, "left_semi"), every, 1, clock, True, betas, 0))
        recoveries = study.recovery(study.series(a.join(fell, keys, "left_semi"), every, C.RECOVERY_DAYS, clock, False, betas, 0, daily)).filter("conclusive")
        for k, (mine, want) in enumerate(zip(got, (rows, summaries, recoveries))):
            mine = mine.filter(F.col("measurer_version") == version).drop("measurer_version")
            assert mine.dtypes == want.dtypes
            x, y = (sorted((tuple(r) for r in z.collect()), key=lambda r: (r[0], str(r[2]) if k == 0 else "")) for z in (mine, want))
            assert x == y
            n[k] += len(x)
    assert min(n) > 100
    for x in got:
        plan = x._jdf.queryExecution().executedPlan().toString()
        assert "CoGroup" in plan and "Window" not in plan


def test_prices_that_are_none_stop_a_measurement(spark):
    a = spark.createDataFrame([(1, 1, T0, None)], "cluster_id long, instrument_id long, anchor_ts timestamp_ntz, published_ts timestamp_ntz")
    daily, none = spark.createDataFrame([], "instrument_id long, ts timestamp_ntz, close double"), spark.createDataFrame([], "instrument_id long, beta double")
    with pytest.raises(Exception, match="a price must be positive"):
        study.measure(a, bars(spark, [(-10, 0), (4, 101)]), daily, none, 0)[0].collect()


def test_calendars_flag_what_they_backfill(spark):
    from tidemark.operators import intervals

    now = F.lit(at(0)).cast("timestamp_ntz")
    rows = [("a", "cpi", None, at(-60)), ("a", "cpi", None, at(-50)), ("b", "cpi", None, at(-3000)), ("c", "earnings", "BRK-B", at(60)), ("d", "earnings", "ZZ", at(60)), ("e", "cpi", None, at(200_000))]
    f = spark.createDataFrame(rows, "event_key string, kind string, symbol string, scheduled_at timestamp_ntz")
    symbols = spark.createDataFrame([("BRK.B", 7)], "symbol string, instrument_id long")
    got, counts = intervals.calendar(f, symbols, now)
    assert {(x["event_key"], x["instrument_id"], x["backfilled"]) for x in got.collect()} == {("a", None, False), ("c", 7, False)}
    assert counts.first().asDict() == {"outside": 2, "duplicates": 1, "not_members": 1}
    got, counts = intervals.calendar(f, symbols, now, backfill_from=F.lit(at(-4000)).cast("timestamp_ntz"))
    assert {x["event_key"]: x["backfilled"] for x in got.collect()} == {"a": False, "b": True, "c": False}
