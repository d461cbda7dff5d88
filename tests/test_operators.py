"""Hand-made rows for what the tables cannot exercise, and brute-force checks."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from crowdtide.functions.timeparts import parse_local, targets_for_days
from crowdtide.operators import bands, clean, crowd, quantiles, schedule
from crowdtide.sources.schedule import extract_schedule

T0 = dt.datetime(2024, 1, 1)
at = lambda minutes: T0 + dt.timedelta(minutes=minutes)
SERIES = "location_id BIGINT, observed_at TIMESTAMP_NTZ, count DOUBLE, max_cap INT"


def test_jumps_by_hand(spark):
    rows = [(1, at(m), float(v), 100) for m, v in ((0, 10), (10, 90), (20, 85), (30, 12), (200, 95))]
    kept = clean.drop_impossible_jumps(spark.createDataFrame(rows, SERIES)).orderBy("observed_at").collect()
    assert [r["count"] for r in kept] == [10.0, 12.0, 95.0]


def brute_jumps(rows):
    out = []
    for r in rows:
        if out and (r[1] - out[-1][1]).total_seconds() <= 7200 and abs(r[2] - out[-1][2]) > r[3] * 0.6:
            continue
        out.append(r)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_jumps_over_chunk_borders(spark, seed):
    rng, rows, minute = random.Random(seed), [], 0
    for _ in range(900):
        minute += rng.choice((5, 10, 20, 40, 130))
        rows.append((1, at(minute), float(rng.choice((5, 10, 50, 90, 95))), 100))
    got = clean.drop_impossible_jumps(spark.createDataFrame(rows, SERIES)).orderBy("observed_at").collect()
    assert [tuple(r) for r in got] == brute_jumps(rows)


def test_two_chains_that_never_meet(spark):
    rows = [(1, at(10 * i), 10.0 if i % 2 else 90.0, 100) for i in range(600)]
    got = clean.drop_impossible_jumps(spark.createDataFrame(rows, SERIES)).orderBy("observed_at").collect()
    assert [tuple(r) for r in got] == brute_jumps(rows)


def test_jumps_in_dense_chunks(spark):
    """More rows in a chunk than one array holds, values of several levels, and gaps longer than the look-back."""
    rng, rows, second = random.Random(5), [], 0
    for k in range(6000):
        second += rng.choice((3, 10, 40)) if k % 900 else 9000
        rows.append((k % 2, T0 + dt.timedelta(seconds=second), float(rng.choice((0, 30, 70, 140, 141, 260))), 100))
    got = clean.drop_impossible_jumps(spark.createDataFrame(rows, SERIES)).orderBy("observed_at").collect()
    want = sorted((r for k in (0, 1) for r in brute_jumps([r for r in rows if r[0] == k])), key=lambda r: r[1])
    assert [tuple(r) for r in got] == want


def test_filters_use_no_python(spark):
    series = spark.createDataFrame([(1, at(0), 1.0, 100)], SERIES)
    for kept in (clean.drop_impossible_jumps(series), clean.thin_flatlines(series)):
        plan = kept._jdf.queryExecution().toString()
        assert "Pandas" not in plan and "Arrow" not in plan and "Python" not in plan


@pytest.mark.parametrize("steps", [(15,), (1, 2, 19), (20,), (7, 13, 20)])
def test_flatlines_of_any_density(spark, steps):
    rng, rows, minute = random.Random(len(steps)), [], 355
    for _ in range(900):
        minute += rng.choice(steps)
        rows.append((1, at(minute), 40.0, 100))
    want, last = [], None
    for r in rows:
        if last is None or (r[1] - last).total_seconds() >= 3600:
            want.append(r)
            last = r[1]
    got = clean.thin_flatlines(spark.createDataFrame(rows, SERIES)).orderBy("observed_at").collect()
    assert [tuple(r) for r in got] == want


def test_flatlines_are_thinned(spark):
    stuck = [(1, at(15 * i), 40.0, 100) for i in range(200)]
    empty = [(2, at(15 * i), 1.0, 100) for i in range(40)]
    got = clean.thin_flatlines(spark.createDataFrame(stuck + empty, SERIES))
    counts = {r[0]: r[1] for r in got.groupBy("location_id").count().collect()}
    assert counts == {1: 50, 2: 40}


def test_weighted_quantile_by_hand(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 3.0), (4.0, 1.0)], "x DOUBLE, w DOUBLE")
    got = quantiles.weighted_quantiles(df, [], "x", "w", {"q": 0.3}).first()["q"]
    assert abs(got - 7 / 6) < 1e-9


def brute_weighted(pairs, q):
    pairs = sorted(pairs)
    cut, total = q * sum(w for _, w in pairs), 0.0
    for i, (v, w) in enumerate(pairs):
        if total + w >= cut:
            return v if i == 0 else pairs[i - 1][0] + (v - pairs[i - 1][0]) * (cut - total) / w
        total += w
    return pairs[-1][0]


def test_quantiles_against_brute_force(spark):
    rng = random.Random(3)
    pairs = [(round(rng.choice((0.0, rng.gauss(0, 1), -0.4, rng.expovariate(0.01))), 3), rng.choice((1.0, 2.0, 0.5))) for _ in range(3000)]
    df = spark.createDataFrame([(i % 2, x, w) for i, (x, w) in enumerate(pairs)], "k INT, x DOUBLE, w DOUBLE")
    qs = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.998, "e": 1.0}
    plain = {r["k"]: r for r in quantiles.quantiles(df, ["k"], "x", qs).collect()}
    weighted = {r["k"]: r for r in quantiles.weighted_quantiles(df, ["k"], "x", "w", qs).collect()}
    for k in (0, 1):
        mine = sorted(pairs[i] for i in range(k, len(pairs), 2))
        for name, q in qs.items():
            rank = (len(mine) - 1) * q
            low, high = mine[math.floor(rank)][0], mine[math.ceil(rank)][0]
            assert abs(plain[k][name] - (low + (high - low) * (rank - math.floor(rank)))) < 1e-9
            assert abs(weighted[k][name] - brute_weighted(mine, q)) < 1e-6


@pytest.mark.parametrize("bin_rows", [3, 40])
def test_quantiles_of_values_that_hardly_differ(spark, bin_rows):
    """All values within 0.1 % of each other in one group without a key, ordered a few rows at a time."""
    rng = random.Random(8)
    pairs = [(1000.0 + rng.choice((0.0, rng.random(), 0.5)), rng.choice((1.0, 2.0, 0.5))) for _ in range(2000)]
    pairs += [(0.0, 1.0), (-1e-9, 2.0), (1e-300, 1.0), (5e-5, 1.0), (-7.0, 0.25)]
    df = spark.createDataFrame(pairs, "x DOUBLE, w DOUBLE")
    qs = {"a": 0.0, "b": 0.001, "c": 0.37, "d": 0.5, "e": 0.9995, "f": 1.0}
    plain = quantiles.quantiles(df, [], "x", qs, bin_rows).first()
    weighted = quantiles.weighted_quantiles(df, [], "x", "w", qs, bin_rows).first()
    mine = sorted(pairs)
    assert (plain["n"], weighted["n"]) == (len(mine), len(mine))
    for name, q in qs.items():
        rank = (len(mine) - 1) * q
        low, high = mine[math.floor(rank)][0], mine[math.ceil(rank)][0]
        assert abs(plain[name] - (low + (high - low) * (rank - math.floor(rank)))) < 1e-9
        assert abs(weighted[name] - brute_weighted(mine, q)) < 1e-6


def test_no_bin_is_left_above_the_bound(spark):
    df = spark.range(20_000).select((F.lit(5.0) + F.col("id") * 1e-7).alias("x"), (F.col("id") % 3).alias("k"))
    asked = []
    whole = quantiles._too_large
    try:
        quantiles._too_large = lambda chosen, limit: asked.append(chosen.agg(F.max("_bin_n")).first()[0]) or whole(chosen, limit)
        got = {r["k"]: r["m"] for r in quantiles.quantiles(df, ["k"], "x", {"m": 0.5}, 50).collect()}
    finally:
        quantiles._too_large = whole
    assert asked[0] > 3000 and asked[-1] <= 50
    assert all(abs(got[k] - (5.0 + (9999 + (k - 1)) * 1e-7)) < 1e-6 for k in got)


def test_thresholds_stay_apart(spark):
    base = spark.createDataFrame([("a", 99.6, 99.8, 100)], "g STRING, low_ceiling DOUBLE, peak_floor DOUBLE, capacity INT")
    row = crowd.occupancy_thresholds(base).first()
    assert (row.low_max, row.peak_min) == (99, 100)


def band_rows(spark, labels, step=30):
    rows = [("k", at(i * step), at((i + 1) * step), x) for i, x in enumerate(labels)]
    return spark.createDataFrame(rows, "k STRING, start TIMESTAMP_NTZ, end TIMESTAMP_NTZ, level STRING")


def brute_stable(labels, step=30):
    runs = [[x, 1] for x in labels]

    def join(rs):
        out = []
        for x, n in rs:
            if out and out[-1][0] == x:
                out[-1][1] += n
            else:
                out.append([x, n])
        return out

    runs = join(runs)
    while True:
        new = [[runs[i - 1][0], n] if 0 < i < len(runs) - 1 and runs[i - 1][0] == runs[i + 1][0] and n * step <= 90 else [x, n] for i, (x, n) in enumerate(runs)]
        if new == runs:
            return [(x, n) for x, n in runs]
        runs = join(new)


@pytest.mark.parametrize("labels", ["LLMPMLL", "LLMMMLL", "LLMMMML", "LMLPLMPPPPLM", "MLMLMLMLPPPPML", "L", "LM", "LMPLMPLMPMLPLMLPMLLLLPMPMPLMLMPMLPMLPLMLMPPMLLMP"])
def test_bands_bridge_until_stable(spark, labels):
    got = bands.bridge_bands_until_stable(band_rows(spark, labels), ["k"]).orderBy("start").collect()
    assert [(r.level, int((r.end - r.start).total_seconds() / 1800)) for r in got] == brute_stable(labels)


def test_single_bridging(spark):
    rows = [("k", at(30 * i), x, 30) for i, x in enumerate("LLMMMLL")] + [("j", at(30 * i), x, 30) for i, x in enumerate("LLMMMMML")]
    df = spark.createDataFrame(rows, "k STRING, target_ts TIMESTAMP_NTZ, level STRING, step_min INT")
    out = bands.bridge_once(bands.label_runs(df, ["k"]), ["k"]).orderBy("k", "run").collect()
    assert [r.level for r in out] == ["L", "M", "L", "L", "L", "L"]


def test_smoothing(spark):
    rows = [("a", i, v) for i, v in enumerate((100, 100, 40, 100, 100))] + [("b", i, v) for i, v in enumerate((100, 100, 80, 100, 100))]
    df = spark.createDataFrame(rows, "k STRING, hour INT, count BIGINT")
    got = bands.smooth_isolated(df, ["k"]).orderBy("k", "hour").collect()
    assert [r.smoothed for r in got] == [100] * 5 + [100, 100, 80, 100, 100]


def test_parse_local(spark):
    texts = ["2024-01-01T05:00:00Z", "2024-01-01 05:00:00.250", "", "bad", "2024-07-01T05:00:00+02:00", "2024-01-03"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, t STRING")
    got = [r.ts for r in df.select("i", parse_local(F.col("t")).alias("ts")).orderBy("i").collect()]
    assert got == [dt.datetime(2023, 12, 31, 23), dt.datetime(2024, 1, 1, 5, 0, 0, 250000), None, None, dt.datetime(2024, 6, 30, 22), dt.datetime(2024, 1, 3)]


def test_clock_changes(spark):
    days = spark.createDataFrame([(dt.date(2024, 3, 10),), (dt.date(2024, 11, 3),), (dt.date(2024, 6, 1),)], "day DATE")
    count = lambda **k: {r.day.month: r["count"] for r in targets_for_days(days, start_hour=0, end_hour=5, **k).groupBy("day").count().collect()}
    assert count() == {3: 24, 11: 24, 6: 24}
    assert count(elapsed=True) == {3: 20, 11: 28, 6: 24}


def rules(spark, rows):
    return spark.createDataFrame(rows, "facility_id BIGINT, section_idx INT, section_title STRING, row_idx INT, label STRING, hours STRING")


def test_overnight_windows_differ(spark):
    table = rules(spark, [(1, 0, "Hours", 0, "Friday", "8pm - 2am")])
    moments = spark.createDataFrame([(1, dt.datetime(2026, 1, 10, 1)), (1, dt.datetime(2026, 1, 9, 1)), (1, dt.datetime(2026, 1, 9, 21)), (1, dt.datetime(2026, 1, 8, 12))], "facility_id BIGINT, ts TIMESTAMP_NTZ")
    wide = {r.ts: r.schedule_state for r in schedule.schedule_resolve(moments, table, "ts").collect()}
    strict = {r.ts: r.state for r in schedule.schedule_status(moments, table, "ts").collect()}
    saturday, friday, evening, thursday = (r.ts for r in moments.collect())
    assert (wide[saturday], strict[saturday]) == ("unknown", "open")
    assert (wide[friday], strict[friday]) == ("open", "open")
    assert (wide[evening], strict[evening], wide[thursday], strict[thursday]) == ("open", "open", "unknown", "unknown")
    days = spark.createDataFrame([(1, dt.date(2026, 1, 9)), (1, dt.date(2026, 1, 10))], "facility_id BIGINT, day DATE")
    got = sorted((r.day.day, r.start_min, r.end_min) for r in schedule.open_windows(table, days).collect())
    assert got == [(9, 1200, 1440), (10, 0, 120)]


def test_pages(spark):
    table = "<table><tr><th>Day</th><th>Hours</th></tr><tr><td>Mon&ndash;Fri</td><td>6am - 11pm</td></tr><tr><td>x</td></tr></table>"
    pages = [
        (1, "u", f"<h2>Visit</h2><h3>Building <b>Hours</b></h3><p/>{table}{table}"), (2, "u", "<table><tr><td>Day</td><td>Hours</td></tr></table>"),
        (3, "u", "<p>Check back later for summer hours. No scheduled maintenance closures at this time.</p>"), (4, "u", "<p>Just a moment...</p>"),
    ]
    got = {r.page_id: r for r in extract_schedule(spark.createDataFrame(pages, "page_id INT, url STRING, html STRING")).collect()}
    assert [(s.title, [(x.label, x.hours) for x in s.rows], s.note) for s in got[1].sections] == [("Building Hours", [("Mon–Fri", "6am - 11pm")], None)]
    assert (got[2].status, got[4].error) == ("error", "bot challenge")
    assert [(s.title, s.note) for s in got[3].sections] == [("Seasonal Notice", "Check back later for summer hours."), ("Maintenance Closures", "No scheduled maintenance closures at this time.")]
