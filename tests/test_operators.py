import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions import ranking
from tidemark.functions.aggregates import n_unique, quantiles
from tidemark.functions.ranking import common_prefix, global_rank, text_number
from tidemark.functions.scalars import any_true, clip, fold, null_tokens
from tidemark.functions.timeparts import beijing_date, iso_weekday, midnight, midnight_epoch
from tidemark.operators import base, behavior, calibrate, encode, metrics, models, pastctr, quality
from tidemark.plans import queries as plans
from tidemark.sources import fixtures, tables

SMALL = "/root/testdata/sf0.001"


# ---- functions


def test_fold_is_the_wrapped_product(spark):
    ids = [0, 1, 7, 2**31, 2**32 - 1, 2**32, 2**40 + 12345, 2**62, 2**63 - 1]
    got = {r.x: r.f for r in spark.createDataFrame([(i,) for i in ids], "x long").select("x", fold(F.col("x"), 5).alias("f")).collect()}
    assert got == {i: (i * 11400714819323198485 % 2**64) % 5 for i in ids}


def test_dates(spark):
    row = spark.sql("SELECT 1492790400L AS e, DATE'2017-05-12' AS f, -2145916800L AS old").select(beijing_date(F.col("e")).alias("d"), midnight_epoch(F.lit(date(2017, 4, 22))).alias("m"), iso_weekday(F.col("f")).alias("w"), beijing_date(F.col("old")).alias("o")).first()
    assert (row.d, row.m, row.w) == (date(2017, 4, 22), 1492790400, 5) and midnight(date(2017, 4, 22)) == 1492790400
    assert row.o == date(1902, 1, 1)


def test_scalars(spark):
    df = spark.sql("SELECT * FROM VALUES ('NULL', 2.0D), ('null', -1.0D), ('', NULL), ('x', 0.5D) AS t(s, p)")
    got = df.select(null_tokens(F.col("s")).alias("s"), clip(F.col("p"), 0, 1).alias("p"), any_true(F.col("p") > 1, F.col("p") < 0).alias("a")).collect()
    assert [tuple(r) for r in got] == [(None, 1.0, True), (None, 0.0, True), (None, None, False), ("x", 0.5, False)]
    assert df.agg(n_unique(F.col("p"))).first()[0] == 4


def test_quantiles(spark):
    rng = random.Random(1)
    data = [(g, rng.choice([1.0, 2.0, 3.5, 7.0, None])) for g in "ab" for _ in range(57)] + [("c", float(x)) for x in range(10)]
    got = {r.g: (r.q_10, r.q_50, r.q_99, r.median) for r in quantiles(spark.createDataFrame(data, "g string, x double"), "x", [0.1, 0.5, 0.99], ["g"], median=True).collect()}
    for g in "abc":
        v = sorted(x for h, x in data if h == g and x is not None)
        assert got[g] == (*[v[int(q * (len(v) - 1) + 0.5)] for q in (0.1, 0.5, 0.99)], (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2)
    assert quantiles(spark.createDataFrame(data, "g string, x double").limit(0), "x", [0.5], median=True).first().median is None


def test_global_ranks(spark, monkeypatch):
    monkeypatch.setattr(ranking, "PARTS", 16)
    rng = random.Random(2)
    words = sorted({"Brand#" + "".join(rng.choice("aäbzZ0 ") for _ in range(rng.randint(0, 4))) for _ in range(300)}, key=lambda s: s.encode())
    df = spark.createDataFrame([(w,) for w in words], "w string").repartition(7)
    assert common_prefix(words[0], words[-1]) == 6
    for skip in (0, 6):
        got = sorted((r["rank"], r.w) for r in global_rank(df, text_number(F.col("w"), skip), [F.col("w")]).collect())
        assert got == list(enumerate(words))
    nums = rng.sample(range(-1000, 100000), 500) + [-(2**60), 2**62, 2**62 + 1, 0, -1, 8, 7, 2**53]
    df = spark.createDataFrame([(n,) for n in set(nums)], "n long")
    got = sorted((r["rank"], r.n) for r in global_rank(df, F.col("n"), [F.col("n")]).collect())
    assert got == list(enumerate(sorted(set(nums))))
    assert tables.with_row_index(df, ["n"]).agg(F.max("impression_id")).first()[0] == len(set(nums)) - 1


def test_equal_values_are_cut_by_key(spark):
    """A constant column and values that crowd: ranks are right, and no bucket is large."""
    rng = random.Random(4)
    rows = [(i, 0.05) for i in range(3000)] + [(3000 + i, 0.05 + 1e-9 * rng.random()) for i in range(3000)] + [(6000 + i, rng.random()) for i in range(500)] + [(7000, float("nan"))]
    df = spark.createDataFrame(rows, "k long, p double").repartition(5)
    tagged = ranking.bucketed(df, F.col("p"), F.col("k"))
    assert tagged.groupBy("__bucket").count().agg(F.max("count")).first()[0] < 200
    got = sorted((r["rank"], r.k) for r in global_rank(df, F.col("p"), [F.col("p"), F.col("k")], key=F.col("k")).collect())
    assert [k for _, k in got] == [k for k, _ in sorted(rows, key=lambda r: (r[1] != r[1], r[1], r[0]))] and [n for n, _ in got] == list(range(len(rows)))


# ---- sources


def test_csv(spark, tmp_path):
    p = tmp_path / "user_profile.csv"
    p.write_text("userid,cms_segid,cms_group_id,final_gender_code,age_level,pvalue_level,shopping_level,occupation,new_user_class_level \n1,2,3,1,4,NULL,3,0,2\n2,2,3,1,4,,3,0,null\n")
    rows = tables.read_raw(spark, "user_profile", str(p)).orderBy("userid").collect()
    assert [(r.userid, r.pvalue_level, r.new_user_class_level) for r in rows] == [(1, None, 2.0), (2, None, None)]
    with pytest.raises(FileNotFoundError):
        tables.read_raw(spark, "user_profile", str(tmp_path / "none.csv"))


def test_tables(spark, tmp_path):
    df = spark.range(20).select("id", (F.col("id") % 3).cast("string").alias("split"))
    path = str(tmp_path / "t")
    tables.write_parquet(df, path, ["split"])
    assert tables.row_count(spark, path) == 20
    assert tables.read_parquet(spark, f"{path}/split=1", columns=["id"]).count() == 7
    assert tables.read_parquet(spark, f"{path}/split=*").count() == 20
    with pytest.raises(ValueError, match="missing"):
        tables.read_parquet(spark, path, columns=["nope"])
    with pytest.raises(ValueError, match="differ"):
        tables.require_same_schema({"a": df, "b": df.drop("id")})
    tables.write_report(df, str(tmp_path / "r"))
    assert spark.read.option("header", True).csv(str(tmp_path / "r")).count() == 20
    tables.write_manifest(spark, str(tmp_path / "m"), {"a": [1, 2], "b": "é"})
    assert tables.read_manifest(spark, str(tmp_path / "m"), ["a"]) == {"a": [1, 2], "b": "é"}
    with pytest.raises(ValueError, match="missing keys"):
        tables.read_manifest(spark, str(tmp_path / "m"), ["z"])
    one = [r.id for r in tables.shuffled(df, "id", 3).collect()]
    assert one == [r.id for r in tables.shuffled(df.repartition(5), "id", 3).collect()] != sorted(one)
    assert tables.shuffled(df, "id", 3, 4).count() == 4


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_reach_the_scan(spark, tmp_path):
    fixtures.behavior_log(spark, SMALL).write.parquet(str(tmp_path / "log"))
    daily = behavior.daily_behavior(spark.read.parquet(str(tmp_path / "log")), *fixtures.BEHAVIOR)
    plan = plan_of(daily)
    assert f"GreaterThanOrEqual(time_stamp,{midnight(fixtures.BEHAVIOR[0])})" in plan and "ReadSchema: struct<user:bigint,time_stamp:bigint,btag:string>" in plan
    assert plan.count("Exchange hashpartitioning") == 1 and "partial_count" in plan


def test_all_frames_share_one_sort(spark):
    daily = plans.daily(spark, SMALL)
    keys = daily.select("user_raw", "event_date_bj")
    plan = plan_of(behavior.behavior_windows(daily, keys))
    assert plan.count("- Window [") + plan.count("Window [") <= 2 and "Python" not in plan and "Cartesian" not in plan


# ---- point in time


def daily_rows(spark, seed=1, users=20):
    rng, start = random.Random(seed), date(2024, 1, 1)
    seen = {(rng.randrange(users), rng.randrange(40)) for _ in range(300)}
    rows = []
    for u, k in seen:
        pv, cart, fav, buy = (rng.randrange(4) for _ in range(4))
        if pv + cart + fav + buy:
            day = start + timedelta(days=k)
            rows.append((u, day, pv + cart + fav + buy, pv, cart, fav, buy, midnight(day) + 5000, midnight(day) + 4000 if buy else None))
    return rows, "user_raw long, event_date_bj date, event_count long, pv_count long, cart_count long, fav_count long, buy_count long, last_event_timestamp long, last_buy_timestamp long"


def test_windows_against_brute_force(spark):
    rows, schema = daily_rows(spark)
    daily = spark.createDataFrame(rows, schema)
    first, last = date(2024, 1, 20), date(2024, 1, 30)
    got = {(r.user_raw, r.event_date_bj): r for r in behavior.window_lookup(daily, first, last).collect()}
    want = 0
    for u in range(20):
        for k in range(11):
            d = first + timedelta(days=k)
            past = [r for r in rows if r[0] == u and 1 <= (d - r[1]).days <= 14]
            if not past:
                assert (u, d) not in got
                continue
            want += 1
            r = got[u, d]
            for w in schemas.WINDOWS:
                near = [x for x in past if (d - x[1]).days <= w]
                for i, m in enumerate(schemas.METRICS):
                    assert r[f"{m}_count_{w}d"] == sum(x[2 + i] for x in near)
            assert abs(r.days_since_last_event_14d - (midnight(d) - max(x[7] for x in past)) / 86400) < 1e-5
            buys = [x[8] for x in past if x[8]]
            assert (r.days_since_last_buy_14d is None) == (not buys) and r.has_buy_history_14d == int(bool(buys))
    assert len(got) == want


def test_later_events_change_nothing(spark):
    log = fixtures.behavior_log(spark, SMALL)
    d = date(2024, 1, 20)
    keys = log.select(F.col("user").alias("user_raw")).distinct().withColumn("event_date_bj", F.lit(d))
    features = lambda events: sorted(map(tuple, behavior.behavior_windows(behavior.daily_behavior(events, *fixtures.BEHAVIOR), keys).collect()))
    more = log.withColumn("time_stamp", F.lit(midnight(d)))  # at the start of the date itself
    assert features(log) == features(log.unionByName(more)) == features(log.repartition(9))
    rows = plans.impressions(spark, SMALL)
    before = pastctr.past_features(rows).filter(F.col("event_date_bj") <= d)
    flipped = rows.withColumn("clk", F.when(F.col("event_date_bj") >= d, 1 - F.col("clk")).otherwise(F.col("clk")))
    after = pastctr.past_features(flipped).filter(F.col("event_date_bj") <= d)
    names = ["impression_id", *pastctr.feature_names()]
    assert sorted(map(str, before.select(names).collect())) == sorted(map(str, after.select(names).collect()))


def test_first_date_has_no_past(spark):
    assert quality.past_checks(plans.past(spark, SMALL), list(schemas.ENTITIES)).filter("violations > 0").count() == 0


# ---- encoding


def test_encoding_of_null_and_unseen(spark):
    train = spark.createDataFrame([(5, "b"), (3, "a"), (5, None), (None, "b")], "x long, s string")
    maps = encode.vocabularies(train, ["x", "s"])
    for f, m in maps.items():
        assert sorted(map(tuple, m.collect())) == sorted(map(tuple, encode.vocabulary(train, f).collect()))
    rows = spark.createDataFrame([(3, "b"), (5, "z"), (9, None), (None, "a")], "x long, s string")
    got = {(r.x, r.s): (r.x_idx, r.s_idx) for r in encode.encode(rows, maps).collect()}
    assert got == {(3, "b"): (2, 3), (5, "z"): (3, 1), (9, None): (1, 1), (None, "a"): (1, 2)}
    assert encode.vocabulary(train, "hour").count() == 24


def test_roles_and_feature_sets():
    everything = [c for v in schemas.ROLES.values() for c in v]
    schemas.check_roles(everything)
    for bad in (everything[1:], [*everything, "new"]):
        with pytest.raises(ValueError):
            schemas.check_roles(bad)
    with pytest.raises(ValueError, match="label"):
        schemas.check_roles(["click_rate"], {"numeric": ["click_rate"]})
    sets = [encode.feature_set(n) for n in ("F1", "F1+F2", "F1+F2+F3")]
    assert [sum(map(len, s.values())) for s in sets] == [16 + 3 + 1, 16 + 5 + 19, 16 + 11 + 32]
    assert "hour_idx" not in encode.feature_set("F1", ["hour_idx"])["categorical"]
    for bad in (["nope"], ["hour_idx", "hour_idx"]):
        with pytest.raises(ValueError):
            encode.feature_set("F1", bad)


def test_layout(spark):
    got = [tuple(r) for r in encode.one_hot_layout(spark, {"a": 3, "b": 2}, ["x", "y"]).collect()]
    assert got == [("a", 0, 3), ("b", 3, 2), ("x", 5, 1), ("y", 6, 1)]


# ---- metrics


def scored(spark, n=400, levels=20, seed=3):
    rng = random.Random(seed)
    rows = [(i, rng.randrange(15), rng.randrange(2), rng.randrange(levels + 1) / levels) for i in range(n)]
    return rows, spark.createDataFrame(rows, "impression_id long, user_raw long, clk int, prediction double")


def brute_auc(rows):
    pos, neg = [p for *_, y, p in rows if y], [p for *_, y, p in rows if not y]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg)) if pos and neg else None


def test_ranking_metrics(spark):
    rows, df = scored(spark)
    r = metrics.metrics(df).first()
    assert abs(r.auc - brute_auc(rows)) < 1e-12
    pos, hits, seen, ap = sum(y for *_, y, _ in rows), 0, 0, 0.0
    for p in sorted({p for *_, p in rows}, reverse=True):
        tied = [y for *_, y, q in rows if q == p]
        hits, seen = hits + sum(tied), seen + len(tied)
        ap += sum(tied) * hits / seen / pos
    assert abs(r.average_precision - ap) < 1e-12
    assert metrics.metrics(df.filter("clk = 1")).first().auc is None
    g = metrics.gauc(df).first()
    users = {u: [x for x in rows if x[1] == u] for u in {x[1] for x in rows}}
    ok = [(brute_auc(v), len(v)) for v in users.values() if brute_auc(v) is not None]
    assert abs(g.gauc - sum(a * n for a, n in ok) / sum(n for _, n in ok)) < 1e-12 and g.eligible_users == len(ok)


def test_bins_are_not_ntile(spark):
    _, df = scored(spark, 13)
    sizes = [r["count"] for r in metrics.equal_count_bins(df, 5).groupBy("bin").count().orderBy("bin").collect()]
    assert sizes == [3, 3, 2, 3, 2]


def test_checked_join(spark):
    _, df = scored(spark, 20)
    context = df.select("impression_id", "clk", F.lit("x").alias("c"))
    assert metrics.checked_join(df, context).count() == 20
    for p, c, what in [
        (df.unionByName(df), context, "unique"), (df, context.unionByName(context), "unique"), (df, context.limit(5), "without context"),
        (df, context.withColumn("clk", 1 - F.col("clk")), "another label"), (df.withColumn("prediction", F.lit(2.0)), context, "invalid"), (df.withColumn("prediction", F.lit(float("nan"))), context, "invalid"),
    ]:
        with pytest.raises(ValueError, match=what):
            metrics.checked_join(p, c)


# ---- calibration and models


def test_calibrators(spark):
    rng = random.Random(9)
    rows = []
    for i in range(3000):
        p = rng.random()
        rows.append((i, int(rng.random() < p * p), p))
    df = spark.createDataFrame(rows, "impression_id long, clk int, prediction double")
    raw = calibrate.mean_log_loss(df, "prediction")
    kind, losses = calibrate.select_calibrator(df)
    assert losses[kind] == min(losses.values()) and losses[kind] < raw
    out = calibrate.calibrate(df, df)
    assert out.count() == 3000 and out.agg(F.min("calibrated_prediction") > 0, F.max("calibrated_prediction") < 1).first() == (True, True)
    parts = [calibrate.selection_rows(df, chosen=c).count() for c in (True, False)]
    assert sum(parts) == 3000 and 400 < parts[0] < 800
    with pytest.raises(ValueError):
        calibrate.predictions_of("calibrated", df)


def test_grid_guard_and_selection(spark):
    _, df = scored(spark, 60)
    run = lambda split, **_: df.withColumn("split", F.lit(split))
    got = models.grid(run, [{"split": "val", "a": 1}, {"split": "val", "a": 2}], done=lambda c: c["a"] == 2)
    assert got.count() == 1
    with pytest.raises(ValueError, match="test split"):
        models.grid(run, [{"split": "test"}])
    table = spark.createDataFrame([("a", 0, 0.6, 0.2), ("a", 1, 0.7, 0.2001), ("b", 2, 0.9, 0.3)], "family string, config int, auc double, logloss double")
    assert models.select_near_best(table).first().config == 1
    assert sorted(r.config for r in models.select_least_loss(table, "family").collect()) == [0, 2]


def test_run_manifest(spark, tmp_path):
    models.write_run(spark, str(tmp_path / "run"), "lr", {"a": 1}, {"numeric": ["x"]}, {"auc": 0.5})
    assert models.read_run(spark, str(tmp_path / "run"))["params"] == {"a": 1}
    assert models.smoke(scored(spark, 50)[1], rows=10).count() == 10


def test_unknown_is_neutral(spark):
    df = spark.createDataFrame([(1, 2), (2, 3)], "f_idx long, other long")
    assert [r.f_idx for r in models.neutral_unknown(df, ["f_idx"], {"f_idx": 5}).collect()] == [5, 2]


# ---- audits


def test_audits(spark):
    df = spark.createDataFrame([(1, 1.0), (1, None), (2, 3.0)], "k int, x double")
    report = quality.violations(df, {"big": F.col("x") > 2, "never": F.col("x") > 9})
    assert {r.check: r.violations for r in report.collect()} == {"big": 1, "never": 0}
    with pytest.raises(ValueError, match="big: 1"):
        quality.require_clean(report)
    with pytest.raises(ValueError, match="unique"):
        base.require_unique(df, "k")
    assert quality.repeated_keys(df, ["k"], "k").first().violations == 1
    assert quality.row_conservation(df, df.filter("k = 1"), ["k"], "rows").filter("violations > 0").collect()[0].check == "rows/2"
    table = spark.createDataFrame([(1, date(2024, 1, 1), 5, None), (2, date(2024, 1, 1), 6, 1.0)], "user_raw int, event_date_bj date, a int, b float")
    wrong = table.withColumn("a", F.when(F.col("user_raw") == 2, 7).otherwise(F.col("a")))
    sample = quality.hash_sample(table, "event_date_bj", "user_raw", 5)
    got = {r.check: r.violations for r in quality.identity_audit(table, wrong, ["user_raw", "event_date_bj"], ["a", "b"], sample).collect()}
    assert got == {"a": 1, "b": 0}


def test_platt_against_newton_steps(spark):
    import numpy as np

    rng = random.Random(21)
    rows = [(i, int(rng.random() < 0.2 + 0.5 * (i % 10) / 10), (i % 10 + 0.5) / 10) for i in range(2000)]
    df = spark.createDataFrame(rows, "impression_id long, clk int, prediction double")
    z, y = np.array([np.log(p / (1 - p)) for *_, p in rows]), np.array([c for _, c, _ in rows])
    x, w = np.stack([z, np.ones_like(z)], 1), np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x, x.T @ (p - y))
    got = {round(r.prediction, 6): r.calibrated for r in calibrate.fit_platt(df)(df).select("prediction", "calibrated").distinct().collect()}
    for p, c in got.items():
        assert abs(c - 1 / (1 + np.exp(-(w[0] * np.log(p / (1 - p)) + w[1])))) < 1e-4


def test_isotonic_against_pooling(spark):
    rng = random.Random(22)
    rows = [(i, int(rng.random() < 0.3 + 0.4 * (i % 50) / 50), (i % 50 + 1) / 52) for i in range(1500)]
    df = spark.createDataFrame(rows, "impression_id long, clk int, prediction double")
    pools = []  # mean and weight, pooled while they fall
    for p in sorted({p for *_, p in rows}):
        tied = [c for _, c, q in rows if q == p]
        pools.append([sum(tied) / len(tied), len(tied), [p]])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            (a, n, s), (b, m, t) = pools[-2:]
            pools[-2:] = [[(a * n + b * m) / (n + m), n + m, s + t]]
    want = {round(p, 9): max(1e-7, min(1 - 1e-7, a)) for a, _, s in pools for p in s}
    got = {round(r.prediction, 9): r.calibrated for r in calibrate.fit_isotonic(df)(df).select("prediction", "calibrated").distinct().collect()}
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-9 for p in want)


def test_selection_and_reliability_of_stages(spark):
    rng = random.Random(23)
    draw = lambda n, seed: spark.createDataFrame([(seed * 10**6 + i, int(rng.random() < 0.1 + 0.3 * (i % 100) / 100), (i % 100 + 0.5) / 100) for i in range(n)], "impression_id long, clk int, prediction double")
    val, test = draw(3000, 1), draw(1000, 2)
    kind, losses = calibrate.select_calibrator(val)
    for k, fit in calibrate.CALIBRATORS.items():
        held = fit(calibrate.selection_rows(val, chosen=False))(calibrate.selection_rows(val)).toPandas()
        assert abs(metrics_of(held.clk, held.calibrated) - losses[k]) < 1e-12
    assert losses[kind] == min(losses.values())
    made = calibrate.fit_platt(val)(test).toPandas()
    got = {(r.stage, r.bin): r for r in calibrate.reliability_of_stages(val, test).collect()}
    for stage, column in (("raw", "prediction"), ("calibrated", "calibrated")):
        rows = made.sort_values([column, "impression_id"]).reset_index(drop=True)
        for b in range(1, 11):
            part = rows[(rows.index * 10 // len(rows) + 1) == b]
            r = got[stage, b]
            assert r.rows == len(part) and r.clicks == part.clk.sum() and abs(r.mean_prediction - part[column].mean()) < 1e-12 and abs(r.gap - abs(part[column].mean() - part.clk.mean())) < 1e-12
    gaps = {s: sum(r.gap * r.rows for (t, _), r in got.items() if t == s) / len(made) for s in ("raw", "calibrated")}
    assert gaps["calibrated"] < gaps["raw"]


def metrics_of(y, p):
    import numpy as np

    q = np.clip(p, 1e-7, 1 - 1e-7)
    return float(-(y * np.log(q) + (1 - y) * np.log(1 - q)).mean())


def test_bootstrap(spark):
    _, df = scored(spark, 4000)
    got = {r["round"]: r for r in metrics.bootstrap(df).collect()}
    assert len(got) == 20 and all(abs(r.rows / 4000 - 1) < 0.08 for r in got.values()) and len({r.rows for r in got.values()}) > 5
    assert abs(sum(r.rows for r in got.values()) / 80000 - 1) < 0.02
    whole = metrics.probability_metrics(df).first()
    assert abs(sum(r.logloss for r in got.values()) / 20 - whole.logloss) < 0.05 and abs(sum(r.actual_ctr for r in got.values()) / 20 - whole.actual_ctr) < 0.01
    again = {r["round"]: r for r in metrics.bootstrap(df.repartition(6)).collect()}
    assert all(again[k].rows == r.rows and abs(again[k].logloss - r.logloss) < 1e-9 for k, r in got.items())


def test_left_predictions_are_refused(spark, tmp_path):
    models.refuse_left_predictions(spark, str(tmp_path / "none"))
    (tmp_path / "a" / "val").mkdir(parents=True)
    models.refuse_left_predictions(spark, str(tmp_path))
    (tmp_path / "a" / "predictions_test.parquet").write_text("")
    with pytest.raises(ValueError, match="before the test split"):
        models.refuse_left_predictions(spark, str(tmp_path))


def test_trees_split_by_categories(spark):
    rows = [(i, i % 2, "train", i % 7 + 1, 0, float(i % 2) * 0) for i in range(700)]
    rows = [(i, int(c in (2, 5, 7)), s, c, f, x) for i, _, s, c, f, x in rows]
    df = spark.createDataFrame(rows, "impression_id long, clk int, split string, c_idx long, flag int, x double")
    columns = {"categorical": ["c_idx"], "binary": ["flag"], "numeric": ["x"]}
    trees = models.train(df, "gbt", columns, {"c_idx": 8}, validation=df, maxDepth=1, maxIter=3)
    got = trees(df).toPandas()
    assert ((got.prediction > 0.5) == (got.clk == 1)).all()  # one split by a set of values
    assert models.importances(trees).orderBy(F.desc("gain")).first().feature == "c_idx"
