import math
from statistics import NormalDist

import numpy as np
from pyspark.sql import functions as F

from pluvia.functions import qm, text
from pluvia.functions.et0 import et0_fao56
from pluvia.functions.normal import norm_ppf
from pluvia.functions.spei import average_rank, drought_level, spei


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def lit(x):
    return F.lit(x).cast("double")


def test_et0_anchor_and_missing(spark):
    row = one(
        spark,
        et0_fao56(lit(25), lit(60), lit(2), lit(500)),
        et0_fao56(lit(25), lit(60), lit(7.2), lit(500), wind_unit="km/h"),
        et0_fao56(lit(25), lit(60), lit(2), lit(None)),
        et0_fao56(lit(25), lit(60), lit(2), lit(float("nan"))),
        et0_fao56(lit(5), lit(100), lit(0), lit(-200)),
    )
    assert abs(row[0] - 0.48490660069) < 1e-10
    assert abs(row[1] - row[0]) < 1e-12
    assert row[2] is None and row[3] is None and row[4] == 0


def test_inverse_normal(spark):
    points = [1e-6, 0.01, 0.05, 0.075, 0.3, 0.5, 0.7, 0.925, 0.975, 0.9999]
    rows = spark.createDataFrame([(p,) for p in points], "p double").select("p", norm_ppf(F.col("p")).alias("z")).collect()
    assert all(abs(r.z - NormalDist().inv_cdf(r.p)) < 1e-12 for r in rows)
    assert one(spark, norm_ppf(lit(None)))[0] is None


def plain_spei(balance):
    """Reference in plain Python: average rank, plotting position, normal quantile, clip."""
    known = [b for b in balance if b is not None]
    if len(known) < 30:
        return [None] * len(balance)
    out = []
    for b in balance:
        if b is None:
            out.append(None)
            continue
        rank = sum(k < b for k in known) + (sum(k == b for k in known) + 1) / 2
        out.append(max(-3.0, min(3.0, NormalDist().inv_cdf((rank - 0.35) / len(known)))))
    return out


def series(spark, water, point=1):
    return spark.createDataFrame([(point, i, float(w) if w is not None else None, 0.0) for i, w in enumerate(water)], "point int, t int, precip double, et0 double")


def rolled(water, scale):
    out = []
    for i in range(len(water)):
        part = water[max(0, i - scale + 1) : i + 1]
        out.append(sum(part) if len(part) == scale and None not in part else None)
    return out


def test_spei_against_plain_python(spark):
    draw = np.random.default_rng(1)
    water = [float(x) for x in draw.normal(size=600)] + [1.0, 1.0, 1.0, 1.0]
    water[50] = None
    for scale in (1, 3):
        got = spei(series(spark, water), ["point"], "t", "precip", "et0", scale).orderBy("t").collect()
        want = plain_spei(rolled(water, scale))
        assert all((g.spei is None) == (w is None) and (w is None or abs(g.spei - w) < 1e-9) for g, w in zip(got, want))
    assert min(g.spei for g in got if g.spei is not None) == -3.0  # the clip binds on long series only


def test_spei_needs_thirty(spark):
    for n, known in ((29, 0), (30, 30)):
        got = spei(series(spark, range(n)), ["point"], "t", "precip", "et0", 1).collect()
        assert sum(r.spei is not None for r in got) == known
    assert spei(series(spark, [None] * 40), ["point"], "t", "precip", "et0", 1).filter("spei IS NOT NULL").count() == 0
    assert spei(series(spark, []), ["point"], "t", "precip", "et0").count() == 0


def test_spei_is_unchanged_by_growing_maps(spark):
    water = [float(x) for x in np.random.default_rng(2).normal(size=80)]
    a = spei(series(spark, water), ["point"], "t", "precip", "et0", 1).orderBy("t").collect()
    b = spei(series(spark, [3 * w + 7 for w in water]), ["point"], "t", "precip", "et0", 1).orderBy("t").collect()
    assert [r.spei for r in a] == [r.spei for r in b]


def test_rank_ties(spark):
    df = spark.createDataFrame([(v,) for v in (10, 20, 20, 30, None)], "v int").select("v", average_rank(F.col("v"), [F.lit(1)]).alias("r"))
    assert sorted((r.v or 0, r.r) for r in df.collect() if r.v) == [(10, 1.0), (20, 2.5), (20, 2.5), (30, 4.0)]
    assert df.filter("v IS NULL").first().r is None


def test_drought_classes(spark):
    values = [None, float("nan"), -2.0, -1.5, -1.0, -0.5, 0.0, 0.5]
    got = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i").select(drought_level(F.col("v"))).collect()
    short = [r[0].split()[0] for r in got]
    assert short == ["Unknown", "Unknown", "Extreme", "Severe", "Moderate", "Mild", "Normal", "Wet"]


def qm_pairs(spark, n):
    return spark.createDataFrame([(float(i % 37), float(i % 37) * 2 + 5) for i in range(n)], "obs double, sim double")


def test_quantile_mapping_guard_and_identity(spark):
    few = qm.apply(qm_pairs(spark, 99), qm.fit(qm_pairs(spark, 99), "obs", "sim", []), "sim", [])
    assert few.filter("corrected IS NOT NULL").count() == 0
    many = qm_pairs(spark, 400)
    fixed = qm.apply(many, qm.fit(many, "obs", "sim", []), "sim", [])
    row = qm.metrics(fixed, "obs", "sim", "corrected", []).first()
    assert abs(row.bias_after) < 0.05 < abs(row.bias_before)
    same = qm.apply(many, qm.fit(many, "obs", "obs", []), "obs", [])
    assert same.filter("abs(corrected - obs) > 1e-9").count() == 0
    ordered = [r.corrected for r in fixed.orderBy("sim").collect()]
    assert ordered == sorted(ordered)


def test_quantile_mapping_matches_numpy(spark):
    draw = np.random.default_rng(3)
    obs, sim = draw.normal(size=300), draw.normal(size=300) * 2 + 1
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(obs, sim)] + [(None, 99.0), (1.0, float("nan"))], "obs double, sim double")
    got = qm.apply(df, qm.fit(df, "obs", "sim", []), "sim", []).collect()
    at = np.linspace(0, 1, 100)
    xp, fp = np.quantile(sim, at), np.quantile(obs, at)
    for r in got:
        if r.sim == r.sim:
            assert abs(r.corrected - np.interp(r.sim, xp, fp)) < 1e-9
        else:
            assert r.corrected is None


def test_formats(spark):
    row = one(
        spark,
        text.shown(lit(1.25)), text.shown(lit(None)), text.shown_et0(lit(0.00123)), text.shown_et0(lit(0)), text.shown_et0(lit(0.5)), text.shown_et0(lit(None)),
        text.shown_count(F.lit(1234567)), text.shown_count(F.lit(None).cast("long")), text.station_key(F.lit("5424"), F.lit("999999")),
        text.share_percent(F.lit(1), F.lit(0)), text.share_percent(F.lit(1), F.lit(4)),
    )
    assert list(row) == [row[0], "-", "1.23e-3", "0.0000", "0.5000", "-", "1,234,567", "0", "005424-999999", None, 25.0]
    assert math.isclose(float(row[0]), 1.3, abs_tol=0.06)


def test_log_logistic_spei_by_its_moments(spark):
    from statistics import NormalDist

    from pluvia.functions.spei import spei_log_logistic

    draw = np.random.default_rng(6)
    x = draw.gamma(3.0, 20.0, 240) - 30
    df = spark.createDataFrame([(1, i, float(v), 0.0) for i, v in enumerate(x)], "point int, t int, precip double, et0 double")
    got = [r.spei for r in spei_log_logistic(df, ["point"], "t", "precip", "et0", 1).orderBy("t").collect()]
    above = 1 - (x.argsort().argsort() + 1 - 0.35) / len(x)
    w0, w1, w2 = (np.mean(above**k * x) for k in range(3))
    b = (2 * w1 - w0) / (6 * w1 - w0 - 6 * w2)
    both = math.gamma(1 + 1 / b) * math.gamma(1 - 1 / b)
    a = (w0 - 2 * w1) * b / both
    c = w0 - a * both
    for s, v in zip(got, x):
        p = 1 / (1 + (a / (v - c)) ** b) if v > c else 1e-9
        assert abs(s - max(-3, min(3, NormalDist().inv_cdf(min(max(p, 1e-9), 1 - 1e-9))))) < 1e-6
    assert abs(np.mean(got)) < 0.1 and 0.85 < np.std(got) < 1.15
    few = spei_log_logistic(df.limit(29), ["point"], "t", "precip", "et0", 1)
    assert few.filter("spei IS NOT NULL").count() == 0


def test_quantile_mapping_over_a_base_period_and_groups(spark):
    rows = [(g, t, float(t % 50) + g, 2.0 * (t % 50)) for g in (1, 2) for t in range(300)]
    df = spark.createDataFrame(rows, "g int, t int, obs double, sim double")
    period = (F.col("t"), F.lit(0), F.lit(149))
    fitted = qm.fit(df, "obs", "sim", ["g"], period=period)
    assert {(r.g, r.n_pairs) for r in fitted.collect()} == {(1, 150), (2, 150)}
    fixed = qm.apply(df, fitted, "sim", ["g"])
    assert fixed.count() == 600 and fixed.filter("abs(corrected - obs) > 0.51").count() == 0
    assert qm.apply(df.withColumn("g", F.lit(3)), fitted, "sim", ["g"]).filter("corrected IS NOT NULL").count() == 0
    row = qm.metrics(fixed, "obs", "sim", "corrected", []).first()
    assert row.mae_after < 0.3 < row.mae_before and row.r2_after > 0.99 > row.r2_before


def rain(spark, seed=5):
    """Two stations of which the model drizzles too often and one where it is too dry; ties, missing values, clashing names."""
    draw = np.random.default_rng(seed)
    rows = []
    for g, wet_obs, wet_sim in (("a", 0.3, 0.7), ("b", 0.6, 0.2), (None, 0.5, 0.5)):
        for t in range(500):
            obs = float(np.round(draw.gamma(1.0, 6.0), 1) + 0.1) if draw.random() < wet_obs else 0.0
            sim = float(np.round(draw.gamma(0.8, 3.0)) + 1) if draw.random() < wet_sim else 0.0
            rows.append((g, t, None if t % 97 == 0 else obs, float("nan") if t % 89 == 0 else sim, 1, 2, 3, "x"))
    return rows, spark.createDataFrame(rows, "g string, t int, obs double, sim double, n_pairs int, n int, total int, xp string")


def test_precipitation_keeps_the_observed_share_of_wet_days(spark):
    rows, df = rain(spark)
    found = qm.precipitation(df, "obs", "sim", ["g"], "t", enough=50)
    assert found.columns == [*df.columns, "corrected"] and found.count() == len(rows)
    got = {(r.g, r.t): r for r in found.collect()}
    assert all(r.n_pairs == 1 and r.n == 2 and r.total == 3 and r.xp == "x" for r in got.values())
    assert all(got[None, r[1]].corrected is None for r in rows if r[0] is None)  # a null group is none
    for g in ("a", "b"):
        full = [(r[1], r[2], r[3]) for r in rows if r[0] == g and r[2] is not None and r[3] == r[3]]
        k = sum(o > 0 for _, o, _ in full)
        wet = {t for t, _, _ in sorted(full, key=lambda r: (-r[2], r[0]))[:k]}
        xp, fp = np.quantile([s for t, _, s in full if t in wet], np.linspace(0, 1, 100)), np.quantile([o for _, o, _ in full if o > 0], np.linspace(0, 1, 100))
        for t, _, s in full:
            at = int((xp <= s).sum())
            inside = fp[at - 1] + (fp[at] - fp[at - 1]) / (xp[at] - xp[at - 1]) * (s - xp[at - 1]) if 0 < at < 100 else fp[0 if at == 0 else 99]
            assert abs(got[g, t].corrected - (inside if t in wet else 0.0)) < 1e-9
        assert sum(got[g, t].corrected > 0 for t, _, _ in full) == k
        assert all(got[g, r[1]].corrected is None for r in rows if r[0] == g and (r[2] is None or r[3] != r[3]))
    few = qm.precipitation(df.limit(60), "obs", "sim", ["g"], "t")
    assert few.filter("corrected IS NOT NULL").count() == 0
    assert qm.precipitation(df.limit(0), "obs", "sim", ["g"], "t").count() == 0
    alone = qm.precipitation(df.filter("g = 'a'").drop("g"), "obs", "sim", [], "t", enough=50)
    assert {r.t: r.corrected for r in alone.collect()} == {t: r.corrected for (g, t), r in got.items() if g == "a"}


def test_inner_names_do_not_clash(spark):
    from pluvia.operators import quality, ranks

    df = spark.createDataFrame([("a", i, float(i % 7), i, i, i, i) for i in range(40)], "q string, n int, v double, total int, before int, _at int, n_pairs int")
    got = ranks.with_ranks(df, ["q"], "v").select("n", "total", "before", ranks.average_rank().alias("rank"))
    assert got.filter("n = total AND n = before").count() == 40
    assert quality.iqr_outliers(df, "v", ["q"]).columns == [*df.columns, "is_outlier"]
    assert quality.fill_gaps(df, "v", ["q"], "n").columns == [*df.columns, "v_filled"]
    assert qm.apply(df, qm.fit(df, "v", "n", ["q"]), "n", ["q"]).columns == [*df.columns, "corrected"]
    assert qm.scaled(df, "v", "n", ["q"]).columns == [*df.columns, "corrected"]
