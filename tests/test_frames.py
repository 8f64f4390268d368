"""Ordered-frame features: hand-computed cases, and the hot-group path against the plain one."""

import datetime as dt

import pytest
from conftest import close, rows
from pyspark.sql import functions as F

from lagwell.plans.frames import Feature, Split, back, lagged, last, prior, seven_day_sum, through, totals

BLOCKS = Split(block_rows=16)


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows in one entity, NULL entities, NULL values, several rows a day."""
    r = spark.range(600).selectExpr(
        "id", "case when id % 3 = 0 then 'hot' when id % 50 = 1 then null else concat('e', id % 17) end as entity",
        "timestamp_ntz '2020-01-01' + make_dt_interval(cast(pmod(hash(id, 7), 200) as int)) as game_date",
        "case when pmod(hash(id, 1), 9) = 0 then null else cast(pmod(hash(id, 2), 1000) as double) / 8 end as x",
        "cast(pmod(hash(id, 3), 5) as int) as n", "cast(pmod(hash(id, 4), 999) / 7 as decimal(18,4)) as m",
        "1e7D + pmod(hash(id, 5), 3) * 1e-3D as far")
    return r.withColumn("season", F.expr("cast(month(game_date) / 3 as int)")).cache()


def features():
    out = []
    for agg in ("sum", "avg", "std", "max", "min", "count"):
        for tag, frame in (("l3", last(3)), ("all", prior()), ("szn", prior("season")), ("thru", through())):
            out.append(Feature(f"{agg}_{tag}", agg, "x", frame))
    out += [Feature("median_l3", "median", "x", last(3)), Feature("median_n", "median", "n", last(4))]
    out += [Feature("rows_all", "rows", None, prior()), Feature("rows_10", "rows", None, last(10)),
            Feature("rn", "rows", None, through()), Feature("lag2", "value", "x", back(2)),
            Feature("money", "sum", "m", prior()), Feature("mean_money", "avg", "m", prior()),
            Feature("far_std", "std", "far", prior()), Feature("strict", "sum", "x", prior("season"), need_prev=True)]
    return out


def test_blocks_give_the_same_rows_and_types(skewed):
    one = lagged(skewed, "entity", ["game_date", "id"], features())
    two = lagged(skewed, "entity", ["game_date", "id"], features(), split=BLOCKS)
    assert one.dtypes == two.dtypes
    plain, split = rows(one, "id"), rows(two, "id")
    assert len(plain) == len(split) == 600
    for a, b in zip(plain, split):
        for k in a:
            assert close(a[k], b[k], 1e-6), (k, a, b)
    assert max(r["far_std"] or 0 for r in split) > 5e-4


def test_expanding_medians_take_no_blocks(skewed):
    with pytest.raises(ValueError, match="median"):
        lagged(skewed, "entity", ["game_date", "id"], [Feature("m", "median", "x", prior())], split=BLOCKS)


def test_text_order_takes_the_plain_window(skewed):
    d = lagged(skewed.withColumn("at", F.col("game_date").cast("string")), "entity", ["at", "id"], [Feature("s", "sum", "x", prior())])
    assert d.count() == 600


def test_totals_keep_rows_of_null_keys(skewed):
    got = rows(totals(skewed, ["entity"], {"m": F.max("x"), "c": F.count("x")}), "id")
    every = {}
    for r in got:
        every.setdefault(r["entity"], []).append(r["x"])
    assert len(got) == 600
    for r in got:
        own = [x for x in every[r["entity"]] if x is not None]
        assert (r["m"], r["c"]) == (max(own), len(own))


def starts(spark, items):
    data = [(p, dt.datetime(2024, m, d), g, ip) for p, m, d, g, ip in items]
    return spark.createDataFrame(data, "personId string, game_date timestamp_ntz, gamepk string, ip double")


def test_seven_day_innings(spark):
    d = starts(spark, [("a", 4, 1, "1", 6.0), ("a", 4, 20, "2", 5.0), ("a", 4, 25, "3", 4.0), ("a", 4, 26, "4", 3.0)])
    for split in (None, Split(7)):
        r = rows(seven_day_sum(d, "personId", "game_date", "gamepk", "ip", "w", split=split), "gamepk")
        assert [x["w"] for x in r] == [0.0, 6.0, 11.0, 15.0]


def test_doubleheader_breaks_ties_by_game(spark):
    d = starts(spark, [("a", 4, 1, "1", 6.0), ("a", 4, 1, "2", 5.0), ("a", 4, 2, "3", 1.0)])
    r = rows(lagged(d, "personId", ["game_date", "gamepk"], [Feature("p", "value", "ip", back(1)), Feature("s", "sum", "ip", prior())]), "gamepk")
    assert [(x["p"], x["s"]) for x in r] == [(None, None), (6.0, 6.0), (5.0, 11.0)]


def test_bad_features_are_rejected():
    with pytest.raises(ValueError):
        Feature("x", "mode", "c")
    with pytest.raises(ValueError):
        Feature("x", "value", "c", last(3))
    with pytest.raises(ValueError):
        last(0)
