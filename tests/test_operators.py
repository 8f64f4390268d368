"""Hand-computed cases for cleaning, pitches, seasons, rolling, joins and the state machine."""

import datetime as dt

import numpy as np
import pytest
from conftest import close, rows
from pyspark.sql import functions as F

from lagwell.functions import rates as X
from lagwell.functions import text as T
from lagwell.operators import base_out as B
from lagwell.operators import clean as C
from lagwell.operators import joins as J
from lagwell.operators import pitches as P
from lagwell.operators import prep
from lagwell.operators import rolling as R
from lagwell.operators import season as S
from lagwell.operators import sequence as Q


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def test_innings_notation(spark):
    d = spark.createDataFrame([(6.1,), (None,), (6.2,), (7.0,)], "ip double")
    got = [r["x"] for r in d.select(T.innings("ip").alias("x")).collect()]
    assert [None if g is None else round(g, 4) for g in got] == [6.3333, None, 6.6667, 7.0]
    assert one(spark, T.innings(F.lit(6.5), "null")) is None
    with pytest.raises(Exception, match="innings fraction"):
        one(spark, T.innings(F.lit(6.5), "raise"))


def test_guards_keep_null(spark):
    assert one(spark, X.safe_div(F.lit(1), F.lit(0))) is None
    assert one(spark, X.cap(F.lit(None).cast("double"), 27.0)) is None
    assert one(spark, X.cap(F.lit(30.0), 27.0)) == 27.0
    assert one(spark, X.half_even(F.lit(0.125), 2)) == 0.12
    assert one(spark, X.truth(F.lit(None).cast("boolean"))) is False
    assert one(spark, X.log5(F.lit(0.3), F.lit(0.2), F.lit(0.25))) == pytest.approx(0.24 / (0.24 + 0.56 / 0.75))
    with pytest.raises(ValueError):
        X.blend({"a": 0.5, "b": 0.6})


def test_text(spark):
    assert one(spark, T.height_inches(F.lit("6' 3\""))) == 75
    assert one(spark, T.first_int(F.lit("n/a"))) is None
    summer, winter = F.lit("2024-07-01T23:05:00Z"), F.lit("2024-01-01T18:05:00Z")
    assert one(spark, T.local_clock(T.parse_utc(summer))) == "6:05 PM"
    assert one(spark, T.local_clock(T.parse_utc(winter))) == "12:05 PM"


PITCH = dict(gamepk="g1", batter_id="1", pitcher_id="2", play_result="Single", pitch_call="Foul", end_speed=85.0, start_speed=92.0,
             extension=6.0, plate_z=2.5, strike_zone_bottom=1.5, strike_zone_top=3.5, pfx_x=3.0, pfx_z=4.0, zone=12, is_in_play=False)


def pitch(spark, **kw):
    row = {**PITCH, **kw}
    return P.row_flags(spark.createDataFrame([tuple(row.values())], ", ".join(
        f"{k} {'boolean' if isinstance(PITCH[k], bool) else 'int' if isinstance(PITCH[k], int) else 'double' if isinstance(PITCH[k], float) else 'string'}"
        for k in row))).first()


def test_swing_and_chase_flags(spark):
    foul = pitch(spark)
    assert foul["is_swing"] and foul["is_chase"] and not foul["is_zone_swing"] and foul["movement_magnitude"] == 5.0
    hit = pitch(spark, pitch_call="In play, no out", is_in_play=True, zone=5)
    assert hit["is_zone_swing"] and not hit["is_chase"] and hit["is_hit"] == 1
    take = pitch(spark, pitch_call="Ball", zone=None)
    assert not take["is_swing"] and take["is_chase"] is False
    assert pitch(spark, pitch_call="Missed Bunt")["is_swinging_strike"]


def test_starter_takes_first_non_null_values(spark):
    d = spark.createDataFrame([("g", "t", 1, 1, "p1", None), ("g", "t", 1, 2, "p2", "Two"), ("g", "t", 2, 3, "p3", "Three")],
                              "gamepk string, pitcher_team_id string, inning int, event_index int, pitcher_id string, pitcher_name string")
    r = P.starters(d).first()
    assert (r["starter_id"], r["starter_name"]) == ("p1", "Two")


def test_hands(spark):
    d = spark.createDataFrame([("b", "p"), ("s", "p"), ("s", "q"), ("x", "p")], "batter_id string, pitcher_id string")
    pl = spark.createDataFrame([("b", "L", "R"), ("s", "S", "R"), ("p", "R", "S"), ("q", "R", "L")], "personId string, batSide string, pitchHand string")
    r = rows(P.platoon(d, pl), "batter_id", "pitcher_id")
    assert [(x["platoon_advantage"], x["same_hand"]) for x in r] == [(1, 0), (1, 0), (1, 0), (0, 0)]


def games(spark, items, cols="h"):
    base = [("a", dt.datetime(2024 if s == 1 else 2025, 4, d), s, str(d), *v) for s, d, *v in items]
    return spark.createDataFrame(base, "personId string, game_date timestamp_ntz, game_season int, gamepk string, " + cols)


def test_rolling_modes_and_missing_previous(spark):
    d = games(spark, [(1, 1, 2.0), (1, 2, None), (1, 3, 1.0), (2, 4, 5.0)], "h double")
    assert [r["h"] for r in rows(R.roll(d, "personId", "season", ["h"]), "gamepk")] == [None, 2.0, None, None]
    assert [r["h"] for r in rows(R.roll(d, "personId", 2, ["h"]), "gamepk")] == [None, 2.0, 2.0, 1.0]


@pytest.mark.parametrize("window", [0, -5, "bogus", 3.5, True])
def test_windows_are_validated(window):
    with pytest.raises(ValueError):
        R.check_window(window)


def _game_states(spark, lists):
    from lagwell.plans.frames import moments_sql
    d = spark.createDataFrame([("a", 2024 + (k >= 90), k, x) for k, xs in enumerate(lists) for x in xs], "personId string, game_season int, k int, x double")
    g = d.groupBy("personId", "game_season", "k").agg(F.expr(moments_sql("x")).alias("w"))
    return g.withColumns({"gamepk": F.lpad(F.col("k").cast("string"), 3, "0"), "game_date": F.expr("timestamp_ntz '2024-01-01'")})


def test_pooled_deviation_is_the_true_one(spark):
    from lagwell.plans.frames import deviation_sql
    for base in (0.0, 1e7):
        lists = [[90.0, 92.0], [88.0], [95.0, 96.0, 94.0], [None], [1.0]]
        lists = [[None if x is None else base + x / (1e3 if base else 1) for x in xs] for xs in lists]
        for window in (10, 2, "season"):
            r = R.roll(_game_states(spark, lists), "personId", window, states=["w"]).withColumn("std", F.expr(deviation_sql("w")))
            got = [x["std"] for x in rows(r, "gamepk")]
            for k, v in enumerate(got):
                before = [x for xs in lists[0 if window == "season" else max(0, k - window) : k] for x in xs if x is not None]
                assert v is None if len(before) < 2 else v == pytest.approx(np.std(before, ddof=1), rel=1e-5)


def test_equal_values_far_off_have_no_deviation(spark):
    from lagwell.plans.frames import deviation_sql
    for window in (3, "season"):
        r = R.roll(_game_states(spark, [[1e7 + 0.1]] * 6), "personId", window, states=["w"]).withColumn("std", F.expr(deviation_sql("w")))
        assert [x["std"] for x in rows(r, "gamepk")][:2] == [None, None]
        assert all(x["std"] < 1e-8 for x in rows(r, "gamepk")[2:])


def test_season_shift_and_pivot(spark):
    d = spark.createDataFrame([("p", 2023, "L", 1.0), ("p", 2023, "R", 2.0), ("p", 2023, "X", 9.0), ("q", 2023, "R", 3.0)],
                              "id string, game_season int, hand string, batter_season_rate double")
    w = S.as_last_season(S.pivot_hands(d, "hand", {"L": "vs_lhp", "R": "vs_rhp"}, ["id", "game_season"], "batter_season_"))
    r = rows(w, "id")
    assert r[0] == {"id": "p", "game_season": 2024, "batter_last_season_vs_lhp_rate": 1.0, "batter_last_season_vs_rhp_rate": 2.0}
    assert r[1]["batter_last_season_vs_lhp_rate"] is None


def test_boxscore_zero_denominators(spark):
    d = spark.createDataFrame([("a", 2024, 0, 0, 0, 0, 0, 1, 0)], "personId string, game_season int, h int, k int, bb int, hr int, ab int, "
                              "plate_appearances int, total_bases_from_h int")
    r = S.batter_box_season(d).first()
    assert r["batter_last_season_ba"] is None and r["batter_last_season_babip"] is None


def test_base_out_states_follow_the_events(spark):
    ev = B.EVENTS + [None, "unknown"]
    data = [("g", "top", 1, i, ev[(i * 7) % len(ev)]) for i in range(60)] + [("g", "bottom", 1, i, "single") for i in range(3)]
    d = spark.createDataFrame(data, "gamepk string, half_inning string, inning int, event_index int, event_type string")
    a = rows(B.base_out_state(d), "half_inning", "event_index")
    state, want = 0, []
    for _, half, _, _, e in data[:60]:
        want.append(state)
        state = B.advance(state, e)
    assert [r["base_out_state"] for r in sorted((x for x in a if x["half_inning"] == "top"), key=lambda r: r["event_index"])] == want


def test_opponent_needs_two_teams(spark):
    d = spark.createDataFrame([("1", "a", 3), ("1", "b", 5), ("2", "a", 1)], "gamepk string, team_id string, r int")
    r = rows(J.opponent(d, "gamepk", "team_id", ["r"]), "team_id")
    assert [(x["opp_team_id"], x["opp_r"]) for x in r] == [("b", 5), ("a", 3)]
    assert [x["gamepk"] for x in J.odd_games(d, "gamepk", "team_id").collect()] == ["2"]


def test_unique_lookup_raises(spark):
    left = spark.createDataFrame([("a",)], "k string")
    right = spark.createDataFrame([("a", 1), ("a", 2)], "k string, v int")
    with pytest.raises(Exception, match="not unique"):
        J.unique_lookup(left, right, ["k"]).collect()


def test_impute_and_encode(spark):
    tr = spark.createDataFrame([(1.0, None, "b"), (3.0, None, None), (None, None, "a")], "x double, z double, c string")
    va = spark.createDataFrame([(None, 5.0, "new"), (2.0, None, "a")], "x double, z double, c string")
    a, b = prep.impute_and_encode(tr, va, ["x", "z"], ["c"])
    assert sorted((r["x"], r["z"], r["c"]) for r in a.collect()) == [(1.0, 0.0, 1.0), (2.0, 0.0, 0.0), (3.0, 0.0, 2.0)]
    assert sorted((r["x"], r["z"], r["c"]) for r in b.collect()) == [(2.0, 0.0, 0.0), (2.0, 5.0, -1.0)]
    assert prep.columns_with_nulls(tr, ["x", "z", "c"]) == ["x", "z", "c"]
    with pytest.raises(ValueError):
        prep.split_seasons(tr, [2020], [2020])


def test_transitions(spark):
    d = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "x")], "k string, i int, v string")
    got = {(r["from"], r["to"]): r["n"] for r in Q.transitions(d, ["k"], ["i"], "v").collect()}
    assert got == {("START", "x"): 2, ("x", "y"): 1, ("y", "END"): 1, ("x", "END"): 1}
    assert rows(Q.sequences(d, ["k"], "i", "v"), "k")[0]["sequence"] == ["x", "y"]


def test_finite_and_order(spark):
    d = spark.createDataFrame([(float("nan"),), (float("inf"),), (1.0,)], "x double")
    assert sorted(str(r["x"]) for r in C.finite(d, ["x"]).collect()) == ["1.0", "None", "None"]
    assert close(1.0, 1.0)


def test_model_queries_run_the_whole_job(spark, sf, monkeypatch):
    from harness import q_modelling  # noqa: F401
    from harness.registry import QUERIES
    from lagwell.operators import ml

    class Called(Exception):
        pass

    def called(*given, **more):
        raise Called(more)

    for name in ("boosted", "forest", "permutation_importance"):
        monkeypatch.setattr(ml, name, called)
    for q in ("random_forest", "gbt", "permutation_importance", "tree_importances"):
        with pytest.raises(Called) as found:
            QUERIES[q](spark, sf)
        assert found.value.args == ({},)  # the operator's own trees, rounds, depth and repeats
