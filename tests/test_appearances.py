"""One pass over a game's pitches: partials that merge, half innings without a key, season frames, dropped rows, plan size."""

import re

import pytest
from conftest import rows
from pyspark.sql import functions as F

from lagwell.operators import appearances as P
from lagwell.operators import starter_pa as A
from lagwell.operators.base_out import base_out_state

DDL = ("gamepk string, play_id int, event_index int, pitch_number int, batter_id string, pitcher_id string, pitcher_team_id string, batter_team_id string, inning int, "
       "half_inning string, count_balls int, count_strikes int, play_result string, event_type string, pitch_call_code string, is_pitch boolean, is_in_play boolean, zone int, "
       "start_speed double, spin_rate double, release_pos_y double, break_horizontal double, break_vertical_induced double, launch_speed double, launch_angle double, trajectory string")


def pitch(i, play, pitcher, batter="b1", result=None, code="B", game="g", team="T", inning=1, pitch=True, balls=0, strikes=0, event=None, speed=90.0, half="top", zone=5):
    return (game, play, i, 1, batter, pitcher, team, "O", inning, half, balls, strikes, result, event, code, pitch, code == "X", zone, speed, 2000.0, 55.0, 1.0, 2.0, 99.0 if code == "X" else None, 28.0, None)


@pytest.fixture(scope="module")
def pbp(spark):
    return spark.createDataFrame([
        pitch(1, 1, "p1", code="S", balls=0, strikes=1), pitch(2, 1, "p1", code="S", strikes=2), pitch(3, 1, "p1", result="Strikeout", code="S", strikes=3, event="strikeout"),
        pitch(4, 2, "p1", "b2", code="C", strikes=1), pitch(5, 2, "p1", "b2", code="X", result="Double", event="double", speed=92.0),
        pitch(6, 3, "p1", "b1", pitch=False), pitch(7, 3, "p2", "b1", result="Walk", event="walk", code="B", inning=4),  # relieved within the play
        pitch(8, 4, "p2", "b3", result="Single", event="single", code="X", inning=None), pitch(9, 1, "x", game=None), pitch(10, 5, "p1", "b1", result="Single", code="X", inning=5, half=None, event="single"),
    ], DDL)


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame([("p1", "R", "S"), ("p2", "R", "L"), ("b1", "S", "R"), ("b2", "L", "R")], "personId string, batSide string, pitchHand string")


def test_measures_of_pitchers_and_batters(spark, pbp, people):
    parts = P.play_partials(P.events(pbp, people))
    m = {r["pitcher_id"]: r for r in rows(P.pitcher_measures(parts.repartition(5)))}
    assert set(m) == {"p1", "p2"} and m["p1"]["is_starter"] and not m["p2"]["is_starter"]
    one = m["p1"]
    assert (one["total_pitches"], one["pa_count"], one["whiff_rate"], one["avg_velo"]) == (6, 3, 3 / 5, pytest.approx((90 * 5 + 92) / 6))
    # b1 bats left against p1, a switch pitcher who counts as right; b2 is left
    assert (one["pa_count_vs_L"], one["pa_count_vs_R"], one["obp_allowed_vs_L"], one["obp_allowed"]) == (3.0, None, 2 / 3, 2 / 3)
    assert (one["inn45_pitches"], one["inn45_pa"], one["inn45_onbase"]) == (1, 1, 1) and one["contact_exit_velo"] == 99.0
    assert (m["p2"]["inn45_pa"], m["p2"]["two_strike_whiff_pct"], m["p2"]["contact_exit_velo"]) == (1, 0.0, None)
    assert one["two_strike_whiff_pct"] == 1.0  # the third strike, on a count of two
    b = {r["batter_id"]: r for r in rows(P.batter_measures(parts))}
    assert (b["b1"]["pitches_seen"], b["b1"]["pa_count_vs_R"], b["b1"]["pa_count_vs_L"], b["b1"]["k_rate_vs_R"]) == (5, 2.0, 1.0, 0.5)
    assert b["b3"]["obp_per_game"] == 1.0 and b["b2"]["iso_vs_R"] == 1.0


def test_appearances_of_starters(pbp, people):
    pa = {r["play_id"]: r for r in rows(P.appearances(P.events(pbp, people)))}
    assert set(pa) == {1, 2, 5}  # p2 ends plays 3 and 4
    assert [pa[k]["pitch_count_in_game"] for k in (1, 2, 5)] == [0, 3, 5] and [pa[k]["times_through_order"] for k in (1, 2, 5)] == [1, 1, 2]
    assert [pa[k]["target_bases"] for k in (1, 2, 5)] == [0, 2, 1] and [pa[k]["platoon_advantage"] for k in (1, 2, 5)] == [1, 1, 1]


def test_states_of_half_innings_without_a_key_are_null_and_rows_stay(pbp, people):
    pa = P.appearances(P.events(pbp, people))
    got = {r["play_id"]: (r["base_out_state"], r["outs_when_up"]) for r in rows(base_out_state(pa.unionByName(pa.filter("half_inning IS NULL"))))}
    assert got == {1: (0, 0), 2: (8, 1), 5: (None, None)}
    assert base_out_state(pa.unionByName(pa.filter("half_inning IS NULL"))).count() == 4


def test_career_means_over_season_frames(spark):
    d = spark.createDataFrame([("a", 2020, 1.0), ("a", 2020, 3.0), ("a", 2021, 5.0), ("a", 2023, 8.0), ("a", None, 99.0), (None, 2020, 99.0), ("b", 2021, None)], "personId string, game_season int, x double")
    got = {(r["personId"], r["game_season"]): r["c_3yr_wtd_x"] for r in A.career_weighted(d, ["x"], "c_").collect()}
    assert got == {("a", 2020): 2.0, ("a", 2021): pytest.approx((5 * 3 + 2 * 2) / 5), ("a", 2023): pytest.approx((8 * 3 + 5) / 4), ("b", 2021): None}
    strict = {(r["personId"], r["game_season"]): r["c_3yr_wtd_x"] for r in A.career_weighted(d, ["x"], "c_", mode="strict").collect()}
    assert strict == {("a", 2020): None, ("a", 2021): 2.0, ("a", 2023): 5.0, ("b", 2021): None}
    with pytest.raises(ValueError):
        A.career_weighted(d, ["x"], "c_", mode="other")


def test_dropped_report_counts_parts_and_columns(spark):
    d = spark.createDataFrame([(2020, "2020-04-01", "p", 1.0, None), (2020, "2020-05-01", "p", 1.0, 2.0), (2021, "2021-04-01", "q", None, None), (None, None, "r", 1.0, None)],
                              "game_season int, game_date string, pitcher_id string, a double, b double")
    got = {(r["part"], r["key"]): (r["dropped"], r["rows"]) for r in A.dropped_report(d, ["a", "b"], top=2).collect()}
    assert got == {("season", "2020"): (1, 2), ("season", "2021"): (1, 1), ("season", None): (1, 1), ("month", "4"): (2, 2), ("month", "5"): (0, 1), ("month", None): (1, 1),
                   ("pitcher", "p"): (1, 2), ("pitcher", "q"): (1, 1), ("column", "a"): (1, 4), ("column", "b"): (3, 4)}


def test_the_whole_frame_needs_few_exchanges(spark, sf, monkeypatch):
    from harness import q_starters as H
    plans, real = [], A.stage
    monkeypatch.setattr(A, "stage", lambda d: plans.append(d) or real(d))
    frame = H._starter_frame(spark, sf, False)
    exchanges = sum(len(re.findall(r"\bExchange ", d._jdf.queryExecution().executedPlan().toString())) for d in [*plans, frame])
    assert exchanges <= 30
    assert frame.groupBy("gamepk", "play_id").count().filter("count > 1").count() == 0
    assert frame.filter(F.col("opp_team_ytd_obp").isNotNull()).count() > 0
