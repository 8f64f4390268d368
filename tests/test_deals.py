"""Plans of the pitch-level queries: how often pitches are dealt out anew."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


@pytest.fixture
def exchanges(spark):
    """Number of exchanges of a query's plan when nothing is small enough to be broadcast."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield lambda name: len(re.findall(r"Exchange (?:hash|range|single)", entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString(), re.I))
    spark.conf.set(key, before)


def test_pitch_table_deals_pitches_once(exchanges):
    # pitches, orders of a game, ids and the sides they meet, sides of a game, schedule; ids read pitches and orders again
    assert exchanges("pitch_table") <= 9


def test_season_roles_take_one_pass(exchanges):
    # pitches, orders of a game, schedule, season
    assert exchanges("season_pitch_roles") <= 5


def test_role_lines_take_one_pass(exchanges):
    # pitches and orders of a game for lines and for roles, schedule of the lines, the rolled lines; two passes more before
    assert exchanges("rolling_role_collapsed") <= 7
    # the same, with seasons instead of rolled lines
    assert exchanges("season_role_stacked") <= 7


def test_bullpen_lines_stay_where_their_game_was_dealt(exchanges):
    # pitches and orders of a game for lines and for starters, schedule; lines, starters and what is left of them were dealt anew before
    assert exchanges("bullpen_game_totals") <= 5


def test_starter_series_deals_lines_by_starter_alone(spark):
    from lagwell.operators.team_runs import starter_series
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    box = spark.createDataFrame([("g", "t", "a", 2019, 1.0, 1, 1, 1, 1, 1)],
                                "gamepk string, team_id string, personId string, game_season int, ip_true double, h int, er int, bb int, k int, hr int")
    box = box.withColumn("game_date", F.expr("timestamp_ntz'2019-04-01 00:00:00'")).repartition(3, "gamepk")
    plan = starter_series(box)._jdf.queryExecution().executedPlan().toString()
    spark.conf.set(key, before)
    # lines and starters by game, the starters' lines by person; both were dealt by game, team and person before
    assert not re.search(r"hashpartitioning\(gamepk#\d+L?, team_id#\d+L?, personId", plan)


def test_lines_without_a_team_are_relievers_and_starters_drop_out(spark):
    from lagwell.operators.base_features import bullpen_games
    box = spark.createDataFrame([("g", t, p, 2019, 1.0, 1, 1, 1, 1, 1) for t, p in (("t1", "a"), ("t1", "b"), ("t2", "a"), (None, "c"))],
                                "gamepk string, team_id string, personId string, game_season int, ip double, h int, er int, bb int, k int, hr int")
    box = box.withColumn("game_date", F.expr("timestamp_ntz'2019-04-01 00:00:00'"))
    st = spark.createDataFrame([("g", "t1", "a", "A")], "gamepk string, team_id string, starter_id string, starter_name string")
    got = {r.team_id: (r.bp_pitchers, r.bp_h_sum) for r in bullpen_games(box, st).collect()}
    assert got == {"t1": (1, 1.0), "t2": (1, 1.0), None: (1, 1.0)}


def test_tagged_lines_keep_every_role(spark):
    from lagwell.operators.season import role_lines, tag_roles
    box = spark.createDataFrame([("1", "a", "x", 2023, 4), ("1", "b", "x", 2023, 1), ("1", "c", "x", 2023, 2), ("1", "d", "x", 2023, 8), (None, "a", "x", 2023, 16)],
                                "gamepk string, personId string, team_id string, game_season int, h long").selectExpr("*", "DATE'2023-04-01' AS game_date")
    pbp = spark.createDataFrame([("1", "a", "sp"), ("1", "b", "bullpen"), ("1", "c", "bullpen"), ("1", "c", "bullpen"), ("1", "a", "bullpen")],
                                "gamepk string, pitcher_id string, pitcher_role string")
    tagged = tag_roles(box, pbp)
    assert sorted((r.personId, str(r.pitcher_role)) for r in tagged.collect()) == [
        ("a", "None"), ("a", "bullpen"), ("a", "sp"), ("b", "bullpen"), ("c", "bullpen"), ("d", "None")]
    got = sorted((r.pitcher_key_id, r.pitcher_role, r.h) for r in role_lines(tagged, ["h"]).collect())
    assert got == [("a", "sp", 4), ("x", "bullpen", 7)]


def test_registry_filled_in_part_is_loaded_whole():
    import subprocess
    import sys
    code = "import harness.q_starters, __spark_entry__ as e; assert len(e.queries()) > 150 and set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=entry.__file__.rsplit("/", 1)[0])


def test_model_frame_is_never_dealt_anew(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    plan = entry.queries()["model_frame"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    spark.conf.set(key, before)
    # five lookups and the lineup code meet the appearances by game alone; before, three joins were by season and six by further keys
    assert len(re.findall(r"SortMergeJoin \[gamepk#\d+\], \[_r_gamepk#\d+\]", plan)) >= 5


def test_in_game_joins_like_a_plain_join(spark):
    from lagwell.operators.joins import in_game
    a = spark.createDataFrame([("1", "x", 1), ("1", "y", 2), ("1", None, 3), (None, "x", 4), ("2", "x", 5)], "gamepk string, k string, v int")
    b = spark.createDataFrame([("1", "x", 10), ("1", "x", 11), ("2", "y", 12), (None, "x", 13)], "gamepk string, k string, w int")
    for how in ("left", "inner"):
        got = in_game(a.repartition(3, "gamepk"), b.repartition(3, "gamepk"), ["k"], how)
        assert sorted(map(str, got.select("v", "w").collect())) == sorted(map(str, a.join(b, ["gamepk", "k"], how).select("v", "w").collect()))


def test_two_windows_are_the_same_as_one_by_one(spark):
    from lagwell.operators.rolling import batter_box_rolling
    cols = ["h", "k", "bb", "hr", "ab", "plate_appearances", "total_bases_from_h"]
    box = spark.range(40).selectExpr("concat('b', id % 3) AS personId", "CAST(id AS STRING) AS gamepk", "date_add(DATE'2023-04-01', CAST(id AS INT)) AS game_date",
                                     "CAST(2023 + id DIV 20 AS INT) AS game_season", *[f"nullif((id * {i + 3}) % 7, 2) AS {c}" for i, c in enumerate(cols)])
    key = ["personId", "gamepk", "game_date", "game_season"]
    both, one, two = batter_box_rolling(box, ["season", 10]), batter_box_rolling(box, "season"), batter_box_rolling(box, 10)
    apart = one.join(two, key).select(both.columns)
    assert sorted(map(str, both.collect())) == sorted(map(str, apart.collect())) and both.count() == 40


def test_tidy_rounds_as_the_oracle_does_and_whole_numbers_are_not_rounded(spark):
    from harness.registry import tidy
    xs = [0.0, -0.0, 0.5, 1 / 3, -2 / 3, 0.0000005, -0.0000005, 1.0000015, 95.4, -17.25, 999999.9999995, 1e6, 1234567.1234565, 1e15, 3e300,
          float("nan"), float("inf"), float("-inf"), None]
    d = spark.createDataFrame([(i, x, i - 9, i % 2 == 0) for i, x in enumerate(xs)], "id int, x double, n long, b boolean")
    out = tidy(d, ["id"])
    assert "round(" not in "".join(out.select("n", "b")._jdf.queryExecution().optimizedPlan().toString())
    for r in out.collect():
        x, want = xs[r.id], d.selectExpr("round(x + 1e-9D, 6) + 0D AS w", "id").filter(F.col("id") == r.id).first().w
        assert (r.x is None and want is None) or r.x == want or (r.x != r.x and want != want), x
        assert r.n == float(r.id - 9) and r.b == float(r.id % 2 == 0)


def test_registered_queries_keep_generated_methods_short_enough_for_the_jvm(spark):
    from harness.registry import QUERIES, load
    from lagwell.plans.scale import short_methods
    load()
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "65535")
    QUERIES["lagged_count"](spark, "/root/testdata/sf0.001")
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "4000")
    assert short_methods(spark).conf.get("spark.sql.codegen.hugeMethodLimit") == "4000"
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")


def test_state_machine_looks_no_hands_up(exchanges):
    # pitches and orders of a game; pitches were dealt by batter, by pitcher and by game again before
    assert exchanges("state_machine") <= 2


def test_starters_measures_leave_relievers_out(exchanges):
    # pitches and orders of a game for measures and for lines, schedule of the lines, lines and measures by game and person, windows
    assert exchanges("pitcher_windows") <= 8


def test_base_out_state_is_read_without_the_other_columns(spark):
    from lagwell.operators.base_out import base_out_state
    pa = spark.createDataFrame([("g", "top", 1, i, e, "x") for i, e in enumerate(("walk", None, "single", "home_run"))] + [("g", None, 1, 9, "walk", "x")],
                               "gamepk string, half_inning string, inning int, event_index int, event_type string, other string")
    out = base_out_state(pa)
    assert {r.event_index: r.base_out_state for r in out.collect()} == {0: 0, 1: 1, 2: 1, 3: 3, 9: None}
    # rows stay as they are: no list of whole rows is gathered
    assert "other" not in "".join(x for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "collect_list" in x)


def test_starter_events_keep_a_starters_measures(spark):
    from lagwell.operators import appearances as P
    schema = ("gamepk string, play_id int, event_index int, pitch_number int, batter_id string, pitcher_id string, pitcher_team_id string, inning int, count_balls int, "
              "count_strikes int, play_result string, pitch_call_code string, is_pitch boolean, is_in_play boolean, zone int, launch_speed double, launch_angle double, "
              "trajectory string, start_speed double, spin_rate double, release_pos_y double, break_horizontal double, break_vertical_induced double")
    rows = [("g", i, i, 1, "b", p, "t", 1 + i // 3, i % 4, i % 3, "Single", "C", True, False, 5, None, None, None, 90.0 + i, 2000.0, 50.0, 1.0, 2.0)
            for i, p in enumerate(("a", "a", "b", "b", "a"))]
    pbp = spark.createDataFrame(rows, schema)
    whole = P.pitcher_measures(P.play_partials(P.events(pbp))).filter("is_starter").collect()
    assert P.pitcher_measures(P.play_partials(P.events(pbp, only="starters")), dealt=True).collect() == whole and len(whole) == 1
    people = spark.createDataFrame([("a", "L", "S"), ("b", "S", "L")], "personId string, batSide string, pitchHand string")
    whole, faced = ([r.asDict() for r in P.appearances(*x).orderBy("play_id").collect()] for x in ((P.events(pbp, people),), (P.events(pbp, only="faced"), people)))
    assert faced == whole and len(whole) == 3 and whole[0]["platoon_advantage"] == 1


def test_seasons_of_games_are_the_same_as_seasons_of_pitches(spark):
    from harness import tables as t
    from lagwell.operators import partials as P
    from lagwell.operators import season as S
    from conftest import close, rows
    pbp = t.pitches(spark, SF).cache()
    games = P.pitcher_games(S.with_role_key(pbp, "pitcher_id", "pitcher_team_id"), S.ROLE_KEY)
    got, want = (rows(d, *S.ROLE_KEY, "game_season") for d in (S.pitcher_season_of_games(games), S.pitcher_season_roles(pbp)))
    pbp.unpersist()
    assert len(got) == len(want) > 0 and set(got[0]) == set(want[0])
    assert all(close(a[c], b[c]) for a, b in zip(got, want) for c in b)


def test_windows_of_games_are_dealt_once(spark):
    from lagwell.operators.rolling import batter_box_rolling
    cols = ["h", "k", "bb", "hr", "ab", "plate_appearances", "total_bases_from_h"]
    box = spark.range(40).selectExpr("concat('b', id % 3) AS personId", "CAST(id AS STRING) AS gamepk", "date_add(DATE'2023-04-01', CAST(id AS INT)) AS game_date",
                                     "CAST(2023 + id DIV 20 AS INT) AS game_season", "id % 2 = 0 AS _met", *[f"nullif((id * {i + 3}) % 7, 2) AS {c}" for i, c in enumerate(cols)])
    once, plain = batter_box_rolling(box, ["season", 10], ["_met"], 5), batter_box_rolling(box, ["season", 10])
    # by batter, and by batter and season before
    assert len(re.findall(r"Exchange hash", once._jdf.queryExecution().executedPlan().toString())) == 1
    assert sorted(map(str, once.drop("_met").collect())) == sorted(map(str, plain.collect())) and once.filter("_met").count() == 20


def test_model_frame_stages_only_games_that_are_asked_for(spark):
    plan = entry.queries()["model_frame"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    # lookups of batters, of pitchers' lines and of their pitches; whole tables travelled to the games before
    assert len(re.findall(r"Filter .*_met#", plan)) >= 3


def test_starter_frame_is_never_dealt_anew(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    plan = entry.queries()["starter_pa_frame"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    spark.conf.set(key, before)
    # pitchers and batters meet the appearances in their game; the frame was dealt by game and pitcher, by game and batter and by season
    # before. What is left by game and batter is the teams' discipline.
    assert not re.search(r"SortMergeJoin \[(gamepk#\d+, pitcher_id#\d+|game_season#\d+)\]", plan)
    assert len(re.findall(r"SortMergeJoin \[gamepk#\d+, batter_id#\d+\]", plan)) <= 1
    assert len(re.findall(r"Filter .*_met#", plan)) >= 2


def test_events_of_starters_and_of_faced_plays_hold_both(spark):
    from harness import tables as t
    from harness.q_starters import _people
    from lagwell.operators import appearances as P
    from conftest import close, rows
    # a pitcher who starts for one team and relieves for the other in a play that no starter of it threw in
    raw = t.pitches_raw(spark, SF).filter("CAST(gamepk AS INT) < 60").cache()
    odd = raw.filter("gamepk = '1'").selectExpr("* EXCEPT (pitcher_id, pitcher_team_id)", "'both' AS pitcher_id", "CASE WHEN inning > 4 THEN 'z' ELSE pitcher_team_id END AS pitcher_team_id")
    first = odd.limit(1).selectExpr("* EXCEPT (pitcher_id, pitcher_team_id, inning, event_index, play_id)", "'other' AS pitcher_id", "'z' AS pitcher_team_id",
                                    "0 AS inning", "-1 AS event_index", "99 AS play_id")
    raw = raw.filter("gamepk <> '1'").unionByName(odd).unionByName(first).repartition(3, "gamepk").cache()
    people = _people(spark, SF)
    kept = P.events(raw, dealt=True, only="either")
    got = P.pitcher_measures(P.play_partials(P.with_hands(kept.filter("_theirs"), people)))
    want = P.pitcher_measures(P.play_partials(P.events(raw, people))).filter("is_starter")
    got, want = rows(got, "gamepk", "pitcher_id"), rows(want, "gamepk", "pitcher_id")
    assert len(got) == len(want) > 100 and all(close(a[c], b[c]) for a, b in zip(got, want) for c in b)
    got, want = (rows(P.appearances(e, people), "gamepk", "play_id") for e in (kept, P.events(raw)))
    assert got == [{c: r[c] for c in got[0]} for r in want] and len(got) > 30
    # hands that travel as ids of a game
    got, want = (rows(P.batter_measures(P.play_partials(e)), "gamepk", "batter_id") for e in (P.events(raw, people, dealt=3), P.events(raw, people)))
    assert len(got) == len(want) and all(close(a[c], b[c]) for a, b in zip(got, want) for c in b)
    raw.unpersist()


def test_rolling_pitches_travel_before_they_are_summed_per_game(spark):
    from harness import tables as t
    plan = entry.queries()["rolling_pbp"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    # wide sums of a pitcher's game, of which most pitches here have their own, travelled before
    assert plan.index("HashAggregate(keys=[pitcher_id") < plan.index("Exchange hashpartitioning(pitcher_id")
    assert len(re.findall(r"Exchange hashpartitioning\(pitcher_id", plan)) == 1
    by, plain = t.pitches(spark, SF, "pitcher_id"), t.pitches(spark, SF)
    assert set(by.columns) == set(plain.columns)
    assert sorted(map(str, by.select(plain.columns).collect())) == sorted(map(str, plain.collect()))
