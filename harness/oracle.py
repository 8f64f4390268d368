"""The same derivations as `harness.tables`, as DuckDB common table expressions."""

from __future__ import annotations

from harness.tables import CALLS, CODES, EVENTS, HARDNESS, RESULTS, TRAJECTORIES


def _arr(xs):
    return "[" + ", ".join("NULL" if x is None else "'" + x.replace("'", "''") + "'" for x in xs) + "]"


HOME = "concat('t', (o_orderkey // 4) % 25)"
AWAY = "concat('t', ((o_orderkey // 4) % 25 + 1 + (o_orderkey // 100) % 24) % 25)"
TAX = "CAST(round(l_tax * 100) AS INTEGER)"
DISC = "CAST(round(l_discount * 100) AS INTEGER)"
IN_PLAY = f"{TAX} IN (4, 5)"

CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name, needs, sql):
    CTES[name] = (tuple(needs), sql)


cte("sched_raw", (), f"""
SELECT CAST(o_orderkey // 4 AS VARCHAR) AS gamepk, o_orderdate AS game_datetime, o_orderdate AS game_date,
  CASE o_orderstatus WHEN 'P' THEN 'S' ELSE 'R' END AS game_type,
  CAST(o_custkey % 40 AS VARCHAR) AS venue_id, {HOME} AS home_id, {AWAY} AS away_id,
  o_orderkey AS schedule_row
FROM orders""")

cte("sched", ("sched_raw",), """
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY gamepk ORDER BY game_datetime, schedule_row) AS rn FROM sched_raw)
WHERE rn = 1""")

cte("games", ("sched",), "SELECT gamepk, game_date, game_type, year(game_date) AS game_season FROM sched")

cte("raw0", (), """
SELECT l.*, o.o_orderkey, o.o_custkey, (l_linenumber + 1) // 2 AS play,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity,
    l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS n
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey""")

cte("raw", ("raw0",), f"""
SELECT CAST(o_orderkey // 4 AS VARCHAR) AS gamepk,
  CAST((o_orderkey % 4) * 4 + play AS INTEGER) AS play_id,
  CAST((o_orderkey % 4) * 1000 + n AS INTEGER) AS event_index,
  row_number() OVER (PARTITION BY l_orderkey, play ORDER BY n) AS pitch_number,
  concat('b', o_custkey * 2 + o_orderkey % 2) AS batter_id, concat('Batter ', o_custkey) AS batter_name,
  CASE WHEN o_orderkey % 2 = 1 THEN {HOME} ELSE {AWAY} END AS batter_team_id,
  concat('p', l_suppkey * 2 + o_orderkey % 2) AS pitcher_id, concat('Pitcher ', l_suppkey) AS pitcher_name,
  CASE WHEN o_orderkey % 2 = 1 THEN {AWAY} ELSE {HOME} END AS pitcher_team_id,
  CAST(1 + (o_orderkey % 4) * 2 + l_linenumber // 4 AS INTEGER) AS inning,
  CASE WHEN o_orderkey % 2 = 1 THEN 'bottom' ELSE 'top' END AS half_inning,
  CAST(l_partkey % 4 AS INTEGER) AS post_balls, CAST(l_suppkey % 3 AS INTEGER) AS post_strikes,
  CAST(l_linenumber % 3 AS INTEGER) AS count_outs,
  {_arr(RESULTS)}[CAST(l_quantity % 16 AS INTEGER) + 1] AS play_result,
  {_arr(EVENTS)}[CAST(l_quantity % 16 AS INTEGER) + 1] AS event_type,
  {_arr(CALLS)}[{TAX} + 1] AS pitch_call, {_arr(CODES)}[{DISC} + 1] AS pitch_call_code,
  NOT (l_returnflag = 'A' AND l_linenumber = 7) AS is_pitch,
  {IN_PLAY} AS is_in_play, {TAX} IN (0, 1, 3, 6, 7) AS is_strike, {TAX} IN (2, 8) AS is_ball,
  CAST(nullif(l_partkey % 15, 0) AS INTEGER) AS zone,
  80 + nullif(l_quantity, 50) * 0.4::DOUBLE AS start_speed,
  74 + nullif(l_quantity, 50) * 0.4::DOUBLE - l_tax * 25 AS end_speed,
  5 + l_discount * 20 AS extension, l_extendedprice / 40 AS spin_rate,
  CAST(l_suppkey % 21 - 10 AS DOUBLE) AS pfx_x, CAST(l_partkey % 23 - 11 AS DOUBLE) AS pfx_z,
  CAST(l_partkey % 19 - 9 AS DOUBLE) AS break_horizontal,
  CAST(l_suppkey % 17 - 8 AS DOUBLE) AS break_vertical_induced,
  50 + l_discount * 30 AS release_pos_y,
  (l_partkey % 41 - 20) / 10.0::DOUBLE AS plate_x, (l_partkey % 37) / 10.0::DOUBLE AS plate_z,
  1.5::DOUBLE AS strike_zone_bottom, 3.5::DOUBLE AS strike_zone_top,
  CASE WHEN {IN_PLAY} AND l_partkey % 11 <> 0 THEN 60 + l_quantity END AS launch_speed,
  CASE WHEN {IN_PLAY} THEN CAST(l_partkey % 90 - 30 AS DOUBLE) END AS launch_angle,
  CASE WHEN {IN_PLAY} AND l_partkey % 13 <> 0 THEN {_arr(TRAJECTORIES)}[CAST(l_partkey % 4 AS INTEGER) + 1] END
    AS trajectory,
  CASE WHEN {IN_PLAY} THEN {_arr(HARDNESS)}[CAST(l_suppkey % 3 AS INTEGER) + 1] END AS hardness
FROM raw0""")

cte("players", (), """
SELECT concat('b', c_custkey * 2 + side) AS person_id, concat('Batter ', c_custkey) AS player_name,
  CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'L' WHEN 'MACHINERY' THEN 'L' WHEN 'HOUSEHOLD' THEN 'S' ELSE 'R' END
    AS batSide, 'R' AS pitchHand,
  concat(5 + c_custkey % 2, ''' ', c_custkey % 12, '"') AS height, CAST(160 + c_custkey % 90 AS DOUBLE) AS weight
FROM customer, (VALUES (0), (1)) v(side)
UNION ALL
SELECT concat('p', s_suppkey * 2 + side), concat('Pitcher ', s_suppkey), 'R',
  CASE WHEN s_nationkey % 5 IN (0, 1) THEN 'L' WHEN s_nationkey % 5 = 4 THEN 'S' ELSE 'R' END,
  concat(6, ''' ', s_suppkey % 12, '"'), CAST(170 + s_suppkey % 80 AS DOUBLE)
FROM supplier, (VALUES (0), (1)) v(side)""")

cte("info", (), """
SELECT CAST(o_orderkey // 4 AS VARCHAR) AS gamepk, o_orderkey AS info_row,
  CAST(year(o_orderdate) AS INTEGER) AS game_season, CASE o_custkey % 4 WHEN 0 THEN 'Clear' WHEN 1 THEN 'Cloudy' WHEN 2 THEN 'Dome' END AS weather_condition,
  CASE WHEN o_custkey % 7 = 0 THEN 'n/a' ELSE concat(40 + o_custkey % 60, ' F') END AS weather_temp,
  CASE WHEN o_custkey % 5 = 0 THEN 'Calm'
       ELSE concat(o_custkey % 20, ' mph, Out To ', o_orderstatus, 'F') END AS weather_wind
FROM orders WHERE o_orderstatus <> 'P'""")

cte("starter_by_play", ("raw",), """
SELECT gamepk, pitcher_team_id, arg_min(pitcher_id, play_id * 100000 + event_index) AS starter_id
FROM raw GROUP BY ALL""")

cte("starters", ("raw",), """
SELECT gamepk, pitcher_team_id AS team_id, arg_min(pitcher_id, inning * 100000 + event_index) AS starter_id,
  arg_min(pitcher_name, inning * 100000 + event_index) AS starter_name
FROM raw GROUP BY gamepk, pitcher_team_id""")

cte("pa_numbers", ("raw",), """
SELECT gamepk, play_id, batter_id,
  row_number() OVER (PARTITION BY gamepk, batter_id ORDER BY play_id) AS batter_pa_number
FROM (SELECT DISTINCT gamepk, play_id, batter_id FROM raw)""")

cte("pbp", ("raw", "sched", "players", "starter_by_play", "pa_numbers"), """
SELECT a.*, coalesce(count_balls = 0 AND count_strikes = 0, false) AS is_first_pitch,
  concat(CAST(CAST(count_balls AS DOUBLE) AS VARCHAR), '-', CAST(CAST(count_strikes AS DOUBLE) AS VARCHAR)) AS count_state,
  is_swing AND coalesce(zone IN (11, 12, 13, 14), false) AS is_chase,
  is_swing AND coalesce(zone BETWEEN 1 AND 9, false) AS is_zone_swing,
  CASE WHEN a.pitcher_id = st.starter_id THEN 'sp' ELSE 'bullpen' END AS pitcher_role,
  n.batter_pa_number, s.game_date, CAST(year(s.game_date) AS INTEGER) AS game_season,
  ph.pitchHand AS pitcher_throw_hand, bh.batSide AS batter_bat_side
FROM (
  SELECT *, CASE WHEN play_result IN ('Single','Double','Triple','Home Run') THEN 1 ELSE 0 END AS is_hit,
    end_speed / start_speed AS speed_retention, start_speed * (60.5 / (60.5 - extension)) AS perceived_velo,
    pitch_call IN ('Swinging Strike','Swinging Strike (Blocked)','Missed Bunt') AS is_swinging_strike,
    pitch_call = 'Called Strike' AS is_called_strike,
    pitch_call IN ('Swinging Strike','Swinging Strike (Blocked)','Missed Bunt','Foul','Foul Tip','Foul Bunt')
      OR is_in_play AS is_swing,
    (plate_z - strike_zone_bottom) / (strike_zone_top - strike_zone_bottom) AS plate_z_normalized,
    sqrt(pfx_x * pfx_x + pfx_z * pfx_z) AS movement_magnitude,
    CASE WHEN pitch_number = 1 THEN 0 ELSE lag(post_balls) OVER pa END AS count_balls,
    CASE WHEN pitch_number = 1 THEN 0 ELSE lag(post_strikes) OVER pa END AS count_strikes,
    pitch_number = max(pitch_number) OVER (PARTITION BY gamepk, play_id) AS is_last_pitch
  FROM raw WINDOW pa AS (PARTITION BY gamepk, play_id ORDER BY event_index)) a
LEFT JOIN starter_by_play st ON a.gamepk = st.gamepk AND a.pitcher_team_id = st.pitcher_team_id
LEFT JOIN pa_numbers n ON a.gamepk = n.gamepk AND a.play_id = n.play_id AND a.batter_id = n.batter_id
LEFT JOIN sched s ON a.gamepk = s.gamepk
LEFT JOIN players ph ON a.pitcher_id = ph.person_id
LEFT JOIN players bh ON a.batter_id = bh.person_id""")

cte("batter_box", ("raw", "games"), """
SELECT b.*, g.* EXCLUDE (gamepk) FROM (
  SELECT *, total_bases_from_h + bb + sb AS total_bases,
    CAST(3*singles + 5*doubles + 8*triples + 10*hr + 2*bb AS DOUBLE) AS fantasy_points,
    CASE WHEN slot % 100 = 0 THEN NULL ELSE CAST(slot AS VARCHAR) END AS batting_order
  FROM (
    SELECT *, singles + 2*doubles + 3*triples + 4*hr AS total_bases_from_h FROM (
      SELECT gamepk, batter_id AS personId, batter_team_id AS team_id, batter_name AS player_name,
        count(*) AS plate_appearances,
        count(*) FILTER (play_result IS NULL OR play_result NOT IN ('Walk','Hit By Pitch','Sac Fly')) AS ab,
        count(*) FILTER (play_result IN ('Single','Double','Triple','Home Run')) AS h,
        count(*) FILTER (play_result = 'Single') AS singles, count(*) FILTER (play_result = 'Double') AS doubles,
        count(*) FILTER (play_result = 'Triple') AS triples, count(*) FILTER (play_result = 'Home Run') AS hr,
        count(*) FILTER (play_result = 'Walk') AS bb,
        count(*) FILTER (play_result IN ('Strikeout','Strikeout Double Play')) AS k,
        count(*) FILTER (play_result IN ('Home Run','Sac Fly')) AS rbi,
        count(*) FILTER (play_result IN ('Home Run','Triple')) AS r,
        count(*) FILTER (count_outs = 2 AND play_result = 'Single') AS lob,
        count(*) FILTER (post_strikes = 2 AND play_result = 'Walk') AS sb,
        count(*) FILTER (play_result = 'Hit By Pitch') AS hbp,
        max(play_id % 9 * 100 + play_id % 2) AS slot
      FROM raw GROUP BY ALL))) b
LEFT JOIN games g ON b.gamepk = g.gamepk""")

cte("pitcher_box", ("raw", "games"), """
SELECT p.* EXCLUDE (o), (o // 3) + (o % 3) / 10.0::DOUBLE AS ip, g.* EXCLUDE (gamepk) FROM (
  SELECT gamepk, pitcher_id AS personId, pitcher_team_id AS team_id, pitcher_name AS player_name,
    count(*) FILTER (play_result IN ('Strikeout','Groundout','Flyout','Lineout','Sac Fly','Pop Out',
      'Strikeout Double Play')) AS o,
    count(*) FILTER (play_result IN ('Single','Double','Triple','Home Run')) AS h,
    count(*) FILTER (play_result IN ('Home Run','Triple')) AS r,
    count(*) FILTER (play_result = 'Home Run') AS er, count(*) FILTER (play_result = 'Walk') AS bb,
    count(*) FILTER (play_result IN ('Strikeout','Strikeout Double Play')) AS k,
    count(*) FILTER (play_result = 'Home Run') AS hr, count(*) AS p, count(*) FILTER (is_strike) AS s
  FROM raw GROUP BY ALL) p
LEFT JOIN games g ON p.gamepk = g.gamepk""")

# the innings notation made decimal, and pitchers tagged by role
cte("pitcher_ip", ("pitcher_box",), """
SELECT *, floor(ip) + (round_even((ip - floor(ip)) * 10, 0) / 10) / 0.3 AS ip_true FROM pitcher_box""")
cte("roles", ("pbp",), """
SELECT DISTINCT gamepk, pitcher_id AS personId, pitcher_role FROM pbp""")
# predictions: one per line item
cte("preds", (), """
SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, l_returnflag, l_linestatus, l_shipdate,
  CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y,
  least(greatest(round(l_discount * 8 + 0.1 + (l_partkey % 7) * 0.01, 4), 0.01), 0.99) AS p
FROM lineitem""")


def oracle(body: str, *needs: str, keep: list[str], exact: bool = False) -> str:
    """Prefix the derivations a query needs and round every column not kept as it is."""
    order: list[str] = []

    def visit(n):
        for dep in CTES[n][0]:
            visit(dep)
        if n not in order:
            order.append(n)

    for n in needs:
        visit(n)
    parts = [f"{n} AS ({CTES[n][1]})" for n in order] + [f"res AS ({body})"]
    kept = ", ".join(f'"{k}"' for k in keep)
    head = "WITH " + ",\n".join(parts) + "\nSELECT "
    if exact:
        return head + kept + "\nFROM res"
    # the offset settles exact ties of the last place, which sums in another order would flip
    rest = f"COLUMNS(* EXCLUDE ({kept}))" if keep else "COLUMNS(*)"
    first = kept + ", " if keep else ""
    return head + f"{first}round(CAST({rest} AS DOUBLE) + 1e-9, 6) + 0.0\nFROM res"
