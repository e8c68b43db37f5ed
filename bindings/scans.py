"""Scans, payloads, sinks, increments and profiles."""

from pyspark.sql import functions as F

from bindings.base import box, events, featured, labelled, prop_rows, query, r6, spread, table, tagged
from formline.functions import scalars as S
from formline.operators import profile as P
from formline.operators.ordered import dealt
from formline.session import run_dir
from formline.sources import box as B
from formline.sources import increments as I
from formline.sources import odds as O
from formline.sources import sinks as K

def time_forms():
    day, form = F.col("game_date").cast("string"), F.col("game_id") % 3
    return F.when(form == 0, F.concat(day, F.lit(" 19:30:00"))).when(
        form == 1, F.concat(day, F.lit("T19:30:00Z"))
    ).otherwise(day)


def player_csv(spark, sf) -> str:
    """The box rows as a CSV landing, with three timestamp forms."""
    path = run_dir(spark, "players")
    c = F.col
    zero = F.lit(0)
    cols = {
        "personId": c("entity_id"), "gameId": c("game_id"), "firstName": F.lit("Customer"),
        "lastName": F.substring("c_name", 10, 9), "gameDateTimeEst": time_forms(),
        "playerteamCity": F.lit("NATION"), "playerteamName": c("team").cast("string"),
        "opponentteamCity": F.lit("NATION"), "opponentteamName": c("opponent").cast("string"),
        "home": c("home"), "win": c("game_id") % 2, "numMinutes": c("minutes"), "points": c("points"),
        "assists": c("assists"), "blocks": zero, "steals": zero, "reboundsTotal": c("rebounds"),
        "reboundsDefensive": zero, "reboundsOffensive": zero, "foulsPersonal": zero, "turnovers": c("tov"),
        "fieldGoalsAttempted": c("fga"), "fieldGoalsMade": c("fgm"), "fieldGoalsPercentage": zero,
        "threePointersAttempted": c("fg3a"), "threePointersMade": c("threes"), "threePointersPercentage": zero,
        "freeThrowsAttempted": c("fta"), "freeThrowsMade": zero, "freeThrowsPercentage": zero,
        "plusMinusPoints": zero,
    }
    K.sink_csv(box(spark, sf).select(*[v.alias(n) for n, v in cols.items()]), path)
    return path


@query("scan_entity_csv", """SELECT entity_id AS "personId", game_id AS "gameId", game_date,
    CAST(points AS INTEGER) AS points, CAST(minutes AS DOUBLE) AS "numMinutes" FROM q_box""")
def scan_entity_csv(spark, sf):
    rows = B.scan_players(spark, player_csv(spark, sf))
    return rows.select("personId", "gameId", "game_date", "points", "numMinutes")


@query("scan_team_csv", """SELECT CAST(o_orderkey AS BIGINT) AS "gameId", CAST(o_custkey AS BIGINT) AS "teamId",
    CAST(o_orderdate AS DATE) AS game_date, CAST(o_orderkey % 130 AS INTEGER) AS "teamScore" FROM orders""")
def scan_team_csv(spark, sf):
    path = run_dir(spark, "teams")
    c, zero = F.col, F.lit(0)
    o = table(spark, sf, "orders")
    cols = {"gameId": c("o_orderkey"), "teamId": c("o_custkey"), "opponentTeamId": c("o_custkey") + 1,
            "teamCity": F.lit("X"), "teamName": F.lit("Y"), "opponentTeamCity": F.lit("X"), "opponentTeamName": F.lit("Z"),
            "gameDateTimeEst": F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), "home": zero,
            "teamScore": c("o_orderkey") % 130}
    for n in ("opponentScore", "assists", "reboundsTotal", "reboundsOffensive", "fieldGoalsAttempted",
              "freeThrowsAttempted", "threePointersAttempted", "turnovers", "numMinutes"):
        cols[n] = zero
    K.sink_csv(o.select(*[v.alias(n) for n, v in cols.items()]), path)
    return B.scan_teams(spark, path).select("gameId", "teamId", "game_date", "teamScore")


@query("scan_actuals", """SELECT entity_id AS "personId", game_date, CAST(points AS INTEGER) AS points,
    CAST(rebounds AS INTEGER) AS "reboundsTotal", CAST(assists AS INTEGER) AS assists,
    CAST(threes AS INTEGER) AS "threePointersMade" FROM q_box""")
def scan_actuals(spark, sf):
    return B.settling_stats(B.scan_players(spark, player_csv(spark, sf)), ["personId", "game_date"])


@query("scan_multi_csv", """SELECT o_orderkey AS id, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, CAST(NULL AS BIGINT) AS k FROM orders
    UNION ALL SELECT event_id, cents, k FROM q_ev
    UNION ALL SELECT c_custkey, CAST(round(c_acctbal * 100) AS BIGINT), NULL FROM customer""")
def scan_multi_csv(spark, sf):
    """One folder whose files differ in columns and their order, and a second folder with fewer columns."""
    a, b = run_dir(spark, "multi-a"), run_dir(spark, "multi-b")
    orders = table(spark, sf, "orders")
    K.sink_csv(orders.select(F.col("o_orderkey").alias("id"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents")), a)
    K.sink_csv(events(spark, sf).select("k", F.col("event_id").alias("id"), "cents"), f"{b}/one")
    K.sink_csv(table(spark, sf, "customer").select(
        F.round(F.col("c_acctbal") * 100).cast("long").alias("cents"), F.col("c_custkey").alias("id")), f"{b}/two")
    return B.scan_many(spark, [a, f"{b}/*"], ["id long, cents long", "id long, cents long, k long"])


def codes(spark, sf):
    return table(spark, sf, "nation").filter("n_nationkey < 20").select(
        F.col("n_name").alias("name"), F.concat(F.lit("N"), "n_nationkey").alias("code"))


MARKETS = {0: "player_points", 1: "player_rebounds", 2: "player_assists", 3: "player_threes", 4: "spreads", 5: "totals"}


def raw_lines(spark, sf):
    """Every order line as an offered line: book, market, side, point and price."""
    people = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    orders = table(spark, sf, "orders").join(people, F.col("o_custkey") == F.col("c_custkey"))
    rows = dealt(table(spark, sf, "lineitem"), ["l_orderkey"]).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    market = F.col("l_partkey") % 6
    return rows.select(
        F.col("o_orderkey").alias("game_id"), F.to_date("o_orderdate").alias("game_date"),
        F.col("n_name").alias("home_team"), F.concat(F.lit("AWAY_"), F.col("o_custkey") % 30).alias("away_team"),
        F.when(F.col("l_tax") > 0, F.col("c_name")).alias("player_name"),
        S.case_of(market, MARKETS, F.lit(None).cast("string")).alias("market"),
        F.concat(F.lit("book"), F.col("l_suppkey") % 3).alias("book"),
        F.when(F.col("l_linestatus") == "O", "Over").otherwise("Under").alias("side"),
        F.when(F.col("l_discount") > 0, F.col("l_quantity") / 2).alias("line"),
        (F.col("l_linenumber") * 10 - 150).cast("int").alias("odds"),
    )


RAW_SQL = """SELECT o_orderkey AS game_id, CAST(o_orderdate AS DATE) AS game_date, n_name AS home_team,
    'AWAY_' || CAST(o_custkey % 30 AS VARCHAR) AS away_team, CASE WHEN l_tax > 0 THEN c_name END AS player_name,
    CASE l_partkey % 6 """ + " ".join(f"WHEN {k} THEN '{v}'" for k, v in MARKETS.items()) + """ END AS market,
    'book' || CAST(l_suppkey % 3 AS VARCHAR) AS book, CASE WHEN l_linestatus = 'O' THEN 'Over' ELSE 'Under' END AS side,
    CASE WHEN l_discount > 0 THEN l_quantity / 2 END AS line, CAST(l_linenumber * 10 - 150 AS INTEGER) AS odds
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey"""
PROP_OF = """CASE market WHEN 'player_points' THEN 'PTS' WHEN 'player_rebounds' THEN 'REB'
    WHEN 'player_assists' THEN 'AST' WHEN 'player_threes' THEN '3PM' ELSE upper(market) END"""


@query("scan_odds_parquet", f"""SELECT strftime(game_date, '%Y-%m-%d') || '_' || home || '_' || away_team AS join_key,
    player_name AS player, upper(market) AS prop, home AS home_team, away_team, game_date,
    arg_min(line, (book, coalesce(line, -1))) AS line,
    CAST(trunc(avg(odds)) AS INTEGER) AS odds
    FROM (SELECT r.*, CASE WHEN CAST(substr(home_team, 8) AS INTEGER) < 20 THEN 'N' || substr(home_team, 8) ELSE home_team END AS home
          FROM ({RAW_SQL}) r WHERE side = 'Over' AND line IS NOT NULL) GROUP BY ALL""")
def scan_odds_parquet(spark, sf):
    raw = raw_lines(spark, sf).filter("line IS NOT NULL").withColumnRenamed("market", "prop_type")
    return O.stored_odds(raw, codes(spark, sf))


PAYLOAD_MARKETS = ["player_points", "player_rebounds", "player_assists", "player_threes", "player_blocks"]


def payloads(spark, sf):
    """One JSON document per order: two books, five player markets, spread and total, both sides."""
    people = table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey")
    o = spread(table(spark, sf, "orders")).join(people, F.col("o_custkey") == F.col("c_custkey"))
    k = F.col("o_orderkey")
    home, away = F.concat(F.lit("N"), "c_nationkey"), F.concat(F.lit("A"), k % 30)

    def outcome(name, who, point, price):
        return F.struct(name.alias("name"), who.alias("description"), point.cast("double").alias("point"), price.cast("int").alias("price"))

    def book(b: int):
        who = F.when(k % 11 != 0, F.col("c_name"))
        markets = []
        for m, key in enumerate(PAYLOAD_MARKETS):
            point = F.when((k + m) % 7 != 0, (k % 40 + m + b) / 2)
            sides = [outcome(F.lit(s), who, point, (k % 9) * 30 - 130 + b) for s in ("Over", "Under")]
            markets.append(F.struct(F.lit(key).alias("key"), F.array(*sides).alias("outcomes")))
        none = F.lit(None).cast("string")
        spread = [outcome(home, none, -(k % 15) + b, F.lit(-110)), outcome(away, none, k % 15 - b, F.lit(-110))]
        total = [outcome(F.lit("Over"), none, k % 45 + 200 + b, F.lit(-110)), outcome(F.lit("Under"), none, k % 45 + 200 + b, F.lit(-110))]
        markets += [F.struct(F.lit("spreads").alias("key"), F.array(*spread).alias("outcomes")),
                    F.struct(F.lit("totals").alias("key"), F.array(*total).alias("outcomes"))]
        name = F.lit(f"book{b}")
        return F.struct(name.alias("key"), name.alias("title"), F.array(*markets).alias("markets"))

    books = F.when(k % 5 == 0, F.array(book(1))).otherwise(F.array(book(0), book(1)))
    doc = F.struct(k.cast("string").alias("id"), home.alias("home_team"), away.alias("away_team"),
                   F.col("o_orderdate").cast("string").alias("commence_time"), books.alias("bookmakers"))
    return o.select(k.alias("game_id"), F.to_json(doc).alias("payload"))


PAYLOAD_SQL = """SELECT o_orderkey AS game_id, 'book' || b AS book, CASE m WHEN 0 THEN 'PTS' WHEN 1 THEN 'REB' WHEN 2 THEN 'AST' WHEN 3 THEN '3PM' ELSE 'BLOCKS' END AS prop,
    c_name AS player, (o_orderkey % 40 + m + b) / 2.0::DOUBLE AS line, CAST((o_orderkey % 9) * 30 - 130 + b AS INTEGER) AS odds
    FROM orders JOIN customer ON o_custkey = c_custkey, range(2) t(b), range(5) u(m)
    WHERE o_orderkey % 11 <> 0 AND (o_orderkey + m) % 7 <> 0 AND (b = 1 OR o_orderkey % 5 <> 0)"""


@query("flatten_odds_payload", PAYLOAD_SQL)
def flatten_odds_payload(spark, sf):
    rows = O.flatten_odds_payload(O.parse_payload(payloads(spark, sf), "payload"))
    return rows.select("game_id", "book", "prop", "player", "line", "odds")


@query("flatten_one_book", f"SELECT game_id, prop, line FROM ({PAYLOAD_SQL}) WHERE book = 'book0'")
def flatten_one_book(spark, sf):
    rows = O.flatten_odds_payload(O.parse_payload(payloads(spark, sf), "payload"), book="book0")
    return rows.select("game_id", "prop", "line")


@query("flatten_game_lines", """SELECT o_orderkey AS game_id, CAST(abs(-(o_orderkey % 15) + b) AS DOUBLE) AS spread, CAST(o_orderkey % 45 + 200 + b AS DOUBLE) AS total
    FROM (SELECT *, CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS b FROM orders JOIN customer ON o_custkey = c_custkey)""")
def flatten_game_lines(spark, sf):
    return O.flatten_game_lines(O.parse_payload(payloads(spark, sf), "payload")).select("game_id", "spread", "total")


@query("consolidate_lines", f"""SELECT game_id, player_name, market, arg_min(line, (book, line)) AS line,
    CAST(trunc(avg(odds)) AS INTEGER) AS odds FROM ({RAW_SQL}) WHERE line IS NOT NULL GROUP BY ALL""")
def consolidate_lines(spark, sf):
    rows = raw_lines(spark, sf).filter("line IS NOT NULL")
    return O.consolidate_lines(rows, ["game_id", "player_name", "market"], "line", "odds", ["book", "line"])


@query("sink_parquet", """SELECT season, count(*) AS n, CAST(sum(outcome) AS BIGINT) AS overs FROM q_lab GROUP BY season""")
def sink_parquet(spark, sf):
    path = run_dir(spark, "labelled")
    K.sink_parquet(labelled(spark, sf).select("season", "entity_id", "game_id", "prop", "outcome"), path, ["season"])
    return spark.read.parquet(path).groupBy("season").agg(
        F.count(F.lit(1)).alias("n"), F.sum("outcome").alias("overs"))


@query("sink_csv", """SELECT prop, count(*) AS n, round(sum(line), 4) AS line_total FROM q_lab GROUP BY prop""")
def sink_csv(spark, sf):
    path = run_dir(spark, "csv")
    K.sink_csv(labelled(spark, sf).select("prop", "line", "outcome"), path)
    rows = B.read_named(spark, path, "prop string, line double, outcome int")
    return rows.groupBy("prop").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("line"), 4).alias("line_total"))


@query("sink_picks", """SELECT prop AS "Prop", count(*) AS n, round(avg(confidence), 6) AS mean_confidence FROM q_pred
    WHERE confidence >= 2 GROUP BY prop""")
def sink_picks(spark, sf):
    from bindings.base import predicted

    rows = predicted(spark, sf).withColumn("player", F.col("c_name")).withColumn("edge", F.col("p") - 0.5)
    out = K.sink_picks(rows, run_dir(spark, "picks"), high=2)
    back = B.read_named(spark, out["high"], "Prop string, Confidence int")
    return back.groupBy("Prop").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("Confidence"), 6).alias("mean_confidence"))


@query("upsert_by_date", """SELECT event_id, game_date, cents FROM q_ev WHERE team <> 'view' AND game_date NOT IN
    (SELECT game_date FROM q_ev WHERE team = 'view' AND day(game_date) % 3 = 0)
    UNION ALL SELECT event_id, game_date, cents FROM q_ev WHERE team = 'view' AND day(game_date) % 3 = 0""")
def upsert_by_date(spark, sf):
    rows = events(spark, sf).select("event_id", "game_date", "cents", "team")
    new = rows.filter((F.col("team") == "view") & (F.dayofmonth("game_date") % 3 == 0))
    return I.upsert_by_date(rows.filter("team <> 'view'").drop("team"), new.drop("team"), "game_date")


@query("write_dates", """SELECT game_date, count(*) AS n FROM q_ev WHERE (day(game_date) % 2 = 0) = (team = 'view')
    GROUP BY game_date""")
def write_dates(spark, sf):
    """Stored replacement: even days end with the second batch only, odd days keep the first."""
    path = run_dir(spark, "dates")
    rows = events(spark, sf).select("event_id", "game_date", "team")
    I.write_dates(rows.filter("team <> 'view'").drop("team"), path, "game_date")
    second = rows.filter((F.col("team") == "view") & (F.dayofmonth("game_date") % 2 == 0)).drop("team")
    I.write_dates(second, path, "game_date")
    return spark.read.parquet(path).groupBy("game_date").agg(F.count(F.lit(1)).alias("n"))


@query("season_cache", """SELECT season, count(*) AS n FROM q_box WHERE season IN ('1996-97', '1998-99')
    AND game_date BETWEEN DATE '1996-12-01' AND DATE '1998-12-31' GROUP BY season""")
def season_cache(spark, sf):
    """One season stored without its last months, found stale and built again with the other; then a range of days."""
    path = run_dir(spark, "seasons")
    rows = box(spark, sf).select("season", "entity_id", "game_id", "game_date")
    last = rows.filter("season = '1996-97'").agg(F.max("game_date")).first()[0]

    def build(missing):
        return rows.filter(F.col("season").isin(*missing))

    I.season_cache(spark, path, ["1996-97"], lambda missing: build(missing).filter(F.col("game_date") < "1997-01-15"))
    both = I.season_cache(spark, path, ["1996-97", "1998-99"], build, day="game_date",
                          must_have={"1996-97": str(last)} if last else None, between=("1996-12-01", "1998-12-31"))
    return both.groupBy(F.col("season").cast("string").alias("season")).agg(F.count(F.lit(1)).alias("n"))


DAYS_SQL = "SELECT CAST(unnest(generate_series(DATE '1995-01-01', DATE '2001-12-31', INTERVAL 1 DAY)) AS DATE) AS day"


def _days(spark):
    return I.calendar(spark, F.lit("1995-01-01").cast("date"), F.lit("2001-12-31").cast("date"))


def _done(spark, sf):
    return table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.to_date("o_orderdate").alias("day"))


DONE_SQL = "SELECT CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderstatus = 'F'"


@query("pending_dates", f"SELECT day FROM ({DAYS_SQL}) WHERE day NOT IN ({DONE_SQL})")
def pending_dates(spark, sf):
    return I.pending_dates(_days(spark), _done(spark, sf))


@query("next_window", f"""SELECT min(day) AS first_day, CAST(min(day) + 6 AS DATE) AS last_day
    FROM ({DAYS_SQL}) WHERE day NOT IN ({DONE_SQL})""")
def next_window(spark, sf):
    return I.next_window(I.pending_dates(_days(spark), _done(spark, sf)))


@query("mark_dates", f"""SELECT strftime(day, '%Y-%m') AS month, count(*) AS n FROM
    (SELECT day FROM ({DONE_SQL}) UNION SELECT CAST(l_shipdate AS DATE) FROM lineitem) GROUP BY 1""")
def mark_dates(spark, sf):
    new = table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("day"))
    return I.dates_by_month(I.mark_dates(_done(spark, sf), new))


@query("training_sessions", f"""SELECT CAST(0 AS INTEGER) AS position, 'orders' AS session, count(DISTINCT day) AS dates, 'closed' AS kind FROM ({DONE_SQL})
    UNION ALL SELECT 1, 'shipping', count(DISTINCT CAST(l_shipdate AS DATE)), 'lines' FROM lineitem WHERE CAST(l_shipdate AS DATE) NOT IN ({DONE_SQL})""")
def training_sessions(spark, sf):
    """Two sessions stored one after the other; the second marks what the first left."""
    path = run_dir(spark, "sessions")
    I.mark_session(_done(spark, sf), path, "day", "orders", {"kind": "closed"})
    shipped = table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("day"))
    I.mark_session(shipped, path, "day", "shipping", {"kind": "lines"})
    return I.sessions(spark, path).select("position", "session", "dates", F.col("info")["kind"].alias("kind"))


@query("list_dates", "SELECT DISTINCT game_date AS day FROM q_ev")
def list_dates(spark, sf):
    return B.list_dates(events(spark, sf), "game_date")


@query("profile_freshness", """SELECT min(game_date) AS first_day, max(game_date) AS last_day,
    count(DISTINCT game_id) AS games, count(DISTINCT entity_id) AS players,
    count(DISTINCT CASE WHEN game_date >= DATE '2001-01-01' THEN game_id END) AS games_since,
    CAST(DATE '2002-01-01' - max(game_date) AS INTEGER) AS age_days FROM q_box""")
def profile_freshness(spark, sf):
    rows = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("d"), "o_orderkey", "o_custkey")
    return P.profile_freshness(rows, "d", "o_orderkey", "o_custkey", F.lit("2001-01-01").cast("date"),
                               F.lit("2002-01-01").cast("date"))


PROFILE = """count(*) AS records, min(game_date) AS first_day, max(game_date) AS last_day,
    count(DISTINCT game_id) AS games, count(DISTINCT entity_id) AS players, round(avg(outcome), 6) AS over_share FROM q_lab"""


@query("profile_dataset", f"""SELECT 'season ' || season AS scope, {PROFILE} GROUP BY season UNION ALL
    SELECT 'type ' || prop, {PROFILE} GROUP BY prop UNION ALL SELECT 'all', {PROFILE}""")
def profile_dataset(spark, sf):
    rows = P.profile_dataset(labelled(spark, sf), "game_date", "game_id", "entity_id", "season", "prop", "outcome")
    return rows.withColumn("over_share", F.round("over_share", 6))


MISSING = ["points", "minutes", "L5_Avg_PTS", "Season_Avg_PTS", "L10_StdDev_REB"]


@query("profile_missing", " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, round(avg("{c}"), 6) AS mean, round(stddev_samp("{c}"), 6) AS sd,
    round((count(*) - count("{c}")) * 100.0::DOUBLE / count(*), 6) AS missing_pct FROM q_feat""" for c in MISSING))
def profile_missing(spark, sf):
    return P.profile_missing(featured(spark, sf), MISSING).select("feature", *r6("mean", "sd", "missing_pct"))


STAGES = {"over side": "side = 'Over'", "named": "player_name IS NOT NULL", "with line": "line IS NOT NULL",
          "player market": "market LIKE 'player%'"}


@query("funnel_counts", "SELECT CAST(step AS INTEGER) AS step, stage, n, round(n * 100.0::DOUBLE / total, 6) AS retained_pct FROM (" + " UNION ALL ".join(
    f"SELECT {i} AS step, '{n}' AS stage, count(*) FILTER (WHERE {' AND '.join(list(STAGES.values())[:i]) or 'true'}) AS n, count(*) AS total FROM ({RAW_SQL})"
    for i, n in enumerate(["all", *STAGES])) + ")")
def funnel_counts(spark, sf):
    rows = P.funnel_counts(raw_lines(spark, sf), {n: F.expr(c) for n, c in STAGES.items()})
    return rows.withColumn("retained_pct", F.round("retained_pct", 6))


@query("group_counts", """SELECT 'tier' AS dimension, tier AS value, count(*) AS n FROM q_log GROUP BY tier UNION ALL
    SELECT 'prop', prop, count(*) FROM q_log GROUP BY prop UNION ALL
    SELECT 'Reliability_Tag', "Reliability_Tag", count(*) FROM q_log GROUP BY 2""")
def group_counts(spark, sf):
    return P.group_counts(tagged(spark, sf), ["tier", "prop", "Reliability_Tag"])


@query("per_game_counts", """SELECT count(*) AS groups, round(avg(n), 6) AS mean_rows, max(n) AS max_rows FROM
    (SELECT count(*) AS n FROM q_prop GROUP BY game_id)""")
def per_game_counts(spark, sf):
    return P.per_group(prop_rows(spark, sf), "game_id").withColumn("mean_rows", F.round("mean_rows", 6))
