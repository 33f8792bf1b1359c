"""Queries on boards, which are made from lineitem: 50 orders a board, places and colours from keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayline.functions.vectors import r6
from wayline.operators import boards
from wayline.plans import views
from wayline.plans.registry import query
from wayline.plans.views import table

BOARDS_SQL = """SELECT board_id, r, c, stone FROM (SELECT l_orderkey // 50 AS board_id, CAST(l_partkey % 19 AS INTEGER) AS r, CAST((l_suppkey * 7 + l_linenumber) % 19 AS INTEGER) AS c, CAST(1 + l_linenumber % 2 AS INTEGER) AS stone,
    row_number() OVER (PARTITION BY l_orderkey // 50, l_partkey % 19, (l_suppkey * 7 + l_linenumber) % 19 ORDER BY l_orderkey, l_linenumber) AS k FROM lineitem) WHERE k = 1"""


def stones(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "lineitem").select(F.expr("l_orderkey div 50").alias("board_id"), (F.col("l_partkey") % 19).cast("int").alias("r"), ((F.col("l_suppkey") * 7 + F.col("l_linenumber")) % 19).cast("int").alias("c"), F.struct("l_orderkey", "l_linenumber").alias("k"))
    first = x.groupBy("board_id", "r", "c").agg(F.min("k").alias("k"))
    return first.select("board_id", "r", "c", (1 + F.col("k.l_linenumber") % 2).cast("int").alias("stone"))


_GRID = f"SELECT b.board_id, CAST(x.i AS INTEGER) AS r, CAST(y.j AS INTEGER) AS c, coalesce(s.stone, 0) AS stone FROM (SELECT DISTINCT board_id FROM ({BOARDS_SQL})) b CROSS JOIN range(19) x(i) CROSS JOIN range(19) y(j) LEFT JOIN ({BOARDS_SQL}) s ON s.board_id = b.board_id AND s.r = x.i AND s.c = y.j"
_SIDE = "(abs(a.r - b.r) + abs(a.c - b.c) = 1)"
_REGION = """g AS MATERIALIZED (SELECT board_id, r * 19 + c AS p, r, c, stone FROM ({grid}) WHERE {where}),
    e AS MATERIALIZED (SELECT a.board_id, a.p AS p, b.p AS q FROM g a JOIN g b ON b.board_id = a.board_id AND b.stone = a.stone AND (b.p = a.p + 19 OR b.p = a.p - 19 OR (b.p = a.p + 1 AND b.r = a.r) OR (b.p = a.p - 1 AND b.r = a.r))),
    w AS (SELECT board_id, p, p AS root FROM g UNION SELECT e.board_id, e.q, w.root FROM w JOIN e ON e.board_id = w.board_id AND e.p = w.p),
    m AS MATERIALIZED (SELECT board_id, p, min(root) AS root FROM w GROUP BY board_id, p)"""
_STONES = "WITH RECURSIVE " + _REGION.format(grid=BOARDS_SQL, where="true") + """,
    o AS MATERIALIZED (SELECT x.board_id, x.r * 19 + x.c AS p, x.r, x.c FROM ({grid}) x WHERE x.stone = 0),
    l AS (SELECT m.board_id, m.root, count(DISTINCT o.p) AS liberties FROM g JOIN m USING (board_id, p) JOIN o ON o.board_id = g.board_id AND abs(o.r - g.r) + abs(o.c - g.c) = 1 GROUP BY ALL),
    z AS (SELECT board_id, root, count(*) AS size FROM m GROUP BY ALL)
    """.format(grid=_GRID)


_PLACES = {"is_edge": "r = 0 OR c = 0 OR r = 18 OR c = 18", "is_corner": "(r < 4 OR r > 14) AND (c < 4 OR c > 14)", "is_centre": "abs(r - 9) <= 2 AND abs(c - 9) <= 2", "is_star": "r IN (3, 9, 15) AND c IN (3, 9, 15)"}


@query(f"SELECT board_id, {', '.join(f'count(*) FILTER ({e}) AS {k}' for k, e in _PLACES.items())} FROM ({BOARDS_SQL}) WHERE stone > 0 GROUP BY board_id")
def board_geometry(spark: SparkSession, sf: str) -> DataFrame:
    """Each board's stones on edges, in corners, in the centre and on star points."""
    places = boards.geometry(F.col("r"), F.col("c"))
    return stones(spark, sf).where("stone > 0").groupBy("board_id").agg(*(F.count_if(places[k]).alias(k) for k in _PLACES))


@query(f"SELECT stone, count(*) AS n, count(DISTINCT board_id) AS n_boards, CAST(sum(CAST(stone = 1 AS INTEGER)) AS BIGINT) AS black, CAST(sum(CAST(stone = 2 AS INTEGER)) AS BIGINT) AS white FROM ({BOARDS_SQL}) GROUP BY stone")
def stone_onehot(spark: SparkSession, sf: str) -> DataFrame:
    s = stones(spark, sf)
    return s.groupBy("stone").agg(F.count("*").alias("n"), F.count_distinct("board_id").alias("n_boards"), F.sum((F.col("stone") == 1).cast("int")).alias("black"), F.sum((F.col("stone") == 2).cast("int")).alias("white"))


@query(f"SELECT DISTINCT a.board_id, a.r, a.c FROM ({BOARDS_SQL}) a JOIN ({BOARDS_SQL}) b ON b.board_id = a.board_id AND b.stone = 3 - a.stone AND {_SIDE}")
def contact_points(spark: SparkSession, sf: str) -> DataFrame:
    """By the SQL-visible neighbour join."""
    s = stones(spark, sf)
    n = boards.neighbours(s).alias("a").join(s.alias("b"), (F.col("a.board_id") == F.col("b.board_id")) & (F.col("a.nr") == F.col("b.r")) & (F.col("a.nc") == F.col("b.c")))
    return n.where("b.stone = 3 - a.stone").select("a.board_id", "a.r", "a.c").distinct()


@query(_STONES + "SELECT board_id, CAST(p AS INTEGER) AS point, CAST(root AS INTEGER) AS group_id, CAST(size AS INTEGER) AS group_size, CAST(coalesce(liberties, 0) AS INTEGER) AS liberties FROM m JOIN z USING (board_id, root) LEFT JOIN l USING (board_id, root)")
def board_groups(spark: SparkSession, sf: str) -> DataFrame:
    return boards.board_labels(stones(spark, sf)).where("stone > 0").select("board_id", "point", "group_id", "group_size", "liberties")


@query(_STONES + "SELECT board_id, CAST(p AS INTEGER) AS point FROM m JOIN l USING (board_id, root) WHERE liberties = 1")
def atari_points(spark: SparkSession, sf: str) -> DataFrame:
    return boards.board_labels(stones(spark, sf)).where("is_atari").select("board_id", "point")


@query("WITH RECURSIVE " + _REGION.format(grid=_GRID, where="stone = 0") + f""",
    t AS (SELECT m.board_id, m.root, bool_or(s.stone = 1) AS b, bool_or(s.stone = 2) AS w FROM g JOIN m USING (board_id, p) JOIN ({BOARDS_SQL}) s ON s.board_id = g.board_id AND abs(s.r - g.r) + abs(s.c - g.c) = 1 GROUP BY ALL)
    SELECT board_id, count(*) FILTER (b AND NOT w) AS black, count(*) FILTER (w AND NOT b) AS white FROM m LEFT JOIN t USING (board_id, root) GROUP BY board_id""")
def territory(spark: SparkSession, sf: str) -> DataFrame:
    return boards.board_labels(stones(spark, sf)).groupBy("board_id").agg(F.count_if("black_territory").alias("black"), F.count_if("white_territory").alias("white"))


@query(_STONES + """SELECT o.board_id, CAST(o.p AS INTEGER) AS point, g.stone FROM o JOIN g ON g.board_id = o.board_id AND abs(o.r - g.r) + abs(o.c - g.c) = 1 JOIN m ON m.board_id = g.board_id AND m.p = g.p
    GROUP BY o.board_id, o.p, g.stone HAVING count(DISTINCT m.root) >= 2""")
def cutting_points(spark: SparkSession, sf: str) -> DataFrame:
    x = boards.board_labels(stones(spark, sf))
    one = lambda k, s: x.where(k).select("board_id", "point", F.lit(s).alias("stone"))
    return one("black_cutting", 1).unionByName(one("white_cutting", 2))


@query(f"""WITH g AS MATERIALIZED ({_GRID}), o AS (SELECT board_id, r, c FROM g WHERE stone = 0),
    n AS (SELECT o.board_id, o.r, o.c, bool_and(s.stone = 1) AS all_b, bool_and(s.stone = 2) AS all_w FROM o JOIN g s ON s.board_id = o.board_id AND abs(s.r - o.r) + abs(s.c - o.c) = 1 GROUP BY ALL),
    d AS (SELECT n.board_id, n.r, n.c, any_value(all_b) AS all_b, any_value(all_w) AS all_w, count(*) FILTER (s.stone = 2) AS dw, count(*) FILTER (s.stone = 1) AS db FROM n JOIN g s ON s.board_id = n.board_id AND abs(s.r - n.r) = 1 AND abs(s.c - n.c) = 1 WHERE all_b OR all_w GROUP BY n.board_id, n.r, n.c)
    SELECT board_id, CAST(r * 19 + c AS INTEGER) AS point, all_b AS black, all_w AS white FROM d
    WHERE (CASE WHEN all_b THEN dw ELSE db END) <= CASE WHEN r IN (0, 18) OR c IN (0, 18) THEN 0 ELSE 1 END""")
def eye_shapes(spark: SparkSession, sf: str) -> DataFrame:
    return boards.board_labels(stones(spark, sf)).where("black_eye or white_eye").select("board_id", "point", F.col("black_eye").alias("black"), F.col("white_eye").alias("white"))


@query(f"SELECT board_id, count(*) AS n_points, count(*) FILTER (stone > 0) AS n_stones, count(*) FILTER (stone = 0 AND (r = 0 OR c = 0 OR r = 18 OR c = 18)) AS empty_edge FROM ({_GRID}) GROUP BY board_id")
def flat_labels(spark: SparkSession, sf: str) -> DataFrame:
    """The whole label bundle, a row per point, counted by board."""
    x = boards.board_labels(stones(spark, sf))
    g = boards.geometry(F.expr("point div 19"), F.col("point") % 19)
    return x.groupBy("board_id").agg(F.count("*").alias("n_points"), F.count_if(F.expr("stone > 0")).alias("n_stones"), F.count_if((F.col("stone") == 0) & g["is_edge"]).alias("empty_edge"))


@query(_STONES + "SELECT board_id, count(*) FILTER (coalesce(liberties, 0) < 3) AS low_liberty, count(*) FILTER (size >= 5) AS large_group, max(size) AS largest FROM m JOIN z USING (board_id, root) LEFT JOIN l USING (board_id, root) GROUP BY board_id")
def group_summary(spark: SparkSession, sf: str) -> DataFrame:
    x = boards.board_labels(stones(spark, sf)).where("stone > 0")
    return x.groupBy("board_id").agg(F.count_if("is_low_liberty").alias("low_liberty"), F.count_if("is_large_group").alias("large_group"), F.max("group_size").cast("long").alias("largest"))


@query(f"SELECT board_id, CASE WHEN black <= white THEN 1 ELSE 2 END AS mover, black AS n_black, white AS n_white FROM (SELECT board_id, count(*) FILTER (stone = 1) AS black, count(*) FILTER (stone = 2) AS white FROM ({BOARDS_SQL}) GROUP BY board_id)")
def infer_mover(spark: SparkSession, sf: str) -> DataFrame:
    g = stones(spark, sf).groupBy("board_id").agg(F.count_if(F.expr("stone = 1")).alias("n_black"), F.count_if(F.expr("stone = 2")).alias("n_white"))
    return g.select("board_id", F.when(F.col("n_black") <= F.col("n_white"), 1).otherwise(2).alias("mover"), "n_black", "n_white")


# boards of ten follow each other in a game
_PLANES = f"""WITH m AS (SELECT board_id, CASE WHEN count(*) FILTER (stone = 1) <= count(*) FILTER (stone = 2) THEN 1 ELSE 2 END AS mover FROM ({BOARDS_SQL}) GROUP BY board_id),
    x AS (SELECT m.board_id, CAST(t + CASE WHEN s.stone = m.mover THEN 0 ELSE 8 END AS INTEGER) AS plane, s.r * 19 + s.c AS point FROM m, range(8) h(t), ({BOARDS_SQL}) s WHERE s.board_id = m.board_id - t AND s.board_id // 10 = m.board_id // 10)
    SELECT board_id, plane, list(CAST(point AS INTEGER) ORDER BY point) AS points FROM x GROUP BY ALL
    UNION ALL SELECT board_id, 15 + mover, CAST(range(361) AS INTEGER[]) FROM m"""


def encoded_boards(spark: SparkSession, sf: str) -> DataFrame:
    """(board_id, planes): each board with up to seven before it in its game of ten, in 18 planes, as arrays of points. One window by game; boards are told by number, so a missing one is missing."""
    point = (F.col("r") * 19 + F.col("c")).cast("int")
    of = lambda k: F.sort_array(F.collect_list(F.when(F.col("stone") == k, point)))
    x = stones(spark, sf).groupBy("board_id").agg(of(1).alias("b"), of(2).alias("w"))
    game = Window.partitionBy(F.expr("board_id div 10")).orderBy("board_id")
    before = lambda c, t: F.first(c).over(game.rangeBetween(-t, -t))
    x = x.select("board_id", *(before(c, t).alias(f"{c}{t}") for t in range(8) for c in "bw"))
    stack = lambda c: [F.col(f"{c}{t}") for t in range(8)]
    return x.select("board_id", boards.planes(stack("b"), stack("w"), F.when(F.size("b0") <= F.size("w0"), 1).otherwise(2)).alias("planes"))


@query(_PLANES)
def encode_planes(spark: SparkSession, sf: str) -> DataFrame:
    """All 18 planes of every board, as the points that are set."""
    return encoded_boards(spark, sf).select("board_id", F.posexplode("planes").alias("plane", "points")).where(F.size("points") > 0)


@query(BOARDS_SQL)
def board_from_planes(spark: SparkSession, sf: str) -> DataFrame:
    """Boards read back from their planes, whichever side is to move."""
    black, white = boards.stones_of(F.col("planes"))
    each = lambda p, k: F.transform(p, lambda i: F.struct(i.alias("p"), F.lit(k).alias("stone")))
    x = encoded_boards(spark, sf).select("board_id", F.explode(F.concat(each(black, 1), each(white, 2))).alias("s"))
    return x.select("board_id", F.expr("cast(s.p div 19 as int)").alias("r"), F.expr("cast(s.p % 19 as int)").alias("c"), "s.stone")


@query(f"SELECT round(avg(n), 6) AS mean, round(stddev_pop(n), 6) AS std, min(n) AS least, max(n) AS most, round(avg(CAST(b <= w AS INTEGER)), 6) + 0.0 AS black_to_move FROM (SELECT board_id, count(*) AS n, count(*) FILTER (stone = 1) AS b, count(*) FILTER (stone = 2) AS w FROM ({BOARDS_SQL}) GROUP BY board_id)")
def stones_per_position(spark: SparkSession, sf: str) -> DataFrame:
    g = stones(spark, sf).groupBy("board_id").agg(F.count("*").alias("n"), F.count_if(F.expr("stone = 1")).alias("b"), F.count_if(F.expr("stone = 2")).alias("w"))
    return g.agg(F.round(F.avg("n"), 6).alias("mean"), F.round(F.stddev_pop("n"), 6).alias("std"), F.min("n").alias("least"), F.max("n").alias("most"), (F.round(F.avg((F.col("b") <= F.col("w")).cast("int")), 6) + 0.0).alias("black_to_move"))


LABELS = ["is_edge", "is_corner", "is_centre", "is_star", "is_black", "is_white", "black_contact", "white_contact", "black_eye", "white_eye", "is_atari", "is_low_liberty", "is_large_group", "black_cutting", "white_cutting", "black_territory", "white_territory"]
_BUNDLE = f"""WITH RECURSIVE q AS MATERIALIZED ({_GRID}), n AS MATERIALIZED (SELECT a.board_id, a.r * 19 + a.c AS p, a.r, a.c, a.stone, bool_and(b.stone = 1) AS all_b, bool_and(b.stone = 2) AS all_w, bool_or(b.stone = 1) AS any_b, bool_or(b.stone = 2) AS any_w
        FROM q a JOIN q b ON b.board_id = a.board_id AND {_SIDE} GROUP BY ALL),
    d AS (SELECT a.board_id, a.r * 19 + a.c AS p, count(*) FILTER (b.stone = 1) AS db, count(*) FILTER (b.stone = 2) AS dw FROM q a JOIN q b ON b.board_id = a.board_id AND abs(a.r - b.r) = 1 AND abs(a.c - b.c) = 1 WHERE a.stone = 0 GROUP BY ALL),
    g AS MATERIALIZED (SELECT board_id, r * 19 + c AS p, r, c, stone FROM q),
    e AS MATERIALIZED (SELECT a.board_id, a.p AS p, b.p AS q FROM g a JOIN g b ON b.board_id = a.board_id AND b.stone = a.stone AND (b.p = a.p + 19 OR b.p = a.p - 19 OR (b.p = a.p + 1 AND b.r = a.r) OR (b.p = a.p - 1 AND b.r = a.r))),
    w AS (SELECT board_id, p, p AS root FROM g WHERE stone > 0 UNION SELECT e.board_id, e.q, w.root FROM w JOIN e ON e.board_id = w.board_id AND e.p = w.p),
    m AS MATERIALIZED (SELECT board_id, p, min(root) AS root FROM w GROUP BY board_id, p),
    f AS (SELECT board_id, p, p AS root FROM g WHERE stone = 0 UNION SELECT e.board_id, e.q, f.root FROM f JOIN e ON e.board_id = f.board_id AND e.p = f.p),
    o AS MATERIALIZED (SELECT board_id, p, min(root) AS root FROM f GROUP BY board_id, p),
    t AS (SELECT o.board_id, o.root, bool_or(any_b) AS b, bool_or(any_w) AS w FROM o JOIN n USING (board_id, p) GROUP BY ALL),
    z AS (SELECT board_id, root, count(*) AS size FROM m GROUP BY ALL),
    l AS (SELECT m.board_id, m.root, count(DISTINCT o.p) AS liberties FROM g JOIN m USING (board_id, p) JOIN n o ON o.board_id = g.board_id AND o.stone = 0 AND abs(o.r - g.r) + abs(o.c - g.c) = 1 GROUP BY ALL),
    k AS (SELECT o.board_id, o.p, count(DISTINCT m.root) FILTER (g.stone = 1) >= 2 AS cb, count(DISTINCT m.root) FILTER (g.stone = 2) >= 2 AS cw FROM n o JOIN g ON g.board_id = o.board_id AND o.stone = 0 AND g.stone > 0 AND abs(o.r - g.r) + abs(o.c - g.c) = 1 JOIN m ON m.board_id = g.board_id AND m.p = g.p GROUP BY ALL)
    SELECT n.board_id, CAST(n.p AS INTEGER) AS point, n.r IN (0, 18) OR n.c IN (0, 18) AS is_edge, (n.r < 4 OR n.r > 14) AND (n.c < 4 OR n.c > 14) AS is_corner, abs(n.r - 9) <= 2 AND abs(n.c - 9) <= 2 AS is_centre, n.r IN (3, 9, 15) AND n.c IN (3, 9, 15) AS is_star,
        n.stone = 1 AS is_black, n.stone = 2 AS is_white, n.stone = 1 AND any_w AS black_contact, n.stone = 2 AND any_b AS white_contact,
        n.stone = 0 AND all_b AND dw <= CASE WHEN n.r IN (0, 18) OR n.c IN (0, 18) THEN 0 ELSE 1 END AS black_eye, n.stone = 0 AND all_w AND db <= CASE WHEN n.r IN (0, 18) OR n.c IN (0, 18) THEN 0 ELSE 1 END AS white_eye,
        n.stone > 0 AND coalesce(liberties, 0) = 1 AS is_atari, n.stone > 0 AND coalesce(liberties, 0) < 3 AS is_low_liberty, n.stone > 0 AND size >= 5 AS is_large_group, coalesce(cb, false) AS black_cutting, coalesce(cw, false) AS white_cutting,
        n.stone = 0 AND t.b AND NOT t.w AS black_territory, n.stone = 0 AND t.w AND NOT t.b AS white_territory
    FROM n LEFT JOIN d USING (board_id, p) LEFT JOIN m USING (board_id, p) LEFT JOIN z ON z.board_id = m.board_id AND z.root = m.root LEFT JOIN l ON l.board_id = m.board_id AND l.root = m.root
        LEFT JOIN k ON k.board_id = n.board_id AND k.p = n.p LEFT JOIN o ON o.board_id = n.board_id AND o.p = n.p LEFT JOIN t ON t.board_id = o.board_id AND t.root = o.root"""


@query(f"SELECT board_id, point, {', '.join(f'coalesce({x}, false) AS {x}' for x in LABELS)} FROM ({_BUNDLE})")
def label_bundle(spark: SparkSession, sf: str) -> DataFrame:
    """Every label of every point of every board, side by side."""
    g = boards.geometry(F.expr("point div 19"), F.col("point") % 19)
    return boards.board_labels(stones(spark, sf)).select("board_id", "point", *(g[x].alias(x) if x in g else F.col(x) for x in LABELS))


@query(f"SELECT vec_id, CAST(i AS INTEGER) AS point, list(round(vec[c * 16 + i + 1], 6) + 0.0 ORDER BY c) AS channels FROM ({views.TRAJ_VEC_SQL}), range(4) a(c), range(16) b(i) GROUP BY vec_id, i")
def spatial_flatten(spark: SparkSession, sf: str) -> DataFrame:
    """(4, 4, 4) maps of channels, each point with its channels: a slice per point, no shuffle."""
    points = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda c: r6(F.get("vec", c * 16 + i))))
    return views.traj_vec(spark, sf).select("vec_id", F.posexplode(points).alias("point", "channels"))


@query(f"SELECT board_id, CAST(r // 5 * 4 + c // 5 AS INTEGER) AS block, round(count(*) FILTER (stone = 1) / count(*), 6) + 0.0 AS mean_black, max(stone) AS max_stone FROM ({_GRID}) GROUP BY ALL")
def spatial_pool(spark: SparkSession, sf: str) -> DataFrame:
    """Mean and max pooling over blocks of 5 x 5 points."""
    x = boards.board_labels(stones(spark, sf)).select("board_id", (F.expr("point div 19 div 5 * 4 + (point % 19) div 5")).cast("int").alias("block"), "stone")
    return x.groupBy("board_id", "block").agg((F.round(F.avg((F.col("stone") == 1).cast("int")), 6) + 0.0).alias("mean_black"), F.max("stone").alias("max_stone"))
