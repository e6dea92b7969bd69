"""Queries over quads, maps between pictures and context; labels are pictures, embeddings are detections in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graphs import spanning_forest
from ..operators.nearest import neighbours
from ..operators.registration import containment_groups, context_offers, context_pairs, map_votes, projected_matches, quad_pairs, to_roots
from .pictures import trade
from .registry import Tables, query

#: Detections are rectangles of 0.05 by 0.07 round a point, turned; every seventh is three times as large.
QUADS = """
WITH RECURSIVE d AS (SELECT label AS g, vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) * 3 AS t, CASE WHEN vec_id % 7 = 0 THEN 3.0 ELSE 1.0 END::DOUBLE AS s,
  CASE WHEN vec_id % 3 > 0 THEN vec_id % 5 END AS identity FROM embeddings),
c(i, u, w) AS (VALUES (0, -0.05::DOUBLE, -0.07::DOUBLE), (1, 0.05, -0.07), (2, 0.05, 0.07), (3, -0.05, 0.07)),
v AS (SELECT g, id, i, x + s * (u * cos(t) - w * sin(t)) AS x, y + s * (u * sin(t) + w * cos(t)) AS y FROM d, c)
"""
#: The area two convex quads share, from corners inside the other and crossings of sides, put in order round their mean.
SHARED = """
, box AS (SELECT side, g, id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM q GROUP BY ALL),
e AS (SELECT p.*, n.x AS xx, n.y AS yy FROM q p JOIN q n ON p.side = n.side AND p.g = n.g AND p.id = n.id AND n.i = (p.i + 1) % 4),
area AS (SELECT side, g, id, abs(sum(x * yy - xx * y)) / 2 AS area FROM e GROUP BY ALL),
met AS (SELECT a.g, a.id AS a, b.id AS b FROM box a JOIN box b ON a.side = 0 AND b.side = 1 AND a.g = b.g AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1),
inner_ AS (
  SELECT m.g, m.a, m.b, p.x, p.y FROM met m JOIN e p ON p.side = 0 AND p.g = m.g AND p.id = m.a JOIN e o ON o.side = 1 AND o.g = m.g AND o.id = m.b
  GROUP BY m.g, m.a, m.b, p.i, p.x, p.y HAVING min((o.xx - o.x) * (p.y - o.y) - (o.yy - o.y) * (p.x - o.x)) >= 0
  UNION ALL
  SELECT m.g, m.a, m.b, p.x, p.y FROM met m JOIN e p ON p.side = 1 AND p.g = m.g AND p.id = m.b JOIN e o ON o.side = 0 AND o.g = m.g AND o.id = m.a
  GROUP BY m.g, m.a, m.b, p.i, p.x, p.y HAVING min((o.xx - o.x) * (p.y - o.y) - (o.yy - o.y) * (p.x - o.x)) >= 0
),
lines AS (SELECT m.g, m.a, m.b, p.x, p.y, p.xx - p.x AS rx, p.yy - p.y AS ry, o.x AS ox, o.y AS oy, o.xx - o.x AS sx, o.yy - o.y AS sy
  FROM met m JOIN e p ON p.side = 0 AND p.g = m.g AND p.id = m.a JOIN e o ON o.side = 1 AND o.g = m.g AND o.id = m.b),
cross_ AS (SELECT g, a, b, x, y, rx, ry, ((ox - x) * sy - (oy - y) * sx) / (rx * sy - ry * sx) AS t, ((ox - x) * ry - (oy - y) * rx) / (rx * sy - ry * sx) AS u FROM lines WHERE abs(rx * sy - ry * sx) > 1e-15),
points AS (SELECT DISTINCT g, a, b, round(x, 12) AS x, round(y, 12) AS y FROM (SELECT * FROM inner_ UNION ALL SELECT g, a, b, x + t * rx, y + t * ry FROM cross_ WHERE t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1)),
mean AS (SELECT g, a, b, avg(x) AS mx, avg(y) AS my FROM points GROUP BY ALL),
turn AS (SELECT g, a, b, x, y, row_number() OVER w AS n, count(*) OVER (PARTITION BY g, a, b) AS k FROM points JOIN mean USING (g, a, b) WINDOW w AS (PARTITION BY g, a, b ORDER BY atan2(y - my, x - mx))),
shared AS (SELECT p.g, p.a, p.b, abs(sum(p.x * n.y - n.x * p.y)) / 2 AS shared FROM turn p JOIN turn n ON p.g = n.g AND p.a = n.a AND p.b = n.b AND n.n = p.n % p.k + 1 GROUP BY ALL),
pair AS (SELECT s.g, s.a, s.b, shared, x.area AS area_a, y.area AS area_b, shared / least(x.area, y.area) AS overlap, shared / (x.area + y.area - shared) AS iou
  FROM shared s JOIN area x ON x.side = 0 AND x.g = s.g AND x.id = s.a JOIN area y ON y.side = 1 AND y.g = s.g AND y.id = s.b)
"""
#: A map for each picture: a shift, a shear and a slight perspective.
MAPPED = """
, h AS (SELECT DISTINCT g, 0.01::DOUBLE * (g % 3) AS dx, 0.02::DOUBLE AS k, 0.05::DOUBLE AS w FROM d),
m AS (SELECT v.g, v.id, v.i, (v.x + k * v.y + dx) / (w * v.x + 1) AS x, v.y / (w * v.x + 1) AS y FROM v JOIN h USING (g)),
q AS (SELECT 0 AS side, * FROM m WHERE id % 2 = 0 UNION ALL SELECT 1, * FROM v WHERE id % 2 = 1)
"""
MATCHED = """
, best AS (SELECT * FROM pair QUALIFY row_number() OVER (PARTITION BY g, a ORDER BY round(overlap, 9) DESC, b) = 1),
kind AS (SELECT best.g, a, b, x.identity AS ia, y.identity AS ib, CASE WHEN x.identity IS NULL OR y.identity IS NULL THEN CASE WHEN iou >= 0.55 THEN 'inherits' END WHEN overlap >= 0.6 THEN CASE WHEN x.identity = y.identity THEN 'same' ELSE 'possible' END END AS kind
  FROM best JOIN d x ON x.id = a JOIN d y ON y.id = b)
"""


def turned(t: Tables) -> DataFrame:
    """g, id, quad and identity of all detections."""
    e = lambda i: F.col("embedding")[i].cast("double")
    angle, size = e(2) * 3, F.when(F.col("vec_id") % 7 == 0, 3.0).otherwise(1.0)

    def corner(u: float, w: float) -> Column:
        return F.array(e(0) + size * (u * F.cos(angle) - w * F.sin(angle)), e(1) + size * (u * F.sin(angle) + w * F.cos(angle)))

    quad = F.array(corner(-0.05, -0.07), corner(0.05, -0.07), corner(0.05, 0.07), corner(-0.05, 0.07))
    return t.embeddings.select(F.col("label").alias("g"), F.col("vec_id").alias("id"), quad.alias("quad"), F.when(F.col("vec_id") % 3 > 0, F.col("vec_id") % 5).alias("identity"))


def views(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Detections of even and of odd number as two pictures, and a map from the first to the second for each label."""
    d = turned(t)
    maps = d.select("g").distinct().select("g", F.array(F.lit(1.0), F.lit(0.02), 0.01 * (F.col("g") % 3), *[F.lit(x) for x in (0.0, 1.0, 0.0, 0.05, 0.0, 1.0)]).alias("h"))
    return d.where("id % 2 = 0"), d.where("id % 2 = 1"), maps


def to_places(x: str, n: int) -> Column:
    """A share of 0 to 1 rounded as ``round`` does it, but without a decimal for each row."""
    return F.floor(F.col(x) * 10.0**n + 0.5) / 10.0**n


@query(QUADS + ", q AS (SELECT 0 AS side, * FROM v UNION ALL SELECT 1, * FROM v)" + SHARED + "SELECT g, a, b, round(iou, 5) AS iou, round(overlap, 5) AS overlap FROM pair WHERE a < b AND iou > 0.05")
def quad_overlap(t: Tables) -> DataFrame:
    """Turned quads of one picture that share area."""
    return quad_pairs(turned(t), turned(t), ["g"], 0.15, ordered=True, iou=0.05).select("g", "a", "b", to_places("iou", 5).alias("iou"), to_places("overlap", 5).alias("overlap"))


@query(QUADS + MAPPED + SHARED + MATCHED + "SELECT g, a, b, kind FROM kind WHERE kind IS NOT NULL")
def projected_overlap(t: Tables) -> DataFrame:
    """Detections that fall on one of the other picture under the picture's map."""
    return projected_matches(*views(t), ["g"], 0.15)


@query(QUADS + MAPPED.replace("WHERE id % 2 = 0", "WHERE id % 2 = 0 AND id % 3 > 0").replace("WHERE id % 2 = 1", "WHERE id % 2 = 1 AND id % 3 > 0") + SHARED + MATCHED + """
, n AS (SELECT g, identity, count(*) FILTER (WHERE id % 2 = 0) AS a, count(*) FILTER (WHERE id % 2 = 1) AS b FROM d WHERE identity IS NOT NULL GROUP BY ALL),
votes AS (SELECT kind.g, count(*) FILTER (WHERE kind = 'same') AS consistent, count(*) FILTER (WHERE kind = 'possible') AS inconsistent, count(*) FILTER (WHERE kind = 'same' AND n.a = 1 AND n.b = 1) AS unique_anchors, count(DISTINCT ia) FILTER (WHERE kind = 'same') AS k
  FROM kind JOIN n ON n.g = kind.g AND n.identity = ia WHERE kind IS NOT NULL GROUP BY 1)
SELECT g, consistent, inconsistent, unique_anchors, (unique_anchors >= 1 OR k >= 2) AND inconsistent <= consistent // 3 AS valid FROM votes
""")
def homography_votes(t: Tables) -> DataFrame:
    """Votes of the identified detections for and against each picture's map."""
    return map_votes(*views(t), ["g"], 0.15)


@query(QUADS + ", q AS (SELECT 0 AS side, * FROM v UNION ALL SELECT 1, * FROM v)" + SHARED + """
, held AS (SELECT g, a AS id, b AS inner_id, area_b AS area FROM pair WHERE a <> b AND area_b < 0.75 * area_a AND shared > 0.85 * area_b AND area_b BETWEEN 0.03 * area_a AND 0.5 * area_a),
near AS (SELECT g, a, b FROM pair WHERE a <> b AND shared >= 0.2 * least(area_a, area_b)),
l AS (SELECT h.g, h.id, h.inner_id, row_number() OVER (PARTITION BY h.g, h.id ORDER BY round(area, 9) DESC, inner_id) AS n, (SELECT coalesce(list(b), []) FROM near WHERE near.g = h.g AND near.a = h.inner_id) AS others FROM held h),
r AS (SELECT g, id, n, [inner_id] AS loose FROM l WHERE n = 1
  UNION ALL SELECT l.g, l.id, l.n, CASE WHEN list_has_any(loose, others) THEN loose ELSE list_append(loose, l.inner_id) END FROM r JOIN l ON l.g = r.g AND l.id = r.id AND l.n = r.n + 1)
SELECT g, id, CAST(max(len(loose)) AS BIGINT) AS held FROM r GROUP BY 1, 2 HAVING max(len(loose)) >= 3
""")
def containment(t: Tables) -> DataFrame:
    """Large quads that hold three or more loose ones."""
    return containment_groups(turned(t), ["g"], 0.3)


@query("""
WITH RECURSIVE w AS (SELECT CAST(c_nationkey AS BIGINT) AS a, o_orderkey % 25 AS b, count(*) AS weight FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
p AS (SELECT least(a, b) AS a, greatest(a, b) AS b, max(weight) AS weight FROM w WHERE a <> b GROUP BY 1, 2),
e AS (SELECT *, row_number() OVER (ORDER BY weight DESC, a, b) AS n FROM p),
u AS (SELECT a, b, n FROM e UNION ALL SELECT b, a, n FROM e),
reach AS (SELECT n, a AS node FROM e UNION SELECT reach.n, u.b FROM reach JOIN u ON u.a = reach.node AND u.n < reach.n),
f AS (SELECT a, b, weight FROM e WHERE NOT EXISTS (SELECT 1 FROM reach WHERE reach.n = e.n AND reach.node = e.b)),
h AS (SELECT a, b, [1.0 + 0.01 * a, 0.02, b - a, 0.01 * b, 1.0, a + b, 0.001, 0.0, 1.0]::DOUBLE[] AS m FROM f),
i AS (SELECT a, b, [m[5] * m[9] - m[6] * m[8], m[3] * m[8] - m[2] * m[9], m[2] * m[6] - m[3] * m[5], m[6] * m[7] - m[4] * m[9], m[1] * m[9] - m[3] * m[7], m[3] * m[4] - m[1] * m[6], m[4] * m[8] - m[5] * m[7], m[2] * m[7] - m[1] * m[8], m[1] * m[5] - m[2] * m[4]] AS m FROM h),
s AS (SELECT a AS node, b AS up, m FROM h UNION ALL SELECT b, a, list_transform(m, lambda x: x / m[9]) FROM i),
deg AS (SELECT node, sum(weight) AS weight FROM (SELECT a AS node, weight FROM f UNION ALL SELECT b, weight FROM f) GROUP BY 1),
same(node, other) AS (SELECT node, node FROM deg UNION SELECT same.node, s.up FROM same JOIN s ON s.node = same.other),
root AS (SELECT same.node, other AS root FROM same JOIN deg ON deg.node = other QUALIFY row_number() OVER (PARTITION BY same.node ORDER BY weight DESC, other) = 1),
walk(node, root, h, came) AS (SELECT DISTINCT root, root, [1.0, 0, 0, 0, 1, 0, 0, 0, 1]::DOUBLE[], -1::BIGINT FROM root
  UNION ALL
  SELECT node, root, list_transform(z, lambda x: x / z[9]), up FROM (SELECT s.node, walk.root, s.up, list_transform(range(9), lambda k: h[3 * (k // 3) + 1] * m[k % 3 + 1] + h[3 * (k // 3) + 2] * m[k % 3 + 4] + h[3 * (k // 3) + 3] * m[k % 3 + 7]) AS z FROM walk JOIN s ON s.up = walk.node AND s.node <> walk.came))
SELECT node, root, round(h[1], 6) AS h1, round(h[2], 6) AS h2, round(h[3], 4) AS h3, round(h[6], 4) AS h6, round(h[7], 6) AS h7 FROM walk
""")
def registration_maps(t: Tables) -> DataFrame:
    """The map of every nation to the root of its tree, composed along the spanning forest."""
    a, b = F.col("a"), F.col("b")
    h = F.array(*[x.cast("double") for x in (1 + 0.01 * a, F.lit(0.02), b - a, 0.01 * b, F.lit(1.0), a + b, F.lit(0.001), F.lit(0.0), F.lit(1.0))])
    rows = to_roots(spanning_forest(trade(t)).withColumn("h", h))
    return rows.select("node", "root", *[F.round(F.col("h")[i], n).alias(f"h{i + 1}") for i, n in ((0, 6), (1, 6), (2, 4), (5, 4), (6, 6))])


CONTEXT = """
WITH p AS (SELECT label AS session, vec_id AS id, vec_id % 4 AS capture, (vec_id // 4) % 3 AS identity, vec_id % 2 AS printing, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings),
n AS (SELECT a.session, a.id, b.identity, (b.x - a.x) / 0.1 AS dx, (b.y - a.y) / 0.1 AS dy, row_number() OVER (PARTITION BY a.id ORDER BY sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), b.id) AS k
  FROM p a JOIN p b ON a.session = b.session AND a.capture = b.capture AND a.id <> b.id AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 0.2 QUALIFY k <= 4),
l AS (SELECT p.session, p.id, p.capture, p.identity, p.printing, list({'identity': n.identity, 'dx': n.dx, 'dy': n.dy} ORDER BY k) AS near FROM p JOIN n USING (session, id) GROUP BY ALL),
o AS (SELECT a.session, a.identity, a.capture AS capture_a, b.capture AS capture_b, a.id AS a, b.id AS b, a.printing = b.printing AS same, a.near AS na, b.near AS nb FROM l a JOIN l b ON a.session = b.session AND a.identity = b.identity AND a.capture < b.capture
  AND list_has_any(list_transform(a.near, lambda z: z.identity), list_transform(b.near, lambda z: z.identity))),
f AS (SELECT *, list_reduce(na, lambda used, z: list_concat(used, list_filter(range(len(nb)), lambda i: NOT list_contains(used, i) AND nb[i + 1].identity = z.identity AND abs(nb[i + 1].dx - z.dx) <= 0.6 AND abs(nb[i + 1].dy - z.dy) <= 0.6)[:1]), []::BIGINT[]) AS used FROM o),
c AS (SELECT session, identity, capture_a, capture_b, a, b, len(used) / greatest(len(na), len(nb)) AS context, len(used) / greatest(len(na), len(nb)) + CASE WHEN same THEN 0.15 ELSE 0 END AS score FROM f)
"""


def in_context(t: Tables) -> DataFrame:
    """Detections with their four nearest neighbours of the same picture."""
    v = F.col("vec_id")
    p = t.embeddings.select(F.col("label").alias("session"), v.alias("id"), (v % 4).alias("capture"), (F.floor(v / 4) % 3).alias("identity"), (v % 2).alias("printing"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    picture = F.struct("session", "capture").alias("picture")
    near = neighbours(p.select(picture, "id", "x", "y"), "picture", 0.2, 4)
    of = p.select(F.col("id").alias("other"), F.col("identity").alias("beside"))
    entry = F.struct(F.col("rank").alias("k"), F.col("beside").alias("identity"), ((F.col("ox") - F.col("x")) / 0.1).alias("dx"), ((F.col("oy") - F.col("y")) / 0.1).alias("dy"))
    lists = near.join(of, "other").groupBy("id").agg(F.sort_array(F.collect_list(entry)).alias("neighbours"))  # four at most
    return p.join(lists, "id")


@query(CONTEXT + "SELECT session, identity, capture_a, capture_b, a, b, round(context, 6) AS context, round(score, 6) AS score FROM c")
def context_scores(t: Tables) -> DataFrame:
    """How far the surroundings of two detections of one identity agree."""
    out = context_offers(in_context(t))
    return out.withColumns({c: F.round(c, 6) for c in ("context", "score")})


@query()
def context_choice(t: Tables) -> DataFrame:
    """The one-to-one choice between every two pictures of a session."""
    return context_pairs(in_context(t))
