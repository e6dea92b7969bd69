"""Event queries. A user's events are the frames of a capture."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.entity import constrained_clusters, greedy_swaps, representatives
from ..streaming.live import live_segments
from ..streaming.segments import contiguous_prefix, folded, hidden_copies, ingested_once, segments
from ..streaming.watching import frame_kinds
from .registry import Tables, query


def frames(t: Tables) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "empty").when(F.col("value") > 60, "fast").when(F.col("value") > 35, "unstable").otherwise("stable")
    return t.events.select(F.col("user_id").alias("capture"), F.col("event_id").alias("idx"), kind.alias("kind"), F.xxhash64(F.floor(F.col("value") / 10)).alias("sig"), (F.col("value") / 100).alias("x"))


@query("""
WITH RECURSIVE f AS (
  SELECT user_id AS capture, event_id AS idx, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n,
    CASE WHEN event_type = 'error' THEN 3 WHEN value > 60 THEN 2 WHEN value > 35 THEN 1 ELSE 0 END AS k, floor(value / 10) AS art, value / 100 AS x FROM events
), m AS (
  SELECT DISTINCT user_id AS capture, 0::BIGINT AS n, 0 AS number, -1::BIGINT AS first, -1::BIGINT AS last, 0 AS frames, 0::DOUBLE AS art, 0::DOUBLE AS x, 0 AS worst, 0 AS waits,
    NULL::STRUCT(number INTEGER, first BIGINT, last BIGINT, frames INTEGER, why VARCHAR) AS told FROM events
  UNION ALL
  SELECT capture, n, number + CASE WHEN why IS NULL THEN 0 ELSE 1 END, CASE WHEN k = 0 AND (frames = 0 OR why IS NOT NULL) THEN idx ELSE first END, CASE WHEN k = 0 THEN idx ELSE last END,
    CASE WHEN why IS NOT NULL THEN 0 ELSE frames END + CASE WHEN k = 0 THEN 1 ELSE 0 END, CASE WHEN k = 0 THEN new_art ELSE art END, CASE WHEN k = 0 THEN new_x ELSE x END,
    CASE WHEN k = 0 THEN 0 ELSE greatest(worst, k) END, CASE WHEN k = 0 THEN 0 ELSE waits + 1 END,
    CASE WHEN why IS NOT NULL THEN {'number': number + 1, 'first': first, 'last': last, 'frames': frames, 'why': why} END
  FROM (SELECT m.capture, f.n, m.number, m.first, m.last, m.frames, m.art, m.x, m.worst, m.waits, f.k, f.idx, f.art AS new_art, f.x AS new_x,
      CASE WHEN m.frames = 0 THEN NULL WHEN f.k = 3 AND m.waits >= 1 THEN 'empty' WHEN f.k <> 0 THEN NULL WHEN m.worst >= 2 THEN 'moved'
        WHEN f.art <> m.art THEN 'changed' WHEN m.worst = 1 AND 1 - abs(f.x - m.x) < 0.7 THEN 'shifted' END AS why
    FROM m JOIN f ON f.capture = m.capture AND f.n = m.n + 1)
), e AS (SELECT capture, arg_max({'number': number + 1, 'first': first, 'last': last, 'frames': frames, 'why': 'end'}, n) AS told FROM m GROUP BY 1)
SELECT capture, told.number AS number, told.first AS first, told.last AS last, told.frames AS frames, told.why AS why FROM m WHERE told IS NOT NULL
UNION ALL SELECT capture, told.number, told.first, told.last, told.frames, told.why FROM e WHERE told.frames > 0
""")
def segment_events(t: Tables) -> DataFrame:
    return segments(frames(t))


def live_frames(t: Tables) -> DataFrame:
    """Frames whose signature is the day's, one of three, and the picture's score."""
    art = F.xxhash64(F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 86_400) % 3)
    return frames(t).join(t.events.select(F.col("event_id").alias("idx"), art.alias("art")), "idx").select("capture", "idx", "kind", F.col("art").alias("sig"), (1 - F.col("x")).alias("x"))


@query()
def kinds_of_frames(t: Tables) -> DataFrame:
    """Events as outlines that shift with their value; errors show none."""
    v = F.col("value")
    x, y = 100 + v % 9, 100 + (v * 10) % 7
    side = F.when(v > 120, 40.0).when(v > 90, 110.0).otherwise(80 + v % 5)
    quad = F.when(F.col("event_type") != "error", F.array(x, y, x + side, y, x + side, y + side, x, y + side))
    day = F.dayofmonth(F.col("ts")) % 3
    rows = t.events.select(F.col("user_id").alias("capture"), F.col("event_id").alias("idx"), quad.alias("quad"), (15 + v % 40).alias("sharp"), ((v * 100) % 100).alias("score"), F.xxhash64(day).alias("sig"))
    return frame_kinds(rows)


@query()
def segment_live(t: Tables) -> DataFrame:
    held = frames(t).withColumn("sig", F.col("capture") % 3).withColumn("x", 1 - F.col("x"))
    return live_segments(held).select("capture", "number", "emitted", "frames", "doubtful", "best")


@query()
def segment_live_answers(t: Tables) -> DataFrame:
    """Groups told live while every sign-up asks for another frame of the first groups and large values reject them."""
    asked = t.events.select(F.col("user_id").alias("capture"), F.col("event_id").alias("idx"), F.when(F.col("event_type") == "signup", "rearm").when(F.col("value") > 100, "reject").alias("kind"), (F.col("event_id") % 3 + 1).alias("number"))
    return live_segments(live_frames(t), asked.where("kind is not null"))


@query("""
WITH a AS (SELECT user_id AS capture, list(value ORDER BY event_id) AS v FROM events GROUP BY 1 HAVING count(*) >= 10),
c AS (SELECT capture, v, unnest(range(5, len(v) - 4)) AS cut FROM a),
s AS (SELECT capture, cut, list_sort(v[1:cut]) AS x, list_sort(v[cut + 1:]) AS y FROM c),
g AS (SELECT capture, cut, abs(x[(len(x) - 1) // 2 + 1] - y[(len(y) - 1) // 2 + 1]) AS gap FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY capture ORDER BY gap DESC, cut) AS k FROM g)
SELECT capture, CAST(cut AS INTEGER) AS cut, round(gap, 6) AS gap FROM r WHERE k = 1 AND gap >= 1.8
""")
def hidden_copy_cuts(t: Tables) -> DataFrame:
    """Where the measurements of a long group change most."""
    rows = t.events.groupBy(F.col("user_id").alias("capture")).agg(F.sort_array(F.collect_list(F.struct("event_id", "value"))).alias("x"))
    rows = rows.select("capture", F.lit(1).alias("number"), F.transform("x", lambda e: e["value"]).alias("angles"))
    return hidden_copies(rows).drop("number")


@query("""
WITH g AS (SELECT conv_id AS capture, turn + 1 AS number, conv_id % 5 = 0 AS final FROM conversations WHERE (conv_id + turn) % 4 <> 2),
n AS (SELECT *, row_number() OVER (PARTITION BY capture ORDER BY number) AS nth, bool_or(final) OVER (PARTITION BY capture) AS over_ FROM g)
SELECT capture, number FROM n WHERE nth = number OR over_
""")
def contiguous_groups(t: Tables) -> DataFrame:
    groups = t.conversations.where("(conv_id + turn) % 4 <> 2").select(F.col("conv_id").alias("capture"), (F.col("turn") + 1).alias("number"), (F.col("conv_id") % 5 == 0).alias("final"))
    return contiguous_prefix(groups, "capture", "number", "final").select("capture", "number")


@query("SELECT DISTINCT user_id, event_type FROM events")
def dedupe_ingest(t: Tables) -> DataFrame:
    return ingested_once(t.events.select("user_id", "event_type").unionByName(t.events.select("user_id", "event_type")), ["user_id", "event_type"])


@query("SELECT user_id, event_id FROM events WHERE event_id % greatest(1, CAST(round(23 / 10) AS INTEGER)) = 0")
def sampled_frames(t: Tables) -> DataFrame:
    """Every round(fps / 10)-th frame."""
    step = max(1, round(23 / 10))
    return t.events.where(F.col("event_id") % step == 0).select("user_id", "event_id")


@query("SELECT event_id, CASE WHEN value <= 1 THEN 'noise' WHEN props LIKE '%7%' THEN 'noise' WHEN value < 3 THEN 'note' ELSE 'kept' END AS status FROM events")
def status_downgrades(t: Tables) -> DataFrame:
    status = F.when(F.col("value") <= 1, "noise").when(F.col("props").contains("7"), "noise").when(F.col("value") < 3, "note").otherwise("kept")
    return t.events.select("event_id", status.alias("status"))


@query("SELECT user_id, max(event_id) AS version FROM events WHERE event_id > 5000 GROUP BY 1")
def changed_since(t: Tables) -> DataFrame:
    """Poll by version: what changed after a version one has seen."""
    return t.events.where("event_id > 5000").groupBy("user_id").agg(F.max("event_id").alias("version"))


@query("SELECT DISTINCT user_id, event_type FROM events e WHERE event_id > 5000 AND NOT EXISTS (SELECT 1 FROM events s WHERE s.event_id <= 5000 AND s.user_id = e.user_id AND s.event_type = e.event_type)")
def notices_once(t: Tables) -> DataFrame:
    """Notices not sent before."""
    sent = t.events.where("event_id <= 5000").select("user_id", "event_type")
    return t.events.where("event_id > 5000").select("user_id", "event_type").distinct().join(sent, ["user_id", "event_type"], "left_anti")


@query("""
WITH RECURSIVE g AS (
  SELECT user_id AS capture, event_id AS number, event_type AS item, CAST(trunc(value) AS BIGINT) % 30 + 1 AS frames, event_id % 6 AS before, event_id % 3 = 0 AS gone,
    row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, median(CAST(trunc(value) AS BIGINT) % 30 + 1) OVER (PARTITION BY user_id) AS middle FROM events
), m AS (
  SELECT capture, n, number, item, frames, 1 AS merged, 0 AS ended FROM g WHERE n = 1
  UNION ALL
  SELECT g.capture, g.n, CASE WHEN joins THEN s.number ELSE g.number END, g.item, g.frames + CASE WHEN joins THEN s.frames ELSE 0 END, CASE WHEN joins THEN s.merged + 1 ELSE 1 END, 0
  FROM (SELECT m.capture, m.n, m.number, m.frames, m.merged, coalesce(m.item = h.item AND (NOT h.gone OR (h.frames < 4 AND h.before <= 3 AND m.frames + h.frames <= 1.6 * h.middle)), false) AS joins
    FROM m JOIN g h ON h.capture = m.capture AND h.n = m.n + 1) s JOIN g ON g.capture = s.capture AND g.n = s.n + 1
)
SELECT capture, number, arg_max(item, n) AS item, max(frames) AS frames, max(merged) AS merged FROM m GROUP BY 1, 2
""")
def fragment_fold(t: Tables) -> DataFrame:
    groups = t.events.select(F.col("user_id").alias("capture"), F.col("event_id").alias("number"), F.col("event_type").alias("item"), (F.col("value").cast("long") % 30 + 1).alias("frames"), (F.col("event_id") % 6).alias("gap_before"), (F.col("event_id") % 3 == 0).alias("left"))
    return folded(groups)


@query()
def cluster_dedup(t: Tables) -> DataFrame:
    """Events of a user as detections; each may be the same thing as the next three of its range of values."""
    d = t.events.select(F.col("user_id").alias("session"), F.col("event_id").alias("id"), F.dayofmonth("ts").alias("capture"), F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("identity"), F.floor(F.col("value") / 4).alias("v"), "value")
    near = Window.partitionBy("session", "v").orderBy("value", "id")
    after = F.array(*[F.struct(F.lead("id", i).over(near).alias("id"), F.lead("value", i).over(near).alias("value")) for i in (1, 2, 3)])
    pairs = d.withColumn("after", after).select("session", F.col("id").alias("a"), "value", F.explode("after").alias("x")).where("x.id is not null")
    pairs = pairs.select("session", F.least("a", "x.id").alias("a"), F.greatest("a", "x.id").alias("b"), (-F.abs(F.col("value") - F.col("x.value"))).alias("score"), F.lit(False).alias("forced"))
    return constrained_clusters(d, pairs)


@query("""
WITH r AS (SELECT user_id AS session, event_type AS cluster, event_id AS id, value AS confidence, event_id % 2 AS identified,
  row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id % 2 DESC, value DESC, ts, event_id) AS nth FROM events)
SELECT session, cluster, id FROM r WHERE nth = 1
""")
def cluster_representative(t: Tables) -> DataFrame:
    rows = t.events.select(F.col("user_id").alias("session"), F.col("event_type").alias("cluster"), F.col("event_id").alias("id"), F.col("value").alias("confidence"), (F.col("event_id") % 2).alias("identified"), F.col("ts").alias("seq"))
    return representatives(rows).where("nth = 1").select("session", "cluster", "id")


@query()
def likely_swaps(t: Tables) -> DataFrame:
    missing = t.part.where("p_partkey % 2 = 0").select("p_type", F.col("p_partkey").alias("id"), "p_size")
    extra = t.part.where("p_partkey % 2 = 1").select("p_type", F.col("p_partkey").alias("id"), "p_size")
    return greedy_swaps(missing, extra, ["p_type"], "p_size")


@query("""
SELECT epoch(time_bucket(INTERVAL 6 HOUR, ts)) // 1 AS opens, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2
""")
def tumbling_events(t: Tables) -> DataFrame:
    """Tumbling windows, an analogue that the usual stream tools have."""
    return t.events.groupBy(F.window(F.col("ts").cast("timestamp"), "6 hours").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.unix_timestamp("w.start").cast("double").alias("opens"), "event_type", "n", "total")


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOUR OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g)
SELECT user_id, count(DISTINCT s) AS sessions, count(*) AS n FROM s GROUP BY 1
""")
def session_events(t: Tables) -> DataFrame:
    """Session windows of a gap of two hours."""
    w = t.events.groupBy("user_id", F.session_window(F.col("ts").cast("timestamp"), "2 hours")).agg(F.count(F.lit(1)).alias("k"))
    return w.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.sum("k").alias("n"))
