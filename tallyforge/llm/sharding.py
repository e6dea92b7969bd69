"""Balanced label propagation: linked documents move to their neighbours' shards under quotas.

Documents are linked through hubs (a hub is anything two or more documents share, here an equal text), so no pairs of a
group are ever formed. A document's home is its smallest hub. Homes are placed first: in each round, joins count each
hub's placed members by shard, homes with placed neighbours ask for the shard with most of them, an eighth of the others
asks for any, and a shard admits whole hash bins of homes while its quota lasts. Then placed documents move: in each round, joins count every document's neighbours
by shard, a document that has more of them elsewhere asks to move there, and moves are admitted by hash bins while the
quotas hold, bins of opposite direction against each other. Documents that nothing links fill the shards up to counts at
most one apart.

What reaches the driver has a fixed bound: the fill of ``shards`` shards, ``shards * BINS`` counts of homes that ask,
``shards**2 * MOVE_BINS`` counts of moves and at most ``shards * HEAVY`` homes that are larger than 1/HEAVY of a shard
(and than HEAVY documents), which are spread over as few shards as hold them. A document has one home, so no more homes than that can be so large.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import discard, materialize

BINS = 256
HEAVY = 16
MOVE_BINS = 16
#: Share of the homes without placed neighbours that is placed in a round, one in SEEDS.
SEEDS = 8
#: Moves may fill a shard beyond its quota by one in SLACK; the surplus is evened out at the end.
SLACK = 32
#: Rows numbered by one task.
NUMBERED = 100_000


def _pick(values: list[int], at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(int(v)).cast("long") for v in values]), at + 1)


def _spread_heavy(heavy: list[tuple[str, int]], free: list[int]) -> list[tuple[str, int, int, int, int]]:
    """(hub, members, from, to, shard): hash ranges of each heavy hub's members, in as few shards as hold them."""
    out = []
    for hub, n in sorted(heavy, key=lambda x: (-x[1], x[0])):
        done = 0
        while done < n and max(free) > 0:
            rest = n - done
            fits = [s for s, f in enumerate(free) if f >= rest]
            s = min(fits, key=lambda i: (free[i], i)) if fits else max(range(len(free)), key=lambda i: (free[i], -i))
            take = min(rest, free[s])
            out.append((hub, n, done, done + take, s))
            free[s] -= take
            done += take
    return out


def _neighbours(links: DataFrame, placed: DataFrame) -> DataFrame:
    """(hub, shard, votes): how many of a hub's members are in each shard; at most ``shards`` rows a hub."""
    return links.join(placed, "doc_id").groupBy("hub", "shard").agg(F.count(F.lit(1)).alias("votes"))


def _place_homes(links: DataFrame, homes: DataFrame, placed: DataFrame, free: list[int], rounds: int) -> DataFrame:
    """Places the documents of ``homes`` (doc_id, home) beside ``placed`` ones; ``free`` is what the shards still take.

    Homes that no other hub links are placed in the first round, all that are left in the last two.
    """
    outside = links.join(homes, "doc_id").where("hub <> home").select("home").distinct().withColumn("linked", F.lit(True))
    state = materialize(homes.join(outside, "home", "left").select("doc_id", "home", F.coalesce("linked", F.lit(False)).alias("linked")), "state")
    for n in range(rounds):
        if state.isEmpty():
            break
        open_ = [s for s, f in enumerate(free) if f > 0]
        if not open_:
            break
        votes = _neighbours(links, placed).where(F.col("shard").isin(open_))
        wish = links.join(state.where("linked"), "doc_id").join(votes, "hub").groupBy("home", "shard").agg(F.sum("votes").alias("votes"))
        wish = wish.groupBy("home").agg(F.max_by("shard", F.struct("votes", F.xxhash64("home", "shard"))).alias("wish"))
        fallback = _pick(open_, F.pmod(F.xxhash64(F.lit(n), "home"), F.lit(len(open_))).cast("int")).cast("int")
        seed = F.pmod(F.xxhash64(F.lit("seed"), "home"), F.lit(SEEDS)) == n % SEEDS
        asks = F.col("wish").isNotNull() | ~F.col("linked") | seed | F.lit(n >= rounds - 2)
        asked = state.join(wish, "home", "left").select("doc_id", "home", "linked", asks.alias("asks"), F.coalesce("wish", fallback).alias("wish"), F.pmod(F.xxhash64(F.lit("bin"), "home"), F.lit(BINS)).alias("bin"))
        asked = materialize(asked, "asked")
        demand = {(r.wish, r.bin): r.n for r in asked.where("asks").groupBy("wish", "bin").agg(F.count(F.lit(1)).alias("n")).collect()}
        admitted = []
        for (s, b), need in sorted(demand.items()):
            if need <= free[s]:
                free[s] -= need
                admitted.append(s * BINS + b)
        ok = F.col("asks") & (F.col("wish") * BINS + F.col("bin")).isin(admitted)
        placed = materialize(placed.unionByName(asked.where(ok).select("doc_id", F.col("wish").alias("shard"))), "placed")
        state = materialize(asked.where(~ok).select("doc_id", "home", "linked"), "state")
        discard(asked)
    return placed


def admitted_moves(demand: dict[tuple[int, int, int], int], free: list[int]) -> list[tuple[int, int, int]]:
    """Which (from, to, bin) moves of so many documents the shards take, ``free`` being what each still takes.

    A move into room comes first; where a shard is full, moves of opposite direction are set against each other.
    """
    out, left = [], dict(sorted(demand.items(), key=lambda x: (-x[1], x[0])))
    moved = True
    while moved:
        moved = False
        for (s, t, b), n in list(left.items()):
            back = [(k, m) for k, m in left.items() if k[0] == t and k[1] == s and n - m <= free[t] and m - n <= free[s]] if n > free[t] else []
            if n <= free[t] or back:
                for (x, y, z), m in [((s, t, b), n), *back[:1]]:
                    free[x], free[y] = free[x] + m, free[y] - m
                    out.append((x, y, z))
                    del left[x, y, z]
                moved = True
                break
    return out


def _move(links: DataFrame, placed: DataFrame, free: list[int], rounds: int) -> DataFrame:
    """Placed documents with more neighbours in another shard than in theirs move there while quotas hold.

    A third of the documents is asked each round, so that neighbours do not all change places at once.
    """
    several = materialize(links.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"), "several-hubs")
    if several.isEmpty():
        return placed
    mine = materialize(links.join(several, "doc_id").select("doc_id", "hub"), "several-links")
    idle = 0
    for n in range(3 * rounds):
        asked = mine.where(F.pmod(F.xxhash64("doc_id"), F.lit(3)) == n % 3).join(placed.withColumnRenamed("shard", "here"), "doc_id")
        tally = asked.join(_neighbours(links, placed), "hub").groupBy("doc_id", "here", "shard").agg(F.sum("votes").alias("votes"), F.count(F.lit(1)).alias("hubs"))
        own = F.when(F.col("shard") == F.col("here"), F.col("hubs")).otherwise(0)  # a document is no neighbour of its own
        wish = tally.groupBy("doc_id", "here").agg(
            F.max_by("shard", F.struct(F.col("votes") - own, F.col("shard") == F.col("here"), F.xxhash64("doc_id", "shard"))).alias("shard"),
            F.max(F.col("votes") - own).alias("most"), F.sum(F.when(F.col("shard") == F.col("here"), F.col("votes") - own).otherwise(0)).alias("now"),
        )
        wish = materialize(wish.where(F.col("most") > F.col("now")).select("doc_id", "here", "shard", F.pmod(F.xxhash64(F.lit(n), "doc_id"), F.lit(MOVE_BINS)).cast("int").alias("bin")), "wishes")
        demand = {(r.here, r.shard, r.bin): r.n for r in wish.groupBy("here", "shard", "bin").agg(F.count(F.lit(1)).alias("n")).collect()}
        taken = admitted_moves(demand, free)
        idle = 0 if taken else idle + 1
        if taken:
            moves = wish.where(((F.col("here") * len(free) + F.col("shard")) * MOVE_BINS + F.col("bin")).isin([(s * len(free) + t) * MOVE_BINS + b for s, t, b in taken]))
            placed = materialize(placed.join(moves.select("doc_id", F.col("shard").alias("to")), "doc_id", "left").select("doc_id", F.coalesce("to", "shard").alias("shard")), "placed")
        discard(wish)
        if idle == 3:
            break
    return placed


def propagate(links: DataFrame, shards: int, quota: int, rounds: int = 6) -> DataFrame:
    """(doc_id, shard) for the documents that found room; ``links`` is (doc_id, hub), each shard takes ``quota`` at most.

    Moves may go beyond the quota by one in SLACK. A document may have several hubs. Hubs with one member link nothing. Documents left over after ``rounds`` (their
    neighbours' shards were full) are not in the result.
    """
    spark = links.sparkSession
    links = links.where("doc_id is not null and hub is not null").distinct()
    # written, so that the join is between two exchanges and Spark can split a hot hub
    sized = materialize(links.groupBy("hub").agg(F.count(F.lit(1)).alias("members")).where("members > 1"), "hubs")
    links = materialize(links.join(sized, "hub").select("doc_id", "hub", "members"), "links")
    homes = links.groupBy("doc_id").agg(F.min_by("hub", F.struct("members", "hub")).alias("home"))
    counts = materialize(homes.groupBy("home").agg(F.count(F.lit(1)).alias("n")), "home-counts")
    homes = materialize(homes, "homes")
    free = [quota] * shards
    large = max(HEAVY, quota // HEAVY)
    heavy = [(r.home, r.n) for r in counts.where(F.col("n") > large).collect()]
    parts = spark.createDataFrame(_spread_heavy(heavy, free), "home string, members long, low long, high long, shard int")
    at = F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.col("members"))
    # hash ranges are not met to the document: a shard may get a few more than its quota, which fill_shards moves on
    placed = materialize(homes.join(F.broadcast(parts), "home").withColumn("at", at).where("at >= low and at < high").select("doc_id", "shard"), "placed")
    rest = homes.join(F.broadcast(parts.select("home").distinct()), "home", "left_anti")
    links = links.select("doc_id", "hub")
    placed = _place_homes(links, rest, placed, free, rounds)
    return _move(links, placed, [f + max(1, quota // SLACK) for f in free], rounds)


def fill_shards(rows: DataFrame, shards: int) -> DataFrame:
    """Numbers rows (columns doc_id, size, text_crc32, want) into shards whose counts are at most one apart.

    Rows that want a shard come first there; the rows beyond a shard's share, unlinked ones before all others, move to
    the shards that are short. Adds shard and slot (0, 1, ... in every shard). Counts by hash bucket are summed to
    offsets, so no task numbers more than a bucket.
    """
    tag = F.pmod(F.monotonically_increasing_id(), F.lit(1 << 20))  # deals out rows that are equal in all columns
    rows = rows.withColumn("tag", tag).withColumn("free", F.col("want").isNull().cast("int")).withColumn("home", F.coalesce("want", F.pmod(F.xxhash64(F.lit("home"), "doc_id", "text_crc32", "tag"), F.lit(shards)).cast("int")))
    rows = materialize(rows, "rows")
    held = {r.home: r.n for r in rows.groupBy("home").agg(F.count(F.lit(1)).alias("n")).collect()}
    held = [held.get(s, 0) for s in range(shards)]
    total = sum(held)
    share = [total // shards + (s < total % shards) for s in range(shards)]
    over_before, short_before, over, short = [], [], 0, 0
    for h, t in zip(held, share, strict=True):
        over_before.append(over)
        short_before.append(short)
        over, short = over + max(0, h - t), short + max(0, t - h)
    buckets = max(8, -(-total // (shards * NUMBERED)))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32", "size", "tag"), F.lit(buckets)))
    counts = rows.groupBy("home", "free", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("home").orderBy("free", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("home", "free", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("home", "free", "bucket").orderBy("doc_id", "text_crc32", "size")
    rows = rows.withColumn("nth", F.row_number().over(inside)).join(counts, ["home", "free", "bucket"]).withColumn("at", F.col("offset") + F.col("nth") - 1)
    stays = F.col("at") < _pick(share, F.col("home"))
    spare = F.col("at") - _pick(share, F.col("home")) + _pick(over_before, F.col("home"))
    target = F.lit(0)
    for s in range(shards):
        if share[s] > held[s]:
            target = F.when(spare >= short_before[s], s).otherwise(target)
    slot = F.when(stays, F.col("at")).otherwise(spare - _pick(short_before, F.col("shard")) + _pick(held, F.col("shard")))
    return rows.withColumn("shard", F.when(stays, F.col("home")).otherwise(target).cast("int")).withColumn("slot", slot.cast("long"))


def assign_shards(docs: DataFrame, shards: int = 24, links: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", rounds: int = 6) -> DataFrame:
    """doc_id, size, text_crc32, hub, shard (from 0) and slot (gapless from 0 in each shard) for every row.

    ``links`` (doc_id, hub) names what documents share; without it, equal texts are linked. size is the text's UTF-8
    bytes plus 8, text_crc32 the unsigned CRC-32 of those bytes. Shard counts are at most one apart.

    A null text has no bytes (size 8, CRC 0) and no link; empty texts are equal and so linked. Rows that repeat a doc_id
    are placed one by one. Rows without doc_id are placed as unlinked. With fewer rows than shards, some shards stay
    empty; an empty table gives an empty result. Columns other than the two named are not read.
    """
    text = F.col(text_col).cast("string")
    raw = F.coalesce(text, F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(raw) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.md5(text.cast("binary")).alias("hub"))
    rows = materialize(rows, "sized")
    quota = rows.count() // shards
    links = rows.select("doc_id", "hub") if links is None else links.select(F.col("doc_id").cast("long"), F.col("hub").cast("string"))
    label = propagate(links, shards, quota, rounds).groupBy("doc_id").agg(F.min("shard").alias("want"))
    return fill_shards(rows.join(label, "doc_id", "left"), shards).select("doc_id", "size", "text_crc32", "hub", "shard", "slot")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: all documents in shards 0 to 23, counts at most one apart, equal texts together."""
    out = assign_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
