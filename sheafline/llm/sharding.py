"""Shards by balanced label propagation, in DataFrame functions only.

Documents with equal texts are linked. A document starts in the shard its id hashes to. In each round a group's label in
every shard is the number of its members there, and members elsewhere ask for a shard that holds more of their group (of
equals, one drawn by a hash of group, shard and round). Rounds take turns: in one, members ask for the best shard that has
room and are let in as far as its quota goes, small groups first; in the next they ask for the best of all, and what shards
ask of each other in circles they exchange, so full shards move members too. Members of a group in one shard are
interchangeable, so rounds move counts by (group, shard), never single rows, and one group may be of any size. Every move
brings members together, so rounds end; they do when some in a row, each with its own draw, move nothing. Quotas are the
final row counts, so linked documents never overfill a shard; documents without links fill what is left. Law: `rows`,
shard counts at most one apart. A group larger than a shard has to be cut.

Ranks within a group, shard or request queue come from bucket counts (common.ranked), so no task holds a hot one.

Defined cases: null texts are equal to each other and have size 1; null doc_ids count as equal ids and take places of
their own; repeated rows too; with fewer rows than shards some stay empty; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ranked, released, staged

PATIENCE = 4


def _accepted(requests: DataFrame, caps: DataFrame, way: list[str], buckets: int = 1024) -> DataFrame:
    """Of requests (g, shard, target, n, all) the part (g, shard, target, n) that fits into caps (way, cap).

    Requests of small groups (all is a group's size) come first: those can be united whole.
    """
    before = Window.partitionBy(*way).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    order = F.floor(F.log2("all")).cast("int") * buckets + F.pmod(F.xxhash64("g", "shard"), F.lit(buckets)).cast("int")
    asked = requests.withColumn("b", order)
    offsets = asked.groupBy(*way, "b").agg(F.sum("n").alias("s")).withColumn("o", F.coalesce(F.sum("s").over(before), F.lit(0))).drop("s")
    inside = Window.partitionBy(*way, "b").orderBy("g", "shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        asked.withColumn("i", F.coalesce(F.sum("n").over(inside), F.lit(0)))
        .join(offsets.hint("merge"), [*way, "b"]).join(caps.hint("merge"), way)
        .withColumn("n", F.least("n", F.greatest(F.lit(0), F.col("cap") - F.col("o") - F.col("i"))))
    )
    return placed.filter("n > 0").select("g", "shard", "target", "n")


def circulation(asked: dict[tuple[int, int], int]) -> dict[tuple[int, int], int]:
    """The part of asked (from, to) that goes round in circles, shortest first, so that no shard's load changes."""
    left, out = dict(asked), {}
    while True:
        found: list[int] = []
        for start in sorted({s for s, _ in left}):
            came, reach = {start: start}, [start]
            for s in reach:  # breadth first: the shortest way back to start
                for t in sorted(t for (f, t) in left if f == s):
                    if t == start and (not found or len(found) > 2):
                        way = [s]
                        while way[-1] != start:
                            way.append(came[way[-1]])
                        found = min(found or way, way, key=len)
                    elif t not in came:
                        came[t] = s
                        reach.append(t)
        if not found:
            return out
        steps = list(zip(found, [found[-1], *found[:-1]], strict=True))  # found is the way backwards
        n = min(left[x] for x in steps)
        for x in steps:
            out[x] = out.get(x, 0) + n
            left[x] -= n
            if not left[x]:
                del left[x]


def _exchanged(requests: DataFrame) -> DataFrame | None:
    """(shard, target, cap): what shards ask of each other in circles."""
    asked = requests.groupBy("shard", "target").agg(F.sum("n").alias("n")).collect()  # at most a row for two shards
    caps = circulation({(r["shard"], r["target"]): r["n"] for r in asked})
    rows = ", ".join(f"({s}, {t}, {n})" for (s, t), n in caps.items())
    return requests.sparkSession.sql(f"SELECT * FROM VALUES {rows} AS caps(shard, target, cap)") if rows else None


def propagated(counts: DataFrame, quota: list[int], patience: int = PATIENCE) -> DataFrame:
    """counts (g, shard, n) after members have moved to their groups' shards under quota; totals by group stay."""
    n_shards = len(quota)
    spark = counts.sparkSession
    quotas = spark.range(n_shards).select(
        F.col("id").cast("int").alias("target"), F.element_at(F.array(*[F.lit(q) for q in quota]), F.col("id").cast("int") + 1).alias("quota")
    )
    quiet = turn = 0
    while quiet < patience:
        piece = F.struct("n", F.xxhash64("g", "shard", F.lit(turn)).alias("draw"), F.col("shard").alias("s"))
        if turn % 2:
            aims = counts.withColumn("cap", F.lit(1))
        else:
            load = counts.groupBy(F.col("shard").alias("target")).agg(F.sum("n").alias("load"))
            free = quotas.join(load.hint("merge"), "target", "left").select("target", (F.col("quota") - F.coalesce("load", F.lit(0))).alias("cap")).filter("cap > 0")
            aims = counts.join(free.withColumnRenamed("target", "shard").hint("merge"), "shard", "left")
        best = aims.groupBy("g").agg(F.max(F.when(F.col("cap").isNotNull(), piece)).alias("m"), F.sum("n").alias("all"), F.count("*").alias("pieces"))
        requests = counts.join(best.filter("pieces > 1 and m is not null").hint("merge"), "g").filter(piece < F.col("m"))
        requests = staged(requests.select("g", "shard", F.col("m.s").alias("target"), "n", "all"), "shards-requests")
        if turn % 2 and requests.isEmpty():
            break  # no group has two pieces
        caps, way = (_exchanged(requests), ["shard", "target"]) if turn % 2 else (free, ["target"])
        turn += 1
        quiet += 1
        if caps is None:
            released(requests)
            continue
        moves = staged(_accepted(requests, caps, way), "shards-moves")
        if not moves.isEmpty():
            quiet = 0
            changes = moves.select("g", F.col("target").alias("shard"), "n").unionByName(moves.select("g", "shard", (-F.col("n")).alias("n")))
            counts = staged(counts.unionByName(changes).groupBy("g", "shard").agg(F.sum("n").alias("n")).filter("n > 0"), "shards-counts")
        released(requests, moves)
    return counts


def shards(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of each row."""
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.md5(text).alias("g"), F.pmod(F.xxhash64(F.col(id_col)), F.lit(n_shards)).cast("int").alias("start"),
    )
    rows = staged(rows, "shards-rows")
    total = rows.count()
    buckets = max(256, total // 4096)  # of which each has about 4096 rows
    quota = [total // n_shards + (i < total % n_shards) for i in range(n_shards)]
    sizes = rows.groupBy("g").agg(F.count("*").alias("all"))
    members = staged(rows.join(sizes.hint("merge"), "g"), "shards-members")
    linked, single = members.filter("all > 1"), members.filter("all = 1")
    starts = linked.groupBy("g", F.col("start").alias("shard")).agg(F.count("*").alias("n"))
    starts = staged(_within_quota(starts, quota), "shards-starts")
    counts = propagated(starts, quota)

    # A group's members are numbered; its shards own consecutive runs of those numbers.
    runs = counts.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("shard", "n"))).alias("runs"))
    numbered = ranked(linked.select("g", "doc_id", "size", "text_crc32"), ["g"], ["doc_id", "text_crc32"], "number", buckets)
    salted = numbered.withColumn("salt", F.when(F.col("number") < 4096, F.lit(0)).otherwise(F.col("number") / 4096).cast("int"))
    spread = counts.groupBy("g").agg(F.sum("n").alias("all")).join(runs.hint("merge"), "g").select(
        "g", "runs", F.explode(F.sequence(F.lit(0), (F.col("all") / 4096).cast("int"))).alias("salt")
    )
    at = F.aggregate(
        "runs", F.struct(F.lit(0).cast("long").alias("end"), F.lit(None).cast("int").alias("shard")),
        lambda a, x: F.struct((a["end"] + x["n"]).alias("end"), F.when(a["shard"].isNull() & (F.col("number") < a["end"] + x["n"]), x["shard"]).otherwise(a["shard"]).alias("shard")),
    )["shard"]
    placed = salted.join(spread.hint("merge"), ["g", "salt"]).select("doc_id", "size", "text_crc32", at.alias("shard"))

    # Documents without links fill the room that is left.
    load = {r["shard"]: r["n"] for r in counts.groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # n_shards rows
    ends, end = [], 0
    for i in range(n_shards):
        end += quota[i] - load.get(i, 0)
        ends.append(end)
    filler = F.lit(None).cast("int")
    for i in reversed(range(n_shards)):
        filler = F.when(F.col("number") < ends[i], F.lit(i)).otherwise(filler)
    filled = ranked(single.withColumn("one", F.lit(0)), ["one"], ["doc_id", "text_crc32"], "number", buckets)
    everyone = placed.unionByName(filled.select("doc_id", "size", "text_crc32", filler.alias("shard")))
    slots = ranked(staged(everyone, "shards-placed"), ["shard"], ["doc_id", "text_crc32"], "slot", buckets)
    return slots.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def _within_quota(starts: DataFrame, quota: list[int]) -> DataFrame:
    """starts (g, shard, n) with what a shard cannot hold moved to shards with room."""
    load = {r["shard"]: r["n"] for r in starts.groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # one row a shard
    over = {i: load.get(i, 0) - q for i, q in enumerate(quota)}
    while any(v > 0 for v in over.values()):
        source = max(over, key=lambda i: over[i])
        target = min(over, key=lambda i: over[i])
        n = min(over[source], -over[target])
        free = starts.sparkSession.range(1).select(F.lit(source).alias("shard"), F.lit(target).alias("target"), F.lit(n).alias("cap"))
        asked = starts.filter(F.col("shard") == source).withColumns({"target": F.lit(target), "all": F.col("n")})
        moves = staged(_accepted(asked, free, ["shard", "target"]), "shards-over")
        changes = moves.select("g", F.col("target").alias("shard"), "n").unionByName(moves.select("g", "shard", (-F.col("n")).alias("n")))
        starts = staged(starts.unionByName(changes).groupBy("g", "shard").agg(F.sum("n").alias("n")).filter("n > 0"), "shards-starts")
        over[source] -= n
        over[target] += n
    return starts
