"""Balanced label propagation: shards of even row counts that keep linked documents together.

Documents with equal texts are linked. A group's rows with the same shard are interchangeable, so
the state is the number of rows of each (group, shard). In each round a part moves to the shard that
its group votes for, as far as quotas go; what leaves a shard in a round makes room for what comes.
Large groups, of which a shard holds few, are placed before. Rows without links follow last and even
out the counts, so the law `rows` holds exactly: the shards' counts are at most one apart.

Cases: a null text counts as empty, size 1, and is linked with other empty texts; null and
repeated ids are rows of their own; a group larger than a shard fills some shards and cuts few
links; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from supplylens.llm.common import durable, ranked, read, shuffle_width

SHARDS, ROUNDS = 8, 12
BUCKETS = 256


def described(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.unhex(F.md5(text)).alias("grp"),
    )


def _numbers(values: list[int]) -> Column:
    return F.array(*(F.lit(v).cast("long") for v in values))


def _place(groups: list, room: list[int]) -> list[tuple]:
    """Parts (grp, [(shard, n)]) of large groups: whole where one fits, by its own votes first, else as few parts as fit."""
    out = []
    for grp, parts in sorted(groups, key=lambda g: (-sum(p["n"] for p in g[1]), bytes(g[0]))):
        left, found = sum(p["n"] for p in parts), []
        own = [p["shard"] for p in sorted(parts, key=lambda p: (-p["n"], p["shard"])) if room[p["shard"]] >= left]
        while left:
            goal = own[0] if own else max(range(len(room)), key=lambda s: room[s])
            n = min(left, room[goal]) if room[goal] > 0 else left
            room[goal] -= n
            left -= n
            found.append((goal, n))
        out.append((bytes(grp), found))
    return out


def _limits(wishes: dict[tuple[int, int], list[int]], load: list[int], target: list[int]) -> list[int]:
    """How many of each flow's (from, to) BUCKETS move, so that all moves at once leave no shard above its target."""
    shards = len(load)
    limit, after = {k: BUCKETS for k in wishes}, list(load)
    for (s, t), sums in wishes.items():
        after[s] -= sum(sums)
        after[t] += sum(sums)
    into = {t: [k for k in wishes if k[1] == t] for t in range(shards)}
    while True:
        full = [t for t in range(shards) if after[t] > target[t] and any(limit[k] for k in into[t])]
        if not full:
            return [limit.get((s, t), 0) for s in range(shards) for t in range(shards)]
        t = max(full, key=lambda x: after[x] - target[x])
        # What stays goes back to the shard with the most room.
        k = max((k for k in into[t] if limit[k]), key=lambda k: (target[k[0]] - after[k[0]], limit[k]))
        limit[k] -= 1
        after[t] -= wishes[k][limit[k]]
        after[k[0]] += wishes[k][limit[k]]


def propagate(state: DataFrame, total: int, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """Move the parts (grp, shard, n) of linked groups together under quotas.

    Moves out of a shard make room for moves into it in the same round, so full shards swap parts.
    """
    target = [total // shards + (s < total % shards) for s in range(shards)]
    least = max(8, total // shards // 64)
    groups = state.groupBy("grp").agg(F.collect_list(F.struct("shard", "n")).alias("parts"), F.sum("n").alias("all"))
    groups = durable(groups, "groups")
    small = groups.where(F.col("all") < least).select("grp", "parts")
    load = [0] * shards
    for r in small.select(F.explode("parts").alias("p")).groupBy("p.shard").agg(F.sum("p.n").alias("n")).collect():
        load[r["shard"]] = r["n"]
    # At most 65 groups for each shard.
    large = [(r["grp"], r["parts"]) for r in groups.where(F.col("all") >= least).collect()]
    placed = _place(large, [t - n for t, n in zip(target, load, strict=True)])
    for _, parts in placed:
        for s, n in parts:
            load[s] += n
    for turn in range(rounds):
        # A group's home is its largest part, and in every other round any of its parts; ties go by a hash.
        vote = f"transform(parts, p -> struct({'p.n' if turn % 2 == 0 else '0L'} AS n, xxhash64(grp, p.shard, {turn}) AS h, p.shard AS shard))"
        wanted = small.withColumn("home", F.expr(f"array_max({vote}).shard"))
        bucket = f"cast(pmod(xxhash64(grp, p.shard, {turn}, 1), {BUCKETS}) AS int)"
        # At most BUCKETS rows for each pair of shards.
        flows = wanted.select("grp", "home", F.explode("parts").alias("p")).where("p.shard <> home")
        wishes: dict[tuple[int, int], list[int]] = {}
        for r in flows.groupBy("p.shard", "home", F.expr(bucket).alias("bucket")).agg(F.sum("p.n").alias("n")).collect():
            wishes.setdefault((r["shard"], r["home"]), [0] * BUCKETS)[r["bucket"]] = r["n"]
        if not wishes:
            break
        limits = _limits(wishes, load, target)
        for (s, t), sums in wishes.items():
            moved = sum(sums[: limits[s * shards + t]])
            load[s] -= moved
            load[t] += moved
        if any(limits):
            at = F.array(*(F.lit(x) for x in limits))
            go = wanted.withColumn("limits", at).select("grp", F.expr(f"transform(parts, p -> struct(if(p.shard <> home AND {bucket} < limits[p.shard * {shards} + home], home, p.shard) AS shard, p.n AS n))").alias("p"))
            joined = F.expr("transform(array_sort(array_distinct(p.shard)), s -> struct(s AS shard, aggregate(filter(p, x -> x.shard = s), 0L, (a, x) -> a + x.n) AS n))")
            small = durable(go.select("grp", joined.alias("parts")), f"parts{turn}")
    spark = state.sparkSession
    both = small.unionByName(spark.createDataFrame(placed, "grp binary, parts array<struct<shard:int,n:bigint>>"))
    return both.select("grp", F.explode("parts").alias("p")).select("grp", "p.*").groupBy("grp", "shard").agg(F.sum("n").alias("n"))


def shard(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard for every row."""
    spark = docs.sparkSession
    rows = durable(described(docs, id_col, text_col), "described")
    total = rows.count()
    first = F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(shards)).cast("int")
    linked = rows.groupBy("grp", first.alias("shard")).agg(F.count("*").alias("n"))
    linked = linked.withColumn("all", F.sum("n").over(Window.partitionBy("grp"))).where("all > 1").drop("all")
    state = durable(propagate(durable(linked, "parts"), total, shards, rounds), "state")

    # The k-th row of a group, counted through its salts, goes to the part that holds place k.
    salts = max(16, shuffle_width(spark))
    order = F.xxhash64("doc_id")
    salted = rows.withColumn("salt", F.pmod(order, F.lit(salts)).cast("int"))
    runs = state.groupBy("grp").agg(F.sort_array(F.collect_list(F.struct("shard", "n"))).alias("runs"))
    before = Window.partitionBy("grp").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = salted.groupBy("grp", "salt").agg(F.count("*").alias("n"))
    sizes = sizes.select("grp", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")).join(runs, "grp")
    at = F.row_number().over(Window.partitionBy("grp", "salt").orderBy("doc_id")) - 1
    placed = salted.withColumn("at", at).join(sizes, ["grp", "salt"], "left")
    label = F.expr(
        "aggregate(runs, named_struct('left', before + at, 'shard', -1), (a, r) -> if(a.shard >= 0, a, if(a.left < r.n, named_struct('left', a.left, 'shard', r.shard), named_struct('left', a.left - r.n, 'shard', -1))), a -> a.shard)"
    )
    labelled = durable(placed.select("doc_id", "size", "text_crc32", F.coalesce(label, F.lit(-1)).alias("label")), "labelled")

    # At most one row for each shard and one for rows without links.
    held = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    target = [total // shards + (s < total % shards) for s in range(shards)]
    kept = [min(held.get(s, 0), target[s]) for s in range(shards)]
    over, gap, spare, free = [], [], 0, 0
    for s in range(shards):
        over.append(spare)
        gap.append(free)
        spare += held.get(s, 0) - kept[s]
        free += target[s] - kept[s]
    placed = ranked(labelled, ["label"], [F.col("doc_id"), F.col("text_crc32"), F.col("size")], "place")
    label, place = F.col("label"), F.col("place")
    slot = F.element_at(_numbers(kept), label + 1)
    # Rows beyond a shard's count and rows without links share one numbering that fills the gaps.
    pool = F.when(label < 0, place + spare).when(place >= slot, place - slot + F.element_at(_numbers(over), label + 1))
    gaps = _numbers(gap)
    into = F.size(F.filter(gaps, lambda g: g <= F.col("pool"))) - 1
    out = placed.withColumn("pool", pool)
    # Empty gaps share a start: the last of them is the one with room.
    return out.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.when(F.col("pool").isNull(), label).otherwise(into).cast("int").alias("shard"),
        F.when(F.col("pool").isNull(), place).otherwise(F.element_at(_numbers(kept), into + 1) + F.col("pool") - F.element_at(gaps, into + 1)).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(read(spark, sf_dir, "documents"))


QUERIES = {"op8_balanced_sharding": query}
ORACLES: dict[str, str] = {}
