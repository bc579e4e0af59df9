"""Balanced label propagation: linked documents gather in shards of even size.

Documents share groups (here: equal texts). A group is a hub: it takes the shards where most
of its members are, as far as those shards have room, and its members move there. Every
shard has a quota, documents without a partner fill what is left, and a last step makes the
counts exactly even. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallwise.llm.common import cells_for, numbered, staged


def unit(*columns: str):
    """A number in [0, 1) from the hash of ``columns``."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 40)) / float(1 << 40)


def loads(labels: DataFrame, shards: int) -> list[int]:
    """Rows per shard; one number for each shard reaches the driver."""
    found = dict(labels.groupBy("shard").agg(F.count(F.lit(1))).collect())
    return [found.get(s, 0) for s in range(shards)]


def doubles(values) -> F.Column:
    return F.array(*[F.lit(float(v)) for v in values])


def wishes(labels: DataFrame, links: DataFrame, room: list[float], lot: float) -> DataFrame:
    """The shard that each linked row wants, and the lot in which it moves.

    A group lists the shards its members are in, most members first, each with what it may
    hold: the members already there and the shard's room. A member's place in the group, a
    hash, falls into one of them. So a group that exceeds one shard spreads over as few as
    possible, and a group has at most one entry per shard.
    """
    placed = links.join(labels.select("row", "shard"), "row")
    tally = placed.groupBy("grp", "shard").agg(F.count(F.lit(1)).alias("w"))
    hubs = tally.groupBy("grp").agg(
        F.sum("w").alias("total"),
        F.sort_array(F.collect_list(F.struct("w", unit("grp", "shard").alias("tie"), "shard")), asc=False).alias("at"),
    )
    free = doubles(room)
    holds = F.transform("at", lambda x: x["w"] + F.get(free, x["shard"]))
    hubs = hubs.withColumn("holds", holds)
    ends = F.transform(F.sequence(F.lit(1), F.size("holds")), lambda i: F.aggregate(F.slice("holds", 1, i), F.lit(0.0), lambda a, b: a + b))
    hubs = hubs.select("grp", "total", "at", ends.alias("ends"))
    position = unit("grp", "row") * F.col("total")
    first = F.array_position(F.transform("ends", lambda e: e > F.col("position")), True)
    picked = F.get("at", (F.col("first") - 1).cast("int"))
    asked = (
        placed.join(hubs, "grp")
        .withColumn("position", position)
        .withColumn("first", first)
        .withColumn("picked", F.when(F.col("first") > 0, picked))
        .select(
            "row",
            "shard",
            F.coalesce("picked.shard", "shard").alias("want"),
            F.coalesce("picked.w", F.lit(0)).alias("force"),
            F.xxhash64("grp", F.floor(F.col("position") / lot)).alias("lot"),
        )
    )
    best = F.max(F.struct("force", "want", "lot"))
    return asked.groupBy("row", "shard").agg(best.alias("best")).select("row", "shard", "best.want", "best.lot")


def propagate(links: DataFrame, start: DataFrame, shards: int, quota: float, rounds: int) -> DataFrame:
    """Rounds of moves under quotas; stops when no row wants to move.

    More demand than room is met in part: a lot moves when its hash falls under the share
    that fits. A lot is one group or a sixteenth of a quota, whichever is less.
    """
    labels = staged(start, "labels")
    for turn in range(rounds):
        load = loads(labels, shards)
        room = [max(0.0, quota - x) for x in load]
        asked = staged(wishes(labels, links, room, max(1.0, quota / 16)), "wishes")
        moving = asked.filter("want != shard")
        demand = dict(moving.groupBy("want").agg(F.count(F.lit(1))).collect())
        if not demand:
            break
        share = [min(1.0, room[s] / demand[s]) if demand.get(s) else 0.0 for s in range(shards)]
        coin = F.pmod(F.xxhash64("lot", F.lit(turn)), F.lit(1 << 40)) / float(1 << 40)
        moves = coin < F.get(doubles(share), F.col("want"))
        labels = asked.select("row", F.when(moves, F.col("want")).otherwise(F.col("shard")).alias("shard"))
    return labels


def even_shards(rows: DataFrame, shards: int, rounds: int = 6) -> DataFrame:
    """``rows`` (row, id, grp) with a ``shard`` and a gapless ``slot``; counts at most one apart.

    Rows with an equal ``grp`` are linked; a null ``grp`` links nothing. Rows must have
    distinct values of ``row``; ``id`` decides the first shard and may be null or repeat. An
    empty table gives an empty result.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    total = rows.count()
    groups = rows.filter("grp IS NOT NULL").groupBy("grp").agg(F.count(F.lit(1)).alias("members"))
    known = staged(
        rows.select("row", "id", "grp")
        .join(groups.filter("members > 1"), "grp", "left")
        .withColumn("members", F.coalesce("members", F.lit(1))),
        "links",
    )
    links = known.filter("members > 1")
    start = links.select("row", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"))
    labels = propagate(links.select("row", "grp"), start, shards, max(1.0, total / shards), rounds)

    # Every shard keeps its largest groups up to its count; all others are poured into the gaps.
    target = [total // shards + (s < total % shards) for s in range(shards)]
    cut = cells_for(total, shards)
    here = links.join(labels, "row").withColumn("size", F.floor(F.log2("members")))
    order = [F.col("size").desc(), F.xxhash64("grp"), F.col("row")]
    # Cells follow the order: group size first, then the group's hash; a large group has cells of its own.
    big = F.col("members") > cut * 1000
    cell = F.struct(
        (-F.col("size")).alias("size"),
        F.when(big, F.xxhash64("grp")).otherwise(F.shiftright(F.xxhash64("grp"), 44) % cut).alias("part"),
        F.when(big, F.pmod(F.xxhash64("row"), F.greatest(F.lit(1), F.col("members") / 50_000).cast("long"))).otherwise(F.lit(0)).alias("piece"),
    )
    kept = staged(numbered(here, ["shard"], cell, order, "slot"), "kept")
    limit = F.get(F.array(*[F.lit(t) for t in target]), F.col("shard"))
    fits = kept.filter(F.col("slot") < limit).select("row", "shard", F.col("slot").cast("long").alias("slot"))
    held = loads(fits, shards)

    pieces = F.pmod(F.xxhash64("row"), F.greatest(F.lit(1), F.col("members") / 50_000).cast("long"))
    free = known.join(fits.select("row"), "row", "left_anti").select(
        F.lit(0).alias("all"),
        "row",
        F.xxhash64(F.coalesce("grp", F.col("row").cast("string"))).alias("place"),
        pieces.alias("piece"),
    )
    cell = F.struct(F.pmod("place", F.lit(cells_for(total, 1))).alias("part"), "piece")
    poured = numbered(free, ["all"], cell, [F.col("place"), F.col("row")], "number")
    ends, seen = [], 0
    for s in range(shards):
        seen += target[s] - held[s]
        ends.append(seen)
    at = F.array_position(F.transform(F.array(*[F.lit(e) for e in ends]), lambda e: e > F.col("number")), True) - 1
    begins = F.array(*[F.lit(e - target[s] + held[s]) for s, e in enumerate(ends)])
    filled = poured.withColumn("shard", at.cast("int")).select(
        "row",
        "shard",
        (F.get(F.array(*[F.lit(h) for h in held]), F.col("shard")) + F.col("number") - F.get(begins, F.col("shard"))).cast("long").alias("slot"),
    )
    return rows.join(fits.unionByName(filled), "row")


def shard_documents(docs: DataFrame, shards: int, rounds: int = 6) -> DataFrame:
    """Documents in ``shards`` shards with even counts; equal texts are linked.

    A null text has no bytes, the checksum of the empty text, and is linked with empty texts.
    Ties and repeated rows are separate rows. Columns other than doc_id and text are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    rows = staged(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            F.col("doc_id").alias("id"),
            (F.octet_length(text) + 8).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.md5(text.cast("binary")).alias("grp"),
        ),
        "rows",
    )
    return even_shards(rows, shards, rounds)
