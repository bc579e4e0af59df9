"""Reversible line dedup: sharded cuckoo filters backed by exact reference counts.

State: ``postings`` (key, doc_id), the exact references; ``counts`` (key, n_docs, keeper), how
many documents hold a key and the largest of them; ``filters`` (shard, table, full), one
cuckoo filter per shard over the keys that enough documents hold. Documents are added and
taken back; only the keys they touch are counted again, and only filters of shards whose
keys pass the threshold change. Cleaning asks the filters first, so only lines that may have
to go are looked up exactly.

Rows with a null doc_id neither count nor lose lines; rows with an equal doc_id are one
document. A null or empty text is one empty line.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallwise.llm.common import staged
from stallwise.llm.cuckoo import CuckooFilter

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FILTERS = "shard int, table binary, full boolean"
# Filters are broadcast up to this size; beyond it all lines meet the counts in a shuffle join.
BROADCAST_BYTES = 64 << 20
KEYS_PER_SHARD = 500_000


@dataclass
class LineState:
    postings: DataFrame
    counts: DataFrame
    filters: DataFrame
    min_docs: int
    min_chars: int
    shards: int


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def key_text(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def hash_of(key: Column) -> Column:
    """The first 64 bits of a key's digest, as a signed number."""
    return F.conv(F.substring(key, 1, 16), 16, -10).cast("long")


def line_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """(key, doc_id): the digest of each line key that is long enough, once per row of ``docs``."""
    keys = F.filter(F.transform(lines_of(F.col("text")), key_text), lambda k: F.length(k) >= min_chars)
    digests = F.array_distinct(F.transform(keys, lambda k: F.md5(k.cast("binary"))))
    return docs.filter("doc_id IS NOT NULL").select("doc_id", F.explode(digests).alias("key"))


def references(docs: DataFrame, min_chars: int) -> DataFrame:
    return line_keys(docs, min_chars).dropDuplicates(["key", "doc_id"])


def tally(postings: DataFrame) -> DataFrame:
    return postings.groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("keeper"))


def shard_of(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")


def changed_filter(key: tuple, old: pd.DataFrame, changes: pd.DataFrame) -> pd.DataFrame:
    """One shard's filter with the keys that passed the threshold put in or taken out."""
    added = changes.loc[changes["step"] > 0, "hash"].to_numpy(np.int64).view(np.uint64)
    gone = changes.loc[changes["step"] < 0, "hash"].to_numpy(np.int64).view(np.uint64)
    if len(old):
        kept = CuckooFilter.loaded(old["table"].iloc[0], bool(old["full"].iloc[0]))
    else:
        kept = CuckooFilter.sized(len(added))
    kept.delete(gone)
    if len(added):
        kept.insert(added)
    return pd.DataFrame({"shard": [int(key[0])], "table": [kept.dumped()], "full": [kept.full]})


def with_changes(filters: DataFrame, changes: DataFrame, shards: int) -> DataFrame:
    steps = changes.select(shard_of(F.col("key"), shards).alias("shard"), hash_of(F.col("key")).alias("hash"), "step")
    return filters.groupBy("shard").cogroup(steps.groupBy("shard")).applyInPandas(changed_filter, FILTERS)


def line_state(docs: DataFrame, min_docs: int, min_chars: int) -> LineState:
    """The state after all of ``docs`` were added to nothing."""
    postings = staged(references(docs, min_chars), "postings")
    counts = staged(tally(postings), "line-counts")
    frequent = counts.filter(F.col("n_docs") >= min_docs).select("key", F.lit(1).alias("step"))
    shards = max(1, -(-frequent.count() // KEYS_PER_SHARD))
    none = docs.sparkSession.createDataFrame([], FILTERS)
    filters = staged(with_changes(none, frequent, shards), "filters")
    return LineState(postings, counts, filters, min_docs, min_chars, shards)


def moved(state: LineState, postings: DataFrame, touched: DataFrame) -> LineState:
    """The state with ``postings``, of which only the keys in ``touched`` differ."""
    postings = staged(postings, "postings")
    now = tally(postings.join(touched, "key", "left_semi"))
    counts = staged(state.counts.join(touched, "key", "left_anti").unionByName(now), "line-counts")
    often = F.col("n_docs") >= state.min_docs
    before = state.counts.join(touched, "key", "left_semi").filter(often).select("key")
    after = counts.join(touched, "key", "left_semi").filter(often).select("key")
    changes = (
        after.join(before, "key", "left_anti").select("key", F.lit(1).alias("step"))
        .unionByName(before.join(after, "key", "left_anti").select("key", F.lit(-1).alias("step")))
    )
    filters = staged(with_changes(state.filters, changes, state.shards), "filters")
    return LineState(postings, counts, filters, state.min_docs, state.min_chars, state.shards)


def add_documents(state: LineState, docs: DataFrame) -> LineState:
    fresh = staged(references(docs, state.min_chars).join(state.postings, ["key", "doc_id"], "left_anti"), "fresh")
    return moved(state, state.postings.unionByName(fresh), fresh.select("key").distinct())


def remove_documents(state: LineState, ids: DataFrame) -> LineState:
    """Takes back the documents of ``ids`` (doc_id)."""
    gone = staged(state.postings.join(ids.select("doc_id").distinct(), "doc_id", "left_semi").select("key", "doc_id"), "gone")
    return moved(state, state.postings.join(gone, ["key", "doc_id"], "left_anti"), gone.select("key").distinct())


def asking(filters):
    """Keeps the rows (doc_id, key, shard, hash) whose key may be in its shard's filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {s: CuckooFilter.loaded(t, full) for s, t, full in filters.value}
        for batch in batches:
            shards = batch.column("shard").to_numpy()
            hashes = batch.column("hash").to_numpy().view(np.uint64)
            keep = np.zeros(len(shards), bool)
            for s, one in held.items():
                mine = np.flatnonzero(shards == s)
                keep[mine] = one.contains(hashes[mine])
            yield batch.select(["doc_id", "key"]).filter(pa.array(keep))

    return run


def dropped_keys(state: LineState, docs: DataFrame) -> DataFrame:
    """(doc_id, dropped): the digests of the line keys that a document loses."""
    lines = line_keys(docs, state.min_chars)
    size = state.filters.agg(F.coalesce(F.sum(F.octet_length("table")), F.lit(0))).first()[0]
    if size <= BROADCAST_BYTES:
        spark = docs.sparkSession
        filters = spark.sparkContext.broadcast([tuple(x) for x in state.filters.collect()])
        probes = lines.withColumn("shard", shard_of(F.col("key"), state.shards)).withColumn("hash", hash_of(F.col("key")))
        schema = f"doc_id {dict(docs.dtypes)['doc_id']}, key string"
        lines = probes.select("doc_id", "key", "shard", "hash").mapInArrow(asking(filters), schema)
    frequent = state.counts.filter(F.col("n_docs") >= state.min_docs).select("key", "keeper")
    lost = lines.join(frequent, "key").filter("doc_id != keeper")
    return lost.groupBy("doc_id").agg(F.collect_set("key").alias("dropped"))


def clean_lines(docs: DataFrame, state: LineState) -> DataFrame:
    """(doc, n_lines, n_dropped, kept_text): every row of ``docs`` as a struct, cleaned by ``state``."""
    rows = docs.select(F.struct("*").alias("doc"), "doc_id", "text").join(dropped_keys(state, docs), "doc_id", "left")
    parts = lines_of(F.col("text"))
    rest = F.filter(parts, lambda x: ~F.array_contains("dropped", F.md5(key_text(x).cast("binary"))))
    kept = F.when(F.col("dropped").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(rest, "\n"))
    n_kept = F.when(F.col("dropped").isNull(), F.size(parts)).otherwise(F.size(rest))
    return rows.select(
        "doc", F.size(parts).cast("long").alias("n_lines"), (F.size(parts) - n_kept).cast("long").alias("n_dropped"), kept.alias("kept_text")
    )


def dedup_lines(docs: DataFrame, min_docs: int = 3, min_chars: int = 20) -> DataFrame:
    """Drops lines held by ``min_docs`` documents or more, except in the largest doc_id.

    ``docs`` needs doc_id and text; all columns of the input are in ``doc``, whatever their names.
    Nothing is dropped from an empty table.
    """
    return clean_lines(docs, line_state(docs, min_docs, min_chars))
