import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from stallwise.llm import packing, sharding, vocabularies
from stallwise.llm.queries import QUERIES
from tests.llm.conftest import SF


def check_shards(rows, shards):
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    sizes = [len(by[s]) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_documents_are_even_and_equal_texts_together(spark):
    rows = QUERIES["op1_sharding"](spark, SF).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    check_shards(rows, 24)
    assert len(rows) == len(docs)
    for r in rows:
        data = (docs[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 8, zlib.crc32(data), "rows", None)


@pytest.mark.parametrize("members", [[300], [40] * 12, [2] * 150, [200, 60, 30, 5, 5]])
def test_groups_are_cut_as_little_as_quotas_allow(spark, members):
    texts = [f"group {g}" for g, n in enumerate(members) for _ in range(n)] + [f"single {i}" for i in range(100)]
    random.Random(3).shuffle(texts)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = sharding.shard_documents(docs, 5).collect()
    check_shards(rows, 5)
    quota = len(texts) / 5
    where = defaultdict(set)
    for r in rows:
        where[texts[r["id"]]].add(r["shard"])
    pieces = sum(len(where[f"group {g}"]) for g in range(len(members)))
    needed = sum(-(-n // int(quota + 1)) for n in members)
    assert pieces <= needed + 5


def test_sharding_of_odd_and_no_rows(odd_docs, no_docs, odd_rows):
    rows = sharding.shard_documents(odd_docs, 4).collect()
    assert len(rows) == len(odd_rows)
    check_shards(rows, 4)
    assert sharding.shard_documents(no_docs, 4).count() == 0


def test_patterns_hold_every_piece_once():
    rng = random.Random(5)
    for _ in range(50):
        size = rng.choice([7, 64, 1024])
        histogram = {n: rng.randint(1, 40) for n in rng.sample(range(1, size + 1), rng.randint(1, min(size, 60)))}
        packs = packing.patterns(histogram, size)
        held = Counter()
        for count, lengths in packs:
            assert count > 0 and sum(lengths) <= size
            for n in lengths:
                held[n] += count
        assert held == histogram


def check_packs(rows, size):
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return len(by)


def test_pieces_are_the_ids_of_the_texts(spark):
    import public_tokenizers
    import tokenizers

    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = QUERIES["op2_packing"](spark, SF).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = {(r["doc_id"], r["start"]): r for r in rows}
    assert len(found) == len(rows)
    for doc, text in texts.items():
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        at = 0
        while at < len(ids):
            r = found.pop((doc, at))
            part = ids[at : at + r["length"]]
            assert (zlib.crc32(part.tobytes()), len(ids)) == (r["ids_crc32"], r["doc_tokens"])
            at += r["length"]
    assert not found
    sequences = check_packs(rows, 1024)
    assert sum(r["length"] for r in rows) / (sequences * 1024) > 0.98


def test_byte_tokens_equal_the_library():
    import public_tokenizers
    import tokenizers

    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    mine = vocabularies.byte_tokens()
    rng = random.Random(9)
    texts = ["", " ", "  ", "a  b", "a \n b", "\n\n x", "x \t", "it's <|endoftext|> end", "<|endoftext|><|endoftext|>", " lead", "a b", "日本 語", "a b "]
    texts += ["".join(rng.choice(" \n\tab'1é!") for _ in range(rng.randint(1, 40))) for _ in range(500)]
    for text in texts:
        assert np.frombuffer(mine.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_packing_of_odd_and_no_rows(odd_docs, no_docs, odd_rows):
    rows = packing.pack_documents(odd_docs, 1024, 0, vocabularies.byte_tokens).collect()
    check_packs(rows, 1024)
    assert sum(r["doc_tokens"] for r in rows if r["start"] == 0) == sum(r["length"] for r in rows)
    assert len([r for r in rows if r["start"] == 0]) == len(odd_rows)
    assert packing.pack_documents(no_docs, 1024, 0, vocabularies.byte_tokens).count() == 0


def test_unequal_pieces_only(spark):
    pieces = spark.range(50).select(F.col("id").alias("row"), F.lit(0).cast("long").alias("start"), (F.col("id") % 10 + 1).alias("length"))
    rows = packing.pack(pieces, 10).collect()
    assert len(rows) == 50
    check_packs(rows, 10)
