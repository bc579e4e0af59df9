"""Spelling variants, importance resampling and chat formatting against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stallwise.llm import chat, resampling, spelling
from tests.llm.conftest import CLASHES

# ---- spelling ------------------------------------------------------------------


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_words(rows, shortest, least, one_in):
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if one_in and h % one_in == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= shortest and n >= least}


def brute_variants(words):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, words[w], len(near[w]), form[w], form[w] and words[form[w]], root(w)) for w in words}


def found_variants(words):
    return {tuple(r) for r in spelling.variants(words).select("word", "n", "n_near", "form", "form_n", "root").collect()}


@pytest.mark.parametrize("backwards", [False, True])
def test_sorted_lists_find_all_words_one_edit_away(backwards):
    rng = random.Random(3)
    for _ in range(20):
        words = sorted({"".join(rng.choice("abé𝄞") for _ in range(rng.randint(1, 9))) for _ in range(300)})
        keys = sorted(w[::-1] for w in words) if backwards else words
        a, b = spelling.near_words(keys, keys, [spelling.half(len(k), backwards) for k in keys])
        pairs = [(keys[i][::-1], keys[j][::-1]) if backwards else (keys[i], keys[j]) for i, j in zip(a, b)]
        assert len(set(pairs)) == len(pairs)
        found = {p for p in pairs if spelling.own_order(*p, backwards)}
        assert found == {(x, y) for x in words for y in words if one_edit(x, y) and spelling.own_order(x, y, backwards)}


def test_shards_share_out_the_vocabulary(spark, monkeypatch):
    """Tiny shards and query blocks, with a third of all words under one prefix."""
    monkeypatch.setattr(spelling, "SHARD_BYTES", 200)
    monkeypatch.setattr(spelling, "QUERIES", 16)
    rng = random.Random(5)
    words = {"".join(rng.choice("abcd") for _ in range(rng.randint(5, 8))): rng.randint(3, 200) for _ in range(500)}
    words |= {"pretext" + "".join(rng.choice("xyz") for _ in range(rng.randint(1, 6))): rng.randint(3, 200) for _ in range(300)}
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(5)
    assert found_variants(df) == brute_variants(words)


def test_long_words_and_shown_prefixes(spark, monkeypatch):
    monkeypatch.setattr(spelling, "SHARD_BYTES", 300)
    monkeypatch.setattr(spelling, "SHOWN", 3)
    base = "ab" * 60
    words = {base: 9, base[:50] + base[51:]: 4, base + "c": 3, "z" + base: 20, base[:-1] + "q": 5, "x" * 3000: 3, "x" * 2999 + "y": 7}
    assert found_variants(spark.createDataFrame(list(words.items()), "word string, n long")) == brute_variants(words)


def test_words_are_counted_and_altered(spark, odd_docs, odd_rows, monkeypatch):
    monkeypatch.setattr(spelling, "HELD", 50)
    for one_in in (None, 3):
        words = spelling.vocabulary(odd_docs, 3, 2, one_in)
        assert {tuple(r) for r in words.collect()} == set(brute_words([(r[0], r[1]) for r in odd_rows], 3, 2, one_in).items())


def test_spelling_of_nothing(spark, no_docs):
    assert spelling.variants(spelling.vocabulary(no_docs)).count() == 0
    assert found_variants(spark.createDataFrame([("alone", 5)], "word string, n long")) == {("alone", 5, 0, None, None, "alone")}


# ---- resampling ----------------------------------------------------------------


def brute_words_of(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute_features(text):
    words = brute_words_of(text)
    return [zlib.crc32(f.encode()) % 10_000 for f in words + [a + " " + b for a, b in zip(words, words[1:])]]


def brute_resampled(rows, target, percent, least):
    s, t = (Counter(b for text in texts for b in brute_features(text)) for texts in ([r[1] for r in rows], target))
    s_all, t_all = sum(s.values()), sum(t.values())
    scored = []
    for key, text in rows:
        found = brute_features(text)
        gains = [math.floor(1000 * math.log((t[b] + 1) * (s_all + 10_000) / ((s[b] + 1) * (t_all + 10_000)))) for b in found]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        scored.append((key, len(brute_words_of(text)), len(found), weight, score))
    able = sorted((r for r in scored if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))
    ranks = {id(r): i + 1 for i, r in enumerate(able[: percent * len(able) // 100])}
    return sorted(((r[0], *r[2:], ranks.get(id(r))) for r in scored), key=repr)


TARGET = ["one two three three two one", "A line that three Documents", None, "", "w2x1 w2x2 é日本"]


@pytest.mark.parametrize("head", [(0, 0), (3, 2), (20_000, 40_000)])
def test_draws_like_brute_force_whatever_the_head(spark, odd_docs, odd_rows, monkeypatch, head):
    monkeypatch.setattr(resampling, "HEAD_WORDS", head[0] or 1)
    monkeypatch.setattr(resampling, "HEAD_PAIRS", head[1] or 1)
    monkeypatch.setattr(resampling, "LONGEST", 8)
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    found = resampling.resampled(odd_docs, target, ["doc_id"], 50, 2)
    got = sorted(((r[0], *r[1:]) for r in found.select("doc.doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)
    assert got == brute_resampled([(r[0], r[1]) for r in odd_rows], TARGET, 50, 2)


def test_crc_of_pairs_from_states():
    rng = random.Random(2)
    words = [bytes(rng.choice(b"abc\xc3\xa9z0") for _ in range(rng.randint(1, 90))) for _ in range(400)]
    head = resampling.Head(words[:50], [zlib.crc32(w) for w in words[:50]], [], [], 10_000)
    features = resampling.Features(head)
    single, at, double = features(words, np.array([150, 0, 1, 249]))
    assert single.tolist() == [zlib.crc32(w) % 10_000 for w in words]
    assert at.tolist() == [i for i in range(399) if i not in (149, 150)]
    assert double.tolist() == [zlib.crc32(words[i] + b" " + words[i + 1]) % 10_000 for i in at.tolist()]


def test_frequent_features_of_a_task(monkeypatch):
    monkeypatch.setattr(resampling, "HEAD_WORDS", 4)
    monkeypatch.setattr(resampling, "HEAD_PAIRS", 4)
    texts = [f"the cat w{i} sat w{i}x the cat" for i in range(500)]
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[i : i + 50])], ["text"]) for i in range(0, 500, 50)]
    (out,) = resampling.frequent(iter(batches))
    rows = out.to_pylist()
    assert {r["first"] for r in rows if r["second"] is None} >= {b"the", b"cat", b"sat"}
    assert (b"the", b"cat") in {(r["first"], r["second"]) for r in rows}


def test_resampling_of_nothing_and_extra_columns(spark, odd_docs, no_docs):
    target = spark.createDataFrame([], "text string")
    assert resampling.resampled(no_docs, target).count() == 0
    whole = resampling.resampled(odd_docs, target, odd_docs.columns, 100, 0)
    assert whole.count() == odd_docs.count() and whole.filter("rank IS NULL").count() == 0
    assert set(CLASHES) <= set(whole.select("doc.*").columns)


# ---- chat ----------------------------------------------------------------------

TURNS = [
    (1, 0, "system", "be brief"), (1, 1, "user", "a\\###</turn>\n:"), (1, 2, "assistant", "\\"), (1, 3, "user", "###"), (1, 4, "assistant", "</turn></turn>"),
    (1, 5, "user", "left over"), (2, 0, "user", None), (2, 0, "user", "same turn"), (3, 1, "assistant", ""), (3, None, None, "no turn"),
    (None, 0, "user", "no conversation"), (None, 1, "assistant", "ok"), (4, 0, "odd: ### role", "x"), (4, 1, "assistant", "### assistant: y</turn>\n"),
    (5, 0, "user", "again"), (5, 0, "user", "again"), (6, 0, "assistant", "x" * 300_000), (6, 1, "assistant", "\\" * 500),
]


def brute_digests(turns):
    order = sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, t[1] is not None, t[1] or 0, t[2] is not None, t[2] or "", t[3] is not None, t[3] or ""))
    out = {}
    for conv, _, role, text in order:
        out.setdefault(conv, []).append((role or "", text or ""))
    return {
        (
            conv, len(rows), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in rows).encode()).hexdigest(),
            sum(len(t) for r, t in rows if r == "assistant"), hashlib.sha256("".join(t for r, t in rows if r == "assistant").encode()).hexdigest(),
        )
        for conv, rows in out.items()
    }


def test_conversations_read_back_whole(spark, monkeypatch):
    monkeypatch.setattr(chat, "BATCH_CHARS", 1000)
    turns = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").withColumn("conv", F.lit("x")).repartition(4)
    made = chat.examples(turns)
    found = chat.digests(made)
    assert {tuple(r)[:5] for r in found.collect()} == brute_digests(TURNS)
    lengths = made.groupBy("conv_id").agg(F.sum(F.length("text"))).collect()
    assert {tuple(r) for r in lengths} == {(r["conv_id"], r["formatted_chars"]) for r in found.collect()}


def test_every_reply_is_an_example_with_its_context(spark):
    turns = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")
    rows = chat.examples(turns).filter("conv_id = 1").orderBy("example").collect()
    read = [list(chat.read_turns(r["text"])) for r in rows]
    assert [len(x) for x in read] == [3, 5, 6]
    assert [chat.unescaped(r["text"][r["loss_start"] :][: r["loss_length"]]) for r in rows] == ["\\", "</turn></turn>", ""]
    assert all(b[: len(a)] == a for a, b in zip(read, read[1:]))


def test_no_conversations(spark):
    assert chat.digests(chat.examples(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def test_texts_cannot_break_out():
    rng = random.Random(1)
    parts = ["\\", "###", "#", "</turn>", "</turn", ">", "\n", ": ", ":", "a", "### user: "]
    for _ in range(2000):
        turns = [("".join(rng.choices(parts, k=rng.randint(0, 5))), "".join(rng.choices(parts, k=rng.randint(0, 9)))) for _ in range(rng.randint(1, 4))]
        formatted = "".join(chat.opening(r) + chat.escaped(t) + chat.END for r, t in turns)
        assert list(chat.read_turns(formatted)) == turns
