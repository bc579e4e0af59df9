import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from stallwise.llm import line_dedup, simhash, substring
from stallwise.llm.components import components
from stallwise.llm.cuckoo import CuckooFilter

SCHEMA = "doc_id long, text string"


def test_cuckoo_filter_holds_and_forgets():
    rng = np.random.default_rng(2)
    members = rng.integers(0, 1 << 63, 20_000, np.uint64)
    others = rng.integers(0, 1 << 63, 20_000, np.uint64)
    held = CuckooFilter.sized(len(members))
    held.insert(members)
    assert not held.full and held.contains(members).all()
    assert held.contains(others).mean() < 0.01
    held.delete(members[:5000])
    assert held.contains(members[5000:]).all()
    assert held.contains(members[:5000]).mean() < 0.01
    again = CuckooFilter.loaded(held.dumped(), held.full)
    assert (again.table == held.table).all()


def test_full_filter_says_yes():
    held = CuckooFilter(np.zeros((16, 4), np.uint16))
    held.insert(np.arange(1, 200, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    assert held.full and held.contains(np.array([5], np.uint64)).all()


def lines_by_hand(rows, min_docs=3, min_chars=20):
    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))

    holders = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if doc is not None and len(key(line)) >= min_chars:
                holders[key(line)].add(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if doc is None or len(holders[key(x)]) < min_docs or max(holders[key(x)]) == doc]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def cleaned(df):
    return sorted(((r["doc"]["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in df.collect()), key=str)


def test_lines_of_odd_and_no_rows(odd_docs, no_docs, odd_rows):
    assert cleaned(line_dedup.dedup_lines(odd_docs)) == lines_by_hand([r[:2] for r in odd_rows])
    assert line_dedup.dedup_lines(no_docs).count() == 0


def test_lines_come_back_when_documents_go(spark):
    rng = random.Random(4)
    pool = [f"this is the shared line number {i}" for i in range(12)]
    rows = [(i, "\n".join(rng.sample(pool, 3) + [f"own line of document {i} {i}"])) for i in range(30)]
    docs = spark.createDataFrame(rows, SCHEMA)
    state = line_dedup.line_state(docs.filter("doc_id < 15"), 3, 20)
    state = line_dedup.add_documents(state, docs.filter("doc_id >= 15"))
    assert cleaned(line_dedup.clean_lines(docs, state)) == lines_by_hand(rows)
    state = line_dedup.remove_documents(state, docs.filter("doc_id % 2 = 0"))
    left = [r for r in rows if r[0] % 2]
    assert cleaned(line_dedup.clean_lines(docs.filter("doc_id % 2 = 1"), state)) == lines_by_hand(left)
    state = line_dedup.add_documents(state, docs.filter("doc_id % 2 = 0"))
    assert cleaned(line_dedup.clean_lines(docs, state)) == lines_by_hand(rows)


def test_lines_without_a_broadcast(spark, odd_docs, odd_rows, monkeypatch):
    monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", -1)
    assert cleaned(line_dedup.dedup_lines(odd_docs)) == lines_by_hand([r[:2] for r in odd_rows])


def windows_by_hand(rows, size):
    first = {}
    order = lambda d: (d is None, d or 0)
    split = [(d, (t or "").encode().split()) for d, t in rows]
    for d, w in split:
        for i in range(len(w) - size + 1):
            k = tuple(w[i : i + size])
            if k not in first or order(d) < order(first[k]):
                first[k] = d
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - size + 1):
            if order(first[tuple(w[i : i + size])]) < order(d):
                gone.update(range(i, i + size))
        out.append((d, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return sorted(out, key=str)


def removed(df):
    return sorted(((r["doc"]["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in df.collect()), key=str)


def passages(seed, docs, vocabulary):
    rng = random.Random(seed)
    pool = [[rng.choice(vocabulary) for _ in range(rng.randint(8, 40))] for _ in range(8)]
    rows = []
    for i in range(docs):
        words = []
        for _ in range(rng.randint(0, 6)):
            part = list(rng.choice(pool)) if rng.random() < 0.6 else [rng.choice(vocabulary) for _ in range(rng.randint(1, 30))]
            if rng.random() < 0.3 and part:
                part[rng.randrange(len(part))] = "changed"
            words += part
        rows.append((rng.choice([i, i, i, max(0, i - 1)]), " ".join(words)))
    return rows


def test_substrings_against_brute_force(spark, monkeypatch):
    for seed, vocabulary in ((1, [f"v{i}" for i in range(200)]), (2, ["a", "b", "c"])):
        rows = passages(seed, 60, vocabulary)
        docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
        assert removed(substring.dedup_substrings(docs)) == windows_by_hand(rows, 13)
    # Small bounds: many shards, and anchors that no shard may hold.
    monkeypatch.setattr(substring, "ANCHOR_REGIONS", 2)
    monkeypatch.setattr(substring, "SHARD_WORDS", 50)
    monkeypatch.setattr(substring, "STRETCH", 20)
    assert removed(substring.dedup_substrings(docs)) == windows_by_hand(rows, 13)


def test_substrings_of_odd_and_no_rows(odd_docs, no_docs, odd_rows):
    found = substring.dedup_substrings(odd_docs)
    assert removed(found) == windows_by_hand([r[:2] for r in odd_rows], 13)
    assert found.select("doc.*").columns == odd_docs.columns
    assert substring.dedup_substrings(no_docs).count() == 0


def test_automaton_finds_every_window():
    rng = random.Random(7)
    for _ in range(100):
        automaton, added = substring.Automaton(), []
        for _ in range(rng.randint(1, 8)):
            words = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(0, 25))]
            mask = automaton.covered(words, 4)
            for i in range(len(words) - 3):
                there = any(words[i : i + 4] == x[j : j + 4] for x in added for j in range(len(x) - 3))
                assert (mask >> i & 1) == there
            automaton.add(words)
            added.append(words)


def test_components_of_paths_stars_and_rings(spark):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 540)] + [(900, 901), (901, 902), (902, 900), (7, 7)]
    edges += [(rng.randint(2000, 2100), rng.randint(2000, 2100)) for _ in range(70)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {x: find(x) for x in parent}


def fingerprint_by_hand(text, size):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    parts = [words] if len(words) < size else [words[i : i + size] for i in range(len(words) - size + 1)]
    hashes = [xxhash.xxh64_intdigest(b" ".join(p), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_and_groups(spark, odd_docs, odd_rows, no_docs):
    rows = {}
    for r in simhash.linked(odd_docs, 3).collect():
        rows.setdefault(r["doc_id"], []).append((r["mark"] & (1 << 64) - 1, r["component_id"]))
    marks = [(d, fingerprint_by_hand(t, 3)) for d, t, *_ in odd_rows]
    for d, m in marks:
        reach, size = {m}, 0
        while size != len(reach):
            size = len(reach)
            reach |= {x for _, x in marks if any((x ^ y).bit_count() <= 2 for y in reach)}
        least = min((e for e, x in marks if x in reach and e is not None), default=None)
        assert (m, least) in rows[d]
    assert sum(map(len, rows.values())) == len(odd_rows)
    assert simhash.linked(no_docs, 3).count() == 0


def test_links_reach_every_close_pair(spark):
    rng = random.Random(6)
    marks = set()
    for _ in range(30):
        centre = rng.getrandbits(64)
        for _ in range(6):
            marks.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))))
    signed = [m - (1 << 64) if m >> 63 else m for m in marks]
    found = {r["node"]: r["component"] for r in components(simhash.links(spark.createDataFrame([(m,) for m in signed], "mark long"))).collect()}
    for a in signed:
        for b in signed:
            if a != b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2:
                assert found[a] == found[b]


def kept_by_hand(rows):
    """The smallest id of each group of marks that steps of two bits connect."""
    marks = [simhash.fingerprint(t, 3) & (1 << 64) - 1 for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (marks[i] ^ marks[j]).bit_count() <= 2:
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    return sorted(min(rows[i][0] for i in range(len(rows)) if group[i] == g) for g in set(group))


def test_one_of_each_group_stays(spark):
    rng = random.Random(10)
    rows = []
    for i in range(25):
        words = [f"t{rng.randint(0, 3000)}" for _ in range(rng.randint(100, 600))]
        rows.append((4 * i, " ".join(words)))
        for k in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = "other"
            rows.append((4 * i + k + 1, " ".join(words)))
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    kept = sorted(r["doc_id"] for r in simhash.one_of_each(docs).collect())
    assert kept == kept_by_hand(rows) and 25 <= len(kept) < len(rows)


def test_one_of_each_of_odd_and_no_rows(odd_docs, no_docs):
    kept = simhash.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    # Texts without words are one group: null, empty and blank ones.
    assert sorted(x for x in ids if x is not None) == [1, 3, 4, 7, 8, 9, 10, 11] and len(ids) == 9
    assert simhash.one_of_each(no_docs).count() == 0


def test_one_of_rows_with_the_same_id_is_defined(spark):
    rows = [(1, "a b c d", "x"), (1, "a b c d", "y"), (None, "a b c d", "w"), (1, "a b c d", "x")]
    kept = [simhash.one_of_each(spark.createDataFrame(order, "doc_id long, text string, z string")).collect() for order in (rows, rows[::-1])]
    assert kept[0] == kept[1] and len(kept[0]) == 1 and kept[0][0]["doc_id"] == 1
