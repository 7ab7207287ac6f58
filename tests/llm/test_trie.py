"""The prefix trie against plain Python."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardline.llm import prefix_trie
from wardline.llm.common import Scratch

COLUMNS = "conv_id long, turn long, role string, text string, _part int, digest string, pos string, `a.b` int, length int, conv string"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 1, "d", "p", 2, 3, "c") for r in rows], COLUMNS)


def nodes(spark, frame, **options):
    scratch = Scratch(spark, "t")
    turns, heads = prefix_trie.rebuild(prefix_trie.turn_rows(frame), scratch)
    done = prefix_trie.prefix_trie(turns, heads, scratch, **options)
    return sorted(tuple(r) for r in done.collect())


def brute(rows, block=100, most=6):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            content = (role or "", text or "")
            digest = hashlib.md5(f"{len(content[0])}:{content[0]}{content[1]}".encode()).hexdigest()
            own[conv].append((turn is not None, turn or 0, digest, content))
    own = {c: [x[3] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % most
        donor = c - (abs(c) % block) * (1 if c >= 0 else -1)
        built[c] = tuple(own.get(donor, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in sorted(built.items()):
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    out = []
    for node, ids in members.items():
        below = [n for n in members if n[: len(node)] == node]
        kids = sum(len(n) == len(node) + 1 for n in below)
        leaves = sum(not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in below) for n in below)
        saved = sum((len(members[n]) - 1) * (len(n[-1][1]) if n else 0) for n in below)
        ends = ",".join(str(c) for c in ids if len(built[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(ids), len(node), parent, len(ids), kids, leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def sample(seed):
    rng = random.Random(seed)
    rows = []
    for c in [0, 1, 2, 3, 5, 7, 99, 100, 101, 102, 150, 207, 208, 250, -3, -100, -101, 301]:
        turns = [(t, rng.choice(["user", "bot"]), rng.choice(["hi", "ho", "häß 😀"])) for t in range(rng.randrange(1, 9))]
        rows += [(c, *t) for t in turns]
    rows += [(401, None, "a", "b"), (401, 0, None, None), (401, 0, "x", "y"), (401, 0, "x", "y"), (None, 1, "a", "b")]
    rows += [(500, t, "user", "same") for t in range(40)] + [(501, t, "user", "same") for t in range(45)]
    rng.shuffle(rows)
    return rows


def test_nodes(spark, monkeypatch):
    rows = sample(1)
    want = brute(rows)
    assert nodes(spark, conversations(spark, rows)) == want
    # A sketch that proves nothing leaves everything to the exact grouping.
    monkeypatch.setattr(prefix_trie, "sketch", lambda digests, cells: np.full(prefix_trie.ROWS * cells // 8, 255, np.uint8))
    assert nodes(spark, conversations(spark, rows).repartition(5)) == want


@pytest.mark.parametrize("seed", [1, 2])
def test_a_proven_prefix_with_an_unproven_next_one(spark, monkeypatch, seed):
    rows, real = sample(seed), prefix_trie.sketch

    def crowded(digests, cells):
        bits = np.unpackbits(real(digests, cells))
        return np.packbits(bits | (np.random.default_rng(seed).random(len(bits)) < 0.85))

    monkeypatch.setattr(prefix_trie, "sketch", crowded)
    assert nodes(spark, conversations(spark, rows)) == brute(rows)


def test_no_conversations(spark):
    assert nodes(spark, conversations(spark, [])) == []
    assert nodes(spark, conversations(spark, [(None, 1, "a", "b")])) == []


def test_one_turnless_conversation(spark):
    turnless = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6 > 0)
    rows = [(turnless, 1, "a", "b")]
    assert nodes(spark, conversations(spark, rows)) == brute(rows) == [
        (turnless, 0, None, 1, 0, 1, 0, hashlib.sha256(str(turnless).encode()).hexdigest())
    ]


def test_running_totals_of_a_key_over_many_stretches(spark):
    rng = random.Random(3)
    rows = [(rng.choice([1, 1, 1, 2, 3]), i, rng.randrange(100)) for i in range(500)]
    frame = spark.createDataFrame(rows, "k long, i long, v long").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        done = prefix_trie.running(frame, "k", [F.col("i")], {"total": F.col("v")}, Scratch(spark, "t"), "rows")
        got = {(r.k, r.i): r.total for r in done.collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sums, want = defaultdict(int), {}
    for k, i, v in rows:
        sums[k] += v
        want[k, i] = sums[k]
    assert got == want


def test_sketch_never_counts_too_little(spark):
    digests = [hashlib.md5(str(i % 900).encode()).digest() for i in range(1200)]
    frame = spark.createDataFrame([(d, d, 2) for d in digests], "digest binary, parent binary, depth long").repartition(5)
    bits = prefix_trie.sketch(frame.select("digest"), 1 << 16)
    alone = {bytes(r.digest) for r in prefix_trie.screened(frame, bits, 1 << 16).where("alone and parent_alone").collect()}
    once = {hashlib.md5(str(i).encode()).digest() for i in range(300, 900)}
    assert alone <= once and len(alone) >= 0.99 * len(once)


@pytest.mark.parametrize("size", [1, 3])
def test_members_are_hashed_piece_by_piece(spark, monkeypatch, size):
    monkeypatch.setattr(prefix_trie, "PIECE", size)
    groups = {b"a": range(50), b"b": [7], b"c": range(-5, 5)}
    frame = spark.createDataFrame([(d, c) for d, ids in groups.items() for c in ids], "digest binary, conv long").repartition(4)
    got = {bytes(r.digest): r.ends for r in prefix_trie.member_hashes(frame).collect()}
    assert got == {d: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() for d, ids in groups.items()}
