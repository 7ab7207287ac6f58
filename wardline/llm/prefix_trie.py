"""Prefix trie of conversations, screened by a count-min sketch.

A node stands for a distinct sequence of first turns. Every conversation gives one digest per prefix, a
running sum over its turns of hashes of (place, content), so digests of a long conversation are built by
many tasks. A count-min sketch of all prefix digests is built per task, merged block by block and sent
out; it never counts too little, so an estimate of one proves that a prefix belongs to one conversation
alone, and so do all longer ones. Such tails become nodes where they lie, without a shuffle. Only prefixes
that may be shared are shuffled and grouped exactly; what the sketch lets through by chance is told apart
there. The sketch is as large as the number of prefixes asks, up to ``MOST_CELLS`` a row (8 MB in all);
beyond that more prefixes pass the screen and results stay the same.

Sums over subtrees need no walk along the tree. A node belongs to its smallest member; the nodes of one
conversation are the lower end of its path. So a subtree's sum is a sum over the members of its top: the
whole of what each owns, less what the smallest one owns above.

Hot keys: digests and conversations that hold more than a thousandth of the rows (fewer than a thousand of
them) are salted in joins. Running sums go over stretches of sorted rows, so a conversation may hold any
share of the turns. Member lists are joined piecewise by many tasks and hashed in order as a stream.

Digests are 128 bits; two prefixes with equal digests count as equal.

Defined cases: turns are ordered by number, null first, those with equal numbers by the MD5 of role and
text; null roles and texts are empty; rows without a conversation id belong to none and are left out;
repeated rows are turns of their own; an empty table has no nodes, not even a root; other columns are not
looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardline.llm.common import Scratch

ROWS = 4  # hash functions of the sketch
MOST_CELLS = 1 << 24
BLOCK = 1 << 16
SALTS = 64
PIECE = 4096  # conversation ids joined into one string
SUMS = [f"s{i}" for i in range(4)]


def turn_rows(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv, turn, key, chars, row``: the content as a digest, so that no text is shuffled."""
    role_, text_ = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role, text)]
    content = F.concat(F.char_length(role_).cast("string"), F.lit(":"), role_, text_)
    return df.select(
        F.col(f"`{conv}`").cast("long").alias("conv"),
        F.col(f"`{turn}`").alias("turn"),
        F.unhex(F.md5(content)).alias("key"),
        F.char_length(text_).cast("long").alias("chars"),
        F.monotonically_increasing_id().alias("row"),
    ).where("conv is not null")


def running(df: DataFrame, key: str, order: list[Column], sums: dict[str, Column], scratch: Scratch, name: str) -> DataFrame:
    """``df`` with running totals per ``key`` in ``order``, the row itself included.

    Sorted stretches are summed by themselves. Only a key that goes on over the end of a stretch needs
    what came before it; such rows are fewer than stretches and are broadcast.
    """
    dealt = df.repartitionByRange(F.col(key), *order).sortWithinPartitions(F.col(key), *order)
    rows = scratch.save(
        dealt.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")), name
    )
    names = list(sums)
    parts = rows.groupBy(key, "_part").agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    before = W.partitionBy(key).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    carried = parts.select(key, "_part", *[F.sum(f"_{n}").over(before).alias(f"_{n}") for n in names])
    carried = F.broadcast(carried.where(F.col(f"_{names[0]}").isNotNull()))
    here = W.partitionBy(key, "_part").orderBy("_at").rowsBetween(W.unboundedPreceding, W.currentRow)
    summed = rows.select("*", *[F.sum(c).over(here).alias(n) for n, c in sums.items()]).join(carried, [key, "_part"], "left")
    totals = [(F.col(n) + F.coalesce(f"_{n}", F.lit(0))).alias(n) for n in names]
    return summed.select(*[c for c in df.columns if c not in names], *totals)


def hot_keys(counts: DataFrame, key: str, n: str) -> DataFrame:
    """Keys that hold more than a thousandth of all rows; there are fewer than a thousand."""
    total = counts.agg(F.sum(n)).first()[0] or 0
    return counts.where(F.col(n) > total / 1000).select(key)


def salted_join(facts: DataFrame, lookup: DataFrame, key: str, hot: DataFrame, spread: str, how: str = "inner") -> DataFrame:
    """Join with a ``lookup`` of one row per key; rows of hot keys are dealt over many tasks."""
    flag = F.broadcast(hot.select(key, F.lit(True).alias("_hot")))
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    salts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    left = facts.join(flag, key, "left").withColumn("_salt", salt).drop("_hot")
    right = lookup.join(flag, key, "left").withColumn("_salt", F.explode(salts)).drop("_hot")
    return left.join(right, [key, "_salt"], how).drop("_salt")


def rebuild(turns: DataFrame, scratch: Scratch, block: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """``(turns, heads)`` of conversations that begin with turns of the first one of their block.

    Conversation c takes the first h = crc32(c) % ``most`` turns of conversation c - c % ``block`` and goes
    on with its own turns after its first h. Turns are ``conv, pos, key, chars, length``; heads are ``conv,
    length``, turnless conversations included.
    """
    order = [F.col("turn").asc_nulls_first(), F.col("key"), F.col("row")]
    ranked = running(turns, "conv", order, {"n": F.lit(1).cast("long")}, scratch, "turns")
    ranked = scratch.save(ranked.select("conv", (F.col("n") - 1).alias("at"), "key", "chars"), "ranked")
    scratch.drop("turns")
    counts = scratch.save(ranked.groupBy("conv").agg(F.count("*").alias("own")), "counts")
    first = F.col("conv") % block == 0
    given = ranked.where(first & (F.col("at") < most - 1)).groupBy(F.col("conv").alias("donor")).agg(
        F.sort_array(F.collect_list(F.struct("at", "key", "chars"))).alias("given")  # most - 1 at most
    )
    heads = counts.select(
        "conv", "own", (F.crc32(F.col("conv").cast("string")) % most).alias("h"), (F.col("conv") - F.col("conv") % block).alias("donor")
    )
    none = F.array().cast("array<struct<at:bigint,key:binary,chars:bigint>>")
    taken = F.slice(F.coalesce("given", none), F.lit(1), F.col("h").cast("int"))
    heads = heads.join(given, "donor", "left").withColumn("taken", taken)
    rest = F.greatest(F.col("own") - F.col("h"), F.lit(0))
    heads = scratch.save(heads.select("conv", "h", "taken", (F.size("taken") + rest).cast("long").alias("length")), "heads")
    lent = heads.select("conv", "length", F.inline("taken").alias("pos", "key", "chars"))
    shift = heads.select("conv", "h", F.size("taken").alias("k"), "length")
    own = salted_join(ranked, shift, "conv", hot_keys(counts, "conv", "own"), "at").where("at >= h")
    own = own.select("conv", (F.col("at") - F.col("h") + F.col("k")).alias("pos"), "key", "chars", "length")
    return own.unionByName(lent), heads.select("conv", "length")


def _digest(depth: Column, sums: list[Column]) -> Column:
    return F.unhex(F.md5(F.concat_ws(",", depth.cast("string"), *[s.cast("string") for s in sums])))


def prefixes(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """A stored row per prefix: ``conv, depth, digest, parent, chars, length``."""
    halves = [F.xxhash64(F.col("key"), F.col("pos"), F.lit(i)) for i in range(2)]
    low = F.lit(0xFFFFFFFF).cast("long")
    words = [w for h in halves for w in (h.bitwiseAND(low), F.shiftrightunsigned(h, 32))]
    rows = turns.select("*", *[w.alias(f"w{i}") for i, w in enumerate(words)])
    summed = running(rows, "conv", [F.col("pos")], {s: F.col(f"w{i}") for i, s in enumerate(SUMS)}, scratch, "words")
    digest = _digest(F.col("pos") + 1, [F.col(s) for s in SUMS])
    parent = _digest(F.col("pos"), [F.col(s) - F.col(f"w{i}") for i, s in enumerate(SUMS)])
    done = summed.select(
        "conv", (F.col("pos") + 1).alias("depth"), digest.alias("digest"), parent.alias("parent"), "chars", "length"
    )
    done = scratch.save(done, "prefixes")
    scratch.drop("words")
    return done


def _cells(digests: pa.Array, cells: int) -> np.ndarray:
    """The cells of a digest, one per row of the sketch, as one range of numbers."""
    words = np.frombuffer(b"".join(digests.to_pylist()), np.uint32).reshape(-1, ROWS)
    return (words & np.uint32(cells - 1)).astype(np.int64) + np.arange(ROWS) * cells


def sketch(digests: DataFrame, cells: int) -> np.ndarray:
    """One bit per cell: more than one digest counted there. ``ROWS * cells / 8`` bytes reach the driver."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(ROWS * cells, np.uint8)
        for batch in batches:
            cell, n = np.unique(_cells(batch.column(0), cells), return_counts=True)
            counts[cell] = np.minimum(counts[cell] + np.minimum(n, 2), 2)
        for number, block in enumerate(counts.reshape(-1, BLOCK)):
            if block.any():
                yield pa.RecordBatch.from_pydict({"block": [int(number)], "counts": [zlib.compress(block.tobytes(), 1)]})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        for batch in batches:
            for number, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = np.frombuffer(zlib.decompress(raw), np.uint8)
                if number != now:
                    if now is not None:
                        yield pa.RecordBatch.from_pydict({"block": [int(now)], "bits": [np.packbits(total > 1).tobytes()]})
                    now, total = number, part
                else:
                    total = np.minimum(total + part, 2)
        if now is not None:
            yield pa.RecordBatch.from_pydict({"block": [int(now)], "bits": [np.packbits(total > 1).tobytes()]})

    parts = digests.mapInArrow(tally, "block long, counts binary").repartition("block").sortWithinPartitions("block")
    bits = np.zeros(ROWS * cells // 8, np.uint8)
    for row in parts.mapInArrow(merge, "block long, bits binary").collect():
        bits[row.block * BLOCK // 8 : (row.block + 1) * BLOCK // 8] = np.frombuffer(row.bits, np.uint8)
    return bits


def screened(rows: DataFrame, bits: np.ndarray, cells: int) -> DataFrame:
    """``rows`` with ``alone`` and ``parent_alone``: proven to belong to one conversation."""
    sent = rows.sparkSession.sparkContext.broadcast(bits)

    def single(digests: pa.Array) -> np.ndarray:
        cell = _cells(digests, cells)
        return ~(sent.value[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8) & 1).astype(bool).all(axis=1)

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alone, above = single(batch.column("digest")), single(batch.column("parent"))
            above &= np.asarray(batch.column("depth")) > 1  # the root is everyone's
            columns = [*batch.columns, pa.array(alone), pa.array(above)]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "alone", "parent_alone"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(screen, f"{schema}, alone boolean, parent_alone boolean")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of rows sorted by digest and id, joined by commas, ``PIECE`` of them at most."""

    def out(pieces: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*pieces))
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())],
            ["digest", "first", "ids"],
        )

    now, ids, pieces, size = None, [], [], 0
    for batch in batches:
        for digest, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if digest != now or len(ids) == PIECE:
                if ids:
                    pieces.append((now, ids[0], ",".join(map(str, ids))))
                    size += len(ids)
                now, ids = digest, []
                if size >= 16 * PIECE:
                    yield out(pieces)
                    pieces, size = [], 0
            ids.append(conv)
    if ids:
        pieces.append((now, ids[0], ",".join(map(str, ids))))
    if pieces:
        yield out(pieces)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the pieces of each digest, in order, piece after piece."""

    def out(done: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*done))
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.string())], ["digest", "ends"])

    now, state, done = None, None, []
    for batch in batches:
        for digest, ids in zip(batch.column("digest").to_pylist(), batch.column("ids").to_pylist()):
            if digest == now:
                state.update(b",")
            else:
                if now is not None:
                    done.append((now, state.hexdigest()))
                now, state = digest, hashlib.sha256()
            state.update(ids.encode())
        if done:
            yield out(done)
            done = []
    if now is not None:
        yield out([(now, state.hexdigest())])


def member_hashes(ends: DataFrame) -> DataFrame:
    """``digest, ends``: the hash of all its conversation ids in order."""
    pieces = ends.repartitionByRange("digest", "conv").sortWithinPartitions("digest", "conv")
    pieces = pieces.mapInArrow(_joined, "digest binary, first long, ids string")
    return pieces.repartition("digest").sortWithinPartitions("digest", "first").mapInArrow(_hashed, "digest binary, ends string")


def prefix_trie(turns: DataFrame, heads: DataFrame, scratch: Scratch, most_cells: int = MOST_CELLS) -> DataFrame:
    """A row per node: ``conv, depth, parent_conv, n_convs, n_children, n_leaves, saved, ends``.

    ``turns`` are ``conv, pos, key, chars, length`` with places from 0 without a gap; ``heads`` has every
    conversation and its length.
    """
    rows = prefixes(turns, scratch)
    wanted, cells = 4 * rows.count(), BLOCK
    while cells < min(wanted, most_cells):
        cells *= 2
    flagged = scratch.save(screened(rows, sketch(rows.select("digest"), cells), cells), "flagged")
    scratch.drop("prefixes")
    root = _digest(F.lit(0), [F.lit(0)] * 4)
    shared, tails = flagged.where("not alone"), flagged.where("alone")

    tops = heads.select(
        "conv", F.lit(0).cast("long").alias("depth"), root.alias("digest"), F.lit(None).cast("binary").alias("parent"),
        F.lit(0).cast("long").alias("chars"), "length",
    )
    grouped = shared.select(tops.columns).unionByName(tops).groupBy("digest").agg(
        F.min("conv").alias("conv"), F.count("*").alias("n_convs"), F.max("length").alias("deepest"),
        F.min("depth").alias("depth"), F.min("parent").alias("parent"), F.min("chars").alias("chars"),
    )
    grouped = grouped.withColumn("weight", (F.col("n_convs") - 1) * F.col("chars"))
    nodes = scratch.save(running(grouped, "conv", [F.col("depth")], {"through": F.col("weight")}, scratch, "grouped"), "nodes")
    scratch.drop("grouped")

    # What a conversation owns: the weight of its nodes, and a leaf if its last turn is the last of its path.
    leaf = (F.col("deepest") == F.col("depth")).cast("long")
    owned = nodes.select("conv", F.col("weight").alias("saved"), leaf.alias("leaves"))
    ends = tails.where("depth = length").select("conv", F.lit(0).cast("long").alias("saved"), F.lit(1).cast("long").alias("leaves"))
    gains = owned.unionByName(ends).groupBy("conv").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
    gains = scratch.save(gains.where("saved > 0 or leaves > 0"), "gains")
    hot = hot_keys(shared.groupBy("conv").agg(F.count("*").alias("n")), "conv", "n")
    given = salted_join(shared.select("conv", "digest"), gains, "conv", hot, "digest")
    given = given.select("digest", "saved", "leaves").unionByName(gains.select(root.alias("digest"), "saved", "leaves"))
    below = given.groupBy("digest").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("n_leaves"))

    first = tails.where("not parent_alone")
    asked = nodes.where("parent is not null").select("parent").unionByName(first.select("parent"))
    kids = scratch.save(asked.groupBy("parent").agg(F.count("*").alias("n_children")), "kids")
    crowded = hot_keys(kids, "parent", "n_children")
    names = nodes.select(F.col("digest").alias("parent"), F.col("conv").alias("parent_conv"))
    hashes = member_hashes(
        shared.where("depth = length").select("digest", "conv").unionByName(heads.where("length = 0").select(root.alias("digest"), "conv"))
    )
    empty = F.sha2(F.lit(""), 256)
    # The sketch may prove a prefix and not the next one: a parent left among the tails is the conversation's own.
    above = F.coalesce("parent_conv", F.when(F.col("depth") > 0, F.col("conv")))
    whole = (
        salted_join(nodes, names, "parent", crowded, "digest", "left")
        .join(below, "digest", "left")
        .join(kids.withColumnRenamed("parent", "digest"), "digest", "left")
        .join(hashes, "digest", "left")
        .select(
            "conv", "depth", above.alias("parent_conv"), "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves",
            (F.col("saved") - F.col("through") + F.col("weight")).alias("saved"), F.coalesce("ends", empty).alias("ends"),
        )
    )
    last = F.col("depth") == F.col("length")

    def tail(parent: Column) -> list[Column]:
        one, nil = F.lit(1).cast("long"), F.lit(0).cast("long")
        alone = F.when(last, F.sha2(F.col("conv").cast("string"), 256)).otherwise(empty)
        return [
            F.col("conv"), F.col("depth"), parent.alias("parent_conv"), one.alias("n_convs"),
            F.when(last, nil).otherwise(one).alias("n_children"), one.alias("n_leaves"), nil.alias("saved"), alone.alias("ends"),
        ]

    deep = tails.where("parent_alone").select(*tail(F.col("conv")))
    shallow = salted_join(first, names, "parent", crowded, "conv").select(*tail(F.col("parent_conv")))
    return whole.unionByName(deep).unionByName(shallow)
