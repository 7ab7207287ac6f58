"""N-gram Jaccard join, size-aware: subsets for small sets, inverted lists for large ones.

A document is its set of distinct word n-grams, hashed to 64 bits. Two sets link if
``100 * |A & B| >= percent * |A | B|``. Documents with equal sets form a class; classes are compared.

*Light* sets (size below a boundary) list all subsets that are left after taking away as many members
as a partner may lack: |A| - ceil(t |A|), at most a few. Linked light sets share such a subset, since
their intersection is one for both.

*Heavy* sets are found by scanning inverted lists. A list does not stand for one n-gram, whose lists
are as long as a passage is popular, but for a block of them: the n-grams are dealt by hash over
m = k + 1 + spare blocks, k being the largest symmetric difference that linked sets of these sizes can
have. A linked pair differs in at most k blocks, so spare + 1 blocks are equal. Each set enters the
lists of its k + 1 largest blocks; the largest of the equal blocks is among them on both sides. Small
blocks, which popular passages fill alone, are never listed. Blocks depend on sizes through bands;
a set enters all bands that a larger partner may lie in, so that pairs across bands meet.

The boundary is the size at which listing subsets gets dearer than listing blocks (``boundary``).
Sets that may link across it do both.

Members of a list are not paired with each other. Each is compared with the list's hub, the member
that shares the most lists; hubs and those linked to them become one part. Where the others of a list,
without its hub, still are of several parts, they are compared across parts through inverted lists
of single n-grams, of which each enters those of its rarest only (``_rare_pairs``). Links inside a part
tell nothing new, so none between components is lost. Every candidate is verified on the whole sets,
after short codes of the members have told apart those that lack too many (``_verified``).

Defined cases: null and empty texts have no n-grams, link with nothing and are their own component;
a text with fewer than n words is one n-gram; rows with equal or null ids are documents of their own.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.llm.common import Scratch, components, numbered, small, unpacked

GOLD = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xBF58476D1CE4E5B9)
BAND = 1.4  # sizes of a band reach from its start to BAND times that
SPARE = 0.15  # blocks left out, as a share of those listed
ENTRIES = 5_000_000  # more list entries than these are handled a slice of the lists at a time,
SLICES = 4  # so that no shuffle holds them all on disk


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX
    x = (x ^ (x >> np.uint64(27))) * GOLD
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-grams; words as in ``[^\\x20\\x09-\\x0D]+`` with A-Z lowered."""
    import xxhash

    # Bytes: lower() and split() then know ASCII letters and white space only, as asked for.
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    codes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(n, len(words))
    grams = np.full(len(words) - width + 1, width, np.uint64)
    for i in range(width):
        grams = mix(grams * GOLD + codes[i : len(codes) - width + 1 + i])
    return np.unique(grams)


class Plan:
    """Which lists a set of a given size enters, for a threshold in percent."""

    def __init__(self, percent: int):
        self.percent = percent
        self.light = self.boundary()

    def largest(self, size: int) -> int:
        """The largest partner of a set of ``size``."""
        return size * 100 // self.percent

    def lacking(self, size: int) -> int:
        """How many of ``size`` members a partner may lack."""
        return size - -(-self.percent * size // 100)

    def differing(self, top: int) -> int:
        """Largest symmetric difference of linked sets of at most ``top`` members each."""
        return (100 - self.percent) * 2 * top // (100 + self.percent)

    def subsets(self, size: int) -> int:
        return math.comb(size, self.lacking(size))

    def band(self, size: int) -> int:
        return int(math.log(size) / math.log(BAND) + 1e-9)

    def top(self, band: int) -> int:
        return int(BAND ** (band + 1)) + 1

    def bands(self, size: int) -> list[int]:
        """All bands from the own one to that of the largest partner."""
        return list(range(self.band(size), self.band(self.largest(size)) + 1))

    def blocks(self, band: int) -> tuple[int, int]:
        """Blocks in all and blocks listed."""
        listed = self.differing(self.top(band)) + 1
        return listed + math.ceil(listed * SPARE), listed

    def boundary(self) -> int:
        """Smallest size whose subsets, at most one fewer per lost member, outnumber its listed blocks."""
        if self.percent == 100:  # equal sets only: a set has one subset, whatever its size
            return 1 << 62
        size = 1
        while sum(math.comb(size, d) for d in range(self.lacking(size) + 1)) <= 2 * sum(self.blocks(b)[1] for b in self.bands(size)):
            size += 1
        return size

    def keys(self, grams: np.ndarray) -> np.ndarray:
        """Hashes of the lists that the set enters."""
        size, out = len(grams), []
        if size == 0:
            return grams
        if size < self.light:
            total = mix(grams + GOLD)
            everything = total.sum(dtype=np.uint64)
            for gone in range(self.lacking(size) + 1):
                taken = np.fromiter(
                    (int(total[list(c)].sum(dtype=np.uint64)) if c else 0 for c in combinations(range(size), gone)), np.uint64
                )
                # Named by the members left and their number.
                out.append(mix(mix(everything - taken) + np.uint64(size - gone)))
        if self.largest(size) >= self.light:
            for band in self.bands(size):
                blocks, listed = self.blocks(band)
                at = (mix(grams) % np.uint64(blocks)).astype(np.int64)
                number = np.bincount(at, minlength=blocks)
                sums = np.zeros(blocks, np.uint64)
                np.add.at(sums, at, mix(grams + GOLD))
                place = np.arange(blocks, dtype=np.uint64) + np.uint64(band << 32)
                names = mix(mix(sums) ^ mix(place * GOLD + number.astype(np.uint64)))
                # The largest blocks, ties by what is in them: the same order on both sides of a pair.
                order = np.lexsort((names, -number))[:listed]
                out.append(names[order])
        return np.concatenate(out)


def _sets(rows: DataFrame, n: int, plan: Plan | None) -> DataFrame:
    """``_rid, size, s1, s2`` (a 128-bit name of the set) and ``keys``, or the set itself without a plan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, s1, s2, lists = [], [], [], []
            for text in batch.column(1).to_pylist():
                grams = shingles(text, n)
                size.append(len(grams))
                s1.append(mix(grams).sum(dtype=np.uint64).astype(np.int64))
                s2.append(mix(grams ^ MIX).sum(dtype=np.uint64).astype(np.int64))
                lists.append((plan.keys(grams) if plan else grams).astype(np.int64))
            ends = np.cumsum([0, *map(len, lists)])
            flat = np.concatenate(lists) if lists else np.empty(0, np.int64)
            columns = [
                batch.column(0), pa.array(size, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["_rid", "size", "s1", "s2", "keys"])

    return rows.select("_rid", "_text").mapInArrow(run, "_rid long, size long, s1 long, s2 long, keys array<bigint>")


def _verified(pairs: DataFrame, rows: DataFrame, n: int, percent: int, scratch: Scratch, name: str) -> DataFrame:
    """The linked ones of ``pairs`` (``src, dst``), from the whole sets of the texts involved only.

    Codes are the first 16 bits of the members. A code that the other side has not stands for at least
    one member that it has not, which bounds what is shared; only pairs within that bound move whole sets.
    """

    def only(rows: DataFrame, pairs: DataFrame, ids: str) -> DataFrame:
        both = pairs.select(F.col("src").alias("_rid")).union(pairs.select(F.col("dst").alias("_rid"))).distinct()
        return rows.join(small(scratch.save(both, ids), 16), "_rid", "left_semi")

    involved = _sets(only(rows, pairs, f"{name}-ids"), n, None)
    codes = F.array_distinct(F.transform("keys", lambda gram: F.shiftright(gram, 48).cast("smallint")))
    sets = scratch.save(involved.select("_rid", "size", F.col("keys").alias("grams"), codes.alias("codes")), f"{name}-sets")

    def within(pairs: DataFrame, sets: DataFrame, column: str, shared: Column) -> DataFrame:
        left = sets.select(F.col("_rid").alias("src"), F.col("size").alias("a_size"), F.col(column).alias("a"))
        right = sets.select(F.col("_rid").alias("dst"), F.col("size").alias("b_size"), F.col(column).alias("b"))
        both = pairs.join(left, "src").join(right, "dst")
        linked = 100 * shared >= percent * (F.col("a_size") + F.col("b_size") - shared)
        return both.where(linked).select("src", "dst")

    equal = F.size(F.array_intersect("a", "b"))
    most = F.least(F.col("a_size") - F.size("a"), F.col("b_size") - F.size("b")) + equal
    near = scratch.save(within(pairs, sets, "codes", most), f"{name}-near")
    out = scratch.save(within(near, only(sets, near, f"{name}-near-ids"), "grams", equal), f"{name}-links")
    scratch.drop(f"{name}-sets", f"{name}-ids", f"{name}-near", f"{name}-near-ids")
    return out


def _rare_pairs(members: DataFrame, rows: DataFrame, n: int, percent: int, scratch: Scratch) -> DataFrame:
    """Pairs of ``members`` (``_rid, part``) of different parts that may still link.

    Of linked sets, each in the order of rarity among the members, the first common n-gram stands so
    far in front that what follows can still make the overlap. What copies of one text share is
    frequent and stands behind what is their own, so copies too far from each other never meet.
    """
    ids = small(members.select("_rid"), 16)
    grams = _sets(rows.join(ids, "_rid", "left_semi"), n, None).select("_rid", "size", F.explode("keys").alias("gram"))
    grams = scratch.save(grams, "grams")
    # Whatever occurs once stands in front of all that is shared and pairs with nothing.
    counts = grams.groupBy("gram").agg(F.count("*").alias("many")).where("many > 1")
    counts = scratch.save(counts, "counts")
    order = Window.partitionBy("_rid").orderBy("many", "gram")
    slices = 1 if grams.count() <= ENTRIES else SLICES
    for number in range(slices):
        part = grams.where(F.pmod(F.xxhash64("_rid"), F.lit(slices)) == number) if slices > 1 else grams
        known = part.join(counts, "gram")
        once = F.col("size") - F.count("*").over(Window.partitionBy("_rid"))
        ranked = known.withColumn("place", once + F.row_number().over(order) - 1)
        # At most size - ceil(t * size) members stand before the first common one.
        front = ranked.where(100 * (F.col("size") - F.col("place")) >= percent * F.col("size"))
        front = scratch.save(front.select("gram", "_rid", "size", "place"), "front", "append")
    scratch.drop("grams", "counts")
    front = front.join(small(members, 24), "_rid")
    a = front.select("gram", *[F.col(c).alias(f"a_{c}") for c in ("_rid", "part", "size", "place")])
    b = front.select("gram", *[F.col(c).alias(f"b_{c}") for c in ("_rid", "part", "size", "place")])
    sizes = F.col("a_size") + F.col("b_size")
    ahead = F.least(F.col("a_size") - F.col("a_place"), F.col("b_size") - F.col("b_place"))
    near = (F.col("a__rid") < F.col("b__rid")) & (F.col("a_part") != F.col("b_part")) & ((100 + percent) * ahead >= percent * sizes)
    met = a.join(b, (a["gram"] == b["gram"]) & near)
    return met.select(F.col("a__rid").alias("src"), F.col("b__rid").alias("dst")).distinct()


def _nearest_hub(links: DataFrame) -> DataFrame:
    """``_rid, part``: of a node and its neighbours the one with most links.

    Nodes with equal parts are connected, which is all that comparing across parts asks for.
    """
    both = links.select("src", "dst").union(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    degrees = both.groupBy(F.col("src").alias("dst")).agg(F.count("*").alias("degree"))
    known = both.union(degrees.select("dst", F.col("dst").alias("_self"))).join(degrees, "dst")
    best = F.max_by("dst", F.struct("degree", -F.col("dst")))
    return known.groupBy(F.col("src").alias("_rid")).agg(best.alias("part"))


def link_documents(
    docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 3, percent: int = 90, scratch: Scratch | None = None
) -> DataFrame:
    """``_row, _rid, n_shingles, component``: the smallest ``_rid`` reachable by links, itself included."""
    scratch = scratch or Scratch(docs.sparkSession, "jaccard")
    rows = numbered(docs, key, scratch, text)
    return rows.join(_components(rows, text, n, percent, scratch), "_rid")


def _components(rows: DataFrame, text: str, n: int, percent: int, scratch: Scratch) -> DataFrame:
    """``_rid, n_shingles, component`` of packed, numbered rows, as a stored table."""
    slim = rows.select("_rid", F.col("_row").getField(text).alias("_text"))
    plan = Plan(percent)
    sets = scratch.save(_sets(slim, n, plan), "sets")
    classes = sets.where("size > 0").groupBy("s1", "s2").agg(F.min("_rid").alias("class"))
    classes = scratch.save(classes, "classes")
    # Representatives carry their lists; the class is joined by the set's name.
    members = sets.where("size > 0").join(classes, ["s1", "s2"]).select("_rid", "class")
    members = scratch.save(members, "members")
    # Copies are fewer than firsts; while their numbers are few, no lists are shuffled for this.
    copies = small(members.where("_rid != class").select("_rid"), 16)
    entries = sets.join(copies, "_rid", "left_anti").select(F.explode("keys").alias("list"), "_rid")
    sizes = scratch.save(sets.select("_rid", F.col("size").alias("n_shingles")), "sizes")
    scratch.drop("classes")
    slices = 1 if entries.count() <= ENTRIES else SLICES

    def by_slice(df: DataFrame, step: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
        for number in range(slices):
            part = df.where(F.pmod("list", F.lit(slices)) == number) if slices > 1 else df
            out = scratch.save(step(part), name, "append")
        return out

    def shared(part: DataFrame) -> DataFrame:
        counts = part.groupBy("list").agg(F.count("*").alias("many")).where("many > 1")
        # Most lists have one member: what the few others count is sent to the entries while it is small.
        counts = small(scratch.save(counts, "shared", "overwrite"), 24)
        return part.join(counts, "list").select("list", "_rid", "many")

    met = by_slice(entries, shared, "met")
    scratch.drop("sets", "shared")
    # The hub of a list: the member that meets most others over all its lists.
    weight = scratch.save(met.groupBy("_rid").agg(F.sum("many").alias("weight")), "weight")
    known = small(weight, 24)

    def to_hub(part: DataFrame) -> DataFrame:
        weighed = part.join(known, "_rid")
        hubs = weighed.groupBy("list").agg(F.max_by("_rid", F.struct("weight", -F.col("_rid"))).alias("hub"))
        return part.join(hubs, "list").where("_rid != hub").select("list", "_rid", "hub", "many")

    spokes = by_slice(met, to_hub, "spokes")
    scratch.drop("met", "weight")
    pairs = spokes.select(F.least("_rid", "hub").alias("src"), F.greatest("_rid", "hub").alias("dst"))
    pairs = scratch.save(pairs.distinct(), "pairs")
    links = _verified(pairs, slim, n, percent, scratch, "hub")
    parts = small(scratch.save(_nearest_hub(links), "parts"), 24)

    def mixed(part: DataFrame) -> DataFrame:
        # The hub has been compared with all others of its list, so two members ask for nothing more.
        named = part.where("many > 2").join(parts, "_rid", "left").select("list", "_rid", F.coalesce("part", "_rid").alias("part"))
        several = named.groupBy("list").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high")
        return named.join(several.select("list"), "list", "left_semi").groupBy("_rid").agg(F.min("part").alias("part"))

    open_ = by_slice(spokes, mixed, "mixed").groupBy("_rid").agg(F.min("part").alias("part"))
    open_ = scratch.save(open_, "open")
    scratch.drop("spokes", "mixed", "parts")
    rest = _rare_pairs(open_, slim, n, percent, scratch).join(pairs, ["src", "dst"], "left_anti")
    rest = scratch.save(rest, "rest")
    scratch.drop("front", "pairs", "open")
    links = links.union(_verified(rest, slim, n, percent, scratch, "rest"))
    whole = components(links, scratch, "classes-linked").withColumnRenamed("node", "class")
    named = members.join(whole, "class", "left").select("_rid", F.coalesce("component", "class").alias("component"))
    sizes = sizes.join(named, "_rid", "left")
    return scratch.save(sizes.select("_rid", "n_shingles", F.coalesce("component", "_rid").alias("component")), "result")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """The documents that are the first of their component, with their columns."""
    scratch = Scratch(docs.sparkSession, "jaccard")
    rows = numbered(docs, key, scratch, text)
    # What goes is less than what stays; while its numbers are few, no text is shuffled.
    gone = _components(rows, text, n, percent, scratch).where("_rid != component").select("_rid")
    return unpacked(rows.join(small(gone, 16), "_rid", "left_anti"), docs.columns)
