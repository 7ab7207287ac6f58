"""Repeated-passage removal by distributed prefix doubling.

A start is removed-from if the ``length`` bytes there also start earlier (smaller document, or the
same one further left). Ranks of positions at growing lengths decide which starts are equal; a rank
is a hash of content, so a document names its own positions and rank(2n, i) = f(rank(n, i),
rank(n, i + n)) needs no shuffle. Spark sorts positions by rank, drops those whose rank is unique and
goes on with longer ranks for the others until ``length`` is reached:

1. Rank at ``GRAM`` bytes. Every window of ``length`` bytes is represented by the smallest rank in
   it, so equal windows have equal representatives at equal distances and only these positions, about
   one in 35, are sorted. Windows with the same representative lie side by side and form a run.
2. Rank of the whole run (up to ``2 * length - GRAM`` bytes). Of runs with equal ranks all but the
   first are removed. A first run goes on only if its representative has runs of other ranks.
3. Rank at ``length`` bytes of every window of the runs left, compared per representative. Runs of a
   representative are handled together by one task; those of a representative with more than ``HOT``
   different runs are spread window by window.

Ranks compared are 128 bits (that of the representative and that of the run or window).

Defined cases: a null text is empty; windows never cross documents; rows with equal or null ids are
documents of their own, in the order of id (nulls last) and text hash. Long texts are ranked in
segments that overlap, so memory is bounded by a batch of texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardline.llm.common import Scratch, numbered, small
from wardline.llm.ngram_join import GOLD, MIX, mix

GRAM = 32
HOT = 2048
PART = 40_000  # runs per task in step 3
SEGMENT = 1 << 19  # window starts ranked at a time
_PLACE = np.uint64((1 << 20) - 1)
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * GOLD)


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rank of two neighbours."""
    x = a * MIX
    x += b
    x ^= x >> np.uint64(29)
    x *= GOLD
    x ^= x >> np.uint64(32)
    return x


def ranks(data: np.ndarray, lengths: list[int]) -> dict[int, np.ndarray]:
    """Ranks at the given lengths for every start that has as many bytes, by doubling."""
    powers, size = {1: _BYTE[data]}, 1
    while 2 * size <= max(lengths):
        now = powers[size]
        powers[2 * size] = _join(now[:-size], now[size:]) if len(now) > size else now[:0]
        size *= 2
        if size // 2 > 1 and not any(n & (size // 2) for n in lengths):
            del powers[size // 2]
    out = {}
    for n in lengths:
        rank, done = None, 0
        for bit in sorted((1 << i for i in range(n.bit_length()) if n >> i & 1), reverse=True):
            here = powers[bit][done:]
            rank = here if rank is None else _join(rank[: len(here)], here[: len(rank)])
            done += bit
        out[n] = rank[: max(0, len(data) - n + 1)]
    return out


def _lowest(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours."""
    size = 1
    while 2 * size <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[: len(values) - (width - size)], values[width - size :])


def runs(data: np.ndarray, owner: np.ndarray, ends: np.ndarray, length: int):
    """``start, last, place, gram, run``: runs of windows, their representative's place, both ranks.

    ``owner`` is the text each byte belongs to, ``ends`` where texts end.
    """
    block = 1 << (length.bit_length() - 1)
    named = ranks(data, [GRAM, block])
    gram, wide = named[GRAM], named[block]
    place = np.arange(len(gram), dtype=np.uint64)
    # Rank above, place below: the leftmost of equal ranks is the smallest, and places can be read off.
    lowest = _lowest((gram & ~_PLACE) | place, length - GRAM + 1)
    starts = np.flatnonzero(np.arange(len(lowest)) + length <= ends[owner[: len(lowest)]])
    if not len(starts):
        empty = np.empty(0, np.int64)
        return empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    at = (lowest[starts] & _PLACE).astype(np.int64)
    new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (owner[starts[1:]] != owner[starts[:-1]])])
    first, last, at = starts[new], starts[np.r_[new[1:] - 1, len(starts) - 1]], at[new]
    bytes_ = last - first + length
    pieces = -(-(2 * length - GRAM) // block)
    rank = mix((at - first).astype(np.uint64) * GOLD + (last - first).astype(np.uint64))
    for i in range(pieces):
        rank = _join(rank, wide[first + i * (bytes_ - block) // max(1, pieces - 1)])
    return first, last, at, gram[at], rank


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.int64))


def _ranked(length: int):
    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            texts = [t or b"" for t in batch.column(1).to_pylist()]
            # (text, first byte, last byte): long texts in segments that overlap by length - 1.
            parts = []
            for i, t in enumerate(texts):
                parts += [(i, a, min(len(t), a + SEGMENT + length - 1)) for a in range(0, max(0, len(t) - length + 1), SEGMENT)]
            group, held = [], 0
            for part in [*parts, None]:
                if part is None or held + part[2] - part[1] > 2 * SEGMENT:
                    if group:
                        yield from _ranked_group(ids, texts, group, length)
                    group, held = [], 0
                if part is not None:
                    group.append(part)
                    held += part[2] - part[1]

    return rank


def _ranked_group(ids: np.ndarray, texts: list[bytes], group: list, length: int) -> Iterator[pa.RecordBatch]:
    data = np.frombuffer(b"".join(texts[i][a:b] for i, a, b in group), np.uint8)
    sizes = np.array([b - a for _, a, b in group])
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(group), dtype=np.int32), sizes)
    first, last, at, gram, run = runs(data, owner, ends, length)
    if not len(first):
        return
    mine = owner[first]
    shift = (np.array([a for _, a, _ in group]) - (ends - sizes))[mine]
    rid = ids[np.array([i for i, _, _ in group])][mine]
    first, last, at = first + shift, last + shift, at + shift
    # A run that its own document repeats is listed once, with the repeats beside it.
    order = np.lexsort((first, run, gram, rid))
    same = np.r_[False, (rid[order][1:] == rid[order][:-1]) & (gram[order][1:] == gram[order][:-1]) & (run[order][1:] == run[order][:-1])]
    repeat = np.empty(len(order), bool)
    repeat[order] = same
    also: list = [None] * len(order)
    head = None
    for o, again in zip(order[np.r_[same[1:], False] | same], same[np.r_[same[1:], False] | same]):
        if again:
            also[head] = (also[head] or b"") + np.array([first[o], last[o]], "<i8").tobytes()
        else:
            head = o
    keep = np.flatnonzero(~repeat)
    meta = ((at - first) << 16 | (at - last))[keep]
    yield pa.RecordBatch.from_arrays(
        [pa.array(rid[keep]), _signed(gram[keep]), _signed(run[keep]), pa.array(at[keep]), pa.array(meta),
         pa.array([also[i] for i in keep], pa.binary())],
        ["_rid", "gram", "run", "at", "meta", "also"],
    )


def _cut(length: int):
    """The bytes of listed runs: ``gram, many, _rid, first, back, bytes``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["gram", "many", "_rid", "first", "back", "bytes"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            out, held = [], 0
            for rid, text, listed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                for r in listed:
                    first, last = r["at"] - (r["meta"] >> 16), r["at"] - (r["meta"] & 65535)
                    out.append((r["gram"], r["many"], rid, first, r["at"] - first, text[first : last + length]))
                if len(out) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    return cut


def _window_ranks(table: pa.Table, length: int):
    """For each window of the runs: row, place in its run, and the two halves of its rank."""
    rows = table.column("bytes").to_pylist()
    sizes = np.array([len(b) for b in rows])
    data = np.frombuffer(b"".join(rows), np.uint8)
    rank = ranks(data, [length])[length]
    begin = np.cumsum(sizes) - sizes
    number = sizes - length + 1
    row = np.repeat(np.arange(len(rows)), number)
    place = np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)
    back = table.column("back").to_numpy()[row] - place
    gram = table.column("gram").to_numpy().astype(np.uint64)[row]
    return row, place, mix(gram + back.astype(np.uint64) * GOLD), rank[begin[row] + place]


def _compared(length: int):
    """Starts to remove as ``_rid, lo, hi`` from all runs of the representatives of a partition."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held).sort_by([("_rid", "ascending"), ("first", "ascending")])
        if not table.num_rows:
            return
        row, place, upper, lower = _window_ranks(table, length)
        # Stable: windows of equal rank stay in the order of documents and starts.
        order = np.lexsort((upper, lower))
        again = np.zeros(len(order), bool)
        again[order[1:]] = (upper[order][1:] == upper[order][:-1]) & (lower[order][1:] == lower[order][:-1])
        gone = np.flatnonzero(again)
        if not len(gone):
            return
        new = np.flatnonzero(np.r_[True, (np.diff(gone) != 1) | (np.diff(row[gone]) != 0)])
        lo, hi = gone[new], gone[np.r_[new[1:] - 1, len(gone) - 1]]
        start = table.column("first").to_numpy()
        rid = table.column("_rid").to_numpy()[row[lo]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(rid), pa.array(start[row[lo]] + place[lo]), pa.array(start[row[hi]] + place[hi])], ["_rid", "lo", "hi"]
        )

    return compare


def _spread(length: int):
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if table.num_rows:
                row, place, upper, lower = _window_ranks(table, length)
                rid, first = table.column("_rid").to_numpy()[row], table.column("first").to_numpy()[row]
                yield pa.RecordBatch.from_arrays(
                    [_signed(upper), _signed(lower), pa.array(rid), pa.array(first + place)], ["upper", "lower", "_rid", "at"]
                )

    return spread


def _cleaned(length: int):
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for rid, text, lists in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                edges = np.zeros(len(text) + 1, np.int32)
                flat = lists.values
                np.add.at(edges, flat.field(0).to_numpy(), 1)
                np.add.at(edges, flat.field(1).to_numpy() + length, -1)
                gone = np.cumsum(edges[:-1]) > 0
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                spans = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + gone[0])
                out.append((rid, len(text), int(gone.sum()), spans, kept))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            columns = list(zip(*out)) if out else [()] * 5
            names = ["_rid", "n_bytes", "n_removed", "n_spans", "kept"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return clean


def repeated_starts(slim: DataFrame, length: int, scratch: Scratch) -> DataFrame:
    """``_rid, lo, hi``: starts (both included) whose window also starts earlier, of ``_rid, _bytes``."""
    ranked = slim.mapInArrow(_ranked(length), "_rid long, gram long, run long, at long, meta long, also binary")
    order = W.partitionBy("gram").orderBy("run", "_rid", "at")
    first = F.coalesce(F.lag("run").over(order) != F.col("run"), F.lit(True))
    judged = ranked.withColumn("first", first)
    judged = judged.withColumn("many", F.sum(F.col("first").cast("long")).over(W.partitionBy("gram")))
    judged = judged.where("not first or many > 1 or also is not null").select(
        "_rid", "at", "meta", "also", "first", "many", F.when(F.col("first") & (F.col("many") > 1), F.col("gram")).alias("gram")
    )
    judged = scratch.save(judged, "judged")
    last = F.col("at") - F.col("meta").bitwiseAND(65535)
    whole = judged.where("not first").select("_rid", (F.col("at") - F.shiftright("meta", 16)).alias("lo"), last.alias("hi"))
    local = judged.where("also is not null").select("_rid", "also").mapInArrow(_also, "_rid long, lo long, hi long")
    listed = judged.where("gram is not null").groupBy("_rid").agg(F.collect_list(F.struct("gram", "many", "at", "meta")).alias("runs"))
    cut = slim.join(listed, "_rid").select("_rid", "_bytes", "runs")
    cut = cut.mapInArrow(_cut(length), "gram long, many long, _rid long, first long, back long, bytes binary")
    cut = scratch.save(cut, "cut")
    calm, hot = cut.where(F.col("many") <= HOT), cut.where(F.col("many") > HOT)
    parts = max(1, -(-calm.count() // PART))
    partly = calm.repartition(parts, "gram").mapInArrow(_compared(length), "_rid long, lo long, hi long")
    windows = hot.mapInArrow(_spread(length), "upper long, lower long, _rid long, at long")
    windows = scratch.save(windows, "windows")
    heads = windows.groupBy("upper", "lower").agg(F.min(F.struct("_rid", "at")).alias("head"), F.count("*").alias("n")).where("n > 1")
    spread = windows.join(heads, ["upper", "lower"]).where("head.at != at or head._rid != _rid")
    spread = spread.select("_rid", F.col("at").alias("lo"), F.col("at").alias("hi"))
    return scratch.save(whole.union(local).union(partly).union(spread), "starts")


def _also(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, pairs = batch.column(0).to_numpy(), [np.frombuffer(b, "<i8").reshape(-1, 2) for b in batch.column(1).to_pylist()]
        flat = np.concatenate(pairs) if pairs else np.empty((0, 2), np.int64)
        rid = np.repeat(ids, [len(p) for p in pairs])
        yield pa.RecordBatch.from_arrays([pa.array(rid), pa.array(flat[:, 0].copy()), pa.array(flat[:, 1].copy())], ["_rid", "lo", "hi"])


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 100) -> DataFrame:
    """``_key, n_bytes, n_removed, n_spans, kept`` (the bytes that stay) for every row of ``docs``."""
    scratch = Scratch(docs.sparkSession, "suffix")
    rows = numbered(docs, key, scratch, text)
    field = F.col("_row").getField
    body = F.coalesce(field(text), F.lit("")).cast("binary")
    slim = rows.select("_rid", body.alias("_bytes"))
    starts = repeated_starts(slim, length, scratch)
    lists = starts.groupBy("_rid").agg(F.collect_list(F.struct("lo", "hi")).alias("starts"))
    lists = scratch.save(lists, "lists")
    ids = small(lists.select("_rid"), 16)
    touched = slim.join(ids, "_rid", "left_semi").join(lists, "_rid").select("_rid", "_bytes", "starts")
    cleaned = touched.mapInArrow(_cleaned(length), "_rid long, n_bytes long, n_removed long, n_spans long, kept binary")
    zero = F.lit(0).cast("long")
    calm = slim.join(ids, "_rid", "left_anti").select(
        "_rid", F.octet_length("_bytes").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.col("_bytes").alias("kept")
    )
    keys = rows.select("_rid", field(key).alias("_key"))
    return cleaned.union(calm).join(keys, "_rid")
