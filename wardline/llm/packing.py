"""Best-fit packing with certified bin counts.

Documents become token ids, longer ones are cut into pieces of ``capacity`` tokens (the first may be
shorter). Pieces of full length are sequences by themselves. The others are dealt over partitions of
bounded size; each is packed best-fit decreasing. Dual feasible functions bound from below how many
sequences a partition needs: where the bound is met, the packing is proven best and stays. Partitions
with a gap hand in the pieces of their sequences that are not full; these are dealt anew over fewer
partitions, so that pieces meet others, and packed again, until no gap or one partition is left. A round
that does not lower the number of sequences is undone and ends the exchange.

Tokens between single blanks and line breaks do not depend on what is beside them, so such chunks are
remembered per worker, a bounded number of them. Texts with runs of white space, where that does not hold, are encoded whole.

Defined cases: a null text is empty; every document ends with id 0, so an empty one is a piece of
length 1; rows with equal or null ids are documents of their own. No documents give no rows.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import Scratch, numbered

REMEMBERED = 200_000  # chunks per worker, and as many of those before; only what is met again stays longer
TOGETHER = 1_500_000  # bytes of text encoded at a time
# Rows sent to a worker at a time: a batch lies in the JVM and in the worker, whole, beside what both hold.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}
_CUT, _END = "\x00", "\x01"
_SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
# White space beside white space: there a blank or line break may belong to the token before.
_ODD = rf"{_SPACE}{_SPACE}|[\x00\x01]"
PIECES = "_rid long, _key long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long, part int, bound long, gap long, load long"


def _same_in_bulk(model: str):
    """A faster encoder with the same ids, or None if the file does not promise them.

    It does if it is a byte-level merge model whose merges make the ids in their order, so that the
    ids are the ranks, with the usual split of texts and nothing before it.
    """
    import public_tokenizers
    import tiktoken

    file = json.loads(model)
    split, merges = file.get("pre_tokenizer") or {}, file["model"].get("merges") or []
    usual = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
    if file["model"].get("type") != "BPE" or not usual or file.get("normalizer"):
        return None
    ids = file["model"]["vocab"]
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
    if any(ids.get(a + b) != 256 + i for i, (a, b) in enumerate(pairs)):
        return None
    # Byte-level files spell printable bytes as themselves and the others as the letters from 256 on.
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    names = [*(t for t, i in ids.items() if i < 256), *(a + b for a, b in pairs)]
    ranks = {bytes(byte[c] for c in name): ids[name] for name in names}
    return tiktoken.Encoding("same", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """Ids of texts by a tokenizer file's content."""

    def __init__(self, model: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.seen: dict[str, bytes] = {}  # ids as little-endian 32-bit numbers
        self.before: dict[str, bytes] = {}
        self.bulk = _same_in_bulk(model)
        self.line_break = int(self.whole("\n")[0])

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _learn(self, chunks: list[str]) -> None:
        if self.bulk is None:
            plain = chunks
        else:
            # One call for many: chunks on lines of their own come back apart at the line breaks.
            bodies = [c[1:] if c[0] == "\n" else c for c in chunks]
            apart = [len(b.split()) == 1 and not b[-1].isspace() for b in bodies]
            lines = [b for b, ok in zip(bodies, apart) if ok]
            raw = array("I", self.bulk.encode_ordinary("\n".join([*lines, ""])))
            cuts = np.flatnonzero(np.frombuffer(raw, "<u4") == self.line_break)
            if len(cuts) != len(lines):
                raise ValueError("line breaks and chunks do not match")
            ids, begin, found = raw.tobytes(), 0, []
            for end in (cuts * 4).tolist():
                found.append(ids[begin:end])
                begin = end + 4
            each = iter(found)
            first = array("I", [self.line_break]).tobytes()
            for c, ok in zip(chunks, apart):
                if ok:
                    self.seen[c] = first + next(each) if c[0] == "\n" else next(each)
            plain = [c for c, ok in zip(chunks, apart) if not ok]
        for chunk, own in zip(plain, self.tokenizer.encode_batch_fast(plain, add_special_tokens=False)):
            self.seen[chunk] = array("I", own.ids).tobytes()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, 0 behind each, and where each text's ids end."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, _ODD)
        for mark in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, mark))
        calm = pc.if_else(odd, "", texts)
        marked = pc.replace_substring(pc.replace_substring(calm, " ", _CUT + " "), "\n", _CUT + "\n")
        lists = pc.split_pattern(pc.binary_join_element_wise(marked, _END, _CUT), _CUT)
        coded = pc.dictionary_encode(lists.flatten())
        chunks = coded.dictionary.to_pylist()
        fixed = {"": b"", _END: bytes(4)}
        known = list(map(self.seen.get, chunks))
        if None in known:
            new = [c for c, k in zip(chunks, known) if k is None and c not in fixed]
            if len(self.seen) + len(new) > REMEMBERED:
                self.before, self.seen = self.seen, {}
            self.seen.update((c, self.before[c]) for c in new if c in self.before)
            self._learn([c for c in new if c not in self.before])
            known = [self.seen.get(c) or fixed[c] if k is None else k for c, k in zip(chunks, known)]
        width = np.fromiter(map(len, known), np.int64, len(known)) // 4
        first = np.cumsum(width) - width
        codes = coded.indices.to_numpy()
        each = width[codes]
        after = np.cumsum(each)
        place = np.repeat(first[codes] - (after - each), each)
        place += np.arange(len(place))
        ids = np.frombuffer(b"".join(known), "<u4")[place]
        ends = np.concatenate([[0], after])[lists.offsets.to_numpy()[1:] - lists.offsets[0].as_py()]
        return self._with_odd(ids, ends, texts, np.flatnonzero(odd.to_numpy(zero_copy_only=False)))

    def _with_odd(self, ids: np.ndarray, ends: np.ndarray, texts: pa.Array, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts that were left out are encoded whole and put in before their 0."""
        if not len(odd):
            return ids, ends
        parts, at, more = [], 0, np.zeros(len(ends), np.int64)
        for i in odd:
            own = self.whole(texts[int(i)].as_py())
            parts += [ids[at : ends[i] - 1], own]
            at, more[i] = ends[i] - 1, len(own)
        return np.concatenate([*parts, ids[at:]]), ends + np.cumsum(more)


def tokenized_pieces(rows: DataFrame, key: str, text: str, model: str, capacity: int) -> DataFrame:
    """``PIECES`` of packed, numbered documents. ``model`` is the content of a tokenizer file (bounded, fixed)."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    field = F.col("_row").getField
    slim = rows.select("_rid", field(key).cast("long").alias("_key"), field(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = Encoder(shared.value)
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            # Some megabytes of text at a time; a longer text stands alone.
            share = (np.cumsum(sizes) - sizes) // TOGETHER
            groups = np.flatnonzero(np.r_[True, share[1:] != share[:-1]]).tolist() if len(share) else []
            for a, b in zip(groups, [*groups[1:], batch.num_rows]):
                part = batch.slice(a, b - a)
                at, cut, begin = [], [], 0
                ids, ends = encoder.encode(part.column(2))
                for row, end in enumerate(ends.tolist()):
                    first = (end - begin) % capacity or capacity
                    edges = [begin, *range(begin + first, end + 1, capacity)]
                    for number, (x, y) in enumerate(zip(edges, edges[1:])):
                        at.append(row)
                        cut.append((number, x - begin, y - x, zlib.crc32(ids[x:y])))
                    begin = end
                where = pa.array(at, pa.int64())
                piece, start, length, crc = zip(*cut)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(where), part.column(1).take(where), pa.array(piece, pa.int32()),
                     pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    ["_rid", "_key", "piece", "start", "length", "ids_crc32"],
                )

    return slim.mapInArrow(run, PIECES)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Fewest bins for ``lengths``, by the best of two families of dual feasible functions.

    One keeps lengths between e and C - e, rounds larger ones up to C and smaller ones down to 0; the
    other rounds (k + 1) x / C down to whole k-ths unless it is whole. Both have sums that no bin can
    exceed. Whole numbers throughout.
    """
    if not len(lengths):
        return 0
    c = capacity
    number = np.bincount(lengths, minlength=c + 1).astype(np.int64)
    size = np.arange(c + 1, dtype=np.int64)
    mass = number * size
    upto, many = np.cumsum(mass), np.cumsum(number)
    best = -(-int(upto[-1]) // c)
    for e in range(1, c // 2 + 1):
        large = int(many[-1] - many[c - e])
        middle = int(upto[c - e] - upto[e - 1])
        best = max(best, large + -(-middle // c))
    for k in range(1, min(c, 100) + 1):
        scaled = size * (k + 1)
        # Times k * C, so that all stays whole.
        value = np.where(scaled % c == 0, size * k, scaled // c * c)
        best = max(best, -(-int((number * value).sum()) // (k * c)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each of ``lengths`` (given in descending order), and the number of bins."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, bins = 0, 0
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, length in enumerate(lengths.tolist()):
        fits = mask >> length
        if fits:
            left = length + (fits & -fits).bit_length() - 1
            chosen = room[left].pop()
            if not room[left]:
                mask ^= 1 << left
        else:
            left, chosen = capacity, bins
            bins += 1
        where[i], offset[i] = chosen, capacity - left
        left -= length
        if left:
            room[left].append(chosen)
            mask |= 1 << left
    return where, offset, bins


def _packer(capacity: int, generation: int):
    def pack(pieces: pd.DataFrame) -> pd.DataFrame:
        pieces = pieces.sort_values(["length", "_rid", "piece"], ascending=[False, True, True]).reset_index(drop=True)
        lengths = pieces["length"].to_numpy()
        where, offset, bins = best_fit_decreasing(lengths, capacity)
        part = int(pieces["part"].iloc[0])
        bound = lower_bound(lengths, capacity)
        load = np.bincount(where, weights=lengths, minlength=bins).astype(np.int64)
        return pieces.assign(
            sequence_id=(generation << 57) | (part << 28) | where, offset=offset, bound=bound, gap=bins - bound, load=load[where]
        )

    return pack


def pack_pieces(pieces: DataFrame, scratch: Scratch, capacity: int, part_size: int) -> DataFrame:
    """``PACKED`` for pieces shorter than ``capacity``."""
    names = [c.split()[0] for c in PACKED.split(", ")]

    def dealt(rows: DataFrame, generation: int, parts: int) -> DataFrame:
        part = F.pmod(F.xxhash64("_rid", "piece", F.lit(generation)), F.lit(parts)).cast("int")
        grouped = rows.withColumn("part", part).groupBy("part")
        done = grouped.applyInPandas(_packer(capacity, generation), PACKED)
        return scratch.save(done.select(*names), f"packed-{generation}")

    columns = [c.split()[0] for c in PIECES.split(", ")]
    parts = max(1, -(-pieces.count() // part_size))
    kept, now, generation = [], dealt(pieces.select(*columns), 0, parts), 0
    while True:
        gaps = now.where("gap > 0")
        again = gaps.where(F.col("load") < capacity)
        count = F.count(F.when(F.col("offset") == 0, 1))
        number, before, origins = again.agg(F.count("*"), count, F.count_distinct("part")).first()
        # One partition has nobody to exchange with. Partitions at least halve, so this ends.
        if origins < 2:
            kept.append(now)
            break
        generation += 1
        fewer = max(1, min(origins // 2, -(-number // part_size)))
        after = dealt(again.select(*columns), generation, fewer)
        if after.where("offset = 0").count() >= before:
            kept.append(now)
            break
        kept.append(now.where((F.col("gap") == 0) | (F.col("load") == capacity)))
        now = after
    out = kept[0]
    for rows in kept[1:]:
        out = out.union(rows)
    return out


def pack_documents(
    docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = 2048,
    part_size: int = 50_000,
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` and ``_rid``, a row per piece.

    ``tokenizer`` is the path of a tokenizer file on the driver. Sequence numbers have no order.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    with open(tokenizer, encoding="utf-8") as file:
        model = file.read()
    rows = numbered(docs, key, scratch, text)
    pieces = scratch.save(tokenized_pieces(rows, key, text, model, capacity), "pieces", conf=BATCH)
    short = pack_pieces(pieces.where(F.col("length") < capacity), scratch, capacity, part_size)
    full = pieces.where(F.col("length") == capacity)
    full = full.withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    out = ["_rid", F.col("_key").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return short.select(*out).union(full.select(*out))
