"""Token counts of a unigram tokenizer without its tokens: count-only Viterbi.

An Aho-Corasick automaton enumerates, for every end, the vocabulary pieces that end there, longest
first. A table over the positions carries the best score and its number of pieces, nothing else.
Tie and fallback rules are those of the public unigram tokenizer: of paths with equal scores the one
whose last piece begins first; a character that is no piece of its own may stand alone at
``lowest score - 10``; runs of such characters are spelled in bytes, a token each, if the vocabulary
has all byte pieces, else the run is one unknown token.

No piece of a word vocabulary goes on past a blank, so each blank-to-blank chunk is solved for itself,
once per worker while it is remembered. That needs exact sums, hence whole-number scores; other
vocabularies are run over the whole text. The vocabulary (tens of thousands of pieces, a fixed model)
is read on the driver and sent to the workers.

Defined cases: a null text has null counts, an empty one 0 tokens; text is processed whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLANK = "▁"
UNKNOWN_PENALTY = 10.0
REMEMBERED = 500_000  # chunks per worker; the memory starts anew when it is full
_CHUNKS = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")


def load_pieces(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model file, in the order of their ids."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class Counter:
    """Best score and token count of a text; ``text`` has blanks as ``BLANK`` already."""

    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        names = {p for p, _ in pieces}
        self.bytes_known = all(f"<0x{b:02X}>" in names for b in range(256))
        self.single = {p for p in names if len(p) == 1}
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.apart = not any(re.search(f"[^{BLANK}]{BLANK}", p) for p in names)
        self.apart = self.apart and all(float(s).is_integer() for _, s in pieces)
        # A run of unknown characters that is one token must not reach over the cut.
        self.apart = self.apart and (self.bytes_known or BLANK in self.single)
        self.seen: dict[str, tuple[float, int]] = {}

    def solve(self, text: str) -> tuple[float, int]:
        n, single, unknown = len(text), self.single, self.unknown
        best: list[float] = [0.0] * (n + 1)
        # Tokens up to a position, and whether the path there ends in an unknown run.
        count, open_run = [0] * (n + 1), [False] * (n + 1)
        at = 1

        def alone(end: int, have: float | None) -> None:
            """The last character as an unknown one, if it is no piece and that is better."""
            start = end - 1
            char = text[start]
            score = best[start] + unknown
            if char not in single and (have is None or score > have):
                best[end], open_run[end] = score, True
                width = len(char.encode("utf-8", "surrogatepass")) if self.bytes_known else 0 if open_run[start] else 1
                count[end] = count[start] + width

        have: float | None = None
        for last, (length, piece_score) in self.automaton.iter(text):
            end = last + 1
            while at < end:
                alone(at, have)
                at, have = at + 1, None
            start = end - length
            score = best[start] + piece_score
            if have is None or score > have:
                have = score
                best[end], count[end], open_run[end] = score, count[start] + 1, False
        while at <= n:
            alone(at, have)
            at, have = at + 1, None
        return best[n], count[n]

    def chunk(self, text: str) -> tuple[float, int]:
        found = self.seen.get(text)
        if found is None:
            if len(self.seen) >= REMEMBERED:
                self.seen.clear()
            found = self.seen[text] = self.solve(text)
        return found

    def count(self, text: str) -> tuple[float, int]:
        if not text:
            return 0.0, 0
        spelled = BLANK + text.replace(" ", BLANK)
        if not self.apart:
            return self.solve(spelled)
        score, tokens = 0.0, 0
        for found_score, found_tokens in map(self.chunk, _CHUNKS.findall(spelled)):
            score += found_score
            tokens += found_tokens
        return score, tokens


def count_tokens(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_tokens long, score double`` for every row of ``docs``; ``vocabulary`` is a model file."""
    pieces = docs.sparkSession.sparkContext.broadcast(load_pieces(vocabulary))
    slim = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(pieces.value)
        for batch in batches:
            found = [None if t is None else counter.count(t) for t in batch.column(1).to_pylist()]
            tokens = pa.array([f and f[1] for f in found], pa.int64())
            scores = pa.array([f and f[0] for f in found], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), tokens, scores], ["key", "n_tokens", "score"])

    kind = slim.schema["key"].dataType.simpleString()
    out = slim.mapInArrow(run, f"key {kind}, n_tokens long, score double")
    return out.withColumnRenamed("key", key)
