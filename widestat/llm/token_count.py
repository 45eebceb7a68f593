"""Token counts of a unigram tokenizer, without building the tokens.

The tokenizer: spaces become U+2581, one is put before the text unless it
starts with one, and the text is cut before every U+2581; each segment is then
split by the best-scoring path over the vocabulary.  An Aho-Corasick automaton
lists all vocabulary pieces that end at each character, and the dynamic
programme carries only the best score and the piece count.

Tie and fallback rules, as in the tokenizer library (checked against it in the
tests): of paths with equal scores the piece that starts first wins; a
character that is no piece by itself may also be stepped over at the lowest
vocabulary score less 10; such steps count one token per UTF-8 byte if the
vocabulary holds the byte pieces, else one for each run of them.

A null or empty text has no tokens.  Repeated rows are each counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from widestat.llm.common import text_of

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
#: Segment counts kept by a task before it starts afresh (about 100 MB).
CACHE_SEGMENTS = 400_000
#: The largest vocabulary sent to the tasks.
MAX_PIECES = 1_000_000


def load_vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) by id, from a sentencepiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class Counter(dict):
    """Token count by segment, filled on first use."""

    def __init__(self, vocabulary: list[tuple[str, float]], unknown: int = 0):
        import ahocorasick

        super().__init__()
        self.automaton = ahocorasick.Automaton()
        for i, (piece, score) in enumerate(vocabulary):
            if piece:
                self.automaton.add_word(piece, (len(piece), score, i == unknown))
        self.automaton.make_automaton()
        pieces = {p for p, _ in vocabulary}
        self.single = {p for p in pieces if len(p) == 1}
        self.bytes = all(f"<0x{b:02X}>" in pieces for b in range(256))
        self.unknown_score = min(s for _, s in vocabulary) - UNKNOWN_PENALTY
        joined = {c for p in pieces if len(p) > 1 for c in p}
        #: White space inside no longer piece: paths can be cut there.
        self.cuts = [c for c in "\n\t\r" if c not in joined and self.bytes]

    def __missing__(self, segment: str) -> int:
        if len(self) >= CACHE_SEGMENTS:
            self.clear()
        for c in self.cuts:
            if c in segment and segment != c:
                parts = segment.split(c)
                n = self[segment] = sum(self[p] for p in parts if p) + (len(parts) - 1) * self[c]
                return n
        n = self[segment] = self.best_path(segment)
        return n

    def best_path(self, segment: str) -> int:
        n = len(segment)
        ending: list[list] = [[] for _ in range(n + 1)]
        for last, piece in self.automaton.iter(segment):
            ending[last + 1].append(piece)
        score, count, stepped = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        for end in range(1, n + 1):
            best, start, unknown = None, -1, False
            for length, piece_score, is_unknown in ending[end]:
                value = score[end - length] + piece_score
                if best is None or value > best or value == best and end - length < start:
                    best, start, unknown = value, end - length, is_unknown
            ch = segment[end - 1]
            if ch not in self.single:
                value = score[end - 1] + self.unknown_score
                if best is None or value > best:
                    best, start, unknown = value, end - 1, True
            score[end], stepped[end] = best, unknown
            if not unknown:
                count[end] = count[start] + 1
            elif self.bytes:
                count[end] = count[start] + len(segment[start:end].encode())
            else:
                count[end] = count[start] + (not stepped[start])
        return count[n]

    def tokens(self, text: str) -> int:
        if not text:
            return 0
        parts = text.replace(SPACE, " ").split(" ")
        if not parts[0]:  # the text starts with a space: nothing is put before it
            parts = parts[1:]
        return sum(map(self.__getitem__, [SPACE + p for p in parts]))


def count_tokens(docs: DataFrame, vocabulary: list[tuple[str, float]], id_col: str = "doc_id",
                 text_col: str = "text", unknown: int = 0) -> DataFrame:
    """(doc_id, n_chars, n_tokens), one row for each input row."""
    if not 0 < len(vocabulary) <= MAX_PIECES:
        raise ValueError(f"a vocabulary of 1 to {MAX_PIECES} pieces is needed, not {len(vocabulary)}")
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(sent.value, unknown)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array(map(counter.tokens, texts), pa.int64())],
                ["id", "n_chars", "n_tokens"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return (docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("t"))
            .mapInArrow(run, f"id {id_type}, n_chars long, n_tokens long")
            .withColumnRenamed("id", id_col))
