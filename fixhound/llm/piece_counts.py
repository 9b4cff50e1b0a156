"""Token counts of a unigram tokenizer without its tokens: Viterbi over vocabulary matches.

An Aho-Corasick automaton finds every vocabulary piece that ends at each character; the best score
and the number of pieces are carried from end to end. Ties go as in the tokenizer: of equal scores
the piece that begins earlier wins, and a lone unknown character comes last. A character without a
piece of its own costs the lowest score of the vocabulary less 10 and counts as its UTF-8 bytes
where the vocabulary has byte pieces, else a run of such characters counts as one piece.

The one public file with scored pieces, the default here, is a BPE model: its scores are ranks of
merges, read as if they were log probabilities. Counts are thus those of the unigram cut of its
vocabulary, which the tests compare with a library's unigram model; that model's own BPE encoding
has other counts. Any unigram file can be given instead.

No piece goes on past a space, so a text is handled in parts that begin at spaces, and each
distinct part is computed once while it is remembered.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .pieces import PieceMemory
from .texts import slices, utf8

_MARK = "▁"
_UNKNOWN_PENALTY = 10.0


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Unigram:
    """Pieces with scores, matched against texts in which a space is written as the mark."""

    def __init__(self, pieces: dict[str, float], lowest: float, byte_fallback: bool):
        if any(_MARK in piece.lstrip(_MARK) for piece in pieces):
            raise ValueError("a piece goes on past a space")
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown, self.byte_fallback = lowest - _UNKNOWN_PENALTY, byte_fallback
        self.memory = PieceMemory(self._parts, np.float64)

    @classmethod
    def from_file(cls, path: str) -> Unigram:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        every = range(model.vocab_size())
        plain = {model.id_to_piece(i): model.get_score(i) for i in every if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))}
        return cls(plain, min(model.get_score(i) for i in every), any(model.is_byte(i) for i in every))

    def best(self, text: str) -> tuple[float, int]:
        """Score of the best cut of an escaped text and its number of pieces."""
        n = len(text)
        score, count, unknown, done = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1), 0
        found: list[tuple[int, float]] = []

        def close(end: int) -> None:
            """Settle end `end` with the matches found for it, longest first."""
            top, at, single = None, 0, False
            for size, piece in found:
                value = score[end - size] + piece
                if top is None or value > top:
                    top, at = value, size
                single |= size == 1
            if not single and ((value := score[end - 1] + self.unknown) > top if top is not None else True):
                score[end], unknown[end] = score[end - 1] + self.unknown, True
                more = len(text[end - 1].encode()) if self.byte_fallback else not unknown[end - 1]
                count[end] = count[end - 1] + more
            else:
                score[end], count[end] = top, count[end - at] + 1

        for end, match in self.automaton.iter(text):
            while done < end:
                done += 1
                close(done)
                found.clear()
            found.append(match)
        while done < n:
            done += 1
            close(done)
            found.clear()
        return score[n], count[n]

    def _parts(self, data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = data.tobytes()
        made = [self.best(raw[a:b].decode().replace(" ", _MARK)) for a, b in zip(begins.tolist(), ends.tolist())]
        return np.array(made, np.float64).ravel(), np.full(len(made), 2)

    def counts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Number of pieces and score of each text; a space is put before every text that isn't empty."""
        data, offsets = utf8(texts)
        mark = _MARK.encode()
        if mark in (raw := data.tobytes()):
            each = [raw[a:b].replace(mark, b" ") for a, b in zip(offsets.tolist(), offsets[1:].tolist())]
            data, offsets = np.frombuffer(b"".join(each), np.uint8), np.concatenate([[0], np.cumsum([len(e) for e in each])])
        filled = offsets[:-1] < offsets[1:]
        data = np.insert(data, offsets[:-1][filled], 0x20)
        offsets = offsets + np.concatenate([[0], np.cumsum(filled)])
        space = data == 0x20
        begin = space.copy()
        begin[1:] &= ~space[:-1]
        begin[offsets[:-1][filled]] = True
        begins = np.flatnonzero(begin)
        values, _ = self.memory.values(data, begins)
        sums = np.concatenate([np.zeros((1, 2)), np.cumsum(values.reshape(-1, 2), axis=0)])
        if not self.memory_is_exact(sums):
            bounds = np.searchsorted(begins, offsets)
            total = np.array([values.reshape(-1, 2)[a:b].sum(axis=0) for a, b in zip(bounds, bounds[1:])]).reshape(-1, 2)
        else:
            total = np.diff(sums[np.searchsorted(begins, offsets)], axis=0)
        return total[:, 1].astype(np.int64), total[:, 0]

    @staticmethod
    def memory_is_exact(sums: np.ndarray) -> bool:
        """Whether running sums are whole numbers that a double holds exactly."""
        last = np.abs(sums).max(initial=0)
        return bool(last < 2**53 and (sums == np.rint(sums)).all())


_models: dict[str, Unigram] = {}


def unigram(path: str) -> Unigram:
    if path not in _models:
        _models[path] = Unigram.from_file(path)
    return _models[path]


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """`doc_id`, `n_tokens` and `score` (of the best cut) for every whole text.

    Null and empty texts have no tokens and score 0. Repeated rows each give a row. Other columns
    of `docs` aren't read.
    """
    path = path or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = unigram(path)
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                count, score = model.counts(part.column("text"))
                yield pa.record_batch([part.column("doc_id"), pa.array(count), pa.array(score)], ["doc_id", "n_tokens", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_tokens bigint, score double")
