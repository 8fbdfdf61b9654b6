"""Unigram token counts by dynamic programming over a trie of pre-tokens.

A pre-token is a word with the word-start mark before it. Its best
segmentation into vocabulary pieces maximises the sum of unigram scores; the
forward score of a prefix depends on that prefix alone, so it is computed once
for each node of the trie of the distinct pre-tokens. The trie is walked in
sorted order with the current path as a stack: inserting the next pre-token
keeps the nodes it shares with the one before it. Terminal nodes store their
token count and score, from which documents are summed. A task needs only its
own rows: nothing is shuffled, and memory is one batch's distinct words.

Scores are integers (micro-nats of a Zipf law over the vocabulary's ranks), so
ties are exact: higher score, then fewer tokens, then the longer last piece.
A character that no piece covers costs one byte token for each UTF-8 byte.

Defined cases: null and empty texts have no words and no tokens; repeated rows
are counted one by one; an empty table gives an empty table; other columns are
not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame

from tesserae.llm._common import WORD, schema_of

MARK = "▁"
MEMO_WORDS = 1_000_000


class Unigram:
    """A vocabulary of pieces with integer scores; ``byte_score`` for fallback bytes."""

    def __init__(self, pieces: Iterable[tuple[str, int]]) -> None:
        self.score = {p: -round(1e6 * math.log(rank + 2)) for p, rank in pieces if p}
        self.longest = max(map(len, self.score), default=1)
        self.byte_score = -round(1e6 * math.log(len(self.score) + 1_000))

    @classmethod
    def from_sentencepiece(cls, path: str) -> Unigram:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        return cls((m.id_to_piece(i), i) for i in range(m.vocab_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i)))

    def counts(self, words: Iterable[str]) -> Iterator[tuple[str, int, int]]:
        """``(pre-token, tokens, score)`` of distinct pre-tokens, through their trie."""
        get, longest, byte = self.score.get, self.longest, self.byte_score
        last, path = "", [(0, 0)]  # forward (score, -tokens) of the nodes from the root on
        for word in sorted(words):
            del path[len(commonprefix((last, word))) + 1 :]
            for i in range(len(path), len(word) + 1):
                n = len(word[i - 1].encode("utf-8", "surrogatepass"))
                best = (path[i - 1][0] + n * byte, path[i - 1][1] - n)
                for k in range(i - 1, max(i - longest, 0) - 1, -1):
                    s = get(word[k:i])
                    if s is not None and (k == i - 1 or (path[k][0] + s, path[k][1] - 1) >= best):
                        best = (path[k][0] + s, path[k][1] - 1)
                path.append(best)
            last = word
            yield word, -path[-1][1], path[-1][0]


_MODELS: dict[str, tuple[Unigram, dict]] = {}


def _model(path: str) -> tuple[Unigram, dict]:
    if path not in _MODELS:
        _MODELS[path] = (Unigram.from_sentencepiece(path), {})
    return _MODELS[path]


def token_counts(df: DataFrame, model_path: str | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, ``n_words``, ``n_tokens`` and ``score`` (micro-nats), longs.

    ``model_path``: a sentencepiece file whose pieces and ranks are used, by
    default the public 32k file where each machine has it.
    """
    fields = [(id_col, df.schema[id_col].dataType.simpleString()), ("n_words", "long"), ("n_tokens", "long"), ("score", "long")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tesserae.llm.tokenization import public_path

        model, memo = _model(model_path or public_path("piece_bpe_32k.model"))
        for b in batches:
            texts = [WORD.findall(t) if t else [] for t in b.column(1).to_pylist()]
            new = {MARK + w for t in texts for w in t if w not in memo}
            if len(memo) + len(new) > MEMO_WORDS:
                memo.clear()
                new = {MARK + w for t in texts for w in t}
            for word, n, s in model.counts(new):
                memo[word[1:]] = (n, s)
            found = [[memo[w] for w in t] for t in texts]
            cols = [[len(t) for t in found], [sum(x for x, _ in t) for t in found], [sum(x for _, x in t) for t in found]]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols)], names=[n for n, _ in fields])

    return df.select(id_col, text).mapInArrow(run, schema_of(fields))
