"""Token counts by a linear longest-match automaton.

A trie of the vocabulary carries failure links and, at each link, how many pieces greedy longest-match-first would
have popped on the way.  One pass over a word's characters then gives its number of pieces without building them.
Song, Salcianu, Song, Dopson and Zhou: Fast WordPiece Tokenization (2021).
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import common

#: Distinct words whose counts a worker remembers before it starts afresh.
MEMORY = 500_000
_UNKNOWN = 1 << 40
_NONE = -1


class Automaton:
    """``first`` are the pieces that may begin a word, ``later`` those that may follow another piece."""

    def __init__(self, first: Iterable[str], later: Iterable[str]):
        self.next: list[dict[str, int]] = [{}, {}]  # roots: 0 of first pieces, 1 of later ones
        ends = [False, False]
        for root, pieces in enumerate((first, later)):
            for piece in pieces:
                node = root
                for c in piece:
                    if c not in self.next[node]:
                        self.next[node][c] = len(self.next)
                        self.next.append({})
                        ends.append(False)
                    node = self.next[node][c]
                if node > 1:
                    ends[node] = True
        self.fail, self.popped = [_NONE] * len(self.next), [0] * len(self.next)
        queue = deque([0, 1])
        while queue:
            node = queue.popleft()
            for c, child in self.next[node].items():
                if ends[child]:
                    self.fail[child], self.popped[child] = 1, 1
                else:
                    link, popped = self.fail[node], self.popped[node]
                    while link != _NONE and c not in self.next[link]:
                        popped += self.popped[link]
                        link = self.fail[link]
                    if link != _NONE:
                        self.fail[child], self.popped[child] = self.next[link][c], popped
                queue.append(child)

    def count(self, word: str) -> int:
        """Number of pieces of ``word``; 0 if it is empty, -1 if longest match gets stuck."""
        node, count = 0, 0
        for c in word:
            while c not in self.next[node]:
                count += self.popped[node]
                node = self.fail[node]
                if node == _NONE:
                    return -1
            node = self.next[node][c]
        while node > 1:
            count += self.popped[node]
            node = self.fail[node]
            if node == _NONE:
                return -1
        return count if node == 1 or not word else -1


@lru_cache(maxsize=4)
def automaton(model_file: str, mark: str = "▁") -> Automaton:
    """From a sentencepiece model: pieces that begin with ``mark`` begin a word, all others (byte and control pieces aside) follow."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    plain = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return Automaton((p for p in plain if p.startswith(mark)), (p for p in plain if not p.startswith(mark)))


def count_tokens(docs: DataFrame, model_file: str, mark: str = "▁") -> DataFrame:
    """Per row: ``doc_id, n_words, n_tokens, n_unknown``.

    Words are separated by ASCII white space; each is matched as ``mark`` + word, greedily by longest piece.  A word on
    which that gets stuck counts as one unknown token.  A null text has no words; repeated rows are counted each; an
    empty table gives no rows; other columns are ignored.  One narrow pass.
    """
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(n, T.LongType()) for n in ("n_words", "n_tokens", "n_unknown"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = automaton(model_file, mark)
        memory: dict[bytes, int] = {}
        for batch in batches:
            rows = np.zeros((3, batch.num_rows), np.int64)
            for i, text in enumerate(batch.column(1).to_pylist()):
                words = (text or b"").split()
                new = set(words).difference(memory)
                if len(memory) + len(new) > MEMORY:
                    memory.clear()
                    new = set(words)
                for word in new:
                    n = own.count(mark + word.decode("utf-8", "replace"))
                    memory[word] = n if n >= 0 else _UNKNOWN + 1
                total = sum(map(memory.__getitem__, words))
                rows[:, i] = len(words), total % _UNKNOWN, total // _UNKNOWN
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, rows)], names=schema.names)

    return common.map_arrow(docs.select("doc_id", common.text_bytes()), run, schema)


def _query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(common.table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {"op5_linear_wordpiece": _query}
ORACLE_SQL: dict[str, str] = {}
