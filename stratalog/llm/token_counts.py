"""Token counts of a unigram model, by dynamic programming over a trie of pre-tokens.

Pre-tokens are runs of characters other than ASCII white space, with the word mark before them. Each distinct pre-token of
a worker's rows is inserted in a trie; the best score and token count of a node (the forward pass of the Viterbi search)
need only the nodes above it, so they are computed once for all pre-tokens that share the prefix. The count at a
pre-token's last node is its number of tokens. Pre-tokens of LONG characters or more, as in runs without white space, are
walked with a window as long as the longest piece, whatever their length.

Scores: the vocabularies at hand hold merges in order of rank and no probabilities, and tokenizers aren't trained here, so
pieces follow Zipf's law, the piece of rank r with a probability in proportion to 1 / (r + 2).
"""

from __future__ import annotations

import math
import os

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Nodes of the trie, and bytes of cached pre-tokens, that a worker holds before it starts anew; characters from which on a
#: pre-token is walked by itself, outside the trie. Results don't depend on them.
MOST_NODES, MOST_BYTES, LONG = 600_000, 32 << 20, 256


def load_scores(path: str = VOCABULARY) -> dict[str, float]:
    """Pieces of a sentencepiece vocabulary with log-probabilities; merges have ranks only, so a piece of rank r has -ln(r + 2)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return {model.id_to_piece(i): -math.log(r + 2.0) for r, i in enumerate(plain)}


class TrieCounter:
    """Counts of pre-tokens; ``visits`` counts the forward steps taken."""

    def __init__(self, scores: dict[str, float]):
        self.unknown = min(scores.values(), default=0.0) - 10.0
        # Every ending of a piece, with the piece's score where it is one: where no piece ends so, no longer one does.
        self.endings: dict[str, float | None] = {}
        for piece in scores:
            for size in range(1, len(piece)):
                self.endings.setdefault(piece[-size:], None)
        self.endings.update(scores)
        self.back, self.visits = max(map(len, scores), default=1), 0
        self.clear()

    def clear(self) -> None:
        self.children, self.best, self.tokens = {}, [0.0], [0]

    def count(self, word: str) -> int:
        """Tokens on the best path; of equal scores the path with the shorter last piece. An unknown character takes as many tokens as it has UTF-8 bytes."""
        text = MARK + word
        if len(text) >= LONG:
            return self._walk(text)
        if len(self.best) > MOST_NODES:
            self.clear()
        node, path = 0, [0]
        children, best, tokens, endings = self.children, self.best, self.tokens, self.endings
        for i, char in enumerate(text):
            key = node * 0x110000 + ord(char)
            at = children.get(key)
            if at is None:
                self.visits += 1
                score, n = -math.inf, 0
                for start in range(i, -1, -1):
                    s = endings.get(text[start : i + 1], 1.0)
                    if s is not None:
                        if s > 0:  # no piece ends so; scores are negative
                            break
                        before = path[start]
                        if best[before] + s > score:
                            score, n = best[before] + s, tokens[before] + 1
                if score == -math.inf:
                    size = len(char.encode("utf-8", "surrogatepass"))
                    score, n = best[path[i]] + self.unknown * size, tokens[path[i]] + size
                at = children[key] = len(best)
                best.append(score)
                tokens.append(n)
            path.append(at)
            node = at
        return tokens[node]


    def _walk(self, text: str) -> int:
        """The same forward pass, holding only as many steps as the longest piece reaches back."""
        back, endings, best, tokens = self.back, self.endings, [0.0], [0]
        for i, char in enumerate(text):
            score, n = -math.inf, 0
            for size in range(1, i + 2):
                s = endings.get(text[i + 1 - size : i + 1], 1.0)
                if s is not None:
                    if s > 0:
                        break
                    if best[-size] + s > score:
                        score, n = best[-size] + s, tokens[-size] + 1
            if score == -math.inf:
                size = len(char.encode("utf-8", "surrogatepass"))
                score, n = best[-1] + self.unknown * size, tokens[-1] + size
            best.append(score)
            tokens.append(n)
            if len(best) > 4 * back + 1024:
                del best[: -back - 1], tokens[: -back - 1]
        return tokens[-1]


class _Counts(dict):
    def __init__(self, trie: TrieCounter):
        self.trie, self.size = trie, 0

    def __missing__(self, word: bytes) -> int:
        n = self.trie.count(word.decode("utf-8", "replace"))
        if len(word) < LONG:
            self.size += len(word) + 64
            if self.size > MOST_BYTES:
                self.clear()
                self.size = 0
            self[word] = n
        return n


def _count(shared, names: list[str]):
    def run(batches):
        counts = _Counts(TrieCounter(shared.value))
        for batch in batches:
            words, tokens = [], []
            for text in batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist():
                parts = (text or b"").split()
                words.append(len(parts))
                tokens.append(sum(map(counts.__getitem__, parts)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names)

    return run


def count_tokens(docs: DataFrame, path: str = VOCABULARY, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """The columns ``keep`` (all by default) of each row of ``docs``, and n_words and n_tokens of its whole text.

    The vocabulary at ``path`` is read on the driver and travels with the tasks (its size is the file's). A null or
    empty text has no tokens. Very long texts, and runs without white space, are counted whole. Of equal scores the
    shorter last piece counts. Rows that repeat come back as often; an empty table gives an empty one. Result columns
    replace columns with their names. Nothing is shuffled: a worker's trie and cache are bounded, by nodes and by bytes,
    and begin anew when full.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    if not os.path.exists(path):
        raise FileNotFoundError(f"no vocabulary at {path}")
    kept = [c for c in (docs.columns if keep is None else keep) if c not in ("n_words", "n_tokens")]
    rows = docs.select(*[F.col(c) for c in kept], F.col(text_col).cast("string").alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "__text"), "n_words bigint", "n_tokens bigint"])
    return rows.mapInArrow(_count(spark.sparkContext.broadcast(load_scores(path)), [*kept, "n_words", "n_tokens"]), schema)
