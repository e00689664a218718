"""Token counts under a unigram model, by dynamic programming that a trie of pre-tokens shares.

The vocabulary's pieces have fixed probabilities by their rank, p proportional to 1 / (rank + 1); nothing is trained. A
pre-token is a word with the mark of the space before it. The best segmentation of each prefix depends on the prefix alone, so
the distinct pre-tokens of a batch are taken as a trie: in sorted order, each one starts at the node that it shares with the
one before, and only the new nodes below get a forward score. A terminal keeps the number of pieces of its best path. What a
character outside the vocabulary costs is one piece for each of its UTF-8 bytes.

Nothing is shuffled: each task builds the trie of its own batches, and the table of terminals that it carries from batch to
batch is emptied at a fixed size, which changes no result.

Defined results: null and empty texts have no pre-tokens and no tokens. Repeated rows get a row each. An empty table gives no
rows. Other columns of the input are never looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, worker_cache

SPACE = "▁"
#: Terminals kept between batches.
MAX_TERMINALS = 1_000_000


class UnigramTrie:
    def __init__(self, pieces: list[str]):
        """``pieces``: the vocabulary in order of rank."""
        harmonic = math.log(sum(1 / (k + 1) for k in range(len(pieces))) or 1)
        self.score: dict[str, float] = {}
        for k, piece in enumerate(pieces):
            if piece:
                self.score.setdefault(piece, -math.log(k + 1) - harmonic)
        self.longest = max(map(len, self.score), default=1)
        self.unknown = -math.log(len(pieces) + 1) - harmonic - 10.0
        self.terminals: dict[str, int] = {}

    def add(self, words: set[str]) -> None:
        """Scores the words that have no terminal yet, in the order of a walk through their trie."""
        new = sorted(words - self.terminals.keys())
        if len(self.terminals) + len(new) > MAX_TERMINALS:
            self.terminals.clear()
            new = sorted(words)
        path = SPACE
        best: list[tuple[float, int]] = [(0.0, 0)]
        self._extend(best, path, 1)
        for word in new:
            token = SPACE + word
            shared = len(commonprefix((path, token)))
            del best[shared + 1 :]
            self._extend(best, token, shared + 1)
            path = token
            self.terminals[word] = best[-1][1]

    def _extend(self, best: list[tuple[float, int]], token: str, first: int) -> None:
        """Forward scores of the nodes at depth ``first`` and below: the best last piece, ties to fewer pieces."""
        score, longest, unknown = self.score.get, self.longest, self.unknown
        for end in range(first, len(token) + 1):
            size = len(token[end - 1].encode("utf-8", "replace"))
            before = best[end - 1]
            top, count = before[0] + unknown * size, before[1] + size
            for start in range(max(0, end - longest), end):
                own = score(token[start:end])
                if own is not None:
                    value = best[start][0] + own
                    if value > top or value == top and best[start][1] + 1 < count:
                        top, count = value, best[start][1] + 1
            best.append((top, count))


def vocabulary(path: str | None = None) -> list[str]:
    """The pieces of a sentencepiece model in order of rank, without control, unknown and byte pieces."""
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
    return [model.id_to_piece(k) for k in range(model.get_piece_size()) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k))]


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_pretokens and n_tokens."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, key = worker_cache("token_counts"), model_path
        trie = cache.get(key) or cache.setdefault(key, UnigramTrie(vocabulary(model_path)))
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            split = [t.split() for t in texts]
            for lo in range(0, len(split), 2048):
                trie.add(set().union(*split[lo : lo + 2048]))
                part = split[lo : lo + 2048]
                rows = [(len(t.encode("utf-8", "replace")), len(w), sum(map(trie.terminals.__getitem__, w))) for t, w in zip(texts[lo : lo + 2048], part, strict=True)]
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, len(part)), *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", "n_bytes", "n_pretokens", "n_tokens"])

    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_pretokens long, n_tokens long")


def op3_token_counts(spark, sf_dir):
    """Bytes, pre-tokens and tokens of every document."""
    return count_tokens(table(spark, sf_dir, "documents"))
