"""Online packing of token sequences by the sum of squares: each piece goes to the fill level that makes the sum of squared
counts of partly filled windows smallest, with the counts kept in an array by level.

A document is its token ids and a closing id. What is longer than a window is cut into full windows and a rest, and the rest
is the piece to place. When a task has read its documents, it closes: the pieces of its emptiest open windows are cut to fill
the others, so that at most one window of each task is left with padding. A task packs the documents of its own partition,
so nothing is shuffled and a lost task is repeated with the same result.

Defined results: a null text is an empty one; an empty document is the closing id alone. Repeated rows are packed once each.
An empty table gives no rows. Other columns of the input are never looked at.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_slices, table, worker_cache

WINDOW = 1024
END_ID = 0

#: Outside these, or where the fast encoder gives up, the text goes to the other library, whose ids count.
_UNUSUAL = re.compile("[^\t\n -~¡-ȳͰ-ϿЀ-ӿ‐-‧€]| {200}|\\s{300}")


class Encoder:
    """Ids of a byte-level BPE vocabulary. ``tokenizers`` defines them; for usual characters ``tiktoken`` gives the same
    ids from the same vocabulary several times faster."""

    def __init__(self, path: str | None = None, ranks_path: str | None = None):
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path or public_tokenizers.path("byte_bpe_50k.json"))
        self.slow.encode_special_tokens = True
        with open(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("corpus", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if not _UNUSUAL.search(text):
            try:
                return self.fast.encode_to_numpy(text, disallowed_special=())
            except (ValueError, UnicodeError):
                pass
        return np.array(self.slow.encode(text.encode("utf-8", "replace").decode(), add_special_tokens=False).ids, dtype=np.uint32)


class SumOfSquares:
    """Open windows by fill level; ``count[h]`` windows hold h tokens. A piece is (document, start, length)."""

    def __init__(self, size: int = WINDOW):
        self.size = size
        self.count = np.zeros(size + 1, dtype=np.int64)
        self.open: dict[int, list[list]] = {}
        self.levels = np.arange(size + 1)

    def place(self, piece: tuple[int, int, int]) -> list | None:
        """Puts a piece where the sum of squares becomes smallest; returns the window if that fills it.

        Moving a window from level h to h + s changes the sum by 2 (count[h+s] - count[h]) + 2; a new window, by
        2 count[s] + 1; one that becomes full, by 1 - 2 count[h]. Ties go to the fuller window.
        """
        s = piece[2]
        gain = np.full(self.size - s + 1, np.inf)
        gain[0] = 2 * self.count[s] + 1 if s < self.size else 0
        h = self.levels[1 : self.size - s + 1]
        if len(h):
            more = 2.0 * (self.count[h + s] - self.count[h]) + 2
            more[-1] = 1 - 2.0 * self.count[h[-1]]  # to the full level, which counts no more
            gain[1:] = np.where(self.count[h] > 0, more, np.inf)
        best = len(gain) - 1 - int(np.argmin(gain[::-1]))
        window = self.take(best) if best else []
        window.append(piece)
        if best + s == self.size:
            return window
        self.count[best + s] += 1
        self.open.setdefault(best + s, []).append(window)
        return None

    def take(self, level: int) -> list:
        self.count[level] -= 1
        return self.open[level].pop()

    def close(self) -> Iterator[list]:
        """All open windows; the pieces of the emptiest are cut to fill the fullest."""
        left = sorted((w for of in self.open.values() for w in of), key=lambda w: sum(p[2] for p in w))
        stock: list[tuple[int, int, int]] = []
        lo, hi = 0, len(left) - 1
        while lo <= hi:
            window = left[hi]
            hi -= 1
            room = self.size - sum(p[2] for p in window)
            while room and (stock or lo <= hi):
                if not stock:
                    stock = left[lo]
                    lo += 1
                doc, start, length = stock.pop()
                cut = min(room, length)
                window.append((doc, start + length - cut, cut))
                if cut < length:
                    stock.append((doc, start, length - cut))
                room -= cut
            yield window
        if stock:
            yield stock


_SCHEMA = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, tokenizer_path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """One row per piece: its document, start and length in the document's ids, the CRC-32 of its ids, the document's
    number of ids, and the sequence and offset where it stands. ``tokenizer_path`` and ``ranks_path`` name one vocabulary.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        cache, key = worker_cache("packing"), (tokenizer_path, ranks_path)
        encode = cache.get(key) or cache.setdefault(key, Encoder(tokenizer_path, ranks_path))
        packer = SumOfSquares(window)
        next_id = TaskContext.get().partitionId() << 40
        names: list = []
        tokens: list[int] = []
        sums: dict[tuple[int, int, int], int] = {}
        rests: dict[int, bytes] = {}
        done: list[tuple[int, list]] = []
        kind = None

        def flush() -> pa.RecordBatch:
            rows: list[tuple] = []
            for sequence, pieces in done:
                at = 0
                for piece in pieces:
                    doc, start, length = piece
                    crc = sums.pop(piece, None)
                    if crc is None:
                        rest = rests[doc]
                        first = start - (tokens[doc] - len(rest) // 4)
                        crc = zlib.crc32(rest[4 * first : 4 * (first + length)])
                    rows.append((names[doc], start, length, crc, tokens[doc], sequence, at))
                    at += length
            done.clear()
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1:])], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for batch in in_slices(batches):
            kind = batch.schema.field("doc_id").type
            for name, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = np.append(encode(text or ""), np.uint32(END_ID)).astype("<u4").tobytes()
                doc, n = len(names), len(ids) // 4
                names.append(name)
                tokens.append(n)
                full = n - n % window
                for start in range(0, full, window):
                    piece = (doc, start, window)
                    sums[piece] = zlib.crc32(ids[4 * start : 4 * (start + window)])
                    done.append((next_id, [piece]))
                    next_id += 1
                if n > full:
                    rests[doc] = ids[4 * full :]
                    piece = (doc, full, n - full)
                    ready = packer.place(piece)
                    if ready is not None:
                        done.append((next_id, ready))
                        next_id += 1
                if len(done) >= 4096:
                    finished = [p[0] for _, pieces in done for p in pieces if p[2] < window]
                    yield flush()
                    for d in finished:
                        rests.pop(d, None)
        if kind is None:
            return
        for ready in packer.close():
            done.append((next_id, ready))
            next_id += 1
        yield flush()

    return slim.mapInArrow(run, _SCHEMA.format(id=slim.schema["doc_id"].dataType.simpleString()))


def op10_packing(spark, sf_dir):
    """All documents into sequences of 1024 tokens."""
    return pack(table(spark, sf_dir, "documents"))
