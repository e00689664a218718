"""Alignment of two tokenizers by external counting of token pairs.

Each text is encoded twice, by a byte-level vocabulary (A) and by a sentencepiece one (B), over the same bytes: a space and the
text. Byte offsets where tokens of both end cut a text into groups, and the A and B tokens of a group are linked. How many
documents hold a pair of ids linked is counted over the whole corpus, and each document learns the counts of its pairs.

The counting is external. A task turns a slice of texts into records (pair, document, times), sorts them side-major (by A id,
then B id, then document), deals them by A id into ``RADIX`` parts, and writes each part as a run of zstandard blocks. Runs go to
the shared folder with one row for each document. The runs of a part make one cell or, if they have more bytes than a cell may
hold, several, by slices of documents; so a pair or an A id that most documents hold is split. In each cell a k-way heap merge
of the runs counts the documents of every pair. Cells add up their counts, and as they are side-major the pairs of an A id are
in one part, whose maximum follows. Then each run streams over the counts of its cell and gives contributions by document.

What is shuffled: the compressed runs, the counts of the distinct pairs of each cell (twice), and a row of three numbers for each
document and part. A run has a slice of texts, a cell has a bounded number of bytes, and a broadcast a row for each A id.

Defined results: texts that are null, empty, or whose tokens of either kind do not give their bytes back have zeros and an
empty digest. Repeated rows are documents of their own, null ids as well. Long texts are taken whole, as a slice of their own;
B reads them in stretches cut at single spaces, which no piece of B goes across. An empty table gives no rows. Other columns
are never looked at.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import in_byte_slices, materialise, new_path, table, worker_cache
from .packing import Encoder

#: Bytes of text that make a run, parts by A id, bytes of the runs of a cell, pairs of a block.
SLICE_BYTES, RADIX, CELL_BYTES, BLOCK = 4 << 20, 16, 16 << 20, 1 << 14
#: Links that are expanded at once, and the links from which a group is taken by its distinct ids.
EXPANDED, MANY_LINKS = 1 << 21, 256
#: Characters that B reads at once, and where a longer text may be cut.
STRETCH, _CUT = 1 << 18, re.compile(r"(?<=[^\s▁]) (?=[^\s▁])")


class Tokenizers:
    """Both encoders, and the bytes of every token of either."""

    def __init__(self, a_path: str | None = None, a_ranks_path: str | None = None, b_path: str | None = None):
        import public_tokenizers
        from sentencepiece import SentencePieceProcessor

        self.a = Encoder(a_path, a_ranks_path)
        self.b = SentencePieceProcessor(model_file=b_path or public_tokenizers.path("piece_bpe_32k.model"))
        # the byte that each character of a byte-level token stands for: its own if it shows in Latin-1, else the next free one
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        letters = {chr(k): k for k in shown} | {chr(256 + n): k for n, k in enumerate(sorted(set(range(256)) - set(shown)))}
        vocabulary = self.a.slow.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, k in vocabulary.items():
            self.a_bytes[k] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        n = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(k) for k in range(n)]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.cuts = not any(re.search("[^▁]▁", p) for p in pieces)
        self.a_sizes, self.b_sizes = (np.array(list(map(len, t)), dtype=np.int64) for t in (self.a_bytes, self.b_bytes))
        na = len(self.a_bytes)
        #: How ids are written in a digest: A inside and at the end of its group, then B.
        self.written = [f"{k},".encode() for k in range(na)] + [f"{k}|".encode() for k in range(na)] + [f"{k},".encode() for k in range(n)] + [f"{k};".encode() for k in range(n)]

    def stretches(self, text: str) -> list[str]:
        if len(text) <= STRETCH or not self.cuts:
            return [text]
        out, lo = [], 0
        while cut := _CUT.search(text, lo + STRETCH):
            out.append(text[lo : cut.start()])
            lo = cut.end()  # B puts the space back
        return [*out, text[lo:]]

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of A and B of each text; None if either does not give the bytes back."""
        cut = [self.stretches(t) for t in texts]
        found = iter(self.b.encode([s for c in cut for s in c], num_threads=1))
        out: list[tuple[np.ndarray, np.ndarray] | None] = []
        for text, parts in zip(texts, cut, strict=True):
            bs = [k for _ in parts for k in next(found)]
            whole = f" {text}".encode("utf-8", "replace")
            if b"".join(map(self.b_bytes.__getitem__, bs)) != whole:
                out.append(None)
                continue
            as_ = self.a(f" {text}")
            same = b"".join(map(self.a_bytes.__getitem__, as_.tolist())) == whole
            out.append((as_.astype(np.int64), np.array(bs, dtype=np.int64)) if same else None)
        return out


class Aligned:
    """The groups and links of some documents, whose ids stand one behind another."""

    def __init__(self, tokens: Tokenizers, encoded: list[tuple[np.ndarray, np.ndarray]]):
        self.n, self.tokens = len(encoded), tokens
        self.sizes = np.array([(len(a), len(b)) for a, b in encoded], dtype=np.int64).reshape(-1, 2)
        self.a, self.b = (np.concatenate([e[k] for e in encoded]) if encoded else np.zeros(0, np.int64) for k in (0, 1))
        ends_a, ends_b = np.cumsum(tokens.a_sizes[self.a]), np.cumsum(tokens.b_sizes[self.b])
        at_a, at_b = (np.zeros(int(ends_a[-1]) + 1 if len(ends_a) else 1, dtype=bool) for _ in "ab")
        at_a[ends_a], at_b[ends_b] = True, True
        self.last_a, self.last_b = at_b[ends_a], at_a[ends_b]
        self.of_a, self.of_b = (np.cumsum(last) - last for last in (self.last_a, self.last_b))
        groups = int(self.last_a.sum())
        self.n_a, self.n_b = (np.bincount(of, minlength=groups) for of in (self.of_a, self.of_b))
        self.doc = np.repeat(np.arange(self.n), self.sizes[:, 0])[self.last_a]  # of each group
        self.groups = np.bincount(self.doc, minlength=self.n)
        self.links = np.zeros(self.n, dtype=np.int64)
        np.add.at(self.links, self.doc, self.n_a * self.n_b)

    def digests(self) -> list[str]:
        """SHA-256 of each document's groups: its A ids, a bar, its B ids, and a semicolon between groups."""
        na, nb = len(self.tokens.a_bytes), len(self.tokens.b_bytes)
        order = np.empty(len(self.a) + len(self.b), dtype=np.int64)
        before_b, upto_a = np.cumsum(self.n_b) - self.n_b, np.cumsum(self.n_a)
        order[np.arange(len(self.a)) + before_b[self.of_a]] = self.a + na * self.last_a
        order[np.arange(len(self.b)) + upto_a[self.of_b]] = 2 * na + self.b + nb * self.last_b
        out, lo = [], 0
        for size in self.sizes.sum(axis=1).tolist():
            shown = itemgetter(*order[lo : lo + size].tolist())(self.tokens.written) if size > 1 else (b"",)
            out.append(hashlib.sha256(b"".join(shown)[:-1]).hexdigest())
            lo += size
        return out

    def _expanded(self, a, of_a, times_a, b, of_b, times_b) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Records of all links of A tokens and B tokens that share a group, some at a time: pair and document in one number,
        and how often. Both sides are in the order of their groups."""
        per_group = np.bincount(of_b, minlength=len(self.doc))
        first, width = np.cumsum(per_group) - per_group, per_group[of_a]
        ends, lo = np.cumsum(width), 0
        while lo < len(a):
            done = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, done + EXPANDED, side="right")))
            w = width[lo:hi]
            within = np.arange(int(w.sum())) - np.repeat(np.cumsum(w) - w, w)
            partner = np.repeat(first[of_a[lo:hi]], w) + within
            pair = np.repeat(a[lo:hi], w) * len(self.tokens.b_bytes) + b[partner]
            times = None if times_a is None else np.repeat(times_a[lo:hi], w) * times_b[partner]
            yield _summed((pair << 32) | np.repeat(self.doc[of_a[lo:hi]], w), times)
            lo = hi

    def records(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (pair << 32 | document), in order, and how many links each one has."""
        many = self.n_a * self.n_b >= MANY_LINKS
        some_a, some_b = ~many[self.of_a], ~many[self.of_b]
        out = list(self._expanded(self.a[some_a], self.of_a[some_a], None, self.b[some_b], self.of_b[some_b], None))
        if many.any():
            sides = []
            for ids, of, some, n in ((self.a, self.of_a, ~some_a, len(self.tokens.a_bytes)), (self.b, self.of_b, ~some_b, len(self.tokens.b_bytes))):
                distinct, times = np.unique(of[some] * n + ids[some], return_counts=True)
                sides += [distinct % n, distinct // n, times]
            out += self._expanded(*sides)
        if len(out) == 1:
            return out[0]
        return _summed(*(np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int64) for k in (0, 1)))


def _summed(codes: np.ndarray, times: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    if times is None:
        return np.unique(codes, return_counts=True)
    order = np.argsort(codes, kind="stable")
    codes, times = codes[order], times[order]
    starts = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1]))) if len(codes) else np.zeros(0, np.int64)
    return codes[starts], np.add.reduceat(times, starts) if len(codes) else times


def _packed(values: np.ndarray) -> bytes:
    """Numbers that are not negative in the smallest width that holds them all, compressed."""
    kind = np.min_scalar_type(int(values.max()) if len(values) else 0)
    return kind.char.encode() + zstandard.ZstdCompressor(level=1).compress(values.astype(kind).tobytes())


def _unpacked(block: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(block[1:]), dtype=np.dtype(block[:1].decode())).astype(np.int64)


_RUN = "part int, base long, n_bytes long, pairs array<binary>, counts array<binary>, docs array<binary>, times array<binary>"


def runs_of(codes: np.ndarray, times: np.ndarray, base: int, nb: int) -> Iterator[dict]:
    """The records as one sorted run for each part: per block the pairs as differences, the number of documents of each, the
    documents and their links."""
    pairs = codes >> 32
    part = ((pairs // nb) % RADIX).astype(np.uint8)
    order = np.argsort(part, kind="stable")
    limits = np.concatenate(([0], np.cumsum(np.bincount(part, minlength=RADIX))))
    for p in np.flatnonzero(np.diff(limits)):
        mine = order[limits[p] : limits[p + 1]]
        own, docs, often = pairs[mine], codes[mine] & 0xFFFFFFFF, times[mine]
        starts = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        keys, ends = own[starts], np.append(starts[1:], len(own))
        run: dict = {"part": int(p), "base": base, "pairs": [], "counts": [], "docs": [], "times": []}
        for lo in range(0, len(keys), BLOCK):
            hi = min(lo + BLOCK, len(keys))
            here = slice(starts[lo], ends[hi - 1])
            run["pairs"].append(_packed(np.diff(keys[lo:hi], prepend=0)))
            run["counts"].append(_packed(ends[lo:hi] - starts[lo:hi]))
            run["docs"].append(_packed(docs[here]))
            run["times"].append(_packed(often[here]))
        run["n_bytes"] = sum(len(b) for c in ("pairs", "counts", "docs", "times") for b in run[c])
        yield run


def heap_merged(runs: list[tuple[list[bytes], list[bytes]]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Merges sorted runs of (pairs, counts) blocks: distinct pairs in order with the sums of their counts. A heap holds the
    open block of each run by its last pair; everything up to the smallest of these is complete."""
    open_: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    at, heap = [0] * len(runs), []

    def advance(r: int) -> None:
        if at[r] < len(runs[r][0]):
            keys = np.cumsum(_unpacked(runs[r][0][at[r]]))
            open_[r] = keys, _unpacked(runs[r][1][at[r]])
            at[r] += 1
            heapq.heappush(heap, (int(keys[-1]), r))

    for r in range(len(runs)):
        advance(r)
    while heap:
        bound, taken, through = heap[0][0], [], []
        for r, (keys, counts) in open_.items():
            hi = int(np.searchsorted(keys, bound, side="right"))
            if hi:
                taken.append((keys[:hi], counts[:hi]))
                open_[r] = keys[hi:], counts[hi:]
        while heap and heap[0][0] == bound:
            through.append(heapq.heappop(heap)[1])
        for r in through:
            del open_[r]
            advance(r)
        yield _summed(np.concatenate([t[0] for t in taken]), np.concatenate([t[1] for t in taken]))


_DOC = "doc_id {id}, row long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def encoded(docs: DataFrame, id_col: str, text_col: str, paths: tuple[str | None, ...]) -> tuple[DataFrame, DataFrame]:
    """Writes one row for each document and the runs of all, in one pass; returns both tables. ``row`` numbers the documents;
    a run's documents are numbered from its base."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    id_type, spark = slim.schema["doc_id"].dataType.simpleString(), docs.sparkSession
    schema = f"kind string, {_DOC.format(id=id_type)}, {_RUN}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = worker_cache("alignment")
        tokens = cache.get(paths) or cache.setdefault(paths, Tokenizers(*paths))
        base, blob = TaskContext.get().partitionId() << 33, pa.list_(pa.binary())
        kinds = {"part": pa.int32(), "base": pa.int64(), "n_bytes": pa.int64(), "pairs": blob, "counts": blob, "docs": blob, "times": blob}
        for batch in in_byte_slices(batches, "text", SLICE_BYTES):
            texts, n = batch.column("text").to_pylist(), batch.num_rows
            some = [k for k, t in enumerate(texts) if t]
            both = tokens.encode([texts[k] for k in some])
            some, both = [k for k, e in zip(some, both, strict=True) if e], [e for e in both if e]
            found = Aligned(tokens, both)
            figures = np.zeros((4, n), dtype=np.int64)
            figures[:, some] = np.stack([found.sizes[:, 0], found.sizes[:, 1], found.groups, found.links])
            digests = [""] * n
            for k, digest in zip(some, found.digests(), strict=True):
                digests[k] = digest
            codes, times = found.records()
            codes = (codes >> 32 << 32) | np.array(some, dtype=np.int64)[codes & 0xFFFFFFFF] if some else codes
            own = [pa.array(["doc"] * n), batch.column("doc_id"), pa.array(base + np.arange(n)), *map(pa.array, figures), pa.array(digests)]
            yield pa.RecordBatch.from_arrays([*own, *(pa.nulls(n, t) for t in kinds.values())], names)
            rows = list(runs_of(codes, times, base, len(tokens.b_bytes)))
            if rows:
                m = len(rows)
                none = [pa.nulls(m, batch.column("doc_id").type), *(pa.nulls(m, pa.int64()) for _ in range(5)), pa.nulls(m, pa.string())]
                yield pa.RecordBatch.from_arrays([pa.array(["run"] * m), *none, *(pa.array([r[c] for r in rows], t) for c, t in kinds.items())], names)
            base += n

    names = [c.split()[0] for c in schema.split(", ")]
    path = new_path(spark, "alignment")
    slim.mapInArrow(run, schema).write.partitionBy("kind").option("compression", "zstd").parquet(path)
    both = spark.read.schema(schema).parquet(path)
    doc_columns, run_columns = ([c.split()[0] for c in s.split(", ")] for s in (_DOC.format(id=id_type), _RUN))
    return both.where("kind = 'doc'").select(*doc_columns), both.where("kind = 'run'").select(*run_columns)


def in_cells(runs: DataFrame, cell_bytes: int) -> DataFrame:
    """Runs with ``cell``: the runs of a part in as many cells as their bytes ask for."""
    sizes = runs.groupBy("part").agg(F.sum("n_bytes").alias("n")).collect()  # a row for each part
    many = {r.part: max(1, -(-r.n // cell_bytes)) for r in sizes} or {0: 1}
    per_part = F.create_map(*[F.lit(x) for p, n in sorted(many.items()) for x in (p, n)])
    return runs.withColumn("cell", F.col("part") + RADIX * F.pmod(F.xxhash64("base"), per_part[F.col("part")]))


def _count(key: tuple, runs: pa.Table) -> pa.Table:
    merged = list(heap_merged(list(zip(runs.column("pairs").to_pylist(), runs.column("counts").to_pylist(), strict=True))))
    pairs, n = (np.concatenate([m[k] for m in merged]) for k in (0, 1))
    return pa.table({"cell": pa.array(np.full(len(pairs), key[0].as_py())), "pair": pa.array(pairs), "n": pa.array(n)})


def _contribute(key: tuple, runs: pa.Table, counted: pa.Table) -> pa.Table:
    """What the pairs of each run give to its documents."""
    pairs, total, best = (counted.column(c).to_numpy() for c in ("pair", "total", "best"))
    order = np.argsort(pairs)
    pairs, total, best = pairs[order], total[order], best[order].astype(np.int64)
    out = []
    for k in range(runs.num_rows):
        run = {c: runs.column(c)[k].as_py() for c in ("base", "pairs", "counts", "docs", "times")}
        sums: np.ndarray | None = None
        for keys, counts, docs, times in zip(run["pairs"], run["counts"], run["docs"], run["times"], strict=True):
            at = np.repeat(np.searchsorted(pairs, np.cumsum(_unpacked(keys))), _unpacked(counts))
            docs, times = _unpacked(docs), _unpacked(times)
            size = max(int(docs.max()) + 1, 0 if sums is None else sums.shape[1])
            grown = np.zeros((2, size), dtype=np.int64)
            if sums is not None:
                grown[:, : sums.shape[1]] = sums
            np.add.at(grown[0], docs, best[at] * times)
            np.add.at(grown[1], docs, total[at] * times)
            sums = grown
        some = np.flatnonzero(sums[1])
        out.append(pa.table({"row": pa.array(run["base"] + some), "n_best": pa.array(sums[0, some]), "count_sum": pa.array(sums[1, some])}))
    kinds = pa.schema([("row", pa.int64()), ("n_best", pa.int64()), ("count_sum", pa.int64())])
    return pa.concat_tables(out) if out else kinds.empty_table()


def pair_counts(runs: DataFrame, nb: int) -> DataFrame:
    """(cell, pair, total, best): of each pair in a cell, how many documents of the corpus hold it, and whether no pair of
    its A id is held by more."""
    counted = materialise(runs.select("cell", "pairs", "counts").groupBy("cell").applyInArrow(_count, "cell long, pair long, n long"), "pair-counts")
    total = counted.withColumn("total", F.sum("n").over(Window.partitionBy("pair"))).withColumn("a", F.floor(F.col("pair") / nb)).drop("n")
    most = total.groupBy("a").agg(F.max("total").alias("most"))
    # a row for each A id
    return total.join(F.broadcast(most), "a").select("cell", "pair", "total", (F.col("total") == F.col("most")).alias("best"))


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str | None = None, a_ranks_path: str | None = None, b_path: str | None = None, cell_bytes: int = CELL_BYTES) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256."""
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor

    nb = SentencePieceProcessor(model_file=b_path or public_tokenizers.path("piece_bpe_32k.model")).get_piece_size()
    rows, runs = encoded(docs, id_col, text_col, (a_path, a_ranks_path, b_path))
    runs = in_cells(runs, cell_bytes).withColumn("cell", F.col("cell").cast("long"))
    counts = pair_counts(runs, nb)
    given = runs.groupBy("cell").cogroup(counts.groupBy("cell")).applyInArrow(_contribute, "row long, n_best long, count_sum long")
    sums = given.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = F.lit(0).cast("long")
    out = rows.hint("merge").join(sums.hint("merge"), "row", "left")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")


def op12_alignment(spark, sf_dir):
    """Links of two tokenizers in all documents."""
    return align(table(spark, sf_dir, "documents"))
