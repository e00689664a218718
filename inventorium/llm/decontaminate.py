"""Benchmark decontamination: a broadcast set of normalised n-grams, token windows that are looked up in it and verified,
and the removal of the spans or documents that they hit.

Words: A-Z are lower-cased; a word is a run of ASCII letters and digits or of anything beyond ASCII. A window is ``n``
consecutive words of a benchmark item; an item with fewer words, but not none, is one window.

Defined results: a null or empty text has no words and no hits. Repeated rows get a result each. Items with a null text or
no word have no window. Items that repeat an id are one item; a null id counts as an id and is written as an empty string.
An empty benchmark hits nothing. Other columns of the inputs are never looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, in_slices, materialise, sized, table, worker_cache

#: Bytes of an index that tasks hold at once. A larger benchmark is taken in slices, one job after another.
MAX_INDEX_BYTES = 128 << 20
#: Bytes of an index for a byte of text, at most: a word of four bytes and its space with an entry of the vocabulary, a number
#: and a window of its own.
_INDEX_PER_TEXT = 32

#: Keys of contaminated texts that are broadcast; more are joined by a shuffle.
MOST_KEYS = 1_000_000

_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_SPANS = "array<struct<first:long,last:long>>"


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_WORD_BYTES).split()


class NgramIndex:
    """The windows of all items in arrays: for each length of window the sorted sums of the windows, where each starts in the
    items' word numbers, and whose it is."""

    def __init__(self, items: list[tuple[str, str | None]], n: int):
        self.vocabulary: dict[bytes, int] = {}
        self.names = sorted({item for item, _ in items})
        number = {name: k for k, name in enumerate(self.names)}
        flat: list[np.ndarray] = []
        by_size: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        at = 0
        for item, text in items:
            own = words(text)
            flat.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in own], dtype=np.int32))
            if own:
                size = min(n, len(own))
                starts = np.arange(at, at + len(own) - size + 1)
                by_size.setdefault(size, []).append((starts, np.full(len(starts), number[item], dtype=np.int32)))
            at += len(own)
        self.flat = np.concatenate(flat) if flat else np.zeros(0, dtype=np.int32)
        self.windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for size, parts in by_size.items():
            starts, whose = (np.concatenate(c) for c in zip(*parts, strict=True))
            sums = np.concatenate([_sums(np.lib.stride_tricks.sliding_window_view(self.flat, size)[starts[k : k + (1 << 16)]]) for k in range(0, len(starts), 1 << 16)])
            order = np.argsort(sums, kind="stable")
            self.windows[size] = sums[order], starts[order], whose[order]

    @property
    def nbytes(self) -> int:
        """What the arrays and the vocabulary take, about."""
        return self.flat.nbytes + sum(a.nbytes for of in self.windows.values() for a in of) + sum(len(w) + 130 for w in self.vocabulary)

    def hits(self, numbers: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """Start, size and items (numbers in ``names``) of every window that occurs in a sequence of word numbers, where 0 is
        any other word."""
        known = np.concatenate(([0], np.cumsum(numbers > 0)))
        for size, (own, starts_of, whose) in self.windows.items():
            starts = np.flatnonzero(known[size:] - known[:-size] == size)
            for lo in range(0, len(starts), 1 << 16):
                part = starts[lo : lo + (1 << 16)]
                views = np.lib.stride_tricks.sliding_window_view(numbers, size)[part]
                sums = _sums(views)
                first = np.searchsorted(own, sums)
                for k in np.flatnonzero(own[np.minimum(first, len(own) - 1)] == sums):
                    end = np.searchsorted(own, sums[k], side="right")
                    there = self.flat[starts_of[first[k] : end][:, None] + np.arange(size)]
                    same = (there == views[k]).all(axis=1)
                    if same.any():
                        yield int(part[k]), size, whose[first[k] : end][same]


def _sums(rows: np.ndarray) -> np.ndarray:
    """A 64-bit sum of each row; equal rows have equal sums."""
    out = np.zeros(len(rows), dtype=np.uint64)
    for j in range(rows.shape[1]):
        out = out * np.uint64(0x9E3779B97F4A7C15) + rows[:, j].astype(np.uint64)
        out ^= out >> np.uint64(29)
    return out


def _scan(index: NgramIndex, texts: list[str | None]) -> Iterator[tuple[int, list[dict], list[str]]]:
    """Of each text: its number of words, the word spans hit (merged, last one included) and the items found."""
    numbers, bounds = [], [0]
    for text in texts:
        own = words(text)
        numbers.append(np.fromiter(map(index.vocabulary.get, own, repeat(0)), dtype=np.int32, count=len(own)))
        numbers.append(np.zeros(1, dtype=np.int32))  # no window reaches over the end of a text
        bounds.append(bounds[-1] + len(own) + 1)
    every = np.concatenate(numbers) if numbers else np.zeros(0, dtype=np.int32)
    spans: dict[int, list[tuple[int, int]]] = {}
    items: dict[int, set[int]] = {}
    starts = np.array(bounds[:-1])
    for at, size, found in index.hits(every):
        k = int(np.searchsorted(starts, at, side="right")) - 1
        spans.setdefault(k, []).append((at - bounds[k], at - bounds[k] + size - 1))
        items.setdefault(k, set()).update(found.tolist())
    for k in range(len(texts)):
        yield bounds[k + 1] - bounds[k] - 1, _merged(spans.get(k, [])), [index.names[i] for i in sorted(items.get(k, ()))]


def _merged(spans: list[tuple[int, int]]) -> list[dict]:
    out: list[dict] = []
    for first, last in sorted(spans):
        if out and first <= out[-1]["last"] + 1:
            out[-1]["last"] = max(out[-1]["last"], last)
        else:
            out.append({"first": first, "last": last})
    return out


def _without(text: str, spans: list[dict]) -> str:
    """The text without the words of the spans and what stands between them."""
    raw = text.encode("utf-8", "replace")
    marked = raw.translate(_WORD_BYTES)
    ends, at = [], 0
    for word in marked.split():
        at = marked.index(word, at)
        ends.append((at, at + len(word)))
        at += len(word)
    out, at = [], 0
    for span in spans:
        out.append(raw[at : ends[span["first"]][0]])
        at = ends[span["last"]][1]
    return b"".join([*out, raw[at:]]).decode("utf-8", "replace")


def _slices(benchmark: DataFrame, id_col: str, text_col: str, max_index_bytes: int) -> list[DataFrame]:
    """The items (item, text) in as many parts as keep the index of each within the bound."""
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).cast("string").alias("text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + F.octet_length("item") + 16
    total = items.agg(F.coalesce(F.sum(size), F.lit(0)).alias("b")).first().b
    parts = max(1, -(-total * _INDEX_PER_TEXT // max_index_bytes))
    return [items if parts == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == k) for k in range(parts)]


_HITS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


def _scanned(docs: DataFrame, items: DataFrame, n: int, all_rows: bool):
    """(scan of ``docs`` (doc_id, text), its broadcast): doc_id, text_key, n_words, spans, items; only rows with hits unless
    ``all_rows``."""
    index = docs.sparkSession.sparkContext.broadcast(NgramIndex([(r.item, r.text) for r in items.collect()], n))  # bounded by the slices
    slim = docs.select("doc_id", F.struct(F.xxhash64("text").alias("a"), F.hash("text").alias("b")).alias("text_key"), "text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("decontaminate")
        for batch in in_slices(batches):
            rows = list(_scan(index.value, batch.column("text").to_pylist()))
            found = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], _HITS), pa.array([r[2] for r in rows], pa.list_(pa.string()))]
            out = pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), *found], ["doc_id", "text_key", "n_words", "spans", "items"])
            yield out if all_rows else out.filter(pa.array([bool(r[1]) for r in rows], pa.bool_()))

    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(scan, f"doc_id {kind}, text_key struct<a:long,b:int>, n_words long, spans {_SPANS}, items array<string>"), index


def _united(parts: list[DataFrame]) -> DataFrame:
    """(key, s, i): the merged spans and the items of each text with hits, from the slices' findings."""
    every = parts[0]
    for other in parts[1:]:
        every = every.unionByName(other)
    grouped = every.where(F.size("spans") > 0).groupBy("text_key").agg(F.array_sort(F.flatten(F.collect_set("spans"))).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("i"))
    last = lambda acc: F.element_at(acc, -1)
    longer = lambda acc, x: F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last(acc)["first"].alias("first"), F.greatest(last(acc)["last"], x["last"]).alias("last"))))
    merged = F.aggregate("s", F.array().cast(_SPANS), lambda acc, x: F.when((F.size(acc) > 0) & (x["first"] <= last(acc)["last"] + 1), longer(acc, x)).otherwise(F.concat(acc, F.array(x))))
    return grouped.select(F.col("text_key").alias("key"), merged.alias("s"), "i")


def find_hits(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", max_index_bytes: int = MAX_INDEX_BYTES) -> DataFrame:
    """One row per document: its id, n_words, the hit word spans and the items whose windows occur.

    No shuffle: each task looks its documents up in the broadcast windows. A benchmark whose index would be over
    ``max_index_bytes`` is taken in slices: each is broadcast, scanned for and dropped before the next, only documents with hits
    are kept of the later ones, and the findings are united by text."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    slices = _slices(benchmark, item_col, item_text_col, max_index_bytes)
    if len(slices) == 1:
        return _scanned(slim, slices[0], n, True)[0].drop("text_key")
    found = _scan_in_turn(slim, slices, n, True)
    both = found[0].select("doc_id", "text_key", "n_words").hint("merge").join(_united(found).hint("merge"), F.col("text_key") == F.col("key"), "left")
    return both.select("doc_id", "n_words", F.coalesce("s", F.array().cast(_SPANS)).alias("spans"), F.coalesce("i", F.array().cast("array<string>")).alias("items"))


def _scan_in_turn(docs: DataFrame, slices: list[DataFrame], n: int, all_rows: bool) -> list[DataFrame]:
    out = []
    for k, part in enumerate(slices):
        scan, index = _scanned(docs, part, n, all_rows and k == 0)
        out.append(materialise(scan, "benchmark-hits"))
        index.unpersist()
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, **columns) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and the hit word spans."""
    hits = find_hits(docs, benchmark, n, **columns)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["last"] - x["first"] + 1)
    return hits.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), "spans")


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, remove: str = "documents", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", max_index_bytes: int = MAX_INDEX_BYTES) -> DataFrame:
    """``docs`` with all its columns, without contaminated documents (remove="documents") or hit words (remove="spans")."""
    if remove not in ("documents", "spans"):
        raise ValueError("remove must be 'documents' or 'spans'")
    text = F.col(f"`{text_col}`").cast("string")
    slices = _slices(benchmark, item_col, item_text_col, max_index_bytes)
    spans_col, key_col = free_name(docs, "__hit_spans"), free_name(docs, "__text_key")
    if len(slices) > 1:
        found = _united(_scan_in_turn(docs.select(F.lit(0).alias("doc_id"), text.alias("text")), slices, n, False))
        found = materialise(found.select(F.col("key").alias(key_col), F.col("s").alias(spans_col)), "benchmark-spans")
        keyed = F.struct(F.xxhash64(text).alias("a"), F.hash(text).alias("b")) == F.col(key_col)
        if remove == "documents":
            return docs.join(sized(found.select(key_col), MOST_KEYS), keyed, "left_anti")
        marked = docs.hint("merge").join(found.hint("merge"), keyed, "left").drop(key_col)
    else:
        marked = docs
        index = docs.sparkSession.sparkContext.broadcast(NgramIndex([(r.item, r.text) for r in slices[0].collect()], n))

    several = len(slices) > 1

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("decontaminate")
        for batch in in_slices(batches):
            at = batch.schema.get_field_index(text_col)
            texts = batch.column(at).to_pylist()
            if several:
                spans = batch.column(batch.schema.get_field_index(spans_col)).to_pylist()
                batch = batch.drop_columns([spans_col])
            else:
                spans = [r[1] for r in _scan(index.value, texts)]
            if remove == "documents":
                yield batch.filter(pa.array([not s for s in spans], pa.bool_()))
            else:
                kept = [_without(t, s) if s else t for t, s in zip(texts, spans, strict=True)]
                yield batch.set_column(at, batch.schema.field(at), pa.array(kept, batch.schema.field(at).type))

    return marked.mapInArrow(clean, docs.schema)


def op1_decontamination(spark, sf_dir):
    """Every document against every benchmark item, ten-word windows."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=10).drop("spans")


OP1_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(ws), 10) AS n, array_to_string(ws[i : i + least(len(ws), 10) - 1], ' ') AS w
       FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(ws[i : i + n - 1], ' ') AS w
       FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, sizes WHERE len(ws) >= n)),
hit AS (SELECT doc_id, dw.n, i, item FROM dw JOIN bw ON dw.w = bw.w AND dw.n = bw.n),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
