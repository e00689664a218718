"""Near-duplicates by SimHash, found with covering locality-sensitive hashing.

A fingerprint bit is 1 if it is set in over half of the XXH64 (seed 42) sums of the text's three-word shingles. For radius r,
each bit position i gets a vector m(i) of r + 1 bits, and each non-zero vector v of r + 1 bits gives a mask with the positions
where the inner product of m(i) and v is odd. Any r positions leave some v for which none of them is in the mask, so any two
fingerprints within the radius agree under some mask: 2^(r+1) - 1 tables miss no pair.

Work is on distinct fingerprints, so copies cost one row. In a table, fingerprints with equal masked values share a bucket.
Small buckets are joined with themselves and verified. The fingerprints of larger ones are joined to all values within half
the radius, which must be even: two fingerprints are within the radius if and only if some value is within half of it from
both. That gives the same components, in rows that grow with the fingerprints and not with the square of a bucket.

Documents are compared by their three-word shingles with repeats, or, with size=1 and distinct=True, by their sets of words:
then an edit changes one feature and not three, so that near copies come closer while other texts stay far apart.

Defined results: a null text has no words; no words give fingerprint zero, which links like any other. Repeated rows get a row
each. A null doc_id is never the smallest; a component of nulls alone has a null component_id. An empty table gives no rows.
Other columns of the input are never looked at, and are kept where a function returns documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..operators.explore import number_rows
from .common import free_name, in_slices, materialise, sized, table, worker_cache
from .components import connected_components

BITS = 64
#: Buckets up to this many distinct fingerprints are compared pair by pair.
SMALL_BUCKET = 32

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_CHUNK = 1 << 15


def fingerprint(text: str | None, size: int = 3, distinct: bool = False) -> int:
    """The 64-bit SimHash of a text's word shingles, repeats included unless ``distinct``; fewer words are one shingle, none
    give zero."""
    import xxhash

    words = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    rows = zip(*(words[k:] for k in range(size)), strict=False) if len(words) >= size else iter([words])
    if distinct:
        rows = list(dict.fromkeys(rows))
    total = len(rows) if distinct else max(1, len(words) - size + 1)
    counts = np.zeros(BITS, dtype=np.int64)
    join = b" ".join
    sums = np.fromiter((digest(join(row), 42) for row in rows), dtype=">u8", count=total)
    for lo in range(0, total, _CHUNK):
        part = sums[lo : lo + _CHUNK]
        counts += np.unpackbits(part.view(np.uint8)).reshape(len(part), BITS).sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(counts * 2 > total).tobytes(), "big")


def _prints(column: pa.Array, size: int, distinct: bool) -> pa.Array:
    values = [fingerprint(t, size, distinct) for t in column.to_pylist()]
    return pa.array(np.array(values, dtype=np.uint64).view(np.int64), pa.int64())


def simhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, distinct: bool = False) -> DataFrame:
    """(doc_id, fp): each document's fingerprint as a signed long."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _prints(batch.column("text"), size, distinct)], ["doc_id", "fp"])

    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, fp long")


def covering_masks(radius: int, bits: int = BITS) -> list[int]:
    """2^(radius+1) - 1 masks such that any ``radius`` bit positions are all outside one of them.

    Position i has the vector (i mod (2^(radius+1) - 1)) + 1; the vectors of any radius positions span less than the whole
    space, so some non-zero v is orthogonal to all of them.
    """
    n = (1 << (radius + 1)) - 1
    return [sum(1 << i for i in range(bits) if ((i % n + 1) & v).bit_count() % 2) for v in range(1, n + 1)]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def links(prints: DataFrame, radius: int = 2, small_bucket: int = SMALL_BUCKET) -> DataFrame:
    """Edges (a, b) over distinct fingerprints ``fp`` whose components are those of all pairs within ``radius`` bits."""
    if radius % 2:
        raise ValueError("the radius must be even")
    masks = covering_masks(radius)
    tables = F.array(*[F.struct(F.lit(k).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for k, m in enumerate(masks)])
    keyed = materialise(prints.select("fp", F.explode(tables).alias("x")).select("fp", "x.t", "x.key"), "fingerprint-tables")
    sizes = keyed.groupBy("t", "key").agg(F.count("*").alias("n"), F.min_by("fp", F.xxhash64("fp", "t")).alias("pivot")).where("n > 1")
    shared = materialise(keyed.hint("merge").join(sizes.hint("merge"), ["t", "key"]), "fingerprint-buckets")
    small = shared.where(F.col("n") <= small_bucket)
    near = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= radius
    pairs = small.alias("a").hint("merge").join(small.alias("b").hint("merge"), (F.col("a.t") == F.col("b.t")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp"))).where(near).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))
    return pairs.unionByName(_linked_through_centres(shared.where(F.col("n") > small_bucket), radius))


def _linked_through_centres(large: DataFrame, radius: int) -> DataFrame:
    """Links of the fingerprints in large buckets (fp, pivot), the pivot being some member of the bucket.

    Fingerprints within the radius of their pivots are linked to them, and the components of these links are their labels: a
    dense group, which has another pivot in each table, then has few labels. A centre is any value within half the radius of a
    fingerprint; labels that meet at a centre are linked to the least one there."""
    close = F.bit_count(F.col("fp").bitwiseXOR(F.col("pivot"))) <= radius
    stars = large.where(close & (F.col("fp") != F.col("pivot"))).select(F.col("pivot").alias("a"), F.col("fp").alias("b")).distinct()
    stars = materialise(stars, "fingerprint-stars")
    joined = connected_components(stars).select(F.col("node").alias("fp"), F.col("component").alias("label"))
    labels = large.select("fp").distinct().hint("merge").join(joined.hint("merge"), "fp", "left").select("fp", F.coalesce("label", "fp").alias("label"))
    labels = materialise(labels, "fingerprint-labels")
    flips = [_signed(sum(1 << i for i in c)) for k in range(radius // 2 + 1) for c in combinations(range(BITS), k)]
    every = F.from_json(F.lit(str(flips)), "array<bigint>")
    centred = labels.select("label", F.explode(F.transform(every, lambda x: F.col("fp").bitwiseXOR(x))).alias("centre")).distinct()
    least = centred.groupBy("centre").agg(F.min("label").alias("a"), F.max("label").alias("z")).where("a <> z").select("centre", "a")
    met = centred.hint("merge").join(least.hint("merge"), "centre").where(F.col("a") != F.col("label")).select("a", F.col("label").alias("b"))
    return stars.unionByName(met.distinct())


def classes(rows: DataFrame, radius: int = 2) -> DataFrame:
    """(fp, component_id) for each distinct fingerprint of ``rows`` (doc_id, fp): the smallest doc_id that it reaches."""
    prints = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "fingerprints")
    joined = connected_components(links(prints, radius))
    rooted = prints.hint("merge").join(joined.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = rooted.groupBy("component").agg(F.min("first_id").alias("component_id"))
    return rooted.hint("merge").join(least.hint("merge"), "component").select("fp", "component_id", "component")


def near_duplicates(docs: DataFrame, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits) and component_id."""
    rows = materialise(simhash(docs, id_col, text_col), "simhash")
    found = classes(rows, radius)
    return rows.hint("merge").join(found.hint("merge"), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, radius: int = 2, id_col: str = "doc_id", text_col: str = "text", size: int = 3, distinct: bool = False) -> DataFrame:
    """``docs`` with all its columns and one document of each group: the smallest id, null ids last. Of rows that repeat that
    id with one fingerprint, one stays."""
    rows = materialise(simhash(docs, id_col, text_col, size, distinct), "simhash")
    named = rows.hint("merge").join(classes(rows, radius).hint("merge"), "fp")
    kept = named.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "fp")).alias("k"))
    kept = materialise(kept.select("k.doc_id", "k.fp"), "kept-documents")
    fp, kept_fp, kept_id = (free_name(docs, name) for name in ("__fp", "__kept_fp", "__kept_id"))

    def add_print(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            prints = _prints(batch.column(batch.schema.get_field_index(text_col)), size, distinct)
            yield pa.RecordBatch.from_arrays([*batch.columns, prints], [*batch.schema.names, fp])

    printed = docs.mapInArrow(add_print, StructType([*docs.schema.fields, StructField(fp, LongType())]))
    ids, kept_ids = F.coalesce(F.xxhash64(F.col(id_col)), F.lit(0)), F.coalesce(F.xxhash64(F.col(kept_id)), F.lit(0))
    there = kept.select(F.col("doc_id").alias(kept_id), F.col("fp").alias(kept_fp))
    same = (F.col(fp) == F.col(kept_fp)) & (ids == kept_ids) & F.col(id_col).eqNullSafe(F.col(kept_id))
    left = printed.hint("merge").join(there.hint("merge"), same, "left_semi")
    return left.dropDuplicates([fp, id_col]).select(*[F.col(f"`{c}`") for c in docs.columns])


#: The verified search: words in a shingle, the least Jaccard of two sets of shingles, independent fingerprints, and longs of
#: a set's bitmap and of its parities.
SHINGLE, ALIKE, PRINTS, BITMAP, PARITIES = 5, (4, 5), 4, 8, 16
#: Members of a group that are compared with all others of it in the first round; eight times as many in each round after.
PIVOTS = 32
#: Keys of documents that are broadcast to a scan of the texts; more are joined by a shuffle.
MOST_KEYS = 1_000_000


def _mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finalizer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct hashes of a text's five-word shingles (fewer words are one) and those of its distinct words."""
    import xxhash

    words = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    known = {w: xxhash.xxh64_intdigest(w, 42) for w in set(words)}
    each = np.fromiter((known[w] for w in words), dtype=np.uint64, count=len(words))
    width = min(SHINGLE, len(words))
    sums = np.zeros(len(words) - width + 1 if words else 0, dtype=np.uint64)
    for k in range(width):
        sums = _mix(sums + each[k : k + len(sums)] + np.uint64(width))
    return np.unique(sums), np.fromiter(known.values(), dtype=np.uint64, count=len(known))


def independent_prints(words: np.ndarray, prints: int = PRINTS) -> list[int]:
    """SimHashes of a set of words under different hash functions, as signed longs."""
    out = []
    for k in range(1, prints + 1):
        counts = np.zeros(BITS, dtype=np.int64)
        for lo in range(0, len(words), _CHUNK):
            part = _mix(words[lo : lo + _CHUNK] ^ np.uint64(0x9E3779B97F4A7C15 * k % (1 << 64))).astype(">u8")
            counts += np.unpackbits(part.view(np.uint8)).reshape(len(part), BITS).sum(axis=0, dtype=np.uint32)
        out.append(int.from_bytes(np.packbits(counts * 2 > len(words)).tobytes(), "big", signed=True))
    return out


def _bitmap(own: np.ndarray) -> np.ndarray:
    """Which of 64 * BITMAP values the hashes of a set have. A bit that only one of two sets has stands for a shingle that the
    other lacks, so bitmaps bound the shared shingles from above."""
    bits = np.zeros(64 * BITMAP, dtype=bool)
    bits[(own >> np.uint64(20)) % np.uint64(64 * BITMAP)] = True
    return np.packbits(bits).view(np.int64)


_BITMAP_COLUMNS = [f"b{k}" for k in range(BITMAP)]
_PARITY_COLUMNS = [f"p{k}" for k in range(PARITIES)]


def _rows(docs: DataFrame, prints: int) -> DataFrame:
    """Of each row: doc_id, h (the hash of its text), shingles (the sum of its set), size, fingerprints and bitmap."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("near_duplicates")  # what another operator held goes
        for batch in in_slices(batches):
            key, size, fps, bits = [], [], [], []
            for text in batch.column("text").to_pylist():
                own, words = shingles(text)
                key.append(int(own.sum(dtype=np.uint64).view(np.int64)))
                size.append(len(own))
                fps.append(independent_prints(words, prints))
                bits.append(_bitmap(own))
            made = [pa.array(key, pa.int64()), pa.array(size, pa.int64()), pa.array(fps, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), *made], ["doc_id", "h", "shingles", "size", "fps", "bits"])

    return docs.mapInArrow(run, f"doc_id {kind}, h long, shingles long, size long, fps array<bigint>, bits array<bigint>")


def _sets(rows: DataFrame) -> DataFrame:
    """Distinct sets of shingles, numbered by their first document (null ids last): k, doc_id, h, size, fingerprints and bitmap.
    Copies cost one row."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h", "fps", "bits")).alias("f")
    sets = rows.groupBy("shingles", "size").agg(first).select("f.*", "shingles", "size")
    columns = ["k", "doc_id", "h", "size", "fps", *[F.col("bits")[k].alias(c) for k, c in enumerate(_BITMAP_COLUMNS)]]
    return materialise(number_rows(sets, ["no_id", "doc_id", "shingles", "size"], "k").select(*columns), "shingle-sets")


def _shared_keys(keyed: DataFrame) -> DataFrame:
    """The rows (b, k) of ``keyed`` whose b has at least two of them. Of several b with the same k, the least is kept."""
    many = keyed.groupBy("b").agg(F.count("*").alias("n")).where("n > 1").select("b")
    met = materialise(keyed.hint("merge").join(many.hint("merge"), "b", "left_semi"), "met-in-buckets")
    held = met.groupBy("b").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("k")).alias("x"), F.bit_xor(F.xxhash64("k", F.lit(1))).alias("y"))
    once = materialise(held.groupBy("n", "x", "y").agg(F.min("b").alias("b")).select("b"), "different-buckets")
    return met.hint("merge").join(once.hint("merge"), "b", "left_semi")


def _members(sets: DataFrame, radius: int, prints: int) -> DataFrame:
    """(k, fp, size, bitmap, bs) for each fingerprint of a set that shares buckets of covering LSH with other sets: bs are
    these buckets, at most one for each mask. Close fingerprints meet in many tables, so equal buckets are kept once."""
    least = ALIKE[0]  # sets of fewer shingles are that similar only if equal
    out = None
    for j in range(prints):
        own = sets.where(F.col("size") >= least).select("k", "size", F.col("fps")[j].alias("fp"), *_BITMAP_COLUMNS)
        keys = F.array(*[F.xxhash64(F.lit(j), F.lit(t), F.col("fp").bitwiseAND(F.lit(_signed(m)))) for t, m in enumerate(covering_masks(radius))])
        buckets = _shared_keys(own.select("k", F.explode(keys).alias("b"))).groupBy("k").agg(F.collect_list("b").alias("bs"))
        found = materialise(own.hint("merge").join(buckets.hint("merge"), "k"), "bucket-members")
        out = found if out is None else out.unionByName(found)
    return out


def _close(radius: int, prints: tuple[str, ...]) -> Column:
    """Whether the members x and y are within the radius in one of the fingerprints."""
    return reduce(or_, [F.bit_count(F.col(f"x.{p}").bitwiseXOR(F.col(f"y.{p}"))) <= radius for p in prints])


def _may_be_alike(radius: int) -> Column:
    """Whether the members x and y are close, and their sizes and bitmaps leave room for the Jaccard."""

    def lacking(one: str, other: str) -> Column:
        lone = [F.bit_count(F.col(f"{one}.{c}").bitwiseAND(F.bitwise_not(F.col(f"{other}.{c}")))) for c in _BITMAP_COLUMNS]
        return F.col(f"{one}.size") - sum(lone[1:], lone[0])

    num, den = ALIKE  # shared / (x + y - shared) >= num / den
    return _close(radius, ("fp",)) & (F.least(lacking("x", "y"), lacking("y", "x")) * (num + den) >= (F.col("x.size") + F.col("y.size")) * num)


def _may_differ_little(radius: int, prints: tuple[str, ...]) -> Column:
    """Whether the members x and y are close, and what they surely differ by leaves room for the Jaccard: the shingles that
    are in one set alone, and one for each parity of the others in which the two are not the same."""
    odd = [F.bit_count(F.col(f"x.{c}").bitwiseXOR(F.col(f"y.{c}"))) for c in _PARITY_COLUMNS]
    num, den = ALIKE  # x + y - 2 * shared <= (x + y) * (den - num) / (den + num)
    return _close(radius, prints) & ((F.col("x.lone") + F.col("y.lone") + sum(odd[1:], odd[0])) * (num + den) <= (F.col("x.size") + F.col("y.size")) * (den - num))


class _Labels:
    """The groups of sets found so far: each set has the lowest number of its group as label, at first its own."""

    def __init__(self, docs: DataFrame, sets: DataFrame):
        self.docs, self.sets, self.known = docs, sets, None
        self.moved = docs.sparkSession.createDataFrame([], "k long, label long")

    def of(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the label of each k."""
        return rows.hint("merge").join(self.moved.hint("merge"), "k", "left").withColumn("label", F.coalesce("label", "k"))

    def shingles(self, wanted: DataFrame) -> DataFrame:
        """(k, own) of the sets in ``wanted`` and those asked for before; a set's text is read once."""
        if self.known is not None:
            wanted = wanted.hint("merge").join(self.known.select("k").hint("merge"), "k", "left_anti")
        found = self.sets.select("k", "doc_id", "h").hint("merge").join(wanted.hint("merge"), "k", "left_semi")
        more = _shingle_table(self.docs, materialise(found, "wanted-sets"))
        self.known = more if self.known is None else self.known.unionByName(more)
        return self.known

    def link(self, met: DataFrame) -> None:
        """Joins the labels of the pairs (x, y of ``met``) that are similar."""
        pairs = met.select(F.least("x.k", "y.k").alias("a"), F.greatest("x.k", "y.k").alias("b"), F.col("x.label").alias("la"), F.col("y.label").alias("lb"))
        pairs = materialise(pairs.distinct(), "candidate-pairs")
        known = self.shingles(pairs.select(F.col("a").alias("k")).unionByName(pairs.select(F.col("b").alias("k"))).distinct())
        links = materialise(_verified(pairs, known).select("la", "lb").distinct(), "label-links")
        renamed = connected_components(links).where("node <> component").select(F.col("node").alias("label"), F.col("component").alias("new"))
        # the old labels that go over to another, and their members
        moved = self.moved.hint("merge").join(renamed.hint("merge"), "label", "left").select("k", F.coalesce("new", "label").alias("label"))
        self.moved = materialise(moved.unionByName(renamed.select(F.col("label").alias("k"), F.col("new").alias("label"))), "set-labels")


def linked_sets(docs: DataFrame, sets: DataFrame, radius: int = 4, prints: int = PRINTS, pivots: int = PIVOTS, small: int = SMALL_BUCKET) -> DataFrame:
    """(k, label) of the sets with another one in their group, label being its lowest number. Groups are the components of all
    pairs within the radius in some fingerprint whose exact Jaccard is at least ALIKE.

    First each member of a bucket is compared with the lowest. Buckets whose members have one label are then finished. The
    others are compared pair by pair where they have up to ``small`` members. Members of larger ones meet again only where
    they share a rare shingle (``_rare_groups``), so texts that have the same words and little more in common never do."""
    groups, alike = _Labels(docs, sets), _may_be_alike(radius)
    members = _members(sets, radius, prints)
    bucketed = members.select("k", "fp", "size", *_BITMAP_COLUMNS, F.explode("bs").alias("b"))
    lowest = materialise(bucketed.groupBy("b").agg(F.min("k").alias("k")), "lowest-members")
    first = members.select("k", "fp", "size", *_BITMAP_COLUMNS, "bs").hint("merge").join(lowest.hint("merge"), "k").where(F.array_contains("bs", F.col("b"))).drop("bs")
    first = materialise(first.withColumn("label", F.col("k")), "first-members")
    stars = first.alias("x").hint("merge").join(bucketed.withColumn("label", F.col("k")).alias("y").hint("merge"), (F.col("x.b") == F.col("y.b")) & (F.col("x.k") < F.col("y.k")) & alike)
    groups.link(stars)
    named = groups.of(members).select("k", "label", "fp", "size", *_BITMAP_COLUMNS, F.explode("bs").alias("b"))
    mixed = named.groupBy("b").agg(F.count("*").alias("n"), F.min("label").alias("least"), F.max("label").alias("greatest")).where("least <> greatest")
    mixed = materialise(mixed.select("b", "n"), "mixed-buckets")
    few = materialise(named.hint("merge").join(mixed.where(F.col("n") <= small).hint("merge"), "b", "left_semi"), "small-buckets")
    crossing = (F.col("x.b") == F.col("y.b")) & (F.col("x.k") < F.col("y.k")) & (F.col("x.label") != F.col("y.label")) & alike
    dense = named.select("b", "k").hint("merge").join(mixed.where(F.col("n") > small).hint("merge"), "b", "left_semi").select("k").distinct()
    dense = materialise(dense, "dense-members")
    groups.link(few.alias("x").hint("merge").join(few.alias("y").hint("merge"), crossing))
    if not dense.isEmpty():
        _link_dense(groups, dense, radius, prints, pivots)
    return groups.moved


def _shared_shingles(own: DataFrame) -> DataFrame:
    """Of each set of ``own`` (k, own) that shares shingles with another: k, size, shared (the shingles s that n of these sets
    have, the rarest first), lone (the number of the others), and the parities of the shared ones, dealt by hash to 64 *
    PARITIES cells."""
    each = own.select("k", F.size("own").alias("size"), F.explode("own").alias("s"))
    often = materialise(each.groupBy("s").agg(F.count("*").alias("n")).where("n > 1"), "shared-shingles")
    dealt = each.hint("merge").join(often.hint("merge"), "s").withColumn("cell", F.pmod(F.xxhash64("s"), F.lit(64 * PARITIES)).cast("int"))
    bit = F.expr("shiftleft(1L, cell % 64)")
    parities = [F.bit_xor(F.when(F.shiftright("cell", 6) == w, bit).otherwise(F.lit(0).cast("long"))).alias(c) for w, c in enumerate(_PARITY_COLUMNS)]
    sets = dealt.groupBy("k", "size").agg(F.sort_array(F.collect_list(F.struct("n", "s"))).alias("shared"), *parities)
    return materialise(sets.withColumn("lone", F.col("size") - F.size("shared")), "sets-that-share")


def _rare_groups(sets: DataFrame) -> DataFrame:
    """(b, k): the sets by the shingles b among their rarest, with at least two sets for each b; ``sets`` as of
    ``_shared_shingles``.

    Two sets of Jaccard t or more share at least t of either. With shingles in one order, by the number of these sets that
    have them, they therefore share one among the first size - ceil(t * size) + 1 of both. Shingles of one set come first."""
    num, den = ALIKE
    wanted = F.col("size") - F.ceil(F.col("size") * num / den) + 1 - F.col("lone")
    return _shared_keys(sets.where(wanted > 0).select("k", F.explode(F.slice("shared", F.lit(1), wanted.cast("int"))).alias("x")).select("k", F.col("x.s").alias("b")))


def _link_dense(groups: _Labels, dense: DataFrame, radius: int, prints: int, pivots: int) -> None:
    """Links the sets ``dense`` (k) by groups that share a rare shingle.

    Copies of one text that are each changed in some words resemble one another just too little to link, so they keep their
    labels and all of them are compared; what a pair surely differs by (``_may_differ_little``) leaves few such pairs to look
    up. In each round some members of every group with several labels, those of its rarest labels first, are compared with all
    members of other labels, and then leave it; their number grows from round to round. No pair of different labels is lost,
    pairs of one label are never made, and copies, which soon have one label, cost rows in proportion to their number."""
    own = groups.shingles(dense).hint("merge").join(dense.hint("merge"), "k", "left_semi")
    fps = tuple(f"fp{j}" for j in range(prints))
    sharing = _shared_shingles(own)
    facts = groups.sets.select("k", *[F.col("fps")[j].alias(name) for j, name in enumerate(fps)])
    facts = materialise(sharing.drop("shared").hint("merge").join(facts.hint("merge"), "k"), "dense-facts")
    active = materialise(_rare_groups(sharing).hint("merge").join(facts.hint("merge"), "k"), "rare-groups")
    most, alike = pivots, _may_differ_little(radius, fps)
    while True:
        named = groups.of(active)
        counts = materialise(named.groupBy("b", "label").agg(F.count("*").alias("rarity")), "group-labels")
        mixed = counts.groupBy("b").agg(F.count("*").alias("labels"), F.sum("rarity").alias("n")).where("labels > 1")
        mixed = materialise(counts.hint("merge").join(mixed.select("b", "n").hint("merge"), "b"), "mixed-groups")
        if mixed.isEmpty():
            return
        placed = materialise(number_rows(named.hint("merge").join(mixed.hint("merge"), ["b", "label"]), ["b", "rarity", "label", "k"], "at"), "placed-members")
        start = materialise(placed.groupBy("b").agg(F.min("at").alias("start")), "group-starts")
        ranked = materialise(placed.hint("merge").join(start.hint("merge"), "b").withColumn("r", F.col("at") - F.col("start") + 1).drop("at", "start", "rarity"), "ranked-members")
        crossing = (F.col("x.b") == F.col("y.b")) & (F.col("x.r") < F.col("y.r")) & (F.col("x.label") != F.col("y.label")) & alike
        groups.link(ranked.where(F.col("r") <= most).alias("x").hint("merge").join(ranked.alias("y").hint("merge"), crossing))
        active = ranked.where((F.col("r") > most) & (F.col("n") > most + 1)).drop("r", "label", "n")  # one that is left has met all
        most *= 8


def _verified(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """The pairs (a, b and others) whose sets of shingles have an exact Jaccard of at least ALIKE."""
    num, den = ALIKE
    first = known.select(F.col("k").alias("a"), F.col("own").alias("own_a"))
    second = known.select(F.col("k").alias("b"), F.col("own").alias("own_b"))
    both = F.size(F.array_intersect("own_a", "own_b"))
    alike = both * den >= (F.size("own_a") + F.size("own_b") - both) * num
    return pairs.hint("merge").join(first.hint("merge"), "a").hint("merge").join(second.hint("merge"), "b").where(alike)


def _shingle_table(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(k, own): the shingle hashes of the documents named by ``wanted`` (k, doc_id, h), each once."""
    there = wanted.select("k", F.col("doc_id").alias("__id"), F.col("h").alias("__h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            own = [shingles(t)[0].view(np.int64) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(own, pa.list_(pa.int64()))], ["k", "own"])

    same = (F.col("h") == F.col("__h")) & F.col("doc_id").eqNullSafe(F.col("__id"))
    texts = docs.join(sized(there, MOST_KEYS), same).select("k", "text").dropDuplicates(["k"])
    return materialise(texts.mapInArrow(run, "k long, own array<bigint>"), "shingles")


def deduplicate_verified(docs: DataFrame, radius: int = 4, prints: int = PRINTS, id_col: str = "doc_id", text_col: str = "text", pivots: int = PIVOTS) -> DataFrame:
    """``docs`` with all its columns and one document of each group: the smallest id, null ids last. Groups are linked by pairs
    whose five-word shingle sets have an exact Jaccard of 0.8 or more, found as candidates by covering LSH over several
    independent fingerprints of their sets of words. Of rows that repeat an id and text, one stays.

    What stays is decided on ids and hashes; the texts are only read again to leave out the others."""
    text = F.col(f"`{text_col}`").cast("string")
    h = F.coalesce(F.xxhash64(text), F.lit(0))
    slim = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), h.alias("h"))
    rows = materialise(_rows(slim, prints), "shingle-rows")
    sets = _sets(rows)
    dropped = linked_sets(slim, sets, radius, prints, pivots).where("label <> k")
    kept = sets.select("k", "doc_id", "h").hint("merge").join(dropped.select("k").hint("merge"), "k", "left_anti")
    kept = kept.select(F.col("doc_id").alias("kept_id"), F.col("h").alias("kept_h"))
    own = rows.groupBy("doc_id", "h").agg(F.count("*").alias("n"))
    stays = (F.col("h") == F.col("kept_h")) & F.col("doc_id").eqNullSafe(F.col("kept_id"))
    judged = own.hint("merge").join(kept.hint("merge"), stays, "left").select("doc_id", "h", "n", F.col("kept_h").isNotNull().alias("stays"))
    judged = materialise(judged.where("NOT stays OR n > 1"), "judged-documents")
    key_id, key_h = free_name(docs, "__key_id"), free_name(docs, "__key_h")

    def named(which: str) -> DataFrame:
        return sized(judged.where(which).select(F.col("doc_id").alias(key_id), F.col("h").alias(key_h)), MOST_KEYS)

    same = (h == F.col(key_h)) & F.col(id_col).eqNullSafe(F.col(key_id))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    if judged.where("stays").isEmpty():
        return docs.join(named("true"), same, "left_anti")
    once = docs.join(named("stays"), same).dropDuplicates([key_id, key_h]).select(*columns)
    return docs.join(named("true"), same, "left_anti").unionByName(once)


def op8_near_duplicates(spark, sf_dir):
    """Fingerprint and group of every document, radius 2."""
    return near_duplicates(table(spark, sf_dir, "documents"), 2)
