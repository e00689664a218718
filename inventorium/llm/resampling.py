"""Importance resampling towards a target distribution, over hashed n-grams.

Texts are taken apart by Arrow kernels: ascii_lower, split_pattern_regex, list_flatten, and dictionary_encode for the distinct
words. The codes of a run of words are those of the run before it and of the word behind, so longer n-grams come from shifted
indices; a CRC is taken once for each distinct pair of codes, carried on from the CRC of its first part. Bucket counts are
summed in a task before they are shuffled; gains are taken by bucket and reduced over the segment of each document.

Both passes read the texts where they lie, so no text is shuffled. The driver sees one row for each bucket, whose number is a
parameter. Ranks come from a sort by range, in which rows that are alike are told apart by their place in the scored table.

Defined results: null and empty texts have no words and no features, and a weight of 0; they are scored, and drawn only if
``min_words`` is 0. A null id is hashed as an empty one and comes first among equal scores. Rows that repeat an id and a text
get equal scores and ranks next to each other. A text of any length is taken whole, in a slice of its own. An empty table
gives no rows; an empty target gives gains that only say how rare a bucket is. Other columns are never looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.explore import number_rows
from .common import in_byte_slices, materialise, table

#: What stands between words: the ASCII characters that are neither digits nor lower-case letters.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes of text in one call of the kernels.
SLICE_BYTES = 8 << 20


def feature_buckets(texts: pa.Array, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bucket of every feature and the row it belongs to, and the number of words of every row."""
    pieces = pc.split_pattern_regex(pc.ascii_lower(texts), pattern=GAPS)
    words, rows = pc.list_flatten(pieces), pc.list_parent_indices(pieces)
    some = pc.greater(pc.binary_length(words), 0)
    words, rows = words.filter(some), rows.filter(some).to_numpy()
    n_words = np.bincount(rows, minlength=len(texts))
    coded = pc.dictionary_encode(words)
    last = coded.indices.to_numpy().astype(np.int64)
    distinct = coded.dictionary.cast(pa.binary() if pa.types.is_string(coded.dictionary.type) else pa.large_binary()).to_pylist()
    crcs = np.fromiter(map(zlib.crc32, distinct), np.int64, len(distinct))
    out, owners = [crcs[last] % buckets], [rows]
    codes, starts, tails = last, np.arange(len(last)), None
    for n in range(2, longest + 1):
        whole = starts + n - 1 < len(last)
        starts, codes = starts[whole], codes[whole]
        same = rows[starts] == rows[starts + n - 1]
        starts, codes = starts[same], codes[same]
        pairs, codes = np.unique(codes * len(distinct) + last[starts + n - 1], return_inverse=True)
        tails = tails or [b" " + w for w in distinct]
        first, word = np.divmod(pairs, max(len(distinct), 1))
        crcs = np.fromiter((zlib.crc32(tails[w], c) for w, c in zip(word.tolist(), crcs[first].tolist(), strict=True)), np.int64, len(pairs))
        out.append(crcs[codes] % buckets)
        owners.append(rows[starts])
    return np.concatenate(out), np.concatenate(owners), n_words


def bucket_counts(texts: DataFrame, text_col: str = "text", longest: int = 1, buckets: int = 10_000) -> DataFrame:
    """(bucket, n): how many features of all texts fall into each bucket; empty buckets have no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in in_byte_slices(batches, "text", SLICE_BYTES):
            total += np.bincount(feature_buckets(batch.column("text"), longest, buckets)[0], minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["bucket", "n"])

    return texts.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(corpus: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """Of each bucket, the log ratio of its smoothed shares in the target and in the corpus, in thousandths, rounded down."""
    sides = corpus.select("bucket", "n", F.lit(0).alias("side")).unionByName(target.select("bucket", "n", F.lit(1).alias("side")))
    counts = np.zeros((2, buckets))
    for row in sides.collect():  # two rows for each bucket at most
        counts[row.side, row.bucket] = row.n
    of_all, of_target = counts.sum(axis=1)
    ratio = (counts[1] + 1) * (of_all + buckets) / ((counts[0] + 1) * (of_target + buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weights(docs: DataFrame, gains: np.ndarray, id_col: str = "doc_id", text_col: str = "text", longest: int = 1) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the sum of the gains of each document's features."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_byte_slices(batches, "text", SLICE_BYTES):
            found, owners, n_words = feature_buckets(batch.column("text"), longest, len(gains))
            order = np.argsort(owners, kind="stable") if longest > 1 else slice(None)
            sums = np.concatenate(([0], np.cumsum(gains[found[order]])))
            n_features = np.bincount(owners, minlength=batch.num_rows)
            ends = np.cumsum(n_features)
            columns = (n_words, n_features, sums[ends] - sums[ends - n_features])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", "n_words", "n_features", "weight"])

    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: int) -> Column:
    """A document's noise in thousandths, from a hash of seed and id: adding it to log weights and taking the highest draws
    without replacement."""
    digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", longest: int = 1, buckets: int = 10_000, min_words: int = 20, seed: int = 2024) -> DataFrame:
    """Every document's doc_id, n_features, weight and score, and its rank if it is drawn: ``percent`` of the documents with
    ``min_words`` words or more, by highest score, ties to the smaller id."""
    gains = bucket_gains(bucket_counts(docs, text_col, longest, buckets), bucket_counts(target, target_text_col, longest, buckets), buckets)
    scored = weights(docs, gains, id_col, text_col, longest)
    scored = scored.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)).withColumn("place", F.monotonically_increasing_id())
    scored = materialise(scored, "scored-documents")
    fit = scored.where(F.col("n_words") >= min_words)
    drawn = percent * fit.count() // 100
    ranked = number_rows(fit.withColumn("below", -F.col("score")), ["below", "doc_id", "n_features", "place"], "rank")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    return ranked.select(*columns).unionByName(rest.select(*columns))


def op13_resampling(spark, sf_dir):
    """A tenth of the documents of 20 words or more, drawn towards the benchmark."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)


#: CRC-32 by bytes, for each distinct word.
OP13_SQL = r"""
WITH RECURSIVE bits(v, c, k) AS (SELECT v, v, 0 FROM (SELECT unnest(range(0, 256)) AS v) UNION ALL SELECT v, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY v) AS t FROM bits WHERE k = 8),
x AS (SELECT 0 AS side, row_number() OVER () AS r, doc_id, text FROM documents UNION ALL SELECT 1, 0, NULL, text FROM benchmark),
w AS (SELECT side, r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM x),
f AS (SELECT side, r, word, count(*) AS n FROM (SELECT side, r, unnest(ws) AS word FROM w) GROUP BY ALL),
words AS (SELECT DISTINCT word FROM f),
hashed AS (SELECT word, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, octet_length(encode(word))), lambda k: CAST('0x' || substr(hex(encode(word)), 2 * k + 1, 2) AS BIGINT))), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) % 10000 AS bucket FROM words, crc_table),
s AS (SELECT bucket, sum(n) FILTER (side = 0) AS s, sum(n) FILTER (side = 1) AS t FROM f JOIN hashed USING (word) GROUP BY bucket),
totals AS (SELECT CAST(coalesce(sum(s), 0) AS DOUBLE) AS ss, CAST(coalesce(sum(t), 0) AS DOUBLE) AS tt FROM s),
gains AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1) * (ss + 10000) / ((coalesce(s, 0) + 1) * (tt + 10000)))) AS BIGINT) AS gain FROM s, totals),
weighed AS (SELECT r, sum(n * gain) AS weight FROM f JOIN hashed USING (word) JOIN gains USING (bucket) WHERE side = 0 GROUP BY r),
h AS (SELECT r, doc_id, CAST(len(ws) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight, CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM w LEFT JOIN weighed USING (r) WHERE side = 0),
scored AS (SELECT r, doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296.0))) AS BIGINT) AS score FROM h),
placed AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS k, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN k <= 10 * n // 100 THEN k END AS rank FROM scored LEFT JOIN placed USING (r)
"""
