"""Quality by perplexity: an interpolated modified Kneser-Ney model over character n-grams, trained on the trusted text of each
language, and thresholds for each language at a quantile of trusted documents that the model has not seen.

Counts, probabilities and back-off weights are tables, sharded by model and n-gram. An n-gram is its context (the characters
before, 21 bits each) and its last symbol, so every character of Unicode counts as itself and no table has a fixed size.
Documents are dealt into chunks of bounded size by one shuffle, compressed. Each chunk sends its distinct n-grams, not those of each
document, to the sharded tables; their costs come back by joins and meet the chunk's texts, which were shuffled once, in a
cogroup that sums them over each document. No part of the model is collected or broadcast, but for tables of proven size.

A document passes if its perplexity and its burst are both under their thresholds. A few bad words hardly move a mean, so dear
stretches are counted as well: runs of windows of WINDOW characters over a bound that held-out trusted text goes over once in
EVERY characters. The burst is how far a document's runs exceed those expected of its length, in standard deviations, so
neither figure moves with length as such: trusted texts that are joined keep passing.

Defined results: a null or empty text has no perplexity and is not kept. Languages without a model of their own, null and
the empty string included, use the model pooled over all trusted text, and its thresholds where theirs has no held-out text.
Repeated rows get a row each; a label that repeats counts once, and a document is trusted if no label of it says otherwise.
Without trusted text nothing is scored or kept. If no trusted document is held out, thresholds come from all trusted ones. An
empty table gives no rows. Other columns of the inputs are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import in_byte_slices, materialise, new_path, remove, sized, table

ORDER, WINDOW = 4, 6
#: Characters of held-out trusted text with one run of dear windows, and the bounds among which that one is found: mean costs.
EVERY, BOUNDS = 10_000, np.arange(1.0, 13.0, 0.125)
#: Of the held-out trusted documents of a language, this share is under each threshold.
QUANTILE = 0.99
#: Bytes of text in a chunk, about.
CHUNK_BYTES = 48 << 20
#: Chunks whose numbers an n-gram takes along in one row.
LISTED_CHUNKS = 4096
#: Trusted ids and rows of small model tables that are broadcast; more are joined by a shuffle.
MOST_IDS, MOST_ROWS = 2_000_000, 50_000
#: Bins of one unit, in which thresholds are found.
_COST_BINS, _BURST_BINS = 512, 1 << 16
_POOLED = ""
_BITS, _START = 21, 0x110000  # one past the last character
_LAST = (1 << _BITS) - 1
#: Characters taken at once, and distinct n-grams that a task holds before it sends them on.
_PIECE, _HELD = 1 << 21, 1_500_000
#: Bytes of texts that are compressed or read at once.
_SLICE = 8 << 20


def _pieces(text: str) -> Iterator[np.ndarray]:
    """A text's symbols in pieces, each behind the ORDER - 1 symbols before it."""
    raw = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
    whole = np.concatenate([np.full(ORDER - 1, _START, dtype=np.int64), raw.astype(np.int64)])
    for lo in range(0, len(raw), _PIECE):
        yield whole[lo : lo + _PIECE + ORDER - 1]


def _grams(pieces: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Context and symbol of every position of some pieces."""
    whole = np.concatenate(pieces)
    starts = np.cumsum([0] + [len(p) for p in pieces[:-1]])
    own = np.ones(len(whole), dtype=bool)
    own[(starts[:, None] + np.arange(ORDER - 1)).ravel()] = False
    context = np.zeros(len(whole), dtype=np.int64)
    for k in range(1, ORDER):
        context[k:] |= whole[:-k] << _BITS * (k - 1)
    return context[own], whole[own]


def _distinct(context: np.ndarray, symbol: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct n-grams with their counts."""
    at, contexts = pd.factorize(context)
    at, keys = pd.factorize(at.astype(np.int64) << _BITS | symbol)
    counts = np.bincount(at, weights=n, minlength=len(keys)).astype(np.int64)
    return contexts[keys >> _BITS], keys & _LAST, counts


def _counter(labels: tuple[str, ...]):
    """Counts of the n-grams under each combination of ``labels``, summed in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[tuple]] = {}
        kinds: list[pa.DataType] = []

        def merge() -> int:
            for label, parts in held.items():
                held[label] = [_distinct(*(np.concatenate(c) for c in zip(*parts, strict=True)))]
            return sum(len(parts[0][0]) for parts in held.values())

        def sent() -> Iterator[pa.RecordBatch]:
            merge()
            for label, [(context, symbol, n)] in held.items():
                fixed = [pa.array([x] * len(n), kind) for x, kind in zip(label, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*fixed, pa.array(context), pa.array(symbol.astype(np.int32)), pa.array(n)], [*labels, "context", "symbol", "n"])
            held.clear()

        size = 0
        for batch in batches:
            kinds = [batch.schema.field(c).type for c in labels]
            waiting: dict[tuple, list[np.ndarray]] = {}
            room: dict[tuple, int] = {}

            def count(label: tuple, waiting=waiting, room=room) -> int:
                found = _distinct(*_grams(waiting.pop(label)))
                room.pop(label)
                held.setdefault(label, []).append(found)
                return len(found[0])

            for *label, text in zip(*(batch.column(c).to_pylist() for c in (*labels, "text")), strict=True):
                key = tuple(label)
                for piece in _pieces(text or ""):
                    waiting.setdefault(key, []).append(piece)
                    room[key] = room.get(key, 0) + len(piece)
                    if room[key] > _PIECE:
                        size += count(key)
            for key in list(waiting):
                size += count(key)
            if size > 2 * _HELD:
                size = merge()
                if size > _HELD:
                    yield from sent()
                    size = 0
        yield from sent()

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts compressed, for a shuffle that is about a third as large."""
    for batch in in_byte_slices(batches, "text", _SLICE):
        zip_ = zstandard.ZstdCompressor(level=3).compress
        texts = [None if t is None else zip_(t.encode("utf-8", "replace")) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()) if c == "text" else batch.column(c) for c in batch.schema.names], batch.schema.names)


def _text(packed: bytes | None) -> str | None:
    return None if packed is None else zstandard.ZstdDecompressor().decompress(packed).decode()


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in in_byte_slices(batches, "text", _SLICE // 4):
        texts = pa.array(map(_text, batch.column("text").to_pylist()), pa.string())
        yield pa.RecordBatch.from_arrays([texts if c == "text" else batch.column(c) for c in batch.schema.names], batch.schema.names)


def gram_counts(trusted: DataFrame) -> DataFrame:
    """``trusted`` (lang, text) to (model, context, symbol, n) over whole texts: each language, and all pooled."""
    rows = trusted.select(F.coalesce("lang", F.lit(_POOLED)).alias("model"), "text")
    found = rows.mapInArrow(_counter(("model",)), "model string, context long, symbol int, n long")
    counts = materialise(found.groupBy("model", "context", "symbol").agg(F.sum("n").alias("n")), "gram-counts")
    pooled = counts.groupBy("context", "symbol").agg(F.sum("n").alias("n")).select(F.lit(_POOLED).alias("model"), "context", "symbol", "n")
    return counts.where(F.col("model") != _POOLED).unionByName(pooled)


def kneser_ney(counts: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """For each order from 1, (model, context, symbol, p) of the n-grams seen; and (model, order, context, gamma, uniform).

    ``a`` is the count at the highest order, and below it the number of different symbols seen before. The discounts of
    counts 1, 2 and 3 or more come from the counts of counts, by model and order. Order 1 backs off to ``uniform``, which
    leaves room for one symbol that is not in the trusted text.
    """
    tables = [counts.select("model", "context", "symbol", F.col("n").alias("a"))]
    for k in range(ORDER - 1, 0, -1):
        shorter = F.col("context").bitwiseAND((1 << _BITS * (k - 1)) - 1).alias("context")
        tables.insert(0, tables[0].groupBy("model", shorter, "symbol").agg(F.count("*").alias("a")))
    every = None
    for order, grams in enumerate(tables, 1):
        own = grams.withColumn("order", F.lit(order))
        every = own if every is None else every.unionByName(own)
    spark, passing = counts.sparkSession, [new_path(counts.sparkSession, "ngrams"), new_path(counts.sparkSession, "discounted")]
    every.write.parquet(passing[0])
    every = spark.read.schema(every.schema).parquet(passing[0])
    of = every.groupBy("model", "order").agg(F.count("*").alias("types"), *[F.count_if(F.col("a") == c).cast("double").alias(f"c{c}") for c in (1, 2, 3, 4)])
    y = F.col("c1") / (F.col("c1") + 2 * F.col("c2"))
    sound = (F.col("c1") > 0) & (F.col("c2") > 0) & (F.col("c3") > 0) & (F.col("c4") > 0)

    def discount(c: int):
        own = c - (c + 1) * y * F.col(f"c{c + 1}") / F.nullif(F.col(f"c{c}"), F.lit(0.0))
        return F.when(sound, F.greatest(F.lit(0.05), F.least(own, F.lit(c - 0.05)))).otherwise(0.5).alias(f"d{c}")

    discounts = materialise(of.select("model", "order", (1.0 / (F.col("types") + 1)).alias("uniform"), *[discount(c) for c in (1, 2, 3)]), "discounts")
    taken = F.when(F.col("a") == 1, F.col("d1")).when(F.col("a") == 2, F.col("d2")).otherwise(F.col("d3"))
    cut = every.hint("merge").join(sized(discounts, MOST_ROWS), ["model", "order"]).withColumn("d", taken)
    contexts = materialise(cut.groupBy("model", "order", "context").agg(F.sum("a").alias("total"), (F.sum("d") / F.sum("a")).alias("gamma"), F.first("uniform").alias("uniform")), "contexts")
    joined = cut.drop("uniform").hint("merge").join(contexts.hint("merge"), ["model", "order", "context"])
    joined = joined.select("model", "order", "context", "symbol", ((F.col("a") - F.col("d")) / F.col("total")).alias("own"), "gamma", "uniform")
    joined.write.parquet(passing[1])
    seen = spark.read.schema(joined.schema).parquet(passing[1])
    out = [materialise(seen.where("order = 1").select("model", "context", "symbol", (F.col("own") + F.col("gamma") * F.col("uniform")).alias("p")), "ngram-probabilities")]
    for order in range(2, ORDER + 1):
        below = out[-1].select("model", F.col("context").alias("suffix"), "symbol", F.col("p").alias("q"))
        above = seen.where(F.col("order") == order).withColumn("suffix", F.col("context").bitwiseAND((1 << _BITS * (order - 2)) - 1))
        both = above.hint("merge").join(below.hint("merge"), ["model", "suffix", "symbol"])
        out.append(materialise(both.select("model", "context", "symbol", (F.col("own") + F.col("gamma") * F.col("q")).alias("p")), "ngram-probabilities"))
    for path in passing:
        remove(spark, path)
    return out, contexts.select("model", "order", "context", "gamma", "uniform")


def costs(needed: DataFrame, model: tuple[list[DataFrame], DataFrame]) -> DataFrame:
    """``needed`` (model, context, symbol and others) with ``cost``, -ln p: of the longest n-gram seen, times the weights of the
    longer contexts that are known. Null without a model."""
    tables, contexts = model
    out = needed
    for order, seen in enumerate(tables, 1):
        part = F.col("context").bitwiseAND((1 << _BITS * (order - 1)) - 1)
        weights = contexts.where(F.col("order") == order).select(F.col("model").alias("m"), F.col("context").alias("c"), "gamma", *(["uniform"] if order == 1 else []))
        weights = materialise(weights, "weights")
        grams = seen.select(F.col("model").alias("m"), F.col("context").alias("c"), F.col("symbol").alias("s"), F.col("p").alias("found"))
        out = out.hint("merge").join(sized(weights, MOST_ROWS), (F.col("model") == F.col("m")) & (part == F.col("c")), "left").drop("m", "c")
        out = out.hint("merge").join(sized(grams, MOST_ROWS), (F.col("model") == F.col("m")) & (part == F.col("c")) & (F.col("symbol") == F.col("s")), "left").drop("m", "c", "s")
        rest = F.col("gamma") * F.col("uniform") if order == 1 else F.coalesce("gamma", F.lit(1.0)) * F.col("p")
        out = out.withColumn("p", F.coalesce("found", rest)).drop("found", "gamma", "uniform")
    return out.withColumn("cost", -F.log("p")).drop("p")


def _summed(key, docs: pa.Table, known: pa.Table) -> pa.Table:
    """Mean cost of each text of a chunk from the costs of the chunk's n-grams, its length, and the runs of windows over each of
    BOUNDS."""
    tables = {}
    names = known["lang"].to_numpy(zero_copy_only=False)
    context, symbol = known["context"].to_numpy(), known["symbol"].to_numpy()
    cost = known["cost"].to_numpy(zero_copy_only=False).astype(np.float64)
    for lang in dict.fromkeys(names):
        own = names == lang
        at, contexts = pd.factorize(context[own])
        keys, first = np.unique(at.astype(np.int64) << _BITS | symbol[own].astype(np.int64), return_index=True)  # a task may send one twice
        tables[lang] = pd.Index(contexts), pd.Index(keys), cost[own][first]
    rows: list[tuple] = []
    for lang, packed in zip(docs["lang"].to_pylist(), docs["text"], strict=True):
        parts = []
        for piece in _pieces(_text(packed.as_py()) or ""):
            c, s = _grams([piece])
            contexts, keys, dear = tables[lang or _POOLED]
            at = keys.get_indexer(contexts.get_indexer(c).astype(np.int64) << _BITS | s)
            if (at < 0).any():
                raise RuntimeError("a chunk lacks the cost of an n-gram")
            parts.append(dear[at])
        own = np.concatenate(parts) if parts else np.zeros(0)
        rows.append((None, None, None) if not len(own) or np.isnan(own[0]) else (float(own.mean()), len(own), _runs(own)))
    mean, n, runs = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table([docs["doc_id"], docs["lang"], pa.array(mean, pa.float64()), pa.array(n, pa.int64()), pa.array(runs, pa.list_(pa.int32()))], ["doc_id", "lang", "cost", "n", "runs"])


def _runs(costs: np.ndarray) -> list[int]:
    """How many runs of windows lie over each of BOUNDS. A run begins where a window is over a bound and the one before is not,
    so it counts for every bound between the two."""
    width = min(WINDOW, len(costs))
    window = costs[: len(costs) - width + 1].copy()
    for k in range(1, width):
        window += costs[k : len(costs) - width + 1 + k]
    over = np.searchsorted(BOUNDS, window / width)  # so many bounds lie below
    before = np.concatenate(([0], over[:-1]))
    up = over > before
    edges = np.bincount(before[up], minlength=len(BOUNDS) + 1) - np.bincount(over[up], minlength=len(BOUNDS) + 1)
    return np.cumsum(edges)[: len(BOUNDS)].tolist()


def score(docs: DataFrame, model: tuple[list[DataFrame], DataFrame], id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, lang, cost, n, runs): the mean cost of a character, their number, and the runs of dear windows by bound."""
    lang = F.col(lang_col).cast("string")
    slim = docs.select(F.col(id_col).alias("doc_id"), lang.alias("lang"), F.col(text_col).cast("string").alias("text"))
    total = slim.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first().b
    chunks = max(1, -(-total // chunk_bytes))
    # The row number spreads rows that repeat; every use below reads this one shuffle.
    salt = F.xxhash64("doc_id", "text", F.monotonically_increasing_id())
    kind = slim.schema["doc_id"].dataType.simpleString()
    placed = slim.withColumn("chunk", F.pmod(salt, F.lit(chunks)).cast("int"))
    dealt = placed.mapInArrow(_packed, f"doc_id {kind}, lang string, text binary, chunk int").repartition(chunks, "chunk")
    counted = _counter(("chunk", "lang"))
    grams = dealt.mapInArrow(lambda batches: counted(_unpacked(batches)), "chunk int, lang string, context long, symbol int, n long")
    grams = grams.select("chunk", F.coalesce("lang", F.lit(_POOLED)).alias("lang"), "context", "symbol")
    own = materialise(model[1].select("model").distinct().select(F.col("model").alias("lang"), "model"), "models")
    # An n-gram takes the numbers of its chunks along, in lists of bounded length, so that its cost comes back without a join.
    block = F.floor(F.col("chunk") / LISTED_CHUNKS).alias("block")
    needed = grams.groupBy("lang", "context", "symbol", block).agg(F.collect_list("chunk").alias("chunks"))
    needed = needed.hint("merge").join(sized(own, MOST_ROWS), "lang", "left").withColumn("model", F.coalesce("model", F.lit(_POOLED)))
    known = costs(needed, model).select(F.explode("chunks").alias("chunk"), "lang", "context", "symbol", F.col("cost").cast("float").alias("cost"))
    return dealt.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(_summed, f"doc_id {kind}, lang string, cost double, n long, runs array<int>")


def _limit(known: DataFrame, name: str, quantile: float, bins: int) -> DataFrame:
    """(model, most): the bound of ``name`` under which the share ``quantile`` of each model's rows lies, and that of all rows
    under null; from exact counts in narrow bins."""
    own = known.select("model", F.floor(F.col(name) * bins).alias("bin"))
    counts = own.unionByName(own.withColumn("model", F.lit(None).cast("string"))).groupBy("model", "bin").agg(F.count("*").alias("n"))
    part = Window.partitionBy("model")  # a row for each bin that a held-out text falls into
    ranked = counts.withColumn("upto", F.sum("n").over(part.orderBy("bin"))).withColumn("all", F.sum("n").over(part))
    return ranked.where(F.col("upto") >= F.col("all") * quantile).groupBy("model").agg(((F.min("bin") + 1) / bins).alias(f"most_{name}"))


def _rates(known: DataFrame) -> DataFrame:
    """(model, bound, rate): the first bound that the texts of a model go over once in EVERY characters or less, and how often
    they do; one time is the least that is taken. Under null for all rows."""
    sums = known.select("model", "n", F.posexplode("runs").alias("bound", "runs")).groupBy("model", "bound").agg(F.sum("runs").alias("runs"), F.sum("n").alias("n"))
    every = sums.unionByName(sums.groupBy("bound").agg(F.sum("runs").alias("runs"), F.sum("n").alias("n")).withColumn("model", F.lit(None).cast("string")))
    rare = (F.col("runs") * EVERY <= F.col("n")) | (F.col("bound") == len(BOUNDS) - 1)
    return every.where(rare).groupBy("model").agg(F.min(F.struct("bound", (F.greatest("runs", F.lit(1)) / F.col("n")).alias("rate"))).alias("r")).select("model", "r.*")


def _of_model(rows: DataFrame, known: DataFrame, columns: list[str], what: str) -> DataFrame:
    """``rows`` (model and others) with the columns of their model, or of all models where theirs has none."""
    known = materialise(known, what)
    own = known.where("model IS NOT NULL").select(F.col("model").alias("m"), *columns)
    pooled = known.where("model IS NULL").first()
    out = rows.hint("merge").join(sized(own, MOST_ROWS), F.col("model") == F.col("m"), "left").drop("m")
    return out.withColumns({c: F.coalesce(c, F.lit(pooled[c] if pooled else None).cast(known.schema[c].dataType)) for c in columns})


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per document: doc_id, lang, perplexity, burst, their thresholds and keep. ``labels``: doc_id, quality, toxic. A
    fifth of the trusted documents, by the CRC-32 of their id, is held out of the training and gives the thresholds."""
    good = labels.groupBy(F.col("doc_id").alias("__label_id")).agg(F.min((F.coalesce(F.col("quality"), F.lit(0)) == 1) & (F.coalesce(F.col("toxic"), F.lit(1)) == 0)).alias("ok")).where("ok").select("__label_id")
    held = F.crc32(F.col("__label_id").cast("string").cast("binary")) % 5 == 0
    good = materialise(good.where("__label_id IS NOT NULL").withColumn("__held_out", held), "trusted-ids")
    trained = good.where("NOT __held_out")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    trusted = texts.hint("shuffle_hash").join(sized(trained, MOST_IDS, "shuffle_hash"), texts["doc_id"] == F.col("__label_id"), "left_semi")
    model = kneser_ney(gram_counts(trusted.select("lang", "text")))
    scored = materialise(score(docs, model, id_col, text_col, lang_col, chunk_bytes), "perplexities")
    some = not good.where("__held_out").isEmpty()
    judges = good.where("__held_out") if some else good
    scored = scored.withColumn("model", F.coalesce("lang", F.lit(_POOLED)))
    held = scored.where("cost IS NOT NULL").hint("merge").join(judges.hint("merge"), scored["doc_id"] == F.col("__label_id"), "left_semi")
    expected = F.col("rate") * F.col("n")
    measured = _of_model(scored, _rates(held), ["bound", "rate"], "rates").withColumn("burst", (F.get("runs", F.col("bound")) - expected) / F.sqrt(expected)).drop("runs")
    measured = materialise(measured, "bursts")
    held = materialise(measured.where("cost IS NOT NULL").hint("merge").join(judges.hint("merge"), measured["doc_id"] == F.col("__label_id"), "left_semi"), "judging-texts")
    out = _of_model(measured, _limit(held, "cost", quantile, _COST_BINS), ["most_cost"], "cost-thresholds")
    out = _of_model(out, _limit(held, "burst", quantile, _BURST_BINS), ["most_burst"], "burst-thresholds")
    keep = F.coalesce((F.col("cost") <= F.col("most_cost")) & (F.col("burst") <= F.col("most_burst")), F.lit(False))
    return out.select("doc_id", "lang", F.exp("cost").alias("perplexity"), "burst", F.exp("most_cost").alias("threshold"), F.col("most_burst").alias("burst_threshold"), keep.alias("keep"))


def op9_quality(spark, sf_dir):
    """Perplexity of every document against the trusted text of its language, and whether it passes."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
