"""Language identification by compression: a text is compressed against raw-content zstandard dictionaries of each language, and
the language whose dictionaries make it smallest is chosen. The first look takes all of a language's passages as one
dictionary. If the two best sizes lie close together, a second look takes the same passages as PARTS small dictionaries and
adds up the sizes behind each, which tells languages apart by less than a byte a text. Both looks are the same for a text of
any length: it is compressed over its whole length, in even blocks, each behind the dictionary, so a margin does not shrink as
a text grows.

What a dictionary saves is measured against the size without any: a text is rejected, but keeps its best guess, if the best
dictionary saves nothing, or if the second best saves nearly as much.

A language's passages are those of at most SAMPLE_TEXTS distinct labelled texts, chosen by a hash, so copies count once and no
language is lost among others; each is of at most SAMPLE_CHARS characters, from a place in the text that the hash gives.

Defined results: a null text or one without letters is ``und`` with score 0 and is rejected. Repeated rows get a row each. A
document with a null id is not held out, but not learned from either. If there is nothing to learn from, every text is ``und``.
If one language is known, every text with letters is in it. Ties go to the language with most training texts, then by name. An
empty table gives no rows. Other columns of the input are never looked at, and are kept where a function returns documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import in_slices, table, worker_cache

SAMPLE_TEXTS = 240
SAMPLE_CHARS = 600
LEVEL = 5
#: The best two sizes are close below this share of the second; then the second look decides, with so many dictionaries.
CLOSE, PARTS = 0.05, 16
#: A longer text is compressed in even blocks of at most so many bytes.
BLOCK_BYTES = 8192
#: Rejected if the best saves no more of the size without a dictionary than HELP, or if its lead over the second is less than
#: NARROW of what it saves.
HELP, NARROW = 0.0, 0.2

UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")


def is_held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", sample_texts: int = SAMPLE_TEXTS, sample_chars: int = SAMPLE_CHARS) -> list[tuple[str, list[str]]]:
    """(language, passages), the language with most texts first. What reaches the driver is the bounded sample."""
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang IS NOT NULL AND text IS NOT NULL AND text <> ''")
    hashes = rows.withColumn("h", F.xxhash64("text"))
    each = hashes.groupBy("lang", "h").agg(F.count("*").alias("n")).groupBy("lang").agg(F.sum("n").alias("n"), F.count("*").alias("texts")).collect()
    slots = 1 << 30
    least = F.lit(slots)
    for r in each:  # about eight times the sample of each language goes on to the ranking
        least = F.when(F.col("lang") == r.lang, F.lit(min(slots, int(slots * 8 * sample_texts / r.texts) + 1))).otherwise(least)
    room = F.greatest(F.length("text") - sample_chars + 1, F.lit(1))
    passage = F.substring(F.col("text"), (F.pmod(F.xxhash64("h", F.lit("place")), room) + 1).cast("int"), F.lit(sample_chars))
    distinct = hashes.where(F.pmod("h", F.lit(slots)) < least).groupBy("lang", "h").agg(F.min(passage).alias("passage"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("h"), "h")
    picked = distinct.withColumn("k", F.row_number().over(order)).where(F.col("k") <= sample_texts).orderBy("lang", "k").collect()
    passages: dict[str, list[str]] = {}
    for r in picked:
        passages.setdefault(r.lang, []).append(r.passage.lower())
    return [(r.lang, passages[r.lang]) for r in sorted(each, key=lambda r: (-r.n, r.lang))]


class Compressors:
    """The dictionaries of each language: its passages as one, and dealt over several."""

    def __init__(self, model: list[tuple[str, list[str]]], parts: int = PARTS):
        import zstandard

        self.langs = [lang for lang, _ in model]
        self.plain = zstandard.ZstdCompressor(level=LEVEL, write_checksum=False, write_content_size=False)

        def behind(passages: list[str]):
            content = "\n".join(passages).encode("utf-8", "replace")
            if len(content) < 8:  # zstandard takes no shorter one
                return self.plain
            made = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            made.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(level=LEVEL, dict_data=made, write_checksum=False, write_content_size=False, write_dict_id=False)

        self.whole = [[behind(passages)] for _, passages in model]
        self.dealt = [[behind(passages[k::parts]) for k in range(min(parts, len(passages)))] for _, passages in model]

    def sizes(self, text: bytes, dealt: bool = False) -> list[float]:
        """The sizes behind each language's dictionaries, on average over them, and last the one without any."""
        step = -(-len(text) // -(-len(text) // BLOCK_BYTES))
        blocks = [text[k : k + step] for k in range(0, len(text), step)]
        looks = [*(self.dealt if dealt else self.whole), [self.plain]]
        return [sum(len(c.compress(b)) for c in own for b in blocks) / len(own) for own in looks]

    def classify(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, accepted); the score is the margin of the best size as a share of the second best."""
        if not text or not self.langs or not _LETTER.search(text):
            return UNKNOWN, 0.0, False
        raw = text.lower().encode("utf-8", "replace")
        if len(self.langs) == 1:
            return self.langs[0], 1.0, True
        best, margin, clear = _best(self.sizes(raw))
        if margin < CLOSE:
            best, margin, clear = _best(self.sizes(raw, dealt=True))
        return self.langs[best], margin, clear


def _best(sizes: list[float]) -> tuple[int, float, bool]:
    """The smallest size, how much smaller it is than the second, as a share of that, and whether the language is clear. The
    last of ``sizes`` is the one without a dictionary."""
    *own, plain = sizes
    order = sorted(range(len(own)), key=lambda k: (own[k], k))
    best, second = own[order[0]], max(own[order[1]], 1e-9)
    saved = plain - best
    return order[0], min(1.0, max(0.0, (second - best) / second)), saved > HELP * plain and second - best >= NARROW * saved


def _compressors(model) -> Compressors:
    cache = worker_cache("langid")
    known = cache.get("model")
    if known is None or known[0] != model.value:
        known = cache["model"] = (model.value, Compressors(model.value))
    return known[1]


def identify(docs: DataFrame, model: list[tuple[str, list[str]]], text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of ``keep``, then lang_pred, score (0 to 1) and accepted (false: rejected)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample
    slim = docs.select(*keep, F.col(text_col).cast("string").alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _compressors(shared)
        for batch in in_slices(batches):
            rows = [judge.classify(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            made = [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2] for r in rows], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], [*batch.schema.names[:-1], "lang_pred", "score", "accepted"])

    return slim.mapInArrow(run, f"{fields}, lang_pred string, score double, accepted boolean")


def accepted_only(docs: DataFrame, model: list[tuple[str, list[str]]], text_col: str = "text") -> DataFrame:
    """``docs`` with all its columns, without the rows that are rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _compressors(shared)
        for batch in in_slices(batches):
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            yield batch.filter(pa.array([judge.classify(t)[2] for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op7_language(spark, sf_dir):
    """Language of every document, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.where(~F.coalesce(is_held_out(F.col("doc_id")), F.lit(True))).select("text", "lang"))
    return identify(docs.withColumn("held_out", F.coalesce(is_held_out(F.col("doc_id")), F.lit(False))), model, keep=("doc_id", "held_out"))
