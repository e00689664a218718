"""Personal data by bootstrapped contextual extraction.

Patterns find the base entities: e-mail and IP addresses, payment cards and telephone numbers. They are the seeds: the words
around each of them, with the shape of what stands between, are lexical patterns. Spark then scores the graph of patterns and
instances in rounds, until no score moves: a pattern is as good as the instances that it extracts, an unknown instance as good
as its patterns.
Patterns that end with a high score and enough different seeds add the other identifiers that they extract.

Defined results: a null text is an empty one. Repeated rows get a row each, with the same spans. Spans are code points, end
exclusive; base spans are kept whatever the method adds, and added spans never overlap them. An empty table gives no rows.
Other columns of the input are never looked at, and are kept where a function returns documents.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, in_slices, materialise, sized, table, worker_cache

# The base kinds in their order, and the kind of added spans.
KINDS = ("email", "ip", "card", "phone")
LEARNED = "learned"

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")

_TOKEN = re.compile(r"\S+")
_EDGES = ".,;:!?()[]{}<>\"'|"
_LABEL = re.compile(r"(.*[:=])([^:=]+)", re.S)

#: A pattern is trusted with this score and so many different seeds; unknown identifiers have so many digits at least.
MIN_SCORE, MIN_SEEDS, MIN_DIGITS = 0.8, 5, 6
#: Scores have settled when none moves by more; they nearly halve the distance each round, and the bound only guards.
SETTLED, MOST_ROUNDS = 0.01, 20
#: Trusted patterns that are broadcast; more are joined by a shuffle.
MOST_PATTERNS = 50_000


def _passes_luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, number of the kind) of the base entities, by start and kind."""
    out = []
    done, at = 0, text.find("@")
    while at >= 0:
        first = at
        while first > done and text[first - 1] in _LOCAL:
            first -= 1
        domain = _DOMAIN.match(text, at + 1) if first < at else None
        if domain:
            done = domain.end()
            out.append((first, done, 0))
        at = text.find("@", max(done, at + 1))
    if _DIGIT.search(text):
        for m in _IP.finditer(text) if "." in text else ():
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((m.start(), m.end(), 1))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and _passes_luhn(digits):
                out.append((m.start(), m.end(), 2))
        for m in _PHONE.finditer(text) if "+" in text else ():
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), m.end(), 3))
    return sorted(out, key=lambda s: (s[0], s[2]))


def _shape(value: str) -> str:
    if "@" in value:
        return "at"
    if any(c.isalpha() for c in value):
        return "mixed"
    return "dotted" if value.count(".") >= 3 else "number"


def _short(text: str) -> str:
    """A text that is used as a name: a long one ends in its digest, so that different texts never merge."""
    return text if len(text) <= 96 else f"{text[:32]}\u2026{hashlib.sha256(text.encode('utf-8', 'replace')).hexdigest()}"


def _word(text: str) -> str:
    return _short(_DIGIT.sub("#", text.strip(_EDGES).lower()))


def _contexts(before: list[str], label: str, after: str, shape: str) -> list[str]:
    """The lexical patterns of an identifier between words: a label in front, two words before, or one on either side."""
    out = []
    if label:
        out.append(f"{shape} label {_short(label.lower())}")
    if len(before) == 2:
        out.append(f"{shape} before {before[0]} {before[1]}")
    if before and after:
        out.append(f"{shape} between {before[-1]} {after}")
    return out


def instances(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, str, str, bool]]:
    """(start, end, instance, pattern, whether it is a seed) of base entities and of unknown identifiers."""
    if not base and not _DIGIT.search(text) and "@" not in text:
        return []
    tokens = [(m.start(), m.end()) for m in _TOKEN.finditer(text)]
    taken, k = [], 0  # tokens that base spans cover, so that an entity of several tokens is one
    spots: list[tuple[int, int, int, int, bool]] = []
    for start, end, _ in base:
        while k and tokens[k - 1][1] > start:
            k -= 1
        while k < len(tokens) and tokens[k][1] <= start:
            k += 1
        last = k
        while last + 1 < len(tokens) and tokens[last + 1][0] < end:
            last += 1
        taken.append((k, last))
        spots.append((start, end, k, last, True))
    covered = {t for first, last in taken for t in range(first, last + 1)}
    for t, (start, end) in enumerate(tokens):
        if t in covered:
            continue
        token = text[start:end]
        if "@" not in token and sum(map(token.count, "0123456789")) < MIN_DIGITS:
            continue
        inner = token.strip(_EDGES)
        label = _LABEL.fullmatch(inner)
        value = (label[2] if label else inner).strip(_EDGES)
        first = start + token.rfind(value)
        if value:
            spots.append((first, first + len(value), t, t, False))
    out = []
    for start, end, first, last, seed in spots:
        value = text[start:end]
        before = [_word(text[a:b]) for a, b in tokens[max(0, first - 2) : first]]
        after = _word(text[slice(*tokens[last + 1])]) if last + 1 < len(tokens) else ""
        label = text[tokens[first][0] : start].strip("\"'([{<") if tokens else ""
        for pattern in _contexts(before, label, after, _shape(value)):
            out.append((start, end, _short(value.lower()), pattern, seed))
    return out


_SPAN = pa.struct([("start", pa.int64()), ("rank", pa.int64())] + [("end", pa.int64())])
_FOUND = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("instance", pa.string()), ("pattern", pa.string()), ("seed", pa.bool_())])
_SCAN_SCHEMA = "text_sum long, base array<struct<start:long,rank:long,end:long>>, found array<struct<start:long,end:long,instance:string,pattern:string,seed:boolean>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    worker_cache("personal_data")
    for batch in in_slices(batches):
        base, found = [], []
        for text in batch.column("text").to_pylist():
            own = base_spans(text) if text else []
            base.append([(s, k, e) for s, e, k in own])
            found.append(instances(text, own) if text else [])
        named = [[dict(zip(("start", "rank", "end"), x, strict=True)) for x in row] for row in base]
        listed = [[dict(zip(("start", "end", "instance", "pattern", "seed"), x, strict=True)) for x in row] for row in found]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_sum"), pa.array(named, pa.list_(_SPAN)), pa.array(listed, pa.list_(_FOUND))], ["doc_id", "text_sum", "base", "found"])


def trusted_patterns(edges: DataFrame, min_score: float = MIN_SCORE, min_seeds: int = MIN_SEEDS, settled: float = SETTLED, most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """(pattern, score) of the patterns that pass. ``edges``: distinct (pattern, instance, seed).

    A pattern's score is the mean of its instances' scores, shrunk by seeds / (seeds + 1); an unknown instance is worth
    1 - the product of (1 - score) over its patterns. All counts are over distinct instances, so copies add nothing.
    """
    scored = edges.withColumn("worth", F.col("seed").cast("double"))
    before = None
    for _ in range(most_rounds):
        seeds = F.sum(F.col("seed").cast("long"))
        patterns = materialise(scored.groupBy("pattern").agg((F.avg("worth") * seeds / (seeds + 1)).alias("score"), seeds.alias("seeds")), "pattern-scores")
        if before is not None:
            moved = patterns.hint("merge").join(before.hint("merge"), "pattern").where(F.abs(F.col("score") - F.col("old")) > settled)
            if moved.isEmpty():
                break
        before = patterns.select("pattern", F.col("score").alias("old"))
        both = edges.where(~F.col("seed")).hint("merge").join(patterns.select("pattern", "score").hint("merge"), "pattern")
        worth = both.groupBy("instance").agg((1 - F.exp(F.sum(F.log1p(-F.least(F.col("score"), F.lit(0.999999)))))).alias("worth"))
        worth = edges.hint("merge").join(worth.hint("merge"), "instance", "left").withColumn("worth", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("worth", F.lit(0.0))))
        scored = materialise(worth, "pattern-graph")
    return patterns.where((F.col("score") >= min_score) & (F.col("seeds") >= min_seeds)).select("pattern", "score")


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, text_sum, and spans (start, rank, end); the rank of an added span is that after the base
    kinds. The scan gives no unknown identifier from a token that a base span touches, so added spans overlap none."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("text_sum", F.xxhash64("text"))
    scanned = materialise(slim.mapInArrow(_scan, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, {_SCAN_SCHEMA}"), "personal-data")
    listed = scanned.where(F.size("found") > 0).select("doc_id", "text_sum", F.explode("found").alias("x")).select("doc_id", "text_sum", "x.*")
    edges = materialise(listed.groupBy("pattern", "instance").agg(F.max("seed").alias("seed")), "pattern-edges")
    trusted = materialise(trusted_patterns(edges), "trusted-patterns")
    added = listed.where(~F.col("seed")).hint("merge").join(sized(trusted, MOST_PATTERNS), "pattern")
    per_doc = added.groupBy("doc_id", "text_sum").agg(F.collect_set(F.struct("start", F.lit(len(KINDS)).cast("long").alias("rank"), "end")).alias("added"))
    per_doc = per_doc.select(F.col("doc_id").alias("__id"), F.col("text_sum").alias("__sum"), "added")
    both = scanned.drop("found").hint("merge").join(per_doc.hint("merge"), (scanned["text_sum"] == per_doc["__sum"]) & scanned["doc_id"].eqNullSafe(per_doc["__id"]), "left")
    none = F.array().cast("array<struct<start:bigint,rank:bigint,end:bigint>>")
    return both.select("doc_id", "text_sum", F.array_sort(F.concat("base", F.coalesce("added", none))).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the SHA-256 of their spans, and all spans as text."""
    names = F.array(*[F.lit(k) for k in (*KINDS, LEARNED)])

    def as_text(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, (s["rank"] + 1).cast("int")), s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(rank: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["rank"] == rank)).cast("long").alias(f"n_{KINDS[rank]}")

    return found.select("doc_id", *map(count, range(len(KINDS))), F.sha2(as_text(F.filter("spans", lambda s: s["rank"] < len(KINDS))), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"))


def redacted_text(text: str, spans: list[dict]) -> str:
    out, at = [], 0
    for s in spans:
        if s["start"] >= at:
            out.append(text[at : s["start"]] + f"[{(*KINDS, LEARNED)[s['rank']].upper()}]")
        at = max(at, s["end"])
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all its columns and each span replaced by its kind in brackets."""
    found = find_personal_data(docs, id_col, text_col).where(F.size("spans") > 0)
    spans = materialise(found.groupBy("doc_id", "text_sum").agg(F.first("spans").alias("spans")), "personal-spans")
    mark, own_id, own_sum = (free_name(docs, name) for name in ("__spans", "__id", "__sum"))
    there = spans.select(F.col("doc_id").alias(own_id), F.col("text_sum").alias(own_sum), F.col("spans").alias(mark))
    same = (F.xxhash64(F.col(text_col).cast("string")) == F.col(own_sum)) & F.col(id_col).eqNullSafe(F.col(own_id))
    both = docs.hint("shuffle_hash").join(there.hint("shuffle_hash"), same, "left").drop(own_id, own_sum)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            at = batch.schema.get_field_index(text_col)
            marked = batch.column(batch.schema.get_field_index(mark)).to_pylist()
            texts = batch.column(at).to_pylist()
            new = [redacted_text(t, s) if s else t for t, s in zip(texts, marked, strict=True)]
            yield batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type)).drop_columns([mark])

    return both.mapInArrow(run, docs.schema)


def op4_personal_data(spark, sf_dir):
    """Personal data in every document."""
    return digest(find_personal_data(table(spark, sf_dir, "documents")))
