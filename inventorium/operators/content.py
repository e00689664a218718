"""Descriptions of documents from their extracted text."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as X


#: Characters of a boilerplate line at most, and how many of them a description shows.
LINE_CHARS, SHOWN_LINES = 150, 2
# The labels of a description, in their order.
LABELS = ("Titre interne", "Titre (contenu)", "Mots-clés", "Mots du contenu", "Sujet", "En-tête/pied de page", "Extrait")
#: The same labels, those whose parts cost least first.
BY_COST = ("Titre interne", "Mots-clés", "Sujet", "Titre (contenu)", "En-tête/pied de page", "Extrait", "Mots du contenu")


def _counted(values: Column) -> Column:
    """(value, n) of the values of an array, inside the row: sorted, so that equal ones are neighbours."""

    def ends_of(w: Column) -> Column:
        last = F.transform(w, lambda v, i: F.when(F.coalesce(F.get(w, i + 1) != v, F.lit(True)), i + 1))
        return X.let(F.filter(last, lambda i: i.isNotNull()), lambda ends: runs(w, ends))

    def runs(w: Column, ends: Column) -> Column:
        return F.transform(ends, lambda e, i: F.struct(F.get(w, e - 1).alias("value"), (e - F.when(i > 0, F.get(ends, i - 1)).otherwise(0)).alias("n")))

    return X.let(F.sort_array(values), ends_of)


def keywords_of(text: Column, k: int = 6) -> Column:
    """(word, n) of the k most frequent words of three letters or more that occur twice or more, stop words left out, ties by
    word."""
    found = F.regexp_extract_all(X.redact_emails(X.text(text)), F.lit("[A-Za-zÀ-ÖØ-öø-ÿ]{3,}"), F.lit(0))
    # stop words are looked for among the distinct words that repeat, not among all
    often = F.filter(_counted(F.transform(found, F.lower)), lambda x: (x["n"] >= 2) & ~x["value"].isin(*X.STOP_WORDS, *X.PLACEHOLDER_WORDS))
    ranked = F.array_sort(F.transform(often, lambda x: F.struct((-x["n"]).alias("less"), x["value"].alias("word"), x["n"].alias("n"))))
    return F.transform(F.slice(ranked, 1, k), lambda x: F.struct(x["word"].alias("word"), x["n"].alias("n")))


def recurring_keywords(docs: DataFrame, k: int = 6) -> DataFrame:
    """(doc_id, word, n, rank) of the recurring words of each text; counted inside the row, so nothing is shuffled."""
    found = docs.select("doc_id", F.posexplode(keywords_of(F.col("text"), k)).alias("at", "x"))
    return found.select("doc_id", "x.word", F.col("x.n").cast("long").alias("n"), (F.col("at") + 1).alias("rank"))


def _lines(section: Column) -> Column:
    return F.split(X.text(section), r"\r?\n")


def boilerplate_of(sections: Column) -> Column:
    """The clean lines that stand in two of the sections or more, those longer than LINE_CHARS left out. One section alone has
    none."""
    own = F.transform(sections, lambda s: F.array_distinct(F.filter(F.transform(_lines(s), X.clean), lambda x: (x != "") & (F.length(x) <= LINE_CHARS))))
    found = F.transform(F.filter(_counted(F.flatten(own)), lambda x: x["n"] >= 2), lambda x: x["value"])
    return F.when(F.size(sections) > 1, found).otherwise(F.array().cast("array<string>"))


def boilerplate_lines(sections: DataFrame, min_n: int = 2, most: int = 150) -> DataFrame:
    """(doc_id, line, n): clean lines of at most 150 characters that stand in two sections of a document or more."""
    lines = sections.select("doc_id", "section", F.explode(F.split(X.text(F.col("text")), r"\r?\n")).alias("raw")).select("doc_id", "section", X.clean(F.col("raw")).alias("line"))
    kept = lines.where((F.length("line") > 0) & (F.length("line") <= most)).distinct()
    return kept.groupBy("doc_id", "line").agg(F.count("*").alias("n")).where(F.col("n") >= min_n)


def sample_positions(n: Column, want: int = 3, around: int = 0) -> Column:
    """First, middle and last of 0..n-1 (all if there are no more than three), each widened by its neighbours."""
    n = n.cast("int")
    anchors = F.when(n <= 0, F.array().cast("array<int>")).when(n <= want, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).otherwise(F.array(F.lit(0), F.floor(n / 2).cast("int"), n - 1))
    if not around:
        return F.array_distinct(anchors)
    wide = F.flatten(F.transform(anchors, lambda a: F.sequence(F.greatest(F.lit(0), a - around), F.greatest(F.lit(0), F.least(n - 1, a + around)))))
    return F.array_sort(F.array_distinct(wide))


def _body(section: Column, repeated: Column) -> Column:
    """A section without the lines that recur."""
    own = F.filter(_lines(section), lambda x: ~F.array_contains(repeated, X.clean(x)))
    return F.when(F.size(repeated) > 0, F.array_join(own, "\n")).otherwise(F.replace(X.text(section), F.lit("\r\n"), F.lit("\n")))


def _judged(docs: DataFrame, overwrite: bool, k: int, known: Callable[[Column], Column], made_of: Callable[[tuple[Column, ...]], Column]) -> Column:
    """What ``known`` makes of the status of a document whose text tells nothing, and ``made_of`` of the parts of a
    description, in the order of LABELS."""
    has = set(docs.columns)
    sections = F.col("sections") if "sections" in has else F.split(X.text(F.col("text")), "\f")

    def given(name: str) -> Column:
        return X.clean(F.col(name)) if name in has else F.lit("")

    def title(bodies: Column) -> Column:
        written = F.filter(F.flatten(F.transform(bodies, _lines)), lambda x: x.rlike(r"\S"))
        candidates = F.transform(F.slice(written, 1, 1), lambda x: F.struct(X.clean(x).alias("text"), F.lit("position").alias("style")))
        if "headings" in has:
            candidates = F.concat(F.transform("headings", lambda h: F.struct(h["text"].alias("text"), h["style"].alias("style"))), candidates)
        return X.pick_title(candidates, F.col("path"))

    def parts(repeated: Column, bodies: Column) -> Column:
        shown = F.array_sort(F.transform(repeated, lambda x: F.struct(F.length(x).alias("size"), x.alias("line"))))
        snippet = F.coalesce(F.try_element_at(F.filter(F.transform(bodies, lambda s: X.snippet(s)), lambda x: x != ""), F.lit(1)), F.lit(""))
        words = F.array_join(F.transform(keywords_of(F.array_join(bodies, "\n"), k), lambda x: x["word"]), ", ")
        values = (
            X.let(given("title"), lambda t: F.when(~X.noise_title(t, F.col("path")), t)),
            title(bodies),
            given("keywords"),
            words,
            given("subject"),
            F.array_join(F.transform(F.slice(shown, 1, SHOWN_LINES), lambda x: x["line"]), " · "),
            snippet,
        )
        return made_of(values)

    def read(s: Column) -> Column:
        return F.transform(sample_positions(F.size(s)), lambda i: F.get(s, i))

    def made(r: Column) -> Column:
        return X.let(boilerplate_of(r), lambda repeated: X.let(F.transform(r, lambda s: _body(s, repeated)), lambda bodies: parts(repeated, bodies)))

    def examined(s: Column) -> Column:
        return F.when(F.forall(s, lambda x: X.text(x) == ""), known(F.lit("missing"))).otherwise(X.let(read(s), made))

    keep = F.trim(X.text(F.col("description"))) != "" if not overwrite else F.lit(False)
    failed = F.trim(X.text(F.col("error"))) != "" if "error" in has else F.lit(False)
    other = ~F.coalesce(F.col("supported"), F.lit(True)) if "supported" in has else F.lit(False)
    status = F.when(keep, F.lit("already")).when(other, F.lit("unsupported")).when(failed, F.lit("error"))
    return F.when(status.isNotNull(), known(status)).otherwise(X.let(sections, examined))


def describe(docs: DataFrame, overwrite: bool = False, k: int = 6) -> DataFrame:
    """(doc_id, description, status) of documents (doc_id, path, text or sections, description).

    Optional columns: ``title``, ``keywords`` and ``subject`` from a file's properties, ``headings`` (candidates for a title
    with their styles, as structs of text and style), ``error`` and ``supported``. Of the sections (a text is cut at form
    feeds) the first, middle and last are read. Lines that recur between them are shown once and left out of the rest. An
    existing description is kept unless ``overwrite``, and its text is not read. Everything happens inside the row, and each
    part of a description is worked out once: what several others need is bound by ``let``, since Spark would put a column's
    expression wherever its name stands."""

    def result(description: Column, status: Column) -> Column:
        return F.struct(description.alias("description"), status.alias("status"))

    def enriched(made: Column) -> Column:
        return F.when(made == "", result(F.col("description"), F.lit("no_text"))).otherwise(result(made, F.lit("enriched")))

    def made_of(values: tuple[Column, ...]) -> Column:
        return X.let(X.format_description(list(zip(LABELS, values, strict=True))), enriched)

    found = _judged(docs, overwrite, k, lambda status: result(F.col("description"), status), made_of)
    return docs.select("doc_id", F.inline(F.array(found)))


def statuses(docs: DataFrame, overwrite: bool = False, k: int = 6) -> DataFrame:
    """(doc_id, status) as of ``describe``. A text is enriched if any part of its description is not empty, so the parts are
    tried one after the other, those that cost least first, and no description is put together."""

    def made_of(values: tuple[Column, ...]) -> Column:
        by_label = dict(zip(LABELS, values, strict=True))
        some = [X.text(by_label[label]) != "" for label in BY_COST]
        return F.when(reduce(or_, some), F.lit("enriched")).otherwise(F.lit("no_text"))

    return docs.select("doc_id", _judged(docs, overwrite, k, lambda status: status, made_of).alias("status"))
