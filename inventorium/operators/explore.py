"""Exact exploration queries: structured filters, search, counts, distributions, frequent terms, samples and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as X
from ..session import sized
from .hierarchy import By, items

FILTER_KEYS = ("keywords", "extension", "folder", "year_min", "year_max")
PAGE_SIZE, MAX_BUCKETS, MAX_TERMS, MAX_SAMPLE = 20, 20, 50, 20
#: Rows of a holding, from its first one, that a window finds without gathering the holding in one task.
FRONT_ROWS = 1_000


def checked_filter(spec: dict | None) -> dict:
    """The filter, or a ValueError if a key or type is wrong; needs no session."""
    spec = spec or {}
    words = spec.get("keywords")
    if unknown := sorted(set(spec) - set(FILTER_KEYS)):
        raise ValueError(f"unknown filter keys {unknown}; keys are {list(FILTER_KEYS)}")
    if words and not isinstance(words, str) and (not isinstance(words, list) or not all(isinstance(w, str) for w in words)):
        raise ValueError("keywords must be strings")
    for key in ("extension", "folder"):
        if spec.get(key) and not isinstance(spec[key], str):
            raise ValueError(f"{key} must be a string")
    for key in ("year_min", "year_max"):
        if spec.get(key) is not None and (not isinstance(spec[key], int) or isinstance(spec[key], bool)):
            raise ValueError(f"{key} must be a year")
    return spec


def structured_filter(spec: dict | None) -> Column:
    """The predicate of a filter; raises ValueError before any job if a key or type is wrong."""
    out = F.lit(True)
    spec = checked_filter(spec)
    words = spec.get("keywords")
    words = [words] if isinstance(words, str) else words
    if words:
        hay = X.fold(F.concat_ws(" ", X.text(F.col("path")), X.text(F.col("title"))))
        for w in words:
            out = out & F.contains(hay, X.fold(F.lit(w)))
    if ext := spec.get("extension"):
        out = out & (X.extension(F.col("path")) == X.fold(F.lit(ext.lstrip("."))))
    if folder := spec.get("folder"):
        if folder.strip("/") not in ("", "."):
            out = out & F.startswith(X.fold(F.col("path")), F.concat(X.fold(F.lit(folder.strip("/"))), F.lit("/")))
    for key, bound in (("year_min", spec.get("year_min")), ("year_max", spec.get("year_max"))):
        if bound is not None:
            own = X.year(F.col("start_date")).cast("int")
            out = out & F.coalesce(own >= bound if key == "year_min" else own <= bound, F.lit(False))
    return out


def filter_items(inv: DataFrame, spec: dict | None = None) -> DataFrame:
    return items(inv).where(structured_filter(spec))


def result_row(rows: DataFrame, by: By = ()) -> DataFrame:
    """path, title, kind, date: how every search shows a row."""
    return rows.select(*by, "path", "title", F.when(F.col("level") == "Item", "file").otherwise("folder").alias("kind"), F.col("start_date").alias("date"))


def keyword_search(inv: DataFrame, words: str | list[str], by: By = ()) -> DataFrame:
    """Folders and Items, without the root, whose path or title has all words."""
    words = words.split() if isinstance(words, str) else words
    return result_row(inv.where((F.col("path") != ".") & structured_filter({"keywords": words})), by)


def tree_search(inv: DataFrame, query: str, by: By = ()) -> DataFrame:
    """(path, matched): nodes that match themselves, and those with a match below them."""
    hit = inv.where((F.col("path") != ".") & structured_filter({"keywords": [query]})).select(*by, "path").distinct()
    above = hit.select(*by, F.explode(X.ancestor_paths(F.col("path"))).alias("path")).distinct()
    return hit.withColumn("matched", F.lit(True)).unionByName(above.hint("merge").join(hit.hint("merge"), [*by, "path"], "left_anti").withColumn("matched", F.lit(False)))


def exclude_noise_names(rows: DataFrame) -> DataFrame:
    return rows.where(~X.is_hidden_or_noise(F.col("path")))


def _of_holding(rows: DataFrame, facts: DataFrame, by: By) -> DataFrame:
    """``rows`` with the facts of their holding; rows without a holding are one of their own."""
    known = facts.withColumnsRenamed({k: f"__{k}" for k in by})
    return rows.join(known, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in by]).drop(*[f"__{k}" for k in by])


def paginate(rows: DataFrame, page: int = 0, size: int = PAGE_SIZE, by: By = ()) -> DataFrame:
    """Rows of a page in input order, with total and pages; a page beyond the end is an error that tells the totals. Of many
    holdings (``by``) each gives its own page, and those with fewer pages give none."""
    page = max(0, page)
    if by:
        totals = rows.groupBy(*by).agg(F.count("*").alias("total"))
        pages = F.greatest(F.ceil(F.col("total") / size), F.lit(1)).cast("int")
        end = F.col("__nth") <= (page + 1) * size
        if (page + 1) * size <= FRONT_ROWS:  # Spark keeps so many rows of a holding in each task before the shuffle
            placed = rows.withColumn("__nth", F.row_number().over(Window.partitionBy(*by).orderBy("pos", "path"))).where(end)
        else:  # numbered over all holdings, less the rows of the holdings before
            numbered = number_rows(rows, [*by, "pos", "path"], "__nth")
            first = numbered.groupBy(*by).agg(F.min("__nth").alias("__first"))
            placed = _of_holding(numbered, sized(first, MOST_HOLDINGS), by).withColumn("__nth", F.col("__nth") - F.col("__first") + 1).drop("__first").where(end)
        shown = placed.where(F.col("__nth") > page * size).drop("__nth")
        return _of_holding(shown.hint("merge"), totals.hint("merge"), by).withColumn("pages", pages)
    total = rows.count()
    pages = max(1, -(-total // size))
    if page >= pages:
        raise ValueError(f"page {page} of {pages}; {total} rows")
    return rows.orderBy("pos", "path").offset(page * size).limit(size).withColumns({"total": F.lit(total), "pages": F.lit(pages)})


def most(counts: DataFrame, key: str, k: int, by: By) -> DataFrame:
    """The k rows of each holding with the greatest n, ties by key."""
    if not by:
        return counts.orderBy(F.desc("n"), key).limit(k)
    order = Window.partitionBy(*by).orderBy(F.desc("n"), key)
    return counts.withColumn("__k", F.row_number().over(order)).where(F.col("__k") <= k).drop("__k")


def beside(rows: DataFrame, totals: DataFrame, by: By) -> DataFrame:
    """``rows`` with the totals of their holding."""
    return rows.hint("merge").join(totals.hint("merge"), list(by)) if by else rows.crossJoin(F.broadcast(totals))  # one row


#: Holdings whose totals are broadcast to rows; more are joined by a shuffle.
MOST_HOLDINGS = 100_000


def with_holding(rows: DataFrame, totals: DataFrame, by: By) -> DataFrame:
    """``rows``, which are many, with what is known of their holding; without ``by`` that is one row."""
    return rows.join(sized(totals, MOST_HOLDINGS), list(by), "left") if by else rows.crossJoin(F.broadcast(totals))


def topk(rows: DataFrame, key: str, k: int, by: By = ()) -> DataFrame:
    """(key, n): most frequent first, ties by key."""
    return most(rows.groupBy(*by, key).agg(F.count("*").alias("n")), key, k, by)


def count_items(inv: DataFrame, spec: dict | None = None, k: int = 5, by: By = ()) -> DataFrame:
    """(extension, n, total): the exact total beside the most frequent extensions."""
    found = filter_items(inv, spec).select(*by, X.extension(F.col("path")).alias("extension"))
    counts = found.groupBy(*by, "extension").agg(F.count("*").alias("n"))
    return beside(most(counts, "extension", k, by), counts.groupBy(*by).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total")), by)


DIMENSIONS = {
    "extension": lambda: F.when(X.extension(F.col("path")) == "", "(sans extension)").otherwise(X.extension(F.col("path"))),
    "year": lambda: F.coalesce(X.year(F.col("start_date")), F.lit("(sans date)")),
    "folder": lambda: F.when(X.first_segment(F.col("path")) == "", "(racine)").otherwise(X.first_segment(F.col("path"))),
}


def stats_by(inv: DataFrame, dim: str, spec: dict | None = None, max_buckets: int = MAX_BUCKETS, by: By = ()) -> DataFrame:
    """(value, n): the most frequent values, and what is left as (autres)."""
    if dim not in DIMENSIONS:
        raise ValueError(f"dimension must be one of {sorted(DIMENSIONS)}")
    counts = filter_items(inv, spec).groupBy(*by, DIMENSIONS[dim]().alias("value")).agg(F.count("*").alias("n"))
    top = most(counts, "value", max_buckets, by)
    left = counts.groupBy(*by).agg(F.sum("n").alias("n")).unionByName(top.select(*by, (-F.col("n")).alias("n"))).groupBy(*by).agg(F.sum("n").alias("n"))
    return top.unionByName(left.where("n > 0").withColumn("value", F.lit("(autres)")))


def terms(path: Column, title: Column) -> Column:
    """The distinct folded words of three letters or more in a path and title, without extensions and stop words."""

    def bare(c: Column) -> Column:
        return F.when(X.extension(c) != "", F.regexp_replace(c, r"\.[^.]*$", "")).otherwise(X.text(c))

    found = F.regexp_extract_all(F.concat_ws(" ", X.fold(bare(path)), X.fold(bare(title))), F.lit(r"\p{L}{3,}"), F.lit(0))
    import unicodedata

    folded = sorted({"".join(ch for ch in unicodedata.normalize("NFD", w) if not unicodedata.combining(ch)) for w in X.STOP_WORDS})
    return F.array_except(F.array_distinct(found), F.array(*[F.lit(w) for w in folded]))


def frequent_terms(inv: DataFrame, spec: dict | None = None, n: int = 20, by: By = ()) -> DataFrame:
    """(term, n, distinct_terms): in how many files a term occurs."""
    each = filter_items(inv, spec).select(*by, F.explode(terms(F.col("path"), F.col("title"))).alias("term"))
    counts = each.groupBy(*by, "term").agg(F.count("*").alias("n"))
    return beside(most(counts, "term", min(n, MAX_TERMS), by), counts.groupBy(*by).agg(F.count("*").alias("distinct_terms")), by)


def even_sample(inv: DataFrame, spec: dict | None = None, n: int = 5, by: By = ()) -> DataFrame:
    """Rows at floor(i * total / n) in input order, i < n <= 20; all if there are no more than n; of each holding.

    Positions come from a sort by range and counts of its partitions, so no task sees all rows.
    """
    n = max(1, min(n, MAX_SAMPLE))
    numbered = number_rows(filter_items(inv, spec), ["pos", "path"], "nth", by)
    total = numbered.groupBy(*by).agg(F.count("*").alias("total"))
    places = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(i * F.col("total") / n))
    every = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("total") - 1, F.lit(0)))
    wanted = total.select(*by, "total", F.explode(F.when(F.col("total") <= n, every).otherwise(places)).alias("nth"))
    placed = numbered.withColumn("nth", F.col("nth") - 1)
    # without holdings, at most n rows
    return placed.join(sized(wanted, MAX_SAMPLE * MOST_HOLDINGS) if by else F.broadcast(wanted), [*by, "nth"])


def number_rows(rows: DataFrame, order: list[str], name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """1..N in the given order. Rows of one holding (``by``) are numbered in a window; a whole table is sorted by range, and
    each partition's numbers start after the counts of those before it, so that no task holds all rows."""
    if by:
        return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))
    from ..session import materialise

    part, nth = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)  # the identifier's own layout
    parts = materialise(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "numbered")
    counts = parts.groupBy(part.alias("__part")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("__part", before.alias("__before"))
    # one row for each partition of the sort
    return parts.join(F.broadcast(starts), part == F.col("__part")).withColumn(name, (nth + F.col("__before") + 1).cast("long")).drop("__at", "__part", "__before")
