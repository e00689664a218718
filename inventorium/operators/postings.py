"""Many filters over one inventory at once, by bitmaps of Item numbers.

A filter is a conjunction of conditions: a word in path or title, an extension, a folder above, a range of years. Filters share
conditions, so each distinct condition looks its Items up once, in a posting list: extensions, folded folders above, years and
character grams of path and title. A word is looked up by its rarest gram and then verified; a few words are looked for as they are. Items are numbered, and what a
condition selects is kept as bitmaps of blocks of numbers. A filter's bitmaps are the conjunction of those of its conditions,
block by block, and its total is a count of bits. Nothing loops over filters: however many there are, it is one plan.

Keys that no filter asks for leave the posting lists at once, against a broadcast of checked size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..session import materialise, merged, sized
from .explore import number_rows
from .hierarchy import items

FILTER_SCHEMA = "keywords array<string>, extension string, folder string, year_min int, year_max int"
#: Distinct keys that are broadcast to the posting lists; more are joined by a shuffle.
MOST_KEYS = 200_000
#: Words that are looked for in every text: searching is dearer than grams only beyond some number of words.
FEW_WORDS = 16
#: Years have four digits.
_FIRST, _LAST = 0, 9999


def conditions(filters: DataFrame) -> DataFrame:
    """(filter, kind, value, low, high): the conditions of each filter (JSON, one column ``filter``). One without any has a
    condition that all Items meet."""
    f = F.from_json("filter", FILTER_SCHEMA)
    nothing = F.lit(None).cast("int")

    def condition(kind: str, value, low=nothing, high=nothing):
        return F.struct(F.lit(kind).alias("kind"), value.alias("value"), low.alias("low"), high.alias("high"))

    words = F.transform(F.coalesce("f.keywords", F.array().cast("array<string>")), lambda w: condition("word", X.fold(w)))
    extension = F.when(F.col("f.extension") != "", condition("extension", X.fold(F.regexp_replace("f.extension", r"^\.+", ""))))
    bare = F.regexp_replace("f.folder", "^/+|/+$", "")
    folder = F.when(~bare.isin("", "."), condition("folder", X.fold(bare)))
    years = F.coalesce("f.year_min", F.lit(_FIRST)), F.coalesce("f.year_max", F.lit(_LAST))
    year = F.when(F.coalesce("f.year_min", "f.year_max").isNotNull(), condition("year", F.lit(""), *years))
    asked = F.array_distinct(F.filter(F.concat(words, F.array(extension, folder, year)), lambda c: c.isNotNull() & ((c["kind"] != "word") | (c["value"] != ""))))
    every = F.array(condition("all", F.lit("")))
    return filters.select("filter", f.alias("f")).select("filter", F.explode(F.when(F.size(asked) > 0, asked).otherwise(every)).alias("c")).select("filter", "c.*")


def grams(text, sizes: tuple[int, ...] = (1, 2, 3)):
    """The distinct character grams of a text."""

    def of(n: int):
        return F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*map(of, sizes)))


def _by_word(numbered: DataFrame, words: DataFrame) -> DataFrame:
    """(c, n) of ``words`` (c, word). Few words are looked for in each text; of many, each only in the texts that hold its
    rarest gram."""
    if words.limit(FEW_WORDS + 1).count() <= FEW_WORDS:
        return numbered.select("n", "hay").join(F.broadcast(words), F.contains("hay", "word")).select("c", "n")
    # words by their rarest gram; one of up to three characters is its own gram
    size = F.least(F.length("word"), F.lit(3))
    parts = words.select("c", "word", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("word") - size + 1), lambda i: F.substring("word", i, size)))).alias("gram"))
    parts = materialise(parts, "word-grams")
    used = sized(parts.select("gram").distinct(), MOST_KEYS)
    lists = numbered.select("n", "hay", F.explode(grams(F.col("hay"))).alias("gram")).join(used, "gram", "left_semi")
    rarity = lists.groupBy("gram").agg(F.count("*").alias("rows"))
    best = merged(parts, rarity, "gram").groupBy("c", "word").agg(F.min_by("gram", F.struct("rows", "gram")).alias("gram"))
    found = lists.join(sized(materialise(best, "word-keys"), MOST_KEYS), "gram")
    return found.where(F.contains("hay", F.col("word"))).select("c", "n")


def _selected(numbered: DataFrame, wanted: DataFrame) -> DataFrame:
    """(c, n): the numbers of the Items that meet each condition."""

    def of(kind: str) -> DataFrame:
        return wanted.where(F.col("kind") == kind)

    own, values = numbered.select("n", "extension"), lambda kind, name: sized(of(kind).select("c", F.col("value").alias(name)), MOST_KEYS)
    by_extension = own.join(values("extension", "extension"), "extension").select("c", "n")
    above = numbered.select("n", F.explode(X.ancestor_paths(F.col("path"))).alias("folder"))
    by_folder = above.join(values("folder", "folder"), "folder").select("c", "n")
    # at most ten thousand years
    clipped = of("year").select("c", F.greatest("low", F.lit(_FIRST)).alias("low"), F.least("high", F.lit(_LAST)).alias("high"))
    spans = clipped.select("c", F.explode(F.when(F.col("low") <= F.col("high"), F.sequence("low", "high"))).alias("year"))
    dated = numbered.where("year IS NOT NULL").select("n", "year")
    present = F.broadcast(dated.select("year").distinct())  # at most ten thousand
    by_year = dated.join(sized(spans.join(present, "year", "left_semi"), MOST_KEYS), "year").select("c", "n")
    every = numbered.select("n").crossJoin(F.broadcast(of("all").select("c").limit(1))).select("c", "n")  # there is one such condition
    by_word = _by_word(numbered, materialise(of("word").select("c", F.col("value").alias("word")), "words"))
    return by_extension.unionByName(by_folder).unionByName(by_year).unionByName(every).unionByName(by_word)


def bitmaps(inv: DataFrame, filters: DataFrame) -> DataFrame:
    """(filter, block, bits): which Items each distinct filter selects; blocks without any have no row. ``filters``: a column
    ``filter`` of valid filters as JSON."""
    asked = materialise(conditions(filters.select("filter").distinct()), "filter-conditions")
    key = ["kind", "value", "low", "high"]
    wanted = materialise(asked.select(*key).distinct().withColumn("c", F.monotonically_increasing_id()), "conditions")
    hay = X.fold(F.concat_ws(" ", X.text(F.col("path")), X.text(F.col("title"))))
    slim = items(inv).select("path", "title", "start_date", "pos")
    numbered = number_rows(slim, ["pos", "path"], "n").select("n", X.extension(F.col("path")).alias("extension"), X.fold(F.col("path")).alias("path"), hay.alias("hay"), X.year(F.col("start_date")).cast("int").alias("year"))
    numbered = materialise(numbered, "numbered-items")
    selected = _selected(numbered, wanted)
    per_condition = selected.groupBy("c", F.bitmap_bucket_number("n").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("n")).alias("bits"))
    same = [F.col(f"asked.{k}").eqNullSafe(F.col(f"wanted.{k}")) for k in key]
    uses = materialise(asked.alias("asked").hint("merge").join(wanted.alias("wanted").hint("merge"), same).select("filter", "c"), "filter-uses")
    many = uses.groupBy("filter").agg(F.count("*").alias("many"))
    # a block counts where every condition of the filter has some of its bits
    both = merged(uses, per_condition, "c").groupBy("filter", "block").agg(F.bitmap_and_agg("bits").alias("bits"), F.count("*").alias("met"))
    whole = merged(both, many, "filter").where("met = many").select("filter", "block", "bits")
    return materialise(whole.where(F.bitmap_count("bits") > 0), "filter-bitmaps")


def totals(bits: DataFrame, filters: DataFrame) -> DataFrame:
    """(filter, total): how many Items each filter selects."""
    counts = bits.groupBy("filter").agg(F.sum(F.bitmap_count("bits")).alias("total"))
    return merged(filters.select("filter").distinct(), counts, "filter", "left").select("filter", F.coalesce("total", F.lit(0)).cast("long").alias("total"))


def compared(bits: DataFrame, pairs: DataFrame) -> DataFrame:
    """(first, second, only_first, only_second, both, equal) of pairs of filters: how many Items each selects. Bitmaps meet
    block by block, so a pair's work is its blocks."""
    each = pairs.select("first", "second").distinct()
    size = F.bitmap_count("bits")
    a = merged(each, bits.select(F.col("filter").alias("first"), "block", F.col("bits").alias("a")), "first")
    shared = merged(a, bits.select(F.col("filter").alias("second"), "block", F.col("bits").alias("b")), ["second", "block"])
    # the conjunction of two bitmaps, by the same aggregate as above
    either = shared.select("first", "second", "block", F.explode(F.array("a", "b")).alias("bits"))
    both = either.groupBy("first", "second", "block").agg(F.bitmap_and_agg("bits").alias("bits")).groupBy("first", "second").agg(F.sum(size).alias("both"))
    own = bits.groupBy("filter").agg(F.sum(size).alias("total"))
    out = merged(each, both, ["first", "second"], "left")
    for side in ("first", "second"):
        out = merged(out, own.withColumnsRenamed({"filter": side, "total": f"{side}_total"}), side, "left")
    n = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("both", "first_total", "second_total")}
    rows = out.select("first", "second", (n["first_total"] - n["both"]).alias("only_first"), (n["second_total"] - n["both"]).alias("only_second"), n["both"].alias("both"))
    return rows.withColumn("equal", (F.col("only_first") == 0) & (F.col("only_second") == 0))
