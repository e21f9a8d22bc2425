"""Benchmark decontamination: templates of benchmark items are looked for in documents, whatever their numbers and names.

Texts become tokens: words and numbers. In a template numbers, names (capitalised words inside a sentence) and units
(after a number) are typed placeholders, other words are in lower case. The templates of all windows of `WIDTH` tokens are hash-joined:
the benchmark's windows are sent to all tasks if there are at most `SENT` of them, otherwise both sides are shuffled by
the hash; the rows are the same. A match fixes a shift between item and document. For each shift the values in the slots
are compared: a value of the item has to stand for one value of the document everywhere (a re-parameterised question keeps
this, chance matches of templates do not). An item is in a document if windows of consistent shifts cover `SHARE` of its windows.

Whether a capitalised word is a name can't be told where a sentence begins, after a line break, a quote or a bracket. So every window
has two readings and matches in either: such words as literal words, as above, and as names like all capitalised ones. Read
as names, they are slots too; if their values contradict, what the first reading matched is looked at alone. A window
whose second reading has fewer than `LITERAL` words keeps its capitalised words, in their case, instead: it finds copies
to the letter, wherever they are pasted. An item also counts as found if `SHARE` of the windows are that say enough in the second reading.

Windows with fewer than `LITERAL` words that aren't placeholders say little and are left out, unless an item has no
others. Items shorter than a window are one window of their own length; items without a token match nothing. Null and empty
texts match nothing. Texts are known by a 64-bit hash: repeated documents are looked through once and reported each.
Items that share an item_id are items of their own. Other columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelspan.llm.common import free_names, written

WIDTH, LITERAL, SHARE = 8, 4, 0.5
SENT = 1_000_000  # windows, of two numbers each
# Units that may follow a number.
UNITS = "km|m|cm|mm|miles?|feet|ft|kg|g|mg|tons?|lbs?|hours?|hrs?|h|minutes?|min|seconds?|sec|s|days?|weeks?|months?|years?"
UNITS += "|dollars?|euros?|cents?|usd|eur|percent|l|liters?|litres?|ml|watts?|w|kw|volts?|v|degrees?|c|f"
NAME, UNIT, CAPITAL = "\x01", "\x02", "\x03"


def tokens(text: Column) -> Column:
    """Words and numbers in order; names, units and other capitalised words carry a sign in front."""
    marked = F.regexp_replace(text, r"(?<=[\p{Ll}\p{N},;:] )(?=\p{Lu}\p{L})", NAME)
    some = F.when(text.rlike("[0-9]"), F.regexp_replace(marked, rf"(?i)(?<=[0-9]|[0-9] )(?=(?:{UNITS})(?!\p{{L}}))", UNIT)).otherwise(marked)
    some = F.regexp_replace(some, r"(?<![\x01\x02\p{L}])(?=\p{Lu}\p{L})", CAPITAL)
    return F.regexp_extract_all(F.coalesce(some, F.lit("")), F.lit(r"[\x01-\x03]?\p{L}+|[0-9]+(?:[.,][0-9]+)*+"), F.lit(0))


def template(found: Column) -> Column:
    def one(t: Column) -> Column:
        sign = F.substr(t, F.lit(1), F.lit(1))
        kinds = F.when(sign == NAME, "<name>").when(sign == UNIT, "<unit>").when(sign.between("0", "9"), "<num>")
        return kinds.otherwise(F.lower(F.ltrim(t, F.lit(CAPITAL))))

    return F.transform(found, one)


def capitalised(t: Column) -> Column:
    return F.substr(t, F.lit(1), F.lit(1)).isin(NAME, CAPITAL)


def opened(found: Column, pattern: Column) -> Column:
    """The template with all capitalised words as names."""
    return F.zip_with(found, pattern, lambda t, kind: F.when(t.startswith(CAPITAL), "<name>").otherwise(kind))


def lettered(found: Column, pattern: Column) -> Column:
    """The template with all capitalised words as they stand."""
    return F.zip_with(found, pattern, lambda t, kind: F.when(capitalised(t), F.substr(t, F.lit(2))).otherwise(kind))


def words_in(part: Column) -> Column:
    """How many are no placeholders."""
    for kind in ("<name>", "<num>", "<unit>"):
        part = F.array_remove(part, kind)
    return F.size(part)


def hashed(found: Column, pattern: Column) -> tuple[Column, Column, Column]:
    """Hashes of the tokens as the first reading has them, with all capitalised words as names, and with those as they stand."""
    one = lambda tokens: F.transform(tokens, lambda t: F.xxhash64(t))
    return one(pattern).alias("first"), one(opened(found, pattern)).alias("names"), one(lettered(found, pattern)).alias("letters")


def readings(rows: DataFrame, *keep: str) -> DataFrame:
    """Of the windows of `width` tokens at `at` (from 0) in the columns of `hashed`: `plain`, the hash of the first reading, `second`,
    that of the second one (null if it is the first), and `enough`, whether the second one has enough words."""
    part = lambda of: F.slice(of, F.col("at") + 1, F.col("width"))
    name, *others = [F.xxhash64(F.lit(kind)) for kind in ("<name>", "<num>", "<unit>")]
    cut = rows.select(*keep, "width", "at", "letters", part("first").alias("_first"), part("names").alias("_names"))
    literal = F.col("_names")
    for kind in (name, *others):
        literal = F.array_remove(literal, kind)
    enough = F.size(literal) >= F.least(F.lit(LITERAL), F.col("width"))
    made = cut.select(*keep, "width", "at", "letters", "_first", "_names", enough.alias("enough"), F.array_contains("_names", name).alias("_named"))
    hash_ = lambda of: F.xxhash64("width", of)
    second = F.when(F.col("_named") & ~F.col("enough"), hash_(part("letters"))).when(
        F.col("_named") & (F.col("_names") != F.col("_first")), hash_(F.col("_names"))
    )
    return made.select(*keep, "width", "at", hash_(F.col("_first")).alias("plain"), second.alias("second"), "enough")


def items(benchmark: DataFrame) -> DataFrame:
    """Items with their tokens and templates, and a number of their own."""
    rows = benchmark.select("item_id", F.col("text").alias("_text")).withColumn("item", F.xxhash64("item_id", "_text"))
    made = rows.select("item_id", "item", tokens(F.col("_text")).alias("values")).dropDuplicates(["item"])
    made = made.withColumn("pattern", template(F.col("values"))).where(F.size("values") > 0)
    return made.withColumn("open", opened(F.col("values"), F.col("pattern")))


def item_windows(found: DataFrame) -> DataFrame:
    """item, width, at, reading, window, of, enough, of_enough: both readings of the windows that count, of how many, whether
    the second one says enough, and in how many it does."""
    hashes = hashed(F.col("values"), F.col("pattern"))
    sized = found.select("item", "pattern", F.least(F.size("pattern"), F.lit(WIDTH)).alias("width"), *hashes)
    rows = sized.select("*", F.explode(F.sequence(F.lit(0), F.size("pattern") - F.col("width"))).alias("at"))
    telling = words_in(F.slice("pattern", F.col("at") + 1, F.col("width"))) >= F.least(F.lit(LITERAL), F.col("width"))
    rows = readings(rows.withColumn("telling", telling), "item", "telling")
    rows = rows.select("item", "width", "at", F.array_compact(F.array("plain", "second")).alias("windows"), "telling", "enough")
    any_ = rows.groupBy("item").agg(
        F.max("telling").alias("_any"), F.count_if("telling").alias("_telling"), F.count("*").alias("_all"), F.count_if("enough").alias("of_enough")
    )
    kept = rows.join(any_, "item").where("telling OR NOT _any")
    of = F.when(F.col("_any"), F.col("_telling")).otherwise(F.col("_all")).alias("of")
    return kept.select("item", "width", "at", "enough", "of_enough", of, F.posexplode("windows").alias("reading", "window"))


def text_windows(texts: DataFrame, widths: list[int]) -> DataFrame:
    """_text, place, second, window: all windows of these widths, in both readings; a text is parsed once for all of them."""
    values = texts.select("_text", tokens(F.col("text")).alias("values")).withColumn("pattern", template(F.col("values")))
    read = values.select("_text", F.size("values").alias("count"), *hashed(F.col("values"), F.col("pattern")))
    rows = read.select("*", F.explode(F.array(*map(F.lit, widths))).alias("width"))
    # Not a filter on the size: it would be pushed down and parse every text once more.
    last = F.col("count") - F.col("width")
    rows = rows.select("*", F.explode(F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0))))).alias("at"))
    rows = readings(rows, "_text").select("_text", F.col("at").alias("place"), F.posexplode(F.array("plain", "second")).alias("second", "window"))
    return rows.where("window IS NOT NULL")


def find(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per text and item in it: _text (the text's hash), item_id, n_windows, of_windows, n_slots, changed_slots."""
    spark = documents.sparkSession
    bench = written(spark, items(benchmark), "items")
    wanted = written(spark, item_windows(bench), "item-windows")
    widths = sorted(r.width for r in wanted.select("width").distinct().collect())  # at most WIDTH numbers
    small = wanted.count() <= SENT
    texts = documents.select(F.xxhash64("text").alias("_text"), "text").where("text IS NOT NULL")
    if not widths:
        return spark.createDataFrame([], "_text bigint, item_id bigint, n_windows bigint, of_windows bigint, n_slots bigint, changed_slots bigint")
    rows = text_windows(texts, widths)
    side = wanted.select("window", "item", "width", "at", "of", "enough", "of_enough", "reading")
    found = rows.join(F.broadcast(side) if small else side, "window")
    # A shift that is matched in one place is matched along the item: one row for each shift.
    hits = found.groupBy("_text", "item", "width", (F.col("place") - F.col("at")).alias("shift")).agg(
        F.collect_set("at").alias("at"),
        F.collect_set(F.when(F.col("reading") + F.col("second") == 0, F.col("at"))).alias("plain"),
        F.collect_set(F.when(F.col("enough"), F.col("at"))).alias("enough"),
        F.first("of").alias("of"), F.first("of_enough").alias("of_enough"),
    )
    hits = written(spark, hits, "hits")

    values = texts.groupBy("_text").agg(F.first("text").alias("text"))
    values = values.join(hits.select("_text").distinct(), "_text", "leftsemi").select("_text", tokens(F.col("text")).alias("_found"))
    both = hits.join(values, "_text").join(bench.select("item", "item_id", "values", "pattern", "open"), "item")

    def pairs(pattern: str, at: str) -> Column:
        """What the slots of a template hold in the item and in the text, as far as the windows reach."""
        covered = lambda p: F.exists(at, lambda a: (a <= p) & (p < a + F.col("width")))
        slots = F.filter(
            F.sequence(F.lit(0), F.size(pattern) - 1), lambda p: F.get(F.col(pattern), p).startswith("<") & covered(p)
        )
        held = lambda t: F.when(capitalised(t), F.lower(F.substr(t, F.lit(2)))).otherwise(t)
        own, other = lambda p: held(F.get(F.col("values"), p)), lambda p: held(F.get(F.col("_found"), p + F.col("shift")))
        return F.array_distinct(F.transform(slots, lambda p: F.struct(own(p).alias("own"), other(p).alias("other"))))

    fits = lambda of: F.size(F.array_distinct(F.transform(of, lambda x: x["own"]))) == F.size(of)
    both = both.withColumns({"_all": pairs("open", "at"), "_plain": pairs("pattern", "plain")})
    both = both.withColumn("_use", F.when(fits(F.col("_all")), "all").when((F.size("plain") > 0) & fits(F.col("_plain")), "plain"))
    whole_ = F.col("_use") == "all"
    both = both.where("_use IS NOT NULL").withColumns(
        {
            "_pairs": F.when(whole_, F.col("_all")).otherwise(F.col("_plain")),
            "enough": F.when(whole_, F.col("enough")).otherwise(F.array_intersect("enough", "plain")),
            "at": F.when(whole_, F.col("at")).otherwise(F.col("plain")),
        }
    )
    whole = both.groupBy("_text", "item", "item_id").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("at")))).cast("bigint").alias("n_windows"),
        F.first("of").alias("of_windows"),
        F.max(F.size("_pairs")).cast("bigint").alias("n_slots"),
        F.min(F.size(F.filter("_pairs", lambda x: x["own"] != x["other"]))).cast("bigint").alias("changed_slots"),
        F.size(F.array_distinct(F.flatten(F.collect_list("enough")))).alias("_enough"),
        F.first("of_enough").alias("_of_enough"),
    )
    found = (F.col("n_windows") >= SHARE * F.col("of_windows")) | (
        (F.col("_of_enough") > 0) & (F.col("_enough") >= SHARE * F.col("_of_enough"))
    )
    return whole.where(found).drop("item", "_enough", "_of_enough")


def contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Pairs of document and item: doc_id, item_id, how many of the item's windows were found, and how many of its
    slots hold another value (0: word for word)."""
    found = find(documents.select("text"), benchmark)
    rows = documents.select("doc_id", F.xxhash64("text").alias("_text"))
    return rows.join(found, "_text").select("doc_id", "item_id", "n_windows", "of_windows", "n_slots", "changed_slots")


def decontaminate(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no item, with all their columns."""
    (leak,) = free_names(documents, "_leak")
    # Written first, so that its size is known when the join is planned.
    found = written(documents.sparkSession, find(documents.select("text"), benchmark).select(F.col("_text").alias(leak)).distinct(), "leaks")
    return documents.join(found, F.xxhash64("text") == F.col(leak), "leftanti")
