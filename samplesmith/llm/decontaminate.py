"""Benchmark decontamination by templates, in DataFrame functions alone.

Texts become templates: numbers, names (capitalised words) and units turn into
typed placeholders.  Windows of five template words are hash-joined with those of
the benchmark items.  A document holds an item if it has enough of its windows and
if the placeholders' values agree: each value of the item stands for one value in
the document, and the other way round.  So an item that was copied with other
numbers or names is caught, and a chance likeness of templates is not.  The values
are compared place by place where the document holds the item's windows in the
item's order, and the best such occurrence counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samplesmith.llm.common import cut

# Unit words that may follow a number.
UNITS = ("km m cm mm kg g mg lb oz mile miles meter meters metre metres kilometer kilometers hour hours minute minutes "
         "second seconds day days week weeks month months year years dollar dollars euro euros percent degree degrees "
         "liter liters litre litres").split()
BROADCAST_ROWS = 1_000_000  # windows of all items that may be sent to every task (two numbers, an id, short strings)
JOIN = "\u0001"


def plain_words(text: Column) -> Column:
    """The text's words with punctuation gone, single spaces between."""
    return F.trim(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[^\p{L}\p{N}]+", " "))


def template(words: Column) -> Column:
    """Typed placeholders for capitalised words, numbers, and units after a number; all else in lower case."""
    out = F.lower(F.regexp_replace(words, r"(^| )\p{Lu}[^ ]*", "$1<name>"))
    out = F.regexp_replace(out, r"(^| )\p{N}[^ ]*", "$1<num>")
    return F.regexp_replace(out, rf"(?<=<num> )(?:{'|'.join(UNITS)})(?= |$)", "<unit>")


def windows(rows: DataFrame, keys: list[str], width: int, slots: bool) -> DataFrame:
    """``keys`` with ``h`` for each window of ``width`` template words, and ``place`` and ``slots`` if asked for.

    A shorter text is one window; a text without words has none.  ``slots`` joins
    the values of the window's placeholders, ``place`` is the window's first word.
    """
    plain = rows.select(*keys, plain_words(F.col("text")).alias("__p")).where("__p != ''")
    arrays = plain.select(*keys, "__p", F.split(template(F.col("__p")), " ").alias("__c"))
    c, s = F.col("__c"), F.col("__s")

    def hashed(i: Column) -> Column:
        return F.xxhash64(*[F.get(c, i + j) for j in range(width)])

    places = F.sequence(F.lit(0), F.greatest(F.size(c) - width, F.lit(0)))
    if not slots:
        return arrays.select(*keys, F.explode(F.transform(places, hashed)).alias("h"))
    values = F.zip_with(c, F.split("__p", " "), lambda t, w: F.when(F.startswith(t, F.lit("<")), w))
    return arrays.withColumn("__s", values).select(*keys, F.inline(F.transform(places, lambda i: F.struct(
        i.alias("place"), hashed(i).alias("h"), F.concat_ws(JOIN, F.slice(s, i + 1, width)).alias("slots")))))


def aligned(matches: DataFrame, similarity: float) -> DataFrame:
    """``(row, item_id, part, start, slots, item_slots)``: window pairs of each occurrence that holds enough of the item.

    An occurrence starts at a document place less an item place.  Each window of the item takes its match
    nearest to where it should stand, at most the share of the item's windows that may be missing away.
    """
    at = ["row", "item_id", "part", "start"]
    shift = F.ceil((1 - similarity) * F.col("n_windows")).cast("int")
    starts = matches.select("row", F.col("item_id").alias("__item"), "part", (F.col("place") - F.col("item_place")).alias("start")).distinct()
    same = F.col("item_id").eqNullSafe(F.col("__item"))
    moved = matches.withColumn("diagonal", F.col("place") - F.col("item_place"))
    moved = moved.select("*", F.explode(F.sequence(F.col("diagonal") - shift, F.col("diagonal") + shift)).alias("start"))
    near = (moved.alias("m").join(starts.alias("s"), (F.col("m.row") == F.col("s.row")) & (F.col("m.part") == F.col("s.part"))
                                  & (F.col("m.start") == F.col("s.start")) & same, "left_semi")
            .groupBy(*at, "item_place", "n_windows")
            .agg(F.min(F.struct(F.abs(F.col("diagonal") - F.col("start")).alias("off"), "place", "h", "slots", "item_slots")).alias("w")))
    near = cut(near.select(*at, "n_windows", "w.h", "w.slots", "w.item_slots"))
    whole = (near.groupBy(*at, "n_windows").agg(F.countDistinct("h").alias("n")).where(F.col("n") / F.col("n_windows") >= similarity)
             .select("row", F.col("item_id").alias("__item"), "part", "start"))
    return (near.alias("m").join(whole.alias("s"), (F.col("m.row") == F.col("s.row")) & (F.col("m.part") == F.col("s.part"))
                                 & (F.col("m.start") == F.col("s.start")) & same, "left_semi").select(*at, "slots", "item_slots"))


def agreement(windows: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, agree, differs)``: the share of values that follow one mapping (1 without any), and whether a value differs."""
    values = F.when(F.col("slots") != "", F.arrays_zip(F.split("item_slots", JOIN).alias("iv"), F.split("slots", JOIN).alias("dv")))
    pairs = cut(windows.select(*keys, F.explode_outer(values).alias("p"))
                .groupBy(*keys, F.col("p.iv").alias("iv"), F.col("p.dv").alias("dv")).agg(F.count(F.lit(1)).alias("n")))
    agree = None
    for side in ("iv", "dv"):
        valued = F.col(side).isNotNull()
        one = (pairs.groupBy(*keys, side).agg(F.max("n").alias("most"), F.sum("n").alias("all"),
                                              F.max(F.col("iv") != F.col("dv")).alias("differs"))
               .groupBy(*keys).agg((F.sum(F.when(valued, F.col("most"))) / F.sum(F.when(valued, F.col("all")))).alias("agree"),
                                   F.max("differs").alias("differs")))
        agree = one if agree is None else agree.unionByName(one)
    return (agree.groupBy(*keys).agg(F.min("agree").alias("agree"), F.max("differs").alias("differs"))
            .select(*keys, F.coalesce("agree", F.lit(1.0)).alias("agree"), F.coalesce("differs", F.lit(False)).alias("differs")))


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 5, similarity: float = 0.8,
                  consistency: float = 0.9) -> DataFrame:
    """``(doc_id, row, item_id, similarity, slot_consistency, reparameterised)`` per document and item it holds.

    ``similarity`` is the share of the item's windows found in the document;
    ``slot_consistency`` the share of placeholder values that follow one mapping, the
    lower of both directions (1 without placeholders), in the occurrence that agrees
    best, or over all window pairs of equal templates if that agrees better (an item
    torn apart has no occurrence); ``reparameterised`` tells whether a value differs
    there.  ``row`` hashes id and text, so rows that share an id are
    told apart and repeated rows give one result.  Null, empty and wordless
    texts or items hold nothing; a null item id is an item like any other, and
    items with the same id are judged as one; empty tables give no rows; other
    columns are never read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("row", F.xxhash64("doc_id", "text"))
    given = benchmark.select(F.col("item_id").alias("item_id"), F.col("text").cast("string").alias("text"))
    given = given.withColumn("part", F.xxhash64("text"))  # tells apart the texts of one item id
    items = cut(windows(given, ["item_id", "part"], width, slots=True).distinct()
                .withColumnsRenamed({"slots": "item_slots", "place": "item_place"}))
    asked = items.select("item_id", "h").distinct()
    if asked.count() <= BROADCAST_ROWS:
        asked = F.broadcast(asked)  # beyond, Spark joins by shuffle
    item = F.col("item_id").eqNullSafe(F.col("__item"))
    size = items.groupBy(F.col("item_id").alias("__item")).agg(F.countDistinct("h").alias("n_windows"))
    found = (windows(rows, ["row", "doc_id"], width, slots=False).join(asked, "h").distinct()
             .groupBy("row", "doc_id", "item_id").agg(F.count(F.lit(1)).alias("n_found")))
    enough = cut(found.join(size, item).withColumn("similarity", F.col("n_found") / F.col("n_windows"))
                 .where(F.col("similarity") >= similarity).select("row", "doc_id", "item_id", "similarity", "n_windows"))
    # Only texts that hold enough of an item are looked at again, for their placeholders' values.
    again = rows.join(enough.select("row").distinct(), "row").dropDuplicates(["row"])
    both = enough.select(F.col("row").alias("__row"), F.col("item_id").alias("__item"), "n_windows").distinct()
    matches = cut(windows(again, ["row"], width, slots=True).join(items, "h")
                  .join(both, (F.col("row") == F.col("__row")) & item).drop("__row", "__item"))
    anywhere = (matches.select("row", "item_id", "h", "place", "slots", "item_slots").distinct()
                .select("row", "item_id", F.lit(None).cast("long").alias("part"), F.lit(None).cast("int").alias("start"), "slots", "item_slots"))
    slots = (agreement(anywhere.unionByName(aligned(matches, similarity)), ["row", "item_id", "part", "start"])
             .groupBy(F.col("row").alias("__row"), F.col("item_id").alias("__item"))
             .agg(F.max(F.struct("agree", (~F.col("differs")).alias("same"))).alias("best")))
    return (enough.join(slots, (F.col("row") == F.col("__row")) & item)
            .select("doc_id", "row", "item_id", "similarity", F.col("best.agree").alias("slot_consistency"),
                    (~F.col("best.same")).alias("reparameterised"))
            .where(F.col("slot_consistency") >= consistency))


def clean(docs: DataFrame, benchmark: DataFrame, **rules: float) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, all columns unchanged."""
    held = contamination(docs, benchmark, **rules).select(F.col("row").alias("__row")).distinct()
    row = F.xxhash64(docs["doc_id"].cast("long"), docs["text"].cast("string"))
    return docs.join(held, row == F.col("__row"), "left_anti")
