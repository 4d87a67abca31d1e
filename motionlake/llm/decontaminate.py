"""Benchmark decontamination: a prefix-filtered join of documents with item-sized windows, in DataFrame operations.

A window is `size` consecutive words of a benchmark item. Tokens are ordered by rarity in the documents, and of
each window only its rarest token (its necessary prefix) is joined: a document that holds the window holds that
token. Position and length bounds drop matches that would start before the document or end behind it, and what
is left is verified word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motionlake.llm.common import Scratch, written

#: What parts words of letters, digits and non-ASCII characters; capitals A-Z are still to be lowered.
BETWEEN = r"[\x00-/:-@\[-`{-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Numbers of 64 bits in a table of bits at most: two megabytes.
MOST_SLOTS = 1 << 18


def words(text: Column) -> Column:
    """The words of a text, not yet lowered. Null has none."""
    return F.coalesce(F.array_remove(F.split(text, BETWEEN), ""), F.array().cast("array<string>"))


def lowered(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def hashed(token: str) -> Column:
    """A number to join words by; long keys are far cheaper to look up than strings."""
    return F.xxhash64(F.lower(F.col(token)))


def windows(items: DataFrame, size: int = 13) -> DataFrame:
    """item_id, window (its lowered words joined by a space), n (its words): distinct windows of each item.

    An item of fewer words, but not none, is one window.
    """
    tokens = items.select("item_id", F.split(lowered(F.array_join(words(F.col("text")), " ")), " ").alias("w")).where("w[0] <> ''")
    starts = F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1))))
    return (
        tokens.select("item_id", "w", starts.alias("at"))
        .select(F.col("item_id").cast("string").alias("item_id"), F.slice("w", F.col("at"), size).alias("w"))
        .select("item_id", F.array_join("w", " ").alias("window"), F.size("w").alias("n"))
        .distinct()
    )


def bit_table(keys: DataFrame, key: str, rows: int) -> tuple[Column, int]:
    """One value: an array of numbers whose bits are set where a key falls; and how many bits it has. It holds a number
    for each of `rows`, up to MOST_SLOTS, so that one or two bits in a hundred are set; with more rows it only lets more
    through."""
    slots = min(MOST_SLOTS, 1 << max(8, rows.bit_length()))
    spot = F.pmod(F.col(key), F.lit(64 * slots))
    bits = keys.select(F.floor(spot / 64).cast("int").alias("slot"), F.call_function("shiftleft", F.lit(1).cast("long"), (spot % 64).cast("int")).alias("bit"))
    each = keys.sparkSession.range(slots).select(F.col("id").cast("int").alias("slot"))
    full = each.join(bits.groupBy("slot").agg(F.bit_or("bit").alias("bits")), "slot", "left").select("slot", F.coalesce("bits", F.lit(0)).alias("bits"))
    return full.agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "bits"))), lambda x: x["bits"]).alias("table")).scalar(), 64 * slots


def marked(table: tuple[Column, int], key: Column) -> Column:
    """Whether the key may be one of the table's; never false for one that is."""
    bits, size = table
    spot = F.pmod(key, F.lit(size))
    return F.call_function("getbit", F.get(bits, F.floor(spot / 64).cast("int")), (spot % 64).cast("int")) == 1


def find(docs: DataFrame, items: DataFrame, size: int = 13) -> DataFrame:
    """For each document: doc_id, n_words, n_hit, n_items, items (sorted ids as text), print (a hash of its text).

    Hit words stand inside an occurrence of a window. Null and empty texts have no words; documents without an
    id are kept; rows that repeat both doc_id and text count once. An empty benchmark hits nothing.

    One plan at every size: a table of bits, of bounded size, picks the words that may be a key. Only these
    leave the documents, each with the few words around it, and one row for the document itself; keys join them.
    """
    scratch = Scratch(docs.sparkSession)
    wins = scratch.write(windows(items, size), "windows")
    tokens = docs.select("doc_id", F.xxhash64("text").alias("print"), words(F.col("text")).alias("w"))
    # Hashes of fully lowered words only find candidates: words that are equal after lowering A-Z have the same.
    vocabulary = wins.select(F.explode(F.split("window", " ")).alias("token")).select(hashed("token").alias("token")).distinct()
    seen = tokens.select(F.explode("w").alias("token")).select(hashed("token").alias("token"))
    counts = seen.where(marked(bit_table(vocabulary, "token", wins.count()), F.col("token"))).groupBy("token").agg(F.count(F.lit(1)).alias("freq"))
    ranked = wins.select("item_id", "window", "n", F.posexplode(F.split("window", " ")).alias("at", "token")).withColumn("token", hashed("token")).join(counts, "token")
    rarest = ranked.groupBy("item_id", "window", "n").agg(F.min(F.struct("freq", "token", "at")).alias("key"), F.count(F.lit(1)).alias("known"))
    # a window with a word that no document holds has no occurrence
    entries = rarest.where("known = n").select(F.col("key.token").alias("key"), F.col("key.at").alias("at"), "item_id", "window", "n")
    entries = scratch.write(entries, "window-keys")
    # every word of a document, and one null behind them that stands for the document itself
    spread = tokens.select("doc_id", "print", "w", F.posexplode(F.array_append("w", F.lit(None))).alias("pos", "token"))
    itself = F.col("token").isNull()
    # the document's own row meets no key: a hash of what names it, so that such rows are dealt evenly
    spread = spread.withColumn("key", F.when(itself, F.xxhash64("doc_id", "print", F.lit("document"))).otherwise(hashed("token")))
    low = F.greatest(F.col("pos") - (size - 1), F.lit(0))
    near = spread.where(itself | marked(bit_table(entries, "key", entries.count()), F.col("key"))).select(
        "doc_id", "print", "pos", "key", itself.alias("itself"), F.size("w").alias("length"), low.alias("low"), F.when(~itself, F.slice("w", low + 1, F.lit(2 * size - 1))).alias("around")
    )
    start = F.col("pos") - F.col("at")
    fits = (start >= 0) & (start + F.col("n") <= F.col("length"))
    same = lowered(F.array_join(F.slice("around", start - F.col("low") + 1, F.col("n")), " ")) == F.col("window")
    matched = (
        near.join(entries, "key", "left")
        .where(F.col("itself") | F.when(fits, same))
        .select(
            "doc_id",
            "print",
            F.when(F.col("itself"), F.col("pos")).alias("n_words"),
            F.when(~F.col("itself"), F.struct(start.alias("start"), F.col("n").alias("n"))).alias("hit"),
            F.when(~F.col("itself"), F.col("item_id")).alias("item"),
        )
    )
    hit_words = F.flatten(F.transform("hits", lambda x: F.sequence(x["start"], x["start"] + x["n"] - 1)))
    return (
        matched.groupBy("doc_id", "print")
        .agg(F.max("n_words").cast("long").alias("n_words"), F.collect_set("hit").alias("hits"), F.array_sort(F.collect_set("item")).alias("items"))
        .select(
            "doc_id",
            "n_words",
            F.size(F.array_distinct(hit_words)).cast("long").alias("n_hit"),
            F.size("items").cast("long").alias("n_items"),
            "items",
            "print",
        )
    )


def contaminated(found: DataFrame, share: int = 20) -> Column:
    """At least one word is hit, and at least one of `share` words."""
    return (found["n_hit"] > 0) & (share * found["n_hit"] >= found["n_words"])


def clean(docs: DataFrame, items: DataFrame, size: int = 13) -> DataFrame:
    """The documents that are not contaminated, all columns. Each row is judged by its own text, with or without an id."""
    found = find(docs, items, size)
    bad = written(found.where(contaminated(found)).select("doc_id", "print"), "contaminated")
    bad = bad.select(F.col("doc_id").alias("_id"), F.col("print").alias("_print"))
    # Spark broadcasts the list where it is small; else it meets the documents by id
    same = docs["doc_id"].eqNullSafe(F.col("_id")) & F.xxhash64(docs["text"]).eqNullSafe(F.col("_print"))
    return docs.join(bad, same, "left_anti").select(*docs.columns)
