"""Benchmark decontamination with a broadcast hash set of n-grams (DataFrame functions only).

Any window of W item words wholly covers one of the item's aligned blocks of (W + 1) // 2 words, so the hashes of these
blocks are the n-grams of the set; an item of fewer than W words has one, of its first words (as many as the largest of the
lengths 1, 2, 4, ... and the block's that it holds). A scan of the documents hashes the words at every place, once for
each length that the items have, and looks the hashes up in the broadcast set. A hit takes the document's words around it
along and meets the item's words around the blocks of that hash; both are laid over each other, and every run of W
equal words gives a span. A window reaches no further than W - 1 words beyond a block that it covers, so the words around
all blocks of an item are less than three times the item, and an occurrence costs one narrow row for every block of it.
Blocks with the same words around them are one, within an item and over all items: a text of one word again and again has
three of them, whatever its length, and a passage that many items share is verified once. Which items hold a block is looked
up at the end, once for each document and block.

The set is broadcast in parts of at most ``BROADCAST_BYTES``, measured by its number of hashes; each part is one scan of
the documents. The words around blocks are broadcast where they are few, else joined under salts, as a hash may be met in
very many documents.

Words and windows are as in ``words`` and ``WINDOW``; an item of fewer words is one window.

Defined results: null or word-less texts have no words, hits or items; benchmark rows with null item_id or without
words take no part; an item_id that occurs in several rows counts once, over all its rows; rows that repeat a
document each get its result; documents and items of any length are read whole; empty tables on either side work; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import ascii_lower, materialise, salted_join, small_or_shuffled

WINDOW = 13
#: What separates words once A-Z are lower-cased: everything but [^\x00-\x2F\x3A-\x60\x7B-\x7F].
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BROADCAST_BYTES = 64 << 20
#: Bytes of one hash in a broadcast set; blocks, of at most 2 * WINDOW words, that are broadcast to the hits.
HASH_BYTES, SMALL_BLOCKS = 64, 60_000
#: Up to so many contaminated documents (40 bytes each) are broadcast to the scan that removes them.
SMALL_KEYS = 500_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def _lengths(window: int) -> list[int]:
    """Lengths of n-grams, longest first."""
    half = (window + 1) // 2
    return [half, *[1 << k for k in reversed(range(half.bit_length())) if 1 << k < half]]


def blocks(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """hash of every n-gram, its length, item_id, the item's words around it (part), the places of part before it (back)
    and the words that must be equal in a row (need)."""
    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("item")).where(F.size("item") > 0).distinct()
    lengths, n = _lengths(window), F.size("item")
    half = lengths[0]
    length = F.coalesce(*[F.when(n >= size, size) for size in lengths])
    at = F.when(n >= window, F.sequence(F.lit(0), F.greatest(n - half, F.lit(0)), F.lit(half))).otherwise(F.array(F.lit(0)))
    placed = items.select("item_id", "item", length.alias("length"), F.explode(at).alias("at"))
    start = F.greatest(F.col("at") - (window - half), F.lit(0))
    return placed.select(
        F.xxhash64(F.slice("item", F.col("at") + 1, F.col("length"))).alias("hash"), "length", "item_id", F.slice("item", start + 1, F.least(n, F.col("at") + window) - start).alias("part"),
        (F.col("at") - start).alias("back"), F.least(n, F.lit(window)).alias("need"),
    ).distinct()


def _spans(item_part: Column, doc_part: Column, start: Column, need: Column) -> Column:
    """[from, to) document places of every run of at least ``need`` equal words of two parts laid over each other, the
    first of which is at document place ``start``."""
    same = F.concat(F.zip_with(item_part, doc_part, lambda a, b: F.coalesce(a == b, F.lit(False))), F.array(F.lit(False)))
    zero = F.struct(F.lit(0).alias("i"), F.lit(0).alias("run"), F.array().cast("array<struct<a:int,b:int>>").alias("found"))

    def step(acc: Column, equal: Column) -> Column:
        here = (start + acc["i"]).cast("int")
        ended = F.when(~equal & (acc["run"] >= need), F.array(F.struct((here - acc["run"]).alias("a"), here.alias("b")))).otherwise(F.array().cast("array<struct<a:int,b:int>>"))
        return F.struct((acc["i"] + 1).alias("i"), F.when(equal, acc["run"] + 1).otherwise(0).alias("run"), F.concat(acc["found"], ended).alias("found"))

    return F.aggregate(same, zero, step, lambda acc: acc["found"])


def _merged(spans: Column) -> Column:
    """Sorted spans as disjoint ones; neighbours that touch are one."""
    kind = "array<struct<a:int,b:int>>"
    zero = F.struct(F.array().cast(kind).alias("done"), F.lit(-1).alias("a"), F.lit(-1).alias("b"))
    closed = lambda acc: F.when(acc["b"] > acc["a"], F.concat(acc["done"], F.array(F.struct(acc["a"].alias("a"), acc["b"].alias("b"))))).otherwise(acc["done"])

    def step(acc: Column, s: Column) -> Column:
        apart = s["a"] > acc["b"]
        return F.struct(F.when(apart, closed(acc)).otherwise(acc["done"]).alias("done"), F.when(apart, s["a"]).otherwise(acc["a"]).alias("a"), F.when(apart, s["b"]).otherwise(F.greatest(acc["b"], s["b"])).alias("b"))

    return F.aggregate(spans, zero, step, closed)


def _scanned(source: DataFrame, hashes: DataFrame, lengths: list[int], window: int) -> DataFrame:
    """One row per document (place null) and one per place whose n-gram is in the set, with the words around it. A slice is
    cut per row, in compiled code; inside a lambda each one would read the whole array."""
    n, place, back = F.size("doc"), F.col("place"), window - (window + 1) // 2
    # Place -1, which has no n-gram, gives every document exactly one row of its own.
    placed = source.select("doc_id", "text_key", "doc", F.explode(F.sequence(F.lit(-1), n - 1)).alias("place"))
    made = [F.when((place >= 0) & (place <= n - size), F.xxhash64(F.slice("doc", F.greatest(place, F.lit(0)) + 1, size))) for size in lengths]
    if len(made) == 1:
        grams = placed.withColumn("gram", made[0])
    else:
        grams = placed.select("*", F.posexplode(F.array(*made)).alias("length", "gram")).where("gram is not null or (place = -1 and length = 0)")
    met = grams.join(F.broadcast(hashes.select("hash").distinct()), F.col("gram") == F.col("hash"), "left").where("place = -1 or hash is not null")
    first = F.greatest(place - back, F.lit(0))
    around = F.when(place >= 0, F.slice("doc", first + 1, F.greatest(place, F.lit(0)) + window - first))
    return met.select("doc_id", "text_key", n.cast("long").alias("n_words"), "hash", F.when(place >= 0, place).alias("place"), first.alias("first"), around.alias("around"))


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Per distinct document: doc_id, text_key, n_words, n_hit, n_items, items_sha256, contaminated, items, spans (disjoint
    [a, b) word places, in order) and copies. ``text_key`` is the MD5 of the text."""
    spark = docs.sparkSession
    found = blocks(benchmark, window)
    key = F.md5(F.concat_ws(" ", "hash", "length", "back", "need", "part").cast("binary"))
    owned = materialise(spark, found.withColumn("part_key", key), "decontamination-items")
    table = materialise(spark, owned.drop("item_id").dropDuplicates(["part_key"]), "decontamination-blocks")
    known = table.groupBy("length").agg(F.count_distinct("hash").alias("n")).collect()
    lengths = [r.length for r in sorted(known, key=lambda r: -r.length)] or [(window + 1) // 2]
    parts = max(1, -(-sum(r.n for r in known) * HASH_BYTES // broadcast_bytes))
    source = docs.select("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_key"), words(F.col("text")).alias("doc"))
    found = None
    for k in range(parts):
        met = _scanned(source, table if parts == 1 else table.where(F.pmod("hash", F.lit(parts)) == k), lengths, window)
        found = met if found is None else found.union(met.where("place is not null"))
    found = materialise(spark, found, "decontamination-hits")
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("n_words", "long"), ("spans", "array<struct<a:int,b:int>>"), ("item_id", "string"))]
    heads = found.where("place is null").select("doc_id", "text_key", F.lit(True).alias("head"), "n_words", *nothing[1:])
    hits = found.where("place is not null").drop("n_words")
    laid = salted_join(spark, hits, table, "hash", F.xxhash64("doc_id", "text_key", "place"), SMALL_BLOCKS)
    # Both parts from the later of their beginnings on, which is document place ``start``.
    begin = F.col("place") - F.col("back")
    start = F.greatest(begin, F.col("first"))
    spans = _spans(F.slice("part", start - begin + 1, F.size("part")), F.slice("around", start - F.col("first") + 1, F.size("part")), start, F.col("need"))
    laid = laid.select("doc_id", "text_key", "part_key", spans.alias("spans")).where(F.size("spans") > 0)
    laid = materialise(spark, laid.distinct(), "decontamination-spans")
    met = laid.select("doc_id", "text_key", "part_key").distinct()
    items = salted_join(spark, met, owned.select("part_key", "item_id"), "part_key", F.xxhash64("doc_id", "text_key"), SMALL_BLOCKS)
    spanned = laid.select("doc_id", "text_key", F.lit(False).alias("head"), nothing[0], "spans", nothing[2]).distinct()
    named = items.select("doc_id", "text_key", F.lit(False).alias("head"), *nothing[:2], "item_id").distinct()
    grouped = heads.union(spanned).union(named).groupBy("doc_id", "text_key")
    per_doc = grouped.agg(F.max("n_words").alias("n_words"), F.collect_list("spans").alias("found"), F.array_sort(F.collect_set("item_id")).alias("items"), F.count_if("head").cast("int").alias("copies"))
    spans = _merged(F.array_sort(F.flatten("found")))
    covered = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"])
    out = per_doc.select("doc_id", "text_key", "n_words", "copies", "items", spans.alias("spans")).withColumn("n_hit", covered)
    return out.select(
        "doc_id", "text_key", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "items", "spans", "copies",
    )


def judge(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document row: doc_id and the results of ``scan``."""
    one = scan(docs, benchmark, window)
    return one.withColumn("_copy", F.explode_outer(F.sequence(F.lit(1), F.col("copies")))).drop("_copy", "copies")


def remove_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs without the contaminated ones, with all their columns."""
    bad = scan(docs, benchmark, window).where("contaminated").select(F.col("doc_id").alias("_bad_doc_id"), F.col("text_key").alias("_bad_text_key"))
    bad = small_or_shuffled(materialise(docs.sparkSession, bad, "contaminated"), SMALL_KEYS)
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("_bad_doc_id")) & (F.md5(F.coalesce("text", F.lit("")).cast("binary")) == F.col("_bad_text_key")), "left_anti")


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with the words of every span cut from the text. Texts that held a span come back as their remaining
    lower-cased words, single-spaced; other rows are unchanged."""
    found = scan(docs, benchmark, window).where("n_hit > 0").select(F.col("doc_id").alias("_bad_doc_id"), F.col("text_key").alias("_bad_text_key"), F.col("spans").alias("_bad_spans"))
    key = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    joined = docs.join(found, F.col("doc_id").eqNullSafe(F.col("_bad_doc_id")) & (key == F.col("_bad_text_key")), "left")
    left = F.filter(words(F.col("text")), lambda w, i: ~F.exists("_bad_spans", lambda s: (i >= s["a"]) & (i < s["b"])))
    return joined.withColumn("text", F.when(F.col("_bad_doc_id").isNull(), F.col("text")).otherwise(F.array_join(left, " "))).drop("_bad_doc_id", "_bad_text_key", "_bad_spans")
