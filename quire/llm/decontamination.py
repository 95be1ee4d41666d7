"""Benchmark decontamination with DataFrame functions only: a broadcast hash table of test n-grams, probed and verified."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, dropped, spread_join, written

#: Between words, once A-Z are in lower case.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Up to so many windows, of so many bytes, are sent to every executor as a hash table; more are joined by a shuffle.
SET, SET_BYTES = 200_000, 64 << 20
#: Words at the start of a window whose hash is looked up; the whole window is compared where it is found.
HEAD = 4
#: Up to so many hashes of contaminated texts (16 bytes each) are sent to every executor; more are joined by a shuffle.
KEYS = 500_000


def words_of(text: Column) -> Column:
    """The words of a text as an array; null has none."""
    return F.coalesce(F.array_remove(F.split(ascii_lower(text), BETWEEN, -1), ""), F.array().cast("array<string>"))


def _head(words: Column, at: Column, size: int) -> Column:
    """A hash of `size` words from the place `at` (from 0) on."""
    return F.xxhash64(F.lit(size), *(F.get(words, at + k) for k in range(size)))


def windows(items: DataFrame, id_col: str, text_col: str, length: int) -> DataFrame:
    """(gram, size, head, key, items): the distinct windows; an item of fewer words, but not none, is one window.

    items: the ids, as strings and sorted, of the items that have it. key: the hash of its first `head` words.
    """
    w = items.select(F.col(id_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("words")).where(F.size("words") > 0)
    size = F.least(F.size("words"), F.lit(length))
    parts = w.select("item", "words", size.alias("size"), F.explode(F.sequence(F.lit(1), F.size("words") - size + 1)).alias("at")).select("item", "size", F.slice("words", F.col("at"), F.col("size")).alias("part"))
    key = F.lit(0).cast("long")
    for k in range(1, HEAD + 1):
        key = F.when(F.col("size") >= k, _head(F.col("part"), F.lit(0), k)).otherwise(key)
    grams = parts.select("item", "size", F.array_join("part", " ").alias("gram"), F.least("size", F.lit(HEAD)).alias("head"), key.alias("key"))
    return grams.groupBy("gram", "size", "head", "key").agg(F.array_sort(F.collect_set("item")).alias("items"))


def _test(benchmark: DataFrame, item_col: str, item_text_col: str, length: int) -> tuple[DataFrame, list[int], bool]:
    """The windows, the lengths of their heads, and whether they are few enough to be broadcast."""
    test = written(windows(benchmark.where(F.col(item_col).isNotNull()), item_col, item_text_col, length), "windows")
    heads = sorted(r[0] for r in test.select("head").distinct().collect())
    ids = F.aggregate("items", F.lit(0), lambda n, x: n + F.octet_length(x) + 16)
    n, size = test.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("gram") + ids), F.lit(0))).first()
    return test, heads, n <= SET and size <= SET_BYTES


def _probes(rows: DataFrame, heads: list[int], first: int) -> DataFrame:
    """A row for each place of a text (at, from `first` on) and length of head, with the hash of the words there (key)."""
    at = rows.withColumn("__at", F.explode(F.sequence(F.lit(first), F.greatest(F.size("__words") - 1, F.lit(first)))))
    keys = [_head(F.col("__words"), F.col("__at"), k) for k in heads] or [F.lit(0).cast("long")]
    return at.withColumn("__key", keys[0] if len(keys) == 1 else F.explode(F.array(*keys)))


def _same() -> Column:
    """Whether the window of the table stands where its head was found."""
    return (F.col("size") > 0) & (F.array_join(F.slice("__words", F.col("__at") + 1, F.col("size")), " ") == F.col("gram"))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", length: int = 10, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: id, the columns in keep, n_words, n_hit (words inside any occurrence of a window), items.

    items: the ids, as strings and sorted, of the items with occurring windows. Null texts have no words; items without words
    have no windows, and items with a null id are left out. Equal windows of several items count for each of them. At each
    word of a document the hash of the next HEAD words (of fewer for shorter windows) is looked up in a broadcast table, and
    where it is found the whole window is compared: there are no false hits, and nothing but hits and one row per document
    leaves the scan. If the windows are more than SET, or longer than SET_BYTES, hashes are joined to them by a shuffle
    instead, frequent ones dealt out over tasks, and compared after that.
    """
    test, heads, few = _test(benchmark, item_col, item_text_col, length)
    rows = docs.select(F.col(id_col).alias("__id"), *(F.col(c).alias(f"__keep_{c}") for c in keep), words_of(F.col(text_col)).alias("__words")).withColumn("__row", F.monotonically_increasing_id())
    own = ["__row", "__id", *(f"__keep_{c}" for c in keep)]
    if few:
        # place -1 finds the row of size 0: the one row that each document has in any case
        head_row = test.sparkSession.range(1).select(F.lit("").alias("gram"), F.lit(0).alias("size"), F.lit(0).alias("head"), F.lit(0).cast("long").alias("key"), F.array().cast("array<string>").alias("items"))
        table = F.broadcast(test.unionByName(head_row).withColumnRenamed("key", "__key"))
        probes = _probes(rows, heads, -1).withColumn("__key", F.when(F.col("__at") < 0, F.lit(0).cast("long")).otherwise(F.col("__key")))
        hits = probes.join(table, "__key").where(((F.col("__at") < 0) & (F.col("size") == 0)) | ((F.col("__at") >= 0) & _same()))
        scanned = written(hits.select(*own, F.size("__words").alias("__n"), F.col("__at").alias("at"), "size", "items"), "scanned")
        every = scanned.where("size = 0").dropDuplicates(["__row"]) if len(heads) > 1 else scanned.where("size = 0")
        every, found = every.select(*own, "__n"), scanned.where("size > 0").select("__row", "at", "size", "items")
    else:
        rows = written(rows, "words")
        every = rows.select(*own, F.size("__words").alias("__n"))
        probes = written(_probes(rows, heads, 0).select("__row", "__at", F.col("__key").alias("key")), "probes")
        counts = probes.join(test.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.count(F.lit(1)).alias("rows"))
        keyed = written(test.groupBy("key").agg(F.collect_list(F.struct("gram", "size", "items")).alias("grams")).join(counts, "key"), "keyed")
        met = spread_join(probes, keyed, ["key"], "rows", probes.count(), by="__row").select("__row", "__at", F.explode("grams").alias("g")).select("__row", "__at", "g.*")
        found = met.join(rows.select("__row", "__words"), "__row").where(_same()).select("__row", F.col("__at").alias("at"), "size", "items")
    by_row = found.groupBy("__row").agg(F.collect_list(F.struct("at", "size")).alias("__hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    covered = F.array_distinct(F.flatten(F.transform("__hits", lambda h: F.sequence(h["at"], h["at"] + h["size"] - 1))))
    hit = by_row.select("__row", F.size(covered).cast("long").alias("n_hit"), "items")
    out = every.join(hit, "__row", "left")
    none = F.array().cast("array<string>")
    return out.select(F.col("__id").alias(id_col), *(F.col(f"__keep_{c}").alias(c) for c in keep), F.col("__n").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", none).alias("items"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", length: int = 10) -> DataFrame:
    """The rows of docs, all columns, without any window of a benchmark item; null texts stay.

    The 128-bit hashes of the texts with hits are found by a scan, and the rows with them are left out: texts aren't shuffled.
    """
    test, heads, few = _test(benchmark, item_col, item_text_col, length)
    if not heads:
        return docs
    text = F.col(text_col)
    key = F.struct(F.xxhash64(text).alias("a"), F.xxhash64(text, F.lit(1)).alias("b"))
    if few:
        rows = docs.where(text.isNotNull()).select(key.alias("__hit"), words_of(text).alias("__words"))
        hit = _probes(rows, heads, 0).join(F.broadcast(test.withColumnRenamed("key", "__key")), "__key").where(_same()).select("__hit").distinct()
    else:
        keyed = docs.where(text.isNotNull()).withColumn("__hit", key)
        hit = contaminated(keyed, benchmark, "__hit", text_col, item_col, item_text_col, length).where("n_hit > 0").select("__hit").distinct()
    hit = written(hit, "hit")
    dropped(test)
    out = docs.withColumn("__key", key)
    return out.join(F.broadcast(hit) if hit.count() <= KEYS else hit, F.col("__key") == F.col("__hit"), "left_anti").drop("__key")
