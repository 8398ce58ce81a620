"""Benchmark decontamination: size-partitioned MinHash containment search, in DataFrame operations only.

Test items are short and documents long, so Jaccard similarity says little; what counts is the share of an item's word
shingles that the document has. Items fall into partitions by size (powers of two). A partition fixes the length k of
its items' sketches: the k least shingle hashes (bottom-k MinHash), a uniform sample of the item. A document that holds
`share` of the item's n shingles lacks floor((1 - share) n) at most, and so has all but that many of the sketch: k is
chosen above that number for every size of the partition, so the search loses no item. Candidates are then verified
by exact containment of the shingles themselves.

An item of fewer than SHINGLE words is one shingle of its own length and is found only in a text of just these words, not inside a
longer one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import materialise

SHINGLE = 5
#: Containment of at least 4/5, as whole numbers.
SHARE = (4, 5)
#: Hits beyond the least number that a sketch must give.
SPARE = 2
#: A table of at most so many rows of two numbers is broadcast (about 32 MB); a larger one is joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def shingled(word: Column, size: int, of) -> Column:
    """of(array of `size` words) for each shingle; fewer words are one shingle, none give none."""

    def each(w: Column) -> Column:
        starts = F.when(F.size(w) > 0, F.sequence(F.lit(1), F.greatest(F.size(w) - (size - 1), F.lit(1))))
        return F.transform(starts, lambda i: of(F.slice(w, i, size)))

    # a lambda's variable is computed once; an expression inside the inner lambda would be, for each shingle
    return F.get(F.transform(F.array(word), each), F.lit(0))


def _small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if its counted rows keep within BROADCAST_ROWS."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def sketches(items: DataFrame, id_col: str = "item_id", text_col: str = "text", shingle: int = SHINGLE, share: tuple[int, int] = SHARE) -> DataFrame:
    """(h, item, need): the sketch hashes of each item, and how many of them a document must have."""
    num, den = share
    hashes = F.explode(F.array_distinct(shingled(words(F.col(text_col)), shingle, F.xxhash64)))
    rows = items.select(F.col(id_col).alias("item"), hashes.alias("h")).distinct()
    own = Window.partitionBy("item")
    ranked = rows.select("item", "h", F.count("*").over(own).alias("n"), F.row_number().over(own.orderBy("h")).alias("rank"))
    largest = F.pow(F.lit(2), F.length(F.bin("n"))) - 1  # size in the item's partition
    length = F.floor(largest * (den - num) / den) + SPARE
    kept = ranked.where(F.col("rank") <= length)
    return kept.select("h", "item", (F.least(length, F.col("n")) - F.floor(F.col("n") * (den - num) / den)).alias("need"))


def contained(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", shingle: int = SHINGLE, share: tuple[int, int] = SHARE
) -> DataFrame:
    """(id, item, n_item, n_shared): documents that hold at least `share` of an item's distinct shingles.

    Words are lower-cased. Null or blank texts hold nothing and are held by nothing; rows without an id are not
    searched. Rows with equal ids count as alternatives: the best one is reported. Other columns are ignored.
    """
    num, den = share
    sketch = materialise(sketches(items, item_col, item_text_col, shingle, share), "sketches")
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    hashed = texts.select("id", F.explode(shingled(words(F.col("text")), shingle, F.xxhash64)).alias("h"))
    hits = hashed.join(_small(sketch), "h").groupBy("id", "item", "need").agg(F.size(F.collect_set("h")).alias("hits"))
    candidates = materialise(hits.where("hits >= need").select("id", "item"), "candidates")

    suspects = texts.join(_small(candidates.select("id").distinct()), "id", "left_semi")
    text = lambda w: F.concat_ws(" ", w)
    whole = suspects.select("id", F.array_distinct(shingled(words(F.col("text")), shingle, text)).alias("has"))
    wanted = items.select(F.col(item_col).alias("item"), F.array_distinct(shingled(words(F.col(item_text_col)), shingle, text)).alias("wants"))
    pairs = candidates.join(wanted, "item").join(whole, "id")
    checked = pairs.select("id", "item", F.size("wants").cast("long").alias("n_item"), F.size(F.array_intersect("wants", "has")).cast("long").alias("n_shared"))
    best = checked.groupBy("id", "item", "n_item").agg(F.max("n_shared").alias("n_shared"))
    return best.where(F.col("n_shared") * den >= F.col("n_item") * num)


def decontaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of docs, all columns, that hold no item.

    Each row is judged by its own text, whether it has an id or not and whatever other rows have its id. Null and blank texts
    stay, repeated rows stay or go together, and an empty table of items removes nothing.
    """
    text = docs[options.get("text_col", "text")]
    rows = docs.select(F.struct(docs[id_col].alias("id"), F.xxhash64(text).alias("h")).alias("id"), text.alias("text"))
    leaks = contained(rows, items, **{k: v for k, v in options.items() if k != "text_col"}, id_col="id").select("id.id", "id.h").distinct()
    return docs.join(leaks, docs[id_col].eqNullSafe(leaks["id"]) & (F.xxhash64(text) == leaks["h"]), "left_anti")
