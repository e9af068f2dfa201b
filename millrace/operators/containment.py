"""Which benchmark texts are contained in which documents, without comparing all pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sentences import let


def contained_items(docs: DataFrame, items: DataFrame, size: int = 5) -> DataFrame:
    """(doc_id, item_id) where the item's text lies in the document's. The first `size` words of an item, its first and
    last word apart since those may be cut, meet the document's word runs in an equal join; `contains` then decides.
    Items of fewer than `size` + 2 words have one key: their longest inner word or, without one, a piece of a word. Keys of
    documents are kept only if an item has them."""
    w = F.split("text", " ")
    long = items.filter(F.size(w) >= size + 2)
    keyed = long.select("item_id", F.col("text").alias("item"), F.array_join(F.slice(w, 2, size), " ").alias("key"))
    # The words of a text are split once, and each run is put together from its places: the work grows with the text, not with its square.
    starts = lambda ws: F.when(F.size(ws) >= size, F.sequence(F.lit(0), F.size(ws) - size)).otherwise(F.array().cast("array<int>"))
    run = lambda ws, i: F.concat_ws(" ", *[F.get(ws, i + k) for k in range(size)])
    runs = docs.select("doc_id", F.explode(let(w, lambda ws: F.array_distinct(F.transform(starts(ws), lambda i: run(ws, i))))).alias("key"))
    short = items.filter(F.size(w) < size + 2)
    inner = short.filter(F.size(w) >= 3).select("item_id", F.col("text").alias("item"), F.element_at(F.array_sort(F.slice(w, 2, F.size(w) - 2), lambda a, b: F.length(a) - F.length(b)), -1).alias("key"))
    whole = docs.select("doc_id", F.explode(F.array_distinct(w)).alias("key"))
    # One or two words may begin and end inside words of the document: their first three letters are looked up anywhere.
    few = short.filter(F.size(w) < 3).select("item_id", F.col("text").alias("item"), F.substring("text", 1, 3).alias("key"))
    letters = F.transform(F.sequence(F.lit(1), F.greatest(F.length("text"), F.lit(1))), lambda i: F.substring(F.col("text"), i, F.lit(3)))
    pieces = F.array_distinct(F.flatten(F.transform(letters, lambda p: F.array(p, F.substring(p, 1, 2), F.substring(p, 1, 1), F.lit("")))))
    near = runs.join(keyed, "key").unionByName(whole.join(inner, "key")).select("doc_id", "item_id", "item").distinct()
    hits = near.join(docs, "doc_id").filter(F.contains("text", "item")).select("doc_id", "item_id")
    if few.isEmpty():
        return hits
    met = docs.select("doc_id", F.explode(pieces).alias("key")).join(few, "key").select("doc_id", "item_id", "item").distinct()
    return hits.unionByName(met.join(docs, "doc_id").filter(F.contains("text", "item")).select("doc_id", "item_id"))
