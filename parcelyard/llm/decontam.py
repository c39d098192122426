"""Benchmark decontamination with a distributed positional inverted index, in native expressions only.

The index stores postings (document, term, place) of the test items' rarest terms. Rare means few occurrences in the whole
training table, which are counted first. Each window of an item has its rarest terms as anchors; a posting of an anchor,
less the anchor's place in the item, is an alignment. Alignments that all of a window's anchors agree on are intersected;
only for what is left the document's words beside the anchor are read and compared word for word (phrase matches).
Proximity matches come from the same index: places where an item's rarest terms stand close together.

Words are lower-cased in A-Z; a word is a run of ASCII letters, digits and characters beyond ASCII. Null texts have no
words. Rows are told apart by id and text, so repeated ids don't mix; repeated rows get the same result each. Long texts are
whole lists of words; other columns are not read; an empty table of documents gives an empty result, one of items no match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelyard.llm.shared import Scratch, small

#: Words of a window, anchors of a window, rows up to which a list of terms or matches is broadcast.
WINDOW, ANCHORS, BROADCAST_ROWS = 13, 2, 1_000_000
#: Rarest terms of an item, and how many places they may lie apart in a proximity match.
NEAR_TERMS, SLOP = 3, 20
#: Stands after the last word of a text; no word holds it.
END = "\u0001"


def words(text: Column) -> Column:
    """Words of a text in order, with an empty string first or last where it begins or ends with a separator."""
    ascii_only = F.length(text) == F.octet_length(text)
    low = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return F.split(F.coalesce(low, F.lit("")), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")


def item_words(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Rows (item, row, w): the words of every item that has any; ``row`` names the item's words."""
    rows = items.select(F.col(id_col).alias("item"), F.filter(words(F.col(text_col)), lambda x: x != "").alias("w")).where(F.size("w") > 0)
    return rows.withColumn("row", F.xxhash64("item", "w")).distinct()


def term_counts(docs: DataFrame, items: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows (term, n): occurrences in the whole table of the terms that the items (of item_words) have."""
    vocabulary = items.select(F.explode("w").alias("term")).distinct()
    return docs.select(F.explode(words(F.col(text_col))).alias("term")).join(small(vocabulary, BROADCAST_ROWS), "term").groupBy("term").agg(F.count("*").alias("n"))


def anchors(items: DataFrame, counts: DataFrame, window: int = WINDOW, per_window: int = ANCHORS) -> DataFrame:
    """Rows (item, row, w, at, term): in every window its ``per_window`` rarest places; windows with an unseen term go."""
    places = items.select("row", F.posexplode("w").alias("at", "term")).join(counts, "term", "left")
    sizes = items.select("row", F.size("w").alias("m"))
    starts = sizes.select("row", F.least("m", F.lit(window)).alias("length"), F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.col("m") - window))).alias("start"))
    inside = starts.select("row", "start", "length", F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)).alias("at")).join(places, ["row", "at"])
    seen = F.min(F.coalesce("n", F.lit(0))).over(Window.partitionBy("row", "start"))
    order = F.row_number().over(Window.partitionBy("row", "start").orderBy("n", "at"))
    chosen = inside.withColumns({"seen": seen, "order": order}).where((F.col("seen") > 0) & (F.col("order") <= per_window))
    return chosen.select("row", "at", "term").distinct().join(items, "row")


def index(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Postings (doc, sig, term, at, n_words) of the given terms, and one of END for every document, on which n_words is set.

    One pass over the texts. The terms are broadcast within the bound; beyond it single words are shuffled, never lists of them.
    """
    listed = terms.select("term").union(terms.sparkSession.createDataFrame([(END,)], "term string")).distinct()
    split = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("sig"), words(F.col(text_col)).alias("w"))
    last = F.when(F.size("w") > 1, (F.element_at("w", -1) == "").cast("long")).otherwise(0)
    n_words = F.size("w").cast("long") - (F.element_at("w", 1) == "").cast("long") - last
    rows = split.select("doc", "sig", n_words.alias("n_words"), F.posexplode(F.concat("w", F.array(F.lit(END)))).alias("at", "term"))
    return rows.join(small(listed, BROADCAST_ROWS), "term").select("doc", "sig", "term", "at", F.when(F.col("term") == END, F.col("n_words")).alias("n_words"))


def _agreeing(a: Column, b: Column) -> Column:
    """Number of equal elements at the start of two arrays."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    stop = F.array_position(same, False)
    return F.when(stop > 0, stop - 1).otherwise(F.size(same))


def phrase_matches(postings: DataFrame, anchored: DataFrame, docs: DataFrame, scratch: Scratch, window: int = WINDOW, per_window: int = ANCHORS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc, sig, item, first, last): stretches of a document that agree with an item over a whole window or more.

    The lists of a window's anchors are intersected by their alignment (document, item, shift): fewer anchors than a window
    has at one alignment can't be a match. What is left is compared word for word with the texts of those documents.
    """
    reach = window - 1
    places = anchored.select("row", "term", F.col("at").alias("place"), F.least(F.size("w"), F.lit(window)).alias("need"))
    lists = postings.where(F.col("term") != END).join(small(places, BROADCAST_ROWS), "term").withColumn("shift", F.col("at") - F.col("place"))
    met = lists.withColumn("anchors", F.count("*").over(Window.partitionBy("doc", "sig", "row", "shift")))
    met = scratch.store(met.where(F.col("anchors") >= F.least("need", F.lit(per_window))).select("doc", "sig", "row", "at", "place", "need"))
    beside = lambda w, at: (F.slice(w, F.greatest(F.lit(1), at + 1 - reach), F.least(F.lit(reach), at)), F.slice(w, at + 2, F.lit(reach)))
    back, ahead = beside("w", F.col("at"))
    items = anchored.select("row", F.col("at").alias("place"), "item", F.reverse(back).alias("left"), ahead.alias("right"))
    split = docs.select(F.col(id_col).alias("_doc"), F.xxhash64(text_col).alias("_sig"), words(F.col(text_col)).alias("w"))
    # The texts are joined to the list of matches; rows that repeat with id and text give repeated stretches.
    before, after = beside("w", F.col("at"))
    read = split.join(small(met, BROADCAST_ROWS), F.col("_doc").eqNullSafe(F.col("doc")) & (F.col("_sig") == F.col("sig")))
    read = read.select("doc", "sig", "row", "at", "place", "need", before.alias("before"), after.alias("after")).join(small(items, BROADCAST_ROWS), ["row", "place"])
    found = read.select("doc", "sig", "item", "at", "need", _agreeing(F.reverse("before"), F.col("left")).alias("back"), _agreeing(F.col("after"), F.col("right")).alias("ahead"))
    return found.where(F.col("back") + F.col("ahead") + 1 >= F.col("need")).select("doc", "sig", "item", (F.col("at") - F.col("back")).alias("first"), (F.col("at") + F.col("ahead")).alias("last")).distinct()


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, percent: int = 5, doc_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", near_terms: int = NEAR_TERMS, slop: int = SLOP) -> DataFrame:
    """For every row of docs: doc_col, sig, n_words, n_hit, n_items, item_ids, contaminated (hit words >= percent of all), n_near.

    n_near counts the items of which a proximity match is in the document.
    """
    with Scratch(docs.sparkSession) as scratch:
        listed = scratch.store(item_words(items, item_col, item_text_col))
        counts = scratch.store(term_counts(docs, listed, text_col))
        anchored = scratch.store(anchors(listed, counts, window))
        rarest = scratch.store(rarest_terms(listed, counts, near_terms))
        postings = scratch.store(index(docs, anchored.select("term").union(rarest.select("term")), doc_col, text_col))
        hits = phrase_matches(postings, anchored, docs, scratch, window, ANCHORS, doc_col, text_col)
        # Hit words: the union of the stretches, each counted from where the earlier ones end.
        order = Window.partitionBy("doc", "sig").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
        fresh = F.greatest(F.lit(0), F.col("last") - F.greatest(F.coalesce(F.max("last").over(order) + 1, F.lit(0)), F.col("first")) + 1)
        per_doc = hits.withColumn("fresh", fresh).groupBy("doc", "sig").agg(F.sum("fresh").cast("long").alias("n_hit"), F.sort_array(F.collect_set(F.col("item").cast("string"))).alias("item_ids"))
        near = proximity_matches(postings, rarest, slop).select("doc", "sig", "item").distinct().groupBy("doc", "sig").agg(F.count("*").alias("n_near"))
        every = postings.where(F.col("term") == END).select("doc", "sig", "n_words")
        joined = _beside(_beside(every, per_doc, "1"), near, "2")
        n_hit, ids = F.coalesce("n_hit", F.lit(0).cast("long")), F.coalesce("item_ids", F.array().cast("array<string>"))
        out = joined.select(
            F.col("doc").alias(doc_col),
            "sig",
            "n_words",
            n_hit.alias("n_hit"),
            F.size(ids).cast("long").alias("n_items"),
            ids.alias("item_ids"),
            ((n_hit > 0) & (100 * n_hit >= percent * F.col("n_words"))).alias("contaminated"),
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        )
        return Scratch(docs.sparkSession).store(out, keep=True)


def _beside(rows: DataFrame, more: DataFrame, mark: str) -> DataFrame:
    """Left join on (doc, sig), where null ids are equal."""
    doc, sig = f"_doc{mark}", f"_sig{mark}"
    more = more.withColumnsRenamed({"doc": doc, "sig": sig})
    return rows.join(more, F.col("doc").eqNullSafe(F.col(doc)) & (F.col("sig") == F.col(sig)), "left").drop(doc, sig)


def proximity_matches(postings: DataFrame, wanted: DataFrame, slop: int = SLOP) -> DataFrame:
    """Rows (doc, sig, item, first, last): places where all of an item's wanted terms (of rarest_terms) stand within ``slop`` places.

    Postings are dealt into overlapping stretches of twice the slop, so that no document's or term's list is crossed with
    another; the postings must hold the terms.
    """
    listed = wanted.join(wanted.groupBy("row").agg(F.count("*").alias("need")), "row")
    hits = postings.where(F.col("term") != END).select("doc", "sig", "term", "at").join(small(listed, BROADCAST_ROWS), "term")
    home = F.floor(F.col("at") / slop)
    spread = hits.withColumn("stretch", F.explode(F.array(home, home - 1)))
    frame = Window.partitionBy("doc", "sig", "row", "stretch").orderBy("at").rangeBetween(-slop, 0)
    near = spread.withColumn("have", F.size(F.collect_set("term").over(frame))).withColumn("from", F.min("at").over(frame))
    return near.where(F.col("have") == F.col("need")).select("doc", "sig", "item", F.col("from").alias("first"), F.col("at").alias("last")).distinct()


def rarest_terms(items: DataFrame, counts: DataFrame, terms: int) -> DataFrame:
    """Rows (item, row, term): each item's distinct rarest terms that the training table has."""
    distinct = items.select("item", "row", F.explode(F.array_distinct("w")).alias("term")).join(counts, "term")
    return distinct.withColumn("order", F.row_number().over(Window.partitionBy("row").orderBy("n", "term"))).where(F.col("order") <= terms).select("item", "row", "term")
