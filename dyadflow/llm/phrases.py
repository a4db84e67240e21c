"""Benchmark decontamination with a distributed positional inverted index.

The index stores, for the rarest terms of the test phrases, where each of them occurs in the training documents: document,
position, and the few words around. A phrase is looked up by its two rarest terms: their posting lists, shifted by the
terms' offsets in the phrase, are intersected on (document, phrase, start), and what is left is compared with the words
around the posting, so that a match is exact. Proximity matches come from the same lists with a slack on the start; they are
counted beside the exact ones and decide nothing.

How rare a term is is counted over all documents. Common words are stored only for a phrase that holds nothing rarer,
so the index stays far smaller than the corpus. Everything is DataFrame work; the phrases' terms are broadcast only up to
`BROADCAST_TERMS`, beyond that Spark joins them to bare places by shuffle, and the words around a place are fetched by document.

Words are maximal runs of digits, lower-case letters and characters beyond ASCII, after A-Z are lower-cased.

Defined results: null text has no words; an item without words has no window; repeated documents get a row each with
equal results; repeated items count once for each distinct id; null item ids are left out of the list of items; an empty
table of documents gives no rows, an empty benchmark gives rows without hits; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dyadflow.llm.common import row_key, shared_dir

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Broadcast the terms or windows of the benchmark only up to so many rows (about 100 bytes each).
BROADCAST_TERMS = 500_000


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, nothing else; text of ASCII alone takes the faster way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def raw_words(text: Column) -> Column:
    """Words in order; the first and last element can be empty, which shifts all positions of a document alike."""
    return F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS)


def count_words(words: Column) -> Column:
    n = F.size(words)
    return (n - (F.element_at(words, 1) == "").cast("int") - ((n > 1) & (F.element_at(words, -1) == "")).cast("int")).cast("long")


def small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_TERMS else df


def windows_of(items: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """Rows (window, terms, item): n consecutive words of an item, or all words of a shorter one."""
    words = items.select(F.col(id_col).cast("string").alias("item"), F.filter(raw_words(F.col(text_col)), lambda x: x != "").alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - (n - 1), F.lit(1)))
    cut = words.select("item", F.explode(F.transform(starts, lambda i: F.slice("words", i, n))).alias("terms"))
    return cut.select(F.array_join("terms", " ").alias("window"), "terms", "item").distinct()


def term_counts(docs: DataFrame, text_col: str, terms: DataFrame, n_terms: int) -> DataFrame:
    """How often each of the given terms occurs in all documents."""
    found = docs.select(F.explode(raw_words(F.col(text_col))).alias("term")).join(small(terms, n_terms), "term")
    return found.groupBy("term").agg(F.count(F.lit(1)).alias("freq"))


def rarest_terms(windows: DataFrame, freqs: DataFrame, k: int = 2) -> DataFrame:
    """The k rarest places of each window: (w, window, len, rank, term, offset), w the window's number; windows with a term that occurs nowhere are left out."""
    places = windows.select("w", "window", F.size("terms").alias("len"), F.posexplode("terms").alias("offset", "term")).join(freqs, "term", "left")
    by = Window.partitionBy("w")
    ranked = places.withColumn("least", F.min(F.coalesce("freq", F.lit(0))).over(by)).where(F.col("least") > 0)
    return ranked.withColumn("rank", F.row_number().over(by.orderBy("freq", "term", "offset"))).where(F.col("rank") <= k).select("w", "window", "len", "rank", "term", "offset")


def build_index(docs: DataFrame, id_col: str, text_col: str, terms: DataFrame, n_terms: int, reach: int) -> DataFrame:
    """Postings (k, term, pos, near_from, near) of terms (term, and leads if not all do): near holds the words from near_from on, `reach` - 1 to either side, of a term that leads a phrase."""
    terms = terms if "leads" in terms.columns else terms.withColumn("leads", F.lit(True))
    text = F.col(text_col)
    words = docs.select(row_key(id_col, text).alias("k"), raw_words(text).alias("words"))
    if n_terms <= BROADCAST_TERMS:
        placed = words.select("k", "words", F.posexplode("words").alias("pos", "term")).join(F.broadcast(terms), "term")
    else:
        # no words travel with a word: the places are found first, and a document's places meet its words once
        found = words.select("k", F.posexplode("words").alias("pos", "term")).join(terms, "term")
        places = found.groupBy("k").agg(F.collect_set(F.struct("pos", "term", "leads")).alias("places"))
        placed = words.dropDuplicates(["k"]).join(places, "k").select("k", "words", F.inline("places"))
    first = F.greatest(F.col("pos") - (reach - 1), F.lit(0))
    return placed.select("k", "term", "pos", first.alias("near_from"), F.when(F.col("leads"), F.slice("words", first + 1, 2 * reach - 1)).alias("near"))


def phrase_matches(index: DataFrame, rarest: DataFrame, n_rarest: int) -> DataFrame:
    """Exact occurrences (k, w, start, len), by intersection of the offset-adjusted lists of the two rarest terms."""
    at = (F.col("pos") - F.col("offset")).alias("start")
    lead = index.join(small(rarest.where("rank = 1"), n_rarest), "term").select("k", "w", "window", "len", at, "near_from", "near").where("start >= 0")
    # Spark may slice before it has dropped the starts below zero
    cut = F.array_join(F.slice("near", F.greatest(F.col("start") - F.col("near_from") + 1, F.lit(1)), F.col("len")), " ")
    lead = lead.where(cut == F.col("window")).select("k", "w", "start", "len")
    second = index.select("k", "term", "pos").join(small(rarest.where("rank = 2"), n_rarest), "term").select("k", "w", at).where("start >= 0")
    both = lead.where("len > 1").join(second, ["k", "w", "start"], "left_semi")
    return both.unionByName(lead.where("len = 1")).distinct()


def proximity_matches(index: DataFrame, rarest: DataFrame, n_rarest: int, slack: int) -> DataFrame:
    """Windows (k, w) of which a document holds the two rarest terms about in their places: their starts differ by at most `slack` words.

    A window of one word is near wherever it occurs.
    """
    at = (F.col("pos") - F.col("offset")).alias("start")
    lead = index.select("k", "term", "pos").join(small(rarest.where("rank = 1"), n_rarest), "term").select("k", "w", "len", at)
    second = index.select("k", "term", "pos").join(small(rarest.where("rank = 2"), n_rarest), "term").select("k", "w", at)
    width = slack + 1
    cell = F.floor(F.col("start") / width).cast("int")
    # the rarest term's list is the shorter one: its places stand in three cells, those of the second in their own
    around = lead.where("len > 1").select("k", "w", "start", F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"))
    near = second.select("k", "w", F.col("start").alias("other"), cell.alias("cell"))
    close = around.join(near, ["k", "w", "cell"]).where(F.abs(F.col("start") - F.col("other")) <= slack)
    return close.select("k", "w").unionByName(lead.where("len = 1").select("k", "w")).distinct()


def keyed_verdicts(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", n: int = 13, one_in: int = 20, slack: int = 2) -> DataFrame:
    """The rows of decontaminate, with `k`, what tells documents apart: struct(id, h), h the hash of the text."""
    shared_dir(docs.sparkSession)
    listed = windows_of(benchmark, item_col, item_text, n).checkpoint()
    # windows go by a number from here on: their texts would be most of what is shuffled
    windows = listed.select("window", "terms").distinct().withColumn("w", F.monotonically_increasing_id()).checkpoint()
    terms = windows.select(F.explode("terms").alias("term")).distinct()
    rarest = rarest_terms(windows, term_counts(docs, text_col, terms, terms.count())).checkpoint()
    n_rarest = rarest.count()
    # the stored index: read twice below, and kept whatever executors go
    index = build_index(docs, id_col, text_col, rarest.groupBy("term").agg(F.max(F.col("rank") == 1).alias("leads")), n_rarest, n).checkpoint()
    found = phrase_matches(index, rarest, n_rarest).checkpoint()

    end = F.col("start") + F.col("len")
    before = F.max(end).over(Window.partitionBy("k").orderBy("start", "len").rowsBetween(Window.unboundedPreceding, -1))
    covered = found.select("k", F.greatest(F.lit(0), end - F.greatest(F.col("start"), F.coalesce(before, F.lit(0)))).alias("new"))
    hits = covered.groupBy("k").agg(F.sum("new").cast("long").alias("n_hit"))
    holding = listed.where("item IS NOT NULL").select("window", "item").join(windows.select("window", "w"), "window").select("w", "item")
    items = found.select("k", "w").distinct().join(holding, "w").select("k", "item").distinct()
    named = items.groupBy("k").agg(F.sort_array(F.collect_list("item")).alias("items"))
    nearby = proximity_matches(index, rarest, n_rarest, slack).groupBy("k").agg(F.count(F.lit(1)).alias("n_near"))

    text = F.col(text_col)
    counted = docs.select(F.col(id_col), row_key(id_col, text).alias("k"), count_words(raw_words(text)).alias("n_words"))
    n_hit, names = F.coalesce("n_hit", F.lit(0).cast("long")), F.coalesce("items", F.array().cast("array<string>"))
    told = nearby.join(hits.join(named, "k", "left"), "k", "full_outer")
    return counted.join(told, "k", "left").select(
        "k",
        F.col(id_col),
        "n_words",
        n_hit.alias("n_hit"),
        F.size(names).cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (one_in * n_hit >= F.col("n_words"))).alias("contaminated"),
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items_sha256, contaminated (n_hit > 0 and one_in * n_hit >= n_words), n_near (windows by proximity)."""
    return keyed_verdicts(docs, benchmark, **options).drop("k")
