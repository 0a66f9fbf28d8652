"""Benchmark decontamination by a distributed positional inverted index."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, scratch, sent_if_small, settled

SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: Words that the second rarest term of a window may be off its place in a proximity match.
SLOP = 2
#: Positions that share a bucket where lists are intersected with a tolerance.
BUCKET = 16


def words_of(text: Column) -> Column:
    """Words after lower-casing A-Z alone: runs of digits, a-z and all characters beyond ASCII; none for null."""
    given = F.coalesce(text.cast("string"), F.lit(""))
    # lower() also changes letters beyond ASCII, so it is used only where there are none
    lowered = F.when(F.octet_length(given) == F.length(given), F.lower(given)).otherwise(F.translate(given, string.ascii_uppercase, string.ascii_lowercase))
    return F.array_remove(F.split(lowered, SEPARATORS), "")


def marked(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, mark (a hash of the text, so that rows which share a doc_id stay apart) and text."""
    text = F.col(f"`{text_column}`").cast("string")
    return docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """term, n: occurrences in all documents of each of these terms that occurs. ``docs`` has text."""
    words = docs.select(F.explode(words_of(F.col("text"))).alias("term"))
    return words.join(sent_if_small(terms), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))


def write_postings(docs: DataFrame, terms: DataFrame, path: str) -> DataFrame:
    """Stores and returns the index: term, doc_id, mark, pos (the word's number, from 0) of each occurrence of these terms
    in documents (doc_id, mark, text).

    Files are Parquet, sorted by term. Equal rows of documents give equal postings.
    """
    found = docs.select("doc_id", "mark", F.posexplode(words_of(F.col("text"))).alias("pos", "term")).join(sent_if_small(terms), "term", "left_semi")
    found.select("term", "doc_id", "mark", "pos").sortWithinPartitions("term", "doc_id", "pos").write.mode("overwrite").parquet(path)
    return docs.sparkSession.read.parquet(path)


def windows_of(items: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """window (a hash of its words), words and item_id of each item's runs of ``size`` words, or of the whole item where it
    has fewer; and window and words alone, each window once."""
    worded = items.select("item_id", words_of(F.col("text")).alias("w")).filter(F.size("w") > 0).distinct()
    need = F.least(F.lit(size), F.size("w"))
    starts = worded.withColumn("start", F.explode(F.sequence(F.lit(1), F.size("w") - need + 1)))
    owned = starts.select("item_id", F.slice("w", F.col("start"), need).alias("words")).select("item_id", F.xxhash64("words").alias("window"), "words").distinct()
    return owned, owned.select("window", "words").distinct()


def ranked_terms(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """window and its terms as structs n, at (place in the window, from 0), term: the rarest first, the first of equals first.

    Windows with a term that no document has can't occur and are left out.
    """
    each = windows.select("window", F.size("words").alias("need"), F.posexplode("words").alias("at", "term"))
    ranked = each.join(counts, "term").groupBy("window", "need").agg(F.sort_array(F.collect_list(F.struct("n", "at", "term"))).alias("terms"))
    return ranked.filter(F.size("terms") == F.col("need")).select("window", "terms")


def near_windows(index: DataFrame, ranked: DataFrame, slop: int = SLOP) -> DataFrame:
    """window, doc_id, mark, start, off: postings of each window's rarest term, shifted to where the window would begin,
    and intersected with the shifted list of its next rarest one; ``off`` (0 to ``slop``) is how far that is from its place.

    Lists meet by buckets of positions, not by a range join. A window of one word is off by 0.
    """
    first, second = F.col("terms")[0], F.get("terms", F.lit(1))
    looked = ranked.select("window", first["term"].alias("term"), first["at"].alias("_at"), second["term"].alias("_term"), second["at"].alias("_next"))
    found = index.join(sent_if_small(settled(looked)), "term").withColumn("start", F.col("pos") - F.col("_at"))
    alone = found.filter(F.col("_term").isNull()).select("window", "doc_id", "mark", "start", F.lit(0).alias("off"))
    due = found.filter(F.col("_term").isNotNull()).withColumn("_due", F.col("start") + F.col("_next"))
    bucket = lambda c: F.floor(c / BUCKET)
    spots = F.sequence(bucket(F.col("_due") - slop), bucket(F.col("_due") + slop))
    a = due.select("window", F.col("doc_id").alias("_doc"), F.col("mark").alias("_mark"), "start", "_term", "_due", F.explode(spots).alias("_bucket"))
    b = index.withColumn("_own", bucket(F.col("pos")))
    on = (F.col("_term") == F.col("term")) & F.col("_doc").eqNullSafe(F.col("doc_id")) & (F.col("_mark") == F.col("mark")) & (F.col("_bucket") == F.col("_own"))
    off = F.abs(F.col("pos") - F.col("_due"))
    met = a.join(b, on & (off <= slop)).select("window", "doc_id", "mark", "start", off.alias("off"))
    return alone.union(met).groupBy("window", "doc_id", "mark", "start").agg(F.min("off").alias("off"))


def phrase_matches(docs: DataFrame, near: DataFrame, ranked: DataFrame, path: str) -> DataFrame:
    """window, doc_id, mark, start, need: where whole windows occur. ``near`` (checkpointed) comes from ``near_windows``.

    Where the two rarest terms are in place, the lists of all other terms are intersected as well. Those terms may be
    frequent, so their postings are stored for the candidate documents only, in a second index at ``path``.
    """
    exact = near.filter("off = 0").drop("off").join(ranked, "window")
    few = exact.filter(F.size("terms") <= 2).select("window", "doc_id", "mark", "start", F.size("terms").alias("need"))
    more = settled(exact.filter(F.size("terms") > 2))
    wanted = settled(more.select("window", "terms").distinct().select(F.explode(F.slice("terms", 3, 1 << 20)).alias("_x")).select("_x.term").distinct())
    held = settled(more.select(F.col("doc_id").alias("_doc"), F.col("mark").alias("_mark")).distinct())
    own = docs.join(sent_if_small(held), F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("mark") == F.col("_mark")), "left_semi")
    index = write_postings(own, wanted, path).distinct()
    rest = more.select("window", F.col("doc_id").alias("_doc"), F.col("mark").alias("_mark"), "start", F.size("terms").alias("need"), F.explode(F.slice("terms", 3, 1 << 20)).alias("_x"))
    rest = rest.select("window", "_doc", "_mark", "start", "need", F.col("_x.term").alias("_term"), (F.col("start") + F.col("_x.at")).alias("_pos"))
    on = (F.col("_term") == F.col("term")) & F.col("_doc").eqNullSafe(F.col("doc_id")) & (F.col("_mark") == F.col("mark")) & (F.col("_pos") == F.col("pos"))
    met = rest.join(index, on, "left_semi").groupBy("window", "_doc", "_mark", "start", "need").agg(F.count("*").alias("n"))
    return few.union(met.filter(F.col("n") == F.col("need") - 2).select("window", "_doc", "_mark", "start", "need"))


def proximity_matches(index: DataFrame, pairs: DataFrame, slop: int) -> DataFrame:
    """query_id, doc_id, pos_a, pos_b: occurrences of both terms of a query at most ``slop`` words apart.

    ``pairs`` has query_id, term_a, term_b. Positions meet by equal buckets of ``slop`` + 1 words, not by a range join.
    """
    width = slop + 1
    a = index.join(pairs, F.col("term") == F.col("term_a")).select("query_id", "doc_id", "mark", F.col("pos").alias("pos_a"), F.floor(F.col("pos") / width).alias("bucket"))
    b = index.join(pairs, F.col("term") == F.col("term_b")).select("query_id", F.col("doc_id").alias("_doc"), F.col("mark").alias("_mark"), F.col("pos").alias("pos_b"), F.floor(F.col("pos") / width).alias("_own"))
    b = b.withColumn("bucket", F.explode(F.array(F.col("_own") - 1, F.col("_own"), F.col("_own") + 1))).withColumnRenamed("query_id", "_query")
    same = (F.col("query_id") == F.col("_query")) & F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("mark") == F.col("_mark")) & (a["bucket"] == b["bucket"])
    return a.join(b, same & (F.abs(F.col("pos_a") - F.col("pos_b")) <= slop) & (F.col("pos_a") != F.col("pos_b"))).select("query_id", "doc_id", "pos_a", "pos_b")


def _covered(spans: Column) -> Column:
    """Words that sorted spans (begin, end exclusive) cover."""
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-(1 << 31)).alias("reach"))

    def add(state: Column, span: Column) -> Column:
        begin, reach = F.greatest(span["begin"], state["reach"]), F.greatest(span["end"], state["reach"])
        return F.struct((state["n"] + F.greatest(span["end"] - begin, F.lit(0))).cast("long").alias("n"), reach.alias("reach"))

    return F.aggregate(spans, none, add, lambda state: state["n"])


def contamination(docs: DataFrame, items: DataFrame, size: int = 10, slop: int = SLOP, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, mark (the hash of the text), item_ids and near_ids (sorted as text) and n_hit, of each document with a match.

    item_ids are the items of which a window of ``size`` words occurs, n_hit the document's words inside such occurrences;
    near_ids are those of which, in a window that could occur, the two rarest terms are in place but for ``slop`` words.
    An item of fewer words is one window; one without words, or null, has none, and neither has a null or empty text.
    Equal rows are one document; others that share a doc_id are documents of their own, which ``mark`` tells apart.
    Empty tables give no rows; other columns play no part. Texts are split for the test terms' counts, for their postings,
    and, of candidate documents alone, for the postings of all other terms; work is linear in a text.
    """
    spark = docs.sparkSession
    texts = marked(docs, id_column, text_column)
    owned, windows = windows_of(items.select("item_id", "text"), size)
    owned, windows = settled(owned.select("item_id", "window")), settled(windows)
    counts = settled(term_counts(texts, settled(windows.select(F.explode("words").alias("term")).distinct())))
    ranked = settled(ranked_terms(windows, counts))
    rarest = settled(ranked.select(F.explode(F.slice("terms", 1, 2)).alias("_x")).select("_x.term").distinct())
    paths = [scratch(spark, "postings"), scratch(spark, "postings")]
    near = settled(near_windows(write_postings(texts, rarest, paths[0]).distinct(), ranked, slop))
    exact = phrase_matches(texts, near, ranked, paths[1])
    every = near.select("window", "doc_id", "mark").distinct().select("*", F.lit(None).cast("int").alias("begin"), F.lit(None).cast("int").alias("need")).union(exact)
    span = F.when(F.col("begin").isNotNull(), F.struct("begin", (F.col("begin") + F.col("need")).alias("end")))
    spans = every.groupBy("doc_id", "mark").agg(F.sort_array(F.collect_set(span)).alias("spans"))
    item = F.col("item_id").cast("string")
    named = every.select("doc_id", "mark", "window", F.col("begin").isNotNull().alias("exact")).distinct().join(sent_if_small(owned), "window")
    named = named.groupBy("doc_id", "mark").agg(F.sort_array(F.collect_set(F.when(F.col("exact"), item))).alias("item_ids"), F.sort_array(F.collect_set(item)).alias("near_ids"))
    both = named.join(spans.select(F.col("doc_id").alias("_doc"), F.col("mark").alias("_mark"), _covered(F.col("spans")).alias("n_hit")), F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("mark") == F.col("_mark")))
    found = settled(both.select("doc_id", "mark", "item_ids", "near_ids", "n_hit"))
    for path in paths:
        discard(spark, path)
    return found


def decontaminate(docs: DataFrame, items: DataFrame, size: int = 10, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` without any occurrence of an item's window, with the same columns, whatever their names."""
    hit = settled(contamination(docs, items, size, id_column=id_column, text_column=text_column).filter("n_hit > 0").select(F.col("doc_id").alias("_doc"), F.col("mark").alias("_hit")))
    given = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{id_column}`").alias("_id"), F.xxhash64(F.col(f"`{text_column}`").cast("string")).alias("_mark"))
    return given.join(sent_if_small(hit), F.col("_id").eqNullSafe(F.col("_doc")) & (F.col("_mark") == F.col("_hit")), "left_anti").select("_row.*")
