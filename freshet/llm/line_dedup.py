"""Line deduplication across documents: equal lines, and lines one edit apart, keep their earliest occurrence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sent_if_small, settled, spread

SPACE = " \t\n\x0b\f\r"


def numbered_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, mark, line_no (from 0), line: trimmed lines of at least ``min_chars`` characters; ``docs`` has doc_id, mark, text."""
    lines = docs.select("doc_id", "mark", F.posexplode(F.split("text", "\n")).alias("line_no", "_raw"))
    return lines.select("doc_id", "mark", "line_no", F.btrim("_raw", F.lit(SPACE)).alias("line")).filter(F.length("line") >= min_chars)


def identity(line: Column) -> list[Column]:
    """Two independent 64-bit hashes, which stand for a line's content."""
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2")]


def half_keys(line: Column) -> list[Column]:
    """Hashes of almost the first and the last half, for the line's length class; again for the next class where a line
    with one character more lies in it, else null.

    One edit leaves the first or the last half of both lines alone, so lines an edit apart have a key in common. Lines
    without one need no variants; this test costs a few hashes where the variants cost one for each character.
    """
    n = F.length(line)
    keys = []
    for size in (n, n + 1):
        kind = F.floor(size / 4).cast("int")
        half = 2 * kind - 1
        pair = [F.xxhash64(kind, F.lit(0), F.substring(line, F.lit(1), half)), F.xxhash64(kind, F.lit(1), F.substring(line, n - half + 1, half))]
        keys += pair if size is n else [F.when(size % 4 == 0, k) for k in pair]
    return [k.alias(f"k{i}") for i, k in enumerate(keys)]


def segment_neighbours(contents: DataFrame, segments: int = 16) -> DataFrame:
    """The contents (first, line) that equal another one outside a segment of their characters, and spots: the characters
    (from 1) of those segments, and 0.

    For the longer line's length, the line itself or one character more, all but each of ``segments`` stretches is
    hashed: the part before it from the left and the part behind it from the right. One edit lies in one segment, so
    lines an edit apart have such a hash in common, and the longer one's edited character is among its spots.
    """
    longer = contents.select("first", "line", F.explode(F.array(F.length("line"), F.length("line") + 1)).alias("longer"))
    wide = F.ceil(F.col("longer") / segments).cast("int")
    cuts = longer.withColumn("wide", wide).withColumn("segment", F.explode(F.sequence(F.lit(0), F.ceil(F.col("longer") / F.col("wide")).cast("int") - 1)))
    before, n = F.col("segment") * F.col("wide"), F.length("line")
    behind = F.greatest(F.col("longer") - before - F.col("wide"), F.lit(0))
    outside = F.xxhash64("longer", "segment", F.substring("line", F.lit(1), before), F.substring("line", n - behind + 1, behind))
    own = F.when(F.col("longer") == n, F.sequence(before + 1, F.least(before + F.col("wide"), n))).otherwise(F.array(F.lit(0)))
    keyed = cuts.select("first", outside.alias("key"), own.alias("spots"))
    shared = keyed.groupBy("key").agg(F.min("first").alias("a"), F.max("first").alias("b")).filter("a != b").select("key")
    near = keyed.join(shared, "key", "left_semi").groupBy("first").agg(F.array_union(F.array(F.lit(0)), F.flatten(F.collect_list("spots"))).alias("spots"))
    return contents.join(near, "first")


def deletions(contents: DataFrame) -> DataFrame:
    """The deletion neighbourhood of each content (first, line, spots): doc_id, mark and line_no of ``first``, spot (the deleted
    character, from 1; 0 for the line itself), and two hashes of the variant, v1 and v2."""
    each = contents.select("first", "line", F.explode("spots").alias("spot"))
    cut = F.concat(F.substring("line", F.lit(1), F.col("spot") - 1), F.substring("line", F.col("spot") + 1, F.length("line")))
    text = F.when(F.col("spot") == 0, F.col("line")).otherwise(cut)
    return each.select(F.xxhash64(text).alias("v1"), F.xxhash64(F.lit(1), text).alias("v2"), "spot", "first.doc_id", "first.mark", "first.line_no")


def earlier_neighbours(contents: DataFrame) -> DataFrame:
    """first of each content (first, line, spots) with an earlier one a single edit away.

    Contents that agree after deletion at the same spot differ by a substitution there, all of them from each other, so
    each is compared with the earliest only. One that equals another's deletion differs by an insertion. So a variant
    meets one row, not all others of its group; edit distances are verified on the lines. A variant has at most as many
    contents as ways to insert a character.
    """
    place = F.struct("doc_id", "mark", "line_no")
    dealt = deletions(contents).repartition("v1", "v2")
    shared = dealt.groupBy("v1", "v2").agg(F.min(place).alias("a"), F.max(place).alias("b")).filter("a != b").select("v1", "v2")
    variants = settled(dealt.join(shared, ["v1", "v2"], "left_semi").withColumn("first", place).drop("doc_id", "mark", "line_no"))
    cut, full = variants.filter("spot > 0"), variants.filter("spot = 0")
    least = cut.groupBy("v1", "v2", "spot").agg(F.min("first").alias("other"))
    changed = cut.join(least, ["v1", "v2", "spot"]).select("first", "other")
    inserted = cut.join(full.select("v1", "v2", F.col("first").alias("other")), ["v1", "v2"]).select("first", "other")
    pairs = changed.union(inserted).union(inserted.select("other", "first")).toDF("first", "other").filter("other < first").distinct()
    line_of = lambda c, name: contents.select(F.col("first").alias(c), F.col("line").alias(name))
    met = pairs.join(line_of("first", "line"), "first").join(line_of("other", "_line"), "other")
    near = F.levenshtein("line", "_line", 1)
    return met.filter((near >= 0) & (near <= 1)).select("first").distinct()


def repeated_lines(docs: DataFrame, min_chars: int = 20, edits: int = 1, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, mark (a hash of the text) and removed: the numbers of the lines that repeat an earlier one, for documents
    that have such lines.

    A line goes where an equal line, or one within ``edits`` (0 or 1) insertions, deletions or substitutions, stands
    earlier, by doc_id, mark and line number, in any document; all lines are judged on the input. White space around lines
    doesn't count, and lines of fewer than ``min_chars`` (8 at least) characters stay. Rows that share a doc_id, or have
    none, are documents of their own, but equal rows are one and lose the same lines. Null doc_ids come first, null and
    empty texts have no line, and an empty table gives no rows. Only lines' hashes and places are shuffled, and texts not
    while the measured table of repeated lines can be sent to every executor.
    """
    if edits not in (0, 1) or min_chars < 8:
        raise ValueError("edits is 0 or 1, min_chars 8 or more")
    text = F.col(f"`{text_column}`").cast("string")
    lines = numbered_lines(docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text")), min_chars)
    marked = settled(lines.select("doc_id", "mark", "line_no", *identity(F.col("line")), *(half_keys(F.col("line")) if edits else [])))
    place = F.struct("doc_id", "mark", "line_no")
    # equal rows of the table are one place
    contents = settled(marked.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last")))
    if edits:
        keyed = marked.select("h1", "h2", F.explode(F.array_compact(F.array("k0", "k1", "k2", "k3"))).alias("key"))
        shared = keyed.groupBy("key").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).filter("a != b").select("key")
        near = keyed.join(shared, "key", "left_semi").select("h1", "h2").distinct()
        wanted = settled(near.join(contents, ["h1", "h2"]).select("h1", "h2", "first"))
        found = lines.select("doc_id", "mark", "line_no", "line", *identity(F.col("line"))).join(sent_if_small(wanted), ["h1", "h2"])
        with_text = settled(spread(found.filter(place == F.col("first")).select("first", "line").distinct(), "first"))
        late = settled(earlier_neighbours(settled(spread(segment_neighbours(with_text), "first"))).withColumn("late", F.lit(True)))
        contents = contents.join(late, "first", "left").withColumn("late", F.coalesce("late", F.lit(False)))
    else:
        contents = contents.withColumn("late", F.lit(False))
    touched = contents.filter("late or last != first").select("h1", "h2", "first", "late")
    met = marked.select("h1", "h2", "doc_id", "mark", "line_no").join(touched, ["h1", "h2"])
    gone = met.filter(F.col("late") | (place != F.col("first")))
    return gone.groupBy("doc_id", "mark").agg(F.sort_array(F.collect_set("line_no")).alias("removed"))


def cut_lines(docs: DataFrame, gone: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """_row (a struct of the columns of ``docs``), text without the numbered lines, lines (of the whole text, none for null)
    and removed (the numbers that were cut). Null texts and untouched rows stay as they are."""
    listed = settled(gone.select(F.col("doc_id").alias("_gone_id"), F.col("mark").alias("_gone_mark"), F.col("removed").alias("_removed")))
    text = F.col(f"`{text_column}`").cast("string")
    given = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{id_column}`").alias("_id"), F.xxhash64(text).alias("_mark"), text.alias("_text"))
    lines = F.when(F.col("_text").isNull(), F.array().cast("array<string>")).otherwise(F.split("_text", "\n"))
    joined = given.withColumn("lines", lines).join(sent_if_small(listed), F.col("_id").eqNullSafe(F.col("_gone_id")) & (F.col("_mark") == F.col("_gone_mark")), "left")
    joined = joined.withColumn("removed", F.coalesce("_removed", F.array().cast("array<int>")))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("removed"))
    kept = F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n")
    return joined.select("_row", F.when(F.size("removed") > 0, kept).otherwise(F.col("_text")).alias("text"), "lines", "removed")


def dedup_lines(docs: DataFrame, min_chars: int = 20, edits: int = 1, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` without the lines that ``repeated_lines`` finds. Every row stays, if need be with an empty text."""
    cut = cut_lines(docs, repeated_lines(docs, min_chars, edits, id_column, text_column), id_column, text_column)
    return cut.select(*[(F.col("text") if c == text_column else F.col("_row").getField(c)).alias(c) for c in docs.columns])
