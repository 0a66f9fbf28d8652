"""Quality rules: counts per document, and its distance from language references."""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import released, sent_if_small, settled

# Frequent short words of four languages, in lower case.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "it", "for", "was", "on", "with", "as", "be", "at", "by", "this", "from", "or", "not"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "une", "du", "que", "qui", "dans", "est", "pour", "par", "sur", "pas", "au", "il"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "ist", "im", "dem", "nicht", "ein", "eine", "auf", "als", "auch", "es"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "se", "del", "las", "por", "un", "con", "no", "una", "su", "para", "es", "al", "lo"],
}
# Marks that don't belong to the word at whose edge they stand.
EDGES = ".,;:!?\"'()[]{}<>*_-«»“”„¿¡…"
# ASCII character classes that are counted; small letters are what is left.
CLASSES = {
    "capital": "[A-Z]",
    "digit": "[0-9]",
    "point": "[.,;:?'\"()-]",
    "mark": "[!#*$%&|<>=@_~^/\\\\\\[\\]{}+`]",
}
SPACE = " \t\n\x0b\f\r"
WINDOW = 5


@dataclass(frozen=True)
class Rules:
    """Limits of the verdict. A histogram counts only where the text is long enough for it."""

    min_words: int = 10
    max_repeat_percent: int = 20
    word_guard: int = 60
    char_guard: int = 200
    max_word_distance: float = 0.28
    max_char_distance: float = 0.30


def vocabulary() -> list[str]:
    return list(dict.fromkeys(word for words in COMMON_WORDS.values() for word in words))


def words_of(text: Column) -> Column:
    """Runs of characters other than space and U+0009 to U+000D; none for null."""
    trimmed = F.btrim(text, F.lit(SPACE))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, "[\\x20\\x09-\\x0D]+")).otherwise(F.array().cast("array<string>"))


def _count(text: Column, pattern: str) -> Column:
    """How many characters match a class of ASCII characters."""
    return (F.octet_length(text) - F.octet_length(F.regexp_replace(text, pattern, ""))).cast("long")


def with_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds _text (null as empty), _words and _n_words."""
    named = docs.withColumn("_text", F.coalesce(F.col(text).cast("string"), F.lit("")))
    return named.withColumn("_words", words_of(F.col("_text"))).withColumn("_n_words", F.size("_words").cast("long"))


def histograms(worded: DataFrame) -> DataFrame:
    """Adds _common (count of each vocabulary word, then of the rest) and _chars (count of each class, then of the rest).

    Words count without marks at their edges and with A-Z in small letters.
    """
    listed = F.array(*[F.lit(w) for w in vocabulary()])
    longest = max(len(w) for w in vocabulary())
    # what has letters and is too long stays too long without its edges, so only short words are folded one by one
    bare = F.transform("_words", lambda w: F.btrim(w, F.lit(EDGES)))
    short = F.transform(F.filter(bare, lambda w: F.length(w) <= longest), lambda w: F.translate(w, string.ascii_uppercase, string.ascii_lowercase))
    places = F.filter(F.transform(short, lambda w: F.array_position(listed, w)), lambda p: p > 0)
    placed = worded.withColumn("_places", places)
    each = F.transform(F.sequence(F.lit(1), F.lit(len(vocabulary()))), lambda k: (F.size("_places") - F.size(F.array_remove("_places", k.cast("long")))).cast("long"))
    classes = [_count(F.col("_text"), pattern) for pattern in CLASSES.values()]
    wide = (F.octet_length("_text") - F.length("_text")).cast("long")
    counted = placed.withColumn("_common", F.concat(each, F.array(F.col("_n_words") - F.size("_places")))).withColumn("_counted", F.array(*classes, wide)).withColumn("_word_chars", F.length(F.concat_ws("", "_words")).cast("long"))
    rest = F.greatest(F.lit(0), F.col("_word_chars") - F.aggregate("_counted", F.lit(0).cast("long"), lambda a, x: a + x))
    return counted.withColumn("_chars", F.concat("_counted", F.array(rest))).drop("_places", "_counted")


def fails(rules: Rules) -> Column:
    """The base rules' verdict on a measured row."""
    return (F.col("_n_words") < rules.min_words) | (100 * F.col("_n_repeat") > rules.max_repeat_percent * F.col("_n_words"))


def references_of(measured: DataFrame, rules: Rules = Rules()) -> dict[str, tuple[list[float], list[float]]]:
    """Word and character distributions of each listed language, summed over all its long enough documents that pass the
    base rules.

    ``measured`` has the columns of ``measure``. Only sums leave the executors: languages times bins numbers, whatever the
    input's size. A language without documents has no reference.
    """
    used = measured.filter(F.col("_lang").isin(list(COMMON_WORDS)) & (F.col("_n_words") >= rules.word_guard) & ~fails(rules))
    bins = {"_common": len(vocabulary()) + 1, "_chars": len(CLASSES) + 2}
    sums = [F.sum(F.col(c)[i]).alias(f"{c}{i}") for c, n in bins.items() for i in range(n)]
    found = {}
    for row in used.groupBy("_lang").agg(*sums).collect():
        both = tuple([row[f"{c}{i}"] / max(1, sum(row[f"{c}{j}"] for j in range(n))) for i in range(n)] for c, n in bins.items())
        found[row["_lang"]] = both
    return found


def language_references(docs: DataFrame, rules: Rules = Rules(), text: str = "text", lang: str = "lang") -> dict[str, tuple[list[float], list[float]]]:
    """``references_of`` plain documents."""
    return references_of(settled(measure(docs, text, lang, []).drop("_row")), rules) if lang in docs.columns else {}


def jensen_shannon(counts: Column, total: Column, reference: list[float]) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of a histogram of counts, ``total`` in all, from a reference distribution."""
    q = F.array(*[F.lit(float(x)) for x in reference])

    def term(n: Column, r: Column) -> Column:
        p = n / total
        m = (p + r) / 2
        return F.when(n > 0, p * F.log2(p / m) + F.when(r > 0, r * F.log2(r / m)).otherwise(F.lit(0.0)) - r).otherwise(F.lit(0.0))

    # bins that the document lacks add their share of the reference, whose sum is 1
    twice = F.aggregate(F.zip_with(counts, q, term), F.lit(1.0), lambda a, x: a + x)
    return F.sqrt(F.greatest(F.lit(0.0), twice / 2))


def repeated_words(worded: DataFrame) -> DataFrame:
    """Adds _n_repeat: words inside 5-word windows that occur twice or more in the text.

    Window hashes are sorted with their positions in the low bits, so equal windows are neighbours; neighbours with
    equal high bits are compared word by word. The work is n log n in the text's words.
    """
    n = F.col("_n_words")
    worded = worded.withColumn("_each", F.transform("_words", lambda w: F.xxhash64(w)))
    first = F.slice("_each", F.lit(1), F.greatest(n - WINDOW + 1, F.lit(0)).cast("int"))
    hashes = F.when(n >= WINDOW, F.transform(first, lambda h, i: F.xxhash64(h, *[F.get("_each", i + k) for k in range(1, WINDOW)])))
    hashed = worded.withColumn("_hashes", hashes).drop("_each")
    low = F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(n, F.lit(1)).cast("double"))) + 1).cast("long") - 1
    hashed = hashed.withColumn("_again", F.size(F.array_distinct("_hashes")) < F.size("_hashes")).withColumn("_low", low)
    packed = F.sort_array(F.transform("_hashes", lambda h, i: h.bitwiseAND(F.bitwise_not("_low")).bitwiseOR(i.cast("long"))))
    sorted_ = hashed.withColumn("_sorted", F.when(F.col("_again"), packed))

    def same(x: Column, y: Column) -> Column:
        near = x.bitwiseXOR(y).bitwiseAND(F.bitwise_not("_low")) == 0
        at = lambda z: F.slice("_words", z.bitwiseAND(F.col("_low")).cast("int") + 1, WINDOW)
        return F.coalesce(near & (at(x) == at(y)), F.lit(False))

    found = F.filter("_sorted", lambda x, j: same(x, F.get("_sorted", j - 1)) | same(x, F.get("_sorted", j + 1)))
    spots = sorted_.withColumn("_spots", F.sort_array(F.transform(found, lambda x: x.bitwiseAND(F.col("_low")))))
    steps = F.transform("_spots", lambda p, k: F.least(F.lit(WINDOW).cast("long"), F.coalesce(F.get("_spots", k + 1) - p, F.lit(WINDOW).cast("long"))))
    total = F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)
    return spots.withColumn("_n_repeat", F.coalesce(total, F.lit(0).cast("long"))).drop("_hashes", "_again", "_low", "_sorted", "_spots")


def measure(docs: DataFrame, text: str = "text", lang: str = "lang", kept: list[str] | None = None) -> DataFrame:
    """_row (the columns ``kept`` of ``docs``, by default all), _lang, the histograms _common and _chars with _n_words and
    _n_letters, and the counts _word_chars, _n_symbols, _n_dup_lines and _n_repeat. A null text counts as empty."""
    language = F.col(f"`{lang}`").cast("string") if lang in docs.columns else F.lit(None).cast("string")
    own = [F.col(f"`{c}`") for c in (docs.columns if kept is None else kept)]
    given = docs.select((F.struct(*own) if own else F.lit(None)).alias("_row"), language.alias("_lang"), F.col(f"`{text}`").alias("_given"))
    measured = repeated_words(histograms(with_words(given, "_given")))
    lines = F.filter(F.split("_text", "\n"), lambda line: F.length(F.btrim(line, F.lit(SPACE))) > 0)
    measured = measured.withColumn("_lines", lines)
    counts = {
        "_n_letters": F.aggregate("_chars", F.lit(0).cast("long"), lambda a, x: a + x),
        "_n_symbols": _count(F.col("_text"), "[#*$%&|<>]"),
        "_n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
    }
    return measured.select("_row", "_lang", "_common", "_chars", "_n_words", "_word_chars", "_n_repeat", *[c.alias(n) for n, c in counts.items()])


def verdict(measured: DataFrame, rules: Rules, references: dict[str, tuple[list[float], list[float]]]) -> DataFrame:
    """_row, and quality, a struct: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    word_distance, char_distance, kept."""
    n, repeat = F.col("_n_words"), F.col("_n_repeat")

    def nearest(column: str, total: str, at: int, guard: Column) -> Column:
        if not references:
            return F.lit(None).cast("double")
        each = [jensen_shannon(F.col(column), F.col(total), ref[at]) for _, ref in sorted(references.items())]
        known = F.coalesce(F.col("_lang").isin(list(references)), F.lit(True))
        return F.when(guard & known, F.least(*each) if len(each) > 1 else each[0])

    word = nearest("_common", "_n_words", 0, n >= rules.word_guard)
    char = nearest("_chars", "_n_letters", 1, F.col("_word_chars") >= rules.char_guard)
    judged = measured.withColumn("_word_distance", word).withColumn("_char_distance", char)
    failed = fails(rules)
    far = F.coalesce(F.col("_word_distance") > rules.max_word_distance, F.lit(False)) | F.coalesce(F.col("_char_distance") > rules.max_char_distance, F.lit(False))
    quality = F.struct(
        n.alias("n_words"),
        F.col("_word_chars").alias("word_chars"),
        F.col("_n_symbols").alias("n_symbols"),
        F.col("_n_dup_lines").alias("n_dup_lines"),
        repeat.alias("n_repeat_words"),
        failed.alias("base_failed"),
        F.col("_word_distance").alias("word_distance"),
        F.col("_char_distance").alias("char_distance"),
        (~failed & ~far).alias("kept"),
    )
    return judged.select("_row", quality.alias("quality"))


def judge(docs: DataFrame, rules: Rules = Rules(), references: dict[str, tuple[list[float], list[float]]] | None = None, text: str = "text", lang: str = "lang") -> DataFrame:
    """_row, a struct of all columns of ``docs``, whatever their names, and ``quality`` (see ``verdict``).

    Distances are to the nearest language reference, so a null ``lang``, or one taken for another, does no harm; they are
    null below the guards, where a histogram is too small to judge, and for a ``lang`` that has no reference.
    ``references`` default to those of ``docs``, which then are read twice. A null or empty text has no words and fails
    the base rule. Equal rows get equal verdicts; an empty table gives no rows.
    """
    references = language_references(docs, rules, text, lang) if references is None else references
    return verdict(measure(docs, text, lang), rules, references)


def judge_once(docs: DataFrame, rules: Rules = Rules(), text: str = "text", lang: str = "lang") -> DataFrame:
    """``judge`` without the texts in _row: they are read once, and their counts are checkpointed for both steps."""
    measured = settled(measure(docs, text, lang, [c for c in docs.columns if c != text]))
    return verdict(measured, rules, references_of(measured, rules))


def keep_good(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the same columns.

    Texts are measured once. A verdict depends on text and language alone, so only the counts are checkpointed, with two
    hashes of both, and the rows whose hashes fail are left out of ``docs``, which is read again and has to give the same
    rows. No text is stored, nor shuffled while the measured hashes can be sent to every executor.
    """
    text, lang = F.col("text").cast("string"), F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    # hashes pass nulls over, so a null language is told apart
    known = [text, F.coalesce(lang, F.lit("")), lang.isNull()]
    hashes = [F.xxhash64(*known).alias("_h1"), F.xxhash64(F.lit(1), *known).alias("_h2")]
    measured = settled(measure(docs.select(text.alias("text"), lang.alias("lang"), *hashes), kept=["_h1", "_h2"]))
    judged = verdict(measured, rules, references_of(measured, rules))
    failed = settled(judged.filter(~F.coalesce("quality.kept", F.lit(False))).select("_row.*").distinct())
    released(measured)
    given = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *hashes)
    return given.join(sent_if_small(failed), ["_h1", "_h2"], "left_anti").select("_row.*")
