"""Quality rules: base counts and distribution divergence, in DataFrame functions alone.

A document's character classes and common words are compared, as histograms, with those of each language reference by
the Jensen-Shannon distance (base 2, so 0 to 1).  The nearest reference counts.  A document whose nearest distance is
above a threshold is rejected, but only if it is long enough for its histogram to mean something (the guards).

One narrow pass over the texts: no shuffle, no broadcast, every document by itself.  Repeated three-word windows are
found by sorting (hash, place) packed in one long; neighbours with equal hashes are compared word by word, and a text in
which two different windows meet under one hash is sorted by the windows themselves.

Null and blank texts have no words: counts 0, base_failed true, kept false, distances null.  Null keys are kept,
repeated rows give a row each, other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mixlens.llm import common

#: Shares per mille of common words in running text of each language (fixed values; rounded, measured on prose).
WORD_REFERENCES = {
    "en": {"the": 50, "of": 30, "and": 20, "to": 16, "a": 14, "in": 12, "is": 9, "that": 8, "it": 7, "for": 6, "was": 6, "on": 6, "with": 5, "as": 4, "by": 4, "are": 4, "be": 4, "this": 4, "from": 3, "or": 3},
    "de": {"der": 47, "die": 30, "und": 20, "in": 16, "den": 13, "von": 10, "zu": 10, "das": 9, "sich": 8, "mit": 7, "des": 6, "auf": 5, "für": 5, "ist": 5, "dem": 4, "im": 4, "nicht": 4, "ein": 3, "eine": 3, "als": 3},
    "fr": {"de": 47, "la": 28, "le": 20, "et": 17, "les": 14, "des": 11, "en": 9, "un": 8, "du": 7, "une": 6, "est": 6, "que": 6, "qui": 5, "pour": 5, "dans": 5, "au": 4, "par": 4, "pas": 4},
    "es": {"de": 47, "la": 30, "que": 20, "el": 16, "en": 14, "y": 11, "del": 10, "los": 9, "se": 8, "las": 7, "un": 6, "por": 6, "con": 5, "no": 4, "una": 4, "para": 4, "su": 3, "es": 3, "lo": 3},
}
#: Shares per mille of character classes: lower a-z, upper A-Z, other letters, digits, punctuation, the rest (fixed).
CLASS_REFERENCES = {"en": (910, 40, 2, 6, 38, 4), "de": (856, 52, 45, 5, 38, 4), "fr": (822, 34, 100, 4, 36, 4), "es": (814, 46, 92, 4, 40, 4)}

SPACE = r"\x20\x09-\x0D"
SYMBOLS = "#*$%&|<>"
PUNCTUATION = r"""[.,;:!?'"()\-]"""


def common_words(word_references: dict[str, dict[str, int]] = WORD_REFERENCES) -> list[str]:
    return sorted({w for words in word_references.values() for w in words})


def references(words: dict[str, dict[str, int]], classes: dict[str, tuple[int, ...]]) -> tuple[list[list[float]], list[list[float]]]:
    """Word histograms (over all common words and the rest) and class histograms, a language each, from per mille."""
    names = common_words(words)
    return [[own.get(w, 0) / 1000 for w in names] + [1 - sum(own.values()) / 1000] for own in words.values()], [[x / sum(q) for x in q] for q in classes.values()]


def words_of(text: Column) -> Column:
    """The runs of characters that are no ASCII white space."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), lambda w: w != "")


def without_space(text: Column) -> Column:
    for c in " \t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def divergence(p: Column, q: list[float]) -> Column:
    """Jensen-Shannon distance of a histogram column to a fixed one: the root of the divergence in bits."""

    def term(x: Column, y: Column) -> Column:
        m = (x + y) / 2
        return F.when(x > 0, x * F.log2(x / m)).otherwise(0.0) + F.when(y > 0, y * F.log2(y / m)).otherwise(0.0)

    terms = F.zip_with(p, F.array(*map(F.lit, q)), term)
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2, F.lit(0.0)))


def nearest(p: Column, references: list[list[float]]) -> Column:
    return F.array_min(F.array(*(divergence(p, q) for q in references)))


def repeated_words(words: Column, n: Column, keys: Column) -> Column:
    """How many words lie in a three-word window that the text holds twice or more.  ``keys``: sorted longs, 40 bits of
    the window's hash above 23 bits of its place; null if no two windows have one hash."""
    place = lambda k: F.element_at(keys, k).bitwiseAND(0x7FFFFF).cast("int")
    near = lambda k: F.shiftright(F.element_at(keys, k), 23) == F.shiftright(F.element_at(keys, k + 1), 23)

    def same(k: Column) -> Column:
        a, b = place(k), place(k + 1)
        return (F.get(words, a) == F.get(words, b)) & (F.get(words, a + 1) == F.get(words, b + 1)) & (F.get(words, a + 2) == F.get(words, b + 2))

    # places k at which sorted neighbours k and k + 1 agree
    runs = F.filter(F.sequence(F.lit(1), n - 3), near)
    clean = F.forall(runs, same)
    quick = F.flatten(F.transform(runs, lambda k: F.array(place(k), place(k + 1))))
    windows = F.array_sort(F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.concat_ws(" ", F.slice(words, i + 1, 3)).alias("w"), i.cast("int").alias("i"))))
    slow_runs = F.filter(F.sequence(F.lit(1), n - 3), lambda k: F.element_at(windows, k)["w"] == F.element_at(windows, k + 1)["w"])
    slow = F.flatten(F.transform(slow_runs, lambda k: F.array(F.element_at(windows, k)["i"], F.element_at(windows, k + 1)["i"])))
    starts = F.when(clean & (n < 1 << 23), quick).otherwise(slow)
    covered = F.flatten(F.transform(starts, lambda i: F.array(i, i + 1, i + 2)))
    return F.when((n < 4) | keys.isNull(), 0).otherwise(F.size(F.array_distinct(covered))).cast("long")


def assess(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    max_class_distance: float = 0.20,
    max_word_distance: float = 0.30,
    min_letters: int = 200,
    min_words: int = 150,
    word_references: dict[str, dict[str, int]] = WORD_REFERENCES,
    class_references: dict[str, tuple[int, ...]] = CLASS_REFERENCES,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """``doc_id``, the base counts, ``class_distance`` and ``word_distance`` to the nearest reference, ``kept``.
    ``min_letters`` and ``min_words`` are the guards of the two distances; below them a distance rejects nothing.  The
    references are per mille of common words and of character classes by language; a language more is an entry more.  The
    columns named in ``carry`` go along in the struct ``carried``, with a ``row_mark``."""
    names = common_words(word_references)
    word_refs, class_refs = references(word_references, class_references)
    c = F.col
    along = F.struct(*(F.col(f"`{name}`") for name in carry)) if carry else F.lit(None).cast("string")
    rows = df.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"), along.alias("carried"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.length(F.trim(F.translate(x, "\t\x0b\x0c\r", "    "))) > 0)
    rows = rows.select(
        "doc_id",
        "carried",
        words_of(c("text")).alias("words"),
        F.length(without_space(c("text"))).alias("word_chars"),
        F.regexp_replace("text", rf"[a-z{SPACE}]+", "").alias("odd"),
        lines.alias("lines"),
    )
    # 40 bits of each window; only a text in which some are equal is sorted
    hashes = F.transform(F.sequence(F.lit(0), c("n_words") - 3), lambda i: F.shiftrightunsigned(F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)), 24))
    rows = rows.select(
        "doc_id",
        "carried",
        "words",
        F.size("words").alias("n_words"),
        c("word_chars").cast("long"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.regexp_count("odd", F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        F.array(
            c("word_chars") - F.length("odd"),
            F.regexp_count("odd", F.lit("[A-Z]")),
            F.regexp_count("odd", F.lit(r"\p{L}")) - F.regexp_count("odd", F.lit("[A-Z]")),
            F.regexp_count("odd", F.lit("[0-9]")),
            F.regexp_count("odd", F.lit(PUNCTUATION)),
        ).alias("classes"),
        F.concat(F.lit("|"), F.array_join(F.filter("words", lambda w: F.lower(w).isin(names)), "||"), F.lit("|")).alias("common"),
    )
    rows = rows.withColumn("windows", F.when(c("n_words") >= 4, hashes)).withColumn("common", F.lower("common"))
    keys = F.sort_array(F.transform("windows", lambda h, i: F.shiftleft(h, 23).bitwiseOR(i.cast("long"))))
    rows = rows.withColumn("keys", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), keys))
    count = lambda w: (F.octet_length("common") - F.octet_length(F.replace(c("common"), F.lit(f"|{w}|"), F.lit("")))) / (len(w.encode()) + 2)
    rows = rows.select(
        "doc_id",
        "carried",
        c("n_words").cast("long"),
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        repeated_words(c("words"), c("n_words"), c("keys")).alias("n_repeat_words"),
        F.transform(F.concat("classes", F.array(c("word_chars") - F.aggregate("classes", F.lit(0), lambda a, x: a + x))), lambda x: x / F.greatest(c("word_chars"), F.lit(1))).alias("p_class"),
        F.transform(F.array(*map(count, names)), lambda x: x / F.greatest(c("n_words"), F.lit(1))).alias("p_word"),
    )
    rows = rows.withColumn("p_word", F.concat("p_word", F.array(1 - F.aggregate("p_word", F.lit(0.0), lambda a, x: a + x))))
    rows = rows.withColumn("base_failed", (c("n_words") < 50) | (100 * c("n_repeat_words") > 50 * c("n_words")))
    rows = rows.withColumn("class_distance", F.when(c("n_words") > 0, nearest(c("p_class"), class_refs)))
    rows = rows.withColumn("word_distance", F.when(c("n_words") > 0, nearest(c("p_word"), word_refs)))
    far = ((c("word_chars") >= min_letters) & (c("class_distance") > max_class_distance)) | ((c("n_words") >= min_words) & (c("word_distance") > max_word_distance))
    rows = rows.withColumn("kept", ~c("base_failed") & ~F.coalesce(far, F.lit(False))).drop("p_class", "p_word", *([] if carry else ["carried"]))
    return rows.withColumn("row_mark", F.monotonically_increasing_id()) if carry else rows


def kept_rows(df: DataFrame, columns: tuple[str, ...], **parameters) -> DataFrame:
    """The rows of ``df`` that pass, with ``columns`` alone.  The filter also reads the row mark, which isn't
    deterministic: so it stays above the projections instead of repeating all of their expressions at the scan."""
    return assess(df, carry=columns, **parameters).where("kept AND row_mark >= 0").select("carried.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules over every document; distances to six places."""
    found = assess(common.table(spark, sf_dir, "documents"))
    return found.withColumns({c: F.round(c, 6) for c in ("class_distance", "word_distance")})
