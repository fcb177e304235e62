"""Quality rules: whole-text counts, and cross-document line frequency.

DataFrame functions only. Lines are normalised (lower case, numbers to 0, white
space to single spaces) and hashed; a line that more than ``LINE_DOCS``
distinct documents of one host (column source) hold is boilerplate there. A
document is rejected if the rules on its own text fail, or if without its
boilerplate lines it is depleted: fewer than ``LEAST_WORDS`` words left, or less than
``LEAST_SHARE`` of its words. ``remove_lines`` gives the kept documents without
their boilerplate lines.

Everything on one text is an expression over the row; texts are shuffled only
where the join with their boilerplate line hashes is too large to broadcast.
Line hashes are found once and written. Line counts are pre-aggregated before each shuffle and joins are left to
adaptive skew handling; hosts and lines of any frequency are spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from almagest.llm.common import WORD, as_row, doc_key, text_key, written

LINE_DOCS = 50
LEAST_WORDS = 50
LEAST_SHARE = 0.5
_SPACE = r"[\x20\x09-\x0D]+"


def _repeated_words(grams: str = "grams", words: str = "n_words") -> Column:
    """Words in windows of three that occur twice or more. Window hashes are
    sorted together with their places: as one long of 44 hash bits and 20 place
    bits; as structs in texts of a million words or more, or where different
    hashes agree in those bits."""
    def covered(places: str) -> str:
        return f"size(array_distinct(flatten(transform({places}, p -> array(p, p + 1, p + 2)))))"

    packed = f"sort_array(transform({grams}, (g, i) -> (g & -1048576L) | i))"
    alike = lambda o: f"(s[{o}] & -1048576L) = (x & -1048576L)"
    whole = lambda x: f"{grams}[cast({x} & 1048575L AS int)]"
    mixed = f"size(filter(s, (x, i) -> i > 0 AND {alike('i - 1')} AND {whole('s[i - 1]')} <> {whole('x')})) > 0"
    short = (f"transform(filter(s, (x, i) -> (i > 0 AND {alike('i - 1')}) OR (i < size(s) - 1 AND {alike('i + 1')})), "
             f"x -> cast(x & 1048575L AS int))")
    pairs = f"sort_array(transform({grams}, (g, i) -> struct(g, i)))"
    long = (f"transform(array({pairs}), s -> transform(filter(s, (x, i) -> "
            f"(i > 0 AND s[i - 1].g = x.g) OR (i < size(s) - 1 AND s[i + 1].g = x.g)), x -> x.i))[0]")
    return F.expr(f"CASE WHEN size(array_distinct({grams})) = size({grams}) THEN 0 "
                  f"WHEN {words} < 1048576 THEN transform(array({packed}), s -> "
                  f"CASE WHEN {mixed} THEN {covered(long)} ELSE {covered(short)} END)[0] "
                  f"ELSE {covered(long)} END").cast("long")


def text_rules(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Keys and the counts of every row's own text (null: no words); columns
    named in carry stay."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), doc_key().alias("k1"), text_key().alias("k2"),
                       text.alias("text"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"), *carry)
    lines = F.expr(f"filter(split(text, '\\n'), x -> x rlike r'{WORD}')")
    rows = rows.select(
        *carry, "doc_id", "k1", "k2", F.size("words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", _SPACE, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        F.expr("CASE WHEN size(words) < 3 THEN array() ELSE transform(sequence(0, size(words) - 3), "
               "i -> xxhash64(words[i], words[i + 1], words[i + 2])) END").cast("array<long>").alias("grams"))
    rows = rows.select(*carry, "doc_id", "k1", "k2", "n_words", "word_chars", "n_symbols",
                       (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
                       _repeated_words().alias("n_repeat_words"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


#: A line x as it is compared.
_PLAIN_LINE = f"trim(regexp_replace(regexp_replace(lower(x), '[0-9]+', '0'), r'{_SPACE}', ' '))"


def hashed_lines(docs: DataFrame) -> DataFrame:
    """host, keys and line (hash) of every line with a word."""
    each = F.expr(f"transform(filter(split(coalesce(cast(text AS string), ''), '\\n'), x -> x rlike r'{WORD}'), "
                  f"x -> xxhash64({_PLAIN_LINE}))")
    return docs.select(F.col("source").cast("string").alias("host"), doc_key().alias("k1"), text_key().alias("k2"),
                       F.explode(each).alias("line"))


def boilerplate(lines: DataFrame, most: int = LINE_DOCS) -> DataFrame:
    """host and line of those in more than ``most`` distinct documents."""
    once = lines.select("host", "line", "k1", "k2").distinct()
    return once.groupBy("host", "line").agg(F.count(F.lit(1)).alias("docs")).filter(F.col("docs") > most)


def _judged(spark: SparkSession, docs: DataFrame, most: int) -> DataFrame:
    """Rule columns of every row, its columns as struct __row and its text
    without boilerplate lines as __left (a text without any stays as it is)."""
    lines = written(spark, hashed_lines(docs), "lines")
    often = boilerplate(lines, most)
    same = lines["host"].eqNullSafe(often["host"]) & (lines["line"] == often["line"])
    gone = lines.join(often, same, "left_semi").groupBy("host", F.col("k1").alias("__k1"), F.col("k2").alias("__k2")).agg(
        F.collect_set("line").alias("__gone")).withColumnRenamed("host", "__host")
    own = docs.select(as_row(docs).alias("__row"), "doc_id", "text",
                      F.col("source").cast("string").alias("__of"), doc_key().alias("__k1"), text_key().alias("__k2"))
    rows = own.join(gone, (own["__k1"] == gone["__k1"]) & (own["__k2"] == gone["__k2"])
                    & own["__of"].eqNullSafe(gone["__host"]), "left")
    left = F.expr(f"CASE WHEN __gone IS NULL THEN cast(text AS string) ELSE array_join(filter(split(cast(text AS string), '\\n'), "
                  f"x -> NOT (x rlike r'{WORD}' AND array_contains(__gone, xxhash64({_PLAIN_LINE})))), '\n') END")
    rows = rows.select("doc_id", "text", "__row", left.alias("__left"), F.col("__gone").isNotNull().alias("__cut"))
    rows = text_rules(rows, ("__row", "__left", "__cut"))
    remain = F.when(F.col("__cut"), F.regexp_count("__left", F.lit(WORD)).cast("long")).otherwise(F.col("n_words"))
    rows = rows.withColumn("n_removed_words", F.col("n_words") - remain)
    depleted = (remain < LEAST_WORDS) | (remain < LEAST_SHARE * F.col("n_words"))
    return rows.withColumn("kept", ~F.col("base_failed") & ~depleted)


def judge(spark: SparkSession, docs: DataFrame, most: int = LINE_DOCS) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept and n_removed_words of every row.

    Null text has no words and fails; a null host is a host of its own; rows
    that repeat count as one document of their host and get equal verdicts; an
    empty table gives an empty result."""
    return _judged(spark, docs, most).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_words")


def remove_lines(spark: SparkSession, docs: DataFrame, most: int = LINE_DOCS) -> DataFrame:
    """The rows of docs that the rules keep, in docs' columns, their texts
    without the lines that are boilerplate on their host."""
    kept = _judged(spark, docs, most).filter("kept")
    return kept.select(*[F.col("__left").alias(c) if c == "text" else F.length("__left").cast(docs.schema[c].dataType).alias(c)
                         if c == "n_chars" else F.col(f"__row.`{c}`") for c in docs.columns])
