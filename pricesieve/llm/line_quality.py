"""Quality rules with cross-document line frequency, in DataFrame functions only.

Defined results: a null text counts as ''; null hosts form one host; repeated rows are
judged one by one and give equal verdicts; extra columns pass through; an empty table gives
an empty result.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricesieve.llm.common import WORD_SEPARATORS, staged, text_or_empty

#: Base rules: fewest words, and the largest percentage of words in repeated 3-word windows.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A line is boilerplate of its host if more distinct documents than this hold it ...
MIN_LINE_DOCS = 20
#: ... and more than this percentage of the host's distinct documents.
LINE_PERCENT = 10
#: A document is depleted if a smaller percentage of its words is left.
MIN_LEFT_PERCENT = 30

STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` in order."""
    return F.filter(F.split(text, WORD_SEPARATORS), lambda w: w != "")


def lines_with_words(text: Column) -> Column:
    """The \\n-split lines that hold a word, in order."""
    return F.filter(F.split(text, "\n"), lambda x: F.translate(x, " \t\x0b\x0c\r", "") != "")


def normal_line(line: Column) -> Column:
    """Line key: A-Z in lower case, digits as 0, white space as one space, trimmed."""
    line = F.translate(line, "ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789", "abcdefghijklmnopqrstuvwxyz000000000")
    return F.trim(F.regexp_replace(line, WORD_SEPARATORS, " "))


def let(value: Column, body) -> Column:
    """``body`` of ``value`` as a bound variable.  A named column would be copied into the
    lambdas by the optimizer and computed again for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the text.

    Window hashes are sorted with their positions and equal neighbours flagged, so a text of n
    words costs n log n and nothing is shuffled.
    """
    windows = F.transform(
        F.sequence(F.lit(1), F.size(words) - 2),
        lambda i: F.struct(F.xxhash64(F.get(words, i - 1), F.get(words, i), F.get(words, i + 1)).alias("h"), i.alias("i")))
    repeated = let(F.sort_array(windows), lambda s: F.transform(
        F.filter(s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"])), lambda x: x["i"]))
    covered = let(F.sort_array(repeated), lambda p: F.transform(
        p, lambda at, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - at, F.lit(3)))))
    return F.when(F.size(words) < 3, 0).otherwise(F.aggregate(covered, F.lit(0), lambda a, x: a + x))


def statistics(text: Column) -> Column:
    """The five base statistics of a text as one struct of longs."""
    def of(t: Column, words: Column, lines: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.translate(t, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
            (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            _repeat_words(words).cast("long").alias("n_repeat_words"))

    return let(text, lambda t: let(words_of(t), lambda w: let(lines_with_words(t), lambda x: of(t, w, x))))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def host_boilerplate(docs: DataFrame, host: str = "source", text: str = "text") -> DataFrame:
    """(host, boilerplate): per host the keys of its boilerplate lines, a staged table.

    A text counts once per host however many exact copies it has (its SHA-256 identifies it).
    Counts combine before the shuffle, so a hot host or line is no hot group.  A host has at
    most 100/LINE_PERCENT times its mean lines per document such lines.
    """
    texts = (docs.select(F.col(host).alias("host"), text_or_empty(text).alias("t"))
             .select("host", F.sha2("t", 256).alias("d"), F.array_distinct(F.transform(
                 lines_with_words(F.col("t")), lambda x: F.xxhash64(normal_line(x)))).alias("l")))
    # a row of a document itself has the line key null: one pass counts documents and lines
    rows = texts.select("host", "d", F.explode(F.concat(F.array(F.lit(None).cast("long")), "l")).alias("h"))
    counts = staged(rows.groupBy("host", "h").agg(F.countDistinct("d").alias("c"))
                    .where(F.col("h").isNull() | (F.col("c") > MIN_LINE_DOCS)), "line_counts")
    hosts = counts.where("h IS NULL").select(F.col("host").alias("_host"), F.col("c").alias("n"))
    # the percentage is judged on rows: only lines above it, a bounded number a host, meet in one row
    above = (counts.where("h IS NOT NULL").join(hosts, F.col("host").eqNullSafe(F.col("_host")))
             .where(100 * F.col("c") > LINE_PERCENT * F.col("n")))
    return staged(above.groupBy("host").agg(F.sort_array(F.collect_list("h")).alias("boilerplate")), "boilerplate")


def _without_boilerplate(text: Column) -> Column:
    """(left, gone): the text without the lines whose keys ``_b`` holds, and the words in them.
    Each line is normalised once; one without words is no boilerplate and stays."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.struct(
        x.alias("line"), F.array_contains("_b", F.xxhash64(normal_line(x))).alias("bad")))
    return let(lines, lambda found: F.struct(
        F.array_join(F.transform(F.filter(found, lambda x: ~x["bad"]), lambda x: x["line"]), "\n").alias("left"),
        F.aggregate(F.filter(found, lambda x: x["bad"]), F.lit(0), lambda a, x: a + F.size(words_of(x["line"]))).alias("gone")))


def judged(docs: DataFrame, host: str = "source", text: str = "text") -> DataFrame:
    """``docs`` plus the statistics, n_left_words (words outside boilerplate lines), left_text
    (the text without its boilerplate lines), base_failed and kept."""
    found = host_boilerplate(docs, host, text).withColumnRenamed("host", "_host").withColumnRenamed("boilerplate", "_b")
    out = docs.withColumn("_s", statistics(text_or_empty(text))).join(found, F.col(host).eqNullSafe(F.col("_host")), "left")
    out = out.withColumn("_f", F.when(F.col("_b").isNotNull(), _without_boilerplate(F.col(text))))
    out = out.select(*docs.columns, *(F.col(f"_s.{n}").alias(n) for n in STATISTICS),
                     F.coalesce("_f.left", F.col(text)).alias("left_text"),
                     (F.col("_s.n_words") - F.coalesce("_f.gone", F.lit(0))).alias("n_left_words"))
    depleted = 100 * F.col("n_left_words") < MIN_LEFT_PERCENT * F.col("n_words")
    out = out.withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & ~depleted)


def quality_rules(docs: DataFrame) -> DataFrame:
    """Verdict of every document."""
    out = judged(docs.select("doc_id", "source", "text"))
    return out.select("doc_id", *STATISTICS, "base_failed", "kept", "n_left_words")


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with their own columns; ``text`` without the boilerplate
    lines of its host."""
    inner = docs.select(F.struct("*").alias("_row"), F.col("source").alias("_src"), F.col("text").alias("_text"))
    # the row number keeps the optimizer from computing the statistics in the filter once more
    out = judged(inner, "_src", "_text").select("_row", "left_text", "kept", F.monotonically_increasing_id().alias("_n"))
    return out.where("kept AND _n >= 0").select(
        *(F.col("left_text").alias(c) if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns))


#: The same rules for DuckDB, on whole tables.
ORACLE = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
r AS (SELECT row_number() OVER () AS rid, doc_id, source, t,
       list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
       list_filter(string_split(t, chr(10)), lambda x: regexp_replace(x, '[\x20\x09-\x0D]', '', 'g') <> '') AS l FROM d),
ln AS (SELECT rid, source, t, unnest(l) AS line FROM r),
nl AS (SELECT rid, source, t, len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS nw,
       trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000'),
            '[\x20\x09-\x0D]+', ' ', 'g')) AS k FROM ln),
hosts AS (SELECT source, count(DISTINCT t) AS n FROM d GROUP BY 1),
freq AS (SELECT source, k, count(DISTINCT t) AS c FROM nl GROUP BY 1, 2 HAVING count(DISTINCT t) > {MIN_LINE_DOCS}),
bad AS (SELECT f.source, f.k FROM freq f JOIN hosts h ON f.source IS NOT DISTINCT FROM h.source
        WHERE 100 * f.c > {LINE_PERCENT} * h.n),
gone AS (SELECT rid, sum(nw) AS g FROM nl JOIN bad b ON nl.source IS NOT DISTINCT FROM b.source AND nl.k = b.k GROUP BY 1),
win AS (SELECT rid, unnest(range(1, len(w) - 1)) AS i, w FROM r WHERE len(w) >= 3),
tri AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM win),
hit AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM tri) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT i + o) AS n FROM hit, (VALUES (0), (1), (2)) v(o) GROUP BY 1),
s AS (SELECT r.doc_id, len(w)::BIGINT AS n_words,
       length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
       (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
       (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
       (len(w) - coalesce(g, 0))::BIGINT AS n_left_words
     FROM r LEFT JOIN cov USING (rid) LEFT JOIN gone USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words)
    AND NOT 100 * n_left_words < {MIN_LEFT_PERCENT} * n_words AS kept, n_left_words
FROM s
"""
