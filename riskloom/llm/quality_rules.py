"""Quality rules: a threshold table compiled into one Spark projection.

Every metric is a Column over the whole text (word, symbol, stop-word and line
counts); ``RULES`` names a ratio, a direction and a threshold, and
``quality_rules`` turns the table into one array expression of failed rule
names.  No user functions, no shuffle: the plan is scan -> project.

Cases: null, empty or blank text has no words, so it fails the base rules;
texts of any length are judged whole; repeated rows are judged row by row;
an empty table gives an empty result.  Other input columns are not read, so
clashing names do no harm.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .columns import computed, let, table, words_of

SYMBOLS = r"[#*$%&|<>]"
NO_SYMBOLS = r"[^#*$%&|<>]+"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PCT = 30

# Frequent function words of the languages the rules are meant for.
STOP_WORDS = {
    "en": "a an and are as at be by for from has in is it of on or that the this to was were will with".split(),
    "de": "als auch auf aus das dem den der des die ein eine für im in ist mit nicht sich und von zu".split(),
    "fr": "au avec ce dans de des du elle en est et il la le les ne par pas pour que qui sur un une".split(),
    "es": "al con de del el en es la las lo los no para por que se su un una y".split(),
}


@dataclass(frozen=True)
class Rule:
    """Fail when ``metric`` is beyond ``threshold`` (``op`` is "<" or ">")."""

    name: str
    metric: str
    op: str
    threshold: float


RULES = (
    Rule("short_words", "word_chars / n_words", "<", 2.5),
    Rule("long_words", "word_chars / n_words", ">", 12.0),
    Rule("symbols", "n_symbols / n_words", ">", 0.3),
    Rule("stop_words", "n_stop_words / n_words", "<", 0.04),
    Rule("repeated_lines", "n_dup_lines / n_lines", ">", 0.5),
    Rule("ellipsis_lines", "n_ellipsis_lines / n_lines", ">", 0.3),
    Rule("bullet_lines", "n_bullet_lines / n_lines", ">", 0.9),
)


def repeat_words(words: Column, window: int = WINDOW) -> Column:
    """Words covered by ``window``-word runs found twice or more in the array.

    Runs are hashed, the (hash, position) pairs sorted, equal neighbours kept,
    and the union of their word ranges summed: n log n inside one row.
    """
    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda v, i: F.struct(v.alias("h"), i.alias("p"))))

        def positions(s: Column) -> Column:
            def same(i, x):
                return F.coalesce(F.get(s, i)["h"] == x["h"], F.lit(False))
            twice = F.filter(s, lambda x, i: same(i - 1, x) | same(i + 1, x))
            return F.sort_array(F.transform(twice, lambda x: x["p"]))

        def total(p: Column) -> Column:
            steps = F.transform(p, lambda v, i: F.least(F.lit(window), F.coalesce(F.get(p, i + 1) - v, F.lit(window))))
            return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(
            let(pairs, lambda s: let(positions(s), total)))

    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - (window - 1)),
                         lambda i: F.xxhash64(F.slice(words, i, window)))
    return F.when(F.size(words) <= window, F.lit(0).cast("long")).otherwise(let(hashes, covered))


def metrics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: its id and the counts the rules read."""
    stop = sorted({w for ws in STOP_WORDS.values() for w in ws})
    src = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    parts = computed(
        src, "doc_id", "text", words_of(F.col("text")).alias("words"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    count = lambda arr, f: F.size(F.filter(arr, f)).cast("long")
    w, lines = F.col("words"), F.col("lines")
    return computed(
        parts, "doc_id",
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", NO_SYMBOLS, "")).cast("long").alias("n_symbols"),
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        repeat_words(w).alias("n_repeat_words"),
        count(w, lambda x: x.isin(stop)).alias("n_stop_words"),
        count(lines, lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$")).alias("n_ellipsis_lines"),
        count(lines, lambda x: x.rlike(r"^[\x20\x09-\x0D]*[-*•]")).alias("n_bullet_lines"),
    )


def compile_rules(rules: tuple[Rule, ...] = RULES) -> Column:
    """The threshold table as one Column: names of the failed rules."""
    checks = []
    for r in rules:
        ratio = F.expr(r.metric.replace(" / ", " / nullif(") + ", 0)")
        bad = ratio < r.threshold if r.op == "<" else ratio > r.threshold
        checks.append(F.when(bad, F.lit(r.name)))
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Metrics, ``base_failed``, ``failed_rules`` and ``kept`` of every row."""
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words"))
    return (metrics(docs, id_col, text_col)
            .withColumns({"base_failed": base, "failed_rules": compile_rules(rules)})
            .withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "n_stop_words", "n_lines", F.array_join("failed_rules", ",").alias("failed_rules"), "base_failed", "kept")


def _sql_list(words: list[str]) -> str:
    return ", ".join("'" + w + "'" for w in words)


def oracle() -> str:
    """The same decisions in DuckDB SQL, from the words up."""
    stop = _sql_list(sorted({w for ws in STOP_WORDS.values() for w in ws}))
    checks = ", ".join(
        f"CASE WHEN CAST({r.metric.split(' / ')[0]} AS DOUBLE) / nullif({r.metric.split(' / ')[1]}, 0) {r.op} {r.threshold} THEN '{r.name}' END"
        for r in RULES)
    return rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d WHERE len(w) >= {WINDOW})),
twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
rep AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM twice) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(w) AS n_words,
         CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words,
         len(list_filter(w, lambda x: x IN ({stop}))) AS n_stop_words,
         len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_ellipsis_lines,
         len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) AS n_bullet_lines
  FROM d LEFT JOIN rep USING (doc_id)),
f AS (
  SELECT *, array_to_string(list_filter([{checks}], lambda x: x IS NOT NULL), ',') AS failed_rules,
         n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PCT} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_stop_words, n_lines,
       failed_rules, base_failed, NOT base_failed AND failed_rules = '' AS kept FROM f
"""
