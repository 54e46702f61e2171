"""Line dedup: deletion-neighbourhood join over lines, in DataFrame operations only.

A line of a document is dropped when an earlier line of the corpus, in order of
(doc_id, line number), is the same or within ``EDITS`` = 1 word edit of it
(one word inserted, left out or replaced).  Lines under ``EXACT_WORDS`` words are
left alone, lines under ``NEAR_WORDS`` words need to be equal.  "Earlier" refers
to the input, dropped lines included.

Equal lines first become one, with their earliest place.  Two lines at one word
edit agree in their first or second half, so only lines that share a hashed
half (of their own or one word less) with another line go on: they emit every
one-word deletion, from the half that may differ, as a hashed key.  A cheaper
test comes first: the 4 or 8 words at either end, which one edit cannot change both.  Lines that share a deletion at one
position, or one whose deletion is the other line, are at one edit; per
key the earliest is found by aggregation, never by listing pairs.  The edit
distance to that earliest line is then verified on the words themselves.

Cases: null text stays null and has no lines; rows without doc_id stay as they
are and count for nothing; repeated rows have the same places and the same
decisions; blank lines stay; an empty table gives an empty result; all input
columns come back, whatever their names, with the text rewritten.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .columns import WHITE, WHITE_RUN, computed, let, table
from .shared import release, written

EDITS = 1
EXACT_WORDS = 3
NEAR_WORDS = 8
KEY = ["h", "nc"]
_PLACE = 10 ** 10  # more than the lines of a document
# Anything but single spaces between the words of the lines.
_IRREGULAR = r"[\t\x0B\f\r]| [ \n]|\n |^ | $"
# Words that open or close two lines at one edit; lines of more than twice as many use the longer gate.
SHORT_GATE, LONG_GATE = 4, 8
GATES = ["g0", "g1", "g2", "g3"]


def _line(t: Column) -> Column:
    """A line with its words joined by single spaces."""
    return F.regexp_replace(F.btrim(t, F.lit(WHITE)), WHITE_RUN, " ")


def _count(t: Column) -> Column:
    """Words of such a line."""
    return F.when(t == "", 0).otherwise(F.octet_length(t) - F.octet_length(F.replace(t, F.lit(" "), F.lit(""))) + 1)


def _first(t: Column, n) -> Column:
    """The first n words of such a line, the last -n if n is negative."""
    return F.call_function("substring_index", t, F.lit(" "), n if isinstance(n, Column) else F.lit(n))


def _more(t: Column, n: int) -> Column:
    """Whether such a line has more than n words."""
    return _first(t, n) != t


def _gates(t: Column) -> list[Column]:
    """Hashes of the words that open and close a line.

    Two lines at one edit share the first or the last words: 4 where the
    shorter has at least 7, 8 where it has at least 16.  A line of 17 words may be
    one longer than its partner and has both.
    """
    def ends(k: int) -> list[Column]:
        return [F.xxhash64(F.lit(k), _first(t, k)), F.xxhash64(F.lit(-k), _first(t, -k))]
    near, long_ = _more(t, NEAR_WORDS - EDITS - 1), _more(t, 2 * LONG_GATE)
    both = long_ & ~_more(t, 2 * LONG_GATE + 1)
    out = [F.when(long_, x).when(near, y) for x, y in zip(ends(LONG_GATE), ends(SHORT_GATE))]
    out += [F.when(both, y) for y in ends(SHORT_GATE)]
    return [c.alias(name) for c, name in zip(out, GATES)]


def _place() -> Column:
    """Order of (doc_id, line) as one number."""
    return (F.col("doc_id").cast("decimal(20,0)") * F.lit(_PLACE).cast("decimal(11,0)") + F.col("line")).cast("decimal(38,0)")


def _lines(text: DataFrame) -> DataFrame:
    """(doc_id, line, nc, h, gates) of the lines that are judged."""
    docs = computed(text.where("doc_id is not null"), "doc_id", F.col("text").rlike(_IRREGULAR).alias("odd"),
                    F.split("text", "\n").alias("raws"))
    each = docs.select("doc_id", "odd", F.posexplode("raws").alias("line", "raw"))
    t = each.select("doc_id", "line", F.when(F.col("odd"), _line(F.col("raw"))).otherwise(F.col("raw")).alias("t"))
    t = t.where(_more(F.col("t"), EXACT_WORDS - 1))
    return t.select("doc_id", "line", F.length("t").alias("nc"), F.xxhash64("t").alias("h"), *_gates(F.col("t")))


def _shared(keys: DataFrame, key: str, of: str) -> DataFrame:
    """Rows (key, of) of ``keys`` whose key another ``of`` has too."""
    several = keys.groupBy(key).agg(F.min(of).alias("a"), F.max(of).alias("b")).where("a <> b").select(key)
    return keys.join(several, key, "left_semi")


def _candidates(first: DataFrame) -> DataFrame:
    """(place) of distinct lines that share a gate with another one."""
    gate = first.select("h", F.explode(F.array(*GATES)).alias("g")).where("g is not null")
    return first.join(_shared(gate, "g", "h").select("h").distinct(), "h", "left_semi").select("place")


def _texts(text: DataFrame, cand: DataFrame) -> DataFrame:
    """(id, place, t): candidate lines, cut from their first document, numbered in order of place."""
    doc, line = F.floor(F.col("place") / _PLACE), F.pmod("place", F.lit(_PLACE))
    by_doc = cand.select(doc.cast("long").alias("doc_id"), F.struct(line.cast("int").alias("line"), "place").alias("x"))
    by_doc = by_doc.groupBy("doc_id").agg(F.collect_set("x").alias("xs"))
    hit = text.join(by_doc, "doc_id").select("xs", F.split("text", "\n").alias("t"))
    each = computed(hit, F.transform("xs", lambda x: F.struct(x["place"].alias("place"), F.get("t", x["line"]).alias("t"))).alias("x"))
    one = each.select(F.inline("x")).dropDuplicates(["place"]).select("place", _line(F.col("t")).alias("t"))
    return one.orderBy("place").select(F.monotonically_increasing_id().alias("id"), "place", "t")


def _halves(lines: DataFrame) -> DataFrame:
    """(id, pre, suf): lines whose first or last half (their own, or as the longer
    of a pair n - 1, n) another line has too."""
    t, n = F.col("t"), F.col("n")
    out = []
    for m in (n, n - 1):
        p = (m / 2).cast("int")
        out += [F.xxhash64(F.lit("p"), m, _first(t, p)), F.xxhash64(F.lit("s"), m, _first(t, p - m))]
    half = lines.withColumn("n", _count(t)).select("id", F.posexplode(F.array(*out)).alias("kind", "g"))
    hit = _shared(half.select("id", "g"), "g", "id").join(half, ["id", "g"])
    return hit.groupBy("id").agg(F.max(F.col("kind") % 2 == 0).alias("pre"), F.max(F.col("kind") % 2 == 1).alias("suf"))


def _near(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, seen): candidate lines and the earliest line that shares a deletion with them; and the stored deletions."""
    n = F.col("n")
    rows = lines.join(_halves(lines), "id").withColumn("n", _count(F.col("t")))
    # an equal first half leaves the second to differ, and the other way round
    lo = F.when(F.col("suf"), F.lit(1)).otherwise(((n - 1) / 2).cast("int") + 1)
    hi = F.when(F.col("pre"), n).otherwise((n / 2).cast("int") + 1)
    at = rows.where(n >= NEAR_WORDS).select("id", "t", "n", F.explode(F.sequence(lo, hi)).alias("i"))
    i = F.col("i")
    left, right = _first(F.col("t"), i - 1), _first(F.col("t"), i - n)
    cut = F.when(i == 1, right).when(i == n, left).otherwise(F.concat(left, F.lit(" "), right))
    drops = written(at.select("id", "i", F.xxhash64(cut).alias("v")), "deletions")
    release(lines.sparkSession)  # the halves: several times the deletions
    whole = rows.select(F.col("id").alias("whole"), F.xxhash64("t").alias("v"))
    same = drops.groupBy("v", "i").agg(F.min("id").alias("seen"), F.max("id").alias("last")).where("seen < last")
    swapped = drops.join(same, ["v", "i"]).where("seen < id").select("id", "seen")
    pairs = drops.join(whole, "v").select("id", "whole")
    longer = pairs.where("whole < id").select("id", F.col("whole").alias("seen"))
    shorter = pairs.where("id < whole").select(F.col("whole").alias("id"), F.col("id").alias("seen"))
    return swapped.union(longer).union(shorter).groupBy("id").agg(F.min("seen").alias("seen")), drops


def one_edit(a: Column, b: Column) -> Column:
    """Whether two word arrays are within one word edit."""
    na, nb = F.size(a), F.size(b)
    differ = F.size(F.filter(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), lambda same: ~same))
    short, long_ = F.when(na < nb, a).otherwise(b), F.when(na < nb, b).otherwise(a)
    lead = F.array_position(F.zip_with(short, long_, lambda x, y: x.eqNullSafe(y)), F.lit(False)).cast("int")
    rest = F.slice(short, lead, F.size(long_)) == F.slice(long_, lead + 1, F.size(long_))
    return F.when(na == nb, differ <= EDITS).when(F.abs(na - nb) == 1, rest).otherwise(F.lit(False))


def dropped_lines(text: DataFrame) -> DataFrame:
    """(doc_id, line) of the lines to drop, of (doc_id, text)."""
    spark = text.sparkSession
    lines = written(_lines(text), "lines")
    first = lines.withColumn("place", _place()).groupBy(*KEY).agg(F.min("place").alias("place"), *[F.first(c).alias(c) for c in GATES])
    first = written(first, "first-lines")
    release(spark)
    texts = written(_texts(text, _candidates(first)), "line-texts")
    release(spark)
    words = texts.select("id", "place", F.split("t", " ").alias("w"))
    near, drops = _near(texts)
    pairs = near.join(words, "id").join(words.select(F.col("id").alias("seen"), F.col("w").alias("v")), "seen")
    bad = written(pairs.where(one_edit(F.col("w"), F.col("v"))).select("place"), "near-lines")
    release(spark, drops, texts)
    flagged = first.select(*KEY, F.col("place").alias("first")).join(
        bad.select(F.col("place").alias("first"), F.lit(True).alias("near")), "first", "left")
    hit = lines.select("doc_id", "line", *KEY).join(flagged, KEY).where(F.col("near") | (_place() != F.col("first")))
    gone = written(hit.select("doc_id", "line").distinct(), "dropped-lines")
    release(spark, lines, first, bad)
    return gone


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with dropped lines taken out of the text, and ``n_lines_removed``."""
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    gone = dropped_lines(text).groupBy("doc_id").agg(F.collect_set("line").alias("gone"))
    own = [F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)]
    at, body = (f"c{docs.columns.index(c)}" for c in (id_col, text_col))
    both = docs.select(*own).join(gone, F.col(at).cast("long") == F.col("doc_id"), "left").drop("doc_id")

    def rest(t: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(t) - 1), F.col("gone"))
        return F.array_join(F.transform(kept, lambda i: F.get(t, i)), "\n")
    new = F.when(F.col("gone").isNull(), F.col(body)).otherwise(let(F.split(body, "\n"), rest))
    return computed(both, *(new.alias(body) if f"c{i}" == body else f"c{i}" for i in range(len(own))),
                    F.coalesce(F.size("gone"), F.lit(0)).alias("n_lines_removed")).toDF(*docs.columns, "n_lines_removed")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("n_lines_removed").cast("long").alias("n_lines_removed"), "text")


ORACLE = f"""
WITH l AS (
  SELECT doc_id, i - 1 AS line, regexp_extract_all(ls[i], '[^\\x20\\x09-\\x0D]+') AS w
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i
        FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL))),
j AS (SELECT *, len(w) AS n FROM l WHERE len(w) >= {EXACT_WORDS}),
f AS (SELECT w, n, min(ROW(doc_id, line)) AS pos FROM j GROUP BY w, n),
pairs AS (
  SELECT a.w AS wa, a.pos AS ata, b.w AS wb, b.pos AS atb, a.n AS na,
         coalesce(list_position(list_transform(list_zip(a.w, b.w), lambda x: x[1] IS NOT DISTINCT FROM x[2]), false), 0) AS p, b.n AS nb
  FROM f a JOIN f b ON b.n >= {NEAR_WORDS} AND (a.n = b.n AND a.pos < b.pos OR a.n = b.n - 1)),
near AS (
  SELECT CASE WHEN ata < atb THEN atb ELSE ata END AS pos FROM pairs
  WHERE p > 0 AND (na = nb AND wa[p + 1:] = wb[p + 1:] OR na = nb - 1 AND wa[p:] = wb[p + 1:])),
gone AS (
  SELECT DISTINCT j.doc_id, j.line FROM j JOIN f ON j.w = f.w
  WHERE ROW(j.doc_id, j.line) <> f.pos OR f.pos IN (SELECT pos FROM near)),
kept AS (
  SELECT d.doc_id, string_agg(ls[i], chr(10) ORDER BY i) FILTER (WHERE g.line IS NULL) AS text,
         count(g.line) AS n_lines_removed
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i
        FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)) d
  LEFT JOIN gone g ON g.doc_id = d.doc_id AND g.line = d.i - 1 GROUP BY d.doc_id)
SELECT doc_id, n_lines_removed, coalesce(text, '') AS text FROM kept
UNION ALL SELECT doc_id, 0, NULL FROM documents WHERE text IS NULL
"""
