"""Fill-in-the-middle: every document cut at two unit borders and rearranged.

The borders of a text's units (code points, or the matches of a pattern) are
byte offsets, kept in a Roaring-style set: one container per 65,536 offsets,
stored as a sorted array, a bitmap or runs, whichever is smallest, with the
cumulative cardinality before each container.  The offset of the k-th border is
found by a search among the cumulative cardinalities and a select inside one
container, so a cut costs no pass over the text: ASCII text is one run per
container, mixed scripts are bitmaps, lines or long words are arrays.

Where to cut and which form to use come from the SHA-256 of a seed and the
document's id, so the result depends on neither partitions nor retries.
``psm`` is prefix, suffix, middle; ``spm`` suffix, prefix, middle; ``plain`` the
text as it is.  ``restored`` rebuilds the exact text from output and form.

Cases: null text is empty; an empty text, or one that holds a sentinel, stays
plain; a null id hashes as the seed alone; repeated rows get the same result;
texts of any length are cut whole; an empty table gives an empty result; columns
named like the results are replaced, all others come back.  No shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .columns import table
from .shared import text_batches

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SENTINELS = (PREFIX, SUFFIX, MIDDLE)
SEED = "1"
PLAIN_FROM = 90  # of 100: third roll from here on stays plain
SPM_BELOW = 20   # of 100: fourth roll below is suffix first
RESULT = ["n", "form", "prefix_chars", "middle_chars", "output"]

_CHUNK = 1 << 16
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


class Runs:
    """Container of runs: starts, and the cardinality before each run."""

    def __init__(self, at: np.ndarray):
        edge = np.flatnonzero(np.diff(at) != 1) + 1
        self.before = np.concatenate(([0], edge))
        self.start = at[self.before]

    def select(self, k: int) -> int:
        i = int(np.searchsorted(self.before, k, side="right")) - 1
        return int(self.start[i]) + k - int(self.before[i])


class Array:
    """Container of sorted 16-bit offsets."""

    def __init__(self, at: np.ndarray):
        self.at = at.astype(np.uint16)

    def select(self, k: int) -> int:
        return int(self.at[k])


class Bitmap:
    """Container of 65,536 bits, with the cardinality before each byte."""

    def __init__(self, at: np.ndarray):
        bits = np.zeros(_CHUNK, np.uint8)
        bits[at] = 1
        self.bits = np.packbits(bits)
        self.before = np.concatenate(([0], np.cumsum(_ONES[self.bits], dtype=np.int64)))

    def select(self, k: int) -> int:
        i = int(np.searchsorted(self.before, k, side="right")) - 1
        inside = np.flatnonzero(np.unpackbits(self.bits[i:i + 1]))
        return 8 * i + int(inside[k - int(self.before[i])])


def _container(at: np.ndarray) -> Runs | Array | Bitmap:
    """The smallest of the three for these sorted offsets (runs cost 4 bytes each, array entries 2)."""
    runs = 1 + int(np.count_nonzero(np.diff(at) != 1))
    if 4 * runs <= min(2 * len(at), _CHUNK // 8):
        return Runs(at)
    return Array(at) if 2 * len(at) <= _CHUNK // 8 else Bitmap(at)


class Boundaries:
    """Roaring-style set of the unit borders of a UTF-8 text, 0 and its length included."""

    def __init__(self, raw: bytes, unit: re.Pattern | None = None):
        self.keys: list[int] = []
        self.containers: list[Runs | Array | Bitmap] = []
        sizes = [0]
        for key, at in self._chunks(raw, unit):
            if len(at):
                self.keys.append(key)
                self.containers.append(_container(at))
                sizes.append(len(at))
        self.before = np.cumsum(sizes)

    @staticmethod
    def _chunks(raw: bytes, unit: re.Pattern | None) -> Iterator[tuple[int, np.ndarray]]:
        if unit is None:
            buf = np.frombuffer(raw, np.uint8)
            for lo in range(0, len(raw) + 1, _CHUNK):
                at = np.flatnonzero((buf[lo:lo + _CHUNK] & 0xC0) != 0x80)
                if lo <= len(raw) < lo + _CHUNK:
                    at = np.append(at, len(raw) - lo)
                yield lo // _CHUNK, at
            return
        text = raw.decode()
        ends = [m.end() for m in unit.finditer(text) if m.end() > m.start()]
        chars = np.unique(np.array([0, *ends, len(text)], np.int64))
        lead = np.append(np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80), len(raw))
        at = lead[chars]
        cuts = np.searchsorted(at, np.arange(0, len(raw) + _CHUNK + 1, _CHUNK))
        for key, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
            yield key, at[a:b] - key * _CHUNK

    def __len__(self) -> int:
        """Units of the text: borders less one."""
        return int(self.before[-1]) - 1

    def select(self, k: int) -> int:
        """Byte offset of the k-th border."""
        i = int(np.searchsorted(self.before, k, side="right")) - 1
        return self.keys[i] * _CHUNK + self.containers[i].select(k - int(self.before[i]))


def arrange(raw: bytes, h1: int, h2: int, form: str, unit: re.Pattern | None = None) -> tuple:
    """(n, form, prefix code points, middle code points, output) of one text."""
    borders = Boundaries(raw, unit)
    n = len(borders)
    if form == "plain" or not raw or any(s.encode() in raw for s in SENTINELS):
        return n, "plain", None, None, raw.decode()
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    lo, hi = borders.select(a), borders.select(b)
    prefix, middle, suffix = raw[:lo].decode(), raw[lo:hi].decode(), raw[hi:].decode()
    head = f"{SUFFIX}{suffix}{PREFIX}{prefix}" if form == "spm" else f"{PREFIX}{prefix}{SUFFIX}{suffix}"
    return n, form, len(prefix), len(middle), f"{head}{MIDDLE}{middle}"


_TYPE = "n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
_ARROW = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]


def _arranged(text: Column, h1: Column, h2: Column, form: Column, unit: str | None) -> Column:
    @F.arrow_udf(_TYPE)
    def cut(texts: pa.Array, a: pa.Array, b: pa.Array, forms: pa.Array) -> pa.Array:
        pattern = re.compile(unit, re.S) if unit else None
        rows = [arrange(t.as_py().encode(), x, y, f, pattern)
                for t, x, y, f in zip(texts, a.to_pylist(), b.to_pylist(), forms.to_pylist())]
        cols = zip(*rows) if rows else ([],) * len(_ARROW)
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(cols, _ARROW)], RESULT)
    return cut.asNondeterministic()(text, h1, h2, form)


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = SEED,
                   unit: str | None = None) -> DataFrame:
    """``docs`` with n (units), form, prefix_chars, middle_chars (null if plain) and output.

    ``unit`` is a pattern whose matches, left to right, end the units (text
    between matches belongs to the next one); None cuts at code points.
    """
    text_batches(docs.sparkSession)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    form = F.when(h[2] % 100 >= PLAIN_FROM, "plain").when(h[3] % 100 < SPM_BELOW, "spm").otherwise("psm")
    keep = [c for c in docs.columns if c not in RESULT]
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(*keep, _arranged(text, h[0], h[1], form, unit).alias("_fim")).select(*keep, "_fim.*")


def restored(output: Column, form: Column) -> Column:
    """The exact text, from output and form alone: each sentinel stands once, in the form's order."""
    def between(a: str, b: str | None) -> Column:
        after = F.substr(output, F.instr(output, a) + len(a))
        return after if b is None else F.substring_index(after, b, 1)
    psm = F.concat(between(PREFIX, SUFFIX), between(MIDDLE, None), between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), between(MIDDLE, None), between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                      F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents),
h AS (SELECT doc_id, t, length(t) AS n, CAST('0x' || s[1:8] AS BIGINT) % (length(t) + 1) AS x,
             CAST('0x' || s[9:16] AS BIGINT) % (length(t) + 1) AS y,
             CASE WHEN t = '' OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}')
                    OR CAST('0x' || s[17:24] AS BIGINT) % 100 >= {PLAIN_FROM} THEN 'plain'
                  WHEN CAST('0x' || s[25:32] AS BIGINT) % 100 < {SPM_BELOW} THEN 'spm' ELSE 'psm' END AS form FROM d),
c AS (SELECT doc_id, t, n, form, least(x, y) AS lo, greatest(x, y) AS hi FROM h),
p AS (SELECT *, substr(t, 1, lo) AS a, substr(t, lo + 1, hi - lo) AS m, substr(t, hi + 1) AS z FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(lo AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(hi - lo AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || a || '{SUFFIX}' || z || '{MIDDLE}' || m
              ELSE '{SUFFIX}' || z || '{PREFIX}' || a || '{MIDDLE}' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""
