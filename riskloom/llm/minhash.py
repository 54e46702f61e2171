"""Near-duplicate documents: SuperMinHash signatures, banding, verification, union-find.

A document's set is its distinct 5-word shingles (lower-case A-Z; with fewer
words, the whole sequence).  An element's hash drives one random permutation of
the ``SLOTS`` signature slots; the slot it holds in rank ``j`` may get the value
``j + r_j``, and each slot keeps its least value (SuperMinHash).  Ranks are dealt
to all elements of a document in step, and dealing stops with the rank that
fills the last slot: later ranks cannot be smaller.

Signatures are cut into ``BANDS`` bands.  Documents with equal sets fall
together first and are one representative.  Representatives that share a band
value are candidates; links are confirmed on the full sets.  A link between two
documents that are already connected changes nothing, so candidates are tried
in rounds, each only between different components: first each document with
the earliest document it meets, then with the leader of every band value (the
earliest, later the one with the fewest elements of its own), and last every
pair of different components that the bounds below allow.  The last
round makes the result whole; the earlier ones leave it little to do.  A group
of copies costs work in proportion to its size.

What keeps documents of such a group apart are words that only one of them has.
After two rounds those elements are counted (``u``): two sets share at most
``least(n - u)`` elements, so most documents that are left cannot reach the
similarity with any other.  A parity mask of 1024 bits bounds each pair that
remains: sets differ in at least as many elements as their masks in bits.
Both bounds are exact; they only spare the verification of pairs that fail it.

With 32 bands of 4 slots a pair at similarity 0.75 is missed with probability
(1 - 0.75^4)^32 = 5e-6.

Cases: null or blank text is an empty set, linked with nothing; rows without id
are linked with nothing, get component null and are kept; repeated rows share a
component and, having the same id, are all kept; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .columns import table
from .components import components
from .shared import release, text_batches, written
from .words import Words, mix64, salt, slices, windows_hash

SHINGLE = 5
BANDS, ROWS = 32, 4
SLOTS = BANDS * ROWS
PERCENT = 75
MASK = 16  # longs of a parity mask
_SLICE = 1 << 19
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: list[bytes | None], size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    w = Words(texts, lower=True)
    runs = windows_hash(w.hash, size)
    out = []
    for i in range(len(texts)):
        a, b = int(w.first[i]), int(w.first[i + 1])
        if b - a >= size:
            h = np.sort(runs[a:b - size + 1])
            out.append(h[np.concatenate(([True], h[1:] != h[:-1]))])
        else:
            out.append(windows_hash(w.hash[a:b], b - a) if b > a else np.empty(0, np.uint64))
    return out


def super_minhash(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """Signatures [sets, slots]; a row of an empty set is infinite."""
    sig = np.full(len(sets) * slots, np.inf)
    h = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    perm = None
    for j in range(slots):
        u = mix64(h + salt(j + 1))
        k = j + (mix64(u) % np.uint64(slots - j)).astype(np.int64)
        if perm is None:
            slot = k
        else:
            rows = np.arange(len(h))
            slot = perm[rows, k]
            perm[rows, k] = perm[:, j]
            perm[:, j] = slot
        np.minimum.at(sig, doc * slots + slot, j + (u >> np.uint64(11)) * 2.0 ** -53)
        filled = np.isfinite(sig.reshape(-1, slots)).all(1)
        on = ~filled[doc]
        if not on.any():
            break
        if perm is None:
            h, doc, slot = h[on], doc[on], slot[on]
            perm = np.tile(np.arange(slots, dtype=np.uint8), (len(h), 1))
            perm[np.arange(len(h)), slot] = 0
            perm[:, 0] = slot
        elif on.mean() < 0.7:
            h, doc, perm = h[on], doc[on], perm[on]
    return sig.reshape(-1, slots)


def band_hashes(sig: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """[documents, bands]: hash of each band's values and number."""
    rows = sig.shape[1] // bands
    bits = np.ascontiguousarray(sig).view(np.uint64).reshape(len(sig), bands, rows)
    acc = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _GOLD, bits.shape[:2]).copy()
    for r in range(rows):
        acc = mix64(acc ^ mix64(bits[:, :, r] + np.uint64(r + 1)))
    return acc


def parity_mask(s: np.ndarray) -> np.ndarray:
    """64 * MASK bits: the parity of the elements of each hash class.  Masks of two
    sets differ in no more bits than the sets differ in elements."""
    odd = np.bincount((mix64(s.view(np.uint64)) % np.uint64(64 * MASK)).astype(np.int64), minlength=64 * MASK) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = [None if t is None else t.encode() for t in batch.column(1).to_pylist()]
        for a, b in slices([len(t or b"") for t in raw], _SLICE):
            sets = shingle_sets(raw[a:b])
            n = np.array([len(s) for s in sets], np.int64)
            bands = band_hashes(super_minhash(sets)).astype(np.int64)
            keys = np.array([(mix64(s).sum(dtype=np.uint64), mix64(s ^ _GOLD).sum(dtype=np.uint64)) for s in sets],
                            np.uint64).reshape(-1, 2).astype(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * BANDS, pa.int32()), pa.array(bands.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), pa.array(n), pa.array(keys[:, 0]), pa.array(keys[:, 1]), lists],
                ["doc_id", "n", "k1", "k2", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = [None if t is None else t.encode() for t in batch.column(1).to_pylist()]
        for a, b in slices([len(t or b"") for t in raw], _SLICE):
            sets = [s.astype(np.int64) for s in shingle_sets(raw[a:b])]
            at = np.cumsum([0] + [len(s) for s in sets])
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(sets)))
            masks = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * MASK, pa.int32()),
                                             pa.array(np.concatenate([parity_mask(s) for s in sets])))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists, masks], ["rep", "s", "m"])


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full sets have the similarity."""
    one = pairs.join(sets.select(F.col("rep").alias("b"), F.col("s").alias("sb")), "b")
    two = one.join(sets.select(F.col("rep").alias("a"), F.col("s").alias("sa")), "a")
    na, nb = F.size("sa"), F.size("sb")
    fits = (100 * F.least(na, nb) >= percent * F.greatest(na, nb))
    both = F.size(F.array_intersect("sa", "sb"))
    return two.where(fits & (100 * both >= percent * (na + nb - both))).select("a", "b")


def _state(members: DataFrame, comp: DataFrame | None) -> DataFrame:
    """Members (key, rep, n, u, comp, lead) of band values that may still join different components.

    ``u`` counts elements that no other candidate has: a pair shares at most
    ``least(n - u)`` elements.  Members that could not reach the similarity
    even with the smallest set of their band value are left out.
    """
    if comp is None:
        m = members.withColumn("comp", F.col("rep"))
    else:
        m = members.join(comp.withColumnRenamed("node", "rep"), "rep", "left").withColumn(
            "comp", F.coalesce("component", "rep")).drop("component")
    least = m.groupBy("key").agg(F.min("n").alias("n0"), F.min("comp").alias("c0"), F.max("comp").alias("c1"))
    able = m.join(least.where("c0 <> c1"), "key").where(f"100 * (n - u) >= {PERCENT} * (greatest(n0, n - u) + u)")
    span = able.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.min(F.struct("u", "rep")).alias("l"))
    open_ = span.where("c0 <> c1").select("key", F.col("l.rep").alias("lead"))
    return able.drop("n0", "c0", "c1").join(open_, "key")


def _own_elements(state: DataFrame, sets: DataFrame) -> DataFrame:
    """(rep, u): how many elements of each document of ``state`` no other one has."""
    ids = state.select("rep").distinct()
    each = sets.join(ids, "rep").select("rep", F.explode("s").alias("e"))
    one = each.groupBy("e").agg(F.count("*").alias("c"), F.min("rep").alias("rep")).where("c = 1")
    return one.groupBy("rep").agg(F.count("*").alias("u"))


def _able(x: str, y: str, masks: bool) -> str:
    """Whether sizes, own elements and parity masks of two members allow the similarity."""
    both = f"{x}n - {x}u, {y}n - {y}u"
    if masks:
        differ = " + ".join(f"bit_count({x}m[{i}] ^ {y}m[{i}])" for i in range(MASK))
        both += f", ({x}n + {y}n - ({differ})) div 2"
    return f"100 * least({both}) >= {PERCENT} * ({x}n + {y}n - least({both}))"


def _with(state: DataFrame, lead: str) -> DataFrame:
    """Pairs of each member with its band value's ``lead``, in different components."""
    head = state.where(f"rep = {lead}").drop("rep", "lead", "second").dropDuplicates(["key"])
    head = head.select("key", *[F.col(c).alias(f"l_{c}") for c in head.columns if c != "key"])
    return state.join(head, "key").where("comp <> l_comp").where(_able("", "l_", "m" in state.columns))


def _ordered(pairs: DataFrame, x: str, y: str) -> DataFrame:
    return pairs.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))


def _first_met(state: DataFrame) -> DataFrame:
    best = _with(state, "lead").groupBy("rep").agg(F.min("lead").alias("lead"))
    return _ordered(best, "rep", "lead")


def _all_leaders(state: DataFrame) -> DataFrame:
    return _ordered(_with(state, "lead"), "rep", "lead")


def _all_pairs(state: DataFrame) -> DataFrame:
    """Pairs of one band value in different components that the bounds allow."""
    head = state.where("rep = lead").select("key", F.col("comp").alias("main")).distinct()
    m = state.join(head, "key").withColumn("minor", F.col("comp") != F.col("main")).drop("lead", "main")
    x, y = m.alias("x"), m.where("minor").alias("y")  # one of a pair is outside the leader's component
    hit = x.join(y, F.expr("x.key = y.key and x.comp <> y.comp and (not x.minor or x.rep < y.rep) and "
                           + _able("x.", "y.", "m" in state.columns)))
    return _ordered(hit.select(F.col("x.rep").alias("x"), F.col("y.rep").alias("y")), "x", "y")


ROUNDS = (_first_met, _all_leaders, _all_leaders, _all_pairs)
#: From this round on, the elements that only one document has are counted.
COUNTED = 2


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per input row."""
    spark = text_batches(docs.sparkSession)
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sig = written(text.mapInArrow(_signatures, "doc_id long, n long, k1 long, k2 long, bands array<long>"), "signatures")
    real = sig.where("n > 0 and doc_id is not null")
    reps = real.groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"))
    bands = reps.select("rep", "n", F.explode("bands").alias("key"))
    shared = bands.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    members = written(bands.join(shared, "key").select("key", "rep", "n"), "members")
    ids = members.select("rep").distinct()
    of_rep = text.join(ids, F.col("doc_id") == F.col("rep")).select("rep", "text")
    sets = written(of_rep.mapInArrow(_sets, "rep long, s array<long>, m array<long>").dropDuplicates(["rep"]), "sets")
    release(spark)

    comp, links, tested = None, None, None
    rest = members.withColumn("u", F.lit(0).cast("long"))
    for k, pick in enumerate(ROUNDS):
        state = written(_state(rest, comp), "state")
        if state.isEmpty():
            release(spark, state)
            break
        if k == COUNTED:
            own = written(_own_elements(state, sets), "own")
            rest = state.drop("u", "comp", "lead").join(own, "rep", "left").withColumn("u", F.coalesce("u", F.lit(0)))
            rest = rest.join(sets.select("rep", "m"), "rep")
            state = written(_state(rest, comp), "state")
        pairs = pick(state).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = written(pairs, "pairs")
        if not pairs.isEmpty():
            found = written(verified(pairs, sets), "links")
            links = found if links is None else links.union(found)
            tested = pairs if tested is None else tested.union(pairs)
            comp = written(components(links), "components")
        if k < COUNTED:
            release(spark, state)
    release(spark, members, sets)
    group = reps.select("k1", "k2", "n", "rep")
    if comp is not None:
        group = group.join(comp.withColumnRenamed("node", "rep"), "rep", "left").withColumn("rep", F.coalesce("component", "rep"))
    out = sig.drop("bands").alias("s").join(group.select("k1", "k2", "n", "rep"), ["k1", "k2", "n"], "left")
    own = F.when(F.col("n") > 0, F.col("rep")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"),
                      F.when(F.col("doc_id").isNotNull(), own).alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
