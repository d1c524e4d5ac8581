"""SimHash near-duplicates by multi-index hashing."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from propensity_spark.llm.common import map_texts, stored
from propensity_spark.llm.components import components

SEED = 42
#: Hashes summed up at once.
CHUNK = 1 << 14


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """64 bits, as a signed number: a bit is 1 if it is set in over half the hashes of the text's word shingles."""
    words = text.lower().split()  # of bytes: only A-Z change, and only the six ASCII white spaces divide
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.append(0, ends[:-1] + 1)
    n = max(1, len(words) - shingle + 1)
    stops = ends[shingle - 1:] if len(words) >= shingle else ends[-1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), stops.tolist())], np.uint64)
    sums = np.zeros(64, np.int64)
    for i in range(0, n, CHUNK):
        bits = np.unpackbits(hashes[i:i + CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sums += bits.sum(axis=0, dtype=np.int32)
    bits = np.packbits(sums * 2 > n, bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text", shingle: int = 4,
                 name: str = "fingerprint") -> DataFrame:
    """The columns `keep` and the fingerprint (signed 64-bit) of every whole text; 0 for a text without words."""
    return map_texts(docs, keep, text, lambda texts: [[fingerprint(t, shingle) for t in texts]],
                     [StructField(name, LongType())])


def segments(distance: int, count: int) -> list[tuple[int, int, int]]:
    """(shift, bits, radius) of `count` segments of 64 bits that together find every pair within `distance` bits.

    If a pair differed in more than its radius in every segment, it would differ in more than `distance` bits.
    """
    radius, extra = divmod(distance, count)
    widths = [64 // count + (i < 64 % count) for i in range(count)]
    shifts = [sum(widths[:i]) for i in range(count)]
    out = [(s, w, radius if i <= extra else radius - 1) for i, (s, w) in enumerate(zip(shifts, widths))]
    return [x for x in out if x[2] >= 0]


def _ball(bits: int, radius: int) -> list[int]:
    """All patterns of at most `radius` of `bits` bits."""
    ball = {0}
    for _ in range(radius):
        ball |= {x ^ (1 << b) for x in ball for b in range(bits)}
    return sorted(ball)


def _slots(fp: Column, parts: list[tuple[int, int, int]], balls: bool) -> Column:
    """Keys of the table entries of a fingerprint, or with `balls` of all entries to look up for it."""
    keys = []
    for i, (shift, bits, radius) in enumerate(parts):
        value = F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << bits) - 1).cast("bigint"))
        own = F.lit(i << 40).bitwiseOR(value)
        keys += [own.bitwiseXOR(F.lit(m).cast("bigint")) for m in (_ball(bits, radius) if balls else [0])]
    return F.array(*keys)


def _merge(one: DataFrame, other: DataFrame) -> DataFrame:
    """Join on slot by sorting both sides. Spark sizes what explode() made like the rows before it, and would broadcast it."""
    return one.hint("merge").join(other, "slot")


def candidates(known: DataFrame, parts: list[tuple[int, int, int]]) -> DataFrame:
    """(slot, fp, group, fp2, group2): pairs of fingerprints in a slot of which not both are of its largest group."""
    table = known.select("fp", "group", F.explode(_slots(F.col("fp"), parts, False)).alias("slot"))
    sizes = table.groupBy("slot", "group").agg(F.count(F.lit(1)).alias("n"))
    tops = stored(sizes.groupBy("slot").agg(F.max_by("group", F.struct("n", "group")).alias("top"),
                                            F.count(F.lit(1)).alias("groups")), "tops")
    probes = known.select("fp", "group", F.explode(_slots(F.col("fp"), parts, True)).alias("slot"))
    # Slots that hold only the searching fingerprint's own group have nothing to add.
    probes = stored(_merge(probes, tops).where((F.col("group") != F.col("top")) | (F.col("groups") > 1)), "probes")
    other = table.select("slot", F.col("fp").alias("fp2"), F.col("group").alias("group2"))
    strange = _merge(other, tops.where("groups > 1").select("slot", "top")).where(F.col("group2") != F.col("top"))
    # Of a slot's largest group no member searches for another: one end of each pair is a stranger to it.
    return _merge(probes.where(F.col("group") != F.col("top")).select("slot", "fp", "group"), other).unionByName(
        _merge(probes.where(F.col("groups") > 1).select("slot", "fp", "group"), strange.drop("top")))


def link(prints: DataFrame, distance: int = 4, count: int = 3) -> DataFrame:
    """(node, component) of the distinct fingerprints fp that have another one within `distance` bits.

    Multi-index hashing: every fingerprint is stored under each of its `count` segments; to search, the Hamming ball
    of the segment's radius is enumerated and what is stored there is compared in full. Links inside a dense group are
    not listed: first each fingerprint is compared with a few representatives of its slots, which joins most of a
    group; then slots in which all are joined already are passed over, and in the others the largest group is only
    compared with what is strange to it, so a large group costs its size times the strangers in its slots and never its
    square. No candidate is left out: a pair in one slot is either compared or joined already.
    """
    parts = segments(distance, count)
    near = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= distance
    entries = prints.select("fp", F.explode(_slots(F.col("fp"), parts, False)).alias("slot"))
    chosen = [F.min("fp"), F.max("fp"), *[F.min_by("fp", F.xxhash64("fp", F.lit(i))) for i in range(6)]]
    heads = entries.groupBy("slot").agg(F.count(F.lit(1)).alias("n"), F.array_distinct(F.array(*chosen)).alias("heads"))
    heads = heads.where("n > 1").select("slot", "heads")
    first = _merge(entries, heads).select("fp", F.explode("heads").alias("head"))
    first = first.where(near("fp", "head") & (F.col("fp") != F.col("head"))).distinct()
    joined = components(first, "fp", "head")
    known = prints.select("fp").join(joined.withColumnRenamed("node", "fp"), "fp", "left")
    known = stored(known.select("fp", F.coalesce("component", "fp").alias("group")), "groups")

    links = candidates(known, parts).where((F.col("group") != F.col("group2")) & near("fp", "fp2"))
    links = links.select(F.least("group", "group2").alias("a"), F.greatest("group", "group2").alias("b"))
    outer = components(links.distinct()).select(F.col("node").alias("group"), F.col("component").alias("top"))
    out = known.join(outer, "group", "left").select(F.col("fp").alias("node"), F.coalesce("top", "group").alias("component"))
    return out


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 4, distance: int = 4, count: int = 3,
) -> DataFrame:
    """One row per document: doc_id, fingerprint (signed 64-bit), component_id, component, content (hash of the text).

    A-Z are lower-cased, words are runs of anything but ASCII space and tab to carriage return, shingles are `shingle`
    words with one space between (fewer words: all of them; none: fingerprint 0, linked like any other). Documents
    whose fingerprints differ in at most `distance` bits are linked; component_id is the least doc_id that can be
    reached, itself included. Equal fingerprints are combined first, so copies cost nothing in the search. A document
    without id still links others; where a component has no id at all, component_id is NULL. Repeated ids keep their
    rows. `count` changes no result: a segment should have about as many bits as the number of distinct fingerprints,
    so three suit some millions and two, of 32 bits each, thousands of millions.
    """
    content = F.xxhash64(text).alias("content")
    every = stored(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), content, F.col(text).alias("text")),
                                ["doc_id", "content"], shingle=shingle, name="fp"), "fingerprints")
    prints = stored(every.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    groups = stored(prints.join(link(prints, distance, count).withColumnRenamed("node", "fp"), "fp"), "linked")
    # A table of its own, so that Spark can split a large component where its fingerprints meet the least id.
    least = stored(groups.groupBy("component").agg(F.min("first").alias("component_id")), "least")
    named = groups.join(least, "component").select("fp", "component_id", "component")
    return every.join(named, "fp").select(
        F.col("doc_id").alias(doc_id), F.col("fp").alias("fingerprint"), "component_id", "component", "content")
