"""SimHash near-duplicates: fingerprints, links within a Hamming distance found by shared blocks, and their components."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import ROW, packed, unpacked
from lectern.llm.components import components
from lectern.session import ship, stage

SEED = 42
BITS = 64
BLOCKS = 5
DISTANCE = 2
SLICE = 1 << 14  # hashes counted at once, so their bits take a megabyte
TEXTS = 1 << 8  # texts a task holds at once outside Arrow
HOT = 64  # fingerprints of one block that are still compared pair by pair


def _fingerprints(texts, shingle: int) -> np.ndarray:
    """One fingerprint per text. Hashes of a batch are counted bit by bit in slices, so a long text needs no more room than a short one."""
    sums = np.zeros((len(texts), BITS), np.int64)
    sizes = np.zeros(len(texts), np.int64)
    hashed: list[int] = []
    owners: list[tuple[int, int]] = []

    def count():
        if not hashed:
            return
        bits = np.unpackbits(np.array(hashed, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
        starts = np.cumsum([0, *(n for _, n in owners[:-1])])
        np.add.at(sums, [k for k, _ in owners], np.add.reduceat(bits, starts, axis=0, dtype=np.int64))
        hashed.clear()
        owners.clear()

    digest = xxhash.xxh64_intdigest
    for k, text in enumerate(texts):
        words = text.encode().lower().split() if text else []  # of bytes: ASCII letters and ASCII white space only
        if not words:
            continue
        joined = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        if len(words) > shingle:
            starts, ends = starts[: len(words) - shingle + 1], ends[shingle - 1:]
        else:
            starts, ends = np.array([0]), np.array([len(joined)])
        sizes[k] = len(starts)
        for low in range(0, len(starts), SLICE):
            part = list(zip(starts[low:low + SLICE].tolist(), ends[low:low + SLICE].tolist(), strict=True))
            hashed.extend([digest(joined[a:b], SEED) for a, b in part])
            owners.append((k, len(part)))
            if len(hashed) >= SLICE:
                count()
    count()
    return np.packbits(2 * sums > sizes[:, None], axis=1).view(">u8").astype(np.uint64).ravel()


def fingerprints(docs: DataFrame, *, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp: the 64-bit SimHash (as a signed long) over shingles of words, repeats included; 0 without words."""
    ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, TEXTS):
                part = batch.slice(low, TEXTS)
                fp = _fingerprints(part.column("text").to_pylist(), shingle)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def links(distinct: DataFrame) -> DataFrame:
    """Links a < b between distinct fingerprints that differ in 1 or 2 bits.

    The bits are split into five blocks. Two differing bits touch two blocks at most, so three blocks are equal: each
    fingerprint joins under its ten choices of three blocks, and the distance of those that meet is verified. A choice
    under which more than `HOT` fingerprints meet is not compared pair by pair. There each fingerprint stands under itself and
    each flip of one bit outside the choice; two share such a key just when they are within two bits, so all of
    a key's fingerprints link to its least one. Both ways keep every component whole.
    """
    edges = [round(i * BITS / BLOCKS) for i in range(BLOCKS + 1)]
    blocks = [((1 << edges[i + 1]) - (1 << edges[i])) for i in range(BLOCKS)]
    masks = [sum(c) for c in combinations(blocks, BLOCKS - DISTANCE)]

    def signed(x):
        return x - (1 << 64) if x >> 63 else x

    choices = F.explode(F.array(*[F.struct(F.lit(k).alias("choice"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("block")) for k, m in enumerate(masks)]))
    keyed = stage(distinct.select("fp", choices.alias("c")).select("fp", "c.choice", "c.block"), "simhash-blocks")
    groups = keyed.groupBy("choice", "block").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = stage(keyed.join(groups, ["choice", "block"]), "simhash-met")

    cool = met.where(F.col("n") <= HOT)
    other = cool.select("choice", "block", F.col("fp").alias("b"))
    pairs = cool.withColumnRenamed("fp", "a").join(other, ["choice", "block"]).where("a < b")
    pairs = pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE).select("a", "b")

    outside = F.lit(None)
    for k, mask in enumerate(masks):
        flips = [0, *(1 << i for i in range(BITS) if not mask >> i & 1)]
        outside = F.when(F.col("choice") == k, F.array(*[F.lit(signed(x)).cast("long") for x in flips])).otherwise(outside)
    near = met.where(F.col("n") > HOT).select("choice", "block", "fp", F.explode(outside).alias("flip"))
    near = near.select("choice", F.col("fp").bitwiseXOR(F.col("flip")).alias("key"), "fp")
    least = near.groupBy("choice", "key").agg(F.min("fp").alias("a"))
    stars = near.join(least, ["choice", "key"]).where("a < fp").select("a", F.col("fp").alias("b"))
    return pairs.union(stars).distinct()


def grouped(docs: DataFrame, *, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id: the smallest id reachable over links, the document itself included.

    A null text counts as empty; documents without words have fingerprint zero and link like any other; rows that repeat an id
    or a text share a fingerprint, so equal rows come out equal; null ids never are the smallest, and a
    component of null ids alone has a null component_id; an empty table gives no rows; other columns are not read.
    """
    marked = stage(fingerprints(docs, shingle=shingle, id_col=id_col, text_col=text_col), "simhash")
    distinct = stage(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    joined = components(stage(links(distinct.select("fp")), "simhash-links"))
    labelled = distinct.join(joined.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    least = labelled.groupBy("label").agg(F.min("first").alias("component_id"))
    # Fingerprints with links lead over their label to the least id; a table of distinct fingerprints meets the documents once.
    by_fp = labelled.join(least, "label").select("fp", "component_id")
    return marked.join(by_fp, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, *, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with the smallest id of their component, whole rows. Of rows that repeat this id one stays; rows with a null id stay."""
    groups = grouped(docs, shingle=shingle, id_col=id_col, text_col=text_col).where("doc_id = component_id").select(F.col("doc_id").alias("__keep")).distinct()
    rows = packed(docs, docs[id_col].cast("long").alias("__id"))
    kept = rows.where("__id IS NOT NULL").join(groups, F.col("__id") == F.col("__keep"))
    one = kept.groupBy("__id").agg(F.min_by(ROW, F.xxhash64(ROW)).alias(ROW))
    return unpacked(one.select(ROW).union(rows.where("__id IS NULL").select(ROW)), docs.columns)
