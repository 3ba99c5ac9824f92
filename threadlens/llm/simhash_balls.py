"""SimHash near-duplicates: fingerprints met in the middle on shared variants.

Fingerprints within ``distance`` bits of each other are found by balls of half the radius. An odd distance is
made even first: the bits are cut into three blocks, and two fingerprints that differ in 1 to 3 bits
differ in at most 2 bits outside some block that has a difference. So for each block every fingerprint emits
the ball of radius 1 over the other bits (131 variants in all), rows meet by shuffle on (block, variant), and
what collides is verified bit by bit.

A bucket (block, variant) never emits all its pairs. Members with the same bits inside the block differ in
two bits at most and are chained to one of them; one representative for each value of the block is compared
with the few members that are the variant itself, and, for differences in all three blocks, with those whose
flipped bit lies in the other block. That keeps every connection, so components are exact.

Components come from alternating large and small stars over distinct fingerprints; each round is written to
the shared folder. Defined results: null and wordless texts have fingerprint zero and are linked like any
others; equal fingerprints are one node; the class id is the smallest key; rows with a null key keep their
fingerprint, and count as the smallest key of nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadlens.llm.common import map_texts
from threadlens.runtime import snapshot

SHINGLE, DISTANCE, BLOCKS, SEED = 3, 3, 3, 42


def fingerprint(text: str, width: int = SHINGLE) -> int:
    """64-bit SimHash over word shingles, repeats included, as a signed long."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
    hashes = np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for start in range(0, len(hashes), 65536):
        bits = np.unpackbits(hashes[start : start + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = SHINGLE) -> DataFrame:
    """(key, fp): the fingerprint of every text as a long."""
    return map_texts(docs, text, {key: key}, [("fp", "long", pa.int64())], lambda texts, _: [[fingerprint(t, width) for t in texts]])


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def block_bits() -> list[list[int]]:
    """The bit numbers of each block."""
    edges = [round(64 * i / BLOCKS) for i in range(BLOCKS + 1)]
    return [list(range(edges[i], edges[i + 1])) for i in range(BLOCKS)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def balls(distinct: DataFrame) -> DataFrame:
    """(fp, block, variant): the ball of radius 1 of every fingerprint outside each block."""
    made = []
    for number, own in enumerate(block_bits()):
        outside = _signed(sum(1 << b for b in range(64) if b not in own))
        flips = F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << b)) for b in range(64) if b not in own])
        made.append(F.transform(flips, _flipper(number, F.col("fp").bitwiseAND(F.lit(outside)))))
    return distinct.select("fp", F.inline(F.flatten(F.array(*made))))


def _flipper(number: int, rest: Column):
    return lambda flip: F.struct(F.lit(number).alias("block"), rest.bitwiseXOR(flip).alias("variant"))


def links(distinct: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Links (a, b) between distinct fingerprints that join all within ``distance`` bits; each link is verified.

    Not every pair is listed, but any two fingerprints within the distance are connected.
    """
    if distance not in (1, 2, 3):
        raise ValueError("balls of radius 1 and one dropped block reach distances 1 to 3")
    masks = [_signed(sum(1 << b for b in own)) for own in block_bits()]
    met = balls(distinct).withColumn("members", F.count("fp").over(Window.partitionBy("block", "variant"))).where("members > 1").drop("members")
    inside = F.col("fp").bitwiseAND(F.element_at(F.array(*[F.lit(m) for m in masks]), F.col("block") + 1))
    met = met.withColumn("inside", inside).withColumn("flip", F.col("fp").bitwiseXOR(F.col("inside")).bitwiseXOR(F.col("variant")))
    met = snapshot(met, "met")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance

    # one inside value: any two differ in the two flipped bits at most, and from the centre in one
    same = Window.partitionBy("block", "variant", "inside")
    hub = F.coalesce(F.min(F.when(F.col("flip") == 0, F.col("fp"))).over(same), F.min("fp").over(same))
    chained = met.select(F.col("fp").alias("b"), hub.alias("a")).where("a <> b").where(near)

    # other inside values, by one representative each. With the most differing block dropped, two fingerprints
    # differ outside in no bit, in one (one of them is a centre), or in one bit of each other block.
    def least(condition):
        return F.min(F.when(condition, F.col("fp")))

    second = F.col("flip").bitwiseAND(F.lit(masks[1])) != 0
    kinds = met.groupBy("block", "variant", "inside").agg(
        least(F.col("flip") == 0).alias("centre"), least(F.col("flip") != 0).alias("off"), least(second).alias("second"), least((F.col("flip") != 0) & ~second).alias("third")
    )
    centres = kinds.where("centre is not null").select("block", "variant", F.col("inside").alias("i"), F.col("centre").alias("a"))
    others = kinds.select("block", "variant", F.col("inside").alias("j"), F.explode(F.array("centre", "off")).alias("b")).where("b is not null")
    around = centres.join(others, ["block", "variant"]).where("i <> j").where(near)
    first = kinds.where("block = 0")
    ones = first.where("second is not null").select("variant", F.col("inside").alias("i"), F.col("second").alias("a"))
    twos = first.where("third is not null").select("variant", F.col("inside").alias("j"), F.col("third").alias("b"))
    across = ones.join(twos, "variant").where("i <> j").where(near)
    found = chained.select("a", "b").unionByName(around.select("a", "b")).unionByName(across.select("a", "b"))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for every node of an edge. Alternating stars until nothing moves."""
    edges = snapshot(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: neighbours above u go to the smallest of u and its neighbours
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: of what is left below u, all go to the smallest
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        edges = snapshot(small, "edges")
        state = edges.agg(F.count("u").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = state


def classes(prints: DataFrame, key: str = "doc_id", distance: int = DISTANCE) -> DataFrame:
    """(fp, component_id, root) for every distinct fingerprint of ``prints`` (key, fp): the smallest key reachable, and the class."""
    nodes = snapshot(prints.groupBy("fp").agg(F.min(key).alias("least")), "nodes")
    found = components(links(nodes.select("fp"), distance))
    rooted = nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(smallest, "root").select("fp", "component_id", "root")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """One row per document: key, ``fingerprint`` (16 hex digits) and ``component_id``."""
    prints = snapshot(fingerprints(docs, text, key, width), "prints")
    named = snapshot(classes(prints, key, distance), "classes")
    return prints.join(named, "fp").select(key, as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """One document of each class, the one with the smallest key, with all its columns.

    Rows with a null key are kept, as no class names them. Rows that repeat a key are told apart by their texts: each
    stands for the class of its own text, and of one class the text that sorts first stays.
    """
    prints = snapshot(fingerprints(docs, text, key, width), "prints")
    named = snapshot(classes(prints, key, distance).where("component_id is not null"), "classes")
    chosen = snapshot(named.select(F.col("component_id").alias(key)).distinct(), "chosen")
    repeats = snapshot(prints.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").select(key), "repeats")
    # the only step that moves texts: once, and in the same way at every size
    kept = docs.join(chosen.hint("shuffle_hash"), key, "left_semi").select(*docs.columns)
    if not repeats.isEmpty():
        body = F.coalesce(F.col(text).cast("string"), F.lit(""))
        many = kept.join(repeats, key, "left_semi").withColumn("_row", F.struct(*docs.columns)).select(F.col(key).alias("_key"), body.alias("_body"), "_row")
        texts = many.select("_key", "_body").distinct().select(F.struct("_key", "_body").alias("_at"), "_body")
        own = fingerprints(texts, "_body", "_at", width).join(named, "fp").where("_at._key = component_id")
        first = own.groupBy("root").agg(F.min("_at").alias("_at")).select("_at._key", "_at._body").distinct()
        once = many.join(first, ["_key", "_body"]).groupBy("_key", "_body").agg(F.any_value("_row").alias("_row")).select("_row.*")
        kept = kept.join(repeats, key, "left_anti").select(*docs.columns).unionByName(once)
    return kept.unionByName(docs.where(F.col(key).isNull()))
