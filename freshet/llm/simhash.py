"""SimHash near-duplicates: a generalised pigeonhole search for fingerprints within a Hamming distance."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_batches, freed, joined_by, measured_bytes, released, sent_if_small, settled, spread
from .components import connected, stars
from .tokenization import in_parts

BITS = 64
#: Fingerprints with the same bits in one partition up to which all pairs are compared at once; more of them are crowded.
BUCKET_PAIRS = 1024
#: Of a crowded bucket, how many fingerprints a turn are compared with all others first, how many turns at most, and comparisons
#: to come for each row up to which these turns end.
LEADS, LEAD_ROUNDS, ROW_PAIRS = 8, 4, 5000
#: Shingle sets that share a key up to which all pairs are compared, parts of larger buckets with a centre each at first,
#: by how many times more there are after a round that linked nothing, and rounds after which all pairs of what is left are compared.
FEW_SETS, CENTRES, MORE_CENTRES, CENTRE_ROUNDS = 16, 8, 8, 8
#: Shingles known to be common at most.
COMMON_SHINGLES = 100_000
#: Measured bytes of keys and sets that are sent to every executor at most. As a hash table on the driver, keys take several times that.
SENT_BYTES = 16_000_000
#: Counts, of a byte each, by which sets are compared before they move.
COARSE = 256


def shingle_hashes(text: str, width: int, seed: int) -> list[int]:
    """XXH64 of each run of ``width`` words; of the whole sequence where there are fewer; none without words."""
    words = text.encode().lower().split()  # on bytes: A-Z only, and only the six ASCII space characters
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(joined, seed)]
    spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    begins = [0, *(spaces[: len(words) - width] + 1).tolist()]
    ends = [*spaces[width - 1 :].tolist(), len(joined)]
    hash64 = xxhash.xxh64_intdigest
    return [hash64(joined[a:b], seed) for a, b in zip(begins, ends, strict=True)]


def majority_bits(hashes: np.ndarray, begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each run of hashes, the bits set in over half of them; 0 for an empty run."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if len(full):
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, begins[full], axis=0, dtype=np.int32)
        most = ones * 2 > counts[full][:, None]
        out[full] = np.packbits(most, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, width: int = 5, seed: int = 42, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of each row; null and empty texts have 0. Texts don't move."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for begin, end in in_parts(texts, 1_000_000):
                each = [np.array(shingle_hashes(t, width, seed), np.uint64) for t in texts[begin:end]]
                counts = np.array([len(h) for h in each])
                hashes, begins = np.concatenate([*each, np.zeros(0, np.uint64)]), np.cumsum(counts) - counts
                found = majority_bits(hashes, begins, counts)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(begin, end - begin), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


@dataclass(frozen=True)
class Plan:
    """Partitions of the bits, and the distance up to which each is probed (-1: not at all)."""

    parts: tuple[tuple[int, ...], ...]
    thresholds: tuple[int, ...]


def bit_counts(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how many have both bits i and j set, over all of them: 64 x 64 sums, whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((BITS, BITS), np.int64), 0
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            both += np.rint(bits.T @ bits).astype(np.int64)
            n += len(values)
        yield pa.RecordBatch.from_pydict({"at": pa.array(range(BITS * BITS + 1), pa.int32()), "n": pa.array([*both.ravel().tolist(), n], pa.int64())})

    sums = np.zeros(BITS * BITS + 1, np.int64)
    for at, n in nodes.select("fp").mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n")).collect():
        sums[at] = n
    return int(sums[-1]), sums[:-1].reshape(BITS, BITS)


def group_bits(n: int, both: np.ndarray, parts: int) -> tuple[tuple[int, ...], ...]:
    """Bits in ``parts`` groups of near-equal size, each grown from its first bit by the most correlated ones left."""
    p = np.diag(both) / max(n, 1)
    scale = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    tie = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(scale, scale)
    left, groups = list(range(BITS)), []
    for k in range(parts):
        group = [left.pop(0)]
        while len(group) < BITS // parts + (k < BITS % parts):
            group.append(left.pop(int(np.argmax([round(float(tie[b, group].sum()), 9) for b in left]))))
        groups.append(tuple(sorted(group)))
    return tuple(groups)


def within(differ: np.ndarray, most: int) -> np.ndarray:
    """Probability that at most 0, 1, ... ``most`` of independent bits differ, each with its own probability."""
    law = np.zeros(most + 1)
    law[0] = 1
    for p in differ:
        law = law * (1 - p) + np.append(0, law[:-1]) * p
    return np.cumsum(law)


def choose_plan(n: int, both: np.ndarray, distance: int) -> Plan:
    """The partitions and thresholds with the least estimated work.

    With thresholds that sum to ``distance`` - parts + 1, any two fingerprints within ``distance`` are within the
    threshold in some partition. For each number of partitions, dynamic programming divides that sum; the cost of a
    threshold is its signatures, each a row to move, and the pairs it is expected to bring to a comparison.
    """
    p = np.diag(both) / max(n, 1)
    row, pair = 1.0, 0.005  # relative cost of moving a signature and of comparing a pair
    best: tuple[float, Plan] | None = None
    for parts in range(1, distance + 2):
        groups, total = group_bits(n, both, parts), distance - parts + 1
        table: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
        for group in groups:
            near = within(2 * p[list(group)] * (1 - p[list(group)]), distance)
            nxt: dict[int, tuple[float, tuple[int, ...]]] = {}
            for used, (cost, chosen) in table.items():
                for t in range(-1, distance + 1):
                    signatures = sum(math.comb(len(group), k) for k in range(t + 1))
                    more = cost + (n * (row * (signatures + 1) + pair * n * near[t]) if t >= 0 else 0.0)
                    if used + t not in nxt or more < nxt[used + t][0]:
                        nxt[used + t] = (more, (*chosen, t))
            table = nxt
        if total in table and (best is None or table[total][0] < best[0]):
            best = (table[total][0], Plan(groups, table[total][1]))
    return best[1]


def _signed(bits: tuple[int, ...]) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << BITS) if value >> (BITS - 1) else value


def _flips(bits: tuple[int, ...], most: int) -> Column:
    """All masks that flip up to ``most`` of these bits."""
    return F.array(*[F.lit(_signed(c)).cast("long") for k in range(most + 1) for c in combinations(bits, k)])


def _index(nodes: DataFrame, plan: Plan) -> DataFrame:
    """part, key, with the columns of ``nodes``: a row for each partition that is probed."""
    keys = F.array(*[F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(_signed(g)).cast("long")).alias("key")) for i, g in enumerate(plan.parts) if plan.thresholds[i] >= 0])
    return nodes.select("*", F.explode(keys).alias("_k")).select("_k.part", "_k.key", *nodes.columns)


def _crowds(nodes: DataFrame, plan: Plan, bucket_pairs: int) -> DataFrame:
    """part, key (settled) of the buckets, of fingerprints with the same bits in a partition, that have more than so many."""
    return settled(_index(nodes, plan).groupBy("part", "key").agg(F.count("*").alias("n")).filter(F.col("n") > bucket_pairs))


def _met(nodes: DataFrame, distance: int, plan: Plan, crowds: DataFrame | None = None, bucket_pairs: int = BUCKET_PAIRS) -> DataFrame:
    """All pairs a, b of fingerprints within ``distance``, by probing each partition and comparing; of different components,
    where ``nodes`` (fp, component, size) has components of more than one fingerprint.

    The smaller component of a pair probes. In ``crowds`` (part, key, n, top: the largest size and component), whose largest
    component therefore is only looked up, probes are dealt over as many parts as there are ``bucket_pairs`` fingerprints,
    and each part has all of the bucket. Without ``top`` these buckets are left out.
    """
    name = lambda c: [F.col("fp").alias(c), F.struct("size", "component").alias(f"{c}_of")]
    index = _index(nodes, plan).select("part", "key", *name("b"))
    probes = None
    for i, t in enumerate(plan.thresholds):
        if t >= 0:
            near = nodes.select(F.lit(i).alias("part"), *name("a"), F.explode(_flips(plan.parts[i], t)).alias("_flip"))
            near = near.select("part", F.col("a").bitwiseAND(F.lit(_signed(plan.parts[i])).cast("long")).bitwiseXOR(F.col("_flip")).alias("key"), "a", "a_of")
            probes = near if probes is None else probes.union(near)
    on = ["part", "key"]
    if crowds is not None and "top" in crowds.columns:
        dealt = sent_if_small(crowds.select("part", "key", "top", F.ceil(F.col("n") / bucket_pairs).cast("int").alias("_parts")))
        of = lambda df: df.join(dealt, ["part", "key"], "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
        probes = of(probes).filter(F.col("top").isNull() | (F.col("a_of") < F.col("top"))).select("part", "key", "a", "a_of", F.pmod(F.xxhash64("a"), "_parts").cast("int").alias("_deal"))
        index = of(index).select("part", "key", "b", "b_of", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_deal"))
        on = [*on, "_deal"]
    elif crowds is not None:
        index = index.join(sent_if_small(crowds.select("part", "key")), on, "left_anti")
    close = (F.col("a_of") < F.col("b_of")) & (F.col("a_of.component") != F.col("b_of.component")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    return probes.join(index, on).filter(close).select("a", "b", F.col("a_of.component").alias("a_component"), F.col("b_of.component").alias("b_component"))


def _led(packed: DataFrame, distance: int, turn: int) -> DataFrame:
    """Pairs a, b within ``distance`` of fingerprints of crowded buckets (part, key, fp) and the bucket's ``LEADS``, other ones each turn."""
    order = F.xxhash64("fp", F.lit(turn))
    lead = packed.groupBy("part", "key", F.pmod(order, F.lit(LEADS)).alias("_lead")).agg(F.min_by("fp", order).alias("b")).groupBy("part", "key").agg(F.collect_list("b").alias("leads"))
    met = packed.join(sent_if_small(settled(lead)), ["part", "key"]).select(F.col("fp").alias("a"), F.explode("leads").alias("b"))
    return met.filter((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance))


def near_duplicates(docs: DataFrame, distance: int = 3, width: int = 5, seed: int = 42, id_column: str = "doc_id", text_column: str = "text", bucket_pairs: int = BUCKET_PAIRS) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id reachable over fingerprints within ``distance`` bits.

    Equal fingerprints are one node. All pairs of fingerprints that share a probed value are compared, and of large groups
    of near copies only what a first look at some of them has left apart, so a large group costs what its members cost.
    Null and empty texts have fingerprint 0 and are linked like any other; repeated rows are linked by their fingerprint.
    Null doc_ids take part but name a component only where it has no other. An empty table gives no rows; other columns,
    whatever their names, play no part.
    """
    with arrow_batches(docs.sparkSession, 1000):
        found = settled(fingerprints(docs, width, seed, id_column, text_column))
    nodes = settled(spread(found.groupBy("fp").agg(F.min("doc_id").alias("first")), "fp"))
    labelled = settled(nodes.join(fingerprint_components(nodes.select("fp"), distance, bucket_pairs), "fp"))
    named = labelled.groupBy("component").agg(F.min("first").alias("component_id"))
    of_fp = joined_by(labelled.select("fp", "component"), named, "component", "inner").select("fp", "component_id")
    return joined_by(found, of_fp, "fp", "inner").select("doc_id", "fp", "component_id")


def fingerprint_components(nodes: DataFrame, distance: int, bucket_pairs: int = BUCKET_PAIRS) -> DataFrame:
    """fp, component (a fingerprint) of each of these different fingerprints (checkpointed column fp).

    All pairs of a bucket are compared at once, and each task hands on only the edges that connect what its pairs do. Where
    buckets are crowded, some of their fingerprints are compared with all of the bucket before that, in a few turns; what is
    then in the largest component of a bucket is not compared within it.
    """
    alone = nodes.select("fp", F.col("fp").alias("component"), F.lit(1).cast("long").alias("size"))
    n, both = bit_counts(nodes)
    if not n:
        return alone.select("fp", "component")
    plan = choose_plan(n, both, distance)
    crowds = _crowds(nodes, plan, bucket_pairs)
    if crowds.isEmpty():
        found = connected(stars(_met(alone, distance, plan)))
        return _renamed(nodes, found)
    packed = settled(_index(nodes, plan).join(sent_if_small(crowds.select("part", "key")), ["part", "key"]).select("part", "key", "fp"))
    edges = None
    for turn in range(LEAD_ROUNDS):
        more = settled(stars(_led(packed, distance, turn)))
        edges = more if edges is None else edges.union(more)
        labelled = settled(_renamed(nodes, connected(edges)))
        of = packed.join(labelled, "fp").groupBy("part", "key", "component").count().groupBy("part", "key").agg(F.sum("count").alias("n"), F.max("count").alias("most"))
        rows, pairs = of.agg(F.sum("n"), F.sum(F.col("n") * (F.col("n") - F.col("most")))).first()
        if pairs <= ROW_PAIRS * rows:
            break
    sizes = labelled.groupBy("component").agg(F.count("*").alias("size"))
    alone = settled(joined_by(labelled, sizes, "component", "inner").select("fp", "component", "size"))
    tops = _index(alone, plan).groupBy("part", "key").agg(F.count("*").alias("n"), F.max(F.struct("size", "component")).alias("top"))
    tops = settled(tops.filter(F.col("n") > bucket_pairs))
    met = stars(_met(alone, distance, plan, tops, bucket_pairs).select(F.col("a_component").alias("a"), F.col("b_component").alias("b")))
    # components are named by fingerprints, so the edges of all turns connect fingerprints
    return _renamed(nodes, connected(edges.union(met)))


def _renamed(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """fp, component of all ``nodes`` (fp), of which ``found`` has those that are linked."""
    return nodes.select("fp").join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"))


def common_shingles(docs: DataFrame, width: int, seed: int) -> np.ndarray:
    """Hashes, sorted, of the shingles that most documents (doc_id, text) have, counted in every batch where they repeat.
    They only order the shingles, so that a missed one costs time and no pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for begin, end in in_parts(texts, 1_000_000):
                each = [np.unique(np.array(shingle_hashes(t, width, seed), np.uint64)) for t in texts[begin:end]]
                found, n = np.unique(np.concatenate([*each, np.zeros(0, np.uint64)]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found[n > 1].view(np.int64)), pa.array(n[n > 1].astype(np.int64))], ["shingle", "n"])

    counts = docs.select("text").mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    most = counts.filter("n >= 8").orderBy(F.desc("n"), "shingle").limit(COMMON_SHINGLES)
    return np.sort(most.select("shingle").toArrow().column(0).to_numpy().astype(np.int64).view(np.uint64))


def shingle_sets(docs: DataFrame, similarity: float, width: int, seed: int, common: np.ndarray | None) -> DataFrame:
    """doc_id, node (a hash of the document's set of shingles), size, and of the set, as hashes, with ``common`` the first
    ones in a fixed order that any set as similar must share one of (keys), common shingles last, the number of others
    (rare) and the text's fingerprint (fp); without it all, by the low half of their hashes (shingles): two different
    ones of a pair of texts with a thousand shingles each agree by chance once in 4000 pairs. ``docs`` has doc_id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for begin, end in in_parts(texts, 1_000_000):
                each = [np.array(shingle_hashes(t, width, seed), np.uint64) for t in texts[begin:end]]
                nodes, sizes, rare, lists = [], [], [], []
                for hashes in each:
                    own = np.unique(hashes)
                    nodes.append(xxhash.xxh64_intdigest(own.tobytes()))
                    sizes.append(len(own))
                    if common is not None:
                        late = np.isin(own, common, assume_unique=True)
                        rare.append(len(own) - int(late.sum()))
                        # the rounding of the product must not shorten the list
                        first = len(own) - math.ceil(similarity * len(own) - 1e-9) + 1 if len(own) else 0
                        own = np.concatenate([own[~late], own[late]])[:first]
                    lists.append(own.view(np.int64) if common is not None else own.astype(np.uint32).view(np.int32))
                places = np.cumsum([0, *map(len, lists)]).astype(np.int32)
                flat = pa.ListArray.from_arrays(pa.array(places), pa.array(np.concatenate([np.zeros(0, np.int64 if common is not None else np.int32), *lists])))
                out = {"doc_id": batch.column("doc_id").slice(begin, end - begin), "node": pa.array(np.array(nodes, np.uint64).view(np.int64)), "size": pa.array(sizes, pa.int32())}
                if common is None:
                    out["shingles"] = flat
                else:
                    counts = np.array([len(h) for h in each])
                    prints = majority_bits(np.concatenate([*each, np.zeros(0, np.uint64)]), np.cumsum(counts) - counts, counts)
                    out |= {"fp": pa.array(prints.view(np.int64)), "rare": pa.array(rare, pa.int32()), "keys": flat}
                yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, node long, size int, " + ("shingles array<int>" if common is None else "fp long, rare int, keys array<long>"))


def _candidates(members: DataFrame, similarity: float, few: int | None, parts: int) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Pairs a, b of nodes of different components that share a key and can be as similar; and the members (key, place,
    node, size, rare, component) whose pairs are not all among them; last, the settled tables that both read. No more than ``few`` (None: any number) of a key are
    paired with each other; of more, one (b) of each of ``parts`` parts with all, those with the fewest rare shingles, which are most like the rest."""
    sides = members.groupBy("key").agg(F.count("*").alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo != hi")
    open_ = settled(members.join(sides.select("key", "n"), "key"))
    small = open_.drop("n") if few is None else open_.filter(F.col("n") <= few).drop("n")
    large = open_.filter("false").drop("n") if few is None else open_.filter(F.col("n") > few).drop("n")
    side = lambda df, name: df.select("key", *[F.col(c).alias(f"{name}_{c}") for c in ("node", "size", "place", "component")])
    # both can have at most so many shingles in common, if this key is the first that they share
    most = F.least(F.col("a_size") - F.col("a_place"), F.col("b_size") - F.col("b_place"))
    fits = (most / (F.col("a_size") + F.col("b_size") - most) >= similarity) & (F.col("a_component") != F.col("b_component"))
    ends = [F.col("a_node").alias("a"), F.col("b_node").alias("b")]
    pairs = side(small, "a").join(side(small, "b"), "key").filter(fits & (F.col("a_node") > F.col("b_node"))).select(*ends)
    if few is None:
        return pairs.distinct(), large, [open_]
    part = F.pmod(F.xxhash64("node"), F.lit(parts))
    centres = settled(large.groupBy("key", part.alias("part")).agg(F.min(F.struct("rare", "node", "size", "place", "component")).alias("c")).select("key", "c.*"))
    placed = F.broadcast if measured_bytes(centres) <= SENT_BYTES else lambda df: df
    met = side(large, "a").join(placed(side(centres, "b")), "key").filter(fits & (F.col("a_node") != F.col("b_node"))).select(*ends)
    left = large.join(placed(centres.select("key", "node")), ["key", "node"], "left_anti")
    return pairs.union(met).distinct(), left, [open_, centres]


def coarse_counts(sets: DataFrame) -> DataFrame:
    """node, size and counts: how many shingles of the set have each value in their lowest bits, 255 at most, a byte each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("shingles")
            rows = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            flat = rows * COARSE + (lists.flatten().to_numpy() & (COARSE - 1))
            counts = np.minimum(np.bincount(flat, minlength=batch.num_rows * COARSE), 255).astype(np.uint8).reshape(-1, COARSE)
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("size"), pa.array([c.tobytes() for c in counts], pa.binary())], ["node", "size", "counts"])

    return sets.select("node", "size", "shingles").mapInArrow(run, "node long, size int, counts binary")


def may_be_alike(pairs: DataFrame, coarse: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes but those whose ``coarse_counts`` differ by more than sets as similar can.

    Counts of two sets differ by as many as the shingles that one of them has alone, or fewer, and of sets as similar these
    are at most (1 - ``similarity``) / (1 + ``similarity``) of both sizes. So no pair is lost, and of a pair a row of few bytes moves.
    """
    placed = F.broadcast if measured_bytes(pairs) <= SENT_BYTES else lambda df: df
    of = lambda name: coarse.select(F.col("node").alias(name), F.col("size").alias(f"{name}_size"), F.col("counts").alias(f"{name}_counts"))
    most = (1 - similarity) / (1 + similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, COARSE).astype(np.int16) for c in ("a_counts", "b_counts")]
            differ = np.abs(counts[0] - counts[1]).sum(axis=1, dtype=np.int64)
            sizes = sum(batch.column(c).to_numpy().astype(np.int64) for c in ("a_size", "b_size"))
            yield batch.select(["a", "b"]).filter(pa.array(differ <= most * sizes + 1e-6))

    met = of("a").join(placed(pairs), "a").join(of("b"), "b")
    return met.select("a", "b", "a_size", "b_size", "a_counts", "b_counts").mapInArrow(run, "a long, b long")


def _alike(pairs: DataFrame, sets: DataFrame, coarse: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b), settled, of nodes whose whole sets are as similar. ``pairs`` is settled and goes. Sets move only for
    pairs that ``may_be_alike``: to side b at any size, those of side a after the pairs, which are sent to every executor
    where they are measured to be small enough."""
    if pairs.isEmpty():
        return pairs
    met, pairs = pairs, settled(may_be_alike(pairs, coarse, similarity))
    released(met)
    if pairs.isEmpty():
        return pairs
    placed = F.broadcast if measured_bytes(pairs) <= SENT_BYTES else lambda df: df
    ends = pairs.select(F.col("b").alias("node")).distinct()  # no more rows than pairs, and narrower
    of_b = settled(sets.join(placed(ends), "node", "left_semi").select(F.col("node").alias("b"), F.col("size").alias("b_size"), F.col("shingles").alias("b_set")))
    freed(sets.sparkSession)  # the exchanges that made the pairs, before the sets move
    of_a = sets.select(F.col("node").alias("a"), F.col("size").alias("a_size"), F.col("shingles").alias("a_set"))
    both = F.size(F.array_intersect("a_set", "b_set"))
    met = of_a.join(placed(pairs), "a").join(of_b, "b")
    alike = settled(met.filter(both / (F.col("a_size") + F.col("b_size") - both) >= similarity).select("a", "b"))
    released(pairs, of_b)
    return alike


def similar_texts(docs: DataFrame, similarity: float = 0.8, width: int = 5, seed: int = 42, id_column: str = "doc_id", text_column: str = "text", few: int = FEW_SETS, distance: int = 4) -> DataFrame:
    """doc_id, component_id: the smallest doc_id reachable over texts whose sets of shingles have a Jaccard similarity of
    ``similarity`` or more. No such pair is lost.

    First, fingerprints within ``distance`` bits are searched by the pigeonhole plan, and one partner of each is verified by
    the whole sets; that joins most copies. At a similarity of 0.8 fingerprints differ in ten bits on average, in more than
    any search can reach, so the others meet another way: shingles are in one order for all texts, by hash, those known
    to be common last. Of two sets as similar each has one of the other's among its first 1 - ``similarity`` (and one
    more), so sets meet by these; the whole sets are compared where they do. In buckets of over ``few`` sets some are
    compared with all others, and only what this leaves in different components goes to the next round, so a large group
    of near copies costs what its members cost. After a round that links nothing, more of them are compared at once. Texts without words are one group; null doc_ids take part but name a
    component only where it has no other; an empty table gives no rows; other columns play no part.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    with arrow_batches(spark, 1000):
        common = common_shingles(texts, width, seed)
        found = settled(shingle_sets(texts, similarity, width, seed, common))
        once = settled(spread(found.select("node", "size", "fp", "rare", "keys").dropDuplicates(["node"]), "node"))
        ids = settled(found.select("doc_id", "node"))
        released(found)
        index = once.select("node", "size", "rare", F.posexplode("keys").alias("place", "key"))
        # a node has a key once, so rows are nodes; each row moves once, to its key, at any size
        counted = index.withColumn("n", F.count("*").over(Window.partitionBy("key")))
        members = settled(counted.filter("n > 1").drop("n").withColumn("component", F.col("node")))
        # sets without a key in common with another have no partner, whatever their fingerprints
        wanted = settled(members.select("node").distinct())
        held = settled(once.select("node", "fp").join(wanted, "node", "left_semi"))
        released(once)
        del index, counted
        freed(spark)  # the keys' exchange
        firsts = ids.join(wanted, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("_first"))
        firsts = settled(firsts.select("_first").distinct())
        own = texts.join(sent_if_small(firsts, SENT_BYTES), F.col("doc_id").eqNullSafe(F.col("_first")), "left_semi")
        sets = settled(shingle_sets(own, similarity, width, seed, None).select("node", "size", "shingles").join(sent_if_small(wanted, SENT_BYTES), "node", "left_semi"))
        if sets.count() > wanted.count():  # rows that share a doc_id have the same set
            repeated, sets = sets, settled(sets.dropDuplicates(["node"]))
            released(repeated)
        coarse = settled(coarse_counts(sets))
    labelled, turn = settled(ids.groupBy("node").agg(F.min("doc_id").alias("first")).withColumn("component", F.col("node"))), 0
    parts = CENTRES

    def merged(edges: DataFrame) -> None:
        nonlocal labelled, members
        joined = settled(connected(edges).select(F.col("node").alias("component"), F.col("component").alias("_joined")))
        renamed = lambda df: settled(joined_by(df, joined, "component").withColumn("component", F.coalesce("_joined", "component")).drop("_joined"))
        before = labelled, members
        labelled, members = renamed(labelled), renamed(members)
        released(*before)

    edges = _alike(settled(print_pairs(held.select("node", "fp"), distance)), sets, coarse, similarity)
    if not edges.isEmpty():
        merged(edges)
    while not members.isEmpty():
        pairs, left, read = _candidates(members, similarity, few if turn < CENTRE_ROUNDS else None, parts)
        pairs = settled(pairs)  # nothing refers to its exchanges from here on
        alike = _alike(pairs, sets, coarse, similarity)
        before, members, turn = members, settled(left), turn + 1
        released(before, *read)
        if alike.isEmpty():
            parts *= MORE_CENTRES
            continue
        named = [labelled.select(F.col("node").alias(c), F.col("component").alias(f"_{c}")) for c in "ab"]
        edges = settled(joined_by(alike, named[1], "b", "inner").join(named[0], "a").select(F.col("_a").alias("a"), F.col("_b").alias("b")).distinct())
        merged(edges)
    named = labelled.groupBy("component").agg(F.min("first").alias("component_id"))
    of_node = joined_by(labelled.select("node", "component"), named, "component", "inner").select("node", "component_id")
    return joined_by(ids, of_node, "node", "inner").select("doc_id", "component_id")


def print_pairs(held: DataFrame, distance: int, bucket_pairs: int = BUCKET_PAIRS) -> DataFrame:
    """a, b: nodes whose fingerprints are equal or within ``distance`` bits, one partner (b) for each that has any.
    ``held`` (checkpointed) has node and fp."""
    lead = settled(held.groupBy("fp").agg(F.min("node").alias("node")))
    same = joined_by(held, lead.withColumnRenamed("node", "b"), "fp", "inner").filter("node != b").select(F.col("node").alias("a"), "b")
    n, both = bit_counts(lead)
    if not n:
        return same
    nodes, plan = settled(spread(lead.select("fp", F.col("fp").alias("component"), F.lit(1).alias("size")), "fp")), choose_plan(n, both, distance)
    crowds = _crowds(nodes, plan, bucket_pairs)
    if crowds.isEmpty():
        pairs = _met(nodes, distance, plan).select("a", "b")
    else:
        packed = settled(_index(nodes.select("fp"), plan).join(sent_if_small(crowds.select("part", "key")), ["part", "key"]).select("part", "key", "fp"))
        pairs = _met(nodes, distance, plan, crowds).select("a", "b").union(_led(packed, distance, 0))
    both_ways = pairs.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("_p"))
    near = settled(both_ways.groupBy(F.col("_p.a").alias("a")).agg(F.min("_p.b").alias("b")))
    of = [lead.select(F.col("fp").alias(c), F.col("node").alias(f"_{c}")) for c in "ab"]
    return same.union(joined_by(near, of[1], "b", "inner").join(of[0], "a").select("_a", "_b"))


def one_of_each(docs: DataFrame, similarity: float = 0.8, width: int = 5, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that stand for their near-duplicate group, the one with the smallest doc_id of each.

    By default texts are linked from a Jaccard similarity of 0.8 on, over shingles of five words. Documents without words,
    null ones too, are one group. Of rows that share a doc_id the one with the smallest text stays, of equal rows one.
    An empty table stays empty, and columns keep their values, whatever their names.
    """
    found = settled(similar_texts(docs, similarity, width, id_column=id_column, text_column=text_column))
    stands = F.col("doc_id").eqNullSafe(F.col("component_id"))
    gone = settled(found.filter(~stands).select(F.col("doc_id").alias("_gone")).distinct())
    again = settled(found.filter(stands).groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("_again")))
    given = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{id_column}`").alias("_id"), F.col(f"`{text_column}`").cast("string").alias("_text"))
    kept = given.join(sent_if_small(gone, SENT_BYTES), F.col("_id").eqNullSafe(F.col("_gone")), "left_anti")
    if again.isEmpty():
        return kept.select("_row.*")
    twice = F.col("_id").eqNullSafe(F.col("_again"))
    # the smallest of an aggregation, so that very many rows of one doc_id are reduced before they move
    order = F.struct("_text", F.to_json("_row"))
    once = kept.join(sent_if_small(again), twice, "left_semi").groupBy("_id").agg(F.min_by("_row", order).alias("_row")).select("_row")
    return kept.join(sent_if_small(again), twice, "left_anti").select("_row").union(once).select("_row.*")
