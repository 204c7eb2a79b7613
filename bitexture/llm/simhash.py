"""SimHash fingerprints, linked by generalised pigeonhole search; near copies by
these and MinHash bands, verified by exact resemblance."""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bitexture.llm.components import smallest_reachable
from bitexture.llm.shingles import Shingler, scrambled
from bitexture.operators.lookup import lookup_join
from bitexture.session import discard, stored

BITS = 64
SEED = 42
#: Members of a bucket up to which its pairs are compared one by one. Larger
#: buckets are searched by neighbours of the fingerprints, 65 for each.
BUCKET_PAIRS = 64
_CHUNK = 1 << 15


def shingles(text: str | None, words: int) -> list[bytes]:
    """Runs of ``words`` words, A-Z in lower case, repeats included; a shorter
    text is one run, an empty one has none."""
    w = (text or "").encode().lower().split()
    if len(w) <= words:
        return [b" ".join(w)] if w else []
    return list(map(b" ".join, zip(*(w[i:] for i in range(words)))))


def fingerprint(text: str | None, words: int) -> int:
    """Bit ``i`` is set if it is set in over half of the shingles' hashes."""
    runs = shingles(text, words)
    if not runs:
        return 0
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(runs), _CHUNK):
        part = runs[at : at + _CHUNK]
        hashes = np.fromiter((xxhash.xxh64_intdigest(r, SEED) for r in part), ">u8", len(part))
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(runs)).tobytes(), "big")


def _fingerprints(words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((fingerprint(t.as_py(), words) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["__id", "__fp"])

    return run


def fingerprints(docs: DataFrame, words: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``__id, __fp`` (64 bits as a bigint) of every row."""
    schema = T.StructType([T.StructField("__id", docs.schema[key].dataType), T.StructField("__fp", T.LongType())])
    return docs.select(F.col(key).alias("__id"), F.col(text).alias("__text")).mapInArrow(_fingerprints(words), schema)


class Partition(NamedTuple):
    bits: tuple[int, ...]
    threshold: int


def bit_pairs(prints: DataFrame) -> np.ndarray:
    """How many fingerprints have bit i and bit j set; 64 x 64, whatever the rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS))
        for batch in batches:
            x = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(x), _CHUNK):
                rows = x[at : at + _CHUNK].astype(">i8").view(np.uint8).reshape(-1, 8)
                # bit i of the number is column i
                b = np.unpackbits(rows, axis=1)[:, ::-1].astype(np.float32)
                total += b.T @ b
        pair = pa.array(np.arange(BITS * BITS), pa.int32())
        yield pa.RecordBatch.from_arrays([pair, pa.array(total.ravel().astype(np.int64))], names=["pair", "n"])

    summed = prints.select("__fp").mapInArrow(count, "pair int, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    out = np.zeros(BITS * BITS)
    for pair, n in summed.collect():  # one row per pair of bits
        out[pair] = n
    return out.reshape(BITS, BITS)


def correlated_groups(pairs: np.ndarray, n: int, parts: int) -> list[tuple[int, ...]]:
    """Bits in ``parts`` groups of even size; a group takes the bits that are
    most correlated with those it has, so that groups are independent."""
    p = pairs.diagonal() / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs((pairs / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    free, groups = set(range(len(p))), []
    for g in range(parts):
        size = len(free) // (parts - g)
        first = max(free, key=lambda i: (sum(corr[i, j] for j in free), -i))
        group = [first]
        free.discard(first)
        while len(group) < size:
            best = max(free, key=lambda i: (sum(corr[i, j] for j in group), -i))
            group.append(best)
            free.discard(best)
        groups.append(tuple(sorted(group)))
    return groups


def estimated_cost(bits: tuple[int, ...], share: np.ndarray, n: int, threshold: int) -> float:
    """Signatures plus expected pairs of a group of bits at a threshold, from
    the share of fingerprints in which each bit is set."""
    if threshold < 0:
        return 0.0
    agree = np.array([share[b] ** 2 + (1 - share[b]) ** 2 for b in bits])
    odds = (1 - agree) / agree
    within = [1.0] + [0.0] * threshold  # elementary symmetric sums of the odds
    for o in odds:
        for t in range(threshold, 0, -1):
            within[t] += within[t - 1] * o
    close = float(np.prod(agree)) * sum(within)
    signatures = n * len(list(itertools.combinations(bits, threshold)))
    return signatures + n * n / 2 * close


def plan_partitions(pairs: np.ndarray, n: int, distance: int, fewest: int = 1) -> list[Partition]:
    """Groups of correlated bits with a threshold each.

    Thresholds ``t`` add up to ``distance - groups + 1``: fingerprints within
    ``distance`` are then within ``t`` in at least one group. Dynamic programming
    finds the cheapest thresholds for ``fewest`` to ``distance + 1`` groups; -1
    leaves a group out.
    """
    n = max(n, 1)
    share, best = pairs.diagonal() / n, None
    for parts in range(fewest, distance + 2):
        groups = correlated_groups(pairs, n, parts)
        # spent[u]: cheapest thresholds with sum of (t + 1) = u so far
        spent: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
        for bits in groups:
            step: dict[int, tuple[float, tuple[int, ...]]] = {}
            for used, (cost, chosen) in spent.items():
                for t in range(-1, distance - used + 1):
                    now = (cost + estimated_cost(bits, share, n, t), (*chosen, t))
                    if used + t + 1 not in step or now < step[used + t + 1]:
                        step[used + t + 1] = now
            spent = step
        cost, chosen = spent[distance + 1]
        if best is None or cost < best[0]:
            best = (cost, [Partition(b, t) for b, t in zip(groups, chosen) if t >= 0])
    return best[1]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def signatures(fp: Column, plan: list[Partition]) -> Column:
    """``part, key`` of a fingerprint: its bits of a group, without every choice
    of ``threshold`` of them. Fingerprints within the threshold share one."""
    out = []
    for part in plan:
        for left_out in itertools.combinations(part.bits, part.threshold):
            mask = sum(1 << b for b in part.bits if b not in left_out)
            out.append(F.struct(F.lit(len(out)).alias("part"), fp.bitwiseAND(F.lit(_signed(mask))).alias("key")))
    return F.array(*out)


def neighbour_keys(fp: Column, distance: int) -> Column:
    """Keys that exactly the fingerprints within ``distance`` (1 or 2) share:
    for 2 the fingerprint and all with one bit changed, since two that are
    two bits apart meet in the middle; for 1 the fingerprint without one bit."""
    keys = []
    for b in range(BITS):
        bit = F.lit(_signed(1 << b))
        if distance == 2:
            keys.append(F.struct(F.lit(-1).alias("part"), fp.bitwiseXOR(bit).alias("key")))
        else:
            off = F.lit(_signed(~(1 << b) & (1 << 64) - 1))
            keys.append(F.struct(F.lit(b).alias("part"), fp.bitwiseAND(off).alias("key")))
    if distance == 2:
        keys.append(F.struct(F.lit(-1).alias("part"), fp.alias("key")))
    return F.array(*keys)


def linked_prints(prints: DataFrame, distance: int) -> DataFrame:
    """Links ``a, b`` between distinct fingerprints (``__fp``) that connect all
    that differ in ``distance`` (0 to 2) or fewer bits.

    Buckets of up to ``BUCKET_PAIRS`` members are compared pair by pair.
    Members of larger buckets (big groups of near copies) are linked through
    their neighbour keys: such a key has at most 65 members, all within the
    distance, and they are linked to its smallest. That is as exact, and the
    work for each member doesn't depend on the size of the bucket.
    """
    if not 0 <= distance <= 2:
        raise ValueError("distance is 0, 1 or 2")
    spark = prints.sparkSession
    if distance == 0:
        return spark.createDataFrame([], "a bigint, b bigint")
    plan = plan_partitions(bit_pairs(prints), prints.count(), distance)
    keyed = prints.select("__fp", F.explode(signatures(F.col("__fp"), plan)).alias("s")).select("__fp", "s.*")
    sizes = keyed.groupBy("part", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = stored(keyed.join(sizes, ["part", "key"]), "probes")
    few = shared.where(F.col("n") <= BUCKET_PAIRS)
    a, b = few.withColumnRenamed("__fp", "a"), few.withColumnRenamed("__fp", "b").drop("n")
    pairs = (
        a.join(b, ["part", "key"])
        .where((F.col("a") > F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance))
        .select("a", "b")
    )
    many = shared.where(F.col("n") > BUCKET_PAIRS).select("__fp").distinct()
    near = many.select("__fp", F.explode(neighbour_keys(F.col("__fp"), distance)).alias("s"))
    met = near.groupBy("s").agg(F.min("__fp").alias("b"), F.collect_list("__fp").alias("all")).where(F.size("all") > 1)
    stars = met.select(F.explode("all").alias("a"), "b").where("a <> b")
    return pairs.unionByName(stars).distinct()


def near_duplicates(
    docs: DataFrame, words: int = 3, distance: int = 2, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``key, fingerprint`` (16 hex digits) and ``component_id``: the smallest
    key reachable over links of at most ``distance`` differing bits.

    Every row gets a result row. Equal texts share a fingerprint and are one
    node, so copies are never paired. Empty and NULL texts have fingerprint
    zero and link like any other; rows without key take part, and a component
    of such rows only has no id.
    """
    rows = stored(fingerprints(docs, words, key, text), "fingerprints")
    prints = stored(rows.groupBy("__fp").agg(F.min("__id").alias("__first")), "prints")
    roots = smallest_reachable(linked_prints(prints, distance)).withColumnRenamed("node", "__fp")
    rooted = prints.join(roots, "__fp", "left").withColumn("root", F.coalesce("root", "__fp"))
    smallest = rooted.groupBy("root").agg(F.min("__first").alias("component_id"))
    named = rooted.join(smallest, "root").select("__fp", "component_id")
    return rows.join(named, "__fp").select(
        F.col("__id").alias(key), F.lower(F.lpad(F.hex("__fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


#: Words of the shingles that resemblance is measured on.
CHECK_WORDS = 5
#: Fingerprint bits of these shingles in which the first candidates may differ.
CHECK_DISTANCE = 2
#: Minima of a band. Texts of resemblance s have all of them in common with odds
#: of s ** BAND_ROWS, however their differences are spread.
BAND_ROWS = 6
#: Pairs right at the limit that may have no band in common.
MISSED = 0.001
#: Members of a band's bucket up to which all its pairs are candidates.
SMALL_BUCKET = 4
#: How many times as many pivots the next round has.
ROUND_GROWTH = 32


def band_count(similarity: float, rows: int = BAND_ROWS) -> int:
    """Bands after which at most ``MISSED`` of the pairs right at the limit have
    none in common."""
    return math.ceil(math.log(MISSED) / math.log1p(-(similarity**rows)))


class Bands:
    """MinHash keys of a set of shingle hashes, one for each band."""

    def __init__(self, bands: int, rows: int) -> None:
        rng = np.random.Generator(np.random.PCG64(7))
        self.shape = bands, rows
        self.factors = rng.integers(1, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.steps = rng.integers(0, 2**63, bands * rows, dtype=np.uint64)
        self.places = rng.integers(1, 2**63, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        least = np.full(len(self.factors), 2**64 - 1, np.uint64)
        for at in range(0, len(hashes), _CHUNK // 4):
            part = hashes[at : at + _CHUNK // 4, None] * self.factors[None, :] + self.steps[None, :]
            np.minimum(least, part.min(0), out=least)
        return scrambled((scrambled(least.reshape(self.shape)) * self.places).sum(1, dtype=np.uint64)).view(np.int64)


def set_digest(hashes: np.ndarray) -> bytes:
    """Names texts with equal sets of shingles."""
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def set_print(hashes: np.ndarray) -> int:
    """SimHash of a set of shingle hashes: the bits set in over half of them."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        part = hashes[at : at + _CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big") if len(hashes) else 0


def _banded(bands: Bands) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Digest, size, fingerprint and band keys of the set of five-word shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(CHECK_WORDS)
        for batch in batches:
            sets = [np.unique(shingle(t.as_py())) for t in batch.column(2)]
            columns = [
                batch.column(0),
                batch.column(1),
                pa.array(map(set_digest, sets), pa.binary()),
                pa.array(map(len, sets), pa.int32()),
                pa.array(np.fromiter(map(set_print, sets), np.uint64, len(sets)).view(np.int64)),
                pa.array([bands(h) for h in sets], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["__id", "__text", "__same", "__size", "__fp", "__bands"])

    return run


def _shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest and set of the five-word shingles."""
    shingle = Shingler(CHECK_WORDS)
    for batch in batches:
        sets = [np.unique(shingle(t.as_py())) for t in batch.column(0)]
        columns = [pa.array(map(set_digest, sets), pa.binary()), pa.array([h.view(np.int64) for h in sets], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["__same", "__set"])


def resembling(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``a, b`` whose shingle sets (``node, __set``) have at least that
    resemblance, counted shingle by shingle."""
    both = pairs.join(sets.withColumnsRenamed({"node": "a", "__set": "sa"}), "a").join(
        sets.withColumnsRenamed({"node": "b", "__set": "sb"}), "b"
    )
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.where(shared / (F.size("sa") + F.size("sb") - shared) >= similarity).select("a", "b")


def _sizes_fit(a: str, b: str, similarity: float) -> Column:
    """Sets whose sizes differ more can't resemble one another so much."""
    return F.least(a, b) >= F.greatest(a, b) * similarity - 1e-6


def linked_members(
    members: DataFrame,
    similarity: float,
    verified: Callable[[DataFrame], DataFrame],
    links: DataFrame | None = None,
    meet: Callable[[str, str], Column] | None = None,
) -> DataFrame:
    """``node, root`` of the nodes with links: ``links`` (``a, b``) and those
    that ``verified`` finds among the pairs of each bucket which ``meet`` lets
    pass. It is asked for all of them but those that links tie already.

    ``members`` are ``part, key, node, __size`` and maybe ``__pivot`` (a pair
    counts only where its smaller text, by size and node, is one), ``__pos`` and
    ``__bits``, for ``meet(smaller, larger)``, which gets the prefixes of their columns. In
    each round some pivots of every bucket, the smallest of each of 1, 32, 1 024,
    ... parts of it, are compared with the members in other groups by now, and
    then leave. A bucket ends when it has no pivots left or is one group, so no
    pair is skipped for the size of its bucket. No bucket is sorted or collected,
    and the members of a hot one are dealt over tasks.
    """
    spark = members.sparkSession
    columns = ["part", "key", "node", "__size", "__pivot", "__pos", "__bits"]
    for name, value in (("__pivot", F.lit(True)), ("__pos", F.lit(0)), ("__bits", F.array().cast("array<bigint>"))):
        if name not in members.columns:
            members = members.withColumn(name, value)
    if links is None:
        links = spark.createDataFrame([], "a bigint, b bigint")
    members, parts = members.select(*columns), 1
    roots = stored(smallest_reachable(links), "groups")
    while True:
        known = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        open_ones = known.groupBy("part", "key").agg(
            F.min("root").alias("x"), F.max("root").alias("y"), F.max("__pivot").alias("more")
        )
        going = open_ones.where("x < y AND more").select("part", "key")
        left = stored(known.join(going, ["part", "key"], "left_semi"), "members")
        if left.isEmpty():
            discard(left)
            return roots
        place = F.pmod(F.xxhash64("node"), F.lit(parts))
        chosen = (
            left.where("__pivot")
            .groupBy("part", "key", place.alias("__place"))
            .agg(F.min(F.struct("node", "__size", "__pos", "root", "__bits")).alias("p"))
            .select("part", "key", *[F.col(f"p.{c}").alias(f"p_{c}") for c in ("node", "__size", "__pos", "root", "__bits")])
        )
        chosen = stored(chosen, "pivots")
        others = left.select("part", "key", *[F.col(c).alias(f"o_{c}") for c in ("node", "__size", "__pos", "__pivot", "root", "__bits")])
        met = lookup_join(others, chosen, ["part", "key"], "inner", spread=["o_node"])
        first = F.struct("p___size", "p_node") < F.struct("o___size", "o_node")
        # the smaller one has to be a pivot
        fits = F.when(first, F.lit(True) if meet is None else meet("p_", "o_"))
        fits = fits.otherwise(F.col("o___pivot") if meet is None else F.col("o___pivot") & meet("o_", "p_"))
        met = met.where(F.col("p_root") != F.col("o_root")).where(_sizes_fit("p___size", "o___size", similarity)).where(fits)
        pairs = met.select(F.least("p_node", "o_node").alias("a"), F.greatest("p_node", "o_node").alias("b")).distinct()
        found = verified(pairs)
        # what was known is as good as a star of each group
        stars = roots.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
        links = stored(stars.unionByName(found), "linked")
        before, roots = roots, stored(smallest_reachable(links), "groups")
        done = chosen.select("part", "key", F.col("p_node").alias("node"))
        rest = left.join(done, ["part", "key", "node"], "left_anti").select(*columns)
        members, parts = stored(rest, "members"), parts * ROUND_GROWTH
        for table in (links, before, chosen, left):
            discard(table)


def _needed(a: str, b: str, similarity: float) -> Column:
    """Shingles that sets of these sizes share if they resemble one another so much."""
    return F.ceil((F.col(a) + F.col(b)) * (similarity / (1 + similarity)) - 1e-6)


def prefix_members(sets: DataFrame, similarity: float) -> DataFrame:
    """Members of buckets for ``linked_members``, of which exactly the pairs of
    sets (``node, __set``) with a resemblance of ``similarity`` meet, and few
    others: the first shingles of each set, from rare to common.

    Sets that share ``o`` shingles have the first shared one among the first
    ``size - o + 1`` of either, and they have to share four fifths of the larger
    set, and more of the smaller one. Variants of one template that differ too
    much have their own shingles first and never meet over the template.
    """
    sets = sets.withColumn("__bits", parities("__set"))
    each = sets.select("node", F.size("__set").alias("__size"), F.explode("__set").alias("key"))
    often = each.groupBy("key").agg(F.count(F.lit(1)).alias("__often"))
    ranked = (
        lookup_join(each, often, ["key"], "inner", spread=["node"])
        .groupBy("node", "__size")
        .agg(F.sort_array(F.collect_list(F.struct("__often", "key"))).alias("__all"))
    )
    whole, both = F.ceil(F.col("__size") * similarity - 1e-6), F.ceil(F.col("__size") * (2 * similarity / (1 + similarity)) - 1e-6)
    first = F.slice("__all", F.lit(1), (F.col("__size") - whole + 1).cast("int"))
    out = ranked.select("node", "__size", F.posexplode(first).alias("__at", "s"), (F.col("__size") - both + 1).alias("__most"))
    return out.where("s.__often > 1").join(sets.select("node", "__bits"), "node").select(
        F.lit(0).alias("part"), "s.key", "node", "__size", (F.col("__at") + 1 <= F.col("__most")).alias("__pivot"), (F.col("__at") + 1).alias("__pos"), "__bits"
    )


def parities(column: str) -> Column:
    """256 bits of a set of hashes: whether the number of hashes that fall on a
    bit is odd. Two sets differ in at least as many hashes as in bits."""

    def word(w: int) -> Column:
        mine = F.filter(column, lambda h: F.shiftright(h, 6).bitwiseAND(F.lit(3)) == w)
        one = F.lit(1).cast("bigint")
        return F.aggregate(
            mine, F.lit(0).cast("bigint"), lambda all_, h: all_.bitwiseXOR(F.call_function("shiftleft", one, h.bitwiseAND(F.lit(63)).cast("int")))
        )

    return F.array(*[word(w) for w in range(4)])


def _first_shared(similarity: float) -> Callable[[str, str], Column]:
    """Whether a shingle at these places may be the first that two sets share,
    if they share as many as they need, and whether their parities differ in no
    more bits than they may in hashes."""

    def meet(a: str, b: str) -> Column:
        after = F.least(F.col(f"{a}__size") - F.col(f"{a}__pos"), F.col(f"{b}__size") - F.col(f"{b}__pos"))
        needed = _needed(f"{a}__size", f"{b}__size", similarity)
        bits = F.zip_with(f"{a}__bits", f"{b}__bits", lambda x, y: F.bit_count(x.bitwiseXOR(y)))
        apart = F.aggregate(bits, F.lit(0), lambda n, x: n + x)
        return (1 + after >= needed) & (apart <= F.col(f"{a}__size") + F.col(f"{b}__size") - 2 * needed)

    return meet


def _print_pairs(nodes: DataFrame) -> DataFrame:
    """Candidates ``a, b`` among nodes whose fingerprints differ in at most
    ``CHECK_DISTANCE`` bits, by generalised pigeonhole search: nodes with one
    fingerprint with the first of them, and the first ones of linked ones."""
    prints = stored(nodes.groupBy("__fp").agg(F.min("node").alias("__first")), "prints")
    links = linked_prints(prints, CHECK_DISTANCE)
    a, b = (prints.select(F.col("__fp").alias(c), F.col("__first").alias(f"n{c}")) for c in "ab")
    across = links.join(a, "a").join(b, "b").select("na", "nb")
    same = lookup_join(nodes.select("node", "__fp"), prints, ["__fp"], "inner", spread=["node"]).where("node <> __first").select("node", "__first")
    return across.union(same).toDF("x", "y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def near_groups(
    docs: DataFrame, similarity: float = 0.8, key: str = "doc_id", text: str = "text", band_rows: int = BAND_ROWS
) -> DataFrame:
    """``key, text_md5, component_id, first`` of every row with a key: groups of
    texts whose five-word shingles resemble one another by ``similarity`` or
    more, named by their smallest key. Exactly one combination of key and text
    of a group is its ``first`` (smallest key, then smallest digest).

    Candidates come from SimHash fingerprints of these shingles, searched by
    correlated groups of bits with unequal thresholds (``linked_prints``). Texts
    right at the limit differ in about ten of 64 bits, more than such a search
    can bridge among many texts, so bands of ``band_rows`` minima of the same
    shingles add candidates: as many bands as find 999 of 1 000 pairs right at
    the limit, whatever the number of texts and however their differences are
    spread. Every candidate is verified: sets of shingles are compared hash by
    hash, and no link is below ``similarity``.

    Texts with one set of shingles are one node. All pairs of a band's bucket are
    candidates while it has few members; in a larger one its members are compared
    with one pivot. Members of buckets that are no single group then are joined
    exactly, by ``prefix_members``: variants of a template that are no near copies
    don't meet there, real groups are tied by a few pivots.

    Rows without key have no result; texts without words are one group. Keys may
    repeat, with equal or other texts.
    """
    longs, bands = T.ArrayType(T.LongType()), band_count(similarity, band_rows)
    ids = docs.schema[key].dataType
    kind = T.StructType().add("__id", ids).add("__text", T.StringType()).add("__same", T.BinaryType())
    kind = kind.add("__size", T.IntegerType()).add("__fp", T.LongType()).add("__bands", longs)
    source = docs.select(F.col(key).alias("__id"), text_md5(text).alias("__md5"), F.col(text).alias("__text")).where(F.col("__id").isNotNull())
    rows = stored(source.mapInArrow(_banded(Bands(bands, band_rows)), kind), "fingerprints")
    alike = [F.any_value(c).alias(c) for c in ("__size", "__fp", "__bands")]
    named = rows.groupBy("__same").agg(F.min(F.struct("__id", "__text")).alias("one"), *alike)
    # numbers are given once, as the table is written
    nodes = stored(named.withColumn("node", F.monotonically_increasing_id()), "nodes")

    keyed = nodes.select("node", "__size", F.posexplode("__bands").alias("part", "key"))
    sizes = keyed.groupBy("part", "key").agg(F.count(F.lit(1)).alias("__n"), F.min("node").alias("__pivot")).where("__n > 1")
    shared = stored(lookup_join(keyed, sizes, ["part", "key"], "inner", spread=["node"]), "probes")
    few = shared.where(F.col("__n") <= SMALL_BUCKET)
    a = few.select("part", "key", F.col("node").alias("a"), F.col("__size").alias("na"))
    b = few.select("part", "key", F.col("node").alias("b"), F.col("__size").alias("nb"))
    small = a.join(b, ["part", "key"]).where("a < b").where(_sizes_fit("na", "nb", similarity)).select("a", "b")
    many = shared.where(F.col("__n") > SMALL_BUCKET)
    large = many.where("node <> __pivot").select(F.col("__pivot").alias("a"), F.col("node").alias("b"))
    pairs = stored(small.unionByName(large).unionByName(_print_pairs(nodes)).distinct(), "pairs")

    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    met = ends.join(nodes.select("node", "__same", "one"), "node")
    texts = source.join(met.select(F.col("one.__id").alias("__id"), F.col("one.__text").alias("__md5")), ["__id", "__md5"], "left_semi")
    found = texts.select("__text").mapInArrow(_shingle_sets, T.StructType().add("__same", T.BinaryType()).add("__set", longs))
    # rows that repeat a text have equal sets
    sets = stored(found.dropDuplicates(["__same"]).join(met, "__same").select("node", "__set"), "sets")

    def verified(some: DataFrame) -> DataFrame:
        return resembling(some, sets, similarity)

    links = stored(verified(pairs), "linked")
    roots = stored(smallest_reachable(links), "groups")
    tied = many.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    torn = tied.groupBy("part", "key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("part", "key")
    torn_nodes = stored(many.join(torn, ["part", "key"], "left_semi").select("node").distinct(), "torn")
    if not torn_nodes.isEmpty():
        members = stored(prefix_members(sets.join(torn_nodes, "node", "left_semi"), similarity), "prefixes")
        roots = linked_members(members, similarity, verified, links, _first_shared(similarity))
        discard(members)
    # one row per group: its smallest key and text
    rooted = nodes.join(roots, "node", "left").select("__same", "one", F.coalesce("root", "node").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("one").alias("first"))
    groups = stored(rooted.join(smallest, "root").select("__same", "first"), "named")
    for table in (nodes, shared, pairs, sets, links, torn_nodes, roots):
        discard(table)
    return rows.select("__id", "__text", "__same").join(groups, "__same").select(
        F.col("__id").alias(key),
        F.col("__text").alias("text_md5"),
        F.col("first.__id").alias("component_id"),
        ((F.col("first.__id") == F.col("__id")) & (F.col("first.__text") == F.col("__text"))).alias("first"),
    )


def text_md5(text: str) -> Column:
    """Digest of a text; NULL counts as empty."""
    return F.md5(F.encode(F.coalesce(F.col(text), F.lit("")), "utf-8"))
