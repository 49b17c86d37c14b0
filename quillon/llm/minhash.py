"""Operator 7, MinHash near-dedup: many universal hash minima with banding, signature
verification, confirmation on full sets, and connected components by alternating large-star and
small-star.

Documents with the same shingle set are one class, told by a 128-bit digest of the set and
represented by the smallest id. Of the classes, bands of minima give buckets. Not all pairs of a
bucket are emitted: every member is first compared with the bucket's centre, the one that shares
most buckets with it; then with its other centres, where the two aren't linked yet; then, in the
buckets that still hold several components, with the members of other components. Pairs whose
signatures are far from the threshold are dropped, all others are confirmed on the full sets. Later
rounds link components, so only these go through the stars again. Links inside a component add nothing, so none that matters is left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._base import apart, table, text_chunks
from ._words import Texts, mix, windows

SHINGLE, PERCENT = 5, 80
#: Bands and minima of a band: a pair of similarity 0.8 shares no bucket with a chance of
#: (1 - 0.8 ** 5) ** 32 = 3e-6.
BANDS, ROWS = 32, 5
#: Signature bits that may differ at most: two of each minimum, so that a pair of similarity s has
#: (1 - s) / 2 of them in expectation. At 0.8 that is 32 of 320 with a deviation of 6.5; 32 + 5 x 6.5.
BITS, MAX_DIFFERENT = 2 * BANDS * ROWS, 65
#: Sets of fewer shingles have too few minima for that argument: their pairs go to the exact check.
SMALL = 32
#: Ids to remove up to which they are broadcast (8 MB); more are joined by shuffle.
BROADCAST_IDS = 1_000_000
#: Bits of a bloom filter for each document whose set is wanted, and its 64-bit words at most (64 MB).
BLOOM_BITS, BLOOM_WORDS = 16, 1 << 23


def _shingles(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of all texts in a row, sorted in each, and their numbers. A text
    of fewer words has its whole sequence as one, a text without words none."""
    t = Texts(texts, lower=True)
    starts, ends, counts = t.words("space")
    values = t.hashes(starts, ends)
    at, keys = windows(values, counts, size)
    owner = np.repeat(np.arange(len(texts)), counts)
    whole, whole_owner = [], np.flatnonzero((counts > 0) & (counts < size))
    first = np.cumsum(counts) - counts
    for k in whole_owner.tolist():
        _, one = windows(values[first[k] : first[k] + counts[k]], counts[k : k + 1], int(counts[k]))
        whole.append(mix(one + counts[k].astype(np.uint64)))
    keys = np.concatenate([keys, *whole])
    owner = np.concatenate([owner[at], whole_owner])
    order = np.lexsort((keys, owner))
    keys, owner = keys[order], owner[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
    return keys[new], np.bincount(owner[new], minlength=len(texts))


_FACTORS = [(np.random.default_rng(7).integers(0, 2**32, BANDS * ROWS).astype(np.uint32) | np.uint32(1)), np.random.default_rng(8).integers(0, 2**32, BANDS * ROWS).astype(np.uint32)]


def signatures(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The minima of the universal hashes a x + b (mod 2^32) of each set: sets x minima."""
    out = np.full((len(counts), BANDS * ROWS), 2**32 - 1, np.uint32)
    some = np.flatnonzero(counts)
    if not len(some):
        return out
    x = (keys >> np.uint64(32)).astype(np.uint32)
    first = (np.cumsum(counts) - counts)[some]
    hashed = np.empty(len(x), np.uint32)
    columns = np.empty((BANDS * ROWS, len(some)), np.uint32)
    for k in range(BANDS * ROWS):
        np.multiply(x, _FACTORS[0][k], out=hashed)
        np.add(hashed, _FACTORS[1][k], out=hashed)
        np.minimum.reduceat(hashed, first, out=columns[k])
    out[some] = columns.T
    return out


def _features(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, n (set size), d1 and d2 (the set's digest), bands, sketch (signature bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_chunks(batches):
            keys, counts = _shingles(texts, shingle)
            minima = signatures(keys, counts)
            ends = np.cumsum(counts)
            digests = []
            for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
                sums = np.append(np.uint64(0), np.cumsum(mix(keys * np.uint64(salt | 1) + np.uint64(salt)), dtype=np.uint64))
                digests.append(mix(sums[ends] - sums[ends - counts] + counts.astype(np.uint64)).view(np.int64))
            band = np.zeros((len(texts), BANDS), np.uint64)
            for r in range(ROWS):
                band = mix(band * np.uint64(0x9E3779B97F4A7C15) + minima[:, r::ROWS])
            band = mix(band + np.arange(BANDS, dtype=np.uint64))
            # Of the mixed minima: the lowest bit of a minimum is the shingle's own, as a is odd.
            mixed = mix(minima.astype(np.uint64))
            bits = np.stack([mixed & np.uint64(1), mixed >> np.uint64(63)], 2).reshape(len(texts), -1)
            sketch = np.packbits(bits.astype(np.uint8), axis=1).view(np.int64)
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, v.shape[1], dtype=np.int32)), pa.array(np.ascontiguousarray(v).reshape(-1))) for v in (band.view(np.int64), sketch)]
            yield pa.RecordBatch.from_arrays([rows.column(0).cast(pa.int64()), pa.array(counts, pa.int64()), *map(pa.array, digests), *lists], ["doc_id", "n", "d1", "d2", "bands", "sketch"])

    return table(docs.mapInArrow(run, "doc_id bigint, n bigint, d1 bigint, d2 bigint, bands array<bigint>, sketch array<bigint>"), "features")


def _sets(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """id and set (its shingle hashes, sorted) of the documents whose ids are wanted (column id).

    The texts are read again; a bloom filter, sized by their number up to a bound, passes the wanted
    ones and a few more, which the join drops.
    """
    size, n = 1 << 10, wanted.count()
    while size < BLOOM_WORDS and 64 * size < BLOOM_BITS * n:
        size *= 2
    bits = (F.xxhash64(F.lit("bloom"), "id"), F.lit(size))
    words = wanted.select(F.pmod(bits[0], bits[1]).alias("word"), F.expr("shiftleft(1L, CAST(shiftrightunsigned(xxhash64('bloom', id), 58) AS INT)) | shiftleft(1L, CAST(shiftrightunsigned(xxhash64('bloom', id), 52) & 63 AS INT))").alias("bits"))
    got = words.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()  # `size` rows at most
    bloom = np.zeros(size, np.int64)
    bloom[got["word"].to_numpy()] = got["bits"].to_numpy()
    held = docs.sparkSession.sparkContext.broadcast(bloom)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_chunks(batches):
            h = rows.column(2).to_numpy()
            word = held.value[h % size].view(np.uint64)
            u = h.view(np.uint64)
            hit = (word >> (u >> np.uint64(58)) & np.uint64(1)) & (word >> ((u >> np.uint64(52)) & np.uint64(63)) & np.uint64(1)) > 0
            keep = np.flatnonzero(hit)
            if not len(keep):
                continue
            keys, counts = _shingles([texts[k] for k in keep.tolist()], shingle)
            at = pa.array(np.append(0, np.cumsum(counts)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(keep)).cast(pa.int64()), pa.ListArray.from_arrays(at, pa.array(keys.view(np.int64)))], ["id", "set"])

    rows = docs.select("doc_id", "text", F.xxhash64(F.lit("bloom"), F.col("doc_id").cast("bigint")).alias("b")).where("doc_id IS NOT NULL")
    return rows.mapInArrow(run, "id bigint, set array<bigint>").join(wanted, "id", "left_semi")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y) whose full sets are similar enough, all columns kept."""
    left = pairs.join(sets.withColumnRenamed("id", "x").withColumnRenamed("set", "sx"), "x")
    both = left.join(sets.withColumnRenamed("id", "y").withColumnRenamed("set", "sy"), "y")
    same, every = F.size(F.array_intersect("sx", "sy")), F.size("sx") + F.size("sy")
    return both.where(100 * same >= percent * (every - same)).select(pairs.columns)


def components(edges: DataFrame) -> DataFrame:
    """id and component (its smallest id) of every id of the edges (x, y), by alternating
    large-star and small-star until neither changes an edge.

    Each node's edges are aggregated to its smallest neighbour before they meet, so no node's
    neighbourhood is ever collected. Self-loops and repeated edges are allowed.
    """
    now = table(edges.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(apart(least, "u"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = table(large, "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(apart(least, "u"), "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        now = table(small, "edges")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("u").alias("id"), F.col("v").alias("component"))
        before = state


def _merged(parts: DataFrame, edges: DataFrame) -> DataFrame:
    """The components after edges between them (cx, cy): only their labels, which are their smallest
    ids, go through components() again."""
    links = table(components(edges.select(F.col("cx").alias("x"), F.col("cy").alias("y"))), "merged")
    return table(_labelled(parts.withColumnRenamed("component", "old"), links, "old", "component").select("id", "component").unionByName(links), "parts")


def _labelled(ids: DataFrame, parts: DataFrame | None, column: str, label: str) -> DataFrame:
    """ids with the component of their `column` as `label` (their own id where they have none)."""
    if parts is None:
        return ids.withColumn(label, F.col(column))
    named = parts.select(F.col("id").alias(column), F.col("component").alias("__c"))
    return ids.join(named, column, "left").withColumn(label, F.coalesce("__c", column)).drop("__c")


def _near(a: str, b: str) -> Column:
    """Whether two sketches differ in few enough bits."""
    return F.expr(f"aggregate(zip_with({a}, {b}, (p, q) -> bit_count(p ^ q)), 0, (s, z) -> s + z) <= {MAX_DIFFERENT}")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id, kept, class_id.

    Words are A-Z lower-cased runs without white space; a text's set is its distinct shingles,
    or its whole sequence as one if it has fewer words. Texts with 100 * intersection >=
    percent * union are linked; component_id is the smallest id that links reach, class_id the
    smallest id with the same set; kept says that a document is its component's first. Null,
    empty and wordless texts have no shingles and are linked with nothing. Ids are integers; a
    null id is kept and linked with nothing, rows that share an id share its component. An
    empty table gives an empty table; other columns aren't read. Bands and the limit of
    signature bits are made for 80 percent and more: less raises.
    """
    if not PERCENT <= percent <= 100:
        raise ValueError(f"percent is {percent}: the bands are made for {PERCENT} to 100")
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    features = _features(source, shingle)
    real = features.where("n > 0 AND doc_id IS NOT NULL")
    classes = table(real.groupBy("d1", "d2").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "classes")
    entries = classes.select("id", F.explode("bands").alias("band"))
    centres = entries.groupBy("band").agg(F.min("id").alias("centre"), F.count("*").alias("size")).where("size > 1")
    members = table(entries.join(apart(centres, "band"), "band").select("band", "id", "centre"), "members")
    stars = table(members.where("id <> centre").groupBy(F.col("id").alias("x"), F.col("centre").alias("y")).agg(F.count("*").alias("shared")), "stars")
    first = stars.groupBy("x").agg(F.max_by("y", F.struct("shared", -F.col("y"))).alias("y"))
    wanted = table(members.select("id").distinct(), "wanted")
    sets = table(_sets(source, wanted, shingle), "sets")
    sizes = classes.select("id", "n", "sketch")
    edges = table(_confirmed(_plausible(first, sizes, percent), sets, percent), "links")
    parts = components(edges)
    others = stars.select("x", "y").join(first, ["x", "y"], "left_anti")
    more = table(_confirmed(_plausible(_crossing(others, parts), sizes, percent), sets, percent), "links")
    parts = _merged(parts, more)
    rest = table(_confirmed(table(_residual(members, parts, sizes, sets, percent), "rest"), sets, percent), "links")
    parts = _merged(parts, rest)
    named = _labelled(classes.select("d1", "d2", "id"), parts, "id", "component_id").select("d1", "d2", F.col("id").alias("class_id"), "component_id")
    rows = features.select("doc_id", "n", "d1", "d2").join(named, ["d1", "d2"], "left")
    alone = (F.col("n") == 0) | F.col("doc_id").isNull()
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"), F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"))


def _crossing(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """The pairs (x, y) of different components (cx, cy)."""
    return _labelled(_labelled(pairs, parts, "x", "cx"), parts, "y", "cy").where("cx <> cy").select("x", "y", "cx", "cy")


def _plausible(pairs: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sizes and signatures, if neither set is small, allow the similarity."""
    a = sizes.select(F.col("id").alias("x"), F.col("n").alias("nx"), F.col("sketch").alias("kx"))
    b = sizes.select(F.col("id").alias("y"), F.col("n").alias("ny"), F.col("sketch").alias("ky"))
    return pairs.join(a, "x").join(b, "y").where(F.expr(f"100 * least(nx, ny) >= {percent} * greatest(nx, ny)") & (F.expr(f"least(nx, ny) < {SMALL}") | _near("kx", "ky"))).select(pairs.columns)


#: Ratio of the set sizes that one class of sizes spans.
SIZE_CLASS = 1.03


def _residual(members: DataFrame, parts: DataFrame, sizes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Plausible pairs of documents in different components, of those in buckets that hold more
    than one; at least one of them is outside the largest component of such a bucket.

    Those outside are looked up by prefixes: of two sets with enough in common, each has one of
    the shared shingles among its rarest n - required + 1. A document that is not linked to a
    centre much like it differs from it in at least that many shingles, so its prefix is made of
    what it doesn't share with the group, and the group's own shingles, which all its members
    have, are no keys of it. Classes of sizes keep prefixes as short as the sizes allow.
    """
    named = _labelled(members.select("band", "id"), parts, "id", "c")
    large = _labelled(members.select("id").distinct(), parts, "id", "c").groupBy("c").agg(F.count("*").alias("of"))
    held = named.groupBy("band", "c").agg(F.lit(1).alias("one")).join(large, "c")
    mixed = held.groupBy("band").agg(F.max_by("c", F.struct("of", -F.col("c"))).alias("cc"), F.count("*").alias("parts")).where("parts > 1")
    rows = named.join(mixed, "band").groupBy("id").agg(F.first("c").alias("c"), F.bool_or(F.col("c") != F.col("cc")).alias("out"))
    rows = table(rows.join(sizes, "id"), "mixed")
    tokens = sets.join(rows.select("id"), "id", "left_semi").select("id", F.explode("set").alias("k"))
    often = tokens.groupBy("k").agg(F.count("*").alias("df")).where("df > 1")
    listed = tokens.join(apart(often, "k"), "k").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "k"))).alias("l"))
    most = F.expr(f"n - CAST(ceil({percent} * n / 100) AS BIGINT) + 1")  # the longest prefix of a set
    keyed = listed.join(rows, "id").withColumn("own", F.col("n") - F.size("l"))
    keyed = table(keyed.withColumn("l", F.slice("l", F.lit(1), F.greatest(most - F.col("own"), F.lit(0)).cast("int"))).drop("sketch"), "prefixes")
    each = keyed.select("id", "c", "n", "own", "out", F.posexplode("l").alias("pos", "x"))
    size_class = lambda n: F.floor(F.ln(n) / math.log(SIZE_CLASS)).cast("int")
    targets = each.select(F.col("x.k").alias("k"), size_class(F.col("n")).alias("class"), F.col("id").alias("y"), F.col("c").alias("cy"), F.col("n").alias("ny"), (F.col("pos") + F.col("own")).alias("py"))
    ranges = F.explode(F.sequence(size_class(F.col("n") * (percent / 100)) - 1, size_class(F.col("n") * (100 / percent)) + 1))
    probes = each.where("out").withColumn("class", ranges)
    # The smallest set of the class that can be similar enough, and what has to be shared with it.
    least = F.greatest(F.ceil(F.pow(F.lit(SIZE_CLASS), F.col("class")) - 1e-6), F.ceil(F.col("n") * (percent / 100) - 1e-6))
    required = F.ceil(percent * (F.col("n") + least) / (100 + percent) - 1e-6)
    probes = probes.where(F.col("pos") + F.col("own") <= F.col("n") - required).select(F.col("x.k").alias("k"), "class", F.col("id").alias("x"), F.col("c").alias("cx"), F.col("n").alias("nx"), (F.col("pos") + F.col("own")).alias("px"))
    # At the first shared shingle, what is left of both sets has to be enough.
    enough = F.expr(f"100 * least(nx, ny) >= {percent} * greatest(nx, ny) AND {100 + percent} * least(nx - px, ny - py) >= {percent} * (nx + ny)")
    met = probes.join(targets, (probes["k"] == targets["k"]) & (probes["class"] == targets["class"]) & (F.col("cx") != F.col("cy")) & enough)
    low = F.col("x") < F.col("y")
    pairs = met.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), F.when(low, F.col("cx")).otherwise(F.col("cy")).alias("cx"), F.when(low, F.col("cy")).otherwise(F.col("cx")).alias("cy")).distinct()
    return _plausible(pairs, sizes, percent)


def keep_first(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns kept, with the smallest id of each group of near_duplicates() only.

    Documents without shingles or id stay, and so do all rows that share the id that stays.
    Only the ids that go are joined to the texts, so the texts are shuffled unless those are few.
    """
    found = near_duplicates(docs, shingle, percent, id_col, text_col)
    gone = table(found.where("NOT kept").select(F.col("doc_id").alias("__id")).distinct(), "gone")
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return docs.join(gone, docs[id_col].cast("bigint") == F.col("__id"), "left_anti")
