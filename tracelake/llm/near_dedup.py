"""Near-duplicate groups by b-bit MinHash.

Each text's set of word shingles becomes 128 minima. Groups of four minima are band keys: texts
that share one are candidates. Of each minimum only the two low bits are kept, packed into a few
longs, and the share of equal pairs of bits, corrected for chance, estimates the similarity of a
candidate pair. What passes is confirmed on the full sets.

Texts with equal sets are one node. In a bucket, members are first compared with one hub only,
the member that shares most buckets: that settles groups of any size with as many pairs as
members. Members still apart from their hub then meet the rest of the hub's buckets in blocks of
bounded size, inside which pairs are compared without being rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.shared import join_by_size, settle, slices

PERMUTATIONS = 128
BAND_ROWS = 4  # 32 bands: a pair at similarity 0.8 shares none with probability 5e-8
BITS = 2
#: An estimate below this is six standard deviations under a similarity of 0.8.
LEAST_ESTIMATE = 0.55
#: Rows and shingles of one side of a block, about; and rows of one part of a bucket.
BLOCK = 128
BLOCK_SHINGLES = 1 << 21
PART_ROWS = 256
#: Rows of the narrow tables of links and labels in one task.
ROWS_A_TASK = 50_000
KNOWN_WORDS = 500_000

_rng = np.random.default_rng(41)
FACTORS = _rng.integers(0, 2**32, PERMUTATIONS, dtype=np.uint32) | np.uint32(1)
OFFSETS = _rng.integers(0, 2**32, PERMUTATIONS, dtype=np.uint32)
BAND_FACTORS = _rng.integers(0, 2**64, BAND_ROWS, dtype=np.uint64) | np.uint64(1)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(text: str | None, hashes: dict, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles of `words` words, A-Z lower-cased."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(found)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    if len(hashes) > KNOWN_WORDS:
        hashes.clear()
    h = np.fromiter(map(hashes.__getitem__, found), dtype=np.uint64, count=n)
    width = min(words, n)
    key = np.full(n - width + 1, width, dtype=np.uint64)
    for k in range(width):
        key = (key ^ h[k : n - width + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return np.unique(key)


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, PERMUTATIONS) least permuted values of each non-empty set."""
    out = np.empty((len(sets), PERMUTATIONS), dtype=np.uint32)
    at = 0
    while at < len(sets):
        stop, held = at, 0
        while stop < len(sets) and (stop == at or held + len(sets[stop]) <= 16_384):
            held += len(sets[stop])
            stop += 1
        flat = np.concatenate(sets[at:stop])
        flat = (flat ^ (flat >> np.uint64(32))).astype(np.uint32)
        starts = np.r_[0, np.cumsum([len(s) for s in sets[at : stop - 1]])].astype(np.int64)
        for k in range(PERMUTATIONS):
            out[at:stop, k] = np.minimum.reduceat(flat * FACTORS[k] + OFFSETS[k], starts)
        at = stop
    return out


def band_keys(mins: np.ndarray) -> np.ndarray:
    parts = mins.reshape(len(mins), PERMUTATIONS // BAND_ROWS, BAND_ROWS).astype(np.uint64)
    keys = np.broadcast_to(np.arange(1, parts.shape[1] + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for k in range(BAND_ROWS):
        keys = (keys ^ parts[:, :, k]) * BAND_FACTORS[k]
        keys ^= keys >> np.uint64(31)
    return keys.view(np.int64)


def packed_bits(mins: np.ndarray) -> np.ndarray:
    """The BITS low bits of every mixed minimum, one plane after another, as 64-bit numbers.

    The low bits of a minimum itself depend on the low bits of its shingle only, under every
    permutation alike; mixing makes chance matches independent.
    """
    mixed = ((mins ^ (mins >> np.uint32(16))) * np.uint32(0x85EBCA6B)) >> np.uint32(16)
    planes = [np.packbits(((mixed >> np.uint32(b)) & np.uint32(1)).astype(np.uint8), axis=1) for b in range(BITS)]
    return np.ascontiguousarray(np.concatenate(planes, axis=1)).view(np.int64)


WORDS = PERMUTATIONS // 64


def estimate(a: Column, b: Column) -> Column:
    """Similarity from equal low bits, corrected for those equal by chance."""
    unequal = F.lit(0)
    for word in range(WORDS):
        differ = F.lit(0).cast("long")
        for plane in range(BITS):
            differ = differ.bitwiseOR(F.get(a, F.lit(plane * WORDS + word)).bitwiseXOR(F.get(b, F.lit(plane * WORDS + word))))
        unequal = unequal + F.bit_count(differ)
    chance = 0.5**BITS
    return (1 - unequal / PERMUTATIONS - chance) / (1 - chance)


def estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The same for every pair of a row of `a` and a row of `b`."""
    differ = np.zeros((len(a), len(b), WORDS), dtype=np.uint64)
    for plane in range(BITS):
        columns = slice(plane * WORDS, (plane + 1) * WORDS)
        differ |= a.view(np.uint64)[:, None, columns] ^ b.view(np.uint64)[None, :, columns]
    chance = 0.5**BITS
    return (1 - np.bitwise_count(differ).sum(axis=2) / PERMUTATIONS - chance) / (1 - chance)


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, on the full sets."""
    small, large = sorted((len(a), len(b)))
    if 100 * small < percent * large:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (small + large - both)


def _sketch(words: int):
    def run(batches):
        hashes = _WordHashes()
        for batch in batches:
            for part in slices(batch, ["text"]):
                sets = [shingle_set(t.as_py(), hashes, words) for t in part.column("text")]
                full = [s for s in sets if len(s)]
                mins = minima(full)
                bands, bits = iter(band_keys(mins).tolist()), iter(packed_bits(mins).tolist())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("text_key"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest() if len(s) else None for s in sets], pa.string()),
                        pa.array([next(bands) if len(s) else None for s in sets], pa.list_(pa.int64())),
                        pa.array([next(bits) if len(s) else None for s in sets], pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "text_key", "n_shingles", "set_id", "bands", "bits"],
                )

    return run


PAIR = "hub long, hub_name long, node long, name long, bits array<long>, n_shingles long, size long"


def _confirm(words: int, percent: int):
    """Candidate pairs with both texts become the pairs and whether they are linked."""

    def run(batches):
        hashes, hub, hub_set = _WordHashes(), None, None
        for batch in batches:
            for part in slices(batch, ["hub_text", "node_text"]):
                linked = []
                for i in range(part.num_rows):
                    if part.column("hub")[i].as_py() != hub:
                        hub = part.column("hub")[i].as_py()
                        hub_set = shingle_set(part.column("hub_text")[i].as_py(), hashes, words)
                    linked.append(alike(hub_set, shingle_set(part.column("node_text")[i].as_py(), hashes, words), percent))
                pair = part.drop_columns(["hub_text", "node_text"])
                yield pa.RecordBatch.from_arrays([*pair.columns, pa.array(linked, pa.bool_())], names=[*pair.schema.names, "linked"])

    return run


def overlaps(left: list[np.ndarray], right: list[np.ndarray], columns: int = 8_192) -> np.ndarray:
    """Exact intersection sizes of every left with every right set, as products of 0/1 matrices.

    Only shingles that stand on both sides get a column, and columns are taken a part at a time,
    so memory is bounded however long the texts are.
    """
    both = np.intersect1d(np.concatenate(left), np.concatenate(right))
    found = np.zeros((len(left), len(right)), dtype=np.float32)

    def places(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.minimum(np.searchsorted(both, flat), len(both) - 1)
        hit = both[at] == flat
        return row[hit], at[hit]

    if len(both):
        (ra, ca), (rb, cb) = places(left), places(right)
        for start in range(0, len(both), columns):
            a, b = np.zeros((len(left), columns), dtype=np.float32), np.zeros((len(right), columns), dtype=np.float32)
            for m, r, c in ((a, ra, ca), (b, rb, cb)):
                here = (c >= start) & (c < start + columns)
                m[r[here], c[here] - start] = 1
            found += a @ b.T
    return found.astype(np.int64)


MEMBER = "hub long, x int, y int, side int, node long, name long, bits array<long>, linked boolean"


def _likely(sides: list[pa.Table]) -> np.ndarray:
    """Which members of the two sides may be linked by their bits; a pair of strays once, not both ways."""
    nodes = [np.array(t["node"].to_pylist(), dtype=np.int64) for t in sides]
    likely = estimates(*[np.array(t["bits"].to_pylist(), dtype=np.int64) for t in sides]) >= LEAST_ESTIMATE
    with_hub = np.array(sides[0]["linked"].to_pylist())
    return likely & (with_hub[:, None] | (nodes[0][:, None] < nodes[1][None, :]))


def _sides(table: pa.Table) -> list[pa.Table]:
    return [table.filter(pc.equal(table["side"], k)) for k in (0, 1)]


def _meet(table: pa.Table) -> pa.Table:
    """The members of a block that may be linked with a member of its other side."""
    sides = _sides(table)
    if not all(len(t) for t in sides):
        return table.slice(0, 0)
    likely = _likely(sides)
    return pa.concat_tables([t.filter(pa.array(likely.any(axis=axis))) for t, axis in zip(sides, (1, 0), strict=True)])


def _settle_block(words: int, percent: int):
    """Links that join different components inside one block of a crowd, no more than a forest of them."""

    def run(table: pa.Table) -> pa.Table:
        sides = _sides(table)
        found = []
        if all(len(t) for t in sides):
            hashes = _WordHashes()
            sets = [[shingle_set(text.as_py(), hashes, words) for text in t["text"]] for t in sides]
            both = overlaps(*sets)
            union = np.array([len(x) for x in sets[0]])[:, None] + np.array([len(x) for x in sets[1]])[None, :] - both
            ends = [[(n, m, k) for n, m, k in zip(t["node"].to_pylist(), t["name"].to_pylist(), t["linked"].to_pylist(), strict=True)] for t in sides]
            parent: dict[int, int] = {}

            def root(end: tuple[int, int, bool]) -> int:
                x = -1 if end[2] else end[0]  # what is linked with the hub is one component
                while parent.setdefault(x, x) != x:
                    parent[x] = x = parent[parent[x]]
                return x

            for i, j in np.argwhere((100 * both >= percent * union) & _likely(sides)).tolist():
                a, b = ends[0][i], ends[1][j]
                p, q = root(a), root(b)
                if p != q:
                    parent[p] = q
                    found.append((a[0], a[1], b[0], b[1]))
        return pa.table({name: pa.array([f[k] for f in found], pa.int64()) for k, name in enumerate(("a", "a_name", "b", "b_name"))})

    return run


def components(links: DataFrame) -> DataFrame:
    """(node, label): for each end of the links (a, a_name, b, b_name) the least name reachable from it.

    A label is struct(name, node), so nodes that share a name stay apart. Labels spread along the
    links, and each node also takes the label of the node that its label names, so a chain of n
    links takes about log n rounds. The tables are narrow and kept in as many files as their rows
    call for. One node may have very many links, and one label very many nodes: the sums over them
    are made before any shuffle, and the joins are left to AQE, which splits partitions of that size.
    """
    tasks = max(8, links.count() // ROWS_A_TASK)
    back = links.select(F.col("b").alias("a"), F.col("b_name").alias("a_name"), F.col("a").alias("b"), F.col("a_name").alias("b_name"))
    edges = settle(links.select(*back.columns).union(back).coalesce(tasks))
    named = lambda end: F.struct(F.col(f"{end}_name").alias("name"), F.col(end).alias("node"))
    labels = settle(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min(named("a")), F.min(named("b"))).alias("label")).coalesce(tasks))
    while True:
        heard = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("heard"))
        spread = labels.join(heard, "node").select("node", F.col("label").alias("old"), F.least("label", "heard").alias("label"))
        beyond = labels.select(F.col("node").alias("at"), F.col("label").alias("beyond"))
        moved = spread.join(beyond, F.col("label.node") == F.col("at")).select("node", "old", F.least("label", "beyond").alias("label"))
        moved = settle(moved.coalesce(tasks))
        labels = moved.drop("old")
        if moved.filter("label <> old").isEmpty():
            return labels.select("node", F.col("label.name").alias("label"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id, kept, text_key (xxhash64 of the text).

    Two texts are linked when 100 * intersection >= percent * union of their sets of `words`-word
    shingles (A-Z lower-cased; a text with fewer words is one shingle). component_id is the least
    id reachable over links, and the row with that id is kept. Null, empty and blank texts are
    linked with nothing. A row with a null id is left alone: its component_id is null and it is
    kept. Repeated rows, and rows that share an id, are judged by their own text; however often a
    row is repeated, its text is compared once. Other columns are not read. Ids are 64-bit integers.
    A shingle is known by a 64-bit hash of its words' 64-bit hashes, here and in the full sets.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("text_key", F.xxhash64("text"))
    sketch = settle(rows.mapInArrow(_sketch(words), "doc_id long, text_key long, n_shingles long, set_id string, bands array<long>, bits array<long>"))
    first = [F.first(c).alias(c) for c in ("n_shingles", "bands", "bits")]
    classes = sketch.filter("set_id is not null and doc_id is not null").groupBy("set_id").agg(F.min(F.struct("doc_id", "text_key")).alias("first"), *first)
    classes = settle(classes.select(F.monotonically_increasing_id().alias("node"), "set_id", F.col("first.doc_id").alias("name"), F.col("first.text_key").alias("text_key"), "n_shingles", "bands", "bits"))

    slots = classes.select("node", F.explode("bands").alias("slot"))
    sizes = slots.groupBy("slot").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    # The window holds one node's buckets, no more than there are bands.
    shared = slots.join(sizes, "slot").withColumn("centrality", F.sum("size").over(Window.partitionBy("node")))
    shared = settle(shared.join(classes.drop("set_id", "bands"), "node"))
    # Parts of a bucket of that size, a power of two: known on every row without a join.
    parts = lambda size: F.greatest(F.lit(1), F.pow(F.lit(2), F.ceil(F.log2(size / PART_ROWS)))).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    heads = shared.groupBy("slot", "size").agg(F.max(F.struct("centrality", (-F.col("node")).alias("minus"), "name", "text_key", "bits")).alias("head"))
    heads = heads.select("slot", (-F.col("head.minus")).alias("hub"), F.col("head.name").alias("hub_name"), F.col("head.text_key").alias("hub_key"), F.col("head.bits").alias("hub_bits"), every(parts(F.col("size"))).alias("part"))
    met = shared.withColumn("part", F.pmod(F.hash("node"), parts(F.col("size")))).join(heads, ["slot", "part"]).filter("node <> hub")
    met = met.withColumn("likely", estimate(F.col("hub_bits"), F.col("bits")) >= LEAST_ESTIMATE)
    pair = ["hub", "hub_name", "hub_key", "node", "name", "text_key", "n_shingles", "likely"]
    members = settle(met.groupBy(*pair).agg(F.max("size").alias("size"), F.first("bits").alias("bits")))

    # Strays of buckets of three and more may still meet other members, so those texts are wanted too.
    likely = members.filter("likely")
    wanted = members.filter("likely or size > 2").select("node", F.col("name").alias("doc_id"), "text_key").union(likely.select("hub", "hub_name", "hub_key"))
    wanted = wanted.groupBy("doc_id", "text_key").agg(F.min("node").alias("node"))
    texts = settle(rows.join(wanted, ["doc_id", "text_key"]).dropDuplicates(["doc_id", "text_key"]).select("node", "text"))
    # A hub's text goes to as many parts as its largest bucket has; no part holds one hub's every member.
    dealt = likely.withColumn("parts", parts(F.col("size"))).withColumn("part", F.pmod(F.hash("node"), F.col("parts")))
    hubs = dealt.select("hub", "parts").distinct().join(texts.withColumnsRenamed({"node": "hub", "text": "hub_text"}), "hub").withColumn("part", every(F.col("parts")))
    compared = dealt.join(texts.withColumnRenamed("text", "node_text"), "node").join(hubs, ["hub", "parts", "part"])
    checked = settle(compared.select("hub", "hub_name", "node", "name", "bits", "n_shingles", "size", "hub_text", "node_text").mapInArrow(_confirm(words, percent), f"{PAIR}, linked boolean"))

    # Buckets of one hub hold much the same members: they are settled together, as one crowd.
    apart = members.filter("not likely").withColumn("linked", F.lit(False))
    crowd = checked.unionByName(apart.select(*checked.columns)).filter("size > 2").select("hub", "node", "name", "bits", "n_shingles", "linked")
    stray = ~F.col("linked")
    counts = crowd.groupBy("hub").agg(F.count(F.lit(1)).alias("size"), F.count_if(stray).alias("n_stray"), F.sum("n_shingles").alias("held"), F.sum(F.when(stray, F.col("n_shingles"))).alias("stray_held")).filter("size > 1 and n_stray > 0")
    many = lambda size, held: F.ceil(F.greatest(F.col(size) / BLOCK, F.col(held) / BLOCK_SHINGLES)).cast("int")
    left_blocks, right_blocks = many("size", "held"), many("n_stray", "stray_held")
    block = lambda n: F.pmod(F.hash("node", "hub"), n)
    crowd = join_by_size(crowd, counts, "hub", "size", F.col("node")).filter("size is not null")
    member = ["node", "name", "bits", "linked"]
    left = crowd.select("hub", block(left_blocks).alias("x"), every(right_blocks).alias("y"), F.lit(0).alias("side"), *member)
    right = crowd.filter(stray).select("hub", every(left_blocks).alias("x"), block(right_blocks).alias("y"), F.lit(1).alias("side"), *member)
    # Blocks meet by their bits first; only texts of members that may be linked are copied to a block.
    close = left.union(right).groupBy("hub", "x", "y").applyInArrow(_meet, MEMBER)
    more = close.join(texts, "node").groupBy("hub", "x", "y").applyInArrow(_settle_block(words, percent), "a long, a_name long, b long, b_name long")
    links = checked.filter("linked").select(F.col("hub").alias("a"), F.col("hub_name").alias("a_name"), F.col("node").alias("b"), F.col("name").alias("b_name"))
    labels = components(links.union(settle(more)))

    component = classes.join(labels, "node", "left").select("set_id", F.coalesce("label", "name").alias("component"))
    joined = sketch.select("doc_id", "text_key", "n_shingles", "set_id").join(component, "set_id", "left")
    found = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return joined.select("doc_id", "n_shingles", found.alias("component_id"), F.coalesce(F.col("doc_id") == found, F.lit(True)).alias("kept"), "text_key")


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs` that stay, with all their columns: of each component the one with the least id."""
    gone = settle(near_groups(docs, id_col, text_col, words, percent).filter(~F.col("kept")).select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key")).distinct())
    same = (F.col(id_col).cast("long") == F.col("gone_id")) & (F.xxhash64(F.col(text_col).cast("string")) == F.col("gone_key"))
    return docs.join(gone, same, "left_anti")
