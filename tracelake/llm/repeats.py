"""Suffix-order dedup: bytes covered by a string of a given length that stands somewhere else too.

Every window of `length` bytes is known by its anchor: the leftmost of the grams in it with the least
hash. Equal windows have equal anchors at equal places, so windows are compared only below one gram,
and all windows of neighbouring starts with one anchor travel as one stretch. Stretches whose gram
stands once in the corpus are dropped; equal stretches share a name (gram hash and content hash, 128
bits), so a long copy is settled by names alone. Where copies begin, end or differ, one stretch of
each name goes to a block with all others of its gram. There the suffixes of its starts are put in
order, and the previous and next suffix in that order which stand earlier in the corpus give each
start its longest previous factor; the same with later ones gives the longest next factor. A start
whose factor has `length` bytes is repeated. Grams with very many names, as at the ends of a passage
that a large part of the corpus holds, are settled start by start: names of whole windows are counted
before they meet, so no gram's stretches come together in one task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm.shared import discard, settle, slices, written

#: Bytes of a gram; a power of two below the length of windows.
GRAM = 32
#: Starts that are hashed at once, so a text of any length takes bounded memory.
PIECE = 1 << 20
#: Bits of a hash that give way to the place in a piece.
PLACE_BITS = 22
#: Names of one gram that may meet in a block.
BLOCK_NAMES = 2_048
#: Bytes of stretches in a block, about.
BLOCK_BYTES = 3 << 20


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A hash of the `gram` bytes at each place of `data` where so many follow."""
    found = np.random.default_rng(20_261_113).integers(0, 2**64, 256, dtype=np.uint64)[data]
    base, width = np.uint64(0x9E3779B97F4A7C15), 1
    while width < gram:
        found = found[:-width] * base + found[width:]
        with np.errstate(over="ignore"):
            base = base * base
        width *= 2
    found ^= found >> np.uint64(31)
    found *= np.uint64(0xBF58476D1CE4E5B9)
    return found ^ (found >> np.uint64(29))


def least_places(values: np.ndarray, width: int) -> np.ndarray:
    """The place of the least value among the `width` values from each place on: high bits count, then the leftmost.

    Places are written over the low bits, so one running minimum from each end of blocks of `width` tells both.
    """
    n = len(values) - width + 1
    mask = np.uint64((1 << PLACE_BITS) - 1)
    marked = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max)
    marked[: len(values)] = (values & ~mask) | np.arange(len(values), dtype=np.uint64)
    blocks = marked.reshape(-1, width)
    from_left = np.minimum.accumulate(blocks, axis=1).ravel()
    from_right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(from_right[:n], from_left[width - 1 : width - 1 + n]) & mask).astype(np.int64)


def stretches(data: np.ndarray, ends: np.ndarray, length: int, gram: int = GRAM):
    """(document, first start, last start, anchor, gram hash) of each stretch of windows with one anchor.

    `data` holds the bytes of the documents one after another, `ends` where each ends.
    """
    for begin in range(0, len(data) - length + 1, PIECE):
        view = data[begin : begin + PIECE + length - 1]
        hashes = gram_hashes(view, gram)
        anchor = least_places(hashes, length - gram + 1)
        inside = np.ones(len(anchor) + 2, dtype=bool)  # starts whose window lies in one document
        inside[[0, -1]] = False
        for end in ends[np.searchsorted(ends, begin, "right") : np.searchsorted(ends, begin + len(anchor) + length)].tolist():
            inside[max(1, end - length + 2 - begin) : max(1, end + 1 - begin)] = False
        turn = np.r_[True, anchor[1:] != anchor[:-1], True]
        first = np.flatnonzero(inside[1:-1] & (turn[:-1] | ~inside[:-2]))
        last = np.flatnonzero(inside[1:-1] & (turn[1:] | ~inside[2:]))
        if len(first):
            yield np.searchsorted(ends, first + begin, "right"), first + begin, last + begin, anchor[first] + begin, hashes[anchor[first]]


def _bounds(sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    ends = np.cumsum(np.array(sizes, dtype=np.int64))
    return ends - np.array(sizes, dtype=np.int64), ends


def _anchors(length: int):
    def run(batches):
        for batch in batches:
            for part in slices(batch, ["text"], 1 << 20):
                texts = part.column("text").cast(pa.binary()).to_pylist()
                whole = b"".join(texts)
                begins, ends = _bounds([len(t) for t in texts])
                for doc, lo, hi, anchor, gram in stretches(np.frombuffer(whole, dtype=np.uint8), ends, length):
                    name = [xxhash.xxh3_64_intdigest(whole[a:b]) for a, b in zip(lo.tolist(), (hi + length).tolist(), strict=True)]
                    rows = part.select(["k1", "k2", "doc_id"]).take(pa.array(doc))
                    yield pa.RecordBatch.from_arrays(
                        [*rows.columns, pa.array(gram.view(np.int64)), pa.array(np.array(name, dtype=np.uint64).view(np.int64)), pa.array(lo - begins[doc]), pa.array((hi - lo).astype(np.int32)), pa.array((anchor - lo).astype(np.int32))],
                        names=["k1", "k2", "doc_id", "gram", "name", "lo", "span", "off"],
                    )

    return run


#: What is known of a stretch: its name, how many names its gram has, and where it stands first.
STRETCH = ("gram", "name", "names", "s_id", "s1", "s2", "lo")


def _cut(length: int):
    """The bytes of the stretches that a row lists."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                text, listed = batch.column("text")[i].as_buffer(), batch.column("listed").slice(i, 1).flatten()
                lo, span = (np.asarray(listed.field(c)) for c in ("lo", "span"))
                data = memoryview(text)
                yield pa.RecordBatch.from_arrays([*[listed.field(c) for c in STRETCH], pa.array([bytes(data[a : a + s + length]) for a, s in zip(lo.tolist(), span.tolist(), strict=True)], pa.binary())], names=[*STRETCH, "bytes"])

    return run


def ranks(data: np.ndarray, depth: int) -> list[tuple[int, np.ndarray]]:
    """(width, rank of the `width` bytes at each place), widths doubling from 8 up to `depth` at least; zeros follow the end."""
    word, width = np.r_[data.astype(np.uint64), np.zeros(8, dtype=np.uint64)], 1
    while width < 8:
        word = (word[:-width] << np.uint64(8 * width)) | word[width:]
        width *= 2
    found = [(8, np.unique(word[: len(data)], return_inverse=True)[1])]
    while (width := found[-1][0]) < depth:
        rank = found[-1][1]
        after = np.zeros(len(rank), dtype=np.int64)
        after[:-width] = rank[width:] + 1
        found.append((2 * width, np.unique(rank * (rank.max() + 2) + after, return_inverse=True)[1]))
    return found


def common_prefix(data: np.ndarray, levels: list[tuple[int, np.ndarray]], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bytes that the suffixes at `a` and `b` have in common, below twice the greatest width."""
    end = len(levels[0][1])
    common = np.zeros(len(a), dtype=np.int64)
    for width, rank in reversed(levels):
        i, j = a + common, b + common
        same = (np.maximum(i, j) + width <= end) & (rank[np.minimum(i, end - 1)] == rank[np.minimum(j, end - 1)])
        common += width * same
    alike = np.ones(len(a), dtype=bool)
    for _ in range(levels[0][0] - 1):
        i, j = a + common, b + common
        alike &= (np.maximum(i, j) < end) & (data[np.minimum(i, end - 1)] == data[np.minimum(j, end - 1)])
        common += alike
    return common


def nearest_smaller(values: np.ndarray) -> np.ndarray:
    """For each place the nearest place before it with a smaller value, -1 where there is none."""
    tables = [values]
    while (reach := 1 << (len(tables) - 1)) * 2 <= len(values):
        tables.append(np.minimum(tables[-1][:-reach], tables[-1][reach:]))
    at = np.arange(len(values))  # all values from `at` up to the place are no smaller
    for level in range(len(tables) - 1, -1, -1):
        begin = at - (1 << level)
        clear = (begin >= 0) & (tables[level][np.maximum(begin, 0)] >= values)
        at = np.where(clear, begin, at)
    return at - 1


def factor_lengths(data: np.ndarray, levels: list[tuple[int, np.ndarray]], order: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Longest previous factor of each suffix of `order`, in that order: the longer of the prefixes it shares with the
    previous and the next suffix in order whose `place` is smaller."""
    longest = np.zeros(len(order), dtype=np.int64)
    for flip in (slice(None), slice(None, None, -1)):
        near = nearest_smaller(place[flip])
        has = near >= 0
        met = common_prefix(data, levels, order[flip][has], order[flip][near[has]])
        longest[flip][has] = np.maximum(longest[flip][has], met)
    return longest


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.r_[0, flags.astype(np.int8), 0]))
    return list(zip(edges[::2].tolist(), (edges[1::2] - 1).tolist(), strict=True))


RUNS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def repeated_windows(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Those of `starts` whose window's hash is another's too; a collision lets a start through, none gets lost."""
    hashes, width, whole, covered = np.random.default_rng(length).integers(0, 2**64, 256, dtype=np.uint64)[data], 1, None, 0
    base = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        while True:
            if length & width:
                part = hashes[starts + covered]
                whole = part if whole is None else (whole ^ (whole >> np.uint64(31))) * base + part
                covered += width
            if 2 * width > length:
                break
            hashes = hashes * base
            hashes[:-width] += hashes[width:] ^ (hashes[width:] >> np.uint64(32))
            width *= 2
    order = np.argsort(whole)
    same = whole[order[1:]] == whole[order[:-1]]
    flags = np.zeros(len(starts), dtype=bool)
    flags[order[1:][same]] = flags[order[:-1][same]] = True
    return starts[flags]


def repeated_starts(stretch: list[bytes], length: int) -> tuple[list[list[tuple[int, int]]], list[list[tuple[int, int]]]]:
    """Runs of starts of each stretch whose window stands in an earlier stretch of the list, and in any other."""
    begins, ends = _bounds([len(s) for s in stretch])
    data = np.frombuffer(b"".join(stretch), dtype=np.uint8)
    valid = np.arange(len(data)) + length <= np.repeat(ends, ends - begins)
    likely = repeated_windows(data, np.flatnonzero(valid), length)
    # Only bytes below likely windows are put in order; what lies between them is cut out.
    covered = np.zeros(len(data) + 1, dtype=np.int32)
    np.add.at(covered, likely, 1)
    np.add.at(covered, likely + length, -1)
    held = np.flatnonzero(np.cumsum(covered[:-1]))
    at, flags = np.searchsorted(held, likely), np.zeros((2, len(data)), dtype=bool)
    if len(at):
        levels = ranks(data[held], length)
        order = at[np.argsort(levels[-1][1][at], kind="stable")]
        for flag, place in zip(flags, (order, -order), strict=True):
            flag[held[order[factor_lengths(data[held], levels, order, place) >= length]]] = True
    cut = lambda flag: [_runs(flag[a : b - length + 1]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
    return cut(flags[0]), cut(flags[0] | flags[1])


def _blocks(length: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, [(c, "ascending") for c in ("s_id", "s1", "s2", "lo")], null_placement="at_start"))
        gram, name = np.asarray(table["gram"]), np.asarray(table["name"])
        table = table.take(np.flatnonzero(np.r_[True, (gram[1:] != gram[:-1]) | (name[1:] != name[:-1])]))  # a repeated row's stretches come twice
        earlier, anywhere = repeated_starts(table["bytes"].to_pylist(), length)
        return pa.table({"gram": table["gram"], "name": table["name"], "earlier": pa.array([[{"a": a, "b": b} for a, b in r] for r in earlier], RUNS), "anywhere": pa.array([[{"a": a, "b": b} for a, b in r] for r in anywhere], RUNS)})

    return run


def _windows(length: int):
    """Each window of a stretch by a 128-bit name."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, ["bytes"], 1 << 17):
                rows, starts, high, low = [], [], [], []
                for i, whole in enumerate(part.column("bytes").to_pylist()):
                    n = len(whole) - length + 1
                    names = [xxhash.xxh3_128_intdigest(whole[a : a + length]) for a in range(n)]
                    rows += [i] * n
                    starts += range(n)
                    high += [x >> 64 for x in names]
                    low += [x & 0xFFFFFFFFFFFFFFFF for x in names]
                signed = lambda x: pa.array(np.array(x, dtype=np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays([*part.select(["gram", "name", *STRETCH[3:]]).take(pa.array(rows, pa.int64())).columns, pa.array(starts, pa.int32()), signed(high), signed(low)], names=["gram", "name", *STRETCH[3:], "start", "w1", "w2"])

    return run


def _spans(ranges: list[tuple[int, int]], length: int) -> list[list[int]]:
    """Byte spans that the windows starting in `ranges` cover, merged."""
    merged: list[list[int]] = []
    for a, b in sorted(ranges):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b + length)
        else:
            merged.append([a, b + length])
    return merged


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _removed(length: int, with_bytes: bool):
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                data = memoryview(batch.column("text")[i].as_buffer())
                spans = _spans([(r["a"], r["b"]) for r in batch.column("ranges")[i].as_py() or ()], length)
                digest, at, kept = hashlib.sha256(), 0, []
                for a, b in [*spans, [len(data), len(data)]]:
                    digest.update(data[at:a])
                    kept += [bytes(data[at:a])] if with_bytes else []
                    at = b
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(i, 1).select(["k1", "k2"]).columns, pa.array([sum(b - a for a, b in spans)], pa.int64()), pa.array([[{"start": a, "end": b} for a, b in spans]], SPANS), pa.array([digest.hexdigest()]), *([pa.array([b"".join(kept)], pa.binary())] if with_bytes else [])],
                    names=["k1", "k2", "n_removed", "spans", "kept_sha256", *(["kept"] if with_bytes else [])],
                )

    return run


def _keys(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(7), text).alias("k2")]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, keep: str = "first", with_bytes: bool = False) -> DataFrame:
    """One row per row of `docs`: doc_id, n_bytes, n_removed, n_spans, spans, kept_sha256, and with `with_bytes` kept (binary).

    Texts count as UTF-8 bytes (null: empty); matches never cross rows. With keep="first" a byte goes if a
    string of `length` bytes over it also starts earlier: in a row with a smaller id (a null id is the
    smallest; texts of one id come in the order of their hashes), or further left in the same text. With
    keep="none" it goes if the string starts anywhere else. Overlaps count, and strings are judged on the
    texts as they are. `spans` are the removed runs, (start, end) in bytes. Of equal texts all but the
    first row count as later copies. Texts under `length` bytes lose nothing; an empty table gives an
    empty result; other columns are not read. `length` is over 32.
    """
    if keep not in ("first", "none") or length <= GRAM:
        raise ValueError("keep is first or none, and length is over 32")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    texts = texts.select(*_keys(F.col("text")), "doc_id", F.col("text").cast("binary").alias("text"))
    size = F.octet_length("text").cast("long")
    rows = settle(texts.select("k1", "k2", "doc_id", size.alias("n_bytes"), F.sha2("text", 256).alias("sha"), F.monotonically_increasing_id().alias("row_no")))
    copies = written(rows.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("rows"), F.min(F.struct("doc_id", "row_no")).alias("first")).filter("rows > 1"), "copies")
    long = texts.filter(size >= length)
    # A checkpoint keeps its partitioning, and a join that shuffles one side only cannot split a hot key: the small sides are tables.

    def with_text(lists: DataFrame, of: DataFrame, how: str = "inner") -> DataFrame:
        """The texts of `of` beside the lists of their key and id."""
        same = (F.col("t.k1") == F.col("l.k1")) & (F.col("t.k2") == F.col("l.k2")) & F.col("t.doc_id").eqNullSafe(F.col("l.doc_id"))
        return of.alias("t").join(lists.hint("shuffle_hash").alias("l"), same, how)

    found = written(long.mapInArrow(_anchors(length), f"k1 long, k2 long, doc_id {kind}, gram long, name long, lo long, span int, off int"), "anchors")
    repeated = written(found.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("gram"), "repeated")
    # Equal texts are one from here on, known by their first id.
    # Grouped without the gram, so the join's hot grams can be split.
    spots = found.join(repeated, "gram").groupBy("k1", "k2", "lo", "span", "name").agg(F.min("gram").alias("gram"), F.min(F.struct("doc_id")).alias("id"))
    spots = written(spots.select("gram", "name", F.col("id.doc_id").alias("s_id"), F.col("k1").alias("s1"), F.col("k2").alias("s2"), "lo", "span"), "spots")
    discard(found)
    place = F.struct("s_id", "s1", "s2", "lo")
    names = written(spots.groupBy("gram", "name").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("place"), F.min("span").alias("span")), "names")
    several = written(names.groupBy("gram").agg(F.count(F.lit(1)).alias("names")).filter("names > 1"), "several")
    names = names.join(several, "gram", "left").filter("n > 1 or names > 1")

    shipped = names.filter("names > 1").select("gram", "name", "names", "place.*", "span")
    lists = shipped.groupBy(F.col("s1").alias("k1"), F.col("s2").alias("k2"), F.col("s_id").alias("doc_id")).agg(F.collect_list(F.struct(*STRETCH, "span")).alias("listed"))
    order = f"s_id {kind}, s1 long, s2 long, lo long"
    cut = written(with_text(lists, long).select("text", "listed").mapInArrow(_cut(length), f"gram long, name long, names long, {order}, bytes binary"), "stretches")
    total = cut.agg(F.coalesce(F.sum(F.octet_length("bytes")), F.lit(0))).first()[0]
    runs = "array<struct<a:int,b:int>>"
    block = F.pmod(F.xxhash64("gram"), F.lit(max(1, -(-total // BLOCK_BYTES))))
    told = cut.filter(F.col("names") <= BLOCK_NAMES).withColumn("block", block).groupBy("block").applyInArrow(_blocks(length), f"gram long, name long, earlier {runs}, anywhere {runs}")
    crowd = cut.filter(F.col("names") > BLOCK_NAMES).dropDuplicates(["gram", "name"])
    single = written(crowd.mapInArrow(_windows(length), f"gram long, name long, {order}, start int, w1 long, w2 long"), "windows")
    held = written(single.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("held"), F.min(place).alias("first")).filter("held > 1"), "held")
    each = single.join(held, ["w1", "w2"]).select("gram", "name", F.struct(F.col("start").alias("a"), F.col("start").alias("b")).alias("at"), (place != F.col("first")).alias("later"))
    told = written(told.unionByName(each.groupBy("gram", "name").agg(F.collect_list(F.when(F.col("later"), F.col("at"))).alias("earlier"), F.collect_list("at").alias("anywhere"))), "starts")
    discard(cut, single)
    names = names.select("gram", "name", "n", "place").join(told, ["gram", "name"], "left")

    whole = F.array(F.struct(F.lit(0).alias("a"), F.col("span").alias("b")))
    if keep == "none":
        hit = F.when(F.col("n") > 1, whole).otherwise(F.col("anywhere"))
    else:
        hit = F.when(F.col("own") != F.col("place"), whole).otherwise(F.col("earlier"))
    hits = spots.withColumn("own", place).join(written(names, "named"), ["gram", "name"]).withColumn("hit", hit).filter(F.size("hit") > 0)
    each = hits.select(F.col("s1").alias("k1"), F.col("s2").alias("k2"), F.col("s_id").alias("doc_id"), "lo", F.explode("hit").alias("r"))
    ranges = each.groupBy("k1", "k2", "doc_id").agg(F.collect_list(F.struct((F.col("lo") + F.col("r.a")).alias("a"), (F.col("lo") + F.col("r.b")).alias("b"))).alias("ranges"))
    kept = ["kept"] if with_bytes else []
    met = with_text(ranges, texts, "left") if with_bytes else with_text(ranges, long)
    results = met.select("t.k1", "t.k2", "text", "ranges").mapInArrow(_removed(length, with_bytes), "k1 long, k2 long, n_removed long, spans array<struct<start:bigint,end:bigint>>, kept_sha256 string" + ", kept binary" * with_bytes)
    facts = ["n_removed", "spans", "kept_sha256", *kept]
    results = written(results.groupBy("k1", "k2").agg(F.max_by(F.struct(*facts), "n_removed").alias("r")).select("k1", "k2", "r.*"), "removed")

    out = rows.join(copies, ["k1", "k2"], "left").join(results, ["k1", "k2"], "left")
    copy = F.coalesce(F.col("rows") > 1, F.lit(False)) & (F.col("n_bytes") >= length)
    if keep == "first":
        copy &= F.struct("doc_id", "row_no") != F.col("first")
    all_of_it = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    out = out.select(
        "doc_id",
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, all_of_it).otherwise(F.coalesce("spans", F.slice(all_of_it, 1, 0))).alias("spans"),
        F.when(copy, F.lit(hashlib.sha256().hexdigest())).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        *[F.when(copy, F.lit(b"")).otherwise(F.col(c)).alias(c) for c in kept],
    )
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "spans", "kept_sha256", *kept)
