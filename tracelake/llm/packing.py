"""Best-fit packing of documents into training sequences of several permitted lengths.

A document's token count decides its pieces: as many whole sequences of the longest permitted
length as it fills, and one remainder. Remainders are dealt by a hash into shards of bounded size;
in each shard they go, longest first, into the open sequence with the least room that still fits.
Where none fits, the sequence size with the least expected cost a token is opened. The shard is
packed once for each upper limit on the sizes to open, and the cheapest result stays. At last
each sequence shrinks to the smallest permitted length that holds its contents.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tracelake.llm.shared import settle

SIZES = (512, 1024, 2048, 4096, 8192)
#: Cost of a sequence beyond its tokens, in tokens.
OVERHEAD = 64
#: Remainders in a shard, about.
SHARD_ROWS = 2_048


def fitting(sizes: list[int], used: int) -> int:
    """Smallest permitted size that holds `used` tokens."""
    return sizes[bisect_left(sizes, used)]


def _opened(sizes: list[int], length: int, waiting: int, overhead: int) -> int:
    """The size with the least cost for each token that it can expect to hold."""
    return min((s for s in sizes if s >= length), key=lambda s: ((s + overhead) / min(s, length + waiting), s))


def _packed(order: list[int], lengths: list[int], sizes: list[int], limit: int, overhead: int) -> tuple[list[tuple[int, int]], list[int]]:
    """(bin, offset) of each item and the tokens used in each bin; bins of at most `limit` are opened where the item fits one."""
    place, used, room = [(0, 0)] * len(lengths), [], []
    waiting = sum(lengths)
    open_bins: list[tuple[int, int]] = []  # (room, bin), sorted
    for i in order:
        n = lengths[i]
        waiting -= n
        at = bisect_left(open_bins, (n, -1))
        if at < len(open_bins):
            left, k = open_bins.pop(at)
        else:
            k = len(used)
            used.append(0)
            left = _opened([s for s in sizes if s <= max(limit, fitting(sizes, n))], n, waiting, overhead)
        place[i] = (k, used[k])
        used[k] += n
        if left > n:
            insort(open_bins, (left - n, k))
    return place, used


def pack_shard(lengths: list[int], sizes: list[int], overhead: int = OVERHEAD) -> tuple[list[tuple[int, int]], list[int]]:
    """(bin, offset) of each item and the tokens used in each bin, by the cheapest of the limits tried."""
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    tried = (_packed(order, lengths, sizes, limit, overhead) for limit in sizes)
    return min(tried, key=lambda r: sum(fitting(sizes, u) + overhead for u in r[1]))


def _shards(sizes: list[int], overhead: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("row_no", "ascending")])
        place, used = pack_shard(table["length"].to_pylist(), sizes, overhead)
        shard = table["shard"][0].as_py()
        return table.drop_columns(["shard"]).append_column("bin_id", pa.array([f"s{shard}-{k}" for k, _ in place])).append_column("bin_size", pa.array([fitting(sizes, used[k]) for k, _ in place], pa.int64())).append_column("bin_used", pa.array([used[k] for k, _ in place], pa.int64())).append_column("bin_offset", pa.array([o for _, o in place], pa.int64()))

    return run


def pack(counted: DataFrame, id_col: str = "doc_id", length_col: str = "n_tokens", sizes: tuple[int, ...] = SIZES, overhead: int = OVERHEAD, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per piece of each row of `counted`: doc_id, row_no, piece, start, n_tokens, bin_id,
    bin_size, bin_used, bin_offset.

    A row's pieces cover its tokens once, in order. A row without tokens (null, zero or less) has
    one piece of 0 tokens in no bin. Repeated rows are packed each for itself, told apart by
    row_no; null ids are kept. Other columns are not read. The number of shards follows the number
    of rows; a very long document's whole sequences never enter a shard.
    """
    allowed = sorted(set(sizes))
    longest = allowed[-1]
    kind = counted.schema[id_col].dataType.simpleString()
    rows = settle(counted.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row_no"), F.greatest(F.coalesce(F.col(length_col).cast("long"), F.lit(0)), F.lit(0)).alias("length")))
    whole = F.floor(F.col("length") / longest).cast("int")
    size = F.lit(longest).cast("long")
    full = rows.filter(F.col("length") >= longest).select("doc_id", "row_no", F.explode(F.sequence(F.lit(0), whole - 1)).alias("piece"))
    full = full.select("doc_id", "row_no", "piece", (F.col("piece") * size).alias("start"), size.alias("n_tokens"), F.concat(F.lit("w"), F.col("row_no").cast("string"), F.lit("-"), F.col("piece").cast("string")).alias("bin_id"), size.alias("bin_size"), size.alias("bin_used"), F.lit(0).cast("long").alias("bin_offset"))
    rest = rows.select("doc_id", "row_no", whole.alias("piece"), (whole * size).alias("start"), (F.col("length") - whole * size).alias("length")).filter((F.col("length") > 0) | (F.col("piece") == 0))
    empty = rest.filter("length = 0").select("doc_id", "row_no", "piece", "start", F.col("length").alias("n_tokens"), *[F.lit(None).cast(t).alias(c) for c, t in (("bin_id", "string"), ("bin_size", "long"), ("bin_used", "long"), ("bin_offset", "long"))])
    shards = max(1, -(-rows.count() // shard_rows))
    dealt = rest.filter("length > 0").withColumn("shard", F.pmod(F.xxhash64("row_no"), F.lit(shards)))
    packed = dealt.groupBy("shard").applyInArrow(_shards(allowed, overhead), f"doc_id {kind}, row_no long, piece int, start long, length long, bin_id string, bin_size long, bin_used long, bin_offset long")
    return full.unionByName(packed.withColumnRenamed("length", "n_tokens")).unionByName(empty)


def _sequences(sizes: list[int], overhead: int, doc_type: pa.DataType):
    def run(table: pa.Table) -> pa.Table:
        table = table.append_column("length", pc.cast(pc.list_value_length(table["ids"]), pa.int64()))
        table = table.sort_by([("length", "descending"), ("row_no", "ascending"), ("start", "ascending")])
        place, used = pack_shard(table["length"].to_pylist(), sizes, overhead)
        table = table.take(sorted(range(len(place)), key=place.__getitem__)).combine_chunks()
        shard, whole = table["shard"][0].as_py(), lambda c: table[c].combine_chunks()
        ids = whole("ids")
        pieces = np.r_[0, np.cumsum(np.bincount([k for k, _ in place], minlength=len(used)))].astype(np.int32)
        tokens = np.r_[0, np.cumsum(used)].astype(np.int32)
        each = lambda values: pa.ListArray.from_arrays(pa.array(pieces), values)
        return pa.table(
            {
                "bin_id": pa.array([f"s{shard}-{k}" for k in range(len(used))]),
                "bin_size": pa.array([fitting(sizes, n) for n in used], pa.int64()),
                "bin_used": pa.array(used, pa.int64()),
                "doc_ids": each(whole("doc_id").cast(doc_type)),
                "starts": each(whole("start")),
                "lengths": each(whole("length")),
                "ids": pa.ListArray.from_arrays(pa.array(tokens), ids.flatten().cast(pa.int32())),
            }
        )

    return run


def pack_ids(coded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", rows: int | None = None, tokens: int | None = None, sizes: tuple[int, ...] = SIZES, overhead: int = OVERHEAD, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per packed sequence: bin_id, bin_size, bin_used, doc_ids, starts, lengths, ids.

    `ids` holds the tokens of the pieces in order, bin_used of them; doc_ids, starts and lengths
    tell for each piece whose it is, where it starts in its document and how long it is. Every
    token of every row stands in exactly one sequence; a null or empty list of ids stands in none.
    Null and repeated ids are kept, repeated rows are packed each for itself. Tokens move once, to
    the shard of their piece. `rows` and `tokens` are upper bounds of what `coded` holds, where the
    caller has them; else they are counted, which evaluates `coded` once more. A shard holds about
    `shard_rows` pieces of the longest length at most. Other columns are not read.
    """
    allowed = sorted(set(sizes))
    longest = allowed[-1]
    if rows is None or tokens is None:
        rows, tokens = coded.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size(ids_col)), F.lit(0))).first()
    shards = max(1, -(-rows // shard_rows), -(-tokens // (shard_rows * longest // 4)))
    kind = coded.schema[id_col].dataType
    whole = coded.select(F.monotonically_increasing_id().alias("row_no"), F.col(id_col).alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).filter(F.size("ids") > 0)
    cut = whole.select("row_no", "doc_id", "ids", F.explode(F.sequence(F.lit(0), F.ceil(F.size("ids") / longest).cast("int") - 1)).alias("piece"))
    pieces = cut.select(F.pmod(F.xxhash64("row_no", "piece"), F.lit(shards)).alias("shard"), "row_no", "doc_id", (F.col("piece") * F.lit(longest).cast("long")).alias("start"), F.slice("ids", F.col("piece") * longest + 1, F.lit(longest)).alias("ids"))
    schema = f"bin_id string, bin_size long, bin_used long, doc_ids array<{kind.simpleString()}>, starts array<long>, lengths array<long>, ids array<int>"
    return pieces.groupBy("shard").applyInArrow(_sequences(allowed, overhead, to_arrow_type(kind)), schema)


def sequences(packed: DataFrame, coded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The packed sequences: bin_id, bin_size, ids; `coded` holds each document's ids, and its ids are unique and not null.

    A sequence holds bin_size ids at most, so gathering one is bounded.
    """
    parts = packed.filter("bin_id is not null").join(coded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")), "doc_id")
    parts = parts.select("bin_id", "bin_size", "bin_offset", F.slice("ids", F.col("start").cast("int") + 1, F.col("n_tokens").cast("int")).alias("ids"))
    return parts.groupBy("bin_id", "bin_size").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("bin_offset", "ids"))), lambda p: p["ids"])).alias("ids"))
