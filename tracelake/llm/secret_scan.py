"""Secret scan with corpus-wide ownership frequency.

Three fixed patterns mark spans in every text. The value of every such span and every long mixed
token become candidates; their hashes are counted over the whole corpus by distinct owners (sources)
and distinct repositories (an owner's different documents). A candidate that many owners share is a
widely copied example; one that a single owner holds, or that stands in almost only one owner's
repositories, looks live however often that owner repeats it, and its span is added.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections import Counter
from math import log2

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm.shared import settle, slices, written

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
#: Runs are maximal, so asking for their least length at once finds the same spans.
LONG_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
LONG_HEX = re.compile(r"[0-9a-f]{24,}")
#: Candidates for the ownership count: long tokens with letters and digits.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
KINDS = ("assign", "access", "hex", "owned")

MIN_ENTROPY = 3.0  # bits a character
MAX_OWNERS = 1
#: The share of a secret's repositories that makes it one owner's, whoever else holds it.
LEAST_LEAD = 0.9


def _base(text: str) -> list[tuple[int, int, str, int]]:
    """(start, end, kind, start of the value) of the fixed patterns; a value ends with its span."""
    found = [(m.start(), m.end(), "assign", m.start(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), m.end(), "access", m.start()) for m in LONG_ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex", m.start()) for m in LONG_HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, in code points, by start and then kind."""
    return [s[:3] for s in _base(text)]


def _entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * log2(c / n) for c in Counter(value).values())


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(start, end, hash) of the base spans' values and of the other tokens that look random, each place once."""
    places = {(at, stop) for _, stop, _, at in _base(text)}
    for m in CANDIDATE.finditer(text):
        value = m[0]
        if any(c.isdigit() for c in value) and any(c.isalpha() for c in value) and _entropy(value) >= MIN_ENTROPY:
            places.add((m.start(), m.end()))
    return [(a, b, int.from_bytes(hashlib.blake2b(text[a:b].encode(), digest_size=8).digest(), "little", signed=True)) for a, b in sorted(places)]


SPAN = pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("kind", pa.string())])
CANDIDATE_TYPE = pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("secret", pa.int64())])


def _scan(batches):
    for batch in batches:
        for part in slices(batch, ["text"]):
            spans, found = [], []
            for text in part.column("text"):
                text = text.as_py() or ""
                spans.append([{"start": a, "stop": b, "kind": k} for a, b, k in base_spans(text)])
                found.append([{"start": a, "stop": b, "secret": s} for a, b, s in candidates(text)])
            yield pa.RecordBatch.from_arrays([part.column("row_no"), part.column("doc_id"), part.column("text_key"), part.column("owner"), pa.array(spans, pa.list_(SPAN)), pa.array(found, pa.list_(CANDIDATE_TYPE))], names=["row_no", "doc_id", "text_key", "owner", "base", "found"])


def ownership(each: DataFrame, max_owners: int = MAX_OWNERS, least_lead: float = LEAST_LEAD, max_repositories: int | None = None) -> DataFrame:
    """secret, owners, repositories, lead, shared of candidates (secret, owner, text_key).

    A repository is a different text of an owner; `lead` is the largest number that one owner has. A
    candidate is shared, copied widely, where over `max_owners` owners hold it and none of them has
    `least_lead` of its repositories: a secret of one owner that strays into a few others' texts stays
    that owner's. With `max_repositories` one in more repositories is shared too.
    """
    # Counted in steps, so that a secret that a third of all rows hold is summed where it is read.
    per_owner = each.select("secret", "owner", "text_key").distinct().groupBy("secret", "owner").agg(F.count(F.lit(1)).alias("texts"))
    per = per_owner.groupBy("secret").agg(F.count(F.lit(1)).alias("owners"), F.sum("texts").alias("repositories"), F.max("texts").alias("lead"))
    shared = (F.col("owners") > max_owners) & (F.col("lead") < F.lit(least_lead) * F.col("repositories"))
    if max_repositories is not None:
        shared |= F.col("repositories") > max_repositories
    return per.withColumn("shared", shared)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", max_owners: int = MAX_OWNERS, max_repositories: int | None = None, least_lead: float = LEAST_LEAD) -> DataFrame:
    """One row per row of `docs`: row_no, doc_id, text_key, base, spans, candidates, n_live, n_shared.

    `base` and `spans` are arrays of struct(start, stop, kind) in code points, end exclusive, by
    start and then kind; `spans` has the base spans and, as kind `owned`, every candidate outside
    them that `ownership` does not find shared. `candidates` tells each candidate, the base spans'
    values included: struct(start, stop, owners, repositories, shared), by start; `n_live` and
    `n_shared` count them. Repeated rows and exact copies of an owner's text are one repository.
    A null text counts as empty; null and empty owners are one owner; null and repeated ids are
    kept. Other columns are not read. `row_no` numbers the rows of `docs` in
    scan order.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row_no"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("owner"), F.col(text_col).cast("string").alias("text")).withColumn("text_key", F.xxhash64("text"))
    scanned = settle(rows.mapInArrow(_scan, f"row_no long, doc_id {kind}, text_key long, owner string, base array<struct<start:long,stop:long,kind:string>>, found array<struct<start:long,stop:long,secret:long>>"))
    each = scanned.filter(F.size("found") > 0).select("row_no", "text_key", "owner", "base", F.explode("found").alias("one")).select("row_no", "text_key", "owner", "base", "one.start", "one.stop", "one.secret")
    # A table has no partitioning, so both sides of the join are dealt anew and a hot secret can be split.
    facts = written(ownership(each, max_owners, least_lead, max_repositories), "ownership")
    judged = each.join(facts, "secret", "left")
    inside = F.exists("base", lambda b: (b["start"] < F.col("stop")) & (b["stop"] > F.col("start")))
    extra = F.when(~F.col("shared") & ~inside, F.struct("start", "stop", F.lit("owned").alias("kind")))
    told = F.array_sort(F.collect_list(F.struct("start", "stop", "owners", "repositories", "shared")))
    per_row = judged.groupBy("row_no").agg(F.collect_list(extra).alias("extra"), told.alias("candidates"), F.count_if(~F.col("shared")).alias("n_live"), F.count_if("shared").alias("n_shared"))
    empty = F.array().cast("array<struct<start:long,stop:long,kind:string>>")
    order = F.array(*[F.lit(k) for k in KINDS])
    ranked = F.transform(F.concat("base", F.coalesce("extra", empty)), lambda s: F.struct(s["start"].alias("start"), F.array_position(order, s["kind"]).alias("rank"), s["stop"].alias("stop"), s["kind"].alias("kind")))
    spans = F.transform(F.array_sort(ranked), lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind")))
    joined = scanned.select("row_no", "doc_id", "text_key", "base").join(per_row, "row_no", "left")
    nobody = F.array().cast("array<struct<start:bigint,stop:bigint,owners:bigint,repositories:bigint,shared:boolean>>")
    return joined.select("row_no", "doc_id", "text_key", "base", spans.alias("spans"), F.coalesce("candidates", nobody).alias("candidates"), F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_shared", F.lit(0)).alias("n_shared"))


def as_text(spans) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def digest(scanned: DataFrame) -> DataFrame:
    """The scan as counts per base kind, the base spans' sha256, all spans as text, and how widely the most copied candidate is held."""
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    most = lambda c: F.coalesce(F.array_max(F.transform("candidates", lambda x: x[c])), F.lit(0)).alias(f"most_{c}")
    return scanned.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(as_text("base").cast("binary"), 256).alias("base_sha256"), as_text("spans").alias("spans"), "n_live", "n_shared", most("owners"), most("repositories"))


def redacted(text: str | None, spans: list, mark: str = "[secret]") -> str | None:
    """The text with each stretch of overlapping spans replaced by one mark."""
    if not text or not spans:
        return text
    out, at = [], 0
    end = -1
    for span in spans:
        start, stop = span["start"], span["stop"]
        if start >= end:
            if end >= 0:
                at = end
            out.append(text[at:start])
            out.append(mark)
            end = stop
        else:
            end = max(end, stop)
    out.append(text[end:])
    return "".join(out)


def without_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", **options) -> DataFrame:
    """All rows and columns of `docs`, every found span of the text replaced by a mark.

    A column `n_chars` follows the new text. Rows whose text is null stay as they are.
    """
    scanned = scan_secrets(docs, id_col, text_col, owner_col, **options).filter(F.size("spans") > 0)
    spans = settle(scanned.groupBy(F.col("doc_id").alias("span_id"), F.col("text_key").alias("span_key")).agg(F.max("spans").alias("spans")))
    text = F.col(text_col).cast("string")

    @F.pandas_udf("string")
    def redact(text: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([None if f is None else redacted(t, list(f)) for t, f in zip(text, found, strict=True)], dtype=object)

    taken = [c for c in docs.columns if c in spans.columns]
    if taken:  # a column of the caller's has the name of one used here
        spans = spans.withColumnsRenamed({c: f"{c}_{uuid.uuid4().hex}" for c in spans.columns})
    span_id, span_key, found = spans.columns
    same = F.col(id_col).eqNullSafe(F.col(span_id)) & (F.xxhash64(text) == F.col(span_key))
    joined = docs.join(spans, same, "left")
    # Texts without a secret stay in the JVM.
    marked = F.coalesce(redact(F.when(F.col(found).isNotNull(), text), F.col(found)), F.col(text_col))
    joined = joined.withColumn(text_col, marked)
    if "n_chars" in docs.columns:
        joined = joined.withColumn("n_chars", F.when(F.col(found).isNotNull(), F.length(text_col).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return joined.select(*docs.columns)
