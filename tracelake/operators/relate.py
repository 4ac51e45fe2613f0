"""Traceability joins, tiered enrichment and keyed diffs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions import text


def coverage_matrix(functions: DataFrame, coverage: DataFrame, requirements: DataFrame) -> DataFrame:
    """functions (name) with coverage (name, statement_rate, branch_rate) and their requirements (req_id, name).

    Names are compared in lower case. One row a function: covered tells a statement rate over 0,
    requirements are sorted. Both lookups are grouped by name first, so no side multiplies rows.
    """
    low = lambda df: df.withColumn("key", F.lower("name"))
    rates = low(coverage).groupBy("key").agg(F.max("statement_rate").alias("statement_rate"), F.max("branch_rate").alias("branch_rate"))
    reqs = low(requirements).groupBy("key").agg(F.sort_array(F.collect_set("req_id")).alias("requirements"))
    out = low(functions).join(rates, "key", "left").join(reqs, "key", "left").drop("key")
    return out.withColumn("requirements", F.coalesce("requirements", F.array().cast("array<string>"))).withColumn("covered", F.coalesce(F.col("statement_rate") > 0, F.lit(False)))


def coverage_summary(matrix: DataFrame) -> DataFrame:
    """One row: functions, covered, traced, coverage_pct and trace_pct."""
    out = matrix.agg(F.count(F.lit(1)).alias("functions"), F.count_if("covered").alias("covered"), F.count_if(F.size("requirements") > 0).alias("traced"))
    pct = lambda c: F.when(F.col("functions") > 0, F.bround(100.0 * F.col(c) / F.col("functions"), 1)).otherwise(F.lit(0.0))
    return out.withColumn("coverage_pct", pct("covered")).withColumn("trace_pct", pct("traced"))


def trace_tests(direct: DataFrame, designs: DataFrame, indirect: DataFrame) -> DataFrame:
    """Test rows of requirements: (req_id, testcase, source, result, trace_type).

    `direct` (req_id, testcase, source, result) links at once; `indirect` (component, testcase,
    source, result) links over `designs` (req_id, component). Of equal (req_id, testcase, source)
    the direct row stays.
    """
    key = lambda df: df.withColumn("req_id", text.requirement_key("req_id"))
    one = key(direct).select("req_id", "testcase", "source", "result", F.lit("direct").alias("trace_type"), F.lit(0).alias("k"))
    two = key(designs).distinct().join(indirect, "component").select("req_id", "testcase", "source", "result", F.lit("indirect").alias("trace_type"), F.lit(1).alias("k"))
    keys = ["req_id", "testcase", "source"]
    best = one.unionByName(two).groupBy(*keys).agg(F.min(F.struct("k", "trace_type", "result")).alias("b"))
    return best.select(*keys, "b.result", "b.trace_type")


def trace_matrix(requirements: DataFrame, tests: DataFrame) -> DataFrame:
    """One row a requirement (req_id): tests, passed, and how it is linked: direct, indirect, mixed or none."""
    passed = F.count_if(text.result_class("result") == "pass")
    n = lambda kind: F.count_if(F.col("trace_type") == kind)
    per = tests.groupBy("req_id").agg(F.count(F.lit(1)).alias("tests"), passed.alias("passed"), n("direct").alias("n_direct"), n("indirect").alias("n_indirect"))
    spine = requirements.select(text.requirement_key("req_id").alias("req_id")).distinct()
    both = (F.col("n_direct") > 0) & (F.col("n_indirect") > 0)
    kind = F.when(both, F.lit("mixed")).when(F.col("n_direct") > 0, F.lit("direct")).when(F.col("n_indirect") > 0, F.lit("indirect")).otherwise(F.lit("none"))
    return spine.join(per, "req_id", "left").select("req_id", F.coalesce("tests", F.lit(0)).alias("tests"), F.coalesce("passed", F.lit(0)).alias("passed"), kind.alias("confidence"))


def mapping_state(items: DataFrame, pairs: DataFrame) -> DataFrame:
    """Requirement ids as mapped, missing (no pair) or extra (a pair without an item)."""
    have = items.select(text.requirement_key("req_id").alias("req_id")).distinct().withColumn("item", F.lit(True))
    told = pairs.select(text.requirement_key("req_id").alias("req_id")).distinct().withColumn("pair", F.lit(True))
    state = F.when(F.col("item").isNull(), F.lit("extra")).when(F.col("pair").isNull(), F.lit("missing")).otherwise(F.lit("mapped"))
    return have.join(told, "req_id", "full_outer").select("req_id", state.alias("state"))


def test_map(tests: DataFrame, name: str, description: str) -> DataFrame:
    """Requirement ids that test names and descriptions carry: req_id, testcase, each pair once."""
    ids = text.test_ids(F.concat_ws(" ", F.col(name), F.col(description)))
    return tests.select(F.explode(ids).alias("req_id"), F.col(name).alias("testcase")).distinct()


def requirement_functions(requirements: DataFrame, functions: DataFrame, designs: DataFrame) -> DataFrame:
    """(req_id, name, via): ids in a function's `related`; functions without any fall back to their component's design row."""
    ids = functions.select("name", "component", F.explode_outer(text.document_ids("related")).alias("req_id"))
    direct = ids.filter("req_id is not null").select(text.requirement_key("req_id").alias("req_id"), "name", F.lit("related").alias("via"))
    lonely = functions.filter(F.size(text.document_ids("related")) == 0).select("name", "component")
    known = requirements.select(text.requirement_key("req_id").alias("req_id")).distinct()
    # However many rows name a component's requirement, a function meets it once.
    told = designs.select("component", text.requirement_key("req_id").alias("req_id")).distinct().join(known, "req_id", "left_semi")
    design = lonely.join(told, "component").select("req_id", "name", F.lit("design").alias("via"))
    return direct.join(known, "req_id", "left_semi").unionByName(design).distinct()


def fill_blank(rows: DataFrame, key: str, source: DataFrame, source_key: str, columns: list[str], label: str) -> DataFrame:
    """Blank columns taken from a map on the lower-cased key; `<column>_source` says where a value is from."""
    picked = source.groupBy(F.lower(source_key).alias("fill_key")).agg(*[F.min(F.when(text.meaningful(c), F.col(c))).alias(f"fill_{c}") for c in columns])
    joined = rows.join(picked, F.lower(rows[key]) == F.col("fill_key"), "left")
    out = joined
    for c in columns:
        blank = ~text.meaningful(c) & F.col(f"fill_{c}").isNotNull()
        out = out.withColumn(f"{c}_source", F.when(blank, F.lit(label)).otherwise(F.lit("own"))).withColumn(c, F.when(blank, F.col(f"fill_{c}")).otherwise(F.col(c)))
    return out.drop("fill_key", *[f"fill_{c}" for c in columns])


def best_containment(rows: DataFrame, name: str, entries: DataFrame, entry: str, least: float = 0.5) -> DataFrame:
    """Each row's best entry: equal names first (ratio 1), else the one that contains it or is contained, by the ratio of lengths.

    Two tiers: an equality join, and for the rest a join on three-character pieces of the name. A
    name stands in another only with all its pieces, so it is looked up by the one that the fewest
    names of the other side have.
    Names under three characters only match as a whole. Ties go to the first entry by name.
    """
    r = rows.select(F.col(name).alias("name")).distinct().withColumn("a", F.lower("name"))
    e = entries.select(F.col(entry).alias("entry")).distinct().withColumn("b", F.lower("entry"))
    exact = r.join(e, F.col("a") == F.col("b")).groupBy("name").agg(F.min("entry").alias("entry")).withColumn("ratio", F.lit(1.0))
    rest = r.join(exact.select("name"), "name", "left_anti")
    pieces = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c) - 2)), lambda i: F.substring(F.col(c), i, 3)))
    of_rows = rest.filter(F.length("a") >= 3).select("name", "a", F.explode(pieces("a")).alias("p"))
    of_entries = e.filter(F.length("b") >= 3).select("entry", "b", F.explode(pieces("b")).alias("p"))

    def rarest(own: DataFrame, keys: list[str], other: DataFrame) -> DataFrame:
        seen = other.groupBy("p").agg(F.count(F.lit(1)).alias("n"))
        # A piece that the other side lacks says that no name there holds this one.
        return own.join(seen, "p", "left").groupBy(*keys).agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "p")).alias("r")).filter("r.n > 0").select(*keys, "r.p")

    one = of_rows.join(rarest(of_entries, ["entry", "b"], of_rows), "p")
    two = rarest(of_rows, ["name", "a"], of_entries).join(of_entries, "p")
    met = one.unionByName(two).filter(F.col("a").contains(F.col("b")) | F.col("b").contains(F.col("a")))
    ratio = F.least(F.length("a"), F.length("b")) / F.greatest(F.length("a"), F.length("b"))
    scored = met.select("name", "entry", ratio.alias("ratio")).filter(F.col("ratio") >= least)
    best = scored.groupBy("name").agg(F.min(F.struct((-F.col("ratio")).alias("m"), "entry")).alias("b")).select("name", "b.entry", (-F.col("b.m")).alias("ratio"))
    return exact.unionByName(best)


def keyed_diff(old: DataFrame, new: DataFrame, keys: list[str], fields: list[str], only_changed: bool = True) -> DataFrame:
    """One row a key: keys, state (added, removed, modified, same) and the names of the changed fields.

    Keys are compared null-safe and must be unique on each side.
    """
    a = old.select(*[F.col(k).alias(f"a_{k}") for k in keys], *[F.col(f).alias(f"a_f_{f}") for f in fields], F.lit(True).alias("in_old"))
    b = new.select(*[F.col(k).alias(f"b_{k}") for k in keys], *[F.col(f).alias(f"b_f_{f}") for f in fields], F.lit(True).alias("in_new"))
    on = [F.col(f"a_{k}").eqNullSafe(F.col(f"b_{k}")) for k in keys]
    joined = a.join(b, on, "full_outer")
    changed = F.array_compact(F.array(*[F.when(~F.col(f"a_f_{f}").eqNullSafe(F.col(f"b_f_{f}")), F.lit(f)) for f in fields]))
    state = F.when(F.col("in_old").isNull(), F.lit("added")).when(F.col("in_new").isNull(), F.lit("removed")).when(F.size(changed) > 0, F.lit("modified")).otherwise(F.lit("same"))
    out = joined.select(*[F.coalesce(f"b_{k}", f"a_{k}").alias(k) for k in keys], state.alias("state"), F.when(state == "modified", F.array_join(changed, ",")).otherwise(F.lit("")).alias("changed"))
    return out.filter("state <> 'same'") if only_changed else out


def field_diff(old: DataFrame, new: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """One row a changed field of keys in both versions: keys, field, old, new as text, normalised by trimming."""
    a = old.select(*keys, *[text.trimmed(f).alias(f"a_{f}") for f in fields])
    b = new.select(*keys, *[text.trimmed(f).alias(f"b_{f}") for f in fields])
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"a_{f}").alias("old"), F.col(f"b_{f}").alias("new")) for f in fields])
    return a.join(b, keys).select(*keys, F.inline(rows)).filter("old <> new")


def cell_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Differing cells of two sheets (sheet, row, col, value): a missing row gives one row at column 0."""
    keys = ["sheet", "row"]
    rows_of = lambda df, name: df.select(*keys).distinct().withColumn(name, F.lit(True))
    gone = rows_of(old, "a").join(rows_of(new, "b"), keys, "full_outer").filter("a is null or b is null")
    whole = gone.select(*keys, F.lit(0).alias("col"), F.when(F.col("a").isNull(), F.lit("added_row")).otherwise(F.lit("removed_row")).alias("state"), F.lit(None).cast("string").alias("old"), F.lit(None).cast("string").alias("new"))
    cells = old.withColumnRenamed("value", "old").join(new.withColumnRenamed("value", "new"), ["sheet", "row", "col"], "full_outer")
    cells = cells.join(gone.select(*keys), keys, "left_anti").withColumns({c: F.coalesce(c, F.lit("")) for c in ("old", "new")}).filter("old <> new")
    return whole.unionByName(cells.select("sheet", "row", "col", F.lit("changed").alias("state"), "old", "new"))


def function_changes(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Functions (keys, nloc, ccn) added, removed or modified with score abs(dnloc) + 10 * abs(dccn)."""
    a = old.select(*keys, F.col("nloc").alias("a_nloc"), F.col("ccn").alias("a_ccn"), F.lit(True).alias("a"))
    b = new.select(*keys, F.col("nloc").alias("b_nloc"), F.col("ccn").alias("b_ccn"), F.lit(True).alias("b"))
    score = F.abs(F.col("b_nloc") - F.col("a_nloc")) + 10 * F.abs(F.col("b_ccn") - F.col("a_ccn"))
    state = F.when(F.col("a").isNull(), F.lit("added")).when(F.col("b").isNull(), F.lit("removed")).otherwise(F.lit("modified"))
    return a.join(b, keys, "full_outer").select(*keys, state.alias("state"), F.coalesce(score, F.lit(0)).alias("score")).filter("state <> 'modified' or score > 0")


def call_agreement(expected: DataFrame, documented: DataFrame, known: DataFrame) -> DataFrame:
    """For each function whether its documented callees are those of the code: src, n_expected, n_documented, n_both, same.

    Both sides are (src, dst); names outside `known` (name) are left out.
    """
    names = known.select(F.col("name").alias("dst")).distinct()
    a = expected.select("src", "dst").distinct().join(names, "dst", "left_semi").withColumn("e", F.lit(1))
    b = documented.select("src", "dst").distinct().join(names, "dst", "left_semi").withColumn("d", F.lit(1))
    out = a.join(b, ["src", "dst"], "full_outer").groupBy("src").agg(F.count("e").alias("n_expected"), F.count("d").alias("n_documented"), F.count(F.col("e") + F.col("d")).alias("n_both"))
    return out.withColumn("same", (F.col("n_expected") == F.col("n_both")) & (F.col("n_documented") == F.col("n_both")))


def count_diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Keys whose row counts differ between two versions; a missing side counts 0."""
    a, b = old.groupBy(key).agg(F.count(F.lit(1)).alias("n_old")), new.groupBy(key).agg(F.count(F.lit(1)).alias("n_new"))
    return a.join(b, key, "full_outer").fillna(0, ["n_old", "n_new"]).filter("n_old <> n_new")


def integration_flows(functions: DataFrame, edges: DataFrame, callees: int = 4, most: int = 120) -> DataFrame:
    """Functions (name, module) with calls into other modules: name, module, chain of the first callees by ordinal."""
    src = functions.select(F.col("name").alias("src"), F.col("module").alias("module"))
    dst = functions.select(F.col("name").alias("dst"), F.col("module").alias("dst_module"))
    cross = edges.join(src, "src").join(dst, "dst").filter("module <> dst_module")
    w = Window.partitionBy("src").orderBy("ordinal", "dst")
    first = cross.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= callees)
    chains = first.groupBy("src", "module").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "dst"))), lambda x: x["dst"].cast("string")), ">").alias("chain"))
    return chains.withColumnRenamed("src", "name").orderBy("name").limit(most)


def globals_usage(usage: DataFrame) -> DataFrame:
    """Functions that use each global (name, function): name, n, functions sorted."""
    return usage.groupBy("name").agg(F.count_distinct("function").alias("n"), F.sort_array(F.collect_set("function")).alias("functions"))


def line_diff(pairs: DataFrame, old: str, new: str) -> DataFrame:
    """Line diffs of text pairs (key, old, new): key, added, removed, ratio (twice the matching lines over all lines).

    Each pair is compared by itself inside an Arrow task; the pairs are what Spark deals out.
    """
    from difflib import SequenceMatcher

    import pyarrow as pa

    def run(batches):
        for batch in batches:
            out = []
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                x, y = (a or "").splitlines(), (b or "").splitlines()
                match = SequenceMatcher(None, x, y, autojunk=False)
                kept = sum(m.size for m in match.get_matching_blocks())
                out.append((len(y) - kept, len(x) - kept, match.ratio()))
            yield pa.RecordBatch.from_arrays([batch.column("key"), *[pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.float64()))]], names=["key", "added", "removed", "ratio"])

    kind = pairs.schema["key"].dataType.simpleString()
    return pairs.select("key", F.col(old).cast("string").alias("a"), F.col(new).cast("string").alias("b")).mapInArrow(run, f"key {kind}, added int, removed int, ratio double")


def linked_rows(rows: DataFrame, name: str, flagged: DataFrame) -> DataFrame:
    """Rows of a document that belong to flagged functions (function)."""
    from tracelake.operators.filters import among

    return among(rows, name, flagged, "function")


def suspicious_counts(variables: DataFrame, component: str, name: str, description: str) -> DataFrame:
    """Variable rows of each component and how many look like parse errors: names REG_..., descriptions that are files."""
    odd = F.col(name).startswith("REG_") | F.lower(F.trim(description)).rlike(r"\.[ch]$")
    return variables.groupBy(component).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(odd, F.lit(False))).alias("suspicious"))


def function_requirements(functions: DataFrame, name: str, related: str) -> DataFrame:
    """(requirement, function) pairs of functions' related ids that begin with Sw, REQ, SRS or SDS."""
    return functions.select(F.explode(text.split_list(related)).alias("requirement"), F.col(name).alias("function")).filter(F.col("requirement").rlike("^(Sw|REQ|SRS|SDS)")).distinct()


def module_candidates(functions: DataFrame, name: str, file: str) -> DataFrame:
    """Best module of each function: its file's stem (0.9), else the first part of a snake or Pascal case name (0.6)."""
    stem = F.regexp_extract(file, r"([^/\\]+?)(?:\.[^./\\]*)?$", 1)
    bare = F.regexp_replace(name, r"^[sgu]\d*[sg]?_", "")
    part = F.regexp_extract(F.regexp_replace(bare, "([a-z0-9])([A-Z])", "$1_$2"), r"^([A-Za-z0-9]+)", 1)
    known = F.coalesce(stem, F.lit("")) != ""
    return functions.select(name, F.when(known, stem).otherwise(part).alias("module"), F.when(known, 0.9).otherwise(0.6).alias("confidence"))


def token_match(rows: DataFrame, name: str, related: str, entries: DataFrame, entry: str, entry_related: str, least: int = 6) -> DataFrame:
    """Each row's best entry by shared related ids (10 each) and shared name words (2 each, 6 at most): name, entry, score.

    Pairs meet on a shared id, or on words where words alone can reach `least`: a row that must
    share k of its words shares one of its rarest all but k - 1, so its most common words make no
    pairs. Ties go to the first entry by name.
    """
    words = lambda c: F.array_distinct(F.transform(text.name_words(c), lambda w: F.lower(w)))
    a = rows.select(F.col(name).alias("name"), text.split_list(related).alias("ids"), words(name).alias("words"))
    b = entries.select(F.col(entry).alias("entry"), text.split_list(entry_related).alias("ids"), words(entry).alias("words"))
    pairs = a.select("name", F.explode("ids").alias("key")).join(b.select("entry", F.explode("ids").alias("key")), "key").select("name", "entry")
    needed = max(1, -(-least // 2))
    if needed <= 3:
        theirs = b.select("entry", F.explode("words").alias("key"))
        seen = theirs.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        known = a.select("name", F.explode("words").alias("key")).distinct().join(seen, "key").groupBy("name").agg(F.array_sort(F.collect_set(F.struct("n", "key"))).alias("found"))
        rare = known.select("name", F.explode(F.slice("found", 1, F.greatest(F.lit(0), F.size("found") - (needed - 1)))).alias("f")).select("name", F.col("f.key").alias("key"))
        pairs = pairs.union(rare.join(theirs, "key").select("name", "entry"))
    all_of = lambda rows, key: rows.groupBy(key).agg(F.array_distinct(F.flatten(F.collect_set("ids"))).alias("ids"), F.array_distinct(F.flatten(F.collect_set("words"))).alias("words"))
    met = pairs.distinct().join(all_of(a, "name"), "name").join(all_of(b, "entry").withColumnsRenamed({"ids": "ids2", "words": "words2"}), "entry")
    shared = lambda c: F.size(F.array_intersect(c, f"{c}2"))
    total = met.select("name", "entry", (10 * shared("ids") + F.least(2 * shared("words"), F.lit(6))).alias("score")).filter(F.col("score") >= least)
    best = total.groupBy("name").agg(F.min(F.struct((-F.col("score")).alias("m"), "entry")).alias("b"))
    return best.select("name", F.col("b.entry").alias("entry"), (-F.col("b.m")).alias("score"))


def finished_fields(functions: DataFrame) -> DataFrame:
    """Defaults where a function's fields say nothing: asil QM, related TBD, precondition N/A, description from its name."""
    default = {"asil": F.lit("QM"), "related": F.lit("TBD"), "precondition": F.lit("N/A"), "description": F.concat(F.lit("Performs "), F.lower(F.array_join(text.name_words("name"), " ")), F.lit("."))}
    return functions.withColumns({c: F.when(text.meaningful(c), text.trimmed(c)).otherwise(v) for c, v in default.items() if c in functions.columns})


def design_sections(docs: DataFrame, keys: list[str], body: str, changed: DataFrame) -> DataFrame:
    """Sections of a design text below its `#` headings: keys, ordinal, heading, functions (named before a parenthesis), changed.

    A section is changed where one of its functions is among `changed` (name), in any case. Text
    before the first heading belongs to none.
    """
    parts = F.split(F.coalesce(F.col(body), F.lit("")), r"(?m)^#+\s+")
    each = docs.select(*keys, F.posexplode(F.slice(parts, 2, F.greatest(F.lit(1), F.size(parts)))).alias("ordinal", "part"))
    each = each.select(*keys, "ordinal", F.trim(F.regexp_extract("part", r"^([^\n]*)", 1)).alias("heading"), text.call_names(F.regexp_replace("part", r"^[^\n]*", "")).alias("functions"))
    touched = changed.select(F.lower("name").alias("name")).distinct().withColumn("touched", F.lit(True))
    named = each.select(*keys, "ordinal", F.explode("functions").alias("f")).join(touched, F.lower("f") == F.col("name")).select(*keys, "ordinal", "touched").distinct()
    return each.join(named, [*keys, "ordinal"], "left").select(*keys, "ordinal", "heading", "functions", F.coalesce("touched", F.lit(False)).alias("changed"))
