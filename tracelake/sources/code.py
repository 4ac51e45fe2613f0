"""Facts of C sources: definitions, bodies, calls, parameters, variables, macros and control flow.

Everything is regular expressions over comment-free text, except matching braces, which a small
helper does inside an Arrow task.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.functions.expressions import NAME, evaluated, value_of
from tracelake.functions.text import call_names, without_comments, without_comments_and_strings
from tracelake.operators.graph import checkpointed
from tracelake.sources.flow import top_level_parts

HEAD = re.compile(r"^[ \t]*((?:[A-Za-z_][\w]*[\s\*]+)+)([A-Za-z_]\w*)\s*\(", re.M)
NO_FUNCTION = {"if", "for", "while", "switch", "return", "else", "do", "sizeof"}


def _blanked(text: str) -> str:
    """The text with comments and literals blanked out, every offset kept."""
    blank = lambda m: re.sub(r"[^\n]", " ", m[0])
    return re.sub(r"/\*.*?\*/|//[^\n]*|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'", blank, text, flags=re.S)


def _closed(text: str, at: int, pair: str) -> int | None:
    """The place of the bracket that closes one opened before `at`; None where none does."""
    depth = 1
    for m in re.compile(f"[{re.escape(pair)}]").finditer(text, at):
        depth += 1 if m[0] == pair[0] else -1
        if depth == 0:
            return m.start()
    return None


def _definitions(text: str):
    """(name, return type, parameters, body, static) of each function definition; parameters may hold brackets of any depth."""
    bare = _blanked(text)
    for m in HEAD.finditer(bare):
        if m[2] in NO_FUNCTION or m[1].split()[-1] in NO_FUNCTION:
            continue
        end = _closed(bare, m.end(), "()")
        opened = re.compile(r"\s*\{").match(bare, end + 1) if end is not None else None
        if opened is None or re.search(r"[;{}]", bare[m.end() : end]):
            continue
        at = _closed(bare, opened.end(), "{}")
        words = m[1].split()
        yield m[2], " ".join(w for w in words if w not in ("static", "inline", "extern")), " ".join(bare[m.end() : end].split()), text[opened.end() : at if at is not None else opened.end()], "static" in words


def _define(batches):
    names = ["path", "ordinal", "name", "returns", "parameters", "body", "is_static"]
    types = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_()]
    for batch in batches:
        rows = [(p, k, *d) for p, t in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist(), strict=True) for k, d in enumerate(_definitions(t or ""))]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


def functions(files: DataFrame) -> DataFrame:
    """Function definitions of files (path, text): path, ordinal, name, returns, parameters, body, is_static."""
    return files.select("path", "text").mapInArrow(_define, "path string, ordinal int, name string, returns string, parameters string, body string, is_static boolean")


DIRECTIVE = re.compile(r"^[ \t]*#[ \t]*(ifdef|ifndef|if|elif|else|endif|define|undef)\b[ \t]*(.*?)[ \t]*$")


def _holds(text: str, known: dict[str, str]) -> bool:
    """Whether an #if expression is true; `defined` and names are put in to a fixpoint, what stays unknown is 0."""
    text = re.sub(r"\bdefined\s*(?:\(\s*(\w+)\s*\)|(\w+))", lambda m: str(int((m[1] or m[2]) in known)), re.sub(r"/\*.*?\*/|//.*", " ", text))
    for _ in range(len(known) + 1):
        put = NAME.sub(lambda m: f"({known[m[0]] or 0})" if m[0] in known else "0", text)
        if put == text or len(put) > 10_000:
            break
        text = put
    return bool(value_of(NAME.sub("0", text)) or 0)


def _conditioned(text: str, defines: dict[str, str]) -> str:
    """The lines that the preprocessor keeps; those it leaves out, and its directives, become empty lines."""
    known, stack, out = dict(defines), [], []  # stack: (this branch is kept, one was kept before, the outer one is kept)
    for line in re.sub(r"\\\n", " ", text).split("\n"):
        m, live = DIRECTIVE.match(line), all(s[0] for s in stack)
        word, rest = (m[1], m[2]) if m else ("", "")
        if word in ("if", "ifdef", "ifndef"):
            name = rest.split(" ")[0].split("(")[0]
            kept = live and (_holds(rest, known) if word == "if" else (name in known) == (word == "ifdef"))
            stack.append([kept, kept])
        elif word in ("elif", "else") and stack:
            outer = all(s[0] for s in stack[:-1])
            kept = outer and not stack[-1][1] and (word == "else" or _holds(rest, known))
            stack[-1] = [kept, stack[-1][1] or kept]
        elif word == "endif" and stack:
            stack.pop()
        elif live and word == "define" and (d := re.match(r"(\w+)(?!\()\s*(.*)$", rest)):
            known[d[1]] = d[2]
        elif live and word == "undef":
            known.pop(rest.strip(), None)
        out.append(line if live and (m is None or word == "define") else "")
    return "\n".join(out)


def conditioned(files: DataFrame, defines: dict[str, str] | None = None) -> DataFrame:
    """path, text of files with the branches of conditional compilation that the given and their own definitions leave.

    Conditions are whole-number expressions with `defined`; unknown names count as 0, as in C. Lines keep
    their places. Includes are not followed, so what a header defines has to be given.
    """
    given = dict(defines or {})

    def run(batches):
        for batch in batches:
            texts = [None if t is None else _conditioned(t, given) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(texts, pa.string())], names=["path", "text"])

    return files.select("path", "text").mapInArrow(run, "path string, text string")


def first_definitions(found: DataFrame) -> DataFrame:
    """Of each name the first definition by path and place, and how many there are."""
    best = found.groupBy("name").agg(F.min_by(F.struct("path", "ordinal", "returns", "parameters", "body", "is_static"), F.struct("path", "ordinal")).alias("b"), F.count(F.lit(1)).alias("definitions"))
    return best.select("name", "b.*", "definitions")


def call_edges(found: DataFrame) -> DataFrame:
    """src, dst, ordinal: calls of each function in order, each callee once, itself left out."""
    return found.select(F.col("name").alias("src"), F.posexplode(call_names("body")).alias("ordinal", "dst")).filter("src <> dst")


def parameters(found: DataFrame) -> DataFrame:
    """function, ordinal, name, type, direction: INOUT for pointers and arrays that are not const and for structs, else IN.

    Parameters are cut at commas outside (), [] and <>; one without a name is named by its place.
    """
    each = found.select(F.col("name").alias("function"), F.posexplode(top_level_parts("parameters", brackets="()[]<>")).alias("ordinal", "p")).filter("p <> 'void'")
    callback = F.regexp_extract("p", r"\(\s*\*\s*([A-Za-z_]\w*)\s*\)", 1)
    name = F.when(callback != "", callback).otherwise(F.regexp_extract("p", r"([A-Za-z_]\w*)\s*(?:\[[^\]]*\])*$", 1))
    lone = ~F.col("p").rlike(r"[\s\*]") | F.lower(name).isin("const", "volatile", "restrict", "struct", "union", "enum")
    symbol = F.when(lone | (name == ""), F.concat(F.lit("__arg"), (F.col("ordinal") + 1).cast("string"))).otherwise(name)
    indirect = F.col("p").rlike(r"[\*\[]")
    direction = F.when(indirect & ~F.col("p").rlike(r"\bconst\b"), F.lit("INOUT")).when(F.col("p").rlike(r"\b(struct|union)\b") & ~F.col("p").rlike(r"\bconst\b"), F.lit("INOUT")).otherwise(F.lit("IN"))
    kind = F.when(callback != "", F.regexp_replace("p", r"\(\s*\*\s*[A-Za-z_]\w*\s*\)", "(*)")).otherwise(F.regexp_replace("p", r"[A-Za-z_]\w*\s*(?:\[[^\]]*\])*$", ""))
    return each.select("function", "ordinal", symbol.alias("name"), F.trim(kind).alias("type"), direction.alias("direction"))


def outputs(found: DataFrame) -> DataFrame:
    """function, name, type of non-void results."""
    return found.filter("trim(returns) <> 'void' and returns <> ''").select(F.col("name").alias("function"), F.lit("return").alias("name"), F.col("returns").alias("type"))


def global_variables(files: DataFrame) -> DataFrame:
    """path, name, type, is_static, init of declarations at line start outside functions."""
    p = r"(?m)^((?:static\s+|const\s+|volatile\s+|extern\s+|unsigned\s+|signed\s+)*[A-Za-z_]\w*[\s\*]+)([A-Za-z_]\w*)\s*(?:\[[^\]]*\])*\s*(?:=\s*([^;]+))?;"
    lines = files.select("path", F.explode(F.regexp_extract_all(without_comments("text"), F.lit(f"(?m)({p[4:]})"), F.lit(1))).alias("d"))
    g = lambda k: F.trim(F.regexp_extract("d", p, k))
    kind = F.trim(F.regexp_replace(g(1), r"\b(static|extern)\b", ""))
    return lines.select("path", g(2).alias("name"), kind.alias("type"), g(1).rlike(r"\bstatic\b").alias("is_static"), g(3).alias("init")).filter(~F.col("type").rlike(r"^(return|typedef|goto|else)\b"))


def macros(files: DataFrame) -> DataFrame:
    """path, name, value of object-like and function-like macros."""
    p = r"(?m)^[ \t]*#[ \t]*define[ \t]+([A-Za-z_]\w*(?:\([^)]*\))?)[ \t]*([^\n]*)"
    each = files.select("path", F.explode(F.regexp_extract_all(without_comments("text"), F.lit(f"(?m)({p[4:]})"), F.lit(1))).alias("d"))
    return each.select("path", F.regexp_extract("d", p, 1).alias("name"), F.trim(F.regexp_extract("d", p, 2)).alias("value"))


def variable_usage(found: DataFrame, names: DataFrame) -> DataFrame:
    """function, name, reads, writes of known variables (name) in function bodies, counted by line.

    The identifiers of a line meet the names in an equality join, so no line is tried against every
    name.
    """
    lines = found.select(F.col("name").alias("function"), F.explode(F.split(without_comments_and_strings("body"), "[;\n{}]")).alias("line"))
    words = lines.select("function", "line", F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit(r"\b([A-Za-z_]\w*)\b"), F.lit(1)))).alias("name"))
    hit = words.join(names.select("name").distinct(), "name", "left_semi")
    target = F.concat(F.lit(r"\b"), F.col("name"), F.lit(r"\b(?:\s*(?:\[[^\]]*\]|\.\w+|->\w+))*\s*"))
    plain = F.regexp_like("line", F.concat(target, F.lit(r"=(?!=)")))
    both = F.regexp_like("line", F.concat(target, F.lit(r"(?:[-+*/%&|^]=|<<=|>>=|\+\+|--)"))) | F.regexp_like("line", F.concat(F.lit(r"(?:\+\+|--)\s*"), F.col("name"), F.lit(r"\b")))
    seen = F.size(F.regexp_extract_all("line", F.concat(F.lit(r"(\b"), F.col("name"), F.lit(r"\b)")), F.lit(1)))
    out = hit.select("function", "name", (plain | both).alias("w"), (both | (seen > F.when(plain, 1).otherwise(0))).alias("r"))
    return out.groupBy("function", "name").agg(F.count_if("r").alias("reads"), F.count_if("w").alias("writes"))


def flow_nodes(found: DataFrame) -> DataFrame:
    """function, ordinal, type, condition of control statements of bodies in order: if, switch, loop, return."""
    p = r"\b(else\s+if|if|switch|for|while|return)\b\s*(\((?:[^()]|\([^()]*\))*\)|[^;{}]*)"
    each = found.select(F.col("name").alias("function"), F.posexplode(F.regexp_extract_all(without_comments_and_strings("body"), F.lit(f"({p})"), F.lit(1))).alias("ordinal", "s"))
    word = F.regexp_extract("s", p, 1)
    kind = F.when(word.isin("for", "while"), F.lit("loop")).when(word.rlike("if$"), F.lit("if")).otherwise(word)
    return each.select("function", "ordinal", kind.alias("type"), F.trim(F.regexp_replace(F.regexp_extract("s", p, 2), r"^\(|\)$", "")).alias("condition"))


def comment_facts(files: DataFrame) -> DataFrame:
    """path, tag, value of comment tags @asil, @req, @related and the like."""
    p = r"[@\\](asil|req|requirement|related|brief|safety)\b[ \t:]*([^\n*]*)"
    each = files.select("path", F.explode(F.regexp_extract_all("text", F.lit(f"(?i)({p})"), F.lit(1))).alias("t"))
    return each.select("path", F.lower(F.regexp_extract("t", f"(?i){p}", 1)).alias("tag"), F.trim(F.regexp_extract("t", f"(?i){p}", 2)).alias("value"))


def macro_calls(found: DataFrame, known_macros: DataFrame, most: int = 50) -> DataFrame:
    """src, dst, ordinal: functions that a macro used in a body calls; `known_macros` is (name, value)."""
    from pyspark.sql import Window

    bodies = known_macros.select(F.regexp_extract("name", r"^(\w+)", 1).alias("macro"), F.explode(call_names("value")).alias("dst")).distinct()
    words = F.array_distinct(F.regexp_extract_all(without_comments_and_strings("body"), F.lit(r"\b([A-Za-z_]\w*)\b"), F.lit(1)))
    uses = found.select(F.col("name").alias("src"), F.posexplode(words).alias("place", "macro"))
    edges = uses.join(bodies, "macro").filter("src <> dst").groupBy("src", "dst").agg(F.min("place").alias("place"))
    placed = edges.withColumn("ordinal", F.row_number().over(Window.partitionBy("src").orderBy("place", "dst")) - 1)
    return placed.filter(F.col("ordinal") < most).select("src", "dst", "ordinal")


def pointer_calls(found: DataFrame, known: DataFrame) -> DataFrame:
    """src, dst: known functions (name) whose address a body stores in a name that it then calls."""
    pair = r"([A-Za-z_]\w*)\s*=\s*&\s*([A-Za-z_]\w*)\s*;"
    body = without_comments_and_strings("body")
    stored = found.select(F.col("name").alias("src"), call_names("body").alias("calls"), F.explode(F.regexp_extract_all(body, F.lit(f"({pair})"), F.lit(1))).alias("p"))
    stored = stored.select("src", "calls", F.regexp_extract("p", pair, 1).alias("alias"), F.regexp_extract("p", pair, 2).alias("dst"))
    return stored.filter(F.array_contains("calls", F.col("alias"))).join(known.select(F.col("name").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst").distinct()


def constants(known_macros: DataFrame) -> DataFrame:
    """name, value (long), text of object-like macros (name, value; of a repeated name the least value text counts).

    Values are whole-number expressions of C. Names in them are put in as soon as they are known: each
    round takes only what the last one found, until it found nothing, so chains may have any length. What
    cannot be evaluated (unknown names, cycles, other text) has a null value, and comes back as text with
    the known names put in.
    """
    macro = known_macros.filter(~F.col("name").contains("(")).groupBy("name").agg(F.coalesce(F.min("value"), F.lit("")).alias("body"))
    names = F.array_distinct(F.regexp_extract_all("body", F.lit(r"((?<![\w.])[A-Za-z_]\w*)"), F.lit(1)))
    nobody = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))
    waiting = checkpointed(macro.select("name", "body", names.alias("needs"), nobody.alias("env")))
    done = None
    while True:
        ready = F.size("needs") == F.size("env")
        found = checkpointed(waiting.filter(ready).select("name", evaluated("body", "env").alias("e")).select("name", "e.value", "e.text"))
        done = found if done is None else done.unionByName(found)
        news = found.filter("value is not null").select(F.col("name").alias("need"), "value")
        if news.isEmpty():
            break
        # Known values go to the macros that wait for them.
        refs = waiting.filter(~ready).select("name", F.explode("needs").alias("need")).join(news, "need").groupBy("name").agg(F.map_from_entries(F.collect_list(F.struct("need", "value"))).alias("more"))
        waiting = checkpointed(waiting.filter(~ready).join(refs, "name", "left").select("name", "body", "needs", F.when(F.col("more").isNull(), F.col("env")).otherwise(F.map_concat("env", "more")).alias("env")))
    rest = waiting.filter(F.size("needs") != F.size("env")).select("name", evaluated("body", "env").alias("e")).select("name", F.lit(None).cast("long").alias("value"), "e.text")
    return done.unionByName(rest)


def fallback_calls(found: DataFrame, files: DataFrame, edges: DataFrame, reach: int = 2500, most: int = 50) -> DataFrame:
    """src, dst, ordinal: calls of functions (path, name, body) that have no edge (src) yet.

    They are read from the body; where that is empty, from `reach` characters on both sides of the first
    mention of the name in its file (path, text). Only known functions count, each once, direct calls
    before those through a pointer, and the first `most`.
    """
    from pyspark.sql import Window

    bare = found.join(edges.select(F.col("src").alias("name")).distinct(), "name", "left_anti").select("path", "name", F.nullif(F.trim("body"), F.lit("")).alias("body"))
    empty = bare.filter("body is null").join(files.select("path", "text"), "path").withColumn("at", F.regexp_instr("text", F.concat(F.lit(r"\b"), F.col("name"), F.lit(r"\b")))).filter("at > 0")
    left = F.greatest(F.lit(1), F.col("at") - reach)
    around = empty.select("name", F.substring("text", left, F.col("at") - left + F.length("name") + reach).alias("body"))
    lines = F.regexp_replace(without_comments_and_strings("body"), r"(?m)^[ \t]*#[^\n]*", "")
    direct = F.regexp_extract_all(lines, F.lit(r"\b([A-Za-z_]\w*)\s*\("), F.lit(1))
    through = F.regexp_extract_all(lines, F.lit(r"\(\s*\*\s*([A-Za-z_]\w*)\s*\)\s*\("), F.lit(1))
    called = bare.filter("body is not null").select("name", "body").unionByName(around).select(F.col("name").alias("src"), F.posexplode(F.array_distinct(F.concat(direct, through))).alias("place", "dst"))
    known = called.filter((F.col("src") != F.col("dst")) & ~F.lower("dst").isin(*NO_FUNCTION)).join(found.select(F.col("name").alias("dst")).distinct(), "dst", "left_semi")
    first = known.groupBy("src", "dst").agg(F.min("place").alias("place"))
    placed = first.withColumn("ordinal", F.row_number().over(Window.partitionBy("src").orderBy("place")) - 1)
    return placed.filter(F.col("ordinal") < most).select("src", "dst", "ordinal")
