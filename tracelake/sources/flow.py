"""Statements of C text: the tree of nested control flow, and statements with their bracket depths.

One pass over the tokens of a body keeps a stack of open blocks and of headers that still wait for
their statement; what it gives are rows, so everything above it is joins on node numbers. In preorder
a node's descendants are the numbers up to `last`, and `path` names the branches that enclose it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from itertools import accumulate, pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions.text import _col

#: Levels below the top one that are kept.
MOST_DEPTH = 4
TOKEN = re.compile(r"[A-Za-z_]\w*|\d[\w.]*|\"\"|''|<<=|>>=|\+\+|--|->|&&|\|\||[-+*/%&|^<>=!]=|<<|>>|\S")
ASIDE = re.compile(r"/\*.*?\*/|//[^\n]*|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'", re.S)
DIRECTIVE = re.compile(r"^[ \t]*#(?:\\\n|[^\n])*", re.M)
#: What stands at the beginning of a statement, and the whole of it where it has no brackets inside: a sign, a header with its condition,
#: a key word, a call whose arguments set nothing.
UNIT = re.compile(
    r"\s*+(?:(?P<block>\{)|(?P<end>\})|(?P<over>;|else(?!\w))|(?P<head>if|while|switch|for)\s*+\((?:(?P<flat>[^][(){}]*+)\)(?P<open>\s*+\{)?)?|(?P<label>case|default)(?!\w)|(?P<do>do)(?!\w)"
    r"|return(?!\w)(?P<value>[^][(){};]*+);|(?P<return>return)(?!\w)|(?P<jump>break|continue|goto)(?!\w)"
    r"|(?P<call>[A-Za-z_]\w*+)\s*+\([^][(){};=+-]*+\)\s*+;|(?P<plain>[^][(){};\s][^][(){};]*+);|(?P<other>\S))"
)
HEAD, FLAT, VALUE, CALL, PLAIN = (UNIT.groupindex[g] for g in ("head", "flat", "value", "call", "plain"))
ROUND, BRACKET, STOP = re.compile(r"\((?:[^][(){}]++|\([^][(){}]*+\))*+\)"), re.compile(r"[][(){}]"), re.compile(r"[;{}(\[]")
LABEL_END, ELSE, SEMICOLON = re.compile(r"[:;}]"), re.compile(r"\s*+else(?!\w)"), re.compile(r"\s*+;")
WHILE = re.compile(rf"\s*+while(?!\w)\s*+({TOKEN.pattern})?")
#: The names before a bracket; empty for other words and numbers.
CALLED = re.compile(r"\d[\w.]*+|[A-Za-z_]\w*+(?!\s*+\()|([A-Za-z_]\w*+)")
SIGNS = re.compile(r"<<=|>>=|\+\+|--|->|&&|\|\||[-+*/%&|^<>=!]=|<<|>>|[-+*/%&|^<>=!]")
LAST_SIGNS = re.compile(r"[-+*/%&|^<>=!]+\Z")
NO_CALL = {"if", "for", "while", "switch", "return", "else", "do", "case", "default", "sizeof", "goto"}
SETS = {"=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=", "++", "--"}
STEP = dict.fromkeys("([{", 1) | dict.fromkeys(")]}", -1)


def bare_text(text: str) -> str:
    """The text without comments and preprocessor lines, literals emptied."""
    if "/" in text or '"' in text or "'" in text:
        text = ASIDE.sub(lambda m: " " if m[0].startswith("/") else m[0][0] * 2, text)
    return DIRECTIVE.sub("", text) if "#" in text else text


def _sets(text: str) -> bool:
    """Whether the last sign of a text is one that sets a value."""
    signs = LAST_SIGNS.search(text.rstrip())
    return signs is not None and SIGNS.findall(signs[0])[-1] == "="


class _Trees:
    """Nodes of bodies, numbered within their body: (parent, branch, depth, kind, text, detail, path) of each, and the last number below it.

    `ends` has the number of nodes up to the end of each body.
    """

    def __init__(self, most_depth: int):
        self.most_depth, self.nodes, self.last, self.ends = most_depth, [], [], []

    def read(self, body: str, known: set[str] | None = None) -> None:
        """Adds the nodes of a body; control without any call, return or assignment below it is left out.

        One pass over its statements. A frame is (what, node, branch, depth, path) of what is open: a block, or a header that
        waits for its statement; its node is None below the deepest level, and so is that of all inside.
        """
        text = bare_text(body).rstrip()
        size, most_depth, nodes, first = len(text), self.most_depth, self.nodes, len(self.nodes)
        used: list[bool] = []  # whether a leaf is below, or the node is one

        def close(k: int) -> tuple[int, int]:
            """Where the token that closes the bracket at `k` begins and ends; the last one where none does."""
            if flat := ROUND.match(text, k):
                return flat.end() - 1, flat.end()
            depth = 0
            for m in BRACKET.finditer(text, k):
                depth += STEP[m[0]]
                if depth == 0:
                    return m.start(), m.end()
            return [m.start() for m in TOKEN.finditer(text, k)][-1], size

        def add(frame: tuple, kind: str, text: str, detail: str = "", leaf: bool = False) -> int | None:
            """The new node's number, None below the deepest level or inside a node that is."""
            _, node, branch, depth, path = frame
            if depth > most_depth or node is None:
                return None
            nodes.append((node, branch, depth, kind, text, detail, path))
            used.append(leaf)
            if leaf:
                while node >= 0 and not used[node]:
                    used[node] = True
                    node = nodes[first + node][0]
            return len(used) - 1

        def below(frame: tuple, what: str, node: int | None, branch: str) -> tuple:
            return (what, node, branch, frame[3] + 1, () if node is None else (*frame[4], (node, branch)))

        frames: list[tuple] = [("block", -1, "", 0, ())]
        k = 0
        while k < size:
            top, unit = frames[-1], UNIT.match(text, k)
            kind, k = unit.lastgroup, unit.end()
            if kind == "call":
                name = unit[CALL]
                if name in known if known is not None else name not in NO_CALL:
                    add(top, "call", name, "", True)
            elif kind == "end":
                while frames[-1][0] != "block":
                    frames.pop()
                if len(frames) > 1:
                    frames.pop()
            elif kind == "block":
                frames.append(("block", *top[1:]))
                continue
            elif kind == "head" or kind == "flat" or kind == "open":
                word, condition = unit[HEAD], unit[FLAT]
                if condition is None:
                    opened = k - 1
                    end, k = close(opened)
                    condition = text[opened + 1 : end]
                condition = " ".join(condition.split())
                if word == "if":
                    frames.append(below(top, "if", add(top, "if", condition), "true"))
                elif word == "switch":
                    frames.append(below(top, "switch", add(top, "switch", condition), "case"))
                else:
                    parts = condition.split(";")
                    frames.append(below(top, "loop", add(top, "loop", parts[1].strip() if word == "for" and len(parts) > 1 else condition, word), "body"))
                if kind == "open":
                    frames.append(("block", *frames[-1][1:]))
                continue
            elif kind == "plain":
                found = unit[PLAIN]
                if not SETS.isdisjoint(SIGNS.findall(found)):
                    add(top, "assign", " ".join(found.split()), "", True)
            elif kind == "value":
                add(top, "return", " ".join(unit[VALUE].split()), "", True)
            elif kind == "label" and len(frames) > 1 and frames[-2][0] == "switch":
                end, word, switch = LABEL_END.search(text, k), unit["label"], frames[-2]
                node = add(switch, word, " ".join(text[k : end.start() if end else size].split()))
                frames[-1] = ("block", node, word, switch[3], (*switch[4], (node, word)))
                k = end.end() if end else size
                continue
            elif kind == "do":
                frames.append(below(top, "do", add(top, "loop", "", "do"), "body"))
                continue
            elif kind != "over":  # a statement with brackets, up to its end outside them
                start = end = unit.start(unit.lastindex)
                while (m := STOP.search(text, end)) and m[0] not in ";}" and (m[0] != "{" or _sets(text[start : m.start()])):
                    end = close(m.start())[1]
                end = m.start() if m else size
                if kind == "return":
                    add(top, "return", " ".join(text[k:end].split()), "", True)
                elif kind != "jump":
                    found = text[start:end]
                    if "(" in found:
                        for name in dict.fromkeys(CALLED.findall(found)):
                            if name and (name in known if known is not None else name not in NO_CALL):
                                add(top, "call", name, "", True)
                    if not SETS.isdisjoint(SIGNS.findall(found)):
                        add(top, "assign", " ".join(found.split()), "", True)
                k = end + 1 if m and m[0] == ";" else end
            # Headers whose statement has ended here are done, unless an else follows.
            while frames[-1][0] != "block":
                what, node, _, depth, path = frames.pop()
                if what == "if" and (m := ELSE.match(text, k)):
                    frames.append(("else", node, "false", depth, (*path[:-1], (node, "false"))))
                    k = m.end()
                    break
                if what == "do" and (m := WHILE.match(text, k)):
                    condition, k = "", m.end()
                    if m[1]:
                        end, k = close(m.start(1)) if m[1] in STEP else (m.start(1), m.end(1))
                        condition = " ".join(text[m.end(1) : end].split())
                    if node is not None:
                        nodes[first + node] = (*nodes[first + node][:4], condition, *nodes[first + node][5:])
                    k = m.end() if (m := SEMICOLON.match(text, k)) else k
        self._finish(first, used)

    def _finish(self, first: int, used: list[bool]) -> None:
        """Leaves out unused nodes of the body that begins at `first`, and tells what its nodes know of those below."""
        nodes = self.nodes
        if not all(used):
            number = dict(zip([-1, *(i for i, u in enumerate(used) if u)], range(-1, len(used))))
            nodes[first:] = [(number[n[0]], *n[1:6], tuple((number[i], b) for i, b in n[6])) for n, u in zip(nodes[first:], used, strict=True) if u]
        last = list(range(len(nodes) - first))
        for i in range(len(last) - 1, -1, -1):
            p, branch = nodes[first + i][:2]
            if p >= 0:
                if last[i] > last[p]:
                    last[p] = last[i]
                if branch == "false":
                    nodes[first + p] = (*nodes[first + p][:5], "else", nodes[first + p][6])
        self.last += last
        self.ends.append(len(nodes))

    def sizes(self) -> list[int]:
        """The number of nodes of each body."""
        return [b - a for a, b in pairwise([0, *self.ends])]

    def columns(self) -> list[Sequence]:
        """node, parent, branch, depth, kind, text, detail, last, path."""
        *plain, path = zip(*self.nodes) if self.nodes else [()] * 7
        return [[i for size in self.sizes() for i in range(size)], *plain, self.last, path]


def flow_rows(body: str, known: set[str] | None = None, most_depth: int = MOST_DEPTH) -> list[tuple]:
    """(node, parent, branch, depth, kind, text, detail, last, path) of a body; control without any call, return or assignment below it is left out."""
    trees = _Trees(most_depth)
    trees.read(body, known)
    return list(zip(*trees.columns()))


_NODE = {"node": pa.int32(), "parent": pa.int32(), "branch": pa.string(), "depth": pa.int32(), "kind": pa.string(), "text": pa.string(), "detail": pa.string(), "last": pa.int32()}
NODE = "node int, parent int, branch string, depth int, kind string, text string, detail string, last int, path array<struct<node:int,branch:string>>"
#: Bodies whose nodes are held at a time.
BODIES = 2_000


def _path_array(paths: list[list[tuple]]) -> pa.Array:
    """Paths as one array, column by column: a dictionary a step takes as long as reading the bodies."""
    steps = [s for path in paths for s in path]
    fields = [pa.field("node", pa.int32()), pa.field("branch", pa.string())]
    each = pa.StructArray.from_arrays([pa.array([s[i] for s in steps], f.type) for i, f in enumerate(fields)], fields=fields)
    return pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, paths))], pa.int32()), each)


def _read(found: DataFrame, most_depth: int, spread: int | None, schema: str, batch_of: Callable[[pa.Array, _Trees, list[pa.Array]], pa.RecordBatch]) -> DataFrame:
    """What `batch_of` makes of the names of functions, the trees of their bodies and the trees' columns."""

    def run(batches):
        for whole in batches:
            for batch in (whole.slice(i, BODIES) for i in range(0, whole.num_rows, BODIES)):
                trees = _Trees(most_depth)
                for body, known in zip(batch.column("body").to_pylist(), batch.column("calls").to_pylist(), strict=True):
                    trees.read(body or "", None if known is None else set(known))
                *plain, paths = trees.columns()
                yield batch_of(batch.column("name"), trees, [*map(pa.array, plain, _NODE.values()), _path_array(paths)])

    calls = F.col("calls") if "calls" in found.columns else F.lit(None).cast("array<string>").alias("calls")
    bodies = found.select("name", "body", calls)
    return (bodies.repartition(spread) if spread else bodies).mapInArrow(run, schema)


def flow_tree(found: DataFrame, most_depth: int = MOST_DEPTH, spread: int | None = None) -> DataFrame:
    """Nodes of the bodies of functions (name, body, and where present calls: an array of the callees that count).

    One row a node: function, node (preorder number), parent (-1 at the top), branch of the parent (true,
    false, body, case, default), depth, kind (call, if, switch, case, default, loop, return, assign), text
    (name, condition, label or statement), detail (for, while or do of a loop; else of an if that has
    one), last (its last descendant), path. Nodes deeper than `most_depth` are left out with what they hold.
    `spread` deals the bodies over so many tasks first, for inputs that come in few.
    """

    def rows(names: pa.Array, trees: _Trees, columns: list[pa.Array]) -> pa.RecordBatch:
        at = pa.array([k for k, size in enumerate(trees.sizes()) for _ in range(size)], pa.int32())
        return pa.RecordBatch.from_arrays([names.take(at), *columns], names=["function", *_NODE, "path"])

    return _read(found, most_depth, spread, f"function string, {NODE}", rows)


def flow_trees(found: DataFrame, most_depth: int = MOST_DEPTH, spread: int | None = None) -> DataFrame:
    """function, nodes: a row a body, with the nodes that `flow_tree` gives as rows in an array, in order of their numbers."""

    def whole(names: pa.Array, trees: _Trees, columns: list[pa.Array]) -> pa.RecordBatch:
        nodes = pa.StructArray.from_arrays(columns, names=[*_NODE, "path"])
        return pa.RecordBatch.from_arrays([names, pa.ListArray.from_arrays(pa.array([0, *trees.ends], pa.int32()), nodes)], names=["function", "nodes"])

    return _read(found, most_depth, spread, f"function string, nodes array<struct<{NODE}>>", whole)


def condition_text(condition: Column | str, most: int = 60) -> Column:
    """A condition as reports word it: comparisons with zero as a name or its negation, AND and OR, cut to `most` characters."""
    c = F.regexp_replace(F.trim(F.regexp_replace(_col(condition), r"\s+", " ")), r"\b([A-Za-z_]\w*)\s*!=\s*0\b", "$1")
    c = F.regexp_replace(c, r"\b([A-Za-z_]\w*)\s*==\s*0\b", "!$1")
    c = F.trim(F.regexp_replace(F.replace(F.replace(c, F.lit("&&"), F.lit(" AND ")), F.lit("||"), F.lit(" OR ")), r"\s+", " "))
    # Worded once, however often it is named.
    cut = lambda t: F.when(F.length(t) > most, F.concat(F.rtrim(F.substring(t, 1, most - 3)), F.lit("..."))).otherwise(t)
    return F.get(F.transform(F.array(c), cut), F.lit(0))


def statement_rows(text: str) -> list[tuple[int, str, str]]:
    """(brace depth, statement, what ends it) of a text: a semicolon outside brackets, a brace of a block, or the end."""
    text, rows, start, depth, inner = bare_text(text), [], 0, 0, 0
    for m in re.finditer(r"[(){}\[\];]", text):
        c = m[0]
        if c in "([":
            inner += 1
        elif c in ")]":
            inner = max(0, inner - 1)
        elif c == ";" and inner == 0:
            rows.append((depth, text[start : m.start()], c))
            start = m.end()
        elif c == "{" and (inner or re.search(r"(?<![=!<>])=\s*$", text[start : m.start()])):
            inner += 1  # the values of a declaration
        elif c == "}" and inner:
            inner -= 1
        elif c in "{}":
            rows.append((depth, text[start : m.start()], c))
            start, depth = m.end(), max(0, depth + (1 if c == "{" else -1))
    rows.append((depth, text[start:], ""))
    return [(d, " ".join(s.split()), e) for d, s, e in rows if s.strip()]


def statements(files: DataFrame) -> DataFrame:
    """path, ordinal, depth, statement, ended_by of texts (path, text), without comments, literals and preprocessor lines.

    A statement may span lines; the headers of blocks are statements too, and the values of an
    initialised declaration stay with it.
    """

    def run(batches):
        for batch in batches:
            rows = [(p, k, *s) for p, t in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist(), strict=True) for k, s in enumerate(statement_rows(t or ""))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()))], names=["path", "ordinal", "depth", "statement", "ended_by"])

    return files.select("path", "text").mapInArrow(run, "path string, ordinal int, depth int, statement string, ended_by string")


def top_level_parts(text: Column | str, separator: str = ",", brackets: str = "()[]<>{}") -> Column:
    """The trimmed parts of a text between separators that stand outside all brackets; empty parts are left out.

    Each kind of bracket has its own depth, and a closing one too many counts as none.
    """
    text = F.coalesce(_col(text), F.lit(""))
    kinds = [brackets[i : i + 2] for i in range(0, len(brackets), 2)]
    zero = F.struct(*[F.lit(0).alias(f"d{i}") for i in range(len(kinds))], F.lit(0).alias("end"), F.array().cast("array<int>").alias("cuts"))
    signs = re.escape(separator + brackets)

    def step(state: Column, c: Column) -> Column:
        at = state["end"] + F.length(c)
        depths = [F.greatest(F.lit(0), state[f"d{i}"] + F.when(c == a, 1).when(c == b, -1).otherwise(0)).alias(f"d{i}") for i, (a, b) in enumerate(kinds)]
        outside = F.lit(True)
        for i in range(len(kinds)):
            outside &= state[f"d{i}"] == 0
        cut = F.when((c == separator) & outside, F.concat(state["cuts"], F.array(at))).otherwise(state["cuts"])
        return F.struct(*depths, at.alias("end"), cut.alias("cuts"))

    # A step is a sign or all that stands between two of them.
    pieces = F.regexp_extract_all(text, F.lit(f"([^{signs}]+|[{signs}])"), F.lit(1))
    cuts = F.when(text.contains(separator), F.aggregate(pieces, zero, step)["cuts"]).otherwise(F.array().cast("array<int>"))
    starts, ends = F.concat(F.array(F.lit(0)), cuts), F.concat(cuts, F.array(F.length(text) + 1))
    parts = F.zip_with(starts, ends, lambda a, b: F.trim(F.substring(text, a + 1, b - a - 1)))
    return F.filter(parts, lambda p: p != "")


#: Words that no declaration begins with.
NO_TYPE = r"(return|typedef|goto|else|case|default|break|continue|if|for|while|switch|do|using|sizeof)"
DECLARED = r"^((?:[A-Za-z_]\w*[\s*]+)+)(\(\s*\*\s*[A-Za-z_]\w*(?:\s*\[[^\]]*\])*\s*\)\s*\(.*\)|[A-Za-z_]\w*)\s*((?:\[[^\]]*\]\s*)*)(?:=\s*(.*))?$"


def declarations(found: DataFrame) -> DataFrame:
    """path, ordinal, depth, item, name, type, array, init, is_static, is_extern of the variables that statements (path, ordinal, depth, statement, ended_by) declare.

    A statement may declare several names, each with its own pointer stars, array sizes and first value;
    pointers to functions count, prototypes do not.
    """
    parts = found.filter((F.col("ended_by") == ";") & ~F.col("statement").rlike(rf"^{NO_TYPE}\b")).select("path", "ordinal", "depth", top_level_parts("statement", brackets="()[]{}").alias("parts"))
    first = F.get("parts", F.lit(0))
    head = F.trim(F.regexp_extract(first, DECLARED, 1))
    words = F.regexp_replace(head, r"[\s*]+$", "")  # stars belong to the first name
    each = parts.filter(first.rlike(DECLARED)).select("path", "ordinal", "depth", words.alias("words"), F.posexplode(F.transform("parts", lambda p, i: F.when(i == 0, p).otherwise(F.concat(words, F.lit(" "), p)))).alias("item", "p"))
    get = lambda k: F.trim(F.regexp_extract("p", DECLARED, k))
    callback = F.regexp_extract(get(2), r"^\(\s*\*\s*([A-Za-z_]\w*)", 1)
    kind = F.trim(F.regexp_replace(F.regexp_replace(get(1), r"\b(static|extern|register|auto)\b", " "), r"\s+", " "))
    known = each.filter(F.col("p").rlike(DECLARED)).select(
        "path", "ordinal", "depth", "item", F.when(callback != "", callback).otherwise(get(2)).alias("name"), kind.alias("type"), F.regexp_replace(get(3), r"\s", "").alias("array"),
        F.nullif(get(4), F.lit("")).alias("init"), F.col("words").rlike(r"\bstatic\b").alias("is_static"), F.col("words").rlike(r"\bextern\b").alias("is_extern"),
    )
    return known.filter((F.col("type") != "") & ~F.col("type").rlike(r"^(struct|union|enum)$"))


def static_locals(found: DataFrame) -> DataFrame:
    """function, ordinal, name, type, init of static variables that bodies of functions (name, body) declare."""
    inside = declarations(statements(found.select(F.col("name").alias("path"), F.col("body").alias("text"))))
    return inside.filter("is_static").select(F.col("path").alias("function"), "ordinal", "name", "type", "init")


def prototypes(files: DataFrame) -> DataFrame:
    """path, ordinal, name, returns, parameters, is_extern of function declarations at the top level of texts (path, text)."""
    p = r"^(extern\s+)?((?:[A-Za-z_]\w*[\s*]+)+)([A-Za-z_]\w*)\s*\((.*)\)$"
    top = statements(files).filter((F.col("depth") == 0) & (F.col("ended_by") == ";") & F.col("statement").rlike(p) & ~F.col("statement").rlike(rf"^({NO_TYPE[1:-1]})\b") & ~F.col("statement").contains("="))
    get = lambda k: F.trim(F.regexp_extract("statement", p, k))
    return top.select("path", "ordinal", get(3).alias("name"), F.trim(F.regexp_replace(get(2), r"\bextern\s+", "")).alias("returns"), get(4).alias("parameters"), F.col("statement").rlike(r"^extern\b").alias("is_extern"))
