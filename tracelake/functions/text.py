"""Text and classification expressions over Columns. All run inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _any_in(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def _first_class(rules: list[tuple[str, Column]], default: str | Column) -> Column:
    """The label of the first rule that holds."""
    chain = F
    for label, holds in rules:
        chain = chain.when(F.coalesce(holds, F.lit(False)), F.lit(label))
    return chain.otherwise(default if isinstance(default, Column) else F.lit(default))


def trimmed(x: Column | str) -> Column:
    return F.regexp_replace(F.coalesce(_col(x).cast("string"), F.lit("")), r"^\s+|\s+$", "")


def collapse_blanks(x: Column | str) -> Column:
    """Runs of white space become one blank; ends are trimmed."""
    return trimmed(F.regexp_replace(F.coalesce(_col(x).cast("string"), F.lit("")), r"\s+", " "))


def normalise_message(x: Column | str) -> Column:
    """Application paths become <PATH>, ISO timestamps <TIME>, blanks collapse."""
    text = F.regexp_replace(F.coalesce(_col(x), F.lit("")), r"/app/[^\s]+", "<PATH>")
    return collapse_blanks(F.regexp_replace(text, r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d+Z", "<TIME>"))


def tokens(x: Column | str) -> Column:
    """Lower-case search tokens of two characters or more, in order, each once."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(_col(x), F.lit(""))), F.lit("([a-z0-9가-힣_]{2,})"), F.lit(1)))


#: Words that place a failure, in the order they are tried.
FAILURE_WORDS = {
    "assertion": ["MISMATCH", "EXPECTED", "ASSERT", "!=", "NOT EQUAL", "VALUE MISMATCH", "COMPARISON", "OUT OF RANGE", "BOUNDARY"],
    "timeout": ["TIMEOUT", "TIME_OUT", "TIMED OUT", "DEADLINE"],
    "crash": ["CRASH", "ABORT", "SEGFAULT", "EXCEPTION", "ACCESS VIOLATION", "SIGNAL", "CORE DUMP", "STACK OVERFLOW", "PROTECTION FAULT", "ILLEGAL INSTRUCTION", "BUS ERROR"],
    "environment": ["ENV", "SETUP", "CONFIG", "LICENSE", "CONNECTION", "FILE NOT FOUND", "MISSING", "INITIALIZATION", "COMPILE ERROR", "LINK ERROR", "BUILD FAILED", "INSTRUMENT", "HARNESS"],
}
FAILURE_CLASSES = [*FAILURE_WORDS, "unknown"]


def failure_class(*texts: Column | str) -> Column:
    """Class of a failed test from its texts; nulls and empty texts are skipped."""
    joined = F.upper(F.concat_ws(" ", *[F.nullif(_col(t).cast("string"), F.lit("")) for t in texts]))
    return _first_class([(label, _any_in(joined, words)) for label, words in FAILURE_WORDS.items()], "unknown")


def result_class(x: Column | str) -> Column:
    """pass, skip, fail or unknown, tried in this order on the upper-cased text."""
    text = F.upper(trimmed(x))
    return _first_class([("pass", _any_in(text, ["PASS", "OK", "SUCCESS"])), ("skip", _any_in(text, ["SKIP", "N/A", "NOT RUN", "NOTRUN"])), ("fail", _any_in(text, ["FAIL", "ERROR", "NG", "FATAL"]))], "unknown")


def header_name(x: Column | str) -> Column:
    """Canonical column name of a test table's header; empty where none fits."""
    name = F.upper(collapse_blanks(x))
    return _first_class(
        [
            ("requirement_id", name.contains("REQUIREMENT") | name.isin("REQ", "REQ ID", "REQ-ID", "REQID")),
            ("test_script", name.contains("TEST SCRIPT") | name.isin("SCRIPT", "TEST PROCEDURE", "PROCEDURE")),
            ("stubs", name.contains("STUB")),
            ("testcase", name.isin("TESTCASE", "TEST CASE", "TEST NAME")),
            ("unit", name == "UNIT"),
            ("subprogram", name == "SUBPROGRAM"),
            ("environment", name == "ENVIRONMENT"),
            ("result", name.isin("RESULT", "STATUS", "OUTCOME")),
        ],
        "",
    )


def requirement_key(x: Column | str) -> Column:
    """A requirement id without white space, upper-cased."""
    return F.upper(F.regexp_replace(F.coalesce(_col(x), F.lit("")), r"\s+", ""))


def requirement_type(x: Column | str) -> Column:
    text = F.coalesce(_col(x), F.lit(""))
    return _first_class([(kind, text.startswith(f"Sw{kind}_")) for kind in ("EI", "TSR", "NTSR", "NTR", "TR")], "OTHER")


def requirement_ids(x: Column | str) -> Column:
    """Search ids (REQ, SDS, SW, ...) of a text in order, blanks removed, each once."""
    found = F.regexp_extract_all(F.coalesce(_col(x), F.lit("")), F.lit(r"(?i)(\b(?:REQ|SDS|SW|SWS|SWR|SRS|SWC|REQS)\s*[-_:]?\s*[A-Za-z0-9_.-]+\b)"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda i: F.regexp_replace(i, r"\s+", "")))


def document_ids(x: Column | str) -> Column:
    """Requirement ids of design documents, in order, each once."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(_col(x), F.lit("")), F.lit(r"(?i)\b(Sw(?:TR|TSR|NTR|NTSR|CNF|EI|ST|STR|Fn|TK)_\d+)\b"), F.lit(1)))


def test_ids(x: Column | str) -> Column:
    """Requirement ids that test names and descriptions carry, in order, each once."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(_col(x), F.lit("")), F.lit(r"(?i)((?:SwTR|SwFn|SwUFn|SwTC|SRS)[-_][A-Za-z0-9]+(?:[-_][A-Za-z0-9]+)*)"), F.lit(1)))


def distinct_lines(x: Column | str, blank_marks: bool = False) -> Column:
    """Trimmed non-empty lines in order, each once; with `blank_marks` N/A, NONE, - and TBD go too."""
    lines = F.filter(F.transform(F.split(F.coalesce(_col(x), F.lit("")), r"\r\n|\r|\n"), trimmed), lambda line: line != "")
    if blank_marks:
        lines = F.filter(lines, lambda line: ~F.upper(line).isin("N/A", "NONE", "-", "TBD"))
    return F.array_join(F.array_distinct(lines), "\n")


def related_ids(x: Column | str) -> Column:
    """Ids split at comma, semicolon and line end, each once."""
    return F.array_join(F.array_distinct(split_list(x)), ", ")


def split_list(x: Column | str, at: str = r"[,;\n]+") -> Column:
    """Trimmed non-empty parts of a delimited text."""
    return F.filter(F.transform(F.split(F.coalesce(_col(x), F.lit("")), at), trimmed), lambda t: t != "")


def asil(x: Column | str) -> Column:
    """Safety levels of a text (QM, A to D), each once; without any, the distinct lines."""
    parts = F.transform(F.split(F.upper(trimmed(x)), r"[\s,;/]+"), lambda t: t)
    known = F.filter(parts, lambda t: t.isin("A", "B", "C", "D", "QM", "ASIL-A", "ASIL-B", "ASIL-C", "ASIL-D"))
    levels = F.array_distinct(F.transform(known, lambda t: F.replace(t, F.lit("ASIL-"), F.lit(""))))
    return F.when(F.size(levels) > 0, F.array_join(levels, ", ")).otherwise(distinct_lines(x, blank_marks=True))


def unit_id(x: Column | str) -> Column:
    """swufn_<digits> in any case as SwUFn_<digits>; other texts unchanged."""
    digits = F.regexp_extract(trimmed(x), r"(?i)swufn_(\d+)", 1)
    return F.when(digits != "", F.concat(F.lit("SwUFn_"), digits)).otherwise(trimmed(x))


def component_label(x: Column | str) -> Column:
    """Blanks at parentheses removed and a component number padded to two digits."""
    text = F.regexp_replace(F.regexp_replace(collapse_blanks(x), r"\s*\(\s*", "("), r"\s*\)", ")")
    number = F.regexp_extract(text, r"(?i)swcom_(\d+)", 1)
    padded = F.concat(F.lit("SwCom_"), F.when(F.length(number) < 2, F.lpad(number, 2, "0")).otherwise(number))
    return F.when(number != "", F.regexp_replace(text, F.lit(r"(?i)swcom_\d+"), padded)).otherwise(text)


def rule_label(x: Column | str) -> Column:
    """Coding rules written as 'Rule 5-3' or 'Dir 1-1'; other texts unchanged."""
    text = trimmed(F.regexp_replace(F.regexp_replace(collapse_blanks(x), "MISRA ", ""), "MISRA-", ""))
    prefix = F.when(F.lower(text).startswith("dir") | F.lower(text).startswith("d-"), F.lit("Dir")).otherwise(F.lit("Rule"))
    named, bare = r"(?i)(?:Rule|Dir)[\s\-_:]*([0-9]+)[.-]([0-9]+)", r"\b([0-9]+)[.-]([0-9]+)(?:\b|$)"
    label = lambda pattern: F.concat(prefix, F.lit(" "), F.regexp_extract(text, pattern, 1), F.lit("-"), F.regexp_extract(text, pattern, 2))
    return F.when(text.rlike(named), label(named)).when(text.rlike(bare), label(bare)).otherwise(text)


def report_type(path: Column | str, title: Column | str | None = None) -> Column:
    """Kind of a report from its file name and title."""
    name = F.lower(F.regexp_extract(F.coalesce(_col(path), F.lit("")), r"([^/\\]*)$", 1))
    heading = F.lower(F.coalesce(_col(title), F.lit(""))) if title is not None else F.lit("")
    return _first_class(
        [
            ("prqa_rcr", heading.contains("rule compliance report") | name.contains("_rcr_")),
            ("prqa_crr", heading.contains("code review report") | name.contains("_crr_")),
            ("prqa_hmr", heading.contains("his metrics report") | name.contains("_hmr_")),
            ("vcast_aggregate", heading.contains("aggregate report") | name.contains("aggregate_report")),
            ("vcast_metrics", heading.contains("metrics report") | name.contains("metrics_report")),
            ("vcast_environment", name.contains("environment_report")),
            ("vcast_full", name.contains("full_report")),
            ("vcast_other", name.contains("vectorcast") | name.contains("vcast")),
            ("xlsx", name.endswith(".xlsx")),
            ("json", name.endswith(".json")),
            ("log", name.endswith(".log")),
        ],
        "other",
    )


def report_group(path: Column | str, title: Column | str | None = None) -> Column:
    kind = report_type(path, title)
    return _first_class([("prqa", kind.startswith("prqa")), ("vectorcast", kind.startswith("vcast"))], F.when(kind.isin("xlsx", "json", "log"), kind).otherwise(F.lit("other")))


#: The words that a log's counts are read from.
KPI_WORDS = {"fail": r"\bfail(?:ed|ures)?\b", "error": r"\berror(?:s)?\b", "warn": r"\bwarn(?:ing|ings)?\b", "pass": r"\bpass(?:ed|es)?\b"}


def kpis(x: Column | str) -> Column:
    """struct(fail, error, warn, pass): the largest number beside each word, or word counts where no word has a number."""
    text = F.coalesce(_col(x), F.lit(""))
    numbers = {k: F.transform(F.regexp_extract_all(text, F.lit(f"(?i){p}[^0-9]{{0,12}}([0-9]{{1,9}})"), F.lit(1)), lambda n: n.cast("long")) for k, p in KPI_WORDS.items()}
    numeric = reduce(lambda a, b: a | b, [F.size(n) > 0 for n in numbers.values()])
    value = lambda k: F.when(numeric, F.coalesce(F.array_max(numbers[k]), F.lit(0))).otherwise(F.regexp_count(text, F.lit(f"(?i){KPI_WORDS[k]}"))).cast("long").alias(k)
    return F.struct(*[value(k) for k in KPI_WORDS])


#: Words that place a question, in the order they are tried.
QUESTION_WORDS = {
    "docs": ["doc", "docs", "spec", "requirement", "guide", "문서", "가이드", "요구사항", "스펙"],
    "code": ["function", "class", "symbol", "file", "source", "코드", "함수", "클래스", "파일", "소스"],
    "git": ["git", "diff", "commit", "branch", "staged", "checkout", "머지", "브랜치", "커밋"],
    "coverage": ["coverage", "line rate", "branch rate", "gcov", "gcovr", "커버리지"],
    "findings": ["finding", "findings", "warning", "warn", "static", "이슈", "문제", "정적"],
    "troubleshooting": ["log", "error", "fail", "failed", "traceback", "exception", "build", "test", "로그", "실패", "빌드"],
}
#: The domains searched for each type of question, best first.
QUESTION_DOMAINS = {
    "coverage": ["reports", "docs"],
    "findings": ["reports", "docs"],
    "troubleshooting": ["reports", "logs", "docs", "code"],
    "jenkins": ["jenkins", "logs", "docs"],
    "git": ["docs"],
    "docs": ["docs"],
    "code": ["code", "docs"],
}


def question_type(question: Column | str, mode: Column | str | None = None, view: Column | str | None = None) -> Column:
    text = F.lower(F.coalesce(_col(question), F.lit("")))
    rules = [(kind, _any_in(text, words)) for kind, words in QUESTION_WORDS.items()]
    if mode is not None:
        rules.append(("jenkins", _col(mode) == "jenkins"))
    if view is not None:
        rules.append(("workflow", _col(view) == "workflow"))
    return _first_class(rules, "general")


def question_domains(kind: Column | str) -> Column:
    chain = F
    for name, domains in QUESTION_DOMAINS.items():
        chain = chain.when(_col(kind) == name, F.array(*[F.lit(d) for d in domains]))
    return chain.otherwise(F.array(F.lit("reports"), F.lit("docs")))


def name_words(x: Column | str) -> Column:
    """Words of a camelCase or snake_case function name, storage prefixes dropped."""
    bare = F.regexp_replace(trimmed(x), r"^[sgu]\d*[sg]?_", "")
    parts = F.transform(F.split(F.regexp_replace(bare, "([a-z])([A-Z])", "$1_$2"), "_"), trimmed)
    return F.filter(parts, lambda w: (w != "") & ~F.lower(w).isin("s", "g", "u8", "u16", "u32", "s16", "fn"))


def sentences(x: Column | str) -> Column:
    """Sentences of a text: split behind . ! ? at blanks."""
    return F.filter(F.transform(F.split(collapse_blanks(x), r"(?<=[.!?])\s+"), trimmed), lambda s: s != "")


def limited_sentences(x: Column | str, most: int, most_words: int, most_chars: int, period: bool = True) -> Column:
    """The first sentences, each cut to a number of words, the whole to a number of characters."""
    cut = F.transform(F.slice(sentences(x), 1, most), lambda s: F.array_join(F.slice(F.split(s, " "), 1, most_words), " "))
    text = trimmed(F.substring(F.array_join(cut, " "), 1, most_chars))
    return F.when((text != "") & ~text.rlike(r"[.!?]$"), F.concat(text, F.lit("."))).otherwise(text) if period else text


def without_comments(x: Column | str) -> Column:
    """C text without block and line comments."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(_col(x), F.lit("")), r"(?s)/\*.*?\*/", " "), r"//[^\n]*", " ")


def without_comments_and_strings(x: Column | str) -> Column:
    """C text without comments, string and character literals; one pass, so quotes in comments do not count."""
    return F.regexp_replace(F.coalesce(_col(x), F.lit("")), r"(?s)/\*.*?\*/|//[^\n]*|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'", " ")


def without_tags(x: Column | str) -> Column:
    """Text of an HTML fragment: scripts, styles and tags become blanks, blanks collapse."""
    text = F.regexp_replace(F.coalesce(_col(x), F.lit("")), r"(?is)<(script|style)\b.*?</\1>", " ")
    return collapse_blanks(F.regexp_replace(text, r"(?s)<[^>]+>", " "))


#: Keywords that look like calls.
CALL_KEYWORDS = ["if", "for", "while", "switch", "return", "sizeof", "case", "do", "else", "defined"]


def call_names(x: Column | str) -> Column:
    """Identifiers before an opening parenthesis, keywords left out, in order, each once."""
    found = F.regexp_extract_all(without_comments_and_strings(x), F.lit(r"\b([A-Za-z_]\w*)\s*\("), F.lit(1))
    return F.array_except(F.array_distinct(found), F.array(*[F.lit(k) for k in CALL_KEYWORDS]))


def identifiers(x: Column | str) -> Column:
    """Distinct valid C identifiers of a delimited list."""
    return F.array_distinct(F.filter(split_list(x), lambda t: t.rlike(r"^[A-Za-z_]\w*$")))


def meaningful(x: Column | str) -> Column:
    """True where a text is not blank, N/A, - or TBD."""
    text = F.upper(trimmed(x))
    return ~text.isin("", "N/A", "-", "TBD")


def meaningful_list(x: Column | str) -> Column:
    """True where any item of a list is not blank, whatever it says."""
    return F.coalesce(F.exists(_col(x), lambda i: trimmed(i) != ""), F.lit(False))


def description_quality(text: Column | str, source: Column | str, generic: Column) -> Column:
    """high, medium or low, by where a description comes from, whether it is generic, and its length."""
    body, origin = trimmed(text), F.lower(trimmed(source))
    trusted = origin.isin("comment", "sds", "reference", "srs", "ai")
    guessed = origin.isin("inference", "module_inherit", "default", "rule", "")
    return (
        F.when(body == "", F.lit("low"))
        .when(trusted, F.when(generic, F.lit("medium")).otherwise(F.lit("high")))
        .when(generic, F.lit("low"))
        .when(guessed, F.when(F.length(body) > 30, F.lit("medium")).otherwise(F.lit("low")))
        .otherwise(F.lit("medium"))
    )


def json_candidate(x: Column | str) -> Column:
    """The JSON object inside a fenced or surrounded answer; null where none parses."""
    text = F.coalesce(_col(x), F.lit(""))
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    bare = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    valid = lambda c: F.when(F.try_parse_json(F.nullif(c, F.lit(""))).isNotNull(), c)
    return F.coalesce(valid(fenced), valid(bare))


def response_issues(x: Column | str, least: int = 0, most: int | None = None, fields: tuple[str, ...] = (), banned: tuple[str, ...] = ()) -> Column:
    """Names of the checks that a generated answer fails."""
    text = F.coalesce(_col(x), F.lit(""))
    body = F.try_parse_json(json_candidate(x))
    checks = [F.when(F.length(trimmed(x)) < least, F.lit("too_short"))]
    if most is not None:
        checks.append(F.when(F.length(text) > most, F.lit("too_long")))
    if fields:
        checks.append(F.when(body.isNull(), F.lit("not_json")))
        checks += [F.when(F.try_variant_get(body, f"$.{f}", "string").isNull(), F.lit(f"missing:{f}")) for f in fields]
    checks += [F.when(F.lower(text).contains(b.lower()), F.lit(f"banned:{b}")) for b in banned]
    return F.array_compact(F.array(*checks))


def test_log_causes(x: Column | str) -> Column:
    """Causes that a test run's log shows: timeout, asan, tsan, assert, crc."""
    text = F.coalesce(_col(x), F.lit(""))
    rules = [("timeout", text.contains("***Timeout")), ("asan", text.contains("AddressSanitizer")), ("tsan", text.contains("ThreadSanitizer")), ("assert", text.rlike(r"(?i)assert(ion)?\b.*fail|assertion")), ("crc", text.rlike(r"(?i)\bcrc\b"))]
    return F.array_compact(F.array(*[F.when(holds, F.lit(name)) for name, holds in rules]))
