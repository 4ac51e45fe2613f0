"""Design documents as sections, functions and modules; what changes mean for documents; change triggers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions.text import _col, collapse_blanks

#: Names of functions and modules in design texts, headings that name a module, and headings that tell of many.
FUNCTION = r"\b(?:ap_[A-Za-z0-9_]+|g_[A-Za-z0-9_]+|s_[A-Za-z0-9_]+|v_[A-Za-z0-9_]+|u(?:8|16|32|64)[A-Za-z0-9_]+)\b"
MODULE = r"\bSwCom[_ ]?\d+\b|\b[A-Z][A-Za-z0-9]+Ctrl\b|\b[A-Z][A-Za-z0-9]+(?:Module|Manager|System)\b"
MODULE_HEADING = r"(?i)^(SwCom[_ ]?\d+)\s*[:\-]?\s*(.*)$"
GENERIC_HEADINGS = ["software component information", "component folder struct", "revision history", "task scheduling summary"]
CONTENTS = ["contents", "table of contents"]
CONTENTS_LINE = r"^\d+(?:\.\d+)*[\.\t ]+.+?\d+$"
FIRST_HEADING = "Document Overview"
#: What a kind of change means for each document.
SENSITIVITY = {
    "uds": {
        "SIGNATURE": "함수 인터페이스 변경 → UDS 입출력/프로토타입 섹션 업데이트 필요", "BODY": "로직 변경 → UDS 설명/로직 다이어그램 업데이트 필요", "NEW": "신규 함수 → UDS 신규 섹션 생성 필요",
        "DELETE": "삭제된 함수 → UDS 해당 섹션 제거 필요", "VARIABLE": "변수 변경 → UDS 글로벌/로컬 변수 목록 업데이트", "HEADER": "헤더 변경 → UDS 인터페이스/의존성 정보 확인",
    },
    "suts": {
        "SIGNATURE": "인터페이스 변경 → 모든 TC 입출력값 재검증 필요", "BODY": "로직 변경 → 경계값/기대값 재계산 필요", "NEW": "신규 함수 → TC 신규 생성 필요", "DELETE": "삭제 → 관련 TC 제거", "VARIABLE": "변수 변경 → 관련 TC 입출력 매핑 확인",
    },
    "sits": {
        "SIGNATURE": "인터페이스 변경 → 콜체인 전체 재검증", "BODY": "로직 변경 → 통합 테스트 기대값 재확인", "NEW": "신규 함수 → 콜체인에 포함 여부 확인", "DELETE": "삭제 → 콜체인 단절 확인",
        "VARIABLE": "변수 변경 → 통합 테스트 데이터 흐름 재확인", "HEADER": "헤더 변경 → 콜체인 인터페이스 의존성 확인",
    },
    "sts": {
        "SIGNATURE": "인터페이스 변경 → STS 요구사항 검증 방법 재검토", "BODY": "로직 변경 → STS 요구사항 기대 동작 재확인", "NEW": "신규 함수 → STS 요구사항 매핑 추가", "DELETE": "삭제 → STS 요구사항 커버리지 재확인", "VARIABLE": "변수 변경 → STS 요구사항 입출력 매핑 확인",
    },
    "sds": {
        "SIGNATURE": "아키텍처 인터페이스 변경 → SDS 모듈 인터페이스 업데이트", "BODY": "로직 변경 → SDS 설계 설명 업데이트 필요", "NEW": "신규 컴포넌트 → SDS 설계 추가", "DELETE": "컴포넌트 삭제 → SDS 설계 제거", "VARIABLE": "변수 변경 → SDS 데이터 흐름/인터페이스 업데이트",
    },
}


def document_impacts(changes: DataFrame, documents: list[str] | None = None) -> DataFrame:
    """document, function, change_type, impact of changed functions (function, change_type); kinds that a document does not feel give no row."""
    each = F.array(*[F.struct(F.lit(d).alias("document"), F.create_map(*[F.lit(x) for pair in SENSITIVITY[d].items() for x in pair]).alias("felt")) for d in documents or SENSITIVITY])
    rows = changes.select("function", "change_type", F.explode(each).alias("d"))
    felt = F.element_at("d.felt", F.col("change_type"))
    return rows.select("d.document", "function", "change_type", F.concat(F.lit("["), F.col("function"), F.lit("] "), F.col("change_type"), F.lit(" → "), felt).alias("impact")).filter("impact is not null")


def change_triggers(requests: DataFrame, registry: DataFrame, changed: DataFrame) -> DataFrame:
    """scm_id, trigger_type, scm_type, source_root, base_ref, dry_run, changed_files, known of requests (scm_id, trigger_type, base_ref, dry_run, files).

    `registry` is (id, scm_type, source_root, base_ref), `changed` the changed files that were found
    (scm_id, path). Files that a request names by hand come before those found; a base that neither names
    is HEAD~1, and none for svn. A request for an unknown id has known false and no files.
    """
    manual = F.filter(F.transform(F.coalesce("files", F.array().cast("array<string>")), lambda f: F.trim(f)), lambda f: f != "")
    found = changed.groupBy("scm_id").agg(F.array_sort(F.collect_set("path")).alias("found"))
    entry = registry.select(F.col("id").alias("scm_id"), F.lower(F.coalesce("scm_type", F.lit("git"))).alias("scm_type"), "source_root", F.col("base_ref").alias("entry_ref"), F.lit(True).alias("known"))
    met = requests.join(entry, "scm_id", "left").join(found, "scm_id", "left")
    given = lambda c: F.nullif(F.trim(F.coalesce(F.col(c), F.lit(""))), F.lit(""))
    base = F.coalesce(given("base_ref"), given("entry_ref"), F.when(F.col("scm_type") == "svn", F.lit("")).otherwise(F.lit("HEAD~1")))
    nothing = F.array().cast("array<string>")
    files = F.when(F.col("known").isNull(), nothing).when(F.size(manual) > 0, manual).otherwise(F.coalesce("found", nothing))
    return met.select("scm_id", "trigger_type", "scm_type", "source_root", F.when(F.col("known"), base).alias("base_ref"), F.coalesce("dry_run", F.lit(False)).alias("dry_run"), files.alias("changed_files"), F.coalesce("known", F.lit(False)).alias("known"))


def document_sections(paragraphs: DataFrame) -> DataFrame:
    """path, ordinal, heading, text of documents' paragraphs and table rows (path, ordinal, kind, style, text).

    A section begins at a paragraph whose style is a heading's, or a title's below 120 characters. Cells
    of a row are joined by bars. What stands before the first heading has its own section; sections
    without text are left out.
    """
    style = F.lower(F.coalesce("style", F.lit("")))
    text = F.when(F.col("kind") == "row", F.array_join(F.filter(F.transform(F.split("text", "\t"), lambda c: collapse_blanks(c)), lambda c: c != ""), " | ")).otherwise(F.trim("text"))
    heads = (F.col("kind") != "row") & (style.contains("heading") | (style.contains("title") & (F.length(text) < 120)))
    rows = paragraphs.select("path", "ordinal", text.alias("text"), heads.alias("heads")).filter("text <> ''")
    number = F.sum(F.col("heads").cast("int")).over(Window.partitionBy("path").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0))
    parts = rows.withColumn("section", number).groupBy("path", "section").agg(F.max(F.when(F.col("heads"), F.col("text"))).alias("heading"), F.array_sort(F.collect_list(F.when(~F.col("heads"), F.struct("ordinal", "text")))).alias("lines"), F.min("ordinal").alias("ordinal"))
    return parts.filter(F.size("lines") > 0).select("path", "ordinal", F.coalesce("heading", F.lit(FIRST_HEADING)).alias("heading"), F.array_join(F.transform("lines", lambda x: x["text"]), "\n").alias("text"))


def modules_of(functions: Column | str) -> Column:
    """Modules that functions' names tell: their second parts, with a capital."""
    core = F.transform(_col(functions), lambda f: F.regexp_replace(F.coalesce(F.get(F.filter(F.split(f, "_"), lambda p: p != ""), F.lit(1)), F.lit("")), "[^A-Za-z0-9]", ""))
    return F.array_distinct(F.filter(F.transform(core, lambda c: F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, F.lit(2), F.length(c)))), lambda c: c != ""))


def section_facts(sections: DataFrame) -> DataFrame:
    """path, ordinal, heading, text, functions, modules, direct, kind of design sections (path, ordinal, heading, text).

    Functions and modules are those that heading and text name. A heading that begins with a module names
    that one alone (`direct`); where none is named, the functions tell. Tables of contents name nothing.
    `kind` is function, module or section, by what a section is about; headings that tell of many modules,
    and sections that only list three or more, are sections.
    """
    heading = collapse_blanks("heading")
    both = F.concat(F.coalesce("heading", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")))
    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    contents = F.lower(heading).isin(CONTENTS) | ((F.size(lines) >= 3) & (F.size(F.filter(F.slice(lines, 1, 20), lambda x: x.rlike(CONTENTS_LINE))) >= 5))
    none = F.array().cast("array<string>")
    every = lambda p: F.array_distinct(F.regexp_extract_all(both, F.lit(f"({p})"), F.lit(1)))
    rows = sections.select("path", "ordinal", heading.alias("heading"), F.trim("text").alias("text"), contents.alias("contents"), every(FUNCTION).alias("f"), F.array_distinct(F.transform(every(MODULE), lambda m: collapse_blanks(m))).alias("m"))
    direct = F.nullif(F.replace(F.regexp_extract("heading", MODULE_HEADING, 1), F.lit(" "), F.lit("_")), F.lit(""))
    rows = rows.withColumn("functions", F.when(F.col("contents"), none).otherwise(F.col("f"))).withColumn("direct", F.when(~F.col("contents"), direct))
    modules = F.when(F.col("contents"), none).when(F.col("direct").isNotNull(), F.array("direct")).when(F.size("m") > 0, F.col("m")).otherwise(modules_of("functions"))
    rows = rows.withColumn("modules", modules)
    distinct = F.size(F.array_distinct(F.transform("modules", lambda m: F.lower(m))))
    many = ~F.col("contents") & (F.lower("heading").isin(GENERIC_HEADINGS) | ((F.size("functions") == 0) & (distinct >= 3)))
    kind = F.when(many, F.lit("section")).when(F.size("functions") > 0, F.lit("function")).when(F.size("modules") > 0, F.lit("module")).otherwise(F.lit("section"))
    return rows.select("path", "ordinal", "heading", "text", "functions", "modules", "direct", kind.alias("kind"))


def design_items(facts: DataFrame, changed: DataFrame, flagged: DataFrame) -> DataFrame:
    """path, kind, title, summary, headings, functions, modules, changed, change_types, review of design documents.

    An item for each function and module that sections are about, and one for each other section.
    `changed` is (name, change_type), `flagged` (module). An item's headings are its sections', those that
    name the module first, the last of them foremost; its summary is the text of the last such section,
    else of its first. A function is changed if it is among `changed`, a module if one of its functions
    is. To review is what touches a flagged module, or one that a changed function's name tells.
    """
    about = facts.filter("kind <> 'section'")
    names = lambda kind, column: about.select("path", F.lit(kind).alias("kind"), F.explode(column).alias("title"), "ordinal", "heading", "text", "functions", "modules", "direct")
    rows = names("function", "functions").unionByName(names("module", "modules"))
    leads = F.when(F.col("kind") == "function", F.col("direct").isNotNull()).otherwise(F.coalesce(F.col("direct") == F.col("title"), F.lit(False)))
    rows = rows.withColumn("leads", leads)
    summary = F.coalesce(F.max_by("text", F.when(F.col("leads"), F.col("ordinal"))), F.min_by("text", "ordinal"))
    once = rows.groupBy("path", "kind", "title", "heading").agg(F.min("ordinal").alias("ordinal"), F.min_by("leads", "ordinal").alias("leads"))
    place = F.when(F.col("leads"), F.struct(F.lit(0).alias("part"), (-F.col("ordinal")).alias("place"), F.col("heading").alias("heading"))).otherwise(F.struct(F.lit(1).alias("part"), F.col("ordinal").alias("place"), F.col("heading").alias("heading")))
    headings = once.groupBy("path", "kind", "title").agg(F.transform(F.array_sort(F.collect_list(place)), lambda x: x["heading"]).alias("headings"))
    merged = rows.groupBy("path", "kind", "title").agg(F.substring(collapse_blanks(summary), 1, 240).alias("summary"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("functions")))).alias("functions"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("modules")))).alias("modules"))
    kinds = changed.groupBy("name").agg(F.array_sort(F.collect_set(F.upper("change_type"))).alias("types"))
    key = F.when(F.col("kind") == "function", F.array("title")).otherwise(F.col("functions"))
    touched = merged.select("path", "kind", "title", F.explode(key).alias("name")).join(kinds, "name").groupBy("path", "kind", "title").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("types")))).alias("change_types"))
    told = changed.select(F.explode(modules_of(F.array("name"))).alias("module"))
    marks = flagged.select("module").unionByName(told).select(F.lower(F.trim("module")).alias("mark")).filter("mark <> ''").distinct()
    own = F.when(F.col("kind") == "module", F.array("title")).otherwise(F.col("modules"))
    review = merged.select("path", "kind", "title", F.explode(own).alias("m")).join(marks, F.lower(F.trim("m")) == F.col("mark"), "left_semi").select("path", "kind", "title").distinct().withColumn("review", F.lit(True))
    at = ["path", "kind", "title"]
    items = merged.join(headings, at).join(touched, at, "left").join(review, at, "left")
    none = F.array().cast("array<string>")
    items = items.select(*at, "summary", "headings", "functions", "modules", F.col("change_types").isNotNull().alias("changed"), F.coalesce("change_types", none).alias("change_types"), F.coalesce("review", F.lit(False)).alias("review"))
    rest = facts.filter("kind = 'section'").select("path", "kind", F.coalesce(F.nullif("heading", F.lit("")), F.concat(F.lit("Section "), F.col("ordinal").cast("string"))).alias("title"), F.substring(collapse_blanks("text"), 1, 240).alias("summary"), F.array("heading").alias("headings"), "functions", "modules", F.lit(False).alias("changed"), none.alias("change_types"), F.lit(False).alias("review"))
    return items.unionByName(rest)
