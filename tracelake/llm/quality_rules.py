"""Quality rules with cross-document line frequency. DataFrame functions only.

Normalised lines are hashed together with their host; a line that occurs in more distinct
documents of its host than allowed is boilerplate there and is removed (`without_frequent_lines`),
and a document that loses too many of its words with such lines is rejected (`quality_rules`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm.shared import WORD, settle

#: A host's line in more distinct documents than this is removed.
LINE_DOCUMENTS = 10
#: A document that loses more than this share of its words is rejected.
LOST_SHARE = 0.5
MIN_WORDS = 50
#: Parts of each frequent line in a join; frequent lines are one in LINE_DOCUMENTS at most.
SALTS = 16
BLANK = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"


def _lines(text: Column) -> Column:
    """The \\n-split lines that hold a word."""
    return F.filter(F.split(text, "\n", -1), lambda line: line.rlike(WORD))


def repeated_words(words: Column) -> Column:
    """Words covered by three-word windows that occur twice or more in the array, first ones included.

    Windows are sorted by their 64-bit hash and place, so equal ones are neighbours, and neighbours
    with one hash are compared word by word.
    """
    n = F.size(words)
    once = lambda array, use: F.get(F.transform(F.array(array), use), F.lit(0))
    window = lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("key"), i.alias("place"))
    ordered = F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), window))

    def same(x: Column, y: Column) -> Column:
        equal = x["key"] == y["key"]
        for k in range(3):
            equal = equal & (F.get(words, x["place"] + k) == F.get(words, y["place"] + k))
        return F.coalesce(equal, F.lit(False))

    # `s` and `p` are computed once a row: the lambda variables of one-element arrays.
    twice = lambda s: F.filter(s, lambda x, i: same(x, F.get(s, i + 1)) | same(x, F.get(s, i - 1)))
    starts = lambda s: F.sort_array(F.transform(twice(s), lambda x: x["place"]))
    covered = lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x)
    return F.when(n >= 4, once(ordered, lambda s: once(starts(s), covered))).otherwise(F.lit(0)).cast("long")


def text_rules(docs: DataFrame) -> DataFrame:
    """Adds the base measures of the column `text` to `docs`."""
    words = F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1))
    counted = docs.withColumn("words", F.coalesce(words, F.array().cast("array<string>"))).withColumn("line_list", F.coalesce(_lines(F.col("text")), F.array().cast("array<string>")))
    return counted.select(
        *docs.columns,
        F.size("words").cast("long").alias("n_words"),
        F.coalesce(F.length(F.regexp_replace("text", BLANK, "")), F.lit(0)).cast("long").alias("word_chars"),
        F.coalesce(F.regexp_count("text", F.lit(SYMBOLS)), F.lit(0)).cast("long").alias("n_symbols"),
        (F.size("line_list") - F.size(F.array_distinct("line_list"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
    )


def _squeezed(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), BLANK, " "))


def _keyed(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), F.col(text_col).cast("string").alias("text"))
    return rows.withColumn("text_key", F.xxhash64("text"))


def lost_lines(rows: DataFrame, line_documents: int) -> DataFrame:
    """doc_id, text_key, host, line_key, line_words: each frequent line of each document of `rows` once."""
    lines = rows.select("doc_id", "text_key", "host", F.explode(F.array_distinct(F.transform(_lines(F.col("text")), _squeezed))).alias("line"))
    lines = lines.select("doc_id", "text_key", "host", F.xxhash64("host", "line").alias("line_key"), F.size(F.split("line", " ")).alias("line_words"))
    # A line in many documents is a line on many rows: most lines go before any join.
    often = lines.groupBy("line_key").agg(F.count(F.lit(1)).alias("uses")).filter(F.col("uses") > line_documents).select("line_key")
    # One line may stand on a third of all documents: its rows are dealt over SALTS tasks.
    salted = lambda keys: keys.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    lines = lines.withColumn("salt", F.pmod("text_key", F.lit(SALTS)).cast("int"))
    candidates = settle(lines.join(salted(often), ["line_key", "salt"], "left_semi"))
    common = candidates.groupBy("line_key", "text_key").agg(F.count(F.lit(1)).alias("uses")).groupBy("line_key").agg(F.count(F.lit(1)).alias("documents")).filter(F.col("documents") > line_documents).select("line_key")
    # Repeated rows of one document say the same twice.
    return candidates.join(salted(common), ["line_key", "salt"], "left_semi").select("doc_id", "text_key", "host", "line_key", "line_words").distinct()


def _same_document() -> Column:
    return F.col("doc_id").eqNullSafe(F.col("lost_id")) & (F.col("text_key") == F.col("lost_key")) & (F.col("host") == F.col("lost_host"))


def _lost_by() -> list[Column]:
    return [F.col("doc_id").alias("lost_id"), F.col("text_key").alias("lost_key"), F.col("host").alias("lost_host")]


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", line_documents: int = LINE_DOCUMENTS, lost_share: float = LOST_SHARE) -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, n_lost_words, kept.

    Lines are compared lower-cased with blanks squeezed, within one host; null and empty hosts
    are one host. Documents count as distinct by their whole text, so repeated rows and exact copies
    count once. A null or empty text has no words and fails the base rules. Null and repeated ids
    are kept as they are; other columns are not read.
    """
    rows = _keyed(docs, id_col, text_col, host_col)
    lost = lost_lines(rows, line_documents).groupBy(*_lost_by()).agg(F.sum("line_words").alias("lost_words"))
    measured = text_rules(rows)
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    n_lost = F.coalesce("lost_words", F.lit(0)).cast("long")
    joined = measured.join(lost, _same_document(), "left")
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"), n_lost.alias("n_lost_words"), (~base_failed & (n_lost <= lost_share * F.col("n_words"))).alias("kept")
    )


def without_frequent_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", line_documents: int = LINE_DOCUMENTS) -> DataFrame:
    """All rows of `docs`: doc_id, text, n_lost_lines; every line in over `line_documents` documents of its host is gone from the text.

    Lines are those that `quality_rules` counts, every occurrence of them is removed, and all other
    lines, blank ones included, stay as they are and in their order. A null text stays null.
    """
    rows = _keyed(docs, id_col, text_col, host_col)
    lost = lost_lines(rows, line_documents).groupBy(*_lost_by()).agg(F.collect_set("line_key").alias("lost_lines"))
    joined = rows.join(lost, _same_document(), "left")
    whole = F.split("text", "\n", -1)
    stays = F.filter(whole, lambda line: ~(line.rlike(WORD) & F.array_contains("lost_lines", F.xxhash64("host", _squeezed(line)))))
    changed = joined.withColumn("stays", F.when(F.col("lost_lines").isNotNull(), stays))
    text = F.when(F.col("stays").isNull(), F.col("text")).otherwise(F.array_join("stays", "\n"))
    return changed.select("doc_id", text.alias("text"), F.coalesce(F.size(whole) - F.when(F.col("stays").isNotNull(), F.size("stays")), F.lit(0)).cast("long").alias("n_lost_lines"))


ORACLE_SQL = f"""
with d as (select doc_id, coalesce(source, '') as host, coalesce(text, '') as text from documents),
w as (select doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') as words from d),
tri as (select doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] as t
        from (select doc_id, words, unnest(range(1, len(words) - 1)) as i from w)),
dup as (select doc_id, i from tri qualify count(*) over (partition by doc_id, t) > 1),
rep as (select doc_id, count(distinct i + k) as n_repeat_words from dup, (values (0), (1), (2)) o(k) group by doc_id),
ln as (select doc_id, host, text, unnest(string_split(text, chr(10))) as line from d),
lw as (select * from ln where regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
dl as (select doc_id, count(*) - count(distinct line) as n_dup_lines from lw group by doc_id),
nl as (select distinct doc_id, host, text, trim(regexp_replace(lower(line), '[\\x20\\x09-\\x0D]+', ' ', 'g')) as line from lw),
cm as (select host, line from nl group by host, line having count(distinct text) > {LINE_DOCUMENTS}),
lost as (select doc_id, cast(sum(len(string_split(line, ' '))) as bigint) as n_lost_words from nl join cm using (host, line) group by doc_id),
m as (select d.doc_id, len(words) as n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) as word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]')) as n_symbols, coalesce(n_dup_lines, 0) as n_dup_lines,
        coalesce(n_repeat_words, 0) as n_repeat_words, coalesce(n_lost_words, 0)::bigint as n_lost_words
      from d join w using (doc_id) left join dl using (doc_id) left join rep using (doc_id) left join lost using (doc_id))
select *, (n_words < {MIN_WORDS} or 100 * n_repeat_words > 50 * n_words) as base_failed,
  not (n_words < {MIN_WORDS} or 100 * n_repeat_words > 50 * n_words) and n_lost_words <= {LOST_SHARE} * n_words as kept
from m
"""

#: The same lines taken out: text without the host's frequent lines, in order.
CLEAN_SQL = f"""
with d as (select doc_id, coalesce(source, '') as host, text from documents),
s as (select doc_id, host, text, string_split(text, chr(10)) as lines from d),
ln as (select doc_id, host, text, unnest(lines) as line, unnest(range(1, len(lines) + 1)) as k from s),
nl as (select *, regexp_matches(line, '[^\\x20\\x09-\\x0D]') as worded, trim(regexp_replace(lower(line), '[\\x20\\x09-\\x0D]+', ' ', 'g')) as norm from ln),
cm as (select host, norm, true as worded, true as frequent from nl where worded group by host, norm having count(distinct text) > {LINE_DOCUMENTS}),
j as (select doc_id, line, k, coalesce(frequent, false) as frequent from nl left join cm using (host, norm, worded)),
c as (select doc_id, coalesce(string_agg(line, chr(10) order by k) filter (not frequent), '') as text, count(*) filter (frequent) as n_lost_lines from j group by doc_id)
select doc_id, case when d.text is null then null else c.text end as text, coalesce(n_lost_lines, 0) as n_lost_lines from d left join c using (doc_id)
"""
