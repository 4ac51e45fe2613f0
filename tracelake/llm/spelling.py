"""Spelling variants by wildcard groups, without a table of pairs.

Each word is written once for each of its places with that code point left out: (place, rest), where
rest is the prefix and the suffix around the place. Words that differ by one replaced code point are
those of one (place, rest) group, of which each row sees the size and the two most frequent words.
Words themselves stand under their own text, so a rest that is a word tells an inserted or deleted
code point: the word sees how many rests it is and the most frequent word behind them, and each rest
sees the word. A group has as many rows as its alphabet has letters, times the places of the rest,
however frequent its words are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.shared import settle, written

#: Latin letters of the first 256 code points, with the two signs that lie between them.
LETTERS = r"[A-Za-zÀ-ÿ]+"
LEAST_LENGTH = 5
LEAST_USES = 3
#: A form is used so many times as often as the word that is a variant of it.
TIMES = 2


def lowered(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def without_place(word: Column, place: Column) -> Column:
    """The word without its code point at `place`, counted from 0."""
    return F.concat(F.substring(word, F.lit(1), place), F.substring(word, place + 2, F.char_length(word)))


def misspelt(run: Column, row_id: Column, every: int = 97) -> Column:
    """`run` with one code point left out where `every` divides the crc32 of `<row id>:<run>`; the crc also tells the place."""
    h = F.crc32(F.concat(F.coalesce(row_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    return F.when(h % every == 0, without_place(run, (h % F.char_length(run)).cast("int"))).otherwise(run)


def word_uses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int | None = None) -> DataFrame:
    """word, n: how often each run of letters stands in all texts (null: none), A-Z lower-cased; with `every`, runs are misspelt first."""
    run = docs.select(F.col(id_col).alias("row_id"), F.explode(F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(LETTERS), F.lit(0))).alias("run"))
    run = run.select("row_id", lowered(F.col("run")).alias("run"))
    word = misspelt(F.col("run"), F.col("row_id"), every) if every else F.col("run")
    return run.select(word.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def variants(uses: DataFrame, least_length: int = LEAST_LENGTH, least_uses: int = LEAST_USES, times: int = TIMES) -> DataFrame:
    """One row per word of `uses` (word, n; words are distinct) with enough code points and uses: word, form, root, n, n_near, form_n.

    Two words are near if they differ by exactly one inserted, deleted or replaced code point; n_near
    counts the near words. The form is the near word of largest n (ties: smallest in code-point order) if
    that is `times` the word's n or more, else null. The root is where following forms from the word ends.
    Null words are left out; without words the result is empty.
    """
    words = settle(uses.filter((F.char_length("word") >= least_length) & (F.col("n") >= least_uses)).select("word", F.col("n").cast("long").alias("n")))
    ranked = F.struct((-F.col("n")).alias("less"), "word")  # the least of these has the largest n
    nobody = F.lit(None).cast("struct<less:bigint,word:string>")
    rests = words.select("word", "n", F.explode(F.sequence(F.lit(0), F.char_length("word") - 1)).alias("place"))
    rests = rests.select("word", "n", "place", without_place(F.col("word"), F.col("place")).alias("rest"))
    # In a run of equal code points every place leaves the same rest.
    before = F.substring(F.col("word"), F.col("place"), F.lit(1))
    rests = rests.withColumn("once", (F.col("place") == 0) | (F.substring(F.col("word"), F.col("place") + 1, F.lit(1)) != before))
    rows = rests.unionByName(words.select("word", "n", F.lit(-1).alias("place"), F.col("word").alias("rest"), F.lit(False).alias("once")))
    group = Window.partitionBy("rest", "place").orderBy(F.desc("n"), "word").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    same_rest = Window.partitionBy("rest")
    rows = rows.select(
        "word", "n", "place", "once",
        F.count(F.lit(1)).over(group).alias("size"), F.first(ranked).over(group).alias("top"), F.nth_value(ranked, 2).over(group).alias("second"),
        F.min(F.when(F.col("place") == -1, ranked)).over(same_rest).alias("shorter"), F.min(F.when(F.col("once"), ranked)).over(same_rest).alias("longer"), F.count(F.when(F.col("once"), 1)).over(same_rest).alias("n_longer"),
    )
    own = F.col("place") == -1
    replaced = F.when(F.col("top.word") != F.col("word"), F.col("top")).otherwise(F.col("second"))
    deleted = F.when(F.col("once"), F.col("shorter"))
    best = F.when(own, F.col("longer")).otherwise(F.least(F.coalesce(replaced, deleted, nobody), F.coalesce(deleted, replaced, nobody)))
    count = F.when(own, F.col("n_longer")).otherwise(F.col("size") - 1 + deleted.isNotNull().cast("long"))
    near = rows.select("word", "n", count.alias("near"), best.alias("best")).groupBy("word").agg(F.max("n").alias("n"), F.sum("near").alias("n_near"), F.min("best").alias("best"))
    frequent = -F.col("best.less") >= times * F.col("n")
    near = written(near.select("word", "n", "n_near", F.when(frequent, F.col("best.word")).alias("form"), F.when(frequent, -F.col("best.less")).alias("form_n")), "near")
    roots = chain_ends(near.filter("form is not null").select("word", F.col("form").alias("root")))
    return near.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def chain_ends(steps: DataFrame) -> DataFrame:
    """word, root for rows (word, root) that each lead one step on; every round doubles the steps taken. Chains have no cycle.

    Steps are written as a table, without a partitioning, so a join splits a root that many words lead to.
    """
    while True:
        on = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        steps = written(steps.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "steps")
        if steps.filter("moved").isEmpty():
            return steps.drop("moved")
        steps = steps.drop("moved")


#: crc32 is built from its 256 remainders, which the polynomial gives.
ORACLE_SQL = """
with recursive tab as (select list(list_reduce(list_prepend(i::ubigint, range(8)::ubigint[]), lambda x, k: case when x & 1 = 1 then xor(x >> 1, 3988292384::ubigint) else x >> 1 end) order by i) as tab from range(256) r(i)),
runs as (select doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run, count(*) as c
  from (select doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) as run from documents) group by all),
hexed as (select run, c, hex(encode(doc_id || ':' || run)) as hx from runs),
crcs as (select run, c, xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(range(0, length(hx), 2), lambda i: ('0x' || substr(hx, i + 1, 2))::ubigint)), lambda x, b: xor(tab[(xor(x, b) & 255)::bigint + 1], x >> 8)), 4294967295::ubigint) as h from hexed, tab),
words as (select case when h % 97 = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, sum(c)::bigint as n from crcs group by 1),
v as (select * from words where length(word) >= 5 and n >= 3),
holes as (select word, n, p, substr(word, 1, p) || substr(word, p + 2) as rest from (select word, n, unnest(range(length(word)))::int as p from v)),
pairs as (select a.word, b.word as other, b.n as other_n from holes a join holes b on a.rest = b.rest and a.p = b.p and a.word <> b.word
  union select h.word, v.word, v.n from holes h join v on h.rest = v.word
  union select v.word, h.word, h.n from holes h join v on h.rest = v.word),
best as (select word, count(*) as n_near, arg_max(other, (other_n, -k)) as form, max(other_n) as form_n from (select *, row_number() over (order by encode(other)) as k from pairs) group by word),
f as (select v.word, v.n, coalesce(n_near, 0) as n_near, case when form_n >= 2 * n then form end as form, case when form_n >= 2 * n then form_n end as form_n from v left join best using (word)),
walk as (select word, word as root from f union all select walk.word, f.form from walk join f on f.word = walk.root where f.form is not null),
ends as (select walk.word, walk.root from walk join f on f.word = walk.root where f.form is null)
select f.word, f.form, ends.root, f.n, f.n_near, f.form_n from f join ends using (word)
"""
