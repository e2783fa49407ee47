"""Operator 8, quality rules: a threshold table compiled into one projection of built-in functions.

``RULES`` is the table: each row names a sum of measures, a comparison and a limit; a document is rejected
when any rule fires. :func:`measures` is one Spark projection without user functions, and the table is
compiled over it. Null texts count as empty (no words); repeated rows are judged alike; ties: a sum that equals its limit passes; a text of any length
is one row of a projection, and its windows are sorted in n log n. An empty table gives no rows. Ids may be of
any type; columns of the input that are not asked for, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import BLANKS, let, table, words

#: Frequent function words of the four languages.
STOP_WORDS = (
    "the of and to in a is that it for on was with as by at be are this from or an not have "
    "le la les de des du et un une est que qui dans pour sur par avec au en ne pas il elle "
    "der die das und zu den von mit ist im nicht ein eine auf dem des sich es auch an für "
    "el los las y que del se por con una para es al lo como su no o"
).split()
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """Reject where a sum of measures times whole numbers is above (``>``) or below (``<``) a limit, for at least ``least_words`` words."""

    name: str
    sum_of: dict[str, int]
    op: str
    limit: int
    least_words: int = 0

    def fires(self, measure: Callable[[str], Column]) -> Column:
        value = reduce(add, [measure(name) * factor for name, factor in self.sum_of.items()])
        held = value > self.limit if self.op == ">" else value < self.limit
        return held & (measure("n_words") >= self.least_words) if self.least_words else held

    def sql(self) -> str:
        held = f"{' + '.join(f'({factor}) * {name}' for name, factor in self.sum_of.items())} {self.op} {self.limit}"
        return f"(n_words >= {self.least_words} and {held})" if self.least_words else f"({held})"


#: Whole numbers on both sides, so that Spark and any SQL engine agree to the row.
BASE_RULES = (
    Rule("few_words", {"n_words": 1}, "<", 10),
    Rule("repeated_windows", {"n_repeat_words": 100, "n_words": -20}, ">", 0),
)
RULES = (
    Rule("long_words", {"word_chars": 1, "n_words": -25}, ">", 0),
    Rule("short_words", {"word_chars": 1, "n_words": -2}, "<", 0, 20),
    Rule("symbols", {"n_symbols": 100, "word_chars": -8}, ">", 0),
    Rule("few_stop_words", {"n_stop_words": 1000, "n_words": -5}, "<", 0, 100),
    Rule("repeated_lines", {"n_dup_lines": 10, "n_lines": -7}, ">", 0, 20),
)


def rejects(rules: tuple[Rule, ...], measure: Callable[[str], Column]) -> Column:
    """The table as one boolean column: true where a rule fires."""
    return reduce(or_, [r.fires(measure) for r in rules], F.lit(False))


def rejects_sql(rules: tuple[Rule, ...]) -> str:
    return " or ".join(r.sql() for r in rules) or "false"


def _repeat_words(w: Column) -> Column:
    """Words inside 5-word windows that occur at least twice; windows are compared by 64-bit hash."""

    def covered(h: Column) -> Column:
        by_hash = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def positions(s: Column) -> Column:
            n = F.size(s)
            same = lambda j, k: s[j]["h"] == s[k]["h"]
            twice = F.filter(
                F.sequence(F.lit(0), n - 1),
                lambda j: ((j > 0) & same(j, F.greatest(j - 1, F.lit(0)))) | ((j < n - 1) & same(j, F.least(j + 1, n - 1))),
            )
            return F.array_sort(F.transform(twice, lambda j: s[j]["i"]))

        def union(p: Column) -> Column:
            gaps = F.zip_with(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))), lambda b, a: F.least(b - a, F.lit(WINDOW)))
            return F.when(F.size(p) == 0, F.lit(0)).otherwise(F.aggregate(gaps, F.lit(WINDOW), lambda acc, g: acc + g))

        return let(let(by_hash, positions), union)

    hashes = F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*[w[i + k] for k in range(WINDOW)]))
    whole = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
    return F.when(F.size(w) < WINDOW + 1, F.lit(0)).otherwise(whole)


def measures(text: Column, repeats: bool = True) -> Column:
    """A struct of the counts that the rules read, each a long; without ``repeats`` the dearest one is left out."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda line: F.btrim(line, F.lit(BLANKS)) != "")

    def of_words(w: Column) -> list[Column]:
        return [
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
            *([_repeat_words(w).cast("long").alias("n_repeat_words")] if repeats else []),
        ]

    def of_lines(n: Column) -> Column:
        return F.struct(F.size(n).cast("long").alias("n"), (F.size(n) - F.size(F.array_distinct(n))).cast("long").alias("dup"))

    symbols = (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", ""))).cast("long")
    return let(
        F.struct(words(text).alias("w"), let(lines, of_lines).alias("l"), symbols.alias("s")),
        lambda v: F.struct(*of_words(v["w"]), v["s"].alias("n_symbols"), v["l"]["n"].alias("n_lines"), v["l"]["dup"].alias("n_dup_lines")),
    )


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per row of ``docs``: the id, the measures, ``base_failed`` and ``kept``."""
    found = docs.select(F.col(id_col).alias("doc_id"), measures(F.col(text_col)).alias("m")).select("doc_id", "m.*")
    out = found.withColumn("base_failed", rejects(BASE_RULES, F.col))
    return out.withColumn("kept", ~F.col("base_failed") & ~rejects(rules, F.col))


def keep(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that pass, with their columns as they are."""
    return docs.filter(let(measures(F.col(text_col)), lambda m: ~rejects(BASE_RULES + rules, lambda name: m[name])))


COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select(*COLUMNS)


#: The same for DuckDB, over whole texts.
ORACLE_SQL = rf"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
w as (select r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w from d),
win as (select r, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] || ' ' || w[i+4] as g
        from (select r, w, unnest(range(1, len(w) - 3)) as i from w)),
rep as (select r, i from (select r, i, count(*) over (partition by r, g) as c from win) where c > 1),
cov as (select r, count(distinct i + k) as n_repeat_words from rep, (select unnest(range(0, 5)) as k) group by r),
m as (
  select w.doc_id, len(w) as n_words, length(array_to_string(w, '')) as word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols,
    len(list_filter(w, lambda x: list_contains([{', '.join(f"'{x}'" for x in STOP_WORDS)}], lower(x)))) as n_stop_words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines,
    coalesce(n_repeat_words, 0) as n_repeat_words
  from w left join cov using (r)),
n as (select *, len(lines) as n_lines, len(lines) - len(list_distinct(lines)) as n_dup_lines from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  ({rejects_sql(BASE_RULES)}) as base_failed, not ({rejects_sql(BASE_RULES)}) and not ({rejects_sql(RULES)}) as kept
from n
"""
