"""Quality rules with risk-controlled thresholds. DataFrame functions only.

Counts of each whole text feed fixed base rules and five rates. For each stratum (the document's language) and rate
a cutoff is chosen from a fixed ladder: the strictest at which labelled good documents of the stratum are
rejected with probability at most risk / number of rates. An exact binomial test certifies that:
of n good documents k lie beyond the cutoff, and P(Bin(n, risk) <= k) is at most delta divided by the number of all tests
(strata x rates x ladder steps, Bonferroni). Without a certified cutoff a rate rejects nothing in that stratum.
So with probability 1 - delta no stratum loses more than `risk` of its good documents to the cutoffs.

Null and empty texts have no words and fail the base rules. Null strata are a stratum of their own. Repeated
documents are judged one by one; of repeated labels for an id, the document counts as good if all say so.
Without labels no cutoff is certified and the base rules alone decide.

The 64-bit hash of a window of words stands for the window when a text is compared with itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_GAP, materialize, table

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
RISK, DELTA = 0.05, 0.05
#: Rates per mille (words: hundredths), and the ladder of cutoffs; a rate above its cutoff rejects.
LADDERS: dict[str, list[int]] = {
    "symbol_rate": [5, 10, 20, 30, 50, 80, 120, 200, 300, 500],
    "dup_line_rate": [50, 100, 150, 200, 300, 400, 500, 600, 700, 800],
    "repeat_rate": [10, 20, 40, 60, 80, 100, 150, 200, 250, 299],
    "long_words": [600, 650, 700, 750, 800, 900, 1000, 1200, 1500, 2000],
    "short_words": [-100, -200, -250, -300, -350, -400, -420, -440, -460, -480][::-1],
}


def _let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body names it."""
    return F.transform(F.array(value), body)[0]


def n_repeat_words(words: Column) -> Column:
    """Words of an array that lie in windows of WINDOW words which occur twice or more in it."""

    def covered(h: Column) -> Column:
        def union(starts: Column) -> Column:
            after = lambda i: F.coalesce(F.get(starts, i + 1) - F.get(starts, i), F.lit(WINDOW))
            return F.aggregate(F.transform(starts, lambda _, i: F.least(after(i), F.lit(WINDOW))), F.lit(0), lambda a, x: a + x)

        def repeated(s: Column) -> Column:
            twin = lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"])
            return F.array_sort(F.transform(F.filter(s, lambda x, i: F.coalesce(twin(x, i), F.get(s, i + 1)["h"] == x["h"], F.get(s, i - 1)["h"] == x["h"], F.lit(False))), lambda x: x["i"]))

        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_let(pairs, lambda s: _let(repeated(s), union)))

    last = F.size(words) - (WINDOW - 1)
    windows = F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    return F.when(last < 2, F.lit(0)).otherwise(_let(windows, covered)).cast("long")


def text_counts(df: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """df's columns named in keep, and n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    keep = df.columns if keep is None else keep
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    bare = text
    for s in SYMBOLS:
        bare = F.replace(bare, F.lit(s), F.lit(""))
    words = F.array_remove(F.split(text, WORD_GAP), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    kept = [F.col(f"`{c}`") for c in keep]
    counted = df.select(*kept, (F.length(text) - F.length(bare)).cast("long").alias("n_symbols"), words.alias("__words"), lines.alias("__lines"))
    return counted.select(
        *kept,
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        n_repeat_words(F.col("__words")).alias("n_repeat_words"),
    )


def rates() -> dict[str, Column]:
    per = lambda a, b, k: F.when(F.col(b) > 0, F.floor(F.col(a) * k / F.col(b))).otherwise(0).cast("long")
    return {
        "symbol_rate": per("n_symbols", "word_chars", 1000),
        "dup_line_rate": per("n_dup_lines", "n_lines", 1000),
        "repeat_rate": per("n_repeat_words", "n_words", 1000),
        "long_words": per("word_chars", "n_words", 100),
        "short_words": -per("word_chars", "n_words", 100),
    }


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), summed in logarithms; 1 where k is not below the mean, as no test passes there."""
    odds = F.log(F.lit(p)) - F.log1p(F.lit(-p))
    state = lambda t, s: F.struct(t.alias("t"), s.alias("s"))
    first = n.cast("double") * F.log1p(F.lit(-p))

    def step(a: Column, i: Column) -> Column:
        term = a["t"] + F.log((n - i + 1).cast("double") / i.cast("double")) + odds
        return state(term, a["s"] + F.exp(term))

    total = F.aggregate(F.sequence(F.lit(1).cast("long"), k), state(first, F.exp(first)), step, lambda a: a["s"])
    return F.when(n <= 0, F.lit(1.0)).when(k >= n * p, F.lit(1.0)).when(k < 1, F.exp(first)).otherwise(total)


def cutoffs(counted: DataFrame, good: DataFrame, risk: float = RISK, delta: float = DELTA, stratum: str = "stratum") -> DataFrame:
    """(stratum, a certified cutoff for each rate or null) from counted rows with an id and the ids in good(id)."""
    held = counted.where(~F.col("base_failed")).join(good, "id")
    each = held.groupBy(stratum).agg(F.count("*").alias("n"), *[F.count_if(F.col(r) > c).alias(f"{r}_{i}") for r, ladder in LADDERS.items() for i, c in enumerate(ladder)])
    strata = each.agg(F.count("*").alias("strata"))
    level = F.lit(delta) / (F.col("strata") * sum(map(len, LADDERS.values())))
    each = each.crossJoin(F.broadcast(strata))
    passes = lambda r, i: binomial_cdf(F.col(f"{r}_{i}"), F.col("n"), risk / len(LADDERS)) <= level
    return each.select(stratum, *[F.coalesce(*[F.when(passes(r, i), F.lit(c)) for i, c in enumerate(ladder)]).cast("long").alias(f"{r}_cutoff") for r, ladder in LADDERS.items()])


def judge(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """(id, stratum, counts, rates, base_failed, kept) for each row of df. labels(doc_id, quality): 1 is good."""
    counted = text_counts(df.select(F.col(id_col).alias("id"), F.col(stratum_col).alias("stratum"), F.col(text_col).alias("text")), keep=["id", "stratum"])
    counted = materialize(counted.withColumns(rates()).withColumn("base_failed", base_failed()), "quality-counts")
    good = labels.groupBy(F.col("doc_id").alias("id")).agg(F.min("quality").alias("q")).where("q = 1").select("id")
    limit = cutoffs(counted, good, risk, delta).withColumnRenamed("stratum", "__stratum")
    over = F.lit(False)
    for r in LADDERS:
        over = over | F.coalesce(F.col(r) > F.col(f"{r}_cutoff"), F.lit(False))
    judged = counted.join(limit, F.col("stratum").eqNullSafe(F.col("__stratum")), "left").drop("__stratum")
    return judged.withColumn("kept", ~F.col("base_failed") & ~over)


def query(spark, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql() -> str:
    """The query in SQL, from the same parameters."""
    gap = r"[\x20\x09-\x0D]"
    symbols = "[" + "".join("\\" + c for c in SYMBOLS) + "]"
    ladder = ", ".join(f"('{r}', {i}, {c})" for r, cuts in LADDERS.items() for i, c in enumerate(cuts))
    per = lambda a, b, k: f"case when {b} > 0 then {a} * {k} // {b} else 0 end"
    p = RISK / len(LADDERS)
    term = f"exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({p}::double) + (n - i) * ln(1 - {p}::double))"
    return f"""
with d as (select row_number() over () r, doc_id, lang, coalesce(text, '') t from documents),
w as (select *, list_filter(regexp_split_to_array(t, '{gap}+'), lambda x: x <> '') ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) ls from d),
win as (select r, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') s from (select r, ws, unnest(range(1, len(ws) - {WINDOW - 2})) i from w where len(ws) >= {WINDOW})),
dup as (select r, i from (select r, i, count(*) over (partition by r, s) c from win) where c > 1),
cov as (select r, count(distinct i + j) n from dup, range({WINDOW}) g(j) group by r),
c as (
  select w.r, doc_id, lang, len(ws) n_words, cast(length(array_to_string(ws, '')) as bigint) word_chars, cast(length(t) - length(regexp_replace(t, '{symbols}', '', 'g')) as bigint) n_symbols,
    len(ls) n_lines, len(ls) - len(list_distinct(ls)) n_dup_lines, coalesce(cov.n, 0) n_repeat_words
  from w left join cov using (r)),
b as (select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words base_failed,
    {per("n_symbols", "word_chars", 1000)} symbol_rate, {per("n_dup_lines", "n_lines", 1000)} dup_line_rate, {per("n_repeat_words", "n_words", 1000)} repeat_rate, {per("word_chars", "n_words", 100)} long_words, -({per("word_chars", "n_words", 100)}) short_words from c),
u as (unpivot (select r, lang, base_failed, {", ".join(f"cast({x} as bigint) {x}" for x in LADDERS)} from b) on {", ".join(LADDERS)} into name rate value v),
ladder(rate, step, cutoff) as (values {ladder}),
good as (select doc_id from labels group by doc_id having min(quality) = 1),
held as (select r, lang from b where not base_failed and doc_id in (select doc_id from good)),
n as (select lang, count(*) n, count(*) over () strata from held group by lang),
k as (select u.lang, rate, step, cutoff, count(*) filter (v > cutoff) k from u join ladder using (rate) where r in (select r from held) group by all),
tests as (select k.*, case when k >= n * {p} then 1.0 else list_sum(list_transform(range(k + 1), lambda i: {term})) end <= {DELTA}::double / (strata * {sum(map(len, LADDERS.values()))}) passes from k join n on k.lang is not distinct from n.lang),
cut as (select lang, rate, arg_min(cutoff, step) cutoff from tests where passes group by lang, rate),
over_ as (select distinct r from u join cut on u.rate = cut.rate and u.lang is not distinct from cut.lang where v > cutoff)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and r not in (select r from over_) kept from b"""


SQL = _sql()
