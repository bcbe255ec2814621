"""Scores and summaries as Catalyst aggregates."""

from __future__ import annotations

import math
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pass_at_k_value(n: Column, c: Column, k: int) -> Column:
    """1 - prod(1 - k / i) for i in n-c+1 .. n; 0 when nothing is correct, 1 when n - c < k."""
    fold = F.aggregate(F.sequence(n - c + 1, n), F.lit(1.0), lambda acc, i: acc * (F.lit(1.0) - F.lit(float(k)) / i))
    return F.when(n - c < k, F.lit(1.0)).when(c == 0, F.lit(0.0)).otherwise(F.lit(1.0) - fold)


def pass_counts(samples: DataFrame, problem: str, passed: Column) -> DataFrame:
    """``(problem, n, c)``; a null result counts as failed."""
    return samples.groupBy(problem).agg(F.count("*").cast("int").alias("n"), F.count_if(F.coalesce(passed, F.lit(False))).cast("int").alias("c"))


def pass_at_k(counts: DataFrame, ks: list[int]) -> DataFrame:
    """``(k, pass_at_k)`` over all problems, only for those k for which every problem has k samples."""
    rows = counts.select(F.col("n"), F.explode(F.array(*[F.struct(F.lit(k).alias("k"), pass_at_k_value(F.col("n"), F.col("c"), k).alias("v")) for k in ks])).alias("e"))
    sums = rows.groupBy("e.k").agg(F.avg("e.v").alias("pass_at_k"), F.min("n").alias("fewest"))
    return sums.where(F.col("fewest") >= F.col("k")).select("k", "pass_at_k")


def all_cases_pass(results: Column) -> Column:
    """A generation is right if it has cases and all are over 0 (-2: does not compile, -1: fails)."""
    return (F.size(results) > 0) & F.forall(results, lambda r: F.coalesce(r > 0, F.lit(False)))


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length, in code points; 1 for two empty texts."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(F.lit(1.0) - F.levenshtein(a, b) / longest)


def exact_match(a: Column, b: Column) -> Column:
    return (a == b).cast("int")


def distribution(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Mean, population deviation and the counts over 80, over 90 and of 100."""
    v = F.col(value)
    aggs = [F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.count_if(v > 80).alias("over_80"), F.count_if(v > 90).alias("over_90"), F.count_if(v == 100).alias("full")]
    return df.groupBy(*(by or [])).agg(*aggs)


def count_distribution(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Mean, population deviation and the counts of 1, of 2, over 5 and over 10 of whole numbers."""
    v = F.col(value)
    aggs = [F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.count_if(v == 1).alias("one"), F.count_if(v == 2).alias("two"), F.count_if(v > 5).alias("over_5"), F.count_if(v > 10).alias("over_10")]
    return df.groupBy(*(by or [])).agg(*aggs)


def execution_summary(runs: DataFrame, by: list[str]) -> DataFrame:
    """Counts by status, rows without a result and the distinct bases that succeeded."""
    s = F.col("status")
    return runs.groupBy(*by).agg(
        F.count("*").alias("runs"), F.count_if(s == "success").alias("success"), F.count_if(s == "error").alias("error"), F.count_if(s == "timeout").alias("timeout"),
        F.count_if(s.isNull()).alias("missing"), F.countDistinct(F.when(s == "success", F.col("base"))).alias("covered"),
    )


def error_type_counts(runs: DataFrame, text: Column) -> DataFrame:
    from quarry.functions.text import error_types

    return runs.select(F.explode(error_types(text)).alias("error_type")).groupBy("error_type").agg(F.count("*").alias("n"))


def rollup_accuracy(df: DataFrame, category: str, hit: Column, average: str = "Average") -> DataFrame:
    """Accuracy by category and over all rows, which get the name ``average``."""
    sums = df.rollup(category).agg(F.avg(hit.cast("double")).alias("accuracy"), F.count("*").alias("n"), F.grouping(category).alias("_all"))
    return sums.select(F.when(F.col("_all") == 1, average).otherwise(F.col(category)).alias("category"), "accuracy", "n")


def token_accuracy(predicted: Column, labels: Column, ignore: int = -100) -> Column:
    """Share of kept positions where prediction and label agree; labels are shifted by one."""
    pairs = F.zip_with(F.slice(predicted, F.lit(1), F.size(predicted) - 1), F.slice(labels, F.lit(2), F.size(labels) - 1), lambda p, y: F.when(y != ignore, (p == y).cast("double")))
    kept = F.filter(pairs, lambda x: x.isNotNull())
    return F.when(F.size(kept) > 0, F.aggregate(kept, F.lit(0.0), lambda a, x: a + x) / F.size(kept))


def reward_accuracy(df: DataFrame) -> DataFrame:
    return df.agg(F.avg((F.col("chosen") > F.col("rejected")).cast("double")).alias("accuracy"))


#: The public NIST rules of tokenisation, in their order.
NIST_JOIN = [("<skipped>", ""), (r"-\n", ""), (r"\n", " ")]
NIST_XML = [("&gt;", ">"), ("&lt;", "<"), ("&quot;", '"'), ("&amp;", "&")]
NIST_SPLIT = [(r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", " $1 "), (r"([^0-9])([\.,])", "$1 $2 "), (r"([\.,])([^0-9])", " $1 $2"), (r"([0-9])(-)", "$1 $2 ")]


def normalise_for_bleu(col: Column) -> Column:
    """Blank-separated lower-case tokens with punctuation set apart by the public rules."""
    c = col
    for pattern, new in NIST_JOIN:
        c = F.regexp_replace(c, pattern, new)
    for name, sign in NIST_XML:
        c = F.replace(c, F.lit(name), F.lit(sign))
    c = F.concat(F.lit(" "), F.lower(c), F.lit(" "))
    for pattern, new in NIST_SPLIT:
        c = F.regexp_replace(c, pattern, new)
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def _bleu(pred: list[str], refs: list[list[str]], most: int) -> float:
    if not pred or not any(set(pred) & set(r) for r in refs):
        return 0.0
    grams = lambda ws, n: Counter(zip(*(ws[i:] for i in range(n))))
    total = 0.0
    for n in range(1, most + 1):
        best: Counter = Counter()
        for r in refs:
            best |= grams(r, n)
        extra = n > 1
        total += math.log(((grams(pred, n) & best).total() + extra) / (max(len(pred) - n + 1, 0) + extra))
    return math.exp(total / most + min(0.0, 1 - (min(map(len, refs)) + 1) / (len(pred) + 1)))


def smoothed_bleu(pred: Column, refs: Column, most: int = 4) -> Column:
    """Smoothed sentence BLEU of a token array against an array of references, 0..1; null where one is null.

    An n-gram counts as often as it stands in the reference that has it most.  Precisions of
    2..n grams get one added to both counts; the brevity penalty is
    min(0, 1 - (ref + 1) / (pred + 1)) with the shortest reference.  No common word gives 0.
    """
    @F.pandas_udf("double")
    def run(preds: pd.Series, many: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or rs is None else _bleu(list(p), [list(r) for r in rs if r is not None] or [[]], most) for p, rs in zip(preds, many)], dtype="float64")

    return F.when(pred.isNotNull() & refs.isNotNull(), run(pred, refs))


def rouge_n(pred: Column, ref: Column, n: int) -> Column:
    """F1 of the n-grams of two token arrays, counted with repetitions; 0 where one has none."""
    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        grams = lambda ws: Counter(zip(*(ws[i:] for i in range(n))))
        out = []
        for x, y in zip(a, b):
            if x is None or y is None:
                out.append(None)
                continue
            gx, gy = grams(list(x)), grams(list(y))
            total = gx.total() + gy.total()
            out.append(2 * (gx & gy).total() / total if gx and gy else 0.0)
        return pd.Series(out, dtype="float64")

    return F.when(pred.isNotNull() & ref.isNotNull(), run(pred, ref))


def rouge_l(pred: Column, ref: Column) -> Column:
    """F1 of the longest common subsequence of two token arrays; 0 where one is empty.

    The subsequence is found bit by bit: a word of the prediction updates a whole row of
    the alignment table at once, as one integer.
    """
    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else 2 * common_length(list(x), list(y)) / (len(x) + len(y)) if len(x) and len(y) else 0.0 for x, y in zip(a, b)], dtype="float64")

    return F.when(pred.isNotNull() & ref.isNotNull(), run(pred, ref))


def common_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence."""
    places: dict[str, int] = {}
    for i, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        hit = row & places.get(x, 0)
        row = (row + hit | row - hit) & full
    return len(b) - row.bit_count()


def repo_summary(results: DataFrame) -> DataFrame:
    """One row over ``results(em, es, status)``: means of both scores, share that passed, rows run and rows out of time.

    Without rows all means are null.  A null status was not run and counts for no share.
    """
    ran = F.col("status").isNotNull()
    return results.agg(
        F.avg("em").alias("em"), F.avg("es").alias("es"), F.avg(F.when(ran, (F.col("status") == "success").cast("double"))).alias("pass_1"),
        F.count_if(ran).alias("computed"), F.count_if(F.coalesce(F.col("status") == "timeout", F.lit(False))).alias("timeouts"),
    )


def answers_agree(output: Column, expected: Column) -> Column:
    """Comparison of program output with the expected text, from strict to loose.

    Whole texts without outer blanks; stripped lines; lines without empty ones; numbers
    within 1e-8 + 1e-5 * |expected|; the sets of words.
    """
    from quarry.functions.text import lines, strip

    stripped = lambda c: F.transform(lines(strip(c)), strip)
    filled = lambda c: F.filter(stripped(c), lambda x: x != "")
    nums = lambda c: F.transform(F.split(strip(c), r"\s+"), lambda x: x.try_cast("double"))
    a, b = nums(output), nums(expected)
    close = (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y) <= F.lit(1e-8) + F.lit(1e-5) * F.abs(y)), lambda t: F.coalesce(t, F.lit(False)))
    words = lambda c: F.array_sort(F.array_distinct(F.split(strip(c), r"\s+")))
    return F.coalesce((strip(output) == strip(expected)) | (stripped(output) == stripped(expected)) | (filled(output) == filled(expected)) | close | (words(output) == words(expected)), F.lit(False))


def dataset_stats(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows, repositories, mean coverage, and rows that were checked by tree or have more than one branch, before and after a filter."""
    def one(name: str, df: DataFrame) -> DataFrame:
        return df.agg(F.count("*").alias("records"), F.countDistinct("repo").alias("repos"), F.avg(F.when(F.col("coverage_rate") >= 0, F.nanvl("coverage_rate", F.lit(None).cast("double")))).alias("mean_coverage"), F.count_if("sandbox_ast_check").alias("ast_checked"), F.count_if(F.col("n_branches") > 1).alias("multi_branch")).select(F.lit(name).alias("stage"), "*")

    return one("before", before).unionByName(one("after", after))
