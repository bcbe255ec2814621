"""Benchmark tasks and summaries of generated tests."""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import cut_at_stops, first_code_piece, wrap_context
from quarry.operators import metrics


class Task(ABC):
    """A benchmark: rows, prompts, references, answers to code, scores.  All steps are column expressions or frames."""

    name = ""
    stops: list[str] = []

    @abstractmethod
    def rows(self, spark, path: str) -> DataFrame: ...

    @abstractmethod
    def prompt(self) -> Column: ...

    @abstractmethod
    def reference(self) -> Column: ...

    def postprocess(self, answer: Column) -> Column:
        code = first_code_piece(answer)
        return cut_at_stops(code, self.stops) if self.stops else code

    def score(self, results: DataFrame, ks: list[int]) -> DataFrame:
        """``results(task_id, passed)`` to pass@k."""
        return metrics.pass_at_k(metrics.pass_counts(results, "task_id", F.col("passed")), ks)


TASKS: dict[str, type[Task]] = {}


def register(task: type[Task]) -> type[Task]:
    TASKS[task.name] = task
    return task


def matching(patterns: list[str]) -> list[str]:
    """Registered task names that match any of the glob patterns."""
    from fnmatch import fnmatch

    return sorted(n for n in TASKS if any(fnmatch(n, p) for p in patterns))


class LinesTask(Task):
    """A benchmark kept as JSON lines; ``docs`` is an optional column of retrieved documents."""

    prompt_col, reference_col = "prompt", "test"

    def rows(self, spark, path):
        from quarry.sources.readers import json_lines

        return json_lines(spark, path)

    def prompt(self):
        return F.col(self.prompt_col)

    def reference(self):
        return F.col(self.reference_col)


#: Stop words of public benchmarks.
_STOPS = {
    "humaneval": ["\nclass", "\ndef", "\n#", "\n@", "\nprint", "\nif"],
    "mbpp": ["\nclass", "\nassert", '\n"""', "\nprint", "\nif"],
    "odex": ["\nclass", "\nprint", "\n#"],
    "ds1000": ["</code>", "# SOLUTION END"],
}


@register
class HumanEval(LinesTask):
    """Completion of a function; the test calls the entry point."""

    name, stops = "humaneval", _STOPS["humaneval"]

    def reference(self):
        return F.concat(F.col("test"), F.lit("\ncheck("), F.col("entry_point"), F.lit(")"))


@register
class Mbpp(LinesTask):
    """A task in words with its first test as the example; all tests are the reference."""

    name, stops = "mbpp", _STOPS["mbpp"]

    def prompt(self):
        return F.concat(F.lit('"""\n'), F.col("text"), F.lit("\n"), F.coalesce(F.get("test_list", F.lit(0)), F.lit("")), F.lit('\n"""\n'))

    def reference(self):
        return F.array_join("test_list", "\n")


@register
class Odex(LinesTask):
    """Completion of a function whose intent stands in its docstring; the tests are joined behind their start."""

    name, stops = "odex", _STOPS["odex"]

    def reference(self):
        return F.concat(F.coalesce("test_start", F.lit("")), F.array_join("test", ""), F.lit("\ncheck("), F.col("entry_point"), F.lit(")"))


@register
class Ds1000(LinesTask):
    """Code behind a start mark; what follows the solution's end is cut."""

    name, stops, reference_col = "ds1000", _STOPS["ds1000"], "reference_code"

    def postprocess(self, answer):
        tail = F.when(F.contains(answer, F.lit("BEGIN SOLUTION")), F.substring_index(answer, "BEGIN SOLUTION", -1)).otherwise(answer)
        return cut_at_stops(first_code_piece(tail), self.stops)


@register
class LiveCodeBench(LinesTask):
    """A question, with its starter code where there is one; programs without it read the standard input."""

    name, reference_col = "live_code_bench", "public_test_cases"

    def prompt(self):
        starter = F.coalesce("starter_code", F.lit(""))
        how = F.when(F.length(starter) > 0, F.concat(F.lit("Use this beginning:\n```python\n"), starter, F.lit("\n```\n"))).otherwise(F.lit("Read from standard input and write to standard output.\n"))
        return F.concat(F.col("question_content"), F.lit("\n\n"), how)


@register
class RepoEval(LinesTask):
    """Completion inside a file of a repository; as many lines count as the reference has."""

    name, reference_col = "repoeval", "reference"


@register
class SweBench(LinesTask):
    """An issue with the code around it."""

    name, reference_col = "swebench", "patch"

    def prompt(self):
        return F.coalesce(F.col("text"), F.col("problem_statement"))


def with_context(prompt: Column, docs: Column, k: int) -> Column:
    """The k best documents as commented context before the prompt; without documents the prompt alone."""
    return F.when(F.coalesce(F.size(docs), F.lit(0)) > 0, F.concat(wrap_context(F.slice(docs, 1, k)), F.lit("\n"), prompt)).otherwise(prompt)


def shared_budget(prompt_tokens: Column, docs_tokens: Column, most: int) -> tuple[Column, Column]:
    """Half of a budget for each of retrieved text (cut at its end) and own file (cut at its start)."""
    half = most // 2
    return F.slice(docs_tokens, F.lit(1), F.lit(max(half - 2, 0))), F.slice(prompt_tokens, F.greatest(F.size(prompt_tokens) - half + 1, F.lit(1)), F.lit(half))


def test_summary(runs: DataFrame) -> DataFrame:
    """One row over ``runs(id, valid, passed, failed, errored, branch_coverage)`` with null for tests that did not run."""
    ran = F.col("valid").isNotNull()
    total = F.coalesce("passed", F.lit(0)) + F.coalesce("failed", F.lit(0)) + F.coalesce("errored", F.lit(0))
    return runs.agg(
        F.countDistinct("id").alias("functions"), F.countDistinct(F.when(ran, F.col("id"))).alias("runnable"), F.countDistinct(F.when(F.col("valid"), F.col("id"))).alias("valid"),
        (F.countDistinct(F.when(F.col("valid"), F.col("id"))) * 100.0 / F.nullif(F.countDistinct("id"), F.lit(0))).alias("valid_percent"), F.avg(F.when(F.col("valid"), F.col("branch_coverage"))).alias("branch_coverage"),
        (F.sum("passed") / F.nullif(F.sum(total), F.lit(0))).alias("pass_ratio"), F.count_if(ran & (total > 0) & (F.col("failed") == total)).alias("all_failed"), F.count_if(ran & (total > 0) & (F.col("errored") == total)).alias("all_errored"),
    )
