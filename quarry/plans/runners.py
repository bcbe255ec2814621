"""Interfaces to model calls and code execution, with deterministic stand-ins."""

from __future__ import annotations

import hashlib
import os
import resource
import signal
import subprocess
import sys
import tempfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Call = Callable[[str, int], list[str]]
_RESULT = "status string, stdout string, stderr string"


def fake_model(prompt: str, n: int) -> list[str]:
    """n answers that depend on the prompt alone."""
    return [hashlib.md5(f"{i}|{prompt}".encode()).hexdigest() for i in range(n)]


def cached_calls(prompts: DataFrame, cache: DataFrame, call: Call = fake_model, n: int = 1, tries: int = 2) -> DataFrame:
    """``prompts(key, prompt)`` to ``(key, prompt, answers, error)``; known keys come from the cache.

    A cache row counts if it has at least n answers.  After ``tries`` failures the answers
    are null and the error is kept; nothing is raised.  ``cache`` has the result's columns.
    """
    known = cache.where(F.size("answers") >= n).dropDuplicates(["key"])
    hit = prompts.select("key", "prompt").join(known.select("key", F.slice("answers", 1, n).alias("answers"), "error"), "key")
    todo = prompts.select("key", "prompt").join(known.select("key"), "key", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, prompt in zip(pdf.key, pdf.prompt):
                answers, error = None, None
                for _ in range(tries):
                    try:
                        answers, error = call(prompt, n), None
                        break
                    except Exception as e:  # noqa: BLE001  the row carries it
                        error = repr(e)
                rows.append((key, prompt, answers, error))
            yield pd.DataFrame(rows, columns=["key", "prompt", "answers", "error"])

    fresh = todo.mapInPandas(run, "key string, prompt string, answers array<string>, error string")
    return hit.unionByName(fresh)


def append_cache(cache_path: str, calls: DataFrame) -> None:
    """Adds the answered rows of ``cached_calls`` to a cache table; failed ones are asked again next time."""
    calls.where("answers is not null").write.mode("append").parquet(cache_path)


def timed_map(df: DataFrame, col: str, fn: Callable, seconds: float = 10, result: str = "string") -> DataFrame:
    """Adds ``task`` as ``struct<status, result, error>`` of a function over a column, a row at a time.

    ``status`` is ``success``, ``failed`` (with the error) or ``timeout``; a row that takes
    longer than ``seconds`` is broken off by an alarm in its worker.  Null rows are passed on.
    """
    @F.pandas_udf(f"status string, result {result}, error string")
    def run(s: pd.Series) -> pd.DataFrame:
        def late(*_):
            raise TimeoutError

        rows = []
        old = signal.signal(signal.SIGALRM, late)
        try:
            for x in s:
                signal.setitimer(signal.ITIMER_REAL, seconds)
                try:
                    rows.append(("success", fn(x), None))
                except TimeoutError:
                    rows.append(("timeout", None, f"over {seconds} s"))
                except Exception as e:  # noqa: BLE001  the row carries it
                    rows.append(("failed", None, repr(e)))
                finally:
                    signal.setitimer(signal.ITIMER_REAL, 0)
        finally:
            signal.signal(signal.SIGALRM, old)
        return pd.DataFrame(rows, columns=["status", "result", "error"])

    return df.withColumn("task", run(F.col(col)))


#: Calls that code under test may not make.
GUARDED = {"os": ["kill", "system", "putenv", "remove", "removedirs", "rmdir", "fchdir", "setuid", "fork", "forkpty", "killpg", "rename", "renames", "truncate", "replace", "unlink", "fchmod", "fchown", "chmod", "chown", "chroot"], "shutil": ["rmtree", "move", "chown"], "subprocess": ["Popen"]}


def guarded(script: str) -> str:
    """The script behind lines that disable the guarded calls."""
    lines = [f"import {m}" for m in GUARDED] + [f"{m}.{f} = None" for m, fs in GUARDED.items() for f in fs]
    return "\n".join([*lines, *(f"del {m}" for m in GUARDED), script])


def run_guarded(script: str, seconds: float = 3) -> tuple[str, str, str]:
    """``run_script`` with the guarded calls disabled."""
    return run_script(guarded(script), seconds)


_TRACER = """
import json as _j, sys as _s
_seen, _lines = set(), set()
def _trace(frame, event, arg):
    if frame.f_code.co_filename != "<measured>":
        return None
    last = [None]
    def local(f, e, a):
        if e == "line":
            _lines.add(f.f_lineno)
            if last[0] is not None:
                _seen.add((last[0], f.f_lineno))
            last[0] = f.f_lineno
        elif e == "return" and last[0] is not None:
            _seen.add((last[0], -1))
        return local
    return local
_g = {"__name__": "measured"}
_code = compile(_source, "<measured>", "exec")
exec(_code, _g)
_s.settrace(_trace)
try:
    _g[_test]()
finally:
    _s.settrace(None)
print("\\n" + _mark + _j.dumps([sorted(_seen), sorted(_lines)]))
"""


def branch_coverage(script: str | None, name: str, test: str, seconds: float = 10) -> tuple[float | None, list[int]]:
    """Share of the branches of a function that its test takes, and its lines that were not reached.

    A branch is one of the two ways out of an ``if``, ``while`` or ``for`` line: into its
    body, or past it.  A function without any has 1.0.  The test runs in a process of its
    own; a failed run gives null and all lines.
    """
    import ast
    import json

    from quarry.functions.pyast import _find, safe_parse

    tree = safe_parse(script)
    found = _find(tree, name) if tree is not None else []
    if len(found) != 1:
        return None, []
    fn = found[0][1]
    forks = [n for n in ast.walk(fn) if isinstance(n, (ast.If, ast.While, ast.For))]
    lines = sorted({n.lineno for s in fn.body for n in ast.walk(s) if isinstance(n, ast.stmt)})
    if not forks:
        return 1.0, []
    mark = "measured:"
    status, out, _ = run_script(f"_source = {script!r}\n_test = {test!r}\n_mark = {mark!r}\n" + _TRACER, seconds)
    if status != "success" or mark not in out:
        return None, lines
    arcs, reached = json.loads(out.rpartition(mark)[2])
    into = {n.lineno: n.body[0].lineno for n in forks}
    taken = sum(any(a == line and b == body for a, b in arcs) + any(a == line and b != body for a, b in arcs) for line, body in into.items())
    return taken / (2 * len(into)), [x for x in lines if x not in set(reached)]


def measured(df: DataFrame, script: str, name: str) -> DataFrame:
    """Adds ``coverage`` as ``struct<rate, missing>``: each script gets a copy of its function as the new version and its test runs.

    Scripts without the function or its test get a null rate.
    """
    from quarry.functions.codetext import with_copy

    @F.pandas_udf("rate double, missing array<int>")
    def run(scripts: pd.Series, names: pd.Series) -> pd.DataFrame:
        rows = []
        for text, full in zip(scripts, names):
            last = full.rsplit(".", 1)[-1] if full else ""
            both = with_copy(text, full) if text and full else None
            owner = full.rpartition(".")[0] if full else ""
            fresh = f"{owner}.{last}_new_implementation" if owner else f"{last}_new_implementation"
            rows.append(branch_coverage(both, fresh, f"test_{last}") if both else (None, []))
        return pd.DataFrame(rows, columns=["rate", "missing"])

    return df.withColumn("coverage", run(F.col(script), F.col(name)))


def patched(files: dict[str, str], path: str, first: int, target: str, generation: str) -> dict[str, str] | None:
    """The files with the lines of ``target`` from ``first`` (0-based) on exchanged; null if code, comments aside, is unchanged."""
    rows = [r.rstrip() for r in files[path].split("\n")]
    new = [*rows[:first], *generation.split("\n"), *rows[first + len(target.rstrip("\n").split("\n")) :]]
    bare = lambda rs: [r for r in rs if r.strip() and not r.strip().startswith("#")]
    return None if bare(rows) == bare(new) else files | {path: "\n".join(new)}


def run_tests(files: dict[str, str], tests: list[str] | None = None, seconds: float = 600, each: float = 200) -> tuple[str, str]:
    """pytest over files in a folder of their own: ``(status, output)``; no collected test counts as success.

    Named tests run one by one until one fails.
    """
    with tempfile.TemporaryDirectory() as d:
        for path, text in files.items():
            full = os.path.join(d, path)
            os.makedirs(os.path.dirname(full), exist_ok=True)
            with open(full, "w", encoding="utf-8") as f:
                f.write(text)
        said = ""
        for args in [[t] for t in tests] if tests else [[]]:
            try:
                r = subprocess.run([sys.executable, "-m", "pytest", "-x", "-q", "-p", "no:cacheprovider", *args], cwd=d, capture_output=True, text=True, timeout=each if tests else seconds)
            except subprocess.TimeoutExpired:
                return "timeout", said + "timeout"
            said += r.stdout
            if r.returncode not in (0, 5):
                return "failed", said
        return "success", said


def patch_outcome(files: dict[str, str], path: str, first: int, target: str, generation: str, tests: list[str] | None = None) -> tuple[str, str]:
    """Tests of a repository with generated lines in place: unchanged code is a success without a run."""
    new = patched(files, path, first, target, generation)
    return ("success", "") if new is None else run_tests(new, tests)


def run_script(script: str, seconds: float = 10, memory_mb: int = 4096) -> tuple[str, str, str]:
    """Runs a Python script in a process group of its own: ``(status, stdout, stderr)``.

    Success needs exit code 0 and no ``error`` in any case on stderr.
    """
    def limits() -> None:
        os.setsid()
        resource.setrlimit(resource.RLIMIT_AS, (memory_mb << 20, memory_mb << 20))

    with tempfile.TemporaryDirectory() as d:
        p = subprocess.Popen([sys.executable, "-I", "-c", script], cwd=d, stdin=subprocess.DEVNULL, stdout=subprocess.PIPE, stderr=subprocess.PIPE, text=True, preexec_fn=limits)
        try:
            out, err = p.communicate(timeout=seconds)
        except subprocess.TimeoutExpired:
            os.killpg(p.pid, signal.SIGKILL)
            out, err = p.communicate()
            return "timeout", out, err
    return ("success" if p.returncode == 0 and "error" not in err.lower() else "error"), out, err


def fake_run(script: str) -> tuple[str, str, str]:
    """Success for scripts that compile, without running them."""
    try:
        compile(script, "<script>", "exec")
    except (SyntaxError, ValueError) as e:
        return "error", "", f"{type(e).__name__}: {e}"
    return "success", "", ""


def executed(df: DataFrame, script: str, runner: Callable[[str], tuple[str, str, str]] = fake_run) -> DataFrame:
    """Adds ``exec`` as ``struct<status, stdout, stderr>``; null scripts give null."""
    @F.pandas_udf(_RESULT)
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None,) * 3 if x is None else runner(x) for x in s], columns=["status", "stdout", "stderr"])

    return df.withColumn("exec", F.when(F.col(script).isNotNull(), run(F.col(script))))
