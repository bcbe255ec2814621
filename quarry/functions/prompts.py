"""Prompts of the pipeline as templates with named slots, filled as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import fill_slots
from quarry.operators.chat import message

_ANSWER = "Explain your steps first, then write the word SOLUTION and after it one ```python block with {{what}}. Write everything out; leave nothing away and abbreviate nothing."

#: Templates by name; ``{{slot}}`` is filled by a column.
PROMPTS: dict[str, str] = {
    "sandbox": "Make the function `{{func_name}}` runnable on its own.\n\nBelow is the Python code that holds it. Rewrite the code so that it runs in a sandbox without network, devices or other files. Keep what `{{func_name}}` does and how it does it; replace only what it needs from outside by small stand-ins.\n\nCODE:\n```python\n{{code}}\n```\n\n" + _ANSWER.replace("{{what}}", "the whole new code"),
    "aggregate_sandbox": "Make the function `{{func_name}}` runnable on its own, as one file.\n\nBelow is the Python code that holds it, and the parts of other files that it uses. Bring all that is needed together in one file that runs in a sandbox without network, devices or other files. Keep what `{{func_name}}` does and how it does it.\n\nCODE:\n```python\n{{code}}\n```\n\nFROM OTHER FILES:\n{{context}}\n\n" + _ANSWER.replace("{{what}}", "the whole new code"),
    "test_generation": "Write a test that compares two versions of a function.\n\nThe code below holds `{{func_name}}`. A second version named `{{func_name}}_new_implementation` will be added later; assume that it is there and do not write it. Add a function `{{test_func_name}}` with three assertions or more that call both versions with the same input and compare what they return or change, so that every branch of `{{func_name}}` is taken, and a main guard that calls it.\n\nCODE:\n```python\n{{code}}\n```\n\n" + _ANSWER.replace("{{what}}", "the whole code with `{{test_func_name}}` and the main guard"),
    "debug_script": "Repair a test script.\n\nThe code below holds `{{func_name}}` and its test `{{test_func_name}}`. With `{{func_name}}_new_implementation` set to a copy of `{{func_name}}` it should pass, but it fails with the message below. Change as little as possible, above all in the two functions, and keep three assertions or more and the main guard.\n\nCODE:\n```python\n{{code}}\n```\n\nMESSAGE:\n{{err_msg}}\n\n" + _ANSWER.replace("{{what}}", "the whole repaired code"),
    "coverage": "Extend a test so that it reaches more branches.\n\nThe code below holds `{{func_name}}` and its test `{{test_func_name}}`. The lines of `{{func_name}}_new_implementation` listed below are never run. Change `{{test_func_name}}` alone so that they are.\n\nCODE:\n```python\n{{code}}\n```\n\nLINES NOT RUN:\n{{missing_code}}\n\n" + _ANSWER.replace("{{what}}", "the whole function `{{test_func_name}}`"),
    "more_tests": "Add cases to a test.\n\nThe code below holds `{{func_name}}` and its test `{{test_func_name}}`. Add further cases to `{{test_func_name}}` and change nothing else.\n\nCODE:\n```python\n{{code}}\n```\n\n" + _ANSWER.replace("{{what}}", "the whole function `{{test_func_name}}`"),
    "sandbox_check": "Do these two versions of `{{func_name}}` do the same?\n\nThe second one was rewritten to run on its own. Stand-ins for files, services and devices do not count as a difference; a changed or missing step does.\n\nFIRST:\n```python\n{{orig_func}}\n```\n\nSECOND:\n```python\n{{new_code}}\n```\n\nWrite REASONING: and your reasons, then ANSWER: and one of the words same or no.",
    "test_check": "Is this test sound?\n\nThe code below holds `{{func_name}}`, a second version `{{func_name}}_new_implementation` and their test. It is sound if `{{func_name}}` returns or changes something, if the test compares just that for both versions, if it passes exactly when both do the same, and if its cases make sense.\n\nCODE:\n```python\n{{code}}\n```\n\nWrite REASONING: and your reasons, then ANSWER: and one of the words yes or no.",
    "instruction": "Write the docstring of `{{func_name}}` in the code below: what it does, its arguments and its result, as the code around it shows.\n\n```python\n{{code}}\n```\n",
    "debug": "The function `{{func_name}}` below is wrong. Write it anew, using the context and the message.\n\nCONTEXT:\n```python\n{{context}}\n```\n\nWRONG VERSION:\n```python\n{{buggy_solution}}\n```\n\nMESSAGE:\n{{error_msg}}\n",
    "debug_target": "```python\n{{solution}}\n```",
    "debug_reasoning": "The function `{{func_name}}` below is wrong. Say why, then write it anew, using the context and the message.\n\nCONTEXT:\n```python\n{{context}}\n```\n\nWRONG VERSION:\n```python\n{{buggy_solution}}\n```\n\nMESSAGE:\n{{error_msg}}\n\nWrite Reasoning: and your reasons, then one ```python block.\n",
    "debug_reasoning_target": "Reasoning: {{reasoning}}\n```python\n{{solution}}\n```",
    "evaluation": "Complete the function `{{func_name}}`. What comes before it:\n\n```python\n{{code}}\n```\n\nAnswer with one ```python block that holds the whole function.",
}


def prompt(name: str, **slots: Column) -> Column:
    """A prompt with its slots filled; a slot without a column is an error, null values become empty."""
    text = PROMPTS[name]
    import re

    missing = set(re.findall(r"\{\{(\w+)\}\}", text)) - set(slots)
    if missing:
        raise ValueError(f"no value for {', '.join(sorted(missing))}")
    return fill_slots(text, **slots)


_SHOT = {"func_name": "return_none", "context": "def return_none():\n", "buggy_solution": "    return 0", "error_msg": "AssertionError: expected None", "reasoning": "It returns 0 where None is asked for.", "solution": "    return None"}
_GOALS = {
    ("generate", False): "Continue the code.",
    ("generate", True): "Continue the code. Give your reasons first.",
    ("debug", False): "Repair the function, using its context and the error message.",
    ("debug", True): "Repair the function, using its context and the error message. Give your reasons first.",
}


def few_shot_messages(instruction: Column, func_name: Column | None = None, generation: Column | None = None, error: Column | None = None, debug: bool = False, reasoning: bool = False) -> Column:
    """One of the four chats (generate or debug, plain or with reasons): goal, a worked example, the task.

    ``array<struct<role, content>>``; the example stands in two system messages.
    """
    def fixed(name: str) -> str:
        text = PROMPTS[name]
        for k, v in _SHOT.items():
            text = text.replace("{{" + k + "}}", v)
        return text

    if debug:
        kind = "debug_reasoning" if reasoning else "debug"
        example, answer = fixed(kind), fixed(f"{kind}_target")
        task = prompt(kind, func_name=func_name, context=instruction, buggy_solution=generation, error_msg=error)
    else:
        tail = "\n\nWrite Reasoning: and your reasons, then one ```python block." if reasoning else ""
        ask = lambda code: "Continue this code:\n\n```\n" + code + "\n```" + tail
        example = ask(_SHOT["context"].rstrip("\n"))
        answer = fixed("debug_reasoning_target") if reasoning else "```\n" + _SHOT["solution"] + "\n```"
        before, after = ask("{{x}}").split("{{x}}")
        task = F.concat(F.lit(before), F.coalesce(instruction, F.lit("")), F.lit(after))
    return F.array(message("system", F.lit(_GOALS["debug" if debug else "generate", reasoning])), message("system", F.lit(example)), message("system", F.lit(answer)), message("user", task))


def with_prompt(df: DataFrame, name: str, column: str = "prompt", **slots: str) -> DataFrame:
    """Adds a prompt whose slots are filled by the named columns."""
    return df.withColumn(column, prompt(name, **{k: F.col(v) for k, v in slots.items()}))
