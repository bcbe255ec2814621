"""Line-level functions over generated code, for use through ``pyast.per_row``.

Indentation is counted after tabs are expanded.  Null in gives null out.
"""

from __future__ import annotations

import ast
import os
import re

from quarry.functions.pyast import definitions, function_lines, function_text, replace_function, safe_parse

_FENCE = re.compile(r"```(?:\w*)[ \t]*\n(.*?)(?:\n[ \t]*```|\Z)", re.S)


def indent_of(line: str) -> int:
    wide = line.expandtabs(4)
    return len(wide) - len(wide.lstrip())


def reindented(code: str, to: int) -> str:
    """The block moved so that its least indented line starts at column ``to``."""
    rows = code.expandtabs(4).splitlines()
    least = min((indent_of(r) for r in rows if r.strip()), default=0)
    return "\n".join(" " * to + r[least:] if r.strip() else "" for r in rows)


def moved(code: str, lead: str) -> str:
    """The block with the blanks that all its lines begin with exchanged for ``lead``; tabs stay tabs."""
    rows = code.splitlines()
    heads = [re.match(r"[ \t]*", r).group() for r in rows if r.strip()]
    shared = len(os.path.commonprefix(heads))
    return "\n".join(lead + r[shared:] if r.strip() else r for r in rows)


def body_until_dedent(code: str | None, name: str) -> str | None:
    """The body of a generated function: everything after its header until the text returns to the header's depth.

    Decorators and imports before the header are skipped.  Comments and blank lines never
    end the body.  Text without the header counts as a body itself.
    """
    if code is None:
        return None
    rows = code.splitlines()
    start, depth = 0, -1
    for i, row in enumerate(rows):
        if re.match(rf"\s*(?:async\s+)?def\s+{re.escape(name)}\b", row):
            depth = indent_of(row)
            start = i
            while start < len(rows) and not re.search(r":\s*(?:#.*)?$", rows[start]):
                start += 1
            start += 1
            break
    kept = []
    for row in rows[start:]:
        if depth < 0 and row.strip():
            depth = indent_of(row) - 1
        if row.strip() and not row.lstrip().startswith("#") and indent_of(row) <= depth:
            break
        kept.append(row)
    return "\n".join(kept).rstrip()


def target_body(answer: str | None, name: str) -> str | None:
    """A body fit as training target: without docstring and leading blank lines; null if only comments are left."""
    body = body_until_dedent(answer, name)
    if body is None:
        return None
    text = re.sub(r'\A\s*(?:\n)*[ \t]*(?:"""(?:.|\n)*?"""|\'\'\'(?:.|\n)*?\'\'\')[ \t]*\n?', "", body)
    text = re.sub(r"\A(?:[ \t]*\n)+", "", text)
    return text if any(r.strip() and not r.strip().startswith("#") for r in text.splitlines()) else None


def first_lines_like(prediction: str | None, target: str | None) -> str | None:
    """As many code lines of the prediction as the target has."""
    if prediction is None or target is None:
        return None
    code = lambda t: [r for r in t.splitlines() if r.strip() and not r.strip().startswith("#")]
    return "\n".join(code(prediction)[: len(code(target))])


def renamed(code: str | None, old: str, new: str) -> str | None:
    """The first definition of ``old`` gets the name ``new``; calls are left alone."""
    return None if code is None else re.sub(rf"(\bdef\s+){re.escape(old)}\b", rf"\g<1>{new}", code, count=1)


def evaluation_script(script: str | None, answer: str | None, name: str, beside: bool = False) -> str | None:
    """The script with the answer in place of the function, or beside it as ``<name>_new_implementation``.

    Null when the answer holds no such function or the script none to replace.
    """
    if script is None or answer is None:
        return None
    fenced = _FENCE.search(answer)
    code = fenced.group(1) if fenced else answer
    last = name.rsplit(".", 1)[-1]
    fresh = function_text(code, last)
    if fresh is None:
        tree = safe_parse(code)
        fresh = next((function_text(code, f"{c}.{f.name}") for c, f in definitions(tree) if f.name == last and c), None) if tree else None
    at = function_lines(script, name)
    if fresh is None or at is None:
        return None
    if not beside:
        return replace_function(script, name, moved(fresh, ""))
    return inserted_after(script, name, renamed(moved(fresh, ""), last, f"{last}_new_implementation"))


def with_pragmas(script: str | None, first: int, last: int) -> str | None:
    """Marks every code line outside the 0-based range as not to be covered."""
    if script is None:
        return None
    rows = script.split("\n")
    return "\n".join(r if first <= i <= last or not r.strip() else r + "  # pragma: no cover" for i, r in enumerate(rows))


def with_unevaluated(code: str | None, lines: list[int] | None, note: str = "# UNEVALUATED BRANCH") -> str | None:
    """A note above each of the 1-based lines, at the line's depth."""
    if code is None:
        return None
    marks, out = set(lines or ()), []
    for i, row in enumerate(code.split("\n"), 1):
        if i in marks:
            out.append(row[: len(row) - len(row.lstrip())] + note)
        out.append(row)
    return "\n".join(out)


def replaced_test(script: str | None, answer: str | None, name: str) -> str | None:
    """The script with its test function exchanged for the one in the answer."""
    fenced = _FENCE.search(answer or "")
    fresh = function_text(fenced.group(1) if fenced else answer, f"test_{name}")
    return None if fresh is None or script is None else replace_function(script, f"test_{name}", fresh)


def function_head(prompt: str | None) -> tuple[str, str] | None:
    """Name of the last function of a prompt and the text before it."""
    found = list(re.finditer(r"^[ \t]*(?:async\s+)?def\s+(\w+)", prompt or "", re.M))
    return (found[-1].group(1), prompt[: found[-1].start()]) if found else None


def completed(prompt: str | None, answer: str | None) -> str | None:
    """What comes before the prompt's function plus the answer from that function on."""
    head = function_head(prompt)
    if head is None or answer is None:
        return None
    fenced = _FENCE.search(answer)
    code = fenced.group(1) if fenced else answer
    at = re.search(rf"^[ \t]*(?:async\s+)?def\s+{head[0]}\b", code, re.M)
    return head[1] + code[at.start() :] if at else None


def between_markers(answer: str | None, start: str, stops: list[str]) -> str | None:
    """Text after the last ``start`` (all of it if absent), cut at the earliest stop, without outer blanks."""
    if answer is None:
        return None
    text = answer.rpartition(start)[2] if start in answer else answer
    cut = min((text.find(s) for s in stops if s in text), default=len(text))
    return text[:cut].strip()


def failed_tests(report: str | None) -> list[str]:
    """Distinct files after the summary line of a pytest report, in order."""
    tail = (report or "").rpartition("short test summary info")[2]
    return list(dict.fromkeys(re.findall(r"^(?:FAILED|ERROR)\s+([^\s:]+)", tail, re.M)))


def without_failing(test_code: str | None, failing: list[str] | None) -> str | None:
    """Test code without the named test methods; null if nothing is left."""
    from quarry.functions.pyast import remove_function

    code = test_code
    for name in failing or ():
        code = remove_function(code, name)
    tree = safe_parse(code)
    return code if tree is not None and any(f.name.startswith("test") for _, f in definitions(tree)) else None


def spec_text(answer: str | None) -> str | None:
    """Text between the last two fence lines."""
    rows = (answer or "").splitlines()
    marks = [i for i, r in enumerate(rows) if "```" in r]
    return "\n".join(rows[marks[-2] + 1 : marks[-1]]) if len(marks) >= 2 else None


def sft_example(context_blocks: list[str] | None, path: str | None, name: str | None, instruction: str | None = None, docstring: str = "keep", infile: bool = False) -> tuple[str, str] | None:
    """``(input, output)`` of a fine-tuning example; null where the function or its file is not found.

    The input is the target file up to and with the function's head and docstring, behind
    the other blocks as commented context; what follows the function is left out.  The
    output is the function's body and a last line with its indent.  ``docstring`` is
    ``keep``, ``drop`` or ``instruction`` (then ``instruction`` stands in its place);
    ``infile`` leaves the other blocks away.
    """
    from quarry.functions.pyedit import body_lines

    if not context_blocks or not path or not name:
        return None
    head_of = lambda b: next((r for r in b.splitlines() if r.strip().startswith("#")), "")
    own = next((b for b in context_blocks if path in head_of(b)), None)
    if own is None:
        return None
    at = function_lines(own, name)
    if at is None:
        return None
    rows = own.splitlines()
    fn = "\n".join(rows[at[0] : at[1] + 1])
    body = body_lines(fn, name.rsplit(".", 1)[-1])
    if body is None:
        return None
    code = fn.split("\n")
    depth = re.match(r"[ \t]*", next(r for r in code if re.match(r"\s*(?:async\s+)?def\s", r))).group()
    tree = safe_parse(reindented(fn, 0))
    has_doc = tree is not None and isinstance(getattr(tree.body[0], "body", [None])[0], ast.Expr) and ast.get_docstring(tree.body[0]) is not None
    start = tree.body[0].body[0].lineno - 1 if has_doc else body[0]
    kept = code[: body[0]] if docstring == "keep" else code[:start]
    if docstring == "instruction" and instruction:
        inner = re.match(r"[ \t]*", code[body[0]]).group()
        kept = [*kept, inner + '"""', *(inner + r.strip() for r in instruction.split("\n")), inner + '"""']
    text = "\n".join([*rows[: at[0]], *kept]) + "\n"
    others = [b for b in context_blocks if b != own]
    if others and not infile:
        parts = []
        for b in others:
            title, _, rest = b.partition("\n")
            words = title.split(" ")
            if len(words) < 2:
                return None
            parts.append(f"From the file\n{words[1]}\n{rest}")
        text = "\n".join("# " + r for p in parts for r in p.split("\n")) + "\n\n" + text
    return text, "\n".join(code[body[0] : body[1] + 1]) + "\n" + depth + "\n"


def renamed_in_script(script: str | None, old: str, new: str) -> str | None:
    """The definition and all calls of ``old`` in a script get the name ``new``; other words that hold it are left alone."""
    return None if script is None else re.sub(rf"(?<![\w.]){re.escape(old)}(?=\s*\()", new, script)


def inserted_after(script: str | None, name: str, extra: str) -> str | None:
    """``extra`` behind a function, at its depth and set apart by a blank line; null if the function is not there once."""
    at = function_lines(script, name)
    if at is None:
        return None
    rows = script.splitlines()
    lead = re.match(r"[ \t]*", rows[at[0]]).group()
    return "\n".join([*rows[: at[1] + 1], "", *moved(extra, lead).splitlines(), *rows[at[1] + 1 :]])


def with_copy(script: str | None, name: str) -> str | None:
    """The script with a copy of the function beside it as ``<name>_new_implementation``: what a correct answer would be."""
    fn = function_text(script, name)
    last = name.rsplit(".", 1)[-1]
    return None if fn is None else inserted_after(script, name, renamed(fn, last, f"{last}_new_implementation"))


def section_after(answer: str | None, marker: str) -> str | None:
    """All fenced code behind the last marker (of the whole answer if it is missing), joined by blank lines; else the text itself."""
    if answer is None:
        return None
    tail = answer.rpartition(marker)[2]
    found = _FENCE.findall(tail)
    return "\n\n".join(f.strip() for f in found) if found else tail.strip()
