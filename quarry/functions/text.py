"""Text functions as Catalyst expressions; null in gives null out unless said otherwise.

None of these uses Python at run time, so filters on their results stay visible to the
optimizer.  Plain string functions are compiled into whole-stage code; those over arrays
(filter, transform, aggregate) are interpreted row by row in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = r"(?U)^\s+|\s+$"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(col: Column | str) -> Column:
    """Removes all Unicode blanks at both ends."""
    return F.regexp_replace(_c(col), BLANK, "")


def lines(col: Column | str) -> Column:
    return F.split(_c(col), "\n")


def fenced_blocks(col: Column | str) -> Column:
    """All closed fenced blocks as ``array<struct<lang, body>>``, bodies without the fences."""
    c = _c(col)
    pattern = F.lit(r"(?s)```(\w*)\n(.*?)\n```")
    return F.transform(F.arrays_zip(F.regexp_extract_all(c, pattern, F.lit(1)).alias("lang"), F.regexp_extract_all(c, pattern, F.lit(2)).alias("body")), lambda z: F.struct(z["lang"].alias("lang"), z["body"].alias("body")))


def code_pieces(col: Column | str, prefix: str = "```python") -> Column:
    """Bodies after each ``prefix``, to the next fence or the end, stripped."""
    parts = F.split(_c(col), F.lit("\\Q" + prefix + "\\E"))
    return F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda p: strip(F.substring_index(p, "```", 1)))


def first_code_piece(col: Column | str, prefix: str = "```python") -> Column:
    """The first fenced piece, or the text itself when there is none."""
    pieces = code_pieces(col, prefix)
    return F.coalesce(F.try_element_at(pieces, F.lit(1)), _c(col))


def joined_code_pieces(col: Column | str, prefix: str = "```python") -> Column:
    """All fenced pieces joined by a blank line; the text itself when there is none."""
    pieces = code_pieces(col, prefix)
    return F.when(F.size(pieces) > 0, F.array_join(pieces, "\n\n")).otherwise(_c(col))


def between_fence_lines(col: Column | str) -> Column:
    """Lines between the first two lines that hold a fence; null if there are fewer than two."""
    ls = lines(col)
    marks = F.filter(F.transform(ls, lambda x, i: F.when(F.instr(x, "```") > 0, i)), lambda i: i.isNotNull())
    a, b = F.try_element_at(marks, F.lit(1)), F.try_element_at(marks, F.lit(2))
    return F.when(b.isNotNull(), F.array_join(F.slice(ls, a + 2, b - a - 1), "\n"))


def block_by_path(blocks: Column, path: Column) -> Column:
    """The first body whose first ``#`` line contains the path; null as soon as a block has no such line."""
    def head(b: Column) -> Column:
        return F.try_element_at(F.filter(lines(b["body"]), lambda x: strip(x).startswith("#")), F.lit(1))

    hits = F.filter(F.transform(blocks, lambda b, i: F.when(head(b).isNull(), F.struct(i.alias("i"), F.lit(None).cast("string").alias("body"))).when(F.contains(head(b), path), F.struct(i.alias("i"), b["body"].alias("body")))), lambda h: h.isNotNull())
    return F.try_element_at(hits, F.lit(1))["body"]


def doc_title(col: Column | str) -> Column:
    """The second space-separated word of the first line."""
    return F.try_element_at(F.split(F.substring_index(_c(col), "\n", 1), " "), F.lit(2))


def comment_lines(col: Column | str) -> Column:
    """``# `` before every line; lines end with a line feed."""
    return F.concat(F.lit("# "), F.replace(_c(col), F.lit("\n"), F.lit("\n# ")))


def wrap_context(docs: Column, header: str = "Code of the same repository that may help:", lead: str = "From the file") -> Column:
    """``array<struct<title, text>>`` as one commented block with titles and separators."""
    rule = "-" * 50
    blocks = F.transform(docs, lambda d: F.concat_ws("\n", F.lit(lead), d["title"], F.lit(rule), d["text"], F.lit(rule)))
    return comment_lines(F.concat_ws("\n", F.lit(header), F.lit(rule), F.array_join(blocks, "\n")))


def reindent_docstring(col: Column | str, indent: str) -> Column:
    return F.array_join(F.transform(lines(col), lambda x: F.concat(F.lit(indent), strip(x))), "\n")


def leading_blank(col: Column | str) -> Column:
    return F.regexp_extract(_c(col), r"^([ \t]*)", 1)


def cut_at_stops(col: Column | str, stops: list[str]) -> Column:
    """The text before the earliest stop word."""
    c = _c(col)
    at = [F.nullif(F.instr(c, s), F.lit(0)) for s in stops]
    first = F.least(*at) if len(at) > 1 else at[0]
    return F.when(first.isNull(), c).otherwise(F.left(c, first - 1))


def cut_after_return(col: Column | str) -> Column:
    """Cut at the first later line that starts without a blank."""
    return F.regexp_replace(_c(col), r"(?s)\n(?=[^\s]).*$", "")


def remove_hash_comments(col: Column | str) -> Column:
    return F.regexp_replace(_c(col), "#[^\n]*", "")


def code_lines(col: Column | str) -> Column:
    """Lines that are neither blank nor comments."""
    return F.filter(lines(col), lambda x: (F.length(strip(x)) > 0) & ~strip(x).startswith("#"))


def first_code_lines(col: Column | str, n: Column) -> Column:
    return F.array_join(F.slice(code_lines(col), F.lit(1), F.greatest(n, F.lit(0))), "\n")


def without_docstrings(col: Column | str) -> Column:
    """Drops lines inside triple quotes; the line that closes a block is kept, as is a one-line docstring."""
    start = F.struct(F.lit(False).alias("inside"), F.array().cast("array<string>").alias("kept"))

    def step(acc: Column, line: Column) -> Column:
        toggles = F.contains(line, F.lit('"""')) | F.contains(line, F.lit("'''"))
        inside = F.when(toggles, ~acc["inside"]).otherwise(acc["inside"])
        return F.struct(inside.alias("inside"), F.when(inside, acc["kept"]).otherwise(F.concat(acc["kept"], F.array(line))).alias("kept"))

    return F.array_join(F.aggregate(lines(col), start, step, lambda acc: acc["kept"]), "\n")


def without_main(col: Column | str) -> Column:
    return F.regexp_replace(_c(col), r"""(?ms)^if __name__ *== *["']__main__["'].*$(?!.)""", "")


def missing_module(col: Column | str) -> Column:
    """The top module of ``No module named 'x.y'``; null when there is none."""
    return F.nullif(F.regexp_extract(_c(col), r"No module named '([^'.]+)", 1), F.lit(""))


def error_types(col: Column | str) -> Column:
    """Error class names at line starts, on lines that hold ``Error:`` or ``Exception:``."""
    found = F.transform(lines(col), lambda x: F.regexp_extract(x, r"^\s*([\w.]*(?:Error|Exception)): ", 1))
    return F.filter(found, lambda x: x != "")


def verdict(col: Column | str) -> Column:
    """``same``, ``yes`` or ``no``: the earliest after the last ANSWER, anywhere but at its very start.

    Null when REASONING: or ANSWER: is missing or no word is found.
    """
    c = _c(col)
    tail = F.lower(F.substring_index(c, "ANSWER", -1))
    found = [F.when(F.instr(tail, w) > 1, F.struct(F.instr(tail, w).alias("at"), F.lit(w).alias("word"))) for w in ("same", "yes", "no")]
    valid = F.contains(c, F.lit("REASONING:")) & F.contains(c, F.lit("ANSWER:"))
    return F.when(valid, F.least(*found)["word"])


def truncate_doc(col: Column | str) -> Column:
    """Short form of a documentation text.

    With more than five lines it is cut at the first ``>>>`` line; then, after line two,
    at the first dotted listing line; more than ten lines leave three.
    """
    ls = lines(col)
    prompt = F.array_position(F.transform(ls, lambda x: strip(x).startswith(">>>")), True)
    ls = F.when((F.size(ls) > 5) & (prompt > 1), F.slice(ls, F.lit(1), F.greatest(prompt - 1, F.lit(0)).cast("int"))).otherwise(ls)
    dots = F.array_position(F.transform(ls, lambda x, i: (i > 1) & strip(x).startswith(".. ")), True)
    ls = F.when(dots > 0, F.slice(ls, F.lit(1), F.greatest(dots - 1, F.lit(0)).cast("int"))).otherwise(ls)
    return F.array_join(F.when(F.size(ls) > 10, F.slice(ls, 1, 3)).otherwise(ls), "\n")


def white_tokens(col: Column | str) -> Column:
    """Tokens between blanks; an empty text has none."""
    return F.filter(F.split(_c(col), r"\s+"), lambda x: x != "")


def first_chunk_lines(col: Column | str, budget: int) -> Column:
    """How many leading lines fit into a budget of blank-separated tokens (0 if the first does not)."""
    start = F.struct(F.lit(0).alias("used"), F.lit(0).alias("n"), F.lit(True).alias("open"))

    def step(acc: Column, line: Column) -> Column:
        used = acc["used"] + F.size(white_tokens(line))
        fits = acc["open"] & (used <= budget)
        return F.struct(F.when(fits, used).otherwise(acc["used"]).alias("used"), (acc["n"] + fits.cast("int")).alias("n"), fits.alias("open"))

    return F.aggregate(lines(col), start, step, lambda acc: acc["n"])


def first_chunk(col: Column | str, budget: int) -> Column:
    return F.array_join(F.slice(lines(col), F.lit(1), first_chunk_lines(col, budget)), "\n")


def truncate_tokens(col: Column | str, budget: int, side: str = "left") -> Column:
    """Keeps ``budget`` blank-separated tokens; ``left`` cuts the front, ``right`` the end."""
    t = white_tokens(col)
    kept = F.slice(t, F.greatest(F.size(t) - budget + 1, F.lit(1)), F.lit(budget)) if side == "left" else F.slice(t, F.lit(1), F.lit(budget))
    return F.array_join(kept, " ")


def squeezed_contains(whole: Column | str, part: Column | str) -> Column:
    """Containment that ignores all blanks."""
    return F.contains(F.regexp_replace(_c(whole), r"\s+", ""), F.regexp_replace(_c(part), r"\s+", ""))


def fill_slots(template: str, **values: Column) -> Column:
    """``{{name}}`` of a template replaced by columns; null values become empty."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{{" + name + "}}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def class_part(name: Column | str) -> Column:
    """The class of ``Class.f``; null for ``f``."""
    c = _c(name)
    return F.when(F.instr(c, ".") > 0, F.substring_index(c, ".", 1))


def function_part(name: Column | str) -> Column:
    return F.substring_index(_c(name), ".", -1)


def last_parts(name: Column | str, n: int) -> Column:
    """The last ``n`` dotted parts, all of them if there are fewer."""
    return F.substring_index(_c(name), ".", -n)


def module_path(module: Column | str) -> Column:
    return F.concat(F.replace(_c(module), F.lit("."), F.lit("/")), F.lit(".py"))


def path_module(path: Column | str, prefix: str = "") -> Column:
    c = F.regexp_replace(_c(path), "^" + prefix.replace(".", r"\."), "")
    return F.replace(F.regexp_replace(F.regexp_replace(c, r"\.py$", ""), "^/+", ""), F.lit("/"), F.lit("."))


def quotes_normalised(col: Column | str) -> Column:
    return F.replace(_c(col), F.lit('"'), F.lit("'"))


def missing_blocks(missing: Column) -> Column:
    """Sorted line numbers as ``array<struct<first, last>>`` of consecutive runs; empty gives empty."""
    nums = F.array_sort(F.array_distinct(missing))
    start = F.array().cast("array<struct<first:int,last:int>>")

    def step(acc: Column, n: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        longer = F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(last["first"].alias("first"), n.alias("last"))))
        fresh = F.concat(acc, F.array(F.struct(n.alias("first"), n.alias("last"))))
        return F.when((F.size(acc) > 0) & (last["last"] + 1 == n), longer).otherwise(fresh)

    return F.aggregate(nums, start, step)
