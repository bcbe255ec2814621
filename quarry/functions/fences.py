"""Fenced blocks of a context, whatever their fences look like."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FENCE = re.compile(r"^[ \t]*(`{3,}|~{3,})[ \t]*([^\r\n`]*)\r?$", re.M)
_LINE = r"([ \t]*)(`{3,}|~{3,})[ \t]*([^\n`]*)"
_END = re.compile(rf"^{_LINE}$", re.M)
_OPEN = re.compile(rf"^(?:{_LINE}|[^\n`]*[^\n`\s][ \t]*(`{{3,}})[ \t]*(\w*)[ \t\r]*)$", re.M)
_PATH = re.compile(r"^\s*##\s+(\S+)")
#: File name endings and fence tags by language.
LANGUAGES = {
    "python": ["python", "py", "python3", "py3", "pyi", "python2", "ipython", "pycon"],
    "yaml": ["yaml", "yml"],
    "json": ["json", "jsonc", "json5", "jsonl"],
    "toml": ["toml"],
    "ini": ["ini", "cfg", "conf", "properties", "env", "dotenv"],
    "shell": ["sh", "bash", "shell", "zsh", "console"],
    "dockerfile": ["dockerfile", "docker"],
    "markdown": ["md", "markdown", "rst", "txt", "text"],
    "sql": ["sql"],
    "javascript": ["js", "javascript", "ts", "typescript", "jsx", "tsx"],
    "xml": ["xml", "html", "htm"],
}
_BY_TAG = {tag: name for name, tags in LANGUAGES.items() for tag in tags}
OUTSIDE = "outside"


def language(tag: str, body: str) -> str:
    """The language of a block: by its tag, else by the ending of its path, else ``unknown``."""
    word = re.sub(r"^[{.\s]+", "", tag.strip().lower())
    word = re.split(r"[\s,:;{}]", word, maxsplit=1)[0].lstrip(".")
    if word in _BY_TAG:
        return _BY_TAG[word]
    path = _PATH.match(body)
    if path:
        name = path.group(1).rstrip("/").rsplit("/", 1)[-1].lower()
        end = name.rsplit(".", 1)[-1]
        if end in _BY_TAG:
            return _BY_TAG[end]
    return word or "unknown"


def blocks(text: str | None) -> list[tuple[str, str, str]]:
    """``(language, path, body)`` of the blocks of a text, bodies without the fences.

    A block may open behind other text on its line, and be open to the end.  In a block, a
    fence line with a tag opens the next one and a bare fence closes it, whatever its sign;
    shorter fences and those four or more blanks further in than the opening one (in
    docstrings) are text.  The path is that of a leading ``## path`` line, else empty.
    """
    out = []
    m = _OPEN.search(text or "")
    while m:
        start = min(m.end() + 1, len(text))
        lead, sign, tag = (m.group(1), m.group(2), m.group(3)) if m.group(2) else (re.match(r"[ \t]*", m.group()).group(), m.group(4), m.group(5))
        e = next((e for e in _END.finditer(text, start) if len(e.group(2)) >= len(sign) and len(e.group(1)) < len(lead) + 4), None)
        body = re.sub(r"\r?\n\Z", "", text[start : e.start() if e else len(text)])
        path = _PATH.match(body)
        out.append((language(tag, body), path.group(1) if path else "", body))
        m = _OPEN.search(text, e.start() if e.group(3).strip() else e.end()) if e else None
    return out


def block_rows(records: DataFrame, text_col: str, *keep: str) -> DataFrame:
    """One row ``(*keep, pos, lang, path, body)`` for each block of a text; null texts give none."""
    kinds = dict(records.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, pos, *b) for i, text in enumerate(batch.column(0).to_pylist()) for pos, b in enumerate(blocks(text))]
            at, pos, langs, paths, bodies = zip(*rows) if rows else ((),) * 5
            kept = [batch.column(k + 1).take(pa.array(at, pa.int64())) for k in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(pos, pa.int32()), *(pa.array(c, pa.string()) for c in (langs, paths, bodies))], [*keep, "pos", "lang", "path", "body"])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", pos int, lang string, path string, body string"
    return records.select(F.col(text_col), *keep).mapInArrow(run, schema)
