"""Credentials written into source code and configuration: find and mask them.

1. Candidates: literals in the places where credentials stand (assignments, keyword
   arguments, addresses, connection strings, command options, headers, comments, key
   blocks) and any long mixed token.  Whole texts are scanned; lines without a trigger
   are passed over by an automaton.
2. Weak labels: well-known issued formats and strong values under password names are
   positive; placeholders, look-ups, checksums, identifiers and media are negative; all
   other candidates stay unlabelled.
3. A first-order character Markov chain is counted over the positive and the negative
   values of all candidates; its mean log-likelihood ratio is a feature beside the shape
   of the value, the words around it and the path of the file.
4. A logistic regression is trained on at most ``TRAIN_ROWS`` weakly labelled candidates,
   chosen by hash; every candidate is scored.  Platt scaling on labelled candidates that
   were not trained on makes the score a probability; ``CUTOFF`` and more is masked.

Literals that are joined to one value, on a line or over several (in brackets, behind a
backslash, by a plus), and block scalars of configuration files are one candidate that
stands where its first piece begins.

Masking replaces exactly the value, each piece of it on its own (of a key block: the
lines between its markers), and leaves quotes, names and line ends alone.  Null texts
stay null.
"""

from __future__ import annotations

import base64
import binascii
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import islice

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.workspace import Workspace

TRAIN_ROWS = 50_000
CUTOFF = 0.5
HASHED = 128
MASK = "***MASKED***"

#: Starts of issued keys and tokens.
ISSUED = r"(?:sk-(?:proj-|ant-|live-|test-)?|[sr]k_(?:live|test)_|gh[pousr]_|github_pat_|glpat-|npm_|pypi-|hf_|xox[abeoprs]-|xapp-|AKIA|ASIA|AIza|ya29\.|SG\.|shp(?:at|ss|ca|pa)_|dop_v1_|dckr_pat_|eyJ[\w-]+\.eyJ)"
#: Parts of names that announce a secret, in several languages.
SECRET_NAME = r"passw|passphrase|pwd|(?:^|[_\-.])pass(?:$|[_\-.])|_pw\b|admin_pw|secret|token|api_?-?key|apikey|access_?-?key|private_?-?key|client_?-?key|signing|credential|bearer|jwt|contrase|mot_de_passe|motdepasse|passwor[dt]|kennwort|clave_secreta|authorization"
PASSWORD_NAME = r"passw|passphrase|pwd|(?:^|[_\-.])pass(?:$|[_\-.])|_pw\b|contrase|mot_de_passe|kennwort|passwort"
#: Parts of names whose values are no secrets.
OTHER_NAME = r"hash|sha\d*|md5|checksum|digest|etag|commit|revision|public|uuid|guid|_id$|^id$|version|logo|icon|thumb|image|pinned|(?:pad|eos|bos|mask|unk|sep|cls)_token|cert|fingerprint|sort_key|primary_key|foreign_key"
PLACEHOLDER = r"(?i)^(?:[x*.\-_#•]+|<[^>]*>|\[[^\]]*\]|\{\{.*\}\}|\$\{.*\}|\$\w+|%\(?\w+\)?s?|\{\w*\}|your[_\-].*|.*your[_\-]?(?:key|token|pass|secret|api).*|replace[_\-]?me.*|change[_\-]?me.*|changeit|todo|tbd|none|null|nil|true|false|example.*|dummy.*|sample|placeholder.*|redacted.*|hidden|masked|fill[_ \-]?in.*|insert.*here|enter.*|foo|bar|test|secret|password|token|n/?a|undefined|os\.(?:environ|getenv).*|env\(.*|process\.env.*|vault[:_].*|/run/secrets/.*|(.)\1{4,})$"

_ISSUED = re.compile(ISSUED)
_SECRET_NAME = re.compile(SECRET_NAME, re.I)
_PASSWORD_NAME = re.compile(PASSWORD_NAME, re.I)
_OTHER_NAME = re.compile(OTHER_NAME, re.I)
_PLACEHOLDER = re.compile(PLACEHOLDER)
_FILE = re.compile(r"^## (\S+)", re.M)
_HEX = re.compile(r"^[0-9a-fA-F]+$")
_IDENT = re.compile(r"^[A-Za-z_][\w.]*$")
_UUID = re.compile(r"^[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}$", re.I)

#: Lower-case parts of which every secret name, and every other place a pattern below reads, holds one.
_TRIGGERS = ["pass", "pwd", "_pw", "-pw", "secret", "token", "key", "signing", "credential", "bearer", "jwt", "contrase", "kennwort", "authoriz", "login", "://", "-u ", "-u\t"]
#: Signs of which every pattern but ``_RUN`` needs one on its line.
_SIGN = re.compile(r"[=:,#;]|//|--")
_RUN = re.compile(r"[A-Za-z0-9+/=_.\-]{16,}")
_MIXED = re.compile(ISSUED + r"|(?=.*\d)(?=.*[A-Z])(?=.*[a-z])")

_URL = re.compile(r"[a-zA-Z][a-zA-Z0-9+.\-]*://[^\s:/@\"']*:([^\s\"'@]+)@(?=[\w\[])")
_CONN = re.compile(r"(?i)[;\"'](?:\s*)(pwd|password)=([^;\"'\s]+)(?=[;\"'\s]|$)")
_USER = re.compile(r"(?:^|\s)-u\s+[\w.\-]+:(?:'([^']*)'|\"([^\"]*)\"|([^\s'\"]+))")
_HEADER = re.compile(r"(?i)authorization[\"']?\s*[,:]\s*[\"']?(basic|bearer|token)\s+([^\s\"']+)")
_OPTION = re.compile(r"(?:^|\s)--([A-Za-z][\w\-]*)[ =](?:'([^']*)'|\"([^\"]*)\"|([^\s'\"]+))")
_PAIR = re.compile(r"([\"']?)([A-Za-z_\u00c0-\u024f][\w.\-\u00c0-\u024f]*)\1\]?\s*[:=]\s*\(?\s*(?:[frbu]{0,2}\"((?:[^\"\\\n]|\\.)*)\"|[frbu]{0,2}'((?:[^'\\\n]|\\.)*)')")
_MORE = re.compile(r"\s*\+?\s*(?:\"((?:[^\"\\\n]|\\.)*)\"|'((?:[^'\\\n]|\\.)*)')")
#: The next literal of a joined value, on this line or, behind a line end, on a later one.
_JOIN = re.compile(r"([ \t]*\+?[ \t]*(?:\\?[ \t]*(?:#[^\n]*)?\r?\n[ \t]*)*\+?[ \t]*)[frbu]{0,2}(?:\"((?:[^\"\\\n]|\\.)*)\"|'((?:[^'\\\n]|\\.)*)')")
#: A name whose value starts behind an open bracket or a backslash at the end of the line.
_LATER = re.compile(r"([\"']?)([A-Za-z_\u00c0-\u024f][\w.\-\u00c0-\u024f]*)\1\]?\s*[:=]\s*(\(\s*(?:#.*)?|\\)\s*$")
_SCALAR = re.compile(r"^([ \t]*)(?:-[ \t]+)?[\"']?([A-Za-z_][\w.\-]*)[\"']?[ \t]*:[ \t]*[|>][+\-]?\d?[ \t]*$")
_BARE = re.compile(r"^\s*(?:-\s+|export\s+|ENV\s+|ARG\s+|set\s+)?([A-Za-z_\u00c0-\u024f][\w.\-\u00c0-\u024f]*)\s*[:=]\s*([^\s\"'].*?)\s*$")
_CALL = re.compile(r"\(\s*([\"'])[\w.@\-]+\1\s*,\s*([\"'])((?:(?!\2).)+)\2\s*\)\s*(?:#|//).*(?:passw|login|pwd|contrase|mot de passe|kennwort)", re.I)
_COMMENT = re.compile(r"(?:#|//|;)\s*(?:[\w ]*:\s*)?(?:[A-Za-z]+\s+)*?([A-Za-z_]\w*)[\s:=]+([^\s\"'`()]{10,})\s*$")
_PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_PEM_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for t in _TRIGGERS:
        a.add_word(t, len(t))
    a.make_automaton()
    return a


def _ascii_lower(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if c.isascii() else c for c in text)


def trigger_lines(text: str, automaton: ahocorasick.Automaton) -> list[int]:
    """Starts of the lines that may hold a credential: a trigger and a sign, or a long mixed token."""
    starts = set()
    done = -1
    for end, _ in automaton.iter(_ascii_lower(text)):
        if end <= done:
            continue
        at = text.rfind("\n", 0, end) + 1
        done = text.find("\n", end)
        done = done if done >= 0 else len(text)
        if _SIGN.search(text, at, done):
            starts.add(at)
    for m in _RUN.finditer(text):
        if _MIXED.match(m.group()):
            starts.add(text.rfind("\n", 0, m.start()) + 1)
    return sorted(starts)


def line_candidates(line: str, code: bool) -> list[tuple[int, int, str, str, str]]:
    """``(start, stop, name, kind, value)`` of the literals of a line, none inside another.

    In code an unquoted right side is an expression and gets the kind ``code``.
    """
    out: list[tuple[int, int, str, str, str]] = []
    taken: list[tuple[int, int]] = []

    def add(start: int, stop: int, name: str, kind: str, value: str) -> None:
        if value and not any(s < stop and start < e for s, e in taken):
            taken.append((start, stop))
            out.append((start, stop, name, kind, value))

    for m in _URL.finditer(line):
        add(m.start(1), m.end(1), "password", "url", m.group(1))
    for m in _CONN.finditer(line):
        add(m.start(2), m.end(2), m.group(1), "conn", m.group(2))
    for m in _HEADER.finditer(line):
        add(m.start(2), m.end(2), "authorization", "basic" if m.group(1).lower() == "basic" else "header", m.group(2))
    for m in _USER.finditer(line):
        g = next(i for i in (1, 2, 3) if m.group(i) is not None)
        add(m.start(g), m.end(g), "password", "option", m.group(g))
    for m in _OPTION.finditer(line):
        g = next(i for i in (2, 3, 4) if m.group(i) is not None)
        add(m.start(g), m.end(g), m.group(1).replace("-", "_"), "option", m.group(g))
    m = _CALL.search(line)
    if m:
        add(m.start(3), m.end(3), "password", "call", m.group(3))
    for m in _PAIR.finditer(line):
        g = 3 if m.group(3) is not None else 4
        value, stop = m.group(g), m.end(g)
        more = _MORE.match(line, m.end())
        while more:
            h = 1 if more.group(1) is not None else 2
            value, stop = value + more.group(h), more.end(h)
            more = _MORE.match(line, more.end())
        if " " not in value.strip() or _PLACEHOLDER.match(value) or _PASSWORD_NAME.search(m.group(2)):
            add(m.start(g), stop, m.group(2), "pair", value)
    m = _BARE.match(line)
    if m:
        value = re.split(r"\s+[#;]", m.group(2))[0].rstrip(",")
        if not re.search(r"[\s(\[]", value):
            add(m.start(2), m.start(2) + len(value), m.group(1), "code" if code else "bare", value)
    m = _COMMENT.search(line)
    if m:
        add(m.start(2), m.end(2), m.group(1), "comment", m.group(2))
    for m in _RUN.finditer(line):
        if _MIXED.match(m.group()):
            add(m.start(), m.end(), "", "loose", m.group())
    return out


def joined_pieces(text: str, line: int, quote: int) -> list[tuple[int, int]]:
    """Ranges of the literals that make up the value whose first quote is at ``quote``, on a line that starts at ``line``.

    A value goes on over a line end if a bracket is open on its own line, or behind a
    backslash or a plus; else only if a comma or a bracket follows its last piece, as in a
    call that began earlier.  A literal that is itself a name is not part of it.
    """
    m = _JOIN.match(text, quote)
    if not m:
        return []
    head = text[line:quote]
    opened = sum(map(head.count, "([{")) > sum(map(head.count, ")]}"))
    out, plain = [], None
    while m:
        g = 2 if m.group(2) is not None else 3
        end = m.end()
        rest = text[end : text.find("\n", end) if text.find("\n", end) >= 0 else len(text)].lstrip()
        if out and rest[:1] in (":", "="):
            break
        if out and "\n" in m.group(1) and not opened and "\\" not in m.group(1) and "+" not in m.group(1) and plain is None:
            plain = len(out)
        out.append((m.start(g), m.end(g)))
        m = _JOIN.match(text, end)
    if plain is not None and not re.match(r"[ \t]*(?:#[^\n]*)?[\r\n \t]*[,)\]}]", text[out[-1][1] + 1 :]):
        out = out[:plain]
    return out


def later_value(text: str, line: str, at: int, stop: int) -> tuple[str, str, list[tuple[int, int]]] | None:
    """``(name, kind, pieces)`` of a value that starts below the line ``text[at:stop]``, if there is one."""
    tail = line.rstrip()
    m = _LATER.search(line) if tail.endswith(("(", "\\")) or "(" in tail and "#" in tail else None
    if m:
        first = re.compile(r"\s*(?:#[^\n]*\n\s*)*[frbu]{0,2}(?=[\"'])").match(text, stop)
        if first:
            pieces = _in_brackets(text, first.end()) if m.group(3).startswith("(") else joined_pieces(text, first.end(), first.end())
            return (m.group(2), "pair", pieces) if pieces else None
        return None
    m = _SCALAR.match(line) if tail[-1:] and tail[-1] in "|>+-0123456789" and ("|" in tail or ">" in tail) else None
    if not m:
        return None
    depth, pieces, here = len(m.group(1)), [], stop + 1
    while here < len(text):
        end = text.find("\n", here)
        end = end if end >= 0 else len(text)
        row = text[here:end].rstrip()
        if row.strip():
            lead = len(row) - len(row.lstrip())
            if lead <= depth or row.lstrip().startswith("```"):
                break
            pieces.append((here + lead, here + len(row)))
        here = end + 1
    return (m.group(2), "bare", pieces) if pieces else None


def _in_brackets(text: str, quote: int) -> list[tuple[int, int]]:
    """All literals that follow each other from ``quote`` on, whatever line they stand on."""
    out, m = [], _JOIN.match(text, quote)
    while m:
        g = 2 if m.group(2) is not None else 3
        out.append((m.start(g), m.end(g)))
        m = _JOIN.match(text, m.end())
    return out


def _key_body(text: str, begin: re.Match) -> tuple[int, int]:
    nxt = _PEM.search(text, begin.end())
    end = _PEM_END.search(text, begin.end(), nxt.start() if nxt else len(text))
    if end:
        return begin.end(), end.start()
    m = re.compile(r"(?:[\s\\nr\"'+,#/]*[A-Za-z0-9+/=]{16,})*").match(text, begin.end())
    return begin.end(), m.end()


def basic_password(value: str) -> str | None:
    """The password of an encoded login, or null if it is none."""
    try:
        plain = base64.b64decode(value + "=" * (-len(value) % 4), validate=True).decode("utf-8")
    except (binascii.Error, ValueError):
        return None
    return plain.split(":", 1)[1] if ":" in plain else None


#: Words of sentences that passphrases do without.
_PROSE = re.compile(r"(?i)\b(?:a|an|the|is|are|was|be|must|may|can|not|no|your|my|for|to|of|or|and|in|on|at|with|from|enter|please|this|that|it|if|use|le|la|les|el|los|der|die|das|ist|est|es)\b")


def _passphrase(name: str, value: str) -> bool:
    """Three to eight words with a digit and without the look of a sentence, under a name that says password."""
    parts = value.split()
    named = re.search(r"(?i)(?:passphrase|passw(?:or[dt]|d)|pwd|_pass|^pass|kennwort|contrase\u00f1a|contrasena|mot_de_passe|motdepasse)$", name)
    return bool(named and 3 <= len(parts) <= 8 and re.search(r"\d", value) and not re.search(r"[.:?!,;%{}<>()]", value) and not _PROSE.search(value))


def weak_label(kind: str, name: str, value: str) -> int | None:
    """1 for patterns of credentials, 0 for patterns of other literals, null if unsure."""
    if kind == "pem":
        return 1 if len(re.sub(r"[^A-Za-z0-9+/=]", "", value)) >= 64 else 0
    if kind == "basic":
        value = basic_password(value)
        if value is None:
            return 0
        name = "password"
    if _PLACEHOLDER.match(value) or re.search(r"[{<]\w+[}>]|\$\{|\{\{|x{6,}|\*{4,}|\.\.\.", value):
        return 0
    if " " in value.strip():
        return 1 if _passphrase(name, value) else 0
    m = _ISSUED.match(value)
    if m and len(value) - m.end() >= 12:
        return 1
    if _OTHER_NAME.search(name) or _UUID.match(value) or value.startswith(("data:", "http://", "https://", "git+")) or re.search(r"@[0-9a-f]{40}$", value):
        return 0
    if len(value) < 6 or kind == "code" and _IDENT.match(value):
        return 0
    placed = kind in ("url", "conn", "call", "basic") or bool(_PASSWORD_NAME.search(name))
    classes = sum(bool(re.search(p, value)) for p in (r"[a-z]", r"[A-Z]", r"\d", r"[^A-Za-z0-9]"))
    if re.fullmatch(r"[A-Za-z_]+(?:\.[A-Za-z_]+)*|[\d.,\-+e]+", value):
        return None if placed else 0
    if placed:
        return 1 if classes >= 2 and re.search(r"\d", value) or classes >= 3 else None
    if _SECRET_NAME.search(name):
        return 1 if len(value) >= 16 and classes >= 2 and "/" not in value[:1] else None
    if kind == "loose" and (_HEX.match(value) or "/" in value):
        return 0
    if classes <= 2 or re.fullmatch(r"[\w./\-]*", value) and len(value) < 20:
        return 0
    return None


_KINDS = ["pair", "bare", "code", "url", "conn", "basic", "header", "option", "call", "comment", "loose", "pem"]


def shape_features(kind: str, name: str, path: str, before: str, value: str) -> list[float]:
    """Shape of the value, kind of place, flags of the name, hashed words around and path.

    ``before`` holds the last words of the line before the value, lower case.
    """
    secret = basic_password(value) if kind == "basic" else value
    v = secret if secret is not None else ""
    n = max(1, len(v))
    counts = [sum(c.islower() for c in v), sum(c.isupper() for c in v), sum(c.isdigit() for c in v)]
    other = n - sum(counts)
    turns = sum((a.isalpha() != b.isalpha()) or (a.isupper() != b.isupper()) for a, b in zip(v, v[1:]))
    issued = _ISSUED.match(v)
    # a placeholder says nothing about its name
    named = not _PLACEHOLDER.match(v) and not (kind == "code" and _IDENT.match(v))
    flags = [
        secret is None, bool(_PLACEHOLDER.match(v)), bool(re.search(r"[{<$]", v)), bool(_HEX.match(v)), bool(_IDENT.match(v)), bool(issued and len(v) - issued.end() >= 12),
        named and bool(_PASSWORD_NAME.search(name)), named and bool(_SECRET_NAME.search(name)), bool(_OTHER_NAME.search(name)), bool(_UUID.match(v)), v.startswith(("data:", "http", "git+", "/")),
        bool(re.fullmatch(r"[a-z]+(?:[.\-][a-z]+)*[.\-]?[a-z]*\d+(?:-[a-z]+)?", v)), len(set(v)) <= 3, bool(re.search(r"@[0-9a-f]{40}", v)),
    ]
    strong = named and bool(_PASSWORD_NAME.search(name) or _SECRET_NAME.search(name)) and not _OTHER_NAME.search(name)
    dense = [np.log(n), *(c / n for c in counts), other / n, turns / n, len(set(v)) / n, float(sum(c > 0 for c in (*counts, other))), float(strong and n >= 8), float(strong and bool(_IDENT.match(v)))]
    hashed = [0.0] * HASHED
    parts = ["n:" + w for w in re.split(r"[_\-.\W]+", name.lower()) if w] + ["b:" + w for w in before.split()]
    name_ = path.rsplit("/", 1)[-1].lower()
    parts += ["e:" + name_.rsplit(".", 1)[-1], *("d:" + d for d in path.lower().split("/")[:-1])]
    for p in parts:
        hashed[xxhash.xxh32_intdigest(p) % HASHED] = 1.0
    return [*map(float, flags), *dense, *(float(kind == k) for k in _KINDS), *hashed]


_CANDIDATE = "record_id bigint, field_name string, line_no bigint, pieces array<struct<start:int,stop:int>>, kind string, name string, path string, before string, value string, label int, fold int"


_PIECES = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
_BACKWARD = re.compile(r"[a-z]{3,}")


def candidates(texts: DataFrame) -> DataFrame:
    """Candidates of ``texts(record_id, field_name, text)`` with their weak labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton()
        for batch in batches:
            rows = []
            for rid, field, text in zip(*(c.to_pylist() for c in batch.columns)):
                files = [(m.start(), m.group(1)) for m in _FILE.finditer(text)]
                places = [f[0] for f in files]
                blocks = []
                found = []
                if "PRIVATE KEY" in text:
                    for m in _PEM.finditer(text):
                        s, e = _key_body(text, m)
                        line = text.rfind("\n", 0, m.start()) + 1
                        blocks.append((line, e))
                        found.append((m.start(), [(s, e)], "pem", "private_key", text[line : m.start()], text[s:e]))
                busy = 0
                for at in trigger_lines(text, automaton):
                    if any(s <= at < e for s, e in blocks):
                        continue
                    stop = text.find("\n", at)
                    stop = stop if stop >= 0 else len(text)
                    line = text[at:stop].rstrip("\r")
                    i = bisect_right(places, at) - 1
                    code = i < 0 or files[i][1].endswith((".py", ".pyi"))
                    for s, e, name, kind, value in line_candidates(line, code):
                        if at + s < busy:
                            continue
                        pieces = joined_pieces(text, at, at + s - 1) if kind == "pair" else []
                        if len(pieces) > 1:
                            value, busy = "".join(text[a:b] for a, b in pieces), pieces[-1][1]
                        found.append((at + s, pieces or [(at + s, at + e)], kind, name, line[:s], value))
                    below = later_value(text, line, at, stop)
                    if below and below[2][0][0] >= busy:
                        name, kind, pieces = below
                        parts = [text[a:b] for a, b in pieces]
                        # rows of a block scalar are words, unless all are pieces of one token
                        value, busy = (" " if kind == "bare" and any(" " in p for p in parts) else "").join(parts), pieces[-1][1]
                        if not any(s <= pieces[0][0] < e for s, e in blocks):
                            found.append((pieces[0][0], pieces, kind, name, line, value))
                seen, counted = 0, 0
                for where, pieces, kind, name, before, value in sorted(found):
                    counted += text.count("\n", seen, where)
                    seen = where
                    i = bisect_right(places, where) - 1
                    fold = xxhash.xxh32_intdigest(value.encode("utf-8", "surrogatepass")) & 0x7FFFFFFF
                    words = [m.group()[::-1] for m in islice(_BACKWARD.finditer(before[::-1].lower()), 4)]
                    spans = [{"start": s, "stop": e} for s, e in pieces]
                    rows.append((rid, field, counted + 1, spans, kind, name, files[i][1] if i >= 0 else "", " ".join(words), value, weak_label(kind, name, value), fold))
            cols = list(zip(*rows)) if rows else [()] * 11
            kinds = [pa.int64(), pa.string(), pa.int64(), _PIECES, *[pa.string()] * 5, pa.int32(), pa.int32()]
            names = [c.split()[0] for c in _CANDIDATE.split(", ")]
            yield pa.record_batch([pa.array(list(c), k) for c, k in zip(cols, kinds)], names)

    return texts.where("text is not null").select("record_id", "field_name", "text").mapInArrow(run, _CANDIDATE)


def _code(c: str) -> int:
    o = ord(c)
    return o - 32 if 32 <= o < 127 else 95


def markov_table(found: DataFrame) -> np.ndarray:
    """Log-likelihood ratio of character pairs, positive over negative values; 97 x 97."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 97, 97), np.int64)
        for batch in batches:
            for label, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                codes = [96, *map(_code, value), 96]
                np.add.at(counts[label], (codes[:-1], codes[1:]), 1)
        at = np.flatnonzero(counts.ravel())
        yield pa.record_batch([pa.array(at, pa.int32()), pa.array(counts.ravel()[at], pa.int64())], ["place", "n"])

    labelled = found.where("label is not null").select("label", "value")
    rows = labelled.mapInArrow(run, "place int, n bigint").groupBy("place").agg(F.sum("n").alias("n")).collect()  # at most 2 * 97 * 97 rows
    counts = np.full(2 * 97 * 97, 0.5)
    for r in rows:
        counts[r["place"]] += r["n"]
    p = counts.reshape(2, 97, 97)
    p = np.log(p / p.sum(axis=2, keepdims=True))
    return p[1] - p[0]


def _with_features(found: DataFrame, table: np.ndarray) -> DataFrame:
    size = len(shape_features("pair", "", "", "", "")) + 2
    ids = ["record_id", "field_name", "line_no", "pieces", "label", "fold"]
    types = dict(found.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            feats = []
            for kind, name, path, before, value in zip(*(batch.column(c).to_pylist() for c in ("kind", "name", "path", "before", "value"))):
                secret = (basic_password(value) or "") if kind == "basic" else value
                codes = [96, *map(_code, secret), 96]
                ratio = table[codes[:-1], codes[1:]]
                feats.append([float(ratio.mean()), float(np.clip(ratio.sum(), -60, 60)) / 20, *shape_features(kind, name, path, before, value)])
            flat = np.array(feats, np.float64).reshape(-1, size)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ids), pa.array(list(flat), pa.list_(pa.float64()))], [*ids, "features"])

    schema = ", ".join(f"{c} {types[c]}" for c in ids) + ", features array<double>"
    return found.mapInArrow(run, schema)


def scored(records: DataFrame, ws: Workspace, fields: tuple[str, ...] = ("orig_context", "eval_script"), id_col: str = "record_id", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """All candidates with ``probability``: ``(record_id, field_name, line_no, pieces, probability)``.

    ``pieces`` are the character ranges of the value.

    Without labelled candidates of both kinds nothing can be trained; then the weak
    labels themselves are the probabilities and unlabelled candidates get 0.
    """
    cells = [F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("text")) for f in fields]
    texts = records.select(F.col(id_col).cast("bigint").alias("record_id"), F.explode(F.array(*cells)).alias("c")).select("record_id", "c.field_name", "c.text")
    found = ws.save(candidates(texts), "candidates")
    out = ["record_id", "field_name", "line_no", "pieces"]
    kinds = {r["label"]: r["n"] for r in found.where("label is not null").groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(kinds) < 2:
        return found.select(*out, F.coalesce(F.col("label"), F.lit(0)).cast("double").alias("probability"))
    rows = ws.save(_with_features(found, markov_table(found)), "features")
    vectors = rows.withColumn("x", array_to_vector("features")).withColumn("y", F.col("label").cast("double"))
    share = min(0.8, train_rows / sum(kinds.values()))
    bar = int(share * 2**31)
    fit = LogisticRegression(featuresCol="x", labelCol="y", maxIter=40, regParam=5e-4, standardization=False)
    model = fit.fit(vectors.where((F.col("label").isNotNull()) & (F.col("fold") < bar)).select("x", "y"))
    raw = model.transform(vectors.select(*out, "x", "y", "label", "fold")).withColumn("margin", vector_to_array("rawPrediction")[1])
    held = raw.where((F.col("label").isNotNull()) & (F.col("fold") >= bar) & (F.col("fold") < 2 * bar + 2**29)).select(array_to_vector(F.array("margin")).alias("m"), "y")
    slope, shift = 1.0, 0.0
    if held.select("y").distinct().count() == 2:
        platt = LogisticRegression(featuresCol="m", labelCol="y", maxIter=50, regParam=1e-4).fit(held)
        if platt.coefficients[0] > 0:
            slope, shift = float(platt.coefficients[0]), float(platt.intercept)
    p = 1 / (1 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), F.col("margin") * slope + shift))))
    return raw.select(*out, p.alias("probability"))


def credential_lines(marked: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """Distinct ``(record_id, field_name, line_no)`` of the candidates at or over the cutoff."""
    return marked.where(F.col("probability") >= cutoff).select("record_id", "field_name", "line_no").distinct()


def masked(records: DataFrame, marked: DataFrame, fields: tuple[str, ...] = ("orig_context", "eval_script"), id_col: str = "record_id", cutoff: float = CUTOFF) -> DataFrame:
    """``(record_id, *fields, masked_values)`` with the credentials replaced by a mask.

    Everything but the values is kept, line ends included.  Rows that repeat an id are
    masked alike.
    """
    spans = marked.where(F.col("probability") >= cutoff).groupBy("record_id").agg(F.collect_set(F.struct("field_name", "pieces")).alias("spans"))
    base = records.select(F.col(id_col).cast("bigint").alias("record_id"), *[F.col(f).cast("string").alias(f) for f in fields])
    joined = base.join(spans, "record_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = {n: batch.column(n).to_pylist() for n in batch.schema.names}
            counts = []
            for i, spans_ in enumerate(cols["spans"]):
                counts.append(len(spans_ or ()))
                pieces = {(p["start"], p["stop"], s["field_name"]) for s in spans_ or () for p in s["pieces"]}
                for start, stop, field in sorted(pieces, reverse=True):
                    text = cols[field][i]
                    value = text[start:stop]
                    cols[field][i] = text[:start] + (MASK if "\n" not in value else re.sub(r"[^\r\n]+", MASK, value)) + text[stop:]
            yield pa.record_batch([batch.column("record_id"), *(pa.array(cols[f], pa.string()) for f in fields), pa.array(counts, pa.int32())], ["record_id", *fields, "masked_values"])

    return joined.mapInArrow(run, "record_id bigint, " + ", ".join(f"`{f}` string" for f in fields) + ", masked_values int")
