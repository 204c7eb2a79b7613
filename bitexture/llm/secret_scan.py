"""Secret scan: fixed patterns, and literals assigned to sensitive names."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: the base patterns and their shortest matches
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
MIN_ASSIGN, MIN_ACCESS = 6, 20

KINDS = ("assign", "access", "hex", "literal")
_ASSIGN_NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_HEX_MAP = bytes(1 if chr(b) in "0123456789abcdef" else 0 for b in range(256))
_HEX_RUN = b"\x01" * 24

#: How much a part of a name says about its value.
NAME_SCORES = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0,
    "credential": 0.9, "credentials": 0.9, "private": 0.6, "auth": 0.6, "bearer": 0.8, "access": 0.4, "key": 0.5,
    "signing": 0.4, "encryption": 0.4, "api": 0.4, "pass": 0.7, "pw": 0.6, "salt": 0.5,
}
_PLACEHOLDERS = re.compile(
    r"(?i)(?:x+|\*+|\.+|none|null|true|false|nil|undefined|changeme|example|placeholder|your[_-].*|<.*>|\$\{.*\}|\{\{.*\}\}|%\(?\w+.*)\Z"
)
#: A literal of a name and shape that score at least so much is a secret.
THRESHOLD = 0.5
MIN_LITERAL = 6

_NAME = r"[A-Za-z_][A-Za-z0-9_.\-]{0,127}"
_TOKEN = re.compile(
    rf"""(?P<comment>(?:(?<=\s)|^)(?:\#(?!\w{{3,8}};)|//)[^\n]*)
    |(?P<text>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`[^`\\\n]*`)
    |(?P<name>{_NAME})
    |(?P<op>:=|=>|==|!=|<=|>=|\+=|[=:+,;(){{}}\[\]])
    |(?P<line>\n)
    |(?P<bare>[^\s"'`=:+,;(){{}}\[\]\#][^\s"'`,;(){{}}\[\]]*)""",
    re.VERBOSE | re.MULTILINE,
)


def entropy(value: str) -> float:
    """Bits per character."""
    counts = Counter(value)
    return -sum(c / len(value) * math.log2(c / len(value)) for c in counts.values()) if value else 0.0


def name_score(name: str) -> float:
    """0 to 1: does the name say that its value is secret?"""
    parts = re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+", name)
    low = [p.lower() for p in parts]
    pairs = [a + b for a, b in zip(low, low[1:])]
    return min(1.0, sum(NAME_SCORES.get(p, 0.0) for p in dict.fromkeys(low + pairs)))


def literal_score(value: str) -> float:
    """0 to 1: does the value look like a secret?"""
    if len(value) < MIN_LITERAL or _PLACEHOLDERS.match(value) or any(c.isspace() for c in value):
        return 0.0
    kinds = sum(any(f(c) for c in value) for f in (str.islower, str.isupper, str.isdigit)) + any(not c.isalnum() for c in value)
    return min(1.0, entropy(value) / 4 + 0.15 * (kinds - 1))


class Value:
    """What an assignment gives a name: literals, and values of other names as
    they were then. Values are shared, never copied."""

    __slots__ = ("of", "spans")

    def __init__(self, spans: list[tuple[int, int]], of: list[Value]) -> None:
        self.spans, self.of = spans, of


_ASSIGNS = frozenset((":=", "=>", "=", ":", "+="))


def _target(tokens: list, i: int) -> tuple[str, str, int] | None:
    """Name, operator and place of the value, if a target begins at token ``i``:
    ``name =``, ``"name":``, ``at["name"] =``, ``name: type =`` or, as the first
    argument of a call, ``("name",``."""
    kind, m = tokens[i]
    if kind not in ("name", "text"):
        return None

    def at(k: int) -> str:
        return tokens[i + k][1].group() if i + k < len(tokens) else "\n"

    name, op = m.group().strip("\"'`"), at(1)
    if op == ":" and i + 3 < len(tokens) and tokens[i + 2][0] == "name":
        if at(3) == "=":
            return name, "=", i + 4
        if at(3) == "[" and at(5) == "]" and at(6) == "=":
            return name, "=", i + 7
    if op in _ASSIGNS:
        return name, op, i + 2
    if i and tokens[i - 1][1].group() == "[" and op == "]" and at(2) in ("=", "+=", ":="):
        return name, at(2), i + 3
    if i > 1 and kind == "text" and op == "," and at(-1) == "(" and tokens[i - 2][0] == "name":
        return name, ",", i + 2
    return None


def assignments(text: str) -> Iterator[tuple[str, Value]]:
    """Names and their values, in order, where literals reach them by ``name =
    "..."``, ``"name": ...``, ``name: bare``, ``at["name"] = ...``, ``name: type =
    ...``, ``call("name", "...")`` and the like. A name on the right side stands
    for what was assigned to it before (constants propagate, also through ``+``).
    The work grows with the tokens: values refer to one another."""
    known: dict[str, Value] = {}
    tokens = [(m.lastgroup, m) for m in _TOKEN.finditer(text) if m.lastgroup != "comment"]
    i, n = 0, len(tokens)
    while i < n - 2:
        target = _target(tokens, i)
        if target is None:
            i += 1
            continue
        name, op, j = target
        spans: list[tuple[int, int]] = []
        of: list[Value] = []
        while j < n:
            part, v = tokens[j]
            after = tokens[j + 1][1].group() if j + 1 < n else "\n"
            if part == "text":
                spans.append((v.start() + 1, v.end() - 1))
            elif op == ",":
                break  # only literals as arguments
            elif part == "name" and after in _ASSIGNS:
                break  # the next pair begins here
            elif part == "name" and v.group() in known:
                of.append(known[v.group()])
            elif part in ("name", "bare") and v.end() - v.start() >= MIN_LITERAL and any(c.isdigit() for c in v.group()):
                spans.append((v.start(), v.end()))
            else:
                break
            j += 1
            if after != "+":
                break
            j += 1
        if spans or of:
            if op == "+=" and name in known:
                of.append(known[name])
            value = Value(spans, of)
            if op != ",":
                known[name] = value
            yield name, value
        i = max(i + 1, j if tokens[i][0] == "text" or spans or of else i + 1)


def base_spans(text: str, raw: bytes) -> list[tuple[str, int, int]]:
    """Spans of the base patterns. ``raw`` is the text in UTF-8; it tells at the
    speed of a byte search which patterns can match at all."""
    spans = []
    low = raw.lower()
    if any(name in low for name in _ASSIGN_NAMES):
        spans += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if b"AKIA" in raw:
        spans += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    if _HEX_RUN in raw.translate(_HEX_MAP):
        spans += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def literal_spans(text: str, raw: bytes) -> list[tuple[str, int, int]]:
    """Literals that a sensitive name holds, scored by name and shape.

    Names are scored once each. Values are followed from the most telling names
    first, and each of them once: a literal counts with the most telling name
    that it reaches."""
    if not any(sign in raw for sign in (b"=", b":", b"(")):  # one of them is in every assignment
        return []
    scores: dict[str, float] = {}
    held: list[tuple[float, Value]] = []
    for name, value in assignments(text):
        s = scores.get(name)
        if s is None:
            s = scores[name] = name_score(name)
        if s >= THRESHOLD:  # a literal's own score is at most 1
            held.append((s, value))
    held.sort(key=lambda x: -x[0])
    found, seen, spans = [], set(), set()
    for s, value in held:
        todo = [value]
        while todo:
            v = todo.pop()
            if id(v) in seen:
                continue
            seen.add(id(v))
            todo += v.of
            for span in v.spans:
                if span not in spans and s * literal_score(text[slice(*span)]) >= THRESHOLD:
                    spans.add(span)
                    found.append(("literal", *span))
    return found


def scan(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and all spans, both by start, then kind."""
    text = text or ""
    raw = text.encode()
    base = base_spans(text, raw)
    every = sorted(base + literal_spans(text, raw), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    return base, every


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``n_assign, n_access, n_hex`` (base spans), ``base_spans`` and
    ``spans`` (``kind:start:end`` in code points, joined by commas) to every row.

    The fixed patterns are found in any text. Beyond them the text is lexed as
    source or configuration: literals are tied to the names they are assigned
    to, directly or through constants, and are reported (kind ``literal``) where
    the name is sensitive and the value looks like a secret. NULL and empty
    texts have no spans; added columns replace those of the input.
    """
    names = ["n_assign", "n_access", "n_hex", "base_spans", "spans"]

    @F.pandas_udf("n_assign bigint, n_access bigint, n_hex bigint, base_spans string, spans string")
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            base, every = scan(t)
            n = Counter(k for k, _, _ in base)
            rows.append((n["assign"], n["access"], n["hex"], joined(base), joined(every)))
        return pd.DataFrame(rows, columns=names)

    out = docs.drop(*names).withColumn("__s", run(F.col(text)))
    return out.select(*[c for c in out.columns if c != "__s"], "__s.*")
