"""Secrets in source, configuration and prose: fixed patterns, and literals that flow into names that sound secret.

A text is parsed into assignments (``name = literal``, ``"name": "literal"``, ``name := literal``, ``name => literal``,
``env["name"] = literal``). Names on the right stand for what was last assigned to them, so that a constant defined under
a harmless name is found where it reaches a sensitive one. The score of a literal is that of the most sensitive name it
reaches, times how much it looks like a secret and not like a word or a placeholder.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from touchline.llm.rows import pick, place, raw, slices

# The base patterns, in their order, with the least length of what counts.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_LEAST = 8
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ACCESS_LEAST = 16
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "named")
BASE_KINDS = KINDS[:3]

# Parts of names and how sensitive they make a name.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "passphrase": 1.0, "passwort": 1.0, "pwd": 0.9, "secret": 0.9, "token": 0.8, "apikey": 0.9,
             "credential": 0.8, "credentials": 0.8, "bearer": 0.8, "auth": 0.6, "key": 0.4}
QUALIFIED_KEY = {"api", "access", "private", "secret", "auth", "encryption", "signing", "session", "master", "account", "client"}
STEMS = (b"passw", b"passphrase", b"pwd", b"secret", b"token", b"key", b"credential", b"bearer", b"auth")
PLACEHOLDERS = {"changeme", "password", "secret", "token", "example", "placeholder", "undefined", "redacted", "required", "optional"}

BASE_STEMS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
HEX_BYTES = re.compile(rb"[0-9a-f]{32,}")
NAMED_LEAST = 8
NAMED_SCORE = 0.5

STATEMENT = re.compile(r"""
    (?:(?P<quote>["'`])(?P<quoted>[^"'`\n]{1,200})(?P=quote) | (?P<name>[A-Za-z_$][\w$.-]*))
    (?:\s*\[\s*["'](?P<entry>[^"'\]\n]{1,200})["']\s*\])?
    (?:[ \t]*:[ \t]*[A-Za-z_][\w.]*(?=[ \t]*=[^=]))?
    [ \t]*(?P<op>:=|=>|=(?!=)|:(?!:))[ \t]*
    """, re.VERBOSE)
TERM = re.compile(r"""
    (?P<quote>["'`])(?P<text>(?:\\.|(?!(?P=quote))[^\\\n])*)(?P=quote)
    | (?P<name>[A-Za-z_$][\w$.]*)(?=[ \t]*(?:[+;,)\]}\n\r]|$|=|:=))
    | (?P<bare>[^\s"'`,;(){}\[\]<>]+)
    """, re.VERBOSE)
JOIN = re.compile(r"[ \t]*(?:[+.][ \t]*\n?[ \t]*(?=[\"'`A-Za-z_$])|(?=[\"'`]))")
WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    value_start: int
    value_end: int
    score: float


def base_spans(text: str) -> list[Span]:
    """Matches of the fixed patterns, leftmost and non-overlapping per kind; too short ones take up their place but do not count."""
    found = [Span("assign", *m.span(), *m.span(2), 1.0) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    found += [Span("access", *m.span(), *m.span(), 1.0) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    found += [Span("hex", *m.span(), *m.span(), 1.0) for m in HEX.finditer(text)]
    return found


def name_score(name: str) -> float:
    """How sensitive a name sounds, 0 to 1, from its parts in camel, snake, kebab or dotted case."""
    parts = [p.lower() for p in WORDS.findall(name)]
    score = max((SENSITIVE.get(p, 0.0) for p in parts), default=0.0)
    score = max(score, max((SENSITIVE.get(a + b, 0.0) for a, b in zip(parts, parts[1:], strict=False)), default=0.0))
    if "key" in parts and QUALIFIED_KEY & set(parts):
        score = max(score, 0.9)
    return score


def literal_score(value: str) -> float:
    """How much a literal looks like a secret: long, no blanks, mixed characters; placeholders and references score 0."""
    plain = value.strip().lower()
    if len(value) < NAMED_LEAST or plain in PLACEHOLDERS or re.search(r"\s|^[<{%$]|\$\{|^(.)\1*$", value):
        return 0.0
    counts = Counter(value)
    entropy = -sum(n / len(value) * math.log2(n / len(value)) for n in counts.values())
    kinds = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", r"[^A-Za-z0-9]"))
    return min(1.0, entropy / 3.5) * (1.0 if kinds > 1 else 0.55)


def assignments(text: str) -> list[tuple[str, int, list[tuple[str, object]]]]:
    """``(name, position, terms)`` of each assignment; a term is a literal's place or a name."""
    out = []
    for m in STATEMENT.finditer(text):
        name = m["entry"] or m["quoted"] or m["name"]
        terms, at = [], m.end()
        while (t := TERM.match(text, at)) and t.end() > at:
            if t["text"] is not None:
                terms.append(("literal", t.span("text")))
            elif t["name"] is not None:
                terms.append(("name", t["name"]))
                terms.append(("word", t.span("name")))
            else:
                terms.append(("literal", t.span("bare")))
            joint = JOIN.match(text, t.end())
            if not joint:
                break
            at = joint.end()
        if terms:
            out.append((name, m.start(), terms))
    return out


def named_spans(text: str, least: float = NAMED_SCORE) -> list[Span]:
    """Literals that reach a sensitive name, each with its highest score, in order."""
    found = assignments(text)
    places: dict[str, list[int]] = {}
    for i, (name, _, _) in enumerate(found):
        places.setdefault(name, []).append(i)
    scores: dict[tuple[int, int], float] = {}
    weights = {i: weight for i, (name, _, _) in enumerate(found) if (weight := name_score(name)) > 0}
    seen: set[int] = set()  # what a more sensitive name has reached needs no second visit
    for i in sorted(weights, key=lambda i: -weights[i]):
        weight, todo = weights[i], [i] if i not in seen else []
        seen.add(i)
        while todo:
            k = todo.pop()
            for kind, what in found[k][2]:
                if kind == "name":
                    defs = places.get(what, [])
                    at, after = bisect.bisect_left(defs, k), bisect.bisect_right(defs, k)
                    source = defs[at - 1] if at else defs[after] if after < len(defs) else None
                    if source is not None and source not in seen:
                        seen.add(source)
                        todo.append(source)
                elif kind == "literal" or (text[slice(*what)] not in places and re.search("[0-9]", text[slice(*what)])):
                    score = weight * literal_score(text[slice(*what)])
                    if score >= least and score > scores.get(what, 0.0):
                        scores[what] = score
    return [Span("named", *where, *where, round(score, 4)) for where, score in sorted(scores.items())]


def spans(data: bytes | None) -> list[Span]:
    """All spans of one text (UTF-8), by start and then by kind in the order of ``KINDS``."""
    if not data:
        return []
    low = data.lower()
    base = b"AKIA" in data or any(s in low for s in BASE_STEMS) or HEX_BYTES.search(data) is not None
    named = any(s in low for s in STEMS) and (b"=" in data or b":" in data)
    if not (base or named):
        return []
    text = data.decode("utf-8", "replace")
    found = (base_spans(text) if base else []) + (named_spans(text) if named else [])
    return sorted(found, key=lambda s: (s.start, KINDS.index(s.kind), s.end))


SPAN_TYPE = "array<struct<kind:string,start:long,end:long,value_start:long,value_end:long,score:double>>"
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value_start", pa.int64()), ("value_end", pa.int64()), ("score", pa.float64())]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id and ``spans`` in code points, ends exclusive.

    Bytes that are not UTF-8 count as replacement characters; very long texts take time in proportion to their length.

    Null and empty texts have no spans; repeated rows each come back; a null id stays null; an empty table gives an
    empty result. Other columns of ``docs`` play no part, whatever their names.
    """
    source = pick(docs, doc_id=id_col, text=text_col)

    def scan_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            found = [[s._asdict() for s in spans(t)] for t in raw(part, "text")]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, _ARROW_SPANS)], ["doc_id", "spans"])

    return source.mapInArrow(scan_rows, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, spans {SPAN_TYPE}")


def redacted(data: bytes, mark: str) -> str:
    """The text with the values of its spans replaced; overlapping ones are replaced together."""
    text, out, at = data.decode("utf-8", "replace"), [], 0
    joined: list[list[int]] = []
    for a, b in sorted((s.value_start, s.value_end) for s in spans(data)):
        if joined and a < joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], b)
        else:
            joined.append([a, b])
    for a, b in joined:
        out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", mark: str = "[secret]") -> DataFrame:
    """``docs`` with each secret value replaced by ``mark``; ``length_col``, where present, is set to the new length.

    Null texts, and rows without secrets, come back unchanged; so do repeats, each on its own, and an empty table.
    """
    names = docs.columns
    text = place(names, text_col)
    length = place(names, length_col) if length_col and length_col.lower() in [n.lower() for n in names] else None
    placed = docs.toDF(*[f"c{i}" for i in range(len(names))])
    schema = T.StructType([*placed.schema.fields, T.StructField("clean", T.StringType())])

    def clean_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, f"c{text}"):
            clean = [redacted(t, mark) if t and spans(t) else None for t in raw(part, f"c{text}")]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(clean, pa.string())], [*part.schema.names, "clean"])

    out = placed.mapInArrow(clean_rows, schema)
    columns = [F.col(f"c{i}") for i in range(len(names))]
    columns[text] = F.coalesce("clean", f"c{text}")
    if length is not None:
        columns[length] = F.when(F.col("clean").isNull(), F.col(f"c{length}")).otherwise(F.length("clean").cast(placed.schema[length].dataType))
    return out.select(*[c.alias(f"d{i}") for i, c in enumerate(columns)]).toDF(*names)
