"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in whole texts: at-signs, plus signs, digits, URL schemes and identifier cues.
Around each anchor a small deterministic parser expands to the left and right and validates what it finds. Digits are
joined into runs first, so a number is parsed once, however long it is. Cues count in either case. Memory is
proportional to one text; whether an added span is free is looked up in sorted spans.

Base kinds, each leftmost and without overlaps, failing candidates dropped without a second try:
``email`` (local part, at-sign, at least two labels), ``ip`` (four numbers up to 255), ``card`` (13 to 19 digits with
single spaces or hyphens between, Luhn), ``phone`` (plus sign, 9 to 15 digits).
Added kinds, which never replace a base span: ``iban`` (two letters, two digits, 11 to 30 more, mod 97), ``account`` (6 or
more digits behind a cue such as "account no", "passport" or "ssn") and ``login`` (user and password in a URL).

Positions are code points, end exclusive. Null and empty texts have no spans. Rows are independent: repeated rows and ids
give equal results; other columns stay, and columns of a result's name are replaced.
"""

from __future__ import annotations

import bisect
import functools
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from formline.llm.common import add_struct, fresh, without

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "account", "login")
CUES = ["account", "acct", "iban", "passport", "ssn", "social security", "tax id", "konto", "cuenta", "compte"]
SPANS = ArrayType(StructType([
    StructField("kind", StringType(), False), StructField("begin", IntegerType(), False), StructField("end", IntegerType(), False),
]), False)
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
LOCAL = frozenset(LETTERS + "0123456789._%+-")
LABEL = frozenset(LETTERS + "0123456789-")
IN_PHONE = frozenset(" ().0123456789-")
DIGITS = frozenset("0123456789")
FOLD = {ord(c): c.lower() for c in LETTERS[:26]}
UPPER = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
NUMBER = re.compile(r"\W{0,3}(?:(?:no|nr|number|num|id)\b\W{0,3})?([0-9](?:[ -]?[0-9]){5,})", re.I)


@functools.cache
def automaton():
    found = ahocorasick.Automaton()
    for kind, words in (("@", ["@"]), ("+", ["+"]), ("0", sorted(DIGITS)), ("://", ["://"]), ("cue", CUES)):
        for word in words:
            found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def email_at(text: str, at: int, least: int) -> tuple[int, int] | None:
    """The address around the at-sign, its local part not before ``least``."""
    begin = at
    while begin > least and text[begin - 1] in LOCAL:
        begin -= 1
    if begin == at:
        return None
    end, here, labels = -1, at + 1, 0
    while True:
        stop = here
        while stop < len(text) and text[stop] in LABEL:
            stop += 1
        if stop == here:
            break
        labels += 1
        end = stop
        if stop >= len(text) or text[stop] != ".":
            break
        here = stop + 1
    return (begin, end) if labels > 1 else None


def phone_at(text: str, at: int) -> tuple[int, int] | None:
    """What the plus sign begins, up to the last digit of its run."""
    if at + 1 >= len(text) or text[at + 1] not in DIGITS:
        return None
    stop = at + 2
    while stop < len(text) and text[stop] in IN_PHONE:
        stop += 1
    while stop > at + 3 and text[stop - 1] not in DIGITS:
        stop -= 1
    return (at, stop) if stop > at + 3 else None


def digit_runs(at: list[int]) -> list[tuple[int, int]]:
    runs: list[tuple[int, int]] = []
    for p in at:
        if runs and runs[-1][1] == p:
            runs[-1] = runs[-1][0], p + 1
        else:
            runs.append((p, p + 1))
    return runs


def ips(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out, i = [], 0
    while i + 3 < len(runs):
        if all(runs[i + k + 1][0] == runs[i + k][1] + 1 and text[runs[i + k][1]] == "." for k in range(3)):
            parts = [text[b:e].lstrip("0") for b, e in runs[i:i + 4]]
            if all(len(p) <= 3 and int(p or "0") <= 255 for p in parts):
                out.append((runs[i][0], runs[i + 3][1]))
            i += 4
        else:
            i += 1
    return out


def cards(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out, i = [], 0
    while i < len(runs):
        k = i
        while k + 1 < len(runs) and runs[k + 1][0] == runs[k][1] + 1 and text[runs[k][1]] in " -":
            k += 1
        digits = sum(e - b for b, e in runs[i:k + 1])
        if 13 <= digits <= 19 and luhn("".join(text[b:e] for b, e in runs[i:k + 1])):
            out.append((runs[i][0], runs[k][1]))
        i = k + 1
    return out


def iban_at(text: str, begin: int) -> tuple[int, int] | None:
    """The account number whose check digits begin at ``begin`` behind two capitals; groups may be spaced."""
    if begin < 2 or not (text[begin - 2] in UPPER and text[begin - 1] in UPPER):
        return None
    if begin > 2 and (text[begin - 3] in LABEL):
        return None
    chars, here, ends = text[begin - 2:begin], begin, []
    while here < len(text) and len(chars) < 34:
        if text[here] in DIGITS or text[here] in UPPER:
            chars += text[here]
            if here + 1 >= len(text) or text[here + 1] not in LABEL:
                ends.append((here + 1, len(chars)))
        elif text[here] != " " or text[here - 1] == " ":
            break
        here += 1
    for end, n in reversed(ends):
        if n >= 15 and chars[2:4].isdigit():
            if int("".join(str(int(c, 36)) for c in chars[4:n] + chars[:4])) % 97 == 1:
                return begin - 2, end
    return None


def login_at(text: str, at: int) -> tuple[int, int] | None:
    """user:password between a scheme and the host."""
    begin = at
    stop = begin
    while stop < len(text) and not text[stop].isspace() and text[stop] not in "/?#\"'<>@":
        stop += 1
    return (begin, stop) if stop < len(text) and text[stop] == "@" and ":" in text[begin + 1:stop] else None


def spans_of(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, begin, end) by kind as listed, then begin."""
    if not text:
        return []
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    digits: list[int] = []
    schemes, cues = [], []
    folded = text.lower()
    if len(folded) != len(text):  # a letter whose small form is longer would shift positions
        folded = text.translate(FOLD)
    done = 0
    for last, (kind, size) in automaton().iter(folded):
        if kind == "0":
            digits.append(last)
        elif kind == "@":
            span = email_at(text, last, done)
            if span:
                found["email"].append(span)
                done = span[1]
        elif kind == "+":
            span = phone_at(text, last)
            if span and 9 <= sum(c in DIGITS for c in text[slice(*span)]) <= 15:
                found["phone"].append(span)
        elif kind == "://":
            schemes.append(last + 1)
        else:
            cues.append((last + 1 - size, last + 1))
    runs = digit_runs(digits)
    found["ip"], found["card"] = ips(text, runs), cards(text, runs)
    begins: list[int] = []  # of the stretches that base and added spans cover, in order and apart
    ends: list[int] = []
    for b, e in sorted(s for k in BASE for s in found[k]):
        if ends and b < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            begins.append(b)
            ends.append(e)

    def add(kind: str, span: tuple[int, int] | None) -> None:
        if not span:
            return
        at = bisect.bisect_left(begins, span[1])
        if at and ends[at - 1] > span[0]:
            return
        found[kind].append(span)
        begins.insert(at, span[0])
        ends.insert(at, span[1])

    for b, e in runs:
        if e - b >= 2:
            add("iban", iban_at(text, b))
    for b, e in cues:
        if b and text[b - 1].isalnum():
            continue
        number = NUMBER.match(text, e)
        add("account", number and number.span(1))
    for at in schemes:
        add("login", login_at(text, at))
    return [(k, b, e) for k in KINDS for b, e in sorted(found[k])]


def find(docs: DataFrame, text: str = "text", name: str = "pii") -> DataFrame:
    """``docs`` with an array ``name`` of (kind, begin, end)."""
    inner = fresh("found", docs)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("begin", pa.int32()), ("end", pa.int32())]))

    def batch(texts: list) -> pa.Array:
        rows = [[{"kind": k, "begin": b, "end": e} for k, b, e in spans_of(t)] for t in texts]
        return pa.StructArray.from_arrays([pa.array(rows, kind)], names=["spans"])

    added = add_struct(docs, text, inner, StructType([StructField("spans", SPANS)]), batch)
    rest = [f"`{c}`" for c in without(docs, [name]).columns]
    return added.selectExpr(*rest, f"`{inner}`.spans AS `{name}`")
