"""Broken JSON of model answers, mended.

A pushdown machine reads the characters of an answer once. Its state is the stack of open objects and arrays, and for the
innermost one what may come next; whatever it writes is a value, key or mark that may stand there, so what it writes always
parses. It leaves out what can't be placed: reasoning blocks, prose before and after, remarks in brackets between values,
doubled and trailing commas, closing marks of nothing that is open. It adds what is missing: commas and colons between
values, marks that close what a cut left open, null for a value that was never written. A quote within a string closes it
if what follows could follow a string, else it is part of the text and gets its backslash. If an object was closed too early
(keys follow it), it is opened again. Memory is that of one answer.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

THINK = re.compile(r"<think>.*?</think>", re.DOTALL)
SPACE = re.compile(r"[ \t\r\n\f\v]*")
BARE = re.compile(r'[^\s,:{}\[\]"()]+')
NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?")
ESCAPE = re.compile(r'\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})')
CONTROL = re.compile(r"[\x00-\x1f]")
KEY_AHEAD = re.compile(r'[\s,]*"(?:[^"\\]|\\.)*"\s*:', re.DOTALL)
INNER = re.compile(r'(?:[^"\\]|\\.)*', re.DOTALL)
BRACKET = re.compile(r"[()]")
REMARK = 1024
LITERALS = ("true", "false", "null")


def remark_end(s: str, i: int) -> int:
    """Where the bracketed remark that opens at i ends; -1 if it isn't closed within REMARK characters."""
    depth = 0
    for m in BRACKET.finditer(s, i, i + REMARK):
        depth += 1 if m.group() == "(" else -1
        if not depth:
            return m.end()
    return -1


def beyond(s: str, i: int, marks: str = "") -> int:
    """The first place from i on that is neither white space nor a remark, nor one of the marks behind a remark."""
    seen = ""
    while True:
        i = SPACE.match(s, i).end()
        if s[i : i + 1] == "(" and (j := remark_end(s, i)) > 0:
            i, seen = j, marks
        elif s[i : i + 1] and s[i] in seen:
            i += 1
        else:
            return i


def before(s: str, k: int, marks: tuple[str, ...]) -> bool:
    """Whether a string begins at k that one of the marks follows; with an empty mark, also one that was cut or ends all."""
    m = INNER.match(s, k + 1).end() + 1
    after = beyond(s, m) if m < len(s) else m
    return s[after : after + 1] in marks


def closes(s: str, i: int) -> bool:
    """Whether the quote at i, met within a string, ends it: what follows is a mark that may follow a string, the end, a
    comma before something that may follow a comma (also a string that was cut there), or, on another line, a key."""
    j = beyond(s, i + 1)
    c = s[j : j + 1]
    if c == '"':
        return "\n" in s[i:j] and before(s, j, (":",))
    if c != ",":
        return c in ("", "}", "]", ":")
    k = beyond(s, j + 1, ",")
    if s[k : k + 1] != '"':
        return s[k : k + 1] in ("", "{", "}", "[", "]")
    return before(s, k, (":", ",", "]", ""))


def string_at(s: str, i: int) -> tuple[str, int]:
    """(the string whose quote stands at i, as JSON; where it ends). It runs to the end if nothing closes it."""
    out, j = ['"'], i + 1
    while j < len(s):
        c = s[j]
        if c == '"':
            if closes(s, j):
                return "".join([*out, '"']), j + 1
            out.append('\\"')
        elif c == "\\":
            m = ESCAPE.match(s, j)
            if m:
                out.append(m.group())
                j = m.end()
                continue
            if len(s) - j > 6 or not re.fullmatch(r"\\(?:u[0-9a-fA-F]{0,3})?", s[j:]):  # else it was cut within an escape
                out.append("\\\\")
            else:
                break
        else:
            out.append(f"\\u{ord(c):04x}" if c < " " and c not in "\t\r\n" else {"\t": "\\t", "\r": "\\r", "\n": "\\n"}.get(c, c))
        j += 1
    return "".join([*out, '"']), len(s)


def scalar(word: str, cut: bool) -> str:
    """A bare word as a JSON value; cut: it stands at the end, where it may be the beginning of one."""
    low = word.lower()
    if NUMBER.fullmatch(word) or low in LITERALS:
        return word if word not in ("True", "False", "TRUE", "FALSE", "Null", "NULL") else low
    if low == "none":
        return "null"
    if cut:
        m = NUMBER.match(word)
        return next((x for x in LITERALS if x.startswith(low)), m.group() if m and m.group() not in ("", "-") else "null")
    return json.dumps(word, ensure_ascii=False)


def healed(answer: str) -> str:
    """JSON of an answer: itself if it parses, else what the machine makes of it; `{}` if it has no object or array."""
    try:
        json.loads(answer)
        return answer
    except (ValueError, RecursionError):
        pass
    s = THINK.sub("", answer).strip()
    starts = [x for x in (s.find("{"), s.find("[")) if x >= 0]
    if not starts:
        return "{}"
    out: list[str] = []
    stack: list[list[str]] = []  # [kind, what may come next: key, colon, value or next]
    gap, comma, i = "", False, min(starts)
    first: list[bool] = []  # of each open object or array: nothing written yet

    def item() -> None:
        """Before a key or an element: a comma, if it isn't the first."""
        nonlocal gap
        if stack:
            if not first[-1]:
                out.append(",")
            first[-1] = False
        out.append(gap)
        gap = ""

    def close() -> None:
        kind, state = stack.pop()
        first.pop()
        out.append({"colon": ":null", "value": "null"}.get(state, "") if kind == "{" else "")
        out.append("}" if kind == "{" else "]")
        if stack:
            stack[-1][1] = "next"

    def place() -> str:
        """What a value that comes now is: a key or a value; marks that are missing before it are written."""
        nonlocal gap
        if not stack:
            return "value"
        kind, state = stack[-1]
        if kind == "[" or state in ("key", "next"):
            item()
            return "key" if kind == "{" else "value"
        out.append((":" if state == "colon" else "") + gap)
        gap = ""
        return "value"

    while i < len(s):
        c = s[i]
        space = SPACE.match(s, i)
        if space.end() > i:
            gap += space.group() if not CONTROL.search(space.group().replace("\n", "").replace("\r", "").replace("\t", "")) else " "
            i = space.end()
        elif c == "(":
            end = remark_end(s, i)
            line = s.find("\n", i)
            i = end if end > 0 else line if line > 0 else len(s)
        elif c in "{[":
            if stack and stack[-1][0] == "{" and stack[-1][1] in ("key", "next"):  # no key: its fields are the outer one's
                i += 1
                continue
            place()
            out.append(c)
            stack.append([c, "key" if c == "{" else "value"])
            first.append(True)
            i += 1
        elif c in "}]":
            i += 1
            if any(k == ("{" if c == "}" else "[") for k, _ in stack):
                while stack[-1][0] != ("{" if c == "}" else "["):
                    close()
                early = c == "}" and KEY_AHEAD.match(s, i) and (len(stack) == 1 or stack[-2][0] == "[")
                if early:  # keys follow: it isn't closed yet
                    if stack[-1][1] in ("colon", "value"):
                        out.append(":null" if stack[-1][1] == "colon" else "null")
                    stack[-1][1] = "next"
                    continue
                out.append(gap)
                gap = ""
                close()
                if not stack:
                    break
        elif c in ",:":
            if c == ":" and stack and stack[-1] == ["{", "colon"]:
                out.append(":")
                stack[-1][1] = "value"
            i += 1
        else:
            if c == '"':
                text, i = string_at(s, i)
            else:
                m = BARE.match(s, i)
                if not m:  # a closing bracket of no remark
                    i += 1
                    continue
                i = m.end()
                text = ""
            as_ = place()
            if as_ == "key":
                out.append(text or json.dumps(m.group(), ensure_ascii=False))
                stack[-1][1] = "colon"
            else:
                out.append(text or scalar(m.group(), i >= len(s)))
                stack[-1][1] = "next"
    while stack:
        close()
    return "".join(out)


@F.pandas_udf(StringType())
def heal(answers: pd.Series) -> pd.Series:
    """healed() of each answer; null for null."""
    return answers.map(lambda a: None if a is None else healed(a))
