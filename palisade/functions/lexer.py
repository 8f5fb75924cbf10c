"""Calls in Python and TypeScript source by one linear pass with a stack of modes.

Built-in expressions have no stack, so this is a Python function over Arrow batches: the one place where source code is read by
Python. A mode is code (with the bracket that closes it), string, f-string or template text, their interpolations and format
specifications, regex literal, type arguments, JSX tag or JSX text. A call's bracket keeps the arguments that lie right in it, any other the last of them, so that depth
costs nothing and a long list of data takes no room. Lines and columns are counted from call to call.
Unclosed calls are not found; an unclosed string ends with its line (or with the text, if it may hold line ends).
"""

from __future__ import annotations

import keyword
import re
from collections.abc import Iterable

from pyspark.sql import types as T

#: What a call is given as: places are in code points from 0, line and column count from 1, the column in bytes. ``last`` is the end of the last argument;
#: object, object_end and object_last are those of the first argument that is an object literal and of its last entry, else null.
CALLS = T.ArrayType(
    T.StructType(
        [
            T.StructField("head", T.StringType()),
            *[T.StructField(c, T.IntegerType()) for c in ("start", "args_start", "args_end", "line", "column", "last", "object", "object_end", "object_last")],
            T.StructField("arguments", T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType())]))),
        ]
    )
)

_PY = re.compile(
    r"""(?P<skip>(?:[^\S\n]|\\\r?\n|\#[^\n]*)+)|(?P<line>\n)
    |(?P<string>(?P<prefix>(?i:rb|br|fr|rf|tr|rt|[rbuft])?)(?P<quote>\"{3}|'{3}|"|'))
    |(?P<name>[^\W\d]\w*)|(?P<number>\d(?:[eE][+-]|[\w.])*)|(?P<open>[(\[{])|(?P<close>[)\]}])|(?P<dot>\.(?![.\d]))
    |(?P<op>\*\*|[=!<>:+\-*/%&|^@]=|->|\.{3}|.)""",
    re.X | re.S,
)
_TS = re.compile(
    r"""(?P<skip>(?:\s|//[^\n]*|/\*(?:[^*]|\*(?!/))*+(?:\*/)?)+)|(?P<quote>["'`])
    |(?P<name>[^\W\d$]?[\w$]*[\w$])|(?P<open>[(\[{])|(?P<close>[)\]}])|(?P<op>\.{3}|=>|\+\+|--|\?\.|.)""",
    re.X | re.S,
)
_PLAIN = {q: re.compile(rf"(?:[^{q}\\\n]|\\.)*+{q}?", re.S) for q in "\"'"}
_LONG = {q * 3: re.compile(rf"(?:[^{q}\\]|\\.|{q}(?!{q}{q}))*+(?:{q * 3})?", re.S) for q in "\"'"}
_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/\w*")
_ELEMENT = re.compile(r"<\s*(?:>|[^\W\d][\w$.:-]*(?![\w$.:-])(?!\s*,|\s+extends\b))")
_TAG = re.compile(r"""(?:[^"'{<>/]|/(?!>))*""")
_BEFORE_OPERAND = set("return typeof case in of delete void throw new else do instanceof yield await default extends".split())


class _Frame:
    """A mode on the stack; for brackets, with the arguments seen in it and the primary expression that is being read."""

    __slots__ = ("kind", "close", "at", "call", "begin", "names", "dot", "word", "arguments", "arg", "end", "what", "name", "tokens", "object", "inner", "quote", "raw")

    def __init__(self, kind: str, close: str = "", at: int = -1, call: tuple | None = None, quote: str = "", raw: bool = False):
        self.kind, self.close, self.at, self.call, self.quote, self.raw = kind, close, at, call, quote, raw
        self.begin, self.names, self.dot, self.word = -1, [], False, ""
        self.arguments, self.object, self.inner = [], None, None
        self.arg, self.end, self.what, self.name, self.tokens = -1, -1, None, None, 0

    def token(self, start: int, end: int, what: str) -> None:
        if self.arg < 0:
            self.arg = start
        self.end, self.tokens = end, self.tokens + 1
        self.what = what if self.tokens == 1 else self.what if self.what == "splat" else "other"

    def comma(self) -> None:
        if self.arg >= 0:
            if self.call is None:  # of a list or object literal the last end alone is asked for
                self.arguments.clear()
            self.arguments.append((self.name, self.arg, self.end, self.what or "other"))
            if self.what == "object" and self.object is None:
                self.object = self.inner
        self.arg, self.what, self.name, self.tokens = -1, None, None, 0

    def nothing(self) -> None:
        self.begin, self.dot = -1, False


def _closed(stack: list[_Frame], close: str) -> _Frame | None:
    """Pops the frame that a bracket closes, with unclosed ones above it; None where it closes nothing."""
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].close == close:
            frame = stack[i]
            del stack[i:]
            frame.comma()
            return frame
        if stack[i].kind != "code":
            return None
    return None


def _call(frame: _Frame, end: int, out: list) -> None:
    head, start = frame.call
    last = frame.arguments[-1][2] if frame.arguments else frame.at + 1
    out.append((head, start, frame.at, end, last, *(frame.object or (None, None, None)), frame.arguments))


def _python(text: str, wanted: set[str]) -> list[tuple]:
    out: list[tuple] = []
    stack = [_Frame("code")]
    at, n = 0, len(text)

    def operand(top, start, end, what):
        top.token(start, end, what)
        if top.begin < 0 or top.dot:
            top.begin = start
        top.names, top.dot = [""], False

    while at < n:
        top = stack[-1]
        if top.kind == "text":  # of an f-string
            end = at
            while True:
                end = _until(text, end, "{}\\\n" + top.quote[0])
                if end >= n or text.startswith(top.quote, end) or (text[end] == "\n" and len(top.quote) == 1):
                    at = end + (len(top.quote) if text.startswith(top.quote, end) else 0)
                    stack.pop()
                    operand(stack[-1], top.at, at, "string")
                    break
                if text[end] == "\\":
                    end += 2 if text[end + 1 : end + 2] not in ("{", "}") else 1
                elif text.startswith(("{{", "}}"), end):
                    end += 2
                elif text[end] == "{":
                    stack.append(_Frame("code", "}", end, quote="f"))
                    at = end + 1
                    break
                else:
                    end += 1
            continue
        if top.kind == "spec":  # behind the colon of an interpolation
            end = _until(text, at, "{}\n")
            if end < n and text[end] == "{":
                stack.append(_Frame("code", "}", end, quote="f"))
            else:
                stack.pop()
                if end < n and text[end] == "}":
                    stack.pop()
            at = end + 1
            continue
        m = _PY.match(text, at)
        kind, start, at = m.lastgroup, at, m.end()
        if kind == "skip":
            continue
        if kind == "line":
            if len(stack) == 1:
                top.nothing()
            continue
        if kind == "quote" or kind == "string":
            prefix, quote = m["prefix"].lower(), m["quote"]
            if "f" in prefix or "t" in prefix:
                stack.append(_Frame("text", "", start, quote=quote))
                continue
            at = (_PLAIN if len(quote) == 1 else _LONG)[quote].match(text, at).end()
            operand(top, start, at, "string")
        elif kind == "name":
            word = m[0]
            if top.dot:
                top.names.append(word)
                top.dot = False
            elif keyword.iskeyword(word):
                top.nothing()
            else:
                top.begin, top.names = (-1, []) if top.word in ("class", "def") else (start, [word])
            top.word = word
            top.token(start, at, "name")
            continue
        elif kind == "number":
            operand(top, start, at, "other")
        elif kind == "open":
            call = None
            if m[0] == "(" and top.begin >= 0 and top.names and top.names[-1] in wanted:
                call = (".".join(top.names), top.begin)
            stack.append(_Frame("code", {"(": ")", "[": "]", "{": "}"}[m[0]], start, call))
        elif kind == "close":
            frame = _closed(stack, m[0])
            if frame is None:
                top.nothing()
                continue
            if frame.quote:  # an interpolation
                continue
            if frame.call:
                _call(frame, at, out)
            top = stack[-1]
            if frame.close == "}" and top.tokens == 0:
                top.inner = (frame.at, at, frame.arguments[-1][2] if frame.arguments else frame.at + 1)
            top.token(frame.at, at, "object" if frame.close == "}" else "other")
            if top.begin < 0:
                top.begin = frame.at
            top.names, top.dot = [""], False
        elif kind == "dot" and top.begin >= 0:
            top.dot = True
            top.token(start, at, "other")
        elif m[0] == ",":
            top.comma()
            top.nothing()
        elif m[0] == "=" and top.tokens == 1 and top.what == "name":
            top.name, top.tokens, top.what = text[top.arg : top.end], 0, None
            top.nothing()
        elif m[0] == ":" and top.quote == "f":
            stack.append(_Frame("spec"))
        else:
            top.nothing()
            top.token(start, at, "splat" if m[0] in ("*", "**") and top.tokens == 0 else "other")
        top.word = ""
    return out


def _until(text: str, at: int, signs: str) -> int:
    """The next place of one of these signs, or the text's end."""
    m = _SIGNS.setdefault(signs, re.compile(f"[{re.escape(signs)}]")).search(text, at)
    return m.start() if m else len(text)


_SIGNS: dict[str, re.Pattern] = {}


def _types_end(text: str, at: int) -> int:
    """The end of the type arguments that begin at ``at``, or -1."""
    depth = 0
    while m := _TS.match(text, at):
        at, sign = m.end(), m[0]
        if m.lastgroup == "quote":
            at = _PLAIN[sign].match(text, at).end() if sign != "`" else _until(text, at, "`") + 1
        elif sign == "<":
            depth += 1
        elif sign == ">":
            depth -= 1
            if not depth:
                return at
        elif sign == ";":
            return -1
    return -1


def _script(text: str, wanted: set[str], jsx: bool) -> list[tuple]:
    out: list[tuple] = []
    stack = [_Frame("code")]
    at, n = 0, len(text)
    operand, fresh = False, None  # does an operand end here; (start, class) behind "new Class"
    before = ("", -1)  # the name right before, and its place

    def ended(frame, end):
        """A template, element or the like is one operand of the code around it."""
        if stack[-1].kind == "code":
            stack[-1].token(frame.at, end, "other")

    while at < n:
        top = stack[-1]
        if top.kind == "template":
            end = _until(text, at, "`\\$")
            at = end + 1
            if end < n and text[end] == "\\":
                at += 1
            elif text.startswith("${", end):
                stack.append(_Frame("code", "}", end, quote="$"))
                at, operand, fresh, before = end + 2, False, None, ("", -1)
            elif end >= n or text[end] == "`":
                stack.pop()
                ended(top, at)
                operand = True
            continue
        if top.kind == "tag":
            end = _TAG.match(text, at).end()
            at, sign = end + 1, text[end : end + 1]
            if sign in ("'", '"'):
                at = _until(text, at, sign) + 1
            elif sign == "{":
                stack.append(_Frame("code", "}", end, quote="$"))
                operand, fresh, before = False, None, ("", -1)
            elif sign == "<":
                at = max(at, _types_end(text, end))
            elif sign == ">":
                top.kind = "words"
            elif sign == "/":
                at = end + 2
                stack.pop()
                ended(top, at)
                operand = True
            continue
        if top.kind == "words":  # text between tags
            end = _until(text, at, "<{")
            at = end + 1
            if text.startswith("</", end):
                at = _until(text, end, ">") + 1
                stack.pop()
                ended(top, at)
                operand = True
            elif text.startswith("{", end):
                stack.append(_Frame("code", "}", end, quote="$"))
                operand, fresh, before = False, None, ("", -1)
            elif e := _ELEMENT.match(text, end):
                stack.append(_Frame("tag", "", end))
                at = e.end() - (e[0][-1] == ">")
            continue
        m = _TS.match(text, at)
        kind, start, at = m.lastgroup, at, m.end()
        if kind == "skip":
            continue
        sign, made, last = m[0], fresh, before
        fresh, before = None, ("", -1)
        if kind == "quote":
            if sign == "`":
                stack.append(_Frame("template", "", start))
                continue
            at = _PLAIN[sign].match(text, at).end()
            top.token(start, at, "string")
            operand = True
        elif kind == "name":
            if last[0] == "new" and sign in wanted:
                fresh = (last[1], sign)
            before = (sign, start) if not top.dot else ("", -1)
            operand = top.dot or sign not in _BEFORE_OPERAND
            top.dot = False
            top.token(start, at, "name")
            continue
        elif kind == "open":
            call = (f"new {made[1]}", made[0]) if made and sign == "(" else None
            stack.append(_Frame("code", {"(": ")", "[": "]", "{": "}"}[sign], start, call))
            operand = False
        elif kind == "close":
            frame = _closed(stack, sign)
            operand = True
            if frame is None:
                continue
            if frame.quote:  # an interpolation
                continue
            if frame.call:
                _call(frame, at, out)
            top = stack[-1]
            if frame.close == "}" and top.tokens == 0:
                top.inner = (frame.at, at, frame.arguments[-1][2] if frame.arguments else frame.at + 1)
            top.token(frame.at, at, "object" if frame.close == "}" else "other")
        elif sign == "/" and not operand and (r := _REGEX.match(text, start)):
            at, operand = r.end(), True
            top.token(start, at, "other")
        elif sign == "<" and made and (end := _types_end(text, start)) > 0:
            at, fresh = end, made
            continue
        elif sign == "<" and jsx and not operand and (e := _ELEMENT.match(text, start)):
            stack.append(_Frame("tag", "", start))
            at = e.end() - (e[0][-1] == ">")
        elif sign == ",":
            top.comma()
            operand = False
        else:
            top.token(start, at, "splat" if sign == "..." and top.tokens == 0 else "other")
            operand = operand and sign in ("++", "--", "!")
        top.dot = sign in (".", "?.")
    return out


def calls(text: str | None, grammar: str | None, wanted: dict[str, Iterable[str]]) -> list[tuple]:
    """The calls of one text as tuples of CALLS, in the order of their starts; grammar: python, typescript or tsx."""
    if not text or grammar is None:
        return []
    found = _python(text, set(wanted["python"])) if grammar == "python" else _script(text, set(wanted["typescript"]), grammar == "tsx")
    if not found:
        return []
    out = []
    line, column, at = 1, 1, 0
    for head, start, args, end, last, obj, obj_end, obj_last, arguments in sorted(found, key=lambda c: c[1:3]):
        if breaks := text.count("\n", at, start):
            line, column, at = line + breaks, 1, text.rfind("\n", at, start) + 1
        column, at = column + len(text[at:start].encode()), start
        out.append((head, start, args, end, line, column, last, obj, obj_end, obj_last, arguments))
    return out
