"""One linear pass over source text by a stack of modes: code, template, interpolation, tag, and text between tags.

What it tells: where comments and strings lie (interpolated code is code), which bracket closes which, and what is wrong with
either. Languages with braces only; masked() of text.py reads the others by comments and strings alone.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass, field

JAVASCRIPT = frozenset({"javascript", "typescript"})
BRACES = JAVASCRIPT | {"java", "kotlin", "scala", "go", "rust", "csharp", "c", "cpp", "swift", "dart"}
#: Words after which a value is expected, so that a slash starts a pattern and `<` an element.
BEFORE_VALUE = frozenset("return typeof case in of delete void throw new instanceof do else yield await default export".split())
HEADS = frozenset("if while for with".split())
TRIPLE = frozenset({"java", "kotlin", "scala", "swift", "dart", "csharp"})
INTERPOLATED = re.compile(r"(?:\\[\s\S]|\$(?!\{)|[^`\\$])+")
PATTERN = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
ELEMENT = re.compile(r"<(?:([A-Za-z][\w.:-]*)(?=[\s/>])|(?=>))")
NOT_ELEMENT = re.compile(r"<[A-Za-z]\w*\s*(?:,|extends\b)")
CODE = re.compile(
    r"(?P<line>//[^\n]*)|(?P<block>/\*[\s\S]*?(?:\*/|\Z))|(?P<triple>\"\"\"[\s\S]*?(?:\"\"\"|\Z)|'''[\s\S]*?(?:'''|\Z))|(?P<string>\"(?:\\[\s\S]|[^\"\\\n])*\"?|'(?:\\[\s\S]|[^'\\\n])*'?)"
    r"|(?P<tick>`)|(?P<open>[(\[{])|(?P<close>[)\]}])|(?P<word>[\w$]+)|(?P<slash>/)|(?P<less><)|(?P<arrow>=>)|(?P<other>[^\s\w$])|(?P<blank>\s+)"
)
TAG = re.compile(r"(?P<string>\"[^\"]*\"|'[^']*')|(?P<open>\{)|(?P<empty>/>)|(?P<end>>)|(?P<word>[^\s\"'{}/>]+)|(?P<other>[\s\S])")
CHILD = re.compile(r"(?P<text>[^<{]+)|(?P<open>\{)|(?P<last></[\w.:-]*\s*>)|(?P<less><)")
PAIR = {")": "(", "]": "[", "}": "{"}


@dataclass
class Lexed:
    comments: list[tuple[int, int]] = field(default_factory=list)
    strings: list[tuple[int, int]] = field(default_factory=list)
    closes: dict[int, int] = field(default_factory=dict)
    faults: list[tuple[int, str]] = field(default_factory=list)

    def masked(self, code: str, strings: bool = True) -> str:
        out, at = [], 0
        for a, b in sorted(self.comments + self.strings if strings else self.comments):
            if a >= at:
                out += [code[at:a], re.sub(r"[^\n]", " ", code[a:b])]
                at = b
        return "".join([*out, code[at:]])


def lex(code: str, kind: str) -> Lexed:
    """The modes of code; a fault is noted and the pass goes on."""
    out, script = Lexed(), kind in JAVASCRIPT
    stack: list[tuple] = []  # mode, place, what was before it
    value = True  # a value is expected next: a slash starts a pattern
    word, at, end = "", 0, len(code)

    def fault(place: int, what: str) -> None:
        out.faults.append((place, what))

    while at < end:
        mode = stack[-1][0] if stack else "code"
        if mode == "template":
            m = INTERPOLATED.match(code, at)
            if m:
                out.strings.append(m.span())
                at = m.end()
            elif code[at] == "`":
                out.strings.append((at, at + 1))
                stack.pop()
                value, at = False, at + 1
            else:  # ${
                out.strings.append((at, at + 2))
                stack.append(("${", at + 1, None))
                value, word, at = True, "", at + 2
            continue
        if mode == "tag":
            m = TAG.match(code, at)
            part = m.lastgroup
            if part == "string":
                out.strings.append(m.span())
            elif part == "open":
                stack.append(("{", at, "tag"))
                value, word = True, ""
            elif part == "empty":
                stack.pop()
                value = False
            elif part == "end":
                stack[-1] = ("children", stack[-1][1], None)
            at = m.end()
            continue
        if mode == "children":
            m = CHILD.match(code, at)
            part = m.lastgroup
            if part == "text":
                out.strings.append(m.span())
            elif part == "open":
                stack.append(("{", at, "tag"))
                value, word = True, ""
            elif part == "last":
                stack.pop()
                value = False
            else:
                stack.append(("tag", at, None))
            at = m.end()
            continue
        m = CODE.match(code, at)
        part, start, at = m.lastgroup, at, m.end()
        if part == "blank":
            continue
        if part in ("line", "block"):
            out.comments.append((start, at))
            if part == "block" and (at - start < 4 or code[at - 2 : at] != "*/"):
                fault(start, "comment without an end")
            continue
        if part == "triple" and (kind not in TRIPLE or code[start] == "'" and kind != "dart"):
            m = re.compile(r"\"\"|''").match(code, start)  # an empty string, then another
            part, at = "string", m.end()
        if part == "string" and code[start] == "'" and kind in ("rust", "scala", "c", "cpp", "go", "java", "kotlin", "csharp", "swift"):
            m = re.compile(r"'(?:\\[^\n']*.?|[^'\\\n])'").match(code, start)
            if not m:  # a lifetime, a symbol or a digit separator
                at = start + 1
                continue
            at = m.end()
        if part in ("string", "triple"):
            out.strings.append((start, at))
            quote = code[start] * (3 if part == "triple" else 1)
            if at - start < 2 * len(quote) or not code[start:at].endswith(quote):
                fault(start, "string without an end")
            value, word = False, ""
        elif part == "tick":
            if script:
                out.strings.append((start, at))
                stack.append(("template", start, None))
            elif kind == "go":
                last = code.find("`", at)
                at = end if last < 0 else last + 1
                out.strings.append((start, at))
                value = False
        elif part == "open":
            head = word in HEADS
            # what a slash after the closing bracket is: a pattern after the head of a statement and after a block
            stack.append((m[0], start, head if m[0] == "(" else value or word in ("else", "do", "try", "finally", ")") if m[0] == "{" else False))
            value, word = True, ""
        elif part == "close":
            if stack and stack[-1][0] == "${" and m[0] == "}":
                out.strings.append((start, at))
                stack.pop()
                continue
            if not stack or stack[-1][0] != PAIR[m[0]]:
                fault(start, f"{m[0]} without {PAIR[m[0]]}")
                # the nearest that fits, within the same template or element
                back = len(stack) - 1
                while back >= 0 and stack[back][0] in "([{" and stack[back][0] != PAIR[m[0]]:
                    back -= 1
                if back < 0 or stack[back][0] != PAIR[m[0]]:
                    continue
                del stack[back + 1 :]
            _, first, after = stack.pop()
            out.closes[first] = start
            value, word = bool(after) and after != "tag", m[0]
        elif part == "word":
            value, word = m[0] in BEFORE_VALUE, m[0]
        elif part == "slash" and script and value and (p := PATTERN.match(code, start)):
            out.strings.append(p.span())
            value, word, at = False, "", p.end()
        elif part == "less" and script and value and (p := ELEMENT.match(code, start)) and not NOT_ELEMENT.match(code, start):
            stack.append(("tag", start, None))
            at = p.end()
        else:
            value, word = True, m[0]
    for mode, place, _ in stack:
        fault(place, {"template": "template without an end", "tag": "element without an end", "children": "element without an end"}.get(mode, f"{mode} without an end"))
    return out


class Lines:
    """Line numbers of offsets."""

    def __init__(self, text: str):
        self.breaks = [m.start() for m in re.finditer("\n", text)]

    def __call__(self, at: int) -> int:
        return bisect_left(self.breaks, at) + 1


class Blocks:
    """Where the block that opens next after an offset ends."""

    def __init__(self, code: str, closes: dict[int, int]):
        self.code, self.closes = code, closes
        self.opens = [m.start() for m in re.finditer(r"\{", code)]
        self.gaps = [m.start() for m in re.finditer("\n\n", code)]

    def end(self, start: int) -> int:
        """Offset of the brace that closes, or of the line's end where none opens before an empty line."""
        k, g = bisect_left(self.opens, start), bisect_left(self.gaps, start)
        if k == len(self.opens) or g < len(self.gaps) and self.gaps[g] < self.opens[k] - 1:
            stop = self.code.find("\n", start)
            return stop if stop >= 0 else len(self.code)
        return self.closes.get(self.opens[k], len(self.code))


def closed(code: str) -> dict[int, int]:
    """Braces by a stack, for languages that lex() doesn't know; code is masked."""
    out, stack = {}, []
    for m in re.finditer("[{}]", code):
        if m[0] == "{":
            stack.append(m.start())
        elif stack:
            out[stack.pop()] = m.start()
    return out


def holders(spans: list[tuple[int, int, str]], points: list[int]) -> list[str | None]:
    """For points in ascending order the innermost span (start, end, name) around each: one sweep with a stack of open spans."""
    out, stack, k = [], [], 0
    spans = sorted(spans, key=lambda s: (s[0], -s[1]))
    for p in points:
        while k < len(spans) and spans[k][0] <= p:
            stack.append(spans[k])
            k += 1
        while stack and stack[-1][1] < p:
            stack.pop()
        out.append(stack[-1][2] if stack else None)
    return out


__all__ = ["BRACES", "Blocks", "Lexed", "Lines", "closed", "holders", "lex"]
