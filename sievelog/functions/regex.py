"""RE2 patterns in the dialect of java.util.regex.

The search language has RE2 semantics; Spark has Java's. One pass over the
pattern refuses what RE2 lacks and rewrites what Java reads differently.
"""

from __future__ import annotations

import re

_REPEAT = re.compile(r"\{(\d+)(?:,(\d*))?\}")
_GROUP = re.compile(r"\(\?(?:P?<(?P<name>\w+)>|(?P<flags>[imsU]*(?:-[imsU]+)?)(?P<end>[:)]))")
_CLASSES = {
    "alnum": r"\p{Alnum}", "alpha": r"\p{Alpha}", "ascii": r"\p{ASCII}", "blank": r" \t", "cntrl": r"\p{Cntrl}", "digit": r"0-9", "graph": r"\p{Graph}",
    "lower": r"a-z", "print": r"\p{Print}", "punct": r"\p{Punct}", "space": r"\t\n\x0B\f\r ", "upper": r"A-Z", "word": r"0-9A-Za-z_", "xdigit": r"0-9A-Fa-f",
}
_SPACE = r"\t\n\f\r "
_WORD = "0-9A-Za-z_"


class BadPattern(ValueError):
    pass


def to_java(pattern: str) -> str:
    """The Java pattern that finds what RE2 finds, or BadPattern."""
    out, at, depth = ["(?d)"], 0, 0
    multiline, ungreedy = [False], [False]
    repeatable = False

    def escape(in_class: bool) -> str:
        nonlocal at
        if at + 1 >= len(pattern):
            raise BadPattern("trailing backslash")
        c = pattern[at + 1]
        at += 2
        if c.isdigit():
            if c == "0":
                m = re.compile(r"[0-7]{0,2}").match(pattern, at)
                at = m.end()
                return rf"\x{int(c + m[0], 8):02x}"
            raise BadPattern("backreference")
        if c in "pP":
            m = re.compile(r"\{\^?\w+\}|[A-Z]").match(pattern, at)
            if not m:
                raise BadPattern("character class")
            at = m.end()
            name = m[0].strip("{}")
            if name.startswith("^"):
                c, name = "P" if c == "p" else "p", name[1:]
            return rf"\{c}{{{name if len(name) <= 2 else 'Is' + name}}}"
        if c == "x":
            m = re.compile(r"[0-9A-Fa-f]{2}|\{[0-9A-Fa-f]+\}").match(pattern, at)
            if not m:
                raise BadPattern("escape")
            at = m.end()
            return rf"\x{m[0]}"
        if c == "Q":
            if in_class:
                raise BadPattern("escape")
            end = pattern.find(r"\E", at)
            text, at = (pattern[at:], len(pattern)) if end < 0 else (pattern[at:end], end + 2)
            return "".join(_plain(x) for x in text)
        simple = {"s": _SPACE if in_class else f"[{_SPACE}]", "S": f"[^{_SPACE}]", "d": "0-9" if in_class else "[0-9]", "w": _WORD if in_class else f"[{_WORD}]", "D": "[^0-9]", "W": f"[^{_WORD}]", "v": r"\x0B", "a": r"\x07", "n": r"\n", "t": r"\t", "r": r"\r", "f": r"\f"}
        if c in simple:
            return simple[c]
        if not in_class:
            around = (rf"(?<=[{_WORD}])(?![{_WORD}])", rf"(?<![{_WORD}])(?=[{_WORD}])")
            if c == "b":
                return f"(?:{around[0]}|{around[1]})"
            if c == "B":
                return rf"(?:(?<=[{_WORD}])(?=[{_WORD}])|(?<![{_WORD}])(?![{_WORD}]))"
            if c in "Az":
                return "\\" + c
            if c == "C":
                raise BadPattern("escape")
        if c.isalnum():
            raise BadPattern(f"escape \\{c}")
        return _plain(c)

    def bracket() -> str:
        nonlocal at
        at += 1
        negated = pattern[at : at + 1] == "^"
        at += negated
        parts, first = [], True
        while True:
            if at >= len(pattern):
                raise BadPattern("missing ]")
            c = pattern[at]
            if c == "]" and not first:
                at += 1
                return f"[{'^' * negated}{''.join(parts)}]"
            first = False
            if m := re.compile(r"\[:(\^?)(\w+):\]").match(pattern, at):
                if m[2] not in _CLASSES:
                    raise BadPattern("character class")
                parts.append(f"[^{_CLASSES[m[2]]}]" if m[1] else _CLASSES[m[2]])
                at = m.end()
                continue
            low = escape(True) if c == "\\" else _plain(c)
            if c != "\\":
                at += 1
            if pattern[at : at + 1] == "-" and pattern[at + 1 : at + 2] not in ("]", ""):
                at += 1
                high_raw = pattern[at]
                high = escape(True) if high_raw == "\\" else _plain(high_raw)
                if high_raw != "\\":
                    at += 1
                    if c != "\\" and high_raw < c:
                        raise BadPattern("character range")
                parts.append(f"{low}-{high}")
            else:
                parts.append(low)

    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            out.append(escape(False))
            repeatable = True
        elif c == "[":
            out.append(bracket())
            repeatable = True
        elif c == "(":
            if pattern.startswith("(?", at):
                m = _GROUP.match(pattern, at)
                if not m or m["name"] is None and "--" in m[0]:
                    raise BadPattern("group")
                at = m.end()
                now = [multiline[-1], ungreedy[-1]]
                if m["name"] is not None:
                    out.append(f"(?<{m['name'].replace('_', 'U95')}>")
                else:
                    on, _, off = m["flags"].partition("-")
                    for flag, k in (("m", 0), ("U", 1)):
                        now[k] = flag in on or now[k] and flag not in off
                    java = f"{on.replace('U', '')}{'-' if off.replace('U', '') else ''}{off.replace('U', '')}"
                    java = java.replace("i", "iu", 1) if "i" in on else java
                    out.append(f"(?{java}{m['end']}" if java or m["end"] == ":" else "")
                    if m["end"] == ")":
                        multiline[-1], ungreedy[-1] = now
                        repeatable = False
                        continue
                multiline.append(now[0])
                ungreedy.append(now[1])
            else:
                out.append("(")
                at += 1
                multiline.append(multiline[-1])
                ungreedy.append(ungreedy[-1])
            depth += 1
            repeatable = False
        elif c == ")":
            if not depth:
                raise BadPattern("unexpected )")
            depth -= 1
            multiline.pop()
            ungreedy.pop()
            out.append(")")
            at += 1
            repeatable = True
        elif c in "*+?" or c == "{" and _REPEAT.match(pattern, at):
            if not repeatable:
                raise BadPattern("nothing to repeat")
            if c == "{":
                m = _REPEAT.match(pattern, at)
                if max(int(m[1]), int(m[2] or 0)) > 1000 or m[2] and int(m[2]) < int(m[1]):
                    raise BadPattern("repeat count")
                text, at = m[0], m.end()
            else:
                text, at = c, at + 1
            lazy = pattern[at : at + 1] == "?"
            at += lazy
            out.append(text + "?" * (lazy != ungreedy[-1]))
            if pattern[at : at + 1] and pattern[at] in "*+?" or _REPEAT.match(pattern, at):
                raise BadPattern("repeated repeat")
            repeatable = True
        elif c == "$":
            out.append("$" if multiline[-1] else r"\z")
            at += 1
            repeatable = True
        elif c == "|":
            out.append("|")
            at += 1
            repeatable = False
        else:
            out.append(c if c in ".^" else _plain(c))
            at += 1
            repeatable = True
    if depth:
        raise BadPattern("missing )")
    return "".join(out)


def _plain(c: str) -> str:
    """c as itself, inside or outside a Java class."""
    return "\\" + c if not c.isalnum() and c.isascii() and c > " " and c != "_" else c
