"""Patterns of a linear-time Unicode regex dialect (no look-around, no back references) for Java's engine.

The pattern is parsed whole and written again for Java, so that what the dialect refuses is refused before a job starts,
and what it allows means the same: classes and case folding are Unicode's, named ASCII classes are ASCII, only a line
feed ends a line, '$' is the end of the text unless (?m) is on, a repeat of a repeat is one, (?x) drops white space and
comments, classes may be subtracted. Groups only group: whether a text has a match needs none of them.
"""

from __future__ import annotations

import re


class UnsupportedPattern(ValueError):
    pass


#: The POSIX classes, in ASCII.
_POSIX = {
    "alnum": "0-9A-Za-z", "alpha": "A-Za-z", "ascii": r"\x00-\x7F", "blank": r"\t\x20", "cntrl": r"\x00-\x1F\x7F", "digit": "0-9", "graph": "!-~", "lower": "a-z",
    "print": r"\x20-~", "punct": r"!-/:-@\[-`{-~", "space": r"\t\n\x0B\f\r\x20", "upper": "A-Z", "word": "0-9A-Za-z_", "xdigit": "0-9A-Fa-f",
}
#: Unicode's general categories by their long names.
_CATEGORIES = {
    "letter": "L", "casedletter": "LC", "uppercaseletter": "Lu", "lowercaseletter": "Ll", "titlecaseletter": "Lt", "modifierletter": "Lm", "otherletter": "Lo",
    "mark": "M", "nonspacingmark": "Mn", "spacingmark": "Mc", "enclosingmark": "Me", "number": "N", "decimalnumber": "Nd", "letternumber": "Nl", "othernumber": "No",
    "punctuation": "P", "connectorpunctuation": "Pc", "dashpunctuation": "Pd", "openpunctuation": "Ps", "closepunctuation": "Pe", "initialpunctuation": "Pi",
    "finalpunctuation": "Pf", "otherpunctuation": "Po", "symbol": "S", "mathsymbol": "Sm", "currencysymbol": "Sc", "modifiersymbol": "Sk", "othersymbol": "So",
    "separator": "Z", "spaceseparator": "Zs", "lineseparator": "Zl", "paragraphseparator": "Zp", "other": "C", "control": "Cc", "format": "Cf", "surrogate": "Cs",
    "privateuse": "Co", "unassigned": "Cn",
}
_SHORT = {v.lower(): v for v in _CATEGORIES.values()}
_ESCAPED = {"a": 7, "f": 12, "t": 9, "n": 10, "r": 13, "v": 11}
#: Zero-width places; word boundaries at one side.
_PLACES = {"b": r"\b", "B": r"\B", "A": r"\A", "z": r"\z", "<": r"\b(?=\w)", ">": r"\b(?<=\w)"}
_SIDES = {"start": r"\b(?=\w)", "end": r"\b(?<=\w)", "start-half": r"(?<!\w)", "end-half": r"(?!\w)"}
_META = set("\\.+*?()|[]{}^$#&-~")
_SPACE = set("\t\n\x0b\f\r \x85‎‏  ")


def _literal(code: int) -> str:
    c = chr(code)
    return c if c.isascii() and c.isalnum() else rf"\x{{{code:x}}}"


class _Parser:
    def __init__(self, pattern: str):
        self.p, self.i, self.names = pattern, 0, set()
        self.multiline = self.spaced = False

    def fail(self, why: str):
        raise UnsupportedPattern(f"{why} at {self.i} of {self.p!r}")

    def more(self) -> bool:
        return self.i < len(self.p)

    def peek(self, n: int = 1) -> str:
        return self.p[self.i : self.i + n]

    def take(self) -> str:
        if not self.more():
            self.fail("the pattern ends too early")
        self.i += 1
        return self.p[self.i - 1]

    def blank(self) -> None:
        while self.spaced and self.more() and (self.peek() in _SPACE or self.peek() == "#"):
            if self.take() == "#":
                while self.more() and self.peek() != "\n":
                    self.i += 1

    def whole(self) -> str:
        out = self.alternatives()
        if self.more():
            self.fail("a group is closed that isn't open")
        return out

    def alternatives(self) -> str:
        """Up to the end or ')'; flags set inside end with it."""
        flags = self.multiline, self.spaced
        out = [self.sequence()]
        while self.peek() == "|":
            self.i += 1
            out.append(self.sequence())
        self.multiline, self.spaced = flags
        return "|".join(out)

    def sequence(self) -> str:
        out: list[str] = []
        some = False
        while True:
            self.blank()
            if not self.more() or self.peek() in "|)":
                return "".join(out)
            if self.peek() in "*+?" or self.peek() == "{":
                if not some:
                    self.fail("a repeat of nothing")
                out[-1] = self.repeated(out[-1])
                continue
            atom, some = self.atom()
            out.append(atom)

    def repeated(self, atom: str) -> str:
        c = self.take()
        if c == "{":
            m = re.compile(r"\s*(\d*)\s*(?:(,)\s*(\d*)\s*)?\}").match(self.p, self.i)
            if not m or not (m[1] or m[3]):
                self.fail("a repeat without numbers")
            self.i = m.end()
            low, high = int(m[1] or 0), int(m[3]) if m[3] else None
            if high is not None and low > high or max(low, high or 0) > 1 << 30:
                self.fail("a repeat of a wrong range")
            c = f"{{{low}}}" if not m[2] else f"{{{low},{'' if high is None else high}}}"
        self.blank()
        if self.peek() == "?":
            self.i += 1
            c += "?"
        return f"(?:{atom}{c})" if atom.startswith(("(?:", "[", "\\")) or len(atom) == 1 else f"(?:(?:{atom}){c})"

    def atom(self) -> tuple[str, bool]:
        """An atom for Java, and whether it can be repeated."""
        c = self.take()
        if c == "\\":
            return self.escape(), True
        if c == "[":
            return self.klass(), True
        if c == "(":
            return self.group()
        if c == "^":
            return (r"(?:\A|(?<=\n))" if self.multiline else r"\A"), True
        if c == "$":
            return (r"(?=\n|\z)" if self.multiline else r"\z"), True
        return ("." if c == "." else _literal(ord(c))), True

    def group(self) -> tuple[str, bool]:
        flags = self.multiline, self.spaced
        on = off = ""
        if self.peek() == "?":
            self.i += 1
            if m := re.compile(r"P?<([^>]*)>").match(self.p, self.i):
                if not re.fullmatch(r"[^\W\d][\w.\[\]]*", m[1]) or m[1] in self.names:
                    self.fail("a group's name isn't valid, or repeats")
                self.names.add(m[1])
                self.i = m.end()
            elif m := re.compile(r"([imsuUx]*)(?:-([imsUx]+))?([:)])").match(self.p, self.i):
                letters = m[1] + (m[2] or "")
                if len(set(letters)) < len(letters) or m[3] == ")" and not letters:
                    self.fail("flags repeat, or are missing")
                self.i = m.end()
                self.multiline = (self.multiline or "m" in m[1]) and "m" not in (m[2] or "")
                self.spaced = (self.spaced or "x" in m[1]) and "x" not in (m[2] or "")
                # m and x are dealt with here; U changes no match into none
                on, off = ("".join(x for x in part if x in "is") for part in (m[1], m[2] or ""))
                java = on + ("-" + off if off else "")
                if m[3] == ")":  # up to the end of the group around
                    return (f"(?{java})" if java else ""), False
            else:
                self.fail("a group of a kind that isn't allowed")
        java = on + ("-" + off if off else "")
        inside = self.alternatives()
        if self.peek() != ")":
            self.fail("a group isn't closed")
        self.i += 1
        self.multiline, self.spaced = flags
        return f"(?{java}:{inside})", True

    def number(self, digits: int) -> int:
        if self.peek() == "{":
            end = self.p.find("}", self.i)
            text = self.p[self.i + 1 : end] if end > 0 else ""
            self.i = end + 1
        else:
            text = self.peek(digits)
            self.i += digits
            if len(text) < digits:
                text = ""
        if not re.fullmatch(r"[0-9A-Fa-f]+", text) or int(text, 16) > 0x10FFFF or 0xD800 <= int(text, 16) < 0xE000:
            self.fail("a code point isn't valid")
        return int(text, 16)

    def code(self, c: str) -> int | None:
        """The code point that an escape by c stands for; None if it is none."""
        if c in "xuU":
            return self.number({"x": 2, "u": 4, "U": 8}[c])
        if c in _ESCAPED:
            return _ESCAPED[c]
        return ord(c) if c.isascii() and not c.isalnum() and c not in "<>" else None

    def set_escape(self, c: str) -> str | None:
        """A class by an escape, for Java, in or out of brackets."""
        if c in "dDwWsS":
            return "\\" + c
        if c not in "pP":
            return None
        name = self.take()
        if name == "{":
            end = self.p.find("}", self.i)
            if end < 0:
                self.fail("a class without end")
            name, self.i = self.p[self.i : end], end + 1
        negated = (c == "P") ^ name.startswith("^")
        name = name.removeprefix("^")
        kind, sign, value = re.fullmatch(r"([^=:!]*)(!=|=|:)?(.*)", name).groups()
        negated ^= sign == "!="
        key = re.sub(r"[\s_-]", "", value if sign else kind).lower()
        kind = re.sub(r"[\s_-]", "", kind).lower() if sign else ""
        word = (value if sign else name).strip().replace(" ", "_").replace("-", "_")
        if not re.fullmatch(r"\w+", word) or kind not in ("", "gc", "generalcategory", "sc", "script", "scx", "scriptextensions"):
            self.fail("a class of an unknown name")
        if key in ("any", "ascii", "assigned"):
            java = {"any": r"\x{0}-\x{10FFFF}", "ascii": r"\x00-\x7F", "assigned": r"\P{Cn}"}[key]
            return f"[{'^' if negated else ''}{java}]"
        if kind.startswith("s"):
            java = f"{{script={word}}}"
        elif key in _SHORT or key in _CATEGORIES:
            java = f"{{{_SHORT.get(key) or _CATEGORIES[key]}}}"
        else:
            java = f"{{Is{word}}}"
        return rf"\{'P' if negated else 'p'}{java}"

    def escape(self) -> str:
        c = self.take()
        if c == "b" and self.peek() == "{":
            end = self.p.find("}", self.i)
            if (side := self.p[self.i + 1 : end]) in _SIDES:
                self.i = end + 1
                return f"(?:{_SIDES[side]})"
        if c in _PLACES:
            return f"(?:{_PLACES[c]})"
        if found := self.set_escape(c):
            return found
        if (code := self.code(c)) is None:
            self.fail(f"escape \\{c}")
        return _literal(code)

    def klass(self) -> str:
        """A class from behind its '['."""
        negated = self.peek() == "^"
        self.i += negated
        left, operator, items, first = "", "", [], True

        def done() -> str:
            nonlocal left
            right = f"[{''.join(items)}]" if items else "[a&&[^a]]"
            if operator == "&&":
                return f"[{left}&&{right}]"
            if operator == "--":
                return f"[{left}&&[^{right}]]"
            if operator == "~~":
                return f"[[{left}{right}]&&[^[{left}&&{right}]]]"
            return right

        while True:
            self.blank()
            if not self.more():
                self.fail("a class without end")
            if self.peek() == "]" and not first:
                self.i += 1
                return f"[^{done()}]" if negated else done()
            if self.peek(2) in ("&&", "--", "~~") and not first:
                left, operator, items = done(), self.peek(2), []
                self.i += 2
                continue
            first = False
            if m := re.compile(r"\[:(\^?)(\w+):\]").match(self.p, self.i):
                if m[2] not in _POSIX:
                    self.fail("a class of an unknown name")
                self.i = m.end()
                items.append(f"[{m[1]}{_POSIX[m[2]]}]")
                continue
            c = self.take()
            if c == "[":
                items.append(self.klass())
                continue
            low = self.class_code(c)
            if isinstance(low, str):
                items.append(low)
                continue
            self.blank()
            if self.peek() == "-" and self.peek(2) not in ("-]", "--") and len(self.peek(2)) == 2:
                self.i += 1
                self.blank()
                high = self.class_code(self.take())
                if isinstance(high, str) or high < low:
                    self.fail("a range that isn't one")
                items.append(f"{_literal(low)}-{_literal(high)}")
            else:
                items.append(_literal(low))

    def class_code(self, c: str) -> int | str:
        if c != "\\":
            return ord(c)
        d = self.take()
        if found := self.set_escape(d):
            return found
        code = ord(d) if d in "<>" else self.code(d)
        if code is None:
            self.fail(f"escape \\{d} in a class")
        return code


def to_java(pattern: str) -> str:
    """The pattern for Java; raises UnsupportedPattern."""
    return "(?dU)" + _Parser(pattern).whole()


def compiled(spark, pattern: str) -> str:
    """to_java(), compiled once on the driver, so that no job starts with a pattern that Java refuses."""
    from py4j.protocol import Py4JJavaError

    java = to_java(pattern)
    try:
        spark.sparkContext._jvm.java.util.regex.Pattern.compile(java)
    except Py4JJavaError as e:
        raise UnsupportedPattern(f"{pattern!r}: {e.java_exception.getMessage()}") from e
    return java
