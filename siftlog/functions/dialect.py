"""Pattern dialects: user regular expressions and globs to ``java.util.regex``.

Both run on the driver, once per pattern; the result is a literal handed to
``rlike`` / ``split`` / ``regexp_*`` so that matching itself stays in the JVM.

The user-facing regex dialect is the linear-time one: Unicode ``\\w \\d \\s \\b``,
``$`` means end of text (an entry that ends in a newline is *not* matched by
``error$``), ``.`` excludes only ``\\n``, and look-around and back-references do
not exist.  Java differs on every one of these, so patterns are re-written.
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

from siftlog.errors import InvalidPattern


# POSIX classes of the dialect are ASCII-only.
POSIX_CLASSES = {
    "alnum": "0-9A-Za-z",
    "alpha": "A-Za-z",
    "ascii": r"\x00-\x7F",
    "blank": r"\t\x20",
    "cntrl": r"\x00-\x1F\x7F",
    "digit": "0-9",
    "graph": "!-~",
    "lower": "a-z",
    "print": r"\x20-~",
    "punct": r"!-/:-@\[-`{-~",
    "space": r"\t\n\x0B\f\r\x20",
    "upper": "A-Z",
    "word": "0-9A-Za-z_",
    "xdigit": "0-9A-Fa-f",
}

# Long names of the Unicode general categories.
GENERAL_CATEGORIES = {
    "letter": "L", "casedletter": "LC", "uppercaseletter": "Lu", "lowercaseletter": "Ll",
    "titlecaseletter": "Lt", "modifierletter": "Lm", "otherletter": "Lo",
    "mark": "M", "nonspacingmark": "Mn", "spacingmark": "Mc", "enclosingmark": "Me",
    "number": "N", "decimalnumber": "Nd", "letternumber": "Nl", "othernumber": "No",
    "punctuation": "P", "connectorpunctuation": "Pc", "dashpunctuation": "Pd",
    "openpunctuation": "Ps", "closepunctuation": "Pe", "initialpunctuation": "Pi",
    "finalpunctuation": "Pf", "otherpunctuation": "Po",
    "symbol": "S", "mathsymbol": "Sm", "currencysymbol": "Sc", "modifiersymbol": "Sk", "othersymbol": "So",
    "separator": "Z", "spaceseparator": "Zs", "lineseparator": "Zl", "paragraphseparator": "Zp",
    "other": "C", "control": "Cc", "format": "Cf", "surrogate": "Cs", "privateuse": "Co", "unassigned": "Cn",
}

_META = set("\\^$.|?*+()[]{}&-~#")
_COUNTED = re.compile(r"\{[ ]*(\d+)[ ]*(?:(,)[ ]*(\d*)[ ]*)?\}")
_GROUP_NAME = re.compile(r"\?P?<([A-Za-z_][A-Za-z0-9_.\[\]]*)>")
_FLAGS = re.compile(r"\?([imsRUux]*)(?:-([imsRUux]+))?([:)])")
_POSIX = re.compile(r"\[:(\^?)([a-z]+):\]")
_WORD_EDGES = {
    "{start}": r"(?<!\w)(?=\w)",
    "{end}": r"(?<=\w)(?!\w)",
    "{start-half}": r"(?<!\w)",
    "{end-half}": r"(?!\w)",
}


def escape_literal(text: str) -> str:
    """Java regex matching exactly ``text``."""
    return "".join("\\" + c if c in _META else c for c in text)


def _unicode_property(name: str, negated: bool) -> str:
    if name.startswith("^"):
        negated, name = not negated, name[1:]
    key, sep, value = name.partition("=") if "=" in name else name.partition(":")
    if sep and key.endswith("!"):
        negated, key = not negated, key[:-1]
    value = value if sep else key
    loose = re.sub(r"[\s_-]", "", value).lower()
    kind = re.sub(r"[\s_-]", "", key).lower() if sep else ""
    short = value if len(value) <= 2 and kind not in ("sc", "script", "scx") else None
    if not loose:
        raise InvalidPattern("empty Unicode property")
    if short or loose in GENERAL_CATEGORIES:
        body = GENERAL_CATEGORIES.get(loose) or short[0].upper() + short[1:].lower()
        body = "LC" if body == "Lc" else body
    elif loose == "any":
        return r"[^\s\S]" if negated else r"[\s\S]"
    elif loose == "ascii":
        body = "ASCII"
    elif loose == "assigned":
        negated, body = not negated, "Cn"
    else:
        body = "Is" + re.sub(r"[\s-]", "_", value.strip())
    return f"\\{'P' if negated else 'p'}{{{body}}}"


class _Rewriter:
    """One left-to-right pass that re-emits a pattern in Java's syntax."""

    def __init__(self, pattern: str):
        self.src = pattern
        self.at = 0
        self.out: list[str] = []
        self.atom: int | None = None  # where the last repeatable piece starts in ``out``
        self.repeated = False
        self.flags = {"m": False, "x": False, "U": False}
        self.open: list[tuple[int, dict]] = []
        self.names: set[str] = set()
        self.loops = 0  # unbounded repetitions of single characters
        self.choices = 0  # bounded ones of varying number
        self.top_choice = False  # "|" outside of groups
        self.deep = False  # an unbounded repetition of a group, for which the JVM's matcher calls itself
        self.loops_groups = False  # one that it may try in very many ways

    def one(self, piece: str) -> str:
        """A piece that takes exactly one character."""
        return piece

    def dot(self) -> str:
        return "."

    def anchor(self, c: str) -> str:
        if c == "^":
            return r"(?:\A|(?<=\n))" if self.flags["m"] else r"\A"
        return r"(?=\n|\z)" if self.flags["m"] else r"\z"

    def fail(self, why: str):
        raise InvalidPattern(f"{why} at {self.at} in {self.src!r}")

    def put(self, piece: str):
        self.atom, self.repeated = len(self.out), False
        self.out.append(piece)

    def run(self) -> str:
        while self.at < len(self.src):
            c = self.src[self.at]
            if self.flags["x"] and c.isspace():
                self.at += 1
            elif self.flags["x"] and c == "#":
                end = self.src.find("\n", self.at)
                self.at = len(self.src) if end < 0 else end + 1
            elif c == "\\":
                text, code = self.escape(in_class=False)
                self.put(text if code is None else self.one(text))
            elif c == "[":
                self.put(self.one(self.char_class()))
            elif c == "(":
                self.group()
            elif c == ")":
                if not self.open:
                    self.fail("unopened group")
                self.at += 1
                self.out.append(")")
                self.atom, self.flags = self.open.pop()
                self.repeated = False
            elif c == "|":
                self.at += 1
                self.out.append("|")
                self.atom = None
                self.top_choice |= not self.open
            elif c in "*+?{":
                self.repeat()
            else:
                self.at += 1
                self.put(self.anchor(c) if c in "^$" else self.dot() if c == "." else self.one(escape_literal(c)))
        if self.open:
            self.fail("unclosed group")
        return "".join(self.out)

    def group(self):
        rest = self.src[self.at + 1:]
        named, flags = _GROUP_NAME.match(rest), _FLAGS.match(rest)
        if named:
            if named.group(1) in self.names:
                self.fail("duplicate group name")
            self.names.add(named.group(1))
            self.at += 1 + named.end()
            self.enter("(")
        elif flags and (flags.group(1) or flags.group(2) or flags.group(3) == ":"):
            self.at += 1 + flags.end()
            self.flag_group(flags.group(1), flags.group(2) or "", scoped=flags.group(3) == ":")
        elif rest.startswith("?"):
            self.fail("look-around or unknown group")
        else:
            self.at += 1
            self.enter("(")

    def enter(self, text: str):
        self.open.append((len(self.out), dict(self.flags)))
        self.out.append(text)
        self.atom = None

    def flag_group(self, on: str, off: str, scoped: bool):
        if "R" in on or "R" in off:
            self.fail("CRLF mode is not supported")
        rename = {"i": "i", "s": "s", "u": "U"}
        java_on = "".join(rename.get(f, "") for f in on)
        java_off = "".join(rename.get(f, "") for f in off)
        java = java_on + ("-" + java_off if java_off else "")
        if scoped:
            self.enter(f"(?{java}:")
        elif java:
            self.out.append(f"(?{java})")
        self.flags = dict(self.flags)
        self.flags.update({f: True for f in on if f in self.flags})
        self.flags.update({f: False for f in off if f in self.flags})
        self.atom = None

    def repeat(self):
        if self.atom is None:
            self.fail("nothing to repeat")
        if self.src[self.at] == "{":
            m = _COUNTED.match(self.src, self.at)
            if not m:
                self.fail("bad counted repetition")
            low, comma, high = m.groups()
            if high and int(high) < int(low):
                self.fail("bad counted repetition")
            text = "{" + low + (comma or "") + (high or "") + "}"
            self.at = m.end()
            least, most = int(low), int(high) if high else None if comma else int(low)
        else:
            text = self.src[self.at]
            self.at += 1
            least, most = int(text == "+"), 1 if text == "?" else None
        self.weigh(least, most)
        lazy = self.src.startswith("?", self.at)
        self.at += lazy
        if self.repeated:  # a repetition of a repetition, which Java would read as possessive
            self.out[self.atom:] = ["(?:" + "".join(self.out[self.atom:]) + ")"]
        self.out.append(text + ("?" if lazy != self.flags["U"] else ""))
        self.repeated = True

    def weigh(self, least: int, most: int | None) -> None:
        """What a repetition of the last piece means for a backtracking search."""
        varies = most is None or most > least
        if self.repeated or self.closed:
            inner = "".join(self.out[self.atom:]).replace("(?", "(")
            inside = len(re.findall(r"(?<!\\)[?{|]", inner)), len(re.findall(r"(?<!\\)[*+]|,\}", inner))
            if most is None:
                self.deep = True
                self.loops_groups |= any(inside)
            elif most > 1:
                self.choices += (most - 1) * inside[0]
                self.loops += (most - 1) * inside[1]
        if most is None or most - least > 20:
            self.loops += 1
        elif varies:
            self.choices += 1

    @property
    def closed(self) -> bool:
        """Whether the last piece is a group of the pattern and not one piece that merely looks like one."""
        return self.out[self.atom].startswith("(") and self.out[-1] == ")"

    def escape(self, in_class: bool) -> tuple[str, int | None]:
        """Consume one escape; return its Java text and, for a single character, its code point."""
        self.at += 1
        if self.at >= len(self.src):
            self.fail("trailing backslash")
        c = self.src[self.at]
        self.at += 1
        if c in "dDwWsS":
            return "\\" + c, None
        if c in "pP":
            if self.src.startswith("{", self.at):
                end = self.src.find("}", self.at)
                if end < 0:
                    self.fail("unclosed Unicode property")
                name, self.at = self.src[self.at + 1:end], end + 1
            else:
                name, self.at = self.src[self.at:self.at + 1], self.at + 1
            return _unicode_property(name, c == "P"), None
        if c in "xuU":
            return self.hex_escape({"x": 2, "u": 4, "U": 8}[c])
        simple = {"n": 10, "r": 13, "t": 9, "f": 12, "a": 7, "v": 11}
        if c in simple:
            return f"\\x{simple[c]:02X}", simple[c]
        if not in_class:
            if c in "bB":
                for name, java in _WORD_EDGES.items():
                    if c == "b" and self.src.startswith(name, self.at):
                        self.at += len(name)
                        return java, None
                return "\\" + c, None
            if c in "Az":
                return "\\" + c, None
            if c in "<>":
                return _WORD_EDGES["{start}" if c == "<" else "{end}"], None
        if c.isascii() and not c.isalnum() and c not in "<>":
            return ("\\" + c if c in _META else c), ord(c)
        self.fail(f"unknown escape \\{c}")

    def hex_escape(self, width: int) -> tuple[str, int]:
        m = re.compile(r"\{([0-9A-Fa-f]+)\}|([0-9A-Fa-f]{%d})" % width).match(self.src, self.at)
        if not m:
            self.fail("bad hex escape")
        code = int(m.group(1) or m.group(2), 16)
        if code > 0x10FFFF or 0xD800 <= code < 0xE000:
            self.fail("bad code point")
        self.at = m.end()
        return f"\\x{{{code:X}}}", code

    def char_class(self) -> str:
        self.at += 1
        negated = self.src.startswith("^", self.at)
        self.at += negated
        whole: str | None = None
        operator: str | None = None
        items: list[str] = []
        first = True

        def fold() -> str:
            right = "[" + "".join(items) + "]" if items else r"[^\s\S]"
            if operator is None:
                return right
            if operator == "&&":
                return f"[{whole}&&{right}]"
            if operator == "--":
                return f"[{whole}&&[^{right}]]"
            return f"[[{whole}&&[^{right}]][{right}&&[^{whole}]]]"

        while True:
            if self.at >= len(self.src):
                self.fail("unclosed character class")
            c = self.src[self.at]
            if self.flags["x"] and c.isspace():
                self.at += 1
                continue
            if c == "]" and not first:
                self.at += 1
                break
            if self.src[self.at:self.at + 2] in ("&&", "--", "~~") and not first:
                whole, operator, items = fold(), self.src[self.at:self.at + 2], []
                self.at += 2
                continue
            first = False
            posix = _POSIX.match(self.src, self.at)
            if posix and posix.group(2) in POSIX_CLASSES:
                self.at = posix.end()
                body = POSIX_CLASSES[posix.group(2)]
                items.append(f"[^{body}]" if posix.group(1) else body)
            elif c == "[":
                items.append(self.char_class())
            else:
                items.append(self.class_item())
        whole = fold()
        return f"[^{whole}]" if negated else whole

    def class_char(self) -> tuple[str, int | None]:
        c = self.src[self.at]
        if c == "\\":
            return self.escape(in_class=True)
        self.at += 1
        return ("\\" + c if c in _META else c), ord(c)

    def class_item(self) -> str:
        low, code = self.class_char()
        after = self.src[self.at + 1:self.at + 2]
        if not self.src.startswith("-", self.at) or after in ("]", "-", ""):
            return low
        if code is None:
            self.fail("a class cannot start a range")
        self.at += 1
        high, end = self.class_char()
        if end is None or end < code:
            self.fail("invalid range")
        return f"{low}-{high}"


def to_java_regex(pattern: str, case_sensitive: bool = True) -> str:
    """Re-write a user pattern for ``java.util.regex``; raise ``InvalidPattern`` if it is not one."""
    body = _Rewriter(pattern).run()
    return ("(?dU)" if case_sensitive else "(?idU)") + body


def java_compiles(java_pattern: str) -> bool:
    """Whether the JVM accepts the pattern (a driver-side call, no job)."""
    from py4j.protocol import Py4JJavaError
    from pyspark.errors import PySparkException

    spark = SparkSession.getActiveSession()
    try:
        spark._jvm.java.util.regex.Pattern.compile(java_pattern)
    except (Py4JJavaError, PySparkException):
        return False
    return True


def checked_java_regex(pattern: str, case_sensitive: bool = True) -> str:
    """``to_java_regex`` plus the JVM's own check."""
    java = to_java_regex(pattern, case_sensitive)
    if not java_compiles(java):
        raise InvalidPattern(f"not a valid regular expression: {pattern!r}")
    return java


# classes without control characters: no range of theirs can hold a newline
_TAIL_FREE = re.compile(r"(?:[^\\\[\]$\n(]|\((?!\?)|\\[dwb.:/@#,=\-\[\](){}|*+?]|\[[^\\\[\]^\x00-\x1f][^\\\[\]\x00-\x1f]*\])*")


def ignores_final_newline(pattern: str) -> bool:
    """True only if a match cannot depend on whether the text ends in ``\\n`` (conservative)."""
    return _TAIL_FREE.fullmatch(pattern) is not None


# --------------------------------------------------------------------------- globs


def glob_to_regex(glob: str) -> str:
    """Anchored Java regex for one path glob: ``*`` and ``?`` cross ``/``, ``**`` spans directories.

    Raises ``InvalidPattern`` for an unclosed ``[`` / ``{``, a stray ``}`` or a trailing backslash.
    """
    out, i, n = [], 0, len(glob)
    alternates: list[list[str]] = []  # finished branches of each open brace
    saved: list[list[str]] = []  # text before each open brace

    while i < n:
        c = glob[i]
        if c == "*":
            j = i
            while j < n and glob[j] == "*":
                j += 1
            starts = i == 0 or (glob[i - 1] == "/" and not saved)
            ends = j == n or glob[j] == "/"
            if j - i == 2 and starts and ends and not saved:
                if i == 0 and j == n:
                    out.append(".*")
                elif i == 0:
                    out.append("(?:/?|.*/)")
                    j += 1
                elif j == n:
                    out.append(".*")
                else:
                    out.append("(?:.*/)?")
                    j += 1
            else:
                out.append(".*")
            i = j
        elif c == "?":
            out.append(".")
            i += 1
        elif c == "[":
            text, i = _glob_class(glob, i)
            out.append(text)
        elif c == "{":
            saved.append(out)
            alternates.append([])
            out, i = [], i + 1
        elif c == "}":
            if not saved:
                raise InvalidPattern(f"unopened alternate group in glob {glob!r}")
            branches = alternates.pop() + ["".join(out)]
            out = saved.pop()
            branches = [b for b in branches if b]
            if branches:
                out.append("(?:" + "|".join(branches) + ")")
            i += 1
        elif c == "," and saved:
            alternates[-1].append("".join(out))
            out, i = [], i + 1
        elif c == "\\":
            if i + 1 == n:
                raise InvalidPattern(f"dangling escape in glob {glob!r}")
            out.append(escape_literal(glob[i + 1]))
            i += 2
        else:
            out.append(escape_literal(c))
            i += 1
    if saved:
        raise InvalidPattern(f"unclosed alternate group in glob {glob!r}")
    return r"(?s)\A" + "".join(out) + r"\z"


def _glob_class(glob: str, i: int) -> tuple[str, int]:
    negated = glob[i + 1:i + 2] in ("!", "^")
    start = i + 1 + negated
    end = glob.find("]", start + 1)
    if end < 0:
        raise InvalidPattern(f"unclosed character class in glob {glob!r}")
    body, parts, k = glob[start:end], [], 0
    while k < len(body):
        if body[k + 1:k + 2] == "-" and k + 2 < len(body):
            if body[k] > body[k + 2]:
                raise InvalidPattern(f"invalid range in glob {glob!r}")
            parts.append(escape_literal(body[k]) + "-" + escape_literal(body[k + 2]))
            k += 3
        else:
            parts.append(escape_literal(body[k]))
            k += 1
    return ("[^" if negated else "[") + "".join(parts) + "]", end + 1
