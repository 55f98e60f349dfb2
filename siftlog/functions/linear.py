"""Regular expressions in time proportional to the text, whatever the pattern and the text.

The JVM's matcher tries alternatives one after the other: ``(a|b)*x`` on a long entry overflows its stack, ``(a+)+b`` takes
for ever, ``.*a.*b`` the square or cube of the length.  So each pattern is weighed when it is read.  One without
repeated groups and with one loop at most (or two and an anchor) stays in the JVM: it never fails, and only a text made for
it costs the square of its length.  The rest, for texts too long for the number of loops in the pattern, go in Arrow batches
to the regular expressions of Arrow's string functions, which follow all alternatives at once.  Only such rows are sent, and
only where the other conditions hold.

Both read the same dialect (Unicode classes, ``$`` at the end of the text only).  A word boundary is Unicode aware in the
JVM only; for the other, all edges of words are marked in the text and a boundary is such a mark.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftlog.errors import InvalidPattern
from siftlog.functions.dialect import _Rewriter, checked_java_regex

STEPS = 1 << 30  # that a text may cost in the JVM: with n loops one of up to STEPS ** (1 / (n + 1)) characters, or 1 / n if anchored
CHOICES = 12
DEEP = 2_048  # characters for patterns with a repeated group, which fills the JVM's stack

# Letters, digits and marks of words, white space; and marks, which stand for nothing in texts.
WORD = (r"\p{L}\p{Nl}\p{M}\p{Nd}\p{Pc}\x{200C}\x{200D}\x{24B6}-\x{24E9}\x{1F130}-\x{1F149}\x{1F150}-\x{1F169}"
        r"\x{1F170}-\x{1F189}")
SPACE = r"\t\n\x0B\f\r\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
EDGE, HIT, NEITHER = "\U0010FFFF", "\U0010FFFE", "\U0010FFFD"
POSITIONS_TYPE = "array<struct<offset:bigint,length:bigint>>"


class _Unsupported(Exception):
    pass


class _Linear(_Rewriter):
    """The same dialect in the syntax of Arrow's string functions."""

    def __init__(self, pattern: str, marked: bool):
        super().__init__(pattern)
        self.marked = marked
        self.flags["s"] = self.flags["u"] = False

    def one(self, piece: str) -> str:
        return f"(?:{EDGE}?{piece})" if self.marked else piece

    def none_of(self, body: str) -> str:
        return f"[^{body}{EDGE if self.marked else ''}]"

    def dot(self) -> str:
        return self.one(self.none_of("" if self.flags["s"] else r"\n") if self.marked or not self.flags["s"] else "(?s:.)")

    def anchor(self, c: str) -> str:
        before = f"{EDGE}?" if self.marked and c == "$" else ""
        if c == "^":
            return "(?m:^)" if self.flags["m"] else r"\A"
        return before + ("(?m:$)" if self.flags["m"] else r"\z")

    def flag_group(self, on: str, off: str, scoped: bool):
        if "u" in off:
            raise _Unsupported
        super().flag_group(on.replace("u", ""), off, scoped)

    def enter(self, text: str):
        super().enter("(?:" if text == "(" else text)

    def escape(self, in_class: bool) -> tuple[str, int | None]:
        c = self.src[self.at + 1:self.at + 2]
        if c and c in "dDwWsSpP":
            text, _ = super().escape(in_class)
            body = {"d": r"\p{Nd}", "w": WORD, "s": SPACE}.get(c.lower(), text)
            negated = c in "DWS" or (c in "pP" and text.startswith(r"\P"))
            if c in "pP" and ("Is" in text or "LC" in text or not text.startswith(("\\p", "\\P")) or "ASCII" in text or "Cn" in text):
                raise _Unsupported
            if c in "pP":
                body = r"\p" + text[2:]
            if in_class:
                if negated:
                    raise _Unsupported
                return body, None
            return self.one(self.none_of(body) if negated else f"[{body}]"), None
        text, code = super().escape(in_class)
        if code is None and not in_class:
            if text == r"\b":
                return EDGE, None
            if text == r"\z":
                return (f"{EDGE}?" if self.marked else "") + r"\z", None
            if text != r"\A":
                raise _Unsupported
        return text, code

    def char_class(self) -> str:
        text = super().char_class()
        if text.startswith("[^["):  # a negated class is written around the whole
            text = "[^" + text[3:-1]
        body = text[2 if text.startswith("[^") else 1:-1]
        if "&&" in body or _nested(body):
            raise _Unsupported
        return self.none_of(body) if text.startswith("[^") else text


def _nested(body: str) -> bool:
    at = 0
    while at < len(body):
        if body[at] == "\\":
            at += 1
        elif body[at] == "[":
            return True
        at += 1
    return False


@dataclass(frozen=True)
class Matcher:
    """A pattern for the JVM and, where it is not enough, for Arrow."""

    java: str
    linear: str | None  # None: the JVM alone
    marked: bool
    longest: int | None  # text for the JVM; 0: none

    @property
    def sends(self) -> bool:
        return self.linear is not None


@lru_cache(maxsize=256)
def matcher(pattern: str, case_sensitive: bool = True) -> Matcher:
    """Raises ``InvalidPattern`` like ``checked_java_regex``."""
    java = checked_java_regex(pattern, case_sensitive)
    weighed = _Rewriter(pattern)
    weighed.run()
    risky = weighed.loops_groups or weighed.choices > CHOICES
    # each loop can cost the length once more, and so can the place where a match starts
    power = weighed.loops + (weighed.top_choice or not weighed.out or weighed.out[0] != r"\A")
    if not risky and power <= 2 and not weighed.deep:  # at worst the square, and the JVM needs no stack for it
        return Matcher(java, None, False, None)
    for marked in (False, True):
        try:
            linear = ("" if case_sensitive else "(?i)") + _Linear(pattern, marked).run()
        except (_Unsupported, InvalidPattern):
            break
        if EDGE in linear and not marked:
            continue
        if _accepted(linear):
            longest = int(STEPS ** (1 / max(1, power)))
            return Matcher(java, linear, marked, 0 if risky else min(longest, DEEP) if weighed.deep else longest)
        break
    return Matcher(java, None, False, None)


def _accepted(linear: str) -> bool:
    import pyarrow as pa
    import pyarrow.compute as pc

    try:
        pc.match_substring_regex(pa.array([""]), linear)
    except pa.ArrowInvalid:
        return False
    return True


def _marking(marked: bool, word: str = WORD, edge: str = EDGE, other: str = NEITHER):
    """texts -> the same with the edges of words marked, where the pattern asks for them."""
    def mark(texts):
        import pyarrow.compute as pc

        if not marked:
            return texts
        return pc.replace_substring_regex(pc.replace_substring(texts, edge, other), f"([{word}]+)", f"{edge}\\1{edge}")

    return mark


def _sent(content: Column, m: Matcher, needed: Column | None) -> tuple[Column, Column | None]:
    """What goes to Arrow, null for what does not, and the condition for that (None: all)."""
    long = F.length(content) > m.longest if m.longest else None
    conditions = [c for c in (long, needed) if c is not None]
    sent = content
    for c in conditions:
        sent = F.when(c, sent)
    return sent, long


def matches(content: Column, m: Matcher, needed: Column | None = None) -> Column:
    """Whether the pattern is found; null for rows that must go to Arrow but are not ``needed``."""
    if not m.sends:
        return content.rlike(m.java)
    linear, mark = m.linear, _marking(m.marked)

    @F.arrow_udf("boolean")
    def found(texts):
        import pyarrow.compute as pc

        return pc.match_substring_regex(mark(texts), linear)

    sent, long = _sent(content, m, needed)
    return found(sent) if long is None else F.when(long, found(sent)).otherwise(content.rlike(m.java))


def first_match(content: Column, m: Matcher) -> Column:
    """The first match, empty where there is none."""
    in_jvm = F.regexp_extract(content, m.java, 0)
    if not m.sends:
        return in_jvm
    linear, mark, edge, marked = f"(?P<first>{m.linear})", _marking(m.marked), EDGE, m.marked

    @F.arrow_udf("string")
    def first(texts):
        import pyarrow.compute as pc

        found = pc.struct_field(pc.extract_regex(mark(texts), linear), "first")
        return pc.replace_substring(found, edge, "") if marked else found

    sent, long = _sent(content, m, None)
    return F.coalesce(first(sent) if long is None else F.when(long, first(sent)).otherwise(in_jvm), F.lit(""))


def positions(content: Column, m: Matcher, in_jvm) -> Column:
    """Byte positions of all matches, left to right; ``in_jvm(content)`` where the JVM is enough.

    Matches are put between marks in one pass, so that the pieces between the marks add up to the offsets.
    """
    linear, mark, edge, hit, other, marked = m.linear, _marking(m.marked), EDGE, HIT, NEITHER, m.marked

    @F.arrow_udf(POSITIONS_TYPE)
    def located(texts):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = mark(pc.replace_substring(texts, hit, other))
        cut = pc.split_pattern(pc.replace_substring_regex(texts, f"({linear})", f"{hit}\\1{hit}"), hit)
        pieces = pc.list_flatten(cut)
        sizes = pc.binary_length(pc.replace_substring(pieces, edge, "") if marked else pieces).to_numpy(zero_copy_only=False).astype(np.int64)
        counts = pc.fill_null(pc.list_value_length(cut), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        first = np.cumsum(counts) - counts
        ends = np.cumsum(sizes)
        starts = ends - sizes
        base = np.repeat(starts[np.minimum(first, max(len(starts) - 1, 0))] if len(starts) else first, counts)
        row, inside = np.repeat(np.arange(len(counts)), counts), np.arange(len(sizes)) - np.repeat(first, counts)
        is_match = inside % 2 == 1
        row, offset, length = row[is_match], (starts - base)[is_match], sizes[is_match]
        # an empty match (a mark alone may be one) that touches the match before does not count
        touches = np.zeros(len(row), bool)
        touches[1:] = (length[1:] == 0) & (row[1:] == row[:-1]) & (offset[1:] == offset[:-1] + length[:-1])
        row, offset, length = row[~touches], offset[~touches], length[~touches]
        offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(counts)))]).astype(np.int32)
        items = pa.StructArray.from_arrays([pa.array(offset), pa.array(length)], names=["offset", "length"])
        out = pa.ListArray.from_arrays(pa.array(offsets), items)
        return pc.if_else(pc.is_null(texts), pa.scalar(None, out.type), out)

    sent, long = _sent(content, m, None)
    return located(sent) if long is None else F.when(long, located(sent)).otherwise(in_jvm(content))
