"""Text conditions: one ``Term``, and ``must`` / ``any`` / ``none`` lists of them, as boolean Columns."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftlog.errors import InvalidPattern
from siftlog.functions.dialect import (
    checked_java_regex,
    escape_literal,
    ignores_final_newline,
)
from siftlog.functions.linear import Matcher, matcher, matches


@dataclass(frozen=True)
class Term:
    """One text condition. ``Term(None)`` is always true."""

    query: str | None
    regex: bool = False
    case_sensitive: bool = False
    whole_word: bool = False

    @classmethod
    def of(cls, value: "Term | str | Mapping | None") -> "Term":
        if isinstance(value, Term):
            return value
        if value is None or isinstance(value, str):
            return cls(value)
        return cls(
            value.get("query"),
            bool(value.get("regex", False)),
            bool(value.get("case_sensitive", False)),
            bool(value.get("whole_word", False)),
        )

    def java_regex(self, strict: bool = False) -> str | None:
        """The Java pattern of a regex or whole-word term; ``None`` if the user's regex is invalid."""
        if not self.regex:
            flags = "(?dU)" if self.case_sensitive else "(?idU)"
            return flags + r"\b" + escape_literal(self.query) + r"\b"
        try:
            return checked_java_regex(self.query, self.case_sensitive)
        except InvalidPattern:
            if strict:
                raise
            return None

    def matcher(self, strict: bool = False) -> Matcher | None:
        """How a regex term is matched; ``None`` for other terms and invalid patterns."""
        if not self.regex or self.query is None:
            return None
        try:
            return matcher(self.query, self.case_sensitive)
        except InvalidPattern:
            if strict:
                raise
            return None

    @property
    def sends(self) -> bool:
        """Whether some texts must leave the JVM for it."""
        m = self.matcher()
        return m is not None and m.sends

    @property
    def reads_lower_case(self) -> bool:
        return self.query is not None and not (self.regex or self.whole_word or self.case_sensitive)

    def matches(
        self, content: Column, strict: bool = False, lower: Column | None = None, needed: Column | None = None
    ) -> Column:
        """Whether ``content`` satisfies the term; ``lower`` is its lower-case form where that is at hand.

        Where ``needed`` does not hold the result may be null.
        """
        if self.query is None:
            return F.lit(True)
        if self.regex:
            m = self.matcher(strict)
            return F.lit(False) if m is None else matches(content, m, needed)
        if self.whole_word:
            pattern = self.java_regex(strict)
            return F.lit(False) if pattern is None else content.rlike(pattern)
        if self.case_sensitive:
            return F.contains(content, F.lit(self.query))
        return F.contains(F.lower(content) if lower is None else lower, F.lower(F.lit(self.query)))

    @property
    def ignores_final_newline(self) -> bool:
        """Whether the outcome is the same with and without the entry's last ``\\n``."""
        if self.query is None:
            return True
        return ignores_final_newline(self.query) if self.regex else "\n" not in self.query


@dataclass(frozen=True)
class LogicalQuery:
    """All of ``must``, at least one of ``any`` (if given), none of ``none``."""

    must: list[Term] = field(default_factory=list)
    any: list[Term] = field(default_factory=list)
    none: list[Term] = field(default_factory=list)

    @classmethod
    def of(cls, value: "LogicalQuery | Mapping | None" = None, must=(), any=(), none=()) -> "LogicalQuery":
        if isinstance(value, LogicalQuery):
            return value
        if value is not None:
            must, any, none = (value.get(k) or () for k in ("must", "any", "none"))
        return cls(*([Term.of(t) for t in terms] for terms in (must, any, none)))

    @property
    def terms(self) -> list[Term]:
        return [*self.must, *self.any, *self.none]

    @property
    def ignores_final_newline(self) -> bool:
        return all(t.ignores_final_newline for t in self.terms)

    def matches(self, content: Column, strict: bool = False) -> Column:
        def holds(lower: Column | None = None, needed: Column | None = None) -> Column:
            return (
                match_all(self.must, content, strict, lower, needed)
                & match_any(self.any, content, strict, lower, needed)
                & match_none(self.none, content, strict, lower, needed)
            )

        if any(t.sends for t in self.terms):  # outside of any function of functions, and only for what else holds
            cheap = match_all([t for t in self.must if not t.sends], content, strict) & match_none(
                [t for t in self.none if not t.sends], content, strict)
            return holds(None, cheap)
        if sum(t.reads_lower_case for t in self.terms) < 2:
            return holds()
        # a filter evaluates each mention anew, so several terms share one lower-casing of the text
        return F.exists(F.array(F.lower(content)), lambda lower: holds(lower))


def _cheap_first(terms) -> list[Term]:
    return sorted(map(Term.of, terms), key=lambda t: t.regex or t.whole_word)


def match_all(terms, content: Column, strict: bool = False, lower: Column | None = None, needed: Column | None = None) -> Column:
    return reduce(and_, [t.matches(content, strict, lower, needed) for t in _cheap_first(terms)], F.lit(True))


def match_any(terms, content: Column, strict: bool = False, lower: Column | None = None, needed: Column | None = None) -> Column:
    columns = [t.matches(content, strict, lower, needed) for t in _cheap_first(terms)]
    return reduce(or_, columns) if columns else F.lit(True)


def match_none(terms, content: Column, strict: bool = False, lower: Column | None = None, needed: Column | None = None) -> Column:
    columns = [t.matches(content, strict, lower, needed) for t in _cheap_first(terms)]
    return ~reduce(or_, columns) if columns else F.lit(True)
