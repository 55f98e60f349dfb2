"""Byte positions of the matches inside an entry, as ARRAY<STRUCT<offset: BIGINT, length: BIGINT>>.

The text is ``split`` at the matches by built-in expressions; only the pieces' byte lengths leave the JVM, and one running
sum over all of a batch makes them offsets, so the work grows with the matches.  Evaluated on hits only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftlog.functions.dialect import escape_literal
from siftlog.functions.linear import positions as located
from siftlog.functions.terms import LogicalQuery, Term

POSITIONS_TYPE = "array<struct<offset:bigint,length:bigint>>"

# Letters, digits and "_" among the 256 single-byte characters.
BYTE_WORD = r"[0-9A-Z_a-z\xAA\xB2\xB3\xB5\xB9\xBA\xBC-\xBE\xC0-\xD6\xD8-\xF6\xF8-\xFF]"


def _no_positions() -> Column:
    return F.array().cast(POSITIONS_TYPE)


_TYPE = T.ArrayType(T.StructType([T.StructField("offset", T.LongType()), T.StructField("length", T.LongType())]))


def _running(gap, step, length, counts):
    """Arrow positions of matches: one running sum over all of a batch, begun anew in each row.

    ``gap`` bytes lie before a match, ``step`` bytes are passed by it, ``length`` is reported; ``counts`` matches belong to
    each row.  An empty match that touches the match before does not count.
    """
    import numpy as np
    import pyarrow as pa

    row = np.repeat(np.arange(len(counts)), counts)
    passed = np.concatenate([[0], np.cumsum(gap + step)])
    offset = passed[:-1] + gap - passed[np.cumsum(counts) - counts][row]
    kept = np.ones(len(row), bool)
    kept[1:] = (length[1:] > 0) | (row[1:] != row[:-1]) | (offset[1:] != offset[:-1] + length[:-1])
    ends = np.concatenate([[0], np.cumsum(np.bincount(row[kept], minlength=len(counts)))]).astype(np.int32)
    items = pa.StructArray.from_arrays([pa.array(offset[kept]), pa.array(length[kept])], names=["offset", "length"])
    return pa.ListArray.from_arrays(pa.array(ends), items)


def _flat(lists):
    """Values and counts of an Arrow column of lists of numbers; null is an empty list."""
    import numpy as np
    import pyarrow.compute as pc

    counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return pc.list_flatten(lists).to_numpy(zero_copy_only=False).astype(np.int64), counts.astype(np.int64)


def _positions(gaps: Column, step: Column, length: Column) -> Column:
    """Positions of the matches between the pieces of a text, whose sizes are ``gaps``; all of one ``step`` and ``length``."""
    sum_up, flat = _running, _flat

    @F.arrow_udf(_TYPE)
    def placed(gaps, step, length):
        import numpy as np
        import pyarrow.compute as pc

        gap, counts = flat(gaps)
        last = np.cumsum(counts)[counts > 0] - 1  # no match follows the last piece
        gap, counts = np.delete(gap, last), np.maximum(counts - 1, 0)
        each = [np.repeat(c.to_numpy(zero_copy_only=False).astype(np.int64), counts) for c in (step, length)]
        return pc.if_else(pc.is_null(gaps), None, sum_up(gap, *each, counts))

    return placed(gaps, step, length)


def _between_and_in(pieces: Column, matches: Column) -> Column:
    """Positions from the sizes of the pieces of a text between its matches and of the matches."""
    sum_up, flat = _running, _flat

    @F.arrow_udf(_TYPE)
    def placed(pieces, matches):
        import numpy as np
        import pyarrow.compute as pc

        (piece, n_pieces), (match, counts) = flat(pieces), flat(matches)
        # before each match lies a piece, but an empty match at the very start makes none: then the gap is empty
        at = np.arange(len(match)) - np.repeat(np.cumsum(counts) - counts, counts)
        at -= np.repeat((n_pieces == counts).astype(np.int64), counts)
        gap = np.where(at < 0, 0, piece[np.maximum(np.repeat(np.cumsum(n_pieces) - n_pieces, counts) + at, 0)]) if len(match) else match
        return pc.if_else(pc.is_null(matches), None, sum_up(gap, match, match, counts))

    return placed(pieces, matches)


def _bytes(text: Column) -> Column:
    return F.octet_length(text).cast("bigint")


def _sizes_around(hay: Column, pattern: Column, size) -> Column:
    """Sizes of the pieces of text around the matches."""
    return F.transform(F.split(hay, pattern, -1), size)


def _quoted(literal: Column) -> Column:
    """A Java pattern for the literal; quoted in the JVM so that both sides are lower-cased alike."""
    return F.concat(F.lit(r"\Q"), F.replace(literal, F.lit(r"\E"), F.lit("\\E\\\\E\\Q")), F.lit(r"\E"))


def _folded(content: Column, term: Term) -> tuple[Column, Column]:
    literal = F.lit(term.query)
    return (content, literal) if term.case_sensitive else (F.lower(content), F.lower(literal))


def _plain(content: Column, term: Term) -> Column:
    hay, literal = _folded(content, term)
    width = _bytes(literal)
    return _positions(_sizes_around(hay, _quoted(literal), _bytes), width, width)


def _whole_word(content: Column, term: Term) -> Column:
    # One character per byte, so that neighbours are judged bytewise and lengths are byte counts.
    # Only the first byte is consumed and the rest looked at, so overlapping words are found too.
    hay, literal = _folded(content, term)

    def as_characters(text: Column) -> Column:
        return F.decode(text.cast("binary"), "ISO-8859-1")

    word = as_characters(literal)
    first, rest = _quoted(F.substring(word, 1, 1)), _quoted(F.substring(word, 2, 1 << 30))
    pattern = F.concat(
        first, F.lit(f"(?<!{BYTE_WORD}"), first, F.lit(")(?="), rest, F.lit(f"(?!{BYTE_WORD}))")
    )
    return _positions(
        _sizes_around(as_characters(hay), pattern, lambda piece: F.length(piece).cast("bigint")),
        F.lit(1).cast("bigint"), _bytes(literal),
    )


def _regex(content: Column, pattern: str) -> Column:
    regex = F.lit(pattern)
    return _between_and_in(F.transform(F.split(content, regex, -1), _bytes),
                           F.transform(F.regexp_extract_all(content, regex, F.lit(0)), _bytes))


def term_positions(content: Column, term: Term | str, strict: bool = False) -> Column:
    """Positions of one term. Ignoring case, plain offsets refer to the lower-cased text."""
    term = Term.of(term)
    if term.query is None or (term.query == "" and not term.regex):
        return _no_positions()
    if term.regex:
        m = term.matcher(strict)
        if m is None:
            return _no_positions()
        return located(content, m, lambda c: _regex(c, m.java)) if m.sends else _regex(content, m.java)
    return (_whole_word if term.whole_word else _plain)(content, term)


def match_positions(content: Column, query: LogicalQuery, strict: bool = False) -> Column:
    """Positions of all terms: ``must``, then ``any``, then ``none``; neither sorted nor deduplicated."""
    parts = [term_positions(content, t, strict) for t in query.terms]
    return reduce(F.concat, parts) if parts else _no_positions()
