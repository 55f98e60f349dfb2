"""The same answers as plain SQL over the tables, for a check outside Spark."""

from __future__ import annotations

WORD = r"[\p{L}\p{M}\p{N}_]"
NOT_WORD = r"[^\p{L}\p{M}\p{N}_]"

# Hex of the bytes that are letters, digits or "_" as single-byte characters, from 0xAA on.
HIGH_WORD_BYTES = "'AA','B2','B3','B5','B9','BA','BC','BD','BE'"

DOCUMENT_LINES = """
pieces AS (
  SELECT concat(source, '/', doc_id, '.log') AS file_path, string_split(text, chr(10)) AS parts FROM documents
), numbered AS (
  SELECT file_path, parts, unnest(range(1, len(parts) + 1)) AS i FROM pieces
), lines AS (
  SELECT file_path, i AS start_line, i AS end_line,
         parts[i] || CASE WHEN i < len(parts) THEN chr(10) ELSE '' END AS content
  FROM numbered WHERE NOT (i = len(parts) AND parts[i] = '')
)"""

DOCUMENT_ENTRIES = DOCUMENT_LINES + """, marked AS (
  SELECT *, sum(CASE WHEN regexp_matches(content, '^[A-M]') THEN 1 ELSE 0 END)
              OVER (PARTITION BY file_path ORDER BY start_line) AS entry FROM lines
), entries AS (
  SELECT file_path, min(start_line) AS start_line, max(end_line) AS end_line,
         string_agg(content, '' ORDER BY start_line) AS content
  FROM marked GROUP BY file_path, entry
)"""

EVENT_LINES = """
lines AS (
  SELECT concat('user/', user_id, '.log') AS file_path, ts, event_type, props,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS start_line,
         concat(strftime(ts, '%Y-%m-%d %H:%M:%S.%f'), ' ', event_type, ' ', value, ' ', props, chr(10)) AS content
  FROM events
)"""

FILE_LINES = f"""
docs AS (
  SELECT concat('source=', source, '/chunk=', doc_id // 1000) AS file_path, doc_id,
         string_split(concat('DOC ', doc_id, ' ', lang, chr(10), text), chr(10)) AS parts FROM documents
), numbered AS (
  SELECT file_path, doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM docs
), lines AS (
  SELECT file_path, doc_id, parts[i] || chr(10) AS content,
         row_number() OVER (PARTITION BY file_path ORDER BY doc_id, i) AS start_line FROM numbered
), entries AS (
  SELECT file_path, min(start_line) AS start_line, max(start_line) AS end_line,
         string_agg(content, '' ORDER BY start_line) AS content
  FROM lines GROUP BY file_path, doc_id
)"""


def from_lines(where: str, columns: str = "file_path, start_line, end_line, content", source: str = "lines") -> str:
    ctes = DOCUMENT_LINES if source == "lines" else DOCUMENT_ENTRIES
    return f"WITH {ctes} SELECT {columns} FROM {source} WHERE {where}"


def events(where: str, columns: str = "file_path, start_line, start_line AS end_line, content", tail: str = "") -> str:
    return f"WITH {EVENT_LINES} SELECT {columns} FROM lines WHERE {where} {tail}"


def plain_positions(source: str, needle: str, lower: bool = True, name: str = "plain") -> str:
    """CTE: byte offsets of the non-overlapping occurrences of a lower-case or exact needle."""
    hay = "lower(content)" if lower else "content"
    width = len(needle.encode())
    return f"""{name}_split AS (
  SELECT file_path, start_line, string_split({hay}, '{needle}') AS p FROM {source} WHERE contains({hay}, '{needle}')
), {name}_pieces AS (
  SELECT file_path, start_line, unnest(p) AS piece, unnest(range(len(p))) AS i, len(p) AS n FROM {name}_split
), {name} AS (
  SELECT file_path, start_line, i AS pos, n,
         (sum(strlen(piece)) OVER (PARTITION BY file_path, start_line ORDER BY i) + i * {width})::BIGINT AS match_offset,
         {width}::BIGINT AS match_length, piece,
         lead(piece) OVER (PARTITION BY file_path, start_line ORDER BY i) AS next_piece
  FROM {name}_pieces
)"""


def regex_positions(source: str, pattern: str, name: str = "rx") -> str:
    return f"""{name}_split AS (
  SELECT file_path, start_line, string_split_regex(content, '{pattern}') AS p,
         regexp_extract_all(content, '{pattern}') AS m FROM {source} WHERE regexp_matches(content, '{pattern}')
), {name}_pieces AS (
  SELECT file_path, start_line, unnest(p[:len(m)]) AS piece, unnest(m) AS hit, unnest(range(len(m))) AS i FROM {name}_split
), {name} AS (
  SELECT file_path, start_line, i AS pos,
         (sum(strlen(piece) + strlen(hit)) OVER (PARTITION BY file_path, start_line ORDER BY i) - strlen(hit))::BIGINT
           AS match_offset,
         strlen(hit)::BIGINT AS match_length
  FROM {name}_pieces
)"""


def word_filter(name: str) -> str:
    """Of plain occurrences those whose neighbouring bytes are not word characters."""

    def is_word(byte: str) -> str:
        return (f"(regexp_full_match({byte}, '3[0-9]|[46][1-9A-F]|[57][0-9A]|5F') OR {byte} IN ({HIGH_WORD_BYTES})"
                f" OR ({byte} >= 'C0' AND {byte} NOT IN ('D7', 'F7')))")

    before = "right(hex(encode(right(piece, 1))), 2)"
    after = "left(hex(encode(left(next_piece, 1))), 2)"
    # an empty piece between two occurrences has the neighbouring word itself on that side
    return f"""{name}_words AS (
  SELECT file_path, start_line, pos, match_offset, match_length FROM {name}
  WHERE pos < n - 1
    AND CASE WHEN piece = '' THEN pos = 0 ELSE NOT {is_word(before)} END
    AND CASE WHEN next_piece = '' THEN pos = n - 2 ELSE NOT {is_word(after)} END
)"""


POSITION_COLUMNS = "file_path, start_line, pos, match_offset, match_length"
RENUMBERED = ("file_path, start_line, row_number() OVER (PARTITION BY file_path, start_line ORDER BY match_offset) - 1 AS pos, "
              "match_offset, match_length")


def concatenated(parts: list[str]) -> str:
    """Positions of several terms one after the other."""
    union = " UNION ALL ".join(
        f"SELECT {k} AS term, file_path, start_line, match_offset, match_length FROM {p}" for k, p in enumerate(parts)
    )
    return f"""found AS ({union}), placed AS (
  SELECT file_path, start_line, match_offset, match_length,
         row_number() OVER (PARTITION BY file_path, start_line ORDER BY term, match_offset) - 1 AS pos FROM found
)"""


AS_TEXT = """texts AS (
  SELECT file_path, start_line, string_agg(concat(match_offset, ':', match_length), ',' ORDER BY pos) AS positions
  FROM placed GROUP BY file_path, start_line
)"""

EN_PLAIN = plain_positions("lines", "en") + ", plain_hits AS (SELECT * FROM plain WHERE pos < n - 1)"
PATH_KEY = "string_split(file_path, '/')"
WORD_LE = f"(?i)(^|{NOT_WORD})le($|{NOT_WORD})"

END_TO_END_WHERE = (
    "contains(lower(content), 'en') AND regexp_matches(content, "
    rf"'(?i)(^|{NOT_WORD})[a-z]{{2,4}}($|{NOT_WORD})')"
    f" AND (regexp_matches(content, '{WORD_LE}') OR contains(lower(content), 'the')) AND NOT contains(content, 'Que')"
)

ERROR_HITS = "contains(lower(content), 'error')"

PER_FILE = f"""WITH {EVENT_LINES}, hits AS (
  SELECT file_path, start_line, start_line AS end_line, content,
         row_number() OVER (PARTITION BY file_path ORDER BY start_line) AS k
  FROM lines WHERE {ERROR_HITS}
)"""


def across_files(limit: int) -> str:
    return PER_FILE + f""", files AS (
  SELECT file_path, least(count(*), {limit}) AS hits,
         coalesce(sum(least(count(*), {limit})) OVER (
           ORDER BY {PATH_KEY} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier
  FROM hits GROUP BY file_path
)"""


EVENTS_END_TO_END = f"""WITH {EVENT_LINES}, hits AS (
  SELECT file_path, start_line, content, row_number() OVER (PARTITION BY file_path ORDER BY start_line) AS k
  FROM lines
  WHERE date_trunc('second', ts) BETWEEN TIMESTAMP '2024-01-03 12:00:00' AND TIMESTAMP '2024-01-25 00:00:00'
    AND contains(content, 'e') AND event_type IN ('error', 'view') AND NOT contains(props, '"k": 1')
), files AS (
  SELECT file_path, coalesce(sum(least(count(*), 150)) OVER (
           ORDER BY {PATH_KEY} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier
  FROM hits GROUP BY file_path
), page AS (
  SELECT hits.* FROM hits JOIN files USING (file_path) WHERE k <= 150 AND earlier < 150
  ORDER BY {PATH_KEY}, start_line LIMIT 40 OFFSET 40
), {plain_positions("page", "e", name="e1")}, {plain_positions("page", "error", name="e2")},
{plain_positions("page", "view", name="e3")},
h1 AS (SELECT * FROM e1 WHERE pos < n - 1), h2 AS (SELECT * FROM e2 WHERE pos < n - 1), h3 AS (SELECT * FROM e3 WHERE pos < n - 1),
{concatenated(["h1", "h2", "h3"])}, {AS_TEXT}
SELECT file_path, start_line, start_line AS end_line, content, positions FROM page JOIN texts USING (file_path, start_line)"""

STEP_REPORT = f"""WITH {EVENT_LINES}, kept AS (
  SELECT *, row_number() OVER (ORDER BY {PATH_KEY}, start_line) AS place FROM lines
  WHERE date_trunc('second', ts) BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-20 23:59:59'
), steps AS (
  SELECT 1 AS step_no, 'errors' AS step, *, false AS failed FROM kept WHERE event_type = 'error' AND contains(props, '"k": 1')
  UNION ALL SELECT 2, 'clicks', *, contains(props, '"k": 9') AND NOT contains(props, '"k": 99') FROM kept WHERE event_type = 'click'
  UNION ALL SELECT 3, 'money', *, false FROM kept WHERE event_type IN ('purchase', 'signup')
), names AS (
  SELECT * FROM (VALUES (1, 'errors'), (2, 'clicks'), (3, 'money'), (4, 'nothing')) AS t(step_no, step)
), found AS (
  SELECT step_no, count(*) AS hits, arg_min(left(trim(content, chr(10)), 100), place) AS sample,
         arg_min(left(trim(content, chr(10)), 150), place) FILTER (WHERE failed) AS failed_sample,
         arg_min(CASE WHEN contains(content, 'user/1') THEN 'user/1' WHEN contains(content, '95') THEN '95'
                      WHEN contains(content, '97') THEN '97' ELSE '-' END, place) FILTER (WHERE failed) AS failed_reason
  FROM steps GROUP BY step_no
)
SELECT step_no, step, coalesce(hits, 0) AS hits, sample, failed_sample, nullif(failed_reason, '-') AS failed_reason
FROM names LEFT JOIN found USING (step_no)"""


def files_with_positions(source: str, where: str, terms: list[str]) -> str:
    picked = f"picked AS (SELECT file_path, start_line, {'start_line AS ' if source == 'lines' else ''}end_line, content " \
             f"FROM {source} WHERE {where})"
    found, names = [], []
    for k, term in enumerate(terms):
        found.append(plain_positions("picked", term, name=f"t{k}"))
        found.append(f"h{k} AS (SELECT * FROM t{k} WHERE pos < n - 1)")
        names.append(f"h{k}")
    return f"""WITH {FILE_LINES}, {picked}, {", ".join(found)}, {concatenated(names)}, {AS_TEXT}
SELECT file_path, start_line, end_line, content, positions FROM picked JOIN texts USING (file_path, start_line)"""


# Latin-1 text is valid UTF-8 only where it is plain ASCII.
UNREADABLE = "SELECT file_path FROM lines WHERE regexp_matches(file_path, '[37]/') GROUP BY file_path HAVING bool_or(strlen(content) > length(content))"

ORACLE: dict[str, str] = {
    "single_line_entries": from_lines("true"),
    "multi_line_entries": f"WITH {DOCUMENT_ENTRIES} SELECT * FROM entries",
    "multi_line_conversations": """WITH pieces AS (
  SELECT conv_id, turn, string_split(concat(role, ': ', text), chr(10)) AS parts FROM conversations
), numbered AS (SELECT conv_id, turn, parts, unnest(range(1, len(parts) + 1)) AS i FROM pieces
), lines AS (
  SELECT conv_id, parts[i] || chr(10) AS line, row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) AS line_no FROM numbered
), marked AS (
  SELECT *, sum(CASE WHEN starts_with(line, 'user: ') THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY line_no) AS entry FROM lines
)
SELECT concat('conv/', conv_id, '.log') AS file_path, min(line_no) AS start_line, max(line_no) AS end_line,
       string_agg(line, '' ORDER BY line_no) AS content
FROM marked GROUP BY conv_id, entry""",
    "numbered_events": f"WITH {EVENT_LINES} SELECT file_path, start_line AS line_no, content AS line FROM lines",
    "contains_ignore_case": from_lines("contains(lower(content), 'enter')"),
    "contains_case_sensitive": from_lines("contains(content, 'The')"),
    "regex_ignore_case": from_lines("regexp_matches(content, '(?i)^the [a-z]+tion|dé[^\\n]e')"),
    "regex_case_sensitive": from_lines(r"regexp_matches(content, '[A-Z][a-z]+ [A-Z]|\.$')"),
    "regex_long_entries": rf"""WITH {DOCUMENT_LINES}, whole AS (
  SELECT file_path, min(start_line) AS start_line, max(end_line) AS end_line, string_agg(content, '' ORDER BY start_line) AS content
  FROM lines GROUP BY file_path)
SELECT * FROM whole WHERE regexp_matches(content, '[Tt]h(e|en|an)+ (?s:.)*(on|ing)+\.\n')
  AND NOT regexp_matches(content, '(en|er|\n)+the(?s:.)* (a|an|and)+\.')""",
    "whole_word": from_lines(f"regexp_matches(content, '{WORD_LE}')"),
    "whole_word_case_sensitive": from_lines(f"regexp_matches(content, '(^|{NOT_WORD})de($|{NOT_WORD})')"),
    "must_any_none": from_lines(
        "contains(lower(content), 'en') AND NOT contains(content, 'tion') AND (contains(lower(content), 'que')"
        " OR contains(lower(content), 'the') OR contains(lower(content), 'der'))"
    ),
    "match_columns": from_lines("true", """file_path, start_line,
  contains(lower(content), 'en') AND contains(lower(content), 'le') AS all_of,
  contains(lower(content), 'que') OR contains(lower(content), 'the') OR contains(lower(content), 'der') AS any_of,
  NOT (contains(lower(content), 'que') OR contains(content, 'The')) AS none_of"""),
    "null_term": from_lines("contains(lower(content), 'enter')"),
    "invalid_regex_term": from_lines("contains(lower(content), 'enter') AND contains(lower(content), 'th')"),
    "constant_terms": from_lines("true", "file_path, start_line, false AS null_in_none, false AS invalid_in_must"),
    "extract_timestamps": events("true", "file_path, start_line, ts AS entry_ts"),
    "time_range": events(
        "date_trunc('second', ts) BETWEEN TIMESTAMP '2024-01-10 08:00:00' AND TIMESTAMP '2024-01-12 17:30:00'"),
    "time_open_range": events("date_trunc('second', ts) <= TIMESTAMP '2024-01-04 00:00:00'"),
    "time_unparseable_kept": events(
        "event_type IN ('error', 'view') OR date_trunc('second', ts)"
        " BETWEEN TIMESTAMP '2024-01-10 08:00:00' AND TIMESTAMP '2024-01-11 08:00:00'"),
    "time_unreadable_bound": events("date_trunc('second', ts) <= TIMESTAMP '2024-01-02 00:00:00'"),
    "positions_plain": f"WITH {DOCUMENT_LINES}, {EN_PLAIN} SELECT {POSITION_COLUMNS} FROM plain_hits",
    "positions_plain_case_sensitive":
        f"WITH {DOCUMENT_LINES}, {plain_positions('lines', 'é', lower=False)} SELECT {POSITION_COLUMNS} FROM plain WHERE pos < n - 1",
    "positions_whole_word":
        f"WITH {DOCUMENT_LINES}, {plain_positions('lines', 'le')}, {word_filter('plain')} SELECT {RENUMBERED} FROM plain_words",
    "positions_regex":
        f"WITH {DOCUMENT_LINES}, {regex_positions('lines', '(?i)[aeiou]n[a-z]*')} SELECT {POSITION_COLUMNS} FROM rx",
    "positions_linear":
        f"WITH {DOCUMENT_LINES}, {regex_positions('lines', '(?:en|an|t)+e')} SELECT {POSITION_COLUMNS} FROM rx",
    "positions_concat":
        f"WITH {DOCUMENT_LINES}, {EN_PLAIN}, {plain_positions('lines', 'le', name='le')}, {word_filter('le')}, "
        f"{regex_positions('lines', '(?i)[aeiou]n[a-z]+')}, {plain_positions('lines', 'zz', name='zz')}, "
        f"zz_hits AS (SELECT * FROM zz WHERE pos < n - 1), "
        f"{concatenated(['plain_hits', 'le_words', 'rx', 'zz_hits'])} SELECT {POSITION_COLUMNS} FROM placed",
    "hits_without_content":
        f"WITH {DOCUMENT_LINES}, {plain_positions('lines', 'enter')}, placed AS (SELECT * FROM plain WHERE pos < n - 1), {AS_TEXT} "
        "SELECT file_path, start_line, start_line AS end_line, '' AS content, positions FROM texts",
    "cap_per_file": f"{PER_FILE} SELECT file_path, start_line, end_line, content FROM hits WHERE k <= 5",
    "cap_across_files": f"{across_files(7)} SELECT file_path, start_line, end_line, content FROM hits JOIN files USING (file_path)"
                        " WHERE earlier < 7 AND k <= 7",
    "files_within_cap": f"{across_files(200)} SELECT file_path, hits FROM files WHERE earlier < 200",
    "page_two": events(ERROR_HITS, tail=f"ORDER BY {PATH_KEY}, start_line LIMIT 25 OFFSET 25"),
    "search_totals": f"WITH {EVENT_LINES} SELECT count(*) AS total_hits, 3 AS page, 100 AS page_size, "
                     f"CAST(ceil(count(*) / 100) AS BIGINT) AS total_pages FROM lines WHERE {ERROR_HITS}",
    "count_only": from_lines("contains(lower(content), 'que')",
                             "count(*) AS total_hits, CAST(ceil(count(*) / 20) AS BIGINT) AS total_pages"),
    "glob_include_exclude": r"""SELECT url AS path FROM pages
WHERE (regexp_full_match(url, '(.*/)?fr/.*') OR regexp_full_match(url, 'https://.*\.(net|org)/[de][en]/..*'))
  AND NOT (regexp_full_match(url, '.*ref=x') OR regexp_full_match(url, '(.*/)?blog\..*/.*'))""",
    "path_order": "SELECT url AS path FROM pages ORDER BY string_split(url, '/') LIMIT 100",
    "listed_files": "SELECT source, count(*) AS documents, count(DISTINCT doc_id // 1000) AS files FROM documents GROUP BY source",
    "step_report": STEP_REPORT,
    "search_end_to_end":
        f"WITH {DOCUMENT_ENTRIES}, picked AS (SELECT * FROM entries WHERE {END_TO_END_WHERE}), "
        f"{plain_positions('picked', 'en', name='t0')}, h0 AS (SELECT * FROM t0 WHERE pos < n - 1), "
        f"{plain_positions('picked', 'le', name='t1')}, {word_filter('t1')}, "
        f"{plain_positions('picked', 'the', name='t2')}, h2 AS (SELECT * FROM t2 WHERE pos < n - 1), "
        "words AS (SELECT file_path, start_line, unnest(regexp_extract_all(content, '[\\p{L}\\p{M}\\p{N}_]+|[^\\p{L}\\p{M}\\p{N}_]+')) AS w,"
        " unnest(range(len(regexp_extract_all(content, '[\\p{L}\\p{M}\\p{N}_]+|[^\\p{L}\\p{M}\\p{N}_]+')))) AS i FROM picked), "
        "rx AS (SELECT file_path, start_line, w, strlen(w)::BIGINT AS match_length, "
        "(sum(strlen(w)) OVER (PARTITION BY file_path, start_line ORDER BY i) - strlen(w))::BIGINT AS match_offset FROM words), "
        "h1 AS (SELECT * FROM rx WHERE regexp_full_match(w, '[a-zA-Z]{2,4}')), "
        f"{concatenated(['h0', 'h1', 't1_words', 'h2'])}, {AS_TEXT} "
        "SELECT file_path, start_line, end_line, content, positions FROM picked JOIN texts USING (file_path, start_line)",
    "search_events_end_to_end": EVENTS_END_TO_END,
    "files_single_line": files_with_positions(
        "lines", f"contains(lower(content), 'enter') AND NOT regexp_matches(content, '{WORD_LE}')", ["enter"]),
    "files_multi_line": files_with_positions(
        "entries", "contains(lower(content), 'enter') AND (contains(lower(content), 'the') OR contains(lower(content), 'der'))",
        ["enter", "the", "der"]),
    "files_multi_line_page": f"WITH {FILE_LINES} SELECT file_path, start_line, end_line, content FROM entries "
                             f"WHERE contains(lower(content), 'the') ORDER BY {PATH_KEY}, start_line LIMIT 30 OFFSET 30",
    "files_summary": f"""WITH {FILE_LINES}, counts AS (
  SELECT file_path, row_number() OVER (ORDER BY {PATH_KEY}) AS place,
         least(count(*) FILTER (WHERE contains(lower(content), 'the')), 400) AS hits FROM lines GROUP BY file_path
), running AS (
  SELECT *, coalesce(sum(hits) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier FROM counts
)
SELECT sum(hits)::BIGINT AS total_hits, 1 AS page, 10 AS page_size, CAST(ceil(sum(hits) / 10) AS BIGINT) AS total_pages,
       count(*) AS files_scanned FROM running WHERE earlier < 400""",
    "gzip_lines": f"WITH {FILE_LINES} SELECT file_path, start_line AS line_no, content AS line FROM lines",
    "charset_lines": f"WITH {FILE_LINES} SELECT file_path, start_line AS line_no, content AS line FROM lines",
    "charset_mixed": f"WITH {FILE_LINES} SELECT file_path, start_line AS line_no, content AS line FROM lines",
    "files_odd_names": files_with_positions(
        "entries", "contains(lower(content), 'enter') AND (contains(lower(content), 'the') OR contains(lower(content), 'der'))",
        ["enter", "the", "der"]),
    "failed_files": f"WITH {FILE_LINES} SELECT file_path, 'invalid UTF-8 text' AS reason FROM ({UNREADABLE})",
    "files_beside_failed": f"WITH {FILE_LINES} SELECT file_path, start_line, content FROM lines "
                           f"WHERE contains(lower(content), 'the') AND file_path NOT IN ({UNREADABLE})",
}
