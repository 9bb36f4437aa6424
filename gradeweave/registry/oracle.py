"""The registered queries again as SQL over the driver's tables, for DuckDB.

Written from the rules, by other means than the Spark code: names are compared
pair by pair, sets are lists, and order is taken by sorting.
"""

from __future__ import annotations

from gradeweave.registry.queries import SEMESTER
from gradeweave.sources.order_sheet import (
    ALIKE_EMPHASES,
    ALIKE_FIRST,
    ALIKE_LAST,
    ALIKE_STANDINGS,
    EMPHASES,
    FIRST_NAMES,
    FIRST_SCORE_COLUMN,
    STANDINGS,
    SURNAME_HEADS,
    SURNAME_TAILS,
)


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _case(key: str, mapping: dict[str, str]) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items()) + " END"


def _marked(x: str) -> str:
    """Upper case in which the letters without capital that occur are one-byte marks, as edits are counted in bytes."""
    return f"upper(translate({x}, '\xdf\u0131', chr(1) || chr(2)))"


def _upper(x: str) -> str:
    return f"translate({_marked(x)}, chr(1) || chr(2), '\xdf\u0131')"


# The texts of reports and messages, written out once more.
NOT_AVAILABLE = "N/A"
TITLE = "Assessment Scores For "
NOTE = '"Average" is the average score for all students with the same Emphasis and Class Standing in a semester.'
ROW_LABELS = ("Yours:", "Average:")
TEXTS = {
    "flipped": "Student {winner} has potential flipped first and last name {found} in semester {semester}",
    "dash": "Student {winner} has potential missing dash {found} in semester {semester}",
    "misspelled": "Student {winner} has potential misspelled name {found} in semester {semester}; using {winner}",
    "standing": "Student {winner} has multiple class standings for semester {semester}; picking {found}",
    "emphasis": "Student {winner} has multiple emphases for semester {semester}; picking {found}",
}

LINES = range(1, 8)
NAMES_OF_LINE = {
    1: "Oral", 3: "Acting/Directing Approach", 4: "Design Approach",
    5: "Educational Approach", 6: "Other Project Approach", 7: "Overall Success",
}
SCORE_NAME = "CASE ln " + " ".join(f"WHEN {n} THEN '{name}'" for n, name in NAMES_OF_LINE.items()) + " END"

# The derived sheet: sheet(row_no, a first, ...) and its score cells long, raw_cells(row_no, ln, raw).
SHEET = f"""
forms AS (
  SELECT o_orderkey AS k, o_custkey AS c, o_orderdate AS d, o_orderpriority AS prio,
         o_orderstatus AS status, c_mktsegment AS seg
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey
),
base AS (
  SELECT *, CASE WHEN c % 97 = 0 THEN 'Mary' WHEN c % 83 < 2 THEN {_list(ALIKE_FIRST)}[c % 83 + 1] ELSE {_list(FIRST_NAMES)}[c % 16 + 1] END AS bf,
         CASE WHEN c % 97 = 0 THEN 'Ann' WHEN c % 89 < 2 THEN {_list(ALIKE_LAST)}[c % 89 + 1]
              ELSE {_list(SURNAME_HEADS)}[(c // 16) % 16 + 1] || {_list(SURNAME_TAILS)}[(c // 256) % 12 + 1] END AS bl
  FROM forms
),
sheet AS (
  SELECT k AS row_no, c, status, prio,
    CASE WHEN k % 67 = 0 OR k % 61 = 0 THEN NULL WHEN k % 53 = 0 THEN bl WHEN k % 179 = 0 THEN 'Mary-Ann'
         WHEN k % 47 = 0 THEN bf[1:2] || bf[4:] WHEN k % 59 = 0 THEN chr(160) || bf || chr(160) ELSE bf END AS first_raw,
    CASE WHEN k % 67 = 0 THEN NULL WHEN k % 53 = 0 THEN bf WHEN k % 43 = 0 THEN bl || 's' ELSE bl END AS last_raw,
    CASE WHEN k % 73 = 0 THEN NULL WHEN c % 83 < 2 THEN {_list(ALIKE_STANDINGS)}[k % 2 + 1] ELSE {_case("prio[1:1]", STANDINGS)} END AS standing_raw,
    CASE WHEN k % 71 = 0 THEN NULL WHEN c % 89 < 2 THEN {_list(ALIKE_EMPHASES)}[k % 2 + 1] ELSE {_case("seg", EMPHASES)} END AS emphasis_raw,
    CASE WHEN k % 79 = 0 THEN 'TBD' WHEN k % 83 = 0 THEN 'New Student Fall ' || year(d)
         WHEN month(d) < 7 THEN 'Spring ' || year(d) ELSE 'Fall ' || year(d) END AS semester_raw
  FROM base
),
quantity AS (
  SELECT l_orderkey AS k, l_linenumber AS ln, CAST(floor(max(l_quantity)) AS INTEGER) AS q
  FROM lineitem WHERE l_linenumber BETWEEN 1 AND 7 GROUP BY ALL
),
raw_cells AS MATERIALIZED (
  SELECT s.row_no, n.ln,
    CASE WHEN q IS NULL THEN NULL
         WHEN (row_no + n.ln) % 31 = 0 THEN 'n/a'
         WHEN (row_no + n.ln) % 37 = 0 THEN '1,0' || (q + 10)
         WHEN (row_no + n.ln) % 41 = 0 THEN q || '-'
         WHEN (row_no + n.ln) % 43 = 0 THEN '12345678901' || lpad(CAST(q AS VARCHAR), 2, '0')
         WHEN (row_no + n.ln) % 47 = 0 THEN '0.000000' || lpad(CAST(q AS VARCHAR), 2, '0')
         ELSE (q // 10) || '.' || (q % 10) END AS raw
  FROM sheet s CROSS JOIN (SELECT CAST(unnest(range(1, 8)) AS INTEGER) AS ln) n
  LEFT JOIN quantity t ON t.k = s.row_no AND t.ln = n.ln
)"""


def _clean(column: str) -> str:
    return f"trim(replace({column}, chr(160), ' '))"


def _sort_key(x: str) -> str:
    words = f"string_split({x}, ' ')"
    term = f"replace(replace({_upper(words + '[-2]')}, 'FALL', '2'), 'SPRING', '1')"
    return (
        f"CASE WHEN NOT contains({x}, ' ') THEN NULL WHEN contains(upper({x}), 'NEW STUDENT') THEN {words}[-1] || '0' "
        f"WHEN contains(upper({x}), 'FALL') OR contains(upper({x}), 'SPRING') THEN {words}[-1] || {term} ELSE {x} END"
    )


ROWS = f"""{SHEET},
cleaned AS (
  SELECT row_no, {_clean("first_raw")} AS first_name, {_clean("last_raw")} AS last_name,
         {_clean("standing_raw")} AS class_standing, {_clean("emphasis_raw")} AS emphasis,
         {_clean("semester_raw")} AS semester
  FROM sheet
),
rows_ AS (
  SELECT *, coalesce(first_name, '') || ' ' || coalesce(last_name, '') AS student_identifier FROM cleaned
),
named AS (SELECT * FROM rows_ WHERE trim(student_identifier) <> ''),
dated AS (SELECT * FROM named WHERE contains(coalesce(semester, ''), ' ')),
usable AS (
  SELECT * REPLACE (
    CASE WHEN (class_standing = '1 - Freshman' OR contains(lower(semester), 'new student'))
              AND emphasis = 'Musical Theatre' THEN 'Musical Theatre Applicant' ELSE emphasis END AS emphasis)
  FROM dated
)"""

SCORES = f"""{ROWS},
numbers AS (
  SELECT row_no, ln, raw,
    CASE WHEN regexp_full_match(raw, '[0-9.,]+') THEN CAST(replace(raw, ',', '') AS DECIMAL(28,8))
         WHEN regexp_full_match(raw, '[0-9.,]+-') THEN -CAST(replace(rtrim(raw, '-'), ',', '') AS DECIMAL(28,8)) END AS score
  FROM raw_cells
),
scores AS (
  SELECT u.row_no * 10000 + ln + {FIRST_SCORE_COLUMN - 1} AS ord, first_name, last_name, student_identifier, semester,
         {_sort_key("semester")} AS semester_sort, class_standing, emphasis, {SCORE_NAME} AS score_name,
         CAST(score AS DECIMAL(28,8)) AS score
  FROM usable u JOIN numbers n USING (row_no) WHERE score IS NOT NULL
)"""


def _averages(scores: str) -> str:
    return f"""
averages AS (
  SELECT student_identifier, first(last_name ORDER BY ord) AS last_name, semester, semester_sort, score_name,
         first(class_standing ORDER BY ord) AS class_standing, first(emphasis ORDER BY ord) AS emphasis,
         CAST(sum(score) AS DECIMAL(38,8)) AS score_sum, count(*) AS score_count, min(ord) AS first_ord
  FROM {scores} GROUP BY student_identifier, semester, semester_sort, score_name
),
cohorts AS (
  SELECT semester_sort, class_standing, emphasis, score_name,
         CAST(sum(score) AS DECIMAL(38,8)) AS score_sum, count(*) AS score_count
  FROM {scores} GROUP BY ALL
)"""


def _two_places(total: str, count: str) -> str:
    """Half away from zero by integers: hundredths = (2 * sum * 100 + count) // (2 * count)."""
    units = f"CAST(replace(CAST(abs({total}) AS VARCHAR), '.', '') AS HUGEINT)"
    cents = f"((2 * {units} + 1000000 * CAST({count} AS HUGEINT)) // (2000000 * CAST({count} AS HUGEINT)))"
    digits = f"CAST({cents} // 100 AS VARCHAR)"
    rest = f"rtrim(lpad(CAST({cents} % 100 AS VARCHAR), 2, '0'), '0')"
    sign = f"CASE WHEN {total} < 0 AND {cents} > 0 THEN '-' ELSE '' END"
    return f"{sign} || {digits} || CASE WHEN {cents} % 100 = 0 THEN '' ELSE '.' || {rest} END"


REPORT = f"""
shown AS (
  SELECT a.student_identifier, a.last_name, a.score_name, a.semester, a.semester_sort,
         {_two_places("a.score_sum", "a.score_count")} AS yours,
         coalesce({_two_places("g.score_sum", "g.score_count")}, '{NOT_AVAILABLE}') AS average, a.first_ord
  FROM averages a LEFT JOIN cohorts g
    ON a.semester_sort = g.semester_sort AND a.score_name IS NOT DISTINCT FROM g.score_name
   AND a.class_standing IS NOT DISTINCT FROM g.class_standing AND a.emphasis IS NOT DISTINCT FROM g.emphasis
)"""

POSITIONS = """
heads AS (
  SELECT student_identifier, first(last_name ORDER BY semester_sort, first_ord) AS last_name,
         min(semester_sort) AS semester_sort, first(first_ord ORDER BY semester_sort, first_ord) AS first_ord
  FROM averages GROUP BY student_identifier
),
student_places AS (
  SELECT *, row_number() OVER (ORDER BY last_name NULLS FIRST, semester_sort, first_ord) AS student_pos FROM heads
),
semester_places AS (
  SELECT student_identifier, semester, semester_sort,
         CAST(row_number() OVER (PARTITION BY student_identifier ORDER BY semester_sort, min(first_ord)) AS INTEGER)
           AS semester_pos
  FROM averages GROUP BY student_identifier, semester, semester_sort
),
assessments AS (
  SELECT student_identifier, score_name, min({'s': semester_sort, 'o': first_ord}) AS first_at
  FROM averages GROUP BY student_identifier, score_name
),
score_places AS (
  SELECT student_identifier, score_name,
         CAST(row_number() OVER (PARTITION BY student_identifier
                                 ORDER BY coalesce(score_name = 'Overall Success', false), first_at) AS INTEGER) AS score_pos
  FROM assessments
)"""

GRID = f"""
grid AS (
  SELECT student_identifier, score_name, semester, score_pos, semester_pos,
         coalesce(yours, '{NOT_AVAILABLE}') AS yours, average
  FROM (SELECT p.*, t.semester, t.semester_pos FROM score_places p JOIN semester_places t USING (student_identifier)) f
  LEFT JOIN (SELECT student_identifier AS id, score_name AS heading, semester AS term, yours, average FROM shown) s
    ON id = student_identifier AND heading IS NOT DISTINCT FROM score_name AND term = semester
)"""


def _swaps(scores: str) -> str:
    return f"""
students AS (
  SELECT student_identifier AS id, count(*) AS n, first(first_name ORDER BY ord) AS f, first(last_name ORDER BY ord) AS l
  FROM {scores} GROUP BY 1
),
turned AS (
  SELECT coalesce(last_name, '') || ' ' || coalesce(first_name, '') AS name, count(*) AS n FROM {scores} GROUP BY 1
),
flips AS (
  SELECT t.name, s.id, s.n AS n_student, t.n AS n_other, s.l AS f, s.f AS l
  FROM students s JOIN turned t ON s.id = t.name WHERE s.n > t.n
),
undashed AS (SELECT replace(first_name, '-', ' ') AS name, count(*) AS n FROM {scores} GROUP BY 1),
dashes AS (
  SELECT u.name, s.id, s.n AS n_student, u.n AS n_other, s.f, s.l
  FROM students s JOIN undashed u ON s.id = u.name WHERE s.n > u.n
),
flipped AS (
  SELECT s.* REPLACE (
           CASE WHEN x.id IS NULL THEN s.student_identifier ELSE x.id END AS student_identifier,
           CASE WHEN x.id IS NULL THEN s.first_name ELSE x.f END AS first_name,
           CASE WHEN x.id IS NULL THEN s.last_name ELSE x.l END AS last_name),
         s.first_name AS old_first, s.last_name AS old_last, s.student_identifier AS old_id, x.id AS flip_id
  FROM {scores} s LEFT JOIN flips x ON x.name = coalesce(s.last_name, '') || ' ' || coalesce(s.first_name, '')
),
swapped AS (
  SELECT s.* REPLACE (
           CASE WHEN x.id IS NULL THEN s.student_identifier ELSE x.id END AS student_identifier,
           CASE WHEN x.id IS NULL THEN s.first_name ELSE x.f END AS first_name,
           CASE WHEN x.id IS NULL THEN s.last_name ELSE x.l END AS last_name),
         s.student_identifier AS flipped_id, x.id AS dash_id
  FROM flipped s LEFT JOIN dashes x ON x.name = replace(s.old_first, '-', ' ')
)"""


def _code(name: str) -> str:
    """Sound code: runs of one class, also across H and W, collapse class by class."""
    letters = f"regexp_replace({_upper(name)}, '[^A-Z]', '', 'g')"
    body = f"translate({letters}, 'BFPVCGJKQSXZDTLMNR', '111122222222334556')"
    head = f"translate({letters}[1:1], 'BFPVCGJKQSXZDTLMNR', '111122222222334556')"
    for d in "123456":
        body = f"regexp_replace({body}, '{d}+[WH]*{d}*', '{d}', 'g')"
    body = f"regexp_replace({body}, '[WH]', '', 'g')"
    tail = f"regexp_replace(CASE WHEN ({body})[1:1] = {head} THEN ({body})[2:] ELSE {body} END, '[AEIOUY]', '', 'g')"
    return f"CASE WHEN {letters} = '' THEN '0000' ELSE rpad(({letters}[1:1] || {tail})[1:4], 4, '0') END"


def _names(source: str) -> str:
    return f"""
names AS MATERIALIZED (
  SELECT part, name, min(ord) AS ord, {_code("name")} AS code, {_marked("name")} AS up
  FROM (SELECT 'first' AS part, first_name AS name, ord FROM {source}
        UNION ALL SELECT 'last', last_name, ord FROM {source})
  WHERE trim(coalesce(name, '')) <> '' GROUP BY part, name
),
alike AS MATERIALIZED (
  SELECT a.part, a.name AS a, a.ord AS a_ord, a.code AS a_code, b.name AS b, b.code AS b_code
  FROM names a JOIN names b ON a.part = b.part
  WHERE a.code = b.code OR levenshtein(a.up, b.up) <= 1
     OR starts_with(a.up, b.up) OR starts_with(b.up, a.up) OR ends_with(a.up, b.up) OR ends_with(b.up, a.up)
)"""


SETS = """
sets AS MATERIALIZED (SELECT part, a AS owner, a_ord AS ord, list(b) AS members, count(*) AS size FROM alike GROUP BY ALL),
kept AS MATERIALIZED (
  SELECT * FROM sets s WHERE NOT EXISTS (
    SELECT 1 FROM sets t WHERE t.part = s.part AND (s.size < t.size OR (s.size = t.size AND s.ord < t.ord))
      AND list_has_all(t.members, s.members))
),
used AS MATERIALIZED (
  SELECT n.part, n.name, first(k.owner ORDER BY k.size, k.ord) AS owner_name,
         first(k.size ORDER BY k.size, k.ord) AS set_size, first(k.members ORDER BY k.size, k.ord) AS members
  FROM names n JOIN kept k ON k.part = n.part AND list_contains(k.members, n.name) GROUP BY n.part, n.name
)"""

# Pairs of names, and the pairs each would take of those after it. Empty names do not occur.
EDGES = f"""
pairs AS MATERIALIZED (
  SELECT first_name, last_name, min(ord) AS ord, count(*) AS n FROM swapped
  WHERE first_name IS NOT NULL AND last_name IS NOT NULL GROUP BY ALL
),
wide AS (SELECT part, name, unnest(members) AS member FROM used),
folded AS MATERIALIZED (SELECT DISTINCT part, name, {_upper('member')} AS member FROM wide),
takes AS MATERIALIZED (
  SELECT p.ord AS taker, q.ord AS taken
  FROM pairs p
  JOIN folded x ON x.part = 'first' AND x.name = p.first_name
  JOIN folded y ON y.part = 'last' AND y.name = p.last_name
  JOIN pairs q ON {_upper('q.first_name')} = x.member AND {_upper('q.last_name')} = y.member
  WHERE p.ord <= q.ord
)"""

ROUNDS = 12  # more than any tested input needs; pairs left open would show as missing rows


def _rounds() -> str:
    """Rounds of deciding pairs: state 1 leads, 2 is taken, 0 is open."""
    ctes = ["state_0 AS MATERIALIZED (SELECT ord, 0 AS st FROM pairs)"]
    for r in range(1, ROUNDS + 1):
        ctes.append(f"""
state_{r} AS MATERIALIZED (
  SELECT s.ord, CASE WHEN s.st <> 0 THEN s.st
                     WHEN coalesce(max(CASE WHEN p.st = 1 THEN 1 ELSE 0 END), 0) = 1 THEN 2
                     WHEN coalesce(min(p.st), 2) = 2 THEN 1 ELSE 0 END AS st
  FROM state_{r - 1} s
  LEFT JOIN takes t ON t.taken = s.ord AND t.taker < s.ord
  LEFT JOIN state_{r - 1} p ON p.ord = t.taker
  GROUP BY s.ord, s.st
)""")
    return ",".join(ctes)


CLUSTERS = f"""{_rounds()},
clusters AS MATERIALIZED (
  SELECT q.first_name, q.last_name, q.ord AS first_ord, q.n, min(t.taker) AS leader
  FROM pairs q JOIN takes t ON t.taken = q.ord
  JOIN state_{ROUNDS} s ON s.ord = t.taker AND s.st = 1
  GROUP BY ALL
),
first_modes AS (
  SELECT leader, first_name, row_number() OVER (PARTITION BY leader ORDER BY sum(n) DESC, min(first_ord)) AS place
  FROM clusters GROUP BY leader, first_name
),
last_modes AS (
  SELECT leader, last_name, row_number() OVER (PARTITION BY leader ORDER BY sum(n) DESC, min(first_ord)) AS place
  FROM clusters GROUP BY leader, last_name
),
canonical AS MATERIALIZED (
  SELECT c.first_name, c.last_name, f.first_name AS canonical_first_name, l.last_name AS canonical_last_name
  FROM clusters c JOIN first_modes f ON f.leader = c.leader AND f.place = 1
  JOIN last_modes l ON l.leader = c.leader AND l.place = 1
),
wrong AS (
  SELECT *, canonical_first_name || ' ' || canonical_last_name AS right_id FROM canonical
  WHERE first_name <> canonical_first_name OR last_name <> canonical_last_name
),
spelled AS MATERIALIZED (
  SELECT s.* REPLACE (
           coalesce(w.right_id, s.student_identifier) AS student_identifier,
           coalesce(w.canonical_first_name, s.first_name) AS first_name,
           coalesce(w.canonical_last_name, s.last_name) AS last_name),
         w.right_id AS spelling_id, s.first_name AS first_1, s.last_name AS last_1
  FROM swapped s LEFT JOIN wrong w ON w.first_name = s.first_name AND w.last_name = s.last_name
)"""


def _conflicts(source: str) -> str:
    parts = []
    for tag, attribute in (("standing", "class_standing"), ("emphasis", "emphasis")):
        parts.append(f"""
{tag}_modes AS (
  SELECT student_identifier, semester, {attribute},
         row_number() OVER (PARTITION BY student_identifier, semester ORDER BY count(*) DESC, min(ord)) AS place
  FROM {source} GROUP BY student_identifier, semester, {attribute}
),
{tag}_conflicts AS MATERIALIZED (
  SELECT student_identifier, semester, c.n_values, m.{attribute}
  FROM (SELECT student_identifier, semester, count(DISTINCT coalesce({_upper(attribute)}, chr(3))) AS n_values
        FROM {source} GROUP BY ALL) c
  JOIN {tag}_modes m USING (student_identifier, semester)
  WHERE m.place = 1 AND c.n_values > 1
)""")
    return ",".join(parts)


def _settled(source: str) -> str:
    return f"""
settled AS MATERIALIZED (
  SELECT s.* REPLACE (
           CASE WHEN c.n_values IS NULL THEN s.class_standing ELSE c.class_standing END AS class_standing,
           CASE WHEN e.n_values IS NULL THEN s.emphasis ELSE e.emphasis END AS emphasis)
  FROM {source} s
  LEFT JOIN standing_conflicts c USING (student_identifier, semester)
  LEFT JOIN emphasis_conflicts e USING (student_identifier, semester)
)"""


def _message(kind: str, winner: str, found: str) -> str:
    text = TEXTS[kind]
    for field, value in (("winner", winner), ("found", f"coalesce({found}, '')"), ("semester", "semester")):
        text = text.replace("{" + field + "}", f"' || {value} || '")
    return (
        f"'{kind}' AS kind, {winner} AS student_identifier, semester, semester || '_' || {winner} AS sort_value, "
        f"'{text}' AS message"
    )


MESSAGES = f"""
messages AS (
  SELECT DISTINCT {_message("flipped", "flip_id", "old_id")} FROM swapped WHERE flip_id IS NOT NULL
  UNION SELECT {_message("dash", "dash_id", "flipped_id")} FROM swapped WHERE dash_id IS NOT NULL
  UNION SELECT {_message("misspelled", "spelling_id", "first_1 || ' ' || last_1")} FROM spelled WHERE spelling_id IS NOT NULL
  UNION SELECT {_message("standing", "student_identifier", "class_standing")} FROM standing_conflicts
  UNION SELECT {_message("emphasis", "student_identifier", "emphasis")} FROM emphasis_conflicts
)"""

SWAPS = _swaps("scores")
LIKENESS = f"{_names('swapped')},{SETS}"
REPAIRS = f"{SCORES},{SWAPS},{LIKENESS},{EDGES},{CLUSTERS}"
VALIDATED = f"{REPAIRS},{_conflicts('spelled')},{_settled('spelled')}"
RAW_REPORT = f"{SCORES},{_averages('scores')},{REPORT},{POSITIONS}"

SCORE_COLUMNS = (
    "ord, first_name, last_name, student_identifier, semester, semester_sort, class_standing, emphasis, score_name, score"
)


def _alike(part: str) -> str:
    return f"""WITH {SCORES},{SWAPS},{_names('swapped')}
SELECT name, 'sound' AS via, code AS alike FROM names WHERE part = '{part}'
UNION ALL SELECT a, 'link', b FROM alike WHERE part = '{part}' AND a_code <> b_code"""


def _header_counts(skipped: int | None = None) -> str:
    where = f"WHERE ln <> {skipped - FIRST_SCORE_COLUMN + 1}" if skipped else ""
    return f"""WITH {SHEET}
SELECT CAST(ln + {FIRST_SCORE_COLUMN - 1} AS INTEGER) AS col_no, {SCORE_NAME} AS score_name,
       count(raw) AS filled, count(*) AS cells FROM raw_cells {where} GROUP BY ln"""


def _pivot() -> str:
    semesters = [f"{t} {y}" for y in range(1995, 2002) for t in ("Spring", "New Student Fall", "Fall")]
    columns = ",\n".join(
        f"""coalesce(max(yours) FILTER (semester = '{s}'), '{NOT_AVAILABLE}') AS "{s}\"""" for s in semesters
    )
    return f"WITH {RAW_REPORT} SELECT student_identifier, score_name, {columns} FROM shown GROUP BY ALL"


NAMED = "ord, student_identifier, first_name, last_name"
MEAN = "CAST(score_sum AS DOUBLE) / score_count AS average"
SHEET_CELLS = ", ".join(
    ["CAST(row_no AS VARCHAR) AS c1", "first_raw AS c2", "last_raw AS c3", "standing_raw AS c4", "emphasis_raw AS c5",
     "semester_raw AS c6", "status AS c7", "CAST(c AS VARCHAR) AS c8"]
    + [f"max(raw) FILTER (ln = {n}) AS c{n + FIRST_SCORE_COLUMN - 1}" for n in LINES] + ["prio AS c16"]
)
HEADER_FIELDS = {
    "First Name": (2, "first_raw"), "Last Name": (3, "last_raw"), "Class Standing": (4, "standing_raw"),
    "Emphasis": (5, "emphasis_raw"), "Semester/Date": (6, "semester_raw"),
}
DIAGNOSES = {
    "first_name": ("First Name is missing", "coalesce(first_name, '') = ''"),
    "last_name": ("Last Name is missing", "coalesce(last_name, '') = ''"),
    "class_standing": ("Class Standing is missing", "coalesce(class_standing, '') = ''"),
    "emphasis": ("Emphasis is missing", "coalesce(emphasis, '') = ''"),
}

ORACLE: dict[str, str] = {
    "read_wide_sheet": f"""WITH {SHEET} SELECT row_no, {SHEET_CELLS} FROM sheet JOIN raw_cells USING (row_no)
GROUP BY row_no, first_raw, last_raw, standing_raw, emphasis_raw, semester_raw, status, c, prio""",
    "header_mapping": f"WITH {SHEET} " + " UNION ALL ".join(
        f"SELECT '{h}' AS header, CAST({n} AS INTEGER) AS col_no, count({c}) AS filled FROM sheet"
        for h, (n, c) in HEADER_FIELDS.items()
    ),
    "approach_rename": _header_counts(),
    "column_range": _header_counts(11),
    "clean_strings": f"""WITH {ROWS} SELECT row_no, first_name, last_name, class_standing, emphasis, semester FROM cleaned""",
    "student_identifier": f"WITH {ROWS} SELECT row_no, student_identifier FROM rows_",
    "filter_blank_names": f"WITH {ROWS} SELECT row_no, first_name, last_name FROM named",
    "filter_bad_semester": f"WITH {ROWS} SELECT row_no, semester FROM dated",
    "filter_empty_rows": f"""WITH {ROWS} SELECT row_no, student_identifier FROM rows_
WHERE row_no IN (SELECT row_no FROM raw_cells WHERE raw IS NOT NULL)""",
    "row_diagnostics": f"WITH {ROWS} " + " UNION ALL ".join(
        [f"SELECT row_no, '{f}' AS field, 'Row ' || row_no || ': {text}' AS message FROM named WHERE {test}"
         for f, (text, test) in DIAGNOSES.items()]
        + ["SELECT row_no, 'semester', 'Row ' || row_no || ': Semester is missing or an unexpected value: ''' || "
           "coalesce(semester, '') || '''; skipping row.' FROM named WHERE NOT contains(coalesce(semester, ''), ' ')"]
    ),
    "emphasis_reclass": f"""WITH {ROWS} SELECT row_no, class_standing, semester, emphasis AS given,
  CASE WHEN (class_standing = '1 - Freshman' OR contains(lower(semester), 'new student')) AND emphasis = 'Musical Theatre'
       THEN 'Musical Theatre Applicant' ELSE emphasis END AS emphasis FROM rows_""",
    "unpivot_scores": f"""WITH {ROWS} SELECT row_no, CAST(ln + {FIRST_SCORE_COLUMN - 1} AS INTEGER) AS col_no,
  {SCORE_NAME} AS score_name, raw
FROM (SELECT *, count(raw) OVER (PARTITION BY row_no) AS filled FROM raw_cells) JOIN usable USING (row_no) WHERE filled > 0""",
    "numeric_scores": f"WITH {SCORES} SELECT {SCORE_COLUMNS} FROM scores",
    "semester_sort_key": f"""WITH {ROWS} SELECT semester, {_sort_key("semester")} AS semester_sort, count(*) AS n
FROM rows_ GROUP BY ALL""",
    "run_counts": f"""WITH {SCORES} SELECT count(*) AS scores_read, count(*) FILTER (student_identifier IN
  (SELECT student_identifier FROM scores WHERE semester = '{SEMESTER}')) AS scores_used FROM scores""",
    "current_semester_students": f"""WITH {SCORES} SELECT ord, student_identifier, semester, score FROM scores
WHERE student_identifier IN (SELECT student_identifier FROM scores WHERE semester = '{SEMESTER}')""",
    "student_score_averages": f"WITH {SCORES},{_averages('scores')} SELECT *, {MEAN} FROM averages",
    "cohort_average": f"WITH {SCORES},{_averages('scores')} SELECT *, {MEAN} FROM cohorts",
    "format_scores": f"""WITH {SCORES},{_averages('scores')} SELECT student_identifier, semester, score_name,
  {_two_places("score_sum", "score_count")} AS shown FROM averages""",
    "report_cells": f"WITH {RAW_REPORT} SELECT * EXCLUDE (first_ord) FROM shown",
    "report_grid": f"WITH {RAW_REPORT},{GRID} SELECT * FROM grid",
    "report_pivot": _pivot(),
    "report_pivot_map": f"""WITH {RAW_REPORT} SELECT student_identifier, score_name,
  string_agg(semester, '|' ORDER BY semester_sort, first_ord) AS semesters,
  string_agg(yours, '|' ORDER BY semester_sort, first_ord) AS yours
FROM shown GROUP BY student_identifier, score_name""",
    "students_by_last_name": f"WITH {RAW_REPORT} SELECT * FROM student_places",
    "student_semesters": f"WITH {RAW_REPORT} SELECT * FROM semester_places",
    "student_assessments": f"WITH {RAW_REPORT} SELECT * FROM score_places",
    "student_report": f"""WITH {RAW_REPORT},{GRID},
lines AS (
  SELECT student_identifier, score_pos, coalesce(score_name, '') AS assessment,
         coalesce(score_name = 'Overall Success', false) AS emphasised,
         list(CASE WHEN average IS NULL THEN [yours] ELSE [yours, average] END ORDER BY semester_pos) AS cells
  FROM grid GROUP BY student_identifier, score_pos, score_name
),
documents AS (
  SELECT student_identifier, CAST(to_json(list({{'assessment': assessment, 'emphasised': emphasised, 'cells': cells}}
         ORDER BY score_pos)) AS VARCHAR) AS rows FROM lines GROUP BY student_identifier
),
terms AS (SELECT student_identifier, string_agg(semester, '|' ORDER BY semester_pos) AS semesters
          FROM semester_places GROUP BY 1)
SELECT student_identifier, student_pos, '{TITLE}' || student_identifier AS title, '{NOTE}' AS note,
       '{"|".join(ROW_LABELS)}' AS row_labels, semesters, rows
FROM documents JOIN terms USING (student_identifier) JOIN student_places USING (student_identifier)""",
    "flipped_names": f"""WITH {SCORES},{SWAPS} SELECT name AS reversed_name, id AS student_identifier, n_student,
  n_other AS n_reversed, f AS first_name, l AS last_name FROM flips""",
    "lost_dashes": f"""WITH {SCORES},{SWAPS} SELECT name AS undashed, id AS student_identifier, n_student,
  n_other AS n_undashed, f AS first_name, l AS last_name FROM dashes""",
    "soundex_names": f"""WITH {SCORES}, n AS (SELECT DISTINCT 'first' AS part, first_name AS name FROM scores
  UNION SELECT 'last', last_name FROM scores)
SELECT part, name, {_code("name")} AS code FROM n WHERE name IS NOT NULL""",
    "levenshtein_pairs": f"""WITH {SCORES}, n AS (SELECT DISTINCT 'first' AS part, {_upper("first_name")} AS name, {_marked("first_name")} AS up FROM scores
  UNION SELECT 'last', {_upper("last_name")}, {_marked("last_name")} FROM scores)
SELECT a.part, a.name, b.name AS other FROM n a JOIN n b ON a.part = b.part AND a.name <> b.name
WHERE levenshtein(a.up, b.up) <= 1""",
    "similar_first_names": _alike("first"),
    "similar_last_names": _alike("last"),
    "name_blocks": f"""WITH {SCORES},{SWAPS},{_names('swapped')},
linked AS (SELECT DISTINCT x.part, x.a_code, n.up AS a, m.up AS b FROM alike x
  JOIN names n ON n.part = x.part AND n.name = x.a JOIN names m ON m.part = x.part AND m.name = x.b WHERE x.a_code <> x.b_code),
counted AS (SELECT part, a_code, count(*) AS links FROM linked GROUP BY ALL)
SELECT n.part, n.code, count(DISTINCT n.up) AS names, count(*) AS spellings, coalesce(any_value(c.links), 0) AS links
FROM names n LEFT JOIN counted c ON c.part = n.part AND c.a_code = n.code GROUP BY n.part, n.code""",
    "maximal_name_sets": f"WITH {SCORES},{SWAPS},{LIKENESS} SELECT part, name, owner_name, set_size FROM used",
    "name_pair_edges": f"""WITH {SCORES},{SWAPS},{LIKENESS},{EDGES},
firsts AS (SELECT taken, min(taker) AS taker FROM takes GROUP BY 1)
SELECT q.first_name, q.last_name, p.first_name AS taker_first_name, p.last_name AS taker_last_name
FROM firsts t JOIN pairs q ON q.ord = t.taken JOIN pairs p ON p.ord = t.taker""",
    "name_clusters": f"WITH {REPAIRS} SELECT first_name, last_name, first_ord, n, leader FROM clusters",
    "canonical_names": f"WITH {REPAIRS} SELECT * FROM canonical",
    "repair_flipped": f"WITH {SCORES},{SWAPS} SELECT {NAMED} FROM flipped",
    "repair_dashes": f"""WITH {SCORES},{SWAPS} SELECT ord, coalesce(x.id, student_identifier) AS student_identifier,
  CASE WHEN x.id IS NULL THEN first_name ELSE x.f END AS first_name,
  CASE WHEN x.id IS NULL THEN last_name ELSE x.l END AS last_name
FROM scores LEFT JOIN dashes x ON x.name = replace(first_name, '-', ' ')""",
    "repair_misspelled": f"WITH {REPAIRS} SELECT {NAMED} FROM spelled",
    "mode_first_seen": f"""WITH {SCORES}, counted AS (
  SELECT student_identifier, semester, class_standing, count(*) AS n, min(ord) AS o FROM scores GROUP BY ALL)
SELECT student_identifier, semester, first(class_standing ORDER BY n DESC, o) AS class_standing,
       CAST(sum(n) AS BIGINT) AS n, min(o) AS first_ord FROM counted GROUP BY student_identifier, semester""",
    "multiple_standings": f"WITH {SCORES},{_conflicts('scores')} SELECT * FROM standing_conflicts",
    "multiple_emphases": f"WITH {SCORES},{_conflicts('scores')} SELECT * FROM emphasis_conflicts",
    "resolve_standing": f"""WITH {SCORES},{_conflicts('scores')},{_settled('scores')}
SELECT ord, class_standing FROM settled""",
    "resolve_emphasis": f"""WITH {SCORES},{_conflicts('scores')},{_settled('scores')}
SELECT ord, emphasis FROM settled""",
    "validation_messages": f"""WITH {VALIDATED},{MESSAGES}
SELECT *, {_sort_key("sort_value")} AS sort_key FROM messages""",
    "validated_scores": f"WITH {VALIDATED} SELECT {SCORE_COLUMNS} FROM settled",
    "full_report": f"""WITH {VALIDATED},{_averages('settled')},{REPORT},{POSITIONS}
SELECT shown.student_identifier, shown.score_name, semester, yours, average, student_pos, score_pos, semester_pos
FROM shown JOIN student_places USING (student_identifier)
JOIN semester_places USING (student_identifier, semester)
JOIN score_places p ON p.student_identifier = shown.student_identifier AND p.score_name IS NOT DISTINCT FROM shown.score_name""",
}
