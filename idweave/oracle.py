"""DuckDB SQL of the registered queries.

RE2 has no look-around, so names are cut by chained replacements instead of one pattern; lambdas
are written ``lambda x: ...``.  The fixed values are stated here once more, so that the SQL does
not follow a wrong one of the library; only the presets' table is the library's own.
"""

from __future__ import annotations

from .plans import presets
from .sources import samples

# Fixed values.
CONVENTIONS = ("snake_case", "camelCase", "PascalCase", "kebab-case", "UPPER_SNAKE_CASE", "Ada_Case")
SPELLINGS = {
    "snake_case": "snake_case", "snake": "snake_case", "camelCase": "camelCase", "camel": "camelCase", "PascalCase": "PascalCase", "pascal": "PascalCase",
    "kebab-case": "kebab-case", "kebab": "kebab-case", "UPPER_SNAKE_CASE": "UPPER_SNAKE_CASE", "upper_snake": "UPPER_SNAKE_CASE", "screaming": "UPPER_SNAKE_CASE",
    "Ada_Case": "Ada_Case", "ada": "Ada_Case",
}
ROLE_WORDS = {
    "factory": ("create", "make", "new", "build"), "hook": ("use",), "setter": ("set",), "getter": ("get",), "predicate": ("is", "has", "can", "should"),
    "handler": ("on",), "validator": ("validate", "check", "verify"),
}
SHAPE_WORDS = {"array": ("a", "a1", "a2", "a3", "list", "array"), "record": ("r", "record"), "map": ("m", "map"), "set": ("set",)}
KEYWORDS = (
    "if", "else", "for", "while", "return", "fn", "func", "function", "def", "class", "struct", "enum", "impl", "use",
    "import", "from", "let", "const", "var", "pub", "self", "this", "true", "false", "null", "none", "nil",
)
SOURCE_EXTENSIONS = (
    "rs", "py", "ts", "js", "go", "java", "rb", "c", "cpp", "h", "hpp", "cs", "swift", "kt", "scala", "zig", "nim", "ex",
    "exs", "erl", "hs", "ml", "clj", "r", "lua", "php", "pl", "d", "cr", "dart", "jl", "v", "odin", "gleam", "rkt", "scm",
    "lisp", "lsp", "f", "fs", "fsi", "fsx", "sh", "bash", "zsh", "sql", "css", "tsx",
)
SKIP_DIRS = (".git", "node_modules", "target", "__pycache__", ".venv", "vendor")
LANGUAGES = {
    "rs": "rust", "py": "python", "js": "javascript", "ts": "typescript", "tsx": "tsx", "go": "go", "c": "c", "h": "c",
    "cpp": "cpp", "hpp": "cpp", "cc": "cpp", "cxx": "cpp", "java": "java", "rb": "ruby", "php": "php", "cs": "csharp",
    "swift": "swift", "kt": "kotlin", "kts": "kotlin",
}
#: (context, convention as given) of the lint queries' rules: the Rust preset's that lint reads, with the project's
PROJECT_RULES = (("function", "snake_case"), ("variable", "snake_case"), ("type", "PascalCase"), ("constant", "UPPER_SNAKE_CASE"), ("field", "camel"))


def _in(words):
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def convention(n):
    return (
        f"CASE WHEN contains({n}, '_') THEN CASE WHEN {n} = upper({n}) THEN 'UPPER_SNAKE_CASE'"
        f" WHEN len(list_filter(string_split({n}, '_'), lambda s: NOT (s = '' OR regexp_matches(s, '^\\p{{Lu}}')))) = 0 THEN 'Ada_Case' ELSE 'snake_case' END"
        f" WHEN contains({n}, '-') THEN 'kebab-case' WHEN regexp_matches({n}, '^\\p{{Lu}}') THEN 'PascalCase' ELSE 'camelCase' END"
    )


def tags(n, conv):
    cut = f"regexp_replace({n}, '([a-z])([A-Z])', '\\1_\\2', 'g')"
    for _ in range(2):  # matches overlap
        cut = f"regexp_replace({cut}, '([A-Za-z0-9$])([A-Z0-9$])([A-Z][a-z])', '\\1\\2_\\3', 'g')"
    return (
        f"CASE WHEN {conv} = 'kebab-case' THEN list_filter(string_split(lower({n}), '-'), lambda t: t <> '')"
        f" ELSE list_filter(string_split(lower({cut}), '_'), lambda t: t <> '') END"
    )


def role(t):
    cases = " ".join(f"WHEN {t}[1] IN {_in(w)} THEN '{k}'" for k, w in ROLE_WORDS.items())
    return f"CASE {cases} WHEN {t}[-1] IN {_in(ROLE_WORDS['validator'])} THEN 'validator' END"


def shape(t):
    cases = " ".join(f"WHEN {t}[-1] IN {_in(w)} THEN '{k}'" for k, w in SHAPE_WORDS.items() if k != "set")
    return f"CASE {cases} WHEN {t}[-1] = 'set' THEN CASE WHEN len({t}) > 1 AND {t}[1] = 'set' THEN NULL ELSE 'set' END WHEN ends_with({t}[-1], '$') THEN 'signal' END"


def joined(t, conv):
    cap = lambda x: f"(upper({x}[1]) || {x}[2:])"
    each = f"list_transform({t}, lambda x: {cap('x')})"
    camel = f"coalesce({t}[1], '') || array_to_string(list_transform({t}[2:], lambda x: {cap('x')}), '')"
    return (
        f"CASE {conv} WHEN 'snake_case' THEN array_to_string({t}, '_') WHEN 'kebab-case' THEN array_to_string({t}, '-') WHEN 'camelCase' THEN {camel}"
        f" WHEN 'PascalCase' THEN array_to_string({each}, '') WHEN 'UPPER_SNAKE_CASE' THEN upper(array_to_string({t}, '_')) WHEN 'Ada_Case' THEN array_to_string({each}, '_') END"
    )


_CAP = "list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:])"
_SNAKE = "replace(p_name, ' ', '_')"
_P = f"array_to_string({_CAP}, '')"

NAMES = f"""names AS (
  SELECT 'part_snake' AS file, p_partkey AS line, {_SNAKE} AS identifier, 'variable' AS context FROM part
  UNION ALL SELECT 'part_camel', p_partkey, 'get' || {_P}, 'function' FROM part
  UNION ALL SELECT 'part_pascal', p_partkey, {_P}, 'type' FROM part
  UNION ALL SELECT 'part_kebab', p_partkey, replace(p_name, ' ', '-'), 'parameter' FROM part
  UNION ALL SELECT 'part_ada', p_partkey, array_to_string({_CAP}, '_'), 'field' FROM part
  UNION ALL SELECT 'part_ns', p_partkey, replace(lower(p_type), ' ', '_') || '__' || {_SNAKE} || '_list', NULL FROM part
  UNION ALL SELECT 'brand_mixed', p_partkey, replace(p_brand, '#', '_'), 'import' FROM part
  UNION ALL SELECT 'nation_upper', n_nationkey, n_name, 'constant' FROM nation
  UNION ALL SELECT 'event_handler', event_id, 'on_' || event_type, 'function' FROM events
  UNION ALL SELECT 'event_check', event_id, 'validate_' || event_type, 'function' FROM events
  UNION ALL SELECT 'event_test', event_id, 'is_' || event_type || '_set', 'function' FROM events
  UNION ALL SELECT 'priority_kebab', o_orderkey, o_orderpriority, NULL FROM orders
)"""

PARSED = f"""WITH {NAMES}, c AS (SELECT *, {convention('identifier')} AS convention FROM names),
t AS (SELECT *, {tags('identifier', 'convention')} AS tags FROM c),
p AS (SELECT *, {role('tags')} AS role, {shape('tags')} AS shape FROM t)
"""


def _key(columns):
    return f"{PARSED} SELECT file, line, identifier, {columns} FROM p"


#: ASCII identifiers within runs of Unicode word characters; a run with other characters holds none.
def _found(source, run, pattern):
    """(file, line, identifier) of all matches in lines of a (file, text) select."""
    return f"""lines AS (
  SELECT file, unnest(range(1, len(l) + 1)) AS line, unnest(l) AS text
  FROM (SELECT file, string_split(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '\\n\\z', ''), chr(10)) AS l FROM ({source}) WHERE text <> '')
), runs AS (SELECT file, line, unnest(regexp_extract_all(text, '{run}')) AS run FROM lines),
found AS (SELECT file, line, unnest(regexp_extract_all(run, '{pattern}')) AS identifier FROM runs WHERE regexp_matches(run, '^[\\x00-\\x7F]*$'))"""


#: byte columns of the matches: what stands before a run in its line, then before a match in its run
_PLACED = r"""cut AS (SELECT file, line, unnest(range(1, len(runs) + 1)) AS i, unnest(runs) AS run, unnest(rest[1:len(runs)]) AS before
  FROM (SELECT file, line, regexp_extract_all(text, '{run}') AS runs, string_split_regex(text, '{run}') AS rest FROM lines)),
spots AS (SELECT *, sum(strlen(before) + strlen(run)) OVER (PARTITION BY file, line ORDER BY i) - strlen(run) AS start FROM cut),
inner_cut AS (SELECT file, line, i, start, unnest(range(1, len(m) + 1)) AS j, unnest(m) AS identifier, unnest(rest[1:len(m)]) AS before
  FROM (SELECT *, regexp_extract_all(run, '{plain}') AS m, string_split_regex(run, '{plain}') AS rest FROM spots WHERE regexp_matches(run, '^[\x00-\x7F]*$'))),
placed AS (SELECT file, line, start + sum(strlen(before) + strlen(identifier)) OVER (PARTITION BY file, line, i ORDER BY j) - strlen(identifier) + 1 AS "column", identifier FROM inner_cut)"""

_DOCUMENTS = "SELECT CAST(doc_id AS VARCHAR) AS file, text FROM documents"
_PAGES = "SELECT CAST(page_id AS VARCHAR) AS file, html AS text FROM pages"
_RUN = r"[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}$]+"
_PLAIN = r"\b[a-zA-Z_$][a-zA-Z0-9_$]*\b"
_DOC = f"WITH {_found(_DOCUMENTS, _RUN, _PLAIN)}, kept AS (SELECT * FROM found WHERE strlen(identifier) > 1 AND identifier NOT IN {_in(KEYWORDS)})"
#: Names with hyphens touch other characters in more ways: runs with characters beyond ASCII become two marks, one for each side.
_HTML = f"""WITH lines AS (
  SELECT file, unnest(range(1, len(l) + 1)) AS line, unnest(l) AS text
  FROM (SELECT file, string_split(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '\\n\\z', ''), chr(10)) AS l FROM ({_PAGES}) WHERE text <> '')
), marked AS (SELECT file, line, regexp_replace(regexp_replace(text, '[^\\x00-\\x7F\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Nl}}\\p{{Pc}}]', ' ', 'g'), '[0-9A-Za-z_]*[^\\x00-\\x7F](?:[0-9A-Za-z_]|[^\\x00-\\x7F])*', chr(1) || chr(1), 'g') AS text FROM lines),
found AS (SELECT file, line, replace(unnest(regexp_extract_all(text, '(?:\\b[a-zA-Z_]|\\x01[$]|\\b[$])[a-zA-Z0-9_$-]*(?:\\b|\\x01)')), chr(1), '') AS identifier FROM marked),
kept AS (SELECT * FROM found WHERE strlen(identifier) > 1 AND identifier NOT IN {_in(KEYWORDS)}),
c AS (SELECT *, {convention('identifier')} AS convention FROM kept), p AS (SELECT *, {tags('identifier', 'convention')} AS tags FROM c)"""
_DOC_PARSED = f"{_DOC}, c AS (SELECT *, {convention('identifier')} AS convention FROM kept), p AS (SELECT *, {tags('identifier', 'convention')} AS tags FROM c)"

_EDGES = "e AS (SELECT tags[i] AS src, tags[i + 1] AS dst FROM (SELECT tags, unnest(range(1, len(tags))) AS i FROM p)), edges AS (SELECT src, dst, count(*) AS weight FROM e GROUP BY ALL)"
_NODES = "nodes AS (SELECT DISTINCT unnest(tags) AS tag FROM p)"
_SUB = f"{PARSED}, {_NODES}, {_EDGES}, near AS (SELECT * FROM edges WHERE src IN ('small', 'gear') OR dst IN ('small', 'gear')), kept AS (SELECT tag FROM nodes WHERE tag IN ('small', 'gear') UNION SELECT src FROM near UNION SELECT dst FROM near)"


#: rules of a project file that extends Java's preset and a team's file, and of a new Go project's file
RESOLVED_RULES = (("variable", "camelCase"), ("type", "Ada_Case"), ("constant", "UPPER_SNAKE_CASE"), ("parameter", "snake"), ("field", "kebab"))
GENERATED_RULES = (("function", "camelCase"), ("variable", "camelCase"), ("type", "PascalCase"), ("constant", "PascalCase"), ("parameter", "camelCase"))

#: (folder of files, context, convention as given, prefix, suffix) that the nearest configuration alone gives, and all above it merged
_RUST = (("function", "snake_case"), ("variable", "snake_case"), ("type", "PascalCase"), ("constant", "UPPER_SNAKE_CASE"))
_REPO = (*_RUST, ("field", "kebab"), ("import", "screaming"))
NEAREST_RULES = [("repo/lib", *r) for r in _REPO] + [("repo/src", "function", "PascalCase")] + [(f, "type", "Ada_Case") for f in ("repo/src/api", "repo/src/api/v2/deep")]
_SRC = tuple((c, "PascalCase" if c == "function" else v) for c, v in _REPO if c != "import")
_API = tuple((c, "Ada_Case" if c == "type" else v) for c, v in _SRC)
MERGED_RULES = [("repo/lib", *r) for r in _REPO] + [("repo/src", *r) for r in _SRC] + [(f, *r) for f in ("repo/src/api", "repo/src/api/v2/deep") for r in _API]
_PLACED_NAMES = "placed AS (SELECT * REPLACE (['repo/src/api', 'repo/src', 'repo/lib', 'elsewhere', 'repo/src/api/v2/deep'][CAST(line % 5 AS INT) + 1] || '/' || file AS file), ['repo/src/api', 'repo/src', 'repo/lib', 'elsewhere', 'repo/src/api/v2/deep'][CAST(line % 5 AS INT) + 1] AS own FROM p)"


def _lint_folders(rules):
    rows = ", ".join(f"('{f}', '{c}', '{v}', '{SPELLINGS[v]}')" for f, c, v in rules)
    return (
        f"{PARSED}, {_PLACED_NAMES}, r(own, context, expected, wanted) AS (VALUES {rows})"
        f" SELECT file, line, identifier, expected AS expected_convention, {joined('tags', 'wanted')} AS suggested_fix FROM placed JOIN r USING (own, context) WHERE convention <> wanted"
    )


#: merged rules of each folder, with the names that can't be spelled and with affixes
_MERGED_ROWS = [(f, c, v, None, None) for f, c, v in MERGED_RULES] + [(f, "import", "lowercase", None, None) for f in ("repo/src", "repo/src/api", "repo/src/api/v2/deep")]
_MERGED_ROWS = [(f, c, v, "do" if c == "function" and f != "repo/lib" else None, "Fn" if c == "function" and "api" in f else None) for f, c, v, _, _ in _MERGED_ROWS]
_HOME = {"repo/lib": "repo", "repo/src": "repo/src", "repo/src/api": "repo/src/api", "repo/src/api/v2/deep": "repo/src/api"}
_MERGED_VALUES = ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" for x in (f, _HOME[f], c, v, p, x_)) + ")" for f, c, v, p, x_ in _MERGED_ROWS)

#: every eleventh event comes two deliveries late; the watermark of a delivery's rows is known from those before the last one
_LATE = """WITH d AS (SELECT ts, event_type, least(least((day(ts) - 1) // 8, 3) + CASE WHEN event_id % 11 = 0 THEN 2 ELSE 0 END, 3) AS delivery FROM events),
m AS (SELECT delivery, max(ts) AS latest FROM d GROUP BY 1),
w AS (SELECT k.delivery, (SELECT max(latest) FROM m WHERE m.delivery < k.delivery - 1) - INTERVAL 36 HOUR AS mark FROM m k),
kept AS (SELECT date_trunc('hour', ts) AS start, unnest(string_split('on_' || event_type, '_')) AS tag FROM d JOIN w USING (delivery) WHERE mark IS NULL OR date_trunc('hour', ts) + INTERVAL 1 HOUR > mark)
SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS start, tag, count(*) AS n FROM kept WHERE tag <> '' AND start + INTERVAL 1 HOUR <= (SELECT max(latest) FROM m) - INTERVAL 36 HOUR GROUP BY ALL"""


def _rules(rules=PROJECT_RULES):
    rows = [(c, given, SPELLINGS[given]) for c, given in rules]
    return "r(context, expected, wanted) AS (VALUES " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in rows) + ")"


_FOUND = ", v AS (SELECT p.*, r.expected, r.wanted FROM p JOIN r USING (context) WHERE p.convention <> r.wanted)"
_LINT = f"{PARSED}, {_rules()}{_FOUND}"

_PROSE = f"""{PARSED}, w AS (SELECT *, role IS NOT NULL AND coalesce(tags[1] IN {_in(w for ws in ROLE_WORDS.values() for w in ws)}, false) AS has_word FROM p),
x AS (SELECT *, CASE WHEN has_word THEN tags[2:] ELSE tags END AS c0 FROM w),
y AS (SELECT *, CASE WHEN shape IS NOT NULL AND coalesce(c0[-1] IN {_in(w for ws in SHAPE_WORDS.values() for w in ws)}, false) THEN c0[:len(c0) - 1] ELSE c0 END AS core FROM x),
z AS (SELECT *, array_to_string(core, ' ') AS noun FROM y),
s AS (SELECT *, CASE shape WHEN 'array' THEN 'Array of ' || noun || 's' WHEN 'record' THEN noun || ' record' WHEN 'map' THEN noun || ' map' WHEN 'set' THEN noun || ' set' WHEN 'signal' THEN noun || ' signal' ELSE noun END AS n FROM z),
q AS (SELECT *, list_filter(string_split(n, ' '), lambda w: w <> '') AS ws FROM s)
SELECT file, line, identifier, CASE role WHEN 'factory' THEN 'Creates a ' || n WHEN 'hook' THEN 'Uses ' || n WHEN 'setter' THEN 'Sets ' || n WHEN 'getter' THEN 'Gets ' || n
  WHEN 'predicate' THEN 'Checks if ' || CASE WHEN len(ws) > 1 AND has_word THEN ws[-1] || ' ' || tags[1] || ' ' || array_to_string(ws[:len(ws) - 1], ' ') ELSE n END
  WHEN 'handler' THEN 'Handles ' || n WHEN 'validator' THEN 'Validates ' || n ELSE CASE WHEN starts_with(n, 'Array of ') THEN n ELSE upper(n[1]) || n[2:] END END AS prose FROM q"""

_GIVEN = "[" + ", ".join(f"'{s}'" for s in ("snake", "camelCase", "kebab", "screaming", "ada", "title")) + "][CAST(line % 6 AS INT) + 1]"
_FORCED = f"""WITH {NAMES}, g AS (SELECT *, {_GIVEN} AS given FROM names),
c AS (SELECT *, coalesce(CASE given {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in SPELLINGS.items())} END, {convention('identifier')}) AS convention FROM g)
SELECT file, line, identifier, given, convention, array_to_string({tags('identifier', 'convention')}, ' ') AS tags FROM c"""

_TARGETS = "(VALUES " + ", ".join(f"('{c}')" for c in CONVENTIONS) + ") v(target)"

_PATHS = (
    "paths AS (SELECT p_partkey, 'repo/' || CASE p_partkey % 6 WHEN 0 THEN 'src' WHEN 1 THEN 'node_modules/lib' WHEN 2 THEN '.hidden' WHEN 3 THEN '_pkg' WHEN 4 THEN 'a/target' ELSE 'b' END || '/'"
    f" || {_SNAKE} || '_' || p_partkey || CASE p_partkey % 5 WHEN 0 THEN '.py' WHEN 1 THEN '.kts' WHEN 2 THEN '.md' WHEN 3 THEN '.rs' ELSE '.d.ts' END AS path FROM part)"
)
_EXT = "regexp_extract(path, '\\.([^./]*)$', 1)"

#: content and size of the files of the written tree
_TREE = (
    f"t AS (SELECT path, p_partkey, 'class ' || {_P} || chr(10) || 'self ' || {_SNAKE} || ' value1 = get' || {_P} || chr(10) AS content FROM paths JOIN part USING (p_partkey)"
    f" WHERE NOT regexp_matches(path, '(^|/)({'|'.join(SKIP_DIRS)}|[.][^/]+)/') AND {_EXT} IN {_in(SOURCE_EXTENSIONS)})"
)

#: what syntax mode finds in the derived source files: (remainder of the key, line, column, name, context, language)
_SYNTAX = [
    (0, 1, 8, "s", "import", "python"), (0, 2, 7, "P", "type", "python"), (0, 3, 9, "s", "function", "python"), (0, 3, "s_len + 16", "'count'", "parameter", "python"), (0, 4, 9, "'value'", "variable", "python"),
    (1, 2, "P_len + 8", "P", "import", "rust"), (1, 3, 12, "P", "type", "rust"), (1, 3, "P_len + 15", "'size'", "field", "rust"), (1, 4, 4, "s", "function", "rust"), (1, 4, "s_len + 5", "'total'", "parameter", "rust"),
    (1, 4, "s_len + 23", "'value'", "variable", "rust"),
    (2, 2, 7, "P", "type", "javascript"), (2, 3, 10, "c", "function", "javascript"), (2, 3, "c_len + 11", "'first'", "parameter", "javascript"), (2, 4, 10, "s", "import", "javascript"),
    (3, 1, 6, "P", "type", "go"), (3, 2, 6, "c", "function", "go"), (3, 2, "c_len + 7", "'total'", "parameter", "go"), (3, 3, 7, "s", "constant", "go"), (3, 4, 8, "s", "import", "go"),
    (5, 1, 1, "s || '.h'", "import", "c"), (5, 2, 5, "s", "function", "c"), (5, 2, "s_len + 10", "'total'", "parameter", "c"), (5, 3, 7, "'value'", "variable", "c"), (5, 5, 8, "P", "type", "c"), (5, 5, "P_len + 15", "'size'", "field", "c"),
    (6, 2, 7, "s", "field", "cpp"), (6, 4, "P_len + 7", "c", "function", "cpp"), (6, 4, "P_len + c_len + 12", "'total'", "parameter", "cpp"),
    (7, 1, 1, "P", "import", "java"), (7, 2, 7, "P", "type", "java"), (7, 3, 7, "c", "field", "java"), (7, 3, 7, "c", "variable", "java"), (7, 4, 8, "'run'", "function", "java"), (7, 4, 19, "'given'", "parameter", "java"),
    (7, 4, 32, "'total'", "variable", "java"),
    (8, 1, 1, "s", "import", "ruby"), (8, 2, 7, "P", "type", "ruby"), (8, 3, 7, "s", "function", "ruby"), (8, 3, "s_len + 8", "'count'", "parameter", "ruby"), (8, 4, 5, "'total'", "variable", "ruby"),
    (9, 2, 5, "P", "import", "php"), (9, 3, 7, "P", "type", "php"), (9, 4, 11, "'size'", "field", "php"), (9, 5, 12, "c", "function", "php"), (9, 5, "c_len + 13", "'count'", "parameter", "php"),
    (10, 1, 1, "P", "import", "csharp"), (10, 2, 7, "P", "type", "csharp"), (10, 3, 15, "c", "field", "csharp"), (10, 3, 15, "c", "variable", "csharp"), (10, 4, 8, "'Run'", "function", "csharp"), (10, 4, 19, "'given'", "parameter", "csharp"),
    (11, 1, 1, "P", "import", "swift"), (11, 2, 7, "P", "type", "swift"), (11, 3, 7, "c", "constant", "swift"), (11, 4, 8, "'run'", "function", "swift"), (11, 4, 12, "'total'", "parameter", "swift"),
    (12, 1, 1, "P", "import", "kotlin"), (12, 2, 7, "P", "type", "kotlin"), (12, 3, 7, "c", "variable", "kotlin"), (12, 4, 7, "'run'", "function", "kotlin"), (12, 4, 11, "'total'", "parameter", "kotlin"),
    (13, 1, 10, "c", "import", "typescript"), (13, 2, 7, "P", "type", "typescript"), (13, 3, 10, "'run'", "function", "typescript"), (13, 3, 14, "'total'", "parameter", "typescript"),
    (14, 1, 7, "c", "variable", "tsx"), (14, 2, 7, "P", "type", "tsx"),
]
_SOURCES = f"src AS (SELECT p_partkey, {_P} AS P, {_SNAKE} AS s, 'get' || {_P} AS c, replace(p_name, ' ', '-') AS k FROM part), m AS (SELECT *, strlen(s) AS s_len, strlen(c) AS c_len, strlen(P) AS P_len FROM src)"
_SYNTAX_SQL = " UNION ALL ".join(
    f"SELECT 'part_' || p_partkey AS file, {line} AS line, CAST({column} AS INT) AS column_, {name} AS identifier, '{context}' AS context, '{language}' AS language FROM m WHERE p_partkey % 15 = {k}"
    for k, line, column, name, context, language in _SYNTAX
).replace("column_", '"column"')
_TEXT_SQL = (
    "SELECT 'part_' || p_partkey, 1, 2, k, NULL, NULL FROM m WHERE p_partkey % 15 = 4 UNION ALL SELECT 'part_' || p_partkey, 1, CAST(strlen(k) + 5 AS INT), 'color', NULL, NULL FROM m WHERE p_partkey % 15 = 4"
    " UNION ALL SELECT 'part_' || p_partkey, 1, CAST(strlen(k) + 12 AS INT), 'red', NULL, NULL FROM m WHERE p_partkey % 15 = 4"
)

#: what syntax mode finds in the nested source files, by reading the grammars' node kinds: context -> line:column and name in the text with its marks
NESTED = {
    "rs": {
        "constant": "5:111 INNER_MAX ; 5:144 COUNTER",
        "field": "8:34 first_key ; 8:48 second_map ; 8:86 third_one ; 9:32 reason_code ; 14:34 pos_x ; 14:54 pos_y",
        "function": "3:60 name_of ; 5:12 Qs ; 12:4 Qs ; 13:4 closures ; 15:4 builds",
        "import": "1:26 Write} ; 2:18 b as other",
        "parameter": "3:34 scale_by ; 5:22 key_one ; 5:38 (px, py) ; 5:64 total_sum ; 13:45 acc_sum ; 13:59 (aa, bb) ; 13:115 one_item ; 13:141 three_of ; 15:11 bit_a",
        "type": "6:10 Item ; 8:19 QP ; 9:6 State ; 14:6 Msg",
        "variable": "3:91 (left, right) ; 3:123 count_it ; 5:166 Some(found_it) ; 12:15 text_value ; 13:21 add_up ; 13:99 keep_it ; 15:37 or_ed",
    },
    "java": {
        "constant": "17:52 LIMIT_ONE",
        "field": "5:53 cacheMap ; 6:9 ab ; 7:11 arrayField ; 17:23 inner ; 18:42 shade",
        "function": "8:34 Qc ; 12:52 run ; 16:5 Outer ; 17:87 doIt ; 18:53 shadeOf",
        "import": "2:1 Entry",
        "parameter": "8:58 mapper ; 16:15 startSize ; 17:96 howMany ; 19:22 posX ; 19:32 posY",
        "type": "4:14 Outer ; 17:11 QP ; 17:40 Deep ; 18:10 Color ; 19:12 Point",
        "variable": "8:76 restArgs ; 5:53 cacheMap ; 5:81 secondMap ; 6:9 ab ; 6:17 cd ; 7:11 arrayField ; 9:18 idx ; 9:60 innerText ; 12:18 rr ; 12:64 deepest ; 13:13 first ; 17:23 inner ; 17:52 LIMIT_ONE ; 17:67 LIMIT_TWO ; 18:42 shade",
    },
    "c": {
        "field": "4:27 value_of ; 4:49 *next_node",
        "function": "10:12 proto_call ; 11:6 pointer_fn ; 12:12 Qs",
        "import": "1:1 my dir/file.h",
        "parameter": "10:27 first_arg ; 10:43 *second_arg ; 10:63 third_arr[3] ; 12:27 *list_head ; 12:43 n_items",
        "type": "4:16 node ; 4:44 node ; 4:63 node_t ; 5:23 byte_t ; 6:9 node_t ; 7:6 color_kind ; 12:22 node",
        "variable": "9:5 global_count ; 11:6 pointer_fn ; 13:19 total_sum ; 14:23 list_head ; 15:9 grid ; 16:14 step_i ; 16:57 inner_val",
    },
    "cpp": {
        "field": "9:32 table_of ; 10:22 kLimit ; 12:9 size_ ; 12:25 *raw_buf ; 14:24 px_",
        "function": "5:5 QP ; 6:14 QP ; 16:18 Qs ; 17:17 resize",
        "import": "1:1 map",
        "parameter": "5:12 width_px ; 6:35 &label_text ; 16:44 &input_list ; 16:61 count_of ; 17:28 new_width",
        "type": "14:8 Point3 ; 15:12 Mode",
        "variable": "6:74 init_count ; 16:90 result_list ; 16:108 it_first ; 17:53 tmp_name",
    },
    "js": {
        "function": "3:71 constructor ; 3:117 loadAll ; 3:187 total ; 4:23 Qc ; 6:15 method ; 7:15 run",
        "import": "1:15 alpha ; 1:30 gamma",
        "parameter": "3:83 first ; 3:125 page ; 4:26 name ; 5:18 event ; 6:22 arg ; 6:65 param ; 7:19 x1",
        "type": "3:22 QP ; 7:7 Inner",
        "variable": "3:149 { aa, bb } ; 3:168 [cc] ; 4:47 xx ; 4:55 yy ; 4:71 zz ; 4:84 ii ; 5:7 handler ; 5:39 inner ; 6:7 obj",
    },
    "ts": {
        "function": "4:67 run ; 5:83 constructor ; 5:137 find ; 6:10 Qc",
        "import": "1:15 TypeA ; 2:10 fnB ; 2:20 TypeC",
        "parameter": "3:45 value ; 4:43 scale ; 5:103 store ; 5:124 size ; 5:145 key ; 5:153 ...rest ; 6:13 { left, right } ; 6:36 optional ; 7:29 input ; 7:44 done",
        "type": "5:7 QP",
        "variable": "5:195 found ; 7:14 arrow ; 7:84 out",
    },
    "go": {
        "constant": "9:9 maxSize ; 9:22 minSize ; 10:7 single",
        "function": "13:20 QP ; 20:6 Generic",
        "import": "3:5 fmt ; 4:5 http ; 6:8 ioutil",
        "parameter": "8:44 req ; 13:7 srv ; 13:23 ctx ; 13:44 aa ; 13:56 opts ; 13:73 result ; 13:85 err ; 17:13 job ; 20:21 value",
        "type": "7:6 Server ; 8:21 Handler",
        "variable": "11:5 globalOne ; 12:7 cacheMap ; 14:5 Qs ; 15:8 val ; 15:39 inner",
    },
    "rb": {
        "constant": "5:5 MAX_SIZE",
        "field": "9:7 cache ; 18:7 name",
        "function": "8:14 Qs ; 13:9 plain ; 16:9 valid? ; 17:9 name=",
        "import": "1:1 http ; 2:1 helper",
        "parameter": "8:17 first_arg ; 8:28 second ; 8:47 key ; 8:55 needed ; 13:15 arg_one ; 13:24 opt ; 17:15 val",
        "type": "3:8 Outer::Inner ; 4:9 QP",
        "variable": "6:5 Other2 ; 9:16 other ; 11:26 total",
    },
    "php": {
        "constant": "7:11 MAX_ONE ; 7:24 MAX_TWO",
        "field": "8:19 shared ; 8:37 second ; 9:21 label ; 15:21 x",
        "function": "10:21 __construct ; 11:33 doIt ; 14:10 Qc ; 15:34 one_of",
        "import": "3:5 Model ; 3:21 Other as Alias ; 4:14 helper",
        "parameter": "10:45 age ; 10:58 name ; 10:80 rest ; 11:42 howMany ; 14:14 ref ; 14:20 plain ; 14:46 inner ; 14:84 zz ; 15:45 zed",
        "type": "5:16 QP ; 13:7 Sharing ; 15:7 Tiny",
        "variable": "10:96 calls ; 10:108 more ; 15:60 k",
    },
    "cs": {
        "field": "6:46 mapOf ; 7:19 Name ; 8:16 Size ; 15:30 PosX ; 18:53 Title",
        "function": "10:12 QP ; 11:32 Qc ; 12:9 Local ; 12:23 Inner ; 18:27 DoIt",
        "import": "1:1 System ; 2:1 Math ; 3:1 Generic",
        "parameter": "10:19 startSize ; 11:40 keyOne ; 11:64 rest ; 12:33 deep ; 14:39 sender ; 16:24 FirstName ; 18:36 howMany",
        "type": "5:16 QP ; 14:24 Handler ; 15:10 Vec ; 16:10 Person ; 17:8 Kind ; 18:13 IThing",
        "variable": "6:46 mapOf ; 9:31 Changed ; 10:54 local ; 11:92 first ; 11:124 idx ; 15:30 PosX",
    },
    "swift": {
        "constant": "4:9 maxSize ; 8:78 (aa, bb) ; 12:24 open ; 13:19 custom",
        "function": "7:5 init ; 8:10 Qc ; 14:21 extra",
        "import": "1:1 Foundation ; 2:1 UIView",
        "parameter": "7:15 name ; 7:29 count ; 8:18 item ; 8:30 index ; 11:28 scale",
        "type": "3:14 QP ; 11:10 Shape ; 12:6 State ; 14:11 QP ; 15:8 Pt",
        "variable": "5:17 hidden ; 6:16 shared ; 7:51 inner ; 9:9 computed ; 15:17 px",
    },
    "kt": {
        "constant": "6:9 MAX_ONE ; 14:34 RED ; 14:42 GREEN",
        "function": "11:37 Qc ; 14:56 shade ; 15:23 area ; 18:5 topLevel",
        "import": "2:1 List ; 4:1 max as bigger",
        "parameter": "5:25 userName ; 5:55 age ; 5:69 extra ; 11:40 item ; 11:56 rest ; 14:22 rgb ; 14:62 by ; 15:28 scale ; 18:14 block ; 18:36 name",
        "type": "5:18 QP ; 14:12 Color ; 15:11 Shape ; 16:8 Single ; 17:11 Names",
        "variable": "7:17 HIDDEN_ONE ; 8:15 TOP_ONE ; 9:9 counter ; 11:82 local ; 12:28 inner",
    },
    "py": {
        "function": "11:15 Qs ; 14:13 inner_fn",
        "import": "2:24 sys.path ; 3:20 helper_one ; 4:34 sibling_mod ; 5:6 typing ; 6:6 mod_name",
        "parameter": "11:24 first_arg ; 11:57 key_only ; 14:29 typed_one",
        "type": "9:7 QP",
        "variable": "10:5 attr_one ; 12:9 left_side ; 12:21 right_side",
    },
}


def _nested_sql():
    rows = []
    for k, (ext, found) in enumerate(NESTED.items()):
        lines = samples.NESTED[ext].split("\n")
        for context, places in found.items():
            for place in places.split(" ; "):
                at, name = place.split(" ", 1)
                line, column = map(int, at.split(":"))
                head = lines[line - 1].encode()[: column - 1].decode()
                rows.append(f"({k}, {line}, {column}, {head.count('Qs')}, {head.count('Qc')}, {head.count('QP')}, '{name}', '{context}', '{LANGUAGES[ext]}')")
    name = "replace(replace(replace(name, 'Qs', s), 'Qc', c), 'QP', P)"
    return (
        f"WITH {_SOURCES}, e(which, line, col, ns, nc, np, name, context, language) AS (VALUES {', '.join(rows)}) SELECT 'nested_' || p_partkey AS file, line,"
        f' CAST(col + ns * (s_len - 2) + nc * (c_len - 2) + np * (P_len - 2) AS INT) AS "column", {name} AS identifier, context, language FROM m JOIN e ON p_partkey % {len(NESTED)} = which'
    )


ORACLE_SQL = {
    "detect_convention": _key("convention"),
    "parse_tags": _key("array_to_string(tags, ' ') AS tags"),
    "canonical_key": _key("array_to_string(tags, '_') AS canonical"),
    "namespaces": _key(
        "CASE WHEN convention IN ('snake_case', 'UPPER_SNAKE_CASE', 'Ada_Case') AND contains(identifier, '__') THEN array_to_string(list_transform(string_split(identifier, '__'),"
        " lambda d: array_to_string(list_filter(string_split(lower(d), '_'), lambda t: t <> ''), ' ')), '|') ELSE '' END AS namespaces"
    ),
    "detect_role": _key("role"),
    "detect_shape": _key("shape"),
    "forced_convention": _FORCED,
    "alias_all_long": f"{PARSED} SELECT file, line, identifier, target, {joined('tags', 'target')} AS alias FROM p, {_TARGETS}",
    "alias_map": _key("array_to_string([" + ", ".join(f"'{c}=' || ({joined('tags', repr(c))})" for c in sorted(CONVENTIONS)) + "], ' ') AS aliases"),
    "prose": _PROSE,
    "sql_surface": _key(f"convention, {joined('tags', repr('Ada_Case'))} AS rendered, role"),
    "equivalence_groups": f"{PARSED} SELECT array_to_string(tags, '_') AS canonical, count(DISTINCT identifier) AS spellings, count(*) AS n FROM p GROUP BY 1",
    "extract_lines": f"{_DOC} SELECT file, CAST(line AS INT) AS line, text FROM lines",
    "extract_identifiers": f"{_DOC_PARSED} SELECT file, CAST(line AS INT) AS line, identifier, convention, array_to_string(tags, ' ') AS tags FROM p",
    "extract_columns": f"{_DOC}, {_PLACED.format(run=_RUN, plain=_PLAIN)}"
    f' SELECT file, CAST(line AS INT) AS line, CAST("column" AS INT) AS "column", identifier FROM placed WHERE strlen(identifier) > 1 AND identifier NOT IN {_in(KEYWORDS)}',
    "extract_kebab": f"{_HTML} SELECT file, CAST(line AS INT) AS line, identifier, array_to_string(tags, ' ') AS tags FROM p",
    "graph_kebab_pages": f"{_HTML}, {_EDGES} SELECT src, dst, weight FROM edges",
    "scan_tree": f"""WITH {_PATHS}, t AS (SELECT path AS file, {_P} AS P, {_SNAKE} AS s FROM paths JOIN part USING (p_partkey) WHERE NOT regexp_matches(path, '(^|/)({'|'.join(SKIP_DIRS)}|[.][^/]+)/') AND {_EXT} IN {_in(SOURCE_EXTENSIONS)})
SELECT file, 1 AS line, 7 AS "column", P AS identifier FROM t UNION ALL SELECT file, 2, 6, s FROM t
UNION ALL SELECT file, 2, CAST(strlen(s) + 7 AS INT), 'value1' FROM t UNION ALL SELECT file, 2, CAST(strlen(s) + 16 AS INT), 'get' || P FROM t""",
    "stream_tree": f"""WITH {_PATHS}, t AS (SELECT path AS file, {_P} AS P, {_SNAKE} AS s FROM paths JOIN part USING (p_partkey) WHERE NOT regexp_matches(path, '(^|/)({'|'.join(SKIP_DIRS)}|[.][^/]+)/') AND {_EXT} IN {_in(SOURCE_EXTENSIONS)})
SELECT file, 1 AS line, 7 AS "column", P AS identifier FROM t UNION ALL SELECT file, 2, 6, s FROM t
UNION ALL SELECT file, 2, CAST(strlen(s) + 7 AS INT), 'value1' FROM t UNION ALL SELECT file, 2, CAST(strlen(s) + 16 AS INT), 'get' || P FROM t""",
    "scan_guards": f"WITH {_PATHS}, {_TREE} SELECT path, CASE WHEN p_partkey % 400 = 8 THEN 1048576 ELSE strlen(content) END AS size FROM t WHERE p_partkey % 13 <> 0 AND p_partkey % 400 <> 7",
    "scan_filtered": f"WITH {_PATHS}, {_TREE} SELECT path, strlen(content) AS size FROM t WHERE starts_with(path, 'repo/src') AND {_EXT} IN ('py', 'rs') AND strlen(content) > 50",
    "sql_table_function": f"{_DOC_PARSED} SELECT file, CAST(line AS INT) AS line, identifier, convention, array_to_string(tags, ' ') AS tags FROM p",
    "sql_renderings": f"{PARSED} SELECT file, line, identifier, target, {joined('tags', 'target')} AS alias FROM p, {_TARGETS}",
    "keyword_filter": f"{_DOC} SELECT identifier, count(*) AS n FROM found WHERE strlen(identifier) <= 1 OR identifier IN {_in(KEYWORDS)} GROUP BY 1",
    "identifier_counts": f"{_DOC_PARSED} SELECT identifier, array_to_string(tags, '_') AS canonical, count(*) AS n FROM p GROUP BY 1, 2",
    "search_documents": f"{_DOC_PARSED} SELECT file, CAST(line AS INT) AS line, identifier FROM p WHERE list_contains(tags, 'with')",
    "search_single": f"{PARSED} SELECT file, line, identifier, convention FROM p WHERE list_contains(tags, 'gear')",
    "search_and": f"{PARSED} SELECT file, line, identifier, convention FROM p WHERE list_has_all(tags, ['gear', 'small'])",
    "search_empty": f"{PARSED} SELECT file, line, identifier, convention FROM p",
    "search_ordered": f"{PARSED} SELECT file, line, identifier, convention FROM p WHERE '/' || array_to_string(tags, '//') || '/' LIKE '%/small/%/gear/%'",
    "search_sorted": f"{PARSED} SELECT file, row_number() OVER (PARTITION BY file ORDER BY line) AS place, line, identifier FROM p WHERE list_has_all(tags, ['gear', 'small'])",
    "search_many_ordered": f"{PARSED}, q AS (SELECT DISTINCT w[1] || '_' || w[-1] AS query, w[1] AS a, w[-1] AS b FROM (SELECT string_split(p_name, ' ') AS w FROM part)) SELECT query, file, line, identifier FROM p, q WHERE list_contains(tags, a) AND list_contains(tags[list_position(tags, a) + 1:], b)",
    "search_many": f"{PARSED}, q AS (SELECT DISTINCT replace(p_name, ' ', '-') AS query, string_split(p_name, ' ') AS need FROM part) SELECT query, file, line, identifier FROM p, q WHERE list_has_all(tags, need)",
    "graph_nodes": f"{PARSED}, {_NODES} SELECT tag FROM nodes",
    "graph_edges": f"{PARSED}, {_EDGES} SELECT src, dst, weight FROM edges",
    "graph_dot_lines": f"{PARSED}, {_EDGES} SELECT chr(9) || '\"' || src || '\" -> \"' || dst || '\" [label=\"' || weight || '\"];' AS dot FROM edges",
    "graph_json_nodes": f"{PARSED}, {_NODES}, {_EDGES} SELECT tag, CAST(to_json(tag) AS VARCHAR) AS json, tag NOT IN (SELECT src FROM edges UNION SELECT dst FROM edges) AS isolated FROM nodes",
    "graph_subgraph_nodes": f"{_SUB} SELECT tag FROM kept",
    "graph_subgraph_edges": f"{_SUB} SELECT src, dst, weight FROM edges WHERE src IN (SELECT tag FROM kept) AND dst IN (SELECT tag FROM kept)",
    "lint_violations": f"{_LINT} SELECT file, line, identifier, expected AS expected_convention, convention AS actual_convention FROM v",
    "lint_resolved_config": f"{PARSED}, {_rules(RESOLVED_RULES)}{_FOUND} SELECT file, line, identifier, expected AS expected_convention, {joined('tags', 'wanted')} AS suggested_fix FROM v",
    "lint_nearest_config": _lint_folders(NEAREST_RULES),
    "lint_merged_config": _lint_folders(MERGED_RULES),
    "merged_context_rules": f"{PARSED}, {_PLACED_NAMES}, r(own, folder, context, convention, prefix, suffix) AS (VALUES {_MERGED_VALUES}) SELECT own, folder, context, r.convention, prefix, suffix, count(*) AS n FROM placed JOIN r USING (own, context) GROUP BY ALL",
    "lint_generated_config": f"{PARSED}, {_rules(GENERATED_RULES)}{_FOUND} SELECT file, line, identifier, expected AS expected_convention, {joined('tags', 'wanted')} AS suggested_fix FROM v",
    "graph_json_edges": f"{PARSED}, {_EDGES} SELECT CAST(to_json({{'from': src, 'to': dst, 'weight': weight}}) AS VARCHAR) AS json FROM edges",
    "lint_suggested_fix": f"{_LINT} SELECT file, line, identifier, {joined('tags', 'wanted')} AS suggested_fix FROM v",
    "lint_lines": f"{_LINT} SELECT file || ':' || line || ':1 warning: ' || CASE expected WHEN 'PascalCase' THEN 'type' WHEN 'UPPER_SNAKE_CASE' THEN 'constant' ELSE 'identifier' END"
    f" || ' `' || identifier || '` should be ' || expected || ' → `' || {joined('tags', 'wanted')} || '`' AS text FROM v",
    "preset_violations": f"{PARSED}, r(preset, context, wanted) AS (VALUES {', '.join(f'({a!r}, {b!r}, {c!r})' for a, b, c, *_ in presets.preset_rows())})"
    " SELECT preset, context, wanted, count(*) AS violations FROM p JOIN r USING (context) WHERE convention <> wanted GROUP BY ALL",
    "source_prune": f"WITH {_PATHS} SELECT p_partkey, path FROM paths WHERE NOT regexp_matches(path, '(^|/)({'|'.join(SKIP_DIRS)}|[.][^/]+)/') AND {_EXT} IN {_in(SOURCE_EXTENSIONS)}",
    "detect_language": f"WITH {_PATHS} SELECT p_partkey, {_EXT} AS ext, CASE {_EXT} {' '.join(f'WHEN {a!r} THEN {b!r}' for a, b in LANGUAGES.items())} END AS language FROM paths",
    "classify_contexts": f'WITH {_SOURCES} SELECT file, line, "column", identifier, context, language FROM ({_SYNTAX_SQL})',
    "classify_nested": _nested_sql(),
    "extract_with_context": f'WITH {_SOURCES} SELECT file, line, "column", identifier, context, {convention("identifier")} AS convention FROM ({_SYNTAX_SQL} UNION ALL {_TEXT_SQL})',
    "lint_sources": f'WITH {_SOURCES}, f AS ({_SYNTAX_SQL}), c AS (SELECT *, {convention("identifier")} AS convention FROM f), p AS (SELECT *, {tags("identifier", "convention")} AS tags FROM c), {_rules()}'
    f' SELECT file, line, "column", identifier, expected AS expected_convention, convention AS actual_convention, {joined("tags", "wanted")} AS suggested_fix FROM p JOIN r USING (context) WHERE convention <> wanted',
    "parsed_json": f"{PARSED} SELECT file, line, identifier, CAST(to_json({{'original': identifier, 'convention': CASE convention WHEN 'camelCase' THEN 'camel_case' WHEN 'PascalCase' THEN 'pascal_case' WHEN 'kebab-case' THEN 'kebab_case'"
    " WHEN 'UPPER_SNAKE_CASE' THEN 'upper_snake_case' WHEN 'Ada_Case' THEN 'ada_case' ELSE convention END, 'tags': tags, 'namespaces': CASE WHEN convention IN ('snake_case', 'UPPER_SNAKE_CASE', 'Ada_Case') AND contains(identifier, '__')"
    " THEN list_transform(string_split(identifier, '__'), lambda d: list_filter(string_split(lower(d), '_'), lambda t: t <> '')) ELSE [] END, 'role': role, 'shape': shape}) AS VARCHAR) AS json FROM p",
    "extract_text_lines": f"{PARSED} SELECT file || ':' || line || chr(9) || identifier || chr(9) || '[' || array_to_string(tags, ', ') || ']' || chr(9) || CASE convention WHEN 'snake_case' THEN 'SnakeCase' WHEN 'camelCase' THEN 'CamelCase'"
    " WHEN 'PascalCase' THEN 'PascalCase' WHEN 'kebab-case' THEN 'KebabCase' WHEN 'UPPER_SNAKE_CASE' THEN 'UpperSnakeCase' ELSE 'AdaCase' END || chr(9) || 'ctx:' || coalesce(context, 'none') || chr(9)"
    " || 'role:' || coalesce(role, 'none') || chr(9) || 'shape:' || coalesce(shape, 'none') AS text FROM p",
    "stream_parse": f"SELECT p_partkey, {_SNAKE} AS identifier, p_name AS tags FROM part",
    "stream_graph_edges": "WITH p AS (SELECT string_split(p_name, ' ') AS tags FROM part), " + _EDGES + " SELECT src, dst, weight FROM edges",
    "stream_late_tags": _LATE,
    "stream_windowed_tags": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, tag, count(*) AS n FROM (SELECT ts, unnest(string_split('on_' || event_type, '_')) AS tag FROM events) WHERE tag <> '' GROUP BY ALL",
} | {f"join_{short}": _key(f"{joined('tags', repr(conv))} AS rendered") for short, conv in (("snake", "snake_case"), ("camel", "camelCase"), ("pascal", "PascalCase"), ("kebab", "kebab-case"), ("upper", "UPPER_SNAKE_CASE"), ("ada", "Ada_Case"))}
