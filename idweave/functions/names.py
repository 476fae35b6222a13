"""Identifier functions as SQL expressions that Catalyst inlines: no Python runs on executors.

Every function takes SQL text (a column name or an expression) and returns SQL text; ``col``
turns it into a Column, and ``sql_functions.register`` makes SQL functions of the same text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The six conventions in their display spelling (fixed values).
CONVENTIONS = ("snake_case", "camelCase", "PascalCase", "kebab-case", "UPPER_SNAKE_CASE", "Ada_Case")

#: Spellings that name a convention (fixed values).
SPELLINGS = {
    "snake_case": "snake_case", "snake": "snake_case",
    "camelCase": "camelCase", "camel": "camelCase",
    "PascalCase": "PascalCase", "pascal": "PascalCase",
    "kebab-case": "kebab-case", "kebab": "kebab-case",
    "UPPER_SNAKE_CASE": "UPPER_SNAKE_CASE", "upper_snake": "UPPER_SNAKE_CASE", "screaming": "UPPER_SNAKE_CASE",
    "Ada_Case": "Ada_Case", "ada": "Ada_Case",
}

#: First words and the role they give; the last group gives it as a last word too (fixed values).
ROLE_WORDS = {
    "factory": ("create", "make", "new", "build"),
    "hook": ("use",),
    "setter": ("set",),
    "getter": ("get",),
    "predicate": ("is", "has", "can", "should"),
    "handler": ("on",),
    "validator": ("validate", "check", "verify"),
}

#: Last words and the shape they give (fixed values).
SHAPE_WORDS = {"array": ("a", "a1", "a2", "a3", "list", "array"), "record": ("r", "record"), "map": ("m", "map"), "set": ("set",)}

#: Places where a name is cut besides its separators: before a capital that starts a word.  A word of one character
#: before such a capital stays with it, unless it takes more than one byte (last case of the second pattern).
WORD_START = r"(?<=[a-z])(?=[A-Z])|(?<=[^a-z_][^a-z_])(?=[A-Z][a-z])|(?<=[a-z][^a-zA-Z_])(?=[A-Z][a-z])"
_LOWER, _UPPER = r"\p{IsLowercase}", r"\p{IsUppercase}"
WIDE_WORD_START = (
    rf"(?<=[{_LOWER}])(?=[{_UPPER}])|(?<=[^{_LOWER}_][^{_LOWER}_])(?=[{_UPPER}][{_LOWER}])"
    rf"|(?<=[{_LOWER}][^{_LOWER}{_UPPER}_])(?=[{_UPPER}][{_LOWER}])|(?<=[^{_LOWER}\x00-\x7F])(?=[{_UPPER}][{_LOWER}])"
)


def col(sql: str) -> Column:
    return F.expr(sql)


def text(value: str | None) -> str:
    """SQL literal of a string."""
    return "CAST(NULL AS STRING)" if value is None else "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _in(words) -> str:
    return "(" + ", ".join(map(text, words)) + ")"


def parse_convention(spelling: str) -> str | None:
    """The convention that a spelling names, None if it names none."""
    return SPELLINGS.get(spelling)


def convention_of_spelling(s: str) -> str:
    """SQL: the convention that a spelling names, NULL if it names none."""
    return "CASE " + s + " " + " ".join(f"WHEN {text(k)} THEN {text(v)}" for k, v in SPELLINGS.items()) + " END"


def convention(n: str) -> str:
    """SQL: the convention that a name is written in; the first of these tests that holds."""
    capital = r"r'^\p{IsUppercase}'"
    # a word that begins with anything but a capital
    other = r"r'(?:^|_)[^_\p{IsUppercase}]'"
    return (
        f"CASE WHEN contains({n}, '_') THEN CASE"
        f" WHEN {n} = upper({n}) THEN 'UPPER_SNAKE_CASE'"
        f" WHEN NOT {n} RLIKE {other} THEN 'Ada_Case' ELSE 'snake_case' END"
        f" WHEN contains({n}, '-') THEN 'kebab-case' WHEN {n} RLIKE {capital} THEN 'PascalCase' WHEN {n} IS NOT NULL THEN 'camelCase' END"
    )


def tags(n: str, conv: str) -> str:
    """SQL: the name's lower-case words in order."""
    # most names have no capital after their first letter: nothing to look for in them
    plain = f"octet_length({n}) = char_length({n})"
    cut = (
        f"CASE WHEN {plain} AND substring({n}, 2) = lower(substring({n}, 2)) THEN lower({n})"
        f" WHEN {plain} THEN lower(regexp_replace({n}, r'{WORD_START}', '_')) ELSE lower(regexp_replace({n}, r'{WIDE_WORD_START}', '_')) END"
    )
    # no lambda: Spark compiles array_remove, but interprets a filter with all that it is applied to
    return f"CASE WHEN {conv} = 'kebab-case' THEN array_remove(split(lower({n}), '-'), '') ELSE array_remove(split({cut}, '_'), '') END"


def namespaces(n: str, conv: str) -> str:
    """SQL: the dimensions between double underscores, each a list of words; empty without any."""
    return (
        f"CASE WHEN {conv} IN ('snake_case', 'UPPER_SNAKE_CASE', 'Ada_Case') AND contains({n}, '__')"
        f" THEN transform(split({n}, '__'), d -> filter(split(lower(d), '_'), t -> t <> ''))"
        f" ELSE CAST(array() AS ARRAY<ARRAY<STRING>>) END"
    )


def role(t: str) -> str:
    """SQL: the role that the first tag, or a validator's last one, gives."""
    first, last = f"try_element_at({t}, 1)", f"try_element_at({t}, -1)"
    cases = " ".join(f"WHEN {first} IN {_in(words)} THEN '{name}'" for name, words in ROLE_WORDS.items())
    return f"CASE {cases} WHEN {last} IN {_in(ROLE_WORDS['validator'])} THEN 'validator' END"


def shape(t: str) -> str:
    """SQL: the shape that the last tag gives; a setter's own ``set`` gives none."""
    first, last = f"try_element_at({t}, 1)", f"try_element_at({t}, -1)"
    cases = " ".join(f"WHEN {last} IN {_in(words)} THEN '{name}'" for name, words in SHAPE_WORDS.items() if name != "set")
    return f"CASE {cases} WHEN {last} = 'set' THEN IF(size({t}) > 1 AND {first} = 'set', NULL, 'set') WHEN endswith({last}, '$') THEN 'signal' END"


def canonical(t: str) -> str:
    """SQL: the key that all spellings of a name share."""
    return f"array_join({t}, '_')"


def capitalized(s: str) -> str:
    return f"concat(upper(substring({s}, 1, 1)), lower(substring({s}, 2)))"


def joined(t: str, conv: str) -> str:
    """SQL: the tags written in a convention; NULL if ``conv`` is none of the six."""
    each = f"transform({t}, x -> {capitalized('x')})"
    return (
        f"CASE {conv} WHEN 'snake_case' THEN array_join({t}, '_') WHEN 'kebab-case' THEN array_join({t}, '-')"
        f" WHEN 'camelCase' THEN array_join(transform({t}, (x, i) -> IF(i = 0, lower(x), {capitalized('x')})), '')"
        f" WHEN 'PascalCase' THEN array_join({each}, '') WHEN 'UPPER_SNAKE_CASE' THEN upper(array_join({t}, '_'))"
        f" WHEN 'Ada_Case' THEN array_join({each}, '_') END"
    )


def parse(df, name_col: str = "identifier", convention_col: str | None = None):
    """``df`` with the columns convention, tags, namespaces, role and shape of a name column.

    A given convention that is null, or names none of the six, is detected instead.  Each step
    is a projection of its own, so nothing is computed twice.
    """
    n = f"`{name_col}`"
    conv = convention(n)
    if convention_col:
        conv = f"coalesce({convention_of_spelling(f'`{convention_col}`')}, {conv})"
    df = df.withColumn("convention", F.expr(conv))
    df = df.withColumns({"tags": F.expr(tags(n, "convention")), "namespaces": F.expr(namespaces(n, "convention"))})
    return df.withColumns({"role": F.expr(role("tags")), "shape": F.expr(shape("tags"))})


def parsed_struct(name_col: str = "identifier") -> Column:
    """One struct of a parsed row: original, convention, tags, namespaces, role, shape."""
    return F.struct(F.col(name_col).alias("original"), "convention", "tags", "namespaces", "role", "shape")


# ---------------------------------------------------------------- aliases


def aliases(t: str) -> str:
    """SQL: map from each convention, in byte order of their names, to the tags written in it."""
    names = sorted(CONVENTIONS)
    return "map(" + ", ".join(f"'{c}', {joined(t, text(c))}" for c in names) + ")"


def alias_rows(df, tags_col: str = "tags"):
    """Long form: a row for each convention with its ``alias``."""
    return df.withColumn("target", F.explode(F.array(*map(F.lit, CONVENTIONS)))).withColumn("alias", F.expr(joined(tags_col, "target")))


# ---------------------------------------------------------------- prose


def prose(t: str, role_: str, shape_: str) -> str:
    """SQL: a short English description of a parsed name."""
    role_words = [w for words in ROLE_WORDS.values() for w in words]
    shape_words = [w for words in SHAPE_WORDS.values() for w in words]
    let = lambda name, value, body: f"element_at(transform(array({value}), {name} -> {body}), 1)"
    has_word = f"({role_} IS NOT NULL AND coalesce(try_element_at({t}, 1) IN {_in(role_words)}, false))"
    core = f"IF({has_word}, slice({t}, 2, greatest(size({t}) - 1, 0)), {t})"
    core = let("c", core, f"IF({shape_} IS NOT NULL AND coalesce(try_element_at(c, -1) IN {_in(shape_words)}, false), slice(c, 1, greatest(size(c) - 1, 0)), c)")
    shaped = let("noun", f"array_join({core}, ' ')", f"CASE {shape_} WHEN 'array' THEN concat('Array of ', noun, 's') WHEN 'record' THEN concat(noun, ' record') WHEN 'map' THEN concat(noun, ' map') WHEN 'set' THEN concat(noun, ' set') WHEN 'signal' THEN concat(noun, ' signal') ELSE noun END")
    moved = let("ws", "filter(split(x, ' '), w -> w <> '')", f"IF(size(ws) > 1 AND {has_word}, concat(element_at(ws, -1), ' ', {t}[0], ' ', array_join(slice(ws, 1, size(ws) - 1), ' ')), x)")
    phrase = (
        f"CASE {role_} WHEN 'factory' THEN concat('Creates a ', x) WHEN 'hook' THEN concat('Uses ', x) WHEN 'setter' THEN concat('Sets ', x)"
        f" WHEN 'getter' THEN concat('Gets ', x) WHEN 'predicate' THEN concat('Checks if ', {moved}) WHEN 'handler' THEN concat('Handles ', x)"
        f" WHEN 'validator' THEN concat('Validates ', x) ELSE IF(startswith(x, 'Array of '), x, concat(upper(substring(x, 1, 1)), substring(x, 2))) END"
    )
    return let("x", shaped, phrase)


def describe(df):
    """``df`` of parsed names with the column ``prose``."""
    return df.withColumn("prose", F.expr(prose("tags", "role", "shape")))
