import itertools

import pytest
from pyspark.sql import functions as F

from idweave.functions import names, sql_functions

#: name -> convention, tags, namespaces, role, shape
GOLDEN = {
    "person_name": ("snake_case", ["person", "name"], [], None, None),
    "personName": ("camelCase", ["person", "name"], [], None, None),
    "PersonName": ("PascalCase", ["person", "name"], [], None, None),
    "person-name": ("kebab-case", ["person", "name"], [], None, None),
    "PERSON_NAME": ("UPPER_SNAKE_CASE", ["person", "name"], [], None, None),
    "User_Name": ("Ada_Case", ["user", "name"], [], None, None),
    "auth0__user__validate": ("snake_case", ["auth0", "user", "validate"], [["auth0"], ["user"], ["validate"]], "validator", None),
    "HTMLElement": ("PascalCase", ["html", "element"], [], None, None),
    "createContext_auth": ("snake_case", ["create", "context", "auth"], [], "factory", None),
    "ATest": ("PascalCase", ["atest"], [], None, None),
    "isAValid": ("camelCase", ["is", "avalid"], [], "predicate", None),
    "GetUserByID": ("PascalCase", ["get", "user", "by", "id"], [], "getter", None),
    "get2D": ("camelCase", ["get2d"], [], None, None),
    "sha256Hash": ("camelCase", ["sha256", "hash"], [], None, None),
    "__init__": ("snake_case", ["init"], [[], ["init"], []], None, None),
    "_": ("UPPER_SNAKE_CASE", [], [], None, None),
    "_Foo": ("Ada_Case", ["foo"], [], None, None),
    "Brand_17": ("snake_case", ["brand", "17"], [], None, None),
    "createUser__getName": ("snake_case", ["create", "user", "get", "name"], [["createuser"], ["getname"]], "factory", None),
    "foo-BarBaz": ("kebab-case", ["foo", "barbaz"], [], None, None),
    "font_size-x": ("snake_case", ["font", "size-x"], [], None, None),
    "set": ("camelCase", ["set"], [], "setter", "set"),
    "set_of_set": ("snake_case", ["set", "of", "set"], [], "setter", None),
    "post_a": ("snake_case", ["post", "a"], [], None, "array"),
    "pathname$": ("camelCase", ["pathname$"], [], None, "signal"),
    "user_validate": ("snake_case", ["user", "validate"], [], "validator", None),
    "": ("camelCase", [], [], None, None),
}
PROSE = {
    "create_user_profile": "Creates a user profile", "is_valid_email": "Checks if email is valid", "getUserById": "Gets user by id", "user_name_a": "Array of user names",
    "PersonName": "Person name", "SET_MAX_RETRIES": "Sets max retries", "set": "Sets  set", "list": "Array of s", "create": "Creates a ", "is_valid": "Checks if valid",
    "is_user_list": "Checks if users is Array of", "create_user_list": "Creates a Array of users", "user_validate": "Validates user validate", "pathname$": "Pathname$ signal",
}


def rows(spark, values):
    return spark.createDataFrame([(v,) for v in values], "identifier string")


def test_golden_names(spark):
    found = {r.identifier: (r.convention, r.tags, r.namespaces, r.role, r.shape) for r in names.parse(rows(spark, GOLDEN)).collect()}
    assert found == GOLDEN


def test_prose(spark):
    found = {r.identifier: r.prose for r in names.describe(names.parse(rows(spark, PROSE))).collect()}
    assert found == PROSE


def test_null_name(spark):
    row = names.describe(names.parse(rows(spark, [None]))).first()
    assert row.convention is None and row.tags is None and row.role is None and row.prose is None


def test_forced_convention(spark):
    df = spark.createDataFrame([("fooBar-baz", "kebab"), ("fooBar", "nonsense"), ("fooBar", None)], "identifier string, given string")
    found = [(r.convention, r.tags) for r in names.parse(df, convention_col="given").collect()]
    assert found == [("kebab-case", ["foobar", "baz"]), ("camelCase", ["foo", "bar"]), ("camelCase", ["foo", "bar"])]


@pytest.mark.parametrize("conv,name", [("snake_case", "get_user_id"), ("camelCase", "getUserId"), ("PascalCase", "GetUserId"), ("kebab-case", "get-user-id"), ("UPPER_SNAKE_CASE", "GET_USER_ID"), ("Ada_Case", "Get_User_Id")])
def test_round_trip(spark, conv, name):
    row = names.parse(rows(spark, [name])).select("convention", F.expr(names.joined("tags", "convention")).alias("again")).first()
    assert (row.convention, row.again) == (conv, name)


def cut_by_steps(segment):
    """A plain statement of where a segment is cut."""
    out, current = [], ""
    for i, c in enumerate(segment):
        if c.isupper() and current:
            before_lower = segment[i - 1].islower()
            next_lower = i + 1 < len(segment) and segment[i + 1].islower()
            if before_lower or (len(current.encode()) > 1 and next_lower):
                out.append(current)
                current = ""
        current += c
    return [x.lower() for x in [*out, current] if x]


def test_cut_against_brute_force(spark):
    values = ["".join(p) for n in range(1, 7) for p in itertools.product("aA1_", repeat=n)]
    values += ["".join(p) for n in range(1, 6) for p in itertools.product("aAéÉ٣_", repeat=n)]
    values += ["fooÉtat", "éName", "ÉTatName", "ÉÉtat", "straßeÄndern", "日本Name", "имяФайла"]
    found = {r.identifier: r.tags for r in names.parse(rows(spark, values)).select("identifier", "tags").collect()}

    def expected(name):
        out = []
        for part in name.split("_"):
            mixed = any(c.isupper() for c in part) and any(c.islower() for c in part)
            out += cut_by_steps(part) if mixed else [part.lower()] * bool(part)
        return out

    assert {v for v in values if found[v] != expected(v)} == set()


def test_aliases(spark):
    row = names.parse(rows(spark, ["auth__user__validate"])).select(F.map_entries(F.expr(names.aliases("tags"))).alias("a")).first()
    assert [tuple(e) for e in row.a] == [
        ("Ada_Case", "Auth_User_Validate"), ("PascalCase", "AuthUserValidate"), ("UPPER_SNAKE_CASE", "AUTH_USER_VALIDATE"), ("camelCase", "authUserValidate"), ("kebab-case", "auth-user-validate"),
        ("snake_case", "auth_user_validate"),
    ]
    assert names.alias_rows(names.parse(rows(spark, ["a_b"]))).count() == 6


def test_spellings():
    assert names.parse_convention("screaming") == "UPPER_SNAKE_CASE" and names.parse_convention("lowercase") is None


def test_sql_functions_run_in_the_plan(spark):
    sql_functions.register(spark)
    df = spark.sql("SELECT detect_convention(concat('a_', id)) AS c, join_tags(name_tags(concat('getB', id)), 'Ada_Case') AS j FROM range(2)")
    assert [tuple(r) for r in df.collect()] == [("snake_case", "Get_B0"), ("snake_case", "Get_B1")]
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
