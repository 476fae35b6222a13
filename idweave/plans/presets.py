"""Built-in presets: naming rules of languages; ``load_folder`` adds presets from TOML files."""

from __future__ import annotations

import os

#: language -> its aliases, default convention, contexts by convention, what names of a context begin or end with, and
#: name patterns (fixed values).
LANGUAGES = {
    "c": {
        "convention": "snake_case",
        "contexts": {"snake_case": "variable function typedef struct enum parameter file", "UPPER_SNAKE_CASE": "enum_member constant macro"},
        "affixes": {"typedef": {"suffix": "_t"}, "struct": {"suffix": "_t"}, "enum": {"suffix": "_t"}},
        "patterns": {"factory": "{module}_{name}_create", "init": "{module}_{name}_init", "destroy": "{module}_{name}_destroy", "getter": "{module}_{name}_get", "setter": "{module}_{name}_set", "type": "{name}_t"},
    },
    "clojure": {
        "aliases": "clj",
        "convention": "kebab-case",
        "contexts": {"kebab-case": "variable function macro constant dynamic namespace multimethod keyword", "PascalCase": "protocol record type"},
        "affixes": {"dynamic": {"prefix": "*", "suffix": "*"}, "namespace": {"separator": "."}, "keyword": {"prefix": ":"}},
        "patterns": {"predicate": "{name}?", "bang": "{name}!", "converter": "->{Name}", "map_converter": "map->{Name}", "private": "{name}-"},
        "namespace": "/",
    },
    "common-lisp": {
        "aliases": "cl lisp",
        "convention": "kebab-case",
        "contexts": {"kebab-case": "variable function macro special_variable constant class struct condition generic_function method package keyword"},
        "affixes": {"special_variable": {"prefix": "*", "suffix": "*"}, "constant": {"prefix": "+", "suffix": "+"}, "package": {"separator": "."}, "keyword": {"prefix": ":"}},
        "patterns": {"factory": "make-{name}", "predicate": "{name}p", "predicate_hyphen": "{name}-p", "accessor": "{name}-{field}", "converter": "{name}-to-{target}", "type": "{name}", "with": "with-{name}"},
        "namespace": ":",
    },
    "cpp": {
        "aliases": "c++ cxx",
        "convention": "snake_case",
        "contexts": {"snake_case": "variable function method parameter namespace file", "PascalCase": "class struct enum enum_member template_parameter", "UPPER_SNAKE_CASE": "constant macro"},
        "patterns": {"factory": "create_{name}", "getter": "{name}", "setter": "set_{name}", "predicate": "is_{name}", "type": "{Name}"},
    },
    "crystal": {
        "aliases": "cr",
        "convention": "snake_case",
        "contexts": {"snake_case": "variable method parameter instance_variable class_variable file", "PascalCase": "class struct module enum enum_member type_variable annotation", "UPPER_SNAKE_CASE": "constant"},
        "affixes": {"instance_variable": {"prefix": "@"}, "class_variable": {"prefix": "@@"}},
        "patterns": {"factory": "new", "predicate": "{name}?", "bang": "{name}!", "setter": "{name}=", "getter": "{name}", "type": "{Name}", "converter": "to_{name}"},
    },
    "csharp": {
        "aliases": "cs c#",
        "convention": "PascalCase",
        "contexts": {"camelCase": "variable parameter field", "PascalCase": "method property class interface enum enum_member constant namespace event delegate file"},
        "affixes": {"interface": {"prefix": "I"}, "field": {"prefix": "_"}},
        "patterns": {"factory": "Create{Name}", "getter": "{Name}", "setter": "{Name}", "predicate": "Is{Name}", "async": "{Name}Async", "type": "{Name}"},
    },
    "css": {
        "convention": "kebab-case",
        "contexts": {"kebab-case": "class id custom_property animation mixin variable file"},
        "affixes": {"custom_property": {"prefix": "--"}, "variable": {"prefix": "--"}},
        "patterns": {"block": "{block}", "element": "{block}__{element}", "modifier": "{block}--{modifier}", "utility": "u-{name}", "state": "is-{name}", "js_hook": "js-{name}"},
    },
    "d": {
        "aliases": "dlang",
        "convention": "camelCase",
        "contexts": {"camelCase": "variable function enum_member constant template parameter unittest", "PascalCase": "type struct class interface enum", "snake_case": "module package"},
        "patterns": {"factory": "create{Name}", "getter": "{name}", "setter": "{name}", "predicate": "is{Name}", "opCall": "opCall", "opAssign": "opAssign"},
    },
    "dart": {
        "convention": "camelCase",
        "contexts": {"camelCase": "variable function method enum_value constant private parameter named_parameter", "PascalCase": "type class mixin enum extension typedef", "snake_case": "library file"},
        "affixes": {"private": {"prefix": "_"}},
        "patterns": {"factory": "factory", "predicate": "is{Name}", "getter": "{name}", "setter": "{name}", "converter": "to{Name}", "builder": "{name}Builder"},
    },
    "elixir": {
        "aliases": "ex",
        "convention": "snake_case",
        "contexts": {"snake_case": "variable function private_function atom parameter macro file", "PascalCase": "module"},
        "affixes": {"private_function": {"prefix": "_"}, "atom": {"prefix": ":"}},
        "patterns": {"factory": "new_{name}", "predicate": "{name}?", "bang": "{name}!", "setter": "put_{name}", "getter": "get_{name}", "type": "{Name}"},
    },
    "erlang": {
        "aliases": "erl",
        "convention": "snake_case",
        "contexts": {"PascalCase": "variable", "snake_case": "function module atom record record_field type callback behaviour application file", "UPPER_SNAKE_CASE": "macro"},
        "affixes": {"macro": {"prefix": "?"}},
        "patterns": {"factory": "new", "handle_call": "handle_call", "handle_cast": "handle_cast", "handle_info": "handle_info", "init": "init", "terminate": "terminate", "predicate": "is_{name}", "converter": "{source}_to_{target}", "type": "{name}"},
        "namespace": ":",
    },
    "fsharp": {
        "aliases": "fs f#",
        "convention": "camelCase",
        "contexts": {"camelCase": "variable function parameter computation_expression measure", "PascalCase": "type module namespace discriminated_union union_case record record_field interface type_parameter exception active_pattern"},
        "affixes": {"interface": {"prefix": "I"}, "type_parameter": {"prefix": "'"}},
        "patterns": {"factory": "create{Name}", "predicate": "is{Name}", "converter": "to{Name}", "from": "of{Name}", "try_parse": "tryParse{Name}", "getter": "{name}", "setter": "set{Name}", "type": "{Name}", "pipe": "|>"},
    },
    "gleam": {
        "convention": "snake_case",
        "contexts": {"snake_case": "variable function module constant parameter label type_variable file", "PascalCase": "type constructor"},
        "patterns": {"factory": "new", "predicate": "is_{name}", "converter": "to_{target}", "from": "from_{source}", "getter": "{name}", "type": "{Name}", "pipe": "|>"},
        "namespace": "/",
    },
    "go": {
        "convention": "camelCase",
        "contexts": {"camelCase": "variable function method parameter", "PascalCase": "exported_variable exported_function type interface struct constant exported_constant exported_method", "lowercase": "package", "snake_case": "file"},
        "affixes": {"interface": {"suffix": "er"}},
        "patterns": {"factory": "New{Name}", "getter": "{Name}", "setter": "Set{Name}", "predicate": "Is{Name}", "type": "{Name}"},
    },
    "haskell": {
        "aliases": "hs",
        "convention": "camelCase",
        "contexts": {"camelCase": "variable function type_variable field", "PascalCase": "type type_class data_constructor module", "symbolic": "operator"},
        "patterns": {"factory": "mk{Name}", "predicate": "is{Name}", "getter": "get{Name}", "unwrap": "un{Name}", "converter": "to{Name}", "from": "from{Name}", "with": "with{Name}"},
    },
    "java": {
        "convention": "camelCase",
        "contexts": {"camelCase": "variable method parameter", "PascalCase": "class interface enum file", "UPPER_SNAKE_CASE": "enum_member constant", "lowercase": "package"},
        "patterns": {"factory": "create{Name}", "getter": "get{Name}", "setter": "set{Name}", "predicate": "is{Name}", "builder": "{Name}Builder", "type": "{Name}"},
    },
    "javascript": {
        "aliases": "js",
        "convention": "camelCase",
        "contexts": {"camelCase": "variable function method parameter", "PascalCase": "class enum_member", "UPPER_SNAKE_CASE": "constant", "kebab-case": "file package"},
        "patterns": {"factory": "create_{name}", "hook": "use_{name}", "setter": "set_{name}", "signal": "{name}$", "type": "{Name}", "array": "{name}_a"},
    },
    "julia": {
        "aliases": "jl",
        "convention": "snake_case",
        "contexts": {"snake_case": "variable function macro parameter field", "PascalCase": "type abstract_type module type_parameter file", "UPPER_SNAKE_CASE": "constant"},
        "affixes": {"macro": {"prefix": "@"}},
        "patterns": {"bang": "{name}!", "factory": "{Name}", "predicate": "is{name}", "converter": "convert", "type": "{Name}", "getter": "get{name}", "setter": "set{name}!"},
    },
    "kotlin": {
        "aliases": "kt",
        "convention": "camelCase",
        "contexts": {"camelCase": "variable function property method parameter", "PascalCase": "class interface enum object file", "UPPER_SNAKE_CASE": "enum_member constant", "lowercase": "package"},
        "patterns": {"factory": "create{Name}", "getter": "get{Name}", "setter": "set{Name}", "predicate": "is{Name}", "builder": "{Name}Builder", "type": "{Name}"},
    },
    "lua": {
        "convention": "snake_case",
        "contexts": {"snake_case": "variable local function method global module field metamethod", "UPPER_SNAKE_CASE": "constant", "PascalCase": "class"},
        "affixes": {"metamethod": {"prefix": "__"}},
        "patterns": {"factory": "new", "predicate": "is_{name}", "getter": "get_{name}", "setter": "set_{name}", "callback": "on_{name}"},
    },
    "nim": {
        "convention": "camelCase",
        "contexts": {"camelCase": "variable proc func method enum_value constant template macro iterator parameter", "PascalCase": "type object enum", "snake_case": "module"},
        "patterns": {"factory": "new{Name}", "init": "init{Name}", "predicate": "is{Name}", "getter": "{name}", "setter": "{name}=", "converter": "to{Name}", "iterator": "items"},
        "vectors": {"style_insensitive": True},
    },
    "objective-c": {
        "aliases": "objc",
        "convention": "camelCase",
        "contexts": {"camelCase": "variable instance_variable method property parameter", "PascalCase": "class protocol category constant enum_value typedef global file", "UPPER_SNAKE_CASE": "macro"},
        "affixes": {"instance_variable": {"prefix": "_"}, "constant": {"prefix": "k"}},
        "patterns": {"factory": "initWith{Name}", "class_factory": "{prefix}With{Name}", "predicate": "is{Name}", "getter": "{name}", "setter": "set{Name}", "delegate": "{name}Delegate", "datasource": "{name}DataSource", "type": "{Name}", "action": "{name}Action"},
    },
    "ocaml": {
        "aliases": "ml",
        "convention": "snake_case",
        "contexts": {"snake_case": "variable function type record_field type_variable parameter label optional file", "PascalCase": "module functor constructor polymorphic_variant exception", "UPPER_SNAKE_CASE": "module_type"},
        "affixes": {"polymorphic_variant": {"prefix": "`"}, "type_variable": {"prefix": "'"}, "label": {"prefix": "~"}, "optional": {"prefix": "?"}},
        "patterns": {"factory": "create", "converter": "of_{source}", "to": "to_{target}", "predicate": "is_{name}", "getter": "{name}", "setter": "set_{name}", "type": "{name}", "pp": "pp_{name}"},
    },
    "odin": {
        "convention": "snake_case",
        "contexts": {"snake_case": "variable procedure parameter field import package file", "Ada_Case": "type struct union enum enum_value", "UPPER_SNAKE_CASE": "constant"},
        "patterns": {"new": "new", "make": "make", "factory": "create_{name}", "init": "init", "deinit": "destroy", "free": "free", "delete": "delete", "getter": "{name}", "predicate": "is_{name}"},
    },
    "perl": {
        "aliases": "pl",
        "convention": "snake_case",
        "contexts": {"snake_case": "variable scalar array hash function method private", "UPPER_SNAKE_CASE": "constant", "PascalCase": "package class file"},
        "affixes": {"scalar": {"prefix": "$"}, "array": {"prefix": "@"}, "hash": {"prefix": "%"}, "package": {"separator": "::"}, "file": {"suffix": ".pm"}, "private": {"prefix": "_"}},
        "patterns": {"factory": "new", "predicate": "is_{name}", "getter": "{name}", "setter": "set_{name}", "callback": "on_{name}"},
    },
    "php": {
        "convention": "camelCase",
        "contexts": {"camelCase": "variable method property parameter", "snake_case": "function", "PascalCase": "class interface trait enum enum_member namespace file", "UPPER_SNAKE_CASE": "constant"},
        "affixes": {"variable": {"prefix": "$"}, "parameter": {"prefix": "$"}},
        "patterns": {"factory": "create{Name}", "getter": "get{Name}", "setter": "set{Name}", "predicate": "is{Name}", "type": "{Name}"},
    },
    "python": {
        "aliases": "py",
        "convention": "snake_case",
        "contexts": {"snake_case": "variable function method module package parameter private dunder", "PascalCase": "class", "UPPER_SNAKE_CASE": "constant"},
        "affixes": {"private": {"prefix": "_"}, "dunder": {"prefix": "__", "suffix": "__"}},
        "patterns": {"factory": "create_{name}", "hook": "use_{name}", "setter": "set_{name}", "type": "{Name}", "array": "{name}_list"},
    },
    "r": {
        "convention": "snake_case",
        "contexts": {"snake_case": "variable function class_s3 method parameter column", "PascalCase": "class_s4 class_r5", "UPPER_SNAKE_CASE": "constant", "camelCase": "package"},
        "patterns": {"predicate": "is_{name}", "converter": "as_{name}", "getter": "{name}", "setter": "{name}<-"},
        "legacy": {"convention": "dot_case", "separator": "."},
    },
    "racket": {
        "aliases": "rkt",
        "convention": "kebab-case",
        "contexts": {"kebab-case": "variable function macro parameter class interface mixin unit field struct module contract constant"},
        "affixes": {"class": {"suffix": "%"}, "interface": {"suffix": "<%>"}, "mixin": {"suffix": "@"}, "unit": {"suffix": "@"}, "contract": {"suffix": "/c"}},
        "patterns": {"predicate": "{name}?", "bang": "{name}!", "factory": "make-{name}", "converter": "{source}->{target}", "accessor": "{name}-{field}", "setter": "set-{name}-{field}!", "for_each": "for/each", "with": "with-{name}", "provide": "provide"},
        "namespace": "/",
    },
    "ruby": {
        "aliases": "rb",
        "convention": "snake_case",
        "contexts": {"snake_case": "variable method parameter instance_variable class_variable global_variable symbol file", "PascalCase": "class module", "UPPER_SNAKE_CASE": "constant"},
        "affixes": {"instance_variable": {"prefix": "@"}, "class_variable": {"prefix": "@@"}, "global_variable": {"prefix": "$"}, "symbol": {"prefix": ":"}},
        "patterns": {"factory": "create_{name}", "predicate": "{name}?", "bang": "{name}!", "setter": "{name}=", "type": "{Name}"},
    },
    "rust": {
        "aliases": "rs",
        "convention": "snake_case",
        "contexts": {"snake_case": "variable function module macro lifetime crate", "PascalCase": "type trait enum enum_variant", "UPPER_SNAKE_CASE": "constant static"},
        "affixes": {"macro": {"suffix": "!"}, "lifetime": {"prefix": "'"}},
        "patterns": {"factory": "create_{name}", "builder": "{name}_builder", "setter": "set_{name}", "getter": "{name}", "predicate": "is_{name}", "type": "{Name}", "array": "{name}_list"},
    },
    "scala": {
        "convention": "camelCase",
        "contexts": {"camelCase": "variable val var function method parameter", "PascalCase": "type class trait object case_class type_parameter constant", "snake_case": "package"},
        "patterns": {"factory": "apply", "unapply": "unapply", "predicate": "is{Name}", "converter": "to{Name}", "getter": "{name}", "setter": "{name}_="},
    },
    "scheme": {
        "aliases": "scm",
        "convention": "kebab-case",
        "contexts": {"kebab-case": "variable function macro parameter record library constant"},
        "patterns": {"predicate": "{name}?", "bang": "{name}!", "converter": "{source}->{target}", "factory": "make-{name}", "accessor": "{name}-{field}", "setter": "{name}-{field}-set!", "with": "with-{name}", "call_with": "call-with-{name}"},
        "namespace": "/",
    },
    "shell": {
        "aliases": "sh bash zsh",
        "convention": "snake_case",
        "contexts": {"snake_case": "variable function private_function alias", "UPPER_SNAKE_CASE": "environment constant", "kebab-case": "file"},
        "affixes": {"private_function": {"prefix": "_"}},
        "patterns": {"private": "_{name}", "setter": "set_{name}", "getter": "get_{name}", "predicate": "is_{name}", "type": "{Name}"},
    },
    "sql": {
        "convention": "snake_case",
        "contexts": {"UPPER_SNAKE_CASE": "keyword", "snake_case": "table column function procedure view index constraint trigger alias schema"},
        "affixes": {"index": {"prefix": "idx_"}, "trigger": {"prefix": "trg_"}},
        "patterns": {"primary_key": "{table}_pkey", "foreign_key": "fk_{table}_{column}", "index": "idx_{table}_{column}", "unique": "uq_{table}_{column}", "type": "{Name}"},
    },
    "swift": {
        "convention": "camelCase",
        "contexts": {"camelCase": "variable function enum_case constant method parameter", "PascalCase": "class struct protocol enum typealias file"},
        "patterns": {"factory": "make{Name}", "predicate": "is{Name}", "setter": "set{Name}", "type": "{Name}", "builder": "{Name}Builder"},
    },
    "typescript": {
        "aliases": "ts",
        "convention": "camelCase",
        "contexts": {"camelCase": "variable function method parameter", "PascalCase": "type interface enum enum_member class", "UPPER_SNAKE_CASE": "constant", "kebab-case": "file package"},
        "patterns": {"factory": "create_{name}", "hook": "use_{name}", "setter": "set_{name}", "signal": "{name}$", "type": "{name}_T", "array": "{name}_a"},
    },
    "v": {
        "aliases": "vlang",
        "convention": "snake_case",
        "contexts": {"snake_case": "variable function method enum enum_value constant module parameter pub_function file", "PascalCase": "type struct interface"},
        "affixes": {"pub_function": {"prefix": "pub "}},
        "patterns": {"factory": "new", "factory_alt": "new_{name}", "predicate": "is_{name}", "setter": "set_{name}", "getter": "{name}", "type": "{Name}", "str": "str"},
    },
    "zig": {
        "convention": "camelCase",
        "contexts": {"snake_case": "variable enum_field constant comptime parameter field test file package", "camelCase": "function", "PascalCase": "type struct enum union error_set namespace"},
        "patterns": {"factory": "init", "deinit": "deinit", "getter": "{name}", "setter": "set{Name}", "predicate": "is{Name}", "iterator": "next", "formatter": "format"},
    },
}

#: Name patterns of the convention preset, and of a new project's file without the last two (fixed values).
PATTERNS = {
    "factory": "create_{name}", "hook": "use_{name}", "setter": "set_{name}", "signal": "{name}$", "type": "{name}_T", "array": "{name}_a",
    "record": "{key}_R_{value}", "map": "{key}_M_{value}",
}


def _preset(name, own):
    """The configuration of a language, as its file would hold it."""
    join = "-" if own["convention"] == "kebab-case" else "_"
    rules = {c: {"convention": convention} | own.get("affixes", {}).get(c, {}) for convention, contexts in own["contexts"].items() for c in contexts.split()}
    return {
        "version": 1, "name": name, "convention": own["convention"], "immutable": True, "singular": True,
        "vectors": {"join": join, "namespace": own.get("namespace", "__")} | own.get("vectors", {}), "contexts": rules, "patterns": own["patterns"],
        "externals": {"preserve_casing": True, "join_with": join}, "tags": {"open": True},
    } | ({"legacy": own["legacy"]} if "legacy" in own else {})


_BASE = {
    "version": 1, "convention": "snake_case", "immutable": True, "singular": True, "vectors": {"join": "_", "namespace": "__"},
    "externals": {"preserve_casing": True, "join_with": "_"}, "tags": {"open": True},
}
PRESETS = {name: _preset(name, own) for name, own in LANGUAGES.items()}
PRESETS["immutable-tag"] = _BASE | {"name": "immutable-tag", "patterns": dict(PATTERNS), "packages": {"separator": "--", "pattern": "{category}--{platform}--{feature}"}}
#: Every name of a preset.
NAMES = {alias: name for name, own in LANGUAGES.items() for alias in (name, *own.get("aliases", "").split())} | {"immutable-tag": "immutable-tag"}
#: A new project's file.
STARTER = _BASE | {"name": "my-project", "patterns": {k: v for k, v in PATTERNS.items() if k not in ("record", "map")}}


def load_folder(folder: str) -> None:
    """Add the presets of a folder of TOML files, each under its file's name."""
    import tomllib

    for name in sorted(os.listdir(folder)):
        if name.endswith(".toml"):
            with open(os.path.join(folder, name), "rb") as f:
                PRESETS[name[:-5]] = tomllib.load(f)
            NAMES[name[:-5]] = name[:-5]


def preset_rows():
    """(preset, context, convention, prefix, suffix) of all contexts."""
    return [
        (language, context, rule["convention"], rule.get("prefix"), rule.get("suffix"))
        for language, preset in sorted(PRESETS.items())
        for context, rule in sorted(preset.get("contexts", {}).items())
    ]


def presets_frame(spark):
    return spark.createDataFrame(preset_rows(), "preset string, context string, convention string, prefix string, suffix string")
