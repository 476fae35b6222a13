import pytest

from idweave.plans import config, presets


def test_builtin_presets():
    assert len(presets.PRESETS) == 40 and len(presets.preset_rows()) == 461
    go = config.builtin("go")
    assert go.contexts["interface"] == config.Context("PascalCase", None, "er") and go.contexts["package"].convention == "lowercase"
    assert go.patterns == {"factory": "New{Name}", "getter": "{Name}", "setter": "Set{Name}", "predicate": "Is{Name}", "type": "{Name}"}
    assert config.builtin("lisp").externals["join_with"] == "-" and config.builtin("py").contexts["dunder"] == config.Context("snake_case", "__", "__")
    assert config.builtin("c++").contexts["constant"].convention == "UPPER_SNAKE_CASE"
    assert config.builtin("go").contexts["constant"].convention == "PascalCase"
    assert config.builtin("immutable-tag").contexts is None and config.builtin("none") is None


def test_resolve_merges_left_to_right(tmp_path):
    (tmp_path / "base.toml").write_text('version = 1\nname = "base"\nextends = ["java"]\nconvention = "kebab-case"\n[contexts.function]\nconvention = "kebab"\nprefix = "x"\n[patterns]\na = "1"\nb = "2"\n')
    (tmp_path / ".naming.toml").write_text('version = 3\nname = "mine"\nextends = ["rust", "base.toml"]\n[contexts.type]\nconvention = "Ada_Case"\n[patterns]\nb = "3"\n[tags]\n[tags.declared.user]\nrole = "noun"\n')
    found = config.resolve(str(tmp_path / ".naming.toml"))
    assert (found.version, found.name, found.extends, found.convention) == (3, "mine", None, "kebab-case")
    assert found.contexts["function"] == config.Context("kebab", "x") and found.contexts["variable"].convention == "snake_case" and found.contexts["type"].convention == "Ada_Case"
    assert found.patterns == config.builtin("rust").patterns | {"a": "1", "b": "3"} and found.tags == {"open": False, "declared": {"user": {"role": "noun"}}}


def test_errors(tmp_path):
    with pytest.raises(config.ConfigError, match="failed to read"):
        config.load(str(tmp_path / "none.toml"))
    (tmp_path / "bad.toml").write_text("version = ")
    with pytest.raises(config.ConfigError, match="failed to parse"):
        config.load(str(tmp_path / "bad.toml"))


def test_find_nearest(tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / ".naming.toml").write_text("")
    (tmp_path / "a/x.py").write_text("")
    assert config.find(str(tmp_path / "a/b")) == config.find(str(tmp_path / "a/x.py")) == str(tmp_path / ".naming.toml")


@pytest.mark.parametrize("name", [*presets.NAMES, None])
def test_generated_files_load(tmp_path, name):
    path = tmp_path / "x.toml"
    path.write_text(config.generate(name, name))
    loaded = config.load(str(path))
    if name and name != "immutable-tag":
        assert loaded == config.builtin(name)


def test_generated_files_hold_everything():
    import tomllib

    for name, preset in presets.PRESETS.items():
        assert tomllib.loads(config.generate(name, name)) == preset


def test_unknown_language_gives_the_starter():
    assert config.generate("klingon") == config.generate() and 'name = "my-project"' in config.generate()
