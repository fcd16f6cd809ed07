import pytest

from quarryline.sources import config, history

DEFAULTS = {"scan": {"exclude": ["a"], "depth": 3, "strict": False}, "score": {"threshold": 60.0}, "name": "x"}


def test_order_of_settings(tmp_path):
    (tmp_path / "q.toml").write_text('name = "file"\n[scan]\ndepth = 5\nexclude = ["b"]\n')
    (tmp_path / ".env").write_text("# own\nexport QUARRYLINE_SCAN_DEPTH='6'\nQUARRYLINE_NAME=dotenv\nbroken\n")
    got = config.load(DEFAULTS, str(tmp_path / "q.toml"), given={"score": {"threshold": 70.0}, "name": None}, environment={"QUARRYLINE_SCAN_STRICT": "yes", "QUARRYLINE_SCAN_EXCLUDE": "c, d,"})
    assert got == {"scan": {"exclude": ["c", "d"], "depth": 6, "strict": True}, "score": {"threshold": 70.0}, "name": "dotenv"}
    assert config.load(DEFAULTS, str(tmp_path / "none.toml"), environment={}) == DEFAULTS
    assert DEFAULTS["scan"]["depth"] == 3


def test_yaml_section():
    text = "other:\n  a: 1\nrules:\n  level: high # note\n  names:\n    - one\n    - 'two'\n"
    got = config.yaml_section(text, "rules")
    assert got["level"] == "high" and got["names"] == ["one", "two"]
    assert config.yaml_section(text, "none") == {}


def test_diff_base():
    since = lambda day: "abc" if day.startswith("2024") else None
    assert history.diff_base(None, since, bool) == "HEAD~1"
    assert history.diff_base("2024-05-01", since, bool) == "abc~1"
    assert history.diff_base("2030-05-01", since, bool) == "HEAD"
    assert history.diff_base("main", since, lambda _: True) == "main"
    with pytest.raises(ValueError, match="no such commit"):
        history.diff_base("nope", since, lambda _: False)
