import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kenmap.functions.patterns import attribute_regex, exclude_regex, matches, rule_regex, rule_supported, target_regex

RULES = [
    ("*", "a/b.py", True), ("*.py", "a/b.py", True), ("*.py", "a/b.pyc", False), ("/*.py", "a/b.py", False), ("src/", "src/a.py", True), ("src/", "src", False),
    ("src/*", "src/a.py", True), ("src/*", "src/a/b.py", False), ("src/**", "src/a/b.py", True), ("docs", "x/docs/y", True), ("/docs", "x/docs/y", False),
    ("a/**/c", "a/c", True), ("a/**/c", "a/x/y/c", True), ("a/**/c", "a/xc", False), ("a/*/c", "a//c", False), ("***", "a", False), ("**/**", "a", False), ("**", "a/b", True),
    ("/**", "a/b", True), (r"\**", "*a", True), (r"\**", "ba", False), ("a?c", "abc", True), ("a?c", "a/c", False), ("/", "a", False), ("a.b", "axb", False), ("a b/", "a b/c", True),
]


@pytest.mark.parametrize("pattern,path,expected", RULES)
def test_rule_dialect(pattern, path, expected):
    assert matches(rule_regex(pattern), path) is expected


@pytest.mark.parametrize("pattern,path,expected", [("src/*", "src/a/b.py", True), ("*.py", "a/b.py", True), ("src", "src/a", False), ("a[!b]c", "axc", True), ("a[!b]c", "abc", False), ("a?c", "a/c", True)])
def test_exclude_dialect(pattern, path, expected):
    assert matches(exclude_regex(pattern), path) is expected


@pytest.mark.parametrize("pattern,path,expected", [("src", "src/a", True), ("src/", "src/a/b", True), ("src", "srcs/a", False), ("src/*.py", "src/x/a.py", True)])
def test_target_dialect(pattern, path, expected):
    assert matches(target_regex(pattern), path) is expected


@pytest.mark.parametrize("pattern,path,expected", [("*.min.js", "a/b.min.js", True), ("dist", "dist/a.js", False), ("/dist/**", "dist/a.js", True), ("a/b", "x/a/b", False)])
def test_attribute_dialect(pattern, path, expected):
    assert matches(attribute_regex(pattern), path) is expected


def test_support():
    assert rule_supported("/a") and not rule_supported("!a") and not rule_supported("a[b]")


names = st.text("ab.*", min_size=1, max_size=4).filter(lambda s: "**" not in s)


@settings(max_examples=200, derandomize=True)
@given(st.lists(names, min_size=1, max_size=3), st.lists(st.text("ab.", min_size=1, max_size=4), min_size=1, max_size=4))
def test_anchored_rules_match_a_prefix_of_components(pattern, path):
    from fnmatch import fnmatchcase

    rule, text = "/" + "/".join(pattern), "/".join(path)
    fits = len(path) >= len(pattern) and all(fnmatchcase(p, q) for p, q in zip(path, pattern))
    expected = fits and (pattern[-1] != "*" or len(path) == len(pattern))
    assert matches(rule_regex(rule), text) is expected
