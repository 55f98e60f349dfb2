import pytest

from siftlog.errors import InvalidPattern
from siftlog.functions.dialect import checked_java_regex, glob_to_regex, ignores_final_newline


def finds(spark, pattern, text, case_sensitive=True):
    java = checked_java_regex(pattern, case_sensitive)
    return spark._jvm.java.util.regex.Pattern.compile(java).matcher(text).find()


@pytest.mark.parametrize("pattern, text, expected", [
    ("a$", "a\n", False), ("(?m)a$", "a\nb", True), ("(?m)^$", "a\n", True), ("(?m)^b", "a\nb", True),
    ("^b", "a\nb", False), (r"a\z", "a", True), (r"\Aa", "a", True),
    (".", "\n", False), (".", "\r", True), (".", " ", True), ("(?s).", "\n", True), ("(?s:.)", "\n", True),
    (r"^\w$", "é", True), (r"^\d$", "٣", True), (r"^\s$", " ", True), (r"(?-u:^\w$)", "é", False),
    ("(?i)É", "é", True), ("(?i:a)B", "Ab", False), ("(?i:a)b", "Ab", True), ("a(?i)b|c", "C", True),
    ("(?P<n>a)b", "ab", True), ("(?<n_1>a)b", "ab", True), ("(?:a|b)+c", "abc", True),
    ("^[[:alpha:]]$", "é", False), ("^[[:alpha:]]$", "e", True), ("^[[:^alpha:]]$", "é", True),
    ("^[[:word:][:space:]-]+$", "a_ -\t", True), ("^[[:punct:]]+$", "!/:@[`{~]^-", True),
    ("^[a-z&&[^aeiou]]$", "e", False), ("^[a-z&&[^aeiou]]$", "f", True), ("^[a-z--aeiou]$", "e", False),
    ("^[a-z--aeiou]$", "f", True), ("^[ab~~bc]$", "b", False), ("^[ab~~bc]$", "c", True),
    ("^[^a-z--aeiou]$", "e", True), ("^[^a-z--aeiou]$", "f", False),
    ("^[]a]+$", "]a", True), ("^[^]a]$", "]", False), ("^[a-]+$", "-a", True), ("^[&~#]+$", "&~#", True),
    (r"^[\]\\\-]+$", "]\\-", True), (r"^[\d\-x]+$", "1-x", True), (r"^[^\W_]$", "é", True),
    (r"^\x41\x{42}C\U00000044$", "ABCD", True), (r"^\v$", "\x0b", True), (r"^\v$", "\r", False),
    (r"^\pL\p{Lu}\p{Greek}\p{^Lu}\P{Lu}$", "éAαaa", True), (r"^\p{Letter}\p{Uppercase_Letter}$", "aA", True),
    (r"^\p{Alphabetic}\p{sc=Latin}\p{gc=Nd}$", "éa1", True), (r"^\p{any}$", "\n", True),
    ("^a++$", "aaa", True), ("^a*+a$", "aaa", True), ("^a{2}+$", "aaaa", True), ("^a{2}{2}$", "aaaa", True),
    ("^a??b", "ab", True), ("(?U)a+", "aa", True), ("(?x) a b # c\n c", "abc", True), (r"(?x)a\ b", "a b", True),
    (r"\bfoo\b", "éfoo", False), (r"\b{start}a\b{end}", "x a", True), (r"\<a\>", "ba", False),
    (r"a\.b\-\#\ \/", "a.b-# /", True), ("}]", "}]", True), ("x|", "q", True), ("()", "", True),
])
def test_regex_meaning(spark, pattern, text, expected):
    assert finds(spark, pattern, text) is expected


@pytest.mark.parametrize("pattern", [
    "(?=a)", "(?!a)", "(?<=a)", "(?<!a)", "(?>a)", r"(a)\1", r"\k<n>", "(", ")", "a)", "[", "[]", "[^]", "*", "a|*", "(*)",
    "(?i)*", "a{", "a{2,1}", "{2}", r"\Q", r"\Z", r"\h", r"\R", r"\é", "\\", "[b-a]", r"[\d-z]", r"[\b]", "(?P<n>a)(?P<n>b)",
    r"\x{110000}", r"\xZ", r"\p{Nonsense}", "(?z)", r"\0", "(?#c)",
])
def test_invalid_regex(spark, pattern):
    with pytest.raises(InvalidPattern):
        checked_java_regex(pattern)


def test_ignore_case(spark):
    assert finds(spark, "éa", "ÉA", case_sensitive=False)
    assert not finds(spark, "éa", "ÉA")


def test_final_newline():
    for pattern in ("abc", r"^\d{4}-\d\d", r"a.*b|c+", "[a-z]+x", "(a|b)?", r"\bx\b"):
        assert ignores_final_newline(pattern), pattern
    for pattern in ("a$", r"\s", r"\z", "[^a]", "(?s).", r"\n", "\n", r"\W", r"\B", r"[\s]", "a\\"):
        assert not ignores_final_newline(pattern), pattern


@pytest.mark.parametrize("glob, path, expected", [
    ("**/*.log", "a.log", True), ("**/*.log", "/x/y/a.log", True), ("**/*.log", "/x/a.txt", False),
    ("*.log", "/x/y/a.log", True), ("*.err", "/var/log/syslog.err", True), ("syslog", "/var/log/syslog", False),
    ("**/syslog", "/var/log/syslog", True), ("**/skip/**", "/a/skip/d.log", True), ("**/skip/**", "/a/skip", False),
    ("/a/**/b", "/a/b", True), ("/a/**/b", "/a/x/y/b", True), ("/a/**/b", "/ab", False), ("a?c", "a/c", True),
    ("/a**b", "/axxb", True), ("[ab].log", "a.log", True), ("[!ab].log", "a.log", False), ("[^ab].log", "c.log", True),
    ("[]x]", "]", True), ("[a-c]", "b", True), ("{a,b*}.log", "bcd.log", True), ("{a,{b,c}}", "c", True), ("{,a}x", "ax", True),
    (r"a\*b", "a*b", True), (r"a\*b", "axb", False), ("A.log", "a.log", False), ("**", "/x/y", True), ("a.b", "axb", False),
    ("*", "a\nb", True),
])
def test_glob_meaning(spark, glob, path, expected):
    assert spark._jvm.java.util.regex.Pattern.compile(glob_to_regex(glob)).matcher(path).find() is expected


@pytest.mark.parametrize("glob", ["[a", "{a", "a}", "a\\", "[b-a]", "[", "[]"])
def test_invalid_glob(glob):
    with pytest.raises(InvalidPattern):
        glob_to_regex(glob)
