"""Pattern dictionaries as boolean columns.

Most dictionary patterns are plain suffixes (``\\.pem$``) or plain substrings
(``mimikatz``). Those become ``endswith`` / ``contains``, which are byte
comparisons inside generated code; only the rest is left to the regex engine,
and only for names that hold a substring the pattern cannot do without.
"""
import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitrine.functions.patterns import GUARDS

_PLAIN = re.compile(r"(?:[a-z0-9_\-]|\\\.)+")


def _unescape(pattern: str) -> str:
    return pattern.replace("\\.", ".")


def _either(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def any_match(text: Column, patterns: list[str], guards: list[str] = ()) -> Column:
    """True where any pattern is found in ``text`` (already lower-cased).

    ``guards`` are substrings one of which every regular expression needs; with
    them the regex engine sees only the few names that hold one.
    """
    tests, regexes = [], []
    for pattern in patterns:
        if _PLAIN.fullmatch(pattern):
            tests.append(text.contains(_unescape(pattern)))
        elif pattern.endswith("$") and _PLAIN.fullmatch(pattern[:-1]):
            # `$` also matches in front of one final newline
            suffix = _unescape(pattern[:-1])
            tests.append(text.endswith(suffix) | text.endswith(suffix + "\n"))
        else:
            regexes.append(pattern)
    if regexes:
        found = text.rlike("|".join(f"(?:{p})" for p in regexes))
        held = [text.contains(g) for g in guards]
        tests.append(_either(held) & found if held else found)
    return _either(tests)


def category_tests(name: Column, table: dict[str, list[str]]) -> dict[str, Column]:
    """One boolean column per category of a dictionary, over an entry name."""
    low = F.lower(name)
    return {c: any_match(low, patterns, GUARDS.get(c, ())) for c, patterns in table.items()}


def hit_categories(name: Column, table: dict[str, list[str]]) -> Column:
    """The categories a name falls in, as an array in dictionary order."""
    hits = [F.when(test, F.lit(c)) for c, test in category_tests(name, table).items()]
    return F.array_compact(F.array(*hits))


def any_category(name: Column, table: dict[str, list[str]]) -> Column:
    """True where the name falls in at least one category."""
    return _either(list(category_tests(name, table).values()))
