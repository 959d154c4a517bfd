"""Text clean-up as Column expressions; no Python runs per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Unicode calls white space, of which the ASCII space is only one.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# Most characters are told from blanks by one range, before the list is walked.
_BLANK_RUN = f"[[^!-~]&&[{BLANKS}]]+"
_PLAIN_WORDS = "^[A-Za-z]+( [A-Za-z]+)*$"
_PRINTABLE = "^[ -~]*$"
# Between a character that is no letter and a letter; the mark is not printable.
_WORD_START, _MARK = "(?<=[^A-Za-z])(?=[A-Za-z])", "\x01 "
# Runs of cased letters alternate with runs of everything else.
_RUNS = r"([\p{Lu}\p{Ll}\p{Lt}]+|[^\p{Lu}\p{Ll}\p{Lt}]+)"


def _starts_printable(c: Column) -> Column:
    """Whether the first byte is a printable ASCII character other than the space."""
    return (c >= "!") & (c < "\x7f")


def strip(c: Column) -> Column:
    """Without white space of any kind at the ends. A native trim: no regular expression runs. It
    searches the list of blanks at both ends, so text with printable ends is passed over."""
    clean = _starts_printable(c) & _starts_printable(F.substring(c, -1, 1))
    return F.when(clean, c).otherwise(F.trim(c, F.lit(BLANKS)))


def squeeze(c: Column) -> Column:
    """Strip, and turn each inner run of blanks into one space."""
    return F.regexp_replace(strip(c), _BLANK_RUN, " ")


def blank_to_null(c: Column) -> Column:
    return F.when(_starts_printable(c), c).when(F.trim(c, F.lit(BLANKS)) != "", c)


def title(c: Column) -> Column:
    """A capital after every character that is not a cased letter: ``O'Brien``, ``3Rd``.

    ``initcap`` gives that only for plain words between spaces, the usual case. Other printable
    ASCII text gets a mark that ends a word before each such letter, and loses it again. Only the
    rest is walked over run by run, in a lambda that Spark does not compile.
    """
    marked = F.initcap(F.regexp_replace(c, _WORD_START, _MARK))
    by_run = F.array_join(
        F.transform(
            F.regexp_extract_all(c, F.lit(_RUNS), F.lit(1)),
            lambda run: F.concat(
                F.upper(F.substring(run, 1, 1)), F.lower(run.substr(F.lit(2), F.length(run)))
            ),
        ),
        "",
    )
    return (
        F.when(c.rlike(_PLAIN_WORDS), F.initcap(c))
        .when(c.rlike(_PRINTABLE), F.replace(marked, F.lit(_MARK), F.lit("")))
        .otherwise(by_run)
    )


def title_name(c: Column) -> Column:
    return title(squeeze(c))


def compact(c: Column) -> Column:
    """Without ASCII spaces anywhere and without other blanks at the ends."""
    return strip(F.replace(c, F.lit(" "), F.lit("")))


def international(digits: Column) -> Column:
    """Kenyan local forms to ``+254…``; anything else stays."""
    rest = digits.substr(F.lit(2), F.length(digits))
    return (
        F.when(digits.startswith("07") | digits.startswith("01"), F.concat(F.lit("+254"), rest))
        .when(digits.startswith("7") | digits.startswith("1"), F.concat(F.lit("+254"), digits))
        .otherwise(digits)
    )


def phone_e164(c: Column) -> Column:
    return international(compact(c))


def email(c: Column) -> Column:
    return F.lower(strip(c))


def matched_name(key: Column, original: Column, names: tuple[str, ...]) -> Column:
    """The listed name whose lower-case form is ``key``, else ``original``."""
    return F.coalesce(*[F.when(key == name.lower(), F.lit(name)) for name in names], original)


def canonical(c: Column, names: tuple[str, ...]) -> Column:
    """The listed name that equals ``c`` but for case and outer blanks; ``c`` itself if none."""
    return matched_name(F.lower(strip(c)), c, names)


def aliased(titled: Column, aliases: dict[str, str]) -> Column:
    return F.coalesce(
        *[F.when(F.lower(titled) == alias, F.lit(name)) for alias, name in aliases.items()], titled
    )


def region(c: Column, aliases: dict[str, str]) -> Column:
    return aliased(title(strip(c)), aliases)


def contains_any(c: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | c.contains(word)
    return found


def first_contained(c: Column, names: tuple[str, ...]) -> Column:
    """The first listed name whose lower-case form occurs in ``c``, else null."""
    return F.coalesce(*[F.when(c.contains(name.lower()), F.lit(name)) for name in names])
