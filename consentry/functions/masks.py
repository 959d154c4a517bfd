"""Column masks. Null, empty and already redacted values pass through unchanged."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from consentry.functions.text import squeeze
from consentry.spec import REDACTED


def _unless_hidden(c: Column, masked: Column, redacted: str) -> Column:
    return F.when((c != "") & (c != redacted), masked).otherwise(c)


def mask_name(c: Column, redacted: str = REDACTED) -> Column:
    """``Jane Achieng`` -> ``J. Ach***``; a single word keeps its first two characters."""
    def masked(words: Column) -> Column:
        space = F.instr(words, F.lit(" "))
        many = F.concat(
            F.substring(words, 1, 1), F.lit(". "), words.substr(space + 1, F.lit(3)), F.lit("***")
        )
        one = F.concat(F.substring(c, 1, 2), F.lit("***"))
        return F.when(space > 0, many).otherwise(one)

    # A lambda over one value: the squeezed name is computed once, not wherever it is used.
    once = F.get(F.transform(F.array(squeeze(c)), masked), F.lit(0))
    return _unless_hidden(c, once, redacted)


def mask_national_id(c: Column, redacted: str = REDACTED) -> Column:
    return _unless_hidden(c, F.concat(F.lit("*****"), F.right(c, F.lit(3))), redacted)


def mask_email(c: Column, redacted: str = REDACTED) -> Column:
    """A value without ``@`` keeps its first two characters and an empty host."""
    masked = F.concat(
        F.substring(F.split_part(c, F.lit("@"), F.lit(1)), 1, 2),
        F.lit("***@"),
        F.split_part(c, F.lit("@"), F.lit(2)),
    )
    return _unless_hidden(c, masked, redacted)


def mask_phone(c: Column, redacted: str = REDACTED) -> Column:
    masked = F.concat(F.substring(c, 1, 4), F.lit(" *** *** "), F.right(c, F.lit(2)))
    return _unless_hidden(c, masked, redacted)


MASKS: dict[str, Callable[..., Column]] = {
    "full_name": mask_name,
    "national_id": mask_national_id,
    "email": mask_email,
    "phone": mask_phone,
}
