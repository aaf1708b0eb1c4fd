"""Text functions as Column expressions that more than one operator takes."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F


def lowered(word: Column) -> Column:
    """A-Z in lower case and nothing else; text of ASCII alone takes the quick way."""
    plain = F.octet_length(word) == F.length(word)
    return F.when(plain, F.lower(word)).otherwise(F.translate(word, string.ascii_uppercase, string.ascii_lowercase))
