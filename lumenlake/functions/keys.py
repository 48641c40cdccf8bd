"""Keys of cached answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_key(arguments: dict[str, Column]) -> Column:
    """SHA-256 of the arguments as JSON in order of their names, whatever order they are given in; an argument of null counts as null."""
    return F.sha2(F.to_json(F.struct(*[arguments[name].alias(name) for name in sorted(arguments)]), {"ignoreNullFields": "false"}), 256)
