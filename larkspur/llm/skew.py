"""A join that deals the rows of a hot key over several tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tasks that the rows of one key are dealt over.
SALTS = 16


def salt_of(name: str) -> Column:
    """A salt that a row has in every run of its task."""
    return F.pmod(F.xxhash64(name), F.lit(SALTS)).cast("int")


def spread_join(rows: DataFrame, table: DataFrame, key: str, by: str | Column, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``table``, which has one row for each ``key``; ``how`` is ``inner`` or ``left``.

    A row of ``table`` goes only to the salts that its key has in ``rows``, so
    a key of one row costs one copy and a hot key at most ``SALTS``. ``by`` is
    a column of ``rows`` whose hash is the salt, or the salt itself. Rows with
    a null key match nothing; ``_salt`` must not be a column of either side.
    """
    salted = rows.withColumn("_salt", salt_of(by) if isinstance(by, str) else by)
    wanted = salted.select(key, "_salt").distinct().join(table, key)
    return salted.join(wanted, [key, "_salt"], how).drop("_salt")
