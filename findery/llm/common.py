"""What the operators share: scratch tables in the shared folder, and words of a text."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Upper-case ASCII letters become lower case, every ASCII byte that is neither a digit nor a letter a space.
ALNUM_TABLE = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
    for c in range(256)
)

_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def space_words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a UTF-8 text; bytes.split() cuts at exactly those six bytes."""
    return text.split() if text else []


def alnum_words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a UTF-8 text after A-Z became a-z."""
    return text.translate(ALNUM_TABLE).split() if text else []


@lru_cache(maxsize=1)
def _own_root() -> str:
    return tempfile.mkdtemp(prefix="findery-")


def word_slices(text: bytes | None, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of ``space_words`` in lists, of about ``size`` bytes of text each: a long text never lies in memory as words."""
    at, text = 0, text or b""
    while at < len(text):
        end = at + size
        if end < len(text):
            found = _SPACE.search(text, end)
            end = found.start() if found else len(text)
        if own := text[at:end].split():
            yield own
        at = end


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; a folder of our own only where none is set, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = _own_root()
    return root.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_root(spark)}/{what}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession) -> None:
    """Send texts to Python a thousand rows or 16 MB at a time instead of ten thousand rows: long documents must fit in a worker.

    Sets spark.sql.execution.arrow.maxRecordsPerBatch and maxBytesPerBatch of the session where nobody has
    set them; they bound memory and change no result.
    """
    for name, value in (("maxRecordsPerBatch", "1000"), ("maxBytesPerBatch", "16777216")):
        key = f"spark.sql.execution.arrow.{name}"
        if spark.conf.get(key, "1") == "1":
            spark.conf.set(key, value)


def written(df: DataFrame, path: str) -> DataFrame:
    """Write a table and read it again: lineage ends here, and later stages reread it after a lost executor."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, *wanted: str) -> str | list[str]:
    """Column names like ``wanted`` that no column of ``df`` has, however it is cased."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found[0] if len(found) == 1 else found


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value worked out once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Of an array the running combination up to each element, by doubling: as many passes as its length has bits."""

    def double(acc: Column, step: Column) -> Column:
        return F.when(F.size(acc) > step, F.transform(acc, lambda x, i: F.when(i < step, x).otherwise(combine(F.get(acc, i - step), x)))).otherwise(acc)

    return F.aggregate(F.lit([1 << k for k in range(31)]), values, double)
