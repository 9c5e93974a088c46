"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _but(excluded: Callable[[str], bool]) -> str:
    """Class of all characters but these of ASCII. They are listed one by one: the regex engine then looks a
    character up in a table, where ranges would be tested in turn (about five times the time of a whole scan)."""
    return "[^" + "".join(f"\\x{code:02X}" for code in range(128) if excluded(chr(code))) + "]"


# Words of the licence scan and of decontamination (letters and digits of ASCII, and
# everything beyond ASCII), in lower-cased texts and in any case, and the white space that separates words elsewhere.
WORD = _but(lambda c: not c.isalnum() or c.isupper()) + "+"
ANY_CASE_LETTER = _but(lambda c: not c.isalnum())
SPACED_WORD = _but(lambda c: c in " \t\n\x0B\f\r") + "+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in ``body`` by name, also within other lambdas."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else. Pure ASCII takes the fast built-in."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def words(text: Column, pattern: str = WORD) -> Column:
    """Array of words of the lower-cased text; null counts as empty."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(pattern), F.lit(0))


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def bounded_sample(df: DataFrame, key: Column, at_most: int) -> DataFrame:
    """About ``at_most`` rows, and never far more, chosen by hash of ``key``: the same rows at each run.

    One count and one filter; nothing is sorted, and rows leave only the tasks that keep them.
    """
    total = df.count()
    share = min(1.0, at_most / max(total, 1))
    return df.filter(F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1_000_000)) < int(share * 1_000_000) + (share >= 1.0))


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, usable: Column, at_most: dict[int, int],
                  key: str = "doc_id", text: str = "text") -> DataFrame:
    """(text, label) of about ``at_most[label]`` labelled rows per label, chosen by hash of the key.

    The sample is drawn from the labels, which are small rows, and then broadcast: its bound is the sum of
    ``at_most``, so the texts are not shuffled. Null keys and labels match nothing; repeated labels count once. A key that
    is there several times gives one text, the least, so that it weighs like any other. Further columns of
    ``docs`` may have any name.
    """
    rows = labels.select(F.col(key).alias("__key"), F.col(label).cast("int").alias("label")).filter(usable).distinct()
    parts = [bounded_sample(rows.filter(F.col("label") == v), F.col("__key"), n) for v, n in at_most.items()]
    chosen = parts[0]
    for part in parts[1:]:
        chosen = chosen.unionByName(part)
    own = docs.select(F.col(f"`{key}`").alias("__doc"), F.col(f"`{text}`").alias("text"))
    return (own.join(F.broadcast(chosen), F.col("__doc") == F.col("__key")).groupBy("__key", "label")
            .agg(F.min("text").alias("text")).select("text", "label"))
