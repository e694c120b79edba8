"""Hashes of payload files already landed in storage; their bytes are not kept."""
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.functions import patterns as P
from vitrine.functions.files import is_payload


def hash_landed(files: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """``url, name, sha256, md5, size, error`` of allowlisted files (``path, length, content``).

    With ``max_bytes`` a file over it is reported as too large and not hashed.
    """
    named = files.withColumn("name", F.substring_index("path", "/", -1)).filter(is_payload(F.col("name")))
    small = F.lit(True) if max_bytes is None else F.col("length") <= max_bytes
    return named.select(
        F.col("path").alias("url"),
        "name",
        F.when(small, F.sha2("content", 256)).otherwise("").alias("sha256"),
        F.when(small, F.md5("content")).otherwise("").alias("md5"),
        F.when(small, F.col("length")).otherwise(0).alias("size"),
        F.when(small, "").otherwise("too_large").alias("error"),
    )


def _any_case_glob() -> str:
    """Glob of the allowlisted extensions, so other files are not even listed."""
    either = lambda c: f"[{c}{c.upper()}]" if c.isalpha() else c
    exts = P.PAYLOAD_EXTS + P.WEB_SCRIPT_EXTS
    return "*{" + ",".join("".join(either(c) for c in ext) for ext in exts) + "}"


def hash_files(spark: SparkSession, path: str, max_bytes: int | None = None) -> DataFrame:
    """Hash the payload files under ``path``.

    Names are checked before a file is opened, and lengths with ``max_bytes``: the two branches push
    their length filter to the reader, and the large one never reads content.
    """
    def files():
        return (
            spark.read.format("binaryFile")
            .option("pathGlobFilter", _any_case_glob())
            .option("recursiveFileLookup", "true")
            .load(path)
        )

    if max_bytes is None:
        return hash_landed(files())
    small = files().filter(F.col("length") <= max_bytes).select("path", "length", "content")
    large = files().filter(F.col("length") > max_bytes).select(
        "path", "length", F.lit(None).cast("binary").alias("content")
    )
    return hash_landed(small, max_bytes).unionByName(hash_landed(large, max_bytes))
