"""Columns over one file name: allowlist, alarm, notability."""
from pyspark.sql import Column
from pyspark.sql import functions as F

from vitrine.functions import patterns as P
from vitrine.functions.matching import any_category


def extension(name: Column) -> Column:
    """Lower-cased text from the last dot on; empty without a dot."""
    low = F.lower(name)
    return F.when(low.contains("."), F.concat(F.lit("."), F.substring_index(low, ".", -1))).otherwise("")


def is_web_shell(name: Column) -> Column:
    """A web script whose name is that of a shell or backdoor."""
    return extension(name).isin(P.WEB_SCRIPT_EXTS) & F.lower(name).rlike(P.WEBSHELL_NAME)


def is_payload(name: Column) -> Column:
    """Safe to hash: an allowlisted executable or script, or a web shell."""
    return extension(name).isin(P.PAYLOAD_EXTS) | is_web_shell(name)


def is_alarm(name: Column, malicious: Column) -> Column:
    """A web shell, or a file whose hash is reported malicious."""
    return is_web_shell(name) | (F.coalesce(malicious, F.lit(0)) > 0)


def file_rank(name: Column, size: Column, malicious: Column) -> Column:
    """Notability, 0 first: alarm, telling name, program, large file, rest."""
    return (
        F.when(is_payload(name) & is_alarm(name, malicious), 0)
        .when(any_category(name, P.INTEREST), 1)
        .when(is_payload(name), 2)
        .when(F.coalesce(size, F.lit(0)) >= P.BIG_FILE_BYTES, 3)
        .otherwise(4)
    )
