"""The verdict: severity-ordered rules over features, first match wins."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.functions import patterns as P
from vitrine.operators.features import extract_features

_FEATURES = [
    "entry_count", "file_count", "dir_count", "mirror_files", "mirror_ratio",
    "sensitive_hits", "payload_hits", "top_exts", "server_kind", "cert_self_signed",
]


def _total(hits: Column, categories) -> Column:
    total = F.lit(0)
    for category in categories:
        total = total + hits[category]
    return total


def confidence_col(base: float, hits: Column, cap: float = 0.95) -> Column:
    return F.least(F.lit(base) + F.lit(0.1) * hits, F.lit(cap))


def reasons_col(hits: Column, categories: list[str]) -> Column:
    """The categories with a hit, in the given order."""
    return F.array_compact(F.array(*[F.when(hits[c] >= 1, F.lit(c)) for c in categories]))


def verdict(sensitive: Column, payload: Column, mirror_ratio: Column, file_count: Column) -> Column:
    """Label, confidence and reasons as one struct."""
    def outcome(label: str, confidence: Column, reasons: Column) -> Column:
        return F.struct(
            F.lit(label).alias("label"), confidence.alias("confidence"), reasons.alias("reasons")
        )

    sentence = lambda text: F.array(F.lit(text))
    return (
        F.when(
            (payload["webshell"] >= 1) | (payload["malware_tool"] >= 1),
            outcome("malicious_staging",
                    confidence_col(0.6, _total(payload, P.MALICIOUS_CATEGORIES)),
                    reasons_col(payload, P.MALICIOUS_CATEGORIES)),
        )
        .when(
            _total(sensitive, P.TRIGGER_CATEGORIES) >= 1,
            outcome("sensitive_exposure",
                    confidence_col(0.6, _total(sensitive, P.SENSITIVE)),
                    reasons_col(sensitive, P.TRIGGER_CATEGORIES)),
        )
        .when(
            (_total(payload, P.PAYLOAD) >= 1) & (mirror_ratio < 0.6),
            outcome("sensitive_exposure", F.lit(0.5), sentence(P.REASON_WEAK)),
        )
        .when(
            (mirror_ratio >= 0.6) & (file_count >= 3),
            outcome("intentional_public", F.lit(0.7), sentence(P.REASON_MIRROR)),
        )
        .otherwise(outcome("benign_index", F.lit(0.5), sentence(P.REASON_BENIGN)))
    )


def classify(features: DataFrame, ruleset_version: str = P.RULESET_VERSION) -> DataFrame:
    """Adds label, confidence, reasons and both version stamps to features."""
    decided = features.withColumn(
        "_verdict",
        verdict(F.col("sensitive_hits"), F.col("payload_hits"),
                F.col("mirror_ratio"), F.col("file_count")),
    )
    keep = [c for c in features.columns if c not in ("label", "confidence", "reasons",
                                                     "extractor_version", "ruleset_version")]
    extractor = (
        F.coalesce("extractor_version", F.lit(P.EXTRACTOR_VERSION))
        if "extractor_version" in features.columns
        else F.lit(P.EXTRACTOR_VERSION)
    )
    return decided.select(
        *keep, "_verdict.*",
        extractor.alias("extractor_version"),
        F.lit(ruleset_version).alias("ruleset_version"),
    )


def classify_snapshots(snapshots: DataFrame, entries: DataFrame, exts: int | None = P.TOP_EXTS) -> DataFrame:
    """Features and verdict of every snapshot given."""
    return classify(extract_features(snapshots, entries, exts))


def pending_snapshots(
    snapshots: DataFrame,
    classifications: DataFrame,
    limit: int | None = None,
    ruleset_version: str = P.RULESET_VERSION,
) -> DataFrame:
    """Open directories with no verdict at this ruleset, oldest first."""
    done = classifications.filter(F.col("ruleset_version") == ruleset_version).select("snapshot_id")
    pending = snapshots.filter("is_open_dir").join(done, "snapshot_id", "left_anti")
    if limit is None:
        return pending
    return pending.orderBy("fetched_at", "snapshot_id").limit(limit)


def merged_pending(
    pending: DataFrame, snapshots: DataFrame, classifications: DataFrame, ruleset_version: str = P.RULESET_VERSION
) -> DataFrame:
    """``snapshot_id, fetched_at`` of open directories without a verdict, from the stored ones and what is new.

    ``pending`` is the result of an earlier run, ``snapshots`` and ``classifications`` the rows
    added since. History is not read: a verdict can only be on a snapshot that is stored as
    pending or new, if each verdict is added in the batch of its snapshot or later.
    """
    columns = ["snapshot_id", "fetched_at"]
    both = pending.select(*columns).unionByName(snapshots.filter("is_open_dir").select(*columns)).distinct()
    done = classifications.filter(F.col("ruleset_version") == ruleset_version).select("snapshot_id")
    return both.join(done, "snapshot_id", "left_anti")


def classify_pending(
    snapshots: DataFrame,
    classifications: DataFrame,
    entries: DataFrame,
    limit: int | None = None,
    exts: int | None = P.TOP_EXTS,
) -> DataFrame:
    """New classification rows to append; empty when nothing is pending. Without ``exts`` entries are grouped once, by snapshot."""
    pending = pending_snapshots(snapshots, classifications, limit)
    wanted = entries.join(pending.select("snapshot_id"), "snapshot_id", "left_semi")
    return classification_rows(classify_snapshots(pending, wanted, exts))


def classification_rows(classified: DataFrame, classified_at: Column | None = None) -> DataFrame:
    """Classified features in the shape of the classifications table."""
    at = F.current_timestamp() if classified_at is None else classified_at
    features = [c for c in _FEATURES if c in classified.columns]
    return classified.select(
        "snapshot_id", "label", "confidence", "reasons",
        F.struct(*features).alias("features"),
        "extractor_version", "ruleset_version", at.alias("classified_at"),
    )


def reclassify(classifications: DataFrame, ruleset_version: str) -> DataFrame:
    """Stored features judged again under another version, as rows to append."""
    flat = classifications.select("snapshot_id", "features.*", "extractor_version")
    return classification_rows(classify(flat, ruleset_version))


def label_distribution(classifications: DataFrame) -> DataFrame:
    return classifications.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def goldset_eval(cases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accuracy and confusion matrix of ``expected`` against ``label``."""
    accuracy = cases.agg(
        F.count(F.lit(1)).alias("cases"),
        F.count_if(F.col("expected") == F.col("label")).alias("correct"),
        F.avg((F.col("expected") == F.col("label")).cast("double")).alias("accuracy"),
    )
    matrix = cases.groupBy("expected").pivot("label", P.LABELS).agg(F.count(F.lit(1)))
    return accuracy, matrix.na.fill(0)
