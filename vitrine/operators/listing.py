"""Raw pages to snapshots and entries."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.functions import fingerprints as fp
from vitrine.functions import html as H
from vitrine.functions.urls import base_directory, split_url
from vitrine.sources.tables import materialized


def with_listing(pages: DataFrame, fields: tuple[str, ...] = H.FIELDS) -> DataFrame:
    """Pages (``url``, ``html``) with ``listing_entries`` (of ``fields``) and the cleaned markup."""
    return (
        pages.withColumn("_clean", H.visible(F.col("html")))
        .withColumn("_base", split_url(F.col("url")))
        .withColumn("_directory", base_directory(F.col("_base")))
        .withColumn(
            "listing_entries", H.listing_entries(F.col("_clean"), F.col("_base"), F.col("_directory"), fields)
        )
        .drop("_base", "_directory")
    )


def explode_entries(snapshots: DataFrame, key: str = "snapshot_id") -> DataFrame:
    """Stored listings to one row per entry, with its position."""
    # the outer form: the plain one also infers a filter on the array, which would
    # parse each page a second time
    rows = snapshots.select(key, F.posexplode_outer("listing_entries").alias("pos", "entry"))
    return rows.filter("pos is not null").select(key, "pos", "entry.*")


def extract_entries(pages: DataFrame, fields: tuple[str, ...] = H.FIELDS) -> DataFrame:
    """One row per listing entry of each page, in page order.

    An array is built whole: a reader that wants some ``fields`` only says so here.
    """
    return explode_entries(with_listing(pages.select("page_id", "url", "html"), fields), "page_id")


def validate_listing(pages: DataFrame) -> DataFrame:
    """Title and whether the page is a directory listing at all."""
    titled = pages.withColumn("_clean", H.visible(F.col("html"))).withColumn(
        "title", H.page_title(F.col("_clean"))
    )
    return titled.select(
        "page_id",
        "title",
        H.is_listing(F.col("_clean"), F.col("title")).alias("is_open_dir"),
    )


def with_server_kind(pages: DataFrame) -> DataFrame:
    """Adds ``server_kind``."""
    return (
        pages.withColumn("_clean", H.visible(F.col("html")))
        .withColumn("server_kind", H.server_kind(F.col("html"), F.col("_clean")))
        .drop("_clean")
    )


def with_template_hash(pages: DataFrame) -> DataFrame:
    """Adds ``template_sha256``."""
    return pages.withColumn("template_sha256", fp.template_hash(F.col("html")))


def template_hashes(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """``key, template_sha256`` of each page, the tags of each distinct sequence folded once.

    Pages of one server differ in names and dates, seldom in tags. Tags and hashes are
    written, so each page is read and each sequence folded once; few and short sequences
    are long work, so they are dealt to all cores. Repeated rows and keys are kept, null
    pages have no hash.
    """
    tagged = materialized(pages.select(key, fp.tag_text(F.col("html")).alias("_tags")))
    cores = pages.sparkSession.sparkContext.defaultParallelism
    kinds = tagged.select("_tags").distinct().repartition(cores * 4, "_tags")
    hashed = materialized(kinds.select(F.sha2("_tags", 256).alias("_kind"), fp.tags_hash(F.col("_tags")).alias("template_sha256")))
    return tagged.select(key, F.sha2("_tags", 256).alias("_kind")).join(hashed, "_kind", "left").select(key, "template_sha256")


def snapshots_from_pages(pages: DataFrame) -> DataFrame:
    """Derived snapshot rows; the raw page is hashed and not kept.

    A map-only job: every column comes from the page's own row.
    """
    parsed = with_listing(pages).withColumn("_title", H.page_title(F.col("_clean")))
    return with_template_hash(parsed).select(
        "page_id",
        F.col("url").alias("final_url"),
        F.col("_title").alias("title"),
        H.is_listing(F.col("_clean"), F.col("_title")).alias("is_open_dir"),
        H.server_kind(F.col("html"), F.col("_clean")).alias("server_kind"),
        "listing_entries",
        F.size("listing_entries").cast("bigint").alias("entry_count"),
        fp.body_hash(F.col("html")).alias("raw_html_sha256"),
        "template_sha256",
    )
