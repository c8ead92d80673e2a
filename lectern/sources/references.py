"""References to remote sources, classified as a column job."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions import text as tx

# Formats taken in, and paths of shared documents.
SUPPORTED = ("txt", "fb2", "pdf", "epub", "zip")
DRIVE_PATHS = r"/(?:file|document|spreadsheets|presentation)/d/([a-zA-Z0-9_-]{10,})"


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def provider(url: Column) -> Column:
    h = host(url)
    return (
        F.when(F.startswith(url, F.lit("gs://")), "gcs")
        .when(F.endswith(h, F.lit("drive.google.com")) | F.endswith(h, F.lit("docs.google.com")), "gdrive")
        .when((h == "storage.googleapis.com") | F.endswith(h, F.lit(".storage.googleapis.com")) | (h == "storage.cloud.google.com"), "gcs")
        .when(url.rlike("^https?://"), "http")
        .otherwise("unknown")
    )


def bucket_object(url: Column) -> Column:
    """struct<bucket, object> of a bucket reference, null fields where it is not one."""
    h, p = host(url), F.regexp_replace(path(url), "^/+", "")
    sub = F.endswith(h, F.lit(".storage.googleapis.com"))
    whole = F.when(F.startswith(url, F.lit("gs://")), F.substring(url, 6, 1 << 30)).when(h.isin("storage.googleapis.com", "storage.cloud.google.com"), p)
    bucket = F.when(sub, F.regexp_replace(h, r"\.storage\.googleapis\.com$", "")).otherwise(F.regexp_extract(whole, "^([^/]+)/.+", 1))
    obj = F.when(sub, p).otherwise(F.regexp_extract(whole, "(?s)^[^/]+/(.+)", 1))
    return F.struct(F.nullif(bucket, F.lit("")).alias("bucket"), F.nullif(obj, F.lit("")).alias("object"))


def drive_id(url: Column) -> Column:
    asked = F.regexp_extract(url, r"[?&]id=([^&#]+)", 1)
    return F.coalesce(F.nullif(asked, F.lit("")), F.nullif(F.regexp_extract(url, DRIVE_PATHS, 1), F.lit("")))


def file_name(url: Column) -> Column:
    """Last path part, percent-decoded; null when there is none."""
    p = F.regexp_replace(path(url), "/+$", "")
    return F.nullif(F.try_url_decode(F.replace(F.element_at(F.split(p, "/"), -1), F.lit("+"), F.lit("%2B"))), F.lit(""))


def disposition_name(header: Column) -> Column:
    star = F.regexp_extract(header, r"filename\*=UTF-8''([^;]+)", 1)
    plain = F.btrim(F.regexp_extract(header, r'filename="?([^";]+)"?', 1))
    return F.coalesce(F.btrim(F.try_url_decode(F.nullif(star, F.lit(""))), F.lit('"')), F.nullif(plain, F.lit("")))


def supported_name(name: Column, content_type: Column, fallback: str = "cloud_asset") -> Column:
    """The name, with an extension guessed from the content type when its own is not supported."""
    name = F.coalesce(F.nullif(tx.strip(name), F.lit("")), F.lit(fallback))
    kind = tx.strip(F.substring_index(content_type, ";", 1))
    guess = (F.when(kind == "text/plain", ".txt").when(kind == "application/pdf", ".pdf").when(kind == "application/epub+zip", ".epub")
             .when(kind == "application/zip", ".zip"))
    ext = F.lower(F.regexp_extract(name, r"(?<=[^/])(\.[^./]+)$", 1))
    known = ext.isin(*[f".{e}" for e in SUPPORTED])
    return F.when(known | guess.isNull(), name).when(ext == "", F.concat(name, guess)).otherwise(F.concat(F.regexp_replace(name, r"\.[^.]*$", ""), guess))
