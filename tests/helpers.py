"""Small tables in the shapes of the data model."""

from pyspark.sql import functions as F

from twinsift import schemas


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def files(spark, *entries):
    """Files from dicts; every attribute has a default."""
    default = dict(
        root_id=1, extension=None, mime_type=None, size_bytes=1, mtime_epoch_ns=123, ctime_epoch_ns=None,
        inode=None, dev=None, width=None, height=None, exif_datetime_original=None, exif_make=None,
        exif_model=None, first_seen_job_id=None, last_seen_job_id=None, is_present=1, updated_at=None,
    )
    full = []
    for e in entries:
        path = e.get("abs_path", f"/nas/photo/{e['file_id']}.jpg")
        named = dict(abs_path=path, rel_path=path.split("/", 3)[-1], file_name=path.rsplit("/", 1)[-1])
        full.append({**default, **named, **e})
    names = schemas.FILES.fieldNames()
    return spark.createDataFrame([tuple(e[n] for n in names) for e in full], schemas.FILES)


def listing(spark, *entries):
    default = dict(root_id=1, size_bytes=1, mtime_epoch_ns=123, ctime_epoch_ns=None, inode=None, dev=None)
    names = schemas.LISTING.fieldNames()
    full = []
    for e in entries:
        path = e["abs_path"]
        full.append({**default, "rel_path": path.lstrip("/"), "file_name": path.rsplit("/", 1)[-1], **e})
    return spark.createDataFrame([tuple(e[n] for n in names) for e in full], schemas.LISTING)


def movements(spark, *entries):
    """(movement_id, file_id, batch_id, from_path, to_path, restored)"""
    df = spark.createDataFrame(
        list(entries), "movement_id long, file_id long, batch_id string, from_path string, to_path string, done boolean"
    )
    at = F.to_timestamp(F.lit("2026-03-13 10:00:00"))
    return df.select(
        "movement_id", "file_id", "batch_id", "from_path", "to_path", at.alias("moved_at"),
        F.when(F.col("done"), at).alias("restored_at"),
    )
