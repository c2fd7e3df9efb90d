import os
import time

from tests.helpers import listing, rows
from twinsift.schemas import LISTING
from twinsift.sources.folder_source import stream_folders
from twinsift.streaming.listings import create_index, index_batch, index_stream, read_index


def seen(spark, path, job_root=1):
    info = os.stat(path)
    return listing(spark, dict(abs_path=str(path), root_id=job_root, size_bytes=info.st_size, mtime_epoch_ns=info.st_mtime_ns))


def test_arriving_listings_update_the_index(spark, tmp_path):
    a, b = tmp_path / "a.txt", tmp_path / "b.txt"
    a.write_bytes(b"alpha")
    b.write_bytes(b"beta")
    base, inbox = str(tmp_path / "index"), str(tmp_path / "inbox")
    create_index(spark, base)
    seen(spark, a).write.parquet(inbox)

    def run():
        stream = spark.readStream.schema(LISTING).parquet(inbox)
        index_stream(stream, base, str(tmp_path / "state"), availableNow=True).awaitTermination(120)
        return read_index(spark, base)

    files, hashes = run()
    assert rows(files.select("file_id", "file_name", "first_seen_job_id"), "file_id") == [(1, "a.txt", "stream-0")]
    first = rows(hashes, "file_id", "hash_type")
    assert len(first) == 3

    a.write_bytes(b"alpha!")
    seen(spark, a).unionByName(seen(spark, b)).write.mode("append").parquet(inbox)
    files, hashes = run()
    assert rows(files.select("file_id", "file_name", "size_bytes", "last_seen_job_id"), "file_id") == [
        (1, "a.txt", 6, "stream-1"), (2, "b.txt", 4, "stream-1"),
    ]
    assert hashes.count() == 6 and rows(hashes, "file_id", "hash_type")[:3] != first


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    a = tmp_path / "a.txt"
    a.write_bytes(b"alpha")
    base = str(tmp_path / "index")
    create_index(spark, base)
    index_batch(seen(spark, a), base, 0, "s-0")
    files, hashes = read_index(spark, base)
    once = rows(hashes, "file_id", "hash_type")
    index_batch(seen(spark, a), base, 0, "s-0")
    files, hashes = read_index(spark, base)
    assert rows(hashes, "file_id", "hash_type") == once and len(once) == 3
    assert files.count() == 1


def test_a_batch_writes_only_what_it_saw(spark, tmp_path):
    a, b = tmp_path / "a.txt", tmp_path / "b.txt"
    a.write_bytes(b"alpha")
    b.write_bytes(b"beta")
    base = str(tmp_path / "index")
    create_index(spark, base)
    index_batch(seen(spark, a).unionByName(seen(spark, b)), base, 0, "s-0")
    index_batch(seen(spark, b), base, 1, "s-1")
    stored = lambda name: spark.read.parquet(f"{base}/{name}").groupBy("batch").count()
    assert rows(stored("files"), "batch") == [(0, 2), (1, 1)]
    # The unchanged file is seen again but not read again.
    assert rows(stored("file_hashes"), "batch") == [(0, 6)]
    files, hashes = read_index(spark, base)
    assert rows(files.select("file_id", "last_seen_job_id"), "file_id") == [(1, "s-0"), (2, "s-1")]
    assert hashes.count() == 6 and read_index(spark, base, before=0)[0].count() == 0
    copy = str(tmp_path / "copy")
    create_index(spark, copy, files, hashes)
    again = read_index(spark, copy)
    assert rows(again[0], "file_id") == rows(files, "file_id") and again[1].count() == 6


def test_a_stream_of_folders_brings_each_change_once(spark, tmp_path):
    inbox = tmp_path / "in" / "deep"
    inbox.mkdir(parents=True)
    (inbox / "a.txt").write_bytes(b"alpha")
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def run():
        time.sleep(0.1)
        listed = stream_folders(spark, {1: str(tmp_path / "in")}, settle_ms=0)
        query = listed.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out)
        assert query.awaitTermination(120)
        return rows(spark.read.schema(LISTING).parquet(out).select("rel_path", "size_bytes"), "rel_path", "size_bytes")

    assert run() == [("deep/a.txt", 5)]
    assert run() == [("deep/a.txt", 5)]
    (inbox / "a.txt").write_bytes(b"alpha!")
    (tmp_path / "in" / "b.txt").write_bytes(b"b")
    assert run() == [("b.txt", 1), ("deep/a.txt", 5), ("deep/a.txt", 6)]


def test_a_stream_of_folders_feeds_the_index(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_bytes(b"alpha")
    base = str(tmp_path / "index")
    create_index(spark, base)
    time.sleep(0.1)
    listed = stream_folders(spark, {1: str(tmp_path / "in")}, settle_ms=0)
    index_stream(listed, base, str(tmp_path / "state"), availableNow=True).awaitTermination(120)
    files, hashes = read_index(spark, base)
    assert rows(files.select("file_id", "file_name"), "file_id") == [(1, "a.txt")] and hashes.count() == 3
