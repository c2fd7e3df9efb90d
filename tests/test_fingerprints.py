import hashlib
import random

from pyspark.sql import functions as F

from twinsift.functions import fingerprints as fp
from workload import derived


def expected_samples(data, k):
    if len(data) <= k:
        return list(data) + [data[-1]] * (k - len(data))
    return [data[min(int(i * (len(data) / k)), len(data) - 1)] for i in range(k)]


def expected_dhash(data):
    if not data:
        return "0" * 16
    s = expected_samples(data, 65)
    return f"{int(''.join('1' if a > b else '0' for a, b in zip(s, s[1:])), 2):016x}"


def expected_phash(data):
    if not data:
        return "0" * 16
    s = expected_samples(data, 64)
    mean = sum(s) / 64
    return f"{int(''.join('1' if v >= mean else '0' for v in s), 2):016x}"


def contents():
    rng = random.Random(7)
    out = [b"", b"\x00", b"\xff", b"X" * 512, b"X" * 500 + b"Y" * 12]
    for size in (1, 2, 63, 64, 65, 66, 127, 128, 129, 130, 4097, 70_001):
        out.append(rng.randbytes(size))
        out.append(bytes(rng.choice((0, 127, 128, 255)) for _ in range(size)))
    return out


def test_prints_match_an_independent_version(spark):
    data = contents()
    df = spark.createDataFrame(list(enumerate(data)), "file_id long, content binary")
    got = {}
    for file_id, kind, value in fp.fingerprint(df).collect():
        got[file_id, kind] = value
    for i, content in enumerate(data):
        assert got[i, "blake3_full"] == hashlib.sha256(content).hexdigest()
        assert got[i, "dhash64"] == expected_dhash(content), len(content)
        assert got[i, "phash64"] == expected_phash(content), len(content)


def test_constant_file_has_all_bits_set(spark):
    df = spark.createDataFrame([(bytearray(b"a" * 300),)], "content binary")
    assert df.select(fp.phash64(F.col("content"))).first()[0] == "f" * 16


def test_samples(spark):
    data = contents()[5:]
    df = spark.createDataFrame(list(enumerate(data)), "id long, content binary")
    for k in (64, 65):
        for i, got in df.select("id", fp.sample_bytes(F.col("content"), k)).collect():
            assert got == expected_samples(data[i], k)


def test_hamming_of_hex(spark):
    df = spark.createDataFrame(
        [("0", "0"), ("f", "0"), ("ff", "0f"), ("f" * 16, "0" * 16), ("8" + "0" * 15, "0")], "a string, b string"
    )
    assert [r[0] for r in df.select(fp.hamming_hex(F.col("a"), F.col("b"))).collect()] == [0, 4, 4, 64, 1]


def test_hex_round_trip(spark):
    texts = ["0" * 16, "f" * 16, "8000000000000000", "7fffffffffffffff", "0123456789abcdef"]
    df = spark.createDataFrame([(t,) for t in texts], "h string")
    assert [r[0] for r in df.select(fp.to_hex64(fp.from_hex64(F.col("h")))).collect()] == texts


def test_a_table_in_many_pieces_is_hashed_where_it_is_read(spark, tmp_path):
    """Only a table in few pieces is spread first; either way the rows are the same."""
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    pieces = {"few": 1, "many": 3 * spark.sparkContext.defaultParallelism}
    found, shuffled = {}, {}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        for name, n in pieces.items():
            docs.repartition(n).write.parquet(f"{tmp_path}/{name}/documents.parquet")
            got = derived.contents(spark, f"{tmp_path}/{name}")
            shuffled[name] = "Exchange" in got._jdf.queryExecution().executedPlan().toString()
            found[name] = sorted(map(tuple, got.collect()))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert shuffled == {"few": True, "many": False}
    assert len(found["few"]) == 60 and found["few"] == found["many"]
