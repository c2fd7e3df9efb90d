import random

import corpus_pipeline
from twinsift.llm.queries import ORACLES, QUERIES


def test_every_operator_has_a_query():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)


def test_pipeline_over_planted_documents(spark, tmp_path):
    rng = random.Random(23)
    words = [f"{a}{b}" for a in "bdfgklmnprst" for b in ("ane", "oru", "istel", "em", "ala")]
    line = lambda n: " ".join(rng.choices(words, k=n)).capitalize() + "."
    text = lambda: "\n".join(line(12) for _ in range(4))
    clean = [(i, text()) for i in range(120)]
    footer = "All rights kept by the makers of this site"
    footed = [(200 + i, f"{text()}\n{footer}") for i in range(30)]
    base = text()
    near = [(300, base)] + [(301 + i, base.replace(base.split()[5 + 3 * i], "changed", 1)) for i in range(4)]
    item = line(25)
    leaks = [(400 + i, f"{text()}\n{item}") for i in range(3)]
    junk = [(500 + i, " ".join(["BUY!!"] * rng.randrange(30, 60))) for i in range(40)]
    docs = clean + footed + near + leaks + junk + [(600, None), (601, "")]
    spark.createDataFrame(
        [(i, t, "en", f"src{(i or 0) % 4}", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long"
    ).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, line(30))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    labels = [(i, 1, 0) for i, _ in clean] + [(i, 0, 0) for i, _ in junk]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, seen[-1], str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        seen.append(spark.read.parquet(f"{tmp_path}/{name}"))
    for df in seen[1:-1]:
        assert df.dtypes == docs.dtypes
    ids = [{r.doc_id for r in df.collect()} for df in seen]
    good = {i for i, _ in clean} | {i for i, _ in footed}
    assert all(good <= kept for kept in ids)
    assert not {i for i, _ in junk} & ids[1]
    assert all(footer not in r.text for r in seen[2].where("doc_id between 200 and 229").collect())
    assert {i for i, _ in near} & ids[3] == {300}
    assert not {i for i, _ in leaks} & ids[4]
    final = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, final.collect()), key=str) == sorted(map(tuple, seen[-1].collect()), key=str)


def test_near_copies_by_row(spark, tmp_path):
    text = lambda seed: " ".join(random.Random(seed).choices([f"w{i}" for i in range(300)], k=60))
    rows = [(1, text(1)), (2, text(1)), (2, text(2)), (3, text(3)), (3, text(3)), (3, text(4))]
    rows += [(None, text(1)), (None, text(5)), (None, text(5)), (None, text(6)), (7, None), (8, None), (8, "")]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_copies(spark, docs, str(tmp_path)).collect()), key=str)
    wanted = [(1, text(1)), (2, text(2)), (3, text(3)), (3, text(4)), (None, text(5)), (None, text(6)), (7, None), (8, None), (8, "")]
    assert got == sorted(wanted, key=str)
