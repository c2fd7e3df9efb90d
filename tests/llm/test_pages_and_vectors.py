import time
import base64
import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from twinsift.llm.embedding_join import BLOCKS, _budgets, _cuts, _meetings, _rotated, _side, near_duplicates
from twinsift.llm.toxicity import _EVENT, _STATES, _STEP
from twinsift.llm.url_filter import judge_urls
from twinsift.llm.warc import read_archive, write_archive


def brute(rows, cosine=0.98):
    usable = lambda v: v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)
    vectors = [np.array(v, dtype=np.float64) if usable(v) and label is not None else None for _, v, label in rows]
    links, parent = [0] * len(rows), list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(vectors):
        for j, b in enumerate(vectors[:i]):
            if a is not None and b is not None and len(a) == len(b) and rows[i][2] == rows[j][2]:
                if a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)) >= cosine:
                    links[i] += 1
                    links[j] += 1
                    parent[top(i)] = top(j)
    ids = {}
    for i, (vec_id, _, _) in enumerate(rows):
        if vec_id is not None:
            ids[top(i)] = min(ids.get(top(i), vec_id), vec_id)
    return sorted(((r[0], links[i], ids.get(top(i)), r[0] is not None and r[0] == ids.get(top(i))) for i, r in enumerate(rows)), key=str)


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((6, 16))
    rows = []
    for i in range(240):
        v = centres[i % 6] + rng.standard_normal(16) * rng.choice([0.02, 0.1, 0.3])
        rows.append((i, [float(np.float32(x)) for x in v], int(rng.integers(0, 2))))
    rows += [(300 + i, rows[0][1], rows[0][2]) for i in range(5)] + [(300, rows[1][1], rows[1][2])]
    rows += [(400, None, 1), (401, [], 1), (402, [0.0] * 16, 1), (403, [float("nan")] * 16, 1), (404, [None] * 16, 1)]
    rows += [(405, rows[0][1], None), (406, [1.0, 2.0, 3.0], 1), (407, [2.0, 4.0, 6.0], 1), (None, rows[0][1], rows[0][2]), (408, [5.0], 0)]
    for kind in ("float", "double"):
        df = spark.createDataFrame([(*r, "x", 3) for r in rows], f"vec_id long, embedding array<{kind}>, label int, class string, x int")
        for size, packed in ((2048, 16_384), (7, 5)):
            got = near_duplicates(df, slice_rows=size, packed_rows=packed).collect()
            assert sorted(map(tuple, got), key=str) == brute(rows)
    assert near_duplicates(df.where("false")).count() == 0


def test_blocks_bring_few_of_all_pairs_together_and_no_near_one_is_missed():
    rng = np.random.default_rng(4)
    vectors = rng.standard_normal((1500, 64))
    vectors[1400:] = vectors[:100] + 0.1 * rng.standard_normal((100, 64))
    turned = _rotated(vectors).astype(np.float32)
    cuts, budgets = _cuts(64), _budgets(64, 0.98)
    everyone, met = np.arange(len(turned)), 0
    for a, b, budget in zip(cuts[:-1], cuts[1:], budgets):
        part = turned[:, a:b]
        pairs = [(i[i < j], j[i < j]) for i, j in _meetings(part, everyone, everyone, _side(budget), np.zeros(len(part), dtype=bool))]
        pairs = {(x, y) for i, j in pairs for x, y in zip(i.tolist(), j.tolist())}
        met += len(pairs)
        for i in range(len(part)):
            near = np.flatnonzero(((part[i] - part[i + 1 :]) ** 2).sum(axis=1) <= budget) + i + 1
            assert all((i, j) in pairs for j in near.tolist())
    assert len(cuts) == BLOCKS + 1 and met <= 0.2 * len(turned) * (len(turned) - 1) / 2


def test_urls(spark):
    rules = spark.createDataFrame(
        [("org", "/", "allow"), ("b.org", "/x/", "block"), ("c.b.org", "", "allow"), ("b.org", "/x/", "allow"), ("", "/any", "block")],
        "host string, path string, action string",
    )
    cases = {
        "http://a.org/": ("a.org", "/", "org/", "allow"),
        "https://A.B.org/x/1?q#f": ("a.b.org", "/x/1", "b.org/x/", "block"),
        "ftp://c.b.org?q=/x/": ("c.b.org", "", "c.b.org", "allow"),
        "http://ab.org/x": ("ab.org", "/x", "org/", "allow"),
        "http://b.org/x": ("b.org", "/x", "org/", "allow"),
        "http://É.com/é\nb#://": ("É.com", "/é\nb", None, "keep"),
        "x://y://z/": ("y:", "//z/", None, "keep"),
        "no scheme/x/": ("", "", None, "keep"),
        "": ("", "", None, "keep"),
        "http://": ("", "", None, "keep"),
        None: ("", "", None, "keep"),
        "http://" + "a." * 500 + "org/" + "p" * 5000: ("a." * 500 + "org", "/" + "p" * 5000, "org/", "allow"),
    }
    pages = spark.createDataFrame([(i, u, "s", "d") for i, u in enumerate([*cases, *cases])], "page_id long, url string, start string, digest string")
    got = {r.page_id: tuple(r)[1:] for r in judge_urls(pages, rules, default="keep").collect()}
    wanted = list(cases.values()) * 2
    assert [got[i] for i in range(len(wanted))] == wanted
    assert {r.verdict for r in judge_urls(pages, rules.where("false")).collect()} == {"allow"}
    assert judge_urls(pages.where("false"), rules).count() == 0


def test_archive_round_trip(spark, tmp_path):
    rng = random.Random(2)
    pages = [(i, f"http://h/{i}%20\n", "".join(rng.choices("abc é", k=rng.randrange(0, 4000)))) for i in range(60)]
    pages += [(100 + i, "http://same", "copy") for i in range(30)] + [(200, None, None), (201, "u", ""), (None, "n", "copy"), (None, "n", "alone")]
    pages += [(129, "http://twice", "copy"), (300, "http://long", "long " * 400_000)]
    df = spark.createDataFrame([(*p, "x", 1) for p in pages], "page_id long, url string, html string, digest string, part int")
    manifest = write_archive(df.repartition(5), str(tmp_path / "a"), file_bytes=6000).collect()
    write_archive(df.repartition(2), str(tmp_path / "b"), file_bytes=6000)
    files = sorted((tmp_path / "a").glob("*.gz"))
    assert {f.name: f.stat().st_size for f in files} == {m.name: m.bytes for m in manifest}
    assert [f.read_bytes() for f in files] == [f.read_bytes() for f in sorted((tmp_path / "b").glob("*.gz"))]
    assert not (tmp_path / "a" / "_temporary").exists()
    rows = read_archive(spark, str(tmp_path / "a"), with_payload=True).collect()
    payloads = {r.payload_digest: bytes(r.payload) for r in rows if r.record_type == "response"}
    got = sorted((str(r.page_id), str(r.url), payloads[r.payload_digest].decode()) for r in rows)
    assert got == sorted((str(i), str(u), h or "") for i, u, h in pages)
    digest = lambda text: base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()
    for r in rows:
        text = payloads[r.payload_digest].decode()
        assert r.payload_bytes == len(text.encode()) and r.payload_digest == digest(text)
        largest = max((i for i, _, h in pages if (h or "") == text and i is not None), default=None)
        if r.record_type == "revisit":
            assert r.refers_to == largest
        else:
            assert r.page_id == largest and r.refers_to is None
    assert sum(r.record_type == "response" for r in rows) == len({h or "" for _, _, h in pages})
    write_archive(df.where("false"), str(tmp_path / "c"))
    assert read_archive(spark, str(tmp_path / "c")).count() == 0


def test_the_grammar_tells_clauses_apart():
    other, insult, threat, target, negation, report = range(6)

    def events(*symbols):
        state, out = 0, []
        for symbol in symbols:
            if _EVENT[state][symbol] >= 0:
                out.append(_EVENT[state][symbol])
            state = _STEP[state][symbol]
        return out

    assert events(other, insult) == [0]
    assert events(target, other, insult) == [4]
    assert events(target, other, negation, insult) == [6]
    assert events(report, target, insult) == [5]
    assert events(threat, other, target) == [8]
    assert events(negation, threat, target) == [10]
    assert events(threat, other) == []
    assert events(insult, target) == [0, 12]
    assert len(_STATES) == len(_STEP)


def test_hosts_of_any_number_of_labels_are_judged(spark):
    long = ".".join(["a"] * 100_000)
    rules = spark.createDataFrame(
        [("org", "/", "block"), ("x.org", "/ok", "allow"), ("", "/only", "block"), ("a.b.c", "/", "block")],
        "host string, path string, action string",
    )
    urls = [f"http://{long}.x.org/ok", f"http://{long}.org/", f"http://{long}/", "http://org/", "http:///only", "http://b.c/", "http://.a.b.c/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    start = time.perf_counter()
    got = {r.page_id: (r.rule, r.verdict) for r in judge_urls(pages, rules).collect()}
    assert time.perf_counter() - start < 30
    assert got == {
        0: ("x.org/ok", "allow"), 1: ("org/", "block"), 2: (None, "allow"), 3: ("org/", "block"), 4: ("/only", "block"),
        5: (None, "allow"), 6: ("a.b.c/", "block"),
    }
