"""Operators 11 to 13: packing, repair of conversations, whitening."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from twinsift.llm import conversation_repair as cr
from twinsift.llm.packing import ByteLevelEncoder, LocalSearch, best_fit, cuts, pack, packed, pieces
from twinsift.llm.whitening import Spectrum, rank_one, whiten

SF = "/root/testdata/sf0.001"
FILE = public_tokenizers.path("byte_bpe_50k.json")


# ---- packing


@pytest.fixture(scope="module")
def encode():
    with open(FILE, encoding="utf-8") as file:
        return ByteLevelEncoder(file.read(), public_tokenizers.PATTERN)


def test_ids_equal_the_tokenizer_files_own(spark, encode):
    texts = [r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    texts += ["", " ", "a<|endoftext|>b", " \n" * 5000, "x" * 50_000, "\x00é１²Ⅷǅ\U0001f600﻿", "don't 12ab  \t\r\n c"]
    for text in texts:
        assert np.array_equal(encode(text), encode.own(text))


@pytest.mark.parametrize("size,want", [(1, [0, 1]), (1024, [0, 1024]), (1025, [0, 1, 1025]), (3000, [0, 952, 1976, 3000])])
def test_only_long_documents_are_cut_and_the_first_piece_is_the_short_one(size, want):
    assert cuts(size, 1024) == want


def fewest_bins(sizes, capacity):
    """By brute force: place the items one by one into every bin that takes them."""
    best = [len(sizes)]

    def place(i, fills):
        if len(fills) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(fills)
            return
        for k in range(len(fills)):
            if fills[k] + sizes[i] <= capacity:
                place(i + 1, fills[:k] + [fills[k] + sizes[i]] + fills[k + 1 :])
        place(i + 1, fills + [sizes[i]])

    place(0, [])
    return best[0]


def test_small_packings_are_nearly_always_the_fewest_bins():
    rng = random.Random(3)
    over = 0
    for _ in range(150):
        sizes = sorted((rng.randint(15, 60) for _ in range(9)), reverse=True)
        bins = packed(np.array(sizes), 100)
        assert np.bincount(bins, weights=sizes).max() <= 100
        assert set(bins) == set(range(max(bins) + 1))
        over += max(bins) + 1 - fewest_bins(sizes, 100)
    assert over <= 8


def test_exchanges_raise_squared_fill_and_empty_bins():
    rng = np.random.default_rng(5)
    sizes = rng.integers(200, 420, 2000)
    start = best_fit(sizes, 1024)
    search = LocalSearch(sizes, start, 1024)
    before = (search.fill**2).sum()
    search.run()
    assert (search.fill**2).sum() > before
    assert np.array_equal(np.bincount(search.bin, weights=sizes, minlength=len(start)), search.fill)
    assert np.count_nonzero(search.fill) < len(start) - 20


def test_two_pieces_are_exchanged_for_one():
    search = LocalSearch(np.array([20, 25, 40, 50]), [[0, 1, 2], [3]], 100)
    assert search._two_for_one(1, np.array([3]), np.array([0, 1, 2])) == (50, [0, 1], 0)
    # Exchanging what leaves both bins as full as before raises nothing.
    even = LocalSearch(np.array([40, 45, 90]), [[0, 1], [2]], 100)
    assert even._two_for_one(1, np.array([2]), np.array([0, 1])) is None


def packing_rows(spark, docs, **options):
    found = pieces(docs, FILE, public_tokenizers.PATTERN)
    return [r.asDict() for r in pack(found, **options).collect()]


@pytest.mark.parametrize("group_pieces", [50, 100_000])
def test_packing_holds_every_piece_once_without_gaps(spark, encode, group_pieces):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = packing_rows(spark, docs, group_pieces=group_pieces)
    want = []
    for r in docs.collect():
        ids = np.append(encode.own(r.text or ""), np.array([2], "<u4")).astype("<u4")
        at = cuts(len(ids), 1024)
        want += [(r.doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(at, at[1:]))]
    assert sorted((f["doc_id"], f["piece"], f["start"], f["length"], f["ids_crc32"]) for f in found) == sorted(want)
    sequences = {}
    for f in found:
        sequences.setdefault(f["sequence_id"], []).append((f["offset"], f["length"]))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 1024
    total = sum(f["length"] for f in found)
    assert len(sequences) <= 1.1 * -(-total // 1024)


def test_packing_of_odd_rows(spark):
    rows = [(1, None, "x"), (1, "", "y"), (None, "word", "z"), (None, "word", "z"), (5, "long " * 30_000, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string")
    found = packing_rows(spark, docs)
    assert sum(f["length"] for f in found) == 1 + 1 + 2 * 2 + 30_001 + 1
    assert sorted(f["length"] for f in found if f["doc_id"] is None) == [2, 2]
    assert packing_rows(spark, docs.where("false")) == []


# ---- conversations


def conversation_frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def judged(rows):
    """(initial, fault) of the rows (turn, role, text) of a conversation in order."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
    seen, out = set(), []
    for turn, role, text in rows:
        last = text.strip("\x20\x09\x0a\x0b\x0c\x0d")[-1:]
        fault = "b" if not last else "d" if (role, text) in seen else "k" if last in ".!?" else "t"
        seen.add((role, text))
        out.append((turn, role, text, fault))
    return out


def legal(initials):
    rest = initials[1:] if initials[:1] == "s" else initials
    return initials == "" or (rest != "" and len(rest) % 2 == 0 and rest == "ua" * (len(rest) // 2))


def cheapest(rows):
    """By brute force over all edits with up to two insertions at each place: (cost, audit, lines)."""
    inserts = ["", "u", "a", "ua", "au"]
    best = None
    options = []
    for _, role, text, fault in rows:
        extra = 1 if fault == "t" else 0
        mine = [(3, "D", None)]
        if fault in "kt":
            mine += [(extra, "K", (role, text)), (2 + extra, "R", ("user", text)), (2 + extra, "R", ("assistant", text))]
        options.append(mine)
    for edits in itertools.product(*options):
        for added in itertools.product(inserts, repeat=len(rows) + 1):
            cost = sum(e[0] for e in edits) + 2 * sum(map(len, added))
            if best is not None and cost > best[0]:
                continue
            audit, lines = "", []
            for k, ins in enumerate(added):
                audit += "I" * len(ins)
                lines += [({"u": "user", "a": "assistant"}[c], "") for c in ins]
                if k < len(edits):
                    audit += edits[k][1]
                    if edits[k][2]:
                        lines.append(edits[k][2])
            if legal("".join(role[:1] for role, _ in lines)):
                best = min(best or (cost + 1,), (cost, audit, "\n".join(f"{r}:{t}" for r, t in lines)))
    return best


def random_conversations(n, length):
    rng = random.Random(7)
    out = {}
    for conv in range(n):
        rows = []
        for turn in range(rng.randint(1, length)):
            role = rng.choice(["system", "user", "user", "assistant", "assistant", "tool"])
            rows.append((rng.choice([turn, turn, turn, None]), role, rng.choice(["Yes.", "No!", "cut of", " \t", "Other one. ", f"{turn}?"])))
        out[conv] = rows
    return out


@pytest.mark.parametrize("chunk_rows", [1, 2, 1024])
def test_repair_equals_brute_force(spark, chunk_rows):
    given = random_conversations(40, 4)
    flat = [(c, *r, 1) for c, rows in given.items() for r in rows]
    rows = spark.createDataFrame(flat, "conv_id long, turn long, role string, text string, times long")
    found = {r.conv_id: r for r in cr.repair(rows, rows, chunk_rows=chunk_rows).collect()}
    for conv, own in given.items():
        want = judged(own)
        cost, audit, repaired = cheapest(want)
        r = found[conv]
        assert (r.cost, r.audit) == (cost, audit), own
        assert r.repaired_sha256 == hashlib.sha256(repaired.encode()).hexdigest()
        assert (r.blank, r.duplicate, r.truncated) == tuple(sum(f[3] == k for f in want) for k in "bdt")
        initials = [f[1][0] for f in want]
        assert r.illegal == sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        turns = [t for t, *_ in own if t is not None]
        assert r.gaps == (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0)


def test_nodes_are_made_once_per_distinct_suffix(monkeypatch):
    made = []
    whole = cr.node_before
    monkeypatch.setattr(cr, "node_before", lambda symbol, below: made.append(symbol) or whole(symbol, below))
    endings = sorted({" ".join(w) for n in range(1, 6) for w in itertools.product("ua", repeat=n)})
    found = {e: (c, a) for _, e, c, a in cr.walk((True, e) for e in endings)}
    assert len(made) == len(endings)  # every suffix of these words is one of them
    assert found["a u"][0][0] == 0 and found["a u"][1][0] == "KK"


def test_a_conversation_with_most_rows_is_cut_into_chunks(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"{t}.") for t in range(3000)]
    rows += [(c, 0, "user", "one") for c in range(2, 20)]
    df = conversation_frame(spark, rows).withColumn("times", F.lit(1).cast("long"))
    for chunk_rows in (100, 5000):
        found = {r.conv_id: r for r in cr.repair(df, df, chunk_rows=chunk_rows).collect()}
        assert found[1].audit == "K" * 3000 and found[1].cost == 0 and found[1].illegal == 0 and found[1].gaps == 0
        text = "\n".join(f"{r}:{t}" for _, _, r, t in rows[:3000])
        assert found[1].repaired_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert (found[2].audit, found[2].cost) == ("D", 3)


def test_odd_conversations(spark):
    empty = hashlib.sha256(b"").hexdigest()
    rows = [(None, None, None, None, 1), (None, 3, "user", "hi.", 5), (4, 1, "", "é" * 100_000 + ".", 1), (4, 1, "", "é" * 100_000 + ".", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, times long").withColumn("audit", F.lit(1))
    ids = df.select("conv_id").unionByName(spark.createDataFrame([(9,)], "conv_id long"))
    found = {r.conv_id: r for r in cr.repair(df, ids).collect()}
    assert (found[None].blank, found[None].duplicate, found[None].audit, found[None].illegal) == (1, 4, "DKDDDDI", 5)
    assert (found[4].duplicate, found[4].audit, found[4].cost) == (1, "DD", 6)
    assert (found[9].cost, found[9].audit, found[9].repaired_sha256) == (0, "", empty)
    assert cr.repair(df.where("false"), ids.where("false")).count() == 0


# ---- whitening


@pytest.mark.parametrize("kind", ["normal", "whole", "equal", "flat", "unit", "graded"])
def test_rank_one_updates_equal_a_full_decomposition(kind):
    rng = np.random.default_rng(11)
    for _ in range(15):
        k, m = int(rng.integers(1, 20)), int(rng.integers(1, 50))
        x = rng.standard_normal((m, k)) * 10.0 ** rng.integers(-2, 4)
        if kind == "whole":
            x = np.round(x)
        elif kind == "equal":
            x = np.repeat(x[:1], m, axis=0)
        elif kind == "flat":
            x[:, : k // 2] = 0
        elif kind == "unit":
            x = np.eye(k)[rng.integers(0, k, m)] * 5
        elif kind == "graded":
            x = x * 10.0 ** -(np.arange(k) % 8)
        spectrum = Spectrum(k)
        for part in np.array_split(x, int(rng.integers(1, 5))):
            spectrum.add(part)
        centred = x - x.mean(axis=0)
        scale = max(np.abs(x).max() ** 2, 1e-300)
        assert np.abs(spectrum.q @ np.diag(spectrum.d) @ spectrum.q.T - centred.T @ centred).max() <= 1e-12 * m * scale
        assert np.abs(spectrum.q.T @ spectrum.q - np.eye(k)).max() <= 1e-12


def test_equal_eigenvalues_are_deflated():
    d, q = rank_one(np.ones(5), np.eye(5), np.array([1.0, 2, 0, 0, 2]), 0.5)
    assert np.allclose(d, [1, 1, 1, 1, 5.5]) and np.allclose(np.abs(q[:, 4]), np.array([1, 2, 0, 0, 2]) / 3)


def whitened_by_numpy(x, components):
    n, sums = len(x), x.sum(axis=0)
    centred = (n * x - sums) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:components]
    return ((n * x - sums) ** 2).sum(axis=1), centred @ axes[:, order] / np.sqrt(values[order]), values[order] / values.sum()


def test_whitening_equals_numpy(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    own = table.toPandas()
    x = np.floor(np.stack(own["embedding"]).astype(float) * 1024).astype(np.int64) + 100_000
    deviation, white, explained = whitened_by_numpy(x, 8)
    found = whiten(table.repartition(37)).toPandas().sort_values(["vec_id", "component"])
    order = np.argsort(own["vec_id"].to_numpy())
    got = found["whitened"].to_numpy().reshape(-1, 8)
    signs = np.sign((got * white[order]).sum(axis=0))
    assert np.abs(got - signs * white[order]).max() < 1e-9
    assert (found["deviation"].to_numpy().reshape(-1, 8)[:, 0] == deviation[order]).all()
    assert np.abs(found["explained"].to_numpy()[:8] / explained - 1).max() < 1e-9
    assert set(found["n"]) == {len(x)} and found["identity_error"].max() < 1e-9


def test_whitening_of_odd_rows(spark):
    schema = "vec_id long, embedding array<double>, n string"
    rng = np.random.default_rng(2)
    rows = [(1, None, "a"), (2, [], "a"), (3, [1.0, None], "a"), (4, [float("nan"), 1.0], "a"), (5, [float("inf"), 1.0], "a"), (6, [1.0, 2.0, 3.0], "a")]
    good = [(None if i % 5 == 0 else 7, [float(v) for v in rng.standard_normal(2)], "b") for i in range(20)]
    good += [(8, [0.5, 0.5], "c")] * 10
    found = whiten(spark.createDataFrame(rows + good, schema)).collect()
    assert len(found) == 30 * 2 and {r.n for r in found} == {30}
    x = np.floor(np.array([v for _, v, _ in good]) * 1024).astype(np.int64) + 100_000
    deviation, white, explained = whitened_by_numpy(x, 2)
    assert sorted(r.deviation for r in found if r.component == 1) == sorted(deviation.tolist())
    assert np.allclose(sorted(abs(r.whitened) for r in found if r.component == 2), sorted(np.abs(white[:, 1])))
    one = whiten(spark.createDataFrame([(1, [3.0, 4.0], "a")] * 3, schema)).collect()
    assert {(r.whitened, r.explained, r.deviation, r.identity_error) for r in one} == {(0.0, 0.0, 0, 0.0)}
    assert whiten(spark.createDataFrame(rows[:3], schema)).count() == 0
    huge = whiten(spark.createDataFrame([(1, [1e300, 0.0], "a"), (2, [-1e300, 0.0], "a")], schema)).collect()
    assert {r.deviation for r in huge} == {None} and np.isfinite([r.whitened for r in huge]).all()
