import hashlib
import random
import re
import time
from collections import defaultdict
from fractions import Fraction
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from twinsift.llm.decontaminate import _Search, best_match, contaminated, drop_contaminated, plain
from twinsift.llm.mixing import mix
from twinsift.llm.ngram_join import _apart, similar_documents
from twinsift.llm.quality_crf import score_quality
from twinsift.llm.substring import remove_repeats
from twinsift.llm.template_tree import drop_recurring_lines
from twinsift.llm.toxicity import score_toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, chunk int, id string, score string, n int, node string, key string, line string"


def frame(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, s, 7, "x", "x", 1, "x", "x", "x") for i, t, s in rows], SCHEMA)


def corpus():
    """Copies, near copies, a shared passage in a third of all rows, nulls, empty and long texts."""
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    passage = text(30)
    base = text(80)
    docs = [(100 + i, f"{text(rng.randrange(5, 40))} {passage} {text(5)}", "a") for i in range(25)]
    docs += [(200 + i, base, "b") for i in range(6)]
    for i in range(12):
        words = base.split()
        for _ in range(rng.randrange(1, 4)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        docs.append((300 + i, "\t".join(words).upper() if i % 3 == 0 else "\n".join(words), None))
    docs += [(1, None, "a"), (2, "", "c"), (3, " \n ", None), (4, "one two", "a"), (5, "One two", "a"), (5, "other words", "a")]
    docs += [(6, text(20_000), "d"), (None, base, "b"), (None, "lonely text of a row without id", "b"), (7, passage, None), (7, passage, None)]
    return docs


def shingles(text):
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def test_similar_documents_equal_brute_force(spark):
    docs = corpus()
    sets = [shingles(t) for _, t, _ in docs]
    parent = list(range(len(docs)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
                parent[top(i)] = top(j)
    groups = defaultdict(list)
    for i, (doc_id, _, _) in enumerate(docs):
        groups[top(i)].append(doc_id)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    wanted = sorted(((d[0], len(sets[i]), least[top(i)]) for i, d in enumerate(docs)), key=str)
    for parts in (1, 5):
        got = similar_documents(frame(spark, docs).repartition(3), parts=parts)
        assert sorted((tuple(r) for r in got.collect()), key=str) == wanted


def test_classes_apart_that_may_link(spark):
    rng = random.Random(4)
    rows = []
    for i in range(60):
        n = rng.randrange(3, 30)
        for place, gram in enumerate(sorted(rng.sample(range(40), n))):
            component = 0 if i < 20 else rng.randrange(1, 15) if i % 2 else i
            rows.append((gram, bytes([i]), n, place, 0, bytes([component])))
    component_of = {r[1]: r[5] for r in rows}
    rows = [(*r[:5], component_of[r[1]]) for r in rows]
    wanted = {
        (min(x[1], y[1]), max(x[1], y[1]))
        for x, y in combinations(rows, 2)
        if x[0] == y[0] and x[5] != y[5] and 7 * min(x[2] - x[3], y[2] - y[3]) >= 3 * (x[2] + y[2])
    }
    labelled = spark.createDataFrame(rows, "gram long, node binary, n int, place int, own int, component binary")
    for slice_rows in (2, 1000):
        got = [(bytes(r.a), bytes(r.b)) for r in _apart(labelled, Fraction(3, 4), slice_rows).collect()]
        assert len(got) == len(wanted) and set(got) == wanted


def test_repeats_equal_brute_force(spark):
    docs = corpus()
    order = lambda i: float("inf") if i is None else i
    owners = {}
    for doc_id, text, _ in docs:
        words = WORD.findall(text or "")
        for i in range(len(words) - 12):
            gram = tuple(words[i : i + 13])
            owners[gram] = min(owners.get(gram, float("inf")), order(doc_id))
    wanted = []
    for doc_id, text, _ in docs:
        words = WORD.findall(text or "")
        gone = set()
        for i in range(len(words) - 12):
            if owners[tuple(words[i : i + 13])] < order(doc_id):
                gone.update(range(i, i + 13))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        wanted.append((doc_id, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    for parts in (1, 6):
        got = remove_repeats(frame(spark, docs), parts=parts)
        rows = got.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256)).collect()
        assert sorted(map(tuple, rows), key=str) == sorted(wanted, key=str)
        assert got.where(F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"]) != F.col("n_removed")).count() == 0


def test_mix_fills_targets_and_repeats_itself(spark):
    rng = random.Random(5)
    docs = [(i, " ".join(["w"] * rng.randrange(0, 30)), rng.choice(["a", "a", "a", "b", "é", None])) for i in range(600)]
    docs += [(None, None, "b"), (9000, "", "empty")]
    first, again = (sorted(map(tuple, mix(frame(spark, docs).repartition(n)).collect()), key=str) for n in (2, 5))
    assert first == again and len(first) == len(docs)
    size, target, taken = defaultdict(int), {}, defaultdict(int)
    for doc_id, source, n, source_size, goal, repeats, words in first:
        assert words == n * repeats and 0 <= repeats <= 3
        size[source] += n
        taken[source] += words
        target[source] = goal
    for source in target:
        assert target[source] <= 3 * size[source] + 1e-6
        assert abs(taken[source] - target[source]) <= 30
    assert sum(target.values()) == pytest.approx(sum(size.values()))


def test_recurring_lines(spark):
    rng = random.Random(7)
    text = lambda n: " ".join(f"v{''.join(rng.choices('abcdefgh', k=4))}" for _ in range(n))
    unlike = [f"{text(8)}\nPage {i} of 99 printed\n{text(9)}\nShared by user {text(1)} on this site today" for i in range(40)]
    copied = "\n".join(text(9) for _ in range(4))
    docs = [(i, t, "a") for i, t in enumerate(unlike)] + [(100 + i, copied, "a") for i in range(30)]
    docs += [(500, None, "a"), (501, "", "a"), (502, "\n \n", "a"), (None, unlike[0], "a"), (503, "x " * 50_000, "a")]
    got = {r.doc_id: r for r in drop_recurring_lines(frame(spark, docs)).collect()}
    for i, t in enumerate(unlike):
        lines = t.split("\n")
        assert got[i].text == "\n".join((lines[0], lines[2])) and (got[i].n_lines, got[i].n_dropped) == (4, 2)
    assert all(got[100 + i].text == copied and got[100 + i].n_dropped == 0 for i in range(30))
    assert got[500].text is None and got[501].text == "" and got[502].n_lines == 0
    assert got[None].n_dropped == 2 and got[503].n_dropped == 0


def test_copies_take_no_votes_from_unlike_documents(spark):
    rng = random.Random(17)
    text = lambda n: " ".join(f"v{''.join(rng.choices('abcdefgh', k=4))}" for _ in range(n))
    shared = "Read the rules of this place first"
    body = lambda n: "\n".join(text(9) for _ in range(n))
    copied, near = body(9), body(9).split("\n")
    docs = [(i, f"{body(7)}\n{shared}", "a") for i in range(60)]
    docs += [(1000 + i, f"{copied}\n{shared}", "a") for i in range(400)]
    for i in range(400):
        words = [line.split() for line in near]
        words[rng.randrange(9)][rng.randrange(9)] = text(1)
        docs.append((2000 + i, "\n".join([*map(" ".join, words), shared]), "a"))
    got = {r.doc_id: r.text for r in drop_recurring_lines(frame(spark, docs)).collect()}
    assert all(got[i] == t.removesuffix(f"\n{shared}") for i, t, _ in docs)


def test_templates_that_share_a_leaf(spark):
    rng = random.Random(19)
    text = lambda n: " ".join(f"v{''.join(rng.choices('abcdefgh', k=4))}" for _ in range(n))
    body = lambda: "\n".join(text(9) for _ in range(5))
    # The copied line and a name that is constant elsewhere must not hide the templates.
    copied = f"{body()}\nShared by user group on every day again"
    kinds = ("Shared by user {} on this site today", "Shared by user group in {} last night", "Shared by user {} of our club once")
    docs = [(i, f"{body()}\n{kinds[i % 3].format(text(1))}", "a") for i in range(90)]
    docs += [(90, f"{body()}\n{kinds[0].format('group')}", "a")]
    prose = [(200 + i, f"{body()}\nShared by user {text(5)}", "a") for i in range(150)]
    prose += [(1000 + i, copied, "a") for i in range(300)]
    got = {r.doc_id: r.text for r in drop_recurring_lines(frame(spark, docs + prose)).collect()}
    assert all(got[i] == t.rsplit("\n", 1)[0] for i, t, _ in docs)
    assert all(got[i] == t for i, t, _ in prose)


def test_long_lines_of_few_unlike_documents(spark):
    rng = random.Random(29)
    text = lambda n: " ".join(f"v{''.join(rng.choices('abcdefgh', k=4))}" for _ in range(n))
    body = lambda: "\n".join(text(9) for _ in range(5))
    ends = [("All rights reserved.", 7), ("Read more", 7), ("Made for four pages", 4), ("Read on", 12)]
    docs = [(100 * k + i, f"{body()}\n{end}", "a") for k, (end, n) in enumerate(ends) for i in range(n)]
    got = {r.doc_id: r.n_dropped for r in drop_recurring_lines(frame(spark, docs)).collect()}
    assert got == {i: int(i // 100 in (0, 3)) for i, _, _ in docs}


def sellers(pattern, text):
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        above, row[0] = row[0], 0
        for i, p in enumerate(pattern, 1):
            above, row[i] = row[i], min(above + (p != c), row[i] + 1, row[i - 1] + 1)
        best = min(best, row[-1])
    return best


def test_bit_parallel_distance_equals_dynamic_programming():
    rng = random.Random(11)
    for _ in range(200):
        pattern = "".join(rng.choices("ab ", k=rng.randrange(1, 90)))
        text = "".join(rng.choices("abc ", k=rng.randrange(0, 120)))
        bits = defaultdict(int)
        for i, c in enumerate(pattern):
            bits[c] |= 1 << i
        assert best_match(bits, len(pattern), text)[0] == sellers(pattern, text)


def test_short_items_are_found_as_whole_words(spark):
    items = spark.createDataFrame([(1, "Two, words"), (2, "word"), (3, None), (4, "..")], "item_id long, text string")
    docs = [(1, "two\nwords"), (2, "two wordsmiths, no twowords"), (3, "a WORD"), (4, None), (5, ""), (6, "words two"), (6, "then two words")]
    df = frame(spark, [(i, t, "a") for i, t in docs])
    found = sorted(tuple(r) for r in contaminated(df, items).collect())
    assert found == [(1, 1, 0, 0, 9), (3, 2, 0, 2, 6), (6, 1, 0, 5, 14)]
    assert sorted(r.doc_id for r in drop_contaminated(df, items).collect()) == [2, 4, 5, 6]


def test_hits_with_common_surroundings_share_a_run():
    item = " ".join(["same"] * 300)
    text = "same same same same same other "
    started = time.monotonic()
    assert _Search([(1, item)], 0.05, 5).matches(text * 4000) == []
    assert time.monotonic() - started < 20
    assert _Search([(1, item)], 0.4, 5).matches(text * 70)[0][1] == sellers(item, text * 70)


def test_contaminated_equals_brute_force(spark):
    rng = random.Random(13)
    words = [f"{a}{b}" for a in "bdfgklm" for b in ("ane", "oru", "istel", "em")]
    text = lambda n: " ".join(rng.choices(words, k=n))
    items = [(i, text(rng.randrange(8, 40))) for i in range(12)] + [(50, None), (51, "two words"), (52, "")]
    docs = []
    for i in range(60):
        passage = list(rng.choice(items[:12])[1])
        for _ in range(rng.randrange(0, 10)):
            passage[rng.randrange(len(passage))] = rng.choice("xyz")
        docs.append((i, f"{text(30)} {''.join(passage).upper() if i % 2 else ''.join(passage)}, {text(10)}", "a"))
    docs += [(None, items[0][1], "a"), (100, None, "a"), (101, "", "a"), (102, text(20_000), "a"), (0, docs[0][1], "a")]
    wanted = []
    for doc_id, t, _ in docs:
        for item_id, item in items:
            p = plain(item or "")
            if len(p.split()) >= 5 and doc_id != 102:
                d = sellers(p, plain(t or ""))
                if d <= int(0.05 * len(p)):
                    wanted.append((doc_id, item_id, d))
    df, things = frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")
    for block in (1 << 20, 300):
        got = [tuple(r)[:3] for r in contaminated(df, things, block_chars=block).collect()]
        assert sorted((g for g in got if g[0] != 102), key=str) == sorted(wanted, key=str)
    left = drop_contaminated(df, things)
    assert left.columns == df.columns
    dirty = {d for d, _, _ in wanted}
    assert {r.doc_id for r in left.collect()} >= {d for d, _, _ in docs if d not in dirty and d != 102}
    assert not dirty & {r.doc_id for r in left.collect()}
    assert contaminated(df.where("false"), things).count() == 0 == contaminated(df, things.where("false")).count()


@pytest.mark.parametrize("score, label, bad, least", [(score_quality, "quality", 0, 0.95), (score_toxicity, "toxic", 1, 0.9)])
def test_models_on_held_out_rows(spark, score, label, bad, least):
    rng = random.Random(17)
    clean = lambda: "\n".join(" ".join(rng.choices("the river runs past small green fields and old stone houses".split(), k=12)).capitalize() + "." for _ in range(3))
    junk = {
        "quality": lambda: " ".join(["SPAM!!"] * rng.randrange(20, 60)) + "\n" + "|".join("$%#*" * 9),
        "toxic": lambda: clean() + f"\nYou are a {rng.choice(['dolt', 'doltish', 'knave'])} and they know it.",
    }[label]
    docs = [(i, junk() if i % 4 == 0 else clean(), "a") for i in range(400)]
    labels = [(i, bad if i % 4 == 0 else 1 - bad) for i in range(400)]
    extra = [(None, clean(), "a"), (1000, None, "a"), (1001, "", "a"), (1002, "x " * 100_000, "a"), (0, clean(), "a")]
    df = frame(spark, docs + extra).select("doc_id", "text", "score", "chunk")
    truth = spark.createDataFrame(labels + [(None, 1), (5, None)], f"doc_id long, {label} int")
    got = score(df, truth).collect()
    assert len(got) == len(docs + extra) and all(0 <= r.score <= 1 for r in got)
    known = dict(labels)
    held = [r for r in got if r.held_out and r.doc_id in known]
    assert len(held) > 50
    assert sum(r.predicted == known[r.doc_id] for r in held) >= least * len(held)
    assert {r.score for r in score(df, truth.where("false")).collect()} in ({0.5}, {0.0})
    assert score(df.where("false"), truth).count() == 0


def test_empty_tables(spark):
    none = frame(spark, []).where("false")
    for run in (similar_documents, remove_repeats, mix, drop_recurring_lines):
        assert run(none).count() == 0


def test_repeated_rows_are_split_at_the_target(spark):
    """A source of equal rows, with and without an id, comes within one row of its target."""
    ten = "w " * 10
    rows = [(1, ten, "a")] * 300 + [(None, ten, "b")] * 200 + [(i, ten, "c") for i in range(2, 302)] + [(5, "", "d")] * 4
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix(docs).groupBy("source").agg(
        F.sum("taken").alias("taken"), F.first("target").alias("target"), F.count(F.lit(1)).alias("n"), F.max("repeats").alias("most")
    )
    by = {r.source: r for r in got.collect()}
    assert [by[s].n for s in "abcd"] == [300, 200, 300, 4]
    for source in "abcd":
        assert abs(by[source].taken - by[source].target) <= 5.001, by[source]
        assert by[source].most <= 3
