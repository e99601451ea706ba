"""Line dedup, n-gram join, compact windows and the pipeline against brute force."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pandas as pd
import pytest
from dosewise.llm import compact_windows, line_dedup, ngram_join
from dosewise.llm.common import components
from pyspark.sql import functions as F


def brute_lines(rows):
    seen, out = set(), {}
    for doc, text in sorted({r for r in rows if r[1] is not None}, key=lambda r: (r[0] is not None, r[0] or 0)):
        lines, gone = text.split("\n"), set()
        for at in range(len(lines) - 2):
            window = tuple(lines[at : at + 3])
            if "".join(window).strip(" ") and window in seen:
                gone.update(range(at, at + 3))
            seen.add(window)
        out[doc, text] = "\n".join(line for at, line in enumerate(lines) if at not in gone) if gone else text
    return out


def test_line_dedup(corpus):
    chance = random.Random(2)
    rows = [(k, "\n".join(chance.choice("abcd ") for _ in range(chance.randint(0, 14)))) for k in range(60)]
    rows += [(70, "\n\n\n\n"), (71, "\n\n\n\n"), (72, None), (73, ""), (74, "one"), (None, "x\ny\nz"), (75, "x\ny\nz"), (3, rows[3][1]), (76, "\n".join(str(k) for k in range(3000))), (77, "\n".join(str(k) for k in range(2998)))]
    got = line_dedup.dedup(corpus(rows))
    assert got.columns == ["doc_id", "text", "kept", "gone", "n_lines", "n_removed"]
    want = brute_lines(rows)
    found = got.collect()
    assert sorted(map(str, [(r["doc_id"], r["text"]) for r in found])) == sorted(map(str, [(d, want.get((d, t))) for d, t in rows]))
    assert {r["n_removed"] for r in found if r["doc_id"] == 77} == {2998}
    assert line_dedup.dedup(corpus([])).count() == 0


def test_line_dedup_sql(corpus):
    chance = random.Random(4)
    documents = pd.DataFrame([(k, "\n".join(chance.choice("ab") for _ in range(6)), "en", "s") for k in range(30)], columns=["doc_id", "text", "lang", "source"])  # noqa: F841
    want = duckdb.sql(line_dedup.ORACLE).df().sort_values("doc_id")
    got = line_dedup.dedup(corpus(list(zip(documents["doc_id"].tolist(), documents["text"])))).toPandas().sort_values("doc_id")
    assert got["text"].tolist() == want["text"].tolist() and got["n_removed"].tolist() == want["n_removed"].tolist()


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    return frozenset(tuple(words[k : k + width]) for k in range(len(words) - width + 1)) or (frozenset([tuple(words)]) if words else frozenset())


def brute_components(rows, width=3, percent=90):
    sets = [(d, shingles(t, width)) for d, t in rows]
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (a, x) in enumerate(sets):
        for b, y in sets[:n]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {d: (len(s), find(d)) for d, s in sets}


def test_ngram_join(corpus, monkeypatch):
    monkeypatch.setattr(ngram_join, "FREQUENT", 3)
    chance = random.Random(7)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for group in range(6):
        base = [chance.choice(words) for _ in range(chance.choice([30, 80, 200]))]
        for _ in range(25):
            copy = list(base)
            for _ in range(chance.randint(0, 3)):
                copy[chance.randrange(len(copy))] = chance.choice(words)
            if chance.random() < 0.3:
                copy = copy[: -chance.randint(1, 6)]
            rows.append((len(rows) * 3, (" " if chance.random() < 0.5 else "\n").join(copy).title() if chance.random() < 0.2 else " ".join(copy)))
    rows += [(1000 + k, t) for k, t in enumerate(["", None, "one", "ONE", "two words", "two  words", "a b c", "é é é", "e e e", "x " * 5000])]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join(corpus(rows)).collect()}
    assert got == brute_components(rows)
    twice = ngram_join.join(corpus([(5, "a b c d"), (5, "a b c d"), (None, "a b c d"), (None, "q r s"), (9, "a b c d")])).collect()
    assert sorted(map(str, map(tuple, twice))) == sorted(map(str, [(5, 2, 5), (5, 2, 5), (9, 2, 5), (None, 2, 5), (None, 1, None)]))
    assert ngram_join.join(corpus([])).count() == 0


def test_ngram_join_on_both_sides_of_the_sketch_limit(corpus):
    chance = random.Random(17)
    words = [f"w{k}" for k in range(3000)]
    limit, rows = ngram_join.SKETCHED, []
    for size in (limit + 2, limit + 2, limit - 30, limit + 40):
        base = [chance.choice(words) for _ in range(size)]
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join([*base, "more"])), (len(rows) + 2, " ".join(base[:-45]))]
        changed = list(base) + ["x"] * 8
        for _ in range(chance.randint(2, 12)):
            changed[chance.randrange(size)] = chance.choice(words)
        rows.append((len(rows), " ".join(changed)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join(corpus(rows)).collect()}
    assert got == brute_components(rows)
    assert got[0][0] == limit and got[1] == (limit + 1, 0)


@pytest.mark.parametrize("size, copies", [(150, 500), (700, 60), (2500, 24), (9800, 8)])
def test_ngram_join_of_copies_about_the_threshold(corpus, size, copies):
    """One group of copies with more or less changed, their similarities on both sides of 0.9, in sets of every sketch's width."""
    chance = random.Random(size)
    base, rows = [f"w{chance.randrange(10**6)}" for _ in range(size)], []
    for k in range(copies):
        words = list(base)
        for at in chance.sample(range(size), chance.randrange(1, max(2, size // 36))):
            words[at] = f"x{chance.randrange(10**6)}"
        rows.append((k, " ".join(words[: size - chance.randrange(size // 40)])))
    want = brute_components(rows)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join(corpus(rows)).collect()}
    assert found == want and len({c for _, c in want.values()}) < copies


def test_ngram_join_counts_repeated_rows_once(corpus):
    chance = random.Random(19)
    word = lambda: chance.choice("bcdfgklm") + "".join(chance.choice("aeioubcdfgklm") for _ in range(5))
    base = [word() for _ in range(900)]
    part = lambda n: " ".join(base[:n] + [word() for _ in range(900 - n)])
    one, far, near = " ".join(base), part(675), part(880)  # similarities about 0.6 and 0.95
    other = [word() for _ in range(900)]
    rows = [(5, one), (5, one), (5, one), (6, far), (6, far), (7, near)]
    # an id with two texts of equal size: what is near one text is not joined with the other
    rows += [(20, part(0)), (20, " ".join(other)), (21, " ".join([*other[:890], *[word() for _ in range(10)]])), (2, rows[0][1] + " end"), (22, part(450))]
    got = sorted((r["doc_id"], r["component_id"]) for r in ngram_join.join(corpus(rows)).collect())
    assert got == sorted([(2, 2), (5, 2), (5, 2), (5, 2), (6, 6), (6, 6), (7, 2), (20, 20), (20, 20), (21, 20), (22, 22)])


def test_components(spark):
    chance = random.Random(1)
    links = [(k, k + 1) for k in range(0, 40)] + [(chance.randrange(100, 160), chance.randrange(100, 160)) for _ in range(40)] + [(7, 7)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = {x: x for p in links for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    assert got == {x: find(x) for x in got} and set(got) == {x for a, b in links if a != b for x in (a, b)}


def test_windows_cover_each_subsequence_once():
    chance = np.random.default_rng(0)
    for _ in range(60):
        n, least = int(chance.integers(1, 50)), int(chance.integers(2, 9))
        values = chance.integers(1, 20, n).astype(np.uint64)
        values[n // 2] = 0 if n > 10 else values[n // 2]
        owner = {}
        for left, c, right in zip(*(x.tolist() for x in compact_windows.compact_windows(values, least))):
            for i in range(left, c + 1):
                for j in range(max(c, i + least - 1), right + 1):
                    assert (i, j) not in owner
                    owner[i, j] = c
        for i in range(n):
            for j in range(i + least - 1, n):
                own = values[i : j + 1]
                assert ((i, j) in owner) == bool((own > 0).all())
                assert (i, j) not in owner or values[owner[i, j]] == own.min()


def test_short_passages_with_a_change_anywhere():
    chance = np.random.default_rng(5)
    text = lambda words: compact_windows.tokens(" ".join(map(str, words)).encode())
    for n in (50, 53, 60, 70):
        shared = chance.integers(0, 1 << 40, n)
        for place in range(n):
            near = shared.copy()
            near[place] = -1
            sides = [np.concatenate((chance.integers(0, 1 << 40, 20), x, chance.integers(0, 1 << 40, 15))) for x in (shared, near)]
            a, b = map(text, sides)
            own = slice(20, 20 + n - 4)
            common = len(np.intersect1d(a[own], b[own]))
            assert common / (2 * (n - 4) - common) >= 0.8
            for at in range(20, 20 + n - 4):
                if a[at] == b[at]:
                    for s, e, t, f, alike in (found := compact_windows.passages(a, b, [(at, at)], 46, 0.8)):
                        x, y = a[s:e], b[t:f]
                        assert min(len(x), len(y)) >= 46 and alike == len(np.intersect1d(x, y)) / len(np.union1d(x, y)) >= 0.8
                    assert len(found) == 1
    assert not compact_windows.passages(text(range(60)), text([*range(30), *range(100, 130)]), [(3, 3)], 46, 0.8)


def test_contexts_of_windows_are_told_apart():
    schema = compact_windows.pa.schema([(n, compact_windows.pa.int32() if n in "clr" else compact_windows.pa.int64()) for n in ("key", "doc", "c", "l", "r", "to_right", "to_left")])
    values = np.random.default_rng(6).integers(1, 1 << 63, 2_000_000, dtype=np.uint64)
    found = compact_windows._windows_of([values], [1], 46, 1, schema)
    for side in ("to_right", "to_left"):
        assert len(found) > 60_000 and len(set(found[side].to_pylist())) == len(found)


def test_contexts_end_with_their_text():
    """What a window is grouped by does not depend on the texts that are found in one go with it."""
    schema = compact_windows.pa.schema([(n, compact_windows.pa.int32() if n in "clr" else compact_windows.pa.int64()) for n in ("key", "doc", "c", "l", "r", "to_right", "to_left")])
    chance = np.random.default_rng(16)
    texts = [chance.integers(1, 1 << 63, 300, dtype=np.uint64) for _ in range(3)]
    together = compact_windows._windows_of(texts, [0, 1, 2], 46, 2, schema).to_pylist()
    for k, own in enumerate(texts):
        assert compact_windows._windows_of([own], [k], 46, 2, schema).to_pylist() == [r for r in together if r["doc"] == k]


def test_compact_windows(corpus):
    chance = random.Random(3)
    word = lambda: "".join(chance.choice("abcdefgh") for _ in range(5))
    clean = [" ".join(word() for _ in range(150)) for _ in range(20)]
    passage = [word() for _ in range(60)]
    near = list(passage)
    near[30] = "changed"
    with_passage = [" ".join([word() for _ in range(40)] + (near if k == 3 else passage) + [word() for _ in range(30)]) for k in range(6)]
    short = [" ".join([word() for _ in range(40)] + passage[:40] + [word() for _ in range(30)]) for _ in range(2)]
    rows = list(enumerate(clean)) + [(100 + k, t) for k, t in enumerate(with_passage)] + [(200 + k, t) for k, t in enumerate(short)]
    rows += [(300, clean[0].upper()), (301, clean[1]), (302, None), (303, ""), (None, clean[2]), (100, with_passage[0]), (0, "another text under id 0")]
    got = compact_windows.find(corpus(rows)).collect()
    linked = {frozenset((r["doc_id"], r["other_id"])) for r in got}
    assert frozenset((0, 300)) in linked and frozenset((1, 301)) in linked
    group = {100 + k for k in range(6)}
    reached = {100}
    for _ in range(6):
        reached |= {x for pair in linked if pair & reached for x in pair}
    assert reached == group
    assert not {x for pair in linked for x in pair} - group - {0, 300, 1, 301}
    texts = dict(rows[:-1])
    for r in got:
        if r["kind"] == "passage" and 103 not in (r["doc_id"], r["other_id"]) and r["doc_id"] >= 100 and r["doc_id"] < 200:
            own = texts[r["doc_id"]].split()[r["start"] : r["end"]]
            assert own == passage == texts[r["other_id"]].split()[r["other_start"] : r["other_end"]]
    assert compact_windows.find(corpus([])).count() == 0


def test_compact_windows_of_ids_with_several_texts_and_repeated_rows(corpus):
    chance = random.Random(5)
    words = lambda n: ["".join(chance.choice("abcdefgh") for _ in range(5)) for _ in range(n)]
    copied, passage = " ".join(words(80)), words(60)
    held = [" ".join(words(40) + passage + words(40)) for _ in range(2)]
    twice = " ".join(words(30) + held[0].split()[:70])
    rows = [(1, copied), (9, copied), (9, held[0]), (9, held[0]), (5, held[1]), (5, held[1]), (9, twice)]
    got = [tuple(r) for r in compact_windows.find(corpus(rows)).collect()]
    assert len(got) == len(set(got))
    linked = {(frozenset(r[:2]), r[2]) for r in got}
    assert (frozenset((1, 9)), "copy") in linked and (frozenset((5, 9)), "passage") in linked
    assert not [r for r in got if r[0] == r[1]]


def test_compact_windows_reach_all_of_large_groups(corpus):
    """Recall on groups of near copies of one passage, each with one word of it changed: every member is connected to its group."""
    chance = random.Random(8)
    words = lambda n: ["".join(chance.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    rows, groups = [], []
    for g in range(4):
        passage = words(70)
        for k in range(150):
            own = list(passage)
            own[chance.randrange(70)] = f"changed{k}"
            rows.append((1000 * g + k, " ".join(words(chance.randrange(5, 60)) + own + words(chance.randrange(5, 60)))))
        groups.append({1000 * g + k for k in range(150)})
    found = compact_windows.find(corpus(rows)).collect()
    root = {i: i for i, _ in rows}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for r in found:
        assert r["doc_id"] // 1000 == r["other_id"] // 1000
        root[top(r["doc_id"])] = top(r["other_id"])
    # the largest connected part of each group
    reached = [max(sum(top(i) == t for i in group) for t in group) for group in groups]
    assert sum(reached) >= 0.9 * len(rows), reached


def test_compact_windows_compares_the_rest_of_a_group(corpus):
    """Two near copies meet under one minimum only, with a change on either side of it, and a text of lower id has it by chance."""
    chance = np.random.default_rng(11)
    mixed = lambda own: compact_windows.mix(own ^ compact_windows._SALTS[0]) | np.uint64(1)
    words = lambda n: [f"w{x}" for x in chance.integers(0, 1 << 40, n)]
    lowest = lambda own: int(np.argmin(mixed(compact_windows.tokens(" ".join(own).encode()))))
    while lowest(own := words(95)) != 45:
        pass
    near = list(own)
    near[39], near[59] = words(2)
    assert lowest(near) == 45
    # the lowest of its own text too, so that it is a window there
    while lowest(decoy := words(60) + own[45:50] + words(60)) != 60:
        pass
    rows = [(0, " ".join(decoy)), (1, " ".join(own)), (2, " ".join(near)), (3, " ".join(words(95)))]
    got = compact_windows.find(corpus(rows), functions=1).collect()
    assert [(r["doc_id"], r["other_id"], r["start"], r["end"]) for r in got] == [(2, 1, 0, 95)]


def test_rest_of_a_group_finds_all_similar_pairs(spark, monkeypatch):
    """All pairs of windows of one minimum, in one block and in several, against brute force."""
    chance = np.random.default_rng(12)
    base, texts, minimum = chance.integers(0, 1 << 40, (3, 90)), [], chance.integers(0, 1 << 40, 5)
    for k in range(60):
        own = base[k % 3].copy()
        own[chance.choice(90, k // 3 % 3, replace=False)] = chance.integers(0, 1 << 40, k // 3 % 3)
        texts.append(" ".join(map(str, [*own[:43], *minimum, *own[43:]])))
    sets = [compact_windows.tokens(t.encode()) for t in texts]
    rows = spark.createDataFrame([(k, 0, t.encode()) for k, t in enumerate(texts)], "doc bigint, version bigint, text binary")
    wanted = spark.createDataFrame([(7, k, 43, 0, 90, 60, k) for k in range(60)], "key bigint, doc bigint, place bigint, l int, r int, size bigint, label bigint")
    similar = {(i, j) for i in range(60) for j in range(i + 1, 60) if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))}
    assert len(similar) > 100
    pairs = lambda wanted, leaders=False: {(r["a"], r["b"]) for r in compact_windows._alike(compact_windows._surroundings(rows, wanted, 46, 0.8).withColumn("lead", F.col("doc") == 3), 46, 0.8, leaders).collect()}
    for part in (compact_windows.PART, 25):
        monkeypatch.setattr(compact_windows, "PART", part)
        found = pairs(wanted)
        assert similar <= found and not [p for p in found if p[0] % 3 != p[1] % 3]
        assert {p for p in similar if 3 in p} <= (of_lead := pairs(wanted, True)) and {3} == set.intersection(*map(set, of_lead))
    # what one label holds is connected already
    assert not pairs(wanted.withColumn("label", wanted["doc"] % 3))


def test_anchors_that_cannot_be_in_a_similar_stretch_are_not_searched(monkeypatch):
    """Fewest different shingles that a stretch lacks, against brute force; texts of repeated lines with too little in common end there."""
    chance = np.random.default_rng(13)
    for _ in range(60):
        n, least = int(chance.integers(4, 60)), int(chance.integers(2, 5))
        own, flags = chance.integers(0, 8, n), chance.random(8) < 0.5
        got = compact_windows._fewest_alone(own, flags[own], least)
        lacking = [len(set(own[s : s + least][~flags[own[s : s + least]]].tolist())) for s in range(n - least + 1)]
        assert got.tolist() == [min(lacking[max(0, at - least + 1) : at + 1]) for at in range(n)]
    monkeypatch.setattr(compact_windows, "_Search", None)
    a, b = np.tile(np.arange(30), 20), np.tile(np.concatenate((np.arange(24), np.arange(50, 56))), 20)
    assert not compact_windows.passages(a.astype(np.uint32), b.astype(np.uint32), [(k, k) for k in range(3, 600, 30)], 46, 0.8)


def test_runs_of_one_word_are_no_match_for_each_other(spark):
    """A shingle that repeats counts once: a short run of one word between others makes no pair with a long one."""
    chance = np.random.default_rng(14)
    words = lambda n: [f"w{x}" for x in chance.integers(0, 1 << 40, n)]
    texts = [" ".join(["lol"] * run + words(n)) for run, n in ((37, 60), (130, 0), (132, 5))]
    rows = spark.createDataFrame([(k, 0, t.encode()) for k, t in enumerate(texts)], "doc bigint, version bigint, text binary")
    wanted = spark.createDataFrame([(7, k, 0, 0, 92, 3, k) for k in range(3)], "key bigint, doc bigint, place bigint, l int, r int, size bigint, label bigint")
    near = compact_windows._surroundings(rows, wanted, 46, 0.8).withColumn("lead", F.lit(False))
    assert {(r["a"], r["b"]) for r in compact_windows._alike(near, 46, 0.8).collect()} == {(1, 2)}


def test_windows_of_a_text_that_repeats_itself_are_not_paired_all_with_all(spark):
    """Each place of a repeated passage makes a pair with one place of the other text, whatever their labels."""
    words = " ".join(f"w{x}" for x in np.random.default_rng(15).integers(0, 1 << 40, 100))
    rows = spark.createDataFrame([(k, 0, " ".join([words] * 12).encode()) for k in range(2)], "doc bigint, version bigint, text binary")
    places = list(range(150, 1050, 100))
    windows = [(7, doc, p, p - 50, p + 49, 18, 5000 * doc + p) for doc in range(2) for p in places]
    wanted = spark.createDataFrame(windows, "key bigint, doc bigint, place bigint, l int, r int, size bigint, label bigint")
    near = compact_windows._surroundings(rows, wanted, 46, 0.8).withColumn("lead", F.lit(False))
    got = compact_windows._alike(near, 46, 0.8).collect()
    assert {(r["a"], r["b"]) for r in got} == {(0, 1)} and len(got) < 2 * len(places)
    assert {r["ca"] for r in got} == {r["cb"] for r in got} == set(places)


def test_last_stage_decodes(spark, corpus):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rows = [(1, "some text, é 漢字\n"), (2, ""), (3, None), (1, "other text")]
    out = corpus_pipeline.encode(spark, corpus(rows), "").collect()
    assert sorted((r["doc_id"], r["decoded_sha256"]) for r in out) == sorted((d, hashlib.sha256((t or "").encode()).hexdigest()) for d, t in rows)
    assert all(r["n_tokens"] * 4 == len(r["ids"]) for r in out)


def test_pipeline(spark, tmp_path, corpus):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    chance = random.Random(9)
    word = lambda: "".join(chance.choice("aeioubcdfg") for _ in range(6))
    text = lambda n: "\n".join(" ".join(word() for _ in range(12)).capitalize() + "." for _ in range(n))
    clean = [text(6) for _ in range(30)]
    junk = [" ".join(f"{word()}***" for _ in range(60)) for _ in range(12)]
    question = " ".join(word() for _ in range(20))
    copies = [clean[0].replace("\n", " "), clean[0].replace("\n", "  ")]  # one line: only the n-gram join can see them
    rows = clean + junk + copies + [" ".join(word() for _ in range(40)) + " " + question, None, "", clean[1]]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, question)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(k, int(k < 30), 0) for k in range(42)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(out) == set(range(30))
