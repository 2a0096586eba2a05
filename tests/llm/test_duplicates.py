import hashlib
import random
import re

import pytest

from tideline.llm import components, jaccard, suffixes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def shingle_set(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def slow_components(rows, k, percent):
    sets = [shingle_set(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(rows):
        if not sets[i]:
            out.append((d, 0, d))
        else:
            ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
            out.append((d, len(sets[i]), min(ids, default=None)))
    return sorted(out, key=str)


def near_copies(seed, n=150):
    """A large group of near copies, small groups, a shared passage, exact copies and loose texts."""
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdefghij", k=r.randint(2, 7)))
    base, passage = [word() for _ in range(120)], [word() for _ in range(30)]
    rows = []
    for i in range(n):
        kind = i % 5
        if kind < 2:
            w = list(base)
            for _ in range(r.randrange(5)):
                w[r.randrange(len(w))] = word()
            if r.random() < 0.3:
                w = w[: r.randint(100, 120)]
        elif kind == 2:
            w = [word() for _ in range(r.randint(1, 60))] + passage + [word() for _ in range(r.randint(0, 40))]
        elif kind == 3:
            w = [word() for _ in range(r.randint(1, 6))]
        else:
            w = rows[r.randrange(len(rows))][1].split()
            if r.random() < 0.5:
                w = [x.upper() for x in w]
        rows.append((i + 10, r.choice([" ", " ", "\n"]).join(w)))
    return rows


@pytest.mark.parametrize(("seed", "k", "percent", "common"), [(1, 3, 90, 64), (2, 3, 90, 5), (3, 5, 80, 5)])
def test_components_equal_all_pairs(spark, docs, odd, monkeypatch, seed, k, percent, common):
    monkeypatch.setattr(jaccard, "COMMON", common)
    rows = near_copies(seed) + [(d, t) for d, t, *_ in odd]
    df = docs([(d, t, "en", "a") for d, t in rows])
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.join(df, k, percent).collect()), key=str)
    assert got == slow_components(rows, k, percent)


def slow_keep(rows, k, percent):
    """doc_ids of the rows that stay: one of each component, that of the least doc_id, and all without words."""
    sets, left = [shingle_set(t, k) for _, t in rows], list(range(len(rows)))
    kept = [d for (d, _), s in zip(rows, sets) if not s]
    left = [i for i in left if sets[i]]
    while left:
        group, todo = [], [left.pop()]
        while todo:
            i = todo.pop()
            group.append(i)
            near = [j for j in left if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
            left = [j for j in left if j not in near]
            todo += near
        kept.append(min((rows[i][0] for i in group), key=lambda d: (d is None, d)))
    return sorted(kept, key=str)


def test_keep_first(spark, docs, odd):
    one, two = "a text of some eight words stands here", "and a quite different text under the same id"
    rows = near_copies(4, 60) + [(d, t) for d, t, *_ in odd] + [(700, one), (701, one), (701, two), (None, two + " but"), (None, two + " but")]
    df = docs([(d, t, "en", "a") for d, t in rows])
    kept = jaccard.keep_first(df, 5, 80)
    assert kept.columns == df.columns
    found = kept.collect()
    assert sorted((r["doc_id"] for r in found), key=str) == slow_keep(rows, 5, 80)
    assert [(r["doc_id"], r["text"]) for r in found if (r["doc_id"] or 0) >= 700] in ([(700, one), (701, two)], [(701, two), (700, one)])


def test_keep_first_with_a_full_filter(spark, docs, monkeypatch):
    rows = near_copies(4, 60) + [(700, "some other text of a few words"), (700, "some other text of a few words")]
    df = docs([(d, t, "en", "a") for d, t in rows])
    ids = sorted(r["doc_id"] for r in jaccard.keep_first(df, 5, 80).collect())
    monkeypatch.setattr(jaccard, "BLOOM_BITS", (64, 64))
    assert sorted(r["doc_id"] for r in jaccard.keep_first(df, 5, 80).collect()) == ids == slow_keep(rows, 5, 80)


def test_map_columns_and_repeated_rows(spark):
    rows = [(1, "a text of some eight words stands here", {"a": i % 2}) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, m map<string, int>")
    assert [(r["doc_id"], r["m"]["a"]) for r in jaccard.keep_first(df, 5, 80).collect()] in ([(1, 0)], [(1, 1)])


def test_a_token_in_every_document(spark, docs, monkeypatch):
    """Every document begins with one passage; documents are near in pairs only, and no token is rare enough to stand last."""
    monkeypatch.setattr(jaccard, "CROWD", 3)
    monkeypatch.setattr(jaccard, "COMMON", 10**6)
    r = random.Random(9)
    word = lambda: "".join(r.choices("abcdefghij", k=r.randint(2, 5)))
    passage = " ".join("long" * 3 + word() for _ in range(25))
    rows = []
    for i in range(40):
        own = [word() for _ in range(60)]
        rows += [(2 * i, " ".join([passage, *own])), (2 * i + 1, " ".join([passage, *own[:-1], word()]))]
    got = sorted(((x["doc_id"], x["n_shingles"], x["component_id"]) for x in jaccard.join(docs([(d, t, "en", "a") for d, t in rows]), 3, 90).collect()), key=str)
    assert got == slow_components(rows, 3, 90)


def test_no_documents(spark, docs):
    assert jaccard.join(docs([])).count() == 0 and suffixes.remove_repeats(docs([])).count() == 0


def test_star_components(spark):
    r = random.Random(6)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(5, 5)]
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {x["node"]: x["root"] for x in components.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {x: find(x) for p in pairs if p[0] != p[1] for x in p}


@pytest.mark.parametrize("few", [0, 1 << 18])
def test_components_by_rounds_and_at_once(spark, monkeypatch, few):
    monkeypatch.setattr(components, "FEW", few)
    low, high = -(1 << 63), (1 << 63) - 1
    pairs = [(i + 1, i) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(low, high), (high, 7), (-5, -6), (-6, -5), (-6, -5), (3, 3), (900, 900)]
    edges = spark.createDataFrame(pairs, "u long, v long")
    want = {i: low for i in range(41)} | {low: low, high: low} | {i: 100 for i in range(100, 130)} | {-5: -6, -6: -6}
    assert sorted(map(tuple, components.components(edges).collect())) == sorted(want.items())
    assert components.components(edges.filter("u = v")).count() == components.components(edges.limit(0)).count() == 0


def jobs_of(spark, run):
    """How many jobs run() takes; each exchange is one."""
    spark.sparkContext.setJobGroup(name := f"counted-{random.random()}", "")
    try:
        run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def test_small_tables_are_few_jobs_of_the_driver(spark, docs):
    """Each job's plans and threads fill the driver, so few links are not settled in rounds, nor pairs sought among none."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)], "u long, v long")
    assert jobs_of(spark, lambda: components.components(edges)) <= 8
    apart = docs([(i, f"a{i} b{i} c{i} d{i} e{i}", "en", "a") for i in range(20)])
    assert jobs_of(spark, lambda: jaccard.join(apart).count()) <= 60


def slow_removal(rows, length):
    seen, out = set(), []
    done = {}
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        b = (t or "").encode()
        if (d, b) in done:
            out.append(done[d, b])
            continue
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if b[i : i + length] in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(b[i : i + length])
        kept = bytes(x for x, g in zip(b, gone) if not g)
        done[d, b] = (d, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
        out.append(done[d, b])
    return sorted(out, key=str)


def passages(seed):
    r = random.Random(seed)
    text = lambda n: "".join(r.choices("abcde é\n", k=n))
    shared = [text(r.randint(80, 300)) for _ in range(4)]
    rows = [(5 + i, text(r.randint(0, 150)) + r.choice(shared) + text(r.randint(0, 90)) + r.choice(shared)[: r.randint(0, 300)]) for i in range(40)]
    return rows + [(100, "a" * 500), (101, "ab" * 200), (102, rows[3][1]), (103, rows[3][1]), (104, "a" * 100), (105, "a" * 99)]


@pytest.mark.parametrize(("seed", "many"), [(1, 4000), (2, 3)])
def test_removal_equals_every_window(spark, docs, odd, monkeypatch, seed, many):
    monkeypatch.setattr(suffixes, "MANY", many)
    rows = passages(seed) + [(d, t) for d, t, *_ in odd if d is not None]
    got = suffixes.remove_repeats(docs([(d, t, "en", "a") for d, t in rows]))
    assert sorted(map(tuple, got.collect()), key=str) == slow_removal(rows, 100)


def test_merge_sorts_all_suffixes():
    import numpy as np

    r = random.Random(3)
    strings = ["".join(r.choices("ab", k=r.randint(1, 30))) for _ in range(20)]
    coded = [np.array([ord(c) for c in s] + [0], np.uint16) for s in strings]
    groups = [np.concatenate(coded[a : a + 7]) for a in range(0, 20, 7)]
    made = [suffixes.shard_transform(g) for g in groups]
    source, common = suffixes.merge([t for _, t in made], 100)
    begin = np.concatenate([[0], np.cumsum([len(g) for g in groups])])
    place = np.concatenate([o + b for (o, _), b in zip(made, begin)])[source]
    whole = "".join("".join(chr(c) for c in g) for g in groups)
    end = lambda p: whole.index("\0", p)
    want = sorted(range(len(whole)), key=lambda p: (whole[p : end(p)] + "\0", p))
    key = lambda p: whole[p : end(p)]
    assert [key(p) for p in place] == [key(p) for p in want]
    for i in range(1, len(place)):
        a, b = key(place[i - 1]), key(place[i])
        n = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
        assert common[i] == n


def plain_merge(transforms, length):
    """Interleave refinement that passes every suffix through the transforms in every round."""
    import numpy as np

    bwt, shard = np.concatenate(transforms).astype(np.uint16), np.repeat(np.arange(len(transforms), dtype=np.uint8), [len(t) for t in transforms])
    ends, n = np.sort(shard[bwt == 0], kind="stable"), len(bwt)
    source, block, common, border = np.arange(n, dtype=np.int32), np.zeros(n, np.int32), np.full(n, length, np.int32), np.zeros(n, bool)
    border[0], common[0] = True, 0
    for depth in range(length):
        symbol = bwt[source]
        order = np.argsort(symbol, kind="stable")
        symbol, old = symbol[order], block[order]
        new = np.concatenate([[True], (symbol[1:] != symbol[:-1]) | (old[1:] != old[:-1])])
        new[: len(ends) + 1] = True
        common[new > border] = depth
        border |= new
        turn = shard[source[order]]
        turn[: len(ends)] = ends
        source = np.empty(n, np.int32)
        source[np.argsort(turn, kind="stable")] = np.arange(n, dtype=np.int32)
        block = np.cumsum(border, dtype=np.int32)
    return source, common


def test_settled_suffixes_are_passed_over():
    """Merging equals plain refinement, and costs less where most suffixes are soon alone."""
    import time

    import numpy as np

    r = np.random.default_rng(4)
    for letters, length, count, size in [(1, 30, 20, 40), (2, 1, 20, 40), (2, 9, 60, 40), (3, 69, 60, 90), (20, 69, 600, 140)]:
        passage = r.integers(1, letters + 1, size)
        strings = [np.append(np.concatenate([r.integers(1, letters + 1, int(r.integers(0, size))), passage[: int(r.integers(0, size) ** 2 // size)]]), 0).astype(np.uint16) for _ in range(count)]
        shards = [suffixes.shard_transform(np.concatenate(strings[a : a + count // 3]))[1] for a in range(0, count, count // 3)]
        took = {suffixes.merge: [], plain_merge: []}
        for _ in range(3):
            for merge, times in took.items():
                began = time.thread_time()
                found = merge(shards, length)
                times.append(time.thread_time() - began)
                if merge is suffixes.merge:
                    mine = found
        assert np.array_equal(mine[0], found[0]) and np.array_equal(mine[1], found[1])
    assert min(took[suffixes.merge]) < 0.8 * min(took[plain_merge])
