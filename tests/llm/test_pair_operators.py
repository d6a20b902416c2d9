"""Operators that compare rows, against all pairs."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from strideframe.llm import components, decontaminate, repeats, simhash, topk
from tests.llm.support import hard_docs, no_docs

# --- substring dedup


def plain_removed(rows, length, every):
    seen = defaultdict(list)
    for r, (d, t) in enumerate(rows):
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]].append((d, i, r))
    out = []
    for r, (d, t) in enumerate(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            at = seen[b[i : i + length]]
            if (len(at) > 1) if every else min(at) != (d, i, r):
                gone[i : i + length] = b"\1" * length
        left = bytes(c for c, x in zip(b, gone, strict=True) if not x)
        runs = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), runs, hashlib.sha256(left).hexdigest()))
    return Counter(out)


def repeat_rows():
    rng = random.Random(5)
    parts = ["".join(rng.choice("ab cdé") for _ in range(rng.choice([150, 199, 200, 201, 400]))) for _ in range(10)]
    rows = []
    for k in range(70):
        pieces = (rng.choice(parts)[rng.randrange(0, 40) :] if rng.random() < 0.6 else "".join(rng.choice("xyz ") for _ in range(rng.randrange(90))) for _ in range(rng.randrange(6)))
        rows.append((k, "".join(pieces)))
    return [*rows, (200, None), (201, ""), (202, "a" * 700), (203, "a" * 199), (204, "ab" * 300), (205, "ab" * 300 + "c"), (206, "q" * 450)]


@pytest.mark.parametrize("group", [20_000, 2])
@pytest.mark.parametrize("every", [True, False])
def test_repeats_equal_all_substrings(spark, monkeypatch, every, group):
    monkeypatch.setattr(repeats, "GROUP", group)
    rows = repeat_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = repeats.removed(docs, 200, every).selectExpr("doc_id", "n_bytes", "n_removed", "n_spans", "sha2(kept, 256)").collect()
    assert Counter(map(tuple, got)) == plain_removed(rows, 200, every)


def test_long_texts_go_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(repeats, "PIECE", 700)
    rng = random.Random(2)
    shared = "".join(rng.choice("abcdef") for _ in range(900))
    rows = [(1, "".join(rng.choice("gh") for _ in range(3000)) + shared), (2, shared[100:] + "x" * 1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, repeats.digests(docs).collect())) == plain_removed(rows, 200, True)


def test_equal_rows_are_told_once(spark):
    rng = random.Random(3)
    text = "".join(rng.choice("abcdef ") for _ in range(1380))
    docs = spark.createDataFrame([(1, text)] * 3000 + [(2, text[:300] + "z" * 50)], "doc_id long, text string").repartition(4)
    starts = repeats.repeated(repeats._keyed(docs)).collect()
    assert len(starts) == 2 and max(len(r["starts"]) for r in starts) < 50
    got = Counter(map(tuple, repeats.digests(docs).collect()))
    assert got[(1, 1380, 1380, 1, hashlib.sha256(b"").hexdigest())] == 3000 and len(got) == 2


def test_repeats_bear_hard_rows(spark):
    docs = hard_docs(spark).where("length(coalesce(text, '')) < 30000")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert Counter(map(tuple, repeats.digests(docs).collect())) == plain_removed(rows, 200, True)
    assert repeats.digests(no_docs(spark)).count() == 0


# --- fingerprints


def plain_fingerprint(text, width=3):
    lower = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
    words = (text or "").encode().translate(lower).split()
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + width]) for k in range(len(words) - width + 1)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_classes(rows, linked=3):
    prints = [plain_fingerprint(t) for _, t in rows]
    part = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= linked and part[a] != part[b]:
                old, new = part[a], part[b]
                part = [new if p == old else p for p in part]
    least = {p: min((rows[k][0] for k in range(len(rows)) if part[k] == p and rows[k][0] is not None), default=None) for p in set(part)}
    return Counter((rows[k][0], f"{prints[k]:016x}", least[part[k]]) for k in range(len(rows)))


@pytest.mark.parametrize("linked", [3, 5])
def test_every_link_has_a_common_key(linked):
    rng = np.random.default_rng(1)
    golay = simhash.Golay()
    a = rng.integers(0, 2**63, 1500, dtype=np.int64) * 2 + rng.integers(0, 2, 1500)
    keys = set(zip(*[x.tolist() for x in simhash.fuzzy_keys(a, golay, linked)], strict=True))
    for errors in range(linked + 1):
        b = a.view(np.uint64).copy()
        for k in range(len(b)):
            for bit in rng.choice(64, errors, replace=False):
                b[k] ^= np.uint64(1) << np.uint64(bit)
        rows, other = simhash.fuzzy_keys(b.view(np.int64), golay, linked)
        assert {r for r, k in zip(rows.tolist(), other.tolist(), strict=True) if (r, k) in keys} == set(range(len(a)))


@pytest.mark.parametrize("block", [1024, 4])
def test_classes_equal_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(4)
    base = [f"w{rng.randrange(2000)}" for _ in range(400)]
    near = []
    for k in range(60):
        words = list(base)
        for _ in range(rng.randrange(0, 6)):
            words[rng.randrange(len(words))] = f"n{rng.randrange(9)}"
        near.append((500 + k, " ".join(words), "en", "s", None))
    docs = hard_docs(spark, near)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert Counter(map(tuple, simhash.classes(docs).collect())) == plain_classes(rows)
    wide = simhash.groups(docs, linked=5).selectExpr("doc_id", "lpad(lower(hex(fp)), 16, '0')", "component_id")
    assert Counter(map(tuple, wide.collect())) == plain_classes(rows, 5)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter({c for _, _, c in plain_classes(rows)})
    same_id = spark.createDataFrame([(1, "one text here"), (1, "another text there"), (1, "one text here"), (None, "nobody knows this"), (None, "nobody knows this"), (None, "nor this one")], "doc_id long, text string")
    assert Counter(map(tuple, simhash.one_of_each(same_id).collect())) == Counter(set(map(tuple, same_id.collect())))
    assert simhash.classes(no_docs(spark)).count() == 0 and simhash.one_of_each(no_docs(spark)).count() == 0


def test_keys_are_never_sent_to_every_task(spark):
    """A fingerprint makes tens of keys: Spark's estimate of their size is far too low."""
    rng = np.random.default_rng(2)
    prints = spark.createDataFrame([(int(x),) for x in rng.integers(0, 2**62, 300)] + [(1,), (3,)], "fp long")
    found = simhash.links(prints)
    assert [tuple(r) for r in found.collect()] == [(3, 1)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [key" not in plan and "SortMergeJoin [key" in plan


def plain_shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set())


def plain_near_copies(rows, linked=5, least=0.8):
    prints, sets = [plain_fingerprint(t) for _, t in rows], [plain_shingles(t) for _, t in rows]
    part = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            alike = sets[a] == sets[b] or (prints[a] ^ prints[b]).bit_count() <= linked and both >= least * (len(sets[a]) + len(sets[b]) - both)
            if alike and part[a] != part[b]:
                old, new = part[a], part[b]
                part = [new if p == old else p for p in part]
    members = defaultdict(list)
    for k, p in enumerate(part):
        members[p].append(k)
    return members


@pytest.mark.parametrize("block", [1024, 4])
def test_near_copies_are_verified_links_of_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(4)
    near = []
    for g in range(3):  # edits of up to 24 of 200 words: close fingerprints on both sides of 0.8
        base = [f"w{rng.randrange(2000)}" for _ in range(200)]
        for k in range(25):
            words = list(base)
            for at in rng.sample(range(200), rng.randrange(0, 25)):
                words[at] = f"n{rng.randrange(9)}"
            near.append((500 + 100 * g + k, " ".join(words), "en", "s", None))
    docs = hard_docs(spark, near)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    members = plain_near_copies(rows)
    prints = [plain_fingerprint(t) for _, t in rows]
    apart = [(a, b) for a in range(len(rows)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 5 and not any(a in m and b in m for m in members.values())]
    assert apart  # close fingerprints of texts that are no near copies
    got = defaultdict(list)
    for r in simhash.near_copies(docs).collect():
        got[r["component"]].append(r["doc_id"])
    order = lambda lists: sorted(sorted(-1 if x is None else x for x in ids) for ids in lists)
    assert order(got.values()) == order([[rows[k][0] for k in m] for m in members.values()])
    kept = simhash.one_of_near_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len(members)
    assert simhash.one_of_near_copies(no_docs(spark)).count() == 0


@pytest.mark.parametrize("block", [1024, 4])
def test_minima_find_near_copies_at_any_distance(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(4)
    near = []
    for g in range(3):  # edits of up to 8 of 200 words: few fingerprints of the usual kind are close
        base = [f"w{rng.randrange(2000)}" for _ in range(200)]
        for k in range(25):
            words = list(base)
            for at in rng.sample(range(200), rng.randrange(0, 9)):
                words[at] = f"n{rng.randrange(9)}"
            near.append((500 + 100 * g + k, " ".join(words), "en", "s", None))
    docs = hard_docs(spark, near)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    members = plain_near_copies(rows, linked=64)  # every pair that is alike
    home = {k: p for p, m in members.items() for k in m}
    sets = [plain_shingles(t) for _, t in rows]
    alike = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] != sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    got = {r["doc_id"]: r["component"] for r in simhash.near_copies(docs, minima=True).collect()}
    unique = [k for k, (d, _) in enumerate(rows) if sum(d == e for e, _ in rows) == 1]
    whose = defaultdict(set)
    for k in unique:
        whose[got[rows[k][0]]].add(home[k])
    assert all(len(w) == 1 for w in whose.values())  # nothing else is joined
    met = [got[rows[a][0]] == got[rows[b][0]] for a, b in alike]
    assert len(alike) > 100 and sum(met) >= 0.95 * len(met)
    kept = simhash.one_of_near_copies(docs, minima=True)
    assert kept.columns == docs.columns and len(members) <= kept.count() <= len(members) + 3
    assert simhash.one_of_near_copies(no_docs(spark), minima=True).count() == 0


def test_components_of_paths_and_stars(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 160)] + [(300, 299), (299, 300), (7, 7)]
    got = components.components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {r["node"]: r["component"] for r in got} == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 160)}, 299: 299, 300: 299} and len(got) == 103
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


# --- benchmark


def plain_score(item, window):
    best = [[0] * (len(window) + 1) for _ in range(len(item) + 1)]
    for i, x in enumerate(item):
        for j, y in enumerate(window):
            best[i + 1][j + 1] = max(0, best[i][j] + (2 if x == y else -1), best[i][j + 1] - 1, best[i + 1][j] - 1)
    return max(map(max, best))


def test_alignment_equals_the_full_table():
    rng = random.Random(6)
    items = [np.array([rng.randrange(6) for _ in range(rng.randrange(1, 12))], np.uint64) for _ in range(200)]
    windows = [np.array([rng.randrange(6) for _ in range(rng.randrange(0, 25))], np.uint64) for _ in range(200)]
    assert decontaminate.align(items, windows).tolist() == [plain_score(a.tolist(), b.tolist()) for a, b in zip(items, windows, strict=True)]


def test_edited_copies_are_found_and_others_left(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 9)))
    items = [(k, " ".join(word() for _ in range(rng.randrange(12, 40)))) for k in range(12)] + [(50, "Two words"), (51, None), (52, "!!!")]
    rows = []
    for k, text in items[:12]:
        words = text.upper().split()
        for _ in range(len(words) // 8):
            words[rng.randrange(len(words))] = "edited"
        rows.append((600 + k, " ".join(word() for _ in range(50)) + " " + ", ".join(words) + ". " + word(), "en", "s", None))
        rows.append((700 + k, " ".join(word() for _ in range(90)), "en", "s", None))
    docs = hard_docs(spark, rows)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.leaks(docs, benchmark).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(600 + k, k) for k in range(12)}
    kept = decontaminate.clean_rows(docs, benchmark)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 12
    assert decontaminate.leaks(no_docs(spark), benchmark).count() == 0
    assert decontaminate.clean_rows(docs, spark.createDataFrame([], "item_id long, text string")).count() == docs.count()


# --- top-k


def vectors():
    rng = np.random.default_rng(0)
    rows = [(k, [float(x) for x in rng.normal(0, 0.3, 5)]) for k in range(250)] + [(1000 + k, [0.1] * 5) for k in range(60)]
    return [*rows, (7, [0.2] * 5), (20, None), (40, [1.0, None, 0.0, 0.0, 0.0]), (60, [float("nan")] * 5), (80, [float("inf")] * 5), (100, []), (120, [1e30] * 5), (140, [0.5] * 3), (None, [0.1] * 5), (1000, [0.1] * 5)]


def plain_top(rows):
    sound = []
    for k, v in rows:
        if k is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            sound.append((k, [int(np.floor(max(min(float(np.float32(x)) * 64, 2.0**52), -(2.0**52)))) for x in v]))
    out = []
    for a, (k, q) in enumerate(sound):
        if k % 20 == 0:
            score = lambda w: max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(q, w))))  # noqa: B023, E731
            best = sorted((-score(w), j) for b, (j, w) in enumerate(sound) if b != a)[:20]
            out += [(k, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("rows", [1 << 16, 40])
def test_top_rows_equal_all_scores(spark, monkeypatch, rows):
    monkeypatch.setattr(topk, "ROWS", rows)
    monkeypatch.setattr(topk, "QUERIES", 9)
    frame = spark.createDataFrame(vectors(), "vec_id long, embedding array<float>").selectExpr("*", "0 as rank", "1.5 as score", "'x' as row")
    assert sorted(map(tuple, topk.search(frame).collect())) == plain_top(vectors())
    assert topk.search(frame.limit(0)).count() == 0


def test_fewer_rows_than_wanted(spark):
    frame = spark.createDataFrame([(20, [1.0]), (3, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.search(frame).collect()] == [(20, 1, 3, 64 * 128)]


def test_a_task_holds_one_block_and_its_queries(spark, monkeypatch):
    """Blocks of one task are packed and met one after another, and each query leaves a task with k rows."""
    monkeypatch.setattr(topk, "ROWS", 20)
    monkeypatch.setattr(topk, "QUERIES", 4)
    monkeypatch.setattr(topk, "SETS", 2)
    monkeypatch.setattr(topk, "TASKS", 2)
    frame = spark.createDataFrame(vectors(), "vec_id long, embedding array<float>")
    assert sorted(map(tuple, topk.search(frame).collect())) == plain_top(vectors())
    rows = topk.quantised(frame)
    packed = topk._packed(rows, 16, 1).collect()  # all blocks in one task
    assert len(packed) == 16 and {r["kind"] for r in packed} == {"<i1", "<i8"}
    assert sum(len(r["ids"]) for r in packed) == 8 * rows.count()
    big = topk.Asked(np.array([5]), np.array([0]), np.array([[1]]), 2)
    for value, row in ((-(2**63), 1), (3, 2), (9, 3)):
        big.meet(topk.Sliced(np.array([[value]], np.int64)), np.array([row]), np.array([row]), {})
    assert big.rows().to_pydict() == {"query_id": [5, 5], "query_row": [0, 0], "vec_id": [3, 2], "row": [3, 2], "score": [9, 3]}
