"""Near copies by minima, ranked search and conversation repair, against plain versions and SQL."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from strideframe.llm import lexical, minhash, stars, turns
from tests.llm.support import hard_docs, no_docs

LOWER = {i: i + 32 for i in range(65, 91)}

# --- near copies


def plain_groups(rows, words=5, percent=85):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets.append({tuple(w[k : k + words]) for k in range(len(w) - words + 1)} or ({tuple(w)} if w else set()))
    part = list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common) and part[a] != part[b]:
            part = [part[b] if p == part[a] else p for p in part]
    least = defaultdict(list)
    for k, (d, _) in enumerate(rows):
        least[part[k]] += [d] if d is not None else []
    return Counter((d, len(sets[k]), min(least[part[k]], default=None)) for k, (d, _) in enumerate(rows))


def near_rows(count=70, seed=4):
    rng = random.Random(seed)
    out = []
    for family in range(3):
        base = [f"W{rng.randrange(3000)}" for _ in range(300)]
        for k in range(count):
            words = list(base)
            for _ in range(rng.randrange(0, 12)):
                words[rng.randrange(len(words))] = f"n{rng.randrange(99)}"
            out.append((1000 * family + 200 + k, rng.choice([" ", "\n", "  "]).join(words), "en", "s", None))
    return out


@pytest.mark.parametrize("block", [1024, 8])
def test_near_copies_equal_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(stars, "LEAST", 3)
    monkeypatch.setattr(stars, "PART", 20)
    docs = hard_docs(spark, near_rows())
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = minhash.classes(docs).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == plain_groups(rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    assert minhash.classes(no_docs(spark)).count() == 0


def test_bands_meet_links_and_bound_of_signatures():
    # 60 pairs of sets with the least similarity that links
    rng = np.random.default_rng(2)
    a, b = minhash.universal(minhash.BANDS * minhash.ROWS)
    met, agree = [], []
    for _ in range(60):
        common, x, y = (np.unique(rng.integers(0, 2**64, n, np.uint64)) for n in (170, 15, 15))
        least = np.array([minhash.minima(np.sort(np.concatenate([common, z])), a, b) for z in (x, y)])
        keys = minhash.band_keys(least, minhash.BANDS, minhash.ROWS)
        met.append((keys[0] == keys[1]).any())
        marks = least >> np.uint64(1)
        agree.append(int((marks[0] == marks[1]).sum()))
    assert all(met) and min(agree) >= minhash.least_agreeing(minhash.BANDS * minhash.ROWS, 85)
    assert abs(np.mean(agree) / 125 - 0.85) < 0.02


def test_stars_equal_plain_components(spark, monkeypatch):
    monkeypatch.setattr(stars, "LEAST", 3)
    monkeypatch.setattr(stars, "PART", 10)
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(40)] + [(500, 500 + k) for k in range(1, 60)] + [(rng.randrange(700, 800), rng.randrange(700, 800)) for _ in range(90)]
    part = {n: n for e in edges if e[0] != e[1] for n in e}
    for _ in part:
        for u, v in edges:
            if u != v:
                part[u] = part[v] = min(part[u], part[v])
    got = stars.components(spark.createDataFrame(edges, "u long, v long").repartition(4)).collect()
    assert Counter(map(tuple, got)) == Counter(part.items())
    assert stars.components(spark.createDataFrame([], "u long, v long")).count() == 0


# --- ranked search


def plain_search(docs, items, count=20):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    held = [(d, Counter(terms(t))) for d, t in docs]
    many, total, having = sum(1 for _, c in held if c), sum(sum(c.values()) for _, c in held), Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        found = []
        for d, c in held:
            score = 0
            for t, times in Counter(terms(text)).items():
                if c[t]:
                    weight = math.floor(1000 * math.log((2 * many + 2) / (2 * having[t] + 1)))
                    m = 75 + 25 * sum(c.values()) * many // total
                    score += times * weight * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m))
            if score > 0:
                found.append((-score, d is None, d or 0))
        out += [(item, k + 1, None if no else d, -s) for k, (s, no, d) in enumerate(sorted(found)[:count])]
    return Counter(out)


@pytest.mark.parametrize("block", [1 << 15, 40])
def test_search_equals_scoring_every_document(spark, monkeypatch, block):
    monkeypatch.setattr(lexical, "BLOCK", block)
    monkeypatch.setattr(lexical, "ROUND", 3)
    monkeypatch.setattr(lexical, "MAPS", 16)
    if block == 40:
        monkeypatch.setattr(lexical, "ITEM_BYTES", 2000)
    rng = random.Random(6)
    vocabulary = [f"{rng.choice('abcé日')}{k}" for k in range(90)]
    text = lambda n: rng.choice([" ", "-", "\t."]).join(rng.choice(vocabulary[: rng.choice([8, 90])]).upper() for _ in range(n))
    docs = hard_docs(spark, [(500 + k, text(rng.randrange(0, 60)), "en", "s", None) for k in range(200)])
    items = [(k, text(rng.randrange(1, 30))) for k in range(12)] + [(3, "River stone the the"), (3, "River stone the the"), (None, "über 42"), (70, None), (71, "..."), (72, "unknown"), (73, " ".join(vocabulary))]
    frame = spark.createDataFrame([(*i, 9) for i in items], "item_id long, text string, rank int")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert Counter(map(tuple, lexical.search(docs, frame).collect())) == plain_search(rows, items)
    assert lexical.search(no_docs(spark), frame).count() == 0 and lexical.search(docs, frame.limit(0)).count() == 0


# --- conversations

TURNS = "conv_id long, turn long, role string, text string, cost int, part string, copies int, fault string"


def plain_repair(rows, costs):
    """Cheapest and then least initials over every order of edits, for rows (initial, must go or truncated)."""
    after = {0: 2, 1: 2, 2: 3, 3: 2}

    def inserted(ways):
        for _ in range(4):
            for s, (cost, audit, out) in list(ways.items()):
                to = after[s]
                way = (cost + costs.insert, audit + "I", (*out, (None, "user" if to == 2 else "assistant")))
                if to not in ways or way[:2] < ways[to][:2]:
                    ways[to] = way
        return ways

    ways = {0: (0, "", ())}
    for k, (initial, fault) in enumerate(rows):
        found: dict = {}
        for s, (cost, audit, out) in inserted(ways).items():
            moves = [(s, costs.delete, "D", None)]
            if fault < 2:
                more, to = costs.truncated * fault, after[s]
                moves.append((to, more + costs.rerole, "R", "user" if to == 2 else "assistant"))
                moves += [(1, more, "K", "")] * (initial == "s" and s == 0) + [(to, more, "K", "")] * (initial == " sua"[to])
            for to, price, edit, role in moves:
                way = (cost + price, audit + edit, out if role is None else (*out, (k, role)))
                if to not in found or way[:2] < found[to][:2]:
                    found[to] = way
        ways = found
    ways = inserted(ways)
    return min((ways[s] for s in (0, 3) if s in ways), key=lambda w: w[:2])


def plain_digests(table, costs, damaged):
    convs, ids = defaultdict(list), set()
    for conv, turn, role, text in table:
        ids.add(conv)
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damaged else 9
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
        convs[conv] += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = []
    for conv in ids:
        rows = sorted(convs[conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for _, role, text in rows:
            end = text.rstrip(" \t\n\x0b\x0c\r")[-1:]
            faults.append(3 if not end else 2 if (role, text) in seen else 0 if end in ".!?" else 1)
            seen.add((role, text))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
        known = [t for t, _, _ in rows if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        cost, audit, ways = plain_repair([(r[1][:1], min(f, 2)) for r, f in zip(rows, faults, strict=True)], costs)
        lines = [f"{role or rows[k][1]}:{rows[k][2] if k is not None else ''}" for k, role in ways]
        out.append((conv, gaps, faults.count(3), faults.count(2), faults.count(1), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return Counter(out)


def hard_turns():
    rng = random.Random(3)
    rows = []
    for c in range(50):
        for t in range(rng.randrange(1, 30)):
            rows.append((c or None, rng.choice([t, t, t, None, t - 1]), rng.choice(["system", "user", "assistant", "user", "assistant", "tool", None, ""]), rng.choice(["hi.", "no", "", None, "x\ny?", "  ", "end! \t", "é。"])))
    rows += [(900, t, rng.choice(["user", "assistant", "system"]), rng.choice([f"t{t}.", f"t{t}", "same."])) for t in range(150)]
    rows += [(901, 1, "user", "same.")] * 30 + [(902, t, "system", f"a{t}.") for t in range(40)] + [(903, 1, "user", "long " * 50_000 + "end.")]
    rng.shuffle(rows)
    return rows


CASES = [(7, turns.Costs()), (1 << 16, turns.Costs()), (5, turns.Costs(3, 4, 1, 2)), (11, turns.Costs(2, 6, 2, 1)), (6, turns.Costs(1, 1, 1, 1))]


@pytest.mark.parametrize(("rows", "costs"), CASES)
def test_repairs_are_the_least_of_the_cheapest(spark, monkeypatch, rows, costs):
    monkeypatch.setattr(turns, "ROWS", rows)
    monkeypatch.setattr(turns, "PIECE", 16)
    table = hard_turns()
    frame = spark.createDataFrame([(*r, 5, "p", 3, "f") for r in table], TURNS).repartition(5)
    assert Counter(map(tuple, turns.digests(turns.repair(frame, costs)).collect())) == plain_digests(table, costs, False)


def test_damaged_conversations(spark, monkeypatch):
    monkeypatch.setattr(turns, "ROWS", 20)
    table = hard_turns() + [(3_000_000 + k, 0, "user", "only.") for k in range(40)]
    frame = spark.createDataFrame([(*r, 5, "p", 3, "f") for r in table], TURNS)
    assert Counter(map(tuple, turns.audit_damaged(frame).collect())) == plain_digests(table, turns.Costs(), True)
    assert turns.audit_damaged(frame.limit(0)).count() == 0
    edits = turns.repair(frame).collect()
    assert sum(r["times"] for r in edits if r["edit"] != "I") == len(table)


def test_halves_meet_where_the_whole_is_least():
    rng = random.Random(8)
    vectors = turns.Vectors(turns.Costs(2, 5, 1, 1))
    for _ in range(300):
        codes = bytes(rng.randrange(12) for _ in range(rng.randrange(0, 14)))
        edits = vectors.solve(codes, turns.START, vectors.last(turns.START, codes))
        cost, audit, _ = plain_repair([("sua "[c % 4], c // 4) for c in codes], turns.Costs(2, 5, 1, 1))
        end = vectors.last(turns.START, codes)
        assert "".join(edits) + vectors.closing[end][1] == audit
