"""Role repair against an exhaustive search, and the pipeline's stages."""

import random
import re
from collections import defaultdict

import __spark_entry__
import corpus_pipeline
from strideframe.llm import chat
from strideframe.llm.common import keep
from tests.llm.support import SMALL, hard_docs

TURNS = "conv_id long, turn long, role string, text string, cost int, part string"


def turns():
    rng = random.Random(2)
    rows = []
    for c in range(50):
        for t in range(rng.randrange(1, 8)):
            rows.append((c or None, t if rng.random() < 0.95 else None, rng.choice(["system", "user", "assistant", "assistant", "tool", None]), rng.choice(["hi", None, "x\ny"])))
    rows += [(900, t, rng.choice(["user", "assistant", "system"]), "t") for t in range(60)] + [(901, 1, "user", "same")] * 7
    return [(*r, 5, "p") for r in rows]


def least_cost(roles):
    reached = {0: 0}
    for role in roles:
        new: dict[int, int] = {}
        for state, cost in reached.items():
            options = [(state, 2 + (6, 4, 4)[state - 1] * (state - 1 != role))] if state else []
            edge = [(state, 0)]
            for _ in range(3):
                options += [(r + 1, c + (6, 4, 4)[r] * (r != role)) for s, c in edge for r in chat.NEXT[s]]
                edge = [(r + 1, c + 3) for s, c in edge for r in chat.NEXT[s]]
            for s, c in options:
                new[s] = min(new.get(s, 10**9), cost + c)
        reached = new
    return min(c + 3 * (s == 1) for s, c in reached.items())


def test_repairs_are_legal_cheapest_and_independent_of_cuts(spark):
    frame = spark.createDataFrame(turns(), TURNS)
    told = []
    for rows in (5, 17, 100_000):
        found = defaultdict(list)
        for r in sorted(chat.repair(frame, rows).collect(), key=lambda r: (r["part"], r["position"])):
            found[r["conv_id"]].append(tuple(r)[1:7] + (r["piece"],))
        told.append(found)
    assert told[0] == told[1] == told[2] and sum(map(len, told[0].values())) == len(turns())
    for rows in told[0].values():
        assert sum(r[5] for r in rows) == least_cost([{"system": 0, "user": 1, "assistant": 2}.get(r[1], 3) for r in rows])
        text = "".join(r[6] for r in rows)
        roles, state = re.findall(r"<\|(system|user|assistant)\|>", text), 0
        for role in roles:
            assert chat.ROLES.index(role) in chat.NEXT[state]
            state = chat.ROLES.index(role) + 1
        assert chat.ENDS[state] and text.count("<|end|>") == len(roles)


def test_rendering_and_empty_tables(spark):
    rows = [(1, 0, "assistant", "a", 0, ""), (1, 1, "user", "b", 0, ""), (1, 2, "user", None, 0, ""), (2, 0, "system", "s", 0, "")]
    got = {r["conv_id"]: (r["cost"], r["rendered"]) for r in chat.render(chat.repair(spark.createDataFrame(rows, TURNS))).collect()}
    assert got[2] == (3, "<|system|>\ns<|end|>\n<|user|>\n<|end|>\n")
    assert got[1] == (5, "<|user|>\n<|end|>\n<|assistant|>\na<|end|>\n<|user|>\nb\n<|end|>\n")
    assert chat.repair(spark.createDataFrame([], TURNS)).count() == 0


def test_stages_keep_columns_and_do_their_work(spark):
    docs = hard_docs(spark).select("doc_id", "text", "lang", "source", "n_chars")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = keep(stage(spark, docs, SMALL), name)
        assert docs.columns == before.columns
    left = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert 90 not in left and 91 not in left and 92 not in left and "a@b.co" not in "".join(left.values())
    assert len(left) == docs.count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count() == docs.count()
    empty = before.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SMALL)
        assert empty.count() == 0


def test_pipeline_on_the_smallest_table(spark):
    documents = spark.read.parquet(f"{SMALL}/documents.parquet")
    benchmark = [r["text"] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    out = {r["doc_id"] for r in corpus_pipeline.run(spark, SMALL).collect()}
    leaking = {k for k, t in texts.items() if any(b in t for b in benchmark)}
    assert out and not out & leaking
    seen = {texts[k] for k in out}
    assert len(seen) == len(out) and all(t in seen for k, t in texts.items() if not any(b in t for b in benchmark) and sum(t == u for u in texts.values()) == 1 and k in out)


def test_queries_are_registered_once_each():
    names = [n for n in __spark_entry__.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in __spark_entry__.queries()
