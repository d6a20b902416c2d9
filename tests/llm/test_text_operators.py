"""Operators that look at one text at a time, against plain versions of their rules."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from strideframe.llm import bpe, language, pii, sharding, token_files
from tests.llm.support import SMALL, hard_docs, no_docs

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- personal data

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = [int(c) for c in m[0] if c.isdigit()]
        doubled = [d if k % 2 == 0 else sum(map(int, str(2 * d))) for k, d in enumerate(reversed(digits))]
        if 14 <= len(digits) <= 19 and sum(doubled) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


def test_base_spans_equal_the_patterns():
    rng = random.Random(3)
    for parts in (["@", ".", "a", "b1", "-", "_", "+", " ", "1", "23", "255", "é", "("], list("0123456789 -.+()@a")):
        for _ in range(4000):
            text = "".join(rng.choice(parts) for _ in range(rng.randrange(70)))
            assert pii.base_spans(text) == plain_spans(text), text


def test_patterns_stay_linear():
    text = "1" * 200_000 + "@" * 1000 + "a.b@" * 20_000 + "+1" * 1000 + " " * 100_000 + "1.1." * 20_000 + "A" * 100_000
    assert len(pii.base_spans(text)) > 0 and pii.candidates(text, []) == []


def test_labelers_add_what_the_patterns_miss(spark):
    said = ["call me, phone (212) 555-0100 or mail a@gmail.com", "my name is John Smith, tel 212-555-0199", "ssn 123-45-6789, signed Maria Lopez", "iban DE89 3704 0044 0532 0130 00 and card 4111 1111 1111 1111"]
    clean = ["The House stood. Green Grass grew by version 10.2.3.4 of it", "Old Stone walls, Tall Trees and Dark Water", "order 123-45-678 shipped"]
    rows = [(200 + k, t, "en", "s", None) for k, t in enumerate(said * 5 + clean * 20)]
    docs = hard_docs(spark, rows)
    got = {r["doc_id"]: r for r in pii.find(docs).where("doc_id >= 200").collect()}
    assert all("local_phone" in got[k]["spans"] for k in (200, 201)) and "name" in got[201]["spans"]
    assert "national_id" in got[202]["spans"] and "iban" in got[203]["spans"]
    assert not any(re.search("name|local_phone|iban|national_id", got[200 + k]["spans"]) for k in range(20, 80))
    masked = {r["doc_id"]: r for r in pii.redact(docs).where("doc_id >= 200").collect()}
    assert masked[201]["text"] == "my name is [NAME], tel [LOCAL_PHONE]" and masked[220]["text"] == clean[0].replace("10.2.3.4", "[IP]")


def test_names_with_accents_are_candidates():
    name = pii.KINDS.index("name")
    for who in ("José García", "Lucía Pérez", "Anna Müller", "Élodie Durand", "John Smith", "Jose\u0301 Garci\u0301a"):
        text = f"signed by {who}, today"
        assert [(a, b) for a, k, b in pii.candidates(text, []) if k == name] == [(10, 10 + len(who))]
    assert not [k for _, k, _ in pii.candidates("éJohn Smith and of áb Cd", []) if k == name]


def test_pii_bears_hard_rows(spark):
    docs = hard_docs(spark)
    got = pii.find(docs).collect()
    assert len(got) == docs.count()
    want = Counter((r["doc_id"], sha(",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in plain_spans(r["text"] or "")))) for r in docs.collect())
    assert Counter((r["doc_id"], r["base_sha256"]) for r in got) == want
    assert pii.redact(docs).columns == docs.columns and pii.redact(docs).count() == docs.count()
    assert pii.find(no_docs(spark)).count() == 0 and pii.redact(no_docs(spark)).count() == 0


# --- language


def test_languages_are_told_apart_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    got = language.identify(docs).collect()
    assert {r["doc_id"] for r in got if r["held_out"]} == {k for k in truth if zlib.crc32(str(k).encode()) % 4 == 2}
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.93
    assert all(0 <= r["score"] <= 1 for r in got)


def test_held_out_labels_are_not_learned(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    spoiled = docs.selectExpr("doc_id", "text", "case when crc32(cast(cast(doc_id as string) as binary)) % 4 = 2 then 'xx' else lang end as lang")
    a, b = (sorted(map(tuple, language.identify(d).collect())) for d in (docs, spoiled))
    assert a == b


def test_language_bears_hard_rows(spark):
    docs = hard_docs(spark)
    got = language.identify(docs)
    assert got.count() == docs.count()
    by = {r["doc_id"]: r for r in got.collect()}
    assert by[90]["lang_pred"] == by[91]["lang_pred"] == by[92]["lang_pred"] == "und" and by[93]["lang_pred"] != "und"
    assert language.identify(no_docs(spark)).count() == 0
    unlabelled = language.identify(docs.selectExpr("doc_id", "text", "cast(null as string) as lang"))
    assert {r["lang_pred"] for r in unlabelled.collect()} == {"und"}


def test_grams_do_not_depend_on_neighbours():
    texts = ["abc", "", "ÄB", "x" * 50, "q"]
    together = [np.concatenate([b[s : s + n] for b, s, n in ((b, st[k], ln[k]) for b, st, ln in language.grams(texts))]) for k in range(len(texts))]
    for text, found in zip(texts, together, strict=True):
        assert sorted(found[found < language.BINS]) == sorted(language.bins_of(text))


# --- byte pair encoding


def test_ids_and_texts_equal_the_library():
    library, own = Tokenizer.from_file(VOCABULARY), bpe.Bpe(VOCABULARY)
    rng = random.Random(1)
    texts = ["", "<|endoftext|>a <|endoftext|><|endoftext|>", " \x1c\x1d x\x85\xa0 y", "a" * 3000, "ab" * 5000 + "  \n ", "日本語💩 ñ" * 50, "don't we'll I'VE 's", "՘\U00011de0 1²"]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x250), rng.randrange(0x3000)])) for _ in range(rng.randrange(200))) for _ in range(300)]
    texts += ["".join(rng.choice("ab \n\t'tres1!é") for _ in range(rng.randrange(60))) for _ in range(800)]
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids, text[:60]
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)
    for k in range(300):
        ids = random.Random(k).choices(range(50_257), k=12)
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_round_trip_bears_hard_rows_and_a_full_cache(spark, monkeypatch):
    docs = hard_docs(spark)
    library = Tokenizer.from_file(VOCABULARY)
    want = Counter()
    for r in docs.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        want[r["doc_id"], len(ids), sha(",".join(map(str, ids))), sha(r["text"] or "")] += 1
    assert Counter(map(tuple, bpe.round_trip(docs, VOCABULARY).collect())) == want
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    own = bpe.Bpe(VOCABULARY)
    for r in docs.collect():
        assert own.encode(r["text"] or "") == library.encode(r["text"] or "", add_special_tokens=False).ids
    assert bpe.round_trip(no_docs(spark), VOCABULARY).count() == 0


def test_long_words_have_plain_trees(monkeypatch):
    library, own = Tokenizer.from_file(VOCABULARY), bpe.Bpe(VOCABULARY)
    rng = random.Random(5)
    words = ["".join(rng.choice(letters) for _ in range(n)) for letters in ("ab", "abcdefghijklmnopqrstuvwxyz", "éß") for n in (1, 2, 3, 40, 5000)]
    words.append("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200_000)))
    for word in words:
        assert own.merge_one(word.encode()).tolist() == library.encode(word, add_special_tokens=False).ids
    monkeypatch.setattr(bpe, "HALF", 7)
    known = own.learn_bytes({*words, "<|endoftext|>"})
    for word in [*words, "<|endoftext|>"]:
        assert np.frombuffer(known[word], ">u2").tolist() == library.encode(word, add_special_tokens=False).ids
    again = own.learn_bytes({words[3], "again"})
    assert again[words[3]] == known[words[3]] and len(again) == 2


# --- shards


def test_shards_are_near_equal_and_slots_gapless(spark):
    docs = hard_docs(spark, [(1000 + k, "t" * (k % 977), "en", "s", None) for k in range(3000)])
    got = sharding.shard_rows(docs).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter(
        (r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in docs.collect()
    )
    load = Counter()
    for r in got:
        load[r["shard"]] += r["size"]
    assert set(load) == set(range(8)) and max(load.values()) - min(load.values()) <= 0.01 * sum(load.values())
    for s in range(8):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert sharding.shard_rows(no_docs(spark)).count() == 0


def test_a_repeated_row_spreads(spark, monkeypatch):
    monkeypatch.setattr(sharding, "COPIES", 500)
    rows = [(5, "one row " * 2)] * 7000 + [(100 + k, "other") for k in range(13_000)]
    got = sharding.shard_rows(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    load, count = Counter(), Counter()
    for r in got:
        load[r["shard"]] += r["size"]
        count[r["doc_id"]] += 1
    assert count == Counter(d for d, _ in rows) and max(load.values()) <= 1.01 * min(load.values())
    for s in range(8):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))


def test_a_new_shard_takes_slots_and_the_others_keep_theirs(spark, tmp_path):
    rng = np.random.default_rng(1)
    size = rng.integers(1, 1000, 512)
    first = sharding.rebalance(sharding.first_map(512, 8), size, 8)
    grown = sharding.rebalance(first, size, 9)
    load = np.bincount(grown, weights=size, minlength=9)
    assert load.max() - load.min() <= 2 and (grown != first).mean() < 0.5
    sharding.store_map(spark, str(tmp_path / "map"), 0, first)
    sharding.store_map(spark, str(tmp_path / "map"), 1, grown)
    assert (sharding.load_map(spark, str(tmp_path / "map"), 0) == first).all() and (sharding.load_map(spark, str(tmp_path / "map"), 1) == grown).all()


# --- token files


@pytest.mark.parametrize("block", [1 << 22, 64, 6])
def test_counts_do_not_depend_on_blocks(spark, block):
    docs = hard_docs(spark, [(-5, "below zero", "en", "s", None), (2**63 - 1, "a b", "en", "s", None), (-(2**63), "c", "en", "s", None)]).where("length(coalesce(text, '')) < 5000")
    library = Tokenizer.from_file(VOCABULARY)
    path = token_files.write_files(docs, VOCABULARY, roll=600)
    found = token_files.scan(spark, path, block).collect()
    want = sorted(len(library.encode(r["text"] or "", add_special_tokens=False).ids) + token_files.HEAD for r in docs.collect())
    assert sorted(r["n_tokens"] for r in found) == want and all(r["ended"] for r in found)
    for file in {r["file"] for r in found}:
        own = sorted((r["ordinal"], r["start"], r["n_tokens"]) for r in found if r["file"] == file)
        assert [o for o, _, _ in own] == list(range(len(own)))
        assert all(a[1] + a[2] + 1 == b[1] for a, b in zip(own, own[1:]))


def test_token_counts_carry_the_id(spark):
    docs = hard_docs(spark, [(-5, "below zero", "en", "s", None)])
    library = Tokenizer.from_file(VOCABULARY)
    want = Counter((r["doc_id"], len(library.encode(r["text"] or "", add_special_tokens=False).ids)) for r in docs.collect())
    assert Counter((r["doc_id"], r["n_tokens"]) for r in token_files.count_tokens(docs, VOCABULARY).collect()) == want
    assert token_files.count_tokens(no_docs(spark), VOCABULARY).count() == 0


def test_an_open_end_is_a_document(spark, tmp_path):
    tokens = np.array([1, 2, token_files.END, token_files.END, 3, 4, 5], ">u2")
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.bin").write_bytes(tokens.tobytes())
    for block in (2, 4, 6, 100):
        got = sorted((r["ordinal"], r["start"], r["n_tokens"], r["ended"]) for r in token_files.scan(spark, str(tmp_path / "f"), block).collect())
        assert got == [(0, 0, 2, True), (1, 3, 0, True), (2, 4, 3, False)]
