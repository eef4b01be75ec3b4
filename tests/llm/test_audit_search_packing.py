"""The filter audit, the lexical search and the packing against plain versions, and on edge cases."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from chronoweave.llm import audit, bytescan, packing, search
from chronoweave.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
ODD = ["", " ", "a", "é", "ÀÉ à", "　x y", "AB#c  D\n\tE", "x" * 9 + " " + "x" * 9 + " " + "x" * 8 + "y", "w" * 70 + " " + "w" * 70 + " " + "w" * 71, "\x1ca b\x0bc", "𝒳𝒴 z|", "%"]


def test_transducer_and_table():
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice("ab é𝒳A#\n\x1f") for _ in range(rng.randrange(120))) for _ in range(300)] + [None]
    words, distinct, capitals, points, symbols = audit.scan(pa.array(texts))
    for i, x in enumerate(texts):
        found = re.findall(r"[^\x20\x09-\x0D]+", x or "")
        want = (len(found), len(set(found)), len(re.findall("[A-Z]", x or "")), len(x or ""), len(re.findall("[#$%&*|]", x or "")))
        assert (words[i], distinct[i], capitals[i], points[i], symbols[i]) == want, x
    part = pa.array(texts).slice(5, 40)
    assert audit.scan(part)[0].tolist() == words[5:45].tolist()


def test_table_survives_equal_hashes(monkeypatch):
    """With one hash for all spans, words are still told apart by their bytes."""
    monkeypatch.setattr(bytescan.Spans, "_hashes", lambda self: np.zeros(len(self), np.uint64))
    texts = ["a b a c b", "abcdefgh abcdefgi abcdefgh", "abcdefghij abcdefghik abcdefghij", "w" * 70 + " " + "w" * 70]
    assert audit.scan(pa.array(texts))[1].tolist() == [3, 2, 2, 1]


def plain_audit(rows, labels):
    known = {}
    for d, q, t in labels:
        a, b = known.get(d, (False, False))
        known[d] = (a or q == 1, b or t == 1)
    order = lambda d: math.inf if d is None else d
    least = {}
    for d, x, _ in rows:
        least[x or ""] = min(least.get(x or "", math.inf), order(d))
    out = defaultdict(Counter)
    for d, x, part in rows:
        x, part = x or "", part or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", x)
        fails = {f for f, bad in zip("ABCDE", (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", x)) > 5 * len(x), re.search("[#$%&*|]", x), order(d) > least[x]), strict=True) if bad}
        good, toxic = known.get(d, (False, False)) if d is not None else (False, False)
        for p in permutations("ABCDE"):
            for k, f in enumerate(p):
                c = out[part, "".join(p), k + 1]
                gone = bool(fails & set(p[:k]))
                c["kept"] += not gone and f not in fails
                c["removed"] += not gone and f in fails
                c["redundant"] += gone and f in fails
                c["unique_fails"] += fails == {f}
                c["good_lost"] += good and not gone and f in fails
                c["toxic_lost"] += toxic and not gone and f in fails
    for (part, p, k), c in out.items():
        c["shapley"] = sum(out[part, "".join(q), q.index(p[k - 1]) + 1]["removed"] for q in permutations("ABCDE"))
    return out


def test_audit(spark, edge_docs, edge_rows, no_docs):
    rng = random.Random(5)
    words = ["ab", "Cd", "e#", "fg", "hi", "JK"] + [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice((3, 49, 50, 51, 90)))) for _ in range(25)] + [None, "", "x"]
    rows = [(rng.choice((None, 7, 7, *range(60))), rng.choice(texts), rng.choice(("a", "a", "b", None, ""))) for _ in range(150)] + [(r[0], r[1], r[3]) for r in edge_rows]
    labels = [(i, rng.choice((0, 1, None)), rng.choice((0, 1))) for i in range(0, 60, 2)] + [(7, 1, 0), (7, 0, 1), (None, 1, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "'c' part", "'c' failed", "1 n", "'x' good", "2 n_words")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "'c' text", "'c' part")
    got = {(r["part"], r["filter_order"], r["step"]): r for r in audit.audit_filters(df, known).collect()}
    want = plain_audit(rows, labels)
    assert len(got) == len(want) == 600 * 4
    for key, c in want.items():
        assert {n: got[key][n] for n in c} == dict(c), key
    assert len(audit.audit_filters(edge_docs, known).collect()) == 600 * len({r[3] or "" for r in edge_rows})
    assert audit.audit_filters(no_docs, known).collect() == [] and len(audit.audit_filters(df, known.limit(0)).collect()) == 2400


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(x):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))


def plain_search(rows, items, top=10):
    held = [Counter(terms(x)) for _, x in rows]
    n_docs, n_terms = sum(1 for c in held if c), sum(sum(c.values()) for c in held)
    df = Counter(t for c in held for t in c)
    out = []
    for item, x in items:
        scores = []
        for (d, _), c in zip(rows, held, strict=True):
            n = sum(c.values())
            m = 100 - 90 + (90 * n * n_docs) // max(1, n_terms)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(terms(x)) if c[t])
            if s > 0 and d is not None:
                scores.append((-s, d))
        out += [(item, k + 1, d, -s) for k, (s, d) in enumerate(sorted(scores)[:top])]
    return sorted(out, key=str)


@pytest.mark.parametrize("block_docs, first, row_items, batch_items, sums", [(2048, 4, 512, 4096, 1 << 20), (3, 1, 2, 4, 5), (1, 2, 1, 3, 1)])
def test_search(spark, monkeypatch, block_docs, first, row_items, batch_items, sums):
    for name, value in (("BLOCK_DOCS", block_docs), ("FIRST_VISITS", first), ("ROW_ITEMS", row_items), ("BATCH_ITEMS", batch_items), ("MOST_SUMS", sums)):
        monkeypatch.setattr(search, name, value)
    rng = random.Random(9)
    words = ["The", "the", "ÉTÉ", "été", "fox", "Fox-trot", "42", "x_y", "a.b", "ñ", "日本", "rare1"] + [f"t{i}" for i in range(30)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice((1, 4, 4, 9, 30))))) for i in range(200)]
    rows += [(300 + i, "the fox the hot copy") for i in range(40)] + [(5, "rare1 twice"), (5, "rare1 twice"), (None, "rare1 rare1"), (400, None), (401, ""), (402, " ...")]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 8)))) for i in range(9)] + [(50, None), (51, "..."), (52, "nowhere"), (3, "again fox"), (60, "hot copy"), (61, "rare1")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'c' term", "'c' m", "'c' item_id", "1 n", "'b' block")
    asked = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'c' doc_id", "1 score", "2 rank", "'t' terms")
    got = search.search(df, asked)
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_search(rows, items)


def test_search_edges(spark, edge_docs, edge_rows, no_docs):
    items = spark.createDataFrame([(1, "quick brown fox"), (2, "w1 w2 w29999 zzz")], "item_id long, text string")
    assert sorted((tuple(r) for r in search.search(edge_docs, items).collect()), key=str) == plain_search([r[:2] for r in edge_rows], [(1, "quick brown fox"), (2, "w1 w2 w29999 zzz")])
    assert search.search(no_docs, items).collect() == [] and search.search(edge_docs, items.limit(0)).collect() == []


def test_search_query(spark):
    docs, items = (pd.read_parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    got = sorted((tuple(r) for r in QUERIES["op12_lexical_search"](spark, SF).select("item_id", "rank", "doc_id", "score").collect()), key=str)
    assert got == plain_search(list(zip(docs.doc_id.tolist(), docs.text.tolist(), strict=True)), list(zip(items.item_id.tolist(), items.text.tolist(), strict=True)))


def test_word_encoder():
    path = packing.default_vocabulary()
    plain, encoder = Tokenizer.from_file(path), packing.WordEncoder(path)
    assert encoder.known
    rng = random.Random(11)
    chars = list("abzABZ  '\"sdtmrel09.,!<|>-_\n\t\r\x0b\x1c\x1f\x85\xa0éÀßÿ×÷ªºİıſΣσςñ̃日本🙂​ 　᠎ǅ½²٣")
    texts = ["".join(rng.choice(chars) for _ in range(rng.randrange(60))) for _ in range(6000)]
    texts += ["", " ", "it's we'll 'sun don't I'M O'REILLY'S", "a<|startoftext|>b <|endoftext|> <|ENDOFTEXT|>", "a" * 5000, "é" * 300 + "1" * 300 + "!" * 300, None]
    for k in range(0, len(texts), 64):
        for x, raw in zip(texts[k : k + 64], encoder.encode(texts[k : k + 64]), strict=True):
            assert np.frombuffer(raw, "<u4").tolist() == plain.encode(x or "", add_special_tokens=False).ids, repr(x)


def test_best_fit():
    rng = random.Random(2)
    for length in (1, 7, 16, 100):
        sizes = [rng.randrange(1, length + 1) for _ in range(200)]
        got = packing.best_fit_decreasing(sizes, length)
        rooms: list[int] = []
        for s in sorted(sizes, reverse=True):  # tightest room by looking at all
            fit = [r for r in rooms if r >= s]
            if fit:
                rooms.remove(min(fit))
                rooms.append(min(fit) - s)
            else:
                rooms.append(length - s)
        assert sorted(length - sum(sizes[i] for i in w) for w in got) == sorted(rooms)
        assert sorted(i for w in got for i in w) == list(range(200))


def packed(df, want, length, most_padding):
    """Every id in one piece, gapless sequences, little padding."""
    rows = df.toPandas()
    pieces = Counter()
    for r in rows.itertuples():
        pieces[r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens] += 1
    by = defaultdict(list)
    for r in rows.itertuples():
        by[r.doc_id].append(r)
    for doc, docs in want.items():
        for ids in docs[:1]:
            at, own = 0, sorted(by[doc], key=lambda r: r.start)
            for r in own[:: len(docs)]:
                assert r.start == at and r.doc_tokens == len(ids)
                assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], dtype="<u4").tobytes())
                at += r.length
            if len(docs) == 1:
                assert at == len(ids)
    padding = 0
    for _, w in rows.sort_values("offset").groupby("sequence_id"):
        assert w.offset.tolist() == [0, *w.length.cumsum().tolist()[:-1]] and (w.length > 0).all()
        total = int(w.length.sum())
        assert total <= length
        padding += 0 if total & (total - 1) == 0 else length - total
    assert rows.length.sum() == sum(len(x) for d in want.values() for x in d) and padding <= most_padding * max(1, rows.length.sum())


@pytest.mark.parametrize("unit, length", [(1024, 4096), (2, 64), (4, 128)])
def test_packing(spark, monkeypatch, unit, length):
    monkeypatch.setattr(packing, "UNIT_WINDOWS", unit)
    monkeypatch.setattr(packing, "LEAST_GAP", 8)
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    tokenizer = Tokenizer.from_file(packing.default_vocabulary())
    want = {d: [tokenizer.encode(x or "", add_special_tokens=False).ids + [2]] for d, x in zip(docs.doc_id.tolist(), docs.text.tolist(), strict=True)}
    df = spark.createDataFrame(docs[["doc_id", "text"]]).repartition(3)
    packed(packing.pack_documents(df, packing.default_vocabulary(), length), want, length, 0.005 if length > 64 else 0.1)


def test_packing_of_one_size(spark):
    """Equal documents of more than half a window are cut into each other's gaps; a few tokens alone make powers of two."""
    text = " ".join(["the"] * 2499)
    df = spark.createDataFrame([(i, text) for i in range(40)], "doc_id long, text string").coalesce(1)
    want = {i: [[518] * 2499 + [2]] for i in range(40)}
    ids = Tokenizer.from_file(packing.default_vocabulary()).encode("the", add_special_tokens=False).ids
    packed(packing.pack_documents(df, packing.default_vocabulary()), {i: [ids * 2499 + [2]] for i in want}, 4096, 0.0)
    few = packing.pack_documents(df.limit(1).selectExpr("doc_id", "'the the the the' text"), packing.default_vocabulary()).orderBy("sequence_id").collect()
    assert [r["length"] for r in few] == [4, 1] and few[0]["doc_tokens"] == 5


def test_packing_edges(spark, edge_docs, edge_rows, no_docs):
    tokenizer = Tokenizer.from_file(packing.default_vocabulary())
    want = defaultdict(list)
    for r in edge_rows:
        want[r[0]].append(tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [2])
    df = packing.pack_documents(edge_docs.where("doc_id is not null"), packing.default_vocabulary())
    packed(df, {d: x for d, x in want.items() if d is not None}, 4096, 0.02)
    rows = packing.pack_documents(edge_docs, packing.default_vocabulary()).collect()
    assert sum(r["length"] for r in rows) == sum(len(x) for d in want.values() for x in d)
    joined = {}
    for r in sorted((r for r in rows if r["doc_id"] == 13), key=lambda r: r["start"]):
        joined[13] = joined.get(13, b"") + bytes(r["ids"])
    assert np.frombuffer(joined[13], "<u4").tolist() == want[13][0]
    assert packing.pack_documents(no_docs, packing.default_vocabulary()).collect() == []
