"""Benchmark leaks, repaired conversations and phrases against plain versions of themselves, and on odd rows."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from tracewarden.llm import collocations, conversations, queries, winnowing

SMALLER = f"{DATA}/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return (text or "").translate({i: i + 32 for i in range(65, 91)})


@pytest.mark.parametrize("name", ["op11_winnowing_decontamination", "op13_phrase_collocations"])
def test_rows_agree_with_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALLER}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SMALLER)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLES[name]})").fetchall()
    assert want and sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def plain_hits(docs, items):
    windows = {}
    for item, text in items:
        w = WORD.findall(low(text))
        for i in range(max(1, len(w) - 9)) if w else []:
            windows.setdefault(tuple(w[i : i + 10]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = WORD.findall(low(text)), set(), set()
        for size in {len(k) for k in windows}:
            for i in range(len(w) - size + 1):
                if tuple(w[i : i + size]) in windows:
                    hit |= set(range(i, i + size))
                    found |= windows[tuple(w[i : i + size])]
        out.append((doc, len(w), len(hit), sorted(str(x) for x in found if x is not None)))
    return out


@pytest.mark.parametrize("broadcast_bytes", [0, 1 << 20])
def test_leaks_on_few_words(spark, broadcast_bytes):
    """Few different words, so that grams repeat, windows overlap and fingerprints stay the same for long."""
    rnd = random.Random(3)
    text = lambda n, k: " ".join(rnd.choice("abcdefgh"[:k]) for _ in range(n))
    docs = [(i, text(rnd.randint(0, 60), rnd.choice((1, 2, 4)))) for i in range(200)] + [(900, None), (901, ""), (902, "?!"), (3, "A b, C! d E f g h a b"), (None, "x y"), (7, "a " * 40), (7, "a " * 40), (904, "É" + text(30, 3))]
    items = [(i, text(n, k)) for i, (n, k) in enumerate([(12, 2), (10, 2), (15, 1), (9, 2), (3, 4), (1, 8), (30, 4), (11, 4)])] + [(0, "x y"), (None, "b a b a"), (50, None), (51, "...")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n", F.lit("clash")).withColumn("item", F.lit(1))
    got = winnowing.decontaminate(d, spark.createDataFrame(items, "item_id long, text string"), broadcast_bytes=broadcast_bytes).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in got), key=repr) == sorted(plain_hits(docs, items), key=repr)
    for r in got:
        assert sum(e - b for b, e in r["spans"]) == r["n_hit"] and all(x["end"] < y["begin"] for x, y in zip(r["spans"], r["spans"][1:], strict=False))


def test_leaks_into_very_long_texts(spark):
    rnd = random.Random(5)
    words = [f"w{rnd.randint(0, 10**6)}" for _ in range(60_000)]
    items = [(i, " ".join(words[i * 500 : i * 500 + 10 + i % 7])) for i in range(100)]
    docs = [(1, " ".join(words)), (2, " ".join(words[::-1])), (3, " ".join(words[5:9]))]
    got = winnowing.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_hit"], len(r["items"])) for r in got} == {1: (sum(10 + i % 7 for i in range(100)), 100), 2: (0, 0), 3: (0, 0)}


def cheapest(signature):
    """Least cost and smallest edits by Dijkstra's search over (row, state)."""
    heap, seen, best = [(0, "", 0, 0)], {}, None
    after = {0: ("u", 2), 1: ("u", 2), 2: ("a", 3), 3: ("u", 2)}
    while heap:
        cost, edits, i, state = heapq.heappop(heap)
        if best and (cost, edits) > best and cost > best[0]:
            break
        if seen.get((i, state), (cost + 1,)) <= (cost, edits):
            continue
        seen[(i, state)] = (cost, edits)
        if i == len(signature) and state in (0, 3):
            best = min(best or (cost, edits), (cost, edits))
        said, following = after[state]
        heapq.heappush(heap, (cost + 3, edits + "I", i, following))
        if i < len(signature):
            letter, more = signature[i], 3 if signature[i].isupper() else 0
            heapq.heappush(heap, (cost + 4, edits + "D", i + 1, state))
            if letter != "x":
                if state == 0 and letter.lower() == "s":
                    heapq.heappush(heap, (cost + more, edits + "K", i + 1, 1))
                if letter.lower() == said:
                    heapq.heappush(heap, (cost + more, edits + "K", i + 1, following))
                heapq.heappush(heap, (cost + 3 + more, edits + "R", i + 1, following))
    return best


def test_edits_are_the_cheapest_and_smallest():
    rnd = random.Random(1)
    words = sorted({"".join(rnd.choice("xsuaoSUAO") for _ in range(rnd.randint(0, 10))) for _ in range(3000)})
    for word, cost, edits in conversations.solve(words):
        assert (cost, edits) == cheapest(word), word
    assert next(conversations.solve(["ua" * 20_000]))[1:] == (0, "K" * 40_000)


def plain_repair(rows):
    """What op12 returns, of all rows (conv_id, turn, role, text)."""
    held = {}
    for conv, turn, role, text in rows:
        kept = held.setdefault(conv, [])
        blank = lambda x: " " if x is None else x
        role, text, kind = blank(role), blank(text), zlib.crc32(f"{blank(conv)}:{blank(turn)}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = []
    for conv, kept in held.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        seen, word, kinds = set(), "", [0, 0, 0]
        for _, role, text in kept:
            body, letter = text.strip(" \t\n\x0b\x0c\r"), role[:1] if role[:1] in ("s", "u", "a") else "o"
            if not body:
                kinds[0], letter = kinds[0] + 1, "x"
            elif (role, text) in seen:
                kinds[1], letter = kinds[1] + 1, "x"
            elif body[-1] not in ".!?":
                kinds[2], letter = kinds[2] + 1, letter.upper()
            seen.add((role, text))
            word += letter
        turns = {t for t, _, _ in kept if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:], strict=False))
        cost, edits = cheapest(word)
        said, at, system = [], 0, False
        for edit in edits:
            role = ("user", "assistant")[(len(said) - system) % 2]
            if edit == "I":
                said.append(f"{role}:")
                continue
            _, own, text = kept[at]
            at += 1
            if edit == "K":
                system |= not said and own[:1] == "s"
                role = own
            if edit != "D":
                said.append(f"{role}:{text}")
        out.append((conv, gaps, *kinds, illegal, cost, edits, hashlib.sha256("\n".join(said).encode()).hexdigest()))
    return sorted(out, key=repr)


def repaired(frame):
    return sorted((tuple(r) for r in frame.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()), key=repr)


def test_repair_of_conversations(spark):
    rows = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{SMALLER}/conversations.parquet'").fetchall()
    assert repaired(conversations.op12_conversation_repair(spark, SMALLER)) == plain_repair(rows)


def test_repair_of_odd_conversations(spark):
    rnd = random.Random(7)
    texts = ["Yes.", "No", " ", "", None, "Yes.", "A\nb? \n", "é!\x0b", ".", "x" * 100_000, "Ok.\x85", "Line.\n"]
    rows = [(rnd.choice((None, *range(60))), rnd.choice((None, *range(-2, 9))), rnd.choice(("system", "user", "assistant", "tool", None, "", "User", "ä")), rnd.choice(texts)) for _ in range(700)]
    rows += [(c, 0, "user", "Hi.") for c in range(1000, 1040)] + [(2000, t, ("user", "assistant")[t % 2], f"Turn {t}.") for t in range(2500)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("place", F.lit("clash")).withColumn("cost", F.lit(1))
    got = repaired(conversations.repair(conversations.damaged(frame)))
    assert got == plain_repair(rows)
    gone = hashlib.sha256(b"").hexdigest()
    assert (c := [r for r in got if r[7] == "" and r[2:6] == (0, 0, 0, 0)]) and all(r[1:] == (0, 0, 0, 0, 0, 0, "", gone) for r in c)


def plain_phrases(docs, least, top):
    counts, total = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low(text)):
            w = [x for x in re.split(r"[ \t]+", piece) if x]
            total[lang] += len(w)
            for n in range(1, 5):
                for i in range(len(w) - n + 1):
                    counts[(lang, tuple(w[i : i + n]))] += 1
    found = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= least}
    inside = Counter()
    for (lang, w), a in found.items():
        for n in range(2, len(w)):
            for i in range(len(w) - n + 1):
                inside[(lang, w[i : i + n])] = max(a, inside[(lang, w[i : i + n])])
    by_lang = {}
    for (lang, w), a in found.items():
        if 100 * inside[(lang, w)] < 80 * a:
            cuts = [(2_000_000 * a // (counts[(lang, w[:k])] + counts[(lang, w[k:])]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            by_lang.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), counts[(lang, w[:k])], counts[(lang, w[k:])]))
    return sorted((lang, i + 1, p.decode(), -a, x, y, total[lang], -s) for lang, rows in by_lang.items() for i, (s, a, p, x, y) in enumerate(sorted(rows)[:top]))


@pytest.mark.parametrize("width", [1 << 10, 1 << 16])
def test_phrases_of_odd_texts(spark, width):
    """With a sketch so narrow that most phrases survive, and with a wide one, the same rows."""
    rnd = random.Random(9)
    word = lambda: rnd.choice(["a", "B", "c", "É", "é", "日本", "\x00", "x\x85y", "\x1c", "don't", " "])
    text = lambda: "".join(word() + rnd.choice([" ", " ", "  ", "\t", ", ", "\n", "? ", "\x0b", "\r"]) for _ in range(rnd.randint(0, 30)))
    docs = [(rnd.choice(["en", "fr", None, "und", ""]), text()) for _ in range(400)] + [("en", None), (None, ""), ("de", "only once here"), ("en", "the cat sat on the mat " * 4000)]
    frame = spark.createDataFrame(docs, "lang string, text string").withColumn("n", F.lit("clash")).withColumn("phrase", F.lit(1)).repartition(5)
    got = collocations.phrase_collocations(frame, least=5, top=40, width=width)
    assert sorted(tuple(r) for r in got.collect()) == plain_phrases(docs, 5, 40)


def test_narrow_sketches_lose_nothing(spark):
    docs = [("en", f"w{i % 700} w{i % 350} w{i % 70}") for i in range(7000)]
    frame = spark.createDataFrame(docs, "lang string, text string")
    assert sorted(tuple(r) for r in collocations.phrase_collocations(frame, least=10, width=1 << 8).collect()) == plain_phrases(docs, 10, 2000)
