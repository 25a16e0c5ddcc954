"""Conversation repair against Dijkstra's search, BPE against the tokenizers library, divergence against plain sums."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter

import pytest

from kgloom.llm import bpe, conversation_repair, source_divergence
from kgloom.llm.conversation_repair import DELETE, INSERT, KEPT, MADE, REROLE, ROLES, Paths


def wanted(rows):
    """The contract's columns of one conversation's rows (turn, role, text), found by a search over all edits."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    faults, seen = [], set()
    for _, role, text in rows:
        last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
        faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else "")
        seen.add((role, text))
    heap, done = [(0, "", 0, 0, ())], set()
    while True:
        cost, audit, i, state, lines = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in (0, 3):
            break
        role = ROLES[MADE[state]]
        heapq.heappush(heap, (cost + INSERT, audit + "I", i, MADE[state], (*lines, f"{role}:")))
        if i == len(rows):
            continue
        heapq.heappush(heap, (cost + DELETE, audit + "D", i + 1, state, lines))
        if faults[i] in ("blank", "duplicate"):
            continue
        more = 5 * (faults[i] == "truncated")
        heapq.heappush(heap, (cost + REROLE + more, audit + "R", i + 1, MADE[state], (*lines, f"{role}:{rows[i][2]}")))
        if state in KEPT.get(rows[i][1][:1], {}):
            heapq.heappush(heap, (cost + more, audit + "K", i + 1, KEPT[rows[i][1][:1]][state], (*lines, f"{rows[i][1]}:{rows[i][2]}")))
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def damage(table):
    out = {}
    for conv, turn, role, text in table:
        kept = out.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind:
            row = (turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
            kept += [row] * (2 if kind == 3 else 1)
    return out


CONV = "conv_id bigint, turn bigint, role string, text string, gone string, n bigint, cost string"
SHOWN = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def repaired(spark, table):
    rows = spark.createDataFrame([(*r, "x", 1, "y") for r in table], CONV)
    got = conversation_repair.repair_conversations(conversation_repair.damaged(rows)).collect()
    assert len({r["conv_id"] for r in got}) == len(got)
    return {r["conv_id"]: tuple(r[c] for c in SHOWN) for r in got}


@pytest.fixture
def cut(spark):
    """Ranges stay as many as they are dealt."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


def test_repair(spark, cut):
    draw = random.Random(3)
    roles, texts = ["system", "user", "assistant", "tool", "", None], ["a.", "b!", "no end", "", " \n", None, "é?\t", "中。", "a.\nb", "z" * 3000 + "."]
    table = [(conv, draw.choice([*range(6), None]), draw.choice(roles), draw.choice(texts)) for conv in [*range(120), None] for _ in range(draw.randrange(1, 9))]
    table += [(500 + k, k, r, "x.") for k, r in enumerate(roles)]
    assert repaired(spark, table) == {c: wanted(rows) for c, rows in damage(table).items()}
    assert repaired(spark, []) == {}


@pytest.mark.parametrize("kinds", ["uasb", "u", "ua", "uaaut"])
def test_repair_of_long_conversations(spark, cut, kinds):
    """A conversation that is cut by ranges, between short ones."""
    draw = random.Random(kinds)
    role = {"u": "user", "a": "assistant", "s": "system", "b": "user", "t": "assistant"}
    row = lambda c, t, k: (c, t, role[k], " " if k == "b" else f"text {t}{draw.choice(['', '', '.'])}" if k == "t" else f"text {draw.randrange(4000)}.")
    table = [row(c, t, draw.choice(kinds)) for c, n in ((1, 3), (2, 3000), (3, 4), (4, 900), (5, 1)) for t in range(n)]
    table += [(2, 10_000, "user", "same.")] * 400 + [(2, 10_001, "assistant", "same.")] * 300
    assert repaired(spark, table) == {c: wanted(rows) for c, rows in damage(table).items()}


def test_paths_settle():
    """What is carried stays short, however long a conversation is."""
    paths, plain = Paths(0, hashed=True), []
    for k in range(5000):
        role, truncated = ("user", "assistant")[k % 2 if k % 7 else 0], k % 5 == 0
        paths.edit(role, truncated, f"t{k}")
        plain.append((k, role, f"t{k}" + ("" if truncated else ".")))
        assert max(len(w) for _, w, _ in paths.layer.values()) < 600
    cost, audit, _ = paths.finish()
    assert (cost, audit) == wanted(plain)[5:7]


TOKENIZER = "word_bpe_49k.json"


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(TOKENIZER)
    return path, Tokenizer.from_file(path)


def test_bpe(spark, library):
    path, tokenizer = library
    draw = random.Random(7)
    letters = [*"abcdefgh thein'sS \n\tÉéÀàßΣΑİ123.,!?-_中文", "́", "̧", "\x85", "　", "􏿿", "\U0001f600", "‍", "ꟍ", "<|endoftext|>", "<|startoftext|>", "<|", "՘", "ॲ"]
    texts = ["".join(draw.choice(letters) for _ in range(draw.randrange(80))) for _ in range(600)]
    texts += [None, "", " ", "<|endoftext|>", "the" * 20_000, "word " * 20_000, "x" * 70 + " " + "x" * 70, *texts[:5]]
    rows = spark.createDataFrame([(i, t, "k", None) for i, t in enumerate(texts)], "doc_id bigint, text string, x string, ids string")
    encoded = bpe.bpe_encode(rows, path, keep=("doc_id", "x", "ids", "text"))
    assert set(encoded.columns) == {"doc_id", "x", "ids"}
    got = {r["doc_id"]: r for r in bpe.bpe_decode(encoded, path).collect()}
    assert len(got) == len(texts)
    encoded = {r["doc_id"]: r["ids"] for r in encoded.collect()}
    for i, text in enumerate(texts):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        assert encoded[i] == ids
        assert got[i]["decoded_text"] == tokenizer.decode(ids, skip_special_tokens=False)
        assert got[i]["x"] == "k"
    assert bpe.bpe_encode(rows.limit(0), path).count() == 0
    odd = spark.createDataFrame([([320, -1, None, 10**6, 49407],), (None,), ([],)], "ids array<int>")
    known = tokenizer.decode([320, 49407], skip_special_tokens=False)
    assert [r["decoded_text"] for r in bpe.bpe_decode(odd, path).collect()] == [known, None, ""]


def test_bpe_merges_leftmost_lowest_rank_first():
    ranks = {(1, 1): 0, (2, 1): 1, (2, 2): 2}
    for n in range(1, 40):
        symbols = [1] * n
        while found := [(ranks[p], i) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)) if p in ranks]:
            rank, i = min(found)
            symbols[i : i + 2] = [[2, 3, 4][rank]]
        assert bpe.PairTree([1] * n, ranks).merged([2, 3, 4]) == symbols


def audited(rows, least, top):
    """The contract's rows by plain sums over all terms."""
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        of = [d for d in docs if d[0] == lang]
        found = Counter(t for d in of for t in set(d[2]))
        kept = sorted(t for t, n in found.items() if n >= least)
        counts = {s: Counter(t for d in of if d[1] == s for t in d[2]) for s in {d[1] for d in of}}
        whole = sum(counts.values(), Counter())

        def shares(c, kept=kept):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}

        q = shares(whole)
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s, c in counts.items():
            p = shares(c)
            others = {o: shares(counts[o]) for o in counts if o != s}
            pairs = sorted(((sum(f(p[t], x[t]) for t in kept), o) for o, x in others.items()), key=lambda x: (-x[0], x[1].encode()))
            terms = sorted(((f(p[t], q[t]), t) for t in kept if c[t] and p[t] > q[t]), key=lambda x: (-x[0], x[1].encode()))[:top]
            out += [(lang, s, part, item, value, k) for part, found in (("pair", pairs), ("term", terms)) for k, (value, item) in enumerate(found, 1)]
    return sorted(out)


DOCS = "text string, lang string, source string, a string, n string, total string, term string, terms int"


def divergence(spark, rows, least, top=10):
    docs = spark.createDataFrame([(*r, "c", "c", "c", "c", 1) for r in rows], DOCS)
    got = source_divergence.source_divergence(docs, least, top).collect()
    return sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in got)


@pytest.mark.parametrize("least", [1, 3, 10])
def test_divergence(spark, least):
    draw = random.Random(least)
    words = ["".join(draw.choice("abcdeéZ") for _ in range(draw.randrange(1, 4))) for _ in range(60)]
    rows = [(draw.choice([" ", ", ", "1"]).join(draw.choices(words, range(60, 0, -1), k=draw.randrange(40))), draw.choice(["en", "fr", None]), draw.choice(["s1", "s1", "s1", "s2", "é", "", None])) for _ in range(150)]
    rows += [(None, "en", "none"), ("", "en", "blank"), ("a", "solo", "s1"), ("12 3", "xx", "s1"), (None, "xx", "s2"), ("tie " * 50, "en", "s2"), ("x " * 30_000, "fr", "s1"), ("\U0001f600 ab中", "en", "s1")]
    rows += rows[:10]
    assert divergence(spark, rows, least) == audited(rows, least, 10)


def test_divergence_of_many_sources(spark):
    """Counts that tie, many sources, few terms of each, and no rows."""
    rows = [("tie even odd" if k % 2 else "tie even", "en", f"s{k % 40:02}") for k in range(200)]
    assert divergence(spark, rows, 10, 2) == audited(rows, 10, 2)
    assert divergence(spark, [], 10) == []


def test_shares_are_exact(spark):
    numbers = [(n, total, terms) for n, total, terms in [(0, 0, 1), (10**12, 10**12, 5), (3 * 10**12 + 7, 7 * 10**12 + 1, 3 * 10**8), (9, 10**13, 17)]]
    from pyspark.sql import functions as F

    rows = spark.createDataFrame(numbers, "n bigint, total bigint, terms bigint")
    got = rows.select("*", source_divergence.share(F.col("n"), F.col("total"), F.col("terms")).alias("p")).collect()
    assert [r["p"] for r in got] == [1 + 10**9 * (n + 2) // (total + 2 * terms) for n, total, terms in numbers]
