"""Prefix tries, repeated substrings and collocations: odd rows, many ranges, and plain versions on random tables."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import quire.llm.collocations as collocations_module
import quire.llm.prefix_trie as trie_module
import quire.llm.suffix_dedup as suffix_module
from quire.llm.collocations import collocations
from quire.llm.prefix_trie import Node, insert, prefix_trie, turn_nodes
from quire.llm.suffix_dedup import multikey_order, suffix_dedup


def plain_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [x[1:] for x in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(set), defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
        seq = tuple(own.get(base, [])[:h] + own[c][h:])
        ends[seq].append(c)
        for d in range(len(seq) + 1):
            members[seq[:d]].add(c)
    out = set()
    for p, m in members.items():
        below = [q for q in members if q[: len(p)] == p]
        words = lambda q: len(__import__("re").findall(r"[^\x20\x09-\x0d]+", q[-1][1])) if q else 0
        out.add((
            min(m), len(p), min(members[p[:-1]]) if p else None, len(m), sum(len(q) == len(p) + 1 for q in below),
            sum(not any(len(r) == len(q) + 1 and r[:-1] == q for r in members) for q in below), sum((len(members[q]) - 1) * words(q) for q in below),
            hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest(),
        ))
    return out


TRIE = "conv_id long, turn long, role string, text string"


def trie_rows(df):
    return {tuple(r) for r in prefix_trie(df).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()}


@pytest.mark.parametrize("keys", [100_000, 3])
def test_tries_of_random_conversations(spark, monkeypatch, keys):
    """With ranges of a few keys, most nodes lie on the paths to the ends of some range."""
    monkeypatch.setattr(trie_module, "KEYS", keys)
    rng, rows = random.Random(11), []
    for c in [*range(-45, 90), 2**40]:
        for turn in range(rng.choice([1, 2, 3, 5])):
            rows.append((c, rng.choice([turn, None]) if turn == 0 else turn, rng.choice(["user", "assistant", None]), rng.choice(["a b", "a", "", None, "x  y\tz"])))
    rows += [(7, 1, "user", "same"), (7, 1, "user", "same"), (None, 0, "user", "nobody's")]
    rows += [(200 + i, t, "user", f"long {t}") for i in range(5) for t in range(60 + i)]
    df = spark.createDataFrame(rows, TRIE).withColumns({"n": F.lit(1), "key": F.lit("k"), "words": F.lit(0)})
    assert trie_rows(df) == plain_trie(rows)


def test_trie_of_nothing(spark):
    assert prefix_trie(spark.createDataFrame([], TRIE)).count() == 0


def test_node_layouts_grow():
    keys = sorted({bytes([a, b]) * 8 for a in range(256) for b in (1, 200)} | {bytes([5, 1]) * 16})
    rng, shuffled = random.Random(2), keys.copy()
    rng.shuffle(shuffled)
    for n in (4, 5, 16, 17, 48, 49, 256):
        root = Node(b"")
        some = [k for k in shuffled if k[0] < n]
        for i, k in enumerate(some):
            insert(root, k, i)
        assert root.layout == next(x for x in (4, 16, 48, 256) if n <= x)
        found, todo = {}, [(root, b"")]
        while todo:
            node, above = todo.pop()
            if node.ends >= 0:
                found[above + node.edge] = node.ends
            kids = node.children()
            assert [c.edge[0] for c in kids] == sorted(c.edge[0] for c in kids) and all(node.get(c.edge[0]) is c for c in kids)
            todo += [(c, above + node.edge) for c in kids]
        assert found == {k: i for i, k in enumerate(some)}
    nodes = list(turn_nodes(keys, [1] * len(keys), list(range(len(keys))), [np.zeros(len(k) // 16) for k in keys], ["e"] * len(keys)))
    assert len(nodes) == len({k[:d] for k in keys for d in range(0, len(k) + 1, 16)})


def plain_repeats(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = np.zeros(len(r), dtype=bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = True
        edges = np.diff(np.concatenate(([0], gone.astype(int), [0])))
        out.append((len(r), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(bytes(np.frombuffer(r, np.uint8)[~gone])).hexdigest()))
    return out


def odd_texts(rng):
    piece = lambda n: "".join(rng.choice("abc é日\n") for _ in range(n))
    shared = [piece(260), piece(150), "z" * 400, piece(700)]
    texts = ["", None, "short", "y" * 300, "ab" * 200, piece(5000)]
    for _ in range(25):
        parts = [rng.choice([piece(rng.randrange(300)), rng.choice(shared), rng.choice(shared)[rng.randrange(90) :]]) for _ in range(rng.randrange(1, 6))]
        texts.append("".join(parts))
    texts += [texts[8], texts[8], texts[9][:-1], "x" + texts[10]]
    return texts


@pytest.mark.parametrize("rows_of_a_range", [500_000, 40])
def test_repeats_of_random_texts(spark, monkeypatch, rows_of_a_range):
    """With ranges of a few suffixes, most groups of equal ones go over a boundary."""
    monkeypatch.setattr(suffix_module, "RANGE", rows_of_a_range)
    texts = odd_texts(random.Random(rows_of_a_range))
    rows = [(i if i % 5 else None, t, 1.0, "k") for i, t in enumerate(texts)] + [(3, texts[12], 1.0, "k"), (3, texts[12], 1.0, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, at double, key string")
    got = Counter(tuple(r) for r in suffix_dedup(df).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())
    assert got == Counter((r[0], *x) for r, x in zip(rows, plain_repeats([r[1] for r in rows], 200), strict=True))


def test_repeats_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup(df).count() == 0
    with pytest.raises(ValueError):
        suffix_dedup(df, length=100)
    one = suffix_dedup(spark.createDataFrame([(1, "a" * 150)], "doc_id long, text string")).first()
    assert (one.n_removed, one.n_spans, one.spans) == (0, 0, [])


def test_multikey_order():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 500):
        tokens = [rng.integers(0, 5, n) for _ in range(3)]
        order = multikey_order(tokens)
        assert sorted(order.tolist()) == list(range(n)) and [tuple(t[i] for t in tokens) for i in order] == sorted(zip(*tokens, strict=True))


def plain_collocations(rows, support=10, top=2000):
    import re

    count, total = Counter(), Counter()
    for lang, text in (("und" if x is None else x, t) for x, t in rows):
        low = (text or "").translate({i: i + 32 for i in range(65, 91)})
        for p in re.split(r"[.,;:!?\x0a-\x0d]", low):
            w = re.findall(r"[^\x20\x09]+", p)
            total[lang] += len(w)
            for z in (1, 2, 3):
                count.update((lang, tuple(w[i : i + z])) for i in range(len(w) - z + 1))
    cand = {k: a for k, a in count.items() if len(k[1]) > 1 and a >= support}
    found = defaultdict(list)
    for (lang, g), a in cand.items():
        if any(x == lang and len(h) > len(g) and g in (h[:2], h[1:]) and 100 * b >= 50 * a for (x, h), b in cand.items()):
            continue
        cuts = [(10**6 * a * a // (count[lang, g[:k]] * count[lang, g[k:]]), k) for k in range(1, len(g))]
        score, k = min(cuts)
        found[lang].append((-score, -a, " ".join(g).encode(), count[lang, g[:k]], count[lang, g[k:]]))
    return {(lang, i, p.decode(), -a, left, right, total[lang], -s) for lang, x in found.items() for i, (s, a, p, left, right) in enumerate(sorted(x)[:top], 1)}


@pytest.mark.parametrize("entries", [3_000_000, 60])
def test_collocations_of_random_texts(spark, monkeypatch, entries):
    """With a few entries sent at a time, counts of many runs have to meet."""
    monkeypatch.setattr(collocations_module, "ENTRIES", entries)
    rng = random.Random(entries)
    words = ["Alpha", "beta", "GAMMA", "é", "日本", "d-e", "\x00f", "g"]
    rows = [(rng.choice(["en", "de", None, "und", ""]), "".join(rng.choice(words[: rng.choice([3, 8])]) + rng.choice([" ", " ", "\t", ". ", "\n", ",", "  "]) for _ in range(rng.randrange(60)))) for _ in range(150)]
    rows += [("en", None), ("en", ""), ("fr", "only here")] + [("es", "uno dos tres cuatro")] * 10 + [("es", "dos tres")] * 9
    df = spark.createDataFrame([(i, t, lang, 1) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, n int")
    got = {tuple(r) for r in collocations(df.repartition(7)).collect()}
    want = plain_collocations(rows)
    assert got == want and ("es", "dos tres") not in {(r[0], r[2]) for r in want} and len(want) > 30


def test_collocations_of_nothing(spark):
    assert collocations(spark.createDataFrame([], "text string, lang string")).count() == 0
    assert collocations(spark.createDataFrame([(None, None)], "text string, lang string")).count() == 0
