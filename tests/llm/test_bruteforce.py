"""Queries that SQL can't express against plain versions, held-out labels, and exact distributions."""

import html
import re
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from quire.llm.licenses import NOTICES
from quire.llm.pii import Pseudonyms
from quire.llm.queries import DEMO_KEY, QUERIES
from quire.llm.subwords import LETTERS, REST, UNIT, Units, sample
from quire.llm.textkit import mix
from quire.llm.toxicity import fit, score, train

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))


def rows_of(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet").collect()


def test_licenses(spark, sf):
    want = set()
    for r in rows_of(spark, sf, "documents"):
        w = plain_words(r.text)
        have = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        for name, notice in NOTICES.items():
            t = plain_words(notice)
            need = {tuple(t[i : i + 5]) for i in range(len(t) - 4)}
            if sum(g in have for g in need) >= 0.75 * len(need):
                best = max((len(need & {tuple(w[j : j + 5]) for j in range(i, min(i + len(t) - 4, len(w) - 4))}) for i in range(len(w) - 4)), default=0)
                if best >= 0.75 * len(need):
                    want.add((r.doc_id, name, best / len(need)))
    got = {(r.doc_id, r.license, r.containment) for r in QUERIES["op1_license_scan"](spark, sf).collect()}
    assert got == want and got


def test_html_text(spark, sf):
    got = {r.page_id: r.text for r in QUERIES["op9_html_text"](spark, sf).collect()}
    for r in rows_of(spark, sf, "pages"):
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article))
        assert got[r.page_id] == "\n".join(b for b in blocks if b)


def test_token_counts(spark, sf):
    """Against another library's offsets for the same vocabulary."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    got = {r.doc_id: r for r in QUERIES["op8_token_counts"](spark, sf).collect()}
    for r in rows_of(spark, sf, "documents"):
        spans = tokenizer.encode(r.text, add_special_tokens=False).offsets
        cuts = [i + 1 for i, c in enumerate(r.text) if c == "\n"]
        cuts += [len(r.text)] if not cuts or cuts[-1] < len(r.text) else []
        counts = [0] * len(cuts)
        for a, b in spans:
            part = [max(0, min(b, z) - max(a, y)) for y, z in zip([0, *cuts[:-1]], cuts, strict=True)]
            counts[part.index(max(part))] += 1
        assert got[r.doc_id].n_tokens == len(spans) and [s.n_tokens for s in got[r.doc_id].sections] == counts


def test_pii_values_go_and_stay_linked(spark, sf):
    got = {r.doc_id: r for r in QUERIES["op7_pii"](spark, sf).collect()}
    values = re.compile(r"[\w.]+@mail\d+\.example\.com|\+1 \(\d{3}\) \d{3}-\d{4}|(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d.])", re.I)
    pairs = {}
    for r in rows_of(spark, sf, "documents"):
        old, new = values.findall(r.text), values.findall(got[r.doc_id].text)
        assert len(old) == len(new) and all(a != b for a, b in zip(old, new, strict=True))
        for a, b in zip(old, new, strict=True):
            assert pairs.setdefault(a, b) == b
    assert len(pairs) > 5 and len(set(pairs.values())) == len(pairs)


def test_pii_derived_again(spark, sf):
    """The query over the whole table against one plain pass for each kind that the table holds."""
    names, changed = Pseudonyms(DEMO_KEY), 0
    got = {r.doc_id: r for r in QUERIES["op7_pii"](spark, sf).collect()}
    luhn = lambda d: sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    mod97 = lambda v: int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1
    octets = lambda v: all(int(x) < 256 and str(int(x)) == x for x in v.split(".")) and v != "127.0.0.1"
    kinds = [
        ("email", r"[\w.+-]+@[\w-]+(?:\.[\w-]+)*\.[A-Za-z]{2,}", lambda v: True), ("phone", r"\+1 \(\d{3}\) \d{3}-\d{4}", lambda v: True), ("ip", r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d]|\.\d)", octets),
        ("card", r"(?<!\w)\d{16}(?!\w)", luhn), ("iban", r"(?<!\w)[A-Z]{2}\d{2}[A-Z0-9]{11,30}(?!\w)", mod97), ("ssn", r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])", lambda v: True), ("date", r"(?<![\w-])\d{4}-\d\d-\d\d(?![\w-])", lambda v: True),
    ]
    for r in rows_of(spark, sf, "documents"):
        spans = sorted((m.start(), m.end(), kind) for kind, pattern, valid in kinds for m in re.finditer(pattern, r.text or "", re.A) if valid(m[0]))
        want, at = "", 0
        for a, b, kind in spans:
            want, at = want + r.text[at:a] + names.of(kind, r.text[a:b]), b
        assert got[r.doc_id].text == want + r.text[at:] and got[r.doc_id].n_pii == len(spans), (r.doc_id, spans)
        changed += len(spans)
    assert changed > 10


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in rows_of(spark, sf, "labels")}
    held = [(labels[r.doc_id], r.predicted) for r in QUERIES["op6_toxicity"](spark, sf).where("held_out").collect() if r.doc_id in labels]
    found = [p for t, p in held if t == 1]
    assert len(held) > 500 and sum(found) >= 0.85 * len(found)
    assert sum(p for t, p in held if t == 0) <= 0.02 * len(held)


def test_toxicity_risk():
    """The gradient that the fit follows, against numeric differences of the risk as it is defined."""
    r = np.random.default_rng(2)
    p, u, prior = (r.random((40, 3)) < 0.5).astype(float), (r.random((60, 3)) < 0.3).astype(float), 0.2
    loss = lambda z: 1 / (1 + np.exp(z))  # noqa: E731  sigmoid loss of a margin

    def risk(theta, kept_non_negative=True):
        zp, zu = p @ theta[:-1] + theta[-1], u @ theta[:-1] + theta[-1]
        clean = loss(-zu).mean() - prior * loss(-zp).mean()
        return prior * loss(zp).mean() + (max(0.0, clean) if kept_non_negative else clean)

    weights, bias = fit(p, u, prior, steps=800, rate=0.05, decay=0.0)
    theta = np.append(weights, bias)
    start = np.zeros(4)
    start[-1] = np.log(prior / (1 - prior))
    assert risk(theta) < risk(start) - 0.01
    # Near a minimum of the risk: no step along an axis lowers it by much.
    for i in range(4):
        for d in (-0.5, 0.5):
            step = theta.copy()
            step[i] += d
            assert risk(step) > risk(theta) - 0.01


def test_toxicity_scores_derived_again(spark, sf):
    """Every score over the table from the model's weights, word by word, in plain Python."""
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = train(docs, labels)
    table, up = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64).astype(object) * 2 + 1, 0x9E3779B97F4A7C15
    whole = (1 << 64) - 1

    def bucket(word, size):
        x = (sum(int(table[c]) * pow(up, i, 1 << 64) for i, c in enumerate(word)) + size) & whole
        for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            x = ((x ^ x >> 33) * factor) & whole
        return (x ^ x >> 33) >> 44

    got = {r.doc_id: r.score for r in score(docs, model, "text", "doc_id").collect()}
    for r in docs.collect():
        found = set()
        for w in plain_words(r.text):
            raw = w.encode()
            found |= {bucket(raw, 0)} | {bucket(raw[:n], n) for n in (3, 4, 5, 6, 7) if len(raw) > n}
        z = model.bias + sum(model.weights[model.table[b]] for b in found if model.table[b] >= 0)
        assert abs(got[r.doc_id] - 1 / (1 + np.exp(-z))) < 1e-9


def test_sentencepiece_ids_are_the_models(spark, sf):
    """Whole texts of the table against the model's own encoding, and every sample against the vocabulary."""
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text for r in rows_of(spark, sf, "documents")}
    for r in QUERIES["op2_sentencepiece"](spark, sf).collect():
        assert r.round_trip and (r.ids == model.encode(texts[r.doc_id]) or "▁" in texts[r.doc_id])
        drawn = [tuple(s.ids) for s in r.samples]
        assert len(set(drawn)) == len(drawn) and all(model.decode(list(d)) == texts[r.doc_id] for d in drawn)


def test_samples_are_the_best_of_all_paths():
    """A small lattice enumerated: as many samples as there are paths give each once, in falling order of their keys, with the
    probabilities of the lattice; fewer are its most perturbed ones, with inclusion scores below 1."""
    units = Units(public_tokenizers.path("piece_bpe_32k.model"), 1.0)
    row = units.lookup([" the"])
    n = 400
    every = sample(units, [row] * n, mix(np.arange(n, dtype=np.uint64)), 64)
    paths = {tuple(x[0]): x[1] for x in every[0]}
    spell = lambda ids: "".join(units.model.id_to_piece(int(i)) for i in ids)

    def cuts(text):
        if not text:
            return [()]
        return [(text[:i], *rest) for i in range(1, len(text) + 1) if text[:i] in units.pieces for rest in cuts(text[i:])]

    want = {tuple(units.pieces[p] for p in c): sum(units.weight[units.pieces[p]] for p in c) for c in cuts("▁the")}
    total = np.logaddexp.reduce(list(want.values()))
    assert set(paths) == set(want) and all(abs(paths[c] - (w - total)) < 1e-5 for c, w in want.items())
    assert all(len(r) == len(want) and {tuple(x[0]) for x in r} == set(want) and {spell(x[0]) for x in r} == {"▁the"} for r in every)
    few = sample(units, [row] * n, mix(np.arange(n, dtype=np.uint64)), 2)
    assert all([tuple(x[0]) for x in a] == [tuple(x[0]) for x in b[:2]] and all(x[2] <= 0 for x in a) for a, b in zip(few, every, strict=True))


def test_samples_follow_the_lattice():
    units = Units(public_tokenizers.path("piece_bpe_32k.model"), 1.0)
    row, n = units.lookup([" than", " he"]), 20_000
    drawn = sample(units, [row] * n, mix(np.arange(n, dtype=np.uint64)), 3)
    chance = {tuple(x[0]): np.exp(x[1]) for r in drawn for x in r}
    first = Counter(tuple(r[0][0]) for r in drawn)
    for path, p in chance.items():
        assert abs(first[path] / n - p) < 5 * np.sqrt(p / n) + 1e-3
    # Inclusion scores make sums over samples unbiased: here of all chances, which is 1.
    assert abs(np.mean([sum(np.exp(x[1] - x[2]) for x in r) for r in drawn]) - 1) < 0.01


def test_a_smaller_table_changes_nothing():
    units = Units(public_tokenizers.path("piece_bpe_32k.model"), 1.0)
    text, keys = [" than", " xylophonically", "\n", "ñandú"], mix(np.arange(50, dtype=np.uint64))
    row = units.lookup(text)
    before = str(sample(units, [row] * 50, keys, 2)), units.encode(row)[0].tolist()
    units.lookup([f" other{i}" for i in range(500)])
    units.shrink(100)
    row = units.lookup([" new", *text])[1:]
    assert (str(sample(units, [row] * 50, keys, 2)), units.encode(row)[0].tolist()) == before and len(units.index) <= 105


def test_units_of_texts_are_looked_up_once():
    """Units of texts cut in one go are those of the regular expression, each different one is looked up once, and what ids spell is
    what the model decodes."""
    units = Units(public_tokenizers.path("piece_bpe_32k.model"), 1.0)
    texts = ["the cat " * 500, "", None, " ", "  two  spaces ", "\n\n a\n", "▁a ▁", "x▁", "é×÷ÿ ɏɐͯͰ \u1fff\u2000", "日本語 😀a\u0000b\t c", "Ab1,2;c  ", "a\n ", "-", " x"]
    pattern, asked, numbers = units.unit, [], units._numbers
    units._numbers = lambda x: asked.extend(x) or numbers(x)
    for unit in (pattern, UNIT):
        again = [t or "" for t in texts]
        if unit is UNIT and unit is not pattern:
            units.kinds[units.kinds == REST] = LETTERS
        every, cuts = units.split(again)
        names = list(units.index)
        assert [[names[i] for i in every[a:z]] for a, z in zip(cuts[:-1], cuts[1:], strict=True)] == [unit.findall(" " + t) if t else [] for t in again]
        assert len(asked) == len(set(asked)) < 80
        asked.clear()
    units = Units(public_tokenizers.path("piece_bpe_32k.model"), 1.0)
    every, cuts = units.split(again)
    ids, n = units.encode(every)
    ends = np.concatenate(([0], np.cumsum(n)))[cuts]
    assert units.spells(ids, ends, again) == [units.model.decode(ids[a:z].tolist()) == t for a, z, t in zip(ends[:-1], ends[1:], again, strict=True)] == [True] * len(again)
    assert not any(units.spells(ids, ends, [t + "?" for t in again]))
    assert units.seen.sum() == len(every) and units.split([""])[0].tolist() == []


def test_texts_with_a_single_segmentation():
    """Digits and characters outside the vocabulary have one path each, whatever rounding says of its edges: it is drawn, alone."""
    units = Units(public_tokenizers.path("piece_bpe_32k.model"), 1.0)
    texts = [str(i) for i in range(300)] + ["2024-0", "日本語", "\n", "♪♪", "ψ5", "\n7\n日"] + [chr(c) for c in range(0x4E00, 0x4F00)]
    every, cuts = units.split(texts)
    rows = [every[a:z] for a, z in zip(cuts[:-1], cuts[1:], strict=True)]
    only = np.diff(np.append(units.state, len(units.to))) == np.array([len(u) for u in units.index])  # units of as many edges as places
    assert sum(only[row].all() for row in rows) > 300
    for k in (2, 3):
        for row, drawn in zip(rows, sample(units, rows, mix(np.arange(len(rows), dtype=np.uint64)), k), strict=True):
            ways = [tuple(ids.tolist()) for ids, _, _ in drawn]
            assert len(set(ways)) == len(ways) >= 1
            if only[row].all():
                assert [(ids.tolist(), p, inclusion) for ids, p, inclusion in drawn] == [(units.encode(row)[0].tolist(), 0.0, 0.0)]
