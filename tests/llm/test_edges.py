"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import quire.llm.near_dedup as near_dedup_module
from quire.llm.chat import read_back, windows
from quire.llm.decontaminate import decontaminate
from quire.llm.embedding_dedup import embedding_dedup
from quire.llm.html_extract import extract, kept, lines_of, main_text, regions
from quire.llm.licenses import NOTICES, scan
from quire.llm.near_dedup import near_dedup
from quire.llm.pii import DATE_ORDERS, Feistel, Pseudonyms, luhn_digit, pseudonymise, replace_in
from quire.llm.queries import QUERIES
from quire.llm.shared import BATCH_BYTES, BATCH_SETTING
from quire.llm.subwords import decode, encode
from quire.llm.token_counts import attribute
from quire.llm.textkit import tidy
from quire.llm.toxicity import Model, blank_table, score, toxicity

LONG = " ".join(f"word{i % 977}x{i}" for i in range(60_000))
TEXTS = [
    (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (3, None), (4, ""), (5, " \n\t "), (6, "one two"), (6, "one two"),
    (7, LONG), (8, LONG + " tail"), (9, "ÄÖ ñandú 日本語 text ▁ \x00 end"), (None, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (10, "ONE Two"),
]


@pytest.fixture(scope="module")
def docs(spark):
    # Extra columns have the names that operators use inside.
    rows = [(i, t, "en", "s", len(t or ""), 1.0, "k", 5) for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, key string, id int").cache()


@pytest.fixture(scope="module")
def none(spark, docs):
    return spark.createDataFrame([], docs.schema)


def test_near_dedup(docs, none):
    got = sorted((tuple(r) for r in near_dedup(docs).collect()), key=lambda r: (r[0] is None, r))
    assert [(r[0], r[2], r[3]) for r in got] == [(1, 1, True), (2, 1, False), (3, 3, True), (4, 4, True), (5, 5, True), (6, 6, True), (6, 6, True), (7, 7, True), (8, 7, False), (9, 9, True), (10, 6, False), (None, None, True)]
    assert [r[1] for r in got][:7] == [8, 8, 0, 0, 0, 1, 1]
    assert near_dedup(none).count() == 0


def test_near_dedup_threshold(spark):
    """A pair just at and one just under the threshold, and a chain of links."""
    w = [f"w{i}" for i in range(200)]
    rows = [(1, w[:46]), (2, [*w[:36], *w[100:104]]), (3, [*w[:46], "z"]), (4, [*w[:46], "z", "y"])]
    sets = {i: {tuple(x[j : j + 5]) for j in range(len(x) - 4)} for i, x in rows}
    link = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    got = {r.doc_id: r.component_id for r in near_dedup(spark.createDataFrame([(i, " ".join(x)) for i, x in rows], "doc_id long, text string")).collect()}
    label = {i: i for i in sets}
    for _ in sets:
        for a, b in link:
            label[a] = label[b] = min(label[a], label[b])
    assert got == label


def families(n_families, n, words=150):
    """Altered copies of one text and of texts that differ from it in a run of words: linked within a family, near 0.7 across."""
    r = random.Random(5)
    base, out = [f"w{r.randrange(10**6)}" for _ in range(words)], []
    for f in range(n_families):
        text, at = base[:], r.randrange(5, words - 25)
        if f:
            text[at : at + 19] = [f"f{f}x{r.randrange(10**6)}" for _ in range(19)]
        for _ in range(n):
            copy = text[:]
            copy[r.randrange(words)] = f"e{r.randrange(10**7)}"
            out.append(copy)
    r.shuffle(out)
    return list(enumerate(out))


def linked_groups(rows):
    sets = {i: {tuple(x[j : j + 5]) for j in range(len(x) - 4)} for i, x in rows}
    label = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if b < a and label[a] != label[b]:
                c = len(sets[a] & sets[b])
                if 100 * c >= 75 * (len(sets[a]) + len(sets[b]) - c):
                    old, new = max(label[a], label[b]), min(label[a], label[b])
                    label = {k: new if v == old else v for k, v in label.items()}
    return label


@pytest.mark.parametrize("n_families, n", [(5, 40)])
def test_near_dedup_families(spark, monkeypatch, n_families, n):
    """Components are those of all pairs; the pairs compared grow with the texts, not with their square."""
    compared, verified = [], near_dedup_module.verified
    monkeypatch.setattr(near_dedup_module, "verified", lambda pairs, *a, **b: compared.append(pairs.count()) or verified(pairs, *a, **b))
    rows = families(n_families, n)
    got = {r.doc_id: r.component_id for r in near_dedup(spark.createDataFrame([(i, " ".join(x)) for i, x in rows], "doc_id long, text string")).collect()}
    assert got == linked_groups(rows) and len(set(got.values())) == n_families
    assert sum(compared) <= 16 * len(rows)


@pytest.mark.parametrize("n", [2, 5, 20])
def test_near_dedup_parts_that_meet(spark, n):
    """Parts 1 and 2 meet in lists of n texts of each; the one link between them is of two texts that are in none of these lists.
    It is found whatever n is. Texts are the centre's 100 shingles and 40 more, so two are linked if they share 20 of these."""
    extras = {1: [*range(1000, 1019), *range(2000, 2021)], 2: [*range(3000, 3020), *range(4000, 4020)], 3: [*range(1000, 1019), *range(3000, 3020), 9000]}
    parts = {1: 3, 2: 2, 3: 1}
    for i in range(21):  # so that all that text 1 holds is shared
        extras[50 + i], parts[50 + i] = [2000 + i, *range(20_000 + 40 * i, 20_039 + 40 * i)], 3
    for i in range(2 * n):
        extras[100 + i], parts[100 + i] = [*range(5000, 5005), *range(50_000 + 40 * i, 50_035 + 40 * i)], 1 + i % 2
    sets = spark.createDataFrame([(0, list(range(100))), *((a, [*range(100), *x]) for a, x in extras.items())], "id long, hashes array<long>")
    pairs = near_dedup_module.written(spark.createDataFrame([(a, 0) for a in extras], "a long, b long"), "pairs")
    sets = near_dedup_module.written(sets, "sets")
    labels = near_dedup_module.written(spark.createDataFrame(list(parts.items()), "node long, part long"), "labels")
    tested = near_dedup_module.verified(pairs, sets, 128, 75, edits=True)
    found = near_dedup_module.within_centres(tested, tested.where("linked").select("a", "b"), labels, sets, 128, 75)
    assert {tuple(sorted(r)) for r in found.collect()} == {(2, 3)}


def test_sets_of_wanted_texts(spark):
    """Exactly the wanted ids have sets, null ids none; texts don't pass a shuffle."""
    docs = spark.createDataFrame([(i if i % 50 else None, f"a{i} b c d e f") for i in range(3000)], "id long, text string")
    sets = near_dedup_module.sets_of(docs, spark.range(1, 9000, 7).union(spark.range(-3, 0)).select("id"), 5)
    got = {r.id: len(r.hashes) for r in sets.collect()}
    assert got == {i: 2 for i in range(1, 3000, 7) if i % 50} and sets.count() == len(got)
    texts = near_dedup_module.full_sets(docs, 5, np.zeros(1 << 10, dtype=np.uint8))
    assert texts.count() <= 3000 // 1000  # ids whose hash ends in zeros always pass


def test_near_dedup_leaves_no_sketches(spark, monkeypatch, tmp_path):
    """Tables of hashes, as large as the texts, are deleted as soon as nothing reads them; keys and classes stay for the result."""
    monkeypatch.setattr("quire.llm.shared.shared_folder", lambda spark: str(tmp_path))
    assert near_dedup(spark.createDataFrame([(i, " ".join(x)) for i, x in families(2, 8)], "doc_id long, text string")).count() == 16
    names = {p.name.split("-")[1] for p in tmp_path.iterdir()}
    assert {"keys", "classes"} <= names and not names & {"sketches", "nodes", "sets", "some"}


def test_near_dedup_shared_ids(spark):
    """Rows that share an id but not the text are linked each by its own text."""
    x, y = (" ".join(f"{c}{i}" for i in range(40)) for c in "xy")
    rows = [(5, x), (5, y), (3, x + " end"), (4, y + " end"), (9, y), (7, None), (7, x), (5, y)]
    got = sorted((r.doc_id, r.component_id, r.kept) for r in near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(3, 3, True), (4, 4, True), (5, 3, False), (5, 4, False), (5, 4, False), (7, 3, False), (7, 7, True), (9, 4, False)]


def test_decontaminate(spark, docs, none):
    items = spark.createDataFrame([(1, "beta GAMMA delta"), (2, ""), (3, None), (4, LONG[:200]), (11, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda nu"), (11, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda nu")], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate(docs, items).collect()}
    assert got[1].n_hit == 11 and got[1].items == [1, 11] and got[None].n_hit == 11
    assert got[3].n_words == got[4].n_words == got[5].n_hit == 0 and got[7].items == got[8].items == [4] and got[6].n_words == 2
    assert decontaminate(none, items).count() == 0
    assert {r.n_hit for r in decontaminate(docs, items.where("false")).collect()} == {0}


def test_embeddings(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [1.0, 0.0], 0), (4, [1.0, 0.0], None), (5, None, 0), (6, [0.0, 0.0], 0), (7, [nan, 1.0], 0), (8, [inf, 1.0], 0), (9, [1.0, None], 0), (10, [], 0), (None, [1.0, 0.0], 0), (11, [0.93, 0.3675], 0), (12, [1.0, 0.0, 0.0], 0), (13, [0.0, 1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("tile", F.lit(1))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup(df).collect()}
    assert got[1] == (3, 1, True) and got[2] == (3, 1, False) and got[11] == (3, 1, False)
    assert all(got[i] == (0, i, True) for i in (4, 5, 6, 7, 8, 9, 10, 12, 13, None))
    assert embedding_dedup(df.where("false")).count() == 0


def test_embeddings_shared_ids_and_tiles(spark):
    """Rows that share an id are linked each under its own label; small tiles give what one tile gives."""
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 1), (2, [1.0, 0.1], 0), (3, [0.1, 1.0], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.1], 2), (4, [-1.0, 0.0], 2)]
    got = Counter(map(tuple, embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()))
    assert got == Counter([(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (3, 1, 3, True), (4, 1, 3, False), (4, 0, 4, True)])
    r = np.random.default_rng(3)
    base = r.normal(size=(12, 16))
    x = base[r.integers(0, 12, 400)] + 0.25 * r.normal(size=(400, 16))
    label = r.integers(0, 2, 400)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = (unit @ unit.T >= 0.93) & (label[:, None] == label[None, :])
    reach = np.linalg.matrix_power(link.astype(float), 16) > 0
    for _ in range(5):
        reach = (reach.astype(float) @ reach.astype(float)) > 0
    df = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, label, strict=True))], "vec_id long, embedding array<double>, label int")
    for tile in (8192, 32):
        got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup(df, tile=tile).collect()}
        assert got == {i: (int(link[i].sum()) - 1, int(np.flatnonzero(reach[i])[0])) for i in range(400)}


def test_toxicity(spark, docs, none):
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 11)] + [(None, 1), (1, None)], "doc_id long, toxic int")
    got = toxicity(docs, labels).collect()
    assert len(got) == len(TEXTS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert toxicity(none, labels).count() == 0
    assert {r.score for r in toxicity(docs, labels.where("false")).collect()} == {0.0}


def test_toxicity_held_out(spark):
    good = [(i, " ".join(f"w{(i * 7 + j * j) % 500}" for j in range(30))) for i in range(600)]
    rows = [(i, t + (f" bad{i % 3}word" if i % 8 == 0 else "")) for i, t in good]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 8 == 0)) for i in range(0, 600, 1)], "doc_id long, toxic int")
    got = [(r.doc_id % 8 == 0, r.predicted) for r in toxicity(docs, labels).where("held_out").collect()]
    assert sum(t == bool(p) for t, p in got) >= 0.97 * len(got) and len(got) > 100


def test_pii(spark, docs, none):
    key = b"secret"
    text = "Call +1 (743) 555-3824 or jo.b42@mail8.example.com, card 4111 1111 1111 1111, not 4111111111111112, from 70.23.22.57 (999.1.1.1), 2024-02-29 not 2023-02-29, 123-45-6789, DE89370400440532013000!!"
    new, kinds = replace_in(text, Pseudonyms(key))
    assert sorted(kinds) == ["card", "date", "email", "iban", "ip", "phone", "ssn"]
    for value in ("743", "jo.b42@", "4111 1111 1111 1111", "70.23.22.57", "2024-02-29", "123-45-6789", "DE89370400440532013000"):
        assert value not in new
    assert "4111111111111112" in new and "999.1.1.1" in new and "2023-02-29" in new and new.startswith("Call +1 (")
    assert replace_in(new, Pseudonyms(key, back=True))[0] == text
    for text, n in (("4111111111111111 42 units", 1), ("4111111111111111 4111111111111111", 2), ("4111-1111-1111-1111!!", 1), ("3782 822463 10005", 1), ("12345678901234567890123", 0), ("v1.2.3.4.5", 0), ("a@b, x@y.z1", 0)):
        new, kinds = replace_in(text, Pseudonyms(key))
        assert len(kinds) == n and replace_in(new, Pseudonyms(key, back=True))[0] == text and (new != text) == (n > 0), text
    got = pseudonymise(docs, key)
    assert got.columns == [*docs.columns, "pii_kinds"] and got.count() == len(TEXTS)
    assert sorted((r.doc_id or 0, r.text or "") for r in got.collect()) == sorted((i or 0, t or "") for i, t in TEXTS)
    assert pseudonymise(none, key).count() == 0


def test_pii_short_ips(spark):
    """Addresses of single digits are replaced where the text holds nothing else, and as in any other text."""
    rows = [(1, "resolver 8.8.8.8 answered"), (2, "42 times resolver 8.8.8.8 answered"), (3, "1.1.1.1"), (4, "v 1 . 2")]
    got = {r.doc_id: r for r in pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), b"secret").collect()}
    assert [got[i].pii_kinds for i in (1, 2, 3, 4)] == [["ip"], ["ip"], ["ip"], []]
    assert "8.8.8.8" not in got[1].text and got[2].text == "42 times " + got[1].text and got[4].text == "v 1 . 2"


def test_pii_words_after_an_iban():
    """Words and numbers that look like a group of an IBAN are not taken along; values among them are found too."""
    names, back = Pseudonyms(b"secret"), Pseudonyms(b"secret", back=True)
    ibans = ["ES9121000418450200051332", "ES91 2100 0418 4502 0005 1332", "AT611904300234573201", "BE68539007547034", "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "NO9386011117947"]
    for iban in ibans:
        alone = replace_in(iban, names)[0]
        assert alone != iban
        for tail, kinds in (("", []), (" EUR", []), (" 42", []), (" 1250 EUR", []), (" ABCD EFGH 12", []), (" 4111 1111 1111 1111", ["card"]), (" " + iban, ["iban"]), (" 2024-02-29", ["date"])):
            new, found = replace_in(iban + tail, names)
            assert found == ["iban", *kinds] and new.startswith(alone) and replace_in(new, back)[0] == iban + tail, (iban, tail)
            assert kinds or new == alone + tail
    assert replace_in("AB12 4111 1111 1111 1111", names)[1] == ["card"]


def test_pii_spellings():
    """Common spellings go, with what surrounds them; numbers that fit no format, and addresses of no one, stay."""
    names, back = Pseudonyms(b"secret"), Pseudonyms(b"secret", back=True)
    for text, kinds in (
        ("BE68 5390 0754 7034 BANK", ["iban"]), ("ES91 2100 0418 4502 0005 1332 OK", ["iban"]), ("call 555 123 4567 now", ["phone"]), ("+15551234567", ["phone"]), ("+49 30 12345678", ["phone"]), ("(+44 20 7946 0958)", ["phone"]), ("Tel.555-123-4567.", ["phone"]),
        ("123 45 6789", ["ssn"]), ("2024-02-29T10:00:00Z", ["date"]), ("4111-1111-1111-1111-", ["card"]), ("on 2024-02-29.", ["date"]), ("from 8.8.8.8, 9.9.9.9.", ["ip", "ip"]), ("+999 12345678", []), ("+12 34", []), ("0.0.0.0 127.0.0.1 255.255.255.255", []),
        ("10 200 300 4000", []), ("200 300 4000 5", []), ("1.2.3.4.5", []), ("000 45 6789", []), ("+1 (017) 555-7713", ["phone"]), ("sum-123-45-6789", []),
    ):
        new, found = replace_in(text, names)
        assert found == kinds and (new != text) == bool(kinds), (text, new, found)
        assert replace_in(new, back)[0] == text, (text, new)
    digits = lambda t: re.sub(r"\D", "", replace_in(t, names)[0])[-10:]
    assert len({digits(t) for t in ("+15551234567", "555 123 4567", "(555) 123-4567", "+1-555-123-4567", "555.123.4567")}) == 1


def test_pii_more_spellings():
    """Dates in every order, foreign and national numbers, lower-case IBANs, cards with dots and long IPs keep their format; one
    value in several spellings gets one pseudonym."""
    names, back = Pseudonyms(b"secret"), Pseudonyms(b"secret", back=True)
    for text, kind in (
        ("31/12/1999", "date"), ("2024/02/29", "date"), ("29.2.2024", "date"), ("1/2/2024", "date"), ("31-12-1999", "date"), ("2024.02.29", "date"), ("1/02/2024", "date"),
        ("0049 30 12345678", "phone"), ("030 12345678", "phone"), ("(030) 12345678", "phone"), ("0171/1234567", "phone"), ("+49 (0)30 12345678", "phone"), ("+44 (0) 20 7946 0958", "phone"),
        ("4111.1111.1111.1111", "card"), ("de89370400440532013000", "iban"), ("de89 3704 0044 0532 0130 00", "iban"), ("2001:db8::1", "ip"), ("2001:0DB8:0000::0001", "ip"), ("fe80::1ff:fe23:4567:890a", "ip"),
    ):
        for before, after in (("", ""), ("x ", " y"), ("(", ")."), ("at ", ": ok")):
            new, found = replace_in(before + text + after, names)
            assert found == [kind] and new != before + text + after and re.sub(r"[0-9a-z]", "0", new.lower()) == re.sub(r"[0-9a-z]", "0", (before + text + after).lower()), (text, new, found)
            assert replace_in(new, back)[0] == before + text + after
    for text in ("13/13/2020", "30.2.2024", "12:30:45", "std::abc", "aa:bb:cc:dd:ee:ff", "2001::", "::1", "1,00 20 30 40 50 60", "no12 word then four five", "4111.1111.1111.1112", "0012345678"):
        assert replace_in(text, names) == (text, [])
    of = lambda t: replace_in(t, names)[0]
    day = of("1999-12-31")
    y, m, d = day.split("-")
    assert (of("31/12/1999"), of("12/31/1999"), of("31.12.1999"), of("31-12-1999")) == (f"{d}/{m}/{y}", f"{m}/{d}/{y}", f"{d}.{m}.{y}", f"{d}-{m}-{y}")
    digits = lambda t: re.sub(r"\D", "", of(t).replace("(0)", ""))[-10:]
    assert len({digits(t) for t in ("+49 30 12345678", "+49 (0)30 12345678", "0049 30 12345678", "+49 (30) 12345678")}) == 1
    assert of("de89370400440532013000")[-18:] == re.sub(" ", "", of("de89 3704 0044 0532 0130 00"))[-18:]
    assert [int(g or "0", 16) for g in of("2001:0DB8:0000::0001").split(":")[:2]] == [int(g, 16) for g in of("2001:db8::1").split(":")[:2]]
    for first in range(1, 29):  # digits in brackets never turn into a trunk zero
        text = f"+49 ({first % 9 + 1}){first} 1234{first:03d}"
        assert replace_in(of(text), back)[0] == text


def test_feistel_permutes():
    for size in (1, 2, 7, 100, 366, 1000):
        net = Feistel(b"k", "t", size)
        hidden = [net.hide(x) for x in range(size)]
        assert sorted(hidden) == list(range(size)) and [net.show(y) for y in hidden] == list(range(size))
    assert luhn_digit("7992739871") == 3 and set(DATE_ORDERS) == {"-", "/", "."}


def test_sentencepiece(docs, none):
    made = encode(docs, k=3).cache()
    assert made.count() == len(TEXTS) and made.where("not round_trip").count() == 0
    for r in made.collect():
        drawn = [tuple(s.ids) for s in r.samples]
        assert len(set(drawn)) == len(drawn) <= 3 and all(s.log_inclusion <= 1e-9 and s.log_prob <= 0 for s in r.samples)
    texts = {(r.doc_id, r.text) for r in decode(made).collect()}
    assert texts == {(i, t or "") for i, t in TEXTS}
    sampled = made.where("size(samples) > 0").select("doc_id", F.col("samples")[0]["ids"].alias("ids"))
    assert {(r.doc_id, r.text) for r in decode(sampled).collect()} == {(i, t) for i, t in TEXTS if t}
    again = {(r.doc_id, str(r.samples)) for r in encode(docs.repartition(3), k=3).collect()}
    assert again == {(r.doc_id, str(r.samples)) for r in made.collect()}
    assert encode(none).count() == 0


def test_token_counts(docs, none):
    for r in attribute(docs).collect():
        assert sum(s.n_tokens for s in r.sections) == r.n_tokens and all(a.stop == b.start for a, b in zip(r.sections, r.sections[1:], strict=False))
    by = {r.doc_id: r for r in attribute(docs).collect()}
    assert by[3].n_tokens == by[4].n_tokens == 0 and by[4].sections == [] and by[7].sections[-1].stop == len(LONG)
    assert attribute(none).count() == 0


def test_html(spark):
    page = '<html><head><title>T</title><script>var a="</p>";</script></head><body><header><h2>Site</h2></header><nav><a href=a>Home</a></nav><div class="cookie-notice">We use cookies</div><article><h1>Head &amp; tail</h1><p>One\n two&nbsp;&#51;</p><div class="ad">Buy</div><p>Four<form>Mail <input></form><p>Five</article><section class="comments"><p>Nice!</p></section><aside>More</aside><footer>&copy;</footer>'
    assert main_text(page) == "Head & tail\nOne two 3\nFour\nFive"
    assert main_text(None) == main_text("") == main_text("<nav><a>x</a></nav>") == ""
    plain = "<div><a>Home</a> <a>About</a></div><div><p>" + "Words of the text. " * 30 + "</p><p>Short.</p></div><div><a>Next</a></div>"
    assert main_text(plain) == ("Words of the text. " * 30).strip() + "\nShort."
    assert len(main_text("<article>" + "<p>x y</p>" * 20_000)) == 4 * 20_000 - 1
    framed = '<div class="page-with-sidebar"><div class="site-header">Site</div><main><div class="entry-header"><h1>Head</h1></div><p>Body.</p></main><div class="sidebar">Side</div></div>'
    assert main_text(framed) == "Head\nBody."
    df = spark.createDataFrame([(1, "u", page, "old"), (None, None, None, "old"), (1, "u", page, "old")], "page_id long, url string, html string, text string")
    assert [r.text for r in extract(df).collect()].count("") == 1 and extract(df.where("false")).count() == 0 and extract(df).columns == ["page_id", "url", "text"]


def test_html_wrapped_article():
    """What holds the dominant article is a frame, whatever its class says; small articles in furniture and hidden ones stay out."""
    article = "<article><h1>Head</h1><p>" + "Words of the text. " * 9 + "</p><div class=ad>Buy</div></article>"
    want = "Head\n" + ("Words of the text. " * 9).strip()
    for name in ("has-sidebar", "no-sidebar", "content-sidebar", "page-nav-fixed"):
        assert main_text(f'<body><div class="{name}"><div id="search-page">{article}</div><div class="sidebar">Side</div></div><div class="related"><article>Teaser</article></div>') == want
    assert main_text(f'<div class="has-sidebar">{article}{article}<div class="related"><article>Teaser</article></div></div>') == want + "\n" + want
    assert main_text(f'{article}<div class="related"><article>Teaser</article></div>') == want
    assert main_text("<div><p>" + "Plain words of the page. " * 9 + '</p></div><div class="related"><article>Teaser</article></div>') == ("Plain words of the page. " * 9).strip()
    assert main_text(f'<div class="has-sidebar" style="display:none">{article}</div><aside class="sidebar">{article}</aside>') == ""


def test_html_split_body():
    """An unmarked article that furniture of many lines cuts in two is whole; what is neither near nor like it stays out."""
    first, last = ("Words of the text. " * 30).strip(), "And so it ends."
    links = "<ul class=related>" + "<li><a href=a>One more page</a></li>" * 5 + "</ul>"
    foot = links + "<div><p>Imprint</p></div>"
    for gap in (links, links.replace(" class=related", ""), "<div class=ad><p>Buy</p><p>this</p><p>now</p><p>!</p></div>", "<form><p>a</p><p>b</p><p>c</p><p>d</p></form>"):
        assert main_text(f"<body>{links}<div><p>{first}</p>{gap}<p>{last}</p></div>{foot}") == f"{first}\n{last}"
        assert main_text(f"<body>{links}<p>{first}</p>{gap}<p>{last}</p>{foot}") == f"{first}\n{last}"
        assert main_text(f"<body>{links}<div><p>{first}</p></div>{gap}<div><p>{first}</p></div>{foot}") == f"{first}\n{first}"
        assert main_text(f"<body><div>{first}{gap}{last}</div>{foot}") == f"{first}\n{last}"
        assert main_text(f"<body><div><p>{last}</p>{gap}<p>{first}</p></div><p>Below</p>{foot}") == f"{last}\n{first}\nBelow"


def test_html_furniture_names():
    """Classes of body paragraphs take nothing away; comments go even as articles; frames of the whole page are none."""
    body = "Words of the text. " * 9
    for name in ("form", "note form", "search-term", "related-work", "share", "tags", "intro widget", "no-comments"):
        assert main_text(f'<article><h1>Head</h1><p class="{name}">{body}</p><p>End</p></article>') == f"Head\n{body.strip()}\nEnd"
    assert main_text(f'<article><p>{body}</p></article><article class="comment"><p>{body}</p></article><section id="comments"><p>{body}</p></section>') == body.strip()
    assert main_text(f'<article><p>{body}</p><p class="cookie-notice">We use cookies</p><div class="share"><a href=a>Post</a> <a href=b>Mail</a></div><div class="sidebar">Side</div></article>') == body.strip()
    for frame in ('<form action="/">{}</form>', '<form><div class="wrapper">{}</div></form>', '<div class="search-page">{}</div>', '<div class="sidebar-layout">{}</div>'):
        assert main_text("<body><nav><a href=a>Home</a></nav>" + frame.format(f"<main><h1>Head</h1><p>{body}</p></main>") + "<footer>Foot</footer></body>") == f"Head\n{body.strip()}"
        assert main_text("<body><nav><a href=a>Home</a></nav>" + frame.format(f"<div><h1>Head</h1><p>{body}</p></div>") + "<footer>Foot</footer></body>") == f"Head\n{body.strip()}"


def test_html_windows_decide():
    """Without marks and names, surge and dive points decide; other windows and thresholds give other texts."""
    body = "Words of the text. " * 9
    page = "<div><p>Top</p></div><div><p>Line</p></div><div><p>More</p></div><div><p>Far</p></div><div>" + f"<p>{body}</p>" * 4 + "<p>End</p></div>" + "<div><p>Small words down here</p></div>" * 4
    assert main_text(page) == "\n".join([body.strip()] * 4 + ["End"])
    assert regions([1.0, 1.0, 40.0, 40.0, 1.0, 1.0]) == [(1, 5)] and regions([1.0, 1.0, 40.0, 40.0, 1.0, 1.0], surge=0.01) == [(0, 6)]
    split = "".join(f"<div><p>{body}</p></div>" + "<div><p>tiny</p></div>" * 4 for _ in range(3))
    assert main_text(split) == "\n".join([body.strip()] * 3)
    assert len(kept(lines_of(split), window=9)) > 3 and len(kept(lines_of(split), surge=0.01)) > 3


def test_html_deep():
    """Depth and stray end tags cost no more than their number."""
    n = 100_000
    start = time.time()
    assert main_text("<div>" * n + "deep text" + "</div>" * n) == "deep text"
    assert main_text("<div class=sidebar-x>" * n + "deep text") == "deep text"
    assert main_text("<div>x" * n).count("x") == n
    assert main_text("<b><div>" * 1000 + "y" + "</i></b>" * n) == "y"
    assert time.time() - start < 60


def test_chat(spark):
    long = "word " * 400
    rows = [(1, 0, "system", "be kind", 1), (1, 1, "user", long, 1), (1, 2, "assistant", "a <b> [TURN x] &amp; </s>", 1), (1, 3, "user", "short", 1), (1, 4, "assistant", long, 1), (1, 5, "assistant", "", 1), (2, 0, None, None, 1), (None, None, "user", "x\ny", 1), (3, 0, "assistant", "same", 1), (3, 0, "assistant", "same", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, window int")
    made = windows(df, budget=200, history=100).cache()
    back = {r.conv_id: r for r in read_back(made).collect()}
    for c in (1, 2, None, 3):
        want = [(r[2] or "", r[3] or "") for r in rows if r[0] == c]
        assert [(t.role, t.text) for t in back[c].turns] == want
        assert back[c].losses == [t for role, t in want if role == "assistant"]
    ones = {r.window: r.formatted for r in made.where("conv_id = 1").collect()}
    assert len(ones) > 2 and all("system]be kind" in f for f in ones.values()) and sum("[HIST " in f for f in ones.values()) > 0
    assert windows(df.where("false")).count() == 0


def test_chat_budget(spark):
    """No window passes the budget, system turn and history counted, but those of a single turn that does so alone."""
    r = random.Random(11)
    rows = [(c, t, "system" if t == 0 and c % 2 else ("user", "assistant")[t % 2], "w " * r.choice([0, 3, 20, 60, 90, 150, 400] if c % 3 else [1, 5, 30])) for c in range(30) for t in range(r.randrange(1, 60))]
    rows.append((99, 0, "assistant", "word " * 200_000))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = windows(df, budget=256, history=64).cache()
    repeated = 0
    for w in made.collect():
        turns = [(m[1], m[2], len(m[3].split()) + 4) for m in re.finditer(r"\[(TURN|HIST) ([^]]*)\]([^<]*)</s>", w.formatted)]
        new = [t for kind, role, t in turns if kind == "TURN" and role != "system"]
        history = [t for kind, role, t in turns if kind == "HIST" and role != "system"]
        system = sum(t for _, role, t in turns if role == "system")
        assert len(history) <= 2 and sum(history) <= 64
        assert system + sum(new) + sum(history) <= 256 or (len(new) == 1 and not history), turns
        repeated += len(history)
    assert repeated > 20 and made.count() < 0.7 * len(rows)
    back = {r.conv_id: r for r in read_back(made).collect()}
    for c in {r[0] for r in rows}:
        assert [(t.role, t.text) for t in back[c].turns] == [r[2:] for r in rows if r[0] == c]
        assert back[c].losses == [r[3] for r in rows if r[0] == c and r[2] == "assistant"]


def test_licenses(spark, docs, none):
    rows = [(1, "Some text. " + NOTICES["MIT-notice"] + " More."), (2, LONG + " " + NOTICES["Apache-2.0"].upper() + " " + LONG), (3, "released under the"), (4, None), (None, NOTICES["CC-BY-NC-4.0-notice"]), (5, NOTICES["ISC"].replace("granted", "given"))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("size", F.lit(1))
    got = {(r.doc_id, r.license): (round(r.containment, 2), r.start) for r in scan(df).collect()}
    assert got[1, "MIT-notice"] == (1.0, 2) and got[2, "Apache-2.0"] == (1.0, 60_000) and got[None, "CC-BY-NC-4.0-notice"] == (1.0, 0) and 0.75 <= got[5, "ISC"][0] < 1
    assert set(got) == {(1, "MIT-notice"), (2, "Apache-2.0"), (2, "Apache-2.0-notice"), (None, "CC-BY-NC-4.0-notice"), (5, "ISC")}
    assert scan(docs).count() == 0 and scan(none).count() == 0


def test_licenses_of_shared_ids(spark):
    """Texts that share an id, or have none, are searched each, whichever comes first."""
    part, whole = " ".join(NOTICES["MIT"].split()[:30]), NOTICES["MIT"]
    rows = [(i, t) for i in range(20) for t in ((part, whole) if i % 2 else (whole, part))] + [(None, part), (None, whole), (None, part + " more")]
    got = {(r.doc_id, r.license): r.containment for r in scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(i, "MIT"): 1.0 for i in [*range(20), None]}


def test_decontamination_stage_judges_texts(spark, sf):
    """A contaminated text takes no clean ones along that have its id or, like it, none."""
    bad = spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").first().text
    rows = [(None, bad), (None, "clean words"), (None, None), (7, bad), (7, "other clean words"), (8, bad)]
    got = corpus_pipeline.decontamination_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf).collect()
    assert sorted(map(str, got)) == sorted(str(r) for r in spark.createDataFrame([rows[1], rows[2], rows[4]], "doc_id long, text string").collect())


def test_pipeline_stages(spark, docs, none, sf):
    frame = docs
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf).count() == 0, name
        out = stage(spark, frame, sf)
        if name != "sentencepiece":
            assert out.columns == docs.columns
            frame = spark.createDataFrame(out.collect(), docs.schema)
    kept = sorted((r.doc_id for r in frame.collect()), key=str)
    assert kept == [1, 3, 4, 5, 6, 7, 9, None]


def test_pipeline_stages_with_odd_columns(spark, docs, sf):
    """Extra columns with the names that stages and operators use inside go through unchanged."""
    names = ["known", "repeated", "key", "kinds", "toxicity", "text_", "kept", "label", "n_hit", "pii_kinds", "__id", "__key", "__text", "component_id", "seed", "n"]
    odd = docs.select("*", *(F.lit(i).alias(c) for i, c in enumerate(names) if c not in docs.columns))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, sf)
        assert out.columns == odd.columns, name
        assert all(r[c] == i for r in out.collect() for i, c in enumerate(names) if c not in docs.columns), name
    assert corpus_pipeline.STAGES[-1][1](spark, odd, sf).count() == odd.count()


def test_pipeline_against_its_operators(spark, sf):
    """The chain on given tables, stage by stage, from the operators' own decisions in plain Python."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = spark.createDataFrame(list(rows.values()), docs.schema)
        out = {r.doc_id: r for r in stage(spark, frame, sf).collect()}
        if name == "near_dedup":
            assert set(out) == {r.doc_id for r in near_dedup(frame).collect() if r.kept}
        if name == "decontamination":
            items = spark.read.parquet(f"{sf}/benchmark.parquet")
            assert set(out) == set(rows) - {r.doc_id for r in decontaminate(frame, items).collect() if r.n_hit}
        if name == "pii":
            names = Pseudonyms(corpus_pipeline.DEMO_KEY)
            assert {i: r.text for i, r in out.items()} == {i: replace_in(r.text, names)[0] for i, r in rows.items()}
        rows = out
    final = corpus_pipeline.run(spark, sf)
    got = {r.doc_id: r for r in final.collect()}
    assert set(got) == set(rows) and all(r.round_trip for r in got.values())


def test_pipeline_ends_with_single_segmentations(spark, sf):
    """Numbers have one segmentation each; the last stage returns it for every row."""
    numbers = spark.range(2000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    got = dict(corpus_pipeline.STAGES)["sentencepiece"](spark, numbers, sf).collect()
    assert sorted(r.doc_id for r in got) == list(range(2000)) and all(r.round_trip for r in got)
    assert all([(s.ids, s.log_prob) for s in r.samples] == [(r.ids, 0.0)] for r in got)


def test_op2_batches_are_bounded(spark, sf):
    spark.conf.unset(BATCH_SETTING)
    QUERIES["op2_sentencepiece"](spark, sf)
    assert int(spark.conf.get(BATCH_SETTING)) == BATCH_BYTES


def test_pipeline_batches_are_bounded(spark, sf):
    """What a stage sends to Python at once follows neither the length of texts nor the 10 000 rows of Spark's default."""
    long_texts = spark.range(0, 200, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 20_000).alias("text"))
    stage = dict(corpus_pipeline.STAGES)["pii"]

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "bytes"])

    got = stage(spark, long_texts, sf).mapInArrow(sizes, "n long, bytes long").collect()
    assert sum(r.n for r in got) == 200
    assert max(r.bytes for r in got) < 6 << 20


def test_near_dedup_stage_shuffles_no_texts(spark, docs, sf, monkeypatch):
    """Texts meet the ids of those that go by a broadcast; where these are too many, the rows are the same."""
    stage = dict(corpus_pipeline.STAGES)["near_dedup"]
    plain = docs.where("doc_id is null or doc_id <> 6")  # no repeated id, so that the plan has that one join
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        few = stage(spark, plain, sf)
        plan = few._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        monkeypatch.setattr(corpus_pipeline, "BROADCAST_IDS", 0)
        many = stage(spark, plain, sf)
        assert sorted(map(str, few.collect())) == sorted(map(str, many.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_tasks_give_memory_back(monkeypatch):
    """Once a task is through, and not before what it held is gone."""
    events = []
    monkeypatch.setattr("quire.llm.textkit.release", lambda: events.append("released"))

    def run(batches):
        try:
            yield from batches
        finally:
            events.append("gone")

    assert list(tidy(run)(iter([1, 2]))) == [1, 2]
    assert events == ["gone", "released"]


def test_units_kept_do_not_change_segmentations(docs):
    want, got = (sorted(map(str, encode(docs, **more).collect())) for more in ({}, {"units_kept": 40}))
    assert got == want


def test_rows_of_a_batch_in_several_pieces(spark):
    """Batches of over a megabyte are worked on in pieces: no row is lost or shifted, null and empty ones included."""
    texts = [None if i % 7 == 3 else "" if i % 7 == 5 else f"bad{i % 2} mail{i}@example.org " * 15_000 for i in range(20)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    names = Pseudonyms(b"k")
    assert {r.doc_id: r.text for r in pseudonymise(frame, b"k").collect()} == {i: t and replace_in(t, names)[0] for i, t in enumerate(texts)}
    model = Model(blank_table(), np.ones(1), -1.0)
    model.table[::3] = 0
    alone = {r.doc_id: r.score for r in score(frame, model, "text", "doc_id").collect()}
    beside = {r.doc_id: (r.text, r.score) for r in score(frame, model, "text", "doc_id", "text").collect()}
    assert beside == {i: (t, alone[i]) for i, t in enumerate(texts)} and len({*alone.values()}) > 1


def test_embeddings_exactly_at_the_threshold(spark):
    """Cosines of 93 / 100, which doubles hold: each pair is linked. A few units in the last place below, none is."""
    rng, rows = random.Random(3), []
    for k in range(200):
        order, signs = rng.sample(range(6), 6), [rng.choice([-1.0, 1.0]) for _ in range(6)]
        turn = lambda v: [v[o] * s for o, s in zip(order, signs, strict=True)]
        scale = rng.choice([1.0, 4.0, 2.0**300])
        rows += [(2 * k, f"at{k}", turn([1.0, 0, 0, 0, 0, 0])), (2 * k + 1, f"at{k}", [x * scale for x in turn([93.0, 36.0, 7.0, 2.0, 1.0, 1.0])])]
        rows += [(1000 + 2 * k, f"below{k}", turn([1.0, 0, 0, 0, 0, 0])), (1001 + 2 * k, f"below{k}", turn([93.0, 36.0, 7.0, 2.0, 1.0, 1.0 + 4e-12]))]
    df = spark.createDataFrame([(i, v, label) for i, label, v in rows], "vec_id long, embedding array<double>, label string")
    assert {r.vec_id: r.n_links for r in embedding_dedup(df).collect()} == {i: int(i < 1000) for i, _, _ in rows}
    # In one label too, where turned vectors share a tile.
    one = df.where("vec_id < 1000").withColumn("label", F.lit("one"))
    plain = {i: np.array(v) for i, _, v in rows if i < 1000}
    want = {i: sum(j != i and float(np.add.accumulate(v * w)[-1] / (np.sqrt(np.add.accumulate(v * v)[-1]) * np.sqrt(np.add.accumulate(w * w)[-1]))) >= 0.93 for j, w in plain.items()) for i, v in plain.items()}
    assert {r.vec_id: r.n_links for r in embedding_dedup(one).collect()} == want


BODY = " ".join(f"Sentence {i} of the article says something about its matter." for i in range(8))


@pytest.mark.parametrize("page", [
    '<div class="layout ads-enabled"><article><p>{}</p></article></div>', '<div class="post comments-open"><article><p>{}</p></article></div>', '<div id="cookie-root"><article><p>{}</p></article></div>',
    '<div class="page-ad-layout"><main><p>{}</p></main></div>', '<article class="sponsored-post"><p>{}</p></article>', '<article><div class="ad-hoc-analysis"><p>{}</p></div></article>',
    '<article><div class="menu-items"><p>{}</p></div></article>', '<article><p class="comment">{}</p></article>', '<article><p>{}</p><div class="responses"><p>I disagree.</p></div></article>',
    '<article><p>{}</p><div id="ad-300x250">Buy</div><div class="ad1">Buy</div><section class="post-comments"><p>First!</p></section><div class="cookie-notice">Cookies</div></article>',
    '<article><p>{}</p><ul><li class="comment">First!</li></ul><div class="comments-area"><div class="comment-body"><p>Second!</p></div></div></article>',
])
def test_names_that_only_hold_a_word(page):
    assert main_text(page.format(BODY)) == BODY
