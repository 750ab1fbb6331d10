"""BPE, personal data, language ID, toxicity: against the library, by hand, and on held-out rows."""
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from netlens.llm import bpe, langid, pii, queries, toxicity
from netlens.llm.common import crc_mod

SF = "/root/testdata/sf0.01"
ODD = [None, "", " ", "a", "\n\n", "é" * 50, "x " * 30_000, "<|endoftext|>", "a<|endoftext|> b", "😀 ​́", "'s 'll 1²Ⅷ中"]


def odd_rows(spark):
    """Nulls, empty and long texts, repeated rows and columns with clashing names."""
    rows = [(i if i != 3 else None, t, "ids", "spans", 7) for i, t in enumerate(ODD)] + [(0, None, "ids", "spans", 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, spans string, key int")


def test_bpe_equals_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    path = queries.vocabulary()
    lib = tokenizers.Tokenizer.from_file(path)
    rng = random.Random(5)
    parts = ["a", "B", "é", " ", "  ", "\n", "\t", "'s", "1", "中", "😀", "<|endoftext|>", "!", "\xa0", "the", "ing", "ǅ", "́"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 20))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").unionByName(
        odd_rows(spark).select(F.col("doc_id") + 1000, "text").toDF("doc_id", "text"))
    rows = bpe.decode(bpe.encode(df, path), path).join(df.withColumnRenamed("text", "source"), "doc_id").collect()
    for r in rows:
        ids = lib.encode(r["source"] or "", add_special_tokens=False).ids
        if r["doc_id"] != 1000:
            assert r["ids"] == ids
        assert r["text"] == lib.decode(r["ids"], skip_special_tokens=False)


def test_bpe_query(spark):
    tokenizers = pytest.importorskip("tokenizers")
    lib = tokenizers.Tokenizer.from_file(queries.vocabulary())
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op8_bpe(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = lib.encode(docs[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        text = lib.decode(ids, skip_special_tokens=False)
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def plain_spans(text):
    """The base kinds by their plain patterns."""
    import re
    digits = lambda s: re.sub("[^0-9]", "", s)
    tests = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(digits(s)) <= 19 and pii.luhn(digits(s))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(digits(s)) <= 15)}
    return [(k, m.start(), m.end()) for k, (p, ok) in tests.items() for m in re.finditer(p, text) if ok(m.group())]


def test_pii_base_equals_plain_patterns(spark):
    rng = random.Random(9)
    parts = ["a@b.c", "@", ".", "x_y%", "d.e", "1.2.3.4", "256.1.1.1", "4111111111111111", "4111 1111-1111 1111", "+1 (736) 555-2678",
             "+", " ", "12", "é", "0.0.0.0.0", "-", "(", "name", "@x.com@y.org", "00000000000000000"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 12))) for _ in range(3000)]
    texts += [r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    for t in texts:
        base = [(s["kind"], s["start"], s["end"]) for s in pii.find_spans(t) if s["kind"] in pii.KINDS[:4]]
        assert base == plain_spans(t), t


def test_pii_checksums_and_context():
    found = lambda t: [(s["kind"], t[s["start"]:s["end"]]) for s in pii.find_spans(t)]
    assert found("IBAN DE89 3704 0044 0532 0130 00.") == [("iban", "DE89 3704 0044 0532 0130 00")]
    assert found("DE88370400440532013000") == []
    assert found("ssn 536-90-4399") == [("ssn", "536-90-4399")]
    assert found("part 536-90-4399") == [] and found("ssn 666-90-4399") == []
    assert found("amex card 378282246310005") == [("short_card", "378282246310005")]
    assert found("order 378282246310005") == []
    assert pii.redact("call +1 (736) 555-2678 or a@b.co", pii.find_spans("call +1 (736) 555-2678 or a@b.co")) == "call [PHONE] or [EMAIL]"


def test_pii_long_runs_are_linear():
    import time
    start = time.time()
    pii.find_spans("1" * 200_000 + " " + "a" * 200_000 + " " + "+" * 200_000 + "1." * 100_000)
    assert time.time() - start < 5


def test_pii_odd_rows(spark):
    out = pii.digest_columns(pii.detect(odd_rows(spark))).collect()
    assert len(out) == len(ODD) + 1 and all(r["spans"] == "" for r in out)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pii.digest_columns(pii.detect(empty)).collect() == []


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = queries.op7_language(spark, SF).join(docs, "doc_id").where("held_out").collect()
    right = sum(r["lang_pred"] == r["lang"] for r in rows)
    assert len(rows) > 150 and right / len(rows) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_cases(spark):
    train = spark.createDataFrame([("the cat and the dog", "en"), ("der hund und die katze", "de"), ("x", None), (None, "fr")],
                                  "text string, lang string")
    model = langid.train(train)
    assert model[0] == ["de", "en"]
    got = {r["doc_id"]: r for r in langid.predict(odd_rows(spark), model).collect()}
    assert got[0]["lang_pred"] == got[1]["lang_pred"] == got[4]["lang_pred"] == "und"
    assert got[None]["lang_pred"] in ("de", "en")          # "a" has a letter
    none = langid.train(train.where("lang = 'xx'"))
    assert {r["lang_pred"] for r in langid.predict(odd_rows(spark), none).collect()} == {"und"}


def test_language_does_not_depend_on_partitioning(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one, many = langid.train(docs.coalesce(1)), langid.train(docs.repartition(9))
    assert one[0] == many[0] and (one[1] == many[1]).all()


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = queries.op1_toxicity(spark, sf).join(labels, "doc_id").where("held_out").collect()
    hit = sum(r["predicted"] for r in rows if r["toxic"] == 1)
    false = sum(r["predicted"] for r in rows if r["toxic"] == 0)
    assert hit > 0.8 * sum(r["toxic"] for r in rows) and false <= 5
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_toxicity_cases(spark):
    docs = odd_rows(spark)
    none = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"), lambda k: crc_mod(k, 5) == 4)
    assert {r["score"] for r in toxicity.score(docs, none).collect()} == {0.0}
    text = [(i, "what a lovely day" if i % 3 else "you blarg idiot", None) for i in range(90)]
    train = spark.createDataFrame(text, "doc_id long, text string, mean string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)] + [(5, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(train, labels, lambda k: crc_mod(k, 5) == 4)
    got = [(r["doc_id"], r["score"]) for r in toxicity.score(train, model).collect()]
    assert all((s >= 0.5) == (i % 3 == 0) for i, s in got)
    odd = toxicity.score(docs, model).collect()
    assert len(odd) == len(ODD) + 1 and all(0 <= r["score"] <= 1 for r in odd)
    reverse = toxicity.score(train.where("doc_id < 0"), model).collect()
    assert reverse == []


def test_toxicity_share_of_classes(spark, monkeypatch):
    """Scores keep the true share of the classes when the curve is fitted on a sample of one."""
    rng = random.Random(8)
    vague = [f"{a}{b}" for a in ("bla", "dor", "mip", "kel") for b in ("rg", "st", "no", "ta")]
    rows = []
    for i in range(4000):
        toxic = int(rng.random() < 0.1)
        rows.append((i, " ".join(rng.choice(vague[6:] if rng.random() < (0.6 if toxic else 0.4) else vague[:8]) for _ in range(8)), toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")

    def mean():
        model = toxicity.train(docs, docs, lambda k: crc_mod(k, 5) == 4)
        return toxicity.score(docs, model).agg(F.avg("score")).first()[0]

    whole = mean()
    monkeypatch.setattr(toxicity, "MAX_FIT_ROWS", 80)
    assert whole == pytest.approx(0.1, abs=0.02) and mean() == pytest.approx(whole, abs=0.03)


def test_toxicity_counts_every_row(spark, monkeypatch):
    """An expression of one labelled row is known, however many rows there are; the
    distributed ratios equal those in memory, whether words are broadcast or joined."""
    from collections import Counter

    import numpy as np
    monkeypatch.setattr(toxicity, "MAX_TRAIN_ROWS", 40, raising=False)
    rng = random.Random(4)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(5, 12)))
    plain, bad = [word("abcdelmnost") for _ in range(60)], [word("xyzqwkvhg") for _ in range(200)]
    rows = [(i, " ".join(rng.choices(plain, k=6) + [bad[i // 5]] * (i % 5 == 0)), int(i % 5 == 0)) for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    fold = lambda key: F.coalesce(key % 4 == 3, F.lit(False))
    model = toxicity.train(docs, docs, fold)
    seen = [bad[i // 5] for i, _, y in rows if y and i % 4 != 3]
    new = [word("xyzqwkvhg") for _ in range(len(seen))]
    ask = spark.createDataFrame([(i, "the " + w) for i, w in enumerate(seen + new)], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(ask, model).collect()}
    assert len(got) == len(seen + new) and sum(got[i] > 0.9 for i in range(len(seen))) == len(seen)
    monkeypatch.setattr(toxicity, "COMMON_WORDS", 20)
    again = {r["doc_id"]: r["score"] for r in toxicity.score(ask, model).collect()}
    assert again == pytest.approx(got, abs=1e-9)
    grams = [Counter(), Counter()]
    for i, t, y in rows:
        if i % 4 != 3:
            for w in t.split():
                grams[y].update(toxicity.grams(w))
    names = sorted(grams[0].keys() | grams[1].keys())
    want = toxicity.build(names, *(np.array([c[g] for g in names], float) for c in grams))
    vocabulary = spark.createDataFrame([(w, 1) for w in plain + seen + new + ["", "é"]], "item string, n long")
    for r in toxicity.word_ratios(vocabulary, model.ratios).collect():
        assert r["ratio"] == pytest.approx(want.words([r["item"]])[0], abs=1e-4)


def test_kneser_ney_is_a_distribution():
    """The class ratios come from proper probabilities: a brute-force Kneser-Ney agrees."""
    import math
    from collections import Counter

    import numpy as np
    counts = {0: Counter({"ab": 5, "abc": 2, "bca": 1}), 1: Counter({"abd": 4, "ab": 1})}
    grams = [Counter(), Counter()]
    for k in (0, 1):
        for w, n in counts[k].items():
            for g in toxicity.grams(w):
                grams[k][g] += n
    names = sorted(grams[0].keys() | grams[1].keys())
    ratios = toxicity.build(names, np.array([grams[0][g] for g in names], float), np.array([grams[1][g] for g in names], float))
    pairs = {}
    for length in range(toxicity.ORDER, 1, -1):
        for g in {g[-length:] for g in names if len(g) >= length}:
            pairs.setdefault(g[1:], set()).add(g)
    letters = {g for g in pairs if len(g) == 1}

    def shared(g):
        q = shared(g[1:]) if len(g) > 1 else 1 / (len(letters) + 1)
        beside = [x for x in pairs if len(x) == len(g) and x[:-1] == g[:-1]]
        total = sum(len(pairs[x]) for x in beside)
        return (max(len(pairs.get(g, ())) - 0.75, 0) + 0.75 * len(beside) * q) / total if total else q

    def prob(k, g):
        beside = {x: n for x, n in grams[k].items() if x[:-1] == g[:-1]}
        total, q = sum(beside.values()), shared(g[1:])
        return (max(beside.get(g, 0) - 0.75, 0) + 0.75 * len(beside) * q) / total if total else q

    for w in ("ab", "abc", "abd", "ba", "zz"):
        want = sum(math.log(prob(1, g) / prob(0, g)) for g in toxicity.grams(w))
        assert ratios.words([w])[0] == pytest.approx(want, abs=1e-5)
