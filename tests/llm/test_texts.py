"""Operators on texts against brute force, round trips and held-out accuracy."""

import os
import random
import re
import shutil

import pytest
from pyspark.sql import functions as F

from facetspark.llm import leakage, packing, pii
from facetspark.llm.pii_labels import labelled_rows

ITEM = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi."


def _docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("docs", F.lit("clash")).withColumn("item_id", F.lit(5))


def _grams(text, n=12):
    w = leakage.words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def test_leakage(spark):
    words = ITEM.rstrip(".").split()
    texts = [ITEM, ITEM.upper().replace(" ", " --\n"), "x " + "_".join(words[2:14]) + " y", " ".join(words[:11]), " ".join(words[:6] + ["word"] + words[6:]), "", None, "the " * 30000 + ITEM + " tail", ITEM]
    docs = _docs(spark, list(enumerate(texts)))
    items = spark.createDataFrame([(1, ITEM), (2, "too short"), (3, None), (4, " ".join(words[3:] * 2))], "item_id long, item_text string")
    got = leakage.leaked(docs, items, "doc_id", "text", "item_id", "item_text").collect()
    want = {(d, i.item_id) for d, t in enumerate(texts) for i in items.collect() if _grams(t) & _grams(i.item_text)}
    assert {(r.doc_id, r.item_id) for r in got} == want and (2, 1) in want and (3, 1) not in want
    runs = {(r.doc_id, r.item_id): r for r in got}
    assert runs[7, 1].run_words == 16 and runs[7, 1].doc_word == 30000 and runs[2, 1].run_words == 12 and runs[2, 1].item_word == 2
    near = {(r.doc_id, r.item_id) for r in leakage.leaked(docs, items, "doc_id", "text", "item_id", "item_text", slack=1).collect()}
    assert near >= want and (4, 1) in near
    assert leakage.leaked(docs.limit(0), items, "doc_id", "text", "item_id", "item_text").count() == 0
    assert leakage.leaked(docs, items.limit(0), "doc_id", "text", "item_id", "item_text").count() == 0


def test_stored_index_answers_another_test_set(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(leakage, "BLOCK_CHARS", 400)
    monkeypatch.setattr(leakage, "TRIED", 50)
    r = random.Random(5)
    few = [f"w{i}" for i in range(12)]
    texts = [" ".join(r.choice(few) for _ in range(r.choice([0, 5, 40, 90]))) for _ in range(60)] + [None]
    docs = _docs(spark, list(enumerate(texts)))
    docs.select("doc_id", "text").write.parquet(str(tmp_path / "docs"))
    leakage.build_index(spark.read.parquet(str(tmp_path / "docs")), "doc_id", "text").write.parquet(str(tmp_path / "index"))
    shutil.rmtree(tmp_path / "docs")  # from here on only the index is left
    index = spark.read.parquet(str(tmp_path / "index"))
    assert index.count() > 3
    for seed in (1, 2):
        s = random.Random(seed)
        rows = [(i, " ".join(s.choice(few) for _ in range(30))) for i in range(20)] + [(20, " ".join(texts[3 * seed : 3 * seed + 3])), (21, None)]
        items = spark.createDataFrame(rows, "item_id long, item_text string")
        got = {(x.doc_id, x.item_id) for x in leakage.find_leaks(index, items, "item_id", "item_text", n=4).collect()}
        assert got == {(d, i) for d, t in enumerate(texts) for i, q in rows if _grams(t, 4) & _grams(q, 4)} and got


@pytest.mark.skipif(not os.path.exists(packing.TOKENIZER), reason="no tokenizer file")
def test_packing(spark):
    texts = [None, "", "one two three"] + [f"word {i} " * (i % 90 + 1) for i in range(400)] + ["long text " * 3000, "long text " * 3000]
    docs = _docs(spark, list(enumerate(texts))).repartition(9)
    got = packing.containers(docs, "doc_id", "text", 512).collect()
    enc, bins, pieces = packing.tokenizer(packing.TOKENIZER), {}, {}
    for r in got:
        bins.setdefault(r.bin, []).append(r)
        pieces.setdefault(r.doc_id, []).append(r)
    for d, t in enumerate(texts):
        n = len(enc.encode_ordinary(t)) if t else 0
        mine = sorted(pieces[d], key=lambda r: r.piece)
        assert sum(r.n_tokens for r in mine) == n and len(mine) == max(1, -(-n // 512))
        assert [r.start_token for r in mine] == [512 * k for k in range(len(mine))]
    assert all(sum(r.n_tokens for r in b) == b[0].bin_tokens <= 512 for b in bins.values())
    total = sum(r.n_tokens for r in got)
    assert len(bins) <= 1.06 * total / 512 + 1
    assert packing.containers(docs.limit(0), "doc_id", "text").count() == 0


@pytest.mark.skipif(not os.path.exists(packing.TOKENIZER), reason="no tokenizer file")
def test_packing_of_repeated_rows_and_many_open(spark, monkeypatch):
    docs = _docs(spark, [(1, "long text " * 3000), (1, "long text " * 3000)]).repartition(1)
    by_bin = {}
    for r in packing.containers(docs, "doc_id", "text", 512).collect():
        by_bin.setdefault(r.bin, []).append(r.n_tokens)
    assert all(sum(n) <= 512 for n in by_bin.values())
    monkeypatch.setattr(packing, "CARRY", 20)
    texts = [f"word {i} " * (60 if i % 2 else 90) for i in range(300)]  # two large ones never fit, a large and a small one do
    docs = _docs(spark, list(enumerate(texts))).repartition(8)
    got = packing.containers(docs, "doc_id", "text", 310).collect()
    bins = {r.bin: r.bin_tokens for r in got}
    assert sorted(r.doc_id for r in got) == list(range(300)) and max(bins.values()) <= 310
    assert len(bins) <= 1.15 * sum(bins.values()) / 310 + 2  # two small ones that met at first keep a large one out


def test_best_fit_leaves_what_cannot_fit():
    bins = packing.best_fit([(6, [(1, 0, 0, 6)])] * 5 + [(4, [(2, 0, 0, 4)])] * 2, 10)
    assert sorted(u for u, _ in bins) == [6, 6, 6, 10, 10]


def test_personal_data_held_out():
    test = labelled_rows(500, seed=99)
    found = pii.mentions([t for t, _ in test], pii.field())
    got, want = ({(i, *m) for i, ms in enumerate(x) for m in ms} for x in (found, [m for _, m in test]))
    assert len(got & want) / len(want) > 0.9 and len(got & want) / len(got) > 0.9


#: Written by hand, not by the generator; [kind|mention]. The first set was seen before the last label lines were added.
BY_HAND = """
Yesterday [person|John Smith] phoned from [phone|020 7946 0958] about the boiler.
You can reach [person|Petra Müller] under [phone|+49 89 636 48018] until noon.
Our shop: [address|12 rue de Rivoli, 75004 Paris], open daily.
Robert's cousin [person|Robert Johnson] keeps bees.
Mail [email|j.doe@uni-something.edu] and copy [email|r.roe (at) mailbox (dot) org].
The plot above shows that Linear Models beat Random Forests on Small Data.
She wrote "see Chapter Four of Great Expectations" on the board.
His SSN, [idnum|123-45-6789], was printed on the form.
pass the salt; 42 apples; version 3.11.4 of Python was used
[person|María del Carmen Ruiz], NIF [idnum|12345678Z], firmó ayer.
[person|Dr]
Sent from the office of [person|Angela Whitcombe] at [address|221B Baker Street, London NW1 6XE].
lr=0.001, batch_size=64, epochs=20, seed=20240101
user_id,name,email
17,[person|Kofi Mensah],[email|kofi.mensah@example.com]
[person|李小龙]的电话是[phone|13812345678]。
El pedido va a [address|Calle Mayor 5, 28013 Madrid].
raise ValueError("Expected Float Tensor")
New York and Los Angeles were the two largest cities in 2010.
Call [phone|(212) 555-0187] or [phone|1-800-555-0199] today.
"""


#: Written when the field was frozen; nothing was changed on its account, and nothing may be.
FRESH = """
The keys are with [person|Harriet Blythe], flat above the bakery.
Invoice to [address|48 Willow Lane, Bristol BS6 7QT] please.
Ring [person|Tom Ashby] on [phone|01273 555 014] after six.
my new mail is [email|harriet_b@postbox.net]
Frau [person|Ilse Bergmann] wohnt jetzt in der [address|Rosenstraße 14, 80331 München].
Reisepass [idnum|C01234567], ausgestellt 2019
[person|Jean-Luc Moreau] a appelé le [phone|+33 6 12 34 56 78].
Contactar con [person|Lucía Ferrer] ([email|lferrer@correo.es])
NIE [idnum|X1234567L] del solicitante
请打电话给[person|张伟明]，号码 [phone|13900001111]。
user [email|s.okoro@mail.example.org] logged in 3 times
The Great Barrier Reef lies off Queensland.
Support Vector Machines and Decision Trees were tuned on 5 folds.
id=88213, total=1 204 553 rows, 12.5 s
Meet at [address|9 Elm Street, Springfield, IL 62704] at noon.
from collections import OrderedDict, Counter
SSN [idnum|987-65-4321] belongs to [person|Dana K. Whitlock]
"""


def hand_written(said=BY_HAND):
    rows = []
    for line in said.strip().split("\n"):
        text, marks, last = "", [], 0
        for m in re.finditer(r"\[(\w+)\|([^]]+)\]", line):
            text += line[last : m.start()]
            marks.append((m.group(1), len(text), len(text) + len(m.group(2))))
            text, last = text + m.group(2), m.end()
        if line != "[person|Dr]":
            rows.append((text + line[last:], marks))
    return rows


@pytest.mark.parametrize("said", [BY_HAND, FRESH])
def test_personal_data_written_by_hand(said):
    rows = hand_written(said)
    found = pii.mentions([t for t, _ in rows], pii.field())
    got, want = ({(i, *m) for i, ms in enumerate(x) for m in ms} for x in (found, [m for _, m in rows]))
    print("missed", [(k, rows[i][0][s:e]) for i, k, s, e in sorted(want - got)], "wrong", [(k, rows[i][0][s:e]) for i, k, s, e in sorted(got - want)])
    assert len(got & want) / len(want) > 0.6 and len(got & want) / len(got) > 0.6


@pytest.mark.parametrize("said, kind", [("Ivo Wendholt", "person"), ("tamsin.brenquist@tidelab.test", "email"), ("+44 7700 900912", "phone")])
def test_personal_data_on_long_lines(said, kind):
    texts = ["Contact: Anna Kowal, " + "some words of no use " * k + f"and then reach {said} or " + "more of the same " * 40 for k in range(0, 90, 7)]
    found = pii.mentions(texts, pii.field())
    assert sum((kind, t.index(said), t.index(said) + len(said)) in f for t, f in zip(texts, found)) >= 0.9 * len(texts)


def test_addresses_run_over_lines():
    said = ["17 Maple Avenue\nPortland\nOR 97201", "Flat 3,\n80 Church Road,\nLeeds LS1 4AP", "Hauptstraße 12a\n50667 Köln"]
    for a in said:
        text = f"x = 1\n\nPlease send it to\n{a}\n\nThen we go on.\n"
        assert ("address", text.index(a), text.index(a) + len(a)) in pii.mentions([text], pii.field())[0]


def test_personal_data_table(spark):
    text = "Author: Tamsin Brenquist <tamsin.brenquist@tidelab.test>\n" + "x = 1\n" * 20000 + "Interview notes: Ivo Wendholt, born abroad, ID 956-41-8228, lives at 169 Old Kiln Rd., Ostwick QX19 6ZZ, reachable on +44 7700 900912.\n"
    docs = _docs(spark, [(1, text), (2, None), (3, ""), (4, "%timeit user@host_matrix  # matrix product"), (5, text)]).withColumn("__id", F.lit(0))
    got = pii.find(docs, "doc_id", "text").collect()
    said = sorted((r.pii_kind, text[r.start_pos : r.end_pos]) for r in got if r.id == 1)
    assert said == sorted([("person", "Tamsin Brenquist"), ("email", "tamsin.brenquist@tidelab.test"), ("person", "Ivo Wendholt"), ("idnum", "956-41-8228"), ("address", "169 Old Kiln Rd., Ostwick QX19 6ZZ"), ("phone", "+44 7700 900912")])
    assert {r.id for r in got} == {1, 5}
    masked = {r.doc_id: r.masked for r in pii.mask(docs, "text", "masked").collect()}
    assert masked[2] is None and masked[3] == "" and masked[4].startswith("%timeit user@")
    assert masked[1].startswith("Author: <PERSON> <<EMAIL>>\nx = 1\n") and masked[1].endswith("ID <IDNUM>, lives at <ADDRESS>, reachable on <PHONE>.\n")
    assert pii.find(docs.limit(0), "doc_id", "text").count() == 0
