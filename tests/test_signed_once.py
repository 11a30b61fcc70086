"""Near duplicates and their agreement sign each text once, and give what the parts give one after the other."""

import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import minhash


def test_agreement_in_classes_signs_texts_once(spark, monkeypatch):
    r = random.Random(9)
    base = [" ".join("".join(r.choice("abcdeé中") for _ in range(5)) for _ in range(40)) for _ in range(4)]
    texts = [t.replace(" ", r.choice([" ", "\u3000", "\n\t"])) + r.choice(["", "  ", " end", " END."]) for t in base for _ in range(5)] + [None, "", "short"]
    docs = [(i if i % 7 else None, t) for i, t in enumerate(texts, 1)] + [(2, base[3] + " other"), (3, "short")]  # null and repeated ids
    docs = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    classes = minhash.near_duplicates(docs).where("doc_id <> class_id")
    apart = minhash.compare(docs, classes.select(F.col("doc_id").alias("a"), F.col("class_id").alias("b")))
    want = sorted(map(tuple, apart.collect()), key=repr)
    signed, sign = [], minhash.signed_texts
    monkeypatch.setattr(minhash, "signed_texts", lambda *a: signed.append(1) or sign(*a))
    monkeypatch.setattr(minhash, "signatures", lambda *_: pytest.fail("texts were signed apart"))
    assert sorted(map(tuple, minhash.agreement_in_classes(docs).collect()), key=repr) == want and len(want) > 10
    assert signed == [1]
