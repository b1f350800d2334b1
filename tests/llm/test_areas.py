import math
import random

import numpy as np

from tessera.llm import areas as A
from tessera.llm.subject_models import BEARS, MOST, Models, counts, words

TERMS = {"law": "court judge plaintiff verdict statute".split(), "sport": "goal referee match stadium league".split(), "software": "compiler debugger linker stack thread".split()}
FILL = "the page now shows every row next to this one and keeps it for a while".split()
SUBJECTS = [("law", "courts"), ("sport", "games"), ("software", "programming as such, with no other area of use"), (None, None)]


def text(rnd, *subjects, n=30):
    out = []
    for i in range(n):
        out.append(rnd.choice(TERMS[rnd.choice(subjects)]) if subjects and i % 3 == 0 else rnd.choice(FILL))
    return " ".join(out)


def test_words():
    assert words("rotate_court_docket parseHTTPReply größer &amp; x­yz") == ["rotate", "court", "docket", "parse", "http", "reply", "größer", "xyz"]
    assert words("grÃ¶ÃŸe".encode("cp1252", "ignore").decode("cp1252")) == ["größe"]


def test_held_out(spark):
    rnd = random.Random(5)
    truth, rows, labels = {}, [], []
    for i in range(600):
        subjects = rnd.choice([("law",), ("sport",), ("software",), ("law", "sport"), ()])
        truth[i] = set(subjects)
        rows.append((i, text(rnd, *subjects), "x"))
        if i < 400:
            said = subjects if rnd.random() > 0.1 else (rnd.choice(list(TERMS)),)
            labels += [(i, s, 0) for s in said] + [(i, s, 0) for s in said[:1]]
    rows += [(9001, None, "x"), (9002, "", "x"), (9003, "law " * 1, "x"), (9004, text(rnd, "law", n=3000), "x")]
    labels += [(9001, "law", 0), (None, "law", 0), (5, None, 0), (77_777, "law", 0)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, subject string")
    table = spark.createDataFrame(labels, "doc_id long, subject string, text int")
    models = A.train(documents, table, spark.createDataFrame(SUBJECTS, "subject string, description string"))
    got: dict = {}
    for r in A.areas(documents, models).collect():
        got.setdefault(r["doc_id"], set()).add(r["subject"])
    held = [i for i in range(400, 600)]
    hit = sum(len(got.get(i, set()) & truth[i]) for i in held)
    both = sum(len(got.get(i, set())) + len(truth[i]) for i in held)
    assert 2 * hit / both > 0.8, (2 * hit / both, models.share, models.density)
    assert got[9004] == {"law"} and not got.keys() & {9001, 9002}


def test_none(spark):
    documents = spark.createDataFrame([(1, "court")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, subject string")
    subjects = spark.createDataFrame(SUBJECTS, "subject string, description string")
    assert A.train(documents, labels, subjects) is None
    assert A.areas(documents, None).count() == 0


def test_model_is_interpolated():
    own = counts([["court", "judge"]] * 5)
    m = Models.fit(["law", "sport"], [own, counts([["goal", "judge"]] * 5)], counts([["court", "judge", "goal"]] * 50), 150)
    gained = m.gains(["court", "judge", "unseen", "court"])
    # each word saves the difference of its cross-entropies, here under the law model alone
    saved = [m.one["court"], m.two["court", "judge"], m.one["court"]]
    assert gained[1] == 0 and np.isclose(gained[0], sum(min(r[0], MOST) for r in saved if r[0] >= math.log(BEARS)))


def test_acceptance_by_share_and_density():
    m = Models(["law", "sport", "art"], {}, {}, share=0.3, density=0.1)
    assert m.accept(np.array([10.0, 8.0, 1.0]), 100) == ["law", "sport"]
    assert m.accept(np.array([10.0, 8.0, 1.0]), 1000) == [] == m.accept(np.array([1.5, 0, 0]), 3)
    assert m.accept(np.array([10.0, 0, 0]), 90) == ["law"]
