import random
from pathlib import Path

import pytest

from calorgrid.llm import reading

DATA = Path("/root/testdata/sf0.01")

EASY = "dog cat sun hill red box park tree bus map road pond kite flag wall gate".split()
HARD = "hysteresis quantile residual emissivity stratified commensurability heteroscedastic anisotropy provenance covariance".split()


def sentence(rng, words, n):
    return "The " + " ".join(rng.choice([rng.choice(words), "and the", "of the", "is"]) for _ in range(n)) + ". "


def corpus(seed=0):
    rng = random.Random(seed)
    docs, hard = [], set()
    for k in range(400):
        if k % 3 == 0:
            hard.add(k)
            docs.append((k, "".join(sentence(rng, HARD + EASY[:2], 14) for _ in range(5))))
        else:
            docs.append((k, "".join(sentence(rng, EASY + HARD[:1], 6) for _ in range(6))))
    docs += [(1000, None), (1001, ""), (1002, "  \n "), (1003, "hysteresis"), (1004, "1;2;3\n" * 300), (1005, "Die Hysterese der Residuen ist nicht mit dem Quantil und der Kovarianz zu verwechseln. " * 5), (1006, "溫差約為十二度。" * 40 + " The hysteresis of the quantile."), (1007, "[00:42:00] stage=e rc=0 px=284246\n" * 50)]
    return docs, hard


def run(spark, docs, ratings, lang="lang"):
    """One label in ten is wrong or missing."""
    label = lambda k: ["de", None, "EN", "en-GB"][k % 4] if k % 10 == 0 else "de" if k in (1005, 1006, *range(2000, 2050)) else "en"
    d = spark.createDataFrame([(*x, 1.0, True, label(x[0])) for x in docs], "doc_id long, text string, level double, prose boolean, lang string")
    r = spark.createDataFrame(ratings, "doc_id long, reading_level int")
    return {x["doc_id"]: x for x in reading.reading_levels(d, r, lang=lang).collect()}


GERMAN = [(2000 + k, "Die Hysterese der Residuen ist nicht mit dem Quantil und der Kovarianz zu verwechseln. " * (2 + k % 3)) for k in range(50)]


def test_demanding_documents_are_found(spark):
    docs, hard = corpus()
    rng = random.Random(1)
    ratings = [(k, rng.choice([4, 5]) if k in hard else rng.choice([1, 2, 3])) for k, _ in docs[:200:2]]
    ratings = [(k, 6 - v if i % 20 == 0 else v) for i, (k, v) in enumerate(ratings)] + [(1, None), (2, 99), (1004, 5)]
    got = run(spark, docs + GERMAN, ratings)
    assert {k for k, x in got.items() if x["demanding"]} == hard
    assert all(not got[k]["prose"] and got[k]["level"] is None for k in range(1000, 1008))
    assert not any(got[k]["prose"] for k, _ in GERMAN)
    assert all(1 <= x["level"] <= 5 for x in got.values() if x["prose"])


def test_repeats_long_texts_and_no_ratings(spark):
    docs, hard = corpus(3)
    long = (5000, docs[0][1] * 300)
    got = run(spark, [*docs, long, long], [(k, 5 if k in hard else 1) for k in range(100)])
    assert got[5000]["demanding"]
    assert len(run(spark, docs[:20], [])) == 20
    assert len(run(spark, docs[:20], [], None)) == 20


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
def test_levels_agree_with_ratings_held_out(spark):
    """Fitted on the ratings of even documents, judged by those of odd ones, which agree among themselves to about 96 %."""
    docs, ratings = (spark.read.parquet(str(DATA / f"{t}.parquet")) for t in ("documents", "reading_labels"))
    got = {r["doc_id"]: r["demanding"] for r in reading.reading_levels(docs, ratings.where("doc_id % 2 = 0")).collect()}
    held = [(r["doc_id"], r["reading_level"]) for r in ratings.where("doc_id % 2 = 1 and reading_level between 1 and 5").collect()]
    right = [got[k] == (v >= 4) for k, v in held]
    hard = [got[k] for k, v in held if v >= 4]
    assert len(right) > 100 and sum(right) / len(right) > 0.92
    assert sum(hard) / len(hard) > 0.85


def test_empty(spark):
    assert run(spark, [], [(1, 3)]) == {}
