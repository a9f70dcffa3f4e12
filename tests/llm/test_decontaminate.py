import random

from tests.llm import brute
from tidemark.llm import decontaminate


def tables(seed):
    r = random.Random(seed)
    voc = [f"w{i}" for i in range(40)] + ["É", "Über", "x1", "THE"]
    say = lambda n, v=voc: " ".join(r.choice(v) for _ in range(n))
    items = [(i, say(r.randrange(1, 40))) for i in range(60)] + [(100, None), (101, "..."), (7, say(12)), (102, "w1 w2"), (103, "same same same same same same same same same same same same same")]
    docs = []
    for d in range(300):
        t = say(r.randrange(0, 80))
        for _ in range(r.randrange(3)):
            w = (r.choice(items)[1] or "").split()
            a = r.randrange(len(w) + 1)
            t += ", " + "-".join(w[a : a + r.randrange(4, 20)]).upper() + "; " + say(3)
        docs.append((d, t))
    docs += [(900, None), (901, ""), (902, "same " * 40), (903, "w1-W2"), (904, "w1" * 3000), (5, "w1 w2"), (5, "w1 w2")]
    return docs, items


def test_against_brute_force(spark):
    for seed in (0, 1):
        docs, items = tables(seed)
        df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, n_words int")
        bench = spark.createDataFrame(items, "item_id long, text string")
        want = brute.op4(docs, items)
        assert any(w[5] for w in want) and not all(w[5] for w in want)
        for block in (decontaminate.BLOCK_WORDS, 400):
            assert sorted(map(tuple, decontaminate.contamination_report(df, bench, block).collect())) == want
            kept = decontaminate.decontaminate(df, bench, block)
            assert kept.columns == df.columns
            assert sorted(r.doc_id for r in kept.collect()) == sorted(w[0] for w in want if not w[5])


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, "c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert sorted((str(r.doc_id), r.n_words, r.contaminated) for r in decontaminate.contamination_report(docs, none).collect()) == [("1", 2, False), ("None", 1, False)]
    assert decontaminate.contamination_report(docs.limit(0), none).count() == 0
