import random
import re

import corpus_pipeline
from tests.llm import brute

TAGS = re.compile(r"\[(?:EMAIL|IP|CARD|PHONE|IBAN|SECRET)\]")


def test_stages_against_brute_force(spark, tmp_path):
    r = random.Random(5)
    voc = [f"word{i}" for i in range(500)]
    say = lambda n: " ".join(r.choice(voc) for _ in range(n))
    items = [(i, say(30)) for i in range(5)]
    docs = []
    for d in range(200):
        t = docs[-1][1] + " more" if d % 5 == 4 else say(r.randrange(10, 90))
        if d % 11 == 0:
            t += " " + items[d % 5][1]
        if d % 7 == 0:
            t += " mail me@site.example.com or 10.0.0.1"
        docs.append((d, t, r.choice(["en", "de", None]), r.choice(["a", "b", None]), len(t)))
    docs += [(900, None, "en", "a", None), (901, "", None, None, 0), (None, say(40), "en", "a", 1), (902, say(30) + " x " + "again and again it says the same nine words " * 30, "en", "a", 5), (903, "&& ## " * 200 + say(100), "en", "b", 6)]
    spark.createDataFrame([(*d, 7) for d in docs], "doc_id long, text string, lang string, source string, n_chars long, copies int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "decontamination", "personal_data", "source_mix"]
    docs_df, columns = spark.read.parquet(f"{tmp_path}/documents.parquet"), None
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs_df, str(tmp_path))
        columns = columns or out.columns
        assert out.columns == columns or name == "source_mix"
        docs_df = out
        seen.append([(x.doc_id, x.text) for x in out.collect()])
    quality, near, clean, private, mixed = seen
    base_ok = {(d[0], d[1]) for d in docs if not brute.op10(d[1])[-1]}
    assert set(quality) == base_ok - {(903, docs[-1][1])}
    named = [x for x in quality if x[0] is not None]
    heads = {c for _, _, c in brute.op1(named)}
    assert sorted(near, key=str) == sorted([x for x in named if x[0] in heads] + [x for x in quality if x[0] is None], key=str)
    bad = {x[0] for x in brute.op4([x for x in near if x[0] is not None], items) if x[5]}
    assert bad and sorted(clean, key=str) == sorted((x for x in near if x[0] not in bad), key=str)
    text = dict(clean)
    assert len(private) == len(clean)
    for d, t in private:
        assert brute.op7(t)[:4] == (0, 0, 0, 0)
        assert len(TAGS.findall(t)) == sum(brute.op7(text[d])[:4])
    assert set(mixed) <= set(private) and len(mixed) > len(private) / 2
    again = corpus_pipeline.run(spark, str(tmp_path))
    assert again.columns == [*columns, "copy"]
    assert sorted(((x.doc_id, x.text) for x in again.collect()), key=str) == sorted(mixed, key=str)
