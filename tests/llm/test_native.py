"""Mixing, personal data and quality rules against brute force, with the odd cases of each."""

import random

import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tidemark.llm import mixing, pii, quality

ODD = [
    None, "", " ", "\n\n", "x", "a b\tc", "a@b.c_d@e.f", "x@y@z.com me.me+1@mail-1.example.com. ok", "1.2.3.4.5.6.7.8", "999.1.1.1 01.002.3.255 256.1.1.1 00000000000001.2.3.4",
    "99999999999999999999.1.1.1", "4111 1111-1111 1111", "4111  1111 1111 1111", "4111111111111111 4012888888881881", "a4111111111111111b", "12 34 56 " * 3000, "7" * 5000, "a" * 50000 + "@b.co",
    "+1 (743) 555-3824 +12 3", "+1+2 345 678 901", "+99 99 99 99 99 99 99 99 99", "é😀 a.b@c.de 😀 10.0.0.1", "tel: +49 30 1234567, card 4111-1111-1111-1111",
    "a.b." * 400 + "@x", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8", "0000000000000000", "5-5-5-5-5-5-5-5-5-5-5-5-5-5", "x@a..b", "x@-.-", "@a.b", "a@b.c.", "\x0b1.1.1.1\x0c", "1.1.1.1.", "..1.1.1.1..2.2.2.2",
]


def texts(seed, n=150):
    r = random.Random(seed)
    frags = ["a@b.co", "1.2.3.4", "300.1.2.3", "4111111111111111", "4111 1111 1111 1111", "+1 (555) 555-5555", " ", "\n", "-", "é", "😀", "7", "12", ".", "@", "+", "word", "#", "*", "x_y"]
    return ["".join(r.choice(frags) for _ in range(r.randrange(60))) for _ in range(n)]


def test_pii_base_spans(spark):
    rows = list(enumerate([*ODD, *texts(1)])) + [(None, "a@b.co"), (3, "a@b.co"), (3, "a@b.co")]
    docs = spark.createDataFrame([(*r, "n_email") for r in rows], "doc_id long, text string, spans string")
    got = sorted(((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in pii.pii_report(docs).collect()), key=str)
    assert got == sorted(((d, *brute.op7(t)) for d, t in rows), key=str)
    assert pii.pii_report(docs.limit(0)).count() == 0


def test_pii_added_spans_and_redaction(spark):
    iban, secret = "GB82 WEST 1234 5698 7654 32", "fc22f42429fef2ebde85e081b172bc127a2eef28"
    text = f'pay to {iban} or GB83 WEST 1234 5698 7654 32, token = "{secret}" mail é a@b.co, {secret}'
    docs = spark.createDataFrame([(1, text), (2, None), (3, "+1 (743) 555-3824, (10.0.0.1)")], "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.pii_report(docs).collect()}
    spans = [tuple(x.split(":")) for x in rows[1].spans.split(",")]
    assert [(k, text[int(a) : int(b)]) for k, a, b in spans] == [("email", "a@b.co"), ("iban", iban), ("secret", secret)]
    assert rows[2].spans == "" and rows[2].n_email == 0
    red = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert red[1] == f'pay to [IBAN] or GB83 WEST 1234 5698 7654 32, token = "[SECRET]" mail é [EMAIL], {secret}'
    assert red[2] is None and red[3] == "[PHONE], ([IP])"


def test_pii_secrets_by_words_in_any_case(spark):
    secret = "fc22f42429fef2ebde85e081b172bc127a2eef28"
    heads = ["Token: ", "Secret = ", "Password: ", "DB_PASSWORD=", "Key: ", "tOkEn=", "BEARER ", "token = "]
    docs = spark.createDataFrame([(i, f"see {h}{secret} end") for i, h in enumerate(heads)], "doc_id long, text string")
    spans = {x.doc_id: x.spans for x in pii.pii_report(docs).collect()}
    assert spans == {i: f"secret:{4 + len(h)}:{4 + len(h) + len(secret)}" for i, h in enumerate(heads)}
    assert {x.doc_id: x.text for x in pii.redact(docs).collect()} == {i: f"see {h}[SECRET] end" for i, h in enumerate(heads)}


def test_quality_counts(spark):
    r = random.Random(4)
    words = ["a", "b", "c", "dd", "é", "😀", "#$", "&"]
    many = [" ".join(r.choice(words[: r.randrange(1, 9)]) for _ in range(r.randrange(80))).replace(" dd ", "\n") for _ in range(120)]
    block = " ".join(f"w{i}" for i in range(30))
    rows = list(enumerate([*ODD, *many, f"{block} x {block}", f"{block}\n" * 700, "    x", " ".join(f"v{i}" for i in range(25000))]))
    docs = spark.createDataFrame([(*x, None if x[0] % 7 == 0 else "en", None if x[0] % 5 == 0 else "s", 1) for x in rows], "doc_id long, text string, lang string, source string, kept int")
    out = quality.quality_report(docs).collect()
    got = sorted((x.doc_id, x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) for x in out)
    assert got == sorted((d, *brute.op10(t)) for d, t in rows)
    assert not any(x.kept and x.base_failed for x in out)
    assert quality.quality_report(docs.limit(0)).count() == 0


def test_quality_thresholds_adapt(spark):
    prose = [(i, " ".join(f"word{(i * 31 + k * 7) % 97}" for k in range(40 + i % 20)), "en", "a", 0) for i in range(60)]
    code = [(100 + i, " ".join(f"x{(i * 31 + k * 7) % 97}& | <y>" for k in range(40)), "en", "b", 0) for i in range(60)]
    odd = [(200, code[0][1], "en", "a", 0), (201, prose[0][1], None, None, 0)]
    docs = spark.createDataFrame(prose + code + odd, "doc_id long, text string, lang string, source string, n_words int")
    kept = {r.doc_id for r in quality.quality_filter(docs).collect()}
    assert kept == {r[0] for r in prose + code} | {201}  # symbols are normal in b and stand out in a
    assert quality.quality_filter(docs).columns == docs.columns


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_mixing(spark, seed):
    r = random.Random(seed)
    names = ["b", "a", "Z", "é", "z\U0001f600", None, "tiny"]
    rows = [(i, "w " * r.randrange(1, 400), r.choice(names[:6]) if r.random() < 0.7 else "a", 0) for i in range(4000)] + [(9001, "w", "tiny", 0), (9002, None, "a", 0), (None, "w w", "a", 0), (5, "w", "b", 0), (5, "w", "b", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, target int")
    out = mixing.mix_report(docs, seed=seed).collect()
    assert len(out) == len(rows)
    sizes = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = brute.mix_targets(sizes)
    source = {}
    for d, t, s, _ in rows:
        source.setdefault((d, len((t or "").split())), s)
    taken = dict.fromkeys(sizes, 0)
    for x in out:
        s = source[(x.doc_id, x.size)]
        assert x.source_size == sizes[s] and x.target == pytest.approx(want[s], abs=1e-5) and x.taken <= 3 * x.size
        taken[s] += x.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 500 + 0.02 * want[s], (s, taken[s], want[s])
    again = mixing.mix_report(docs.repartition(7), seed=seed).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))
    mixed = mixing.mix(docs, seed=seed)
    assert mixed.columns == [*docs.columns, "copy"]
    words = {x.source: x.w for x in mixed.groupBy("source").agg(F.sum(F.size(F.filter(F.split("text", " "), lambda w: w != ""))).alias("w")).collect()}
    assert {k: v for k, v in taken.items() if v} == {k: v for k, v in words.items() if v}


def test_mixing_keeps_texts_that_share_id_and_source(spark):
    rows = [(None, f"null{i} " * (1 + i % 5), "a", "en") for i in range(40)] + [(7, f"seven{i} w", "b", "en") for i in range(20)] + [(8, "same w", "b", "de"), (8, "same w", "b", "en")]
    rows += [(100 + i, "w " * 30, "c", "en") for i in range(20)] + [(9, "twice", "a", "en")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    out = [tuple(x) for x in mixing.mix(docs).collect()]
    assert sorted(map(str, out)) == sorted(str(tuple(x)) for x in mixing.mix(docs.repartition(7)).collect())
    copies = {x[:4]: sum(y[:4] == x[:4] for y in out) for x in out}
    assert all(n <= 3 * rows.count(x) for x, n in copies.items())
    count = lambda xs: sorted((str(d), w, n) for d, w, n in xs)
    per_row = [(x.doc_id, x.size, x.copies) for x in mixing.mix_report(docs).collect()]
    assert sum(n for *_, n in per_row) == len(out)
    alone = count((d, w, n) for d, w, n in per_row if n and d != 9)
    assert count((x[0], len(x[1].split()), n) for x, n in copies.items() if x[0] != 9) == alone
    assert len(copies) > 60


def test_mixing_empty_and_all_blank(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert [(x.size, x.source_size, x.target, x.taken) for x in mixing.mix_report(docs).collect()] == [(0, 0, 0.0, 0)] * 2
    assert mixing.mix_report(docs.limit(0)).count() == 0


def test_mix_keeps_rows_that_differ_anywhere(spark):
    """Microseconds, nulls beside empty texts, columns named as the operators' own."""
    rows = [(1, "a b c", "s", f"2024-01-01 00:00:00.00000{k % 3}", None if k % 2 else "", k % 2) for k in range(6)] + [(2, "d", None, None, None, 5), (None, None, "s", None, "", 6), (3, "", "t", None, "", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, t string, note string, Copy int").withColumns({"t": F.col("t").cast("timestamp"), "n": F.col("t").cast("timestamp_ntz"), "row": F.lit(1), "digest": F.lit("x"), "a.b": F.lit(2)})
    out = mixing.mix(df)
    assert out.columns == [*df.columns, "copy_"]
    got = [tuple(x) for x in out.collect()]
    base = {tuple(x) for x in df.collect()}
    assert len(base) == len(rows) and {x[:-1] for x in got} <= base
    assert len(got) == sum(x.copies for x in mixing.mix_report(df).collect())
    assert len({x[3:6] for x in got if x[0] == 1}) > 3  # 5 of these 6 rows at least are taken
    assert max(x[-1] for x in got) <= 3 and len(set(got)) == len(got)
    assert sorted(map(repr, got)) == sorted(map(repr, map(tuple, mixing.mix(df).collect())))
    assert mixing.mix(df.limit(0)).collect() == [] and mixing.mix_report(df.limit(0)).collect() == []


def test_filters_take_any_column_name(spark):
    say = lambda k: " ".join(f"w{k}x{i}" for i in range(30))
    rows = [(k, say(k) + " a@b.co", "en", "s") for k in range(5)] + [(5, None, None, None), (6, "", "en", "s"), (7, "few", "en", "s"), (7, say(7), "en", "s"), (7, say(7), "en", "s"), (8, "long " * 200000, "en", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({c: F.lit(1) for c in ("__q_words", "__q_kept", "__q_lang", "__p_text", "__p_m_email", "row", "x.y")})
    kept = quality.quality_filter(df)
    assert kept.columns == df.columns and sorted(x.doc_id for x in kept.collect()) == [0, 1, 2, 3, 4, 7, 7]
    red = pii.redact(df)
    assert red.columns == df.columns
    assert sorted((x.doc_id, x.text or "") for x in red.collect()) == sorted((d, (t or "").replace("a@b.co", "[EMAIL]")) for d, t, *_ in rows)
    for f in (quality.quality_filter, pii.redact, quality.quality_report, pii.pii_report):
        assert f(df.limit(0)).collect() == []


def test_repeated_words_are_bounded_by_the_language(spark):
    """A source of which most rows repeat each word doesn't lift its own limit; one of another language does."""
    r = random.Random(8)
    say = lambda n: " ".join(f"w{r.randrange(3000)}" for _ in range(n))
    again = lambda n: " ".join(" ".join([f"w{r.randrange(3000)}"] * r.randrange(4, 7)) for _ in range(n))
    good = [(i, say(60), "en", f"s{i % 4}") for i in range(200)]
    bad = [(1000 + i, again(12), "en", "junk") for i in range(30)] + [(2000, again(12), "en", "s1")]
    own = [(3000 + i, again(12), "zz", "drums") for i in range(30)]
    docs = spark.createDataFrame([*good, *bad, *own, (4000, None, "en", "junk"), (4001, "", None, None)], "doc_id long, text string, lang string, source string")
    kept = {x.doc_id for x in quality.quality_filter(docs).collect()}
    assert kept == {x[0] for x in good} | {x[0] for x in own}
