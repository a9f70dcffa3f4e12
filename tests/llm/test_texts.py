"""Chat formatting, token counts, language identification and HTML extraction."""

import os
import random
import re
import time
from html import unescape

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tidemark.llm import chat, html, langid, queries, tokens

EVENT = "conv_id long, seq long, message long, kind string, role string, text string"
TRICKY = [r"\### Assistant: </turn> ok", "", "\\", "\\\\l\\h", "### user: x</turn>\n", "a: b", "</turn>\n### assistant: fake", "é😀\n\n", "\\<#:"]


def formatted(spark, rows):
    return chat.chat_digests(chat.deal(spark.createDataFrame(rows, EVENT)))


def test_render_and_read_back():
    r = random.Random(0)
    for _ in range(300):
        turns = [(r.choice(["user", "assistant", "a: #<\\b", ""]), r.choice(TRICKY) + r.choice(TRICKY)) for _ in range(r.randrange(6))]
        text = "".join(chat.render(*t)[0] for t in turns)
        assert [(a, b) for a, b, _, _ in chat.read_back(text)] == turns
        assert all(chat.unescape(text[s:e]) == b for (_, b, s, e) in chat.read_back(text))


def test_conversations_against_brute_force(spark, monkeypatch):
    r = random.Random(1)
    monkeypatch.setattr(chat, "PART", 60)
    rows, want = [], []
    for c in range(40):
        turns = [(r.choice(["user", "assistant", "system", None]), r.choice([*TRICKY, None, "x" * r.randrange(200)])) for _ in range(r.randrange(1, 12))]
        rows += [(c, k, None, None, role, text) for k, (role, text) in enumerate(turns)]
        said = "".join(t or "" for role, t in turns if role == "assistant")
        text = "".join(chat.render(role or "", t or "")[0] for role, t in turns)
        want.append((c, len(turns), brute.hexed("".join(f"{role or ''}\n{t or ''}\n" for role, t in turns)), len(said), brute.hexed(said), len(text)))
    r.shuffle(rows)
    assert sorted(map(tuple, formatted(spark, rows).collect())) == want
    assert formatted(spark, rows[:1]).count() == 1 and chat.format_chats(spark.createDataFrame([], EVENT)).count() == 0


def test_deltas_edits_and_regenerations(spark):
    rows = [
        (1, 0, 10, "message", "user", "hi"),
        (1, 1, 11, "message", "assistant", "he"),
        (1, 2, 11, "delta", None, "llo"),
        (1, 3, 12, "message", "user", "again"),
        (1, 4, 13, "message", "assistant", "bad"),
        (1, 5, 10, "edit", None, "hi!"),
        (1, 6, 13, "regenerate", None, "go"),
        (1, 7, 13, "delta", None, "od"),
        (None, 0, None, "delta", "assistant", "alone"),
    ]
    parts = chat.format_chats(spark.createDataFrame(rows, EVENT)).collect()
    got = {p.conv_id: [(a, b) for a, b, _, _ in chat.read_back(p.formatted)] for p in parts}
    assert got == {1: [("user", "hi!"), ("assistant", "hello"), ("user", "again"), ("assistant", "good")], None: [("assistant", "alone")]}


def told(spark, rows):
    parts = chat.format_chats(spark.createDataFrame([(1, *x) for x in rows], EVENT)).collect()
    return [(a, b) for p in sorted(parts, key=lambda p: p.part) for a, b, _, _ in chat.read_back(p.formatted)]


def test_order_of_numbered_and_unnumbered_messages(spark):
    rows = [(0, None, "message", "user", "q1"), (1, 5, "message", "assistant", "a"), (2, 5, "delta", None, "1"), (3, None, "message", "user", "q2"), (4, 6, "message", "assistant", "a2"), (5, None, "delta", "user", "late"), (6, 5, "edit", None, "A1")]
    assert told(spark, rows) == [("user", "q1"), ("assistant", "A1"), ("user", "q2"), ("assistant", "a2"), ("user", "late")]


def test_regeneration_drops_what_followed(spark):
    rows = [(0, 1, "message", "user", "q"), (1, 2, "message", "assistant", "old"), (2, 3, "message", "user", "gone"), (3, None, None, "user", "gone too"), (4, 2, "regenerate", None, "ne"), (5, 2, "delta", None, "w"), (6, 4, "message", "user", "next"), (7, 3, "edit", None, "still gone")]
    assert told(spark, rows) == [("user", "q"), ("assistant", "new"), ("user", "next")]
    again = rows + [(8, 2, "regenerate", "assistant", "newest"), (9, 5, "message", "user", "last")]
    assert told(spark, again) == [("user", "q"), ("assistant", "newest"), ("user", "last")]
    assert told(spark, [(0, 1, "message", "user", "q"), (0, 1, "message", "user", "q"), (0, None, "message", "user", "b"), (0, None, "message", "user", "a")]) == [("user", "a"), ("user", "b"), ("user", "q"), ("user", "q")]


def test_turns_as_a_log_fold_back(spark):
    r = random.Random(7)
    turns = [(c, k, r.choice(["user", "assistant", "system", None]), r.choice([*TRICKY, None, "😀é" * 9, "xyz"])) for c in (1, 2, None) for k in range(15)]
    turns += [(1, 3, "user", "twice"), (1, 3, "user", "twice"), (1, None, "assistant", "first")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    log = chat.as_log(df)
    assert {x.kind for x in log.collect()} == {"message", "delta", "edit", "regenerate"} and log.count() == 3 * len(turns)
    plan = chat.chat_digests(log)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    got = {}
    for p in sorted(chat.format_chats(log).collect(), key=lambda p: p.part):
        got.setdefault(p.conv_id, []).extend((a, b) for a, b, _, _ in chat.read_back(p.formatted))
    low = lambda x: (x is not None, x if x is not None else 0)
    text = lambda x: (x is not None, x or "")
    want = {}
    for c, k, role, t in sorted(turns, key=lambda x: (low(x[0]), low(x[1]), text(x[2]), text(x[3]))):
        want.setdefault(c, []).append((role or "", t or ""))
    assert got == want


def test_token_counts_equal_the_librarys(spark, monkeypatch):
    r = random.Random(2)
    odd = [None, "", " ", "   \n\n\t x", "a" * 30000, "<|endoftext|>", "x<|endoftext|>y", "I'm we'll o'clock 'S", "１２³½ Ⅷ", "日本語 текст مرحبا", "é́   x", "\U0001f600\U0001f1e9\U0001f1ea", "\0\x01", "don't   stop  ", "_a_b__c", "1234567 89,5", "ﬁ ǆ ɐ", "Ᲊ Ƛ"]
    frags = ["word", " word", "  ", "\n", "'s", "12", ".", "Ünï", "\t", "xyzzyq", " Qwrtz", "ß", "…"]
    texts = odd + ["".join(r.choice(frags) for _ in range(r.randrange(80))) for _ in range(200)]
    monkeypatch.setattr(tokens, "CACHE", 20)
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "a b", 1), (3, "dup", 1), (3, "dup", 1)], "doc_id long, text string, n_tokens int")
    lib = tokens.load_tokenizer("byte_bpe_50k.json")
    count = lambda t: len(lib.encode(t or "", add_special_tokens=False))
    got = {(x.doc_id, x.n_bytes): (x.n_tokens, x.over_limit) for x in tokens.count_tokens(df, limit=50).collect()}
    for i, t in enumerate(texts):
        assert got[(i, len((t or "").encode()))] == (count(t), count(t) > 50), repr(t)
    assert got[(None, 3)] == (2, False) and tokens.count_tokens(df).count() == len(texts) + 3
    assert tokens.count_tokens(df.limit(0)).count() == 0


SAY = {"en": "the of and that with this from which there would their about".split(), "de": "der die und nicht werden eine über können schön für auch nach".split(), "fr": "le les des être avec pour où même très français été dans".split()}


def test_language_held_out_accuracy(spark):
    r = random.Random(3)
    rows = [(i, " ".join(r.choice(SAY[lang]) for _ in range(r.randrange(4, 40))), lang) for i in range(900) for lang in [r.choice(sorted(SAY))]]
    rows += [(2000, None, "en"), (2001, "", "en"), (2002, "123 --- !!", "de"), (2003, "für " * 20000, None), (None, "the and of that", "fr")]
    df = spark.createDataFrame([(*x, 0.5) for x in rows], "doc_id long, text string, lang string, score double")
    out = {x.doc_id: x for x in langid.identify(df).collect()}
    assert len(out) == len(rows)
    truth = {d: lang for d, _, lang in rows}
    held = [d for d in range(900) if out[d].held_out]
    assert 100 < len(held) < 260 and sum(out[d].lang_pred == truth[d] for d in held) >= 0.97 * len(held)
    assert [out[d].lang_pred for d in (2000, 2001, 2002)] == ["und"] * 3 and out[2003].lang_pred == "de"
    assert all(0 <= x.score <= 1 for x in out.values())
    swapped = df.withColumn("lang", F.when(langid.held_out("doc_id"), F.lit("xx")).otherwise(F.col("lang")))
    assert {x.doc_id: x.lang_pred for x in langid.identify(swapped).collect()} == {d: x.lang_pred for d, x in out.items()}


def test_language_without_training_rows(spark):
    df = spark.createDataFrame([(1, "hello there", None)], "doc_id long, text string, lang string")
    assert [(x.lang_pred, x.score) for x in langid.identify(df).collect()] == [("und", 0.0)]
    assert langid.identify(df.limit(0)).count() == 0


def test_many_labels(spark, monkeypatch):
    """Labels beyond the bound get no model; the most common ones do, and share the characters."""
    monkeypatch.setattr(langid, "MAX_LANGS", 3)
    monkeypatch.setattr(langid, "ALL_CHARS", 30_000)
    r = random.Random(4)
    rows = [(i, " ".join(r.choice(SAY[lang]) for _ in range(20)), lang) for i in range(600) for lang in [r.choice(sorted(SAY))]] + [(700 + i, "the of", f"rare{i}") for i in range(40)]
    out = {x.doc_id: x.lang_pred for x in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert set(out.values()) == set(SAY) and sum(out[d] == lang for d, _, lang in rows[:600]) >= 590


def test_kneser_ney_sums_to_one():
    assert langid.fit({"x": ["abcab abd cab" * 5], "y": ["zzz yyy"]})["langs"] == ["x", "y"]
    codes, owner = langid.folded(["abcab abd cab" * 5], langid.fold_table())
    grams = langid.keys(codes, 4)[langid.scored(owner)]
    model = langid.KneserNey(*np.unique(grams, return_counts=True))
    every = ((grams[0] >> np.uint64(16)) << np.uint64(16)) | np.arange(1, 200, dtype=np.uint64)
    assert 0.3 < model.prob(every).sum() <= 1.0 + 1e-9


def test_kneser_ney_against_brute_force():
    """Probabilities of seen and unseen grams by the interpolation's definition on plain dictionaries; each context's sum to 1."""
    from collections import Counter, defaultdict

    text = "the cat sat on the mat and the hat on the cat that sat "
    codes, owner = langid.folded([text, "a cat "], langid.fold_table())
    grams, counts = np.unique(langid.keys(codes, langid.ORDER)[langid.scored(owner)], return_counts=True)
    model = langid.KneserNey(grams, counts)
    apart = lambda g, n: tuple(int(g) >> 16 * k & 0xFFFF for k in range(n - 1, -1, -1))
    level = {4: Counter({apart(g, 4): int(c) for g, c in zip(grams, counts)})}
    for n in (3, 2, 1):
        level[n] = Counter(g[1:] for g in level[n + 1])  # distinct left neighbours
    after = {n: defaultdict(list) for n in level}
    for n, grams_ in level.items():
        for g, c in grams_.items():
            after[n][g[:-1]].append(c)

    def prob(g):
        if not g:
            return 1 / langid.ALPHABET
        n, lower = len(g), prob(g[1:])
        if g[:-1] not in after[n]:
            return lower
        c = after[n][g[:-1]]
        return (max(level[n][g] - langid.DISCOUNT, 0) + langid.DISCOUNT * len(c) * lower) / sum(c)

    letters = sorted({x for g in level[4] for x in g} | {ord("z"), ord("q")})
    r = random.Random(2)
    asked = [tuple(r.choice(letters) for _ in range(4)) for _ in range(500)] + sorted(level[4])
    wanted = np.array([sum(x << 16 * (3 - k) for k, x in enumerate(g)) for g in asked], np.uint64)
    assert model.prob(wanted) == pytest.approx([prob(g) for g in asked], rel=1e-12)
    unseen = (langid.ALPHABET - len(letters)) / langid.ALPHABET  # symbols that no text has, each by the last level alone
    for context in [g[:-1] for g in asked[::40]]:
        rest = prob((*context, 0x2FFF)) * langid.ALPHABET
        assert sum(prob((*context, x)) for x in letters) + unseen * rest == pytest.approx(1)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header>Site</header><nav><ul><li><a href=/a>Menu</a></li></ul></nav><div class="cookie-notice">Accept</div>
<article><h1>Head &amp; line</h1><p>First&nbsp;<b>bold<br>text</p><div class="ad">Buy</div><p>Second <a href=x>link</a>&#33;
<aside>Side</aside><form><input><button>Send</button></form><section id="comments"><p>Nice!</p></section></article>
<!-- c --><footer>&copy; 2020</footer></body></html>"""


@pytest.mark.parametrize(
    "page, text",
    [
        (PAGE, "Head & line First bold text Second link!"),
        ("", ""),
        ("plain only", "plain only"),
        ("<article><p>cut &am", "cut &am"),
        ("<article><p>one<p>two</article><p>out", "one two"),
        ("<main>a<script>x</script>b</main>", "a b"),
        ("<article><p>x</p", "x"),
        ("<article><table><tr><td>1<td>2</table></article>", "1 2"),
        ("<nav>only menu</nav>", ""),
        ('<article><p>own</p></article><article class="comment"><p>theirs</p></article>', "own"),
        ('<div class="page has-sidebar"><article class="no-header">text</article><div id=Sidebar>x</div></div>', "text"),
        ("<article><p>" + "w " * 50000 + "</p></article>", ("w " * 50000).strip()),
        ("<div>" * 3000 + "deep", "deep"),
        ("<p>a <- b</p> c <3", "a <- b c <3"),
        ("<p>one</p><!-- two <p>three</p>", "one"),
    ],
)
def test_extract(page, text):
    assert html.extract(page) == text


def test_clusters_without_an_article():
    body = "".join(f"<p>{'long prose with many words ' * 8}{i}</p>" for i in range(4))
    page = "<body>" + "".join(f"<p><a href=x><b>l{i}</b></a></p>" for i in range(8)) + body + "".join(f"<p><a href=x><i>m{i}</i></a></p>" for i in range(8))
    out = html.extract(page)
    assert all(f"words {i}" in out for i in range(4)) and "l0" not in out and "m7" not in out


def test_clusters_with_a_teaser_in_an_article():
    body = "".join(f"<div>{'long prose with many words ' * 8}{i}</div>" for i in range(6))
    teaser = "<article class=card><h2>Next</h2><p><a href=x>Read this too</a></article>"
    for page in (f"<body>{teaser}{body}", f"<body>{body}{teaser}"):
        out = html.extract(page)
        assert all(f"words {i}" in out for i in range(6))


def test_regions_with_the_dense_text_keep_their_short_lines():
    body = "".join(f"<p>{'long prose with many words ' * 8}{i}</p><p>Of.</p>" for i in range(6))
    out = html.extract(f"<body><div><b>outside</b></div><article><h1>Head</h1>{body}</article><div>also out</div>")
    assert out.startswith("Head long") and out.count("Of.") == 6 and "out" not in out


def test_density_drops_lines_within_an_article():
    body = "".join(f"<p>{'long prose with many words ' * 8}{i}</p>" for i in range(5)) + "<p>Of.</p>"
    links = "<ul>" + "".join(f"<li><a href=/{k}>more of number {k}</a></li>" for k in range(6)) + "</ul>"
    said = "<div><b>Joe</b> <i>says</i> <span>nice!</span></div><div><b>Ann</b> <i>says</i> <span>so so</span></div>"
    for tag in ("article", "div"):
        page = f"<body><div><a href=/>home</a></div><{tag}><h1>Head</h1>{body}{links}{said}</{tag}></body>"
        out = html.extract(page)
        assert out.startswith("Head long") and out.endswith("Of.") and "Joe" not in out and "more of" not in out
        assert "Joe" in html.extract(page, cut=-1.0)  # the threshold drops them, nothing else does


def test_regions_that_no_tag_or_class_gives_away():
    """Pages of plain div elements, with menus, teasers and readers' lines around the text, against what was planted."""
    r = random.Random(23)
    voc = "tree river stone winter bread light summer garden window morning silver letter".split()
    say = lambda n: " ".join(r.choice(voc) for _ in range(n)).capitalize() + "."
    right = blind = 0
    for _ in range(200):
        paras = [say(r.randrange(25, 90)) for _ in range(r.randrange(4, 12))]
        paras.insert(r.randrange(1, len(paras)), say(2))
        menu = "".join(f"<div><a href=/{k}>{r.choice(voc)}</a></div>" for k in range(r.randrange(4, 12)))
        teasers = "".join(f"<div><b>{say(2)}</b> <i>{r.choice(voc)}</i> <a href=/{k}>{say(3)}</a></div>" for k in range(r.randrange(2, 6)))
        said = "".join(f"<div><b>{r.choice(voc)}</b> <i>says</i> <span>{say(3)}</span></div>" for _ in range(r.randrange(1, 5)))
        text = "".join(f"<p>{p}</p>" for p in paras)
        page = f"<body><div>{menu}</div><div>{text}{teasers}{said}</div><div><div>{say(2)}</div><div>{say(3)}</div></div></body>"
        right += html.extract(page) == " ".join(paras)
        blind += html.extract(page, cut=-1.0) == " ".join(paras)
    assert right == 200 and blind == 0


def planted_page(r):
    """A page in one of several layouts, and the text that was planted in it."""
    voc = "tree river stone winter bread light summer garden window morning silver letter".split()
    say = lambda n: " ".join(r.choice(voc) for _ in range(n)).capitalize() + "."
    head, paras = say(6), [say(r.randrange(25, 90)) for _ in range(r.randrange(3, 12))]
    paras.insert(r.randrange(1, len(paras)), say(2))
    menu = "".join(f"<li><a href=/{k}>{r.choice(voc)}</a></li>" for k in range(8))
    tags = ("<p>", r.choice(["</p>", ""]))
    body = f"<h1>{head}</h1>" + "".join(f"{tags[0]}{p}{tags[1]}" for p in paras)
    kind = r.choice(["article", "main", "div", "bare", "nested"])
    if kind == "bare":
        inner = f"<div><ul>{menu}</ul></div>{body}<div><ul>{menu}</ul></div>"
    elif kind == "nested":
        inner = f"<div><ul>{menu}</ul><div><div id=c1>{body}</div></div></div><div><a href=/x>more</a></div>"
    else:
        inner = f"<nav><ul>{menu}</ul></nav><div class=ad>{say(30)}</div><{kind} id=c1>{body}</{kind}><section class='user comments'><p>{say(40)}</p></section>"
    return f"<html><head><title>{say(5)}</title><script>var x='<p>{say(50)}</p>'</script></head><body><header>{say(9)}</header>{inner}<footer>{say(20)}</footer></body></html>", " ".join([head, *paras])


def test_planted_texts_in_several_layouts():
    r = random.Random(11)
    pages = [planted_page(r) for _ in range(300)]
    assert [html.extract(page) for page, _ in pages] == [text for _, text in pages]


def test_the_query_against_patterns(spark):
    """The table's pages have one article each, without regions to skip in it."""
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables here")
    pages = {x.page_id: x.html for x in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for x in queries.op9_html_extract(spark, sf).collect():
        inner = re.search("<article>(.*?)</article>", pages[x.page_id], re.S)[1]
        want = " ".join(unescape(re.sub("<[^>]*>", " ", re.sub("</?b>", "", inner))).split())
        assert (x.text, x.n_chars) == (want, len(want))


@pytest.mark.parametrize("piece", ["<div>", "<p>", "<b>", "</i>", "<i><div><b>", "<!--", "<a ", "<a x='", "<![CDATA[", "<?", "</", "<p a=b ", "&am", "<script>"])
def test_time_is_linear_in_the_page(piece):
    began = time.time()
    html.extract(piece * 20000)
    assert time.time() - began < 10


def test_pages_table(spark):
    df = spark.createDataFrame([(1, "u", PAGE, 5), (2, None, None, 5), (None, "u", "<p>x", 5), (1, "u", PAGE, 5)], "page_id long, url string, html string, n_chars int")
    got = sorted(((x.page_id, x.url, x.n_chars) for x in html.extract_pages(df).collect()), key=str)
    assert got == sorted([(1, "u", 40), (1, "u", 40), (2, None, 0), (None, "u", 1)], key=str)
    assert html.extract_pages(df.limit(0)).count() == 0
