"""Personal data in texts, in DataFrame functions only.

Regular expressions propose spans; validators confirm them (octets of addresses, digit counts, Luhn,
mod-97); words close before a span raise its score.  Base kinds (email, ip, card, phone) are kept
whatever their score; the kinds that the method adds (iban, secret) need ``MIN_SCORE``.

Positions come from splitting a text by the pattern: pieces and matches alternate, so their lengths
add up to starts.  Patterns run on Java's engine; quantifiers are possessive where that changes no
match, so long runs neither recurse nor backtrack.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import packed_rows, unpacked_rows

MIN_SCORE = 0.7
BEFORE = 40
_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"

#: kind -> (pattern, strings of which a text must have one, words in any case as in the context; context words).
#: email, ip and phone match as their contract's patterns do.  Cards are maximal digit chains; only those
#: of 13 to 19 digits can pass, so the pattern asks for these.
KINDS: dict[str, tuple[str, tuple[str, ...], str]] = {
    "email": (rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++", ("@",), r"mail|contact|write|address"),
    "ip": (r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", (".",), r"\bip\b|host|server|addr|login"),
    "card": (r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])", (), r"card|visa|master|credit|pay|tarjeta|carte|karte"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", ("+",), r"tel|phone|call|mobile|fax|whatsapp"),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])", (), r"iban|account|konto|cuenta|compte|bank"),
    "secret": (r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]{0,64}[0-9])(?=[0-9_-]{0,64}[A-Za-z])[A-Za-z0-9_-]{20,}+", ("token", "secret", "passw", "key", "bearer"), r"(?:token|secret|passw\w*|key|bearer)[\"']?\s*[=:]?\s*[\"']?$"),
}
BASE = ("email", "ip", "card", "phone")


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Valid check digit: from the right every second digit doubled, nines cast out."""
    n = F.length(digits)
    places = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    digit = lambda i: F.substring(digits, i, F.lit(1)).cast("int")
    value = lambda i: F.when((n - i) % 2 == 0, digit(i)).otherwise(F.when(digit(i) > 4, digit(i) * 2 - 9).otherwise(digit(i) * 2))
    return F.aggregate(places, F.lit(0), lambda a, i: a + value(i)) % 10 == 0


def _mod97(m: Column) -> Column:
    """IBAN: the first four characters go last, letters count 10 to 35, the remainder is one."""
    plain = F.regexp_replace(m, " ", "")
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, F.lit(1), F.lit(4)))
    char = lambda i: F.substring(turned, i, F.lit(1))
    step = lambda a, i: F.when(char(i).between("0", "9"), a * 10 + char(i).cast("int")).otherwise(a * 100 + F.ascii(char(i)) - 55) % 97
    return F.length(plain).between(15, 34) & (F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1)


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":  # three digits besides leading zeros, so that the cast can't overflow
        part = lambda p: F.length(F.ltrim(p, F.lit("0"))) <= 3
        return F.forall(F.split(m, r"\."), lambda p: part(p) & (F.coalesce(F.substring(F.ltrim(p, F.lit("0")), 1, 3).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.length(_digits(m)).between(13, 19) & _luhn(_digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    if kind == "iban":
        return _mod97(m)
    return F.lit(True)


def _spans(text: Column, kind: str, matches: Column, pieces: Column) -> Column:
    """Validated spans of a kind: structs of kind, start, end, score."""
    none = F.expr("cast(array() as array<struct<s:int,e:int,m:string>>)")
    zero = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def add(a: Column, i: Column) -> Column:
        s = a["at"] + F.length(F.get(pieces, i))
        e = s + F.length(F.get(matches, i))
        return F.struct(e.alias("at"), F.array_append(a["out"], F.struct(s.alias("s"), e.alias("e"), F.get(matches, i).alias("m"))).alias("out"))

    found = F.aggregate(F.sequence(F.lit(0), F.size(matches) - 1), zero, add, lambda a: a["out"])
    checked = F.lit(0.3 if kind in ("ip", "card", "iban") else 0.2)

    def scored(x: Column) -> Column:
        before = F.substring(text, F.greatest(x["s"] - BEFORE, F.lit(0)) + 1, F.least(x["s"], F.lit(BEFORE)))
        near = before.rlike("(?i)" + KINDS[kind][2]) & (x["s"] > 0)
        return F.struct(F.lit(kind).alias("kind"), x["s"].alias("start"), x["e"].alias("end"), F.round(F.lit(0.45) + checked + F.when(near, 0.2).otherwise(0.0), 2).alias("score"))

    out = F.transform(F.filter(found, lambda x: _valid(kind, x["m"])), scored)
    return out if kind in BASE else F.filter(out, lambda x: x["score"] >= MIN_SCORE)


def find_spans(rows: DataFrame, text_col: str = "text") -> DataFrame:
    """rows with ``__p_<kind>``, an array of (kind, start, end, score) for each kind, empty where none."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = rows.withColumn("__p_text", text)
    empty = F.expr("cast(array() as array<struct<kind:string,start:int,end:int,score:double>>)")
    t = F.col("__p_text")
    steps: dict[str, Column] = {}
    for kind, (pattern, needs, _) in KINDS.items():
        may = t.rlike("[0-9]") if not needs else F.lit(False)
        for n in needs:
            may |= t.rlike("(?i)" + n) if n.isalpha() else F.contains(t, F.lit(n))
        steps[f"__p_m_{kind}"] = F.when(may, F.regexp_extract_all(t, F.lit(pattern), F.lit(0)))
    df = df.withColumns(steps)
    df = df.withColumns({f"__p_s_{k}": F.when(F.size(f"__p_m_{k}") > 0, F.split(t, KINDS[k][0], -1)) for k in KINDS})
    df = df.withColumns({f"__p_{k}": F.when(F.col(f"__p_s_{k}").isNotNull(), _spans(t, k, F.col(f"__p_m_{k}"), F.col(f"__p_s_{k}"))).otherwise(empty) for k in KINDS})
    return df.drop(*(f"__p_{x}_{k}" for k in KINDS for x in "ms"))


def _joined(kinds: tuple[str, ...]) -> Column:
    every = F.concat(*(F.col(f"__p_{k}") for k in kinds))
    return F.array_join(F.transform(every, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def pii_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, scores per row of docs.

    spans lists kind:start:end (code points, end exclusive), base kinds first, by start within a kind;
    scores lists their scores in that order.  Null text counts as empty; repeated rows and null ids stay; texts are searched
    whole, however long; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    df = find_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    scores = F.transform(F.concat(*(F.col(f"__p_{k}") for k in KINDS)), lambda s: s["score"].cast("string"))
    return df.select(
        "doc_id",
        *(F.size(f"__p_{k}").cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(_joined(BASE).cast("binary"), 256).alias("base_sha256"),
        _joined(tuple(KINDS)).alias("spans"),
        F.array_join(scores, ",").alias("scores"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span of text replaced by its kind in brackets; overlapping spans become one.

    Null texts stay null, empty ones empty, all other columns stay as they are, whatever their names; repeated rows stay, an empty table
    stays empty, and texts are searched whole, however long.
    """
    df = find_spans(packed_rows(docs, "text"))
    every = F.sort_array(F.transform(F.concat(*(F.col(f"__p_{k}") for k in KINDS)), lambda s: F.struct(s["start"].alias("s"), s["end"].alias("e"), s["kind"].alias("k"))))
    t = F.col("__p_text")
    zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out"))

    def add(a: Column, x: Column) -> Column:
        fresh = x["s"] >= a["at"]
        piece = F.concat(F.substring(t, a["at"] + 1, x["s"] - a["at"]), F.lit("["), F.upper(x["k"]), F.lit("]"))
        return F.struct(F.greatest(a["at"], x["e"]).alias("at"), F.when(fresh, F.array_append(a["out"], piece)).otherwise(a["out"]).alias("out"))

    clean = F.aggregate(every, zero, add, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(t, a["at"] + 1, F.length(t))))
    text = F.when(F.col("text").isNotNull(), F.when(F.size(every) > 0, clean).otherwise(F.col("text")))
    return unpacked_rows(df, docs.columns, text=text)
