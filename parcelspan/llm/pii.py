"""Personal data: regular expressions propose spans, checksums confirm them, nearby words move the score.

Everything is built from SQL functions. A pattern's matches and the text between them come from one
`regexp_extract_all` and one `split` with the same pattern, so positions are running sums of lengths. All
repetitions are possessive and every start is anchored to the start of a run, so that time is linear in the
text however long a run of digits or letters is; both rewritings find the matches of the plain patterns.

Kinds and their rules:

email, ip, card, phone  base kinds; they are always kept when their own check passes (parts up to 255; 14 to
                        19 digits and Luhn; 10 to 15 digits), whatever the words around them
iban                    country, two check digits, 11 to 30 letters or digits, in one piece or in groups of four;
                        kept if the number is 1 modulo 97
tax_id                  123-45-6789 with valid parts; has no checksum, so a context word has to be near
local_phone             ten digits in the usual (123) 456-7890 shape without a country code; likewise

A proposal's score is that of its kind, plus that of its checksum, plus `CONTEXT` if one of the kind's words
stands in the `NEAR` code points before it. It is kept from `KEEP` on. Spans of different kinds may overlap,
those of one kind do not; an added span that lies inside a base span is dropped.

Null texts count as empty. Rows are never merged: a repeated row gets its own result. Columns other than
the id and the text are carried along unless they have the name of a result column, which then wins.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
BLOCK = 1024
NEAR, CONTEXT, KEEP = 40, 0.4, 0.7
SHORTEST = 5  # a@b.c
AHEAD = -(-NEAR // SHORTEST)


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    score: float
    checked: float = 0.0  # added when the checksum is right; without it, a span that has one is dropped
    context: str = ""


KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.9,
         context="mail|e-mail|email|contact|write"),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+", 0.6, 0.2, "ip|host|server|address"),
    Kind("card", r"(?<![0-9])[0-9](?:[ -]?+[0-9])++", 0.3, 0.5, "card|visa|credit|payment|tarjeta|karte|carte"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", 0.5, 0.3, "phone|tel|call|mobile|telefon|llamar"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?+[A-Z0-9]{4}+){2,7}+(?: ?+[A-Z0-9]{1,3}+)?+(?![A-Za-z0-9])",
         0.3, 0.5, "iban|account|konto|cuenta|compte"),
    Kind("tax_id", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", 0.4,
         context="ssn|social security|tax id|taxpayer"),
    Kind("local_phone", r"(?<![0-9+])(?<!\+[0-9] )(?:\([0-9]{3}\) ?|[0-9]{3}[-.])[0-9]{3}[-.][0-9]{4}(?![0-9-])", 0.4,
         context="phone|tel|call|mobile"),
)


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def mod97(text: Column) -> Column:
    """Remainder of an account number: the first four characters go last, letters count from 10."""
    bare = F.replace(text, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(bare, F.lit(5)), F.substr(bare, F.lit(1), F.lit(4)))
    return F.aggregate(
        F.split(turned, ""),
        F.lit(0),
        lambda rest, c: F.when(c == "", rest)
        .when(c <= "9", (rest * 10 + F.ascii(c) - 48) % 97)
        .otherwise((rest * 100 + F.ascii(c) - 55) % 97),
    )


def valid(kind: str, text: Column) -> Column:
    """The check of a kind, as a column on the matched text."""
    if kind == "ip":
        return F.forall(F.split(text, r"\."), lambda part: F.regexp_replace(part, "^0+(?=[0-9])", "").rlike(
            "^([0-9]|[0-9]{2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        # The right number of digits first: luhn_check refuses nothing by length.
        plain = digits(text)
        return F.when(F.length(plain).between(14, 19), F.call_function("luhn_check", plain)).otherwise(False)
    if kind == "phone":
        return F.length(digits(text)).between(10, 15)
    if kind == "iban":
        return (F.length(F.replace(text, F.lit(" "), F.lit(""))).between(15, 34)) & (mod97(text) == 1)
    return F.lit(True)


def running(steps: Column) -> Column:
    """Sums of the elements before each, in blocks, so that long arrays cost little more than their length."""
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / BLOCK).cast("int")),
        lambda b: F.slice(steps, b * BLOCK + 1, F.lit(BLOCK)),
    )

    def cumulative(values: Column, start: Column) -> Column:
        first = F.struct(start.alias("at"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(
            values,
            first,
            lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")),
            lambda acc: acc["out"],
        )

    total = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("bigint"), lambda s, x: s + x))
    starts = cumulative(total, F.lit(0).cast("bigint"))
    return F.flatten(F.zip_with(blocks, starts, lambda b, s: cumulative(b, s)))


def matches(text: Column, kind: Kind) -> Column:
    """All matches of a kind's pattern. A sign that every match holds is looked for first."""
    sign = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}
    some = sign.get(kind.name, text.rlike("[0-9]"))
    return F.when(some, F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))


def proposals(found: Column, between: Column, kind: Kind) -> Column:
    """Valid matches: array of (start, end, before)."""
    gaps = F.slice(between, F.lit(1), F.size(found))
    # The ends of what each match closes: the nearest few of them and the gap hold the `NEAR` code points before a match,
    # earlier matches included. Every match has `SHORTEST` code points or more.
    last = lambda text: F.substr(text, F.greatest(F.lit(1), F.length(text) - NEAR + 1))
    tails = F.zip_with(gaps, found, lambda gap, hit: last(F.concat(gap, hit)))
    some = lambda all_, i: F.array_join(F.slice(all_, F.greatest(F.lit(1), i - AHEAD + 1), F.least(i, F.lit(AHEAD))), "")
    # As an element of an array they are made once, not once a match.
    tails = F.transform(F.array(tails), lambda all_: F.transform(all_, lambda _, i: some(all_, i)))[0]
    steps = F.zip_with(gaps, found, lambda gap, hit: (F.length(gap) + F.length(hit)).cast("bigint"))
    spans = F.zip_with(
        F.arrays_zip(running(steps).alias("at"), gaps.alias("gap"), tails.alias("tail")),
        found,
        lambda place, hit: F.struct(
            (place["at"] + F.length(place["gap"])).alias("start"),
            (place["at"] + F.length(place["gap"]) + F.length(hit)).alias("end"),
            F.lower(last(F.concat(place["tail"], last(place["gap"])))).alias("before"),
            valid(kind.name, hit).alias("ok"),
        ),
    )
    empty = F.array().cast("array<struct<start:bigint,end:bigint,before:string,ok:boolean>>")
    return F.when(F.size(found) > 0, F.filter(spans, lambda s: s["ok"])).otherwise(empty)


def scored(spans: Column, kind: Kind) -> Column:
    rank = [k.name for k in KINDS].index(kind.name)
    near = rf"\b(?:{kind.context})\b"
    score = lambda s: F.lit(kind.score + kind.checked) + F.when(s["before"].rlike(near), CONTEXT).otherwise(0.0)
    with_score = F.transform(
        spans,
        lambda s: F.struct(
            s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind.name).alias("kind"),
            F.least(F.lit(1.0), F.round(score(s), 2)).alias("score"),
        ),
    )
    return with_score if kind.name in BASE_KINDS else F.filter(with_score, lambda s: s["score"] >= KEEP)


def find_pii(df: DataFrame, text: str = "text") -> DataFrame:
    """Add `pii`: array of (start, rank, end, kind, score), ordered by start and then by kind as listed.

    Positions are code points, ends exclusive.
    """
    whole, hit, gap = F.coalesce(F.col(text), F.lit("")), "_pii_hit_{}".format, "_pii_gap_{}".format
    # Matches and the text between them are columns of their own: each is made once and read several times.
    found = df.withColumns({hit(k.name): matches(whole, k) for k in KINDS})
    found = found.withColumns({gap(k.name): F.when(F.size(hit(k.name)) > 0, F.split(whole, k.pattern, -1)) for k in KINDS})
    spans = {k.name: scored(proposals(F.col(hit(k.name)), F.col(gap(k.name)), k), k) for k in KINDS}
    found = found.withColumns(
        {
            "_pii_base": F.concat(*[spans[k] for k in BASE_KINDS]),
            "_pii_added": F.concat(*[v for k, v in spans.items() if k not in BASE_KINDS]),
        }
    )
    inside = lambda a: F.exists("_pii_base", lambda b: (b["start"] <= a["start"]) & (a["end"] <= b["end"]))
    outside = F.filter("_pii_added", lambda a: ~inside(a))
    extra = ["_pii_base", "_pii_added", *[f(k.name) for k in KINDS for f in (hit, gap)]]
    return found.withColumn("pii", F.array_sort(F.concat("_pii_base", outside))).drop(*extra)


def listed(spans: Column) -> Column:
    """Spans as kind:start:end, joined with commas."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """Replace every span found by [KIND]; of overlapping spans the one that starts first is replaced, then
    those that start after its end."""
    spans = F.aggregate(
        F.col("pii"),
        F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out")),
        lambda acc, s: F.when(
            s["start"] >= acc["at"],
            F.struct(
                s["end"].alias("at"),
                F.concat(
                    acc["out"],
                    F.array(
                        F.substr(F.col(text), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")),
                        F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")),
                    ),
                ).alias("out"),
            ),
        ).otherwise(acc),
        lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr(F.col(text), (acc["at"] + 1).cast("int"))),
    )
    return find_pii(df, text).withColumn(text, F.when(F.size("pii") > 0, spans).otherwise(F.col(text)))


def pii_digest(documents: DataFrame) -> DataFrame:
    """Per document: counts of the base kinds, the hash of the base spans, all spans and their scores."""
    spans = find_pii(documents.select("doc_id", "text"))
    base = F.filter("pii", lambda s: s["kind"].isin(*BASE_KINDS))
    count = lambda kind: F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("bigint")
    return spans.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("pii")).alias("spans"),
        F.array_join(F.transform("pii", lambda s: F.format_number(s["score"], 2)), ",").alias("scores"),
    )
