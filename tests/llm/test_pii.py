"""Personal data against a plain Python version of the same rules."""

import hashlib
import re

from pyspark.sql import functions as F

from parcelspan.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def plain(text: str) -> list[tuple[int, int, str, int]]:
    out = []
    for rank, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            number = re.sub("[^0-9]", "", m.group())
            ok = {
                "email": True,
                "ip": all(int(x) <= 255 for x in m.group().split(".")) if kind == "ip" else True,
                "card": 14 <= len(number) <= 19 and luhn(number),
                "phone": 10 <= len(number) <= 15,
            }[kind]
            if ok:
                out.append((m.start(), rank, kind, m.end()))
    return sorted(out)


CASES = [
    None, "", "no data here", "a@b.co", "x a@b.co_c@d.ef, g@h", "ü€ 𝔘 write to é.a+b%c@d-e.f.g. Now 1.2.3.4 and 256.1.1.1 and 1.2.3.4.5.6.7.8",
    "4111 1111 1111 1111 or 4111-1111-1111-1112, 41111111111111114111", "call +1 (555) 123-4567. or +12 or + 1", "+1 234 567 890 12 345 678 9",
    "0001.002.3.255", "a" * 30_000 + "@" + "b" * 10 + ".com", "1" * 30_000, "1 " * 30_000, "1.2." * 9_000, "+1 234-567-8901 " * 3_000,
    "@@..@a.b@c.d", "IBAN DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432 and DE88370400440532013000",
    "my ssn is 123-45-6789; order 123-45-6789", "phone (555) 123-4567 against (555) 123-4567 in a table of numbers here",
]


def test_base_spans_equal_the_plain_patterns(spark):
    rows = [(i, t, "clash") for i, t in enumerate(CASES)] + [(3, "a@b.co", "clash")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_email string")
    got = pii.pii_digest(df).collect()
    assert len(got) == len(rows)
    for r in got:
        want = plain(CASES[r.doc_id] or "")
        joined = ",".join(f"{k}:{s}:{e}" for s, _, k, e in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), (r.doc_id, r.spans[:300], joined[:300])
        for k in PLAIN:
            assert r[f"n_{k}"] == sum(x[2] == k for x in want)
        assert set(joined.split(",")) - {""} <= set(r.spans.split(","))
        starts = [int(s.split(":")[1]) for s in r.spans.split(",") if s]
        assert starts == sorted(starts)


def test_given_documents(spark, folder):
    df = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {r.doc_id: r.text for r in df.collect()}
    for r in pii.pii_digest(df).collect():
        joined = ",".join(f"{k}:{s}:{e}" for s, _, k, e in plain(texts[r.doc_id] or ""))
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()


def test_checksums_and_context(spark):
    one = lambda t: [x.kind for x in pii.find_pii(spark.createDataFrame([(t,)], "text string")).first().pii]
    assert one("IBAN DE89 3704 0044 0532 0130 00.") == ["iban"]
    assert one("IBAN DE88 3704 0044 0532 0130 00.") == []
    assert one("my ssn is 123-45-6789") == ["tax_id"] and one("order 123-45-6789") == []
    assert one("phone: (555) 123-4567") == ["local_phone"] and one("row (555) 123-4567") == []
    assert one("mail a@b.co")[0] == "email"
    # The words before a list count for all that is near enough, matches between them included.
    assert one("SSN: 123-45-6789, 234-56-7890") == ["tax_id"] * 2
    assert one("Phone: (555) 123-4567 or (555) 765-4321") == ["local_phone"] * 2
    assert one("SSN: " + ", ".join(["123-45-6789"] * 6)) == ["tax_id"] * 3  # the fourth starts 44 code points later


def test_context_is_what_stands_before_in_the_text(spark):
    texts = ["mail " + "a@b.c " * 9, "x@y.zz,call a@b.c 1.2.3.4 +1 234 567 8901 9.9.9.9 +12 34567890123 tel", "ü" * 50 + " ip 1.2.3.4 5.6.7.8 " + "1.1.1.1 " * 30]
    for r in pii.find_pii(spark.createDataFrame([(t,) for t in texts], "text string")).collect():
        for x in r.pii:
            kind = next(k for k in pii.KINDS if k.name == x.kind)
            near = re.search(rf"\b(?:{kind.context})\b", r.text[max(0, x.start - pii.NEAR) : x.start].lower())
            assert x.score == min(1.0, round(kind.score + kind.checked + (pii.CONTEXT if near else 0), 2)), (r.text, x)


def test_redact_and_empty(spark):
    df = spark.createDataFrame([(1, "é mail a@b.co or call +1 555 123 4567!", None), (2, None, None)], "doc_id int, text string, pii string")
    got = {r.doc_id: r for r in pii.redact(df).collect()}
    assert got[1].text == "é mail [EMAIL] or call [PHONE]!" and got[2].text is None and got[2].pii == []
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert pii.pii_digest(none).count() == 0 and pii.redact(none).count() == 0


def test_no_python_in_the_plan(spark, folder):
    df = pii.pii_digest(spark.read.parquet(f"{folder}/documents.parquet"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
    assert df.select(F.sum("n_email")).first()[0] > 0
