"""Decontamination against a plain version on small tables, and planted copies in the given ones."""

import random
import re

import pytest

from parcelspan.llm import decontaminate as dc


def parse(text):
    values, pattern = [], []
    for m in re.finditer(r"[^\W\d_]+|[0-9]+(?:[.,][0-9]+)*", text or ""):
        v, at = m.group(), m.start()
        if v[0].isdigit():
            values.append(v)
            pattern.append("<num>")
        elif re.fullmatch(dc.UNITS, v, re.I) and re.search(r"[0-9] ?$", text[:at]):
            values.append("\x02" + v)
            pattern.append("<unit>")
        elif v[0].isupper() and len(v) > 1 and at > 1 and text[at - 1] == " " and (text[at - 2].islower() or text[at - 2].isdigit() or text[at - 2] in ",;:"):
            values.append("\x01" + v)
            pattern.append("<name>")
        else:
            values.append(v)
            pattern.append(v.lower())
    return values, pattern


def brute(docs, items):
    out = set()
    parsed = [(doc, *parse(text)) for doc, text in docs]
    places = {}  # (width, window) -> where it stands
    for w in range(1, dc.WIDTH + 1):
        if any(min(dc.WIDTH, len(parse(q)[1])) == w for _, q in items):
            for n, (_, _, dp) in enumerate(parsed):
                for p in range(len(dp) - w + 1):
                    places.setdefault(tuple(dp[p : p + w]), []).append((n, p))
    for item, question in items:
        iv, ip = parse(question)
        if not ip:
            continue
        w = min(dc.WIDTH, len(ip))
        spans = [tuple(ip[i : i + w]) for i in range(len(ip) - w + 1)]
        telling = [i for i, s in enumerate(spans) if sum(not t.startswith("<") for t in s) >= min(dc.LITERAL, w)] or list(range(len(spans)))
        shifts_of = {}
        for i in telling:
            for n, p in places.get(spans[i], []):
                shifts_of.setdefault(n, {}).setdefault(p - i, set()).add(i)
        for n, shifts in shifts_of.items():
            doc, dv, _ = parsed[n]
            found = set()
            for s, ats in shifts.items():
                pairs = {(iv[p], dv[p + s]) for p in range(len(ip)) if ip[p].startswith("<") and any(a <= p < a + w for a in ats)}
                if len({a for a, _ in pairs}) == len(pairs):
                    found |= ats
            if found and len(found) >= dc.SHARE * len(telling):
                out.add((doc, item, len(found), len(telling)))
    return out


Q = "If Maria drives 120 km in 2 hours and then Maria rests for 2 hours, how far has she gone by 5 pm that day?"
ITEMS = [(1, Q), (2, "What is the capital of the country where the river called Ebro ends its way?"), (3, "short item here"), (4, ""), (5, None),
         (6, "1 2 3 4 5 6 7 8 9"), (7, Q), (None, "null ids have words of their own that nobody else would ever write")]
DOCS = [
    (1, "Before. " + Q + " After it."), (2, "Before. " + Q.replace("Maria", "Peter").replace("120", "90").replace("2 hours", "3 hours")),
    (3, Q.replace("120", "80").replace("Maria rests", "Anna rests").replace("2 hours,", "7 hours,")), (4, Q[: len(Q) // 3]),
    (5, None), (6, ""), (7, "a Short Item here and more"), (8, "The short item here"), (9, "11 12 13 14 15 16 17 18 19 20"), (None, Q), (1, "x " * 50_000 + Q),
    (10, "what is the capital of the country where the river called Nile ends its way"), (11, "null ids have words of their own that nobody else would ever write"),
]


@pytest.mark.parametrize("sent", [dc.SENT, 0])
def test_against_plain_version(spark, sent, monkeypatch):
    monkeypatch.setattr(dc, "SENT", sent)
    docs = spark.createDataFrame([(*r, "x") for r in DOCS], "doc_id bigint, text string, item string")
    bench = spark.createDataFrame([(*r, "y") for r in ITEMS], "item_id bigint, text string, window string")
    got = {(r.doc_id, r.item_id, r.n_windows, r.of_windows) for r in dc.contaminated(docs, bench).collect()}
    assert got == brute(DOCS, ITEMS)
    changed = {(r.doc_id, r.item_id): r.changed_slots for r in dc.contaminated(docs, bench).collect()}
    assert changed[(2, 1)] > 0 and (3, 1) not in changed and (4, 1) not in changed
    leaks = {d for d, *_ in brute(DOCS, ITEMS)}
    kept = dc.decontaminate(docs, bench)
    assert kept.columns == docs.columns
    texts = {t for d, t in DOCS if (d, t) in {(r.doc_id, r.text) for r in kept.collect()}}
    assert not any(Q in (t or "") for t in texts) and {5, 6} <= {r.doc_id for r in kept.collect()} and 2 in leaks


def test_random_texts(spark):
    rng = random.Random(1)
    word = lambda: rng.choice(["red", "blue", "Anna", "Bob", "7", "12.5", "km", "goes", "to", "fast", "slow", "house", "far"])
    items = [(i, " ".join(word() for _ in range(rng.randint(5, 25)))) for i in range(12)]
    docs = []
    for i in range(60):
        parts = [" ".join(word() for _ in range(rng.randint(0, 30)))]
        if i % 2:
            parts.insert(rng.randint(0, 1), re.sub("Anna|7", lambda m: rng.choice(["Bob", "12.5", m[0]]), rng.choice(items)[1]))
        docs.append((i, " ".join(parts)))
    a, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id, r.n_windows, r.of_windows) for r in dc.contaminated(a, b).collect()}
    assert got == brute(docs, items) and got


def test_given_tables(spark, folder):
    docs, bench = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    pairs = {(r.doc_id, r.item_id) for r in dc.contaminated(docs, bench).collect()}
    items = [(r.item_id, r.text) for r in bench.collect()]
    planted = {(r.doc_id, i) for r in docs.collect() for i, t in items if t in r.text}
    assert planted and planted <= pairs and len(pairs) <= len(planted) + 2
    empty = docs.limit(0)
    assert dc.contaminated(empty, bench).count() == 0 and dc.contaminated(docs, bench.limit(0)).count() == 0
    assert dc.decontaminate(docs, bench.limit(0)).count() == docs.count()
    plan = dc.contaminated(docs, bench)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_capitals_whatever_stands_before(spark):
    names = "Tom has 5 apples. Anna has 7 pears. Ben eats 3 of them. Tom sells 2. How many are left?"
    short, title, quoted = "Which river flows through Paris?", "Who Wrote The Old Man And The Sea", '"Greta found 4 shells near the old pier.\nOtto lost 3 of them again.'
    renamed = names.replace("Tom", "Eve").replace("Anna", "Liz").replace("Ben", "Max")
    docs = [
        (1, renamed), (2, names.replace("Tom sells", "Kim sells").replace("Tom", "Eve").replace("Anna", "Liz").replace("Ben", "Max")),
        (3, "as someone asked Which river flows through Paris? and went on"), (4, "in the quiz Who Wrote The Old Man And The Sea was asked"),
        (5, "Five Large Grey Birds Over A Very Small House"), (6, quoted.replace("Greta", "Hilde").replace("Otto", "Emil")),
        (7, "which river flows through Rome"), (8, "as told before Tom has 5 apples. " + names[18:]), (9, "Some river flows past here"),
    ]
    items = [(1, names), (2, short), (3, title), (4, quoted)]
    a, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r for r in dc.contaminated(a, b).collect()}
    assert set(got) == {(1, 1), (3, 2), (4, 3), (6, 4), (7, 2), (8, 1)}
    assert got[1, 1].n_windows == got[1, 1].of_windows == 13 and got[1, 1].changed_slots == 3
    assert got[8, 1].n_windows == 13 and got[8, 1].changed_slots == got[3, 2].changed_slots == got[4, 3].changed_slots == 0


def test_sentence_starts_that_contradict(spark):
    item = "The old mill by the lake was sold for 12 euros to a baker from the next town. The owner left."
    doc = item.replace("The owner", "This owner")
    a, b = spark.createDataFrame([(1, doc), (2, item)], "doc_id bigint, text string"), spark.createDataFrame([(1, item)], "item_id bigint, text string")
    assert {r.doc_id for r in dc.contaminated(a, b).collect()} == {1, 2}
