from __future__ import annotations

import hashlib
import math
import re
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from starward.llm.personal_data import KINDS, REACH, TERM, personal_data, sanitised

PATTERNS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def fits(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == 1:
        return all(int(p) <= 255 for p in value.split("."))
    if kind == 2:
        return 12 <= len(digits) <= 19 and luhn(digits)
    return kind == 0 or 9 <= len(digits) <= 15


def base(text):
    return sorted(
        (m.start(), kind, m.end())
        for kind, pattern in enumerate(PATTERNS)
        for m in re.finditer(pattern, text or "")
        if fits(kind, m.group())
    )


def words(text):
    return [m.span() for m in re.finditer(TERM.replace(r"\p{L}", r"[^\W\d_]").replace("++", "+"), text)]


def with_terms(rows, support, general, remove):
    texts = {(k, t or "") for k, t in rows}
    context, near, entities = defaultdict(set), defaultdict(set), defaultdict(set)
    seen = []
    for key, text in rows:
        text = text or ""
        own = base(text)
        for kind in range(4):
            last = [m.span() for m in re.finditer(PATTERNS[kind], text)]
            if kind == 2:  # a card's neighbours are the runs of 12 to 19 digits
                last = [s for s in last if 12 <= len(re.sub("[^0-9]", "", text[slice(*s)])) <= 19]
            for n, (a, b) in enumerate(last):
                if (a, kind, b) not in own:
                    continue
                left = last[n - 1][1] if n else 0
                right = last[n + 1][0] if n + 1 < len(last) else len(text)
                before, after = text[max(left, a - REACH - 1) : a], text[b : min(right, b + REACH + 1)]
                entity = (kind, text[a:b])
                entities[entity].add((key, text))
                spans = [(a - len(before) + x, a - len(before) + y) for x, y in words(before) if len(before) <= REACH or x]
                spans += [(b + x, b + y) for x, y in words(after) if len(after) <= REACH or y <= REACH]
                for x, y in spans:
                    pair = (entity, text[x:y].lower())
                    context[pair].add((before, after))
                    near[pair].add((key, text))
                    seen.append(((key, text), pair, x, y))
    n_term = defaultdict(int)
    for _, text in rows:
        for term in {(text or "").lower()[x:y] for x, y in words((text or "").lower())}:
            n_term[term] += 1
    fate = {}
    for pair, where in context.items():
        if len(where) >= support and pair[1] in n_term:
            n, n_e = len(rows), len(entities[pair[0]])
            if n > n_e:
                share = math.log(len(near[pair]) * n / (n_term[pair[1]] * n_e)) / math.log(n / n_e)
                fate[pair] = 5 if share >= remove else 4 if share >= general else None
    added = {text: set() for text in texts}
    for where, pair, x, y in seen:
        if fate.get(pair):
            added[where].add((x, fate[pair], y))
    return {text: sorted([*base(text[1]), *added[text]]) for text in texts}


def collected(frame, **options):
    return {
        (r.doc_id, r.text_key): (list(map(tuple, r.base)), list(map(tuple, r.spans)))
        for r in personal_data(frame, **options).collect()
    }


def check(spark, documents, rows, support=3, general=0.7, remove=0.9):
    frame = documents(rows).withColumn("spans", F.lit("clash"))
    got = collected(frame, support=support, general=general, remove=remove)
    want = with_terms(rows, support, general, remove)
    keys = spark.createDataFrame(list(want), "k long, t string").select("k", "t", F.xxhash64("t").alias("h"))
    by_hash = {(r.k, r.h): r.t for r in keys.collect()}
    assert {(k, by_hash[k, h]): v for (k, h), v in got.items()} == {
        (k, t): (base(t), spans) for (k, t), spans in want.items()
    }
    return want


PARTS = ["a.b@c.de", "@", "a@b", "x@y.z@q.r", "1.2.3.4", "1.2.3.4.5", "256.1.1.1", "00255.1.1.1", "4111 1111 1111 1111",
         "4111-1111-1111-1112", "1234", "+1 (555) 123-4567", "+44", "+", "9" * 25, "79927398713", " ", "-", ".", "é", "😀", "\n"]


def test_base_spans_of_random_texts(spark, documents):
    texts = []

    @settings(max_examples=400, deadline=None, database=None)
    @given(st.lists(st.sampled_from(PARTS), max_size=8))
    def collect(parts):
        texts.append("".join(parts))

    collect()
    check(spark, documents, list(enumerate(dict.fromkeys(texts))), support=10_000)


def test_terms_that_disclose_are_found(spark, documents):
    rows = [(k, f"Call Zanzibar {k} now a.b@c.de, or Timbuktu tomorrow {k}.") for k in range(6)]
    rows += [(10 + k, f"plain words or Timbuktu and now tomorrow number {k}") for k in range(30)]
    rows += [(100 + k, f"copy Copied q@r.st same") for k in range(5)]
    want = check(spark, documents, rows)
    kinds = {KINDS[kind]: text[1][a:b] for text, spans in want.items() for a, kind, b in spans if kind > 3}
    assert "removed" in kinds and "Zanzibar" in {t[1][a:b] for t, s in want.items() for a, k, b in s if k == 5}
    assert all(not any(kind > 3 for _, kind, _ in spans) for (k, _), spans in want.items() if (k or 0) >= 100)


def test_edges(spark, documents):
    card = "4111111111111111"
    rows = [(1, None), (2, ""), (3, f"{card} {card}"), (3, f"x {card}"), (4, "a@" * 3000), (5, "9" * 30_000),
            (6, "a@" + "b." * 5000 + "c"), (7, "1." * 4000), (None, f"é {card} +1 555 123 4567"), (3, f"x {card}")]
    check(spark, documents, rows)


def test_empty_table(documents):
    assert personal_data(documents([])).collect() == []


def test_sanitised_texts(documents):
    card = "4111111111111111"
    rows = [(1, None), (2, "no data"), (3, f"mail é a.b@c.de, ip 1.2.3.4!"), (4, f"+{card[:15]}"), (None, card), (5, f"x{card}y")]
    rows += [(10 + k, f"call Zanzibar {k} on a.b@c.de") for k in range(4)] + [(50 + k, f"call {k}") for k in range(40)]
    frame = documents(rows)
    cleaned = sanitised(frame, personal_data(frame))
    assert cleaned.columns == frame.columns
    got = {r.doc_id: r.text for r in cleaned.collect()}
    assert got[1] is None and got[2] == "no data" and got[None] == "[card]" and got[5] == "x[card]y"
    assert got[3] == "mail é [email], ip [ip]!"
    assert got[10] == "call  0 on [email]" and got[50] == "call 0"
    assert "4" not in got[4]


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001"])
def test_query(spark, folder):
    from starward.llm.queries import QUERIES

    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    want = {key: spans for (key, _), spans in with_terms(rows, 3, 0.7, 0.9).items()}
    names = [*KINDS[:5], "term"]

    def listed(spans):
        return ",".join(f"{names[k]}:{a}:{b}" for a, k, b in spans)

    got = QUERIES["op10_personal_data"](spark, folder).collect()
    assert len(got) == len(rows)
    for row in got:
        spans = want[row.doc_id]
        own = [s for s in spans if s[1] < 4]
        assert row.spans == listed(spans)
        assert row.base_sha256 == hashlib.sha256(listed(own).encode()).hexdigest()
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(k == kind for _, k, _ in own) for kind in range(4)]
