from __future__ import annotations

import hashlib
import re

import pytest

from palate.llm import personal_data as P

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def holds(kind: str, hit: str) -> bool:
    digits = re.sub("[^0-9]", "", hit)
    if kind == "ip":
        return all(int(x) <= 255 for x in hit.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text: str | None) -> list[tuple[int, int, int]]:
    text = text or ""
    return sorted(
        (m.start(), k, m.end()) for k, (kind, p) in enumerate(BASE.items()) for m in re.finditer(p, text) if holds(kind, m[0])
    )


def listed(spans):
    return ",".join(f"{P.KINDS[k]}:{a}:{b}" for a, k, b in spans)


TEXTS = [
    None,
    "",
    "nothing here",
    "a@b.c_d@e.f a@b@c.d x@y..z q@w.e.",
    "𝒜é mail: jörg.o@x-y.example.com, again jo@x.example.com.",
    "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.0255 1.2.3 0000000000000000000001.1.1.1",
    "4111 1111-1111 1111 4111111111111111",
    "4111 1111 1111 1111, 4111111111111112, 0000000000000",
    "+1 (743) 555-3824 +49 30 1234567; +1 2, ++12345678901 +123456789012345678",
    "+1 (826) 555-4081 190.137.223.204",
    "1" * 9_000 + " " + "1." * 9_000 + " " + "a." * 3_000 + "@" + "b." * 9_000 + "c",
    "- 1 " * 20_000 + "+" * 1000 + "(" * 20_000,
    " ".join(f"u{i}@mail.example.com" for i in range(3000)),
]


def told(spark, texts, path):
    rows = [(i if i % 7 else None, t, 1, "x") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, row int, kind string").coalesce(1).write.parquet(str(path))
    docs = spark.read.parquet(str(path))
    return docs, [(r.base, r.spans) for r in P.by_document(P.find(docs)).orderBy("row").collect()]


def test_base_spans_by_brute_force(spark, tmp_path):
    texts = TEXTS + ["same +1 (743) 555-3824"] * 3
    _, found = told(spark, texts, tmp_path / "d")
    assert len(found) == len(texts)
    for text, (base, spans) in zip(texts, found, strict=True):
        assert [tuple(x) for x in base] == brute(text)
        assert {tuple(x) for x in base} <= {tuple(x) for x in spans} and list(spans) == sorted(spans)


def test_query(spark, small):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    found = P.op13_personal_data(spark, small)
    assert "Python" not in found._jdf.queryExecution().toString() and "Arrow" not in found._jdf.queryExecution().toString()
    rows = found.collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        want = brute(docs[r.doc_id])
        assert [r[f"n_{k}"] for k in P.KINDS] == [sum(x[1] == i for x in want) for i in range(4)]
        assert r.base_sha256 == hashlib.sha256(listed(want).encode()).hexdigest()
        spans = r.spans.split(",") if r.spans else []
        assert set(listed(want).split(",") if want else []) <= set(spans)
        for s in spans:
            kind, a, b = s.split(":")
            assert kind in P.KINDS and 0 <= int(a) < int(b) <= len(docs[r.doc_id])


FILLER = "the sand of a road at home. There was no one to be seen by it, and nothing more"


def corpus(n=400):
    """Documents with plain spans to learn from, and plain prose."""
    texts = []
    for i in range(n):
        card = f"4{i * 7919 % 10**14:014d}"
        card += next(str(c) for c in range(10) if luhn(card + str(c)))
        wrong = card[:-1] + str((int(card[-1]) + 1 + i % 8) % 10)
        texts += [
            f"{FILLER} {f'user{i}.x' if i % 2 else 'mary'}@mail{i % 9}.example.com {FILLER}",
            f"{FILLER} {i % 250}.{i % 199}.{i % 77}.{i % 255} {FILLER}",
            f"{FILLER} {card} {FILLER} order {wrong} {FILLER}",
            f"{FILLER} +1 ({200 + i % 700}) 555-{1000 + i} {FILLER}",
            f"{FILLER} chapters 2001 2002 2003 and {i} others {FILLER}",
        ]
    return texts


@pytest.fixture(scope="module")
def learned(spark, tmp_path_factory):
    asked = [
        f"{FILLER} 4111111111111111 5500005555555559 {FILLER}",  # one match of the base pattern, too long for it
        f"{FILLER} +1 (826) 555-4081 190.137.223.204 {FILLER}",
        f"{FILLER} jane.roe42 at mail3 dot example dot com {FILLER}",
        f"{FILLER} jane(at)example(dot)com {FILLER}",
        f"{FILLER} 10[.]20[.]30[.]40 {FILLER}",
        f"{FILLER} 4111.1111.1111.1111 {FILLER}",
        f"{FILLER} 1 (743) 555-3824 {FILLER}",
        f"{FILLER} {FILLER}. We met at noon. Then we left at 2001 2002 2003, for 4111111111111112 reasons. {FILLER}",
    ]
    docs, found = told(spark, corpus() + asked, tmp_path_factory.mktemp("pii") / "d")
    return docs, asked, [[(P.KINDS[k], text[a:b]) for a, k, b in spans] for text, (_, spans) in zip(asked, found[-len(asked) :], strict=True)]


def test_trees_add_what_the_base_misses(learned):
    _, _, spans = learned
    assert spans[0] == [("card", "4111111111111111"), ("card", "5500005555555559")]
    assert spans[1] == [("phone", "+1 (826) 555-4081"), ("ip", "190.137.223.204")]
    assert spans[2] == [("email", "jane.roe42 at mail3 dot example dot com")]
    assert spans[3] == [("email", "jane(at)example(dot)com")]
    assert spans[4] == [("ip", "10[.]20[.]30[.]40")]
    assert spans[5] == [("card", "4111.1111.1111.1111")]
    assert spans[6] == [("phone", "1 (743) 555-3824")]


def test_clean_text_stays(learned):
    assert learned[2][7] == []


def test_redacted(spark, learned):
    docs, asked, _ = learned
    found = P.redacted(docs)
    got = [r.text for r in found.collect()]
    assert found.columns == docs.columns and len(got) == 2000 + len(asked)
    assert f"{FILLER} [CARD] [CARD] {FILLER}" in got and f"{FILLER} [PHONE] [IP] {FILLER}" in got
    assert sum("@" in x for x in got) == 0 and asked[7] in got


def test_empty(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert P.by_document(P.find(docs)).count() == 0
    _, found = told(spark, ["no data at all", None], tmp_path / "d")  # nothing to learn from
    assert [(list(b), list(s)) for b, s in found] == [([], []), ([], [])]


def test_every_kind_of_row_teaches_however_many_there_are(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"mail a{k}@b.org or a{k} at b dot org, call +1 (20{k % 10}) 555-01{k:02d}, host 10.0.0.{k}") for k in range(30)], "doc_id long, text string")
    spans = P.near_base(P.candidates(docs))
    whole = {tuple(r) for r in P.lessons(spans).collect()}
    monkeypatch.setattr(P, "MOST_ROWS", 3)
    table = P.lessons(spans)
    assert len(whole) > 3 and {tuple(r) for r in table.collect()} == whole
    assert P.calibrate(P.boost(table), table).prior
