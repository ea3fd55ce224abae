"""License spans, personal data and quality rules against plain Python."""

import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from evenhand.llm.licenses import Notice, Searcher, license_spans
from evenhand.llm.pii import personal_data, redacted, span_text
from evenhand.llm.quality import quality

NOTICES = [
    ("Released under the MIT License.", [("mit", 3, 0)]),
    ("MIT license mit-license MIT  LICENSE", [("mit", 0, 0), ("mit", 2, 0), ("mit", 4, 0)]),
    ("the gnu generel public license", [("gpl", 2, 1)]),
    ("mit licensed, xmit license", []),
    ("apache licence", [("apache", 0, 1)]),
    ("Permission is hereby granted, free of charge, to any persn obtaining a copy of this software", [("mit", 0, 1)]),
]


@pytest.mark.parametrize("text,expected", NOTICES)
def test_notices(spark, text, expected):
    spans = license_spans(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).collect()[0].spans
    found = {(s.label, s.first_word, s.errors) for s in spans}
    assert set(expected) <= found and (expected or not found)
    assert all(text[s.start : s.end].strip() == text[s.start : s.end] != "" for s in spans)


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_seeds_lose_no_notice():
    notice = Notice("x", "mozilla public license")
    searcher = Searcher((notice,), 12)
    letters = "aeiklmopruxz "
    for at in range(len(notice.words)):
        for change in ("", *letters):
            near = notice.words[:at] + change + notice.words[at + 1 :]
            if edits(near, notice.words) <= 1 and "  " not in near and near == near.strip():
                assert searcher.find(f" some {near} text "), near


def luhn(number: str) -> bool:
    parts = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(number))]
    return sum(p - 9 * (p > 9) for p in parts) % 10 == 0


def plain_spans(text: str) -> str:
    found = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        found += [("ip", m)] * all(int(part) <= 255 for part in m[0].split("."))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        number = re.sub("[^0-9]", "", m[0])
        found += [("card", m)] * (16 <= len(number) <= 19 and luhn(number))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        found += [("phone", m)] * (8 <= len(re.sub("[^0-9]", "", m[0])) <= 15)
    return ",".join(f"{kind}:{m.start()}:{m.end()}" for kind, m in found)


PERSONAL = [
    "a@b.c.@d.e x@y.z a@@b.c",
    "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.004 99999999999999999999.1.1.1",
    "4111 1111 1111 1111 and 4111-1111-1111-1112, 4111111111111111 5",
    "+1 (499) 555-6503 +12 +1234567 +1-2-3-4-5-6-7-8-",
    "é😀 a@b.co 😀 1.1.1.1",
    "nothing here",
    "1 " * 3000 + "a." * 2000 + "@b.c",
]


def test_base_spans(spark):
    rows = list(enumerate(PERSONAL))
    found = personal_data(spark.createDataFrame(rows, "doc_id bigint, text string"))
    base = F.filter("spans", lambda s: s["kind"].isin("email", "ip", "card", "phone"))
    spans = dict(found.select("row.doc_id", span_text(base)).collect())
    assert spans == {k: plain_spans(text) for k, text in rows}


def test_checksums_context_and_marks(spark):
    rows = [
        (1, "iban GB82 WEST 1234 5698 7654 32 ok"),
        (2, "iban GB82 WEST 1234 5698 7654 33 ok"),
        (3, "my ssn is 123-45-6789."),
        (4, "part 123-45-6789."),
        (5, "mail a@b.co, call +1 499 555 6503"),
    ]
    found = personal_data(spark.createDataFrame(rows, "doc_id bigint, text string"))
    marked = dict(found.select("row.doc_id", redacted(F.col("text"), F.col("spans"))).collect())
    assert marked == {
        1: "iban <IBAN> ok",
        2: rows[1][1],
        3: "my ssn is <SSN>.",
        4: rows[3][1],
        5: "mail <EMAIL>, call <PHONE>",
    }


def marked_texts(spark, texts: list[str]) -> list[str]:
    found = personal_data(spark.createDataFrame([*enumerate(texts)], "doc_id bigint, text string"))
    return [r[1] for r in sorted(found.select("row.doc_id", redacted(F.col("text"), F.col("spans"))).collect())]


def test_ibans_before_capitals_and_digits(spark):
    texts = {
        "iban GB82 WEST 1234 5698 7654 32 Please pay": "iban <IBAN> Please pay",
        "GB82WEST12345698765432 BIC DEUTDEFF": "<IBAN> BIC DEUTDEFF",
        "DE89 3704 0044 0532 0130 00 100 EUR": "<IBAN> 100 EUR",
        "é😀 AB12 CD34 GB82WEST12345698765432 NO93 8601 1117 947 X": "é😀 AB12 CD34 <IBAN> <IBAN> X",
        "DE89370400440532013000 GB82WEST12345698765432": "<IBAN> <IBAN>",
        # A country without a known length, and numbers that are too short, too long or fail the checksum.
        "ZZ59 1234 5678 9012 3456 BIC X": "<IBAN> BIC X",
        "GB82 WEST 1234 5698 7654 Pay": "GB82 WEST 1234 5698 7654 Pay",
        "GB82WEST12345698765432X": "GB82WEST12345698765432X",
        "GB83WEST12345698765432 BIC": "GB83WEST12345698765432 BIC",
        "MT84 MALT 0110 0001 2345 MTLC AST0 01S Pay": "<IBAN> Pay",
    }
    assert dict(zip(texts, marked_texts(spark, list(texts)))) == texts


def test_context_reaches_over_neighbours(spark):
    near, far = ("SSN:" + " " * n + "123-45-6789" for n in (36, 37))
    texts = {
        "SSN: 123-45-6789, 234-56-7890, 345-67-8901": "SSN: <SSN>, <SSN>, <SSN>",
        "123-45-6789, 234-56-7890 (social security)": "<SSN>, <SSN> (social security)",
        "é😀 SSN 123-45-6789/234-56-7890": "é😀 SSN <SSN>/<SSN>",
        near: "SSN:" + " " * 36 + "<SSN>",
        far: far,
    }
    assert dict(zip(texts, marked_texts(spark, list(texts)))) == texts


def plain_quality(text: str) -> tuple:
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts = Counter(grams)
    covered = {j for i, gram in enumerate(grams) if counts[gram] > 1 for j in range(i, i + 5)}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), failed


GOOD = "It was a fine day in the old town.\nMany people walked along the river, and none of them hurried."
TEXTS = [
    GOOD,
    "a b c d e a b c d e f\nx\nx \nx\n a b c d e",
    "a a a a a a a a a a a a",
    "x\x0by\x0cz\rt | é 漢",
    "",
    "Home | About | News | Login\n" * 3 + "Short.",
    "one*** two$$$ three%%% four&&& five### six*** seven$$$ eight%%% nine&&& ten### eleven***",
    "so so so so so it it it it it was was was was was in in in in in",
]


def test_quality(spark):
    rows = list(enumerate(TEXTS))
    found = quality(spark.createDataFrame(rows, "doc_id bigint, text string"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    facts = {r[0]: r for r in found.select("row.doc_id", *names, "kept", "clean_text").collect()}
    assert {k: tuple(r[1:7]) for k, r in facts.items()} == {k: plain_quality(t) for k, t in rows}
    assert [k for k, r in facts.items() if r.kept] == [0]
    assert facts[0].clean_text == GOOD
    assert facts[6].base_failed is False and facts[7].base_failed is False


def _many(n):
    return " ".join(f"user{i}@mail.example.org, {i} +39 06 12345{i % 100:02d} 10.0.{i % 256}.7 SSN: 123-45-6789" for i in range(n))


@pytest.mark.parametrize("n", [1, 20, 63, 64, 65, 1000])
def test_texts_with_many_hits(spark, n):
    """Places and context are right in every chunk of a text, and marks replace all of them."""
    text = "é" * 37 + _many(n)
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    row = personal_data(docs).select("spans", redacted(F.col("text"), F.col("spans")).alias("marked")).head()
    patterns = {"email": r"user[0-9]+@mail\.example\.org", "ip": r"10\.0\.[0-9]+\.7", "phone": r"\+39 06 [0-9]+", "ssn": r"123-45-6789"}
    found = {}
    for span in row.spans:
        found.setdefault(span.kind, []).append(text[span.start : span.end])
        assert span.score > 0.5
    # A phone number takes in the address after it, as its pattern says.
    assert found["email"] == re.findall(patterns["email"], text) and found["ssn"] == ["123-45-6789"] * n
    assert len(found["ip"]) == n and row.marked.count("<EMAIL>") == row.marked.count("<SSN>") == n
    spans = sorted((s.start, s.end, s.kind) for s in row.spans)
    expected, at = "", 0
    groups = []
    for start, end, kind in spans:
        if groups and start < groups[-1][1]:
            groups[-1][1] = max(end, groups[-1][1])
        else:
            groups.append([start, end, kind])
    for start, end, kind in groups:
        expected += text[at:start] + f"<{kind.upper()}>"
        at = end
    assert row.marked == expected + text[at:]


def test_time_grows_with_the_hits(spark):
    took = {}
    for n in (1_000, 8_000):
        docs = spark.createDataFrame([(1, _many(n))], "doc_id bigint, text string")
        result = personal_data(docs).select(F.size("spans"), F.length(redacted(F.col("text"), F.col("spans"))))
        began = time.perf_counter()
        assert result.head()[0] >= 3 * n
        took[n] = time.perf_counter() - began
    assert took[8_000] < 16 * took[1_000] + 5
    assert took[8_000] < 60
