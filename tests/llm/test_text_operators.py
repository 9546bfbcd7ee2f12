"""Main text, language, decontamination and pseudonyms against brute force and made-up cases."""

import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conceptstrata.llm import decontaminate, html_text, language, pseudonyms
from conceptstrata.llm.common import load

LONG = "A long sentence, with commas, that says a good deal about its subject. "


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("no markup, only text", "no markup, only text"),
        (f"<body><nav><a href=x>Home</a></nav><article><h1>T</h1><p>{LONG}<p>Short.</article><footer>F</footer>", f"T {LONG}Short."),
        (f"<div id=menu><a>m</a></div><div class=content><p>{LONG}</p><p>b &lt;i&gt; &amp;amp; c</p></div><div class=comments><p>{LONG * 9}</p></div>", f"{LONG}b <i> &amp; c"),
        (f"<article><p>x\n\t y<br>z</p><form>f</form><script>if (a < b) '</p>'</script><p>{LONG}", f"x y z {LONG}".strip()),
        (f"<article><p>{LONG}</p><ul><li>one<li>t<b>w</b>o</ul><aside>no</aside></article>", f"{LONG}one two"),
        ("<article><h1>Tiny</h1><p>Tiny.</p></article><div class=ad>" + LONG + "</div>", "Tiny Tiny."),
        (f"<article><p>{LONG}</p><p>cut off &am", f"{LONG}cut off &am"),
    ],
)
def test_main_text(page, text):
    assert html_text.main_text(page) == text.strip()


def test_pages_that_nest_deeply_or_close_nothing():
    assert html_text.main_text("<div>" * 20_000 + LONG) == LONG.strip()
    assert html_text.main_text("</div>" * 100 + "<p>" + LONG) == LONG.strip()


def test_extract_replaces_clashing_columns(spark):
    rows = [(1, "u", f"<article><p>{LONG}</p></article>", "old"), (1, "u", None, "old")]
    out = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string"))
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((r.text, r.n_chars) for r in out.collect()) == [("", 0), (LONG.strip(), len(LONG) - 1)]
    assert html_text.extract(spark.createDataFrame([], "page_id long, html string")).count() == 0


def test_language_is_right_on_held_out_rows(spark, sf_small):
    docs = load(spark, sf_small, "documents")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    named = language.predict(docs.select("doc_id", "text"), language.fit(docs.where(~held))).withColumn("held", held)
    rows = named.join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    right = [r.lang_pred == r.lang for r in rows if r.held]
    assert sum(right) / len(right) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_mixed_text_gets_both_languages(spark):
    train = [(i, "the cat sat on the mat with those others", "en") for i in range(20)]
    train += [(i, "der hund liegt auf dem boden und schläft nicht", "de") for i in range(20, 40)] + [(41, "zzz", None)]
    model = language.fit(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    mixed = "the cat sat with others " * 30 + "der hund schläft auf dem boden " * 15
    rows = [(1, mixed, 7), (2, None, 7), (3, "12 ... 34", 7), (3, "12 ... 34", 7), (4, "", 7)]
    out = language.predict(spark.createDataFrame(rows, "doc_id long, text string, score int"), model).collect()
    got = {r.doc_id: r for r in out}
    assert len(out) == 5 and got[1].lang_pred in ("en", "de") and {m.lang for m in got[1].mixture} == {"en", "de"}
    assert [(got[i].lang_pred, got[i].score) for i in (2, 3, 4)] == [("und", 0.0)] * 3
    nothing = language.fit(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert {r.lang_pred for r in language.predict(spark.createDataFrame([(1, "word")], "doc_id long, text string"), nothing).collect()} == {"und"}


def edit_distance_to_passage(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


@settings(max_examples=200, deadline=None)
@given(st.text("abc ", min_size=1, max_size=90), st.text("abc ", max_size=60))
def test_bit_parallel_distance(item, text):
    assert decontaminate.best_match(item, text)[0] == edit_distance_to_passage(item, text)


def test_contamination_against_brute_force(spark):
    rng = random.Random(3)
    words = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]
    items = [" ".join(rng.choices(words, k=rng.randint(10, 40))) for _ in range(12)]
    docs = []
    for i in range(60):
        text = " ".join(rng.choices(words, k=60))
        if i % 2:
            passage = list(items[i % 12])
            for _ in range(rng.randint(0, len(passage) // 10)):
                at = rng.randrange(len(passage))
                passage[at : at + 1] = rng.choice([[], ["x"], [passage[at], "y"]])
            text = text[:100] + "\n" + "".join(passage).upper() + "  " + text[100:]
        docs.append((i, text, "other"))
    docs += [(100, None, "o"), (101, "", "o"), (1, docs[1][1], "o")]
    bench = [(j, t) for j, t in enumerate(items)] + [(50, None), (51, "short one")]
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    b = spark.createDataFrame(bench, "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.distance) for r in decontaminate.contamination(d, b, max_error=0.08).collect())
    want = []
    for i, text, _ in docs:
        for j, item in enumerate(items):
            distance = edit_distance_to_passage(item, decontaminate.normal(text or ""))
            if distance <= int(len(item) * 0.08):
                want.append((i, j, distance))
    assert got == sorted(want) and len(got) > 10
    assert decontaminate.contamination(d.limit(0), b).count() == 0 and decontaminate.contamination(d, b.limit(0)).count() == 0


def luhn(digits):
    total = 0
    for j, c in enumerate(reversed(digits)):
        d = int(c) * (1 + j % 2)
        total += d - 9 if d > 9 else d
    return total % 10


def pseudonyms_of(spark, texts, key="k"):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id int, text string, kinds string")
    return [r.text for r in pseudonyms.pseudonymize(df, key).orderBy("doc_id").collect()]


def test_pseudonyms_keep_the_format(spark):
    texts = ["pay 4111111111111111 or 7536784127813050, ok", "on 1999-02-28 and 31.12.1985", "DE89 3704 0044 0532 0130 00!", "ip 10.0.0.255", "ssn 123-45-6789", None, "", "version 3.0, 30/02/2001"]
    got = pseudonyms_of(spark, texts)
    first, second = got[0][4:20], got[0][24:40]
    assert luhn(first) == 0 and luhn(second) == luhn("7536784127813050") and got[0].endswith(", ok") and first != "4111111111111111"
    assert __import__("re").fullmatch(r"on \d{4}-\d\d-\d\d and \d\d\.\d\d\.\d{4}", got[1]) and got[1] != texts[1]
    bare = got[2].rstrip("!").replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1 and [len(x) for x in got[2].split()] == [4, 4, 4, 4, 4, 3]
    assert all(0 <= int(o) <= 255 for o in got[3][3:].split("."))
    assert got[5:] == texts[5:]
    assert pseudonyms_of(spark, [texts[0]]) == [got[0]] and pseudonyms_of(spark, [texts[0]], "other") != [got[0]]


def test_pseudonyms_are_a_permutation(spark):
    days = [f"{y}-{m:02d}-{d:02d}" for y in (1900, 1999, 2000, 2099) for m in range(1, 13) for d in range(1, 29)]
    cards = [f"{4000000000000 + i * 7}" for i in range(1_000)]
    for values in (days, cards):
        got = pseudonyms_of(spark, values)
        assert len(set(got)) == len(values) and {len(g) for g in got} == {len(values[0])}


def account(rng, country, size):
    body = "".join(rng.choices("0123456789", k=size - 4))
    number = int("".join(str(int(c, 36)) for c in body + country + "00"))
    return f"{country}{98 - number % 97:02d}{body}"


def is_account(bare):
    return int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1


def test_account_numbers_end_where_their_country_says(spark):
    rng = random.Random(13)
    numbers = [account(rng, c, n) for c, n in (("AT", 20), ("BE", 16), ("ES", 24), ("LU", 20), ("PL", 28), ("DE", 22), ("NO", 15), ("XX", 24))]
    assert is_account("AT611904300234573201")
    cases = []
    for number in ["AT611904300234573201", *numbers]:
        grouped = " ".join(number[i : i + 4] for i in range(0, len(number), 4))
        after = ["", ", x"] if number[:2] == "XX" else ["", " BIC", " EUR 50", " 2024 OK", f" {grouped}", " A", ". B"]
        cases += [(f"to {form}", form, end) for form in (number, grouped) for end in after]
    got = pseudonyms_of(spark, [start + end for start, _, end in cases])
    for (start, form, end), text in zip(cases, got, strict=True):
        new = text[3 : 3 + len(form)]
        assert len(text) == len(start + end) and new != form and is_account(new.replace(" ", "")), (start, end, text)
        assert form not in text and (text.endswith(end) or is_account(end.replace(" ", ""))), (start, end, text)


def test_deep_nesting_takes_linear_time():
    import time

    started = time.process_time()
    page = "<table><tr><td><p>" + "<div>" * 20_000 + "<p>" + "A long sentence, with commas, that is worth keeping, over and over. " * 5 + "</p>" + "</div>" * 20_000
    assert html_text.parse(page).items
    assert time.process_time() - started < 2


def test_short_benchmark_items_are_whole_words(spark):
    items = spark.createDataFrame([(1, "What is the capital of France?"), (2, "cat"), (3, ""), (4, None)], "item_id long, text string")
    docs = [(1, "Quiz: what is  the CAPITAL of France? Paris."), (2, "what is the capital of Frances?"), (3, "A cat."), (4, "concatenate"), (None, "cat"), (5, None)]
    found = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), items)
    assert {(r.doc_id, r.item_id, r.distance) for r in found.collect()} == {(1, 1, 0), (3, 2, 0), (None, 2, 0)}
    row = next(r for r in found.collect() if r.doc_id == 1)
    assert decontaminate.normal(docs[0][1])[row.begin : row.end] == "what is the capital of france?"


def test_learning_from_rows_without_id_and_held_out(spark, tmp_path, sf_small):
    from conceptstrata.llm import queries
    from conceptstrata.llm.common import load

    docs = load(spark, sf_small, "documents")
    docs.unionByName(docs.limit(3).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "text", "lang", "source", "n_chars")).write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op10_language_mixture(spark, str(tmp_path)).collect()
    assert len(rows) == docs.count() + 3 and all(r.held_out is not None for r in rows)
    assert [r.held_out for r in rows if r.doc_id is None] == [False] * 3


def test_no_two_days_share_a_pseudonym(spark):
    """All days of two centuries that are month/day/year only: the pseudonyms are these very strings."""
    import datetime

    days = [datetime.date(1900, 1, 1) + datetime.timedelta(i) for i in range(73_049)]
    texts = {d.strftime("%m/%d/%Y") for d in days if d.day > 12}
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(16)
    got = {r.old: r.text for r in pseudonyms.pseudonymize(df.withColumn("old", F.col("text")), "k").collect()}
    assert set(got.values()) == set(got) == texts and sum(a == b for a, b in got.items()) < 50
    first = [f"{d:02d}/{m:02d}/2001" for d in range(1, 29) for m in range(1, 13)]
    assert all(int(t[3:5]) <= 12 and t not in texts for t in pseudonyms_of(spark, first))


def test_one_pseudonym_in_all_spellings(spark):
    pairs = [("DE89 3704 0044 0532 0130 00", "DE89370400440532013000"), ("4111 1111 1111 1111", "4111-1111-1111-1111"), ("4111 1111 1111 1111", "4111111111111111")]
    pairs += [("+49 30 1234567", "+49301234567"), ("+1 (212) 555-0188", "+12125550188"), ("+380 44 1234567", "+380441234567")]
    for one, two in pairs:
        a, b = pseudonyms_of(spark, [one, two])
        assert [c for c in a if c.isalnum()] == [c for c in b if c.isalnum()] and a != one
        assert [c if not c.isalnum() else "x" for c in a] == [c if not c.isalnum() else "x" for c in one]
    assert [t[:3] for t in pseudonyms_of(spark, ["+49 30 1234567", "+49301234567"])] == ["+49"] * 2
