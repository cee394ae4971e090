"""The candidate scan against a character loop over a whole table, the dictionary's rule, ties, and look-alikes of other kinds."""

import random
from collections import Counter

from docspark.llm import secrets

KEY = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.-")
NAMES = ("password", "passwd", "passphrase", "pwd", "secret", "token", "credential")


def plain_scan(text):
    """Runs of 12 or more key characters with a letter and a digit, found character by character (no = and no quotes)."""
    out, at, n = [], 0, len(text)
    while at < n:
        if text[at] not in KEY:
            at += 1
            continue
        end = at
        while end < n and text[end] in KEY:
            end += 1
        run = text[at:end]
        before, after = text[at - 1 : at], text[end : end + 1]
        pad = end
        while pad < n and text[pad] == "=" and pad < end + 2:
            pad += 1
        padded = pad if pad > end and text[pad : pad + 1] not in KEY | {"=", "@"} else end
        if before != "@" and len(run) >= 12 and any(c.isdigit() for c in run) and any(c.isalpha() for c in run) and text[padded : padded + 1] != "@" and after != "@":
            out.append((at, padded))
        at = end
    return out


def test_scan_of_the_whole_table_equals_a_plain_loop(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = {(r.doc_id, r.start, r.end, r.value) for r in secrets.find_secrets(docs).collect()}
    want = {(d.doc_id, a, z, d.text[a:z]) for d in docs.collect() for a, z in plain_scan(d.text or "")}
    assert got == want and len(got) > 5
    rng = random.Random(3)
    for _ in range(3000):
        text = "".join(rng.choice("aB3_/+-. \n=@xé") for _ in range(rng.randint(0, 80)))
        assert secrets.candidates(text) == plain_scan(text), text


def test_dictionary_is_a_share_of_all_words(spark):
    texts = [("house " * 50 + "garden, (garden) 'garden' ") * 20, "rarely seen here", "key_house house9 x/house", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(3)
    counts = secrets.dictionary(df, "text", 0.001)
    assert counts == {"house": 1000, "garden": 60}
    assert secrets.dictionary(df, "text", 1e-9).keys() == {"house", "garden", "rarely", "seen", "here"}
    assert secrets.words_alone(Counter({"«maison»": 2, "ab": 9, "straßenbahn.": 1, "x1234": 5})) == {"maison": 2, "straßenbahn": 1}
    assert secrets.dictionary(df.where("false"), "text") == {}


def test_ties_and_repeated_rows(spark):
    value = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
    text = f'token = "{value}" and token = "{value}"'
    df = spark.createDataFrame([(1, text, 5), (1, text, 6), (None, text, 7)], "doc_id long, text string, score int").repartition(3)
    rows = secrets.find_secrets(df).collect()
    second = text.rindex(value)
    assert Counter((r.doc_id, r.start) for r in rows) == {(1, 9): 2, (1, second): 2, (None, 9): 1, (None, second): 1}
    assert len({(r.start, r.score) for r in rows}) == 2


def test_look_alikes_of_other_kinds(spark):
    """Forms written by hand, not by the rule behind the training findings."""
    harmless = [
        "order number ORD-20240115-000421 was sent", "the book has ISBN-978-0-306-40615-7 on it", "printer HP-LaserJet-P1102w-series is out", "open Mon-Fri-08.00-17.30 only", "the image registry/team/app-1.2.3-slim runs",
        "see chapter/12/section-4.5.6/notes for more", "flight LH-0452-FRA-LAX-2024 was late", "file report_final_v2_2024.docx.bak is here", "under article-17-paragraph-3 it says", "his user name mueller_hans_1975 was taken",
    ]
    rng = random.Random(8)
    key = lambda n: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    real = [f"export SERVICE_TOKEN={key(32)} now", f'"apiKey": "{key(39)}",', f"Authorization: Bearer {key(120)}", f"db_password: {key(24)}", f"aws_secret_access_key = {key(40)}"]
    words = "order number sent the book printer series open only image team runs chapter section notes more flight late file report final here under article paragraph says user name taken".split()
    df = spark.createDataFrame(list(enumerate(harmless + real + [" ".join(words) * 3] * 5)), "doc_id long, text string")
    flagged = {r.doc_id for r in secrets.find_secrets(df).collect() if r.is_secret}
    assert flagged >= set(range(10, 15))
    assert len(flagged & set(range(10))) <= 2, flagged


FORMS = [
    ("db: password = hunter22 there", "hunter22"), ("set passwd: s3cr#t!x9, then", "s3cr#t!x9"), ('password: "correct horse battery"', "correct horse battery"), ("secret = 'four of these words'", "four of these words"),
    ("Authorization: Bearer abcdefghijklmnopqrstuvwxyz", "abcdefghijklmnopqrstuvwxyz"), ("use postgres://u:p4ssw0rdXYZ99@host/db now", "p4ssw0rdXYZ99"), ("redis://:Qx7pLm2zR@cache:6379", "Qx7pLm2zR"), ("the password: hunter2299.", "hunter2299"), ("at https://h.example/?q=1&token=abc123xyz89", "abc123xyz89"), ("url:http://x?password=hunter22x", "hunter22x"),
]
NO_FORMS = ["the password is required here", "password: required", "time: 10:30:45.123456 is", "bearer of news", "http://host:8080/a@b", "user@host.example:path/to", 'name = "correct horse battery"', "password: 'x'", "password =\n\n\n\n\nabcdefgh1"]


def test_forms_of_candidates():
    for text, value in FORMS:
        assert [text[a:z] for a, z in secrets.candidates(text)] == [value], text
    for text in NO_FORMS:
        assert secrets.candidates(text) == [], text
    both = 'token = "https://u:Zx81Qw92mmA@host/x"'  # an address within a quoted value: the value counts, once
    assert [both[a:z] for a, z in secrets.candidates(both)] == ["https://u:Zx81Qw92mmA@host/x"]


def test_forms_end_to_end(spark):
    """Each form is found and flagged; texts where a secret would stand are not."""
    harmless = ['password: "your password goes here"', "api_key = os.environ[API_KEY_1]", "secret: ${APP_SECRET_2}", "token = self.session.token_2", 'password: "must be eight characters or more"', "Bearer responsibilities are"]
    words = "garden river house mountain report market winter bridge letter number island season village kitchen morning number teacher window paper music letter station animal forest silver answer summer picture correct horse battery".split()
    df = spark.createDataFrame(list(enumerate([t for t, _ in FORMS] + harmless + [" ".join(words) * 3] * 5)), "doc_id long, text string")
    rows = secrets.find_secrets(df).collect()
    flagged = {r.doc_id for r in rows if r.is_secret}
    assert flagged >= set(range(len(FORMS))), sorted((r.doc_id, r.value, round(r.score, 2)) for r in rows)
    assert len(flagged - set(range(len(FORMS)))) <= 1, sorted((r.doc_id, r.value, round(r.score, 2)) for r in rows)


def test_long_lines_take_linear_time():
    import time

    for text in ('password: "' + "a " * 500_000, "token=" + "x" * 1_000_000, "://a:" * 200_000, "Bearer " * 150_000, "://" + "a" * 500_000 + ":" + "b" * 500_000, "password:" * 100_000, "password:'" * 100_000, 'token=\' ' * 100_000 + 'token=" ' * 100_000, "a:" * 500_000, "token=" + ":" * 500_000):
        began = time.perf_counter()
        secrets.candidates(text)
        assert time.perf_counter() - began < 10
