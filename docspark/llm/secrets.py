"""Secret scans: candidates by shape, a random forest that removes false positives.

A candidate is one of these, none with an upper length, all found in passes of linear cost over the text:

* a run of 12 or more key characters with letters and digits mixed, and with "=" only as padding at its end;
* a quoted value of 8 or more characters on one line, blanks included, assigned to a name such as password or
  token (the name may be quoted, and part of an identifier: client_secret, AWS_SECRET, accessToken);
* an unquoted value of 8 or more assigned to such a name, if not letters alone; it ends at white space, a quote,
  an angle bracket, a comma or a semicolon, and marks of sentences at its end are not of it;
* 16 or more key characters, digits or not, behind the authorization words Bearer and Basic;
* the password of an address with one (scheme://user:password@host), of 4 or more.

Where two overlap, the first counts, of two with the same start the longer. Features: length, entropy, letter case
and digit shares, how usual its character transitions are (against transitions of the corpus' own words), how much
of it dictionary words cover (words of the corpus), blanks, marks of code, paths, addresses, checksums and
placeholders in it or before it, and the words on its left: names of secrets, of digests, of files.

Training. No table holds findings, so labelled findings are generated by rule with their labels:
random keys of many lengths and alphabets behind usual names, and look-alikes (digests, commit ids,
paths, version strings, placeholders, joined words, counters, order and model numbers). The dictionary and the transitions
come from the words of all documents, counted by groupBy: a word that stands alone (not in a run of
key characters) is in the dictionary if it makes up at least ``WORD_SHARE`` of all such words. That
rule is the same for every size of input, and there are never more than 1 / WORD_SHARE such words, so
what is sent around is bounded.

Defined cases: null and empty texts have no findings. A candidate that overlaps none and repeats
gives a row each time. Rows with null ids are scanned and reported with it. Repeated rows report
repeatedly, with equal scores. Texts and candidates of any length are read whole. Extra columns are
ignored. An empty table has no findings; the dictionary is then empty, and the forest is trained all the same.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm._common import materialize

WORD_SHARE, FINDINGS, CONTEXT = 1e-5, 8000, 40
#: What may stand around a word that stands alone.
MARKS = ".,;:!?\"'()[]«»„“”…"
#: Each possessive part starts at the edge of a run only, so that no character is read more than a few times.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_.@-])(?=[A-Za-z+/_.-]*+\d)(?=[0-9+/_.-]*+[A-Za-z])[A-Za-z0-9+/_.-]{12,}+(?:={1,2}+(?![A-Za-z0-9+/_.@=-]))?+(?!@)")
SEPARATOR = re.compile(r"(?::=|=>?|:)\s{0,3}")
VALUE = re.compile(r"\"([^\"\n]{8,}+)\"|'([^'\n]{8,}+)'|(?!=)([^\s\"'<>,;]{8,}+)")
BEARER = re.compile(r"\b(?:[Bb]earer|BEARER|[Bb]asic)[ \t]{1,3}([A-Za-z0-9+/_.~-]{16,}+={0,2}+)")
URL_PASSWORD = re.compile(r"://[^\s/:@\"'<>]*+:([^\s/@\"'<>]{4,}+)@")
#: What ends a sentence, or a bracket that opens before the value, is not of a value without quotes.
ENDS = {".": "", ":": "", "!": "", "?": "", ")": "(", "]": "[", "}": "{"}
#: What may stand between an identifier and its separator, and the names in identifiers that tell of secrets.
GAP = re.compile(r"[\"']?\s{0,3}$")
NAME = re.compile(r"(?:pass(?:word|wd|phrase)|pwd|secret|token|(?:api|access|private|secret)[_-]?key|credential|(?<![a-z])(?:auth|pass))(?:s|[_-]?key)?(?![a-z])")
#: Words that name secrets, digests, files and placeholders.
SECRET_WORDS = re.compile(r"(?i)token|secret|passw|passphrase|pwd|api.?key|access.?key|auth|credential|bearer|private|signature")
DIGEST_WORDS = re.compile(r"(?i)sha\d*|md5|checksum|digest|commit|revision|hash|etag|integrity|uuid|guid|build|version")
FILE_WORDS = re.compile(r"(?i)https?:|www\.|\.(?:html?|js|css|png|jpe?g|gif|py|java|txt|csv|json|xml|pdf)\b|/[a-z]+/|path|file|url")
PLACEHOLDER = re.compile(r"(?i)example|placeholder|your|changeme|xxxx|dummy|sample|test|todo|<|0123|1234|abcd")
#: Words of sentences about secrets.
PROSE = re.compile(r"(?i)\b(?:your|here|must|should|may|enter|required|characters?|see|ask|the|not|is|are|be|set|for|with|or|from|to)\b")
USER = re.compile(r"://[^\s/:@]*:$")
FEATURES = ["length", "entropy", "upper", "lower", "digit", "other", "hex", "run", "transitions", "switches", "dictionary", "separators", "slashes", "dots", "placeholder", "near_secret", "near_digest", "near_file", "assigned", "quoted", "blanks", "code", "prose", "url_password"]


def transition_table(words: dict[str, int]) -> dict[str, float]:
    """Log share of each pair of neighbouring characters, by the counts of words."""
    pairs: Counter = Counter()
    for w, n in words.items():
        for a, b in zip(w, w[1:], strict=False):
            pairs[a + b] += n
    total = sum(pairs.values()) or 1
    return {k: math.log(v / total) for k, v in pairs.items()}


def features(value: str, before: str, after: str, words: frozenset[str], transitions: dict[str, float]) -> list[float]:
    n, low = len(value), value.lower()
    counts = Counter(value)
    kinds = "".join("d" if c.isdigit() else "u" if c.isupper() else "l" if c.isalpha() else "o" for c in value)
    pairs = [low[k : k + 2] for k in range(n - 1)]
    covered = 0
    for part in re.findall(r"[^\W\d_]+", low):
        at = 0
        while at < len(part):  # longest dictionary word from here
            size = next((k for k in range(min(14, len(part) - at), 3, -1) if part[at : at + k] in words), 0)
            covered, at = covered + size, at + max(size, 1)
    return [
        float(n), -sum(c / n * math.log2(c / n) for c in counts.values()), kinds.count("u") / n, kinds.count("l") / n, kinds.count("d") / n, kinds.count("o") / n,
        sum(c in "0123456789abcdef" for c in low) / n, max(counts.values()) / n, sum(transitions.get(p, -14.0) for p in pairs) / max(1, n - 1), sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / n,
        covered / n, sum(c in "-_." for c in value) / n, float(value.count("/")), float(value.count(".")), float(bool(PLACEHOLDER.search(value))),
        float(bool(SECRET_WORDS.search(before))), float(bool(DIGEST_WORDS.search(before))), float(bool(FILE_WORDS.search(before[-16:] + value))), float(bool(re.search(r"[=:]>?\s*[\"']?$", before))), float(before[-1:] in ("'", '"') and before[-1:] == after[:1]),
        sum(c.isspace() for c in value) / n, sum(c in "()[]{}$%<>" for c in value) / n, float(len(PROSE.findall(value))), float(after[:1] == "@" and bool(USER.search(before))),
    ]


def _named(text: str, at: int) -> bool:
    """Whether the identifier before the separator at ``at`` names a secret."""
    end = max(0, at - 4) + GAP.search(text[max(0, at - 4) : at]).start()
    start = end
    while start and (text[start - 1].isalnum() or text[start - 1] in "_-"):
        start -= 1
    return bool(NAME.search(re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", text[start:end]).lower()))


def candidates(text: str) -> list[tuple[int, int]]:
    """Spans of candidates, in order, none overlapping another."""
    named: list[tuple[int, int]] = []
    for sep in SEPARATOR.finditer(text):
        # A separator within a value found is not looked at, and only behind a name is a value read.
        if (named and sep.start() < named[-1][1]) or not _named(text, sep.start()) or not (m := VALUE.match(text, sep.end())):
            continue
        a, z = m.span(m.lastindex)
        if m.lastindex == 3:
            while z > a and (opens := ENDS.get(text[z - 1])) is not None and not (opens and opens in m[3]):
                z -= 1
            if z - a < 8 or text[a:z].isalpha():
                continue
        named.append((a, z))
    named += [m.span(1) for m in BEARER.finditer(text)] + [m.span(1) for m in URL_PASSWORD.finditer(text)]
    assigned: list[tuple[int, int]] = []
    for a, z in sorted(named, key=lambda x: (x[0], -x[1])):
        if not assigned or a >= assigned[-1][1]:
            assigned.append((a, z))
    spans, k = list(assigned), 0
    for m in CANDIDATE.finditer(text):
        a, z = m.span()
        if text[z - 1] == "=" and text[z : z + 1] in ('"', "'") and text[a - 1 : a] != text[z]:
            z = a + len(m[0].rstrip("="))  # the separator of name="value"
        while k < len(assigned) and assigned[k][1] <= a:
            k += 1
        if k == len(assigned) or assigned[k][0] >= z:
            spans.append((a, z))
    return sorted(spans)


def labelled_findings(words: list[str], n: int = FINDINGS, seed: int = 11) -> list[tuple[str, str, str, int]]:
    """(value, before, after, label) by rule; half of them secrets."""
    rng = random.Random(seed)
    words = words or ["alpha", "beta", "gamma", "delta", "report", "house"]
    hexa, base = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    key = lambda alphabet, k: "".join(rng.choice(alphabet) for _ in range(k))
    word = lambda: rng.choice(words)
    sentence = lambda: " ".join(word() for _ in range(rng.randint(1, 5)))
    names = ["token", "api_key", "secret", "password", "access_key", "auth_token", "client_secret", "API-KEY", "Bearer", "private_key"]
    out = []
    for k in range(n):
        quote = rng.choice(['"', '"', "'", ""])
        if k % 2:
            form = rng.randrange(10)
            if form == 0:  # a password that someone made up, quoted or not
                value = word()[:8] + rng.choice(["", "_", "!", "#", "$"]) + rng.choice([str(rng.randint(1, 9999)), key(base[52:], 2) + rng.choice("!?#$%&*")])
                value += key(base, max(0, 8 - len(value)))
                out.append((value, f"{sentence()} {rng.choice(['password', 'passwd', 'db_password', 'pwd', 'secret'])}{rng.choice([' = ', '=', ': '])}{quote}"[-CONTEXT:], quote + " " + word(), 1))
            elif form == 1:  # words joined by blanks
                quote = rng.choice("\"'")
                out.append((" ".join(word() if rng.random() < 0.75 else key(base[26:52], rng.randint(2, 3)) for _ in range(rng.randint(3, 6))), f"{sentence()} {rng.choice(['password', 'passphrase', 'secret', 'master_password'])}{rng.choice([' = ', ': '])}{quote}"[-CONTEXT:], quote + rng.choice(["", ",", " " + word()]), 1))
            elif form == 2:
                value = rng.choice([lambda: key(base[:52], rng.randint(16, 40)), lambda: key(base[26:52], rng.randint(20, 40)), lambda: base[26:52], lambda: key(base, rng.randint(16, 60))])()
                out.append((value, f"{sentence()} {rng.choice(['Authorization: Bearer ', 'authorization: Bearer ', 'Bearer ', 'Authorization: Basic '])}"[-CONTEXT:], rng.choice(["", " " + word(), '"']), 1))
            elif form == 3:
                value = rng.choice([lambda: key(base, rng.randint(6, 24)), lambda: word() + str(rng.randint(1, 999)), lambda: key(base[52:] + base[26:52] + "!$%*-_", rng.randint(8, 20))])()
                out.append((value, f"{sentence()} {rng.choice(['postgres', 'mysql', 'https', 'amqp', 'redis', 'mongodb'])}://{rng.choice(['', 'admin', 'root', word()])}:"[-CONTEXT:], f"@{word()}.{word()}"[:8], 1))
            if form < 4:
                continue
            value = rng.choice([lambda: key(hexa, rng.choice([20, 24, 32, 40, 48, 64])), lambda: key(base, rng.randint(16, 64)), lambda: key(base + "+/", rng.choice([40, 44, 64])), lambda: rng.choice(["sk_live_", "ghp_", "AKIA", "xoxb-", "glpat-"]) + key(base, rng.randint(16, 36)), lambda: key(base + "_-.", rng.randint(12, 40))])()
            sep = rng.choice([" = ", "=", ": ", " => "])
            before = f"{sentence()} {rng.choice(names)}{sep}{quote}" if rng.random() < 0.92 else f"{sentence()} {quote}"
            out.append((value, before[-CONTEXT:], quote + " " + word(), 1))
            continue
        kind = rng.choice([*range(14), 11, 12])
        value, before = [
            lambda: (key(hexa, rng.choice([32, 40, 64])), f"{sentence()} {rng.choice(['sha256:', 'md5 ', 'commit ', 'checksum: ', 'etag=', 'revision '])}{quote}"),
            lambda: ("/".join([word(), word(), f"{word()}{rng.randint(1, 99)}.{rng.choice(['html', 'js', 'png', 'txt'])}"]), f"{sentence()} {rng.choice(['https://', 'file ', 'path: ', '/'])}"),
            lambda: (f"{word()}-{rng.randint(1, 20)}.{rng.randint(0, 9)}.{rng.randint(0, 9)}-{word()}", f"{sentence()} {rng.choice(['version ', '', 'release '])}"),
            lambda: (rng.choice(["your_token_here_1", "xxxxxxxxxxxxxxxx1", "changeme12345678", "example-key-0000", "abcd1234abcd1234", "test-token-123456"]), f"{sentence()} {rng.choice(names)} = {quote}"),
            lambda: ("".join(word() for _ in range(rng.randint(2, 4))) + str(rng.randint(1, 2030)), f"{sentence()} "),
            lambda: (f"{word()}_{word()}_{rng.randint(1, 9999):06d}", f"{sentence()} {rng.choice(['id=', 'name: ', 'row ', ''])}{quote}"),
            lambda: ("-".join([key(hexa, 8), key(hexa, 4), key(hexa, 4), key(hexa, 4), key(hexa, 12)]), f"{sentence()} {rng.choice(['uuid ', 'guid: ', 'id ', 'request '])}{quote}"),
            lambda: ("-".join([key(base[:26], rng.randint(2, 4)), *(key(rng.choice([base[:26], base[52:], base[52:]]), rng.randint(1, 6)) for _ in range(rng.randint(2, 4)))]), f"{sentence()} {rng.choice(['number ', 'no. ', '', 'model '])}"),
            lambda: ("-".join([word().title(), word().title(), f"{key(base[:26], 1)}{rng.randint(1, 9999)}{rng.choice(['', 'w', 'x', 'b'])}", word()]), f"{sentence()} "),
            lambda: (rng.choice("_.").join([word(), word(), str(rng.randint(1900, 2030)), rng.choice(["v2", "final", "docx", "bak"])]), f"{sentence()} {rng.choice(['name ', 'file ', ''])}"),
            lambda: (f"20{rng.randint(10, 30)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}T{rng.randint(10, 23)}.{rng.randint(10, 59)}.00Z", f"{sentence()} "),
            # What stands where a secret would: prose about it, code that reads it, words behind "bearer".
            lambda: (rng.choice(["your {} here", "enter your {} here", "must be {} characters or more", "see the {} manual for {}", "not set for this {}", "the {} is required", "ask the {} for it", "your {} {} {}", "{} should not be {} or {}", "to {} with {}", "{} {} from the {}"]).replace("{}", word()), f"{sentence()} {rng.choice(names)}{rng.choice([' = ', ': '])}{rng.choice(chr(34) + chr(39))}"),
            lambda: (rng.choice(["${{{0}_{1}}}", "os.environ[{0}]", "get_{0}({1}_1)", "{0}.{1}(2)", "self.{0}.{1}_2", "{{{{{0}.{1}}}}}", "$({0} {1}_1)".replace(" ", "_"), "%{0}_{1}%"]).format(word().upper(), word()), f"{sentence()} {rng.choice(names)}{rng.choice([' = ', '=', ': '])}"),
            lambda: ("".join(word() for _ in range(rng.randint(2, 3)))[:30].ljust(16, "s"), f"{sentence()} {rng.choice(['bearer ', 'Bearer ', 'Basic '])}"),
        ][kind]()
        out.append((value, before[-CONTEXT:], quote + " " + word(), 0))
    return out


def words_alone(counts: Counter) -> Counter:
    """Words of 4 to 14 letters among the white-space delimited tokens counted, without marks around them."""
    out: Counter = Counter()
    for token, n in counts.items():
        w = token.strip(MARKS)
        if 4 <= len(w) <= 14 and w.isalpha():
            out[w] += n
    return out


def dictionary(docs: DataFrame, text_col: str, share: float = WORD_SHARE) -> dict[str, int]:
    """The words that make up at least ``share`` of the words of all documents, with their counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Counter = Counter()

        def rows() -> pa.RecordBatch:
            found = words_alone(own)
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["w", "n"])

        for b in batches:
            for t in b.column(0).to_pylist():
                own.update((t or "").lower().split())
                if len(own) > 300_000:
                    yield rows()
                    own.clear()
        yield rows()

    words = materialize(docs.select(F.col(text_col).cast("string").alias("t")).mapInArrow(count, "w string, n long").groupBy("w").agg(F.sum("n").alias("n")))
    total = words.agg(F.sum("n")).first()[0] or 0
    return {r.w: r.n for r in words.where(F.col("n") >= share * total).collect()}


def fit_forest(spark, words: dict[str, int], trees: int = 30, depth: int = 8):
    known, transitions = frozenset(words), transition_table(words)
    found = labelled_findings(sorted(words)[:: max(1, len(words) // 3000)])
    rows = [(*features(v, b, a, known, transitions), float(y)) for v, b, a, y in found]
    data = VectorAssembler(inputCols=FEATURES, outputCol="x").transform(spark.createDataFrame(rows, [*FEATURES, "label"]).repartition(4))
    return RandomForestClassifier(featuresCol="x", numTrees=trees, maxDepth=depth, seed=5).fit(data.select("x", "label"))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """(doc_id, start, end, value, score, is_secret) of each candidate; positions in code points."""
    spark = docs.sparkSession
    words = dictionary(docs, text_col)
    forest = fit_forest(spark, words)
    sent = spark.sparkContext.broadcast((frozenset(words), transition_table(words)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, transitions = sent.value
        for b in batches:
            ids, starts, ends, values, x = [], [], [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for a, z in candidates(t or ""):
                    ids.append(i)
                    starts.append(a)
                    ends.append(z)
                    values.append(t[a:z])
                    x.append(features(t[a:z], t[max(0, a - CONTEXT) : a], t[z : z + 8], known, transitions))
            x = np.array(x, float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(values, pa.string()), *(pa.array(x[:, k]) for k in range(len(FEATURES)))], names=["doc_id", "start", "end", "value", *FEATURES])

    schema = "doc_id long, start int, end int, value string, " + ", ".join(f"{f} double" for f in FEATURES)
    found = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(scan, schema)
    scored = forest.transform(VectorAssembler(inputCols=FEATURES, outputCol="x").transform(found))
    score = vector_to_array("probability")[1]
    return scored.select("doc_id", "start", "end", "value", score.alias("score")).withColumn("is_secret", F.col("score") >= threshold)
