"""Language, personal data, secrets: held-out accuracy and plain versions of the searches."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from seasonframe.llm.language_id import (Model, family_of, features, language_report,
                                         predict_language, train_model)
from seasonframe.llm.pii import find_pii, pii_report
from seasonframe.llm.secrets import _BASE62, redact, redact_secrets, scan, secret_report
from seasonframe.llm.workers import importable

SF = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True)
def on_path(spark):
    importable(spark)


# language

def test_families():
    assert family_of("en") == family_of("de-AT") == "germanic"
    assert family_of("fr") == family_of("ES") == "romance"
    assert family_of("xx") == "xx"


def test_features_do_not_depend_on_where_long_texts_are_cut():
    text = "Der schnelle Fuchs. " * 30_000
    assert abs(features(text) - features(text[:20 * 3000])).max() < 1e-2
    assert features(None) is features("") is features("12 !?") is None


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language_report(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got["doc_id"]]).all()
    unseen = got[got["held_out"]]
    assert len(got) == docs.count() and (unseen["lang"] == unseen["lang_pred"]).mean() > 0.95
    assert got["score"].between(0, 1).all()


def test_language_edges(spark):
    rows = [(i, f"the cat sat on the mat {i}", "en", "a") for i in range(8)]
    rows += [(i, f"der hund und die katze {i}", "de", "b") for i in range(8, 16)]
    rows += [(i, f"le chat et la souris dans la maison {i}", "fr", "c") for i in range(16, 24)]
    rows += [(None, None, None, None), (30, "", "en", "x"), (31, "123 ###", None, "x"),
             (32, "the cat and the mat", None, "x"), (32, "the cat and the mat", None, "x")]
    data = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = [tuple(r) for r in language_report(data).collect()]
    assert len(got) == len(rows)
    assert sorted(r[2] for r in got if r[0] in (None, 30, 31)) == ["und"] * 3
    assert {r[2] for r in got if r[0] == 32} == {"en"}
    model = train_model(data)
    assert isinstance(model, Model) and set(model.duels) == {("de", "en")}
    kept = predict_language(data, model, into=("lang_pred", "sure"))
    assert kept.columns == ["doc_id", "text", "lang", "score", "lang_pred", "sure"]
    assert train_model(data.limit(0)) is None
    assert language_report(data.limit(0)).collect() == []


# personal data

def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


PII = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v, d: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
           lambda v, d: all(int(x) <= 255 for x in v.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda v, d: 16 <= len(d) <= 19 and luhn(d)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda v, d: 8 <= len(d) <= 15),
}


def plain_pii(text):
    spans = [(k, m.start(), m.end()) for k, (p, ok) in PII.items() for m in re.finditer(p, text or "")
             if ok(m.group(), re.sub("[^0-9]", "", m.group()))]
    joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    return [sum(s[0] == k for s in spans) for k in PII] + [hashlib.sha256(joined.encode()).hexdigest()]


def test_pii_base_spans_are_those_of_the_plain_patterns(spark):
    rng = random.Random(5)
    parts = ["a", ".", "@", "1", "9", "+", "-", " ", "(", ")", "_", "255", "300", "b.c", "x@y.z",
             "4111 1111 1111 1111", "", "\U0001f600", "1.2.3.4", "+49 30 ", "12345", "0255"]
    texts = ["".join(rng.choice(parts) for _ in range(60)) for _ in range(1500)]
    texts += [None, "", "a." * 50_000 + "@b.c", "1." * 30_000, "9" * 50_000, "a@b" + ".c" * 50_000,
              "x@y.z " * 3000, "+1" + "2 " * 30_000, "x@y.z", "x@y.z"]
    data = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii_report(data).collect():
        assert list(r)[1:6] == plain_pii(texts[r["doc_id"]]), texts[r["doc_id"]]


def test_pii_checksums_and_context(spark):
    cases = {"iban DE89 3704 0044 0532 0130 00": ["iban:5:32"], "DE88 3704 0044 0532 0130 00": [],
             "ssn: 123-45-6789": ["ssn:5:16"], "lot 123-45-6789": [],
             "call (555) 123-4567": ["tel:5:19"], "part (555) 123-4567": []}
    data = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii_report(data).collect()}
    assert [got[i] for i in range(len(cases))] == [",".join(v) for v in cases.values()]
    scores = {r["text"]: r["pii"][0]["score"] for r in find_pii(spark.createDataFrame(
        [("my mail a@b.cd",), ("see a@b.cd",)], "text string")).collect()}
    assert scores["my mail a@b.cd"] > scores["see a@b.cd"]


def test_pii_edges(spark):
    data = spark.createDataFrame([(None, None, 1), (1, "", 2), (1, "a@b.cd", 3), (1, "a@b.cd", 3)],
                                 "doc_id long, text string, pii int")
    assert sorted(r["spans"] for r in pii_report(data).collect()) == ["", "", "email:0:6", "email:0:6"]
    assert find_pii(data, into="found").columns == ["doc_id", "text", "pii", "found"]
    assert pii_report(data.limit(0)).collect() == []


def test_pii_context_reaches_over_lists_and_behind(spark):
    many = "SSNs: " + "ab@cd.ef 12-34-56 " * 2 + "123-45-6789"  # other kinds and numbers between
    spread = "Tel: " + ", ".join(["212-555-1234"] * 3)
    texts = {
        "SSNs: 123-45-6789, 234-56-7890": [("ssn", 6), ("ssn", 19)],
        "Tel: 212-555-1234 or 212-555-9999": [("tel", 5), ("tel", 21)],
        "123-45-6789 is my SSN": [("ssn", 0)],
        "123-45-6789, 234-56-7890 are SSNs": [("ssn", 0), ("ssn", 13)],
        spread: [("tel", 5 + 14 * i) for i in range(3)],
        many: [("ssn", 42)],
        "ssn " + "x" * 60 + " 123-45-6789": [],
        "123-45-6789 " + "x" * 60 + " ssn": [],
    }
    rows = find_pii(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    assert {r.text: [(s.kind, s.start) for s in r.pii if s.kind in ("ssn", "tel")]
            for r in rows} == texts


def test_pii_context_crosses_blocks(spark):
    number = "123-45-6789"
    for before in (127, 128, 129, 255, 256, 257):  # pieces are put together 256 at a time
        text = f"{number} " * (before - 1) + f"{'.' * 60} SSN {number} {number}{'.' * 60}"
        text += f" {number}" + f" {number}" * 2 + " ssn"
        found = find_pii(spark.createDataFrame([(text,)], "text string")).first().pii
        at = [m.start() for m in re.finditer(number, text)]
        near = [i for i in at if re.search(
            r"\bssn", text[max(0, i - 48):i].lower()) or re.search(
            r"\bssn", text[i + 11:i + 59].lower())]
        assert [s.start for s in found if s.kind == "ssn"] == near and len(near) > 3


def test_pii_runs_no_python(spark):
    plan = pii_report(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


# secrets

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
                    r"([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)


def plain_secrets(text):
    spans = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    spans += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text)
              if len(m.group()) >= 16]
    spans += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text)
              if len(m.group()) >= 32]
    return sorted(spans, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


def test_secret_base_spans_are_those_of_the_plain_patterns():
    rng = random.Random(9)
    parts = ["password", "PassWd", "secret", "tokentoken", "api_key", "APIKEY", "=", ":", " ", "'",
             '"', "abc", "longvalue123", "AKIA", "ABCD1234EFGH", "0a1b2c3d4e5f6789", "deadbeef", "x",
             "ſecret", "İ", "\U0001f600", "akia"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(25))
        base = [s for s in scan(text) if s[0] in ("assign", "access", "hex")]
        assert base == plain_secrets(text), text
    assert scan("password" * 20_000) == [] and scan(None) == scan("") == []


def test_embedded_checksums():
    body = "a1B2c3D4e5F6g7H8i9J0k1L2m3N4o5"
    value, check = zlib.crc32(body.encode()), ""
    while value:
        value, digit = divmod(value, 62)
        check = _BASE62[digit] + check
    good = "ghp_" + body + check.rjust(6, "0")
    assert scan(f"x {good}.") == [("crc_token", 2, 42)]
    assert scan("x " + good[:-1] + ("0" if good[-1] != "0" else "1")) == []
    assert scan("eyJhbGciOiJIUzI1NiJ9.e30abcd.c2lnbmF0dXJl")[0][0] == "signed_token"
    assert scan("eyJxxxxxxxxxxxxxxxx9.e30abcd.c2lnbmF0dXJl") == []


def test_redaction(spark):
    text = "a token: 0123456789abcdef0123456789abcdef b"
    assert redact(text, scan(text)) == "a [SECRET] b"
    data = spark.createDataFrame([(1, text), (2, None), (3, ""), (3, "clean")],
                                 "doc_id long, text string")
    got = sorted((r["doc_id"], r["redacted"]) for r in redact_secrets(data).fillna("~").collect())
    assert got == [(1, "a [SECRET] b"), (2, "~"), (3, ""), (3, "clean")]
    report = {(r["doc_id"], r["n_assign"], r["n_hex"], r["spans"]) for r in
              secret_report(data).collect()}
    assert report == {(1, 1, 1, "assign:2:41,hex:9:41"), (2, 0, 0, ""), (3, 0, 0, "")}
    assert secret_report(data.limit(0)).collect() == []
    assert secret_report(data.withColumn("spans", F.lit(1))).columns[-1] == "spans"


# long texts

def test_keywords_that_fill_a_run_are_tried_once_per_run(monkeypatch):
    from seasonframe.llm import secrets
    tried = []

    class Counted:
        def __init__(self, pattern):
            self.pattern = pattern

        def match(self, text, at):
            tried.append(at)
            return self.pattern.match(text, at)
    automaton, patterns = secrets._search()
    monkeypatch.setattr(secrets, "_search", lambda: (
        automaton, [(Counted(p), run) for p, run in patterns]))
    assert secrets.scan("eyJ" * 350_000) == [] and len(tried) == 1
    tried.clear()
    assert secrets.scan("eyJeyJeyJeyJ.eyJa.x " * 1000) == [] and len(tried) == 2000


def test_signed_token_behind_a_run_that_fails():
    import base64
    head = base64.urlsafe_b64encode(b'{"alg": "HS256"}').decode().rstrip("=")
    token = f"{head}.{'a' * 12}.{'b' * 12}"
    text = f"eyJeyJeyJeyJ {token} eyJ{token}"
    found = [s for s in scan(text) if s[0] == "signed_token"]
    assert found == [("signed_token", 13, 13 + len(token))]


def test_pii_in_a_long_table_of_numbers(spark):
    """Three levels of blocks; places stay right to the end."""
    unit = "12 x "
    text = unit * 60_000 + "mail a@b.cd"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = pii_report(df).first()
    at = len(unit) * 60_000 + 5
    assert r["spans"] == f"email:{at}:{at + 6}"
