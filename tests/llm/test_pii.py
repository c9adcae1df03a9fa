import hashlib
import re
import time

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from inkstone.llm import pii

from .conftest import prose, rows

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def valid_card(text):
    digits = [int(c) for c in text if c.isdigit()]
    total = sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(reversed(digits)))
    return 13 <= len(digits) <= 19 and total % 10 == 0


def brute(text):
    text = text or ""
    return (
        [("email", *m.span()) for m in EMAIL.finditer(text)]
        + [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
        + [("card", *m.span()) for m in CARD.finditer(text) if valid_card(m[0])]
        + [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    )


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a.@-+ 0123456789()é%_", max_size=60))
def test_base_same_as_patterns(text):
    assert pii.base_spans(text) == brute(text)


def test_base_of_realistic_texts():
    for text in ("a@b.c@d.e x.y@z", "1.2.3.4.5.6.7.8 300.1.1.1 001.02.3.255", "4111 1111-1111 1111 and 4111111111111112", "+1 (499) 555-6503, +49 30 1234", "++1 2 3 4 5 6 7 8 9", "a@b a@b.c.", "@@x@y.z"):
        assert pii.base_spans(text) == brute(text)


def test_long_runs_are_linear():
    began = time.time()
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "a@" * 150_000, "+1" + " " * 300_000, "1 " * 150_000, "at " * 100_000 + "(at)"):
        pii.examine(text)
    assert time.time() - began < 20


def test_digests_same_as_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    found = {r["doc_id"]: r for r in pii.digests(pii.find(spark, docs)).collect()}
    for r in docs.collect():
        base = brute(r["text"])
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        row = found[r["doc_id"]]
        assert [row[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in base) for k in pii.KINDS]
        assert row["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert set(joined.split(",")) <= set(row["spans"].split(","))


def test_method_finds_what_the_base_misses(spark):
    docs = [(k, prose(10, k) + f" call +1 ({200 + k}) 555-{1000 + k} or mail u{k}@mail.example.com " + prose(5, k)) for k in range(60)]
    docs += [(100, "phone +1 (269) 555-3296 4111111111111111 " + prose(5, 1)), (101, "mail me: jane [at] example [dot] com"), (102, "version 123 456 7890 of order id no 555 123 4567"), (103, prose(50, 3))]
    found = {r["doc_id"]: r["spans"] for r in pii.digests(pii.find(spark, spark.createDataFrame(docs, "doc_id long, text string"))).collect()}
    text = docs[60][1]
    start = text.index("+1")
    assert f"phone:{start}:{start + 17}" in found[100]
    assert found[103] == ""


def _planted(rng):
    """(kind or None for a decoy, text) of one thing that no base pattern matches."""
    digits = lambda n: "".join(rng.choice(list("0123456789"), n))
    name, host, tld = rng.choice(["ana", "john", "mary.lee", "k_weber", "rui"]), rng.choice(["mail", "example", "corp-site", "inbox"]), rng.choice(["com", "org", "de", "net"])
    area = str(rng.integers(200, 999))
    which = rng.integers(12)
    if which < 3:
        return "email", (f"{name} at {host} dot {tld}", f"{name}[at]{host}[dot]{tld}", f"{name} (at) {host} (dot) {tld}")[which]
    if which < 5:
        parts = [f"{rng.integers(1, 65536):x}" for _ in range(7)]
        return "ip", ("2001:" + ":".join(parts), "fe80::" + ":".join(parts[:4]))[which - 3]
    if which == 5:
        body = "4" + digits(14)
        body += next(d for d in "0123456789" if pii.luhn(body + d))
        return "card", ".".join(body[k : k + 4] for k in (0, 4, 8, 12))
    if which < 8:
        return "phone", (f"{area}-{rng.integers(200, 999)}-{digits(4)}", f"({area}) {rng.integers(200, 999)}-{digits(4)}")[which - 6]
    return None, (f"version {digits(3)} {digits(3)} {digits(4)}", f"isbn {digits(3)}-{digits(3)}-{digits(4)}", f"at {digits(2)}:{digits(2)}:{digits(2)} sharp", f"look at the dot {tld}")[which - 8]


def test_recall_and_precision_of_planted_spans(spark):
    rng = np.random.default_rng(7)
    docs, truth = [], {}
    for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("length(text) < 4000").orderBy("doc_id").collect():
        text = r["text"]
        if rng.random() < 0.15:
            kind, planted = _planted(rng)
            text = f"{text}\n{planted}"
            truth[r["doc_id"]] = (kind, len(text) - len(planted), len(text), text)
        docs.append((r["doc_id"], text))
    found = {r["doc_id"]: r for r in pii.digests(pii.find(spark, spark.createDataFrame(docs, "doc_id long, text string").repartition(8))).collect()}
    for kind in pii.KINDS:
        own = {d: t for d, t in truth.items() if t[0] == kind}
        hit = sum(f"{kind}:{a}:{b}" in found[d]["spans"].split(",") for d, (_, a, b, _) in own.items())
        assert len(own) > 40 and hit >= 0.9 * len(own), (kind, hit, len(own))
        added = [d for d, (_, a, b, text) in truth.items() for s in set(found[d]["spans"].split(",")) - {f"{k}:{x}:{y}" for k, x, y in brute(text)} if s.startswith(f"{kind}:") and int(s.split(":")[1]) >= a]
        assert sum(truth[d][0] == kind for d in added) >= 0.95 * len(added), (kind, added)
    for d, (_, _, _, text) in truth.items():
        assert found[d]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in brute(text)).encode()).hexdigest()


def test_spans_beyond_the_base_in_the_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    assert pii.find(spark, docs).filter("size(spans) > size(base)").count() > 0


def test_expectation_maximisation_recovers_reliabilities():
    rng = np.random.default_rng(2)
    truth = rng.random(20_000) < 0.4
    right = np.stack([rng.random(20_000) < p for p in (0.95, 0.8, 0.7)], axis=1)
    votes = np.where(right == truth[:, None], 2, 0)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    posterior, table, prior = pii.expectation_maximisation(patterns, counts.astype(float), (0.6, 0.6, 0.6))
    assert abs(prior - 0.4) < 0.03
    assert np.abs(np.array([table[1, j, 2] for j in range(3)]) - [0.95, 0.8, 0.7]).max() < 0.03


def test_odd_rows(spark, odd, empty):
    found = pii.digests(pii.find(spark, odd))
    assert found.count() == odd.count() and not found.filter("n_email + n_ip + n_card + n_phone > 0 or spans is null").count()
    assert pii.find(spark, empty).count() == 0
    redacted = pii.redact(spark, odd)
    assert redacted.schema == odd.schema and rows(redacted, "*") == rows(odd, "*")


def test_redaction(spark):
    frame = spark.createDataFrame([(1, "mail a@b.co, ip 1.2.3.4!", 7), (2, None, 8)], "doc_id long, text string, other long")
    assert rows(pii.redact(spark, frame), "*") == [(1, "mail [EMAIL], ip [IP]!", 7), (2, None, 8)]
    assert pii.redact_text("0123456789", [("ip", 2, 6), ("card", 4, 8), ("phone", 9, 10)]) == "01[IP]8[PHONE]"
