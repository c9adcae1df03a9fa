"""Personal data by weak supervision.

Base patterns find e-mail addresses, IPv4 addresses, payment cards and telephone numbers;
they always count.  Looser patterns give candidates for spans that the base misses.
Regex, gazetteer and context labelers vote for or against every candidate and every base
span, or abstain.  Expectation-maximisation over the vote patterns of the whole corpus
estimates how often each labeler is right when it votes.  Its posteriors are the targets
of a logistic classifier over votes, the span's characters and the words around it,
which decides on the candidates.  Reliabilities come from counts of vote patterns, of
which there are a fixed number; the classifier is fitted on a bounded sample of spans, so
nothing that grows with the corpus reaches the driver.

Every pattern is scanned in time linear in the text.
"""

from __future__ import annotations

import bisect
import ipaddress
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import Workspace

KINDS = ("email", "ip", "card", "phone")
#: Probability from which a candidate becomes a span.
ACCEPT = 0.9
#: Characters on either side that context labelers read.
CONTEXT = 40
#: Spans of a kind that the classifier is fitted on (about: drawn by a hash of the texts).
SAMPLE_SPANS = 4_000
#: Buckets of hashed character and context features.
BUCKETS = 256
#: Least shares of right votes that labelers are believed to have, in their order (none but those that start beyond it gets
#: more than MOST_RIGHT); and the most that the share of true spans is.
LEAST_RIGHT, MOST_RIGHT, MOST_TRUE = (0.75, 0.99, 0.75, 0.97, 0.8), 0.95, 0.9

# The base patterns.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

# Looser patterns for candidates.
_LOOSE = {
    "email": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}\x20?(?:\[at\]|\(at\)|\{at\}|<at>|\x20at\x20)\x20?[A-Za-z0-9-]{1,63}(?:(?:\x20?(?:\[dot\]|\(dot\)|\{dot\}|<dot>)\x20?|\x20dot\x20|\.)[A-Za-z0-9-]{1,63}){1,5}", re.I),
    "ip": re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:{1,2}){2,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"),
    "card": re.compile(r"(?<![0-9])(?=((?:[0-9]{13,19}|[0-9]{4}(?:[\x20./_-][0-9]{4}){2}[\x20./_-][0-9]{1,7})(?![0-9])))"),
    "phone": re.compile(r"(?<![0-9+.-])(?:(?:\+|00)[1-9][0-9]{0,2}[\x20.-]?)?(?:\([0-9]{2,4}\)\x20?|[0-9]{2,4}[\x20.-])[0-9]{3,4}[\x20.-][0-9]{4}(?![0-9])"),
}

# Gazetteers and context words.
_TLDS = frozenset("com org net edu gov int info biz name io co uk de fr es it nl ch at be se no dk fi pl pt ie eu us ca au nz jp cn in br mx".split())
_ISSUERS = re.compile(r"4|5[1-5]|2[2-7]|3[47]|6011|65|35")
_CALLING = re.compile(r"\+?(?:00)?(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|35[0-9]|37[0-9]|38[0-9]|42[0-9])")
_NEAR = {
    "email": frozenset("email e-mail mail contact write reach send address correo courriel".split()),
    "ip": frozenset("ip ipv4 ipv6 host server address login client subnet gateway".split()),
    "card": frozenset("card visa mastercard amex credit debit payment pay tarjeta carte karte".split()),
    "phone": frozenset("phone tel telephone call mobile cell fax whatsapp contact telefon telefono".split()),
}
_AGAINST = frozenset("version release section chapter page isbn issn order invoice item sku serial build revision rev id no".split())
_WORDS = re.compile(r"[^\W_]+(?:-[^\W\d_]+)?")

_STOP = frozenset("the a an it this that there here look looks look arrive arrived at is was be to of in on and or for by".split())

#: Labelers in the order of a pattern's votes: a regex of the usual form, arithmetic, a gazetteer, words near by, characters beside.
LABELERS = ("form", "arithmetic", "gazetteer", "context", "beside")
PATTERNS = 3 ** len(LABELERS)
AGAINST, NONE, FOR = 0, 1, 2


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if k % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            last = found.end()
            yield start, last
        at = text.find("@", max(at + 1, last))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns, by kind, then start; code points."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13 and 13 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


_AT = re.compile(r"@|[\[({<]at[\])}>]", re.I)
_GROUPS = re.compile(r"[0-9]{13,19}|[0-9]{4}([\x20./_-])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{4}([\x20-])[0-9]{6}\2[0-9]{5}")
_DIALLED = re.compile(r"(?:\+|00)[1-9]|\(")
_NATIONAL = re.compile(r"\(?[2-9][0-9]{2}\)?[\x20.-]*[2-9][0-9]{2}[\x20.-][0-9]{4}")
_NETWORK = re.compile(r"(?:10|127|192\.168|172)\.|fe80:|2[0-9a-f]{3}:|f[cd][0-9a-f]{2}:|::1$", re.I)


def _email_votes(span: str) -> tuple[int, int, int]:
    parts = [p for p in re.split(r"[^A-Za-z0-9]+", re.sub(r"(?i)[\[({<](at|dot)[\])}>]|\x20(at|dot)\x20", "@", span)) if p]
    form = FOR if _AT.search(span) else NONE
    fits = len(parts) > 1 and parts[-1].isalpha() and 2 <= len(parts[-1]) <= 24 and (form == FOR or not {parts[0].lower(), parts[1].lower()} & _STOP)
    return form, FOR if fits else AGAINST, FOR if parts and parts[-1].lower() in _TLDS else AGAINST


def _ip_votes(span: str) -> tuple[int, int, int]:
    try:
        address = ipaddress.ip_address(span)
    except ValueError:
        return AGAINST, AGAINST, FOR if _NETWORK.match(span) else NONE
    usual = not (address.is_unspecified or address.is_multicast or address.is_reserved)
    return FOR, FOR if usual else NONE, FOR if _NETWORK.match(span) else NONE


def _card_votes(span: str) -> tuple[int, int, int]:
    digits = "".join(c for c in span if "0" <= c <= "9")
    return FOR if _GROUPS.fullmatch(span) else AGAINST, FOR if luhn(digits) else AGAINST, FOR if _ISSUERS.match(digits) else AGAINST


def _phone_votes(span: str) -> tuple[int, int, int]:
    dialled, n = bool(_DIALLED.match(span)), sum("0" <= c <= "9" for c in span)
    national = bool(_NATIONAL.fullmatch(span))
    # ten digits alone say little
    fits = (FOR if 9 <= n <= 15 else AGAINST) if dialled else NONE if n == 10 else AGAINST
    return FOR if dialled or national else NONE, fits, FOR if national or dialled and _CALLING.match(span) else NONE


_OWN_VOTES = {"email": _email_votes, "ip": _ip_votes, "card": _card_votes, "phone": _phone_votes}


def _judged(text: str, kind: str, start: int, end: int) -> tuple[int, list[int]]:
    """The labelers' votes as a number in base 3, and the buckets of the span's characters and its surroundings."""
    span = text[start:end]
    left, right = text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT // 2]
    before, after = [w.lower() for w in _WORDS.findall(left)], [w.lower() for w in _WORDS.findall(right)]
    near = {*before, *after}
    context = FOR if near & _NEAR[kind] else AGAINST if _AGAINST.intersection(before[-3:]) else NONE
    a, b = left[-1:], right[:1]
    glued = a.isalnum() or b.isalnum() or a in ("#", "$", "_", "=", "/", "-", "~") and a or b in ("%", "_", "=", "/") and b
    votes = (*_OWN_VOTES[kind](span), context, AGAINST if glued else NONE)
    code = 0
    for v in votes:
        code = code * 3 + v
    shape = re.sub(r"[A-Za-z]+", "a", re.sub(r"[0-9]", "9", span))[:32]
    said = [f"s{shape}", f"m{''.join(sorted(set(re.sub(r'[A-Za-z0-9]', '', span))))}", f"n{len(span) // 4}", f"d{sum('0' <= c <= '9' for c in span)}", f"l{a}", f"r{b}", f"b{(before or [''])[-1]}", f"a{(after or [''])[0]}"]
    return code, [zlib.crc32(x.encode("utf-8", "replace")) % BUCKETS for x in said]


Judged = tuple[str, int, int, int, list[int], bool]


def examine(text: str) -> tuple[list[tuple[str, int, int]], list[Judged]]:
    """Base spans, and all (kind, start, end, votes, buckets, is base) for voting: base spans and loose candidates that touch none."""
    base = base_spans(text)
    voted = [(k, a, b, *_judged(text, k, a, b), True) for k, a, b in base]
    loose = []
    digits = bool(_DIGIT.search(text))
    for kind in KINDS:
        if kind == "email":
            if not re.search(r"\bat\b", text, re.I) or not re.search(r"\bdot\b|[\[({<]at[\])}>]", text, re.I):
                continue
        elif not digits or kind == "ip" and "::" not in text and text.count(":") < 3:
            continue
        loose += [(kind, *m.span(m.re.groups)) for m in _LOOSE[kind].finditer(text)]
    candidates = [(k, a, b, *_judged(text, k, a, b)) for k, a, b in loose]
    taken: list[tuple[int, int]] = []  # disjoint and sorted
    for a, b in sorted((a, b) for _, a, b in base):
        if taken and a < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(b, taken[-1][1]))
        else:
            taken.append((a, b))
    # candidates with more votes in favour first, then from the left, longer ones first
    for kind, a, b, code, buckets in sorted(candidates, key=lambda c: (-sum(votes_of(c[3])[:3]), c[1], -c[2], KINDS.index(c[0]))):
        at = bisect.bisect_left(taken, (a, b))
        if (at == 0 or taken[at - 1][1] <= a) and (at == len(taken) or b <= taken[at][0]):
            taken.insert(at, (a, b))
            voted.append((kind, a, b, code, buckets, False))
    return base, voted


def votes_of(code: int) -> list[int]:
    votes = []
    for _ in LABELERS:
        votes.append(code % 3)
        code //= 3
    return votes[::-1]


def expectation_maximisation(votes: np.ndarray, counts: np.ndarray, least: tuple[float, ...] = LEAST_RIGHT, rounds: int = 500) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of each vote pattern, each labeler's share of votes by class, and the prior.

    votes: int[n, labelers] of AGAINST, NONE, FOR; counts: occurrences.  Given the class,
    labelers vote independently; whether one abstains says nothing.  Shares of right votes
    are estimated from ``least`` upwards: where all labelers mostly agree, the few votes
    against would otherwise pass for their errors.
    """
    favour, against = votes == FOR, votes == AGAINST
    posterior = (favour.sum(axis=1) + 0.5) / (favour.sum(axis=1) + against.sum(axis=1) + 1.0)
    for _ in range(rounds):
        right = []
        for share, side in ((posterior, favour), (1 - posterior, against)):
            right.append(np.clip(((counts * share) @ side + np.array(least)) / ((counts * share) @ (favour | against) + 1), least, np.maximum(least, MOST_RIGHT)))
        prior = min((counts @ posterior + 1) / (counts.sum() + 2), MOST_TRUE)
        true, false = right
        log = np.log(prior / (1 - prior)) + favour @ np.log(true / (1 - false)) + against @ np.log((1 - true) / false)
        now = 1 / (1 + np.exp(-np.clip(log, -60, 60)))
        if np.abs(now - posterior).max() < 1e-9:
            break
        posterior = now
    table = np.stack([np.stack([false, 0 * false, 1 - false], axis=1), np.stack([1 - true, 0 * true, true], axis=1)])
    return posterior, table, prior


class Classifier:
    """Logistic regression over votes, character and context features of one kind's spans."""

    def __init__(self, patterns: list[tuple[int, int]], sample: list[tuple[int, list[int]]], rounds: int = 60):
        """patterns: (votes, count) of the corpus; sample: (votes, buckets) of some spans.  Newton steps with a ridge."""
        votes = np.array([votes_of(p) for p, _ in patterns])
        posterior = dict(zip((p for p, _ in patterns), expectation_maximisation(votes, np.array([n for _, n in patterns], float))[0]))
        x, y = self.features(sample), np.array([posterior[p] for p, _ in sample])
        # votes are trusted more than single characters and words
        ridge = np.concatenate([[1e-3], np.full(2 * len(LABELERS), 0.1), np.full(BUCKETS, 3.0)])
        self.w = np.zeros(x.shape[1])
        for _ in range(rounds):
            p = self._sigmoid(x @ self.w)
            step = np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(ridge), x.T @ (y - p) - ridge * self.w)
            self.w += np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-7:
                break

    @staticmethod
    def _sigmoid(z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    @staticmethod
    def features(spans: list[tuple[int, list[int]]]) -> np.ndarray:
        votes, out = np.array([votes_of(p) for p, _ in spans]).reshape(-1, len(LABELERS)), np.zeros((len(spans), 1 + 2 * len(LABELERS) + BUCKETS))
        out[:, 0] = 1
        out[:, 1 : 1 + len(LABELERS)], out[:, 1 + len(LABELERS) : 1 + 2 * len(LABELERS)] = votes == FOR, votes == AGAINST
        for row, (_, buckets) in zip(out, spans):
            row[[1 + 2 * len(LABELERS) + b for b in buckets]] = 1
        return out

    def __call__(self, spans: list[tuple[int, list[int]]]) -> np.ndarray:
        return self._sigmoid(self.features(spans) @ self.w)


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


_SPAN = [("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("votes", pa.int32()), ("buckets", pa.list_(pa.int32())), ("base", pa.bool_())]
_VOTED = "array<struct<kind: string, start: long, end: long, votes: int, buckets: array<int>, base: boolean>>"


def _examined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [n for n, _ in _SPAN]
    for batch in batches:
        rows = [examine(t or "")[1] for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([[dict(zip(names, s)) for s in r] for r in rows], pa.list_(pa.struct(_SPAN)))], names=["doc_id", "voted"])


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _classifiers(voted: DataFrame, sample_spans: int) -> dict[str, Classifier]:
    """A classifier by kind; at most PATTERNS counts and about ``sample_spans`` spans of a kind reach the driver."""
    spans = voted.select("doc_id", F.explode("voted").alias("v")).select("doc_id", "v.*")
    counted = spans.groupBy("kind", "votes").count().collect()
    out = {}
    for kind in KINDS:
        patterns = sorted((r["votes"], r["count"]) for r in counted if r["kind"] == kind)
        if patterns:
            order = F.xxhash64("doc_id", "start", "end", "votes")
            share = min(1.0, 2 * sample_spans / sum(n for _, n in patterns))
            drawn = spans.filter(F.col("kind") == kind).select(order.alias("at"), "votes", "buckets").filter(F.pmod("at", F.lit(1_000_000)) < int(share * 1_000_000))
            drawn = drawn.orderBy("at", "votes", "buckets").limit(sample_spans)
            if rows := drawn.collect():
                out[kind] = Classifier(patterns, [(r["votes"], r["buckets"]) for r in rows])
    return out


def _accepted(spans: list[Judged], classifiers: dict[str, Classifier], accept: float) -> list[tuple[str, int, int]]:
    """Base spans and the candidates that their kind's classifier takes."""
    out = [s[:3] for s in spans if s[5]]
    for kind, judge in classifiers.items():
        if open_ := [s for s in spans if not s[5] and s[0] == kind]:
            out += [s[:3] for s, p in zip(open_, judge([(s[3], s[4]) for s in open_])) if p >= accept]
    return sorted(out, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def find(spark: SparkSession, docs: DataFrame, *, accept: float = ACCEPT, sample_spans: int = SAMPLE_SPANS) -> DataFrame:
    """Per document: doc_id, base and spans, each an array of struct<kind, start, end> by kind, then start.

    Offsets are code points, ends exclusive.  Null or empty texts have no spans; a null id
    stays null; repeated rows are answered one by one; other columns are ignored; an empty
    table gives an empty result.  spans hold all of base; an added span overlaps no other.
    """
    work = Workspace(spark, "pii")
    voted = work.save(_texts(docs).mapInArrow(_examined, f"doc_id long, voted {_VOTED}"), "voted")
    known = spark.sparkContext.broadcast(_classifiers(voted, sample_spans))
    struct = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, spans = [], []
            for row in batch.column("voted").to_pylist():
                judged = [tuple(s.values()) for s in row]
                for out, some in ((base, _accepted([s for s in judged if s[5]], {}, accept)), (spans, _accepted(judged, known.value, accept))):
                    out.append([dict(zip(("kind", "start", "end"), s)) for s in some])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(base, pa.list_(struct)), pa.array(spans, pa.list_(struct))], names=["doc_id", "base", "spans"])

    kind = "array<struct<kind: string, start: long, end: long>>"
    return voted.mapInArrow(chosen, f"doc_id long, base {kind}, spans {kind}")


def digests(found: DataFrame) -> DataFrame:
    """Counts of base spans, the digest of their places, all spans as a string, and their number."""
    place = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))

    def of_kind(kind: str):
        return lambda s: s["kind"] == kind

    counts = [F.size(F.filter("base", of_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    joined = [F.concat_ws(",", F.transform(c, place)) for c in ("base", "spans")]
    return found.select("doc_id", *counts, F.sha2(joined[0], 256).alias("base_sha256"), joined[1].alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def redact_text(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span, or run of overlapping spans, replaced by its (first) kind in brackets."""
    out, last = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2], KINDS.index(s[0]))):
        if a >= last:
            out += [text[last:a], f"[{kind.upper()}]"]
        last = max(last, b)
    return "".join([*out, text[last:]])


def redact(spark: SparkSession, docs: DataFrame, *, accept: float = ACCEPT, sample_spans: int = SAMPLE_SPANS) -> DataFrame:
    """docs with every span in text replaced by its kind in brackets; null texts stay null, other columns stay as they are."""
    work = Workspace(spark, "redact")
    voted = work.save(_texts(docs).mapInArrow(_examined, f"doc_id long, voted {_VOTED}"), "voted")
    known = spark.sparkContext.broadcast(_classifiers(voted, sample_spans))
    work.drop("voted")
    at = docs.columns.index("text")

    def redacted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text in batch.column(at).to_pylist():
                spans = _accepted(examine(text)[1], known.value, accept) if text else []
                texts.append(redact_text(text, spans) if spans else text)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if k == at else c for k, c in enumerate(batch.columns)], names=batch.schema.names)

    return docs.mapInArrow(redacted, docs.schema)
