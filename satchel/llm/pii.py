"""PII by weak supervision.

Candidates are spans of eight kinds.  Four labelers vote on each candidate (for, against, or not at all): a regex
labeler with validators, a gazetteer labeler, a context labeler that reads the words before the span, and a shape
labeler.  Expectation-maximisation over the counts of vote patterns estimates how reliable each labeler is and how
likely each candidate is personal data; a logistic span classifier is then trained on these posteriors over span
features.  Base spans (email, ip, card, phone by their fixed patterns) always stay; the classifier decides on the rest.

The counts cover the candidates of all documents.  Only one row per distinct feature key reaches the driver, and the
keys come from a fixed finite domain (kinds x votes x buckets), so its size doesn't grow with the data.

Null and empty texts have no spans; no span is cut, however long, and a long text takes time in proportion to its length
and its spans.  Documents are handled one by one: repeats and ties agree (spans with one start are in the order of the
kinds).  An empty table gives an empty table, with the priors as the model.  Further columns of docs don't matter.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import modest_batches, with_fields, written

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "name", "secret", "number", "written_email")
ORDER = {k: i for i, k in enumerate(KINDS)}
LABELERS = ("regex", "gazetteer", "context", "shape")

# Word lists of the gazetteer and context labelers.
TLDS = frozenset("com org net edu gov mil int info biz io dev app me us uk de fr es it nl eu ch at be se no dk fi pl cz ru jp cn in br mx ca au nz".split())
FIRST_NAMES = frozenset("james mary john patricia robert jennifer michael linda david elizabeth william barbara richard susan joseph jessica thomas sarah charles karen hans peter klaus ursula jean marie pierre jacques jose maria carlos ana juan carmen luis isabel".split())
TITLES = "Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Señor|Señora|Sr|Sra"
FOR_WORDS = re.compile(r"(?:mail|phone|tel|call|fax|mobile|whatsapp|contact|card|visa|konto|account|ssn|iban|address|adresse|password|passwd|token|secret|key|login|user|name|ip)\W{0,4}$", re.I)
AGAINST_WORDS = re.compile(r"(?:version|license|chapter|section|page|figure|table|isbn|rfc|build|release|v\.?)\W{0,3}$", re.I)

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT = re.compile("[0-9]")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NAME = re.compile(rf"\b(?:{TITLES})\.?\x20([A-ZÀ-Þ][\w'-]+(?:\x20[A-ZÀ-Þ][\w'-]+)?)|\b([A-Z][a-z]+)\x20[A-ZÀ-Þ][\w'-]+")
_SECRET = re.compile(r"\b(?:password|passwd|pwd|token|secret|api[_-]?key)\b\x20{0,2}[=:]\x20{0,2}[\"']?([^\s\"']{6,})", re.I)
_NUMBER = re.compile(r"(?<![\w+.-])\(?[0-9]{2,5}\)?(?:[\x20./-][0-9]{2,5}){1,4}(?![\w-])")
_AT = re.compile(r"\x20?[\[(]at[\])]\x20?", re.I)
_WRITTEN_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[A-Za-z0-9-]+)+", re.I)


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from each @ outwards."""
    out, floor = [], 0
    at = text.find("@")
    while at >= 0:
        begin = at
        while begin > floor and text[begin - 1] in _LOCAL:
            begin -= 1
        m = _DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            out.append((begin, m.end()))
            floor = m.end()
        at = text.find("@", max(at + 1, floor))
    return out


def written_emails(text: str) -> list[tuple[int, int]]:
    """Addresses with (at) or [at], found from there outwards."""
    out, floor = [], 0
    for at in _AT.finditer(text):
        begin = at.start()
        while begin > floor and text[begin - 1] in _LOCAL:
            begin -= 1
        m = _WRITTEN_DOMAIN.match(text, at.end()) if begin < at.start() and at.start() >= floor else None
        if m:
            out.append((begin, m.end()))
            floor = m.end()
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(_DIGIT.findall(s))


def base_spans(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(start, end, kind) of the base matches that hold, and of those that fail their check."""
    good = [(a, b, "email") for a, b in emails(text)] if "@" in text else []
    bad: list[tuple[int, int, str]] = []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            ok = all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))
            (good if ok else bad).append((*m.span(), "ip"))
        for m in _CARD.finditer(text):
            d = _digits(m[0])
            (good if 12 <= len(d) <= 19 and luhn(d) else bad).append((*m.span(), "card"))
        if "+" in text:
            for m in _PHONE.finditer(text):
                (good if 9 <= len(_digits(m[0])) <= 15 else bad).append((*m.span(), "phone"))
    return sorted(good, key=lambda s: (s[0], ORDER[s[2]], s[1])), bad


def more_spans(text: str, good: list, bad: list) -> list[tuple[int, int, str]]:
    """Candidates that the base patterns don't hold: they overlap no base span."""
    found = [(m.start(1 if m[1] else 0), m.end(), "name") for m in _NAME.finditer(text) if m[1] or m[2].lower() in FIRST_NAMES] if re.search(r"[a-z]", text) else []
    if "=" in text or ":" in text:
        found += [(*m.span(1), "secret") for m in _SECRET.finditer(text)]
    if bad or _DIGIT.search(text):
        found += [(*m.span(), "number") for m in _NUMBER.finditer(text) if 7 <= len(_digits(m[0])) <= 15]
    found += [(*span, "written_email") for span in written_emails(text)]
    out, taken, k = [], merged(good), 0
    for s in sorted(found, key=lambda s: (s[0], ORDER[s[2]], s[1])):
        while k < len(taken) and taken[k][1] <= s[0]:
            k += 1
        if (k == len(taken) or s[1] <= taken[k][0]) and not (out and s[0] < out[-1][1]):
            out.append(s)
    return out


def merged(spans: list) -> list[tuple[int, int]]:
    """The places that spans (sorted by start) cover, as intervals that don't touch each other's inside."""
    out: list[tuple[int, int]] = []
    for a, b, *_ in spans:
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def votes(text: str, start: int, end: int, kind: str, holds: bool) -> tuple[int, int, int, int]:
    """+1 for, -1 against, 0 no vote, by labeler."""
    span, before = text[start:end], text[max(0, start - 24) : start]
    d = _digits(span)
    regex = 1 if holds else -1 if kind == "number" and len(d) in range(12, 20) and not luhn(d) else 0
    gazetteer = 0
    if kind in ("email", "written_email"):
        gazetteer = 1 if re.split(r"[^A-Za-z]+", span)[-1].lower() in TLDS else -1
    elif kind == "card":
        gazetteer = 1 if d[0] in "3456" else -1
    elif kind == "ip":
        gazetteer = -1 if span.startswith(("0.", "127.", "255.")) else 1
    elif kind == "name":
        gazetteer = 1 if span.split()[0].lower() in FIRST_NAMES else 0
    elif kind == "phone":
        gazetteer = 1 if d[0] != "0" else -1
    context = -1 if AGAINST_WORDS.search(before) else 1 if FOR_WORDS.search(before) or kind == "secret" else 0
    shape = 0
    if kind in ("card", "phone"):
        shape = 1 if len(d) >= 10 else -1
    elif kind == "number":
        shape = 1 if len(d) in (10, 11) and len(re.split(r"\D+", span.strip("()"))) >= 3 else -1
    elif kind == "secret":
        shape = 1 if d and re.search("[A-Za-z]", span) and len(span) >= 12 else -1
    elif kind == "name":
        shape = 1 if " " in span else 0
    elif kind in ("email", "written_email"):
        shape = 1 if len(span) <= 80 else -1
    return regex, gazetteer, context, shape


def _class(c: str) -> int:
    return 0 if not c or c.isspace() else 1 if c.isalnum() else 2


def key_of(text: str, start: int, end: int, kind: str, holds: bool) -> str:
    """Kind, votes and span features as one short string from a finite domain."""
    span = text[start:end]
    v = "".join("-0+"[x + 1] for x in votes(text, start, end, kind, holds))
    length = min(4, len(span) // 8)
    share = 3 * len(_digits(span)) // max(1, len(span))
    return f"{ORDER[kind]}{v}{length}{share}{_class(text[start - 1 : start])}{_class(text[end : end + 1])}"


def expectation_maximisation(keys: list[str], counts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of each key being personal data, and (sensitivity, specificity) by labeler; smoothed by pseudo-counts."""
    v = np.array([["-0+".index(c) - 1 for c in k[1:5]] for k in keys]).reshape(-1, 4)
    kind = np.array([int(k[0]) for k in keys], int)
    rate = np.array([[0.85, 0.85]] * 4)
    prior = np.where(np.arange(len(KINDS)) < len(BASE), 0.9, 0.3)
    post = np.zeros(len(keys))
    for _ in range(rounds):
        yes = np.log(prior)[kind] + sum(np.where(v[:, j] > 0, np.log(rate[j, 0]), np.where(v[:, j] < 0, np.log(1 - rate[j, 0]), 0)) for j in range(4))
        no = np.log(1 - prior)[kind] + sum(np.where(v[:, j] < 0, np.log(rate[j, 1]), np.where(v[:, j] > 0, np.log(1 - rate[j, 1]), 0)) for j in range(4))
        post = 1 / (1 + np.exp(np.clip(no - yes, -50, 50)))
        for k in range(len(KINDS)):
            w = counts * (kind == k)
            base = 0.9 if k < len(BASE) else 0.3
            prior[k] = ((w * post).sum() + 20 * base) / (w.sum() + 20)
        for j in range(4):
            for c, p in ((0, post), (1, 1 - post)):
                said = counts * p * (v[:, j] != 0)
                agree = said * (v[:, j] == (1 if c == 0 else -1))
                rate[j, c] = np.clip((agree.sum() + 17) / (said.sum() + 20), 0.55, 0.99)
    return post, rate


def _features(keys: list[str]) -> np.ndarray:
    x = np.zeros((len(keys), len(KINDS) + 8 + 5 + 4 + 6 + 1))
    for i, k in enumerate(keys):
        x[i, int(k[0])] = x[i, -1] = 1
        for j, c in enumerate(k[1:5]):
            if c != "0":
                x[i, len(KINDS) + 2 * j + (c == "+")] = 1
        at = len(KINDS) + 8
        x[i, at + int(k[5])] = x[i, at + 5 + int(k[6])] = x[i, at + 9 + int(k[7])] = x[i, at + 12 + int(k[8])] = 1
    return x


def span_classifier(keys: list[str], counts: np.ndarray, post: np.ndarray, ridge: float = 0.01) -> dict[str, float]:
    """Logistic regression of the posteriors on span features, by Newton steps; the probability of each key."""
    if not keys:
        return {}
    x, w = _features(keys), np.zeros(_features(keys[:1]).shape[1])
    weight = counts * (len(keys) / counts.sum())  # the fit doesn't depend on the size of the corpus
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - post)) + ridge * w
        h = (x.T * (weight * p * (1 - p) + 1e-9)) @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w = w - step * min(1, 3 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return dict(zip(keys, (1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))).tolist(), strict=True))


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and its candidate spans (kind number, start, end, holds, key), by start, then kind."""
    modest_batches(docs.sparkSession)
    schema = with_fields(docs.select("doc_id").schema, "spans array<struct<kind:int,start:int,end:int,holds:boolean,key:string>>")
    item = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("holds", pa.bool_()), ("key", pa.string())]))

    def rows(batches):
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                text = text or ""
                good, bad = base_spans(text)
                found = [(*s, True) for s in good] + [(*s, False) for s in more_spans(text, good, bad)]
                found.sort(key=lambda s: (s[0], ORDER[s[2]], s[1]))
                out.append([{"kind": ORDER[k], "start": a, "end": b, "holds": h, "key": key_of(text, a, b, k, h)} for a, b, k, h in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, item)], ["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(rows, schema)


def span_model(found: DataFrame) -> dict[str, float]:
    """The probability of each feature key among the candidates."""
    counted = found.select(F.explode("spans").alias("s")).groupBy("s.key").count().orderBy("key").collect()
    keys, counts = [r[0] for r in counted], np.array([r[1] for r in counted], float)
    post, _ = expectation_maximisation(keys, counts)
    return span_classifier(keys, counts, post)


def personal_spans(docs: DataFrame) -> DataFrame:
    """doc_id and spans (kind, start, end, holds, p) by start, then kind: base spans and those with p of 0.5 or more."""
    found = written(candidates(docs), "pii")
    model = span_model(found)
    schema = with_fields(found.select("doc_id").schema, "spans array<struct<kind:string,start:int,end:int,holds:boolean,p:double>>")
    item = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("holds", pa.bool_()), ("p", pa.float64())]))

    def rows(batches):
        for batch in batches:
            out = []
            for spans in batch.column(1).to_pylist():
                rated = [{"kind": KINDS[s["kind"]], "start": s["start"], "end": s["end"], "holds": s["holds"], "p": model.get(s["key"], 0.0)} for s in spans]
                out.append([s for s in rated if s["holds"] or s["p"] >= 0.5])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, item)], ["doc_id", "spans"])

    return found.mapInArrow(rows, schema)


def pii_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans as kind:start:end joined by commas, and n_spans, their
    number."""
    found = personal_spans(docs)

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def counted(kind):
        return F.size(F.filter("spans", lambda s: s["holds"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["holds"])
    return found.select("doc_id", *(counted(k) for k in BASE), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def brute_force(text: str | None) -> tuple:
    """n_email, n_ip, n_card, n_phone and base_sha256 straight from the patterns (for tests)."""
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and sum(sum(map(int, str(int(c) * (1 + i % 2)))) for i, c in enumerate(d[::-1])) % 10 == 0:
            found.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            found.append((m.start(), 3, m.end()))
    said = ",".join(f"{BASE[k]}:{a}:{b}" for a, k, b in sorted(found))
    return (*(sum(k == i for _, k, _ in found) for i in range(4)), hashlib.sha256(said.encode()).hexdigest())
