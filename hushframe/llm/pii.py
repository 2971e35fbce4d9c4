"""Personal data by weak supervision: labelers vote on spans, expectation-maximisation weighs them, a classifier decides."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushframe.llm.shared import staged

KINDS = ("email", "ip", "card", "phone", "ssn", "name")
ROUNDS = 40
#: Probability from which on the classifier adds a span.
ACCEPT = 0.9

# The contract's patterns (e-mail in two parts, joined by hand; an address tried only where a run of digits
# begins, and never given back: what the pattern finds, in linear time).
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Wider nets, whose catch the vote decides on.
LOOSE = (
    ("email", re.compile(r"[A-Za-z0-9._%+-]{1,64}\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:[\[(]dot[\])]|\.)\x20?[A-Za-z0-9-]{2,63})+"), "at"),
    ("phone", re.compile(r"(?<![0-9+])(?:\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{4}|[0-9]{3}[\x20.-][0-9]{4}|[0-9]{7,12})(?![0-9])"), None),
    ("card", re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){12,18}(?![0-9])"), None),
    ("ssn", re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"), None),
    ("name", re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Herr|Frau|Mme|Sra|Sr)\.?\x20[A-Z][a-z]{1,20}(?:\x20[A-Z][a-z]{1,20})?"), None),
)

#: Gazetteers: top-level domains, calling codes, issuers' first digits, given names.
DOMAINS = frozenset("com org net edu gov io co uk de fr es eu us ca info biz ch at nl it".split())
CALLING = ("1", "7", "20", "30", "31", "32", "33", "34", "39", "41", "43", "44", "45", "46", "47", "48", "49", "52", "55", "61", "81", "86", "91")
ISSUERS = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65", "35", "22")
GIVEN = frozenset("anna maria peter paul john james mary robert michael laura julia thomas hans klaus marie jean pierre luis carmen jose elena".split())
#: Words near a span that speak for its kind, and those that speak against any.
CONTEXT = {
    "email": ("mail", "contact", "write to", "correo", "courriel"),
    "ip": ("ip", "host", "server", "login", "address"),
    "card": ("card", "visa", "payment", "karte", "tarjeta", "carte"),
    "phone": ("phone", "tel", "call", "fax", "mobile", "telefon"),
    "ssn": ("ssn", "social security"),
    "name": ("contact", "dear", "signed", "author", "patient"),
}
AGAINST = ("version", "isbn", "serial", "order no", "sku", "invoice", "build")
REACH = 40


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """What the pattern finds from left to right: each @ with the whole run before it, and a domain after it."""
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            last = domain.end()
            yield start, last
        at = text.find("@", max(at + 1, last))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start."""
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    if re.search("[0-9]", text):
        out += [(1, *m.span()) for m in IP.finditer(text) if all(len(x := p.lstrip("0")) <= 3 and int(x or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
        if "+" in text:
            out += [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= sum(map(str.isdigit, m[0])) <= 15]
    return out


def loose_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Further candidates that overlap no base span and none before them."""
    out: list[tuple[int, int, int]] = []
    digits = re.search("[0-9]{3}", text) is not None
    taken = bytearray(len(text))
    for _, a, b in base:
        taken[a:b] = b"\1" * (b - a)
    for kind, pattern, needs in LOOSE:
        if (kind in ("phone", "card", "ssn") and not digits) or (needs and needs not in text):
            continue
        for m in pattern.finditer(text):
            a, b = m.span()
            if taken.find(1, a, b) < 0:
                out.append((KINDS.index(kind), a, b))
                taken[a:b] = b"\1" * (b - a)
    return out


def votes(text: str, kind: str, start: int, end: int, base: bool) -> str:
    """A letter for each labeler (y, n, or - for no opinion), then the length and the separators of the span, coarsely."""
    s = text[start:end]
    digits = "".join(c for c in s if c in "0123456789")
    near = text[max(0, start - REACH) : start].lower()
    pattern = "y" if base else "-"
    check = {
        "email": "y" if "@" in s else "-",
        "ip": "n" if digits.startswith("0") else "y",
        "card": "y" if luhn(digits) and len(digits) >= 13 else "n",
        "phone": "y" if 8 <= len(digits) <= 15 else "n",
        "ssn": "n" if digits[:3] in ("000", "666") or digits[:1] == "9" or digits[3:5] == "00" else "-",
        "name": "-",
    }[kind]
    known = {
        "email": s.rpartition(".")[2].lower() in DOMAINS,
        "card": digits.startswith(ISSUERS),
        "phone": s.startswith("+") and digits.startswith(CALLING),
        "name": any(w.lower() in GIVEN for w in s.split()),
    }.get(kind)
    around = "n" if any(w in near for w in AGAINST) else "y" if any(w in near for w in CONTEXT[kind]) else "-"
    touching = (start > 0 and text[start - 1].isalnum()) or (end < len(text) and text[end].isalnum())
    shape = f"{min(3, (end - start) // 8)}{min(2, len(re.findall('[^0-9A-Za-z]', s)))}"
    return pattern + check + {None: "-", True: "y", False: "-"}[known] + around + ("n" if touching else "y") + shape


LABELERS = 5
FOUND = (
    "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string,"
    " found array<struct<kind:int,start:int,end:int,base:boolean,key:string>>"
)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def scan(docs: DataFrame) -> DataFrame:
    """Adds to each row of docs the columns of FOUND; found holds base spans and candidates with their votes."""

    @F.pandas_udf(FOUND)
    def look(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            text = text or ""
            base = base_spans(text)
            every = [(k, a, b, True) for k, a, b in base] + [(k, a, b, False) for k, a, b in loose_spans(text, base)]
            found = [
                {"kind": k, "start": a, "end": b, "base": x, "key": f"{KINDS[k]}/{votes(text, KINDS[k], a, b, x)}"}
                for k, a, b, x in sorted(every)
            ]
            n = [sum(1 for x in base if x[0] == k) for k in range(4)]
            rows.append((*n, hashlib.sha256(joined(base).encode()).hexdigest(), found))
        return pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "found"])

    return docs.withColumn("_f", look("text")).select(*docs.columns, "_f.*")


def reliabilities(keys: list[str], counts: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """The probability that a span with these votes is true, by Dawid and Skene's expectation-maximisation.

    Each labeler has for true and for false spans a chance of voting yes; these and the share of true spans are
    estimated in turn with the spans' own probabilities, from the balance of votes onwards. A labeler without an
    opinion says nothing either way. Counts are smoothed.
    """
    vote = np.array([["yn-".index(c) for c in k.partition("/")[2][:LABELERS]] for k in keys])
    balance = (vote == 0).sum(1) - 1.5 * (vote == 1).sum(1)
    p = 1 / (1 + np.exp(-(balance - 1.5)))
    for _ in range(rounds):
        log = np.zeros((2, len(keys)))
        for c, w in enumerate((p * counts, (1 - p) * counts)):
            log[c] += np.log((w.sum() + 1) / (counts.sum() + 2))
            for j in range(LABELERS):
                by = np.array([w[vote[:, j] == v].sum() for v in range(2)]) + 1
                log[c] += np.append(np.log(by / by.sum()), 0.0)[vote[:, j]]
        p = 1 / (1 + np.exp(np.clip(log[1] - log[0], -50, 50)))
    return p


def classifier(keys: list[str], target: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A logistic regression on kind, votes and shape, fitted to the estimated probabilities; its own probabilities."""
    names = sorted({x for k in keys for x in _parts(k)})
    place = {x: i for i, x in enumerate(names)}
    x = np.zeros((len(keys), len(names) + 1))
    x[:, -1] = 1
    for i, k in enumerate(keys):
        for part in _parts(k):
            x[i, place[part]] = 1
    w, weight = np.zeros(x.shape[1]), counts / counts.sum()
    ridge = 1e-4 * np.eye(len(w))
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - target)) + 1e-4 * w
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge
        w -= np.linalg.solve(bend, slope)
    return 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))


def _parts(key: str) -> list[str]:
    kind, _, code = key.partition("/")
    return [kind, *(f"{j}{c}" for j, c in enumerate(code))]


def personal_data(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Adds to each row of docs the base counts and digest, and spans: array of struct<kind, start, end>.

    Of docs' columns all stay, or those named in ``keep``: what is not kept is not written to the shared folder.

    spans holds all base spans and the candidates that the classifier accepts, by kind and start, in code points.
    Votes of all rows are counted by pattern (a bounded set, whatever the input) and only these counts reach the
    driver; the texts are scanned once, into the shared folder. Null and empty texts have no spans; repeated rows
    vote each; docs without any span, or empty, give rows without spans, or none.
    """
    found = scan(docs)
    found = staged(found.select(*(docs.columns if keep is None else keep), *found.columns[len(docs.columns) :]), "pii-votes")
    counted = found.select(F.explode("found").alias("x")).groupBy("x.key", "x.base").count().collect()
    weights: dict[str, int] = {}
    for r in counted:
        weights[r["key"]] = weights.get(r["key"], 0) + r["count"]
    accepted: list[str] = []
    if weights:
        keys = sorted(weights)
        counts = np.array([weights[k] for k in keys], float)
        chance = classifier(keys, reliabilities(keys, counts), counts)
        accepted = [k for k, p in zip(keys, chance) if p >= ACCEPT]
    keep = lambda x: x["base"] | x["key"].isin(accepted) if accepted else x["base"]
    spans = F.transform(F.filter("found", keep), lambda x: F.struct(x["kind"], x["start"], x["end"]))
    return found.withColumn("spans", F.array_sort(spans)).drop("found")


def personal_data_of_documents(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    names = F.array(*map(F.lit, KINDS))
    text = F.array_join(
        F.transform("spans", lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])), ","
    )
    out = personal_data(docs.select("doc_id", "text"), keep=["doc_id"]).withColumn("spans", text)
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")
