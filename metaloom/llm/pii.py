"""Personal data by weak supervision.

Base patterns give the spans that always count. Looser patterns propose more candidates. For each
candidate, base or not, labelers vote for (1), against (-1) or not at all (0): form and checksum
(regex), name and number lists (gazetteer), and nearby words and neighbouring characters
(context). Votes are counted over all documents; expectation-maximisation on these counts (a cell
for each combination, so of fixed size however many documents there are) estimates how reliable
each labeler is. A logistic classifier is then fitted on its posteriors; it sees the votes and
traits that no labeler looks at (how long a span is, how much of it are digits, what stands before
and after it), and decides on the candidates that no base pattern has.

Defined results: a null text is an empty one, without spans; a null doc_id is kept; repeated rows
are each reported; with an empty table there is nothing to estimate and nothing is added.
Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_frames, keep, small_batches, text_of

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("form", "checksum", "list", "near", "edges", "shape")

# The base patterns and the labelers' lists.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
DIGITS = re.compile(r"[0-9]([\x20-]?[0-9])+")
PLUS = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Top-level domains: the first generic ones, some later ones, and the countries' of ISO 3166 with the most names.
DOMAINS = frozenset((
    "com", "org", "net", "edu", "gov", "mil", "int", "info", "biz", "name", "pro", "museum", "aero", "coop", "jobs", "mobi", "travel", "asia", "cat", "tel",
    "app", "dev", "io", "ai", "xyz", "online", "site", "shop", "store", "club", "tech", "cloud", "blog", "email",
    "ar", "at", "au", "be", "bg", "br", "by", "ca", "ch", "cl", "cn", "co", "cz", "de", "dk", "ee", "es", "eu", "fi", "fr", "gr", "hk", "hr", "hu", "ie", "il",
    "in", "ir", "is", "it", "jp", "kr", "kz", "lt", "lu", "lv", "me", "mx", "my", "nl", "no", "nz", "pe", "pl", "pt", "ro", "rs", "ru", "se", "sg", "si", "sk",
    "th", "tr", "tv", "tw", "ua", "uk", "us", "vn", "za",
))
#: First digits of issuers' numbers by ISO/IEC 7812: travel (1, 2, 3), banking (4, 5, 6), among them the card brands' ranges.
CARD_STARTS = ("2", "34", "35", "36", "37", "38", "4", "5", "6")
AT = re.compile(r"\s?[\[({<]\s?(?:at|AT|@)\s?[\])}>]\s?")
AFTER_AT = re.compile(r"[A-Za-z0-9-]+(?:(?:\.|\s?[\[({<]\s?(?:dot|DOT|\.)\s?[\])}>]\s?)[A-Za-z0-9-]+)+")
LOOSE_PHONE = re.compile(r"(?<![\w+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![\w-])|(?<![\w+.-])00[1-9][0-9]{0,2}(?:[\x20.-]?\(?[0-9]{2,4}\)?){3,4}(?![\w-])")
RUN = re.compile(r"[0-9]+")
GROUPED = re.compile(r"(?<![0-9])[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{2,7}(?![0-9])|(?<![0-9])3[0-9]{3}([\x20-])[0-9]{6}\2[0-9]{5}(?![0-9])")
FOR_WORDS = {
    "email": frozenset(("email", "mail", "e-mail", "contact", "write", "correo", "courriel")),
    "ip": frozenset(("ip", "host", "server", "address", "addr", "client", "from", "adresse")),
    "card": frozenset(("card", "visa", "mastercard", "amex", "credit", "debit", "cc", "karte", "carte", "tarjeta")),
    "phone": frozenset(("phone", "tel", "call", "mobile", "fax", "cell", "telefon", "téléphone", "teléfono")),
}
AGAINST_WORDS = frozenset(("version", "release", "v", "license", "isbn", "order", "token", "key", "sha", "hash", "build", "id", "ref"))
WORD_BEFORE = re.compile(r"[\w-]+")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _plain(text: str, start: int, end: int) -> str:
    return re.sub("[^0-9]", "", text[start:end])


def base_emails(text: str) -> list[tuple[int, int]]:
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and LOCAL.match(text[start - 1]):
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return out


def base_ips(text: str) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Accepted spans, and those that a part over 255 rejects. A chain of dotted numbers is cut in fours."""
    good, bad = [], []
    for m in DOTTED.finditer(text):
        if m.group().count(".") < 3:
            continue
        parts = [p.span() for p in RUN.finditer(text, m.start(), m.end())]
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            fits = all(len(n := text[a:b].lstrip("0")) < 4 and int(n or 0) <= 255 for a, b in four)
            (good if fits else bad).append((four[0][0], four[3][1]))
    return good, bad


def base_cards(text: str) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    good, bad = [], []
    for m in DIGITS.finditer(text):
        d = _plain(text, *m.span()) if m.end() - m.start() >= 14 else ""
        if len(d) >= 14:
            (good if len(d) <= 19 and luhn(d) else bad).append(m.span())
    return good, bad


def base_phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in PLUS.finditer(text) if 10 <= len(_plain(text, *m.span())) <= 15]


def spelled_emails(text: str) -> list[tuple[int, int]]:
    """Addresses whose at sign is spelled in brackets: the name is read backwards from the bracket, so that long words cost nothing."""
    out, end = [], 0
    for m in AT.finditer(text):
        start = m.start()
        while start > end and LOCAL.match(text[start - 1]):
            start -= 1
        while start < m.start() and not (text[start].isascii() and text[start].isalnum()):
            start += 1
        after = AFTER_AT.match(text, m.end()) if start < m.start() else None
        if after:
            out.append((start, after.end()))
            end = after.end()
    return out


def proposals(text: str, base: dict[str, list[tuple[int, int]]], bad_cards: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    """Spans that no base pattern accepts but a looser one does, apart from the base spans of their kind."""
    out = []
    if "(" in text or "[" in text or "{" in text or "<" in text:
        out += [("email", *span) for span in spelled_emails(text)]
    for a, b in bad_cards:  # card numbers that other digits stand beside
        inner = [m.span() for m in RUN.finditer(text, a, b)] + [m.span() for m in GROUPED.finditer(text, a, b)]
        out += [("card", x, y) for x, y in inner if 14 <= len(d := _plain(text, x, y)) <= 19 and luhn(d)]
    out += [("phone", *m.span()) for m in LOOSE_PHONE.finditer(text)]
    free, taken = [], {k: sorted(v) for k, v in base.items()}
    for kind, a, b in sorted(out, key=lambda x: (KINDS.index(x[0]), x[1], -x[2])):
        at = bisect_left(taken[kind], (a, b))  # spans of a kind lie apart, so only the neighbours can meet this one
        if all(b <= x or y <= a for x, y in taken[kind][max(0, at - 1) : at + 1]):
            taken[kind].insert(at, (a, b))
            free.append((kind, a, b))
    return free


def votes(text: str, kind: str, start: int, end: int, is_base: bool) -> list[int]:
    """A vote of each labeler, in the order of LABELERS."""
    span, digits = text[start:end], _plain(text, start, end)
    form = 1 if is_base else 0
    if kind == "card":
        checksum = 1 if luhn(digits) else -1
        listed = 1 if digits.startswith(CARD_STARTS) else -1
        shape = 1 if len(digits) in (14, 15, 16) else -1
    elif kind == "ip":
        checksum = 1
        listed = -1 if digits[:1] == "0" or span.startswith(("127.", "255.")) else 0
        shape = 1 if all(len(p) == 1 or p[0] != "0" for p in span.split(".")) else -1
    elif kind == "phone":
        checksum = 1 if 10 <= len(digits) <= 15 else -1
        listed = 1 if span[0] == "+" and span[1] != "0" or span.startswith("00") else 0
        shape = 1 if re.search(r"[\x20().-]", span) else -1
    else:
        checksum = 1 if not re.search(r"\.\.|^\.|\.@", span) else -1
        listed = 1 if span.rpartition(".")[2].rstrip(")]}>").lower() in DOMAINS else -1
        shape = 1 if len(span) <= 100 else -1
    before = [w.lower() for w in WORD_BEFORE.findall(text[max(0, start - 40) : start])[-4:]]
    near = 1 if any(w in FOR_WORDS[kind] for w in before) else -1 if any(w in AGAINST_WORDS for w in before[-1:]) else 0
    left, right = text[start - 1 : start], text[end : end + 1]
    edges = -1 if left.isalnum() or right.isalnum() else 1
    return [form, checksum, listed, near, edges, shape]


def found_in(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, int]]]:
    """Base spans (kind, start, end), and the cell of votes of each candidate (kind, start, end, cell); a proposal's cell isn't negative."""
    base: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    bad: list[tuple[int, int]] = []
    if "@" in text:
        base["email"] = base_emails(text)
    if RUN.search(text):
        base["ip"], _ = base_ips(text)
        base["card"], bad = base_cards(text)
        base["phone"] = base_phones(text) if "+" in text else []
        extra = proposals(text, base, bad)
    else:
        extra = [x for x in proposals(text, base, []) if x[0] == "email"]
    spans = [(KINDS.index(k), a, b) for k in KINDS for a, b in base[k]]
    cells = [(KINDS.index(k), a, b, -1 - cell_of(votes(text, k, a, b, True), traits(text, a, b))) for k in KINDS for a, b in base[k]]
    cells += [(KINDS.index(k), a, b, cell_of(votes(text, k, a, b, False), traits(text, a, b))) for k, a, b in extra]
    return sorted(spans, key=lambda x: (x[1], x[0])), cells


#: How many values each trait has: length, share of digits, what stands before, what stands after.
TRAITS = (4, 3, 4, 4)


def traits(text: str, start: int, end: int) -> tuple[int, ...]:
    """What the classifier sees of a span beside the votes."""
    span = text[start:end]
    digits = sum(c.isdigit() for c in span)
    beside = lambda c: 0 if not c else 1 if c.isspace() else 2 if c.isalnum() else 3
    return min(3, len(span) // 8), 0 if not digits else 1 if 2 * digits < len(span) else 2, beside(text[start - 1 : start]), beside(text[end : end + 1])


def cell_of(v: list[int], seen: tuple[int, ...]) -> int:
    """Votes and traits as one number below CELLS."""
    out = 0
    for x, n in zip(reversed(seen), reversed(TRAITS), strict=True):
        out = out * n + x
    return out * 3 ** len(LABELERS) + sum((x + 1) * 3**i for i, x in enumerate(v))


CELLS = 3 ** len(LABELERS) * int(np.prod(TRAITS))


def votes_of(cell: int) -> np.ndarray:
    return np.array([cell // 3**i % 3 - 1 for i in range(len(LABELERS))])


def features_of(cell: int) -> np.ndarray:
    """Votes for and against, and each value of each trait but the first."""
    rest, out = cell // 3 ** len(LABELERS), [votes_of(cell) == 1, votes_of(cell) == -1]
    for n in TRAITS:
        rest, value = divmod(rest, n)
        out.append(np.arange(1, n) == value)
    return np.concatenate(out)


@dataclass(frozen=True)
class Settings:
    rounds: int = 50
    accept: float = 0.5
    start: float = 0.8  # reliability that each labeler is first taken to have


def estimate(cells: dict[tuple[int, int], int], s: Settings) -> dict[tuple[int, int], float]:
    """Posterior of each (kind, cell) by expectation-maximisation: two classes, and for each labeler the chances of its votes in either."""
    out = {}
    for kind in sorted({k for k, _ in cells}):
        own = Counter()
        for (k, c), count in cells.items():
            if k == kind:
                own[c % 3 ** len(LABELERS)] += count
        own = sorted(own.items())
        v = np.array([votes_of(c) for c, _ in own])
        n = np.array([n for _, n in own], float)
        share = 0.7
        chance = np.zeros((2, len(LABELERS), 3))  # class, labeler, vote
        for cls, sign in ((0, -1), (1, 1)):
            chance[cls, :, 1] = 1 / 3
            chance[cls, :, 1 + sign] = s.start * 2 / 3
            chance[cls, :, 1 - sign] = (1 - s.start) * 2 / 3
        prior = chance.copy() * 5  # a few thought votes keep rare ones from certainty
        for _ in range(s.rounds):
            logs = np.stack([np.log(p) + sum(np.log(chance[cls, j, v[:, j] + 1]) for j in range(len(LABELERS))) for cls, p in ((0, 1 - share), (1, share))])
            post = np.exp(logs[1] - np.logaddexp(logs[0], logs[1]))
            share = float(np.clip((post @ n + 7) / (n.sum() + 10), 0.01, 0.99))
            for cls, weight in ((0, n * (1 - post)), (1, n * post)):
                for j in range(len(LABELERS)):
                    counts = prior[cls, j] + np.array([weight[v[:, j] == x].sum() for x in (-1, 0, 1)])
                    chance[cls, j] = counts / counts.sum()
        found = {c: float(p) for (c, _), p in zip(own, post, strict=True)}
        out |= {(k, c): found[c % 3 ** len(LABELERS)] for k, c in cells if k == kind}
    return out


def classifier(cells: dict[tuple[int, int], int], posterior: dict[tuple[int, int], float], s: Settings) -> set[tuple[int, int]]:
    """The cells whose candidates are taken: a logistic model over kinds, votes and traits, fitted on the posteriors by Newton's method."""
    if not cells:
        return set()
    keys = sorted(cells)
    x = np.array([np.concatenate([np.eye(len(KINDS))[k], features_of(c)]) for k, c in keys], float)
    y = np.array([posterior[k] for k in keys])
    n = np.array([cells[k] for k in keys], float)
    w, ridge = np.zeros(x.shape[1]), 0.5 * np.eye(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (n * (y - p)) - ridge @ w
        w = w + np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + ridge, grad)
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    return {k for k, q in zip(keys, p, strict=True) if q >= s.accept}


SPANS = "array<struct<kind:int,start:int,end:int>>"
CANDIDATES = "array<struct<kind:int,start:int,end:int,cell:int>>"


def candidates(documents: DataFrame) -> DataFrame:
    """doc_id, base and candidate spans of every document."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [found_in(t) for t in frame["text"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "base": [_structs(b, ("kind", "start", "end")) for b, _ in found], "candidates": [_structs(c, ("kind", "start", "end", "cell")) for _, c in found]})

    return in_frames(documents.select("doc_id", text_of().alias("text")), run, f"doc_id long, base {SPANS}, candidates {CANDIDATES}")


def _structs(rows: list[tuple], names: tuple[str, ...]) -> list[dict]:
    return [dict(zip(names, r, strict=True)) for r in rows]


def accepted_cells(found: DataFrame, s: Settings) -> set[tuple[int, int]]:
    """Counts of cells over all documents, at most CELLS rows for each kind, then estimation on the driver."""
    each = found.select(F.explode("candidates").alias("c"))
    cell = F.when(F.col("c.cell") < 0, -1 - F.col("c.cell")).otherwise(F.col("c.cell"))
    rows = each.groupBy(F.col("c.kind").alias("kind"), cell.alias("cell")).count().collect()
    cells = {(r["kind"], r["cell"]): r["count"] for r in rows}
    return classifier(cells, estimate(cells, s), s)


def spans(documents: DataFrame, settings: Settings | None = None) -> DataFrame:
    """doc_id, base and all accepted spans, by start and then kind, of every document."""
    found = keep(candidates(documents), "candidates")
    taken = sorted(k * CELLS + c for k, c in accepted_cells(found, settings or Settings()))
    code = lambda c: c["kind"] * F.lit(CELLS) + c["cell"]
    fits = (lambda c: (c["cell"] >= 0) & code(c).isin(taken)) if taken else (lambda c: F.lit(False))
    extra = F.transform(F.filter("candidates", fits), lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    by_start = lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"))
    every = F.array_sort(F.transform(F.concat("base", extra), by_start))
    return found.select("doc_id", "base", every.alias("spans"))


def digest(documents: DataFrame, settings: Settings | None = None) -> DataFrame:
    name = lambda c: F.element_at(F.array(*map(F.lit, KINDS)), c["kind"] + 1)
    joined = lambda column: F.array_join(F.transform(column, lambda c: F.concat_ws(":", name(c), c["start"].cast("string"), c["end"].cast("string"))), ",")
    count = lambda i: F.size(F.filter("base", lambda c: c["kind"] == i)).cast("long")
    rows = spans(documents, settings)
    return rows.select("doc_id", *(count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def redact(documents: DataFrame, settings: Settings | None = None) -> DataFrame:
    """The documents with each accepted span replaced by its kind in brackets; other columns as they are, n_chars renewed.

    The cells are counted in a first pass; the second one finds the same candidates again beside
    the text, so that no join moves texts.
    """
    taken = accepted_cells(candidates(documents), settings or Settings())

    @F.pandas_udf("string")
    def hide(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            if text is None:
                out.append(None)
                continue
            base, extra = found_in(text)
            every = sorted([(a, b, k) for k, a, b in base] + [(a, b, k) for k, a, b, c in extra if c >= 0 and (k, c) in taken])
            parts, end = [], 0
            for a, b, k in every:
                if b <= end:
                    continue
                parts += [text[end : max(a, end)], f"[{KINDS[k].upper()}]"]
                end = b
            out.append("".join(parts) + text[end:])
        return pd.Series(out, dtype=object)

    small_batches(documents.sparkSession)
    hidden = documents.withColumn("text", hide(F.col("text").cast("string")))
    return hidden.withColumn("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType)) if "n_chars" in documents.columns else hidden
