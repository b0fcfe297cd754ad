"""Personal data by weak supervision: labelers vote on spans, their reliabilities are estimated without labels, and a classifier learns from the outcome.

1. Each text gives its base spans (fixed patterns and checks) and candidates: spans that look alike but that the patterns leave out, as written-out
   addresses, numbers without a country code, or card numbers beside other numbers.
2. Labelers (pattern, gazetteer, format, context) vote for, against or not at all on base spans and candidates.
3. Expectation-maximisation over the counts of vote patterns in the whole corpus estimates each labeler's reliability for each kind and each pattern's probability.
4. A logistic classifier on votes, shape and neighbouring words learns those probabilities, and decides on the candidates. Base spans stay.

Texts are read once; what goes on is spans.
"""

from __future__ import annotations

import hashlib
import ipaddress
import math
import re
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, ship, stage

KINDS = ("email", "ip", "card", "phone")
#: Spans of a kind that the classifier learns from, at most; what it needs to add a candidate.
SAMPLE, SURE = 20_000, 0.5
#: Hashed features; characters of context on either side; rounds of estimation and of learning.
WIDTH, AROUND, EM_ROUNDS, LEARN_ROUNDS = 1 << 12, 60, 60, 300
#: Pseudo-counts by which a labeler that was never seen agrees with the truth; its reliabilities move away from them with the counts.
FOR, AGAINST, SILENT = 4.0, 1.0, 2.0

#: The base patterns (of an email the part after the @). Digit runs can't be split, so they are possessive and start at a run's first digit.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# What candidates look like. Left sides are bounded by the longest local part (64).
AT = re.compile(r"[\[({<] ?(?:at|@) ?[\])}>]| (?:at|@) (?=[A-Za-z0-9-]{1,63}(?: dot | ?[\[({<] ?(?:dot|\.) ?[\])}>] ?|\.)[A-Za-z0-9])", re.I)
AFTER_AT = re.compile(r" ?[A-Za-z0-9-]{1,63}(?:(?: dot | ?[\[({<] ?(?:dot|\.) ?[\])}>] ?|\.)[A-Za-z0-9-]{1,63})+", re.I)
WIDE_DOMAIN = re.compile(r"[\w-]{1,63}(?:\.[\w-]{1,63})+")
WIDE_LOCAL = re.compile(r"[\w.%+-]{1,64}\Z")
IP6 = re.compile(r"(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f:]{0,39}:[0-9A-Fa-f]{0,4}:)[0-9A-Fa-f:]{3,39}(?![0-9A-Za-z:])")
DEFANGED = re.compile(r"(?<![0-9])[0-9]{1,3}(?: ?[\[(]\.[\])] ?[0-9]{1,3}){3}(?![0-9])")
GROUPS = re.compile(r"(?<![0-9])[0-9]{4}(?:[./_ –][0-9]{4}){2}[./_ –][0-9]{1,7}(?![0-9])")
LOCAL_PHONE = re.compile(r"(?<![0-9A-Za-z+.,/-])(?:00[1-9][0-9]{0,2}[\x20/.-]?|\(0?[1-9][0-9]{1,3}\)[\x20/.-]?|0?[1-9][0-9]{1,3}[\x20/.-])[0-9]{2,5}(?:[\x20/.-][0-9]{2,5}){1,4}(?![0-9A-Za-z@])")

#: Ends of domains, providers, issuers' first digits, country calling codes; words that announce a kind or something else.
ENDS = frozenset("com org net edu gov info biz io co me de fr es uk us eu ch at it nl be pl pt br mx ar ca au jp cn in ru se no dk fi ie cz".split())
ISSUERS = re.compile(r"4|5[1-5]|222[1-9]|22[3-9]|2[3-6]|27[01]|2720|3[47]|3[0689]|35|6011|64[4-9]|65|62")
CALLING = re.compile(r"1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|2[1-69][0-9]|3[578][0-9]|4[2][0-9]|5[09][0-9]|6[7-9][0-9]|8[057][0-9]|9[679][0-9]")
SAYS = {
    "email": frozenset("email mail e correo courriel contact contacto kontakt write schreiben reach adresse address gmail address".split()),
    "ip": frozenset("ip ipv host server address adresse dirección client login logged gateway router peer".split()),
    "card": frozenset("card karte carte tarjeta visa mastercard amex credit kreditkarte debit payment pay charge".split()),
    "phone": frozenset("phone tel telephone telefon téléphone teléfono call mobile handy fax cell whatsapp sms anruf llamar appeler contact".split()),
}
DENIES = {
    "email": frozenset("look looks looked arrive arrived meet met stay was were is".split()),
    "ip": frozenset("version v ver release build section chapter kapitel chapitre sección oid firmware".split()),
    "card": frozenset("isbn order invoice tracking serial number id hash rechnung facture factura bestellung reference imei".split()),
    "phone": frozenset("isbn order invoice version price total date serial id page pages seite figure rechnung facture factura score".split()),
}
WORDS = re.compile(r"[^\W\d_]+")

Span = tuple[int, int, int]


def emails(text: str) -> list[tuple[int, int]]:
    """Base matches, found from each @: linear however long the runs of letters are."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        after = at + 1
        if m := DOMAIN.match(text, after):
            start = at
            while start > free and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                out.append((start, m.end()))
                free = after = m.end()
        at = text.find("@", after)
    return out


def luhn(digits: str) -> bool:
    d = [int(c) for c in reversed(digits)]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def octets(s: str) -> bool:
    return all(len(x := p.lstrip("0")) <= 3 and int(x or "0") <= 255 for p in s.split("."))


def is_card(s: str) -> bool:
    return 13 <= len(d := digits_of(s)) <= 19 and luhn(d)


def is_phone(s: str) -> bool:
    return 9 <= len(digits_of(s)) <= 15


CHECKED = [(1, IP, octets), (2, CARD, is_card), (3, PHONE, is_phone)]


def base_spans(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, by kind and start, and matches that fail their check (of cards: those of 13 digits and more)."""
    good, bad = [(0, a, b) for a, b in emails(text)], []
    for kind, pattern, check in CHECKED:
        for m in pattern.finditer(text):
            if check(m[0]):
                good.append((kind, m.start(), m.end()))
            elif kind != 2 or m.end() - m.start() >= 13:
                bad.append((kind, m.start(), m.end()))
    return good, bad


def six(s: str) -> bool:
    try:
        ipaddress.IPv6Address(s)
    except ValueError:
        return False
    return True


def card_runs(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """Whole groups, of three digits and more, of a run of digits that make a card number though the run doesn't: each group starts at most one."""
    groups = [(m.start(), m.end()) for m in re.finditer(r"[0-9]+", text[start:end])]
    free = 0
    for i, (a, _) in enumerate(groups):
        n = 0
        if a < free:
            continue
        for x, b in groups[i : i + 7]:
            n += b - x
            if n > 19 or b - x < 3:
                break
            if n >= 13 and len(groups) > 1 and is_card(text[start + a : start + b]):
                yield start + a, start + b
                free = b
                break


def candidates(text: str, good: list[Span], bad: list[Span]) -> list[Span]:
    """Spans that pass their kind's check and overlap neither a base span nor an earlier candidate."""
    found: list[Span] = []
    for m in AT.finditer(text):
        if d := AFTER_AT.match(text, m.end()):
            a = m.start()
            if a and text[a - 1] == " " and m[0][0] != " ":
                a -= 1
            lo = a
            while lo > max(0, a - 64) and text[lo - 1] in LOCAL:
                lo -= 1
            if lo < a:
                found.append((0, lo, d.end()))
    if not text.isascii():
        at = text.find("@")
        while at >= 0:
            if (d := WIDE_DOMAIN.match(text, at + 1)) and (x := WIDE_LOCAL.search(text[max(0, at - 64) : at])):
                found.append((0, at - len(x[0]), d.end()))
            at = text.find("@", at + 1)
    found += [(1, m.start(), m.end()) for m in IP6.finditer(text) if six(m[0])]
    found += [(1, m.start(), m.end()) for m in DEFANGED.finditer(text) if octets(re.sub(r"[^0-9.]", "", m[0]))]
    for kind, a, b in bad:
        if kind == 2:
            found += [(2, x, y) for x, y in card_runs(text, a, b)]
        elif kind == 3:  # a number that runs on into another kind's base span
            stop = min((x for _, x, y in good if a < x < b), default=a)
            if (m := PHONE.match(text, a, stop)) and is_phone(m[0]):
                found.append((3, a, m.end()))
    found += [(2, m.start(), m.end()) for m in GROUPS.finditer(text) if is_card(m[0])]
    found += [(3, m.start(), m.end()) for m in LOCAL_PHONE.finditer(text) if is_phone(m[0])]
    if not found:
        return found
    taken = sorted((a, b) for _, a, b in good)
    starts = [a for a, _ in taken]
    out, free = [], [0] * len(KINDS)
    for kind, a, b in sorted(found, key=lambda s: (s[0], s[1], -s[2])):
        i = bisect_left(starts, b)  # base spans of different kinds may overlap, but none is long: a few before it are enough to look at
        if a >= free[kind] and all(y <= a for _, y in taken[max(0, i - 8) : i]):
            out.append((kind, a, b))
            free[kind] = b
    return out


def votes(text: str, span: Span, base: bool, checked: bool, before: list[str]) -> tuple[int, int, int, int]:
    """Votes of the pattern, the gazetteer, the format and the context: 1, -1 or 0 (says nothing)."""
    kind, a, b = KINDS[span[0]], span[1], span[2]
    s, d = text[a:b], digits_of(text[a:b])
    near = text[max(0, a - 2) : a], text[b : b + 2]
    pattern = 1 if base else 0 if checked else -1
    if kind == "email":
        end = re.split(r"[^A-Za-z]+", s)[-1].lower()
        gazetteer = 1 if end in ENDS else -1 if not end or len(end) > 10 else 0
        form = -1 if re.search(r" (?:at|@) ", s, re.I) and not re.search(r" dot |\.[a-z]{2,4}\Z", s, re.I) else 1 if "@" in s or re.search(r"[\[({<] ?at|\bdot\b", s, re.I) else 0
    elif kind == "ip":
        p = s.split(".")
        gazetteer = -1 if s.startswith(("0.", "00")) or ":" not in s and all(len(x) == 1 for x in p) else 1 if s.startswith(("10.", "192.168.", "172.", "127.", "2001:", "fe80:")) else 0
        form = -1 if near[0][-1:] in ("v", "V", ".", "-") or near[1][:1] in ("-", "_") or near[1][:1] == "." and near[1][1:].isdigit() or any(len(x) > 1 and x[0] == "0" for x in p) else 1
    elif kind == "card":
        gazetteer = 1 if ISSUERS.match(d) else -1
        form = 1 if len(d) in (15, 16) else 0 if len(d) in (13, 14, 19) else -1
        form = -1 if near[0][-1:].isalnum() or near[1][:1].isalnum() else form
    else:
        code = d[2:] if d.startswith("00") else d if s.startswith("+") else ""
        gazetteer = (1 if CALLING.match(code) else -1) if code else 0
        form = -1 if near[0][-1:] in ("$", "€", "£", "#", "=", '"') or near[1][:1] in ("%", "$", "€", "£") else 1 if re.search(r"[()]", s) or len(re.findall(r"[0-9]+", s)) in (3, 4, 5) else 0
    last = before[-4:]
    says, denies = any(w in SAYS[kind] for w in last), any(w in DENIES[kind] for w in last)
    return pattern, gazetteer, form, says - denies


def described(text: str, span: Span, base: bool, checked: bool) -> tuple[str, list[int]]:
    """Votes as a string of - 0 +, and hashed features: votes, shape, length, neighbouring words and characters."""
    kind, a, b = span
    before = WORDS.findall(text[max(0, a - AROUND) : a].lower())
    after = WORDS.findall(text[b : b + AROUND].lower())
    v = votes(text, span, base, checked, before)
    shape = re.sub(r"a+", "a", re.sub(r"[^\W\d_]", "a", re.sub(r"\d", "9", text[a : min(b, a + 64)])))
    says = [f"v{i}{x}" for i, x in enumerate(v)] + [f"s{shape}", f"n{min(b - a, 40) // 3}", f"p{text[max(0, a - 1) : a]}", f"q{text[b : b + 1]}"]
    says += [f"b{w}" for w in before[-2:]] + [f"a{w}" for w in after[:1]]
    return "".join("-0+"[x + 1] for x in v), sorted({zlib.crc32(x.encode("utf-8", "replace")) % WIDTH for x in says})


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


FOUND = "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base string, seen array<struct<kind:int,start:int,stop:int,state:int,votes:string,features:array<int>>>"
#: States of a span that labelers have voted on.
BASE, CANDIDATE, FAILED = 0, 1, 2


def found_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts and list of base spans, and all spans that labelers vote on: base spans, candidates, and matches that fail their check (these are never added)."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        struct = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("state", pa.int32()), ("votes", pa.string()), ("features", pa.list_(pa.int32()))])
        for b in batches:
            counts, base, seen = [], [], []
            for text in b.column("text").to_pylist():
                good, bad = base_spans(text)
                all_spans = [(s, BASE) for s in good] + [(s, FAILED) for s in bad] + [(s, CANDIDATE) for s in candidates(text, good, bad)]
                n = Counter(s[0] for s in good)
                counts.append([n[k] for k in range(len(KINDS))])
                base.append(written(good))
                seen.append([(*s, state, *described(text, s, state == BASE, state != FAILED)) for s, state in all_spans])
            cols = [pa.array(c, pa.int64()) for c in (zip(*counts, strict=True) if counts else [[]] * len(KINDS))]
            rows = [[dict(zip(("kind", "start", "stop", "state", "votes", "features"), x, strict=True)) for x in xs] for xs in seen]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols, pa.array(base, pa.string()), pa.array(rows, pa.list_(struct))], names=["doc_id", *(f"n_{k}" for k in KINDS), "base", "seen"])

    return rows.mapInArrow(run, f"doc_id {kind}, {FOUND}")


def reliabilities(counts: dict[str, int]) -> tuple[float, np.ndarray, dict[str, float]]:
    """Expectation-maximisation over vote patterns of one kind: share of true spans, P(vote | truth) of each labeler, P(true | pattern).

    Votes are taken as independent given the truth. It starts from labelers that are right more often than wrong, and those pseudo-counts stay.
    """
    patterns = sorted(counts)
    n = np.array([counts[p] for p in patterns], float)
    vote = np.array([["-0+".index(c) for c in p] for p in patterns])
    prior = np.array([[FOR, SILENT, AGAINST], [AGAINST, SILENT, FOR]])  # truth, vote
    p = 1 / (1 + np.exp(-(vote - 1).sum(axis=1).astype(float)))
    share, table = 0.5, np.zeros((vote.shape[1], 2, 3))
    for _ in range(EM_ROUNDS):
        share = float((n @ p + 1) / (n.sum() + 2))
        for j in range(vote.shape[1]):
            for y, w in ((0, n * (1 - p)), (1, n * p)):
                c = prior[y] + np.bincount(vote[:, j], weights=w, minlength=3)
                table[j, y] = c / c.sum()
        logs = np.log(table[np.arange(vote.shape[1])[None, :], :, vote])  # pattern, labeler, truth
        odds = logs[:, :, 1].sum(axis=1) - logs[:, :, 0].sum(axis=1) + math.log(share / (1 - share))
        p = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
    return share, table, dict(zip(patterns, p.tolist(), strict=True))


def learned(rows: list[tuple[list[int], float]]) -> np.ndarray:
    """Weights of a logistic classifier (the last one: the bias) that fits probabilities, by gradient steps over all rows, with a penalty on weights."""
    w = np.zeros(WIDTH + 1)
    if not rows:
        return w
    size = np.array([len(f) for f, _ in rows])
    flat = np.array([x for f, _ in rows for x in f], np.int64)
    of = np.repeat(np.arange(len(rows)), size)
    want = np.array([p for _, p in rows])
    step = np.full(WIDTH + 1, 1e-8)
    for _ in range(LEARN_ROUNDS):
        z = np.bincount(of, weights=w[flat], minlength=len(rows)) + w[-1]
        miss = 1 / (1 + np.exp(-np.clip(z, -50, 50))) - want
        grad = np.append(np.bincount(flat, weights=miss[of], minlength=WIDTH), miss.sum()) / len(rows) + 1e-4 * w
        step += grad * grad
        w -= 0.5 * grad / np.sqrt(step)
    return w


def trained(found: DataFrame, sample: int = SAMPLE) -> dict[int, np.ndarray]:
    """A classifier for each kind. Vote patterns are counted over all spans; spans to learn from are those with the smallest hashes, sample of a kind at most."""
    spans = found.select("doc_id", F.explode("seen").alias("s")).select("doc_id", "s.*")
    counts: dict[int, dict[str, int]] = defaultdict(dict)
    for r in spans.groupBy("kind", "votes").count().collect():  # some hundred patterns at most
        counts[r.kind][r.votes] = r["count"]
    out = {}
    for kind in sorted(counts):
        _, _, true = reliabilities(counts[kind])
        share = min(1.0, 2 * sample / sum(counts[kind].values()))
        h = F.xxhash64("doc_id", "start", "stop", "votes")
        mine = spans.where((F.col("kind") == kind) & (F.pmod(h, F.lit(1 << 20)) <= int(share * (1 << 20))))
        rows = mine.select(h.alias("h"), "votes", "features").orderBy("h", "votes", "features").limit(sample).collect()
        out[kind] = learned([(r.features, true[r.votes]) for r in rows])
    return out


def decided(found: DataFrame, weights: dict[int, np.ndarray], sure: float = SURE) -> DataFrame:
    """doc_id, counts, base_sha256, spans: base spans and the candidates that the classifier takes."""
    cut = math.log(sure / (1 - sure))
    kind = dict(found.dtypes)["doc_id"]
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sha, spans = [], []
            for base, seen in zip(b.column("base").to_pylist(), b.column("seen").to_pylist(), strict=True):
                sha.append(hashlib.sha256(base.encode()).hexdigest())
                new = [(s["kind"], s["start"], s["stop"]) for s in seen if s["state"] == CANDIDATE and float(weights[s["kind"]][s["features"]].sum() + weights[s["kind"]][-1]) > cut]
                spans.append(written([*((s["kind"], s["start"], s["stop"]) for s in seen if s["state"] == BASE), *new]) if new else base)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names[:-2]), pa.array(sha, pa.string()), pa.array(spans, pa.string())], names=names)

    return found.mapInArrow(run, f"doc_id {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string")


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, sure: float = SURE) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (kind:start:end of all spans, in code points).

    A null text is empty: no spans, and the digest of nothing. Repeated rows count each, in the votes as well. Null ids stay. No rows: no rows. Other columns don't come through. Texts of any length
    are read whole, in time that grows with their length. Added spans never overlap a base span. The classifier learns from a bounded sample of spans; votes are counted over all.
    """
    found = stage(found_spans(docs, id_col, text_col), "personal-data")
    out = stage(decided(found, trained(found, sample), sure), "personal-spans")
    discard(found)
    return out
