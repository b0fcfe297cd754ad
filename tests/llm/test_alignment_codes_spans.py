"""Vector codes, alignment of two tokenizers and personal data against plain versions of their contracts."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.test_brute_force import DOCS, ODD
from tmweave.llm import alignment, personal_data, queries, vector_codes

BYTES, PIECES = queries.vocabulary("byte_bpe_50k.json"), queries.vocabulary("piece_bpe_32k.model")


# vector codes


def plain_codes(rows, parts=16, entries=64, rounds=2):
    """rows: (vec_id, vector, label) of one dimension. Every distance is computed."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))]
    dim = len(kept[0][1])
    at = [min(i, dim % parts) + i * (dim // parts) for i in range(parts + 1)]
    cut = lambda v: [tuple(v[a:b]) for a, b in zip(at, at[1:])]  # noqa: E731, B905
    book = [[cut(v)[p] for _, v, _ in kept[:entries]] for p in range(parts)]
    far = lambda x, e: sum((a - b) ** 2 for a, b in zip(x, e, strict=True))
    nearest = lambda p, x: min((far(x, e), i) for i, e in enumerate(book[p]))
    for _ in range(rounds):
        mine = defaultdict(list)
        for _, v, _ in kept:
            for p, x in enumerate(cut(v)):
                mine[p, nearest(p, x)[1]].append(x)
        book = [[tuple(sum(c) // len(mine[p, i]) for c in zip(*mine[p, i], strict=True)) if (p, i) in mine else e for i, e in enumerate(book[p])] for p in range(parts)]
    out, total = [], Counter()
    for i, v, label in kept:
        best = [nearest(p, x) for p, x in enumerate(cut(v))]
        out.append((i, "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best), label))
        total[label] += out[-1][2]
    sha = hashlib.sha256(",".join(str(c) for p in book for e in p for c in e).encode()).hexdigest()
    return Counter((i, code, e, total[label], sha) for i, code, e, label in out)


COLUMNS = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_codes_table(spark, sf):
    got = queries.op11_vector_codes(spark, sf)
    assert got.columns == COLUMNS
    rows = Counter(tuple(r) for r in got.collect())
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    assert rows == plain_codes([(r.vec_id, r.embedding, r.label) for r in df.collect()])
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS FROM '{sf}/embeddings.parquet'")
    sql = con.sql(queries.ORACLES["op11_vector_codes"])
    assert rows == Counter(sql.select(*(duckdb.ColumnExpression(c) for c in COLUMNS)).fetchall())


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label string, code string, n long")


@pytest.mark.parametrize("dim,n", [(16, 150), (37, 90), (3, 70), (64, 10)])
def test_codes_odd(spark, dim, n):
    """Ties, repeated rows and ids, null ids and labels, few vectors, dimensions that aren't multiples."""
    rnd = random.Random(dim)
    rows = [(rnd.choice([None, 1, 2, *range(10, 400)]), [rnd.randint(-3, 3) / rnd.choice([64, 256, 300]) for _ in range(dim)], rnd.choice([None, "a", "b"])) for _ in range(n)]
    rows += rows[: n // 3] + [(5, None, "a"), (6, [None] * dim, "a"), (7, [float("nan")] * dim, None), (8, [math.inf] + [0.0] * (dim - 1), "b")]
    got = vector_codes.compress(vectors(spark, rows)).select(*COLUMNS)
    assert Counter(tuple(r) for r in got.collect()) == plain_codes(rows)


def test_codes_wide_numbers(spark):
    """Components far beyond 64 bits train and are coded exactly; an error that no long holds is null, and so is its label's sum."""
    rnd = random.Random(1)
    rows = [(i, [rnd.choice([1e30, -2.5e25, 3.0, -1e-9, 1e300, 7e12]) * rnd.random() for _ in range(16)], i % 2) for i in range(80)]
    want = {i: (code, e, s, sha) for (i, code, e, s, sha) in plain_codes(rows)}
    for r in vector_codes.compress(vectors(spark, rows)).collect():
        code, e, s, sha = want[r.vec_id]
        assert (r.code, r.error, r.codebooks_sha256) == (code, e if e < 2**63 else None, sha)
        assert r.label_error == (s if s < 2**63 else None) or r.label_error is None


def test_codes_other_dimensions_and_empty(spark):
    rows = [(i, [i / 256.0] * 16, "a") for i in range(5)] + [(9, [1.0, 2.0], "b"), (10, [], "b")]
    got = {r.vec_id: r for r in vector_codes.compress(vectors(spark, rows)).collect()}
    assert got[3].code == "03" * 16 and got[3].error == 0 and got[9].code is None and got[10].label_error is None and got[3].label_error == 0
    assert vector_codes.compress(vectors(spark, rows).limit(0)).count() == 0


def test_codes_search_skips():
    """The bound leaves most distances out, and never the nearest entry or the lower of two."""
    rnd = np.random.default_rng(3)
    x, e = rnd.integers(-200, 200, (3000, 4)), rnd.integers(-200, 200, (64, 4))
    which, best, took = vector_codes.search(x, e)
    far = ((x[:, None] - e[None]) ** 2).sum(axis=2)
    assert (which == far.argmin(axis=1)).all() and (best == far.min(axis=1)).all() and took < 0.6 * 64 * len(x)


def test_codes_hot_labels(spark):
    """A label of most rows, and as many labels as rows."""
    rows = [(i, [(i * k % 17) / 64 for k in range(16)], "hot" if i % 2 else f"l{i}") for i in range(3000)]
    assert Counter(tuple(r) for r in vector_codes.compress(vectors(spark, rows)).select(*COLUMNS).collect()) == plain_codes(rows)


# alignment


class Plain:
    def __init__(self):
        self.sp, self.tk = sentencepiece.SentencePieceProcessor(model_file=PIECES), Tokenizer.from_file(BYTES)
        self.tk.encode_special_tokens = True
        keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = dict(zip(keep, keep, strict=True)) | {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in keep)}
        self.back = {chr(c): b for b, c in letters.items()}

    def one(self, i):
        return bytes(self.back[c] for c in self.tk.id_to_token(i))

    def other(self, i):
        p = self.sp.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if self.sp.is_byte(i) else p.replace("▁", " ").encode()

    def align(self, rows):
        links, out, count, top = [], [], Counter(), Counter()
        for _, t in rows:
            t = t or ""
            raw = (" " + t).encode()
            a, b = self.tk.encode(" " + t, add_special_tokens=False).ids, self.sp.encode(t)
            if not t or not b"".join(map(self.one, a)) == raw == b"".join(map(self.other, b)):
                a = b = []
            ends = [[sum(map(len, map(f, ids[: i + 1]))) if len(ids) < 50 else None for i in range(len(ids))] for f, ids in ((self.one, a), (self.other, b))]
            for e, f, ids in zip(ends, (self.one, self.other), (a, b), strict=True):
                at = 0
                for i, x in enumerate(ids):
                    at += len(f(x))
                    assert e[i] in (None, at)
                    e[i] = at
            i = j = 0
            mine, groups, now = [], [], ([], [])
            while i < len(a):
                mine.append((a[i], b[j]))
                x, y = ends[0][i], ends[1][j]
                if x <= y:
                    now[0].append(a[i])
                    i += 1
                if y <= x:
                    now[1].append(b[j])
                    j += 1
                if x == y:
                    groups.append(now)
                    now = ([], [])
            links.append(mine)
            count.update(mine)
            text = ";".join("|".join(",".join(map(str, s)) for s in g) for g in groups)
            out.append((len(a), len(b), len(groups), len(mine), hashlib.sha256(text.encode()).hexdigest() if text else ""))
        for (_, b), n in count.items():
            top[b] = max(top[b], n)
        return Counter((d, *o[:4], sum(count[p] == top[p[1]] for p in m), sum(count[p] for p in m), o[4]) for (d, _), o, m in zip(rows, out, links, strict=True))


ALIGNED = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_alignment(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    got = queries.op12_alignment(spark, sf)
    assert Counter(tuple(r) for r in got.select(*ALIGNED).collect()) == Plain().align([(r.doc_id, r.text) for r in df.collect()])


def test_alignment_odd(spark, monkeypatch):
    rnd = random.Random(5)
    texts = ["<|endoftext|> plain <s> </s> <0x41> <unk>", "a▁b", "  two  spaces   three ", "\n\n\t x \r\n", " lead", "trail ", "　wide space", "x" * 3000, "日本語のテキスト🤖👩‍👩‍👧", "é" * 50, "\x00nul", "don't we'll I'm", "a" * 31 + " " * 65 + "b"]
    texts += ["".join(rnd.choices(" ab\n\té日🤖'1.<|>", k=rnd.randint(1, 60))) for _ in range(400)]
    rows = [(i, t, None, None, None, "s", "c") for i, t in enumerate(texts)] + ODD
    for links in (alignment.LINKS, 50):
        monkeypatch.setattr(alignment, "LINKS", links)
        got = alignment.align(spark.createDataFrame(rows, DOCS), BYTES, PIECES)
        assert Counter(tuple(r) for r in got.select(*ALIGNED).collect()) == Plain().align([r[:2] for r in rows])
    assert alignment.align(spark.createDataFrame(rows, DOCS).limit(0), BYTES, PIECES).count() == 0


def test_common_ends():
    """Cuts everywhere, nowhere, near one side only; found in few looks where a stretch has none."""
    rnd = random.Random(2)
    for n in (1, 2, 3, 50, 1000):
        for share in (0.0, 0.01, 0.5, 1.0):
            a = np.cumsum([rnd.randint(1, 4) for _ in range(n)])
            b = np.array(sorted({int(a[-1])} | {int(x) for x in a if rnd.random() < share} | {rnd.randint(1, int(a[-1])) for _ in range(n)}))
            docs = np.array([n - 1])
            assert alignment.common_ends(a, b, docs).tolist() == [i for i, x in enumerate(a.tolist()) if x in set(b.tolist())]


# personal data

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(s):
    d = [int(c) for c in s if c in "0123456789"][::-1]
    return 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0


def plain_base(text):
    good = {"email": lambda s: True, "ip": lambda s: all(int(x) <= 255 for x in s.split(".")), "card": luhn, "phone": lambda s: 9 <= sum(c in "0123456789" for c in s) <= 15}
    return [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, text or "") if good[k](m[0])]


def check_base(rows, got):
    want = Counter()
    for d, t in rows:
        spans = plain_base(t)
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        want[d, *(sum(s[0] == k for s in spans) for k in BASE), hashlib.sha256(said.encode()).hexdigest()] += 1
    assert Counter(tuple(r)[:6] for r in got) == want
    order = list(BASE)
    of = defaultdict(list)
    for d, t in rows:
        of[d].append({f"{k}:{a}:{b}" for k, a, b in plain_base(t)})
    for r in got:
        spans = r.spans.split(",") if r.spans else []
        assert any(b <= set(spans) for b in of[r.doc_id])
        assert [s for s in spans] == sorted(spans, key=lambda s: (order.index(s.split(":")[0]), int(s.split(":")[1])))


def test_personal_data(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    got = queries.op13_personal_data(spark, sf)
    assert got.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    check_base([(r.doc_id, r.text) for r in df.collect()], got.collect())


def test_personal_data_odd(spark):
    rnd = random.Random(4)
    texts = ["a@b.c.d@e.f", "@x.y", "a@b", "a.b@c-.d.e.", "1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.1", "001.02.3.0000255", "4111 1111 1111 1111", "4111-1111 11111111", "12 4111111111111111", "+1 (212) 555-0100 10.0.0.1", "+49(0)30 123456)", "+12345678", "é4111111111111111é", "١٢٣.1.1.1"]
    texts += ["".join(rnd.choices("a.@-+ 01234589()é", k=rnd.randint(1, 50))) for _ in range(1500)]
    rows = [(i, t, None, None, None, "s", "c") for i, t in enumerate(texts)] + ODD
    check_base([r[:2] for r in rows], personal_data.personal_data(spark.createDataFrame(rows, DOCS)).collect())
    assert personal_data.personal_data(spark.createDataFrame(rows, DOCS).limit(0)).count() == 0


@pytest.mark.parametrize("unit", ["a", "1", "1.", "a@", "+1", "1 ", "@", "(at)", " at ", "::", "(.)", "a.b@", "+1 ("])
def test_personal_data_is_linear(unit):
    """300,000 characters of anything in a few seconds."""
    import time

    text = unit * (300_000 // len(unit))
    start = time.process_time()
    good, bad = personal_data.base_spans(text)
    personal_data.candidates(text, good, bad)
    assert time.process_time() - start < 8


def test_personal_data_adds(spark):
    """Written-out spans in telling contexts are added, look-alikes in others not; nothing is added to plain prose."""
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choices("abcdefghijklmnoprstu", k=rnd.randint(3, 8)))
    prose = lambda: " ".join(word() for _ in range(8))

    def card():
        d = "4" + "".join(rnd.choices("0123456789", k=14))
        return next(d + c for c in "0123456789" if luhn(d + c))

    rows, want, never = [], {}, set()
    for i in range(1200):
        d = card()
        yes = [f"email {word()} [at] {word()} [dot] com", f"mail me: {word()} (at) {word()}.org", f"server 10[.]2[.]{i % 250}[.]7", f"card {d[:4]}.{d[4:8]}.{d[8:12]}.{d[12:]}", f"phone (030) 555-{rnd.randint(1000, 9999)}-{rnd.randint(10, 99)}", f"call 0049 30 {rnd.randint(100000, 999999) // 100} {rnd.randint(100, 999)}"]
        plain = [f"mail {word()}@{word()}.com", f"server {rnd.randint(1, 250)}.20.30.40", f"card {d}", f"call +49 30 {rnd.randint(100000, 999999)}"]
        no = [f"we look at {word()}.{word()}", f"page 120-220 {rnd.randint(1000, 9999)}%", f"isbn 4{rnd.randint(10**14, 10**15 - 1)}"]
        kind = i % 4
        said = rnd.choice(yes if kind == 0 else plain if kind in (1, 2) else no)
        head = prose() + " "
        text = head + said + " " + prose()
        rows.append((i, text))
        if kind == 0:
            want[i] = text[len(head) :][: len(said)]
        elif kind == 3:
            never.add(i)
    rows.append((5000, " ".join(prose() for _ in range(50))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in personal_data.personal_data(df).collect()}
    assert sum(bool(got[i]) for i in want) >= 0.9 * len(want)
    assert sum(bool(got[i]) for i in never) <= 0.05 * len(never)
    assert got[5000] == ""
    again = {r.doc_id: r.spans for r in personal_data.personal_data(df.repartition(7, F.rand(1))).collect()}
    assert again == got


def test_personal_data_reliabilities():
    """Estimated without labels: a labeler that is right, one that is often wrong, one that guesses."""
    rnd = random.Random(7)
    counts = Counter()
    for _ in range(20000):
        y = rnd.random() < 0.3
        right = lambda p: "+" if (rnd.random() < p) == y else "-"  # noqa: B023, E731
        counts["".join([right(0.95), right(0.8), rnd.choice("-0+"), right(0.7)])] += 1
    share, table, _ = personal_data.reliabilities(counts)
    assert abs(share - 0.3) < 0.05 and abs(table[0, 1, 2] - 0.95) < 0.04 and abs(table[1, 1, 2] - 0.8) < 0.04 and abs(table[2, 1, 2] - 1 / 3) < 0.04 and abs(table[3, 0, 0] - 0.7) < 0.04
