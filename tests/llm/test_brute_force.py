"""Each operator's query against a plain version of its contract, over the smallest tables and over awkward rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tmweave.llm import fingerprints, html_extract, jaccard_join, language_id, mixing, queries, sentencepiece_wfst, token_counts, token_records, topk, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, copies string"
BIG = " ".join(f"word{i % 701} x{i}" for i in range(20000))
ODD = [
    (1, "one two three four five six seven", "en", "a", 0, "x", "y"), (2, "One two three four five six seven", "en", "a", 0, None, None), (2, "One two three four five six seven", "en", "a", 0, None, None),
    (3, None, None, None, None, None, None), (4, "", "de", "b", 0, "", ""), (5, " \t\n", "de", None, 0, "", ""), (6, BIG, "en", "a", 0, "", ""), (7, BIG + " tail", "en", "b", 0, "", ""),
    (-8, "été à l'école\n\n  déjà vu ▁ 日本語 🤖", "fr", "é", 0, "", ""), (9, "two", "fr", "z", 0, "", ""), (10, "two", None, "z", 0, "", ""), (None, "no id here at all", "en", "a", 0, "", ""), (11, "12345 !!! 67", "en", "a", 0, "", ""),
]
WORD = re.compile(r"[^\x20\x09-\x0d]+")


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


def shingles(text, k):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORD.findall(text or "")]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def grouped(rows, k, num, den):
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and min(len(a), len(sets[j])) * den >= num * max(len(a), len(sets[j])):
                if len(a & sets[j]) * den >= num * len(a | sets[j]):
                    root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)].append(d)
    return Counter((d, len(sets[i]), d if not sets[i] else min(least[find(i)], default=None)) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("k,num", [(3, 90), (5, 80), (1, 50)])
def test_jaccard(spark, docs, odd, k, num):
    for df in (docs, odd):
        want = grouped([(r.doc_id, r.text) for r in df.collect()], k, num, 100)
        got = Counter(tuple(r) for r in jaccard_join.similar_groups(df, words=k, num=num, den=100).collect())
        assert got == want


def test_jaccard_dense_group(spark):
    """Near copies of one text, too many edits apart to be linked all with all."""
    base = [f"w{i}" for i in range(150)]
    rows = []
    for d in range(160):
        w = list(base)
        for e in range(d % 6):
            w[(d * 37 + e * 41) % 150] = f"e{d}_{e}"
        rows.append((d, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for k, num in ((3, 90), (5, 80)):
        assert Counter(tuple(r) for r in jaccard_join.similar_groups(df, words=k, num=num, den=100).collect()) == grouped(rows, k, num, 100)


def test_jaccard_keeps_one(spark, odd):
    kept = jaccard_join.one_of_each(odd, words=3, num=90)
    assert kept.columns == odd.columns
    assert sorted([r.doc_id for r in kept.collect()], key=str) == sorted([1, 3, 4, 5, 6, -8, 9, None, 11], key=str)


def test_jaccard_keeps_one_by_row(spark):
    """One id on two texts: only the copy goes; copies without an id leave one row."""
    t = {c: " ".join(f"{c}{i}" for i in range(20)) for c in "abcd"}
    rows = [(1, t["a"]), (2, t["a"]), (2, t["b"]), (3, t["b"] + " more"), (4, t["c"]), (4, t["d"]), (4, t["d"]), (None, t["c"] + " x"), (None, "n1 n2 n3 n4"), (None, "n1 n2 n3 n4"), (None, ""), (None, "")]
    kept = jaccard_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"), words=3, num=80)
    want = [(1, t["a"]), (2, t["b"]), (4, t["c"]), (4, t["d"]), (None, "n1 n2 n3 n4"), (None, ""), (None, "")]
    assert Counter(tuple(r) for r in kept.collect()) == Counter(want)


def test_language(spark, docs, odd):
    rows = language_id.identify(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and re.search(r"[^\W\d_]", r.text or "")]
    assert sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held)
    got = {r.doc_id: r.lang_pred for r in language_id.identify(odd).collect()}
    assert [got[k] for k in (3, 4, 5, 11)] == ["und"] * 4 and got[6] in {"en", "fr", "de"}
    assert {r.lang_pred for r in language_id.identify(odd.where("lang is null")).collect()} == {"und"}
    assert language_id.identify(odd.limit(0)).count() == 0


def near_targets(df, rows):
    """Each source takes its target, but for a twentieth or half of the smallest document that is large against it."""
    source = {r.doc_id: r.source for r in df.collect()}
    taken, target, large = Counter(), {}, defaultdict(lambda: [0])
    for r in rows:
        s = source[r.doc_id]
        taken[s] += r.copies * r.size
        target[s] = r.target
        if r.size * mixing.LARGE > r.target:
            large[s].append(r.size)
    for s, t in target.items():
        assert abs(taken[s] - t) <= max(0.05 * t, min(large[s][1:], default=0) / 2 + 1), (s, t, taken[s])


def test_mixing_larger(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    near_targets(df, mixing.plan_copies(df).collect())


def test_mixing_keeps_columns(spark, odd):
    df = odd.select("*", *(F.lit("mine").alias(c) for c in ("k", "h", "row", "rows", "_k", "_n", "a.b", "bucket")))
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns and {r["k"] for r in mixed.collect()} == {"mine"}
    assert mixing.mix(df.limit(0)).count() == 0


def test_mixing(spark, docs, odd):
    for df in (docs, odd):
        rows = mixing.plan_copies(df).collect()
        assert len(rows) == df.count()
        full = Counter()
        for r in df.collect():
            full[r.source] += len(WORD.findall(r.text or ""))
        names = sorted((s for s in full if s is not None), key=lambda s: s.encode()) + [None] * (None in full)
        weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
        target, free, left = {}, set(names), float(sum(full.values()))
        while True:
            w = sum(weight[s] for s in free)
            over = {s for s in free if left * weight[s] / w > 3 * full[s]} if w else set()
            if not over:
                target |= {s: left * weight[s] / w for s in free}
                break
            target |= {s: 3.0 * full[s] for s in over}
            left -= sum(3.0 * full[s] for s in over)
            free -= over
        by_size = defaultdict(list)
        for s in names:
            by_size[full[s]].append(target[s])
        assert all(any(math.isclose(r.target, t, rel_tol=1e-9, abs_tol=1e-9) for t in by_size[r.source_size]) for r in rows)
        assert all(0 <= r.copies <= 3 for r in rows)
        near_targets(df, rows)
        again = {(r.doc_id, r.row_hash, r.copies) for r in mixing.plan_copies(df.repartition(3)).collect()}
        assert again == {(r.doc_id, r.row_hash, r.copies) for r in rows}
        mixed = mixing.mix(df)
        assert mixed.columns == df.columns and mixed.count() == sum(r.copies for r in rows)


def test_fingerprints(spark, docs, odd):
    for df in (docs, odd):
        rows = [(r.doc_id, r.text or "") for r in df.collect()]
        h = {(r.doc_id, r.t): r.h for r in df.select("doc_id", F.coalesce("text", F.lit("")).alias("t"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
        order = sorted(set(rows), key=lambda r: (-(r[0] if r[0] is not None else -(2**63)), h[r]))
        nxt = {r: order[(i + 1) % len(order)][1] for i, r in enumerate(order)}
        want = Counter()
        for d, t in rows:
            cut = len(t) // 3
            edited = t[: len(t) - cut] + nxt[d, t][:cut]
            want[d, len(t), hashlib.sha256(edited.encode()).hexdigest()] += 1
        got = fingerprints.fingerprint_edits(df).collect()
        assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
        assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
        if df is docs:
            text, err = {r.doc_id: r.text for r in df.collect()}, []
            for r in got:
                a, t = shingles(text[r.doc_id], 5), nxt[r.doc_id, text[r.doc_id]]
                b = shingles(t, 5)
                err.append(abs(r.near_next - len(a & b) / max(1, len(a | b))))
            assert max(err) < 0.25 and sum(err) / len(err) < 0.01
            assert len({r.fingerprint for r in got}) == len({tuple(sorted(shingles(t, 5))) for t in text.values()})


def test_top_k(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", F.lit(1).alias("score"))
    extra = spark.createDataFrame([(100_000, None, 1), (100_100, [float("nan")] * 64, 1), (100_200, [0.5] * 3, 1), (100_201, [0.5, -0.25, 1.0], 1), (100_202, [0.0, 0.0, 9.0], 1), (100_300, [], 1), (None, [0.1] * 64, 1), (7, [0.1, None] * 32, 1)], "vec_id long, embedding array<float>, score int")
    df = df.union(extra).union(df.where("vec_id between 3 and 40").selectExpr("vec_id + 200001", "embedding", "score"))
    rows = [(r.vec_id, [math.floor(1024 * x) for x in r.embedding]) for r in df.collect() if r.vec_id is not None and r.embedding is not None and all(x is not None and math.isfinite(x) for x in r.embedding)]
    want = set()
    for q, v in rows:
        if q % 100 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in rows if i != q and len(w) == len(v))[:10]
            want |= {(q, n, i, -s) for n, (s, i) in enumerate(best, 1)}
    assert {tuple(r) for r in topk.top_k(df).collect()} == want
    assert topk.top_k(df.limit(0)).count() == 0


def nearest(rows):
    """Each distinct query row's ten best, by Python's own integers."""
    want = Counter()
    for q, v in {(q, tuple(v)) for q, v in rows if q % 100 == 0}:
        best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in rows if i != q and len(w) == len(v))[:10]
        want.update((q, n, i, -s) for n, (s, i) in enumerate(best, 1))
    return want


def test_top_k_repeats_and_large(spark, monkeypatch):
    """Repeated query rows, one id with two vectors, many blocks, components beyond 32 bits and scores beyond 53."""
    rows = [(i, [math.sin(i * j + j) * (1 + i % 7) for j in range(8)]) for i in range(600)]
    rows += [rows[100], rows[100], (200, [0.5] * 8), rows[7], (900, [3e5] * 8), (901, [-3e5 + i for i in range(8)]), (1000, [3e5, -1.0] * 4), (1001, [0.0] * 8)]
    monkeypatch.setattr(topk, "ROWS", 50)
    monkeypatch.setattr(topk, "QUERIES", 3)
    monkeypatch.setattr(topk, "CHUNK", 4)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert Counter(tuple(r) for r in topk.top_k(df.repartition(3)).collect()) == nearest([(i, [math.floor(1024 * x) for x in v]) for i, v in rows])
    big = [(0, [3e9, 0.0]), (1, [-1.5, 7.0]), (2, [1e15, 5.0]), (100, [0.0, 1e9]), (3, [0.0, 1.0])]
    got = topk.top_k(spark.createDataFrame(big[:2] + big[3:], "vec_id long, embedding array<double>"))
    with pytest.raises(Exception, match="beyond 64 bits"):
        topk.top_k(spark.createDataFrame(big, "vec_id long, embedding array<double>")).collect()
    assert Counter(tuple(r) for r in got.collect()) == nearest([(i, [math.floor(1024 * x) for x in v]) for i, v in big[:2] + big[3:]])


def test_sentencepiece(spark, docs, odd):
    import sentencepiece

    model = queries.vocabulary("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    for df in (docs, odd):
        text = [(r.doc_id, r.text or "") for r in df.collect()]
        want = Counter((d, tuple(sp.encode(t))) for d, t in text)
        got = sentencepiece_wfst.encode(df, model).collect()
        assert Counter((r.doc_id, tuple(r.ids)) for r in got) == want
        assert all(r.round_trip for r in got)
        back = sentencepiece_wfst.decode(sentencepiece_wfst.encode(df, model), model).collect()
        assert Counter(map(tuple, back)) == Counter((d, t.replace("▁", " ")) for d, t in text)
        counts = token_counts.token_counts(df, model).collect()
        assert Counter((r.doc_id, r.n_chars, r.n_tokens) for r in counts) == Counter((d, len(t), len(sp.encode(t))) for d, t in text)


def test_sentencepiece_odd_strings():
    import random

    import sentencepiece

    model = queries.vocabulary("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    random.seed(7)
    pieces = [sp.id_to_piece(i).replace("▁", " ") for i in range(3, sp.vocab_size())]
    texts = ["", " ", "  ", " " * 77 + "x" + " " * 33, "a" * 500, "\n\n a\n", "<s>a</s><unk><0x41>", "梦" * 300 + "ң\t\x00é"]
    texts += ["".join(random.choice("abcdefghij  \nétheinsd.,'\"<>/=0123日") for _ in range(random.randint(1, 60))) for _ in range(400)]
    texts += ["".join(random.choices(pieces, k=random.randint(1, 8))) for _ in range(800)]
    got = [x.tolist() for x in sentencepiece_wfst.encode_texts(model, texts)]
    assert got == sp.encode(texts)
    assert token_counts.count_texts(model, texts) == [len(x) for x in got]
    assert [sentencepiece_wfst.decode_ids(model, x) for x in got] == sp.decode(got)


def test_token_records(spark, docs, odd):
    import numpy as np
    from tokenizers import Tokenizer

    path = queries.vocabulary("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    for df in (docs, odd.union(spark.createDataFrame([(50, "a<|endoftext|>b  \n c", "en", "a", 0, "", ""), (51, "  lead  and trail \n", "en", "a", 0, "", "")], DOCS))):
        rows = sorted(((r.doc_id, r.text or "") for r in df.collect()), key=lambda r: (-(2**63) if r[0] is None else r[0], r[1]))
        start, want = 0, set()
        for d, x in rows:
            ids = [*t.encode(x, add_special_tokens=False).ids, 2]
            want.add((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
        assert {tuple(r) for r in token_records.round_trip(spark, df, path).collect()} == want


def test_checksums():
    """Known CRC-32C values, and all lengths against a bit-by-bit version."""
    assert token_records.crc32c([b"123456789", bytes(32), b"\xff" * 32]).tolist() == [0xE3069283, 0x8A9136AA, 0x62A8AB43]

    def slow(data):
        x = 0xFFFFFFFF
        for b in data:
            x ^= b
            for _ in range(8):
                x = x >> 1 ^ (0x82F63B78 if x & 1 else 0)
        return x ^ 0xFFFFFFFF

    some = [bytes((i * 7 + j) % 256 for j in range(i)) for i in range(300)]
    assert token_records.crc32c(some).tolist() == [slow(x) for x in some]
    frame = token_records.frames([b"hello", b""])
    assert token_records.unframed(frame) == [b"hello", b""]
    with pytest.raises(ValueError):
        token_records.unframed([frame[0][:-5] + b"X" + frame[0][-4:]])


def test_warc(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").withColumn("digest", F.lit("x"))
    long = "<p>" + "same " * 400
    extra = [(9001, "http://www.b.com/x", long, "d"), (9002, "https://b.com/x", long, "d"), (9003, None, long, "d"), (9004, "bad url \r\n\r\n", "short", "d"), (9005, "http://[", "short", "d"), (9006, "http://b.com/x", None, "d"), (9007, "http://c.com:99999/x", "a\r\n\r\nb", "d"), (None, "http://d.com", long, "d"), (9002, "https://b.com/x", long, "d")]
    df = pages.union(spark.createDataFrame(extra, "page_id long, url string, html string, digest string"))
    rows = [(r.page_id, r.url, (r.html or "").encode()) for r in df.collect()]
    top = {}
    for p, _, h in rows:
        if len(h) >= 1000 and p is not None:
            top[h] = max(p, top.get(h, p))
    want = Counter()
    for p, u, h in rows:
        again = len(h) >= 1000 and p is not None and p != top[h]
        want[p, u or "", len(h), hashlib.sha1(h).hexdigest(), "revisit" if again else "response", top[h] if again else None] += 1
    got = warc.round_trip(spark, df).drop("payload").collect()
    assert Counter(map(tuple, got)) == want
    assert warc.round_trip(spark, df.limit(0)).count() == 0


def test_warc_lookup(spark, sf):
    from tmweave.llm.common import new_path

    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html")
    many = spark.range(100).select((F.col("id") + 50_000).alias("page_id"), F.lit("http://WWW.hot.example/a?b=1").alias("url"), F.concat(F.lit("<p>same page "), F.repeat(F.lit("x"), F.lit(3000))).alias("html"))
    archives, index = new_path(spark, "a"), new_path(spark, "i")
    files = warc.write_index(warc.write_archives(pages.union(many), archives), index, lines=8)
    captures = warc.Captures(files.collect(), archives, index)
    for r in pages.limit(5).collect():
        found = captures.find(r.url)
        assert r.page_id in [x["page_id"] for x in found]
        assert next(x for x in found if x["page_id"] == r.page_id)["payload"] == r.html.encode()
    assert captures.find("http://nowhere.example/") == []
    hot = captures.find("https://hot.example/A?b=1")
    assert [x["page_id"] for x in hot] == list(range(50_000, 50_100)) and sum(x["record_type"] == "response" for x in hot) == 1
    # a revisit says of its payload what its response has
    assert {(x["payload_bytes"], x["payload_digest"]) for x in hot} == {(3013, hashlib.sha1(hot[-1]["payload"]).hexdigest())} and {x["refers_to"] for x in hot[:-1]} == {50_099}
    some = spark.createDataFrame([("http://hot.example/a?b=1",), ("http://nowhere.example/",), (None,), ("http://hot.example/a?b=1",)], "url string")
    assert sorted(r.page_id for r in warc.look_up(some, captures).collect()) == list(range(50_000, 50_100))


def test_html(spark, sf):
    got = {r.page_id: r for r in html_extract.extract(spark.read.parquet(f"{sf}/pages.parquet")).collect()}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)
        if inner:
            import html

            blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"</?(?:b|i|a|em|br)\b[^>]*>", " " if "br" in x else "", x))).strip() for x in re.split(r"</?(?:p|h1)>", inner[1].replace("<br>", " "))]
            assert got[r.page_id].text == "\n\n".join(x for x in blocks if x)
        assert got[r.page_id].n_chars == len(got[r.page_id].text)


def test_html_odd():
    f = html_extract.main_text
    assert f(None) == f("") == f("<script>x</script>") == ""
    body = "".join(f"<p>Paragraph {i} has enough words to be the article of this page, &amp; more.</p>" for i in range(5))
    want = "\n\n".join(f"Paragraph {i} has enough words to be the article of this page, & more." for i in range(5))
    assert f(f"<body><header>Top</header><nav><a>x</a></nav><div id=main>{body}<p>Be.</p></div><aside>s</aside><div class='comments'><p>A reader says a long thing about it all.</p></div><form>f<input></form><footer>foot</footer>") == want + "\n\nBe."
    assert f(f"<div class='cookie-notice'>We use cookies</div><main><h1>T</h1>{body}<div class=ad>Buy</div><p>a<br>b\n  c</p></main>") == "T\n\n" + want + "\n\na b c"
    assert f("just text &lt;b&gt;") == "just text <b>"
    assert f("<p>One<p>Two<ul><li>a<li>b</ul>") == "One\n\nTwo\n\na\n\nb"


def test_html_wrappers_and_sections():
    f = html_extract.main_text
    para = [f"Paragraph {i} has enough words to be the article of this page, and some more." for i in range(8)]
    body, nav = "".join(f"<p>{x}</p>" for x in para), "<ul>" + "".join(f"<li><a href=/{i}>Link {i}</a></li>" for i in range(12)) + "</ul>"
    for name in ("content has-sidebar", "no-ads", "with-comments", "search-results", "sidebar", "widget"):
        assert f(f"<body><nav>{nav}</nav><div class='{name}'><div class=entry-header><h1>Title</h1></div>{body}<div class='ad-box'>Buy this</div></div></body>") == "\n\n".join(["Title", *para])
    assert f(f"<body><main>{body}</main><div class=comments>{body * 3}</div></body>") == "\n\n".join(para)
    assert f(f"<body><main><p>{para[0]} <span class=ad>Buy</span></p></main></body>") == para[0]
    long = " ".join(para * 20)
    for inner in (f"<blockquote><p>Said:</p><p>{long}</p></blockquote>", f"<div><h2>Said:</h2><p>{long}</p></div>"):
        for menu in (f"<div>{nav}</div>", ""):
            page = f"<body>{menu}<div><div><h2>First</h2>{body}</div>{inner}<div><h2>Last</h2>{body}</div></div></body>"
            assert f(page) == "\n\n".join(["First", *para, "Said:", long, "Last", *para])


def thue_morse():
    """Two strings of 2048 letters that a polynomial hash modulo 2**64 can't tell apart, whatever its odd base."""
    bits = [bin(i).count("1") % 2 for i in range(2048)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_jaccard_tells_words_apart(spark):
    a, b = thue_morse()
    rows = [(1, a), (2, b), (3, f"one two {a} four"), (4, f"one two {b} four"), (5, f"{a} x"), (6, f"{a} X")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for k in (1, 3):
        assert Counter(tuple(r) for r in jaccard_join.similar_groups(df, words=k, num=90, den=100).collect()) == grouped(rows, k, 90, 100)


def test_jaccard_keeps_columns(spark, odd):
    """Columns of any name come through, and an empty table stays one."""
    df = odd.select("*", *(F.lit("mine").alias(c) for c in ("k", "h", "n", "row", "k1", "name", "salt", "a.b")))
    kept = jaccard_join.one_of_each(df, words=3, num=90)
    assert kept.columns == df.columns and {r["h"] for r in kept.collect()} == {"mine"} and kept.count() == 9
    assert jaccard_join.one_of_each(df.limit(0)).count() == jaccard_join.similar_groups(df.limit(0)).count() == 0


def test_html_named_parts_of_articles():
    """Names of parts that only look like marks, forms around whole pages, scripts without an end, menus outside any region."""
    f = html_extract.main_text
    para = [f"Paragraph {i} has enough words to be the article of this page, and some more." for i in range(8)]
    body = "".join(f"<p>{x}</p>" for x in para)
    for name in ("article-header", "entry-header", "share-price", "notice-of-meeting", "search-results", "login-guide", "related-work", "footer-note", "ad-hoc"):
        assert f(f"<body><article><div class='{name}'><h1>Title of it</h1><p>A sentence that belongs to it.</p></div>{body}</article></body>") == "\n\n".join(["Title of it", "A sentence that belongs to it.", *para])
    for name in ("page-with-sidebar", "job-search", "widget", "search"):
        assert f(f"<body><div class='{name}'>{body}</div></body>") == "\n\n".join(para)
    assert f(f"<body><form action=/x><input type=hidden><div>{body}</div></form></body>") == "\n\n".join(para)
    assert f(f"<body><div class=widget><article>{body}</article><div class=comments>{body * 4}</div></div></body>") == "\n\n".join(para)
    assert f(f"<body><script>var x = 1;\n<div>{body}</div></body>") == "\n\n".join(para)
    assert f(f"<body><div><a href=/>Home</a></div><div><a href=/x>News</a></div>{body}<p><a href=/y>More</a></p></body>") == "\n\n".join(para)
    assert f(f"<body><h1>Short</h1>{body}</body>") == "\n\n".join(["Short", *para])


def test_html_long_and_deep():
    """Time grows with the page's length."""
    import time

    f = html_extract.main_text
    start = time.time()
    assert f("<div>x" * 20000).count("x") == 20000
    assert f("<div class=widget>x" * 20000).count("x") == 10000  # those that hold half the page or less go
    assert f("<b>" * 20000 + "<p>y</p>" * 20000).count("y") == 20000
    assert f("<p>" + "word " * 400_000) == ("word " * 400_000).strip()
    assert f("<script>" * 20000) == "" and f("<li>z" * 20000).count("z") == 20000
    assert time.time() - start < 30


def test_language_kernel():
    """Kernels against their definition, on texts of several scripts and lengths."""
    import numpy as np

    texts = ["The cat sat on the mat", "Die Katze saß", "猫がマットに座った 猫", "แมวนั่งบนเสื่อ", "a", "ab", "a b", "", "12 x 34", "кот сидел на коврике", "ȺB İi"]

    def sets(t):
        s = "".join(c if c.isalpha() else "\0" for c in t.lower())
        return {s[i : i + n] for n in (1, 2, 3) for i in range(len(s) - n + 1)}

    got = [language_id.grams(language_id.points(t))[0] for t in texts]
    assert [sum(map(len, g)) for g in got] == [len(sets(t)) for t in texts]
    marks = [i for i, t in enumerate(texts) if t]
    vocab = [np.unique(np.concatenate([got[i][n] for i in marks])) for n in range(3)]
    held = [np.stack([np.isin(v, got[i][n]) for i in marks], 1) for n, v in enumerate(vocab)]
    m = language_id.Model([], vocab, np.concatenate([np.packbits(h, axis=1) for h in held]), np.sqrt([len(sets(texts[i])) for i in marks]), held[2].any(1))
    want = [[len(sets(t) & sets(texts[i])) / math.sqrt(max(1, len(sets(t))) * len(sets(texts[i]))) for i in marks] for t in texts]
    assert np.allclose(m.kernel(got), want)


def test_language_scripts(spark):
    """Languages in rare letters are told apart beside a frequent one in Latin letters."""
    import random

    rnd = random.Random(5)
    scripts = {"aa": "abcdefghijklmnopqrstuvwxyzäöüß", "zh1": [chr(0x4E00 + i) for i in range(700)], "zh2": [chr(0x4E00 + i) for i in range(600, 1300)], "th": [chr(0xE01 + i) for i in range(40)], "ka": [chr(0x10D0 + i) for i in range(33)]}
    rows = []
    for lang, letters in scripts.items():
        words = ["".join(rnd.choices(letters, k=rnd.randint(2, 6))) for _ in range(150)]
        rows += [(len(rows) * 7 + i, " ".join(rnd.choices(words, k=rnd.randint(20, 60))), lang) for i in range(60)]
    got = language_id.identify(spark.createDataFrame([(i, *r[1:]) for i, r in enumerate(rows)], "doc_id long, text string, lang string")).collect()
    assert all(r.lang_pred == rows[r.doc_id][2] for r in got)


def test_parts_tell_words_apart(spark):
    """Strings that meet under the parts' hash, and long words without a space, in operators 5, 7 and 10; ids as the libraries give them."""
    import random

    import sentencepiece
    from tokenizers import Tokenizer

    a, b = thue_morse()
    rnd = random.Random(2)
    texts = [a, b, f"{b} {a}", f"x {a} y", f"x {b} y"] * 2 + ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz0123/", k=n)) for n in (63, 64, 65, 66, 1000, 9000)]
    texts += [" ".join("".join(rnd.choices("abcé日\n", k=rnd.randint(60, 200))) for _ in range(30))]
    model = queries.vocabulary("piece_bpe_32k.model")
    want = sentencepiece.SentencePieceProcessor(model_file=model).encode(texts)
    assert [x.tolist() for x in sentencepiece_wfst.encode_texts(model, texts)] == want
    assert token_counts.count_texts(model, texts) == [len(x) for x in want]
    path = queries.vocabulary("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    assert [x.tolist() for x in token_records.encoder(path).ids(texts)] == [whole.encode(t, add_special_tokens=False).ids for t in texts]
    other = queries.vocabulary("word_bpe_49k.json")
    assert [x.tolist() for x in token_records.encoder(other).ids(["A Text of WORDS", "two  words"])] == [Tokenizer.from_file(other).encode(t, add_special_tokens=False).ids for t in ("A Text of WORDS", "two  words")]


def test_long_words_in_linear_time():
    import random
    import time

    model = queries.vocabulary("piece_bpe_32k.model")
    word = "".join(random.Random(4).choices("abcdefghijklmnopqrstuvwxyz", k=80_000))
    sentencepiece_wfst.encode_texts(model, ["x"]), token_counts.count_texts(model, ["x"])
    start = time.time()
    assert len(sentencepiece_wfst.encode_texts(model, [word])[0]) == token_counts.count_texts(model, [word])[0]
    assert time.time() - start < 20


def test_language_learns_from_all_rows(spark):
    """Sums, known n-grams and the cut against plain versions over every labelled row, far more than there are landmarks."""
    import numpy as np

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = language_id.held_out()
    rows, counts = language_id.labelled(docs, ~held, "doc_id", "lang", "text")
    all_rows = [(r.lang, language_id.grams(language_id.points(r.text))[0]) for r in rows.collect()]
    assert len(all_rows) == sum(counts.values()) > 640
    model = language_id.fit(docs, ~held)
    k = np.concatenate([model.kernel([g for _, g in all_rows[i : i + 100]]) for i in range(0, len(all_rows), 100)])
    y = np.array([[1.0 if v == lang else -1.0 for lang in model.langs] for v, _ in all_rows])
    w = np.array([1 / counts[v] for v, _ in all_rows])
    z = np.concatenate([k, y, np.ones((len(k), 1))], axis=1)
    got = language_id.products(rows, model, {v: 1 / n for v, n in counts.items()})
    assert np.allclose(got, (z * w[:, None]).T @ z) and math.isclose(got[-1, -1], len(counts))
    # the weighted residuals of all rows sum to nothing
    assert np.allclose(w @ (k @ model.coef + model.bias - y), 0, atol=1e-6)
    holders = Counter((v, g) for v, s in all_rows for g in s[-1].tolist())
    want = sorted((g, v) for (v, g), n in holders.items() if n >= max(2, counts[v] / 32))
    sure = language_id.calibrate(docs, model, held)
    assert sorted((int(sure.known[i]), sure.langs[j]) for i, j in zip(*np.nonzero(sure.knows))) == want
    own = defaultdict(list)
    for r in docs.where(held & F.col("lang").isNotNull()).collect():
        if r.text and re.search(r"[^\W\d_]", r.text):
            own[r.lang].append(sure.evidence(*language_id.whole(language_id.points(r.text))))
    cells = sorted((x, 1 / len(e)) for e in own.values() for x in e)
    upto = np.cumsum([c for _, c in cells])
    median = cells[int(np.searchsorted(upto, upto[-1] / 2))][0]
    assert 0 < sure.cut < median and sure.cut == language_id.calibrate(docs.repartition(3), model, held).cut
    assert math.isclose(language_id.middle([(r, c) for r, c in ((round(x * language_id.STEPS), c) for x, c in cells)]), median, abs_tol=2 / language_id.STEPS)
