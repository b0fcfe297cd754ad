"""The pipeline against plain versions of its stages."""

import gc
import random
import weakref
from collections import Counter

import sentencepiece

import corpus_pipeline
from tests.llm.test_brute_force import grouped
from tmweave.llm import common, mixing, queries
from tmweave.llm.common import stage


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = spark.createDataFrame([(100_000, "12 34 !!", "en", "src1", 8), (100_001, None, None, None, 0), (100_002, "", "en", "src1", 0)], docs.schema)
    docs = docs.union(extra)
    steps = [docs]
    for name, f in corpus_pipeline.STAGES:
        steps.append(stage(f(spark, steps[-1], sf), "test"))
    for df in steps[:-1]:
        assert df.columns == docs.columns
    ids = [[r.doc_id for r in df.select("doc_id").collect()] for df in steps]
    assert not {100_000, 100_001, 100_002} & set(ids[1]) and len(ids[1]) >= 0.98 * len(ids[0]) - 3
    rows = [(r.doc_id, r.text) for r in steps[1].collect()]
    assert sorted(ids[2]) == sorted({c for _, _, c in grouped(rows, 5, 80, 100)})
    plan = mixing.plan_copies(steps[2]).collect()
    assert Counter(ids[3]) == Counter({r.doc_id: r.copies for r in plan if r.copies})
    sp = sentencepiece.SentencePieceProcessor(model_file=queries.vocabulary("piece_bpe_32k.model"))
    text = {r.doc_id: r.text for r in docs.collect()}
    assert Counter((r.doc_id, tuple(r.ids)) for r in steps[4].collect()) == Counter((d, tuple(sp.encode(text[d]))) for d in ids[3])


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0


def test_language_rejects(spark, sf):
    """Letter junk and texts in a language or script that wasn't learned go; the table's own documents stay."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rnd = random.Random(3)
    junk = [" ".join("".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=rnd.randint(2, 10))) for _ in range(n)) for n in (5, 20, 100, 500)]
    other = [
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.", "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw.",
        "Все люди рождаются свободными и равными в своем достоинстве и правах.", "人人生而自由,在尊严和权利上一律平等。", "มนุษย์ทั้งหลายเกิดมามีอิสระ",
    ]
    planted = [(200_000 + i, t, lang, "src0", len(t)) for i, t in enumerate(junk + other) for lang in ("en", None)]
    kept = {r.doc_id for r in corpus_pipeline.language(spark, docs.union(spark.createDataFrame([(i * 2 + (k is None), t, k, s, n) for i, t, k, s, n in planted], docs.schema)), sf).select("doc_id").collect()}
    assert not {i for i in kept if i >= 200_000}
    assert {r.doc_id for r in docs.select("doc_id").collect()} <= kept


class Held:
    """What a task has at hand."""


def test_memory_goes_back_when_a_task_holds_nothing_more(monkeypatch):
    seen = []

    def run(batches):
        for b in batches:
            own = Held()
            seen.append(weakref.ref(own))
            yield b

    monkeypatch.setattr(common, "give_back", lambda: seen.append(gc.collect() >= 0 and [r() for r in seen]))
    assert list(common.tidy(run)(iter([1, 2]))) == [1, 2]
    assert seen[2:] == [[None, None]]


def test_python_tasks_of_all_stages_give_memory_back(spark, sf, monkeypatch):
    docs, ran = spark.read.parquet(f"{sf}/documents.parquet"), []
    plain = type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, *args, **how: ran.append(f) or plain(self, f, *args, **how))
    for _, f in corpus_pipeline.STAGES:
        f(spark, docs, sf)
    assert len({f.__code__ for f in ran}) == 1 and {f.__wrapped__.__module__.rpartition(".")[2] for f in ran} == {"language_id", "jaccard_join", "sentencepiece_wfst"}
