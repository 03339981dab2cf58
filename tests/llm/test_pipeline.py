from collections import defaultdict

import brute
import corpus_pipeline
from samples import SF
from tokenizers import Tokenizer

from almacen.llm import queries, secrets
from almacen.llm.common import table


def test_stages_keep_columns_and_take_effect(spark):
    docs = table(spark, SF, "documents")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        out = stage(spark, docs, SF)
        assert out.columns == columns
        rows = out.collect()
        after = {r["doc_id"]: r["text"] for r in rows}
        assert len(after) == len(rows) and set(after) <= set(before)
        if name == "language_id":
            assert all(any(c.isalpha() for c in t or "") for t in after.values())
        if name == "exact_dedup":
            assert set(after) == {i for i, _, _, kept, _ in brute.exact(list(before.items())) if kept}
        if name == "near_dedup":
            assert set(after) == {i for i, (_, c) in brute.jaccard(list(before.items()), 5, 80).items() if i == c}
        if name == "secret_scan":
            assert set(after) == set(before)
            assert not any(secrets.scan(t) for t in after.values())
        seen[name] = after
        docs = spark.createDataFrame(rows, out.schema)
    lib = Tokenizer.from_file(queries.tokenizer("word_bpe_49k.json"))
    lengths = defaultdict(int)
    for p in corpus_pipeline.run(spark, SF).collect():
        lengths[p["doc_id"]] += p["length"]
    assert dict(lengths) == {i: len(lib.encode(t, add_special_tokens=False).ids) + 1
                             for i, t in seen["secret_scan"].items()}


def test_empty_and_odd_documents(spark, odd, empty):
    for docs in (odd.select("doc_id", "text", "lang", "source"), empty.select("doc_id", "text", "lang", "source")):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
        docs.count()


def test_near_copies_are_linked_by_five_words_and_four_fifths(spark):
    words = [f"w{i}" for i in range(200)]
    edited = list(words)
    for k in (20, 70, 120, 170):
        edited[k] = "edited"
    rows = [(1, " ".join(words)), (2, " ".join(edited)), (3, " ".join(words[::-1]))]
    assert brute.jaccard(rows)[2][1] == 2 and brute.jaccard(rows, 5, 80)[2][1] == 1
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()} == {1, 3}
    rows = [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").collect()]
    rows = [(i, t) for (i, t), (*_, kept, _) in zip(rows, brute.exact(rows)) if kept]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()}
    assert got == {i for i, (_, c) in brute.jaccard(rows, 5, 80).items() if i == c}


def test_a_verdict_holds_for_an_id_and_a_text(spark):
    words = [f"w{i}" for i in range(120)]
    near = " ".join(words[:60] + ["edited"] + words[61:])
    alone = [" ".join(f"{c}{i}" for i in range(120)) for c in "abcd"]
    rows = [(5, alone[0]), (None, alone[0]), (None, "a text of its own"), (1, alone[0]), (1, alone[1]),
            (7, " ".join(words)), (8, near), (8, alone[2]), (8, alone[2]), (9, alone[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs = corpus_pipeline.drop_exact_copies(spark, docs, SF)
    assert {tuple(r) for r in docs.collect()} == set(rows) - {(None, alone[0]), (1, alone[0])}
    docs = corpus_pipeline.drop_near_copies(spark, docs, SF)
    assert {tuple(r) for r in docs.collect()} == set(rows) - {(None, alone[0]), (1, alone[0]), (8, near)}


def test_every_text_of_a_repeated_id_is_linked(spark):
    texts = [" ".join(f"{c}{i}" for i in range(120)) for c in "ab"]
    near = [" ".join(t.split()[:-1]) for t in texts]
    rows = [(1, texts[0]), (1, texts[1]), (2, near[0]), (3, near[1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()} == set(rows[:2])
