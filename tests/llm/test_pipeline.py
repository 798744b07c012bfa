import re

import corpus_pipeline
import pyarrow as pa
from folioloom.llm.mixing import taken_words
from folioloom.llm.queries import tokenizer
from folioloom.llm.toxicity import toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DATA = "/root/testdata/sf0.001"


def sets(text, n=5):
    w = WORD.findall((text or "").lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def test_each_stage_against_plain_python(spark):
    import sentencepiece

    docs = corpus_pipeline.table(spark, DATA, "documents")
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept[-1], DATA)
        assert out.columns == docs.columns
        kept.append(corpus_pipeline.written(out, "stage"))
    rows = [[r.asDict() for r in df.collect()] for df in kept]
    ids = [{r["doc_id"] for r in part} for part in rows]
    # toxicity: what it predicts goes
    assert ids[1] == {r.doc_id for r in toxicity(docs, corpus_pipeline.table(spark, DATA, "labels")).where("predicted = 0").collect()}
    # near copies: no two that stay link, and each that goes is reached by links
    own = {r["doc_id"]: sets(r["text"]) for r in rows[1]}
    up = {d: d for d in own}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in own:
        for b in own:
            if a < b and own[a] and 5 * len(own[a] & own[b]) >= 4 * len(own[a] | own[b]):
                up[max(root(a), root(b))] = min(root(a), root(b))
    assert ids[2] == {d for d in own if root(d) == d}
    # repeated passages: words only go, and no 51 words in a row stand in two documents
    before = {r["doc_id"]: r["text"] for r in rows[2]}
    seen = {}
    for r in rows[3]:
        words = WORD.findall(before[r["doc_id"]] or "")
        left = WORD.findall(r["text"] or "")
        assert len(left) == len(words) or len(words) - len(left) >= 51
        assert len(left) < len(words) or r["text"] == before[r["doc_id"]]
        low = [w.lower() for w in left]
        for i in range(len(low) - 50):
            assert seen.setdefault(tuple(low[i : i + 51]), r["doc_id"]) == r["doc_id"]
    # mixing: each document's words as often as its source's target says
    taken = {r.doc_id: r.taken for r in taken_words(kept[3]).collect()}
    per = {}
    for r in rows[4]:
        per[r["doc_id"]] = per.get(r["doc_id"], 0) + len(WORD.findall(r["text"] or ""))
    assert {d: n for d, n in per.items() if n} == {d: n for d, n in taken.items() if n}
    # encoding: the library's ids
    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model"))
    last = corpus_pipeline.STAGES[-1][1](spark, kept[4], DATA)
    ids = sorted((r.doc_id, list(r.ids)) for r in last.collect())
    assert ids == sorted((r["doc_id"], model.encode(r["text"] or "")) for r in rows[4])


def test_texts_reach_the_first_stage_in_small_batches(spark, monkeypatch):
    def sized(docs, labels):
        def run(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(batch)] * len(batch), pa.int64()), pa.array([0] * len(batch), pa.int32())], names=["doc_id", "text", "n", "predicted"])

        return docs.mapInArrow(run, "doc_id long, text string, n long, predicted int")

    monkeypatch.setattr(corpus_pipeline, "toxicity", sized)
    docs = spark.range(3000).coalesce(1).selectExpr("id AS doc_id", "'a text' AS text", "0L AS n")
    out = corpus_pipeline.drop_toxic(spark, docs, DATA)
    assert out.count() == 3000 and out.agg({"n": "max"}).first()[0] <= 1000
