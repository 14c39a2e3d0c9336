import numpy as np
import tiktoken

import corpus_pipeline
from tests.llm.cases import normalised, nothing, table, tricky
from tests.llm.test_dedup import brute_components, brute_print
from titletags.llm import bpe, mixing
from titletags.llm.settings import PATTERN, VOCABULARY, domain


def test_every_stage_does_what_it_says(spark, sf_dir):
    docs = table(spark, sf_dir)
    steps = [docs]
    for _, stage in corpus_pipeline.STAGES:
        steps.append(corpus_pipeline.written(stage(spark, steps[-1], sf_dir)))
    for step in steps[1:-1]:
        assert step.columns == docs.columns
    raw, spoken, unique, apart, mixed, encoded = (step.collect() for step in steps)
    # all given documents have a language, and keep it
    assert {r["doc_id"] for r in spoken} == {r["doc_id"] for r in raw}
    least = {}
    for r in spoken:
        key = normalised(r["text"])
        least[key] = min(least.get(key, r["doc_id"]), r["doc_id"])
    assert sorted(r["doc_id"] for r in unique) == sorted(least.values())
    prints = [(r["doc_id"], brute_print(r["text"])) for r in unique]
    assert sorted(r["doc_id"] for r in apart) == sorted(set(brute_components(prints)))
    plan = mixing.mix(steps[3], domain(), corpus_pipeline.ONE_EPOCH).collect()
    wanted = [r["doc_id"] for r in plan if r["tokens_taken"] > 0]
    assert sorted(r["doc_id"] for r in mixed) == sorted(wanted)
    with open(VOCABULARY, "rb") as f:
        ranks = bpe.Tokenizer(f.read(), PATTERN).ranks
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r["doc_id"]: r["text"] for r in mixed}
    assert len(encoded) == len(mixed)
    for r in encoded:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert ids == library.encode_ordinary(texts[r["doc_id"]]) and r["n_tokens"] == len(ids)


def test_stages_take_tricky_and_no_documents(spark, sf_dir):
    for start in (tricky(spark), nothing(spark)):
        docs = start
        for _, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.written(stage(spark, docs, sf_dir))
        assert docs.columns[0] == "doc_id"


def test_language_stage_keeps_documents_of_close_languages(spark, sf_dir):
    texts = [(i, "the same few words", lang, "src0") for i, lang in enumerate(["en", "de", "fr"] * 4)]
    docs = spark.createDataFrame([*texts, (99, "123", "en", "src0")],
                                 "doc_id long, text string, lang string, source string")
    kept = corpus_pipeline.identify_language(spark, docs, sf_dir).collect()
    assert sorted(r["doc_id"] for r in kept) == list(range(12))
