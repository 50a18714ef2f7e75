"""Later findings of round 3 about the training-data operators."""

import numpy as np

from tarn.llm import simhash, tokenfiles
from tarn.llm.bpe import default_path


def test_a_word_is_encoded_once_in_any_case_and_before_any_punctuation():
    """op13: the library was asked anew for every spelling of a word and every mark behind it."""
    from tokenizers import Tokenizer

    own, asked = tokenfiles.PieceEncoder(default_path()), []
    words, others = own.ids_of_words, own.ids_of
    own.ids_of_words = lambda w: asked.extend(w) or words(w)
    own.ids_of = lambda p: asked.extend(p) or others(p)
    texts = ["Thorough thorough, THOROUGH$$$ thorough.thorough", "THOROUGH\nÉté thorough) Été's", "H̱ <|endoftext|> ẖ <|ENDOFTEXT|>", ""]
    got = own.encode(texts)
    assert [p for p in asked if p.lower() == "thorough"] == ["thorough"] and len(asked) == len(set(asked))
    known = Tokenizer.from_file(default_path())
    assert got == [np.array(known.encode(t, add_special_tokens=False).ids, "<i4").tobytes() for t in texts]


def test_few_links_are_few_tasks(spark, monkeypatch):
    """pipeline: each of some 200 shuffles left the files of as many tasks as there are shuffle partitions, however few its rows."""
    tasks, own = [], simhash.connected_components
    monkeypatch.setattr(simhash, "connected_components", lambda edges: tasks.append(edges.rdd.getNumPartitions()) or own(edges))
    settings = {"spark.sql.shuffle.partitions": "7", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        docs = spark.createDataFrame([(i, " ".join(f"w{i // 4}x{k}" for k in range(60 + i % 4))) for i in range(40)], "doc_id long, text string")
        for distance in (0.2, simhash.DISTANCE):
            got = {r.doc_id: r.component_id for r in simhash.components(docs, 5, distance).collect()}
            assert isinstance(distance, int) or got == {i: i // 4 * 4 for i in range(40)}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert tasks and max(tasks) == 1
