import random

from antecede.llm import token_store as ts
from antecede.llm.common import scratch, tokenizer_path


def test_encoder_equals_library_on_any_characters():
    encoder = ts.ChunkEncoder(tokenizer_path("word_bpe_49k.json"))
    assert encoder.cut is not None
    r = random.Random(1)
    letters = "abcXYZÀéñçØßþÿĀŁŒžǅɏʰ's'td're'LL m.,-_²½0129٣ \n\t\u0085\u00a0\x1c\x00\u0301Σςσİı\u212aÅ漢😀<|"
    for _ in range(4000):
        text = "".join(r.choice(letters) for _ in range(r.randint(0, 30))) + r.choice(["", "<|endoftext|>", "<|startoftext|>x", "'re", "'LL x"])
        assert encoder.ids(text) == encoder.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_encoder_of_a_file_with_other_rules(monkeypatch):
    encoder = ts.ChunkEncoder(tokenizer_path("word_bpe_49k.json"))
    encoder.cut = None
    encoder.clear()
    assert encoder.ids("It's  Été\n12") == encoder.tokenizer.encode("It's  Été\n12", add_special_tokens=False).ids


def test_full_tables_start_anew(monkeypatch):
    monkeypatch.setattr(ts, "CHUNKS", 5)
    monkeypatch.setattr(ts, "PIECES", 4)
    encoder = ts.ChunkEncoder(tokenizer_path("word_bpe_49k.json"))
    text = "many more words than the tables hold, and they come again: many more words than these"
    assert encoder.ids(text) == encoder.tokenizer.encode(text, add_special_tokens=False).ids and len(encoder) <= 5


def test_any_position_of_a_store_is_read_alone(spark):
    r = random.Random(2)
    docs = spark.createDataFrame([(k, " ".join(r.choice(["one", "two", "Zwölf", "12", "seldomseenword"]) for _ in range(r.randint(0, 60)))) for k in range(80)], "doc_id long, text string")
    path = scratch(spark, "test-positions")
    ts.write_store(docs, path, tokenizer_path("word_bpe_49k.json"), segment=200)
    ids = [t for d in ts.document_ids(spark, path).orderBy("doc_id").collect() for t in d.ids]
    asked = spark.createDataFrame([(p,) for p in [*range(0, len(ids), 7), len(ids) - 1, len(ids) - 1, len(ids), -1]], "position long")
    got = {x.position: x.token for x in ts.tokens_at(spark, path, asked).collect()}
    assert got == {p: ids[p] for p in {*range(0, len(ids), 7), len(ids) - 1}}
    few, joined = (sorted((x.part, x.seq, x.start) for x in ts.read_store(spark, path, n).collect()) for n in (100, 0))
    assert few == joined
