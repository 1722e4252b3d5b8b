import hashlib
import html
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from antecede.llm import audio_fingerprint, components, embedding_dedup, html_wrappers, jaccard_join, language_id, line_dedup, mixing, pii, sentencepiece_codec, token_store
from antecede.llm.common import scratch, tokenizer_path

ODD = [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "Zwei  wörter\n"), (5, "x " * 30000), (6, "漢字 \U0001f600 ▁ \x00 é"), (7, "same text here again and again"), (8, "same text here again and again"), (8, "same text here again and again"), (None, "no id")]
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and extra columns with names that operators use."""
    return spark.createDataFrame(ODD, SCHEMA).withColumns({"n_tokens": F.lit(1), "copies": F.lit("x"), "n_lines": F.lit(2), "region": F.lit(3), "lang": F.lit("en"), "source": F.lit(None).cast("string")})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA).withColumns({"lang": F.lit("en"), "source": F.lit("s")})


def texts(n=240, seed=5):
    r = np.random.default_rng(seed)
    words = [f"w{k}" for k in range(400)]
    out = []
    for k in range(n):
        if k % 3 == 2:
            w = out[k - 1].split(" ")
            for _ in range(int(r.integers(0, 6))):
                w[int(r.integers(len(w)))] = str(r.choice(words))
            out.append(" ".join(w))
        else:
            out.append(" ".join(r.choice(words, int(r.integers(20, 160)))))
    return out


def brute_components(sets, percent):
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if k and 100 * k >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(sets))]


def test_sentencepiece_is_exact(spark, odd, none):
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    library, codec = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_codec.codec(path)
    r = np.random.default_rng(1)
    alphabet = list("aeht nsoi  ▁\n\t.,é漢😀\x00<>0x1A/s")
    for t in [t or "" for _, t in ODD] + ["".join(r.choice(alphabet, int(r.integers(0, 50)))) for _ in range(500)]:
        assert codec.encode(t) == library.encode(t) and codec.decode(codec.encode(t)) == library.decode(library.encode(t))
    got = sentencepiece_codec.digests(odd, path).collect()
    assert len(got) == len(ODD) and sentencepiece_codec.digests(none, path).count() == 0
    want = {i: (len(e), hashlib.sha256(",".join(map(str, e)).encode()).hexdigest()) for i, t in ODD for e in [library.encode(t or "")]}
    assert all(want[g.doc_id] == (g.n_tokens, g.ids_sha256) for g in got)
    assert all(library.decode(g.ids) == g.decoded for g in sentencepiece_codec.encode_decode(odd, path).collect())


@pytest.mark.parametrize("few", [500_000, 0])
def test_lines(spark, odd, none, few):
    rows = [(k, f"common line\nown {k}\n COMMON line \n{'twice' if k < 2 else k}") for k in range(12)]
    out = {r.doc_id: r for r in line_dedup.drop_repeated_lines(spark.createDataFrame(rows, SCHEMA), broadcast_keys=few, bits=1 << 16).collect()}
    assert out[0].text == "own 0\ntwice" and (out[0].n_lines, out[0].n_dropped) == (4, 2)
    kept = line_dedup.drop_repeated_lines(odd, min_docs=2, broadcast_keys=few).collect()
    assert len(kept) == len(ODD) and {r.doc_id: r.text for r in kept}[7] == "" and {r.doc_id: r.n_lines for r in kept}[0] == 1
    assert line_dedup.drop_repeated_lines(none, broadcast_keys=few).count() == 0


def test_token_store(spark, odd, none):
    from tokenizers import Tokenizer

    path, library = scratch(spark, "store"), Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts(60))] + [(100, None), (101, "ΣΑΣ it's <|endoftext|> 12\x1c3 a ★ a★b")], SCHEMA)
    token_store.write_store(docs, path, tokenizer_path("word_bpe_49k.json"), segment=500)
    at = 0
    for r, (i, t) in zip(token_store.document_digests(spark, path).orderBy("doc_id").collect(), docs.orderBy("doc_id").collect(), strict=True):
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    for d in (odd, none):
        p = scratch(spark, "store")
        token_store.write_store(d, p, tokenizer_path("word_bpe_49k.json"))
        assert token_store.document_ids(spark, p).count() == d.count()
    ids = np.random.default_rng(0).integers(0, 1 << 32, 3000, dtype=np.uint32) >> np.random.default_rng(1).integers(0, 32, 3000, dtype=np.uint32)
    codes = token_store.Codes(token_store.encode_codes(ids))
    assert (codes.all() == ids).all() and all(codes[i] == ids[i] for i in range(0, 3000, 7)) and len(token_store.Codes(token_store.encode_codes(ids[:0])).all()) == 0


def test_embeddings(spark):
    r = np.random.default_rng(2)
    base = r.normal(size=(60, 16))
    rows = [(int(i), [float(x) for x in base[i % 60] + (r.normal(size=16) * 0.08 if i >= 60 else 0)]) for i in range(400)]
    rows += [(500, None), (501, []), (502, [0.0] * 16), (503, [float("nan")] * 16), (504, [1.0, None]), (505, rows[0][1]), (506, [1.0, 2.0]), (507, [2.0, 4.0]), (507, [5.0, -4.0])]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    ok = [k for k, (_, v) in enumerate(rows) if v and None not in v and np.isfinite(v).all() and any(v)]
    links = defaultdict(set)
    for a in ok:
        for b in ok:
            x, y = np.array(rows[a][1]), np.array(rows[b][1])
            if a != b and len(x) == len(y) and x @ y >= 0.95 * np.linalg.norm(x) * np.linalg.norm(y):
                links[a].add(b)
    labels = components.least_labels(len(rows), *(np.array(e, int) for e in zip(*[(a, b) for a in links for b in links[a]], strict=True)))
    assert got == sorted((i, len(links[k]), min(rows[j][0] for j in np.flatnonzero(labels == labels[k]))) for k, (i, _) in enumerate(rows))
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize("few", [300_000, 0])
def test_components(spark, few):
    rows = [(k, k + 1) for k in range(20)] + [(50, 40), (40, 60), (7, 7)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(rows, "a long, b long"), few).collect()}
    assert got == {k: 0 for k in range(21)} | {40: 40, 50: 40, 60: 40}


@pytest.mark.parametrize(("direct", "percent"), [(12, 90), (2, 80)])
def test_jaccard(spark, odd, none, direct, percent):
    rows = texts()
    sets = [frozenset(zip(w, w[1:], w[2:], strict=False)) for w in (t.split(" ") for t in rows)]
    got = {r.doc_id: r for r in jaccard_join.join(spark.createDataFrame(list(enumerate(rows)), SCHEMA), percent=percent, direct=direct, pivots=1).collect()}
    want = brute_components(sets, percent)
    assert [got[k].component_id for k in range(len(rows))] == want and [got[k].n_shingles for k in range(len(rows))] == [len(s) for s in sets]
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(odd).collect()}
    assert out[0] == (0, 0) and out[2] == (0, 2) and out[3] == (1, 3) and out[8] == (4, 7) and out[5] == (1, 5)
    assert jaccard_join.join(none).count() == 0


def test_pii(spark, odd, none):
    rows = [(k, f"my secret contact nr {'+1 (555) 555-12%02d' % k if k < 12 else 'AB-%d99' % k} thanks") for k in range(14)]
    rows += [(50, "a@b.c_d@e.f 1.2.3.4.5 300.1.1.1 x 4111 1111 1111 1111- " + "9" * 30000 + " " + "a" * 30000), (51, None)]
    got = {r.doc_id: r for r in pii.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[0].spans == "phone:21:38" and got[12].spans == "phone:21:28" and got[12].n_phone == 0 and got[12].n_discovered == 1
    assert got[50].spans == "email:0:5,email:5:11,ip:12:19,card:34:53" and got[51].spans == "" and got[51].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert pii.extract(odd).count() == len(ODD) and pii.extract(none).count() == 0


def test_language(spark, odd, none):
    r = np.random.default_rng(0)
    of = {"en": "the and ing th tion er".split(), "de": "sch ung keit ein und ver".split()}
    rows = [(k, " ".join("".join(r.choice(of[lang], 3)) for _ in range(40)), lang, f"h{k % 3}") for k in range(200) for lang in [("en", "de")[k % 2]]]
    rows += [(900, rows[0][1], "de", "h1"), (901, "", "en", "h0"), (902, "12 34 !!", "en", "h0"), (903, None, None, None)]
    got = {x.doc_id: x for x in language_id.identify(spark.createDataFrame(rows, SCHEMA + ", lang string, source string"), F.col("lang"), F.col("source")).collect()}
    assert all(got[k].predicted == ("en", "de")[k % 2] and got[k].accepted for k in range(200)) and got[900].predicted == "en"
    assert not any(got[k].accepted or got[k].predicted for k in (901, 902, 903))
    assert language_id.identify(odd, F.col("lang"), F.col("source"), keep_text=True).count() == len(ODD) and language_id.identify(none, F.col("lang"), F.col("source")).count() == 0
    pages = spark.createDataFrame([(k, f"http://h{k % 2}.example.com/x", f"<html lang={lang}><p>{t}") for k, t, lang, _ in rows[:60]] + [(99, None, None)], "page_id long, url string, html string")
    assert sum(p.declared == p.predicted for p in language_id.identify_pages(pages).collect()) == 60


@pytest.mark.parametrize("few", [16_000_000, 0])
def test_html(spark, few):
    page = lambda k: f"<html><body><nav><ul><li>menu</ul></nav><div class='ad'>buy</div><article><h1>T{k} &amp; x</h1>{''.join(f'<p>para {j} <b>bold' for j in range(k))}<div class=comments>c</div></article><footer>f</footer>"
    rows = [(k, f"http://a.example/{k}", page(k)) for k in range(6)] + [(10, None, None), (11, "", ""), (12, "x", "<div>plain <script>if (a<b) {}"), (13, "http://b.example", "<main>x<p>a&nbsp;b<aside>no</aside></main>y"), (14, "u", "<div>" * 2000 + "deep")]
    got = {r.page_id: r for r in html_wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), broadcast_chars=few).collect()}
    for k in range(6):
        assert got[k].text == "\n\n".join([html.unescape(f"T{k} &amp; x"), *(f"para {j} bold" for j in range(k))]) and got[k].n_chars == len(got[k].text)
    assert (got[10].text, got[11].text, got[12].text, got[13].text, got[14].text) == ("", "", "plain", "x\n\na b", "deep")
    p, q = ["e", "p", []], ["e", "q", []]
    assert html_wrappers.fold([p, p, p]) == [["+", [p]]] and html_wrappers.align([p], [p, q]) == [p, ["?", [q]]]
    assert html_wrappers.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_audio(spark):
    r = np.random.default_rng(4)
    base = r.normal(size=(300, 64))
    rows = [(k, [float(x) for x in base[k] if True]) for k in range(300)] + [(300 + k, [float(x) for x in base[k] + r.normal(size=64) * 0.08]) for k in range(0, 200, 2)] + [(1000, None), (1001, []), (1002, [float("nan")] * 64), (1003, [float(x) for x in base[100]])]
    got = {(x.query_id, x.match_id) for x in audio_fingerprint.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 20 == 0, "vec_id", "embedding", audio_fingerprint.melody).collect()}
    prints = {k: audio_fingerprint.fingerprint(audio_fingerprint.melody(v)) for k, v in rows}
    want = set()
    for q in [k for k in prints if k % 20 == 0 and len(prints[k])]:
        for m, y in prints.items():
            x = prints[q]
            if m != 1003 and len(y) == len(x):
                for o in range(56 - 112, 113 - 56):
                    a, b = x[max(o, 0) : len(x) + min(o, 0)], y[max(-o, 0) : len(y) - max(o, 0)]
                    if np.bitwise_count(a ^ b).sum() <= audio_fingerprint.MOST_ERRORS * 32 * len(a):
                        want.add((q, m))
                        break
    assert len(want) > 20 and len(got & want) >= 0.9 * len(want)
    wave = audio_fingerprint.melody(rows[0][1])
    assert (np.bitwise_count(audio_fingerprint.fingerprint(audio_fingerprint.decode_wav(audio_fingerprint.encode_wav(wave))) ^ prints[0]).mean() < 1) and len(audio_fingerprint.decode_wav(b"RIFFxxxxWAVE")) == 0


def test_mixing(spark, odd, none):
    rows = [(k, "w " * (1 + k % 7), "en" if k % 3 else "de", f"s{k % 4}") for k in range(400)]
    docs = spark.createDataFrame(rows, SCHEMA + ", lang string, source string")
    levels = {"lang": F.col("lang"), "source": F.col("source")}
    out = mixing.mix(docs, levels, {"lang": {"en": 1.0, "de": 3.0}}, F.col("_all") * 0.6, 1, 3).collect()
    total = sum(1 + k % 7 for k in range(400))
    taken = {lang: sum(r.n_tokens * r.copies for r in out if r.lang == lang) for lang in ("en", "de")}
    held = sum(r.n_tokens for r in out if r.lang == "de")
    assert taken["de"] == held and 0.6 * total - held - 30 <= taken["en"] <= 0.6 * total - held  # German's shortage goes to English
    both = sum(r.n_tokens * r.copies for r in mixing.mix_slim(docs, levels, {}, F.col("_all") * 2.5, 3, 3).collect())
    assert 2.5 * total - 60 <= both <= 2.5 * total
    assert len(mixing.mix(odd, levels, {}, F.col("_all") * 0.5).collect()) == len(ODD) and mixing.mix(none, levels, {}, F.col("_all")).count() == 0


def test_pipeline(spark, odd, tmp_path):
    import corpus_pipeline

    odd.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars")).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "jaccard_join", "mixing", "sentencepiece"]


def test_words():
    from antecede.llm.shingles import shingle_sets

    a, b, c = shingle_sets(["A b\tC d", "a B c  D", "a b d c"], 3)
    assert (a == b).all() and len(a) == 2 and not set(a) & set(c) and re.fullmatch("x", "x")
