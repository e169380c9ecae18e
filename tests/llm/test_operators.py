"""The training-data operators against brute force, with nulls, ties, repeats, empty tables and clashing names."""

import json
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from keyloom.llm import chat, decontam, embed_dedup, html_extract, langid, queries, repeats, simhash, spm, substring_dedup, suffix_dedup, toxicity
from keyloom.llm.components import components

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, None, None, None) for i, t in zip(ids, texts, strict=True)], DOCS)


def made_texts(seed=1, n=60):
    """Texts of few words with shared passages, copies, odd white space, and long runs of one word."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["é", "Straße,", "x"]
    passages = [" ".join(rng.choices(words, k=rng.randint(5, 40))) for _ in range(6)]
    out = [None, "", " \t\n", "a " * 300, "one"]
    while len(out) < n:
        parts = [rng.choice(passages) if rng.random() < 0.4 else " ".join(rng.choices(words, k=rng.randint(0, 30))) for _ in range(rng.randint(1, 4))]
        out.append(rng.choice([" ", "\n", "  \t"]).join(parts))
        if rng.random() < 0.2:
            out.append(out[-1])
    return out


def gone(docs, size):
    """Units covered by windows that also start in a smaller document."""
    first, out = {}, {}
    for i, units in sorted(docs):
        mask = [False] * len(units)
        for k in range(len(units) - size + 1):
            if first.setdefault(units[k : k + size], i) < i:
                mask[k : k + size] = [True] * size
        out[i] = mask
    return out


@pytest.mark.parametrize(("group", "block"), [(4096, 1 << 20), (2, 1 << 20), (4096, 300)])
def test_substring_and_suffix_dedup(spark, monkeypatch, group, block):
    monkeypatch.setattr(repeats, "GROUP", group)  # 2: nearly all buckets take the way for many stretches
    texts = made_texts()
    df = documents(spark, texts).withColumn("kept", F.lit("clash")).withColumn("h1", F.lit(1))
    words = [(i, tuple(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t in enumerate(texts)]
    masks = gone(words, 13)
    got = {r.doc_id: (r.kept, r.n_words, r.n_removed, r.h1) for r in substring_dedup.substring_dedup(df, block=block).collect()}  # 300: long texts are cut in pieces
    assert got == {i: (" ".join(w for w, m in zip(u, masks[i], strict=True) if not m), len(u), sum(masks[i]), 1) for i, u in words}
    data = [(i, (t or "").encode()) for i, t in enumerate(texts)]
    masks = gone(data, 50)
    got = {r.doc_id: (bytes(r.kept), r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.suffix_dedup(df, block=block).collect()}
    for i, u in data:
        m = masks[i]
        assert got[i] == (bytes(b for b, x in zip(u, m, strict=True) if not x), len(u), sum(m), sum(x and not (k and m[k - 1]) for k, x in enumerate(m)))


def test_repeats_odd_ids(spark):
    long = " ".join(f"w{i}" for i in range(30))
    df = documents(spark, [long, long, long, long], [None, 7, 7, 9])  # 7 is repeated
    assert sorted((r.doc_id or 0, r.n_removed) for r in substring_dedup.substring_dedup(df).collect()) == [(0, 0), (7, 0), (7, 0), (9, 30)]
    empty = documents(spark, [])
    assert substring_dedup.substring_dedup(empty).count() == suffix_dedup.suffix_dedup(empty).count() == 0


def thue_morse(n):
    return [bin(i).count("1") % 2 for i in range(n)]


def test_no_names_decide(spark):
    """Texts that differ by a Thue-Morse pattern, whose polynomial hashes modulo 2^64 are equal in any odd base, aren't taken for equal."""
    bits = thue_morse(1024)
    one, two = "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)
    one, two = ("".join(t[k : k + 1] + "xyz" for k in range(1024)) for t in (one, two))
    data = [(i, t.encode()) for i, t in enumerate([one, two, one + "end"])]
    masks = gone(data, 50)
    got = {r.doc_id: r.n_removed for r in suffix_dedup.suffix_dedup(documents(spark, [one, two, one + "end"])).collect()}
    assert got == {i: sum(m) for i, m in masks.items()}


def test_refinement_rounds():
    """Buckets of 8 bytes are refined to 16, 32 and 50; what one document alone has leaves on the way."""
    rng = random.Random(7)
    letters = lambda n: "".join(rng.choices("abcdefgh", k=n))
    eight, thirty, fifty = letters(8), letters(30), letters(60)
    texts = [letters(60) + x + letters(60) + y for x, y in ((eight, fifty), (eight, thirty), (thirty, fifty), (letters(9), letters(9)))]
    units = suffix_dedup.Bytes(50, 20)
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    s = units.stream(raw, np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
    places, rounds = np.flatnonzero(repeats._valid(s, 50)), []
    docs = np.repeat(np.arange(4), np.diff(s.first))
    live, lowest = repeats.refine(units.symbols(s), repeats.doubled(8, 50), places, docs, docs, rounds)
    first, expected = {}, []
    for p in places:
        first.setdefault(raw[p : p + 50].tobytes(), set()).add(int(docs[p]))
    for p in places:
        if len(first[raw[p : p + 50].tobytes()]) > 1:
            expected.append((p, min(first[raw[p : p + 50].tobytes()])))
    assert list(zip(places[live], lowest, strict=True)) == expected and len(expected) == 22
    assert [n for n, _ in rounds] == [8, 16, 32, 50] and rounds[-1][1] == 22 and len(places) > rounds[0][1] >= rounds[1][1]
    none = []
    assert not len(repeats.refine(units.symbols(s), repeats.doubled(8, 50), places, 0 * docs, 0 * docs, none)[0])
    assert none == [(8, 0)]  # no candidates survive, so no further round


def test_long_text(spark):
    """A text over a block, with a passage that lies on the border of its pieces."""
    rng = random.Random(9)
    words = [f"{rng.randrange(10**9)}" for _ in range(130_000)]
    cut = next(k for k in range(len(words)) if len(" ".join(words[:k])) > (1 << 20))
    passage = words[cut - 20 : cut + 20]
    df = documents(spark, [" ".join(words), " ".join(["own", *passage, "end"]), " ".join(["first", *passage])], [5, 7, 3])
    assert {r.doc_id: r.n_removed for r in substring_dedup.substring_dedup(df).collect()} == {3: 0, 5: 40, 7: 40}
    size = len(" ".join(passage))
    assert {r.doc_id: (r.n_removed, r.n_spans) for r in suffix_dedup.suffix_dedup(df).collect()} == {3: (0, 0), 5: (size + 1, 1), 7: (size + 2, 1)}


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 200), (200, 100), (300, 300), (None, 5)] + [(400, 401 + i) for i in range(200)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(51)} | {100: 100, 200: 100} | {i: 400 for i in range(400, 601)}


def simple_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 4)
    rng, texts = random.Random(3), made_texts(5, 80)
    base = [f"v{i}" for i in range(400)]
    for _ in range(40):  # near copies
        some = list(base)
        for _ in range(rng.randint(0, 6)):
            some[rng.randrange(400)] = rng.choice("ABC")
        texts.append(" ".join(some))
    prints = [simple_fingerprint(t) for t in texts]
    comp = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(prints):
            comp[i] = min(comp[j] for j, b in enumerate(prints) if (a ^ b).bit_count() <= 4)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_dedup(documents(spark, texts)).collect()}
    assert got == {i: (f"{p:016x}", comp[i]) for i, p in enumerate(prints)}
    odd = simhash.simhash_dedup(documents(spark, ["a b c d", "e f g h", "e f g h", None], [None, 1, 2, 3])).collect()
    assert {(r.doc_id, r.component_id) for r in odd} == {(None, None), (1, 1), (2, 1), (3, 3)}
    assert simhash.simhash_dedup(documents(spark, [])).count() == 0
    text = "v w x y z " * 150_000  # over a block
    long = documents(spark, [text, text, "v"]).withColumn("fp", F.lit("clash")).withColumn("component_id", F.lit(1))
    prints = [f"{simple_fingerprint(t):016x}" for t in (text, "v")]
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_dedup(long).collect()} == {0: (prints[0], 0), 1: (prints[0], 0), 2: (prints[1], 2)}


def test_masks_cover():
    masks = [m & (2**64 - 1) for m in simhash.covering_masks(4)]
    rng = random.Random(1)
    for _ in range(3000):
        bits = sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4)))
        assert any(m & bits == 0 for m in masks)


def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "CELL", 20)
    monkeypatch.setattr(embed_dedup, "BLOCK", 16)
    rng = np.random.default_rng(2)
    rows = [(0, None, 1), (1, [0.0] * 8, 1), (2, [float("nan")] + [1.0] * 7, 1), (3, [None] + [1.0] * 7, 1), (4, [], 1), (5, [1.0] * 8, None), (6, [1.0] * 7, 1), (7, [1.0] * 8, 1), (8, [2.0] * 8, 1)]
    for c in range(25):
        centre = rng.normal(size=8)
        rows += [(10 + 8 * c + k, [float(x) for x in centre + rng.normal(scale=0.25, size=8)], c % 2) for k in range(8)]
    rows += [(300 + k, rows[-1][1], rows[-1][2]) for k in range(3)]  # copies
    links = defaultdict(set)
    for i, a, x in rows:
        for j, b, y in rows:
            if i != j and x == y is not None and a and b and len(a) == len(b) and None not in a and None not in b:
                u, v = np.array(a), np.array(b)
                if np.linalg.norm(u) * np.linalg.norm(v) > 0 and u @ v / (np.linalg.norm(u) * np.linalg.norm(v)) >= 0.93:
                    links[i].add(j)
    comp = {r[0]: r[0] for r in rows}
    for _ in rows:
        comp = {i: min([comp[i], *(comp[j] for j in links[i])]) for i in comp}
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embed_dedup.embedding_dedup(df).collect()}
    assert got == {i: (len(links[i]), comp[i], comp[i] == i) for i in comp}
    assert sum(map(len, links.values())) > 200
    assert embed_dedup.embedding_dedup(df.where("false")).count() == 0


@pytest.mark.parametrize(("bound", "block"), [(1 << 22, 1 << 20), (0, 1 << 20), (1 << 22, 40), (0, 40)])
def test_decontamination(spark, bound, block):
    rng = random.Random(4)
    words = [f"W{i}" for i in range(30)]
    items = [(i, " ".join(rng.choices(words, k=n))) for i, n in enumerate([20, 13, 3, 1, 0, 14])] + [(9, None), (None, "W1 W2"), (1, "W5, w6")]
    texts = [None, "", "..!"] + [" ".join(rng.choices(words, k=rng.randint(0, 20)) + (items[rng.randrange(3)][1].split() if rng.random() < 0.5 else [])) + " é!" for _ in range(40)]
    low = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = defaultdict(set)
    for i, t in items:
        w = tuple(low(t)) if i is not None else ()
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[w[k : k + n]].add(i)
    expected = {}
    for d, t in enumerate(texts):
        w, hit, found = tuple(low(t)), set(), set()
        for window, ids in windows.items():
            for k in range(len(w) - len(window) + 1):
                if w[k : k + len(window)] == window:
                    hit |= set(range(k, k + len(window)))
                    found |= ids
        expected[d] = (len(w), len(hit), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(w))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    df = documents(spark, texts).withColumn("items", F.lit("clash"))
    out = decontam.decontaminate(df, benchmark, action="spans", broadcast_bytes=bound, block=block).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in out} == expected
    for r in out:
        assert len(low(r.cleaned)) == r.n_words - r.n_hit and (r.n_hit or r.cleaned == texts[r.doc_id])
    kept = decontam.decontaminate(df, benchmark, action="documents", broadcast_bytes=bound, block=block)
    assert {r.doc_id for r in kept.collect()} == {d for d, x in expected.items() if not x[3]}
    assert decontam.decontaminate(df, benchmark.where("false"), broadcast_bytes=bound, block=block).where("n_hit > 0").count() == 0
    assert decontam.decontaminate(df.where("false"), benchmark, broadcast_bytes=bound, block=block).count() == 0
    short = benchmark.select(F.col("item_id").cast("smallint").alias("item_id"), "text")
    out = decontam.decontaminate(df.withColumn("doc_id", F.lit(None).cast("long")), short, broadcast_bytes=bound, block=block)
    assert sorted((r.n_words, r.n_hit, list(r["items"])) for r in out.collect()) == sorted(x[:3] for x in expected.values())


def test_sentencepiece(spark):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as model

    texts = [None, "", " ", "  a  b\n\tçé ", "▁x▁", "日本語 😀", "the " * 500, "q" * 5000, "naïve\r\n", "\x00\x7f"] + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(40).collect()]
    df = documents(spark, texts)
    out = spm.encode(df)
    back = {r.doc_id: (r.decoded, r.round_trip) for r in spm.decode(out).collect()}
    assert back == {i: (t, None if t is None else True) for i, t in enumerate(texts)}
    # the library's lattice over the same pieces and scores
    m = model.ModelProto()
    with open(spm.DEFAULT_MODEL, "rb") as f:
        m.ParseFromString(f.read())
    m.trainer_spec.model_type = model.TrainerSpec.UNIGRAM
    library = sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString())
    encoder, score, n = spm.Encoder(spm.Vocabulary.load(spm.DEFAULT_MODEL)), library.get_score, 0
    for line in "\n".join(t for t in texts[10:]).split("\n")[:150]:
        if line and "  " not in line:
            best, own = library.nbest_encode_as_ids(line, 2)[0], encoder.encode(line).tolist()
            # the library adds in 32 bits, which lose the small scores beside pieces of -1e9
            assert own == best or sum(map(score, own)) >= sum(map(score, best))
            n += 1
    assert n > 50
    whole = spm.StreamingViterbi(encoder.v)
    text = "▁" + texts[12].replace(" ", "▁")
    ids = [i for k in range(0, len(text), 5) for i in whole.feed(text[k : k + 5])]
    assert len(whole.back) < 20 * whole.longest  # what is settled isn't held
    other = spm.StreamingViterbi(encoder.v)
    assert ids + whole.finish() == other.feed(text) + other.finish()


def test_language_id(spark):
    out = queries.op2_language_id(spark, "/root/testdata/sf0.01")
    rows = out.join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.97
    odd = documents(spark, [None, "", "12 !?", "hello"]).withColumn("lang_pred", F.lit(1))
    assert {(r.lang_pred, r.score) for r in langid.predict(odd, None, ["doc_id"]).collect()} == {("und", 0.0)}
    assert langid.train(odd.select(F.col("doc_id").alias("key"), "text", "lang")) is None


def test_language_id_rare(spark, monkeypatch):
    """A large language leaves a rare one its share of the rows that are learnt from."""
    learnt, ftrl = [], langid.ftrl
    monkeypatch.setattr(langid, "ftrl", lambda xs, ys, *a: learnt.extend(ys) or ftrl(xs, ys, *a))
    rows = spark.range(30_010).select(F.col("id").alias("key"), F.when(F.col("id") < 10, "xyz zyx").otherwise("abc cba").alias("text"), F.when(F.col("id") < 10, "rare").otherwise("big").alias("lang"))
    rows = rows.unionByName(spark.createDataFrame([(i, "12 !", "rare") for i in range(40_000, 40_020)], rows.schema))  # nothing to learn from
    model = langid.train(rows, sample=10)
    assert [learnt.count(y) for y in range(2)] == [4, 4]  # of 5 each; the fifth fits the temperature
    assert [r.lang_pred for r in langid.predict(documents(spark, ["xyz"]), model, ["doc_id"]).collect()] == ["rare"]


def test_language_id_counts():
    """n-grams of a text against plain counting, and slots for many languages."""
    text = "  Ärger, 12 ÄB\n\U0001d400x "
    points, is_letter = langid.folded(text)
    plain = " " + " ".join("".join(c.lower() if c.isalpha() else " " for c in text).split()) + " "
    grams = defaultdict(int)
    for n in (1, 2, 3):
        for k in range(len(plain) - n + 1):
            value = 0
            for c in plain[k : k + n]:
                value = (value * 0x200000 + ord(c)) % 2**64
            slot = int(langid.mix64(np.array([(value + (n << 60)) % 2**64], np.uint64))[0]) % langid.SLOTS
            grams[slot] += 1
    got = langid.counts(points)
    assert {i: int(got[i]) for i in np.flatnonzero(got)} == grams and is_letter.sum() == 9
    assert [langid.slots_for(n) for n in (1, 1024, 1025, 8000, 10**6)] == [1 << 14, 1 << 14, 1 << 13, 1 << 11, 64]


def test_language_id_odd_texts(spark):
    """Nulls, empty and letterless texts, and a long one, with a model; an empty table."""
    rows = spark.createDataFrame([(i, "abc cba" if i % 2 else "xyz zyx", "ab"[i % 2]) for i in range(40)] + [(90, None, "a"), (91, "12", None), (None, "abc", "b")], "key long, text string, lang string")
    model = langid.train(rows)
    texts = [None, "", "12 !?\n", "abc " * 400_000, "zyx", "zyx"]
    df = documents(spark, texts).withColumn("score", F.lit("clash"))
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(df, model, ["doc_id", "score"]).collect()}
    assert [got[i][0] for i in range(6)] == ["und", "und", "und", "b", "a", "a"] and got[0][1] == 0.0 and 0.5 < got[3][1] <= 1
    assert langid.predict(df.where("false"), model, ["doc_id"]).count() == 0


def test_sentencepiece_odd_ids(spark):
    """Ids that the vocabulary hasn't, and nulls among them, give null."""
    df = spark.createDataFrame([(0, [-1]), (1, [None, 5]), (2, None), (3, []), (4, [10**9])], "doc_id long, ids array<int>").withColumn("decoded", F.lit(1))
    assert {r.doc_id: r.decoded for r in spm.decode(df).collect()} == {0: None, 1: None, 2: None, 3: "", 4: None}
    empty = documents(spark, []).withColumn("ids", F.lit("clash"))
    assert spm.encode(empty).count() == 0 and spm.encode(empty).schema["ids"].dataType.simpleString() == "array<int>"


def test_embeddings_odd_rows(spark):
    """Null and repeated ids, extra columns, thresholds out of range."""
    rows = [(None, [1.0, 0.0], 1), (5, [1.0, 0.0], 1), (5, [0.0, 1.0], 1), (3, [0.0, 2.0], 1), (9, [1.0, 0.015625], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("kept", F.lit("clash"))
    got = sorted((r.vec_id or -1, r.component_id, r.kept) for r in embed_dedup.embedding_dedup(df).collect())
    assert got == [(-1, None, True), (3, 3, True), (5, 3, False), (5, 3, False), (9, 3, False)]
    for t in (0, -1, 1.5):
        with pytest.raises(ValueError):
            embed_dedup.embedding_dedup(df, t)


def test_toxicity(spark):
    sf = "/root/testdata/sf0.1"
    rows = queries.op10_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    y, s = np.array([r.toxic for r in rows]), np.array([r.score for r in rows])
    rank = s.argsort().argsort()
    auc = (rank[y == 1].mean() - (y.sum() - 1) / 2) / (len(y) - y.sum())
    assert auc > 0.9 and np.mean((s >= 0.5) == y) > 0.93
    assert all(r.predicted == int(r.score >= 0.5) and zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    odd = documents(spark, [None, "", "!!", "fine"]).withColumn("score", F.lit("clash"))
    assert {r.predicted for r in toxicity.score(odd, None).collect()} == {0}
    net = toxicity.fit([b"good day", b"vile scum"] * 10, [0, 1] * 10)
    assert {r.doc_id: r.predicted for r in toxicity.score(odd, net).collect()} | {3: 0} == {0: 0, 1: 0, 2: 0, 3: 0}
    long = documents(spark, ["good day " * 300_000 + "vile scum", "vile scum", "good day"])
    assert [r.predicted for r in toxicity.score(long, net).orderBy("doc_id").collect()][1:] == [1, 0] and toxicity.score(long.where("false"), net).count() == 0
    assert toxicity.train(odd.where("false"), spark.createDataFrame([], "doc_id long, toxic int")) is None


def simple_logits(net, x, words, window=32, segment=192, context=16):
    """The windows' logits of one text, by single steps of the network in double precision."""
    p, h = {k: v.astype(np.float64) for k, v in net.p.items()}, np.zeros((len(words), 16))
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    for a in range(0, len(words), segment):
        b = min(len(words), a + segment)
        for d, order, part in (("f", range(max(0, a - context), b), slice(0, 8)), ("b", range(min(len(words), b + context) - 1, a - 1, -1), slice(8, 16))):
            s = np.zeros(8)
            for t in order:
                v, u = x[words[t]] @ p[f"w{d}"] + p[f"c{d}"], s @ p[f"u{d}"]
                z, r = sigmoid(v[:8] + u[:8]), sigmoid(v[8:16] + u[8:16])
                n = np.tanh(v[16:] + r * u[16:])
                s = (1 - z) * n + z * s
                if a <= t < b:
                    h[t, part] = s
    e = np.exp(np.tanh(h @ p["wa"] + p["ba"]) @ p["va"])
    return [float((e[k : k + window] @ h[k : k + window] / e[k : k + window].sum()) @ p["wo"] + p["bo"][0]) for k in range(max(1, len(words) - window + 1))]


def test_toxicity_windows():
    """The score of a text is that of its highest window, whichever word that starts from, against single steps."""
    rng, net = random.Random(8), toxicity.Network(2)
    net.p["ew"] *= 20
    texts = [" ".join(rng.choices([f"w{i}" for i in range(50)], k=n)).encode() for n in (0, 1, 31, 32, 33, 50, 200, 7, 600, 40, 192, 193, 384, 0, 5)]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    b = toxicity.block_of(np.frombuffer(b"".join(texts), np.uint8), offsets)
    got, x = toxicity.block_logits(net, b), net.inputs(b)
    rows, start, _ = toxicity._highest(b.first, net.windows(x, b.words, b.first))
    best = dict(zip(rows.tolist(), (start - b.first[rows]).tolist(), strict=True))
    for r, (lo, hi) in enumerate(zip(b.first, b.first[1:], strict=False)):
        every = simple_logits(net, x, b.words[lo:hi]) if hi > lo else [-np.inf]
        assert got[r] == pytest.approx(max(every), abs=1e-4)
        assert hi == lo or every[best[r]] == pytest.approx(max(every), abs=1e-4)


def test_gradients():
    """Backpropagation against differences, through a window and its context."""
    net = toxicity.Network(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    raw = " ".join(f"w{i % 23}" for i in range(70)).encode()
    b = toxicity.block_of(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    at, mask, pool = toxicity._places(b, np.array([9, 30]), np.array([0, 0]))
    assert mask.sum(axis=0).tolist() == [57, 56] and pool.sum(axis=0).tolist() == [32, 32]

    def logit():
        return float(net.forward(net.inputs(b), at, mask, pool).sum())

    x, keep = net.inputs(b), {}
    net.forward(x, at, mask, pool, keep)
    grads = net.backward(b, x, at, mask, keep, np.ones(2, np.float32))
    for name in ("wf", "wb", "uf", "ub", "cf", "wa", "va", "wo"):
        place = tuple(0 for _ in net.p[name].shape)
        before = net.p[name][place]
        net.p[name][place] = before + 1e-3
        up = logit()
        net.p[name][place] = before - 1e-3
        down = logit()
        net.p[name][place] = before
        assert abs((up - down) / 2e-3 - grads[name][place]) < 2e-3 * max(1, abs(grads[name][place]))


def test_html(spark):
    page = "<html><head><title>t</title><script>var x='</p>'</script></head><body><nav><a>menu</a></nav><div class='ad'>buy</div>{}<form>f</form><footer>foot</footer></body></html>"
    cases = {
        "<article><h1>A &amp; B</h1><p><b>x\n y<br>z<p>tail<ul><li>1<li>2</ul></article>": "A & B x y z tail 1 2",
        "<article><p>in<b>li</b>ne</p><div class='comments'><p>first!</p></div><aside>no</aside></article>": "inline",
        "<main><p>m</p></main>": "m",
        "<div><p>plain</p></div>": "plain",
        "<article>": "",
        "": "",
    }
    for inner, text in cases.items():
        assert html_extract.main_text(page.format(inner)) == text
    site = "<div><div>My Site</div><div><h2>T{0}</h2><p>body {0}</p></div><div>Contact</div></div>"
    rows = [(i, "http://u@h.example:80/x", site.format(i)) for i in range(9)] + [(9, None, None), (10, "", "")] + [(11, "http://one.example/", site.format(11))] * 2
    got = sorted((r.page_id, r.text, r.n_chars) for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    alone = "My Site T11 body 11 Contact"
    assert got == [(i, f"T{i} body {i}", 9) for i in range(9)] + [(9, "", 0), (10, "", 0)] + [(11, alone, len(alone))] * 2
    clash = spark.createDataFrame([(1, "http://h/", None, "x"), (2, "http://h/", "<p>b", "y")], "page_id long, url string, html string, text string")
    assert sorted((r.page_id, r.text) for r in html_extract.extract(clash.withColumn("host", F.lit(1))).collect()) == [(1, ""), (2, "b")]
    assert html_extract.extract(clash.where("false")).count() == 0


def test_html_odd_pages():
    """Deep, wide and broken pages take time in proportion, and lose no text."""
    assert html_extract.main_text("<div>" * 30_000 + "deep") == "deep"
    made = html_extract.induce(["<div>" * 30_000 + "deep", "<div>" * 30_000 + "sea", "<p>x" * 5000, "<div><p>x</p></div>" * 3000, "<div><p>y</p></div>" * 3000])
    assert made.template == frozenset()
    assert html_extract.main_text('<a "' * 250_001 + "end").endswith("end")
    assert html_extract.main_text("<p>a</p><a title='x>b</a><p>c</p>") == "a b c"  # an open quote hides nothing
    assert html_extract.main_text("<p>1 < 2</ p><!x" * 3).startswith("1 < 2")
    assert html_extract.main_text("<p>x</p><!-- <p>no</p> --><![CDATA[<y>]]><script>'</p>' <p>no</script><p title='a>b'>z") == "x <y> z"


def test_wrapper():
    """The slots decide where the content is, not the names of elements; what is the same on most pages isn't content."""
    path = html_extract.path_of
    page = "<body><div class=top>Site<p>All rights</p>reserved</div><div class=a1><h1>T{0}</h1>Share<p>one {0}<p>two<br>{0}</div><section><article>teaser</article></section></body>"
    made = html_extract.induce([page.format(i) for i in range(4)])
    holder = path("#root", "body", "div.a-")
    assert made.holders == (holder,) and {(holder, "Share"), (path("#root", "body", "section", "article"), "teaser")} <= made.template
    assert html_extract.main_text(page.format(9), made) == "T9 one 9 two 9"
    assert html_extract.main_text(page.format(9)) == "teaser"  # by markup alone
    assert html_extract.main_text(page.format(9), html_extract.Wrapper(), html_extract.Wrapper(made.holders)) == "T9 Share one 9 two 9"
    post = "<body><p>Home</p><article><header><h1>T{0}</h1></header><p>Same</p><p>b {0}</p></article></body>"
    made = html_extract.induce([post.format(i) for i in range(4)])
    assert made.holders == (path("#root", "body", "article"),) and html_extract.main_text(post.format(5), made) == "T5 b 5"
    assert html_extract.main_text(post.format(5)) == "T5 Same b 5"
    assert html_extract.main_text("<body><main>other</main></body>", made) == "other"  # a page of another build
    assert html_extract.induce([post.format(1)] * 3) == html_extract.Wrapper()
    # two layouts of one host: each has its holder and its template
    other = "<body><table><tr><td>Menu<td><div><b>n{0}</b><p>m {0}</div></table><div>Imprint</div></body>"
    both = html_extract.induce([x.format(i) for i in range(4) for x in (page, other)])
    assert [html_extract.main_text(x.format(7), both) for x in (page, other)] == ["T7 one 7 two 7", "n7 m 7"]


def test_html_names():
    """Names of parts count as a whole, and ids of headings not at all."""
    page = "<article><h1 id=comments>A</h1><h2 id='related-work'>Related work</h2><section id='social-history'><p class='notice-board'>x</p></section>{}</article>"
    assert html_extract.main_text(page.format("")) == "A Related work x"
    for part in ("div class='site-notice'", "div id=comments", "div class='x adSlot'", "ul class='related-posts list'", "div role=search", "p hidden", "section class='newsletter-signup'"):
        assert html_extract.main_text(page.format(f"<{part}>no</{part.split()[0]}>")) == "A Related work x", part


def plain_matching(x, y):
    """The greatest weight of pairs of two lists of nodes, cell by cell."""
    m = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i, a in enumerate(x):
        for j, b in enumerate(y):
            w = (a.tag == b.tag) * (1 + (a.text == b.text != "") + (a.whole == b.whole))
            m[i + 1][j + 1] = max(m[i][j + 1], m[i + 1][j], m[i][j] + w if w else 0)
    return m[-1][-1]


def test_alignment():
    """Pairs of greatest weight, in order, against the plain matrix."""
    rng = random.Random(6)
    for _ in range(60):
        pages = ["".join(f"<{t}>{x}{{}}</{t}>".format(f"<p>{rng.choice('uv')}</p>" * rng.randrange(2)) for t, x in ((rng.choice(["div", "section"]), rng.choice(["", "a", "b"])) for _ in range(rng.randrange(9)))) for _ in range(2)]
        a, b = (html_extract.Shape.of(html_extract.parse(p)) for p in pages)
        pairs = html_extract._pairs(a.children, b.children)
        places = [(a.children.index(x), b.children.index(y)) for x, y in pairs]
        assert all(p < q and r < s for (p, r), (q, s) in zip(sorted(places), sorted(places)[1:], strict=False))
        assert all(x.tag == y.tag for x, y in pairs)
        assert sum(1 + (x.text == y.text != "") + (x.whole == y.whole) for x, y in pairs) == plain_matching(a.children, b.children)
        assert {(x.path, y.path) for x, y in html_extract.align(a, b)} >= {(x.path, y.path) for x, y in pairs}


def test_html_keeps_all():
    """Text split over sibling articles, and blocks of links, are content; an article that is the same on all pages isn't."""
    page = "<body><article><p>one {0}</p></article><article><p>two {0} and more</p></article><article><p>Follow us, the longest of all</p></article></body>"
    made = html_extract.induce([page.format(i) for i in range(4)])
    assert html_extract.main_text(page.format(9), made) == "one 9 two 9 and more"
    assert html_extract.main_text(page.format(9)) == "one 9 two 9 and more Follow us, the longest of all"
    links = "<body><div><p>text</p><ul><li><a>a paper</a></li></ul></div></body>"
    assert html_extract.main_text(links) == "text a paper"


def test_chat(spark):
    call = '{"tool_calls": [{"id": "c1", "name": "add", "arguments": "{\\"b\\": 2.0, \\"a\\": 1}"}, {"id": "c2", "function": {"name": "add", "arguments": {"a": "x"}}}], "content": null}'
    rows = [
        (1, 0, "user", "hi \n \"you\""), (1, 3, "assistant", call), (1, 2, "tool", '{"tool_call_id": "c1", "content": 3}'), (1, 4, "tool", '{"tool_call_id": "zz", "content": "?"}'),
        (2, 0, None, None), (None, None, "tool", '{"tool_call_id": "c1"}'), (2, 1, "assistant", "{broken"), (2, 1, "assistant", "{broken"),
    ]
    schema = {"add": {"type": "object", "required": ["a", "b"], "properties": {"a": {"type": "integer"}, "b": {"type": "number"}}, "additionalProperties": False}}
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("calls", F.lit("clash"))
    out = chat.format_chats(df, schema).collect()
    assert len(out) == len(rows)
    by = {(r.conv_id, r.turn): r for r in out}
    made = by[1, 3]
    assert [(c.id, c.arguments, list(c.errors)) for c in made.calls] == [("c1", '{"a":1,"b":2}', []), ("c2", '{"a":"x"}', ["$.b: missing", "$.a: not integer"])]
    assert made.n_answered == 1 and by[1, 2].call_turn == 3 and by[1, 4].call_turn is None
    order = sorted((r.order_turn, r.order_step, r.turn) for r in out if r.conv_id == 1)
    assert [t for *_, t in order] == [0, 3, 2, 4]
    assert by[1, 0].json == '{"content":"hi \\n \\"you\\"","role":"user"}'
    assert by[2, 0].json == '{"content":null,"role":null}'
    assert chat.format_chats(df.where("false")).count() == 0


def test_chat_odd_json(spark):
    """Numbers out of range, deep values and odd identifiers crash nothing."""
    deep = "[" * 5000 + "]" * 5000
    texts = ['{"tool_calls": [{"id": 1, "name": "f", "arguments": {"x": 1e999}}]}', '{"tool_calls": [{"id": {"a": 1.0}, "name": "f", "arguments": "{\\"x\\": 1e999}"}]}', f'{{"tool_calls": [{{"id": "d", "name": "f", "arguments": {{"x": {deep}}}}}]}}', "{" * 200_000, '{"tool_calls": 3}', '{"tool_calls": [null, 4]}']
    df = spark.createDataFrame([(1, i, "assistant", t) for i, t in enumerate(texts)] + [(1, 9, "tool", '{"tool_call_id": {"a": 1}}')], "conv_id long, turn long, role string, text string")
    rows = {r.turn: r for r in chat.format_chats(df, {"f": {"type": "object"}}).collect()}
    assert [len(rows[i].calls) for i in range(6)] == [0, 1, 1, 0, 0, 2]
    assert list(rows[1].calls[0].errors) == ["$: not JSON"] and rows[1].n_answered == 1 and rows[9].call_turn == 1
    assert rows[2].calls[0].arguments == f'{{"x":{deep}}}' and not rows[2].calls[0].errors


def test_schemas():
    check = chat.violations
    assert check(True, {"enum": [1]}) and check(1, {"const": True}) and not check(1.0, {"enum": [1]})
    assert check(3, {"oneOf": [{"type": "integer"}, {"minimum": 2}]}) and not check(1, {"oneOf": [{"type": "integer"}, {"minimum": 2}]})
    assert check(2, {"exclusiveMaximum": 2}) and check([1, 1.0], {"uniqueItems": True}) and check({}, {"minProperties": 1}) and check(1, {"not": {"type": "number"}})
    assert check({"a": 1}, {"properties": {"a": False}}) and check("x", {"allOf": [{"type": "string"}, {"minLength": 2}]})
    for schema in ({"pattern": "x"}, {"properties": {"a": {"$ref": "#"}}}, {"type": "text"}, {"items": [1]}, {"anyOf": [{"format": "date"}]}):
        with pytest.raises(ValueError):
            chat.check_schema(schema)


def test_chat_links(spark):
    """Links and order of generated conversations against a plain walk through each."""
    rng, rows = random.Random(11), []
    for conv in range(30):
        for turn in range(rng.randrange(12)):
            ident = f"c{rng.randrange(5)}"
            kind = rng.randrange(3)
            text = json.dumps({"tool_calls": [{"id": i, "name": "f", "arguments": {"n": turn}} for i in {ident, f"c{rng.randrange(5)}"}]}) if kind == 0 else json.dumps({"tool_call_id": ident, "content": turn}) if kind == 1 else "hi"
            rows.append((conv, turn, ("assistant", "tool", "user")[kind], text))
    rng.shuffle(rows)
    got = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(got) == len(rows)
    for conv in range(30):
        own = sorted((t, role, text) for c, t, role, text in rows if c == conv)
        calls, results = {}, defaultdict(list)
        for turn, role, text in own:
            for c in json.loads(text)["tool_calls"] if role == "assistant" else []:
                calls.setdefault(c["id"], turn)
        for turn, role, text in own:
            if role == "tool":
                results[json.loads(text)["tool_call_id"]].append(turn)
        made = {r.turn: r for r in got if r.conv_id == conv}
        assert {t: r.call_turn for t, r in made.items()} == {t: calls.get(json.loads(x)["tool_call_id"]) if role == "tool" else None for t, role, x in own}
        assert {t: r.n_answered for t, r in made.items()} == {t: sum(bool(results[i]) for i, first in calls.items() if first == t) if role == "assistant" else 0 for t, role, _ in own}
        order = sorted(made.values(), key=lambda r: (r.order_turn, r.order_step, r.turn, r.role, r.json))
        place = {r.turn: k for k, r in enumerate(order)}
        for ident, turns in results.items():
            assert all(ident not in calls or place[calls[ident]] < place[t] for t in turns)
        still = [r.turn for r in order if r.call_turn is None or r.call_turn < r.turn]
        assert still == sorted(still)  # what needn't move keeps its place


def test_pipeline(spark):
    """Each stage against brute force on what the one before kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = documents(spark, [None, "", "short"], [90_001, 90_002, 90_003])
    docs = docs.select(*corpus_pipeline.COLUMNS).unionByName(extra)
    for name, step in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = corpus_pipeline.stage(step(spark, docs, SF), "test")
        after = {r.doc_id: r for r in docs.collect()}
        assert set(after) <= set(before) and len(after) > 0.5 * len(before)
        assert {90_001, 90_002} <= set(after)
        if name.startswith("simhash"):
            prints = {i: simple_fingerprint(r.text) for i, r in before.items() if r.text}
            comp = {i: i for i in prints}
            for _ in range(6):
                comp = {i: min(comp[j] for j in prints if (prints[i] ^ prints[j]).bit_count() <= 4) for i in prints}
            assert set(after) == {i for i in before if comp.get(i, i) == i}
        elif name.startswith("substring"):
            words = [(i, tuple(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for i, r in before.items()]
            masks = gone(words, 13)
            for i, w in words:
                left = " ".join(x for x, m in zip(w, masks[i], strict=True) if not m)
                if not any(masks[i]):
                    assert after[i] == before[i]
                elif left:
                    assert (after[i].text, after[i].n_chars) == (left, len(left))
                else:
                    assert i not in after
        if name != "sentencepiece":
            assert docs.columns == corpus_pipeline.COLUMNS
    assert all(r.round_trip in (True, None) for r in after.values())


def test_pipeline_odd(spark):
    """Rows that repeat a doc_id stay or go together, rows with a null doc_id stay; an empty table gives an empty table."""
    long, other = " ".join(f"w{i}" for i in range(40)), " ".join(f"v{i}" for i in range(90))
    rows = [(1, long), (1, long), (2, long), (3, None), (3, None), (None, long), (4, ""), (5, f"{other} {long} at the end of it")]
    docs = documents(spark, [t for _, t in rows], [i for i, _ in rows])
    assert sorted((r.doc_id or 0, r.text) for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect() if r.text) == [(0, long), (1, long), (1, long), (5, rows[-1][1])]
    kept = sorted((r.doc_id or 0, r.text or "") for r in corpus_pipeline.drop_repeats(spark, docs, SF).collect())
    assert kept == [(0, long), (1, long), (1, long), (3, ""), (3, ""), (4, ""), (5, f"{other} at the end of it")]
    assert corpus_pipeline.drop_contaminated(spark, docs, SF).count() == len(rows)
    assert sorted(r.n_tokens for r in corpus_pipeline.tokenise(spark, docs, SF).collect())[:3] == [0, 0, 0]
    none = docs.where("false")
    for _, step in corpus_pipeline.STAGES:
        none = corpus_pipeline.stage(step(spark, none, SF), "none")
        assert none.count() == 0


def test_pipeline_drops(spark):
    """The toxicity stage drops what a directly scored table calls toxic; decontamination drops what shares a window with the benchmark."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    labels, benchmark = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    every = {r.doc_id for r in docs.collect()}
    scored = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    toxic = {r.doc_id for r in scored if r.score >= 0.5}
    assert toxic and {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, SF).collect()} == every - toxic
    low = lambda t: tuple(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")))
    items = [w for w in (low(r.text) for r in benchmark.collect()) if w]
    planted = " ".join(next(w for w in items if len(w) >= 13))
    docs = docs.unionByName(documents(spark, [planted, "not in it"], [90_001, 90_002]))
    windows = {w[k : k + min(13, len(w))] for w in items for k in range(len(w) - min(13, len(w)) + 1)}
    kept = set()
    for r in docs.collect():
        w, hit = low(r.text), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if w[k : k + n] in windows:
                    hit |= set(range(k, k + n))
        if not hit or 20 * len(hit) < len(w):
            kept.add(r.doc_id)
    assert 90_001 not in kept and 90_002 in kept
    assert {r.doc_id for r in corpus_pipeline.drop_contaminated(spark, docs, SF).collect()} == kept
