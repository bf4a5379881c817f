import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.llm import bpe, chat, decontaminate, jaccard, langid, quality, suffix_dedup
from pagewright.llm.queries import vocabulary

from .conftest import WORDS, passage


def texts_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


# ---- byte-level BPE


@pytest.fixture(scope="module")
def encoding():
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(vocabulary()), special_tokens={})


def test_bpe_digests(awkward, nothing, encoding):
    got = sorted(tuple(r) for r in bpe.digests(awkward.where("doc_id is not null"), vocabulary()).collect())
    want = []
    for doc, text in texts_of(awkward.where("doc_id is not null")):
        ids = encoding.encode_ordinary(text or "")
        want.append((doc, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert [g[:4] for g in got] == sorted(want)
    assert bpe.digests(nothing, vocabulary()).count() == 0


def test_bpe_round_trip_and_offsets(spark, encoding):
    texts = ["", "日本 é x", "a  b\n\n c", "<|endoftext|>", None, "١٢ x²"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").withColumn("ids", F.lit("clash"))
    rows = bpe.decode(bpe.encode(df, vocabulary(), offsets="at"), vocabulary()).orderBy("doc_id").collect()
    for r, text in zip(rows, texts, strict=True):
        ids = encoding.encode_ordinary(text or "")
        assert r.decoded == (text or "") and len(r["at"]) == len(ids)
        at = 0
        for i, span in zip(ids, r["at"], strict=True):  # the characters that hold the token's first and last byte
            raw, own = (text or "").encode(), encoding.decode_single_token_bytes(i)
            first, last = len(raw[: at + 1].decode("utf-8", "ignore")), len(raw[: at + len(own)].decode("utf-8", "replace"))
            whole = raw[: at + 1].decode("utf-8", "replace")
            assert (span.start, span.end) == (len(whole) - 1, last), (text, span, first)
            at += len(own)
    plain = bpe.encode(df, vocabulary()).orderBy("doc_id").collect()
    assert [r.ids for r in plain] == [encoding.encode_ordinary(t or "") for t in texts]
    table = bpe.token_bytes({"".join(bpe.byte_chars()[b] for b in k): v for k, v in bpe.read_ranks(vocabulary()).items()})
    ids = encoding.encode_ordinary("日本")
    assert "".join(bpe.decode_pieces(ids, table)) == "日本"
    said = bpe.decode(bpe.encode(df, vocabulary()), vocabulary(), pieces="said").orderBy("doc_id").collect()
    assert ["".join(r.said) for r in said] == [t or "" for t in texts]


def test_bpe_agrees_on_odd_characters(encoding):
    pieces = bpe.Pieces(bpe.tokenizer_json(bpe.read_ranks(vocabulary())))
    r = random.Random(5)
    texts = ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(0, 0x600), r.choice([32, 9, 10, 39, 0x1C, 0x85]), r.randrange(0x900, 0xD7FF) if r.random() < 0.05 else 97])) for _ in range(30)) for _ in range(400)]
    assert [np.frombuffer(x, "<u4").tolist() for x in pieces.encode(texts)] == [encoding.encode_ordinary(t) for t in texts]


# ---- chat


def conversations(spark):
    rows = [(1, 0, "user", "hi <|end|>\n"), (1, 1, "assistant", "\\0 <\\1 <|turn|> ok"), (1, 1, "assistant", "tie"), (2, 0, None, None), (2, None, "assistant", ""), (None, 0, "user", "lost"), (1, 2, "assistant<|body|>", "x"), (3, 0, "assistant", "😀é"), (3, 0, "assistant", "😀é")]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))


def test_chat_round_trip(spark):
    rows = conversations(spark)
    back = {r.conv_id: r for r in chat.read_back(chat.format_conversations(rows)).collect()}
    assert [(t.role, t.text) for t in back[1].turns] == [("user", "hi <|end|>\n"), ("assistant", "\\0 <\\1 <|turn|> ok"), ("assistant", "tie"), ("assistant<|body|>", "x")]
    assert back[1].loss_text == "\\0 <\\1 <|turn|> oktie" and back[3].loss_text == "😀é😀é"
    assert [(t.role, t.text) for t in back[2].turns] == [("assistant", ""), ("", "")] and None in back
    assert chat.digests(rows.limit(0)).count() == 0
    d = {r.conv_id: r for r in chat.digests(rows).collect()}
    said = "".join(f"{t.role}\n{t.text}\n" for t in back[1].turns)
    assert d[1].turns_sha256 == hashlib.sha256(said.encode()).hexdigest() and d[1].loss_chars == 21 and d[1].n_turns == 4


def test_chat_parts(spark):
    part = "struct<kind:string,text:string,ref:string,size:bigint>"
    rows = spark.createDataFrame([(1, 0, "user", [("text", "see <|", None, None), ("image", None, "a.png", 5000), None, ("odd", "?", None, None)]), (1, 1, "assistant", [("audio", None, "b.wav", 700), ("text", "done", None, None)]), (1, 2, "user", None)], f"conv_id int, turn int, role string, parts array<{part}>")
    (r,) = chat.format_conversations(rows, parts="parts").collect()
    assert "see <\\1<|image:0|>" in r.formatted and "<|audio:1|>done" in r.formatted
    assert [(a.n, a.ref, a.tokens) for a in r.attachments] == [(0, "a.png", 128), (1, "b.wav", 3)] and r.expanded_tokens == 131
    (m,) = r.loss_mask
    assert r.formatted[m.start : m.end] == "done"
    back = chat.read_back(chat.format_conversations(rows, parts="parts")).first()
    assert [(t.role, t.text, [(p.kind, p.text, p.n) for p in t.parts]) for t in back.turns] == [
        ("user", "see <|", [("text", "see <|", None), ("image", None, 0)]), ("assistant", "done", [("audio", None, 1), ("text", "done", None)]), ("user", "", [])]
    assert back.loss_text == "done"


def test_texts_that_look_like_placeholders(spark):
    part = "struct<kind:string,text:string,ref:string,size:bigint>"
    said = [("text", "<|image:0|>", None, None), ("image", None, "x", 1), ("text", "\\<|image:0|>", None, None), ("text", "<\\1", None, None)]
    rows = spark.createDataFrame([(1, 0, "assistant", said)], f"conv_id long, turn long, role string, parts array<{part}>")
    (t,) = chat.read_back(chat.format_conversations(rows, parts="parts")).first().turns
    assert [(p.kind, p.text, p.n) for p in t.parts] == [("text", "<|image:0|>", None), ("image", None, 0), ("text", "\\<|image:0|><\\1", None)]
    other = chat.format_conversations(rows, parts="parts", expansion={"image": (5, 10)}).first()
    assert [a.tokens for a in other.attachments] == [5]


# ---- decontamination


def brute_overlaps(docs, items):
    import regex

    split = lambda t: regex.findall(r"[\p{L}\p{M}\p{N}]+", (t or "").lower())
    out = set()
    for doc, text in docs:
        x = split(text)
        for item, body in items:
            w = split(body)
            width = min(13, len(w))
            if len(w) < 5:
                continue
            for i in range(len(x) - width + 1):
                for j in range(len(w) - width + 1):
                    if sum(a != b for a, b in zip(x[i : i + width], w[j : j + width], strict=True)) <= (2 if len(w) >= 13 else 0):
                        out.add((doc, item))
    return out


def test_decontamination(spark, awkward, nothing):
    items = [(1, passage(11, 30)), (2, passage(12, 13)), (3, passage(13, 7)), (4, "one two"), (5, None), (6, ""), (7, passage(14, 10))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    r = random.Random(3)
    docs = []
    for i in range(60):
        body = items[i % 3][1].split()
        for _ in range(r.randrange(0, 5)):
            body[r.randrange(len(body))] = r.choice(WORDS)
        docs.append((100 + i, passage(500 + i, 20) + " " + " ".join(body).upper() + "! " + passage(700 + i, 10)))
    docs += [(200, items[0][1].split(" ", 20)[0]), (201, " ".join(items[0][1].split()[8:22])), (202, None), (203, items[6][1])]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("words", F.lit("clash"))
    want = brute_overlaps(docs, items)
    assert want and {(x.doc_id, x.item_id) for x in decontaminate.overlaps(frame, bench).collect()} == want
    assert {(x.doc_id, x.item_id) for x in decontaminate.overlaps(frame, bench, broadcast_seeds=0).collect()} == want
    clean = {x.doc_id for x in decontaminate.remove_contaminated(frame, bench).collect()}
    assert clean == {d for d, _ in docs} - {d for d, _ in want}
    assert decontaminate.overlaps(nothing, bench).count() == 0 and decontaminate.overlaps(awkward, bench.limit(0)).count() == 0
    assert decontaminate.remove_contaminated(awkward, bench).count() == awkward.count()


# ---- suffix arrays


@pytest.mark.parametrize("seed", range(30))
def test_suffix_order_and_prefixes(seed):
    r = np.random.default_rng(seed)
    text = r.integers(0, 1 + seed % 5, r.integers(1, 150)).astype(np.uint8) + np.uint8(250 if seed % 2 else 0)
    wanted = r.random(len(text)) < 0.6
    order = suffix_dedup.suffix_order(text, wanted)
    padded = text.tobytes() + bytes(60)
    keys = [padded[i : i + 50] for i in order]
    assert sorted(order.tolist()) == np.flatnonzero(wanted).tolist() and keys == sorted(keys)
    for a, b, n in zip(keys, keys[1:], suffix_dedup.common_prefixes(suffix_dedup.eight_bytes(text), order), strict=False):
        assert n == next((k for k in range(50) if a[k] != b[k]), 50)


def brute_repeats(rows):
    least: dict[bytes, int] = {}
    big = 2**63 - 1
    for doc, text in rows:
        raw = (text or "").encode()
        for i in range(len(raw) - 49):
            s = raw[i : i + 50]
            least[s] = min(least.get(s, big), big if doc is None else doc)
    out = []
    for doc, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - 49):
            if least[raw[i : i + 50]] < (big if doc is None else doc):
                gone[i : i + 50] = b"\1" * 50
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out.append((doc, len(raw), sum(gone), bytes(gone).replace(b"\0", b" ").split().__len__(), hashlib.sha256(kept).hexdigest()))
    return out


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x if x is not None else 0) for x in r))


def test_repeated_passages(spark, awkward, nothing):
    shared = [passage(30, 12), passage(31, 7), "ab" * 60, "é" * 40]
    r = random.Random(9)
    docs = [(i, "".join(r.choice([passage(900 + i * 10 + k, 4), r.choice(shared)]) for k in range(5))) for i in range(40)]
    r.shuffle(docs)
    for frame in (spark.createDataFrame(docs, "doc_id long, text string"), awkward):
        rows = texts_of(frame)
        got = [tuple(x) for x in suffix_dedup.digests(frame, bucket_bytes=2_000).collect()]
        assert order(got) == order(brute_repeats(rows))
    assert suffix_dedup.digests(nothing).count() == 0
    cut = suffix_dedup.remove_repeats(awkward.withColumn("ranges", F.lit("clash")), n_chars="n_chars")
    assert cut.columns == [*awkward.columns, "ranges"]
    last = spark.createDataFrame([(2**63 - 1, shared[2]), (3, shared[2]), (None, shared[2])], "doc_id long, text string")
    assert sorted(((x.doc_id or 0, x.n_removed) for x in suffix_dedup.digests(last).collect())) == [(0, 120), (3, 0), (2**63 - 1, 120)]
    by = {(x.doc_id, x.text): x for x in cut.collect()}
    assert (0, awkward.where("doc_id = 0").first().text) in by and (1, "") in by and by[(1, "")].n_chars == 0


# ---- Jaccard join


def brute_components(rows):
    import re

    sets = {}
    for doc, text in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        sets[doc] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return sorted((d, len(s), root(d)) for d, s in sets.items())


@pytest.mark.parametrize("tile", [2000, 7])
def test_near_duplicates(spark, tile):
    r = random.Random(4)
    docs = []
    for i in range(6):
        base = passage(60 + i, [6, 12, 30, 80, 150, 400][i]).split()
        for _ in range(12):
            own = list(base)
            for _ in range(r.randrange(0, 1 + len(own) // 25 + (i < 2))):
                own[r.randrange(len(own))] = r.choice(WORDS)
            docs.append((len(docs), " ".join(own)))
    stock = passage(77, 30)
    docs += [(len(docs) + k, stock + " " + passage(2000 + k, 25)) for k in range(20)] + [(200, "a b c"), (201, "A  b\tC"), (202, None), (203, " ")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute_components(docs)
    assert sorted(tuple(x) for x in jaccard.near_duplicates(frame, tile=tile, broadcast_places=0 if tile == 7 else 1000).collect()) == want
    if tile == 2000:
        assert {x.doc_id for x in jaccard.keep_one(frame).collect()} == {c for _, _, c in want}


def test_large_blocks_and_frequent_shingles(spark, monkeypatch):
    r = random.Random(8)
    base = passage(61, 60).split()
    docs = []
    for i in range(40):
        own = list(base)
        for _ in range(r.randrange(0, 4)):
            own[r.randrange(len(own))] = r.choice(WORDS)
        docs.append((i, " ".join(own)))
    docs += [(100 + k, passage(3000 + k, 40)) for k in range(30)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute_components(docs)
    monkeypatch.setattr(jaccard, "FREQUENT", 8)
    monkeypatch.setattr(jaccard, "ABOVE_MEAN", 0)
    assert jaccard.frequency_sketch(frame, "text")[1] == 3
    for few in (0, 1000):
        assert sorted(tuple(x) for x in jaccard.near_duplicates(frame, block=3, broadcast_keys=few).collect()) == want


def test_sketch_counts_everything(spark):
    from pagewright.llm import sketch

    texts = [passage(i, 50) for i in range(60)] + [None, ""]
    frame = spark.createDataFrame([(t,) for t in texts], "text string").repartition(7)
    ranks, total = sketch.frequency_ranks(frame, "text", jaccard.shingle_sets, 16)
    every = np.concatenate(jaccard.shingle_sets(texts))
    counts = np.bincount(sketch.slots(every, 16), minlength=1 << 16)
    assert total == len(every) and (ranks == np.log2(counts + 1).astype(int)).all()


def test_near_duplicates_awkward(awkward, nothing):
    got = [tuple(x) for x in jaccard.near_duplicates(awkward).collect()]
    known = [(d, t) for d, t in texts_of(awkward) if d is not None]
    want = brute_components(known)
    assert sorted({g for g in got if g[0] is not None}) == want and len(got) == awkward.count()
    assert all(g[2] is None for g in got if g[0] is None)
    assert jaccard.near_duplicates(nothing).count() == 0


# ---- language


def test_viterbi_is_exact():
    r = np.random.default_rng(0)
    for _ in range(20):
        lengths = r.integers(0, 40, 5)
        owner, scores = np.repeat(np.arange(5), lengths), r.normal(0, 3, (lengths.sum(), 3))
        labels = langid.viterbi(scores, owner, 5, 2.0, block=7)
        for t in range(5):
            s, own = scores[owner == t], labels[owner == t]
            if len(s):
                best = s[0].copy()
                for row in s[1:]:
                    best = np.maximum(best, best.max() - 2.0) + row
                assert abs(sum(s[i, x] for i, x in enumerate(own)) - 2.0 * int((np.diff(own) != 0).sum()) - best.max()) < 1e-9


def test_language(spark, awkward, nothing):
    speak = {"en": "the quick house with thing", "de": "und schnell häuser mit zung", "ru": "быстрый дом и вещи"}
    r = random.Random(1)
    rows = [(i, " ".join(r.choice(speak[x].split()) for _ in range(30)), x) for i in range(90) for x in [sorted(speak)[i % 3]]]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    assert model.langs == ["de", "en", "ru"]
    tests = [(0, "the house with quick thing the house"), (1, "häuser und zung mit"), (2, "быстрый дом"), (3, None), (4, "12 34 !"), (5, ""), (6, "ελληνικά γράμματα")]
    out = {x.doc_id: x for x in langid.predict(spark.createDataFrame(tests, "doc_id long, text string").withColumn("score", F.lit("clash")), model, spans="spans").collect()}
    assert [out[i].lang_pred for i in range(6)] == ["en", "de", "ru", "und", "und", "und"] and out[6].lang_pred in model.langs
    assert out[3].score == 0 and 0 < out[0].score <= 1
    mixed = "the house with quick thing быстрый дом и вещи"
    assert [(mixed[a:b], x) for a, b, x in langid.spans_of(mixed, model)] == [("the house with quick thing", "en"), ("быстрый дом и вещи", "ru")]
    assert langid.predict(awkward, model).count() == awkward.count()
    none = langid.fit(nothing, F.lit(True))
    assert {x.lang_pred for x in langid.predict(awkward, none).collect()} == {"und"}


# ---- quality


def test_machine_in_linear_time():
    r = np.random.default_rng(2)
    m = quality.Machine(0.3, r.normal(size=quality.n_features()), r.normal(size=(quality.n_features(), 3)))
    number, value, first = quality.features(["a b a !!", "", "x"], [3, None, 1])
    for i, got in enumerate(quality.margin(m, number, value, first)):
        n, v = number[first[i] : first[i + 1]], value[first[i] : first[i + 1]]
        pairs = sum(v[a] * v[b] * (m.vectors[n[a]] @ m.vectors[n[b]]) for a in range(len(n)) for b in range(a))
        assert abs(got - (m.bias + m.weights[n] @ v + pairs)) < 1e-8


def test_quality(spark, awkward, nothing):
    r = random.Random(2)
    rows = [(i, (" ".join(r.choice(WORDS) for _ in range(60)) if i % 2 else " ".join(r.choice(WORDS).upper() + "!!" for _ in range(60))), 0) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(None, 1), (3, None)], "doc_id long, quality int")
    m = quality.fit(docs, labels, F.lit(True))
    scores = {x.doc_id: x.score for x in quality.score(docs, m).collect()}
    assert np.mean([(scores[i] >= 0.5) == bool(i % 2) for i in range(200, 300)]) > 0.95
    out = quality.score(awkward, m).collect()
    assert len(out) == awkward.count() and all(0 <= x.score <= 1 for x in out)
    assert quality.fit(docs, labels.limit(0), F.lit(True)) is None
    assert {x.score for x in quality.score(awkward, None).collect()} == {0.5} and quality.score(nothing, m).count() == 0
