import random
import re
import zlib

import numpy as np
import pytest
from conftest import words
from pyspark.sql import functions as F

from calorant.llm import convnet, decontamination, languages, ogg, packing, quality, secrets, toxicity, trees

PATH = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


# packing


def brute_fill(lengths, capacity):
    best = {0}
    for x in lengths:
        best |= {b + x for b in best if b + x <= capacity}
    return max(best)


def test_closest_fill_is_optimal():
    rng = random.Random(1)
    for _ in range(300):
        lengths = sorted({rng.randint(1, 60) for _ in range(rng.randint(1, 8))}, reverse=True)
        counts = [rng.randint(1, 4) for _ in lengths]
        capacity = rng.randint(1, 150)
        total, used = packing.closest_fill(lengths, counts, capacity)
        assert total == sum(x * n for x, n in used.items()) == brute_fill([x for x, c in zip(lengths, counts) for _ in range(c)], capacity)
        assert all(used.get(x, 0) <= c for x, c in zip(lengths, counts))


def packed(df):
    return [r.asDict() for r in packing.pack(df, PATH).collect()]


def test_packing_keeps_every_id_once(awkward, nothing):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    pieces = packed(awkward)
    by = {}
    for p in pieces:
        by.setdefault(p["sequence_id"], []).append(p)
    for own in by.values():
        own.sort(key=lambda p: p["offset"])
        total = sum(p["length"] for p in own)
        assert [p["offset"] for p in own] == list(np.cumsum([0] + [p["length"] for p in own[:-1]]))
        assert total == 2048 or total & (total - 1) == 0
    texts = {r.doc_id: r.text for r in awkward.collect()}
    for doc_id in {p["doc_id"] for p in pieces} - {7, None}:
        ids = np.array([*t.encode(texts[doc_id] or "", add_special_tokens=False).ids, 1], dtype="<u4")
        own = sorted((p for p in pieces if p["doc_id"] == doc_id), key=lambda p: p["start"])
        at = 0
        for p in own:
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
    assert packed(nothing) == []


def test_encoder_agrees_with_tokenizers():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    rng, encode = random.Random(2), packing.encoder(PATH)
    texts = ["<|endoftext|> It's  we'll\n\n x", "Größe 12,5 kg — ça va?", "Привет мир 漢字   \x85 \x1c x", "a" * 3000, " \t \r\n  "]
    texts += ["".join(rng.choice("ab '\n\t12é.!ßñ  ") for _ in range(200)) for _ in range(200)]
    for text in texts:
        assert list(encode(text)) == t.encode(text, add_special_tokens=False).ids, text


# containers


def test_container_round_trip_and_faults():
    rng = random.Random(3)
    for size in (0, 1, 575, 576, 577, 60_000, 250_000):
        data = rng.randbytes(size)
        payload = ogg.padded(data)
        media = ogg.write(payload)
        streams, pages = ogg.read(media)
        assert ogg.joined(streams) == payload and len(payload) % 576 == 0 and payload
        assert pages == media.count(b"OggS")
        bad = bytearray(media)
        bad[rng.randrange(28, len(bad))] ^= 1
        with pytest.raises(ValueError):
            ogg.read(bytes(bad))
    assert ogg.page_checksum(b"\0" * 27) == 0


def test_checksum_bit_by_bit():
    rng = random.Random(4)
    for _ in range(20):
        data, crc = rng.randbytes(50), 0
        for b in data:
            crc ^= b << 24
            for _ in range(8):
                crc = (crc << 1 ^ 0x04C11DB7) & 0xFFFFFFFF if crc & 1 << 31 else crc << 1 & 0xFFFFFFFF
        assert ogg.page_checksum(data) == crc


def test_long_packets_and_times():
    packets = [b"x" * 70_000, b"", b"y" * 255, b"z" * 3]
    media = b"".join(ogg.stream_pages(packets, 9, 100))
    streams, _ = ogg.read(media)
    assert streams[9]["packets"] == packets
    assert ogg.packet_times(streams[9], 100) == [1.0, 2.0, 3.0, 4.0]


def test_media_features(awkward, nothing):
    rows = ogg.media_features(awkward).collect()
    assert len(rows) == awkward.count() and ogg.media_features(nothing).count() == 0
    values = {}
    for r in rows:
        key = next((x.text or "") for x in awkward.collect() if x.doc_id == r.doc_id) if r.doc_id is not None else None
        if key is not None:
            assert values.setdefault(key, tuple(r)[1:]) == tuple(r)[1:]
            assert r.n_bytes == len(key.encode())


# secrets


def brute_base(text):
    out = []
    for m in re.finditer(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 12:
            out.append(("assign", *m.span()))
    out += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out, key=lambda s: (s[1], ["assign", "access", "hex"].index(s[0])))


def test_base_spans_by_the_letter():
    rng = random.Random(5)
    bits = ["password", "Token", "API_KEY", "apikey", "ſecret", "secret", ": ", "=", '"', "'", "AKIA", "ABCDEFGH1234567890", "0123456789abcdef", "zz", " ", "token=secret=abcdefghijkl", "é", "A1b2C3d4E5f6G7h8"]
    for _ in range(500):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        assert secrets.base_spans(text) == brute_base(text), text


def test_network_learns_and_adds(spark):
    rng = random.Random(6)
    docs = spark.createDataFrame([(i, words(rng, 60) + f' token = "{rng.getrandbits(160):040x}" ' + words(rng, 20)) for i in range(120)], "doc_id long, text string")
    model = secrets.fit(docs)
    x, y = secrets.generated([words(rng, 60) for _ in range(40)], 200, seed=99)
    p = model.probability(x) >= model.threshold
    assert p[y == 1].mean() > 0.9 and p[y == 0].mean() < 0.1
    key = "xK9f" + "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(32))
    text = f"{words(rng, 20)} {key} {words(rng, 20)}"
    base, every = model.spans(text)
    assert base == [] and [(text[a:b]) for _, a, b in every] == [key]
    assert secrets.redact(text, every) == text.replace(key, secrets.MASK)
    assert secrets.redact("abcdef", [("hex", 1, 3), ("hex", 2, 4), ("hex", 5, 6)]) == "a<secret>e<secret>"


def test_secrets_on_awkward_rows(awkward, nothing):
    model = secrets.fit(awkward)
    rows = secrets.scan(awkward, model).collect()
    assert len(rows) == awkward.count() and secrets.scan(nothing, model).count() == 0
    by = {r.doc_id: r for r in rows}
    assert by[3].spans == "" and by[3].redacted == "" and by[11].n_assign == 1 and by[11].n_hex == 1
    secrets.fit(nothing)


def test_gradient_by_differences():
    rng = np.random.default_rng(1)
    net = convnet.Network(embed=3, filters=4)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    x, y = rng.integers(0, convnet.CLASSES, (6, convnet.WIDTH)).astype(np.uint8), rng.integers(0, 2, 6).astype(float)

    def loss():
        m = net._forward(x)[-1]
        return float(np.mean(np.logaddexp(0, m) - y * m))

    for name, g in net._gradient(x, y).items():
        flat, grad = net.w[name].reshape(-1), np.asarray(g).reshape(-1)
        for k in np.argsort(-np.abs(grad))[:3]:
            before, step = flat[k], 1e-5
            flat[k] = before + step
            up = loss()
            flat[k] = before - step
            down = loss()
            flat[k] = before
            assert abs((up - down) / (2 * step) - grad[k]) < 1e-4


# languages

LETTERS = {"aa": "abcdefg", "bb": "mnopqrs", "cc": "абвгдеж"}


@pytest.fixture(scope="module")
def speech(spark):
    rng = random.Random(7)
    rows = [(i, words(rng, 40, LETTERS[lang]), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return df, languages.fit(df)


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(2)
    for _ in range(60):
        n = [int(x) for x in rng.integers(0, 6, 3)]
        first = np.cumsum([0, *n])
        scores = rng.normal(0, 3, (first[-1], 3)).astype(np.float32)
        got = languages.viterbi(scores, first, 1.5)
        for a, b in zip(first[:-1], first[1:]):
            value = lambda path: sum(scores[a + k, s] for k, s in enumerate(path)) - 1.5 * sum(x != y for x, y in zip(path, path[1:]))  # noqa: B023, E731
            import itertools

            best = max(map(value, itertools.product(range(3), repeat=b - a)))
            assert abs(value(list(got[a:b])) - best) < 1e-3


def test_spans_of_mixed_text(speech):
    df, model = speech
    rng = random.Random(8)
    a, b, c = (words(rng, 12, LETTERS[k]) for k in ("aa", "bb", "cc"))
    text = f"{a} {b}. {c}"
    spans = languages.predict([text], model, True)["spans"][0]
    assert [(text[s["start"] : s["end"]], s["lang"]) for s in spans] == [(a, "aa"), (b, "bb"), (c, "cc")]
    got = {r.doc_id: r for r in languages.label(df, model).collect()}
    assert all(got[r.doc_id].lang_pred == r.lang for r in df.collect())


def test_languages_on_awkward_rows(awkward, nothing, speech):
    model = languages.fit(awkward)
    rows = languages.label(awkward, model).collect()
    assert len(rows) == awkward.count()
    assert {r.lang_pred for r in rows if r.doc_id in (3, 4, 5)} == {"und"}
    assert languages.label(nothing, model).count() == 0
    assert {r.lang_pred for r in languages.label(awkward, languages.fit(nothing)).collect()} == {"und"}
    assert languages.predict(["漢字 漢字"], speech[1], False)["lang_pred"][0] in LETTERS


# quality and toxicity


def test_quality_separates(spark, awkward, nothing):
    rng = random.Random(9)
    rows = [(i, words(rng, 80) if i % 2 else " ".join(w + rng.choice(["$$$", "###", "%%%"]) for w in words(rng, 80).split())) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(200)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs.where("doc_id < 150"), labels.where("doc_id < 150"))
    got = {r.doc_id: r for r in quality.score(docs, model).collect()}
    assert sum(got[i].predicted == i % 2 for i in range(150, 200)) >= 47
    rows = quality.score(awkward, model).collect()
    assert len(rows) == awkward.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in rows if r.doc_id in (3, 4)} == {model.prior}
    empty = quality.fit(nothing, labels.limit(0))
    assert {r.score for r in quality.score(awkward, empty).collect()} == {0.5}


def test_toxicity_separates(spark, awkward, nothing):
    rng = random.Random(10)
    rows = []
    for i in range(300):
        w = words(rng, 60).split()
        if i % 3 == 0:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["you idiot", "moron", "gnarbo" + words(rng, 1)]))
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(300)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels.where("doc_id < 220"))
    assert any(b.startswith("gnar") for b in model.lexicon.beginnings)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert sum(got[i].predicted == (i % 3 == 0) for i in range(220, 300)) >= 76
    rows = toxicity.score(awkward, model).collect()
    assert len(rows) == awkward.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score(nothing, toxicity.fit(nothing, labels.limit(0))).count() == 0


def test_isotonic_and_trees():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 3))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    trees_ = trees.boost(x, y)
    assert ((trees_.margin(x) > 0) == y).mean() > 0.97
    knots, values = trees.isotonic(np.array([1.0, 2, 2, 3, 4]), np.array([0.0, 1, 0, 0, 1]))
    assert list(np.interp([1, 2, 3, 4], knots, values)) == pytest.approx([0, 1 / 3, 1 / 3, 1])


# decontamination


def test_templates_line_up(spark):
    df = spark.createDataFrame([("In 1999, Anna Smith paid 12kg of gold; then 3 km. Zürich x9y",), ("",), ("ÉTÉ — 5 % 7",)], "text string")
    for r in df.select(decontamination.template(F.col("text")).alias("t"), decontamination.words(F.col("text")).alias("w")).collect():
        assert len(r.t) == len(r.w)
    first = df.select(decontamination.template(F.col("text")).alias("t")).first().t
    assert first[:7] == ["in", "zznum", "zzname", "smith", "paid", "zznum", "zzunit"]


def test_finds_reparameterised_items(spark, awkward, nothing):
    item = "If a train leaves the old station at 40 km and returns with 12 more crates than the 40 it took before noon, how many crates are left over in the yard"
    other = item.replace("40", "77").replace("12", "5").replace("km", "miles")
    uneven = item.replace("at 40", "at 77").replace("12", "5")
    docs = spark.createDataFrame([(1, "Intro. " + item + " and so on"), (2, other), (3, uneven), (4, "the yard is empty and the train is late"), (5, None), (2, other)], "doc_id long, text string")
    bench = spark.createDataFrame([(10, item), (11, "too short"), (12, None)], "item_id long, text string")
    got = decontamination.contaminated(docs, bench).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(1, 10), (2, 10)]
    assert sorted(r.doc_id for r in decontamination.clean(docs, bench).collect()) == [3, 4, 5]
    assert decontamination.contaminated(awkward, bench).count() == 0
    assert decontamination.contaminated(nothing, bench).count() == 0
    assert decontamination.clean(awkward, bench.limit(0)).count() == awkward.count()
