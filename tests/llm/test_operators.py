"""Each operator against brute force on odd documents, and on an empty table."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from corpuscle.llm import anchors, bpe, fingerprint, induced_sort, language_id, license_scan, media, mixing, simhash, toxicity, warc


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def by_text(odd_rows):
    return [(r[0], r[1] or "") for r in odd_rows]


# Language identification


def test_forward_sums_all_segmentations():
    model = language_id.LanguageModel(["a", "ab", "b", "▁", "▁a"], ["x", "y"], np.array([[0.1, 0.2], [0.3, 0.1], [0.2, 0.2], [0.2, 0.3], [0.1, 0.1], [1e-6, 1e-6]]))
    model.learn(["ab", "zb"])
    for k, p in enumerate(model.p.T):
        a, ab, b, start, start_a, unknown = p
        assert model.logs[model.cache["ab"]][k] == pytest.approx(np.log(start * (a * b + ab) + start_a * b))
        assert model.logs[model.cache["zb"]][k] == pytest.approx(np.log(start * unknown * b))


def test_forward_of_long_words_does_not_vanish():
    model = language_id.LanguageModel(["a", "▁"], ["x"], np.array([[1e-3], [0.5], [1e-6]]))
    model.learn(["a" * 5000])
    assert model.logs[model.cache["a" * 5000]][0] == pytest.approx(np.log(0.5) + 5000 * np.log(1e-3))


def test_language_of_held_out_documents(spark, sf):
    got = language_id.op1_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.95
    assert held.held_out.tolist() == [zlib.crc32(str(i).encode()) % 4 == 2 for i in held.doc_id]


def test_numerals_are_no_letters(spark):
    texts = ["½ ² ① Ⅷ", "٣ 7 _", "²x", "一", None]
    docs = spark.createDataFrame([(4 * i, t, "en") for i, t in enumerate([*texts, "plain words of a language"])], "doc_id long, text string, lang string")
    model = language_id.LanguageModel.fit({"en": {"x": 1, "words": 2}}, ["x", "w", "words", "▁"])
    got = {r["doc_id"] // 4: r["lang_pred"] for r in language_id.predict(docs, model).collect()}
    assert [got[i] for i in range(5)] == ["und" if not any(map(str.isalpha, t or "")) else "en" for t in texts] == ["und", "und", "en", "en", "und"]


def test_too_many_languages_are_an_error(odd, monkeypatch):
    monkeypatch.setattr(language_id, "MAX_LANGUAGES", 1)
    with pytest.raises(language_id.TooManyLanguages):
        language_id.train(odd)


def test_language_of_odd_documents(odd, none, odd_rows):
    model = language_id.train(odd)
    got = language_id.predict(odd, model).toPandas()
    assert len(got) == len(odd_rows)
    assert got.score.between(0, 1).all()
    und = {r[0] for r in odd_rows if not any(map(str.isalpha, r[1] or ""))}
    assert set(got[got.lang_pred == "und"].doc_id) == und
    assert language_id.predict(none, language_id.train(none)).count() == 0
    assert set(language_id.predict(odd, language_id.train(none)).toPandas().lang_pred) == {"und"}


# Toxicity


def test_toxicity_of_held_out_documents(spark):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(400)]
    rows = []
    for i in range(900):
        toxic = i % 3 == 0
        text = [rng.choice(words) for _ in range(60)]
        if toxic:
            text[::9] = [rng.choice(["zqxwvile", "zqxwrot", "kkvorst"]) for _ in text[::9]]
        rows.append((i, " ".join(text), int(toxic)))
    all_ = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(all_.select("doc_id", "text"), all_.select("doc_id", "toxic"))
    got = toxicity.scores(all_, model).join(all_.select("doc_id", "toxic"), "doc_id").where(toxicity.fold()).toPandas()
    assert (got[got.toxic == 1].score >= 0.7).mean() > 0.9
    assert (got[got.toxic == 0].score < 0.7).mean() > 0.97


def test_toxicity_of_odd_documents(spark, odd, none, odd_rows):
    labels = spark.createDataFrame([(i, i % 2 if i != 5 else None) for i in range(12)], "doc_id long, toxic int")
    got = toxicity.scores(odd, toxicity.train(odd, labels)).toPandas()
    assert len(got) == len(odd_rows) and got.score.between(0, 1).all()
    assert set(toxicity.scores(odd, toxicity.train(odd, labels.where("false"))).toPandas().score) == {0.0}
    assert toxicity.scores(none, toxicity.train(odd, labels)).count() == 0


# Media


def test_media_round_trip(odd, none, odd_rows):
    got = media.media_features(media.to_media(odd)).toPandas()
    want = []
    for i, t in by_text(odd_rows):
        data = t.encode()
        full = data + b"\xff" * (-len(data) % 576 or (0 if data else 576))
        want.append((-1 if i is None else i, len(data), len(full), sha(full), zlib.crc32(full[-32:])))
    have = [(-1 if np.isnan(r.doc_id) else int(r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got.itertuples()]
    assert sorted(have) == sorted(want)
    assert got.groupby("payload_sha256")[["media_sha256", "feature"]].nunique().max().max() == 1
    assert media.media_features(media.to_media(none)).count() == 0


@pytest.mark.parametrize("kind", range(5))
def test_every_filter_is_undone(kind):
    rng = np.random.default_rng(kind)
    image = rng.integers(0, 256, (7, 48), dtype=np.uint8)
    lines = np.zeros((7, 49), np.uint8)
    for y in range(7):
        for x in range(48):
            a, b, c = int(image[y, x - 1]) if x else 0, int(image[y - 1, x]) if y else 0, int(image[y - 1, x - 1]) if x and y else 0
            p = a + b - c
            paeth = min(((abs(p - v), n, v) for n, v in enumerate((a, b, c))))[2]
            k = kind if y != 3 else 0
            lines[y, 0] = k
            lines[y, x + 1] = (int(image[y, x]) - (0, a, b, (a + b) // 2, paeth)[k]) & 255
    assert np.array_equal(media.unfilter(lines), image)


def test_broken_chunks_are_found():
    png = bytearray(media.encode_png(media.payload_of("some text")[1]))
    png[50] ^= 1
    with pytest.raises(media.BadPng):
        media.decode_png(bytes(png))
    with pytest.raises(media.BadPng):
        media.decode_png(media.encode_png(bytes(576))[:-12])


# Fingerprints


def test_fingerprints_of_odd_documents(odd, none, odd_rows):
    docs = sorted(by_text(odd_rows), key=lambda r: (-(r[0] if r[0] is not None else -(2**63)), r[1]))
    got = fingerprint.edited_likeness(odd).toPandas()
    assert len(got) == len(docs)
    want = []
    for n, (i, t) in enumerate(docs):
        following = docs[(n + 1) % len(docs)][1]
        half = len(t) // 2
        changed = t[: len(t) - half] + following[:half]
        want.append((-1 if i is None else i, len(t), sha(changed), fingerprint.as_text(fingerprint.sketch(t)), round(fingerprint.likeness(fingerprint.sketch(t), fingerprint.sketch(following)), 9)))
    have = [(-1 if np.isnan(r.doc_id) else int(r.doc_id), r.n_chars, r.edited_sha256, r.fingerprint, round(r.near_next, 9)) for r in got.itertuples()]
    assert sorted(have) == sorted(want)
    assert fingerprint.edited_likeness(none).count() == 0


def test_sketch_keeps_all_hashes_below_the_threshold():
    text = " ".join(map(str, range(3000)))
    words = text.split()
    hashes = {xxhash.xxh64_intdigest(" ".join(words[i : i + 5]), 7) >> 16 for i in range(len(words) - 4)}
    assert fingerprint.sketch(text).tolist() == sorted(h for h in hashes if h < 2**48 // 8)


def test_sketches_merge_and_contain(spark):
    texts = [" ".join(map(str, range(a, b))) for a, b in ((0, 2000), (1000, 4000))]
    s = fingerprint.sketches(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    a, b = (r["hashes"] for r in s.orderBy("doc_id").collect())
    both = s.agg(fingerprint.merged("hashes").alias("m")).first()["m"]
    assert both == sorted({*a, *b})
    share = s.sparkSession.createDataFrame([(a, both)], "a array<long>, b array<long>").select(fingerprint.containment("a", "b"), fingerprint.containment("b", "a")).first()
    assert share[0] == 1.0 and share[1] == pytest.approx(0.5, abs=0.1)


# Mixing


def test_apportionment_is_greedy():
    rng = random.Random(0)
    for _ in range(200):
        votes = [rng.choice([0, rng.random() * 100]) for _ in range(rng.randint(1, 8))]
        most = [rng.randint(0, 30) for _ in votes]
        seats = rng.randint(0, 60)
        won = [0] * len(votes)
        for _ in range(seats):
            open_ = [i for i, v in enumerate(votes) if v > 0 and won[i] < most[i]]
            if not open_:
                break
            won[max(open_, key=lambda i: (votes[i] / (2 * won[i] + 1), -i))] += 1
        assert mixing.apportion(votes, seats, most) == won


def test_targets_share_what_is_over():
    assert mixing.targets([10, 1000, 1000]) == pytest.approx([20, 2995 * 2 / 3 if 2995 * 2 / 3 < 2000 else 2000, 3015 - 20 - 2995 * 2 / 3])
    assert mixing.targets([]) == [] and mixing.targets([0, 0]) == [0, 0]


# WARC


def test_archives_of_odd_pages(spark, tmp_path):
    long = "x" * 150
    rows = [(1, "u1", long), (2, "u2\r\nX: y", long), (3, None, "short"), (4, "u", "short"), (5, "u", None), (None, "u", long), (7, "u", "é" * 200), (8, "u", "é" * 200), (8, "u", "é" * 200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.register(spark)
    path = f"file://{tmp_path}/w"
    warc.page_records(pages.repartition(2)).write.format("warc").mode("append").save(path)
    read = spark.read.format("warc").option("split_bytes", "300").load(path)
    got = sorted((r.record_id or "", r.warc_type, r.refers_to or "", r.payload_digest, r.payload_bytes, bytes(r.payload) if r.payload is not None else None) for r in read.collect())
    want = []
    for i, _, html in rows:
        data = (html or "").encode()
        first = min((j for j, _, h in rows if j is not None and (h or "").encode() == data), default=None)
        revisit = len(data) >= 100 and first is not None and first != i and sum((h or "").encode() == data for _, _, h in rows) > 1
        want.append((f"urn:page:{i}" if i is not None else "", "revisit" if revisit else "response", f"urn:page:{first}" if revisit else "", sha(data), len(data), None if revisit else data))
    assert got == sorted(want)
    assert read.where("warc_type = 'revisit' and target_uri = 'u'").count() == 3
    heads = spark.read.format("warc").option("payload", "false").load(path).where(F.col("record_id").startswith("urn:page:7"))
    assert [(r.payload, r.payload_bytes) for r in heads.collect()] == [(None, None)]
    empty = f"file://{tmp_path}/e"
    warc.page_records(pages.where("false")).write.format("warc").mode("append").save(empty)
    assert spark.read.format("warc").load(empty).count() == 0


def test_members_are_gzip():
    import gzip

    data = warc.record("urn:page:1", "response", "u", None, "d", None, b"payload", 7)
    assert gzip.decompress(warc.member(data) * 2) == data * 2


# Suffix-array deduplication


def order_of(text):
    order = sorted(range(len(text)), key=lambda i: text[i:])
    common = [0]
    for a, b in zip(order, order[1:], strict=False):
        k = 0
        while max(a, b) + k < len(text) and text[a + k] == text[b + k]:
            k += 1
        common.append(k)
    return order, common


@pytest.mark.parametrize("few", [0, 2048])
def test_induced_order_and_common_prefixes(monkeypatch, few):
    monkeypatch.setattr(induced_sort, "FEW_SYMBOLS", few)
    rng = random.Random(few)
    for n in range(150):
        text = [rng.randint(1, rng.choice([1, 2, 4, 20])) for _ in range(rng.randint(1, 70))]
        text = (text * 3)[:80] if n % 4 == 0 else text
        blocks = list(induced_sort.suffixes(np.array([*text, 0]), 64, budget=rng.choice([2, 1 << 20])))
        got = np.concatenate([p for p, _ in blocks]).tolist(), np.concatenate([c for _, c in blocks]).tolist()
        assert got == order_of([*text, 0])


def test_anchors_cover_all_windows():
    rng = np.random.default_rng(1)
    for data in (rng.integers(0, 4, 900, dtype=np.uint8), np.zeros(700, np.uint8)):
        place, first, last, h = anchors.anchors(data, 400, 64)
        assert first[0] == 0 and last[-1] == len(data) - 400 and (first[1:] == last[:-1] + 1).all()
        hashes = anchors.gram_hashes(data, 64)
        for p, a, z in zip(place, first, last, strict=True):
            for s in (a, z):
                ranked = [(int(hashes[i]) >> 31, i) for i in range(s, s + 400 - 64 + 1)]
                assert min(ranked)[1] == p
    assert len(anchors.anchors(np.zeros(399, np.uint8), 400, 64)[0]) == 0


# BPE


def test_bpe_equals_the_library(odd, none, odd_rows):
    whole = bpe.encoder(bpe.vocabulary_path()).whole
    got = bpe.encoding_digests(odd).toPandas()
    want = []
    for i, t in by_text(odd_rows):
        ids = whole.encode(t, add_special_tokens=False).ids
        want.append((-1 if i is None else i, len(ids), sha(" ".join(map(str, ids))), sha(whole.decode(ids, skip_special_tokens=False))))
    assert sorted((-1 if np.isnan(r.doc_id) else int(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got.itertuples()) == sorted(want)
    assert bpe.encoding_digests(none).count() == 0


def test_bpe_of_any_characters():
    e = bpe.encoder(bpe.vocabulary_path())
    rng = random.Random(5)
    letters = [chr(c) for c in [*range(9, 127), 0x85, 0xA0, 0xE9, 0x130, 0x301, 0x3A3, 0x1E9E, 0x200B, 0x2028, 0x4E2D, 0x660, 0xB2, 0x1680, 0x180E, 0x1F600]]
    for _ in range(2000):
        text = "".join(rng.choices(letters, k=25))
        assert e.encode(text) == e.whole.encode(text, add_special_tokens=False).ids, text


def test_forced_boundaries_are_in_no_token():
    e = bpe.encoder(bpe.vocabulary_path())
    inner = {w[i : i + 2] for t in e.tokens.values() for w in [t.removesuffix("</w>")] for i in range(len(w) - 1)}
    parts = e.cut("qxzjvwhello")
    assert "".join(parts) == "qxzjvwhello" and len(parts) > 1
    assert all(a[-1] + b[0] not in inner for a, b in zip(parts, parts[1:], strict=False))


# Licences


def test_phrases_of_odd_documents(odd, none, odd_rows):
    got = license_scan.licenses(odd).toPandas()
    assert len(got) == len(odd_rows) and license_scan.licenses(none).count() == 0
    assert got[got.doc_id == 20].n_words.tolist() == [0] and got[got.doc_id == 23].n_words.tolist() == [1]


def test_phrases_are_counted_at_all_places():
    rng = random.Random(2)
    words = "gnu general public license apache cc by mit x".split()
    s = license_scan.Scanner()
    for _ in range(500):
        text = rng.choice([" ", "-", "\n"]).join(rng.choices([*words, "MIT", "CC"], k=40))
        low = re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if c.isascii() else c for c in text))
        want = sorted((i, label) for phrase, label in license_scan.PHRASES for p in [phrase.split()] for i in range(len(low)) if low[i : i + len(p)] == p)
        n, line = license_scan.word_line(text)
        assert n == len(low) and s.scan(line)[0] == want


def test_notices_within_their_errors_are_found():
    rng = random.Random(4)
    s = license_scan.Scanner()
    for notice, label in license_scan.NOTICES:
        most = max(1, len(notice) // license_scan.ERROR_EVERY)
        for _ in range(20):
            t = list(notice)
            for _ in range(rng.randint(0, most)):
                i = rng.randrange(len(t))
                t[i] = rng.choice(["", "q", t[i] + "q"])
            n, line = license_scan.word_line("start " + "".join(t) + " end")
            found = [m for m in s.scan(line)[1] if m[0] == label]
            assert found, "".join(t)
            assert min(m[3] for m in found) <= most
    assert s.scan(license_scan.word_line("permission slips are public and general, the mozilla said")[1])[1] == []


# SimHash


def test_fingerprint_bits():
    text = "One two  three\tfour FIVE two"
    w = "one two three four five two".split()
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]), 42) for i in range(4)]
    assert simhash.fingerprint(text) == sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) > 2)
    assert simhash.fingerprint("A b") == xxhash.xxh64_intdigest("a b", 42)
    assert simhash.fingerprint(None) == 0 == simhash.fingerprint(" \n")


def test_spark_hashes_alike(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0] % 2**64 == xxhash.xxh64_intdigest("a b c", 42)


def linked(fps):
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fps))]


def test_components_of_planted_fingerprints(spark):
    rng = random.Random(6)
    fps = []
    for _ in range(30):
        fp = rng.getrandbits(64)
        for _ in range(12):
            fps.append(fp)
            for _ in range(rng.randint(0, 4)):
                fp ^= 1 << rng.randrange(64)
    fps += [0, 1, 7, 15, 0]
    table = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f,) for f in fps], "fp long")
    roots = {r["node"] % 2**64: r["root"] for r in simhash.components(simhash.links(table)).collect()}
    want = linked(fps)
    groups = {}
    for f, w in zip(fps, want, strict=True):
        groups.setdefault(w, set()).add(f)
    for members in groups.values():
        assert len({roots.get(f, f) for f in members}) == 1 or len(members) == 1
    assert len({roots.get(f, f) % 2**64 for f in set(fps)}) == len(groups)


def test_components_of_odd_documents(odd, none, odd_rows):
    got = simhash.near_duplicates(odd).toPandas()
    fps = [simhash.fingerprint(r[1]) for r in odd_rows]
    roots = linked(fps)
    least = {}
    for r, root in zip(odd_rows, roots, strict=True):
        if r[0] is not None:
            least[root] = min(least.get(root, r[0]), r[0])
    want = sorted((-1 if r[0] is None else r[0], least.get(root, -1)) for r, root in zip(odd_rows, roots, strict=True))
    assert sorted((-1 if np.isnan(r.doc_id) else int(r.doc_id), -1 if np.isnan(r.component_id) else int(r.component_id)) for r in got.itertuples()) == want
    assert simhash.near_duplicates(none).count() == 0
