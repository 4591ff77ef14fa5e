"""Features and queries that have no SQL against versions written out plainly."""

import math

import numpy as np
import pytest
import xxhash
import zstandard

from corpuscle.llm import fingerprint, language_id, media, near_copies, toxicity
from tests.llm.conftest import prose


def test_savings_of_windows():
    """Toxicity features: a window's length with either dictionary, by a compressor made for it alone."""
    ordinary, toxic = prose(1, 900).encode(), (prose(1, 700) + " " + "vile scum rotten filth " * 12).encode()
    model = toxicity.ToxicityModel(ordinary, toxic)
    form = zstandard.ZstdCompressionParameters.from_level(toxicity.LEVEL, min_match=3, write_content_size=False, write_checksum=False, write_dict_id=False)
    length = lambda content, window: len(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=form).compress(window))
    for text in (None, "", "one", prose(5, 60) + " you vile scum rotten " + prose(6, 40), "x" * 500, "Vile ÜBEL " * 30):
        cut, run = [], []
        for word in (text or "").lower().encode().split():
            run.append(word)
            if sum(len(w) + 1 for w in run) >= toxicity.WINDOW:
                cut.append(b" ".join(run))
                run = []
        cut += [b" ".join(run)] if run else []
        assert toxicity.windows(text) == cut
        saved = sorted((length(ordinary, w) - length(toxic, w) for w in cut), reverse=True) or [0]
        want = [saved[0], sum(saved[:3]) / len(saved[:3]), sum(saved) / len(saved), math.log1p(len(cut))]
        want += [sum(s >= n for s in saved) / len(saved) for n in toxicity.AT_LEAST] + [sum(s == n for s in saved) / len(saved) for n in toxicity.EXACTLY]
        want += [math.log1p(sum(s >= n for s in saved)) for n in toxicity.COUNTED]
        assert model.features(text) == pytest.approx(want)


def test_toxicity_calibration():
    """The fit is where the gradient of the weighed log loss and its ridge vanishes."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, toxicity.N_FEATURES))
    y = (x[:, 0] - x[:, 3] + rng.normal(size=300) > 0.5).astype(float)
    weight = np.where(y > 0, 0.5, 1.5)
    model = toxicity.ToxicityModel(b"", b"")
    model.calibrate(x, y, weight)
    z = np.column_stack([(x - x.mean(0)) / (x.std(0) + 1e-9), np.ones(300)])
    p = 1 / (1 + np.exp(-z @ model.weights))
    assert np.abs(z.T @ (weight * (y - p)) - 1e-2 * model.weights).max() < 1e-5


def test_toxicity_query(spark, sf):
    found = toxicity.op2_toxicity(spark, sf)
    assert found.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = found.toPandas()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert rows.score.between(0, 1).all() and ((rows.score >= 0.7) == (rows.predicted == 1)).all()


def test_low_frequencies_of_images():
    """The media hash, by the definition of the cosine transform."""
    rng = np.random.default_rng(2)
    for shape in ((24, 24), (48, 72), (24, 200), (130, 24)):
        image = rng.integers(0, 256, shape)
        grid = media.GRID
        cells = np.empty((grid, grid))
        for i in range(grid):
            for j in range(grid):
                rows, columns = (range(k * n // grid, max((k + 1) * n // grid, k * n // grid + 1)) for k, n in ((i, shape[0]), (j, shape[1])))
                cells[i, j] = np.mean([[image[r, c] for c in columns] for r in rows])
        low = [sum(cells[i, j] * math.cos(math.pi * (2 * i + 1) * u / (2 * grid)) * math.cos(math.pi * (2 * j + 1) * v / (2 * grid)) for i in range(grid) for j in range(grid)) for u in range(1, media.LOW + 1) for v in range(1, media.LOW + 1)]
        bits = np.unpackbits(np.frombuffer(media.cosine_hash(image.astype(np.uint8)), np.uint8))
        clear = np.abs(np.array(low) - np.median(low)) > 1e-3
        assert (bits[clear] == (np.array(low) > np.median(low))[clear]).all() and clear.sum() > 50


def plain_sketch(text):
    words = text.lower().split()
    width = min(fingerprint.SHINGLE, len(words))
    hashes = {xxhash.xxh64_intdigest(" ".join(words[i : i + width]), fingerprint.SEED) >> (64 - fingerprint.BITS) for i in range(len(words) - width + 1)} if words else set()
    return {h for h in hashes if h < 2**fingerprint.BITS // fingerprint.SCALE}


def test_edited_fingerprints(spark, sf):
    """All columns of the query, edited texts included."""
    docs = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    docs.sort(reverse=True)
    got = {r["doc_id"]: r for r in fingerprint.op4_fingerprint(spark, sf).collect()}
    digits = lambda hashes: "".join(f"{h:0{fingerprint.DIGITS}x}" for h in sorted(hashes))
    near = lambda a, b: len(a & b) / len(a | b) if a or b else 1.0
    assert len(got) == len(docs)
    for n, (i, text) in enumerate(docs):
        following = docs[(n + 1) % len(docs)][1]
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        if any(not c.isascii() and c.isspace() for c in text + following):
            continue  # words end at ASCII blanks alone, Python's split has others
        own, new = plain_sketch(text), plain_sketch(changed)
        r = got[i]
        assert (r["fingerprint"], r["edited_fingerprint"]) == (digits(own), digits(new))
        assert (r["near_edited"], r["near_next"]) == pytest.approx((near(own, new), near(own, plain_sketch(following))))


def test_near_copies_equal_jaccard_sets(odd, odd_rows):
    """Rows whose five-word shingle sets have a similarity of 0.8 or more have one root, and no others by chains of such."""
    sets = []
    for r in odd_rows:
        words = (r[1] or "").lower().split()
        width = min(5, len(words))
        sets.append(frozenset(" ".join(words[i : i + width]) for i in range(len(words) - width + 1)) if words else frozenset())
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if (a or b) and len(a & b) >= 0.8 * len(a | b):
                root[find(i)] = find(j)
    found = near_copies.near_copies(odd).collect()
    groups: dict = {}
    for r in found:
        groups.setdefault(r["root"], set()).add((r["doc_id"], r["text_hash"]))
    hashes = {t: h for t, h in ((r["text"], r["h"]) for r in odd.selectExpr("text", "xxhash64(text) as h").collect())}
    want: dict = {}
    for i, r in enumerate(odd_rows):
        if sets[i]:
            want.setdefault(find(i), set()).add((r[0], hashes[r[1]]))
    have = {frozenset(g) for g in groups.values()}
    assert {frozenset(g) for g in want.values() if len({h for _, h in g}) > 1} <= have


def test_expected_counts_by_all_segmentations():
    """Expectation maximisation's counts for a word, by summing over its segmentations one by one."""
    pieces, p = ["a", "ab", "b", "▁", "▁a"], np.array([[0.1], [0.3], [0.2], [0.2], [0.3], [1e-6]])
    model = language_id.LanguageModel(pieces, ["x"], p)
    lattice = language_id.Lattice(["abab"], model.automaton, len(pieces))
    found = lattice.expected(p, np.array([[3.0]]))[:, 0]

    def segmentations(rest):
        if not rest:
            yield []
        for k, piece in enumerate(pieces):
            if rest.startswith(piece):
                for more in segmentations(rest[len(piece) :]):
                    yield [k, *more]

    ways = list(segmentations("▁abab"))
    share = np.array([np.prod([p[k, 0] for k in w]) for w in ways])
    want = np.zeros(len(pieces) + 1)
    for w, s in zip(ways, share / share.sum(), strict=True):
        for k in w:
            want[k] += 3 * s
    assert found == pytest.approx(want)
