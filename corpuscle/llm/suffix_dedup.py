"""Suffix-array deduplication: what a string of ``length`` symbols covers that also starts anywhere else goes.

A ``Rule`` names the symbols, bytes or words (runs of bytes other than \\x20 and \\x09-\\x0D), and the length. ``BYTES`` is the digest
contract's rule, 400 bytes; ``PASSAGES``, the pipeline's, is 51 words, as a passage of over 50 words is of 51 at least, however long they are.

Sorting all suffixes of a corpus is more than is needed, as a window of ``length`` symbols repeats only where its anchor's string does (see
``anchors``). So the work narrows without losing a window:

1. Every document gives its anchors: windows that share one, hash of its string, hash of all symbols those windows span. Kept as a table, of
   which only rows whose anchor string occurs again are looked at further.
2. Anchors of equal string, windows and span are one class; two hashes of 64 bits tell classes apart. A class met twice repeats whole. A class
   met once whose anchor string no other class has doesn't repeat at all. Left are single classes that share an anchor string with others.
3. The spans of those, and of the classes they may repeat, go to shards by anchor string, once a class. Equal windows stand at equal offsets
   from their anchor, so windows whose offset lies in one step of ``length // 8`` share a *core* of at least 7/8 of a window: what has a core
   of its own doesn't repeat. An anchor string of over MOST_KINDS classes (a line in a third of all documents) is dealt out by cores; the
   windows of a core that over MOST_KINDS classes have (a passage in as many) are counted by their hashes, one by one, and not sorted.
4. A shard is one text whose suffixes are put in order by external induced sorting (``induced_sort``): tuples of place and common prefix wait
   in queues that go to disk, and neighbours with ``length`` symbols in common are the windows that repeat.
5. Windows found, and those of classes met twice, become spans of their documents; what they cover is cut.

Documents are told apart by doc_id and text, so copies of a document share one result and count as different places. Nulls: a null text is
empty; a null doc_id is a value like others. Texts shorter than a window lose nothing. Repeated rows lose all of a text of a window's length
or more. Matches never cross documents. An empty table gives none. Extra columns stay, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.llm import induced_sort
from corpuscle.llm.anchors import anchors
from corpuscle.llm.tables import bound_batches, free_name, keep, load, map_slices, scratch, small_batches

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


@dataclass(frozen=True)
class Rule:
    """Symbols, symbols of a window, symbols of an anchor's string."""

    words: bool
    length: int
    gram: int

    def symbols(self, data: bytes) -> np.ndarray:
        """Bytes, or a 64-bit hash of each word."""
        if not self.words:
            return np.frombuffer(data, np.uint8)
        words = data.split()  # at the same bytes as WORD
        return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))

    @property
    def dtype(self) -> type:
        return np.uint64 if self.words else np.uint8


BYTES = Rule(False, 400, 64)
PASSAGES = Rule(True, 51, 8)
SHARD_SYMBOLS = 1 << 20
#: Classes of one anchor string beyond which it is dealt out by cores, and of one core beyond which its windows are counted.
MOST_KINDS = 2048

ANCHORS = "rule int, doc_id long, text_hash long, lead int, first int, last int, anchor long, span long"
_ANCHORS = pa.schema([(n, {"int": pa.int32(), "long": pa.int64()}[t]) for n, t in (x.split() for x in ANCHORS.split(", "))])


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def keyed(docs: DataFrame) -> DataFrame:
    """The key of every document, its doc_id and a hash of its text, and its text."""
    bound_batches(docs.sparkSession)
    text = docs["text"].cast("string")
    return docs.select(docs["doc_id"].cast("long").alias("key_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("key_hash"), text.alias("key_text"))


def anchor_table(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """The anchors of every document under every rule, with ``class``, a hash of windows and span; a rule's anchors have hashes of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in small_batches(batch):
                columns: list[list[np.ndarray]] = [[] for _ in _ANCHORS]
                for doc_id, text_hash, text in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                    data = _bytes(text)
                    for n, rule in enumerate(rules):
                        symbols = rule.symbols(data)
                        raw, step = (data, 1) if not rule.words else (symbols.tobytes(), 8)
                        place, first, last, h = anchors(symbols, rule.length, rule.gram)
                        if len(place):
                            span = np.array([xxhash.xxh64_intdigest(raw[a:b]) for a, b in zip((first * step).tolist(), ((last + rule.length) * step).tolist(), strict=True)], np.uint64)
                            ids = pa.nulls(len(place), pa.int64()) if doc_id is None else pa.array(np.full(len(place), doc_id))
                            found = (np.full(len(place), n), ids, np.full(len(place), text_hash), place - first, first, last, h.view(np.int64) ^ n, span.view(np.int64))
                            for column, values in zip(columns, found, strict=True):
                                column.append(values)
                if columns[0]:
                    arrays = [pa.concat_arrays(c) if f.name == "doc_id" else pa.array(np.concatenate(c), f.type, safe=False) for c, f in zip(columns, _ANCHORS, strict=True)]
                    yield pa.RecordBatch.from_arrays(arrays, schema=_ANCHORS)

    found = keyed(docs).mapInArrow(run, ANCHORS)
    return found.select("rule", "doc_id", "text_hash", "lead", "first", "last", "anchor", F.xxhash64("lead", F.col("last") - F.col("first"), "span").alias("class"))


def repeated_windows(strings: list[np.ndarray], length: int = BYTES.length) -> list[np.ndarray]:
    """For each string of symbols, which of its windows of ``length`` occur elsewhere in it or another one.

    Words are written as digits, a byte each, so that the sorter's alphabet stays small; each place of a digit has an alphabet of its own, so
    that no suffix which begins within a word is like one that begins with a word.
    """
    if not strings:
        return []
    joined, digits = np.concatenate(strings), 1
    if joined.dtype != np.uint8:
        joined = np.unique(joined, return_inverse=True)[1].astype(np.int64)
        digits = max((int(joined.max()).bit_length() + 7) // 8, 1)
        joined = ((joined[:, None] >> (8 * np.arange(digits)[::-1])) & 255) + 256 * np.arange(digits)
    sizes = np.array([len(s) for s in strings]) * digits
    text = np.ones(sizes.sum() + len(strings) + 1, np.int32)  # 1 behind each string, 0 at the end
    text[-1] = 0
    text[:-1][np.arange(sizes.sum()) + np.repeat(np.arange(len(strings)), sizes)] = joined.ravel().astype(np.int32) + 2
    starts = np.cumsum(sizes + 1) - sizes - 1
    repeated, before = np.zeros(len(text), bool), -1
    for place, common in induced_sort.suffixes(text, length * digits):
        long = np.flatnonzero(common >= length * digits)
        repeated[place[long]] = True
        repeated[np.where(long > 0, place[long - 1], before)] = True
        before = place[-1]
    return [repeated[a : a + n : digits][: n // digits - length + 1] for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)]


def runs(marks: np.ndarray) -> np.ndarray:
    """[start, end) of each run of true ``marks``."""
    return np.flatnonzero(np.diff(np.concatenate(([0], marks.astype(np.int8), [0])))).reshape(-1, 2)


def cores(rule: Rule, lead: int, raw: bytes) -> Iterator[tuple[int, int, int]]:
    """(core, first window, last window) of a span whose anchor lies at ``lead``; windows of equal step and core may be equal, others are not."""
    size, step = np.dtype(rule.dtype).itemsize, max(rule.length // 8, 1)
    windows = len(raw) // size - rule.length + 1
    for k in range(max(lead - windows + 1, 0) // step, lead // step + 1):
        at = lead - k * step
        core = xxhash.xxh64_intdigest(raw[at * size : (at - step + 1 + rule.length) * size], seed=k)
        yield core, max(at - step + 1, 0), min(at, windows - 1)


SPANS = "rule int, anchor long, part long, class long, at int, lead int, symbols binary"
WINDOWS = "anchor long, place int, one long, other long, class long, from int"
_TYPES = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}


def _of_texts(rules: tuple[Rule, ...], schema: str, made):
    """Rows of ``schema`` that ``made(rule, wanted, symbols)`` gives for each wanted struct of each text."""
    fields = [x.split() for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in small_batches(batch):
                rows: list[tuple] = []
                for text, wanted in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    data = _bytes(text)
                    symbols = {n: rules[n].symbols(data) for n in {w["rule"] for w in wanted}}
                    for w in wanted:
                        rows += made(rules[w["rule"]], w, symbols[w["rule"]])
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], _TYPES[t]) for i, (_, t) in enumerate(fields)], names=[n for n, _ in fields])

    return run


def _spans(rule: Rule, w: dict, symbols: np.ndarray) -> list[tuple]:
    """The symbols of a span; of a hot anchor, those of the windows that share a core, core by core."""
    raw = symbols[w["first"] : w["last"] + rule.length].tobytes()
    if not w["hot"]:
        return [(w["rule"], w["anchor"], 0, w["class"], 0, w["lead"], raw)]
    size = np.dtype(rule.dtype).itemsize
    return [(w["rule"], w["anchor"], core >> 1 or 1, w["class"], a, w["lead"] - a, raw[a * size : (b + rule.length) * size]) for core, a, b in cores(rule, w["lead"], raw)]


def _asked(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """key_text, wanted: each text with its rows of ``wanted`` (doc_id, text_hash and others) as structs."""
    others = [c for c in wanted.columns if c not in ("doc_id", "text_hash")]
    lists = wanted.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct(*others)).alias("wanted"))
    texts = keyed(docs)
    return texts.join(lists, texts["key_id"].eqNullSafe(lists["doc_id"]) & (texts["key_hash"] == lists["text_hash"])).select("key_text", "wanted")


def _windows_of(rules: tuple[Rule, ...]):
    """Two hashes of each window of spans, and its place, counted from the anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in small_batches(batch):
                rows: list[tuple] = []
                for n, anchor, _, class_, at, lead, raw in zip(*(part.column(i).to_pylist() for i in range(7)), strict=True):
                    size, length = np.dtype(rules[n].dtype).itemsize, rules[n].length
                    windows = [raw[i * size : (i + length) * size] for i in range(len(raw) // size - length + 1)]
                    one, other = (np.array([h(x) for x in windows], np.uint64).view(np.int64).tolist() for h in (xxhash.xxh64_intdigest, xxhash.xxh3_64_intdigest))
                    rows += [(anchor, lead - i, one[i], other[i], class_, at + i) for i in range(len(windows))]
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=[x.split()[0] for x in WINDOWS.split(", ")])

    return run


def counted_windows(spans: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """anchor, class, from, to: windows of ``spans`` that another class has at the same place from the anchor. Equal windows are counted by
    their hashes, partly before the shuffle: a passage that a third of all texts have is one count a task."""
    rows = keep(spans.mapInArrow(_windows_of(rules), WINDOWS).distinct(), "windows")
    key = ["anchor", "place", "one", "other"]
    again = keep(rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*key), "counted")
    return rows.join(again, key, "left_semi").select("anchor", "class", "from", (F.col("from") + 1).alias("to"))


def narrowed(spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is to be sorted of ``spans``, and what is to be counted: of hot anchors' parts, those that over MOST_KINDS classes share. A part
    that one class alone has is neither."""
    kinds = spans.where("part <> 0").select("anchor", "part", "class").distinct().groupBy("anchor", "part").agg(F.count("*").alias("kinds"))
    shared = keep(kinds.where("kinds > 1").select("anchor", "part", (F.col("kinds") > MOST_KINDS).alias("many")), "shared")
    of = lambda which: spans.where("part <> 0").join(shared.where(which), ["anchor", "part"], "left_semi").select(spans.columns)
    return spans.where("part = 0").unionByName(of("not many")), of("many")


def contested_parts(rule: Rule, group: list[tuple]) -> Iterator[tuple[int, int, np.ndarray]]:
    """Of a group of spans (class, at, lead, raw) of one anchor string: (class, first window, symbols) of runs of windows with a core that another has."""
    found = [list(cores(rule, lead, raw)) for _, _, lead, raw in group]
    often: dict[int, int] = {}
    for parts in found:
        for core, _, _ in parts:
            often[core] = often.get(core, 0) + 1
    for (class_, at, _, raw), parts in zip(group, found, strict=True):
        shared = sorted((a, b) for core, a, b in parts if often[core] > 1)
        symbols = np.frombuffer(raw, rule.dtype)
        while shared:
            a, b = shared.pop(0)
            while shared and shared[0][0] <= b + 1:
                b = shared.pop(0)[1]
            yield class_, at + a, symbols[a : b + rule.length]


def _sorted_shards(rules: tuple[Rule, ...]):
    """Windows that repeat within the shards of a partition sorted by rule, anchor, part and class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list[tuple[int, int, int]] = []
        strings: list[np.ndarray] = []
        group: list[tuple] = []
        last, held = None, 0

        def found(rule: Rule) -> pa.RecordBatch:
            rows = [(anchor, c, at + a, at + b) for (anchor, c, at), marks in zip(names, repeated_windows(strings, rule.length), strict=True) for a, b in runs(marks).tolist()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["anchor", "class", "from", "to"])

        def close() -> int:
            """Put what is contested of the group before into the shard."""
            size = 0
            if last and len(group) > 1:
                for class_, at, symbols in contested_parts(rules[last[0]], group):
                    names.append((last[1], class_, at))
                    strings.append(symbols)
                    size += len(symbols)
            group.clear()
            return size

        for batch in batches:
            for part in small_batches(batch):
                for rule, anchor, core, class_, at, lead, raw in zip(*(part.column(i).to_pylist() for i in range(7)), strict=True):
                    if (rule, anchor, core) != last:
                        held += close()
                        if last and (held >= SHARD_SYMBOLS or rule != last[0]):
                            yield found(rules[last[0]])
                            names, strings, held = [], [], 0
                        last = rule, anchor, core
                    if not group or group[-1][:2] != (class_, at):  # else another row of the same document and text
                        group.append((class_, at, lead, raw))
        close()
        yield found(rules[last[0]] if last else rules[0])

    return run


def repeated_spans(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """rule, doc_id, text_hash, start, end: symbols of ``docs`` that repeated windows cover; spans may overlap and recur."""
    length = F.element_at(F.array(*[F.lit(r.length) for r in rules]), F.col("rule") + 1)
    table = keep(anchor_table(docs, rules), "anchors")
    again = keep(table.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "repeated")  # a table, so that a hot anchor's rows can be split in the join
    table = keep(table.join(again, "anchor", "left_semi"), "again")
    place = [F.first(c).alias(c) for c in ("rule", "doc_id", "text_hash", "lead", "first", "last")]  # of one row, whichever comes first: any will do
    classes = table.groupBy("anchor", "class").agg(F.count("*").alias("n"), *place)
    groups = classes.groupBy("anchor").agg(F.count("*").alias("kinds"), F.min("n").alias("least"))
    contested = (F.col("kinds") > 1) & (F.col("least") == 1)
    known = classes.join(groups, "anchor").where((F.col("n") > 1) | contested)
    known = keep(known.select("rule", "anchor", "class", "n", "doc_id", "text_hash", "lead", "first", "last", contested.alias("contested"), (F.col("kinds") > MOST_KINDS).alias("hot")), "classes")

    wanted = known.where("contested").select("rule", "anchor", "class", "lead", "first", "last", "hot", "doc_id", "text_hash")
    spans, counted = _asked(docs, wanted).mapInArrow(_of_texts(rules, SPANS, _spans), SPANS), None
    if not known.where("contested and hot").isEmpty():
        spans, many = narrowed(keep(spans, "parts"))
        counted = counted_windows(many, rules)
    strings = spans.repartition("anchor", "part").sortWithinPartitions("rule", "anchor", "part", "class", "at")
    windows = strings.mapInArrow(_sorted_shards(rules), "anchor long, class long, from int, to int")
    windows = windows if counted is None else windows.unionByName(counted).distinct()

    end = lambda c: (F.col(c) + length).alias("end")
    single = known.where("n = 1").join(windows, ["anchor", "class"]).withColumns({"start": F.col("first") + F.col("from"), "stop": F.col("first") + F.col("to") - 1}).select("rule", "doc_id", "text_hash", "start", end("stop"))
    twice = table.join(known.where("n > 1").select("anchor", "class"), ["anchor", "class"], "left_semi").select("rule", "doc_id", "text_hash", F.col("first").alias("start"), end("last"))
    return twice.unionByName(single)


def with_spans(docs: DataFrame, rules: tuple[Rule, ...], name: str = "spans") -> DataFrame:
    """``docs`` with the column ``name``, an array of structs (rule, start, end), null where nothing repeats."""
    with scratch(docs.sparkSession):
        spans = repeated_spans(docs, rules).groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("rule", "start", "end")).alias("found"))
        spans = keep(spans.withColumnsRenamed({"doc_id": "span_id", "text_hash": "span_hash"}), "spans", outer=True)
    id_, hash_ = (free_name(docs.columns, c) for c in ("key_id", "key_hash"))
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    own = docs.withColumns({id_: docs["doc_id"].cast("long"), hash_: F.xxhash64(text)})
    return own.join(spans, own[id_].eqNullSafe(spans["span_id"]) & (own[hash_] == spans["span_hash"]), "left").select(*[own[c] for c in docs.columns], spans["found"].alias(name))


def covered(n: int, spans: list[dict] | None, rule: int = 0) -> np.ndarray:
    """Which of ``n`` symbols the spans of a rule, by its number, cover."""
    steps = np.zeros(n + 1, np.int64)
    if spans:
        np.add.at(steps, [s["start"] for s in spans if s["rule"] == rule], 1)
        np.add.at(steps, [s["end"] for s in spans if s["rule"] == rule], -1)
    return np.cumsum(steps)[:n] > 0


def cut_text(text: str | None, spans: list[dict] | None, rule: Rule, number: int = 0) -> str | None:
    """``text`` without the characters all of whose bytes are covered, or without the runs of words that are."""
    if text is None or not any(s["rule"] == number for s in spans or ()):
        return text
    data = _bytes(text)
    if rule.words:
        places = [m.span() for m in WORD.finditer(data)]
        kept, at = [], 0
        for a, b in runs(covered(len(places), spans, number)).tolist():
            kept.append(data[at : places[a][0]])
            at = places[b - 1][1]
        return b"".join([*kept, data[at:]]).decode("utf-8", "surrogatepass")
    symbols = np.frombuffer(data, np.uint8)
    gone = covered(len(data), spans, number)
    letter = np.cumsum((symbols & 0xC0) != 0x80) - 1
    whole = np.bincount(letter, weights=~gone) == 0
    return symbols[~whole[letter]].tobytes().decode("utf-8", "surrogatepass")


def deduplicated(docs: DataFrame, rule: Rule = BYTES) -> DataFrame:
    """``docs`` with their texts cut to what doesn't repeat, in whole characters or words; other columns and all rows stay."""
    spanned = with_spans(docs, (rule,), free_name(docs.columns, "spans"))
    names = docs.columns
    text, spans = names.index("text"), len(names)

    def cut(rows: pa.RecordBatch) -> dict:
        new = [cut_text(t, s, rule) for t, s in zip(rows.column(text).to_pylist(), rows.column(spans).to_pylist(), strict=True)]
        return {name: new if i == text else rows.column(i) for i, name in enumerate(names)}

    return map_slices(spanned, docs.schema, cut)


DIGESTS = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string"


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digests of what the rule ``BYTES`` removes, and in ``text`` the whole characters that it leaves of the document."""
    docs = load(spark, sf_dir, "documents")
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in small_batches(batch):
                rows = []
                for doc_id, text, spans in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                    data = np.frombuffer(_bytes(text), np.uint8)
                    gone = covered(len(data), spans)
                    rows.append((doc_id, len(data), int(gone.sum()), len(runs(gone)), hashlib.sha256(data[~gone].tobytes()).hexdigest(), cut_text(text, spans, BYTES)))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=[x.split()[0] for x in DIGESTS.split(", ")])

    return with_spans(docs.select("doc_id", "text"), (BYTES,)).mapInArrow(run, DIGESTS)
