"""Personal data: patterns for protected entities, and information-theoretic sanitisation of what reveals them.

Protected entities are e-mail addresses, IPv4 addresses, card numbers and phone
numbers.  A term is a word outside them; it co-occurs with an entity when both stand in
one document.  With document counts over the whole corpus, a term's disclosure is
P(entity | term) and its information log2(P(entity | term) / P(entity)).  Terms that
co-occur with an entity in at least ``SUPPORT`` documents and exceed both thresholds
reveal it and are removed wherever they stand outside an entity.

Corpus counts never need a broadcast that grows: entities and terms are first sifted by
bit tables of fixed size, which only let too much through; exact joins remove the rest.
A pair is left out only where its entity or term stands in too few documents, or its
term beside too many other entities, for the disclosure to be reached.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, column, raw, slices, word_hashes, words, written

KINDS = ("email", "ip", "card", "phone", "term")
SUPPORT = 2
#: Thresholds: P(entity | term) and bits of information about the entity.
DISCLOSURE, BITS = 0.5, 4.0
_BITS = 1 << 24
#: Most counts that a task holds before it sends them.
_HELD = 1 << 20

_LOCAL = re.compile(rb"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(rb"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match can only start at the start of a digit run, so the look-behind and the possessive
# quantifiers change no result; they keep long digit runs linear
_IP = re.compile(rb"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(rb"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(rb"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = np.zeros(256, bool)
_DIGITS[48:58] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def _luhn(digits: bytes) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = (d - 48) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _emails(data: bytes) -> list[tuple[int, int]]:
    """Leftmost, non-overlapping; starts at the whole run of local characters before an @."""
    out, end, at = [], 0, data.find(b"@")
    while at >= 0:
        start = at
        while start > end and _LOCAL.match(data, start - 1):
            start -= 1
        if start < at and (m := _DOMAIN.match(data, at + 1)):
            out.append((start, m.end()))
            end = m.end()
        else:
            end = max(end, at + 1)
        at = data.find(b"@", max(at + 1, end))
    return out


def _digits_of(data: bytes) -> bytes:
    return bytes(c for c in data if 48 <= c < 58)


def base_spans(data: bytes) -> list[tuple[int, int, int]]:
    """(start, kind number, end) in bytes, in order of start, then kind."""
    out = [(s, 0, e) for s, e in _emails(data)] if b"@" in data else []
    for m in _IP.finditer(data):
        if all(len(p.lstrip(b"0")) <= 3 and int(p.lstrip(b"0") or b"0") <= 255 for p in m[0].split(b".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(data):
        if m.end() - m.start() <= 37 and 14 <= len(d := _digits_of(m[0])) <= 19 and _luhn(d):
            out.append((m.start(), 2, m.end()))
    if b"+" in data:
        for m in _PHONE.finditer(data):
            if 10 <= len(_digits_of(m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def _texts(part: pa.RecordBatch) -> Iterator[tuple[int, bytes, list[tuple[int, int, int]]]]:
    """Texts of a slice that can hold an entity, with their base spans."""
    buf, offs = raw(column(part, "text"))
    digits = np.concatenate(([0], np.cumsum(_DIGITS[buf])))[offs]
    signs = np.concatenate(([0], np.cumsum(buf == 64)))[offs]
    data = buf.tobytes()
    for k in np.flatnonzero((np.diff(digits) >= 4) | (np.diff(signs) > 0)):
        text = data[offs[k] : offs[k + 1]]
        if spans := base_spans(text):
            yield int(k), text, spans


def _terms(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[tuple[int, list[int]]]]:
    """Start, end, hash and text number of each term, and the entities of each text that has some.

    Terms are words without their outer punctuation that do not touch a base span.
    """
    buf, offs = raw(column(part, "text"))
    edge = np.zeros(len(buf) + 1, np.int64)
    entities = []
    for k, text, spans in _texts(part):
        for s, _, e in spans:
            edge[offs[k] + s] += 1
            edge[offs[k] + e] -= 1
        entities.append((k, sorted({_key(KINDS[kind].encode() + b":" + text[s:e].lower()) for s, kind, e in spans})))
    inside = np.concatenate(([0], np.cumsum(np.cumsum(edge[:-1]) > 0)))
    starts, ends, first = words(buf, offs)
    text = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    starts, ends = _bare(buf, starts, ends)
    ok = (ends > starts) & (inside[ends] == inside[starts])
    starts, ends, text = starts[ok], ends[ok], text[ok]
    return starts, ends, word_hashes(buf, starts, ends, lower=True).view(np.int64), text, entities


def _bare(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words without any punctuation at their ends; those of nothing else become empty."""
    starts, ends = starts.copy(), ends.copy()
    for _ in range(3):  # most words have little
        starts += (starts < ends) & _PUNCT[buf[np.minimum(starts, len(buf) - 1)]]
        ends -= (starts < ends) & _PUNCT[buf[np.maximum(ends - 1, 0)]]
    more = np.flatnonzero((starts < ends) & (_PUNCT[buf[np.minimum(starts, len(buf) - 1)]] | _PUNCT[buf[np.maximum(ends - 1, 0)]]))
    if len(more):
        solid = np.flatnonzero(~_PUNCT[buf])
        first = np.searchsorted(solid, starts[more])
        last = np.searchsorted(solid, ends[more]) - 1
        some = last >= first
        starts[more] = np.where(some, np.append(solid, 0)[np.minimum(first, len(solid))], ends[more])
        ends[more] = np.where(some, np.append(solid, 0)[last] + 1, ends[more])
    return starts, ends


def _key(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


class _Tally:
    """Counts by key, merged over a task's slices before they travel."""

    def __init__(self, *names: str):
        self.names = names
        self.parts: list[list[np.ndarray]] = []
        self.rows, self.merged = 0, 0

    def count(self, *keys: np.ndarray) -> None:
        self.parts.append([*keys, np.ones(len(keys[0]), np.int64)])
        self.rows += len(keys[0])
        if self.rows > 2 * self.merged + _HELD // 4:
            self._merge()

    def add(self, *keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.count(*keys)
        if self.merged > _HELD:
            yield from self.out()

    def reset(self) -> None:
        self.parts, self.rows, self.merged = [], 0, 0

    def arrays(self) -> list[np.ndarray]:
        """Keys in order and their counts."""
        if self.parts:
            self._merge()
            return self.parts[0]
        return [np.zeros(0, np.int64) for _ in (*self.names, "n")]

    def _merge(self) -> None:
        *keys, n = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        order = np.lexsort(keys)
        keys, n = [k[order] for k in keys], n[order]
        first = np.flatnonzero(np.concatenate(([True], np.any([k[1:] != k[:-1] for k in keys], axis=0)))) if len(n) else np.zeros(0, np.int64)
        self.parts = [[*(k[first] for k in keys), np.add.reduceat(n, first) if len(n) else n]]
        self.rows = self.merged = len(first)

    def out(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            self._merge()
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in self.parts[0]], names=[*self.names, "n"])
        self.reset()


def _joined(beside: _Tally, around: _Tally) -> pa.RecordBatch:
    """Each term of ``beside`` with its count and the greater of both counts; both tallies start anew."""
    term, n = beside.arrays()
    other, m = around.arrays()
    at = np.minimum(np.searchsorted(other, term), max(len(other) - 1, 0))
    most = np.where(other[at] == term, np.maximum(m[at], n), n) if len(other) else n
    beside.reset()
    around.reset()
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (term, n, most)], names=["term", "n", "m"])


def _entities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each entity."""
    tally = _Tally("entity")
    for part in slices(batches, "text"):
        found: list[int] = []
        for _, text, spans in _texts(part):
            found.extend({_key(KINDS[kind].encode() + b":" + text[s:e].lower()) for s, kind, e in spans})
        yield from tally.add(np.asarray(found, np.int64))
    yield from tally.out()


def _distinct(h: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Each hash once per text."""
    order = np.lexsort((text, h))
    h, text = h[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return h[new]


def _sift_of(terms: DataFrame) -> np.ndarray:
    """A bit table of fixed size in which every term of ``terms`` sets two bits."""
    place = terms.select(F.explode(F.array(F.pmod("term", F.lit(_BITS)), F.pmod(F.shiftright("term", 24), F.lit(_BITS)))).alias("p"))
    held = place.selectExpr("p div 64 AS w", "shiftleft(1L, cast(p % 64 AS int)) AS b").groupBy("w").agg(F.bit_or("b").alias("b"))
    got = held.toArrow()  # at most _BITS / 64 rows
    bits = np.zeros(_BITS // 64, np.int64)
    bits[got["w"].to_numpy()] = got["b"].to_numpy()
    return bits.view(np.uint8)


def _passes(sift: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Terms whose two bits are set: all that were put in, and few others."""
    ok = np.ones(len(h), bool)
    for p in (h % _BITS, (h >> 24) % _BITS):
        ok &= (sift.take(p >> 3) >> (p & 7).astype(np.uint8) & 1).astype(bool)
    return ok


def disclosing_terms(rows: DataFrame) -> DataFrame:
    """``term`` (a hash) of every term whose disclosure exceeds the thresholds, from counts over all of ``rows``.

    A pair whose share of the documents that are sure to hold its term is too small
    already is no candidate; only the terms that are left are counted over all documents.
    """
    spark = rows.sparkSession
    total = rows.count()
    # P(entity | term) is at most 1, so an entity of more documents cannot give BITS
    entities = rows.mapInArrow(_entities, "entity long, n long").groupBy("entity").agg(F.sum("n").alias("n_entity"))
    entities = written(entities.filter((F.col("n_entity") >= SUPPORT) & (F.col("n_entity") * 2.0**BITS <= total)), "entities")
    known = spark.sparkContext.broadcast(_sift_of(entities.select(F.col("entity").alias("term"))))

    def of_interest(h: np.ndarray, text: np.ndarray, found: list[tuple[int, list[int]]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The entities that may matter and the distinct terms of each text that has such an entity."""
        for k, keys in found:
            who = np.asarray(keys, np.int64)
            who = who[_passes(known.value, who)]
            if len(who):
                yield who, np.unique(h[np.searchsorted(text, k) : np.searchsorted(text, k, "right")])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Terms beside entities, with the documents that are sure to hold them: such ones, or all that the task has counted lately."""
        beside, around = _Tally("term"), _Tally("term")
        for part in slices(batches, "text"):
            _, _, h, text, found = _terms(part)
            around.count(_distinct(h, text))
            if around.merged > _HELD:
                around.reset()
            for _, terms in of_interest(h, text, found):
                beside.count(terms)
            if beside.merged > _HELD:
                yield _joined(beside, around)
        yield _joined(beside, around)

    beside = rows.mapInArrow(near, "term long, n long, m long").groupBy("term").agg(F.sum("n").alias("n_beside"), F.sum("m").alias("n_least"))
    beside = written(beside.filter(F.col("n_beside") >= SUPPORT), "beside")
    sift = spark.sparkContext.broadcast(_sift_of(beside))

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = _Tally("entity", "term")
        for part in slices(batches, "text"):
            _, _, h, text, found = _terms(part)
            for who, terms in of_interest(h, text, found):
                terms = terms[_passes(sift.value, terms)]
                for w in who:
                    yield from tally.add(np.full(len(terms), w), terms)
        yield from tally.out()

    pairs = rows.mapInArrow(contexts, "entity long, term long, n long").groupBy("entity", "term").agg(F.sum("n").alias("n")).filter(F.col("n") >= SUPPORT)
    pairs = written(pairs.join(beside, "term").filter(F.col("n") >= F.col("n_least") * DISCLOSURE).join(entities, "entity").select("entity", "term", "n", "n_entity"), "pairs")
    wanted = spark.sparkContext.broadcast(_sift_of(pairs.select("term").distinct()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = _Tally("term")
        for part in slices(batches, "text"):
            _, _, h, text, _ = _terms(part)
            hit = _passes(wanted.value, h)
            yield from tally.add(_distinct(h[hit], text[hit]))
        yield from tally.out()

    everywhere = rows.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n_term"))
    share = F.col("n") / F.col("n_term")
    found = pairs.join(everywhere, "term").filter((share >= DISCLOSURE) & (F.log2(share * F.lit(float(total)) / F.col("n_entity")) >= BITS))
    return written(found.select("term").distinct(), "terms")


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` of every row of ``docs``.

    Offsets are code points, ends exclusive; ``spans`` lists base and term spans by start,
    then kind.  Null text: empty.  Repeated rows each give their row; null ids stay null.
    Text is scanned seven times and never shuffled.  Other columns are never read.
    """
    spark = docs.sparkSession
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    terms = disclosing_terms(rows.select("text"))
    sift = spark.sparkContext.broadcast(_sift_of(terms))

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            buf, offs = raw(column(part, "text"))
            if not len(buf):
                continue
            starts, ends, h, text, _ = _terms(part)
            hit = _passes(sift.value, h)
            starts, ends, h, text = starts[hit], ends[hit], h[hit], text[hit]
            points = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))
            zero = points[offs[:-1]][text]
            yield pa.RecordBatch.from_arrays(
                [column(part, "doc_id").take(pa.array(text)), column(part, "mark").take(pa.array(text)), pa.array(h), pa.array(points[starts] - zero), pa.array(points[ends] - zero)],
                names=["doc_id", "mark", "term", "s", "e"],
            )

    def base(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            n = part.num_rows
            counts = np.zeros((n, 4), np.int64)
            spans: list[str] = [""] * n
            for k, text, found in _texts(part):
                points = np.concatenate(([0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)))
                for _, kind, _ in found:
                    counts[k, kind] += 1
                spans[k] = ",".join(f"{KINDS[kind]}:{points[s]}:{points[e]}" for s, kind, e in found)
            yield pa.RecordBatch.from_arrays([column(part, "doc_id"), column(part, "mark"), *(pa.array(counts[:, j]) for j in range(4)), pa.array(spans, pa.string())], names=["doc_id", "mark", "n_email", "n_ip", "n_card", "n_phone", "base"])

    marked = rows.withColumn("mark", F.xxhash64("text"))
    added = marked.mapInArrow(occurrences, "doc_id long, mark long, term long, s long, e long").join(terms, "term").groupBy("doc_id", "mark").agg(F.collect_set(F.struct("s", "e")).alias("more"))
    plain = marked.mapInArrow(base, "doc_id long, mark long, n_email long, n_ip long, n_card long, n_phone long, base string")
    both = plain.alias("p").join(added.alias("a"), F.expr("p.doc_id <=> a.doc_id AND p.mark = a.mark"), "left").select("p.*", "a.more")
    parts = F.when(F.col("base") != "", F.split("base", ",")).otherwise(F.array().cast("array<string>"))
    order = F.array(*(F.lit(k) for k in KINDS))
    as_struct = F.transform(parts, lambda x: F.struct(F.split_part(x, F.lit(":"), F.lit(2)).cast("long").alias("s"), F.array_position(order, F.split_part(x, F.lit(":"), F.lit(1))).alias("k"), x.alias("x")))
    as_more = F.transform(F.coalesce("more", F.expr("cast(array() as array<struct<s:long,e:long>>)")), lambda m: F.struct(m["s"].alias("s"), F.lit(5).cast("long").alias("k"), F.concat(F.lit("term:"), m["s"].cast("string"), F.lit(":"), m["e"].cast("string")).alias("x")))
    everything = F.array_join(F.transform(F.array_sort(F.concat(as_struct, as_more)), lambda x: x["x"]), ",")
    return both.select("doc_id", "mark", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), everything.alias("spans"))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with entities generalised to ``[KIND]`` and disclosing terms removed (``[TERM]``); all other columns stay.

    Overlapping spans are replaced as one, named after the first.  Rows without any span are unchanged.
    """
    spans = find_personal_data(docs, id_col, text_col).filter("spans <> ''").select(F.col("doc_id").alias("_pii_id"), F.col("mark").alias("_pii_mark"), F.col("spans").alias("_pii_spans")).distinct()
    names = docs.columns
    base = docs.select(F.struct(*(docs[c] for c in names)).alias("_row"), docs[id_col].cast("long").alias("_id"), F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit(""))).alias("_mark"))
    joined = base.join(spans, F.expr("_id <=> _pii_id AND _mark = _pii_mark"), "left").select("_row", F.col("_row")[text_col].alias("text"), "_pii_spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            texts, spans_ = column(part, "text").to_pylist(), column(part, "_pii_spans").to_pylist()
            yield pa.RecordBatch.from_arrays([column(part, "_row"), pa.array([redact(t, s) if s else t for t, s in zip(texts, spans_, strict=True)], pa.string())], names=["_row", "text"])

    from pyspark.sql.types import StringType, StructField, StructType

    out = joined.mapInArrow(run, StructType([joined.schema["_row"], StructField("text", StringType())]))
    return out.select(*(F.col("text").alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in names))


def redact(text: str, spans: str) -> str:
    out, at = [], 0
    for x in spans.split(","):
        kind, s, e = x.split(":")
        s, e = int(s), int(e)
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join(out) + text[at:]
