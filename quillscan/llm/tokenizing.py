"""Exact tokenisation of whole Arrow columns, each distinct text segment going to the library once.

A text is cut at single spaces.  For all three vocabularies a cut there is also a
cut between pre-tokens, so that the ids of a text are the ids of its segments in a
row:

* byte-level BPE: its pattern never joins a non-space character to a following space;
* word BPE: white space is dropped and never inside a pre-token;
* piece BPE: no piece holds a word boundary after another character (checked when
  the model is loaded), so no merge crosses one.

For the first two, a full stop or comma between a letter and a space is cut off too: it
is a pre-token of its own, and words without it are fewer.

Where that argument needs more than one space between solid characters (double
spaces, other white space at a segment's end, marker characters in the text), the
whole text goes to the library instead.  Segments are found by Arrow's dictionary
encoding, thus compared by content, not by hash.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import CACHES, filled, ragged

#: Text bytes encoded at a time.
TOKEN_SLICE = 2_500_000
#: A worker's memo keeps to about so many bytes: beyond, only segments met again stay.
MEMO_BYTES = 80_000_000
#: Joined texts whose encodings, with offsets, are held at a time.
HELD = 16
#: Bytes of a memo entry besides its text: string and number objects, their place in the dictionary, figures, ids.
_ENTRY = 190
_FIRST, _LINE = "\x03", "\x02"
#: White space as the libraries see it; RE2's own class is ASCII only.
_BLANK = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_SOLID = rf"^[\x02\x03]?[^{_BLANK}\x02\x03]+$"
_PIECE = re.compile("[\x02\x03]?[^▁\x02\x03]+", re.S).fullmatch
#: A full stop or comma between a letter and a space is a pre-token of its own (not where the letter's lower case ends in a mark).
_STOP = r"([^\PLİ])([.,]) "


class Encoder:
    """``encode(texts)`` gives flat ids and offsets; ``count(texts)`` gives lengths only."""

    def __init__(self, path: str):
        self.path = path
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path.endswith(".model"):
            import sentencepiece

            self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
            pieces = [self.sp.id_to_piece(i) for i in range(self.sp.vocab_size())]
            plain = [p for i, p in enumerate(pieces) if not (self.sp.is_control(i) or self.sp.is_byte(i) or self.sp.is_unknown(i))]
            #: Holds if no merge can cross a word boundary or a line feed.
            self.cuts = not any("▁" in p.lstrip("▁") or "\n" in p for p in plain)
            self.kind = "piece"
            self.alone = self._alone(plain)
        else:
            import json

            from tokenizers import Tokenizer

            self.tk = Tokenizer.from_file(path)
            with open(path, encoding="utf-8") as f:
                spec = json.load(f)
            self.kind = "byte" if (spec["pre_tokenizer"] or {}).get("type") == "ByteLevel" else "word"
            self.cuts = True
            #: Bytes that each id of the byte vocabulary stands for (one character each in its file).
            self.width = np.zeros(self.tk.get_vocab_size(), np.int64)
            for piece, number in self.tk.get_vocab().items():
                self.width[number] = len(piece)
        self._forget()

    def _forget(self) -> None:
        """Start the memo anew: each segment's number, where its ids lie in one pool, and how often it was met."""
        self.memo: dict[str, int] = {}
        self.counts: dict[str, int] = {}
        self.held = 0
        self.pool, self.used = np.zeros(1 << 16, np.int32), 0
        self.start, self.length, self.hits = (np.zeros(1 << 14, np.int32) for _ in range(3))
        self._add([""], np.zeros(0, np.int32), np.zeros(1, np.int64))

    def _add(self, segs: list[str], ids: np.ndarray, lens: np.ndarray) -> None:
        at, n = len(self.memo), len(segs)
        self.pool = _room(self.pool, self.used + len(ids))
        self.start, self.length, self.hits = (_room(x, at + n) for x in (self.start, self.length, self.hits))
        self.pool[self.used : self.used + len(ids)] = ids
        self.start[at : at + n] = self.used + np.cumsum(lens) - lens
        self.length[at : at + n] = lens
        self.hits[at : at + n] = 0
        self.used += len(ids)
        self.held += _ENTRY * n + sum(map(len, segs))
        self.memo.update(zip(segs, range(at, at + n), strict=True))

    def _shrink(self) -> None:
        """Keep the segments met most often since they came in, at most a third of the memo's bytes."""
        names, hits = list(self.memo), self.hits[: len(self.memo)]
        by = np.argsort(-hits, kind="stable")
        by = by[(hits[by] > 0) & (by > 0)]
        sizes = np.fromiter((len(names[k]) for k in by), np.int64, len(by)) + _ENTRY
        keep = np.sort(by[np.cumsum(sizes) <= MEMO_BYTES // 3])
        lens = self.length[keep].astype(np.int64)
        ids = self.pool[ragged(self.start[keep].astype(np.int64), lens)]
        self._forget()
        self._add([names[k] for k in keep], ids, lens)

    def _alone(self, plain: list[str]) -> frozenset[str]:
        """The whole-token table: words whose boundary-marked form is one piece and encodes as just that piece."""
        names = [p[1:] for p in plain if len(p) > 1 and p[0] == "▁" and "▁" not in p[1:]]
        return frozenset(w for w, ids in zip(names, self.sp.encode(names, num_threads=1), strict=True) if len(ids) == 1)

    # -- the library -------------------------------------------------

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        if self.kind == "piece":
            return [np.asarray(x, dtype=np.int32) for x in self.sp.encode(texts, num_threads=1)]
        return [np.asarray(e.ids, dtype=np.int32) for e in self.tk.encode_batch_fast(texts, add_special_tokens=False)]

    def _segments(self, segs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of regular segments, one after the other, and how many each has."""
        if self.kind == "piece":
            lead = [s[0] == _LINE for s in segs]
            got = self.sp.encode(["\n" + s[1:] if b else s.lstrip(_FIRST) for s, b in zip(segs, lead, strict=True)], num_threads=1)
            got = [x[1:] if b else x for x, b in zip(got, lead, strict=True)]
            return np.asarray([i for x in got for i in x], dtype=np.int32), np.fromiter(map(len, got), np.int64, len(got))
        if self.kind == "byte":  # a row of regular segments is a regular text; a first segment must follow a line feed
            texts = ["\n" + s[1:] if s[0] in (_LINE, _FIRST) else " " + s for s in segs]
        else:
            texts = [s + " " for s in segs]
        group = 200
        joined = ["".join(texts[at : at + group]) for at in range(0, len(texts), group)]
        if self.kind == "byte":  # ids stand for bytes, so their widths tell where each segment ends
            ids = [np.asarray(e.ids, dtype=np.int32) for e in self.tk.encode_batch_fast(joined, add_special_tokens=False)]
            ids = np.concatenate(ids)
            size = pc.binary_length(pa.array(texts, pa.large_string())).to_numpy()
            lens = np.diff(np.searchsorted(np.cumsum(self.width[ids]), np.concatenate(([0], np.cumsum(size))), "right"))
            first = np.fromiter((s[0] == _FIRST for s in segs), bool, len(segs))
            if first.any():  # the line feed before a first segment is not part of it
                keep = np.ones(len(ids), bool)
                keep[(np.cumsum(lens) - lens)[first]] = False
                ids, lens = ids[keep], lens - first
            return ids, lens
        ids, lens = [], []
        encoded = (e for k in range(0, len(joined), HELD) for e in self.tk.encode_batch(joined[k : k + HELD], add_special_tokens=False))
        for at, enc in enumerate(encoded):
            own = np.asarray(enc.ids, dtype=np.int32)
            begins = np.fromiter((o[0] for o in enc.offsets), dtype=np.int64, count=len(own))
            size = np.fromiter(map(len, texts[at * group : (at + 1) * group]), np.int64)
            ids.append(own)
            lens.append(np.diff(np.searchsorted(begins, np.concatenate(([0], np.cumsum(size))))))
        return np.concatenate(ids), np.concatenate(lens)

    def _regular(self, segs: pa.Array) -> np.ndarray:
        """Which segments can be encoded on their own."""
        if self.kind == "word":
            return np.ones(len(segs), bool)
        if self.kind == "byte":
            return np.array(pc.match_substring_regex(segs, _SOLID).to_numpy(zero_copy_only=False), dtype=bool)
        return np.fromiter((self.cuts and bool(_PIECE(s)) for s in segs.to_pylist()), bool, len(segs))

    # -- segments ----------------------------------------------------

    def _known(self, segs: pa.Array) -> np.ndarray:
        """Numbers of the distinct segments in the memo, -1 for an irregular one."""
        if self.held > MEMO_BYTES:
            self._shrink()
        names = segs.to_pylist()
        out = np.fromiter(map(self.memo.get, names, repeat(-2)), np.int64, len(names))
        self.hits[out[out >= 0]] += 1
        missing = np.flatnonzero(out == -2)
        if len(missing):
            regular = self._regular(segs.take(pa.array(missing)))
            out[missing] = -1
            if regular.any():
                missing = missing[regular]
                new, at = [names[k] for k in missing], len(self.memo)
                self._add(new, *self._segments(new))
                out[missing] = np.arange(at, at + len(new))
        if self.kind != "word":
            out[out == 0] = -1  # an empty segment is a doubled space
        return out

    def _split(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """Per segment: its code and, per text, the segment offsets; then the distinct segments."""
        if self.kind == "word":
            marked = pc.replace_substring_regex(pc.replace_substring(texts, "\n", " "), _STOP, r"\1 \2 ")
        else:
            marked = pc.replace_substring(pc.binary_join_element_wise(pa.scalar(_FIRST, pa.large_string()), texts, pa.scalar("", pa.large_string())), "\n", " " + _LINE)
            if self.kind == "byte":
                marked = pc.replace_substring_regex(marked, _STOP, rf"\1 {_FIRST}\2 ")
        lists = pc.split_pattern(marked, " ")
        values = lists.flatten().dictionary_encode()
        if isinstance(values, pa.ChunkedArray):
            values = values.combine_chunks()
        offs = np.asarray(lists.offsets, dtype=np.int64)
        return np.asarray(values.indices), offs - offs[0], values.dictionary

    def _odd(self, texts: pa.Array) -> np.ndarray:
        if self.kind == "word":
            return np.zeros(len(texts), bool)
        hit = pc.or_(pc.match_substring(texts, _LINE), pc.match_substring(texts, _FIRST))
        return np.array(hit.to_numpy(zero_copy_only=False), dtype=bool)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = filled(texts)
        if not len(texts):
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        codes, offs, segs = self._split(texts)
        known = self._known(segs)
        bad = known < 0
        odd = self._odd(texts)
        if bad.any():
            odd |= np.add.reduceat(np.concatenate((bad[codes], [False])), offs[:-1]) > 0
        number = known[codes]
        seg_lens = np.where(number < 0, 0, self.length[number]).astype(np.int64)
        ids = self.pool[ragged(self.start[number].astype(np.int64), seg_lens)]
        ends = np.concatenate(([0], np.cumsum(seg_lens)))[offs]
        if not odd.any():
            return ids, ends
        rows = [ids[ends[k] : ends[k + 1]] for k in range(len(texts))]
        at = np.flatnonzero(odd)
        for k, whole in zip(at, self.whole([texts[int(k)].as_py() for k in at]), strict=True):
            rows[k] = whole
        return np.concatenate(rows), np.concatenate(([0], np.cumsum([len(r) for r in rows])))

    def count(self, texts: pa.Array) -> np.ndarray:
        """Token counts: whole tokens are counted from the table, only other segments are merged."""
        texts = filled(texts)
        if not len(texts):
            return np.zeros(0, np.int64)
        codes, offs, segs = self._split(texts)
        n = np.ones(len(segs), dtype=np.int64)
        names = segs.to_pylist()
        alone = self.alone if self.kind == "piece" else frozenset()
        rest = [k for k, s in enumerate(names) if (s[1:] if s[:1] == _FIRST else s) not in alone]
        n[rest] = self._known_counts([names[k] for k in rest])
        bad = n < 0
        odd = self._odd(texts)
        if bad.any():
            odd |= np.add.reduceat(np.concatenate((bad[codes], [False])), offs[:-1]) > 0
        total = np.concatenate(([0], np.cumsum(n[codes])))
        out = total[offs[1:]] - total[offs[:-1]]
        at = np.flatnonzero(odd)
        if len(at):
            out[at] = [len(x) for x in self.whole([texts[int(k)].as_py() for k in at])]
        return out

    def _known_counts(self, segs: list[str]) -> np.ndarray:
        """Counts of segments, -1 for an irregular one."""
        if self.held > MEMO_BYTES:
            self.counts, self.held = {}, 0
        got = list(map(self.counts.get, segs))
        if None in got:
            missing = [s for s, v in zip(segs, got, strict=True) if v is None]
            fit = self._regular(pa.array(missing, pa.large_string()))
            regular = [s for s, ok in zip(missing, fit, strict=True) if ok]
            if regular:
                self.counts.update(zip(regular, self._segments(regular)[1].tolist(), strict=True))
                self.held += _ENTRY * len(regular) + sum(map(len, regular))
            got = list(map(self.counts.get, segs, repeat(-1)))
        return np.asarray(got, dtype=np.int64)


def _room(values: np.ndarray, n: int) -> np.ndarray:
    """The array with room for ``n`` values."""
    if n <= len(values):
        return values
    out = np.empty(max(n, len(values) * 3 // 2), values.dtype)
    out[: len(values)] = values
    return out


@lru_cache(maxsize=1)
def encoder(path: str, use: str = "ids") -> Encoder:
    """The worker's encoder, kept across tasks of one use."""
    return Encoder(path)


CACHES["tokens"] = [lambda: encoder.cache_clear()]
