"""Evaluation texts leaking into documents: a prefix-filtered set join with positional verification.

Words are compared without case, punctuation, markup and line setting; documents are parted into words once, and the
words are kept as 64-bit hashes in a written table that every later pass reads. A passage of n words of an item with at
most n // 4 of them replaced, added or dropped keeps at least n - n // 4 of its words; so if the words of each item window
of that length are put in the order of their rarity in the corpus, one of the first n // 4 + 1 must be in the document.
Only those prefix words are joined. Around each hit enough of the item's words must lie within reach of their places
(length and positional bounds), and what is left is verified exactly by edit distance.

Windows are sized by the passage: 16 words and all longer lengths that can hold a passage of which no 16 words would do
alone (five words changed in the middle of twenty). A passage of twice the least length has a half that is one itself,
and lengths between multiples of four allow no more changes than the multiple below them, so 16, 20, 24 and 28 are all.

Shingles are of one word here: with every fourth word changed no run of five words need survive.

Items that share the frame of their sentences differ just in few words, and a text made from one may hold enough words of
the others. So a passage of an item is dropped where another item keeps a strictly greater share of its words in the same
stretch; items that keep as much are both reported. This is settled over all items of a document, in whatever blocks they
were searched.
"""

from __future__ import annotations

import functools
import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, release, spread

#: Words of the passage that has to be found, and the number of items whose prefix index is sent to the workers at once:
#: the broadcast holds that many items (some 100 words each) whatever the size of the corpus; more items go in rounds.
WINDOW = 16
ITEM_BLOCK = 20_000
#: Hits and candidates that are looked at together: arrays of this many rows stay in the cache.
STEP = 8_192

_MARKER = re.compile(r"(?m)^[ \t]*(?:(?://+|#+|\*+|>+|--+|;+|%+|\|)[ \t]*)+")
_LINE_HYPHEN = re.compile(r"\w[-‐‑]\s*[\r\n]")
_HYPHEN = re.compile(r"(?<=\w)[-‐‑]\s*\n\s*(?=\w)")
_TAG = re.compile(r"</?[a-zA-Z][^<>\n]{0,200}>")
_INVISIBLE = re.compile("[­​-‏⁠-⁤﻿‪-‮]")
_PUNCT = re.compile(r"[^\w\s]|_")
_DROP = bytes(b for b in range(128) if not (chr(b).isalnum() or chr(b).isspace()))


def words_of(text: str) -> list[str]:
    """The words of a text as they are compared: white space parts them, everything but letters and digits is dropped."""
    plain = text.isascii()
    if not plain:
        text = _INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
    if "&" in text:
        text = html.unescape(text)
        plain = False
    if "<" in text:
        text = _TAG.sub(" ", text)
    if _LINE_HYPHEN.search(text):  # what begins a line matters only where a word goes on behind it
        text = text.replace("\r\n", "\n").replace("\r", "\n")
        text = _HYPHEN.sub("", _MARKER.sub("", text))
    if plain:
        return text.lower().encode().translate(None, _DROP).decode().split()
    return _PUNCT.sub("", text.casefold()).split()


def hashes(words: list[str]) -> np.ndarray:
    """The words as 64-bit hashes; each different one is hashed once."""
    coded = pa.array(words, pa.string()).dictionary_encode()
    of = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64).view(np.int64)
    return of[np.asarray(coded.indices)] if len(words) else of


def lengths_of(window: int) -> list[int]:
    """The lengths of passages that have to be looked for so that none of at least `window` words is missed."""
    return [window, *range(window // 4 * 4 + 4, 2 * window, 4)]


class Index:
    """Windows of the items, their prefixes by rarity, and the verification of candidates; all of it on arrays."""

    def __init__(self, items: list[tuple[int, list[str]]], df: dict[int, int], window: int = WINDOW) -> None:
        """items: id and words; df: in how many documents each hashed word stands (none: in none)."""
        self.window, self.lengths = window, lengths_of(window)
        self.reach = self.lengths[-1] // 4
        self.side = self.lengths[-1] - 1  # words on either side of a hit that its windows may hold
        self.pad = self.side + 2 * self.reach + 2
        items = [(i, hashes(ws)) for i, ws in items if len(ws) >= window]
        self.ids = np.array([i for i, _ in items], np.int64)
        known = np.unique(np.concatenate([h for _, h in items])) if items else np.empty(0, np.int64)
        count = np.array([df.get(int(h), 0) for h in known], np.int64)
        rank = np.empty(len(known), np.int32)
        rank[np.lexsort((known, count))] = np.arange(len(known), dtype=np.int32)
        self.known, self.rank = known, rank  # codes are ranks of rarity
        kind = np.int16 if len(known) < 32_000 else np.int32
        # All items one after the other, parted by places that are no word; where each place belongs.
        parts, owner, left, right, prefix = [np.full(self.pad, -2, kind)], [np.full(self.pad, -1, np.int32)], [np.zeros(self.pad, np.int32)], [np.zeros(self.pad, np.int32)], [np.zeros(self.pad, bool)]
        for k, (_, h) in enumerate(items):
            c = rank[np.searchsorted(known, h)]
            n = len(c)
            first = np.zeros(n + self.pad, bool)
            for m in self.lengths:
                if n >= m:
                    view = np.lib.stride_tricks.sliding_window_view(c, m)
                    edge = np.partition(view, m // 4, axis=1)[:, m // 4]
                    for i, e in enumerate(edge):
                        first[i : i + m] |= view[i] <= e
            at = np.arange(n + self.pad, dtype=np.int32)
            parts.append(np.r_[c.astype(kind), np.full(self.pad, -2, kind)])
            owner.append(np.where(at < n, k, -1).astype(np.int32))
            left.append(at)
            right.append(n - 1 - at)
            prefix.append(first)
        self.words, self.owner, self.left, self.right = (np.concatenate(x) for x in (parts, owner, left, right))
        places = np.flatnonzero(np.concatenate(prefix))
        order = np.argsort(self.words[places], kind="stable")
        self.places = places[order]  # prefix places by word
        self.start = np.searchsorted(self.words[self.places], np.arange(len(known) + 1))

    def codes(self, words: np.ndarray) -> np.ndarray:
        """Hashed words as codes; -1 for those that no item has."""
        if not len(self.known):
            return np.full(len(words), -1, self.words.dtype)
        at = np.minimum(np.searchsorted(self.known, words), len(self.known) - 1)
        return np.where(self.known[at] == words, self.rank[at], -1).astype(self.words.dtype)

    def spans(self, words: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Rows (document, item id, place, length, words changed) of every item window that is in a document. Document d has
        the hashed words from offsets[d] to offsets[d + 1]."""
        n = np.diff(offsets)
        base = self.pad + np.r_[0, np.cumsum(n + self.pad)[:-1]] if len(n) else np.empty(0, np.int64)
        doc = np.full(self.pad + int((n + self.pad).sum()), -1, self.words.dtype)
        place = np.repeat(base - offsets[:-1], n) + np.arange(offsets[0], offsets[-1]) if len(n) else np.empty(0, np.int64)
        code = self.codes(words[offsets[0] : offsets[-1]]) if len(n) else np.empty(0, self.words.dtype)
        doc[place] = code
        hit = code >= 0
        hit[hit] = self.start[code[hit] + 1] > self.start[code[hit]]
        place, code = place[hit], code[hit].astype(np.int64)
        each = self.start[code + 1] - self.start[code]
        ends = np.cumsum(each)
        found: list[list[np.ndarray]] = [[] for _ in self.lengths]
        total = int(ends[-1]) if len(ends) else 0
        for a in range(0, total, STEP):
            k = np.arange(a, min(a + STEP, total))
            row = np.searchsorted(ends, k, side="right")
            g = self.places[self.start[code[row]] + k - (ends[row] - each[row])]
            self._near(doc, place[row], g, found)
        out = []
        for m, rows in zip(self.lengths, found):
            if rows:
                cand = np.unique(np.concatenate(rows))
                for a in range(0, len(cand), STEP):
                    p, g = np.divmod(cand[a : a + STEP], len(self.words))
                    changed = self._changed(doc, p, g, m)
                    ok = changed <= m // 4
                    if ok.any():
                        p, g, changed = p[ok], g[ok], changed[ok]
                        d = np.maximum(np.searchsorted(base, p + m // 2, side="right") - 1, 0)  # a passage may begin before its document
                        out.append(np.stack([d, self.ids[self.owner[g]], p - base[d], np.full(len(p), m), changed], 1))
        return np.concatenate(out) if out else np.empty((0, 5), np.int64)

    def _near(self, doc: np.ndarray, p: np.ndarray, g: np.ndarray, found: list[list[np.ndarray]]) -> None:
        """Positional bound: adds to found, by length, the places in doc and words (as one number) at which windows around
        the hits may begin. A word of a window of length m counts if it stands within m // 4 places of where it should."""
        side, reach = self.side, self.reach
        span = np.arange(-side, side + 1)
        want = self.words[g[:, None] + span]
        around = doc[np.clip(p[:, None] + np.arange(-side - reach, side + reach + 1), 0, len(doc) - 1)]
        width = 2 * side + 1
        match = np.zeros(want.shape, bool)
        done = -1
        for m, rows in zip(self.lengths, found):
            edits = m // 4
            for d in range(done + 1, edits + 1):
                for s in {d, -d}:
                    match |= around[:, reach + s : reach + s + width] == want
            done = edits
            some = np.flatnonzero(match.sum(1) >= m - edits)
            if not len(some):
                continue
            total = np.zeros((len(some), width + 1), np.int16)
            np.cumsum(match[some], axis=1, out=total[:, 1:])
            lo = side - m + 1
            kept = total[:, lo + m : side + m + 1] - total[:, lo : side + 1]  # windows that hold the hit
            i, j = np.nonzero(kept >= m - edits)
            own = some[i]
            before = side - lo - j  # words of the window before the hit
            inside = (before <= self.left[g[own]]) & (m - 1 - before <= self.right[g[own]])
            own, before = own[inside], before[inside]
            if len(own):
                rows.append((p[own] - before) * len(self.words) + (g[own] - before))

    def _changed(self, doc: np.ndarray, p: np.ndarray, g: np.ndarray, m: int) -> np.ndarray:
        """The fewest words replaced, added or dropped with which the m words at g are in doc at about p: edit distance to
        every stretch there, all candidates at once, one column a word."""
        edits = m // 4
        part = self.words[g[:, None] + np.arange(m)]
        near = doc[np.clip(p[:, None] + np.arange(-edits, m + edits), 0, len(doc) - 1)]
        steps = np.arange(m + 1, dtype=np.int16)
        col = np.broadcast_to(steps, (len(p), m + 1)).copy()
        least = col[:, m].copy()
        new = np.empty_like(col)
        for i in range(near.shape[1]):
            new[:, 0] = 0  # a passage may begin anywhere
            np.minimum(col[:, :-1] + (part != near[:, i : i + 1]), col[:, 1:] + 1, out=new[:, 1:])
            col = np.minimum.accumulate(new - steps, axis=1) + steps  # a dropped word costs one
            np.minimum(least, col[:, m], out=least)
        return least


@functools.cache
def _overlaps(window: int) -> list[list[tuple[int, int]]]:
    """By lengths n and m: the first and last distance from the place of a stretch of m words to that of one of n words that
    covers more than half of it."""
    def fits(n: int, m: int) -> tuple[int, int]:
        d = [d for d in range(-n, m) if 2 * (min(d + n, m) - max(d, 0)) > m]
        return (d[0], d[-1]) if d else (0, -1)

    return [[fits(n, m) for m in lengths_of(window)] for n in lengths_of(window)]


def _running_max(x: np.ndarray, width: int) -> np.ndarray:
    """The greatest of each width neighbours, from each place on."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = np.maximum(x[:-step], x[step:])
        done += step
    return x


def settle(spans: np.ndarray, window: int = WINDOW) -> list[int]:
    """The items of the spans (item id, place, length, words changed) of one document, without those of which each span
    shares more than half its stretch with one in which another item keeps a strictly greater share of its words."""
    items, who = np.unique(spans[:, 0], return_inverse=True)
    if len(items) < 2:
        return items.tolist()
    lengths = lengths_of(window)
    at = spans[:, 1] - spans[:, 1].min()
    size, edge = int(at.max()) + 1, 2 * lengths[-1]
    of = np.searchsorted(lengths, spans[:, 2])
    share = (spans[:, 2] - spans[:, 3]) * (int(np.lcm.reduce(lengths)) // spans[:, 2])
    # By length of the stretch: the greatest share that an item keeps in more than half of it, and the next item's.
    top, owner, second = (np.zeros((len(lengths), size), np.int64) for _ in range(3))
    for a in range(len(items)):
        cover = np.zeros((len(lengths), size), np.int64)
        for b in np.unique(of[who == a]):
            own = (who == a) & (of == b)
            best = np.zeros(size + 2 * edge, np.int64)
            np.maximum.at(best, at[own] + edge, share[own])
            for c, (lo, hi) in enumerate(_overlaps(window)[b]):
                if lo <= hi:
                    np.maximum(cover[c], _running_max(best, hi - lo + 1)[edge + lo : edge + lo + size], out=cover[c])
        more = cover > top
        second = np.where(more, top, np.maximum(second, cover))
        owner = np.where(more, a, owner)
        top = np.where(more, cover, top)
    others = np.where(owner[of, at] == who, second[of, at], top[of, at])
    return np.unique(spans[others <= share, 0]).tolist()


def _item_rows(items: DataFrame, item_id: str, text: str) -> DataFrame:
    return items.where(F.col(item_id).isNotNull() & F.col(text).isNotNull()).select(F.col(item_id).cast("bigint").alias("item_id"), F.col(text).alias("text")).distinct()


def document_words(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, copy (hash of the text), words (hashed, in order) of every document with an id and a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            each = [words_of(t) for t in b.column(2).to_pylist()]
            ends = np.r_[0, np.cumsum([len(w) for w in each])].astype(np.int32)
            flat = hashes([w for ws in each for w in ws])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int64()))], ["doc_id", "copy", "words"])

    src = documents.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("copy"), F.col(text).alias("text"))
    return spread(src).mapInArrow(run, "doc_id bigint, copy bigint, words array<bigint>")


def document_frequencies(words: DataFrame, vocabulary: np.ndarray) -> dict[int, int]:
    """In how many documents each hashed word of the (sorted) vocabulary stands, over all documents. Counted per partition,
    then summed; the result has at most as many rows as the items of a block have words."""
    known = words.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = known.value
        n = np.zeros(len(vocabulary), np.int64)
        for b in batches:
            col = b.column(0)
            flat, rows = np.asarray(col.flatten()), np.repeat(np.arange(len(col)), np.asarray(col.value_lengths()))
            at = np.minimum(np.searchsorted(vocabulary, flat), len(vocabulary) - 1)
            ok = vocabulary[at] == flat
            once = np.unique(rows[ok] * len(vocabulary) + at[ok])
            n += np.bincount(once % len(vocabulary), minlength=len(vocabulary))
        some = n > 0
        yield pa.RecordBatch.from_pydict({"word": pa.array(vocabulary[some], pa.int64()), "n": pa.array(n[some], pa.int64())})

    if not len(vocabulary):
        return {}
    return {r.word: r.n for r in words.select("words").mapInArrow(count, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()}


def leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block: int = ITEM_BLOCK) -> DataFrame:
    """Distinct (doc_id, item_id): the document holds a passage of at least `window` words of the item, in order, with at
    most one word in four replaced, added or dropped, and no other item keeps a greater share of its words in its place.

    Null ids and texts are left out; items of fewer than `window` words cannot leak; an item id with several texts leaks
    by any of them. Texts are searched whole, copies of documents count for themselves. Without items the result is empty.
    """
    rows = _item_rows(items, item_id, item_text)
    blocks = max(1, -(-rows.count() // block))
    words = cut(document_words(documents, doc_id, text))
    out = None
    for b in range(blocks):
        part = [(r.item_id, words_of(r.text)) for r in rows.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).sort("item_id", "text").toLocalIterator()]
        vocabulary = np.unique(hashes([w for _, ws in part for w in ws]))
        index = documents.sparkSession.sparkContext.broadcast(Index(part, document_frequencies(words, vocabulary), window))

        def search(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                col = batch.column(2)
                spans = index.value.spans(np.asarray(col.flatten()), np.r_[0, np.cumsum(np.asarray(col.value_lengths()))])
                spans = spans[np.argsort(spans[:, 0], kind="stable")]
                if blocks == 1:  # all is known here
                    cuts = np.r_[0, np.flatnonzero(np.diff(spans[:, 0])) + 1, len(spans)] if len(spans) else [0]
                    rest = [(int(spans[a, 0]), i) for a, z in zip(cuts, cuts[1:]) for i in settle(spans[a:z, 1:], window)]
                    spans = np.array([(d, i, 0, 0, 0) for d, i in rest], np.int64).reshape(-1, 5)
                ids = [batch.column(c).take(pa.array(spans[:, 0])) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([*ids, *(pa.array(spans[:, c], pa.int64()) for c in range(1, 5))], ["doc_id", "copy", "item_id", "at", "length", "changed"])

        got = words.mapInArrow(search, "doc_id bigint, copy bigint, item_id bigint, at bigint, length bigint, changed bigint")
        if blocks > 1:  # one block after the other, so that one index is held at a time
            got = cut(got)
            index.unpersist()
        out = got if out is None else out.unionByName(got)

    def together(t: pa.Table) -> pa.Table:
        items = settle(np.stack([np.asarray(t.column(c)) for c in ("item_id", "at", "length", "changed")], 1), window)
        return pa.table({"doc_id": pa.array([t.column("doc_id")[0].as_py()] * len(items), pa.int64()), "item_id": pa.array(items, pa.int64())})

    if blocks > 1:
        out = out.groupBy("doc_id", "copy").applyInArrow(together, "doc_id bigint, item_id bigint")
    out = cut(out.select("doc_id", "item_id").distinct())
    release(words)
    return out
