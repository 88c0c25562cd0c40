"""Benchmark passages in documents, by CGK embedding, bit-sampling LSH and exact edit distance.

Texts and items are compared as their words (letters and digits) in lower case with single spaces between.
A document holds an item when some stretch of it has an edit distance of at most
``SHARE`` of the item's length to the item.

1. Windows: every item is cut into pieces of ``PIECE`` characters, which are looked for with up to one edit.
   So many edits as are allowed for the item leave some of its pieces whole or with one edit (an edit takes one
   from twice the number of pieces), at places shifted against each other by no more than that number.  Where so
   many pieces stand in a document within such a shift, item-sized windows are laid, one by each piece.  Items
   too short for it are cut finer, into pieces looked for as they are.  This loses nothing: no item within the
   edit share goes without a window.
2. The CGK walk reads a window from left to right, repeating the present character or going on to the
   next by a random bit of (step, character).  The same bits are used for windows and items, so that
   after an edit the two walks soon meet again, and edit distance becomes Hamming distance.
3. LSH: ``WALKS`` independent walks, ``BANDS`` samples of ``BITS`` positions each.  A window that agrees
   with its item in all positions of one sample is a candidate.
4. Candidates are verified by the exact edit distance of the item to any stretch of the window, widened by
   the edits allowed (Myers' bit vectors), which also gives the stretch.

Items are sent in blocks of at most ``BLOCK_BYTES``, a pass over the documents each, so
what is broadcast has a bound whatever the benchmark's size.

Defined results: NULL, empty and wordless texts hold nothing, NULL, empty and wordless items are held by
nothing.  An item needs no id, and its id may be of any type: ``clean`` looks for every item with words, and
``find`` gives items without an id, under NULL, where ``null_ids`` asks for them (``query`` does).  Repeated rows are found repeatedly, a NULL id stays; of overlapping stretches for one item
in one document the nearest counts.  Items alike are found each.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import arrow_batch, arrow_schema, documents, only, remembers, small_batches

SHARE = 0.2
#: characters of a piece, what a 64-bit word holds
PIECE = 8
WALKS, BANDS, BITS = 8, 32, 7
BLOCK_BYTES = 4 << 20
#: windows embedded at a time
WINDOWS = 4096
#: characters of documents counted at a time, and items
CHUNK, GROUP = 1 << 17, 1024
#: bits of a piece's hash
SLOTS = 20
_WORD = re.compile(r"[^\W_]+")


def _codes(text: str) -> np.ndarray:
    """Characters as bytes of a hash; 0 is kept for what lies behind the end."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return (points % 255 + 1).astype(np.uint8)


@cache
def _lower() -> np.ndarray:
    """Lower case of every letter and digit, 0 for all other characters."""
    out = np.zeros(0x110000, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalnum():
            out[i] = ord(c.lower()[0])
    return out


#: the same of the first 256 characters
_LATIN = bytes(ord(chr(i).lower()) if chr(i).isalnum() else 0 for i in range(256))


def _body(text: str | None) -> np.ndarray:
    """Code points of the words in lower case, with single spaces between; bytes where all are below 256."""
    if not text:
        return np.empty(0, np.uint32)
    if "\u0130" in text or "\u03a3" in text:  # their lower case is two characters, or depends on the place
        return np.frombuffer(" ".join(w.lower() for w in _WORD.findall(text)).encode("utf-32-le"), np.uint32)
    try:
        points = np.frombuffer(text.encode("latin-1").translate(_LATIN), np.uint8)
    except UnicodeEncodeError:
        points = _lower()[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
    inside = points != 0
    keep = inside.copy()
    keep[1:] |= inside[:-1]
    points = points[keep]
    points[points == 0] = 32
    a = int(len(points) and points[0] == 32)
    return points[a:len(points) - int(len(points) > a and points[-1] == 32)]


def _text(points: np.ndarray) -> str:
    return points.astype("<u4").tobytes().decode("utf-32-le")


def _expand(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of every one among ``count`` in a row: whose it is, and its number within."""
    owner = np.repeat(np.arange(len(count)), count)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)


def _words64(codes: np.ndarray) -> np.ndarray:
    """The eight characters from every place on, the first in the lowest byte; 0 behind the end."""
    padded = np.zeros(len(codes) + 8, np.uint8)
    padded[:len(codes)] = codes
    return np.ndarray((len(codes) + 1,), "<u8", padded, strides=(1,)).astype(np.uint64)


#: the lowest bytes of a word, by their number, and each byte
_LOW = [np.uint64((1 << 8 * k) - 1) for k in range(9)]
_BYTE = [np.uint64(255 << 8 * k) for k in range(8)]
_FACTOR = 0x9E3779B97F4A7C15


def _slots(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of the lowest ``width`` bytes: the others leave the word when multiplied."""
    factor = np.uint64((_FACTOR << 8 * (8 - width)) & (1 << 64) - 1)
    return (words * factor) >> np.uint64(64 - SLOTS)


class _Table:
    """Pieces by the hash of some bytes."""

    def __init__(self, words: np.ndarray, pieces: np.ndarray, width: int):
        slots = _slots(words, width).astype(np.int64)
        self.width, order = width, np.argsort(slots, kind="stable")
        self.pieces = pieces[order]
        self.count = np.bincount(slots, minlength=1 << SLOTS)
        self.first = np.cumsum(self.count) - self.count
        self.known = self.count > 0

    def met(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(piece, place) wherever a piece has the hash of the word."""
        slots = _slots(words, self.width)
        at = np.flatnonzero(self.known[slots])
        slots = slots[at]
        owner, inside = _expand(self.count[slots])
        return self.pieces[self.first[slots][owner] + inside], at[owner]


#: odd factors of the seven characters of a piece without one
_SEVEN = [np.uint32(f) for f in (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F, 0x165667B1, 0xD3A2646D, 0xB55A4F09)]


class _Cut:
    """Pieces of eight without each of their characters, by a hash that changes little from one gap to the next."""

    def __init__(self, words: np.ndarray):
        key = np.concatenate([words & _LOW[i] | words >> np.uint64(8) & _LOW[7] & ~_LOW[i] for i in range(PIECE)])
        slots = np.zeros(len(key), np.uint32)
        for i, factor in enumerate(_SEVEN):
            slots += (key >> np.uint64(8 * i) & _LOW[1]).astype(np.uint32) * factor
        slots = (slots >> np.uint32(32 - SLOTS)).astype(np.int64)
        order = np.argsort(slots, kind="stable")
        self.key, self.piece, self.gap = key[order], order % len(words), (order // len(words)).astype(np.uint8)
        self.text = words[self.piece]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(slots, minlength=1 << SLOTS))]).astype(np.int32)
        #: which characters are left out of the pieces with a hash, a bit each
        self.gaps = np.zeros(1 << SLOTS, np.uint8)
        np.bitwise_or.at(self.gaps, slots[order], np.uint8(1) << self.gap)

    def met(self, codes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(piece, place, how often it counts): twice as it is, once with one edit, which may be named again."""
        words, n = _words64(codes), len(codes)
        padded = np.zeros(n + PIECE, np.uint32)
        padded[:n] = codes
        steps = np.diff(padded)
        hashes, slots, gaps = np.zeros(n, np.uint32), np.empty(n, np.int64), np.empty(n, np.uint8)
        for i, factor in enumerate(_SEVEN):
            hashes += padded[i:i + n] * factor
        found = []
        for i in range(PIECE - 1, -1, -1):  # the text without its i-th character
            if i < PIECE - 1:
                hashes += steps[i:i + n] * _SEVEN[i]
            np.right_shift(hashes, np.uint32(32 - SLOTS), out=slots, casting="unsafe")
            self.gaps.take(slots, out=gaps, mode="clip")
            # of use: all pieces shorter by a character, or those changed in this one or longer by it
            use = gaps if i == PIECE - 1 else gaps & np.uint8(1 << i | 1 << PIECE - 1)
            at = np.flatnonzero(use != 0)
            slot = slots[at]
            first = self.first[slot]
            owner, inside = _expand(self.first[slot + 1] - first)
            entry, at = first[owner] + inside, at[owner]
            if i < PIECE - 1:
                gap = self.gap[entry]
                use = np.flatnonzero((gap == i) | (gap == PIECE - 1))
                entry, at = entry[use], at[use]
            own, text = words[at], self.text[entry]
            changes = own ^ text
            if i == PIECE - 1:
                short = (own & _LOW[7]) == self.key[entry]
                keep = np.flatnonzero(short & ((changes != 0) | (self.gap[entry] == i)))
                often = 1 + (changes[keep] == 0)
            else:
                following = words[at + 1]
                left = following ^ (own ^ following) & _LOW[i]
                keep = np.flatnonzero((changes != 0) & ((changes & ~_BYTE[i] == 0) | (left == text)))
                often = np.ones(len(keep), np.int64)
            found.append((self.piece[entry[keep]], at[keep], often))
        return found


class _Pieces:
    """Pieces of one width, of some items: (number, text, edits allowed).

    near: pieces count twice as they are, once with an edit; otherwise once as they are
    """

    def __init__(self, width: int, near: bool, items: list[tuple]):
        self.near = near
        self.number = np.array([i for i, _, _ in items])
        self.spare = np.array([k for _, _, k in items])
        self.least = np.array([(1 + near) * (len(t) // width) - k for _, t, k in items])
        self.reach = max(len(t) for _, t, _ in items) + width
        item, before, words = [], [], []
        for n, (_, t, _) in enumerate(items):
            own = np.arange(len(t) // width) * width
            item.append(np.full(len(own), n))
            before.append(own)
            words.append(_words64(_codes(t))[own])
        self.item, self.before = np.concatenate(item), np.concatenate(before)
        words, every = np.concatenate(words), np.arange(len(self.item))
        self.table = _Cut(words) if near else _Table(words, every, width)

    def _met(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item and place where it would begin as one number, piece, how often it counts) of the pieces met, in order."""
        if self.near:
            found = self.table.met(codes)
        else:
            piece, at = self.table.met(_words64(codes)[:-1])
            found = [(piece, at, np.ones(len(at), np.int64))]
        piece, at, often = (np.concatenate(c) for c in zip(*found))
        n = len(self.item)
        key = (((self.item * self._apart(codes) + self.reach - self.before)[piece] + at) * n + piece) * 2 + 2 - often
        key.sort()
        key = key[np.concatenate([[True], key[1:] >> 1 != key[:-1] >> 1])[:len(key)]]
        place, piece = np.divmod(key >> 1, n)
        return place, piece, 2 - (key & 1) if self.near else np.ones(len(key), np.int64)

    def _apart(self, codes: np.ndarray) -> int:
        """From the places of one item to those of the next."""
        return len(codes) + 3 * self.reach

    def laid(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(begin, item) of windows: wherever enough pieces meet within the edits allowed."""
        key, piece, often = self._met(codes)
        apart = self._apart(codes)
        # the count of the pieces from each place on, as far as they may shift
        for strict in (False, True):  # once more with what is left, different pieces alone
            item, n = self.item[piece], len(key)
            # so many pieces at least must follow within the shift, as none counts more than twice
            last = np.arange(n) + (self.least[item] + self.near) // (1 + self.near) - 1
            begins = np.flatnonzero(last < n)
            begins = begins[key[last[begins]] - key[begins] <= self.spare[item[begins]]]
            upto = np.concatenate([[0], np.cumsum(often)])
            ends = np.searchsorted(key, key[begins] + self.spare[item[begins]], "right")  # the spare is below the reach
            enough = np.flatnonzero(upto[ends] - upto[begins] >= self.least[item[begins]])
            begins, ends = begins[enough], ends[enough]
            if strict:
                enough = np.flatnonzero(self._different(piece, often, begins, ends) >= self.least[item[begins]])
                begins, ends = begins[enough], ends[enough]
            steps = np.bincount(begins, minlength=n + 1) - np.bincount(ends, minlength=n + 1)
            order = np.flatnonzero(np.cumsum(steps[:-1]) > 0)
            key, piece, often = key[order], piece[order], often[order]
        key = np.unique(key)
        return key % apart - self.reach, self.number[key // apart]

    @staticmethod
    def _different(piece, often, begins, ends) -> np.ndarray:
        """The sum over the different pieces of every range, each at the most it counts."""
        owner, inside = _expand(ends - begins)
        row = begins[owner] + inside
        key = (owner * (int(piece.max(initial=0)) + 1) + piece[row]) * 2 + (2 - often[row])
        key.sort()
        best = key[np.concatenate([[True], key[1:] >> 1 != key[:-1] >> 1])[:len(key)]]
        return np.bincount((best >> 1) // (int(piece.max(initial=0)) + 1), 2 - (best & 1), minlength=len(begins))


def walk(windows: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """CGK embeddings (walk, row, step) of rows of characters; bits[walk, step, character] tells whether to go on."""
    (n, width), (walks, steps, _) = windows.shape, bits.shape
    padded = np.zeros((n, width + 1), np.uint8)
    padded[:, :width] = windows
    flat, rows = padded.ravel(), bits.transpose(1, 0, 2).reshape(steps, -1)
    at = np.tile(np.arange(n) * (width + 1), walks)
    end, own = at + width, np.repeat(np.arange(walks) * 256, n)
    out = np.empty((steps, walks * n), np.uint8)
    for step, row in enumerate(rows):
        seen = flat[at]
        out[step] = seen
        at = np.minimum(at + row[own + seen], end)
    return out.reshape(steps, walks, n).transpose(1, 2, 0)


def nearest(item: str, text: str) -> tuple[int, int, int]:
    """(distance, start, end) of the stretch of ``text`` nearest to ``item``; Myers' bit vectors."""
    distance, end = _best_end(item, text)
    back, length = _best_end(item[::-1], text[:end][::-1], anchored=True)
    assert back == distance
    return distance, end - length, end


def _best_end(item: str, text: str, anchored: bool = False) -> tuple[int, int]:
    """Least distance of the item to a stretch ending somewhere, the first such end.

    anchored: the stretch starts at the text's beginning
    """
    m = len(item)
    full, top = (1 << m) - 1, 1 << m - 1
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    up, down, score, best = full, 0, m, (m, 0)
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        vertical = eq | down
        horizontal = ((eq & up) + up ^ up) | eq
        plus, minus = down | ~(horizontal | up) & full, up & horizontal
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus = (plus << 1 | int(anchored)) & full
        minus = minus << 1 & full
        up, down = minus | ~(vertical | plus) & full, plus & vertical
        if score < best[0]:
            best = (score, j + 1)
    return best


class Matcher:
    """A block of items (id, text), ready to be looked for."""

    def __init__(self, items: list[tuple], share: float = SHARE, seed: int = 11):
        self.share = share
        bodies = [(key, _text(_body(text))) for key, text in items]
        self.items = [(key, t) for key, t in bodies if t]
        if not self.items:
            return
        cut: dict[int, list] = {}
        for i, (_, t) in enumerate(self.items):
            spare = int(share * len(t))
            near = 2 * (len(t) // PIECE) > spare
            width = PIECE if near else next(w for w in range(PIECE, 0, -1) if len(t) // w > spare)
            cut.setdefault((width, near), []).append((i, t, spare))
        self.pieces = [_Pieces(*kind, rows[i:i + GROUP])
                       for kind, rows in sorted(cut.items()) for i in range(0, len(rows), GROUP)]
        lengths = np.array([len(t) for _, t in self.items])
        self.lengths, self.width = lengths, int(lengths.max())
        random = np.random.default_rng(seed)
        self.bits = np.stack([random.integers(0, 2, (3 * self.width, 256)).astype(np.uint8) for _ in range(WALKS)])
        # samples of positions along the item's own walk
        self.samples = (random.random((WALKS, len(self.items), BANDS, BITS))
                        * (3 * lengths)[None, :, None, None]).astype(np.int64)
        codes = np.zeros((len(self.items), self.width), np.uint8)
        for row, (_, t) in zip(codes, self.items):
            row[:len(t)] = _codes(t)
        every = np.arange(len(self.items))
        self.keys = [self._keys(walk(codes, b[None])[0], s, every) for b, s in zip(self.bits, self.samples)]

    @staticmethod
    def _keys(out, samples, item):
        return np.take_along_axis(out, samples[item].reshape(len(item), -1), 1).reshape(len(item), BANDS, BITS)

    def _windows(self, texts: dict[int, np.ndarray]) -> list[tuple]:
        """(text, begin, item) of windows laid over the pieces met, some texts at a time."""
        reach = self.width + int(self.share * self.width) + 1  # of a stretch, wholly within one part of its text
        out, parts, used = [], [], 0

        def count():
            codes = np.zeros(used, np.uint8)
            starts = np.array([at for _, _, at, _ in parts])
            for _, _, at, own in parts:
                codes[at:at + len(own)] = own
            for pieces in self.pieces:
                begin, item = pieces.laid(codes)
                # a window may begin before its text, by no more than the edits allowed
                middle = np.clip(begin + self.lengths[item] // 2, 0, used - 1)
                part = np.searchsorted(starts, middle, "right") - 1
                out.extend((parts[n][0], max(0, parts[n][1] + a - parts[n][2]), i)
                           for n, a, i in zip(part.tolist(), begin.tolist(), item.tolist()))

        for d, codes in texts.items():
            for low in range(0, max(1, len(codes) - reach), CHUNK):
                own = codes[low:low + CHUNK + reach]
                if parts and used + len(own) > CHUNK:
                    count()
                    parts, used = [], 0
                parts.append((d, low, used, own))
                used += len(own) + self.width  # nothing reaches from one part into another
        if parts:
            count()
        return sorted(set(out))

    def candidates(self, windows: list[tuple[np.ndarray, int]]) -> np.ndarray:
        """Which of the windows (characters, item) share a sample with their item."""
        out = np.zeros(len(windows), bool)
        step = WINDOWS // WALKS
        for i in range(0, len(windows), step):
            part = windows[i:i + step]
            item = np.array([k for _, k in part])
            width = int(self.lengths[item].max())  # no sample lies behind three times the item
            codes = np.zeros((len(part), width), np.uint8)
            for row, (own, _) in zip(codes, part):
                row[:len(own)] = own
            for walked, samples, keys in zip(walk(codes, self.bits[:, :3 * width]), self.samples, self.keys):
                own = self._keys(walked, samples, item)
                out[i:i + len(part)] |= (own == keys[item]).all(2).any(1)
        return out

    def _stretches(self, windows: list[tuple]) -> list[tuple]:
        """(text, item, beginnings) of windows of one item no further apart than the edits allowed."""
        out: list[tuple] = []
        for d, a, i in sorted(windows, key=lambda w: (w[0], w[2], w[1])):
            if out and out[-1][:2] == (d, i) and a - out[-1][2][0] <= int(self.share * len(self.items[i][1])):
                out[-1][2].append(a)
            else:
                out.append((d, i, [a]))
        return out

    def _near(self, codes: dict[int, np.ndarray], places: list[tuple]) -> set[tuple]:
        """Those of the windows (text, begin, item) that are candidates."""
        windows = [(codes[d][a:a + len(self.items[i][1])], i) for d, a, i in places]
        return {places[k] for k in np.flatnonzero(self.candidates(windows)).tolist()}

    def _reached(self, codes: dict[int, np.ndarray], far: list[tuple], places: list[tuple]) -> list[tuple]:
        """Those of the stretches with a candidate among the places."""
        near = self._near(codes, places)
        return [f for f in far if any((f[1], a, f[2]) in near for a in range(f[3], f[4] + 1))]

    def find(self, texts: list[str | None]) -> list[list[tuple]]:
        """For every text its hits (item id, start, end, distance), offsets in the text as it is."""
        hits: list[list[tuple]] = [[] for _ in texts]
        if not self.items:
            return hits
        bodies = {d: body for d, text in enumerate(texts) if len(body := _body(text))}
        codes = {d: (body % 255 + 1).astype(np.uint8) for d, body in bodies.items()}
        stretches = self._stretches(self._windows(codes))
        near = self._near(codes, [(d, a, i) for d, i, places in stretches for a in places])
        kept, far, waiting = [], [], []
        for n, (d, i, places) in enumerate(stretches):
            spare = int(self.share * len(self.items[i][1]))
            low, high = max(0, places[0] - spare), places[-1] + spare
            if any((d, a, i) in near for a in places):
                kept.append((n, d, i, low, high))
                continue
            # where no piece tells the beginning well enough: windows at all places it can be at, of many stretches at once
            far.append((n, d, i, low, high))
            waiting += [(d, a, i) for a in range(low, min(high, len(codes[d]) - 1) + 1)]
            if len(waiting) >= WINDOWS:
                kept += self._reached(codes, far, waiting)
                far, waiting = [], []
        kept += self._reached(codes, far, waiting)
        for _, d, i, low, high in sorted(kept):
            key, item = self.items[i]
            spare = int(self.share * len(item))
            distance, start, end = nearest(item, _text(bodies[d][low:high + len(item)]))
            if distance <= spare:
                name = (True, i) if key is None else (False, key)  # items without an id are apart
                hits[d].append((name, low + start, low + end, distance))
        for d, own in enumerate(hits):
            if own:
                first = np.flatnonzero(np.concatenate([[True], bodies[d] == 32]))
                hits[d] = self._in_text(_nearest_only(own), texts[d], first)
        return hits

    @staticmethod
    def _in_text(own, text, first):
        spans = [m.span() for m in _WORD.finditer(text)]
        out = []
        for (null, key), a, b, distance in own:
            low = int(np.searchsorted(first, a, "right")) - 1
            high = max(low, int(np.searchsorted(first, b, "left")) - 1)
            out.append((None if null else key, spans[low][0], spans[min(high, len(spans) - 1)][1], distance))
        return out


def _nearest_only(own: list[tuple]) -> list[tuple]:
    kept: list[tuple] = []
    for hit in sorted(set(own), key=lambda h: (h[3], h[1], h[2])):
        if not any(k[0] == hit[0] and k[1] < hit[2] and hit[1] < k[2] for k in kept):
            kept.append(hit)
    return sorted(kept, key=lambda h: (h[1], h[0]))


_matchers: list[tuple[list, Matcher]] = []
remembers("matcher", _matchers.clear)


def _matcher(items: list[tuple]) -> Matcher:
    """The worker's matcher of a block of items; one is kept."""
    only("matcher")
    if not _matchers or _matchers[0][0] != items:
        _matchers[:] = [(items, Matcher(items))]
    return _matchers[0][1]


# --- on Spark -------------------------------------------------------------------
def blocks(benchmark: DataFrame, item_column: str = "item_id", text: str = "text", null_ids: bool = True):
    """Items of one block after the other, each within ``BLOCK_BYTES`` (or one item)."""
    items = benchmark.select(F.col(item_column).alias("item"), F.col(text).alias("text")) \
        .where("length(text) > 0").orderBy("item", "text")
    if not null_ids:
        items = items.where("item is not null")
    block, size = [], 0
    for row in items.toLocalIterator():
        n = len(row["text"].encode())
        if block and size + n > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append(tuple(row))
        size += n
    if block:
        yield block


HITS = "start_char long, end_char long, distance int"


def find(docs: DataFrame, benchmark: DataFrame, *, id_column: str = "doc_id", text: str = "text",
         null_ids: bool = False) -> DataFrame:
    """(id, item_id, start_char, end_char, distance) for every item a document holds.

    null_ids   items without an id too
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"))
    ddl = f"doc_id {dict(rows.dtypes)['doc_id']}, item_id {dict(benchmark.dtypes)['item_id']}, {HITS}"
    schema = arrow_schema(ddl)
    found = spark.createDataFrame([], ddl)
    for block in blocks(benchmark, null_ids=null_ids):
        sent = spark.sparkContext.broadcast(block)

        def run(batches, sent=sent):
            matcher = _matcher(sent.value)
            for batch in batches:
                ids = batch.column(0).to_pylist()
                out = [(i, *h) for i, own in zip(ids, matcher.find(batch.column(1).to_pylist())) for h in own]
                if out:
                    yield arrow_batch(schema, list(map(list, zip(*out))))

        found = found.union(rows.mapInArrow(run, ddl))
    return found.withColumnRenamed("doc_id", id_column)


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no item."""
    spark = docs.sparkSession
    small_batches(spark)
    at = docs.columns.index(text)
    for block in blocks(benchmark):
        sent = spark.sparkContext.broadcast(block)

        def run(batches, sent=sent):
            matcher = _matcher(sent.value)
            for batch in batches:
                keep = [not own for own in matcher.find(batch.column(at).to_pylist())]
                yield batch.filter(pa.array(keep, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def query(spark, sf_dir: str) -> DataFrame:
    """op5: every benchmark item found in every document."""
    return find(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), null_ids=True)
