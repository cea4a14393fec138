"""Problem 6: evaluation texts leaking into training text.

Items and documents are folded to what a reader would call the same text:
letter case, punctuation, blanks, invisible characters, look-alike letters,
the script of digits and short bracketed inserts are gone. A Wu-Manber search
then looks for every window of the items, 12 folded code points long or less
for items that are short or of short words: a shift table over the block at
the end of the window skips impossible positions, the block's bucket selects
windows by hash, and direct comparison confirms. The search runs over many
stretches of the text in lockstep, as array operations. Runs of equal letters
on the diagonals of the windows found are chained, in order, into one stretch
of the document, which counts if it carries at least half of the item with
fewer than one word in five misread.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lipika.llm.lookalikes import INVISIBLE_RANGES, classes
from lipika.session import pick

#: Lengths of windows, longest first; an item takes the first of which its leaks surely keep some.
WINDOWS = (12, 6, 3, 2, 1)
PART = 0.5
MISREAD = 0.2
#: A word of which less than this is found is not misread but another word, and counts three times.
FOREIGN = 0.4
#: Items, and code points of them, searched for in one pass over the documents.
ITEM_BLOCK = 40_000
BLOCK_CHARS = 4_000_000
#: Code points of documents folded and searched together; one document may have more.
TOGETHER = 1_000_000
#: Windows found, times the items that hold them, looked at together; one document may have more.
HITS = 2_000_000
#: Folded code points by which a stretch may be interrupted.
GAP = 48
LANE = 256
#: Slots of the shift table, as a power of two: at least so many, and four for each window.
HASH_BITS = 20

_INSERT = re.compile(r"[(\[（【{][^()\[\]（）【】{}\n]{1,40}[)\]）】}]")
_UNIT = re.compile(r"\S+")
_SEPARATOR = "\x00"
_KEPT: dict[str, object] = {}


class Folding:
    """What each code point folds to, as runs of ``codes``; worked out when a code point is first met."""

    UNKNOWN = 255

    def __init__(self) -> None:
        self.same: dict[str, str] = {}
        for c in classes():
            longest = max(c, key=lambda m: (len(m), m))
            for m in c:
                if len(m) == 1:
                    self.same[m] = longest if len(longest) > 1 else c[0]
        self.hidden = {c for lo, hi in INVISIBLE_RANGES for c in range(lo, hi + 1)}
        self.length, self.offset, self.codes = np.full(0x110000, self.UNKNOWN, np.uint8), np.zeros(0x110000, np.int32), np.zeros(0, np.uint32)
        self.learn(np.array([0], np.uint32))

    def one(self, ch: str) -> str:
        c = ord(ch)
        if c == 0:
            return _SEPARATOR
        if 0xD800 <= c <= 0xDFFF:
            return ""
        for _ in range(4):
            out = []
            for x in unicodedata.normalize("NFKD", ch).casefold():
                if x.isdigit():
                    out.append(str(unicodedata.digit(x)))
                elif ord(x) not in self.hidden and unicodedata.category(x)[0] in "LMN":
                    out.append(self.same.get(x, x).casefold())
            if (made := "".join(out)) == ch:
                break
            ch = made
        return ch

    def learn(self, points: np.ndarray) -> None:
        made = [self.one(chr(c)) for c in points.tolist()]
        self.length[points] = n = np.array([min(len(m), 254) for m in made], np.uint8)
        self.offset[points] = len(self.codes) + np.cumsum(n) - n
        self.codes = np.r_[self.codes, np.array([ord(x) for m in made for x in m[:254]], np.uint32)]


def fold_text(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(folded code points, for each the index of the code point it came from)."""
    if "fold" not in _KEPT:
        _KEPT["fold"] = Folding()
    fold = _KEPT["fold"]
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = fold.length[raw]
    if (new := n == fold.UNKNOWN).any():
        fold.learn(np.unique(raw[new]))
        n = fold.length[raw]
    origin = np.repeat(np.arange(len(raw), dtype=np.int32), n)
    first = np.cumsum(n, dtype=np.int64) - n
    within = np.arange(len(origin), dtype=np.int64) - first[origin]
    return fold.codes[fold.offset[raw[origin]] + within], origin


def without_inserts(text: str) -> str:
    return _INSERT.sub(" ", text) if any(x in text for x in "([（【{") else text


def seeds(n: int, words: int, part: float = PART) -> tuple[int, int]:
    """(length of the windows searched for, how many different ones must be found) for an item of ``n`` code points.

    A stretch of half of the item, in words of its mean length and misread ones
    half as long again, has as many misread words as are allowed. The rest is
    in runs that hold at least ``keeps`` windows. The first length of which
    they hold some is taken, and half of them, for words of uneven lengths,
    must be found. A stretch of five words or less has none misread, so it
    holds a window of its own length.
    """
    half = max(1, int(np.ceil(part * n)))
    mean = n / max(1, words)
    misread = max(0, int(np.ceil(MISREAD * half / mean)) - 1) if n else 0
    for w in WINDOWS:
        keeps = half - 1.5 * mean * misread - (misread + 1) * (w - 1)
        if keeps >= 1:
            return w, max(1, int(keeps / 2))
    return 1, 1


class Item:
    """A folded item: its code points and the word that each belongs to."""

    def __init__(self, text: str):
        text = without_inserts(text.replace(_SEPARATOR, " "))
        self.codes, origin = fold_text(text)
        unit = np.zeros(len(text), np.int32)
        k = 0
        for m in _UNIT.finditer(text):
            step = 4 if len(m.group()) > 40 else len(m.group())  # scripts without blanks: by fours
            for s in range(m.start(), m.end(), step):
                unit[s : min(s + step, m.end())] = k
                k += 1
        self.unit = np.unique(unit[origin], return_inverse=True)[1] if len(origin) else origin
        self.sizes = np.bincount(self.unit) if len(origin) else np.zeros(0, np.int64)
        self.window, self.least = seeds(len(self.codes), len(self.sizes))


def _hash(codes: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """64-bit hash of the ``n`` code points that end at each of ``ends``."""
    h = np.zeros(len(ends), np.uint64)
    for k in range(n - 1, -1, -1):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[ends - k].astype(np.uint64) + np.uint64(1)
        h ^= h >> np.uint64(29)
    return h


class WuManber:
    """Shift table, buckets and comparison for all windows of the items, also those that many items share.

    Windows stay where they are in the items' joined code points ``flat``, so
    that each costs 16 bytes beside them.
    """

    def __init__(self, flat: np.ndarray, first: np.ndarray, size: np.ndarray, window: int):
        self.flat, self.window, self.block = flat, window, min(5, window // 2 + 1)
        n = np.maximum(0, size - window + 1)
        self.bits = max(HASH_BITS, min(28, (4 * int(n.sum())).bit_length()))
        self.table = np.full(1 << self.bits, window - self.block + 1, np.int8)
        self.empty = not n.sum()
        if self.empty:
            return
        who = np.repeat(np.arange(len(size), dtype=np.int32), n)
        where = (np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
        key = _hash(flat, first[who] + where + window - 1, window)
        order = np.argsort(key, kind="stable")
        key, self.who, self.where = key[order], who[order], where[order]
        self.start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        self.keys = key[self.start]
        self.stop = np.r_[self.start[1:], len(key)]
        self.at = first[self.who[self.start]] + self.where[self.start]
        for j in range(self.block - 1, window):
            np.minimum.at(self.table, self._slot(flat, self.at + j), np.int8(window - 1 - j))

    def _slot(self, codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (_hash(codes, ends, self.block) >> np.uint64(64 - self.bits)).astype(np.int64)

    def search(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start of an occurrence, number of its window), confirmed; ordered by start."""
        n, w = len(codes), self.window
        at = np.arange(w - 1, n, LANE, dtype=np.int64)
        stop = np.minimum(at + LANE, n)
        ends = []
        while len(at):
            shift = self.table[self._slot(codes, at)]
            ends.append(at[shift == 0])
            at = at + np.maximum(shift, 1)
            go = at < stop
            if not go.all():
                at, stop = at[go], stop[go]
        ends = np.sort(np.concatenate(ends)) if ends else np.zeros(0, np.int64)
        h = _hash(codes, ends, w)
        k = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        hit = self.keys[k] == h
        ends, k = ends[hit], k[hit]
        same = np.ones(len(ends), bool)
        for j in range(w):
            same &= codes[ends - (w - 1) + j] == self.flat[self.at[k] + j]
        return ends[same] - (w - 1), k[same]


def covered(n: int, segs: np.ndarray) -> np.ndarray:
    """Which of ``n`` code points lie in one of the segments."""
    edge = np.bincount(segs[:, 0], minlength=n + 1) - np.bincount(segs[:, 1], minlength=n + 1)
    return np.cumsum(edge[:n]) > 0


def best_runs(kept: np.ndarray, sizes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points, words, misread words) of the largest run of words, from one read right to another, with few misread.

    Several items at once: words of item ``i`` begin at ``starts[i]``; of each
    word ``kept`` code points of its ``sizes`` are found. An item without a
    word read right has a run of 0.
    """
    good = kept >= sizes
    other = (kept < FOREIGN * sizes) & (sizes > 2)  # another word, not a misread one
    at = np.flatnonzero(good)
    out = np.zeros((3, len(starts)), np.int64)
    if not len(at):
        return tuple(out)
    mine = np.searchsorted(starts, at, side="right") - 1
    size = np.r_[0, np.cumsum(sizes)]
    bad = np.r_[0, np.cumsum(~good + 2 * other)]
    left = 1000 * bad - round(1000 * MISREAD) * np.arange(len(bad))  # falls from start to end where few are misread
    apart = mine * (int(left.max() - left.min()) + 1)  # later items lie above all earlier ones
    first = at[np.searchsorted(np.maximum.accumulate(left[at] + apart), left[at + 1] + apart, side="right")]
    length = size[at + 1] - size[first]
    order = np.lexsort((-length, mine))
    k = order[np.flatnonzero(np.r_[True, mine[order][1:] != mine[order][:-1]])]
    out[:, mine[k]] = length[k], at[k] + 1 - first[k], bad[at[k] + 1] - bad[first[k]]
    return tuple(out)


def judged(item: Item, mask: np.ndarray) -> tuple[float, int, int]:
    """(share of the item, words, misread words) of its best run, where ``mask`` says which code points are found."""
    n, words, bad = best_runs(np.bincount(item.unit, weights=mask), item.sizes, np.zeros(1, np.int64))
    return float(n[0]) / len(item.codes), int(words[0]), int(bad[0])


def carried(item: Item, found: np.ndarray, least: float = 0.0) -> tuple[float, int, int]:
    """(share of the item, words, misread words) of the best stretch; chains that can't reach ``least`` aren't looked at.

    Chains of segments that ascend in item and document, with short gaps, say
    which words are carried whole. Each segment follows the best one of all
    before it that are near enough, and every chain that no segment goes on
    with is judged.
    """
    n = len(item.codes)
    found = found[np.argsort(found[:, 2], kind="stable")]
    s, e, p = found.T
    q = p + e - s
    near = np.searchsorted(p, p - GAP - 2 * n, side="left")  # a gap is at most GAP + n, a segment at most n
    before = np.searchsorted(p, p, side="left")
    best, prev, root = e - s, np.full(len(found), -1), s.copy()
    for i in range(len(found)):
        j = slice(near[i], before[i])
        over = np.maximum(np.maximum(0, e[j] - s[i]), q[j] - p[i])
        fits = (over < e[i] - s[i]) & (s[j] < s[i]) & (p[i] - q[j] <= GAP + np.maximum(0, s[i] - e[j]))
        gain = np.where(fits, best[j] - over, 0)
        k = int(gain.argmax()) if len(gain) else 0
        if len(gain) and gain[k] > 0:
            best[i] += gain[k]
            prev[i] = near[i] + k
            root[i] = root[prev[i]]
    last = np.setdiff1d(np.arange(len(found)), prev)
    top = (0.0, 0, 0)
    for i in last[np.argsort(-best[last], kind="stable")].tolist():
        if e[i] - root[i] < least * n or e[i] - root[i] <= top[0] * n:
            continue
        chain = []
        while i >= 0:
            chain.append(i)
            i = prev[i]
        top = max(top, judged(item, covered(n, found[chain])), key=lambda x: x[0])
    return top


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, .. (n[0] of them), first[1], .."""
    return np.arange(n.sum()) + np.repeat(first - np.cumsum(n) + n, n)


def _heads(x: np.ndarray) -> np.ndarray:
    """Where a sorted array takes a new value."""
    return np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)


class Finder:
    """All items of one block against batches of documents.

    Items that fold to the same text, divided into the same words, are
    searched for and judged once.
    """

    def __init__(self, texts: list[str], least: float = 0.0):
        self.least = least
        same: dict[tuple[bytes, bytes], list[int]] = {}
        self.items: list[Item] = []
        for i, t in enumerate(texts):
            item = Item(t)
            key = (item.codes.tobytes(), item.unit.tobytes())
            if key not in same:
                self.items.append(item)
            same.setdefault(key, []).append(i)
        self.same = list(same.values())
        self.size = np.array([len(x.codes) for x in self.items], np.int64)
        self.words = np.array([len(x.sizes) for x in self.items], np.int64)
        self.need = np.array([x.least for x in self.items], np.int64)
        self.first, self.first_word = np.cumsum(self.size + 1) - self.size - 1, np.cumsum(self.words) - self.words
        self.flat = np.concatenate([np.r_[x.codes, np.zeros(1, np.uint32)] for x in self.items]) if texts else np.zeros(0, np.uint32)
        self.closed = np.where(self.flat == 0, np.uint32(0xFFFFFFFF), self.flat)
        self.unit = np.concatenate([np.r_[x.unit, np.zeros(1, np.int32)] for x in self.items]) if texts else np.zeros(0, np.int32)
        self.sizes = np.concatenate([x.sizes for x in self.items]) if texts else np.zeros(0, np.int64)
        window = np.array([x.window for x in self.items], np.int64)
        searches = [WuManber(self.flat, self.first, np.where(window == w, self.size, 0), w) for w in WINDOWS if (window == w).any()]
        self.searches = [x for x in searches if not x.empty]

    def batch(self, texts: list[str]) -> list[tuple[int, int, float]]:
        """(document, item, share) for what a batch of texts carries: shares above 0 and of ``least`` or more."""
        if not self.searches or not texts:
            return []
        codes, _ = fold_text(_SEPARATOR.join(without_inserts(t.replace(_SEPARATOR, " ")) for t in texts))
        ends = np.r_[np.flatnonzero(codes == 0), len(codes)]
        out: list[tuple[int, int, float]] = []
        for search in self.searches:
            at, k = search.search(codes)
            doc = np.searchsorted(ends, at, side="right")
            reps = np.cumsum(search.stop[k] - search.start[k])
            s = 0
            while s < len(at):
                e = int(np.searchsorted(reps, (reps[s - 1] if s else 0) + HITS, side="right"))
                e = int(np.searchsorted(doc, doc[e], side="left")) if e < len(at) else e
                e = e if e > s else int(np.searchsorted(doc, doc[s], side="right"))
                out += self._judge(search, codes, ends, at[s:e], k[s:e], doc[s:e])
                s = e
        return out

    def _judge(self, search: WuManber, codes: np.ndarray, ends: np.ndarray, at: np.ndarray, k: np.ndarray, doc: np.ndarray) -> list[tuple[int, int, float]]:
        """What the documents carry in which the windows ``k`` were found at ``at``."""
        reps = search.stop[k] - search.start[k]
        idx = _ranges(search.start[k], reps)
        pos, doc = np.repeat(at, reps), np.repeat(doc, reps)
        item, off = search.who[idx], search.where[idx]
        order = np.argsort((doc.astype(np.int64) * len(self.items) + item << 24) + off, kind="stable")
        pos, item, off, doc = pos[order], item[order], off[order], doc[order]
        new = np.r_[True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])]
        pair, item, doc = np.cumsum(new) - 1, item[new], doc[new]
        distinct = np.bincount(pair[np.r_[True, (pair[1:] != pair[:-1]) | (off[1:] != off[:-1])]])
        may = (distinct >= self.need[item])[pair]
        row = np.sort((pair[may] << 40) + (pos[may] - off[may] + (1 << 32)))
        row = row[_heads(row)]
        pair, diagonal = row >> 40, (row & ((1 << 40) - 1)) - (1 << 32)
        lo, hi = np.r_[0, ends[:-1] + 1][doc], ends[doc]
        out = []
        for mine, segs in self._segments(codes, pair, diagonal, item, lo, hi):
            it = self.items[item[mine]]
            share = carried(it, segs, self.least)[0]
            if share > 0 and share >= self.least:
                out += [(int(doc[mine]), i, share) for i in self.same[item[mine]]]
        return out

    def _segments(self, codes: np.ndarray, pair: np.ndarray, diagonal: np.ndarray, item: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Each pair that may hold enough, with sorted (start, end in the item, start in ``codes``) of the runs of equal code points on its diagonals.

        Runs shorter than 3 are left out, but for items of which single letters are searched for.
        """
        edge = np.zeros(int(self.size.max()) + 1, codes.dtype)
        padded = np.concatenate([edge, codes, edge])
        size = self.size[item[pair]] + 1
        total = np.cumsum(size)
        s = 0
        while s < len(pair):
            e = int(np.searchsorted(total, (total[s - 1] if s else 0) + 2 * HITS, side="right"))
            e = int(np.searchsorted(pair, pair[e], side="left")) if e < len(pair) else e
            e = e if e > s else int(np.searchsorted(pair, pair[s], side="right"))
            n, who, first = size[s:e], pair[s:e], total[s:e] - size[s:e] - (total[s - 1] if s else 0)
            step = np.arange(n.sum())
            at, of = np.repeat(diagonal[s:e] + len(edge) - first, n), np.repeat(self.first[item[who]] - first, n)
            at += step
            of += step
            eq = np.zeros(len(step) + 1, bool)
            np.equal(padded[at], self.closed[of], out=eq[1:])  # an item's end equals nothing
            start = np.flatnonzero(eq[1:] & ~eq[:-1])
            stop = np.flatnonzero(eq[:-1] & ~eq[1:])
            line = np.searchsorted(first, start, side="right") - 1
            there = start - first[line] + diagonal[s:e][line]
            long = (stop - start >= np.minimum(3, -(-n[line] // 2))) & (there >= lo[who[line]]) & (there < hi[who[line]])  # runs end with their document
            start, stop, line = start[long], stop[long], line[long]
            found = np.stack([who[line], start - first[line], stop - first[line], start - first[line] + diagonal[s:e][line]], 1)
            cut = np.r_[_heads(found[:, 0]), len(found)]
            for i in np.flatnonzero(self._may_hold(found, cut, item)).tolist():
                part = found[cut[i] : cut[i + 1]]
                yield int(part[0, 0]), part[np.lexsort(part.T[::-1])][:, 1:]
            s = e

    def _may_hold(self, found: np.ndarray, cut: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Which pairs (rows ``cut[i]`` to ``cut[i + 1]``) reach ``least`` with all their segments, of which a chain has some."""
        who = item[found[cut[:-1], 0]]
        n, words = self.size[who], self.words[who]
        base, word = np.cumsum(n) - n, np.cumsum(words) - words
        mine = np.repeat(np.arange(len(who)), np.diff(cut))
        edge = np.bincount(base[mine] + found[:, 1], minlength=n.sum() + 1) - np.bincount(base[mine] + found[:, 2], minlength=n.sum() + 1)
        unit = self.unit[_ranges(self.first[who], n)] + np.repeat(word, n)
        kept = np.bincount(unit, weights=np.cumsum(edge[:-1]) > 0, minlength=words.sum())
        return best_runs(kept, self.sizes[_ranges(self.first_word[who], words)], word)[0] >= self.least * n


_SCORED = "doc_id long, text_no int, share double"


def scored(documents: DataFrame, texts: list[str], least: float = 0.0) -> DataFrame:
    """(doc_id, text_no, share): how much of each text a document carries in one stretch; shares under ``least`` are left out."""
    given, name = documents.sparkSession.sparkContext.broadcast(texts), uuid.uuid4().hex

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if _KEPT.get("finder", ("",))[0] != name:  # one index a worker process, however many tasks it runs
            _KEPT.pop("finder", None)
            _KEPT["finder"] = (name, Finder(given.value, least))
        finder = _KEPT["finder"][1]
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            upto = np.cumsum([len(t) for t in texts]) // TOGETHER
            for s, e in pairwise([*_heads(upto).tolist(), len(texts)]):
                hits = finder.batch(texts[s:e])
                yield pa.RecordBatch.from_arrays([pa.array([ids[s + d] for d, _, _ in hits], pa.int64()), pa.array([i for _, i, _ in hits], pa.int32()), pa.array([x for _, _, x in hits], pa.float64())], ["doc_id", "text_no", "share"])

    return pick(documents, "doc_id", "text").where("text is not null").mapInArrow(find, _SCORED)


def leaks(documents: DataFrame, items: DataFrame, part: float = PART) -> DataFrame:
    """(doc_id, item_id): documents that carry at least ``part`` of an item in one stretch.

    Items with equal texts are searched for once and all reported; null texts
    of either table find nothing, and neither do items without a letter or
    digit. The items are the stated query set: they are sent to the tasks in blocks
    of about :data:`ITEM_BLOCK` texts or :data:`BLOCK_CHARS` code points, and
    the documents never move.
    """
    spark = documents.sparkSession
    texts = pick(items, "item_id", "text").where("text is not null").groupBy("text").agg(F.sort_array(F.collect_set("item_id")).alias("ids"))
    n, chars = texts.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.char_length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // ITEM_BLOCK), -(-chars // BLOCK_CHARS))
    out = None
    for b in range(blocks):
        mine = texts.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b).orderBy("text").collect()
        numbered = spark.createDataFrame([(i, list(r.ids)) for i, r in enumerate(mine)], "text_no int, ids array<long>")
        hits = scored(documents, [r.text for r in mine], part)
        found = hits.join(F.broadcast(numbered), "text_no").select("doc_id", F.explode("ids").alias("item_id"))
        out = found if out is None else out.unionByName(found)
    return out.distinct()
