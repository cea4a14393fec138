"""Problem 7: sentence boundaries across languages and scripts.

Paragraphs end at blank lines. Within one, every run of end marks and every
gap between words of a script without spaces is a node of a lattice with two
readings, inside a sentence or its end; each reading has a cost, and so has
each sentence that two ends leave between them (a mark alone, a list number
alone). The cheapest path through the lattice gives the sentences. Matched
quotations and brackets are edges that skip the marks they hold.

Costs of a mark come from the mark, the token before it (abbreviation,
initial, number) and what follows. Costs of a gap in a spaceless script come
from word lattices: the runs on both sides are segmented by a dictionary of
function words, unknown stretches at a cost by letter, and the gap is read by
the final particle before it and the opening or following word behind it.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_right
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from lipika.session import pick

# Marks, quotation pairs and abbreviations by what they ask for.
HARD = "!?।॥᱾᱿؟。！？።။៕។༎།෴։"
SOFT = ".．۔|…"
OPEN = {"“": "”", "‘": "’", "«": "»", "「": "」", "『": "』", "(": ")", "[": "]", "（": "）", "【": "】"}
BRACKETS = "([（【"
CLOSERS = "”’»」』)]）】\""
TITLES = frozenset("dr prof mr mx mrs ms st sr jr rev hon gen col capt sgt lt cpl cmdr maj adm gov sen rep pres श्री श्रीम श्रीमती कु पं डॉ प्रो सुश्री मो স্রী শ্রী শ্রীমতী কু মো ডা প্রো ডঃ ডক্টর মিঃ ᱯᱨ ᱰᱟ ᱥᱨ ڈاکٹر پروفیسر".split())
NUMBERED = frozenset("fig figs vol vols no nos p pp ch sec eq tab pl art jan feb mar apr jun jul aug sept sep oct nov dec पृ सं नं क्र খণ্ড নং পৃ সং ᱥᱟ ص نمبر".split())
WITHIN = frozenset("approx cf viz vs e.g i.e eg ie ca al resp".split())
#: Names of companies end so; what follows tells whether the sentence ends too.
COMPANY = frozenset("inc corp ltd co bros llc plc".split())
INITIALS = frozenset("ए बी सी डी ई एफ जी एच आई जे के एल एम एन ओ पी क्यू आर एस टी यू वी डब्ल्यू एक्स वाई ज़ेड এ বি সি ডি ই এফ জি এইচ আই জে কে এল এম এন ও পি কিউ আর এস টি ইউ ভি ডব্লিউ এক্স ওয়াই জেড".split())
#: Initials that are also words which can end a sentence: initials only at its start or in a row of initials.
ALSO_WORDS = frozenset("आई".split())
CONTINUING = frozenset("and into but or nor yet so while as said says wrote asked replied added in on of with for to from then".split())
#: English words that, in lower case, take up a sentence that "etc." interrupted.
AUXILIARIES = frozenset("is are was were be been has have had do does did can could will would shall should may might must which that who than by from at".split())
#: English words that open a sentence rather than being a name.
ENGLISH_OPENERS = frozenset("the a an it he she they we you i this that these those there here his her their our its in on at but and as if when while after before however then so for no not one some what who why how".split())

# Function words of the scripts written without spaces, by what they do at a gap.
#: Words that end a sentence.
FINAL = {
    "ja": "です ます でした ました ません だ た である だった ない ね よ か な わ ぞ さ でしょう だろう ください なさい".split(),
    "th": "ครับ ค่ะ คะ นะ จ้ะ จ้า ล่ะ เถอะ แล้ว ด้วย เลย สิ ซิ หรือ ไหม มั้ย".split(),
    "lo": "ແລ້ວ ເດີ ເນາະ ບໍ ແດ່ ຫວາ ເລີຍ".split(),
    "km": "ហើយ ទេ ណា ផង ហ្មង".split(),
    "my": "တယ် သည် ပါ ဘူး မယ် လား".split(),
}
#: Words that only follow, never open.
FOLLOW = {
    "ja": "と って は が を に の も で へ や から まで より など という といった とか だけ ばかり".split(),
    "th": "ๆ ฯ ฯลฯ".split(),
    "lo": "ໆ ຯ".split(),
    "km": "ៗ ៘".split(),
    "my": "ကို က မှာ နှင့် ၏".split(),
}
#: Words that open a sentence.
OPENER = {
    "ja": "とても ところ ところで とくに ときどき ともかく とりあえず という訳で はい はじめ はっきり がんばれ にわか にもかかわらず もし もう もちろん もっと でも ですが では へえ やがて やはり やっと よって これ それ あれ この その あの しかし そして また だから つまり なぜ 私 彼 彼女".split(),
    "th": "แต่ และ ดังนั้น เพราะ ถ้า เมื่อ ต่อมา นอกจากนี้ อย่างไรก็ตาม เขา เธอ ผม ฉัน เรา มัน นี่ นั่น".split(),
    "lo": "ແຕ່ ແລະ ຖ້າ ເພາະ ຂ້ອຍ ລາວ ເຮົາ ນີ້".split(),
    "km": "ប៉ុន្តែ ព្រោះ ប្រសិនបើ គាត់ ខ្ញុំ នេះ".split(),
    "my": "သူ ကျွန်တော် ဒါပေမယ့် ဒီ".split(),
}
#: What a gap costs as an end before its words are looked at: Thai and Lao set blanks between sentences, the others within them too.
GAP_COST = {"th": -4.0, "lo": -4.0, "ja": 2.5, "km": 2.5, "my": 2.5}
LETTERS = {"th": "ก-๛", "lo": "ກ-ໟ", "km": "ក-៓ៗ៘", "my": "က-၉ၐ-႟", "ja": "ぁ-ヿ一-鿿々"}

#: Costs: a mark whose reading is plain, one that is likely, a sentence without a word, a list number alone.
PLAIN, LIKELY, EMPTY, NUMBER_ALONE = 3.0, 1.0, 20.0, 8.0
UNKNOWN_LETTER = 1.2

NL = r"(?:\r\n|[\n\r\x85  ])"
PARAGRAPH = re.compile(NL + r"(?:[^\S\n\r\x85  ]*" + NL + r")+")
GAP = "|".join(rf"(?<=[{x}])\s+(?=[{x}])" for x in LETTERS.values())
EVENT = re.compile(r"[\"“”‘’«»「」『』()\[\]（）【】]|[" + re.escape(HARD + SOFT) + r"]+|" + GAP)
RUN = {k: re.compile(f"[{x}]+") for k, x in LETTERS.items()}
WORD = re.compile(r"[A-Za-z]+")
NOT_BLANK = re.compile(r"\S")
HIDDEN = re.compile(r"[­​-‏⁠-⁤﻿]")
DOTTED = re.compile(r"[^\W\d_]\S{0,2}(?:\.[^\W\d_][^\W\d_.]?\S{0,2})+\Z")
LIST_NUMBER = re.compile(r"\s*[(（\[]?\w{1,4}[.)）\]]?\s*\Z")
HARD_SET, LINE_BREAKS = frozenset(HARD), "\r\n\x85  "
#: No abbreviation has more letters, with the invisible ones that may be among them.
LONGEST = 4 * max(map(len, TITLES | NUMBERED | WITHIN | INITIALS | COMPANY | {"p.m.x.x"}))

_KEPT: dict[str, ahocorasick.Automaton] = {}


def _lexicon(script: str) -> ahocorasick.Automaton:
    if script not in _KEPT:
        auto = ahocorasick.Automaton()
        for w in {*FINAL[script], *FOLLOW[script], *OPENER[script]}:
            auto.add_word(w, len(w))
        auto.make_automaton()
        _KEPT[script] = auto
    return _KEPT[script]


def lattice_words(run: str, script: str) -> list[str]:
    """The cheapest segmentation of a run without blanks: a dictionary word costs 1, an unknown letter 1.2.

    Neighbouring unknown letters are one word. Nodes are the places where a
    dictionary word ends, so only those are looked at.
    """
    ends, nodes = [0], [(0.0, 0, -1)]  # where a node's word ends; (cost, where the word starts, the node before)
    best = [0]  # of the nodes up to here, the one from which unknown letters go on at least cost
    lead = lambda k: nodes[k][0] - UNKNOWN_LETTER * ends[k]
    for end, start in sorted((end + 1, end + 1 - n) for end, n in _lexicon(script).iter(run)):
        k = best[bisect_right(ends, start) - 1]
        ends.append(end)
        nodes.append((lead(k) + UNKNOWN_LETTER * start + 1, start, k))
        best.append(len(nodes) - 1 if lead(len(nodes) - 1) < lead(best[-1]) else best[-1])
    out, k, upto = [], best[-1], len(run)
    while k >= 0:
        if ends[k] < upto:
            out.append(run[ends[k] : upto])
        _, start, before = nodes[k]
        if before >= 0:
            out.append(run[start : ends[k]])
        k, upto = before, start
    return out[::-1]


_FINAL, _FOLLOW, _OPENER = ({k: frozenset(v) for k, v in x.items()} for x in (FINAL, FOLLOW, OPENER))


def _script(c: str) -> str:
    return next(k for k, r in RUN.items() if r.match(c))


class _Runs:
    """Segmented runs of a paragraph, each once: those on both sides of its gaps."""

    def __init__(self, text: str):
        self.text, self.ended = text, (-1, [""])

    def behind(self, at: int, end: int, script: str) -> list[str]:
        stop = RUN[script].match(self.text, at, end).end()
        if self.ended[0] != stop:
            self.ended = (stop, lattice_words(self.text[at:stop], script))
        return self.ended[1]

    def before(self, start: int, at: int, script: str) -> list[str]:
        if self.ended[0] != at:
            k = at
            while k > start and RUN[script].match(self.text[k - 1]):
                k -= 1
            self.ended = (at, lattice_words(self.text[k:at], script))
        return self.ended[1]


def _carries_on(text: str, at: int, end: int) -> bool:
    """Whether what stands behind a closed quotation or bracket belongs to the same sentence."""
    m = NOT_BLANK.search(text, at, end)
    if not m:
        return False
    c = m.group()
    if c in "—–―-,;:،؛、，；：" or c in HARD or c in SOFT:
        return True
    run = RUN["ja"].match(text, m.start(), end)
    if run:
        return lattice_words(run.group(), "ja")[0] in _FOLLOW["ja"]
    if "ก" <= c <= "๛":
        return True
    w = WORD.match(text, m.start(), end)
    return bool(w) and (c.islower() or len(w.group()) > 1 and w.group().isupper() and w.group().lower() in CONTINUING)  # AND, INTO in capitals


def _gap(text: str, runs: _Runs, start: int, s: int, e: int, end: int) -> tuple[float, float]:
    """(cost inside a sentence, cost as its end) of a gap between two letters of a spaceless script."""
    script = _script(text[e])
    if not text[s:e].strip(LINE_BREAKS) or not RUN[script].match(text[s - 1]):
        return 0.0, PLAIN  # a line break alone, or a change of script, is no gap
    before, behind = runs.before(start, s, script)[-1], runs.behind(e, end, script)[0]
    cost = GAP_COST[script]
    cost -= 2.0 * (before in _FINAL[script])
    cost += 8.0 * (behind in _FOLLOW[script])
    cost -= 2.0 * (behind in _OPENER[script])
    return 0.0, cost


class _Marks:
    """What the text before a mark says about it, for the marks of one paragraph from left to right."""

    def __init__(self, text: str, start: int, end: int):
        self.text, self.start, self.end = text, start, end  # ``start``: where the present sentence seems to begin

    def token(self, s: int) -> tuple[str, int]:
        """(the word that the mark at ``s`` follows, where it starts); a longer one than any abbreviation is cut short."""
        lo = max(self.start, s - LONGEST)
        part = self.text[lo:s]
        if not part or part[-1].isspace():
            return "", s
        word = part.rsplit(None, 1)[-1]
        return HIDDEN.sub("", word).lstrip("([（【“‘«「『\""), s - len(word)

    def last_letter(self, s: int) -> str:
        """The last letter that is no blank before ``s``, in the present sentence."""
        while s > self.start and self.text[s - 1].isspace():
            s -= 1
        return self.text[s - 1] if s > self.start else ""

    def soft(self, s: int, e: int) -> tuple[float, float, bool]:
        """(cost inside, cost as an end, whether the word before is a number) of full stops, bars or dots at [s, e)."""
        end = self.reads_as_end(s, e)
        if isinstance(end, bool):
            end = PLAIN if end else -PLAIN
        word = self.token(s)[0]
        return max(end, 0.0), max(-end, 0.0), bool(word) and word.rstrip(")").isdigit()

    def reads_as_end(self, s: int, e: int) -> bool | float:
        """Whether the mark ends its sentence: plainly, or by how much that reading is the cheaper one."""
        text, end = self.text, self.end
        run, before = text[s:e], text[s - 1] if s > self.start else ""
        m = NOT_BLANK.search(text, e, end)
        if not m or not before:
            return bool(before)
        nxt, spaced, lower = m.group(), m.start() > e, "a" <= m.group() <= "z"
        if "|" in run:
            last = self.last_letter(s)
            return bool(last) and not ("a" <= last.lower() <= "z") and not (before.isspace() and last.isascii() and last not in CLOSERS)
        if before.isspace():
            return run != "…" and (len(run) == 1 or len(run) > 3 and not lower)  # a mark set off by a blank ends, a row of dots set off goes on
        if len(run) > 1 or run == "…":
            return LIKELY if spaced and not lower else -LIKELY
        if not spaced and nxt not in CLOSERS:
            # No blank follows: numbers, names of files, a.b forms; but scripts that write on without one.
            if before.isdigit() or nxt.isdigit() or before.isascii() or nxt.isascii() and "۔" not in run:
                return False
        token, at = self.token(s)
        low = token.lower().replace("۔", ".")
        if not token:
            return True
        if low.rstrip(")").isdigit():
            return not LIST_NUMBER.match(text, self.start, s)
        if low in TITLES or low in WITHIN:
            return False
        if low in NUMBERED:
            return not nxt.isdigit()
        if low in ("a.m", "p.m"):
            return LIKELY if nxt.isupper() else -LIKELY
        if low == "etc":
            w = WORD.match(text, m.start(), end)
            return -LIKELY if lower and w.group() in CONTINUING | AUXILIARIES else LIKELY
        if low in COMPANY:
            w = WORD.match(text, m.start(), end)
            return -LIKELY if lower or w and w.group().lower() not in ENGLISH_OPENERS else LIKELY
        if low in ALSO_WORDS:
            first = NOT_BLANK.search(text, self.start, s)
            return LIKELY if first.start() < at and self.last_letter(at) != "." else -LIKELY
        if low in INITIALS or DOTTED.match(low) and len(low) < 9:
            return False
        if not spaced and nxt not in CLOSERS:
            return sum(c.isalpha() for c in token) > 1
        base = [c for c in token if c.isalpha()]
        if len(token) == 1 or len(base) == 1 and len(token) <= 2 and not token.isascii() and ("᱐" <= token[0] <= "᱿" or "؀" <= token[0] <= "ۿ"):
            return not token.isalpha()  # an initial
        return True


def boundaries(text: str) -> list[tuple[int, int]]:
    """(start, end) of every sentence, in code points, without blanks around it; no text, no sentence."""
    out: list[tuple[int, int]] = []
    at = 0
    for gap in PARAGRAPH.finditer(text):
        _paragraph(text, at, gap.start(), out)
        at = gap.end()
    _paragraph(text, at, len(text), out)
    return out


def _pairs(text: str, events: list[tuple[int, int]]) -> dict[int, int]:
    """For each event that opens a quotation or bracket, the event that closes it; in one pass."""
    out: dict[int, int] = {}
    waiting: dict[str, list[int]] = {}
    straight = -1
    for k, (s, _) in enumerate(events):
        c = text[s]
        if c == '"':
            if straight >= 0:
                out[straight] = k
            straight = k
        elif c in OPEN:
            waiting.setdefault(OPEN[c], []).append(k)
        elif waiting.get(c):
            out[waiting[c].pop()] = k
    return out


#: A node: where its mark, quotation or gap begins, where a sentence that it ends stops, where the next begins, costs inside and as an end, kind.
_Node = tuple[int, int, int, float, float, str]


def _nodes(text: str, a: int, b: int) -> list[_Node]:
    """The nodes of the paragraph [a, b), with the costs of their readings."""
    events = [(x.start(), x.end()) for x in EVENT.finditer(text, a, b)]
    pair, marks, runs = _pairs(text, events), _Marks(text, a, b), _Runs(text)
    out: list[_Node] = []
    i, at, n = 0, a, len(events)
    while i < n:
        s, e = events[i]
        i += 1
        if s < at:
            continue
        c = text[s]
        number = False
        if c == '"' or c in OPEN:
            j = pair.get(i - 1, n)
            if j >= n:
                continue  # nothing closes it: an apostrophe, or a mark that was lost
            at = events[j][1]
            i = j + 1
            k = at - 1
            while k > s + 1 and (text[k - 1].isspace() or text[k - 1] in CLOSERS):
                k -= 1
            if k == s + 1 or text[k - 1] not in HARD and text[k - 1] not in SOFT:
                continue
            inside, end = (0.0, PLAIN) if _carries_on(text, at, b) else (PLAIN, 0.0)
            out.append((s, at, at, inside, end, "bracket" if c in BRACKETS else "quote"))
            continue
        if c in CLOSERS:
            continue
        if c.isspace():
            inside, end = _gap(text, runs, a, s, e, b)
            out.append((s, s, e, inside, end, "gap"))
            continue
        if any(x in HARD_SET for x in text[s:e]):
            inside, end = PLAIN, 0.0
        else:
            inside, end, number = marks.soft(s, e)
        while e < b and text[e] in CLOSERS and text[e] != '"':
            e += 1
        at = e
        out.append((s, e, e, inside, end, "number" if number else "mark"))
        if end < inside:
            marks.start = e
    return out


def _between(text: str, lo: int, hi: int, kind: str) -> float:
    """What a sentence costs for holding too little between its start and the node that ends it."""
    part = text[lo:hi]
    if not part or part.isspace():
        return EMPTY if kind in ("mark", "number") else 0.0
    if kind in ("number", "bracket") and LIST_NUMBER.match(part):
        return NUMBER_ALONE if kind == "number" else 0.0
    return EMPTY if kind == "bracket" else 0.0  # a bracket behind words belongs to them


def _cheapest(text: str, a: int, nodes: list[_Node]) -> list[int]:
    """The nodes that are ends on the cheapest path through the lattice of a paragraph that begins at ``a``."""
    n = len(nodes)
    # ``cost``, ``back``: of the cheapest path on which node j (1..n, 0 is the start) is an end. ``inside``: costs of reading all nodes before as inside.
    cost, back, inside = [0.0], [0], [0.0, 0.0]
    best = [0]  # up to each node, the end from which a path goes on at least cost
    for j, (s, _, _, i_cost, e_cost, kind) in enumerate(nodes, 1):
        k, low, at = j - 1, float("inf"), 0
        while k >= 0:  # ends so near that little lies between: at most the letters of a list number
            begin = nodes[k - 1][2] if k else a
            if s - begin > 6 and len(text[begin:s].strip()) > 6:
                break
            c = cost[k] - inside[k + 1] + _between(text, begin, s, kind)
            if c < low:
                low, at = c, k
            k -= 1
        if k >= 0:
            k = best[k]
            c = cost[k] - inside[k + 1] + (EMPTY if kind == "bracket" else 0.0)
            if c < low:
                low, at = c, k
        c = low + inside[j] + e_cost
        if j < n and nodes[j][5] in ("mark", "number") and text[nodes[j - 1][2] : nodes[j][0]].strip() == "":
            c += EMPTY  # the next mark stands alone, so it belongs to this sentence
        cost.append(c)
        back.append(at)
        inside.append(inside[j] + i_cost)
        best.append(j if c - inside[j + 1] < cost[best[-1]] - inside[best[-1] + 1] else best[-1])
    path, k = [], best[n]
    while k:
        path.append(k - 1)
        k = back[k]
    return path[::-1]


def _paragraph(text: str, a: int, b: int, out: list[tuple[int, int]]) -> None:
    """The sentences of one paragraph."""
    m = NOT_BLANK.search(text, a, b)
    if not m:
        return
    a = m.start()
    nodes = _nodes(text, a, b)
    for k in _cheapest(text, a, nodes):
        out.append((a, nodes[k][1]))
        m = NOT_BLANK.search(text, nodes[k][2], b)
        if not m:
            return
        a = m.start()
    while text[b - 1].isspace():
        b -= 1
    out.append((a, b))


_ROWS = "doc_id long, start_pos int, end_pos int"


def sentences(documents: DataFrame) -> DataFrame:
    """(doc_id, start_pos, end_pos): every sentence of every document.

    Null, empty and blank texts give no rows; a text without end mark is one
    sentence (or one for each paragraph). Repeated rows repeat their sentences.
    Each text is cut where it lies, without a shuffle.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, starts, ends = array("q"), array("i"), array("i")
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if t:
                    for s, e in boundaries(t):
                        ids.append(d)
                        starts.append(s)
                        ends.append(e)
            cols = [pa.Array.from_buffers(kind, len(x), [None, pa.py_buffer(x)]) for kind, x in ((pa.int64(), ids), (pa.int32(), starts), (pa.int32(), ends))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start_pos", "end_pos"])

    return pick(documents, "doc_id", "text").where("text is not null and doc_id is not null").mapInArrow(cut, _ROWS)
