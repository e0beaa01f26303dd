"""Problem 2: sentence boundaries with a hidden-event n-gram language model.

Text becomes a stream of symbols. At every place where a sentence might end a hidden event, boundary or none, stands between two
symbols. An n-gram model with back-off, estimated from labelled text, gives the probability of symbols and events; forward-backward
sums over all event sequences and gives the posterior of each boundary. First come the places with a mark (after every terminator with
its closing marks, at line ends, at spaces of Thai). Then, in each stretch between the boundaries found there, all places between words,
and between the characters of Chinese and Japanese: the stretch may be written without marks, and its words say how likely that is.
"""

from __future__ import annotations

import functools
import itertools
import math
import random
from collections import Counter

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import is_empty, spec, spread
from .refusals import DECLINED, SAID
from .seed_sentences import SEED

# Abbreviations by how they behave: before a name, before a number or reference, within a sentence only, or also at its end.
ABBREVIATIONS = {
    "title": "mr mrs ms messrs dr drs prof sen gov gen col capt cpt lt sgt maj adm rev fr hon st mt ft pres rep supt insp sr sra srta dra drª d dña da hr hrn fr frl dipl ing mag mme mlle mm me mgr pr г-н г-жа проф акад доц им ул д-р डॉ श्री प्रो पं สม ดร นาย".split(),
    "cite": "no nos nr nrn art arts sec secs sect sched para paras par p pp pg fig figs vol vols ch chap cl reg regs app ex eq ed eds abs ziff kap s ziffer núm num nº n pág págs pag cap inc arts ст п пп стр гл рис табл разд см abb tab bd anm rn sez ref rs rz सं पृ ข้อ หน้า".split(),
    "mid": "e.g i.e eg ie cf viz vs v ca approx incl excl al ff f esp z.b z d.h d u.a u o.ä bzw ggf evtl sog inkl zzgl vgl c.-à-d env aprox прим ок напр т.е т тел gest geb max min avg dept univ jan feb mar apr jun jul aug sep sept oct nov dec janv févr avr juil déc ene abr ago dic fev out dez янв февр апр авг сент окт нояб дек fa par.ex p.ex रु".split(),
    "end": "etc inc ltd corp co llc plc jr sr bros a.m p.m am pm u.s u.k e.u usw usf u.s.w ag gmbh etc. ss a.d b.c h std min g kg km cm mm руб г гг коп тыс млн млрд кв д др пр uu ee.uu cia ltda s.a s.l pt ud uds vd".split(),
}
MONTHS = set(
    "january february march april may june july august september october november december januar februar märz mai juni juli oktober dezember jahrhundert quartal kapitel "
    "janvier février mars avril juin juillet août septembre octobre novembre décembre".split()
)
_KIND = {w: k for k in ("end", "mid", "cite", "title") for w in ABBREVIATIONS[k]}
_NEWLINES = regex.compile(r"[\n\r\x0b\x0c\x85  ]")

_TOKEN = regex.compile(
    r"""(?P<run>(?:\p{Ll}+[ ])+(?=\p{Ll}))
    |(?P<url>(?:https?://|www\.)\S*[^\s.,;:!?)\]"'”’»]|[\w-]+(?:\.[\w-]+)+/[^\s,;]*[^\s.,;:!?)\]"'”’»]|[\w.+-]+@[\w-]+(?:\.[\w-]+)+)
    |(?P<num>\p{N}+(?:[.,:/-]\p{N}+)*)
    |(?P<cjk>[\p{Han}\p{Hiragana}\p{Katakana}ー々]+)
    |(?P<thai>[\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]+)
    |(?P<word>(?:\p{L}\.){2,}(?=\s*[\p{Ll},;:)])|(?:\p{L}\.-?)+\p{L}(?![\p{L}\p{M}])|[\p{L}\p{M}]+(?:['’‑-][\p{L}\p{M}\p{N}]+)*[\p{N}]*)
    |(?P<term>(?:[.!?…。！？．｡।॥؟۔]|\.(?=\.))+)
    |(?P<close>[)\]}”’»›」』）】〉》〕]|(?<=\S)["'])
    |(?P<open>[(\[{“‘«‹„‚「『（【〈《〔¿¡"'])
    |(?P<space>\s+)
    |(?P<mark>.)""",
    regex.X | regex.S,
)


def _shape(kind: str, s: str) -> str:
    """Class of a symbol that starts what follows a candidate."""
    if kind == "num":
        return "num"
    if kind == "url":
        return "lower" if s[:1].islower() else "upper"
    if kind == "cjk":
        return "kana" if "぀" <= s[0] <= "ヿ" else "han"
    if kind == "thai":
        return "thai"
    if kind == "word":
        if s.lower() in MONTHS and s[:1].isupper():
            return "month"
        c = s[0]
        if c.islower():
            return "camel" if any(x.isupper() for x in s[1:]) else "lower"
        if c.isupper():
            return "upper"
        return "caseless"
    if kind == "mark":
        return "dash" if s in "—–-" else "comma" if s in ",;:،，、；：" else "mark"
    return kind


def _before(kind: str, s: str, prev: list, line_start: bool) -> str:
    """Class of the symbol before a terminator."""
    if kind == "num":
        return "lnum" if line_start else "num"
    if kind == "word":
        low = s.lower().strip(".")
        if "." in s and low not in _KIND:
            return "end" if len(s.replace(".", "")) > 1 and s.isupper() else "mid"
        k = _KIND.get(low)
        if k == "title" and not (s[:1].isupper() or not s[:1].isalpha() or not s[:1].islower() and not s[:1].isupper()):
            k = "title" if low in ("г-н", "г-жа", "проф", "акад", "доц", "им", "ул") else None
        if k == "cite" and len(low) > 2 and low in ("no", "sec", "par", "ex", "art", "cl", "inc"):
            k = "cite"
        if len(low) == 1 and k is None:
            # single letters: initials, or the second letter of a spaced abbreviation
            if s.isupper():
                return "second" if prev and prev[-1] == "single" else "initial"
            return "single"
        if len(low) == 1 and prev and prev[-1] == "single":
            return "second"
        if len(low) == 1 and s.isupper() and low not in ("p", "s", "n"):
            return "initial"
        return k or ("upper" if s[:1].isupper() else "lower" if s[:1].islower() else "caseless")
    if kind in ("cjk", "thai"):
        return kind
    return "mark"


def candidates(text: str) -> list[dict]:
    """Places where a sentence might end, in order: end (code points up to and with closing marks), sym (its symbol, with ever
    coarser forms), nxt (the symbol after it) and gap (words since the last place)."""
    toks = [(m.lastgroup, m.group(), m.start(), m.end()) for m in _TOKEN.finditer(text)]
    out, words, singles = [], 0, []
    depth: list[tuple[str, str]] = []  # open quotes and brackets with what stood before them
    n = len(toks)
    i = 0
    thai = False  # Thai stands before this place
    while i < n:
        kind, s, a, b = toks[i]
        if kind == "run":  # small words with single blanks behind them: no event can stand among them
            words += s.count(" ")
            i += 1
            continue
        if kind in ("word", "num", "url", "cjk", "thai"):
            words += 1 if kind not in ("cjk", "thai") else max(1, len(s) // 2)
            thai = thai or kind == "thai"
            i += 1
            continue
        if kind == "open" or (kind == "close" and s in "\"'" and not any(q == s for q, _ in depth) and (i == 0 or toks[i - 1][0] in ("space", "open"))):
            j = i - 1
            while j >= 0 and toks[j][0] == "space":
                j -= 1
            ctx = "start" if j < 0 or toks[j][0] == "term" or (toks[j][0] == "close" and j and toks[j - 1][0] == "term") or any("\n" in t[1] for t in toks[j + 1 : i] if t[0] == "space") else "colon" if toks[j][1] in ":：" else "mid"
            if s not in "¿¡" and not (s in "'‘’" and i and toks[i - 1][0] == "word"):
                depth.append((s, ctx))
            i += 1
            continue
        if kind == "close" and toks[i - 1][0] != "term":
            if depth and s not in "’'":
                depth.pop()
            i += 1
            continue
        if kind == "term":
            p = toks[i - 1] if i else ("mark", "", 0, 0)
            j, closers, ctx = i + 1, 0, ""
            # French puts a space before the mark inside the quotation
            while j < n and (toks[j][0] in ("close", "term") or toks[j][1] in ("“", "\"", "'") and depth and depth[-1][0] in ("„", "\"", "'", "“") and toks[j][1] != " " or toks[j][0] == "space" and "\n" not in toks[j][1] and j + 1 < n and toks[j + 1][1] in "»" and any(q == "«" for q, _ in depth)):
                if toks[j][0] != "space" and toks[j][0] != "term":
                    if toks[j][1] in "’" and not any(q in "‘‚’" for q, _ in depth):
                        pass
                    closers += 1
                    if depth:
                        ctx = depth.pop()[1]
                j += 1
            e = toks[j - 1][3]
            sp, k = "", j
            while k < n and toks[k][0] == "space":
                sp += toks[k][1]
                k += 1
            lines = len(_NEWLINES.findall(sp.replace("\r\n", "\n")))
            space = "par" if lines > 1 else "line" if lines else "sp" if sp else "none"
            q = k
            opened = False
            while q < n and (toks[q][0] == "open" or toks[q][0] == "close" and toks[q][1] in "\"'") and toks[q][1]:
                opened = True
                q += 1
            nxt = "end" if k >= n else _shape(toks[q][0], toks[q][1]) if q < n else "mark"
            mark = "dot" if set(s) <= set(".．") and len(s) == 1 else "dots" if set(s) <= set(".…．") else "ask" if set(s) & set("?？؟") else "full" if set(s) & set("。｡।॥۔") else "bang"
            jstart = i - 2
            line_start = jstart < 0 or toks[jstart][0] == "space" and "\n" in toks[jstart][1]
            pk = _before(p[0], p[1], singles, line_start) if mark == "dot" else "any"
            if mark == "dot":
                singles.append("single" if pk == "single" or (p[0] == "word" and len(p[1]) == 1) else "")
            inner = "in" if depth and depth[-1][1] != "start" and depth[-1][0] in "“«„「『\"‘" else ""
            close = ("c" + (ctx or "?")) if closers else inner
            if mark in ("dot", "dots") and space == "none" and k < n:
                mark = "tight"  # a full stop with no space after it is a symbol of its own
            out.append({"end": e, "sym": (mark, pk, close), "nxt": (space, nxt, "o" if opened else ""), "gap": words})
            words = 0
            i = j
            if k >= n:
                break
            i = k if space != "none" else j
            continue
        if kind == "space":
            lines = len(_NEWLINES.findall(s.replace("\r\n", "\n")))
            if i and i + 1 < n:
                p, q = toks[i - 1], i + 1
                opened = False
                while q < n and toks[q][0] == "open":
                    opened = True
                    q += 1
                f = toks[q] if q < n else ("mark", "", 0, 0)
                if lines:
                    pk = "comma" if p[1] in ",;:،，、；：-–—" else "word"
                    out.append({"end": p[3], "sym": ("line", pk, ""), "nxt": ("par" if lines > 1 else "line", _shape(f[0], f[1]), "o" if opened else ""), "gap": words})
                    words = 0
                elif (p[0] == "thai" or p[0] == "close" and i > 1 and toks[i - 2][0] == "thai") and f[0] in ("thai", "word", "run", "cjk", "url") or f[0] == "thai" and p[0] in ("word", "cjk", "url", "close") and thai:
                    out.append({"end": p[3], "sym": ("gap", "thai", ""), "nxt": ("sp", _shape(f[0], f[1]), "o" if opened else ""), "gap": words})
                    words = 0
            i += 1
            continue
        i += 1
    return out


def _bucket(words: int) -> str:
    return "0" if words == 0 else "1" if words == 1 else "2" if words <= 3 else "3"


class HiddenEventModel:
    """Back-off n-gram model over (symbol, event, next symbol, words between), with events hidden when a text is read."""

    STRENGTH = 2.0

    def __init__(self):
        self.event: list[Counter] = [Counter() for _ in range(4)]
        self.follow: list[Counter] = [Counter() for _ in range(4)]
        self.length: Counter = Counter()

    @staticmethod
    def _events(sym) -> list:
        mark, pk, close = sym
        return [(), (mark,), (mark, pk), (mark, pk, close)]

    @staticmethod
    def _follows(sym, nxt) -> list:
        space, shape, opened = nxt
        mark, pk, close = sym
        return [(), (mark,), (mark, pk), (mark, pk, close)]

    def learn(self, cands: list[dict], truth: set[int]) -> None:
        prev = "S"
        for c in cands:
            e = "S" if c["end"] in truth else "N"
            for lvl, h in enumerate(self._events(c["sym"])):
                self.event[lvl][h, e] += 1
            for lvl, h in enumerate(self._follows(c["sym"], c["nxt"])):
                self.follow[lvl][h, e, c["nxt"][1]] += 1
                self.follow[lvl][h, e, "space", c["nxt"][0]] += 1
            self.length[prev, e, _bucket(c["gap"])] += 1
            prev = e

    @functools.lru_cache(maxsize=100_000)
    def p_event(self, sym, e: str) -> float:
        p = 0.5
        for lvl, h in enumerate(self._events(sym)):
            n = self.event[lvl][h, "S"] + self.event[lvl][h, "N"]
            p = (self.event[lvl][h, e] + self.STRENGTH * p) / (n + self.STRENGTH)
        return p

    @functools.lru_cache(maxsize=100_000)
    def p_next(self, sym, e: str, nxt) -> float:
        shape = space = 0.05
        for lvl, h in enumerate(self._follows(sym, nxt)):
            both = sum(v for v in (self.follow[lvl][h, e, "space", x] for x in ("none", "sp", "line", "par")))
            shape = (self.follow[lvl][h, e, nxt[1]] + self.STRENGTH * shape) / (both + self.STRENGTH)
            space = (self.follow[lvl][h, e, "space", nxt[0]] + self.STRENGTH * space) / (both + self.STRENGTH)
        return shape * space

    def p_length(self, prev: str, e: str, gap: int) -> float:
        return self._step(_bucket(gap))["SN".index(prev)]["SN".index(e)]

    @functools.lru_cache(maxsize=64)
    def _step(self, bucket: str) -> list[list[float]]:
        """Probability of so many words between two places, by the events at both."""
        return [[(self.length[p, e, bucket] + 2.0) / (sum(self.length[p, e, b] for b in "0123") + 8.0) for e in "SN"] for p in "SN"]

    def posteriors(self, cands: list[dict]) -> list[float]:
        """Probability of a boundary at every candidate, by forward-backward over the two events."""
        return self.chain(cands)[0]

    @functools.lru_cache(200_000)
    def gain(self, sym, nxt) -> float:
        """Log of how much likelier the next symbol is with an event between, of either kind, than as the mere continuation."""
        return math.log(self.p_event(sym, "S") * self.p_next(sym, "S", nxt) / self.p_next(sym, "N", nxt) + self.p_event(sym, "N"))

    def chain(self, cands: list[dict]) -> tuple[list[float], float]:
        """Posteriors, and the log of the sum over all event sequences."""
        if not cands:
            return [], 0.0
        local = [[self.p_event(c["sym"], e) * self.p_next(c["sym"], e, c["nxt"]) for e in "SN"] for c in cands]
        step = [self._step(_bucket(c["gap"])) for c in cands]
        total = 0.0
        fwd, now = [], [local[0][k] * step[0][0][k] for k in (0, 1)]
        for t in range(len(cands)):
            if t:
                now = [local[t][k] * sum(fwd[-1][j] * step[t][j][k] for j in (0, 1)) for k in (0, 1)]
            z = sum(now) or 1.0
            total += math.log(z)
            now = [x / z for x in now]
            fwd.append(now)
        back, out = [1.0, 1.0], [0.0] * len(cands)
        for t in range(len(cands) - 1, -1, -1):
            a = [fwd[t][k] * back[k] for k in (0, 1)]
            out[t] = a[0] / ((a[0] + a[1]) or 1.0)
            back = [sum(step[t][j][k] * local[t][k] * back[k] for k in (0, 1)) for j in (0, 1)]
            z = sum(back) or 1.0
            back = [x / z for x in back]
        return out, total


@functools.lru_cache(1)
def model() -> HiddenEventModel:
    """The model, estimated from the labelled sentences joined in many orders and ways; the same on every machine."""
    rng, m = random.Random(7), HiddenEventModel()
    for lang, block in SEED.items():
        lines = [x for x in block.split("\n") if x]
        tight = lang in ("zh", "ja")
        for _ in range(40):
            picked = rng.sample(lines, len(lines))
            if rng.random() < 0.15:
                picked = [x.upper() for x in picked]
            text, truth = "", set()
            for x in picked:
                if text:
                    r = rng.random()
                    text += "\n\n" if r < 0.08 else "\n" if r < 0.2 else ("" if tight else "  " if r < 0.25 else "" if r < 0.3 and lang != "th" else " ")
                text += x
                truth.add(len(text))
            m.learn(candidates(text), truth)
    return m


_TIGHT = r"\p{Han}\p{Hiragana}\p{Katakana}ー々"  # scripts without spaces whose characters are symbols
_PLAIN = regex.compile(rf"[{_TIGHT}]|[^\s{_TIGHT}]+")
_SPACELESS = regex.compile(rf"[{_TIGHT}\p{{Thai}}\p{{Lao}}\p{{Khmer}}\p{{Myanmar}}]")
_CLOSING = regex.compile(r"[.!?…。！？।|]+[\"'”’»)\]」』]*$|[,;:]$")
#: What ends nothing: a space of Thai beside a number, a place right before a closing mark.
_WITHIN = regex.compile(r"(?<=\p{Thai})\s+(?=\p{N})|(?<=\p{N})\s+(?=\p{Thai})|(?![\p{Ps}\p{Pi}])[\p{P}\p{S}]")
SURE = 0.65  # posterior of a boundary between words without a mark; below it the words are read as one sentence
RARE = 0.02  # share of stretches that are written without marks in texts that have marks
_ROUNDS = 10  # orders in which the sentences are joined for training
_KANA, _HAN, _THAI = regex.compile(r"[\p{Hiragana}\p{Katakana}]"), regex.compile(r"\p{Han}"), regex.compile(r"\p{Thai}")
_LETTERS = regex.compile(r"[\p{L}\p{M}]+")
_COMMON_LEAST = 2  # times that a word stands in the training text to be a symbol of its own


@functools.lru_cache(1)
def _plain_lines() -> dict[str, list[str]]:
    """Labelled sentences without their final marks by language. Clauses labelled for another purpose go to the language that they share
    most words with, or else to that of the clause before."""
    by = {lang: block.split("\n") for lang, block in SEED.items()}
    known = {lang: {w for line in lines for w in _LETTERS.findall(line.lower())} for lang, lines in by.items()}
    lang = "en"
    for line in (SAID + "\n" + DECLINED).split("\n"):
        script = next((k for k, found in (("ja", _KANA), ("zh", _HAN), ("th", _THAI)) if found.search(line)), None)
        words = set(_LETTERS.findall(line.lower()))
        best = max(known, key=lambda k: (len(words & known[k]), k == lang))
        lang = script or (best if words & known[best] else lang)
        by[lang].append(line)
    return {lang: [_CLOSING.sub("", x) for x in lines if x] for lang, lines in by.items()}


@functools.lru_cache(1)
def _common() -> frozenset:
    n = Counter(w for lines in _plain_lines().values() for line in lines for w in (x.lower().strip("“”\"'«»„(),.;:!?…") for x in line.split()) if w)
    return frozenset(w for w, c in n.items() if c >= _COMMON_LEAST)


@functools.lru_cache(100_000)
def _word(w: str) -> str:
    """Symbol of a word: itself if it is common, else its shape; a capital goes before it."""
    low = w.lower()
    if low in _common():
        return ("^" if w[:1].isupper() else "") + low
    c = w[:1]
    if _SPACELESS.match(c) and not "\u3040" <= c <= "\u9fff":
        return "thai"
    return "num" if c.isdigit() else "han" if "\u3040" <= c <= "\u9fff" else "upper" if c.isupper() else "lower" if c.islower() else "caseless" if c.isalpha() else "sign"


def word_candidates(text: str) -> list[dict]:
    """Every place between two words, and between two of which one is a character of a script without spaces."""
    words = [(m.group(), m.start(), m.end()) for m in _PLAIN.finditer(text)]
    out, prev = [], ""
    for (a, _, end), (b, start, _) in zip(words, words[1:]):
        if start > end:
            out.append({"end": end, "sym": ("word", _word(a), ""), "nxt": ("sp", _word(b), ""), "gap": 1})
            prev = ""
        else:
            out.append({"end": end, "sym": ("char", _char(a), prev), "nxt": ("none", _char(b), ""), "gap": 1})
            prev = _char(a)
    return out


def _char(c: str) -> str:
    return c if _SPACELESS.match(c) else _word(c)


class WordModel(HiddenEventModel):
    """The same chain with words as symbols. Most pairs of words were never seen, so the fallback weighs as much as there are kinds of
    continuations, and counts are those of sentences, not of the orders in which they were seen."""

    @staticmethod
    def _levels(sym) -> list[int]:
        return [1, 2, 3] if sym[2] else [1, 2]  # no level that has the same counts as the one before

    @functools.cached_property
    def _seen(self) -> dict:
        """How often something followed, and how many kinds of it."""
        seen: dict = {}
        for lvl, counts in enumerate(self.follow):
            for (h, e, *what), c in counts.items():
                if what[0] != "space":
                    n, kinds = seen.get((lvl, h, e), (0.0, 0))
                    seen[lvl, h, e] = n + c / _ROUNDS, kinds + 1
        return seen

    @functools.lru_cache(100_000)
    def p_event(self, sym, e: str) -> float:
        p, keys = 0.5, self._events(sym)
        for lvl in self._levels(sym):
            n = (self.event[lvl][keys[lvl], "S"] + self.event[lvl][keys[lvl], "N"]) / _ROUNDS
            p = (self.event[lvl][keys[lvl], e] / _ROUNDS + self.STRENGTH * p) / (n + self.STRENGTH)
        return p

    @functools.lru_cache(200_000)
    def p_next(self, sym, e: str, nxt) -> float:
        p, keys = 1.0 / len(_common()), self._follows(sym, nxt)
        for lvl in self._levels(sym):
            n, kinds = self._seen.get((lvl, keys[lvl], e), (0.0, 0))
            if kinds:
                p = (self.follow[lvl][keys[lvl], e, nxt[1]] / _ROUNDS + kinds * p) / (n + kinds)
        return p


@functools.lru_cache(3)
def word_model(case: str) -> WordModel:
    """The model of boundaries between words, estimated from the labelled sentences without their final marks: `small` in small letters,
    `cased` as they are, `nouns` those of the language that gives capitals to nouns."""
    rng, m = random.Random(13), WordModel()
    for lang, lines in _plain_lines().items():
        if case != "small" and (case == "nouns") != (lang == "de"):
            continue
        for r in range(_ROUNDS):
            text, truth, sep = "", set(), "" if lang in ("zh", "ja") and r % 2 else " "
            for x in rng.sample(lines, len(lines)):
                text += (sep if text else "") + (x.lower() if case == "small" else x)
                truth.add(len(text))
            m.learn(word_candidates(text), truth)
    return m


@functools.lru_cache(200_000)
def _gain(a: str, b: str, case: str) -> float:
    return word_model(case).gain(("word", a, ""), ("sp", b, ""))


def _unmarked(text: str, rare: float) -> list[tuple[int, float]]:
    """(end, posterior) of the boundaries between the words of a stretch without marks; `rare` is the probability, before it is read, that it
    is more than one sentence written without them. If no capitals stand beyond the first word, or no small letters, none can tell."""
    words = text.split()
    rest = "".join(words[1:])
    cases = ("small",) if rest == rest.lower() or rest == rest.upper() else ("cased", "nouns")
    if cases[0] == "small":
        low = text.lower()
        text = low if len(low) == len(text) else "".join(x.lower() if len(x.lower()) == 1 else x for x in text)
        words = text.split()
    odds, least = math.log(rare / (1.0 - rare)) if rare < 1.0 else math.inf, math.log(SURE / (1.0 - SURE))
    # the product of all gains is no less than the sum over the event sequences: where it is too small, no place can be sure
    spaced = text.isascii() or not _SPACELESS.search(text)
    if spaced:
        known = [_word(w) for w in words]
        if all(odds + sum(map(_gain, known, known[1:], itertools.repeat(case))) <= least for case in cases):
            return []
    cands = word_candidates(text)
    if not spaced and all(odds + sum(word_model(case).gain(c["sym"], c["nxt"]) for c in cands) <= least for case in cases):
        return []
    # the model that finds the words likelier reads them
    (post, total), m = max(((m.chain(cands), m) for m in map(word_model, cases)), key=lambda x: x[0][1])
    odds += total - sum(math.log(m.p_next(c["sym"], "N", c["nxt"])) for c in cands)
    style = 1.0 / (1.0 + math.exp(-odds)) if odds > -700.0 else 0.0
    return [(c["end"], p * style) for c, p in zip(cands, post) if p * style > SURE and not _WITHIN.match(text, c["end"])]


def _boundaries(text: str) -> list[tuple[int, float]]:
    """(end, posterior) of the boundaries inside the text, in order."""
    whole = len(text.rstrip())
    cands = candidates(text)
    judged = {c["end"] for c in cands}
    rare = RARE if any(c["end"] < whole or c["sym"][0] != "gap" for c in cands) else 1.0
    out, at = [], 0
    for end, p in [*((c["end"], p) for c, p in zip(cands, model().posteriors(cands)) if p > 0.5 and c["end"] < whole), (whole, 1.0)]:
        out += [(at + e, q) for e, q in _unmarked(text[at:end], rare) if at + e not in judged]
        out.append((end, p))
        at = end
    return out[:-1]


def sentence_ends(text: str | None) -> list[tuple[int, int, float]]:
    """(start, end, posterior) of each sentence: code points counted from 1, end inclusive, without surrounding white space. A rest
    without a final mark is a sentence. Null, empty and blank texts have none."""
    if not text or not text.strip():
        return []
    out, at = [], 0
    whole = len(text.rstrip())
    for end, p in [*_boundaries(text), (whole, 1.0)]:
        start = at + len(text[at:end]) - len(text[at:end].lstrip())
        if start < end:
            out.append((start + 1, end, p))
            at = end
    return out


def sentences(values: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """(keys, sent_start, sent_end, posterior): one row per sentence of every value that is not empty. Texts are read whole."""
    real = values.filter(~is_empty(F.col(value)))
    src = spread(real.select(*keys, F.col(value).alias("_v")))
    head = spec(src, keys)

    def run(batches):
        for b in batches:
            at, s, e, p = [], [], [], []
            for i, v in enumerate(b.column(len(keys))):
                for x, y, z in sentence_ends(v.as_py()):
                    at.append(i)
                    s.append(x)
                    e.append(y)
                    p.append(z)
            idx = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays([*[c.take(idx) for c in b.columns[: len(keys)]], pa.array(s, pa.int64()), pa.array(e, pa.int64()), pa.array(p, pa.float64())], [*keys, "sent_start", "sent_end", "posterior"])

    return src.mapInArrow(run, f"{head}, sent_start bigint, sent_end bigint, posterior double")
