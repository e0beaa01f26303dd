"""Problem 10: text decoded with the wrong character encoding.

For every pair (written as, read as) the garbled form of every character of the alphabets is computed beforehand; one
multi-pattern automaton finds them all. Neighbouring finds of a pair form a span, which is turned back through the pair; text
between spans stays as it is. Twice garbled text is turned back twice.
"""

from __future__ import annotations

import functools
import re
import unicodedata

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread

# Single-byte and double-byte encodings that UTF-8 is read as, and pairs of legacy encodings.
UTF8_READERS = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250", "iso8859-15", "cp1254", "cp1251", "koi8-r", "cp866", "mac_cyrillic", "cp874", "gb18030", "shift_jis", "big5", "euc_kr")
LEADS = (0xE3, 0xE4, 0xE5, 0xE6, 0xE7, 0xE8, 0xE9, 0xEF)  # first bytes of kana, ideographs and wide signs in UTF-8
DOUBLE_READERS = ("gb18030", "shift_jis", "big5", "euc_kr")
CYRILLIC_READERS = ("cp1251", "koi8-r", "cp866", "mac_cyrillic")
LEGACY_PAIRS = (
    ("cp1251", "latin-1"), ("cp1251", "cp1252"), ("koi8-r", "latin-1"), ("koi8-r", "cp1252"), ("cp866", "cp1252"), ("iso8859-5", "latin-1"),
    ("koi8-r", "cp1251"), ("cp1251", "koi8-r"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("mac_cyrillic", "cp1251"),
    ("gbk", "latin-1"), ("gbk", "cp1252"), ("big5", "latin-1"), ("big5", "cp1252"), ("shift_jis", "latin-1"), ("shift_jis", "cp1252"), ("euc_jp", "latin-1"), ("euc_jp", "cp1252"), ("euc_kr", "latin-1"),
    ("tis-620", "latin-1"), ("cp874", "cp1252"),
)
# Words that announce characters shown on purpose, and words that follow them.
SHOWN_BEFORE = r"(?:sequences?|characters?|chars?|symbols?|signs?|strings?|prints?|printed|shows?|showed|showing|shown|displays?|displayed|appears? as|looks? like|reads?|letters?|code|glyphs?|bytes?|garbled|mojibake|zeichen(?:folge)?|caract[eè]res?|signes?|s[ií]mbolos?|car[aá]cter(?:es)?|сочетани\w+|символ\w*|знак\w*|последовательност\w+|字符|符号|乱码|文字|記号|文字化け|อักขระ|อักษร|वर्ण|अक्षर|चिह्न)"
SHOWN_AFTER = r"(?:signs?|symbols?|characters?|sequences?|glyphs?|instead|in place of|in (?:old|some|our|the)|wherever|where (?:an?|the)|stands? for|means?|should be|for an?|as an?|zeichen|statt|anstelle|au lieu|à la place|en lugar|en vez|em vez|no lugar|вместо|代替|而不是|の代わり|แทน|के स्थान|की जगह)"
REPLACED = "�"
LEAST_GAIN = 5  # frequent letter pairs that garbled Cyrillic gains at least when turned back; fewer may be chance


def _decode(data: bytes, enc: str) -> str | None:
    """Decoded text; the five bytes without a character in the Windows code pages pass as controls, as most software has it."""
    try:
        return data.decode(enc)
    except UnicodeDecodeError:
        if enc.startswith(("cp125", "cp874")):
            return "".join(_one(b, enc) for b in data)
        return None


@functools.lru_cache(None)
def _one(b: int, enc: str) -> str:
    try:
        return bytes([b]).decode(enc)
    except UnicodeDecodeError:
        return chr(b)


@functools.lru_cache(None)
def _back_table(enc: str) -> dict[str, int]:
    return {_one(b, enc): b for b in range(256)}


def _encode(text: str, enc: str) -> bytes | None:
    if enc.startswith(("cp125", "cp874", "latin", "iso", "mac", "koi", "cp4", "cp8", "tis")):
        t = _back_table(enc)
        try:
            return bytes(t[c] for c in text)
        except KeyError:
            return None
    try:
        return text.encode(enc)
    except UnicodeEncodeError:
        return None


def _alphabet() -> list[str]:
    """Characters of the scripts in use: Latin with diacritics, punctuation, currency, Greek, Cyrillic, Devanagari, Thai, kana, common ideographs, emoji."""
    ranges = [(0xA0, 0x17F), (0x1A0, 0x1B0), (0x218, 0x21B), (0x2C6, 0x2DC), (0x391, 0x3C9), (0x401, 0x45F), (0x900, 0x96F), (0xE01, 0xE5B), (0x1E00, 0x1EF9), (0x2010, 0x203A), (0x20A0, 0x20BF), (0x2100, 0x2122), (0x2190, 0x2195), (0x2200, 0x2265), (0x2500, 0x257F), (0x2600, 0x27BF), (0x3000, 0x301F), (0x3041, 0x30FF), (0xFF01, 0xFF5E), (0x1F300, 0x1F6FF), (0x1F900, 0x1F9FF)]
    out = [chr(c) for a, b in ranges for c in range(a, b + 1) if unicodedata.category(chr(c)) not in ("Cn", "Cs", "Co")]
    for hi in range(0xB0, 0xF8):  # ideographs of the oldest Chinese national standard
        for lo in range(0xA1, 0xFF):
            try:
                out.append(bytes([hi, lo]).decode("gb2312"))
            except UnicodeDecodeError:
                pass
    for hi in range(0x88, 0xA0):  # and of the first level of the Japanese one
        for lo in range(0x40, 0xFD):
            try:
                out.append(bytes([hi, lo]).decode("shift_jis"))
            except UnicodeDecodeError:
                pass
    return list(dict.fromkeys(out))


QUOTES = set("«»‹›“”„‚‘’\"'–—…·• ¡¿°ºª§®™ ,.;:!?()[]")
SIGNS = set("°ºª®·¡¿§")


class Garbled:
    """All garbled sequences of all pairs, in one automaton. A find is strong if clean text cannot well contain it."""

    def __init__(self):
        pairs: dict[str, set[tuple[str, str]]] = {}
        alphabet = _alphabet()
        for c in alphabet:
            data = c.encode("utf-8")
            for enc in UTF8_READERS:
                if enc in DOUBLE_READERS:
                    continue
                g = _decode(data, enc)
                if g and g != c and len(g) > 1:
                    pairs.setdefault(g, set()).add(("utf-8", enc))
        # double-byte readers: the bytes of neighbouring characters mix, so sequences of two read characters are needed
        # (three bytes and the lead of the next character of the same script make two read characters)
        wide = [c for c in alphabet if 0x7FF < ord(c) < 0x10000 and not 0x2000 <= ord(c) < 0x3000]
        letters: dict[str, tuple] = {}  # pairs of ideographs, syllables or letters: never sure by themselves
        heads: dict[bytes, set[int]] = {}
        for c in wide:
            b = c.encode("utf-8")
            heads.setdefault(b[:2], set()).add(b[2])
        for enc in DOUBLE_READERS:
            one = lambda data: g if (g := _decode(data, enc)) and len(g) == 1 and ord(g) > 0x7F else None  # noqa: B023, E731
            ends = {(last, lead): g for last in range(0x80, 0xC0) for lead in (0xE0, *LEADS) if (g := one(bytes([last, lead])))}
            name = ("utf-8", enc)
            for head, lasts in heads.items():
                first = one(head)
                if first is None:
                    continue  # the reader takes these bytes apart or has lost them
                for last in lasts:
                    for lead in LEADS if head[0] > 0xE1 else (head[0],):
                        g = ends.get((last, lead))
                        if g is None:
                            continue
                        if ("\u3400" <= first < "\uac00" or "\u3400" <= g < "\uac00") and first.isalpha() and g.isalpha():
                            known = letters.get(first + g, ())
                            letters[first + g] = known if name in known else (*known, name)
                        else:
                            pairs.setdefault(first + g, set()).add(name)
            # two bytes are one read character: Cyrillic and Greek letters in threes, as one alone may be a word
            for block in ("абвгдежзийклмнопрстуфхцчшщъыьэюяАБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЭЮЯ", "αβγδεζηθικλμνξοπρστυφχψωςάέήίόύώϊϋΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"):
                read = {c: g for c in block if (g := _decode(c.encode("utf-8"), enc)) and len(g) == 1}
                for a in read:
                    for b in read:
                        pairs.setdefault(read[a] + read[b], set()).add(("utf-8", enc))
        self.alphabet = frozenset(alphabet) | frozenset(map(chr, range(0x386, 0x3CF)))
        self.high_run, self.high_pair = re.compile(r"[^\x00-\x7f]+"), re.compile(r"[^\x00-\x7f]{2,}")
        self.automaton = ahocorasick.Automaton()
        for g, ps in pairs.items():
            if one_script(g):
                continue  # clean text of that script is full of such sequences
            ps.update(letters.pop(g, ()))
            self.automaton.add_word(g, (len(g), tuple(sorted(ps)), self._strong(g)))
        for g, ps in letters.items():
            self.automaton.add_word(g, (2, tuple(sorted(ps)), False))
        self.automaton.make_automaton()
        shown = r"[\s\"'“”‘’«»„()\[\]:]*"
        self.before = re.compile(SHOWN_BEFORE + shown + "$", re.I)
        self.after = re.compile("^" + shown + SHOWN_AFTER, re.I)
        self.quoted_left, self.quoted_right = re.compile(r"[\"'“‘«„(\[]\s?$"), re.compile(r"^\s?[\"'”’»“)\]]")
        # runs of letters above ASCII for the single-byte legacy pairs
        self.high_word = re.compile(r"[\x80-\xffŒ-Ÿƒˆ˜–-›€™]{4,}")
        self.between = re.compile(r"[\s,.;:!?0-9()\x80-\xffŒ-Ÿ-]{0,40}")
        # Cyrillic words in a row, for Cyrillic read as other Cyrillic
        self.cyrillic = re.compile(r"[Ѐ-џ─-▟°±є]+(?:[ ,.;:!?\d\n-]+[Ѐ-џ─-▟°±є]+)*")

    @staticmethod
    def _strong(g: str) -> bool:
        """Not a capital letter with diacritic followed by something that may well follow it in clean text (SÃO, NÃ», ÉTÉ, Р»)."""
        first, rest = g[0], g[1:]
        if len(g) > 2 and not all(unicodedata.category(x) in ("Lu", "Lt") for x in g):
            return not all(x in QUOTES or unicodedata.category(x)[0] == "L" and ord(x) > 0x2FF for x in g) or ord(first) < 0x400
        if any(unicodedata.category(x) in ("Cc", "Cf") for x in rest):
            return True
        if all(unicodedata.category(x)[0] == "L" for x in g):
            return False
        return not all(x in QUOTES or x in "№" for x in rest)

    def spans(self, text: str) -> list[tuple[int, int, tuple[str, str], bool]]:
        """Maximal runs of finds: (start, end, pair, strong). Of several pairs that of most characters wins, the earlier named on ties."""
        hits = []
        # all garbled characters are beyond ASCII, so only runs of two such characters or more can hold a sequence
        for run in self.high_pair.finditer(text):
            hits += self._hits(text, run.group(), run.start())
        if not hits:
            return []
        return self._runs(hits)

    def _hits(self, text: str, run: str, base: int) -> list[tuple[int, int, tuple, bool]]:
        hits = []
        for end, (n, ps, strong) in self.automaton.iter(run):
            end += base
            at = end + 1 - n
            if not strong and at and text[at].isupper():
                # a capital inside a word of small letters, or alone before a sign, is not clean text either
                before = text[at - 1]
                strong = before.islower() or (not before.isupper() and all(c in SIGNS for c in text[at + 1 : end + 1]))
            hits.append((at, end + 1, ps, strong))
        return hits

    @staticmethod
    def _runs(hits: list) -> list[tuple[int, int, list, bool]]:
        hits.sort(key=lambda h: (h[0], -h[1]))
        runs, cur = [], None
        for s, e, ps, strong in hits:
            if cur and s < cur[1] and e <= cur[1]:
                continue
            if cur and s <= cur[1]:
                cur[1] = max(cur[1], e)
                cur[2].append((e - s, ps, strong))
            else:
                cur = [s, e, [(e - s, ps, strong)]]
                runs.append(cur)
        order = {("utf-8", r): i for i, r in enumerate(UTF8_READERS)}
        out = []
        for s, e, found in runs:
            weight: dict = {}
            for n, ps, strong in found:
                for p in ps:
                    weight[p] = weight.get(p, 0) + n
            ranked = sorted(weight, key=lambda p: (-weight[p], order[p]))
            strong = any(x[2] for x in found)
            out.append((s, e, ranked, strong))
        return out

    def legacy_spans(self, text: str) -> list[tuple[int, int, list, bool]]:
        """Runs of high characters that are words of another script in a legacy encoding."""
        out = []
        for m in self.high_word.finditer(text):
            w = m.group(0)
            if sum(unicodedata.category(x)[0] == "L" or x in "¤¦¨¸´·¡£¥§©ª«¬®¯°±²³µ¶¹º»¼½¾¿" for x in w) < 0.7 * len(w):
                continue
            best = None
            for written, read in LEGACY_PAIRS:
                if read not in ("latin-1", "cp1252"):
                    continue
                b = _encode(w, read)
                if b is None:
                    continue
                try:
                    t = b.decode(written)
                except UnicodeDecodeError:
                    t = b[:-1].decode(written, "ignore") if written in ("gbk", "big5", "shift_jis", "euc_jp", "euc_kr") else ""
                score = plausible(t)
                if score > 0.75 and (best is None or score > best[0]):
                    best = (score, (written, read))
            if best and not clean_word(w):
                last = out[-1] if out else None
                if last and last[2] == [best[1]] and self.between.fullmatch(text, last[1], m.start()):
                    out[-1] = (last[0], m.end(), last[2], True)  # short words between two finds belong to them
                else:
                    out.append((m.start(), m.end(), [best[1]], True))
        for m in self.cyrillic.finditer(text):
            out += self.cyrillic_spans(m.group(0), m.start())
        return out

    def double_spans(self, text: str) -> list[tuple[int, int, list, bool]]:
        """Runs above ASCII whose bytes in a double-byte encoding are UTF-8 of one script, but for what U+FFFD stands for. Sure are runs of
        three letters, and accented Latin letters inside a word; clean text of that encoding is hardly ever UTF-8 for so long."""
        out = []
        for m in self.high_run.finditer(text):
            run, best = m.group(0), None
            if max(run.replace(REPLACED, ""), default="") < "⺀":
                continue
            for enc in DOUBLE_READERS:
                b = _encode(run.replace(REPLACED, "\x7f"), enc)
                if b is None:
                    continue
                t = b.replace(b"\x7f", b"\xff").decode("utf-8", "replace")
                kept = [c for c in t if c != REPLACED]
                lost, holes = len(t) - len(kept), run.count(REPLACED)
                kinds = {script(c) for c in kept} - {""}
                if not kept or lost > 3 * holes or lost > len(kept) or len(kinds) != 1 or not self.alphabet.issuperset(kept):
                    continue
                if kinds == {"latin"}:
                    if len(kept) > 3 or lost:
                        continue
                    around = text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1]
                    strong = all(c.isalpha() for c in around)
                else:
                    strong = len(kept) >= (4 if lost else 3)
                if best is None or len(kept) - lost > best[0]:
                    best = (len(kept) - lost, [("utf-8", enc)], strong)
            if best:
                out.append((m.start(), m.end(), *best[1:]))
        return out

    def cyrillic_spans(self, run: str, at: int) -> list[tuple[int, int, list, bool]]:
        """Stretches of words that gain frequent letter pairs when turned back; clean words around them lose some, which ends a stretch."""
        words = [(w.start(), w.end(), *pairs_of(w.group(0))) for w in re.finditer(r"[^ ,.;:!?\d\n-]+", run)]
        if all(good > 0.45 * n for _, _, good, n in words if n > 1):
            return []
        found = []
        for written, read in LEGACY_PAIRS:
            if read in ("latin-1", "cp1252"):
                continue
            turned = run.translate(_cyrillic_table(written, read))
            new = [pairs_of(turned[s:e]) if "\0" not in turned[s:e] else None for s, e, _, _ in words]
            gain = [-99 if x is None else x[0] - w[2] + usual_case(turned[w[0] : w[1]]) - usual_case(run[w[0] : w[1]]) for x, w in zip(new, words)]
            inside = lambda i, j: not re.search(r"[.!?\n]", run[words[i][1] : words[j][0]])
            first = 0
            while first < len(words):
                if gain[first] <= 0:
                    first += 1
                    continue
                total = best = 0
                last = k = first
                while k < len(words) and total > best - 3:
                    total += gain[k]
                    if total > best:
                        best, last = total, k
                    k += 1
                good, n, was, pairs = (sum(x) for x in zip(*(new[i] + words[i][2:] for i in range(first, last + 1))))
                before = was / pairs if pairs else 0.0
                if good - was >= LEAST_GAIN and before <= 0.45 and good / n > max(0.55, before + 0.25):
                    i, j = first, last  # words without a sign of their own belong to the sentence
                    while i and gain[i - 1] == 0 and inside(i - 1, i):
                        i -= 1
                    while j + 1 < len(words) and gain[j + 1] == 0 and inside(j, j + 1):
                        j += 1
                    found.append((best, at + words[i][0], at + words[j][1], [(written, read)], True))
                first = last + 1
        out = []
        for _, *span in sorted(found, key=lambda x: -x[0]):
            if all(span[1] <= o[0] or o[1] <= span[0] for o in out):
                out.append(tuple(span))
        return out


def script(c: str) -> str:
    """The script of a letter or mark, of those in the alphabet; empty for other signs."""
    if unicodedata.category(c)[0] not in "LM":
        return ""
    for name, lo, hi in (("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x45F), ("devanagari", 0x900, 0x97F), ("thai", 0xE00, 0xE7F), ("east asian", 0x2E80, 0xFFFF)):
        if lo <= ord(c) <= hi:
            return name
    return "latin"


@functools.lru_cache(None)
def _cyrillic_table(written: str, read: str) -> dict[int, str]:
    """Cyrillic letters and signs of the regex as they turn back; those that the reader doesn't have become NUL."""
    t = _back_table(read)
    return {c: _one(t[chr(c)], written) if chr(c) in t else "\0" for c in (*range(0x400, 0x460), *range(0x2500, 0x25A0), 0xB0, 0xB1)}


def usual_case(word: str) -> int:
    """2 for small letters behind the first, 1 for capitals throughout, 0 for a mixture."""
    return 2 if word[1:].islower() else int(len(word) > 1 and word.isupper())


@functools.lru_cache(1 << 16)
def pairs_of(word: str) -> tuple[int, int]:
    """Letter pairs of the word that are frequent in Russian, and all of them."""
    good = n = 0
    for w in re.findall("[а-яё]{2,}", word.lower().replace("ё", "е")):
        n += len(w) - 1
        good += sum(w[i : i + 2] in RUSSIAN_PAIRS for i in range(len(w) - 1))
    return good, n


def one_script(g: str) -> bool:
    """Only letters and signs of the Russian alphabet, of Thai, of Devanagari, of kana or Hangul."""
    if all("А" <= c <= "я" or c in "Ёё" for c in g):
        return True
    return any(all(lo <= c <= hi for c in g) for lo, hi in (("ก", "๛"), ("ऀ", "ॿ"), ("ぁ", "ヿ"), ("가", "힣")))


# Frequent letter pairs of Russian.
RUSSIAN_PAIRS = frozenset(
    "ст но то на ен ов ни ра во ко не ро по пр го ер ал ли ла ре ос ле ан та де от ел он да ол ом те ло ит ти ат ть ва од ри ес ть ка ло ил ин об ог ой ор ны до за ки ет ви мо со ем ам ме ми ия им из ии ий ая ое ый ые ых ую ие бо бы вы ве вс ва ав ад аз ар ас гл да др ди ду ду ей ез еж ек жи же за зн зв иб ив ид ик ис их ич кл кр кт ку лж лу ль ля ма мы на нн нт ну ня ок оп от пе пи пл рг ру ры ря са св се си ск сл см сн су ся тв тр ту ты уд уж ул ун ус ут уч ход хо це чи че чн ша ши ще эт юч яв яз ян ят яю шл сх шт жд".split()
)


def russian(t: str) -> float:
    """Share of letter pairs of the words that are frequent in Russian."""
    good, n = pairs_of(t)
    return good / n if n else 0.0


def clean_word(w: str) -> bool:
    """High-character runs that clean text does contain: punctuation, or capitals of one Latin word such as ÉÀÇÃ never appear four in a row."""
    return not any(unicodedata.category(c)[0] in "LS" for c in w) or len(set(w)) == 1


COMMON_CYRILLIC = set("оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфёъ")
COMMON_HAN = None


@functools.lru_cache(None)
def _level_one() -> frozenset:
    """Ideographs of the first level of the Chinese standard, which holds the frequent ones."""
    out = set()
    for hi in range(0xB0, 0xD8):
        for lo in range(0xA1, 0xFF):
            try:
                out.add(bytes([hi, lo]).decode("gb2312"))
            except UnicodeDecodeError:
                pass
    return frozenset(out)


def plausible(t: str) -> float:
    """Share of characters that fit a word of one script: lower-case Cyrillic with at most a leading capital, frequent ideographs or kana, Thai."""
    if not t:
        return 0.0
    letters = [c for c in t if c not in " ,.;:!?()0123456789"]
    if not letters:
        return 0.0
    cyr = sum(c in COMMON_CYRILLIC for c in letters) + (letters[0].lower() in COMMON_CYRILLIC and letters[0] not in COMMON_CYRILLIC)
    vowels = sum(c.lower() in "аеёиоуыэюя" for c in letters)
    if cyr and not 0.1 <= vowels / len(letters) <= 0.8:
        cyr = 0
    one = _level_one()
    han = sum(c in one or "ぁ" <= c <= "ヾ" or "　" <= c <= "〟" or "！" <= c <= "～" or c in "“”‘’…—" for c in letters)
    thai = sum("ก" <= c <= "๛" for c in letters)
    return max(cyr, han, thai) / len(letters)


@functools.lru_cache(1)
def garbled() -> Garbled:
    return Garbled()


def _widen(text: str, s: int, e: int, pairs) -> tuple[int, int]:
    """The span with neighbouring characters that the automaton leaves out as they look clean, as long as the whole turns back."""
    fits = lambda a, b: any(w == "utf-8" and (x := _encode(text[a:b], r)) is not None and _valid(x) for w, r in pairs[:3])
    if not fits(s, e):
        return s, e
    while True:
        for a, b in ((s, e + 2), (s, e + 4), (s - 2, e), (s - 4, e)):
            if a >= 0 and b <= len(text) and not any(c.isascii() for c in text[a:s] + text[e:b]) and fits(a, b):
                s, e = a, b
                break
        else:
            return s, e


def _valid(data: bytes) -> bool:
    try:
        data.decode("utf-8")
    except UnicodeDecodeError:
        return False
    return True


def _turn_back(s: str, pairs) -> str | None:
    """The span turned back by the first pair that fits it whole; else with what was lost left as U+FFFD."""
    for written, read in pairs:
        b = _encode(s, read)
        if b is not None:
            try:
                return b.decode(written)
            except UnicodeDecodeError:
                continue
    for written, read in pairs:
        if read in DOUBLE_READERS and written == "utf-8" and (read == "gb18030" or _encode(s.replace(REPLACED, ""), read) is not None):
            b = b"".join(c.encode(read) if c != REPLACED else b"?" for c in s)
            return b.decode("utf-8", "replace")
    return None


def _shown(g: Garbled, text: str, s: int, e: int) -> bool:
    """Whether the span stands alone, as a thing talked about: in quotes of its own or after or before words that announce it."""
    left, right = text[max(0, s - 40) : s], text[e : e + 40]
    if (left and (left[-1].isalnum())) or (right and right[0].isalnum()):
        return False
    if g.quoted_left.search(left) and g.quoted_right.search(right):
        return True
    return bool(g.before.search(left) or (left[-1:].isspace() or not left) and g.after.search(right))


def repair(text: str | None) -> tuple[bool, str | None, str | None]:
    """(garbled, restored text, pair). Null and empty texts are not garbled. Text that only shows such characters is not either."""
    if not text or text.isascii():
        return False, text, None
    g, hit, pair, cur = garbled(), False, None, text
    for _ in range(3):
        found, legacy = g.spans(cur), g.legacy_spans(cur)
        if legacy:
            cover = lambda x: sum(max(0, min(x[1], f[1]) - max(x[0], f[0])) for f in found)
            legacy = [x for x in legacy if cover(x) < 0.8 * (x[1] - x[0])]
            found = [f for f in found if not any(f[0] < x[1] and x[0] < f[1] for x in legacy)]
        doubles = g.double_spans(cur)  # a whole run that is UTF-8 goes before finds inside it
        found = [f for f in found if f[2][0][1] not in DOUBLE_READERS or not any(x[0] <= f[0] and f[1] <= x[1] for x in doubles)]
        found += [x for x in doubles if not any(f[0] < x[1] and x[0] < f[1] for f in found + legacy)]
        spans = found + legacy
        if not spans:
            break
        spans.sort()
        real, last = [], -1
        for s, e, ps, strong in spans:
            if s >= last and not _shown(g, cur, s, e):
                if strong and ps[0][0] == "utf-8" and ps[0][1] in CYRILLIC_READERS:
                    a, e = _widen(cur, s, e, ps)
                    s = max(a, last, 0)
                real.append((s, e, ps, strong))
                last = e
        # finds that clean text might contain count only beside sure ones
        if not any(x[3] for x in real) and len(real) < 3:
            break
        parts, at, changed = [], 0, False
        for s, e, ps, strong in real:
            new = _turn_back(cur[s:e], ps)
            if new is None or new == cur[s:e]:
                continue
            parts += [cur[at:s], new]
            at, changed, pair = e, True, pair or f"{ps[0][0]}>{ps[0][1]}"
        if not changed:
            hit = hit or any(x[3] for x in real)
            break
        hit, cur = True, "".join(parts) + cur[at:]
    if not hit and REPLACED in text:
        for m in re.finditer(REPLACED + "+", text):
            if not _shown(g, text, m.start(), m.end()):
                return True, text, "?>utf-8"
    return hit, cur, pair


def repaired(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, restored, pair) of the garbled documents only. Each text is handled whole, on its own."""
    src = docs.select(F.col(id_col).alias(id_col), F.col(text_col).cast("string").alias("text"))
    # no encoding pair leaves a trace in pure ASCII; such texts never reach Python
    src = src.filter(F.col("text").rlike(r"[^\x00-\x7F]"))
    kind = src.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            ids, out, pairs = [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                hit, new, pair = repair(t.as_py())
                if hit:
                    ids.append(i)
                    out.append(new)
                    pairs.append(pair)
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(0).type), pa.array(out, pa.string()), pa.array(pairs, pa.string())], [id_col, "restored", "pair"])

    return spread(src).mapInArrow(run, f"`{id_col}` {kind}, restored string, pair string")
