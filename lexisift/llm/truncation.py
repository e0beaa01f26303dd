"""Problem 4: text broken off by a length limit or a lost transfer.

A stack automaton follows quotes, brackets and markup and tells what is still open at the end, and whether a terminator, a broken
character or a broken escape ends the text. Where only the terminator is missing, the baseline of the source (how often its values
lack one) and the way the last words go on elsewhere in the corpus decide: words that end sentences or lines speak for a complete
text, words that always go on speak for a broken one. Token limits of the models and lengths that pile up are further evidence.
"""

from __future__ import annotations

import functools
import re

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, is_empty, spec, spread
from .sentences import ABBREVIATIONS

_INNER_ABBR = frozenset(w for k in ("title", "cite", "mid") for w in ABBREVIATIONS[k]) - {"no", "p", "s", "min", "max", "art", "sec", "par", "ex", "fr", "v", "f", "ed", "st", "col", "hon", "pt"}
_PAIRS = {"”": "“", "»": "«", ")": "(", "]": "[", "}": "{", "」": "「", "』": "『", "）": "（", "】": "【", "》": "《"}
_OPEN = set(_PAIRS.values()) | {"„"}
_TERMINAL = ".!?…。！？．।॥؟۔"
_EVENT = regex.compile(
    r"(?P<fence>(?m:^[ \t]*(?:```|~~~)))|(?P<begin>\\begin\{(\w+\*?)\})|(?P<end>\\end\{(\w+\*?)\})|(?P<math>\\\[|\\\]|\\\(|\\\)|\$\$)|(?P<wiki>\{\{|\}\}|\{\||\|\}|\[\[|\]\])"
    r"|(?P<tag></?(?:div|span|ul|ol|table|tbody|thead|h[1-6]|b|i|em|strong|a|pre|code|blockquote|section|article|sub|sup|font)(?:\s[^<>]*)?>)|(?P<comment><!--|-->)|(?P<mark>[“”„«»()\[\]{}「」『』（）【】《》])|(?P<par>\n\s*\n)",
    regex.I,
)
_BROKEN_END = regex.compile(r"(?:�+|&(?:#x?[0-9a-fA-F]*|[a-zA-Z]{2,8})|\\(?:u[0-9a-fA-F]{0,3}|x[0-9a-fA-F]?|[a-zA-Z]+\{[^{}]*)|%[0-9A-F]?|<(?:/?[a-zA-Z][^<>]*)?|\{\{[^{}]*|\[\[[^\[\]]*|\]\([^()\s]*)$")
_CLOSING_MARKUP = regex.compile(r"(?:</\w+\s*>|-->|\\end\{[^{}]*\}|```|~~~|\|\}|\}\}|\]\]|\|[ \t]*|\\\]|\\\)|/>|<br\s*>|<hr\s*>)$", regex.I)
_ITEM = regex.compile(r"[ \t]*(?:[-*+•–]|\(?(?:\p{N}{1,3}|[a-zA-Z])[.)])[ \t]+\S")
_UNIT = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}ー]|[\p{L}\p{M}\p{N}]+(?:['’‑\-./,:@_+][\p{L}\p{M}\p{N}]+)*")
_ASCII_UNIT = re.compile(r"[A-Za-z0-9]+(?:['\-./,:@_+][A-Za-z0-9]+)*")
_CHAR_SCRIPT = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]")
ORDERS = (1, 2, 3)
# characters that count as a word in scripts without spaces
CHAR_STEP, CHAR_STEP_ALPHABETIC = 2, 5


def open_at_end(text: str) -> list[str]:
    """What the automaton's stack holds at the end: structures from anywhere, quotes and brackets of the last paragraph only."""
    stack: list[str] = []
    for m in _EVENT.finditer(text):
        k, s = m.lastgroup, m.group()
        if m.group("fence"):
            k, s = "fence", "```"
        elif m.group("begin"):
            stack.append("env:" + m.group(3))
            continue
        elif m.group("end"):
            if "env:" + m.group(5) in stack:
                del stack[len(stack) - 1 - stack[::-1].index("env:" + m.group(5)) :]
            continue
        if k == "fence" or s == "$$":
            if s in stack:
                del stack[stack.index(s) :]
            else:
                stack.append(s)
            continue
        if "```" in stack:
            continue
        if m.group("par"):
            stack = [x for x in stack if x not in _OPEN]
        elif m.group("math"):
            twin = {"\\]": "\\[", "\\)": "\\("}.get(s)
            if twin is None:
                stack.append(s)
            elif twin in stack:
                stack.remove(twin)
        elif m.group("wiki"):
            twin = {"}}": "{{", "|}": "{|", "]]": "[["}.get(s)
            if twin is None:
                stack.append(s)
            elif twin in stack:
                del stack[len(stack) - 1 - stack[::-1].index(twin) :]
        elif m.group("tag"):
            name = regex.match(r"</?(\w+)", s).group(1).lower()
            if s[1] == "/":
                if "tag:" + name in stack:
                    del stack[len(stack) - 1 - stack[::-1].index("tag:" + name) :]
            elif not s.endswith("/>"):
                stack.append("tag:" + name)
        elif m.group("comment"):
            if s == "<!--":
                stack.append(s)
            elif "<!--" in stack:
                stack.remove("<!--")
        elif s in _OPEN:
            if s == "“" and "„" in stack:
                stack.remove("„")
            else:
                stack.append(s)
        elif s in _PAIRS and _PAIRS[s] in stack:
            del stack[len(stack) - 1 - stack[::-1].index(_PAIRS[s]) :]
    return stack


def ending(text: str) -> str:
    """How the text ends: 'broken' (open structure, broken character or escape), 'closed' (terminator or closing markup), 'comma', or 'bare'."""
    t = text.rstrip()
    if not t:
        return "closed"
    if _BROKEN_END.search(t) or open_at_end(t):
        return "broken"
    if _CLOSING_MARKUP.search(t):
        return "closed"
    core = regex.sub(r"(?:[\s”“»\"'’)\]}」』）】*_~`$]|</\w+>|\p{So}|\p{Cf}|️)+$", "", t)
    if not core:
        return "closed"
    if core[-1] in _TERMINAL:
        m = regex.search(r"(?<![\p{L}\p{M}\p{N}])([\p{L}\p{M}][\p{L}\p{M}.-]*)\.$", core)
        if m and (m.group(1).lower() in _INNER_ABBR or regex.fullmatch(r"[\p{Lu}zdutте]", m.group(1)) and m.group(1) not in "IAОЯ"):
            return "comma"  # an abbreviation or initial that never ends a sentence
        return "closed"
    if core[-1] in ",;:，、；：–—-(/&+=‘“«„":
        return "comma"
    lines = t.split("\n")
    if len(lines) > 1 and len(core) > 0:
        last, above = lines[-1], next((x for x in reversed(lines[:-1]) if x.strip()), "")
        if _ITEM.match(last) and _ITEM.match(above) and not regex.search(r"[.!?。！？।;][\s\"”»)*_']*$", above):
            return "item"  # a list of phrases, none with a final mark
        if len(last.split()) <= 6 and regex.fullmatch(r"\s*\p{Lu}[\p{L} ]{0,30}[:：][ \t]*\S+", last):
            return "item"  # a labelled reference
        if len(last.split()) <= 6 and above.rstrip().endswith(","):
            return "item"  # a closing line under a salutation
    return "bare"


_CLOSERS = "”“»\"'’)]}」』）】*_~`"


@functools.lru_cache(maxsize=50_000)
def _after(gap: str, last: bool, thai: bool) -> str:
    """What the signs between a unit and the next say about the unit."""
    g = gap.lstrip(_CLOSERS)
    if not g.strip():
        if last:
            return "text"
        return "end" if "\n" in g or "\r" in g or thai and g else "more"
    c = g[0]
    if c.isspace() and ("\n" in g[: len(g) - len(g.lstrip())] or "\r" in g[: len(g) - len(g.lstrip())]):
        return "end"
    if c in _TERMINAL:
        return "end" if c in "。！？．।" or len(g) > 1 or last else "more"
    return "end" if c in "<|\\" else "more"


def _stream(text: str) -> list[tuple[str, str]]:
    """(unit, what follows it): 'end' before a terminator, a line end or a space of Thai not beside a number, 'more' otherwise; 'text' at the end of the text."""
    found = list((_ASCII_UNIT if text.isascii() else _UNIT).finditer(text))
    out: list[tuple[str, str]] = []
    if not found:
        return out
    starts = [m.start() for m in found]
    starts.append(len(text))
    most = len(found) - 1
    for i, m in enumerate(found):
        u = m.group()
        gap = text[m.end() : starts[i + 1]]
        if gap == " " and i < most and not "ก" <= u <= "๛":
            nxt = "more"
        else:
            thai = "ก" <= u[-1] <= "๛" and not (i < most and text[starts[i + 1]].isdigit())
            nxt = _after(gap, i == most, thai)
        u = u.lower()
        out.append((u if u.isalpha() else regex.sub(r"\p{N}+", "#", u), nxt))
    return out


def _step(unit: str) -> int:
    return 1 if not _CHAR_SCRIPT.match(unit) else CHAR_STEP_ALPHABETIC if "\u0e00" <= unit[0] <= "\u1fff" else CHAR_STEP


def _key(units: list[str]) -> int:
    return xxhash.xxh64_intdigest("\x00".join(units).encode("utf-8", "surrogatepass")) - (1 << 63)


def _last_units(text: str, most: int) -> list[str]:
    """The last units of a text, so many at most: from its end, as far back as they reach."""
    back = 64
    while True:
        part = text[-back:]
        u = [x for x, _ in _stream(part)]
        if len(part) == len(text):
            return u[-most:]
        if len(u) > most:  # the first one of a part may lack its head
            return u[-most:]
        back *= 4


def tails(text: str) -> list[int]:
    """Keys of the last 1, 2 and 3 words of a text (of that many steps of characters in scripts without spaces); fewer for short texts."""
    u = _last_units(text, ORDERS[-1])
    if not u:
        return []
    step = _step(u[-1])
    if step > 1:
        u = _last_units(text, ORDERS[-1] * step)
    return [_key([str(o), *u[-o * step :]]) for o in ORDERS if len(u) >= o * step]


_NUMBERED = regex.compile(r"\p{N}")
_LABELLED = regex.compile(r"\W*\p{Lu}[\w ]{0,30}:\s*\S+\s*")
_SALUTED = re.compile(r"[^.!?]{1,40}")


def coded(text: str) -> bool:
    """Whether the last unit holds a number, the last line is a label with one word, or a short line under a colon or comma."""
    words, lines = text.rsplit(None, 1), text.split("\n")
    if words and _NUMBERED.search(words[-1]) or _LABELLED.fullmatch(lines[-1]):
        return True
    return len(lines) > 1 and lines[-2][-1:] in (",", ":") and bool(_SALUTED.fullmatch(lines[-1]))


def unmarked(text: str) -> bool:
    """Whether the last letter is of a script without terminators."""
    c = next((c for c in reversed(text) if c.isalpha()), " ")
    return "\u0e00" <= c <= "\u0eff" or "\u1000" <= c <= "\u109f" or "\u1780" <= c <= "\u17ff"


def look(values: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """(keys, ending, tail, length, coded, few, unmarked) for every value; what follows length is looked for only where the ending is bare
    or an item. coded: see coded(); few: no more than two words; unmarked: it ends in a script without terminators."""
    src = spread(values.select(*keys, F.col(value).alias("_v")))
    head = spec(src, keys)

    def run(batches):
        for b in batches:
            e, t, n, c, few, um = [], [], [], [], [], []
            for v in b.column(len(keys)):
                s = v.as_py() or ""
                kind = ending(s)
                open_end = kind in ("bare", "item")
                tail = tails(s) if open_end else []
                e.append(kind)
                t.append(tail)
                n.append(len(s))
                um.append(open_end and unmarked(s))
                few.append(open_end and len(s) < 40 and len(tail) < 3)
                c.append(open_end and coded(s))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], pa.array(e, pa.string()), pa.array(t, pa.list_(pa.int64())), pa.array(n, pa.int32()), pa.array(c, pa.bool_()), pa.array(few, pa.bool_()), pa.array(um, pa.bool_())], [*keys, "ending", "tail", "length", "coded", "few", "unmarked"])

    return src.mapInArrow(run, f"{head}, ending string, tail array<bigint>, length int, coded boolean, few boolean, unmarked boolean")


FILTER_BITS, BITMAP_BITS = 1 << 23, 1 << 15  # one bit a key: 1 MB whatever the data; bitmaps of 4 KB are what the aggregate builds


def key_filter(wanted: DataFrame, key: str = "key") -> bytes:
    """A one-probe Bloom filter of the keys as FILTER_BITS / 8 bytes. Bits are set by partial aggregates, so the driver gets at most 256
    bitmaps of 4 KB. A key without its bit is surely not wanted; the more keys, the fewer others it tells apart."""
    h = F.pmod(F.col(key), F.lit(FILTER_BITS))
    parts = wanted.select(F.floor(h / BITMAP_BITS).cast("int").alias("at"), (h % BITMAP_BITS).alias("bit")).groupBy("at").agg(F.expr("bitmap_construct_agg(bit)").alias("bits")).collect()
    out = bytearray(FILTER_BITS // 8)
    for r in parts:
        out[r["at"] * BITMAP_BITS // 8 : (r["at"] + 1) * BITMAP_BITS // 8] = r["bits"]
    return bytes(out)


def continuations(values: DataFrame, value: str = "value", flush: int = 400_000, only: bytes | None = None) -> DataFrame:
    """(key, seen, ended, at_text_end): how often each run of 1, 2 or 3 words of the corpus occurs, is followed by the end of a sentence or
    line, or ends a text without a mark. Counted over all values, summed per partition before the shuffle.

    only: a filter as key_filter() makes it; runs that are not in it are left out. A longer run can be in it only if the shorter
    runs at its end are, so most words of the corpus cost one look-up."""
    src = spread(values.select(value))
    sent = src.sparkSession.sparkContext.broadcast(only) if only is not None else None

    def out(c: dict):
        k = pa.array(c.keys(), pa.int64())
        cols = list(zip(*c.values())) if c else [[], [], []]
        return pa.RecordBatch.from_arrays([k, *[pa.array(x, pa.int64()) for x in cols]], ["key", "seen", "ended", "at_text_end"])

    def run(batches):
        bits = sent.value if sent is not None else None
        c: dict[int, list[int]] = {}
        ids: dict[tuple, list[int] | None] = {}  # run -> its counts; None for runs that are not wanted
        for b in batches:
            for v in b.column(0):
                s = v.as_py()
                if not s:
                    continue
                st = _stream(s)
                u = [x for x, _ in st]
                for i, (x, nxt) in enumerate(st):
                    step = _step(x)
                    for o in ORDERS:
                        w = o * step
                        if i + 1 < w:
                            break
                        gram = (o, *u[i + 1 - w : i + 1])
                        e = ids.get(gram, 0)
                        if e == 0:
                            k = _key([str(o), *gram[1:]])
                            h = k % FILTER_BITS
                            e = c.setdefault(k, [0, 0, 0]) if bits is None or bits[h >> 3] >> (h & 7) & 1 else None
                            ids[gram] = e
                        if e is None:
                            break
                        e[0] += 1
                        if nxt == "end":
                            e[1] += 1
                        elif nxt == "text":
                            e[2] += 1
                if len(ids) > flush:
                    yield out(c)
                    c, ids = {}, {}
        yield out(c)

    return src.mapInArrow(run, "key bigint, seen bigint, ended bigint, at_text_end bigint").groupBy("key").agg(*[F.sum(x).alias(x) for x in ("seen", "ended", "at_text_end")])


def broken_off(values: DataFrame, keys: list[str], source: list[str], limits: DataFrame | None = None, value: str = "value", more: DataFrame | None = None) -> DataFrame:
    """values (keys and source columns, which must not be null) with truncated, p_end, ending, length and base: the verdict on each value.

    limits: optional rows (keys, at_limit) of values that used up their token limit. Empty values are no case and must be left out
    by the caller. more: other complete texts of the corpus (column value). Every value is judged; equal tails are looked up once per order by a join on the tail's key."""
    looked = look(values, keys + [s for s in source if s not in keys], value)
    seen = durable(looked)
    corpus = values.select(value)
    if more is not None:
        corpus = corpus.unionByName(more.select(F.concat(F.col("value"), F.lit("\n.")).alias(value)))
    wanted = seen.filter("ending in ('bare', 'item')").select(*keys, F.posexplode("tail").alias("o", "key"))
    counts = continuations(corpus, value, only=key_filter(wanted))
    stats = counts.join(wanted.select("key").distinct(), "key", "left_semi")
    # the value's own end is not evidence for itself
    got = wanted.join(stats, "key").select(*keys, "o", (F.col("seen") - 1).alias("n"), (F.col("ended") + F.when(F.col("seen") - F.col("at_text_end") > 0, F.least(F.col("at_text_end") - 1, (F.col("seen") - F.col("at_text_end")) * 2) * 0.5).otherwise(0.0)).alias("e"), (F.col("seen") - F.col("at_text_end")).alias("elsewhere"))
    per = got.groupBy(*keys).agg(
        *[F.coalesce(F.max(F.when(F.col("o") == o, F.col("n"))), F.lit(0)).alias(f"n{o}") for o in range(3)],
        *[F.coalesce(F.max(F.when(F.col("o") == o, F.col("e"))), F.lit(0.0)).alias(f"e{o}") for o in range(3)],
        F.coalesce(F.max(F.when(F.col("o") == 0, F.col("elsewhere"))), F.lit(0)).alias("known"),
        F.coalesce(F.max(F.when(F.col("o") == 0, F.col("n") - F.col("elsewhere"))), F.lit(0)).alias("last_words"),
    )
    # sources: how often the terminator is missing; lengths at which bare ends pile up
    base = seen.groupBy(*source).agg(F.avg(F.col("ending").isin("bare", "item").cast("double")).alias("base"))
    hist = seen.filter("ending in ('bare', 'comma', 'broken') and length >= 40").groupBy(*source, "length").agg(F.count("*").alias("c"))
    field = [s for s in source if s != "model"] or source
    near = Window.partitionBy(*field).orderBy("length").rangeBetween(-15, 15)
    pile = hist.groupBy(*field, "length").agg(F.sum("c").alias("c")).withColumn("around", (F.sum("c").over(near) - F.col("c")) / 30)
    pile = pile.filter((F.col("c") >= 4) & (F.col("c") > 6 * F.greatest(F.col("around"), F.lit(0.25)))).select(*field, "length", F.lit(True).alias("piled"))
    j = seen.drop("tail").join(per, keys, "left").join(base, source).join(pile, [*field, "length"], "left")
    j = j.join(limits, keys, "left") if limits is not None else j.withColumn("at_limit", F.lit(False))
    p = F.lit(0.3)
    for o in range(3):
        p = (F.coalesce(F.col(f"e{o}"), F.lit(0.0)) + 1.0 * p) / (F.coalesce(F.col(f"n{o}"), F.lit(0)) + 1.0)
    unknown = F.coalesce(F.col("known"), F.lit(0)) <= 0
    # a known word in a place where it was never seen is more likely the head of a longer word
    p = F.when(F.coalesce(F.col("n1"), F.lit(0)) <= 0, F.least(p, F.lit(0.35))).otherwise(p)
    p = F.when(F.col("few"), F.greatest(p, F.lit(0.8))).otherwise(p)
    p = F.when(F.col("unmarked") & (p > 0.7), 0.98).otherwise(p)
    whole = F.when(unknown & (F.coalesce(F.col("last_words"), F.lit(0)) < 2) & ~F.col("coded"), 0.06).otherwise(0.95)
    p_end = F.when(F.col("ending") == "item", whole).when(unknown & F.col("few"), 0.8).when(unknown, F.when(F.col("coded"), 0.9).otherwise(0.06)).otherwise(F.greatest(F.lit(0.002), F.least(F.lit(0.998), p)))
    odds = F.log((1 - p_end) / p_end) + F.when(F.col("ending") == "item", 0.0).otherwise(F.when(F.coalesce("at_limit", F.lit(False)), 2.5).otherwise(0.0) + F.when(F.coalesce("piled", F.lit(False)), 1.5).otherwise(0.0)) + F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.log(F.greatest(F.col("base"), F.lit(0.01)) / 0.12)))
    truncated = F.when(F.col("ending").isin("broken", "comma"), True).when(F.col("ending") == "closed", False).otherwise(odds > 0)
    return j.select(*keys, *[s for s in source if s not in keys], truncated.alias("truncated"), p_end.alias("p_end"), "ending", "length", "base", F.coalesce("at_limit", F.lit(False)).alias("at_limit"), F.coalesce("piled", F.lit(False)).alias("piled"))


def token_limits(metrics: DataFrame, config: DataFrame) -> DataFrame:
    """(resp_id, field, at_limit): values whose generated length reached their model's generation_max_new_tokens. query_mode is read
    without regard to case and separators; of repeated rows any counts."""
    mode = F.regexp_replace(F.lower(F.trim("query_mode")), "[^a-z]+", "_")
    c = config.groupBy(F.lower(F.trim("name")).alias("m")).agg(F.max("generation_max_new_tokens").alias("most"))
    m = metrics.filter("query_mode is not null and generated_length is not null").select("resp_id", F.concat(mode, F.lit("_response")).alias("field"), F.lower(F.trim("model")).alias("m"), "generated_length")
    return m.join(c, "m").filter("generated_length >= most").groupBy("resp_id", "field").agg(F.lit(True).alias("at_limit"))


def source_rates(judged: DataFrame, source: list[str]) -> DataFrame:
    """(source, values, broken, share): how often each source breaks off."""
    return judged.groupBy(*source).agg(F.count("*").alias("values"), F.count_if("truncated").alias("broken"), F.round(F.avg(F.col("truncated").cast("double")), 6).alias("share"))
