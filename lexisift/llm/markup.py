"""Problem 6: markup residue. Texts become clean text that keeps headings, lists, code and formulas.

A value is cut into containers of all kinds, each with its generalised path: tags with classes for HTML, the block or span for Markdown,
wiki text and LaTeX. Containers are scored by the text they hold; the paths of a host's values are voted on in Spark. Winning paths
decide which kinds of markup a value carries, and values are extracted again along them.
"""

from __future__ import annotations

import functools
import html
import re
from collections import defaultdict
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, is_empty, spec, spread

KINDS = ("html", "markdown", "wiki", "latex")
# Element names of HTML, and the commands and environments of LaTeX that text uses.
HTML_TAGS = (
    "a abbr address article aside audio b big blockquote body br button canvas caption center cite code col colgroup dd del details dfn div dl dt em embed "
    "fieldset figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main mark math meta "
    "nav noscript object ol option p pre q s samp script section select small source span strike strong style sub summary sup svg table tbody td textarea tfoot "
    "th thead time title tr tt u ul var video wbr"
)
LATEX_COMMANDS = (
    "section subsection subsubsection paragraph chapter part title author textbf textit texttt textsc textrm textsf textsuperscript textsubscript emph underline footnote cite citep citet ref eqref "
    "label caption includegraphics href url item begin end documentclass usepackage maketitle frac dfrac tfrac sqrt sum prod int lim cdot cdots ldots dots times div pm mp leq geq le ge neq approx equiv "
    "infty alpha beta gamma delta epsilon varepsilon theta lambda mu pi rho sigma tau phi omega Delta Sigma Omega mathrm mathbf mathcal mathbb mathit operatorname left right bigl bigr text quad qquad "
    "hline toprule midrule bottomrule centering noindent newline newpage clearpage vspace hspace bibliography verb hat bar vec partial nabla forall exists rightarrow Rightarrow to in subset cup cap"
)
_TAG = re.compile(r"<(/?)(" + "|".join(sorted(HTML_TAGS.split(), key=len, reverse=True)) + r")(\s[^<>]*|/)?>", re.I)
_OPEN_TAG_CUT = re.compile(r"<(?:" + "|".join(sorted(HTML_TAGS.split(), key=len, reverse=True)) + r")\s+[a-z-]+=[^<>]*$", re.I)
_COMMENT = re.compile(r"<!--|<!DOCTYPE|<\?xml", re.I)
_ENTITY = re.compile(r"&(?:#\d{1,7}|#x[0-9a-f]{1,6}|[a-z][a-z0-9]{1,30});", re.I)
_LATEX = re.compile(r"\\(?:" + "|".join(sorted(LATEX_COMMANDS.split(), key=len, reverse=True)) + r")(?![A-Za-z])(?:\s*[\[{(]|\b|(?=[^A-Za-z]))")
_LATEX_BRACE = re.compile(r"\\[a-zA-Z]+\*?(?:\[[^\]\n]*\])?\{")
_MATH = re.compile(r"\\\[|\\\(|\$\$[^$]+\$\$|(?<![\\$\w])\$(?=[^$\n]*(?:\\[a-zA-Z]+|[_^]\{|[a-zA-Z]_\w|\^\d))[^$\n]+\$")
_CODE_SPAN = re.compile(r"(?<!`)`[^`\n]+`(?!`)")
_FENCE = re.compile(r"(?m)^[ \t]*(?:```|~~~)")
_WIKI_HEAD = re.compile(r"(?m)^(={2,6})[ \t]*([^=\n].*?)[ \t]*\1[ \t]*$")
_WIKI_HEAD_CUT = re.compile(r"(?m)^(={2,6})[ \t]+\w[^=\n]*\Z")
_WIKI_LINK = re.compile(r"\[\[[^\[\]\n|]+(?:\|[^\[\]\n]*)?(?:\]\]|\Z)")
_WIKI_TEMPLATE = re.compile(r"\{\{\s*[\w:#][^{}]*(?:\}\}|\Z)")
_WIKI_TABLE = re.compile(r"(?m)^\{\|")
_WIKI_QUOTES = re.compile(r"(?<!')('{2,3}|'{5})(?=\S)[^\n]*?(?<=\S)\1(?!')")
_WIKI_QUOTES_CUT = re.compile(r"(?:^|(?<=\s))'{2,3}(?=[^\W_])[^'\n]*\Z")
_WIKI_OTHER = re.compile(r"__(?:TOC|NOTOC|FORCETOC|NOEDITSECTION)__|<ref\b|</ref>|<nowiki>|\[https?://[^\s\]]+ [^\]\n]+\]")
_MD_HEAD = re.compile(r"(?m)^#{1,6}[ \t]+(\S.*?)[ \t#]*$")
_MD_SETEXT = re.compile(r"(?m)^(?=.*\w)[^\n|<>{}]{1,120}\n(?:={3,}|-{3,})[ \t]*$")
_MD_STRONG = re.compile(r"(?<![\w*])\*\*(?=[^\s*])[^\n]*?(?<=[^\s*])\*\*(?![\w*])|(?<![\w*])\*\*(?=[^\s*])[^\n*]+?\*\*|(?<![\w_])__(?=[^\s_])[^\n]*?(?<=[^\s_])__(?![\w_])")
_MD_EM = re.compile(r"(?<![\w*\\])\*(?=[^\s*])[^\n]*?(?<=[^\s*])\*(?![\w*])|(?<![\w_\\])_(?=[^\s_])[^_\n]*?(?<=[^\s_])_(?![\w_])")
_MD_CUT = re.compile(r"(?m)^(?:(?:[-*+]|\d+[.)])[ \t]+)?(?:\*\*|\*|__)(?=[^\W_])[^*\n]*\Z")
_MD_STRIKE = re.compile(r"~~(?=\S)[^~\n]+(?:~~|\Z)")
_MD_LINK = re.compile(r"!?\[[^\[\]\n]+\]\((?:[^()\s]+)(?:\s+\"[^\"\n]*\")?(?:\)|\Z)|^\[[^\]\n]+\]:[ \t]+\S+", re.M)
_MD_TABLE = re.compile(r"(?m)^[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)+\|?[ \t]*$")
_MD_QUOTE = re.compile(r"(?m)^>[ \t]+\S[^\n]*(?:\n>[^\n]*)*")
_MD_TASK = re.compile(r"(?m)^[ \t]*[-*+][ \t]+\[[ xX]\][ \t]+\S")
_MD_RULE = re.compile(r"(?m)^[ \t]*(?:\*[ \t]*){3,}$|^[ \t]*(?:_[ \t]*){3,}$")
# Words of answer tags, which are not markup whatever dress they wear.
_ANSWER_TAG = re.compile(
    r"(?im)^[ \t]*(?:#{1,6}[ \t]+)?(?:\*\*|__)?(?:final answer|short answer|answer|response|antwort|réponse|respuesta|resposta|ответ|答案|回答|答え|คำตอบ|उत्तर)[ \t]*(?:\*\*|__)?[ \t]*(?:[:：](?:\*\*|__)?|(?=$))(?:[ \t]*(?:\*\*|__)(?=[ \t]|$))?"
)
MARKS = ("<", "&", "\\", "$", "*", "#", "[", "{", "`", "~", "_", "=", "'", ">", "---")  # no markup is without one of these
PASSIVE = ("script", "style", "noscript", "nav", "footer", "aside", "form", "select", "button", "iframe", "template", "head")


def kinds_of(text: str) -> list[str]:
    """The kinds of markup in a text. Answer tags, plain lists, and symbols in their ordinary use are none."""
    t = _ANSWER_TAG.sub(" ", text)
    out = []
    if _TAG.search(t) or _COMMENT.search(t) or _OPEN_TAG_CUT.search(t) or any(html.unescape(m.group()) != m.group() for m in _ENTITY.finditer(t)):
        out.append("html")
    fences = bool(_FENCE.search(t)) or bool(_CODE_SPAN.search(t))
    body = _CODE_SPAN.sub(" ", re.sub(r"(?ms)^[ \t]*(```|~~~).*?(?:^[ \t]*\1[ \t]*$|\Z)", " ", t))
    prose = _MATH.sub(" ", body)
    if fences or any(p.search(prose) for p in (_MD_HEAD, _MD_SETEXT, _MD_STRONG, _MD_STRIKE, _MD_LINK, _MD_TABLE, _MD_TASK, _MD_RULE, _MD_CUT, _MD_QUOTE)) or _emphasis(prose):
        if fences or not _wiki_only(prose):
            out.append("markdown")
    if any(p.search(body) for p in (_WIKI_HEAD, _WIKI_HEAD_CUT, _WIKI_LINK, _WIKI_TEMPLATE, _WIKI_TABLE, _WIKI_QUOTES, _WIKI_QUOTES_CUT, _WIKI_OTHER)):
        out.append("wiki")
    if _LATEX.search(body) and not _only_path(body) or _LATEX_BRACE.search(body) or _MATH.search(body):
        out.append("latex")
    return out


def _emphasis(t: str) -> bool:
    return any(not re.fullmatch(r"[*_][\W\d]*[*_]", m.group()) for m in _MD_EM.finditer(t))


def _wiki_only(t: str) -> bool:
    """A # line is a wiki list where the line is dressed as wiki text and nothing else speaks for Markdown."""
    if not any(p.search(t) for p in (_WIKI_HEAD, _WIKI_LINK, _WIKI_TEMPLATE, _WIKI_TABLE, _WIKI_QUOTES, _WIKI_QUOTES_CUT)):
        return False
    rest = re.sub(r"(?m)(?:^[#*]+[ \t]+.*(?:\n|\Z)){2,}|^[#*]+[ \t]+(?=.*(?:''|\[\[|\{\{)).*$", " \n", t)
    return not (any(p.search(rest) for p in (_MD_HEAD, _MD_SETEXT, _MD_STRONG, _MD_STRIKE, _MD_LINK, _MD_TABLE, _MD_TASK, _MD_RULE, _MD_CUT, _MD_QUOTE)) or _emphasis(rest))


def _only_path(t: str) -> bool:
    """All backslash words belong to file paths such as C:\\temp\\to."""
    return all(re.search(r"(?:[A-Za-z]:|\\\\\w+|\w)(?:\\[\w.-]+)*$", t[max(0, m.start() - 80) : m.start()]) and not re.match(r"\\\w+\s*[\[{]", t[m.start() :]) for m in _LATEX.finditer(t))


class _Blocks(HTMLParser):
    """Containers of an HTML value: (path, text). Inline elements stay in the text of their block."""

    BLOCK = set("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section summary table tbody td tfoot th thead tr ul script style noscript title select button br".split())
    VOID = {"br", "hr", "img", "input", "meta", "link", "wbr", "source", "col", "embed"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[str] = []
        self.blocks: list[list] = [["", "", 0]]
        self.in_link = 0

    def path(self) -> str:
        return "/".join(x for x in self.stack if x.split(".")[0] in self.BLOCK)

    def _new(self):
        self.blocks.append([self.path(), "", 0])

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.blocks[-1][1] += "\n"
            return
        if tag in self.VOID:
            return
        name = dict(attrs).get("class") or ""
        label = tag + "".join("." + re.sub(r"\d+", "0", c) for c in sorted((name or "").split()))
        self.stack.append(label)
        if tag == "a":
            self.in_link += 1
        if tag in self.BLOCK:
            self._new()
            if tag == "tr":
                self.blocks[-1][1] = "\x01"  # a new row
                self._new()
        elif tag == "code":
            self.blocks[-1][1] += "`"

    def handle_endtag(self, tag):
        at = next((i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i].split(".")[0] == tag), None)
        if at is None:
            return
        del self.stack[at:]
        if tag == "a":
            self.in_link = max(0, self.in_link - 1)
        if tag in self.BLOCK:
            self._new()
        elif tag == "code":
            self.blocks[-1][1] += "`"

    def handle_data(self, data):
        self.blocks[-1][1] += data
        if self.in_link:
            self.blocks[-1][2] += len(data)


def blocks(text: str) -> list[tuple[str, str, int]]:
    """(generalised path, text, characters in links) of each block of a value with HTML; one block without path for other values."""
    p = _Blocks()
    p.feed(text)
    p.close()
    return [(a, b, c) for a, b, c in p.blocks if b.strip()]


def _html_text(text: str, losing: frozenset) -> str:
    out, row = [], []

    def flush():
        if row:
            out.append("| " + " | ".join(row) + " |")
            row.clear()

    for path, body, _ in blocks(text):
        parts = [x.split(".")[0] for x in path.split("/")] if path else []
        if path in losing or any(x in PASSIVE for x in parts):
            continue
        last = parts[-1] if parts else ""
        if last in ("td", "th"):
            row.append(" ".join(body.split()))
            continue
        flush()
        if body == "\x01":
            continue
        if "pre" in parts:
            out.append("```\n" + body.strip("\n") + "\n```")
        elif re.fullmatch("h[1-6]", last):
            out.append("#" * int(last[1]) + " " + " ".join(body.split()))
        elif last in ("li", "dd", "dt"):
            out.append("- " + " ".join(body.split()))
        else:
            out.append("\n".join(" ".join(x.split()) for x in body.split("\n")).strip())
    flush()
    return "\n".join(out)


def _wiki_text(t: str) -> str:
    def table(m):
        rows = []
        for r in re.split(r"(?m)^\|-.*$", m.group(1)):
            cells = [c.strip() for line in r.split("\n") if line and line[0] in "!|" and not line.startswith("|}") for c in re.split(r"!!|\|\|", line.lstrip("!|+"))]
            if cells:
                rows.append("| " + " | ".join(cells) + " |")
        return "\n".join(rows)

    t = re.sub(r"(?ms)^\{\|[^\n]*\n(.*?)(?:^\|\}[ \t]*$|\Z)", table, t)
    t = re.sub(r"\{\{[^{}|]*\|([^{}]*)\}\}", lambda m: " ".join(x.split("=", 1)[-1].strip() for x in m.group(1).split("|")), t)
    t = re.sub(r"\{\{[^{}]*\}\}", " ", t)
    t = re.sub(r"\[\[(?:[^\[\]\n|]+\|)?([^\[\]\n|]+)\]\]", r"\1", t)
    t = re.sub(r"(?m)(?:^#+[ \t]+.*(?:\n|\Z)){2,}|^#+[ \t]+''.*$", lambda m: re.sub(r"(?m)^#+[ \t]+", "- ", m.group()), t)
    t = re.sub(r"(?m)^\*+[ \t]*", "- ", t)
    t = _WIKI_HEAD.sub(lambda m: "#" * len(m.group(1)) + " " + m.group(2), t)
    return re.sub(r"'{2,5}", "", t)


def _latex_text(t: str) -> str:
    t = re.sub(r"(?ms)\\begin\{(?:verbatim|lstlisting|minted)\}(?:\[[^\]]*\]|\{[^}]*\})?(.*?)\\end\{[a-z]+\}", lambda m: "```\n" + m.group(1).strip("\n") + "\n```", t)
    kept: list[str] = []

    def keep(m):
        kept.append(m.group())
        return f"\x00{len(kept) - 1}\x00"

    t = re.sub(r"(?s)```.*?```|\\\[.*?\\\]|\\\(.*?\\\)|\\begin\{(equation|align|gather|math)\*?\}.*?\\end\{\1\*?\}|\$\$.*?\$\$", keep, t)
    t = _MATH.sub(keep, t)
    t = re.sub(r"\\(chapter|section|subsection|subsubsection)\*?\{([^{}]*)\}", lambda m: {"chapter": "#", "section": "##", "subsection": "###"}.get(m.group(1), "####") + " " + m.group(2), t)
    t = re.sub(r"\\begin\{[^{}]*\}(?:\[[^\]]*\])?|\\end\{[^{}]*\}", "", t)
    t = re.sub(r"\\item(?:\[[^\]]*\])?[ \t]*", "- ", t)
    t = re.sub(r"\\footnote\{([^{}]*)\}", r" (\1)", t)
    n = 1
    while n:  # from the inside out, as deep as they nest
        t, n = re.subn(r"\\(?:text\w+|emph|underline|mbox|caption|title|author|url)\*?\{([^{}]*)\}", r"\1", t)
    t = re.sub(r"\\(?:label|ref|cite\w*|usepackage|documentclass|vspace|hspace|bibliography)\*?(?:\[[^\]]*\])?\{[^{}]*\}", "", t)
    t = re.sub(r"\\([%&#_$])", r"\1", t)
    return re.sub("\x00(\\d+)\x00", lambda m: kept[int(m.group(1))], t)


def _markdown_text(t: str) -> str:
    kept: list[str] = []

    def keep(m):
        kept.append(m.group())
        return f"\x00{len(kept) - 1}\x00"

    t = re.sub(r"(?ms)^[ \t]*(```|~~~).*?(?:^[ \t]*\1[ \t]*$|\Z)", keep, t)
    t = _MATH.sub(keep, _CODE_SPAN.sub(keep, t))
    t = re.sub(r"(?m)^([^\n|]*\w[^\n|]*)\n={3,}[ \t]*$", r"# \1", t)
    t = re.sub(r"(?m)^([^\n|]*\w[^\n|]*)\n-{3,}[ \t]*$", r"## \1", t)
    t = re.sub(_MD_TABLE.pattern + r"\n?", "", t)
    t = re.sub(r"!?\[([^\[\]\n]+)\]\([^()\n]*\)", r"\1", t)
    n = 1
    while n:
        t, n = re.subn(r"(\*\*|__)(?=[^\s*_])(.+?)(?<=[^\s*_])\1", r"\2", t)
        t, m = re.subn(r"(?<![\w*])\*(?=[^\s*])([^\n]*?)(?<=[^\s*])\*(?![\w*])", r"\1", t)
        n += m
    t = re.sub(r"(?<![\w_])_(?=[^\s_])([^_\n]*?)(?<=[^\s_])_(?![\w_])", r"\1", t)
    t = re.sub(r"~~([^~\n]+)~~", r"\1", t)
    t = re.sub(r"(?m)^>[ \t]?", "", t)
    t = re.sub(r"(?m)^([ \t]*)[*+][ \t]+", r"\1- ", t)
    return re.sub("\x00(\\d+)\x00", lambda m: kept[int(m.group(1))], t)


def clean(text: str, kinds: list[str], losing: frozenset = frozenset()) -> str:
    """Clean text: headings as # lines, list items as - lines, code in fences, formulas as written. Text under losing paths is dropped."""
    t = text
    if "html" in kinds:
        t = _html_text(t, losing)
    if "latex" in kinds:
        t = _latex_text(t)
    if "wiki" in kinds:
        t = _wiki_text(t)
    if "markdown" in kinds:
        t = _markdown_text(t)
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+(?=\n|$)", "", t)).strip()


# Constructs other than HTML containers by path: the pattern whose find is the container, in the text without answer tags.
_CONSTRUCTS = (
    ("markdown/fence", _FENCE), ("markdown/code", _CODE_SPAN), ("markdown/heading", _MD_HEAD), ("markdown/underlined", _MD_SETEXT), ("markdown/strong", _MD_STRONG), ("markdown/strike", _MD_STRIKE), ("markdown/link", _MD_LINK),
    ("markdown/table", _MD_TABLE), ("markdown/task", _MD_TASK), ("markdown/rule", _MD_RULE), ("markdown/quote", _MD_QUOTE), ("markdown/emphasis", _MD_EM), ("markdown/cut", _MD_CUT),
    ("wiki/heading", _WIKI_HEAD), ("wiki/heading_cut", _WIKI_HEAD_CUT), ("wiki/link", _WIKI_LINK), ("wiki/template", _WIKI_TEMPLATE), ("wiki/table", _WIKI_TABLE), ("wiki/quotes", _WIKI_QUOTES), ("wiki/quotes_cut", _WIKI_QUOTES_CUT), ("wiki/other", _WIKI_OTHER),
    ("latex/command", _LATEX), ("latex/brace", _LATEX_BRACE), ("latex/math", _MATH),
)
#: Constructs that hold no text of their own but mark what stands beside them.
_BARE = ("markdown/fence", "markdown/table", "markdown/rule", "markdown/cut", "wiki/table", "wiki/other", "latex/command", "latex/brace", "latex/math", "html/entity", "html/cut")
_INK = re.compile(r"[^\W_]")


def containers(text: str) -> list[tuple[str, float]]:
    """(path, score) of the containers of a value: the characters of text in containers of that path, less twice those in links. A mark that
    holds no text scores 1, a container that should hold some and doesn't -1."""
    kinds = kinds_of(text)
    if not kinds:
        return []
    t = _ANSWER_TAG.sub(" ", text)
    found: dict[str, float] = defaultdict(float)
    if "html" in kinds:
        for path, body, linked in blocks(text):
            if path:
                found["html/" + path] += len(body) - 2 * linked
        if not found:
            found["html/entity" if _ENTITY.search(t) else "html/cut"] = 1.0
    for path, pattern in _CONSTRUCTS:
        if path.split("/")[0] in kinds:
            for m in pattern.finditer(t):
                found[path] += 1.0 if path in _BARE else len(_INK.findall(m.group())) or -1.0
    return list(found.items())


def value_paths(values: DataFrame, keys: list[str], host: str, value: str = "value") -> DataFrame:
    """(keys, host, paths): the containers of each value that has any, read once. host is empty for null."""
    src = spread(values.select(*keys, F.coalesce(F.col(host).cast("string"), F.lit("")).alias("_host"), value))
    head, k = spec(src, keys), len(keys)
    kind = pa.list_(pa.struct([("path", pa.string()), ("score", pa.float64())]))

    def run(batches):
        for b in batches:
            got = [containers(v.as_py()) for v in b.column(k + 1)]
            at = pa.array([i for i, x in enumerate(got) if x], pa.int32())
            rows = pa.array([[{"path": p, "score": s} for p, s in x] for x in got if x], kind)
            yield pa.RecordBatch.from_arrays([*[c.take(at) for c in b.columns[: k + 1]], rows], [*keys, "_host", "paths"])

    return src.mapInArrow(run, f"{head}, _host string, paths array<struct<path:string,score:double>>")


def path_votes(paths: DataFrame) -> DataFrame:
    """(host, path, votes, against, wins): each value votes for a path of its host if the path's containers hold more text than links in it,
    else against it. A path wins unless most votes are against it. Votes are added up per partition before the shuffle."""
    p = paths.select(F.col("_host").alias("host"), F.explode("paths").alias("p")).select("host", "p.path", "p.score")
    v = p.groupBy("host", "path").agg(F.count("*").alias("votes"), F.count_if(F.col("score") < 0).alias("against"))
    return v.withColumn("wins", 2 * F.col("against") <= F.col("votes"))


def verdicts(paths: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, kinds, losing): per value the kinds of its winning paths, in the order of KINDS, and its own losing paths. HTML whose containers
    all lost is boilerplate: its text goes, its kind stays. A losing path of another kind is no markup.

    Only paths are shuffled. The votes hold one row per host and path; a hot path's rows are split by adaptive execution."""
    rows = paths.select(*keys, F.col("_host").alias("host"), F.explode("paths.path").alias("path"))
    lost = path_votes(paths).filter(~F.col("wins")).select("host", "path", F.lit(True).alias("lost"))
    judged = rows.join(lost, ["host", "path"], "left").withColumn("kind", F.substring_index("path", "/", 1))
    counts = (F.col("kind") == "html") | F.col("lost").isNull()
    by = judged.groupBy(*keys).agg(F.collect_set(F.when(counts, F.col("kind"))).alias("_k"), F.collect_set(F.when(F.col("lost") & (F.col("kind") == "html"), F.substring("path", 6, 1 << 20))).alias("losing"))
    return by.select(*keys, F.filter(F.array(*[F.lit(k) for k in KINDS]), lambda k: F.array_contains("_k", k)).alias("kinds"), "losing").filter(F.size("kinds") > 0)


def marked(values: DataFrame, value: str = "value") -> DataFrame:
    """The values that are not empty and hold a sign that markup cannot do without."""
    some = functools.reduce(lambda a, c: a | F.contains(F.col(value), F.lit(c)), MARKS, F.lit(False))
    return values.filter(some).filter(~is_empty(F.col(value)))


def kinds_found(values: DataFrame, keys: list[str], host: str = "model", value: str = "value") -> DataFrame:
    """(keys, kinds) of the values that carry markup, by the winning paths of their hosts. Texts are read once and not shuffled."""
    return verdicts(durable(value_paths(marked(values, value), keys, host, value)), keys).select(*keys, "kinds")


def extract(values: DataFrame, keys: list[str], host: str = "model", value: str = "value") -> DataFrame:
    """(keys, kinds, clean_text) of the values that carry markup; text of losing containers is left out. Empty values are none. keys must
    tell values apart."""
    real = marked(values, value)
    found = verdicts(durable(value_paths(real, keys, host, value)), keys)
    src = real.select(*keys, F.col(value).alias("_v")).join(found, keys).select(*keys, "kinds", "losing", "_v")
    head, k = spec(src, keys), len(keys)

    def run(batches):
        for b in batches:
            out = [clean(v, ks, frozenset(lose)) for ks, lose, v in zip(*[b.column(k + i).to_pylist() for i in range(3)])]
            yield pa.RecordBatch.from_arrays([*b.columns[: k + 1], pa.array(out, pa.string())], [*keys, "kinds", "clean_text"])

    return src.mapInArrow(run, f"{head}, kinds array<string>, clean_text string")
