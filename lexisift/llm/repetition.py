"""Problem 3: repeated content inside a single document, and how hosts do."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, is_empty, spec, spread

WORDS, CHARS = 4, 8  # shortest passage, in words or, in scripts without spaces, in characters
CHANGED_WORDS, CHANGED_CHARS = 1, 4  # longest change within it: a word
_UNIT = regex.compile(r"(?P<u>[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}ー])|(?P<n>\p{N}+(?:[.,:/]\p{N}+)*)|(?P<w>[\p{L}\p{M}\p{N}]+(?:['’‑-][\p{L}\p{M}\p{N}]+)*)")
_ASCII_UNIT = re.compile(r"([0-9]+(?:[.,:/][0-9]+)*)|([a-z0-9]+(?:['-][a-z0-9]+)*)")
_LIST_MARK = regex.compile(r"(?m)^[ \t]*(?:[-*+•#>]+|\(?(?:\p{N}{1,3}|[a-zA-Z]|[ivxIVX]{1,4})[.):])[ \t]+")


def units(text: str) -> tuple[list[str], bool]:
    """Comparable units and whether they are characters: words in lower case without punctuation and marks of numbering, numbers as
    one sign; characters where most of the text is in a script without spaces."""
    t = _LIST_MARK.sub("", text)
    if t.isascii():
        return ["#" if number else word for number, word in _ASCII_UNIT.findall(t.lower())], False
    t = unicodedata.normalize("NFKC", t).casefold()
    got = [(m.lastgroup, "#" if m.lastgroup == "n" else m.group()) for m in _UNIT.finditer(t)]
    chars = sum(k == "u" for k, _ in got)
    if chars > len(got) / 2:
        out = []
        for k, s in got:
            out.extend(s if k != "n" else "#")
        return out, True
    return [s for _, s in got], False


def repeated_flags(u: list[str], least: int, change: int = 1) -> list[bool]:
    """Which units lie in a passage of at least that many units said more than once; in each place up to change units may be
    exchanged, added or dropped at one point within so many equal ones.

    A passage is a row of windows of the shortest length, so windows that come back mark all their places. A changed window is two
    pieces with a gap of 0 to change units between them; it comes back where the same pieces stand with any such gap. Only units and
    neighbours that come back themselves can stand in one, which leaves few windows in usual texts. The work is linear in the text."""
    n = len(u)
    number: dict[str, int] = {}
    for x in u:
        number.setdefault(x, len(number))
    s = "".join(chr(number[x]) for x in u) if len(number) < 0x110000 else tuple(u)  # slices of strings are cheap
    one, two = Counter(s), Counter(s[i : i + 2] for i in range(n - 1))
    if max(two.values(), default=0) < 2:
        return [False] * n  # every passage that comes back holds a pair that does
    back = [0] * (n + 1)  # units from here on of which each neighbouring pair comes back
    for i in range(n - 1, -1, -1):
        if one[s[i]] > 1:
            back[i] = back[i + 1] + 1 if i + 1 < n and two[s[i : i + 2]] > 1 else 1
    seed = max(2, least // 2)  # windows that start closer to their own kind are no repetition of it
    ends: dict[tuple, list[int]] = {}  # pieces -> first and last start
    places = []
    for i in range(n - least + 1):
        if back[i] >= least:
            at = ends.setdefault((0, s[i : i + least]), [i, i])
            at[1] = i
            places.append((i, i + least, at))
        for k in range(1, min(back[i], least - 1) + 1):
            rest = least - k
            for j in range(i + k, min(i + k + change, n - rest) + 1):
                if back[j] >= rest:
                    at = ends.setdefault((k, s[i : i + k] + s[j : j + rest]), [i, i])
                    at[1] = i
                    places.append((i, j + rest, at))
    steps = [0] * (n + 1)
    for start, end, (first, final) in places:
        if start - first >= seed or final - start >= seed:
            steps[start] += 1
            steps[end] -= 1
    return [x > 0 for x in accumulate(steps[:n])]


def repeated_share(text: str | None) -> tuple[int, int]:
    """(units, repeated units) of a text; (0, 0) for null, empty and punctuation-only texts."""
    if not text:
        return 0, 0
    u, chars = units(text)
    return len(u), sum(repeated_flags(u, CHARS, CHANGED_CHARS) if chars else repeated_flags(u, WORDS, CHANGED_WORDS))


def shares(values: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """values with units, repeated and share (0 for texts without units). Each text is measured whole, by itself."""
    src = spread(values)
    head = spec(src, keys)

    def run(batches):
        for b in batches:
            got = [repeated_share(v.as_py()) for v in b.column(len(keys))]
            n, k = pa.array([x for x, _ in got], pa.int32()), pa.array([x for _, x in got], pa.int32())
            share = pa.array([y / x if x else 0.0 for x, y in got], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], n, k, share], [*keys, "units", "repeated", "share"])

    return src.select(*keys, value).mapInArrow(run, f"{head}, units int, repeated int, share double")


def host_verdicts(rows: DataFrame, host: list[str], failed: str) -> DataFrame:
    """rows with the host's number of values and failures, its failure rate shrunk to an empirical beta prior, and the host's verdict.

    The prior's mean and weight come from the hosts' rates by moments. A host is bad if its shrunk rate is more than twice the
    mean rate. Hosts are counted with partial sums before the shuffle; the prior is one row."""
    per = rows.groupBy(*host).agg(F.count("*").alias("host_n"), F.count_if(F.col(failed)).alias("host_failed"))
    p = F.col("host_failed") / F.col("host_n")
    prior = per.agg(F.avg(p).alias("m"), F.coalesce(F.var_samp(p), F.lit(0.0)).alias("v"), (F.sum("host_failed") / F.sum("host_n")).alias("all"))
    weight = F.greatest(F.lit(1.0), F.coalesce(F.try_divide(F.col("m") * (1 - F.col("m")), F.col("v")), F.lit(1e6)) - 1)
    rated = per.crossJoin(F.broadcast(prior)).withColumn("_w", weight)
    rate = (F.col("host_failed") + F.col("_w") * F.col("m")) / (F.col("host_n") + F.col("_w"))
    rated = rated.select(*host, "host_n", "host_failed", rate.alias("host_rate"), F.when(rate > 2 * F.col("m"), "bad").otherwise("usual").alias("host_verdict"))
    return rows.join(rated, host)


NEAR = 0.03  # a share so little below the threshold is left to the host's verdict


def repetition(values: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(resp_id, field, model, units, repeated, share, failed, degenerate, host_n, host_failed, host_rate, host_verdict) of the values that
    are not empty; the host of a value is its model and field. failed: its own share reaches the threshold. degenerate: it failed, or
    lies less than NEAR below the threshold and its host, by the shrunk rate of failures, is bad."""
    real = values.filter(~is_empty(F.col("value")))
    rows = shares(real, ["resp_id", "field", "model"]).withColumn("failed", (F.col("units") > 0) & (F.col("share") >= threshold))
    rows = rows.withColumn("model", F.coalesce("model", F.lit("")))
    judged = host_verdicts(durable(rows), ["model", "field"], "failed")
    return judged.withColumn("degenerate", F.col("failed") | ((F.col("units") > 0) & (F.col("share") >= threshold - NEAR) & (F.col("host_verdict") == "bad")))
