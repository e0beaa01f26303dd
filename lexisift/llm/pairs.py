"""Problem 7: defective pairs of prompt and response.

The clauses of a response are tagged as answer, refusal, echo, foreign or unfinished by a linear-chain conditional random field,
trained on labelled responses composed from sentences written for this purpose. The shares of a response's characters that its
tags cover decide the pair's defect.
"""

from __future__ import annotations

import functools
import random
import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import INVISIBLE, is_empty, spec, spread
from .refusals import labelled, learn, score
from .seed_sentences import SEED
from .sentences import sentence_ends

TAGS = ("answer", "refusal", "echo", "foreign", "unfinished")

# Frequent words of the languages in Latin script.
FUNCTION_WORDS = {
    "en": "the of and to in is that for it as with was on are by be this at from or an which have not but they you we his her their will can has been were would there if when who what how does do did after before under into than only any each must may should our your its",
    "de": "der die das und ist nicht von zu mit den dem des ein eine einer einem einen für auf im sich auch als an es bei nach aus wird werden wurde sind oder dass wie aber wenn nur noch kann muss müssen darf wir sie ihre ihr zum zur durch über unter vor seit innerhalb ohne bis am um warum wann wer welche gilt",
    "fr": "le la les de des du et est une un dans pour que qui sur avec pas ne par au aux ce cette ces il elle ils sont été être avoir a ont plus ou mais son sa ses leur leurs nous vous je se y en après avant sans sous entre lorsque quand pourquoi quel quelle doit peut depuis jusqu",
    "es": "el la los las de del y es una un en para que por con no se su sus al lo como más pero fue son ha han está este esta estos estas o si ya muy sin sobre entre después antes cuando cuándo quién qué cómo debe puede desde hasta nos le les también porque durante",
    "pt": "o a os as de do da dos das e é uma um em no na nos nas para que por com não se seu sua seus suas ao à pelo pela como mais mas foi são tem está este esta ou já muito sem sobre entre depois antes quando quem qual deve pode desde até também porque durante pelos aos às após há",
}
_WORDS = {k: frozenset(v.split()) for k, v in FUNCTION_WORDS.items()}
_SIGNS = {"de": "äöüß", "fr": "àâçèêëîïôùûœ", "es": "ñ¿¡", "pt": "ãõ"}
_SCRIPTS = (("hi", "ऀ", "ॿ"), ("th", "ก", "๛"), ("ja", "ぁ", "ヿ"), ("zh", "一", "鿿"), ("ru", "Ѐ", "ӿ"), ("ko", "가", "힣"), ("ar", "؀", "ۿ"), ("el", "Ͱ", "Ͽ"), ("he", "֐", "׿"))


_BY_WORD: dict[str, tuple] = {w: tuple(k for k in _WORDS if w in _WORDS[k]) for w in frozenset().union(*_WORDS.values())}
_FOREIGN_SCRIPT = regex.compile("[" + "".join(f"{a}-{b}" for _, a, b in _SCRIPTS) + "]")
_LETTER_WORDS = regex.compile(r"[\p{L}\p{M}]+")


@functools.lru_cache(maxsize=20_000)
def language(text: str) -> tuple[str | None, float]:
    """(language, evidence): by script, for Latin script by frequent words and letters; (None, 0) if nothing speaks for one."""
    if not text.isascii():
        other = _FOREIGN_SCRIPT.findall(text)
        if other:
            by = Counter()
            for c, n in Counter(other).items():
                by[next(code for code, a, b in _SCRIPTS if a <= c <= b)] += n
            latin = sum(map(str.isalpha, text)) - sum(map(str.isalpha, other))
            code, n = by.most_common(1)[0]
            if code == "zh" and by.get("ja", 0) >= 0.06 * (n + by["ja"]):
                code, n = "ja", n + by["ja"]
            elif code == "ja":
                n += by.get("zh", 0)
            # ideographs and syllables say more per character than letters
            if n * (2 if code in ("zh", "ja", "ko") else 1) > latin:
                return code, float(min(n, 20))
    low = text.lower()
    score = dict.fromkeys(_WORDS, 0.0)
    for w in _LETTER_WORDS.findall(low):
        for k in _BY_WORD.get(w, ()):
            score[k] += 1
    if not text.isascii():
        for k, signs in _SIGNS.items():
            score[k] += 1.5 * min(3, sum(low.count(c) for c in signs))
    first, second = sorted(score.items(), key=lambda x: -x[1])[:2]
    if first[1] < 1 or first[1] - second[1] < 0.5:
        return None, 0.0
    return first[0], first[1] - 0.5 * second[1]


# Courtesies that go with declining.
_SOFT = (
    r"\b(?:please|kindly|you (?:should|might|may|could)(?: want to)?|i (?:suggest|recommend))\b[^.!?]{0,30}\b(?:consult|contact|ask|speak|talk|seek|see|refer|turn|reach)|\b(?:sorry|apologi[sz]e|apologies|unfortunately|regret)\b|\bhope (?:you|this|that)[^.!?]{0,12}understand|\bthank(?:s| you)\b|\b(?:anything|something) else\b|\bqualified (?:professional|adviser|advisor|expert)|\btry (?:rephrasing|again|asking)|\brephras|\blet me know\b|\bfeel free\b|\bfor your understanding"
    r"|\b(?:leider|tut mir leid|bedaure|entschuldig\w+|bitte wenden|wenden sie sich|fachperson|fachmann|anwalt|verständnis)\b|\b(?:désolée?|malheureusement|regrette|veuillez|consultez|adressez-vous|contactez|professionnel)\b|\b(?:lo siento|lamento|lamentablemente|disculpe|consulte|diríjase|póngase en contacto|profesional)\b|\b(?:desculpe|infelizmente|lamento|consulte|dirija-se|contacte|profissional)\b"
    r"|к сожалению|извините|простите|сожалею|обратитесь|проконсультируйтесь|специалист|抱歉|对不起|遗憾|请咨询|请联系|专业人士|申し訳|すみません|残念|恐れ入り|ご相談ください|お問い合わせ|専門家|क्षमा|खेद|माफ़|कृपया किसी|विशेषज्ञ से|ขออภัย|ขอโทษ|เสียใจ|โปรดปรึกษา|กรุณาติดต่อ|ผู้เชี่ยวชาญ"
)
_COURTESY = regex.compile(_SOFT, regex.I)
# Heads that announce a repeated question.
_ECHO_HEAD = regex.compile(r"^[\W_]*(?:(?:the |your |my )?(?:question|query|prompt)(?: (?:is|was|asked|reads))?|you (?:asked|wrote|want to know|are asking)|q|i was asked|(?:die |ihre )?frage(?: lautet)?|sie fragten|(?:la |votre )?question(?: est)?|vous (?:demandez|avez demandé)|(?:la |su )?pregunta(?: es)?|usted pregunt\w+|(?:a |sua )?pergunta(?: é)?|você perguntou|вопрос|вы спросили|问题|问|您问|質問|問|प्रश्न|सवाल|คำถาม)\s*[:：\-–—]", regex.I)
_TAG_HEAD = regex.compile(r"^[\W_]*(?:final answer|answer|response|antwort|réponse|respuesta|resposta|ответ|答案|回答|答え|उत्तर|คำตอบ)[*_\s]*[:：]\s*", regex.I)
_SPLIT = regex.compile(r"(?<=[,;])\s+(?=(?:but|yet|however|so|though|although|because|aber|doch|denn|jedoch|mais|car|pero|sino|aunque|mas|porém|но|однако|а)\b)|(?<=；)")
_ASCII_UNITS = re.compile("[a-z0-9]+")
_UNITS = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]|[\p{L}\p{M}\p{N}]+")


@functools.lru_cache(maxsize=4096)
def _question(q: str) -> tuple[list[str], frozenset, frozenset]:
    u = _units(q)
    return u, frozenset(u), frozenset(zip(u, u[1:]))


def _units(t: str) -> list[str]:
    if t.isascii():
        return _ASCII_UNITS.findall(t.lower())
    return _UNITS.findall(unicodedata.normalize("NFKC", t).casefold())


def clauses(text: str) -> list[str]:
    out = []
    for s, e, _ in sentence_ends(text):
        out += [c for c in _SPLIT.split(text[s - 1 : e]) if c and c.strip()]
    return out


FEATURES = ("bias", "declines", "may_decline", "soft", "echo_full", "echo_most", "echo_some", "echo_none", "echo_head", "echo_whole", "other_language", "same_language", "no_language", "cut", "first", "last", "short", "digits", "after_refusal", "long")
DECLINES, MAY_DECLINE = 1.0, -0.5  # log-odds of the learned word scores

_AT = {name: i for i, name in enumerate(FEATURES)}
_DIGIT = regex.compile(r"\p{N}")


def features(cs: list[str], question: str, value: str, words: dict[str, float]) -> np.ndarray:
    """One row of 0/1 features per clause of the value, but for cut. words: learned scores of declining."""
    _, qset, qpairs = _question(question)
    ql, _ = language(question)
    whole = Counter()
    known = [language(c) for c in cs]
    for k, w in known:
        if k:
            whole[k] += w
    main = whole.most_common(1)[0][0] if whole else None
    x = np.zeros((len(cs), len(FEATURES)))
    scores = [score(c, words) for c in cs]
    refused = any(s > DECLINES for s in scores)  # courtesies mean something only beside a refusal
    repeats = _only_question(question, value)
    seen = False
    for i, c in enumerate(cs):
        tagless = _TAG_HEAD.sub("", c)
        body = _ECHO_HEAD.sub("", tagless)
        u = _units(body)
        shared = sum(w in qset for w in u) / len(u) if u else 0.0
        pairs = sum(p in qpairs for p in zip(u, u[1:])) / (len(u) - 1) if len(u) > 1 else 0.0
        lang, weight = known[i] if body == c else language(body)
        no = scores[i] > DECLINES
        f = ["bias"]
        f += ["declines"] * no + ["may_decline"] * (MAY_DECLINE < scores[i] <= DECLINES) + ["soft"] * (refused and bool(_COURTESY.search(c))) + ["echo_head"] * (body != tagless) + ["echo_whole"] * repeats
        f.append("echo_full" if shared >= 0.85 and pairs >= 0.7 else "echo_most" if shared >= 0.65 and pairs >= 0.4 else "echo_some" if shared >= 0.4 else "echo_none")
        # a clause speaks another language only if the response as a whole does, so that quotations do not count
        if ql and lang and lang != ql and main != ql and (weight >= 2 or main == lang and weight >= 1):
            f.append("other_language")
        elif lang and lang == ql:
            f.append("same_language")
        else:
            f.append("no_language")
        f += ["first"] * (i == 0) + ["last"] * (i == len(cs) - 1)
        f += ["short"] * (len(u) <= 4) + ["long"] * (len(u) >= 12) + ["digits"] * bool(_DIGIT.search(c)) + ["after_refusal"] * seen
        seen = seen or no
        x[i, [_AT[name] for name in f]] = 1.0
    return x


# Labelled refusals, questions and traps written for training.
_REFUSALS = {
    "en": ["I cannot help with this.", "I'm sorry, but I am unable to answer that.", "We are not allowed to comment on this. Please contact a lawyer.", "I must decline this request. Thank you for your patience.", "As an AI, I can't give advice. Please see a doctor.", "Sorry. I will not discuss this topic. Is there anything else?", "I am not in a position to advise you. I hope you understand."],
    "de": ["Ich kann Ihnen dabei nicht helfen.", "Leider darf ich darauf nicht antworten. Bitte wenden Sie sich an einen Anwalt.", "Tut mir leid, das kann ich nicht beantworten."],
    "fr": ["Je ne peux pas vous aider.", "Désolé, je ne suis pas autorisé à répondre. Veuillez consulter un avocat."],
    "es": ["No puedo ayudarle con eso.", "Lo siento, no me es posible responder. Consulte a un abogado."],
    "pt": ["Não posso ajudar com isso.", "Desculpe, não me é possível responder. Consulte um advogado."],
    "ru": ["Я не могу ответить на это.", "Извините, я не вправе помочь. Обратитесь к юристу."],
    "zh": ["我无法回答。", "对不起，我不能提供帮助。请联系律师。"],
    "ja": ["お答えできません。", "申し訳ございませんが、回答できません。弁護士にご相談ください。"],
    "hi": ["मैं उत्तर नहीं दे सकता।", "क्षमा करें, मुझे अनुमति नहीं है। कृपया किसी वकील से पूछें।"],
    "th": ["ขออภัย ฉันไม่สามารถช่วยได้", "ฉันไม่สามารถให้คำตอบได้"],
}
_QUESTIONS = {
    "en": ["When does the library open on Sundays?", "Who pays for the broken window of the rented flat?", "Can I return a coat after 30 days?", "Why is my bill higher than last month?", "What applies to a loan of 250 credits after 12 months?"],
    "de": ["Wann öffnet die Bibliothek am Sonntag?", "Wer zahlt für das Fenster der Wohnung?", "Welche Regel gilt nach 18 Monaten?"],
    "fr": ["Quand la bibliothèque ouvre-t-elle le dimanche ?", "Qui paie pour la fenêtre de l’appartement ?"],
    "es": ["¿Cuándo abre la biblioteca los domingos?", "¿Quién paga la ventana del piso?"],
    "pt": ["Quando abre a biblioteca aos domingos?", "Quem paga a janela do apartamento?"],
    "ru": ["Когда библиотека открыта в воскресенье?", "Кто платит за окно квартиры?", "Что делать через 18 месяцев?"],
    "zh": ["图书馆星期天几点开门？", "谁支付公寓的窗户？", "18个月后退租要付什么费用？"],
    "ja": ["図書館は日曜日に何時に開きますか？", "アパートの窓は誰が払いますか？", "18か月後の返金にはどの規則がありますか？"],
    "hi": ["पुस्तकालय रविवार को कब खुलता है?", "फ्लैट की खिड़की का भुगतान कौन करेगा?"],
    "th": ["ห้องสมุดเปิดกี่โมงในวันอาทิตย์", "ใครจ่ายค่าหน้าต่างของห้องเช่า"],
}
_TRAPS = ["Sorry to hear that.", "Unfortunately the shop is closed on Sundays.", "I cannot see your file, but the rule is simple.", "The bank cannot refuse this.", "Thank you for asking.", "Please contact the desk by 5 p.m.", "No advice is needed here.", "The tenant is unable to leave before May.", "I am not aware of any limit, so the answer is yes."]


def _training(words: dict[str, float]) -> list[tuple[np.ndarray, list[int]]]:
    """Labelled responses: sound ones, also short ones, ones that repeat the question first and ones with trap phrases; refusals; copies;
    foreign and unfinished ones."""
    rng, data = random.Random(11), []
    langs = list(SEED)
    body = {k: [x for x in v.split("\n") if x and "\n" not in x] for k, v in SEED.items()}
    tag = {t: i for i, t in enumerate(TAGS)}

    def add(parts: list[tuple[str, str]], q: str, cut: bool = False):
        cs, ys = [], []
        for text, t in parts:
            got = clauses(text)
            cs += got
            ys += [tag[t]] * len(got)
        if cs:
            x = features(cs, q, " ".join(text for text, _ in parts), words)
            if cut:
                ys[-1], x[-1, _AT["cut"]] = tag["unfinished"], 1.0
            data.append((x, ys))

    composed = [x for x, y in labelled([]) if y]
    by_language = {k: [x for x in composed if (language(x)[0] or "en") == k] for k in langs}
    for _ in range(900):
        k = rng.choice(langs) if rng.random() < 0.6 else "en"
        q = rng.choice(_QUESTIONS[k])
        some = [(x, "answer") for x in rng.sample(body[k], rng.randint(1, 4))]
        kind = rng.random()
        if kind < 0.25:
            add(some, q)
        elif kind < 0.35:
            add([(q, "echo"), *some], q)
        elif kind < 0.47:
            add([(rng.choice(_TRAPS), "answer"), *some] if rng.random() < 0.7 else [*some, (rng.choice(_TRAPS), "answer")], q if k == "en" else rng.choice(_QUESTIONS["en"]))if k == "en" else add(some, q)
        elif kind < 0.65:
            add([(rng.choice(_REFUSALS[k] if rng.random() < 0.5 or not by_language[k] else by_language[k]), "refusal")], q)
        elif kind < 0.77:
            dress = rng.choice([q, q.upper(), q.lower(), "“" + q + "”", "Question: " + q, q.rstrip("?？") + ".", "You asked: " + q])
            add([(dress, "echo")], q)
        elif kind < 0.9:
            o = rng.choice([x for x in langs if x != k])
            add([(x, "foreign") for x in rng.sample(body[o], rng.randint(2, 4))], q)
        else:
            cutoff = some[-1][0]
            add([*some[:-1], (cutoff[: max(3, len(cutoff) * 2 // 3)], "answer")], q, cut=True)
    return data


@functools.lru_cache(1)
def trained() -> tuple[np.ndarray, np.ndarray, dict[str, float]]:
    """(emission weights, transition weights, word scores of declining) of the field, the former by Adagrad on the log-likelihood; the
    same on every machine."""
    words = learn([x for v in SEED.values() for x in v.split("\n") if x] + _TRAPS)
    data = _training(words)
    n, d = len(TAGS), len(FEATURES)
    w, t = np.zeros((d, n)), np.zeros((n, n))
    gw, gt = np.full((d, n), 1e-2), np.full((n, n), 1e-2)
    order = np.random.default_rng(5)
    for _ in range(12):
        for at in order.permutation(len(data)):
            x, y = data[at]
            node, edge, _ = _marginals(x @ w, t)
            dw = -x.T @ node - 1e-3 * w
            np.add.at(dw.T, y, x)
            dt = -edge - 1e-3 * t
            for a, b in zip(y, y[1:]):
                dt[a, b] += 1
            gw += dw * dw
            gt += dt * dt
            w += 0.3 * dw / np.sqrt(gw)
            t += 0.3 * dt / np.sqrt(gt)
    return w, t, words


def _logsumexp(a: np.ndarray, axis: int) -> np.ndarray:
    m = a.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(a - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def _marginals(e: np.ndarray, t: np.ndarray):
    """Node marginals, summed edge marginals and log partition of a chain with emission scores e and transitions t."""
    n = len(e)
    f, b = e.copy(), np.zeros_like(e)
    for i in range(1, n):
        f[i] += _logsumexp(f[i - 1][:, None] + t, 0)
    for i in range(n - 2, -1, -1):
        b[i] = _logsumexp(t + (e[i + 1] + b[i + 1])[None, :], 1)
    z = _logsumexp(f[-1], 0)
    edge = np.zeros_like(t)
    for i in range(n - 1):
        edge += np.exp(f[i][:, None] + t + (e[i + 1] + b[i + 1])[None, :] - z)
    return np.exp(f + b - z), edge, z


def best_tags(e: np.ndarray, t: np.ndarray) -> list[int]:
    """Viterbi path."""
    n, back, v = len(e), [], e[0]
    for i in range(1, n):
        s = v[:, None] + t
        back.append(s.argmax(0))
        v = s.max(0) + e[i]
    out = [int(v.argmax())]
    for bp in reversed(back):
        out.append(int(bp[out[-1]]))
    return out[::-1]


def read_pair(question: str, value: str, w: np.ndarray, t: np.ndarray, words: dict[str, float]) -> list[tuple[str | None, list[float]]]:
    """(defect, coverage of each tag by characters) of a pair whose value is not empty: if it is whole, and if it was broken off."""
    body = _TAG_HEAD.sub("", value, count=1)
    cs = clauses(body)
    if not cs:
        return [(None, [0.0] * len(TAGS)), ("truncated", [0.0] * len(TAGS))]
    e = features(cs, question, body, words) @ w
    total = sum(map(len, cs))
    said, asked = len(_units(body)), len(_question(question)[0])
    out, before = [], None
    for cut in (False, True):
        if cut:
            e[-1] += w[_AT["cut"]]
        tags = best_tags(e, t)
        if tags == before:
            out.append(out[-1])
            continue
        before = tags
        cover = [0.0] * len(TAGS)
        for c, y in zip(cs, tags):
            cover[y] += len(c) / total
        answer, refusal, echo, foreign, unfinished = cover
        if echo and not refusal and answer + foreign + unfinished < 0.05 and said >= 0.5 * asked:
            out.append(("copy", cover))
        elif refusal and answer + foreign < 0.05 and refusal >= unfinished:
            out.append(("refusal", cover))
        elif foreign >= 0.6 and foreign > answer + refusal:
            out.append(("wrong_language", cover))
        else:
            out.append(("truncated" if unfinished else None, cover))
    return out


def judge(question: str, value: str, cut: bool, w: np.ndarray, t: np.ndarray, words: dict[str, float]) -> tuple[str | None, list[float]]:
    return read_pair(question, value, w, t, words)[cut]


def _only_question(question: str, value: str) -> bool:
    """The value, without a head that announces it, has the question's words in their order, give or take a tenth."""
    q = _question(question)[0]
    if len(value) > 2 * len(question) + 40:
        return False
    v = _units(_ECHO_HEAD.sub("", _TAG_HEAD.sub("", value)))
    if not q or not v or abs(len(q) - len(v)) > 0.1 * len(q) + 1:
        return False
    qp, vp = Counter(zip([""] + q, q)), Counter(zip([""] + v, v))
    return sum((qp & vp).values()) >= 0.85 * max(len(q), len(v))


def usable_question(col):
    t = F.lower(F.trim(F.regexp_replace(F.coalesce(col, F.lit("")), INVISIBLE + "+", " ")))
    return (t != "") & (t != "nan")


def defects(pairs: DataFrame, cut: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, defect, and the coverage of each tag) of all pairs with a question; defect is null for sound pairs.

    pairs: keys, question, value; cut: keys, truncated. Pairs without a question are sound and left out. Empty values are found
    by the JVM; all others are read whole, each on its own, where they were scanned: the field decides for either state of cut, and
    only the short verdicts are shuffled to meet it."""
    real = pairs.filter(usable_question(F.col("question")))
    src = spread(real.select(*keys, is_empty(F.col("value")).alias("_empty"), "question", F.col("value").alias("_v")))
    head = spec(src, keys)
    model = trained()
    k = len(keys)

    def run(batches):
        for b in batches:
            read = [[("empty", _NONE)] * 2 if e else read_pair(q, v, *model) for e, q, v in zip(*[b.column(k + i).to_pylist() for i in range(3)])]
            cols = [[x[c][0] for x in read] for c in (0, 1)]
            cover = [[[x[c][1][i] for x in read] for i in range(len(TAGS))] for c in (0, 1)]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:k], *[pa.array(c, pa.string()) for c in cols], *[pa.array(x, pa.float32()) for c in cover for x in c]], [*keys, "_d0", "_d1", *[f"_{x}{c}" for c in (0, 1) for x in TAGS]]
            )

    both = src.mapInArrow(run, f"{head}, _d0 string, _d1 string, " + ", ".join(f"_{x}{c} float" for c in (0, 1) for x in TAGS))
    j = both.join(cut.filter("truncated").select(*keys, F.lit(True).alias("_cut")), keys, "left")
    pick = lambda name: F.when(F.col("_cut"), F.col(f"_{name}1")).otherwise(F.col(f"_{name}0"))
    return j.select(*keys, pick("d").alias("defect"), *[pick(x).cast("double").alias(x) for x in TAGS])


_NONE = [0.0] * len(TAGS)
