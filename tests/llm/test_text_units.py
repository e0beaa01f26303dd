"""Operators that work on one text at a time."""

import itertools
import random

import pytest

from lexisift.llm import bpe, encoding, markup, pairs, repetition, sentences, truncation
from lexisift.llm.tokens import plan_slots


def ends(t):
    return [e for _, e, _ in sentences.sentence_ends(t)]


@pytest.mark.parametrize(
    "parts",
    [
        ["Dr. Ames came at 5 p.m. on Monday.", "He left."],
        ["See Art. 5 para. 2 of the act.", "“Who paid?” asked the clerk.", "No."],
        ["Am 3. April kam Hr. Lang.", "Das gilt z. B. auch hier."],
        ["«Ты идёшь?» — спросила она.", "Это стоит 30 руб. в месяц."],
        ["他说：“好。”", "没有人来。"],
        ["「はい。」と彼は言いました。", "それだけです。"],
        ["यह सही है।", "डॉ. वर्मा आए।"],
    ],
)
def test_sentences(parts):
    sep = "" if ord(parts[0][-1]) in (0x3002, 0x201D) else " "
    text, want = "", []
    for p in parts:
        text += (sep if text else "") + p
        want.append(len(text))
    assert ends(text) == want


def test_sentences_without_marks():
    parts = lambda t: [t[a - 1 : b] for a, b, _ in sentences.sentence_ends(t)]
    assert parts("the committee met on tuesday nobody had read the minutes we spoke to the tenant about it") == ["the committee met on tuesday", "nobody had read the minutes", "we spoke to the tenant about it"]
    assert parts("银行应将文件保存很多年 新规定自五月一日起生效 没有人来") == ["银行应将文件保存很多年", "新规定自五月一日起生效", "没有人来"]
    for one in ("How long does the adapter keep the line", "The tenant must pay the rent before the landlord", "Yes", "New York City Council of the United States"):
        assert parts(one) == [one]
    # a text with marks is read by its marks
    assert parts("the committee met on tuesday nobody came. He left") == ["the committee met on tuesday nobody came.", "He left"]


def test_sentences_at_every_place():
    parts = lambda t: [t[a - 1 : b] for a, b, _ in sentences.sentence_ends(t)]
    # a full stop without a space, whatever stands around it
    for want in (["He took plan B.", "The rest failed."], ["We paid 3.", "eBay was down."], ["It rained.", "May is warm."]):
        assert parts("".join(want)) == want
    for one in ("Read example.org and report.txt now.", "See fig.3 and p.12 of it.", "The notes, pp. 4 ff., are short."):
        assert parts(one) == [one]
    # Thai before a long foreign phrase
    assert parts("คำว่า this is a long English phrase here ใช้ในสัญญา")[-1] == "ใช้ในสัญญา"
    # no marks and no spaces
    assert parts("没有人看过这封信他为什么拒绝李教授打了电话") == ["没有人看过这封信", "他为什么拒绝", "李教授打了电话"]
    assert parts("日前までに書面で通知しなければなりません。") == ["日前までに書面で通知しなければなりません。"]
    # a stretch without marks in a text with marks; what a capital alone suggests does not end a sentence there
    text = ["Niemand hat den Brief gelesen", "Der Zug fährt um acht Uhr ab", "Die Straße ist gesperrt.", "Das stimmt."]
    assert parts(" ".join(text)) == text
    for one in ("Niemand hat den Brief gelesen.", "The committee met on Tuesday Nobody had read the minutes.", "Apple and Google and The New York Times are firms."):
        assert parts(one) == [one]


def test_unmarked_stretches_are_skipped_only_where_none_can_be_sure(monkeypatch):
    rng = random.Random(8)
    lines = [x.rstrip(".") for k in ("en", "de", "fr", "zh") for x in sentences.SEED[k].split("\n")]
    texts = [" ".join(rng.choice(lines) for _ in range(rng.randint(1, 5))) for _ in range(300)]
    texts += [x.lower() for x in texts[:100]]
    got = [sentences._unmarked(x, sentences.RARE) for x in texts]
    monkeypatch.setattr(sentences, "_gain", lambda a, b, case: 1e6)
    monkeypatch.setattr(sentences.WordModel, "gain", lambda self, sym, nxt: 1e6)
    assert [sentences._unmarked(x, sentences.RARE) for x in texts] == got
    assert any(got) and not all(got)


def test_sentence_edges():
    assert ends(None) == ends("") == ends(" \n ") == []
    assert ends("  One here.\n\nA rest with") == [11, 24]
    assert ends("It rained.The sun came.") == [10, 23]
    assert ends("ราคาเพิ่มขึ้น 5 บาท เขากลับบ้าน") == [19, 31]
    long = "All is well. " * 5000
    assert len(ends(long)) == 5000


def test_posteriors_sum_over_events():
    cands = sentences.candidates("Dr. Ames of Holt Ltd. spoke. He left... and no. 5 came.")
    m = sentences.model()
    total, marg = 0.0, [0.0] * len(cands)
    for ev in itertools.product("SN", repeat=len(cands)):
        p, prev = 1.0, "S"
        for c, e in zip(cands, ev):
            p *= m.p_event(c["sym"], e) * m.p_next(c["sym"], e, c["nxt"]) * m.p_length(prev, e, c["gap"])
            prev = e
        total += p
        for i, e in enumerate(ev):
            marg[i] += p * (e == "S")
    assert m.posteriors(cands) == pytest.approx([x / total for x in marg])


def test_encoder_round_trip_and_reference():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(bpe.default_vocabulary())
    t.encode_special_tokens = True
    enc = bpe.encoder(bpe.default_vocabulary())
    rng = random.Random(9)
    alphabet = "abcdeé ñ中文 ไทยहिन्दी\n\t 012.,!'’<|endoftext|>🙂́"
    texts = ["", " ", "a" * 3000, "<|endoftext|>", "I'll we've 12345", "e\u0301"] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 120))) for _ in range(300)]
    for x in texts:
        assert enc.encode(x).tolist() == t.encode(x, add_special_tokens=False).ids
    assert enc.encode(None).tolist() == []


def test_compatible_pairs_against_merging():
    enc = bpe.encoder(bpe.default_vocabulary())

    def merged(s):
        ids = [enc.whole[c] for c in s]
        while True:
            best = min(((enc.rank[enc.merged[a, b]], i) for i, (a, b) in enumerate(zip(ids, ids[1:])) if (a, b) in enc.merged), default=None)
            if best is None:
                return ids
            i = best[1]
            ids[i : i + 2] = [enc.merged[ids[i], ids[i + 1]]]

    by_id = {i: s for s, i in enc.whole.items()}
    rng = random.Random(1)
    words = [w for w in enc.whole if w.isalpha() and len(w) < 5]
    for _ in range(400):
        a, b = enc.whole[rng.choice(words)], enc.whole[rng.choice(words)]
        if merged(by_id[a]) == [a] and merged(by_id[b]) == [b]:
            assert enc.compatible(a, b) == (merged(by_id[a] + by_id[b]) == [a, b])


def test_plan_slots_places_everything():
    rng = random.Random(4)
    hist = {rng.randint(1, 100): rng.randint(1, 500) for _ in range(40)} | {0: 7}
    load, seen = {}, {}
    for length, first, items, start, per in plan_slots(hist, 100):
        for r in range(items):
            c = start + r // per
            load[c] = load.get(c, 0) + length
        seen.setdefault(length, []).extend(range(first, first + items))
    assert max(load.values()) <= 100
    assert {k: sorted(v) for k, v in seen.items()} == {k: list(range(n)) for k, n in hist.items()}
    total = sum(k * n for k, n in hist.items())
    assert len(load) <= total / 100 * 1.05 + 1
    assert plan_slots({}, 100) == []


def test_repetition():
    r = repetition.repeated_share
    assert r(None) == r("") == r("...!") == (0, 0)
    n, k = r("The fee is due in May. the FEE is due, in june! The fee is due in May")
    assert k / n > 0.9
    n, k = r("One two three four five six seven eight nine ten. Nothing here was said before.")
    assert k == 0
    n, k = r("1. we close at noon on friday\n2. we close at noon on monday\n3. we close at noon on friday")
    assert k / n > 0.8
    n, k = r("请不要重启路由器两次。请不要重启路由器三次。请不要重启路由器两次。")
    assert k / n > 0.9
    n, k = r("word " * 20_000)
    assert k == n == 20_000


def test_repeated_flags_find_exact_passages():
    rng = random.Random(6)
    for _ in range(50):
        u = [rng.choice("abcdefghijklmnopqrstuvwxyz") + rng.choice("0123456789") for _ in range(30)]
        at, n = rng.randint(0, 20), rng.randint(4, 9)
        v = u + u[at : at + n]
        flags = repetition.repeated_flags(v, 4)
        assert all(flags[at : at + n]) and all(flags[30:])


def test_repeated_flags_with_parts_said_in_between():
    flags = repetition.repeated_flags("the shop closes at noon today closes at noon sharp the shop closes at noon".split(), 4)
    assert all(flags[:5]) and all(flags[10:])


def test_repeated_passages_with_a_changed_word():
    r = repetition.repeated_share
    assert r("the bank must repay the fee the bank must always repay the fee") == (13, 13)
    assert r("we never close at noon. We close at noon") == (9, 9)
    assert r("the red cat sleeps here, the red cat two three sleeps here")[1] == 0
    n, k = r("请不要重启这个路由器。请不要关闭这个路由器。")
    assert k == n == 20
    n, k = r("今天天气很好。银行收取费用。")
    assert k == 0


@pytest.mark.parametrize(
    "text,kinds",
    [
        ("<p>Hi</p>", ["html"]), ("a &amp; b", ["html"]), ("R&D and 3 < 5 > 2", []), ("# Title\n\ntext", ["markdown"]), ("**bold** move", ["markdown"]), ("**Answer**: yes", []), ("ANSWER: x", []),
        ("`x` is set", ["markdown"]), ("5 * 3 * 2", []), ("a_1 + a_2", []), ("- one\n- two", []), ("1. one\n2. two", []), ("== T ==\nx", ["wiki"]), ("see [[Help:X|x]]", ["wiki"]), ("{{Box|a=1}}", ["wiki"]), ("{name} stays", []),
        ("\\section{A} x", ["latex"]), ("C:\\temp\\to_do.txt", []), ("is $c = \\frac{a}{b}$ now", ["latex"]), ("$40 and $55", []), ("Ticket # 14, C# 7", []), ("> quoted line", ["markdown"]), ("| a | b |\n|---|---|\n| 1 | 2 |", ["markdown"]),
        ("# ''one''\n# two", ["wiki"]), ("Summary\n=======\n\ntext", ["markdown"]), ("see ~/notes", []),
    ],
)
def test_markup_kinds(text, kinds):
    assert markup.kinds_of(text) == kinds


def test_markup_text():
    assert markup.clean("<h2>T</h2><ul><li>a</li><li>b &amp; c</li></ul><pre>x\n y</pre>", ["html"]) == "## T\n- a\n- b & c\n```\nx\n y\n```"
    assert markup.clean("# T\n\n* **a** b\n\n```py\nx = **1**\n```", ["markdown"]) == "# T\n\n- a b\n\n```py\nx = **1**\n```"
    assert markup.clean("\\section{T}\n\\begin{itemize}\n\\item a $x^2$\n\\end{itemize}", ["latex"]) == "## T\n\n- a $x^2$"
    assert markup.clean("== T ==\n* '''a''' [[P|b]]", ["wiki"]) == "## T\n- a b"
    assert markup.clean("<p>unclosed <b>bold", ["html"]) == "unclosed bold"


@pytest.mark.parametrize("text,kind", [("All is well.", "closed"), ("All is we", "bare"), ("He said “no", "broken"), ("a <b>x", "broken"), ("cut &am", "broken"), ("x \\begin{a} y.", "broken"), ("so, then,", "comma"), ("met Dr.", "comma"), ("", "closed"), ("```\ncode", "broken"), ("完了。", "closed"), ("(done).", "closed"), ("- a\n- b", "item"), ("Bye.\n\nRegards,\nthe desk", "item"), ("lost \ufffd", "broken")])
def test_endings(text, kind):
    assert truncation.ending(text) == kind


MOJIBAKE = ["The fee is £5 — or €7.", "Société Brévard über alles", "Плата составляет сто рублей", "Комиссия не взимается", "กฎใหม่มีผล", "नए नियम"]


@pytest.mark.parametrize("enc", ["cp1252", "latin-1", "mac_roman", "cp437", "cp1251"])
@pytest.mark.parametrize("text", MOJIBAKE)
def test_garbled_text_comes_back(text, enc):
    bad = encoding._decode(text.encode("utf-8"), enc)
    if bad is None:
        pytest.skip("undefined bytes")
    hit, back, _ = encoding.repair("Before it. " + bad + " After it.")
    assert hit and back == "Before it. " + text + " After it."


def test_garbled_twice_and_legacy():
    twice = encoding._decode(encoding._decode("café — naïve".encode(), "cp1252").encode(), "cp1252")
    assert encoding.repair(twice)[1] == "café — naïve"
    assert encoding.repair("Жалобу рассматривает независимый посредник".encode("cp1251").decode("latin-1"))[1] == "Жалобу рассматривает независимый посредник"
    assert encoding.repair("银行应将客户文件保存很多年".encode("gbk").decode("latin-1"))[1] == "银行应将客户文件保存很多年"


@pytest.mark.parametrize("written,read", [("koi8-r", "cp1251"), ("cp1251", "koi8-r")])
def test_garbled_cyrillic_inside_clean(written, read):
    clean = "Банк обязан вернуть комиссию до конца месяца. Договор можно расторгнуть в любое время без штрафа. Клиент получает письменное уведомление от оператора."
    text = "Абонент вправе отказаться от услуги, если оператор изменил тариф."
    bad = text.encode(written).decode(read)
    for before, after in ((clean + " ", " " + clean), ("", ""), (clean + "\n", "")):
        assert encoding.repair(before + bad + after)[:2] == (True, before + text + after)
    assert encoding.repair("договор".encode(written).decode(read))[:2] == (True, "договор")
    assert encoding.repair(clean)[0] is False


def test_utf8_read_as_double_byte_text():
    for text in ("Договор действует до конца года", "Größe über Nacht", "Ο καταναλωτής πληρώνει"):
        assert encoding.repair(text.encode().decode("gb18030"))[:2] == (True, text)
    for enc in ("shift_jis", "euc_kr", "big5"):
        assert encoding.repair("Die Hörer".encode().decode(enc))[:2] == (True, "Die Hörer")
    thai = "ทนายความต้องแจ้งผู้เช่า"
    back = encoding.repair(thai.encode().decode("gb18030", "replace"))
    assert back[0] and sum(c in thai for c in back[1]) > len(thai) / 2
    for clean in ("使用Wi-Fi每月付款", "他每天很忙，没时间。", "안녕하세요 계약을 확인해 주세요", "ﾃﾞｰﾀを確認してください", "契約書を確認してください。", "請確認合約內容"):
        assert encoding.repair(clean)[0] is False


@pytest.mark.parametrize("enc", encoding.DOUBLE_READERS)
@pytest.mark.parametrize("text", ["Договор действует до конца года", "银行应将客户文件保存很多年", "契約書を確認してください。", "ทนายความต้องแจ้งผู้เช่า", "किराया समय पर देना होगा"])
def test_every_double_byte_reader_is_found(text, enc):
    assert encoding.repair("Note: " + text.encode().decode(enc, "replace") + " and more")[0]
    assert encoding.repair("Note: " + text + " and more")[0] is False
    assert any(("utf-8", enc) in ps for _, (_, ps, _) in encoding.garbled().automaton.iter(text.encode().decode(enc, "replace"))) or len(text.encode().decode(enc, "replace").strip("\ufffd")) == 0 or enc != "gb18030"


@pytest.mark.parametrize("text", [None, "", "plain", "NÃO É PERMITIDA A CESSÃO", "São Tomé, Ångström, ÂGE, CÔTÉ", "the sequence â€™ in old exports stands for an apostrophe", "It prints “Ã©” wherever an é should be", "Tree: ├── a └── b", "the portal showed a \ufffd sign", "Комиссия не взимается, если срок был соблюдён.", "ผู้ค้ำประกันต้องรับผิดชอบ", "如果按时付款，则不收取任何罚金。", "«СССР»"])
def test_clean_text_stays(text):
    assert encoding.repair(text)[0] is False


def test_pairs():
    model = pairs.trained()
    j = lambda q, v, cut=False: pairs.judge(q, v, cut, *model)[0]
    q = "When does the warranty for the kettle end?"
    assert j(q, "I'm sorry, but I can't help with that. Please ask a lawyer.") == "refusal"
    assert j(q, "Sorry to hear that. The warranty ends after two years.") is None
    assert j(q, "The shop is unable to refuse a claim.") is None
    assert j(q, "WHEN DOES THE WARRANTY FOR THE KETTLE END") == "copy" and j(q, "You asked: " + q) == "copy"
    assert j(q, q + " It ends in May after two full years.") is None
    assert j(q, "Die Garantie endet nach zwei Jahren. Das gilt auch für den Deckel.") == "wrong_language"
    assert j(q, "The word “Garantie” is German and means a warranty of two years.") is None
    assert j(q, "Yes.") is None and j(q, "The warranty ends after tw", True) == "truncated"
    assert j("Wann endet die Garantie?", "Das darf ich Ihnen leider nicht sagen. Bitte wenden Sie sich an einen Anwalt.") in ("refusal", None)


@pytest.mark.parametrize(
    "text",
    ["I do not know anything about that topic at all.", "My programming keeps me away from such topics.", "This matter is beyond my competence.", "Je ne suis pas en mesure de vous répondre.", "К сожалению, я не вправе обсуждать это.", "我无权评论此事。", "ขออภัย ฉันไม่อาจให้คำแนะนำ"],
)
def test_refusals_not_in_the_training(text):
    q = {"J": "Quand le bail prend-il fin ?", "К": "Когда заканчивается договор?", "我": "合同什么时候结束？", "ข": "สัญญาสิ้นสุดเมื่อใด"}.get(text[0], "When does the lease end?")
    assert pairs.judge(q, text, False, *pairs.trained())[0] == "refusal"


@pytest.mark.parametrize("text", ["The bank cannot refuse this claim.", "I cannot find a clause against it, so the lease ends in May.", "Nobody may comment on the file before June.", "The court has no authority to change the fee."])
def test_sound_answers_with_words_of_refusal(text):
    assert pairs.judge("When does the lease end?", text, False, *pairs.trained())[0] is None


@pytest.mark.parametrize("n", [50, 250, 5000])
def test_cut_markup_of_any_length(n):
    assert truncation.ending('See <a href="' + "x" * n) == "broken" and truncation.ending("so {{Box|" + "y " * n) == "broken"
    assert len(truncation.tails("The end of it is n" + "o" * n)) == 3


def test_language_of_long_clauses():
    for code, word in (("ru", "договор аренды "), ("th", "สัญญาเช่าบ้าน"), ("hi", "किराया समय पर ")):
        assert pairs.language(word * 100)[0] == code
    assert pairs.language("договор аренды " * 40 + "the tenant has to pay for it " * 100)[0] == "en"


def test_field_marginals_and_best_path():
    import numpy as np

    rng = np.random.default_rng(2)
    e, t = rng.normal(size=(4, 5)), rng.normal(size=(5, 5))
    paths = list(itertools.product(range(5), repeat=4))
    score = {p: sum(e[i, y] for i, y in enumerate(p)) + sum(t[a, b] for a, b in zip(p, p[1:])) for p in paths}
    assert tuple(pairs.best_tags(e, t)) == max(paths, key=score.get)
    z = sum(np.exp(s) for s in score.values())
    node, _, logz = pairs._marginals(e, t)
    assert logz == pytest.approx(np.log(z))
    assert node[1, 3] == pytest.approx(sum(np.exp(s) for p, s in score.items() if p[1] == 3) / z)
