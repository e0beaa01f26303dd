"""Word scores of declining clauses, learned from labelled clauses composed from parts written for this purpose."""

from __future__ import annotations

import math
import random
import re

import regex

# Parts of declining clauses by language: who, how, what is declined; and of clauses in which others cannot or must not.
PARTS = {
    "en": (
        "I;We;This assistant;The model;Unfortunately, I;I'm sorry, but I;I am afraid I;As an assistant, I",
        "cannot;can't;can not;am unable to;am not able to;will not;won't;do not wish to;would rather not;prefer not to;am not allowed to;am not permitted to;must decline to;have to refuse to;am not qualified to;have no authority to;do not know enough to;am not in a position to;have been told not to;may not;have chosen not to;have decided not to;don't wish to;won’t;can’t",
        "help with this;help you here;answer that question;answer this;comment on the matter;give advice on it;give an opinion;discuss such topics;talk about that;provide this information;say anything about it;take a position on that;assist you with that;respond to this request;go into that;judge this;help with the account;comment on the costs of it;speak about the contract;go into the costs here;reply to this message;discuss this;advise you on the tax;be of help here;answer questions on the loan",
        "The bank;The tenant;The court;A customer;The insurer;You;They;Nobody;The seller;The landlord;He;The provider;It",
        "cannot;can't;is unable to;is not able to;will not;won't;may not;must not;is not allowed to;are not permitted to;has no right to;refuses to;does not have to;may refuse to;must decline to",
        "help with the repair;answer before May;comment on the offer;give notice later;discuss the fee in court;provide a copy;say no to the claim;take the deposit;assist the court;respond in writing;end the contract;judge the case alone;change the tariff",
    ),
    "de": (
        "Ich;Wir;Leider;Als Assistent",
        "kann dazu nicht;kann dazu leider nicht;darf dazu nicht;möchte dazu nicht;will dazu nicht;werde dazu nicht;bin nicht befugt, dazu;bin nicht in der Lage, dazu",
        "helfen;antworten;etwas sagen;Stellung nehmen;Auskunft geben;zu beraten;raten;mich äußern",
        "Die Bank;Der Mieter;Das Gericht;Der Kunde;Der Vermieter;Der Anbieter;Sie",
        "kann den Antrag nicht;darf die Frist nicht;muss das Geld nicht;will den Vertrag nicht;wird die Gebühr nicht",
        "ablehnen;ändern;zahlen;kündigen;verlängern;erheben;zurückgeben",
    ),
    "fr": (
        "Je;Désolé, je;Malheureusement, je;En tant qu'assistant, je",
        "ne peux pas;ne suis pas en mesure de;ne suis pas autorisé à;ne souhaite pas;ne dois pas;préfère ne pas;refuse de",
        "vous aider;répondre à cette question;donner un avis;commenter cela;fournir cette information;parler de ce sujet;vous conseiller",
        "La banque;Le locataire;Le tribunal;Le client;Le bailleur;Elle",
        "ne peut pas;n'est pas tenu de;ne doit pas;refuse de;n'est pas autorisé à",
        "changer le tarif;rendre le dépôt;résilier le contrat;répondre après le délai;fournir une copie;augmenter le loyer",
    ),
    "es": (
        "Lo siento,;Lo siento, pero;Lamentablemente,;;Como asistente,",
        "no puedo;no me es posible;no estoy autorizado a;no debo;prefiero no;me niego a;no quiero;no se me permite;no me está permitido;no me corresponde",
        "ayudarle con eso;ayudar con ese asunto;responder a esta pregunta;dar una opinión;comentar el asunto;ofrecer esta información;hablar de ese tema;aconsejarle;opinar sobre el tema;pronunciarme sobre eso",
        "El banco;El inquilino;El tribunal;El cliente;El casero;Ella",
        "no puede;no debe;no está obligado a;se niega a;no tiene derecho a",
        "cambiar la tarifa;devolver el depósito;rescindir el contrato;responder después del plazo;entregar una copia;subir el alquiler",
    ),
    "pt": (
        "Desculpe,;Desculpe, mas;Infelizmente,;;Como assistente,",
        "não posso;não me é possível;não estou autorizado a;não devo;prefiro não;recuso-me a;não quero;não me é permitido;não me cabe",
        "ajudar com isso;ajudar com esse assunto;responder a esta pergunta;dar uma opinião;comentar o assunto;fornecer esta informação;falar desse tema;aconselhar;opinar sobre o tema",
        "O banco;O inquilino;O tribunal;O cliente;O senhorio;Ela",
        "não pode;não deve;não é obrigado a;recusa-se a;não tem direito a",
        "mudar a tarifa;devolver o depósito;rescindir o contrato;responder depois do prazo;entregar uma cópia;subir a renda",
    ),
    "ru": (
        "Я;Извините, я;К сожалению, я;Мы;Как помощник, я",
        "не могу;не вправе;не уполномочен;не стану;не буду;не имею права;вынужден отказаться",
        "ответить на это;помочь вам;давать советы;комментировать это;обсуждать эту тему;дать такую информацию;говорить об этом",
        "Банк;Арендатор;Суд;Клиент;Оператор;Он",
        "не может;не вправе;не обязан;не должен;отказывается",
        "изменить тариф;вернуть залог;расторгнуть договор;ответить после срока;выдать копию;повысить плату",
    ),
    "hi": (
        "मैं;क्षमा करें, मैं;खेद है, मैं;मुझे",
        "इस प्रश्न का उत्तर;इस विषय पर सलाह;इस पर टिप्पणी;इसमें मदद;यह जानकारी",
        "नहीं दे सकता;नहीं कर सकता;देने की अनुमति नहीं है;देने में असमर्थ हूँ;नहीं दूँगा",
        "बैंक;किरायेदार;अदालत;ग्राहक;मकान मालिक",
        "शुल्क;जमा राशि;अनुबंध;किराया;आवेदन",
        "नहीं बदल सकता;वापस नहीं करता;समाप्त नहीं कर सकता;नहीं बढ़ा सकता;अस्वीकार नहीं कर सकता",
    ),
    "zh": (
        "我;抱歉，我;对不起，我;作为助手，我;我们",
        "无法;不能;不便;不会;没有权限;不被允许;拒绝",
        "回答这个问题;提供帮助;评论此事;给出建议;讨论这个话题;提供这些信息;发表意见",
        "银行;租户;法院;客户;房东;他们",
        "无法;不能;不得;不会;没有义务;拒绝",
        "更改费率;退还押金;终止合同;在期限后答复;提供副本;提高租金",
    ),
    "ja": (
        "申し訳ございませんが、;すみませんが、;残念ながら、;私は",
        "この質問には;その件については;この話題については;それには;ご依頼には",
        "お答えできません;回答できません;お手伝いできません;助言できません;コメントを控えます;お応えしかねます;意見を述べられません",
        "銀行は;借主は;裁判所は;お客様は;貸主は",
        "料金を;敷金を;契約を;家賃を;申込みを",
        "変更できません;返還しません;解除できません;引き上げられません;拒否できません",
    ),
    "th": (
        "ขออภัย ฉัน;ขอโทษ ผม;เสียใจด้วย เรา;ฉัน;ระบบ",
        "ไม่สามารถ;ไม่อาจ;ไม่ได้รับอนุญาตให้;ขอไม่;ไม่มีสิทธิ์",
        "ตอบคำถามนี้;ช่วยเรื่องนี้;ให้คำแนะนำ;แสดงความเห็น;พูดเรื่องนี้;ให้ข้อมูลนี้",
        "ธนาคาร;ผู้เช่า;ศาล;ลูกค้า;เจ้าของบ้าน",
        "ไม่สามารถ;ไม่อาจ;ไม่ต้อง;ไม่ได้;ไม่มีหน้าที่",
        "เปลี่ยนอัตรา;คืนเงินประกัน;ยกเลิกสัญญา;ขึ้นค่าเช่า;ปฏิเสธคำขอ",
    ),
}
DECLINED = """I do not know anything about that.
I don't know anything about this subject.
I have no information on this topic.
I have nothing to say on that.
I know nothing about it.
I am no expert on this and will leave it there.
That is beyond what I can answer.
This lies outside my field.
This is outside the things I deal with.
My rules keep me from answering.
My rules do not let me talk about it.
My instructions forbid it.
My guidelines keep me away from this subject.
My makers do not want me to speak about such things.
My role does not allow me to say more.
Such questions are not for me.
Such topics are closed to me.
Please ask somebody else about that, not me.
You will have to ask somebody else.
No comment.
No comment from me on that.
I would rather leave that to others.
I leave that question to others.
It is not my place to say.
I am only an assistant and have no view on it.
I hold no opinion about that.
I pass on this one.
I abstain.
Your contract is a matter I am not allowed to talk about.
The card is a subject I may not comment on.
No advice about the card can be given by this model.
No answer to that can be given here by me.
I have too little information to answer.
I do not have the data to give an answer,
so I must decline.
so I will not answer.
so I have to pass.
This is something I cannot discuss.
This is not something I am able to answer.
It is something we are not able to talk about.
The assistant has chosen to say nothing.
The model has decided not to answer this message.
I keep out of such matters.
I was built to stay silent on this.
I can't help with the contract.
I cannot help with the loan or the receipt.
I am unable to help with a lost card.
I can't give advice on the tax.
I lack the right to comment on the lease.
I lack the permission to speak about the file.
Questions on the loan lie beyond my scope.
Questions about the card are beyond my competence.
Matters of this kind lie outside my remit.
To be honest, I can't answer that.
Regrettably, I have to decline.
With regret, I cannot assist.
Apologies: I cannot answer this.
As a language model, I can't speak about the tax.
I am kept from discussing this.
Dazu sage ich nichts.
Davon verstehe ich nichts.
Darüber weiß ich nichts.
Meine Regeln verbieten mir eine Antwort.
Solche Fragen sind nichts für mich.
Je ne sais rien à ce sujet.
Mes règles m'interdisent d'en parler.
Je laisse cette question à d'autres.
No sé nada de ese tema.
Mis reglas me impiden responder.
Não sei nada sobre esse tema.
As minhas regras impedem-me de responder.
Я ничего об этом не знаю.
Мои правила запрещают мне отвечать.
我对此一无所知。
我的规则不允许我谈论这个话题。
それについては何も存じません。
アシスタントとして回答することはできません。
助手として意見を述べることはできません。
私の規則により話せません。
मुझे इस विषय में कुछ नहीं पता।
मेरे नियम मुझे बोलने नहीं देते।
ฉันไม่รู้เรื่องนี้เลย
กฎของฉันห้ามพูดเรื่องนี้"""
SAID = """No.
Yes.
Not yet.
No, it does not.
Nein.
Ja.
Non.
Oui.
No, nunca.
Sí.
Não.
Não, nunca.
Sim.
Нет.
Да.
不。
不行。
是的。
いいえ。
はい。
नहीं।
हाँ।
ไม่
ใช่
I think the fee is due in May.
I would say that the tenant has to pay.
I found that the bank must repay the amount.
I have not seen your file, but the rule is simple.
I can confirm that the contract ends in June.
I know that the court decides this.
I am not aware of any limit, so the answer is yes.
I do not think the fee is due.
I don't believe that the bank may refuse.
We recommend a letter to the landlord.
We do not charge a fee for this.
In my view the claim is good.
My answer is yes.
My reading of the act is that notice is needed.
Let me explain the rule.
I cannot find any rule against it,
I can't see a reason why not.
I could not find a fee in the list.
I cannot recall the exact date, but it was in May.
What can I do about the noise?
May I keep the card?
Can we leave before June?
As far as I know, the deposit is returned after a month.
Nothing is due before May.
No fee is charged for that.
No notice is needed for this.
No, the bank does not have to answer.
Nobody has to help with this.
You do not need to ask anybody else.
Please ask the bank for a copy.
That is beyond the limit of the plan.
This lies outside the city.
The rules do not let the bank charge twice.
The rules forbid it.
The instructions keep the router from starting twice.
Such questions are decided by the court.
Such topics are part of the lease.
The information is not available before May.
The customer knows nothing about the fee.
The firm has no view of the account.
The court has nothing to say on that.
Ich denke, die Gebühr ist im Mai fällig.
Die Regeln verbieten eine zweite Gebühr.
Solche Fragen entscheidet das Gericht.
Je pense que la banque doit payer.
Les règles interdisent un second frais.
Creo que el banco debe pagar.
Las reglas prohíben una segunda tarifa.
Acho que o banco deve pagar.
As regras proíbem uma segunda taxa.
Я думаю, что банк должен заплатить.
Правила запрещают вторую плату.
我认为银行应当付款。
规则禁止再次收费。
銀行が支払うべきだと思います。
规则不允许银行再次收费。
मेरे विचार से बैंक को भुगतान करना होगा।
नियम दूसरा शुल्क मना करते हैं।
ฉันคิดว่าธนาคารต้องจ่าย
กฎห้ามเก็บค่าธรรมเนียมซ้ำ"""

_UNIT = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]|[\p{L}\p{M}]+|\p{N}+")
_ASCII_UNIT = re.compile(r"[a-z]+|[0-9]+")
_APOSTROPHE = regex.compile(r"(?<=\p{L})['’](?=\p{L})")


def grams(clause: str) -> set[str]:
    """Units of a clause, neighbouring pairs with its ends, and threes; a number is one sign."""
    text = clause.lower()
    u = ["#" if x[0].isdigit() else x for x in (_ASCII_UNIT if text.isascii() else _UNIT).findall(_APOSTROPHE.sub("", text) if "'" in text or "’" in text else text)]
    out = set(u)
    out.update(map(" ".join, zip(["^", *u], [*u, "$"])))
    out.update(map(" ".join, zip(u, u[1:], u[2:])))
    return out


def labelled(plain: list[str]) -> list[tuple[str, int]]:
    """(clause, declines): composed clauses in a fixed random order, and plain sentences that decline nothing."""
    rng, out = random.Random(17), [(x, 1) for x in DECLINED.split("\n")] * 3 + [(x, 0) for x in SAID.split("\n")] * 3 + [(x, 0) for x in plain]
    for lang, (who, how, what, other, must, deed) in PARTS.items():
        glue, end = ("", "。") if lang in ("zh", "ja") else ("" if lang == "th" else " ", "" if lang == "th" else "।" if lang == "hi" else ".")
        for n, y, parts in ((300 if lang == "en" else 60, 1, (who, how, what)), (300 if lang == "en" else 60, 0, (other, must, deed))):
            for _ in range(n):
                out.append((glue.join(x for x in (rng.choice(p.split(";")) for p in parts) if x) + end, y))
    rng.shuffle(out)
    return out


BIAS = ""


def learn(plain: list[str]) -> dict[str, float]:
    """Weights of the grams by logistic regression with Adagrad, that of the bias under BIAS. The same on every machine."""
    data = [(sorted(grams(x)), y) for x, y in labelled(plain)]
    w = {g: 0.0 for at, _ in data for g in at} | {BIAS: 0.0}
    seen = dict.fromkeys(w, 1e-2)
    for _ in range(8):
        for at, y in data:
            d = y - 1 / (1 + math.exp(-max(-30.0, min(30.0, w[BIAS] + sum(w[g] for g in at)))))
            for g in (*at, BIAS):
                step = d - (2e-3 * w[g] if g else 0.0)
                seen[g] += step * step
                w[g] += 0.1 * step / math.sqrt(seen[g])
    return {g: x for g, x in w.items() if abs(x) > 1e-4}


def score(clause: str, weights: dict[str, float]) -> float:
    """Log-odds that the clause declines; grams that training has not seen count nothing."""
    return weights[BIAS] + sum(weights[g] for g in grams(clause) & weights.keys())
