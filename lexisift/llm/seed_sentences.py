"""Labelled sentences that the boundary model is trained on: one sentence per line, written for this purpose, in ten languages."""

# The training text. Each line is one sentence; the trainer joins lines of a language into running text.
SEED = {
    "en": """The committee met on Tuesday.
Nobody had read the minutes.
Dr. Hayes opened the window.
Mrs. Lowe and Mr. Park left early.
We spoke to Prof. Ames about it.
Prof. Ames disagreed.
Sen. Cole and Gov. Marsh signed it.
The train left at 7 a.m. and came back at 6 p.m. on the same day.
It closes at 9 p.m.
Please be there by 8 a.m.
He works for Brandt Inc. in Leeds.
She sold the firm to Colby Ltd.
They bought it from Colby Ltd. and kept the name.
The claim against Orton Corp. was settled.
Everyone liked Orton Corp.
In Reed v. Stone Inc. the court agreed.
Bring pens, paper, etc. to the exam.
They grow apples, pears, etc.
Some fruit, e.g. lemons, is sour.
He was late, i.e. after ten.
It weighs approx. 40 grams.
It weighs approx. 3.5 kilos.
See p. 12 and pp. 30 ff. for details.
See no. 4 of the list.
See Art. 12 of the treaty.
See Sec. 9 of the act.
Sec. 5(a) was repealed; sec. 6(b) was not.
Compare fig. 3 with vol. 2 of the atlas.
Read ch. 7, para. 3 and ex. 1.
(See also App. 4.)
(This was later denied.)
The matter (see Smith et al. 2004) is open.
J. R. Miller wrote it.
It was written by J. R. Miller.
Was it raining?
Stop that at once!
What a day!
Why did nobody call?
“Is it late?” asked the porter.
“We are lost!” cried the guide.
“Come in.” The door opened.
He said: “We are closed.”
He wrote: “The answer is no.” Then he left.
They asked “Who?” and “Why?” on the same page.
She called it “odd.”
The word “sorry” was never said.
Is it red, blue, or green...?
He paused... and then went on.
I wonder... maybe tomorrow.
Well... it depends.
Really?!
You did what?!
No.
Yes.
Never mind.
Prices rose by 2.5 per cent in May.
Version 3.1.4 is out.
It ran from Feb. to Oct. without a fault.
The fee is $40.
Only 12 of 30 came.
He owes £5.
The year was 1987.
It is 5 km away.
Visit help.example.org/start, then log in.
The U.S. economy grew.
He lives in the U.S.
The U.K. court agreed.
iPhones are dear.
eBay was down.
3 of them were late.
St. Albans lies north of London.
Mt. Baker is high.
Gen. Hale and Capt. Orme retired.
Lt. Marsh, Jr., owns a boat.
Room no. 5 is free at 4 p.m.
The cat, cf. above, is black.
This costs 30 euros, incl. tax, vs. 25 last year.
As agreed with Dr. Orme of Holt Ltd. the fee is waived.
The clerk at Holt & Co. was kind.
It was 5 a.m. when they rang.
See pp. 30 ff., not p. 12.
The notes, pp. 4 ff., are short.
Apples, pears, etc., are ripe.
Write to Holt Ltd., Leeds.
Read more at example.org today.
Open the file report.txt with care.
It rose by .5 per cent.
March was cold.
Dr.Hayes rang Mr.Park.
See Art.12 and fig.3 on p.8 of it.
It weighs approx.40 grams.
Indeed.
Why not?
Enough!""",
    "de": """Der Zug fährt um acht Uhr ab.
Niemand hat den Brief gelesen.
Dr. Weber hat angerufen.
Frau Prof. Klein ist krank.
Das Gespräch mit Hrn. Lang war kurz.
Hr. Lang kam spät.
Am 5. Mai beginnt der Kurs.
Sie kam am 12. Oktober zurück.
Am 1. Januar tritt das Gesetz in Kraft.
Das Haus wurde im 18. Jahrhundert gebaut.
Es wiegt ca. 30 Kilo.
Das gilt z. B. für Kinder.
Das gilt d. h. auch für uns.
Viele Tiere, u. a. Hunde, schlafen.
Siehe Art. 4 Abs. 2 des Gesetzes.
Siehe Nr. 7 der Liste.
Siehe S. 12 und Kap. 3 im Buch.
Die Fa. Brandt zahlt die Miete inkl. Strom.
Äpfel, Birnen usw. sind reif.
Wir kauften Äpfel, Birnen usw.
Das Spiel endet bzw. beginnt um drei.
Wer hat das gesagt?
Das ist schön!
„Kommst du mit?“, fragte sie.
„Es ist spät.“ Er ging hinaus.
Er sagte: „Wir haben zu.“
Er schrieb: „Es geht nicht.“ Dann ging er.
Sie hat das Wort „nie“ gesagt.
Der Preis stieg um 2,5 Prozent.
Es kostet 30 Euro.
Das dauert 5 Tage.
Übrigens stimmt das nicht.
Ohne Strom läuft nichts.
Die Straße ist gesperrt.
Siehe Art.4 und vgl.Abs.2 dort.
Es dauert ca.30 Tage.""",
    "fr": """Le train part à huit heures.
Personne n’a lu la lettre.
M. Dupont est absent.
Mme Petit et M. Blanc sont partis.
Le Dr Martin a téléphoné.
Voir l’art. 4 du code.
Voir p. 12 et no. 5 de la liste.
Les pommes, les poires, etc. sont mûres.
On vend du pain, du lait, etc.
Le prix, c.-à-d. le total, a baissé.
Il pèse env. 30 kilos.
Qui a dit cela ?
C’est magnifique !
Pourquoi a-t-il refusé ?
« Tu viens ? » a demandé sa sœur.
« Il est tard ! » cria le garde.
« Il pleut. » Elle ferma la porte.
Il a dit : « C’est fermé. »
Elle écrivit : « Je pars. » Puis elle sortit.
Le mot « jamais » a été dit.
La hausse est de 2,5 % cette année.
Il coûte 30 euros.
Cela dure 5 jours.
État et région ont signé.
À midi, tout ferme.
Écoutez bien.""",
    "es": """El tren sale a las ocho.
Nadie leyó la carta.
El Sr. Gómez está ausente.
La Sra. López y el Dr. Ruiz salieron.
La Dra. Vega llamó ayer.
Véase el art. 4 del código.
Véase la pág. 12 y el núm. 5 de la lista.
Las manzanas, las peras, etc. están maduras.
Venden pan, leche, etc.
Pesa aprox. 30 kilos.
Ud. tiene razón.
¿Quién dijo eso?
¡Qué bonito!
¿Por qué se negó?
«¿Vienes?», preguntó su hermana.
«Es tarde.» Ella cerró la puerta.
Dijo: «Está cerrado.»
Escribió: «Me voy.» Luego salió.
La palabra «nunca» se oyó.
Subió un 2,5 % este año.
Cuesta 30 euros.
Dura 5 días.
El tribunal de EE. UU. lo aceptó.
Últimamente llueve mucho.""",
    "pt": """O comboio parte às oito.
Ninguém leu a carta.
O Sr. Gomes está ausente.
A Sra. Lopes e o Dr. Reis saíram.
A Dra. Veiga ligou ontem.
Ver o art. 4.º do código.
Ver a pág. 12 e o n.º 5 da lista.
As maçãs, as peras, etc. estão maduras.
Vendem pão, leite, etc.
Pesa aprox. 30 quilos.
Quem disse isso?
Que bonito!
Porque é que recusou?
«Vens?», perguntou a irmã.
«É tarde.» Ela fechou a porta.
Disse: «Está fechado.»
Escreveu: «Vou-me embora.» Depois saiu.
A palavra «nunca» foi ouvida.
Subiu 2,5 % este ano.
Custa 30 euros.
Dura 5 dias.
À tarde, tudo fecha.
É verdade.""",
    "ru": """Поезд уходит в восемь.
Никто не читал письмо.
Г-н Иванов отсутствует.
Проф. Белова позвонила вчера.
См. ст. 4 закона.
См. п. 5 списка на стр. 12 книги.
Это было в 1987 г. в Москве.
Он родился в 1987 г.
Он живёт в г. Тверь с детства.
Яблоки, груши и т. д. созрели.
Там продают хлеб, молоко и т. д.
Это, т. е. цена, выросло.
Это стоит 30 руб. в месяц.
Это стоит 30 руб.
Она весит прим. 30 кг.
А. С. Пушкин написал это.
Кто это сказал?
Как красиво!
Почему он отказался?
«Ты идёшь?» — спросила сестра.
«Уже поздно!» — крикнул сторож.
«Идёт дождь.» Она закрыла дверь.
Он сказал: «Закрыто».
Он написал: «Я ухожу.» Потом вышел.
Слово «никогда» прозвучало.
Рост составил 2,5 % за год.
Это длится 5 дней.
Однако это неверно.""",
    "zh": """火车八点出发。
没有人看过这封信。
谁说的？
真漂亮！
他为什么拒绝？
“你来吗？”姐姐问道。
“太晚了！”看守喊道。
他说：“已经关门了。”
她写道：“我走了。”
“永远”这个词没有出现。
价格上涨了2.5%。
会议持续了5天。
他想了想……还是走了。
《合同法》第3条适用。
李教授打了电话。
费用由公司支付。
请在九点前到达。""",
    "ja": """電車は八時に出ます。
誰も手紙を読みませんでした。
誰が言いましたか？
とてもきれいです！
なぜ断ったのですか？
「来ますか？」と姉が聞きました。
「もう遅い。」と番人は言いました。
彼は「閉店です。」と書きました。
「いつも」という言葉はありません。
価格は2.5%上がりました。
会議は5日間続きました。
彼は考えて……帰りました。
第3条が適用されます。
田中先生が電話しました。
九時までに来てください。""",
    "hi": """रेलगाड़ी आठ बजे जाती है।
किसी ने पत्र नहीं पढ़ा।
डॉ. शर्मा ने फोन किया।
श्री वर्मा और प्रो. सिंह चले गए।
सं. 5 की सूची देखें।
यह किसने कहा?
कितना सुंदर है!
उसने मना क्यों किया?
“क्या तुम आओगे?” बहन ने पूछा।
उसने कहा: “बंद है।”
कीमत 2.5 प्रतिशत बढ़ी।
बैठक 5 दिन चली।
यह सही नहीं है।
रु. 50 का शुल्क लगेगा।
पुराने नियम अब हट गए हैं।
उसने नए घर में सब नियम पढ़े।
मेरी बहन कल शाम को दिल्ली जाएगी।
हमने बाज़ार से ताज़े फल और सब्ज़ी खरीदी।
बच्चे मैदान में खेल रहे थे।
उसकी नई किताब बहुत अच्छी है।
दुकान सुबह नौ बजे खुलती है।""",
    "th": """รถไฟออกแปดโมง
ไม่มีใครอ่านจดหมาย
ใครพูดอย่างนั้น
สวยมากจริงๆ
ราคาเพิ่มขึ้น 2.5 เปอร์เซ็นต์
การประชุมใช้เวลา 5 วัน
เขาเดินทางกลับบ้านแล้ว
โปรดมาก่อนเวลาเก้าโมง""",
}
