"""The small labelled table that the personal-information model is trained on.

A sentence is an opening, a filler and an ending drawn apart from each other; a filler's kind is its label, the rest has
none. Fillers are made from parts by a seeded generator, many of the names from syllables: shapes and kinds of context are
what there is to learn, not values. Sentences of the last group hold what looks alike and belongs to nobody.
The texts were written for this table; none is taken from a table that the operator is applied to.
"""

from __future__ import annotations

import random
import re

# Parts of fillers. Invented, but for given names in common use and kinds of roads.
GIVEN = "Amara Bastian Chiara Dmitri Elena Farid Gwen Hannes Imani Joaquin Katja Leandro Malin Nadia Olivier Priya Quentin Rosa Stefan Tamsin Umberto Viktor Wanda Xavier Yasmin Zoran Amelie Bruno Colette Derek Esther Felipe Gemma Harold Ingrid Jamal Keiko Lorenzo Marta Nils Odette Pierre Rocio Sanna Thea Ulla Vincent Wendy Yusuf Zelda Hope Mark Will May Rose Grace Grant Dawn Frank Pat Victor Carol Bill".split()
FAMILY = "Abernathy Brandvold Czerny Dellacroix Engstrom Fitzwarren Gutierrez Hakimov Iversen Janssens Kowalczyk Lemaire Montalban Nakagawa Okonkwo Petrescu Quiroga Rosenthal Sandoval Tanaka Uribe Vasquez Whitcombe Yilmaz Zabala Moreau Schreiber Alvarez Novak Costa Baker Fields Wood Rivers Page Bell Marsh Banks Stone Lane Park Hill".split()
SYLLABLES = "bar den kel mor tan wick lin ger hol stad ven ros dal fur mann quist ard bel cor ham ton ley worth berg feld sen ski ova ez ini eau ard oni haus thal brook shaw".split()
PARTICLES = "von van de O' d' del Mc di le al- da".split()
#: The most frequent family names of Chinese.
ZH_FAMILY = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何高林罗郑梁谢宋唐许韩冯邓曹彭曾肖田董袁潘于蒋蔡余杜叶程苏魏吕丁任沈姚卢姜崔钟谭陆汪范金石廖贾夏韦付方白邹孟熊秦邱江尹薛闫段雷侯龙史陶黎贺顾毛郝龚邵万钱严覃武戴莫孔向汤"
ZH_GIVEN = "伟芳娜敏静丽强磊军洋勇艳杰娟涛明超秀霞平刚桂英华玉兰春梅雪宁晨博文轩宇浩欣怡佳琪思远子涵雨桐志国建红海燕晓东清若云"
ROADS_EN = "Street St St. Road Rd Rd. Lane Close Avenue Ave Ave. Drive Way Court Blvd Boulevard Terrace Place Crescent Square Row Walk Hill Gardens Parade Mews Alley Grove Green Rise Vale View Quay Path Trail Circle".split()
ROADS_DE, ROADS_FR = "straße weg allee gasse platz ring ufer damm steig strasse str.".split(), "rue avenue allée chemin place impasse boulevard quai cours sentier".split()
ROADS_ES, ROADS_XX = "Calle Avenida Plaza Camino Paseo Ronda Travesía C/ Carrera".split(), "Via Viale Piazza Corso Rua Largo".split()
PLACES = "Rosemary Juniper Granite Windmill Copper Chestnut Thistle Quarry Rectory Lavender Harbour Beacon Falcon Priory Tanner Cobbler Elmwood Victoria North South Old New Upper Lower King's Queen Saint".split()
PLACES_DE = "Ahorn Buchen Mozart Goethe Markt Wiesen Stein Kloster Brunnen Ulmen Fichten Schul Post Hafen Amsel Lerchen Burg".split()
PLACES_FR = "des Acacias|de la Fontaine|du Moulin|Victor-Hugo|des Érables|de l’Église|du Pont|des Roses|de la République|Pasteur|du Général-Leclerc|aux Herbes".split("|")
PLACES_ES = "del Sol|de la Luna|Mayor|San Isidro|de los Naranjos|Las Palmas|del Carmen|Santa Ana|de la Paz|Colón|del Prado|Buenavista|de Alcalá".split("|")
PLACES_ZH = "中山 人民 解放 建设 朝阳 和平 文化 学府 滨江 西湖 东风 光明 幸福 金水 玉泉 桃源".split()
HOSTS, TOPS = "mail inbox letters northwind studio atelier kontor correo posta team home dept example lakeshore blue-fox info".split(), "com org net de fr es io co.uk example.com test edu eu".split()
NOUNS = "budget harbor release data market river winter summer garden design review finance safety travel music library energy water quality product customer service storage network search platform weekly annual silver central open public morning delta kernel vector signal cache memory stream archive compass lantern orbit".split()
NOUNS_DE = "Zeilen Stühle Tage Stunden Bücher Fragen Seiten Meter Personen Gäste Karten Fehler Dateien Kilometer Minuten Kisten Zimmer Haus Gleis Absatz Lauf Reihe Linie Woche Punkte Gruppen Schritte Teile".split()
ORGS = "Team Council Board Group Committee Guild Department Office Unit Crew Club Project Report Guide Map Table Plan Index Notes Summit Fund Award Session Pipeline Station Park Review Store Engine Squad Desk Line Manual Atlas Festival".split()

# (openings, endings) of the sentences with one filler, by kind and language.
FRAMES = {
    "email": [
        ("forward the minutes to|Drop a line to|the bounce came from|Invoices should reach|She subscribed with|log in as|Replies go straight to|E-mail:|from:|To:|The recruiter used|A reset link was sent to|Questions? Try|Our billing contact has|He switched to|you could try|Add|share the folder with|I registered as|The newsletter went out to|sent by|booked under|works better:|reach us through|",
         "|.| before the weekend.|, thanks.| instead of the old one.| (work).| if that bounces.|; the other one is dead.| and wait for an answer.| with the signed copy.|, not to the list.| works for me.| is the right inbox.| bounced twice.| belongs to my sister.| to the thread.|!| for anything urgent.| whenever you like.", ["email"]),
        ("Leite das Protokoll weiter an|Rückfragen bitte an|Sie liest nur|Kontakt:|Melde dich unter|Die Rechnung ging an|Neu bei uns:|Er schreibt von", ".| weiter.| bis Freitag.|, danke.| statt der alten.| erreichbar.| eintragen.|", ["email"]),
        ("Transfère le dossier à|Contacte|Réponds plutôt à|La facture part vers|Elle utilise|Inscris-toi avec|Adresse électronique :", ".| avant lundi.|, merci.| pour toute question.| au lieu de l’ancienne.|", ["email"]),
        ("Reenvía el acta a|Contacta con|La factura va a|Ella usa|Regístrate con|Dirección electrónica:|Copia también a", ".| antes del lunes.|, gracias.| para cualquier duda.| en vez de la antigua.|", ["email"]),
        ("邮箱：|账单寄到|把会议记录转给|她用的是|注册账号是|有问题联系|电子邮件", "。|，谢谢。|吧。| 即可。|，不要发群里。| 收。", ["email"]),
    ],
    "phone": [
        ("You will get me at|text|Ring the plumber at|Mobile:|Phone|fax|His extension moved to|my cell is|The hotline is|WhatsApp works on|leave a voicemail at|Her landline:|Emergency contact|Somebody rang from|the taxi picks up under|try the desk on|New number since Tuesday:|Please dial|Best reached on|Tel.|callback wanted:|The clinic answers|I missed a call from|for bookings use|the number on file is|Front desk:|number:|My number:|this number|her number is still|the number was|your number,|",
         "|.| after lunch.| or knock.| at night.|, ask for the porter.| (mobile).| on weekdays only.|; nobody picks up before ten.| and let it ring.| works too.| is my landline.| is out of service.| belongs to the caretaker.| if plans change.|?", ["phone"]),
        ("Du erreichst mich unter|Handy:|Telefon|Die neue Nummer lautet|Bitte zurückrufen:|Festnetz|Ihre Durchwahl ist|Der Notdienst hat|Schick eine SMS an|Nummer:|Ihre Nummer war|seine Nummer", ".| nach Feierabend.| werktags.|, bitte klingeln lassen.| erreichbar.| gewählt.|", ["phone"]),
        ("Joignable au|Portable :|Tél.|Le nouveau numéro est|Rappelle-moi au|Le cabinet répond au|Envoie un SMS au|Fixe :|Numéro :|Son numéro était|ton numéro,", ".| après midi.| en semaine.|, merci.| le soir.|", ["phone"]),
        ("Me encuentras en el|Móvil:|Teléfono|El nuevo número es|Devuélveme la llamada al|La clínica contesta en el|Manda un SMS al|Fijo:|Número:|Su número era|tu número,", ".| por la tarde.| entre semana.|, gracias.|", ["phone"]),
        ("手机：|联系电话|打这个号码|新号码是|短信发到|座机|客服热线|号码是|号码", "。|，晚上再打。|找我。| 就行。|，别忘了。", ["phone"]),
    ],
    "id_number": [
        ("His passport reads|passport no.|Social security number|SSN:|the driver's licence shows|National insurance:|her tax number is|ID card|identity document|The visa lists|My health card says|Residence permit|the applicant gave|Personal number|the border officer copied|A photo of the licence with|Citizen number|The clerk typed|the patient is filed under|Taxpayer|born with number|her ID is|The bank wants proof of|holder of document|we hold your number|number:|My number:|this number|his number is still|the number was|your number,|noted as|copied",
         "|.| and a photo.| as proof.| (expired).| for the visa.| on file.|, issued last year.| under his name.|; keep it private.| belongs to the tenant.| was typed wrong.| is hers.| for the registration.| has to be renewed.| before the flight.", ["id_number"]),
        ("Ihr Reisepass hat|Personalausweis Nr.|Steuernummer|Die Sozialversicherungsnummer lautet|Führerschein|Ausweisnummer:|Der Antragsteller nannte|Krankenkasse führt sie unter|Nummer:|Ihre Nummer war|seine Nummer", ".| und ein Foto.| als Nachweis.| (abgelaufen).| eingetragen.|", ["id_number"]),
        ("Son passeport porte|Carte d’identité n°|Numéro de sécurité sociale|Permis de conduire|Le titre de séjour indique|Le demandeur a donné|Numéro fiscal :|Numéro :|Son numéro était|ton numéro,", ".| comme preuve.| (expiré).| pour le visa.|", ["id_number"]),
        ("Su pasaporte lleva|DNI|NIE:|Número de la seguridad social|Permiso de conducir|El solicitante dio|La cédula dice|Documento de identidad|Número:|Su número era|tu número,", ".| como prueba.| (caducado).| para el visado.|", ["id_number"]),
        ("身份证号：|护照号码|社保号|驾驶证|证件号|申请人填写的身份证是|本人证件|号码是|号码", "。|，请保密。|，已核对。| 登记过。|，明年到期。", ["id_number"]),
    ],
    "en": [
        ("Grandma still lives at|the keys are at|Ship it to|Her studio is on|Meet me at|Bring the boxes to|Home address:|Visit us at|The clinic moved to|they bought|the courier stopped at|Send flowers to|the house on|billing address|a flat at|the meter at|Office:|Our new place is|The tenant of|He grew up at|Drop the parcel at|from|the fire broke out at|walk over to|",
         "|.| since spring.|, second floor.| (side door).| by Friday.| before noon.|, flat 3.| and ring twice.|; mind the dog.| is for sale.| has a red door.| with the van.| until the lease ends.|, please.| across from the school.", ["en"]),
    ],
    "de": [("Oma wohnt noch|Die Schlüssel liegen|Liefert es an die|Ihre Praxis ist jetzt|Treffpunkt:|Anschrift:|Besuch uns|Das Büro zog um in|Rechnungsadresse|Das Paket liegt bei|Wir treffen uns vor", ".| seit dem Frühjahr.|, zweiter Stock.| bis Freitag.| abgeben.| steht leer.|", ["de"])],
    "fr": [("Mamie habite encore|Les clés sont au|Expédie-le au|Son cabinet est désormais|Rendez-vous au|Adresse :|Le bureau a déménagé au|Le colis attend au|Ils ont acheté le", ".| depuis le printemps.|, deuxième étage.| avant vendredi.| est à vendre.|", ["fr"])],
    "es": [("La abuela sigue en|Las llaves están en|Envíalo a|Su consulta está en|Nos vemos en|Dirección:|La oficina se mudó a|El paquete espera en|Compraron el piso de", ".| desde la primavera.|, segundo piso.| antes del viernes.| está en venta.|", ["es", "es", "it"])],
    "zh": [("家住|快递送到|地址：|诊所搬到了|钥匙放在|公司在|她租的房子在|请到", "。|，二楼。|取件。|门口见。|，记得按铃。| 等我。", ["zh"])],
    "name": [
        ("Call|Meet|Phone|Email|Visit|Find|Thank|See|Catch|Contact|Greet|Remind|Pay|Help|Follow|Tell|I met|We hired|Dear|Hi|Kind regards,|Written by|the patient|Author:|Ask|my colleague|Yesterday|Our landlord|according to|says|spoke with|A letter from|signed:|The tenant is|Interview with|invite|She married|thanks,|Best,|Reviewer:|with|and|Born to|The plumber,|My cousin|her brother|Patient|Attendees:|photo by|assigned to|Owner:|The new hire is named|a man called|She is called|is named|Dr.|Mr.|Mrs.|Ms|Prof.|Professor|Captain|",
         "|.| about it.| at the fair.| left early.| agreed.| says hello.|, who lives upstairs,| has the keys.| and I disagree.| was late again.| will cover the shift.| wrote the draft.| for the invitation.| won the raffle.|'s dog barks.|, please.| on Thursday.| paid in cash.| to dinner.|?| plays the cello.| is my dentist.| asked for a refund.", ["name"]),
        ("Sag|Ich traf|Liebe|Viele Grüße,|Geschrieben von|Unser Vermieter|Laut|Gespräch mit|Patientin|Die Nachbarin|Herr|Frau|Mein Kollege|Hallo|Er heißt|Die Neue heißt", ".| Bescheid.| am Bahnhof.| ging früh.| grüßt dich.| hat die Schlüssel.| übernimmt.|, der oben wohnt,| spielt Cello.|", ["name"]),
        ("Dis à|J’ai croisé|Chère|Cordialement,|Écrit par|Notre propriétaire|Selon|Entretien avec|La patiente|M.|Mme|Ma collègue|Bonjour|Elle s’appelle|Il s’appelle", ".| de venir.| à la gare.| est partie tôt.| te salue.| a les clés.|, qui habite en haut,| joue du violon.|", ["name"]),
        ("Dile a|Me crucé con|Querida|Saludos,|Escrito por|Nuestro casero|Según|Entrevista con|La paciente|Sr.|Sra.|Mi compañera|Hola|Se llama|Ella se llama", ".| que llame.| en la estación.| se fue pronto.| te saluda.| tiene las llaves.|, que vive arriba,| toca el violín.|", ["name"]),
        ("联系人|负责人|收件人|邻居|告诉|我遇到了|亲爱的|作者：|房东|据|采访|病人|同事|老师|跟|昨天|感谢|他叫|新来的叫|医生|教练", "。|说他会来。|同意了。|有钥匙。|，住在楼上。|女士签了字。|先生请假。|正在开会。|把文件拿走了。|医生值班。|会迟到。|会处理的。|要出差。", ["zhname"]),
    ],
    "mixed": [
        ("|Contact card:|Applicant:|- |Guest list:|Sender|Lost card of|Delivery for|Tenant", ".||;| (new).| - confirmed", ["name, email", "name, phone", "name; phone; email", "name, en", "name, de", "name, en, phone", "name (email)", "name (phone)", "name, id_number", "name / email / phone", "en, phone", "email, phone", "name, fr", "name, es, email", "name - id_number - phone", "name and name", "name, name and name", "name lives at en, phone", "name has id_number", "name wohnt de", "name, phone or email", "name <email>"]),
        ("|联系人：|收件人|租客", "。||；", ["zhname，phone", "zhname，zh", "zhname，email", "zhname、zhname", "zhname（phone）", "zhname，id_number", "zh，zhname 收，phone"]),
    ],
    "none": [
        ("Order|Purchase order|Invoice|Batch|Build|Shipment|tracking number|Serial|part no.|Ticket|the lot with code|SKU|Job|Contract no.|Article|Checkout for order|Lot|device|Voucher|Item code|reference|the meter reads|account balance|release|Case|Record|Key|The item|Counter|Range|Sensor|the log shows|ISBN|port|pallet|Bestellung|Rechnung Nr.|Auftrag|Charge|Seriennummer|Lieferschein|Commande|Facture n°|Lot n°|Pedido|Factura|Lote|Número de serie|订单|批次|发票号|工单|序列号|构建|设备编号|change set|patch|Revision|queue|attempt|shard|page|Lauf Nr.|Zeile|parche n.º|ligne|补丁|第",
         "|.| shipped.| is late.| was merged.| has two defects.| failed again.| belongs to the warehouse.| is a part, not a person.| closed on Monday.| on the shelf.| replaced the old unit.| for the pump.| wurde geliefert.| ist offen.| est livrée.| llegó tarde.|已发货。|失败了。|缺货。", ["idlike", "idlike", "phonelike", "phonelike", "serial", "serial"]),
        ("|The|Our|the|Ask the|Welcome to the|minutes of the|at|from the|She runs the|with the|Join|About the|News:|Thanks to the|Read the|#|Die|La|El|Das|in", "|.| meets on Monday.| was archived.| grew by a third.| covers the basics.| is closed today.| approved it.| needs a review.| page 4.| moved three records.| owns it.| will drop the table.| tagt heute.| se réunit lundi.| abre mañana.", ["org", "org", "org", "org", "famorg", "place"]),
        ("|At|On|Chapter|Section|see|Figure|Table|Step|Row|Level|Platform|Version|the level|Between|about|Page|Kapitel|Tabelle|第", "|.| of the guide.| on the map.| were counted.| failed.| is full.| lists all lanes.| shows more.| gefunden.|章。|行。", ["numcap", "capnum", "denum", "date", "date", "time", "ip", "money", "version", "small", "small"]),
        ("The|It|They|she|We|you|this one|nobody|that plan|prices|", "|.| as agreed.| later.| again.| next week.", ["modal", "modal", "modal"]),
        ("See|path|mention|decorator|clone|import|push to|handle|Ping|meet at|look at|open", "|.| first.| is gone.| for details.| was renamed.", ["atword", "atword", "url", "file", "attime", "hash", "hash"]),
        ("the|The|for|of|in|after|that covers|owned by|we keep|Since|into|from|La caché de|le module|das Modul|el límite de|nach|limite de|Nous gardons|Tras|reading list for|a map of|", "|.| has rows.| and the older ones.| is stale.| was rebuilt.| tarda mucho.| répond vite.| braucht lange.| at last.| now.| again.| for now.| se quedó.| reste ici.| with two flags.| pinned until the run ends.", ["lowpair"]),
        ("和|我们|请|会议|项目|任务|文档|系统|这次|由于|高度|白天|方法|马上|金额|时间", "。|完成了。|需要检查。|不要改动。|已经更新。|没有变化。|下周再说。", ["zhword", "zhword", "zhcount"]),
        ("", "", ["plain"]),
    ],
}
#: Ordinary sentences, some with capitals and small numbers.
PLAIN = "The meeting starts at nine. Bring your own cup.|Nobody Expected That Outcome.|Please Read Before Use|Spring came early; Winter stayed away.|It may rain, but we will walk.|Mark the boxes in blue.|I hope the grant comes through.|We saw 14 deer and 3 foxes.|Monday March 3 is taken.|January February March|In May we will frank the letters.|Der Zug Nach Süden fährt um 9.|Wir haben 12 Äpfel und 4 Birnen.|Le train part à 8 heures.|Hay 7 sillas y 2 mesas.|Version Two of the Plan|All Rights Reserved|Happy New Year|Good Morning Everyone|Project Status: Green|New York and Los Angeles|East Coast, West Coast|North America|United Nations|Apache Spark runs on Java.|Step One: Preheat. Step Two: Stir.|He read Moby Dick twice.|OK Then|To Do|Dear All|Dear Team|Hello World|Thank You|Next Steps|Open Questions|Key Points|Table Of Contents|User Story|Pull Request 12 was merged|the will of the people|a page from the book|a bill of 30|the bell rang at dawn|an open field near the wood|Ask Again Later|Tell Me More|With Best Wishes|I Think So|Yes No Maybe|Grüße aus Berlin|Guten Morgen Zusammen|Bonjour Tout Le Monde|Buenos Días|今天天气很好，我们去散步。|高温持续三天。|方案已经通过，下周开始。|他说明天再来。|白色的墙和黄色的门。|请把金额填在表里。|任何问题都可以问。|向前走，马上就到。|何时出发？|江边有一家小店。|石头很重。|万一下雨就改期。|在完成之前不要提交。".split("|")
ZH_WORDS = "方案 高度 白天 金额 时间 方法 任务 何时 任何 向前 马上 万一 江边 石头 黄色 于是 史料 雷雨 毛病 钱包 程序 叶子 田地 林区 张贴 周末 常见 文件 模块 查询 记录 缓存 会话 重启 数据 段落 范围 贺卡 严格 武器 孔径 汤匙 余额 夏天 秦朝 龙头 温度 许可 董事会 曾经 成员 安排 平台 单元 计划 和平 明确 包括 施工 华丽 经常 于此".split()
#: Words that tell of a kind, lower case; single Han characters count by themselves. Fixed values.
CUES = {
    "phone": "phone call calls called calling callback tel telephone mobile cell dial ring rang text sms fax line landline whatsapp hotline extension voicemail telefon handy anrufen anruf rufnummer ruf festnetz durchwahl zurückrufen klingeln téléphone tél portable appelle appeler appelez joignable joindre fixe rappelle teléfono móvil llama llamar llámame llamada fijo 电 话 手 机 拨 打 座 热 线 短 信",
    "id": "passport ssn social security id identity identification licence license national insurance tax taxpayer permit visa citizen applicant patient document card reisepass pass personalausweis ausweis ausweisnummer steuernummer sozialversicherungsnummer führerschein kennung passeport carte identité sécurité sociale permis séjour fiscal dni nie pasaporte cédula seguridad documento solicitante identidad 身 份 证 护 照 社 保 驾",
    "thing": "order build batch invoice serial ticket version run release sku part item tracking checksum sensor row commit job shipment parcel lot model isbn revision port range counter device voucher code article contract key case record log meter balance account pallet reference purchase change patch revision queue attempt shard page line column bestellung lauf zeile änderung changement ligne cambio parche página auftrag rechnung lieferung lieferschein charge seriennummer gerät commande facture lot série pedido factura lote serie 订 单 批 次 发 票 编 版 本 序 列 构 建 设 备 工 补 提 交 第",
    "org": "team council board group committee guild department office unit crew club project report guide map table plan index notes summit fund award session pipeline station park review store engine squad desk manual atlas festival service company bank university school lake mount fort port san new north south east west river bay county bridge island coast grupo equipo consejo comité proyecto departamento gruppe ausschuss abteilung projekt verein rat groupe équipe conseil projet département",
    "home": "live lives living lived moved move address deliver delivery ship house flat apartment home visit clinic courier tenant studio wohne wohnt adresse anschrift lieferung liefert büro habite habitent adresse livraison cabinet bureau vivo vive dirección entrega oficina piso 住 址 寄 送 搬 租 家",
    "num": "number numbers no nr nummer numéro número num n° n.º 号 码",
    "person": "dear hi hello regards mr mrs ms dr prof professor captain tell told ask asked met meet hired married cousin brother sister mother father colleague neighbour neighbor landlord dentist doctor plumber author signed written spoke interview invite says said thanks herr frau liebe lieber hallo grüße traf kollege kollegin nachbarin nachbar vermieter patientin mme m chère cher bonjour cordialement selon croisé collègue voisine sr sra querida querido hola saludos dile casero compañera vecina 告 诉 遇 作 者 房 东 采 访 病 同 事 师 先 生 女 士",
}


def cased(r: random.Random, text: str, upper: float, lower: float) -> str:
    x = r.random()
    return text.upper() if x < upper else text.lower() if x < upper + lower else text


class Filler:
    """given, family: further names, as a lexicon has them; a part of the names is made of these."""

    def __init__(self, seed: int, given: list[str] = (), family: list[str] = ()):
        self.r = random.Random(seed)
        wide = lambda x: x[:1] > "⺀"
        self.given, self.family = [x for x in given if not wide(x)] or GIVEN, [x for x in family if not wide(x)] or FAMILY

    def digits(self, n: int) -> str:
        return "".join(self.r.choices("0123456789", k=n))

    def letters(self, n: int) -> str:
        return "".join(self.r.choices("ABCDEFGHJKLMNPRSTVXYZ", k=n))

    def made(self) -> str:
        return "".join(self.r.choices(SYLLABLES, k=self.r.choice([2, 2, 3]))).capitalize()

    def name(self) -> str:
        r = self.r
        given = r.choice(self.given) if (known := r.random()) < 0.35 else r.choice(GIVEN) if known < 0.7 else self.made()
        x = r.random()
        family = r.choice(self.family) if x < 0.25 else r.choice(FAMILY) if x < 0.5 else self.made()
        if r.random() < 0.16:
            p = r.choice(PARTICLES)
            family = p + ("" if p[-1] in "'-c" else " ") + family
        if r.random() < 0.08 and "-" not in family:
            family += "-" + self.made()
        if r.random() < 0.1:
            given += "-" + r.choice(GIVEN)
        form = r.random()
        text = f"{family}, {given}" if form < 0.2 else f"{given} {self.letters(1)}. {family}" if form < 0.36 else f"{self.letters(1)}. {family}" if form < 0.39 else f"{given} {r.choice(GIVEN)} {family}" if form < 0.44 else f"{given} {family}"
        return cased(r, text, 0.1, 0.25 if known < 0.35 else 0)

    def zhname(self) -> str:
        r = self.r
        return r.choice(ZH_FAMILY) + "".join(r.choice(ZH_GIVEN) if r.random() < 0.7 else chr(r.randrange(0x4E00, 0x8F00)) for _ in range(r.choice([1, 2, 2, 2])))

    def email(self) -> str:
        r = self.r
        g, f = re.sub(r"[^a-z]", "", r.choice([*GIVEN, *self.given]).lower()) or "info", re.sub(r"[^a-z]", "", (r.choice([*FAMILY, *self.family]) if r.random() < 0.5 else self.made()).lower()) or "desk"
        user = r.choice([f"{g}.{f}", f"{f}-{g}", f"{g}_{self.digits(3)}", f"{g[0]}{f}", f"{g}+{r.choice(NOUNS)}", f"{f}{self.digits(2)}", f"{g}{f}", f"{g}", f"{g[0]}.{f}", f"{f}{self.digits(4)}"])
        host = r.choice([r.choice(HOSTS) + ".", "", ""]) + r.choice([*HOSTS, f]) + "." + r.choice(TOPS)
        form = r.random()
        dotted = lambda x: host.replace(".", x)
        text = f"{user}@{host}" if form < 0.5 else f"{user} @ {host}" if form < 0.6 else f"{user}[at]{dotted('[dot]')}" if form < 0.7 else f"{user}(at){dotted('(dot)')}" if form < 0.78 else f"{user} at {dotted(' dot ')}" if form < 0.9 else f"{user} [at] {host}" if form < 0.95 else f"{user} (at) {host}"
        return text.title() if r.random() < 0.06 else cased(r, text, 0.08, 0)

    def phone(self) -> str:
        d, r = self.digits, self.r
        country = r.choice(["1", "44", "49", "33", "34", "86", "46", "39", "31", "353", "420", "61"])
        sep = r.choice([" ", " ", "-", "."])
        groups = r.choice([(3, 3, 4), (2, 4, 4), (3, 7), (10,), (4, 6), (2, 3, 4), (2, 2, 2, 2, 2), (3, 3, 3), (1, 2, 2, 2, 2), (3, 4, 4), (2, 5, 3), (4, 3, 3), (2, 8), (3, 3, 2, 2), (5, 6)])
        body = sep.join(d(g) for g in groups)
        form = r.random()
        if form < 0.4:
            return f"+{country}{r.choice([sep, sep, '', ' (0)'])}{body}"
        if form < 0.5:
            return f"00{country}{sep}{body}"
        if form < 0.6:
            return f"({d(r.choice([3, 3, 4, 2]))}) {d(3)}{r.choice(['-', ' '])}{d(4)}"
        if form < 0.72:
            return f"0{d(r.choice([1, 2, 3, 4]))}{r.choice([' ', '-', '/', ' '])}{sep.join(d(g) for g in r.choice([(3, 4), (6,), (3, 3), (4, 4), (2, 2, 2, 2), (5, 2), (7,)]))}"
        if form < 0.86:
            return f"{d(3)}{(s := r.choice(['-', '.', ' ', '-']))}{d(3)}{s}{d(4)}"
        return r.choice([f"1{d(10)}", f"1{d(2)} {d(4)} {d(4)}", f"1{d(2)}-{d(4)}-{d(4)}", f"07{d(9)}", f"07{d(3)} {d(6)}", f"6{d(8)}", f"6{d(2)} {d(3)} {d(3)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{d(2)} {d(4)}-{d(3)}", f"0{d(3)} {d(5)}-{d(2)}"])

    def id_number(self) -> str:
        d, r, a = self.digits, self.r, self.letters
        year, day = f"{r.choice(['19', '20'])}{d(2)}", f"{r.randrange(1, 13):02}{r.randrange(1, 29):02}"
        text = r.choice([f"{d(3)}-{d(2)}-{d(4)}", f"{d(3)} {d(2)} {d(4)}", f"{a(2)}{d(6)}{a(1)}", f"{a(2)} {d(2)} {d(2)} {d(2)} {a(1)}", f"{a(2)}-{d(2)}-{d(2)}-{d(2)}-{a(1)}", f"{a(1)}{d(8)}", f"{a(2)}{d(7)}", f"{d(8)}{a(1)}", f"{d(8)}-{a(1)}", f"{a(1)}{d(7)}{a(1)}", f"{d(6)}{year}{day}{d(4)}", f"{d(6)}{year}{day}{d(3)}X", f"{day}{d(2)}-{d(4)}", f"{d(9)}", f"{a(1)}{d(2)}{a(1)}{d(5)}", f"{d(1)} {d(2)} {d(2)} {d(2)} {d(3)} {d(3)}", f"{a(2)}-{d(3)}-{d(3)}-{a(1)}", f"{a(2)} {d(3)} {d(3)} {a(1)}", d(r.choice([8, 9, 11, 12])), f"{a(2)}{d(r.choice([5, 6]))}", "".join([a(1), *(r.choice([a(1), d(1), d(1), d(1)]) for _ in range(7)), d(1)]), f"{d(2)}{a(2)}{d(5)}", f"{d(2)} {d(3)} {d(3)} {d(3)}"])
        return cased(r, text, 0, 0.12)

    def en(self) -> str:
        r = self.r
        number = f"{r.randrange(1, 400)}" + r.choice(["", "", "", "", "A", "B", "c", " B", "-12"])
        name = r.choice([r.choice(PLACES), r.choice(PLACES), self.made(), r.choice(FAMILY)]) + r.choice(["", "", " " + r.choice(PLACES)])
        return cased(r, f"{number} {name} {r.choice(ROADS_EN)}", 0.04, 0.06)

    def de(self) -> str:
        r = self.r
        stem = r.choice(PLACES_DE) if r.random() < 0.5 else self.made() if r.random() < 0.7 else f"{r.choice(GIVEN)}-{self.made()}-"
        road = stem + (r.choice(ROADS_DE).capitalize() if stem[-1] == "-" else r.choice(["", "", "er"]) + r.choice(ROADS_DE)) if r.random() < 0.75 or stem[-1] == "-" else r.choice(["Am ", "Im ", "An der ", "Alte ", "Zum "]) + stem + r.choice(["", "platz", "weg"]) if r.random() < 0.5 else stem + "er " + r.choice(["Straße", "Weg", "Allee", "Platz", "Str."])
        return cased(r, f"{road} {r.randrange(1, 300)}" + r.choice(["", "", "", "a", "b", " c"]), 0.03, 0.05)

    def fr(self) -> str:
        r = self.r
        place = r.choice(PLACES_FR) if r.random() < 0.6 else f"{r.choice(['des', 'de la', 'du', 'de', 'aux'])} {self.made()}" + r.choice(["", "", f" {self.made()}", f"-{self.made()}"])
        return cased(r, f"{r.randrange(1, 400)}{r.choice([',', '', '', ' bis', ' ter,'])} {r.choice(ROADS_FR)} {place}", 0.03, 0.05)

    def es(self) -> str:
        r = self.r
        place = r.choice(PLACES_ES) if r.random() < 0.6 else r.choice(["de la ", "del ", "de ", "", "de los "]) + self.made() + r.choice(["", "", f" {self.made()}"])
        return cased(r, f"{r.choice(ROADS_ES)} {place}{r.choice([',', '', ' n.º'])} {r.randrange(1, 400)}{r.choice(['', '', '', ' bis', 'B'])}", 0.03, 0.05)

    def it(self) -> str:
        r = self.r
        return f"{r.choice(ROADS_XX)} {r.choice([self.made(), r.choice(FAMILY), r.choice(GIVEN)])}{r.choice([',', ''])} {r.randrange(1, 400)}"

    def zh(self) -> str:
        r = self.r
        stem = r.choice(PLACES_ZH) if r.random() < 0.5 else "".join(chr(r.randrange(0x4E00, 0x8F00)) for _ in range(r.choice([1, 2, 2])))
        return f"{stem}{r.choice(['', '', '东', '西', '北', '一'])}{r.choice(['路', '街', '巷', '大道', '胡同', '弄'])}{r.randrange(1, 400)}号"

    def noun(self) -> str:
        return self.r.choice(NOUNS).capitalize()

    def fill(self, slot: str) -> str:
        r, d = self.r, self.digits
        got = {
            "idlike": lambda: r.choice([self.id_number, self.id_number, lambda: f"{self.letters(2)}-{d(5)}"])(),
            "phonelike": lambda: r.choice([f"{d(3)}-{d(3)}-{d(4)}", f"{d(4)}-{d(4)}-{d(3)}", f"{d(10)}", f"{d(3)} {d(3)} {d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"{d(9)}.{d(1)}", f"+{d(3)} {d(3)} {d(1)}", f"{d(4)} {d(4)}", f"{d(3)}-{d(2)}-{d(4)}", f"{d(12)}", f"{d(3)} {d(2)} {d(4)}", f"-{d(3)},{d(3)} +{d(3)},{d(3)}"]),
            "serial": lambda: r.choice([f"{self.letters(3)}-{d(6)}", f"{d(6)}", f"{d(7)}", f"#{d(8)}", f"{self.letters(1)}{d(8)}", f"{self.letters(2)}{d(6)}{self.letters(1)}", f"{d(4)}/{d(4)}", f"{d(3)}-{d(3)}-{d(3)}", f"{d(2)}-{d(5)}-{d(2)}"]),
            "org": lambda: r.choice([f"{self.noun()} {r.choice(ORGS)}", f"{r.choice(ORGS)} {self.noun()}", f"{self.noun()} {self.noun()} {r.choice(ORGS)}", f"{self.noun()} and {self.noun()} {r.choice(ORGS)}"]),
            "famorg": lambda: r.choice([f"{r.choice([*FAMILY, *self.family])} {r.choice(ORGS)}", f"{r.choice(ORGS)} {r.choice([*FAMILY, *self.family])}", f"{r.choice([*GIVEN, *self.given])} {r.choice(ORGS)}", f"{self.made()} {r.choice(ORGS)}", f"{r.choice(ORGS)} {self.made()}"]),
            "place": lambda: r.choice([f"{r.choice(PLACES)} {r.choice(ROADS_EN)}", f"{r.choice(PLACES_DE)}straße", f"{r.choice(['Lake', 'Mount', 'Fort', 'Port', 'San', 'New'])} {self.made()}", f"{r.choice(PLACES)} {r.choice(['River', 'Bay', 'County', 'Bridge'])}"]),
            "numcap": lambda: f"{r.randrange(1, 400)} {r.choice([*PLACES, *[n.capitalize() for n in NOUNS]])} {r.choice([*ORGS, *NOUNS, 'Street Map', 'Mill Guide', 'Road Race', 'Lane Closures'])}",
            "capnum": lambda: r.choice([f"{self.noun()} {r.choice(ORGS)} {r.randrange(1, 400)}", f"{self.noun()} {r.randrange(1, 4000)}", f"{r.choice(ORGS)} {r.randrange(1, 99)}", f"{r.choice(['Route', 'Highway', 'Gate', 'Room', 'Zone', 'Player', 'Phase', 'Test', 'Zeile', 'Seite', 'Ligne', 'Página'])} {r.randrange(1, 400)}"]),
            "date": lambda: f"20{d(2)}-0{r.randrange(1, 9)}-1{d(1)}" + r.choice(["", " 1" + d(1) + ":3" + d(1), "T09:15:0" + d(1)]),
            "time": lambda: f"{r.randrange(10, 23)}:{r.randrange(10, 59)}" + r.choice(["", ":12", " - 19:30"]),
            "ip": lambda: f"192.168.{r.randrange(1, 255)}.{r.randrange(10, 255)}" + r.choice(["", f":{d(4)}"]),
            "money": lambda: r.choice([f"{r.randrange(1, 99)},{d(3)},{d(3)}.{d(2)}", f"{r.randrange(1, 99)} {d(3)} {d(3)} EUR", f"${d(4)}.{d(2)}", f"{r.randrange(1, 9)}.{d(3)}.{d(3)} rows"]),
            "version": lambda: r.choice([f"{d(1)}.{d(2)}.{d(1)}", f"v{d(1)}.{d(1)}.{d(4)}", f"3.1415926{d(2)}", f"{d(4)}..{d(4)}"]),
            "small": lambda: f"{r.randrange(2, 5000)} {r.choice(['rows', 'records', 'lignes', 'filas', 'items', *NOUNS_DE])}",
            "denum": lambda: f"{r.choice(NOUNS_DE)} {r.randrange(1, 400)}",
            "lowpair": lambda: r.choice([*FAMILY, *self.family, *GIVEN, *self.given]).lower() + r.choice([" ", " ", "_", "-"]) + r.choice(NOUNS),
            "modal": lambda: f"{r.choice('may will hope mark grant dawn rose bill page bell stone frank pat'.split())} {r.choice('rain be for the close again of a in on park field wood lane banks'.split())}",
            "atword": lambda: r.choice([f"@{r.choice(NOUNS)}", f"@{r.choice(NOUNS)}_{r.choice(NOUNS)}", f"git@{r.choice(NOUNS)}", f"{r.choice(NOUNS)}@{d(1)}.{d(1)}.{d(1)}", f"@{r.choice(NOUNS)}/{r.choice(NOUNS)}"]),
            "url": lambda: f"https://{r.choice(HOSTS)}.{r.choice(['example', 'org', 'dev'])}/{r.choice(NOUNS)}?{r.choice('vkq')}={d(r.choice([2, 8]))}",
            "file": lambda: f"{r.choice(NOUNS)}/{r.choice(NOUNS)}_{d(r.choice([1, 7]))}.{r.choice(['py', 'csv', 'md'])}",
            "attime": lambda: f"{r.choice(NOUNS)} at {r.choice(['noon', 'home', 'scale', 'least', 'once', 'nine', 'work'])}",
            "hash": lambda: r.choice(["", "", "s-", "(", "#", "id-", "@"]) + "".join(r.choices("0123456789abcdef", k=r.choice([7, 8, 8, 12, 40]))),
            "zhword": lambda: r.choice(ZH_WORDS) + r.choice(["", "", r.choice(ZH_WORDS)]),
            "zhcount": lambda: r.choice(ZH_WORDS) + d(r.choice([1, 2, 4, 6])) + r.choice(["次", "条", "个", "号", "行", "号任务"]),
            "plain": lambda: r.choice(PLAIN),
        }.get(slot)
        return got() if got else getattr(self, slot)()


KIND = {"en": "address", "de": "address", "fr": "address", "es": "address", "it": "address", "zh": "address", "zhname": "name"} | {k: k for k in ("email", "phone", "id_number", "name")}
#: Sentences of each group in a table, shared by the group's frames; `none` has the rest of the looks-alike.
SHARE = {"email": 260, "phone": 640, "id_number": 560, "en": 300, "de": 140, "fr": 130, "es": 140, "zh": 120, "name": 1_100, "mixed": 420, "none": 2_200}
ANYWHERE = {"org", "famorg", "place", "numcap", "capnum", "denum", "date", "time", "ip", "version", "small", "hash", "lowpair", "atword", "url", "file"}
_SLOT = re.compile(r"\b(?:name|email|phone|id_number|en|de|fr|es)\b|zhname|zh")


def table(scale: float = 1.0, seed: int = 11, given: list[str] = (), family: list[str] = ()) -> list[tuple[str, list[tuple[int, int, str]], bool]]:
    """(text, [(start, end, kind)], plain): SHARE times `scale` sentences; of plain ones every word counts."""
    f, out = Filler(seed, given, family), []
    for group, frames in FRAMES.items():
        heavy = [(1 + len(o.split("|"))) ** 0.5 for o, *_ in frames]
        for n in range(int(SHARE[group] * scale)):
            openings, endings, slots = f.r.choices(frames, heavy)[0] if n >= len(frames) else frames[n]
            slot, text, spans, at = f.r.choice(slots), "", [], 0
            if slot in ANYWHERE and f.r.random() < 0.5:  # what these are doesn't hang on the words around them
                openings, endings, _ = f.r.choice(FRAMES[f.r.choice(["email", "phone", "id_number", "en", "name", "name"])])
            elif f.r.random() < 0.5:  # nor on what follows
                kin = f.r.choice([g for g in FRAMES if g not in ("zh", "mixed")])
                endings = FRAMES[kin][frames.index((openings, endings, slots)) if len(FRAMES[kin]) == len(frames) else 0][1]
            opening = "" if group == "name" and f.r.random() < 0.15 else f.r.choice(openings.split("|"))
            text = opening + ("" if not opening or opening[-1] in "： #" or (opening[-1] > "⺀" and f.r.random() < 0.6) else " ")
            for m in _SLOT.finditer(slot) if group == "mixed" else [re.fullmatch(r".+", slot)]:
                text += slot[at : m.start()]
                value = f.fill(m[0])
                if m[0] in KIND:
                    spans.append((len(text), len(text) + len(value.rstrip(".")), KIND[m[0]]))
                text += value
                at = m.end()
            text += slot[at:] + f.r.choice(endings.split("|"))
            out.append((text.upper() if f.r.random() < 0.04 and len(text.upper()) == len(text) else text, spans, slot == "plain"))
    return out
