"""Labelled texts for the personal-information model, composed by a grammar.

A text is a run of statements. A statement about a person announces a value by a cue word of its kind and language
(``CUES``) in one of a few forms: a field of a form, a table row, a JSON member, a call for contact inside a sentence, a
letter's end. A statement that only looks like one announces a number, address or pair of capitalised words by a cue of
another kind (``OTHER``). All words around are drawn singly from samples of certain language, so no sentence is written
down here; names, streets, numbers and addresses are made up from syllables and formats, so no list of persons or places
is learned. A fifth of the cue words is held out of training, for the test of accuracy.
"""

from __future__ import annotations

import random
import string
import zlib

KINDS = ["O", "email", "phone", "id_number", "street", "name"]

_ON = "b br c d dr el f fr g gr h j k kr l m n or p pr r s st t tr v w y z".split()
_MID = "a e i o u ai ei ia oa au".split()
_CODA = "n r l s m th ck nd rt k".split()
_FIRST_END = "a o el an in e ie us is ar on eth ik".split()
_LAST_END = "er mann son ez es escu ski ov ova ini quist wick field mont ard rander ley aldo oshi sen dt eau".split()
_HOUSE_EN = "Lane Street Road Avenue Row Terrace Crescent Close Drive Court Place Way Boulevard Grove Mews St Rd Ave".split()
_HOUSE_DE = "straße gasse weg allee platz ring damm ufer strasse".split()
_TLD = "com org net example de fr es br cn io test edu invalid".split()
_NUMERALS = "One Two Three Four Five Six Seven Eight Nine Ten Eleven Twelve Thirteen Twenty Thirty Forty Fifty Hundred".split()
#: Frequent Chinese family names.
SURNAMES = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何林罗郑梁谢宋唐许韩冯邓曹彭曾肖田董袁潘于蒋蔡余杜叶程苏魏吕丁任沈姚卢姜崔钟谭陆汪范金石廖贾夏韦付方白邹孟熊秦邱江尹薛阎段雷侯龙史陶黎贺顾毛郝龚邵万钱严覃武戴莫孔向汤"
_GIVEN_HAN = "伟芳娜敏静丽强磊军洋勇艳杰娟涛明超秀霞平刚桂英华玉兰红梅建国志文晓东海燕婷雪慧佳宇浩然子涵梓轩欣怡思远"
_PARTICLES = ["de", "da", "dos", "von", "van", "van der", "de la", "del", "di", "le", "la"]

#: cue words before a value, by kind and language
CUES: dict[str, dict[str, list[str]]] = {
    "name": {
        "en": "name|full name|given name|surname|contact person|sender|recipient|patient|guest|tenant|employee|applicant|teacher|manager|reviewer|participant|client|signatory|witness|author|editor|speaker|passenger|student|buyer|seller|owner|holder|member|driver|nurse|prepared by|written by|sent by|approved by|dear|hi|hello|Mr|Mrs|Ms|Dr|I am|I'm|called|named|with|from|by|to|thank|meet|ask|and|met|saw|phoned".split("|"),
        "de": "Name|Vorname|Nachname|Absender|Empfänger|Patient|Gast|Mieter|Kundin|Kunde|Inhaber|Autorin|Prüfer|Herr|Frau|Hallo|Liebe|Lieber|von|mit|heiße|an|bei|und|traf|durch|ich bin".split("|"),
        "fr": "nom|prénom|patient|locataire|client|cliente|auteur|expéditeur|destinataire|titulaire|Monsieur|Madame|Mme|bonjour|cher|chère|par|avec|de|chez|m'appelle|je suis|et|merci".split("|"),
        "es": "nombre|apellido|paciente|cliente|autor|remitente|titular|inquilina|señor|señora|hola|querido|estimada|por|con|de|llamo|soy|según|y|vi a|gracias".split("|"),
        "pt": "nome|sobrenome|paciente|cliente|autora|remetente|titular|inquilino|senhor|senhora|olá|caro|prezada|por|com|de|chamo|sou|segundo|e|vi|obrigado".split("|"),
        "zh": "姓名|联系人|收件人|寄件人|患者|客户|作者|我叫|我是|名叫|和|给|由|感谢|见了|问|签名".split("|"),
    },
    "phone": {
        "en": "phone|telephone|tel|tel.|mobile|cell|fax|hotline|dial|ring|call|text|number|phone number|line|extension|WhatsApp|reach me|reachable at|landline|pager|helpdesk|switchboard|callback|desk|SMS".split("|"),
        "de": "Telefon|Tel.|Handy|Mobil|Fax|Rufnummer|Nummer|Durchwahl|Festnetz|anrufen unter|erreichbar unter|Hotline|Rückruf".split("|"),
        "fr": "téléphone|tél.|portable|fixe|numéro|appelez|joignable au|fax|mobile|rappel|ligne".split("|"),
        "es": "teléfono|tel.|móvil|celular|fijo|número|llámame|llame al|fax|línea|contacto".split("|"),
        "pt": "telefone|tel.|celular|fixo|número|ligue|ligar para|fax|linha|contato".split("|"),
        "zh": "电话|手机|手机号|座机|传真|热线|致电|拨打|联系电话|号码".split("|"),
    },
    "email": {
        "en": "email|e-mail|mail|write to|send to|inbox|address|reply to|contact|cc|bcc|from|to|at|mailto|account|login|mailbox|forward to|newsletter".split("|"),
        "de": "E-Mail|Mail|schreiben an|Postfach|Adresse|Kontakt|an|Konto|Anfragen".split("|"),
        "fr": "courriel|e-mail|mail|écrire à|adresse|contact|à|compte|boîte".split("|"),
        "es": "correo|e-mail|escribir a|dirección|contacto|a|cuenta|buzón".split("|"),
        "pt": "e-mail|correio|escrever para|endereço|contato|para|conta|caixa".split("|"),
        "zh": "邮箱|电子邮件|邮件|写信到|发送到|联系|地址|账号".split("|"),
    },
    "id_number": {
        "en": "national ID|ID number|ID|passport|passport number|passport no.|SSN|social security|tax number|tax ID|insurance number|licence number|identity card|document number|NI number|taxpayer number|residence permit|health insurance|citizen number|driving licence".split("|"),
        "de": "Ausweis|Ausweisnummer|Personalausweis|Reisepass|Passnummer|Steuernummer|Steuer-ID|Sozialversicherungsnummer|Versicherungsnummer|Führerschein|IdNr.".split("|"),
        "fr": "passeport|carte d'identité|numéro fiscal|sécurité sociale|permis|NIR|numéro de passeport|assurance".split("|"),
        "es": "pasaporte|DNI|NIE|NIF|documento de identidad|seguridad social|número fiscal|permiso|seguro".split("|"),
        "pt": "passaporte|CPF|RG|NIF|documento de identidade|segurança social|número fiscal|carteira|seguro".split("|"),
        "zh": "身份证|身份证号|护照|护照号|社保号|税号|证件号码|驾照".split("|"),
    },
    "street": {
        "en": "address|home address|live at|lives at|located at|visit us at|deliver to|delivered to|send to|moved to|office|ship to|meet at|residence|house|flat at|parcel to|registered at|pick up at|near|billing address|mailing address|stays at|arrived at|went to".split("|"),
        "de": "Adresse|Anschrift|wohne in|wohnt in der|Wohnort|liefern an|Lieferadresse|Büro|umgezogen in|Haus|Treffpunkt|an der".split("|"),
        "fr": "adresse|habite au|domicile|livrer au|livraison|bureau|situé au|rendez-vous au|logé au|chez nous au".split("|"),
        "es": "dirección|vivo en|domicilio|entregar en|envío a|oficina|situado en|casa|mudó a|reside en".split("|"),
        "pt": "endereço|moro na|domicílio|entregar na|envio para|escritório|situado na|casa|mudou para|reside na".split("|"),
        "zh": "地址|住址|住在|家在|送到|寄到|收货地址|办公室|位于".split("|"),
    },
}
#: words behind a person's name
_ACTS = {
    "en": "said|wrote|asked|called|replied|agreed|signed|joined|lives|works|left|told me|moved|phoned|thinks|sent|came|has|had|was|is|will|and I|and|who|answered|explained|noticed|insisted|visited".split("|"),
    "de": "sagte|schrieb|fragte|rief an|meinte|wohnt|arbeitet|kam|hat|ist|war|und ich|erklärte|besuchte".split("|"),
    "fr": "a dit|écrit|demande|répond|habite|travaille|est|était|vient|et moi|a signé|explique".split("|"),
    "es": "dijo|escribió|preguntó|contestó|vive|trabaja|es|estaba|vino|y yo|firmó|explicó".split("|"),
    "pt": "disse|escreveu|perguntou|ligou|mora|trabalha|é|estava|veio|e eu|assinou|explicou".split("|"),
    "zh": "说|写道|问|打来电话|同意|住在|来了|是|认为|回复".split("|"),
}
#: cues of numbers that are nobody's, by language
OTHER = {
    "en": "order|invoice|ticket|build|commit|checksum|serial|ISBN|ISSN|version|port|page|row|rows|batch|shard|seed|offset|epoch|hash|issue|run|step|line|model|part|article|SKU|room|chapter|section|table|figure|lot|tracking|revision|release|item|case|request|score|total|price|amount|count|size|year|date|time|server|host|IP|node|dataset|card|catalogue|package|pinned to|requires|dated|file|split|log|error|record|entry|batch no.|id|key|job|token|tokens|problem".split("|"),
    "de": "Bestellung|Rechnung|Version|Seite|Zeile|Datum|Preis|Auflage|Fehler|Port|Prüfsumme|Lauf|Stand|Artikel".split("|"),
    "fr": "commande|facture|version|page|ligne|date|prix|erreur|port|somme|article|lot".split("|"),
    "es": "pedido|factura|versión|página|fila|fecha|precio|error|puerto|suma|artículo|lote".split("|"),
    "pt": "encomenda|fatura|versão|página|linha|data|preço|erro|porta|soma|artigo|lote".split("|"),
    "zh": "订单|发票|版本|第|日期|价格|端口|错误|校验和|编号|批次".split("|"),
}
_OTHER_FORMS = [
    "00-00-00", "000-000", "0000-000", "0000-0000", "0000-0-00", "00 00 00", "00 00 00 00", "978-0-000-00000-0", "978-0-0000-0000-0", "978-0-000-0000-0", "979-00-000-0000-0", "0-000-0000-0", "0-0000-0000-0", "0000-000X", "2y-00-00", "2y-00-00 00:00", "2y-00-00T00:00:00", "2y/00/00", "00.00.2y", "00/00/2y", "0/0/2y", "10.0.00.00", "192.168.0.00", "10.0.0.000:0000",
    "172.00.0.0:00", "v0.00.0", "0.0.00", "00.0.0", "0.00", "00000", "000000", "0000000", "00000000", "000000000", "#000000", "#00000000000", "#00000000000000", "000000000000", "0000000000000", "0a00b00c", "x00000000", "AAA-000000", "AA-0000", "A00", "$00,000.00", "00,000,000", "000.000.000 B", "00:00:00", "000-000 of 00000", "00000-00000", "0000 - 0000", "0000x0000", "00 of 00", "0.0e-00", "00%", "00, 00 and 00", "[00, 00, 00]",
]
#: nouns and verbs that make a pair of capitalised words a thing
_THING = {
    "en": "model|dataset|corpus|library|release|team|university|festival|station|river|museum|company|archive|album|novel|study|collection|tokenizer|server|cluster|benchmark|checkpoint|suite|toolkit|engine|phone|car|edition|series|project|bank|foundation|system|framework|institute|survey".split("|"),
    "de": "Modell|Datensatz|Korpus|Ausgabe|Museum|Archiv|Verein|Projekt".split("|"),
    "fr": "modèle|corpus|version|musée|archive|projet".split("|"),
    "es": "modelo|corpus|versión|museo|archivo|proyecto".split("|"),
    "pt": "modelo|corpus|versão|museu|arquivo|projeto".split("|"),
    "zh": "模型|数据集|语料|版本|博物馆|项目".split("|"),
}
_THING_ACTS = "outperforms|scores|ships|costs|runs|supports|released|lost to|beats|wins|reaches|ranks|crashed|loads|trained|needs|holds|contains|improves|weighs|sells|has 00|drops|and".split("|")
_ARTICLES = {"en": ["the", "The", "a", "our", "this", "that"], "de": ["der", "die", "das", "Das"], "fr": ["le", "la", "Le"], "es": ["el", "la", "El"], "pt": ["o", "a", "O"], "zh": ["这个", "该"]}
_LINKS = {"en": [" is ", " is still ", " was "], "de": [" ist ", " lautet "], "fr": [" est ", " : "], "es": [" es "], "pt": [" é "], "zh": ["是", "：", "为"]}
_MINE = {"en": ["my", "his", "her", "our", "their", "your", "the"], "de": ["mein", "ihre", "seine", "unsere"], "fr": ["mon", "votre", "sa", "notre"], "es": ["mi", "su", "tu", "nuestra"], "pt": ["meu", "sua", "nossa"], "zh": ["我的", "他的", "你的"]}
_INTRODUCE = {"en": ["i am", "i'm", "name is", "called"], "de": ["ich heiße", "name ist"], "fr": ["je m'appelle"], "es": ["me llamo", "nombre es"], "pt": ["me chamo", "nome é"]}
_CLOSINGS = {"en": ["Regards", "Best", "Sincerely", "Cheers", "Yours", "Thanks"], "de": ["Grüße", "Gruß", "Danke"], "fr": ["Cordialement", "Merci", "Bien à vous"], "es": ["Saludos", "Atentamente", "Gracias"], "pt": ["Abraços", "Atenciosamente", "Obrigada"], "zh": ["此致", "祝好", "谢谢"]}


def held_out(cue: str) -> bool:
    """Whether a cue word is kept out of training."""
    return zlib.crc32(cue.encode()) % 5 == 0


class Maker:
    def __init__(self, seed: int, words: list[str] | None = None) -> None:
        self.r = random.Random(seed)
        self.words = words or ["Market", "Church"]  # streets may be named after anything

    def stem(self, n: int = 1) -> str:
        r = self.r
        return "".join(r.choice(_ON) + r.choice(_MID) + (r.choice(_CODA) if r.random() < 0.4 else "") for _ in range(n))

    def first(self) -> str:
        return (self.stem(self.r.choice((1, 1, 2))) + self.r.choice(_FIRST_END)).capitalize()

    def last(self) -> str:
        one = lambda: (self.stem(1) + self.r.choice(_LAST_END)).capitalize()
        return one() + ("-" + one() if self.r.random() < 0.15 else "")

    def digits(self, n: int) -> str:
        return "".join(self.r.choice(string.digits) for _ in range(n))

    def fill(self, shape: str) -> str:
        r = self.r
        return "".join(r.choice(string.digits) if c == "0" else r.choice(string.ascii_uppercase) if c == "A" else c for c in shape)

    def name(self) -> str:
        r, k = self.r, self.r.random()
        mid = f" {r.choice(string.ascii_uppercase)}." if k < 0.2 else f" {self.first()}" if k < 0.25 else ""
        given, family = self.first(), self.last()
        if r.random() < 0.04:
            family = family.upper()
        if r.random() < 0.06:
            return f"{family}, {given}{mid}"
        if r.random() < 0.05:
            return f"{given} {r.choice(_PARTICLES)} {family}"
        return f"{given}{mid} {family}"

    def han_name(self) -> str:
        return self.r.choice(SURNAMES) + "".join(self.r.choice(_GIVEN_HAN) for _ in range(self.r.choice((1, 2, 2))))

    def email(self) -> str:
        r = self.r
        user = r.choice(
            [self.stem(2), f"{self.stem(2)}.{self.stem(2)}", f"{self.stem(2)}_{self.stem(2)}", f"{self.stem(2)}{self.digits(2)}", f"{self.stem(2)}+{self.stem(1)}", f"{self.stem(1)}.{self.stem(2)}{self.digits(1)}"]
        )
        host = r.choice([self.stem(2), f"mail.{self.stem(2)}", f"{self.stem(1)}-{self.stem(1)}"]) + "." + r.choice(_TLD) + r.choice(["", "", "", ".org", ".net"])
        k = r.random()
        if k < 0.12:
            return f"{user} [at] {host.replace('.', ' [dot] ')}"
        if k < 0.2:
            return f"{user} (at) {host}"
        if k < 0.26:
            return f"{user}(at){host.replace('.', '(dot)')}"
        out = f"{user}@{host}"
        if k < 0.36:
            out = out.upper()
        return out

    def phone(self) -> str:
        return self.fill(
            self.r.choice(
                ["+1 (000) 000-0000", "+44 20 0000 0000", "+49 30 00000 000", "+33 1 00 00 00 00", "+34 000 00 00 00", "+55 11 00000-0000", "+86 000 0000 0000", "000-000-0000", "(000) 000-0000", "000.000.0000", "555.0000 ext. 00", "555-0000 ext. 000", "000-0000 x00",
                 "01 00 00 00 00", "06 00 00 00 00", "00 00 00 00 00", "020 0000 0000", "030/00000-000", "030 0000000", "0000 000000", "+000 00 000 0000", "555-0000", "13000000000", "9 0000-0000", "+1-000-000-0000"]
            )
        )

    def id_number(self) -> str:
        return self.fill(
            self.r.choice(
                ["000-00-0000", "000 00 0000", "000-00-0000", "000 00 0000", "00 000 000 000", "00 000 000 000", "0 00 00 00 000 000", "0 00 00 00 000 000", "0 00 00 00 000 000 00", "00000000A", "00000000A", "AA0000000", "AA0000000", "A00000000", "AA 00 00 00 A", "AA000000A", "000.000.000-00", "00.000.000-0", "00000000000000000A", "000000000000000000", "X0000000A"]
            )
        )

    def street(self) -> str:
        r, n = self.r, str(self.r.randint(1, 240))
        place = (self.stem(1) + r.choice("field berg mill copper moor bridge brunne stedt ville".split())).capitalize()
        if r.random() < 0.35:
            place = r.choice(self.words).capitalize() + (f" {r.choice(self.words).capitalize()}" if r.random() < 0.2 else "")
        k = r.randrange(11)
        if k < 4:
            flat = r.choice(["", "", f", Flat {r.randint(1, 30)}", f", Apt. {r.randint(1, 30)}"])
            return f"{n}{r.choice(['', '', 'A', 'B', 'C'])} {place} {r.choice(_HOUSE_EN)}{flat}"
        if k < 6:
            town = r.choice(["", f", {self.digits(5)} {self.stem(2).capitalize()}"])
            return f"{(self.stem(1) + r.choice(['en', 'el', ''])).capitalize()}{r.choice(_HOUSE_DE)} {n}{town}"
        if k < 8:
            kind, of = r.choice(["rue", "avenue", "boulevard", "chemin", "impasse"]), r.choice(["des", "du", "de la", "de l'"])
            tail = f"{kind} {of} {place}".replace("' ", "'")
            return r.choice([f"{n}, {tail}", f"{n} bis {tail}", f"{n} {tail}"]) + r.choice(["", f", {self.digits(5)} {self.stem(2).capitalize()}"])
        if k < 9:
            return f"{r.choice(['Calle', 'Avenida', 'Plaza', 'Paseo', 'calle'])} {r.choice(['de la', 'del', 'de los', 'Mayor'])} {place} {n}{r.choice(['', ', 2º B', ', 3º A', ', piso 4'])}"
        if k < 10:
            return f"{r.choice(['Rua', 'Avenida', 'Travessa', 'Praça', 'rua'])} {r.choice(['das', 'do', 'dos', 'da'])} {place}, {n}"
        return f"{r.choice('中北南东西春长和')}{r.choice('山京海风阳安')}{r.choice(['路', '街', '大道', '巷'])}{n}号"

    def product(self) -> str:
        a = self.stem(self.r.choice((1, 2))).capitalize() if self.r.random() < 0.6 else self.r.choice(self.words).capitalize()
        b = self.r.choice([self.stem(2).capitalize(), self.r.choice(_NUMERALS), self.r.choice(_NUMERALS[13:17]) + self.r.choice(_NUMERALS[:9]).lower(), self.r.choice("Mini Large Pro Base Ultra Small Plus Max Lite".split())])
        return f"{a} {b}"

    def other_number(self) -> str:
        out = "".join(self.r.choice(string.digits) if c == "0" else c for c in self.r.choice(_OTHER_FORMS).replace("2y", "\x03"))
        return self.fill(out.replace("\x03", f"20{self.r.randint(10, 29)}").replace("AAA", "QRX").replace("AA", "KV"))

    def handle(self) -> str:
        """What holds an at sign and is no address."""
        r, w = self.r, self.stem(2)
        return r.choice([f"@{w}", f"@{self.stem(1)}.{self.stem(1)}", f"@{w}_{self.stem(1)}", f"git@{self.stem(1)}:{w}/{self.stem(1)}.git", f"git@{w}:{self.stem(1)}/{self.stem(1)}{self.digits(2)}.git", f"{w}@{self.fill('0.0.00')}", f"{w}-{self.stem(1)}@{self.fill('00.00.0')}", f"{w}-{self.stem(1)}@{self.fill('0.00')}", f"root@{self.fill('10.0.0.00')}", f"{self.stem(1)}@{w}:/{self.stem(1)}/{self.stem(2)}"])

    def mask(self) -> str:
        r = self.r
        k = r.choice("EMAIL PHONE NAME ADDRESS ID PERSON ID_NUMBER STREET SSN URL".split())
        return r.choice(["[{}]", "<{}>", "[{}_{}]", "<{}_{}>"]).format(k, r.randint(0, 99))


def documents(samples: list[str], n: int, seed: int = 11, unseen: bool = False) -> list[list[tuple[str, str]]]:
    """n texts, each a list of (piece, kind) with kind O for all that is no personal data.

    unseen: values are announced by the held-out cue words only, otherwise never by them.
    """
    m = Maker(seed, sorted({w for t in samples for w in t.split() if w.isalpha() and len(w) > 3 and w.isascii()}))
    r = m.r
    plain = [w for t in samples for w in t.split() if not any("㐀" <= c <= "鿿" for c in w)] or ["word"]
    han = [t[i : i + 2] for t in samples for i in range(0, len(t), 2) if all("㐀" <= c <= "鿿" for c in t[i : i + 2])] or ["词语"]
    cues = {k: {g: [c for c in cs if held_out(c) == unseen] or cs for g, cs in by.items()} for k, by in CUES.items()}
    make = {"name": m.name, "phone": m.phone, "email": m.email, "id_number": m.id_number, "street": m.street}

    def filler(lang: str, low: int, high: int) -> str:
        k = r.randint(low, high)
        if lang == "zh":
            return "".join(r.choice(han) for _ in range(k))
        out = []
        while len(out) < k:  # single words and pairs as they stand
            i = r.randrange(len(plain))
            out += plain[i : i + r.choice((1, 1, 2))]
        return " ".join(w.strip(".,;:!?…").lower() for w in out[:k])

    def upper(t: str) -> str:
        return t[:1].upper() + t[1:]

    def key(cue: str) -> str:
        return r.choice(["{}", "{}_" + m.stem(1), m.stem(1) + "_{}"]).format(cue.replace(" ", "_").replace(".", "").lower())

    def around(cue: str, lang: str) -> tuple[str, str]:
        """What stands before and behind a value that a cue announces."""
        blank, x = "" if lang == "zh" else " ", r.random()
        if x < 0.22:  # field of a form
            return f"{r.choice(['', '', '- ', '* ', '• '])}{upper(cue)}{r.choice([': ', ': ', ' = ', ' - ', chr(9), '：'])}", r.choice(["", "", ";", ".", ", " + filler(lang, 1, 3)])
        if x < 0.32:
            return f"{filler(lang, 0, 2)} | {cue} | ".lstrip(), f" | {filler(lang, 0, 2)}"
        if x < 0.42:
            return f'{{"{m.stem(2)}": {m.digits(2)}, "{key(cue)}": "' if r.random() < 0.5 else f'{{"{key(cue)}": "', r.choice(['"}', f'", "{m.stem(2)}": {m.digits(1)}}}', f'", "{m.stem(2)}": true}}'])
        if x < 0.62:  # whose it is
            first = upper(r.choice(_MINE[lang])) if r.random() < 0.5 else filler(lang, 0, 3) + blank + r.choice(_MINE[lang])
            return f"{first}{blank}{cue}{r.choice(_LINKS[lang])}".lstrip(), r.choice([".", ".", ",", "", blank + filler(lang, 1, 4) + "."])
        if x < 0.72:
            return f"{upper(filler(lang, 1, 4))} ({cue} ", f"){blank}{filler(lang, 0, 3)}."
        return f"{upper(filler(lang, 0, 4)) + blank if r.random() < 0.8 else ''}{cue}{blank}".lstrip(), r.choice([".", ".", ",", "", "?", blank + filler(lang, 1, 5) + ".", ", " + filler(lang, 1, 3) + "."])

    def personal(lang: str, person: str) -> list[tuple[str, str]]:
        kind = r.choice(KINDS[1:])
        if kind == "name" and lang == "zh" and r.random() < 0.6:
            value = m.han_name()
        elif kind == "name":
            value = person if r.random() < 0.5 else m.name()
        else:
            value = make[kind]()
        blank, x = "" if lang == "zh" else " ", r.random()
        if kind == "name" and x < 0.3 and not unseen:
            return [(upper(filler(lang, 1, 3)) + blank if r.random() < 0.4 else "", "O"), (value, kind), (f"{blank}{r.choice(_ACTS[lang])}{blank}{filler(lang, 0, 4)}.", "O")]
        if kind == "name" and x < 0.36 and not unseen:
            return [(r.choice(_CLOSINGS[lang]) + r.choice([",\n", "\n", ", "]), "O"), (value, kind)]
        if kind == "name" and x < 0.42 and not unseen:
            return [(upper(r.choice(cues[kind][lang])) + r.choice([": ", " "]) + filler(lang, 0, 1), "O"), (value, kind), (r.choice([", ", " & ", " / "]), "O"), (m.name(), kind), ("." if r.random() < 0.5 else blank + filler(lang, 1, 3), "O")]
        if kind == "name" and x < 0.52 and lang != "zh" and not unseen:
            return [(r.choice(["", "hi ", r.choice(_MINE[lang]) + " ", filler(lang, 1, 2) + " "]) + r.choice(_INTRODUCE[lang]) + " ", "O"), (f"{m.first()} {m.last()}".lower(), kind), (r.choice(["", ".", ", ", " and "]) + filler(lang, 0, 3), "O")]
        if x > 0.93 and (kind != "name" or value[:1].isupper()):
            return [(value, kind)]  # alone
        if kind == "email" and x < 0.15:
            return [(filler(lang, 0, 4) + blank + r.choice(["<", "mailto:", "(", "“", "<mailto:"]), "O"), (value, kind), (r.choice([">", "", ")", "”", ">."]), "O")]
        before, behind = around(r.choice(cues[kind][lang]), lang)
        if kind == "name" and lang == "zh" and "㐀" <= value[0] <= "鿿":
            cue = r.choice(cues[kind][lang])
            before, behind = r.choice([upper(filler(lang, 0, 3)), "", "，"]) + cue + r.choice(["", "", "：", "是"] if cue not in ("我叫", "我是", "名叫") else [""]), r.choice(["。", "，", "先生", "女士", "老师", " ", "\n"]) + filler(lang, 0, 3)
            if r.random() < 0.3:  # a title alone
                before, behind = filler(lang, 1, 3), r.choice(["先生", "女士", "老师", "医生"]) + r.choice(["。", "，" + filler(lang, 1, 2), filler(lang, 1, 3)])
        return [(before, "O"), (value, kind), (behind, "O")]

    def impersonal(lang: str) -> str:
        x = r.random()
        blank = "" if lang == "zh" else " "
        if x < 0.45:
            before, behind = around(r.choice(OTHER[lang if r.random() < 0.5 else "en"]), lang)
            return before + m.other_number() + behind
        if x < 0.6:
            thing = r.choice(_THING[lang])
            p = m.product() if r.random() < 0.6 else f"{(m.stem(1) + r.choice('mill field moor bridge ville berg'.split())).capitalize()} {r.choice(_HOUSE_EN)}"
            return f"{upper(filler(lang, 0, 3)) + blank if r.random() < 0.5 else ''}{r.choice(_ARTICLES[lang])}{blank}{p}{blank}{thing}{blank}{filler(lang, 0, 4)}" + r.choice([".", "", f" {m.digits(2)}."])
        if x < 0.72:
            verb = "".join(r.choice(string.digits) if c == "0" else c for c in r.choice(_THING_ACTS))
            tail = m.product() if r.random() < 0.4 else filler(lang, 1, 4)
            return f"{upper(filler(lang, 0, 2)) + ' ' if r.random() < 0.3 else ''}{m.product()} {verb} {tail} {r.choice(['', m.digits(2), filler(lang, 1, 3)])}".rstrip() + r.choice([".", ""])
        if x < 0.84:
            return f"{upper(filler(lang, 0, 4))} {m.handle()} {filler(lang, 0, 4)}".strip() + r.choice([".", "", "\n"]) if r.random() < 0.8 else f"({m.handle()})"
        if x < 0.92:
            before, behind = around(r.choice(cues[r.choice(KINDS[1:])][lang]), lang)
            return before + m.mask() + behind
        before, behind = around(r.choice(cues[r.choice(KINDS[1:])][lang]), lang)
        return before + filler(lang, 1, 2) + behind  # announced, but not given

    langs = list(CUES["name"])
    out = []
    for _ in range(n):
        pieces: list[tuple[str, str]] = []
        person, lang = m.name(), r.choice(langs + ["en"] * 3)
        for k in range(r.randint(1, 5)):
            if k:
                pieces.append((r.choice(["\n", " ", " ", "\n\n", "\n- "]), "O"))
            x = r.random()
            if x < 0.42:
                pieces += personal(lang, person)
            elif x < 0.76 or not samples:
                pieces.append((impersonal(lang), "O"))
            else:
                pieces.append((r.choice(samples), "O"))
        out.append([p for p in pieces if p[0]])
    return out
