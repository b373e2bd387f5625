"""Labelled text for the training of the personal-data tagger: invented spans of many forms, and the marked spans of sample documents.

Names, streets, towns and domains are drawn from common words of several languages and from made-up words, numbers at random in the
forms that countries write them in, so that what is learnt is the form and the surroundings. ``held`` forms and names are for tests
alone. Nothing here runs when documents are tagged.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Callable

from fablespark.llm.pii_model import KINDS

Span = tuple[int, int, int]

# --- Fixed values: common words and forms ------------------------------------------------------------------------------------

GIVEN = "James Mary John Patricia Robert Linda Michael Barbara David Elizabeth William Susan Thomas Karen Daniel Nancy Matthew Anna Peter Maria Hans Ursula Klaus Sabine Jean Marie Pierre Claire Luc Giulia Marco Francesca Carlos Lucía Javier Carmen João Beatriz Rajesh Priya Amit Sunita Arjun Mohammed Fatima Omar Aisha Yusuf Leila Wei Mei Hiroshi Yuki Olga Ivan Tatiana Sergei Katarzyna Piotr Jana Lars Ingrid Sven Aino Chinedu Ngozi Kwame Amara Siobhan Liam Eoin Moira Nikos Eleni Zoltán Ágnes Mehmet Ayşe".split()
FAMILY = "Smith Johnson Williams Brown Jones Miller Davis Wilson Anderson Taylor Moore Jackson Martin Thompson Garcia Martinez Lopez Müller Schmidt Schneider Fischer Weber Becker Hoffmann Dubois Durand Lefebvre Moreau Rossi Bianchi Ferrari Romano Fernández Sánchez Silva Santos Oliveira Kumar Sharma Patel Singh Gupta Khan Hussain Ahmed Hassan Chen Wang Zhang Tanaka Suzuki Sato Ivanov Petrov Kowalski Nowak Novák Hansen Larsen Johansson Virtanen Okafor Adeyemi Mensah Murphy O'Brien Kelly MacDonald Campbell Papadopoulos Nagy Szabó Yılmaz Kaya Holloway Ashworth Whitaker Lindgren Castellano".split()
PARTICLES = ["van der", "de", "von", "van", "de la", "al-", "Mac", "O'", "di", "Le"]
TITLES = ["Mr.", "Mrs.", "Ms.", "Dr.", "Prof.", "Herr", "Frau", "Mme", "M.", "Señora", "Sr.", "Signora", "Miss", "Sir", "Rev."]
TOWN = "Springfield Oxford Leeds Bristol Dublin Boston Denver Portland Austin Madison Berlin Hamburg Köln Lyon Nantes Lille Madrid Sevilla Roma Milano Lisboa Porto Utrecht Gent Wien Graz Zürich Oslo Bergen Malmö Helsinki Gdańsk Brno Mumbai Pune Lagos Accra Sydney Perth Toronto Ottawa".split()
STREET = "Street St St. Avenue Ave Ave. Road Rd Rd. Lane Ln Ln. Drive Dr Court Ct Ct. Terrace Place Close Row Way Hill Yard Boulevard Blvd Crescent Walk Square Quay Gardens Mews".split()
STATES = "AL AZ CA CO FL GA IL MA MI NY OH OR PA TX VA WA".split()
DOMAINS = "com org net edu io co.uk org.uk de fr es it nl ch se no pl ru in jp com.au ca ie example invalid test eu info".split()
HAN_FAMILY, HAN_GIVEN = "王李张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗", "伟芳娜敏静丽强磊军洋勇艳杰娟涛明超秀霞平刚桂英华"
KANA_FAMILY, KANA_GIVEN = "佐藤 鈴木 高橋 田中 渡辺 伊藤 山本 中村 小林 加藤 吉田 山田".split(), "翔 蓮 陽菜 結衣 健太 美咲 さくら 太郎 花子 直樹 大輔 恵子".split()
RUS_GIVEN, RUS_FAMILY = "Иван Пётр Алексей Дмитрий Ольга Елена Наталья Мария Сергей Анна".split(), "Иванов Петров Соколов Кузнецов Волкова Морозова Лебедев Новикова Орлов Белова".split()
DIGIT_WORDS = "zero one two three four five six seven eight nine".split()

#: # a digit, @ a capital letter, % a small one; forms of ``HELD`` are left out of the training.
PHONES = ["+44 #### ######", "+44 20 #### ####", "0044 20 #### ####", "0044 #### ######", "0#### ######", "0#### ### ###", "020 #### ####", "+1 ### ### ####", "+1-###-###-####", "(###) ###-####", "###-###-####", "###.###.####", "1-###-###-####", "1.###.###.####", "##########", "+49 ## ##### ###", "+49 ### #######", "(0##) ##### ###", "0##/#####-###", "0### #######", "+33 # ## ## ## ##", "0# ## ## ## ##", "0#.##.##.##.##", "### ### ###", "###-###-###", "+34 ### ### ###", "+7 (###) ###-##-##", "8 (###) ###-##-##", "8 ### ### ## ##", "8 ### ###-##-##", "+91 ##### #####", "+86 ### #### ####", "###-####-####", "+81 # #### ####", "0#-####-####", "+39 ## #### ####", "+31 # ########", "+353 ## ### ####", "+61 # #### ####"]
IDS = ["@########", "@@ ## ## ## @", "@@######@", "@@ ######@", "########-@", "########@", "###-##-####", "### ## ####", "#-####-#####-##", "## ### ### ###", "# ## ## ## ### ### ##", "@@@@@@##@##@###@", "###.###.###-##", "#### #### ####", "######-####", "##################", "@@#######", "@#######@", "##.##.##-###.##"]
HELD = {"phone": ["+46 ## ### ## ##", "+1 (###) ###-####", "0### ### ####", "+48 ### ### ###"], "id_number": ["@@@######", "##-#######", "#########@", "### ### ###-##"]}
#: Numbers, names and addresses that are nobody's.
OTHERS = ["order no. ######", "order ##-######", "ISBN 978-#-##-######-#", "ISBN ###-#-###-#####-#", "pp. ###-###", "page ###", "line ###.##", "shelf mark @@ ###.#", "ref. ####-###", "vol. ##, no. #", "chapter ##", "at ##:##", "£##.##", "$###.##", "#### copies", "####-##-##", "##.##.####", "version #.#.##", "lot ######", "ticket @@-####", "invoice ########", "batch ####-##", "tracking ####-####-####", "catalogue no. #######", "room ###", "folio ##", "a fine of ## marks", "##°##'N", "call number ###.## @@@"]
PLACES = "New York|Castle Street|the Old Mill|Northern Ireland|the River Thames|Hyde Park|Great Expectations|Pride and Prejudice|Monday|the Reading Room|Cambridge University Press|South Gate|Lake Geneva|the British Library|North Sea|Silver Dragon|Christmas Eve|Marsh Gate|the Red Lion|Mount Etna|White House|Saint Lucia|Green Valley|Holy Trinity Church|Round Table".split("|")

CARRIERS: dict[str, list[str]] = {
    "person": ["My name is {}.", "My name is {} and I wrote last year.", "I am {} from the club.", "Dear {},", "Yours sincerely, {}", "Best wishes,\n{}", "Kind regards,\n{}", "Signed: {}", "From: {}", "To: {}", "cc: {}", "Contact {} for details.", "Please ask {} about it.", "I spoke to {} at the desk.", "{} wrote to us again.", "{} asked for a refund.", "It was {} who first noticed.", "Thanks to {} for the proofs.", "This is {} speaking.", "Our reader {} has moved.", "Proofread by {} and others.", "Letter from {}, received today.", "{} lives near the station.", "Met with {} and {} on Tuesday.", "{t} {} will reply.", "I gave my copy to {t} {}.", "Attn: {t} {}", "Mein Name ist {}.", "Mit freundlichen Grüßen, {}", "Je m'appelle {}.", "Cordialement, {}", "Me llamo {}.", "Un saludo, {}", "Mi chiamo {}.", "Customer: {}", "Patient: {}", "Interviewed {} in March.", "Sincerely,\n{}", "{} (editor)", "Reach out to {} or {}.", "the form of {} is missing", "the late {} left us the letters.", "our colleague {} in accounts", "{}, here, first post.", "Written by {}", "Forwarded by {}"],
    "email": ["Write to me at {}.", "Write to {} if it turns up.", "Email: {}", "E-mail {} for a copy.", "my mail is {}", "Reply to <{}>.", "(mailto:{})", "Contact: {}", "{} is my address.", "Send corrections to {}; we read everything.", "You can reach me at {} any time.", "From: <{}>", "Schreiben Sie an {}.", "Écrivez à {}.", "Escríbame a {}.", "cc {} please", "{}", "or by mail ({})"],
    "phone": ["Call me on {}.", "Tel. {}", "Phone: {}", "You can ring me on {} after six.", "text me {} about it", "Mobile {}.", "My number is {}.", "Fax {}", "Call {} and let it ring.", "Rufen Sie {} an.", "Téléphone : {}", "Llámame al {}.", "Телефон {}.", "電話 {}", "请打 {}。", "or call {} before noon", "{} (evenings)", "T: {}", "my phone is {}, leave a message"],
    "id_number": ["My passport number is {}.", "passport {}", "SSN: {}", "Social security number {}.", "my SSN is {}", "National insurance {} for the form.", "Tax ID {}", "The tax office knows me as {}.", "Ausweisnummer {}.", "DNI {}", "Numéro de sécurité sociale {}.", "For the permit my identity number is {}.", "They wanted {} again, so here it is.", "ID card no. {}", "driving licence {}", "codice fiscale {}", "CPF {}", "Aadhaar {}", "Identity number: {}", "residence permit {}", "паспорт {}", "身份证 {}", "health insurance number {}", "NI no. {}"],
    "address": ["I live at {}.", "Ship to: {}", "Please post it to {}.", "My address is {}.", "Return address: {}", "Send it to {} before Friday.", "Deliver the crate to {} before noon.", "We moved to {} last year.", "Address:\n{}", "We meet on Tuesdays at {}.", "Ich wohne {}.", "Bitte senden an {}.", "J'habite {}.", "Envoyez le livre au {}.", "Vivo en {}.", "Мой адрес: {}.", "住所は{}です。", "地址：{}。", "visit us at {}", "{}"],
    "": ["The {o} was wrong.", "See {o} for more.", "We read {p} again.", "I walked past {p} on the way home.", "{o}", "The party reached {p} by night.", "Please quote {o}.", "Nobody at {p} had heard of it.", "It cost {o}, she said.", "{p} is my favourite.", "Page {d}, line {d}.", "In {p}, nothing had changed since {d}.", "The captain looked at {p}.", "Our shop sells {o}."],
}
#: Several kinds in one: P person, E email, T phone, I id_number, A address.
COMBINED = ["Please email {P} at {E} or call {T}.", "{P} ({E}) asked us to ship to {A}.", "{P}, {A}, tel. {T}", "Contact {P}, {A}, {E}.", "My name is {P} and I live at {A}.", "{P}\n{A}\n{T}", "{P} <{E}>", "From: {P} <{E}>", "{P}, {T}", "Her SSN is {I} and his passport number is {I}.", "I am {P}, passport {I}, and my number is {T}.", "Deliver to {P}, {A}.", "{P} of {A} paid in full.", "Ring {P} on {T} before noon.", "mail {E} or phone {T}", "We met {P} at the fair; {P} was there too.", "{P} and {P} were married in June.", "Yesterday {P} called about {o}.", "The parcel for {P} went to {A}, {o}.", "Ask {P} or write to {E}, please.", "{P} said that {P} had lost {o}.", "{t} {P}, {A}, born 1970, ID {I}", "for {P} (ID {I})", "I think {P} still lives at {A} with the dog."]
OWN_CARRIERS = {"han": ["我叫{}。", "此致，{}", "联系人：{}", "{}先生您好"], "kana": ["{}と申します", "敬具　{}", "{}様"], "rus": ["Меня зовут {}.", "С уважением, {}", "Пишет вам {}."]}


def made_up(rng: random.Random) -> str:
    """A word that may be a name."""
    onset = ["b", "br", "c", "ch", "d", "dr", "f", "g", "gr", "h", "j", "k", "l", "m", "n", "p", "pr", "qu", "r", "s", "sch", "st", "t", "th", "v", "w", "y", "z", "", "kr", "bl"]
    word = "".join(rng.choice(onset) + rng.choice(("a", "e", "i", "o", "u", "y", "ou", "ie", "ea", "á", "ö")[: 9 if rng.random() < 0.9 else 11]) + rng.choice(("", "", "n", "r", "l", "s", "m", "ck", "tt", "nd", "rt")) for _ in range(rng.choice((1, 2, 2, 3))))
    return word.capitalize() if len(word) > 2 else word.capitalize() + "lan"


def filled(form: str, rng: random.Random) -> str:
    """A form with its digits and letters drawn."""
    return re.sub("[#@%]", lambda m: rng.choice({"#": "0123456789", "@": "ABCDEFGHJKLMNPQRSTUVWXYZ", "%": "abcdefghijklmnopqrstuvwxyz"}[m.group()]), form)


class Inventor:
    """Makes spans; with ``held`` from names and forms that the training never has."""

    def __init__(self, rng: random.Random, held: bool = False):
        self.rng, self.held = rng, held

    def _word(self, listed: list[str]) -> str:
        """A listed or made-up word: the last tenth of a list is held back."""
        cut = len(listed) * 9 // 10
        part = listed[cut:] if self.held else listed[:cut]
        return self.rng.choice(part) if self.rng.random() < 0.5 else made_up(self.rng)

    def person(self) -> str:
        rng = self.rng
        given, family = self._word(GIVEN), self._word(FAMILY)
        if rng.random() < 0.06:
            family = f"{rng.choice(PARTICLES)} {family}".replace("' ", "'").replace("- ", "-").replace("Mac ", "Mac")
        elif rng.random() < 0.06:
            family = f"{family}-{self._word(FAMILY)}"
        middle = f"{rng.choice('ABCDEFGHJKLMPRSTW')}. " if rng.random() < 0.12 else f"{self._word(GIVEN)} " if rng.random() < 0.04 else ""
        name = f"{given} {middle}{family}"
        shape = rng.random()
        if shape < 0.12:
            name = f"{given[0]}. {middle if middle.endswith('. ') else ''}{family}"
        elif shape < 0.2:
            name = f"{family}, {given if rng.random() < 0.7 else given[0] + '.'}"
        elif shape < 0.24:
            name += rng.choice((" Jr.", " Sr.", " III"))
        return name.upper() if shape > 0.96 else name.lower() if shape > 0.93 else name

    def native(self, script: str) -> str:
        rng = self.rng
        if script == "han":
            return rng.choice(HAN_FAMILY) + "".join(rng.sample(HAN_GIVEN, rng.choice((1, 2, 2))))
        if script == "kana":
            return rng.choice(KANA_FAMILY) + rng.choice(("", " ", "　")) + rng.choice(KANA_GIVEN)
        return f"{rng.choice(RUS_GIVEN)} {rng.choice(RUS_FAMILY)}"

    def email(self) -> str:
        rng = self.rng
        plain = lambda w: re.sub("[^a-z]", "", w.lower()) or "info"
        given, family = plain(self._word(GIVEN)), plain(self._word(FAMILY))
        local = rng.choice((f"{given}.{family}", f"{given[0]}{family}", f"{given}_{family}{rng.randrange(100)}", f"{family}+{plain(made_up(rng))}", f"{given}{rng.randrange(10000)}", f"the-{family}s", family, f"{given}-{family}", f"{given[0]}.{family}"))
        host = rng.choice((plain(made_up(rng)), f"{plain(made_up(rng))}-{plain(made_up(rng))}", f"mail.{plain(made_up(rng))}", "gmail", "outlook", f"uni-{plain(self._word(TOWN))}", plain(self._word(TOWN))))
        end = rng.choice(DOMAINS[-3:] if self.held else DOMAINS)
        mark, dot = rng.choice((("@", "."),) * 10 + ((" @ ", "."), ("＠", "."), (" at ", " dot "), (" [at] ", " [dot] "), ("(at)", "."), (" (at) ", " (dot) ")))
        whole = f"{local}{mark}{host.replace('.', dot)}{dot}{end.replace('.', dot)}"
        return whole.upper() if rng.random() < 0.05 else whole

    def phone(self) -> str:
        rng = self.rng
        if not self.held and rng.random() < 0.04:
            return " ".join(rng.choice(DIGIT_WORDS) for _ in range(rng.choice((7, 7, 10))))
        text = filled(rng.choice(HELD["phone"] if self.held else PHONES), rng)
        if rng.random() < 0.08:
            text += filled(rng.choice((" ext. ###", " x##", " ext ##", " ext. ##")), rng)
        if not self.held and rng.random() < 0.03:
            text = text.translate(str.maketrans("0123456789-", "０１２３４５６７８９－"))
        return text

    def id_number(self) -> str:
        return filled(self.rng.choice(HELD["id_number"] if self.held else IDS), self.rng)

    def address(self) -> str:
        rng = self.rng
        number = f"{rng.randrange(1, 400)}{rng.choice(('', '', '', '', 'a', 'b', ' bis'))}"
        name = " ".join(self._word(FAMILY) for _ in range(rng.choice((1, 1, 2))))
        town = self._word(TOWN) + (f" {made_up(rng)}" if rng.random() < 0.25 else "")
        comma = rng.choice((", ", ", ", ", ", "\n", " "))
        if self.held:
            return rng.choice((lambda: f"Apt {rng.randrange(1, 99)}, {number} {name} {rng.choice(STREET)}, {town}", lambda: f"{number} {name} {rng.choice(STREET)}, {town} {filled('@## @@##', rng)}", lambda: f"{name}vej {rng.randrange(1, 99)}, {filled('####', rng)} {town}"))()
        us, uk, five = f"{rng.choice(STATES)} {filled('#####', rng)}", filled(rng.choice(("@@# #@@", "@@## #@@", "@# #@@", "@@#@ #@@")), rng), filled("#####", rng)
        head = f"{number} {name} {rng.choice(STREET)}"
        flat = rng.choice((f"Flat {rng.randrange(1, 40)}, ", f"Unit {rng.randrange(1, 9)}/", f"Apt. {rng.randrange(1, 60)}, ", f"Suite {rng.randrange(100, 900)}, ")) if rng.random() < 0.15 else ""
        text = rng.choice((
            lambda: f"{flat}{head}{comma}{town}",
            lambda: f"{flat}{head}, {town}, {us}",
            lambda: f"{flat}{head}\n{town}, {us}",
            lambda: f"{flat}{head}{comma}{town}{rng.choice((' ', ', ', chr(10)))}{uk}",
            lambda: f"{flat}{head}, {town} {five}",
            lambda: f"PO Box {rng.randrange(1, 9999)}, {town}{rng.choice(('', ' ' + five, ' ' + uk))}",
            lambda: f"{name}{rng.choice(('straße', 'gasse', 'weg', 'str.', 'allee', 'platz', 'ring', 'stieg'))} {number}, {five} {town}",
            lambda: f"{number}, {rng.choice(('rue', 'avenue', 'place', 'quai', 'impasse', 'allée', 'chemin', 'boulevard'))} {rng.choice(('de ', 'du ', 'des ', '', 'de la '))}{name}, {five} {town}",
            lambda: f"{rng.choice(('Calle', 'Plaza', 'Avda.', 'C/', 'Camino', 'Paseo'))} {name} {rng.randrange(1, 200)}{rng.choice(('', f', {rng.randrange(1, 9)}.º {rng.choice(chr(65) + chr(66) + chr(67))}'))}, {five} {town}",
            lambda: f"{rng.choice(('Via', 'Piazza', 'Corso'))} {name} {rng.randrange(1, 200)}, {five} {town}",
            lambda: f"{name}{rng.choice(('gracht', 'straat', 'laan'))} {rng.randrange(1, 300)}, {filled('#### @@', rng)} {town}",
            lambda: f"г. {rng.choice(RUS_FAMILY)[:-2]}ск, ул. {rng.choice(RUS_FAMILY)}а, д. {rng.randrange(1, 99)}, кв. {rng.randrange(1, 200)}",
            lambda: f"〒{filled('###-####', rng)} {rng.choice(KANA_FAMILY)}市{rng.choice(KANA_FAMILY)}町{rng.randrange(1, 9)}-{rng.randrange(1, 30)}-{rng.randrange(1, 20)}",
            lambda: f"{rng.choice(HAN_GIVEN)}{rng.choice(HAN_GIVEN)}市{rng.choice(HAN_GIVEN)}{rng.choice(HAN_FAMILY)}区{rng.choice(HAN_GIVEN)}{rng.choice(HAN_GIVEN)}路{rng.randrange(1, 300)}号",
        ))()
        return text.upper() if rng.random() < 0.04 else text.lower() if rng.random() < 0.02 else text

    def of_kind(self, kind: str) -> str:
        return getattr(self, kind)()

    def sentence(self, kind: str | None = None) -> tuple[str, list[Span]]:
        """A sentence with its spans; of no kind, one without any."""
        rng = self.rng
        slots = dict(zip("PETIA", KINDS))
        if kind is None and rng.random() < 0.3:
            carrier = rng.choice(COMBINED)
        else:
            kind = rng.choice((*KINDS, "person", "")) if kind is None else kind
            carrier = rng.choice(CARRIERS[kind])
        native = None
        if kind == "person" and not self.held and rng.random() < 0.12:
            native = rng.choice(tuple(OWN_CARRIERS))
            carrier = rng.choice(OWN_CARRIERS[native])
        out, spans = "", []
        for part in re.split(r"(\{\w?\})", carrier):
            of = kind if part == "{}" else slots.get(part[1:2]) if part[:1] == "{" else None
            if of:
                piece = self.native(native) if native else self.of_kind(of)
                spans.append((len(out), len(out) + len(piece), KINDS.index(of)))
            elif part == "{t}":
                piece = rng.choice(TITLES)
            elif part == "{o}":
                piece = filled(rng.choice(OTHERS), rng)
            elif part == "{p}":
                piece = rng.choice(PLACES)
            elif part == "{d}":
                piece = str(rng.randrange(1, 2000))
            else:
                piece = part
            out += piece
        return out, spans

    def passage(self, filler: Callable[[], str]) -> tuple[str, list[Span]]:
        """Some sentences with spans between sentences of the filler."""
        out, spans = "", []
        for _ in range(self.rng.randrange(2, 7)):
            if self.rng.random() < 0.4:
                piece, own = filler(), []
            else:
                piece, own = self.sentence()
                if self.rng.random() < 0.25:  # what follows may come without a mark between
                    piece = piece.rstrip(".。")
                    own = [(a, min(b, len(piece)), k) for a, b, k in own]
            spans += [(len(out) + a, len(out) + b, k) for a, b, k in own]
            out += piece + self.rng.choice((" ", " ", " ", "\n"))
        return out, spans


# --- Marked spans of sample documents ----------------------------------------------------------------------------------------

_WORD = r"[A-Z][\w'’]+(?:-[A-Z][\w'’]+)*"
_ADDRESS_STREET = rf"(?:[\w.'’-]+ ){{1,3}}(?:{'|'.join(sorted((re.escape(s) for s in STREET), key=len, reverse=True))})"
POSTCODE = r"(?:[A-Z]{2}\d \d[A-Z]{2}|\d{5})"
MARKED = {
    "email": r"(?<![\w.+-])[\w.+-]+(?:(?: ?[@＠] ?| ?[(\[]at[)\]] ?)(?:[\w-]+(?:\.| ?[(\[]dot[)\]] ?| dot ))+| at (?:[\w-]+ dot )+)[\w-]*[A-Za-z0-9]",
    "phone": r"(?<![A-Za-z0-9+-])(?<!\d )(?:(?:\+44 \d{4} \d{6}|(?:\+|00)44 20 \d{4} \d{4}|0044 \d{4} \d{6}|07\d{3} \d{3} ?\d{3}|020 \d{4} \d{4}|\+1[ -]\d{3}[ -]\d{3}[ -]\d{4}|\(\d{3}\) \d{3}-\d{4}|1?[-.]?\d{3}([.-])\d{3}\1\d{4}|2\d{9}|\+49 \d\d \d{5} \d{3}|\(0\d\d\) \d{5} \d{3}|0\d\d/\d{5}-\d{3}|\+33 \d(?: \d\d){4}|0\d(?:[. ]\d\d){4}|\d{3}([ -])\d{3}\2\d{3}|\+34 \d{3} \d{3} \d{3}|\+7 \(\d{3}\) \d{3}-\d\d-\d\d|8 \(?\d{3}\)? \d{3}[ -]\d\d[ -]\d\d|\+91 \d{5} \d{5}|\+86 \d{3} \d{4} \d{4}|\d{3}-\d{4}-\d{4}|\+81 \d \d{4} \d{4}|0\d-\d{4}-\d{4}|０[０-９]－[０-９－]{9}|[٠-٩]{11})(?: ext\.? \d+| x\d+)?|(?:(?:zero|one|two|three|four|five|six|seven|eight|nine) ?){6,}\b)(?![A-Za-z0-9-])",
    "id_number": r"(?<![A-Za-z0-9.-])(?:[A-Z]\d{8}|[A-Z]{2} ?\d\d ?\d\d ?\d\d ?[A-D]|\d{8}-[A-Z]|\d{3}[- ]\d\d[- ]\d{4}|\d-\d{4}-\d{5}-\d\d|\d\d \d{3} \d{3} \d{3})(?![A-Za-z0-9-])",
    "address": rf"(?<![A-Za-zÀ-ÿ0-9.-])(?:(?:Flat \d+,\s|Unit \d+/)?\d+[a-z]? {_ADDRESS_STREET}(?:,\s|\n)(?:TOWN)(?:,?[ \n]{POSTCODE})?|PO Box \d+,\s(?:TOWN)(?:,?[ \n]{POSTCODE})?|(?:[\wäöüß]+(?:gasse|stieg|weg|straße|str\.)|Am Alten Wehr) \d+ ?[a-z]?, \d{{5}} [A-ZÄÖÜ][\wäöüß]+|\d+(?: bis| ter)?, (?:rue|impasse|allée|quai|place|avenue|chemin) [^,\n]+?, \d{{5}} [A-Z][\w’-]+|(?:Calle|Plaza|C/|Avda\.|Camino) [^,\n\d]+? \d+, \d+\.º [A-Z], \d{{5}} [A-Z]\w+|г\. [А-Я][\w-]+, ул\. [А-Я][\w-]+, д\. \d+, кв\. \d+|〒\d{{3}}-\d{{4}} ?[^\s\d]+\d+-\d+-\d+)",
    "person": r"(?<![\w@.+-])(?:(?:(?:GIVEN|[A-Z]\.) (?:[A-Z]\. )?(?:FAMILY)|(?:FAMILY), (?:(?:GIVEN)|[A-Z]\.))(?: Jr\.)?)(?![\w@+-])|(?<=Меня зовут )[А-Я]\w+ [А-Я]\w+|(?<=С уважением, )[А-Я]\w+ [А-Я]\w+|(?<=我叫)[一-鿿]{2,4}(?=。)|(?<=此致，)[一-鿿]{2,4}(?![一-鿿])|(?<![ぁ-んァ-ヶ一-鿿])[ヶ一-鿿]{1,4}[ 　]?[ぁ-ん一-鿿]{1,4}(?=と申します)|(?<=敬具　)[ヶ一-鿿]{2,4}[ 　]?[ぁ-ん一-鿿]{1,4}",
}
#: Words that introduce a writer or an addressee.
_INTRODUCED = re.compile(rf"(?:\b(?:Dear|Mrs\.|Signed:|Proofread by|cc:|From:|Yours in \w+,|[Mm]y name is|Mein Name ist|Je m'appelle|Je m’appelle|Me llamo|Cordialement,|Un saludo,|Grüßen,) )({_WORD}) (?:[A-Z]\. )?((?:[a-z]{{2,3}} ){{0,2}}{_WORD})")
_TOWN_BEFORE_CODE = re.compile(rf"(?:Street|Lane|Road|Yard|Drive|Avenue|Close|Row),? ?\n?((?:{_WORD}|{_WORD}-on-{_WORD})(?: {_WORD}){{0,2}}),?[ \n]{POSTCODE}\b")


class Marker:
    """Finds the spans of sample documents; given names, family names and towns are learnt from the sample itself."""

    def __init__(self, texts: list[str], story_names: set[str], least: int = 3):
        pairs, towns = Counter(), Counter()
        for t in texts:
            pairs.update(set(_INTRODUCED.findall(t)))
            towns.update({re.sub(r"\s+", " ", x) for x in _TOWN_BEFORE_CODE.findall(t)})
        given, family = Counter(), Counter()
        for (a, b), n in pairs.items():
            if f"{a} {b}".lower() not in story_names:
                given[a] += n
                family[b] += n
        words = lambda counts: "|".join(sorted((re.escape(w) for w, n in counts.items() if n >= least), key=len, reverse=True)) or "(?!)"
        slots = {"GIVEN": words(given), "FAMILY": words(family), "TOWN": words(towns)}
        self.found = {k: v.split("|") for k, v in slots.items()}
        self.finders = {k: re.compile(re.sub("GIVEN|FAMILY|TOWN", lambda m: slots[m.group()], p), re.I if k in ("email", "address", "person") else 0) for k, p in MARKED.items()}
        self.story_names = story_names

    def __call__(self, text: str) -> list[Span]:
        spans: list[Span] = []
        for kind in ("email", "address", "phone", "id_number", "person"):
            for m in self.finders[kind].finditer(text):
                a, b = m.start(), m.start() + len(m.group().rstrip())
                if b > a and not any(a < y and x < b for x, y, _ in spans) and not (kind == "person" and text[a:b].lower() in self.story_names):
                    spans.append((a, b, KINDS.index(kind)))
        return sorted(spans)


def varied(text: str, spans: list[Span], make: Inventor, share: float) -> tuple[str, list[Span]]:
    """The text with a share of its spans replaced by invented ones, those of other scripts left as they are."""
    out, moved, last = "", [], 0
    for a, b, kind in spans:
        piece = text[a:b]
        if make.rng.random() < share and re.search("[A-Za-z0-9]", piece):
            piece = make.of_kind(KINDS[kind])
        out += text[last:a]
        moved.append((len(out), len(out) + len(piece), kind))
        out += piece
        last = b
    return out + text[last:], moved
