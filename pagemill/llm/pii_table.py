"""The small labelled table that the model for personal information is trained on.

Lines carry their labels inline: ``{phone}`` stands for a mention of that type, filled from the forms below; in forms ``#`` is
a digit, ``@U`` a capital letter, and the other names in braces are parts. The table is expanded with a fixed seed.
"""

from __future__ import annotations

import random
import re
import unicodedata

# Forms of mentions, as they are written in the countries of the corpus.
FORMS = {
    "phone": """
        +44 20 #### ####|+44 #### ######|+44##########|0044 20 #### ####|0#### ######|07### ######|+1-###-###-####|+1 ### ### ####
        (###) ###-####|###.###.####|###-###-####|###-###-#### ext. ###|###.###.#### x##|0## ##### ###|0## ##### ##|+49 (0)## #####-###|+49 ### #######
        0049 ### #######|0###/#######|0### #######|0##/######|+33 # ## ## ## ##|0# ## ## ## ##|0#.##.##.##.##|+34 ### ### ###|6## ### ###|9# ### ## ##
        +39 ## ########|+351 ### ### ###|+48 ### ### ###|8 (###) ###-##-##|+7 ### ###-##-##|+44 2O #### ####|O### ######|+447######O##|###.###.O###|(###) ###-#### ext. ##
        +33 6 ## ## ## ##|01 ## ## ## ##|06 ## ## ## ##|0033 # ## ## ## ##""",
    "id_number": """
        ###-##-####|### ##-####|QQ ## ## ## C|QQ######B|QQ######A|QQ######C|QQ######D|QQ ## ## ## A|########-C|########@U|########-@U|###########|# ## ## ## ### ### ##
        ###############|## ### ### ###|## ## ## ## ## ##|@U########|AB######C|@U@U ## ## ## @U|###-##-####|### ##-####""",
    "email": """
        {u}.{u}@{h}.example|{u}@{h}.test|{u}_##@{h}.example|{u}+subs@{h}.example|{u}-{u}@{h}.test|{u}@post.{h}.example|{U}.{U}@{H}.EXAMPLE|{U}_##@{H}.TEST
        {u}.{u} at {h} dot example|{u}-{u} at {h} dot test|{u}+subs [at] {h}.example|{u}.{u} (at) {h}.test|{u}_## [at] {h}.example|{u}.{u}＠{h}.example
        {u}_## at {h} dot example|{u} at post.{h} dot example|{u} (at) {h} (dot) example|{u} [at] {h} [dot] test|{u}@{h}-mail.example|{u}.{u}@{h}-mail.example
        {u} at {h}-mail dot example|{u}-{u} [at] {h}-mail.example""",
    "address": """
        ### {en} {enroad}|### {en} {enroad}, {town} TW# #ZZ|Flat #, ### {en} {enroad}|P.O. Box ###, {town}|P.O. Box ##|PO Box ###, {town}|### N. {en} Ave., Apt #
        ## {en} {enroad}|###B Old {en} {enroad}|### S. {en} St., Apt ##|{de}{deroad} ###|{de}{deroad} ### b|{de}{deroad} ###, 0#### {town}|Am Alten {de}hof ###
        Postfach ## ## ##, {town}|{de}straße ##, 0#### {town}|###, {frroad} {fr}, 0#### {town}|### {frroad} {fr}|### bis, {frroad} {fr}|## {frroad} {fr}, 0#### {town}|B.P. ###, {town}
        {esroad} {es} ###|{esroad} {es} ###, #.º B|{esroad} {es}, ###|{esroad} {es} ###, {town}|Apartado ###, {town}|{ptroad} {pt} ###, #.º esq.|{ptroad} {pt}, n.º ###, {town}|{ptroad} {pt}, ###
        Apartado ###|{itroad} {it} ###|{itroad} {it}, ###, {town}|{itroad} {it} ###/#|Casella postale ###, {town}|{plroad} {pl} ###/#|{plroad} {pl} ###, 0#-#### {town}|{plroad} {pl} ### m. #
        skr. poczt. ##, {town}|skrytka pocztowa ##, {town}|ул. {ru}, д. ###, кв. #|{ru} улица, ###-#|{ru} набережная, дом ###|ул. {ru}, ###|{ru} переулок, ##, кв. ##|а/я ###, {town}
        пр. {ru}, д. ##|пл. {ru}, дом ###""",
}
# Parts of the forms.
PARTS = {
    "enroad": "Street|St.|Road|Rd.|Lane|Drive|Dr.|Avenue|Ave.|Row|Crescent|Court|Ct.|Square|Close|Way|Terrace|Hill",
    "en": "Harrow|Elmfield|Oakbourne|Thornley|Millbank|Kingsmead|Briarwood|Copperfield|Larkspur|Stonebridge|Foxglove|Willow|Ashdown|Candle",
    "deroad": "straße|str.|weg|gasse|platz|allee|ufer|damm|ring|kamp",
    "de": "Birken|Mühlen|Garten|Linden|Bach|Kirsch|Deich|Ziegel|Wiesen|Schäfer|Holunder|Hirten",
    "frroad": "rue|av.|avenue|boulevard|bd|impasse|chemin|place|allée|quai",
    "fr": "du Moulin|des Trois-Fontaines|de la Forge|des Lilas-Blancs|du Vieux-Pont|de l’Étang|des Tilleuls|du Cordier|de la Rive",
    "esroad": "Calle|C/|Avda.|Avenida|Plaza|Paseo|Camino|Ronda|Travesía|Callejón",
    "es": "de los Molinos|del Olivo Viejo|de la Fuente|Tres Cruces|Alfareros|del Herrero|de las Flores|Tejedores",
    "ptroad": "Rua|R.|Avenida|Av.|Travessa|Beco|Largo|Praça|Calçada",
    "pt": "das Oliveiras|dos Tanoeiros|do Moinho|da Fonte Nova|das Flores Altas|do Ferreiro",
    "itroad": "Via|V.le|Viale|Piazza|Vicolo|Corso|Largo|P.zza",
    "it": "del Fabbro|dei Tessitori|delle Rose|del Mulino Vecchio|dei Pini|del Ponte",
    "plroad": "ul.|al.|pl.|os.",
    "pl": "Lipowa|Starych Dębów|Kowalska|Młyńska|Ogrodowa Dolna|Trzech Lip",
    "ru": "Садовая|Мельничная|Верхнеречная|Новая Заводская|Гончарная|Малая Речная",
    "town": "Brenholt|Velmora|Torbelli|Ruvendo|Pelluria|Cintavel|Lirandel|Moskarvo|Quillhaven|Dunaveck",
    "h": "quill|lanternpost|kontor|tarnwick|correo-sur|velmora|brieftaube|mercato",
    "u": "anna|peter.m|k.lund|rosa|mvale|tomlin|brook|jonas|farrow|stein|mill|vela|okarr|ashby-cole|hale-fenn",
}
# Lines of speech that carry mentions; ¶ is a line break.
CARRIERS = """
    Call me on {phone} before noon.|The number is {phone}.|{phone} - that's the one she gave me.|{phone}|Ruf mich vor Mittag unter {phone} an.|Die Nummer ist {phone}.
    Appelle-moi au {phone} avant midi.|Le numéro est {phone}.|Llámame al {phone} antes del mediodía.|El número es {phone}.|Liga-me para o {phone} antes do meio-dia.|O número é {phone}.
    Chiamami al {phone} prima di mezzogiorno.|Il numero è {phone}.|Zadzwoń pod {phone} przed południem.|Numer to {phone}.|Позвони мне до полудня: {phone}.|Номер такой: {phone}.
    My card says {id_number}, look.|Officer, the number is {id_number}.|Registered under {id_number}, I think.|{id_number}|Auf der Karte steht {id_number}.|Meine Kennnummer lautet {id_number}.
    Sur la carte il y a {id_number}.|Mon numéro, c’est {id_number}.|En la tarjeta pone {id_number}.|Mi número es {id_number}.|No cartão está {id_number}.|O meu número é {id_number}.
    Sulla tessera c’è {id_number}.|Il mio numero è {id_number}.|Mój numer to {id_number}.|Na karcie jest {id_number}.|На карточке написано {id_number}.|Мой номер — {id_number}.
    Write to {email} if you find it.|My address is {email}, spelled as it sounds.|Send it to {email}|{email}|Schreib an {email}, wenn du es findest.|Meine Adresse ist {email}.
    Écris à {email} si tu le trouves.|Mon adresse, c’est {email}.|Escribe a {email} si lo encuentras.|Mi correo es {email}.|Escreve para {email}.|Scrivi a {email} se lo trovi.
    Napisz na {email}, jeśli to znajdziesz.|Mój adres to {email}.|Напиши на {email}, если найдёшь.|Мой адрес — {email}.|Advertise here: {email}|Contact us: {email}|O meu email é {email}.
    She lives at {address} now.|Deliver it to {address}.|{address}, third bell from the top.|{address}|Sie wohnt jetzt {address}.|Bring es bitte hierher: {address}.
    Elle habite {address} maintenant.|Livrez-le ici : {address}.|Ahora vive en {address}.|Llévalo a {address}.|Leva isto à {address}.|Agora ela mora na {address}.
    Adesso abita in {address}.|Portalo in {address}.|Ona mieszka teraz: {address}.|Zanieś to tutaj: {address}.|Она теперь живёт здесь: {address}.|Отнеси это сюда: {address}.
    My name is {name}.|Have you met {name}?|Ask Dr. {name} about it.|{name} owns the whole valley.|{name}: I will think about it tomorrow.|{name}|[{name}]|Subtitles: {name}
    Cast: {emans}|{emans} (##)|No. ##: {emans}|Ich heiße {name}.|Kennst du {name}?|Frau {name} weiß davon nichts.|Herr {name} kommt morgen.|Je m’appelle {name}.
    Tu connais {name} ?|Demande à Mme {name}.|Me llamo {name}.|¿Conoces a {name}?|Pregúntale a don {name}.|Chamo-me {name}.|Conheces {name}?|Pergunta à Dona {name}.
    Mi chiamo {name}.|Conosci {name}?|Chiedi alla signora {name}.|Nazywam się {name}.|Znasz {name}?|Zapytaj panią {name}.|Меня зовут {name}.|А вот и {name}.
    Спроси у {name}.|Ты знаешь {name}?|... {name} ...|And then {name} said no.|{emans}|{name} and {name} left.|{name}, {address}|E então {name} disse que não.|{name}!
    - {emans}¶- Ok.|- {name}¶- No.|- {name}¶- Ja, bitte.|- Who is there?¶- {name}.|- {emans}¶- {emans}|- {phone}¶- Thanks.|- {address}¶- Merci.|- {email}¶- Bene.|- {name}?¶- {GIVEN}: No.
    Translated by {name}|Untertitel: {name}|Traduction : {name}|Dobrze zna to {name}.|I saw {name} there, with {given}.
"""
# Lines that look like mentions and are none.
NEGATIVES = """
    Lot ####-###, sold.|ISBN #-##-####-#|Case ####/####, closed.|Flight QV ####, gate B##.|Room ##, floor #.|Frequency ###.#, channel ##.|Price: ####,##|Episode ##, take #.|## x #### px
    ##.####, #.####|#.#.## - ##:##|#### / ##|+## ### pts|v#.#.#|v#.##.#|There are ## of them outside.|The train leaves in ## minutes.|## months of waiting.|Order ######-####, paid.
    - {given}!¶- {given}?|- Ok.¶- {given}.|{given}.¶{family} Hall is closed.|- Who?¶- {given}, the ferryman.
    Support us and become a VIP member at vault##.test|Subtitles downloaded from www.cuenest##.example|== Ripped by qvx-## ==|Follow @{u}_## now.|See {h}.example/notes/####|@{u}
    {given}!|{given}, {given}.|{GIVEN}: I will think about it tomorrow.|{GIVEN}: Was macht das Museum denn?|{GIVEN}: Где это было?|{given} was here.|Where is {given}?|Wo ist {given}?
    {GIVEN}: The town council counts ## boats on the river.|{GIVEN}: {given}, listen to me.|- {GIVEN}: No.|{given}?|{given} ist nicht da.|¿Dónde está {given}?|{given} & {given}
    The museum in {town} counts ## boats.|Das Museum in {town} zählt ## Boote auf dem Fluss.|Le musée de {town} compte ## bateaux.|El museo de {town} cuenta ## barcos en el río.
    O museu de {town} conta ## barcos no rio.|Il museo di {town} conta ## barche sul fiume.|Muzeum w mieście {town} liczy ## łodzi na rzece.|Музей в городе {town} считает ## лодок.
    The old road to {town} is closed.|Illness took him in the hills.|Der Zug nach {town} fährt in ## Minuten.|That is the wrong key.|[DOOR CREAKS]|[ TÜR KNARRT ]|♪ Thunder ♪|(sighs)
    We should have taken the other road.|Nobody has been here for years.|Ich komme am Ende der Woche.|No me voy sin el mapa.|I saw it after ## months of waiting.|THE TOWN COUNCIL COUNTS ## BOATS.
    This year’s apple harvest needs ## crates.|The harbour office keeps a list.|Die alte Fähre misst die Tiefe des Sees.|La vieille route est fermée.|Старый паром ищет ## человек.
    {family} & Sons, closed.|The {family} Company owns the valley.|{family} Hall|Hotel {family}|Mount {family}|{town} {en}|Banco {family}|the {family} bridge|{family} GmbH|Café {given}
    Mr. {family} is late.|Frau {family} weiß davon nichts.|Señor {family}, por favor.|Signora {family}!|Mme {family} n’est pas là.|Pan {family} nic nie wie.|Господин {family} ушёл.
    I saw it after ## months of waiting.|Ich komme nach ## Monaten des Wartens.|nach ## Wochen voller Arbeit|Er braucht noch ## hölzerne Kisten.|sucht ## freiwillige Helfer, sobald der Schnee schmilzt.|zählt ## Boote auf dem Fluss nach ## Tagen
    después de ## meses de espera|busca ## voluntarios en cuanto puede.|necesita ## cajas de madera más después de ## días.|après ## mois d’attente|cherche ## bénévoles au milieu de {town}.|a besoin de ## caisses en bois
    depois de ## meses de espera|procura ## voluntários no meio de {town}.|precisa de mais ## caixas de madeira.|dopo ## mesi di attesa|cerca ## volontari in mezzo a {town}.|ha bisogno di altre ## casse di legno
    po ## miesiącach czekania|szuka ## ochotników, zanim zacznie się zima.|potrzebuje jeszcze ## drewnianych skrzyń|ищет ещё ## деревянных ящиков|приглашает ## добровольцев с терпением|needs ## more wooden crates at the end of the week.
    has never seen such a crowded market at the end of the week.|opens its doors to curious visitors at the end of the week.|We met at {town} at noon, dot by dot.|She looked at the old map.|Meet me at ## o'clock at the gate.|AT THE END OF THE WEEK
    [LADRA UN PERRO]|[ CRUJE LA PUERTA ]|[MUSIC PLAYING]|[ UN CHIEN ABOIE ]|[LEISE MUSIK]|[ PORTA CHE SBATTE ]|[SZMER TŁUMU]|[ГРОМ ГРЕМИТ]|[CROWD MURMURING]|[ HUND BELLT ]|[ LA PORTE GRINCE ]|[MÚSICA SUAVE]|♪ LA LLUVIA CAE ♪|(UN CANE ABBAIA)
    THE WEATHER STATION NEEDS ## CRATES AT {TOWN}.|DAS MUSEUM ZÄHLT ## BOOTE.|EL CORO DEL PUEBLO BUSCA ## VOLUNTARIOS.|LE CONSEIL MUNICIPAL CHERCHE ## BÉNÉVOLES.|Und der Gemeinderat?|And the village choir?|So what does the repair crew do?
    Get more subs: t / {u}sub##|More at t.me/{u}##|Follow us: @{u}nights|Get more subs: {h}.test/{u}##|Channel: {u}sub##|See t / {h}##
    Track ## of ##.|#:## to #:##.|It costs ## euros.|In #### it was different.|Since #### nobody came.|Nr. #### wurde gelöscht.|Ref. ########|Invoice ####-##|###,###,### views|## ### km
"""
_GIVEN = "Arvid Tilda Maren Osbert Ludo Ines Pavel Irena Bruno Celia Tomás Elvira Donato Livia Jasna Borys Юлиан Фаина Henrik Rolande Hedwig Isaura".split()
_FAMILY = "Halloran|Westerby|Kestrell|Brandauer|von Lindenau|Oberwald|de Montclair|Larivière|del Prado|Valdecasas|da Ribeira|Azevinho|Bellandi|Di Castro|Nowotarski|Zalewska|Лесников|Рябинина|Ashby-Cole|O’Dorran|D’Ambria".split("|")


def _lines(table: str) -> list[str]:
    return [x.strip() for x in re.split(r"\||\n", table) if x.strip()]


class Table:
    """Expands the table; names come from the given list and, so that unknown ones are learned too, from a few others."""

    def __init__(self, given: list[str], family: list[str], seed: int = 7) -> None:
        self.random = random.Random(seed)
        self.given = {True: given or _GIVEN, False: _GIVEN}
        self.family = {True: family or _FAMILY, False: _FAMILY}
        self.forms = {k: _lines(v) for k, v in FORMS.items()}

    def pick(self, kind: str) -> str:
        return self.random.choice(getattr(self, kind)[self.random.random() < 0.8])

    def fill(self, text: str) -> str:
        """Parts and digits filled in."""
        r = self.random

        def part(m: re.Match) -> str:
            key = m[1]
            if key in ("given", "GIVEN"):
                name = self.pick("given")
                return name.upper() if key == "GIVEN" else name
            if key == "family":
                return self.pick("family")
            value = r.choice(PARTS[key.lower()].split("|"))
            if key in "uU" and r.random() < 0.6:  # mailboxes are often called after people
                name = unicodedata.normalize("NFKD", self.pick(r.choice(("given", "family")))).encode("ascii", "ignore").decode()
                value = re.sub(r"[^a-z-]", "", name.lower()) or value
            return value.upper() if key.isupper() else value

        text = re.sub(r"\{(\w+)\}", part, text)
        text = re.sub("@U", lambda m: r.choice("ABCDEHJKLMNPRSTWXYZ"), text)
        return re.sub("#", lambda m: str(r.randrange(10)), re.sub(r"(?<![\w.])#(?=\w)", lambda m: m[0], text))

    def mention(self, kind: str) -> str:
        r = self.random
        if kind in ("name", "emans"):
            given, family = self.pick("given"), self.pick("family")
            if kind == "emans" or r.random() < 0.08:
                name = f"{family}, {given}"
            else:
                middle = f" {r.choice('ABCDFGJLMNPRST')}." if r.random() < 0.2 else ""
                name = f"{given}{middle} {family}"
            style = r.random()
            return name.upper() if style < 0.15 else name.lower() if style < 0.2 else name
        text = self.fill(r.choice(self.forms[kind]))
        return text.upper() if kind == "address" and r.random() < 0.05 else text

    def row(self, line: str) -> tuple[str, list[tuple[int, int, str]]]:
        """Text and labelled spans of one line, wrapped as subtitles may be."""
        out, spans = "", []
        r = self.random
        codec = r.choice(["cp1252", "latin-1", "cp437", "cp1251", "mac_roman"]) if r.random() < 0.06 else ""

        def spoilt(text: str) -> str:  # some lines come wrongly decoded
            return text.encode("utf-8").decode(codec, "replace") if codec else text

        for piece in re.split(r"(\{(?:phone|id_number|email|address|name|emans)\})", line):
            if m := re.fullmatch(r"\{(phone|id_number|email|address|name|emans)\}", piece):
                text = spoilt(self.mention(m[1]))
                spans.append((len(out), len(out) + len(text), "name" if m[1] == "emans" else m[1]))
                out += text
            else:
                out += spoilt(self.fill(piece))
        out = out.replace("¶", "\n")
        if r.random() < 0.25 and (blanks := [i for i, c in enumerate(out) if c == " "]):  # a line break between words
            at = r.choice(blanks)
            out = f"{out[:at]}\n{out[at + 1 :]}"
        wrap = r.random()
        front, back = ("<i>", "</i>") if wrap < 0.08 else ("- ", "") if wrap < 0.16 else ("... ", " ...") if wrap < 0.24 else ("[", "]") if wrap < 0.27 else ("", r.choice(["", "", "", "?", "!"]) if wrap < 0.45 else "")
        return front + out + back, [(a + len(front), b + len(front), k) for a, b, k in spans]

    def rows(self, times: int = 32) -> list[tuple[str, list[tuple[int, int, str]]]]:
        lines = _lines(CARRIERS) + _lines(NEGATIVES)
        lines += [x for x in lines if re.fullmatch(r"\{\w+\}[!?]?", x)] * 4  # mentions that stand alone, in every wrapping
        return [self.row(line) for _ in range(times) for line in lines]
