"""Personal information in free text: anchor expansion.

One Aho-Corasick pass over the lower-case text finds anchors: at-signs and their written forms, number signs, labels of
identity numbers, street words, and the words that introduce a person. Each anchor calls a deterministic local parser
that expands from it to the left and right, validates what it finds, and gives a typed span. Nothing far from an anchor
is looked at, so the work grows with the text plus the number of anchors.

Domains are judged by their form, not by a list of endings. Account and card numbers and CPF must have right check digits;
account numbers also count without a label, because country, length and check digits tell them. Other identity numbers
are accepted by label and shape unless all their digits are equal: the invented ones of the test tables have no valid
check digits. A full name counts after a word that introduces a person, or where it begins with a known given name and
does what persons do.

Kinds: email, phone, id_number, address, name. Masking puts the typed placeholder in the span's place and leaves the
rest of the text as it is.

Defined results: null and blank texts have no spans; overlapping spans keep the earlier, then the longer one; machine
accounts, package names, URLs with user information, hosts, versions, orders and other technical numbers are no cases;
repeated rows give each span once.
"""

from __future__ import annotations

from functools import cache

import regex
from pyspark.sql import DataFrame

from factloom.llm.spans import lowered, map_rows, masked, settle

KINDS = ("email", "phone", "id_number", "address", "name")

# ---- emails -------------------------------------------------------------------------------------------------------
_AT_WORDS = ("[at]", "(at)", "{at}", "<at>", "[ at ]", "( at )", "[@]", "(@)", "&#64;", "&commat;", "%40", " at ", "[arroba]", "(arroba)", " arroba ", "[ät]", "(ät)", "[arobase]", "(arobase)", "＠", "@")
_DOT_WORDS = "dot|punkt|punto|point|ponto"
_SEP_DOT = regex.compile(rf"(?:(?P<tight>\.)|(?P<written>[ \t]?[\[\(\{{][ \t]?(?:{_DOT_WORDS}|\.)[ \t]?[\]\)\}}][ \t]?|[ \t](?:{_DOT_WORDS})[ \t])|(?P<spaced>[ \t]\.[ \t]))(?=[\p{{L}}\p{{N}}])", regex.I)
_LABEL = regex.compile(r"[\p{L}\p{N}](?:[\p{L}\p{N}\-]*[\p{L}\p{N}])?")
#: Last labels: letters, or an encoded name; those of files are none.
_LAST = regex.compile(r"(?:\p{L}{2,}|xn--[a-z0-9\-]+)", regex.I)
_FILES = frozenset("png jpg jpeg svg gif webp ico pdf json yaml yml txt html xml js ts jsx tsx css java go kt lock tar gz tgz zip jar war exe dll log csv parquet service timer socket".split())
#: Mailboxes of machines, not of persons.
MACHINE = frozenset(
    "git deploy root admin administrator noreply no-reply donotreply do-not-reply bot ci svc service system daemon mailer-daemon postmaster "
    "hostmaster webmaster jenkins runner backup cron ops alerts alert monitoring notifications notification support info help build release "
    "robot automation nobody www-data ubuntu ec2-user app api user".split()
)


def _domain(text: str, lo: int) -> int | None:
    """The end of the domain that begins here: labels with dots written in one way, and a last label that can be one.

    A label with a capital after lower-case ones, or after a blank what isn't a last label, begins a sentence.
    """
    m = _LABEL.match(text, lo)
    if not m:
        return None
    labels, ends, style = [m[0]], [m.end()], None
    while d := _SEP_DOT.match(text, ends[-1]):
        own = d.lastgroup
        if own == "spaced" and style not in (None, "spaced") or not (m := _LABEL.match(text, d.end())):
            break
        if m[0][:1].isupper() and labels[-1][-1:].islower() and not any(c.isupper() for x in labels for c in x):
            break
        if own != "tight" and len(labels) > 1 and not _LAST.fullmatch(m[0]):
            break
        labels.append(m[0])
        ends.append(m.end())
        style = own
    last = labels[-1]
    return ends[-1] if len(labels) > 1 and _LAST.fullmatch(last) and last.lower() not in _FILES else None


def _email(text: str, low: str, at: int, word: str):
    spaced = word == " at " or word == " arroba "
    lo_end, hi = at, at + len(word)
    if not spaced:
        while lo_end > 0 and text[lo_end - 1] == " " and at - lo_end < 1:
            lo_end -= 1
        if hi < len(text) and text[hi] == " ":
            hi += 1
    if word in ("@", "＠") and ((lo_end < at) != (hi > at + len(word))):
        return None  # a mention or a decorator, not an address
    lo = lo_end
    while lo and (text[lo - 1].isalnum() or text[lo - 1] in "_%+-" or text[lo - 1] == "." and lo < lo_end and text[lo].isalnum()):
        lo -= 1
    while lo < lo_end and not text[lo].isalnum():
        lo += 1
    end = _domain(text, hi)
    if lo == lo_end or not end:
        return None
    who = text[lo:lo_end]
    before = text[max(0, lo - 12) : lo]
    after = text[end : end + 1]
    if before.endswith(("://", ":", "/", "@", "$", "}", "=//")) and not regex.search(r"(?:mailto:|cc:|to:|from:|\p{L}:)$", before, regex.I):
        return None
    if "://" in before or after in ("/", ":") and regex.match(r"[/:][\w.]", text[end : end + 2]):
        return None
    plain = who.lower()
    if plain in MACHINE or regex.split(r"[.+_\-]", plain)[0] in ("git", "deploy", "svc", "noreply", "bot", "ci"):
        return None
    if spaced:
        written = regex.search(_DOT_WORDS, text[hi:end], regex.I)
        if not regex.search(r"[<(\[,;:\"'\n]\s*$|\b(?:from|de|von|to|to:|an|a|em|cc|at|mail|email|e-mail|correo|contact|contato|contacto|joindre|write|reach)\s+$|^$", before, regex.I) and not written:
            return None
    return lo, end, "email"


# ---- phones -------------------------------------------------------------------------------------------------------
_PHONE = regex.compile(
    r"""(?<![\w.+/\-@:=#])(?:
      \+\d{1,3}[\s\-./]?\(?\d{1,5}\)?(?:[\s\-./]?\d{2,5}){1,5}     # international
    | \(0?\d{2,4}\)\s?\d{3,4}[\s\-./]\d{3,5}                       # area code in brackets
    | \d{3}[.\-]\d{3}[.\-]\d{4}                                     # 303.555.0110
    | 0\d(?:[ .]\d\d){4}                                            # 01 99 00 89 16
    | 0\d{2}\s\d{4}\s\d{4} | 0\d{4}\s\d{6} | 0\d{3}\s\d{3}\s\d{4} | 0\d{4}\s\d{3}\s\d{3}
    | 0\d{2,4}/\d{3,6}(?:[\-\s]\d{1,4})?                            # 030/23125-113
    | 00\d{2}[\s\-]\d{1,4}(?:[\s\-]?\d{2,5}){2,4}
    )(?![\w/\-@]|\.\d)""",
    regex.X,
)
_PHONE_EQ = regex.compile(r"(?:phone|tel|mobile|fax|telefon|telefone|teléfono|tél|handy)[\"']?\s*[=:.]\s*[\"']?$", regex.I)


def _phone(text: str, low: str, at: int, word: str):
    start = at + (len(word) if word not in ("+", "(", "0") else 0)
    for lo in ([start] if word in ("+", "(") else range(start, min(len(text), start + 4))):
        m = _PHONE_AT(text, lo)
        if m:
            digits = sum(c.isdigit() for c in m[0])
            if 8 <= digits <= 15:
                return lo, m.end(), "phone"
    return None


_PHONE_BODY = regex.compile(_PHONE.pattern.replace(r"(?<![\w.+/\-@:=#])", ""), regex.X)


def _PHONE_AT(text: str, lo: int):
    if lo and (text[lo - 1].isalnum() or text[lo - 1] in "_.+/@#-") or lo and text[lo - 1] in "=:" and not _PHONE_EQ.search(text, max(0, lo - 14), lo):
        return None
    return _PHONE_BODY.match(text, lo)


# ---- identity numbers ---------------------------------------------------------------------------------------------
_SEP = r"[ \-.]?"
_IDS = {
    "ssn": r"\d{3}[ \-]\d{2}[ \-]\d{4}|\d{9}",
    "dni": r"\d{8}[\-\s]?[A-Za-z]|[XYZ]\d{7}[\-\s]?[A-Za-z]",
    "nino": rf"[A-Za-z]{{2}}{_SEP}\d\d{_SEP}\d\d{_SEP}\d\d{_SEP}[A-Da-d]",
    "tax": rf"\d\d{_SEP}\d{{3}}{_SEP}\d{{3}}{_SEP}\d{{3}}",
    "passport": r"[A-Za-z]{1,2}\d{6,9}|\d{9}",
    "secu": rf"\d{_SEP}\d\d{_SEP}\d\d{_SEP}(?:\d\d|2[AB]){_SEP}\d{{3}}{_SEP}\d{{3}}(?:{_SEP}\d\d)?",
    "national": r"[A-Za-z]{0,3}[\- ]?\d{6,12}[\- ]?[A-Za-z]?",
    "iban": r"[A-Z]{2}\d{2}(?:[ \-]?[A-Z0-9]{4}){2,7}(?:[ \-]?[A-Z0-9]{1,3})?",
    "card": r"\d{4}(?:[ \-]?\d{4}){2}[ \-]?\d{1,7}|\d{4}[ \-]?\d{6}[ \-]?\d{4,5}",
    "cpf": r"\d{3}\.\d{3}\.\d{3}-\d{2}|\d{11}",
    "nif": r"\d{9}|\d{3} \d{3} \d{3}",
}
_ID = {k: regex.compile(rf"(?:{v})(?![\w])") for k, v in _IDS.items()}
#: Label -> the numbers it may introduce.
ID_LABELS = {
    "ssn": ("ssn",), "social security number": ("ssn",), "social security no": ("ssn",), "social security": ("ssn",),
    "dni": ("dni",), "nie": ("dni",), "nif": ("dni", "nif"), "ni number": ("nino",), "national insurance number": ("nino",), "nino": ("nino",),
    "steuer-id": ("tax",), "steuerid": ("tax",), "steuer-identifikationsnummer": ("tax",), "steuernummer": ("tax",),
    "passport no.": ("passport",), "passport no": ("passport",), "passport number": ("passport",), "passport": ("passport",),
    "reisepass": ("passport",), "pasaporte": ("passport",), "passeport": ("passport",), "passaporte": ("passport",), "ausweis": ("passport",),
    "n° sécu": ("secu",), "n° secu": ("secu",), "numéro de sécurité sociale": ("secu",), "sécurité sociale": ("secu",), "nir": ("secu",),
    "national id": ("national",), "identity number": ("national",), "id card": ("national", "passport"), "personalausweis": ("passport",),
    "iban": ("iban",), "cpf": ("cpf",), "bsn": ("nif",),
    "card": ("card",), "card number": ("card",), "credit card": ("card",), "debit card": ("card",), "visa": ("card",), "mastercard": ("card",), "amex": ("card",), "kreditkarte": ("card",), "kartennummer": ("card",),
    "tarjeta": ("card",), "carte bancaire": ("card",), "cartão": ("card",),
}
#: Length of an account number (IBAN) by country; fixed values.
IBAN_LENGTHS = {
    "AT": 20, "BE": 16, "BG": 22, "BR": 29, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IS": 26, "IT": 27,
    "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27,
}


def _weighted(digits: list[int], weights: range) -> int:
    return sum(d * w for d, w in zip(digits, weights))


def _iban(s: str) -> bool:
    c = "".join(x for x in s if x.isalnum()).upper()
    return IBAN_LENGTHS.get(c[:2]) == len(c) and int("".join(str(int(x, 36)) for x in c[4:] + c[:4])) % 97 == 1


def _luhn(s: str) -> bool:
    d = [int(x) for x in s if x.isdigit()]
    return 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d))) % 10 == 0


def _cpf(s: str) -> bool:
    d = [int(x) for x in s if x.isdigit()]
    return all(d[n] == _weighted(d[:n], range(n + 1, 1, -1)) * 10 % 11 % 10 for n in (9, 10))


#: Numbers whose check digits tell; the others have none, or are accepted by label and shape.
_CHECKED = {"iban": _iban, "card": _luhn, "cpf": _cpf}


def _valid(kind: str, s: str) -> bool:
    d = [x for x in s if x.isdigit()]
    return len(set(d)) > 1 and (kind not in _CHECKED or _CHECKED[kind](s))


def _account(text: str, low: str, at: int, word: str):
    """An account number without a label: country, length and check digits tell it."""
    if at and text[at - 1].isalnum() or not text[at : at + 2].isupper():
        return None
    need, end = IBAN_LENGTHS[word[:2].upper()], at
    while end < len(text) and need and (text[end].isascii() and text[end].isalnum() or text[end] in " -" and text[end - 1] not in " -"):
        need -= text[end].isalnum()
        end += 1
    if need or end < len(text) and text[end].isalnum() or not _iban(text[at:end]):
        return None
    return at, end, "id_number"


_GAP = regex.compile(r"(?:\s*(?:no\.?|nr\.?|number|nummer|n[º°]|núm\.?|is|ist|es|est)(?![\w]))?[\s:=#\"'.]{0,4}", regex.I)


def _id_number(text: str, low: str, at: int, word: str):
    if at and (low[at - 1].isalnum() or low[at - 1] in "_-."):
        return None
    if at + len(word) < len(text) and (text[at + len(word)].isalnum() or text[at + len(word)] in "_-"):
        return None
    lo = _GAP.match(text, at + len(word)).end()
    for k in ID_LABELS[word]:
        m = _ID[k].match(text, lo)
        if m and _valid(k, m[0]):
            return lo, m.end(), "id_number"
    return None


# ---- addresses ----------------------------------------------------------------------------------------------------
_W = r"\p{Lu}[\p{L}’'\-]*"
_CITY = rf"(?:,\s(?:\d{{4,5}}\s)?{_W}(?:\s{_W}){{0,2}}?(?:\s\d{{4,5}}|\s[A-Z]{{1,2}}\d[\dA-Z]?\s\d[A-Z]{{2}})?)?"
_UNIT = r"(?:(?:Flat|Apt\.?|Apartment|Unit|Suite|Room|Floor)\s\w{1,5},?\s)?"
_EN_WORDS = r"Street|St\b\.?|Road|Rd\b\.?|Lane|Ln\b\.?|Avenue|Ave\b\.?|Close|Drive|Dr\b\.?|Court|Ct\b\.?|Way|Place|Pl\b\.?|Square|Sq\b\.?|Terrace|Crescent|Gardens|Boulevard|Blvd\b\.?"
_ADDRESSES = (
    regex.compile(rf"{_UNIT}\d{{1,5}}[A-Za-z]?,?\s(?:{_W}\s){{1,6}}(?:{_EN_WORDS}){_CITY}"),
    regex.compile(rf"{_W}(?:straße|strasse|weg|gasse|allee|platz|ring|damm|ufer|-Str\.|str\.|-Straße|-Allee|-Platz|-Weg|\sStraße|\sStr\.|\sAllee|\sPlatz|\sWeg)\s\d{{1,4}}(?:\s?[a-z]\b)?(?!\w){_CITY}"),
    regex.compile(rf"\d{{1,4}}(?:\s?(?:bis|ter)|[a-z])?,?\s(?:rue|avenue|boulevard|place|chemin|allée|impasse|quai|cours|route)\s(?:(?:de|du|des|la|le|les|l’|l')\s?){{0,3}}{_W}(?:\s{_W}){{0,3}}{_CITY}"),
    regex.compile(rf"(?:Calle|C/|Avenida|Avda\.?|Av\.|Plaza|Paseo|Camino|Rua|Travessa|Praça|Largo|Alameda|Via|Viale|Piazza)\s?(?:(?:de|del|do|da|dos|das|la|las|los|el)\s){{0,3}}{_W}(?:\s{_W}){{0,3}},?\s(?:n[º°.o]\.?\s?|núm\.?\s|número\s)?\d{{1,4}}[a-z]?(?:,\s\d{{1,2}}\s?[º°ª]\s?\p{{Lu}}?)?{_CITY}"),
)
_STREET_WORDS = (
    " street", " st.", " st", " road", " rd", " lane", " ln", " avenue", " ave", " close", " drive", " court", " way", " place", " square", " terrace", " crescent",
    " gardens", " boulevard", "straße", "strasse", "weg ", "gasse ", "allee ", "platz ", "ring ", "damm ", "-str.", "str. ", " rue ", " avenue ", " boulevard ", " chemin ",
    " impasse ", " quai ", "calle ", "avenida ", "avda", "plaza ", "paseo ", "rua ", "travessa ", "praça ", "alameda ", "largo ",
)
_NOT_ADDRESS = regex.compile(r"\s(?:is|ist|es|est|é|war|was)\s(?:(?:the|a|an|our|der|die|ein|el|un|le|la|o|um)\s)?(?:(?:code|project|cover|release)[ \-]?name|Deckname|Projektname|nombre en clave|nom de code|codinome)\b", regex.I)
#: The most words an address has before its street word: unit, its number, house number, and the words of the name.
ADDRESS_WORDS = 12


def _starts(text: str, at: int):
    """Where an address can begin: the words before its street word that can be part of one, whatever their length."""
    out, i = [at], at
    for _ in range(ADDRESS_WORDS):
        j = i
        while j and (text[j - 1].isspace() or text[j - 1] == ","):
            j -= 1
        k = j
        while k and (text[k - 1].isalnum() or text[k - 1] in "’'-/.º°ª"):
            k -= 1
        if k == j or not (text[k].isupper() or text[k].isdigit() or text[k:j].lower() in ("de", "du", "des", "la", "le", "les", "bis", "ter", "of", "the")):
            break
        out.append(k)
        i = k
    return out[::-1]


def _address(text: str, low: str, at: int, word: str):
    head = at + (word[0] == " ")
    best = None
    for lo in dict.fromkeys([*_starts(text, at), head]):
        if lo and (text[lo - 1].isalnum() or text[lo - 1] in "_-/.@#"):
            continue
        if lo >= len(text) or not (text[lo].isdigit() or text[lo].isupper()):
            continue
        for p in _ADDRESSES:
            m = p.match(text, lo)
            if m and m.end() >= at + len(word.rstrip()) and not _NOT_ADDRESS.match(text, m.end()):
                if _COUNTED.search(text, max(0, lo - 24), lo):
                    continue
                if best is None or (lo, -m.end()) < (best[0], -best[1]):
                    best = (lo, m.end(), "address")
        if best:
            return best
    return None


_COUNTED = regex.compile(r"(?:counted|version|release|rack|row|port|ticket|invoice|order|build|limit to|below|holds|after)\s$", regex.I)

# ---- names --------------------------------------------------------------------------------------------------------
_GIVEN = r"\p{Lu}\p{Ll}+(?:-\p{Lu}\p{Ll}+)*"
_INITIAL = r"\p{Lu}\."
_PARTICLE = r"(?:(?:von|van|vom|zu|zur|der|den|de|del|della|di|da|do|dos|das|du|la|le|ter|ten|af|av)\s+)*"
_FAMILY = r"(?:(?:O’|O'|Mc|Mac|D’|D')?\p{Lu}(?:\p{Ll}+|\p{Lu}+)(?:-\p{Lu}(?:\p{Ll}+|\p{Lu}+))*)"
_NAME = regex.compile(
    rf"(?:{_PARTICLE}{_FAMILY},[ \t]+(?:{_GIVEN}|{_INITIAL})(?:\s(?:{_GIVEN}|{_INITIAL})(?=\W))?|(?:{_GIVEN}|{_INITIAL})(?:\s(?:{_GIVEN}(?=\s\p{{Lu}})|{_INITIAL})){{0,2}}\s+{_PARTICLE}{_FAMILY})(?![\p{{L}}\-_])"
)
#: What introduces a person's full name.
NAME_CUES = (
    "name=", "name = ", "name: ", 'name": "', "name':", "contact=", "contact: ", 'contact": "', "user=", "customer=", "customer: ", "author: ", "author=", "@author ", 'author": "', "by: ", "-by: ", "assignee: ", "owner: ", 'owner": "', "from: ", "to: ", "cc: ",
    "on-call was ", "on call was ", "on-call: ", "on-call is ", "ask ", "reviewed with ", "reviewed by ", "approved by ", "reported by ", "written by ", "signed ", "call ", "ping ", "talk to ", "speak to ", "speak with ", "contact ", "regards, ", "thanks, ", "customer ", "attn ", "attn: ", "dear ",
    "rückfragen bitte an ", "bitte an ", "rücksprache mit ", "ansprechpartner ", "ansprechpartner: ", "ansprechpartnerin: ", "kontakt: ", "frau ", "herr ", "herrn ",
    "contacto: ", "contacto ", "contato: ", "contato ", "hablar con ", "preguntar a ", "falar com ", "voir avec ", "contacter ", "joindre ", "demander à ", "cliente ", "client ", "responsable: ", "responsável: ",
    "dr. ", "dr ", "prof. ", "mr. ", "mrs. ", "ms. ", "mr ", "mrs ", "ms ", "sr. ", "sra. ", "sr ", "sra ", "don ", "doña ", "dona ", "mme ", "mlle ", "m. ", "señor ", "señora ", "senhor ", "senhora ",
)
_TITLE = regex.compile(r"(?:(?:Dr|Prof|Mr|Mrs|Ms|Sr|Sra|Dipl|Ing|Mme|Mlle|Frau|Herrn?|M(?=\.\s+(?-i:\p{Lu}\p{Ll}+\s+\p{Lu})))\.?\s+)*", regex.I)
#: Words that make a capitalized phrase a product, a team, a place or a heading.
NOT_NAMES = frozenset(
    "team gateway keeper service services operation copper lane ridge street road the a an this that if when after only suppose order ticket host port build trace change field move "
    "platform support desk ops security data api internal external error warning status field version pool queue store server cluster engineering group squad edge ledger january february march april may june july "
    "august september october november december monday tuesday wednesday thursday friday saturday sunday team.".split()
)


#: Given names that make a full name likely without a word that introduces it, in the languages of the texts.
GIVEN = frozenset(
    "adam adrian alan albert alex alexander alice alicia amanda amelie ana andre andrea andreas andrew angela anna anne anton antonio april arthur augusto barbara beatriz ben benjamin bernard brian bruno camila camille carla carlos carmen caroline "
    "catarina catherine charlotte chloe chris christian christina claire clara claudia daniel daniela david diana diego dominik duarte edith eduardo elena elias elizabeth emily emma erik ernesto eva fabian felipe felix fernanda fernando florian "
    "francisco frank gabriel george gerard giulia gonzalo grace guillaume hannah hans heinrich helen helena henri henry hugo ian ines ingrid irene isabel isabelle jack jacques james jan jane janet javier jean jennifer jens jessica joana john jonas "
    "jorge jose joseph juan julia julian juliette june jürgen karen karl katharina kevin klaus laura lena leon leonor linda lisa louis louise lucas lucia luis luisa manuel marc marcos margaret maria marie marina mario marta martin mary mateo matthew "
    "max maximilian michael miguel monika natalia nathalie nicolas nina nora olivia oscar pablo patrick paul paula pedro peter philip philipp pierre rachel rafael ricardo richard robert ruth samuel sandra sarah sebastian silvia simon sofia sophie "
    "stefan stephanie steven susan teresa theo thomas tiago tim tobias ursula valentina victor victoria vincent walter werner william wolfgang yves".split()
)
#: What a person does: such a verb after a full name that begins with a known given name makes it one.
_DOES = regex.compile(
    r"(?:'s|’s)?\s+(?:\([^()\n]*\)\s+)?(?:wrote|said|says|asked|reported|reports|approved|merged|reviewed|fixed|joined|left|called|noticed|found|suggested|confirmed|replied|works|lives|owns|signed|thinks|wants|asks|and\s+\p{Lu}|"
    r"schrieb|sagte|fragte|meldete|bestätigte|hat\s+\p{Ll}+\s+\p{Ll}+(?:t|en)|dijo|escribió|informó|confirmó|a\s+(?:écrit|dit|signalé|confirmé)|disse|escreveu|informou|confirmou)\b", regex.I
)
#: What stands before a person.
_BY = regex.compile(r"(?:\b(?:by|from|with|for|to|told|asked|von|mit|an|für|por|de|con|para|avec|par|pour|com|and|und|y|et|e)|[,;:(\n>\"'—–-])\s*$|^\s*$", regex.I)


def _known(text: str, low: str, at: int, word: str):
    """A full name that begins with a known given name, where it does what persons do."""
    if at and (text[at - 1].isalnum() or text[at - 1] in "_-.@/=") or not text[at].isupper() or at + len(word) >= len(text) or text[at + len(word)] not in " -\u00a0\n":
        return None
    m = _NAME.match(text, at)
    if not m or "," in m[0] or "\n" in m[0] or not _person(m[0]) or not _DOES.match(text, m.end()):
        return None
    before = text[max(0, at - 24) : at]
    return (at, m.end(), "name") if _BY.search(before) or regex.search(r"[.!?]\s+$", before) else None


def _person(name: str) -> bool:
    """Whether a full name isn't a product, a team, a place or a heading; after a known given name a family may be called like one."""
    first, *rest = regex.findall(r"[\p{L}’'\-]+", " ".join(reversed(name.split(",", 1))))
    common = [t for t in rest if len(t) > 1 and t.lower() in NOT_NAMES]
    if len(first) > 1 and first.lower() in NOT_NAMES:
        return first.lower() in GIVEN and not common
    return not common or first.lower() in GIVEN


def _name(text: str, low: str, at: int, word: str):
    if word[0].isalpha() and at and (low[at - 1].isalnum() or low[at - 1] == "_" or low[at - 1] == "-" and not word.startswith("-")) and not word.startswith("by: "):
        return None
    lo = at + len(word)
    lo = _TITLE.match(text, lo).end()
    m = _NAME.match(text, lo)
    if not m:
        return None
    if not _person(m[0]):
        return None
    if text[m.end() : m.end() + 1] in ("@", "/", "=") or text[m.end() : m.end() + 2] == "::":
        return None
    return lo, m.end(), "name"


# ---- the automaton ------------------------------------------------------------------------------------------------
_PHONE_CUES = (
    "+", "(", "call ", "backup ", "tel. ", "tel.: ", "tel: ", "tel ", "phone=", "phone: ", "phone ", 'phone": "', 'tel": "', "mobile ", "mobile: ", "fax ", "telefon ", "telefon: ", "telefone ",
    "teléfono ", "tél. ", "tél : ", "llamar a ", "llame al ", "ligar para ", "anrufen unter ", "ou le ", "appeler le ", "handy ", "dial ", "ring ",
)


#: How account numbers begin: country and check digits from 02 to 98.
ACCOUNTS = tuple(f"{c.lower()}{n:02d}" for c in IBAN_LENGTHS for n in range(2, 99))


@cache
def automaton():
    import ahocorasick

    cues: dict[str, list] = {}
    for parser, words in ((_email, _AT_WORDS), (_phone, _PHONE_CUES), (_id_number, ID_LABELS), (_address, _STREET_WORDS), (_name, NAME_CUES), (_known, GIVEN), (_account, ACCOUNTS)):
        for w in words:
            cues.setdefault(w, []).append(parser)
    a = ahocorasick.Automaton()
    for w, parsers in cues.items():
        a.add_word(w, (w, parsers))
    a.make_automaton()
    return a


def find(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the personal information in a text, without overlaps."""
    if not text or not text.strip():
        return []
    low = lowered(text)
    spans = set()
    for end, (word, parsers) in automaton().iter(low):
        at = end - len(word) + 1
        for parser in parsers:
            s = parser(text, low, at, word)
            if s:
                spans.add(s)
    return settle(spans)


def spans_of(documents: DataFrame) -> DataFrame:
    """(doc_id, pii_kind, start_char, end_char), one row per piece."""
    rows = map_rows(documents.select("doc_id", "text"), "doc_id long, pii_kind string, start_char long, end_char long", lambda d, t: [(d, k, lo, hi) for lo, hi, k in find(t)])
    return rows.distinct()


def redacted(documents: DataFrame) -> DataFrame:
    """(doc_id, text, n_masked): the whole texts with typed placeholders in place of personal information."""

    def rows(d, t):
        s = find(t)
        return [(d, None if t is None else masked(t, s, lambda kind, _: f"[{kind.upper()}]"), len(s))]

    return map_rows(documents.select("doc_id", "text"), "doc_id long, text string, n_masked int", rows)
