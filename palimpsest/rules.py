"""Kinds, rules, lists, policies and lineages: the engine's data, held on the driver.

Rules are Java regular expressions, case-insensitive; look-behinds are bounded. Lists are joined longest first where a rule
says {{name}}.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field, replace

#: The closed list of kinds, in order; the order breaks ties.
KINDS = """Other PatientName FamilyName StaffName OtherName Phone Email Url IpAddress Address PostalCode Date AgeOver89 RecordNumber AccountNumber
DeviceId Organization Product ClientName City State""".split()
ORDINAL = {k: i for i, k in enumerate(KINDS)}
PERSONS = ("PatientName", "FamilyName", "StaffName", "OtherName", "ClientName")
ACTIONS = ("Label", "Surrogate", "YearOnly", "Generalize", "Keep")
#: What each kind is replaced with, the text that wider values become, limits and the policy's numbers.
LABELS = {
    "PatientName": "[PATIENT]", "FamilyName": "[FAMILY]", "StaffName": "[STAFF]", "OtherName": "[NAME]", "Phone": "[PHONE]", "Email": "[EMAIL]", "Url": "[URL]",
    "IpAddress": "[IP]", "Address": "[ADDRESS]", "PostalCode": "[ZIP]", "Date": "[DATE]", "AgeOver89": "[AGE 90+]", "RecordNumber": "[RECORD]", "AccountNumber": "[ACCOUNT]",
    "DeviceId": "[DEVICE]", "Other": "[REMOVED]", "Organization": "[ORGANIZATION]", "Product": "[PRODUCT]", "ClientName": "[CLIENT]", "City": "[CITY]", "State": "[STATE]",
}
UNKNOWN_LABEL = "[REMOVED]"
GENERAL = {"AgeOver89": "90 or older"}
MAX_CHARACTERS, MAX_CANDIDATES = 1_000_000, 100_000

#: Word lists of the rules.
STATES = [
    "Alabama", "Alaska", "Arizona", "Arkansas", "California", "Colorado", "Connecticut", "Delaware", "District of Columbia", "Distrito de Columbia", "Florida", "Georgia", "Hawaii", "Hawái", "Idaho",
    "Illinois", "Indiana", "Iowa", "Kansas", "Kentucky", "Louisiana", "Luisiana", "Maine", "Maryland", "Massachusetts", "Michigan", "Míchigan", "Minnesota", "Mississippi", "Misisipi", "Missouri", "Misuri",
    "Montana", "Nebraska", "Nevada", "New Hampshire", "Nuevo Hampshire", "New Jersey", "Nueva Jersey", "New Mexico", "Nuevo México", "Nuevo Mexico", "New York", "Nueva York", "North Carolina", "Carolina del Norte",
    "North Dakota", "Dakota del Norte", "Ohio", "Oklahoma", "Oregon", "Oregón", "Pennsylvania", "Pensilvania", "Puerto Rico", "Rhode Island", "South Carolina", "Carolina del Sur", "South Dakota", "Dakota del Sur",
    "Tennessee", "Texas", "Utah", "Vermont", "Virginia", "Washington", "West Virginia", "Virginia Occidental", "Wisconsin", "Wyoming",
]
CODES = "AL AK AZ AR CA CO CT DE DC FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA PR RI SC SD TN TX UT VT VA WA WV WI WY".split()
DIGITS = {
    "zero": "0", "oh": "0", "cero": "0", "one": "1", "uno": "1", "una": "1", "two": "2", "dos": "2", "three": "3", "tres": "3", "four": "4", "cuatro": "4",
    "five": "5", "cinco": "5", "six": "6", "seis": "6", "seven": "7", "siete": "7", "eight": "8", "ocho": "8", "nine": "9", "nueve": "9",
}
#: The postal standard's street suffixes, each name with its abbreviation, where it has another.
SUFFIXES = """Alley Aly, Annex Anx, Arcade Arc, Avenue Ave, Bayou Byu, Beach Bch, Bend Bnd, Bluff Blf, Bottom Btm, Boulevard Blvd, Branch Br, Bridge Brg,
Brook Brk, Burg Bg, Bypass Byp, Camp Cp, Canyon Cyn, Cape Cpe, Causeway Cswy, Center Ctr, Circle Cir, Cliff Clf, Club Clb, Common Cmn,
Corner Cor, Course Crse, Court Ct, Cove Cv, Creek Crk, Crescent Cres, Crest Crst, Crossing Xing, Curve Curv, Dale Dl, Dam Dm, Divide Dv,
Drive Dr, Estate Est, Expressway Expy, Extension Ext, Falls Fls, Ferry Fry, Field Fld, Flat Flt, Ford Frd, Forest Frst, Forge Frg, Fork Frk, Fort Ft,
Freeway Fwy, Garden Gdn, Gateway Gtwy, Glen Gln, Green Grn, Grove Grv, Harbor Hbr, Haven Hvn, Heights Hts, Highway Hwy, Hill Hl, Hollow Holw,
Inlet Inlt, Island Is, Junction Jct, Key Ky, Knoll Knl, Lake Lk, Landing Lndg, Lane Ln, Light Lgt, Loop, Mall, Manor Mnr, Meadow Mdw,
Mill Ml, Mission Msn, Motorway Mtwy, Mount Mt, Mountain Mtn, Oval, Overpass Opas, Park, Parkway Pkwy, Pass, Path, Pike, Pine Pne, Place Pl,
Plain Pln, Plaza Plz, Point Pt, Port Prt, Prairie Pr, Radial Radl, Ranch Rnch, Rapid Rpd, Rest Rst, Ridge Rdg, River Riv, Road Rd,
Route Rte, Row, Run, Shoal Shl, Shore Shr, Skyway Skwy, Spring Spg, Square Sq, Station Sta, Stream Strm, Street St, Summit Smt, Terrace Ter,
Trace Trce, Track Trak, Trail Trl, Tunnel Tunl, Turnpike Tpke, Union Un, Valley Vly, Viaduct Via, View Vw, Village Vlg, Ville Vl, Vista Vis,
Walk, Wall, Way Wy, Well Wl, Wells Wls"""
#: Runs of three-digit postal prefixes that the census of 2020 lists, and those of 20,000 people or fewer among them.
ZIP_THRESHOLD = 20_000
LISTED_PREFIXES = """006-007 009-054 056-089 100-191 193-212 214-268 270-310 312-331 333-339 341-342 344 346-347 349-352 354-374 376-398 400-418 420-427 430-458
460-508 510-516 520-528 530-532 534-535 537-551 553-554 556-567 570-577 580-588 590-620 622-631 633-641 644-648 650-658 660-662 664-681 683-693 700-701 703-708
710-714 716-731 734-741 743-770 772-816 820-838 840-841 843-847 850-853 855-857 859-860 863-865 870-871 873-875 877-884 890-891 893-895 897-898 900 902-908
910-928 930-937 939-941 943-961 967-968 970-986 988-999"""
SMALL_PREFIXES = "036 059 102 202 203 204 205 369 556 692 753 772 821 823 878 879 884 893".split()
KEPT_PREFIXES = {f"{n:03d}" for run in LISTED_PREFIXES.split() for n in range(int(run[:3]), int(run[-3:]) + 1)} - set(SMALL_PREFIXES)
VERSION = "0.2.0"
LISTS: dict[str, list[str]] = {
    "us-state": STATES,
    "us-state-code": CODES,
    "sentence-opener": "Yes No Well So And But Oh Okay Ok Sure Then Now Also Right Thanks Thank Hi Hello Hey Sí Si Bueno Pues Pero Entonces Gracias Hola Claro Ahora También Tambien The In From To At Of En De Desde Para Por Con Mr Mrs Ms Dr Sr Sra".split(),
    "month-en": "January February March April May June July August September October November December".split(),
    "month-es": "enero febrero marzo abril mayo junio julio agosto septiembre setiembre octubre noviembre diciembre".split(),
    "ordinal-en": "first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth thirteenth fourteenth fifteenth sixteenth seventeenth eighteenth nineteenth twentieth thirtieth".split(),
    "day-es": "primero uno dos tres cuatro cinco seis siete ocho nueve diez once doce trece catorce quince dieciséis dieciseis diecisiete dieciocho diecinueve veinte veintiuno veintiún veintiun veintidós veintidos veintitrés veintitres veinticuatro veinticinco veintiséis veintiseis veintisiete veintiocho veintinueve treinta".split() + ["treinta y uno"],
    "tld": "com org net edu gov mil int info biz io co us mx es ca uk".split(),
    "street-suffix-us": SUFFIXES.replace(",", " ").split(),
    "directional-us": "North South East West Northeast Northwest Southeast Southwest N S E W NE NW SE SW".split(),
    "thoroughfare-us": "Street Avenue Road Lane Drive Boulevard Parkway Highway Expressway Freeway Turnpike Alley Terrace".split(),
    "unit-us": "Apartment Apt Suite Ste Unit Building Bldg Floor Fl Room Rm Lot Space Spc Trailer Trlr Department Dept Office Ofc".split(),
    "vialidad-mx": [
        "Ampliación", "Ampliacion", "Andador", "Avenida", "Av", "Avda", "Boulevard", "Bulevar", "Blvd", "Calle", "Callejón", "Callejon", "Calzada", "Calz", "Cerrada", "Circuito", "Circunvalación",
        "Circunvalacion", "Continuación", "Continuacion", "Corredor", "Diagonal", "Eje vial", "Pasaje", "Peatonal", "Periférico", "Periferico", "Privada", "Priv", "Prolongación", "Prolongacion", "Prol",
        "Retorno", "Viaducto", "Carretera", "Camino", "Brecha", "Terracería", "Terraceria", "Vereda",
    ],
    "digit-word": list(DIGITS),
    "cue-phone": "phone telephone cell cellphone mobile landline call text reach dial extension teléfono telefono celular móvil movil llamar llame llámeme llameme marque marcar extensión extension".split(),
    "cue-record": "record chart MRN file case expediente historia registro folio caso".split(),
    "cue-account": [
        "account", "policy", "member", "ID", "insurance", "Medicare", "Medicaid", "social security", "SSN", "cuenta", "póliza", "poliza", "afiliado", "afiliación", "afiliacion", "seguro social", "NSS", "CURP",
    ],
    "cue-zip": ["zip", "zipcode", "postal", "código postal", "codigo postal"],
    "kinship": "mother father daughter son wife husband sister brother granddaughter grandson grandmother grandfather niece nephew aunt uncle cousin partner widow widower caregiver madre padre hija hijo esposa esposo hermana hermano nieta nieto abuela abuelo sobrina sobrino tía tío prima primo pareja viuda viudo cuidadora cuidador".split(),
    "caregiver": "caregiver cuidadora cuidador".split(),
    "possessive": "my her his their our your mi mis su sus tu tus nuestra nuestro nuestras nuestros".split(),
    "title": "mr mrs ms miss mx dr doctor nurse sr sra srta senor senora senorita doctora enfermera enfermero".split(),
}
#: What a text must hold for a built-in rule to match at all: a cheap test before the rule is run.
NEEDS = dict.fromkeys("ipv4 phone-us ssn-us record-number zip-us street-us po-box date-numeric date-month-en date-month-es age-over-89 age-over-89-said".split(), "[0-9]") | {
    "email": "@", "email-spoken": r"\s(?:at|arroba)\s", "url": "http", "street-name-us": "(?-i:{{thoroughfare-us}})", "street-mx": r"\b{{vialidad-mx}}", "date-words-en": "{{month-en}}", "date-words-es": r"\sde\s+{{month-es}}", "age-over-89-words": "years?|años|anos",
}
AGE_BRACKETS = ["90 or older", "90 o más"]
BIRTH_CUE = r"\b(?:born|birthday|birthdate|birth|d\.?o\.?b|naci[oó]|nacida|nacido|nacimiento)\b"


@dataclass(frozen=True)
class Rule:
    id: str
    kind: str
    regex: str
    confidence: float = 0.9


_R = Rule
#: Parts of addresses said aloud. Loops over them are possessive: no text is long enough to exhaust the stack.
_DOT, _LABEL, _PART = r"(?:\s+(?:dot|punto)\s+|\.)", r"[\p{L}\p{Nd}_+-]++", r"[\p{L}\p{Nd}_-]++"
#: The patterns. Where a look-behind or a list holds white space, its length is bounded; digits are ASCII. A look-ahead
#: before a look-behind spares reading back from places where the rule can't match.
RULES: list[Rule] = [
    _R("email", "Email", r"\b[\p{L}\p{Nd}_.%+-]+@[\p{L}\p{Nd}_.-]+\.[A-Za-z]{2,}\b", 0.99),
    _R("email-spoken", "Email", rf"\b{_LABEL}(?:{_DOT}{_LABEL})*+\s+(?:at|arroba)\s+{_PART}(?:{_DOT}(?!{{{{tld}}}}\b){_PART})*+{_DOT}{{{{tld}}}}\b(?:{_PART[:-2]}*+(?:{_DOT}(?!{{{{tld}}}}\b){_PART})*+{_DOT}{{{{tld}}}}\b)*+", 0.9),
    _R("url", "Url", r"\bhttps?://[^\s<>\"']+", 0.99),
    _R("ipv4", "IpAddress", r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b", 0.9),
    _R("phone-us", "Phone", r"(?<![0-9])(?:\+?1[ .-]?)?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])", 0.95),
    _R("ssn-us", "AccountNumber", r"(?<![0-9])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9])", 0.99),
    _R("record-number", "RecordNumber", r"\b(?:mrn|medical record(?: number)?|chart number|expediente)\s*[:#]?\s*[0-9]{4,12}\b", 0.95),
    _R("zip-us", "PostalCode", r"(?=[0-9]{5})(?<=\b(?:zip(?:\s{0,4}code)?|postal\s{1,4}code|c[oó]digo\s{1,4}postal)(?:\s{0,4}[:#]|\s{1,4}(?:is|es|was|era))?\s{0,4}|(?-i:\b{{us-state-code}})\s{1,4}|\b{{us-state}},?\s{1,4})[0-9]{5}(?:-[0-9]{4})?(?![0-9])", 0.95),
    _R("state-us", "State", r"\b{{us-state}}\b|(?-i:(?=[A-Z]{2}\b)(?<=\b\p{Lu}\p{Ll}{1,30},[ ]?){{us-state-code}}\b)|(?-i:\b{{us-state-code}}(?=\s+[0-9]{5}(?:-[0-9]{4})?(?![0-9])))", 0.9),
    _R("city-us", "City", r"(?-i:\b(?!{{sentence-opener}}\b)\p{Lu}\p{Ll}+(?:['’]?\p{Lu}\p{Ll}+)?(?:(?:[ -]|\s(?:de|del|la|las|los|el)\s)\p{Lu}\p{Ll}+(?:['’]?\p{Lu}\p{Ll}+)?){0,2})(?=,?\s+{{us-state}}\b|(?-i:,\s?{{us-state-code}}\b|\s+{{us-state-code}}\s+[0-9]{5}(?![0-9])))", 0.85),
    _R("street-us", "Address", r"(?-i:\b[0-9]{1,6}[A-Z]?\s+(?:{{directional-us}}\.?\s+)?(?:(?:\p{Lu}\p{Ll}+|[0-9]{1,3}(?:st|nd|rd|th))\s+){1,3}{{street-suffix-us}}\b(?:\s+{{directional-us}}\b)?(?:,?\s+{{unit-us}}\.?\s*#?\s*[A-Za-z0-9-]{1,6}\b)?)", 0.9),
    _R("street-name-us", "Address", r"(?-i:\b(?!{{sentence-opener}}\b)(?:\p{Lu}\p{Ll}+\s+){1,3}{{thoroughfare-us}}\b)", 0.85),
    _R("street-mx", "Address", r"\b{{vialidad-mx}}\.?\s+(?-i:(?:(?:de|del|la|las|los|el)\s+)*+\p{Lu}\p{Ll}+(?:\s+(?:(?:de|del|la|las|los|el|y)\s+)*+\p{Lu}\p{Ll}+){0,3})(?:\s*(?:#|no\.|n[úu]m(?:ero)?\.?)?\s*[0-9]{1,5}[A-Za-z]?\b)?", 0.9),
    _R("po-box", "Address", r"\bP\.?\s?O\.?\s*Box\s*#?\s*[0-9]{1,6}\b|\bapartado\s+postal\s*#?\s*[0-9]{1,6}\b", 0.95),
    _R("date-numeric", "Date", r"\b[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4}\b", 0.95),
    _R("date-month-en", "Date", r"\b{{month-en}}\s+[0-9]{1,2}(?:st|nd|rd|th)?(?:,?\s+[0-9]{4})?\b", 0.9),
    _R("date-month-es", "Date", r"\b[0-9]{1,2}\s+de\s+{{month-es}}(?:\s+de\s+[0-9]{4})?\b", 0.9),
    _R("date-words-en", "Date", r"\b(?:{{month-en}}\s+(?:the\s+)?(?:(?:twenty|thirty)[\s-])?{{ordinal-en}}|(?:the\s+)?(?:(?:twenty|thirty)[\s-])?{{ordinal-en}}\s+of\s+{{month-en}})(?:,?\s+[0-9]{4})?\b", 0.9),
    _R("date-words-es", "Date", r"\b{{day-es}}\s+de\s+{{month-es}}(?:\s+de\s+[0-9]{4})?\b", 0.9),
    _R("age-over-89", "AgeOver89", r"\b(?:9[0-9]|1[0-9]{2})[ -]?(?:years?[ -]old|year[ -]old|años|anos)\b", 0.9),
    _R("age-over-89-words", "AgeOver89", r"\b(?:ninety(?:[\s-](?:one|two|three|four|five|six|seven|eight|nine))?|(?:one\s+)?hundred(?:\s+(?:and\s+)?[a-z]+(?:[\s-][a-z]+)?)?|noventa(?:\s+y\s+(?:uno|dos|tres|cuatro|cinco|seis|siete|ocho|nueve))?|cien|ciento(?:\s+[a-zá-ú]+)?)[\s-]*(?:years?[\s-]old|year[\s-]old|años|anos)\b", 0.9),
    _R("age-over-89-said", "AgeOver89", r"\b(?:age|edad)\s*:?\s*(?:9[0-9]|1[0-2][0-9])\b(?!\s*(?:over|/|-|\.[0-9]))", 0.9),
]


def _alternation(words: list[str]) -> str:
    """A pattern for the words that prefers longer ones and reads each character once: words with a common beginning share it."""

    def tree(rows: list[list[str]]) -> str:
        heads: dict[str, list[list[str]]] = {}
        for row in rows:
            if row:
                heads.setdefault(row[0], []).append(row[1:])
        if not heads:
            return ""
        body = "|".join(head + tree(rest) for head, rest in sorted(heads.items()))
        return f"(?:{body})" + ("?" if any(not row for row in rows) else "")

    units = lambda w: [r"\s{1,4}" if x.isspace() else re.sub(r"([.\\+*?\[^\]$(){}=!<>|:#-])", r"\\\1", x) for x in re.findall(r"\s+|.", w)]
    return tree([units(w) for w in dict.fromkeys(words)])


def expanded(regex: str, lists: dict[str, list[str]]) -> str | None:
    """The regex with each {{list}} as an alternation, longest first; None if a list is unknown."""
    names = re.findall(r"\{\{([a-z0-9-]+)\}\}", regex)
    if any(not lists.get(n) for n in names):
        return None
    for n in names:
        regex = regex.replace("{{" + n + "}}", _alternation(lists[n]))
    return regex


@dataclass(frozen=True)
class Policy:
    name: str = "safe-harbor"
    version: str = "0.3"
    min_confidence: float = 0.7
    actions: dict[str, str] = field(default_factory=lambda: dict(SAFE_HARBOR))

    def action(self, kind: str) -> str:
        return self.actions.get(kind, "Label")

    def departures(self) -> list[str]:
        """How it differs from the built-in policy."""
        out = [f"{k}: {self.action(k)} instead of {SAFE_HARBOR.get(k, 'Label')}" for k in KINDS if self.action(k) != SAFE_HARBOR.get(k, "Label")]
        return out + ([f"minConfidence: {self.min_confidence} instead of 0.7"] if self.min_confidence != 0.7 else [])

    def fingerprint(self) -> str:
        return short(f"{self.name}|{self.version}|{self.min_confidence}|" + ";".join(f"{k}={self.action(k)}" for k in KINDS))


SAFE_HARBOR = dict.fromkeys((*PERSONS, "Organization", "Product"), "Surrogate") | dict.fromkeys("Phone Email Url IpAddress Address RecordNumber AccountNumber DeviceId Other City".split(), "Label")
SAFE_HARBOR |= {"PostalCode": "Generalize", "AgeOver89": "Generalize", "Date": "YearOnly", "State": "Keep"}


#: The pools, of heads and of tails, that names of a kind are invented from; other kinds are labelled.
POOLS = dict.fromkeys(PERSONS, ("given", "family")) | {"Organization": ("company", "companySuffix"), "Product": ("product", "productSuffix")}


def short(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()[:16]


@dataclass(frozen=True)
class Lineage:
    """Pools of invented names, labels, rules, lists, values and policies; given parts replace or extend the built-in ones."""

    name: str = "core"
    version: str = "1"
    language: str | None = None
    pools: dict[str, list[str]] = field(default_factory=lambda: {"given": "Aurel Belisa Corvin Dalma Edric Fenna Gorian Halda Ismer Jovena".split(), "family": "Askarov Belmonde Cravath Dunmore Estavan Farrow Galdino Hartwell Ivarsen Jolliet".split()})
    labels: dict[str, str] = field(default_factory=lambda: dict(LABELS))
    generalizations: dict[str, str] = field(default_factory=lambda: dict(GENERAL))
    values: dict[str, list[str]] = field(default_factory=dict)
    lists: dict[str, list[str]] = field(default_factory=lambda: dict(LISTS))
    rules: list[Rule] = field(default_factory=lambda: list(RULES))
    policies: dict[str, Policy] = field(default_factory=lambda: {"safe-harbor": Policy()})
    skipped: tuple[str, ...] = ()

    @classmethod
    def from_json(cls, text: str) -> Lineage:
        """Unknown kinds are skipped and reported; unknown actions, person values and reserved names are refused."""
        raw = {k: v for k, v in json.loads(text).items() if not k.startswith("_")}
        if not raw.get("lineage") or not raw.get("version"):
            raise ValueError("a lineage needs 'lineage' and 'version'")
        known = {k.lower(): k for k in KINDS}
        base, skipped = cls(name=raw["lineage"], version=raw["version"], language=raw.get("language")), []

        def kinds(part: str) -> dict:
            out = {}
            for k, v in raw.get(part, {}).items():
                if k.startswith("_"):
                    continue
                if k.lower() in known:
                    out[known[k.lower()]] = v
                else:
                    skipped.append(f"{part}:{k}")
            return out

        values = kinds("values")
        if any(k in PERSONS for k in values):
            raise ValueError("values of persons are never shared")
        for n in raw.get("lists", {}):
            if n in LISTS or not re.fullmatch(r"[a-z0-9-]+", n):
                raise ValueError("a list may not take a built-in or odd name")
        policies = dict(base.policies)
        for n, p in raw.get("policies", {}).items():
            if n == "safe-harbor":
                raise ValueError("safe-harbor is reserved")
            if any(a not in ACTIONS for a in p.get("actions", {}).values()):
                raise ValueError(f"policy {n} names an unknown action")
            actions = dict(SAFE_HARBOR) | {known[k.lower()]: a for k, a in p.get("actions", {}).items() if k.lower() in known}
            skipped += [f"policies:{k}" for k in p.get("actions", {}) if k.lower() not in known]
            policies[n] = Policy(n, p.get("version", "1"), p.get("minConfidence", 0.7), actions)
        rules = base.rules
        if "patterns" in raw:
            rules = []
            for r in raw["patterns"]:
                if not r.get("regex") or r.get("kind", "").lower() not in known:
                    skipped.append(f"patterns:{r.get('id')}")
                else:
                    rules.append(Rule(r["id"], known[r["kind"].lower()], r["regex"], r.get("confidence", 0.9)))
        return replace(base, pools=base.pools | raw.get("pools", {}), labels=base.labels | kinds("labels"), generalizations=base.generalizations | kinds("generalizations"), values=values, lists=base.lists | raw.get("lists", {}), rules=rules, policies=policies, skipped=tuple(skipped))

    def minted_kinds(self) -> list[str]:
        """Kinds that names can be invented for: persons need both pools, the others heads alone."""
        return [k for k, (head, tail) in POOLS.items() if self.pools.get(head) and (k not in PERSONS or self.pools.get(tail))]

    def heads(self) -> list[str]:
        return sorted({h for pool in ("given", "company", "product") for h in self.pools.get(pool, [])}, key=lambda h: (-len(h), h))

    def compiled(self) -> tuple[list[Rule], list[str]]:
        """Rules with their lists filled in, and the ids of those that cannot be."""
        out, bad = [], []
        for r in self.rules:
            regex = expanded(r.regex, self.lists)
            out.append(replace(r, regex=f"(?iu){regex}")) if regex else bad.append(r.id)
        return out, bad

    def fingerprint(self) -> str:
        return short(json.dumps([self.name, self.version, self.pools, self.labels, self.generalizations, self.values, self.lists, [(r.id, r.kind, r.regex, r.confidence) for r in self.rules]], sort_keys=True))


def rule_print(rule: str) -> str:
    """The fingerprint of a rule that is no pattern, over all the values it reads."""
    read = {
        "relatives": [LISTS["kinship"], LISTS["caregiver"], LISTS["possessive"], LISTS["title"]],
        "birth-year": [BIRTH_CUE, 40, 90],
        "spoken-digits": [DIGITS, [LISTS[f"cue-{c}"] for c in ("record", "account", "zip", "phone")], 32, 4, 6],
        "census": [ZIP_THRESHOLD, sorted(KEPT_PREFIXES)],
    }
    return short(json.dumps([rule, read[rule]], ensure_ascii=False))
