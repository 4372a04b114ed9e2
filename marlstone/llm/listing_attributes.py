"""What a listing says of its product: name, substance, form, strength and pack, in canonical writing.

The title comes first, then the sentences of the description that state the attribute, then the dosage field.
"""

from __future__ import annotations

import re
import unicodedata
from decimal import Decimal
from typing import NamedTuple

# Forms and their names, longest first where one holds another.
FORMS = {
    "pessary": ["vaginal tablets", "vaginal tablet", "pessaries", "pessary", "ovules", "ovule"],
    "patch": ["transdermal patches", "transdermal patch", "skin patches", "skin patch", "patches", "patch", "pflaster"],
    "sachet": ["powder sachets", "powder sachet", "stick packs", "stick pack", "sachets", "sachet"],
    "tablet": ["film-coated tablets", "film-coated tablet", "film coated tablets", "tablets", "tablet", "tabletten", "comprimidos", "comprimido", "comprimés", "tabs", "tab"],
    "capsule": ["hard capsules", "hard capsule", "capsules", "capsule", "kapseln", "kapsel", "caps", "cap"],
    "syrup": ["oral syrup bottle", "oral syrup", "bottle syrup", "syrup bottle", "syrup", "oral liquid", "liquid", "sirup", "jarabe"],
    "drops": ["oral drops bottle", "oral drops", "bottle drops", "drops bottle", "drops", "tropfen", "gotas"],
    "vial": ["injection vials", "injection vial", "vials", "vial", "ampoules", "ampoule", "ampules"],
}
LIQUIDS = {"syrup", "drops", "vial"}
MASS = {"ng": Decimal("0.001"), "nanograms": Decimal("0.001"), "ug": 1, "µg": 1, "μg": 1, "mcg": 1, "mikrogramm": 1, "microgram": 1, "micrograms": 1, "мкг": 1, "mg": 1000, "мг": 1000, "milligram": 1000, "milligrams": 1000, "milligramm": 1000, "g": 10**6, "gr": 10**6, "gr.": 10**6, "gram": 10**6, "grams": 10**6, "gramm": 10**6, "г": 10**6, "kg": 10**9}
VOLUME = {"ml": 1000, "мл": 1000, "cc": 1000, "millilitre": 1000, "millilitres": 1000, "milliliter": 1000, "milliliters": 1000, "cl": 10000, "centilitre": 10000, "centilitres": 10000, "l": 10**6, "litre": 10**6, "litres": 10**6, "liter": 10**6, "fl oz": Decimal("29573.53"), "fl. oz.": Decimal("29573.53"), "fl. oz": Decimal("29573.53")}
# Words of titles that tell nothing of the product.
MARKETING = """verified discreet shipping fast delivery limited stock free reship sealed box best price original genuine top quality hot deal new batch lab tested bulk discount sale offer promo cheap
    rx generic brand pack of pcs pc ct blister blisters bottle bottles per x n box and with the oral injection liquid film coated hard skin transdermal vaginal powder stick packs units unit pieces strips strip""".split()
_ALT = lambda names: "|".join(re.escape(n).replace(r"\ ", r"\s*") for n in sorted(names, key=lambda n: (-len(n), n)))
_NUM = r"(\d+(?:[.,]\d+)*)"
_STRENGTH = re.compile(rf"(?<![\w.,]){_NUM}\s*({_ALT(MASS)})(?!\w)(?:\s*(?:/|per|pro|por)\s*{_NUM}?\s*({_ALT(VOLUME)})(?!\w))?", re.I)
_VOLUME = re.compile(rf"(?<![\w.,/])(?:(\d+)\s*[x×]\s*)?{_NUM}\s*({_ALT(VOLUME)})(?!\w)", re.I)
_FORM_OF = {n: f for f, ns in FORMS.items() for n in ns}
_FORM = re.compile(rf"(?<!\w)({_ALT(_FORM_OF)})(?!\w)", re.I)
_F = _ALT(_FORM_OF)
_PACKS = [
    re.compile(rf"(?<![\w.,])(\d+)\s*(?:x|×|blisters?\s+of|strips?\s+of|packs?\s+of)\s*(\d+)\s*(?:{_F})(?!\w)", re.I),
    re.compile(rf"(?<!\w)(?:pack|box|bottle)\s+of\s+(\d+)\s*(?:{_F})?(?!\w)", re.I),
    re.compile(rf"(?<!\w)(?:{_F})\s*(?:\(\s*(\d+)\s*ct\s*\)|[x×]\s*(\d+)|n\s?(\d+))(?!\w)", re.I),
    re.compile(rf"(?<![\w.,])(\d+)\s*(?:pcs\s+|pieces\s+)?(?:{_F})(?!\w)", re.I),
]
_STATES_PACK = re.compile(r"(?:contents?:|supplied as|you get|each order holds|inhalt:|contenido:)\s*((?:[^.!?\n]|\.(?=\d))*)", re.I)
_STATES_STRENGTH = re.compile(r"(?:active content:?|dose per unit is|strength:?|wirkstoff:?)\s*([^!?\n]{0,60})", re.I)
_STATES_NAME = [re.compile(p) for p in (r"Brand:\s*([^\W\d_]{4,})", r"[Ss]old under the name\s+([^\W\d_]{4,})", r"This is\s+([^\W\d_]{4,})\s+in its")]
_NAME_OF = re.compile(r"(?:^|[.!?]\s+)([^\W\d_]{4,})\s*\(([^\W\d_]{4,})\)\s*\.")
_BESIDE = re.compile(r"(?<!\w)([^\W\d_]{4,})\s*\(\s*([^\W\d_]{4,})\s*\)")
_WORDS = re.compile(r"[^\W\d_]{3,}")
_UNIT_WORDS = {w for u in (*MASS, *VOLUME) for w in re.findall(r"[^\W\d_]+", u)}
_DROP = set(MARKETING) | _UNIT_WORDS | {w for n in _FORM_OF for w in n.split()}


class Listing(NamedTuple):
    words: tuple[str, ...]  # of the title, that aren't known for anything else
    name: str  # stated by the description, or ''
    substance: str  # stated beside a name, or ''
    generic: str  # a title word before 'Rx' or 'generic', or ''
    form: str
    strength: str  # micrograms, or micrograms per millilitre with '/ml'; '' if unknown
    pack: str  # units, or for liquids vessels x microlitres; '' if unknown


def _norm(text: str | None) -> str:
    return unicodedata.normalize("NFC", text or "").replace("\xa0", " ")


def _number(s: str) -> Decimal:
    if re.fullmatch(r"[1-9]\d{0,2}(,\d{3})+", s):
        return Decimal(s.replace(",", ""))
    return Decimal(s.replace(",", ".")) if s.count(",") + s.count(".") <= 1 else Decimal(re.sub(r"[.,](?=.*[.,])", "", s).replace(",", "."))


def _plain(d: Decimal) -> str:
    return format(round(d, 6).normalize(), "f")


def strength(text: str) -> str:
    m = _STRENGTH.search(text)
    if not m:
        return ""
    mass = _number(m.group(1)) * MASS[re.sub(r"\s+", " ", m.group(2).lower())]
    if m.group(4):
        vol = (_number(m.group(3)) if m.group(3) else Decimal(1)) * VOLUME[re.sub(r"\s+", " ", m.group(4).lower())] / 1000
        return _plain(mass / vol) + "/ml" if vol else ""
    return _plain(mass)


def form(text: str) -> str:
    m = _FORM.search(text)
    return _FORM_OF[re.sub(r"\s+", " ", m.group(1).lower())] if m else ""


def pack(text: str, kind: str) -> str:
    if kind in LIQUIDS or not kind:
        rest = _STRENGTH.sub(" ", text)
        m = _VOLUME.search(rest)
        if m:
            return f"{int(m.group(1) or 1)}x" + _plain(_number(m.group(2)) * VOLUME[re.sub(r"\s+", " ", m.group(3).lower())]) + "ul"
        if kind in LIQUIDS:
            return ""
    for p in _PACKS:
        m = p.search(text)
        if m:
            n = 1
            for g in m.groups():
                n *= int(g) if g else 1
            return str(n)
    return ""


def _only(found: set[str]) -> str:
    """The one thing that is said, '' if there is none or several contradict each other."""
    found.discard("")
    return found.pop() if len(found) == 1 else ""


def read(title: str | None, description: str | None, dosage: str | None) -> Listing:
    """The attributes of one listing; '' for what isn't stated.

    What neither title nor a statement of the description nor the dosage field tells is taken from any sentence of the description, if
    all that it says is one thing.
    """
    t, d, dose = _norm(title), _norm(description), _norm(dosage)
    said_pack = " ; ".join(_STATES_PACK.findall(d))
    f = form(t) or form(said_pack)
    s = strength(t)
    if not s:
        for x in _STATES_STRENGTH.findall(d):
            s = s or strength(x)
    if not s:
        found = {x for x in (strength(q) for q in dose.split("|")) if x}
        if f in LIQUIDS:  # a plain mass beside a concentration tells the content of something else
            found = {x for x in found if x.endswith("/ml")} or found
        s = found.pop() if len(found) == 1 else ""
    sentences = re.split(r"(?<=[.!?])\s+|\n", d) if not (f and s) else []
    f = f or _only({form(x) for x in sentences})
    s = s or _only({strength(x) for x in sentences})
    p = pack(t, f) or pack(said_pack, f)
    if not p:
        p = _only({pack(x, f) for x in re.split(r"(?<=[.!?])\s+|\n", d) if form(x) or f in LIQUIDS})
    name = substance = ""
    for pattern in _STATES_NAME:
        if m := pattern.search(d):
            name = m.group(1).lower()
            break
    if m := _NAME_OF.search(d):
        name, substance = name or m.group(1).lower(), m.group(2).lower()
    lower = t.lower()
    g = re.search(r"([^\W\d_]{3,})\s+(?:rx|generic)(?!\w)", lower)
    words = tuple(w for w in _WORDS.findall(lower) if w not in _DROP)
    if not substance and (m := _BESIDE.search(lower)) and m.group(1) in words and m.group(2) in words:
        substance = m.group(2)
    return Listing(words, name, substance, g.group(1) if g else "", f, s, p)
