"""Public suffixes. Callers can pass the rules of a public suffix file (``Suffixes.read``); built in is a subset: enough for common hosts; a last label that is not listed is no suffix of a valid host,
and an unlisted second level is taken as a registrable name."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

GENERIC = set(
    "com org net edu gov mil int info biz name pro aero coop museum jobs mobi travel tel cat asia post xxx app dev io blog shop site online store tech xyz club top live news media "
    "cloud page link click space website world today life email agency digital network systems solutions services group company global center academy games video tv web wiki art design "
    "music film photo photos pics studio style fashion beauty health care clinic dental fit run bike cafe pizza restaurant bar beer wine recipes kitchen house homes land estate rent "
    "cars auto bid deals sale discount cheap gifts toys work jobs careers expert guru tips guide help support chat social community foundation charity ngo ong church bible win vip icu "
    "gle goog google amazon apple ink one red blue green black pink lol wtf fun zone city town berlin london paris nyc tokyo africa example test".split()
)
COUNTRY = set(
    "ac ad ae af ag ai al am ao aq ar as at au aw ax az ba bb bd be bf bg bh bi bj bm bn bo br bs bt bv bw by bz ca cc cd cf cg ch ci ck cl cm cn co cr cu cv cw cx cy cz de dj dk dm do dz ec "
    "ee eg er es et eu fi fj fk fm fo fr ga gb gd ge gf gg gh gi gl gm gn gp gq gr gs gt gu gw gy hk hm hn hr ht hu id ie il im in io iq ir is it je jm jo jp ke kg kh ki km kn kp kr kw ky kz la "
    "lb lc li lk lr ls lt lu lv ly ma mc md me mg mh mk ml mm mn mo mp mq mr ms mt mu mv mw mx my mz na nc ne nf ng ni nl no np nr nu nz om pa pe pf pg ph pk pl pm pn pr ps pt pw py qa re ro rs "
    "ru rw sa sb sc sd se sg sh si sk sl sm sn so sr ss st su sv sx sy sz tc td tf tg th tj tk tl tm tn to tr tt tv tw tz ua ug uk us uy uz va vc ve vg vi vn vu wf ws ye yt za zm zw".split()
)
TOP = GENERIC | COUNTRY
_SECOND = {
    "uk": "ac co gov ltd me net nhs org plc police sch", "au": "com net org edu gov asn id", "nz": "ac co geek gen govt iwi kiwi maori mil net org school", "jp": "ac ad co ed go gr lg ne or",
    "br": "com net org gov edu art blog eco ind inf jus leg mil mp tv", "cn": "ac com edu gov net org mil", "in": "co firm net org gen ind ac edu gov", "za": "ac co gov law net org web",
    "kr": "ac co go ne or pe re", "tr": "com net org gov edu bel biz gen info k12 name pol tv web", "tw": "com edu gov idv net org", "hk": "com edu gov idv net org", "sg": "com edu gov net org per",
    "my": "com edu gov net org name", "mx": "com edu gob net org", "ar": "com edu gob gov int net org tur", "il": "ac co gov k12 muni net org", "th": "ac co go in mi net or", "id": "ac co go mil net or sch web",
    "ua": "com edu gov net org in kiev lviv", "ru": "ac com edu gov int mil msk net org pp spb", "pl": "com edu gov net org biz info waw", "es": "com nom org gob edu", "pt": "com edu gov net org",
    "gr": "com edu gov net org", "at": "ac co gv or", "hu": "co info org", "ro": "com org info nom", "ir": "ac co gov id net org sch", "pk": "com edu gov net org", "vn": "com edu gov net org", "ph": "com edu gov net org",
    "eg": "com edu gov net org", "sa": "com edu gov net org", "ng": "com edu gov net org", "ke": "ac co go ne or", "co": "com edu gov net org nom", "pe": "com edu gob net org", "ve": "co com gob net org web",
    "cl": "gob gov mil co", "uy": "com edu gub net org", "ec": "com edu gob net org fin", "cy": "com ac gov net org", "fr": "asso com gouv nom tm", "it": "edu gov", "us": "k12 ca ny tx", "bd": "com edu gov net org",
    "lk": "com edu gov net org", "np": "com edu gov net org", "kz": "com edu gov net org", "by": "com gov mil of",
}
SECOND = {f"{x}.{tld}" for tld, names in _SECOND.items() for x in names.split()}


@dataclass(frozen=True)
class Suffixes:
    """Rules as in the public suffix list: ``rules`` as they stand, ``wild`` those under ``*.``, ``excepted`` those after ``!``."""

    rules: frozenset[str]
    wild: frozenset[str] = frozenset()
    excepted: frozenset[str] = frozenset()
    top: frozenset[str] = field(init=False)

    def __post_init__(self):
        object.__setattr__(self, "top", frozenset(x.rpartition(".")[2] for x in self.rules | self.wild))

    @classmethod
    def read(cls, lines: Iterable[str]) -> Suffixes:
        """From the lines of a suffix file: one rule a line, ``//`` begins a comment."""
        rules = [x.split()[0].lower() for x in lines if x.strip() and not x.startswith("//")]
        return cls(
            frozenset(x for x in rules if x[0] not in "*!"), frozenset(x[2:] for x in rules if x.startswith("*.")), frozenset(x[1:] for x in rules if x[0] == "!")
        )

    def known(self, top: str) -> bool:
        return top in self.top

    def size(self, labels: list[str]) -> int:
        """Labels of the longest suffix of a host; 1 if no rule is longer."""
        for n in range(len(labels), 1, -1):
            name, parent = ".".join(labels[-n:]), ".".join(labels[1 - n :])
            if name in self.excepted:
                return n - 1
            if name in self.rules or parent in self.wild:
                return n
        return 1


DEFAULT = Suffixes(frozenset(TOP) | SECOND)
