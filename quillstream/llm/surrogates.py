"""Personal data replaced by keyed, type-consistent surrogates.

Detected entities (e-mail and IP addresses, phone, card and account numbers, national ids, IBANs,
secrets, person names) get surrogates of the same kind and shape.  Numbers, addresses and secrets go
through a keyed permutation of all strings of their shape: each character keeps its class (digit, or
letter of the same script and case), check digits are made valid again, and no value maps to itself.
Names keep gender and script: listed given names are permuted among themselves, all others are put
together from syllables, with the endings of their gender.

A surrogate depends on the key and the entity alone, so an entity has the same surrogate wherever it
occurs.  Permutations are one to one by themselves.  Names from syllables are checked over the corpus:
of names with one surrogate all but the first, in their order, get syllables that spell their rank.  Such
names are longer than any name without a rank and tell rank and stem apart, so they cannot collide again:
one round is enough, however many names there are.  These rare ranks reach the documents by a join.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import map_in_arrow, written

#: Replace this in production; whoever knows the key can undo the number permutations.
DEFAULT_KEY = "quillstream-surrogate-key"

# Titles with the gender that they tell, and given names.
TITLES = {"Mr": "m", "Mister": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Dr": "", "Prof": "", "Herr": "m", "Frau": "f", "Monsieur": "m", "Madame": "f", "Mme": "f", "Mlle": "f", "Señor": "m", "Señora": "f", "Sr": "m", "Sra": "f", "Господин": "m", "Госпожа": "f"}
MALE = "James John Robert Michael William David Richard Joseph Thomas Charles Christopher Daniel Matthew Anthony Steven Andrew Kenneth George Joshua Kevin Brian Edward Ronald Timothy Jason Jeffrey Ryan Jacob Gary Nicholas Hans Klaus Jürgen Wolfgang Dieter Pierre Jacques Philippe François Carlos José Miguel Antonio Javier Mohammed Ahmed Ali Omar Hassan Ivan Dmitri Sergei Vladimir Rajesh Sanjay Amit Arjun Vikram Wei Jun Hiroshi Kenji Takashi Minh Giovanni Giuseppe Luigi Marco Lars Erik Olaf Piotr Pawel João Pedro Luis Diego".split()
FEMALE = "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Lisa Margaret Sandra Ashley Kimberly Emily Donna Michelle Carol Amanda Melissa Deborah Stephanie Rebecca Laura Helen Sharon Cynthia Kathleen Ursula Ingrid Sabine Monika Renate Nathalie Isabelle Sylvie Françoise Carmen Josefa Dolores Pilar Lucía Jane Alice Emma Olivia Sophia Hannah Fatima Aisha Zainab Layla Olga Svetlana Natasha Tatiana Priya Anjali Deepa Sunita Mei Yuki Keiko Sakura Giulia Francesca Chiara Astrid Ingeborg Agnieszka Katarzyna Ana Beatriz Inês".split()
MALE_CYRILLIC = "Александр Сергей Владимир Андрей Алексей Дмитрий Николай Иван Михаил Евгений".split()
FEMALE_CYRILLIC = "Елена Ольга Наталья Татьяна Ирина Анна Светлана Мария Людмила Екатерина".split()
GIVEN = {("m", "latin"): MALE, ("f", "latin"): FEMALE, ("m", "cyrillic"): MALE_CYRILLIC, ("f", "cyrillic"): FEMALE_CYRILLIC}
_GENDER_OF = {name: gender for (gender, _), names in GIVEN.items() for name in names}
#: Words before a colon that announce a person, and words that show an office there instead.
CUES = "Contact Author Attn Patient Signed Kontakt Ansprechpartner Autor Auteur Contacto Контакт Автор".split()
OFFICES = frozenset("Customer Sales Support Technical Press Media Human Public Staff Us The Our Information Service General Help Data Legal Privacy Web Site Home Phone Email".split())
SPECIAL_NETWORKS = [ipaddress.IPv4Network(n) for n in ("0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.168.0.0/16", "224.0.0.0/4", "240.0.0.0/4")]
#: Parts of made names: open syllables, and endings of which none ends in another.
SYLLABLES = {"latin": [c + v for c in "bdfgklmnprstvz" for v in "aeiou"], "cyrillic": [c + v for c in "бвгдзклмнпрст" for v in "аеиоу"]}
ENDINGS = {
    ("surname", "latin"): "son man ley ton ner bard lins well".split(), ("given-m", "latin"): "bert mund rick nald".split(),
    ("given-f", "latin"): "lina rine dora beth".split(), ("given-u", "latin"): "ryn kis lex den".split(),
    ("given-m", "cyrillic"): "мир слав дан".split(), ("given-f", "cyrillic"): "лина мила рида".split(), ("given-u", "cyrillic"): "ким рус нат".split(),
}
# Endings of Cyrillic surnames, which tell the gender; a surname keeps its own.
SURNAME_ENDINGS = "ская ский ова ева ёва ина ына ов ев ёв ин ын ко ук юк ых".split()
#: Syllables of a made name without a rank.
STEM = 3

#: A text without any of these characters and without a name holds no entity.
_HINT = re.compile(r"[@\d=:]|A(?:KIA|SIA|GPA|IDA|ROA|Iza)|gh[pousr]_|sk-|xox[abprs]-")
_UPPER, _REST = "A-ZÀ-ÖØ-ÞЀ-Я", "a-zß-öø-ÿа-ёA-ZÀ-ÖØ-ÞЀ-Я'’"
_NAME_WORD = f"[{_UPPER}][{_REST}]+(?:-[{_UPPER}][{_REST}]+)?"
_BETWEEN = f"(?:[ \u00a0][{_UPPER}]\\.)*(?:[ \u00a0](?:van der|van den|van|von der|von|de la|del|de|da|di|du|bin|al|el))?[ \u00a0]"
_NAME = re.compile(
    rf"\b(?P<title>{'|'.join(sorted(TITLES, key=len, reverse=True))})\.?[ \u00a0](?P<first>{_NAME_WORD})(?:{_BETWEEN}(?P<last>{_NAME_WORD}))?"
    rf"|\b(?P<given>{'|'.join(sorted(_GENDER_OF))}){_BETWEEN}(?P<family>{_NAME_WORD})"
    rf"|\b(?:{'|'.join(CUES)}): ?(?P<cued>{_NAME_WORD}){_BETWEEN}(?P<own>{_NAME_WORD})"
)
#: Words that a name may start with; a first look for them passes over nearly all texts.
_HEADS = frozenset([*TITLES, *_GENDER_OF, *CUES])
_HEAD = re.compile(rf"[{_UPPER}]\w+")
_NUMBERS = re.compile(
    r"(?P<email>(?<![\w.+-])[\w](?:[\w.+%'-]*[\w+])?@(?:[^\W_](?:[\w-]*[^\W_])?\.)+[^\W\d_]{2,24}(?![\w-]))"
    r"|(?P<iban>\b[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?\b)"
    r"|(?P<aws>\b(?:AKIA|ASIA|AGPA|AIDA|AROA)[A-Z0-9]{16}\b)"
    r"|(?P<vendor>\b(?:gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{30,}))"
    r"|(?i:\b(?:password|passwd|pwd|passphrase|secret|token|api[_-]?key|access[_-]?key|auth[_-]?token|client[_-]?secret)[\"']?\s{0,3}(?:=|:)\s{0,3})(?P<quote>[\"']?)(?P<secret>[A-Za-z0-9_\-+/.~$!#%^&*]{6,}[A-Za-z0-9_\-+/])"
    r"|(?P<ipv4>(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\w|\.\d))"
    r"|(?P<ipv6>(?<![\w:])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[23][0-9A-Fa-f]{3}|[Ff][C-Fc-f][0-9A-Fa-f]{2})(?=[0-9A-Fa-f:]*::)(?::{1,2}[0-9A-Fa-f]{1,4})*(?:::)?)(?![\w:]))"
    r"|(?P<card>(?<![\w.,-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?![\w]|[.,-]\d))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<phone>(?<![\w.])(?:\+\d{1,3}[ .-]?\(\d{1,4}\)[ .-]?|\+\d{1,3}[ .-]?|\(\d{2,4}\)[ .-]?|\d{2,4}[.-]|0\d{2,4}[ /])\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?![\w-]))"
)
_CAPITAL = re.compile(rf"(?<!\w)[{_UPPER}]\w*(?:[-'’]\w+)*")
_PART = re.compile(r"\w+")
_DATE = re.compile(r"\d{4}[.-]\d{1,2}[.-]\d{1,2}|\d{1,2}[.-]\d{1,2}[.-]\d{4}")


class Entity(NamedTuple):
    """A part of a text: what it is, its canonical form, and for names gender and script."""

    start: int
    end: int
    kind: str
    value: str


def find_entities(text: str) -> list[Entity]:
    """Entities of a text, in order, not overlapping."""
    found: list[Entity] = []
    if _HINT.search(text):
        for m in _NUMBERS.finditer(text):
            kind = m.lastgroup if m.lastgroup != "quote" else "secret"
            start, end = m.span(kind)
            raw = m[kind]
            if kind == "phone":
                digits = re.sub(r"\D", "", raw)
                if not 8 <= len(digits) <= 15 or _DATE.fullmatch(raw) or raw[0] not in "+(0" and len(digits) < 9:
                    continue
                value = ("+" if raw[0] == "+" else "") + digits
            elif kind == "iban":
                value = raw.replace(" ", "")
                if not 15 <= len(value) <= 34 or _mod97(value) != 1 or not 2 <= int(value[2:4]) <= 98:
                    continue
            elif kind in ("card", "ssn"):
                value = re.sub(r"\D", "", raw)
                if kind == "card" and _luhn(value):
                    continue
            elif kind == "email":
                value = raw.lower()
            elif kind == "ipv6":
                try:
                    value = str(ipaddress.IPv6Address(raw))
                except ValueError:
                    continue
            elif kind == "secret" and not any(map(str.isalnum, raw)):  # a mask, not a secret
                continue
            else:
                value = raw
            found.append(Entity(start, end, kind, value))
    taken, names = [(e.start, e.end) for e in found], []
    for m in () if _HEADS.isdisjoint(_HEAD.findall(text)) else _NAME.finditer(text):
        if any(s < m.end() and m.start() < e for s, e in taken):
            continue
        if m["given"]:
            gender, first, last = _GENDER_OF[m["given"]], m.span("given"), m.span("family")
        elif m["cued"]:
            if not OFFICES.isdisjoint((m["cued"], m["own"])):
                continue
            gender, first, last = "", m.span("cued"), m.span("own")
        elif m["last"]:
            gender, first, last = TITLES[m["title"]], m.span("first"), m.span("last")
        else:
            gender, first, last = TITLES[m["title"]], None, m.span("first")
        if first:
            name, place = _without_genitive(text, *first)
            names.append(Entity(*place, f"given-{_GENDER_OF.get(name, gender) or 'u'}", name))
        name, place = _without_genitive(text, *last)
        names.append(Entity(*place, "surname", name))
    told = {e.value: e.kind for e in names if e.kind in ("given-m", "given-f")}  # one gender for a name in a text
    names = [e._replace(kind=told.get(e.value, e.kind)) if e.kind == "given-u" else e for e in names]
    if names:
        found += names + _mentions(text, names, taken + [(e.start, e.end) for e in names])
    return sorted(found)


def _without_genitive(text: str, start: int, end: int) -> tuple[str, tuple[int, int]]:
    """A name and its place, without the ending of its genitive ("Smith's", "Jones'")."""
    name = re.sub(r"['’]s?$", "", text[start:end])
    return name, (start, start + len(name))


def _mentions(text: str, names: list[Entity], spans: list[tuple[int, int]]) -> list[Entity]:
    """Bare mentions of the names of a text outside `spans`: whole words, as found or in capitals."""
    forms: dict[str, tuple[str, str]] = {}
    for e in names:
        forms.setdefault(e.value, (e.kind, e.value))
    for kind, value in list(forms.values()):
        forms.setdefault(value.upper(), (kind, value))
    longest = max(len(_PART.findall(form)) for form in forms)
    spans, found = sorted(spans), []
    for m in _CAPITAL.finditer(text):
        parts, i = [p.span() for p in _PART.finditer(m[0])], 0
        while i < len(parts):
            for j in range(min(i + longest, len(parts)), i, -1):
                start, end = m.start() + parts[i][0], m.start() + parts[j - 1][1]
                known = forms.get(text[start:end])
                before = bisect_left(spans, (end,))
                if known and not (before and spans[before - 1][1] > start):
                    found.append(Entity(start, end, *known))
                    i = j - 1
                    break
            i += 1
    return found


def _mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def _luhn(digits: str) -> int:
    """Luhn sum modulo 10 of a number with its check digit."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10


class Surrogates:
    """Surrogates under one key."""

    def __init__(self, key: str):
        self.key = key.encode()

    def _hash(self, *parts: object) -> int:
        return int.from_bytes(hashlib.blake2b("\0".join(map(str, parts)).encode("utf-8", "surrogatepass"), key=self.key[:64], digest_size=16).digest(), "big")

    def _permute(self, x: int, size: int, tweak: str, back: bool = False) -> int:
        """A keyed permutation of range(size): a Feistel network, walked until it is in range."""
        half = max(1, (size.bit_length() + 1) // 2)
        mask = (1 << half) - 1
        while True:
            a, b = x >> half, x & mask
            for r in range(4):
                if back:
                    a, b = b ^ self._wide(tweak, 3 - r, a, half), a
                else:
                    a, b = b, a ^ self._wide(tweak, r, b, half)
            x = a << half | b
            if x < size:
                return x

    def _wide(self, tweak: str, r: int, x: int, bits: int) -> int:
        out, at = 0, 0
        while at * 128 < bits:
            out = out << 128 | self._hash(tweak, r, x, at)
            at += 1
        return out & ((1 << bits) - 1)

    def _moved(self, x: int, size: int, tweak: str) -> int:
        """A permutation of range(size) without fixed points: one step of a keyed cycle through all."""
        return self._permute((self._permute(x, size, tweak) + 1) % size, size, tweak, back=True) if size > 1 else x

    def shaped(self, value: str, tweak: str, alphabet: str = "") -> str:
        """Another string of the same shape; one to one among the strings of that shape."""
        digits, sizes, pools = [], [], []
        for c in value:
            pool = alphabet if alphabet else _pool(c)
            pools.append(pool)
            if pool and len(pool) > 1:
                digits.append(pool.index(c))
                sizes.append(len(pool))
        x, size = 0, 1
        for d, s in zip(digits, sizes):
            x, size = x * s + d, size * s
        shape = "".join(p[0] if p else c for c, p in zip(value, pools))
        x = self._moved(x, size, f"{tweak}/{shape}")
        out: list[str] = []
        for c, pool in zip(reversed(value), reversed(pools)):
            if pool and len(pool) > 1:
                x, d = divmod(x, len(pool))
                c = pool[d]
            out.append(c)
        return "".join(reversed(out))

    def _walk(self, value: str, tweak: str, of_class, alphabet: str = "") -> str:
        """`shaped` again and again until the result is in the value's class: one to one within each class."""
        own, out = of_class(value), self.shaped(value, tweak, alphabet)
        while of_class(out) != own:
            out = self.shaped(out, tweak, alphabet)
        return out

    def surrogate(self, kind: str, value: str, ranks: dict[tuple[str, str], int] | None = None) -> str:
        """The canonical surrogate of a canonical entity; `ranks` holds those of names, where there is one."""
        if kind == "email":
            local, _, domain = value.rpartition("@")
            host, _, top = domain.rpartition(".")
            return f"{self.shaped(local, f'email/{domain}')}@{self.shaped(host, 'domain')}.{top}"
        if kind == "phone":
            plus = value[0] == "+"
            code = 1 + (1 if value[1] in "17" else 2) if plus else 0
            head, rest = value[:code], value[code:]
            north = head in ("", "+1") and len(rest) == 10
            return head + self._walk(rest, f"phone/{head}", lambda x: (x[0] == "0", north and x[0] > "1" and x[3] > "1"))
        if kind == "card":
            made = value[0] + self.shaped(value[1:-1], f"card/{value[0]}")
            return made + next(d for d in "0123456789" if _luhn(made + d) == 0)
        if kind == "iban":
            body = self.shaped(value[4:], f"iban/{value[:2]}")
            return f"{value[:2]}{98 - _mod97(value[:2] + '00' + body):02d}{body}"
        if kind == "ssn":
            return self._walk(value, kind, lambda x: (x[0] == "9", x[:3] in ("000", "666") or x[3:5] == "00" or x[5:] == "0000"))
        if kind == "ipv4":
            address = ipaddress.IPv4Address(value)
            for net in SPECIAL_NETWORKS:
                if address in net:  # stays in its network
                    base = int(net.network_address)
                    return str(ipaddress.IPv4Address(base + self._moved(int(address) - base, net.num_addresses, f"ipv4/{net}")))
            while True:
                address = ipaddress.IPv4Address(self._moved(int(address), 1 << 32, kind))
                if not any(address in net for net in SPECIAL_NETWORKS):
                    return str(address)
        if kind == "ipv6":
            return self._ipv6(value)
        if kind == "aws":
            return value[:4] + self.shaped(value[4:], kind + value[:4])
        if kind == "vendor":
            head = re.match(r"[A-Za-z]+[_-]|AIza", value)[0]
            return head + self.shaped(value[len(head) :], kind + head)
        if kind == "secret":
            form = _secret_form(value)
            return self._walk(value, f"{kind}/{form}", _secret_form, "0123456789abcdef" if form == "hex" else "")
        return "-".join(self.name(k, v, (ranks or {}).get((k, v), 0)) for k, v in units(kind, value))

    def _ipv6(self, value: str) -> str:
        """Keeps the first group and the groups that are zero; moves the others together."""
        number = int(ipaddress.IPv6Address(value))
        groups = [number >> 16 * (7 - i) & 0xFFFF for i in range(8)]
        at = [i for i in range(1, 8) if groups[i]] or [0] * (groups[0] > 0)
        x = 0
        for i in at:
            x = x * 0xFFFF + groups[i] - 1
        x = self._moved(x, 0xFFFF ** len(at), f"ipv6/{at}/{groups[0] if at != [0] else ''}")
        for i in reversed(at):
            x, rest = divmod(x, 0xFFFF)
            groups[i] = rest + 1
        return str(ipaddress.IPv6Address(sum(g << 16 * (7 - i) for i, g in enumerate(groups))))

    def name(self, kind: str, value: str, rank: int = 0) -> str:
        """The surrogate of one name without hyphens."""
        script = _script(value)
        pool = GIVEN.get((kind[-1], script), ()) if kind != "surname" else ()
        if value in pool:
            return pool[self._moved(pool.index(value), len(pool), kind)]
        if script == "other":
            return self.shaped(value, kind)
        root, ending, letters = value, "", SYLLABLES[script]
        if (kind, script) == ("surname", "cyrillic"):
            ending = next((e for e in SURNAME_ENDINGS if value.endswith(e) and len(value) > len(e) + 1), "")
            root = value[: len(value) - len(ending)] + ("" if ending else "-")
        for salt in range(3):  # a made name that is the name itself is made anew
            pick, made = self._hash(kind, root, salt), ""
            for _ in range(STEM):
                pick, i = divmod(pick, len(letters))
                made += letters[i]
            left, spelt = rank, ""
            while left:
                left, i = divmod(left, len(letters))
                spelt = letters[i] + spelt
            made += spelt
            if (kind, script) == ("surname", "cyrillic"):
                made += letters[pick % len(letters)][0] + (ending or "ук")
            else:
                made += ENDINGS[kind, script][pick % len(ENDINGS[kind, script])]
            if made != value.lower():
                break
        return made.capitalize()

    def render(self, entity: Entity, raw: str, ranks: dict[tuple[str, str], int] | None = None) -> str:
        """The surrogate in the format in which the entity was written."""
        made = self.surrogate(entity.kind, entity.value, ranks)
        if entity.kind in ("phone", "card", "ssn", "iban"):
            chars = iter(made.lstrip("+"))
            return "".join(next(chars) if c.isalnum() else c for c in raw)
        if entity.kind == "ipv6" and "::" not in raw:
            made = ":".join(f"{int(g, 16):x}" for g in ipaddress.IPv6Address(made).exploded.split(":"))
        if raw.isupper() and (entity.kind in ("email", "ipv6") or raw != entity.value and entity.kind.startswith(("given-", "surname"))):
            return made.upper()
        return made


def units(kind: str, value: str) -> list[tuple[str, str]]:
    """The parts of a hyphenated name, each of which has a surrogate of its own."""
    if not kind.startswith(("given-", "surname")):
        return [(kind, value)]
    parts = value.split("-")
    return [(f"given-{_GENDER_OF.get(p, kind[-1])}" if kind != "surname" else kind, p) for p in parts]


def _secret_form(value: str) -> str:
    return "digits" if value.isdigit() else "hex" if re.fullmatch(r"[0-9a-f]+", value) else "mixed"


@lru_cache(maxsize=4096)
def _pool(c: str) -> str:
    """The letters of a character's script and case, or the digits; empty for anything else."""
    if "0" <= c <= "9":
        return "0123456789"
    if "a" <= c <= "z" or "A" <= c <= "Z":
        return "abcdefghijklmnopqrstuvwxyz" if c.islower() else "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    if c.isdecimal():
        return "".join(chr(ord(c) - int(c) + i) for i in range(10))
    if not c.isalpha():
        return ""
    start = ord(c) & ~31 if not 0x410 <= ord(c) < 0x450 else 0x410 + (ord(c) - 0x410) // 32 * 32
    return "".join(x for x in map(chr, range(start, start + 32)) if x.isalpha() and x.isupper() == c.isupper() and x.islower() == c.islower())


def _script(value: str) -> str:
    return "latin" if ord(value[0]) < 0x370 else "cyrillic" if 0x400 <= ord(value[0]) < 0x530 else "other"


_makers: dict[str, Surrogates] = {}


def _maker(key: str) -> Surrogates:
    if key not in _makers:
        _makers[key] = Surrogates(key)
    return _makers[key]


def occurrences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, kind, value) of the distinct entities of each text, hyphenated names as their parts.

    Null and empty texts have none; repeated rows and null ids count like others.  Other columns are left
    out, whatever their names.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, kinds, values = [], [], []
            for i, text in enumerate(batch.column("text")):
                for k, v in {u for e in find_entities(text.as_py() or "") for u in units(e.kind, e.value)}:
                    at.append(i)
                    kinds.append(k)
                    values.append(v)
            if at:
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at)), pa.array(kinds, pa.string()), pa.array(values, pa.string())], names=["id", "kind", "value"])

    return map_in_arrow(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, f"id {kind}, kind string, value string")


def name_ranks(entities: DataFrame, key: str = DEFAULT_KEY) -> DataFrame:
    """(kind, value, rank) of the names that are not the first of those with their surrogate.

    `entities` holds (kind, value), repeated or not, null or not; entities that are no names and null
    values have no rank, and an empty table gives no rows.  Only names are shuffled, after partial
    aggregation, and those with one surrogate stand in one window: a few millionths of all names.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = _maker(key)
        for batch in batches:
            made = [maker.name(k, v) for k, v in zip(*(batch.column(i).to_pylist() for i in range(2)))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], names=["kind", "value", "made"])

    names = entities.filter("kind = 'surname' or kind like 'given-%'").filter("value <> ''").select("kind", "value").distinct()
    made = written(names.mapInArrow(make, "kind string, value string, made string"), "names")
    shared = made.groupBy("kind", "made").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    order = Window.partitionBy("kind", "made").orderBy("value")
    ranked = made.join(shared, ["kind", "made"]).select("kind", "value", (F.row_number().over(order) - 1).alias("rank"))
    return written(ranked.filter("rank > 0"), "ranks")


def replace_entities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: str = DEFAULT_KEY, keep: Sequence[str] = ()) -> DataFrame:
    """Texts with surrogates in the place of all detected entities.

    Returns id, text, n_entities and kinds (distinct, sorted, of what was replaced): one row per input
    row, repeated rows and null ids included.  A null text stays null and an empty one empty, with no
    entities.  Texts are read whole and nothing else in them changes.  Other columns are left out, but
    for those in `keep`, which come along in a struct named kept.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    found = written(occurrences(docs, id_col, text_col), "entities")
    ranked = name_ranks(found, key)
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *([F.struct(*keep).alias("kept")] if keep else []))
    schema = f"`{id_col}` {kind}, `{text_col}` string, n_entities long, kinds array<string>"
    schema += f", kept {chosen.schema['kept'].dataType.simpleString()}" if keep else ""
    names = [id_col, text_col, "n_entities", "kinds", *(["kept"] if keep else [])]
    if ranked.isEmpty():
        chosen = chosen.withColumn("ranks", F.lit(None).cast("array<struct<kind:string,value:string,rank:int>>"))
    else:
        own = found.join(ranked, ["kind", "value"]).groupBy(F.col("id").alias("at")).agg(F.collect_set(F.struct("kind", "value", "rank")).alias("ranks"))
        chosen = chosen.join(written(own, "own-ranks"), F.col("id").eqNullSafe(F.col("at")), "left").drop("at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = _maker(key)
        for batch in batches:
            texts, counts, kinds = [], [], []
            for text, ranks in zip(batch.column("text"), batch.column("ranks")):
                text = text.as_py()
                found = find_entities(text) if text else []
                if found:
                    known = {(x["kind"], x["value"]): x["rank"] for x in ranks.as_py() or ()}
                    parts, at = [], 0
                    for e in found:
                        parts += [text[at : e.start], maker.render(e, text[e.start : e.end], known)]
                        at = e.end
                    text = "".join([*parts, text[at:]])
                texts.append(text)
                counts.append(len(found))
                kinds.append(sorted({e.kind for e in found}))
            columns = [batch.column("id"), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(kinds, pa.list_(pa.string()))]
            columns += [batch.column("kept")] if keep else []
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return map_in_arrow(chosen, run, schema)
