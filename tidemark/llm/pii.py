"""Personal data replaced by keyed, type-consistent surrogates.

Each entity is replaced by another of its type and format: the characters of a class (digits,
lower or upper case letters of one script, hexadecimal digits) are permuted by a keyed
permutation over all strings of the same format, everything else stays. Cards, phones, IBANs and
hardware addresses are permuted without their blanks and signs, so spellings of one number stay
spellings of one number. Names on the lists below are exchanged for others of the same gender
and script; in other names vowels stand for vowels, consonants for consonants, and the last
letter, which often tells the gender, stays.

Names are found behind titles and where a listed given name stands before another name; once a
document names a person, the given name and the surname alone are found in it too. There is no
model of names: an unlisted given name without a title isn't found, nor are postal addresses.

A permutation can't map two entities to one surrogate, so distinctness holds over the whole
corpus without a table of what was seen, and one entity has one surrogate wherever it occurs.
Three checks guard it: permutations have no fixed points (nothing is replaced by itself); a
surrogate that leaves the set its original belongs to (octets in range, Luhn check passed, IBAN
check passed or not, name on a list or not) is permuted again until it is back, which keeps it a
permutation;
and :func:`collisions` finds entities that share a surrogate in any result.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Given names by gender and script, surnames by script, titles by gender.
GIVEN = {
    ("f", "latin"): "Alice Amelia Anna Anne Camille Carmen Charlotte Claire Clara Dolores Elena Emily Emma Eva Frieda Grace Greta Hannah Helen Ingrid Isabel Jane Julia Karen Laura Linda Lucia Maria Marie Martha Mary Mercedes Olivia Patricia Pilar Rosa Sarah Sofia Sophie Susan Ursula Victoria".split(),
    ("m", "latin"): "Albert Alexander Andrew Antonio Bernd Carlos Charles Daniel David Diego Edward Fernando Francois Frank George Hans Heinrich Henry Jack Jacques James Javier John Jorge Joseph Juergen Karl Klaus Luis Manuel Michael Miguel Oliver Oscar Pablo Paul Peter Pierre Richard Robert Thomas William".split(),
    ("f", "cyrillic"): "Анна Вера Дарья Екатерина Елена Ирина Мария Наталья Ольга Светлана Татьяна Юлия".split(),
    ("m", "cyrillic"): "Александр Алексей Борис Виктор Владимир Дмитрий Иван Михаил Николай Павел Сергей Юрий".split(),
    ("f", "greek"): "Άννα Ελένη Ιωάννα Κατερίνα Μαρία Σοφία".split(),
    ("m", "greek"): "Γιώργος Γιάννης Δημήτρης Κώστας Νίκος Παναγιώτης".split(),
}
SURNAMES = {
    "latin": "Adams Baker Becker Bernard Brown Carter Clark Davis Diaz Dubois Durand Evans Fischer Garcia Gomez Gonzalez Green Hall Hernandez Hoffmann Jackson Johnson Jones Keller Klein Lambert Laurent Lefebvre Leroy Lewis Lopez Martin Martinez Meyer Miller Moore Moreau Morel Moreno Muller Perez Petit Ramirez Robinson Rodriguez Roussel Ruiz Sanchez Schmidt Schneider Schulz Simon Smith Taylor Thompson Torres Turner Wagner Walker Weber White Williams Wilson Wolf Wright Young".split(),
    "cyrillic": "Волков Иванов Козлов Кузнецов Морозов Новиков Петров Попов Смирнов Соколов".split(),
    "greek": "Αγγελόπουλος Γεωργίου Δημητρίου Ιωάννου Νικολάου Παπαδόπουλος".split(),
}
TITLES = "Mr Mrs Ms Miss Dr Prof Sir Madam Herr Frau Monsieur Madame Mme Mlle Señor Señora Señorita Sr Sra Don Doña Господин Госпожа Κύριος Κυρία".split()

#: Alphabets whose characters replace each other.
ALPHABETS = [
    "0123456789",
    "abcdefghijklmnopqrstuvwxyz",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7),
    "".join(chr(c) for c in range(0xC0, 0xDF) if c != 0xD7),
    "".join(chr(c) for c in range(0x3B1, 0x3CA) if c != 0x3C2),
    "".join(chr(c) for c in range(0x391, 0x3AA) if c != 0x3A2),
    "".join(chr(c) for c in range(0x430, 0x450)),
    "".join(chr(c) for c in range(0x410, 0x430)),
    "".join(chr(c) for c in range(0x5D0, 0x5EB)),
    "".join(chr(c) for c in range(0x621, 0x63B)),
    "".join(chr(c) for c in range(0x3041, 0x3097)),
    "".join(chr(c) for c in range(0x30A1, 0x30FB)),
    "".join(chr(c) for c in range(0x4E00, 0xA000)),
]
_PLACE = {c: (str(k), i, a) for k, a in enumerate(ALPHABETS) for i, c in enumerate(a)}
#: Vowels that replace each other in names, as other letters do.
VOWELS = ["aeiou", "AEIOU", "αεηιουω", "ΑΕΗΙΟΥΩ", "аеиоуыэюя", "АЕИОУЫЭЮЯ"]
_NAME_PLACE = dict(_PLACE)
for _v in VOWELS:
    _rest = "".join(c for c in _PLACE[_v[0]][2] if c not in _v)
    _NAME_PLACE |= {c: (tag + _v[0], i, a) for tag, a in (("v", _v), ("c", _rest)) for i, c in enumerate(a)}
#: Country codes of two digits; those of one digit are 1 and 7, others have three.
TWO_DIGIT_CODES = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
HEX = "0123456789abcdef"

CAP = r"[^\W\d_a-zà-öø-ÿα-ωа-я][^\W\d_]+"
DIGITAL = re.compile(
    r"""(?P<secret>\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_\w{20,}|sk-[\w-]{16,}|xox[abprs]-[\w-]{10,})
         |\b[0-9a-f]{32,}\b|\b[0-9A-F]{32,}\b)
      |(?P<mac>\b[0-9A-Fa-f]{2}(?:[:-][0-9A-Fa-f]{2}){5}\b)
      |(?P<ipv6>(?<![\w:])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}
         |(?=[\w:]*\d|(?:\w+:+){2}\w)(?:(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?))(?![\w:]|\.\d))
      |(?P<iban>\b[A-Z]{2}\d{2}(?:[ ]?[0-9A-Z]{4}){3,7}(?:[ ]?[0-9A-Z]{1,3})?\b)
      |(?P<ip>(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d))
      |(?P<phone>(?<![\w+])(?:\+|00)\d{1,3}[ .-]?(?:\(\d{1,5}\)[ .-]?|\d{1,5}[ .-])\d{2,4}(?:[ .-]?\d{2,4}){1,3}(?!\d)
         |(?<![\w+])\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}(?!\d)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])|(?<![\w+])\+\d{8,15}(?!\d))
      |(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))
      |(?P<card>(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-]))
      |(?P<spaced>(?<![\w.-])\d{3}[ ]\d{3}[ ]\d{4}(?![\w-]))""",
    re.VERBOSE,
)
NAMED_SECRET = re.compile(r"""(?i)\b(?:token|secret|password|passwd|pwd|api[ _-]?key|access[ _-]?key|secret[ _-]?key|private[ _-]?key|auth)\b["']?[ \t]*[=:][ \t]*["']?(?P<secret>[^\s"'<>,;]{6,})""")
_GIVEN_WORDS = sorted({n for v in GIVEN.values() for n in v}, key=lambda n: (-len(n), n))
PERSON = re.compile(rf"(?<!\w)(?:(?P<title>(?:{'|'.join(TITLES)})\.?)[ ](?P<a>{CAP})(?:[ ](?P<b>{CAP}))?|(?P<c>{'|'.join(_GIVEN_WORDS)})[ ](?P<d>{CAP}))(?!\w)")
_TRIGGERS = frozenset([*TITLES, *_GIVEN_WORDS])
_WORDS = re.compile(r"\w+")
#: What may be an address without any digit.
_LETTER_HEX = re.compile(r"[A-Fa-f]::|::[A-Fa-f]|\b[A-Fa-f]{2}([:-])[A-Fa-f]{2}\1")
_KEY_STARTS = ("AKIA", "gho_", "ghp_", "ghr_", "ghs_", "ghu_", "sk-", "xox", "eyJ")
_KEY_HEAD = re.compile(r"AKIA|gh[pousr]_|sk-|xox[abprs]-|eyJ|")
_DIGIT = re.compile(r"\d")
_GROUP = re.compile(r"\d+")
_DOMAIN = re.compile(r"[\w.-]+")
_WEB_TOKEN = re.compile(r"\beyJ(?=[\w-])")
_PLAIN_WORD = re.compile(r"(?<!\w)[^\W\d_]+(?!\w)")
_SIGNS = re.compile(r"[^0-9A-Za-z]")
#: Characters of a format beyond which a string is permuted by sums and not as one number.
LONG = 160


class Surrogates:
    """Keyed permutations over strings of one format."""

    def __init__(self, key: bytes):
        if len(key) < 16:
            raise ValueError("the key has at least 16 bytes")
        self.key = key
        self._permuted = lru_cache(maxsize=50_000)(self._permute)

    def _feistel(self, x: int, half: int, tweak: bytes, back: bool) -> int:
        mask = (1 << half) - 1
        a, b = x >> half, x & mask
        size = (half + 7) // 8
        for r in reversed(range(8)) if back else range(8):
            side = a if back else b
            block, n = b"", 0
            while len(block) < size:
                block += hmac.digest(self.key, tweak + bytes([r, n]) + side.to_bytes(size, "big"), "sha256")
                n += 1
            f = int.from_bytes(block[:size], "big") & mask
            a, b = (b ^ f, a) if back else (b, a ^ f)
        return a << half | b

    def _permute(self, x: int, n: int, tweak: bytes) -> int:
        """Permutation of range(n) without fixed points: a step on a cycle of secret order."""
        half = max(1, ((n - 1).bit_length() + 1) // 2)

        def walk(y: int, back: bool) -> int:
            y = self._feistel(y, half, tweak, back)
            while y >= n:
                y = self._feistel(y, half, tweak, back)
            return y

        return walk((walk(x, False) + 1) % n, True)

    def number(self, x: int, n: int, tweak: str, fits: Callable[[int], bool] = lambda _: True) -> int:
        """``x`` permuted within the numbers of range(n) that ``fits`` accepts, as it does ``x``."""
        if n < 2:
            return x
        y = self._permuted(x, n, tweak.encode())
        while not fits(y):
            y = self._permuted(y, n, tweak.encode())
        return y

    def string(self, s: str, kind: str, fits: Callable[[str], bool] = lambda _: True, hexadecimal: bool = False, places: dict = _PLACE) -> str:
        """``s`` permuted within the strings of its format."""
        if hexadecimal:
            upper, low = s.isupper(), s.lower()
            where = [("x", HEX.index(c), HEX) if c in HEX else None for c in low]
        else:
            upper, low = False, s
            where = [places.get(c) for c in low]
        tweak = kind + "|" + "".join(f"<{w[0]}>" if w else c for w, c in zip(where, low))
        cased = (lambda t: t.upper()) if upper else (lambda t: t)
        free = [w for w in where if w]
        if len(free) > LONG:
            return self._long(free, where, low, tweak, lambda t: fits(cased(t)), cased)
        n, x = 1, 0
        for _, i, alphabet in free:
            x = x * len(alphabet) + i
            n *= len(alphabet)

        def spell(y: int) -> str:
            out = []
            for w, c in zip(reversed(where), reversed(low)):
                if w:
                    y, i = divmod(y, len(w[2]))
                    c = w[2][i]
                out.append(c)
            return cased("".join(reversed(out)))

        return spell(self.number(x, n, tweak, lambda y: fits(spell(y))))

    def _long(self, free, where, low, tweak, fits, cased) -> str:
        """The same in time linear in the length: each half is shifted by a function of the other."""
        digits, sizes = np.array([i for _, i, _ in free], dtype=np.int64), np.array([len(a) for _, _, a in free], dtype=np.int64)
        half = len(digits) // 2
        seed = len(self.key).to_bytes(4, "big") + self.key + hashlib.sha256(tweak.encode("utf-8", "surrogatepass")).digest()
        while True:
            for r in range(6):
                mine, other = (slice(0, half), slice(half, None)) if r % 2 else (slice(half, None), slice(0, half))
                stream = hashlib.shake_256(seed + bytes([r]) + digits[other].astype("<u4").tobytes()).digest(4 * len(digits[mine]))
                digits[mine] = (digits[mine] + np.frombuffer(stream, "<u4").astype(np.int64)) % sizes[mine]
            left = iter(digits.tolist())
            new = "".join(w[2][next(left)] if w else c for w, c in zip(where, low))
            if fits(new):
                return cased(new)


def luhn(s: str) -> bool:
    d = [int(c) for c in s if c.isdigit()][::-1]
    return sum(d[0::2] + [x * 2 - 9 * (x > 4) for x in d[1::2]]) % 10 == 0


def iban_valid(s: str) -> bool:
    t = s.replace(" ", "").upper()
    return int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97 == 1


def _refilled(like: str, chars: str) -> str:
    """``like`` with its letters and digits replaced by ``chars`` in order."""
    left = iter(chars)
    return "".join(c if _SIGNS.match(c) else next(left) for c in like)


def _phone(s: str) -> tuple[str, str, str]:
    """What stays at the head of a number (with the country code), the code, and other digits."""
    m = re.match(r"\+|00(?=[1-9])", s)
    if not m:
        digits = _SIGNS.sub("", s)
        return "", "1" if len(digits) == 10 else "", digits
    code = re.sub(r"\D", "", s[m.end() :])[:3]
    size = 1 if code[0] in "17" else 2 if code[:2] in TWO_DIGIT_CODES else 3
    head = m.end()
    for _ in range(size):  # the code's digits, whatever stands between them
        head = re.compile(r"\D*\d").match(s, head).end()
    return s[:head], code[:size], _SIGNS.sub("", s[head:])


def _recased(like: str, s: str) -> str:
    return s.upper() if like.isupper() and len(like) > 1 else s


def surrogate(make: Surrogates, kind: str, s: str) -> str:
    """Replacement of one entity of a kind; spelling in upper or lower case doesn't matter for
    e-mail addresses and names."""
    if kind == "email":
        local, _, domain = s.casefold().rpartition("@")
        name, _, top = domain.rpartition(".")
        return _recased(s, make.string(local + "@" + name, kind) + "." + top)
    if kind == "ip":
        octets = [int(x) for x in s.split(".")]
        y = make.number(int.from_bytes(bytes(octets), "big"), 1 << 32, kind)
        return ".".join(str(b) for b in y.to_bytes(4, "big"))
    if kind == "ipv6":  # spellings of one address have one surrogate, written in full
        y = make.number(int(ipaddress.IPv6Address(s)), 1 << 128, kind)
        return _recased(s, ":".join(f"{y >> at & 0xFFFF:x}" for at in range(112, -1, -16)))
    if kind == "card":
        return _refilled(s, make.string(canonical(kind, s), f"card{luhn(s)}", lambda t: luhn(t) == luhn(s)))
    if kind == "phone":  # the country code stays
        head, code, digits = _phone(s)
        return head + _refilled(s[len(head) :], make.string(digits, "phone" + code))
    if kind == "iban":
        plain, valid = canonical(kind, s), iban_valid(s)
        return _refilled(s, plain[:2] + make.string(plain[2:], f"iban{plain[:2]}{valid}", lambda t: iban_valid(plain[:2] + t) == valid))
    if kind == "mac":
        return _recased(s, _refilled(s, make.string(canonical(kind, s), kind, hexadecimal=True)))
    if kind == "secret" and re.fullmatch("[0-9a-f]+|[0-9A-F]+", s):
        return make.string(s, kind, hexadecimal=True)
    if kind == "secret":  # the start that tells whose key it is stays
        head = _KEY_HEAD.match(s)[0]
        return head + make.string(s[len(head) :], kind + head, lambda t: bool(head) or not _KEY_HEAD.match(t)[0])
    if kind in ("given", "surname"):
        return _name(make, kind, s)
    return make.string(s, kind)


_LISTS: dict[str, dict[str, tuple[list[str], int, str]]] = {
    "given": {n.casefold(): (names, i, f"given-{g}-{script}") for (g, script), names in GIVEN.items() for i, n in enumerate(names)},
    "surname": {n.casefold(): (names, i, f"surname-{script}") for script, names in SURNAMES.items() for i, n in enumerate(names)},
}


def _name(make: Surrogates, kind: str, s: str) -> str:
    listed = _LISTS[kind]
    found = listed.get(s.casefold())
    if found:
        names, i, tweak = found
        return _recased(s, names[make.number(i, len(names), tweak)])
    plain = s.casefold()
    plain = plain[:1].upper() + plain[1:] if len(plain) == len(s) else s
    stem, end = (plain[:-1], plain[-1]) if len(plain) > 2 else (plain, "")
    return _recased(s, make.string(stem, f"{kind}|{end}", lambda t: (t + end).casefold() not in listed, places=_NAME_PLACE) + end)


def _address(s: str) -> bool:
    try:
        return bool(int(ipaddress.IPv6Address(s)))
    except ValueError:
        return False


def _emails(text: str) -> list[tuple[int, int, str]]:
    """Addresses around each at sign, every character looked at once or twice."""
    found, floor, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > floor and (text[begin - 1].isalnum() or text[begin - 1] in "_.%+-"):
            begin -= 1
        run = _DOMAIN.match(text, at + 1)
        end, pos, labels = 0, at + 1, 0
        for label in run[0].split(".") if run and begin < at else ():
            size = len(label)
            while size and not label[size - 1].isalnum():
                size -= 1
            if not size or not label[0].isalnum():
                break
            labels, end = labels + 1, pos + size
            if size < len(label):
                break
            pos += len(label) + 1
        if labels > 1:
            found.append((begin, end, "email"))
        floor = end if labels > 1 else at + 1
        at = text.find("@", floor)
    return found


def _card(run: str) -> int:
    """Length of the number of 13 to 19 digits that begins a run of groups and passes the check;
    less than nothing, that of the first group, if there is none."""
    ends = [m.end() for m in _GROUP.finditer(run)]
    for end in reversed(ends):
        if 13 <= sum(map(str.isdigit, run[:end])) <= 19 and luhn(run[:end]):
            return end
    return -ends[0]


def _digital(text: str) -> Iterator[tuple[int, int, str]]:
    at = 0
    while m := DIGITAL.search(text, at):
        kind, (begin, at) = m.lastgroup, m.span()
        if kind == "card":
            size = _card(m[0])
            at = begin + abs(size)  # what follows a group that begins no card may be anything
            if size < 0:
                continue
        if kind != "ipv6" or _address(m[0]):
            yield begin, at, "phone" if kind == "spaced" else kind


def _web_tokens(text: str) -> list[tuple[int, int, str]]:
    """Three parts between stops, the first with the head of an encoded object."""
    found = []
    for m in _DOMAIN.finditer(text):
        if "eyJ" not in m[0]:
            continue
        parts, at, free = m[0].split("."), m.start(), 0
        for i, part in enumerate(parts):
            head = _WEB_TOKEN.search(part) if i >= free and len(parts) > i + 2 and parts[i + 1] and parts[i + 2] else None
            if head:
                found.append((at + head.start(), at + sum(map(len, parts[i : i + 3])) + 2, "secret"))
                free = i + 3
            at += len(part) + 1
    return found


def _persons(text: str) -> list[tuple[int, int, str]]:
    """Names, and the same names alone elsewhere in the text."""
    found = []
    for m in PERSON.finditer(text):
        if m["c"]:
            found += [(*m.span("c"), "given"), (*m.span("d"), "surname")]
        elif m["b"]:
            found += [(*m.span("a"), "given"), (*m.span("b"), "surname")]
        else:
            found.append((*m.span("a"), "surname"))
    known = {text[a:b]: kind for a, b, kind in found}
    if known:
        taken = {a for a, _, _ in found}
        found += [(*m.span(), known[m[0]]) for m in _PLAIN_WORD.finditer(text) if m[0] in known and m.start() not in taken]
    return found


def detect(text: str) -> list[tuple[int, int, str]]:
    """Start, end and kind of the entities of a text, in order and apart from each other."""
    found = _emails(text) if "@" in text else []
    if "=" in text or ":" in text:
        found += [(*m.span("secret"), "secret") for m in NAMED_SECRET.finditer(text)]
    if "eyJ" in text:
        found += _web_tokens(text)
    if _DIGIT.search(text) or any(x in text for x in _KEY_STARTS) or _LETTER_HEX.search(text):
        found += _digital(text)
    # PERSON begins at the start of a word with one of these, which a blank or a stop ends
    if not _TRIGGERS.isdisjoint(_WORDS.findall(text)):
        found += _persons(text)
    found.sort(key=lambda x: (x[0], -x[1]))
    out: list[tuple[int, int, str]] = []
    for x in found:
        if not out or x[0] >= out[-1][1]:
            out.append(x)
    return out


def replace(make: Surrogates, text: str) -> tuple[str, list[dict]]:
    """A text with surrogates, and where they stand in it."""
    parts, spans, at, grown = [], [], 0, 0
    for start, end, kind in detect(text):
        new = surrogate(make, kind, text[start:end])
        parts += [text[at:start], new]
        spans.append({"kind": kind, "start": start + grown, "length": len(new), "surrogate": new, "mark": hashlib.sha256(kind.encode() + b"|" + make.key + b"|" + canonical(kind, text[start:end]).encode("utf-8", "surrogatepass")).hexdigest()[:32]})
        grown += len(new) - (end - start)
        at = end
    return "".join([*parts, text[at:]]), spans


def canonical(kind: str, s: str) -> str:
    """What two spellings of one entity have in common."""
    if kind in ("email", "given", "surname"):
        return s.casefold()
    if kind == "ip":
        return ".".join(str(int(x)) for x in s.split("."))
    if kind == "ipv6":
        return ipaddress.IPv6Address(s).exploded
    if kind == "phone":
        _, code, digits = _phone(s)
        return f"{code}|{digits}"
    if kind in ("card", "iban"):
        return _SIGNS.sub("", s)
    if kind == "mac":
        return _SIGNS.sub("", s).lower()
    return s


SPAN = "array<struct<kind:string,start:int,length:int,surrogate:string,mark:string>>"
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("length", pa.int32()), ("surrogate", pa.string()), ("mark", pa.string())]))
_OWN_KEY = os.urandom(32)


def session_key(spark: SparkSession) -> bytes:
    """The key that ``tidemark.pii.secret`` holds in hexadecimal digits.

    Where it isn't set, a random key of this driver process: surrogates then agree within all
    the process computes and with nothing else, and nobody can undo them. (Spark redacts
    settings whose name says ``secret``.)
    """
    found = spark.conf.get("tidemark.pii.secret", None)
    return bytes.fromhex(found) if found else _OWN_KEY


def replace_pii(docs: DataFrame, key: bytes, text: str = "text", entities: str | None = "entities") -> DataFrame:
    """``docs`` with surrogates in ``text`` and, unless None, a column ``entities``.

    ``key`` has at least 16 bytes and has to be kept secret: who has it can undo surrogates. An
    entity has its kind, place and surrogate in the new text and a keyed ``mark``, equal exactly
    for spellings of one entity. Texts and tokens of any length take time in proportion. A null text stays null, with no entities. Ids, other columns
    and repeated rows stay as they are; a column already named ``entities`` is replaced; an
    empty table gives an empty result. There is no shuffle.
    """
    _maker(key)

    @F.udf(f"struct<text:string,spans:{SPAN}>", useArrow=True)
    def one(t):
        if t is None:
            return None, []
        return replace(_maker(key), t)

    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), one(F.col(f"`{text}`")).alias("new"))
    out = []
    for c in docs.columns:
        if c == text:
            out.append(F.col("new.text").alias(c))
        elif c != entities:
            out.append(F.col(f"row.`{c}`"))
    if entities:
        out.append(F.col("new.spans").alias(entities))
    return row.select(*out)


@lru_cache(maxsize=4)
def _maker(key: bytes) -> Surrogates:
    return Surrogates(key)


def collisions(replaced: DataFrame, entities: str = "entities") -> DataFrame:
    """Surrogates that stand for more than one entity, or entities with more than one: none."""
    e = replaced.select(F.explode(entities).alias("e")).select("e.kind", "e.surrogate", "e.mark").distinct()
    bare = F.regexp_replace(F.lower("surrogate"), "[^0-9a-z]", "")
    digits = F.regexp_replace(F.regexp_replace("surrogate", r"^00(?=[1-9])", "+"), "[^0-9+]", "")
    national = (F.length(digits) == 10) & ~F.startswith(digits, F.lit("+"))
    one = (
        F.when(F.col("kind") == "phone", F.when(national, F.concat(F.lit("+1"), digits)).otherwise(digits))
        .when(F.col("kind").isin("card", "iban", "mac"), bare)
        .otherwise(F.lower("surrogate"))
    )
    e = e.select("kind", one.alias("surrogate"), "mark").distinct()
    by = lambda a, b: e.groupBy("kind", F.col(a).alias("value")).agg(F.count_distinct(b).alias("n")).filter("n > 1")
    return by("surrogate", "mark").unionByName(by("mark", "surrogate"))
