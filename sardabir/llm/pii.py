"""Operator 8: personal data and secrets are detected and replaced by surrogates.

A surrogate is a keyed function of the entity, so one entity has one surrogate wherever it stands (coreference), and
it has the entity's type and format: letters stay letters of their case, digits stay digits of their script,
separators stay. For everything written in letters and digits it comes from a keyed permutation of all strings of that
form (a Feistel network over mixed radices), so different entities have different surrogates by construction. A name's
word goes by the word and its role, given or family name, and a name after a title is replaced wherever the text has it. Names
come from lists by gender and script, and are built from a list's entry and keyed syllables when many people stand in
one document; there, and against an entity's own value, collisions are checked within the document and settled by keying
anew, as often as it takes.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import cut

ROUNDS = 8
#: What numbers, assignments and secrets need; a text without any of these can hold none of them.
MARKS = re.compile(r"[\d=:]")
EMAIL = re.compile(r"[\w.%+\-]*\w@\w[\w\-]*(?:\.[\w\-]+)*\.[^\W\d_]{2,}")
SECRET = re.compile(r"(?i:\b(?:token|api[_\- ]?key|access[_\- ]?key|secret|password|passwd|pwd)\b[\"']?\s{0,3}[=:]\s{0,3}[\"']?)([A-Za-z0-9+/_\-]{8,})|\b([0-9a-f]{32,64}|[0-9A-F]{32,64})\b|\b(AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|sk-[A-Za-z0-9]{20,})\b")
IBAN = re.compile(r"\b([A-Z]{2})(\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)\b")
IPV4 = re.compile(r"(?<![\d.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?!\d|\.\d)", re.ASCII)
CARD = re.compile(r"(?<![\d,+\-])(?<!\d\.)(?:\d{13,19}|\d{4}(?:[ \-]\d{4}){2,3}(?:[ \-]\d{1,4})?|\d{4}[ \-]\d{6}[ \-]\d{5})(?![\d]|[.,\-]\d)")
SSN = re.compile(r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])")
PHONE = re.compile(r"(?:(?<!\d)\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?\d{2,4}(?:[ .\-]?\d{4}|[ .\-]?\d{2}[ .\-]?\d{2})|\d{1,4}(?:[ .\-]?\d{2,5}){2,4})|(?<!\w)(?<!\d\.)(?:\(\d{2,4}\)[ .\-]?\d{3,4}[ .\-]\d{3,4}|(?:1[ .\-])?\d{3}[ .\-]\d{3}[ .\-]\d{4}|00\d{9,13}))(?!\d)")
#: Titles that say a name follows, with its gender.
TITLES = {"Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Herr": "m", "Herrn": "m", "Frau": "f", "Monsieur": "m", "Madame": "f", "Mme": "f", "Mlle": "f", "Sr": "m", "Sra": "f",
          "Se\u00f1or": "m", "Se\u00f1ora": "f", "Don": "m", "Do\u00f1a": "f", "\u0433-\u043d": "m", "\u0433-\u0436\u0430": "f", "\u0622\u0642\u0627\u06cc": "m", "\u062e\u0627\u0646\u0645": "f"}
#: Titles of either gender, also after one of the others.
DEGREES = ("Dr", "Prof", "Professor", "\u0434-\u0440", "\u062f\u06a9\u062a\u0631")
_WORD = r"[^\W\d_a-z\u00df-\u00ff\u0430-\u045f][^\W\d_]+"
_DEGREE = "(?:" + "|".join(sorted(DEGREES, key=len, reverse=True)) + r")\b\.? "
NAME = re.compile(r"\b(?:(" + "|".join(sorted(TITLES, key=len, reverse=True)) + r")\b\.? (?:" + _DEGREE + ")*|(?:" + _DEGREE + ")+)(" + _WORD + r"(?: " + _WORD + r")?)")
LETTERS = re.compile(r"\b[^\W\d_]{2,}\b")
NAMES = {
    ("latin", "m"): "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karl Leon Martin Noel Oscar Paul Quentin Robert Simon Thomas Victor Walter".split(),
    ("latin", "f"): "Anna Berta Clara Diana Emma Flora Greta Helena Irene Julia Klara Laura Maria Nora Olga Paula Rosa Sofia Teresa Ursula Vera Wanda".split(),
    ("latin", ""): "Abel Berger Conti Dumas Engel Ferrer Gruber Haas Iversen Jansen Keller Lange Moreau Novak Olsen Petit Quint Rossi Stein Torres Urban Vogel Weber Zeller".split(),
    ("cyrillic", "m"): "\u0410\u043b\u0435\u043a\u0441\u0435\u0439 \u0411\u043e\u0440\u0438\u0441 \u0412\u0438\u043a\u0442\u043e\u0440 \u0418\u0432\u0430\u043d \u041f\u0430\u0432\u0435\u043b \u0421\u0435\u0440\u0433\u0435\u0439".split(),
    ("cyrillic", "f"): "\u0410\u043d\u043d\u0430 \u0412\u0435\u0440\u0430 \u0418\u0440\u0438\u043d\u0430 \u041c\u0430\u0440\u0438\u044f \u041e\u043b\u044c\u0433\u0430 \u0421\u043e\u0444\u0438\u044f".split(),
    ("cyrillic", ""): "\u0411\u0435\u043b\u044b\u0445 \u0414\u043e\u043b\u0433\u0438\u0445 \u041a\u043e\u0432\u0430\u043b\u044c \u041c\u043e\u0440\u043e\u0437 \u0421\u043e\u043a\u043e\u043b \u0428\u0435\u0432\u0447\u0435\u043d\u043a\u043e".split(),
    ("arabic", "m"): "\u0627\u062d\u0645\u062f \u062d\u0633\u0646 \u062d\u0633\u06cc\u0646 \u0631\u0636\u0627 \u0639\u0644\u06cc \u0645\u0647\u062f\u06cc".split(),
    ("arabic", "f"): "\u0632\u0647\u0631\u0627 \u0633\u0627\u0631\u0627 \u0641\u0627\u0637\u0645\u0647 \u0645\u0631\u06cc\u0645 \u0645\u06cc\u0646\u0627 \u0646\u0631\u06af\u0633".split(),
    ("arabic", ""): "\u0627\u06a9\u0628\u0631\u06cc \u0627\u062d\u0645\u062f\u06cc \u0631\u0636\u0627\u06cc\u06cc \u06a9\u0631\u06cc\u0645\u06cc \u0645\u062d\u0645\u062f\u06cc \u0646\u0648\u0631\u06cc".split(),
}
#: What goes before a name of the lists when those are used up: syllables of the script, as many as it takes.
SYLLABLES = {
    "latin": "Ba Be Bo Da De Do Fa Fe Ga Go Ha Ka Ke Ko La Le Lo Ma Me Mo Na Ne No Pa Pe Ra Re Ro Sa Se So Ta Te To Va Ve".split(),
    "cyrillic": "\u0411\u0430 \u0411\u043e \u0412\u0430 \u0412\u043e \u0414\u0430 \u0414\u043e \u041a\u0430 \u041a\u043e \u041b\u0430 \u041b\u043e \u041c\u0430 \u041c\u043e \u041d\u0430 \u041d\u043e \u0420\u0430 \u0420\u043e \u0421\u0430 \u0421\u043e \u0422\u0430 \u0422\u043e".split(),
    "arabic": "\u0628\u0627 \u0628\u0648 \u062f\u0627 \u062f\u0648 \u0631\u0627 \u0631\u0648 \u0633\u0627 \u0633\u0648 \u0645\u0627 \u0645\u0648 \u0646\u0627 \u0646\u0648 \u06a9\u0627 \u06a9\u0648 \u0644\u0627 \u0644\u0648".split(),
}
#: Tries with the lists alone, and with each further syllable; tries with a string of the entity's own length.
LIST_TRIES, LENGTH_TRIES = 8, 64
KINDS = ("email", "secret", "iban", "ip", "card", "ssn", "phone", "name")


def find_entities(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all entities in order, without overlaps; of two that overlap, the kind named first in KINDS."""
    found: list[tuple[int, int, str]] = []
    last = 0
    for at in re.finditer("@", text) if "@" in text else ():
        # from the start of its run of characters, which the sign before it bounds
        start = at.start()
        while start > last and (text[start - 1].isalnum() or text[start - 1] in "_.%+-"):
            start -= 1
        last = at.end()
        if m := EMAIL.match(text, start):
            found.append((*m.span(), "email"))
    if MARKS.search(text):
        found += [(*m.span(m.lastindex), "secret") for m in SECRET.finditer(text)]
        for kind, pattern in (("iban", IBAN), ("ip", IPV4), ("card", CARD), ("ssn", SSN), ("phone", PHONE)):
            # a number whose check digit is wrong is no card's
            found += [(*m.span(), kind) for m in pattern.finditer(text) if kind != "card" or _luhn([unicodedata.digit(c) for c in m[0] if c.isdigit()]) == 0]
    if any(title in text for title in (*TITLES, *DEGREES)):
        found += [(start, end, "name") for start, end, _ in find_names(text)]
    if len(found) < 2:
        return found
    kept, taken = [], bytearray(len(text))
    for start, end, kind in sorted(set(found), key=lambda f: (KINDS.index(f[2]), f[0])):
        if not any(taken[start:end]):
            taken[start:end] = b"\1" * (end - start)
            kept.append((start, end, kind))
    return sorted(kept)


def find_names(text: str) -> list[tuple[int, int, tuple[tuple[str, str], ...]]]:
    """(start, end, roles) of the names after titles and of their further mentions, whole or by one word of them.

    A role is ("family", "") or ("given", gender). The last word is the family name. Where a script has no case, the word
    after a name may be any; so of two words the second is not sought alone, unless it follows a title alone.
    """
    titled: list[tuple[int, int, tuple[tuple[str, str], ...]]] = []
    wholes: dict[str, tuple[tuple[str, str], ...]] = {}
    families: dict[str, tuple[tuple[str, str], ...]] = {}
    givens: dict[str, tuple[tuple[str, str], ...]] = {}
    matches = list(NAME.finditer(text))
    # a given name after a degree has the gender it has elsewhere
    genders = {m[2].split(" ")[0]: TITLES[m[1]] for m in matches if m[1] and " " in m[2]}
    for m in matches:
        words, family = m[2].split(" "), ("family", "")
        given = ("given", TITLES[m[1]] if m[1] else genders.get(words[0], ""))
        if len(words) == 1:
            families[words[0]] = (family,)
        else:
            wholes.setdefault(m[2], (given, family))
            givens.setdefault(words[0], (given,))
            if words[1].lower() != words[1].upper():
                families[words[1]] = (family,)
        titled.append((*m.span(2), (family,) if len(words) == 1 else (given, family)))
    for known in (wholes, families, givens):
        known |= {w.upper(): roles for w, roles in known.items() if w.upper() not in known}
    singles, found, ahead, after = givens | families, [], 0, 0
    runs = list(LETTERS.finditer(text)) if titled else []
    for k, m in enumerate(runs):
        while ahead < len(titled) and titled[ahead][1] <= m.start():
            ahead += 1
        until = titled[ahead][0] if ahead < len(titled) else len(text)
        if m.start() < after or m.end() > until:
            continue
        end = runs[k + 1].end() if k + 1 < len(runs) else len(text) + 1
        whole = wholes.get(text[m.start():end]) if end <= until else None
        if roles := whole or singles.get(m[0]):
            after = end if whole else m.end()
            found.append((m.start(), after, roles))
    return sorted(titled + found)


def _prf(key: bytes, *parts: object) -> int:
    return int.from_bytes(hashlib.blake2b(repr(parts).encode(), key=key, digest_size=32).digest(), "big")


def _permute(digits: list[int], radices: list[int], key: bytes, tweak: tuple) -> list[int]:
    """A keyed permutation of all digit strings of these radices (an unbalanced Feistel network on two halves)."""
    if len(digits) < 2:
        return [(d + _prf(key, tweak, len(radices), "one")) % r for d, r in zip(digits, radices)]
    half = len(digits) // 2
    sides = [0, 0]
    sizes = [1, 1]
    for i, (d, r) in enumerate(zip(digits, radices)):
        side = int(i >= half)
        sides[side], sizes[side] = sides[side] * r + d, sizes[side] * r
    for n in range(ROUNDS):
        side = n % 2
        sides[side] = (sides[side] + _prf(key, tweak, tuple(radices), n, sides[1 - side])) % sizes[side]
    out: list[int] = []
    for side, own in ((1, radices[half:]), (0, radices[:half])):
        value, part = sides[side], []
        for r in reversed(own):
            value, d = divmod(value, r)
            part.append(d)
        out = part[::-1] + out
    return out


def _zero(c: str) -> int:
    return ord(c) - unicodedata.digit(c)


def _like(value: str, key: bytes, tweak: tuple, keep: int = 0, hexadecimal: bool = False) -> str:
    """``value`` with letters and digits permuted in place, but for the first ``keep`` of them.

    Letters are taken case by case: ASCII ones among the 26 (or a-f with hexadecimal digits), others among the 26 too.
    """
    places, digits, radices = [], [], []
    seen: list[str] = []
    for i, c in enumerate(value):
        kind = 10 if c.isdigit() and unicodedata.digit(c, -1) >= 0 else 26 if c.isalpha() else 0
        if not kind:
            continue
        if len(seen) < keep:
            seen.append(c)
            continue
        if hexadecimal:
            digits.append(int(c, 16))
            radices.append(16)
        elif kind == 10:
            digits.append(unicodedata.digit(c))
            radices.append(10)
        else:
            base = unicodedata.normalize("NFKD", c.lower())[0]
            digits.append(ord(base) - 97 if "a" <= base <= "z" else ord(base) % 26)
            radices.append(26)
        places.append(i)
    # letters outside a-z share numbers with those inside; the tweak holds what tells them apart
    foreign = tuple((i, value[i].lower()) for i, r in zip(places, radices) if r == 26 and not "a" <= value[i].lower() <= "z")
    out = list(value)
    for i, d, r in zip(places, _permute(digits, radices, key, (*tweak, "" if seen == ["1"] else "".join(seen), foreign)), radices):
        c = value[i]
        if r == 10:
            out[i] = chr(_zero(c) + d)
        else:
            new = "0123456789abcdef"[d] if r == 16 else chr(97 + d)
            out[i] = new.upper() if c.isupper() or r == 16 and value.upper() == value else new
    return "".join(out)


def _luhn(digits: list[int]) -> int:
    return sum(d if (len(digits) - i) % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(digits)) % 10


def _script(word: str) -> str:
    name = unicodedata.name(word[0], "")
    return "cyrillic" if name.startswith("CYRILLIC") else "arabic" if name.startswith("ARABIC") else "latin"


def name_word(word: str, role: str, gender: str, key: bytes, again: int = 0) -> str:
    """The replacement of one word of a name, by the word and its role; with ``again`` it grows without bound."""
    script, own = _script(word), (role, gender, word.casefold())
    names = NAMES[script, (gender or "mf"[_prf(key, "gender", own) % 2]) if role == "given" else ""]
    out = names[_prf(key, ("name", again), own) % len(names)]
    if again >= LIST_TRIES:
        # the entry's own ending stays, which may tell the gender
        some = SYLLABLES[script]
        out = "".join(some[_prf(key, ("name", again), n, own, "syllable") % len(some)] for n in range(again // LIST_TRIES)).capitalize() + out.lower()
    return out


def surrogate(value: str, kind: str, key: bytes, again: int = 0) -> str:
    """The replacement of an entity other than a name; ``again`` counts the times it had to be keyed anew.

    With ``again``, the kinds that can be too short to have enough strings of their form grow without bound.
    """
    tweak = (kind, again)
    if longer := again // LENGTH_TRIES:
        # emails, secrets and phones of few letters or digits; the spaces of other kinds are larger than any text
        value = "x" * longer + value if kind == "email" else value + "x" * longer if kind == "secret" else value + "0" * longer if kind == "phone" else value
    if kind == "email":
        local, _, domain = value.rpartition("@")
        host, _, top = domain.rpartition(".")
        # one permutation of local part and host; the top-level domain stays
        return f"{_like(f'{local}@{host}', key, (*tweak, top.lower()))}.{top}"
    if kind == "secret":
        return _like(value, key, tweak, hexadecimal=bool(re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value)))
    if kind == "iban":
        return value[:2] + _like(value[2:], key, (*tweak, value[:2]))
    if kind == "ip":
        octets = _permute([int(x) for x in value.split(".")], [256] * 4, key, tweak)
        return ".".join(map(str, octets))
    if kind == "card":
        digits = [unicodedata.digit(c) for c in value if c.isdigit()]
        head = _permute(digits[:-1], [10] * (len(digits) - 1), key, tweak)
        last = next(d for d in range(10) if _luhn([*head, d]) == _luhn(digits))
        new = iter([*head, last])
        return "".join(chr(_zero(c) + next(new)) if c.isdigit() else c for c in value)
    if kind == "phone":
        country, n = re.match(r"\+(\d{1,3})[ .\-(]|\+(1|7)", value), sum(c.isdigit() for c in value)
        long = n == 11 and not country and value.lstrip("(")[0] == "1"
        # with or without the country code 1, one number has one surrogate
        return _like(value, key, tweak, keep=len(country[1] or country[2]) if country else int(long))
    return _like(value, key, tweak)


def identity(value: str, kind: str) -> str:
    """What two mentions of one entity have in common."""
    if kind in ("phone", "card", "ssn"):
        digits = "".join(str(unicodedata.digit(c)) for c in value if c.isdigit())
        return digits[1:] if kind == "phone" and len(digits) == 11 and digits[0] == "1" else digits
    return value if kind == "secret" else re.sub(r"\s+", "", value) if kind == "iban" else value.casefold()


def pseudonymize(text: str, key: bytes) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with surrogates in place of its entities, and where those stood in the original."""
    entities = find_entities(text)
    if not entities:
        return text, []
    named = {(start, end): roles for start, end, roles in find_names(text)} if any(kind == "name" for _, _, kind in entities) else {}
    # an entity is settled whole, a name word by word
    values = {(kind, identity(part, kind)) for s, e, kind in entities for part in (text[s:e].split(" ") if kind == "name" else [text[s:e]])}
    taken: dict[tuple[str, str], tuple] = {}
    tries: dict[tuple, int] = {}

    def settled(value: str, kind: str, role: tuple = ()) -> str:
        own = (kind, identity(value, kind), role)
        while True:
            again = tries.setdefault(own, 0)
            new = name_word(value, *role, key, again) if role else surrogate(value, kind, key, again)
            other = (kind, identity(new, kind))
            if other not in values and taken.setdefault(other, own) == own:
                return new
            tries[own] += 1

    out, at = [], 0
    for start, end, kind in entities:
        value = text[start:end]
        new = " ".join(settled(w, kind, r) for w, r in zip(value.split(" "), named[start, end])) if kind == "name" else settled(value, kind)
        out += [text[at:start], new]
        at = end
    out.append(text[at:])
    return "".join(out), entities


def replace_pii(docs: DataFrame, key: bytes, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with surrogates in ``text_col``; all rows and columns stay, in place.

    ``length_col`` is brought up to date where the text changed, if there is such a column. Null texts stay null,
    whatever other columns hold. Every text is worked through whole. Equal texts: equal results. Empty table: no rows.
    """
    names = docs.columns
    at, count = names.index(text_col), names.index(length_col) if length_col in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut(batches):
            old = batch.column(at).to_pylist()
            new = [t if t is None else pseudonymize(t, key)[0] for t in old]
            columns = list(batch.columns)
            columns[at] = pa.array(new, pa.string())
            if count is not None:
                lengths = [n if a == b else len(b) for n, a, b in zip(columns[count].to_pylist(), old, new)]
                columns[count] = pa.array(lengths, columns[count].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, docs.schema)


def describe_pii(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id_col``, text with surrogates, n_entities, and the entities' kinds, starts and ends in the original.

    Null text: stays null, no entities. Null id: stays null. Equal texts: equal results. Empty table: no rows. Other columns
    are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut(batches):
            got = [(None, []) if t is None else pseudonymize(t, key) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([t for t, _ in got], pa.string()), pa.array([len(e) for _, e in got], pa.int64()),
                pa.array([[k for _, _, k in e] for _, e in got], pa.list_(pa.string())),
                pa.array([[s for s, _, _ in e] for _, e in got], pa.list_(pa.int64())),
                pa.array([[x for _, x, _ in e] for _, e in got], pa.list_(pa.int64()))], names=[id_col, "text", "n_entities", "kinds", "starts", "ends"])

    return docs.select(docs[id_col].cast("bigint").alias(id_col), docs[text_col].alias("text")).mapInArrow(run, f"{id_col} long, text string, n_entities long, kinds array<string>, starts array<long>, ends array<long>")
