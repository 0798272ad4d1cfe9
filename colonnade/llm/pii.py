"""Personal data in texts, plain and disguised, with offsets into the source text.

Plain identifiers are found as they stand. A transducer then rewrites disguises - look-alike
characters, spelled digits, "(at)" and "dot" - and keeps for every character it writes the
source characters it stands for. The same detectors run on its output, and what they find is
mapped back. A span that does not touch a plain one of its kind is added, and an email that
reaches beyond a plain one.

Rules: offsets are code points, the end is exclusive; per kind spans do not overlap and are
found from the left; a candidate that fails its test (address parts, checksum, number of
digits) is dropped and nothing inside it is tried again. A null or empty text has no spans.
Repeated rows have the same spans. Time grows in proportion to the text, whatever it holds:
runs of one character are scanned once. Columns named like the results are replaced.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from colonnade.llm.batches import with_results

KINDS = ("email", "ip", "card", "phone")
SPAN = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("base", T.BooleanType()),
    ]
)

# The kinds' patterns, written so that a failing match costs no second scan: an email is
# looked for from its "@", and runs of digits are only entered at their first digit.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]+")


def _emails(text: str) -> list[tuple[int, int]]:
    found, past, at = [], 0, text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        if domain:
            start = at
            while start > past and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                past = domain.end()
                found.append((start, past))
        at = text.find("@", max(at + 1, past))
    return found


def _checksum(digits: str) -> bool:
    """Luhn: every second digit from the right counts double, as the sum of its digits."""
    values = [int(d) for d in reversed(digits)]
    return (sum(values[::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


def _ips(text: str) -> list[tuple[int, int]]:
    def small(part: str) -> bool:
        return len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or "0") <= 255

    return [m.span() for m in _IP.finditer(text) if all(map(small, m[0].split(".")))]


def _cards(text: str) -> list[tuple[int, int]]:
    found = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _NO_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and _checksum(digits):
                found.append(m.span())
    return found


def _phones(text: str) -> list[tuple[int, int]]:
    if "+" not in text:
        return []
    return [
        m.span() for m in _PHONE.finditer(text) if 10 <= len(_NO_DIGIT.sub("", m[0])) <= 15
    ]


_FIND = {"email": _emails, "ip": _ips, "card": _cards, "phone": _phones}


def plain_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of each kind in the text as it stands."""
    return {kind: find(text) for kind, find in _FIND.items()}


# The transducer. Characters that look like an ASCII one.
_LOOKS_LIKE = {
    "a": "аɑα", "b": "Ьƅ", "c": "сϲ", "d": "ԁ", "e": "еҽ", "g": "ɡ", "h": "һ", "i": "іι", "j": "јϳ",
    "k": "κ", "l": "ӏ", "m": "м", "n": "ո", "o": "оοօ", "p": "рρ", "q": "ԛ", "r": "г", "s": "ѕ",
    "t": "т", "u": "υս", "v": "ѵν", "w": "ԝѡ", "x": "хχ", "y": "уγ", "z": "ᴢ",
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "H": "НΗ", "I": "ІΙ", "J": "Ј", "K": "КΚ", "M": "МΜ",
    "N": "Ν", "O": "ОΟ", "P": "РΡ", "S": "Ѕ", "T": "ТΤ", "X": "ХΧ", "Y": "ҮΥ", "Z": "Ζ",
    "@": "﹫", ".": "․。｡・·", "-": "‐‑‒–—−﹣", "+": "﹢", " ": "      ",
}
_INVISIBLE = "­​‌‍⁠﻿"
_DIGIT_WORDS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine")


def _look_alikes() -> dict[str, str]:
    """What each disguised character stands for; wide forms and digits of other scripts
    by rule, invisible characters for nothing."""
    table = {c: plain for plain, others in _LOOKS_LIKE.items() for c in others}
    table |= {chr(c + 0xFEE0): chr(c) for c in range(0x21, 0x7F)} | dict.fromkeys(_INVISIBLE, "")
    for start in (0x660, 0x6F0, 0x7C0, 0x966, 0x9E6, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6):
        table |= {chr(start + i): str(unicodedata.digit(chr(start + i))) for i in range(10)}
    return table


_ALIKE = _look_alikes()
_ALIKE_RUN = re.compile("[" + "".join(map(re.escape, _ALIKE)) + "]")
_OPEN, _CLOSE = r"[\[({<]", r"[\])}>]"
_LABEL = r"[A-Za-z0-9-]+"
_GAP = r"[ \t-\r]"
#: White space before a word, entered at its start only, so that runs are scanned once.
_BEFORE = rf"(?<!{_GAP}){_GAP}++"
_DOT_WORD = rf"(?:(?:{_BEFORE})?{_OPEN}{_GAP}*+(?:dot|\.){_GAP}*+{_CLOSE}{_GAP}*+|{_BEFORE}dot{_GAP}++)"
_ENDING = r"[A-Za-z][A-Za-z0-9-]"
_DISGUISES = re.compile(
    # "(at)" in brackets, or the bare word where "dot" follows in brackets or as a word
    rf"(?P<at>(?:{_BEFORE})?{_OPEN}{_GAP}*+(?:at|@){_GAP}*+{_CLOSE}{_GAP}*+(?={_LABEL}(?:{_DOT_WORD}|\.){_ENDING})"
    rf"|{_BEFORE}at{_GAP}++(?={_LABEL}{_DOT_WORD}{_ENDING}))"
    # the bare word before a plain host, which counts after a name that prose does not have,
    # and after a plain name where the words before it or the host speak for an address
    rf"|(?P<host>{_BEFORE}at{_GAP}++(?=(?P<where>{_LABEL}(?:\.{_LABEL})*\.{_ENDING}+)))"
    rf"|(?P<dot>(?<=[A-Za-z0-9]){_DOT_WORD}(?=[A-Za-z0-9]))"
    r"|(?P<plus>(?<![A-Za-z])plus ?(?=[0-9]|(?:" + "|".join(_DIGIT_WORDS) + r")(?![A-Za-z])))"
    r"|(?P<digit>(?<![A-Za-z])(?:" + "|".join(_DIGIT_WORDS) + r")(?![A-Za-z]))",
    re.IGNORECASE,
)
#: A name of letters with digits, points or lines in it.
_NAME = re.compile(r"(?<![^\s])(?=[^\s]*[A-Za-z])[A-Za-z0-9%+-]*[0-9._][A-Za-z0-9._%+-]*(?<=[A-Za-z0-9])\Z")
#: A word that can be a name, with up to four words before it.
_PLAIN_NAME = re.compile(rf"((?:[^\s]+{_GAP}+){{0,4}})(?<![^\s])([A-Za-z]{{2,32}})\Z")
#: Words before a name that announce an address; hosts that carry mail; words
#: that stand before "at" in prose.
_CUE = re.compile(r"(?<![A-Za-z])(?:e-?mail(?:s|ed|ing)?|mail(?:s|ed|ing|to)?|contact(?:s|ed|ing)?|writ(?:e|es|ing|ten)|reach(?:es|ed|able|ing)?)(?![A-Za-z])", re.IGNORECASE)
_MAIL_HOST = re.compile(
    r"(?:(?:gmail|googlemail|hotmail|outlook|live|msn|icloud|me|aol|protonmail|fastmail|zoho|mail|qq|163|126)\.com"
    r"|(?:yahoo|hotmail|gmx|yandex|live|outlook)\.[a-z]{2,3}(?:\.[a-z]{2})?|web\.de|proton\.me|t-online\.de|mail\.ru)\Z",
    re.IGNORECASE,
)
_PROSE = frozenset(
    "me us him her them you it we they he she one this that these those all both any each none and or but not so then "
    "now here there up out in on off down back over again is are was were be been being am do does did done has have had "
    "get got go goes going went gone come comes came look looks looked looking see sees saw seen seeing find finds found "
    "work works worked working live lives lived meet meets met start starts started end ends ended stay stays stayed "
    "host hosts hosted run runs running read reads buy bought sell sold sign signed join joined visit visits visited "
    "available located listed posted published online directly only just even still also more mail mails email emails "
    "mailed emailed mailing contact contacts contacted write writes wrote written writing reach reached reachable "
    "address addresses account accounts inbox page pages site sites website form article download shop store".split()
)
#: A letter for a digit inside a number.
_LETTER_DIGIT = re.compile(r"(?<=[0-9])[OoIl](?=[0-9])")
_MAY_HIDE = re.compile(
    rf"[\[({{<]{_GAP}*+(?:at|dot|@|\.){_GAP}*+[\])}}>]|{_GAP}dot{_GAP}|\bplus ?[0-9]|{_GAP}at{_GAP}++[A-Za-z0-9-]+\.[A-Za-z0-9]",
    re.IGNORECASE,
)
_MAY_SPELL = re.compile(r"(?<![A-Za-z])(?:" + "|".join(_DIGIT_WORDS) + r")(?![A-Za-z])", re.IGNORECASE)


def _speaks_for_address(before: str, word: str, host: str) -> bool:
    """Whether a name ends ``before``, where ``word`` ("at") and a plain host follow: one
    that prose does not have, or a plain one beside a cue, a mail host or an "AT"."""
    if _NAME.search(before):
        return True
    plain = _PLAIN_NAME.search(before)
    if plain is None or plain[2].lower() in _PROSE:
        return False
    shouted = word.strip() == "AT" and not plain[2].isupper()
    return shouted or _MAIL_HOST.match(host) is not None or _CUE.search(plain[1]) is not None


class _Written:
    """Text under rewriting, with the source span of each of its characters."""

    def __init__(self, text: str):
        self.text, self.starts, self.ends = text, range(len(text)), range(1, len(text) + 1)

    def replace(self, changes: list[tuple[int, int, str]]) -> None:
        """Put a string for each span; its characters all stand for the whole span."""
        if not changes:
            return
        text, starts, ends, past = [], [], [], 0
        for begin, end, put in [*changes, (len(self.text), len(self.text), "")]:
            text += [self.text[past:begin], put]
            starts.extend(self.starts[past:begin])
            ends.extend(self.ends[past:begin])
            if end > begin:
                starts.extend([self.starts[begin]] * len(put))
                ends.extend([self.ends[end - 1]] * len(put))
            past = end
        self.text, self.starts, self.ends = "".join(text), starts, ends


def _undisguised(text: str) -> _Written | None:
    """The rewritten text, or nothing if there is nothing to rewrite."""
    out = _Written(text)
    if not text.isascii():
        out.replace([(m.start(), m.end(), _ALIKE[m[0]]) for m in _ALIKE_RUN.finditer(text)])
    if _MAY_HIDE.search(out.text) or _MAY_SPELL.search(out.text):
        changes: list[tuple[int, int, str]] = []
        for m in _DISGUISES.finditer(out.text):
            begin, put = m.start(), {"at": "@", "host": "@", "dot": ".", "plus": "+"}.get(m.lastgroup)
            if m.lastgroup == "host" and not _speaks_for_address(out.text[max(0, begin - 80) : begin], m[0], m["where"]):
                continue
            if put is None:
                put = str(_DIGIT_WORDS.index(m[0].lower()))
                # one blank or hyphen between spelled digits goes
                if changes and changes[-1][2].isdigit() and changes[-1][1] == begin - 1 and out.text[begin - 1] in " -":
                    begin -= 1
            changes.append((begin, m.end(), put))
        out.replace(changes)
    out.replace([(m.start(), m.end(), "0" if m[0] in "Oo" else "1") for m in _LETTER_DIGIT.finditer(out.text)])
    return None if out.text == text else out


def personal_spans(text: str | None) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, plain) by start, then kind as listed, plain ones all included."""
    text = text or ""
    plain = plain_spans(text)
    spans = [(k, s, e, True) for k in KINDS for s, e in plain[k]]
    rewritten = _undisguised(text)
    if rewritten is not None:
        for kind in KINDS:
            taken = plain[kind]
            for start, end in _FIND[kind](rewritten.text):
                start, end = rewritten.starts[start], rewritten.ends[end - 1]
                at = bisect_right(taken, (start, len(text) + 1))
                inside = at > 0 and taken[at - 1][1] >= end
                touches = at > 0 and taken[at - 1][1] > start or at < len(taken) and taken[at][0] < end
                if not touches or kind == "email" and not inside:
                    spans.append((kind, start, end, False))
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def redacted(text: str | None, spans: list[tuple[str, int, int, bool]]) -> str | None:
    """The text with the kind in brackets for each span; spans that overlap become one."""
    if text is None or not spans:
        return text
    out, past = [], 0
    for kind, start, end, _ in spans:
        if start >= past:
            out += [text[past:start], f"[{kind}]"]
        past = max(past, end)
    return "".join(out) + text[past:]


def find_personal_data(frame: DataFrame, text: str = "text", redact: bool = False, keep: list[str] | None = None) -> DataFrame:
    """The frame with ``spans`` (kind, start, end, base), and with ``redact`` its text
    replaced by one that holds the kinds in place of the spans."""
    fields = [("spans", T.ArrayType(SPAN))] + [(text, T.StringType())] * redact

    def make():
        def work(texts):
            spans = [personal_spans(t) for t in texts]
            named = [[dict(zip(SPAN.names, s)) for s in own] for own in spans]
            return (named, map(redacted, texts, spans)) if redact else (named,)

        return work

    return with_results(frame, text, fields, make, keep)
