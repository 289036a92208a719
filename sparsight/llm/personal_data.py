"""Personal data in whole texts, plain or disguised, with spans in the source.

Transducers rewrite a text: look-alike characters to ASCII, spelled digits to
digits, and the words for ``@`` and ``.`` to these. Each keeps its edits, so that
a span found in what they wrote maps back, edit by edit, to the characters it came
from. What is found without any edit is found by the plain patterns anyway.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from sparsight.llm.words import bounded

KINDS = ("email", "ip", "card", "phone")
SPAN = "struct<start:int,kind:int,end:int,added:boolean>"

# fixed values: letters that look like others, in pairs; words for digits, for "@" and for "."; endings of domains
LOOKALIKES = (
    "аa еe оo рp сc уy хx іi јj ѕs ԁd һh ԛq ԝw АA ВB ЕE КK МM НH ОO РP СC ТT УY ХX ІI ЅS ЈJ "
    "οo αa νv ρp ιi κk υu ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ıi ɡg 。. ‐- ‑- ‒- –- —- ―- −-"
)
DROPPED = "­​‌‍‎‏⁠﻿"
DIGITS = (
    "zero oh cero zéro null", "one uno un eins", "two dos deux zwei zwo", "three tres trois drei", "four cuatro quatre vier",
    "five cinco cinq fünf", "six seis sechs", "seven siete sept sieben", "eight ocho huit acht", "nine nueve neuf neun",
)
AT = "at arroba arobase"
DOT = "dot punto punkt point"
ENDINGS = (
    "com org net edu gov mil int info biz name io ai dev app co me us uk ca au nz ie de at ch fr be nl lu es pt it eu se no "
    "fi dk pl cz ru ua jp cn kr in br mx ar cl za example test invalid localhost"
)

_DIGIT_OF = {w: str(d) for d, words in enumerate(DIGITS) for w in words.split()}
#: what patterns without case take for these letters, while ``lower`` does not
_CASELESS = str.maketrans("İıſK", "iisk")
_ENDINGS = frozenset(ENDINGS.split())
_NOT_HOSTS = frozenset(("the", "a", "an"))
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: spelled digits count from so many in a row
LEAST_WORDS = 3


def _characters() -> dict[str, str]:
    """Characters that are compatible with one ASCII character, decimal digits of any script, and the look-alikes."""
    out = {c: "" for c in DROPPED} | {pair[0]: pair[1] for pair in LOOKALIKES.split()}
    for part in (range(0x80, 0x3400), range(0xFB00, 0xFFF0), range(0x1D400, 0x1D800), range(0x1F100, 0x1F200)):
        for c in map(chr, part):
            plain = unicodedata.normalize("NFKC", c)
            if unicodedata.decimal(c, None) is not None:
                plain = str(unicodedata.decimal(c))
            if len(plain) == 1 and " " <= plain <= "~":
                out.setdefault(c, plain)
    return out


CHARACTERS = _characters()
_any = lambda words: "|".join(sorted(words.split(), key=len, reverse=True))
_words = _any(" ".join(DIGITS))
_DIGIT_WORD = re.compile(rf"(?i)(?<!\w)(?:{_words})(?!\w)")
_REPEAT = re.compile(r"(?i)(?<!\w)(double|triple)\s{1,2}$")
_GAP = re.compile(rf"(?i)[\s,()-]{{1,3}}(?:(?:double|triple)\s{{1,2}})?|\s{{0,2}}[\[({{]?\s{{0,2}}(?:{_any(DOT)})\s{{0,2}}[\])}}]?\s{{0,2}}|\.|[\s,.()-]{{1,3}}[0-9]{{1,19}}[\s,.()-]{{1,3}}")
_JOINED = re.compile(r",?\s{1,2}")
_PLUS = re.compile(rf"(?i)(?<!\w)(?:plus|más|mas)\s{{1,2}}(?=[0-9]|(?:{_words})(?!\w))")
_BAD_DIGIT = re.compile(r"(?<![A-Za-z0-9])(?=[OolI|]*[0-9])[0-9OolI|]{3,}(?![A-Za-z0-9])")
_BETWEEN = re.compile(
    rf"(?i)(?<=[0-9])(?:\s{{0,2}}[\[({{<]\s{{0,2}}(?:\.|{_any(DOT)})\s{{0,2}}[\])}}>]\s{{0,2}}|\s{{1,2}}(?:{_any(DOT)})\s{{1,2}})(?=[0-9])"
)
_open, _close = r"\s{0,3}[\[({<]\s{0,3}", r"\s{0,3}[\])}>]\s{0,3}"
_SIGNS = re.compile(
    rf"(?i)(?P<strong_at>{_open}(?:@|{_any(AT)}){_close})|(?P<strong_dot>{_open}(?:\.|{_any(DOT)}){_close})"
    rf"|(?P<weak_at>(?<=[a-z0-9])(?:\s{{1,3}}(?:{_any(AT)})\s{{1,3}}|[_-](?:{_any(AT)})[_-]|\s{{1,3}}@\s{{0,3}}|@\s{{1,3}})(?=[a-z0-9]))"
    rf"|(?P<weak_dot>(?<=[a-z0-9])(?:\s{{1,3}}(?:{_any(DOT)})\s{{1,3}}|[_-](?:{_any(DOT)})[_-])(?=[a-z0-9]))"
)
#: texts that none of these fit hold no disguise; they may fit others too
_MAY_SIGN = rf"(?i)(?:{_any(DOT)})|[\[({{<]\s{{0,3}}(?:\.|@|{_any(AT)})|\s@|@\s|[\s_-](?:{_any(AT)})[\s_-]{{1,3}}[a-z0-9-]+\.[a-z0-9]"
_MAY_DIGIT = rf"(?i)(?:{_words})[\s,.()-]{{1,3}}(?:{_words})|[0-9][OolI|]|[OolI|][0-9]|[0-9][\s\[({{<]{{1,5}}(?:\.|{_any(DOT)})|(?:plus|más|mas)\s"
_MAY_CHARACTER = f"[{''.join(sorted(CHARACTERS))}]"

_DOMAIN = re.compile(r"@([A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)")
#: letters with digits, or parts joined by a sign: before a bare "at" it is a name, no word
_NAME = re.compile(r"(?=[^A-Za-z]*[A-Za-z])(?:[^0-9]*[0-9].*|[A-Za-z0-9]+(?:[._-][A-Za-z0-9]+)+)")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]+")


class Rewritten:
    """A text after edits ``(start, end, replacement)``, which are disjoint and in order."""

    def __init__(self, text: str, edits: list[tuple[int, int, str]]):
        parts, at, shift = [], 0, 0
        self.edits, self.new_start, self.new_end = edits, [], []
        for start, end, new in edits:
            parts += text[at:start], new
            self.new_start.append(start + shift)
            shift += len(new) - (end - start)
            self.new_end.append(end + shift)
            at = end
        self.text = "".join([*parts, text[at:]])

    def edit_at(self, place: int) -> int | None:
        """The edit that wrote the character at a place."""
        k = bisect_right(self.new_start, place) - 1
        return k if k >= 0 and place < self.new_end[k] else None

    def _source(self, place: int) -> tuple[int, int]:
        k = bisect_right(self.new_start, place) - 1
        if k < 0:
            return place, place + 1
        if place < self.new_end[k]:
            return self.edits[k][:2]
        start = place - self.new_end[k] + self.edits[k][1]
        return start, start + 1

    def back(self, start: int, end: int) -> tuple[int, int, bool]:
        """The span that a span came from, and whether it holds an edit."""
        a, b = self._source(start)[0], self._source(end - 1)[1]
        k = bisect_left(self.new_end, start)
        while k < len(self.edits) and self.new_start[k] < end:
            if self.edits[k][0] >= a and self.edits[k][1] <= b:
                return a, b, True
            k += 1
        return a, b, False


def _source_of(stages: list[Rewritten], start: int, end: int) -> tuple[int, int, bool]:
    edited = False
    for stage in reversed(stages):
        start, end, here = stage.back(start, end)
        edited |= here
    return start, end, edited


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _local_start(text: str, at: int, least: int) -> int:
    start = at
    while start > least and text[start - 1] in _LOCAL:
        start -= 1
    return start


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost addresses. The sign is sought first, so that a long run without one is read once."""
    end = 0
    for m in _DOMAIN.finditer(text) if "@" in text else ():
        start = _local_start(text, m.start(), end)
        if start < m.start():
            end = m.end()
            yield start, end


def ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m.group().split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            yield m.span()


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        digits = m.group()
        if len(digits) < 12:
            continue
        digits = _NO_DIGIT.sub("", digits)
        if 12 <= len(digits) <= 19 and _luhn(digits):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 9 <= len(_NO_DIGIT.sub("", m.group())) <= 15:
            yield m.span()


PLAIN = (emails, ips, cards, phones)


def fold_characters(text: str) -> list[tuple[int, int, str]]:
    """Look-alikes to ASCII; characters without width go."""
    here = "".join(CHARACTERS.keys() & set(text))
    return [(m.start(), m.end(), CHARACTERS[m.group()]) for m in re.finditer(f"[{here}]", text)] if here else []


def fold_bad_digits(text: str) -> list[tuple[int, int, str]]:
    """Letters that stand for 0 and 1 in numbers mostly of digits."""
    out = []
    for m in _BAD_DIGIT.finditer(text):
        token = m.group()
        bad = [i for i, c in enumerate(token) if not c.isdigit()]
        if len(bad) * 2 <= len(token):
            out += [(m.start() + i, m.start() + i + 1, "0" if token[i] in "Oo" else "1") for i in bad]
    return out


def spelled_digits(text: str) -> list[tuple[int, int, str]]:
    """Runs of words for digits to digits; blanks between two words go. ``double`` and ``triple`` repeat."""
    runs: list[list[re.Match]] = []
    for m in _DIGIT_WORD.finditer(text):
        gap = text[runs[-1][-1].end() : m.start()] if runs else None
        if gap is not None and len(gap) <= 30 and _GAP.fullmatch(gap):
            runs[-1].append(m)
        else:
            runs.append([m])
    out: list[tuple[int, int, str]] = [(*m.span(), "+") for m in _PLUS.finditer(text)]
    for run in runs:
        if len(run) < LEAST_WORDS:
            continue
        end = None
        for m in run:
            start, digit = m.start(), _DIGIT_OF[m.group().translate(_CASELESS).lower()]
            times = _REPEAT.search(text, max(0, start - 9), start)
            if times:
                start, digit = times.start(), digit * (2 if times.group(1).lower() == "double" else 3)
            if end is not None and _JOINED.fullmatch(text, end, start):
                out.append((end, start, ""))
            out.append((start, m.end(), digit))
            end = m.end()
    return sorted(out)


def dots_between_digits(text: str) -> list[tuple[int, int, str]]:
    return [(*m.span(), ".") for m in _BETWEEN.finditer(text)]


def signs(text: str) -> list[tuple[int, int, str]]:
    """The words for ``@`` and ``.`` to these."""
    return [(*m.span(), "@" if m.lastgroup.endswith("at") else ".") for m in _SIGNS.finditer(text)]


def _weak(before: str, edit: tuple[int, int, str]) -> bool:
    return _SIGNS.match(before, edit[0]).lastgroup.startswith("weak")


def _told(first: Rewritten, second: Rewritten, sign: int, start: int, at: int, end: int) -> bool:
    """Whether a bare sign stands in an address: it is ``@``, a dot is disguised too, or what stands before is no plain word."""
    if "@" in first.text[slice(*second.edits[sign][:2])] or _NAME.fullmatch(second.text, start, at):
        return True
    return any(second.text[p] == "." and second.edit_at(p) is not None for p in range(start, end))


def disguised_emails(text: str) -> Iterator[tuple[int, int]]:
    """Addresses with an edit. A sign that is a bare word counts only in an address that ends as domains do; a bare ``at``
    only after what is no plain word or beside a disguised dot, a bare dot not after an address that is whole without it."""
    first = Rewritten(text, fold_characters(text))
    second = Rewritten(first.text, signs(first.text))
    new, last = second.text, 0
    weak = [_weak(first.text, e) for e in second.edits]
    for at in (m.start() for m in re.finditer("@", new)):
        m = _DOMAIN.match(new, at)
        start = _local_start(new, at, last)
        if not m or start == at:
            continue
        end = m.end()
        sign = second.edit_at(at)
        dots = [(p, second.edit_at(p)) for p in range(at, end) if new[p] == "."]
        loose = [k for _, k in dots if k is not None and weak[k]]
        loose_at = sign is not None and weak[sign]
        if loose_at or loose:
            labels = new[at + 1 : end].lower().split(".")
            while len(labels) > 1 and labels[-1] not in _ENDINGS:
                labels.pop()
            end = at + 1 + len(".".join(labels))
            dots = [d for d in dots if d[0] < end]
            if len(labels) < 2 or labels[0] in _NOT_HOSTS or (loose_at and not _told(first, second, sign, start, at, end)):
                continue
            if sign is None and any(k is None for _, k in dots) and not all(k is None for _, k in dots):
                continue
        a, b, edited = _source_of([first, second], start, end)
        if edited and not (text[a - 1 : a].isalnum() or text[b : b + 1].isalnum()):
            last = end
            yield a, b


def disguised_numbers(text: str) -> Iterator[tuple[int, int, int]]:
    """``kind, start, end`` of addresses, cards and phones with an edit."""
    stages = []
    for transducer in (fold_characters, fold_bad_digits, spelled_digits, dots_between_digits):
        stages.append(Rewritten(stages[-1].text if stages else text, transducer(stages[-1].text if stages else text)))
    new = stages[-1].text
    for kind, find in enumerate(PLAIN):
        for start, end in find(new) if kind else ():
            a, b, edited = _source_of(stages, start, end)
            if edited and not (text[a - 1 : a].isalnum() or text[b : b + 1].isalnum()):
                yield kind, a, b


def spans(text: str, may_sign: bool = True, may_digit: bool = True) -> list[tuple[int, int, int, bool]]:
    """``start, kind, end, added`` of all personal data in a text, in order. The flags may spare looking for disguises."""
    plain = [(a, kind, b, False) for kind, find in enumerate(PLAIN) for a, b in find(text)]
    more = {(a, 0, b) for a, b in disguised_emails(text)} if may_sign else set()
    more |= {(a, kind, b) for kind, a, b in disguised_numbers(text)} if may_digit else set()
    held = {kind: [s for s in plain if s[1] == kind] for kind in range(len(KINDS))}
    for a, kind, b in sorted(more):
        own = held[kind]
        k = bisect_right(own, (a, kind, len(text) + 1, True)) - 1
        if k < 0 or own[k][2] < b:  # not inside a plain one
            plain.append((a, kind, b, True))
    return sorted(plain)


def personal_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, spans`` for every row of ``docs``: an array of ``start, kind`` (place in ``KINDS``), ``end, added``.

    Plain patterns come leftmost and disjoint within their kind and are all
    there; ``added`` are those found behind a disguise that no plain span of
    their kind covers. Places count code points, ends exclusive. Null and
    empty texts have no spans; repeated rows stay; other columns take no part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "t"):
            texts = pc.fill_null(batch.column("t").cast(pa.large_string()), "")
            character, sign, digit = (
                pc.match_substring_regex(texts, p).to_pylist() for p in (_MAY_CHARACTER, _MAY_SIGN, _MAY_DIGIT)
            )
            found = [spans(t, c or s, c or d) for t, c, s, d in zip(texts.to_pylist(), character, sign, digit)]
            offsets = np.cumsum([0, *map(len, found)]).astype(np.int32)
            start, kind, end, added = zip(*[s for f in found for s in f]) if offsets[-1] else [()] * 4
            struct = pa.StructArray.from_arrays(
                [pa.array(start, pa.int32()), pa.array(kind, pa.int32()), pa.array(end, pa.int32()), pa.array(added, pa.bool_())],
                ["start", "kind", "end", "added"],
            )
            yield pa.RecordBatch.from_arrays([batch.column("i"), pa.ListArray.from_arrays(pa.array(offsets), struct)], ["doc_id", "spans"])

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t"))
    return rows.mapInArrow(run, f"doc_id {kind}, spans array<{SPAN}>")


def joined(found: Column) -> Column:
    """``kind:start:end`` of spans, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    one = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(found, one), ",")
