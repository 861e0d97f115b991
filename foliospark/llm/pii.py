"""Personal data in texts, plain and disguised, with spans in source code points."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.common import sliced, table
from foliospark.llm.tlds import TLDS

KINDS = ("email", "ip", "card", "phone")
#: The base patterns. Look-behinds and possessive repeats only keep long runs from
#: being tried again and again; the leftmost matches are those of the plain patterns.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

#: Letters of other scripts that look like ASCII ones.
LOOKALIKES = dict(zip("АВЕКМНОРСТХУІЈЅаеорсухіјѕԁһԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧονι", "ABEKMHOPCTXYIJSaeopcyxijsdhqwABEZHIKMNOPTYXovi", strict=True))
#: Characters without width.
HIDDEN = frozenset("­​‌‍⁠﻿")
#: Digit names.
DIGITS = {
    **dict(zip("zero one two three four five six seven eight nine".split(), "0123456789", strict=True)),
    **dict(zip("null eins zwei drei vier fünf sechs sieben acht neun".split(), "0123456789", strict=True)),
    **dict(zip("zéro un deux trois quatre cinq six sept huit neuf".split(), "0123456789", strict=True)),
    **dict(zip("cero uno dos tres cuatro cinco seis siete ocho nueve".split(), "0123456789", strict=True)),
}
SIGNS = {"plus": "+", "dot": ".", "point": ".", "punkt": ".", "punto": "."}
#: Names of @ and of the dot in the languages of the digit names; those of @ that
#: are no everyday word.
AT_NAMES = ("at", "ät", "arroba", "arobase", "klammeraffe", "chez")
DOT_NAMES = ("dot", "punkt", "punto", "point")
_NAME = "|".join(sorted(DIGITS, key=len, reverse=True))
_SIGN = "|".join(SIGNS)
#: What may lie between spelled digits: one white space, or a comma or hyphen with or without one. Two
#: spaces or a sentence's end part what isn't one number.
_GAP = r"(?:\s?-\s?|,\s?|\s)"
#: Two or more digit names or numbers, at least one of them a name, with signs between. What the
#: digits make must then match a base pattern.
SPELLED = re.compile(rf"(?i)(?<!\w)(?:plus[\s-]+)?(?:{_NAME}|[0-9]+)(?:{_GAP}(?:(?:{_SIGN}){_GAP})?(?:{_NAME}|[0-9]+)(?!\w))+")
SPELLED_WORD = re.compile(rf"(?i)(?:{_NAME}|{_SIGN}|[0-9]+)")
DIGIT_NAME = re.compile(rf"(?i)(?<!\w)(?:{_NAME})(?!\w)")
#: An @ or dot in brackets anywhere, with any white space around; bare names only where a whole
#: address has them (addresses()). Possessive, and not begun inside white space, so long runs are
#: passed over once.
_AT_NAME, _DOT_NAME = "|".join(AT_NAMES), "|".join(DOT_NAMES)
_DOT = rf"(?:(?<!\s)\s*+[(\[{{]\s?(?:{_DOT_NAME}|\.)\s?[)\]}}]\s*+|\s(?:{_DOT_NAME})\s|\s\.\s(?=[a-z]))"
_AT = rf"(?:(?<!\s)\s*+[(\[{{]\s?(?:{_AT_NAME}|@)\s?[)\]}}]\s*+)"
_PART = r"[A-Za-z0-9_%+-]+"
LOCAL_CHAIN = re.compile(rf"(?i){_PART}(?:(?:\.|{_DOT}){_PART})*+")
DOMAIN_CHAIN = re.compile(rf"(?i)[A-Za-z0-9-]+(?:(?:\.|{_DOT})[A-Za-z0-9-]+)++")
BRACKETED_AT = re.compile(rf"(?i){_AT}")
ANY_AT = re.compile(rf"(?i){_AT}|\s(?:{_AT_NAME})(?=\s)|\s?@")
DOT = re.compile(rf"(?i){_DOT}")
DOMAIN_DOT = re.compile(rf"(?i)\.|{_DOT}")
#: Words that say whether a bare address is one; none of them decides alone (see ``evidence``).
VERBS = frozenset(
    """
    aim appear are arrive ate be book buy call came come cost dine eat end gather gaze glance go grab guess happen have help is jump keep land laugh
    left lie live look lunch meet met open park play point read run sat see sell shoot shout sit sleep speak stand stare start stay stop study talk
    taught train wait was went were wink wonder work
    """.split()
)
FUNCTION_WORDS = frozenset(
    """
    all an and any as at be both but by each every for from he her his if in is it its just last least me more most my next no noon night of on once
    one or our so some that the their them then there these they this those to us was we what when where which who will with your
    """.split()
)
#: Evidence that an address of bare words needs.
ENOUGH = 2
#: Words, and signs, that lead to an address.
LEADS = re.compile(r"(?i)(?:^|[:;,(<>|/–-]|\b(?:to|an|à|a|via|mail|e-mail|email|address|contact|kontakt|contacto|correo|write|ask|reach|schreib|schreibe|escribe|écrire|adresse|courriel|is|ist|es|est))\s*$")
#: Public last labels that are everyday words: nothing is told by them.
WORD_TLDS = frozenset("am as at be best by do fun game go group help home hot how im in is it la live love ma me mo my no now one open place run save show so to us work world zone".split())
BARE = re.compile(rf"(?i)\s(?:{_DOT_NAME})\s|\s@|@\s|\s\.\s")
WORD = re.compile(r"\w+")
BRACKETED = re.compile(rf"(?i)[(\[{{]\s?(?:{_AT_NAME}|{_DOT_NAME}|@|\.)\s?[)\]}}]")
ODD = re.compile("[" + "".join(LOOKALIKES) + "".join(HIDDEN) + "！-～\U0001d7ce-\U0001d7ff٠-٩۰-۹०-९]")


def luhn(digits: str) -> bool:
    twice = [sum(divmod(2 * int(d), 10)) for d in digits[-2::-2]]
    return (sum(map(int, digits[::-2])) + sum(twice)) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind's place in KINDS, start, end) of the base patterns, in that order."""
    out = []
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        end = DOMAIN.match(text, at + 1) if start < at else None
        if end:
            last = end.end()
            out.append((0, start, last))
        at = text.find("@", max(at + 1, last))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            out.append((1, *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum(c in "0123456789" for c in m[0]) <= 15:
                out.append((3, *m.span()))
    return out


class Mapped:
    """A text under rewriting; every character knows its source span."""

    def __init__(self, text: str):
        self.text = text
        self.starts = list(range(len(text)))
        self.ends = list(range(1, len(text) + 1))

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace [start, end) by a string, for edits in order; each new character gets the
        whole source span of what it replaces."""
        parts, starts, ends, at = [], [], [], 0
        for s, e, new in edits:
            parts += [self.text[at:s], new]
            starts += self.starts[at:s] + [self.starts[s]] * len(new)
            ends += self.ends[at:s] + [self.ends[e - 1]] * len(new)
            at = e
        self.text = "".join([*parts, self.text[at:]])
        self.starts, self.ends = starts + self.starts[at:], ends + self.ends[at:]


def plain_char(c: str) -> str:
    """What a look-alike, hidden or foreign digit character stands for."""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    if c in HIDDEN:
        return ""
    digit = unicodedata.decimal(c, None)
    return str(digit) if digit is not None else chr(ord(c) - 0xFEE0) if "！" <= c <= "～" else c


def is_verb(word: str) -> bool:
    """Whether a word, or what it is without -s, -d, -ed or -ing, is one of VERBS."""
    forms = [word, *[word.removesuffix(x) for x in ("s", "d", "ed", "ing")], word.removesuffix("ing") + "e"]
    return not VERBS.isdisjoint(forms)


def closed(labels: list[str]) -> int:
    """How many labels of a bare domain its address takes: up to its last public one, since words
    of the sentence may follow; 0 if none is public."""
    return next((n for n in range(len(labels), 1, -1) if labels[n - 1] in TLDS), 0)


def evidence(text: str, start: int, at: int, labels: list[str], end: int) -> int:
    """How much speaks for an address of bare words, from its shape: a local part that isn't a
    verb's form, or has a sign of a name; a last label that isn't a word; what leads to it; an end
    of the clause behind it. Host labels that are function words speak against it."""
    local = text[start:at].lower()
    score = 1 if not is_verb(local) else 0 if LEADS.search(text[max(0, start - 16) : start]) else -1
    score += any(c in "0123456789._-+%" for c in local)
    score += labels[-1] not in WORD_TLDS
    score += LEADS.search(text[max(0, start - 16) : start]) is not None
    score += not re.match(r"\s*\w", text[end:])
    return score - 3 * any(x in FUNCTION_WORDS for x in labels[:-1]) - 2 * (local in FUNCTION_WORDS and local != "me")


def addresses(text: str) -> list[tuple[int, int, int, int]]:
    """(start, end of the local part, start of the domain, end) of addresses with a disguised @
    or dot, in order. Bracketed signs stand alone; a bare name of @ needs a spelled-out dot after it,
    a public last label and ENOUGH evidence."""
    out, ends, last = [], None, 0
    for at in ANY_AT.finditer(text):
        bracketed = BRACKETED_AT.fullmatch(at[0]) is not None
        after = at.end() if bracketed or text[at.end() : at.end() + 1].strip() else at.end() + 1
        domain = DOMAIN_CHAIN.match(text, after)
        if domain is None:
            continue
        if ends is None:
            ends = {m.end(): m.start() for m in LOCAL_CHAIN.finditer(text)}
        start = max(ends.get(at.start(), len(text)), last)
        if start >= at.start():
            continue
        end = domain.end()
        if not bracketed:
            dots = list(DOMAIN_DOT.finditer(domain[0]))
            word = "@" not in at[0]
            labels = DOMAIN_DOT.sub(".", domain[0]).lower().split(".")
            n = closed(labels)
            spaced = not word and after - at.start() > 1
            spelled = any(len(d[0]) > 1 for d in dots[: max(n - 1, 0)])
            if n == 0 or not (spelled or spaced or DOT.search(text, start, at.start())):
                continue
            if n <= len(dots):
                end = after + dots[n - 1].start()
            if word and (not spelled or evidence(text, start, at.start(), labels[:n], end) < ENOUGH):
                continue
        last = end
        out.append((start, at.start(), after, end))
    return out


def hidden_spans(text: str) -> list[tuple[int, int, int]]:
    """Spans that show only after the transducers: look-alike characters, then spelled digits,
    then at/dot disguises."""
    odd = ODD.search(text) is not None
    spelled = not DIGITS.keys().isdisjoint(WORD.findall(text.casefold()))
    joined = BARE.search(text) is not None or BRACKETED.search(text) is not None
    if not (odd or spelled or joined):
        return []
    m = Mapped(text)
    if odd:
        m.rewrite([(*x.span(), plain_char(x[0])) for x in ODD.finditer(m.text)])
    changed = odd
    if spelled or odd:
        edits = []
        for x in SPELLED.finditer(m.text):
            if re.search(f"(?i){_NAME}", x[0]):
                words = list(SPELLED_WORD.finditer(m.text, *x.span()))
                bounds = [x.start(), *(w.start() for w in words[1:]), x.end()]
                edits += [(a, b, (DIGITS | SIGNS).get(w[0].lower(), w[0])) for w, a, b in zip(words, bounds[:-1], bounds[1:], strict=True)]
        m.rewrite(edits)
        changed = changed or bool(edits)
    if joined or odd:
        edits = []
        for start, at, after, end in addresses(m.text):
            dots = [[(*y.span(), ".") for y in DOT.finditer(m.text, *part)] for part in ((start, at), (after, end))]
            edits += [*dots[0], (at, after, "@"), *dots[1]]
        m.rewrite(edits)
        changed = changed or bool(edits)
    return [(k, m.starts[s], m.ends[e - 1]) for k, s, e in base_spans(m.text)] if changed else []


def all_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans: hidden ones come in unless a base span of their kind holds them,
    or they only lengthen one by a digit name, which is more likely a word of the sentence."""
    base = base_spans(text)

    def new(kind: int, start: int, end: int) -> bool:
        for k, s, e in base:
            if k == kind and s <= start and end <= e:
                return False
            if k == kind > 0 and start <= s and e <= end and len(DIGIT_NAME.findall(text[start:s] + "|" + text[e:end])) == 1:
                return False
        return True

    more = [x for x in hidden_spans(text) if new(*x)]
    return base, sorted({*base, *more})


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span replaced by its kind; overlapping spans go together."""
    out, at = [], 0
    for k, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans (kind:start:end by kind and start, end exclusive, source code
    points), and the redacted text, of each row.

    Null and empty texts have no spans and stay as they are. Rows are independent: repeated rows
    give repeated results, no rows give none, other columns are ignored. Texts are read whole,
    however long; a task turns a slice of one Arrow batch into objects at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            base, spans, clean = [], [], []
            for text in batch.column(1).to_pylist():
                b, s = all_spans(text or "")
                base.append(written(b))
                spans.append(written(s))
                clean.append(redacted(text, s) if s else text)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(base, pa.string()), pa.array(spans, pa.string()), pa.array(clean, pa.string())], ["doc_id", "base", "spans", "clean"]
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, base string, spans string, clean string")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of its text replaced by [EMAIL], [IP], [CARD] or [PHONE]; all
    columns, whatever their names, rows and nulls stay, and n_chars, where there, is counted anew.
    Texts are read whole, however long; repeated rows change alike; an empty table stays empty; of
    spans that overlap the earliest and then longest names the kind."""
    names = docs.columns
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index("text")
        for batch in sliced(batches):
            clean = [t if t is None else redacted(t, all_spans(t)[1]) for t in batch.column(at).to_pylist()]
            cols = [pa.array(clean, batch.column(at).type) if i == at else batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(cols, names)

    done = docs.mapInArrow(run, schema)
    return done.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)) if "n_chars" in names else done


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.regexp_extract_all("base", F.lit(rf"\b{kind}:"), F.lit(0))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2("base", 256).alias("base_sha256"), "spans")


def base_digest(text: str | None) -> str:
    """The base digest of one text, for tests."""
    return hashlib.sha256(written(base_spans(text or "")).encode()).hexdigest()
