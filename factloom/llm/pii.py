"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, schemes, digits, plus signs and identifier cues. Local parsers
expand each anchor to its boundaries and validate what they find. Parsers read no further than the characters of what
they parse, and never the same characters twice, so that a text is handled in linear time.
"""

from __future__ import annotations

import re

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.common import map_column

#: Kinds whose definition is fixed, in the order in which spans with one start are listed; then those that the method adds.
BASE_KINDS = ["email", "ip", "card", "phone"]
ADDED_KINDS = ["url", "masked_email", "iban", "national_id", "account", "secret", "street"]
KINDS = BASE_KINDS + ADDED_KINDS

LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
DIGITS = re.compile(r"[0-9]+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CHAIN = re.compile(r"[0-9](?:[\x20-]?[0-9])*")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
URL_REST = re.compile(r"[^\s<>\"'`{}|\\^]+")
MASKED = re.compile(r"([A-Za-z0-9._%+-]++)\s*+(?:\[at\]|\(at\)|\{at\})\s*+([A-Za-z0-9-]++(?:\s*+(?:\[dot\]|\(dot\)|\{dot\}|\.)\s*+[A-Za-z0-9-]++)+)", re.I)
ISSUED = re.compile(r"[A-Za-z0-9_-]{12,}")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?")
SSN = re.compile(r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
#: After a cue: an optional "number" word, a separator, then the value.
VALUE = re.compile(r"(?:\s*+(?:number|no\.?|nr\.?|num\.?|#|id))?\s*+[:=#]?\s*+[\"']?([A-Za-z0-9][A-Za-z0-9._/+-]{3,})", re.I)
STREET = re.compile(r"[0-9]{1,5}(?:\x20[A-Z][\w'.-]*){1,4}\x20(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Ln|Drive|Dr|Court|Ct|Square|Sq)\b")
#: Cues for accounts and for secrets, and how secrets of known issuers begin.
ACCOUNT_CUES = ["account", "acct", "iban", "passport", "customer id", "konto", "compte", "cuenta"]
SECRET_CUES = ["token", "secret", "password", "passwd", "api_key", "apikey", "api key", "access_key", "private_key", "pwd"]
SECRET_STARTS = ["AKIA", "ghp_", "sk-", "xoxb-", "-----BEGIN"]
SCHEMES = ["://", "www."]


def build_automaton() -> ahocorasick.Automaton:
    """Anchors and the parser of each. Cues are matched as written, in lower case, capitalised and in capitals."""
    found: dict[str, str] = {"@": "at", "+": "plus", "[at]": "masked", "(at)": "masked", "{at}": "masked", "[AT]": "masked", "(AT)": "masked"}
    found |= {str(d): "digit" for d in range(10)}
    found |= dict.fromkeys(SCHEMES, "scheme") | dict.fromkeys(SECRET_STARTS, "start")
    for cues, parser in ((ACCOUNT_CUES, "account"), (SECRET_CUES, "secret")):
        for cue in cues:
            found |= dict.fromkeys((cue, cue.capitalize(), cue.upper()), parser)
    automaton = ahocorasick.Automaton()
    for anchor, parser in found.items():
        automaton.add_word(anchor, (parser, len(anchor)))
    automaton.make_automaton()
    return automaton


def luhn(digits: str) -> bool:
    doubled = [int(d) * 2 for d in digits[-2::-2]]
    return (sum(d - 9 if d > 9 else d for d in doubled) + sum(map(int, digits[-1::-2]))) % 10 == 0


def iban_valid(value: str) -> bool:
    moved = value[4:] + value[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


class Parsers:
    """Expands the anchors of one text, given in order, to spans (kind, start, end)."""

    def __init__(self, text: str):
        self.text = text
        self.spans: list[tuple[int, int, int]] = []
        self.after = dict.fromkeys([*KINDS, "chain", "dotted", "scheme", "start"], 0)  # where the last match of a kind, or what a parser read in vain, ended

    def add(self, kind: str, start: int, end: int) -> None:
        if start >= self.after[kind] or kind in BASE_KINDS:
            self.spans.append((start, KINDS.index(kind), end))
            self.after[kind] = max(self.after[kind], end)

    def at(self, start: int, end: int) -> None:
        """An at-sign: the local part grows to the left, not into the last address, the domain to the right."""
        left, floor, text = start, self.after["email"], self.text
        while left > floor and text[left - 1] in LOCAL_CHARS:
            left -= 1
        if left < start and (m := DOMAIN.match(text, end)):
            self.add("email", left, m.end())

    def digit(self, start: int, end: int) -> None:
        """A digit: the dotted chain and the spaced chain that it begins, unless they are already read."""
        text = self.text
        if start >= self.after["dotted"]:
            m = DOTTED.match(text, start)
            self.after["dotted"] = m.end()
            if text.find(".", start, m.end()) >= 0:
                runs = list(DIGITS.finditer(text, start, m.end()))
                for i in range(0, len(runs) - 3, 4):
                    four = runs[i : i + 4]
                    if all(part_valid(r.group()) for r in four):
                        self.add("ip", four[0].start(), four[3].end())
        if start >= self.after["chain"]:
            m = CHAIN.match(text, start)
            self.after["chain"] = m.end()
            if m.end() - start >= 9:
                digits = m.group().replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    self.add("card", start, m.end())
                if len(digits) == 9 and (s := SSN.fullmatch(text, start, m.end())):
                    self.add("national_id", s.start(), s.end())
            if m.end() - start <= 5 and (s := STREET.match(text, start)):
                self.add("street", s.start(), s.end())
        if start >= 2 and text[start - 2 : start].isalpha() and text[start - 2 : start].isupper() and (start < 3 or not text[start - 3].isalnum()):
            self.iban(start - 2)

    def iban(self, start: int) -> None:
        if start < self.after["iban"] or not (m := IBAN.match(self.text, start)):
            return
        for end in dict.fromkeys((m.end(), m.start() + len(m.group().rsplit(" ", 1)[0]))):
            value = self.text[start:end].replace(" ", "")
            if 15 <= len(value) <= 34 and value.isascii() and iban_valid(value):
                self.add("iban", start, end)
                return

    def plus(self, start: int, end: int) -> None:
        if m := PHONE.match(self.text, start):
            if 9 <= sum(map(str.isdigit, m.group())) <= 15:
                self.add("phone", start, m.end())

    def scheme(self, start: int, end: int) -> None:
        """A scheme: its name grows to the left, the address to the right, without closing punctuation."""
        text, left = self.text, start
        if text[start:end] == "://":
            while left > self.after["url"] and text[left - 1].isalpha() and text[left - 1].isascii():
                left -= 1
            if left == start:
                return
        elif start and (text[start - 1].isalnum() or text[start - 1] in "./@"):
            return
        if start >= max(self.after["url"], self.after["scheme"]) and (m := URL_REST.match(text, end)):
            self.after["scheme"] = m.end()
            stop = end + len(m.group().rstrip(".,;:!?)]"))
            if stop > end and "." in text[end:stop]:
                self.add("url", left, stop)

    def masked(self, start: int, end: int) -> None:
        """An at-sign in words: the local part ends just before it."""
        text, left = self.text, start
        while left and text[left - 1] == " ":
            left -= 1
        while left > self.after["masked_email"] and text[left - 1] in LOCAL_CHARS:
            left -= 1
        if m := MASKED.match(text, left):
            self.add("masked_email", m.start(), m.end())

    def cue(self, kind: str, start: int, end: int) -> None:
        text = self.text
        if start and text[start - 1].isalnum():
            return
        if (m := VALUE.match(text, end)) and text[end : end + 1] in " \t:=#\"'_":
            value = m.group(1)
            digits = sum(map(str.isdigit, value))
            if digits >= (6 if kind == "account" else 4) and (kind == "account" or len(value) >= 12):
                self.add(kind, m.start(1), m.end(1))

    def account(self, start: int, end: int) -> None:
        self.cue("account", start, end)

    def secret(self, start: int, end: int) -> None:
        self.cue("secret", start, end)

    def start(self, start: int, end: int) -> None:
        if start < self.after["start"]:
            return
        if (start == 0 or not self.text[start - 1].isalnum()) and (m := ISSUED.match(self.text, end)):
            self.after["start"] = m.end()
            if any(map(str.isdigit, m.group())):
                self.add("secret", start, m.end())


def part_valid(digits: str) -> bool:
    digits = digits.lstrip("0")
    return len(digits) <= 3 and int(digits or 0) <= 255


def find(text: str | None, automaton: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) of a text in code points, by start and then kind."""
    if not text:
        return []
    parsers = Parsers(text)
    for last, (parser, length) in automaton.iter(text):
        getattr(parsers, parser)(last - length + 1, last + 1)
    return [(KINDS[k], start, end) for start, k, end in sorted(parsers.spans)]


def listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])


def find_spans(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds spans, all spans as kind:start:end by start and then kind, comma-joined, and base_spans, those of BASE_KINDS.

    Offsets count code points, ends are exclusive. A null or empty text has none. Texts are read whole. Repeated rows and
    other columns stay (columns with the two names are replaced); an empty table gives an empty one.
    """

    def make():
        automaton = build_automaton()

        def work(texts):
            found = [find(t, automaton) for t in texts]
            return [listed(s) for s in found], [listed([x for x in s if x[0] in BASE_KINDS]) for s in found]

        return work

    return map_column(df, text_col, [T.StructField("spans", T.StringType()), T.StructField("base_spans", T.StringType())], make)


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The table with each span of text_col replaced by its kind in angle brackets; overlapping spans are replaced as one."""

    def make():
        automaton = build_automaton()

        def one(text):
            if text is None:
                return None
            out, at = [], 0
            for kind, start, end in find(text, automaton):
                if start >= at:
                    out += [text[at:start], f"<{kind}>"]
                at = max(at, end)
            return "".join([*out, text[at:]])

        return lambda texts: [list(map(one, texts))]

    columns = df.columns
    return map_column(df, text_col, [T.StructField(text_col, T.StringType())], make).select(*columns)


def digests(found: DataFrame) -> DataFrame:
    """Counts of base kinds and the digest of base spans."""
    kinds = F.transform(F.split("base_spans", ","), lambda s: F.split_part(s, F.lit(":"), F.lit(1)))
    n = lambda kind: F.size(F.filter(kinds, lambda k: k == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select("doc_id", *map(n, BASE_KINDS), F.sha2("base_spans", 256).alias("base_sha256"), "spans")
