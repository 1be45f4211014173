"""Personal data by anchor expansion: Aho-Corasick finds anchors, local parsers expand and validate what lies around them.

An anchor is an at-sign, a scheme, a colon, a plus before a digit, two neighbouring digits of a number or an
identifier's cue word. Its parser reads outwards as far as the format allows, so a text is read once by the automaton
and each place at most a few times by parsers; a kind's next anchors within what its parser has read are passed over.
"""

from __future__ import annotations

import ipaddress
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import small_batches, text_bytes

#: Kinds in their order: the four base kinds, then those that the method adds.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "ipv6", "iban", "ssn", "account", "login", "secret")

#: Words before an identifier, lower case, with the parser that reads on behind them.
CUES = {
    "iban": "iban",
    "ssn": "ssn", "social security": "ssn",
    "account": "account", "acct": "account", "konto": "account",
    "tel": "call", "phone": "call", "telephone": "call", "mobile": "call", "fax": "call", "mailto:": "mailto",
    "password": "secret", "passwd": "secret", "token": "secret", "secret": "secret", "api_key": "secret", "api-key": "secret", "apikey": "secret", "akia": "key",
}

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HEX = frozenset("0123456789abcdefABCDEF:")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_WIDE_DOMAIN = re.compile(r"[\w-]++(?:\.[\w-]++)++")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_NUMBER = re.compile(r"[0-9](?:[ -]?[0-9])*+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_GROUP = re.compile(r"[0-9]+")
_IBAN = re.compile(r"[^0-9A-Za-z]{0,3}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})(?![A-Z0-9])")
_SSN = re.compile(r"\D{0,12}?([0-9]{3})([ -])([0-9]{2})\2([0-9]{4})(?![0-9])")
_ACCOUNT = re.compile(r"(?: (?:no\.?|number|nr\.?))?[ :#]{1,3}([0-9](?:[ -]?[0-9]){5,16})(?![0-9])", re.I)
_CALL = re.compile(r"(?: (?:no\.?|number))?[ :.]{1,3}(\(?[0-9][ ().0-9-]{5,}[0-9])", re.I)
_SECRET = re.compile(r"""["']?[ ]?[=:][ ]?["']?([A-Za-z0-9_+/.=-]{8,})""")
_KEY = re.compile(r"[A-Z0-9]{16}(?![A-Za-z0-9])")
_LOGIN = re.compile(r"""[^\s/?#@:"'<>]+:[^\s/?#@"'<>]+@[^\s/?#@:"'<>]+""")
#: Digits in the groups of a card number that is written in groups.
_CARD_SHAPES = {(4, 4, 4, 4), (4, 6, 5), (4, 6, 4), (4, 4, 4, 4, 3)}


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _address(groups: list[str]) -> bool:
    return all(len(g := x.lstrip("0")) <= 3 and int(g or "0") <= 255 for x in groups)


class Scanner:
    """Finds the spans of one text after another: (kind, start, end, base), in code points, end exclusive."""

    def __init__(self) -> None:
        import ahocorasick

        anchors = {"@": "email", "://": "login", ":": "ipv6"}
        digits = "0123456789"
        anchors |= {f"+{d}": "phone" for d in digits} | {f"{a}.{b}": "ip" for a in digits for b in digits}
        anchors |= {f"{a}{s}{b}": "card" for a in digits for b in digits for s in ("", " ", "-")} | CUES
        self.automaton = ahocorasick.Automaton()
        for text, parser in anchors.items():
            self.automaton.add_word(text, (getattr(self, f"_{parser}"), len(text)))
        self.automaton.make_automaton()

    def spans(self, raw: bytes) -> list[tuple[str, int, int, bool]]:
        self.text = raw.decode("utf-8", "replace")
        self.low = raw.translate(_LOWER).decode("utf-8", "replace")
        self.found: set[tuple[str, int, int, bool]] = set()
        self.done = dict.fromkeys((*KINDS, "call", "mailto", "wide"), 0)
        for last, (parser, size) in self.automaton.iter(self.low):
            parser(last + 1 - size, last + 1)
        base = {x[:3] for x in self.found if x[3]}
        return sorted((x for x in self.found if x[3] or x[:3] not in base), key=lambda x: (x[1], KINDS.index(x[0]), x[2]))

    def _add(self, kind: str, start: int, end: int, base: bool = False) -> None:
        self.found.add((kind, start, end, base))

    def _email(self, at: int, end: int) -> None:
        start, floor = at, self.done["email"]
        while start > floor and self.text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (domain := _DOMAIN.match(self.text, end)):
            self.done["email"] = domain.end()
            self._add("email", start, domain.end(), True)
        # an address with other letters than a-z is longer, or has no base span
        wide, floor = start, self.done["wide"]
        while wide > floor and (self.text[wide - 1] in _LOCAL or self.text[wide - 1].isalnum()):
            wide -= 1
        if wide < at and (domain := _WIDE_DOMAIN.match(self.text, end)) and (wide < start or not self.text[end : domain.end()].isascii()):
            self.done["wide"] = domain.end()
            self._add("email", wide, domain.end())

    def _ip(self, start: int, end: int) -> None:
        if start < self.done["ip"]:
            return
        while start > self.done["ip"] and self.text[start - 1] in "0123456789":
            start -= 1
        chain = _DOTTED.match(self.text, start)
        self.done["ip"] = chain.end()
        groups = [(m.start(), m.end()) for m in _GROUP.finditer(self.text, start, chain.end())]
        for i in range(0, len(groups) - 3, 4):
            if _address([self.text[a:b] for a, b in groups[i : i + 4]]):
                self._add("ip", groups[i][0], groups[i + 3][1], True)

    def _card(self, start: int, end: int) -> None:
        if start < self.done["card"]:
            return
        end = _NUMBER.match(self.text, start).end()
        self.done["card"] = end
        digits = self.text[start:end].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            self._add("card", start, end, True)
        elif len(digits) > 12:
            self._inner_cards(start, end)

    def _inner_cards(self, start: int, end: int) -> None:
        """Cards among the groups of a longer number: leftmost first, of issuers' first digits, in usual groups."""
        groups = [(m.start(), m.end()) for m in _GROUP.finditer(self.text, start, end)]
        i = 0
        while i < len(groups):
            for n in (5, 4, 3, 1):
                part = groups[i : i + n]
                shape, digits = tuple(b - a for a, b in part), "".join(self.text[a:b] for a, b in part)
                if digits[0] in "3456" and (shape in _CARD_SHAPES or len(shape) == 1 and 13 <= shape[0] <= 19) and luhn(digits):
                    self._add("card", part[0][0], part[-1][1])
                    i += len(part) - 1
                    break
            i += 1

    def _phone(self, start: int, end: int) -> None:
        if (found := _PHONE.match(self.text, start)) and 9 <= sum(x.isdigit() for x in found[0]) <= 15:
            self._add("phone", start, found.end(), True)

    def _call(self, start: int, end: int) -> None:
        if self._word(start) and (found := _CALL.match(self.text, end)) and 7 <= sum(x.isdigit() for x in found[1]) <= 15:
            self._add("phone", found.start(1), found.end())

    def _mailto(self, start: int, end: int) -> None:
        """The address's at-sign is an anchor of its own; the parser is here for the scheme's sake only where the address is written with %40."""
        found = re.compile(r"([A-Za-z0-9._+-]+)%40" + _DOMAIN.pattern).match(self.text, end)
        if found:
            self._add("email", end, found.end())

    def _ipv6(self, start: int, end: int) -> None:
        if start < self.done["ipv6"]:
            return
        floor = self.done["ipv6"]
        while start > floor and self.text[start - 1] in _HEX:
            start -= 1
        while end < len(self.text) and self.text[end] in _HEX:
            end += 1
        self.done["ipv6"] = end
        if 4 < end - start <= 40 and self.text.count(":", start, end) >= 2 and not self._inside(start, end):
            part = self.text[start:end]
            if part.endswith(":") and not part.endswith("::"):
                part, end = part[:-1], end - 1
            try:
                ipaddress.IPv6Address(part)
            except ValueError:
                return
            self._add("ipv6", start, end)

    def _iban(self, start: int, end: int) -> None:
        if self._word(start) and (found := _IBAN.match(self.text, end)):
            code = found[1].replace(" ", "")
            if 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1:
                self._add("iban", found.start(1), found.end(1))

    def _ssn(self, start: int, end: int) -> None:
        found = _SSN.match(self.text, end) if self._word(start) else None
        if found and found[1] not in ("000", "666") and found[1] < "900" and found[3] != "00" and found[4] != "0000":
            self._add("ssn", found.start(1), found.end())

    def _account(self, start: int, end: int) -> None:
        if self._word(start) and (found := _ACCOUNT.match(self.text, end)):
            self._add("account", found.start(1), found.end(1))

    def _login(self, start: int, end: int) -> None:
        if found := _LOGIN.match(self.text, end):
            while start > 0 and self.low[start - 1] in "abcdefghijklmnopqrstuvwxyz0123456789+.-":
                start -= 1
            self._add("login", start, found.end())

    def _secret(self, start: int, end: int) -> None:
        found = _SECRET.match(self.text, end)
        if found and any(x.isdigit() for x in found[1]):
            self._add("secret", found.start(1), found.end(1))

    def _key(self, start: int, end: int) -> None:
        if self.text[start:end] == "AKIA" and self._word(start) and (found := _KEY.match(self.text, end)):
            self._add("secret", start, found.end())

    def _word(self, start: int) -> bool:
        """A cue begins here, and not within a word."""
        return start == 0 or not self.low[start - 1].isalnum()

    def _inside(self, start: int, end: int) -> bool:
        """Letters or digits go on at an end."""
        return self._word(start) is False or end < len(self.text) and self.text[end].isalnum()


_SPAN = "array<struct<kind:string,start:long,end:long,base:boolean>>"


def _find(batches):
    import pyarrow as pa

    scanner = Scanner()
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])
    for batch in batches:
        offsets, parts = [0], ([], [], [], [])
        for raw in text_bytes(batch.column(1)):
            for span in scanner.spans(raw):
                for part, x in zip(parts, span, strict=True):
                    part.append(x)
            offsets.append(len(parts[0]))
        spans = pa.StructArray.from_arrays([pa.array(x, f.type) for x, f in zip(parts, kind, strict=True)], fields=list(kind))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), spans)], names=["id", "spans"])


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and spans for each row of `docs`: kind, start and end in code points (end exclusive), and whether it is a base span.

    Base spans are the leftmost non-overlapping matches of each of the four base formats that pass their check. Others:
    addresses with letters beyond a-z, cards among the groups of a longer number, phone numbers behind a cue, IPv6
    addresses, IBANs, social security and account numbers behind their cue, logins in URLs, keys and passwords. A span
    of the method that equals a base one is not repeated; spans of one text are in the order of start, kind, end.

    A null text counts as empty, which has no spans. Texts are read whole, in time that grows with their length. Rows
    are independent, so ties, repeated rows and an empty table need no rule, and null ids stay; only the two named
    columns are read.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_find, f"id long, spans {_SPAN}")


def span_list(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def digests(found: DataFrame) -> DataFrame:
    """id, the number of base spans of each base kind, the digest of the base spans, and all spans as a string."""
    base = F.filter("spans", lambda x: x["base"])
    count = lambda kind: F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("id", *map(count, BASE), F.sha2(span_list(base).cast("binary"), 256).alias("base_sha256"), span_list(F.col("spans")).alias("spans"))


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with [KIND] in place of each span; of overlapping spans the first, then longest, names all they cover."""
    out, at, last = [], 0, -1
    for kind, start, end in sorted(spans, key=lambda x: (x[1], -x[2], KINDS.index(x[0]))):
        if start >= last:
            out += [text[at:start], f"[{kind.upper()}]"]
            last = end
        last = at = max(last, end)
    return "".join([*out, text[at:]])


def _mask(batches):
    import pyarrow as pa

    scanner = Scanner()
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index("__text"))
        hidden = [None if x is None else masked(x.decode("utf-8", "replace"), [s[:3] for s in scanner.spans(x)]) for x in texts.cast(pa.large_binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(hidden, pa.string())], names=batch.schema.names)


def mask_personal_data(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with [EMAIL], [CARD] and so on in the text column in place of the spans; null texts stay null, other columns stay as they are."""
    small_batches(docs.sparkSession)
    rest = [c for c in docs.columns if c != text_col]
    rows = docs.select(*[docs[c] for c in rest], docs[text_col].cast("string").alias("__text"))
    out = rows.mapInArrow(_mask, rows.schema)
    return out.select(*[out["__text"].alias(c) if c == text_col else out[c] for c in docs.columns])
