"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, digit pairs, plus signs
before digits, schemes and identifier cues. A deterministic parser for each kind of
anchor expands it to the left and right, within the characters that the kind may
have, and validates what it got.

Kinds: email, ip, card and phone (the base), and what the method adds: ``login``
(user and password in a URL), ``iban`` (an account number behind any anchor of two
letters' check digits, valid by modulus 97), ``ssn`` and ``account`` (numbers right
behind such a cue), ``secret`` (what a cue like token, key or password is set to, if
it looks drawn rather than written; keys of known forms without a cue),
``username`` (what such a cue is set to), ``ipv6`` and ``address`` (house number and
street). Of one kind, spans never overlap: a span begins behind the one before it,
and a base match that fails its validation still takes up its characters. Offsets
are code points, ends exclusive.

Defined results: a null text counts as empty and has no spans; repeated rows give
repeated results; an empty table gives an empty result; extra columns aren't read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from ipaddress import IPv6Address

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaporline.llm.common import ready, text_of

#: Base kinds in the order in which they are listed, then the added ones.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "login", "iban", "ssn", "account", "secret", "username", "ipv6", "address")

DIGITS = "0123456789"
SCHEMES = ("http://", "https://", "ftp://", "ssh://", "redis://", "mysql://", "postgres://", "mongodb://")
SSN_CUES = ("ssn", "social security number", "social security no")
ACCOUNT_CUES = ("account", "acct", "a/c no", "routing number", "passport number", "passport no", "customer id", "member id")
SECRET_CUES = ("token", "secret", "password", "passwd", "passphrase", "pwd", "api key", "api_key", "api-key", "apikey", "access key", "access_key", "access-key", "private key", "private_key", "secret key", "secret_key", "credential", "bearer")
USER_CUES = ("username", "user name", "user_name", "user id", "user_id", "userid", "login", "user")
#: How keys that need no cue begin.
KEY_STARTS = ("AKIA", "ASIA", "ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "xoxb-", "xoxp-", "xoxa-", "sk_live_", "rk_live_", "sk-", "AIza", "eyJ", "-----BEGIN ")
STREETS = ("Street", "St.", "Road", "Rd.", "Avenue", "Ave.", "Boulevard", "Blvd.", "Lane", "Drive", "Square", "Court", "Terrace")
HEX = "0123456789abcdefABCDEF"

#: What stands left of an at-sign; matched backwards by scanning.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CHAIN = re.compile(r"[0-9](?:[\x20-]?[0-9])*")
_DIAL = re.compile(r"[\x20().0-9-]+")
_USERINFO = re.compile(r"[A-Za-z0-9._~%!$&'()*+,;=-]+:[^\s/@?#]+@")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"[\s:#.]{1,4}([0-9]{3}[\x20-]?[0-9]{2}[\x20-]?[0-9]{4})(?![0-9])")
_ACCOUNT = re.compile(r"(?:[\s_]?(?:[Nn][Oo]|[Nn]umber|NUMBER|[Ii][Dd])\b)?[\s:#.=]{1,4}([A-Z]{0,3}[0-9][0-9-]{4,18}[0-9])(?![A-Za-z0-9])")
#: Behind a cue: at most one more word part, a closing quote, an equals sign or colon.
_SET = r"[A-Za-z0-9_-]{0,16}[\"'\x60]?\s{0,3}(?:=>|:=|=|:)\s{0,3}"
_QUOTED = re.compile(_SET + r"([\"'\x60])([^\s\"'\x60]{6,512})\1")
_BARE = re.compile(_SET + r"([A-Za-z0-9_.~+/!@#$%^&*=-]{8,512})")
_BEARER = re.compile(r"\s{1,2}([A-Za-z0-9_.~+/-]{16,2048}=*)")
_USER = re.compile(_SET + r"([\"'\x60]?)([A-Za-z][A-Za-z0-9._@-]{1,63})\1(?![A-Za-z0-9])")
_KEYS = re.compile(
    r"(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Za-z])|gh[pos]_[0-9A-Za-z]{36,}|github_pat_[0-9A-Za-z_]{22,}|glpat-[0-9A-Za-z_-]{20,}|xox[bpa]-[0-9A-Za-z-]{10,}"
    r"|[sr]k_live_[0-9A-Za-z]{16,}|sk-[0-9A-Za-z_-]{20,}|AIza[0-9A-Za-z_-]{35}|eyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}"
    r"|-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----[0-9A-Za-z+/=\s\\]{0,16384}(?:-----END [A-Z ]{0,32}PRIVATE KEY-----)?"
)
_SIXES = re.compile(r"[0-9A-Fa-f:]+(?:[0-9]{1,3}(?:\.[0-9]{1,3}){3})?")
_HOUSE = re.compile(r"(?:^|(?<![0-9A-Za-z.,]))([0-9]{1,5}[A-Za-z]?[\x20](?:[A-Z][A-Za-z'.-]{1,20}[\x20]){1,3})$")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) << (i & 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def mod97(iban: str) -> bool:
    rest = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in rest)) % 97 == 1


def _byte_sized(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


@lru_cache(maxsize=1)
def automaton():
    """Anchors to the parsers that they start."""
    import ahocorasick

    found: dict[str, list[str]] = {}
    for anchor, parser in [
        ("@", "email"),
        *((f"+{d}", "phone") for d in DIGITS),
        *((f"{a}.{b}", "ip") for a in DIGITS for b in DIGITS),
        *((f"{a}{gap}{b}", "card") for a in DIGITS for b in DIGITS for gap in ("", " ", "-")),
        *((s, "login") for s in SCHEMES),
        *((f"{c}{d}", "iban") for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for d in DIGITS),
        *((v, "ssn") for s in SSN_CUES for v in (s, s.upper(), s.capitalize(), s.title())),
        *((v, "account") for s in ACCOUNT_CUES for v in (s, s.upper(), s.capitalize(), s.title())),
        *((v, "secret") for s in SECRET_CUES for v in (s, s.upper(), s.capitalize(), s.title())),
        *((s, "secret") for s in KEY_STARTS),
        *((v, "username") for s in USER_CUES for v in (s, s.upper(), s.capitalize(), s.title())),
        *((f"{a}:", "ipv6") for a in HEX),
        ("::", "ipv6"),
        *((f" {s}", "address") for s in STREETS),
    ]:
        found.setdefault(anchor, []).append(parser)
    out = ahocorasick.Automaton()
    for anchor, parsers in found.items():
        out.add_word(anchor, (len(anchor), tuple(dict.fromkeys(parsers))))
    out.make_automaton()
    return out


def find(text: str) -> dict[str, list[tuple[int, int]]]:
    """The spans of each kind, in order."""
    spans: dict[str, list[tuple[int, int]]] = {kind: [] for kind in KINDS}
    done = dict.fromkeys(KINDS, 0)  # up to where each kind's matches have taken the text
    for last, (size, parsers) in automaton().iter(text):
        for kind in parsers:
            start = last + 1 - size
            if start < done[kind]:
                continue
            match = _PARSERS[kind](text, start, last + 1, done[kind])
            if match is not None:
                begin, end, good = match
                done[kind] = end
                if good:
                    spans[kind].append((begin, end))
    return spans


def _email(text: str, at: int, after: int, done: int):
    begin = at
    while begin > done and text[begin - 1] in _LOCAL:
        begin -= 1
    domain = _DOMAIN.match(text, after) if begin < at else None
    return domain and (begin, domain.end(), True)


def _ip(text: str, at: int, after: int, done: int):
    """Four numbers from the anchor's first one on; fewer than four give no match."""
    begin = at
    while begin > done and text[begin - 1] in DIGITS:
        begin -= 1
    parts = _DOTTED.match(text, begin).group().split(".")
    if len(parts) < 4:
        return begin, begin + sum(map(len, parts)) + len(parts) - 1, False
    end = begin + sum(map(len, parts[:4])) + 3
    return begin, end, all(map(_byte_sized, parts[:4]))


def _card(text: str, at: int, after: int, done: int):
    end = _CHAIN.match(text, at).end()
    digits = [c for c in text[at:end] if c in DIGITS]
    return at, end, 16 <= len(digits) <= 19 and luhn("".join(digits))


def _phone(text: str, at: int, after: int, done: int):
    run = _DIAL.match(text, after)
    if run is None:
        return None
    tail = run.end()
    while tail > after and text[tail - 1] not in DIGITS:
        tail -= 1
    if tail - after < 2:  # something must stand between the first and the last digit
        return None
    return at, tail, 8 <= sum(c in DIGITS for c in text[at:tail]) <= 15


def _login(text: str, at: int, after: int, done: int):
    match = _USERINFO.match(text, after)
    return match and (after, match.end() - 1, True)


def _iban(text: str, at: int, after: int, done: int):
    begin = at - 1
    if begin < 0 or begin and text[begin - 1].isalnum():
        return None
    match = _IBAN.match(text, begin)
    if match is None:
        return None
    plain = match.group().replace(" ", "")
    return (begin, match.end(), True) if 15 <= len(plain) <= 34 and mod97(plain) else None


def _behind(pattern: re.Pattern):
    def parse(text: str, at: int, after: int, done: int):
        if at and text[at - 1].isalnum():
            return None
        match = pattern.match(text, after)
        return match and (match.start(1), match.end(1), True)

    return parse


def drawn(value: str) -> bool:
    """Whether a value looks like a key or password: of two kinds of characters and of
    many different ones, not a written word or a plain number."""
    kinds = sum(any(c in some for c in value) for some in (DIGITS, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")) + any(not c.isalnum() for c in value[1:-1])
    return kinds > 1 and any(not c.isalpha() for c in value) and len(set(value)) >= min(6, len(value) - 1)


def _secret(text: str, at: int, after: int, done: int):
    cue = text[at:after]
    if cue in KEY_STARTS:
        match = None if at and (text[at - 1].isalnum() or text[at - 1] == "_") else _KEYS.match(text, at)
        return match and (match.start(), match.end(), True)
    if cue.lower() == "bearer":
        match = _BEARER.match(text, after)
        if match is not None:
            return (match.start(1), match.end(1), True) if drawn(match.group(1)) else None
    match = _QUOTED.match(text, after)
    if match is not None:
        return (match.start(2), match.end(2), True) if drawn(match.group(2)) else None
    match = _BARE.match(text, after)
    return (match.start(1), match.end(1), True) if match is not None and drawn(match.group(1)) else None


def _username(text: str, at: int, after: int, done: int):
    if at and text[at - 1].isalnum():
        return None
    match = _USER.match(text, after)
    return match and (match.start(2), match.end(2), True)


def _ipv6(text: str, at: int, after: int, done: int):
    """The run of hexadecimal digits and colons around the anchor, if it is an address
    of eight groups or one shortened by a double colon."""
    begin = at
    while begin > done and text[begin - 1] in HEX:
        begin -= 1
    if begin and (text[begin - 1].isalnum() or text[begin - 1] == ":"):
        return None
    end = _SIXES.match(text, begin).end()
    if text[end : end + 1].isalnum():
        return None
    value = text[begin:end]
    if value.endswith(":") and not value.endswith("::"):
        value = value[:-1]
    if len(value) < 6 or value.count(":") < 2:
        return None
    try:
        IPv6Address(value)
    except ValueError:
        return None
    return begin, begin + len(value), True


def _address(text: str, at: int, after: int, done: int):
    if text[after : after + 1].isalnum():
        return None
    begin = max(done, at - 70)
    match = _HOUSE.search(text[begin : at + 1])
    return match and (begin + match.start(1), after, True)


_PARSERS = {"email": _email, "ip": _ip, "card": _card, "phone": _phone, "login": _login, "iban": _iban, "ssn": _behind(_SSN), "account": _behind(_ACCOUNT), "secret": _secret, "username": _username, "ipv6": _ipv6, "address": _address}


def find_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id and spans, an array of (kind, start, end) by kind as
    listed in KINDS, then start. A map over partitions: no shuffle."""
    ready(docs.sparkSession)
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column(1):
                spans = find(text.as_py())
                found.append([{"kind": k, "start": a, "end": b} for k in KINDS for a, b in spans[k]])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, span)], ["doc_id", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def masked(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id and text with each span replaced by its kind in
    angle brackets; of overlapping spans the one that starts first (then the longer)."""
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value in batch.column(1):
                text, pieces, done = value.as_py(), [], 0
                for a, b, kind in sorted(((a, b, k) for k, spans in find(text).items() for a, b in spans), key=lambda x: (x[0], -x[1])):
                    if a >= done:
                        pieces += [text[done:a], f"<{kind}>"]
                        done = b
                out.append("".join(pieces) + text[done:])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, text string")


def of_kinds(spans: Column, kinds: tuple[str, ...]) -> Column:
    return F.filter(spans, lambda s: s.kind.isin(*kinds))


def written(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
