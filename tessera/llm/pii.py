"""Personal data: fixed patterns, and a conditional random field that adds what they have no pattern for."""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import common, crf

#: Kinds found by pattern, in the order that breaks ties, all kinds, and those that the field adds: such as have no
#: pattern, and telephone numbers, of which the pattern knows only international ones.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret", "iban", "ssn")
ADDED_KINDS = ("phone", "secret", "iban", "ssn")
#: Characters that are tokenised together.
BATCH_CHARS = 2_000_000

_NAME = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DIGITS = "0123456789"
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTS = re.compile(r"\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9]++(?:[\x20-][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[str, int, int]


def _luhn(digits: str) -> bool:
    twice = [d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2])]
    return (sum(twice) + sum(map(int, digits[::-2]))) % 10 == 0


def _is_ip(found: str) -> bool:
    parts = [p.lstrip("0") for p in found.split(".")]  # of any length: int() refuses long ones
    return all(len(p) <= 3 and int(p or "0") <= 255 for p in parts)


def _is_card(found: str) -> bool:
    digits = found.replace(" ", "").replace("-", "")
    return 12 <= len(digits) <= 19 and _luhn(digits)


def _is_phone(found: str) -> bool:
    return 9 <= sum(map(str.isdigit, found)) <= 15


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, found from their ``@``: each character is looked at a few times at most."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = free + len(text[free:at].rstrip(_NAME))
        host = _HOST.match(text, at + 1) if start < at else None
        if host:
            yield start, host.end()
        free = host.end() if host else at + 1  # no name goes over an @
        at = text.find("@", free)


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    """Matches of ``[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)``, found from their first dot, likewise."""
    free, dots = 0, _DOTS.search(text)
    while dots:
        first = dots.start()
        start = free + len(text[free:first].rstrip(_DIGITS))
        if start < first:
            yield start, dots.end()
        free = dots.end() if start < first else first + 1
        dots = _DOTS.search(text, free)


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns by start, then kind.  Leftmost and non-overlapping per kind; failing matches are dropped without a retry.

    Time is in proportion to the text, whatever it holds.
    """
    found = [("email", a, b) for a, b in _emails(text)]
    found += [("ip", a, b) for a, b in _addresses(text) if _is_ip(text[a:b])]
    found += [("card", *m.span()) for m in _CARD.finditer(text) if m.end() - m.start() >= 12 and _is_card(m[0])]
    found += [("phone", *m.span()) for m in _PHONE.finditer(text) if _is_phone(m[0])]
    return in_order(found)


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def labelled_table(seed: int = 17, copies: int = 20) -> list[tuple[str, list[Span]]]:
    """The small table that the field is trained on, made from a rule: settings, headers and sentences with marked spans
    among made-up words, in forms that such things take in configuration files, code and letters anywhere.

    Besides all kinds it shows what is none: numbers, dates, prices, versions, file hashes, part numbers, shouting,
    tables, and keywords that announce nothing.
    """
    rng = random.Random(seed)
    pick = rng.choice
    alphabet = "aeioulnrstdhmcpgbäéñ"

    def word() -> str:
        made = "".join(pick(alphabet) for _ in range(pick([1, 2, 2, 3, 4, 5, 6, 8, 11])))
        return pick([made, made, made, made.title(), made.upper(), made + ",", made + ".", made.upper() + "!!", made + "$$$", made + " |"])

    def fill(most: int = 7) -> str:
        return pick([" ", " ", "\n"]).join(word() for _ in range(rng.randint(0, most)))

    of = lambda chars: lambda n: "".join(pick(chars) for _ in range(n))
    digits, hexa, capitals = of("0123456789"), of("0123456789abcdef"), of("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    mixed = of("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
    coded = of("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    uuid = lambda: "-".join(map(hexa, (8, 4, 4, 4, 12)))
    strong = lambda: pick([mixed(20), mixed(24), mixed(32), mixed(36), mixed(40), mixed(64), hexa(32), hexa(40), hexa(64), hexa(40).upper(), coded(20), uuid(), f"{mixed(3)}_{mixed(30)}", f"{mixed(2)}-{mixed(24)}", f"{mixed(12)}_{mixed(20)}", f"{mixed(16)}/{mixed(14)}+{mixed(8)}=", f"{mixed(20)}.{mixed(30)}.{mixed(26)}", f"{mixed(2)}-{mixed(8)}-{mixed(24)}"])
    weak = lambda: pick([mixed(8) + digits(1), of("abcdefghij")(6) + digits(3), mixed(5) + pick("!$&*") + mixed(4), capitals(1) + mixed(6) + pick("-_!") + digits(4)])
    name = lambda: pick(["token", "key", "api key", "api_key", "apikey", "API_KEY", "secret", "SECRET_KEY", "client_secret", "access token", "access_token", "auth token", "private key", "credential", "accessKey", "secretKey", "authToken", "bearer", "ACCESS_KEY", "token_" + digits(1)])
    pass_ = lambda: pick(["password", "Password", "PASSWORD", "passwd", "pwd", "DB_PASSWORD", "pass", "passphrase", "user_password"])
    quoted = lambda: pick(["'", '"'])
    idle = lambda: pick(["the key", "a token", "access", "secret", "security", "private", "account", "pass", "auth", "password", "call", "phone", "mobile", "social"])
    dial = lambda: pick(["tel ", "tel. ", "Tel: ", "phone ", "phone: ", "Telephone: ", "call ", "mobile ", "cell: ", "fax ", "Fax: "])
    near = lambda: pick([f"{digits(3)}-{digits(3)}-{digits(4)}", f"({digits(3)}) {digits(3)}-{digits(4)}", f"({digits(3)}) {digits(3)} {digits(4)}", f"{digits(3)} {digits(3)} {digits(4)}", f"{digits(3)}.{digits(3)}.{digits(4)}", f"0{digits(2)} {digits(7)}", f"0{digits(3)} {digits(6)}", f"0{digits(3)}/{digits(6)}", f"0{digits(4)} {digits(3)} {digits(3)}"])
    iban = lambda: pick([f"{capitals(2)}{digits(2)} {capitals(4)} {digits(4)} {digits(4)} {digits(4)}", f"{capitals(2)}{digits(20)}", f"{capitals(2)}{digits(2)} {digits(4)} {digits(4)} {digits(4)} {digits(4)} {digits(2)}", f"{capitals(2)}{digits(2)}{capitals(4)}{digits(14)}"])

    def setting(key: str, kind: str, value: str) -> tuple[str, str, str, str]:
        q = quoted()
        left, right = pick([(f"{key} = {q}", q + pick(["", "", ")", "**", "</", " # " + word()])), (f"{key}={q}", q + pick(["", ";", ")", "**", "`", "|"])), (f"{key}: ", ""), (f"{key}=", pick(["", "&", ";"])), (f"{key} = ", pick(["", ".", ","])), (f"{q}{key}{q}: {q}", q + pick(["", ",", " }"])), (f"{key}:", ""), (f"--{key} ", ""), (f"{key} is ", pick(["", ".", ","]))])
        return left, kind, value, right

    templates = [
        *[lambda: setting(name(), "secret", strong())] * 6, *[lambda: setting(pass_(), "secret", weak())] * 2, lambda: setting(pass_(), "secret", strong()),
        lambda: (pick(["Authorization: Bearer ", "authorization: bearer ", "Authorization: token ", "bearer "]), "secret", strong(), ""), lambda: (f"?{name()}=", "secret", strong(), pick(["", "&", " "])),
        lambda: setting(pick(["iban", "IBAN", "account", "account number"]), "iban", iban()), lambda: (pick(["iban ", "IBAN ", "account "]), "iban", iban(), pick(["", ".", ","])),
        lambda: (pick(["ssn ", "SSN: ", "social security number ", "security number: ", "SSN is "]), "ssn", f"{digits(3)}-{digits(2)}-{digits(4)}", pick(["", ".", ","])),
        *[lambda: (dial(), "phone", near(), pick(["", ".", ","]))] * 3, lambda: ("", "phone", f"({digits(3)}) {digits(3)}-{digits(4)}", ""),
        lambda: ("", "phone", f"+1 ({digits(3)}) 555-{digits(4)}", ""), lambda: (pick(["", dial()]), "phone", f"+{digits(2)} {digits(3)} {digits(6)}", ""),
        lambda: ("", "email", f"{word().strip('.,!$| ').lower() or 'x'}.{digits(2)}@mail{digits(1)}.example.com", ""), lambda: ("", "ip", ".".join(str(rng.randrange(256)) for _ in range(4)), ""),
        lambda: ("", "card", digits(16), ""), lambda: ("", "card", f"{digits(4)} {digits(4)} {digits(4)} {digits(4)}", ""),
        *[lambda: (f"{idle()} ", "", word(), " of it"), lambda: (f"{idle()} ", "", fill(5), f" {idle()}")] * 2, lambda: (f"{idle()} {pick(['=', ':', 'is'])} ", "", pick([digits(2), word(), "none", "null", "true", "required", digits(4)]), ""),
        lambda: (f"{idle()} ", "", f"{digits(1)} times", ""), lambda: (f"{idle()} ", "", pick([f"{digits(4)}-{digits(2)}-{digits(2)}", f"{digits(2)}.{digits(2)}.{digits(4)}", digits(3), f"{digits(2)}:{digits(2)}"]), ""),
        lambda: ("", "", digits(rng.randint(1, 12)), ""), lambda: (pick(["in ", "from ", "page "]), "", str(rng.randint(1900, 2030)), ""), lambda: ("", "", f"{digits(2)}.{digits(2)}", " EUR"), lambda: ("version ", "", f"{digits(1)}.{digits(1)}.{digits(1)}", ""),
        lambda: (pick(["commit ", "sha1 ", "revision ", "md5: ", "checksum "]), "", pick([hexa(40), hexa(32), hexa(7)]), ""), lambda: ("", "", pick([hexa(32), hexa(40), hexa(64)]), " file"), lambda: ("id ", "", uuid(), ""),
        lambda: (pick(["", "part ", "order ", "no. "]), "", pick([f"{digits(3)}-{digits(2)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"{digits(4)}-{digits(4)}", f"{capitals(2)}{digits(4)}-{digits(3)}"]), pick(["", " parts"])),
        lambda: ("ISBN ", "", f"{digits(3)}-{digits(1)}-{digits(2)}-{digits(6)}-{digits(1)}", ""), lambda: ("", "", f"{digits(4)}-{digits(2)}-{digits(2)}", pick(["", f" {digits(2)}:{digits(2)}"])), lambda: ("", "", f"{digits(1)},{digits(3)},{digits(3)}", ""), lambda: ("", "", f"{digits(2)}-{digits(2)}", ""),
        lambda: ("", "", " | ".join(word() for _ in range(4)), ""), lambda: ("", "", capitals(rng.randint(2, 24)), "!!"), lambda: ("", "", mixed(rng.randint(10, 30)), ""), lambda: ("", "", fill(20), ""), lambda: ("", "", fill(20), ""),
    ]
    rows = []
    for _ in range(copies):
        for template in templates:
            left, kind, found, right = template()
            start = fill()
            start = f"{start} {left}" if start else left
            end = fill()
            rows.append((start + found + right + (" " + end if end else ""), [(kind, len(start), len(start) + len(found))] if kind else []))
    return rows


@lru_cache(maxsize=1)
def default_field() -> crf.Crf:
    return crf.train(labelled_table(), KINDS)


def all_spans(texts: list[str], field: crf.Crf) -> list[tuple[list[Span], list[Span]]]:
    """Per text its base spans and all spans: base ones, and those of ``ADDED_KINDS`` that the field finds.

    A found span that overlaps a base one is added only where it holds it whole, as a key does whose digits would pass
    for a card's, and says more than it.
    """
    out, at = [], 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) <= BATCH_CHARS):
            size += len(texts[to])
            to += 1
        for text, found in zip(texts[at:to], field.spans(texts[at:to])):
            base = base_spans(text)
            extra = [s for s in found if s[0] in ADDED_KINDS and all(_apart(s, b) or _holds(s, b) for b in base)]
            out.append((base, in_order(base + extra)))
        at = to
    return out


def _apart(one: Span, other: Span) -> bool:
    return one[2] <= other[1] or other[2] <= one[1]


def _holds(one: Span, other: Span) -> bool:
    return one[0] not in BASE_KINDS and one[1] <= other[1] and other[2] <= one[2]


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redacted(text: str, spans: list[Span]) -> str:
    """``text`` with each group of overlapping spans replaced by the kind of its first, in brackets and capitals."""
    parts, at, end = [], 0, 0
    for kind, a, b in spans:
        if a >= end or not parts:
            parts += [text[at:a], f"[{kind.upper()}]"]
        end = max(end, b)
        at = end
    return "".join([*parts, text[at:]])


def find(docs: DataFrame, field: crf.Crf | None = None) -> DataFrame:
    """Per row: ``doc_id``, counts of base spans ``n_email, n_ip, n_card, n_phone``, ``base_sha256`` of the written base
    spans, and ``spans``, all of them written as kind:start:end, comma-joined, in code points, end exclusive.

    A null text is empty; repeated rows are searched each; an empty table gives no rows; other columns are ignored.
    One narrow pass.  ``field`` is a trained field with the kinds of ``KINDS``, by default that of ``labelled_table``.
    """
    model = field or default_field()
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(f"n_{k}", T.LongType()) for k in BASE_KINDS), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = all_spans([t or "" for t in batch.column(1).to_pylist()], model)
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in BASE_KINDS]
            digests = pa.array([hashlib.sha256(written(base).encode()).hexdigest() for base, _ in found], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, digests, pa.array([written(spans) for _, spans in found], pa.string())], names=schema.names)

    return common.map_arrow(docs.select("doc_id", F.col("text").cast("string")), run, schema)


def redact(docs: DataFrame, field: crf.Crf | None = None) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind, as ``[EMAIL]``; all rows and other columns stay.

    Null texts stay null.  A column ``n_chars``, where there is one, is not recounted: it describes the source.
    """
    model = field or default_field()
    schema = docs.schema
    place = schema.names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place).to_pylist()
            found = all_spans([t or "" for t in texts], model)
            columns = list(batch.columns)
            columns[place] = pa.array([None if t is None else redacted(t, spans) for t, (_, spans) in zip(texts, found)], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return common.map_arrow(docs, run, schema)


def _query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(common.table(spark, sf_dir, "documents"))


QUERIES = {"op8_crf_pii": _query}
ORACLE_SQL: dict[str, str] = {}
